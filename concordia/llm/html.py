"""HTML extraction: the best contiguous content region of a page.

Method (maximum-scoring subsequence, Pasternack and Roth): a page is a row of
text runs and tags.  Words score positive and tags negative, and one linear
scan finds the contiguous region with the largest sum; its text, without the
elements that are never content, is the main text.

The weights come from labelled pages: a page whose author marks its content
with one ``article`` (or else one ``main``) element says of every word and tag
whether it is content.  A tag costs ``TAG_COST`` times its share outside the
content, shrunk towards nothing while it was seldom seen (and a little in any case);
tags that any content may hold (``PLAIN``) cost a little only, so that what decides
about a list, a link or a table is the words around it.  A word counts by the log
odds of its enclosing element (tag and first class), between -1 and 1; where that
element was never seen, by those of its tag, at least ``UNSEEN``.  The names of all elements around a word (whole class
names, id, role, and the tags of ``MARKS``) have such odds too, and the lowest
counts where it is lower; ``BOILERPLATE`` is only what is thought of a name before
labels are seen (``PRIOR`` words outside the content).  Elements around the
content itself say nothing against a name.  The weights are fitted on ``FIT_PAGES`` labelled pages
with the smallest hash of their id; every page is then scored, whole.  Where the
page that is scored marks its content itself, this is strong evidence, no more: words
outside the mark count ``OUTSIDE``, those inside ``INSIDE`` at least.  A page
whose words all count against it is scored once more without its names.

Text: character references are decoded; white space within a block becomes one
space; blocks (block elements and line breaks end one) are joined by a newline.

Defined cases
* null, empty or text-free html: an empty text;
* without labelled pages the default weights hold (words 1, tags a little);
* an element whose end tag may be left out ends where the next of its kind or its
  parent ends, others with their parent, at any depth; an end tag without a start
  is ignored; text of ``NEVER`` elements and hidden ones counts 0 and is left out; a ``<`` that starts no tag is text;
* repeated rows are extracted alike; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.columns import emit, table, texts

FIT_PAGES = 2000
TAG_COST = 10.0
LEAST_COST = 0.05       # of any tag
SELDOM = 50             # tags that a share is shrunk with
UNSEEN = 0.5            # a word of an element that no labelled page has, where its tag is no better
INSIDE, OUTSIDE = 0.5, -0.5  # words inside and outside what the page marks as its content

PRIOR = 20              # words outside the content that a name of BOILERPLATE starts with

#: elements whose text is no running text of the page
NEVER = frozenset("""head title script style noscript template iframe object svg canvas select option input textarea
label button dialog audio video""".split())
#: tags that count as names
MARKS = frozenset("nav menu header footer aside form figcaption".split())
#: names that are taken for boilerplate until labels say otherwise
BOILERPLATE = frozenset("""ad ads advert advertisement advertising adverts sponsor sponsored promo promotion banner
nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo
comment comments disqus respond reply replies notice notices alert cookie cookies consent gdpr popup modal overlay figcaption
newsletter subscribe signup login search share sharing social related recommended recommendations widget toolbar
pagination pager tags skip copyright""".split())
#: elements that start and end a block of text
BLOCKS = frozenset("""address article aside blockquote body br button caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre
section select summary table tbody td tfoot th thead title tr ul""".split())
#: elements that content holds as often as what is around it
PLAIN = frozenset("""a abbr article b blockquote br code dd del div dl dt em figure h1 h2 h3 h4 h5 h6 hr i img ins kbd li main
mark ol p pre q s samp section small span strong sub sup table tbody td tfoot th thead time tr u ul""".split())
#: start tag -> (open elements that it ends, elements that they are looked for within)
_SCOPE = frozenset("table td th caption button object template".split())
ENDS = {name: (frozenset({"p"}), _SCOPE) for name in """address article aside blockquote center details dialog dir div dl
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary ul""".split()}
ENDS |= {"li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
         "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
         "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
         "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select", "datalist"})),
         "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
         "tr": (frozenset({"tr"}), frozenset({"table"})),
         **{name: (frozenset({"thead", "tbody", "tfoot", "caption"}), frozenset({"table"})) for name in ("thead", "tbody", "tfoot")}}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-z][^>]*>|<[!?][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(kind, name, attributes, text): kind is text, open or close."""
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", "", "", page[at:m.start()]
        at = m.end()
        if m[3]:
            yield ("close" if m[2] else "open"), m[3].lower(), m[4] or "", ""
    if at < len(page):
        yield "text", "", "", page[at:]


def element_key(name: str, attributes: str) -> tuple[str, frozenset[str], bool]:
    """(tag with its first class, names, whether its text is never content)."""
    key, never, marks = name, name in NEVER, {name} & MARKS
    if attributes:
        for a in _ATTRIBUTE.finditer(attributes):
            names = a[2].lower().strip("\"'").split()
            if a[1].lower() == "class" and names:
                key = f"{name}.{names[0]}"
            marks.update(names)
        never = never or bool(_HIDDEN.search(_ATTRIBUTE.sub("", re.sub(r"\"[^\"]*\"|'[^']*'", "''", attributes))))
    if name in ("html", "body"):
        return key, frozenset(), False
    return key, frozenset(marks), never


class Elements:
    """The elements of a page in page order, and which are open."""

    def __init__(self):
        self.parent: list[int] = []
        self.marks: list[frozenset[str]] = []
        self._open: list[tuple[str, str, bool, int]] = []
        self._places: dict[str, list[int]] = {}  # name -> where it lies among the open ones

    def _last(self, names) -> int:
        return max((self._places[x][-1] for x in names if self._places.get(x)), default=-1)

    def _cut(self, at: int) -> None:
        while len(self._open) > at:
            self._places[self._open.pop()[0]].pop()

    def around(self) -> tuple[str, bool, int]:
        """(key, never, number) of the innermost open element."""
        return self._open[-1][1:] if self._open else ("", False, -1)

    def start(self, name: str, attributes: str) -> bool:
        ended, within = ENDS.get(name, ((), ()))
        at = self._last(ended)
        if at > self._last(within):
            self._cut(at)
        if name == "li" or name in ("dt", "dd"):  # a paragraph in the one before is gone with it
            at = self._last(("p",))
            if at > max(self._last(_SCOPE), self._last(within)):
                self._cut(at)
        key, marks, never = element_key(name, attributes)
        never = never or self.around()[1]
        if name not in VOID and not attributes.endswith("/"):
            self.parent.append(self.around()[2])
            self.marks.append(marks)
            self._places.setdefault(name, []).append(len(self._open))
            self._open.append((name, key, never, len(self.parent) - 1))
        return never

    def end(self, name: str) -> bool:
        at = self._last((name,))
        if at >= 0:
            self._cut(at)
        return self.around()[1]


def units(page: str, elements: Elements) -> Iterator[tuple[str, str, str, bool, int]]:
    """(kind, key, text, never, number of the innermost element): every text run
    with its enclosing element, and every tag, in page order."""
    for kind, name, attributes, text in tokens(page):
        if kind == "text":
            key, never, number = elements.around()
            yield "text", key, text, never, number
        else:
            never = elements.start(name, attributes) if kind == "open" else elements.end(name)
            yield kind, name, "", never, elements.around()[2]


_COUNTS = pa.schema([("key", pa.string()), ("inside", pa.int64()), ("outside", pa.int64())])


def marked_by(page: str) -> str | None:
    """The element by which a page marks its content: the one ``article``, or else
    the one ``main``."""
    marks = [m.lower() for m in re.findall(r"<(article|main)\b", page, re.I)]
    return next((x for x in ("article", "main") if marks.count(x) == 1), None)


def label_counts(page: str) -> tuple[Counter, Counter] | None:
    """Words (by enclosing element, by its tag and by names around them) and tags
    inside and outside the element that the page marks as its content; None for a
    page without such a mark."""
    name = marked_by(page)
    if name is None:
        return None
    count, within = (Counter(), Counter()), False
    elements, own, around = Elements(), (Counter(), Counter()), set()
    for kind, key, text, never, number in units(page, elements):
        if kind == "text":
            n = 0 if never else len(text.split())
            count[within][f"word {key}"] += n
            count[within][f"tagged {key.split('.')[0]}"] += n
            own[within][number] += n
        else:
            if key == name:
                within = kind == "open"
                count[0][f"tag {key}"] += 1
                while within and number >= 0:
                    around.add(number)
                    number = elements.parent[number]
            else:
                count[within][f"tag {key}"] += 1
    for k in range(len(elements.parent) - 1, -1, -1):  # inner elements come later
        for inside in (False, True):
            if own[inside][k]:
                own[inside][elements.parent[k]] += own[inside][k]
                if inside or k not in around:
                    for mark in elements.marks[k]:
                        count[inside][f"name {mark}"] += own[inside][k]
    return count[1], count[0]


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, outside = Counter(), Counter()
    for b in batches:
        for page in texts(b.column(0)):
            found = label_counts(page)
            if found:
                inside += found[0]
                outside += found[1]
    keys = sorted(inside | outside)
    yield emit(_COUNTS, keys, [inside[k] for k in keys], [outside[k] for k in keys])


def fit(pages: DataFrame) -> dict[str, float]:
    """Weights of words by enclosing element, and of tags."""
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select("page_id", F.xxhash64("page_id").alias("h"))
    some = marked.orderBy("h", "page_id").limit(FIT_PAGES).select(F.col("page_id").alias("_id")).distinct()
    rows = (pages.join(F.broadcast(some), F.col("page_id").eqNullSafe(F.col("_id"))).select("html")
            .mapInArrow(_label_counts, "key string, inside long, outside long")
            .groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect())
    weights = {}
    for key, inside, outside in rows:
        if key.startswith("tag "):
            share = 0.0 if key[4:] in PLAIN else outside / (inside + outside + SELDOM)
            weights[key] = -TAG_COST * share - LEAST_COST
        else:
            if key.startswith("name ") and key[5:] in BOILERPLATE:
                outside += PRIOR
            weights[key] = max(-1.0, min(1.0, math.log((inside + 1) / (outside + 1))))
    return weights


def name_weights(elements: Elements, weights: dict[str, float]) -> list[float]:
    """The lowest weight of the names of and around each element; the last is that of no element."""
    out: list[float] = []
    for parent, marks in zip(elements.parent, elements.marks):
        low = out[parent] if parent >= 0 else 1.0
        for mark in marks:
            low = min(low, weights.get(f"name {mark}", -1.0 if mark in BOILERPLATE else 1.0))
        out.append(low)
    return [*out, 1.0]


def word_weight(key: str, weights: dict[str, float]) -> float:
    """What a word in an element counts, before the names around it."""
    if (own := weights.get(f"word {key}")) is not None:
        return own
    return max(UNSEEN, weights.get(f"tagged {key.split('.')[0]}", 1.0))


def region(row: list, weights: dict[str, float], low: list[float], mark: str | None) -> tuple[int, int]:
    """First and last unit of the best contiguous region; (0, -1) for none."""
    best, first, last = 0.0, 0, -1
    total, start, within = 0.0, 0, False
    for k, (kind, key, text, never, number) in enumerate(row):
        if kind == "text":
            if not never:
                word = min(word_weight(key, weights), low[number])
                if mark:
                    word = max(word, INSIDE) if within and low[number] > -1 else min(word, OUTSIDE) if not within else word
                total += len(text.split()) * word
        else:
            if key == mark:
                within = kind == "open"
            total += weights.get(f"tag {key}", -LEAST_COST)
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, first, last = total, start, k
    return first, last


def extract(page: str, weights: dict[str, float]) -> str:
    """The main text of a page."""
    elements = Elements()
    row = list(units(page, elements))
    low, mark = name_weights(elements, weights), marked_by(page)
    first, last = region(row, weights, low, mark)
    if last < 0:  # nothing speaks for any word: the names are wrong about this page
        low = [1.0] * len(low)
        first, last = region(row, {}, low, mark)
    blocks, block = [], []
    for kind, key, text, never, number in row[first:last + 1]:
        if kind == "text":
            if not never and low[number] > -1:
                block.append(html.unescape(text))
        elif key in BLOCKS:
            blocks.append(block)
            block = []
    blocks.append(block)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def main_text(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` and their ``main_text``."""
    weights = fit(pages)

    def run(column: pa.Array) -> pa.Array:
        return pa.array([extract(page, weights) for page in texts(column)], pa.string())

    return pages.withColumn("main_text", F.arrow_udf(run, "string")("html"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", F.col("main_text").alias("text"),
                                   F.length("main_text").cast("long").alias("n_chars"))
