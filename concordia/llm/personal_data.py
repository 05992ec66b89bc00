"""Personal data: fixed patterns, and contextual extraction bootstrapped from them.

Base: e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers by
regular expressions, as code point spans.  Method: base spans are the seed
entities.  The words around a seed are its lexical patterns (the two words
before it; the word before and the word after).  Patterns and the instances in
them are a graph that Spark scores in rounds: a pattern's score for a kind is
the share of that kind among the known or contrary instances it surrounds, and
an instance not yet known gets a kind from patterns of high score.  What is so
found counts as known in the next round and supports further patterns.  Finally
the mentions that stand in a pattern of high score become spans.

Candidates for new identifiers are runs of digit groups, joined by single spaces,
dots, dashes, slashes or brackets, that have the loose form of a card or phone number
(``555 123 4567``, ``(555) 123-4567``), and words with a digit or ``@``, ``MIN_CHARS``
or longer; both outside all base spans, and words outside such runs.  A candidate can only become a kind whose
loose form it has (``FORMS``); in a pattern of another kind it is evidence
against the pattern.  A pattern needs ``SUPPORT`` distinct known instances.

All of it is DataFrame functions.  The expressions are the stated ones with
possessive loops and a look at the character before, which finds the same
matches in linear time: a start inside a run of the first class can only match
where the run's own start did.  Positions come from the lengths of what
``split`` and ``regexp_extract_all`` return, summed in blocks.  Texts are read
once; what is shuffled are mentions with up to ``CONTEXT`` characters on either
side, and pairs (pattern, instance) that are distinct per task first.

Defined cases
* null text counts as empty: no spans, the hash of the empty string;
* repeated rows and null ids are rows like any other, each with its own spans;
* texts are searched whole; an empty table gives an empty table;
* a mention that patterns give to several kinds gets the one of the highest
  score, ties to the first in the order e-mail, IP, card, phone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concordia.llm.columns import table
from concordia.session import Scratch

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 5         # distinct known instances that a pattern needs
PRECISION = 0.8     # least score of a pattern
MIN_CHARS = 6       # of a candidate
CONTEXT = 64        # characters on either side that patterns are taken from
BLOCK = 256

_WS = r"\x20\x09-\x0D"
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: kind -> (expression, what a text must hold for a match)
PATTERNS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
CANDIDATE = rf"(?<![^{_WS}])[^{_WS}0-9@]*+[0-9@][^{_WS}]*+"
GROUPED = (rf"(?<![^{_WS}])[+(]{{0,2}}[0-9]++(?:(?:\)?[\x20./-]\(?|[()])[0-9]++)++(?=[.,;:!?)]{{0,2}}(?:[{_WS}]|$))")
#: the loose form of a kind
FORMS = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^(?:[0-9]+[.:_-]){3}[0-9]+[.,;]?$|^[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,7}[.,;]?$",
    "card": r"^[0-9](?:[-._/\x20]?[0-9]){11,18}[.,;]?$",
    "phone": r"^[+(]?[0-9](?:[-()./\x20]{0,3}[0-9]){6,14}[.,;]?$",
}


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(n.between(13, 19), F.call_function("luhn_check", digits)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def with_spans(df: DataFrame, name: str, pattern: str, needs: str) -> DataFrame:
    """Adds ``name``: the matches of ``pattern`` in ``_t`` in their order, as
    array<struct<start, end, s, left, right>> (code points, end exclusive)."""
    p, gap, found, lens, sums = _sql(pattern), f"_{name}_gap", f"_{name}_found", f"_{name}_lens", f"_{name}_sums"
    hit = f"_t rlike {_sql(needs)}"
    df = (df.withColumn(found, F.expr(f"if({hit}, regexp_extract_all(_t, {p}, 0), cast(array() as array<string>))"))
          .withColumn(gap, F.expr(f"if(size({found}) > 0, split(_t, {p}, -1), cast(array() as array<string>))"))
          .withColumn(lens, F.expr(f"transform({found}, (m, i) -> cast(length(m) + length({gap}[i]) as bigint))"))
          .withColumn(sums, F.expr(f"transform(sequence(0, size({lens}) div {BLOCK}), b -> aggregate("
                                   f"slice({lens}, cast(b * {BLOCK} + 1 as int), {BLOCK}), 0L, (a, x) -> a + x))"))
          .withColumn(sums, F.expr(f"transform({sums}, (s, b) -> aggregate(slice({sums}, 1, b), 0L, (a, x) -> a + x))")))
    start = (f"({sums}[cast(i div {BLOCK} as int)] + aggregate(slice({lens}, cast(i div {BLOCK} * {BLOCK} + 1 as int), "
             f"cast(i % {BLOCK} as int)), 0L, (a, x) -> a + x) + length({gap}[i]))")
    before = f"concat(if(i > 0, {found}[greatest(i - 1, 0)], ''), {gap}[i])"
    after = f"concat({gap}[i + 1], if(i + 1 < size({found}), {found}[least(i + 1, size({found}) - 1)], ''))"
    return df.withColumn(name, F.expr(
        f"transform({found}, (m, i) -> named_struct('start', {start}, 'end', {start} + length(m), 's', m, "
        f"'left', right({before}, {CONTEXT}), 'right', left({after}, {CONTEXT})))")).drop(gap, found, lens, sums)


def base_spans(docs: DataFrame) -> DataFrame:
    """uid, doc_id, base: array<struct<k, start, end>> in order, and mentions:
    array<struct<k, start, end, s, left, right>>, k null for candidates.  To be
    written, as ``uid`` numbers its rows."""
    df = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("_t"))
    for kind, (pattern, needs) in PATTERNS.items():
        df = with_spans(df, kind, pattern, needs)
    df = with_spans(df, "grouped", GROUPED, r"[0-9][\x20().\/-]{1,3}[0-9]")
    df = with_spans(df, "other", CANDIDATE, "[0-9@]").drop("_t")

    def of(name: str, valid) -> Column:
        k = KINDS.index(name) if name in KINDS else None
        return F.transform(F.filter(F.col(name), lambda x: valid(x["s"])), lambda x: F.struct(
            F.lit(k).cast("int").alias("k"), F.lit(name == "grouped").alias("grouped"), x["start"].alias("start"),
            x["end"].alias("end"), x["s"].alias("s"), x["left"].alias("left"), x["right"].alias("right")))

    seeds = [of(kind, lambda s, kind=kind: _valid(kind, s)) for kind in KINDS]
    others = [of("grouped", lambda s: s.rlike(FORMS["phone"]) | s.rlike(FORMS["card"])),
              of("other", lambda s: F.length(s) >= MIN_CHARS)]
    df = df.select("doc_id", F.concat(*seeds).alias("seeds"), F.concat(*others).alias("others"))
    return df.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id",
        F.transform("seeds", lambda x: F.struct(x["k"].alias("k"), x["start"].alias("start"), x["end"].alias("end"))).alias("base"),
        F.concat("seeds", "others").alias("mentions"))


def mentions(found: DataFrame) -> DataFrame:
    """(uid, start, end, k, forms, instance, patterns): seeds, and candidates
    that overlap none (told from the spans before and after them in their text)."""
    m = found.select("uid", F.explode("mentions").alias("x")).select("uid", "x.*")
    text = Window.partitionBy("uid").orderBy("start", "end")
    seed = F.col("k").isNotNull()

    def apart(from_: Column) -> Column:
        before = F.max(F.when(from_, F.col("end"))).over(text.rowsBetween(Window.unboundedPreceding, -1))
        after = F.min(F.when(from_, F.col("start"))).over(text.rowsBetween(1, Window.unboundedFollowing))
        return F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(after >= F.col("end"), F.lit(True))
    free = seed | (F.col("grouped") & apart(seed)) | (~F.col("grouped") & apart(seed | F.col("grouped")))
    left = F.filter(F.split(F.lower("left"), f"[{_WS}]+"), lambda w: w != "")
    right = F.filter(F.split(F.lower("right"), f"[{_WS}]+"), lambda w: w != "")
    two = F.when(F.size("l") >= 2, F.concat(F.lit("2:"), F.array_join(F.slice("l", -2, 2), " ")))
    both = F.when((F.size("l") >= 1) & (F.size("r") >= 1),
                  F.concat(F.lit("1:"), F.element_at("l", -1), F.lit(" _ "), F.get("r", F.lit(0))))
    s = F.col("s")
    return (m.withColumn("free", free).where("free")
            .withColumn("l", left).withColumn("r", right)
            .select("uid", "start", "end", "k", F.xxhash64(F.lower("s")).alias("instance"),
                    F.array(*(s.rlike(FORMS[x]) for x in KINDS)).alias("forms"),
                    F.array_compact(F.array(two, both)).alias("patterns")))


def scored_patterns(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(pattern, kind, score): the patterns of high score, given what instances
    are known as (instance, known)."""
    e = edges.join(known, "instance", "left").withColumn("is", F.coalesce("k", "known"))
    counts = [F.sum((F.col("is") == k).cast("long")).alias(f"n{k}") for k in range(len(KINDS))]
    against = [F.sum((F.col("is").isNull() & ~F.col("forms")[k]).cast("long")).alias(f"c{k}") for k in range(len(KINDS))]
    per = e.groupBy("pattern").agg(*counts, *against)
    n = [F.coalesce(F.col(f"n{k}"), F.lit(0)) for k in range(len(KINDS))]
    total = sum(n[1:], n[0])
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), n[k].alias("n"),
                              (n[k] / (total + F.col(f"c{k}") + 1)).alias("score")) for k in range(len(KINDS))))
    return (per.select("pattern", F.explode(rows).alias("x")).select("pattern", "x.*")
            .where((F.col("n") >= SUPPORT) & (F.col("score") >= PRECISION)).drop("n"))


def discovered(all_: DataFrame, scratch: Scratch) -> DataFrame:
    """(uid, k, start, end) of the spans that patterns add."""
    edges = scratch.cut(all_.select(F.explode("patterns").alias("pattern"), "instance", "k", "forms").distinct(), "edges")
    unknown = edges.where("k is null").select("pattern", "instance", "forms")
    known = scratch.cut(unknown.where("false").select("instance", F.lit(0).alias("known")), "known")
    for _ in range(ROUNDS):
        patterns = scratch.cut(scored_patterns(edges, known), "patterns")
        known = scratch.cut(unknown.join(patterns, "pattern").where(F.col("forms")[F.col("kind")])
                            .groupBy("instance").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("known")), "known")
    return (all_.where("k is null").select("uid", "start", "end", "forms", F.explode("patterns").alias("pattern"))
            .join(patterns, "pattern").where(F.col("forms")[F.col("kind")])
            .groupBy("uid", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("k"))
            .select("uid", "k", "start", "end"))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(kinds, x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, base and spans (arrays of k, start, end) of every row."""
    found = scratch.cut(base_spans(docs), "found")
    all_ = scratch.cut(mentions(found.select("uid", "mentions")), "mentions")
    more = discovered(all_, scratch).groupBy("uid").agg(F.collect_list(F.struct("k", "start", "end")).alias("more"))
    return (found.select("uid", "doc_id", "base").join(more, "uid", "left")
            .select("doc_id", "base", F.coalesce(F.array_sort(F.concat("base", "more")), "base").alias("spans")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and positions of the personal data of every document."""
    with Scratch(spark, "personal-data") as scratch:
        found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch)
        counts = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) as bigint)").alias(f"n_{kind}")
                  for k, kind in enumerate(KINDS)]
        return scratch.keep(found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                                         _joined(F.col("spans")).alias("spans")))
