"""Text functions as Spark Column expressions.

All of these stay in the JVM (regexp_replace, substring_index, ...) except the
entity-decode + NFC step, which Spark has no built-in for; that step is one
Arrow-batched helper that only touches strings with ``&`` or non-ASCII code
points and passes every other string through untouched.

Regex dialect: Java's ``\\s`` is ASCII-only unless ``(?U)``; Python's also
treats U+001C..U+001F as space, so the whitespace class is spelled
``[\\s\\x1c-\\x1f]`` under ``(?U)``.  ``(?d)`` makes ``.`` and ``$`` treat only
``\\n`` as a line end, as in Python.
"""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordia.config import DURATION_TOLERANCE_SEC

_FLAGS = "(?iuUd)"
_WS = r"[\s\x1c-\x1f]"

# The decoration patterns stripped before matching
# (bracketed feat./ft. clause, trailing feat./ft. clause, and bracketed
# radio edit / original mix / official video / official audio).
RE_FEAT_BRACKET = _FLAGS + _WS + r"*[(\[]" + _WS + r"*(?:feat|ft)\.?" + _WS + r"+[^)\]]+[)\]]"
RE_FEAT_TRAILING = _FLAGS + _WS + r"+(?:feat|ft)\.?" + _WS + r"+.+$"
RE_SUFFIX = (_FLAGS + _WS + r"*[(\[]" + _WS + r"*(?:radio" + _WS + r"+edit|original" + _WS
             + r"+mix|official" + _WS + r"+(?:video|audio))" + _WS + r"*[)\]]")
RE_SPACES = "(?U)" + _WS + "+"
RE_EDGE_SPACES = "(?U)^" + _WS + "+|" + _WS + "+$"
# Token = run of letters/digits of the normalised text (used for blocking).
RE_TOKEN = r"[\p{L}\p{N}]+"
# Fixed value: item link format of the source platform.
DEFAULT_ITEM_URL_BASE = "https://music.youtube.com/watch?v="


def _clean_py(values: list) -> list:
    out = []
    for v in values:
        if v is None:
            out.append(None)
        else:
            out.append(unicodedata.normalize("NFC", html.unescape(v)))
    return out


@F.arrow_udf(T.StringType())
def clean_text_udf(s: pa.Array) -> pa.Array:
    """HTML-entity decode then NFC; ASCII strings without '&' pass through."""
    need = pc.fill_null(pc.or_(pc.invert(pc.string_is_ascii(s)), pc.match_substring(s, "&")), False)
    if not pc.any(need).as_py():
        return s
    fixed = pa.array(_clean_py(pc.filter(s, need).to_pylist()), type=pa.string())
    # vectorised scatter: only the strings that needed it went through Python
    return pc.replace_with_mask(s, need, fixed)


def blank(c: Column | str) -> Column:
    """NULL-safe text: NULL -> ''."""
    return F.coalesce(_c(c), F.lit(""))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Unicode whitespace trim (Python ``str.strip()``)."""
    return F.regexp_replace(_c(c), RE_EDGE_SPACES, "")


def normalize_text(c: Column | str, clean: bool = True) -> Column:
    """Matching form of a title/artist: decode entities, NFC, drop feat./ft.
    clauses and radio-edit/official-video style suffixes, collapse whitespace,
    trim, lowercase.  NULL/'' -> ''."""
    x = blank(c)
    if clean:
        x = clean_text_udf(x)
    x = F.regexp_replace(x, RE_FEAT_BRACKET, "")
    x = F.regexp_replace(x, RE_FEAT_TRAILING, "")
    x = F.regexp_replace(x, RE_SUFFIX, "")
    x = F.regexp_replace(x, RE_SPACES, " ")
    return F.lower(F.trim(x))


def first_artist(c: Column | str) -> Column:
    """Text before the first comma, whitespace-trimmed."""
    return strip_ws(F.substring_index(blank(c), ",", 1))


def query_string(norm_title: Column | str, norm_artist: Column | str) -> Column:
    """``track:<t> artist:<a>``, omitting blank parts; '' when both blank."""
    t, a = blank(norm_title), blank(norm_artist)
    return F.concat_ws(
        " ",
        F.when(t != "", F.concat(F.lit("track:"), t)),
        F.when(a != "", F.concat(F.lit("artist:"), a)),
    )


def tokens(c: Column | str) -> Column:
    """Distinct letter/digit runs of an already-normalised string."""
    return F.array_distinct(F.regexp_extract_all(blank(c), F.lit(RE_TOKEN), 0))


def duration_close(sec: Column | str, ms: Column | str,
                   tolerance: float = DURATION_TOLERANCE_SEC) -> Column:
    """|sec - ms/1000| <= tolerance; unknown (<= 0) on either side counts as close."""
    s = F.coalesce(_c(sec).cast("double"), F.lit(0.0))
    m = F.coalesce(_c(ms).cast("double"), F.lit(0.0))
    return (s <= 0) | (m <= 0) | (F.abs(s - m / F.lit(1000.0)) <= F.lit(float(tolerance)))


_INT_PART = r"^\s*[+-]?[0-9]+\s*$"


def _int_part(p: Column) -> Column:
    return F.when(p.rlike(_INT_PART), F.trim(p).cast("long"))


def parse_duration(seconds_field: Column | str, text_field: Column | str) -> Column:
    """Seconds from a numeric field (wins when set) or ``m:s`` / ``h:m:s`` text.

    A set numeric field that does not parse gives 0 (no fallback to the
    text); text with another shape or a bad part gives 0.
    """
    num = F.trim(_c(seconds_field))
    num_set = num.isNotNull() & (num != "") & ~num.rlike(r"^[+-]?0*(\.0*)?$")
    txt = blank(text_field)
    parts = F.split(txt, ":")
    n = F.size(parts)
    p0, p1, p2 = (_int_part(F.get(parts, i)) for i in range(3))
    from_text = (
        F.when(n == 2, p0 * 60 + p1)
        .when(n == 3, p0 * 3600 + p1 * 60 + p2)
    )
    return (
        F.when(num_set, F.coalesce(num.try_cast("double"), F.lit(0.0)))
        .when(txt != "", F.coalesce(from_text.cast("double"), F.lit(0.0)))
        .otherwise(F.lit(0.0))
    )


def item_url(item_id: Column | str, base: str = DEFAULT_ITEM_URL_BASE) -> Column:
    i = blank(item_id)
    return F.when(i != "", F.concat(F.lit(base), i)).otherwise(F.lit(""))


def uri_id(uri: Column | str) -> Column:
    """Catalogue id = text after the last ':' of a uri."""
    return F.substring_index(blank(uri), ":", -1)


def is_missing(c: Column | str, sentinel) -> Column:
    """Falsy test: NULL or equal to the column's sentinel."""
    x = _c(c)
    return x.isNull() | (x == F.lit(sentinel))


def parse_bool(c: Column | str) -> Column:
    return F.lower(blank(c)) == "true"


def first_nonblank(*cols: Column | str) -> Column:
    return F.coalesce(*[F.nullif(_c(x), F.lit("")) for x in cols], F.lit(""))


def join_list(arr: Column | str) -> Column:
    return F.coalesce(F.array_join(_c(arr), ", "), F.lit(""))


def tag_names(tags: Column | str) -> Column:
    """Names of an array<struct<name>>; nameless entries dropped."""
    names = F.transform(F.coalesce(_c(tags), F.array()), lambda t: t["name"])
    return F.filter(names, lambda n: n.isNotNull() & (n != ""))
