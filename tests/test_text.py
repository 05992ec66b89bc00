"""Golden rows and a property check for the scalar text functions."""

import html
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concordia.functions import text as X
from concordia.functions.similarity import ratio

NORMALIZE_GOLDEN = [
    ("Rock &amp; Roll", "rock & roll"),
    ("Song (feat. Guest)", "song"), ("Song(ft. X)", "song"), ("Song [ft Guest)", "song"),
    ("Song FT. Guest", "song"), ("Song feat. A (Live)", "song"),
    ("Song (featuring Guest)", "song (featuring guest)"),
    ("Feat. Alone", "feat. alone"), ("Left Foot", "left foot"), ("soft. x", "soft. x"),
    ("Song ft Guest\nB", "song ft guest b"), ("Song (Remix)", "song (remix)"),
    ("Song  (Radio  Edit)", "song"), ("Song [Official Video] - Live", "song - live"),
    ("Song (Official Music Video)", "song (official music video)"),
    ("(Radio Edit)", ""), ("  ", ""), ("", ""), (None, ""),
    ("A\u00a0\u00a0B", "a b"), ("X\u001cY", "x y"), ("x\u3000y\u2028z\u0085", "x y z"), ("&#39;Til", "'til"),
]


def spec_normalize(t):
    """Executable statement of the normalisation rules (test oracle)."""
    if not t:
        return ""
    t = unicodedata.normalize("NFC", html.unescape(t))
    t = re.sub(r"\s*[\(\[]\s*(?:feat|ft)\.?\s+[^\)\]]+[\)\]]", "", t, flags=re.IGNORECASE)
    t = re.sub(r"\s+(?:feat|ft)\.?\s+.+$", "", t, flags=re.IGNORECASE)
    t = re.sub(r"\s*[\(\[]\s*(?:radio\s+edit|original\s+mix|official\s+(?:video|audio))\s*[\)\]]", "", t,
               flags=re.IGNORECASE)
    return re.sub(r"\s+", " ", t).strip().lower()


def _run(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_normalize_golden(spark):
    got = _run(spark, [v for v, _ in NORMALIZE_GOLDEN], X.normalize_text("v"))
    assert got == [e for _, e in NORMALIZE_GOLDEN]


_alphabet = st.sampled_from(list("abcXYZ ()[].,&;#") + ["feat", "ft", "FT.", "radio", "edit", "Official",
                                                       "video", "\u00a0", "\t", "\n", "\u2003", "\x1c",
                                                       "&amp;", "&amp", "&lt;", "&#39", "e\u0301", "É", "mix", "original"])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(_alphabet, max_size=12).map("".join), min_size=40, max_size=40))
def test_normalize_matches_spec(spark, values):
    assert _run(spark, values, X.normalize_text("v")) == [spec_normalize(v) for v in values]


def test_first_artist_and_query(spark):
    df = spark.createDataFrame([("Song (feat. X)", " Artist A , B"), ("", "Solo"), ("", "")], "t string, a string")
    rows = df.select(X.first_artist("a").alias("fa"),
                     X.query_string(X.normalize_text("t"), X.normalize_text(X.first_artist("a"))).alias("q")).collect()
    assert [(r.fa, r.q) for r in rows] == [("Artist A", "track:song artist:artist a"), ("Solo", "artist:solo"),
                                           ("", "")]


def test_ratio_golden(spark):
    long = "ab" * 150 + "c"
    cases = [("tide", "diet", 0.25), ("diet", "tide", 0.5), ("abc", "abc", 1.0), ("", "", 0.0), ("abc", "", 0.0),
             ("small ring", "small & ring", 0.9090909090909091), ("hello world", "hello wrld", 0.9523809523809523),
             ("guest", "brand#2", 0.0), ("", "x", 0.0), (None, "x", 0.0), (long, long[:-1], 600 / 601)]
    df = spark.createDataFrame(cases, "a string, b string, r double")
    for row in df.select("r", ratio(F.col("a"), F.col("b")).alias("got")).collect():
        assert row["got"] == row["r"]



def test_duration_close(spark):
    df = spark.createDataFrame([(0.0, 1000), (100.0, 0), (100.0, 105000), (100.0, 105001)], "s double, m int")
    assert [r[0] for r in df.select(X.duration_close("s", "m")).collect()] == [True, True, True, False]


def test_parse_duration(spark):
    rows = [(None, "3:35", 215.0), (None, "1:02:03", 3723.0), (None, "45", 0.0), (None, "a:b", 0.0),
            ("x", "3:35", 0.0), ("0", "3:35", 215.0), ("", "3:35", 215.0), ("250", "3:35", 250.0),
            (None, None, 0.0), (None, " 3: 05", 185.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, n string, t string")
    got = [r[0] for r in df.orderBy("i").select(X.parse_duration("n", "t")).collect()]
    assert got == [e for _, _, e in rows]


def test_fingerprint(spark):
    from concordia.operators.keys import fingerprint
    df = spark.createDataFrame([("YT", "AbC", "T", "A"), ("YT", "", "T", "A"), ("YT", None, "Ti", "Ar")],
                               "platform string, track_id string, title string, artist string")
    assert [r[0] for r in df.select(fingerprint()).collect()] == ["YT:AbC", "yt:t:a", "yt:ti:ar"]
