"""Scoring classes and the bounded arg-max of the fuzzy passes.

Catalogue rows of one (name, artist) differ, for any probe, only by whether their
duration is close and by their rank.  So the catalogue is reduced to *classes*
(one per name and artist) and *variants* (the best-ranked row of a class and
duration), and a probe needs at most two rows of a class: its best-ranked one and its
best-ranked one of a close duration, which a band join finds once per class and
asked duration.  What is scored are (probe, class) pairs; a catalogue that grows
by more rows of the same names adds none.

Classes of a probe are visited by falling upper bound of their score.  The bound
comes from the lengths and the character counts of both strings, so it is never
below the score; a probe is done as soon as its next bound is below its best
score.  Every round scores the next ``VISITED`` classes of the probes that are left,
the last round all that remain, so no class is left out that could have won.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.config import MatchConfig
from concordia.functions.similarity import pair_similarity
from concordia.functions.text import duration_close
from concordia.operators.candidates import containing, postings
from concordia.operators.ranges import band, bands_around
from concordia.session import cut_lineage, spread

VISITED = (8, 64, None)     # classes of a probe, by falling bound, that are scored by the end of a round
BINS = 16                   # bins of the character counts
_DIGITS = "0123456789abcdef"  # one per bin
_ASCII = "".join(map(chr, range(1, 128)))
_SLACK = 1e-9               # keeps bounds safe against rounding
_NO_DURATION = -1           # band of rows without duration: close to everything
_LAST = (1 << 63) - 1


@dataclass
class CatalogClasses:
    """``classes``: class_id, c_name, c_artist, their character counts, and
    ``best``, the best-ranked row; ``variants``: class_id, band, row, place."""
    classes: DataFrame
    variants: DataFrame
    postings: DataFrame
    freq: DataFrame
    has_pairs: bool

    PARTS = ("classes", "variants", "postings", "freq")

    def built(self):
        return self.postings, self.freq, self.has_pairs


def place() -> Column:
    """What rows are ranked by, smallest first: popularity falling (unknown
    last), then uri."""
    return F.struct(F.coalesce(-F.col("popularity").cast("long"), F.lit(_LAST)).alias("unpopular"), F.col("uri"))


def char_counts(s: Column) -> Column:
    """How many characters of a string fall in each bin: every character becomes the
    digit of its bin, and a bin's digits are counted by what their removal takes away."""
    digit = F.transform(F.split(s, ""), lambda c: F.substr(F.lit(_DIGITS), F.pmod(F.ascii(c), F.lit(BINS)) + 1, F.lit(1)))
    bins = (F.when(F.length(s) == 0, F.lit(""))
            .when(s.rlike(r"\A[\x01-\x7f]*\z"), F.translate(s, _ASCII, (_DIGITS * 8)[1:])).otherwise(F.array_join(digit, "")))
    return F.transform(F.array(bins), lambda d: F.array(
        *(F.length(d) - F.length(F.replace(d, F.lit(k))) for k in _DIGITS)))[0]


def similarity_bound(la: Column, lb: Column, a: Column, b: Column, metric: str) -> Column:
    """At least the similarity of two strings of these lengths and character
    counts: what they can match is no more than the characters that both have."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x).cast("double")
    whole = (la + lb) / 2.0 if metric == "ratio" else F.greatest(la, lb).cast("double")
    return F.when((la == 0) | (lb == 0), F.lit(0.0)).otherwise(F.least(both / whole, F.lit(1.0)))


def build_classes(index: DataFrame, fields: list[str], cfg: MatchConfig) -> CatalogClasses:
    """Classes, variants and postings of a normalised catalogue, as written tables."""
    per = index.groupBy("c_name", "c_artist", "duration_ms").agg(
        F.min_by(F.struct(*fields), place()).alias("row"), F.min(place()).alias("place"),
        F.any_value("k_all").alias("k_all"))
    per = cut_lineage(per, "catalog-variants")
    classes = cut_lineage(per.groupBy("c_name", "c_artist").agg(
        F.min_by(F.struct("row", "place"), "place").alias("best"), F.any_value("k_all").alias("k_all"))
        .select(F.monotonically_increasing_id().alias("class_id"), "*", char_counts(F.col("c_name")).alias("name_chars"),
                char_counts(F.col("c_artist")).alias("artist_chars")), "catalog-classes")
    ms = F.coalesce(F.col("duration_ms").cast("double"), F.lit(0.0))
    near = F.when(ms <= 0, F.lit(_NO_DURATION)).otherwise(band(ms / F.lit(1000.0), cfg.duration_tolerance_sec))
    variants = cut_lineage(per.join(classes.select("class_id", "c_name", "c_artist"), ["c_name", "c_artist"])
                           .select("class_id", near.cast("long").alias("band"), "row", "place"), "class-variants")
    post, freq, pairs = postings(classes, "k_all", ["class_id"], cfg, id_col="class_id")
    return CatalogClasses(classes, variants, post, freq, pairs)


def _close_rows(wanted: DataFrame, cc: CatalogClasses, cfg: MatchConfig) -> DataFrame:
    """(class_id, s_duration, close): the best-ranked row of a class whose
    duration is close to an asked one, once per class and duration."""
    asked = (wanted.where("s_duration > 0").select("class_id", "s_duration").distinct()
             .withColumn("band", F.explode(F.concat(bands_around(F.col("s_duration"), cfg.duration_tolerance_sec),
                                                    F.array(F.lit(_NO_DURATION).cast("long"))))))
    return (asked.join(cc.variants, ["class_id", "band"])
            .where(duration_close("s_duration", F.col("row.duration_ms"), cfg.duration_tolerance_sec))
            .groupBy("class_id", "s_duration").agg(F.min_by(F.struct("row", "place"), "place").alias("close")))


def _scored(pairs: DataFrame, probes: DataFrame, cc: CatalogClasses, cfg: MatchConfig, bonus: float) -> DataFrame:
    """The best row of these (probe_id, class_id) pairs for each probe: probe_id,
    score, place, row."""
    texts = cut_lineage(pairs.select("probe_id", "class_id")
                        .join(probes.select("probe_id", "s_title", "s_artist", "s_duration"), "probe_id")
                        .join(cc.classes.select("class_id", "c_name", "c_artist"), "class_id"), "probe-candidates")
    ts = pair_similarity(texts, "s_title", "c_name", "title_sim", cfg.metric)
    as_ = pair_similarity(texts, "s_artist", "c_artist", "artist_sim", cfg.metric)
    rows = (texts.join(ts, ["s_title", "c_name"]).join(as_, ["s_artist", "c_artist"])
            .select("probe_id", "class_id", "s_duration", "title_sim", "artist_sim")
            .join(cc.classes.select("class_id", "best"), "class_id")
            .join(_close_rows(texts, cc, cfg), ["class_id", "s_duration"], "left"))
    two = F.array_compact(F.array("best", "close"))
    rows = rows.select("probe_id", "s_duration", "title_sim", "artist_sim", F.explode(two).alias("c"))
    close = duration_close("s_duration", F.col("c.row.duration_ms"), cfg.duration_tolerance_sec)
    dur = F.when(close, F.lit(1.0)).otherwise(F.lit(cfg.duration_miss_factor))
    score = (F.col("title_sim") * F.lit(cfg.w_title) + F.col("artist_sim") * F.lit(cfg.w_artist)
             + dur * F.lit(cfg.w_duration))
    if bonus:
        score = F.least(score + F.when(close, F.lit(bonus)).otherwise(F.lit(0.0)), F.lit(1.0))
    return _first(rows.select("probe_id", score.alias("score"), F.col("c.place").alias("place"), F.col("c.row").alias("row")))


def _first(rows: DataFrame) -> DataFrame:
    """Per probe the row of highest score, the better-ranked one on ties."""
    order = F.struct(-F.col("score"), F.col("place"))
    best = rows.groupBy("probe_id").agg(F.min_by(F.struct("score", "place", "row"), order).alias("b"))
    return best.select("probe_id", "b.*")


def bounded_best(prepared: DataFrame, qcols: list[str], q_keys: Column, cc: CatalogClasses, cfg: MatchConfig,
                 threshold: float, bonus: float, probe_cols: list[str], work: dict | None = None) -> DataFrame:
    """(probe_cols, score, row) of every probe with a candidate that can reach
    ``threshold``.  ``work`` is told how many pairs there were and how many were
    scored."""
    queries = cut_lineage(prepared.select(*qcols).distinct().withColumn("q_keys", q_keys)
                          .withColumn("query_id", F.monotonically_increasing_id()), "queries")
    probes = cut_lineage(
        prepared.select(*probe_cols).distinct().join(queries.select(*qcols, "query_id"), qcols)
        .select(F.monotonically_increasing_id().alias("probe_id"), "query_id", *probe_cols,
                char_counts(F.col("s_title")).alias("title_chars"), char_counts(F.col("s_artist")).alias("s_artist_chars")),
        "probes")
    hits = containing(queries, "query_id", "q_keys", "class_id", cfg, cc.built())
    bound = F.lit(cfg.w_duration + bonus)
    if cfg.prune_by_length_bound:
        bound = (similarity_bound(F.length("s_title"), F.length("c_name"), F.col("title_chars"), F.col("name_chars"), cfg.metric)
                 * F.lit(cfg.w_title)
                 + similarity_bound(F.length("s_artist"), F.length("c_artist"), F.col("s_artist_chars"), F.col("artist_chars"), cfg.metric)
                 * F.lit(cfg.w_artist) + bound)
    else:
        bound = bound + F.lit(cfg.w_title + cfg.w_artist)
    # pairs are small in bytes but not in work: dealt evenly before each is looked at
    asked = spread(hits.join(probes.select("query_id", "probe_id"), "query_id").drop("query_id"))
    pairs = cut_lineage(
        asked.join(probes, "probe_id")
        .join(cc.classes.select("class_id", "c_name", "c_artist", "name_chars", "artist_chars"), "class_id")
        .select("probe_id", "class_id", bound.alias("bound")).where(F.col("bound") >= F.lit(threshold - _SLACK)), "probe-classes")
    total = pairs.count()
    at_once = total <= cfg.pairs_at_once
    if work is not None:
        work.update(pairs=total, scored=0)

    best, seen = None, None
    by_bound = Window.partitionBy("probe_id").orderBy(F.col("bound").desc(), "class_id")
    for visited in ((None,) if at_once else VISITED):
        rows = pairs
        if best is not None:  # a class that only equals the best may still win by rank
            rows = (rows.join(best.select("probe_id", "score"), "probe_id", "left")
                    .where(F.col("score").isNull() | (F.col("bound") >= F.col("score") - F.lit(_SLACK))).drop("score")
                    .join(seen, ["probe_id", "class_id"], "left_anti"))
        if visited:
            rows = rows.withColumn("_r", F.row_number().over(by_bound)).where(F.col("_r") <= visited).drop("_r")
        rows = cut_lineage(rows.select("probe_id", "class_id"), "visited")
        n = rows.count()
        if not n:
            break
        if work is not None:
            work["scored"] += n
        scored = _scored(rows, probes, cc, cfg, bonus)
        best = cut_lineage(scored if best is None else _first(best.unionByName(scored)), "best")
        seen = rows if seen is None else seen.unionByName(rows)
    if best is None:
        best = _scored(pairs.select("probe_id", "class_id"), probes, cc, cfg, bonus)  # no pair, no row
    return probes.select("probe_id", *probe_cols).join(best, "probe_id").select(*probe_cols, "score", "row")
