"""Candidate generation: conjunctive token search over a catalogue table.

A query is a set of field-scoped keys (``t:<token>`` for title tokens,
``a:<token>`` for artist tokens).  A catalogue row is a candidate when it holds
every key of the query; candidates are ranked by (popularity desc, uri asc)
and the first ``k`` are kept.

Plan, per distinct query (duplicates of a query never multiply the work):

1. Postings: one row per (key, catalogue row).  Key frequencies come from a
   partial-aggregated ``groupBy(key).count()``.
2. Block key = the query's rarest key.  When even the rarest key is hot
   (posting list > ``hot_block_rows``) the block becomes the query's two
   rarest keys as a pair; pair postings exist only for hot x hot keys of a
   row, and the set of hot keys is bounded by postings / hot_block_rows.
3. A query whose keys are exactly its block needs no residual test: its
   candidates are the block's top-k (window top-k, map-side partial limit).
4. Every other query joins the block's postings on (block, salt): big blocks
   are spread over ``ceil(n / rows_per_task)`` salt buckets, the query side is
   replicated once per bucket, so no task holds a whole hot block.  The
   residual test (all query keys present) runs on the join output and a
   per-query top-k (partial WindowGroupLimit before the shuffle) keeps at most
   k rows per query per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordia.config import MatchConfig
from concordia.session import cut_lineage

PAIR_SEP = "|"
_SLIM = ["catalog_id", "uri", "popularity"]  # identity and rank of a catalogue row


def field_keys(prefix: str, toks) -> F.Column:
    return F.transform(toks, lambda t: F.concat(F.lit(prefix), t))


def _rank_order():
    return [F.col("popularity").desc(), F.col("uri").asc()]


def _pairs(arr: F.Column) -> F.Column:
    """All (a|b) with a < b of a sorted array (bounded by the row's own keys)."""
    n = F.size(arr)
    return F.flatten(F.transform(
        F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))),
        lambda i: F.transform(F.slice(arr, i + 2, F.greatest(n - i - 1, F.lit(1))),
                              lambda b: F.concat(F.element_at(arr, i + 1), F.lit(PAIR_SEP), b))))


def postings(index: DataFrame, keys_col: str, item_cols: list[str], cfg: MatchConfig, id_col: str = "catalog_id"
             ) -> tuple[DataFrame, DataFrame, bool]:
    """(postings, block frequencies, has_pairs).  The frequencies carry the
    limit above which keys were paired (``hot_limit``).

    Postings are (block, item cols..., c_keys) for single keys and, when some
    key is hot, for hot key pairs.  The frequency table is written to the
    shared folder: it is read by both the query side and the salting step.
    """
    base = index.select(*item_cols, F.col(keys_col).alias("c_keys"))
    single = base.select(F.explode("c_keys").alias("block"), *item_cols, "c_keys")
    limit = F.lit(cfg.hot_block_rows).cast("long").alias("hot_limit")
    freq = cut_lineage(single.groupBy("block").agg(F.count(F.lit(1)).alias("n")).select("*", limit), "key-freq")
    # Bounded: at most (#postings / hot_block_rows) keys can exceed the limit.
    hot = freq.where(F.col("n") > cfg.hot_block_rows).select(F.col("block").alias("hot_key"))
    if not hot.take(1):
        return single, freq, False
    hot_rows = single.join(hot, single.block == hot.hot_key, "left_semi")
    # collect_set per catalogue row is bounded by that row's own key count.
    per_item = (hot_rows.groupBy(id_col)
                .agg(F.any_value(F.struct(*item_cols, "c_keys")).alias("it"),
                     F.array_sort(F.collect_set("block")).alias("hk"))
                .where(F.size("hk") >= 2))
    pair = per_item.select(F.explode(_pairs(F.col("hk"))).alias("block"), "it.*")
    pair = pair.select("block", *item_cols, "c_keys")
    pair_freq = pair.groupBy("block").agg(F.count(F.lit(1)).alias("n")).select("*", limit)
    post = cut_lineage(single.unionByName(pair), "postings")
    return post, cut_lineage(freq.unionByName(pair_freq), "block-freq"), True


def _query_blocks(queries: DataFrame, qkey_cols: list[str], freq: DataFrame, has_pairs: bool) -> DataFrame:
    """(qkey_cols, q_keys, block, exact): the block whose postings each query
    has to look at, and whether holding the block is all that the query asks."""
    q = queries.where(F.size("q_keys") > 0)

    # Rarest keys of each query (a key absent from the catalogue => no candidate).
    qk = q.select(*qkey_cols, "q_keys", F.explode("q_keys").alias("block"))
    qk = qk.join(freq, "block", "left").select(
        *qkey_cols, "q_keys", "block", F.coalesce("n", F.lit(0)).alias("n"))
    # collect_list is bounded by the number of keys of one query.
    ranked = (qk.groupBy(*qkey_cols)
                .agg(F.array_sort(F.collect_list(F.struct("n", "block"))).alias("ks"),
                     F.min("n").alias("min_n"), F.any_value("q_keys").alias("q_keys")))
    ranked = ranked.where(F.col("min_n") > 0)
    k1, k2 = F.element_at("ks", 1), F.get("ks", F.lit(1))
    # What the postings hold decides, not this call's knobs: they may have been
    # built with others.  Pairs exist for the keys above the builder's limit.
    use_pair = F.lit(False)
    if has_pairs:
        limit = freq.agg(F.max("hot_limit")).scalar()
        use_pair = (k1["n"] > limit) & (F.size("ks") >= 2)
    block = F.when(use_pair, F.concat_ws(PAIR_SEP, F.array_sort(F.array(k1["block"], k2["block"]))))\
             .otherwise(k1["block"])
    return ranked.select(*qkey_cols, "q_keys", block.alias("block"),
                         (F.size("ks") == F.when(use_pair, F.lit(2)).otherwise(F.lit(1))).alias("exact"))


def containing(queries: DataFrame, query_id: str, q_keys_col: str, item_id: str, cfg: MatchConfig,
               built: tuple[DataFrame, DataFrame, bool]) -> DataFrame:
    """(query_id, item_id) of all items that hold every key of a query, unranked.

    Blocks are spread both ways: postings over ``ceil(n / rows_per_task)`` salts and
    queries over as many of their own, each side repeated for the salts of the other,
    so neither a frequent key nor a key that most queries ask for stays in one task.
    """
    post, freq, has_pairs = built
    qb = cut_lineage(_query_blocks(queries.select(query_id, F.col(q_keys_col).alias("q_keys")), [query_id], freq, has_pairs),
                     "query-blocks")
    asked = qb.groupBy("block").agg(F.count(F.lit(1)).alias("m"))

    def parts(n: str) -> F.Column:
        return F.ceil(F.col(n) / F.lit(cfg.rows_per_task)).cast("int")
    # one row per split block: at most (postings + queries) / rows_per_task of them
    split = (freq.join(asked, "block").select("block", parts("n").alias("np"), parts("m").alias("nq"))
             .where((F.col("np") > 1) | (F.col("nq") > 1)))
    split = cut_lineage(split, "split-blocks")

    def salted(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        own_n, other_n = F.coalesce(f"n{own}", F.lit(1)), F.coalesce(f"n{other}", F.lit(1))
        return (df.join(split, "block", "left")
                .withColumn(own, F.pmod(F.xxhash64(key), own_n.cast("long")).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), other_n - 1))).drop("np", "nq"))
    q = salted(qb, query_id, "q", "p")
    p = salted(post.select("block", item_id, "c_keys").join(asked.select("block"), "block", "left_semi"), item_id, "p", "q")
    return (q.join(p, ["block", "p", "q"])
            .where(F.col("exact") | F.forall("q_keys", lambda key: F.array_contains("c_keys", key)))
            .select(query_id, item_id))


def candidates(queries: DataFrame, qkey_cols: list[str], q_keys_col: str, index: DataFrame,
               c_keys_col: str, item_cols: list[str], cfg: MatchConfig, k: int,
               built: tuple[DataFrame, DataFrame, bool] | None = None) -> DataFrame:
    """Top-k candidates per distinct query.

    ``queries``: distinct rows of ``qkey_cols`` plus the query key array.
    ``index``: catalogue rows with ``item_cols`` (must include catalog_id,
    uri, popularity) and their key array.
    Returns qkey_cols + item_cols + ``rank`` (1..k; all if k is None), written to the shared
    folder (it feeds both similarity branches and the scoring join).
    ``built``: postings already built for this index (shared by passes).
    Where all candidates are asked for, queries meet the distinct key sets of the
    catalogue first, so that rows alike in their keys are tested once.
    """
    if k is None and built is None:
        return _with_items(_all_ranked(queries, qkey_cols, q_keys_col, index, c_keys_col, cfg), qkey_cols, index, item_cols)
    post, freq, has_pairs = built or postings(index, c_keys_col, item_cols, cfg)
    # Only identity + rank columns travel through the block join; the other
    # catalogue columns are attached to the final top-k rows.
    slim = _SLIM
    post = post.select("block", *slim, "c_keys")
    qb = _query_blocks(queries.select(*qkey_cols, F.col(q_keys_col).alias("q_keys")), qkey_cols, freq, has_pairs)

    w_block = Window.partitionBy("block").orderBy(*_rank_order())
    w_query = Window.partitionBy(*qkey_cols).orderBy(*_rank_order())

    # (3) exact blocks: block top-k, no residual.
    qe = qb.where("exact")
    top_block = (post.join(qe.select("block").distinct(), "block", "left_semi")
                     .withColumn("rank", F.row_number().over(w_block)))
    top_block = top_block.where(F.col("rank") <= k) if k else top_block
    exact = qe.select(*qkey_cols, "block").join(top_block, "block").select(*qkey_cols, *slim, "rank")

    # (4) general blocks: salted join + residual + per-query top-k.
    qg = qb.where(~F.col("exact"))
    # Bounded: at most (#postings / rows_per_task) blocks are split.
    split = (freq.where(F.col("n") > cfg.rows_per_task)
                 .select("block", F.ceil(F.col("n") / F.lit(cfg.rows_per_task)).cast("int").alias("nb")))
    qg = (qg.join(split, "block", "left")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("nb", F.lit(1)) - 1)))
            .drop("nb"))
    pg = (post.join(qg.select("block").distinct(), "block", "left_semi")
              .join(split, "block", "left")
              .withColumn("salt", F.pmod(F.xxhash64("catalog_id"), F.coalesce("nb", F.lit(1)).cast("long")).cast("int"))
              .drop("nb"))
    hits = (qg.join(pg, ["block", "salt"])
              .where(F.forall("q_keys", lambda key: F.array_contains("c_keys", key)))
              .withColumn("rank", F.row_number().over(w_query)))
    hits = hits.where(F.col("rank") <= k) if k else hits
    general = hits.select(*qkey_cols, *slim, "rank")
    return _with_items(exact.unionByName(general), qkey_cols, index, item_cols)


def _with_items(top: DataFrame, qkey_cols: list[str], index: DataFrame, item_cols: list[str]) -> DataFrame:
    rest = [c for c in item_cols if c not in _SLIM]
    if rest:
        # the rows of all queries meet the catalogue once, by id
        top = top.join(index.select("catalog_id", *rest), "catalog_id")
    return cut_lineage(top.select(*qkey_cols, *item_cols, "rank"), "candidates")


def _all_ranked(queries: DataFrame, qkey_cols: list[str], q_keys_col: str, index: DataFrame, c_keys_col: str,
                cfg: MatchConfig) -> DataFrame:
    """Every catalogue row of every query, with its rank: qkey_cols + identity + rank."""
    queries = cut_lineage(queries.withColumn("query_id", F.monotonically_increasing_id()), "queries")
    alike = cut_lineage(index.select(F.col(c_keys_col).alias("c_keys")).distinct()
                        .withColumn("class_id", F.monotonically_increasing_id()), "key-sets")
    rows = index.select(*_SLIM, F.col(c_keys_col).alias("c_keys")).join(alike, "c_keys").drop("c_keys")
    hits = cut_lineage(containing(queries, "query_id", q_keys_col, "class_id", cfg,
                                  postings(alike, "c_keys", ["class_id"], cfg, id_col="class_id")), "query-key-sets")
    ranked = hits.join(rows, "class_id").withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*_rank_order())))
    return queries.select("query_id", *qkey_cols).join(ranked, "query_id").select(*qkey_cols, *_SLIM, "rank")
