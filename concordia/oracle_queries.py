"""Oracle SQL (DuckDB) for every registered query with a SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from concordia.oracle import (close_sql, first_artist_sql, fuzzy_cands_ctes, fuzzy_pass_ctes, fuzzy_scored_ctes,
                              INDEX_CTES, isrc_pass_ctes, norm_sql, prepared_sql, ratio_cte, waterfall_ctes,
                              with_views)

ORACLE: dict[str, Callable[[], str]] = {}


def oracle(name: str):
    def deco(fn):
        ORACLE[name] = fn
        return fn
    return deco


def _dedupe(view: str) -> str:
    return (f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint "
            f"ORDER BY position DESC) AS rn FROM {view}) WHERE rn = 1")


_DIFF = [("dc", _dedupe("v_cur")), ("dp", _dedupe("v_prev")),
         ("dd", """SELECT coalesce(c.fingerprint, p.fingerprint) AS fingerprint,
   CASE WHEN c.fingerprint IS NOT NULL AND p.fingerprint IS NOT NULL THEN 'unchanged'
        WHEN c.fingerprint IS NOT NULL THEN 'added' ELSE 'removed' END AS change_type,
   CASE WHEN c.fingerprint IS NOT NULL THEN c.position ELSE p.position END AS position,
   CASE WHEN c.fingerprint IS NOT NULL THEN c.title ELSE p.title END AS title
   FROM dc c FULL OUTER JOIN dp p ON c.fingerprint = p.fingerprint""")]


@oracle("q_fingerprint")
def _():
    return with_views(["v_keyed"], "SELECT position, fingerprint FROM v_keyed")


@oracle("q_dedupe_last_wins")
def _():
    return with_views(["v_cur"], "SELECT fingerprint, position, title FROM dc", [("dc", _dedupe("v_cur"))])


@oracle("q_diff")
def _():
    return with_views(["v_cur", "v_prev"], "SELECT * FROM dd", _DIFF)


@oracle("q_diff_summary")
def _():
    body = """SELECT added, removed, unchanged, (added > 0 OR removed > 0) AS has_changes,
  concat_ws(', ', CASE WHEN added > 0 THEN '+' || CAST(added AS STRING) || ' added' END,
    CASE WHEN removed > 0 THEN '-' || CAST(removed AS STRING) || ' removed' END,
    CAST(unchanged AS STRING) || ' unchanged') AS summary
  FROM (SELECT count(*) FILTER (WHERE change_type = 'added') AS added,
    count(*) FILTER (WHERE change_type = 'removed') AS removed,
    count(*) FILTER (WHERE change_type = 'unchanged') AS unchanged FROM dd)"""
    return with_views(["v_cur", "v_prev"], body, _DIFF)


@oracle("q_diff_changed")
def _():
    body = """SELECT coalesce(c.fingerprint, p.fingerprint) AS fingerprint,
   CASE WHEN p.fingerprint IS NULL THEN 'added' WHEN c.fingerprint IS NULL THEN 'removed'
        WHEN (c.title, c.artist, c.album, c.duration) IS DISTINCT FROM (p.title, p.artist, p.album, p.duration) THEN 'changed'
        ELSE 'unchanged' END AS change_type, coalesce(c.position, p.position) AS position
   FROM dc c FULL OUTER JOIN dp p ON c.fingerprint = p.fingerprint"""
    return with_views(["v_cur", "v_prev"], body, _DIFF)


@oracle("q_first_run")
def _():
    return with_views(["v_cur"], "SELECT fingerprint, 'added' AS change_type, position, title FROM v_cur")


@oracle("q_normalize")
def _():
    return with_views(["v_source"], f"""SELECT position, {norm_sql('title')} AS norm_title,
  {norm_sql('artist')} AS norm_artist, {norm_sql(first_artist_sql('artist'))} AS norm_first_artist FROM v_source""")


@oracle("q_query_string")
def _():
    t, a = norm_sql("title"), norm_sql(first_artist_sql("artist"))
    return with_views(["v_source"], f"""SELECT position, concat_ws(' ',
  CASE WHEN {t} <> '' THEN 'track:' || {t} END, CASE WHEN {a} <> '' THEN 'artist:' || {a} END) AS query
  FROM v_source""")


@oracle("q_first_artist")
def _():
    return with_views(["v_source"], f"SELECT position, {first_artist_sql('artist')} AS first_artist FROM v_source")


@oracle("q_html_titles")
def _():
    raw = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
    return f"SELECT page_id, {raw} AS title_raw, {norm_sql(raw)} AS title FROM pages"


@oracle("q_duration_close")
def _():
    return with_views(["v_source", "v_catalog"], f"""SELECT s.position, {close_sql('s.duration', 'c.duration_ms')}
  AS close FROM v_source s JOIN v_catalog c ON c.catalog_id = 'c' || CAST(s.position AS STRING)""")


@oracle("q_duration_band")
def _():
    return with_views(["v_source", "v_catalog"], """SELECT position, count(*) AS n_close, arg_min(uri, (gap, uri)) AS closest FROM
      (SELECT s.position, c.uri, abs(s.duration - c.duration_ms / 1000.0) AS gap FROM v_source s
       JOIN v_catalog c ON c.album_type = s.album AND s.duration > 0
         AND abs(s.duration - c.duration_ms / 1000.0) <= 5.0) GROUP BY position""")


DURATION_PAYLOAD = """SELECT position,
  CASE position % 4 WHEN 0 THEN CAST(CAST(floor(CAST(duration AS BIGINT) / 60) AS BIGINT) AS STRING) || ':'
      || lpad(CAST(CAST(duration AS BIGINT) % 60 AS STRING), 2, '0')
    WHEN 1 THEN '0:' || CAST(CAST(floor(CAST(duration AS BIGINT) / 60) AS BIGINT) AS STRING) || ':'
      || lpad(CAST(CAST(duration AS BIGINT) % 60 AS STRING), 2, '0')
    WHEN 2 THEN CAST(CAST(duration AS BIGINT) AS STRING)
    ELSE 'a:' || CAST(CAST(duration AS BIGINT) % 60 AS STRING) END AS duration_text,
  CASE position % 5 WHEN 0 THEN CAST(duration AS STRING) WHEN 1 THEN 'x' WHEN 2 THEN '0' END AS duration_seconds
  FROM v_source"""


def parse_duration_sql(num: str, txt: str) -> str:
    def part(i):
        p = f"string_split(coalesce({txt}, ''), ':')[{i}]"
        return f"CASE WHEN regexp_matches({p}, '^\\s*[+-]?[0-9]+\\s*$') THEN CAST(trim({p}) AS BIGINT) END"
    n = f"len(string_split(coalesce({txt}, ''), ':'))"
    from_text = (f"CASE WHEN {n} = 2 THEN {part(1)} * 60 + {part(2)} "
                 f"WHEN {n} = 3 THEN {part(1)} * 3600 + {part(2)} * 60 + {part(3)} END")
    num_set = (f"({num} IS NOT NULL AND trim({num}) <> '' AND "
               f"NOT regexp_matches(trim({num}), '^[+-]?0*(\\.0*)?$'))")
    return (f"CASE WHEN {num_set} THEN coalesce(TRY_CAST(trim({num}) AS DOUBLE), 0.0::DOUBLE) "
            f"WHEN coalesce({txt}, '') <> '' THEN coalesce(CAST({from_text} AS DOUBLE), 0.0::DOUBLE) "
            f"ELSE 0.0::DOUBLE END")


@oracle("q_duration_parse")
def _():
    return with_views(["v_source"], f"SELECT position, {parse_duration_sql('duration_seconds', 'duration_text')} "
                                    f"AS seconds FROM dp", [("dp", DURATION_PAYLOAD)])


# ---------------------------------------------------------------- resolver
def _single(passname: str) -> str:
    ctes = [ratio_cte()] + list(INDEX_CTES) + [("r0", prepared_sql("v_source"))]
    if passname == "isrc":
        ctes += isrc_pass_ctes("p", "r0")
    else:
        ctes += fuzzy_pass_ctes("p", "r0", passname == "title_artist", 0.5 if passname == "title_artist" else 0.4)
    return with_views(["v_source", "v_catalog"], "SELECT _id AS position, uri, method, confidence FROM p", ctes)


@oracle("q_match_isrc")
def _():
    return _single("isrc")


@oracle("q_match_title_artist")
def _():
    return _single("title_artist")


@oracle("q_match_relaxed")
def _():
    return _single("relaxed")


def _scored(metric: str) -> str:
    ctes = ([ratio_cte()] if metric == "ratio" else []) + list(INDEX_CTES) + [("r0", prepared_sql("v_source"))]
    ctes += fuzzy_scored_ctes("p", "r0", True, metric)
    return with_views(["v_source", "v_catalog"], "SELECT s_title, s_first_artist, s_artist, s_duration, uri, "
                                                 "rnk AS cand_rank, score, eff FROM p_e", ctes)


@oracle("q_score_ratio")
def _():
    return _scored("ratio")


@oracle("q_score_levenshtein")
def _():
    return _scored("levenshtein")


@oracle("q_candidates_topk")
def _():
    ctes = list(INDEX_CTES) + [("r0", prepared_sql("v_source"))]
    cc, _ = fuzzy_cands_ctes("p", "r0", True, 10)
    return with_views(["v_source", "v_catalog"], "SELECT s_title, s_first_artist, uri, rnk AS cand_rank FROM p_c",
                      ctes + cc)


def _waterfall(thr: float) -> str:
    ctes = [ratio_cte()] + waterfall_ctes("v_source", pass3_threshold=thr)
    return with_views(["v_source", "v_catalog"],
                      "SELECT _id AS position, uri, method, confidence, method <> '' AS matched FROM wf", ctes)


@oracle("q_match_waterfall")
def _():
    return _waterfall(0.4)


@oracle("q_match_thresholds")
def _():
    return _waterfall(0.6)


# ---------------------------------------------------------------- sync plan
_EX = ("ex", _dedupe("v_existing"))
_SPLIT = ("sp", """SELECT c.*, CASE WHEN coalesce(e.uri, '') <> '' THEN 'already_matched' ELSE 'needs_matching' END
  AS state, CASE WHEN coalesce(e.uri, '') <> '' THEN e.uri ELSE '' END AS existing_uri
  FROM v_cur c LEFT JOIN ex e ON c.fingerprint = e.fingerprint""")
_ENTRY = """coalesce(uri, '') AS u, coalesce(url, '') AS url, coalesce(method, 'cached') AS method,
  coalesce(confidence, 0.0::DOUBLE) AS confidence, coalesce(isrc, '') AS k_isrc, coalesce(explicit, false) AS explicit,
  coalesce(album_release_date, '') AS release_date, coalesce(duration_ms, 0) AS duration_ms, coalesce(popularity, 0) AS popularity,
  coalesce(album_type, '') AS album_type, coalesce(track_number, 0) AS track_number"""
_E_COLS = "url, method, confidence, k_isrc, explicit, release_date, duration_ms, popularity, album_type, track_number"
_CACHE = ("kc", f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY m DESC, u DESC, "
                f"{', '.join(c.strip() + ' DESC' for c in _E_COLS.split(','))}) AS rn "
                f"FROM (SELECT fingerprint, matched AS m, {_ENTRY} FROM v_cache)) WHERE rn = 1")
_CSPLIT = ("cs", """SELECT s.* EXCLUDE (state), CASE WHEN k.fingerprint IS NULL THEN 'search' WHEN k.m THEN 'restored'
  ELSE 'known_unmatched' END AS state,
  CASE WHEN k.fingerprint IS NOT NULL AND k.m THEN k.u ELSE '' END AS cache_uri, k.url, k.method, k.confidence,
  k.k_isrc, k.explicit, k.release_date, k.duration_ms, k.popularity, k.album_type, k.track_number
  FROM sp s LEFT JOIN kc k ON s.fingerprint = k.fingerprint WHERE s.state = 'needs_matching'""")
_PLAN_VIEWS = ["v_cur", "v_prev", "v_existing", "v_cache", "v_target", "v_catalog"]


@oracle("q_split_existing")
def _():
    return with_views(_PLAN_VIEWS, "SELECT position, fingerprint, state, existing_uri FROM sp", [_EX, _SPLIT])


@oracle("q_cache_split")
def _():
    return with_views(_PLAN_VIEWS, "SELECT position, fingerprint, state, cache_uri FROM cs",
                      [_EX, _SPLIT, _CACHE, _CSPLIT])


@oracle("q_limit_pending")
def _():
    body = """SELECT position, fingerprint, CASE WHEN position <= (SELECT max(position) FROM
      (SELECT position FROM cs WHERE state = 'search' ORDER BY position LIMIT 250)) THEN 'search' ELSE 'pending' END
      AS state FROM cs WHERE state = 'search'"""
    return with_views(_PLAN_VIEWS, body, [_EX, _SPLIT, _CACHE, _CSPLIT])


def _plan_ctes(limit: int | None = None) -> list[tuple[str, str]]:
    cut = "" if limit is None else (f" AND position <= (SELECT max(position) FROM (SELECT position FROM cs "
                                    f"WHERE state = 'search' ORDER BY position LIMIT {limit}))")
    ctes = [ratio_cte(), _EX, _SPLIT, _CACHE, _CSPLIT,
            ("srch", f"SELECT * FROM cs WHERE state = 'search'{cut}")]
    ctes += waterfall_ctes("srch")
    ctes += [
        ("fs", """SELECT position, CASE WHEN state = 'already_matched' THEN 'already_matched' END AS state,
                   existing_uri AS uri FROM sp WHERE state = 'already_matched'
                 UNION ALL SELECT position, state, cache_uri FROM cs WHERE state <> 'search'
                 UNION ALL SELECT _id, CASE WHEN method <> '' THEN 'newly_matched' ELSE 'unmatched' END, uri FROM wf
                 UNION ALL SELECT position, 'pending', '' FROM cs WHERE state = 'search'
                   AND position NOT IN (SELECT position FROM srch)"""),
        ("wanted", "SELECT DISTINCT uri FROM fs WHERE state IN ('already_matched', 'restored', 'newly_matched') "
                   "AND coalesce(uri, '') <> ''"),
        ("ta", "SELECT uri FROM wanted WHERE uri NOT IN (SELECT uri FROM v_target)"),
        ("tr", """SELECT DISTINCT e.uri FROM dd JOIN ex e ON dd.fingerprint = e.fingerprint
                 WHERE dd.change_type = 'removed' AND e.uri <> '' AND e.uri NOT IN (SELECT uri FROM wanted)"""),
    ]
    return _DIFF + ctes


@oracle("q_to_add")
def _():
    return with_views(_PLAN_VIEWS + ["v_source"], "SELECT uri FROM ta", _plan_ctes())


@oracle("q_to_remove")
def _():
    return with_views(_PLAN_VIEWS + ["v_source"], "SELECT uri FROM tr", _plan_ctes())


@oracle("q_change_batches")
def _():
    body = """SELECT 'add' AS op, uri, CAST((row_number() OVER (ORDER BY uri) - 1) // 100 AS BIGINT) AS batch_no FROM ta
      UNION ALL SELECT 'remove', uri, CAST((row_number() OVER (ORDER BY uri) - 1) // 100 AS BIGINT) FROM tr"""
    return with_views(_PLAN_VIEWS + ["v_source"], body, _plan_ctes())


_SUMMARY = """SELECT count(*) AS total, count(*) FILTER (WHERE state = 'already_matched') AS already_matched,
      count(*) FILTER (WHERE state = 'restored') AS restored,
      count(*) FILTER (WHERE state = 'newly_matched') AS newly_matched,
      count(*) FILTER (WHERE state IN ('unmatched', 'known_unmatched')) AS unmatched,
      count(*) FILTER (WHERE state = 'pending') AS pending FROM fs"""


@oracle("q_sync_summary")
def _():
    return with_views(_PLAN_VIEWS + ["v_source"], _SUMMARY, _plan_ctes())


@oracle("q_sync_limited")
def _():
    return with_views(_PLAN_VIEWS + ["v_source"], _SUMMARY, _plan_ctes(limit=250))


_TS = "'2026-01-01T00:00:00'"


def _enriched_body() -> str:
    """The enriched table of a sync run: resolved before, from the cache, newly resolved, unresolved."""
    none = ("'' AS uri, '' AS catalog_url, '' AS match_method, 0.0::DOUBLE AS match_confidence, {i} AS isrc, false AS explicit, "
            "'' AS release_date, 0 AS duration_ms, 0 AS popularity, '' AS album_type, 0 AS track_number, '' AS first_synced, '' AS last_synced")
    return f"""SELECT s.position, s.fingerprint, e.uri, '' AS catalog_url, e.match_method, 0.0::DOUBLE AS match_confidence,
        '' AS isrc, false AS explicit, '' AS release_date, 0 AS duration_ms, e.popularity, '' AS album_type, 0 AS track_number,
        '' AS first_synced, '' AS last_synced
        FROM sp s JOIN ex e ON s.fingerprint = e.fingerprint WHERE s.state = 'already_matched'
      UNION ALL SELECT position, fingerprint, cache_uri, url, method, confidence, CASE WHEN isrc = '' THEN k_isrc ELSE isrc END,
        explicit, release_date, duration_ms, popularity, album_type, track_number, {_TS}, {_TS} FROM cs WHERE state = 'restored'
      UNION ALL SELECT c.position, c.fingerprint, w.uri, '', w.method, w.confidence, CASE WHEN c.isrc = '' THEN w.isrc ELSE c.isrc END,
        w.explicit, w.release_date, w.duration_ms, w.popularity, w.album_type, w.track_number, {_TS}, {_TS}
        FROM srch c JOIN wf w ON c.position = w._id WHERE w.method <> ''
      UNION ALL SELECT position, fingerprint, {none.format(i='isrc')} FROM cs WHERE state = 'known_unmatched'
      UNION ALL SELECT c.position, c.fingerprint, {none.format(i='c.isrc')} FROM srch c JOIN wf w ON c.position = w._id
        WHERE w.method = ''"""


@oracle("q_sync_enriched")
def _():
    return with_views(_PLAN_VIEWS + ["v_source"], _enriched_body(), _plan_ctes())


@oracle("q_target_applied")
def _():
    body = "SELECT uri FROM v_target WHERE uri NOT IN (SELECT uri FROM tr) UNION ALL SELECT uri FROM ta"
    return with_views(_PLAN_VIEWS + ["v_source"], body, _plan_ctes())


@oracle("q_match_resumed")
def _():
    return ORACLE["q_match_waterfall"]()


# ---------------------------------------------------------------- enrichment
_ENRICHED = ("en", """SELECT e.position, e.fingerprint, e.title, e.artist, e.uri, e.match_method, e.popularity,
  k.platform, k.track_id, k.album, k.isrc, k.duration, CAST(0 AS INT) AS duration_ms, '' AS artist_genres,
  CAST(0 AS BIGINT) AS playcount
  FROM v_existing e JOIN v_keyed k ON e.position = k.position""")
_E_VIEWS = ["v_existing", "v_keyed", "v_catalog"]


@oracle("q_retry_upsert")
def _():
    ctes = [ratio_cte(), _ENRICHED, ("um", "SELECT * FROM en WHERE uri = ''")]
    ctes += waterfall_ctes("um", duration=None, isrc=None)
    ctes += [("nw", "SELECT u.fingerprint, w.uri, w.method AS match_method FROM um u "
                    "JOIN wf w ON u.position = w._id WHERE w.method <> '' AND w.uri <> ''")]
    body = """SELECT fingerprint, uri, match_method FROM en
      WHERE fingerprint NOT IN (SELECT fingerprint FROM nw) UNION ALL SELECT * FROM nw"""
    return with_views(_E_VIEWS, body, ctes)


@oracle("q_apply_match")
def _():
    ctes = [ratio_cte()] + waterfall_ctes("v_source")
    body = """SELECT s.position, CASE WHEN w.uri <> '' THEN w.uri ELSE '' END AS uri,
      CASE WHEN w.uri <> '' THEN w.method ELSE '' END AS match_method,
      CASE WHEN w.uri <> '' THEN w.confidence ELSE 0.0::DOUBLE END AS match_confidence,
      CASE WHEN w.uri <> '' AND s.isrc = '' AND w.isrc <> '' THEN w.isrc ELSE s.isrc END AS isrc,
      CASE WHEN w.uri <> '' THEN w.duration_ms ELSE 0 END AS duration_ms,
      CASE WHEN w.uri <> '' THEN w.popularity ELSE 0 END AS popularity,
      CASE WHEN w.uri <> '' THEN '2026-01-01T00:00:00' ELSE '' END AS first_synced,
      CASE WHEN w.uri <> '' THEN '2026-01-01T00:00:00' ELSE '' END AS last_synced
      FROM v_source s LEFT JOIN wf w ON s.position = w._id"""
    return with_views(["v_source", "v_catalog"], body, ctes)


@oracle("q_backfill_metadata")
def _():
    body = """SELECT e.position, e.uri,
      CASE WHEN h THEN coalesce(c.duration_ms, 0) ELSE e.duration_ms END AS duration_ms,
      CASE WHEN h THEN coalesce(c.explicit, false) ELSE false END AS explicit,
      CASE WHEN h THEN coalesce(c.popularity, 0) ELSE e.popularity END AS popularity,
      CASE WHEN h THEN coalesce(c.track_number, 0) ELSE 0 END AS track_number,
      CASE WHEN h AND coalesce(c.release_date, '') <> '' THEN c.release_date ELSE '' END AS release_date,
      CASE WHEN h AND coalesce(c.album_type, '') <> '' THEN c.album_type ELSE '' END AS album_type,
      CASE WHEN h AND e.isrc = '' AND coalesce(c.isrc, '') <> '' THEN c.isrc ELSE e.isrc END AS isrc
      FROM (SELECT e.*, c.catalog_id IS NOT NULL AS h, c.duration_ms AS c_duration_ms FROM
              (SELECT *, uri <> '' AND (duration_ms = 0 OR isrc = '' OR popularity = 0) AS need FROM en) e
            LEFT JOIN v_catalog c ON e.need AND c.catalog_id = split_part(e.uri, ':', -1)) e
      LEFT JOIN v_catalog c ON e.h AND c.catalog_id = split_part(e.uri, ':', -1)"""
    return with_views(_E_VIEWS, body, [_ENRICHED])


@oracle("q_backfill_genres")
def _():
    body = """SELECT e.position, e.uri, CASE WHEN g.catalog_id IS NOT NULL THEN g.genre_text ELSE '' END
      AS artist_genres FROM en e LEFT JOIN
      (SELECT c.catalog_id, array_to_string(a.genres, ', ') AS genre_text FROM v_catalog c
       JOIN v_artist a ON c.artist = a.artist_id) g
      ON e.uri <> '' AND g.catalog_id = split_part(e.uri, ':', -1)"""
    return with_views(_E_VIEWS + ["v_artist"], body, [_ENRICHED])


@oracle("q_audio_features")
def _():
    from concordia.schema import AUDIO_FEATURES
    dflt = {"key": "-1", "mode": "-1", "time_signature": "0"}
    cols = []
    for f in AUDIO_FEATURES:
        d = dflt.get(f, "0.0::DOUBLE")
        cols.append(f"CASE WHEN f.catalog_id IS NOT NULL THEN coalesce(f.{f}, {d}) ELSE {d} END AS {f}")
    body = (f"SELECT e.position, e.uri, {', '.join(cols)}, e.uri <> '' AS audio_features_fetched "
            f"FROM en e LEFT JOIN v_features f ON e.uri <> '' AND f.catalog_id = split_part(e.uri, ':', -1)")
    return with_views(_E_VIEWS + ["v_features"], body, [_ENRICHED])


_LISTEN = """SELECT e.position, CASE WHEN l.title IS NOT NULL THEN CAST(l.playcount AS BIGINT) ELSE 0 END AS playcount,
      CASE WHEN l.title IS NOT NULL THEN CAST(l.listeners AS BIGINT) ELSE 0 END AS listeners,
      CASE WHEN l.title IS NOT NULL THEN coalesce(array_to_string(l.tags[1:5], ', '), '') ELSE '' END AS tags
      FROM en e LEFT JOIN v_listen l ON e.title <> '' AND e.artist <> ''
        AND trim(split_part(e.artist, ',', 1)) <> ''
        AND trim(split_part(e.artist, ',', 1)) = l.artist AND e.title = l.title"""


@oracle("q_listen_stats")
def _():
    return with_views(_E_VIEWS + ["v_listen"], _LISTEN, [_ENRICHED])


@oracle("q_listen_coverage")
def _():
    return with_views(_E_VIEWS + ["v_listen"], "SELECT count(*) AS total, count(*) FILTER (WHERE playcount > 0) "
                                               "AS with_listen_stats FROM ls", [_ENRICHED, ("ls", _LISTEN)])


@oracle("q_needs_enrichment")
def _():
    cond = "(uri <> '' AND (popularity = 0 OR artist_genres = '' OR playcount = 0))"
    return with_views(_E_VIEWS, f"SELECT coalesce(bool_or({cond}), false) AS needs_enrichment, "
                                f"count(*) FILTER (WHERE {cond}) AS n_needing FROM en", [_ENRICHED])


# ---------------------------------------------------------------- reports
@oracle("q_match_rate")
def _():
    return with_views(_E_VIEWS, """SELECT count(*) AS total, count(*) FILTER (WHERE uri <> '') AS matched,
      CASE WHEN count(*) > 0 THEN 100.0::DOUBLE * CAST(count(*) FILTER (WHERE uri <> '') AS DOUBLE)
        / CAST(count(*) AS DOUBLE) ELSE 0.0::DOUBLE END AS match_rate FROM en""", [_ENRICHED])


_METHODS = """SELECT coalesce(nullif(match_method, ''), 'unknown') AS method, count(*) AS n FROM en
  WHERE uri <> '' GROUP BY 1"""


@oracle("q_method_breakdown")
def _():
    return with_views(_E_VIEWS, _METHODS, [_ENRICHED])


@oracle("q_status")
def _():
    body = """SELECT 'source_tracks' AS metric, CAST(count(*) AS DOUBLE) AS value FROM v_source
      UNION ALL SELECT 'enriched_tracks', CAST(count(*) AS DOUBLE) FROM en
      UNION ALL SELECT 'matched_tracks', CAST(count(*) FILTER (WHERE uri <> '') AS DOUBLE) FROM en
      UNION ALL SELECT 'match_rate', 100.0::DOUBLE * CAST(count(*) FILTER (WHERE uri <> '') AS DOUBLE)
        / CAST(count(*) AS DOUBLE) FROM en
      UNION ALL SELECT 'method:' || method, CAST(n AS DOUBLE) FROM mb
      UNION ALL SELECT 'unmatched_tracks', CAST(count(*) FILTER (WHERE uri = '') AS DOUBLE) FROM en
      UNION ALL SELECT 'snapshots', 2.0
      UNION ALL SELECT 'latest_snapshot:2026-01-02T00-00-00', CAST(count(*) AS DOUBLE) FROM v_cur"""
    return with_views(_E_VIEWS + ["v_source", "v_cur"], body, [_ENRICHED, ("mb", _METHODS)])


@oracle("q_preview")
def _():
    body = """SELECT d.change_type, d.fingerprint, d.position, d.title, d.row_no, t.type_total FROM
      (SELECT *, row_number() OVER (PARTITION BY change_type ORDER BY position) AS row_no FROM dd) d
      JOIN (SELECT change_type, count(*) AS type_total FROM dd GROUP BY 1) t USING (change_type)
      WHERE d.row_no <= 20"""
    return with_views(["v_cur", "v_prev"], body, _DIFF)


# ---------------------------------------------------------------- I/O round trips
def _full() -> str:
    """The enriched table of a last run with all lookups."""
    from concordia.schema import AUDIO_FEATURES
    fdef = {"key": "-1", "mode": "-1", "time_signature": "0"}
    feats = []
    for f in AUDIO_FEATURES:
        d = fdef.get(f, "0.0::DOUBLE")
        feats.append(f"CASE WHEN e.uri <> '' AND f.catalog_id IS NOT NULL THEN coalesce(f.{f}, {d}) ELSE {d} END AS {f}")
    return f"""SELECT e.position, e.title, e.artist, e.album, e.platform, e.track_id, e.duration, e.uri, e.match_method,
        CASE WHEN h THEN coalesce(c.duration_ms, 0) ELSE 0 END AS duration_ms, h AND coalesce(c.explicit, false) AS explicit,
        CASE WHEN h THEN coalesce(c.popularity, 0) ELSE e.popularity END AS popularity,
        CASE WHEN h THEN coalesce(c.track_number, 0) ELSE 0 END AS track_number,
        CASE WHEN h THEN coalesce(c.release_date, '') ELSE '' END AS release_date,
        CASE WHEN h THEN coalesce(c.album_type, '') ELSE '' END AS album_type,
        CASE WHEN h AND e.isrc = '' THEN coalesce(c.isrc, '') ELSE e.isrc END AS isrc,
        coalesce(g.genre_text, '') AS artist_genres, e.uri <> '' AS audio_features_fetched, {', '.join(feats)},
        CASE WHEN l.title IS NOT NULL THEN CAST(l.playcount AS BIGINT) ELSE 0 END AS playcount,
        CASE WHEN l.title IS NOT NULL THEN CAST(l.listeners AS BIGINT) ELSE 0 END AS listeners,
        CASE WHEN l.title IS NOT NULL THEN coalesce(array_to_string(l.tags[1:5], ', '), '') ELSE '' END AS tags
      FROM (SELECT *, uri <> '' AS h FROM en) e
      LEFT JOIN v_catalog c ON e.uri <> '' AND c.catalog_id = split_part(e.uri, ':', -1)
      LEFT JOIN (SELECT c.catalog_id, array_to_string(a.genres, ', ') AS genre_text FROM v_catalog c
                 JOIN v_artist a ON c.artist = a.artist_id) g
        ON e.uri <> '' AND g.catalog_id = split_part(e.uri, ':', -1)
      LEFT JOIN v_features f ON e.uri <> '' AND f.catalog_id = split_part(e.uri, ':', -1)
      LEFT JOIN v_listen l ON e.title <> '' AND e.artist <> '' AND trim(split_part(e.artist, ',', 1)) <> ''
        AND trim(split_part(e.artist, ',', 1)) = l.artist AND e.title = l.title"""


_FULL_VIEWS = _E_VIEWS + ["v_artist", "v_features", "v_listen"]


@oracle("q_enrich")
def _():
    body = """SELECT position, uri, duration_ms, explicit, popularity, track_number, release_date, album_type, isrc, artist_genres,
      danceability, key, audio_features_fetched, playcount, listeners, tags FROM full_t"""
    return with_views(_FULL_VIEWS, body, [_ENRICHED, ("full_t", _full())])


@oracle("q_csv_roundtrip")
def _():
    from concordia.schema import AUDIO_FEATURES
    shown = {"tempo": "%.1f", "loudness": "%.2f"}
    feats = [f"CASE WHEN audio_features_fetched THEN CAST(printf('{shown.get(f, '%.4f')}', {f}) AS DOUBLE) ELSE 0.0::DOUBLE END AS {f}"
             for f in AUDIO_FEATURES if f not in ("key", "mode", "time_signature")]
    body = f"""SELECT title, artist, album, isrc, platform, track_id, duration, '' AS added_date, '' AS added_by, '' AS url, uri,
      '' AS catalog_url, duration_ms, uri <> '' AND explicit AS explicit, release_date, {', '.join(feats)},
      CASE WHEN audio_features_fetched AND key >= 0 THEN key ELSE -1 END AS key,
      CASE WHEN audio_features_fetched AND mode >= 0 THEN mode ELSE -1 END AS mode,
      CASE WHEN audio_features_fetched THEN time_signature ELSE 0 END AS time_signature,
      audio_features_fetched, popularity, artist_genres, album_type, track_number, playcount, listeners, tags, match_method,
      0.0::DOUBLE AS match_confidence, '' AS first_synced, '' AS last_synced FROM full_t"""
    return with_views(_FULL_VIEWS, body, [_ENRICHED, ("full_t", _full())])


@oracle("q_snapshot_roundtrip")
def _():
    return with_views(["v_cur"], "SELECT position, platform, track_id, title, artist, album, duration, "
                                 "CASE WHEN track_id <> '' THEN platform || ':' || track_id "
                                 "ELSE lower(platform || ':' || title || ':' || artist) END AS fingerprint, "
                                 "'2026-01-02T00-00-00' AS snapshot_ts FROM v_cur")


@oracle("q_snapshot_history")
def _():
    return with_views(["v_cur", "v_prev"], """SELECT count(DISTINCT ts) AS snapshots, max(ts) AS latest FROM
      (SELECT '2026-01-01T00-00-00' AS ts FROM v_prev UNION ALL SELECT '2026-01-02T00-00-00' FROM v_cur)""")


@oracle("q_payload_flatten")
def _():
    body = f"""SELECT s.position, 'ytmusic' AS platform, s.track_id, s.title, s.artist, s.album, s.isrc,
      {parse_duration_sql('dp.duration_seconds', 'dp.duration_text')} AS duration,
      CASE WHEN s.track_id <> '' THEN 'https://music.youtube.com/watch?v=' || s.track_id ELSE '' END AS url
      FROM v_source s JOIN dp ON s.position = dp.position WHERE s.position % 13 <> 0"""
    return with_views(["v_source"], body, [("dp", DURATION_PAYLOAD)])


@oracle("q_listen_payload")
def _():
    return with_views(["v_listen"], """SELECT artist, title, CAST(playcount AS BIGINT) AS playcount,
      CAST(listeners AS BIGINT) AS listeners, array_to_string(tags, ', ') AS tags FROM v_listen
      WHERE NOT contains(title, 'rod') AND playcount % 7 <> 0""")


@oracle("q_cache_roundtrip")
def _():
    return with_views(["v_cache"], "SELECT fingerprint, matched, uri, url, method, confidence, isrc, explicit, "
                                   "album_release_date, duration_ms, popularity, album_type, track_number FROM (SELECT *, row_number() "
                                   "OVER (PARTITION BY fingerprint ORDER BY matched DESC, uri DESC) AS rn FROM v_cache) WHERE rn = 1")


# ---------------------------------------------------------------- streaming (batch SQL equivalents)
@oracle("q_stream_incremental")
def _():
    return with_views(["v_cur"], """SELECT fingerprint, position, title FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint
      ORDER BY CASE WHEN position >= 1099511627776 THEN 0 ELSE 2 - position % 2 END DESC, position DESC) AS rn FROM v_cur) WHERE rn = 1""")


@oracle("q_stream_split")
def _():
    return ORACLE["q_split_existing"]()


# ---------------------------------------------------------------- composite jobs
@oracle("q_import_csv")
def _():
    return with_views(["v_keyed"], "SELECT title, artist, album, isrc, platform, track_id, duration, fingerprint "
                                   "FROM v_keyed")


@oracle("q_diff_job")
def _():
    fp = ("CASE WHEN track_id <> '' THEN platform || ':' || track_id "
          "ELSE lower(platform || ':' || title || ':' || artist) END")
    ctes = [("cf", f"SELECT position, {fp} AS fingerprint FROM v_cur"),
            ("pf", f"SELECT position, {fp} AS fingerprint FROM v_prev"),
            ("dc", _dedupe("cf")), ("dp", _dedupe("pf")),
            ("dd", """SELECT CASE WHEN c.fingerprint IS NOT NULL AND p.fingerprint IS NOT NULL THEN 'unchanged'
               WHEN c.fingerprint IS NOT NULL THEN 'added' ELSE 'removed' END AS change_type
               FROM dc c FULL OUTER JOIN dp p ON c.fingerprint = p.fingerprint""")]
    body = """SELECT added, removed, unchanged, (added > 0 OR removed > 0) AS has_changes,
  concat_ws(', ', CASE WHEN added > 0 THEN '+' || CAST(added AS STRING) || ' added' END,
    CASE WHEN removed > 0 THEN '-' || CAST(removed AS STRING) || ' removed' END,
    CAST(unchanged AS STRING) || ' unchanged') AS summary
  FROM (SELECT count(*) FILTER (WHERE change_type = 'added') AS added,
    count(*) FILTER (WHERE change_type = 'removed') AS removed,
    count(*) FILTER (WHERE change_type = 'unchanged') AS unchanged FROM dd)"""
    return with_views(["v_cur", "v_prev"], body, ctes)


@oracle("q_stream_matches")
def _():
    ctes = [ratio_cte(), _EX, _SPLIT, ("nm", "SELECT * FROM sp WHERE state = 'needs_matching'")]
    ctes += waterfall_ctes("nm")
    return with_views(_PLAN_VIEWS + ["v_source"],
                      "SELECT _id AS position, uri, method, confidence, method <> '' AS matched FROM wf", ctes)


@oracle("q_snapshot_job")
def _():
    return with_views(["v_cur"], f"""SELECT c.platform, c.track_id, c.title, c.artist, c.album,
      {parse_duration_sql('dp.duration_seconds', 'dp.duration_text')} AS duration,
      CASE WHEN c.track_id <> '' THEN c.platform || ':' || c.track_id
           ELSE lower(c.platform || ':' || c.title || ':' || c.artist) END AS fingerprint
      FROM v_cur c JOIN dp ON c.position = dp.position""", [("dp", DURATION_PAYLOAD.replace("FROM v_source", "FROM v_cur"))])


@oracle("q_sync_published")
def _():
    body = f"""SELECT 'enriched' AS name, count(*) AS n FROM en_t UNION ALL
      SELECT 'enriched_resolved', count(*) FILTER (WHERE uri <> '') FROM en_t UNION ALL
      SELECT 'features_fetched', count(*) FILTER (WHERE uri <> '') FROM en_t UNION ALL
      SELECT 'unmatched', count(*) FILTER (WHERE uri = '') FROM en_t UNION ALL
      SELECT 'snapshot', count(*) FROM v_cur UNION ALL
      SELECT 'results_matched', count(DISTINCT s.fingerprint) FROM srch s JOIN wf w ON s.position = w._id WHERE w.method <> ''"""
    return with_views(_PLAN_VIEWS + ["v_source"], body, _plan_ctes() + [("en_t", _enriched_body())])


@oracle("q_retry_published")
def _():
    return f"SELECT uri, match_method FROM ({ORACLE['q_retry_upsert']()}) WHERE uri <> ''"


@oracle("q_listen_job")
def _():
    body = """SELECT e.platform, e.track_id, e.title, e.artist, CASE WHEN l.title IS NOT NULL THEN CAST(l.playcount AS BIGINT) ELSE 0 END AS playcount,
      CASE WHEN l.title IS NOT NULL THEN CAST(l.listeners AS BIGINT) ELSE 0 END AS listeners,
      CASE WHEN l.title IS NOT NULL THEN coalesce(array_to_string(l.tags[1:5], ', '), '') ELSE '' END AS tags
      FROM v_cur e LEFT JOIN v_listen l ON e.title <> '' AND e.artist <> '' AND trim(split_part(e.artist, ',', 1)) = l.artist AND e.title = l.title"""
    return with_views(["v_cur", "v_listen"], body)


@oracle("q_bulk_lookup")
def _():
    return with_views(["v_catalog", "v_existing"], """SELECT catalog_id, uri, duration_ms, popularity FROM v_catalog
      WHERE catalog_id IN (SELECT split_part(uri, ':', -1) FROM v_existing WHERE uri <> '')""")


@oracle("q_catalog_payload")
def _():
    k = "CAST(substr(catalog_id, 2) AS BIGINT)"
    return with_views(["v_catalog"], f"""SELECT catalog_id, uri, 'https://open.example/track/' || catalog_id AS url,
      name, artist, isrc, duration_ms, explicit,
      CASE WHEN {k} % 10 <> 0 THEN popularity ELSE 0 END AS popularity,
      CASE WHEN {k} % 9 <> 0 THEN album_type ELSE '' END AS album_type, track_number,
      CASE WHEN {k} % 9 <> 0 THEN release_date ELSE '' END AS release_date, artist AS artist_id FROM v_catalog""")


@oracle("q_target_pages")
def _():
    return with_views(["v_catalog"], """SELECT uri, catalog_id, artist AS artist_id FROM v_catalog
      WHERE CAST(substr(catalog_id, 2) AS BIGINT) % 7 <> 0""")



@oracle("q_artist_payload")
def _():
    return with_views(["v_artist"], """SELECT artist_id, CASE WHEN CAST(split_part(artist_id, '#', -1) AS BIGINT) % 4 <> 0
      THEN array_to_string(genres, ', ') ELSE '' END AS genre_text FROM v_artist""")


@oracle("q_features_payload")
def _():
    from concordia.schema import AUDIO_FEATURES
    cols = ", ".join(f if f != "tempo" else
                     "CASE WHEN CAST(substr(catalog_id, 2) AS BIGINT) % 5 <> 0 THEN tempo END AS tempo"
                     for f in AUDIO_FEATURES)
    return with_views(["v_features"], f"SELECT catalog_id, {cols} FROM v_features")
