"""DuckDB oracle SQL for the driver's side-by-side correctness check.

Every query is self-contained: the derived views are CTEs over the driver's
pre-registered tables.  DuckDB has no Ratcliff/Obershelp ratio, so queries
that score with it embed a ``VALUES`` table of the distinct (source,
candidate) string pairs with their stdlib ratio; DuckDB does the
normalisation, blocking, ranking, scoring, arg-max and waterfall itself.
"""

from __future__ import annotations

import functools
import os
from difflib import SequenceMatcher

# --------------------------------------------------------------------------
# Derived views (DuckDB dialect).
# --------------------------------------------------------------------------
VIEWS: dict[str, str] = {
    "v_catalog": """SELECT 'c' || CAST(p_partkey AS STRING) AS catalog_id,
  'cat:track:c' || CAST(p_partkey AS STRING) AS uri, p_name AS name, p_brand AS artist,
  'IS' || lpad(CAST(p_partkey AS STRING), 8, '0') AS isrc, CAST(p_size * 6000 AS INT) AS duration_ms,
  p_partkey % 5 = 0 AS explicit, CAST(p_partkey % 101 AS INT) AS popularity, p_type AS album_type,
  CAST(p_partkey % 20 AS INT) AS track_number,
  '20' || lpad(CAST(p_partkey % 25 AS STRING), 2, '0') AS release_date FROM part""",
    "v_source": """SELECT p_partkey AS position, 'ytmusic' AS platform,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'y' || CAST(p_partkey AS STRING) END AS track_id,
  CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' (feat. Guest)' WHEN 2 THEN p_name || ' ft. Guest'
    WHEN 3 THEN upper(p_name) || ' [Official Video]' WHEN 4 THEN p_name || ' live'
    ELSE replace(p_name, ' ', ' &amp; ') || '  (Radio  Edit)' END AS title,
  CASE WHEN p_partkey % 7 = 0 THEN 'Guest' WHEN p_partkey % 4 = 0 THEN p_brand || ', Guest' ELSE p_brand END AS artist,
  p_type AS album,
  CASE WHEN p_partkey % 3 = 0 THEN 'IS' || lpad(CAST(p_partkey AS STRING), 8, '0') ELSE '' END AS isrc,
  CASE WHEN p_partkey % 17 = 0 THEN CAST(0 AS DOUBLE)
    ELSE CAST(greatest(1, p_size * 6 + (p_partkey % 13 - 6)) AS DOUBLE) END AS duration FROM part""",
    "v_keyed": """SELECT *, CASE WHEN track_id <> '' THEN platform || ':' || track_id
  ELSE lower(platform || ':' || title || ':' || artist) END AS fingerprint FROM v_source""",
    "v_prev": "SELECT * FROM v_keyed WHERE position % 10 <> 3",
    "v_cur": """SELECT * FROM v_keyed WHERE position % 10 <> 7
  UNION ALL SELECT position + 1099511627776 AS position, platform, track_id, title || ' v2' AS title, artist, album, isrc,
  duration, fingerprint FROM v_keyed WHERE position % 50 = 1""",
    "v_existing": """SELECT *, CASE WHEN uri = '' THEN '' WHEN position % 8 = 0 THEN 'isrc' WHEN position % 12 = 0 THEN ''
    ELSE 'title_artist' END AS match_method,
  CASE WHEN position % 12 = 0 THEN 0 ELSE CAST(position % 101 AS INT) END AS popularity
  FROM (SELECT position, fingerprint, title, artist, CASE WHEN position % 4 = 0 OR position % 20 = 7
    THEN 'cat:track:c' || CAST(position AS STRING) ELSE '' END AS uri FROM v_keyed)""",
    "v_cache": """SELECT CASE WHEN position % 8 IN (1, 5) THEN fingerprint ELSE 'retired:' || fingerprint END AS fingerprint,
  position % 8 = 1 AS matched,
  CASE WHEN position % 8 = 1 THEN 'cat:track:c' || CAST(position AS STRING) ELSE '' END AS uri,
  CASE WHEN position % 8 = 1 THEN 'https://open.example/track/c' || CAST(position AS STRING) END AS url,
  CASE WHEN position % 8 = 1 AND position % 3 <> 0 THEN 'title_artist' END AS method,
  CASE WHEN position % 8 = 1 AND position % 3 <> 0 THEN 0.5::DOUBLE + CAST(position % 50 AS DOUBLE) / 100.0::DOUBLE END AS confidence,
  CASE WHEN position % 8 = 1 AND position % 5 <> 0 THEN 'IC' || lpad(CAST(position AS STRING), 8, '0') END AS isrc,
  CASE WHEN position % 8 = 1 THEN position % 7 = 0 END AS explicit,
  CASE WHEN position % 8 = 1 THEN '19' || lpad(CAST(position % 90 AS STRING), 2, '0') END AS album_release_date,
  CASE WHEN position % 8 = 1 THEN CAST(position % 300 * 1000 AS INT) END AS duration_ms,
  CASE WHEN position % 8 = 1 THEN CAST(position % 97 AS INT) END AS popularity,
  CASE WHEN position % 8 = 1 AND position % 2 = 1 THEN 'single' END AS album_type,
  CASE WHEN position % 8 = 1 THEN CAST(position % 12 AS INT) END AS track_number FROM v_keyed""",
    "v_target": "SELECT CASE WHEN popularity % 3 = 0 THEN uri ELSE replace(uri, ':c', ':x') END AS uri FROM v_catalog",
    "v_artist": """SELECT p_brand AS artist_id, list_sort(list(DISTINCT p_type)) AS genres
  FROM part GROUP BY p_brand""",
    "v_features": """SELECT 'c' || CAST(vec_id AS STRING) AS catalog_id,
  CAST(embedding[1] AS DOUBLE) AS danceability, CAST(embedding[2] AS DOUBLE) AS energy,
  CAST(embedding[3] AS DOUBLE) AS valence, CAST(embedding[4] AS DOUBLE) AS tempo,
  CAST(floor((CAST(embedding[5] AS DOUBLE) + 1.0::DOUBLE) * 6.0::DOUBLE) AS INT) AS key,
  CASE WHEN CAST(embedding[6] AS DOUBLE) >= 0 THEN 1 ELSE 0 END AS mode,
  CAST(embedding[7] AS DOUBLE) AS loudness, CAST(embedding[8] AS DOUBLE) AS speechiness,
  CAST(embedding[9] AS DOUBLE) AS acousticness, CAST(embedding[10] AS DOUBLE) AS instrumentalness,
  CAST(embedding[11] AS DOUBLE) AS liveness,
  3 + CASE WHEN CAST(embedding[12] AS DOUBLE) >= 0 THEN 1 ELSE 0 END AS time_signature
  FROM embeddings""",
    "v_listen_user": """SELECT user_id, count(*) AS playcount, count(DISTINCT event_type) AS listeners,
  list(DISTINCT event_type) AS tags FROM events GROUP BY user_id""",
    "v_listen": """SELECT p.p_brand AS artist, p.p_name AS title, sum(u.playcount) AS playcount,
  sum(u.listeners) AS listeners, list_sort(list_distinct(flatten(list(u.tags)))) AS tags
  FROM v_listen_user u JOIN part p ON u.user_id = p.p_partkey GROUP BY p.p_brand, p.p_name""",
}

DEPS: dict[str, list[str]] = {
    "v_keyed": ["v_source"], "v_prev": ["v_keyed"], "v_cur": ["v_keyed"], "v_existing": ["v_keyed"],
    "v_cache": ["v_keyed"], "v_target": ["v_catalog"], "v_listen": ["v_listen_user"],
}


def _closure(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(n):
        for d in DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)
    for n in names:
        visit(n)
    return order


def with_views(names: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH <views...>, <extra ctes...> <body>``."""
    ctes = [f"{n} AS ({VIEWS[n]})" for n in _closure(names)]
    ctes += [f"{n} AS ({q})" for n, q in (extra or [])]
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --------------------------------------------------------------------------
# Scalar helpers (DuckDB RE2; fixtures are ASCII-spaced).
# The three patterns of what a title's normalisation strips.
# --------------------------------------------------------------------------
RE_FEAT_BRACKET = r"\s*[\(\[]\s*(?:feat|ft)\.?\s+[^\)\]]+[\)\]]"
RE_FEAT_TRAILING = r"\s+(?:feat|ft)\.?\s+.+$"
RE_SUFFIX = r"\s*[\(\[]\s*(?:radio\s+edit|original\s+mix|official\s+(?:video|audio))\s*[\)\]]"


def unescape_sql(x: str) -> str:
    """The entities the fixtures contain; like the HTML5 rules, these legacy
    names also decode without the trailing ';'.  &amp last, so a decoded '&'
    is never decoded again (single pass)."""
    s = f"coalesce({x}, '')"
    for ent, ch in (("&lt", "<"), ("&gt", ">"), ("&quot", '"'), ("&#39", "''"), ("&amp", "&")):
        s = f"regexp_replace({s}, '{ent};?', '{ch}', 'g')"
    return s


def norm_sql(x: str) -> str:
    s = f"nfc_normalize({unescape_sql(x)})"
    s = f"regexp_replace({s}, '{RE_FEAT_BRACKET}', '', 'gi')"
    s = f"regexp_replace({s}, '{RE_FEAT_TRAILING}', '', 'gi')"
    s = f"regexp_replace({s}, '{RE_SUFFIX}', '', 'gi')"
    s = f"regexp_replace({s}, '\\s+', ' ', 'g')"
    return f"lower(trim({s}))"


def first_artist_sql(x: str) -> str:
    return f"trim(split_part(coalesce({x}, ''), ',', 1))"


def tokens_sql(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+'))"


def close_sql(sec: str, ms: str, tol: float = 5.0) -> str:
    return (f"({sec} <= 0 OR {ms} <= 0 OR abs({sec} - CAST({ms} AS DOUBLE) / 1000.0::DOUBLE) "
            f"<= {tol!r}::DOUBLE)")


def lev_sql(a: str, b: str) -> str:
    return (f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE ELSE "
            f"1.0::DOUBLE - CAST(levenshtein(lower({a}), lower({b})) AS DOUBLE) / "
            f"CAST(greatest(length({a}), length({b})) AS DOUBLE) END")


# --------------------------------------------------------------------------
# Ratio pairs (stdlib difflib), computed once per data directory.
# --------------------------------------------------------------------------
ORACLE_SF_DIR = "/root/testdata/sf0.01"  # the driver's correctness scale


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@functools.lru_cache(maxsize=4)
def ratio_pairs_values(sf_dir: str = ORACLE_SF_DIR) -> str:
    """``VALUES`` rows (a, b, sim) for every pair any fixture query can score."""
    import duckdb

    con = duckdb.connect()
    con.sql("SET enable_progress_bar = false")
    for t in ("part",):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t + '.parquet')}')")
    body = f"""
      SELECT DISTINCT s.a, c.b, s.aa, c.ba FROM
        (SELECT DISTINCT {norm_sql('title')} AS a, {norm_sql('artist')} AS aa, isrc FROM v_source
         UNION SELECT DISTINCT {norm_sql("title || ' v2'")} AS a, {norm_sql('artist')} AS aa, isrc
         FROM v_source) s
      JOIN (SELECT DISTINCT {norm_sql('name')} AS b, {norm_sql('artist')} AS ba, isrc FROM v_catalog) c
        ON list_has_all({tokens_sql('c.b')}, {tokens_sql('s.a')}) OR (s.isrc <> '' AND s.isrc = c.isrc)
    """
    pairs = set()
    for a, b, aa, ba in con.sql(with_views(["v_source", "v_catalog"], body)).fetchall():
        pairs.add((a, b))
        pairs.add((aa, ba))
    con.close()
    rows = [f"({_sql_str(a)}, {_sql_str(b)}, '{(SequenceMatcher(a=a, b=b, autojunk=False).ratio() if a and b else 0.0)!r}')" for a, b in sorted(pairs)]
    return "VALUES " + ",\n".join(rows)


def ratio_cte(sf_dir: str | None = None) -> tuple[str, str]:
    """The pairs CTE for the data directory the oracle runs on (module
    setting ``ORACLE_SF_DIR``, read at call time)."""
    d = sf_dir or ORACLE_SF_DIR
    return ("r_pairs", f"SELECT a, b, CAST(sim AS DOUBLE) AS sim FROM ({ratio_pairs_values(d)}) AS t(a, b, sim)")


# --------------------------------------------------------------------------
# Resolver in SQL (brute force: nested-loop token containment).
# --------------------------------------------------------------------------
FIELDS = ["catalog_id", "uri", "isrc", "duration_ms", "explicit", "release_date", "popularity",
          "album_type", "track_number"]
PROBE = ["s_title", "s_first_artist", "s_artist", "s_duration"]


def prepared_sql(view: str, id_col: str = "position", title="title", artist="artist",
                 duration="duration", isrc="isrc") -> str:
    d = f"coalesce(CAST({duration} AS DOUBLE), 0.0::DOUBLE)" if duration else "0.0::DOUBLE"
    i = f"coalesce({isrc}, '')" if isrc else "''"
    return (f"SELECT {id_col} AS _id, {norm_sql(title)} AS s_title, "
            f"{norm_sql(first_artist_sql(artist))} AS s_first_artist, {norm_sql(artist)} AS s_artist, "
            f"{d} AS s_duration, {i} AS s_isrc FROM {view}")


INDEX_CTES = [
    ("idx0", f"SELECT {', '.join(FIELDS)}, {norm_sql('name')} AS c_name, {norm_sql('artist')} AS c_artist "
             f"FROM v_catalog"),
    ("idx", f"SELECT *, {tokens_sql('c_name')} AS ct, {tokens_sql('c_artist')} AS ca FROM idx0"),
]


def score_sql(metric: str = "ratio") -> tuple[str, str, str]:
    """(join clause, title sim expr, artist sim expr) for a row with PROBE + c_name/c_artist."""
    if metric == "levenshtein":
        return "", lev_sql("s_title", "c_name"), lev_sql("s_artist", "c_artist")
    j = (" LEFT JOIN r_pairs rt ON rt.a = x.s_title AND rt.b = x.c_name"
         " LEFT JOIN r_pairs ra ON ra.a = x.s_artist AND ra.b = x.c_artist")
    return j, "rt.sim", "ra.sim"


def _score_expr(tsim: str, asim: str, w=(0.45, 0.40, 0.15), miss=0.5) -> str:
    return (f"{tsim} * {w[0]!r}::DOUBLE + {asim} * {w[1]!r}::DOUBLE + "
            f"CASE WHEN x.dur_close THEN 1.0::DOUBLE ELSE {miss!r}::DOUBLE END * {w[2]!r}::DOUBLE")


def isrc_pass_ctes(p: str, rest: str, metric="ratio", floor=0.95) -> list[tuple[str, str]]:
    j, ts, as_ = score_sql(metric)
    f = ", ".join(f"c.{c}" for c in FIELDS)
    return [
        (f"{p}_c1", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY isrc ORDER BY popularity DESC, uri) "
                    "AS rb FROM idx WHERE isrc <> '') WHERE rb = 1"),
        (f"{p}_j", f"SELECT r._id, r.s_title, r.s_artist, c.c_name, c.c_artist, {f}, "
                   f"{close_sql('r.s_duration', 'c.duration_ms')} AS dur_close "
                   f"FROM {rest} r JOIN {p}_c1 c ON r.s_isrc = c.isrc WHERE r.s_isrc <> '' AND c.uri <> ''"),
        (p, f"SELECT x._id, {', '.join('x.' + c for c in FIELDS)}, 'isrc' AS method, "
            f"least(greatest({_score_expr(ts, as_)}, {floor!r}::DOUBLE), 1.0::DOUBLE) AS confidence "
            f"FROM {p}_j x{j}"),
    ]


def fuzzy_cands_ctes(p: str, rest: str, with_artist: bool, k: int | None = None) -> list[tuple[str, str]]:
    if with_artist:
        qcols = ["s_title", "s_first_artist"]
        where = "s_title <> '' OR s_first_artist <> ''"
        qsel = f"s_title, s_first_artist, {tokens_sql('s_title')} AS qt, {tokens_sql('s_first_artist')} AS qa"
        cond = "list_has_all(i.ct, q.qt) AND list_has_all(i.ca, q.qa) AND len(q.qt) + len(q.qa) > 0"
    else:
        qcols = ["s_title"]
        where = "s_title <> ''"
        qsel = f"s_title, {tokens_sql('s_title')} AS qt"
        cond = "list_has_all(i.ct, q.qt) AND len(q.qt) > 0"
    qc = ", ".join(f"q.{c}" for c in qcols)
    return [
        (f"{p}_q", f"SELECT DISTINCT {qsel} FROM {rest} WHERE {where}"),
        (f"{p}_c", f"SELECT * FROM (SELECT {qc}, {', '.join('i.' + c for c in FIELDS)}, i.c_name, i.c_artist, "
                   f"row_number() OVER (PARTITION BY {qc} ORDER BY i.popularity DESC, i.uri) AS rnk "
                   f"FROM {p}_q q JOIN idx i ON {cond}){f' WHERE rnk <= {k}' if k else ''}"),
        (f"{p}_pr", f"SELECT DISTINCT {', '.join(PROBE)} FROM {rest} WHERE {where}"),
    ], qcols


def fuzzy_scored_ctes(p: str, rest: str, with_artist: bool, metric="ratio", k: int | None = None,
                      bonus: float = 0.1) -> list[tuple[str, str]]:
    ctes, qcols = fuzzy_cands_ctes(p, rest, with_artist, k)
    j, ts, as_ = score_sql(metric)
    using = ", ".join(qcols)
    ctes += [
        (f"{p}_x", f"SELECT pr.*, {', '.join('c.' + c for c in FIELDS)}, c.c_name, c.c_artist, c.rnk, "
                   f"{close_sql('pr.s_duration', 'c.duration_ms')} AS dur_close "
                   f"FROM {p}_pr pr JOIN {p}_c c USING ({using})"),
        (f"{p}_s", f"SELECT x.*, {_score_expr(ts, as_)} AS score FROM {p}_x x{j}"),
        (f"{p}_e", f"SELECT *, least(score + CASE WHEN dur_close THEN {bonus!r}::DOUBLE ELSE 0.0::DOUBLE END, "
                   f"1.0::DOUBLE) AS eff FROM {p}_s"),
    ]
    return ctes


def fuzzy_pass_ctes(p: str, rest: str, with_artist: bool, threshold: float, metric="ratio",
                    k: int | None = None) -> list[tuple[str, str]]:
    ctes = fuzzy_scored_ctes(p, rest, with_artist, metric, k)
    sc = "eff" if with_artist else "score"
    method = "title_artist" if with_artist else "relaxed"
    probe = ", ".join(PROBE)
    ctes += [
        (f"{p}_b", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {probe} ORDER BY {sc} DESC, rnk) "
                   f"AS rb FROM {p}_e) WHERE rb = 1 AND {sc} >= {threshold!r}::DOUBLE AND uri <> ''"),
        (p, f"SELECT r._id, {', '.join('b.' + c for c in FIELDS)}, '{method}' AS method, b.{sc} AS confidence "
            f"FROM {rest} r JOIN {p}_b b USING ({probe})"),
    ]
    return ctes


def waterfall_ctes(src_view: str, pass3_threshold: float = 0.4, metric="ratio", **prep) -> list[tuple[str, str]]:
    """CTEs ending in ``wf`` (one row per source row)."""
    ctes = [r for r in INDEX_CTES]
    ctes.append(("w_r0", prepared_sql(src_view, **prep)))
    ctes += isrc_pass_ctes("w_p1", "w_r0", metric)
    ctes.append(("w_r1", "SELECT * FROM w_r0 WHERE _id NOT IN (SELECT _id FROM w_p1)"))
    ctes += fuzzy_pass_ctes("w_p2", "w_r1", True, 0.5, metric)
    ctes.append(("w_r2", "SELECT * FROM w_r1 WHERE _id NOT IN (SELECT _id FROM w_p2)"))
    ctes += fuzzy_pass_ctes("w_p3", "w_r2", False, pass3_threshold, metric)
    ctes.append(("w_r3", "SELECT * FROM w_r2 WHERE _id NOT IN (SELECT _id FROM w_p3)"))
    none = ("SELECT _id, '' AS catalog_id, '' AS uri, '' AS isrc, CAST(0 AS INT) AS duration_ms, false AS explicit, "
            "'' AS release_date, CAST(0 AS INT) AS popularity, '' AS album_type, CAST(0 AS INT) AS track_number, "
            "'' AS method, 0.0::DOUBLE AS confidence FROM w_r3")
    ctes.append(("wf", "SELECT * FROM w_p1 UNION ALL SELECT * FROM w_p2 UNION ALL SELECT * FROM w_p3 "
                       f"UNION ALL {none}"))
    return ctes
