"""Tunable parameters and fixed values.

``MatchConfig`` carries the matcher's weights and thresholds; the defaults are
the values the resolved results must agree with.  Scale knobs (hot-block
threshold, per-task target) only change how work is spread, never results.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference behaviour for identical results).
# Score weights: title 0.45, artist 0.40, duration 0.15; a duration that is not
# close counts 0.5 of its weight.  Pass-2 bonus 0.1 for a close duration, score
# capped at 1.0.  Pass thresholds: title+artist 0.5 (on the bonus score),
# relaxed 0.4 (raw score).  Exact-id confidence is clamped to [0.95, 1.0].
# Duration tolerance 5 seconds, inclusive.  Search depth 10 candidates, exact
# id search depth 1.  Target write batch 100, lookup batch 50.  Listen tags: 5.
# Method names: isrc, title_artist, relaxed; cache default method: cached.
# ---------------------------------------------------------------------------
W_TITLE = 0.45
W_ARTIST = 0.40
W_DURATION = 0.15
DURATION_MISS_FACTOR = 0.5
PASS2_BONUS = 0.1
PASS2_THRESHOLD = 0.5
PASS3_THRESHOLD = 0.4
ISRC_CONF_FLOOR = 0.95
DURATION_TOLERANCE_SEC = 5.0
SEARCH_LIMIT = 10
TARGET_BATCH = 100
MAX_TAGS = 5
METHOD_ISRC = "isrc"
METHOD_TITLE_ARTIST = "title_artist"
METHOD_RELAXED = "relaxed"


@dataclass(frozen=True)
class MatchConfig:
    """Weights, thresholds and scale knobs for the resolver."""

    w_title: float = W_TITLE
    w_artist: float = W_ARTIST
    w_duration: float = W_DURATION
    duration_miss_factor: float = DURATION_MISS_FACTOR
    pass2_bonus: float = PASS2_BONUS
    pass2_threshold: float = PASS2_THRESHOLD
    pass3_threshold: float = PASS3_THRESHOLD
    isrc_conf_floor: float = ISRC_CONF_FLOOR
    duration_tolerance_sec: float = DURATION_TOLERANCE_SEC
    # Candidates *listed* per query: all of them (None), or the most popular
    # ones where a top-k is what is asked for (SEARCH_LIMIT).  The resolver's
    # arg-max always is over all of them.
    max_candidates: int | None = None
    # "ratio" = Ratcliff/Obershelp (parity); "levenshtein" = JVM-native metric.
    metric: str = "ratio"
    # Scale knobs: a block key whose posting list exceeds ``hot_block_rows``
    # is refined to a key pair; postings of big blocks are salted so that no
    # task handles more than ~``rows_per_task`` of them.
    hot_block_rows: int = 1_000_000
    rows_per_task: int = 250_000
    # Up to so many (probe, class) pairs are scored in one round; beyond, classes
    # are visited by falling bound (same results, fewer pairs, more stages).
    pairs_at_once: int = 1 << 18
    # Drop candidates whose best possible score is below the pass threshold
    # before any Python runs (lossless: ratio <= 2*min(la,lb)/(la+lb)).
    prune_by_length_bound: bool = True

    def with_(self, **kw) -> "MatchConfig":
        return replace(self, **kw)
