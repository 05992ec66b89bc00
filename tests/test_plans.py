"""Physical-plan properties of the resolver and the sync plan."""

import pytest

import __spark_entry__ as E
import concordia.session as S

SF001 = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture()
def captured(monkeypatch):
    plans = []
    orig = S.cut_lineage

    def spy(df, name="stage", path=None):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return orig(df, name, path)

    import concordia.operators.candidates as CC
    import concordia.operators.classes as CL
    import concordia.operators.keys as KK
    import concordia.operators.match as M
    import concordia.plans.sync as PS
    for mod in (S, M, CC, CL, KK, PS):
        monkeypatch.setattr(mod, "cut_lineage", spy)
    return plans


@pytest.mark.parametrize("name", ["q_match_waterfall", "q_change_batches", "q_sync_enriched"])
def test_no_cross_products_and_bounded_python(spark, captured, name):
    df = E.queries()[name](spark, SF001)
    final = df._jdf.queryExecution().executedPlan().toString()
    stages = captured + [("final", final)]
    assert len(stages) > 3
    for stage, plan in stages:
        for bad in FORBIDDEN:
            assert bad not in plan, (stage, bad)
        # the Python helpers run at most once per side in any one stage
        assert plan.count("ArrowEvalPython") <= 2, stage


def test_top_k_is_partial_before_shuffle(spark, captured):
    E.queries()["q_candidates_topk"](spark, SF001)
    cand = [p for n, p in captured if n == "candidates"]
    assert cand and all("WindowGroupLimit" in p and "Partial" in p for p in cand)


def test_last_wins_dedupe_limits_before_shuffle(spark):
    plan = E.queries()["q_dedupe_last_wins"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    partial = [i for i, line in enumerate(lines) if "WindowGroupLimit" in line and "Partial" in line]
    exchange = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(fingerprint" in line]
    assert partial and exchange and min(partial) > min(exchange)  # printed below = runs before
