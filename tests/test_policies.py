"""Policies against a loop over rows, the gate's reasons, and stops that never fall back."""

import random

from pyspark.sql import functions as F

from tidemark.operators import policies as P

SHAPE = "i int, estimate double, consistency double, pullback double, quality boolean, reason string, profit double"


def rows(n, seed=1):
    rng = random.Random(seed)
    some = lambda *xs: rng.choice(xs)
    return [(i, some(None, 0.0, 0.03, 0.06, 0.2, -1.0), some(None, 0.5, 0.55, 0.7, 0.9), some(None, 0.2, 0.35, 0.6, 1.0, 1.2), some(None, True, False), some(None, "a", "b", " a ", ""), some(-2.0, 1.0, 0.0, 3.0)) for i in range(n)]


def takes(policy, r):
    _, estimate, consistency, pullback, quality, reason, _ = r
    return (
        (estimate or 0.0) >= policy.least_profit and (consistency or 0.0) >= policy.least_consistency and (pullback or 0.0) <= policy.most_pullback
        and (not policy.quality or bool(quality)) and (policy.reason is None or (reason or "").strip() == policy.reason)
    )


def test_grid_is_the_loop(spark):
    given = rows(300)
    got = {P.Policy(*r[:6]): tuple(r[6:]) for r in P.grid(spark.createDataFrame(given, SHAPE)).collect()}
    assert len(got) == 5 * 5 * 5 * 2 * 2 * 3 and {p.reason for p in got} == {None, "a", "b"}
    for policy, (taken, wins, net, won, lost, factor) in got.items():
        own = [-r[6] if policy.inverted else r[6] for r in given if takes(policy, r)]
        up, down = sum(x for x in own if x > 0), -sum(x for x in own if x < 0)
        assert (taken, wins, net, won, lost) == (len(own), sum(x > 0 for x in own), up - down, up, down)
        assert factor == (up / down if down else 999.0 if up else 0.0)
    best = P.best(P.grid(spark.createDataFrame(given, SHAPE)), 10)
    assert got[best][5] == max(v[5] for v in got.values() if v[0] >= 10)
    assert P.best(P.grid(spark.createDataFrame([], SHAPE)), 1) is None


def test_gate(spark):
    given = rows(60, 2)
    frame = spark.createDataFrame(given, SHAPE)
    policy = P.Policy(0.03, 0.55, 0.65, True, "a", True)
    for column, want in (
        (P.gate(False, policy), "shadow_policy_disabled"), (P.gate(True, None), "shadow_policy_missing"), (P.gate(True, policy, False, "too few"), "too few"),
        (P.gate(True, policy), "shadow_policy_inversion_requires_review"),
    ):
        assert {r.g for r in frame.select(column.alias("g")).collect()} == {want}
    got = {r.i: r.g for r in frame.select("i", P.gate(True, policy, invert=True).alias("g")).collect()}
    assert got == {r[0]: "shadow_policy_ok" if takes(policy, r) else "shadow_policy_feature_reject" for r in given} and len(set(got.values())) == 2


def test_stops_never_fall_back(spark):
    given = [("a", k, c) for k, c in enumerate([5.0, 4.0, 0.0, 6.0, None, 5.5, 7.0])]
    frame = spark.createDataFrame(given, "symbol string, ts int, candidate double").withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    got = {s: [(r.allowed, r.stop) for r in P.held_stop(frame).where(f"side = {s}").orderBy("ts").collect()] for s in (1, -1)}
    assert got[1] == [(True, 5.0), (False, 5.0), (False, 5.0), (True, 6.0), (False, 6.0), (False, 6.0), (True, 7.0)]
    assert got[-1] == [(True, 5.0), (True, 4.0), (False, 4.0), (False, 4.0), (False, 4.0), (False, 4.0), (False, 4.0)]
