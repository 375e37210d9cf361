"""Curves, reports, scores, networks and exams against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import network as N
from tidemark.operators import exam as E
from tidemark.operators import monitor
from tidemark.operators.curves import curve
from tidemark.operators.features import rolling_z
from tidemark.plans.reports import monitor_report

T0 = dt.datetime(2024, 1, 1)


def plain_curve(profits, goal):
    equity = peak = fall = 0.0
    streak = longest = reached = 0
    for i, p in enumerate(profits, 1):
        equity += p
        reached = reached or (i if equity >= goal else 0)
        peak, fall = max(peak, equity), max(fall, max(peak, equity) - equity)
        streak = streak + 1 if p < 0 else 0 if p > 0 else streak
        longest = max(longest, streak)
    return len(profits), round(equity, 6), round(peak, 6), round(fall, 6), longest, reached


@pytest.mark.parametrize("goal", [-100.0, 0.5, 6.0, 1000.0])
def test_curves_folded_by_day(spark, goal):
    rng = random.Random(goal)
    rows = []
    for key in ("a", "b", None, "lost", "flat"):
        for i in range(rng.randint(1, 120)):
            profit = {"lost": -1.0, "flat": 0.0}.get(key, rng.choice([-2.0, -1.0, -1.0, 0.0, 1.0, 2.5]))
            rows.append((key, T0 + dt.timedelta(hours=rng.randint(0, 300)), i, profit))
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, n int, profit double").repartition(3)
    fields = ("n", "ending", "peak", "max_drawdown", "max_loss_streak", "trades_to_goal")
    got = {r.k: tuple(round(r[f], 6) for f in fields) for r in curve(df, ["k"], "ts", ["n"], goal).collect()}
    order = lambda r: (r[1], r[2])
    assert got == {k: plain_curve([r[3] for r in sorted(rows, key=order) if r[0] == k], goal) for k in got}
    rows = [(r[0] or "", *r[1:]) for r in rows]
    (whole,) = curve(spark.createDataFrame(rows, df.schema), [], "ts", ["n", "k"], goal).collect()
    assert tuple(round(whole[f], 6) for f in fields) == plain_curve([r[3] for r in sorted(rows, key=lambda r: (r[1], r[2], r[0]))], goal)


def test_report_of_an_empty_journal_and_of_repeats(spark):
    shape = "decided timestamp_ntz, symbol string, side int, bid double, ask double, target double, limit double, status string, most_favorable double, most_adverse double"
    row = (T0, "a", 1, 1.0, 1.01, 20.0, 10.0, "win", 25.0, 12.0)
    doc = monitor.report(spark.createDataFrame([row, row, (T0, None, -1, 1.0, 1.01, 20.0, 10.0, "loss", 1.0, 30.0), (T0, "a", -1, 1.0, 1.01, 20.0, 10.0, "pending", 0.0, 0.0)], shape)).first()
    assert (doc.counts.rows, doc.counts.resolved, doc.counts.pending, doc.counts.duplicates) == (4, 3, 1, 1)
    assert {b.bucket: b.summary.net for b in doc.buckets.by_symbol} == {"a": 50.0, "missing": -30.0}
    # the opposite of a win that was at 25 for it and at 12 against it loses 25, that of the loss wins 30
    assert doc.buckets["all"].inverse_net == -20.0 and doc.curve.ending == 20.0 and doc.inverse_curve.ending == -20.0
    doc = monitor.report(spark.createDataFrame([], shape)).first()
    assert doc.counts.rows == 0 and doc.curve is None and doc.buckets.by_side == []


def test_rolling_scores_are_those_of_a_buffer(spark):
    rng = random.Random(2)
    rows = [(s, T0 + dt.timedelta(minutes=37 * rng.randint(0, 400)), i, rng.choice([1.0, 2.0, rng.random()]), float(i % 3 == 0)) for i, s in enumerate("aaaabc" * 150)]
    got = {r.n: (r.x_z, r.y_z) for r in rolling_z(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, n int, x double, y double").repartition(4), ["x", "y"], "n", 7, block=20).collect()}
    want = {}
    for s in "abc":
        held, last = [], None
        for _, ts, n, x, y in sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2])):
            if ts != last:
                held, last = [*held, (x, y)][-7:], ts
            v = np.array(held)
            want[n] = tuple((np.array([x, y]) - v.mean(0)) / np.where(v.std(0) > 1e-12, v.std(0), 1.0))
    assert got.keys() == want.keys() and all(np.allclose(got[n], want[n], atol=1e-6) for n in want)


def plain_network(net, x):
    """One row, one layer after another."""
    leaky = lambda h: [v if v > 0 else 0.01 * v for v in h]
    times = lambda h, w, b: [sum(h[i] * w[i][j] for i in range(len(h))) + b[j] for j in range(len(b))]

    def normal(h):
        m = sum(h) / len(h)
        return [(v - m) / (sum((u - m) ** 2 for u in h) / len(h) + 1e-5) ** 0.5 for v in h]

    h = leaky(times(x, *net.layers[0]))
    hidden = net.layers[1:-1]
    while hidden:
        pair, hidden = hidden[:2], hidden[2:]
        g = h
        for layer in pair:
            g = leaky(times(normal(g), *layer))
        h = [0.5 * a + b for a, b in zip(g, h)] if len(pair) == 2 else g
    return times(normal(h), *net.layers[-1])[0]


@pytest.mark.parametrize("hidden", [0, 1, 2, 3])
def test_network_is_the_loop(spark, hidden):
    rng = np.random.default_rng(hidden)
    sizes = [6, *[5] * (hidden + 1), 1]
    net = N.Network([(rng.normal(size=s), rng.normal(size=s[1])) for s in zip(sizes, sizes[1:])], rng.normal(size=6), np.array([1.0, 2.0, 0.0, 1.0, 0.5, 1.0]))
    rows = [[float(v) for v in rng.normal(size=rng.integers(4, 9))] for _ in range(60)] + [[None, 1.0], [], None]
    df = spark.createDataFrame([(i, r, (i % 5) / 2 or None) for i, r in enumerate(rows)], "i int, v array<double>, fall double")
    for r in df.withColumn("e", N.explained(spark, net, F.col("v"), F.col("fall"), 3)).collect():
        if r.v is None:
            assert r.e is None
            continue
        x = np.zeros(6)
        x[: min(6, len(r.v))] = [v or 0.0 for v in r.v[:6]]
        z = (x - net.mean) / np.where(net.deviation > 0, net.deviation, 1.0)
        logit = plain_network(net, list(z))
        assert np.isclose(r.e.probability, 1 / (1 + np.exp(-logit)))
        bar = min(0.75, max(0.45, 0.55 + 0.1 * (r.fall or 0.0)))
        assert np.isclose(r.e.threshold, bar) and r.e.trade == (r.e.probability >= bar)
        order = sorted(range(6), key=lambda k: (-abs(z[k]), k))[:3]
        assert [t.feature for t in r.e.top] == order and np.allclose([t.z for t in r.e.top], z[order])
        k = order[0]
        up, down = (list(z[:k]) + [z[k] + d] + list(z[k + 1 :]) for d in (1e-5, -1e-5))
        assert np.isclose(r.e.top[0].share, (plain_network(net, up) - plain_network(net, down)) / 2e-5 * z[k], rtol=1e-2, atol=1e-3)


RIGHT = [
    ("12", {"number": "12"}, True), ("12.", {"number": "12"}, True), ("the answer is 12", {"number": "12"}, True), ("result = 12", {"number": "12"}, True),
    ("12 apples", {"number": "12", "units": ["apples"]}, True), ("12 pears", {"number": "12", "units": ["apples"]}, False), ("112", {"number": "12"}, False),
    ("7 plus 5 = 12", {"number": "12", "expression": "7 + 5"}, True), ("7 times 5 = 12", {"number": "12", "expression": "7 + 5"}, False), ("7+5=12", {"number": "12"}, False),
    ("demand rises and prices fall", {"all_terms": ["price", "demand"]}, True), ("demand rises", {"all_terms": ["price", "demand"]}, False),
    ("two policies and boxes", {"any_terms": ["policy"]}, True), ("apolicy", {"any_terms": ["policy"]}, False), ("supply side", {"any_terms": ["supply side", "x"]}, True),
    ("c++ is one", {"any_terms": ["c++"]}, True), ("anything", {}, False), ("price", {"any_terms": ["price"], "conceptual": True}, False),
    ("the price of it", {"any_terms": ["price"], "conceptual": True}, True), ("price", {"any_terms": ["price"], "flags": ["loop"]}, False), ("", {"any_terms": ["price"]}, False), (None, {"number": "1"}, False), ("x", {"any_terms": [""]}, False),
]


def test_answers_that_are_right(spark):
    names = ("flags", "number", "units", "expression", "conceptual", "all_terms", "any_terms")
    rows = [(i, a, *[q.get(n) for n in names]) for i, (a, q, _) in enumerate(RIGHT)]
    shape = "i int, answer string, flags array<string>, number string, units array<string>, expression string, conceptual boolean, all_terms array<string>, any_terms array<string>"
    got = {r.i: r.correct for r in E.correct(spark.createDataFrame(rows, shape)).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(RIGHT)}


def test_collapse(spark):
    rows = [("same", "one answer")] * 6 + [("same", f"other {i}") for i in range(5)] + [("alike", f"one two three four five {i}") for i in range(8)] + [("alike", f"x{i}") for i in range(7)]
    rows += [("fine", f"answer {i}") for i in range(9)] + [("fine", "")] + [("none", None), ("none", "")]
    got = {r.k: (r.answers, round(r.diversity, 3), r.most_same, r.most_alike, r.collapsed) for r in E.collapse(spark.createDataFrame(rows, "k string, answer string"), "k").collect()}
    assert got == {"same": (11, 54.545, 6, 6, True), "alike": (15, 100.0, 1, 8, True), "fine": (10, 100.0, 1, 1, False), "none": (2, 0.0, 2, 2, True)}


def test_report_reads_the_journal_once_written(spark, data):
    read = monitor_report(spark, data).inputFiles()
    assert read and not [f for f in read if f.endswith("events.parquet")]
