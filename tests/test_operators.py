"""Operators that SQL cannot check, against loops; files; streams against their batch twins."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import backtest, bars, corpus
from tidemark.operators.metrics import loss_streak
from tidemark.sources import files
from tidemark.sources.tables import clock_bars, ticks
from tidemark.streaming import flows


@pytest.fixture(scope="module")
def some_bars(spark, data):
    return clock_bars(spark.read.parquet(f"{data}/events.parquet"))


def test_folds_match_a_loop(some_bars):
    got = bars.folded(some_bars).toPandas().sort_values(["symbol", "ts"])
    for _, g in got.groupby("symbol"):
        close = g.close.tolist()

        def ema(xs, n):
            out = [xs[0]]
            for x in xs[1:]:
                out.append(x * 2 / (n + 1) + out[-1] * (1 - 2 / (n + 1)))
            return np.array(out)

        assert np.allclose(g.ema_20, ema(close, 20))
        macd = ema(close, 12) - ema(close, 26)
        assert np.allclose(g.macd_histogram, macd - ema(macd.tolist(), 9)) or len(close) < 35


def test_sar_stays_beyond_the_bars(some_bars):
    rows = bars.parabolic_sar(some_bars).toPandas()
    both = rows.merge(some_bars.toPandas(), on=["symbol", "ts"]).sort_values(["symbol", "ts"]).groupby("symbol").tail(-2)
    assert ((both.trend == 1) & (both.sar <= both.high + 1e-9) | (both.trend == -1) & (both.sar >= both.low - 1e-9)).all()


def test_value_area_holds_the_share(spark, data):
    t = ticks(spark.read.parquet(f"{data}/events.parquet"))
    area = bars.volume_profile(t).toPandas().set_index("symbol")
    for symbol, g in t.toPandas().groupby("symbol"):
        price = (g.bid + g.ask) / 2
        width = (price.max() - price.min()) / 100
        inside = price.between(area.val[symbol] - width / 2 - 1e-6, area.vah[symbol] + width / 2 + 1e-6).mean()
        assert inside >= 0.7 and area.val[symbol] <= area.poc[symbol] <= area.vah[symbol]


def test_near_pass_matches_a_loop(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randint(0, 50)}" for _ in range(40)]
        for _ in range(rng.randint(1, 4)):
            texts.append(" ".join(words) + rng.choice(["", "", "!"]))
            words[rng.randrange(40)] = "new"
    rng.shuffle(texts)
    texts += [None, "", "  "]
    got = {r.doc_id: r.status for r in corpus.near_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    seen, index, want = set(), [], {}
    radius = round(0.15 * 64)
    for i, t in enumerate(texts):
        fp = X.simhash_of(t or "") % 2**64
        key = t or ""
        share = lambda a, b: any((a >> 16 * k) & 65535 == (b >> 16 * k) & 65535 for k in range(4))
        if key in seen:
            want[i] = "exact"
        elif any(share(fp, o) and (fp ^ o).bit_count() <= radius for o in index):
            want[i] = "near"
        else:
            want[i] = "kept"
            index.append(fp)
        seen.add(key)
    assert got == want


def test_family_split_isolates_and_fills(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    parts = corpus.family_split(docs, 0.2).join(docs.select("doc_id", X.prompt_family(F.col("text")).alias("f")), "doc_id").toPandas()
    assert parts.groupby("f").part.nunique().max() == 1
    share = (parts.part == "validation").mean()
    assert 0.15 < share < 0.45 and len(parts) == docs.count()


def test_streaks_with_zero(spark):
    rows = spark.createDataFrame([("a", i, p) for i, p in enumerate([-1.0, -1.0, 0.0, -1.0, 2.0, -3.0])], "k string, i long, profit double")
    assert loss_streak(rows, "k", ["i"]).first().max_loss_streak == 2
    assert loss_streak(rows, "k", ["i"], zero_resets=False).first().max_loss_streak == 3


def test_text_rules(spark):
    def one(column, **row):
        return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(column).first()[0]

    t = F.col("t")
    assert one(X.repaired(t), t="cafÃ©") == "café" and one(X.repaired(t), t="café") == "café"
    chat = "<bos>\n<user>\nWhat is two and two?\n</user>\n<assistant>\nFour.\n</assistant>\n<eos>"
    assert one(X.quality(t)["accepted"], t=chat)
    assert one(X.quality(t)["reasons"], t="<bos>\n<user>\nWhat is two and two?\n</user>\n<eos>") == ["missing_assistant", "unbalanced_assistant", "empty_chat_side"][:1] + ["empty_chat_side"]
    assert one(X.quality(t)["reasons"], t="word " * 100)[0] == "high_word_repetition"
    assert one(X.quality(t)["reasons"], t=None) == ["too_short"]
    assert one(X.prompt_family(t), t=chat) == "what is two and two"
    once = one(X.normalized(t, True), t=" Human: AI: hello<sep>you \r\n there ")
    assert once == "hello\n<sep>\nyou \n there" and one(X.normalized(t, True), t=once) == once
    assert one(X.escaped(t, ("<think>",)), t="<think><user>") == "<think>&lt;user&gt;"


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "human", "Human: What is 2 + 2?"), (1, 1, "gpt", "Assistant: 4"), (1, 2, "tool", "x"), (2, 0, "user", " ")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.text for r in corpus.conversation_texts(turns).collect()}
    assert got == {1: "<bos>\n<user>\nWhat is 2 + 2?\n</user>\n<assistant>\n4\n</assistant>\n<eos>", 2: ""}


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "one"}\nbroken{\n{"prompt": "p", "response": "r"}\n')
    (tmp_path / "b.json").write_text(json.dumps({"examples": [{"text": "x"}, {"text": "y"}]}))
    (tmp_path / "c.txt").write_text("short\n\n" + "a long paragraph " * 4 + "\n\n\nanother long paragraph of some forty characters")
    (tmp_path / ".d.json").write_text("{}")
    (tmp_path / "e.csv").write_text("time,open,high,low,close,volume\n2024-01-01 00:15:00,1,2,0,1.5,7\n2024.01.01 00:00,1,2,0,1,5\nbad,1,2,3\n1704068100,1,1,1,1,1\n")
    (tmp_path / "q.csv").write_text("2024-01-01 00:00:00,1.0,1.1\n2024-01-01 00:00:01,0,0\n")
    assert files.json_lines(spark, f"{tmp_path}/a.jsonl").count() == 2
    assert [r.text for r in files.json_examples(spark, f"{tmp_path}/b.json").collect()] == ["x", "y"]
    assert files.paragraphs(spark, f"{tmp_path}/c.txt").count() == 2
    assert sorted(r.path.rsplit("/")[-1] for r in files.discover(spark, str(tmp_path)).collect()) == ["a.jsonl", "b.json", "c.txt"]
    assert [r.volume for r in files.candles(spark, f"{tmp_path}/e.csv").collect()] == [5, 7, 1]
    assert [r["last"] for r in files.quotes(spark, f"{tmp_path}/q.csv").collect()] == [1.1]


def test_bar_stream_gives_the_batch_bars(spark, data, tmp_path, some_bars):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.select("event_id", "ts", "event_type", "value").write.parquet(f"{tmp_path}/in")
    stream = flows.bar_stream(spark.readStream.schema("event_id long, ts timestamp_ntz, event_type string, value double").parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("bars_out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    missing = some_bars.join(got, ["symbol", "ts"], "left_anti").count()
    assert got.join(some_bars, ["symbol", "ts", "open", "high", "low", "close", "volume"]).count() == got.count() > 0
    assert missing <= some_bars.groupBy("symbol").count().count() * 5


def test_tick_stream_drops_late_ticks(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 0, s), b, 1.0) for s, b in [(1, 10.0), (2, 11.0), (2, 99.0), (1, 99.0), (3, 10.5), (4, 10.5)]]
    spark.createDataFrame(rows, "symbol string, ts timestamp, bid double, volume double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = flows.tick_flow_stream(spark.readStream.schema("symbol string, ts timestamp, bid double, volume double").parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("ticks_out").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    r = spark.table("ticks_out").collect()[-1]
    assert (r.n_ticks, r.dropped, r.buy_volume, r.sell_volume) == (4, 2, 2.0, 2.0)


def test_paper_trades_close_on_the_stop_first(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [
        ("a", at(0), "open", 1, 1, 100.0, 95.0, 110.0, None, None),
        ("a", at(0), "open", 2, -1, 100.0, 105.0, 90.0, None, None),
        ("a", at(1), "bar", None, None, None, None, None, 104.0, 98.0),
        ("a", at(2), "bar", None, None, None, None, None, 111.0, 94.0),
    ]
    shape = "symbol string, ts timestamp, kind string, trade_id long, side int, entry double, stop double, target double, high double, low double"
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = flows.paper_trade_stream(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("trades_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.trade_id: r.outcome for r in spark.table("trades_out").collect()} == {1: -1.0, 2: -1.0}


def test_backtest_trades():
    close = np.array([10.0] * 6 + [11, 12, 13, 14, 15, 14, 12, 9, 8, 7], float)
    out = backtest.simulate(close + 0.1, close - 0.1, close, 2, 4, 0.05, 0.1)
    assert len(out) and set(np.round(out, 9)) <= {-0.05, 0.1} | set(np.round(out[-1:], 9))
    assert math.isclose(out[0], 0.1)


def test_entry_works_without_the_llm_package(spark, data, tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'corpus_index' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True, timeout=60)


def test_foundation_gate_looks_for_each_pattern_once(spark):
    """Counts are worked out once a text, not again in each condition and for score, verdict and reasons."""
    from pyspark.sql import functions as F

    from tidemark.functions import text

    rows = spark.createDataFrame([("An ordinary text of some words, long enough to be looked at in whole, as it has a stop.",)], "t string")
    column = text.foundation_quality(F.col("t"))
    plan = rows.select(column.alias("x"))._jdf.queryExecution().optimizedPlan()
    shown = str(plan.expressions().mkString("|"))
    assert shown.count("mathrm") == 1 and shown.count("www") == 1
    assert rows.select(column["accepted"].alias("a")).first().a


def test_sound_texts_do_not_go_to_python(spark):
    """Repair sends a Python function nulls for sound texts, as it is called for every row."""
    rows = spark.createDataFrame([(1, "cafÃ©"), (2, "sound"), (3, None), (4, "")], "i int, t string")
    found = rows.select("i", X.repaired(F.col("t")).alias("x"))
    assert {r.i: r.x for r in found.collect()} == {1: "café", 2: "sound", 3: None, 4: ""}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_decoded_again(CASE WHEN" in plan
