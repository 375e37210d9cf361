"""Embedded objects and the load-all scan, beyond what the tables hold."""

import ast
import json
import random

import duckdb
from pyspark.sql import functions as F

from tidemark import queries as core
from tidemark.functions import objects as O
from tidemark.sources import files


def values(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [None if r.v is None else json.loads(r.v) for r in rows.select("i", F.to_json(O.embedded(F.col("t"))).alias("v")).orderBy("i").collect()]


def test_python_literals_are_read_as_python_does(spark):
    rng = random.Random(4)
    bits = ["'", '"', "\\", "\n", "é日", "True", "(x,)", ", }", "a", " ", "\t", "\x07", "{'a': 1}", "'it'"]

    def some(depth=0):
        kind = rng.randint(0, 7 if depth < 3 else 4)
        if kind < 2:
            return "".join(rng.choice(bits) for _ in range(rng.randint(0, 5)))
        if kind < 5:
            return rng.choice([True, False, None, 12, -3, 0.5])
        if kind == 5:
            return {f"k{i}": some(depth + 1) for i in range(rng.randint(0, 3))}
        return [some(depth + 1) for _ in range(rng.randint(0, 3))]

    made = [{"x": some()} if i % 2 else [some(), some()] for i in range(300)]
    texts = [repr(x) for x in made]
    assert all(ast.literal_eval(t) == x for t, x in zip(texts, made))
    assert values(spark, texts) == made
    assert values(spark, [json.dumps(x) for x in made]) == made


def test_what_is_no_object(spark):
    texts = [None, "", "  ", "plain", "{'a': 'b", "{'a': 'x' 'y'}", "{1, 2}", "{'a': ﷐}", "{'a': 1} and more", "(1, 2,)", " [1] "]
    assert values(spark, texts) == [None] * 9 + [[1, 2], [1]]
    long = "{'a': '" + "x\\'y\\\\ " * 50_000 + "'}"
    assert values(spark, [long]) == [ast.literal_eval(long)]


def messages(spark, rows, schema, fields=None):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    got = d.select("i", O.record_messages(dict(d.drop("i").dtypes), fields or {}).alias("m")).orderBy("i").collect()
    return [[(m.role, m.text) for m in r.m] for r in got]


def test_records_in_prompts(spark):
    rows = [
        ("{'instruction': 'Do it', 'input': 'with care', 'output': 'done'}", None),
        ('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}', "more"),
        ('{"role": "user", "content": "q"}\n\n {\'role\': \'gpt\', \'content\': \'a\'} ', "a"),
        ('{"role": "user", "content": "q"}\nno object', "answer"),
        ("[1, 2]", "answer"),
        ('{"nothing": "known"}', "answer"),
        ("{'chosen': '\\n\\nHuman: hi\\n\\nAssistant: hello'}", None),
    ]
    assert messages(spark, rows, "prompt string, response string") == [
        [("user", "Do it\n\nwith care"), ("assistant", "done")],
        [("user", "q"), ("assistant", "a"), ("assistant", "more")],
        [("user", "q"), ("assistant", "a")],
        [("user", '{"role": "user", "content": "q"}\nno object'), ("assistant", "answer")],
        [("user", "[1, 2]"), ("assistant", "answer")],
        [("user", '{"nothing": "known"}'), ("assistant", "answer")],
        [("user", "hi"), ("assistant", "hello")],
    ]


def test_load_all(spark, tmp_path):
    ask = lambda q: {"question": q, "answer": "a long enough answer"}
    wanted = lambda q: f"<bos>\n<user>\n{q}\n</user>\n<assistant>\na long enough answer\n</assistant>\n<eos>"
    (tmp_path / "b").mkdir()
    (tmp_path / "b/list.json").write_text(json.dumps([ask("one"), {"other": 1}, ask("two")]))
    (tmp_path / "a.json").write_text(json.dumps({"data": [ask("three"), ask("two")]}))
    (tmp_path / "master_index.json").write_text(json.dumps([ask("never")]))
    (tmp_path / "x.jsonl").write_text("\n".join([json.dumps(ask("four")), "{broken", "", json.dumps(ask("one")), '{"text": "some plain text here"}']))
    (tmp_path / "y.txt").write_text("short\n\nA paragraph that is long enough\nin two lines\n\n\n\nAnother paragraph, long enough too\n\nshort")
    (tmp_path / "z.csv").write_text("question,answer\nfive,no")
    got = [r.text for r in files.load_all(spark, str(tmp_path)).orderBy("at").collect()]
    paragraphs = ["A paragraph that is long enough\nin two lines", "Another paragraph, long enough too"]
    assert got == [*map(wanted, ("three", "two", "one", "four")), "<bos>\nsome plain text here\n<eos>", *(f"<bos>\n{p}\n<eos>" for p in paragraphs)]
    mixed = [r.text for r in files.load_all(spark, str(tmp_path), seed=7, most=4).collect()]
    assert len(mixed) == 4 and set(mixed) < set(got) and mixed == [r.text for r in files.load_all(spark, str(tmp_path), seed=7).limit(4).collect()]
    assert files.load_all(spark, f"{tmp_path}/none").collect() == []
    (tmp_path / "empty").mkdir()
    assert files.load_all(spark, f"{tmp_path}/empty").collect() == []


def test_texts_of_records_are_worked_out_once(spark):
    """The length is not looked at in a filter that holds the whole expression a second time."""
    rows = spark.createDataFrame([(1, "Human: a question\n### Response: ", "an answer that is long enough"), (2, "", "no")], "at int, question string, answer string")
    found = files.record_texts(rows)
    assert [(r.at, r.text) for r in found.collect()] == [(1, "<bos>\n<user>\na question\n</user>\n<assistant>\nan answer that is long enough\n</assistant>\n<eos>")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("&lt;think&gt;") == 1


def test_objects_are_parsed_once(spark):
    """Every name of a record is read from one parsed value, also where it is a Python literal."""
    rows = spark.createDataFrame([("{'instruction': 'a \\x41', 'output': 'b'}",), ('{"prompt": "p", "response": "r"}',), ("no object",), (None,)], "t string")
    found = rows.select(O.record(O.embedded(F.col("t"))).alias("r"))
    assert [r.r and tuple(r.r[n] for n in ("instruction", "output", "prompt", "response")) for r in found.collect()] == [("a A", "b", None, None), (None, None, "p", "r"), None, None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= 2


def test_documents_without_a_text_are_loaded_as_in_the_sql(spark, tmp_path):
    """Their questions are blank, and what answers them stays."""
    rows = [(0, "a text", "src0"), (1, "", "src1"), (2, None, "src2"), (3, " \n\n ", "src3"), (None, "of a row that has no id, long enough to be a text", "src4"), (5, "one part that is long enough\n\n\nand another that is", "src5")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = core.QUERIES["load_all_texts"](spark, str(tmp_path)).collect()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert sorted(tuple(r) for r in got) == sorted(con.sql(core.ORACLE["load_all_texts"]).fetchall())
