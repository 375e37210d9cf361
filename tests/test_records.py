"""Corner cases of records, chats and sequences that the tables do not hold."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import records as R
from tidemark.functions import text as X
from tidemark.operators import joins, sequences


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def pairs(messages):
    return [(m["role"], m["text"]) for m in messages]


def test_transcripts_with_escaped_line_ends(spark):
    text = "\\n\\nHuman: What is it?\\n\\nAssistant: A thing.\\nTwo lines.\\n\\nHuman: Thanks"
    assert pairs(one(spark, R.tidied(R.from_transcript(F.col("t"))), t=text)) == [("user", "What is it?"), ("assistant", "A thing.\nTwo lines."), ("user", "Thanks")]
    assert pairs(one(spark, R.from_transcript(F.col("t")), t="no marks at all")) == []
    assert pairs(one(spark, R.from_transcript(F.col("t")), t=None)) == []


def test_legacy_prompts_and_frames(spark):
    got = one(spark, R.split_legacy(F.col("t")), t="User: ask\r\nAssistant : first\nAssistant: second")
    assert (got["user"], got["assistant"]) == ("ask", "first\nAssistant: second")
    got = one(spark, R.split_legacy(F.col("t")), t="only a question")
    assert (got["user"], got["assistant"]) == ("only a question", "")
    framed = "below is an instruction that describes a task. Write a response that appropriately completes the request.\n### Instruction:\nDo it.\n### Response:"
    assert one(spark, R.clean_instruction(F.col("t")), t=framed) == "Do it."


def test_messages_lose_unknown_roles_blanks_and_repeats(spark):
    rows = spark.sql("SELECT array(named_struct('role', 'GPT ', 'text', 'a'), named_struct('role', 'ai', 'text', 'a'), named_struct('role', 'tool', 'text', 'x'), named_struct('role', 'Human', 'text', ' '), named_struct('role', cast(null as string), 'text', 'y'), named_struct('role', 'human', 'text', 'b')) AS m")
    assert pairs(rows.select(R.tidied(F.col("m")).alias("x")).first()["x"]) == [("assistant", "a"), ("user", "b")]


def test_records_of_several_shapes(spark):
    def read(sql):
        rows = spark.sql(sql)
        return pairs(rows.select(R.record_messages(dict(rows.dtypes), {"conversations": ["from", "value"]}).alias("x")).first()["x"])

    assert read("SELECT 'q' AS input, 'r' AS answer, 'better' AS teacher_response") == [("user", "q"), ("assistant", "r"), ("assistant", "better")]
    assert read("SELECT 'Human: a\n\nAssistant: b' AS prompt, '' AS output, 'c' AS solution") == [("user", "a"), ("assistant", "c")]
    assert read("SELECT array(named_struct('from', 'human', 'value', 'h'), named_struct('from', 'gpt', 'value', 'g')) AS conversations, 'left out' AS text") == [("user", "h"), ("assistant", "g")]
    assert read("SELECT '\n\nHuman: x\n\nAssistant: y' AS chosen") == [("user", "x"), ("assistant", "y")]
    assert read("SELECT '  a text ' AS text") == [("document", "a text")]
    assert read("SELECT cast(null as string) AS text, 7 AS other") == []
    assert R.column_pair(["output", "answer", "question", "input"]) == ("question", "answer") and R.column_pair(["text"]) is None


@pytest.mark.parametrize(("body", "context", "most"), [(0, 5, 20), (3, 0, 20), (40, 5, 20), (41, 100, 20), (12, 5, 20), (11, 5, 20), (13, 5, 20)])
def test_chunks_match_a_loop(spark, body, context, most):
    prefix, start, want = min(context, most - 7) + 2, 0, []
    inner, final = most - prefix, most - prefix - 2
    while body - start > final:
        take = min(inner, body - start - final)
        want.append((start, take, prefix + take))
        start += take
    want.append((start, body - start, prefix + body - start + 2))
    got = spark.range(1).select(R.chunks(F.lit(body), F.lit(context), most).alias("x")).first()["x"]
    assert [(c["start"], c["n"], c["total"]) for c in got] == want and all(c["total"] <= most for c in got)


def test_starts_do_not_depend_on_runs(spark):
    docs = spark.createDataFrame([(i * 7 - 50, i % 5) for i in range(40)], "doc_id long, n long")
    got = {r.doc_id: r.start for r in sequences.starts(docs, span=10).collect()}
    total = 0
    for i in range(40):
        assert got[i * 7 - 50] == total
        total += i % 5


def test_nearest_gap_of_many_prices(spark):
    gaps = spark.createDataFrame([("a", float(t), float(t) - 2) for t in (3, 11, 30)] + [("b", 1.0, 1.0)], "symbol string, top double, bottom double")
    prices = spark.createDataFrame([("a", x / 2) for x in range(80)] + [("b", 5.0), ("c", 1.0)], "symbol string, price double")
    got = {(r.symbol, r.price): (r.middle, r.distance) for r in joins.nearest_gap(prices, gaps).collect()}
    assert len(got) == 81 and got["b", 5.0] == (1.0, 4.0)
    for x in range(80):
        p = x / 2
        assert got["a", p] == min(((m, abs(p - m)) for m in (2.0, 10.0, 29.0)), key=lambda y: (y[1], y[0]))


@pytest.mark.parametrize("text", ["", " \t\r\n\x0b\x0c", " a \r\nb\r\rc ", "Human : user:\n x", "uSeR:AI: assistant", "human", "a>\n\n<b>\n\n<c", "x\x00y\n", "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\nx ### Response: ", "Human: q\nassistant : a\nAssistant: b", "ASSISTANT: only", "Systems: x"])
def test_plain_forms_do_what_the_patterns_did(spark, text):
    """Trimming, line ends, roles and frames by the patterns alone, in Python."""
    blank = "[ \t\n\x0b\x0c\r]"
    role = lambda t: re.sub(rf"(?i)^(?:{blank}*(?:Human|User|Assistant|AI|System){blank}*:{blank}*)+", "", t)
    trim = lambda t: re.sub(rf"\A{blank}+|{blank}+\Z", "", t)
    ends = lambda t: re.sub("\r\n?", "\n", t.replace("\x00", ""))
    normal = lambda t: role(re.sub("(?<=>)\n\n(?=<)", "\n", trim(ends(t))))
    clean = lambda t: trim(re.sub(R.FRAME_END.replace("$", r"\Z"), "", re.sub(R.FRAME, "", normal(t))))
    got = spark.createDataFrame([(text,)], "t string").select(X.normalized(F.col("t"), True).alias("n"), R.clean_instruction(F.col("t")).alias("c"), R.split_legacy(F.col("t")).alias("s")).first()
    assert (got.n, got.c) == (normal(text), clean(text))
    said = re.sub(rf"(?i)^{blank}*(?:Human|User){blank}*:{blank}*", "", trim(re.sub("\r\n?", "\n", text)))
    parts = [*re.split(rf"(?i)(?:^|\n){blank}*Assistant{blank}*:{blank}*", said, maxsplit=1), ""]
    assert (got.s.user, got.s.assistant) == (clean(parts[0]), normal(parts[1]))
