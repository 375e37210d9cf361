"""Records of many shapes to chat messages: arrays of (role, text), as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import text as X

# Names of roles, column pairs in order of preference, first-present keys, an instruction frame.
ROLES = {"human": "user", "user": "user", "assistant": "assistant", "ai": "assistant", "gpt": "assistant", "model": "assistant", "system": "system"}
COLUMN_PAIRS = (("prompt", "response"), ("instruction", "output"), ("question", "answer"), ("input", "output"))
ANSWERS = ("output", "response", "answer", "solution")
QUESTIONS = ("prompt", "question", "problem", "query")
FRAME = r"(?i)^Below is an instruction that describes a task\.\s*Write a response that appropriately completes the request\.\s*### Instruction:\s*"
FRAME_END = r"(?i)\s*### Response:\s*$"

# Words that tell of the training stage a text belongs to.
STRONG_TRADING = (
    "xauusd|eurusd|gbpusd|usdjpy|usdchf|audusd|nzdusd|candlestick|candlesticks|slippage|stop loss|stop-loss|take profit|"
    "risk reward|risk-reward|position size|lot size|leverage|margin call|pip|pips|order flow|orderflow|rsi|atr|macd|"
    "bid[- ]ask|bid ask|long position|short position|broker|spread"
)
CONTEXT_TRADING = (
    "forex|fx|trading|trader|trade|bullish|bearish|liquidity|support|resistance|breakout|retest|volatility|drawdown|"
    "timeframe|higher timeframe|lower timeframe|entry|exit|execution|moving average|ema|sma|price action|risk management"
)
MATH = (
    "solve|calculate|equation|probability|percentage|percent|ratio|mean|median|variance|standard deviation|integral|"
    "derivative|formula|arithmetic|algebra|geometry|statistics"
)


trimmed = X.trimmed


def clean_instruction(text: Column) -> Column:
    """An instruction without its frame and without a role before it."""
    framed = lambda t: t.contains("### ")
    return trimmed(X.let(X.normalized(text, True), lambda t: F.when(framed(t), F.regexp_replace(F.regexp_replace(t, FRAME, ""), FRAME_END, "")).otherwise(t)))


def split_legacy(text: Column) -> Column:
    """(user, assistant) of one string in which a line that begins with "Assistant:" starts the answer; no such line: no answer."""
    text = trimmed(X.one_line_end(F.coalesce(text, F.lit(""))))
    # The patterns of who speaks, here and in from_transcript.
    text = X.without_head(text, r"(?i)^\s*(?:Human|User)\s*:\s*", "Human|User")
    parts = X.let(text, lambda t: F.when(F.lower(t).contains("assistant"), F.split(t, r"(?i)(?:^|\n)\s*Assistant\s*:\s*", 2)).otherwise(F.array(t)))
    answer = lambda p: F.when(F.size(p) > 1, X.normalized(F.get(p, F.lit(1)), True)).otherwise("")
    return X.let(parts, lambda p: F.struct(clean_instruction(F.get(p, F.lit(0))).alias("user"), answer(p).alias("assistant")))


def message(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def tidied(messages: Column) -> Column:
    """Messages with roles by their common names and clean texts, without blank ones, unknown roles, and repeats in a row."""
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])

    def clean(m: Column) -> Column:
        role = F.lower(trimmed(F.coalesce(m["role"], F.lit(""))))
        asked = role.isin("human", "user")
        return message(F.element_at(names, role), F.when(asked, clean_instruction(m["text"])).otherwise(X.normalized(m["text"], True)))

    real = F.filter(F.transform(messages, clean), lambda m: m["role"].isNotNull() & (m["text"] != ""))
    once = lambda found: F.filter(found, lambda m, i: (i == 0) | (m != F.get(found, i - 1)))
    return F.get(F.transform(F.array(real), once), F.lit(0))


def from_turns(turns: Column, fields: list[str]) -> Column:
    """Messages of an array of structs that name their parts from/value or role/content; fields: the struct's."""
    pick = lambda t, names: F.coalesce(*[t[n].cast("string") for n in names if n in fields], F.lit(None).cast("string"))
    return F.transform(turns, lambda t: message(pick(t, ("from", "role")), pick(t, ("value", "content"))))


def from_dialogue(texts: Column) -> Column:
    """Messages of an array of strings that take turns, the user first; blank ones count for the turn but do not stay.

    A last one by the user goes; fewer than two that are not blank give none.
    """
    turns = F.transform(texts, lambda x, i: message(F.when(i % 2 == 0, "user").otherwise("assistant"), x))
    real = F.filter(turns, lambda m: trimmed(F.coalesce(m["text"], F.lit(""))) != "")
    cut = lambda m: F.when(F.size(m) < 2, F.slice(m, 1, 0)).when(F.element_at(m, -1)["role"] == "user", F.slice(m, 1, F.size(m) - 1)).otherwise(m)
    return F.get(F.transform(F.array(real), cut), F.lit(0))


def from_transcript(text: Column) -> Column:
    """Messages of a text with marks "Human:" and "Assistant:" at its start or after a blank line."""
    text = trimmed(F.coalesce(text, F.lit("")))
    text = F.when(text.contains("\\n\\nHuman:") & ~text.contains("\n\nHuman:"), F.replace(text, F.lit("\\n"), F.lit("\n"))).otherwise(text)
    parts = F.split(text, r"(?i)(?:^|\n\n)(?=(?:Human|Assistant):)")
    marked = F.filter(parts, lambda p: p.rlike(r"(?i)^(?:Human|Assistant):"))
    return F.transform(marked, lambda p: message(F.lower(F.regexp_extract(p, "^([A-Za-z]+):", 1)), F.regexp_replace(p, r"^[A-Za-z]+:\s*", "")))


def column_pair(columns: list[str]) -> tuple[str, str] | None:
    """The first known pair of a prompt's and an answer's column that are both there."""
    return next((p for p in COLUMN_PAIRS if p[0] in columns and p[1] in columns), None)


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def first_present(columns: list[str], names: tuple[str, ...], of: Callable[[str], Column] = _column) -> Column:
    return F.coalesce(*[F.nullif(of(n).cast("string"), F.lit("")) for n in names if n in columns], F.lit(None).cast("string"))


def record_messages(types: dict[str, str], fields: dict[str, list[str]], of: Callable[[str], Column] = _column, plain_text: bool = True) -> Column:
    """Messages of a record with any of the known columns, in this order: chosen or rejected transcript, content, messages,
    conversations, instruction (and input) with its answer, else question with its answer, teacher_response; else (with
    plain_text) text as a document.

    types: the record's columns and their types; fields: names in the structs of its array columns; of: the column of a name.
    """
    columns = list(types)
    first = lambda *names: first_present(columns, names, of)
    none = F.array().cast("array<struct<role:string,text:string>>")
    parts = []
    if "chosen" in columns or "rejected" in columns:
        parts.append(from_transcript(first("chosen", "rejected")))
    for name in ("content", "messages", "conversations"):
        if types.get(name, "").startswith("array"):
            parts.append(F.coalesce(from_turns(of(name), fields[name]), none))
    answer = first(*ANSWERS)
    instruction, extra = first("instruction"), X.normalized(first("input"), True)
    told = F.struct(clean_instruction(instruction).alias("told"), extra.alias("extra"))
    asked = X.let(told, lambda p: F.when(p["extra"] != "", F.concat(p["told"], F.lit("\n\n"), p["extra"])).otherwise(p["told"]))
    framed = F.array(message(F.lit("user"), asked), message(F.lit("assistant"), answer))
    parts_of = F.struct(split_legacy(first(*QUESTIONS, "input")).alias("legacy"), X.normalized(answer, True).alias("reply"))
    replied = lambda p: F.when(p["reply"] != "", p["reply"]).otherwise(p["legacy"]["assistant"])
    plain = X.let(parts_of, lambda p: F.array(message(F.lit("user"), p["legacy"]["user"]), message(F.lit("assistant"), replied(p))))
    has_question = first(*QUESTIONS, "input").isNotNull()
    parts.append(F.when(instruction.isNotNull(), framed).when(answer.isNotNull() & has_question, plain).otherwise(none))
    parts.append(F.array(message(F.lit("assistant"), first("teacher_response"))))
    found = tidied(F.concat(*parts))
    if not plain_text:
        return found
    document = X.let(X.normalized(first("text"), True), lambda t: F.when(t != "", F.array(message(F.lit("document"), t))).otherwise(none))
    return F.get(F.transform(F.array(found), lambda m: F.when(F.size(m) > 0, m).otherwise(document)), F.lit(0))


def document_text(text: Column) -> Column:
    """A document as canonical text; a blank one gives ""."""
    return X.let(X.normalized(X.escaped(text)), lambda body: F.when(body == "", "").otherwise(F.concat(F.lit("<bos>\n"), body, F.lit("\n<eos>"))))


def is_reasoning(text: Column) -> Column:
    return text.contains("<think>") & text.contains("</think>")


def is_math(text: Column) -> Column:
    return text.rlike(rf"(?i)\b(?:{MATH})\b|[=+*/^]")


def trading_evidence(text: Column) -> Column:
    """3 for a mark or a strong term, else the number of different context terms."""
    hits = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)(\b(?:{CONTEXT_TRADING})\b)"), F.lit(1)), F.lower))
    strong = text.contains("<market>") | text.contains("<decision>") | text.rlike(rf"(?i)\b(?:{STRONG_TRADING})\b")
    return F.when(strong, 3).otherwise(F.size(hits))


def chunks(body: Column, context: Column, most: int) -> Column:
    """Chunks (start, n, total) of an assistant's turn of `body` tokens after a prompt of `context` tokens, `most` tokens each.

    Each chunk repeats the begin mark, the prompt (its last most - 7 tokens at most) and the assistant mark;
    the last one also has two end marks. No token of the turn is in two chunks; an empty turn is one.
    """
    prefix = F.least(context, F.lit(most - 7)) + 2
    inner, final = most - prefix, most - prefix - 2
    many = F.greatest(F.lit(0), F.ceil((body - final) / inner)).cast("int")

    def chunk(i: Column) -> Column:
        start = F.when(i < many, i * inner).otherwise(F.greatest(F.lit(0), body - final))
        n = F.when(i < many, F.least(inner, body - final - i * inner)).otherwise(F.least(body, final))
        total = prefix + n + F.when(i < many, 0).otherwise(2)
        return F.struct(i.alias("chunk"), start.cast("int").alias("start"), n.cast("int").alias("n"), total.cast("int").alias("total"))

    return F.transform(F.sequence(F.lit(0), many), chunk)


def compact(text: Column) -> Column:
    """The text in lower case, without white space."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


def repeated_grams(packed: Column, n: int = 4, least: int = 12) -> Column:
    """Share of a compact text's runs of n characters that occurred before in it; 0 below `least` characters."""
    grams = F.when(F.length(packed) >= least, F.transform(F.sequence(F.lit(1), F.length(packed) - n + 1), lambda i: F.substring(packed, i, F.lit(n))))
    share = lambda g: 1 - F.size(F.array_distinct(g)) / F.size(g)
    return F.coalesce(F.get(F.transform(F.array(grams), share), F.lit(0)), F.lit(0.0))


def period_share(packed: Column, widest: int = 12, least: int = 16) -> Column:
    """The greatest share of a compact text's characters that equal the one some width before; 0 below `least` characters."""
    chars = F.split(packed, "")

    def best(chars: Column) -> Column:
        width = F.sequence(F.lit(1), F.least(F.lit(widest), F.floor(F.size(chars) / 3).cast("int")))
        same = lambda w: F.size(F.filter(F.zip_with(F.slice(chars, w + 1, F.size(chars) - w), F.slice(chars, 1, F.size(chars) - w), lambda x, y: x == y), lambda x: x))
        return F.array_max(F.transform(width, lambda w: same(w) / (F.size(chars) - w)))

    return F.when(F.length(packed) >= least, F.get(F.transform(F.array(chars), best), F.lit(0))).otherwise(0.0)
