"""Objects that stand in a text, as JSON or as Python literals, by way of VARIANT; and records that hold such texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import records as R
from tidemark.functions.text import let

#: The names that a record may have, and the types they are read as.
TURN = "array<struct<role:string,content:string,from:string,value:string>>"
SHAPE = {n: "string" for n in ("chosen", "rejected", *R.QUESTIONS, "instruction", "input", *R.ANSWERS, "teacher_response", "text")} | {n: TURN for n in ("content", "messages", "conversations")}

#: Names in the structs of each array.
FIELDS = {"content": ["role", "content"], "messages": ["role", "content"], "conversations": ["from", "value", "role", "content"]}

#: Characters that stand for a backslash and for quotes behind one while a literal is taken apart; none is ever a character of a text.
_SLASH, _ONE, _TWO = "﷐", "﷑", "﷒"


def python_to_json(text: Column) -> Column:
    """A Python literal of dicts, lists, tuples, strings, numbers, True, False and None as JSON; null where quotes do not pair.

    Strings that stand beside each other, sets, bytes and numbers that JSON writes otherwise stay as they
    are, and so do not parse; a bracketed single value counts as a list. Work is linear in the text.
    """
    held = F.replace(F.replace(F.replace(text, F.lit("\\\\"), F.lit(_SLASH)), F.lit("\\'"), F.lit(_ONE)), F.lit('\\"'), F.lit(_TWO))

    def told(token: Column) -> Column:
        inner = token.substr(F.lit(2), F.length(token) - 2)
        bytes_told = lambda x: F.when(x.contains("\\x"), F.regexp_replace(x, r"\\x([0-9a-fA-F]{2})", r"\\u00$1")).otherwise(x)
        inner = let(F.replace(inner, F.lit('"'), F.lit(_TWO)), bytes_told)
        inner = F.replace(F.replace(F.replace(inner, F.lit(_ONE), F.lit("'")), F.lit(_TWO), F.lit('\\"')), F.lit(_SLASH), F.lit("\\\\"))
        bare = F.translate(token, "()", "[]")
        for python, json in (("True", "true"), ("False", "false"), ("None", "null")):
            bare = F.regexp_replace(bare, rf"\b{python}\b", json)
        bare = F.regexp_replace(bare, r",(\s*[\]}])", "$1")
        return F.when(token.startswith("'") | token.startswith('"'), F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(bare)

    def joined(text: Column) -> Column:
        tokens = F.regexp_extract_all(text, F.lit("('[^']*+'|\"[^\"]*+\"|[^'\"]++)"), F.lit(1))
        whole = lambda t: F.when(F.length(F.array_join(t, "")) == F.length(text), F.array_join(F.transform(t, told), ""))
        return let(tokens, whole)

    return F.when(~text.rlike(f"[{_SLASH}{_ONE}{_TWO}]"), let(held, joined))


def embedded(text: Column) -> Column:
    """The JSON or Python value that a text is, as VARIANT; null if it is neither."""
    literal = lambda t: F.when(F.substring(t, 1, 1).isin("[", "{", "("), _parsed(python_to_json(t)))
    return let(R.trimmed(text), lambda t: F.coalesce(F.when(t != "", _parsed(t)), literal(t)))


def _parsed(json: Column) -> Column:
    """The value of a text that is one JSON value and nothing more; the parser alone would pass over what follows it."""
    only = lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant"))
    return let(F.try_parse_json(F.concat(F.lit("["), json, F.lit("]"))), only)


def record(value: Column) -> Column:
    """What an object says under the known names, as a struct; null if it is no object."""
    parts = lambda v: F.struct(*[F.try_variant_get(v, f"$.{n}", t).alias(n) for n, t in SHAPE.items()])
    return let(value, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), parts(v)))


def chat_lines(text: Column) -> Column:
    """Messages of a text that has an object with role and content on each line; another line, and there are none."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    lines = F.filter(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: R.trimmed(x) != "")

    def turn(value: Column) -> Column:
        part = lambda n: F.try_variant_get(value, f"$.{n}", "string")
        has = lambda n: F.schema_of_variant(value).rlike(rf"^OBJECT<(?:.*, )?{n}: ")
        return F.when(has("role") & has("content"), R.message(F.coalesce(part("role"), F.lit("")), F.coalesce(part("content"), F.lit(""))))

    whole = lambda found: F.when(F.forall(found, lambda m: m.isNotNull()), found).otherwise(none)
    return F.when(R.trimmed(F.coalesce(text, F.lit(""))) == "", none).otherwise(let(F.transform(lines, lambda line: let(embedded(line), turn)), whole))


def record_messages(types: dict[str, str], fields: dict[str, list[str]]) -> Column:
    """Messages of a record. If its prompt is an object, that is read as a record, and if it is lines of chat turns, those are
    read, and the record's own answer comes after; else the record's columns are read, as records.record_messages does."""
    own = R.record_messages(types, fields)
    if types.get("prompt") != "string":
        return own
    answer = R.first_present(list(types), ("response", "output", "answer", "solution"))
    more = F.array(R.message(F.lit("assistant"), answer))

    none = F.array().cast("array<struct<role:string,text:string>>")
    # what is found is tidied already, so only the answer outside still has to be
    with_answer = lambda found: F.concat(found, F.filter(R.tidied(more), lambda m: m != F.element_at(found, -1)))
    first = lambda inner: F.when(F.size(inner) > 0, with_answer(inner)).otherwise(let(R.tidied(chat_lines(F.col("prompt"))), second))
    second = lambda lines: F.when(F.size(lines) > 0, with_answer(lines)).otherwise(own)
    inner = let(record(embedded(F.col("prompt"))), lambda r: F.when(r.isNotNull(), R.record_messages(SHAPE, FIELDS, lambda n: r[n], False)).otherwise(none))
    return let(F.coalesce(inner, none), first)
