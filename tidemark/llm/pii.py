"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs the labelers, and a
linear classifier trained on the posteriors decides. DataFrame operations only.

Spans of the four base kinds are always kept; the classifier adds further spans to them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, remove, unboxed, written

#: The kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")

#: What a match of each kind's candidates looks like. Repeats are possessive and runs are entered at their
#: first character only (or where the last match ended), so a long run costs no more than its length.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?i)\b(?:api[_-]?key|access[_-]?key|token|secret|password|passwd)\b[\x20\t]{0,3}[:=][\x20\t]{0,3}[\x22\x27]?[A-Za-z0-9+/_-]{12,}+[\x22\x27]?",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}

#: A text without this cannot hold the kind.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]", "secret": "[:=]", "ssn": "[0-9]-[0-9]", "iban": "[A-Z]{2}[0-9]{2}"}

#: Words before a span that speak for a kind, and words that speak against any.
CONTEXT = {
    "email": "mail|contact|write|reach",
    "ip": r"\bip\b|address|host|server|client|login",
    "card": "card|visa|master|amex|credit|payment|account",
    "phone": "phone|tel|call|mobile|fax|whatsapp",
    "secret": "config|export|env|auth|api",
    "ssn": "ssn|social|security|tax",
    "iban": "iban|bank|account|transfer",
}
AGAINST = r"version|isbn|issn|doi|order|invoice|build|figure|chapter|section|serial"

#: Gazetteers: domain ends, card issuers' first digits, calling codes, and countries of bank accounts.
DOMAIN_ENDS = "com|org|net|edu|gov|io|info|biz|de|fr|es|it|uk|nl|eu|us|ca|ch|at|be|pt|pl|se|mx|ar|br|in|jp|cn"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35"
CALLING = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
BANKS = "DE|FR|ES|IT|GB|NL|BE|AT|CH|PT|PL|SE|IE|LU"

VOTERS = ("shape", "number", "gazetteer", "context", "edges", "variety")

#: Kinds whose number can be checked by itself; one that fails the check is none, whatever the other labelers say.
CHECKED = ("ip", "card", "phone", "ssn")

#: Numbers of an array that are summed up in one go.
BLOCK = 128


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid Luhn check digit."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    taken = F.transform(values, lambda v, i: F.when(i % 2 == 1, 2 * v - F.when(v > 4, 9).otherwise(0)).otherwise(v))
    return F.aggregate(taken, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def _parts_fit(match: Column) -> Column:
    """Whether all four numbers of a dotted address are at most 255, however many zeros lead them."""
    short = F.transform(F.split(match, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))


def _base(kind: str, match: Column, digits: Column) -> Column:
    """Whether a match is a base span."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _parts_fit(match)
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(False)


def _vote(yes: Column, no: Column) -> Column:
    """1 for, -1 against, 0 no vote."""
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, x: Column) -> list[Column]:
    """One vote of each labeler on a candidate: its match, its digits, and the text on either side."""
    match, digits, left, right = x["match"], x["digits"], x["left"], x["right"]
    number = F.length(digits)
    lower, before = F.lower(match), F.lower(left)
    never = F.lit(False)
    shape, value, known = never, never, never
    told = match  # the part that says something, without a name before it
    not_shape, not_value, not_known = never, never, never
    if kind == "email":
        shape, not_shape = match.rlike(r"^[A-Za-z0-9]"), match.rlike(r"\.\.|\.@|-\.|\.-")
        value = F.length(match) <= 254
        known = lower.rlike(rf"\.(?:{DOMAIN_ENDS})$")
        not_known = lower.rlike(r"\.(?:png|jpg|gif|js|css|html)$")
    elif kind == "ip":
        shape, not_shape = match.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), match.rlike(r"^0|\.0[0-9]")
        value, not_value = _parts_fit(match), ~_parts_fit(match)
        not_known = match.rlike(r"^(?:0|127|255)\.")
    elif kind == "card":
        shape, not_shape = number.isin(15, 16) & match.rlike(r"^[0-9]{4}([\x20-]?)[0-9]{4,6}\1[0-9]{4,5}"), (number < 14) | (number > 19)
        value = luhn(digits) & number.between(14, 19)
        not_value = ~value
        known, not_known = digits.rlike(rf"^(?:{ISSUERS})"), digits.rlike("^0")
    elif kind == "phone":
        shape, not_shape = number.between(10, 13), (number < 8) | (number > 15)
        value, not_value = match.rlike(r"^\+[1-9]"), match.rlike(r"^\+0") | ~number.between(8, 15)
        known = digits.rlike(rf"^(?:{CALLING})")
    elif kind == "secret":
        body = F.regexp_extract(match, r"([A-Za-z0-9+/_-]{12,})[\x22\x27]?$", 1)
        told, shape, not_shape = body, F.length(body) >= 20, F.length(body) < 16
        value, not_value = body.rlike("[0-9]") & body.rlike("[A-Za-z]"), ~body.rlike("[0-9]")
        known = match.rlike(r"[\x22\x27]$")
    elif kind == "ssn":
        shape = F.lit(True)
        value, not_value = ~match.rlike("^(?:000|666|9)|-00-|-0000$"), match.rlike("^(?:000|666|9)|-00-|-0000$")
    else:
        shape, not_shape = F.length(F.regexp_replace(match, " ", "")).between(15, 34), F.length(match) < 15
        known, not_known = match.rlike(f"^(?:{BANKS})"), ~match.rlike(f"^(?:{BANKS})")
    glued = left.rlike("[A-Za-z0-9]$") | right.rlike("^[A-Za-z0-9]")
    bare = F.regexp_replace(F.lower(told), "[^a-z0-9]", "")
    kinds_of = F.size(F.array_distinct(F.split(bare, "")))
    return [
        _vote(shape & ~not_shape, not_shape),
        _vote(value & ~not_value, not_value),
        _vote(known & ~not_known, not_known),
        _vote(before.rlike(CONTEXT[kind]), before.rlike(AGAINST)),
        _vote(~glued, glued),
        _vote(kinds_of >= 5, kinds_of <= 3),
    ]


#: How many values each trait of a candidate has; the classifier sees them beside the votes.
TRAITS = (4, 4, 3, 2, 3)


def _traits(x: Column) -> list[Column]:
    """What a candidate looks like, in a few steps each: length, share of digits, separators, mixed case, what stands before it."""
    match, number, size = x["match"], F.length(x["digits"]), F.length(x["match"])
    marks = size - F.length(F.regexp_replace(match, r"[\x20().:=_/-]", ""))
    return [
        F.when(size < 12, 0).when(size < 20, 1).when(size < 36, 2).otherwise(3),
        F.when(number == 0, 0).when(2 * number < size, 1).when(number < size, 2).otherwise(3),
        F.when(marks == 0, 0).when(marks < 4, 1).otherwise(2),
        F.when(match.rlike("[A-Z]") & match.rlike("[a-z]"), 1).otherwise(0),
        F.when(x["left"].rlike(r"[:=]\s*$"), 2).when(x["left"].rlike(r"\s$") | (x["left"] == ""), 1).otherwise(0),
    ]


def _running(values: Column, join: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """All values up to each place joined, of a non-empty array of numbers; join is a sum or a maximum.

    Appending to an array copies it, so that is done in blocks: an array of n costs about n * BLOCK steps.
    """

    def grown(part: Column, start: Column) -> Column:
        """start joined with the first value, and so on; start comes first."""
        return F.aggregate(part, F.array(start), lambda a, x: F.concat(a, F.array(join(F.element_at(a, -1), x))))

    def placed(held: Column) -> Column:
        starts = grown(F.transform(held["blocks"], lambda b: F.aggregate(b, F.lit(zero), join)), F.lit(zero))
        return F.flatten(F.zip_with(held["blocks"], F.slice(starts, 1, F.size(held["blocks"])), lambda b, s: F.slice(grown(b, s), 2, F.size(b))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    return F.get(F.transform(F.array(F.struct(blocks.alias("blocks"))), placed), F.lit(0))


def _located(kind: str, text: Column) -> Column:
    """Matches of a kind: array of (match, from, to, left, right), in code points, to exclusive."""
    pattern = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))

    def place(both: Column) -> Column:
        found, gaps = both["found"], both["gaps"]
        sizes = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, f: F.length(g) + F.length(f))
        return F.transform(
            F.arrays_zip(found.alias("found"), _running(sizes, lambda a, x: a + x).alias("to")),
            lambda x, i: F.struct(
                x["found"].alias("match"),
                _digits(x["found"]).alias("digits"),
                (x["to"] - F.length(x["found"])).alias("from"),
                x["to"].alias("to"),
                F.right(F.get(gaps, i), F.lit(40)).alias("left"),
                F.left(F.get(gaps, i + 1), F.lit(1)).alias("right"),
            ),
        )

    def placed(found: Column) -> Column:
        bound = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps"))
        return F.get(F.transform(F.array(bound), place), F.lit(0))

    nothing = F.array().cast("array<struct<match:string,digits:string,from:int,to:int,left:string,right:string>>")
    return F.when(text.rlike(NEEDS[kind]) & (F.size(matches) > 0), placed(matches)).otherwise(nothing)


def _judged(kind: str, located: Column) -> Column:
    """The matches of a kind with their votes."""

    def judge(x: Column) -> Column:
        votes = [v.cast("int") for v in _votes(kind, x)]
        return F.struct(
            x["from"].alias("from"),
            F.lit(KINDS.index(kind)).alias("rank"),
            x["to"].alias("to"),
            _base(kind, x["match"], x["digits"]).alias("base"),
            F.array(*votes).alias("votes"),
            F.array(*[t.cast("int") for t in _traits(x)]).alias("traits"),
        )

    return F.transform(located, judge)


def candidates(text: Column) -> Column:
    """Candidate spans of a text: array of (from, rank, to, base, votes, traits), by start and then kind."""
    located = {kind: _located(kind, text) for kind in KINDS}
    located["card"] = F.filter(located["card"], lambda x: F.length(x["match"]) >= 13)  # a base card has 14 digits
    return F.array_sort(F.concat(*[_judged(kind, found) for kind, found in located.items()]))


@dataclass
class Model:
    """Reliabilities of the labelers for each kind, and the classifier's weights."""

    prior: dict[int, float] = field(default_factory=dict)
    accuracy: dict[tuple[int, int], float] = field(default_factory=dict)
    bias: dict[int, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)
    traits: list[float] = field(default_factory=lambda: [0.0] * sum(TRAITS))

    def score(self, c: Column) -> Column:
        """The classifier's log-odds that a candidate is personal data."""
        out = F.get(_numbers([self.bias.get(k, -1.0) for k in range(len(KINDS))]), c["rank"])
        for i, w in enumerate(self.weights):
            out = out + F.get(c["votes"], F.lit(i)) * w
        for i, steps in enumerate(TRAITS):
            at = sum(TRAITS[:i])
            out = out + F.get(_numbers(self.traits[at : at + steps]), F.get(c["traits"], F.lit(i)))
        return out


def _numbers(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _posterior(model: Model) -> Column:
    """P(personal data | votes) of a pattern under the labelers' reliabilities."""
    odds = lambda p: math.log(p / (1 - p))
    prior = _numbers([odds(model.prior.get(k, 0.5)) for k in range(len(KINDS))])
    trust = _numbers([odds(model.accuracy.get((k, i), 0.75)) for k in range(len(KINDS)) for i in range(len(VOTERS))])
    own = F.zip_with("votes", F.slice(trust, F.col("rank") * len(VOTERS) + 1, len(VOTERS)), lambda v, t: v * t)
    return 1 / (1 + F.exp(-F.aggregate(own, F.get(prior, F.col("rank")), lambda a, x: a + x)))


def _of_text(text: Column) -> Column:
    return candidates(F.coalesce(text.cast("string"), F.lit("")))


def learn(docs: DataFrame, rounds: int = 8, trust: float = 20.0) -> Model:
    """Reliabilities by expectation-maximisation, then a logistic classifier on the posteriors.

    docs: text; other columns are not read. Null and empty texts, and an empty table, add no candidates:
    then the votes count alike.
    """
    return _fitted(docs.select(F.explode(_of_text(F.col("text"))).alias("c")), rounds, trust)


def _fitted(spans: DataFrame, rounds: int = 8, trust: float = 20.0) -> Model:
    """The model of candidates c.

    They are reduced to how often each kind has each pattern of votes and traits: at most 7 x 3^6 x 288
    rows, whatever the corpus. Every round is one aggregation of that table. A labeler starts from an
    accuracy of 0.75 that counts like `trust` votes, so kinds with few candidates, or none, keep a defined
    model; one that is wrong more often than right ends below 0.5, and its votes count the other way.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counted = spans.groupBy(*[F.col(f"c.{x}").alias(x) for x in ("rank", "votes", "traits")]).agg(F.count(F.lit(1)).alias("n"))
    patterns = written(counted.coalesce(1), "vote-patterns")
    model = Model()
    for _ in range(rounds):
        p = F.col("p")
        sums = [F.sum("n").alias("n"), F.sum(p * F.col("n")).alias("yes")]
        for i in range(len(VOTERS)):
            v = F.get("votes", F.lit(i))
            sums += [
                F.sum(F.when(v == 1, p * F.col("n")).when(v == -1, (1 - p) * F.col("n")).otherwise(0)).alias(f"right{i}"),
                F.sum(F.abs(v) * F.col("n")).alias(f"cast{i}"),
            ]
        for row in patterns.withColumn("p", _posterior(model)).groupBy("rank").agg(*sums).collect():
            model.prior[row["rank"]] = (row["yes"] + 0.5 * trust) / (row["n"] + trust)
            for i in range(len(VOTERS)):
                share = (row[f"right{i}"] + 0.75 * trust) / (row[f"cast{i}"] + trust)
                model.accuracy[row["rank"], i] = min(max(share, 0.05), 0.99)
    kinds = [F.when(F.col("rank") == k, 1.0).otherwise(0.0) for k in range(len(KINDS))]
    steps = [F.when(F.get("traits", F.lit(i)) == k, 1.0).otherwise(0.0) for i, n in enumerate(TRAITS) for k in range(n)]
    features = array_to_vector(F.concat(F.col("votes").cast("array<double>"), F.array(*kinds, *steps)))
    rows = patterns.select("n", features.alias("features"), _posterior(model).alias("p"))
    soft = rows.select("features", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")), F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight")))).alias("x"))
    soft = soft.select("features", "x.label", "x.weight").where("weight > 0")
    if soft.isEmpty():
        model.weights, model.bias = [1.0] * len(VOTERS), {}
    else:
        fitted = LogisticRegression(weightCol="weight", regParam=0.001, maxIter=50, standardization=False).fit(soft)
        found, votes = [float(x) for x in fitted.coefficients], len(VOTERS)
        model.weights = found[:votes]
        model.bias = {k: float(fitted.intercept) + found[votes + k] for k in range(len(KINDS))}
        model.traits = found[votes + len(KINDS) :]
    remove(patterns.sparkSession, patterns)
    return model


def _taken(found: Column, model: Model) -> Column:
    """Of candidates the base spans and those that the classifier takes and no check rules out: array of (from, rank, to, base)."""
    checked = [KINDS.index(k) for k in CHECKED]
    fails = lambda c: c["rank"].isin(*checked) & (F.get(c["votes"], F.lit(VOTERS.index("number"))) == -1)
    taken = F.filter(found, lambda c: c["base"] | ((model.score(c) > 0) & ~fails(c)))
    return F.transform(taken, lambda c: F.struct(c["from"].alias("from"), c["rank"].alias("rank"), c["to"].alias("to"), c["base"].alias("base")))


def found_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with spans: array of (from, rank, to, base): base spans, and candidates that the classifier takes.

    All columns stay (one named spans is replaced). A null text counts as empty and has none; an empty
    table gives no rows. Spans of different kinds may overlap. Nothing is shuffled. Without a model one is
    learned from docs: then candidates are looked for once and written beside the rows.
    """
    if model is not None:
        return docs.withColumn("spans", _taken(_of_text(F.col("text")), model))
    rows = written(boxed(docs).select("row", _of_text(F.col("text")).alias("candidates")), "candidates", "zstd")
    model = _fitted(rows.select(F.explode("candidates").alias("c")))
    held = [F.col("row")[c].alias(c) for c in docs.columns if c != "spans"]
    return rows.select(*held, _taken(F.col("candidates"), model).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["from"].cast("string"), s["to"].cast("string")))
    return F.array_join(text, ",")


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; overlapping spans become one.

    All columns stay; a null text stays null; an empty table gives no rows. n_chars, where there is one, is the new length.
    """
    marked = found_spans(boxed(docs).select("row", "text"), model)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def shown(held: Column) -> Column:
        """What stands before each span and after those before it, and its kind; a span that begins inside others adds nothing."""
        spans, done = held["spans"], held["done"]
        pieces = F.transform(
            spans,
            lambda s, i: F.when(s["from"] < F.coalesce(F.get(done, i - 1), F.lit(0)), F.lit("")).otherwise(
                F.concat(F.substring(F.col("text"), F.coalesce(F.get(done, i - 1), F.lit(0)) + 1, s["from"] - F.coalesce(F.get(done, i - 1), F.lit(0))), F.get(names, s["rank"]))
            ),
        )
        return F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), F.element_at(done, -1) + 1, F.length("text")))

    ends = _running(F.transform("spans", lambda s: s["to"]), lambda a, x: F.greatest(a, x))
    bound = F.array(F.struct(F.col("spans").alias("spans"), ends.alias("done")))
    text = F.when(F.size("spans") > 0, F.get(F.transform(bound, shown), F.lit(0))).otherwise(F.col("text"))
    out = unboxed(marked.select("row", text.alias("text")), docs, F.col("text"))
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
