"""Answers of an exam: whether they are right, whether they collapse into a few, and what training should stress next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import let

# Categories of each skill; weight, gain and bounds of each kind of feedback.
SKILLS = {
    "arithmetic": ("primitive_arithmetic", "number_sense"),
    "economics": ("foundation_economics",),
    "grammar": ("grammar", "semantic_plausibility"),
    "control": ("language_control",),
    "creativity": ("creativity",),
}


def term_present(term: Column, text: Column) -> Column:
    """Whether a lower-case text has a term as a word of its own, a single word also in its plural forms; an empty term never."""
    term = F.lower(F.trim(term))
    quoted = F.regexp_replace(term, r"([\\.\[\]{}()*+?^$|/-])", r"\\$1")
    forms = F.when(term.contains(" "), quoted).when(term.rlike(".y$"), F.concat(F.lit("(?:"), quoted, F.lit("(?:s|es)?|"), F.regexp_replace(quoted, "y$", "ies"), F.lit(")"))).otherwise(F.concat(quoted, F.lit("(?:s|es)?")))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), forms, F.lit(r"(?![\p{L}\p{N}_])"))
    return F.when(term == "", False).otherwise(F.regexp_like(text, pattern))


def _plain_math(text: Column) -> Column:
    for name, sign in (("multiplied by", "*"), ("times", "*"), ("plus", "+"), ("minus", "-")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.regexp_replace(text, r"\s+", "")


def number_matches(answer: Column, expected: Column, units: Column, expression: Column) -> Column:
    """Whether a lower-case answer is the number alone, with one of its units, after "the answer is", or the sum that was asked for.

    expected: the number as text; units, an array, and expression may be null.
    """
    cleaned = F.regexp_replace(answer, r"^[ \t\r\n.!,:;]+|[ \t\r\n.!,:;]+$", "")
    told = F.regexp_extract(cleaned, r"^(?:(?:the\s+)?(?:answer|result|value)\s+(?:is|=)\s*)(.*)$", 1)
    unit = F.regexp_extract(cleaned, r"^(\S+)\s+(.+)$", 2)
    with_unit = (F.regexp_extract(cleaned, r"^(\S+)\s+(.+)$", 1) == expected) & F.coalesce(F.array_contains(units, unit), F.lit(False))
    sides = F.struct(F.regexp_extract(cleaned, r"^(.*)=([^=]*)$", 1).alias("left"), F.regexp_extract(cleaned, r"^(.*)=([^=]*)$", 2).alias("right"))
    asked = lambda s: (F.regexp_replace(s["right"], r"^[ .!,:;]+|[ .!,:;]+$", "") == expected) & (_plain_math(s["left"]) == _plain_math(F.lower(expression)))
    summed = F.coalesce(cleaned.contains("=") & let(sides, asked), F.lit(False))
    return (cleaned == expected) | with_unit | (told == expected) | summed


def correct(answers: DataFrame) -> DataFrame:
    """answers with correct: no answer and none with flags is; a number decides if one is expected, else all of one list of terms and any of another.

    answers: answer (lower case), flags, number, units, expression, conceptual, all_terms, any_terms. Without
    an expected number or term nothing is right; a conceptual question wants four words.
    """
    blank = lambda c: F.coalesce(F.size(F.filter(c, lambda t: t.isNotNull())) == 0, F.lit(True))
    has = lambda t: term_present(t, F.col("answer"))
    every = F.coalesce(F.forall("all_terms", has), F.lit(True))
    some = blank("any_terms") | F.coalesce(F.exists("any_terms", has), F.lit(False))
    words = F.size(F.regexp_extract_all("answer", F.lit(r"([\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)?)")))
    terms = every & some & ~(blank("all_terms") & blank("any_terms")) & (~F.coalesce("conceptual", F.lit(False)) | (words >= 4))
    right = F.when(F.col("number").isNotNull(), number_matches(F.col("answer"), F.col("number"), F.col("units"), F.col("expression"))).otherwise(terms)
    there = (F.coalesce("answer", F.lit("")) != "") & (F.coalesce(F.size("flags"), F.lit(0)) <= 0)
    return answers.withColumn("correct", F.coalesce(there & right, F.lit(False)))


def collapse(answers: DataFrame, key: str, first: int = 5) -> DataFrame:
    """key, answers, diversity (percent of different ones among those that are not empty), most_same, most_alike, collapsed.

    answers: key, answer. most_same is how often the most frequent answer came, most_alike the most frequent
    beginning of `first` words; where all are empty both are the number of answers. An exam has
    collapsed if a third of its answers (six at least) are the same, or half (eight at least) begin alike. Counts
    of hashed answers and beginnings are combined in each task, then counted once more by key.
    """
    said = F.coalesce("answer", F.lit(""))
    head = F.array_join(F.slice(F.filter(F.split(said, r"\s+"), lambda w: w != ""), 1, first), " ")
    both = F.array(F.struct(F.lit("whole").alias("kind"), F.sha2(said, 256).alias("h")), F.struct(F.lit("head").alias("kind"), F.sha2(head, 256).alias("h")))
    rows = answers.select(key, (said == "").alias("empty"), F.explode(both).alias("x"))
    counted = rows.groupBy(key, "empty", "x.kind", "x.h").agg(F.count(F.lit(1)).alias("n"))
    whole, full = F.col("kind") == "whole", ~F.col("empty")
    sums = counted.groupBy(key).agg(
        F.sum(F.when(whole, F.col("n"))).alias("answers"), F.coalesce(F.sum(F.when(whole & full, F.col("n"))), F.lit(0)).alias("full"), F.count_if(whole & full).alias("kinds"),
        F.max(F.when(whole & full, F.col("n"))).alias("same"), F.max(F.when(~whole & full, F.col("n"))).alias("alike"),
    )
    third, half = F.floor((F.col("answers") + 2) / 3), F.floor((F.col("answers") + 1) / 2)
    fell = F.col("same").isNull() | (F.col("same") >= F.greatest(F.lit(6), third)) | (F.col("alike") >= F.greatest(F.lit(8), half))
    share = F.when(F.col("full") > 0, 100 * F.col("kinds") / F.col("full")).otherwise(0.0)
    return sums.select(key, "answers", share.alias("diversity"), F.coalesce("same", "answers").alias("most_same"), F.coalesce("alike", "answers").alias("most_alike"), fell.alias("collapsed"))


def feedback(answers: DataFrame, collapses: DataFrame, key: str) -> DataFrame:
    """key, six weights and scales by which training should stress what an exam has shown to be weak.

    answers: key, category, correct, quality (0 to 1), flags, answer; collapses: what collapse() gives. A skill
    that was not asked for counts as known. An answer that is coherent though wrong counts as an attempt.
    """
    full = F.coalesce("answer", F.lit("")) != ""
    flagged = F.coalesce(F.size("flags"), F.lit(0)) > 0
    effort = F.when(~full, 0.0).when((F.col("quality") >= 0.55) & ~flagged, 1.0).when(F.col("quality") >= 0.30, 0.5).otherwise(0.0)
    known = lambda cs: F.coalesce(F.avg(F.when(F.col("category").isin(*cs), F.col("correct").cast("double"))), F.lit(1.0))
    sums = answers.groupBy(key).agg(
        *[known(cs).alias(name) for name, cs in SKILLS.items()], F.avg("quality").alias("quality"), F.avg(effort).alias("attempt"), F.avg(flagged.cast("double")).alias("babble"), F.avg(F.col("correct").cast("double")).alias("right")
    )
    rows = sums.join(collapses.select(F.col(key).alias("own"), (F.col("diversity") / 100).alias("diversity"), "collapsed"), F.col(key).eqNullSafe(F.col("own")))
    miss = lambda c: 1 - F.col(c)
    fell = lambda x: F.when(F.col("collapsed"), x).otherwise(0.0)
    held = lambda x, high, low=0.65: F.greatest(F.lit(low), F.least(F.lit(high), x))
    return rows.select(
        key,
        held(1 + 2.5 * miss("arithmetic"), 3.5).alias("arithmetic_weight"),
        held(1 + 2.0 * miss("economics"), 3.0).alias("economics_weight"),
        held(1 + 1.25 * miss("quality") + 1.1 * F.col("babble") + 1.1 * miss("grammar") + 0.6 * miss("control"), 3.25).alias("language_weight"),
        held(1 + 0.65 * miss("quality") + 0.45 * miss("attempt"), 2.25).alias("conversation_weight"),
        held(1 + 0.9 * miss("diversity") + 0.65 * miss("creativity") + fell(0.5), 2.75).alias("creativity_weight"),
        held((1 + 1.55 * miss("right")) * (1 - 0.1 * F.col("attempt")), 2.75, 0.9).alias("hard_negative_scale"),
        held(1 + 1.75 * miss("diversity") + 0.8 * miss("control") + fell(0.9) + 0.9 * F.col("babble"), 3.5, 0.9).alias("repetition_scale"),
    )
