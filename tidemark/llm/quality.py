"""Line-first cleaning and document rules. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, unboxed, words

#: Fixed phrases of lines that a site or a licence puts around a text.
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "we use cookies",
    "enable javascript",
    "licensed under the",
    "copyright (c)",
    "subscribe to our newsletter",
    "click here",
    "sign in",
    "log in",
    "share this",
    "lorem ipsum",
)

SYMBOLS = "[#*$%&|<>]"


def _count(text: Column, inside: str) -> Column:
    """How many characters of a class a text has; inside: the class without its brackets."""
    return F.length(F.regexp_replace(text, f"[^{inside}]+", ""))


def line_fails(line: Column) -> Column:
    """Whether a line fails a rule; a line without a word passes.

    punctuation - a symbol or a doubled exclamation mark for every other word or more, or nothing
    that ends a sentence anywhere in a line of ten words or more;
    stutter - of ten words or more, half or more equal to the word before;
    navigation - a separator for every fifth word or more, three at least;
    boilerplate - a short line with a fixed phrase.
    """
    marks = _count(line, "#*$%&|<>{}~^=")
    shouts = F.size(F.split(line, "!!")) - 1
    bars = _count(line, "|»›•·")
    phrases = "|".join(p.replace("(", r"\(").replace(")", r"\)") for p in BOILERPLATE)

    def judge(found: Column) -> Column:
        count = F.size(found)
        same = F.size(F.filter(found, lambda w, i: (i > 0) & (w == F.get(found, i - 1))))
        return (count > 0) & (
            (2 * (marks + shouts) >= count) & (marks + shouts > 0)
            | (count >= 10) & (~line.rlike("[.!?…。！？;:]") | (2 * same >= count))
            | (bars >= 3) & (5 * bars >= count)
            | (count <= 25) & F.lower(line).rlike(phrases)
        )

    return F.get(F.transform(F.array(words(line)), judge), F.lit(0))


def repeat_words(hashes: Column, width: int) -> Column:
    """How many words lie in windows that occur twice or more; hashes: a window's hash at each word."""
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def again(ranked: Column) -> Column:
        same = F.filter(
            ranked,
            lambda x, k: F.coalesce(F.get(ranked, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(ranked, k + 1)["h"] == x["h"], F.lit(False)),
        )
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1), p + width) - p))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    # arrays of one element bind a value that the expression needs more than once
    at = F.get(F.transform(F.array(ranked), again), F.lit(0))
    return F.get(F.transform(F.array(at), covered), F.lit(0))


def judged(
    docs: DataFrame,
    least_words: int = 20,
    most_repeated: int = 30,
    width: int = 8,
    most_lost: float = 0.5,
) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept, clean_text.

    docs: text and any other columns, which stay (columns of these names are replaced). clean_text is
    the text without the lines that fail a rule; lost_chars are the word characters of those lines. A
    document fails if it has fewer than least_words words or more than most_repeated percent of them
    in repeated windows of `width` words (base_failed), or if it loses more than most_lost of its word
    characters. Null and empty texts have no words and fail; an empty table gives no rows. All is
    computed row by row: nothing is shuffled, whatever the sizes of texts or groups.
    Windows are compared by 64-bit hashes within one text.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept", "clean_text"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    joined = lambda parts: F.length(F.array_join(parts, ""))
    found = boxed(docs).select("row", words(text).alias("words"), F.split(text, "\n").alias("all"), F.length(F.regexp_replace(text, f"[^{SYMBOLS[1:]}+", "")).cast("long").alias("n_symbols"))
    found = found.withColumn("lines", F.filter("all", has_word))
    found = found.withColumn("bad", F.transform("all", line_fails))
    count = F.size("words")
    hashes = F.when(
        count >= width,
        F.transform(F.sequence(F.lit(1), count - (width - 1)), lambda i: F.xxhash64(F.slice("words", i, width))),
    )
    found = found.withColumn("hashes", hashes).withColumn("n_words", count.cast("long"))
    found = found.withColumn("again", F.size(F.array_distinct("hashes")) < F.size("hashes"))
    lost = F.when(
        F.array_contains("bad", True),
        joined(words(F.array_join(F.filter("all", lambda x, i: F.get("bad", i)), "\n"))),
    ).otherwise(0)
    found = found.select(
        "row",
        "n_words",
        joined("words").cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), repeat_words(F.col("hashes"), width)).otherwise(0).cast("long").alias("n_repeat_words"),
        lost.cast("long").alias("lost_chars"),
        F.array_join(F.filter("all", lambda x, i: ~F.get("bad", i)), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    found = found.withColumn("base_failed", failed)
    found = found.withColumn("kept", ~failed & (F.col("lost_chars") <= most_lost * F.col("word_chars")))
    # a row of its own for each verdict: a filter on it then runs after it, on its values
    found = found.select("row", F.explode(F.array(F.struct(*made))).alias("verdict"))
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in made], "verdict.*")


def kept(docs: DataFrame, **rules: float) -> DataFrame:
    """The rows of docs whose document passes, with clean_text in place of the text.

    The other columns stay as they were, but for n_chars, where there is one, which is the new length.
    """
    found = judged(boxed(docs).select("row", "text"), **rules).where("kept")
    out = unboxed(found, docs, F.col("clean_text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
