"""Text rules as column expressions: repair, canonical form, quality, classes, families, fingerprints."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The reserved marks of the canonical grammar.
MARKS = (
    "<bos>", "<eos>", "<sep>", "<think>", "</think>", "<user>", "</user>", "<assistant>", "</assistant>",
    "<market>", "</market>", "<account>", "</account>", "<position>", "</position>", "<evidence>", "</evidence>",
    "<hypothesis>", "</hypothesis>", "<countercase>", "</countercase>", "<tool>", "</tool>", "<tool_result>", "</tool_result>",
    "<decision>", "</decision>", "<confidence>", "</confidence>", "<invalidation>", "</invalidation>",
)

#: What wrongly decoded UTF-8 leaves in a text; each counts two, the replacement character eight.
BROKEN = ("Ã", "Â", "â€", "â€™", "â€œ", "â€�", "â€“", "â€”", "â€¦", "ðŸ", "ï»¿", "ï¿½")

#: Words that name a class, looked for in this order in the first 500 characters.
CLASS_WORDS = (
    ("code", ("def ", "import ", "class ", "return ", "function ")),
    ("math", ("solve", "calculate", "equation", "integral", "formula", "= ")),
    ("instruction", ("human:", "assistant:", "user:", "instruction:")),
)

#: Fixed value: the marks as they are looked for in any case.
ANY_MARK = r"(?i)</?(?:bos|eos|sep|user|assistant|think|market|account|position|evidence|hypothesis|countercase|tool|tool_result|decision|confidence|invalidation)>"
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def occurrences(text: Column, part: str) -> Column:
    """How often a text holds a part, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def mojibake_score(text: Column) -> Column:
    """Eight for each replacement character, two for each broken sequence, three for each C1 control character."""
    score = 8 * occurrences(text, "�") + 3 * F.regexp_count(text, F.lit("[\u0080-\u009f]"))
    return reduce(lambda a, part: a + 2 * occurrences(text, part), BROKEN, score)


@F.pandas_udf(T.StringType())
def _decoded_again(texts: pd.Series) -> pd.Series:
    def score(t: str) -> int:
        return 8 * t.count("�") + 2 * sum(t.count(b) for b in BROKEN) + 3 * len(re.findall("[\x80-\x9f]", t))

    def again(t: str | None) -> str | None:
        for _ in range(2 if t else 0):
            tries = []
            for code in ("cp1252", "latin-1"):
                try:
                    tries.append(t.encode(code).decode())
                except UnicodeError:
                    continue
            best = min(tries, key=score, default=t)
            if score(best) >= score(t):
                break
            t = best
        return t

    return texts.map(again)


def repaired(text: Column) -> Column:
    """The text decoded once or twice more where that lowers its score.

    A Python function is called for all rows, whatever condition stands around it; so sound texts go to it as nulls.
    """
    return F.coalesce(_decoded_again(F.when(mojibake_score(text) > 0, text)), text)


def escaped(text: Column, allowed: tuple[str, ...] = ()) -> Column:
    """The text with reserved marks made inert, but for those that are allowed."""

    def inert(whole: Column) -> Column:
        text = whole
        for mark in MARKS:
            if mark not in allowed:
                text = F.replace(text, F.lit(mark), F.lit(mark.replace("<", "&lt;").replace(">", "&gt;")))
        return F.when(whole.contains("<"), text).otherwise(whole)  # most texts have no mark to look for

    return let(text, inert)


#: What \\s is in a pattern.
BLANKS = " \t\n\x0b\x0c\r"


def trimmed(text: Column) -> Column:
    """The text without white space around it, found from its ends and not by a pattern tried at each character."""
    return F.btrim(text, F.lit(BLANKS))


def one_line_end(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def without_head(text: Column, pattern: str, names: str) -> Column:
    """A text that begins with no white space without its head by the pattern, which is looked for only where a text begins with one of the names."""
    return let(text, lambda t: F.when(F.substring(t, 1, 9).rlike(f"(?i)^(?:{names})"), F.regexp_replace(t, pattern, "")).otherwise(t))


def normalized(text: Column, strip_role: bool = False) -> Column:
    """Line ends made one kind, marks on lines of their own, the parts between them trimmed; null gives ""."""
    text = one_line_end(F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit("")))
    listed = "|".join(re.escape(m) for m in sorted(MARKS, key=len, reverse=True))
    text = let(text, lambda t: F.when(t.contains("<"), F.regexp_replace(t, rf"\s*({listed})\s*", "\n$1\n")).otherwise(t))
    text = F.replace(trimmed(text), F.lit(">\n\n<"), F.lit(">\n<"))
    if strip_role:
        text = without_head(text, r"(?i)^(?:\s*(?:Human|User|Assistant|AI|System)\s*:\s*)+", "Human|User|Assistant|AI|System")
    return text


def prompt_family(text: Column) -> Column:
    """What a text asks: its first user part, else its first 512 characters; lower case, blanks made one, no end marks."""
    value = normalized(text)
    asked = F.regexp_extract(value, r"(?s)<user>\s*(.*?)\s*</user>", 1)
    prompt = F.lower(F.when(value.rlike(r"(?s)<user>.*?</user>"), asked).otherwise(F.substring(value, 1, 512)))
    return F.regexp_replace(F.regexp_replace(prompt, r"\s+", " "), r"[\s.,;:!?]+$", "")


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def category(text: Column) -> Column:
    """reasoning, code, math, instruction or general: the first class whose mark or words a text shows."""
    head = F.lower(F.substring(text, 1, 500))
    out = F.when(text.contains("<think>"), "reasoning")
    for name, parts in CLASS_WORDS:
        out = out.when(reduce(lambda a, b: a | b, [head.contains(p) for p in parts]), name)
    return out.otherwise("general")


def blank_words(text: Column) -> Column:
    """How many words a text has between white space."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+")))


def hash_share(text: Column) -> Column:
    """A number from 0 to 1 that the text's digest gives."""
    return F.conv(F.substring(digest(text), 1, 8), 16, 10).cast("double") / 4294967295.0


def continuation(text: Column, prefix: int = 32, target: int = 48, spare: int = 12) -> Column:
    """A document of prefix + spare words or more as a prompt of its first words and an answer of the next; else null."""
    parts = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+")
    ask, reply = F.array_join(F.slice(parts, 1, prefix), " "), F.array_join(F.slice(parts, prefix + 1, target), " ")
    lines = F.concat(F.lit("<bos>\n<user>\nContinue this passage naturally:\n"), ask, F.lit("\n</user>\n<assistant>\n"), reply, F.lit("\n</assistant>\n<eos>"))
    return F.when(F.size(parts) >= prefix + spare, lines)


def most_frequent(items: Column) -> Column:
    """How often the most frequent item of an array occurs."""
    start = F.struct(F.lit(None).cast("string").alias("item"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["item"] == x, a["run"] + 1).otherwise(1)
        return F.struct(x.alias("item"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(F.array_sort(items), start, step, lambda a: a["best"])


#: Least share printable and of letters or digits, most of one word, least of different words, most of tags to a word.
LIMITS = (0.80, 0.12, 0.50, 0.06, 0.30)

# Fixed values of the gate of the first training stage: the same limits, and what counts as a link, as code, and as notation.
FOUNDATION_LIMITS = (0.95, 0.30, 0.32, 0.10, 0.08)
LINK = r"(?i)(?:https?://|www\.|\b[a-z0-9.-]+\.(?:com|org|net|io|co|ai)\b)"
MAIL = r"\b[^\s@]+@[^\s@]+\.[^\s@]+\b"
CODE = r"(?i)(?:\b(?:def|class|function|import|return|SELECT|INSERT|const|let|var)\b|```|=>|::|</?[a-z][^>]*>)"
NOTATION = r"(?:\\(?:frac|begin|end|mathrm|mathbf|sqrt|det|sum|int)\b|\$[^$]{2,}\$|\b[a-zA-Z]\s*[=<>]\s*[-+]?[0-9]|[{}]{2,})"


def quality(text: Column, least: int = 25, most: int = 100_000, pass_score: float = 0.55, limits: tuple[float, ...] = LIMITS) -> Column:
    """struct(accepted, score, reasons) of a text.

    Length, broken markup and broken encoding reject outright; then each fault takes its penalty from one.
    Words are runs of ASCII letters and digits; printable leaves unassigned characters out of account.
    """
    text = F.coalesce(text, F.lit(""))
    n = lambda part: occurrences(text, part)
    framed = text.contains("<bos>") | text.contains("<eos>")
    user, helper = text.contains("<user>") | text.contains("</user>"), text.contains("<assistant>") | text.contains("</assistant>")
    chat = user | helper
    structure = [
        (framed & ((n("<bos>") != 1) | (n("<eos>") != 1)), "invalid_bos_eos"),
        (chat & ~user, "missing_user"),
        (chat & ~helper, "missing_assistant"),
        (chat & (n("<user>") != n("</user>")), "unbalanced_user"),
        (chat & (n("<assistant>") != n("</assistant>")), "unbalanced_assistant"),
        (chat & ((n("<user>") <= 0) | (n("<assistant>") <= 0)), "empty_chat_side"),
        (n("<think>") != n("</think>"), "unbalanced_think"),
    ]
    broken = F.array_compact(F.array(*[F.when(c, r) for c, r in structure]))
    verdict = lambda ok, score, reasons: F.struct(ok.alias("accepted"), score.cast("double").alias("score"), reasons.alias("reasons"))
    reject = lambda *r: verdict(F.lit(False), F.lit(0.0), F.array(*map(F.lit, r)))

    def summed(found: Column) -> Column:
        bad = F.filter(found, lambda x: x["bad"])
        score = F.greatest(F.lit(0.0), 1.0 - F.aggregate(bad, F.lit(0.0), lambda a, x: a + x["cost"]))
        return verdict(score >= pass_score, F.bround(score, 4), F.transform(bad, lambda x: x["reason"]))

    def judged(content: Column) -> Column:
        words = F.transform(F.regexp_extract_all(content, F.lit("([A-Za-z0-9]+)")), F.lower)
        lines = F.filter(F.transform(F.split(content, LINE_ENDS), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
        parts = F.struct(words.alias("words"), lines.alias("lines"), F.lower(content).alias("lower"))
        faults = lambda p: let(F.size(F.array_distinct(p["words"])), lambda different: _faults(content, p["words"], different, p["lines"], p["lower"], limits))
        return let(let(parts, faults), summed)

    return (
        F.when(F.length(text) < least, reject("too_short"))
        .when(F.length(text) > most, reject("too_long"))
        .when(F.size(broken) > 0, verdict(F.lit(False), F.lit(0.0), broken))
        .when(text.contains("�"), reject("unicode_replacement_character"))
        .when(mojibake_score(text) >= 4, reject("residual_mojibake"))
        .otherwise(let(F.regexp_replace(text, ANY_MARK, " "), judged))
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _faults(content: Column, words: Column, different: Column, lines: Column, lower: Column, limits: tuple[float, ...]) -> Column:
    """Faults of a text as array of (bad, reason, cost); different: its different words. Counts of the most frequent item wait for enough repeats."""
    size = F.greatest(F.length(content), F.lit(1))
    hidden = F.length(content) - F.length(F.regexp_replace(content, r"[\p{Cc}\p{Cf}\p{Co}\p{Zl}\p{Zp}\p{Zs}&&[^ \n\t]]+", ""))
    letters = F.length(F.regexp_replace(content, r"[^\p{L}\p{N}]+", ""))
    count = F.size(words)
    printable, alnum, repeated, diverse, tags = limits
    # Names and costs of the faults, least counts, the patterns of boilerplate.
    often = (count >= 40) & (different - 1 <= (1 - repeated) * count)
    repeats = (F.size(lines) >= 12) & (F.size(lines) - F.size(F.array_distinct(lines)) >= 7)
    faults = [
        ((size - hidden) / size < printable, "low_printable", 0.55),
        (letters / size < alnum, "low_alphanumeric_density", 0.55),
        (F.when(often, most_frequent(words) / count >= repeated).otherwise(False), "high_word_repetition", 0.55),
        (F.when(count >= 40, different / count < diverse).otherwise(False), "low_lexical_diversity", 0.45),
        (F.when(repeats, most_frequent(lines) >= 8).otherwise(False), "repeated_lines", 0.55),
        (F.regexp_count(content, F.lit("<[a-zA-Z][^>]*>")) / F.greatest(count, F.lit(1)) > tags, "mostly_html", 0.40),
        (
            lower.rlike(r"(?:^|\n)\s*(?:cookie policy|privacy policy|terms of service|all rights reserved)\b")
            | lower.rlike(r"\b(?:subscribe to our newsletter|accept all cookies|click here to unsubscribe)\b"),
            "boilerplate",
            0.35,
        ),
    ]
    return F.array(*[F.struct(c.alias("bad"), F.lit(r).alias("reason"), F.lit(p).alias("cost")) for c, r, p in faults])


def foundation_quality(text: Column, pass_score: float = 0.70) -> Column:
    """struct(accepted, score, reasons) under the stricter gate of the first stage: quality() with tighter limits, then
    script, links, code, notation, sentences and numbers, each with its penalty."""
    text = F.coalesce(text, F.lit(""))
    base = quality(text, 40, 20_000, pass_score, FOUNDATION_LIMITS)

    def judged(p: Column) -> Column:
        content, words, base = p["content"], p["words"], p["base"]
        count = F.greatest(F.size(words), F.lit(1))
        length = lambda pattern: F.length(F.regexp_replace(content, pattern, ""))
        hits = lambda pattern: F.regexp_count(content, F.lit(pattern))
        counts = {"letters": length(r"[^\p{L}]+"), "latin": length("[^A-Za-z]+"), "links": hits(LINK) + hits(MAIL), "code": hits(CODE), "notation": hits(NOTATION), "stops": hits("[.!?]")}

        def faulty(n: Column) -> Column:
            many = lambda name, share: (n[name] >= 3) | (n[name] / count > share)
            # Names, bounds and costs of the faults.
            faults = [
                ((n["letters"] > 0) & (n["latin"] / F.greatest(n["letters"], F.lit(1)) < 0.90), "non_english_script_density", 0.45),
                (many("links", 0.025), "link_or_identifier_heavy", 0.45),
                (many("code", 0.03), "code_or_markup_heavy", 0.50),
                (many("notation", 0.025), "math_notation_heavy", 0.50),
                ((F.size(words) >= 30) & (n["stops"] == 0), "no_sentence_boundaries", 0.35),
                (F.size(F.filter(words, lambda w: w.rlike("^[0-9]+$"))) / count > 0.16, "numeric_heavy", 0.40),
            ]
            return F.filter(F.array(*[F.struct(c.alias("bad"), F.lit(r).alias("reason"), F.lit(x).alias("cost")) for c, r, x in faults]), lambda x: x["bad"])

        def told(found: Column) -> Column:
            short = F.size(words) < 8
            score = F.when(short, 0.0).otherwise(F.greatest(F.lit(0.0), F.aggregate(found, base["score"], lambda a, x: a - x["cost"])))
            reasons = F.when(short, F.array(F.lit("too_few_words_for_foundation"))).otherwise(F.transform(found, lambda x: x["reason"]))
            return F.struct((score >= pass_score - 1e-9).alias("accepted"), F.bround(score, 4).alias("score"), F.concat(base["reasons"], reasons).alias("reasons"))

        verdict = let(let(F.struct(*[c.alias(name) for name, c in counts.items()]), faulty), told)
        return F.when(base["accepted"], verdict).otherwise(base)

    content = F.regexp_replace(text, ANY_MARK, " ")
    parts = F.struct(content.alias("content"), F.regexp_extract_all(content, F.lit("([A-Za-z0-9]+)")).alias("words"), base.alias("base"))
    return let(parts, judged)


def simhash_of(text: str) -> int:
    """64-bit SimHash over triples of words (single words below six), as a signed number; ties set a bit.

    Words are runs of letters, digits, underscores and apostrophes, case-folded; without any, the trimmed
    text is the one item. Each item is its BLAKE2b-8 digest, little-endian.
    """
    import numpy as np

    words = [w.casefold() for w in re.findall(r"[\w']+", text)]
    width = 3 if len(words) >= 6 else 1
    items = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [text.casefold().strip()]
    raw = np.frombuffer(b"".join(hashlib.blake2b(x.encode(), digest_size=8).digest() for x in items), np.uint8)
    ones = np.unpackbits(raw.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones >= len(items), bitorder="little").tobytes(), "little", signed=True)


@F.pandas_udf(T.LongType())
def simhash64(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: simhash_of(t or ""))


def bands(fingerprint: Column) -> Column:
    """The four 16-bit bands of a fingerprint, lowest first."""
    return F.array(*[F.shiftrightunsigned(fingerprint, 16 * i).bitwiseAND(F.lit(65535)) for i in range(4)])


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
