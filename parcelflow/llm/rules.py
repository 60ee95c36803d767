"""Line-first quality rules, in SQL functions only.

Every line is judged first: by its symbols, capitals, closing punctuation, and phrases of navigation and boilerplate.
Lines that fail are removed; a document that loses more than LOST of its characters is rejected, as is one that
fails the base rules on words and repeated eight-word windows.  Counts are of whole texts.

A null text counts as empty: no words, so it is rejected.  Rows keep their number; repeated ids and rows are judged one
by one; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm.common import documents

WINDOW = 8
LEAST_WORDS, REPEATED_PERCENT = 20, 30
LOST = 0.5
#: Symbols a word and separators from which on a line fails; words up to which a line without an end fails.
SYMBOLS_A_WORD, SEPARATORS, OPEN_WORDS = 0.34, 3, 3
SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
PHRASES = (
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "log in", "lorem ipsum", "main menu",
    "next page", "previous page", "privacy policy", "read more", "share this", "sign in", "sign up", "site map", "skip to content", "subscribe to", "terms of service", "terms of use",
)
PHRASED_CHARS = 200  # longer lines are prose, whatever they mention


def bound(value: Column, then) -> Column:  # noqa: ANN001
    """then(value) with value computed once: the optimizer does not copy what a lambda's variable stands for."""
    return F.transform(F.array(value), then)[0]


def line_fails(line: Column) -> Column:
    words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    symbols = F.regexp_count(line, F.lit(SYMBOL))
    end = F.substring(F.rtrim(line), -1, 1)
    return (
        (symbols > SYMBOLS_A_WORD * words)
        | (F.regexp_count(line, F.lit("[|»›•]")) >= SEPARATORS)
        | (~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}.*\p{Lu}") & (words >= 3))
        | ((words <= OPEN_WORDS) & ~end.isin(list(".!?:;,\"')]…”»")))
        | ((F.length(line) <= PHRASED_CHARS) & F.lower(line).rlike("|".join(PHRASES)))
    )


def repeated_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the hashes of the words."""

    def windows(h: Column) -> Column:
        return F.when(F.size(h) < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
        )

    def covered(g: Column) -> Column:
        in_order = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = bound(
            in_order,
            lambda s: F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["x"] == e["x"], F.lit(False))),
        )
        at = F.array_sort(F.transform(twice, lambda e: e["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(at, start, lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end")), lambda a: a["n"].cast("long"))

    return bound(windows(hashes), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, lost (share of characters that failing lines have) and kept."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = text.select("doc_id", "text", F.array_remove(F.split("text", SPACE, -1), "").alias("words"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    chars = F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    failed = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.when(line_fails(x), F.length(x)).otherwise(0))
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    counted = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        chars.alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        bound(F.transform("words", lambda w: F.xxhash64(w)), repeated_words).alias("n_repeat_words"),
        F.coalesce(F.try_divide(failed, total), F.lit(0.0)).alias("lost"),
    )
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= LOST))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
