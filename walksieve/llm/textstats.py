"""Counts of whole texts as Spark columns: words, symbols, lines and repeats. No Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, SPACES

SYMBOLS = "#*$%&|<>"


def held(c: Column) -> Column:
    """An expression that is evaluated once per row, however often and wherever it is used afterwards."""
    return F.explode(F.array(c))


def occurrences(c: Column, characters: str) -> Column:
    """How many of the characters a text holds."""
    return (F.char_length(c) - F.char_length(F.translate(c, characters, ""))).cast("long")


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `body` (null: empty) and `words`: runs of anything but space and tab to carriage return."""
    df = df.withColumn("body", F.coalesce(F.col(text).cast("string"), F.lit("")))
    return df.withColumn("words", held(F.array_remove(F.split("body", SPACE_RE), "")))


def with_lines(df: DataFrame) -> DataFrame:
    """Adds `lines`: the parts of `body` between line feeds that hold a word."""
    return df.withColumn("lines", held(F.filter(F.split("body", "\n"), lambda x: F.translate(x, SPACES, "") != "")))


def n_dup_lines() -> Column:
    """Lines that equal an earlier line."""
    return (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in 3-word windows that the text has twice or more, the first included.

    Window hashes are sorted with their places only where some hash repeats. A repeated window at place p covers
    p..p+2, so in order of places each adds the step to the next one, 3 at most, and the last adds 3.
    """
    n = F.size("words")
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    df = df.withColumn("_h", held(F.when(n > 3, hashes).otherwise(F.array().cast("array<bigint>"))))
    placed = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = df.withColumn("_s", held(F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed)))
    same = F.zip_with(F.slice("_s", 1, F.size("_s") - 1), F.slice("_s", 2, F.size("_s") - 1),
                      lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_q", held(F.when(F.col("_s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(same))))))
    steps = F.zip_with(F.slice("_q", 1, F.size("_q") - 1), F.slice("_q", 2, F.size("_q") - 1), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(steps, F.lit(3), lambda s, x: s + x)
    return df.withColumn("n_repeat_words", F.when(F.size("_q") > 0, covered).otherwise(0).cast("long")).drop("_h", "_s", "_q")


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words; keeps body, words and lines."""
    df = with_repeats(with_lines(with_words(df, text)))
    return df.withColumns({
        "n_words": F.size("words").cast("long"), "word_chars": F.char_length(F.translate("body", SPACES, "")).cast("long"),
        "n_symbols": occurrences(F.col("body"), SYMBOLS), "n_dup_lines": n_dup_lines()})
