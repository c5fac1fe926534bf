"""Small tables with nulls, empty and long texts, repeated rows and clashing column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"

PROSE = "the quick brown fox jumps over a lazy dog while seven wizards brew strong tea near the old stone bridge at dawn"
ODD_TEXTS = [
    (1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "one two"), (None, "no id at all"),
    (8, "a b c " * 20_000), (9, "x" * 50_000), (10, "é😀 ü" * 50), (11, "\x00 nul \x01\x02"), (12, "-1 2,3 \"q\" 'r' \\ / |"),
]


def odd_documents(spark: SparkSession) -> DataFrame:
    """Documents whose other columns have names that operators use inside."""
    names = "_row hits n_words text_ start kind row words part node"
    rows = [(i, t, "en" if k % 2 else None, f"src{k % 3}" if k % 4 else None, None if t is None else len(t), *[k] * 10) for k, (i, t) in enumerate(ODD_TEXTS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names.split())
    return spark.createDataFrame(rows, schema)


def no_documents(spark: SparkSession) -> DataFrame:
    return odd_documents(spark).limit(0)


def documents(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
