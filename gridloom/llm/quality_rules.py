"""Quality rules as a short-circuit cascade, in column expressions only.

A rule is a named condition under which a text is rejected. On a bounded sample each rule's cost (time to
evaluate it) and selectivity (share rejected) are measured, and the rules are run in falling order of
rejection per cost. They are branches of one CASE, so a later rule is not evaluated for a text that an
earlier one rejects. The order changes the work and the name of the first failing rule, never the verdict.

Null or empty text: no words, all counts 0, rejected for its length. Repeated rows each get their own result.
Other columns are ignored, whatever their names. A text of any length is one row of arrays; nothing is shuffled.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SPACES, free_name

SYMBOLS = "#*$%&|<>"
#: Rows on which cost and selectivity are estimated; they decide the order of the rules and nothing else.
SAMPLE_ROWS, SAMPLE_CHARS = 500, 50_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


def count_of(text: Column, kept: str) -> Column:
    """Code points of a text that match a character class."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", ""))


#: Conditions over the counted columns and the text. ``c`` names a column.
RULES = (
    Rule("symbols", lambda c: c("n_symbols") * 10 > c("n_words")),
    Rule("dup_lines", lambda c: c("n_dup_lines") * 4 > c("n_lines") * 3),
    Rule("word_length", lambda c: (c("word_chars") < c("n_words") * 2) | (c("word_chars") > c("n_words") * 20)),
    Rule("capitals", lambda c: count_of(c("text"), "\\p{Lu}") * 2 > count_of(c("text"), "\\p{L}")),
    Rule("letters", lambda c: count_of(c("text"), "\\p{L}") * 2 < c("word_chars")),
)


def repeated_words(words: Column, n_words: Column) -> tuple[Column, Callable[[Column], Column], Callable[[Column], Column]]:
    """Words inside 3-word windows that occur twice or more, in three steps for three projections.

    Windows are sorted with their places, so equal ones are neighbours; the places that have an equal
    neighbour are put in order again, and each adds the words that the place before has not covered.
    """
    window = lambda i: F.struct(
        F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("k"), i.alias("p")
    )
    ordered = F.when(n_words >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n_words - 3, F.lit(0))), window)))

    def places(ordered: Column) -> Column:
        same = lambda x, j: (F.get(ordered, j - 1)["k"] == x["k"]) | F.coalesce(F.get(ordered, j + 1)["k"] == x["k"], F.lit(False))
        twice = F.filter(ordered, lambda x, j: F.coalesce(same(x, j), F.get(ordered, j + 1)["k"] == x["k"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def covered(places: Column) -> Column:
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last"))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.coalesce(F.aggregate(places, start, step)["n"], F.lit(0))

    return ordered, places, covered


def text_counts(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Keys, the text and its counts: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)."""
    rows = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("text"))
    word = "[\\x20\\x09-\\x0D]+"
    rows = rows.withColumn("_words", F.array_remove(F.split("text", word), ""))
    rows = rows.withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    n = F.size("_words")
    ordered, places, covered = repeated_words(F.col("_words"), n)
    rows = rows.select(
        *keys, "text", n.cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        ordered.alias("_ordered"),
    )
    rows = rows.withColumn("_places", places(F.col("_ordered"))).drop("_ordered")
    return rows.withColumn("n_repeat_words", covered(F.col("_places")).cast("long")).drop("_places")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def first_failure(rules: tuple[Rule, ...]) -> Column:
    """Name of the first rule that rejects, in the given order; null when none does."""
    out = None
    for rule in rules:
        when = F.when if out is None else out.when
        out = when(F.coalesce(rule.rejects(F.col), F.lit(False)), F.lit(rule.name))
    return out if out is not None else F.lit(None).cast("string")


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by rejection per cost on the first rows at hand with a text of moderate length.

    The rows are taken from as few partitions as hold them, so the sample costs the same at any size of input.
    """
    spark = docs.sparkSession
    taken = docs.select(F.col(text).alias("text")).where(F.length(text) <= SAMPLE_CHARS).limit(sample_rows).collect()
    sample = text_counts(spark.createDataFrame(taken, "text string"), ()).persist()
    try:
        n = max(1, sample.count())
        worth = {}
        for rule in rules:
            rejected = sample.select(F.sum(F.coalesce(rule.rejects(F.col), F.lit(False)).cast("long")))
            rejected.first()  # compiles
            start = time.perf_counter()
            share = (rejected.first()[0] or 0) / n
            worth[rule.name] = share / max(1e-6, time.perf_counter() - start)
    finally:
        sample.unpersist()
    return tuple(sorted(rules, key=lambda r: -worth[r.name]))


def quality_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, keys: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """Keys, counts, base_failed, kept and failed_rule (first failing rule in cascade order, ``base`` included)."""
    counted = text_counts(docs, keys, text)
    order = ordered_rules(docs, rules, text)
    failed = free_name(docs, "failed_rule")
    out = counted.withColumn(failed, F.when(base_failed(), F.lit("base")).otherwise(first_failure(order)))
    return out.select(
        *keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), F.col(failed).isNull().alias("kept"), F.col(failed).alias("failed_rule"),
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
k AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM g),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM k),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) o(j) WHERE n > 1 GROUP BY r),
c AS (SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN covered USING (r)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
             length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS caps, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 4 > n_lines * 3 OR word_chars < n_words * 2
            OR word_chars > n_words * 20 OR caps * 2 > letters OR letters * 2 < word_chars) AS kept
FROM f
"""
