"""Line dedup by a fixed-depth template tree.

A line's leaf is its token count and its first ``DEPTH`` tokens, where a token with a digit counts as a variable
field. A line recurs if enough different documents have it word for word, fields aside. A line template keeps the
constant tokens and makes the others variable fields too: a token is constant if at least ``SHARE`` of the lines of
the leaf have it at its place, or if so many lines have it as one of ``SUPPORTS``. Each of these gives a line a
template; any of them will do, so a leaf with many templates loses none of them. A template recurs if enough
different documents have it and enough of its tokens are constant. All lines that recur, or whose template does,
are dropped, in every document.

Documents are told apart by their whole texts: exact copies count once, and so do near copies, by the classes of
``copy_classes`` (``NEAR_SIZE`` words, ``NEAR_PERCENT``) among the texts that hold a line in question. So
copied documents stay whole, as that stage's work, however often they are copied, and neither copies nor more
input can take away what speaks for a template.

Null text stays null, empty text empty. Lines of fewer than ``MIN_TOKENS`` tokens are never dropped. Repeated
rows each get their own result. Other columns are passed on, whatever their names. Counting covers all lines of
all texts: leaves are counted first, and only lines of leaves that occur ``MIN_LINES`` times are looked at again,
picked out by a filter of fixed size that may let others through but drops none. Leaves, lines and texts are known
by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from gridloom.llm.common import bits_of, flat_map_rows, free_name, in_filter, map_rows
from gridloom.llm.copy_classes import SIGNATURE, copy_classes, signature
from gridloom.llm.jaccard_join import shingle_set
from gridloom.session import discard, materialise

DEPTH, SHARE, MIN_TOKENS = 3, 0.2, 4
#: Recurring: so many different documents for a line as it is, and for a template with variable words.
MIN_LINES, MIN_LINES_VARIED, MIN_CONSTANT = 3, 10, 0.75
#: Texts that are near copies of each other: words a shingle, and similarity.
NEAR_SIZE, NEAR_PERCENT = 5, 80
#: Lines that must have a token at its place, whatever else is in the leaf; a template is found at the one below its size.
SUPPORTS = tuple(MIN_LINES_VARIED * 8**k for k in range(10))
FIELD = "<*>"
#: Dropped lines that every worker holds at most, as 64-bit hashes.
IN_MEMORY = 1_000_000
DIGITS = frozenset("0123456789")
ANY_DIGIT = re.compile("[0-9]").search


def number(*parts: str) -> int:
    hashed = xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"))
    return hashed if hashed < 1 << 63 else hashed - (1 << 64)


def masked(line: str) -> list[str]:
    """Tokens of a line, those with a digit as a variable field."""
    tokens = line.split()
    return [t if DIGITS.isdisjoint(t) else FIELD for t in tokens] if ANY_DIGIT(line) else tokens


def leaf_of(tokens: list[str]) -> int:
    return number(str(len(tokens)), *tokens[:DEPTH])


def line_leaves(text: str | None) -> Iterator[tuple[list[str], int]]:
    """(tokens, leaf) of each line long enough to be dropped."""
    for line in (text or "").split("\n"):
        tokens = masked(line)
        if len(tokens) >= MIN_TOKENS:
            yield tokens, leaf_of(tokens)


def recurring_leaves(docs: DataFrame, text: str) -> DataFrame:
    rows = flat_map_rows(docs.select(text), lambda r: ((leaf,) for _, leaf in line_leaves(r[0])), "leaf long")
    return materialise(rows.groupBy("leaf").agg(F.count("*").alias("lines")).where(F.col("lines") >= MIN_LINES))


def line_templates(lines: DataFrame) -> DataFrame:
    """(line, template): the templates with variable words of each line, over leaves with enough lines for one."""
    whole = lines.groupBy("leaf").agg(F.sum("n").alias("lines")).where(F.col("lines") >= MIN_LINES_VARIED)
    # Written tables let the joins on a leaf with very many lines be split.
    whole = materialise(whole)
    # The first tokens are the same in the whole leaf.
    head = F.size(F.filter(F.slice("tokens", 1, DEPTH), lambda t: t != FIELD))
    lines = materialise(lines.join(whole.select("leaf"), "leaf").select("leaf", "line", "n", "tokens", F.size("tokens").alias("size"), head.alias("head")))
    tail = F.posexplode(F.slice(F.col("tokens"), F.lit(DEPTH + 1), F.size("tokens"))).alias("place", "token")
    places = lines.select("leaf", "line", "n", "size", "head", tail).where(F.col("token") != FIELD)
    tokens = places.groupBy("leaf", "place", "token").agg(F.sum("n").alias("support")).where("support >= 2").join(whole, "leaf")
    tokens = tokens.select("leaf", "place", "token", "support", (F.col("support") >= F.col("lines") * SHARE).alias("common"))
    tokens = materialise(tokens.where(F.col("common") | (F.col("support") >= SUPPORTS[0])))
    cells = places.join(tokens, ["leaf", "place", "token"]).groupBy("leaf", "line", "size", "head").agg(
        F.sort_array(F.collect_list(F.struct("place", "token", "support", "common"))).alias("cells")
    )

    def shape(constant) -> Column:
        return F.transform(F.filter("cells", constant), lambda c: F.struct(c["place"].alias("place"), c["token"].alias("token")))

    shapes = [shape(lambda c: c["common"]), *[shape(lambda c, least=least: c["support"] >= least) for least in SUPPORTS]]
    bare = F.array().cast("array<struct<place: int, token: string>>")
    made = cells.select("leaf", "line", "size", "head", F.explode(F.array_distinct(F.array(*shapes))).alias("shape"))
    made = made.unionByName(lines.select("leaf", "line", "size", "head", bare.alias("shape")))
    made = made.where(F.col("head") + F.size("shape") >= F.col("size") * MIN_CONSTANT)
    return made.select("line", F.xxhash64("leaf", "shape").alias("template")).distinct()


def classes_of(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(whole, class) of the wanted texts that have near copies among them."""
    known = bits_of(wanted, "whole").tobytes()

    def signed(row: tuple) -> Iterator[tuple]:
        if in_filter(known, whole := number(row[0] or "")):
            yield whole, *signature(shingle_set(row[0], NEAR_SIZE))

    texts = flat_map_rows(docs.select(text), signed, f"whole long, {SIGNATURE}")
    # Copies of a text are one before they are dealt out; texts that the filter let through play no part.
    texts = texts.groupBy("whole").agg(*(F.first(c).alias(c) for c in ("n", "bands", "sketch")))
    texts = materialise(texts.join(wanted, "whole", "left_semi"))
    classes = copy_classes(texts, NEAR_PERCENT)
    discard(texts)
    return classes


def recurring_templates(docs: DataFrame, text: str, found: DataFrame, templates: DataFrame) -> DataFrame:
    """(template) of ``templates`` (line, template, least) that ``least`` different documents have."""
    held = found.select("line", "whole").join(templates.select("line", "template"), "line").select("template", "whole").distinct()
    held = materialise(held)
    likely = held.groupBy("template").agg(F.count("*").alias("texts"))
    likely = materialise(likely.join(templates.select("template", "least").distinct(), "template").where("texts >= least"))
    wanted = materialise(held.join(likely.select("template"), "template", "left_semi").select("whole").distinct())
    if not wanted.take(1):
        return likely.select("template")
    classes = classes_of(docs, text, wanted)
    # Each text of a class but one adds nothing to a template's texts, so only texts with copies are counted again.
    copies = held.join(classes, "whole").groupBy("template").agg((F.count("*") - F.count_distinct("class")).alias("copies"))
    counts = likely.join(copies, "template", "left").where(F.col("texts") - F.coalesce("copies", F.lit(0)) >= F.col("least"))
    recurring = materialise(counts.select("template"))
    for read in (held, likely, wanted, classes):
        discard(read)
    return recurring


def dropped_lines(docs: DataFrame, text: str) -> DataFrame:
    """(line): hashes of the masked lines whose template recurs."""
    leaves = recurring_leaves(docs, text)
    known = bits_of(leaves, "leaf").tobytes()

    def lines_of(row: tuple) -> Iterator[tuple]:
        whole, seen = number(row[0] or ""), set()
        for tokens, leaf in line_leaves(row[0]):
            if in_filter(known, leaf) and (line := number(*tokens)) not in seen:
                seen.add(line)
                yield leaf, line, tokens, whole

    found = flat_map_rows(docs.select(text), lines_of, "leaf long, line long, tokens array<string>, whole long")
    # The tokens are a function of the line; copies of a text are one before they are dealt out.
    found = found.groupBy("leaf", "line", "whole").agg(F.first("tokens").alias("tokens"))
    found = materialise(found.join(leaves.select("leaf"), "leaf", "left_semi"))
    lines = materialise(found.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.first("tokens").alias("tokens")))
    same = lines.where(F.col("n") >= MIN_LINES).select("line", F.xxhash64("line").alias("template"), F.lit(MIN_LINES).alias("least"))
    templates = materialise(same.unionByName(line_templates(lines).withColumn("least", F.lit(MIN_LINES_VARIED))))
    recurring = recurring_templates(docs, text, found, templates)
    dropped = materialise(templates.join(recurring, "template", "left_semi").select("line").distinct())
    for read in (leaves, found, lines, templates, recurring):
        discard(read)
    return dropped


def without(text: str | None, dropped) -> tuple[str | None, int, int]:
    """The text without dropped lines, its lines, and how many were dropped."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    kept = []
    for line in lines:
        tokens = masked(line)
        if len(tokens) < MIN_TOKENS or number(*tokens) not in dropped:
            kept.append(line)
    return ("\n".join(kept) if len(kept) < len(lines) else text), len(lines), len(lines) - len(kept)


def clean_lines(docs: DataFrame, text: str = "text", in_memory: int = IN_MEMORY) -> tuple[DataFrame, str, str, str]:
    """The rows with three more columns, and their names: the text without recurring lines, its lines, and those dropped."""
    lines = dropped_lines(docs, text)
    known = lines.limit(in_memory + 1).collect()
    new, n_lines, n_dropped = (free_name(docs, c) for c in ("_clean", "_n_lines", "_n_dropped"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", {new} string, {n_lines} long, {n_dropped} long"
    at = docs.columns.index(text)
    if len(known) <= in_memory:
        dropped = frozenset(r["line"] for r in known)
        return map_rows(docs, lambda row: (*row, *without(row[at], dropped)), schema), new, n_lines, n_dropped
    row_id, found = free_name(docs, "_row"), free_name(docs, "_found")
    rows = materialise(docs.withColumn(row_id, F.monotonically_increasing_id()))
    bits = bits_of(lines, "line").tobytes()

    def candidates(row: tuple) -> Iterator[tuple]:
        for line in (row[1] or "").split("\n"):
            tokens = masked(line)
            if len(tokens) >= MIN_TOKENS and in_filter(bits, hashed := number(*tokens)):
                yield row[0], hashed

    hits = flat_map_rows(rows.select(row_id, text), candidates, f"{row_id} long, line long").join(lines, "line", "left_semi")
    hits = hits.groupBy(row_id).agg(F.collect_set("line").alias(found))
    rows = rows.join(hits, row_id, "left").drop(row_id)
    rows = map_rows(rows, lambda row: (*row[:-1], *without(row[at], frozenset(row[-1] or ()))), schema)
    return rows, new, n_lines, n_dropped


def drop_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their own columns and cleaned texts; ``n_chars``, where there is one, follows the text.

    A document whose every word was in dropped lines is left out.
    """
    rows, new, _, n_dropped = clean_lines(docs, text)
    emptied = (F.col(n_dropped) > 0) & ~F.col(new).rlike("\\S")
    kinds = dict(docs.dtypes)

    def column(c: str) -> Column:
        if c == text:
            return F.col(new).alias(c)
        if c == "n_chars":
            return F.when(F.col(n_dropped) > 0, F.length(new).cast(kinds[c])).otherwise(F.col(c)).alias(c)
        return F.col(f"`{c}`")

    return rows.where(~F.coalesce(emptied, F.lit(False))).select(*map(column, docs.columns))
