"""Benchmark decontamination: a prefix-filtered join of word shingles, verified over item-sized windows.

An item is cut into windows of ``size`` consecutive words (a shorter item is one window), a window into
3-word shingles (a shorter window is one shingle). Shingles are ordered by how often they occur in all
documents; a document that holds a window holds its rarest shingle, so that one is the window's prefix and
the only one joined. A match fixes the window's start, which must lie inside the document with the window's
length; the window is then compared place by place.

Null or empty text: no words, nothing hit. An item without words has no window. An item id that repeats is
one item with the windows of all its rows; a null item id counts in no document. Repeated documents each get
their own row. Other columns are ignored, whatever their names. Nothing is capped: the only shuffled rows are
shingles of the benchmark that occur in documents, and the join of a shingle in very many of them is one that
Spark may split.

Shingles have 64-bit ids. Documents are matched by the words themselves while the benchmark's shingles are
at most ``IN_MEMORY``; beyond that, all shingles of the documents are joined by id.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import free_name, lower_ascii, map_rows
from gridloom.session import materialise

SIZE, SHINGLE = 10, 3
#: Shingles of a benchmark held by every worker at most (some 100 bytes each).
IN_MEMORY = 500_000

_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
_FOLD = bytes(c if c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def words_column(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def shingle_id(words: Column) -> Column:
    return F.xxhash64(F.array_join(words, " "))


def item_windows(benchmark: DataFrame, size: int = SIZE, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: n (words), shingles (arrays of words), keys (their ids), items (sorted item ids as text)."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), words_column(F.col(text)).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    rows = rows.where((F.size("words") > 0) & F.col("item").isNotNull()).select(
        "item", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, size))).alias("window")
    )
    rows = rows.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    n = F.size("window")
    inside = F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0)))
    rows = rows.withColumn("shingles", F.transform(inside, lambda i: F.slice("window", i + 1, SHINGLE)))
    return rows.select(n.alias("n"), "shingles", F.transform("shingles", shingle_id).alias("keys"), "items")


HITS = "array<struct<pos: int, key: long>>"


def hits_in_memory(docs: DataFrame, key: str, text: str, shingles: list[tuple[list[str], int]]) -> DataFrame:
    """Document rows with the places of benchmark shingles, found by a word tree that every worker holds."""
    tree: dict = {}
    for words, number in shingles:
        reduce(lambda node, w: node.setdefault(w.encode(), {}), words, tree)[None] = number

    def find(row: tuple) -> tuple:
        words, hits = words_of(row[1]), []
        for pos, word in enumerate(words):
            node, at = tree.get(word), pos
            while node is not None:
                if None in node:
                    hits.append({"pos": pos, "key": node[None]})
                at += 1
                node = node.get(words[at]) if at < len(words) else None
        return row[0], len(words), hits

    kind = dict(docs.dtypes)[key]
    return map_rows(docs.select(key, text), find, f"`{key}` {kind}, n_words long, hits {HITS}")


def hits_by_join(docs: DataFrame, key: str, text: str, shingles: DataFrame) -> DataFrame:
    """The same rows by a join of all shingles of the documents with those of the benchmark."""
    rows = materialise(docs.select(key, words_column(F.col(text)).alias("words")).withColumn("_row", F.monotonically_increasing_id()))
    # Ids are made inside the row, so that no exploded row carries a whole text.
    one = lambda n: F.transform(F.sequence(F.lit(0), F.size("words")), lambda i: F.struct(
        i.alias("pos"), F.lit(n).alias("n"), shingle_id(F.slice("words", i + 1, n)).alias("key")
    ))
    found = rows.select("_row", F.inline(F.concat(*[one(n) for n in range(1, SHINGLE + 1)])))
    found = found.join(shingles.select(F.size("words").alias("n"), "key"), ["n", "key"])
    found = found.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("pos", "key"))).alias("hits"))
    return rows.join(found, "_row", "left").select(
        key, F.size("words").cast("long").alias("n_words"), F.coalesce("hits", F.array().cast(HITS)).cast(HITS).alias("hits")
    )


def verify(n_words: int, hits: list, found: list | None) -> tuple[list[tuple[int, int]], set[str]]:
    """Windows (start, end) and items that really occur, from the places of prefix shingles."""
    places, spans, items = {(h["pos"], h["key"]) for h in hits}, set(), set()
    for match in found or ():
        for window in match["windows"]:
            start = match["pos"] - window["offset"]
            if start < 0 or start + window["n"] > n_words:
                continue
            if all((start + j, k) in places for j, k in enumerate(window["keys"])):
                spans.add((start, start + window["n"]))
                items.update(window["items"])
    return sorted(spans), items


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", in_memory: int = IN_MEMORY,
) -> DataFrame:
    """Key, n_words, windows (array of start and end word of occurring windows) and items (sorted ids) of each document."""
    windows = materialise(item_windows(benchmark, size, item, item_text))
    shingles = windows.select(F.explode(F.arrays_zip("shingles", "keys")).alias("s")).select(
        F.col("s.shingles").alias("words"), F.col("s.keys").alias("key")
    ).distinct()
    known = shingles.limit(in_memory + 1).collect()
    if len(known) <= in_memory:
        rows = hits_in_memory(docs, key, text, [(r["words"], r["key"]) for r in known])
    else:
        rows = hits_by_join(docs, key, text, shingles)
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()))
    places = rows.select("_row", F.inline("hits"))
    counts = places.groupBy("key").agg(F.count("*").alias("count"))
    # A window whose rarest shingle occurs nowhere drops out here.
    spread = windows.select("n", "keys", "items", F.posexplode("keys").alias("offset", "key"))
    rare = spread.join(counts, "key", "left").groupBy("n", "keys", "items").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "key", "offset")).alias("rarest")
    ).where(F.col("rarest.count") > 0)
    prefixes = rare.groupBy(F.col("rarest.key").alias("key")).agg(
        F.collect_list(F.struct(F.col("rarest.offset").alias("offset"), "n", "keys", "items")).alias("windows")
    )
    prefixes = materialise(prefixes)  # a table of its own: its size is known, and a shingle found everywhere can be split
    found = places.join(prefixes, "key").groupBy("_row").agg(F.collect_list(F.struct("pos", "windows")).alias("found"))

    def check(row: tuple) -> tuple:
        ident, n_words, hits, matches = row
        spans, items = verify(n_words, hits, matches)
        return ident, n_words, [{"start": s, "end": e} for s, e in spans], sorted(items)

    schema = f"`{key}` {dict(docs.dtypes)[key]}, n_words long, windows array<struct<start: int, end: int>>, items array<string>"
    return map_rows(rows.join(found, "_row", "left").select(key, "n_words", "hits", "found"), check, schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no window of an item, with their own columns.

    A document is known by a hash of its text, so the texts themselves are not dealt out: what is joined is the
    hash of those that are hit.
    """
    own, hit = free_name(docs, "_text"), free_name(docs, "_hit")
    name = lambda frame: frame.withColumn(own, F.concat(F.xxhash64(text).cast("string"), F.lit(":"), F.xxhash64(text, F.lit(1)).cast("string")))
    found = contamination(name(docs.select(text)).select(own, text), benchmark, key=own, text=text)
    found = materialise(found.where(F.size("windows") > 0).select(F.col(own).alias(hit)).distinct())
    rows = name(docs)
    return rows.join(found, F.col(own) == F.col(hit), "left_anti").select(*[f"`{c}`" for c in docs.columns])


def covered_words(windows: Column) -> Column:
    """Words inside any of the windows, given in order of their start."""
    step = lambda acc, w: F.struct(
        (acc["n"] + F.greatest(F.lit(0), w["end"] - F.greatest(w["start"], acc["last"]))).alias("n"),
        F.greatest(acc["last"], w["end"]).alias("last"),
    )
    return F.aggregate(windows, F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")), step)["n"]


def digest(found: DataFrame) -> DataFrame:
    n_hit = covered_words(F.col("windows")).cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[object, str | None]], size: int = SIZE) -> tuple:
    """The digest of one text by comparing every window with every place; for tests."""
    words, hit, names = words_of(text), set(), set()
    for name, body in items:
        own = words_of(body)
        n = min(size, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if name is not None and words[at : at + n] == own[i : i + n]:
                    hit.update(range(at, at + n))
                    names.add(str(name))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(words), len(hit), len(names), digest, bool(hit)


_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bi AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bi),
lens AS (SELECT DISTINCT n FROM win),
di AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
hits AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM di),
m AS (SELECT h.r, h.i, h.n, win.item_id FROM hits h JOIN win ON h.n = win.n AND h.k = win.k),
hit AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT r, i, unnest(range(0, n)) AS j FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
       FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
