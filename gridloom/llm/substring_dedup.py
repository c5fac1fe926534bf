"""Repeated passages of ``WINDOW`` words, found through anchors at the positions of a difference cover.

A difference cover holds, for any two positions, a common offset below its period at which both are in the cover.
So of each text only the windows of ``ANCHOR`` = WINDOW - PERIOD + 1 words that start at cover positions are hashed,
and still any two equal passages of WINDOW words hold the same anchor at the same place.

An anchor found in different texts is extended. Its hub is the least document that has it. In each other document
anchors with the same hub and the same shift are chained while they overlap: the whole stretch is then equal to a
stretch of the hub, and its windows need no other look. A window that holds a shared anchor but sticks out of every
chain is compared as a whole: it is hashed (128 bits), together with the windows about the same anchors in every
other text that has them, and is repeated if a document with a smaller id has the same one. Windows about anchors
that no document needs are not hashed.

Texts with the same words are one, of the least document: the words of the others are all covered, if there are
enough for a window. Text is read as words between ASCII white space, unchanged. Null text has no words. A row
without an id is never smaller or greater than another: its words all stay and remove nothing. Rows with the same id
never remove each other's words, whether or not they have the same text; repeated rows each get their row. Texts of
any length are taken whole; other columns are ignored, whatever their names. Whatever is gathered in one row belongs
to one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import FILTER_BITS, bits_of
from gridloom.llm.word_hashes import Roll, word_hashes
from gridloom.session import materialise

WINDOW, PERIOD = 50, 21
#: A perfect difference set: every difference below PERIOD occurs.
COVER = np.array([0, 1, 4, 14, 16])
#: Anchors a shift apart by a whole period overlap, so chains of them have no gaps.
ANCHOR = WINDOW - PERIOD + 1
#: Places of one text; texts of one id are told apart by what is above.
PLACES = 40
EMPTY = sha256(b"").hexdigest()


FIRST, SECOND = Roll(0xA0761D6478BD642F), Roll(0xE7037ED1A0B428DB)


def places(n_words: int) -> np.ndarray:
    """Cover positions with a whole anchor."""
    if n_words < WINDOW:
        return np.empty(0, np.int64)
    all_of = (np.arange(0, n_words, PERIOD)[:, None] + COVER).ravel()
    return all_of[all_of <= n_words - ANCHOR]


def place_of(k: int) -> int:
    return k // len(COVER) * PERIOD + int(COVER[k % len(COVER)])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of batches whose last column is a text as bytes, one text at a time in memory beside its batch."""
    for batch in batches:
        rest = [c.to_pylist() for c in batch.columns[:-1]]
        for i, text in enumerate(batch.columns[-1]):
            yield (*(c[i] for c in rest), text.as_py() or b"")


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Batches of rows, each of about ``most`` values; the last element of a row is its number of values and is left out."""
    waiting, n = [], 0
    for row in rows:
        waiting.append(row[:-1])
        n += row[-1]
        if n >= most or len(waiting) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)
            waiting, n = [], 0
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)


def _id(column: str, ident: str) -> Column:
    return F.col(f"`{ident}`").cast("long").alias(column)


def profiles(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(doc, n_words, sha, anchors) of every row."""
    schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("anchors", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc, body in _texts(batches):
                words = body.split()
                at = places(len(words) if doc is not None else 0)
                anchors = FIRST.windows(word_hashes(body), ANCHOR)[at].view(np.int64) if len(at) else at
                yield doc, len(words), sha256(b" ".join(words)).hexdigest(), anchors, 1 + len(at)

        return _batches(rows(), schema)

    return materialise(docs.select(_id("doc", ident), F.col(f"`{text}`").cast("binary").alias("body")).mapInArrow(run, "doc long, n_words long, sha string, anchors array<long>"))


def chains(doc: int, n: int, found: list[dict]) -> tuple[list[tuple[int, int]], list[int]]:
    """Stretches of one text that equal a stretch of a smaller document, and the shared anchors that still are in a window outside of them.

    ``found`` has ``k``, ``hash``, ``hub`` (document) and ``at`` (its place) of each shared anchor of the text.
    """
    shifts: dict[tuple, list[int]] = {}
    spans: list[list[int]] = []
    held = [(place_of(x["k"]), x) for x in found if x["hub"] < doc]
    for place, x in sorted(held, key=lambda y: y[0]):
        dup, k = divmod(x["at"], 1 << PLACES)
        key = (x["hub"], dup, place - place_of(k))
        if key in shifts and place <= shifts[key][1]:
            shifts[key][1] = place + ANCHOR
        else:
            shifts[key] = [place, place + ANCHOR]
            spans.append(shifts[key])
    wide = sorted((a, b) for a, b in spans if b - a >= WINDOW)
    inside = np.zeros(n + 1, np.int64)  # window starts inside of a stretch
    for a, b in wide:
        inside[a] += 1
        inside[b - WINDOW + 1] -= 1
    known = np.concatenate(([0], np.cumsum(np.cumsum(inside)[: n - WINDOW + 1] > 0)))
    due = []
    for place, x in held:
        first, last = max(0, place - PERIOD + 1), min(place, n - WINDOW)
        if known[last + 1] - known[first] < last + 1 - first:
            due.append(x["hash"])
    return wide, due


def stretches(shared: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, dup, n_words, sha, spans, due) of every text with a shared anchor that a smaller document has."""
    hubs = shared.groupBy("hash").agg(F.min(F.struct("doc", "at")).alias("hub"))
    met = shared.join(hubs, "hash").where("hub.doc < doc")
    one = F.struct(F.expr(f"at & {(1 << PLACES) - 1}").alias("k"), "hash", F.col("hub.doc").alias("hub"), F.col("hub.at").alias("at"))
    lists = met.groupBy("doc", F.shiftright("at", PLACES).alias("dup")).agg(F.collect_list(one).alias("found"))
    lists = lists.join(texts, ["doc", "dup"])
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    schema = pa.schema([("doc", pa.int64()), ("dup", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("spans", span), ("due", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                cells = [c.to_pylist() for c in batch.columns[:-1]]
                for i, found in enumerate(batch.columns[-1]):
                    doc, dup, n, sha = (c[i] for c in cells)
                    spans, due = chains(doc, n, found.as_py())
                    yield doc, dup, n, sha, [{"a": a, "b": b} for a, b in spans], due, 1 + len(spans) + len(due)

        return _batches(rows(), schema)

    made = lists.select("doc", "dup", "n_words", "sha", "found").mapInArrow(
        run, "doc long, dup long, n_words long, sha string, spans array<struct<a: long, b: long>>, due array<long>"
    )
    return materialise(made)


def bodies(docs: DataFrame, ident: str, text: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc, ...) with the texts of its documents, as bytes.

    A filter of fixed size keeps most other texts from being dealt out; the join decides.
    """
    bits = bits_of(wanted, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) & (FILTER_BITS - 1)
            yield batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0))

    rows = docs.select(_id("doc", ident), F.col(f"`{text}`").cast("binary").alias("body")).where("doc IS NOT NULL AND body IS NOT NULL")
    rows = rows.mapInArrow(run, "doc long, body binary")
    return wanted.join(rows, "doc")


def window_rows(texts: DataFrame) -> DataFrame:
    """(w1, w2, doc, dup, p): the windows that hold an anchor of ``ks`` and are in no stretch of ``spans``."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("doc", pa.int64()), ("dup", pa.int64()), ("p", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, dup, n, sha, spans, ks, body in _texts(batches):
            words = body.split()
            if len(words) != n or sha256(b" ".join(words)).hexdigest() != sha:
                continue  # another text of this id
            wanted = np.zeros(n + 1, np.int64)
            for k in ks:
                place = place_of(k)
                wanted[max(0, place - PERIOD + 1)] += 1
                wanted[min(place, n - WINDOW) + 1] -= 1
            wanted = np.cumsum(wanted)[: n - WINDOW + 1] > 0
            for s in spans or ():
                wanted[s["a"] : s["b"] - WINDOW + 1] = False
            p = np.flatnonzero(wanted)
            if not len(p):
                continue
            one = word_hashes(body)
            w1, w2 = FIRST.windows(one, WINDOW)[p], SECOND.windows(one, WINDOW)[p]
            for at in range(0, len(p), 100_000):
                cut = slice(at, at + 100_000)
                m = len(p[cut])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w1[cut].view(np.int64)), pa.array(w2[cut].view(np.int64)), pa.array(np.full(m, doc)), pa.array(np.full(m, dup)), pa.array(p[cut])], schema=schema
                )

    return materialise(texts.select("doc", "dup", "n_words", "sha", "spans", "ks", "body").mapInArrow(run, "w1 long, w2 long, doc long, dup long, p long"))


def repeated_spans(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every row's (doc, n_words, sha, whole) and the stretches (doc, sha, spans) of words to remove.

    ``sha`` names the words of a text, ``whole`` says that all of them are removed, as a smaller document has the
    same; ``spans`` has first word and the one past the last, for the texts of which part is removed.
    """
    full = profiles(docs, ident, text)
    rows = full.select("doc", "n_words", "sha")
    names = rows.where(F.col("doc").isNotNull() & (F.col("n_words") >= WINDOW)).groupBy("sha").agg(F.min("doc").alias("doc"), F.first("n_words").alias("n_words"))
    names = materialise(names)
    same = names.groupBy("doc").agg(F.array_sort(F.collect_set("sha")).alias("all")).where(F.size("all") > 1)
    same = same.select("doc", F.posexplode("all").alias("dup", "sha"))
    texts = materialise(names.join(same, ["doc", "sha"], "left").withColumn("dup", F.coalesce("dup", F.lit(0)).cast("long")))
    held = full.join(texts.select("doc", "sha", "dup"), ["doc", "sha"]).groupBy("doc", "sha", "dup").agg(F.first("anchors").alias("anchors"))
    held = held.select("doc", "dup", F.posexplode("anchors").alias("k", "hash"))
    held = materialise(held.select("hash", "doc", (F.shiftleft("dup", PLACES) + F.col("k")).alias("at")))
    found = held.groupBy("hash").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("hash")
    shared = materialise(held.join(found, "hash", "left_semi"))
    known = stretches(shared, texts)
    due = materialise(known.select(F.explode("due").alias("hash")).distinct())
    asked = shared.join(due, "hash", "left_semi").groupBy("doc", F.shiftright("at", PLACES).alias("dup"))
    asked = asked.agg(F.collect_list(F.expr(f"at & {(1 << PLACES) - 1}")).alias("ks")).join(texts, ["doc", "dup"])
    asked = materialise(asked.join(known.select("doc", "dup", "spans"), ["doc", "dup"], "left"))
    windows = window_rows(bodies(docs, ident, text, asked))
    owners = materialise(windows.groupBy("w1", "w2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most"))
    again = windows.join(owners, ["w1", "w2"]).where("doc > least").select("doc", "dup", "p").groupBy("doc", "dup").agg(F.collect_set("p").alias("p"))
    one = known.where(F.size("spans") > 0).select("doc", "dup", "spans").join(again, ["doc", "dup"], "full")
    windows_of = F.transform("p", lambda p: F.struct(p.alias("a"), (p + WINDOW).alias("b")))
    none = F.array().cast("array<struct<a: bigint, b: bigint>>")
    cut = F.array_sort(F.concat(F.coalesce("spans", none), F.coalesce(windows_of, none)))
    spans = one.select("doc", "dup", merged(cut).alias("spans")).join(texts.select("doc", "dup", "sha"), ["doc", "dup"]).drop("dup")
    least = names.select("sha", F.col("doc").alias("_least"))
    rows = rows.join(least, "sha", "left").withColumn("whole", F.coalesce(F.col("doc") > F.col("_least"), F.lit(False))).drop("_least")
    return rows, materialise(spans)


def merged(spans: Column) -> Column:
    """Sorted stretches with overlapping and adjacent ones joined."""
    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["b"] >= s["a"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<struct<a: bigint, b: bigint>>"), step)


def kept_words(body: bytes, spans: list[dict]) -> list[bytes]:
    words, out, at = body.split(), [], 0
    for s in spans:
        out += words[at : s["a"]]
        at = s["b"]
    return out + words[at:]


def digest(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed and the digest of the words that stay."""
    rows, spans = repeated_spans(docs, ident, text)
    schema = pa.schema([("doc", pa.int64()), ("sha", pa.string()), ("gone", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for doc, sha, cut, body in _texts(batches):
                words = body.split()
                if sha256(b" ".join(words)).hexdigest() == sha:
                    kept = kept_words(body, cut)
                    yield doc, sha, len(words) - len(kept), sha256(b" ".join(kept)).hexdigest(), 1

        return _batches(made(), schema)

    cut = bodies(docs, ident, text, spans).select("doc", "sha", "spans", "body").mapInArrow(run, "doc long, sha string, gone long, kept string")
    cut = materialise(cut.dropDuplicates(["doc", "sha"]))
    rows = rows.join(cut, ["doc", "sha"], "left")
    whole = F.col("whole")
    return rows.select(
        F.col("doc").alias(ident), "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def brute_force(rows: list[tuple[int | None, str | None]], size: int = WINDOW) -> list[tuple]:
    """(id, n_words, n_removed, kept_sha256) of (id, text) rows by a dictionary of all windows."""
    from re import findall

    split = [(i, findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least: dict[tuple, int] = {}
    for i, words in split:
        for p in range(len(words) - size + 1) if i is not None else ():
            key = tuple(words[p : p + size])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        for p in range(len(words) - size + 1) if i is not None else ():
            if least[tuple(words[p : p + size])] < i:
                gone.update(range(p, p + size))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), sha256(kept.encode()).hexdigest()))
    return out
