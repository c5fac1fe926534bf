"""Near-duplicate classes of texts by a grouped prefix join over word shingles.

Texts with the same shingle set are one class. Shingles have one global order, rarest first (by counts of
all texts in a fixed number of buckets; any order is right, a good one is fast). Two sets that reach the
threshold share a shingle among the first ``n - ceil(t * n) + 1`` of each. Classes with the same size and the
same prefix are one group and stand in the posting lists once. Pairs from a list must pass the size bound, the
positional bound, and a parity sketch (a bit flips for each shingle that only one side has, so differing bits
never exceed the symmetric difference). All three only drop pairs that cannot reach the threshold.

Pairs of one component bring nothing new, so a list is joined in two rounds. In the first each member meets
the list's hub, the one with the fewest rarer shingles. Links are verified on whole sets and joined to
components. In the second only members outside a list's largest component meet members of other components,
and groups are expanded to all their classes. The result is the component of the full link graph.

Null or empty text: no shingles, linked with nothing, its own component. A text of one or two words has one
shingle, the whole sequence. Repeated rows each get their row, in one component; a component's id is its least
doc_id, null ids left out. Other columns are ignored, whatever their names. A set is known by a 128-bit digest,
a shingle by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bits_of, free_name, in_filter, map_rows, small_batches
from gridloom.llm.components import components
from gridloom.llm.word_hashes import word_hashes
from gridloom.session import discard, materialise

#: Buckets of shingle counts sent to every task: 1 MB, whatever the input.
BUCKETS = 1 << 18
#: Bits of the parity sketch of a set, by the largest size that takes them. Sketches of other lengths are not compared.
SKETCH_BITS = ((1_200, 1 << 10), (6_000, 1 << 12), (30_000, 1 << 14), (1 << 62, 1 << 16))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    body = text.encode("utf-8", "surrogatepass").lower() if text else b""
    one = word_hashes(body)
    if not len(one):
        return np.empty(0, np.uint64)
    if len(one) < size:
        whole = blake2b(b" ".join(body.split()), digest_size=8, person=b"whole").digest()
        return np.frombuffer(whole, np.uint64).copy()
    n = len(one) - size + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = (mixed ^ one[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def digest_of(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def bucket_counts(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Shingles of all texts counted in BUCKETS buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, n = np.zeros(BUCKETS, np.int64), [], 0
        for batch in batches:
            for value in batch.column(0):
                waiting.append((shingle_set(value.as_py(), size) & np.uint64(BUCKETS - 1)).astype(np.int32))
                n += len(waiting[-1])
                if n > 1_000_000:
                    total += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
                    waiting, n = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    small_batches(docs.sparkSession)
    counts = docs.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return out


def profiles(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Each text's set digest, size, prefix, group (digest of size and prefix) and parity sketch."""
    ranks = bucket_counts(docs, text, size)
    ranks = np.minimum(ranks, np.iinfo(np.int32).max).astype(np.int32)

    def one(row: tuple) -> tuple:
        found = shingle_set(row[1], size)
        n = len(found)
        if not n:
            return row[0], 0, None, None, None, None
        prefix_len = n - -(-percent * n // 100) + 1
        order = np.lexsort((found, ranks[found & np.uint64(BUCKETS - 1)]))[:prefix_len]
        prefix = found[order]
        group = blake2b(prefix.tobytes(), digest_size=16, salt=n.to_bytes(8, "little")).digest()
        bits = next(bits for most, bits in SKETCH_BITS if n <= most)
        odd = np.bincount((found >> np.uint64(32)).astype(np.int64) & (bits - 1), minlength=bits) & 1
        sketch = np.packbits(odd.astype(np.uint8)).view(np.int64)
        return row[0], n, digest_of(found), group, prefix.view(np.int64).tolist(), sketch.tolist()

    kind = dict(docs.dtypes)[key]
    return map_rows(
        docs.select(key, text), one,
        f"`{key}` {kind}, n long, set binary, grp binary, prefix array<long>, sketch array<long>",
    )


def sizes_and_places(x: str, y: str, percent: int) -> Column:
    """Whether two list members can reach the threshold, by their sizes and the places of the shared shingle."""
    c = lambda s, n: F.col(f"{s}.{n}")
    need = F.ceil(percent * (c(x, "n") + c(y, "n")) / (100 + percent))
    rest = F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos"))
    sizes = F.least(c(x, "n"), c(y, "n")) * 100 >= F.greatest(c(x, "n"), c(y, "n")) * percent
    return (c(x, "token") == c(y, "token")) & (c(x, "node") != c(y, "node")) & sizes & (rest >= need)


def sketches_alike(x: str, y: str, percent: int) -> Column:
    """Whether two sets can reach the threshold by their parity sketches."""
    c = lambda s, n: F.col(f"{s}.{n}")
    both = c(x, "n") + c(y, "n")
    most = both - 2 * F.ceil(percent * both / (100 + percent))
    differing = F.aggregate(
        F.zip_with(c(x, "sketch"), c(y, "sketch"), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, n: acc + n
    )
    unlike = F.size(c(x, "sketch")) != F.size(c(y, "sketch"))
    return unlike | (differing <= most)


def can_reach(x: str, y: str, percent: int) -> Column:
    """The same, and by the parity sketches; a node that stands for a group has none."""
    return sizes_and_places(x, y, percent) & (F.col(f"{x}.multi") | F.col(f"{y}.multi") | sketches_alike(x, y, percent))


def grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (grp, node, multi, n, prefix, sketch), and members (node, member, n, sketch) of those of several sets."""
    rows = rows.where("n > 0")
    groups = materialise(rows.groupBy("grp").agg(
        F.min("set").alias("node"), (F.min("set") != F.max("set")).alias("multi"), F.first("n").alias("n"),
        F.first("prefix").alias("prefix"), F.min_by("sketch", "set").alias("sketch"),
    ))
    many = materialise(groups.where("multi").select("grp", "node"))  # few, and known to be few
    members = materialise(rows.join(many, "grp").groupBy("node", F.col("set").alias("member")).agg(
        F.first("n").alias("n"), F.first("sketch").alias("sketch")
    ))
    discard(many)
    return groups, members


def posting_lists(groups: DataFrame, members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Lists (token, node, n, pos, multi) of members that can reach another one, and marks (node, n, sketch) of their sets.

    Members are first held against their lists without the sketch, so that only few rows carry one; each step is a
    table of its own, so that the files it deals out are gone before the next one.
    """
    entries = groups.select("node", "n", "multi", F.posexplode("prefix").alias("pos", "token"))
    shared = materialise(entries.groupBy("token").agg(F.count("*").alias("members")).where("members > 1").select("token"))
    common = materialise(entries.join(shared, "token", "left_semi"))
    discard(shared)
    held = materialise(common.alias("x").join(common.alias("y"), sizes_and_places("x", "y", percent), "left_semi"))
    discard(common)
    own = held.where(~F.col("multi")).select("node").distinct().join(groups.select("node", "n", "sketch"), "node")
    marks = materialise(own.unionByName(members.select(F.col("member").alias("node"), "n", "sketch")))
    discard(groups)
    entries = held.join(marks.select("node", "sketch"), "node")
    inside = members.select(
        F.xxhash64("node").alias("token"), F.col("member").alias("node"), "n", F.lit(0).alias("pos"), F.lit(False).alias("multi"), "sketch"
    )
    columns = ("token", "node", "n", "pos", "multi", "sketch")
    drawn = materialise(entries.select(*columns).unionByName(inside.select(*columns)))
    discard(held)
    lists = materialise(drawn.alias("x").join(drawn.alias("y"), can_reach("x", "y", percent), "left_semi").drop("sketch"))
    discard(drawn)
    return lists, marks


def sets_of(docs: DataFrame, text: str, wanted: DataFrame, size: int) -> DataFrame:
    """(set, shingles) of the wanted digests, read again from the texts through a filter of fixed size."""
    known = bits_of(wanted.select(F.xxhash64("set").alias("hash")), "hash")

    def one(row: tuple) -> tuple:
        found = shingle_set(row[0], size)
        if not len(found):
            return None, None
        name = digest_of(found)
        return (name, found.view(np.int64).tolist()) if in_filter(known, spark_hash(name)) else (None, None)

    sets = map_rows(docs.select(text), one, "set binary, shingles array<long>").where("set IS NOT NULL")
    return sets.dropDuplicates(["set"]).join(wanted.select("set"), "set", "left_semi")


def spark_hash(value: bytes) -> int:
    """Spark's xxhash64 of a binary value (seed 42), as an unsigned number."""
    import xxhash

    return xxhash.xxh64_intdigest(value, 42)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold, as a written table; only the sets of the pairs are dealt out."""
    pairs = materialise(pairs)
    named = materialise(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct())
    sets = sets.join(named, "set", "left_semi")
    left = sets.select(F.col("set").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("set").alias("b"), F.col("shingles").alias("sb"))

    def check(row: tuple) -> tuple:
        a, b, sa, sb = row
        both = len(np.intersect1d(np.array(sa, np.int64), np.array(sb, np.int64), assume_unique=True))
        return a, b, 100 * both >= percent * (len(sa) + len(sb) - both)

    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    linked = materialise(map_rows(rows, check, "a binary, b binary, linked boolean").where("linked").select("a", "b"))
    discard(pairs)
    discard(named)
    return linked


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of nodes to pairs of classes; a node that stands for a group becomes all its classes."""
    for side in ("a", "b"):
        own = members.select(F.col("node").alias(side), "member")
        pairs = pairs.join(own, side, "left").withColumn(side, F.coalesce("member", side)).drop("member")
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def set_components(docs: DataFrame, groups: DataFrame, members: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """(node, root) of every set that is linked to another; ``groups`` and ``members`` are deleted."""
    lists, marks = posting_lists(groups, members, percent)
    whole, members = members, members.select("node", "member")
    wanted = lists.select("node").distinct().join(members, "node", "left").select(F.explode(F.array("node", "member")).alias("set"))
    wanted = materialise(wanted.where("set IS NOT NULL").distinct())
    sets = materialise(sets_of(docs, text, wanted, size))
    discard(wanted)

    hubs = lists.groupBy("token").agg(F.min_by(F.struct("node", "n", "pos", "multi"), F.struct("pos", "n", "node")).alias("h"))
    hubs = hubs.select("token", "h.*")
    x, y = lists.alias("x"), hubs.alias("y")
    met = x.join(y, sizes_and_places("x", "y", percent)).groupBy(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")
    ).agg(F.max(F.col("x.multi") | F.col("y.multi")).alias("multi"))
    # A pair has many tokens in common; sketches are only held against each other once.
    met = materialise(met)
    first = met.join(marks.alias("x"), F.col("a") == F.col("x.node")).join(marks.alias("y"), F.col("b") == F.col("y.node"))
    links = verified(first.where(F.col("multi") | sketches_alike("x", "y", percent)).select("a", "b"), sets, percent)
    discard(met)
    labels = components(links)

    part = F.when(~F.col("multi"), F.coalesce("root", "node"))
    named = materialise(lists.join(labels, "node", "left").withColumn("part", part).drop("root"))
    discard(lists)
    per_part = named.groupBy("token", "part").agg(F.count("*").alias("n"))
    largest = per_part.groupBy("token").agg(
        F.max_by("part", F.when(F.col("part").isNotNull(), F.col("n"))).alias("largest"), F.count("*").alias("parts"), F.max(F.col("part").isNull()).alias("mixed")
    ).where("parts > 1 OR mixed").select("token", "largest")
    lists = materialise(named.join(largest, "token").withColumn("outside", F.coalesce(F.col("part") != F.col("largest"), F.lit(True))))
    discard(named)
    read, lists = lists, materialise(lists.join(marks.select("node", "sketch"), "node"))
    discard(read)
    x, y = lists.where("outside").alias("x"), lists.alias("y")
    apart = F.coalesce(F.col("x.part") != F.col("y.part"), F.lit(True))
    once = ~F.col("y.outside") | (F.col("x.node") < F.col("y.node"))
    second = x.join(y, once & apart & can_reach("x", "y", percent)).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b")
    ).distinct()
    more = verified(expanded(second, members), sets, percent)
    found = components(links.unionByName(more))
    for read in (lists, whole, marks, sets, links, more):
        discard(read)
    return found


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", *, spent: list[DataFrame] | None = None
) -> DataFrame:
    """Key, n_shingles and component_id (least key of the texts reachable by links of ``percent`` or more).

    The written tables that the result reads are added to ``spent``, for a caller that is done with it to discard.
    """
    whole = materialise(profiles(docs, key, text, size, percent))
    groups, members = grouped(whole)
    rows = materialise(whole.select(key, "n", "set"))
    discard(whole)
    roots = set_components(docs, groups, members, text, size, percent)
    full = rows.where("n > 0").select(key, "n", "set").join(roots.withColumnRenamed("node", "set"), "set", "left")
    full = full.select(key, "n", F.coalesce("root", "set").alias("part"))
    # A table of its own, so that the join below can split a component with very many texts.
    least = materialise(full.groupBy("part").agg(F.min(key).alias("component_id")))
    if spent is not None:
        spent += [rows, least]
    full = full.join(least, "part").select(key, F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select(key, F.col("n").alias("n_shingles"), F.col(key).alias("component_id"))
    return full.unionByName(alone)


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, one of each component (least id, null ids last), with their own columns.

    Only rows to be removed are joined to the documents. Rows with the same id and text are one document.
    """
    key = free_name(docs, "_key")
    name = F.concat_ws(
        ":", F.coalesce(F.lpad(F.col(ident).cast("string"), 20, "0"), F.lit("~")),
        F.xxhash64(text).cast("string"), F.xxhash64(text, F.lit(1)).cast("string"),
    )
    rows = docs.withColumn(key, name)
    spent: list[DataFrame] = []
    found = near_duplicates(rows.select(key, text), size, percent, key, text, spent=spent).groupBy(key).agg(
        F.min("component_id").alias("component_id"), F.count("*").alias("rows")
    )
    found = materialise(found.where((F.col(key) != F.col("component_id")) | (F.col("rows") > 1)))
    for read in spent:
        discard(read)
    kept = rows.join(found.where(F.col(key) != F.col("component_id")).select(key), key, "left_anti")
    again = materialise(found.where(F.col(key) == F.col("component_id")).select(key))
    if again.take(1):
        repeated = kept.join(again, key, "left_semi").dropDuplicates([key])
        kept = kept.join(again, key, "left_anti").unionByName(repeated)
    return kept.select(*[f"`{c}`" for c in docs.columns])


_SHINGLES = """
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT r, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT r, s FROM e),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
sym AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
"""
SQL = f"""
WITH RECURSIVE {_SHINGLES}
walk AS (SELECT r AS node, r AS reach FROM d UNION SELECT walk.node, sym.b FROM walk JOIN sym ON walk.reach = sym.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (r)
JOIN (SELECT node, min(o.doc_id) AS component_id FROM walk JOIN d o ON o.r = walk.reach GROUP BY node) c ON c.node = d.r
"""
