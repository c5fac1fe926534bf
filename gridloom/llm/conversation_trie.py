"""Prefix trie of conversations as a z-fast trie in tables.

A prefix is known by a 128-bit hash: the exclusive or of one hash for each (place, role and text), so a prefix and
its parent give each other in one step. The compacted trie keeps the nodes where a conversation ends or several
continue; such a node has its depth (its extent), the depth of its parent, and a conversation that passes through
it, whose rows are the edge above it. Its handle is its prefix at the two-fattest number (the one with most trailing
zero bits) between the two depths, and a table from handles to nodes is all that a search needs.

Conversations with the same turns are one. The others are inserted in batches. A batch finds its exit nodes by fat
binary search: each round looks up, for all conversations at once, the prefix at the two-fattest depth of what is
left of their range, so a batch needs as many rounds as the longest conversation has binary digits, however much of
it is in the trie already. What a batch shares with the trie is not dealt out again: edges are split at the exit
depth, and only turns below it are grouped to find where the members of the batch themselves part.

Sums over subtrees are taken on the compacted trie by doubling: each round adds what is twice as far below. At the
end edges are expanded to one row a prefix.

Everything is in rows, one a turn: no conversation, node or group is collected. Turns of very long conversations
are numbered in ranges and their hashes are combined in blocks. The ids that end in a node are digested in sorted
order by runs; only their digest needs them in one place, as text that streams through.

Rows without a conv_id belong to no conversation. Null role or text is empty. Turns are ordered by ``turn``, null
first, then by role and by a hash of the text, so ties and repeated rows (each is a turn) have one order. The
remainder of a negative id is negative, as in SQL. No conversations: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import materialise

#: Conversations go in by these shares of their hashes; what is common is in the trie after the first.
BATCHES = (32, 1)
#: Turns whose hashes and words are combined at once.
BLOCK = 4096
#: Ids whose text is joined before they are dealt to their node's digest.
RUN = 4096
WORD = r"[^\x20\x09-\x0D]+"
SHARED, EVERY, HASHES = 20, 4, ("h1", "h2")


def numbered(turns: DataFrame, ident: str) -> DataFrame:
    """(conv_id, i, x1, x2, w): each turn's place from 1, content hashes and words; a long conversation is numbered in ranges."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where(F.col(ident).isNotNull()).select(
        F.col(ident).cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("x1"),
        F.xxhash64(F.lit(2), role, text).alias("x2"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("w"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("x1"), F.col("x2")]
    rows = materialise(rows.repartitionByRange(F.col("conv_id"), *order).withColumn("part", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)).alias("i")
    counts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("conv_id", "part", before.alias("before")).where("before IS NOT NULL")
    placed = rows.select("conv_id", "part", local, "x1", "x2", "w").join(before, ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("i") + F.coalesce("before", F.lit(0))).alias("i"), "x1", "x2", "w")


def running(rows: DataFrame, key: list[str], place: str, parts: dict[str, Column], total) -> DataFrame:
    """``rows`` with, under each name, ``total`` of an expression over the rows of the key up to and with this place."""
    block = F.shiftright(place, BLOCK.bit_length() - 1)
    rows = rows.withColumns({f"_{n}": x for n, x in parts.items()} | {"_block": block})
    local = Window.partitionBy(*key, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*key, "_block").agg(*[total(f"_{n}").alias(f"_{n}") for n in parts])
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*key, "_block", *[total(f"_{n}").over(before).alias(f"_before_{n}") for n in parts]).where(F.col(f"_before_{next(iter(parts))}").isNotNull())
    done = rows.withColumns({n: total(f"_{n}").over(local) for n in parts}).join(sums, [*key, "_block"], "left")
    join = {n: F.when(F.col(f"_before_{n}").isNull(), F.col(n)).otherwise(_both(total, n)) for n in parts}
    return done.withColumns(join).drop("_block", *[f"_{n}" for n in parts], *[f"_before_{n}" for n in parts])


def _both(total, name: str) -> Column:
    a, b = F.col(name), F.col(f"_before_{name}")
    return a.bitwiseXOR(b) if total is F.bit_xor else a + b


def rebuilt(own: DataFrame, shared: int = SHARED, every: int = EVERY) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, d, x1, x2, w) and lengths (conv_id, length) of conversations that open with turns of another one.

    Conversation c takes the first h turns of c - c % shared, h = crc32(c) % every, and its own after its first h.
    """
    c = F.col("conv_id")
    sizes = materialise(own.groupBy("conv_id").agg(F.max("i").alias("n")))
    plan = sizes.select("conv_id", "n", (c - c % shared).alias("base"), (F.crc32(c.cast("string")) % every).alias("h"))
    plan = plan.join(sizes.select(c.alias("base"), F.col("n").alias("base_n")), "base", "left")
    plan = materialise(plan.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))))
    mine = own.join(plan.select("conv_id", "h", "taken"), "conv_id").where("i > h").withColumn("d", F.col("i") - F.col("h") + F.col("taken"))
    heads = own.where(F.col("i") < every).select(c.alias("base"), "i", "x1", "x2", "w")
    heads = heads.join(plan.where("taken > 0").select("conv_id", "base", "taken"), "base").where("i <= taken").withColumn("d", F.col("i"))
    lengths = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    columns = ("conv_id", "d", "x1", "x2", "w")
    return mine.select(*columns).unionByName(heads.select(*columns)), lengths


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, d, h, up, w): the hash of each prefix and of its parent."""
    one = {h: F.xxhash64("d", x, F.lit(k)) for k, (h, x) in enumerate(zip(HASHES, ("x1", "x2")))}
    rows = running(turns, ["conv_id"], "d", one, F.bit_xor)
    up = F.struct(*[F.col(h).bitwiseXOR(one[h]).alias(h) for h in HASHES])
    return materialise(rows.select("conv_id", "d", F.struct(*HASHES).alias("h"), up.alias("up"), "w"))


def _root() -> Column:
    return F.struct(*[F.lit(0).cast("long").alias(h) for h in HASHES])


def fattest(low: str, high: str) -> Column:
    """The number in (low, high] with most trailing zero bits."""
    keep = f"length(bin({low} ^ {high})) - 1"
    return F.expr(f"shiftleft(shiftright({high}, {keep}), {keep})")


def with_handles(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes (h, e, p, rep) with the hash at their two-fattest depth and at the first depth of their edge."""
    at = paths.select(F.col("conv_id").alias("rep"), F.col("d"), F.col("h").alias("at"))
    rows = nodes.select("*", fattest("p", "e").alias("f"))
    rows = rows.join(at.withColumnRenamed("d", "f").withColumnRenamed("at", "handle"), ["rep", "f"])
    first = at.select("rep", F.col("at").alias("first"), (F.col("d") - 1).alias("p"))
    return materialise(rows.join(first, ["rep", "p"]).select("h", "e", "p", "rep", "handle", "first"))


def exits(batch: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, length, lcp, exit, exit_p): how deep each conversation is in the trie, and the edge it leaves inside of."""
    at = paths.select("conv_id", F.col("d").alias("f"), F.col("h").alias("handle"))
    state = materialise(batch.select("conv_id", "length", F.lit(0).cast("long").alias("a"), F.col("length").alias("b")))
    done = None
    while True:
        over = state.where("a >= b").select("conv_id", "length", "a")
        done = over if done is None else done.unionByName(over)
        active = state.where("a < b").withColumn("f", fattest("a", "b"))
        if not active.take(1):
            break
        met = active.join(at, ["conv_id", "f"]).join(
            nodes.select("handle", F.col("h").alias("extent"), "e", "p"), "handle", "left"
        )
        whole = met.join(at.select("conv_id", F.col("f").alias("e"), F.col("handle").alias("here")), ["conv_id", "e"], "left")
        inside = F.coalesce(F.col("here") == F.col("extent"), F.lit(False))
        # A handle that fits above an extent that does not: the parent is the last node passed.
        a = F.when(inside, F.col("e")).when(F.col("e").isNotNull(), F.col("p")).otherwise(F.col("a"))
        b = F.when(inside, F.col("b")).when(F.col("e").isNotNull(), F.col("p")).otherwise(F.col("f") - 1)
        state = materialise(whole.select("conv_id", "length", a.alias("a"), b.alias("b")))
    done = materialise(done)
    steps = done.where("a < length").withColumn("f", F.col("a") + 1).join(at, ["conv_id", "f"])
    edges = nodes.select(F.col("first").alias("handle"), F.col("h").alias("exit"), F.col("e").alias("exit_e"), F.col("p").alias("exit_p"), "rep")
    edge = materialise(steps.join(edges, "handle").select("conv_id", "exit", "exit_e", "exit_p", "rep", "length"))
    along = edge.join(paths.select("conv_id", "d", "h"), "conv_id").where("d > exit_p AND d <= exit_e")
    same = paths.select(F.col("conv_id").alias("rep"), "d", "h")
    deep = along.join(same, ["rep", "d", "h"]).groupBy("conv_id").agg(F.max("d").alias("deep"))
    found = done.join(edge.drop("length"), "conv_id", "left").join(deep, "conv_id", "left")
    return materialise(found.select("conv_id", "length", F.coalesce("deep", "a").alias("lcp"), "exit", "exit_p"))


def inserted(batch: DataFrame, paths: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """The nodes of the trie after a batch (conv_id, length, end) of different conversations."""
    if nodes is None:
        none = F.lit(None)
        found = batch.select("conv_id", "length", F.lit(0).cast("long").alias("lcp"), _root().alias("exit"), none.cast("long").alias("exit_p"))
    else:
        found = exits(batch, paths, nodes)
    tails = materialise(paths.join(found.select("conv_id", "lcp"), "conv_id").where("d > lcp"))
    parted = tails.where("d - 1 > lcp").groupBy("up").agg(
        F.min("h").alias("least"), F.max("h").alias("most"), F.max("d").alias("d"), F.min("conv_id").alias("rep")
    ).where("least <> most")
    ends = found.where("length > lcp").join(batch.select("conv_id", "end"), "conv_id").select(F.col("end").alias("h"), F.col("length").alias("e"), F.col("conv_id").alias("rep"))
    new = parted.select(F.col("up").alias("h"), (F.col("d") - 1).alias("e"), "rep").unionByName(ends)
    new = materialise(new.groupBy("h").agg(F.max("e").alias("e"), F.min("rep").alias("rep")))
    # The node above a new one on its conversation's path: the last new one, else the exit position, a node by now.
    marked = tails.join(new.select("h", F.col("rep").alias("owner")), "h", "left")
    last = F.max(F.when(F.col("owner").isNotNull(), F.col("d"))).over(Window.partitionBy("conv_id").orderBy("d").rowsBetween(Window.unboundedPreceding, -1))
    own = marked.withColumn("p", F.coalesce(last, "lcp")).where("owner = conv_id")
    grown = own.select("h", F.col("d").alias("e"), "p", F.col("conv_id").alias("rep"))
    if nodes is None:
        return with_handles(materialise(grown), paths)
    cut = found.where("exit_p IS NOT NULL AND lcp > exit_p").join(paths.select("conv_id", F.col("d").alias("lcp"), "h"), ["conv_id", "lcp"])
    cut = cut.join(nodes.select(F.col("h").alias("exit"), F.col("e").alias("exit_e")), "exit").where("lcp < exit_e")
    cut = materialise(cut.groupBy("h").agg(F.max("lcp").alias("e"), F.min("conv_id").alias("rep"), F.first("exit").alias("exit"), F.first("exit_p").alias("exit_p")))
    above = F.lag("e").over(Window.partitionBy("exit").orderBy("e"))
    cuts = cut.select("h", "e", F.coalesce(above, "exit_p").alias("p"), "rep")
    lowest = cut.groupBy(F.col("exit").alias("h")).agg(F.max("e").alias("cut"))
    kept = nodes.select("h", "e", "p", "rep").join(lowest, "h", "left").withColumn("p", F.coalesce("cut", "p")).drop("cut")
    return with_handles(materialise(kept.unionByName(cuts).unionByName(grown)), paths)


def subtree(tree: DataFrame, values: dict[str, tuple]) -> DataFrame:
    """(h, up, names) with, under each name, the aggregate of a column over the node and all nodes below it.

    ``values`` gives each name its aggregate function and the one that joins two results. ``up`` is the parent's
    hash; rounds grow with the logarithm of the height.
    """
    state = materialise(tree.select("h", F.col("up").alias("far"), *values))
    while state.where("far IS NOT NULL").take(1):
        below = state.where("far IS NOT NULL").groupBy(F.col("far").alias("h")).agg(*[f(n).alias(f"_{n}") for n, (f, _) in values.items()])
        jump = state.where("far IS NOT NULL").select("h", F.col("far").alias("mid")).where(F.col("mid") != _root())
        jump = jump.join(state.select(F.col("h").alias("mid"), F.col("far").alias("next")), "mid").select("h", "next")
        added = {n: both(F.col(n), F.col(f"_{n}")) for n, (_, both) in values.items()}
        state = materialise(state.join(below, "h", "left").withColumns(added).join(jump, "h", "left").select("h", F.col("next").alias("far"), *values))
    return state


def _plus(a: Column, b: Column) -> Column:
    return a + F.coalesce(b, F.lit(0))


def id_digests(members: DataFrame) -> DataFrame:
    """(h, ends_sha256) of (h, conv_id): SHA-256 of the decimal ids in numerical order, comma-joined."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != key or len(ids) >= RUN:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = row[:2], []
                ids.append(row[2])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip((*key, ids[0], ",".join(map(str, ids))))], names=names)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = row[:2], sha256()
                else:
                    state.update(b",")
                state.update(row[3].encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*HASHES, "ends_sha256"])
                out = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip((*key, state.hexdigest()))], names=[*HASHES, "ends_sha256"])

    names = [*HASHES, "least", "ids"]
    rows = members.select("h.*", "conv_id").repartitionByRange(*HASHES, "conv_id").sortWithinPartitions(*HASHES, "conv_id")
    parts = rows.mapInArrow(runs, "h1 long, h2 long, least long, ids string")
    parts = parts.repartition(*HASHES).sortWithinPartitions(*HASHES, "least")
    return parts.mapInArrow(digests, "h1 long, h2 long, ends_sha256 string").select(F.struct(*HASHES).alias("h"), "ends_sha256")


def prefix_trie(turns: DataFrame, ident: str = "conv_id", *, shared: int = SHARED, every: int = EVERY, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    own = materialise(numbered(turns, ident))
    built, lengths = rebuilt(own, shared, every)
    paths = prefixes(built)
    ends = lengths.join(paths.select("conv_id", F.col("d").alias("length"), F.col("h").alias("end")), ["conv_id", "length"], "left")
    ends = materialise(ends.select("conv_id", "length", F.coalesce("end", _root()).alias("end")))
    kinds = materialise(ends.groupBy("end").agg(F.min("conv_id").alias("conv_id"), F.max("length").alias("length"), F.count("*").alias("n")))
    paths = materialise(paths.join(kinds.select("conv_id"), "conv_id", "left_semi"))
    nodes, rest = None, kinds.where("length > 0").withColumn("deal", F.xxhash64("conv_id", F.lit("batch")))
    for k, share in enumerate(batches):
        here = F.pmod("deal", F.lit(share)) == 0
        for wider in batches[:k]:
            here = here & (F.pmod("deal", F.lit(wider)) != 0)
        nodes = inserted(rest.where(here), paths, nodes)

    above = paths.select(F.col("conv_id").alias("rep"), F.col("d").alias("p"), F.col("h").alias("up"))
    tree = nodes.select("h", "e", "p", "rep").join(above, ["rep", "p"], "left").withColumn("up", F.coalesce("up", _root()))
    top = kinds.limit(1).select(_root().alias("h"), F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("p"), F.lit(None).cast("long").alias("rep"))
    tree = materialise(tree.unionByName(top.withColumn("up", F.lit(None).cast("struct<h1: bigint, h2: bigint>")), allowMissingColumns=True))
    children = tree.groupBy(F.col("up").alias("h")).agg(F.count("*").alias("n_children"))
    full = tree.join(children, "h", "left").join(kinds.select(F.col("end").alias("h"), "n", F.col("conv_id").alias("least")), "h", "left")
    full = materialise(full.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "n": F.coalesce("n", F.lit(0))}).withColumn("leaves", (F.col("n_children") == 0).cast("long")))
    own_sums = {"n": (F.sum, _plus), "least": (F.min, F.least), "leaves": (F.sum, _plus)}
    sums = subtree(full, own_sums)
    full = full.select("h", "e", "p", "rep", "up", "n_children").join(sums.select("h", *own_sums), "h")

    edges = full.select("h", "e", "p", "n", "rep").join(paths.select(F.col("conv_id").alias("rep"), "d", "w"), "rep").where("d > p AND d <= e")
    edges = edges.select("h", "d", ((F.col("n") - 1) * F.col("w")).alias("worth"))
    edges = materialise(running(edges, ["h"], "d", {"so_far": F.col("worth")}, F.sum))
    worth = edges.groupBy("h").agg(F.sum("worth").alias("saved"))
    full = materialise(full.join(worth, "h", "left").withColumn("saved", F.coalesce("saved", F.lit(0))))
    saved = subtree(full, {"saved": (F.sum, _plus)}).select("h", "saved")
    full = materialise(full.drop("saved").join(saved, "h"))
    full = full.join(full.select(F.col("h").alias("up"), F.col("least").alias("up_least")), "up", "left")
    full = full.join(id_digests(ends.select(F.col("end").alias("h"), "conv_id")), "h", "left")

    rows = full.join(edges, "h", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    bottom = F.col("d") == F.col("e")
    return rows.select(
        F.col("least").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") == F.col("p") + 1, F.col("up_least")).when(F.col("d") > 0, F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(bottom, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("saved") - F.coalesce(F.col("so_far") - F.col("worth"), F.lit(0))).alias("saved_tokens"),
        F.coalesce(F.when(bottom, F.col("ends_sha256")), F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def brute_force(rows: list[tuple]) -> list[tuple]:
    """Nodes of (conv_id, turn, role, text) rows by plain dictionaries, in the columns of ``prefix_trie``."""
    from re import findall
    from zlib import crc32

    own: dict[int, list] = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    full = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))  # the remainder has the sign of c, as in SQL
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members: dict[tuple, list] = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids: dict[tuple, list] = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        own_words = len(findall(WORD, node[-1][1])) if node else 0
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = (len(members[node]) - 1) * own_words + sum(saved[k] for k in below)
        ends = ",".join(map(str, sorted(c for c in members[node] if full[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(below), leaves[node], saved[node], sha256(ends.encode()).hexdigest()))
    return out
