"""Exact Lloyd clustering of vectors with heap-ordered bounds.

A vector that was compared with every centroid knows its gap: the distance to the nearest of the other centroids
less the distance to its own. When centroids move, the gap shrinks by no more than the move of its own centroid and
the largest move of another. Each cluster adds these up to an offset that never falls, and an entry's key is its gap
plus its cluster's offset at that time. While the key is above the offset, the vector cannot have changed its
cluster; once the offset reaches the key, the entry is popped and the vector is compared with all centroids again.

Entries are only ever appended, one written table a round: as offsets never fall, those popped in a round are the
ones with keys between a cluster's last offset and its new one, so no table is rewritten. Vectors are written once,
bucketed by row, so popped entries come to them and the vectors stay where they are. Centroids follow from the sums
of the vectors that changed their cluster; the driver holds ``k`` centroids and as many sums, never vectors.

Components are integers, ``floor(SCALE * x)``; distances, sums and means are exact, ties go to the smaller cluster
number. Bounds are floating point with a margin, so a near tie is compared again, never guessed. Vectors without
exactly ``dim`` components, or with a null or non-finite one, are left out. Repeated rows each get their own result;
a null id can be clustered and is a first centroid only if there are too few others. Fewer vectors than ``k``: as
many centroids as vectors. No vectors: no rows. Components are held in 64 bits, greater ones are taken as the
nearest such number; a distance or sum that does not fit 64 bits is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256
from math import isqrt, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import materialise

SCALE, DIM, CLUSTERS, ROUNDS = 1024, 64, 8, 10
#: Components up to this size have distances below 2**62; greater ones are computed in Python's own integers.
SAFE = 1 << 27
#: Margin of the bounds, as a share of what they were computed from; doubles are good to 1e-16.
MARGIN = 1e-9
LONG = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, ident: str, column: str, dim: int) -> DataFrame:
    """(row, id, v) of the vectors that are kept, ``row`` naming each, bucketed by it."""
    finite = F.forall(column, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))) & ~F.isnan(x.cast("double")))
    kept = vectors.where(F.coalesce((F.size(column) == dim) & finite, F.lit(False)))
    whole = F.transform(column, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = kept.select(F.monotonically_increasing_id().alias("row"), F.col(ident).alias("id"), whole.alias("v"))
    return materialise(rows, "row")


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r.v) for r in rows.orderBy(name.asc_nulls_last(), "row").limit(k).select("v").collect()]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return flat if not flat.size or max(-int(flat.min()), int(flat.max())) <= SAFE else flat.astype(object)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each vector to each centroid, exact."""
    if centroids.size and max(-int(centroids.min()), int(centroids.max())) <= SAFE and vectors.dtype != object:
        centroids = centroids.astype(np.int64)
    else:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], axis=1)


def rescanned(rows: DataFrame, centroids: list[list[int]], offsets: list[float], dim: int) -> DataFrame:
    """New entries (row, cluster, key) of the given (row, was, v), and per task and cluster the sums that moved.

    A row with a null key holds, for its cluster, the componentwise sum and last the number of the vectors that came,
    less those that left.
    """
    k, c, drift = len(centroids), np.array(centroids, object), np.array(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved, any_row = np.zeros((k, dim + 1), object), None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                row = part.column(0).to_numpy()
                was = part.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
                vectors = matrix(part.column(2), dim)
                d = squared(vectors, c)
                best = np.argmin(d, 1)
                own = np.sqrt(d[np.arange(len(d)), best].astype(float))
                if k > 1:
                    others = d.astype(float)
                    others[np.arange(len(d)), best] = np.inf
                    nearest = np.sqrt(others.min(1))
                else:
                    nearest = np.full(len(d), np.inf)
                far = np.where(np.isinf(nearest), own, nearest)
                key = nearest - own + drift[best] - MARGIN * (far + own + drift[best] + 1)
                for j in range(k):
                    for there, sign in ((best == j, 1), (was == j, -1)):
                        there &= best != was
                        if there.any():
                            wide = vectors[there] if vectors.dtype == object else vectors[there].astype(np.int64)
                            moved[j, :dim] += sign * wide.sum(0).astype(object)
                            moved[j, dim] += sign * int(there.sum())
                any_row = int(row[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row), pa.array(best.astype(np.int32)), pa.array(key), pa.nulls(len(row), pa.list_(pa.decimal128(38, 0)))], names=names
                )
        changed = [j for j in range(k) if any(moved[j])]
        if changed:
            sums = pa.array([[Decimal(int(x)) for x in moved[j]] for j in changed], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([any_row] * len(changed), pa.int64()), pa.array(changed, pa.int32()), pa.nulls(len(changed), pa.float64()), sums], names=names
            )

    names = ["row", "cluster", "key", "moved"]
    return rows.select("row", "was", "v").mapInArrow(run, "row long, cluster int, key double, moved array<decimal(38,0)>")


def moved_sums(entries: DataFrame) -> list[tuple[int, int, int]]:
    """(cluster, place, sum) over all tasks: at most clusters x (dim + 1) rows."""
    parts = entries.where("key IS NULL").select("cluster", F.posexplode("moved").alias("place", "x"))
    return [(r[0], r[1], int(r[2])) for r in parts.groupBy("cluster", "place").agg(F.sum("x")).collect()]


def by_cluster(values: list[float]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)


def expired(tables: list[DataFrame], last: list[float], now: list[float]) -> DataFrame:
    """(row, was) of entries whose key the offset of their cluster has reached since the round before."""
    out = None
    for i, entries in enumerate(tables):
        due = entries.where(F.col("key") <= by_cluster(now))
        if i < len(tables) - 1:  # those of the last table have not been looked at before
            due = due.where(F.col("key") > by_cluster(last))
        due = due.select("row", F.col("cluster").alias("was"))
        out = due if out is None else out.unionByName(due)
    return out


def bounds_after(old: list[list[int]], new: list[list[int]], offsets: list[float]) -> list[float]:
    """Offsets after the centroids moved: own move and the largest other one, rounded up."""
    squares = [sum((a - b) ** 2 for a, b in zip(x, y)) for x, y in zip(old, new)]
    moves = [(sqrt(s) if s < 1 << 100 else float(isqrt(s) + 1)) * (1 + 1e-12) for s in squares]
    return [o + m + max([x for i, x in enumerate(moves) if i != j], default=0.0) for j, (o, m) in enumerate(zip(offsets, moves))]


def clusters(
    vectors: DataFrame, *, ident: str = "vec_id", column: str = "embedding", dim: int = DIM, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3
) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every kept vector after ``rounds`` of assignment and update and a last assignment, and the centroids."""
    rows = integer_vectors(vectors, ident, column, dim)
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return rows.select(F.col("id").alias(ident), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    k = len(centroids)
    sums, offsets, last, tables = [[0] * (dim + 1) for _ in range(k)], [0.0] * k, [0.0] * k, []
    for turn in range(rounds + 1):
        due = rows.join(expired(tables, last, offsets), "row") if tables else rows.withColumn("was", F.lit(None).cast("int"))
        tables.append(materialise(rescanned(due, centroids, offsets, dim)))
        if turn == rounds:
            break
        for j, place, x in moved_sums(tables[-1]):
            sums[j][place] += x
        new = [[x // s[dim] for x in s[:dim]] if s[dim] else c for s, c in zip(sums, centroids)]
        last, offsets = offsets, bounds_after(centroids, new, offsets)
        if new == centroids:  # every round to come is the same
            break
        centroids = new
    alive = None
    for i, entries in enumerate(tables):
        on = entries.where("key IS NOT NULL")
        on = on if i == len(tables) - 1 else on.where(F.col("key") > by_cluster(offsets))
        alive = on.select("row", "cluster") if alive is None else alive.unionByName(on.select("row", "cluster"))
    own = np.array(centroids, object)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                cluster, wide = part.column(1).to_numpy(), matrix(part.column(2), dim)
                d = np.zeros(len(cluster), object)
                for j in np.unique(cluster):
                    d[cluster == j] = squared(wide[cluster == j], own[j : j + 1])[:, 0]
                fits = pa.array([int(x) if x <= LONG else None for x in d], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), fits], names=["id", "cluster", "distance"])

    kind = dict(rows.dtypes)["id"]
    found = rows.join(alive, "row").select("id", "cluster", "v").mapInArrow(distances, f"id {kind}, cluster int, distance long")
    return found.withColumnRenamed("id", ident), centroids


def digest(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The assignment with the distance sums of each cluster and of all, and the digest of the final centroid."""
    found = materialise(found)
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r[0]: r[1] for r in found.groupBy("cluster").agg(total).collect()}

    def fits(x) -> int | None:
        return int(x) if x is not None and x <= LONG else None

    whole = None if None in sums.values() else fits(sum(sums.values()))
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids] or [""]
    inertia = [fits(sums.get(j, 0)) for j in range(len(names))]

    def of(values: list, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)

    return found.select(
        "*", of(inertia, "long").alias("cluster_inertia"), F.lit(whole).cast("long").alias("inertia"), of(names, "string").alias("centroid_sha256")
    )


def brute_force(vectors: list[tuple[int, list[float] | None]], dim: int = DIM, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3) -> list[tuple]:
    """Plain Lloyd in Python's integers: sorted (id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    from math import floor, isfinite

    kept = [(i, [floor(SCALE * x) for x in v]) for i, v in vectors if v is not None and len(v) == dim and all(x is not None and isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: sha256(f"{seed}:{r[0]}".encode()).hexdigest())
    centroids = [list(v) for _, v in order[:k]]

    def nearest(v: list[int]) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, own in groups.items():
            centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = [sum(d for _, j, d in found if j == c) for c in range(len(centroids))]
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, j, d, sums[j], sum(sums), names[j]) for i, j, d in found)
