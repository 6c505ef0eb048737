"""Centroid clustering of vectors in whole numbers, with a table of distances to fixed pivots.

A component x becomes floor(1024 * x), so all sums and distances are exact and do not depend on how rows
are spread.  Each vector's distances to a few fixed pivots are stored once.  In a round the centroids'
distances to the pivots are known too, and by the triangle inequality the difference of two distances to
one pivot is a lower bound of the distance between vector and centroid.  A vector is first measured against
the centroid with the least bound; of the others only those whose bound does not exceed the best distance
found so far get an exact distance.

1. Rows with exactly ``dims`` components, none null or non-finite, are kept.  The starts are the rows with
   the least SHA-256 of ``<seed>:<vec_id>``; the first ``PIVOTS`` different ones in that order are the pivots, so
   the first round's bounds are nearly exact.
2. Vectors travel in blocks with their pivot distances, written once.
3. Each round reads the blocks; a task sends the sums of its vectors by cluster, in digits to the base 2^40,
   so a round's shuffle is some thousand rows a task whatever the sizes of the clusters are, and only
   clusters x dims sums reach the driver.

Cases: null, short, long and null- or NaN-holding vectors are left out; ties go to the smaller cluster; a null id
is a row like any other (hashed as an empty one), repeated rows are rows each, equal hashes start in the order
of their vectors; with fewer kept rows than clusters each kept row starts one; an empty table gives no rows;
extra columns are ignored.  Very large components are computed without bounds on their size; a distance or an
inertia that a long cannot hold is null.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import Scratch, expand, squeeze, tidy

#: Pivots of the table.
PIVOTS = 8
#: Vectors of a block.
BLOCK_ROWS = 4096
#: Bits of a digit in which sums travel.
DIGIT = 40
#: Relative error that distances as doubles may have.
SLACK = 1e-12
_LONG = 2**63 - 1


def narrow(dims: int) -> int:
    """Components below it have squared distances that fit into 64 bits; others are computed in Python's integers."""
    return 1 << ((62 - (dims - 1).bit_length()) // 2 - 1)


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of doubles, as int64 if all are narrow and as Python's integers otherwise."""
    scaled = np.floor(x * 1024.0)
    if scaled.size == 0 or np.abs(scaled).max() < narrow(x.shape[-1]):
        return scaled.astype(np.int64)
    exact = [int(math.floor(v * 1024.0)) if abs(v) < 2.0**60 else int(v) * 1024 for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of the vectors to one point."""
    if vectors.dtype == object or point.dtype == object:
        return ((vectors.astype(object) - point.astype(object)) ** 2).sum(axis=1)
    gap = vectors - point
    return np.einsum("ij,ij->i", gap, gap)


def _root(value) -> float:
    try:
        return math.sqrt(value)
    except OverflowError:
        return math.inf


def roots(values: np.ndarray) -> np.ndarray:
    return np.sqrt(values.astype(np.float64)) if values.dtype != object else np.array([_root(v) for v in values])


def pivot_table(vectors: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    """Distance of each vector to each pivot."""
    return np.stack([roots(squared(vectors, p)) for p in pivots], axis=1) if len(pivots) else np.zeros((len(vectors), 0))


def choose_pivots(vectors: list[np.ndarray], n: int = PIVOTS) -> list[np.ndarray]:
    """The first n different vectors."""
    chosen: dict[tuple, np.ndarray] = {}
    for v in vectors:
        if len(chosen) < n:
            chosen.setdefault(tuple(v.tolist()), v)
    return list(chosen.values())


def nearest(vectors: np.ndarray, table: np.ndarray, centroids: list[np.ndarray], reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, exact distances computed) of each vector.

    table: the vectors' distances to the pivots; reach: the centroids'.
    """
    n, k = len(vectors), len(centroids)
    with np.errstate(invalid="ignore"):
        bound = np.zeros((n, k))
        for p in range(table.shape[1]):
            gap = np.abs(table[:, p, None] - reach[None, :, p])
            np.maximum(bound, np.nan_to_num(gap - SLACK * (table[:, p, None] + reach[None, :, p]), nan=0.0, posinf=0.0), out=bound)
        bound = bound * bound * (1 - SLACK)
    wide = vectors.dtype == object or any(c.dtype == object for c in centroids)
    cluster = bound.argmin(axis=1).astype(np.int32)
    best = np.zeros(n, object if wide else np.int64)
    for j in range(k):
        own = np.flatnonzero(cluster == j)
        best[own] = squared(vectors[own], centroids[j])
    first, computed = cluster.copy(), n
    for j in range(k):
        near = np.array([b <= v for b, v in zip(bound[:, j].tolist(), best, strict=True)], bool) if wide else bound[:, j] <= best
        rows = np.flatnonzero(near & (first != j))
        if len(rows):
            found = squared(vectors[rows], centroids[j])
            computed += len(rows)
            better = np.array((found < best[rows]) | ((found == best[rows]) & (j < cluster[rows])), bool)
            best[rows[better]], cluster[rows[better]] = found[better], j
    return cluster, best, computed


def _kept(rows: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    vector = F.col(vector_col).cast("array<double>")
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).where((F.size("vector") == dims) & F.forall("vector", fine))


def _blocks(kept: DataFrame, dims: int, pivots: list[np.ndarray]) -> DataFrame:
    """(n, ids, nulls, wide, vectors, table) of up to BLOCK_ROWS vectors; wide ones stay doubles, in blocks of their own."""

    def row(ids: list, x: np.ndarray) -> pa.RecordBatch:
        vectors = whole(x)
        wide = vectors.dtype == object
        small = next((t for t in (np.int16, np.int32) if not wide and np.abs(vectors).max() <= np.iinfo(t).max), np.int32)
        cells = {
            "n": len(ids), "ids": np.array([i or 0 for i in ids], np.int64).tobytes(), "nulls": np.array([i is None for i in ids], np.uint8).tobytes(),
            "kind": "wide" if wide else small.__name__, "vectors": squeeze((x if wide else vectors.astype(small)).tobytes()), "table": pivot_table(vectors, pivots).tobytes(),
        }
        return pa.RecordBatch.from_pylist([cells], pa.schema([("n", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("kind", pa.string()), ("vectors", pa.binary()), ("table", pa.binary())]))

    def pack(batches):
        held = {False: ([], []), True: ([], [])}
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            wide = (np.abs(x) >= narrow(dims) / 2048).any(axis=1)
            ids = batch.column(0).to_pylist()
            for kind, (some, parts) in held.items():
                for at in np.flatnonzero(wide == kind).tolist():
                    some.append(ids[at])
                    parts.append(x[at])
                    if len(some) == BLOCK_ROWS:
                        yield row(some, np.stack(parts))
                        some.clear()
                        parts.clear()
        for some, parts in held.values():
            if some:
                yield row(some, np.stack(parts))

    return kept.mapInArrow(tidy(pack), "n long, ids binary, nulls binary, kind string, vectors binary, table binary")


def _unpack(cells: dict, dims: int) -> tuple[np.ndarray, np.ndarray]:
    kind, raw = cells["kind"], expand(cells["vectors"])
    vectors = whole(np.frombuffer(raw, np.float64).reshape(-1, dims)) if kind == "wide" else np.frombuffer(raw, kind).reshape(-1, dims).astype(np.int64)
    return vectors, np.frombuffer(cells["table"], np.float64).reshape(len(vectors), -1)


def digits(value: int) -> list[int]:
    """value = sum of digit[i] * 2**(DIGIT * i); all but the last are not negative."""
    out = []
    while not -(1 << DIGIT) < value < 1 << DIGIT:
        out.append(value & ((1 << DIGIT) - 1))
        value >>= DIGIT
    return [*out, value]


def _sums(blocks: DataFrame, dims: int, centroids: list[np.ndarray], reach: np.ndarray) -> dict[int, dict[int, int]]:
    """Componentwise sums by cluster, the count at -1 and at -2 the number of exact distances."""

    def run(batches):
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            for cells in batch.to_pylist():
                vectors, table = _unpack(cells, dims)
                cluster, _, computed = nearest(vectors, table, centroids, reach)
                for j in np.unique(cluster).tolist():
                    own = vectors[cluster == j]
                    for dim, value in enumerate(own.sum(axis=0).tolist()):
                        total[j, dim] = total.get((j, dim), 0) + value
                    total[j, -1] = total.get((j, -1), 0) + len(own)
                total[0, -2] = total.get((0, -2), 0) + computed
        rows = [(j, dim, i, d) for (j, dim), value in total.items() for i, d in enumerate(digits(value))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "dim", "digit", "value"])

    sent = blocks.mapInArrow(tidy(run), "cluster int, dim int, digit int, value long")
    out: dict[int, dict[int, int]] = {}
    for r in sent.groupBy("cluster", "dim", "digit").agg(F.sum("value").alias("value")).collect():  # clusters x (dims + 2) x digits rows
        own = out.setdefault(r.cluster, {})
        own[r.dim] = own.get(r.dim, 0) + (r.value << (DIGIT * r.digit))
    return out


def _point(values: list[int]) -> np.ndarray:
    return np.array(values, np.int64 if all(abs(v) < narrow(len(values)) for v in values) else object)


def cluster_vectors(rows: DataFrame, dims: int = 64, clusters: int = 8, rounds: int = 10, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", report: list | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector.

    report: gets (vectors, exact distances) of each round, to see what the pivots save.
    """
    spark = rows.sparkSession
    work = Scratch(spark, "pivot_clustering")
    kept = _kept(rows, dims, id_col, vector_col)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(order, "vector").limit(max(clusters, PIVOTS)).collect()
    points = [_point(whole(np.array(r.vector, np.float64)).tolist()) for r in first]
    pivots, centroids = choose_pivots(points), points[:clusters]
    blocks = work.write(_blocks(kept, dims, pivots), "blocks")
    reach = lambda: np.stack([pivot_table(c[None, :], pivots)[0] for c in centroids]) if centroids else np.zeros((0, len(pivots)))
    for _ in range(rounds if centroids else 0):
        sums = _sums(blocks, dims, centroids, reach())
        if report is not None:
            report.append((sum(s.get(-1, 0) for s in sums.values()), sums.get(0, {}).get(-2, 0)))
        for j, own in sums.items():
            if own.get(-1):
                centroids[j] = _point([own[d] // own[-1] for d in range(dims)])
    at = reach()

    def assign(batches):
        for batch in batches:
            for cells in batch.to_pylist():
                vectors, table = _unpack(cells, dims)
                cluster, best, _ = nearest(vectors, table, centroids, at)
                ids = pa.array(np.frombuffer(cells["ids"], np.int64), mask=np.frombuffer(cells["nulls"], np.uint8).astype(bool))
                distance = pa.array([d if d <= _LONG else None for d in best.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), distance], names=["vec_id", "cluster", "distance"])

    assigned = work.write(blocks.mapInArrow(tidy(assign), "vec_id long, cluster int, distance long"), "assigned")
    work.keep("assigned")
    found = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"), F.count("distance").alias("known")).collect()
    fits = lambda values: int(sum(values)) if None not in values and sum(values) <= _LONG else None
    own = {r.cluster: r.total if r.n == r.known else None for r in found}
    sha = lambda j: hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()
    sizes = spark.createDataFrame([(j, fits([total]), fits(list(own.values())), sha(j)) for j, total in own.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(sizes), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a cluster
