"""Centroid clustering of integer vectors, exact whatever order the work is done in.

Components are scaled by a power of two and rounded down to integers. Vectors are packed into blocks of BLOCK rows once,
written to the shared folder and read by every round. A block's distances to all centroids are one
matrix product, |x|^2 - 2 x.c + |c|^2 in float64. All values are integers, so the result is exact as
long as no intermediate value can reach 2^53; by Cauchy and Schwarz none does where
(|x| + |c|)^2 < 2^53, which is tested for every vector and centroid. Pairs beyond that bound are
computed again with Python integers. A round's sums and counts are integers too, added by block,
task and treeAggregate; new centroids are the componentwise floor of sum / count. The driver holds k
centroids and their sums only.

Defined results: vectors that are null, of another length than `size`, or hold null or non-finite
components take no part; rows that share an id are clustered each, and start in the order of their components;
rows with a null id are clustered but start no centroid. Fewer ids than k start fewer centroids, none
gives an empty result. A vector as near to two centroids joins the smaller number; an empty centroid
stays where it is. A distance or inertia beyond a long is null (the cluster is exact all the same). An empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K, ROUNDS, SEED, SIZE, SCALE = 8, 10, 3, 64, 1024
#: Vectors of a block.
BLOCK = 2_048
EXACT = 2**53
LONG = 2**63 - 1


def usable(vectors: DataFrame, size: int = SIZE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("v"))
    return rows.filter(F.size("v") == size).filter("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(double(x)) < double('Infinity'))")


def integers(values: np.ndarray, scale: int = SCALE) -> list[int]:
    """floor(scale * x) as Python integers, of any size."""
    return [p * scale // q for p, q in map(float.as_integer_ratio, values.tolist())]


class Block(NamedTuple):
    """x: integer vectors as float64, exact where norm is finite and below the bound; raw: the given components."""

    raw: np.ndarray
    x: np.ndarray
    norm: np.ndarray


def unpacked(data: bytes, size: int, scale: int, wide: bool) -> Block:
    raw = np.frombuffer(data, np.float64 if wide else np.float32).reshape(-1, size).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(raw * scale)
        norm = np.sqrt((x * x).sum(1))
    return Block(raw, x, np.where(np.isfinite(norm), norm, np.inf))


def squared(a: list[int], b: list[int]) -> int:
    return sum((p - q) * (p - q) for p, q in zip(a, b))


def assigned(block: Block, centroids: list[list[int]], scale: int = SCALE) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """Each vector's cluster and exact squared distance: int64, or Python integers where the bound fails."""
    # roots are rounded up, so that rounding can't hide a value beyond the bound
    reach = np.array([min(math.isqrt(sum(x * x for x in c)), EXACT) + 1.0 for c in centroids])
    small = reach < math.sqrt(EXACT)
    c = np.array([[float(x) if ok else 0.0 for x in row] for row, ok in zip(centroids, small)])
    with np.errstate(over="ignore", invalid="ignore"):
        apart = (block.x * block.x).sum(1)[:, None] - 2.0 * (block.x @ c.T) + (c * c).sum(1)
        sure = ((block.norm[:, None] + 1.0 + reach) ** 2 < EXACT) & small
    if sure.all():
        nearest = apart.argmin(1)
        return nearest, apart[np.arange(len(apart)), nearest].astype(np.int64)
    clusters, far = np.empty(len(apart), np.int64), []
    for i, row in enumerate(sure):
        own = None if row.all() else integers(block.raw[i], scale)
        gaps = [int(apart[i, j]) if ok else squared(own, centroids[j]) for j, ok in enumerate(row)]
        clusters[i] = min(range(len(gaps)), key=gaps.__getitem__)
        far.append(gaps[clusters[i]])
    return clusters, far


Sums = list[list[int]]


def gathered(sums: Sums, block: Block, centroids: list[list[int]], scale: int = SCALE) -> Sums:
    """sums (of a cluster: count, distance, components) with a block added."""
    clusters, far = assigned(block, centroids, scale)
    exact = bool((block.norm < EXACT).all()) and float(np.abs(block.x).max(initial=0)) * len(block.x) < EXACT
    for j in np.unique(clusters).tolist():
        own = clusters == j
        # each component's sum stays below 2^53, or is taken of Python integers
        more = [int(t) for t in block.x[own].sum(0)] if exact else [sum(t) for t in zip(*(integers(r, scale) for r in block.raw[own]))]
        distance = sum(map(int, far[own])) if isinstance(far, np.ndarray) else sum(f for f, o in zip(far, own) if o)
        sums[j] = [a + b for a, b in zip(sums[j], [int(own.sum()), distance, *more])]
    return sums


def added(a: Sums, b: Sums) -> Sums:
    return [[p + q for p, q in zip(x, y)] for x, y in zip(a, b)]


def packed(rows: DataFrame, wide: bool) -> DataFrame:
    """(ids, data): blocks of at most BLOCK vectors, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, v = batch.column("vec_id"), batch.column("v")
                data = np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False), np.float64 if wide else np.float32)
                width = len(data) // batch.num_rows
                starts = range(0, batch.num_rows, BLOCK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.slice(k, BLOCK).to_pylist() for k in starts], pa.list_(pa.int64())), pa.array([data[k * width : (k + BLOCK) * width].tobytes() for k in starts])],
                    ["ids", "data"],
                )

    return common.materialize(rows.mapInArrow(run, "ids array<long>, data binary"), "vector-blocks")


def first_centroids(rows: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors of the smallest hashes of their ids; equal hashes by components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = rows.filter("vec_id IS NOT NULL").orderBy(order, "v").limit(k).select("v").collect()
    return [integers(np.array(r.v, np.float64), scale) for r in chosen]


def clustered(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]], list[int], list[int]]:
    """(vec_id, cluster, distance) of every vector; the final centroids, their counts and inertias."""
    spark = vectors.sparkSession
    wide = vectors.schema[vector_col].dataType.simpleString() != "array<float>"
    rows = usable(vectors, size, id_col, vector_col)
    if wide:
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    centroids = first_centroids(rows, k, seed, scale)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), [], [], []
    blocks = packed(rows, wide)
    data = blocks.select("data").rdd

    def sums_of(now: list[list[int]]) -> Sums:
        zero = [[0] * (size + 2) for _ in now]
        return data.treeAggregate(zero, lambda s, r: gathered(s, unpacked(bytes(r[0]), size, scale, wide), now, scale), added)

    for _ in range(rounds):
        sums = sums_of(centroids)
        centroids = [[t // n for t in total] if n else old for old, (n, _, *total) in zip(centroids, sums)]
    last = sums_of(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch.column("ids"), batch.column("data")):
                clusters, far = assigned(unpacked(data.as_py(), size, scale, wide), centroids, scale)
                fits = far if isinstance(far, np.ndarray) else [f if f <= LONG else None for f in far]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(clusters, pa.int32()), pa.array(fits, pa.int64())], ["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long"), centroids, [x[0] for x in last], [x[1] for x in last]


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(found: DataFrame, centroids: list[list[int]], inertias: list[int]) -> DataFrame:
    """found with cluster_inertia, inertia and centroid_sha256: k values each, set in as constants."""

    def of(values: list, kind: str):  # noqa: ANN202
        return F.element_at(F.array(*(F.lit(x).cast(kind) for x in values)) if values else F.array().cast(f"array<{kind}>"), F.col("cluster") + 1)

    fits = [x if x <= LONG else None for x in inertias]
    total = sum(inertias)
    return found.withColumns({
        "cluster_inertia": of(fits, "long"),
        "inertia": F.lit(total if total <= LONG else None).cast("long"),
        "centroid_sha256": of([digest(c) for c in centroids], "string"),
    })


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids, _, inertias = clustered(common.read_table(spark, sf_dir, "embeddings"))
    return with_inertia(found, centroids, inertias)


def _oracle() -> str:
    """The same rounds unrolled: list arithmetic on integers (given vectors stay far below a long)."""
    gap = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(k.x, c.x)])"
    steps = [
        f"""k AS MATERIALIZED (SELECT vec_id, [floor({SCALE} * t::DOUBLE)::BIGINT for t in embedding] AS x, row_number() OVER () AS r FROM embeddings
WHERE len(embedding) = {SIZE} AND len([1 for t in embedding if t IS NULL OR NOT isfinite(t::DOUBLE)]) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INT AS j, x FROM (SELECT sha256('{SEED}:' || vec_id) AS h, x FROM k WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {K}))"""
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"d{n} AS (SELECT k.r, c.j, {gap} AS d FROM k, c{n} c), a{n} AS MATERIALIZED (SELECT r, min(d)::BIGINT AS d, arg_min(j, [d, j]) AS j FROM d{n} GROUP BY r)")
        if n < ROUNDS:
            steps.append(
                f"""s{n} AS (SELECT a.j, u.i, floor(sum(k.x[u.i]) / count(*))::BIGINT AS m FROM a{n} a JOIN k USING (r), range(1, {SIZE + 1}) u(i) GROUP BY ALL),
v{n} AS (SELECT j, list(m ORDER BY i) AS x FROM s{n} GROUP BY j), c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(v.x, c.x) AS x FROM c{n} c LEFT JOIN v{n} v USING (j))"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.j AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.j)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
       sha256(list_aggregate(c.x, 'string_agg', ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN k USING (r) JOIN c{ROUNDS} c USING (j)"""


OP13_SQL = _oracle()
