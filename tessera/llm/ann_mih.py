"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors are centred, rotated (principal axes, then the rotation that loses least in rounding to
signs, fitted alternately) and rounded to at most BITS signs. A code is split into substrings of WIDTH
bits and every substring is indexed: an entry (substring number, value) holds the code and the vector.
If two codes differ in at most r bits, some substring differs in at most r // substrings bits, so
probing the values within that distance in every substring retrieves every code within the radius;
a code is taken in the first substring that finds it, checked whole and ranked by distance on the
vectors.

Entries are dealt to cells by substring number and the first bits of the value (so many that a cell
holds about BLOCK entries); a query is joined with the cells whose bits are within the probed distance,
by equality on enumerated bits, and probes the values there. A cell of more entries, as one common
vector makes, is dealt to blocks of about BLOCK by row. A task holds one block and streams its queries;
it gives k rows a query and block at most. The index is built once for all queries.

The rotation, and the radius that reaches RECALL of the true neighbours, are fitted on a bounded
sample of SAMPLE vectors (by hash); every vector is indexed. Queries that find fewer than k vectors
are asked again with a wider radius, at last one that holds every code, so that none goes without k
neighbours that exist. `probed` is the number of entries that a query's buckets held.

Defined results: vectors that are null, zero or hold null or non-finite components, rows with a null
id, and vectors of another than the most frequent length take no part; rows that share an id are
candidates each, but not for queries of that id, which asks once, with the smallest of its vectors
(componentwise from the left). Of vectors
equally far the smaller id comes first. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BITS, WIDTH, SAMPLE, PROBED, RECALL = 64, 16, 8_192, 256, 0.985
#: Entries of a cell's block.
BLOCK, ROUNDS = 2_048, 30


class Coder:
    """Centre, rotation to signs, and the search radius."""

    def __init__(self, sample: np.ndarray, k: int = 10, recall: float = RECALL, seed: int = 5):
        rng = np.random.default_rng(seed)
        d = sample.shape[1]
        self.bits = min(BITS, d)
        self.parts = -(-self.bits // WIDTH)
        self.centre = sample.mean(0)
        x = sample - self.centre
        _, axes = np.linalg.eigh(x.T @ x)
        axes = axes[:, ::-1][:, : self.bits]
        y = x @ axes
        turn = np.linalg.qr(rng.normal(size=(self.bits, self.bits)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
            turn = (u @ v).T
        self.w = axes @ turn
        self.radius = self.bits
        if len(sample) > 4 * k:
            self.radius = self._radius(sample, k, recall)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, parts) substrings; bits are dealt to them in turn, what is missing is 0."""
        signs = np.zeros((len(x), self.parts * WIDTH), bool)
        signs[:, : self.bits] = (x - self.centre) @ self.w > 0
        packed = np.packbits(signs.reshape(len(x), WIDTH, self.parts).transpose(0, 2, 1), axis=2).astype(np.uint16)
        return packed[:, :, 0] << 8 | packed[:, :, 1]

    def _radius(self, sample: np.ndarray, k: int, recall: float) -> int:
        codes = self.codes(sample)
        far = []
        for i in range(0, len(sample), max(1, len(sample) // PROBED)):
            gap = ((sample - sample[i]) ** 2).sum(1)
            gap[i] = np.inf
            near = np.argpartition(gap, k)[:k]
            far.append(np.bitwise_count(codes[near] ^ codes[i]).sum(1))
        return int(np.quantile(np.concatenate(far), recall, method="higher"))


class Block:
    """The buckets of one substring over entries sorted by its value."""

    def __init__(self, part: int, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray):
        self.part, self.ids, self.vectors, self.codes = part, ids, vectors, codes
        self.values, self.sizes = np.unique(codes[:, part], return_counts=True)

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, int]:
        """Positions of the codes within the radius that no earlier substring finds, and how many entries the probed buckets hold."""
        reach = radius // self.codes.shape[1]
        at = np.flatnonzero(np.repeat(np.bitwise_count(self.values ^ code[self.part]) <= reach, self.sizes))
        apart = np.bitwise_count(self.codes[at] ^ code)
        new = (apart.sum(1) <= radius) & ~(apart[:, : self.part] <= reach).any(1)
        return at[new], len(at)

    def nearest(self, query_id: int, query: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        at, probed = self.within(code, radius)
        at = at[self.ids[at] != query_id]
        far = np.sqrt(((self.vectors[at] - query) ** 2).sum(1))
        if len(at) > 4 * k:
            close = far <= np.partition(far, k)[k]
            at, far = at[close], far[close]
        best = np.lexsort((self.ids[at], far))[:k]
        return self.ids[at[best]], far[best], probed


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = rows.filter(
        "vec_id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    )
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.uint16).reshape(-1, parts)


def coded(rows: DataFrame, coder: Coder) -> DataFrame:
    """(row, vec_id, v, codes) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = coder.codes(_matrix(batch.column("v"))).astype(np.int32)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), coder.parts).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "codes"])

    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    return common.materialize(rows.mapInArrow(run, "row long, vec_id long, v array<double>, codes array<int>"), "coded")


def prefix_bits(n: int) -> int:
    """Leading bits that deal n entries of a substring to cells of about BLOCK."""
    return min(WIDTH, max(0, int(np.ceil(np.log2(max(1, n) / BLOCK)))))


def masks(bits: int, reach: int) -> list[int]:
    return [m for m in range(1 << bits) if m.bit_count() <= reach]


def _answered(parts: int, radius: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile, a tile's entries (by value) before its queries: what each query finds in the tile."""
    tile, held, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("part", "prefix", "block", "query")], 1)
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        out = []
        for a, b in zip(edges, edges[1:]):
            part, *_, query = key[a].tolist()
            if tuple(key[a, :3].tolist()) != tile:
                tile, held, block = tuple(key[a, :3].tolist()), [], None
            rows = batch.slice(a, b - a)
            own = (rows.column("vec_id").to_numpy(), _matrix(rows.column("v")), _codes(rows.column("codes"), parts))
            if not query:
                held.append(own)
                continue
            if block is None and held:
                block = Block(part, *(np.concatenate(x) for x in zip(*held)))
                held = []
            if block is not None:
                out += [(i, *block.nearest(i, q, c, radius, k)) for i, q, c in zip(*own)]
        if out:
            sizes = [max(1, len(x[1])) for x in out]
            none = (np.array([-1]), np.array([np.nan]))
            ids, far = (np.concatenate([x[j + 1] if len(x[1]) else none[j] for x in out]) for j in (0, 1))
            first = np.cumsum(sizes) - np.array(sizes)
            probed = np.zeros(len(ids), np.int64)
            probed[first] = [x[3] for x in out]
            found = pa.array(~np.isnan(far))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([x[0] for x in out], sizes)), pa.array(ids, mask=np.isnan(far)), pa.array(far, mask=np.isnan(far)), pa.array(probed), found],
                ["query_id", "vec_id", "score", "probed", "found"],
            )


def _round(index: DataFrame, queries: DataFrame, cells: DataFrame, parts: int, bits: int, radius: int, k: int) -> DataFrame:
    """(query_id, vec_id, score, probed, found): what the queries find within a radius, at most k a block."""
    own = F.shiftright(F.col("value"), WIDTH - bits)
    near = F.transform(F.array(*(F.lit(m) for m in masks(bits, radius // parts))), lambda m: own.bitwiseXOR(m))
    probes = queries.select("vec_id", "v", "codes", F.posexplode("codes").alias("part", "value"))
    probes = probes.select("vec_id", "v", "codes", "part", "value", F.explode(near).alias("prefix"))
    # cells are bounded by 2**WIDTH times the substrings
    probes = probes.join(F.broadcast(cells), ["part", "prefix"]).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    columns = ["part", "prefix", "block", "query", "value", "vec_id", "v", "codes"]
    both = index.withColumn("query", F.lit(0)).select(columns).union(probes.withColumn("query", F.lit(1)).select(columns))
    both = both.repartition("part", "prefix", "block").sortWithinPartitions("part", "prefix", "block", "query", "value")
    return both.mapInArrow(lambda x: _answered(parts, radius, k, x), "query_id long, vec_id long, score double, probed long, found boolean")


def search(vectors: DataFrame, is_query: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score, probed: the k nearest found of each query row (a predicate over vec_id)."""
    spark = vectors.sparkSession
    rows = common.materialize(usable(vectors, id_col, vector_col), "vectors")
    n = rows.count()
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, probed long")
    if not n:
        return nothing
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) / 1_000_003
    sample = rows.filter(place < min(1.0, SAMPLE / n)).orderBy("vec_id").limit(2 * SAMPLE).toPandas()["v"]
    if not len(sample):
        sample = rows.orderBy("vec_id").limit(1).toPandas()["v"]
    coder = Coder(np.stack(sample.to_list()), k)
    common.small_batches(spark)
    base = coded(rows, coder)
    common.discard(rows)
    bits = prefix_bits(n)
    index = base.select("row", "vec_id", "v", "codes", F.posexplode("codes").alias("part", "value")).withColumn("prefix", F.shiftright("value", WIDTH - bits))
    cells = index.groupBy("part", "prefix").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    cells = common.materialize(cells, "cells")
    index = index.join(F.broadcast(cells), ["part", "prefix"]).withColumn("block", F.expr("int(pmod(xxhash64(row), blocks))"))

    asked = base.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "codes")).alias("q"))
    queries = asked.select("vec_id", "q.v", "q.codes")
    queries = common.materialize(queries, "queries")
    radius, found = coder.radius, []
    order = Window.partitionBy("query_id").orderBy(F.desc("found"), "score", "vec_id")
    while not queries.isEmpty():
        got = _round(index, queries, cells, coder.parts, bits, radius, k)
        got = got.withColumns({"rank": F.row_number().over(order), "probed": F.sum("probed").over(Window.partitionBy("query_id"))})
        got = common.materialize(got.filter(F.col("rank") <= k), "found")
        # a query is done with k vectors, or when it has seen every code
        done = got.filter("found").groupBy("query_id").count().filter(F.col("count") >= k) if radius < coder.bits else queries.select(F.col("vec_id").alias("query_id"))
        done = done.select("query_id")
        found.append(got.filter("found").join(done, "query_id", "left_semi"))
        if radius >= coder.bits:
            break
        queries = common.materialize(queries.join(done, F.col("vec_id") == F.col("query_id"), "left_anti"), "queries")
        radius = min(coder.bits, 2 * radius + coder.parts)
    if not found:
        return nothing
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select("query_id", "rank", "vec_id", "score", "probed")


def op10_ann_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.read_table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")
