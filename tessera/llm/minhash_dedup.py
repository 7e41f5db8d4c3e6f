"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A document's set is its distinct 5-word shingles. SLOTS minima of BITS bits each make its signature;
two sets with similarity s differ in about (1-s)*SLOTS slots. The signature is split into chunks; if
two signatures differ in at most radius < 2*chunks slots, some chunk has at most one differing slot.
Leaving out each slot of each chunk in turn enumerates that error, so every pair under the distance
shares a key. laid_out() sets the radii by the similarity asked for: a pair at it exceeds each with
probability below MISSED.

Documents with equal sets form one class, a node named after one of its rows; only nodes are indexed.
Pairs within a bucket aren't listed. In each of at most ROUNDS rounds every node makes one offer, to
the one of its buckets' heads that shares most buckets with it and belongs to another component, a
bucket's head being the member that shares buckets with the most nodes; offers are confirmed on the
full sets and the components joined, so most of a group of any number of near copies soon is one
component for a row a member and round. A bucket whose members are one component is finished. What is
left is searched in tiles of bounded size, two blocks of a bucket at most: members with a partner of
another component under the signature distance, that a longer signature (LONG slots of 2 bits) doesn't
rule out either, get their full sets, and the tile confirms its pairs on them where they lie. It gives
only links that join components, fewer than it has members. Blocks meet in turns, NEIGHBOURS a turn, and
components are joined in between, so a bucket of many blocks isn't copied for all of them at once.
No bucket is capped.

Defined results: null or wordless texts have an empty set, are linked with nothing and kept; texts
of fewer than 5 words are one shingle; rows that share a doc_id are each judged by their own set, one
result row per input row; null doc_ids have rows too, take part as ids larger than any other, and
component_id is null where no other id is reachable. `stays` marks exactly one row of each component
(the smallest doc_id, and of its rows the first). Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE = 5
#: Slots of the signature and bits of each; slots of 2 bits of the longer signature.
SLOTS, BITS, LONG = 64, 16, 1024
#: A pair at the similarity asked for exceeds either radius with a probability below this.
MISSED = 1e-6
ROUNDS = 4
#: A round that links fewer than one in so many of the nodes it left is the last.
WORTH = 20
#: Members of a bucket's block and bytes of their sets; two blocks meet in a task, NEIGHBOURS a turn.
BLOCK, BLOCK_BYTES, NEIGHBOURS = 1024, 16 << 20, 8
_UPPER = str.maketrans({c: c + 32 for c in range(65, 91)})

_rng = np.random.Generator(np.random.PCG64(20240131))
#: Odd multipliers and offsets of the hash functions of both signatures (multiply-shift on 64 bits).
MULTIPLIERS = _rng.integers(0, 2**63, SLOTS + LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 2**63, SLOTS + LONG, dtype=np.uint64)


class Layout(NamedTuple):
    radius: int
    long_radius: int
    chunk_slots: list[list[int]]


def radius_of(slots: int, differs: float) -> int:
    """The least radius that slots, each differing with that probability, exceed more seldom than MISSED."""
    beyond, radius = 0.0, slots
    while radius and (beyond := beyond + math.comb(slots, radius) * differs**radius * (1 - differs) ** (slots - radius)) < MISSED:
        radius -= 1
    return radius


def laid_out(percent: int) -> Layout:
    differs = 1 - percent / 100
    radius = radius_of(SLOTS, differs)
    chunks = np.array_split(np.arange(SLOTS), radius // 2 + 1)
    return Layout(radius, radius_of(LONG, differs * 3 / 4), [list(map(int, x)) for x in chunks])


#: The layout for a similarity of 0.85.
RADIUS, LONG_RADIUS, CHUNK_SLOTS = laid_out(85)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    words = WORD.findall((text or "").translate(_UPPER))
    if not words:
        return np.empty(0, np.uint64)
    n = len(words)
    with np.errstate(over="ignore"):
        h = word_hashes(words)
        if n < size:
            acc = np.full(1, n, np.uint64)
            for x in h:
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + x)
            return acc
        acc = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : n - size + 1 + k])
    return np.unique(acc)


def word_hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def minima(shingles: np.ndarray, functions: slice) -> np.ndarray:
    a, b = MULTIPLIERS[functions], OFFSETS[functions]
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 512):
            low = np.minimum(low, (shingles[at : at + 512, None] * a + b).min(0))
        return mix(low)


def signature(shingles: np.ndarray) -> np.ndarray:
    """SLOTS minima, of which BITS bits are kept."""
    return (minima(shingles, slice(SLOTS)) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def long_signature(shingles: np.ndarray) -> np.ndarray:
    """LONG slots of 2 bits, packed four to a byte."""
    slots = (minima(shingles, slice(SLOTS, None)) & np.uint64(3)).astype(np.uint8).reshape(-1, 4)
    return slots[:, 0] | slots[:, 1] << 2 | slots[:, 2] << 4 | slots[:, 3] << 6


def long_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing slots, row by row, of packed signatures as 64-bit words."""
    x = a ^ b
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(1)


def keys_of(sigs: np.ndarray, chunk_slots: list[list[int]] = CHUNK_SLOTS) -> np.ndarray:
    """Per signature, chunk and left-out slot a hash of the chunk's other slots; the low 6 bits name the slot."""
    out = np.empty(sigs.shape, np.int64)
    with np.errstate(over="ignore"):
        wide = sigs.astype(np.uint64)
        for slots in chunk_slots:
            for gone in slots:
                acc = np.full(len(sigs), gone + 1, np.uint64)
                for s in slots:
                    if s != gone:
                        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + wide[:, s])
                out[:, gone] = ((acc & ~np.uint64(63)) | np.uint64(gone)).view(np.int64)
    return out


def first_shared_slot(differ: np.ndarray, chunk_slots: list[list[int]] = CHUNK_SLOTS) -> np.ndarray:
    """The lowest left-out slot whose key two signatures share, from (pairs, SLOTS) of differing slots; SLOTS if none."""
    best = np.full(len(differ), SLOTS)
    for slots in reversed(chunk_slots):
        part = differ[:, slots[0] : slots[-1] + 1]
        wrong = part.sum(1)
        best = np.where(wrong == 0, slots[0], np.where(wrong == 1, slots[0] + part.argmax(1), best))
    return best


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """A few rows at a time and the shingles of their texts."""
    for batch in batches:
        for a in range(0, batch.num_rows, 128):
            part = batch.slice(a, 128)
            yield part, [shingle_hashes(t) for t in part.column("text").to_pylist()]


def set_hash(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, sets in _texts(batches):
        columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(map(set_hash, sets), pa.binary()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *columns], ["row", "doc_id", "n_shingles", "set_hash", "sig"])


def signatures(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(_signed, "row long, doc_id long, n_shingles long, set_hash binary, sig binary")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, sets in _texts(batches):
        sets = [s for s in sets if len(s)]
        columns = [list(map(set_hash, sets)), [s.tobytes() for s in sets], [long_signature(s).tobytes() for s in sets]]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in columns], ["set_hash", "shingles", "long_sig"])


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles, long_sig) of the wanted nodes (node, set_hash, doc_id), from the texts of their doc_ids."""
    ids = wanted.filter("doc_id IS NOT NULL").select("doc_id").distinct()
    rows = common.join_ids(docs, ids, "doc_id", "left_semi")
    if not wanted.filter("doc_id IS NULL").isEmpty():
        rows = rows.union(docs.filter("doc_id IS NULL"))
    sets = rows.mapInArrow(_sets, "set_hash binary, shingles binary, long_sig binary")
    # the wanted side is one row a node: broadcast only after counting
    small = wanted.limit(common.BROADCAST_IDS // 4 + 1).count() <= common.BROADCAST_IDS // 4
    nodes = wanted.select("set_hash", "node")
    sets = common.materialize(sets.join(F.broadcast(nodes) if small else nodes.hint("merge"), "set_hash").drop("set_hash"), "sets")
    if sets.count() > wanted.count():  # rows that share id and set
        sets = common.materialize(sets.dropDuplicates(["node"]), "sets-once")
    return sets


def _keyed(chunk_slots: list[list[int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS)
        nodes = np.repeat(batch.column("node").to_numpy(), SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(keys_of(sigs, chunk_slots).ravel()), pa.array(nodes)], ["key", "node"])


def is_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether sorted full sets satisfy 100 * |x and y| >= percent * |x or y|."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _linked(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [[np.frombuffer(x.as_py(), np.uint64) for x in batch.column(c)] for c in ("a_set", "b_set")]
        yield batch.select(["a", "b"]).filter(pa.array([is_link(x, y, percent) for x, y in zip(*sets)], pa.bool_()))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b), by alternating hooking and shortcutting; a component is named after its least node.

    Each step is a join and an aggregate with partial sums, written to the shared folder; star-like
    groups take two or three steps, a chain of n takes about log n.
    """
    live = common.materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc-edges")
    labels = live.select("u").union(live.select("v")).distinct().select(F.col("u").alias("node"), F.col("u").alias("component"))
    if live.isEmpty():
        return labels
    labels = common.materialize(labels, "cc-nodes")
    while True:
        # the smallest label next to each label hooks it
        hook = common.materialize(live.groupBy("u").agg(F.min("v").alias("v")), "cc-hook")
        while True:  # follow hooks to their ends
            on = hook.alias("h").join(hook.alias("g"), F.col("h.v") == F.col("g.u"), "left")
            nxt = common.materialize(on.select("h.u", F.coalesce("g.v", "h.v").alias("v"), F.col("g.v").isNotNull().alias("moved")), "cc-jump")
            moved = not nxt.filter("moved").isEmpty()
            common.discard(hook)
            hook = nxt
            if not moved:
                break
        new = labels.join(hook, labels["component"] == hook["u"], "left").select("node", F.coalesce("v", "component").alias("component"))
        new = common.materialize(new, "cc-labels")
        to = lambda side: hook.select(F.col("u").alias(side), F.col("v").alias(f"{side}_to"))
        left = live.join(to("u"), "u", "left").join(to("v"), "v", "left").select(F.coalesce("u_to", "u").alias("x"), F.coalesce("v_to", "v").alias("y"))
        left = common.materialize(left.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "cc-live")
        common.discard(labels, live, hook)
        labels, live = new, left
        if live.isEmpty():
            common.discard(live)
            return labels


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    joined = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set")), "b")
    joined = joined.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set")), "a")
    return joined.select("a", "b", "a_set", "b_set").mapInArrow(lambda x: _linked(percent, x), "a long, b long")


class Tiles(NamedTuple):
    """Rows of tiles side by side: a number for each tile, the bucket's key, and the members' columns."""

    tile: np.ndarray
    key: np.ndarray
    block: np.ndarray
    component: np.ndarray
    node: np.ndarray
    sig: np.ndarray
    long_sig: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Tiles:
        tiles = rows.column("tile").combine_chunks()
        key, i, j = (tiles.field(k).to_numpy() for k in range(3))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        unpack = lambda c, t: np.frombuffer(b"".join(rows.column(c).to_pylist()), t).reshape(rows.num_rows, -1)
        return cls(np.cumsum(new), key, *(rows.column(c).to_numpy() for c in ("block", "component", "node")), unpack("sig", np.uint16), unpack("long_sig", np.uint64))


def across(t: Tiles, layout: Layout, block_pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((n, 2) positions, distances) of pairs within a tile that may be links.

    Kept are pairs of different components under both distances whose first shared key is the tile's;
    a tile of two blocks (block_pair) pairs rows across them only. All tiles are worked on at once, by
    the distance between the two rows.
    """
    out, far = [np.empty((0, 2), np.int64)], [np.empty(0, np.int64)]
    at, d = np.arange(len(t.tile)), 0
    while len(at):
        d += 1
        at = at[at + d < len(t.tile)]
        at = at[t.tile[at] == t.tile[at + d]]
        x = at[(t.component[at] != t.component[at + d]) & (~block_pair[at] | (t.block[at] != t.block[at + d]))]
        for x in np.array_split(x, max(1, len(x) // 8192)):
            differ = t.sig[x] != t.sig[x + d]
            ok = differ.sum(1) <= layout.radius
            ok[ok] = first_shared_slot(differ[ok], layout.chunk_slots) == (t.key[x[ok]] & 63)
            x = x[ok]
            distance = long_distance(t.long_sig[x], t.long_sig[x + d])
            ok = distance <= layout.long_radius
            out.append(np.stack([x[ok], x[ok] + d], 1))
            far.append(distance[ok].astype(np.int64))
    return np.concatenate(out), np.concatenate(far)


def _pairs(rows: pa.Table, layout: Layout) -> tuple[Tiles, np.ndarray, np.ndarray]:
    t = Tiles.of(rows)
    tiles = rows.column("tile").combine_chunks()
    return t, *across(t, layout, tiles.field(1).to_numpy() != tiles.field(2).to_numpy())


def _suspects(layout: Layout, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of a tile that have a possible partner in it."""
    for rows in whole_tiles(batches):
        _, pairs, _ = _pairs(rows, layout)
        yield from rows.take(pa.array(np.unique(pairs))).to_batches(max_chunksize=512)


def _forest(layout: Layout, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links of each tile that join components, at most one fewer than its members; the likeliest pairs first."""
    for rows in whole_tiles(batches):
        t, pairs, far = _pairs(rows, layout)
        sets = rows.column("shingles")
        own: dict[int, np.ndarray] = {}
        up: dict[tuple[int, int], tuple[int, int]] = {}

        def root(k: int) -> tuple[int, int]:
            x = (int(t.tile[k]), int(t.component[k]))
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        links = []
        for x, y in pairs[np.argsort(far, kind="stable")].tolist():
            a, b = root(x), root(y)
            if a == b:
                continue
            for k in (x, y):
                if k not in own:
                    own[k] = np.frombuffer(sets[k].as_py(), np.uint64)
            if is_link(own[x], own[y], percent):
                up[a] = b
                links.append((int(t.node[x]), int(t.node[y])))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])


def links_within(members: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links that connect all linked nodes; members: (key, node) of shared buckets.

    sigs: (node, n_shingles, sig); sets: (node, shingles, long_sig).
    """
    links = members.sparkSession.createDataFrame([], "a long, b long")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # who has many nodes in its buckets is close to many: the likeliest to be linked
    weights = members.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = common.materialize(members.join(weights, "node").select("key", "node", "weight", F.col("node").alias("component")), "weighed")
    common.discard(members)
    members = weighed
    for r in range(ROUNDS):
        # another quarter of the nodes goes first in each later round
        turn = F.lit(r == 0) | (F.pmod(F.xxhash64("node"), F.lit(4)) == r)
        heads = _open(members, F.max_by(F.struct("node", "component"), F.struct(turn, "weight", "node")).alias("head"))
        others = members.join(heads, "key").filter("component <> head.component")
        met = others.groupBy("node", F.col("head.node").alias("to")).agg(F.count(F.lit(1)).alias("shared"))
        offers = met.groupBy("node").agg(F.max_by("to", F.struct("shared", "to")).alias("to"))
        pairs = offers.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()
        new = common.materialize(confirm(pairs, sets, percent), "links")
        links, members = joined_up(links, new, members)
        if members.isEmpty():
            return links
        if WORTH * new.count() < members.agg(F.approx_count_distinct("node")).first()[0]:
            break
    return _tiled(links, members, sigs, sets, percent)


def joined_up(links: DataFrame, new: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links so far, and the members of buckets that still hold two components or more."""
    links = links.union(new)
    if new.isEmpty():
        return links, members
    # what is new joins components; each earlier link is within one
    joins = new.select(F.col("a").alias("node")).union(new.select(F.col("b").alias("node"))).distinct()
    of = members.join(joins, "node", "left_semi").select("node", "component").distinct()
    named = lambda side: of.select(F.col("node").alias(side), F.col("component").alias(f"{side}_in"))
    edges = new.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    labels = components(edges).select(F.col("node").alias("component"), F.col("component").alias("into"))
    own = members.join(labels, "component", "left").select("key", "node", "weight", F.coalesce("into", "component").alias("component"))
    own = common.materialize(own, "placed")
    left = common.materialize(own.join(_open(own), "key", "left_semi"), "members")
    common.discard(own, labels, members)
    return links, left


def _open(members: DataFrame, *more: Column) -> DataFrame:
    """Keys whose members are of two components or more."""
    return members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), *more).filter("lo < hi").drop("lo", "hi")


def _tiled(links: DataFrame, members: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """links and those that the tiles of what is left of the buckets confirm."""
    layout = laid_out(percent)
    about = sigs.join(sets.select("node", "long_sig"), "node")
    first = 0
    while True:
        sized = members.join(sigs.select("node", "n_shingles"), "node")
        blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") * 8 / BLOCK_BYTES)).cast("int")
        if first == 0:
            # a bucket's blocks are settled once, so that each pair of them meets once
            numbers = common.materialize(sized.groupBy("key").agg(blocks.alias("blocks")), "blocks")
            most = numbers.agg(F.max("blocks")).first()[0] or 0
        # block i meets i, i + 1, ... around the ring: half of it makes every pair meet
        own = members.join(numbers, "key").filter(F.col("blocks") >= 2 * first)
        own = own.withColumn("block", F.expr("int(pmod(xxhash64(node), blocks))"))
        reach = f"sequence({first}, least({first + NEIGHBOURS - 1}, int(blocks / 2)))"
        pairs = f"array_distinct(flatten(transform({reach}, d -> array(struct(block AS x, int(pmod(block + d, blocks)) AS y), struct(int(pmod(block - d, blocks)) AS x, block AS y)))))"
        own = own.withColumn("pair", F.explode(F.expr(f"array_distinct(transform({pairs}, p -> struct(least(p.x, p.y) AS i, greatest(p.x, p.y) AS j)))")))
        own = own.withColumn("tile", F.struct("key", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"))).join(about, "node")
        own = own.select("tile", "block", "component", "node", "sig", "long_sig")
        kind = own.schema
        near = _by_tile(own).mapInArrow(lambda x: _suspects(layout, x), kind)
        near = common.materialize(near, "suspects")
        new = _by_tile(near.join(sets.select("node", "shingles"), "node")).mapInArrow(lambda x: _forest(layout, percent, x), "a long, b long")
        new = common.materialize(new, "tile-links")
        common.discard(near)
        first += NEIGHBOURS
        if 2 * first > most:
            return links.union(new)
        links, members = joined_up(links, new, members)


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition("tile").sortWithinPartitions("tile", "node")


def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by tile, regrouped so that no tile is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.column("tile")[batch.num_rows - 1]
        cut = batch.num_rows
        while cut and batch.column("tile")[cut - 1] == last:
            cut -= 1
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and held[-1].column("tile")[0] != last:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def near_dedup(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, stays, set_hash.

    Links are pairs of sets with 100 * intersection >= percent * union; percent is at least 80,
    so that keys are of three slots or more. component_id is the smallest doc_id reachable; kept is
    doc_id = component_id, or `stays` where doc_id is null.
    """
    if percent < 80:
        raise ValueError("the signature is laid out for similarities of 0.8 or more")
    common.small_batches(docs.sparkSession)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    signed = common.materialize(signatures(docs), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    classes = signed.filter("n_shingles > 0").groupBy("set_hash").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = common.materialize(classes.select("set_hash", "first", F.col("first.row").alias("node"), "n_shingles", "sig"), "classes")
    chunk_slots = laid_out(percent).chunk_slots
    keys = common.materialize(classes.select("node", "sig").mapInArrow(lambda x: _keyed(chunk_slots, x), "key long, node long"), "keys")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    members = common.materialize(keys.join(shared, "key"), "members")
    common.discard(keys)
    wanted = common.materialize(classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "set_hash", F.col("first.doc_id").alias("doc_id"), "n_shingles", "sig"), "wanted")
    sets = sets_of(docs, wanted)
    labels = components(links_within(members, wanted.select("node", "n_shingles", "sig"), sets, percent))
    # the first row of each component, handed to its classes
    linked = classes.select("set_hash", "node", "first").join(labels, "node")
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    heads = linked.join(heads, "component").select("set_hash", "head")
    # classes as plain Parquet: AQE splits the partition of a class with very many copies
    heads = common.materialize(classes.select("set_hash", "first").join(heads, "set_hash", "left").select("set_hash", F.coalesce("head", "first").alias("head")), "class-heads")
    common.discard(sets, wanted, classes)
    out = signed.select("row", "doc_id", "n_shingles", "set_hash").join(heads, "set_hash", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("head.doc_id")).otherwise(F.col("doc_id"))
    stays = (F.col("n_shingles") == 0) | (F.col("row") == F.col("head.row"))
    kept = F.coalesce(F.col("doc_id") == component, stays)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), stays.alias("stays"), "set_hash")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, one row of each component at similarity 0.8.

    Texts are read again only where an id repeats or is null: there the row to keep is known by id and set.
    """
    decided = common.materialize(near_dedup(docs, percent=80).select("doc_id", "stays", "set_hash"), "near-decided")
    odd = common.materialize(decided.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select("doc_id"), "near-odd")
    named = odd.filter("doc_id IS NOT NULL")
    dropped = decided.filter("NOT stays AND doc_id IS NOT NULL").select("doc_id").union(named).distinct()
    plain = common.join_ids(docs.filter(docs["doc_id"].isNotNull()), dropped, "doc_id", "left_anti")
    if odd.isEmpty():
        return plain
    again = common.join_ids(docs, named, "doc_id", "left_semi").select(docs.columns).unionByName(docs.filter(docs["doc_id"].isNull()))
    mark, of, wanted = (common.unused(docs, x) for x in ("near_set", "near_of", "near_wanted"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _texts(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(map(set_hash, sets), pa.binary())], [*part.schema.names, mark])

    again = again.mapInArrow(hashed, StructType([*docs.schema.fields, StructField(mark, BinaryType())]))
    again = common.materialize(again, "near-again")
    stay = decided.filter("stays AND set_hash IS NOT NULL").select(F.col("doc_id").alias(of), F.col("set_hash").alias(wanted))
    same = (F.col(mark) == F.col(wanted)) & F.col("doc_id").eqNullSafe(F.col(of))
    one = again.join(stay, same, "left_semi").dropDuplicates(["doc_id", mark])
    return plain.unionByName(one.unionByName(again.filter(F.col(mark).isNull())).drop(mark))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(common.read_table(spark, sf_dir, "documents")).drop("set_hash")
