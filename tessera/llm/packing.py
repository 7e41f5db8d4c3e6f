"""Best-fit packing of token pieces, improved by swap-based local search.

Documents are tokenised where they lie; only (doc_id, piece, start, length, crc) travel. Pieces are
dealt by hash into groups of about GROUP pieces, a bounded amount of work and memory whatever the
size of the corpus; each group is packed best-fit decreasing, then a local search over its underfull
bins moves documents or exchanges one for one, one for two and two for one wherever that raises the sum of squared
fills, until no step between any two bins does, so that the emptiest bins drain and vanish. The bins that are still underfull in all groups
are pooled, and their pieces packed again in fewer groups, until one group would hold them or a round
saves fewer than one bin in SAVED.

Defined results: a null text counts as empty and is one piece of the end token; documents longer than
the capacity are cut so that all pieces but the first are full; rows that share a doc_id are packed
as separate documents (sequence_id and offset tell them apart); a null doc_id is carried as null. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY = 1024
END_ID = 2
GROUP = 16_384
SAVED = 1_000
PIECE_SCHEMA = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of the vocabulary in a tokenizers file.

    Texts are encoded by a rank-based encoder of the same vocabulary and split pattern, which gives
    the same ids several times faster; texts that hold a special token's string, and any that the
    fast encoder refuses, go through the tokenizers library.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        self.path, self.exact = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = None
        if ranked(spec):
            back = {v: k for k, v in byte_letters().items()}
            ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
            self.fast = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # the encoder's native panics aren't Exceptions
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return self.slowly(text)

    def slowly(self, text: str) -> list[int]:
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.path)
        return self.exact.encode(text, add_special_tokens=False).ids


def ranked(spec: dict) -> bool:
    """Whether ids alone tell a tokenizers file's merges: byte-level BPE with nothing beside it, each merge's result next in the vocabulary."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    if spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback"):
        return False
    if (spec.get("post_processor") or {}).get("type") not in (None, "ByteLevel"):
        return False
    made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    return None not in made and made == sorted(set(made)) and min(made, default=256) >= 256


#: The split pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def pieces_of(ids: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of one document's ids: all pieces but the first are full."""
    raw = np.asarray(ids, dtype="<u4")
    first = len(raw) % capacity or capacity
    edges = [0, *range(first, len(raw) + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(raw[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.once_a_worker(("encoder", tokenizer), lambda: Encoder(tokenizer))
        for batch in batches:
            of, out = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = encoder.encode(text)
                ids.append(END_ID)
                got = pieces_of(ids, capacity)
                of += [k] * len(got)
                out += got
            of = pa.array(of, pa.int64())
            piece, start, length, crc = zip(*out) if out else ((),) * 4
            columns = [batch.column("row").take(of), batch.column("doc_id").take(of), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    common.small_batches(docs.sparkSession)
    return docs.select(
        F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("doc_id"), common.text_of(docs, text_col).alias("text")
    ).mapInArrow(run, PIECE_SCHEMA)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0  # bit g is set if some bin has gap g
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fits = open_gaps >> n
        if fits:
            gap = n + ((fits & -fits).bit_length() - 1)
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps &= ~(1 << gap)
            bins[b].append(int(i))
        else:
            gap, b = capacity, len(bins)
            bins.append([int(i)])
        left = gap - n
        if left:
            by_gap[left].append(b)
            open_gaps |= 1 << left
    return bins


class Underfull:
    """Bins with a gap, found by what they take and give back.

    An item of n tokens fits a bin of gap g in exchange for s < n of its tokens if n <= g + s, and then
    leaves g + s - n. So offers[k] (s is one item for k = 0, a pair for k = 1) keeps for each g + s the s
    as bits of a number, and holders[k] the bins behind each (g, s): the best exchange in any number of
    bins is a walk over at most `capacity` numbers.
    """

    def __init__(self, capacity: int):
        self.gaps = 0
        self.by_gap: dict[int, dict[int, None]] = {}
        self.offers = [[0] * (2 * capacity + 1) for _ in range(2)]
        self.holders: list[dict[tuple[int, int], dict[int, None]]] = [{}, {}]
        self.kept: dict[int, tuple[int, tuple[set[int], set[int]]]] = {}

    def enter(self, b: int, gap: int, sizes: list[int]) -> None:
        if gap <= 0 or not sizes:
            return
        seen: set[int] = set()
        sums: set[int] = set()
        for n in sizes:
            sums.update([n + x for x in seen])
            seen.add(n)
        sums.update(2 * n for n in seen if sizes.count(n) > 1)
        self.kept[b] = (gap, (seen, sums))
        self.by_gap.setdefault(gap, {})[b] = None
        self.gaps |= 1 << gap
        for k, gives in enumerate((seen, sums)):
            for x in gives:
                self.holders[k].setdefault((gap, x), {})[b] = None
                self.offers[k][gap + x] |= 1 << x

    def leave(self, b: int) -> None:
        gap, both = self.kept.pop(b, (0, ((), ())))
        if not gap:
            return
        del self.by_gap[gap][b]
        if not self.by_gap[gap]:
            self.gaps &= ~(1 << gap)
        for k, gives in enumerate(both):
            for x in gives:
                own = self.holders[k][gap, x]
                del own[b]
                if not own:
                    del self.holders[k][gap, x]
                    self.offers[k][gap + x] &= ~(1 << x)

    def taker(self, n: int, gap: int) -> int | None:
        """The fullest bin that takes n tokens and is then left a gap below the one given."""
        fits = self.gaps >> n
        found = n + ((fits & -fits).bit_length() - 1) if fits else n + gap
        return next(iter(self.by_gap[found])) if found - n < gap else None

    def exchange(self, n: int, gap: int, kinds: tuple[int, ...] = (0, 1)) -> tuple[int, int, int] | None:
        """(bin, tokens given back, 0 for one item or 1 for a pair): the bin that n tokens for fewer fill best, to a gap below the one given."""
        for v in range(n, n + gap):
            for k in kinds:
                give = self.offers[k][v] & ((1 << n) - 1)
                if give:
                    s = give.bit_length() - 1
                    return next(iter(self.holders[k][v - s, s])), s, k
        return None


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Drain the emptiest underfull bins into others until no step is left.

    A step gives one document, for none, one or two, or two documents for one, from a bin A to a bin B. Their fills' sum stays, so the
    squared fill rises if and only if B then is fuller than the fuller of both was. Every bin is tried as A
    against all others as B, so a step after which A would be the fuller is found from the other side.
    """
    size = [int(x) for x in lengths]
    fill = [sum(size[i] for i in b) for b in bins]
    under = Underfull(capacity)
    enter = lambda k: under.enter(k, capacity - fill[k], [size[i] for i in bins[k]])
    for k in range(len(bins)):
        enter(k)

    def step(a: int, given: list[int]) -> bool:
        """Give some of a's items to the bin that they fill best, if there is one; a isn't among the bins meanwhile."""
        n, gap = sum(size[i] for i in given), capacity - fill[a]
        b, out = under.taker(n, gap) if len(given) == 1 else None, []
        if b is None:
            found = under.exchange(n, gap, (0, 1) if len(given) == 1 else (0,))
            if found is None:
                return False
            b, s, pair = found
            out = _pair_of(bins[b], size, s) if pair else [next(j for j in bins[b] if size[j] == s)]
        under.leave(b)
        bins[a] = [*(x for x in bins[a] if x not in given), *out]
        bins[b] = [*(x for x in bins[b] if x not in out), *given]
        gain = n - sum(size[j] for j in out)
        fill[a] -= gain
        fill[b] += gain
        enter(b)
        return True

    changed = True
    while changed:
        changed = False
        for a in sorted(under.kept, key=lambda k: (fill[k], k)):
            if a not in under.kept:  # filled or emptied meanwhile
                continue
            under.leave(a)
            for i in sorted(bins[a], key=lambda x: -size[x]):
                changed |= step(a, [i])
            pairs = {size[i] + size[j]: [i, j] for k, i in enumerate(bins[a]) for j in bins[a][:k]}
            for n in sorted(pairs, reverse=True):
                if step(a, pairs[n]):
                    changed = True
                    break  # its items are others now; the next pass goes on
            enter(a)
    return [b for b in bins if b]


def _pair_of(items: list[int], size: list[int], total: int) -> list[int]:
    seen: dict[int, int] = {}
    for j in items:
        if total - size[j] in seen:
            return [seen[total - size[j]], j]
        seen.setdefault(size[j], j)
    raise AssertionError("no such pair")


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def _pack_group(table: pa.Table, capacity: int) -> pa.Table:
    table = table.sort_by([("row", "ascending"), ("piece", "ascending")])
    lengths = table.column("length").to_numpy()
    number, offset, full = (np.zeros(len(lengths), np.int64) for _ in range(3))
    for k, b in enumerate(pack_lengths(lengths, capacity)):
        number[b] = k
        offset[b] = np.cumsum(lengths[b]) - lengths[b]
        full[b] = lengths[b].sum()
    for name, x in (("bin", number), ("offset", offset), ("fill", full)):
        table = table.append_column(name, pa.array(x))
    return table


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces (PIECE_SCHEMA, as written by materialize) with sequence_id and offset."""
    schema = f"{PIECE_SCHEMA}, deal long, bin long, offset long, fill long"
    columns = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
    # a full piece is a sequence of its own, numbered below zero
    done = pieces.filter(F.col("length") == capacity).select(
        *columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest, level, before = pieces.filter(F.col("length") < capacity), 0, None
    n = rest.count()
    while n:
        deals = -(-n // group)
        dealt = rest.withColumn("deal", F.expr(f"pmod(xxhash64(row, piece, {level}), {deals})"))
        packed = dealt.groupBy("deal").applyInArrow(lambda t: _pack_group(t, capacity), schema)
        packed = common.materialize(packed, "packed")
        number = F.lit(level << 57) + F.shiftleft("deal", 20) + F.col("bin")
        packed = packed.withColumn("sequence_id", number)
        full = F.col("fill") == capacity
        left, bins, open_bins = packed.agg(F.count_if(~full), F.count_if(F.col("offset") == 0), F.count_if(~full & (F.col("offset") == 0))).first()
        if before is not None and bins > before[0]:
            done = done.union(before[1])
            break
        last = deals == 1 or (before is not None and (before[0] - bins) * SAVED < before[0])
        kept = columns + ["sequence_id", "offset"]
        done = done.union((packed if last else packed.filter(full)).select(kept))
        if last:
            break
        under = packed.filter(~full).select(kept)
        rest, n, level, before = under.select(*columns), left, level + 1, (open_bins, under)
    return done


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = common.materialize(tokenised(docs, tokenizer or default_tokenizer(), capacity, id_col, text_col), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing(docs)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(common.read_table(spark, sf_dir, "documents"))
