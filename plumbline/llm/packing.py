"""Packing of token pieces into sequences by linear grouping, few-size configurations and best fit.

Documents become token ids and an end id; only those longer than a sequence are cut, so that at most their first piece is
short. What the packing needs to know of a corpus is how many pieces have each length: at most ``capacity`` numbers, at any
size of input. From them the driver makes a plan:

1. long pieces are dealt into ``groups`` groups of equal cardinality, and count as long as the longest of their group;
2. for these few sizes the configurations of a sequence are optimised: a linear program over all configurations, whose
   columns a knapsack generates, rounded down;
3. actual lengths take the place of the rounded ones: each slot takes the longest piece left that its size covers, the last
   slot the longest that fits, so what rounding left loose is used; a configuration ends where that leaves more than a 512th
   of a sequence empty, and the pieces then left are grouped and configured again, ``ROUNDS`` times at most;
4. what is left, and all short pieces, go best-fit in decreasing length into the room there is.

The plan says, in runs, which ranks of a length go to which sequences and offset. Its rows depend on the number of lengths
and configurations, not on the number of documents. Spark then ranks the pieces of each length in salted parts, so a
length that a third of the pieces have is not one task, and looks each rank up in the plan.

Defined results: null and empty texts are one piece, the end id. Rows without ``doc_id`` and repeated rows are packed as
pieces of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import id_and_text
from plumbline.session import stage

CAPACITY = 2048
END_ID = 0
GROUPS = 32
TIGHT = 512
ROUNDS = 8
PIECES_PER_RANKING = 100_000
CACHE_WORDS = 400_000

PIECE_FIELDS = "doc_id long, piece int, start long, length long, ids binary"

# Fixed values of byte-level BPE vocabularies: the pretoken pattern, and the bytes that stand for themselves.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

# No pretoken goes over a single blank between two visible characters, so texts may be cut there.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


class _WordIds(dict):
    """Ids (little-endian uint32) of a word with a blank before it; bounded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = np.array(self.encode(" " + word), "<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """Encoder of the byte-level BPE vocabulary in a tokenizers file: text to ids as bytes.

    The file's ids are its merge ranks, so the ranks alone give the ids that the file's own library gives, several times
    faster; words are looked up in a bounded table before they are merged again.
    """
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    rest = [b for b in range(256) if b not in set(PLAIN_BYTES)]
    byte_of = {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if not (token.startswith("<|") and token.endswith("|>"))}
    encode = tiktoken.Encoding("ranks", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    seen = _WordIds(encode)

    def ids(text: str) -> bytes:
        first, *words = SAFE_CUT.split(text)
        return np.array(encode(first), "<u4").tobytes() + b"".join([seen[w] for w in words])

    return ids


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian uint32 bytes) of every piece of every whole text."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches):
        encode = tokenizer(tokenizer_path)
        for batch in batches:
            rows = ([], [], [], [], [])
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                at, stop = 0, (total - 1) % capacity + 1
                while at < total:
                    for store, value in zip(rows, (doc_id, (at - 1) // capacity + 1, at, stop - at, ids[4 * at:4 * stop])):
                        store.append(value)
                    at, stop = stop, stop + capacity
                size += len(ids)
                if size > 4 << 20:
                    yield _piece_batch(rows)
                    rows, size = ([], [], [], [], []), 0
            if rows[0]:
                yield _piece_batch(rows)

    return id_and_text(docs).mapInArrow(cut, PIECE_FIELDS)


def _piece_batch(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids"])


def configurations(sizes: list[int], demands: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of a few sizes and how often to use each: the linear program's optimum, rounded down."""
    k = len(sizes)
    basis = np.diag([capacity // x for x in sizes]).astype(float)
    need = np.array(demands, float)
    for _ in range(40 * k):
        worth = np.linalg.solve(basis.T, np.ones(k))
        column = _knapsack(sizes, worth, capacity)
        if column @ worth <= 1 + 1e-7:
            break
        along, level = np.linalg.solve(basis, column), np.linalg.solve(basis, need)
        ratio = np.where(along > 1e-9, np.maximum(level, 0) / np.where(along > 1e-9, along, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    uses = np.floor(np.linalg.solve(basis, need) + 1e-6).astype(int)
    return [(basis[:, j].astype(int), int(uses[j])) for j in range(k) if uses[j] > 0]


def _knapsack(sizes: list[int], worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size make the most worth in one sequence."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for g, size in enumerate(sizes):
        for _ in range(capacity // size):
            more = best[:-size] + worth[g]
            better = more > best[size:] + 1e-12
            if not better.any():
                break
            best[size:][better] = more[better]
            pick[size:][better] = g
    column, c = np.zeros(len(sizes)), capacity
    while pick[c] >= 0:
        column[pick[c]] += 1
        c -= sizes[pick[c]]
    return column


def group_sizes(long_ones: list[tuple[int, int]], groups: int) -> tuple[list[int], list[int]]:
    """Longest length and cardinality of each of ``groups`` groups of equal cardinality; groups of one length are one."""
    total = sum(n for _, n in long_ones)
    k = min(groups, total)
    bounds = [total * (g + 1) // k for g in range(k)] if k else []
    grouped: dict[int, int] = {}
    seen, g, longest = 0, 0, None
    for length, n in long_ones:
        while n:
            longest = longest or length
            take = min(n, bounds[g] - seen)
            grouped[longest] = grouped.get(longest, 0) + take
            seen, n = seen + take, n - take
            if seen == bounds[g]:
                g, longest = g + 1, None
    return list(grouped), list(grouped.values())


def substituted(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]], int]:
    """What configurations place: runs as in ``make_plan``, (room, first sequence, sequences) and the number of sequences."""
    runs: list[tuple[int, int, int, int, int]] = []
    rooms: list[tuple[int, int, int]] = []
    used: dict[int, int] = dict.fromkeys(counts, 0)
    sequences = counts.get(capacity, 0)
    if sequences:
        runs.append((capacity, 0, sequences, 0, 0))
    placed_before = -1
    for _ in range(ROUNDS):
        long_ones = sorted(((x, n - used[x]) for x, n in counts.items() if n > used[x] and capacity // 8 < x < capacity), reverse=True)
        if not long_ones or len(rooms) == placed_before:
            break
        placed_before = len(rooms)
        sizes, demands = group_sizes(long_ones, groups)
        open_lengths = sorted(x for x, _ in long_ones)
        for shape, times in configurations(sizes, demands, capacity):
            slots = [size for size, n in zip(sizes, shape) for _ in range(n)]
            while times and open_lengths:
                # Each slot takes the longest piece left that its rounded size covers. Rounding leaves room, so the last slot
                # takes the longest piece that fits, and further ones follow while any long piece does.
                chosen: dict[int, int] = {}
                order: list[int] = []
                free = capacity
                for slot in [*slots[:-1], *[capacity] * (capacity // open_lengths[0])]:
                    i = bisect_right(open_lengths, min(slot, free)) - 1
                    while i >= 0 and counts[open_lengths[i]] - used[open_lengths[i]] <= chosen.get(open_lengths[i], 0):
                        i -= 1
                    if i >= 0:
                        x = open_lengths[i]
                        chosen[x] = chosen.get(x, 0) + 1
                        order.append(x)
                        free -= x
                if free > capacity // TIGHT:
                    break
                step = min(times, *((counts[x] - used[x]) // n for x, n in chosen.items()))
                offset = 0
                for x in order:
                    runs.append((x, used[x], step, sequences, offset))
                    used[x] += step
                    offset += x
                rooms.append((free, sequences, step))
                sequences, times = sequences + step, times - step
                for x in chosen:
                    if used[x] == counts[x]:
                        open_lengths.pop(bisect_left(open_lengths, x))
    return runs, rooms, sequences


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first sequence, offset) that place all pieces, and the number of sequences."""
    used: dict[int, int] = dict.fromkeys(counts, 0)
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    runs, configured, sequences = substituted(counts, capacity, groups)
    for length, _, n, _, _ in runs:
        used[length] += n

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], n, sequence, offset))
        used[length] += n

    def leave(free: int, sequence: int, n: int) -> None:
        if free > 0 and n > 0:
            if free not in room:
                room[free] = []
                insort(rooms, free)
            room[free].append((sequence, n))

    for free, sequence, n in configured:
        leave(free, sequence, n)
    for length in sorted((x for x in counts if x < capacity), reverse=True):
        left = counts[length] - used[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                break
            free = rooms[i]
            sequence, n = room[free].pop()
            if not room[free]:
                del room[free]
                rooms.pop(i)
            take = min(n, left)
            if take < n:
                leave(free, sequence + take, n - take)
            place(length, take, sequence, capacity - free)
            leave(free - length, sequence, take)
            left -= take
        per = capacity // length
        whole, rest = divmod(left, per)
        for n_bins, fill in ((whole, per), (1, rest)):
            if n_bins and fill:
                for j in range(fill):
                    place(length, n_bins, sequences, j * length)
                leave(capacity - fill * length, sequences, n_bins)
                sequences += n_bins
    return runs, sequences


def placed(sized: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``sized`` (doc_id, piece, length and more; written already) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in sized.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = make_plan(counts, capacity, groups)
    parts = max(16, -(-sum(counts.values()) // PIECES_PER_RANKING))
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    length, first, n, sequence, offset = (np.array(x, np.int64) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 5
    order = np.lexsort((first, length))
    length, first, sequence, offset = length[order], first[order], sequence[order], offset[order]
    # One axis for all lengths: the pieces of shorter lengths come before.
    shift = np.zeros(capacity + 2, np.int64)
    for x, c in counts.items():
        shift[x + 1] = c
    shift = np.cumsum(shift)
    starts = shift[length] + first

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def look_up(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        at = shift[lengths.to_numpy(zero_copy_only=False)] + ranks.to_numpy(zero_copy_only=False)
        i = np.searchsorted(starts, at, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(sequence[i] + at - starts[i]), pa.array(offset[i])], names=["sequence_id", "offset"])

    out = ranked.join(base, ["length", "salt"]).withColumn("at", look_up("length", F.col("rank") + F.col("base")))
    return out.select(*[c for c in sized.columns], "at.sequence_id", "at.offset")


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Ids don't move; their digest does."""
    sized = stage(pieces(docs, tokenizer_path, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "packing-pieces")
    return placed(sized, capacity, groups)


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """The sequences themselves: sequence_id, length, ids (little-endian uint32 bytes), doc_ids in order."""
    cut = pieces(docs, tokenizer_path, capacity)
    made = stage(cut, "packing-ids")
    whole = placed(made, capacity, groups)
    rows = whole.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("x"))
    return rows.select("sequence_id", F.concat(*[F.lit(b"")], F.reduce("x", F.lit(b""), lambda a, y: F.concat(a, y["ids"]))).alias("ids"),
                       F.transform("x", lambda y: y["doc_id"]).alias("doc_ids")).withColumn("length", (F.length("ids") / 4).cast("long"))
