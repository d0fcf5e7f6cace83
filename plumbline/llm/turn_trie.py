"""Prefix trie of conversations: who shares which first turns, and what sharing saves.

Distinct turns (role and text, told apart by sha256) become numbers through a dictionary table, so texts leave the job after
one pass. Each conversation is rebuilt from its host's first turns and its own rest, as a list of numbers. The lists, with
``conv_id`` as the last sort column, are dealt into ranges of about ``SHARD_TURNS`` turns. Equal lists lie next to each other
and may be cut between ranges, so a conversation that many repeat spreads over tasks.

In a range a ternary search tree is filled by medians first, which keeps every search tree of siblings balanced. Nodes are
numbered as they are made, parents before children, so one backward walk sums leaves and savings. Only nodes on the path of
a range's first or last list can occur in another range: these boundary nodes are handed over as two lists a range and merged
in order by one task (two lists a range, whatever the number of conversations). Children of boundary nodes then get their
parent's name by a join on range, path and depth.

What a task holds: a range's numbers, or one conversation if it is longer, at 12 bytes a turn. The text of
``ends_sha256`` names every conversation that ends in a node and is hashed in one piece, so its parts meet in one task.

Defined results: null role or text counts as empty; turns are ordered by ``turn``, null first, equal ones by sha256 of role and
text; repeated rows are turns of their own. Rows without ``conv_id`` belong to no conversation. An empty table gives no nodes.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import small_side, stage

SHARD_TURNS = 20_000
HOST_EVERY = 20
HEADS = 4  # crc32 of the id modulo this: how many turns come from the host
BLANKS = "[\\x20\\x09-\\x0D]+"
NONE = 2**63 - 1
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest of role and text, words of the text."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    seen = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.size(F.filter(F.split(text, BLANKS), lambda w: w != "")).alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return seen.select("conv_id", F.row_number().over(order).alias("pos"), "digest", "words")


def encoded(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, id, words: turns as numbers of a dictionary, written."""
    numbered = stage(turns(conversations), "trie-turns")
    dictionary = stage(numbered.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")
    return stage(numbered.join(dictionary, "digest").select("conv_id", "pos", "id", "words"), "trie-encoded")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, ids, words: one row per conversation, those without turns too."""
    own = encoded(conversations)
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = own.select("conv_id").distinct().select("conv_id", heads.alias("heads"), (F.col("conv_id") - F.col("conv_id") % HOST_EVERY).alias("host"))
    rest = own.where(F.col("pos") > heads)
    first = own.where((F.col("pos") < HEADS) & (F.col("conv_id") % HOST_EVERY == 0)).withColumnRenamed("conv_id", "host")
    taken = first.join(convs, "host").where("pos <= heads")
    bare = convs.select("conv_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("words"))
    rows = rest.unionByName(taken.select(*rest.columns)).unionByName(bare)
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "id", "words")))).alias("turns"))
    return lists.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words"))


class TernaryTrie:
    """Trie nodes with their siblings in binary search trees. Node 0 is the root; children have larger numbers than parents."""

    def __init__(self) -> None:
        self.key, self.low, self.high, self.down = [-1], [-1], [-1], [-1]
        self.parent, self.depth, self.words = [-1], [0], [0]
        self.members, self.least, self.ends, self.kids = [0], [NONE], [[]], [0]

    def _child(self, node: int, key: int, words: int) -> int:
        at, links, link = self.down[node], self.down, node
        while at >= 0:
            if key == self.key[at]:
                return at
            links, link = (self.low, at) if key < self.key[at] else (self.high, at)
            at = links[link]
        links[link] = new = len(self.key)
        for column, value in ((self.key, key), (self.low, -1), (self.high, -1), (self.down, -1), (self.parent, node), (self.depth, self.depth[node] + 1),
                              (self.words, words), (self.members, 0), (self.least, NONE), (self.ends, []), (self.kids, 0)):
            column.append(value)
        self.kids[node] += 1
        return new

    def insert(self, ids: list[int], words: list[int], conv: int) -> list[int]:
        """The path of nodes, root first."""
        node, path = 0, [0]
        for key, n in zip(ids, words):
            node = self._child(node, key, n)
            path.append(node)
        for node in path:
            self.members[node] += 1
            self.least[node] = min(self.least[node], conv)
        self.ends[path[-1]].append(conv)
        return path


def medians(n: int) -> Iterator[int]:
    """0..n-1 with the middle of every span before its halves."""
    spans = [(0, n)]
    while spans:
        wider = []
        for lo, hi in spans:
            if lo < hi:
                mid = (lo + hi) // 2
                yield mid
                wider += [(lo, mid), (mid + 1, hi)]
        spans = wider


def digest_of(convs: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(convs))).encode()).hexdigest() if convs else NO_ENDS


NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
        "shard int, side int, at int")
SPINE = ("ids array<long>, words array<int>, from int, members array<long>, least array<long>, kids array<long>, leaves array<long>, saved array<long>, "
         "ends array<string>")
NAMES = [part.split()[0] for part in f"{NODE}, {SPINE}".split(", ")]
TYPES = {"conv_id": pa.int64(), "ends_sha256": pa.string(), "shard": pa.int32(), "side": pa.int32(), "at": pa.int32(), "from": pa.int32(),
         "words": pa.list_(pa.int32()), "ends": pa.list_(pa.string())}
LISTS = {"ids", "members", "least", "kids", "leaves", "saved"}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(NAMES)
    kinds = [TYPES.get(n, pa.list_(pa.int64()) if n in LISTS else pa.int64()) for n in NAMES]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=NAMES)


def _slices(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 10_000):
        yield _batch(rows[at:at + 10_000])


def build_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one range of sorted lists, and its two boundary paths.

    A node below a boundary node has no parent's name yet: (shard, side, at) say which boundary node that is.
    """
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    table = pa.Table.from_batches(tables)
    convs, ids, words = (table.column(c).to_pylist() for c in ("conv_id", "ids", "words"))
    shard = table.column("shard")[0].as_py()
    trie, first, last = TernaryTrie(), [], []
    for i in medians(len(convs)):
        path = trie.insert(ids[i], words[i], convs[i])
        first, last = path if i == 0 else first, path if i == len(convs) - 1 else last
    n = len(trie.key)
    side = dict.fromkeys(last, 1) | dict.fromkeys(first, 0)  # shared nodes belong to the first path
    leaves, saved = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if i not in side:
            leaves[i] = leaves[i] or 1
            saved[i] += (trie.members[i] - 1) * trie.words[i]
            leaves[trie.parent[i]] += leaves[i]
            saved[trie.parent[i]] += saved[i]
    for i in side:
        if i and trie.parent[i] in side:
            trie.kids[trie.parent[i]] -= 1  # boundary children are counted when they are merged
    out = []
    for i in range(n):
        if i not in side:
            up, on = trie.parent[i], trie.parent[i] in side
            out.append((trie.least[i], trie.depth[i], None if on else trie.least[up], trie.members[i], trie.kids[i], leaves[i], saved[i], digest_of(trie.ends[i]),
                        shard if on else None, side[up] if on else None, trie.depth[up] if on else None, *[None] * 9))
    for k, path in enumerate((first, last)):
        own = [i for i in path if side[i] == k]
        start = len(path) - len(own)
        at = 0 if k == 0 else len(convs) - 1
        if own:
            out.append((*[None] * 8, shard, k, None, ids[at], words[at], start, [trie.members[i] for i in own], [trie.least[i] for i in own],
                        [trie.kids[i] for i in own], [leaves[i] for i in own], [saved[i] for i in own], [",".join(map(str, sorted(trie.ends[i]))) for i in own]))
    yield from _slices(out)


def merge_boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boundary nodes with their sums over all ranges; and for each (shard, side, at) the name of its node, as a row of depth -1.

    Paths come in order, so the nodes that a path shares with an earlier one are those it shares with the one just before.
    """
    key, parent, depth, words = [-1], [-1], [0], [0]
    members, least, kids, leaves, saved, ends, names = [0], [NONE], [0], [0], [0], [[]], []
    path = [0]
    for batch in batches:
        for row in batch.to_pylist():
            shared = 0
            while shared < min(len(path) - 1, len(row["ids"])) and key[path[shared + 1]] == row["ids"][shared]:
                shared += 1
            del path[shared + 1:]
            for d in range(shared, len(row["ids"])):
                kids[path[-1]] += 1
                for column, value in ((key, row["ids"][d]), (parent, path[-1]), (depth, d + 1), (words, row["words"][d]), (members, 0), (least, NONE),
                                      (kids, 0), (leaves, 0), (saved, 0), (ends, [])):
                    column.append(value)
                path.append(len(key) - 1)
            for j, node in enumerate(path[row["from"]:]):
                members[node] += row["members"][j]
                least[node] = min(least[node], row["least"][j])
                kids[node] += row["kids"][j]
                leaves[node] += row["leaves"][j]
                saved[node] += row["saved"][j]
                if row["ends"][j]:
                    ends[node].append(row["ends"][j])
                names.append((node, row["shard"], row["side"], row["from"] + j))
    if not members[0]:
        return
    for i in range(len(key) - 1, -1, -1):
        leaves[i] += not kids[i]
        saved[i] += (members[i] - 1) * words[i]
        if i:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    out = [(least[i], depth[i], least[parent[i]] if i else None, members[i], kids[i], leaves[i], saved[i], hashlib.sha256(",".join(ends[i]).encode()).hexdigest(),
            None, None, None, *[None] * 9) for i in range(len(key))]
    out += [(least[i], -1, None, None, None, None, None, None, shard, side, at, *[None] * 9) for i, shard, side, at in names]
    yield from _slices(out)


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    lists = stage(rebuilt(conversations), "trie-lists")
    total = lists.agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(1))).first()[0]
    ranges = lists.repartitionByRange(math.ceil(total / shard_turns), "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    parts = stage(ranges.withColumn("shard", F.spark_partition_id()).mapInArrow(build_shard, f"{NODE}, {SPINE}"), "trie-shards")
    spines = parts.where("ids IS NOT NULL").coalesce(1).sortWithinPartitions("shard", "side")
    merged = stage(spines.mapInArrow(merge_boundaries, f"{NODE}, {SPINE}"), "trie-boundaries")
    fields = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    names = merged.where("depth < 0").select("shard", "side", "at", F.col("conv_id").alias("named"))
    nodes = parts.where("ids IS NULL")
    below = nodes.where("shard IS NOT NULL").join(small_side(names), ["shard", "side", "at"]).withColumn("parent_conv_id", F.col("named"))
    return nodes.where("shard IS NULL").select(*fields).unionByName(below.select(*fields)).unionByName(merged.where("depth >= 0").select(*fields))
