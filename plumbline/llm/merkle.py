"""Merkle manifest of a table: per-language trees, a tree over their roots, and a recursive climb that audits every leaf.

``levels`` builds the tree bottom-up, eight consecutive nodes to a parent, and stores one row per parent: its key, its
children's hashes in order, its hash, and a link to its own parent. ``climb`` is a recursive SQL query over that table: it
starts at a leaf, follows the link, appends the siblings found there, and folds the tampered hash with them.

* Leaf positions come from ranges, not from a window over a language, so one language may hold most rows.
* Nodes with at least 1/``CROWN`` of all leaves below them would be hot keys of the climb's join. There are at most ``CROWN`` of
  them at each depth, a few thousand rows of 650 bytes in all, so they are broadcast. Leaves climb below this crown by a
  shuffle, and through it by the broadcast.
* A path through the crown is shared by all leaves that enter it at one place. Its siblings are appended by a climb from
  that place, once, not again for each leaf; only the folded hash goes up per leaf.
* A step's row has only that step's siblings, as 32 bytes each; the steps of a leaf are put in a row at the end. What the
  climb moves is therefore in proportion to leaves times levels.

Every hash is lowercase hex sha256; hashes are joined as hex text. Defined results: null columns count as ``-``; leaves with
equal ``doc_id`` are ordered by their hash, null ids come first; repeated rows are leaves of their own. An empty table gives
no rows. A lone leaf is its own subroot, and a lone subroot the root. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.keys import join_on
from plumbline.operators.ranges import positions
from plumbline.session import small_side, stage

FAN = 8
CROWN = 512
TAMPER_EVERY = 3
# Rows of a task that puts children under their parents or climbs; few rows make few tasks, of which every step has its own.
TASK_ROWS = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1  # the tree over the subroots; languages are numbered from 0

ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    return F.sha2(F.concat(*[_field(text if c == "text" else F.col(c)) for c in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and ``offered``: the leaf of the tampered text for every third crc32 of an id, else null. One pass."""
    shouted = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0, F.lit(False))
    return docs.select("doc_id", "lang", leaf_hash(F.col("text")).alias("leaf"), F.when(chosen, leaf_hash(shouted)).alias("offered"))


def placed_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, offered, tree (number of the language) and pos (place in it), written."""
    ordered = positions(leaves(docs), [F.col("doc_id"), F.col("leaf")], ["lang"], "pos", "merkle-leaves")
    # The trees are ordered by language, bytewise, null first: Spark's own order of strings.
    trees = positions(ordered.select("lang").distinct(), [F.col("lang")], (), "tree", "merkle-trees")
    return stage(join_on(ordered, small_side(trees), ["lang"]).select("doc_id", "leaf", "offered", "tree", "pos"), "merkle-placed")


def _name(tree: Column | str, level: Column | int, pos: Column) -> Column:
    """The key of a node."""
    level = F.lit(level) if isinstance(level, int) else level
    return F.concat_ws("/", F.col(tree) if isinstance(tree, str) else tree, level, pos)


def _parents(nodes: DataFrame) -> DataFrame:
    """One level up: tree, level, pos, children (hashes in order), below (leaves), hash; trees of one node have ended."""
    grouped = nodes.where("width > 1").groupBy(
        "tree", (F.col("level") + 1).alias("level"), F.floor(F.col("pos") / FAN).alias("pos"), F.ceil(F.col("width") / FAN).alias("width"),
    ).agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("kids"), F.sum("below").alias("below"))
    return grouped.select("tree", "level", "pos", "width", F.col("kids.hash").alias("children"), "below", F.sha2(F.concat_ws("", "kids.hash"), 256).alias("hash"))


def levels(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The parent nodes of all trees (node, up, slot, children, below, hash), and the subroots (tree, subroot, pos, up)."""
    widths = stage(placed.groupBy("tree").agg(F.count("*").alias("width")), "merkle-widths")
    own = placed.join(small_side(widths), "tree").select("tree", F.lit(0).alias("level"), "pos", "width", F.lit(1).cast("long").alias("below"), F.col("leaf").alias("hash"))

    def build(nodes: DataFrame, widest: int, rows: int) -> tuple[list[DataFrame], list[DataFrame]]:
        """All parents of a set of trees of ``rows`` nodes, and the last node of each."""
        parents, tops, most = [], [nodes.where("width = 1")], rows
        while widest > 1:
            nodes = stage(_parents(nodes).coalesce(max(1, math.ceil(most / TASK_ROWS))), "merkle-level")
            most = most // FAN + count
            parents.append(nodes)
            tops.append(nodes.where("width = 1"))
            widest = math.ceil(widest / FAN)
        return parents, tops

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    few = ("tree", "level", "pos", "width", "below", "hash")
    count, widest, total = widths.agg(F.count("*"), F.coalesce(F.max("width"), F.lit(0)), F.coalesce(F.sum("width"), F.lit(0))).first()
    parents, tops = build(own, widest, total)
    subroots = stage(union([t.select(*few) for t in tops]), "merkle-subroots")
    above, _ = build(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("pos"),
                                     F.lit(count).cast("long").alias("width"), "below", "hash"), count, count)
    link = F.when(F.col("width") > 1, _name("tree", F.col("level") + 1, F.floor(F.col("pos") / FAN)))
    over = _name(F.lit(TOP), 1, F.floor(F.col("tree") / FAN)) if count > 1 else F.lit(None).cast("string")
    slot = (F.col("pos") % FAN).cast("int")
    common = [_name("tree", F.col("level"), F.col("pos")).alias("node"), "children", "below", "hash"]
    kinds = []
    if parents:
        turned = F.col("width") == 1  # a subroot goes on in the tree over the languages
        kinds.append(union(parents).select(*common, F.when(turned, over).otherwise(link).alias("up"), F.when(turned, F.col("tree") % FAN).otherwise(slot).cast("int").alias("slot")))
    if above:
        kinds.append(union(above).select(*common, link.alias("up"), slot.alias("slot")))
    if not kinds:
        empty = subroots.where("false").select(_name("tree", F.col("level"), F.col("pos")).alias("node"), F.array("hash").alias("children"), "below", "hash")
        kinds.append(empty.withColumn("up", F.lit(None).cast("string")).withColumn("slot", F.lit(0)))
    return stage(union(kinds), "merkle-nodes"), subroots.select("tree", F.col("hash").alias("subroot"), over.alias("over"))


CLIMB = """
WITH RECURSIVE climb(tree, pos, step, up, slot, folded, siblings, moved) AS (
  SELECT tree, pos, step, up, slot, folded, CAST('' AS BINARY), false FROM {start}
  UNION ALL
  SELECT %s c.tree, c.pos, c.step + 1, n.up, n.slot,
         sha2(concat_ws('', transform(n.children, (x, i) -> if(i = c.slot, c.folded, x))), 256), %s, true
  FROM climb c JOIN {nodes} n ON c.up = n.node
)
SELECT * FROM climb"""
APPEND = "unhex(concat_ws('', filter(n.children, (x, i) -> i <> c.slot)))"
NOTHING = "CAST('' AS BINARY)"


def climb(start: DataFrame, nodes: DataFrame, hint: str = "", siblings: str = APPEND) -> DataFrame:
    """Every step of every climbing row over ``nodes``; ``moved`` is false for the rows it starts from.

    Spark keeps each round in shuffle files and starts the next from them. Run it under ``unlimited_rows``.
    """
    return start.sparkSession.sql(CLIMB % (hint, siblings), start=start, nodes=nodes)


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in tasks of about ``TASK_ROWS`` rows, one a core at least: a climb repeats its tasks at every step."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS)))


@contextmanager
def unlimited_rows(spark: SparkSession) -> Iterator[None]:
    """Lifts Spark's limit on the rows of a recursive query."""
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(ROW_LIMIT, before)


def manifest(docs: DataFrame, crown: int = CROWN) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    placed = placed_leaves(docs)
    nodes, subroots = levels(placed)
    total = placed.count()
    shared = F.col("below") * crown >= total
    heights = small_side(stage(subroots.join(placed.groupBy("tree").agg(F.count("*").alias("width")), "tree"), "merkle-trees"))
    joined = placed.join(heights, "tree")
    start = joined.select(
        "tree", "pos", F.lit(0).alias("step"),
        F.when(F.col("width") > 1, _name("tree", 1, F.floor(F.col("pos") / FAN))).otherwise(F.col("over")).alias("up"),
        F.when(F.col("width") > 1, F.col("pos") % FAN).otherwise(F.col("tree") % FAN).cast("int").alias("slot"),
        F.coalesce("offered", "leaf").alias("folded"))
    # A few thousand rows, so one window over them is small.
    number = F.row_number().over(Window.orderBy("node")).cast("long")
    hot = stage(nodes.where(shared).select("node", "up", "slot", "children", number.alias("number")), "merkle-crown")
    cold = nodes.where(~shared).select("node", "up", "slot", "children")
    with unlimited_rows(docs.sparkSession):
        proofs = _proofs(start, cold, hot, total)
    top = nodes.where("up IS NULL").select("hash").first()
    root = F.lit(top[0]) if top else F.col("subroot")
    out = joined.join(proofs, ["tree", "pos"])
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def _joined(path: str) -> Column:
    """The siblings of a row's steps in order, as hex text."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", path))), lambda s: F.lower(F.hex(s[path]))), "")


def _crown_paths(hot: DataFrame) -> DataFrame:
    """up, slot, above: the siblings from each child of a crown node up to the root."""
    entries = hot.select(F.explode(F.sequence(F.lit(0), F.size("children") - 1)).alias("slot"), "number", F.col("node").alias("up"), "children")
    start = entries.select(F.lit(0).cast("long").alias("tree"), (F.col("number") * FAN + F.col("slot")).alias("pos"), F.lit(0).alias("step"), "up", "slot",
                           F.get("children", F.col("slot")).alias("folded"))
    steps = climb(start, hot, "/*+ BROADCAST(n) */").groupBy("pos").agg(_joined("siblings").alias("above"))
    keys = hot.select("number", F.col("node").alias("up"))
    return steps.join(keys, F.floor(F.col("pos") / FAN) == F.col("number")).select("up", (F.col("pos") % FAN).cast("int").alias("slot"), "above")


def _proofs(start: DataFrame, cold: DataFrame, hot: DataFrame, rows: int) -> DataFrame:
    """tree, pos, folded_root and proof_sha256, written."""
    above = small_side(stage(_crown_paths(hot), "merkle-crown-paths"))
    lower = stage(_few(climb(start, cold), rows), "merkle-climb")
    # A row goes on here where its next node is in the crown; one whose next node is not has gone on already.
    edge = lower.join(F.broadcast(hot.select(F.col("node").alias("up"))), "up", "left_semi").select("tree", "pos", "step", "up", "slot", "folded")
    upper = climb(_few(edge, rows), hot, "/*+ BROADCAST(n) */", NOTHING).where("moved AND up IS NULL")
    own = lower.unionByName(upper).groupBy("tree", "pos").agg(
        F.max(F.struct("step", "folded"))["folded"].alias("folded_root"), _joined("siblings").alias("below"),
        F.max(F.when(F.col("up").isNotNull(), F.struct("step", "up", "slot"))).alias("entry"))
    own = own.select("tree", "pos", "folded_root", "below", F.col("entry.up").alias("up"), F.col("entry.slot").alias("slot"))
    whole = own.join(above, ["up", "slot"], "left")
    return stage(whole.select("tree", "pos", "folded_root", F.sha2(F.concat("below", F.coalesce("above", F.lit(""))), 256).alias("proof_sha256")), "merkle-proofs")
