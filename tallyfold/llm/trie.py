"""Prefix tree of conversations: which beginnings are shared, by how many, and what sharing them saves.

A node is a distinct beginning of d turns, named by a 128-bit digest. Nodes are dealt into shards so that a shard holds
whole subtrees: a node is heavy if the conversations below it have more than LIGHT turns from it on, which only shrinks from parent to child;
the shallowest node of a path that isn't heavy takes all below it to one shard. In a shard, distinct digests get the slots of
a minimal perfect hash (a digest's slot is only believed if it holds that digest), counts are scattered into flat arrays by slot,
and sums run up the array of parents' slots in order of depth. The heavy nodes, few, make a tree of their own that starts
from what their light children brought up; it is summed in bands of depth, the deepest first.

Digests of a beginning are exclusive ors of hashes of (place, role and text), so a long conversation is cut into blocks whose
running values are joined by those of the blocks before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.session import shared_path, written

#: Turns below a node, itself included, from which it is heavy; and turns that a shard is meant to hold.
LIGHT, SHARD = 8_192, 32_768
#: Turn numbers that one block of a conversation spans.
BLOCK = 4_096
#: Heavy nodes that are summed at once.
BAND = 1_000_000


class SlotTable:
    """A minimal perfect hash of distinct 128-bit keys (n rows of two int64), built level by level: keys that meet no other
    key at their place stay there, the rest go on to the next level. Slots number the places in use."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []  # slot of each place, -1 if none
        self.keys = np.empty_like(keys)
        rest, used = np.arange(len(keys)), 0
        while len(rest):
            size = max(8, 2 * len(rest))
            place = self._places(keys[rest], len(self.levels), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            slots = np.full(size, -1, np.int64)
            slots[place[alone]] = used + np.arange(int(alone.sum()))
            self.levels.append(slots)
            self.keys[slots[place[alone]]] = keys[rest[alone]]
            used, rest = used + int(alone.sum()), rest[~alone]

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = keys[:, 0].astype(np.uint64) ^ (keys[:, 1].astype(np.uint64) * np.uint64(2 * level + 3))
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that the table doesn't hold."""
        found, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, slots in enumerate(self.levels):
            if not len(open_):
                break
            here = slots[self._places(keys[open_], level, len(slots))]
            right = here >= 0
            right[right] = (self.keys[here[right]] == keys[open_[right]]).all(1)
            found[open_[right]] = here[right]
            open_ = open_[~right]
        return found


def _distinct(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, axis=0) if len(keys) else keys


def climb(depth: np.ndarray, parent: np.ndarray, *sums: np.ndarray) -> None:
    """Add each slot's sums to its parent's (-1: none), the deepest first, in place."""
    order = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in reversed(np.split(order, cuts)):
        up = level[parent[level] >= 0]
        for s in sums:
            np.add.at(s, parent[up], s[up])


def _ends(slots: np.ndarray, ids: np.ndarray, n: int) -> list[str]:
    """For each slot the SHA-256 of its ids, ascending, joined by commas."""
    found = [hashlib.sha256(b"").hexdigest()] * n
    order = np.lexsort((ids, slots))
    slots, ids = slots[order], ids[order]
    for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(slots)) + 1):
        if len(part):
            found[slots[part[0]]] = hashlib.sha256(",".join(map(str, ids[part].tolist())).encode()).hexdigest()
    return found


_NODE = "d1 long, d2 long, p1 long, p2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]


def _keys(rows: pd.DataFrame, a: str, b: str) -> np.ndarray:
    return np.stack([rows[a].to_numpy(np.int64), rows[b].to_numpy(np.int64)], axis=1)


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of whole subtrees from their members' turns (conv_id, depth, d1, d2, p1, p2, chars, ends)."""
    own, up = _keys(rows, "d1", "d2"), _keys(rows, "p1", "p2")
    table = SlotTable(_distinct(own))
    n, slot = len(table.keys), table.slots(own)
    ids = rows["conv_id"].to_numpy(np.int64)
    count, first = np.bincount(slot, minlength=n), np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, slot, ids)
    depth, chars, above = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
    depth[slot], chars[slot], above[slot] = rows["depth"].to_numpy(np.int64), rows["chars"].to_numpy(np.int64), up
    parent = table.slots(above)
    children = np.zeros(n, np.int64)
    np.add.at(children, parent[parent >= 0], 1)
    leaves, saved = (children == 0).astype(np.int64), (count - 1) * chars
    climb(depth, parent, leaves, saved)
    ends = rows["ends"].to_numpy(bool)
    told = [first[p] if p >= 0 else None for p in parent.tolist()]
    return pd.DataFrame(
        {
            "d1": table.keys[:, 0], "d2": table.keys[:, 1], "p1": above[:, 0], "p2": above[:, 1], "depth": depth, "conv_id": first, "parent_conv_id": pd.array(told, "Int64"),
            "n_convs": count, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": _ends(slot[ends], ids[ends], n),
        }
    )[_COLUMNS]


def _band(rows: pd.DataFrame) -> pd.DataFrame:
    """The sums of heavy nodes of a band of depths from what their children outside it brought up."""
    own, up = _keys(rows, "d1", "d2"), _keys(rows, "p1", "p2")
    table = SlotTable(own)
    slot = table.slots(own)
    rows = rows.iloc[np.argsort(slot)]
    up = up[np.argsort(slot)]
    parent = table.slots(up)
    parent[rows["depth"].to_numpy() == 0] = -1
    children, leaves, saved = (rows[c].to_numpy(np.int64).copy() for c in ("n_children", "n_leaves", "saved_tokens"))
    np.add.at(children, parent[parent >= 0], 1)
    leaves[children == 0] = 1
    saved += (rows["n_convs"].to_numpy(np.int64) - 1) * rows["chars"].to_numpy(np.int64)
    climb(rows["depth"].to_numpy(np.int64), parent, leaves, saved)
    return rows.assign(n_children=children, n_leaves=leaves, saved_tokens=saved)


# turns to digests


def _hashes(place: Column) -> list[Column]:
    """Two 64-bit hashes of a turn at a place, from those of its role and text."""
    return [F.xxhash64(place, "e1", "e2").alias("x1"), F.xxhash64(F.lit("second"), place, "e2", "e1").alias("x2")]


def slim(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, block, e1, e2 (hashes of role and text), chars (code points) of rows with a conv_id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce(F.expr(f"turn div {BLOCK}L"), F.lit(-(2**62))).alias("block"),
        F.xxhash64(role, text).alias("e1"), F.xxhash64(F.lit("second"), role, text).alias("e2"), F.length(text).cast("long").alias("chars"),
    )


def numbered(turns: DataFrame) -> DataFrame:
    """turns with rank, from 1 in each conversation: by turn, null first, then by hash. Blocks are numbered apart, and the sizes of
    the blocks before are added: a row for each conversation, and for each further block of a long one."""
    sizes = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = sizes.select("conv_id", "block", F.sum("_n").over(before).alias("_before")).where("_before IS NOT NULL")
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "e1", "e2")
    local = turns.withColumn("_r", F.row_number().over(inside))
    return local.join(later, ["conv_id", "block"], "left").withColumn("rank", (F.col("_r") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_r", "_before")


def prefix_tree(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes (see _NODE, and chars) of conversations: turns (conv_id, rank from 1 without gaps, e1, e2, chars) and ids (each conv_id
    once, also of those without a turn). An empty table of ids has no nodes; otherwise the root is one of them."""
    block = F.expr(f"(rank - 1) div {BLOCK}L")
    placed = turns.select("conv_id", "rank", block.alias("block"), "chars", *_hashes(F.col("rank")))
    running = Window.partitionBy("conv_id", "block").orderBy("rank")
    own = placed.select("conv_id", "rank", "block", "chars", F.bit_xor("x1").over(running).alias("r1"), F.bit_xor("x2").over(running).alias("r2"), "x1", "x2")
    own = written(own, "turns")
    size = own.groupBy("conv_id").agg(F.max("rank").alias("size"))
    # what the blocks before a long conversation's later ones come to; sizes are joined by conversation
    blocks = own.join(size.where(F.col("size") > BLOCK).select("conv_id"), "conv_id", "left_semi").groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(blocks.select("conv_id", "block", F.bit_xor("x1").over(before).alias("s1"), F.bit_xor("x2").over(before).alias("s2")).where("s1 IS NOT NULL"), "starts")
    zero = F.lit(0).cast("long")
    digest = lambda k: F.col(f"r{k}").bitwiseXOR(F.coalesce(f"s{k}", zero))
    full = own.join(starts, ["conv_id", "block"], "left").join(size, "conv_id")
    members = full.select("conv_id", F.col("rank").alias("depth"), "block", digest(1).alias("d1"), digest(2).alias("d2"), digest(1).bitwiseXOR(F.col("x1")).alias("p1"), digest(2).bitwiseXOR(F.col("x2")).alias("p2"), "chars", (F.col("size") - F.col("rank") + 1).alias("left"))
    members = written(members, "members")
    # heavy nodes, and where each conversation leaves them
    heavy = written(members.groupBy("d1", "d2").agg(F.sum("left").alias("w")).where(F.col("w") > LIGHT).select("d1", "d2", F.lit(True).alias("heavy")), "heavy")
    marked = members.join(heavy, ["d1", "d2"], "left")
    inner = written(marked.where("heavy"), "inner")
    light = marked.where("heavy IS NULL").drop("heavy")
    inside = Window.partitionBy("conv_id", "block").orderBy("depth")
    tops = light.withColumns({"t1": F.first("d1").over(inside), "t2": F.first("d2").over(inside)})
    # a conversation of several blocks leaves the heavy nodes in one of them
    left = light.groupBy("conv_id").agg(F.min_by(F.struct("d1", "d2"), "depth").alias("_t"), F.count_distinct("block").alias("_n")).where("_n > 1").select("conv_id", "_t")
    tops = tops.join(left, "conv_id", "left").withColumn("top", F.when(F.col("_t").isNotNull(), F.xxhash64("_t.d1", "_t.d2")).otherwise(F.xxhash64("t1", "t2")))
    n = members.count()
    shards = max(1, -(-n // SHARD))
    dealt = tops.select("conv_id", "depth", "d1", "d2", "p1", "p2", "chars", (F.col("left") == 1).alias("ends"), F.pmod("top", F.lit(shards)).alias("shard"))
    nodes = written(dealt.groupBy("shard").applyInPandas(_shard, _NODE), "nodes")
    # the heavy nodes' tree
    low = nodes.where("parent_conv_id IS NULL").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = ids.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(zero.alias("d1"), zero.alias("d2"), zero.alias("p1"), zero.alias("p2"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("chars"))
    crown = inner.groupBy("d1", "d2").agg(*[F.min(c).alias(c) for c in ("p1", "p2", "depth", "conv_id")], F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars")).unionByName(root)
    crown = written(crown.join(low, ["d1", "d2"], "left").fillna(0, ["n_children", "n_leaves", "saved_tokens"]), "crown")
    summed = _summed(crown)
    # what is still to be told: the parents of heavy nodes and of their light children, and the ends of heavy nodes
    above = written(summed.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("_above")), "above")
    empty = ids.join(size, "conv_id", "left_anti").select("conv_id", zero.alias("d1"), zero.alias("d2"))
    ended = written(inner.where("left = 1").select("conv_id", "d1", "d2").unionByName(empty), "ended")
    hashed = _streamed_ends(ended)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    up = F.when(F.col("depth") > 0, F.col("_above"))
    top = summed.join(above, ["p1", "p2"], "left").join(hashed, ["d1", "d2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)).withColumn("parent_conv_id", up)
    rest = nodes.where("parent_conv_id IS NULL").join(above, ["p1", "p2"], "left").withColumn("parent_conv_id", up)
    return nodes.where("parent_conv_id IS NOT NULL").unionByName(rest.select(*_COLUMNS)).unionByName(top.select(*_COLUMNS))


def _summed(crown: DataFrame) -> DataFrame:
    """The heavy nodes with their sums, in bands of depth of at most BAND nodes (or one depth), the deepest first.

    Counts by bins of depth, at most 4,096, reach the driver. As a heavy node has more than LIGHT turns below it, one band
    holds the heavy nodes of many billions of conversations, unless conversations of millions of turns share them.
    """
    spark = crown.sparkSession
    n, deepest = crown.agg(F.count(F.lit(1)), F.coalesce(F.max("depth"), F.lit(0))).first()
    step = deepest // 4096 + 1
    bins = sorted(crown.groupBy(F.expr(f"depth div {step}L").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    bands, held = [], 0
    for b, k in bins:
        if bands and held + k <= BAND:
            bands[-1][0], held = b * step, held + k
        else:
            bands.append([b * step, (b + 1) * step - 1])
            held = k
    path = shared_path(spark, "crown-sums")
    schema = crown.schema
    for k, (lo, hi) in enumerate(bands):
        rows = crown.where(F.col("depth").between(lo, hi))
        if k:
            came = spark.read.schema(schema).parquet(path).where(F.col("depth") == hi + 1).groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count(F.lit(1)).alias("_c"), F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
            add = lambda c, a: (F.col(c) + F.coalesce(a, F.lit(0))).alias(c)
            own = [c for c in crown.columns if c not in ("n_children", "n_leaves", "saved_tokens")]
            rows = rows.join(came, ["d1", "d2"], "left").select(*own, add("n_children", "_c"), add("n_leaves", "_l"), add("saved_tokens", "_s")).select(*crown.columns)
        rows.groupBy(F.lit(0).alias("_")).applyInPandas(lambda rows: _band(rows.drop(columns="_", errors="ignore")), schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path) if bands else crown


def _streamed_ends(ended: DataFrame) -> DataFrame:
    """d1, d2, ends_sha256 of rows (d1, d2, conv_id), for nodes at which any number of conversations may end.

    Ranges of the ids are joined to text apart; then a node's few texts, in order, run through one digest, of which one text at a
    time is held. SHA-256 itself has to read them one after the other.
    """
    ranged = ended.repartitionByRange("d1", "d2", "conv_id").sortWithinPartitions("d1", "d2", "conv_id")
    texts = ranged.mapInPandas(_texts, "d1 long, d2 long, first long, ids string")
    return texts.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first").mapInPandas(_digests, "d1 long, d2 long, ends_sha256 string")


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for (a, b), part in batch.groupby(["d1", "d2"], sort=False):
            ids = part["conv_id"].tolist()
            yield pd.DataFrame([(a, b, ids[0], ",".join(map(str, ids)))], columns=["d1", "d2", "first", "ids"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, digest = None, None
    done = lambda: pd.DataFrame([(*now, digest.hexdigest())], columns=["d1", "d2", "ends_sha256"])
    for batch in batches:
        for a, b, ids in zip(batch["d1"], batch["d2"], batch["ids"], strict=True):
            if (a, b) != now:
                if now is not None:
                    yield done()
                now, digest = (a, b), hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
    if now is not None:
        yield done()


# the query's conversations


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, rank, e1, e2, chars) and ids of the rebuilt conversations: the first h turns of conversation c - c % 100, then
    c's own after its first h, h being crc32(c) % 6."""
    ranked = written(numbered(slim(conversations)), "ranked")
    ids = ranked.groupBy("conv_id").agg(F.lit(1).alias("_")).select("conv_id")
    shape = lambda df: df.withColumns({"h": (F.crc32(F.col("conv_id").cast("string")) % 6), "base": F.col("conv_id") - F.col("conv_id") % 100})
    heads = ranked.where((F.col("rank") <= 5) & (F.col("conv_id") % 100 == 0)).select(F.col("conv_id").alias("base"), "rank", "e1", "e2", "chars")
    begun = written(shape(ids).join(heads, "base").where(F.col("rank") <= F.col("h")).select("conv_id", "rank", "e1", "e2", "chars"), "begun")  # at most 199 ids meet a base
    taken = begun.groupBy("conv_id").agg(F.count(F.lit(1)).alias("taken"))
    own = shape(ranked).where(F.col("rank") > F.col("h")).join(taken, "conv_id", "left")
    own = own.select("conv_id", (F.col("rank") - F.col("h") + F.coalesce("taken", F.lit(0))).alias("rank"), "e1", "e2", "chars")
    return own.unionByName(begun), ids


def conversation_tree(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the rebuilt
    conversations. Rows without a conv_id belong to none; null roles and texts are empty; turns of equal number stand by
    a hash of role and text, and repeated rows are turns of their own; other columns are not looked at; an empty table has no node."""
    return prefix_tree(*rebuilt(conversations)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _oracle() -> str:
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    return f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT *, {crc} % 6 AS h, conv_id - conv_id % 100 AS base FROM (SELECT DISTINCT conv_id FROM t) x),
reb AS (SELECT i.conv_id, r, role, text FROM ids i JOIN t ON t.conv_id = i.base AND r <= h UNION ALL SELECT t.conv_id, r + 10, role, text FROM t JOIN ids i ON i.conv_id = t.conv_id AND r > h),
seq AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, string_agg(md5(role) || md5(text), '') OVER w AS k FROM reb WINDOW w AS (PARTITION BY conv_id ORDER BY r)),
mem AS MATERIALIZED (SELECT conv_id, depth, chars, md5(k) AS k, md5(left(k, length(k) - 64)) AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM seq
  UNION ALL SELECT conv_id, 0, 0, md5(''), NULL, conv_id NOT IN (SELECT conv_id FROM seq) FROM ids),
node AS (SELECT k, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM mem GROUP BY k, depth),
kids AS (SELECT up AS k, count(*) AS n FROM node GROUP BY up),
own AS (SELECT node.*, coalesce(n, 0) AS n_children, (n_convs - 1) * chars AS saved FROM node LEFT JOIN kids USING (k)),
sums AS (SELECT m.k, count_if(u.n_children = 0)::BIGINT AS n_leaves, sum(u.saved)::BIGINT AS saved_tokens FROM own u JOIN mem m ON m.conv_id = u.conv_id AND m.depth <= u.depth GROUP BY m.k)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens, o.ends_sha256 FROM own o JOIN sums USING (k) LEFT JOIN node p ON p.k = o.up
"""


ORACLE = _oracle()
