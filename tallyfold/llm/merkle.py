"""Merkle manifest of a dataset: digests of all rows in trees with eight children, stored in van Emde Boas layout.

The leaves of a language are cut into aligned subtrees of HEIGHT levels. A subtree is one row of a table: its digests lie in one
array, in the order of van Emde Boas: the upper half of its levels first, then each of the lower subtrees, all laid out the same
way. A digest's address follows by arithmetic from its level and place, so building and sibling retrieval need no pointers. The
roots of the subtrees are the leaves of the next table, until each language has one root; the languages' roots are
the leaves of the tree above them, built the same way. Proofs are read from the top down: each subtree gets the siblings of its
root's path from the table above and hands its own leaves' paths on.

No task holds more than one subtree's rows (8 ** HEIGHT of them) of a language at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.ranking import running
from tallyfold.session import written

FANOUT = 8
#: Levels above the leaves of a subtree.
HEIGHT = 4
SIZE = FANOUT**HEIGHT


def tree_size(levels: int) -> int:
    """Digests of a whole tree of so many levels."""
    return (FANOUT**levels - 1) // (FANOUT - 1)


def address(levels: int, depth: int, place: np.ndarray) -> np.ndarray:
    """Where the digests of a depth (0: the root) lie in the layout of a whole tree of `levels` levels."""
    if levels == 1:
        return np.zeros_like(place)
    top = levels // 2
    if depth < top:
        return address(top, depth, place)
    below = FANOUT ** (depth - top)
    tree, inside = place // below, place % below
    return tree_size(top) + tree * tree_size(levels - top) + address(levels - top, depth - top, inside)


@cache
def _addresses(levels: int) -> list[np.ndarray]:
    return [address(levels, depth, np.arange(FANOUT**depth)) for depth in range(levels)]


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Subtree:
    """The digests over up to 8 ** height leaves in van Emde Boas layout."""

    def __init__(self, height: int, count: int, nodes: bytes | None = None):
        self.height, self.counts = height, [count]
        for _ in range(height):
            self.counts.append(-(-self.counts[-1] // FANOUT))
        size = tree_size(height + 1)
        self.nodes = np.zeros((size, 32), np.uint8) if nodes is None else np.frombuffer(nodes, np.uint8).reshape(size, 32)

    def at(self, up: int, start: int, end: int) -> list[str]:
        """Digests start to end (or the level's last) of the level `up` steps above the leaves."""
        where = _addresses(self.height + 1)[self.height - up][start : min(end, self.counts[up])]
        text = self.nodes[where].tobytes().hex()
        return [text[k : k + 64] for k in range(0, len(text), 64)]

    def build(self, leaves: list[str]) -> Subtree:
        level = leaves
        for up in range(self.height + 1):
            if up:
                level = [_hash("".join(level[k : k + FANOUT])) for k in range(0, len(level), FANOUT)]
            where = _addresses(self.height + 1)[self.height - up][: len(level)]
            self.nodes[where] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, 32)
        return self

    def path(self, leaf: int) -> list[tuple[str, str]]:
        """For each level from the leaf's up: the digests of its run before and after it, joined."""
        found, place = [], leaf
        for up in range(self.height):
            start = place - place % FANOUT
            run = self.at(up, start, start + FANOUT)
            found.append(("".join(run[: place - start]), "".join(run[place - start + 1 :])))
            place //= FANOUT
        return found

    def paths(self) -> list[list[tuple[str, str]]]:
        return [self.path(leaf) for leaf in range(self.counts[0])]


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and the siblings of its path make."""
    for before, after in path:
        leaf = _hash(before + leaf + after)
    return leaf


def proof(path: list[tuple[str, str]]) -> str:
    return _hash("".join(before + after for before, after in path))


def _levels(count: int) -> int:
    """Steps until one digest is left."""
    steps = 0
    while count > 1:
        count, steps = -(-count // FANOUT), steps + 1
    return steps


# Paths travel between tables as text: levels parted by "|", a level's two halves by ",".


def _as_text(path: list[tuple[str, str]]) -> str:
    return "|".join(f"{before},{after}" for before, after in path)


def _as_path(text: str) -> list[tuple[str, str]]:
    return [tuple(level.split(",")) for level in text.split("|")] if text else []


_BLOCK = "grp string, block long, height int, count int, nodes binary, root string, ids array<string>, changed array<string>, last boolean"


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    """One subtree of rows (grp, block, total, i, id, leaf, changed) as a row."""
    rows = rows.sort_values("i")
    total = int(rows["total"].iat[0])
    last = total <= SIZE
    tree = Subtree(_levels(total) if last else HEIGHT, len(rows)).build(rows["leaf"].tolist())
    lists = [[x if isinstance(x, str) else None for x in rows[c]] for c in ("id", "changed")]
    return pd.DataFrame([(rows["grp"].iat[0], int(rows["block"].iat[0]), tree.height, len(rows), tree.nodes.tobytes(), tree.at(tree.height, 0, 1)[0], *lists, last)], columns=["grp", "block", "height", "count", "nodes", "root", "ids", "changed", "last"])


def _subtrees(leaves: DataFrame, totals: DataFrame) -> DataFrame:
    """A table of subtrees over leaves (grp, i, id, leaf, changed), i counting from 0 in each group; totals: grp, total."""
    cut = leaves.join(totals, F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp").withColumn("block", F.expr(f"i div {SIZE}L"))
    return written(cut.groupBy("grp", "block").applyInPandas(_built, _BLOCK), "subtrees")


def _towers(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tables of subtrees from the leaves up, and each group's root (grp, subroot). A table has 1 / 4096 of the rows below it."""
    tables, roots = [], None
    while True:
        totals = leaves.groupBy(F.col("grp").alias("_grp")).agg(F.count(F.lit(1)).alias("total"))
        made = _subtrees(leaves, totals)
        tables.append(made)
        done = made.where("last").select("grp", F.col("root").alias("subroot"))
        roots = done if roots is None else roots.unionByName(done)
        rest = made.where("NOT last")
        if rest.isEmpty():
            return tables, roots
        none = F.lit(None).cast("string")
        leaves = rest.select("grp", F.col("block").alias("i"), none.alias("id"), F.col("root").alias("leaf"), none.alias("changed"))


def _handed_down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Subtrees with their root's path: their leaves' paths, to be joined to the table below."""
    for batch in batches:
        for grp, block, height, count, nodes, above in zip(*[batch[c] for c in ("grp", "block", "height", "count", "nodes", "path")], strict=True):
            tree = Subtree(height, count, nodes)
            paths = [_as_text(p + _as_path(above)) for p in tree.paths()]
            yield pd.DataFrame({"grp": [grp] * count, "block": block * SIZE + np.arange(count, dtype=np.int64), "path": paths})


_PROVED = "id string, leaf string, proof_sha256 string, folded string, grp string"


def _proved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for grp, block, height, count, nodes, ids, changed, above in zip(*[batch[c] for c in ("grp", "block", "height", "count", "nodes", "ids", "changed", "path")], strict=True):
            tree = Subtree(height, count, nodes)
            upper, leaves, out = _as_path(above), tree.at(0, 0, count), []
            for leaf, id_, other, own in zip(leaves, ids, changed, tree.paths(), strict=True):
                path = own + upper
                out.append((id_, leaf, proof(path), folded(leaf if other is None else other, path), grp))
            yield pd.DataFrame(out, columns=["id", "leaf", "proof_sha256", "folded", "grp"])


def _paths_of(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest table with a column path, handed down from above: grp and the path of the group's root."""
    path = None
    for k in reversed(range(len(tables))):
        tops = tables[k].where("last").join(above.select(F.col("grp").alias("_g"), "path"), F.col("grp").eqNullSafe(F.col("_g"))).drop("_g")
        now = tops
        if path is not None:
            inner = tables[k].where("NOT last").join(path.select(F.col("grp").alias("_g"), F.col("block").alias("_b"), "path"), F.col("grp").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))).drop("_g", "_b")
            now = tops.unionByName(inner)
        if not k:
            return now
        path = written(now.mapInPandas(_handed_down, "grp string, block long, path string"), "paths")
    raise ValueError("no table")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Hex SHA-256 of the values: each `-` if null, else its UTF-8 byte count, `:` and itself."""
    return F.sha2(F.concat(*map(_field, values)), 256)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prove(leaves: DataFrame) -> DataFrame:
    """Rows (grp, id, leaf, proof_sha256, folded, subroot, root) of leaves (grp string, id string, leaf, changed).

    grp groups leaves into trees, i numbers them from 0; the groups' roots, null first and then by bytes, are the leaves of the
    tree above. changed: the digest to fold with a leaf's siblings in place of its own, or null. Ties and repeated rows
    are leaves of their own; an empty table has no rows.
    """
    tables, roots = _towers(leaves)
    roots = written(roots, "subroots")
    ranked = running(roots.withColumn("_has", F.col("grp").isNotNull()), [F.col("_has"), F.col("grp")], {"_i": F.lit(1)})
    none = F.lit(None).cast("string")
    langs, whole = _towers(ranked.select(F.lit("").alias("grp"), (F.col("_i") - 1).alias("i"), F.concat(F.when(F.col("_has"), F.lit("=")).otherwise(F.lit("-")), F.coalesce("grp", F.lit(""))).alias("id"), F.col("subroot").alias("leaf"), none.alias("changed")))
    above = _paths_of(langs, whole.select("grp", F.lit("").alias("path")))
    named = above.mapInPandas(_named_paths, "id string, path string").select(F.when(F.col("id") != "-", F.substring("id", 2, 2**31 - 1)).alias("grp"), "path")
    done = _paths_of(tables, written(named, "group-paths")).mapInPandas(_proved, _PROVED)
    subroots = roots.select(F.col("grp").alias("_g"), "subroot").crossJoin(F.broadcast(whole.select(F.col("subroot").alias("root"))))  # one row
    return done.join(subroots, F.col("grp").eqNullSafe(F.col("_g"))).drop("_g")


def _named_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The paths of a table's leaves by their ids."""
    for batch in batches:
        for height, count, nodes, ids, above in zip(*[batch[c] for c in ("height", "count", "nodes", "ids", "path")], strict=True):
            tree, upper = Subtree(height, count, nodes), _as_path(above)
            yield pd.DataFrame({"id": list(ids), "path": [_as_text(p + upper) for p in tree.paths()]})


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs.

    Leaves of a language ascend by doc_id, null first, equal ones by digest. Rows whose doc_id's CRC-32 is divisible by 3 are
    folded with their text's A-Z lower-cased. A null language is a group of its own; other columns are not looked at.
    """
    text = F.col("text")
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    slim = docs.select("doc_id", "lang", leaf_digest(*own, text).alias("leaf"), F.when(tampered, leaf_digest(*own, F.translate(text, UPPER, LOWER))).alias("changed"))
    ordered = running(slim.withColumn("_has", F.col("doc_id").isNotNull()), [F.col("_has"), F.col("doc_id"), F.col("leaf")], {"_i": F.lit(1)}, ("lang",))
    leaves = ordered.select(F.col("lang").alias("grp"), (F.col("_i") - 1).alias("i"), F.col("doc_id").cast("string").alias("id"), "leaf", "changed")
    done = prove(leaves)
    return done.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _oracle(levels: int = 8) -> str:
    """The same by whole levels: each one's runs of eight, the siblings and the folded digests of every row."""

    def tower(k: str, source: str) -> str:
        # grp, i, h: a level's digests; own: each row's place and folded digest, with what its proof has so far
        parts = [f"{k}0 AS (SELECT * FROM {source})"]
        for n in range(levels):
            parts.append(
                f"{k}{n + 1} AS (SELECT grp, i // 8 AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {k}{n}) x GROUP BY grp, i // 8)"
            )
        return ",\n".join(parts)

    def climbed(k: str, first: str) -> str:
        parts, last = [], first
        for n in range(levels):
            parts.append(
                f"{k}s{n} AS (SELECT r.row, r.grp, r.p // 8 AS p, r.proof || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i <> r.p), '') AS proof, CASE WHEN any_value(t.n) > 1 THEN sha256(string_agg(CASE WHEN t.i = r.p THEN r.f ELSE t.h END, '' ORDER BY t.i)) ELSE r.f END AS f "
                f"FROM {last} r JOIN (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {k}{n}) t ON t.grp IS NOT DISTINCT FROM r.grp AND t.i // 8 = r.p // 8 GROUP BY r.row, r.grp, r.p, r.proof, r.f)"
            )
            last = f"{k}s{n}"
        return ",\n".join(parts)

    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, *, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
{tower("a", "(SELECT lang AS grp, i, leaf AS h FROM r) x")},
g AS MATERIALIZED (SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS i FROM a{levels}),
{tower("b", "(SELECT 0 AS grp, i, subroot AS h FROM g) x")},
own AS (SELECT row, lang AS grp, i AS p, '' AS proof, coalesce(changed, leaf) AS f FROM r),
{climbed("a", "own")},
up AS (SELECT s.row, 0 AS grp, g.i AS p, s.proof, s.f FROM as{levels - 1} s JOIN g ON g.grp IS NOT DISTINCT FROM s.grp),
{climbed("b", "up")}
SELECT r.doc_id, r.leaf, g.subroot, b{levels}.h AS root, sha256(s.proof) AS proof_sha256, s.f AS folded_root, s.f = b{levels}.h AS verified
FROM bs{levels - 1} s JOIN r USING (row) JOIN g ON g.grp IS NOT DISTINCT FROM r.lang, b{levels}
"""


ORACLE = _oracle()
