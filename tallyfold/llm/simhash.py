"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are majority votes over the bits of hashed word shingles. Linking never compares all pairs:
fingerprints meet in blocks only, and a block is compared vertically: bit planes are stored one after the
other, many distances are counted at once with carry-save bitwise counters, and a block is abandoned as soon
as every distance in it exceeds the radius.

Two block rules are built on that:

* ``link_within_radius``: exact for a radius r on 64-bit fingerprints. The bits are cut into r + k pieces; two
  fingerprints within r differ in at most r pieces, so they agree on some k pieces. Every k pieces are a block key.
  The more fingerprints, the larger the k that costs least: more and longer keys, so that few strangers share a block.
* ``near_duplicates``: five-word shingles and a similarity of 0.8. There the distance is far beyond what pieces
  can catch, so blocks come from banded minima of shingle hashes. The planes of 512-bit fingerprints, compared as above
  in a few bands, propose links that the exact Jaccard similarity confirms; then every pair of every block that is
  not joined yet is decided by its exact similarity.

Edge cases: null and empty texts and texts without a word have fingerprint zero and are linked like any other;
a text shorter than a shingle is one shingle; equal texts share a fingerprint, so copies collapse before any
comparison; repeated rows and null doc_ids stay rows of their own (a component's id ignores null ids);
an empty table gives an empty table; other columns of the input are not used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm.cells import CELL, KEYS, by_cell, by_cell_of_words, dealt_cells, filled_cells, met_cells
from tallyfold.llm.common import WORDS, components, removed, subfolder, written

SEED = 42
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    w = WORDS.findall((text or "").translate(LOWER) if (text or "").isascii() else _lower(text or ""))
    if not w:
        return np.empty(0, np.uint64)
    joined = [" ".join(w)] if len(w) < words else map(" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s.encode("utf-8", "surrogatepass"), SEED) for s in joined], dtype=np.uint64)


def _lower(text: str) -> str:
    return text.translate(LOWER)


def majority(rows: np.ndarray) -> np.ndarray:
    """Bits set in over half the rows of an (n, w) array of 64-bit words, counted with carry-save adders."""
    n = len(rows)
    planes, level = [], rows
    while len(level):
        carries = []
        while len(level) > 1:
            third = len(level) // 3
            if third:
                a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
                odd = a ^ b
                carries.append((a & b) | (odd & c))
                level = np.concatenate([odd ^ c, level[3 * third :]])
            else:
                carries.append((level[0] & level[1])[None])
                level = (level[0] ^ level[1])[None]
        planes.append(level[0])
        level = np.concatenate(carries) if carries else level[:0]
    # count > n // 2, compared bit by bit from the highest plane
    half, above, equal = n // 2, np.zeros_like(rows[0]), ~np.zeros_like(rows[0])
    for k in range(max(len(planes), half.bit_length()) - 1, -1, -1):
        plane = planes[k] if k < len(planes) else np.zeros_like(rows[0])
        if half >> k & 1:
            equal = equal & plane
        else:
            above = above | (equal & plane)
            equal = equal & ~plane
    return above


def simhash64(text: str | None, words: int = 4) -> int:
    h = shingle_hashes(text, words)
    return int(majority(h[:, None])[0]) if len(h) else 0


@F.pandas_udf(T.LongType())
def _fingerprint4(text: pd.Series) -> pd.Series:
    return pd.Series([simhash64(t, 4) for t in text], dtype=np.uint64).astype(np.int64)


def within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Bit-sliced distances: a (q, w) against b (n, w) words; a boolean (q, n) matrix of distance <= radius.

    Lane j of plane k holds bit k of fingerprint j. Each step adds one plane's differences to binary
    counters with carries; a final comparison with the radius is made on the planes. A block is given up
    when every lane has passed the next power of two above the radius.
    """
    q, n = len(a), len(b)
    lanes = -(-n // 64)
    vertical = _planes(b, lanes)
    mine = np.unpackbits(np.ascontiguousarray(a).view(np.uint8), axis=1, bitorder="little").astype(bool)
    size = radius.bit_length()
    counters = [np.zeros((q, lanes), np.uint64) for _ in range(size)]
    over = np.zeros((q, lanes), np.uint64)
    spare = np.zeros(lanes, np.uint64)
    if n % 64:
        spare[-1] = ~np.uint64(0) << np.uint64(n % 64)
    for k in range(len(vertical)):
        carry = np.where(mine[:, k, None], ~vertical[k], vertical[k])
        for c in range(size):
            counters[c], carry = counters[c] ^ carry, counters[c] & carry
        over |= carry
        if k % 16 == 15 and k >= 2 * radius and ((over | spare) == ~np.uint64(0)).all():
            return np.zeros((q, n), bool)
    above, equal = over, ~over
    for c in range(size - 1, -1, -1):
        if radius >> c & 1:
            equal = equal & counters[c]
        else:
            above = above | (equal & counters[c])
            equal = equal & ~counters[c]
    near = np.unpackbits(np.ascontiguousarray(~above).view(np.uint8).reshape(q, -1), axis=1, bitorder="little")
    return near[:, :n].astype(bool)


def _planes(b: np.ndarray, lanes: int) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(b).view(np.uint8), axis=1, bitorder="little")
    padded = np.zeros((bits.shape[1], lanes * 64), np.uint8)
    padded[:, : len(b)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise Hamming distances of (n, w) words."""
    return np.bitwise_count(a ^ b).sum(axis=1)


def _links(node: np.ndarray, prints: np.ndarray, left: int, radius: int) -> Iterator[tuple[int, int]]:
    """Links of one block, as a forest that joins the closest first. left: how many of the rows are the first chunk,
    to be compared with the others; 0: all rows are compared with each other."""
    n = len(node)
    if n < 2:
        return
    first, second = (np.arange(left), np.arange(left, n)) if left else (np.arange(n), np.arange(n))
    found = []
    for at in range(0, len(first), 256):
        rows = first[at : at + 256]
        x, y = np.nonzero(within(prints[rows], prints[second], radius))
        x, y = rows[x], second[y]
        keep = x < y if not left else node[x] != node[y]
        x, y = x[keep], y[keep]
        found.append((distances(prints[x], prints[y]), x, y))
        if sum(len(f[0]) for f in found) > 4_000_000:  # a dense block: keep the forest so far, not the pairs
            found = [_forest(*map(np.concatenate, zip(*found, strict=True)), n)]
    d, x, y = _forest(*map(np.concatenate, zip(*found, strict=True)), n)
    yield from zip(node[x].tolist(), node[y].tolist(), strict=True)


def _forest(d: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    root, kept = list(range(n)), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k in np.argsort(d, kind="stable").tolist():
        a, b = top(int(x[k])), top(int(y[k]))
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(k)
            if len(kept) == n - 1:
                break
    return d[kept], x[kept], y[kept]


def _linked(radius: int):
    def handle(rows: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        node, side = rows["node"].to_numpy(), rows["side"].to_numpy()
        i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
        prints = np.frombuffer(b"".join(rows["print"]), np.uint64).reshape(len(rows), -1)
        a = starts[ends - starts == 2]  # most cells hold one pair: those are compared together
        apart = (i[a] != j[a]) & (side[a] == side[a + 1])
        a = a[(distances(prints[a], prints[a + 1]) <= radius) & ~apart]
        out = list(zip(node[a].tolist(), node[a + 1].tolist(), strict=True))
        large = ends - starts > 2
        for s, e in zip(starts[large].tolist(), ends[large].tolist(), strict=True):
            left = int((side[s:e] == 0).sum()) if i[s] != j[s] else 0
            if i[s] == j[s] or 0 < left < e - s:
                out.extend(_links(node[s:e], prints[s:e], left, radius))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return handle


def link_blocks(blocks: DataFrame, prints: DataFrame, radius: int, cell: int = CELL, folder: str | None = None) -> DataFrame:
    """Links (u, v) between the nodes that meet in a block and whose prints (node long, print binary) lie within the
    radius; each cell gives a forest, not all its pairs."""
    return met_cells(blocks, prints, cell, folder).mapInPandas(by_cell(_linked(radius)), "u long, v long").distinct()


def shared_pieces(n: int, radius: int) -> int:
    """How many pieces a block key of n fingerprints has: the number with the fewest rows and pairs of strangers to handle.
    Each choice gives the same links."""

    def work(k: int) -> float:
        return comb(radius + k, k) * (n + n * n / 2 ** (64 * k / (radius + k) + 1))

    return min(range(1, 8), key=work)


def link_within_radius(prints: DataFrame, radius: int = 4, cell: int = CELL, shared: int | None = None, folder: str | None = None) -> DataFrame:
    """Links (u, v) between 64-bit fingerprints (column fp long, distinct) at most `radius` bits apart; exact."""
    shared = shared or shared_pieces(prints.count(), radius)
    pieces = radius + shared
    cut = [(round(64 * k / pieces), round(64 * (k + 1) / pieces)) for k in range(pieces)]

    def joined(chosen: tuple[int, ...]) -> Column:
        key = F.lit(0).cast("long")
        for lo, hi in (cut[c] for c in chosen):
            piece = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
            key = F.shiftleft(key, hi - lo).bitwiseOR(piece)
        return key

    keys = [F.struct(F.lit(n).alias("block"), joined(chosen).alias("key")) for n, chosen in enumerate(combinations(range(pieces), shared))]
    blocks = prints.select(F.col("fp").alias("node"), F.explode(F.array(*keys)).alias("k")).select("k.block", "k.key", "node")
    words = prints.select(F.col("fp").alias("node"), F.to_binary(F.lpad(F.hex("fp"), 16, "0"), F.lit("hex")).alias("print"))
    return link_blocks(blocks, words, radius, cell, folder)


def simhash_components(docs: DataFrame, radius: int = 4) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id."""
    own = written(docs.select("doc_id", _fingerprint4("text").alias("fp")), "fingerprints")
    folder = subfolder(docs.sparkSession, "simhash")
    nodes = written(own.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes", folder)
    links = written(link_within_radius(nodes.select("fp"), radius, folder=folder), "links", folder)
    roots = components(links, inside=folder)
    groups = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = groups.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = written(groups.join(ids, "root").select("fp", "component_id"), "named")
    removed(docs.sparkSession, folder)  # the result reads `own` and `named` only
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# near-duplicates of five-word shingles and a similarity of 0.8

WIDE = 8
BANDS, ROWS = 25, 5
#: Bands whose closest pairs are tried first; what they link is not compared again.
FIRST_BANDS = 5
#: Shingles of one chunk: two chunks of 64-bit hashes take 16 MB.
HEAVY = 1_000_000
#: Full cells' pairs of different roots from which a block is parted by prefixes.
OPEN_CELLS = 4
#: 512-bit distance that a pair of similarity 0.8 (78 on average, deviation 8) exceeds once in a thousand cases.
WIDE_RADIUS = 103
_rng = np.random.default_rng(20240)
_MULTIPLY = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_WIDEN = _rng.integers(1, 2**63, WIDE, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray, factors: np.ndarray) -> np.ndarray:
    x = h[:, None] * factors
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def distinct_shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The hashes of the text's distinct shingles in order; a single zero without a word."""
    h = np.unique(shingle_hashes(text, words))
    return h if len(h) else np.zeros(1, np.uint64)


def wide_print(text: str | None, words: int = 5) -> tuple[bytes, list[int], int]:
    """The 512-bit fingerprint of the text's distinct shingles, a key for each band of minima, and their number."""
    h = distinct_shingles(text, words)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(h), 4096):
        least = np.minimum(least, _mixed(h[at : at + 4096], _MULTIPLY).min(axis=0))
    keys = [xxhash.xxh64_intdigest(band.tobytes(), SEED) for band in least.reshape(BANDS, ROWS)]
    return majority(_mixed(h, _WIDEN)).tobytes(), np.array(keys, np.uint64).view(np.int64).tolist(), len(h)


@F.pandas_udf(T.StructType().add("print", T.BinaryType()).add("keys", T.ArrayType(T.LongType())).add("size", T.LongType()))
def _wide5(text: pd.Series) -> pd.DataFrame:
    of = {t: wide_print(t) for t in text.unique()}  # a batch's copies are read once
    return pd.DataFrame([of[t] for t in text], columns=["print", "keys", "size"])


@F.pandas_udf(T.BinaryType())
def _shingles5(text: pd.Series) -> pd.Series:
    return pd.Series([distinct_shingles(t).tobytes() for t in text], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _shingle_list5(text: pd.Series) -> pd.Series:
    return pd.Series([distinct_shingles(t).view(np.int64) for t in text], dtype=object)


@F.pandas_udf(T.DoubleType())
def _jaccard5(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        s, t = (np.unique(shingle_hashes(z, 5)) for z in (x, y))
        both = len(np.intersect1d(s, t, assume_unique=True))
        out.append(both / (len(s) + len(t) - both) if len(s) + len(t) else 1.0)
    return pd.Series(out, dtype=float)


def near_duplicates(docs: DataFrame, similarity: float = 0.8, cell: int = CELL) -> DataFrame:
    """Groups of near-duplicate texts: one row (node long, root long) per distinct text linked to another one.

    node is xxhash64 of the text (null as empty). Words are as for fingerprints, shingles of five. Pairs that share a band
    are decided exactly; a pair of similarity 0.8 shares none of the bands in one of 20,000 cases.
    """
    folder = subfolder(docs.sparkSession, "near-duplicates")
    groups = written(_groups(docs, _firsts(docs, folder), similarity, cell, folder), "groups")
    removed(docs.sparkSession, folder)
    return groups


def _node() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _firsts(docs: DataFrame, folder: str) -> DataFrame:
    """(node, id): for each distinct text the smallest doc_id, null if none of its rows has one."""
    return written(docs.select(_node().alias("node"), "doc_id").groupBy("node").agg(F.min("doc_id").alias("id")), "first", folder)


def _rows_of(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row (node, doc_id, ...) for each of the chosen (node, id). They are joined by text and doc_id, not by text
    alone, so that the copies of a text are spread over all tasks and only one of them passes."""
    key = lambda c: (F.coalesce(c, F.lit(0)).alias("_id"), F.col(c).isNull().alias("_none"))
    by = chosen.select("node", *key("id")).hint("merge")  # texts meet it by the same plan at every size
    keys = ["node", "_id", "_none"]
    return rows.select("*", *key("doc_id")).join(by, keys, "left_semi").dropDuplicates(keys).drop("_id", "_none")


def _groups(docs: DataFrame, firsts: DataFrame, similarity: float, cell: int, folder: str) -> DataFrame:
    """See near_duplicates. What is written on the way lies in the folder; the first bands' tables, texts among them, go when
    their links are known."""
    spark = docs.sparkSession
    early = subfolder(spark, "first-bands", folder)
    one = docs.select(_node().alias("node"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = one.select("node", _wide5("text").alias("w")).select("node", "w.print", "w.keys", "w.size").dropDuplicates(["node"])
    own = written(own, "wide", folder)

    def texts(nodes: DataFrame) -> DataFrame:
        return _rows_of(one, written(firsts.join(nodes, "node", "left_semi"), "chosen", folder))

    bands = own.select("node", F.posexplode("keys").alias("block", "key")).where(F.col("block") < FIRST_BANDS)
    first = written(_verified(texts, own, bands, similarity, early), "links", folder)
    roots = written(components(first, inside=early), "roots", folder)
    removed(spark, early)
    # a block whose members are all linked already has nothing to add; in the others every pair of two roots is decided
    every = own.select("node", F.col("size").alias("weight"), F.posexplode("keys").alias("block", "key"))
    every = every.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    blocks = _parted(texts, written(_undecided(every, folder, "block", "key"), "open", folder), similarity, cell, folder)
    more = _decided(texts, blocks, similarity, cell, folder)
    return components(first.union(more), inside=folder)


def _parted(texts: Callable[[DataFrame], DataFrame], blocks: DataFrame, similarity: float, cell: int, folder: str) -> DataFrame:
    """The blocks (block, key, node, weight, root) with the widest open ones replaced by blocks of shared prefixes: those that have more
    pairs of different roots than OPEN_CELLS full cells.

    In such a block, as that of a page template, most pairs are far apart; in a large group of copies, which are joined already, few pairs
    are open. Two sets of n shingles or more reach the
    similarity only if they share one of the first n - ceil(similarity n) + 1 of each in any one order, so a member enters a block for each of
    these; the order begins with the rarest among the members of all large blocks, which templates are not. Blocks of the same
    members are compared once.
    """
    keys = ["block", "key"]
    counts = blocks.groupBy(*keys, "root").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy(*keys)
    wide = (F.pow(F.sum("n"), F.lit(2)) - F.sum(F.col("n") * F.col("n"))) / 2 > OPEN_CELLS * cell * cell / 2
    large = written(counts.agg(wide.alias("wide")).where("wide").select(*keys), "large", folder)
    members = written(blocks.join(large, keys, "left_semi").select("node", "weight", "root").distinct(), "members", folder)
    sets = texts(members.select("node")).select("node", _shingle_list5("text").alias("s"))
    tokens = written(sets.select("node", F.size("s").alias("n"), F.explode("s").alias("key")), "tokens", folder)
    common = written(tokens.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "common", folder)
    ranked = tokens.join(common, "key", "left").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(1)).alias("held"), "key"))).alias("t"))
    first = ranked.select("node", F.explode(F.slice("t", F.lit(1), F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - 1e-9).cast("int") + 1)).alias("t")).where("t.held > 1")
    made = first.select("node", F.lit(BANDS).alias("block"), F.col("t.key").alias("key")).join(members, "node")
    made = written(_undecided(made, folder, *keys), "prefixes", folder)
    alike = made.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("b"))
    one = alike.groupBy("n", "a", "b").agg(F.min(F.struct(*keys)).alias("k")).select("k.block", "k.key")
    return blocks.join(large, keys, "left_anti").unionByName(made.join(one, keys, "left_semi").select(*blocks.columns))


def _undecided(rows: DataFrame, folder: str, *keys: str) -> DataFrame:
    """The rows of those groups by the keys that have more than one root."""
    open_ = rows.groupBy(*keys).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(*keys)
    return rows.join(written(open_, "undecided", folder), list(keys))


def _decided(texts: Callable[[DataFrame], DataFrame], blocks: DataFrame, similarity: float, cell: int, folder: str) -> DataFrame:
    """Links (u, v) that join all nodes of a block (block, key, node, weight, root) whose texts have at least the similarity:
    no pair of different roots is left untested."""
    spark, late = blocks.sparkSession, subfolder(blocks.sparkSession, "all-bands", folder)
    dealt = written(_undecided(dealt_cells(blocks, cell, HEAVY, late), late, *KEYS), "dealt", late)
    sets = written(texts(dealt.select("node").distinct()).select("node", _shingles5("text").alias("shingles")), "shingles", late)
    links = filled_cells(dealt, sets).mapInArrow(by_cell_of_words(_similar(similarity), "shingles"), "u long, v long").distinct()
    links = written(links, "links", folder)
    removed(spark, late)
    return links


def _similar(similarity: float):
    def handle(rows: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        node, side, root = (rows[c].to_numpy() for c in ("node", "side", "root"))
        cross = rows["i"].to_numpy() != rows["j"].to_numpy()
        sets = rows["shingles"].tolist()
        out = []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            left = int((side[s:e] == 0).sum()) if cross[s] else 0
            if not cross[s] or 0 < left < e - s:
                out.extend(_joins(node[s:e], root[s:e], sets[s:e], left, similarity))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return handle


def _joins(node: np.ndarray, root: np.ndarray, sets: list[np.ndarray], left: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Links of one cell by exact Jaccard similarity of sorted sets, none of them empty. Every pair is tested unless its
    ends are joined already, by their roots or by links found before. left: as for _links."""
    n = len(node)
    group = np.unique(root, return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    fits = lambda k, js: js[np.minimum(size[js], size[k]) / np.maximum(size[js], size[k]) >= similarity]
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True)) if group[0] != group[1] and len(fits(0, np.array([1]))) else 0
        if both / (size.sum() - both) >= similarity:
            yield int(node[0]), int(node[1])
        return
    shingle, at = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(shingle), np.int32)
    for k in range(left or n):
        first = left or k + 1
        js = fits(k, first + np.flatnonzero(group[first:] != group[k]))
        if not len(js):
            continue
        mine = at[start[k] : start[k + 1]]
        mark[mine] = 1
        if 4 * len(js) < n - first:
            both = np.array([mark[at[start[j] : start[j + 1]]].sum() for j in js.tolist()])
        else:
            both = np.add.reduceat(mark[at[start[first] :]], start[first:-1] - start[first])[js - first]
        mark[mine] = 0
        for j in js[both / (size[js] + size[k] - both) >= similarity].tolist():
            if group[j] != group[k]:
                group[group == group[j]] = group[k]
                yield int(node[k]), int(node[j])


def _verified(texts: Callable[[DataFrame], DataFrame], own: DataFrame, blocks: DataFrame, similarity: float, folder: str) -> DataFrame:
    """Links (u, v) found in the blocks whose texts (node, text) have at least the similarity."""
    links = written(link_blocks(blocks, own.select("node", "print"), WIDE_RADIUS, folder=folder), "likely", folder)
    ends = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    few = written(texts(ends).select("node", "text"), "texts", folder)
    pairs = links.join(few.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(few.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    return pairs.where(_jaccard5("a", "b") >= similarity).select("u", "v")


def keep_one_of_each_group(docs: DataFrame, similarity: float = 0.8, cell: int = CELL) -> DataFrame:
    """docs without near-duplicates: of each group the row with the smallest doc_id (null ids last) stays, once."""
    folder = subfolder(docs.sparkSession, "near-duplicates")
    firsts = _firsts(docs, folder)
    groups = firsts.join(_groups(docs, firsts, similarity, cell, folder), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # null ids rank after all others; rows that tie on doc_id are told apart by their text, and equal rows stay once
    kept = groups.groupBy("root").agg(F.min_by("node", F.struct(F.col("id").isNull(), "id", "node")).alias("node"))
    kept = written(firsts.join(kept.select("node"), "node", "left_semi"), "kept")
    removed(docs.sparkSession, folder)  # the result reads docs and `kept` only
    rows = docs.select(F.struct(*docs.columns).alias("row"), _node().alias("node"), "doc_id")
    return _rows_of(rows, kept).select("row.*")
