"""Document fingerprints by SpotSigs.

A spot signature is a common word (the anchor) with the chain of the next content words after it. A
document's fingerprint is its set of hashed signatures, written as sorted hex. Likeness is the Jaccard
similarity of two sets, compared in order and given up as soon as a threshold is out of reach; sets can only
reach a threshold t if their sizes differ by less than 1/t, so joins are partitioned by set length.

Edge cases: null is as empty; a text without any signature has one signature of all its words (or of the raw
text, if it has none), so equal texts always have equal fingerprints and two empty texts have likeness 1;
documents are ordered by doc_id (null first), then text, and the last one's next is the first; repeated rows
are documents of their own; a group without any doc_id has none as its name; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm.blocks import id_blocks
from tallyfold.llm.cells import KEYS, by_cell, dealt_cells, filled_cells
from tallyfold.llm.common import components, subfolder, written
from tallyfold.session import removed

CHAIN = 3
#: Signatures are counted in so many buckets, a table of fixed size, to begin every set's order with rare ones.
BUCKETS = 1 << 18
#: In blocks of more members, each is compared with the block's leader first.
LARGE = 64
#: Common words (articles, prepositions, conjunctions, auxiliaries) of four languages.
COMMON = frozenset(
    """a an and are as at be by for from had has have he in is it not of on or that the this to was were which with you
    au aux avec ce dans de des du elle en est et il la le les ne ou par pas pour que qui se sur un une
    als auf aus bei das dem den der des die ein eine für im ist mit nicht sich sie und von war zu
    al como con del el ella es esta las lo los más no para pero por su y""".split()
)
_WORD = re.compile(r"\w+")


def signatures(text: str | None) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the text's spot signatures."""
    text = text or ""
    words = _WORD.findall(text.lower())
    content: list[str] = []
    anchors: list[tuple[str, int]] = []
    for w in words:
        if w in COMMON:
            anchors.append((w, len(content)))
        else:
            content.append(w)
    last = len(content) - CHAIN
    spots = {f"{a} {' '.join(content[k : k + CHAIN])}" for a, k in anchors if k <= last}
    if not spots:
        spots = {"\0" + (" ".join(words) or text)}
    digest = xxhash.xxh32_intdigest
    return np.unique(np.array([digest(s.encode("utf-8", "surrogatepass")) for s in spots], np.uint32))


def as_text(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def as_set(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def pruned_jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets, or 0 as soon as `least` is out of reach."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not len(long):
        return 1.0
    if len(short) < least * len(long):
        return 0.0
    need = math.ceil(least * (len(a) + len(b)) / (1 + least) - 1e-9)
    both, step = 0, 256
    for at in range(0, len(short), step):
        part = short[at : at + step]
        place = np.searchsorted(long, part)
        both += int((long[np.minimum(place, len(long) - 1)] == part).sum())
        if both + len(short) - at - len(part) < need:
            return 0.0
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The text, its last floor(n/4) code points replaced by as many (or all) of the first of what follows."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_with_next(docs: DataFrame, rows_per_block: int = 500, members: DataFrame | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs; with
    members (doc_id, node, group_id: see similar_groups) also group_id.

    Texts move once, to blocks of neighbouring ids. A block's last row meets the first of the next block through
    a copy of that row: one for each block. Members move to their rows' blocks, too.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    block = id_blocks(docs, rows_per_block)
    firsts = sorted(base.select("doc_id", block.alias("block")).groupBy("block").agg(F.min("doc_id").alias("doc_id")).collect())
    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out += "" if members is None else ", group_id long"
    if not firsts:
        return docs.sparkSession.createDataFrame([], out)
    before = [(firsts[k - 1].block, first.doc_id, first.block) for k, first in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(before, "to_block int, first_id long, own_block int")  # one row for each block
    copies = base.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("first_id")))
    none = [F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("group_id")]
    rows = base.select(block.alias("block"), F.lit(0).alias("copy"), "doc_id", "text", *none).union(
        copies.select(F.col("to_block").alias("block"), F.lit(1).alias("copy"), "doc_id", "text", *none)
    )
    if members is not None:
        rows = rows.union(members.select(block.alias("block"), F.lit(-1).alias("copy"), "doc_id", F.lit("").alias("text"), "node", "group_id").distinct())
    dealt = rows.repartition("block").sortWithinPartitions("block", "copy", F.col("doc_id").asc_nulls_first(), "text")
    whole = [F.col(c).cast("string").alias(c) for c in ("doc_id", "group_id")]  # pandas has no whole numbers beside nulls
    return dealt.select("block", "copy", "text", "node", *whole).mapInPandas(_with_next(members is not None), out)


def _with_next(grouped: bool):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # (block, doc_id, text, signatures) of the row that waits for its next
        at, named = None, {}  # the block whose members came last, and their groups
        for batch in batches:
            out = []
            columns = (batch[c] for c in ("block", "copy", "doc_id", "text", "node", "group_id"))
            for block, copy, doc_id, text, node, group in zip(*columns, strict=True):
                if copy < 0:
                    if at != block:
                        at, named = block, {}
                    named[node] = group
                    continue
                sigs = None
                if held is not None and held[0] == block:
                    sigs = signatures(text)
                    _, own_id, own, own_sigs = held
                    changed = edited(own, text)
                    changed_sigs = signatures(changed)
                    out.append(
                        (
                            _number(own_id),
                            len(own),
                            hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                            as_text(own_sigs),
                            as_text(changed_sigs),
                            pruned_jaccard(own_sigs, changed_sigs),
                            pruned_jaccard(own_sigs, sigs),
                            _number(named[node_of(own_sigs)]) if grouped else None,
                        )
                    )
                held = None if copy else (block, doc_id, text, signatures(text) if sigs is None else sigs)
            made = pd.DataFrame({c: pd.array(v, "Int64") if c in ("doc_id", "group_id") else v for c, v in zip(names, zip(*out, strict=True), strict=True)} if out else {c: [] for c in names})
            yield made if grouped else made.drop(columns="group_id")

    return run


def _number(x: str | None) -> int | None:
    return None if x is None or x != x else int(x)


def node_of(sigs: np.ndarray) -> int:
    """The set's node: what Spark's xxhash64 makes of its bytes."""
    h = xxhash.xxh64_intdigest(sigs.tobytes(), 42)
    return h - (h >> 63 << 64)


@F.pandas_udf(T.BinaryType())
def _signatures(text: pd.Series) -> pd.Series:
    return pd.Series([signatures(t).tobytes() for t in text])


def _set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32)


def _bucket_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    count = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        count += np.bincount(_set(b"".join(batch["s"])) % BUCKETS, minlength=BUCKETS)
    at = np.flatnonzero(count)
    yield pd.DataFrame({"bucket": at, "n": count[at]})


def _frequency(sets: DataFrame) -> np.ndarray:
    """The number of signatures in each bucket, over all sets: BUCKETS numbers, whatever the input."""
    counts = sets.select("s").mapInPandas(_bucket_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[counts["bucket"].to_numpy(int)] = counts["n"].to_numpy(int)
    return out


def _prefixes(frequency: np.ndarray, least: float):
    """A set's length class, the keys by which it meets sets of its own class and smaller ones, and how many of them serve to meet the class above.

    Sets of sizes a <= b that reach the likeness share least * b signatures at least, which is 2 * least / (1 + least) * a or more: so one
    of the first b - ceil(least * b) + 1 of the larger is among the first a - ceil(2 * least / (1 + least) * a) + 1 of the smaller, in any one order.
    """

    @F.pandas_udf("struct<place:int,keys:array<long>,low:int>")
    def prefixes(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in map(_set, s):
            n = len(x)
            own = n - math.ceil(least * n - 1e-9) + 1
            keys = x[np.lexsort((x, frequency[x % BUCKETS]))][:own].astype(np.int64)
            out.append((math.floor(-math.log(n) / math.log(least) + 1e-9), keys, n - math.ceil(2 * least / (1 + least) * n - 1e-9) + 1))
        return pd.DataFrame(out, columns=["place", "keys", "low"])

    return prefixes("s")


def _reaches(least: float):
    @F.pandas_udf(T.BooleanType())
    def reaches(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([pruned_jaccard(_set(x), _set(y), least) >= least for x, y in zip(a, b, strict=True)], dtype=bool)

    return reaches("a", "b")


def _alike(least: float):
    """Links of each cell: pairs of different roots, not both of the class below, by length until one is out of reach."""

    def handle(rows: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        out = []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            cell = rows.iloc[s:e]
            two = cell["i"].iat[0] != cell["j"].iat[0]
            sets = [_set(x) for x in cell["s"]]
            size = np.array([len(x) for x in sets])
            order = np.argsort(size, kind="stable")
            size, sets = size[order], [sets[k] for k in order]
            node, side, low = (cell[c].to_numpy()[order] for c in ("node", "side", "low"))
            root = np.unique(cell["root"].to_numpy()[order], return_inverse=True)[1]
            for x in range(len(sets)):
                near = np.arange(x + 1, np.searchsorted(size, size[x] / least + 1e-9, side="right"))  # the others are too long
                near = near[(root[near] != root[x]) & ((low[near] == 0) | (low[x] == 0))]
                if two:
                    near = near[side[near] != side[x]]
                for y in near.tolist():
                    if root[x] != root[y] and pruned_jaccard(sets[x], sets[y], least) >= least:
                        root[root == root[y]] = root[x]
                        out.append((node[x], node[y]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return handle


def similar_groups(docs: DataFrame, least: float = 0.8, cell: int = 512, large: int = LARGE) -> DataFrame:
    """doc_id, node (the signature set), group_id for every row of docs: sets that reach a Jaccard similarity of `least` are linked, and
    group_id is the smallest doc_id of all that are linked.

    Distinct sets are partitioned by length: a set meets those of its own length class, and with fewer keys those of the class above
    (_prefixes). Each set's keys begin with its rarest signatures, so passages that many documents share are seldom keys. Members of large
    blocks are first compared with the leader of their largest; then the blocks that still hold different roots are dealt into cells, where
    pairs of different roots are compared by the pruned Jaccard similarity.
    """
    spark = docs.sparkSession
    folder = subfolder(spark, "spots")
    early = subfolder(spark, "all", folder)
    every = written(docs.select("doc_id", _signatures("text").alias("s")).withColumn("node", F.xxhash64("s")), "own", early)
    own = written(every.select("doc_id", "node"), "own", folder)
    sets = written(every.select("node", "s").dropDuplicates(["node"]), "sets", folder)
    removed(spark, early)
    ids = written(own.groupBy("node").agg(F.min("doc_id").alias("id")), "ids", folder)
    p = written(sets.select("node", _prefixes(_frequency(sets), least).alias("p")).select("node", "p.*"), "prefixes", folder)
    blocks = p.select("node", F.col("place").alias("block"), F.lit(0).alias("low"), F.explode("keys").alias("key")).union(
        p.select("node", F.col("place") + 1, F.lit(1), F.explode(F.slice("keys", F.lit(1), F.col("low"))))
    )
    keys = ["block", "key"]
    met = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("only")).where("n > 1 AND only = 0").drop("only")
    rows = written(blocks.join(met.hint("merge"), keys), "met", folder)  # a key's rows lie together, so they are combined before the next shuffle
    alike = [F.bit_xor(F.xxhash64("node", "low")).alias("a"), F.bit_xor(F.xxhash64("low", "node")).alias("b")]
    met = rows.groupBy(*keys, "n").agg(F.min("node").alias("leader"), *alike)
    # blocks of the same members are compared once
    met = written(met.groupBy("block", "n", "leader", "a", "b").agg(F.min("key").alias("key")).drop("a", "b", "n"), "blocks", folder)
    rows = written(rows.join(met.hint("merge"), keys), "rows", folder)
    ends = rows.where(F.col("n") > large).groupBy("node").agg(F.max_by("leader", "n").alias("v")).where("node <> v")
    few = sets.hint("merge")  # sets meet by the same plan at every size
    both = ends.join(few.select("node", F.col("s").alias("a")), "node").join(few.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    first = written(both.where(_reaches(least)).select(F.col("node").alias("u"), "v"), "first", folder)
    roots = written(components(first, inside=folder), "roots", folder)
    rooted = rows.select(*keys, "node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    dealt = written(_open(dealt_cells(written(_open(rooted, keys), "open", folder), cell, folder=folder), KEYS), "dealt", folder)
    more = written(filled_cells(dealt, few).mapInPandas(by_cell(_alike(least)), "u long, v long").distinct(), "more", folder)
    roots = written(components(first.union(more), inside=folder), "all-roots", folder)
    names = roots.join(ids, "node").groupBy("root").agg(F.min("id").alias("group_id"))
    linked = written(roots.join(names, "root").select("node", "group_id", F.lit(True).alias("linked")), "named", folder)
    named = ids.join(linked, "node", "left").select("node", F.when(F.col("linked"), F.col("group_id")).otherwise(F.col("id")).alias("group_id"))
    out = written(own.select("doc_id", "node").join(written(named, "groups", folder), "node"), "grouped")
    removed(spark, folder)
    return out


def _open(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of those groups by the keys that have more than one root and are not all of the class below."""
    some = rows.groupBy(*keys).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("low").alias("only")).where("lo <> hi AND only = 0")
    return rows.join(some.select(*keys), keys, "left_semi")


def fingerprinted(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """compare_with_next with group_id, the class of similar documents (see similar_groups)."""
    rows = docs.select("doc_id", "text")
    return compare_with_next(rows, members=similar_groups(rows, least))
