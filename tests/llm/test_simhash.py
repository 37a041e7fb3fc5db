import re
from pathlib import Path

import numpy as np
import pytest
import xxhash

from tallyfold.llm import simhash as S

SF = "/root/testdata/sf0.01"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: {doc_id: fingerprint}, by comparing every two."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array([prints[i] for i in ids], np.uint64)
    for n, i in enumerate(ids):
        for m in np.flatnonzero(np.bitwise_count(values[:n] ^ values[n]) <= 4):
            a, b = top(i), top(ids[m])
            root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_majority_and_within_match_plain_counting():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 7, 64, 101):
        rows = rng.integers(0, 2**64, (n, 3), dtype=np.uint64)
        bits = np.unpackbits(rows.view(np.uint8).reshape(n, -1), axis=1, bitorder="little").sum(0)
        want = np.packbits(2 * bits > n, bitorder="little").view(np.uint64)
        assert (S.majority(rows) == want).all()
    a = rng.integers(0, 2**64, (9, 2), dtype=np.uint64)
    b = np.concatenate([a ^ np.uint64(0b1011), a ^ np.uint64(1 << 40), rng.integers(0, 2**64, (60, 2), dtype=np.uint64)])
    for r in (0, 1, 3, 4, 6, 60):
        want = np.bitwise_count(a[:, None] ^ b[None]).sum(-1) <= r
        assert (S.within(a, b, r) == want).all()


def test_fixture_against_every_pair(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in S.simhash_components(docs).collect()}
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    assert {i: v[0] for i, v in got.items()} == prints
    assert {i: v[1] for i, v in got.items()} == brute_components(prints)


@pytest.mark.parametrize("cell, shared", [(3, None), (2048, 1), (2048, 3), (2048, 4)])
def test_dense_blocks_are_dealt_into_cells_without_loss(spark, cell, shared):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63)
    fps = {int(base)} | {int(base) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (150, 2))}
    fps |= {int(x) for x in rng.integers(0, 2**63, 200)}
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in S.components(S.link_within_radius(frame, cell=cell, shared=shared)).collect()}
    want = brute_components({f: f for f in fps})
    assert {f: roots.get(f, f) for f in fps} == want


def test_keys_grow_longer_with_the_table():
    assert [S.shared_pieces(n, 4) for n in (10**3, 10**5, 10**7, 10**9, 2 * 10**10)] == sorted(S.shared_pieces(n, 4) for n in (10**3, 10**5, 10**7, 10**9, 2 * 10**10))
    n, k = 2 * 10**10, S.shared_pieces(2 * 10**10, 4)
    assert n / 2 ** (64 * k / (4 + k)) < 1  # a stranger a block at most


def test_nulls_ties_empties_and_clashing_names(spark):
    long = "word " * 50_000
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a b"), (5, long), (6, "  \n"), (None, "only one here now indeed")]
    docs = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in rows], "doc_id long, text string, fp int, node string, u int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_components(docs).collect()), key=str)
    assert len(got) == len(rows)
    by = {(i, f): c for i, f, c in got}
    assert by[1, "0" * 16] == by[2, "0" * 16] == by[6, "0" * 16] == 1
    assert by[None, f"{brute_fingerprint('a b'):016x}"] == 3
    assert by[None, f"{brute_fingerprint('only one here now indeed'):016x}"] is None
    assert S.simhash_components(docs.limit(0)).count() == 0
    kept = S.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.select("doc_id", "text").collect(), key=str) == sorted(
        [(1, None), (3, "a b"), (5, long), (None, "only one here now indeed")], key=str
    )
    assert S.keep_one_of_each_group(docs.limit(0)).count() == 0


def test_near_copies_of_similarity_08_are_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [re.findall(r"[^\x20\x09-\x0D]+", t.lower())]}
    ids, root, pairs = sorted(sets), {i: i for i in sets}, []

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small >= 0.8 * large and (k := len(sets[i] & sets[j])) >= 0.8 * (small + large - k):
                pairs.append((i, j))
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    want = {i for i in ids if top(i) == i}
    got = {r.doc_id for r in S.keep_one_of_each_group(docs).select("doc_id").collect()}
    assert got == want
    node = {r.doc_id: r.node for r in docs.selectExpr("doc_id", "xxhash64(text) AS node").collect()}
    group = {r.node: r.root for r in S.near_duplicates(docs).collect()}
    assert pairs and all(group.get(node[i], node[i]) == group.get(node[j], node[j]) for i, j in pairs)  # every link


@pytest.mark.parametrize("cell", [400, 2048])
def test_every_near_copy_in_a_large_group_is_joined(spark, cell):
    rng = np.random.default_rng(11)
    originals = [[f"w{x}" for x in rng.integers(0, 10**6, n)] for n in (300, 300, 24)]
    texts = [" ".join(o) for o in originals]
    for original, copies, edits in zip(originals, (1200, 40, 40), (5, 5, 1), strict=True):
        for _ in range(copies):
            w = list(original)
            for at in rng.choice(len(w), edits, replace=False):
                w[at] = f"e{rng.integers(0, 10**9)}"
            texts.append(" ".join(w))
    hashed = [np.unique([xxhash.xxh64_intdigest(" ".join(w[k : k + 5])) for k in range(len(w) - 4)]) for w in map(str.split, texts)]
    size = np.array([len(h) for h in hashed])
    ids = np.unique(np.concatenate(hashed), return_inverse=True)[1]
    rows = np.zeros((len(texts), ids.max() + 1), np.float32)
    rows[np.repeat(np.arange(len(texts)), size), ids] = 1
    shared = np.where(rows.sum(0) > 1)[0]
    both = rows[:, shared] @ rows[:, shared].T
    near = both / (size[:, None] + size[None] - both) >= 0.8
    np.fill_diagonal(near, True)
    group = np.arange(len(texts))
    while ((lower := np.where(near, group[None], len(texts)).min(1)) < group).any():
        group = lower
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    numbers = {r.node: r.doc_id for r in docs.selectExpr("xxhash64(text) AS node", "doc_id").collect()}
    found = {numbers[r.node]: r.root for r in S.near_duplicates(docs, cell=cell).collect()}
    least = {}
    for i in sorted(found):
        least.setdefault(found[i], i)
    assert [least[found[i]] if i in found else i for i in range(len(texts))] == group.tolist()


def test_tables_of_the_way_are_deleted(spark):
    from tallyfold.session import shared_folder

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept, groups, alike = S.keep_one_of_each_group(docs), S.near_duplicates(docs), S.simhash_components(docs)
    left = [p.name for p in Path(shared_folder(spark).removeprefix("file:")).iterdir()]
    assert not [n for n in left if n.startswith(("near-duplicates", "simhash"))]
    # the results read none of them
    assert 0 < kept.count() <= docs.count() == alike.count()
    assert groups.count() >= 2 * groups.select("root").distinct().count()


def template_texts(n, own, length=200):
    """n texts of one template, a share `own` of whose words are each text's own."""
    template = [f"t{k}" for k in range(length)]
    out = []
    for i in range(n):
        words = list(template)
        for k in range(0, int(own * length)):
            words[length - 1 - k] = f"w{i}x{k}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("open_cells", [0, 4])
def test_large_blocks_are_parted_by_prefixes_without_loss(spark, monkeypatch, open_cells):
    """Texts of one template, pairs of copies among them: blocks of shared prefixes link what a comparison of all pairs links."""
    from tallyfold.llm import simhash as S

    monkeypatch.setattr(S, "OPEN_CELLS", open_cells)
    texts = template_texts(120, 0.25)
    copies = [" ".join([*t.split()[:-1], "changed"]) for t in texts[::6]]
    docs = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in S.keep_one_of_each_group(docs, cell=8).collect())
    assert kept == list(range(120))


def test_twenty_thousand_texts_of_one_template_are_no_quadratic_work(spark):
    """At a similarity of about 0.6 no two texts share a rare prefix, so no cell of their large blocks is compared."""
    import time

    from pyspark.sql import functions as F

    from tallyfold.llm import simhash as S

    tail = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.concat(F.lit("w"), F.col("doc_id").cast("string"), F.lit("x"), k.cast("string"))), " ")
    head = " ".join(f"t{k}" for k in range(64))
    took = {}
    for n in (2_000, 20_000):
        docs = spark.range(n).select(F.col("id").alias("doc_id")).withColumn("text", F.concat(F.lit(head + " "), tail))
        began = time.time()
        assert S.keep_one_of_each_group(docs).count() == n
        took[n] = time.time() - began
    assert took[20_000] < 6 * took[2_000], took
