import base64
import datetime
import gzip
import hashlib
import io
import math
import random
import re
import string

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from tallyfold.llm import langid, mixing, packing, pii, registry, rules, secrets, spotsigs, tokens, warc

SF = "/root/testdata/sf0.01"
KEY = "key"
ODD = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "no id"), (5, "x" * 300_000), (6, " \n\t "), (7, "word " * 30_000), (8, "ünï   cödé 🙂 <|endoftext|>")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(
        [(i, t, None, None, 0, 9, "s") for i, t in ODD], "doc_id long, text string, lang string, source string, n_words long, n_tokens long, spans string"
    )


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = [tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns) for r in want.fetchall()]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, rows))


def test_odd_rows_have_a_result_everywhere(spark, odd):
    path = registry.vocabulary()
    runs = {
        "pack": packing.pack, "pii": lambda d: pii.pseudonymize(d, KEY), "rules": rules.quality, "spots": spotsigs.fingerprinted, "mix": mixing.mixture,
        "tokens": lambda d: tokens.token_counts(d, path), "secrets": secrets.scan, "lang": langid.identify,
    }
    for name, run in runs.items():
        got = run(odd)
        rows = got.collect()
        if name == "pack":
            assert {r.doc_id for r in rows} == {i for i, _ in ODD}
        else:
            assert len(rows) == len(ODD), name
        assert run(odd.limit(0)).count() == 0, name
        if name == "pii":  # there is nothing to permute
            assert sorted(map(str, ((r.doc_id, r.text) for r in rows))) == sorted(map(str, ODD)) and not any(r[f"n_{k}"] for r in rows for k in pii.KINDS)
        if name == "rules":
            words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in ODD}
            assert {r.doc_id: (r.n_words, r.base_failed and not r.kept) for r in rows} == {i: (n, True) for i, n in words.items()}
        if name == "spots":
            assert sorted(r.n_chars for r in rows) == sorted(len(t or "") for _, t in ODD) and len({r.fingerprint for r in rows if r.doc_id == 3}) == 1
            assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
            own = {}  # equal fingerprints are one group, named by its smallest id
            for r in rows:
                own.setdefault(r.fingerprint, []).append(r)
            assert all(len({r.group_id for r in same}) == 1 for same in own.values()) and {r.group_id for r in rows} <= {r.doc_id for r in rows}
        if name == "tokens":
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            n = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in ODD}
            assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {i: (len((t or "").encode()), n[i], n[i] > 1024) for i, t in ODD}
        if name == "lang":  # no row has a language
            assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    twice = tokens.prefix_table(odd.withColumn("Prefix_Changes", F.lit(1)), path)
    assert len(twice.columns) == len(set(map(str.lower, twice.columns))) and twice.where("doc_id = 2").first().n_tokens == 0
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<p>"), (4, None, "<p>"), (4, None, "<p>"), (None, "u", "<p>")], "page_id long, url string, html string")
    got = sorted(map(str, ((r.page_id, r.record_type, r.refers_to) for r in warc.archived(pages).collect())))
    assert got == sorted(map(str, [(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3), (4, "revisit", 3), (None, "revisit", 3)]))
    assert warc.archived(pages.limit(0)).count() == 0


def test_boundaries_are_optimal():
    rng = np.random.default_rng(2)
    from itertools import combinations

    for _ in range(20):
        hist = {int(x): int(rng.integers(1, 9)) for x in rng.choice(60, 9, replace=False) + 1}
        lengths = sorted(hist)

        def padded(bounds, hist=hist):
            return sum(n * min(b for b in bounds if b >= x) for x, n in hist.items())

        best = min(padded((*c, lengths[-1])) for c in combinations(lengths[:-1], 3))
        assert padded(packing.boundaries(hist, 4)) == best


def test_batches_hold_their_budget_and_all_tokens(docs):
    got = packing.pack(docs, max_tokens=500, buckets=5, token_budget=4000, rows_per_block=50).collect()
    sizes = {}
    for r in got:
        assert 0 <= r.padding and r.n_tokens <= r.bucket
        if r.batch is not None:
            sizes.setdefault((r.bucket, r.batch), []).append(r.place)
    for (bucket, _), places in sizes.items():
        assert sorted(places) == list(range(len(places))) and bucket * len(places) <= max(bucket, 4000)
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.select("text").collect())
    assert sum(r.n_tokens for r in got) == words


def luhn(d):
    return sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms_keep_their_format_and_links(spark):
    texts = [
        "mail Anna.B-7@mail8.example.com, card 4111 1111 1111 1111 and 4111 1111 1111 1112.",
        "born 1984-02-29, seen 03/04/2020; not 2020-13-01. ssn 123-45-6789, not 000-12-3456",
        "from 10.0.0.1 and 10.0.0.1, not 300.1.1.1; call +1 (988) 555-2485 Anna.B-7@mail8.example.com",
        None,
        "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymize(df, KEY).collect()}
    a, b, c = (out[i].text for i in range(3))
    m = re.fullmatch(r"mail ([A-Z][a-z]{3}\.[A-Z]-\d@[a-z]{4}\d\.[a-z]{7}\.com), card (\d{4} \d{4} \d{4} \d{4}) and 4111 1111 1111 1112\.", a)
    assert m and m[2] != "4111 1111 1111 1111" and luhn(m[2].replace(" ", "")) and m[1] in c
    assert re.fullmatch(r"born \d{4}-\d\d-\d\d, seen \d\d/\d\d/\d{4}; not 2020-13-01\. ssn \d{3}-\d\d-\d{4}, not 000-12-3456", b) and "1984-02-29" not in b and "123-45-6789" not in b
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", c)
    assert ips[0] == ips[1] != "10.0.0.1" and ips[2] == "300.1.1.1" and "555-2485" not in c and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", c)
    assert out[3].text is None and out[4].text == ""
    back = {r.doc_id: r.text for r in pii.pseudonymize(pii.pseudonymize(df, KEY).select("doc_id", "text"), KEY, restore=True).collect()}
    assert back == dict(enumerate(texts))
    assert pii.pseudonymize(df, key="another").first().text != a


def test_cards_beside_short_numbers_and_dates_with_the_month_first(spark):
    card = "4111 1111 1111 1111"
    texts = [f"{card} 12/27", f"{card} 123", f"No 12 {card}", "4111111111111111 2", f"12-{card.replace(' ', '-')}-7", "3782 822463 10005 1234", f"{card} {card}", "12 34 56 " + card]
    cards = [card] * 4 + [card.replace(" ", "-"), "3782 822463 10005", card, card]
    cards[3] = "4111111111111111"
    dates = ["due 12/31/2024", "due 02/29/2024", "due 05/13/1999"]
    df = spark.createDataFrame(list(enumerate([*texts, *dates, "due 02/30/2024 or 13/13/2024"])), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymize(df, KEY).collect()}
    for i, (t, c) in enumerate(zip(texts, cards, strict=True)):
        shape = re.fullmatch(re.escape(t).replace(re.escape(c), "(" + re.sub("[0-9]", "[0-9]", c) + ")"), out[i].text)
        assert shape and c not in out[i].text and all(luhn(re.sub("[ -]", "", g)) for g in shape.groups()), (t, out[i].text)
        assert out[i].n_card == t.count(c)
    for i, t in enumerate(dates, len(texts)):
        m = re.fullmatch("due ([0-9]{2})/([0-9]{2})/[0-9]{4}", out[i].text)
        assert m and out[i].text != t and int(m[1]) <= 12 < int(m[2]) and out[i].n_date == 1
    assert out[11].text == "due 02/30/2024 or 13/13/2024" and out[11].n_date == 0
    back = pii.pseudonymize(spark.createDataFrame([(i, r.text) for i, r in out.items()], "doc_id long, text string"), KEY, restore=True)
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text for r in df.collect()}


def test_ledger_ablations(docs):
    book = rules.ledger(docs)
    got = {r.rule: r for r in rules.ablations(book).collect()}
    bits = [r.failed_bits for r in book.collect()]
    for name, _ in rules.RULES:
        bit = rules.BIT[name]
        assert (got[name].n_failed, got[name].n_only, got[name].n_kept_without) == (sum(b & bit > 0 for b in bits), bits.count(bit), bits.count(0) + bits.count(bit))


def test_edited_texts_and_likeness(docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()))
    got = {r.doc_id: r for r in spotsigs.compare_with_next(docs, rows_per_block=37, members=spotsigs.similar_groups(docs)).collect()}
    assert len(got) == len(rows)
    groups = {r.doc_id: r for r in spotsigs.similar_groups(docs).collect()}
    for k, (i, text) in enumerate(rows):
        follow = rows[(k + 1) % len(rows)][1]
        n = len(text) // 4
        changed = text[: len(text) - n] + follow[:n]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = (set(spotsigs.signatures(t).tolist()) for t in (text, changed, follow))
        assert spotsigs.as_set(r.fingerprint).tolist() == sorted(a)
        assert spotsigs.node_of(spotsigs.as_set(r.fingerprint)) == groups[i].node and r.group_id == groups[i].group_id <= i
        assert abs(r.near_edited - len(a & b) / len(a | b)) < 1e-12 and abs(r.near_next - len(a & c) / len(a | c)) < 1e-12


@pytest.mark.parametrize(("cell", "large"), [(512, 64), (4, 2)])
def test_similar_groups_against_every_pair(docs, cell, large):
    """Texts with copies and near copies of some: cells of 4 cut every larger block, and blocks of 3 have a leader."""
    some = docs.where("doc_id < 300").select("doc_id", "text")
    grown = F.expr("concat(text, ' the copy number ', doc_id % 7, ' of this page')")
    some = some.union(some.where("doc_id % 5 = 0").select(F.col("doc_id") + 1000, grown)).union(some.where("doc_id % 9 = 0").selectExpr("doc_id + 2000", "text"))
    sets = {r.doc_id: set(spotsigs.signatures(r.text).tolist()) for r in some.collect()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    assert {r.doc_id: r.group_id for r in spotsigs.similar_groups(some, cell=cell, large=large).collect()} == {i: top(i) for i in sets}


@pytest.mark.parametrize("hot", [False, True])
def test_samples_meet_their_targets(docs, hot):
    """With the query's own parameters, and with a source that holds a third of all rows."""
    if hot:
        docs = docs.withColumn("source", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'hot' ELSE source END"))
    mixed = mixing.mixture(docs).cache()
    tokens, spent = mixed.selectExpr("sum(n_tokens)", "sum(n_tokens * probability)").first()
    top = mixed.where("n_tokens > 0").agg(F.max("probability")).first()[0]
    assert spent <= mixing.SHARE * tokens * (1 + 1e-9) and (top == 1 or abs(spent - mixing.SHARE * tokens) < 1e-6 * tokens)
    shares = {m: {} for m in mixing.MARGINS}
    for r in mixed.where("n_tokens > 0").collect():
        for m in mixing.MARGINS:
            shares[m][r[m]] = shares[m].get(r[m], 0) + r.n_tokens
    got = {(r.margin, r.value): r for r in mixing.achieved(mixed).collect()}
    for m, power in zip(mixing.MARGINS, mixing.POWERS, strict=True):
        raised = {v: n**power for v, n in shares[m].items()}
        for v, x in raised.items():
            target = x / sum(raised.values())
            assert abs(got[m, v].expected - target) < 0.01 * target and abs(got[m, v].raked - target) < 0.01 * target


def test_budget_bounds_the_sample(docs):
    mixed = mixing.mixture(docs, share=0.01)
    tokens, spent = mixed.selectExpr("sum(n_tokens)", "sum(n_tokens * probability)").first()
    assert abs(spent - 0.01 * tokens) < 1e-4 * tokens


def test_archives_split_anywhere(spark, tmp_path):
    inner = warc.record(99, "inner", "x" * 50, None, False)
    made = [warc.record(i, f"u{i}", ("ab\x1f\x8b\x08" * i) + str(i), None, False) for i in range(40)]
    data = b"".join(m + warc.EMPTY for m in made)
    assert gzip.GzipFile(fileobj=io.BytesIO(data)).read().count(b"WARC/1.1") == 40
    for size in (1, 37, 100, 5000):
        found = [r for s in range(0, len(data), size) for r in warc.scan_range(io.BytesIO(data), s, s + size)]
        assert [warc._page(warc.parse(m)["fields"]["WARC-Record-ID"]) for _, _, m in found] == list(range(40))
    assert inner.startswith(warc.MAGIC)
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i % 7}é" * 50) for i in range(60)], "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    rows = warc.read_archive(spark, path, size=300).collect()
    assert sorted(r.page_id for r in rows) == list(range(60)) and all(r.intact for r in rows)
    assert {r.page_id: bytes(r.payload).decode() for r in rows if r.record_type == "response"} == {i: f"<p>{i}é" * 50 for i in range(7)}


def test_prefix_counts_equal_the_library(docs):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(registry.vocabulary()), tokens.PrefixCounter(registry.vocabulary())
    texts = ["a  b\n\n\nc   ", "don't we'll 'r 've 're' x''s", "<|endoftext|>a.<|endoftext|> b", "é  ü　　 x", "日本語  🙂🙂 ²½x", " '’s’", ""]
    texts += [r.text[:120] for r in docs.limit(20).collect()]
    for t in texts:
        counts = np.cumsum(own.text_changes(t), dtype=int)
        assert [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(1, len(t) + 1)] == counts.tolist()


def test_token_counts_and_longest_prefix(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.vocabulary())
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in tokens.token_counts(docs.where("doc_id % 5 = 0"), registry.vocabulary()).collect():
        assert r.n_tokens == len(library.encode(text[r.doc_id], add_special_tokens=False).ids) and r.over_limit == (r.n_tokens > 1024)
        assert len(library.encode(text[r.doc_id][: r.limit_chars], add_special_tokens=False).ids) <= 1024


def test_secret_spans_against_plain_patterns(docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in secrets.scan(docs).collect():
        t = text[r.doc_id]
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        listed = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_random_runs_are_told_from_words(spark):
    rng = random.Random(4)
    words = ["internationalization-of-electroencephalography", "https-some-long-path-of-words-and-names", "Donaudampfschifffahrtsgesellschaft", "counterrevolutionaries"]
    rows = [(i, f"see {rng.choice(words)} and {rng.choice(words)} here") for i in range(200)]
    rows += [(1000 + i, f"key {base64.urlsafe_b64encode(rng.randbytes(30)).decode()} end") for i in range(20)]
    got = {r.doc_id: r.n_random for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[1000 + i] for i in range(20)) >= 18
    assert not any(got[i] for i in range(200))
    clean = secrets.redact(spark.createDataFrame([(1, 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', 55)], "doc_id long, text string, n_chars long")).first()
    assert clean.text == 'x [secret]" y' and clean.n_chars == len(clean.text)


def test_keys_joined_to_a_pattern_are_found(spark):
    rng = random.Random(8)
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=34)) for _ in range(40)]
    shapes = ["see /blob/{h}/{k} here", "see {k}-{h} here", "see {h}_{k} here", "see {k}/{h}/{k} here"]
    texts = [shapes[i % 4].format(h=rng.randbytes(20).hex(), k=k) for i, k in enumerate(keys)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.n_hex, r.n_random) for r in secrets.scan(df).collect()} == {i: (1, 2 if i % 4 == 3 else 1) for i in range(40)}
    assert not [r for r in secrets.redact(df).collect() if keys[r.doc_id] in r.text]


@pytest.mark.parametrize("symbols", ["0123456789abcdef", string.ascii_uppercase + "234567", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"])
def test_battery_holds_its_level_and_tells_order_from_chance(symbols):
    rng = random.Random(3)
    p = np.array([secrets.battery("".join(rng.choices(symbols, k=200)))[1:] for _ in range(1000)])
    assert (abs((p < 0.05).mean(axis=0) - 0.05) < 0.03).all()
    k, uniform, _, serial = secrets.battery(symbols * 4)
    assert min(uniform, serial) < 1e-6
    assert secrets.battery("a" * 40)[1] < 1e-6


@pytest.mark.parametrize(
    "shape, make, least",
    [
        ("key {} end", lambda r: base64.b64encode(r.randbytes(30)).decode(), 0.99),
        ("sk_live_{} end", lambda r: "".join(r.choices(string.ascii_letters + string.digits, k=32)), 0.99),
        ("base64:{} end", lambda r: base64.b64encode(r.randbytes(24)).decode(), 0.95),
        ("id {} end", lambda r: base64.b32encode(r.randbytes(25)).decode(), 0.9),
        ("id {} end", lambda r: r.randbytes(24).hex().upper(), 0.95),
        ("short {} end", lambda r: "".join(r.choices(string.ascii_letters + string.digits, k=20)), 0.9),
    ],
)
def test_recall_of_planted_secrets(spark, docs, shape, make, least):
    rng = random.Random(6)
    planted = [make(rng) for _ in range(200)]
    rows = [(10**6 + i, f"some words before {shape.format(x)}") for i, x in enumerate(planted)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    text = dict(rows)
    hits = false = 0
    for r in secrets.scan(both).where("n_random > 0 OR doc_id >= 1000000").collect():
        spans = [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("random:")]
        if r.doc_id < 10**6:
            false += len(spans)
        else:
            hits += any(planted[r.doc_id - 10**6] in text[r.doc_id][s:e] for s, e in spans)
    assert hits >= least * len(planted) and not false, (hits, false)


def test_the_cut_equals_a_plain_loop_over_the_whole_table(spark, docs):
    """Runs, tests of chance, unlikeness to language and the cut of each length class, one run at a time."""
    rng = random.Random(11)
    planted = [(10**6 + i, f"x {base64.b32encode(rng.randbytes(20 + i % 9)).decode().rstrip('=')} y {''.join(rng.choices(string.ascii_letters + string.digits, k=20 + i % 20))} z") for i in range(150)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    classes, runs = {}, {}
    for r in both.collect():
        text = r.text or ""
        taken = [False] * len(text)
        for s, _, e in secrets.base_spans(text):
            taken[s:e] = [True] * (e - s)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
            at = m.start()
            while at < m.end():
                end = at
                while end < m.end() and not taken[end]:
                    end += 1
                if end - at >= 20:
                    chance = secrets.joint(secrets.battery(text[at:end])[1:]) >= 1e-4
                    score = min(600, math.floor(10 * secrets.log_p(text[at:end]))) if chance else -1
                    classes.setdefault(math.floor(2 * math.log2(end - at)), []).append(score)
                    runs.setdefault(r.doc_id, []).append((at, end, score))
                at = max(end, at + 1)
    cut = {}
    for length, scores in classes.items():
        fits = [b for b in set(scores) if b >= 0 and 10 ** (-b / 10) <= secrets.RATE * sum(x >= b for x in scores) / len(scores)]
        cut[length] = min(fits, default=10**9)
    want = {i: sorted((s, e) for s, e, b in found if b >= cut[math.floor(2 * math.log2(e - s))]) for i, found in runs.items()}
    got = {r.doc_id: sorted(tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("random:")) for r in secrets.scan(both).collect()}
    assert {i: x for i, x in got.items() if x} == {i: x for i, x in want.items() if x} and sum(map(len, want.values())) > 200


def test_secret_rows_of_odd_texts(odd):
    empty = hashlib.sha256(b"").hexdigest()
    for r in secrets.scan(odd).collect():
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == (0, 0, 0, empty, "")


def test_mixture_rows_of_odd_texts(odd):
    rows = mixing.mixture(odd).collect()
    for r in rows:
        assert (r.source, r.lang) == ("", "")
        assert (r.topic == "empty") == (r.doc_id in (1, 2)) and (r.topic != "empty" or (r.n_tokens, r.weight, r.probability, r.sampled) == (0, 0, 1, True))
    assert sum(dict((r.topic, r.weight) for r in rows if r.n_tokens).values()) == pytest.approx(1)


#: Identifiers in notations that are easily missed: all but the last two are permuted.
PROBES = [
    "müller@example.de", "Σωκράτης.Π@παράδειγμα.gr", "4111.1111.1111.1111", "3782.822463.10005", "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819",
    "0171/2345678", "1985/03/12", "12-03-1985", "ivan.петров@пример.com", "DE88 3704 0044 0532 0130 00", "01/2024",
]


def test_identifiers_in_other_notations(spark):
    df = spark.createDataFrame([(i, f"see {t}, please") for i, t in enumerate(PROBES)], "doc_id long, text string")
    out = {r.doc_id: r.text.removeprefix("see ").removesuffix(", please") for r in pii.pseudonymize(df, KEY).collect()}
    shape = lambda t: [c.isdigit() or c.isalpha() and c.isupper() + 2 or c for c in t]
    for i, t in enumerate(PROBES):
        assert (out[i] == t) == (i >= len(PROBES) - 2), (t, out[i])
        assert shape(out[i]) == shape(t)
    assert luhn(out[2].replace(".", "")) and out[4].startswith("DE") and Plain("other").iban(out[4])
    back = pii.pseudonymize(pii.pseudonymize(df, KEY).select("doc_id", "text"), KEY, restore=True)
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text for r in df.collect()}


class Plain:
    """Pseudonyms by plain loops over one match at a time."""

    def __init__(self, key):
        self.key = key

    def hash(self, kind, turn, other):
        base = f"{self.key}|{kind}|{turn}|{other}".encode()
        return hashlib.sha512(b"0" + base).hexdigest() + hashlib.sha512(b"1" + base).hexdigest()

    def string(self, v, kind):
        a, b = v[: len(v) // 2], v[len(v) // 2 :]
        for t in range(pii.ROUNDS):
            half, other = (a, b) if t % 2 == 0 else (b, a)
            h, moved = self.hash(kind, t, other), ""
            for i, c in enumerate(half):
                k = int(h[4 * (i % 64) : 4 * (i % 64) + 4], 16)
                moved += next((x[(x.index(c) + k) % len(x)] for x in (string.digits, string.ascii_lowercase, string.ascii_uppercase, *pii.ALPHABETS) if c in x), c)
            a, b = (moved, b) if t % 2 == 0 else (a, moved)
        return a + b

    def pair(self, a, b, sizes, kind):
        for t in range(pii.ROUNDS):
            k = int(self.hash(kind, t, str(b if t % 2 == 0 else a))[:8], 16)
            a, b = ((a + k) % sizes[0], b) if t % 2 == 0 else (a, (b + k) % sizes[1])
        return a, b

    def refill(self, shape, digits):
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in shape)

    def card(self, v):
        d = re.sub("[^0-9]", "", v)
        body = d[0] + self.string(d[1:-1], "card")
        return self.refill(v, body + next(c for c in "0123456789" if luhn(body + c))) if 13 <= len(d) <= 19 and luhn(d) else None

    def ip(self, v):
        o = [int(x) for x in v.split(".")]
        if max(o) > 255:
            return None
        a, b = self.pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), "ip")
        return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"

    def date(self, v):
        first = datetime.date(1900, 1, 1)

        def read(y, m, d):
            try:
                day = (datetime.date(int(v[y : y + 4]), int(v[m : m + 2]), int(v[d : d + 2])) - first).days
            except ValueError:
                return None
            return day

        year_first = v[4] in "-/"
        day = read(0, 5, 8) if year_first else read(6, 3, 0)
        month_first = day is None and not year_first
        day = read(6, 0, 3) if month_first else day
        if day is None or not 0 <= day < pii.DAY_A * pii.DAY_B:
            return None
        while True:
            a, b = self.pair(day // pii.DAY_B, day % pii.DAY_B, (pii.DAY_A, pii.DAY_B), "date")
            day = a * pii.DAY_B + b
            at = first + datetime.timedelta(days=day)
            if not month_first or at.day > 12:
                break
        if year_first:
            return at.isoformat().replace("-", v[4])
        return v[2].join([f"{at.month:02}", f"{at.day:02}", str(at.year)] if month_first else [f"{at.day:02}", f"{at.month:02}", str(at.year)])

    def ssn(self, v):
        area, group, serial = (int(x) for x in v.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        areas = [x for x in range(1, 900) if x != 666]
        a, b = self.pair(areas.index(area), (group - 1) * 9999 + serial - 1, (898, 99 * 9999), "ssn")
        return f"{areas[a]:03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"

    def phone(self, v):
        code = re.match(r"(?:\+[0-9]{1,3}(?=[ .(-])|0(?=[0-9]+/))?", v)[0]
        return code + self.string(v[len(code) :], "phone") if 7 <= len(re.sub("[^0-9]", "", v)) <= 15 else None

    def iban(self, v):
        bare = v.replace(" ", "")
        number = lambda x: int("".join(str(int(c, 36)) for c in x))
        if not 15 <= len(bare) <= 34 or number(bare[4:] + bare[:4]) % 97 != 1:
            return None
        body = self.string(bare[4:], "iban")
        made = f"{bare[:2]}{98 - number(body + bare[:2] + '00') % 97:02}{body}"
        return " ".join(made[k : k + 4] for k in range(0, len(made), 4)) if " " in v else made

    def email(self, v):
        if ".." in v or ".@" in v:
            return None
        local, domain = v.split("@")
        rest, _, top = domain.rpartition(".")
        return f"{self.string(local, 'local')}@{self.string(rest, 'domain')}.{top}"

    def text(self, t):
        def one(m):
            kind = next((k for k in pii.KINDS if re.fullmatch(pii.PATTERNS[k], m[0])), None)
            return (getattr(self, kind)(m[0]) if kind else None) or m[0]

        return re.sub(pii.ANY, one, t)


def test_pseudonyms_against_plain_loops_over_the_whole_table(spark, docs):
    plain = Plain(KEY)
    more = ["ssn 123-45-6789 and 665-01-0001, 667-99-9999", "12/31/2024 31.12.2024 2024-12-31", "4111-1111-1111-1111", "+44 20 7946 0958", "a.b@c.de", *PROBES]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    text = {r.doc_id: r.text for r in every.collect()}
    out = {r.doc_id: r.text for r in pii.pseudonymize(every, KEY).collect()}
    assert sum(out[i] != text[i] for i in out) > 50
    assert not [i for i in out if out[i] != plain.text(text[i])]


def test_numbers_are_permuted_one_to_one(spark):
    df = spark.range(0, 60_000).select(F.col("id").alias("doc_id"), F.expr("concat(lpad(CAST(1 + id % 665 AS STRING), 3, '0'), '-', lpad(CAST(1 + id % 99 AS STRING), 2, '0'), '-', lpad(CAST(1 + id % 9973 AS STRING), 4, '0'))").alias("text"))
    out = pii.pseudonymize(df, KEY)
    assert out.select("text").distinct().count() == df.select("text").distinct().count() and not out.where("n_ssn <> 1").count()
    back = pii.pseudonymize(out.select("doc_id", "text"), KEY, restore=True)
    assert not back.join(df.withColumnRenamed("text", "t"), "doc_id").where("text <> t").count()


def test_many_cells_are_raked_without_one_task(spark, docs):
    """The sums of margins, joined back, give the weights of the windows in one partition."""
    units = mixing._units(docs).withColumn("source", F.concat("source", (F.col("doc_id") % 37).cast("string")))
    few, many = (sorted(mixing.raked_cells(units, one_task=n).collect(), key=lambda r: r[:3]) for n in (10**6, 10))
    assert len(few) == len(many) > 100
    for a, b in zip(few, many, strict=True):
        assert a[:4] == b[:4] and a.weight == pytest.approx(b.weight, rel=1e-9) and a.probability == pytest.approx(b.probability, rel=1e-9)


def test_junk_languages_are_not_learned(spark):
    rows = [(i, ("the house by the river was old and green ", "das Haus am Fluss war alt und sehr grün ")[i % 2] * (2 + i % 5), ("en", "de")[i % 2]) for i in range(60)]
    junk = spark.range(1000, 101_000).selectExpr("id AS doc_id", "concat('words of no language ', id) AS text", "concat('x', id) AS lang")
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(junk))
    assert model.languages == {"germanic": ["de", "en"]}
    many = spark.range(0, 80 * 9).selectExpr("id AS doc_id", "concat('word', id % 80) AS text", "concat('l', lpad(id % 80, 2, '0')) AS lang")
    assert sum(map(len, langid.fit(many).languages.values())) == langid.MOST_LANGUAGES


def test_wide_changes_of_token_counts_are_kept():
    for c in (np.array([], np.int16), np.array([1, -5, 127], np.int16), np.array([1, 300, -299], np.int16)):
        assert tokens.unpacked(tokens.packed(c)).tolist() == c.tolist()


def brute_language(text, model):
    """Features and both levels by plain loops."""
    low = (text or "").lower()
    if not any(map(str.isalpha, low)):
        return "und", 0.0
    m32 = 0xFFFFFFFF
    count = {}
    # other characters than letters are blanks, of which the first after a letter, or in the text, is kept
    padded = " " + "".join(c if c.isalpha() else " " for k, c in enumerate(low) if k == 0 or c.isalpha() or low[k - 1].isalpha()) + " "
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        two = (ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA77) & m32
        for h in (two, (two + ord(c) * 0xC2B2AE3D) & m32):
            h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & m32
            k = (h >> 12) % langid.DIM
            count[k] = count.get(k, 0) + 1
    norm = sum(count.values()) ** 0.5
    v = {k: n**0.5 / norm for k, n in count.items()}
    z = [sum(model.family_w[f][k] * x for k, x in v.items()) + model.family_b[f] for f in range(len(model.families))]
    best = max(range(len(z)), key=lambda f: z[f])
    family, share = model.families[best], 1 / sum(np.exp(y - z[best]) for y in z)
    votes = dict.fromkeys(model.languages[family], 0.0)
    for one, other, w, b in model.pairs[family]:
        p = 1 / (1 + np.exp(-2 * min(20, max(-20, sum(w[k] * x for k, x in v.items()) + b))))
        votes[one] += p
        votes[other] += 1 - p
    winner = max(sorted(votes), key=votes.get)
    return winner, share * (votes[winner] / (len(votes) - 1) if len(votes) > 1 else 1)


def test_languages_against_plain_loops_over_the_whole_table(docs):
    model = langid.fit(docs)
    assert len(model.families) > 1 and any(model.pairs.values())
    got = {r.doc_id: r.g for r in docs.select("doc_id", langid.guess(model).alias("g")).collect()}
    for r in docs.collect():
        lang, score = brute_language(r.text, model)
        assert got[r.doc_id].lang == lang and abs(got[r.doc_id].score - score) < 1e-6


def test_held_out_language_accuracy(docs):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in langid.identify(docs).collect() if r.held_out]
    assert len(rows) > 200 and sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_pipeline_stages_against_their_own_input(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF)
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in before.collect()}
            break
        assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), docs.schema)
        if name == "secrets":
            assert out.count() == before.count() and not out.where(r"text rlike '[0-9a-f]{16,}|AKIA[A-Z0-9]{14,}'").count()
        if name == "mixing":
            want = {r.doc_id for r in mixing.mixture(before, powers=corpus_pipeline.POWERS).where("sampled").collect()}
            assert len(want) > 0.4 * before.count()
            assert {r.doc_id for r in out.collect()} == want
        before = out


CLASHING = "lang_pred string, score double, _guess string, node long, id long, row string, runs string, s string, topic string, weight double, n_tokens long, bucket long, block int, _id int, _none boolean"


@pytest.mark.parametrize("labelled", [False, True])
def test_pipeline_stages_on_odd_empty_and_clashing_tables(spark, labelled):
    """Every stage keeps its input's columns whatever their names, and gives each odd row its stated result."""
    import corpus_pipeline

    english, german = "the house by the river was old and the garden was green ", "das Haus am Fluss war alt und der Garten war sehr grün "
    rows = [(i, t, None, None, 0) for i, t in ODD] + [(100 + i, (english, german)[i % 2] * (3 + i), ("en", "de")[i % 2] if labelled else None, "s", 0) for i in range(40)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = plain.selectExpr("*", *[f"CAST(NULL AS {x.split()[1]}) AS {x.split()[0]}" for x in CLASHING.split(", ")])
    for docs in (clashing, clashing.limit(0)) if labelled else (plain,):
        before, empty = docs, not docs.limit(1).count()
        for name, stage in corpus_pipeline.STAGES if labelled else corpus_pipeline.STAGES[:1]:
            out = stage(spark, before, SF)
            if name == "packing":
                assert {r.doc_id for r in out.collect()} == {r.doc_id for r in before.collect()}
                break
            assert out.columns == docs.columns and out.schema == docs.schema.__class__([out.schema[c] for c in docs.columns])
            found = out.collect()
            texts = {(r.doc_id, r.text) for r in found}
            if empty:
                assert not found
            elif name == "language":
                gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in found}
                assert gone >= {1, 2, 6} if labelled else not gone
                assert not labelled or sum(r.lang == ("en", "de")[r.doc_id % 2] for r in found if (r.doc_id or 0) >= 100) == 40
            elif name == "near_duplicates":
                assert len(found) == len(texts) and {3, None} <= {i for i, _ in texts}
            elif name == "secrets":
                assert texts == {(r.doc_id, r.text) for r in before.collect()}
            before = spark.createDataFrame(found, docs.schema)
