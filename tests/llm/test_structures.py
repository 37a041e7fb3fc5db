"""Chat formatting, the prefix tree and the Merkle manifest against plain loops, with odd and hot inputs."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from tallyfold.llm import chat, merkle, trie

SCHEMA = "conv_id long, turn long, role string, text string"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def conversations(seed=1, n=150):
    """Shared beginnings, copies, nulls, ties, repeated rows, control strings and escapes inside texts and roles."""
    rng, rows = random.Random(seed), []
    bits = ["</s>", "[INST]", "␛", "<|end|>", "<|text|>", "ok", "", "é🙂", "<", "\n", "[/INST]", "<s>", "<<SYS>>", "␛␛", "<|turn|>user"]
    for c in range(n):
        for t in range(rng.randrange(0, 9)):
            role = rng.choice(["user", "assistant", "system", None, "<|text|>"])
            text = rng.choice([None, "same", "".join(rng.choice(bits) for _ in range(rng.randrange(6)))])
            rows.append((c, t if rng.random() < 0.9 else None, role, text))
        if rng.random() < 0.2 and rows:
            rows.append(rows[-1])
    rows += [(-5, 0, "user", "a"), (-205, None, None, None), (10**15, 3, "user", "x" * 50_000), (None, 1, "assistant", "nobody's")]
    return rows


def order(row):
    return (row[1] is not None, row[1] or 0, row[2] or "", row[3] or "")


def test_formatting_equals_plain_loops(spark):
    rows = conversations() + [(chat.QUOTED_ID, 0, "user", chat.QUOTED), (chat.QUOTED_ID, 1, "assistant", chat.QUOTED)]
    given = spark.createDataFrame(rows[:-2], SCHEMA).withColumns({"message": F.lit("clash"), "seq": F.lit(1), "part": F.lit(2), "kind": F.lit(None)})
    want = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=order)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        want[c] = (len(turns), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)), len(loss), sha(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.formatted(given).collect()}
    assert got == want
    assert [r.conv_id for r in chat.formatted(given.limit(0)).collect()] == [chat.QUOTED_ID]
    assert chat.format_chats(chat.as_log(given.limit(0))).count() == 0


def test_long_conversations_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 16)
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t}") for t in range(100)] + [(2, 0, "user", "short"), (None, 0, "user", "x")]
    table = spark.createDataFrame(rows, SCHEMA)
    parts = chat.format_chats(chat.as_log(table)).collect()
    assert sorted(r.part for r in parts if r.conv_id == 1) == list(range(7)) and len(parts) == 9
    got = {r.conv_id: r for r in chat.formatted(table).collect()}
    assert (got[1].n_turns, got[1].loss_sha256) == (100, sha("".join(f"text {t}" for t in range(1, 100, 2))))


def test_control_strings_never_show_and_come_back(spark):
    texts = [chat.QUOTED, "<s><s>", "[[INST]]", "<|turn|>", "␛", "␛[INST]", "[␛INST]", "<<SYS>><</SYS>>", "<|a<|end|>", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escaped(F.col("t")).alias("e")).select("*", chat.unescaped(F.col("e")).alias("back")).collect()
    for r in rows:
        assert r.back == r.t
        assert not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]", "<|", "<<SYS>>"))


def plain_fold(events):
    """Messages of one conversation from its events, one after the other."""
    state = {}
    for message, turn, seq, kind, role, text in sorted(events, key=lambda e: (e[0], e[2])):
        m = state.setdefault(message, {"turn": turn, "role": "", "text": "", "gone": False})
        m["role"] = role if role is not None else m["role"]
        if kind == "open":
            m["gone"] = False
        elif kind == "delta":
            m["text"] += text or ""
        elif kind in ("edit", "regenerate", "retract"):
            m["text"], m["gone"] = (text or "") if kind == "edit" else "", kind == "retract"
    return sorted((m["turn"], m["role"], m["text"]) for m in state.values() if not m["gone"])


def test_folding_events_equals_a_plain_loop(spark):
    rng, events = random.Random(3), []
    for c in range(40):
        for m in range(rng.randrange(1, 5)):
            kinds = ["open"] + [rng.choice(["delta", "delta", "delta", "edit", "regenerate", "retract", "open", None]) for _ in range(rng.randrange(12))]
            events += [(c, m, m // 2, s, k, "assistant" if k == "open" else None, None if k in ("open", "regenerate", "retract", None) or rng.random() < 0.1 else f"{k}{s} ") for s, k in enumerate(kinds)]
    rng.shuffle(events)
    log = spark.createDataFrame(events, "conv_id long, message long, turn long, seq long, kind string, role string, text string")
    got = {}
    for r in chat.fold(log).collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    want = {c: plain_fold([e[1:] for e in events if e[0] == c]) for c in range(40)}
    assert {c: sorted(v) for c, v in got.items()} == {c: v for c, v in want.items() if v}


def plain_tree(rows):
    own = {}
    for r in rows:
        if r[0] is not None:
            own.setdefault(r[0], []).append(r)
    # ties by the same hash as the operator's have no order to compare with: callers give none, or equal rows
    own = {c: [(r[2] or "", r[3] or "") for r in sorted(t, key=order)] for c, t in own.items()}
    paths = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        paths[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(tuple(p[:d]), []).append(c)
    children = {k: 0 for k in nodes}
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    ends = lambda k: sha(",".join(map(str, sorted(c for c in nodes[k] if len(paths[c]) == len(k)))))
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k], ends(k)) for k, m in nodes.items())


def untied(rows):
    """Rows without two different texts for one turn of a conversation."""
    seen = {}
    return [r for r in rows if seen.setdefault((r[0], r[1]), r) == r]


@pytest.mark.parametrize("light, shard, block, band", [(8192, 32768, 4096, 10**6), (20, 40, 3, 5), (3, 10, 1000, 1)])
def test_tree_equals_plain_loops(spark, monkeypatch, light, shard, block, band):
    for name, value in (("LIGHT", light), ("SHARD", shard), ("BLOCK", block), ("BAND", band)):
        monkeypatch.setattr(trie, name, value)
    rows = untied(conversations(2))
    long = [(700, t, "user", f"long {t}") for t in range(60)]  # and copies of it, which share all but their ends
    rows += long + [(c, *r[1:]) for c in range(701, 731) for r in long[: 60 - c % 3]]
    given = spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit(0), "depth": F.lit("x"), "block": F.lit(None)})
    got = sorted(tuple(-1 if x is None else x for x in r) for r in trie.conversation_tree(given).collect())
    assert got == plain_tree(rows)


def test_an_empty_table_has_no_tree(spark):
    assert trie.conversation_tree(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.conversation_tree(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(2**62), 2**62, (5000, 2)), axis=0)
    table = trie.SlotTable(keys)
    slots = table.slots(keys)
    assert sorted(slots) == list(range(len(keys))) and (table.keys[slots] == keys).all()
    assert (table.slots(keys + 1) == -1).all()
    assert len(trie.SlotTable(keys[:0]).slots(keys[:3])) == 3


def plain_manifest(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    low = lambda t: t if t is None else t.translate(str.maketrans(merkle.UPPER, merkle.LOWER))
    leaf = lambda r, text: sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))

    def climb(level, place):
        """The root over a level, and the siblings of a place on the way."""
        path = []
        while len(level) > 1:
            start = place - place % 8
            path.append((level[start:place], level[place + 1 : start + 8]))
            level, place = [sha("".join(level[k : k + 8])) for k in range(0, len(level), 8)], place // 8
        return level[0], path

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for x in langs]
    subroots = [climb([leaf(r, r[1]) for r in g], 0)[0] for g in groups]
    out = []
    for n, g in enumerate(groups):
        level = [leaf(r, r[1]) for r in g]
        for k, r in enumerate(g):
            path = climb(level, k)[1] + climb(subroots, n)[1]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf(r, low(r[1])) if tampered else level[k]
            for before, after in path:
                now = sha("".join(before) + now + "".join(after))
            root = climb(subroots, n)[0]
            out.append((r[0], level[k], subroots[n], root, sha("".join("".join(b + a) for b, a in path)), now, now == root))
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("n, langs", [(1, 1), (2, 1), (9, 2), (70, 3), (300, 20)])
def test_manifest_equals_plain_loops(spark, n, langs):
    rows = [(k * 7, f"Text {k} É🙂", f"l{k % langs}", "S", k) for k in range(n)]
    if n > 9:
        rows += [(None, None, None, None, None), (3, "", "", "", 0), (3, "", "", "", 0), (3, "TIE", "", "", 0), (-4, "A" * 100_000, "ü", None, 1), (None, "x", None, None, None)]
    given = spark.createDataFrame(rows, DOCS).withColumns({"grp": F.lit(1), "i": F.lit(2), "leaf": F.lit("z"), "_has": F.lit(True)})
    assert sorted(map(str, map(tuple, merkle.manifest(given).collect()))) == sorted(map(str, plain_manifest(rows)))
    assert merkle.manifest(given.limit(0)).count() == 0


def test_manifest_of_a_language_over_several_subtrees(spark):
    rows = [(k, f"Text {k}", "en" if k else "xx", "s", k) for k in range(4096 * 2 + 10)]
    assert sorted(map(str, map(tuple, merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()))) == sorted(map(str, plain_manifest(rows)))


def test_layout_is_a_permutation_that_keeps_subtrees_together():
    for levels in range(1, 6):
        every = np.concatenate([merkle.address(levels, d, np.arange(8**d)) for d in range(levels)])
        assert sorted(every.tolist()) == list(range(merkle.tree_size(levels)))
    low = [merkle.address(4, 2, np.array([5])), merkle.address(4, 3, np.arange(40, 48))]
    assert np.ptp(np.concatenate(low)) == merkle.tree_size(2) - 1
