"""Exact token counts of every prefix, by dynamic programming over byte-pair tokens.

A token sequence is the encoding of its bytes exactly if every two neighbours are: the pair's own encoding is the
pair. So the encoding of a prefix is the encoding of a shorter prefix plus one token that fits its last one, and
one pass over a piece of text gives the count of all its prefixes. Counts are kept as one signed byte per code
point (the change against the prefix before), so questions of truncation and budget are sums over stored bytes.

Pieces are those of the byte-level pattern that the vocabulary file's library uses. A prefix may be cut into other
pieces than the whole: where it ends after a run of white space, or inside a contraction. Both are corrected.

Edge cases: null is as empty, with count 0 and an empty table of prefixes; the special string in a text is one token,
as the library has it by default; repeated rows, null ids and clashing columns are as in the input; an empty table
gives an empty table.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm.common import spare

#: Fixed value: how byte-level byte-pair vocabularies of this kind cut text into pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_RUNS = regex.compile(r"\s{2,}(?=\S)")
#: Pieces and prefixes held by a worker, and the longest piece that is held; beyond them, counts are made anew each time.
HELD, STATES, LONGEST_HELD = 250_000, 200_000, 40


def _byte_letters() -> dict[str, int]:
    """The vocabulary file's letters for bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"])
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.specials = [t["content"] for t in file["added_tokens"]]
        special = set(self.specials)
        # how each token comes about: the last merge, and its place in the order of merges
        self.made = {a + b: (k, a, b) for (a, b), k in reversed(self.rank.items())}
        # what a token can end with: true for tokens, false for mere ends; a token whose own bytes encode to
        # something else never comes up
        tokens = {t for t in map(raw, (v for v in file["model"]["vocab"] if v not in special)) if self.encode(t) == [t]}
        self.ends = {t[k:]: False for t in tokens for k in range(1, len(t))} | dict.fromkeys(tokens, True)
        #: For prefixes of pieces, the token count and last token of each of their prefixes, and perhaps of longer ones.
        self.states: dict[bytes, list[tuple[int, bytes]]] = {}
        self.edges: dict[tuple[bytes, bool], list[tuple[bytes, int]]] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.held: dict[str, bytes] = {}

    def encode(self, data: bytes) -> list[bytes]:
        """Plain byte-pair merging."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            k, at = min((self.rank.get((parts[i], parts[i + 1]), 1 << 30), i) for i in range(len(parts) - 1))
            if k == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """The parts that lie at a token's right (or left) end while it is merged, each with the place of the merge that uses it up."""
        known = self.edges.get((token, right))
        if known is None:
            known, part, until = [], token, 1 << 30
            while True:
                known.append((part, until))
                if len(part) == 1:
                    break
                until, a, b = self.made[part]
                part = b if right else a
            self.edges[token, right] = known
        return known

    def pair_fits(self, a: bytes, b: bytes) -> bool:
        """Whether a, b is the encoding of their bytes: no two parts at the seam would merge while both are there.
        Of equal merges the leftmost comes first, so one at the seam comes before one to its right only."""
        known = self.fits.get((a, b))
        if known is None:
            rank, known = self.rank, True
            for x, x_until in self.edge(a, True):
                for y, y_until in self.edge(b, False):
                    k = rank.get((x, y))
                    if k is not None and k < x_until and k <= y_until:
                        known = False
            if len(self.fits) < HELD:
                self.fits[a, b] = known
        return known

    def byte_counts(self, data: bytes) -> list[int]:
        """The token count of every prefix of a piece, by bytes; from the empty one."""
        states, ends, fits, known = self.states, self.ends.get, self.fits.get, self.pair_fits
        n, row, low, high = len(data), [(0, b"")], 0, len(data)
        while low < high:  # the longest prefix met before: all of its own prefixes were met, too
            half = (low + high + 1) // 2
            met = states.get(data[:half])
            if met is None:
                high = half - 1
            else:
                low, row = half, met
        row = row[: low + 1]
        room = len(states) < STATES and n <= LONGEST_HELD
        for i in range(len(row), n + 1):
            # the one token that ends here and fits the last token of the prefix before it
            for j in range(i - 1, -1, -1):
                t = data[j:i]
                whole = ends(t)
                if whole is None:
                    raise ValueError("a byte without a token")
                if whole:
                    c, before = row[j]
                    fit = not before or fits((before, t))
                    if fit is None:
                        fit = known(before, t)
                    if fit:
                        row.append((c + 1, t))
                        if room:
                            states[data[:i]] = row
                        break
        return [c for c, _ in row]

    def changes(self, piece: str) -> bytes:
        """Change of the token count at each code point of a piece."""
        known = self.held.get(piece)
        if known is not None:
            return known
        data = piece.encode("utf-8", "surrogatepass")
        counts = self.byte_counts(data)
        if len(data) != len(piece):
            counts = [c for c, b in zip(counts, data, strict=False) if b & 0xC0 != 0x80] + counts[-1:]
        if piece in ("'re", "'ve", "'ll"):
            counts[2] = 2  # cut there, the apostrophe and the letter are pieces of their own
        out = bytes([(b - a) & 255 for a, b in zip(counts, counts[1:], strict=False)])
        if len(piece) <= LONGEST_HELD and len(self.held) < HELD:
            self.held[piece] = out
        return out

    def _plain(self, text: str) -> np.ndarray:
        changes = self.changes
        out = np.frombuffer(b"".join([changes(p) for p in PIECES.findall(text)]), np.int8).astype(np.int16)
        for run in _RUNS.finditer(text):
            # a prefix that ends with the whole run has it as one piece
            whole = run.group()
            at = run.end() - 1
            by = int(np.frombuffer(changes(whole), np.int8).sum() - np.frombuffer(changes(whole[:-1]), np.int8).sum()) - int(out[at])
            out[at] += by
            out[at + 1] -= by
        return out

    def text_changes(self, text: str) -> np.ndarray:
        """Change of the exact token count at each code point of a text (int16)."""
        special = next((s for s in self.specials if s in text), None)
        if special is None:
            return self._plain(text)
        parts, out = text.split(special), []
        for part in parts[:-1]:
            open_end = self._plain(part + special[:-1])
            closing = 1 - int(open_end[len(part) :].sum())
            out += [open_end, np.array([closing], np.int16)]
        return np.concatenate([*out, self._plain(parts[-1])])


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def packed(changes: np.ndarray) -> bytes:
    """Changes as bytes: their width in bytes, then each of them; one byte holds all but very rare texts."""
    width = 1 if not len(changes) or -128 <= changes.min() and changes.max() <= 127 else 4
    return bytes([width]) + changes.astype(f"<i{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1)


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_tokens and prefix_changes (binary, see packed: the change of the exact token count at each code point); columns
    of docs that have these names already, in any case of letters, are replaced."""

    @F.pandas_udf(T.StructType().add("n", T.LongType()).add("changes", T.BinaryType()))
    def count(text: pd.Series) -> pd.DataFrame:
        own = counter(path)
        rows = []
        for t in text:
            c = own.text_changes(t or "")
            rows.append((int(c.sum(dtype=np.int64)), packed(c)))
        return pd.DataFrame(rows, columns=["n", "changes"])

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_tokens", "prefix_changes")]
    own = spare(docs, "_t")
    return docs.withColumn(own, count("text")).select(*kept, F.col(f"{own}.n").alias("n_tokens"), F.col(f"{own}.changes").alias("prefix_changes"))


def tokens_at(changes: Column, chars: Column) -> Column:
    """The token count of the first `chars` code points, from prefix_changes."""

    @F.pandas_udf(T.LongType())
    def at(changes: pd.Series, chars: pd.Series) -> pd.Series:
        return pd.Series([int(unpacked(c)[: max(0, n)].sum(dtype=np.int64)) for c, n in zip(changes, chars, strict=True)])

    return at(changes, chars)


def chars_within(changes: Column, budget: int) -> Column:
    """The most code points from the start whose token count is at most budget, from prefix_changes."""

    @F.pandas_udf(T.LongType())
    def most(changes: pd.Series) -> pd.Series:
        out = []
        for c in changes:
            fits = np.flatnonzero(np.cumsum(unpacked(c), dtype=np.int64) <= budget)
            out.append(int(fits[-1]) + 1 if len(fits) else 0)
        return pd.Series(out, dtype="int64")

    return most(changes)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, limit_chars (the longest prefix of at most `limit` tokens, in code points)."""
    counted = prefix_table(docs.select("doc_id", "text"), path)
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select(
        "doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), chars_within(F.col("prefix_changes"), limit).alias("limit_chars")
    )
