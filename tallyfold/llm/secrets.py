"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Beside the patterns, every run of SHORTEST or more letters, digits, + / _ - = is tested; where a pattern's match lies in a
run, every such piece before and after it. What the patterns match is tested, too, but reported whatever comes out.

From its characters a run's encoding is inferred, and with it an alphabet whose symbols have values. Three tests take it
for drawn by chance from that alphabet: chi-squared of the symbols' counts against equal ones, Wald and Wolfowitz's runs
of values in the lower and the upper half, and serial correlation of neighbouring values. Fisher's method joins their
p-values; a run that chance alone would hardly give (below CHANCE: words, paths, counting sequences) is no secret.

What passes must also be unlike written language. Its evidence is a p-value, too: of counts as even as these, of changes
between classes of characters and of the order of vowels, if the run were language. Here discoveries are controlled by
length: in each length class, the largest threshold t with t <= rate * (runs with p <= t) / (runs tested) holds (Benjamini
and Hochberg). For that, the p-values of all documents are counted in bins: a bounded table is all the driver sees.

SHORTEST is 20: twenty symbols of base64 are 120 random bits, and shorter runs of language and of chance overlap in all
these tests. Runs of one case of letters, and of digits alone, are told from language only when they are far longer.

Edge cases: null is as empty; spans are in code points, end exclusive; without spans the lists are empty strings;
repeated rows, null ids and clashing columns are as in the input; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm.common import written

KINDS = ("assign", "access", "hex", "random")
_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_KEYS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile(rf"({'|'.join(_either(k) for k in _KEYS)})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
SHORTEST = 20
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
_HAS_KEY = ("passw", "secret", "token", "api")
#: Rate of false discoveries in each length class; p-values are binned by tenths of their negative decimal logarithm.
RATE, BINS = 0.005, 600
#: A run that uniform chance gives this rarely is not taken for random; so many of the random ones are lost.
CHANCE = 1e-4
#: Sums of squared and cubed shares of letters in written language, change of class between neighbours,
#: and mean serial correlation of vowels.
EVENNESS, CUBES, CLASS_CHANGE, VOWELS = 0.066, 0.0058, 0.06, -0.3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches."""
    out = []
    low = text.lower()
    if any(k in low for k in _HAS_KEY):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def alphabet(run: str) -> str:
    """The symbols of the inferred encoding in the order of their values: decimal, hex, base32, one or both cases of letters
    without or with digits, base64, base64 for addresses."""
    digit, lower, upper = (bool(re.search(c, run)) for c in ("[0-9]", "[a-z]", "[A-Z]"))
    if re.fullmatch("[0-9]+", run):
        return _DIGITS
    if re.fullmatch("[0-9a-f]+", run):
        return _DIGITS + _LOWER[:6]
    if re.fullmatch("[0-9A-F]+", run):
        return _DIGITS + _UPPER[:6]
    if digit and re.fullmatch("[A-Z2-7]+", run):
        return _UPPER + _DIGITS[2:8]
    if re.search("[-_]", run):
        return _UPPER + _LOWER + _DIGITS + "-_" + ("+/" if re.search("[+/]", run) else "")
    if re.search("[+/]", run):
        return _UPPER + _LOWER + _DIGITS + "+/"
    return (_UPPER if upper else "") + (_LOWER if lower else "") + (_DIGITS if digit else "")


def battery(run: str) -> tuple[int, float, float, float]:
    """Size of the run's alphabet, and the two-sided p-values of its three tests (chi-squared, runs, serial correlation) if its
    symbols were drawn evenly and independently. Padding and other foreign characters are left out."""
    symbols = alphabet(run)
    value = {c: k for k, c in enumerate(symbols)}
    x = np.array([value[c] for c in run if c in value])
    n, k = len(x), len(symbols)
    if n < 2 or k < 2:
        return k, 0.0, 0.0, 0.0
    chi = k / n * float((np.bincount(x, minlength=k).astype(float) ** 2).sum()) - n
    # Wilson and Hilferty: the cube root of a chi-squared variable is nearly normal
    above = _normal_tail(((chi / (k - 1)) ** (1 / 3) - 1 + 2 / (9 * (k - 1))) / math.sqrt(2 / (9 * (k - 1))))
    high = 2 * x >= k
    share, runs = (k + 1) // 2 / k, 1 + int((high[1:] != high[:-1]).sum())
    change = 2 * share * (1 - share)
    spread = math.sqrt(max(1e-12, (n - 1) * change * (1 - change) + 2 * (n - 2) * (share * (1 - share) - change * change)))
    odd = abs(runs - 1 - (n - 1) * change) / spread
    y = x - x.mean()
    total = float((y * y).sum())
    serial = (float((y[1:] * y[:-1]).sum()) / total + 1 / n) * math.sqrt(n) if total else math.inf
    return k, min(1.0, 2 * min(above, 1 - above)), 2 * _normal_tail(odd), 2 * _normal_tail(abs(serial))


def joint(p: tuple[float, ...]) -> float:
    """Fisher's joint probability of three independent p-values: a chi-squared law of 6 degrees."""
    s = -sum(math.log(max(v, 1e-300)) for v in p)
    return math.exp(-s) * (1 + s + s * s / 2)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def log_p(run: str) -> float:
    """Negative decimal logarithm of the joint probability of so even counts, so many changes of class and so unordered
    vowels, if the run were language."""
    n = len(run)
    counts = np.bincount(np.frombuffer(run.encode(), np.uint8))
    squares = float((counts.astype(float) ** 2).sum())
    mean, spread = n + n * (n - 1) * EVENNESS, math.sqrt(4 * n**3 * (CUBES - EVENNESS**2) + 2 * n**2 * EVENNESS)
    p = [_normal_tail((mean - squares) / spread)]
    kind = np.array([0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in run])
    kind = kind[kind < 3]  # marks between words say nothing
    changes, expected = int((kind[1:] != kind[:-1]).sum()), max(1, len(kind) - 1) * CLASS_CHANGE
    p.append(min(1.0, math.exp(changes - expected) * (expected / changes) ** changes) if changes > expected else 1.0)  # Chernoff's bound
    vowel = np.array([c in "aeiouyAEIOUY" for c in run], float)
    x = vowel - vowel.mean()
    serial = float((x[1:] * x[:-1]).sum() / (x * x).sum()) if x.any() else 0.0
    p.append(_normal_tail((serial - VOWELS) * math.sqrt(n)))
    s = -sum(math.log(max(v, 1e-300)) for v in p)
    return max(0.0, s - math.log(1 + s + s * s / 2)) / math.log(10)


def length_class(n: int) -> int:
    return int(math.log2(n) * 2)


def free_runs(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs, or of what is left of them between the patterns' matches."""
    for m in RUN.finditer(text):
        at, end = m.span()
        pieces = []
        for s, _, e in base:
            if s < end and at < e:
                pieces.append((at, s))
                at = e
        yield from ((s, e) for s, e in [*pieces, (at, end)] if e - s >= SHORTEST)


def _value(text: str, span: tuple[int, int, int]) -> tuple[int, int]:
    """Where the secret itself lies in a pattern's match: after the name, for assignments."""
    start, kind, end = span
    m = ASSIGN.match(text, start) if kind == 0 else None
    return m.span(2) if m else (start, end)


def tested_runs(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple]:
    """(start, end, length class, bin of language's p-value, whether it is a pattern's, alphabet, p-values of the battery) of
    the free runs and of the patterns' values. The bin is -1 where chance is ruled out."""
    tested = [(s, e, False) for s, e in free_runs(text, base)] + [(*_value(text, s), True) for s in base]
    for s, e, known in tested:
        k, *p = battery(text[s:e])
        b = min(BINS, int(10 * log_p(text[s:e]))) if joint(tuple(p)) >= CHANCE else -1
        yield s, e, length_class(e - s), b, known, k, *p


_SPAN = T.StructType().add("start", T.LongType()).add("kind", T.IntegerType()).add("end", T.LongType())
_RUN = T.StructType().add("start", T.LongType()).add("end", T.LongType()).add("length", T.IntegerType()).add("bin", T.IntegerType()).add("known", T.BooleanType())
_RUN = _RUN.add("alphabet", T.IntegerType()).add("p_uniform", T.DoubleType()).add("p_runs", T.DoubleType()).add("p_serial", T.DoubleType())


@F.pandas_udf(T.StructType().add("base", T.ArrayType(_SPAN)).add("runs", T.ArrayType(_RUN)))
def _scan(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        base = base_spans(t or "")
        rows.append(([dict(zip(_SPAN.names, s, strict=True)) for s in base], [dict(zip(_RUN.names, r, strict=True)) for r in tested_runs(t or "", base)]))
    return pd.DataFrame(rows, columns=["base", "runs"])


def thresholds(scanned: DataFrame, rate: float = RATE) -> dict[int, int]:
    """For each length class the lowest bin that is a discovery. scanned: column runs, of which the free ones count. At most
    classes times bins rows reach the driver."""
    counts: dict[int, dict[int, int]] = {}
    table = scanned.select(F.explode(F.filter("runs", lambda r: ~r["known"])).alias("r")).groupBy("r.length", "r.bin").agg(F.count(F.lit(1)).alias("n"))
    for r in table.collect():
        counts.setdefault(r.length, {})[r.bin] = r.n
    out = {}
    for length, bins in counts.items():
        tested, above = sum(bins.values()), 0
        for b in sorted((b for b in bins if b >= 0), reverse=True):
            above += bins[b]
            if 10 ** (-b / 10) <= rate * above / tested:
                out[length] = b
    return out


def _found(limits: dict[int, int]) -> Column:
    """Spans of the discovered runs among column runs."""

    def discovered(r: Column) -> Column:
        limit = F.lit(BINS + 1)
        for length, b in limits.items():
            limit = F.when(r["length"] == length, b).otherwise(limit)
        return ~r["known"] & (r["bin"] >= limit)

    kept = F.filter("runs", discovered)
    return F.transform(kept, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans, tests for every row of docs (doc_id, text).

    tests: start:end:alphabet:p:p:p of everything tested, the p-values being those of the battery.
    """
    found = written(docs.select("doc_id", _scan("text").alias("s")).select("doc_id", "s.base", "s.runs"), "scanned")
    every = F.array_sort(F.concat("base", _found(thresholds(found, rate))))
    counted = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    shown = lambda r: F.format_string("%d:%d:%d:%.2g:%.2g:%.2g", *[r[c] for c in ("start", "end", "alphabet", "p_uniform", "p_runs", "p_serial")])
    return found.select(
        "doc_id",
        *[counted(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        (F.size(every) - F.size("base")).cast("long").alias("n_random"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(every).alias("spans"),
        F.array_join(F.transform("runs", shown), ",").alias("tests"),
    )


def redact(docs: DataFrame, rate: float = RATE, mark: str = "[secret]") -> DataFrame:
    """docs with every span in text replaced by mark; all rows and columns stay, n_chars follows the text if there is one.

    Each text is searched once: docs are written with what was found, and then cut.
    """
    seen = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _scan("text").alias("s")), "scanned")
    seen = seen.select("row", "s.base", "s.runs")
    every = F.array_sort(F.concat("base", _found(thresholds(seen, rate))))

    @F.pandas_udf(T.StringType())
    def cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for t, start, end in zip(text, starts, ends, strict=True):
            parts, at = [], 0
            for s, e in zip(start, end, strict=True):
                if s >= at:
                    parts += [t[at:s], mark]
                at = max(at, e)
            out.append("".join(parts) + t[at:] if len(start) else t)
        return pd.Series(out, dtype=object)

    text = cut(F.col("row.text"), F.transform(every, lambda s: s["start"]), F.transform(every, lambda s: s["end"]))
    changed = seen.select("row", text.alias("text"))
    kinds = {f.name: f.dataType for f in docs.schema}
    made = {"text": F.col("text"), "n_chars": F.length("text").cast(kinds["n_chars"]) if "n_chars" in kinds else None}
    return changed.select(*[(made[c] if c in made else F.col("row")[c]).alias(c) for c in docs.columns])
