"""Language identification by hierarchical discrimination.

Character two- and three-grams of the whole text, hashed into a fixed vector, go through two levels: a
multinomial regression tells the language family, then one-versus-one linear support vector machines tell the
languages of that family apart by vote. Both levels are fitted by Spark ML on a bounded sample of labelled rows
(at most PER_LANGUAGE documents a language, taken by hash); the fitted weights are a few arrays that prediction
carries into every task.

Learning uses text and non-null lang of documents whose crc32(doc_id as text) mod 3 is not 1 and nothing else.

Edge cases: a null text, or one without a letter, is `und` with score 0; so is everything if nothing could be
learned (an empty table). With one learned language, that language is the answer, score 1. Rows with a null
doc_id are predicted but not learned from (held_out false). Repeated rows give repeated results. Other columns
are ignored, except by `labelled`, which keeps them whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm.common import spare, written

DIM = 2048
#: The bound of the training sample: documents of each language.
PER_LANGUAGE = 800
UNDETERMINED = "und"
#: Languages that are learned, those with the most documents, and the fewest documents of one. A family's languages are told apart in pairs, so
#: the fits grow with their square.
MOST_LANGUAGES, LEAST_DOCUMENTS = 64, 3
#: Families of closely related languages. A language that is not here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "cy", "gd", "br"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "semitic": ("ar", "he", "mt"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "gu", "pa", "ne"),
}


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), f"={lang}")


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of hashed character two- and three-grams; None if there is no letter."""
    x = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[x]
    if not letter.any():
        return None
    x = np.where(letter, x, np.uint32(32))
    # one blank on either side of each run of letters
    keep = letter | np.concatenate([[True], letter[:-1]])
    x = np.concatenate([[32], x[keep], [32]]).astype(np.uint32)
    a, b, c = x[:-2], x[1:-1], x[2:]
    two = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    three = two + c * np.uint32(0xC2B2AE3D)
    total = np.zeros(DIM)
    for h in (two, three):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        total += np.bincount((h >> np.uint32(12)) & np.uint32(DIM - 1), minlength=DIM)
    total = np.sqrt(total)
    return total / np.linalg.norm(total)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _features(text: pd.Series) -> pd.Series:
    return pd.Series([None if (v := features(t)) is None else v.astype(np.float32) for t in text])


@dataclass
class LanguageModel:
    """families: names; family_w, family_b: their regression; pairs: (lang if > 0, lang if < 0, weights, bias)."""

    families: list[str] = field(default_factory=list)
    family_w: np.ndarray | None = None
    family_b: np.ndarray | None = None
    languages: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[str, list[tuple[str, str, np.ndarray, float]]] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        v = features(text) if self.families else None
        if v is None:
            return UNDETERMINED, 0.0
        share, family = 1.0, self.families[0]
        if len(self.families) > 1:
            z = self.family_w @ v + self.family_b
            p = np.exp(z - z.max())
            p /= p.sum()
            family, share = self.families[int(p.argmax())], float(p.max())
        votes = dict.fromkeys(self.languages[family], 0.0)
        for one, other, w, b in self.pairs[family]:
            p = 1 / (1 + np.exp(-2 * float(np.clip(w @ v + b, -20, 20))))
            votes[one] += p
            votes[other] += 1 - p
        best = max(sorted(votes), key=votes.get)
        return best, float(np.clip(share * (votes[best] / max(1, len(votes) - 1) if len(votes) > 1 else 1.0), 0, 1))


def held_out() -> Column:
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    return F.coalesce(rest == 1, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, features) of at most per_language documents a language, the first by a hash of their id. The MOST_LANGUAGES languages
    with the most documents, of those with LEAST_DOCUMENTS or more, are learned; a column full of junk has no other effect."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    usable = docs.where((rest != 1) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    order = F.xxhash64(F.lit("sample"), "doc_id")
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    counts = F.broadcast(written(counts.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES), "languages"))  # so many rows at most
    # twice the share that is needed passes by hash before anything is moved; the window then meets a bounded rest
    thin = usable.join(counts, "lang").where(F.pmod(order, F.lit(1_000_000)) * F.col("n") < 2_000_000 * per_language)
    first = Window.partitionBy("lang").orderBy(F.pmod(order, F.lit(1_000_000)), "doc_id", F.xxhash64("text"))
    return thin.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language).select("lang", _features("text").alias("x")).where("x IS NOT NULL")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    sample = written(training_sample(docs, per_language), "sample").cache()  # bounded by per_language; every fit reads it
    langs = sorted(r.lang for r in sample.select("lang").distinct().collect())
    model = LanguageModel(families=sorted({family_of(x) for x in langs}))
    model.languages = {f: [x for x in langs if family_of(x) == f] for f in model.families}

    def labelled(index: dict[str, int]) -> DataFrame:
        number = F.create_map(*[F.lit(x) for kv in index.items() for x in kv])
        rows = sample.where(F.col("lang").isin(list(index)))
        return rows.select(number[F.col("lang")].cast("double").alias("label"), array_to_vector("x").alias("features"))

    if len(model.families) > 1:
        lr = LogisticRegression(maxIter=25, regParam=1e-4, standardization=False, family="multinomial")
        m = lr.fit(labelled({x: model.families.index(family_of(x)) for x in langs}))
        model.family_w, model.family_b = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
    for f, own in model.languages.items():
        model.pairs[f] = []
        for one, other in combinations(own, 2):
            m = LinearSVC(maxIter=25, regParam=1e-4, standardization=False).fit(labelled({one: 1, other: 0}))
            model.pairs[f].append((one, other, m.coefficients.toArray(), float(m.intercept)))
    sample.unpersist()
    return model


def guess(model: LanguageModel, text: str | Column = "text") -> Column:
    """struct(lang, score) of a text."""

    @F.pandas_udf(T.StructType().add("lang", T.StringType()).add("score", T.DoubleType()))
    def told(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in text], columns=["lang", "score"])

    return told(text)


def labelled(docs: DataFrame, model: LanguageModel, least_score: float = 0.5) -> DataFrame:
    """The rows of docs whose language can be told, lang being the prediction, all columns kept.

    Rows without a letter or with an even guess (a score below least_score) go. If the model has learned nothing (no row of
    docs had a language), nothing can be told apart: then all rows stay as they are.
    """
    if not model.families:
        return docs
    name = spare(docs, "_guess")
    told = docs.withColumn(name, guess(model)).where((F.col(f"{name}.lang") != UNDETERMINED) & (F.col(f"{name}.score") >= least_score))
    kind = docs.schema["lang"].dataType
    return told.select(*[F.col(f"{name}.lang").cast(kind).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs (doc_id, text, lang)."""
    told = docs.select("doc_id", guess(fit(docs, per_language)).alias("g"))
    return told.select("doc_id", held_out().alias("held_out"), F.col("g.lang").alias("lang_pred"), F.col("g.score").alias("score"))
