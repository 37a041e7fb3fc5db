"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions only.

Documents fall into cells of source, language and topic. The cells' token weights are raked, one margin after the
other, until the sums over each source, language and topic have the target shares. The raked weights become
sampling probabilities by one scale for all cells: the largest at which no probability exceeds 1, and the expected tokens
do not exceed the budget. So no cell is cut off, and the expected sample has the raked shares in every margin.

The topic of a document is the form of its text (prose, markup, list, shouting, data), told by character counts.
Targets: in each margin, a value's share of tokens to the margin's power, made to sum to 1. By default every source has
the same share (power 0), languages and topics the square root of theirs. The further the targets are from the shares that
the documents have, the smaller the sample that can meet them: the rarest tokens bound it.

Edge cases: a null source or language is a value of its own ('' after coalescing); null and empty texts and
texts of blanks have no tokens, fall in topic 'empty', have weight 0 and are sampled with probability 1, as they cost nothing
(texts of other white space share their cell's fate, or that of 'empty' if the cell has no tokens); the draw is
a hash of the doc_id (null as ''), so repeated rows share a fate; an empty table gives an empty table; input
columns whose names clash with the result's are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import WORD, written

SWEEPS = 12
#: The most tokens that a sample may have, of all. With targets far from the documents' shares the rarest tokens bound it much earlier,
#: as no document is drawn twice.
SHARE = 0.7
MARGINS = ("source", "lang", "topic")
#: Powers of the token shares that give the targets of MARGINS.
POWERS = (0.0, 0.5, 0.5)
#: Cells that one task rakes without a shuffle. More of them (a source for each host, say) are raked by sums of each margin, joined
#: back, wherever they lie; the weights are the same.
ONE_TASK = 1_000_000


def n_tokens() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def topic() -> Column:
    t = F.coalesce("text", F.lit(""))
    symbols, bars = _without(t, "#*$%&"), _without(t, "|")
    upper, lower = _without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _without(t, "abcdefghijklmnopqrstuvwxyz")
    digits = _without(t, "0123456789")
    return (
        F.when(F.length(F.trim(t)) == 0, "empty")
        .when(symbols * 20 > F.length(t), "markup")
        .when(bars * 20 > F.length(t), "list")
        .when(upper > lower, "shouting")
        .when(digits * 50 > F.length(t), "data")
        .otherwise("prose")
    )


def _units(docs: DataFrame) -> DataFrame:
    filled = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("source", "lang")]
    return docs.select("doc_id", *filled, topic().alias("topic"), n_tokens().alias("n_tokens"))


def _fitted(held: DataFrame, margin: str, small: bool) -> DataFrame:
    """held with its weights scaled to the targets of a margin."""
    if small:
        return held.withColumn("weight", F.col("weight") * F.col(f"to_{margin}") / F.sum("weight").over(Window.partitionBy(margin)))
    sums = held.groupBy(margin).agg(F.sum("weight").alias("_sum"))
    return held.join(sums, margin).withColumn("weight", F.col("weight") * F.col(f"to_{margin}") / F.col("_sum")).drop("_sum")


def raked_cells(units: DataFrame, sweeps: int = SWEEPS, share: float = SHARE, powers: tuple[float, ...] = POWERS, one_task: int = ONE_TASK) -> DataFrame:
    """source, lang, topic, cell_tokens, weight (share of the mixture), probability of every cell with tokens.

    The cells are a table of distinct source, language and topic: small beside the documents, but never collected. Up to one_task of them
    lie in one partition, where each margin is a window without a shuffle; more stay in many, and a margin's sums, combined
    before their shuffle, are joined back. The table is written after every third sweep, or every one of many, so that plans stay short.
    """
    cells = units.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("cell_tokens")).where("cell_tokens > 0")
    cells = written(cells, "cells")
    small = cells.count() <= one_task
    near = lambda df: df.coalesce(1) if small else df
    total = cells.agg(F.sum("cell_tokens").alias("_total"))
    held = cells.crossJoin(F.broadcast(total)).withColumn("weight", F.col("cell_tokens") / F.col("_total")).drop("_total")  # one row
    for margin, power in zip(MARGINS, powers, strict=True):
        raised = cells.groupBy(margin).agg(F.pow(F.sum("cell_tokens").cast("double"), F.lit(power)).alias("_r"))
        whole = F.broadcast(raised.agg(F.sum("_r").alias("_all")))  # one row
        held = held.join(raised.crossJoin(whole).select(margin, (F.col("_r") / F.col("_all")).alias(f"to_{margin}")), margin)
    held = near(written(held, "margins"))
    for sweep in range(sweeps):
        for margin in MARGINS:
            held = _fitted(held, margin, small)
        if sweep % 3 == 2 or not small:
            held = near(written(held, "raked"))
    ratio = F.col("weight") / F.col("cell_tokens")
    bounds = F.broadcast(held.agg((share * F.sum("cell_tokens")).alias("_most"), (1.0 / F.max(ratio)).alias("_scale")))  # one row
    priced = held.crossJoin(bounds).withColumn("probability", F.least(F.lit(1.0), F.least("_most", "_scale") * ratio))
    return written(priced.select(*MARGINS, "cell_tokens", "weight", "probability"), "mixture")


def draw() -> Column:
    """A uniform number in [0, 1) from the doc_id."""
    digits = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def mixture(docs: DataFrame, sweeps: int = SWEEPS, share: float = SHARE, powers: tuple[float, ...] = POWERS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, sampled for every row of docs.

    Each text is read and counted once: what the cells and the result need of it is written.
    """
    units = written(_units(docs), "units")
    cells = raked_cells(units, sweeps, share, powers).drop("cell_tokens")
    return _decided(units.join(cells, list(MARGINS), "left")).select(
        "doc_id", *MARGINS, "n_tokens", F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"), "sampled"
    )


def _decided(joined: DataFrame) -> DataFrame:
    filled = joined.withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return filled.withColumn("sampled", draw() < F.col("probability"))


def sample(docs: DataFrame, sweeps: int = SWEEPS, share: float = SHARE, powers: tuple[float, ...] = POWERS) -> DataFrame:
    """The rows of docs that the mixture samples, with the columns of docs. Each text is read and counted once: docs are
    written with their cells."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")]
    keyed = written(docs.select(row, "doc_id", *filled, topic().alias("topic"), n_tokens().alias("n_tokens")), "units")
    cells = raked_cells(keyed, sweeps, share, powers).drop("cell_tokens")
    return _decided(keyed.join(cells, list(MARGINS), "left")).where("sampled").select("row.*")


def achieved(mixed: DataFrame) -> DataFrame:
    """margin, value, share of the raked weights, expected and sampled share of tokens, from the rows of mixture."""
    cells = mixed.where("n_tokens > 0").groupBy(*MARGINS).agg(
        F.max("weight").alias("weight"), F.sum(F.col("n_tokens") * F.col("probability")).alias("e"), F.sum(F.when(F.col("sampled"), F.col("n_tokens")).otherwise(0)).alias("s")
    )
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("value")) for m in MARGINS]))
    sums = cells.select(each.alias("m"), "weight", "e", "s").groupBy("m.margin", "m.value").agg(F.sum("weight").alias("raked"), F.sum("e").alias("e"), F.sum("s").alias("s"))
    every = Window.partitionBy("margin")
    return sums.select("margin", "value", "raked", (F.col("e") / F.sum("e").over(every)).alias("expected"), (F.col("s") / F.sum("s").over(every)).alias("sampled"))


def oracle(sweeps: int = SWEEPS, share: float = SHARE, powers: tuple[float, ...] = POWERS) -> str:
    """DuckDB SQL for mixture(documents): one CTE for each sweep and margin."""
    steps = []
    last = "w0"
    for k in range(sweeps):
        for m in MARGINS:
            name = f"w{k}{m}"
            steps.append(f"{name} AS (SELECT * REPLACE (weight * to_{m} / sum(weight) OVER (PARTITION BY {m}) AS weight) FROM {last})")
            last = name
    targets = [
        f", (SELECT power(sum(cell_tokens), {p}) FROM c x WHERE x.{m} = c.{m}) / (SELECT sum(r) FROM (SELECT power(sum(cell_tokens), {p}) AS r FROM c GROUP BY {m})) AS to_{m}"
        for m, p in zip(MARGINS, powers, strict=True)
    ]
    strip = lambda chars: f"(length(t) - length(regexp_replace(t, '[{chars}]', '', 'g')))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
u AS (SELECT doc_id, source, lang, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
      CASE WHEN length(trim(t, ' ')) = 0 THEN 'empty' WHEN {strip("#*$%&")} * 20 > length(t) THEN 'markup'
           WHEN {strip("|")} * 20 > length(t) THEN 'list' WHEN {strip("A-Z")} > {strip("a-z")} THEN 'shouting'
           WHEN {strip("0-9")} * 50 > length(t) THEN 'data' ELSE 'prose' END AS topic FROM d),
c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS cell_tokens FROM u GROUP BY ALL HAVING sum(n_tokens) > 0),
w0 AS MATERIALIZED (SELECT c.*, cell_tokens / (SELECT sum(cell_tokens) FROM c) AS weight{"".join(targets)} FROM c),
{", ".join(steps)},
m AS (SELECT source, lang, topic, weight, least(1.0, weight / cell_tokens * least({share} * sum(cell_tokens) OVER (), 1.0 / max(weight / cell_tokens) OVER ())) AS probability FROM {last}),
r AS (SELECT doc_id, u.source, u.lang, u.topic, n_tokens, coalesce(weight, 0.0) AS weight, coalesce(probability, 1.0) AS probability
      FROM u LEFT JOIN m ON u.source = m.source AND u.lang = m.lang AND u.topic = m.topic)
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 9) AS weight, round(probability, 9) AS probability,
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / {1 << 52} < probability AS sampled FROM r
"""
