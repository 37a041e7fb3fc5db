"""Running sums and samples over a global order without a task that holds everything."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.session import written

#: Digits of the hash by which samples are narrowed: 4,096 counts reach the driver.
PREFIX = 3


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """rows with columns of inclusive running sums in a unique order within each group of the columns `by`.

    Rows are dealt into ranges of the order and written; each range sums its own rows, and the totals of the ranges before
    it, a row for each range, are added. Null groups are groups of their own.
    """
    keys = [F.col(c) for c in by]
    dealt = written(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_range").alias("_at"), F.count(F.lit(1)).over(before).alias("_earlier"), *[F.sum(f"_{n}").over(before).alias(f"_{n}") for n in sums])
    starts = starts.where("_earlier > 0")  # groups that go on from an earlier range: at most one for each range
    same = F.col("_range") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select("*", *[F.sum(c).over(inside).alias(f"_own_{n}") for n, c in sums.items()])
    both = local.join(F.broadcast(starts), same, "left")
    return both.select(*rows.columns, *[(F.col(f"_own_{n}") + F.coalesce(F.col(f"_{n}"), F.lit(0))).alias(n) for n in sums])


#: Bins into which `percentiles` cuts each group's range of values.
BINS = 4096


def percentiles(rows: DataFrame, by: tuple[str, ...], value: str, p: float, name: str) -> DataFrame:
    """Each group's value (long) at the nearest rank of the share p, exact; null for groups without a value.

    A group's range of values is cut into BINS; counts by bin, combined before their shuffle, say which bin holds the rank; its rows
    alone go on to the next pass. No task ever holds more of a group than counts of bins, or of the
    distinct values of one bin. Ranges up to 16 million (BINS squared) take two passes, each further one multiplies that by BINS.
    """
    if not 0 < p <= 1:
        raise ValueError("p must lie above 0 and at most at 1")
    keys, x = list(by), F.col(value)
    of = lambda df: df.select(*[F.col(c).alias(f"_of_{c}") for c in keys], *[c for c in df.columns if c not in keys])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    whole = rows.groupBy(*keys).agg(F.count(value).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    state = written(whole.withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(Decimal(str(p)))))).drop("_n"), "ranges")
    while state.agg(F.max(F.col("_hi") - F.col("_lo"))).first()[0]:
        width = F.expr(f"(_hi - _lo) div {BINS}L + 1")
        inside = rows.select(*keys, value).join(of(state.where("_hi > _lo")), same).where(x.between(F.col("_lo"), F.col("_hi")))
        counts = inside.groupBy(*keys, F.expr(f"({value} - _lo) div ((_hi - _lo) div {BINS}L + 1)").alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
        upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        ranked = of(counts.withColumn("_upto", F.sum("_c").over(upto)))
        # the group's first bin that reaches the rank: the one whose counts before stay below it
        hit = state.where("_hi > _lo").join(ranked, same).where("_upto >= _rank AND _upto - _c < _rank")
        lo = F.col("_lo") + F.col("_bin") * width
        narrowed = hit.select(*keys, lo.alias("_lo"), F.least(F.col("_hi"), lo + width - 1).alias("_hi"), (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"))
        state = written(state.where("_lo = _hi OR _lo IS NULL").select(*keys, "_lo", "_hi", "_rank").unionByName(narrowed), "ranges")
    return state.select(*keys, F.col("_lo").cast("long").alias(name))


def hash_of_id() -> Column:
    return F.md5(F.col("id").cast("string").cast("binary"))


def first_by_hash(rows: DataFrame, n: int) -> DataFrame:
    """n rows in the order of a hash of their id: a reproducible uniform sample.

    Rows are counted by the first digits of the hash; those beyond the digits that hold the n-th row never reach the sort.
    """
    prefix = F.substring(hash_of_id(), 1, PREFIX)
    counts = sorted(rows.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    seen, last = 0, ""
    for p, k in counts:
        seen, last = seen + k, p
        if seen >= n:
            break
    return rows.withColumn("_h", hash_of_id()).where(F.substring("_h", 1, PREFIX) <= last).orderBy("_h", "id").limit(n).drop("_h")
