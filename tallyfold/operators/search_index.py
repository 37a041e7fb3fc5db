"""Stored layouts for searches: three-gram lists of account names, and tables sorted by their paging key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.operators.lookups import PAGE_SIZE, paged, search_transactions

#: Partitions of the lists and of the rows by account; a search reads the few that its grams and accounts hash to.
LIST_PARTS, ROW_PARTS = 256, 1024
#: Accounts that match up to which the rows' partitions are picked one by one.
MOST_ACCOUNTS = 10_000
#: Rows of one account's partition that one file holds.
ROWS_PER_FILE = 1_000_000
GRAM = 3


def _grams(text: Column) -> Column:
    """The distinct three-grams of a text."""
    n = F.length(text) - (GRAM - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, GRAM)))).otherwise(F.array().cast("array<string>"))


def _part(value: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(parts)).cast("int")


def index_accounts(tx: DataFrame, path: str) -> None:
    """Store payments for searches by parts of their accounts' names: lists of the distinct accounts of each three-gram (small letters),
    and the payments by account, once for each side. Null accounts are in neither."""
    sides = [tx.select(F.col(c).alias("account"), F.lit(c[0]).alias("side"), *tx.columns).where("account IS NOT NULL") for c in ("sender_account", "receiver_account")]
    both = sides[0].unionByName(sides[1])
    names = both.select("account").distinct()
    lists = names.select("account", F.explode(_grams(F.lower("account"))).alias("gram")).withColumn("list", _part(F.col("gram"), LIST_PARTS))
    lists.repartition("list").sortWithinPartitions("gram").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    # a partition with many rows is written by as many tasks as it takes
    files = F.broadcast(both.groupBy(_part(F.col("account"), ROW_PARTS).alias("part")).agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_FILE).alias("_files")))  # at most ROW_PARTS rows
    rows = both.withColumn("part", _part(F.col("account"), ROW_PARTS)).join(files, "part").withColumn("_file", F.pmod(F.xxhash64("id"), F.col("_files")))
    rows.repartition("part", "_file").sortWithinPartitions("account").drop("_file", "_files").write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")


def matching_accounts(spark: SparkSession, path: str, text: str) -> DataFrame:
    """The indexed accounts that contain a text of at least three letters, in any case: those in the lists of all its three-grams,
    compared with it."""
    low = text.lower()
    grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    wanted = spark.createDataFrame([(g,) for g in grams], "gram string")
    parts = [r[0] for r in wanted.select(_part(F.col("gram"), LIST_PARTS)).distinct().collect()]
    lists = spark.read.parquet(f"{path}/lists").where(F.col("list").isin(parts) & F.col("gram").isin(grams))
    held = lists.groupBy("account").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
    return held.where(F.lower("account").contains(low)).select("account")


def search_by_account(spark: SparkSession, path: str, text: str, page: int = 0, size: int = PAGE_SIZE, **filters) -> DataFrame:
    """The page that search_transactions gives for `account=text` and the other filters, from the stored index: only the lists of the
    text's three-grams and the partitions of the matching accounts are read. Texts of fewer than three letters are looked
    for in all rows."""
    rows = spark.read.parquet(f"{path}/rows")
    if len(text) >= GRAM:
        names = matching_accounts(spark, path, text)
        few = names.limit(MOST_ACCOUNTS + 1).collect()
        if len(few) <= MOST_ACCOUNTS:
            accounts = [r.account for r in few]
            parts = [r[0] for r in spark.createDataFrame([(a,) for a in accounts], "account string").select(_part(F.col("account"), ROW_PARTS)).distinct().collect()]
            rows = rows.where(F.col("part").isin(parts) & F.col("account").isin(accounts))
        else:
            rows = rows.join(names, "account", "left_semi")
    else:
        rows = rows.where(F.lower("account").contains(text.lower()))
    # a payment whose both accounts match is there twice; its sender's copy is kept
    other = F.lower("sender_account").contains(text.lower())
    rows = rows.where((F.col("side") == "s") | ~F.coalesce(other, F.lit(False))).drop("account", "side", "part")
    return search_transactions(rows, page=page, size=size, **filters)


# sorted tables


def store_sorted(rows: DataFrame, path: str, key: str = "id", files: int | None = None) -> None:
    """Store rows in files that follow each other in the order of a unique key, and what each file holds: file, n, lo, hi."""
    dealt = rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)
    dealt.sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/rows")
    _held(rows.sparkSession.read.parquet(f"{path}/rows"), key).write.mode("overwrite").parquet(f"{path}/files")


def _held(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))


def stored_page(spark: SparkSession, path: str, page: int, size: int = PAGE_SIZE, key: str = "id", where: Column | None = None, descending: bool = True) -> DataFrame:
    """A page, from 0, of a sorted table in the order of its key. The files that hold it follow from their counts; only they are sorted.

    Without a filter the counts are stored; with one, a pass over the filter's columns counts the rows that fit in each file.
    """
    if page < 0 or size < 1:
        raise ValueError("pages count from 0 and have a positive size")
    stored = spark.read.parquet(f"{path}/rows")
    held = spark.read.parquet(f"{path}/files") if where is None else _held(stored.where(where), key)
    order = Window.orderBy(F.desc("hi") if descending else F.asc("lo")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each file
    upto = held.withColumn("upto", F.sum("n").over(order)).withColumn("before", F.col("upto") - F.col("n"))
    wanted = upto.where((F.col("upto") > page * size) & (F.col("before") < (page + 1) * size)).select("file", "before").collect()
    if not wanted:
        return stored.limit(0)
    rows = spark.read.schema(stored.schema).parquet(*[r.file for r in wanted])
    rows = rows if where is None else rows.where(where)
    skip = page * size - min(r.before for r in wanted)
    ordered = rows.orderBy(F.desc(key) if descending else F.asc(key))
    return (ordered.offset(skip) if skip else ordered).limit(size)


def page_after(spark: SparkSession, path: str, after, size: int, key: str = "id") -> DataFrame:
    """The next rows of a sorted table after a key: the first file that ends behind it, and as many further ones as the size asks for."""
    held = spark.read.parquet(f"{path}/files").where(F.col("hi") > after)
    order = Window.orderBy("lo")  # a row for each file
    # the first file counts for nothing, as all but one of its rows may lie before the key
    later = held.withColumns({"_n": F.row_number().over(order), "before": F.sum("n").over(order) - F.col("n") - F.first("n").over(order)})
    files = [r.file for r in later.where((F.col("_n") == 1) | (F.col("before") < size)).select("file").collect()]
    stored = spark.read.parquet(f"{path}/rows")
    return paged(spark.read.schema(stored.schema).parquet(*files).where(F.col(key) > after), [F.asc(key)], size=size) if files else stored.limit(0)
