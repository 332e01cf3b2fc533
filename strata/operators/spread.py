"""Row order and joins that stay spread out when one key holds much of the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.session import cut

#: Rows of one key that a single task should have to take.
HOT_ROWS = 1_000_000
#: Groups of keys, by a hash, whose rows are counted before those of keys are.
KEY_GROUPS = 1 << 14
#: Bytes that a partition of a sorted copy should have.
PART_BYTES = 128 << 20
#: Stored bytes whose rows one task of a spread scan should have to take.
SCAN_BYTES = 4 << 20
#: Bytes in a row's memory that a byte of a stored table may unpack to.
UNPACKED = 8
#: Bytes of stored tables that a join of which only a slice is shuffled at a time reads for a slice.
SLICE_BYTES = 512 << 20
#: Slices of such a join at most: each reads its sources anew.
MOST_SLICES = 4
#: From here on a source's size is Spark's word for not knowing it.
_UNKNOWN = 1 << 60


def spread_scan(df: DataFrame, part_bytes: int = SCAN_BYTES) -> DataFrame:
    """Give every core a share of a scan that has fewer splits than there are cores, and no task more than about `part_bytes` of it.

    For costly row work on a few large files, which cannot be split. Meant for plans without a shuffle,
    whose number of partitions is known from the files.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, min(-(-_stored_bytes(df) // part_bytes), 1_000_000))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def _stored_bytes(df: DataFrame) -> int:
    """Bytes of the tables that a plan reads; a source of unknown size counts nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < _UNKNOWN)


def slices(key: str, *sources: DataFrame) -> list[Column]:
    """Conditions that deal the rows of a join on `key`, and maybe more columns, to as many slices as the tables read are large.

    A slice can be joined alone, as equal keys meet in it, so that the disk holds the shuffle files of one only. All rows of a hot key are in one slice.
    """
    n = max(1, min(-(-sum(map(_stored_bytes, sources)) // SLICE_BYTES), MOST_SLICES))
    return [F.pmod(F.xxhash64(key), F.lit(n)) == i if n > 1 else F.lit(True) for i in range(n)]


def hot_keys(df: DataFrame, on: list[str], min_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than `min_rows` rows, and the number of tasks (``_salts``) that should share each.

    There are at most rows / `min_rows` of them. Keys with a null are left out: they match nothing. Groups of keys are counted first, which
    moves a row per group and task; only keys of a group with that many rows are then counted one by one.
    """
    grouped = df.dropna(subset=on).withColumn("_group", F.pmod(F.xxhash64(*on), F.lit(KEY_GROUPS)))
    full = cut(grouped.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_rows).select("_group"), "hot")
    counts = grouped.join(full, "_group", "left_semi").groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_rows)
    return counts.select(*on, F.ceil(F.col("_n") / min_rows).cast("int").alias("_salts"))


def spread_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left", min_rows: int = HOT_ROWS, hot: DataFrame | None = None
) -> DataFrame:
    """Equi-join for a left side whose keys may be badly skewed and a right side that is not.

    Every key with more than `min_rows` rows is dealt to as many salts as it has times that many, and
    the few right rows of that key are repeated once per salt, so a task takes about `min_rows` rows of
    it at any size. Rows with a null key are spread over all tasks; they match nothing. `how`: inner,
    left, left_semi or left_anti. The salt comes from a row's place in the scan, so a task that runs
    again gives the same salt. The keys of `left` are read twice, so pass a stored table, or `cut`
    what is costly to compute. The list of hot keys is stored: Spark sees its size when it joins it. `hot` is that list where it is known.
    Elsewhere plain joins are left to adaptive execution, which splits skewed partitions.
    """
    hot = cut(hot_keys(left, on, min_rows), "hot") if hot is None else hot
    some_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    placed = left.withColumn("_spot", F.xxhash64(F.monotonically_increasing_id())).join(hot, on, "left")
    salt = F.when(some_null, F.col("_spot")).otherwise(F.pmod("_spot", F.coalesce("_salts", F.lit(1))).cast("bigint"))
    salted_left = placed.withColumn("_salt", salt).drop("_salts", "_spot")
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)).cast("bigint") - 1)
    salted_right = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    joined = salted_left.join(salted_right, on + ["_salt"], how)
    return joined.drop("_salt")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "_rn") -> DataFrame:
    """The first `k` rows of each key by a total order, with their rank in `name`.

    Rows are ranked within their input partition first, so a key sends at most `k` rows per partition
    to the task that ranks them all.
    """
    part = Window.partitionBy(*keys, "_part").orderBy(*order)
    near = df.withColumn("_part", F.spark_partition_id()).withColumn("_near", F.row_number().over(part))
    near = near.where(F.col("_near") <= k).drop("_part", "_near")
    ranked = near.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= k)


def sized_parts(df: DataFrame) -> int:
    """Partitions of about `PART_BYTES`, by the plan's estimate, and no fewer than the session's.

    An estimate multiplies the sides of a join, so it counts only up to what the tables read can unpack to; a source of unknown size counts nothing.
    """
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = min(estimate, UNPACKED * _stored_bytes(df))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // PART_BYTES), 1_000_000))


def deal(df: DataFrame, parts: int, on: list[str]) -> DataFrame:
    """`df` dealt by the keys of the join that follows, if it takes more partitions than the session's to keep a task's share small."""
    return df.repartition(parts, *on) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def number_rows(df: DataFrame, order: list[Column], name: str = "row_no", partitions: int | None = None) -> DataFrame:
    """1-based row number over the whole order, without a window in one task.

    The rows are ranged and sorted once and written to the shared folder with their place inside
    the partition; the offsets of the partitions (one row each) are then joined on. `order` must
    name a total order.
    """
    parts = partitions or sized_parts(df)
    return number_sorted(df.repartitionByRange(parts, *order).sortWithinPartitions(*order), name)


def number_sorted(df: DataFrame, name: str = "row_no") -> DataFrame:
    """1-based number of each row in the order in which `df` has its rows."""
    placed = cut(df.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # The only window in one task; it has one row per partition.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    place = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(name, F.col("_offset") + place + 1).drop("_part", "_place", "_offset")
