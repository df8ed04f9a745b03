"""What the operators share: scratch tables, text expressions, prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = r"[\x20\x09-\x0D]+"
NOT_BLANKS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, or below the checkpoint folder set on the context.

    Without either a folder of this machine serves a local master, as in tests;
    on a cluster that is an error, since its executors share no such folder.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix=f"llm-{name}-") + "/t"
    return f"{shared.rstrip('/')}/llm-{name}-{uuid.uuid4()}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to shared storage and read back: lineage ends here."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower case of A-Z only. ``lower`` is the fast form where no other letter can change."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    """Number of maximal runs of anything but blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_BLANKS)), F.lit(0)).cast("long")


def private(df: DataFrame, *wanted: str) -> DataFrame:
    """The wanted columns alone, so that no other column of a table can clash with a working name."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def small_batches(spark: SparkSession) -> None:
    """Few rows and bytes per Arrow batch: texts may be long, and a batch is held whole by a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")


def random_rows(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, one of each ``h``: those of the smallest ``h`` among a share chosen by it.

    The share follows from the number of different ``h``, so what the tasks send
    to sort out the smallest is near ``most`` rows in all, however many tasks
    there are and however often a row repeats.
    """
    span = 1 << 30
    share = min(1.0, 1.2 * most / max(1, rows.select("h").distinct().count()))
    return rows.where(F.pmod("h", F.lit(span)) < int(share * span)).dropDuplicates(["h"]).orderBy("h").limit(most)


def packed(df: DataFrame) -> DataFrame:
    """All columns in one struct ``row``, out of the way of working names."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def by_class(rows: DataFrame, classes: DataFrame, key: str, heavy: int = 1000, most: int = 1_000_000) -> DataFrame:
    """``rows`` with the other columns of their class: an inner join on ``key`` where one class may hold very many rows.

    ``classes`` has one row a class, with ``members``, the number of its rows.
    Classes above ``heavy`` members (more, where those would be above ``most``)
    are few; they are broadcast, so that their rows stay where they are. All
    others are joined by a shuffle, in which no key has more rows than that.
    """
    total = classes.agg(F.sum("members")).first()[0] or 0
    bound = max(heavy, total // most)
    large, small = classes.where(F.col("members") > bound), classes.where(F.col("members") <= bound)
    names = F.broadcast(large.select(key))
    return rows.join(F.broadcast(large), key).unionByName(rows.join(names, key, "left_anti").join(small, key))


def same(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    """Null-safe equality of the key columns of two relations."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def prefix_sums(df: DataFrame, order: list[str], values: list[str], group: list[str] = (), name: str = "prefix") -> DataFrame:
    """Adds ``<value>_before``: the sum over all rows ahead in ``order`` (within ``group``).

    Rows are range-partitioned by group and order, so a hot group spreads over
    many partitions; each partition's totals give the offset of the next, and
    the running sums stay within a partition. No group is gathered in one task.
    The range split is stored first: its partition numbers are used twice.
    """
    group = list(group)
    ranged = df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged, name)
    totals = ranged.groupBy("_part", *group).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in group], *[
        F.coalesce(F.sum(f"_t_{v}").over(ahead), F.lit(0)).alias(f"_o_{v}") for v in values])
    local = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.select("*", *[F.coalesce(F.sum(v).over(local), F.lit(0)).alias(f"_r_{v}") for v in values])
    on = reduce(lambda a, b: a & b, [F.col("_part") == F.col("_p"), *[F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]])
    joined = running.join(offsets, on)
    return joined.select(*df.columns, *[(F.col(f"_o_{v}") + F.col(f"_r_{v}")).alias(f"{v}_before") for v in values])
