"""Appending to a table batch by batch, each instrument after its own last date; safe when a batch is delivered again or breaks off."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing there yet
        return None


def _committed(spark: SparkSession, path: str, part: str) -> DataFrame | None:
    """What the committed batches wrote; files of a batch without its record do not count."""
    rows, done = _read(spark, f"{path}/{part}"), _read(spark, f"{path}/commits")
    return None if rows is None or done is None else rows.join(done.select("batch").distinct(), "batch", "left_semi")


def appended(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed batches."""
    rows = _committed(spark, path, "rows")
    if rows is None:
        raise ValueError(f"no batch has been committed to {path}")
    return rows.drop("batch")


def unseen(batch: DataFrame, marks: DataFrame | None, keys: list[str], order: str, key: str = "id") -> DataFrame:
    """Rows of a batch at or after the newest mark of their instrument, one per instrument and `keys`, without keys that have that mark.

    Marks are sorted in among the rows, so one shuffle and one sort by
    instrument find its newest mark, the rows behind it and repeated keys. Null
    keys are equal; of rows that repeat a key, the one of the newest `order` is
    taken."""
    both = batch.withColumn("_old", F.lit(False))
    rest = [k for k in keys if k != key]
    first = [F.desc("_old"), *([] if order in keys else [F.desc(order)])]
    if marks is not None:
        value = lambda f: F.col("_mark") if f.name == order else F.col(f.name) if f.name in (key, *keys) else F.lit(None).cast(f.dataType)
        both = both.unionByName(marks.select(*(value(f).alias(f.name) for f in batch.schema), F.lit(True).alias("_old")))
        whole = Window.partitionBy(key).orderBy(*rest, *first).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        both = both.withColumn("_last", F.max(F.when(F.col("_old"), F.col(order))).over(whole))
        both = both.where(F.when(F.col("_old"), F.col(order) == F.col("_last")).otherwise(F.col("_last").isNull() | (F.col(order) >= F.col("_last")))).drop("_last")
    same = Window.partitionBy(key, *rest).orderBy(*first)  # in the order of the window before; marks come before rows
    return both.withColumn("_place", F.row_number().over(same)).where("_place = 1 and not _old").drop("_place", "_old")


def append_batch(batch: DataFrame, number: int, path: str, keys: list[str], order: str, key: str = "id") -> None:
    """Append to the table in `path` the rows of each instrument after its own last `order` value, one per instrument and `keys`; for foreachBatch with its batch id.

    A batch writes its rows, then its marks (per instrument the newest value and
    the keys that have it), then its record. One with a record is not written
    again; one that broke off is written anew over its own folder, against the
    marks of the others. An instrument that comes late is compared with its own
    mark only, and rows that tie with a mark are told by their keys. One writer
    at a time. Marks, not rows, are read for each batch."""
    spark = batch.sparkSession
    done = _read(spark, f"{path}/commits")
    if done is not None and not done.where(F.col("batch") == number).isEmpty():
        return
    new = unseen(batch, _committed(spark, path, "marks"), keys, order, key)
    folder = f"batch={number}"
    new.write.mode("overwrite").parquet(f"{path}/rows/{folder}")
    own = spark.read.schema(new.schema).parquet(f"{path}/rows/{folder}")
    top = own.groupBy(key).agg(F.max(order).alias("_mark"))
    own.join(top, key).where(F.col(order) == F.col("_mark")).select(*dict.fromkeys([key, *keys]), "_mark").write.mode("overwrite").parquet(f"{path}/marks/{folder}")
    spark.range(1).select(F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{path}/commits/{folder}")
