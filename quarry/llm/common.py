"""Helpers shared by the training-data operators: written tables, ordered prefix sums, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import scratch_path

#: ``[^\x20\x09-\x0D]+`` as a Java regular expression: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lineage ends there, and a later loss of an
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra columns of an input, whatever they are called, never reach an operator."""
    return df.select(*[df[n] for n in names])


def ordered_totals(rows: DataFrame, order: list[str], values: list[str], group: list[str] = (),
                   name: str = "ordered") -> DataFrame:
    """Exclusive running totals of ``values`` and of the row count (``_row``), over ``order`` within ``group``.

    Rows are range-partitioned by (group, order), so neither a hot group nor a long table meets in one task:
    each partition's own totals per group give the group's offset at that partition (as many rows as there
    are partitions and groups), and a window inside the partition adds the rest. Rows that tie on every order
    column are separated by their place in the input. Adds ``_before_<value>``, ``_total_<value>`` (of the whole
    group) and ``_row``.
    """
    group = list(group)
    keyed = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = keyed.repartitionByRange(*[F.col(c) for c in [*group, *order, "_tie"]])
    table = materialize(placed.withColumn("_part", F.spark_partition_id()), name)

    key = ["_part", *group]
    sums = [F.sum(v).alias(f"_sum_{v}") for v in values] + [F.count(F.lit(1)).alias("_sum_row")]
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = table.groupBy(*key).agg(*sums)
    offsets = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in key],
                             *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_off_{v}")
                               for v in [*values, "row"]],
                             *[F.sum(f"_sum_{v}").over(Window.partitionBy(*group)).alias(f"_total_{v}") for v in values])
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in key]
    inside = Window.partitionBy(*key).orderBy(*order, "_tie")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    out = table.join(offsets, cond)
    for v in values:
        out = out.withColumn(f"_before_{v}", F.col(f"_off_{v}") + F.coalesce(F.sum(v).over(upto), F.lit(0)))
    out = out.withColumn("_row", F.col("_off_row") + F.row_number().over(inside) - 1)
    return out.select(*rows.columns, *[f"_before_{v}" for v in values], *[f"_total_{v}" for v in values], "_row")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def string_column(batch: pa.RecordBatch, name: str) -> list:
    """A text column of a batch as Python strings (null: empty)."""
    return [t if t is not None else "" for t in batch.column(name).to_pylist()]


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Bound the Arrow batches of this session's Python stages by rows and by bytes, so that long texts cannot
    gather in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` (an integer column) from batches sorted by it, one table a run."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)
