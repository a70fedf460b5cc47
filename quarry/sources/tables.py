"""Sources and sinks (S1-S10). Schemas are fixed on read, so nothing is inferred from the files."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE_SCHEMA = "article_id BIGINT, title STRING, body STRING"
LABELLED_QUERY_SCHEMA = "query_id BIGINT, query_text STRING, ground_truth STRING"
QUERY_SCHEMA = "query_id BIGINT, query_text STRING"
AP_SCHEMA = "query_id BIGINT, ap DOUBLE, method STRING"


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet scan (schema fixed when given); Spark's own settings split it."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles (article_id, title, body as HTML)."""
    return read_table(spark, path, ARTICLE_SCHEMA)


def read_labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    """Calibration queries (query_id, query_text, ground_truth as space-separated ids)."""
    return read_table(spark, path, LABELLED_QUERY_SCHEMA)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """S3: unlabelled queries (query_id, query_text)."""
    return read_table(spark, path, QUERY_SCHEMA)


def write_cleaned(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S4 sink: cleaned articles, same columns as the input."""
    df.write.mode(mode).parquet(path)


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    """S4 scan."""
    return read_table(spark, path, ARTICLE_SCHEMA)


def checked_embeddings(df: DataFrame, emb_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """S5 checks, evaluated inline by whatever consumes the rows (no separate pass over the table).

    Every vector must be non-null, free of NaN and ``dim`` long; without ``dim``, as long as the table's longest one
    (a scalar subquery of the same job).
    """
    v = F.col(emb_col)
    want = F.lit(dim) if dim is not None else df.agg(F.max(F.size(emb_col))).scalar()
    bad = v.isNull() | F.exists(v, lambda x: F.isnan(x) | x.isNull()) | (F.size(v) != want)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("invalid embedding vector (null, NaN or wrong length) in column "),
                                                 F.lit(emb_col)))).otherwise(v)
    return df.withColumn(emb_col, checked.cast("array<float>"))


def read_embeddings(spark: SparkSession, path: str, emb_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """Embedding table scan with the checks of :func:`checked_embeddings`."""
    return checked_embeddings(read_table(spark, path), emb_col, dim)


def embedding_summary(df: DataFrame, emb_col: str = "embedding") -> DataFrame:
    """One row: n_rows, min_dim, max_dim. Equal dims are what the reference's stacking requires."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                  F.min(F.size(emb_col)).cast("bigint").alias("min_dim"),
                  F.max(F.size(emb_col)).cast("bigint").alias("max_dim"))


def write_embeddings(df: DataFrame, path: str, id_col: str, text_cols: tuple[str, ...] = (),
                     emb_col: str = "embedding", mode: str = "overwrite") -> None:
    """Typed embedding sink: id BIGINT, the given text columns as STRING, embedding ARRAY<FLOAT>."""
    cols = [F.col(id_col).cast("bigint").alias(id_col)]
    cols += [F.col(c).cast("string").alias(c) for c in text_cols]
    cols.append(F.col(emb_col).cast("array<float>").alias(emb_col))
    df.select(*cols).write.mode(mode).parquet(path)


def write_derived_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rewritten queries / generated titles; ids as BIGINT, everything else as STRING."""
    cols = [F.col(c).cast("bigint" if c.endswith("_id") else "string").alias(c) for c in df.columns]
    df.select(*cols).write.mode(mode).parquet(path)


def write_answer(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Answer CSV with header ``query_id,answer``.

    Written as a folder of CSV parts (each with the header line) so that no single task writes every row.
    """
    df.select(F.col("query_id").cast("bigint"), F.col("answer").cast("string")) \
        .write.mode(mode).option("header", True).csv(path)


def read_answer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_id BIGINT, answer STRING").option("header", True).csv(path)


def write_ap(ap: DataFrame, path: str, method: str | None = None, mode: str = "overwrite") -> None:
    """S9 sink: per-query AP, one partition folder per method. Written again, a method replaces its own folder and no
    other (dynamic partition overwrite)."""
    out = ap if method is None else ap.withColumn("method", F.lit(method))
    (out.select(F.col("query_id").cast("bigint"), F.col("ap").cast("double"), F.col("method").cast("string"))
        .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("method").parquet(path))


def read_ap(spark: SparkSession, path: str, methods: list[str] | None = None) -> DataFrame:
    """S9 scan; a method filter prunes partitions."""
    df = spark.read.schema(AP_SCHEMA).parquet(path)
    return df if methods is None else df.where(F.col("method").isin(methods))


def write_run(report: dict[str, DataFrame], path: str, method: str | None = None, mode: str = "overwrite") -> None:
    """One parquet table per report section under ``path/<section>``, partitioned by method (the given one, or the
    sections' own column).

    Dynamic partition overwrite replaces the folders of the methods written and keeps other methods' runs.
    """
    def write(section: str) -> None:
        df = report[section] if method is None else report[section].withColumn("method", F.lit(method))
        (df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("method")
           .parquet(f"{path.rstrip('/')}/{section}"))

    with ThreadPoolExecutor(4) as pool:  # the sections are small jobs that don't depend on each other
        list(pool.map(write, report))


def read_run(spark: SparkSession, path: str, section: str, method: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path.rstrip('/')}/{section}")
    return df if method is None else df.where(F.col("method") == method)
