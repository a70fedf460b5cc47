"""Answer queries as they arrive (R7 on a stream).

The reference answers a file of queries in one batch. Here new query files landing in a folder are
answered incrementally: each micro-batch is ranked against the (static) article vectors with the same
block ranker, and the answers are appended to a parquet folder. Progress lives in the checkpoint
location, so a restarted query resumes without answering a file twice; the sink is idempotent per
batch id (dynamic overwrite of the batch's own partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.answer import answer_queries, hashing_embedder
from quarry.session import materialize
from quarry.sources.tables import QUERY_SCHEMA


def answer_stream(spark: SparkSession, queries_path: str, articles: DataFrame, out_path: str, checkpoint: str,
                  article_vectors: DataFrame | None = None, embed=None, k: int = 10, max_files: int | None = None,
                  available_now: bool = True):
    """Start the stream; returns the StreamingQuery. ``articles`` holds (article_id, title).

    Article title vectors are encoded once, before the stream starts, and written to the shared
    checkpoint folder; every micro-batch ranks its queries against that table instead of encoding the
    corpus again.
    """
    if article_vectors is None:
        enc = (embed or hashing_embedder())(articles.select("article_id", F.col("title").alias("_t")), "_t")
        article_vectors = materialize(enc.select("article_id", "embedding"), "stream-article-vectors")
    reader = spark.readStream.schema(QUERY_SCHEMA)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(queries_path)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        ans = answer_queries(batch, articles, embed=embed, k=k, article_vectors=article_vectors)
        (ans.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out_path))

    writer = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
