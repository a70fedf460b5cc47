"""Title lookup and id-list rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING_TITLE = "?"


def title_source(emb_df: DataFrame, articles: DataFrame) -> DataFrame:
    """(article_id, title) from the embedding table when it carries titles, else from the articles."""
    src = emb_df if "title" in emb_df.columns else articles
    return src.select(F.col("article_id").cast("bigint"), F.col("title"))


def with_titles(df: DataFrame, titles: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Add ``title`` by id lookup, '?' when the id is unknown. A left join whose strategy is left to Spark. Titles that
    have a ``method`` are those of that method's rows."""
    t = titles.select(F.col("article_id").cast("bigint").alias("_tid"), F.col("title").alias("_title"),
                      *[F.col("method").alias("_tmethod") for _ in range("method" in titles.columns)])
    same = df[id_col].cast("bigint") == F.col("_tid")
    if "_tmethod" in t.columns:
        same = same & (df["method"] == F.col("_tmethod"))
    out = df.join(t, same, "left")
    return out.withColumn("title", F.coalesce("_title", F.lit(MISSING_TITLE))).drop("_tid", "_title", "_tmethod")


def render_ids(df: DataFrame, key: str | list[str], ids_col: str, titles: DataFrame, out: str) -> DataFrame:
    """``id «title», id «title»`` in list order, one string per key row; an empty/null list gives ''.

    Ids are rendered as given (so '0012' stays '0012') and looked up as numbers.
    """
    key = [key] if isinstance(key, str) else key
    e = df.select(*key, F.posexplode(ids_col).alias("_pos", "_id"))
    e = with_titles(e, titles, "_id")
    piece = F.concat(F.col("_id").cast("string"), F.lit(" «"), F.col("title"), F.lit("»"))
    agg = e.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", piece.alias("s")))),
                                                      lambda x: x["s"]), ", ").alias(out))
    return df.select(*key).join(agg, key, "left").select(*key, F.coalesce(out, F.lit("")).alias(out))
