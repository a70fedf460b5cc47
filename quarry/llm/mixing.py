"""Operator 6: mix sources to target weights by Efraimidis-Spirakis order (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, columns, materialize, ordered_totals, read

#: Weights of the sources in code point order, repeated; share of all sizes that the mix takes; most epochs.
CYCLE = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 20240


def quality_weight(text: Column) -> Column:
    """A document's sampling weight, 0.01 to 1: the share of its characters that are letters, digits, white
    space or common punctuation, to the fourth power. Null and empty texts weigh 1."""
    odd = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:!?'()-]"))
    clean = 1.0 - odd / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.01), F.coalesce(F.pow(clean, F.lit(4.0)), F.lit(1.0)))


def source_targets(sizes: DataFrame, cycle=CYCLE, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with ``target``: ``share`` of all sizes divided by weight, no target above
    ``max_epochs`` times its source, the excess reshared by weight until none is above.

    The fixed point has one level: target = min(cap, level * weight). Sources fill in the order of
    cap / weight; after the first k are full the level is (budget - their caps) / (weights left), and the
    right k is the first whose level the next source's ratio still holds. One row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (place % len(cycle) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    left = fill.rowsBetween(0, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    s = s.withColumn("_level", (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(left))
    holds = F.col("_level") * F.col("weight") <= F.col("cap")
    s = s.withColumn("_final", F.min(F.when(holds, F.struct(F.col("cap") / F.col("weight"), F.col("_level").alias("level"))))
                     .over(everything))
    level = F.col("_final.level")
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weight: Column | None = None, cycle=CYCLE, share: float = SHARE,
             max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """How many times the mix takes each row: doc_id, size, source_size, target, taken, copies, source, text_hash.

    A row's key is -ln(u) / weight with u drawn from a hash of (seed, id, text), so reruns agree and an order
    by key is a weighted sample without replacement. A source first gives its complete epochs; the rest of
    its target is filled in key order as long as a row's middle word lies within it. What that leaves open before a long
    row is filled once more in the same way, by the later rows that fit in it, so the source ends within half of the
    smaller of a document and that gap. The sort within a source is a range partitioning over all sources,
    so a source with a third of all rows is spread like any other rows.

    Defined cases: null text has size 0; a null source is a source of its own and comes last; null ids are
    hashed like any value; rows that tie are separated by their place in the input; a source of size 0
    has target 0 and its rows are not copied; an empty table gives no rows.
    """
    text = F.col(text_col)
    src = columns(docs, *dict.fromkeys([id_col, text_col, source_col]))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(text.cast("binary"))), 11)
    u = (h + F.lit(1)) / F.lit(float(2 ** 53))
    rows = src.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
                      (-F.log(u) / (weight if weight is not None else quality_weight(text))).alias("key"),
                      text_hash(text).alias("text_hash"))
    # written first: a range partitioning looks at its input twice, and this one is all that the texts are needed for
    rows = materialize(rows, "op6-rows")
    order = ["key", "doc_id", "text_hash"]
    placed = ordered_totals(rows, order, ["size"], group=["source"], name="op6-sizes")
    placed = placed.withColumnRenamed("_total_size", "source_size")
    targets = source_targets(rows_by_source(placed), cycle, share, max_epochs)
    targets = targets.select(F.col("source").alias("_source"), "target")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    placed = placed.join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn("epochs", epochs)
    placed = placed.withColumn("rest", F.when(F.col("epochs") < int(max_epochs), F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(0.0))
    extra = ((F.col("size") > 0) & (F.col("_before_size") + F.col("size") / 2.0 <= F.col("rest"))).cast("long")
    placed = materialize(placed.withColumn("extra", extra).select(*rows.columns, "source_size", "target", "epochs", "rest", "extra"), "op6-chosen")
    # what the cut left open goes to the next rows that fit in it
    gaps = placed.groupBy(F.col("source").alias("_source")).agg((F.max("rest") - F.sum(F.col("extra") * F.col("size"))).alias("gap"))
    placed = placed.join(gaps, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    fits = (F.col("extra") == 0) & (F.col("size") > 0) & (F.col("size") <= F.col("gap"))
    filling = ordered_totals(placed.filter(fits), order, ["size"], group=["source"], name="op6-filling")
    filling = filling.withColumn("extra", (F.col("_before_size") + F.col("size") / 2.0 <= F.col("gap")).cast("long")).select(*placed.columns)
    return placed.filter(~fits).union(filling).withColumn("copies", (F.col("epochs") + F.col("extra")).cast("long")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", "text_hash")


def rows_by_source(placed: DataFrame) -> DataFrame:
    """One row per source, with its size."""
    return placed.groupBy("source").agg(F.max("source_size").alias("source_size"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (0, 1 or more times), all columns kept.

    Rows that agree in id, text and source are one row here, repeated as often as the mix takes them together.
    """
    taken = mix_rows(docs, id_col, text_col, source_col, **options).filter("copies > 0")
    taken = taken.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), F.col("source").alias("_s")).agg(
        F.sum("copies").alias("_copies"))
    marked = docs.withColumn("_text_hash", text_hash(docs[text_col]))
    same = (marked[id_col].cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_h"))
            & marked[source_col].eqNullSafe(F.col("_s")))
    one = Window.partitionBy("_id", "_h", "_s").orderBy("_id")
    return (marked.join(taken, same).withColumn("_n", F.row_number().over(one)).filter("_n = 1")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
            .select(*[marked[c] for c in docs.columns]))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rows(read(spark, sf_dir, "documents"))
