"""Batch inference over columns.

Models are supplied by the caller as a *factory*: a zero-argument function, called once per Python
worker, that loads the model and returns a batch function. Spark's ``predict_batch_udf`` caches the
loaded model per worker and feeds it Arrow batches of ``batch_size`` rows, so model loading is not
repeated per row or per batch.

* encoder factory -> ``fn(texts: np.ndarray[str]) -> np.ndarray[float32] (n, dim)``
* generator factory, given the decoder's limit of new tokens -> ``fn(prompts: np.ndarray[str]) -> np.ndarray[object]
  (n,)`` of strings

Chat prompts (E3/E4) are ARRAY<STRUCT<role, content>> columns; they reach a generator as JSON text
(``to_json``) so the UDF needs no nested-type conversion.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import py_strip
from quarry.functions.terms import bucket_counts
from quarry.functions.vectors import TOKEN_PATTERN, l2_normalize
from quarry.session import bounded_batches, materialize

# Batch sizes and generation limits of the reference's jobs.
BATCH_TITLES = 32
BATCH_BODIES = 8
BATCH_QUERIES = 64
BATCH_REWRITE = 4
BATCH_GENERATE_TITLES = 8
MAX_NEW_TOKENS_REWRITE = 64
MAX_NEW_TOKENS_TITLES = 32


def encoder_udf(make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = BATCH_QUERIES):
    """A vectorised UDF (string -> ARRAY<FLOAT>) from an encoder factory."""
    return predict_batch_udf(make_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)


def embed_column(df: DataFrame, text_col: str, make_encoder, batch_size: int = BATCH_QUERIES,
                 out: str = "embedding", normalize: bool = True, distinct: bool = False) -> DataFrame:
    """E1 (+E2): add ``out`` = encoder(text), L2-normalised as the reference's encoder calls are. With ``distinct`` each
    distinct text is encoded once (for columns with many repeats: it costs a shuffle of hashes and results)."""
    if distinct:
        return infer_distinct(df, text_col, lambda t: embed_column(t, text_col, make_encoder, batch_size, out, normalize), out)
    raw = f"_{out}_raw"
    bounded_batches(df.sparkSession)
    staged = df.withColumn(raw, encoder_udf(make_encoder, batch_size)(F.col(text_col)))
    vec = l2_normalize(raw).cast("array<float>") if normalize else F.col(raw)
    return staged.withColumn(out, vec).drop(raw)


#: Rows of one text from which the rows that ask for its result are spread over several keys.
HOT_ROWS = 100_000


def infer_distinct(df: DataFrame, text_col: str, infer: Callable[[DataFrame], DataFrame], out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``out`` to ``df`` with ``infer`` run once per distinct text of ``text_col``.

    ``infer`` takes a table (text_col, ..) and adds ``out``; its result must depend on the text alone. Texts are told apart by
    their SHA-256 and each is sent once; the results are written and joined back by the hash. A text with more than
    ``hot_rows`` rows has its result repeated under as many salted keys as that takes, so that its rows are spread. A
    null text is one of the texts.
    """
    key = F.coalesce(F.sha2(F.col(text_col), 256), F.lit("null"))
    hashed = df.withColumn("_text_key", key)
    counts = hashed.groupBy("_text_key").agg(F.first(text_col).alias(text_col), F.count(F.lit(1)).alias("_rows"))
    done = materialize(infer(counts).select("_text_key", "_rows", out), "distinct-texts")
    salts = F.ceil(F.col("_rows") / hot_rows).cast("int")
    keyed = done.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_rows")
    # few texts can be hot: no more than rows / hot_rows
    hot = done.filter(F.col("_rows") > hot_rows).select("_text_key", salts.alias("_salts"))
    spread = (hashed.join(hot, "_text_key", "left")
              .withColumn("_salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts"))
    return spread.join(keyed, ["_text_key", "_salt"]).drop("_text_key", "_salt")


def hashing_encode(df: DataFrame, text_col: str, dim: int = 64, out: str = "embedding") -> DataFrame:
    """The built-in encoder, a hashed bag of words, L2-normalised.

    Words are counted in one Arrow pass, linear in the words of a text whatever ``dim``; the vector is a column of its own
    before it is normalised, so it is computed once per row. A NULL text is the zero vector.
    """
    c = f"_{out}_c"
    bounded_batches(df.sparkSession)
    return df.withColumn(c, bucket_counts(F.col(text_col), dim)).withColumn(out, l2_normalize(c)).drop(c)


def hashing_encoder_factory(dim: int = 64):
    """The same hashed bag of words as a Python encoder factory, to exercise E1's injected path."""
    def make():
        import hashlib

        import regex
        pattern = regex.compile(TOKEN_PATTERN)

        def encode(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for i, t in enumerate(texts):
                if t is None:
                    continue
                for tok in pattern.findall(str(t).lower()):
                    out[i, int(hashlib.md5(tok.encode()).hexdigest()[:8], 16) % dim] += 1.0
            return out
        return encode
    return make


def generator_udf(make_generator: Callable[[int], Callable[[np.ndarray], np.ndarray]], batch_size: int, max_new_tokens: int):
    """A vectorised UDF (prompt JSON string -> STRING) from a generator factory, which is given the decoder's limit."""
    return predict_batch_udf(functools.partial(make_generator, max_new_tokens), return_type=T.StringType(), batch_size=batch_size)


def generate_column(df: DataFrame, prompt_col: str, make_generator, batch_size: int, out: str, max_new_tokens: int,
                    distinct: bool = False) -> DataFrame:
    """Run the generator over chat prompts; the output is stripped as the reference strips it. With ``distinct`` each
    distinct prompt is decoded once."""
    bounded_batches(df.sparkSession)
    if distinct:
        flat = df.withColumn("_json", F.to_json(F.col(prompt_col)))

        def decode(t: DataFrame) -> DataFrame:
            return t.withColumn(out, py_strip(generator_udf(make_generator, batch_size, max_new_tokens)(F.col("_json"))))
        return infer_distinct(flat, "_json", decode, out).drop("_json")
    gen = generator_udf(make_generator, batch_size, max_new_tokens)(F.to_json(F.col(prompt_col)))
    return df.withColumn(out, py_strip(gen))


def last_user_message(max_new_tokens: int):
    """A stand-in generator factory without a model: the whole last user message without its instruction label. It
    has no decoder, so the decoder's limit does not apply to it."""
    import json

    def generate(prompts: np.ndarray) -> np.ndarray:
        res = []
        for p in prompts:
            msgs = json.loads(p) if p is not None else []
            text = next((m.get("content") or "" for m in reversed(msgs) if m.get("role") == "user"), "")
            res.append(text.split(": ", 1)[1] if ": " in text else text)
        return np.array(res, dtype=object)
    return generate
