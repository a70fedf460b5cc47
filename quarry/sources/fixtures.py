"""Stand-ins for the reference's inputs, derived by Spark from the given test tables.

Every fixture reads whole tables; rows are assigned roles (query or article), never dropped.

* V (vectors): ``embeddings`` rows with ``vec_id % 10 = 0`` are queries, the others articles. A query's
  ground truth is the GT_IDS articles of its label that come first by a hash of their ids, ascending.
* R (rank-derived): ground truth picked from ranks of fixture V's top 10 by ``(query_id // 10) % 5``,
  giving known AP values (1, 0.75, 0.1, 0.5317, 0); case 4 alternates NULL and ''.
* T (text): ``benchmark`` passages are queries, ``documents`` the articles; ground truth is every
  document whose text contains the passage. Noisy queries: ``conversations`` user turns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import bounded_batches, materialize
from quarry.sources import tables
from quarry.sources.tables import read_embeddings

# Fixed value: ranks that become ground truth in fixture R, by case (query_id // 10) % 5.
RANK_CASES = {0: [1], 1: [1, 4], 2: [10], 3: [2, 3, 7], 4: []}

# Articles in a query's ground truth in fixture V.
GT_IDS = 40


@dataclass
class Fixture:
    articles: DataFrame           # article_id, title, body
    queries: DataFrame            # query_id, query_text, ground_truth
    article_vectors: DataFrame | None = None   # article_id, embedding
    query_vectors: DataFrame | None = None     # query_id, embedding


def _ids_string(pairs: DataFrame, key: str, val: str, out: str) -> DataFrame:
    """(key, val) pairs -> (key, out) with the vals ascending, joined by spaces (bounded by the output row)."""
    return pairs.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list(F.col(val))), " ").alias(out))


def vector_fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    emb = read_embeddings(spark, f"{sf_dir}/embeddings.parquet")
    is_query = (F.col("vec_id") % 10) == 0
    arts = emb.where(~is_query).select(F.col("vec_id").alias("article_id"), "embedding", "label")
    qs = emb.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding", "label")
    # One id list of at most GT_IDS ids per label, joined many-to-one to the queries: the window's limit is applied
    # by every task before the shuffle, so a label of any size sends GT_IDS rows a task.
    first = Window.partitionBy("label").orderBy(F.md5(F.col("article_id").cast("string")), "article_id")
    chosen = arts.select("label", "article_id", F.row_number().over(first).alias("_r")).where(F.col("_r") <= GT_IDS)
    per_label = _ids_string(chosen, "label", "article_id", "ground_truth")
    queries = (qs.join(per_label, "label", "left")
               .select("query_id",
                       F.concat(F.lit("vector "), F.col("query_id").cast("string"), F.lit(" label "),
                                F.col("label").cast("string")).alias("query_text"),
                       F.coalesce("ground_truth", F.lit("")).alias("ground_truth")))
    articles = arts.select("article_id",
                           F.concat(F.lit("vector "), F.col("article_id").cast("string"), F.lit(" label "),
                                    F.col("label").cast("string")).alias("title"),
                           F.lit("").alias("body"))
    return Fixture(articles, queries, arts.select("article_id", "embedding"), qs.select("query_id", "embedding"))


def rank_fixture(spark: SparkSession, sf_dir: str, rankings: DataFrame | None = None) -> Fixture:
    """Fixture R: ground truth taken from given ranks of fixture V's top 10."""
    from quarry.operators.rank import block_top_k

    v = vector_fixture(spark, sf_dir)
    if rankings is None:
        rankings = block_top_k(v.article_vectors, v.query_vectors, 10)
    case = F.pmod(F.floor(F.col("query_id") / 10), F.lit(5))
    picked = F.lit(False)
    for c, ranks in RANK_CASES.items():
        if ranks:
            picked = picked | ((case == c) & F.col("rank").isin(ranks))
    chosen = rankings.where(picked)
    gt = chosen.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "article_id"))),
                                 lambda x: x["article_id"].cast("string")), " ").alias("gt"))
    case4_null = F.pmod(F.floor(F.col("query_id") / 50), F.lit(2)) == 0
    queries = (v.queries.drop("ground_truth").join(gt, "query_id", "left")
               .select("query_id", "query_text",
                       F.when(F.col("gt").isNotNull(), F.col("gt"))
                       .when(case4_null, F.lit(None).cast("string"))
                       .otherwise(F.lit("")).alias("ground_truth")))
    return Fixture(v.articles, queries, v.article_vectors, v.query_vectors)


#: Words, and characters, of the gram by which a passage meets the documents that may hold it.
MATCH_WORDS, MATCH_CHARS = 4, 8
#: Bytes of passages that are broadcast to the documents; more of them meet the documents by a join.
PASSAGE_BYTES = 32 << 20
#: What Java's pattern \\s takes for white space.
JAVA_SPACES = re.compile(rb"[ \t\n\x0b\f\r]+")


def _gram_of_words(words: str, at, n: int):
    """Hash of ``n`` words from place ``at`` (from 0) of an array column on."""
    return F.xxhash64(*[F.get(F.col(words), at + j) for j in range(n)])


def _grams(docs: DataFrame, unit: str, n: int) -> DataFrame:
    """(doc_id, gram): hashes of all runs of ``n`` words (or characters) of each text (doc_id, text, words).

    The words are a column of their own, read from a written table: a lambda would split the text anew at every place. The
    outer explode keeps Spark from deriving a filter that repeats the expression."""
    if unit == "empty":
        return docs.select("doc_id", F.lit(0).cast("bigint").alias("gram"))
    if unit == "words":
        places = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n))
        grams = F.transform(places, lambda i: _gram_of_words("words", i, n))
    else:
        places = F.when(F.length("text") >= n, F.sequence(F.lit(1), F.length("text") - n + 1))
        grams = F.transform(places, lambda i: F.xxhash64(F.substring("text", i, F.lit(n))))
    return docs.select("doc_id", F.explode_outer(grams).alias("gram")).where(F.col("gram").isNotNull())


def containment_pairs(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, pid) for every document text containing a passage text (exact substring).

    A passage meets documents by a gram of its own: its first words but the very first one, which may be the end of a longer
    word in the document, as may the last one be its beginning. A passage without such words is met by its first characters, an
    empty one by every document. Passages with such words are broadcast if they are few; else that is an equi-join on hashes, as it
    is for the others. What is found is checked on the texts.
    """
    p = passages.select(F.col("pid").cast("bigint").alias("pid"), F.col("ptext").cast("string").alias("ptext"))
    words = F.split("ptext", r"\s+")
    inner = F.size(words) - 2
    unit = F.when(F.length("ptext") == 0, "empty").when(inner > 0, "words").otherwise("chars")
    n = F.when(unit == "empty", 0).when(unit == "words", F.least(inner, F.lit(MATCH_WORDS))).otherwise(
        F.least(F.length("ptext"), F.lit(MATCH_CHARS)))
    p = p.where(F.col("ptext").isNotNull()).withColumn("unit", unit).withColumn("n", n)
    key = F.when(F.col("unit") == "empty", F.lit(0).cast("bigint"))
    for size in range(1, MATCH_WORDS + 1):
        key = key.when((F.col("unit") == "words") & (F.col("n") == size), _gram_of_words("words", F.lit(1), size))
    key = (key.when(F.col("unit") == "chars", F.xxhash64(F.substring("ptext", F.lit(1), F.col("n")))))
    p = materialize(p.withColumn("words", words).withColumn("gram", key).drop("words"), "match-passages")
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    by_words = p.where(F.col("unit") == "words")
    few = (by_words.agg(F.sum(F.octet_length("ptext") + 100)).first()[0] or 0) <= PASSAGE_BYTES
    pairs = _word_pairs(d, by_words) if few else None
    rest = p.where(F.col("unit") != "words") if few else p
    kinds = rest.select("unit", "n").distinct().collect()  # at most MATCH_WORDS + MATCH_CHARS + 1 of them
    split = d
    if not few:
        split = materialize(d.withColumn("words", F.split("text", r"\s+")), "match-words")
    found = None
    for unit, n in kinds:
        own = p.where((F.col("unit") == unit) & (F.col("n") == n)).select("pid", "gram")
        one = _grams(split, unit, n).join(own, "gram").select("doc_id", "pid")
        found = one if found is None else found.unionByName(one)
    if found is not None:
        maybe = materialize(found.distinct(), "match-candidates")
        more = (maybe.join(rest.select("pid", "ptext"), "pid").join(d, "doc_id").where(F.contains("text", "ptext"))
                .select("doc_id", "pid"))
        pairs = more if pairs is None else pairs.unionByName(more)
    return docs.sparkSession.createDataFrame([], "doc_id BIGINT, pid BIGINT") if pairs is None else pairs


def _word_pairs(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, pid) of passages (pid, ptext) that have a gram of words, few enough to be broadcast: each text is read once,
    and a place of it is looked at if the word there is the longest of a passage."""
    rows = [r for r in passages.select("pid", "ptext").collect() if r["pid"] is not None]  # PASSAGE_BYTES at most
    if not rows:
        return docs.sparkSession.createDataFrame([], "doc_id BIGINT, pid BIGINT")
    grams: dict[bytes, dict[tuple[int, int], dict[bytes, list]]] = {}
    for pid, text in rows:  # the gram is around the longest word, which few texts have
        words = JAVA_SPACES.split(text.encode())[1:-1]
        longest = max(range(len(words)), key=lambda i: len(words[i]))
        n = min(MATCH_WORDS, len(words))
        first = min(longest, len(words) - n)
        (grams.setdefault(words[longest], {}).setdefault((longest - first, n), {})
         .setdefault(b" ".join(words[first:first + n]), []).append((pid, text.encode())))
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def match(batches):
        grams = shared.value
        known = frozenset(grams)
        for batch in batches:
            ids, pids = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text.encode()
                words = text.split()  # by the same characters; no word of a gram is empty
                some = known.intersection(words)
                seen = set()
                for i in [i for i, w in enumerate(words) if w in some] if some else ():
                    for (before, n), those in grams[words[i]].items():
                        gram = b" ".join(words[i - before:i - before + n]) if i >= before else b""
                        if gram in those and (words[i], before, gram) not in seen:
                            seen.add((words[i], before, gram))
                            own = [pid for pid, passage in those[gram] if passage in text]
                            ids += [doc] * len(own)
                            pids += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pids, pa.int64())], names=["doc_id", "pid"])

    bounded_batches(docs.sparkSession)
    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(match, "doc_id BIGINT, pid BIGINT")


def text_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of fixture T, without the work for its ground truth."""
    docs = tables.read_table(spark, f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("article_id"),
                       F.concat(F.col("source"), F.lit(" #"), F.col("doc_id").cast("string")).alias("title"),
                       F.col("text").alias("body"))


def text_fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    docs = tables.read_table(spark, f"{sf_dir}/documents.parquet")
    bench = tables.read_table(spark, f"{sf_dir}/benchmark.parquet")
    articles = text_articles(spark, sf_dir)
    pairs = containment_pairs(docs.select("doc_id", "text"),
                              bench.select(F.col("item_id").alias("pid"), F.col("text").alias("ptext")))
    gt = _ids_string(pairs, "pid", "doc_id", "ground_truth").withColumnRenamed("pid", "query_id")
    queries = (bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
               .join(gt, "query_id", "left")
               .select("query_id", "query_text", F.coalesce("ground_truth", F.lit("")).alias("ground_truth")))
    return Fixture(articles, queries)


def noisy_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of ``conversations`` as (query_id, query_text); query_id = conv_id * 1000000 + turn."""
    conv = tables.read_table(spark, f"{sf_dir}/conversations.parquet")
    return conv.where(F.col("role") == "user").select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).cast("bigint").alias("query_id"),
        F.col("text").alias("query_text"))


# Synthetic wrappers of fixture H, chosen by doc_id % 8 (TEXT = the document, '&' escaped;
# LANG = its language code). They supply the structures the crawled pages lack.
HTML_WRAPPERS = [
    '<div class="spoiler"><label></label><div class="spoiler-text"> LANG </div><div class="spoiler-content"><p>TEXT</p></div></div>',
    '<div class="spoiler"><div class="spoiler-text">LANG</div></div>',
    '<div class="spoiler"><div class="spoiler-text">LANG</div><div class="spoiler-content"></div></div>',
    '<div class="spoiler"><label>x</label><div class="spoiler-content"><p>TEXT</p></div></div>',
    '<div class="x tabset"><input><label class="tab-label">A</label><label class="tab-label">B</label>'
    '<div class="tab-panel"><p>TEXT</p></div><div class="tab-panel"></div></div>',
    '<div class="tabset"><label class="tab-label">LANG</label><div class="tab-panel"><p>TEXT</p></div>'
    '<div class="tab-panel"><p>LANG</p></div></div>',
    '<div class="tabset"><label class="tab-label">A</label><p>TEXT</p></div>',
    '<table><tr><td><table><tr><td> LANG </td><td>B</td></tr></table></td><td>TEXT</td></tr></table>'
    '<table><tr><td> </td></tr></table><p><img alt=" A "> <img> <a href="x">t <b>u</b></a> '
    '<headline>H</headline><chunk>C</chunk></p><div class="a factoid">F</div><div><div></div>x</div>'
    '<label> </label><span>&nbsp;</span>',
]
SYNTHETIC_ID_OFFSET = 1_000_000_000


def _wrap_expr(text, lang, doc_id):
    expr = None
    for i, tpl in enumerate(HTML_WRAPPERS):
        pieces = []
        for j, part in enumerate(tpl.split("TEXT")):
            if j:
                pieces.append(text)
            for k, sub in enumerate(part.split("LANG")):
                if k:
                    pieces.append(lang)
                pieces.append(F.lit(sub))
        built = F.concat(F.lit("<html><head><title>"), lang, F.lit("</title></head><body>"), *pieces,
                         F.lit("</body></html>"))
        cond = F.pmod(doc_id, F.lit(len(HTML_WRAPPERS))) == i
        expr = F.when(cond, built) if expr is None else expr.when(cond, built)
    return expr


def html_fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    """Fixture H: crawled pages (title from <title>) plus every document wrapped in a synthetic structure."""
    pages = tables.read_table(spark, f"{sf_dir}/pages.parquet").select(
        F.col("page_id").alias("article_id"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("html").alias("body"))
    docs = tables.read_table(spark, f"{sf_dir}/documents.parquet")
    text = F.replace(F.col("text"), F.lit("&"), F.lit("&amp;"))
    synth = docs.select((F.col("doc_id") + SYNTHETIC_ID_OFFSET).alias("article_id"), F.col("lang").alias("title"),
                        _wrap_expr(text, F.col("lang"), F.col("doc_id")).alias("body"))
    return Fixture(pages.unionByName(synth), None)
