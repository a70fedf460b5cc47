import pytest

from quarry.llm.common import bounded_batches

#: Texts that every operator on documents has to stand: nulls, empty and odd ones, repeats, a very long one.
TEXTS = [None, "", "   \n\t ", "one", "Two words", "a b c d e f g h", "a b c d e f g h", "A B C D E F G H", "x " * 30_000,
         "Ünïcödé text with odd\x1cspaces\n\n\nand 漢字 😀😀", "!!! ### $$$ ***", "word " * 40 + "end."]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """The odd texts, with a null id, repeated ids and rows, a null source, and columns whose names clash with those that
    the operators make."""
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 0) for i, t in enumerate(TEXTS)]
    rows += [(None, "a b c d e f g h", "en", "s1", 0), (5, "a b c d e f g h", "en", "s2", 0), (5, "a b c d e f g h", "en", "s2", 0)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("size", "shard", "key", "tokens", "_row", "_part", "score", "rank", "text_hash", "n", "cls", "label", "predicted"):
        df = df.selectExpr("*", f"'clash' as `{name}`")
    bounded_batches(spark)
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
