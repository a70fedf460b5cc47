"""Whole texts through the generators, strict parsing, overwriting runs, checked vectors, text conversion by hand."""

import pytest
from pyspark.sql import functions as F

from quarry.functions.prompts import title_prompt
from quarry.functions.text import parse_gt
from quarry.operators import infer
from quarry.operators.markdown import html_to_text
from quarry.plans import enrich
from quarry.sources import tables


def test_long_text_passes_whole(spark):
    text = " ".join(f"word{i}" for i in range(3000))
    q = spark.createDataFrame([(1, text, "5"), (2, None, None)], "query_id long, query_text string, ground_truth string")
    got = {r.query_id: r for r in enrich.rewrite_queries(q, infer.last_user_message).collect()}
    assert got[1].rewritten_text == text and got[1].ground_truth == "5" and got[2].rewritten_text == ""


def test_generator_is_given_the_decoder_limit(spark):
    def limit(max_new_tokens):
        import numpy as np
        return lambda prompts: np.array([str(max_new_tokens)] * len(prompts), dtype=object)
    q = spark.createDataFrame([(1, "a")], "query_id long, query_text string")
    assert enrich.rewrite_queries(q, limit).first().rewritten_text == str(infer.MAX_NEW_TOKENS_REWRITE)
    a = spark.createDataFrame([(1, "a")], "article_id long, body string")
    assert enrich.generate_titles(a, limit, 7).first().generated_title == "7"


def test_title_examples_can_be_given(spark):
    p = spark.range(1).select(title_prompt(F.lit("body"), [("head", "title")]).alias("p")).first().p
    assert [m.role for m in p] == ["system", "user", "assistant", "user"] and p[2].content == "title"


def test_bad_id_in_a_ground_truth_raises(spark):
    df = spark.createDataFrame([("5 x7 8.5",)], "gt string")
    with pytest.raises(Exception, match="not an article id"):
        df.select(parse_gt("gt")).collect()
    ok = spark.createDataFrame([(" 5 7 5\n", ), (None,), ("",)], "gt string").select(parse_gt("gt").alias("g")).collect()
    assert [r.g for r in ok] == [[5, 7], [], []]


def test_writing_a_method_again_replaces_it(spark, tmp_path):
    path = str(tmp_path / "ap")
    for method, ap in (("m", 0.5), ("n", 0.1), ("m", 0.75)):
        tables.write_ap(spark.createDataFrame([(1, ap)], "query_id long, ap double"), path, method)
    assert sorted((r.method, r.ap) for r in tables.read_ap(spark, path).collect()) == [("m", 0.75), ("n", 0.1)]


def test_ragged_vectors_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="invalid embedding"):
        tables.checked_embeddings(df).collect()
    assert tables.checked_embeddings(df.limit(1)).count() == 1


@pytest.mark.parametrize("html,text", [
    ("price < 100 and > 50", "price < 100 and > 50"),
    ('<p title="a>b">q</p>', "q"),
    ("&#8212; &rsquo; &euro; &#x41; &amp;lt; AT&T", "— ’ € A &lt; AT&T"),
    ("<ol><li>a<ul><li>x</li></ul></li><li>b</li></ol><ul><li>c</li></ul>", "1. a\n\n* x\n\n2. b\n\n* c"),
    ("<ol start=3><li>a</li></ol>", "3. a"),
    ("a<hr>b", "a\n\n* * *\n\nb"),
    ("<blockquote><p>one</p><p>two</p></blockquote>after", "> one\n> two\n\nafter"),
    ("<h2>T</h2>x&nbsp;y", "## T\n\nx y"),
])
def test_text_by_hand(spark, html, text):
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(html_to_text("h").alias("t")).first().t == text
