import pytest

from quarry.operators.analyze import length_bin_lo
from quarry.operators.html import clean_html
from quarry.operators.markdown import html_to_text

CASES = [
    ("<body><p>a</p><p> </p><div><div></div>x</div><span>&nbsp;</span></body>", "<p>a</p><div>x</div>"),
    ("<body><label> </label><label>L</label><a href='x'>t <b>u</b></a><img alt=' A '><img><br>z</body>",
     "<label>L</label>t uA z"),
    ('<body><div class="a factoid">F</div><headline>H</headline><chunk>C</chunk></body>', "FHC"),
    ('<body><div class="spoiler"><label></label><div class="spoiler-text"> T1 </div>'
     '<div class="spoiler-content"><p>TEXT</p></div></div>after</body>', "<p><strong>T1</strong>: </p><p>TEXT</p>after"),
    ('<body><div class="spoiler"><div class="spoiler-text">T</div></div>gone</body>', "gone"),
    ('<body><div class="spoiler"><div class="spoiler-text">T</div><div class="spoiler-content"></div></div>g</body>', "g"),
    ('<body><div class="spoiler"><div class="spoiler-content"><p>X</p></div></div></body>', "<p>X</p>"),
    ('<body><div class="x tabset"><input><label class="tab-label">A</label><label class="tab-label">B</label>'
     '<div class="tab-panel"><p>P1</p></div><div class="tab-panel"></div></div></body>', "<p><strong>A</strong>: </p><p>P1</p>"),
    ('<body><div class="tabset"><label class="tab-label">A</label><div class="tab-panel"><p>P1</p></div>'
     '<div class="tab-panel"><p>P2</p></div></div></body>', "<p><strong>A</strong>: </p><p>P1</p><p>P2</p>"),
    ('<body><div class="tabset"><label class="tab-label">A</label><p>kept</p></div></body>',
     '<label class="tab-label">A</label><p>kept</p>'),
    ("<body><table><tr><td><table><tr><td> A </td><td>B</td></tr></table></td><td>T</td></tr></table>"
     "<table><tr><td> </td></tr></table></body>", "<table><tr><td>A B</td><td>T</td></tr></table>"),
    ("<html><head><script>var t='</p>';</script></head><body><!-- c --><p>x</p></body></html>", "<p>x</p>"),
    ("<div><b>open<p>y</p>", "<div><b>open<p>y</p>"),
    # a spoiler in a spoiler's content: the outer one first, then the inner one; nothing after it is lost
    ('<div class="spoiler"><div class="spoiler-text">A</div><div class="spoiler-content">before<div class="spoiler">'
     '<div class="spoiler-text">B</div><div class="spoiler-content"><p>in</p></div></div>after</div></div>end',
     "<p><strong>A</strong>: </p>before<p><strong>B</strong>: </p><p>in</p>afterend"),
    # a stray close shifts nothing: the nested table is still flattened
    ("</table><table><tr><td><table><tr><td>A</td></tr></table></td></tr></table>",
     "</table><table><tr><td>A</td></tr></table>"),
    ('<p title="a>b">q</p>', '<p title="a>b">q</p>'),
    ("<img alt=Foo width=3>x", "Foox"),
    ("<p>&emsp;</p><div>&#8195;&#xa0;</div><p>y</p>", "<p>y</p>"),
    ("<div class=factoid>F</div>", "F"),
    ("price < 100 <b>x</b>", "price < 100 <b>x</b>"),
    ('<table><tr><td><table><tr><td><div class="spoiler"><p class="spoiler-text">T</p><div class="spoiler-content">c</div>'
     '</div></td></tr></table></td></tr></table>', "<table><tr><td>T : c</td></tr></table>"),
]


@pytest.mark.parametrize("html,expected", CASES)
def test_clean_html(spark, html, expected):
    df = spark.createDataFrame([(1, html)], "article_id long, body string")
    assert clean_html(df).first()["body"] == expected


def test_null_body_stays_null(spark):
    df = spark.createDataFrame([(1, None, "t")], "article_id long, body string, title string")
    row = clean_html(df).first()
    assert row["body"] is None and row["title"] == "t"


def test_rows_with_one_id_or_none_stay_apart(spark):
    df = spark.createDataFrame([(1, "<p>aaa</p>"), (1, "<p>bbb</p>"), (None, "<p>c</p><p> </p>")], "article_id long, body string")
    assert sorted(r.body for r in clean_html(df).collect()) == ["<p>aaa</p>", "<p>bbb</p>", "<p>c</p>"]


def test_cleaning_needs_no_exchange(spark):
    df = spark.createDataFrame([(1, "x")], "article_id long, body string")
    assert "Exchange" not in clean_html(df)._jdf.queryExecution().executedPlan().toString()


def test_html_to_text(spark):
    df = spark.createDataFrame([("<h2>T</h2><p>a &amp; b</p><ul><li>x</li></ul>   \n\n\n\n<p>c&nbsp;</p>",)], "h string")
    # T2 collapses space runs and 3+ newlines separately, so a lone space between newline runs stays
    assert df.select(html_to_text("h").alias("t")).first()["t"] == "## T\n\na & b\n\n* x\n\n \n\nc"


def test_length_bins(spark):
    df = spark.createDataFrame([(0,), (499,), (500,), (999,), (50000,), (10**6,)], "n long")
    assert [r.lo for r in df.select(length_bin_lo("n").alias("lo")).collect()] == [0, 0, 500, 500, 50000, 50000]
