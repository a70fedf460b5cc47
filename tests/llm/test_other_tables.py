"""Vectors, pages, conversations, and the pipeline as a whole."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, chat, pages


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# ---------------------------------------------------------------- vectors

def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(20, 48))
    for f in ann.signs(48, 3):
        assert np.allclose(np.linalg.norm(ann.rotate(x, f), axis=1), np.linalg.norm(x, axis=1))


def test_recall_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = rows_of(ann.nearest(table, F.col("vec_id") % 100 == 0, block=7))  # several blocks of queries
    ids, x = zip(*[(r.vec_id, r.embedding) for r in table.collect()])
    ids, x = np.array(ids), np.array(x, dtype=float)
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(m[2] == d[ids == m[1]][0] for m in mine)
        hit, total = hit + len({m[1] for m in mine} & set(ids[best])), total + 10
    assert hit / total >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]),
            (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (2, [0.9, 0.1]), (100, [0.8, 0.1]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as codes", "2 as rank")
    got = rows_of(ann.nearest(df, F.col("vec_id") % 100 == 0, k=3))
    assert {r["vec_id"] for r in got} <= {0, 1, 2, 100}
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0][:2] == [1, 2]
    assert rows_of(ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0)) == []


@pytest.mark.parametrize("rows, dim", [(6, 64), (50, 64), (500, 64), (2000, 256)])
def test_recall_of_few_and_of_wide_vectors(spark, rows, dim):
    x = np.random.default_rng(rows).normal(size=(rows, dim))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = range(0, rows, max(1, rows // 100))
    got = {q: {} for q in asked}
    for r in ann.nearest(table, F.col("vec_id").isin(list(asked))).collect():
        got[r.query_id][r["rank"]] = r.vec_id
    hit = 0
    for q in asked:
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        assert sorted(got[q]) == list(range(1, min(10, rows - 1) + 1))
        hit += len(set(got[q].values()) & set(np.argsort(d)[:min(10, rows - 1)].tolist()))
    assert hit >= 0.9 * len(asked) * min(10, rows - 1)


def test_query_alone_in_its_buckets(spark):
    rows = [(0, [-1.0] + [0.0] * 63)] + [(i, [1.0] + [0.001 * i] + [0.0] * 62) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = rows_of(ann.nearest(df, F.col("vec_id") == 0, probe=96))
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(i, i) for i in range(1, 11)]


# ---------------------------------------------------------------- pages

def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 14))] for _ in range(2))
        at = pages.common_lines(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
        rest = iter(b)
        assert (np.diff(at) > 0).all() and all(a[i] in rest for i in at) and len(at) == lcs(a, b)


def test_article_without_its_surroundings(spark):
    page = ("<!DOCTYPE html><head><title>T</title></head><body><nav><a>Home</a></nav><div class='cookie-notice'>We use</div><header>Site</header>"
            "<article><header><h1>Head &amp; more</h1></header><p>One <b>bold</b>\n word<br>&nbsp;two<p>Three<aside>no</aside>"
            "<script>if (a < b) { '</p>' }</script><div class=\"ad\">buy</div><form>name <input></form><ul><li>x</li><li>y</li></ul>"
            "<section id='comments'><article>nice!</article></section></article><footer>&copy;</footer>")
    got = rows_of(pages.main_text(spark.createDataFrame([(1, "http://h/1", page)], "page_id long, url string, html string")))
    assert got[0]["text"] == "Head & more\nOne bold word two\nThree\nx\ny"
    assert got[0]["n_chars"] == len(got[0]["text"])


def test_pages_without_article_lose_what_they_share(spark):
    rows = [(1, "http://h/a/1", "<div>Home</div><div>About</div><div>Text one here</div><p>Copyright</p>"),
            (2, "http://h/a/2?x=1", "<div>Home</div><div>About</div><div>Text two</div><p>more</p><p>Copyright</p>"),
            (3, "http://g/", "<p>only</p>"), (4, None, None), (4, "", ""), (5, "http://[bad", "<p>odd url</p>"),
            (6, "http://h/zzz", "<div>Home</div><main><p>x <b>y</b>\n z</p><div class='comments'><p>nice</p></div></main>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as host", "3 as _row")
    got = sorted((r["page_id"], r["text"]) for r in rows_of(pages.main_text(df)))
    assert got == [(1, "Text one here"), (2, "Text two\nmore"), (3, "only"), (4, ""), (4, ""), (5, "odd url"), (6, "x y z")]
    assert rows_of(pages.main_text(df.limit(0))) == []


def test_copies_of_a_page_keep_their_text(spark):
    one = "<div>Home</div><p>Text one</p><p>Copyright</p>"
    rows = [(i, f"http://h/a?s={i}", one) for i in range(20)] + [(20, "http://h/mirror/a", one)]
    rows += [(21, "http://h/b", "<div>Home</div><p>Text two</p><p>Copyright</p>"), (22, "http://twice/", "<p>all</p>"), (23, "http://twice/x", "<p>all</p>"),
             (24, "http://part/a", "<p>x</p><p>y</p>"), (25, "http://part/b", "<p>x</p><p>y</p><p>z</p>")]
    got = {r["page_id"]: r["text"] for r in rows_of(pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")))}
    assert got == {**{i: "Text one" for i in range(21)}, 21: "Text two", 22: "all", 23: "all", 24: "x\ny", 25: "z"}


def test_given_pages_by_their_template(spark):
    import html
    import re
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in rows_of(pages.main_text(table))}
    for r in table.collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


# ---------------------------------------------------------------- chat

@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user", "<\\|im_end|>", "[\\\\INST]", "<<SYS>> x <</SYS>>",
                                  "a\\b\nc", "<s", "[INST", "<|a|><|b|>"])
def test_escape_round_trip(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    for control in ("<|im_end|>", "<|im_start|>", "</s>", "[INST]", "[/INST]", "<<SYS>>"):
        assert control not in hidden
    segment, a, b = chat.render_message(text, text)
    assert chat.parse_message(segment) == (text, text) and chat.unescape(segment[a:b]) == text


def test_folding_events(spark):
    log = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "he"), (1, 1, 2, "delta", "assistant", "llo"),
           (1, 1, 3, "regenerate", "assistant", "go"), (1, 1, 4, "delta", "assistant", "od"), (1, 0, 9, "edit", "user", "hey"),
           (2, None, None, None, None, None), (2, 5, 1, "delta", "assistant", "late"), (None, 0, 0, "message", "user", "x")]
    df = spark.createDataFrame(log, "conv_id long, position long, seq long, kind string, role string, text string")
    got = {r["conv_id"]: r for r in rows_of(chat.read_back(chat.transcripts(df.selectExpr("*", "1 as ord", "2 as formatted"))))}

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\nhey\nassistant\ngood\n") and got[1]["loss_sha256"] == sha("good")
    assert (got[1]["n_turns"], got[1]["loss_chars"]) == (2, 4)
    assert got[2]["turns_sha256"] == sha("\n\nassistant\nlate\n") and got[None]["n_turns"] == 1
    assert chat.transcripts(df.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, 0, 0, "message", "user", "a"), (1, 0, 1, "shout", "user", "b")], df.schema)
    with pytest.raises(Exception, match="unknown kind"):
        chat.transcripts(bad).collect()


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from quarry.llm import mixing, near_dedup, quality
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = cp.quality_stage(spark, docs, sf)
    assert good.columns == docs.columns
    scored = quality.score(docs, quality.train(docs, labels)).filter("predicted = 1")
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in scored.collect())
    single = cp.near_dedup_stage(spark, good, sf)
    kept = near_dedup.near_duplicates(good, 5, 80).filter("kept")
    assert sorted(r.doc_id for r in single.collect()) == sorted(r.doc_id for r in kept.collect())
    mixed = cp.mixing_stage(spark, single, sf)
    want = [r.doc_id for r in mixing.mix_rows(single).collect() for _ in range(r.copies)]
    assert mixed.columns == docs.columns and sorted(r.doc_id for r in mixed.collect()) == sorted(want)
    out = cp.run(spark, sf)
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_every_query_runs(spark):
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
