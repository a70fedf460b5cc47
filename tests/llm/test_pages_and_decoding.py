"""Page markup that ends elements early or marks too much, broken markup in linear time, and decoding from ids alone."""

import random
import time
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe, pages

INSIDE = [
    ('<div class="entry-content no-sidebar"><p>All of it</p></div><p>tail</p>', "All of it\ntail"),
    ('<h2 id="cookies">Baking cookies</h2><p>x</p>', "Baking cookies\nx"),
    ('<section id="related-work"><h2>Related work</h2><p>w</p></section>', "Related work\nw"),
    ('<p class="ad">buy<p>Real text<p>More', "Real text\nMore"),
    ('<ul><li class="share">Share<li>real</ul><p>more</p>', "real\nmore"),
    ("<p title=it's>One</p><p>Two it's</p>", "One\nTwo it's"),
    ('<p title="a>One</p><p>Two</p>', "One\nTwo"),
    ("<table><tr><td class=ad>x<td>y<tr><td>z</table>", "y\nz"),
    ('a<script>var x = "</p>"</script>b &amp; c', "ab & c"),
    ("<dl><dt>t<dd class=promo>no<dt>u<dd>yes</dl>", "t\nu\nyes"),
    ("<aside><article>promo</article></aside><p>t</p>", "t"),
    ("<p>a <b>b</b>  c<br>d<!-- x --></p><form>f</form><noscript>n", "a b c d\nn"),
    ("<header>byline</header><footer>no</footer><p>t</p>", "byline\nt"),
    ('<div class="comments"><article>reader</article></div><p>t</p>', "t"),
]


@pytest.mark.parametrize("html,expected", INSIDE)
def test_nothing_but_marked_elements_goes(html, expected):
    page = f"<html><head><title>T</title></head><body><nav>menu</nav><article>{html}</article><footer>f</footer></body></html>"
    assert pages.marked_text(pages.blocks(page)) == expected


def test_larger_of_article_and_main_part():
    text = lambda page: pages.marked_text(pages.blocks(page))
    assert text("<main><h1>T</h1><p>Long main text</p><article>teaser</article></main>") == "T\nLong main text\nteaser"
    assert text("<main><h1>T</h1><article>the long article</article></main>") == "the long article"
    assert text("<nav><ul><li>x<article><p>text</p></article>") == "text"
    assert text("") == "" and text("<p>neither</p>") is None


@pytest.mark.parametrize("piece", ['<p a="', "<script>", "<div><p>", "<li>", "<table><tr><td>", "<p class=ad>x", "<nav><article>", "<", "<!--"])
def test_broken_pages_take_linear_time(piece):
    pages.blocks(piece * 100)
    start = time.process_time()
    pages.blocks(piece * (200_000 // len(piece)))
    assert time.process_time() - start < 10


def test_decoding_takes_ids_alone(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, mine, r = Tokenizer.from_file(path), bpe.WordBpe(path), random.Random(5)
    for _ in range(300):
        ids = [r.randrange(tok.get_vocab_size()) for _ in range(r.randint(0, 20))]
        assert mine.decode(array("I", ids).tobytes()) == tok.decode(ids, skip_special_tokens=False)
    letters = "aB cDé'ÉßŒœ\n\t\r.,!$×÷ÿŁ0 9\x1c\x85漢😀<|endoftext|>İſŉ's'LL_`{[\\]^-"
    for _ in range(5000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 30))) + r.choice(["", "<|endoftext|>", "<|startoftext|>x"])
        want = tok.encode(text, add_special_tokens=False).ids
        assert list(memoryview(mine.encode(text)).cast("I")) == want, text
    df = spark.createDataFrame([(1, bytearray(array("I", [320, 49407, 2]).tobytes())), (2, bytearray(b"")), (3, None)], "i long, ids binary")
    got = {x.i: x.decoded for x in bpe.bpe_decode(df, path).collect()}
    assert got == {1: tok.decode([320, 49407, 2], skip_special_tokens=False), 2: "", 3: None}
