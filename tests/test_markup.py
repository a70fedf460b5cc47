"""The linear tag scanner: HTML's rules for tags and quotes by hand, and broken markup of a megabyte."""

import time

import pytest

from quarry.functions.markup import Scanner, attributes
from quarry.operators.html import STEPS, clean_document
from quarry.operators.markdown import document_text

TOKENS = [
    ("<p title=it's>One</p>", [("open", "<p title=it's>"), ("text", "One"), ("close", "</p>")]),
    ("a < b <c d=\"x>y\" e='z\"'>q</c >", [("text", "a "), ("text", "<"), ("text", " b "), ("open", "<c d=\"x>y\" e='z\"'>"), ("text", "q"), ("close", "</c >")]),
    ('<p a="b>c', [("open", '<p a="b>'), ("text", "c")]),
    ("<!-- x > --><!-- y", [("comment", "<!-- x > -->"), ("text", "<"), ("text", "!-- y")]),
    ("<script>a</p></SCRIPT >x<style>y", [("raw", "<script>a</p></SCRIPT >"), ("text", "x"), ("open", "<style>"), ("text", "y")]),
    ("<!DOCTYPE html><?php a?>", [("decl", "<!DOCTYPE html>"), ("decl", "<?php a?>")]),
    ("<<p>>", [("text", "<"), ("open", "<p>"), ("text", ">")]),
    ("<p", [("text", "<"), ("text", "p")]),
]


@pytest.mark.parametrize("text,expected", TOKENS)
def test_tokens(text, expected):
    found = list(Scanner(text).tokens())
    assert [(k, t) for k, _, t in found] == expected and "".join(t for _, _, t in found) == text


def test_attributes():
    assert attributes('<div class = foo ID="bar" id=2 data= checked/>') == {"class": "foo", "id": "bar", "data": "checked/"}
    assert attributes("<p title=it's>") == {"title": "it's"} and attributes('<img alt="a>b" src=x>') == {"alt": "a>b", "src": "x"}
    assert attributes("text") == {}


@pytest.mark.parametrize("piece", ['<p a="', "<script>", "<p ", "<!--", '<p a="b" ', '<p a="b" <', "<style><script>", "<", "<blockquote>", "<li>", "<div>"])
@pytest.mark.parametrize("tail", ["", ">", '">', 'c=">"'])
def test_broken_markup_takes_linear_time(piece, tail):
    def seconds(size):
        text = piece * (size // len(piece)) + tail
        start = time.process_time()
        clean_document(text, STEPS)
        document_text(text)
        return time.process_time() - start
    seconds(1000)
    assert seconds(400_000) < 12


CLEAN = [
    # an element that is not closed ends with the one around it
    ("<div><p></div>x", "x"),
    ("<div><p>a</div><div><span><p> </div>b", "<div><p>a</div>b"),
    ("<ul><li>a<li>b</ul>", "<ul><li>a<li>b</ul>"),
    ("<div><p title=it's>One</p></div>", "<div><p title=it's>One</p></div>"),
    ("<p><a href=x>t <b>u</p>v", "<p>t u</p>v"),
    ('<img alt="a<b">', "a&lt;b"),
    # panels and labels count at any depth, as the reference counts them; the tabset inside goes
    ('<div class="tabset"><label class="tab-label">A</label><label class="tab-label">B</label><div class="tab-panel"><p>1</p>'
     '<div class="tabset"><label class="tab-label">C</label><div class="tab-panel"><p>2</p></div></div></div>'
     '<div class="tab-panel"><p>3</p></div></div>end',
     "<p><strong>A</strong>: </p><p>1</p><p><strong>B</strong>: </p><p>2</p><p><strong>C</strong>: </p><p>3</p>end"),
    # a panel in a panel: its children follow, its own tags stay where they were
    ('<div class="tabset"><div class="tab-panel">a<div class="tab-panel">b</div>c</div></div>', 'a<div class="tab-panel"></div>cb'),
    # a tabset without panels inside a panel is unwrapped
    ('<div class="tabset"><div class="tab-panel">a<div class="tabset">x</div></div></div>', "ax"),
]


@pytest.mark.parametrize("html,expected", CLEAN)
def test_cleaning_by_hand(html, expected):
    assert clean_document(html, STEPS) == expected


def test_text_by_hand():
    assert document_text("<blockquote>a<blockquote>b</blockquote>c</blockquote>d").split() == "> a > > b > c d".split()
    assert document_text("<blockquote>open <p title=it's>x</p>").split() == ["open", "x"]
    assert document_text("<ol start=3><li>a<li>b</ol><ul><li>c</ul>").split("\n") == ["", "", "3. a", "4. b", "", "", "* c", ""]
    assert document_text("x <y & 1 < 2 &lt;b&gt;") == "x <y & 1 < 2 <b>"
