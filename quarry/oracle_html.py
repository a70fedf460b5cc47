"""DuckDB twins of the HTML cleanup (H1-H14) and text conversion (T1-T2), for the correctness gate.

They mirror quarry.operators.html / markdown step by step on a token table; used only by the
catalog's oracle SQL.
"""

from __future__ import annotations

from quarry.functions.text import WS_CHARS, WS_CLASS
from quarry.operators import html as H
from quarry.operators import markdown as M
from quarry.sources.fixtures import HTML_WRAPPERS, SYNTHETIC_ID_OFFSET


# Patterns of this twin's own: the engine scans tags without regular expressions over whole documents.
TOKEN_PATTERN = r"""<[A-Za-z/!?](?:"[^"]*"|'[^']*'|[^>"'])*>|<|[^<]+"""
NBSP_ENTITIES = r"&nbsp;|&#160;|&#[xX][aA]0;"
FLAT_PREP = [(r"(?s)<!--.*?-->", ""),
             (r"(?is)<script\b[^>]*>.*?</script\s*>", ""),
             (r"(?is)<style\b[^>]*>.*?</style\s*>", "")]
FLAT_STEPS = {
    "images": [(r'(?i)<img\b[^>]*?\salt\s*=\s*"' + WS_CLASS + r'*([^"]*?)' + WS_CLASS + r'*"[^>]*>', "$1"),
               (r"(?i)<img\b[^>]*?\salt\s*=\s*'" + WS_CLASS + r"*([^']*?)" + WS_CLASS + r"*'[^>]*>", "$1"),
               (r"(?i)<img\b[^>]*?\salt\s*=\s*([^\s\"'=<>`]+)[^>]*>", "$1"),
               (r"(?i)<img\b[^>]*>", "")],
    "breaks": [(r"(?i)<br\b[^>]*>", " ")],
    "inputs": [(r"(?i)<input\b[^>]*>", "")],
    "headline_chunk": [(r"(?i)</?(headline|chunk)\b[^>]*>", "")],
}
_BLOCK = "p|div|ul|ol|table|tbody|thead|article|section|header|footer|nav|main|aside|blockquote|pre"
_ATTRS = r"""(?:"[^"]*"|'[^']*'|[^>"'])*"""
TEXT_RULES = (
    [(rf"(?is)<!--.*?-->|<script\b{_ATTRS}>.*?</script\s*>|<style\b{_ATTRS}>.*?</style\s*>", "")]
    + [(rf"(?i)<h{n}\b{_ATTRS}>", "\n\n" + "#" * n + " ") for n in range(1, 7)]
    + [(r"(?i)</h[1-6]\s*>", "\n\n"),
       (rf"(?i)<li\b{_ATTRS}>", "\n* "),
       (r"(?i)</t[dh]\s*>", " | "),
       (rf"(?i)</li\s*>|</?tr\b{_ATTRS}>|<br\b{_ATTRS}>|</?({_BLOCK})\b{_ATTRS}>", "\n"),
       (rf"<[A-Za-z/!?]{_ATTRS}>", "")])

# The character references that fixture H holds ('&amp;' last, so that nothing is decoded twice).
ENTITIES = [("&nbsp;", " "), ("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&#39;", "'"), ("&lt;?", "<"), ("&gt;?", ">"),
            ("&amp;?", "&")]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(col: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({col}, {q(pattern)}, {q(repl.replace('$1', chr(92) + '1'))}, 'g')"


def strip(col: str) -> str:
    return f"trim({col}, {q(WS_CHARS)})"


def fixture_sql() -> str:
    """CTE h_src(article_id, title, body): pages plus wrapped documents."""
    cases = []
    for i, tpl in enumerate(HTML_WRAPPERS):
        parts = []
        for j, part in enumerate(tpl.split("TEXT")):
            if j:
                parts.append("replace(text, '&', '&amp;')")
            for k, sub in enumerate(part.split("LANG")):
                if k:
                    parts.append("lang")
                parts.append(q(sub))
        built = " || ".join(["'<html><head><title>'", "lang", "'</title></head><body>'"] + parts + ["'</body></html>'"])
        cases.append(f"WHEN doc_id % {len(HTML_WRAPPERS)} = {i} THEN {built}")
    return f"""
h_src AS (
  SELECT page_id AS article_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html AS body FROM pages
  UNION ALL
  SELECT doc_id + {SYNTHETIC_ID_OFFSET} AS article_id, lang AS title, CASE {' '.join(cases)} END AS body FROM documents)
"""


def _flat(col: str, steps) -> str:
    out = col
    for pattern, repl in FLAT_PREP:
        out = rx(out, pattern, repl)
    for step in steps:
        for pattern, repl in FLAT_STEPS.get(step, []):
            out = rx(out, pattern, repl)
    return out


NB = "(nbk = 1)"


def has(cls: str) -> str:
    return f"(cls & {H.CLASS_BITS[cls]} <> 0)"
PAIR = "PARTITION BY doc, name, depth ORDER BY pos"
RUN = "PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BEFORE = "PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
FULL = "ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
COLS = "doc, pos, tok, kind, name, cls, nbk, depth, partner"
OK = (f"(partner IS NOT NULL AND partner = CASE WHEN kind = 'open' THEN lead(pos) OVER ({PAIR}) "
      f"WHEN kind = 'close' THEN lag(pos) OVER ({PAIR}) END)")


class _Chain:
    def __init__(self, prefix: str):
        self.p, self.n, self.ctes = prefix, 0, []

    def add(self, body: str) -> str:
        self.n += 1
        name = f"{self.p}{self.n}"
        self.ctes.append(f"{name} AS ({body})")
        return name

    def cover(self, src: str, sel: str, out: str) -> str:
        """src + ok + out (sweep over selected pairs). sel may use _ok."""
        a = self.add(f"SELECT *, {OK} AS _ok FROM {src}")
        return self.add(f"SELECT *, sum(CASE WHEN ({sel}) AND kind = 'open' THEN 1 ELSE 0 END) OVER ({RUN}) - "
                        f"coalesce(sum(CASE WHEN ({sel}) AND kind = 'close' THEN 1 ELSE 0 END) OVER ({BEFORE}), 0) AS {out} FROM {a}")

    def enclosing(self, src: str, sel: str, out: str) -> str:
        a = self.cover(src, sel, "_cv")
        return self.add(f"SELECT * EXCLUDE (_cv), CASE WHEN _cv > 0 THEN last_value(CASE WHEN ({sel}) AND kind = 'open' "
                        f"THEN pos END IGNORE NULLS) OVER ({RUN}) END AS {out} FROM {a}")

    def finish(self, src: str) -> str:
        return self.add(f"SELECT {COLS} FROM {src}")

    def remove_empty(self, src: str, tags) -> str:
        a = self.add(f"SELECT *, sum(CASE WHEN {NB} THEN 1 ELSE 0 END) OVER ({RUN}) AS _nb FROM {src}")
        b = self.add(f"SELECT *, {OK} AND (CASE WHEN kind = 'open' THEN lead(_nb) OVER ({PAIR}) "
                     f"WHEN kind = 'close' THEN lag(_nb) OVER ({PAIR}) END) = _nb AS _empty FROM {a}")
        tl = ", ".join(q(x) for x in tags)
        c = self.cover(b, f"name IN ({tl}) AND _empty", "_rm")
        return self.finish(self.add(f"SELECT * FROM {c} WHERE _rm = 0"))

    def links(self, src: str) -> str:
        c = self.cover(src, "name = 'a' AND _ok", "_in")
        return self.finish(self.add(f"SELECT * FROM {c} WHERE _in = 0 OR kind IN ('text', 'html')"))

    def factoids(self, src: str) -> str:
        a = self.add(f"SELECT *, {OK} AS _ok FROM {src}")
        return self.finish(self.add(
            f"SELECT * FROM {a} WHERE NOT (name = 'div' AND {has('factoid')} AND "
            f"(kind = 'open' OR (kind = 'close' AND _ok)))"))

    def spoilers(self, src: str) -> str:
        a = self.enclosing(src, f"name = 'div' AND {has('spoiler')} AND _ok", "_sp")
        a = self.add(f"SELECT * EXCLUDE (_ok), {OK} AS _ok FROM {a}")
        op = "kind = 'open' AND _ok AND _sp IS NOT NULL AND pos <> _sp"
        b = self.add(f"SELECT *, min(CASE WHEN {op} AND {has('spoiler-content')} THEN pos END) "
                     f"OVER (PARTITION BY doc, _sp) AS _co, min(CASE WHEN {op} AND {has('spoiler-text')} "
                     f"THEN pos END) OVER (PARTITION BY doc, _sp) AS _to FROM {a}")
        c = self.add(f"SELECT *, max(CASE WHEN pos = _co THEN partner END) OVER (PARTITION BY doc, _sp) AS _cc, "
                     f"max(CASE WHEN pos = _to THEN partner END) OVER (PARTITION BY doc, _sp) AS _tc FROM {b}")
        d = self.add(f"SELECT *, count(CASE WHEN pos > _co AND pos < _cc THEN 1 END) OVER (PARTITION BY doc, _sp) AS _kids, "
                     f"array_to_string(list_filter(list(CASE WHEN pos > _to AND pos < _tc AND kind = 'text' THEN {strip('tok')} END) "
                     f"OVER (PARTITION BY doc, _sp {FULL}), lambda v: v IS NOT NULL), '') AS _title FROM {c}")
        head = "(pos = _co AND _kids > 0 AND _title <> '')"
        e = self.add(f"SELECT * FROM {d} WHERE _sp IS NULL OR (_kids > 0 AND pos > _co AND pos < _cc) OR {head}")
        return self.finish(self.add(
            f"SELECT doc, pos, CASE WHEN {head} THEN '<p><strong>' || _title || '</strong>: </p>' ELSE tok END AS tok, "
            f"CASE WHEN {head} THEN 'html' ELSE kind END AS kind, name, cls, CASE WHEN {head} THEN 1 ELSE nbk END AS nbk, "
            f"depth, partner FROM {e}"))

    def tabsets(self, src: str) -> str:
        a = self.enclosing(src, f"name = 'div' AND {has('tabset')} AND _ok", "_ts")
        is_panel = f"(name = 'div' AND {has('tab-panel')})"
        is_label = f"(name = 'label' AND {has('tab-label')})"
        a = self.add(f"SELECT * EXCLUDE (_ok) FROM {a}")
        a = self.enclosing(a, f"{is_panel} AND _ok AND _ts IS NOT NULL", "_pn")
        a = self.add(f"SELECT * EXCLUDE (_ok) FROM {a}")
        a = self.enclosing(a, f"{is_label} AND _ok AND _ts IS NOT NULL", "_lb")
        opened = "(kind = 'open' AND _ok AND _ts IS NOT NULL AND pos <> _ts)"
        b = self.add(f"SELECT *, array_to_string(list_filter(list(CASE WHEN _lb IS NOT NULL AND pos <> _lb AND kind = 'text' "
                     f"THEN {strip('tok')} END) OVER (PARTITION BY doc, _ts, _lb {FULL}), lambda v: v IS NOT NULL), '') AS _lt FROM {a}")
        c = self.add(f"SELECT *, list_filter(list(CASE WHEN {opened} AND {is_label} THEN _lt END) OVER (PARTITION BY doc, _ts {FULL}), "
                     f"lambda v: v IS NOT NULL) AS _labels, count(CASE WHEN {opened} AND {is_panel} THEN 1 END) "
                     f"OVER (PARTITION BY doc, _ts) AS _np, CASE WHEN {opened} AND {is_panel} THEN count(CASE WHEN {opened} "
                     f"AND {is_panel} THEN 1 END) OVER (PARTITION BY doc, _ts ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING "
                     f"AND CURRENT ROW) END AS _pi FROM {b}")
        inside = "(_pn IS NOT NULL AND pos <> _pn AND NOT (kind = 'close' AND partner = _pn))"
        d = self.add(f"SELECT *, count(CASE WHEN {inside} THEN 1 END) OVER (PARTITION BY doc, _ts, _pn) AS _kids, "
                     f"CASE WHEN _pi <= len(_labels) THEN _labels[_pi] ELSE '' END AS _title FROM {c}")
        head = f"({opened} AND {is_panel} AND _kids > 0 AND _title <> '')"
        keep = (f"_ts IS NULL OR (_np = 0 AND pos <> _ts AND NOT (kind = 'close' AND partner = _ts)) "
                f"OR (_np > 0 AND (({inside} AND _kids > 0) OR {head}))")
        e = self.add(f"SELECT *, {head} AS _head FROM {d} WHERE {keep}")
        return self.finish(self.add(
            f"SELECT doc, pos, CASE WHEN _head THEN '<p><strong>' || _title || '</strong>: </p>' ELSE tok END AS tok, "
            f"CASE WHEN _head THEN 'html' ELSE kind END AS kind, name, cls, CASE WHEN _head THEN 1 ELSE nbk END AS nbk, "
            f"depth, partner FROM {e}"))

    def nested_tables(self, src: str) -> str:
        a = self.enclosing(src, "name = 'table' AND depth = 2 AND _ok", "_nt")
        b = self.add(f"SELECT *, CASE WHEN _nt IS NOT NULL AND kind = 'text' AND {NB} THEN {strip('tok')} END AS _pc FROM {a}")
        c = self.add(f"SELECT *, min(CASE WHEN _pc IS NOT NULL THEN pos END) OVER (PARTITION BY doc, _nt) AS _first FROM {b} "
                     f"WHERE _nt IS NULL OR _pc IS NOT NULL")
        return self.finish(self.add(
            f"SELECT doc, pos, CASE WHEN _nt IS NULL THEN tok WHEN pos = _first THEN _pc ELSE ' ' || _pc END AS tok, "
            f"kind, name, cls, nbk, depth, partner FROM {c}"))

    def body(self, src: str) -> str:
        a = self.add(f"SELECT *, min(CASE WHEN name = 'body' AND kind = 'open' THEN pos END) OVER (PARTITION BY doc) AS _bo, "
                     f"{OK} AS _ok FROM {src}")
        b = self.add(f"SELECT *, max(CASE WHEN pos = _bo AND _ok THEN partner END) OVER (PARTITION BY doc) AS _bc FROM {a}")
        return self.finish(self.add(f"SELECT * FROM {b} WHERE _bo IS NULL OR (pos > _bo AND (_bc IS NULL OR pos < _bc))"))


def clean_html_sql(src: str, id_col: str, body_col: str, prefix: str, steps=None) -> tuple[str, str]:
    """CTEs cleaning ``src``(id_col, body_col); returns (cte_text, name of the (doc, html) CTE)."""
    steps = H.STEPS if steps is None else [s for s in H.STEPS if s in steps]
    ch = _Chain(prefix)
    flat = ch.add(f"SELECT {id_col} AS doc, {_flat(body_col, steps)} AS html FROM {src}")
    raw = ch.add(f"SELECT doc, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS pos FROM ("
                 f"SELECT doc, regexp_extract_all(html, {q(TOKEN_PATTERN)}) AS toks FROM {flat})")
    name = "lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9:_-]*)', 1))"
    openlike = "regexp_matches(tok, '^<[A-Za-z]')"
    void = ", ".join(q(v) for v in H.VOID_TAGS)
    kind = (f"CASE WHEN regexp_matches(tok, '^</[A-Za-z]') THEN 'close' WHEN {openlike} AND ({name} IN ({void}) "
            f"OR regexp_matches(tok, '/\\s*>$')) THEN 'void' WHEN {openlike} THEN 'open' "
            f"WHEN regexp_matches(tok, '^<[!?]') THEN 'decl' ELSE 'text' END")
    cls_text = (f"concat_ws(' ', regexp_extract(tok, {q(chr(40) + '?i)' + r'''\sclass\s*=\s*"([^"]*)"''')}, 1), "
                f"regexp_extract(tok, {q('(?i)' + chr(92) + 'sclass' + chr(92) + 's*=' + chr(92) + 's*' + chr(39) + '([^' + chr(39) + ']*)' + chr(39))}, 1))")
    cls = f"regexp_split_to_array({cls_text}, {q(WS_CLASS + '+')})"
    mask = " + ".join(f"list_contains({cls}, {q(c)})::INT * {bit}" for c, bit in H.CLASS_BITS.items())
    blank = f"regexp_matches({rx('tok', NBSP_ENTITIES, ' ')}, {q('^' + WS_CLASS + '*$')})"
    a = ch.add(f"SELECT doc, pos, tok, {kind} AS kind, CASE WHEN {openlike} OR starts_with(tok, '</') THEN {name} END AS name, "
               f"CASE WHEN {kind} = 'open' THEN {mask} ELSE 0 END AS cls, "
               f"({kind} = 'text' AND NOT {blank})::INT AS nbk FROM {raw}")
    delta = "CASE WHEN kind = 'open' THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END"
    b = ch.add(f"SELECT *, CASE WHEN kind = 'open' THEN r WHEN kind = 'close' THEN r + 1 END AS depth FROM ("
               f"SELECT *, sum({delta}) OVER (PARTITION BY doc, name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING "
               f"AND CURRENT ROW) AS r FROM {a})")
    nxt = f"(kind = 'open' AND lead(kind) OVER ({PAIR}) = 'close')"
    prv = f"(kind = 'close' AND lag(kind) OVER ({PAIR}) = 'open')"
    t = ch.add(f"SELECT doc, pos, tok, kind, name, CASE WHEN {prv} THEN lag(cls) OVER ({PAIR}) ELSE cls END AS cls, nbk, depth, "
               f"CASE WHEN {nxt} THEN lead(pos) OVER ({PAIR}) WHEN {prv} THEN lag(pos) OVER ({PAIR}) END AS partner FROM {b}")
    for step in steps:
        if step == "empty_labels":
            t = ch.remove_empty(t, ["label"])
        elif step == "links":
            t = ch.links(t)
        elif step == "empty_tags":
            t = ch.remove_empty(t, H.EMPTY_TAGS)
        elif step == "factoids":
            t = ch.factoids(t)
        elif step == "spoilers":
            t = ch.spoilers(t)
        elif step == "tabsets":
            t = ch.tabsets(t)
        elif step == "nested_tables":
            t = ch.nested_tables(t)
        elif step == "empty_tables":
            t = ch.remove_empty(t, ["table"])
        elif step == "body":
            t = ch.body(t)
    out = ch.add(f"SELECT doc, string_agg(tok, '' ORDER BY pos) AS html FROM {t} GROUP BY doc")
    res = ch.add(f"SELECT s.{id_col} AS article_id, CASE WHEN s.{body_col} IS NULL THEN NULL ELSE coalesce(o.html, '') END AS body "
                 f"FROM {src} s LEFT JOIN {out} o ON o.doc = s.{id_col}")
    return ",\n".join(ch.ctes), res


def html_to_text_sql(col: str) -> str:
    out = col
    for pattern, repl in TEXT_RULES:
        out = rx(out, pattern, repl)
    for pattern, char in ENTITIES:
        out = rx(out, pattern, char)
    return collapse_sql(out)


def collapse_sql(col: str) -> str:
    out = col
    for pattern, repl in M.COLLAPSE_RULES:
        out = rx(out, pattern, repl)
    return strip(out)
