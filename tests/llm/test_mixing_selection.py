"""Which rows the mix takes, with keys, order, epochs and both fillings recomputed row by row."""

import math
import re

import regex

from quarry.llm import mixing


def selection_by_hand(rows, targets):
    """rows: (id, text hash, size, source, u) -> copies by row."""
    out = {}
    for source, target in targets.items():
        own = [r for r in rows if r["source"] == source]
        total = sum(r["size"] for r in own)
        epochs = math.floor(target / total) if total else 0
        rest = target - epochs * total if epochs < 2 else 0.0
        own.sort(key=lambda r: (r["key"], r["doc_id"], r["text_hash"]))
        before, extra = 0, set()
        for r in own:
            if r["size"] and before + r["size"] / 2 <= rest:
                extra.add(r["at"])
            before += r["size"]
        gap = rest - sum(r["size"] for r in own if r["at"] in extra)
        before = 0
        for r in own:
            if r["at"] not in extra and 0 < r["size"] <= gap:
                if before + r["size"] / 2 <= gap:
                    extra.add(r["at"])
                before += r["size"]
        for r in own:
            out[r["at"]] = epochs + (r["at"] in extra)
    return out


def test_rows_are_taken_by_key_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.createOrReplaceTempView("mix_docs")
    u = "(shiftrightunsigned(xxhash64(20240, doc_id, crc32(cast(text as binary))), 11) + 1) / 9007199254740992D"
    rows = []
    for at, r in enumerate(spark.sql(f"select doc_id, text, source, xxhash64(coalesce(text, '')) as text_hash, {u} as u from mix_docs").collect()):
        text = r.text or ""
        odd = len(regex.findall(r"[^\p{L}\p{N}\s.,;:!?'()-]", text))
        weight = max(0.01, (1 - odd / max(len(text), 1)) ** 4) if r.text is not None else 1.0
        rows.append({"at": at, "doc_id": r.doc_id, "text_hash": r.text_hash, "source": r.source, "key": -math.log(r.u) / weight,
                     "size": len(re.findall("[^\x20\x09-\x0d]+", text))})
    got = [r.asDict() for r in mixing.mix_rows(docs).collect()]
    targets = {r["source"]: r["target"] for r in got}
    want = selection_by_hand(rows, targets)
    assert (sorted((r["doc_id"], r["text_hash"], r["copies"]) for r in got)
            == sorted((r["doc_id"], r["text_hash"], want[r["at"]]) for r in rows))
    # a gap before a long row is filled: no source is further away than by half of any row that would still have fitted
    for source, target in targets.items():
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own) / 2
