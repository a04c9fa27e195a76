"""Fill-in-middle against plain slicing of strings, and back."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import odd_texts
from verdikt.llm import fim

BORDERS = {"code point": r"(?s).", "word": r"^[ \t-\r]+|[^ \t-\r]+[ \t-\r]*", "line": r"[^\n]*\n|[^\n]+$"}


@pytest.mark.parametrize("unit", fim.UNITS)
@pytest.mark.parametrize("every", [1, 3, 1024])
def test_checkpoints(unit, every, monkeypatch):
    for block in (5, 1 << 16):
        monkeypatch.setattr(fim, "BLOCK", block)
        for text in [t or "" for t in odd_texts()]:
            if block == 5:
                text = text[:300]
            pieces = re.findall(BORDERS[unit], text)
            assert "".join(pieces) == text
            index = fim.Checkpoints(np.frombuffer(text.encode(), np.uint8), unit, every)
            assert (index.n, index.points, len(index.units)) == (len(pieces), len(text), -(-len(pieces) // every))
            for units in {0, 1, 2, 7, len(pieces) // 2, len(pieces) - 1, len(pieces)} - {-1}:
                before = "".join(pieces[:units])
                assert index.cut(units) == (len(before.encode()), len(before))


def expected(doc_id, text, rate=90, spm=20, unit="code point", seed="1"):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    pieces = re.findall(BORDERS[unit], text)
    n = len(pieces)
    if not text or any(m in text for m in fim.MARKERS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(pieces[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("unit", "rate"), [("code point", 90), ("word", 100), ("line", 50)])
def test_forms(documents, unit, rate):
    rows = documents.select("doc_id", "text", "n_chars", documents.lang.alias("form"), "keep", documents.k1.alias("n"))
    got = fim.fill_in_middle(rows, unit=unit, rate=rate)
    assert got.columns == ["doc_id", "text", "n_chars", "keep", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = got.withColumn("back", fim.restored(got.output, got.form)).collect()
    want = Counter((r.doc_id, r.text, *expected(r.doc_id, r.text, rate, unit=unit)) for r in documents.collect())
    assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    assert all(r.back == (r.text or "") for r in got)


def test_text_like_markers(spark):
    texts = ["a<P>b", "<M>", "<", "<S", "P>", "<P<S<M>" + "x" * 20, "<P><", "<<<<<<", ">>>S><P", "M>S>P>" * 9, "\0 <", "á<S" * 50]
    rows = spark.createDataFrame([(i, t) for i in range(40) for t in texts], "doc_id long, text string")
    got = fim.fill_in_middle(rows, rate=100, suffix_first=50)
    got = got.withColumn("back", fim.restored(got.output, got.form)).collect()
    assert all(r.back == r.text for r in got)
    assert {r.form for r in got if any(m in r.text for m in fim.MARKERS)} == {"plain"}
    assert {r.form for r in got if not any(m in r.text for m in fim.MARKERS)} == {"spm", "psm"}


def test_markers():
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "bc", "d"), ("aa", "b", "c"), ("abc", "b", "d")):
        with pytest.raises(ValueError):
            fim.checked(bad)


def test_nothing(nothing):
    assert fim.fill_in_middle(nothing).collect() == []
