"""Spelling variants: automata and near words against brute force, and the whole operator against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from verdikt.llm import spelling
from verdikt.llm.common import CAPITALS

LOWER = str.maketrans(CAPITALS, CAPITALS.lower())


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(counts, times=10):
    """word: (form, root, n, n_near, form_n) by comparing all."""
    forms, rows = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= times * n else None
        rows[w] = (n, len(others))
    for w in counts:
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows[w] = (forms[w], root, *rows[w], counts[forms[w]] if forms[w] else None)
    return rows


def some_words(seed, alphabet, n, most=9):
    draw = random.Random(seed)
    return sorted({"".join(draw.choices(alphabet, k=draw.randint(1, most))) for _ in range(n)})


@pytest.mark.parametrize(("alphabet", "n"), [("ab", 300), ("abcé", 600), ("abcdefghijklmnopqrstuvwxyzÀÿ\U00010000", 400)])
def test_automaton(alphabet, n):
    words = some_words(n, alphabet, n)
    labels, at = spelling._labels(words, np.unique(spelling._points(words)))
    automaton = spelling.Automaton(labels, at)
    for number, (a, b) in enumerate(zip(at, at[1:])):
        state, total = np.zeros(1, int), 0
        for label in labels[a:b]:
            edge, there = automaton.step(state, np.array([label]))
            assert there[0]
            total, state = total + automaton.skip[edge][0], automaton.target[edge]
        assert automaton.final[state[0]] and total == number
    beginnings = {w[:k] for w in words for k in range(1, len(w) + 1)}
    assert len(automaton.final) == 1 + len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in beginnings})


def test_hash_clash(monkeypatch):
    """Hashes that fail to tell states apart are noticed, and others are taken."""
    words = some_words(7, "abc", 200)
    labels, at = spelling._labels(words, np.unique(spelling._points(words)))
    own, calls = spelling.mixed, []

    def bad(x, seed=0):
        calls.append(seed)
        return own(x, seed) & np.uint64(0xF if seed < 2 else 2**64 - 1)

    monkeypatch.setattr(spelling, "mixed", bad)
    automaton = spelling.Automaton(labels, at)
    assert max(calls) >= 2
    monkeypatch.setattr(spelling, "mixed", own)
    assert len(automaton.final) == len(spelling.Automaton(labels, at).final)


@pytest.mark.parametrize("bucket_words", [7, 50, 40_000])
def test_groups(spark, bucket_words):
    words = some_words(3, "abc", 350) + ["x" * 300, "x" * 299, "x" * 299 + "y", "zzzz", "zzzzz"]
    draw = random.Random(4)
    counts = {w: draw.choice([2, 3, 20, 20, 45, 300, 4000]) for w in words}
    rows = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    got = spelling.spelling_groups(rows, bucket_words=bucket_words).collect()
    assert {r.word: tuple(r)[1:] for r in got} == brute(counts) and len(got) == len(counts)


def test_ties_and_chains(spark):
    counts = {"abcdefgh": 2, "abcdefg": 20, "bcdefgh": 20, "abcdefgg": 1, "abcdef": 200, "abcde": 2000, "abcd": 20_000, "abc": 10**12, "ab": 10**13, "é": 5, "è": 50}
    rows = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    got = {r.word: tuple(r)[1:] for r in spelling.spelling_groups(rows).collect()}
    assert got == brute(counts) and got["abcdefgh"][:2] == ("abcdefg", "ab")


def counted(rows, error_every):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if error_every and h % error_every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            found[word] += len(word) >= 7
    return {w: n for w, n in found.items() if n >= 2}


@pytest.mark.parametrize("error_every", [None, 1, 3])
def test_documents(spark, documents, error_every):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.word: tuple(r)[1:] for r in spelling.group_spellings(documents, error_every=error_every).collect()}
    assert got == brute(counted(rows, error_every)) and got
    texts = [(n, f"Zurückgehend ÀÉÎÕÜÿß×÷x abcdefghi{'jk'[n % 2]} Straßenbahnen{n} " * 3) for n in range(40)] + [(None, "zurückgehend")]
    own = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.word: tuple(r)[1:] for r in spelling.group_spellings(own, error_every=error_every).collect()}
    assert got == brute(counted(texts, error_every))


def test_one_long_word(spark):
    rows = spark.createDataFrame([(1, "q" * 30_000 + " " + "q" * 30_000 + " " + "q" * 29_999 + " " + "q" * 29_999)], "doc_id long, text string")
    assert {(len(r.word), r.n_near) for r in spelling.group_spellings(rows).collect()} == {(30_000, 1), (29_999, 1)}


def test_nothing(nothing):
    assert spelling.group_spellings(nothing).collect() == []
