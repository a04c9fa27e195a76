"""Operators over texts against brute force, odd texts, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd_texts, words
from verdikt.llm import langid, pii, ppm
from verdikt.llm.common import CAPITALS, WHITE, chunks, utf8, word_hashes
from verdikt.llm.line_dedup import dedup_lines, run_lengths
from verdikt.llm.packing import fit_repeats, full_patterns, pack_documents, plan_packs

LOWER = str.maketrans(CAPITALS, CAPITALS.lower())


def test_word_hashes():
    texts = odd_texts()
    data, at = utf8(pa.array(texts))
    for limit in (8, 1 << 21):
        seen, hashes = {}, []
        for a, b in chunks(at, limit):
            got, bounds = word_hashes(data, at[a : b + 1])
            hashes += [got[bounds[i] : bounds[i + 1]].tolist() for i in range(b - a)]
        for text, own in zip(texts, hashes, strict=True):
            split = [w for w in re.split(f"[{WHITE}]+", (text or "").translate(LOWER)) if w]
            assert len(split) == len(own)
            for w, h in zip(split, own, strict=True):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def dropped(rows, least, min_length, first=False):
    keys = [[line.strip(WHITE).translate(LOWER) for line in (t or "").split("\n")] for _, t in rows]
    count = Counter(k for own in keys for k in set(own) if len(k) >= min_length)
    gone, seen = [], set()
    for own in keys:
        flags = []
        for k in own:
            common = count[k] >= least
            flags.append(common and not (first and k not in seen))
            seen.add(k) if common else None
        gone.append(flags)
    return gone


@pytest.mark.parametrize(("least", "min_length"), [(2, 1), (3, 1), (2, 0), (2, 5)])
def test_lines(documents, least, min_length):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    expected = []
    for (i, t), flags in zip(rows, dropped(rows, least, min_length), strict=True):
        kept = "\n".join(x for x, gone in zip((t or "").split("\n"), flags, strict=True) if not gone)
        expected.append((i, len(flags), sum(flags), kept if sum(flags) else t))
    got = dedup_lines(documents, min_length=min_length, min_documents=least, keep_first=False)
    assert set(documents.columns) <= set(got.columns)
    key = lambda r: (str(r[0]), str(r[3]))
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()], key=key) == sorted(expected, key=key)


def test_lines_keep_first(spark, nothing):
    rows = [(1, "b\na\nb"), (2, "a\nc"), (3, "c\nA\nd"), (None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.keep) for r in dedup_lines(df, min_documents=2).collect()}
    assert got == {1: ("b\na\nb", None), 2: ("c", [0, 1]), 3: ("", [0, 3]), None: ("d", None)}
    assert dedup_lines(nothing).count() == 0


def test_run_lengths(spark):
    rows = [([0],), ([0, 1, 2],), ([3],), ([0, 2, 3, 7],)]
    got = [r[0] for r in spark.createDataFrame(rows, "p array<int>").coalesce(1).select(run_lengths(F.col("p"))).collect()]
    assert got == [[0, 1], [0, 3], [3, 1], [0, 1, 1, 2, 3, 1]]


def test_packing(documents, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for capacity in (64, 1024):
        expected = []
        for i, t in rows:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
            at = 0
            while at < len(ids):
                to = at + ((len(ids) - at) % capacity or capacity)
                expected.append((str(i), at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())))
                at = to
        got = pack_documents(documents, path, capacity).collect()
        assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
        room = defaultdict(list)
        for r in got:
            room[r.sequence_id].append((r.offset, r.length))
        for own in room.values():
            end = 0
            for offset, length in sorted(own):
                assert offset == end
                end += length
            assert end <= capacity
        assert len(room) <= math.ceil(sum(x[2] for x in expected) / capacity) + 3
    assert pack_documents(nothing, path).count() == 0


def test_plan():
    draw = np.random.default_rng(3)
    for capacity, lengths in ((100, draw.integers(1, 101, 4000)), (1024, np.minimum(1024, draw.geometric(0.004, 20_000))), (10, np.full(7, 10)), (10, np.full(9, 3))):
        histogram = np.bincount(lengths, minlength=capacity + 1)
        packs = plan_packs(histogram, capacity)
        held = np.zeros(capacity + 1, int)
        for pack, times in packs:
            assert times > 0
            assert sum(pack) <= capacity
            for length in pack:
                held[length] += times
        assert (held == histogram).all()
        least = max(math.ceil(lengths.sum() / capacity), (lengths > capacity // 2).sum())
        assert sum(t for _, t in packs) <= least * 1.01 + 2
    patterns = full_patterns(np.arange(1, 11), 10)
    assert (patterns.sum(1) == 10).all()
    assert len({tuple(p) for p in patterns.tolist()}) == len(patterns) == 14
    x = fit_repeats(np.array([[6, 4, 0], [5, 5, 0]]), np.array([0, 0, 0, 0, 7.0, 8, 7, 0, 0, 0, 0]))
    assert np.allclose(x, [7, 4], atol=0.05)


def brute_base(text):
    d = lambda x: re.sub("[^0-9]", "", x)
    found = [("email", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) < 256 for x in m.group().split("."))]
    found += [("card", m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d(m.group())) <= 19 and pii.luhn(d(m.group()))]
    return found + [("phone", m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(d(m.group())) <= 15]


def test_pii_base():
    texts = ["a.b@c.d e@f@g.h i@j", "x@y.z@w.v", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.3.4 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 0000000000000", "+1 (456) 555-2186 +12 3 +1234567890123456 ++49 30 1234567-", "a@b.c" * 3, "1" * 9000, "1.1.1.1-2.2.2.2", "né@é.fr ñ+1 (234) 555-1234.", ""]
    for text in texts:
        assert [(k, s) for k in pii.KINDS for s in pii.base_spans(text)[k]] == brute_base(text), text


def test_pii(spark, nothing):
    draw = np.random.default_rng(5)
    rows = []
    for i in range(900):
        number = "".join(map(str, draw.integers(0, 10, 15)))
        number = next(number + c for c in "0123456789" if pii.luhn(number + c))
        said = [f"+1 ({draw.integers(200, 999)}) 555-{draw.integers(1000, 9999)}", f"{'.'.join(map(str, draw.integers(0, 256, 4)))}", number, f"{words(i, 1)[0]}.{i}@mail.example.com"][i % 4]
        rows.append((i, " ".join([*words(i, 8), said, *words(i + 1000, 8), f"version {i % 9}.{i % 7}.0 of {draw.integers(10**9, 10**10)}"])))
    hidden = {1000: "call (456) 555-2186 now", 1001: "write joe.doe [at] mail.example [dot] com now"}
    rows += [*hidden.items(), (1002, None), (1003, "built 2019-03-04 10.30"), (1003, "built 2019-03-04 10.30")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    got = defaultdict(list)
    for r in pii.find(df).collect():
        got[r.doc_id].append(r)
    for i, t in rows:
        r = got[i][0]
        base = brute_base(t or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, (a, b) in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _ in base) for kind in pii.KINDS]
        assert set(f"{k}:{a}:{b}" for k, (a, b) in base) <= set(r.spans.split(",")) | {""}
    assert sum(got[i][0].n_added for i in range(900)) <= 9
    assert got[1000][0].redacted == "call [phone] now"
    assert got[1001][0].redacted == "write [email] now"
    assert (got[1002][0].redacted, got[1003][0].n_added, len(got[1003])) == (None, 0, 2)
    assert pii.find(nothing).count() == 0


def test_pii_candidates():
    """Every rewritten form is proposed with its own span, alone and next to other numbers."""
    values = {"email": ["joe.doe@mail.example.com", "a@3x.4y.org"], "ip": ["10.0.0.1", "8.8.8.8", "192.168.100.200"], "card": ["4111111111111111", "378282246310005"], "phone": ["+1 (456) 555-2186", "+49 30 555 123 4567"]}
    for kind, own in values.items():
        for value in own:
            for lot in range(48):
                for form in pii._rewritten(kind, value, lot):
                    for before, after in (("see ", " now"), ("17 ", " ok"), ("2023 ", " 2023"), ("555-765-4321 ", " 4.5"), ("", "")):
                        if kind != "email" or before in ("see ", ""):
                            text = before + form + after
                            assert (kind, (len(before), len(before) + len(form))) in pii.candidates(text), text
    assert [s for k, s in pii.candidates("call 555-123-4567 555-765-4321") if k == "phone" and s in ((5, 17), (18, 30))] == [(5, 17), (18, 30)]
    assert len(pii.candidates("1 " * 20_000)) < 40 * 20_000


LANGUAGES = {"en": "the and of thing with", "de": "der und schach keit lich", "fr": "le étion queau chère", "es": "el ción ñado que llor"}


def test_language(spark, documents, nothing):
    draw = np.random.default_rng(2)
    rows = []
    for i in range(800):
        lang = list(LANGUAGES)[i % 4]
        rows.append((i, " ".join(draw.choice(LANGUAGES[lang].split(), 12)) + ".", lang if i % 5 else None))
    rows += [(900, None, "en"), (901, "12 34 !", "en"), (902, "", None), (903, "漢字", None), (904, "THE and Of", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.identify(df, F.col("doc_id") % 3 == 1).collect()}
    right = [got[i].lang_pred == list(LANGUAGES)[i % 4] for i in range(800) if i % 3 == 1]
    assert np.mean(right) > 0.98
    assert {i: got[i].lang_pred for i in (900, 901, 902)} == dict.fromkeys((900, 901, 902), "und")
    assert got[903].lang_pred in LANGUAGES
    assert got[904].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(documents, langid.fit(documents)).count() == documents.count()
    assert langid.predict(nothing, langid.fit(nothing)).count() == 0
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.family_of("xx") != langid.family_of("yy")


def brute_ppm(texts, held, order):
    """The model by dictionaries: counts of every context's symbols, escapes with exclusion."""
    sequences = [[257] * order + list((t or "").translate(LOWER).encode()) + [256] for t in texts]
    seen = defaultdict(Counter)
    for s, h in zip(sequences, held, strict=True):
        if not h:
            for i in range(order, len(s)):
                for k in range(order + 1):
                    seen[tuple(s[i - k : i])][s[i]] += 1
    scores = []
    for s in sequences:
        total = 0.0
        for i in range(order, len(s)):
            excluded = set()
            for k in range(order, -1, -1):
                here = {x: n for x, n in seen[tuple(s[i - k : i])].items() if x not in excluded} if tuple(s[i - k : i]) in seen else {}
                if not here:
                    continue
                n, t = sum(here.values()), len(here)
                if s[i] in here:
                    total += math.log10(here[s[i]] / (n + t))
                    break
                total += math.log10(t / (n + t))
                excluded |= set(here)
            else:
                total -= math.log10(257 - len(excluded))
        scores.append(total)
    return scores


@pytest.mark.parametrize("block_bytes", [16 << 20, 64])
def test_ppm(spark, nothing, block_bytes):
    texts = [None, "", "The cat sat.", "the cat\nsat on thé mat", "xyz", "The cat sat.", "  the   end ", " ".join(words(3, 200)), " ".join(words(4, 200)), "ZZZ qqq"]
    held = [i in (4, 8, 9) for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, h, 1) for i, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id long, text string, held boolean, score int")
    got = {r.doc_id: r for r in ppm.score_documents(df, F.col("held"), block_bytes=block_bytes).collect()}
    split = [[*re.findall(f"[^{WHITE}]+", (t or "").translate(LOWER)), None] for t in texts]
    counts = Counter(w for s, h in zip(split, held, strict=True) if not h for w in s)
    n, v = sum(counts.values()), len(counts)
    for i, score in enumerate(brute_ppm(texts, held, 4)):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(split[i]), sum(counts[w] > 0 for w in split[i]), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split[i]), rel_tol=1e-9)
        assert math.isclose(r.score, score, rel_tol=1e-9)
    assert ppm.score_documents(nothing, F.lit(False), block_bytes=block_bytes).count() == 0
    alone = ppm.score_documents(df.limit(3), F.lit(True), block_bytes=block_bytes).collect()
    assert all(r.n_known == 0 and math.isclose(r.score, -(len((texts[r.doc_id] or "").encode()) + 1) * math.log10(257)) for r in alone)


def test_odd_documents(documents):
    n = documents.count()
    assert ppm.score_documents(documents, F.col("doc_id") == 3).count() == n
    assert pii.find(documents).count() == n


def test_pii_long_text(spark):
    """A log of addresses: time grows with its length, and nothing is lost."""
    import time

    took = []
    for n in (10_000, 80_000):
        text = "10.0.0.1 - +49 30 1234567 -\n" * n
        base = pii.base_spans(text)
        began = time.perf_counter()
        marks = pii.covered(text, (s for k in pii.KINDS for s in base[k]))
        free = sum(not pii.touches(marks, span) for _, span in pii.candidates(text))
        took.append(time.perf_counter() - began)
        assert (len(base["ip"]), len(base["phone"]), free) == (n, n, 0)
    assert took[1] < 40 * took[0] + 1
    model = {k: (pii.Trees(np.zeros((2, len(pii.FEATURES))), np.array([0.0, 1.0])), -99.0) for k in pii.KINDS}
    long = "10.0.0.1 - ann at site dot org 4071 1234 555 0199 -\n" * 3000
    added = pii.added_spans([long], [pii.base_spans(long)], model)[0]
    spans = sorted(s for _, s in added)
    assert len(added) >= 6000 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_marks():
    marks = pii.covered("x" * 20, [(2, 5), (10, 11), (4, 7)])
    for a in range(20):
        for b in range(a + 1, 21):
            assert pii.touches(marks, (a, b)) == any(a < d and c < b for c, d in ((2, 5), (10, 11), (4, 7)))
