"""Near duplicates, mixtures, reputations and the pipeline."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from verdikt.llm.mixing import budgets, mix
from verdikt.llm.common import utf8, word_hashes
from verdikt.llm.order_minhash import banded_matches, components, drop_near_duplicates, folded, labelled, near_duplicates, rising, shingles, signature, similar, sketches
from verdikt.llm.url_reputation import beta_below, host_of, judge_urls, path_of


def edited(text, seed, edits):
    draw, own = np.random.default_rng(seed), list(text)
    for at in draw.choice(len(own), edits, replace=False):
        own[at] = f"new{draw.integers(10**6)}"
    return own


def jaccard(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in (a, b))
    return len(a & b) / len(a | b)


def test_near_duplicates(spark):
    texts, group = [], []
    for g in range(60):
        base = words(g, 200 + g)
        family = [base, base, *(edited(base, 100 * g + i, 3) for i in range(3)), base[:-4]]
        texts += family
        group += [g] * len(family)
    texts += [words(10_000 + i, 150) for i in range(100)]
    shared = words(77, 60)
    texts += [shared + words(20_000 + i, 200) for i in range(80)]  # one passage, else different
    rows = [(i, " ".join(t), 1) for i, t in enumerate(texts)] + [(None, None, 1), (5000, None, 1), (5001, "", 1), (5002, "one two", 1), (5003, "One  two", 1), (5004, "one two three", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t int").repartition(7)
    got = {r.id: r for r in near_duplicates(df).collect()}
    assert len(got) == len(rows)
    label = {}
    for a in range(len(texts)):
        label.setdefault(got[a].class_id, set()).add(a)
    for g in range(60):
        own = [i for i, x in enumerate(group) if x == g]
        assert len({got[i].class_id for i in own if jaccard(texts[own[0]], texts[i]) >= 0.8}) == 1
    for members in label.values():  # nobody without a near one
        for a in members:
            assert len(members) == 1 or any(jaccard(texts[a], texts[b]) >= 0.79 for b in members - {a})
    assert got[0].class_id == 0
    assert len({got[i].class_id for i in (5000, 5001, 5002)}) == 3
    assert got[5002].class_id == got[5003].class_id != got[5004].class_id
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert kept.count() == len({r.class_id for r in got.values() if r.class_id is not None}) + 1


def test_hot_near_duplicates(spark, documents, nothing):
    base = words(1, 120)
    rows = [(i, " ".join(edited(base, i, 1)) if i % 2 else " ".join(base)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.class_id for r in near_duplicates(df).collect()} == {0}
    assert near_duplicates(nothing).count() == 0
    assert near_duplicates(documents).count() == documents.count()
    assert drop_near_duplicates(documents).columns == documents.columns


def test_hot_classes(spark):
    """Hot groups of edited copies, small groups beside them: the classes are those of all candidates."""
    texts = []
    for g, size in enumerate((250, 120, 6, 4)):
        base = words(300 + g % 2, 300) if g < 2 else edited(words(300 + g % 2, 300), g, 12)  # the small ones share sketches with a hot one
        texts += [" ".join(edited(base, 1000 * g + i, 3 + i % 3 if g < 2 else 2)) for i in range(size)]
    bounds = shingles(*word_hashes(*utf8(pa.array(texts))), 5)
    labels = labelled(*bounds)
    made = sketches(labels, bounds[1], 12)
    at = bounds[1]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    part = lambda x, i: x[at[i] : at[i + 1]]
    for b in range(len(texts)):
        for a in np.flatnonzero((made[:b] == made[b]).any(1)):
            if top(a) != top(b) and similar(part(bounds[0], a), part(labels, a), part(bounds[0], b), part(labels, b), 0.8):
                root[max(top(a), top(b))] = min(top(a), top(b))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.id: r.class_id for r in near_duplicates(df).collect()}
    assert got == {i: top(i) for i in range(len(texts))}


def test_one_meeting(spark, monkeypatch):
    """Texts of a hot class that are a little under the line to a small one are aligned without a second meeting."""
    from verdikt.llm import order_minhash

    meetings, meet = [], order_minhash._apart
    monkeypatch.setattr(order_minhash, "_apart", lambda *given: meetings.append(0) or meet(*given))
    changed = lambda own, **new: [new.get(f"w{i}", w) for i, w in enumerate(own)]
    base = words(300, 260)
    near = changed(base, w50="near3", w100="near2", w150="near3", w200="near4")
    texts = [changed(base, w20=f"hot{i}") for i in range(20)] + [changed(near, w240=f"small{i}") for i in range(3)]
    assert 0.78 < jaccard(texts[0], texts[20]) < 0.8
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: 0 if i < 20 else 20 for i in range(23)}
    assert len(meetings) == 1


def test_alignment():
    draw = np.random.default_rng(8)
    for _ in range(60):
        a, b = (draw.integers(0, 6, draw.integers(0, 30)).tolist() for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        assert banded_matches(a, b, 40) == best[-1, -1]
        assert banded_matches(a, b, 3) <= best[-1, -1]


def test_components(spark):
    draw = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(60) if i % 13] + [(int(a), int(b)) for a, b in draw.integers(100, 160, (40, 2)) if a != b]
    parent = {n: n for e in links for n in e}

    def find(n):
        return n if parent[n] == n else find(parent[n])

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}


def brute_share(children, budget):
    """Hands the budget round by weight until it is spent or all are full."""
    given = dict.fromkeys(children, 0.0)
    left = min(budget, sum(c for c, w in children.values() if w > 0))
    while left > 1e-9:
        hungry = {n: (c, w) for n, (c, w) in children.items() if w > 0 and c - given[n] > 1e-9}
        step = min([left, *((c - given[n]) / w * sum(x for _, x in hungry.values()) for n, (c, w) in hungry.items())])
        whole = sum(w for _, w in hungry.values())
        for n, (_, w) in hungry.items():
            given[n] += step * w / whole
        left -= step
    return given


def test_budgets(spark):
    draw = np.random.default_rng(6)
    rows = [(d, lang, f"s{i}", int(draw.integers(1, 500))) for d in "xy" for lang in ("en", "de", None) for i in range(5)]
    leaves = spark.createDataFrame(rows, "d string, l string, s string, tokens long")
    weights = {"d": {"x": 5.0, "y": 1.0}, "l": {"en": 3.0, None: 0.5}, "s": {"s0": 0.0, "s1": 7.0}}
    of = lambda level, name: weights[level].get(name, 1.0)
    for total in (0.0, 700.0, 2500.0, 1e9):
        tree = defaultdict(lambda: defaultdict(dict))
        for d, lang, s, n in rows:
            tree[d][lang][s] = (n, of("s", s))
        size = lambda x: sum(c for c, w in x.values())
        expected = {}
        top = brute_share({d: (sum(size(x) for x in langs.values()), of("d", d)) for d, langs in tree.items()}, total)
        for d, langs in tree.items():
            middle = brute_share({lang: (size(x), of("l", lang)) for lang, x in langs.items()}, top[d])
            for lang, sources in langs.items():
                expected |= {(d, lang, s): v for s, v in brute_share(sources, middle[lang]).items()}
        got = {(r.d, r.l, r.s): r.granted for r in budgets(leaves, ["d", "l", "s"], weights, total, 1).collect()}
        assert got.keys() == expected.keys()
        assert all(got[k] == pytest.approx(expected[k], abs=1e-6) for k in got)


def test_mix(spark, documents, nothing):
    rows = [(i, " ".join(words(i, 1 + i % 40)), "en" if i % 3 else "de", "src0" if i % 2 else f"src{i % 20}", 0) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch int")
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    got = mix(df, {"lang": {"de": 4.0}}, 0.6, levels, max_epochs=2, seed=3).collect()
    size = {i: len(t.split()) for i, t, *_ in rows}
    per = defaultdict(lambda: defaultdict(list))
    for r in got:
        per[r.lang, r.source][r.epoch].append(r.doc_id)
    leaf = defaultdict(list)
    for i, _, lang, source, _ in rows:
        leaf[lang, source].append(i)
    granted = {(r["lang"], r["source"]): r.granted for r in budgets(df.groupBy("lang", "source").agg(F.sum(F.size(F.split("text", " "))).alias("tokens")), ["lang", "source"], {"lang": {"de": 4.0}}, 0.6 * sum(size.values()), 2).collect()}
    for key, epochs in per.items():
        whole, taken = sum(size[i] for i in leaf[key]), sum(size[i] for own in epochs.values() for i in own)
        assert all(len(set(own)) == len(own) for own in epochs.values())
        assert taken <= granted[key] + 1e-6
        assert taken > granted[key] - 41
        if 1 in epochs:
            assert sorted(epochs[0]) == leaf[key]
            assert granted[key] > whole
    assert {(r.doc_id, r.epoch) for r in got} == {(r.doc_id, r.epoch) for r in mix(df.repartition(5), {"lang": {"de": 4.0}}, 0.6, levels, max_epochs=2, seed=3).collect()}
    assert mix(documents, {}, 1.0, levels).count() == documents.count()
    assert mix(nothing, {}, 0.5, levels).count() == 0


def test_beta():
    draw = np.random.default_rng(1)
    for a, b in ((1, 1), (2, 5), (30, 4), (0.3, 0.2), (800, 900)):
        assert float(beta_below(0.4, np.array([a]), np.array([b]))[0]) == pytest.approx(np.mean(draw.beta(a, b, 400_000) < 0.4), abs=4e-3)


def test_urls(spark):
    urls = ["http://A.Example.ORG/es/1", "https://example.org/en/12?x", "https://example.org/fr", "https://notexample.org/", "http://x.com/de/", "http://x.com/fr/#a", "x.com/fr/", None, "", "://h?q", "a://b://c/d", "http://É.net", "http://org", "http://org/", "http://bad.net/1", "http://good.net/1", "http://u:p@Good.net:80/x"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)] + [(3, "https://notexample.org/", "h", 1)] + [(100 + i, f"http://{['bad', 'good'][i % 2]}.net/{i}", None, 1) for i in range(80)], "page_id long, url string, html string, n int")
    outcomes = spark.createDataFrame([(100 + i, bool(i % 2)) for i in range(80)] + [(100, None), (7777, False)], "page_id long, good boolean")
    rules = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
    rows = judge_urls(pages, outcomes, rules).collect()
    assert len(rows) == len(urls) + 81
    got = {r.page_id: r for r in rows}
    expected = {0: ("a.example.org", "/es/1", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"), 2: ("example.org", "/fr", "org/", "allow"), 3: ("notexample.org", "/", "org/", "allow"), 4: ("x.com", "/de/", "com/de/", "block"), 5: ("x.com", "/fr/", "com/fr/", "allow"), 13: ("org", "/", "org/", "allow")}
    for i, want in expected.items():
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want
    assert [(got[i].host, got[i].path, got[i].rule) for i in (6, 7, 8, 9, 10, 11, 12)] == [("", "", None), ("", "", None), ("", "", None), ("h", "", None), ("b:", "//c/d", None), ("É.net", "", None), ("org", "", None)]
    assert (got[14].verdict, got[15].verdict, got[16].verdict) == ("block", "allow", "allow")
    assert got[14].posterior_mean < 0.1 < 0.9 < got[15].posterior_mean
    assert judge_urls(pages.limit(0), outcomes, rules).count() == 0
    assert {r.verdict for r in judge_urls(pages, outcomes.limit(0)).collect()} <= {"allow", "block"}
    one = spark.createDataFrame([("http://a/b://c?d",)], "u string").select(host_of(F.col("u")), path_of(F.col("u"))).first()
    assert tuple(one) == ("a", "/b://c")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    boilerplate = "All rights reserved by the owner of this site"
    rows = []
    for i in range(120):
        lang, stem = ("en", "the of and") if i % 2 else ("de", "der und ich")
        rows.append((i, "\n".join([boilerplate, " ".join(words(i, 40)), stem * 6, " ".join(words(i + 500, 40))]), lang, f"src{i % 12}", 0))
    rows += [(200, rows[3][1], "en", "src1", 0), (201, "123 456", "en", "src1", 0), (202, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        ids = {r.doc_id for r in docs.collect()}
        if name == "language":
            assert ids == {*range(120), 200}
        if name == "lines":
            assert [r.doc_id for r in docs.filter(F.contains("text", F.lit(boilerplate))).collect()] == [0]
            assert docs.filter(F.col("n_chars") != F.char_length("text")).count() == 0
        if name == "copies":
            assert ids == set(range(120))
    assert 60 < len(ids) < 120
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == ids
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "in" / "documents.parquet"))
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path / "in")).collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in packed}


def test_pipeline_copies(spark, tmp_path):
    """Twelve exact and twelve near copies: their lines stay once, what others share too, and no row is left empty."""
    import corpus_pipeline

    boilerplate = "All rights reserved by the owner of this site"
    body = [" ".join(words(900 + i, 20)) for i in range(8)]
    near = [" ".join(words(950 + i, 40)) for i in range(8)]
    rows = [(i, "\n".join(body), "en", "src1", 0) for i in range(12)]
    rows += [(20 + i, "\n".join([*near, " ".join(words(700 + i, 4))]), "en", "src1", 0) for i in range(12)]
    rows += [(40 + i, "\n".join([boilerplate, " ".join(words(i, 40))]), "en", "src2", 0) for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lines = corpus_pipeline.drop_common_lines(spark, docs, str(tmp_path))
    got = {r.doc_id: r.text for r in lines.collect()}
    assert set(got) == {0, *range(20, 32), *range(40, 55)}
    assert got[0] == "\n".join(body)
    assert got[20] == rows[12][1]
    assert all(got[20 + i] == rows[12 + i][1].split("\n")[-1] for i in range(1, 12))
    assert [i for i, t in got.items() if boilerplate in t] == [40]
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_copies(spark, lines, str(tmp_path)).collect()}
    assert list(kept.values()).count("\n".join(body)) == 1


def test_pipeline_without_labels(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "the cat", None), (2, "123 456", None), (3, None, None), (4, "漢字", None)], "doc_id long, text string, lang string")
    for own in (docs, docs.drop("lang")):
        kept = corpus_pipeline.identify_language(spark, own, str(tmp_path))
        assert kept.columns == own.columns
        assert sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_template_pairs(spark):
    """Pairs over the line that share a long template with all others: every one is linked, and no two pairs are."""
    template, rows = words(1, 90), []
    for pair in range(150):
        own = words(5000 + pair, 10)
        rows += [(2 * pair + side, " ".join([*own, *template, *words(9000 + 2 * pair + side, 7)])) for side in (0, 1)]
    assert jaccard(rows[0][1].split(), rows[1][1].split()) >= 0.8 > jaccard(rows[0][1].split(), rows[2][1].split())
    got = {r.id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert sum(got[2 * p] == got[2 * p + 1] == 2 * p for p in range(150)) == 150


def test_long_near_duplicates(spark):
    """Long texts, one with its halves exchanged and one with parts moved a little: the alignment's cost is the band's."""
    base = words(3, 60_000)
    moved = [*base[:1000], *base[1100:3000], *base[1000:1100], *base[3000:]]
    texts = [base, moved, base[30_000:] + base[:30_000], words(4, 60_000)]
    got = {r.id: r.class_id for r in near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_window_of_alignment():
    """The moving window gives what the whole bit vector gives."""
    def whole(a, b, band):
        state = full = (1 << len(a)) - 1
        for j, x in enumerate(b):
            hit = state & sum(1 << i for i, y in enumerate(a) if y == x and abs(i - j) <= band)
            state = ((state + hit) | (state - hit)) & full
        return len(a) - state.bit_count()

    draw = np.random.default_rng(5)
    for _ in range(200):
        a, b = (draw.integers(0, 8, draw.integers(1, 40)).tolist() for _ in range(2))
        a, b = [-1, *a, -2], [-3, *b, -4]
        for band in (0, 1, 3, 12):
            assert banded_matches(a, b, band) == whole(a, b, band)
    assert rising(np.array([3, 1, 2, 9, 4, 5])) == 4


def test_signatures():
    """A signature's differing bits never exceed the labels of one text alone, at any two lengths."""
    draw = np.random.default_rng(6)
    for n in (1, 5, 100, 127, 128, 129, 700, 5000):
        a = draw.integers(0, 2**63, n).astype(np.uint64)
        b = np.r_[a[n // 9 :], draw.integers(0, 2**63, n // 7).astype(np.uint64)]
        x, y = (np.frombuffer(signature(v), np.uint64)[None] for v in (a, b))
        while x.shape[1] > y.shape[1]:
            x = folded(x)
        while y.shape[1] > x.shape[1]:
            y = folded(y)
        apart = int(np.bitwise_count(x ^ y).sum())
        true = len(np.setxor1d(a, b))
        assert true - apart <= true // 4 + 1
        assert apart <= true


def test_reputation(spark):
    """Rates shrink from suffix to domain to site as beta-binomial means say, and a bad site is blocked."""
    draw, rows, good = np.random.default_rng(3), [], []
    rate = {"a.one.net": 0.95, "b.one.net": 0.9, "bad.one.net": 0.2, "www.two.co.uk": 0.9, "x.three.net": 0.97}
    for site, p in rate.items():
        for _ in range(120):
            good.append((len(rows), bool(draw.random() < p)))
            rows.append((len(rows), f"http://{site}/{'p' * 5000}{len(rows)}", "h", "r", True))
    rows.append((len(rows), "http://new.one.net/", "h", "r", True))
    pages = spark.createDataFrame(rows, "page_id long, url string, site string, rule string, blocked boolean")
    outcomes = spark.createDataFrame(good, "page_id long, good boolean")
    judged = judge_urls(pages, outcomes)
    verdicts = {(r.host, r.verdict) for r in judged.collect()}
    assert {h for h, v in verdicts if v == "block"} >= {"bad.one.net"}
    assert ("a.one.net", "allow") in verdicts and ("x.three.net", "allow") in verdicts
    n, k = defaultdict(int), defaultdict(int)
    for (i, ok), (_, url, *_) in zip(good, rows, strict=False):
        n[url.split("/")[2]] += 1
        k[url.split("/")[2]] += ok
    domain = lambda s: "two.co.uk" if s.endswith("co.uk") else ".".join(s.split(".")[-2:])
    suffix = lambda d: d.partition(".")[2]
    grouped = lambda of, x: {g: sum(v for s, v in x.items() if of(s) == g) for g in {of(s) for s in x}}

    def strength(level_n, level_k, up_rate, parents):
        w, q = sum(level_n.values()), sum(v * v for v in level_n.values())
        e = sum(level_n[g] * (level_k[g] / level_n[g] - up_rate[g]) ** 2 for g in level_n)
        variance = sum(level_n[g] * up_rate[g] * (1 - up_rate[g]) for g in level_n) / w
        if w - q / w <= 0:
            return 10.0
        share = min(0.5, max(1 / 1001, (e - max(0, len(level_n) - parents) * variance) / (w - q / w) / variance))
        return (1 - share) / share

    top = (sum(k.values()) + 1) / (sum(n.values()) + 2)
    dn, dk = grouped(domain, n), grouped(domain, k)
    sn, sk = grouped(suffix, dn), grouped(suffix, dk)
    ms, md = strength(sn, sk, dict.fromkeys(sn, top), 1), strength(dn, dk, {d: sk[suffix(d)] / sn[suffix(d)] for d in dn}, len(sn))
    mh = strength(n, k, {s: dk[domain(s)] / dn[domain(s)] for s in n}, len(dn))
    suffix_mean = {s: (sk[s] + ms * top) / (sn[s] + ms) for s in sn}
    domain_mean = {d: (dk[d] + md * suffix_mean[suffix(d)]) / (dn[d] + md) for d in dn}
    got = {r.host: r for r in judged.collect()}
    for site in rate:
        prior = domain_mean[domain(site)]
        assert got[site].posterior_mean == pytest.approx((k[site] + mh * prior) / (n[site] + mh), rel=1e-9)
        a, b = k[site] + mh * prior, n[site] - k[site] + mh * (1 - prior)
        assert got[site].p_below == pytest.approx(np.mean(draw.beta(a, b, 200_000) < 0.8 * top), abs=5e-3)
    assert got["new.one.net"].posterior_mean == pytest.approx(domain_mean["one.net"], rel=1e-9)
    assert float(beta_below(0.5, np.array([2e6]), np.array([2e6]))[0]) == pytest.approx(0.5, abs=1e-6)


def test_pipeline_columns(spark, tmp_path):
    """Columns whose names operators use within come through every stage, and missing, empty and null ones are no harm."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, keep string, n_lines int, n_dropped int, epoch int, `odd name` string"
    rows = [(i, " ".join(words(i, 50)), ("en", "de", None)[i % 3], "src1", 0, 42.0, "p", "k", 5, 6, 7, "o") for i in range(40)]
    rows += [rows[0], (100, None, None, None, None, None, None, None, None, None, None, None), (101, "", "en", "src1", 0, 42.0, "p", "k", 5, 6, 7, "o")]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame(rows, schema).limit(0), spark.createDataFrame(rows, schema).select("doc_id", "text"), spark.createDataFrame([r for r in rows if r[1] is None], schema)):
        whole = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.schema.simpleString() == docs.schema.simpleString()
            path = str(tmp_path / f"{name}-{len(docs.columns)}-{whole}")
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
        if "epoch" in docs.columns:
            assert {(r.score, r.lang_pred, r.keep, r.n_lines, r.n_dropped, r.epoch, r["odd name"]) for r in docs.collect()} <= {(42.0, "p", "k", 5, 6, 7, "o")}
        assert docs.count() > 20 if whole > 20 else docs.count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()
