"""Nearest vectors, ranked search and phrases against plain versions."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riverbed.llm import lexical, phrases, selection, topk


def nearest(rows, asked, k, scale=256):
    usable = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if usable(v)]
    queries: dict = {}
    for i, v in asked:
        if i is not None and usable(v):
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        v = [math.floor(scale * x) for x in v]
        bound = lambda x: max(-(2**63 - 1), min(2**63 - 1, x))
        found = sorted((-bound(sum(a * b for a, b in zip(v, w, strict=True))), i is None, i or 0, i) for i, w in whole if len(w) == len(v) and i != q)
        out += [(q, r, f[3], -f[0]) for r, f in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")


@pytest.mark.parametrize("queries", [4096, 7])
def test_top_k(spark, monkeypatch, queries):
    monkeypatch.setattr(topk, "QUERIES", queries)
    monkeypatch.setattr(topk, "SCORES", 512)
    monkeypatch.setattr(topk, "SLACK", 0)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(400)] + [(400 + i, [0.5] * 6) for i in range(300)] + [(800 + i, rng.normal(size=3).tolist()) for i in range(4)]
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [math.nan] * 6), (903, [math.inf] * 6), (904, []), (905, []), (None, [1.0] * 6), (None, [1.0] * 6), (7, [9.0] * 6), (7, [9.0] * 6), (906, [1e9] * 6), (907, [-3e15] * 6), (908, [1e-9] * 6)]
    df = vectors_of(spark, rows).repartition(5)
    got = topk.top_k(df, df.where("vec_id % 20 = 0 or vec_id > 899 or vec_id is null or vec_id = 7"), 5)
    want = nearest(rows, [r for r in rows if r[0] is None or r[0] % 20 == 0 or r[0] > 899 or r[0] == 7], 5)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert topk.top_k(df, df.limit(0)).count() == 0 and topk.top_k(df.limit(0), df.where("vec_id = 0")).count() == 0
    with pytest.raises(ValueError):
        topk.top_k(df, df, 0)


def test_best():
    rng = np.random.default_rng(5)
    best, every = selection.Best(3, 4), defaultdict(list)
    best.limit = 50
    for _ in range(40):
        q, s, i = rng.integers(0, 3, 30), rng.integers(-4, 4, 30), rng.integers(0, 1000, 30)
        best.add(q, s, i)
        for x in zip(q.tolist(), s.tolist(), i.tolist(), strict=True):
            every[x[0]].append((-x[1], x[2]))
    q, s, i = best.prune()
    assert [(a, -b, c) for a, b, c in zip(q.tolist(), s.tolist(), i.tolist(), strict=True)] == [(k, *x) for k in sorted(every) for x in sorted(every[k])[:4]]


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def best_documents(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(bags), sum(c.total() for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in {i: min(t for j, t in items if j == i and t is not None) for i, t in items if t is not None}.items():
        found = []
        for i, c in bags:
            m = 25 + 75 * c.total() * n_docs // total
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in Counter(terms(text)).items() if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("item_bytes", [4 << 20, 40])
def test_rank(spark, monkeypatch, item_bytes):
    monkeypatch.setattr(lexical, "ITEM_BYTES", item_bytes)
    monkeypatch.setattr(lexical, "CELLS", 300)
    rng = np.random.default_rng(2)
    word = lambda: f"W{int(rng.zipf(1.5)) % 60}é"
    docs = [(i, " ".join(word() for _ in range(int(rng.integers(0, 40))))) for i in range(120)]
    docs += [(5, docs[5][1]), (200, None), (201, ""), (202, "-- ..\x7f"), (None, "w1é w2É W3é"), (203, "W1é " * 3000), (204, "日本 w2é{w3é}")]
    items = [(i, " ".join(word() for _ in range(12))) for i in range(15)] + [(3, "w1é zz"), (20, None), (21, ""), (22, "never seen"), (None, "w2é w1é"), (23, "w1é w1é w1é W2é")]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, lexical.rank(d, q).collect()), key=str) == best_documents(docs, items, 10)
    assert lexical.rank(d.limit(0), q).count() == 0 and lexical.rank(d, q.limit(0)).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c", b"d", b"e", b"f", b"g"]), max_size=12), max_size=8))
def test_shared_sums(items):
    graph = lexical.Shared([Counter(i) for i in items])
    assert graph.items == [i for i, x in enumerate(items) if x]
    if graph.terms:
        partial = np.random.default_rng(1).integers(0, 1 << 40, (len(graph.terms), 5))
        number = {t: i for i, t in enumerate(graph.terms)}
        assert np.array_equal(graph.scores(partial), [sum(partial[number[t]] for t in items[i]) for i in graph.items])


def test_shared_sets_are_summed_once():
    items = [Counter([b"a", b"b", b"c", b"d", *x]) for x in ([b"e"], [b"f"], [b"g", b"e"], [])]
    graph = lexical.Shared(items)
    assert sum(len(n) for n, _, _ in graph.levels) == 3 + 1 and len(graph.operands) <= 6  # a + b + c + d once, and e to it


@settings(deadline=None, max_examples=60)
@given(st.integers(2, 4), st.integers(1, 31), st.data())
def test_packing_and_filters(longest, bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=60)), np.uint64)
    half = phrases.half_of(longest, bits)
    left, right = phrases.packed(ids, 0, longest, bits)
    want = [tuple(ids[i : i + n].tolist()) for n in range(2, longest + 1) for i in range(len(ids) - n + 1) if all(ids[i : i + n])]
    words = phrases.unpacked(left, right, longest, bits)
    assert [tuple(w[w > 0].tolist()) for w in words] == want
    p = phrases.permuted(left, right, half)
    assert all(np.array_equal(a, b) for a, b in zip(phrases.restored(*p, half), (left, right), strict=True))
    counts = np.array([data.draw(st.sampled_from([1, 254, 255, 256, 1 << 40])) for _ in want], np.int64)
    keys = phrases.summed(*p, counts, half)
    for ranges in {0, min(3, half)}:
        parts = [phrases.opened(r, b, np.diff(np.searchsorted(keys[0] >> np.uint64(half - ranges) if ranges else keys[0] * np.uint64(0), [r, r + 1]))[0], *x, half, ranges) for r, b, *x in phrases.filters(*keys, half, ranges)]
        for i in range(3):
            assert np.array_equal(np.concatenate([x[i] for x in parts]) if parts else [], keys[i])


def company(docs, longest, least, cover, first):
    f = defaultdict(Counter)
    n = Counter()
    for lang, text in docs:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        kept = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in kept.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        rows = []
        for p, a in kept.items():
            if 100 * most[p] < cover * a:
                s, _, l, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), a, l, r, s))
        out += [(lang, i, x[2].decode(), x[3], x[4], x[5], n[lang], x[6]) for i, x in enumerate(sorted(rows)[:first], 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "longest", "least", "first"), [(1 << 20, 3, 3, 2000), (40, 3, 3, 17), (40, 4, 2, 2000), (25, 2, 1, 2000)])
def test_collocations(spark, monkeypatch, shard, longest, least, first):
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    monkeypatch.setattr(phrases, "MERGE", 200)
    rng = np.random.default_rng(4)
    gaps = [" ", "  ", "\t", ", ", ".", "\n", "\r\n", " "]
    text = lambda n: "".join(f"{'Ab' if rng.random() < 0.2 else 'ab'}{int(rng.zipf(1.6)) % 9}{gaps[int(rng.integers(0, 8))]}" for _ in range(n))
    docs = [(["en", "de", None, "fr"][i % 4], text(int(rng.integers(0, 60)))) for i in range(60)]
    docs += [("en", None), ("en", ""), (None, " ,. "), ("de", "é\x00x\x1c" * 5 + " é\xa0z é\xa0z"), ("en", "ab1 ab2 " * 300), ("en", docs[0][1]), ("en", docs[0][1])]
    d = spark.createDataFrame([(t, g, 1, "w") for g, t in docs], "text string, lang string, a int, w string").repartition(3)
    got = phrases.collocations(d, longest, least, 50, first)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == company(docs, longest, least, 50, first)


def test_no_phrases(spark):
    d = spark.createDataFrame([("one two", "en"), (None, None)], "text string, lang string")
    assert phrases.collocations(d).count() == 0 and phrases.collocations(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(d, longest=1)
