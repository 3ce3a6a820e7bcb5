"""The corpus operators against plain versions of what they compute."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riverbed.llm import chat, media, minhash, mixing, packing, parsing, quality, secret_scan, suffixes, toxicity
from riverbed.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
#: Labels of some languages are too few in SF to learn from.
LABELLED = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("_t", T.StringType()), T.StructField("key", T.StringType())])
ODD = [
    (1, None, None, None, None, "x", "y"), (2, "", "en", "a", 0, "x", "y"), (3, " \n ", None, "a", 3, None, None), (4, "one two", "en", None, 7, None, None), (5, "one two", "en", "b", 7, None, None),
    (5, "one two", "en", "b", 7, None, None), (None, "no id here, none at all", "en", "b", 23, None, None), (None, "no id here, none at all", "en", "b", 23, None, None),
    (6, "w" * 3000, "en", "b", 3000, None, None), (7, "many words of text " * 3000, "en", "b", 57000, None, None), (8, "日本語 текст <|endoftext|> \x00   ſecret=abcdefghijklmnop", "en", "c", 1, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def table_of(frame, *names):
    return {r["doc_id"]: r for r in frame.collect()}


def test_media_round_trip(spark, texts):
    rows = table_of(QUERIES["op1_media_tiles"](spark, SF))
    assert set(rows) == set(texts)
    for i, r in rows.items():
        data = texts[i].encode()
        payload = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and re.fullmatch("[0-9a-f]{16}:[0-9a-f]+", r["feature"])


def test_media_formats_and_resize():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (7, 5), (31, 9), (5000, 3), (4, 6, 3), (9, 5, 3)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        for write in (media.write_pgm, media.write_bmp):
            assert np.array_equal(media.decode(write(image)), image)
    assert np.array_equal(media.decode(b"P5 # note\n2\n1 255\n\x01\x02"), [[1, 2]])
    for bad in (b"", b"P5\n9 9\n255\nxx", b"BM" + bytes(60), b"GIF89a"):
        with pytest.raises(ValueError):
            media.decode(bad)
    image = rng.integers(0, 256, (9000, 10)).astype(np.uint8)
    assert np.allclose(media.area_resize(image, 9, 5), image.reshape(9, 1000, 5, 2).mean((1, 3)))
    big = np.kron(image[:7, :5], np.ones((3, 4)))  # enlarging by whole factors repeats cells
    assert np.allclose(media.area_resize(image[:7, :5], 21, 20), big)
    assert np.array_equal(np.load(io.BytesIO(media.to_npy(image))), image)


def area_mean(image, height, width):
    """By repeating each sample until both grids fit, then plain means."""
    h, w = image.shape
    return np.kron(image.astype(float), np.ones((height, width))).reshape(height, h, width, w).mean((1, 3))


def test_media_forms_and_features(spark, texts):
    rows, some = table_of(QUERIES["op1_media_tiles"](spark, SF)), sorted(texts, key=lambda i: len(texts[i]))[:400]
    for i in some:
        data = texts[i].encode()
        n = max(1, -(-len(data) // 576))
        payload = data.ljust(n * 576, b"\xff")
        image = np.frombuffer(payload, np.uint8).reshape(-1, 24)
        h = len(image)
        if n % 2:
            palette = b"".join(bytes([k, k, k, 0]) for k in range(256))
            head = b"BM" + (1078 + h * 24).to_bytes(4, "little") + bytes(4) + (1078).to_bytes(4, "little")
            head += b"".join(x.to_bytes(k, "little") for x, k in ((40, 4), (24, 4), (h, 4), (1, 2), (8, 2), (0, 4), (h * 24, 4), (2835, 4), (2835, 4), (256, 4), (0, 4)))
            media_ = head + palette + image[::-1].tobytes()
        else:
            media_ = f"P5\n24 {h}\n255\n".encode() + payload
        assert (rows[i]["media_bytes"], rows[i]["media_sha256"]) == (len(media_), hashlib.sha256(media_).hexdigest())
        small = area_mean(image, 8, 9)
        bits = "".join("1" if b > a + 1e-9 else "0" for line in small for a, b in zip(line, line[1:], strict=False))
        if all(abs(b - a) > 1e-6 or a == b for line in small for a, b in zip(line, line[1:], strict=False)):
            assert rows[i]["feature"].split(":")[0] == f"{int(bits, 2):016x}"
        tile = np.load(io.BytesIO(media.to_npy(np.clip(np.rint(media.area_resize(image, 24, 24)), 0, 255).astype(np.uint8))))
        assert np.abs(tile - area_mean(image, 24, 24)).max() <= 0.5 + 1e-6
        assert int(rows[i]["feature"].split(":")[1], 16) == zlib.crc32(media.to_npy(tile))


def level(totals, weights=(5, 2, 1)):
    order = sorted(totals, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(totals.values()), set(order), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * totals[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * totals[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix_targets_and_balance(spark, docs, texts):
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size = {i: len(WORD.findall(t)) for i, t in texts.items()}
    totals = Counter()
    for i in texts:
        totals[source[i]] += size[i]
    want, rows = level(totals), table_of(QUERIES["op2_mix"](spark, SF))
    assert {i: r["size"] for i, r in rows.items()} == size
    taken = Counter()
    for i, r in rows.items():
        assert r["source_size"] == totals[source[i]] and r["target"] == pytest.approx(want[source[i]])
        assert r["taken"] in (0, size[i], 2 * size[i])
        taken[source[i]] += r["taken"]
    for s in totals:
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 60)
    assert rows == table_of(QUERIES["op2_mix"](spark, SF))


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 10, 500):
        x, size = rng.random(n), rng.integers(0, 1000, n)
        y = mixing.flight(x, size, np.random.default_rng(5))
        assert ((y > 0) & (y < 1)).sum() <= 2
        assert np.isclose(x.sum(), y.sum(), atol=1e-5) and np.isclose(x @ size, y @ size, atol=1e-2)
    means = np.mean([mixing.flight(np.full(7, 0.3), np.array([1, 5, 2, 9, 4, 4, 0]), np.random.default_rng(k)) for k in range(3000)], axis=0)
    assert np.allclose(means, 0.3, atol=0.05)


def test_mix_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise("s").alias("source"), (F.col("id") * 37 % 101).alias("size"))
    out = mixing.sample(rows).toPandas()
    assert len(out) == 3000 and set(out.copies) <= {0, 1, 2}
    for _, g in out.groupby("source", dropna=False):
        assert abs((g.copies * g["size"]).sum() - g.target.iloc[0]) < 5


def test_mix_repeats_and_names(spark):
    """A row that repeats very often is one unit; columns of any name survive; a rerun takes the same rows."""
    rows = [(7, "same words here", "a", 1)] * 9000 + [(i, "word " * (i % 9), "b" if i % 2 else None, i) for i in range(300)] + [(5, t, "b", 0) for t in ("p q", "r s", "t u")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long").select("*", *(F.lit(1).alias(c) for c in ("_d", "_k", "_c", "_size", "row", "times", "unit", "size")))
    took = [Counter(map(tuple, mixing.take(frame.repartition(n)).collect())) for n in (3, 5)]
    assert took[0] == took[1] and mixing.take(frame).columns == frame.columns
    size, have = lambda r: len((r[1] or "").split()), Counter((*r, *[1] * 8) for r in rows)
    assert all(0 <= n <= 2 * have[r] for r, n in took[0].items())
    totals = Counter()
    for r in rows:
        totals[r[2]] += size(r)
    got = Counter()
    for r, n in took[0].items():
        got[r[2]] += n * size(r)
    for s, t in level(totals).items():
        assert abs(got[s] - t) <= max(20, 0.01 * t)
    out = mixing.sample(frame).toPandas()
    assert len(out) == len(rows) and out.copies.between(0, 2).all() and out[out.doc_id == 7].copies.sum() in range(13000, 18001)


def reassemble(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["start"], bytes(r["ids"])))
    return {i: b"".join(x[1] for x in sorted(p)) for i, p in by.items()}


def test_pack_full_windows_only(spark):
    frame = spark.createDataFrame([(1, "a" + " a" * 2046), (2, "a" + " a" * 4094)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(frame, packing.default_vocabulary()).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["offset"]) for r in rows) == [(1, 0, 2048, 0), (2, 0, 2048, 0), (2, 2048, 2048, 0)]
    assert len({r["sequence_id"] for r in rows}) == 3


def test_pack(spark, docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    rows = packing.pack(docs, packing.default_vocabulary()).collect()
    got = reassemble(rows)
    for i, text in texts.items():
        assert got[i] == np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
    fill = defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and 1 <= r["length"] <= 2048
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for pieces in fill.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
        total += at
    assert total >= 0.98 * 2048 * len(fill)
    q = QUERIES["op3_pack"](spark, SF).collect()
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in q) == Counter((r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é1_'st \n\t.,-<|>²日 \x1c")), max_size=60))
def test_word_ids_equal_the_tokenizer(text):
    ids = packing.PartIds(packing.default_vocabulary())
    assert ids.text(text) == ids.whole(text)


def test_special_tokens_in_texts():
    """They are what a plain call of the tokenizer makes of them, wherever they stand among other texts."""
    from tokenizers import Tokenizer

    t, end = Tokenizer.from_file(packing.default_vocabulary()), "<|endoftext|>"
    some = [end, "a b", "", f"word {end} next{end}", "plain text here", f"{end[:-1]} |>", f" {end}", end[:6], end[6:], "日 " + end, "x"]
    for texts in (some, some[1:3], some[:1], []):
        ids, counts = packing.PartIds(packing.default_vocabulary()).texts([x.encode() for x in texts])
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=40))
def test_best_fit(lengths):
    free, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = sorted((c, w) for w, c in enumerate(free) if c >= lengths[i])
        if fits:
            capacity = fits[0][0]
        else:
            free.append(32)
            capacity = 32
        want[i] = 32 - capacity
        free[next(w for w, c in enumerate(free) if c == capacity)] -= lengths[i]
    places = packing.best_fit(lengths, 32)
    assert [p[1] for p in places] == [want[i] for i in range(len(lengths))]


def covered(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                m[i : i + length] = True
        out.append(m)
    return out


def test_suffix_dedup(spark, texts):
    rows = table_of(QUERIES["op4_suffix_dedup"](spark, SF))
    ids = sorted(texts)
    data = [texts[i].encode() for i in ids]
    for i, t, m in zip(ids, data, covered(data, 200), strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~m])
        spans = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        assert tuple(rows[i])[1:] == (len(t), int(m.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_shards_and_merge():
    random.seed(4)
    for trial in range(20):
        length = random.choice([40, 60, 200])
        base = [bytes(random.choices(b"abc\0\xff" if trial % 2 else b"ab", k=random.randint(0, 500))) for _ in range(4)]
        texts = [b"".join(b[random.randint(0, 30) :] for b in random.sample(base, 2)) for _ in range(8)] + [b"Le " * 200 + b"q", b"zLe " * 3]
        by = defaultdict(list)
        for i, t in enumerate(texts):
            for k, lo, hi, _ in zip(*suffixes.anchors(t, length), strict=True):
                by[int(k)].append(((i, i * 7), int(lo), t[lo : hi + length]))
        got = [np.zeros(len(t), bool) for t in texts]
        for rows in by.values():
            shards = [suffixes._shard(rows[j::3], length) for j in range(3) if rows[j::3]] if trial % 3 else [suffixes._shard(rows, length)]
            found, known = [suffixes._found(s, length) for s in shards], np.zeros((0, 5), np.int64)
            for s in shards:
                known, hits = suffixes.meet(known, suffixes.windows(s, length))
                found.append(suffixes._runs(hits, length))
            for f in found:
                for o, a, b in f[["owner", "start", "end"]].itertuples(index=False):
                    got[o][a:b] = True
        for g, w in zip(got, covered(texts, length), strict=True):
            assert (g == w).all()


def test_suffix_large_keys(spark, monkeypatch):
    """A passage that many documents share has keys of several shards."""
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 2000)
    monkeypatch.setattr(suffixes, "KEY_BYTES", 2000)
    random.seed(9)
    passage = "".join(random.choices("abcdefgh ", k=450))
    texts = ["".join(random.choices("xyzw ", k=random.randint(0, 90))) + passage + "".join(random.choices("xyzw ", k=50)) for _ in range(40)]
    texts += ["ab" * 3000, "zz" + "ab" * 2500]  # one segment that is longer than a shard
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = table_of(suffixes.remove_repeats(frame))
    for i, (t, m) in enumerate(zip(texts, covered([t.encode() for t in texts], 200), strict=True)):
        assert bytes(rows[i]["kept"]) == bytes(np.frombuffer(t.encode(), np.uint8)[~m])



def held_out(spark, name, column):
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{LABELLED}/labels.parquet").collect() if r[column] is not None}
    rows = QUERIES[name](spark, LABELLED).collect()
    mod, rest = (4, 2) if column == "toxic" else (3, 1)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest) and 0 <= r["score"] <= 1
    pairs = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    return pairs


def test_toxicity_held_out(spark):
    pairs = held_out(spark, "op5_toxicity", "toxic")
    good = [p for p, y in pairs if not y]
    bad = [p for p, y in pairs if y]
    assert np.mean(good) <= 0.02 and np.mean(bad) >= 0.9


def test_toxicity_exceptions_of_all_words(spark):
    """A phrase with a word that comes after 500 others in the lexicon is an exception too."""
    words = [a + b + c for a in "bcdfghjklm" for b in "aeiou" for c in "bcdfghjklmnp"]
    rows = [(" ".join(words) + (" zyx" if i < 10 else ""), 1) for i in range(20)] + [("calm zyx" if i < 3 else "plain text", 0) for i in range(100)]
    lexicon, phrases = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), "toxic")
    assert [w for w in lexicon if not w.endswith("*")].index("zyx") >= 500 and phrases == ["calm zyx"]


def test_toxicity_folding_and_exceptions():
    assert toxicity.fold("IDI0T! ïdіot s​cum 1diot $cum x!") == "idiot  idiot scum idiot scum x "
    a = toxicity.automaton({"scum": 5.0, "lowe*": 3.0}, ["pond scum"])
    m = toxicity.measures(["pond scum here", "scum", "lowei", "slowest", "", None], a)
    assert m[:, 0].tolist() == [0.0, 5.0, 3.0, 0.0, 0.0, 0.0] and m[:, 3].tolist() == [0, 0, 0, 0, 1, 1]


def test_toxicity_scores_by_plain_search(spark):
    """Each score against a search for every entry at every word, one text at a time."""
    import math

    docs = spark.read.parquet(f"{LABELLED}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{LABELLED}/labels.parquet").select("doc_id", "toxic"))
    assert model["lexicon"]
    some = docs.where("doc_id % 40 = 3")
    for r in toxicity.score(some, model).collect():
        w = toxicity.fold(r["text"]).split()
        free = {i for i in range(len(w)) for k in (i - 1, i) if 0 <= k < len(w) - 1 and f"{w[k]} {w[k + 1]}" in model["phrases"]}
        held = []
        for i, x in enumerate(w):
            fits = [v for e, v in model["lexicon"].items() if (x.startswith(e[:-1]) if e.endswith("*") else x == e)]
            if fits and i not in free:
                held.append(max(fits))
        m = [max(held, default=0.0), math.log1p(sum(held)), math.log1p(100 * sum(held) / max(50, len(w))), float(not w)]
        z = sum(a * b for a, b in zip(m, model["weights"], strict=False)) + model["weights"][-1]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)


def test_quality_by_plain_updates(spark):
    """The trained weights and the scores against the textbook's formulas, one coordinate at a time."""
    import math

    rng = random.Random(1)
    texts = [" ".join(rng.choices("alpha beta gamma delta 1. x, eps".split(), k=rng.randrange(1, 30))).encode() for _ in range(30)] + [b""]
    labels = np.array([i % 2 for i in range(31)], float)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.02 else -(z[i] - math.copysign(0.02, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.6 + 0.1)

    def vector(t):
        f = quality.features([t])[0].tolist()
        return {i: c * 24.0 / len(f) for i, c in Counter(f).items()} | {quality.BUCKETS: 1.0}

    for _ in range(quality.EPOCHS):
        for t, y in zip(texts, labels, strict=True):
            x = vector(t)
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
            for i, g in [(i, (p - y) * v) for i, v in x.items()]:
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.6
                z[i], n[i] = z[i] + g - s * weight(i), n[i] + g * g
    got = quality.train(texts, labels)
    assert all(got[i] == pytest.approx(weight(i), abs=1e-5) for i in list(z)) and np.count_nonzero(got) <= len(z)
    frame = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.score(frame, got).collect():
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-sum(float(got[i]) * v for i, v in vector(texts[r["doc_id"]]).items()))), abs=1e-6)


def test_quality_held_out(spark):
    pairs = held_out(spark, "op10_quality", "quality")
    assert np.mean([p == y for p, y in pairs]) >= 0.95


def sets(texts, width):
    out = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    return out


def near_classes(texts, width):
    """Component of each document, by comparing all that share a shingle."""
    s, parent = sets(texts, width), {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i in sorted(s):
        for x in s[i]:
            by[x].append(i)
    common = Counter((a, b) for group in by.values() for k, a in enumerate(group) for b in group[k + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(s[a]) + len(s[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s[i]), root(i)) for i in texts}


def test_minhash(spark, texts):
    rows = table_of(QUERIES["op6_minhash"](spark, SF))
    want = near_classes(texts, 4)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in rows.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in rows.items())


def test_minhash_family_of_distant_copies(spark, monkeypatch):
    """Copies of one text with 0 to 14 of 60 words changed: every link that joins two components counts."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        words = list(base)
        for j in rng.sample(range(60), rng.choice([0, 1, 2, 3, 6, 14])):
            words[j] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(t.split()[j : j + 4]) for j in range(57)} for _, t in rows]
    root = list(range(80))
    for i in range(80):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    assert 5 < len(set(root)) < 79
    for large in (0, 16):
        monkeypatch.setattr(minhash, "LARGE_KEY", large)
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(root))


def family(n: int, length: int = 10, seed: int = 8) -> list[tuple[int, str]]:
    """Texts of 20 passages, in 14 of which one word is one of three."""
    rng = random.Random(seed)
    passages = [[f"p{i}w{j}" for j in range(length)] for i in range(20)]
    rows = []
    for d in range(n):
        chosen = [p if i >= 14 else [*p[:5], f"v{i}x{rng.randrange(3)}", *p[6:]] for i, p in enumerate(passages)]
        rows.append((d, " ".join(w for p in chosen for w in p)))
    return rows


def test_minhash_family_forms_few_pairs(spark, monkeypatch):
    """Pairs grow with the documents, not with their square, and the classes are those of all pairs."""
    n = 300
    rows = family(n)
    formed, verify = [], minhash.verify
    monkeypatch.setattr(minhash, "verify", lambda pairs, *a, **k: (formed.append(pairs.count()), verify(pairs, *a, **k))[1])
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    want = near_classes(dict(rows), 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert 1 < len({c for _, c in want.values()}) < n and sum(formed[:-1]) <= 4 * n and sum(formed) < n * n // 4, formed


def test_minhash_likely_rows_and_rounds(spark, monkeypatch):
    """A document has a row for each band that still parts components, not for all; rounds that link nothing end, and nothing is lost."""
    rng, rows = random.Random(4), []
    for i in range(60):
        words = [f"w{j}" for j in range(200)]
        for j in rng.sample(range(200), 10):
            words[j] = f"x{i}y{j}"
        rows.append((i, " ".join(words)))
    looked, likely = [], minhash.likely

    def seen(placed, classes, *a):
        found = likely(placed, classes, *a)
        looked.append("Generate" in found._jdf.queryExecution().optimizedPlan().toString())
        return found

    monkeypatch.setattr(minhash, "likely", seen)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near_classes(dict(rows), 4)
    assert looked == [False], looked  # one round of three


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    s = minhash.signatures(np.concatenate([pool[:2000], pool[500:2500]]), np.array([2000, 2000]), 1000)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.06


def test_components(spark):
    random.seed(6)
    edges = [(random.randrange(120), random.randrange(120)) for _ in range(80)] + [(500 + i, 501 + i) for i in range(40)]
    parent = list(range(600))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["id"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for a, b in edges if a != b for i in (a, b)}


def test_parsing_query(spark, texts):
    rows, ids = table_of(QUERIES["op7_parsing"](spark, SF)), sorted(texts)
    near, edited_near = [], []
    for k, i in enumerate(ids):
        t, n = texts[i], texts[ids[(k + 1) % len(ids)]]
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        a, b, c = parsing.fingerprints([t.encode(), e.encode(), n.encode()])
        assert (rows[i]["fingerprint"], rows[i]["edited_fingerprint"]) == (parsing.encode(a), parsing.encode(b))
        assert rows[i]["near_edited"] == parsing.likeness(a, b) and rows[i]["near_next"] == parsing.likeness(a, c)
        if len(t) > 400 and t != n:
            near.append(rows[i]["near_next"])
            edited_near.append(rows[i]["near_edited"])
    assert np.median(near) < 0.2 < 0.4 < np.median(edited_near)


def plain_phrases(data):
    """The bounds, in bytes, of the inner phrases of each level: tosses on whole numbers, one place at a time."""
    spans, names, out = [(i, i + 1) for i in range(len(data))], [data[i : i + 1] for i in range(len(data))], {}
    ids = {}
    for lev in range(1, parsing.LEVELS):
        runs = []
        for s, x in zip(spans, names, strict=True):
            if runs and runs[-1][1] == x:
                runs[-1] = ((runs[-1][0][0], s[1]), x, runs[-1][2] + 1)
            else:
                runs.append((s, x, 1))
        x = [ids.setdefault((lev, r[1]), plain_number(lev, r[1])) for r in runs]
        for _ in range(4):
            label = []
            for i, v in enumerate(x):
                d = v ^ (x[i - 1] if i else ~v & (1 << 64) - 1)
                low = (d & -d).bit_length() - 1
                label.append(2 * low + (v >> low & 1))
            x = label
        begin = [i for i in range(len(runs)) if i == 0 or (1 < i < len(runs) - 1 and x[i] > x[i - 1] and x[i] >= x[i + 1])]
        ends = [*begin[1:], len(runs)]
        spans = [(runs[a][0][0], runs[b - 1][0][1]) for a, b in zip(begin, ends, strict=True)]
        names = [tuple((r[1], r[2]) for r in runs[a:b]) for a, b in zip(begin, ends, strict=True)]
        out[lev] = (spans, names)
    return out


def plain_number(lev, name):
    """The number of a name: a byte's own, or the hash of what its phrase is made of."""
    if lev == 1:
        return name[0] + 1
    parts = []
    for x, n in name:
        v = plain_number(lev - 1, x)
        parts.append(mix((v * 0x9E3779B97F4A7C15 + n)) if n > 1 else v)
    base, total = 0x9E3779B97F4A7C15, 0
    for k, v in enumerate(parts):
        total += mix(v + 1) * (pow(base, k, 1 << 64))
    return mix(total)


def mix(x):
    m = (1 << 64) - 1
    x &= m
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & m
    return x ^ x >> 31


def test_parsing_against_a_plain_parser():
    rng = random.Random(7)
    for n in (9, 40, 333, 1500):
        for letters in ("ab", "abcdefgh ", "a"):
            data = "".join(rng.choices(letters, k=n)).encode()
            want = set()
            for lev, (spans, names) in plain_phrases(data).items():
                if lev in parsing.SKETCHED and len(spans) > 2:
                    want |= {mix(plain_number(lev + 1, x) + lev) for x in names[1:-1]}
            got = set(parsing.phrases([data])[0].tolist())
            assert got == want if want else len(got) == 1


def test_parsing_is_locally_consistent():
    rng = np.random.default_rng(8)
    shared = bytes(rng.integers(97, 123, 4000, dtype=np.uint8))
    a, b = (parsing.phrases([bytes(rng.integers(97, 123, n, dtype=np.uint8)) + shared])[0] for n in (37, 1201))
    only = parsing.phrases([shared])[0]
    assert len(np.intersect1d(a, b)) > 0.95 * len(only)


def test_secrets_query(spark, texts):
    rows = table_of(QUERIES["op8_secrets"](spark, SF))
    words = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    assign = re.compile("(" + words + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in texts.items():
        base = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[2]) >= 12]
        base += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        base += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        joined = ",".join(x[2] for x in sorted(base))
        assert rows[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[1] == k for x in base) for k in range(3)]
        assert set(x[2] for x in base) <= set(rows[i]["spans"].split(","))


def test_secrets_structure():
    import base64

    def der(tag, body):
        n = len(body)
        return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2, "big")) + body

    rsa = der(0x30, b"".join(der(2, bytes([1 + k]) * 20) for k in range(9)))
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(range(32))))
    token = base64.urlsafe_b64encode(b'{"alg":"HS256","typ":"JWT"}').decode().rstrip("=") + ".eyJzdWIiOiIxIn0.c2lnbmF0dXJl"
    kinds = lambda t: {k for _, _, k in secret_scan.scan(t)}
    assert kinds("x " + base64.b64encode(rsa).decode() + " y") == {"der"}
    assert "der" in kinds(rsa.hex()) and kinds(base64.b64encode(ssh).decode()) == {"ssh"} and kinds("a " + token) == {"jwt"}
    assert not kinds(base64.b64encode(rsa[:-30]).decode()) and not kinds("e" * 200000 + "Z") - {"hex"}
    assert not secret_scan.is_der_key(rsa[:-30]) and not kinds("eyJub3QiOiJhIGhlYWRlciJ9.eyJzdWIiOiIxIn0.x")


def test_secrets_in_hex_and_nested_lengths():
    def der(tag, body):
        n = len(body)
        return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2, "big")) + body

    rsa = der(0x30, b"".join(der(2, bytes([1 + k]) * 20) for k in range(9)))
    name = der(0x30, der(6, secret_scan.RSA_OID) + b"\5\0")
    wrapped = der(0x30, der(2, b"\0") + name + der(4, rsa))
    public = der(0x30, name + der(3, b"\0" + der(0x30, der(2, b"\1" * 30) + der(2, b"\1\0\1"))))
    sec1 = der(0x30, der(2, b"\1") + der(4, bytes(32)) + der(0xA0, der(6, b"*\x86H\xce=\3\1\7")))
    assert [secret_scan.der_kind(x) for x in (rsa, wrapped, sec1, public)] == ["der", "der", "der", "public"]
    broken = bytearray(wrapped)
    broken[len(wrapped) - 21] += 1  # the last number's length, two levels down
    assert secret_scan.der_kind(bytes(broken)) is None and secret_scan.der_kind(public[:-1]) is None
    assert secret_scan.der_kind(der(0x30, b"".join(der(2, b"\1") for _ in range(8)))) is None
    for key in (rsa, wrapped, sec1):
        for lead in ("", "a", "bc", "30", "3082"):
            for tail in ("", "f", "00ff1"):
                text = f"x {lead}{key.hex()}{tail} y"
                assert (2 + len(lead), 2 + len(lead) + 2 * len(key), "der") in secret_scan.scan(text), (lead, tail)
    ssh = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(range(32)))).hex()
    assert (1, 1 + len(ssh), "ssh") in secret_scan.scan("a" + ssh)


def test_secrets_in_the_forms_of_crawled_text():
    """Each kind of key in each form in which keys stand in files and mails; near misses stay clean."""
    import base64

    rng = random.Random(3)

    def der(tag, body):
        n = len(body)
        return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2, "big")) + body

    def number(n):
        return der(2, bytes([1 + rng.randrange(100)]) + rng.randbytes(n - 1))

    rsa = der(0x30, der(2, b"\0") + number(257) + der(2, b"\1\0\1") + b"".join(number(k) for k in (256, 129, 129, 129, 129, 129)))
    password = der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")) + der(0x30, rng.randbytes(40)))
    kinds = {
        "rsa": rsa,
        "pkcs8": der(0x30, der(2, b"\0") + der(0x30, der(6, secret_scan.RSA_OID) + b"\5\0") + der(4, rsa)),
        "sec1": der(0x30, der(2, b"\1") + der(4, rng.randbytes(32)) + der(0xA0, der(6, b"*\x86H\xce=\3\1\7"))),
        "ed25519": der(0x30, der(2, b"\0") + der(0x30, der(6, b"+ep")) + der(4, der(4, rng.randbytes(32)))),
        "encrypted": der(0x30, password + der(4, rng.randbytes(1232))),
    }

    def forms(key):
        flat = base64.b64encode(key).decode()
        lines = [flat[i : i + 64] for i in range(0, len(flat), 64)]
        for between in ("\n", "\r\n", "\\n", "\\r\\n", "\n  ", "\n> ", " ", '",\n  "', "\\n\" \n\t\"", "\n\n"):
            yield between, "-----BEGIN KEY-----" + between, between.join(lines), between + "-----END KEY-----"
        for lead in ("x/", "a+b/", "path/to/M", "MIIMII"):
            yield lead, "see " + lead, flat, " end"
        for tail in ("/x", "_and_more_of_it_that_goes_on", " word\nword"):
            yield tail, "", flat.rstrip("="), tail
        for between in (":", ":\n    "):
            h = key.hex()
            yield "colons" + between, "key: ", between.join(h[i : i + 2] for i in range(0, len(h), 2)), "\nend"
        yield "capitals", "0x", key.hex().upper(), " end"

    for kind, key in kinds.items():
        for form, before, body, after in forms(key):
            text = before + body + after
            found = [(s, e) for s, e, k in secret_scan.scan(text) if k == "der"]
            want = len(before) + len(body)
            assert len(found) == 1 and found[0][0] == len(before) and want - 2 <= found[0][1] <= want, (kind, form, found, len(before), want)
        cut, grown = key[: len(key) * 2 // 3], bytearray(key)
        # a tag that no key has there; in PKCS#8 that of the key inside, which would be a key by itself
        grown[key.index(rsa[:8]) + 4 if rsa in key else key.index(b"\4" if kind == "encrypted" else b"\2")] ^= 0x1F
        digest = der(0x30, der(0x30, der(6, bytes.fromhex("608648016503040201")) + b"\5\0") + der(4, rng.randbytes(64)))
        for miss in (cut, bytes(grown), digest, rng.randbytes(900)):
            for form, before, body, after in forms(miss):
                if miss is cut and after[:1] in ("/", "_"):  # letters glued to it stand for those that are missing
                    continue
                assert not {k for _, _, k in secret_scan.scan(before + body + after)} & {"der", "ssh", "public", "jwt"}, (kind, form)
    prose = "an_identifier_of_more_than_32_letters and/then/a/path/that/goes/on, \"internationalization\" > counterrevolutionaries\\nuncharacteristically"
    assert secret_scan.scan(prose) == []


def test_secrets_over_lines():
    """Keys wrapped over lines, with last lines of every length, alone and one after the other."""
    import base64

    def der(tag, body):
        n = len(body)
        return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2, "big")) + body

    def lines(data, width=64):
        text = base64.b64encode(data).decode()
        return "\n".join(text[i : i + width] for i in range(0, len(text), width))

    def spans(text, kind):
        return [text[s:e] for s, e, k in secret_scan.scan(text) if k == kind]

    def private(n):
        return der(0x30, der(2, b"\0") + der(0x30, der(6, b"+ep")) + der(4, bytes(range(1, n + 1))))

    for n in range(34, 100):
        key = lines(private(n))
        for end in ("\n", "\r\n"):
            text = f"-----BEGIN PRIVATE KEY-----\n{key}\n-----END PRIVATE KEY-----\nand then".replace("\n", end)
            assert spans(text, "der") == [key.replace("\n", end)], n
        assert spans(f"{key}\n{key}\nword\n{key}", "der") == [key] * 3, n
        assert spans(key + "\nunfortunately_it_ends", "der") == [key]
    ed25519 = lines(der(0x30, der(2, b"\0") + der(0x30, der(6, b"+ep")) + der(4, bytes(range(34)))))
    assert len(ed25519) == 64 and spans("\n".join([ed25519] * 4), "der") == [ed25519] * 4
    for n in range(20, 80):
        public = lines(b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-rsa", b"\1\0\1", bytes(range(n)))), 70)
        assert spans(f"{public}\nword", "ssh") == [public.rstrip("=\n")] or spans(f"{public}\nword", "ssh") == [public], n
    assert not spans(lines(private(90))[:-9] + "\n-----END PRIVATE KEY-----", "der")


def test_perspectives(spark):
    got = QUERIES["op9_perspectives"](spark, SF).toPandas()
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{SF}/conversations.parquet')")
    want = con.sql(chat.OP9_SQL).df()
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))


def test_perspectives_edges(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "late"), (2, 0, "system", "alone"), (None, 0, "ann", "x"), (1, 600, "ann", "far")]
    out = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    by = {(r["conv_id"], r["speaker"], r["chunk"]): r for r in out}
    assert set(by) == {(1, s, 0) for s in ("ann", "bob", "unknown")} | {(None, "ann", 0)}
    r = by[1, "ann", 0]
    bob = "<|user name=bob|>\n\n<|end|>\n"
    assert r["text"] == "<|system|>\nrules\n<|end|>\n<|assistant|>\nhi\n<|end|>\n" + bob * 2 + "<|assistant|>\nfar\n<|end|>\n<|user name=unknown|>\nlate\n<|end|>\n"
    assert [r["text"][m["start"] : m["end"]] for m in r["masks"]] == ["hi\n<|end|>\n", "far\n<|end|>\n"] and r["n_turns"] == 6
    assert not chat.perspectives(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).collect()


def test_perspectives_long_conversations(spark):
    """Chunks go by a turn's place, whatever its number: with gaps, repeats, and turns without a number."""
    rng = random.Random(2)
    rows = [(c, rng.choice([None, *range(0, 4000, 7)]), rng.choice("ab"), rng.choice(["x", "yy", None])) for c in (1, 2, None) for _ in range(90)] + [(1, 5, "a", "same")] * 30
    got = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), chunk=8).collect()
    want = {}
    for c in (1, 2, None):
        mine = sorted(((t is None, t or 0, r, x or "") for k, t, r, x in rows if k == c))
        for s in "ab":
            for i in range(0, len(mine), 8):
                want[c, s, i // 8] = "".join(("<|assistant|>\n" if r == s else f"<|user name={r}|>\n") + x + "\n<|end|>\n" for _, _, r, x in mine[i : i + 8])
    assert {(r["conv_id"], r["speaker"], r["chunk"]): r["text"] for r in got} == want


def test_odd_rows(spark, odd):
    """Nulls, empty and long texts, repeated rows, clashing column names; and empty tables."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (7, 1, None), (None, 1, 1), (9, 0, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    for frame, n in ((odd, len(ODD)), (odd.where("false"), 0)):
        assert media.tiles(media.text_to_media(frame)).count() == n
        assert mixing.sample(frame.select("doc_id", "source", mixing.words_in("text").alias("size"))).count() == n
        assert mixing.take(frame).count() >= 0
        got = reassemble(packing.pack(frame.where("doc_id <> 5"), packing.default_vocabulary()).collect())
        ids = packing.PartIds(packing.default_vocabulary())
        assert got == {r[0]: (ids.whole(r[1]) if r[1] else b"") + b"\1\0\0\0" for r in ODD if r[0] not in (5, None)} or not n
        kept = suffixes.remove_repeats(frame).collect()
        assert len(kept) == n and all(bytes(r["kept"]) == b"" for r in kept if r["doc_id"] in (6, 7))
        model = toxicity.fit(frame, labels)
        assert toxicity.score(frame, model).count() == n
        near = minhash.near_duplicates(frame).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in near if r["doc_id"]) == ([(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (6, 6), (7, 7), (8, 8)] if n else [])
        assert parsing.compare_edited(frame).count() == n
        assert parsing.fingerprint(frame).count() == n
        assert secret_scan.secrets(frame).count() == n and secret_scan.redact(frame).count() == n
        assert quality.score(frame, quality.fit(frame, labels)).count() == n
    assert media.tiles(spark.createDataFrame([(None,), (b"junk",)], "media binary")).where("dhash is null").count() == 2


def test_pipeline(spark, texts):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = p.cut(p.keep_good(spark, docs, SF))
    ids = {r["doc_id"] for r in good.collect()}
    assert np.mean([i in ids for i, q in labels.items() if q]) > 0.97 and np.mean([i in ids for i, q in labels.items() if q == 0]) < 0.15
    apart = p.cut(p.drop_near_duplicates(spark, good, SF))
    classes = near_classes({i: texts[i] for i in ids}, 5)
    assert {r["doc_id"] for r in apart.collect()} == {i for i, (_, c) in classes.items() if i == c}
    clean = p.cut(p.remove_secrets(spark, apart, SF))
    assert all(not secret_scan.scan(r["text"]) for r in clean.collect())
    mixed = p.cut(p.mix_sources(spark, clean, SF))
    copies = Counter(r["doc_id"] for r in mixed.collect())
    want = mixing.sample(clean.select("doc_id", "source", mixing.words_in("text").alias("size"))).collect()
    assert copies == Counter({r["doc_id"]: r["copies"] for r in want if r["copies"]})
    packed = p.pack(spark, mixed, SF).collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == copies
    for frame in (good, apart, clean, mixed):
        assert frame.columns == docs.columns


def test_pipeline_stages_on_odd_rows(spark, odd):
    """Each stage on nulls, empty texts, rows that repeat, ids that repeat with other texts, and on no rows."""
    import corpus_pipeline as p

    frame = odd.union(spark.createDataFrame([(4, "other text", "en", "a", 1, "x", "y")], odd.schema))
    for docs, n in ((frame, len(ODD) + 1), (frame.where("false"), 0)):
        for name, stage in p.STAGES:
            out = stage(spark, docs, SF)
            rows = out.collect()
            if name == "pack":
                assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) and sum(r["start"] == 0 for r in rows) == n
            else:
                assert out.columns == p.COLUMNS
                have = Counter(r["doc_id"] for r in docs.collect())
                assert all(k <= {"mix": 2, "near_duplicates": 1}.get(name, 1) * max(1, have[i]) for i, k in Counter(r["doc_id"] for r in rows).items())
            if name == "secrets":
                assert len(rows) == n and sum(r["text"] is None for r in rows) == (1 if n else 0)
            if name == "near_duplicates" and n:
                assert sorted((r["doc_id"] or 0, r["text"] or "")[0] for r in rows) == [0, 1, 2, 3, 4, 4, 6, 7, 8]
