"""Near duplicates: circulant MinHash, banding, and exact Jaccard verification of word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, cut, mix64, release, table, text_groups, utf8, words

#: Two sets of similarity 0.8 share a band with probability 0.33, so all bands miss them 3 times in a million; at 0.9, never.
BANDS, ROWS = 32, 5
#: Documents of one band key beyond which their pairs are formed under the rare shingles that they share.
LARGE_KEY = 16
#: Rounds in which documents of such keys are first compared with one each for two bands that they share, and how many bands must
#: be equal for that: at a similarity of 0.8 some 10 are, and all but 3 in 100 such pairs have so many. What they miss comes later.
ROUNDS, EQUAL_BANDS = 3, 6
#: A further round is made only if the last one linked one in so many of the pairs that it tried: where hardly any are similar
#: enough, rounds leave as many components as they found.
WORTH = 10
#: Documents under one rare shingle that one task compares with others; more are dealt to further tasks.
MEMBERS = 4096
#: Counters (of four bytes) that shingles of such documents are hashed to, to tell rare ones, and how many go in one row.
COUNTERS, COUNTER_ROW = 1 << 20, 1 << 14
#: Texts that one task compares with one and the same text; more are dealt to further tasks.
FOLLOWERS = 512
#: Ids up to which a set of documents is broadcast to filter the texts before their shuffle (16 bytes or so each).
BROADCAST_IDS = 500_000
_STEP, _SPREAD = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles of width words (fewer words: the whole sequence), and their numbers."""
    h, _, counts = words(texts)
    sets = []
    at = 0
    for n in counts.tolist():
        w, at = h[at : at + n], at + n
        if n >= width:
            s = np.zeros(n - width + 1, U)
            for j in range(width):
                s = mix64(s + w[j : j + len(s)])
        else:
            s = w[:1].copy() + U(n)
            for j in range(1, n):
                s = mix64(s * U(0xD6E8FEB86659FD93) + w[j])
        sets.append(np.unique(s))
    return (np.concatenate(sets) if sets else np.zeros(0, U)), np.array([len(s) for s in sets], np.int64)


def signatures(values: np.ndarray, counts: np.ndarray, k: int, first: int = 0, mask: int = 0xFFFFFFFF) -> np.ndarray:
    """k coordinates from the first one for each non-empty set, and of each the bits in mask. The first permutation (sigma) places a shingle on a circle of 2**32; the
    second (pi), turned by one place for each coordinate, orders the circle; a coordinate is a set's least value."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    sigma = (mix64(values + U(0x1234567)) >> U(32)).astype(np.uint32) * _STEP
    out = np.empty((len(counts), k), np.uint32 if mask > 255 else np.uint8)
    for i in range(k):
        x = sigma + np.uint32(((first + i) * int(_STEP)) & 0xFFFFFFFF)  # the turn, before pi's first factor
        x ^= x >> np.uint32(15)
        x *= _SPREAD
        x ^= x >> np.uint32(13)
        out[:, i] = np.minimum.reduceat(x, starts) & np.uint32(mask)
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """BANDS keys a set; keys of different bands differ."""
    s = coordinates.astype(U).reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=U)), s.shape[:2]).copy()
    for j in range(ROWS):
        key = mix64(key + s[:, :, j])
    return key.view(np.int64)


def sketch(docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (of the set; equal sets, equal values) and bands, an array of BANDS keys (none for an empty set)."""

    def run(batches):
        for b in batches:
            size = b.num_rows
            n, h1, h2, bands = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64), [None] * size
            for g, data in text_groups(b, text):
                values, counts = shingles(data, width)
                n[g] = counts
                full = np.flatnonzero(counts) + g.start
                if not len(full):
                    continue
                counts = counts[counts > 0]
                starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
                h1[full] = np.add.reduceat(mix64(values), starts).view(np.int64)
                h2[full] = np.bitwise_xor.reduceat(mix64(values * U(0x9E3779B97F4A7C15) + U(9)), starts).view(np.int64)
                for i, k in zip(full, band_keys(signatures(values, counts, BANDS * ROWS)), strict=True):
                    bands[i] = k
            columns = [b.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(h1), pa.array(h2), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "h1", "h2", "bands"])
        release()

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id stands in ids (distinct), without a shuffle of texts while ids are few."""
    ids = cut(ids)
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs.doc_id == ids.id, "left_semi")


def _bucket(values: np.ndarray) -> np.ndarray:
    return (mix64(values) % U(COUNTERS)).astype(np.int64)


def rarity(docs: DataFrame, width: int, text: str = "text") -> np.ndarray:
    """In how many of docs the shingles of each of COUNTERS buckets stand: never less than for the shingle itself. Each task
    adds up its own counters, then one task for each COUNTER_ROW of them adds those of all tasks, a row at a time."""

    def count(batches):
        seen = np.zeros(COUNTERS, np.uint32)
        for b in batches:
            for _, data in text_groups(b, text):
                k, n = np.unique(_bucket(shingles(data, width)[0]), return_counts=True)
                seen[k] += n.astype(np.uint32)
        for i in range(0, COUNTERS, COUNTER_ROW):
            if (part := seen[i : i + COUNTER_ROW]).any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.tobytes()], pa.binary())], ["part", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[i] = sums.get(i, np.uint32(0)) + np.frombuffer(c, np.uint32)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])
        release()

    schema = "part long, counts binary"
    out = np.zeros(COUNTERS, np.uint32)
    for r in docs.select(text).mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect():  # COUNTERS numbers, whatever the input
        out[r["part"] : r["part"] + COUNTER_ROW] = np.frombuffer(r["counts"], np.uint32)
    return out


def rare_shingles(docs: DataFrame, seen: np.ndarray, width: int, percent: int, text: str = "text") -> DataFrame:
    """(id, n, i, token): of each text, with n shingles, those at the places i of the rarest first (by bucket, then hash) that
    a set of the given similarity must share at least one of; but for shingles that stand in one text alone."""
    held = docs.sparkSession.sparkContext.broadcast(seen)

    def run(batches):
        seen = held.value
        for b in batches:
            ids = b.column("doc_id").cast(pa.int64())
            for g, data in text_groups(b, text):
                values, counts = shingles(data, width)
                often = seen[_bucket(values)]
                doc, place, token, at = [], [], [], 0
                for d, n in enumerate(counts.tolist()):
                    v, c, at = values[at : at + n], often[at : at + n], at + n
                    first = np.lexsort((v, c))[: n - -(-percent * n // 100) + 1]
                    i = np.flatnonzero(c[first] > 1)
                    doc.append(np.full(len(i), d))
                    place.append(i)
                    token.append(v[first[i]])
                doc = np.concatenate(doc)
                columns = [ids[g].take(pa.array(doc)), pa.array(counts[doc]), pa.array(np.concatenate(place).astype(np.int64)), pa.array(np.concatenate(token).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "i", "token"])
        release()

    return docs.select("doc_id", text).mapInArrow(run, "id long, n long, i long, token long")


def likely(placed: DataFrame, classes: DataFrame, percent: int, shift: int) -> DataFrame:
    """Pairs (a, b) of different components among the documents of placed (key, rep, n, c), at most one for each document: of the
    least ones that share a band of placed and the one that comes shift later with it, that with most equal bands, if EQUAL_BANDS
    are. Bands that no longer part components aren't looked at: a document has as many rows as it has bands in placed."""
    held = placed.join(classes.select("rep", "bands"), "rep")
    later = F.pmod(F.array_position("bands", F.col("key")).cast("int") - 1 + shift, F.lit(BANDS))
    at = held.select("rep", "n", "c", "bands", F.col("key").alias("_k"), F.get("bands", later).alias("_k2"))
    pivots = at.groupBy("_k", "_k2").agg(F.min(F.struct("c", "rep", "n", "bands")).alias("_p"), F.max("c").alias("_h")).where("_p.c < _h").drop("_h")
    equal = F.size(F.filter(F.zip_with("bands", "_p.bands", lambda x, y: x == y), lambda x: x))
    fits = 100 * F.least("n", "_p.n") >= percent * F.greatest("n", "_p.n")
    near = at.join(pivots, ["_k", "_k2"]).where((F.col("c") != F.col("_p.c")) & fits).select("rep", F.struct(equal.alias("e"), F.col("_p.rep").alias("r")).alias("_e"))
    best = near.groupBy("rep").agg(F.max("_e").alias("_e")).where(F.col("_e.e") >= EQUAL_BANDS)
    return best.select(F.greatest("rep", "_e.r").alias("a"), F.least("rep", "_e.r").alias("b")).distinct()


def still_split(placed: DataFrame) -> DataFrame:
    """The rows of placed (key, rep, n, c) whose key has documents of several components."""
    split = placed.groupBy("key").agg(F.min("c").alias("_l"), F.max("c").alias("_h")).where("_l < _h").select("key")
    return placed.join(split, "key", "left_semi")


def joined(placed: DataFrame, links: DataFrame) -> DataFrame:
    """placed (key, rep, n, c) with the components that links (a, b) between its documents put together; only keys still split."""
    of = placed.select(F.col("rep").alias("_r"), F.col("c").alias("_c")).distinct()
    edges = links.join(of, F.col("a") == F.col("_r")).select("b", F.col("_c").alias("_a")).join(of, F.col("b") == F.col("_r")).select(F.col("_a").alias("a"), F.col("_c").alias("b"))
    found = components(edges)
    return still_split(cut(placed.join(found, placed.c == found.id, "left").select("key", "rep", "n", F.coalesce("component", "c").alias("c"))))


def crowded(placed: DataFrame, docs: DataFrame, width: int, percent: int, text: str = "text") -> DataFrame:
    """Pairs (a, b) of documents in placed (key, rep, c: component) that share a key, have different components and may be
    similar enough; no such pair is left out.

    In a family of copies that differ a little too much nearly all pairs share some band. So pairs are formed under a
    shingle that both have among their rarest (two sets of the similarity share one there), and only if enough shingles
    come after it in both: if it is the first that they share, those before it are in one set alone. Under a shingle, the
    documents of the component that has most of them aren't paired with each other: all others are paired with them, so
    that rows grow with the documents outside it times those under the shingle.
    """
    who = cut(placed.groupBy("rep").agg(F.first("c").alias("c"), F.collect_set("key").alias("keys")))  # at most BANDS keys
    texts = only(docs, who.select(F.col("rep").alias("id")))
    rare = rare_shingles(texts, rarity(texts, width, text), width, percent, text)
    every = cut(rare.join(who, rare.id == who.rep).select("token", "rep", "n", "i", "c", "keys"))
    sizes = every.groupBy("token", "c").agg(F.count(F.lit(1)).alias("m"))
    tokens = sizes.groupBy("token").agg(F.max(F.struct("m", "c")).alias("_m"), F.sum("m").alias("_all"))
    tokens = tokens.where("_m.m < _all").select("token", F.col("_m.c").alias("_main"), F.ceil(F.col("_all") / MEMBERS).alias("_parts"))
    every = cut(every.join(tokens, "token"))
    left = every.where("c <> _main").withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    right = every.select("token", "_main", F.pmod(F.xxhash64("rep"), F.col("_parts")).alias("_p"), *(F.col(x).alias(f"{x}_") for x in ("rep", "n", "i", "c", "keys")))
    most = F.least(F.col("n") - F.col("i"), F.col("n_") - F.col("i_"))
    once = (F.col("c_") == F.col("_main")) | (F.col("c") < F.col("c_"))
    may = once & (100 * most >= percent * (F.col("n") + F.col("n_") - most)) & F.arrays_overlap("keys", "keys_")
    pairs = left.drop("_main", "_parts").join(right, ["token", "_p"]).where(may)
    return pairs.select(F.greatest("rep", "rep_").alias("a"), F.least("rep", "rep_").alias("b"))


def verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int, text: str = "text") -> DataFrame:
    """Those pairs (a, b) of documents for which 100 * intersection >= percent * union, on their full sets of shingles."""
    texts = only(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()).select("doc_id", F.coalesce(text, F.lit("")).alias("_t"))
    # a text that very many are compared with goes to several tasks
    heavy = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / FOLLOWERS).alias("_parts")).where("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    salted = pairs.join(heavy, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), parts).alias("_p"))
    left = salted.join(texts, salted.a == texts.doc_id).select("a", "b", "_p", F.col("_t").alias("_ta"))
    right = texts.join(heavy, texts.doc_id == heavy.b, "left").select(F.col("doc_id").alias("_b"), F.col("_t").alias("_tb"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_q"))
    both = left.join(right, (F.col("b") == F.col("_b")) & (F.col("_p") == F.col("_q"))).select("a", "b", "_ta", "_tb")

    def run(batches):
        known, of = np.zeros(0, U), None
        for x in batches:
            keep = np.zeros(len(x), bool)
            for i, (b, ta, tb) in enumerate(zip(x.b, x["_ta"], x["_tb"], strict=True)):
                if (b, tb) != of:  # rows come in the order of b
                    known, of = shingles([utf8(tb)], width)[0], (b, tb)
                mine = shingles([utf8(ta)], width)[0]
                if 100 * min(len(mine), len(known)) >= percent * max(len(mine), len(known)):
                    common = len(mine) + len(known) - len(np.unique(np.concatenate([mine, known])))
                    keep[i] = common > 0 and 100 * common >= percent * (len(mine) + len(known) - common)
            yield x.loc[keep, ["a", "b"]]
        release()

    return both.mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that can be reached, for every id that stands in edges (a, b).

    Alternating stars: each vertex's larger neighbours are hung on its least one, then its smaller ones, until no edge
    changes. Every round is a join and an aggregation, cut from its past by a written table.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    inner = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return inner.union(edges.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component")))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the least doc_id reachable over links), kept.

    Documents of equal sets form one class; its least doc_id stands for it. Within the documents of one band key, each
    is compared with the least; pairs of documents that are still in different components after that are compared too,
    so that no link that shares a band is lost if it joins two components (where a key has more than LARGE_KEY documents, rounds
    of likely pairs come first, as long as they link some, so that few components are left): pairs that aren't formed can't be similar
    enough by their sizes, or by their rarest shingles where a key has more than LARGE_KEY documents. A document without
    words (empty or null text) is linked with nothing, nor is one without an id: its component is its own doc_id, and kept
    is true. An empty table gives no rows; other columns of docs are ignored.
    Rows that repeat a doc_id are taken one by one; those of equal sets share a component.
    """
    docs = docs.select("doc_id", text)
    rows = cut(sketch(docs, width, text))
    classes = cut(rows.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    keyed = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("_x")).where("pivot < _x").drop("_x")
    near = cut(keyed.join(shared, "key"))
    best = near.where("rep > pivot").groupBy("rep", "pivot").agg(F.count(F.lit(1)).alias("c")).groupBy("rep").agg(F.max(F.struct("c", -F.col("pivot"))).alias("m"))
    first = cut(best.select(F.col("rep").alias("a"), (-F.col("m.col2")).alias("b")))
    links = cut(verify(first, docs, width, percent, text))
    found = components(links)
    placed = cut(near.join(found, near.rep == found.id, "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("c")))
    split = placed.groupBy("key").agg(F.min("c").alias("_l"), F.max("c").alias("_h"), F.count(F.lit(1)).alias("m")).where("_l < _h").select("key", "m")
    placed = cut(placed.join(split, "key"))
    few = placed.where(F.col("m") <= LARGE_KEY).select("key", "rep", "n", "c")
    other = few.select("key", *(F.col(x).alias(f"{x}_") for x in few.columns if x != "key"))
    fits = 100 * F.least("n", "n_") >= percent * F.greatest("n", "n_")
    pairs = few.join(other, "key").where((F.col("c") < F.col("c_")) & fits).select(F.greatest("rep", "rep_").alias("a"), F.least("rep", "rep_").alias("b"))
    many, tried = cut(placed.where(F.col("m") > LARGE_KEY).drop("m")), first
    for shift in range(1, ROUNDS + 1):
        if many.isEmpty():
            break
        tries = cut(likely(many, classes, percent, shift).join(tried, ["a", "b"], "left_anti"))
        formed = tries.count()
        if not formed:
            break
        more = cut(verify(tries, docs, width, percent, text))
        linked = more.count()
        links, tried = links.union(more), tried.union(tries)
        many = cut(joined(many, more)) if linked else many
        if WORTH * linked < formed:
            break
    if not many.isEmpty():
        pairs = pairs.union(crowded(many, docs, width, percent, text))
    pairs = cut(pairs.distinct().join(tried, ["a", "b"], "left_anti"))
    # one row a component is enough where the second round links nothing
    all_links = links.union(cut(verify(pairs, docs, width, percent, text)))
    final = cut(components(all_links))
    reps = classes.join(final, classes.rep == final.id, "left").select("h1", "h2", F.coalesce("component", "rep").alias("_c"))
    out = rows.drop("bands").join(reps, ["h1", "h2"], "left")
    out = out.withColumn("component_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("_c")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 4-word shingles, similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)
