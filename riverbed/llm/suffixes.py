"""Removal of long repeated byte strings: suffix arrays of shards in numpy, common prefixes, and merging of shards.

A string of `length` bytes that starts at two places has the same smallest 32-gram (its anchor) at both. So documents
are first cut into anchored segments; only segments whose anchor occurs again, anywhere, are dealt out by anchor to
shards, which sort all their suffixes. Nothing else can hold a repeat, so the result is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES, U, cut, groups, mix64, powers, prefix_hashes, slice_hashes, table, utf8

LENGTH = 200
GRAM = 32
#: Bytes of segments in one suffix array. A suffix's number has 21 bits there.
SHARD_BYTES = 1 << 20
#: Bytes of one key's segments beyond which they are dealt in parts of half as many.
KEY_BYTES = 1 << 18
_PLACE = U((1 << 24) - 1)


def _anchors_of(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For maximal runs of window starts with one anchor: its hash, first and last start, number of anchors merged."""
    grams = np.arange(len(data) - GRAM + 1)
    h = slice_hashes(prefix_hashes(mix64(data.astype(U) + U(1))), grams, grams + GRAM)
    w = length - GRAM + 1  # grams in a window
    n = len(h) - w + 1  # windows
    packed = (h & ~_PLACE) | np.arange(len(h), dtype=U)
    full = np.full(-(-len(h) // w) * w, ~U(0), U)
    full[: len(h)] = packed
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & _PLACE).astype(np.int64)  # the leftmost of the least
    first = np.flatnonzero(np.diff(at, prepend=-1))
    key = h[at[first]]
    # in periodic text the same anchor comes again and again: one segment
    new = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    last = np.append(first[new[1:]], n) - 1
    return key[new], first[new], last, np.diff(np.append(new, len(key)))


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As above for a text of any length, in steps that overlap by length - 1 bytes."""
    if len(data) < length:
        return np.zeros(0, U), *(np.zeros(0, np.int64),) * 3
    found = []
    for at in range(0, len(data) - length + 1, STEP_BYTES):
        key, lo, hi, n = _anchors_of(np.frombuffer(data, np.uint8, min(STEP_BYTES + length - 1, len(data) - at), at), length)
        found.append((key, lo + at, hi + at, n))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def suffix_array(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of strings laid one after another; ends: of each, the place of its sentinel (any byte).

    Larsson-Sadakane: suffixes are ordered by their first bytes, then groups that tie are refined by the rank of what
    follows, twice as far each time; suffixes alone in their group are never touched again. Sentinels differ and sort first.
    """
    n = len(data)
    end = ends[np.searchsorted(ends, np.arange(n))]
    used = np.unique(data)
    bits = max(1, int(len(used)).bit_length())
    code = np.zeros(256, U)
    code[used] = np.arange(1, len(used) + 1, dtype=U)
    symbols = code[data]
    symbols[ends] = 0
    width, index_bits = max(1, 40 // bits), U(max(1, int(n).bit_length()))
    width = min(width, (63 - int(index_bits)) // bits)
    key, place = np.zeros(n, U), np.arange(n)
    for k in range(width):
        at = place + k
        key = (key << U(bits)) | np.where(at < end, symbols[np.minimum(at, n - 1)], U(0))
    mask = (U(1) << index_bits) - U(1)
    packed = np.sort((key << index_bits) | place.astype(U))
    order, key = (packed & mask).astype(np.int64), packed >> index_bits
    head = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    rank = np.empty(n, np.int64)
    size = np.diff(np.append(head, n))
    rank[order] = np.repeat(head, size)
    order[: len(ends)] = ends  # the sentinels' key is 0 and no other's
    rank[ends] = np.arange(len(ends))
    open_ = np.repeat(size > 1, size)
    open_[: len(ends)] = False
    slots, h = np.flatnonzero(open_), width
    while len(slots):
        who = order[slots]
        group = rank[who]
        follow = rank[np.minimum(who + h, end[who])]
        # group numbers and ranks have up to 21 bits each, as has the place within slots
        packed = (group.astype(U) << (index_bits + index_bits)) | (follow.astype(U) << index_bits) | np.arange(len(slots), dtype=U)
        packed.sort()
        who = who[(packed & mask).astype(np.int64)]
        order[slots] = who
        pair = packed >> index_bits
        head = np.flatnonzero(np.diff(pair, prepend=~pair[:1]))
        size = np.diff(np.append(head, len(slots)))
        rank[who] = np.repeat(slots[head], size)
        slots = slots[np.repeat(size > 1, size)]
        h *= 2
    return order, rank


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each place, the common prefix of its suffix with the one sorted just before it (Kasai, in text order).

    Where the bytes before both suffixes agree, the value is one less than at the place before, so only the other
    places are compared byte by byte (by eight), and the rest follow by subtraction.
    """
    n = len(data)
    end = ends[np.searchsorted(ends, np.arange(n))]
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = order[0]
    place = np.arange(n)
    inside = np.ones(n, bool)
    inside[ends] = False
    follows = np.zeros(n, bool)
    # a place's predecessor in the text must be a byte of the same string, for both suffixes
    ok = (place > 0) & (before > 0)
    follows[ok] = (inside[place[ok] - 1]) & (inside[before[ok] - 1]) & (data[place[ok] - 1] == data[before[ok] - 1])
    follows[1:] &= rank[:-1] > 0
    most = np.minimum(end - place, end[before] - before)
    most[order[0]] = 0
    start = np.flatnonzero(~follows)
    value = np.zeros(n, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    live, done = start, 0
    while len(live):
        live = live[most[live] > done]
        a, b = eight[live + done], eight[before[live] + done]
        same = (a == b).all(axis=1)
        stop = live[~same]
        value[stop] = done + np.argmin(a[~same] == b[~same], axis=1)
        live, done = live[same], done + 8
        value[live] = done
    value = np.minimum(value, most)
    origin = np.maximum.accumulate(np.where(follows, 0, place))
    return np.minimum(value[origin] - (place - origin), most)


def repeats(segments: list[bytes], owners: np.ndarray, places: np.ndarray, twice: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, whether each window start in it has a like one at another (owner, place).

    places: of the segment's first byte in its owner; twice: the segment is known to stand elsewhere as a whole.
    """
    data = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    sizes = np.array([len(s) + 1 for s in segments])
    ends = np.cumsum(sizes) - 1
    order, rank = suffix_array(data, ends)
    prefix = common_prefixes(data, ends, order, rank)
    of = np.repeat(np.arange(len(segments)), sizes)
    at = np.arange(len(data)) - np.repeat(ends - sizes + 1, sizes)
    who = mix64(owners.astype(U)[of] + mix64((places[of] + at).astype(U)))
    joined = prefix[order] >= length  # with the suffix just before
    hit = np.zeros(len(data), bool)
    near = joined.copy()
    near[:-1] |= joined[1:]
    runs = np.flatnonzero(near)
    if len(runs):
        places_ = order[runs]
        first = np.flatnonzero(~joined[runs])  # each run starts with one that isn't joined to what is before it
        differ = (np.minimum.reduceat(who[places_], first) != np.maximum.reduceat(who[places_], first)) | np.logical_or.reduceat(twice[of[places_]], first)
        hit[places_] = np.repeat(differ, np.diff(np.append(first, len(runs))))
    hit |= twice[of]
    return [hit[e - s + 1 : max(e - s + 1, e - length + 1)] for e, s in zip(ends, sizes, strict=True)]


def windows(shard: list[tuple], length: int) -> np.ndarray:
    """Different windows of a shard, sorted: two hashes of each (128 bits), then owner, tag and start of the only place where
    it stands there, or start -1 where it stands twice, which the shard itself has found."""
    found = []
    for data, owners, places, hit in shard:
        x = np.frombuffer(data, np.uint8).astype(U)
        at = np.arange(len(hit))
        one, two = (slice_hashes(prefix_hashes(mix64(x + salt)), at, at + length).view(np.int64) for salt in (U(1), U(1 << 20)))
        owner, tag = owners[0]
        found.append(np.stack([one, two, np.full(len(at), owner), np.full(len(at), tag), np.where(hit, -1, places[0] + at)], 1))
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 1], every[:, 0]))]
    return every[np.append(True, (np.diff(every[:, :2], axis=0) != 0).any(1))] if len(every) else every


def meet(known: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the sorted windows of a further shard into those known by binary search. Returns what is known then, and the
    places (owner, tag, start) that have a like window in the other."""
    at = np.searchsorted(known[:, 0], more[:, 0])
    k = np.minimum(at, len(known) - 1)
    same = (known[k, :2] == more[:, :2]).all(1) if len(known) else np.zeros(len(more), bool)
    hits = np.concatenate([more[same, 2:], known[k[same], 2:]]) if same.any() else np.zeros((0, 3), np.int64)
    known[k[same], 4] = -1
    return np.insert(known, at[~same], more[~same], axis=0), hits[hits[:, 2] >= 0]


def _shard(rows: list[tuple], length: int) -> list[tuple]:
    """rows: (owner, place, bytes). Like segments are sorted once. Returns (bytes, owners, places, hits)."""
    by: dict[bytes, list[tuple]] = {}
    for owner, place, data in rows:
        by.setdefault(data, []).append((owner, place))
    where = [sorted(set(x)) for x in by.values()]
    ids = np.array([x[0][0] for x in where], np.int64).astype(U)
    owners = mix64(mix64(ids[:, 0]) ^ ids[:, 1])
    hits = repeats(list(by), owners, np.array([x[0][1] for x in where]), np.array([len(x) > 1 for x in where]), length)
    return [(data, [x[0] for x in at], [x[1] for x in at], hit) for data, at, hit in zip(by, where, hits, strict=True)]


def _found(shard: list[tuple], length: int) -> pd.DataFrame:
    out = []
    for _, owners, places, hit in shard:
        edges = np.flatnonzero(np.diff(hit, prepend=False, append=False))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            out += [(o, t, p + s, p + e - 1 + length) for (o, t), p in zip(owners, places, strict=True)]
    return pd.DataFrame(out, columns=["owner", "tag", "start", "end"], dtype="int64").assign(key=0, range=0, windows=None)


def _runs(hits: np.ndarray, length: int) -> pd.DataFrame:
    """(owner, tag, start, end) of what windows at the places (owner, tag, start) cover, neighbours together."""
    hits = hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))]
    new = np.append(True, (np.diff(hits[:, :2], axis=0) != 0).any(1) | (np.diff(hits[:, 2]) > 1)) if len(hits) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hits)) - 1
    return pd.DataFrame({"owner": hits[first, 0], "tag": hits[first, 1], "start": hits[first, 2], "end": hits[last[: len(first)], 2] + length})


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, owner (the id, or for a row that has none one made from its text), _t (the text) and tag (of the text)."""
    texts = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("_t")).withColumn("_sha", F.unhex(F.sha2("_t", 256)))
    return texts.select("doc_id", F.coalesce("doc_id", F.xxhash64("_sha")).alias("owner"), F.xxhash64("_sha").alias("tag"), "_sha", "_t")


def spans(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """For each different text with something to remove (owner: its document; tag: a hash of it): covered, an array of
    byte ranges (start, end), which may overlap; or copies > 1, the number of rows that hold it.

    A text that stands twice and has at least length bytes is covered whole; of such copies only the one with the least
    id is searched, and a row for each of them is returned. Null texts are empty; shorter texts are never returned.
    """

    def cut_up(batches):
        for b in batches:
            data = [utf8(t) for t in b["_t"]]
            found = [anchors(d, length) for d in data]
            yield pd.DataFrame(
                {"owner": b.owner, "tag": b.tag, "sha": b["_sha"], "n_bytes": [len(d) for d in data], "key": [f[0].view(np.int64) for f in found]}
                | {k: [f[i].astype(np.int32) for f in found] for i, k in ((1, "lo"), (2, "hi"), (3, "n"))}
            )

    texts = _texts(docs, text)
    marked = cut(texts.drop("doc_id").mapInPandas(cut_up, "owner long, tag long, sha binary, n_bytes long, key array<long>, lo array<int>, hi array<int>, n array<int>"))
    copies = marked.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.min("owner").alias("owner"), F.first("tag").alias("tag"), F.count(F.lit(1)).alias("copies"))
    copies = cut(copies)
    # rows that repeat in full are found more than once here; what follows holds each place once
    segments = marked.join(copies.select("owner", "tag"), ["owner", "tag"]).select("owner", "tag", F.explode(F.arrays_zip("key", "lo", "hi", "n")).alias("s"))
    segments = segments.select("owner", "tag", "s.key", "s.lo", "s.hi", "s.n")
    again = segments.groupBy("key").agg(F.sum("n").alias("_n"), F.sum(F.col("hi") - F.col("lo") + length).alias("_bytes")).where("_n > 1")
    parts = F.when(F.col("_bytes") > KEY_BYTES, F.ceil(F.col("_bytes") * 2 / KEY_BYTES)).otherwise(1).cast("long")
    wanted = segments.join(again.select("key", parts.alias("parts")), "key").groupBy("owner", "tag").agg(F.collect_list(F.struct("key", "lo", "hi", "parts")).alias("segments"))

    step = max(1, SHARD_BYTES // 4)  # windows of a segment that are dealt together

    def fetch(batches):
        columns = ["key", "part", "parts", "owner", "tag", "lo", "data"]
        for b in batches:
            for g in groups([sum(r["hi"] - r["lo"] + length for r in s) for s in b.segments], 1 << 24):
                rows = []
                for owner, tag, t, found in zip(b.owner[g], b.tag[g], b["_t"][g], b.segments[g], strict=True):
                    data = utf8(t)
                    rows += [(r["key"], 0, r["parts"], owner, tag, lo, data[lo : min(r["hi"], lo + step - 1) + length]) for r in found for lo in range(r["lo"], r["hi"] + 1, step)]
                out = pd.DataFrame(rows, columns=columns)
                if len(out):
                    spread = mix64(out.owner.to_numpy(np.int64).astype(U) + mix64(out.tag.to_numpy(np.int64).astype(U) + out.lo.to_numpy(np.int64).astype(U)))
                    out["part"] = (spread % out.parts.to_numpy(np.int64).astype(U)).astype(np.int64)
                yield out

    # the same columns as remove_repeats() joins, so that texts are shuffled once for both
    pieces = texts.drop("_sha").join(wanted, ["owner", "tag"])
    dealt = pieces.mapInPandas(fetch, "key long, part long, parts long, owner long, tag long, lo long, data binary").repartition("key", "part").sortWithinPartitions("key", "part", "owner", "tag", "lo")

    def work(batches):
        """Shards of about SHARD_BYTES. Keys that fit are never cut; those that don't are dealt in parts, each with shards
        of its own, and what windows these have goes on, by range of hash, to be met with those of the others."""
        shard: list[tuple] = []
        of_key: list[tuple] = []
        size, at, several = [0, 0], (None, 0, 1), False

        def large():
            nonlocal of_key, size
            done = _shard(of_key, length)
            of_key, size = [], [size[0], 0]
            yield _found(done, length)
            w = windows(done, length)
            place = (w[:, 0].view(U) >> U(32)) * U(at[2]) >> U(32)  # ranges: as many as parts
            order = np.argsort(place, kind="stable")
            some, first = np.unique(place[order], return_index=True)
            blobs = [x.tobytes() for x in np.split(w[order], first[1:])]
            yield pd.DataFrame({"owner": 0, "tag": 0, "start": 0, "end": 0, "key": at[0], "range": some.astype(np.int64), "windows": blobs})

        def end_of_key():
            nonlocal shard, of_key, size, several
            if several or at[2] > 1:
                if of_key:
                    yield from large()
                several = False
            elif size[0] + size[1] > SHARD_BYTES and shard:
                yield _found(_shard(shard, length), length)
                shard, of_key, size = of_key, [], [size[1], 0]
            else:
                shard, of_key, size = shard + of_key if len(of_key) > 1 else [*shard, *of_key], [], [sum(size), 0]

        for b in batches:
            for k, part, parts, owner, tag, lo, data in zip(b.key, b.part, b.parts, b.owner, b.tag, b.lo, b["data"], strict=True):
                if (k, part) != at[:2]:
                    yield from end_of_key()
                    at = (k, part, parts)
                elif size[1] >= SHARD_BYTES:
                    yield from large()
                    several = True
                of_key.append(((owner, tag), lo, bytes(data)))
                size[1] += len(data)
        yield from end_of_key()
        if shard:
            yield _found(_shard(shard, length), length)

    def join_up(batches):
        at, known = None, None
        for b in batches:
            for k, r, blob in zip(b.key, b["range"], b.windows, strict=True):
                w = np.frombuffer(blob, np.int64).reshape(-1, 5)
                if (k, r) != at:
                    at, known = (k, r), np.zeros((0, 5), np.int64)
                known, hits = meet(known, w)
                yield _runs(hits, length)

    worked = cut(dealt.mapInPandas(work, "owner long, tag long, start long, end long, key long, range long, windows binary"))
    met = worked.where("windows is not null").select("key", "range", "windows").repartition("key", "range").sortWithinPartitions("key", "range")
    every = worked.where("windows is null").select("owner", "tag", "start", "end").union(met.mapInPandas(join_up, "owner long, tag long, start long, end long"))
    covered = every.groupBy("owner", "tag").agg(F.collect_set(F.struct("start", "end")).alias("covered"))
    several = marked.select("owner", "tag", "sha").join(copies.where("copies > 1").select("sha", "copies"), "sha").select("owner", "tag", "copies").distinct()
    return covered.join(several, ["owner", "tag"], "full_outer")


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """Each row's doc_id with n_bytes, kept (binary: the bytes that stay) and removed: array of (start, end).

    Every byte is removed that a string of length bytes covers which also starts elsewhere, in any document. A text of
    at least length bytes that stands in two rows goes whole. Texts shorter than that stay, as do empty and null ones.
    """

    def apply(batches):
        for b in batches:
            out = []
            for t, copies, r in zip(b["_t"], b.copies.fillna(0), b.covered, strict=True):
                data = utf8(t)
                ranges = [(0, len(data))] if copies > 1 else union([(x["start"], x["end"]) for x in r] if r is not None else [])
                kept, at = [], 0
                for s, e in ranges:
                    kept.append(data[at:s])
                    at = e
                kept.append(data[at:])
                out.append((len(data), b"".join(kept), [{"start": s, "end": e} for s, e in ranges]))
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "n_bytes": [o[0] for o in out], "kept": [o[1] for o in out], "removed": [o[2] for o in out]})

    joined = _texts(docs, text).drop("_sha").join(spans(docs, length, text), ["owner", "tag"], "left").drop("owner", "tag")
    return joined.mapInPandas(apply, "doc_id long, n_bytes long, kept binary, removed array<struct<start:long,end:long>>")


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs covered by half-open ranges."""
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 200-byte strings that also stand elsewhere."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
