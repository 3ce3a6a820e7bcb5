"""Phrases whose words keep company: n-grams of word ids counted without loss in counting quotient filters, merged by ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U, cut, mix64, release, table, text_groups

#: Words of one shard: a block of texts of one language with word ids of its own.
SHARD_WORDS = 1 << 20
#: Entries that one task merges at a time, and about so many in one range of quotients.
MERGE, RANGE = 1 << 21, 1 << 21
#: Groups of word hashes in which ids are given, and parts of a language's phrases that are ranked before the whole.
GROUPS, PARTS = 1 << 10, 64
#: Bytes that end a piece (fixed values), as one that no UTF-8 text holds; A-Z as a-z.
CLEAN = bytes(c + 32 if 65 <= c <= 90 else 255 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in range(256))
#: Bytes of text that are split into words at a time.
STEP = 1 << 20


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, and b"\\xff" where a piece ends, of about STEP bytes at a time."""
    clean = text.translate(CLEAN)
    at = 0
    while at < len(clean):
        end = at + STEP
        if end < len(clean):
            found = [x for x in (clean.find(c, end) for c in (b" ", b"\t", b"\xff")) if x >= 0]
            end = min(found, default=len(clean))
        yield clean[at:end].replace(b"\xff", b" \xff ").split()
        at = end


class Shard:
    """Texts of one language as numbers of words, in the order of their first coming; 0 ends a piece."""

    def __init__(self, lead: list[bytes]):
        self.numbers: dict[bytes, int] = {b"\xff": 0}
        self.parts: list[np.ndarray] = []
        self.size = 0
        self.add(lead)
        self.lead = self.size

    def add(self, words: list[bytes]) -> None:
        numbers = self.numbers
        for w in words:
            if w not in numbers:
                numbers[w] = len(numbers)
        self.parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
        self.size += len(words)


def encoded(docs: DataFrame, longest: int, text: str, lang: str) -> DataFrame:
    """(shard, lang, lead, ids, words, counts): a row for each shard, written to the shared folder. ids are numbers of the
    shard's words (words, with how often each stands there, are numbered from 1), of 2 or 4 bytes. The first lead of them
    stand in the shard before, too, and are there for phrases across the cut of a long text."""

    def row(place: int, language: str, s: Shard):
        ids = np.concatenate(s.parts)
        counts = np.bincount(ids[s.lead :], minlength=len(s.numbers))[1:]
        words = list(s.numbers)[1:]
        data = ids.astype(np.uint16 if len(words) < 1 << 16 else np.uint32).tobytes()
        columns = [pa.array([place]), pa.array([language]), pa.array([s.lead], pa.int32()), pa.array([data], pa.binary()), pa.array([words], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["shard", "lang", "lead", "ids", "words", "counts"])

    def run(batches):
        place = TaskContext.get().partitionId() << 32
        shards: dict[str, Shard] = {}
        for b in batches:
            languages = b.column("lang").to_pylist()
            for g, data in text_groups(b, "text"):
                for language, d in zip(languages[g], data, strict=True):
                    s = shards.setdefault(language, Shard([]))
                    for words in _words(d):
                        s.add(words)
                        if s.size >= SHARD_WORDS:
                            yield row(place, language, s)
                            place += 1
                            s = shards[language] = Shard(words[-(longest - 1) :] if longest > 1 else [])
                    s.add([b"\xff"])
        for language, s in shards.items():
            yield row(place, language, s)
            place += 1
        release()

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return cut(rows.mapInArrow(run, "shard long, lang string, lead int, ids binary, words array<binary>, counts array<long>"))


def dictionary(shards: DataFrame, least: int) -> tuple[DataFrame, int, DataFrame]:
    """(lang, word, id, f) of the words that stand least times or more in their language, ids from 1; the bits of an id; and
    (lang, n), all words of each language. Ids are given within groups of hashes, so no task numbers all words."""
    pairs = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("f"))
    every = pairs.groupBy("lang", "word").agg(F.sum("f").alias("f"))
    kept = every.where(F.col("f") >= least).withColumn("g", F.pmod(F.xxhash64("lang", "word"), F.lit(GROUPS)))
    place = F.row_number().over(Window.partitionBy("g").orderBy("lang", "word")) - 1
    kept = cut(kept.select("lang", "word", (place.cast("long") * GROUPS + F.col("g") + 1).alias("id"), "f"))
    most = kept.agg(F.max("id")).first()[0] or 1
    sizes = shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    return kept, int(most).bit_length(), sizes


# ---- counting quotient filters ----
# A key of 2 * half bits is two halves in two words. It is permuted by an invertible network of rounds; the first bits of the
# result are its quotient, all others its remainder, so a key is told from all others. Filters are kept in the order of keys.

_ROUNDS = tuple(U(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF) for i in range(4))


def permuted(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    mask = U((1 << half) - 1)
    for key in _ROUNDS:
        left, right = right, left ^ (mix64(right ^ key) & mask)
    return left, right


def restored(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    mask = U((1 << half) - 1)
    for key in reversed(_ROUNDS):
        left, right = right ^ (mix64(left ^ key) & mask), left
    return left, right


def summed(left: np.ndarray, right: np.ndarray, counts: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, with their counts added up. Sorted runs are merged as runs."""
    if 2 * half <= 64:
        order = np.argsort(left << U(half) | right, kind="stable")
    else:
        order = np.lexsort((right, left))
    left, right, counts = left[order], right[order], counts[order]
    first = np.ones(len(left), bool)
    first[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    at = np.flatnonzero(first)
    return left[at], right[at], np.add.reduceat(counts, at) if len(at) else counts


def filters(left: np.ndarray, right: np.ndarray, counts: np.ndarray, half: int, ranges: int) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    """(range, bits, runs, remainders, counts) of sorted keys, for each range of their first bits (2**ranges of them).

    bits: of the quotient; about as many quotients as keys. runs: for each quotient of the range as many ones as it has keys,
    then a zero. remainders: whole bytes, the left half's rest, then the right half. counts: a byte each; 255 says that the
    count follows at the end, in 8 bytes.
    """
    bounds = np.searchsorted(left, np.arange((1 << ranges) + 1, dtype=U) << U(half - ranges))
    for r in range(1 << ranges):
        a, z = int(bounds[r]), int(bounds[r + 1])
        if a == z:
            continue
        bits = min(half, ranges + max(0, (z - a).bit_length() - 1))
        quotient = (left[a:z] >> U(half - bits)).astype(np.int64) - (r << (bits - ranges))
        ones = np.zeros((z - a) + (1 << (bits - ranges)), np.uint8)
        ones[np.arange(z - a) + quotient] = 1
        rest = left[a:z] & U((1 << (half - bits)) - 1)
        columns = [x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-width // 8)] for x, width in ((rest, half - bits), (right[a:z], half))]
        few = np.minimum(counts[a:z], 255).astype(np.uint8)
        yield r, bits, np.packbits(ones).tobytes(), np.concatenate(columns, 1).tobytes(), few.tobytes() + counts[a:z][few == 255].astype("<i8").tobytes()


def opened(r: int, bits: int, n: int, runs: bytes, remainders: bytes, counts: bytes, half: int, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys and counts that filters() has put into one row."""
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(runs, np.uint8), count=n + (1 << (bits - ranges))))
    quotient = (ones - np.arange(n) + (r << (bits - ranges))).astype(U)
    widths = [-(-(half - bits) // 8), -(-half // 8)]
    data = np.frombuffer(remainders, np.uint8).reshape(n, sum(widths))
    halves = []
    for w, at in zip(widths, (0, widths[0]), strict=True):
        full = np.zeros((n, 8), np.uint8)
        full[:, :w] = data[:, at : at + w]
        halves.append(full.view("<u8")[:, 0])
    out = np.frombuffer(counts, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(counts, "<i8", offset=n)
    return quotient << U(half - bits) | halves[0], halves[1], out


# ---- n-grams ----


def packed(ids: np.ndarray, lead: int, longest: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (two halves) of the phrases of 2 to longest words among ids (0: no word of a phrase) that end beyond lead. A word
    takes so many bits, the last one the lowest; shorter phrases have zeros before them."""
    half = half_of(longest, bits)
    mask = U((1 << half) - 1)
    left, right = [], []
    ids = ids.astype(U)
    for n in range(2, longest + 1):
        if len(ids) < n:
            break
        ends = np.arange(max(n - 1, lead), len(ids))
        whole = np.ones(len(ends), bool)
        for j in range(n):
            whole &= ids[ends - j] > 0
        ends = ends[whole]
        a, b = np.zeros(len(ends), U), np.zeros(len(ends), U)
        for j in range(n):  # the j-th word from the end, from bit j * bits on
            w, at = ids[ends - j], j * bits
            if at < half:
                b |= (w << U(at)) & mask
                if at + bits > half:
                    a |= w >> U(half - at)
            else:
                a |= w << U(at - half)
        left.append(a)
        right.append(b)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, U), np.zeros(0, U))


def unpacked(left: np.ndarray, right: np.ndarray, longest: int, bits: int) -> np.ndarray:
    """A row for each key: the ids of its words, zeros before those of a shorter phrase."""
    half = half_of(longest, bits)
    out = np.zeros((len(left), longest), np.int64)
    for j in range(longest):
        at = j * bits
        if at < half:
            w = right >> U(at)
            if at + bits > half:
                w |= left << U(half - at)
        else:
            w = left >> U(at - half)
        out[:, longest - 1 - j] = (w & U((1 << bits) - 1)).astype(np.int64)
    return out


def half_of(longest: int, bits: int) -> int:
    return -(-longest * bits // 2)


def counted(shards: DataFrame, kept: DataFrame, bits: int, least: int, longest: int) -> DataFrame:
    """(w, a): phrases of 2 to longest words (ids) that stand a = least times or more.

    Each task makes filters of its shards' phrases, merged while they are small; ranges of quotients then meet in one task
    each, where sorted filters are merged. Keys are permuted, so ranges are alike in size, whatever phrases are frequent.
    """
    half = half_of(longest, bits)
    if half > 62:
        raise ValueError(f"phrases of {longest} of so many different words don't fit in 124 bits")
    ids = shards.select("shard", "lang", F.posexplode("words").alias("pos", "word")).join(kept.select("lang", "word", "id"), ["lang", "word"])
    known = ids.groupBy("shard").agg(F.collect_list(F.struct("pos", "id")).alias("known"))  # at most the words of a shard
    both = shards.select("shard", "lead", F.size("words").alias("size"), "ids").join(known, "shard", "left")
    total = shards.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    ranges = min(max(4, (total * (longest - 1) // RANGE).bit_length()), half, 20)

    def rows(held: list):
        left, right, counts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)), half)
        for r, b, runs, rest, c in filters(left, right, counts, half, ranges):
            n = len(rest) // (-(-(half - b) // 8) + -(-half // 8))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (r, b, n)] + [pa.array([x], pa.binary()) for x in (runs, rest, c)], ["range", "bits", "n", "runs", "remainders", "counts"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column("size")[i].as_py()
                data = batch.column("ids")[i].as_buffer()
                of = np.zeros(words + 1, np.uint64)
                if (found := batch.column("known")[i]).is_valid:
                    pos, gid = (found.values.field(x).to_numpy() for x in (0, 1))
                    of[pos + 1] = gid
                numbers = np.frombuffer(data, np.uint16 if words < 1 << 16 else np.uint32)
                left, right = permuted(*packed(of[numbers], batch.column("lead")[i].as_py(), longest, bits), half)
                held.append(summed(left, right, np.ones(len(left), np.int64), half))
                size += len(held[-1][0])
                if size >= MERGE:
                    yield from rows(held)
                    held, size = [], 0
        if size:
            yield from rows(held)
        release()

    def merge(batches):
        now, held, size = None, [], 0

        def close(r):
            left, right, counts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)), half)
            at = np.flatnonzero(counts >= least)
            words = unpacked(*restored(left[at], right[at], half), longest, bits)
            n = (words > 0).sum(1)
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(words[words > 0]))
            return pa.RecordBatch.from_arrays([flat, pa.array(counts[at])], ["w", "a"])

        for batch in batches:
            for x in batch.to_pylist():
                if held and x["range"] != now:
                    yield close(now)
                    held, size = [], 0
                now = x["range"]
                held.append(opened(x["range"], x["bits"], x["n"], x["runs"], x["remainders"], x["counts"], half, ranges))
                size += x["n"]
                if size >= 2 * MERGE and len(held) > 1:
                    held = [summed(*(np.concatenate(y) for y in zip(*held, strict=True)), half)]
                    size = len(held[0][0])
        if held:
            yield close(now)
        release()

    made = both.mapInArrow(run, "range long, bits long, n long, runs binary, remainders binary, counts binary")
    return cut(made.repartition("range").sortWithinPartitions("range").mapInArrow(merge, "w array<long>, a long"))


def _exact(x):
    return x.cast("decimal(15,0)")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50, first: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's first phrases by score, then a, then phrase (bytes).

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends, and those into words at blanks and tabs. A
    phrase is 2 to longest words side by side in a piece; it counts (a) each time that it stands there, and is a candidate
    from least times on. Cut after its first words, l and r are the counts of both parts; score is the least floor(10**6 * a *
    a / (l * r)) over all cuts, at ties that after the fewest words. Candidates go that stand inside a longer one with at
    least cover per cent of their count. n: all words of the language.

    Null and empty texts have no words; a null lang is "und". Rows that repeat count each time. Without candidates there are no
    rows. Other columns are ignored. Counts end at 15 digits.

    Words below least can't stand in a candidate: they have no id, and end phrases. What travels is a shard's numbers, its
    words, and filters; no table of words is sent to all tasks.
    """
    if longest < 2 or least < 1 or first < 1:
        raise ValueError("a phrase has two words at least, and stands somewhere")
    shards = encoded(docs, longest, text, lang)
    kept, bits, sizes = dictionary(shards, least)
    grams = counted(shards, kept, bits, least, longest)
    words = kept.select(F.array("id").alias("w"), F.col("f").alias("a"), "lang", F.col("word").cast("string").alias("phrase"), F.array("f").alias("heads"), F.array("f").alias("tails"))
    shorter, every = words, []
    for n in range(2, longest + 1):
        head = shorter.select(F.col("w").alias("_h"), "lang", F.col("phrase").alias("_p"), "heads")
        tail = shorter.select(F.col("w").alias("_t"), F.col("phrase").alias("_q"), "tails")
        here = grams.where(F.size("w") == n).withColumns({"_h": F.slice("w", 1, n - 1), "_t": F.slice("w", 2, n - 1)})
        here = here.join(head, "_h").join(tail, "_t")
        phrase = F.concat_ws(" ", "_p", F.element_at(F.split("_q", " "), -1))
        shorter = here.select("w", "a", "lang", phrase.alias("phrase"), F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails"))
        shorter = cut(shorter)
        every.append(shorter)
    found = every[0]
    for x in every[1:]:
        found = found.unionByName(x)
    square = _exact(F.col("a")) * _exact(F.col("a")) * F.lit(1_000_000).cast("decimal(7,0)")

    def cut_after(k):
        l, r = F.get("heads", k - 1), F.get("tails", F.size("w") - k - 1)
        return F.struct(F.call_function("div", square, _exact(l) * _exact(r)).alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    cuts = F.transform(F.sequence(F.lit(1), F.size("w") - 1), cut_after)
    found = found.withColumn("_c", F.array_min(cuts)).select("lang", "phrase", "w", "a", "_c.score", "_c.l", "_c.r")
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda s: F.slice("w", s, n))))
    longer = found.where(F.size("w") > 2).select(F.explode(inside).alias("w"), F.col("a").alias("_most")).groupBy("w").agg(F.max("_most").alias("_most"))
    found = found.join(longer, "w", "left").where(F.col("_most").isNull() | (F.col("_most") * 100 < F.col("a") * cover))
    by = (F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    found = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    found = found.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*by))).where(F.col("_r") <= first)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= first)
    return found.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of two or three words of each language."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]', chr(10), 'g'), chr(10))) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))),
f AS MATERIALIZED (SELECT lang, k, phrase, lang || '|' || phrase AS key, count(*) AS a FROM g GROUP BY ALL),
c AS MATERIALIZED (SELECT *, array_to_string(w[1:1], ' ') AS h1, array_to_string(w[2:], ' ') AS t1, array_to_string(w[1:2], ' ') AS h2, array_to_string(w[3:], ' ') AS t2 FROM (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10)),
o AS (SELECT lang, k, phrase, a, 1 AS cut, h1 AS h, t1 AS t FROM c UNION ALL SELECT lang, k, phrase, a, 2, h2, t2 FROM c WHERE k = 3),
s AS (SELECT o.*, l.a AS l, r.a AS r, ((1000000::HUGEINT * o.a * o.a) // (l.a::HUGEINT * r.a))::BIGINT AS score
FROM o JOIN f l ON l.key = o.lang || '|' || o.h JOIN f r ON r.key = o.lang || '|' || o.t),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM s),
i AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, h2 AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, t1, a FROM c WHERE k = 3) GROUP BY 1, 2),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN i USING (lang, phrase) WHERE place = 1 AND (most IS NULL OR 100 * most < 50 * a))
SELECT t.lang, rank, t.phrase, t.a, l, r, n, score FROM t JOIN (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1) USING (lang) WHERE rank <= 2000"""
