"""Document fingerprints by locally consistent parsing: hierarchical phrases named by deterministic coin tossing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import place_of
from .common import STEP_BYTES, U, from_texts, groups, mix64, prefix_hashes, slice_hashes, table, utf8

#: Levels of phrases; one of a level has some three of the level below.
LEVELS = 5
#: Phrase names of these levels make up a fingerprint, of texts that have any.
SKETCHED = (2, 3, 4)
#: Names that a fingerprint keeps: the least of a text's different ones.
KEEP = 64
#: Ranges of doc_id that neighbours are looked for in: at least and at most, and bytes of text in one between these.
RANGES, RANGE_BYTES = (16, 1 << 16), 1 << 23


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One toss: twice the place of the lowest bit in which a symbol differs from the one before, plus that bit (64 as the
    place where none differs). Symbols are unsigned numbers of any width; labels have 8 bits."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = ~x[first]
    before ^= x
    low = np.negative(before)
    low &= before
    bit = (x & low) != 0
    same = low == 0
    low -= x.dtype.type(1)
    label = np.bitwise_count(low)
    label[same] = 64
    label <<= np.uint8(1)
    label |= bit
    return label


def _level(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of sequences laid one after another (starts: their first places; none is empty)."""
    # runs of one symbol become one symbol with its number, so that neighbours differ
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[starts] = True
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(x)))
    x = x[at]
    starts = np.searchsorted(at, starts)
    named = x.astype(U)
    runs = np.flatnonzero(run > 1)
    named[runs] = mix64(named[runs] * U(0x9E3779B97F4A7C15) + run[runs].astype(U))
    first = np.zeros(len(x), bool)
    first[starts] = True
    label = x
    for _ in range(4):  # 64 bits, 7, 4, 3 bits: labels up to 5
        label = _labels(label, first)
    # a phrase begins at a label above both neighbours (a tie can only be with a sequence's first)
    peak = np.zeros(len(x), bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    last = np.zeros(len(x), bool)
    last[np.append(starts[1:], len(x)) - 1] = True
    peak &= ~last
    peak[1:] &= ~first[:-1]
    peak |= first
    begin = np.flatnonzero(peak)
    end = np.append(begin[1:], len(x))
    return slice_hashes(prefix_hashes(mix64(named + U(1))), begin, end), np.searchsorted(begin, starts)


def _names(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's phrase names of SKETCHED levels, repeats among them; of a text too short for one, the text's name."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    full = [i for i, t in enumerate(texts) if t]
    if full:
        x = np.frombuffer(b"".join(texts[i] for i in full), np.uint8).astype(np.uint16) + np.uint16(1)
        sizes = np.array([len(texts[i]) for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        for level in range(1, LEVELS):
            x, starts = _level(x, starts)
            ends = np.append(starts[1:], len(x))
            if level in SKETCHED:
                tagged = mix64(x + U(level))
                for i, s, e in zip(full, starts.tolist(), ends.tolist(), strict=True):
                    if e - s > 2:
                        out[i].append(tagged[s + 1 : e - 1])  # inner ones: those at the edges depend on where the text ends
    whole = [mix64(np.frombuffer(t.ljust(8, b"\1")[:8], "<u8") + U(len(t))) for t in texts]
    for i, t in enumerate(texts):
        if not out[i] and len(t) > 8:
            whole[i] = slice_hashes(prefix_hashes(np.frombuffer(t, np.uint8).astype(U) + U(1)), np.array([0]), np.array([len(t)]))
    return [np.concatenate(o) if o else w.astype(U) for o, w in zip(out, whole, strict=True)]


def phrases(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's different phrase names of SKETCHED levels in ascending order; of a text too short for one, the text's name."""
    return [np.unique(x) for x in _names(texts)]


def _least(names: np.ndarray) -> np.ndarray:
    x = np.sort((names >> U(32)).astype(np.uint32))
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new][:KEEP]


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """The least KEEP different 32-bit hashes of each text's phrase names, ascending. Long texts are parsed one by one."""
    out: list[np.ndarray] = []
    for g in groups([len(t) for t in texts], STEP_BYTES // 2):
        out += map(_least, _names(texts[g]))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two texts' phrases: among the KEEP least of both, the share that both have."""
    both = np.unique(np.concatenate([a, b]))[:KEEP]
    return float(np.isin(both, a, assume_unique=True)[np.isin(both, b, assume_unique=True)].sum() / len(both)) if len(both) else 1.0


def encode(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds out: a text's fingerprint in hex digits, 8 for each kept name. Equal texts have equal ones; null is as empty."""
    return from_texts(docs, text, out, "string", lambda: lambda data: list(map(encode, fingerprints(data))))


def with_next(docs: DataFrame, text: str = "text") -> DataFrame:
    """Partitions in which each row of (g, halo, doc_id, t) with halo = 0 stands just before its next document.

    Order: doc_id ascending, nulls last, then text. The ids' range is cut at quantiles, into more ranges the more text there
    is; each range's first rows also go, as halo rows, to the range before, and those of the first range to the last. Only
    texts are shuffled, once. The driver gets two numbers a range.
    """
    ids = docs.select("doc_id")
    n = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = min(max(RANGES[0], n // RANGE_BYTES), RANGES[1])
    # a doc_id above 2**53 is rounded in the cuts, which only moves a cut
    cuts = sorted({int(c) for c in ids.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (8 * n))})
    last = len(cuts) + 1

    bucket = F.when(F.col("doc_id").isNull(), last).otherwise(place_of(cuts, F.col("doc_id").cast("long"))).cast("int")
    heads = sorted((r["g"], r["m"]) for r in ids.groupBy(bucket.alias("g")).agg(F.min("doc_id").alias("m")).collect())  # a row a range
    order = [g for g, _ in heads]
    firsts = [m for _, m in heads if m is not None]
    # the range before the one that a first id begins; before the first it is the last
    place = place_of(firsts, F.col("doc_id").cast("long"))
    before = F.get(F.lit([order[i - 1] for i in range(len(order))] or [0]).cast("array<int>"), F.when(F.col("doc_id").isNull(), len(firsts)).otherwise(place))
    is_first = F.coalesce(F.get(F.lit(firsts or [0]).cast("array<bigint>"), place) == F.col("doc_id"), F.col("doc_id").isNull())
    rows = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("t"), bucket.alias("g"))
    to = F.when(is_first, before)
    copies = rows.withColumn("to", to).select("doc_id", "t", F.explode(F.filter(F.array(F.struct("g", F.lit(0).alias("halo")), F.struct(F.col("to").alias("g"), F.lit(1).alias("halo"))), lambda x: x["g"].isNotNull())).alias("x"))
    flat = copies.select("x.g", "x.halo", "doc_id", "t")
    return flat.repartition("g").sortWithinPartitions("g", "halo", F.col("doc_id").asc_nulls_last(), "t")


def compare_edited(docs: DataFrame, text: str = "text") -> DataFrame:
    """For each document: n_chars, edited (its text with the last quarter replaced by the next document's first characters),
    fingerprint, edited_fingerprint, near_edited and near_next. A single row is its own next document."""
    ordered = with_next(docs, text)

    def rows(batches):
        """(doc_id, text, next text) of rows that aren't halo rows."""
        held, group, need = None, None, False
        for b in batches:
            for g, halo, doc, t in zip(b.g, b.halo, b.doc_id, b.t, strict=True):
                doc = None if pd.isna(doc) else int(doc)
                if need and held is not None and g == group:
                    yield (*held, t)
                if halo:
                    need = False
                else:
                    held, group, need = (doc, t), g, True

    def run(batches):
        pending: list[tuple] = []
        size = 0

        def emit():
            edited = []
            for _, t, n in pending:
                k = len(t) // 4
                edited.append(t[: len(t) - k] + n[:k])
            own, changed = fingerprints([utf8(t) for _, t, _ in pending]), fingerprints([utf8(t) for t in edited])
            # the next text is nearly always the next row here
            follow = [own[i + 1] if i + 1 < len(pending) and pending[i + 1][1] == n else fingerprints([utf8(n)])[0] for i, (_, _, n) in enumerate(pending)]
            return pd.DataFrame(
                {
                    "doc_id": pd.array([p[0] for p in pending], dtype="Int64"), "n_chars": [len(p[1]) for p in pending], "edited": edited,
                    "fingerprint": [encode(f) for f in own], "edited_fingerprint": [encode(f) for f in changed],
                    "near_edited": [likeness(a, b) for a, b in zip(own, changed, strict=True)], "near_next": [likeness(a, b) for a, b in zip(own, follow, strict=True)],
                }
            )

        for r in rows(batches):
            pending.append(r)
            size += len(r[1])
            if size > 4 * STEP_BYTES:
                yield emit()
                pending, size = [], 0
        if pending:
            yield emit()

    return ordered.mapInPandas(run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    out = compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
