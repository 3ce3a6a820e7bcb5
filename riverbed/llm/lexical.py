"""Ranked lexical search of many items at once: sets of terms that items share are summed up once for each document."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES, cut, release, table, text_groups
from .selection import NO_ID, Best, ranked

#: Bytes of the items that one pass over the documents answers; what it broadcasts is in proportion.
ITEM_BYTES = 4 << 20
#: Numbers that one step's table of accumulators holds (8 bytes each).
CELLS = 4 << 20
#: Digits, letters and all that isn't ASCII stand in terms; only A-Z are lower-cased.
TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, of about STEP_BYTES at a time."""
    clean = text.translate(TERM)
    at = 0
    while at < len(clean):
        end = at + STEP_BYTES
        if end < len(clean) and (end := clean.find(b" ", end)) < 0:
            end = len(clean)
        yield clean[at:end].split()
        at = end


def counted(text: bytes) -> Counter:
    out: Counter = Counter()
    for part in terms_of(text):
        out.update(part)
    return out


class Shared:
    """Sums of terms' partial scores that several items need, each made once: a graph whose leaves are terms.

    An item is one set of terms for each number of times that its terms repeat. Sets are put in the order of how many of them
    hold a term, terms of exactly the same sets side by side; then neighbours that two sets or more have are joined to a
    node, the most frequent first, until no two are left. levels: arrays (node, left, right) in the order of their making;
    the i-th item of items (those with terms) is the sum of the nodes from operands[offsets[i]] on.
    """

    def __init__(self, items: list[Counter]):
        self.terms = sorted({t for c in items for t in c})
        number = {t: i for i, t in enumerate(self.terms)}
        sets, owner = [], []
        for i, c in enumerate(items):
            for depth in range(1, max(c.values(), default=0) + 1):
                sets.append([number[t] for t, n in c.items() if n >= depth])
                owner.append(i)
        held: dict[int, list[int]] = {}
        for k, s in enumerate(sets):
            for t in s:
                held.setdefault(t, []).append(k)
        place = {t: (-len(k), k, t) for t, k in held.items()}
        sets = [sorted(s, key=place.__getitem__) for s in sets]
        self.size, depth_of, levels = len(self.terms), {}, {}
        made: dict[tuple[int, int], int] = {}
        while True:
            pairs = Counter(p for s in sets for p in zip(s, s[1:], strict=False))
            if not pairs or max(pairs.values()) < 2:
                break
            for k, s in enumerate(sets):
                out, j = [], 0
                while j < len(s):
                    pair = tuple(s[j : j + 2])
                    n = pairs.get(pair, 0)
                    if n >= 2 and n >= pairs.get(tuple(s[j + 1 : j + 3]), 0):  # else the next pair goes first
                        if pair not in made:
                            made[pair] = self.size
                            depth_of[self.size] = 1 + max(depth_of.get(x, 0) for x in pair)
                            levels.setdefault(depth_of[self.size], []).append((self.size, *pair))
                            self.size += 1
                        out.append(made[pair])
                        j += 2
                    else:
                        out.append(s[j])
                        j += 1
                sets[k] = out
        self.levels = [np.array(levels[d]).T for d in sorted(levels)]
        every: list[list[int]] = [[] for _ in items]
        for i, s in zip(owner, sets, strict=True):
            every[i].extend(s)
        self.items = [i for i, s in enumerate(every) if s]
        self.operands = np.array([x for s in every for x in s], np.int64)
        self.offsets = np.cumsum([0] + [len(every[i]) for i in self.items])[:-1]

    def scores(self, partial: np.ndarray) -> np.ndarray:
        """Items (those with terms) x documents, from terms x documents."""
        values = np.zeros((self.size, partial.shape[1]), np.int64)
        values[: len(partial)] = partial
        for node, left, right in self.levels:
            values[node] = values[left] + values[right]
        return np.add.reduceat(values[self.operands], self.offsets)


def statistics(docs: DataFrame, terms: list[bytes], ident: str, text: str) -> tuple[DataFrame, int, int, np.ndarray]:
    """(id, n, terms, counts) of every document with one of the terms; N, L and the df of each term. Texts are read once:
    what the ranking needs of them is written to the shared folder."""

    def run(batches):
        number = {t: i for i, t in enumerate(terms)}
        for b in batches:
            idents = b.column("id")
            for g, data in text_groups(b, "text"):
                n, of, times, at = [], [], [], [0]
                for d in data:
                    c = counted(d)
                    found = sorted((number[t], c[t]) for t in c.keys() & number.keys())
                    n.append(c.total())
                    of.extend(x[0] for x in found)
                    times.extend(x[1] for x in found)
                    at.append(len(of))
                offsets = pa.array(at, pa.int32())
                columns = [idents[g], pa.array(n, pa.int64()), *(pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (of, times))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "terms", "counts"])
        release()

    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))
    rows = cut(rows.mapInArrow(run, "id long, n long, terms array<int>, counts array<int>").where("n > 0"))
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)

    def count(batches):
        seen = np.zeros(len(terms), np.int64)
        for b in batches:
            seen += np.bincount(b.column("terms").flatten().to_numpy(), minlength=len(terms))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["term", "df"])

    for r in rows.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # terms of a bounded part of the items
        df[r["term"]] = r["df"]
    return rows, n, total, df


def rank(docs: DataFrame, items: DataFrame, k: int = 10, ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k documents of the highest scores above 0, ties to smaller doc_ids.

    A term's weight is floor(1000 ln((2N + 2) / (2df + 1))), a document's m is 25 + (75nN) div L, and a term adds weight *
    ((10**9 tf) div (1000 tf + 8m)) for each time that it stands in the item; N, L and df count all documents with a term.

    Null and empty texts hold no terms: such documents aren't counted, such items give no rows. Rows of documents that repeat
    an id are ranked one by one; one without an id is ranked too, last among equal scores. An item_id that repeats counts
    once, with its least text; a null item_id is an id like others. Empty tables give no rows. Other columns are ignored.

    Items go in parts of a bounded size. For each part the documents are read once; what they hold of the items' terms is
    written, summed up along the graph of shared sets of terms, and a task keeps k rows an item at most.
    """
    if k <= 0:
        raise ValueError("k is one at least")
    asked = cut(items.where(F.col(item_text).isNotNull()).groupBy(F.col(item).cast("long").alias("item")).agg(F.min(item_text).alias("text")))
    parts = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES))
    out = docs.sparkSession.createDataFrame([], "query long, id long, score long")
    for p in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == p).collect()  # a bounded part of the items
        graph = Shared([counted(r["text"].encode("utf-8", "surrogatepass")) for r in rows])
        if graph.terms:
            found = _scored(docs, graph, [rows[i]["item"] for i in graph.items], k, ident, text)
            out = out.unionByName(cut(found)) if parts > 1 else found
    return ranked(out, k).select(F.col("query").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def _scored(docs: DataFrame, graph: Shared, names: list, k: int, ident: str, text: str) -> DataFrame:
    """(query, id, score): what of each task's documents may be among the k best."""
    rows, n_docs, total, df = statistics(docs, graph.terms, ident, text)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    step = max(16, CELLS // (graph.size + len(graph.operands)))

    def run(batches):
        best = Best(len(names), k)
        for b in batches:
            idents = pc.fill_null(b.column("id"), NO_ID).to_numpy(zero_copy_only=False)
            m = 25 + np.array([75 * n * n_docs // total for n in b.column("n").to_pylist()], np.int64)
            held = np.diff(b.column("terms").offsets.to_numpy())
            doc = np.repeat(np.arange(b.num_rows), held)
            term, tf = (b.column(x).flatten().to_numpy().astype(np.int64) for x in ("terms", "counts"))
            value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
            for s in range(0, b.num_rows, step):
                here = slice(*np.searchsorted(doc, [s, s + step]))
                partial = np.zeros((len(graph.terms), min(step, b.num_rows - s)), np.int64)
                partial[term[here], doc[here] - s] = value[here]
                scores = graph.scores(partial)
                q, d = np.nonzero((scores > 0) & (scores >= best.score[:, None]))
                best.add(q, scores[q, d], idents[s + d])
        yield best.rows(pa.array(names, pa.int64()))
        release()

    return rows.mapInArrow(run, "query long, id long, score long")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that each benchmark item is found in best."""
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, unnest(t) AS term, len(t) AS n FROM d) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, sum(times * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // l))))::BIGINT AS score
FROM q JOIN f USING (term) JOIN p USING (term), c GROUP BY 1, 2)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0) WHERE r <= 10"""
