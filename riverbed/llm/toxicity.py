"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding, normalised by length, with exception phrases."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, from_texts, table

#: Labelled rows to learn from at most: those of the smallest hash of doc_id.
TRAIN_ROWS = 20_000
#: Entries of a lexicon and exception phrases at most, those of the greatest evidence; they bound what is broadcast.
ENTRIES, PHRASES = 2000, 2000
#: Lengths of the stems that are learned beside whole words.
STEMS = (4, 5, 6)
#: A text's entries count for their share of its words, with at least so many words.
SHORT = 50

# Letters that look like Latin ones, and digits and signs used for letters.
HOMOGLYPHS = dict(zip("аеорсухівкмнтѕјԁһցᴀβαοερντικυχ", "aeopcyxibkmhtsjdhgabaoepvtikux", strict=True))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}


class Folding(dict):
    """For str.translate: lower case, no accents, homoglyphs and substitutes as Latin letters, what isn't a letter as a space."""

    def __missing__(self, code: int) -> str:
        import unicodedata

        c = chr(code)
        c = SUBSTITUTES.get(c) or HOMOGLYPHS.get(c) or HOMOGLYPHS.get(c.lower()) or c
        c = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        c = "".join(HOMOGLYPHS.get(x, x) for x in c)
        if code == 0x200B or code == 0xAD:  # invisible
            c = ""
        elif not c or not c.isalpha():
            c = " " if not (unicodedata.category(chr(code)) == "Mn") else ""
        self[code] = c
        return c


FOLD = Folding()
#: A sign that stands for a letter does so only before a letter ("!" ends sentences).
SIGNS = re.compile(r"[!|$@]+(?![^\W\d_])")


def fold(text: str | None) -> str:
    return SIGNS.sub(" ", text).translate(FOLD) if isinstance(text, str) else ""


def evidence(docs: DataFrame, label: str) -> DataFrame:
    """Numbers of toxic and other documents that hold each word, "stem*" and pair of words: (entry, bad, good).
    What stands in two documents at most is left out: neither a lexicon nor exceptions take it up."""

    def run(batches):
        good, bad = Counter(), Counter()
        for b in batches:
            for t, y in zip(b.text, b[label], strict=True):
                w = fold(t).split()
                have = set(w)
                have |= {f"{x[:k]}*" for x in have for k in STEMS if len(x) >= k}
                have |= {f"{x} {y_}" for x, y_ in zip(w, w[1:], strict=False)}
                (bad if y else good).update(have)
        entries = list(good.keys() | bad.keys())
        for i in range(0, len(entries), 50_000):
            part = entries[i : i + 50_000]
            yield pd.DataFrame({"entry": part, "bad": [bad[e] for e in part], "good": [good[e] for e in part]})

    counts = docs.mapInPandas(run, "entry string, bad long, good long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    return counts.where("bad + good > 2")


def learn_lexicon(docs: DataFrame, label: str, entries: int = ENTRIES, most_phrases: int = PHRASES) -> tuple[dict[str, float], list[str]]:
    """Entries with weights (log odds of the share of toxic and of other documents that hold them), and exception phrases:
    pairs of words that hold a word of the lexicon but stand in other documents as often as in toxic ones, or more."""

    counts = cut(evidence(docs, label))
    t = docs.agg(F.sum(F.col(label).cast("long")).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    bad, good = t["bad"] or 0, t["n"] - (t["bad"] or 0)
    if not bad:
        return {}, []
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    least = max(4, math.ceil(bad * 0.002))
    chosen = counts.where(~F.col("entry").contains(" ") & (F.col("bad") >= least)).withColumn("w", odds).where("w > 2.0")
    rows = chosen.orderBy((F.col("w") * F.sqrt("bad")).desc(), "entry").limit(entries).collect()
    lexicon = {r["entry"]: float(r["w"]) for r in rows}
    words = [e for e in lexicon if not e.endswith("*")]
    phrases = []
    if words:
        part = F.split("entry", " ")
        mixed = counts.where(F.col("entry").contains(" ") & (part[0].isin(words) | part[1].isin(words)) & (F.col("good") >= 3)).withColumn("w", odds).where("w <= 0")
        phrases = [r["entry"] for r in mixed.orderBy(F.col("good").desc(), "entry").limit(most_phrases).collect()]
    return lexicon, phrases


def automaton(lexicon: dict[str, float], phrases: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for e, w in lexicon.items():
        key = " " + e[:-1] if e.endswith("*") else f" {e} "
        a.add_word(key, (len(key), w))
    for p in phrases:
        a.add_word(f" {p} ", (len(p) + 2, 0.0))
    if len(a):
        a.make_automaton()
    return a


def measures(texts: list[str | None], a) -> np.ndarray:
    """For each text: the greatest weight that it holds, its sum, and the sum's share of the words, all damped; whether it is empty.

    Where entries begin at one word, the greatest weight counts; those inside an exception phrase don't count.
    """
    out = np.zeros((len(texts), 4))
    for i, t in enumerate(texts):
        w = fold(t).split()
        text = " " + " ".join(w) + " "
        at: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (n, weight) in a.iter(text) if len(a) else ():
            start = end - n + 1
            if weight:
                at[start] = max(weight, at.get(start, 0.0))
            else:
                free.append((start, end))
        for s, e in free:
            for start in [x for x in at if s <= x < e]:
                del at[start]
        total = sum(at.values())
        out[i] = max(at.values(), default=0.0), math.log1p(total), math.log1p(100 * total / max(SHORT, len(w))), not w
    return out


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on a few measures by Newton's method; the last value is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if len(y) and 0 < y.sum() < len(y):
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    elif len(y):
        w[-1] = 4.0 if y.sum() else -4.0
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = TRAIN_ROWS, entries: int = ENTRIES, phrases: int = PHRASES) -> dict:
    """A model: lexicon (of at most so many entries), exception phrases (likewise) and the calibration's weights, from at most
    max_rows labelled documents.

    Labels that are null are left out; labels of one document that differ count as their mean, rounded, and of texts that
    share a doc_id the least counts, so that reruns agree. With no labels at all every score is 0.5. The driver gets the
    lexicon and four numbers for each training row.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias(label))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    data = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # at most max_rows pairs of numbers
    data = cut(data.groupBy("doc_id", label).agg(F.min("text").alias("text")))
    lexicon, exceptions = learn_lexicon(data, label, entries, phrases)

    def run(batches):
        a = automaton(lexicon, exceptions)
        for b in batches:
            m = measures(list(b.text), a)
            yield pd.DataFrame({"doc_id": b.doc_id, "y": b[label].astype("float64")} | {f"m{i}": m[:, i] for i in range(m.shape[1])})

    got = data.mapInPandas(run, "doc_id long, y double, m0 double, m1 double, m2 double, m3 double").toPandas().sort_values("doc_id")
    return {"lexicon": lexicon, "phrases": exceptions, "weights": calibrate(got[["m0", "m1", "m2", "m3"]].to_numpy(float), got.y.to_numpy(float))}


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """Adds out, 0 to 1: how likely each whole text is toxic. Null texts are empty; an empty text gets what its measures give.
    A column of that name is replaced, all others stay; rows that repeat are scored each; an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value
        a = automaton(m["lexicon"], m["phrases"])

        def run(data: list[bytes]) -> np.ndarray:
            x = measures([t.decode("utf-8", "replace") for t in data], a)
            return 1 / (1 + np.exp(-np.clip(x @ m["weights"][:-1] + m["weights"][-1], -30, 30)))

        return run

    return from_texts(docs, text, out, "double", make)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from the labels of those whose crc32 of doc_id modulo 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(crc_mod("doc_id", 4) != 2)
    scored = score(docs, fit(docs, labels)).drop("text")
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
