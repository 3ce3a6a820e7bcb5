"""Token sequences of fixed length from documents: best-fit decreasing, with overlong documents cut into full windows."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES, U, mix64, release, table, text_groups

WINDOW = 2048
END_ID = 1
#: Pieces shorter than a window that are packed together at most; they and their ids are what a task holds.
GROUP_PIECES = 16_384
GROUP_TOKENS = 1 << 22
#: Pieces that go to the JVM at once, of a window each at most.
SENT_PIECES = 1024
#: Bytes that a task keeps different parts and their ids in, about; beyond that it begins anew.
CACHE_BYTES = 1 << 25
#: Parts of up to so many bytes are told apart in numpy, longer ones one by one.
SHORT_PART = 24
#: Bytes of texts whose parts are looked up together.
LOOKUP_BYTES = STEP_BYTES
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space of more than one byte, as UTF-8, by the bytes that come before the last one.
WIDE_SPACES = {b"\xc2": [0x85, 0xA0], b"\xe1\x9a": [0x80], b"\xe2\x80": [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF], b"\xe2\x81": [0x9F], b"\xe3\x80": [0x80]}

#: Characters whose class every Unicode version agrees on, how a byte-level pre-tokenizer cuts texts of these alone, and the
#: letters that stand for bytes in its vocabulary (printable ones for themselves, then those from 256 on, in the bytes' order).
COMMON = re.compile("[\0-\x7fÀ-ſ]*")
PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+| ?[^\x09-\x0d 0-9A-Za-zÀ-ÖØ-öø-ſ]+|[\x09-\x0d ]+(?![^\x09-\x0d ])|[\x09-\x0d ]+")
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTER = dict(zip([*_PRINTABLE, *(b for b in range(256) if b not in _PRINTABLE)], [*map(chr, _PRINTABLE), *map(chr, range(256, 512))], strict=False))
BYTES = {c: b for b, c in _LETTER.items()}


def part_starts(data: np.ndarray) -> np.ndarray:
    """Where white space (of one byte) begins after something else: a byte-level pre-tokenizer always cuts there."""
    space = SPACE[data]
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    before = data[at - 1]
    high = np.flatnonzero(before >= 0x80)
    for lead, lasts in WIDE_SPACES.items():  # white space before: part of one run with what follows
        k = high[np.isin(before[high], lasts) & (at[high] > len(lead))]
        for j, byte in enumerate(reversed(lead)):
            k = k[data[at[k] - 2 - j] == byte]
        at[k] = 0
    return at[at > 0]


@functools.lru_cache(maxsize=1)
def load(vocabulary: str):
    """The tokenizer; its added tokens, if it is byte-level BPE without normalizer, prefix or added words, so that texts in
    which none of them stands may be cut where white space begins (else None); and, if so, a quicker encoder of the same
    merges with each token's number of bytes.

    The quicker one joins whatever gives a token, the least id first. That is the same as the vocabulary's merges if these
    come in the order of ids and each token's letters give that token alone: all that stands in a span before it becomes a
    token depends on that span only, so the last two parts are always the pair that the merges name. Both are looked up here.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(vocabulary)
    with open(vocabulary, encoding="utf-8") as f:
        said = json.load(f)
    cutter, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
    by_part = (
        said.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space", True)
        and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and not said.get("truncation") and not said.get("padding") and all(t.get("special") for t in said.get("added_tokens") or ())
    )
    if not by_part:
        return tokenizer, None, None, None
    special = {t["content"] for t in said.get("added_tokens") or ()}
    added = [t.encode() for t in sorted(special)]
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    order = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    plain = not model.get("ignore_merges") and all(set(t) <= BYTES.keys() for t in vocab) and all(c in vocab for c in BYTES)
    plain = plain and all(x < y for x, y in zip(order, order[1:], strict=False)) and len(order) + 256 == len(vocab)
    if not plain or not all([x.id for x in tokenizer.model.tokenize(t)] == [i] for t, i in vocab.items()):
        return tokenizer, added, None, None
    import tiktoken

    sizes = np.zeros(max(vocab.values()) + 1, np.int64)
    sizes[list(vocab.values())] = [len(t) for t in vocab]
    ranks = {bytes(BYTES[c] for c in t): i for t, i in vocab.items()}
    return tokenizer, added, tiktoken.Encoding("plain", pat_str=PIECES.pattern, mergeable_ranks=ranks, special_tokens={}), sizes


class PartIds:
    """Token ids, as little-endian 32-bit numbers, of texts; what it learns is kept only as long as the object.

    A byte-level pre-tokenizer cuts wherever white space begins, and BPE doesn't join across its cuts, so the ids of a
    text are those of its parts (white space and what follows, up to the next white space) one after another. Each
    different part of some texts is encoded once. A text in which a special token stands is encoded whole, so that it becomes
    that token's id as in any call of the tokenizer; and so is every text for a vocabulary with another pre-tokenizer, with
    a normalizer, or with added tokens that aren't special.
    """

    def __init__(self, vocabulary: str):
        self.tokenizer, self.added, self.quick, self.sizes = load(vocabulary)
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def encode(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        """Of different parts. New ones of plain characters that begin with white space and don't end with it are encoded as
        one text, in which the tokens' sizes tell where each ends."""
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        known, odd, plain = self.known, [], []
        for p in parts:
            if p not in known:
                joins = self.quick and SPACE[p[0]] and not SPACE[p[-1]] and (p.isascii() or COMMON.fullmatch(p.decode("utf-8", "replace")))
                (plain if joins else odd).append(p)
        for i in range(0, len(plain), 4096):
            some = plain[i : i + 4096]
            ids = np.array(self.quick.encode_ordinary(b"".join(some).decode()), "<u4")
            stops = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(p) for p in some])) + 1
            data, stops = ids.tobytes(), [0, *(4 * stops).tolist()]
            known.update(zip(some, [data[x:y] for x, y in zip(stops, stops[1:], strict=False)], strict=True))
        for i in range(0, len(odd), 4096):
            known.update(zip(odd[i : i + 4096], self.encode(odd[i : i + 4096]), strict=True))
        self.held += 200 * (len(odd) + len(plain))
        return [known[p] for p in parts]

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and each text's number of ids."""
        if self.added is None:
            found = self.encode(texts)
            return np.frombuffer(b"".join(found), "<u4"), np.array([len(f) // 4 for f in found], np.int64)
        named = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if not named:
            return self._by_parts(texts)
        outs, counts, at = [], np.zeros(len(texts), np.int64), 0
        for i in [*named, len(texts)]:
            ids, counts[at:i] = self._by_parts(texts[at:i])
            whole = self.encode(texts[i : i + 1])
            outs += [ids, *(np.frombuffer(w, "<u4") for w in whole)]
            counts[i : i + 1] = [len(w) // 4 for w in whole]
            at = i + 1
        return np.concatenate(outs), counts

    def _by_parts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        outs, counts = [], np.zeros(len(texts), np.int64)
        steps: list[tuple[list[bytes], list[int]]] = [([], [])]
        size = 0
        for i, t in enumerate(texts):
            for piece in [t] if len(t) <= LOOKUP_BYTES else self._cut(t):
                if size and size + len(piece) > LOOKUP_BYTES:
                    steps.append(([], []))
                    size = 0
                steps[-1][0].append(piece)
                steps[-1][1].append(i)
                size += len(piece)
        for some, of in steps:
            ids, n = self._step(some)
            outs.append(ids)
            np.add.at(counts, of, n)
        return np.concatenate(outs), counts

    def _cut(self, text: bytes) -> list[bytes]:
        """A long text in pieces of about LOOKUP_BYTES that begin with a part."""
        starts = np.append(part_starts(np.frombuffer(text, np.uint8)), len(text))
        out, at = [], 0
        while at < len(text):
            k = max(np.searchsorted(starts, at + LOOKUP_BYTES, side="right") - 1, 0)
            end = int(starts[k] if starts[k] > at else starts[min(k + 1, len(starts) - 1)])
            out.append(text[at:end])
            at = end
        return out

    def _step(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"".join(texts)
        bounds = np.cumsum([0] + [len(t) for t in texts])
        if not joined:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        data = np.frombuffer(joined + bytes(SHORT_PART), np.uint8)
        begins = np.zeros(len(joined) + 1, bool)
        begins[bounds] = True
        begins[part_starts(data[: len(joined)])] = True
        starts = np.flatnonzero(begins[:-1])
        sizes = np.diff(np.append(starts, len(joined)))
        which = np.empty(len(starts), np.int64)
        short = sizes <= SHORT_PART
        at, n = starts[short], sizes[short]
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        columns = []
        for k in range(0, SHORT_PART, 8):
            left = np.clip(n - k, 0, 8).astype(U)
            mask = np.where(left == 8, ~U(0), (U(1) << (left * U(8))) - U(1))
            columns.append(eight[at + k] & mask)
        key = n.astype(U)
        for c in columns:
            key = mix64(key + c)
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        same = np.all([c == c[first][inverse] for c in columns] + [n == n[first][inverse]], axis=0)
        which[short] = np.where(same, inverse, -1)
        which[~short] = -1
        parts = [joined[s : s + m] for s, m in zip(at[first].tolist(), n[first].tolist(), strict=True)]
        other = np.flatnonzero(which < 0)
        if len(other):
            place: dict[bytes, int] = {}
            which[other] = [place.setdefault(joined[s : s + m], len(parts) + len(place)) for s, m in zip(starts[other].tolist(), sizes[other].tolist(), strict=True)]
            parts += list(place)
        found = self._ids(parts)
        number = np.array([len(f) // 4 for f in found], np.int64)
        offset = np.cumsum(number) - number
        flat = np.frombuffer(b"".join(found), "<u4")
        n = number[which]
        after = np.cumsum(n)
        ids = flat[np.repeat(offset[which] - (after - n), n) + np.arange(after[-1])]
        return ids, np.diff(np.append(0, after)[np.searchsorted(starts, bounds)])

    def text(self, text: str) -> bytes:
        return self.texts([text.encode("utf-8", "surrogatepass")])[0].tobytes()

    def whole(self, text: str) -> bytes:
        return self.encode([text.encode("utf-8", "surrogatepass")])[0]


class Openings:
    """A segment tree indexed by remaining capacity: how many open windows have each, and the tightest that fits."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, capacity: int, window: int) -> None:
        if capacity:
            self.windows[capacity].append(window)
            self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window of the least capacity of at least need, taken out of the tree, and that capacity."""
        i, count = need + self.leaves, self.count
        while not count[i]:
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1  # the next subtree to the right
        while i < self.leaves:
            i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return self.windows[capacity].pop(), capacity


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """For each length (1 to window) its window's number and its offset there; longest first, ties in the order given."""
    places: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    openings, opened = Openings(window), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if (found := openings.take(lengths[i])) is None:
            found, opened = (opened, window), opened + 1
        places[i] = (found[0], window - found[1])
        openings.put(found[1] - lengths[i], found[0])
    return places


def _batch(doc: pa.Array, start, length, ids: np.ndarray, tokens, sequence, offset) -> pa.RecordBatch:
    ends = np.append(0, np.cumsum(length)).astype(np.int32) * 4
    binary = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids))])
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([doc, pa.array(start), pa.array(length), binary, pa.array(tokens), pa.array(sequence), pa.array(offset)], names)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids (binary: little-endian 32-bit), doc_tokens, sequence_id, offset.

    Each document is its token ids and end_id, so an empty or null text is one piece of length 1. Full windows are
    sequences of their own; what remains of each document is packed with others of its input partition, in groups
    bounded by GROUP_PIECES and GROUP_TOKENS. Nothing is shuffled. A special token of the vocabulary that stands in a text
    is that token. Rows that repeat give pieces of their own; an empty
    table gives none. Other columns of docs are ignored.
    """

    def run(batches):
        task = TaskContext.get()
        base, opened = (task.partitionId() if task else 0) << 40, 0
        encode = PartIds(vocabulary)
        rest: list[tuple] = []
        pieces = held = 0

        def flush():
            nonlocal opened, rest, pieces, held
            if rest:
                length, tokens = np.concatenate([r[1] for r in rest]), np.concatenate([r[2] for r in rest])
                places = np.array(best_fit(length.tolist(), window), np.int64)
                found = _batch(pa.concat_arrays([r[0] for r in rest]), tokens - length, length, np.concatenate([r[3] for r in rest]), tokens, base + opened + places[:, 0], places[:, 1])
                yield from (found.slice(i, SENT_PIECES) for i in range(0, found.num_rows, SENT_PIECES))
                opened += int(places[:, 0].max()) + 1
                rest, pieces, held = [], 0, 0

        for b in batches:
            every = b.column("doc_id").cast(pa.int64())
            for g, data in text_groups(b, text, LOOKUP_BYTES):
                ids, n = encode.texts(data)
                ids, tokens, doc = np.insert(ids, np.cumsum(n), end_id), n + 1, every[g]
                full, left = tokens // window, tokens % window
                begin = np.cumsum(tokens) - tokens
                of = np.repeat(np.arange(len(tokens)), full)
                if len(of):
                    start = (np.arange(len(of)) - np.repeat(np.cumsum(full) - full, full)) * window
                    for i in range(0, len(of), SENT_PIECES):
                        o, s = of[i : i + SENT_PIECES], start[i : i + SENT_PIECES]
                        took = ids[((begin[o] + s)[:, None] + np.arange(window)).ravel()]
                        yield _batch(doc.take(pa.array(o)), s, np.full(len(o), window, np.int64), took, tokens[o], base + opened + np.arange(len(o)), np.zeros(len(o), np.int64))
                        opened += len(o)
                part = np.flatnonzero(left)
                if not len(part):  # whole windows only
                    continue
                m = left[part]
                inside = np.repeat(begin[part] + tokens[part] - m - (np.cumsum(m) - m), m) + np.arange(m.sum())
                rest.append((doc.take(pa.array(part)), m, tokens[part], ids[inside]))
                pieces, held = pieces + len(part), held + int(m.sum())
                if pieces >= GROUP_PIECES or held >= GROUP_TOKENS:
                    yield from flush()
        yield from flush()
        del encode
        release()

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame) -> DataFrame:
    p = pack(docs, default_vocabulary())
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 tokens."""
    return pieces(table(spark, sf_dir, "documents"))
