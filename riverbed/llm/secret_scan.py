"""Secrets in texts: patterns, then spans whose decoded structure confirms a key or a signed token."""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import from_texts, table

KINDS = ("assign", "access", "hex", "der", "ssh", "jwt", "public")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The patterns of the base kinds.
ASSIGN = re.compile("(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # [A-Z0-9]+ of 18 characters in all: a shorter match ends where its run ends
HEX = re.compile(r"[0-9a-f]{16,}")
#: What may stand between two lines of a key: white space, quotes, commas, marks of quoted mail, and line ends written as escapes.
BETWEEN = r"""(?:\\[nrt]|[\s"',>])"""
#: Runs that may be encoded bytes: base64 (either alphabet, perhaps over lines), hex of either case, and dotted tokens.
BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{32,}}(?:{BETWEEN}++[A-Za-z0-9+/_-]{{16,}})*={{0,2}}")
#: The last line of such a run, if it is a short one.
TAIL = re.compile(rf"{BETWEEN}++(?!-----)[A-Za-z0-9+/_-]{{1,15}}={{0,2}}")
LINE = re.compile(rf"{BETWEEN}++|([A-Za-z0-9+/_-]+)")
#: Where a key may begin: a sequence's tag, wherever it stands.
SEQUENCE = re.compile("M")
#: Bytes as pairs of hex digits with colons, perhaps over lines.
COLON_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{2}(?::\s*+[0-9A-Fa-f]{2}){23,}")
HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
LONG_HEX = re.compile(r"[0-9A-Fa-f]{48,}")
#: Bytes of a key, at most, that stands somewhere inside a run of hex digits.
HEX_KEY = 1 << 14
# Object identifiers of RSA and elliptic-curve keys.
RSA_OID, EC_OID = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201")
# How the identifiers of encryption by password begin (PKCS#5, PKCS#12).
PASSWORD_OIDS = bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[yw][A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]{4,}+)\.([A-Za-z0-9_-]*)")  # JSON's "{" begins so


def decode64(text: str) -> bytes | None:
    text = re.sub(r"[\r\n=]", "", text).replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """(first byte of the content, its end) of the element at a place; None if the length isn't whole or not in its shortest form."""
    if at + 2 > len(data):
        return None
    n, start = data[at + 1], at + 2
    if n & 128:
        k = n & 127
        if not 1 <= k <= 4 or start + k > len(data):
            return None
        n, start = int.from_bytes(data[start : start + k], "big"), start + k
        if n < 128 or n >> (8 * (k - 1)) == 0:
            return None
    return (start, start + n) if start + n <= len(data) else None


def der_whole(head: bytes) -> int | None:
    """Bytes of a sequence with its header, as its first bytes say."""
    if len(head) < 6 or head[0] != 0x30 or head[1] > 0x84:
        return None
    k = head[1] & 127 if head[1] & 128 else 0
    return 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1])


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, first byte of the content, its end) of the elements that fill a range exactly; else None."""
    found = []
    while at < end:
        if not (part := der_length(data, at)) or part[1] > end:
            return None
        found.append((data[at], *part))
        at = part[1]
    return found


def der_kind(data: bytes) -> str | None:
    """"der" for a sequence that fills the data and holds, exactly, elements as a PKCS#1, PKCS#8 (encrypted or not) or SEC1
    private key does, "public" for a public key, else None. The parts inside are followed too: the algorithm's sequence, SEC1's tagged parts,
    and the key that PKCS#8 wraps, where its algorithm says what that must be."""
    if not data or data[0] != 0x30 or not (whole := der_length(data, 0)) or whole[1] < len(data) - 2:
        return None
    parts = elements(data, *whole)
    tags = [p[0] for p in parts or ()]
    if tags[:2] == [0x02, 0x02]:
        return "der" if tags == [0x02] * 9 else None
    if tags[:2] == [0x02, 0x04]:
        return "der" if 0xA0 in tags[2:] and all(elements(data, s, e) is not None for t, s, e in parts[2:] if t in (0xA0, 0xA1)) else None
    if tags[:3] != [0x02, 0x30, 0x04] and tags not in ([0x30, 0x03], [0x30, 0x04]):
        return None
    names = elements(data, *parts[tags.index(0x30)][1:])
    if not names or names[0][0] != 0x06:
        return None
    if tags == [0x30, 0x03]:
        return "public"
    name = data[names[0][1] : names[0][2]]
    if tags == [0x30, 0x04]:  # as a digest with its algorithm has it too
        return "der" if name.startswith(PASSWORD_OIDS) and parts[1][2] - parts[1][1] >= 16 else None
    inner = elements(data, *parts[2][1:])
    if name in (RSA_OID, EC_OID):
        within = elements(data, *inner[0][1:]) if inner and [p[0] for p in inner] == [0x30] else None
        shape = [p[0] for p in within or ()]
        return "der" if (shape == [0x02] * 9 if name == RSA_OID else shape[:2] == [0x02, 0x04]) else None
    return "der"


def is_der_key(data: bytes) -> bool:
    return der_kind(data) is not None


def is_ssh_key(data: bytes) -> bool:
    """Fields of four-byte lengths, of which the first names a key type and the last ends with the data; or an OpenSSH private key."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at, fields = 0, []
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if n > len(data) - at - 4:
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return at == len(data) and len(fields) >= 2 and re.fullmatch(rb"ssh-[a-z0-9-]+|ecdsa-sha2-[a-z0-9-]+", fields[0]) is not None


def openssh_whole(data: bytes) -> int | None:
    """Bytes of an OpenSSH private key, with the tag of its cipher; None if its fields don't end with the data."""
    at, names, left = 15, [], 3
    while left:
        n = int.from_bytes(data[at : at + 4], "big")
        names.append(data[at + 4 : at + 4 + n])
        at, left = at + 4 + n, left - 1
        if len(names) == 3:  # cipher, key derivation and its options: a count of public keys, then they and the private part
            at, left = at + 4, int.from_bytes(data[at : at + 4], "big") + 1
        if at > len(data):
            return None
    at += 16 if b"gcm" in names[0] or b"poly1305" in names[0] else 0
    return at if at <= len(data) else None


def ssh_ends(data: bytes) -> set[int]:
    """Where a field ends, as far as fields follow each other."""
    at, ends = 0, set()
    while at + 4 <= len(data) and (n := int.from_bytes(data[at : at + 4], "big")) <= len(data) - at - 4:
        at += 4 + n
        ends.add(at)
    return ends


def keys_in(run: str, tail: str) -> list[tuple[int, int, str]]:
    """Keys in a base64 run and the short line after it: DER keys wherever they begin, SSH keys where a line begins. A DER key
    ends where its length says, so that nothing glued to it hides it."""
    whole = run + tail
    lines = [m.span(1) for m in LINE.finditer(run) if m[1]]
    own = len(lines)
    lines += [(len(run) + m.start(1), len(run) + m.end(1)) for m in LINE.finditer(tail) if m[1]]
    before = [0, *accumulate(e - s for s, e in lines)]
    flat = "".join(whole[s:e] for s, e in lines)

    def at(k: int) -> int:  # the place in whole of the flat text's k-th letter
        i = bisect_right(before, k) - 1
        return lines[i][0] + k - before[i]

    def ssh_size(start: int) -> int | None:  # letters of the SSH key that begins there
        if not flat.startswith(("b3BlbnNzaC1rZXktdjEA", "AAAA"), start):
            return None
        if flat.startswith("AAAA", start) and (decode64(flat[start : start + 16]) or b"")[4:8] not in (b"ssh-", b"ecds"):
            return None
        n = len(flat) - start
        data = decode64(flat[start : len(flat) - (n % 4 == 1)]) or b""
        if data.startswith(b"openssh-key-v1\0"):
            n = openssh_whole(data)
            return -(-n * 4 // 3) if n else before[own] - start
        ends = ssh_ends(data)
        sizes = [b - start for b in before if b > start]
        return max((n for n in sizes if n % 4 != 1 and n * 3 // 4 in ends and is_ssh_key(data[: n * 3 // 4])), default=None)

    def der_size(start: int) -> tuple[int, str] | None:  # letters of the DER key that begins there, and its kind
        head = decode64(flat[start : start + 12]) or b""
        n = der_whole(head)
        first = 2 + (head[1] & 127 if n and head[1] & 128 else 0)
        size = -(-n * 4 // 3) if n else 0
        if not n or start + size > len(flat) or head[first : first + 1] not in (b"\x02", b"\x30"):
            return None
        kind = der_kind(decode64(flat[start : start + size]) or b"")
        return (size, kind) if kind else None

    begins = {before[i] for i in range(own)}
    found, done = [], 0
    for start in sorted(begins | {m.start() for m in SEQUENCE.finditer(flat, 0, before[own])}):
        if start < done:
            continue
        if flat[start] == "M":
            size, kind = der_size(start) or (None, "der")
        else:
            size, kind = ssh_size(start), "ssh"
        if not size:
            continue
        done = start + min(size, len(flat) - start)
        end = at(done - 1) + 1
        found.append((at(start), end + len(whole[end : end + 2]) - len(whole[end : end + 2].lstrip("=")), kind))
    return found


def keys_in_hex(run: str) -> list[tuple[int, int, str]]:
    """Keys in a run of hex digits, wherever they begin; an SSH key must end with the run."""
    found, at = [], 0
    while (at := run.find("30", at)) >= 0:
        n = der_whole(bytes.fromhex(run[at : at + 12])) if at + 48 <= len(run) else None
        known = der_kind(bytes.fromhex(run[at : at + 2 * n])) if n and 24 <= n <= HEX_KEY and at + 2 * n <= len(run) else None
        if known:
            found.append((at, at + 2 * n, known))
        at += 2 * n if known else 1
    for at in (0, 1) if not found else ():
        data = bytes.fromhex(run[at : len(run) - (len(run) - at) % 2])
        if data[:1] in (b"\0", b"o") and is_ssh_key(data):
            return [(at, at + 2 * len(data), "ssh")]
    return found


def is_token_header(text: str) -> bool:
    data = decode64(text)
    try:
        head = json.loads(data) if data else None
    except ValueError:
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def confirmed(text: str) -> list[tuple[int, int, str]]:
    found = []
    for m in JWT.finditer(text):
        if is_token_header(m[1]):
            found.append((m.start(), m.end(), "jwt"))
    for m in BASE64.finditer(text):
        tail = None if m[0].endswith("=") else TAIL.match(text, m.end())
        found += [(m.start() + s, m.start() + e, kind) for s, e, kind in keys_in(m[0], tail[0] if tail else "")]
    for m in COLON_HEX.finditer(text):
        places = [i for i, c in enumerate(m[0]) if c in HEX_DIGITS]
        pairs = "".join(m[0][i] for i in places)
        found += [(m.start() + places[s], m.start() + places[e - 1] + 1, kind) for s, e, kind in keys_in_hex(pairs) if s % 2 == 0]
    for m in LONG_HEX.finditer(text):
        found += [(m.start() + s, m.start() + e, kind) for s, e, kind in keys_in_hex(m[0])]
    return found


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as in KINDS; spans of different kinds may overlap."""
    if not isinstance(text, str) or not text:
        return []
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    found += confirmed(text)
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2]), f[1]))


def secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds secrets: array of (start, end, kind) of the whole text; empty and null texts have none. Rows stand for themselves."""

    def run(data: list[bytes]) -> list:
        return [[{"start": s, "end": e, "kind": k} for s, e, k in scan(t.decode("utf-8", "replace"))] for t in data]

    return from_texts(docs, text, "secrets", "array<struct<start:bigint,end:bigint,kind:string>>", lambda: run)


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each run of characters that spans cover replaced by mark; other texts, null and empty ones included, stay
    as they are, as do all other columns. Rows that repeat stay rows."""

    def one(data: bytes) -> str:
        t = data.decode("utf-8", "replace")
        parts, at = [], 0
        for s, e, _ in scan(t):
            if s >= at:
                parts += [t[at:s], mark]
            at = max(at, e)
        return "".join([*parts, t[at:]])

    return from_texts(docs, text, text, "string", lambda: lambda data: list(map(one, data)))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:3]))
    def number(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("secrets").alias("spans"))
