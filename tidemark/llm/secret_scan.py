"""Secret scanning: pattern candidates and structural confirmation.

Candidates are armoured blocks, runs of base64 or hex (also wrapped over lines), and dotted runs. Each is decoded
and parsed once, and what decodes to text is searched in the same way, so every step is linear in the text.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts

# The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Kinds in their order among spans with one start. The last three come from structural confirmation.
KINDS = ("assign", "access", "hex", "pem", "der", "jwt")
# Candidates for decoding. Lines of one block may be indented.
ARMOUR = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
DOTTED = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
HEX_ANY = re.compile(r"[0-9A-Fa-f]{16,}(?:\r?\n[ \t]*[0-9A-Fa-f]+)*")
#: Characters of a base64 or hex candidate at least, and encodings inside encodings that are undone.
LEAST_CODED = 44
NESTED = 4
#: Bytes of a key among other lines, where its stated length tells where it ends.
LEAST_KEY, MOST_KEY = 33, 1 << 14
#: DER object identifiers of key algorithms, and magic strings of other key encodings.
KEY_OIDS = tuple(
    bytes.fromhex(x)
    for x in (
        "2a864886f70d010101",  # RSA
        "2a8648ce3d0201",  # elliptic curve
        "2b6570",  # Ed25519
        "2b656e",  # X25519
        "2a8648ce380401",  # DSA
    )
)
OPENSSH = b"openssh-key-v1\0"


def _decode64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der(data: bytes, at: int = 0, end: int | None = None) -> tuple[int, int, int] | None:
    """(tag, start, end) of the value at `at`, if its length fits exactly within the data."""
    end = len(data) if end is None else end
    if at + 2 > end:
        return None
    tag, first = data[at], data[at + 1]
    at += 2
    if first < 0x80:
        size = first
    else:
        n = first & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    return (tag, at, at + size) if at + size <= end else None


def _der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """All values between at and end, if their nested lengths fill the space exactly."""
    items = []
    while at < end:
        item = _der(data, at, end)
        if item is None:
            return None
        items.append(item)
        at = item[2]
    return items


def is_der_key(data: bytes) -> bool:
    """A DER SEQUENCE that is a PKCS#1, PKCS#8 or SEC 1 private key, every nested length checked."""
    top = _der(data)
    if top is None or top[0] != 0x30 or top[2] != len(data) or top[2] - top[1] < 8:
        return False
    items = _der_items(data, top[1], top[2])
    if not items or items[0][0] != 2 or items[0][2] - items[0][1] != 1:
        return False
    tags = [t for t, _, _ in items]
    if tags == [2] * len(tags) and len(tags) in (6, 9, 10):  # DSA, PKCS#1
        return True
    if tags[1:3] == [0x30, 4]:  # PKCS#8
        inner = _der_items(data, *items[1][1:])
        return bool(inner) and inner[0][0] == 6 and data[inner[0][1] : inner[0][2]] in KEY_OIDS
    return tags[1:2] == [4] and items[1][2] - items[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])  # SEC 1


def is_ssh_key(data: bytes) -> bool:
    """OpenSSH's private key container: magic, then length-prefixed fields that fit."""
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)
    for _ in range(3):  # cipher, key derivation, its options
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        if at > len(data):
            return False
    return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_ssh_key(data))


def signed_token(parts: list[str]) -> int:
    """How many of the first parts form a signed token: 3, 5 if it is encrypted, else 0.

    The header decodes to a JSON object with a string alg. A signed token's body is a JSON object too.
    """
    start = _decode64(parts[0][:8]) if len(parts[0]) >= 8 else None
    if not start or not (start.lstrip(b" \t\r\n") or b"{").startswith(b"{"):
        return 0
    try:
        top = json.loads(_decode64(parts[0]) or b"")
        if not (isinstance(top, dict) and isinstance(top.get("alg"), str)):
            return 0
        if "enc" in top:
            return 5 if len(parts) >= 5 else 0
        return 3 if len(parts) >= 3 and isinstance(json.loads(_decode64(parts[1]) or b""), dict) else 0
    except (ValueError, RecursionError):
        return 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if ("=" in text or ":" in text) else []
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def _armoured(text: str) -> list[tuple[str, int, int]]:
    """Key blocks between a BEGIN line and the END line of the same name, no other such line between them."""
    found, begin = [], None
    for m in ARMOUR.finditer(text):
        if m[1] == "BEGIN":
            begin = m
        elif begin and begin[2] == m[2]:
            body = text[begin.end() : m.start()]
            data = _decode64("".join("".join(x for x in body.split("\n") if ":" not in x).split()))
            if data and (is_key(data) or "ENCRYPTED" in m[2] + body and (_der(data) or len(data) % 8 == 0)):
                found.append(("pem", begin.start(), m.end()))
            begin = None
    return found


def _tokens(text: str) -> list[tuple[str, int, int]]:
    found = []
    for m in DOTTED.finditer(text):
        parts, at, k = m[0].split("."), m.start(), 0
        while k < len(parts) - 2:
            n = signed_token(parts[k : k + 5])
            size = sum(len(x) + 1 for x in parts[k : k + max(1, n)])
            if n:
                found.append(("jwt", at, at + size - 1))
            at, k = at + size, k + max(1, n)
    return found


def _inside(data: bytes | None, depth: int) -> str | None:
    """The kind of secret that decoded data is, or that its text holds."""
    if not data:
        return None
    if is_key(data):
        return "der"
    if depth and len(data) >= LEAST_CODED and data.isascii():
        inner = data.decode("ascii")
        if inner.isprintable() or not inner.translate(PRINTED):
            return next((kind for kind, _, _ in confirmed_spans(inner, depth - 1)), None)
    return None


#: Deletes what a text of codes is made of.
PRINTED = dict.fromkeys([9, 10, 13, *range(32, 127)])


def _stated(lines: list[str], k: int, decode, per_byte: float) -> int:
    """How many lines from the k-th hold the DER value that starts there, by its stated length; 0 if none fits."""
    head = decode(lines[k][:16])
    if not head or head[0] != 0x30 or len(head) < 6:
        return 0
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    size = 2 + n + int.from_bytes(head[2 : 2 + n], "big") if n else 2 + head[1]
    if n > 4 or not LEAST_KEY <= size <= MOST_KEY:
        return 0
    left, end = math.ceil(size * per_byte), k
    while end < len(lines) and left > 0:
        left -= len(lines[end])
        end += 1
    return end - k if left <= 0 else 0


def _coded(text: str, pattern: re.Pattern, decode, per_byte: float, depth: int) -> list[tuple[str, int, int]]:
    """Spans of base64 or hex blocks that hold a secret: the whole block, else its lines and those a key states to take."""
    found = []
    for m in pattern.finditer(text):
        lines = m[0].split()
        if sum(map(len, lines)) < LEAST_CODED:
            continue
        if kind := _inside(decode("".join(lines)), depth):
            found.append((kind, *m.span()))
            continue
        at, starts = m.start(), []
        for line in lines:
            starts.append(text.index(line, at))
            at = starts[-1] + len(line)
        k = 0
        while k < len(lines) and len(lines) > 1:
            n, kind = _stated(lines, k, decode, per_byte), None
            if n > 1:
                kind = _inside(decode("".join(lines[k : k + n])), 0)
            if not kind and len(lines[k]) >= LEAST_CODED:
                n, kind = 1, _inside(decode(lines[k]), depth)
            if kind:
                found.append((kind, starts[k], starts[k + n - 1] + len(lines[k + n - 1])))
            k += n if kind else 1
    return found


def _decode16(text: str) -> bytes | None:
    return bytes.fromhex(text) if len(text) % 2 == 0 else None


def confirmed_spans(text: str, depth: int = NESTED) -> list[tuple[str, int, int]]:
    """Spans that decoding and parsing confirm; a candidate inside a confirmed one is not reported again."""
    found = _armoured(text) if "-----BEGIN " in text else []
    found += _tokens(text) if "." in text else []
    found += _coded(text, BASE64, _decode64, 4 / 3, depth) + _coded(text, HEX_ANY, _decode16, 2, depth)
    out, end = [], -1
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if b > end:
            out.append((kind, a, b))
            end = b
    return out


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, end exclusive, by start and then kind as listed in KINDS."""
    text = text or ""
    found = base_spans(text) + confirmed_spans(text)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, kinds array, starts array, ends array): one row per row of docs, over whole texts.

    Null and empty texts have no spans; a long text takes time in proportion to its length; spans that start
    together go by kind, then end. Repeated rows stay repeated, a null doc_id stays null, other
    columns are ignored, an empty table gives an empty result.
    """

    def make():
        def run(texts: list[str]) -> dict:
            spans = [spans_of(t) for t in texts]
            return {n: [[s[k] for s in x] for x in spans] for k, n in enumerate(("kinds", "starts", "ends"))}

        return run

    types = {"kinds": pa.list_(pa.string()), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64())}
    return map_texts(docs, make, types, "kinds array<string>, starts array<long>, ends array<long>")


def join_spans(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def op10(docs: DataFrame) -> DataFrame:
    """The contract's columns, derived from the spans of the operator."""
    out = scan(docs).withColumn("all", F.arrays_zip("kinds", "starts", "ends"))
    base = F.filter("all", lambda s: s["kinds"].isin("assign", "access", "hex"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"])), ",")
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans")
    )
