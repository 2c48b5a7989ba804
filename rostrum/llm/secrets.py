r"""Secret scan with structural confirmation.

Base findings come from three patterns; on top of them, base64 and hex candidates are decoded and reported only when the
bytes have a key's structure: DER with nested lengths that fit exactly, length-prefixed SSH blobs, PEM armour around
such bytes, or a signed token whose header and payload parse.

Defined cases: a null text counts as empty; repeated rows each get a row; an empty table gives an empty result; columns
other than doc_id and text are ignored. Positions are code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds in the order in which spans that start together are listed (fixed values).
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ANY_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{64,}|[0-9A-F]{64,})(?![0-9A-Za-z])")
BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----\s*((?:[A-Za-z][A-Za-z0-9-]*: [^\n]*\n)*)([^-]+)-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")
#: A run of token letters is looked at once, from its start, so the time grows with the text alone.
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
SSH_KINDS = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
OPENSSH = b"openssh-key-v1\0"
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value of the DER element at `at`; None if its length doesn't fit."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        found = _tlv(data, at, end)
        if found is None:
            return None
        out.append(found)
        at = found[2]
    return out


def is_der_key(data: bytes) -> bool:
    """Whether the bytes are one DER sequence, filled exactly, with the outline of a private or public key."""
    outer = _tlv(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    inner = _elements(data, outer[1], outer[2])
    if not inner:
        return False
    tags = [t for t, _, _ in inner]
    if tags[:1] == [0x02] and len(tags) >= 6 and set(tags) == {0x02}:  # numbers of an RSA or DSA key
        return True
    if tags == [0x02, 0x02] and inner[0][2] - inner[0][1] >= 64:  # modulus and exponent
        return True
    if tags[:2] == [0x02, 0x04] and inner[0][2] - inner[0][1] == 1:  # elliptic curve key
        return True
    sealed = tags == [0x30, 0x04] and inner[1][2] - inner[1][1] >= 32  # an encrypted key
    algorithm = inner[1] if tags[:3] == [0x02, 0x30, 0x04] else inner[0] if tags == [0x30, 0x03] or sealed else None
    if algorithm is None:
        return False
    names = _elements(data, algorithm[1], algorithm[2])
    return bool(names) and names[0][0] == 0x06


def _fields(data: bytes, at: int, n: int | None = None) -> tuple[list[bytes], int] | None:
    """n length-prefixed fields from `at` on, or as many as fill the bytes, and where they end; None if one doesn't fit."""
    out: list[bytes] = []
    while len(out) < n if n is not None else at < len(data):
        if at + 4 > len(data):
            return None
        size, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if size > len(data) - at:
            return None
        out.append(data[at : at + size])
        at += size
    return out, at


def is_ssh_key(data: bytes) -> bool:
    """Whether the bytes are a public key of a known kind, or a private key file: cipher, derivation and its options, the
    number of keys, that many public keys, and the private part, which ends the file."""
    if data.startswith(OPENSSH):
        head = _fields(data, len(OPENSSH), 3)
        if head is None or head[1] + 4 > len(data):
            return False
        n = int.from_bytes(data[head[1] : head[1] + 4], "big")
        rest = _fields(data, head[1] + 4, n + 1) if 1 <= n <= len(data) // 4 else None
        return rest is not None and rest[1] == len(data) and all(map(_is_public, rest[0][:-1])) and len(rest[0][-1]) % 8 == 0
    return _is_public(data)


def _is_public(data: bytes) -> bool:
    found = _fields(data, 0)
    return found is not None and len(found[0]) >= 2 and found[0][0] in SSH_KINDS


def _decoded(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    try:
        return (base64.urlsafe_b64decode if url else base64.b64decode)(text + "=" * (-len(text) % 4))
    except (binascii.Error, ValueError):
        return None


def _is_token(found: str) -> bool:
    header, payload, _ = found.split(".", 2)
    try:
        head, body = (json.loads(_decoded(x, url=True) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def _kind_of(data: bytes | None) -> str | None:
    if data:
        if is_der_key(data):
            return "der"
        if is_ssh_key(data):
            return "ssh"
    return None


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and confirmed spans of a text, unordered."""
    base, more = [], []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        base += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        base += [("access", *m.span()) for m in ACCESS.finditer(text)]
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    for m in BASE64.finditer(text):
        if kind := _kind_of(_decoded(m[0])):
            more.append((kind, *m.span()))
    for m in ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := _kind_of(bytes.fromhex(m[0]))):
            more.append((kind, *m.span()))
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            data = _decoded(re.sub(r"\s", "", m[2]))
            # With headers that name a cipher, the body is encrypted and fills whole cipher blocks.
            if _kind_of(data) or data and "ENCRYPTED" in m[1] and "DEK-Info:" in m[1] and len(data) % 8 == 0:
                more.append(("pem", *m.span()))
    if "eyJ" in text:
        more += [("jwt", *m.span()) for m in JWT.finditer(text) if _is_token(m[0])]
    return base, more


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = batch.column("doc_id"), []
        for text in batch.column("text"):
            base, more = scan(text.as_py() or "")
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
            out.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more)))
        columns = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])
    common.given_back()


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base kinds, the digest of the base spans, and all spans."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan_batches, SCHEMA)


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    return find_secrets(common.table(spark, sf_dir, "documents"))
