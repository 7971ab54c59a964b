"""Operator 1: secrets in texts, confirmed by the structure of what candidates decode to."""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_arrow

#: Kinds in the order in which spans with one start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh_key")
#: No structure that is looked for has more members on one level; a walk over a candidate stops there.
MEMBERS = 32

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
#: Where an encoded key may start: a run whose first bytes are a DER sequence (in base64 or hexadecimal) or the OpenSSH
#: container; runs start at a character outside the alphabet or after a line feed that is written as an escape.
_START64 = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n))(?:M[A-P][A-Za-z0-9+/_-]{14}|b3BlbnNzaC1rZXktdjEA)")
_START16 = re.compile(r"(?<![0-9A-Fa-f])(?:30[0-9A-Fa-f]{22}|6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]763100)")
_RUN64, _RUN16 = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9A-Fa-f]+")
#: How an encoded key goes on in the next line.
_WRAP = re.compile(r"(?:\r?\n[\x20\t]*|(?:\\r)?\\n)(?=[A-Za-z0-9+/_-])")
_SSH = b"openssh-key-v1\0"
#: How a JSON object starts in base64: a brace, then a quote, a space, a tab, a line feed or a carriage return.
_OBJECTS = ("eyJ", "eyA", "ewk", "ewo", "ew0")
_OBJECT = re.compile("|".join(_OBJECTS))

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

#: Object identifiers (DER content) of RSA, elliptic curve and DSA keys, the keys that are plain octets with
#: their lengths (X25519, X448, Ed25519, Ed448), and the arcs of password-based encryption.
_RSA, _EC, _DSA = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2a8648ce380401")
_OCTETS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
_ENCRYPTED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, where the value starts, its length) of the DER value at ``at``; lengths must be written in the shortest form."""
    if at + 2 > len(data) or data[at] & 0x1F == 0x1F:
        return None
    n = data[at + 1]
    if n < 0x80:
        return data[at], at + 2, n
    k = n & 0x7F
    if not 1 <= k <= 4 or at + 2 + k > len(data):
        return None
    n = int.from_bytes(data[at + 2 : at + 2 + k], "big")
    return (data[at], at + 2 + k, n) if n >= 0x80 and n >> 8 * (k - 1) else None


def der_items(data: bytes | memoryview, most: int | None = MEMBERS) -> list[tuple[int, memoryview]] | None:
    """(tag, value) of the DER values that fill ``data`` exactly; None if they don't, or if they are more than ``most``.

    Values are views: only headers are read, however long a value is.
    """
    data = memoryview(data)
    out: list[tuple[int, memoryview]] = []
    at = 0
    while at < len(data):
        head = _header(data, at)
        if head is None or head[1] + head[2] > len(data) or len(out) == most:
            return None
        out.append((head[0], data[head[1] : head[1] + head[2]]))
        at = head[1] + head[2]
    return out


def well_formed(data: bytes, depth: int = 0) -> bool:
    """DER values, nested to any sensible depth, that fill ``data`` exactly."""
    items = der_items(data, None) if depth < 12 else None
    return items is not None and all(well_formed(v, depth + 1) for tag, v in items if tag & 0x20)


def _positive(v: bytes | memoryview) -> bool:
    """The content of a positive DER integer, which is written in the fewest bytes."""
    return 0 < v[0] < 0x80 or len(v) > 1 and v[0] == 0 and v[1] >= 0x80


def _integers(items: list[tuple[int, bytes]], n: int, least: int) -> bool:
    """``n`` or more positive integers after a small version, of which the first has ``least`` bytes or more."""
    return len(items) >= n and all(t == 2 and v for t, v in items[:n]) and len(items[0][1]) == 1 and items[0][1][0] <= 1 and all(_positive(v) for _, v in items[1:n]) and len(items[1][1]) >= least


def _private(items: list[tuple[int, bytes]]) -> bool:
    """The fields of an RSA, DSA or elliptic curve private key, of PKCS#8, or of its encrypted form."""
    tags = [t for t, _ in items]
    if tags[:2] == [2, 2]:
        # nine integers (and the further primes of a multi-prime key) for RSA; six for DSA
        return _integers(items, 9, 32) and (len(items) == 9 or tags[9:] == [0x30]) or len(items) == 6 and _integers(items, 6, 32)
    if tags[:2] == [2, 4]:
        return items[0][1] == b"\x01" and 16 <= len(items[1][1]) <= 72 and all(t in (0xA0, 0xA1) and well_formed(v) for t, v in items[2:]) and _bits(items[2:])
    if tags[:3] == [2, 0x30, 4]:
        kind = der_items(items[1][1])
        return items[0][1] in (b"\0", b"\x01") and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:]) and bool(kind) and kind[0][0] == 6 and all(well_formed(v) for t, v in kind if t & 0x20) and _inner(bytes(kind[0][1][:16]), items[2][1])
    if tags == [0x30, 4]:
        kind = der_items(items[0][1])
        return bool(kind) and kind[0][0] == 6 and bytes(kind[0][1][:16]).startswith(_ENCRYPTED) and len(kind) == 2 and well_formed(kind[1][1]) and len(items[1][1]) >= 16
    return False


def _bits(items: list[tuple[int, bytes]]) -> bool:
    """Bit strings among the values of ``items`` start with the number of their unused bits."""
    return all(b and b[0] <= 7 for _, v in items for t, b in der_items(v) or [] if t == 3)


def _inner(kind: bytes, data: bytes) -> bool:
    """The octets of a PKCS#8 key hold what its algorithm asks for."""
    items = der_items(data)
    if not items or len(items) != 1:
        return False
    tag, value = items[0]
    if kind in _OCTETS:
        return tag == 4 and len(value) == _OCTETS[kind]
    if kind == _DSA:
        return tag == 2 and len(value) >= 16
    if kind in (_RSA, _EC):
        own = der_items(value) if tag == 0x30 else None
        return own is not None and [t for t, _ in own[:2]] == ([2, 2] if kind == _RSA else [2, 4]) and _private(own)
    # other algorithms: a sequence, or octets of a key's length
    return well_formed(data) and (tag == 0x30 or tag == 4 and len(value) >= 16)


def is_private_key(data: bytes) -> bool:
    """A DER sequence that fills ``data`` exactly and has the fields of a private key; public keys and certificates have others."""
    items = der_items(data)
    own = der_items(items[0][1]) if items and len(items) == 1 and items[0][0] == 0x30 else None
    return bool(own) and _private(own)


def _fields(data: bytes, at: int, n: int | None = None) -> tuple[list[bytes], int]:
    """Up to ``n`` length-prefixed fields from ``at`` and where they end; -1 if one is cut or they are more than MEMBERS."""
    out: list[bytes] = []
    while (n is None and at < len(data)) or (n is not None and len(out) < n):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data) or len(out) == MEMBERS:
            return out, -1
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at


def ssh_key_end(data: bytes) -> int:
    """Where the OpenSSH private key container at the start of ``data`` ends; -1 unless its nested lengths hold."""
    data = memoryview(data)
    if data[: len(_SSH)] != _SSH:
        return -1
    (*names, _), at = _fields(data, len(_SSH), 3) if len(data) > 32 else ([b""], -1)
    keys = int.from_bytes(data[at : at + 4], "big") if at >= 0 else 0
    if not 1 <= keys <= 16 or not names[0]:
        return -1
    public, at = _fields(data, at + 4, keys)
    for p in public if at >= 0 else [b""]:
        own, end = _fields(p, 0)
        if end != len(p) or len(own) < 2 or len(own[0]) > 64 or not re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", own[0]):
            return -1
    private, at = _fields(data, at, 1)
    if at < 0 or len(private[0]) < 16 or len(private[0]) % 8:
        return -1
    return at if names[0] != b"none" or private[0][:4] == private[0][4:8] else -1


def is_signed_token(head: str, body: str, signature: str) -> bool:
    """The first part decodes to a JSON object that names an algorithm, the second to a JSON object, and there is a signature unless the algorithm is none."""
    first = _object(head)
    return first is not None and isinstance(first.get("alg"), str) and (first["alg"] == "none") == (not signature) and _object(body) is not None


def _object(part: str) -> dict | None:
    try:
        out = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def _tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """Signed tokens. In a part of a dotted run a header is looked for at the first place of each way in which an object starts, so a part is decoded a fixed number of times."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 2 or not _OBJECT.search(m[0]):
            continue
        parts, at, k = m[0].split("."), m.start(), 0
        while k + 2 < len(parts):
            places = sorted(parts[k].find(o) for o in _OBJECTS)
            # a header with an algorithm has 14 characters or more
            j = next((j for j in places if 0 <= j <= len(parts[k]) - 14 and is_signed_token(parts[k][j:], parts[k + 1], parts[k + 2])), None)
            if j is not None:
                end = at + sum(map(len, parts[k : k + 3])) + 2
                yield "jwt", at + j, end
                at, k = end + 1, k + 3
            else:
                at, k = at + len(parts[k]) + 1, k + 1


class _Lines:
    """The encoded characters of wrapped lines from ``at`` on, joined, and the place of each in the text."""

    def __init__(self, text: str, at: int, run: re.Pattern, width: int) -> None:
        self.width, self.bytes = width, {}
        self.places, self.offsets, parts, n = [], [], [], 0
        while m := run.match(text, at):
            self.places.append(at)
            self.offsets.append(n)
            parts.append(m[0])
            at, n = m.end(), n + len(m[0])
            if not (wrap := _WRAP.match(text, at)):
                break
            at = wrap.end()
        self.joined, self.end = "".join(parts), at

    def data(self, offset: int) -> memoryview:
        """What the characters from ``offset`` on decode to; all offsets of one phase share the bytes."""
        group, size = (4, 3) if self.width == 6 else (2, 1)
        phase = offset % group
        if phase not in self.bytes:
            self.bytes[phase] = memoryview((_base64 if self.width == 6 else _base16)(self.joined[phase:]))
        return self.bytes[phase][offset // group * size :]

    def offset(self, at: int) -> int:
        k = bisect_right(self.places, at) - 1
        return self.offsets[k] + at - self.places[k]

    def place(self, offset: int) -> tuple[int, bool]:
        """Where the text goes on after ``offset`` characters, and whether their line ends there."""
        k = bisect_left(self.offsets, offset) - 1
        line_end = self.offsets[k + 1] if k + 1 < len(self.offsets) else len(self.joined)
        return self.places[k] + offset - self.offsets[k], offset == line_end


def _keys(text: str) -> Iterator[tuple[str, int, int]]:
    """Private keys in base64 (either alphabet) or hexadecimal, in one run or in wrapped lines.

    A candidate starts at the start of a run. A DER header states how long
    the key is, whatever follows in the next lines; an OpenSSH container ends
    where its fields do. The lines of a block are decoded once (once for each
    phase in which a candidate lies in it), and candidates are views of that:
    a start costs the headers of its members, however long a key it states.
    A confirmed key is not searched again.
    """
    for start, run, width in ((_START64, _RUN64, 6), (_START16, _RUN16, 4)):
        done, lines = 0, None
        for m in start.finditer(text):
            at = m.start()
            if at < done:
                continue
            if lines is None or at >= lines.end:
                lines = _Lines(text, at, run, width)
            o = lines.offset(at)
            if ssh := m[0][0] in "b6":
                end = ssh_key_end(lines.data(o))
            else:
                # the first octets: a sequence that fits what follows, and in it a version or a sequence
                first = _base64(m[0]) if width == 6 else bytes.fromhex(m[0])
                head = _header(first, 0)
                end = head[1] + head[2] if head and first[head[1]] in (2, 0x30) else -1
            need = -(-8 * end // width)
            if not 24 <= end or need > len(lines.joined) - o:
                continue
            stop, line_ends = lines.place(o + need)
            if not line_ends or not (ssh or is_private_key(lines.data(o)[:end])):
                continue
            pad = -need % 4 if width == 6 else 0
            while pad and text[stop : stop + 1] == "=":
                stop, pad = stop + 1, pad - 1
            yield "ssh_key" if ssh else "der", at, stop
            done = stop


def _base16(text: str) -> bytes:
    return bytes.fromhex(text[: len(text) // 2 * 2])


def _base64(text: str) -> bytes:
    """Of either alphabet; what is left after whole bytes is dropped."""
    text = text.replace("-", "+").replace("_", "/")
    text = text[: len(text) - (len(text) % 4 == 1)]
    return base64.b64decode(text + "=" * (-len(text) % 4))


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of one text by start, then kind; offsets are code points, ends exclusive."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    if _OBJECT.search(text):
        out += _tokens(text)
    out += _keys(text)
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


@F.pandas_udf(T.ArrayType(SPAN))
def _spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t)] if t else [] for t in batch])


def secret_spans(docs: DataFrame, text: str = "text", into: str = "secret_spans") -> DataFrame:
    """``docs`` with a column of secrets: an array of (kind, start, end), by start and then kind.

    The base kinds are found by pattern alone: assignments, access key ids and
    long lower-case hexadecimal runs. Structure adds spans and never removes
    base ones. Candidates are decoded and reported only if what they decode to
    holds: ``der`` is a private key whose DER lengths fit exactly at each
    level, octet strings of PKCS#8 included (RSA, DSA, elliptic curves,
    Edwards curves, encrypted keys); ``ssh_key`` an OpenSSH private key
    container whose length-prefixed fields fit; ``jwt`` a token whose header
    is JSON with an algorithm, with any white space, and whose body is JSON.
    Public keys and certificates are no secrets and are not reported. No
    candidate is too long. The cost is linear in the text and in the members
    of its candidates.

    Null and empty texts have no spans. Each row is scanned whole and by
    itself, so repeated rows repeat their result; all columns of ``docs`` stay
    (one named like ``into`` is replaced). Nothing is shuffled.
    """
    bound_arrow(docs.sparkSession)
    return docs.withColumn(into, _spans(F.col(text)))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
