"""Secret scans: pattern candidates, and structural confirmation of encoded keys and tokens.

Three kinds are found by pattern alone: ``assign``, ``access`` and ``hex``. Further candidates,
long runs of base64 or hex letters, are decoded and their structure is parsed before anything is
reported: DER keys must have lengths that nest exactly and the fields of a key, OpenSSH keys their
own framing, and signed tokens a JSON header that names an algorithm.

Spans are in code points, end exclusive. Texts are scanned within tasks, without a shuffle.

Defined results: a null or empty text has no spans; null ids, repeated rows and other columns pass
through; an input column with the name of a result is replaced.
"""

from __future__ import annotations

import base64
import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mentionflow.llm.wordhash import slices

# Order of kinds among spans that start together.
KINDS = ("assign", "access", "hex", "private_key", "public_key", "openssh_key", "signed_token")
BASE_KINDS = KINDS[:3]

# Patterns and least lengths of the kinds found by pattern.
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same spans as runs of any length kept from 24 on
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

# Candidates of the structural checks.
LETTERS = re.compile(r"[A-Za-z0-9+/_-]+")
# Between two lines: a break or an escape of one, with indentation and quotes about it.
_EDGE = r"""[\x20\t"',>#*]{0,64}"""
_PLUS = r"(?:\x20\+[\x20\t]{0,8})?\r?\n"  # strings may be added up
LINE_BREAK = re.compile(rf"{_EDGE}(?:(?:\\+r)?\\+n(?:{_EDGE}{_PLUS})?{_EDGE}|{_PLUS}{_EDGE})")
# How keys and PEM files begin in base64: a sequence of short or long length, OpenSSH's magic, dashes.
KEY_START = re.compile(r"M[A-I]|b3BlbnNzaC|LS0tLS1CRUdJTi")
KEY_LETTERS = 40
KEY_BYTES = 1 << 16  # far more than keys of any kind in use have
KEY_PARTS = (b"\x02", b"\x30")  # a key begins with a version or with its algorithm
HEX_RUN = re.compile(r"[0-9A-Fa-f]{80,}")
DOTTED = re.compile(r"[A-Za-z0-9_.-]+")
PADDING = re.compile("={0,2}")
PEM_END = re.compile(r"-----END [A-Z0-9 ]+-----\s*")
OPENSSH = b"openssh-key-v1\0"

SCHEMA = T.ArrayType(
    T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    ])
)
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

SEQUENCE, INTEGER, BIT_STRING, OCTETS, OBJECT = 0x30, 0x02, 0x03, 0x04, 0x06
MAX_DEPTH = 16


@dataclass(frozen=True)
class Node:
    tag: int
    body: bytes
    children: tuple[Node, ...]


def der(data: bytes, depth: int = 0) -> tuple[Node, ...] | None:
    """The elements that fill ``data`` exactly, or None if some length doesn't fit."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > MAX_DEPTH:
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            length = int.from_bytes(data[at : at + n], "big")
            at += n
            if length < 0x80:
                return None  # DER takes the short form here
        if at + length > len(data):
            return None
        body = data[at : at + length]
        children = der(body, depth + 1) if tag & 0x20 else ()
        if children is None:
            return None
        found.append(Node(tag, body, children))
        at += length
    return tuple(found)


def key_kind(data: bytes) -> str | None:
    """private_key or public_key if ``data`` is one DER key, with nothing after it."""
    top = der(data) if data[:1] == bytes([SEQUENCE]) else None
    if not top or len(top) != 1 or not top[0].children:
        return None
    parts = top[0].children
    tags = [p.tag for p in parts]
    version = parts[0].body if tags[0] == INTEGER else None
    if version in (b"\x00", b"\x01") and tags[:9] == [INTEGER] * 9:
        return "private_key"  # RSA: version, modulus, exponents, primes, …
    if version == b"\x00" and tags == [INTEGER] * 6:
        return "private_key"  # DSA
    if version == b"\x01" and tags[1:2] == [OCTETS] and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "private_key"  # elliptic curve
    if version in (b"\x00", b"\x01") and tags[1:3] == [SEQUENCE, OCTETS] and _algorithm(parts[1]):
        return "private_key"  # any algorithm, its key in the octets
    if tags == [SEQUENCE, OCTETS] and _algorithm(parts[0]) and len(parts[1].body) >= 16:
        return "private_key"  # encrypted
    if tags == [SEQUENCE, BIT_STRING] and _algorithm(parts[0]) and parts[1].body[:1] == b"\x00":
        return "public_key"
    return None


def _algorithm(node: Node) -> bool:
    return bool(node.children) and node.children[0].tag == OBJECT and 3 <= len(node.children[0].body) <= 32


def der_size(data: bytes) -> int | None:
    """How many bytes the element at the start of ``data`` takes."""
    if len(data) < 2 or data[0] != SEQUENCE:
        return None
    if data[1] < 0x80:
        return 2 + data[1]
    n = data[1] & 0x7F
    return 2 + n + int.from_bytes(data[2 : 2 + n], "big") if 1 <= n <= 4 else None


def openssh_size(data: bytes) -> int | None:
    """How many bytes a private key in OpenSSH's framing takes: magic, then length-prefixed strings."""
    if not data.startswith(OPENSSH):
        return None
    at, strings = len(OPENSSH), 3  # cipher, key derivation, its options
    for part in (0, 1):
        for _ in range(strings):
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            if at > len(data):
                return None
        if part == 0:
            strings = int.from_bytes(data[at : at + 4], "big") + 1  # public keys and the private part
            at += 4
            if not 2 <= strings <= 17:
                return None
    return at


def signed_token(text: str) -> bool:
    """Header and payload are JSON objects, and the header names an algorithm."""
    header, payload, signature = text.split(".")
    try:
        first, second = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    if not isinstance(first, dict) or not isinstance(second, dict) or not isinstance(first.get("alg"), str):
        return False
    return bool(signature) != (first["alg"].lower() == "none")


class _Run:
    """Letters of base64 in lines that belong together, from the first start of a key in them on. They are
    decoded once for each place that a group of four may begin at, however many keys seem to begin there."""

    def __init__(self, text: str, at: int) -> None:
        self.text, self.lines = text, []
        m = LETTERS.match(text, at)
        while m:
            self.lines.append(m.span())
            gap = LINE_BREAK.match(text, m.end())
            m = gap and LETTERS.match(text, gap.end())
        self.first = [0]  # number of the first letter of each line
        for a, b in self.lines:
            self.first.append(self.first[-1] + b - a)
        self.letters = "".join(text[a:b] for a, b in self.lines).replace("-", "+").replace("_", "/")
        self.decoded: dict[int, bytes] = {}
        self.inner: dict[int, tuple[list, list]] = {}

    def number(self, at: int) -> int | None:
        """The number of the letter at ``at`` in the text."""
        line = bisect_right(self.lines, (at, len(self.text))) - 1
        if line < 0 or at >= self.lines[line][1]:
            return None
        return self.first[line] + at - self.lines[line][0]

    def bytes_from(self, letter: int) -> tuple[bytes, int]:
        """(what the letters encode, and where in it what ``letter`` begins is)"""
        shift = letter % 4
        if shift not in self.decoded:
            letters = self.letters[shift:]
            rest = {2: letters[-2:] + "==", 3: letters[-3:] + "="}.get(len(letters) % 4, "")
            self.decoded[shift] = base64.b64decode(letters[: len(letters) // 4 * 4] + rest)
        return self.decoded[shift], (letter - shift) // 4 * 3

    def pem(self, letter: int) -> tuple[list, list]:
        """(keys, ends of PEM texts) in the text that the letters encode, from that beginning on."""
        data, at = self.bytes_from(letter)
        shift = letter % 4
        if shift not in self.inner:
            inner = data.decode("latin-1")
            self.inner[shift] = keys(inner, nested=False), [m.end() for m in PEM_END.finditer(inner)]
        found, ends = self.inner[shift]
        return [k for k in found if k[1] >= at], [e for e in ends if e > at]

    def end(self, letter: int, size: int, whole: bool) -> int | None:
        """Where ``size`` bytes encoded from ``letter`` on end in the text; None if a line must end there
        and doesn't."""
        last = letter + -(-size * 4 // 3)
        if last > self.first[-1]:
            return None
        line = bisect_right(self.first, last - 1) - 1
        a, b = self.lines[line]
        at = a + last - self.first[line]
        if whole and at < b:
            return None
        return at + len(PADDING.match(self.text, at)[0])


def keys(text: str, nested: bool = True) -> list[tuple[str, int, int]]:
    """Encoded keys that begin anywhere in a run of letters, in lines joined in any of the known ways;
    with ``nested`` also keys in encoded PEM files."""
    found, at, run = [], 0, None
    while m := KEY_START.search(text, at):
        start, at = m.start(), m.start() + 1
        letter = None if run is None else run.number(start)
        if letter is None:
            run, letter = _Run(text, start), 0
        data, place = run.bytes_from(letter)
        kind = end = None
        if m[0][0] == "M":
            size = der_size(data[place : place + 6])
            if not size or size > KEY_BYTES or -(-size * 4 // 3) < KEY_LETTERS:
                continue
            length = data[place + 1]
            if data[(first := place + 2 + (length & 0x7F if length & 0x80 else 0)) : first + 1] not in KEY_PARTS:
                continue
            if (end := run.end(letter, size, True)) is not None:
                kind = key_kind(data[place : place + size])
        elif m[0][0] == "b":
            if data.startswith(OPENSSH, place) and (size := openssh_size(data[place : place + KEY_BYTES])) is not None:
                kind, end = "openssh_key", run.end(letter, size, True)
        elif nested:
            inside, ends = run.pem(letter)
            if inside:
                kind, end = inside[0][0], run.end(letter, max([k[2] for k in inside] + ends) - place, False)
        if kind and end:
            found.append((kind, start, end))
            at = end
    return found


def signed_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of three parts with dots between them, the first of which begins like a JSON object."""
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        at, i = m.start(), 0
        while i + 2 < len(parts):
            begin = parts[i].find("eyJ")
            if 0 <= begin <= len(parts[i]) - 11 and len(parts[i + 1]) >= 2:
                size = sum(map(len, parts[i : i + 3])) + 2
                if signed_token(text[at + begin : at + size]):
                    yield at + begin, at + size
                at, i = at + size + 1, i + 3
            else:
                at, i = at + len(parts[i]) + 1, i + 1


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret of ``text``, by start, then by kind."""
    if not text:
        return []
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    found += keys(text)
    for m in HEX_RUN.finditer(text):
        if m[0].startswith("30") and len(m[0]) % 2 == 0 and (kind := key_kind(bytes.fromhex(m[0]))):
            found.append((kind, *m.span()))
    if "eyJ" in text:
        found += [("signed_token", *span) for span in signed_tokens(text)]
    rank = KINDS.index
    return sorted(set(found), key=lambda s: (s[1], rank(s[0]), s[2]))


def redact(text: str | None) -> str | None:
    """``text`` with each stretch of secrets replaced by a mark that names its first kind."""
    if not text or not (found := spans(text)):
        return text
    out, at = [], 0
    stretch: list = []
    for kind, start, end in [*found, ("", len(text) + 1, len(text) + 1)]:
        if stretch and start < stretch[2]:
            stretch[2] = max(stretch[2], end)
            continue
        if stretch:
            out += [text[at : stretch[1]], f"[{stretch[0]} removed]"]
            at = stretch[2]
        stretch = [kind, start, end]
    return "".join([*out, text[at:]])


def scanned(
    df: DataFrame, text: str = "text", into: str = "secrets", redacted: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """``df`` (or its columns ``keep``) with the spans of ``text``; ``redacted`` names a column for
    the text without them, which may be ``text`` itself."""
    made = [into] + ([redacted] if redacted else [])
    names = [c for c in (df.columns if keep is None else keep) if c not in made]
    fields = [df.schema[c] for c in names] + [T.StructField(into, SCHEMA)]
    if redacted:
        fields.append(T.StructField(redacted, T.StringType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = part[text].to_pylist()
                rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in texts]
                columns = [*[part[c] for c in names], pa.array(rows, ARROW)]
                if redacted:
                    columns.append(pa.array([redact(t) if r else t for t, r in zip(texts, rows, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names + made)

    columns = list(dict.fromkeys([*names, text]))
    return df.select(*[f"`{c}`" for c in columns]).mapInArrow(task, T.StructType(fields))
