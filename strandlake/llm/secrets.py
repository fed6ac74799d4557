"""Secrets in texts, confirmed by decoding what looks encoded."""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame

from .common import plus, with_text

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*)-----((?:[^-]|-(?!----))*+)-----END \1-----")
#: What string literals write for a character: line ends and tabs, slashes, code points; also a line end after a backslash.
ESCAPE = re.compile(r"\\+(?:u00([0-9A-Fa-f]{2})|([nrt])|(/)|\r?\n)")
HEADERS = re.compile(r"\s*((?:[A-Za-z][A-Za-z0-9-]*:[^\n]*\n(?:[ \t]+\S[^\n]*\n)*)+)")
LOCKED = re.compile(r"Proc-Type:\s*4\s*,\s*ENCRYPTED\s.*DEK-Info:\s*([A-Za-z0-9-]+)\s*,\s*([0-9A-Fa-f]+)\s", re.S)
CODED = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
#: Coded text over lines, whose ends may be escaped.
BREAK = r"[ \t]*(?:\r?\n|(?:\\+r)?\\+n)[ \t]*"
WRAPPED = re.compile(rf"[A-Za-z0-9+/_-]+(?:{BREAK}[A-Za-z0-9+/_-]+)*+")
BLANK = " \t\r\n\\"
LINE = re.compile(rf"[A-Za-z0-9+/_-]+|{BREAK}")
#: How base64 of a DER sequence and of the other form's name begins; what a DER key's first bytes are; base64 of "-----BEGIN " at each of three places.
START = re.compile(r"M(?:[A-H]|I[E-T])|b3BlbnNzaC1rZXktdjEA")
HEAD = re.compile(rb"0(?:[\0-\x7f]|\x81.|\x82..|\x83...|\x84....)(?:\x02\x01[\0\1]|0(?:[\0-\x7f]|\x81.|\x82..)\x06.\*\x86H\x86\xf7\r\x01(?:\x05|\x0c\x01))", re.S)
#: The object identifiers of password-based encryption, 1.2.840.113549.1.5 and 1.2.840.113549.1.12.1.
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
ARMOUR_CODED = re.compile(r"LS0tLS1CRUdJTi|0tLS0tQkVHSU4g|tLS0tLUJFR0lOI")
ANY_HEX = re.compile(r"(?:[0-9A-Fa-f]{2}){24,}")
KINDS = ("assign", "access", "hex", "signed", "armour", "key")


def tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, content start and content end of the element at ``at`` in DER, None if its length is not minimal or leaves the parent."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill [at, end) exactly, None if they don't."""
    out = []
    while at < end:
        e = tlv(data, at, end)
        if e is None:
            return None
        out.append(e)
        at = e[2]
    return out


def sound(data: bytes, parts: list[tuple[int, int, int]], depth: int = 16) -> bool:
    """Whether the lengths of all elements nested in ``parts`` come out even, ``depth`` levels down at most."""
    for tag, at, end in parts:
        if tag & 0x20:
            inner = children(data, at, end) if depth else None
            if inner is None or not sound(data, inner, depth - 1):
                return False
    return True


def algorithm(data: bytes, part: tuple[int, int, int]) -> bytes:
    """The object identifier that an algorithm's element begins with, b"" for none."""
    inner = children(data, *part[1:])
    return data[inner[0][1] : inner[0][2]] if inner and inner[0][0] == 0x06 and inner[0][2] - inner[0][1] >= 2 else b""


def der_key(data: bytes) -> str:
    """The kind of key that ``data`` encodes in DER, "" for none; every nested length must come out even. What holds an algorithm and a string of bytes is an encrypted key only if the algorithm is password-based encryption, not a digest or a signature."""
    top = tlv(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data):
        return ""
    parts = children(data, *top[1:])
    if not parts or not sound(data, parts):
        return ""
    tags = [p[0] for p in parts]
    version = data[parts[0][1] : parts[0][2]] if tags[0] == 0x02 else None
    if version in (b"\0", b"\1") and tags[:9] == [0x02] * 9 and tags[9:] in ([], [0x30]) and all(p[2] > p[1] for p in parts[:9]):
        return "rsa"
    if version == b"\0" and tags == [0x02] * 6 and all(p[2] > p[1] for p in parts):
        return "dsa"
    if version in (b"\0", b"\1") and tags[1:3] == [0x30, 0x04] and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:]):
        # The string of bytes is the key's own element: a sequence, a number or a string of bytes.
        own = tlv(data, *parts[2][1:])
        return "pkcs8" if algorithm(data, parts[1]) and own and own[0] in (0x30, 0x02, 0x04) and own[2] == parts[2][2] and sound(data, [own]) else ""
    if version == b"\1" and tags[1:2] == [0x04] and parts[1][2] > parts[1][1] and all(t in (0xA0, 0xA1) for t in tags[2:]) and all(children(data, *p[1:]) for p in parts[2:]):
        return "ec"
    if tags == [0x30, 0x04]:
        return "encrypted" if algorithm(data, parts[0]).startswith(PASSWORD_BASED) else ""
    return ""


def ssh_end(data: bytes) -> int:
    """Where a private key in the form that begins with its name ends, whose four leading strings have lengths that fit; 0 for none."""
    magic = b"openssh-key-v1\0"
    if data[: len(magic)] != magic:
        return 0
    at = len(magic)
    for _ in range(3):
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        if at > len(data):
            return 0
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    for _ in range(min(keys, 64) + 1):
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
    return at if 1 <= keys <= 64 and at <= len(data) else 0


def ssh_key(data: bytes) -> str:
    """"ssh" if ``data`` is a key of that form and no more."""
    return "ssh" if data and ssh_end(data) == len(data) else ""


def decode64(text: str) -> bytes:
    """What ``text`` stands for in either base64 alphabet, b"" if it can't be right."""
    text = text.rstrip("=")
    if len(text) % 4 == 1 or re.search(r"[+/]", text) and re.search(r"[_-]", text):
        return b""
    try:
        return base64.b64decode(text.replace("-", "+").replace("_", "/") + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return b""


def signed_header(text: str) -> bool:
    """Whether ``text`` is a signed token's header: a JSON object that names an algorithm."""
    try:
        header = json.loads(decode64(text))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def unescaped(text: str) -> str:
    """``text`` with what string literals escape within coded text put back."""
    return ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else {"n": "\n", "r": "\r", "t": "\t"}[m[2]] if m[2] else m[3] or "\n", text)


def armoured_key(label: str, body: str) -> bool:
    """Whether an armoured block holds a private key, bare or in a string literal; of one locked by a pass phrase, which can't be read, the headers and the whole number of cipher blocks tell."""
    body = unescaped(body)
    headers = HEADERS.match(body)
    data = decode64(re.sub(r"\s", "", body[headers.end() :] if headers else body))
    if der_key(data) or ssh_key(data):
        return True
    locked = headers and label.endswith("PRIVATE KEY") and LOCKED.search(headers[1])
    return bool(locked and data and (not locked[1].upper().endswith("CBC") or len(locked[2]) in (16, 32) and len(data) % (len(locked[2]) // 2) == 0))


def loose64(text: str) -> bytes:
    """What ``text`` without padding stands for in either alphabet or both, but for a last character that is too much."""
    text = text[: len(text) - (len(text) % 4 == 1)]
    return base64.b64decode(text.replace("-", "+").replace("_", "/") + "=" * (-len(text) % 4))


class Coded:
    """The bytes that base64 text stands for from character ``at`` on (``size`` of them, by default all), decoded only where they are looked at: what a key's first lengths rule out costs no more than these."""

    def __init__(self, text: str, at: int, size: int | None = None):
        n = len(text) - at
        self.text, self.at, self.size = text, at, (n - (n % 4 == 1)) * 3 // 4 if size is None else size
        self.first, self.block = 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int | slice):
        if isinstance(i, slice):
            a, b, _ = i.indices(self.size)
            first = a // 3
            return loose64(self.text[self.at + first * 4 : self.at - (-b // 3 * 4)])[a - first * 3 : b - first * 3] if a < b else b""
        if not 0 <= i < self.size:
            raise IndexError(i)
        if not self.first <= i < self.first + len(self.block):
            self.first = i - i % 3
            self.block = self[self.first : self.first + 96]
        return self.block[i - self.first]


def coded_keys(text: str, region: re.Match) -> list[tuple[int, int]]:
    """Spans of the private keys within a region of base64 lines, wherever they begin: in DER, by name, or as an armoured block that is itself coded. Candidates are read length by length; only a key is decoded whole."""
    lines = [x for x in LINE.finditer(text, region.start(), region.end()) if x[0][0] not in BLANK]
    begins = list(accumulate((len(x[0]) for x in lines), initial=0))
    bare = "".join(x[0] for x in lines)

    def place(n: int) -> int:
        """Where in ``text`` the coded character ``n`` is."""
        k = bisect_right(begins, n) - 1
        return lines[k].start() + n - begins[k]

    spans, end = [], 0
    for s in START.finditer(bare):
        at, named = s.start(), s[0][0] == "b"
        if at < end or at and not named and not HEAD.match(loose64(bare[at : at + 36])):
            continue
        data = Coded(bare, at)
        top = None if named else tlv(data, 0, len(data))
        n = ssh_end(data) if named else top[2] if top else 0
        to = at - (-n * 4 // 3)
        if n and (named or der_key(Coded(bare, at, n))) and decode64(bare[at:to]):
            spans.append((at, to))
            end = to
    if ARMOUR_CODED.search(bare):
        for skip in range(4):
            data = loose64(bare[skip:]).decode("latin-1")
            for m in ARMOUR.finditer(data) if "-----BEGIN " in data else ():
                if armoured_key(m[1], m[2]):
                    spans.append((skip + m.start() // 3 * 4, min(skip - (-m.end() // 3 * 4), len(bare))))
    out = []
    for a, b in sorted(spans):
        last = place(b - 1) + 1
        out.append((place(a), last + len(re.match("={0,2}", text[last : last + 2])[0])))
    return out


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then as kinds are listed in ``KINDS``.

    The first three kinds are patterns; those below are reported only once decoded: signed tokens by their header and
    payload, armoured blocks and bare base64 or hex by the key that they encode.
    """
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            found.append(("assign", *m.span()))
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    taken: list[tuple[int, int]] = []
    if "." in text and ("ey" in text or "ew" in text):
        for m in SIGNED.finditer(text):
            if signed_header(m[1]) and decode64(m[2]) and (not m[3] or decode64(m[3])):
                found.append(("signed", *m.span()))
                taken.append(m.span())
    if "-----BEGIN " in text:
        for m in ARMOUR.finditer(text):
            if armoured_key(m[1], m[2]):
                found.append(("armour", *m.span()))
                taken.append(m.span())
    # Starts in order with the farthest end so far, so that one search says whether a place is in any of them.
    taken.sort()
    starts, ends = [x for x, _ in taken], list(accumulate((y for _, y in taken), max))
    free = lambda a: not (k := bisect_right(starts, a)) or a >= ends[k - 1]
    end = 0
    while m := CODED.search(text, end):
        region = WRAPPED.match(text, m.start())
        found += [("key", a, b) for a, b in coded_keys(text, region) if free(a)]
        end = region.end()
    for m in ANY_HEX.finditer(text):
        data = bytes.fromhex(m[0]) if m[0][:2] in ("30", "6f", "6F") else b""
        if der_key(data) or ssh_key(data):
            found.append(("key", *m.span()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with ``secrets`` (array of kind, start, end; code points, end exclusive).

    A narrow plan: each text is read once where it lies and nothing is dealt out; a very long text is scanned whole, in the
    memory of one task. Null or empty text: an empty array. Spans that begin together are ordered by kind and then end.
    Repeated rows are scanned each. Columns of other names pass through; ``secrets`` is replaced. Empty table: empty.
    """

    def scan(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def make(texts):
            return {"secrets": pa.array([[dict(zip(("kind", "start", "end"), x)) for x in find_secrets((t or b"").decode())] for t in texts], kind)}

        yield from with_text(batches, make)

    return docs.mapInArrow(scan, plus(docs, "secrets array<struct<kind: string, start: long, end: long>>"))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts and digest of the base kinds, and all spans."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    said = "concat_ws(',', transform({}, x -> concat_ws(':', x.kind, x.start, x.end)))"
    base = "filter(secrets, x -> x.kind in ('assign', 'access', 'hex'))"
    return scan_secrets(docs).select(
        "doc_id",
        *(F.expr(f"cast(size(filter(secrets, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.expr(said.format(base)), 256).alias("base_sha256"),
        F.expr(said.format("secrets")).alias("spans"),
    )
