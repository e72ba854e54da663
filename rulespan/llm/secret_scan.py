"""Secret scans with structural confirmation.

Patterns propose; structure confirms. Assignments, access ids and hex runs are reported as
matched (the base kinds). Three further kinds are reported only if their content parses:
a signed token's header must be base64url JSON naming an algorithm, a PEM block's body must
decode to a private key's encoding (or, where its headers say so, to whole cipher blocks),
and a base64 or hex key must decode to DER whose nested lengths all fit exactly.

A base64 or hex key may begin anywhere in a run of its characters and go on over white space
and escaped line breaks: its own outer length says how many characters belong to it. Kinds
are found independently, so a key in PEM armour is listed as pem and as der64.

Defined results: a null text is empty and has no spans; rows are scanned one by one, so
repeated rows repeat their result and a null doc_id stays null; other columns pass through
redact() and are ignored by report(). Offsets are code points, ends exclusive. Whole texts
are scanned, whatever their length.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame

from .common import map_rows

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A whole run of token characters before a dot, and what must follow that dot.
SEGMENT = re.compile(r"[A-Za-z0-9_-]++(?=\.)")
FOLLOWING = re.compile(r"\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)+")
JSON_MARK = re.compile(rb'"(?:[^"\\]|\\.)*+"|[{}\[\]]', re.S)
DEPTH = 16  # levels of a token's header or of a key's encoding; what nests deeper is neither
BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
PEM_HEADERS = re.compile(r"\s*(?:[A-Za-z][A-Za-z0-9-]*:[^\n]*(?:\n|\Z)\s*)+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
LEAST = 40  # base64 characters of a key
#: What may part the characters of one key: white space, escaped line breaks, the backslash of \/ and of a continued line.
_GAP = r"(?:\\+[rn]|\\+(?=[/\r\n])|\s)"
GAP = re.compile(f"{_GAP}+")
PADDING = re.compile(f"(?:{_GAP}*=){{1,2}}")
CLASS64, CLASS16 = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9A-Fa-f]+")
#: 0x30 0x8x, 0x30 short, and "openssh-key-v1" begin with M[A-I] or b3Bl in base64.
START64, START16 = re.compile(f"M{_GAP}*[A-I]|b{_GAP}*3{_GAP}*B{_GAP}*l"), re.compile(f"3{_GAP}*0")
MAGIC = b"openssh-key-v1\0"
#: Encryption schemes of PKCS 5 and PKCS 12.
SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: In the order in which spans that start together are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "signed", "pem", "der64", "derhex")


def _der(data: bytes, depth: int = 0) -> list[tuple[int, int]] | None:
    """(tag, length) of each element if data is a whole number of DER elements, nested lengths included."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or data[at] & 31 == 31:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n >= 128:
            k = n & 127
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n = int.from_bytes(data[at : at + k], "big")
            if n < 128 or data[at] == 0:
                return None
            at += k
        if at + n > len(data):
            return None
        if tag & 32 and (depth > DEPTH or _der(data[at : at + n], depth + 1) is None):
            return None
        out.append((tag, n))
        at += n
    return out


def _content(data: bytes) -> bytes:
    """What the first element of checked DER holds."""
    n = data[1]
    at = 2 + (n & 127 if n >= 128 else 0)
    return data[at : at + (n if n < 128 else int.from_bytes(data[2:at], "big"))]


def is_key(data: bytes) -> bool:
    """A private key: OpenSSH's format, or one DER SEQUENCE that begins with a version INTEGER or is an EncryptedPrivateKeyInfo."""
    if data.startswith(MAGIC):
        return True
    if len(data) < 16 or data[0] != 0x30:
        return False
    outer = _der(data)
    if not outer or len(outer) != 1:
        return False
    body = _content(data)
    inner = _der(body, 1)
    if not inner or len(inner) < 2:
        return False
    if [tag for tag, _ in inner] == [0x30, 0x04]:  # an algorithm and the encrypted key
        scheme = _content(body)
        return scheme[:1] == b"\x06" and _content(scheme).startswith(SCHEMES)
    return inner[0][0] == 0x02 and inner[0][1] <= 2


def _der_size(head: bytes) -> int | None:
    """How many bytes the key that begins with these nine has, None if none can."""
    n, at = head[1], 2
    if n >= 128:
        k = n & 127
        if not 1 <= k <= 4:
            return None
        n, at = int.from_bytes(head[2 : 2 + k], "big"), 2 + k
    fits = head[0] == 0x30 and (head[at] == 0x02 and head[at + 1] <= 2 or head[at] == 0x30)
    return at + n if fits else None


def _openssh_size(data: bytes) -> int:
    """Bytes of the OpenSSH key that begins with data, or more than data has, where it says no further."""
    at, left, counted = len(MAGIC), 3, False
    while left or not counted:
        if at + 4 > len(data):
            return at + 4
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if left:
            at, left = at + n, left - 1
        else:
            left, counted = n + 1, True  # public keys, and the private part
    return at


def _taken(text: str, at: int, want: int, kind: re.Pattern) -> tuple[str, int] | None:
    """The next `want` characters of the class, over gaps, and where they end; None if there are fewer."""
    out = []
    while want:
        if m := kind.match(text, at):
            out.append(m[0][:want])
            want -= len(out[-1])
            at += len(out[-1])
        elif g := GAP.match(text, at):
            at = g.end()
        else:
            return None
    return "".join(out), at


def _keys(text: str, start: re.Pattern, kind: re.Pattern, chars, decode, least: int = 0) -> list[tuple[int, int]]:
    """Spans of the keys of `least` characters or more in text; chars(n): how many characters n bytes take."""

    def bytes_at(at: int, n: int) -> tuple[bytes, int] | None:
        got = _taken(text, at, chars(n), kind)
        data = decode(got[0]) if got else None
        return (data[:n], got[1]) if data is not None else None

    out, end = [], 0
    for m in start.finditer(text):
        at = m.start()
        if at < end or not (got := bytes_at(at, 9)):
            continue
        if got[0][0] == 0x30:
            size = _der_size(got[0])
            got = bytes_at(at, size) if size and len(text) - at >= chars(size) else None
        elif MAGIC.startswith(got[0]):
            size = len(MAGIC)
            while size <= len(text) and (got := bytes_at(at, size)) and got[0].startswith(MAGIC) and (more := _openssh_size(got[0])) > size:
                size, got = more, None
        else:
            got = None
        if got and chars(len(got[0])) >= least and is_key(got[0]):
            end = got[1]
            out.append((at, end))
    return out


def _in_base64(text: str) -> list[tuple[int, int]]:
    out = []
    for a, b in _keys(text, START64, CLASS64, lambda n: -(-n * 4 // 3), _b64, LEAST):
        pad = PADDING.match(text, b)
        out.append((a, pad.end() if pad else b))
    if "b3Bl" in text:  # a run that begins as an OpenSSH key and is not laid out as one
        for m in BASE64.finditer(text):
            if m[0].startswith("b3Bl") and not any(a <= m.start() < b for a, b in out) and (_b64(m[0]) or b"").startswith(MAGIC):
                out.append(m.span())
    return out


def _in_pem(body: str) -> bool:
    body = re.sub(r"\\+r", "", re.sub(r"\\+n", "\n", body)).replace("\\/", "/")
    headers = PEM_HEADERS.match(body)
    data = _b64(re.sub(r"\s", "", body[headers.end() :] if headers else body))
    if not data:
        return False
    if headers and re.search(r"Proc-Type:\s*4,\s*ENCRYPTED", headers[0]) and "DEK-Info:" in headers[0]:
        return len(data) % 8 == 0  # whole cipher blocks
    return is_key(data)


def _b64(text: str) -> bytes | None:
    text = text.translate({45: "+", 95: "/"}).rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return None


def _header_end(data: bytes, at: int) -> int | None:
    """Where the JSON object that begins at data[at] closes; None if it doesn't or nests too deep."""
    depth = 0
    for m in JSON_MARK.finditer(data, at):
        if (c := m[0]) in b"{[":
            depth += 1
            if depth > DEPTH:
                return None
        elif c in b"}]":
            depth -= 1
            if not depth:
                return m.end()
    return None


def is_header(data: bytes, at: int = 0) -> bool:
    """data[at:] is a JSON object that names an algorithm."""
    end = _header_end(data, at)
    if end is None or data[end:].strip(b" \t\r\n"):
        return False
    try:
        header = json.loads(data[at:])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def _signed(text: str) -> list[tuple[int, int]]:
    """Tokens whose header parses, from every place that can begin one.

    A run of token characters is decoded once for each of four alignments. A start is given
    up where its JSON closes early or nests too deep, so a run of starts costs its length.
    """
    out, at = [], text.find("eyJ")
    while at >= 0 and (m := SEGMENT.search(text, at)):
        run, first, found = m[0], m.start(), None
        if run.find("eyJ") >= 0 and (after := FOLLOWING.match(text, m.end())):
            decoded: dict[int, bytes | None] = {}
            k = run.find("eyJ")
            while k >= 0 and not found:
                c = k % 4
                if c not in decoded:
                    decoded[c] = _b64(run[c:])
                if (data := decoded[c]) and is_header(data, (k - c) // 4 * 3):
                    found = first + k, after.end()
                k = run.find("eyJ", k + 3)
        if found:
            out.append(found)
        at = text.find("eyJ", found[1] if found else m.end())
    return out


def _pems(text: str) -> list[tuple[int, int]]:
    """Private keys in armour; a block ends at the next dashes or is none."""
    out, at = [], 0
    while m := BEGIN.search(text, at):
        at, dashes = m.end(), text.find("-----", m.end())
        if dashes >= 0 and text.startswith(close := f"-----END {m[1]}-----", dashes) and _in_pem(text[m.end() : dashes]):
            at = dashes + len(close)
            out.append((m.start(), at))
    return out


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, index in KINDS, end), sorted."""
    if not text:
        return []
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "eyJ" in text:
        out += [(a, 3, b) for a, b in _signed(text)]
    if "-----BEGIN" in text:
        out += [(a, 4, b) for a, b in _pems(text)]
    out += [(a, 5, b) for a, b in _in_base64(text)]
    out += [(a, 6, b) for a, b in _keys(text, START16, CLASS16, lambda n: 2 * n, bytes.fromhex)]
    return sorted(out)


def listed(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def report(docs: DataFrame) -> DataFrame:
    """The digest of query op10_secret_scan: one row a document, no shuffle."""

    def rows(ids, texts):
        for i, t in zip(ids, texts):
            found = spans(t)
            n = [sum(1 for x in found if x[1] == k) for k in range(3)]
            yield i, *n, hashlib.sha256(listed([x for x in found if x[1] < 3]).encode()).hexdigest(), listed(found)

    return map_rows(docs.select("doc_id", "text"), rows, {"doc_id": "long", "n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string"})


def redacted(text: str | None) -> str | None:
    """text with every span, overlapping ones merged, replaced by <secret>."""
    if not (found := spans(text)):
        return text
    out, at, end = [], 0, 0
    for a, _, b in found:
        if a >= end:
            out += [text[at:a], "<secret>"] if a > end or not out else []
            at = b
        end = max(end, b)
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs, same columns and order, with secrets in text_col replaced and length_col set to the new length."""
    names = docs.columns
    at = names.index(text_col)
    to = names.index(length_col) if length_col in names else None

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols = list(b.columns)
            texts = cols[at].to_pylist()
            new = [redacted(t) for t in texts]
            cols[at] = pa.array(new, cols[at].type)
            if to is not None:
                old = cols[to].to_pylist()
                cols[to] = pa.array([n if a is b_ or a is None else len(b_) for n, a, b_ in zip(old, texts, new)], cols[to].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)
