"""Secret scans with a recursive decoding worklist.

The text is the first layer. Every layer is scanned for the three kinds of secrets, then decoded: percent escapes and
escaped code points (\\uXXXX, \\UXXXXXXXX, \\u{X}, \\xXX, %uXXXX, &#N;, &#xX;) give the whole layer with these decoded. A base64 run (either alphabet) is decoded from
each of its first four characters, as a path or name may stand before the payload; every readable part of what comes out
is a layer. Base64 in lines is joined first. Compressed data (gzip, zlib, bzip2, xz) is looked for at every byte of decoded base64 and escapes; members that
follow one another are all read. UTF-16 within a layer gives a layer. New layers join the worklist until none is left; a
layer seen before isn't scanned again, so cycles end. Each character of a layer knows the span of the text it came from,
and spans found in a layer are mapped back through it.

Each compressed region is read once, and nothing calls itself, so no nesting is too deep. Decompression, nested too, runs through windows of WINDOW bytes that overlap by OVERLAP bytes; each is a layer, so memory
stays bounded and nothing is left out.

Defined results: null and empty texts have no secrets; repeated rows each get their result; spans are in code points, end
exclusive, of equal spans of one kind one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import documents

WINDOW, OVERLAP = 1 << 22, 1 << 12
KINDS = ("assign", "access", "hex")
#: Fixed values of the contract. Runs are maximal, so the least lengths of access and hex stand in the pattern.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
#: One of these is in each match of ASSIGN.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: Escapes of code points: of programming languages, of URLs and of markup.
CODES = re.compile(r"\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|\\[ux]\{[0-9A-Fa-f]{1,6}\}|%u[0-9A-Fa-f]{4}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 in lines (as mail and certificates have it), the ends of lines as they are or escaped.
LINE_END = r"(?:\r?\n|\\r\\n|\\n)"
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{{4,}}+{LINE_END})+[A-Za-z0-9+/_-]++={{0,2}}")
LINE_END = re.compile(LINE_END)
#: Escapes of single bytes, as quoted byte strings have them.
BYTES = re.compile(r"\\x[0-9A-Fa-f]{2}|\\[ntr0\\'\"]")
#: No secret, nor what encodes one, is shorter than 16 characters of ASCII (UTF-16 has a NUL beside each).
READABLE = re.compile(rb"[\x00\t\n\r\x20-\x7e]{16,}")
LITTLE, BIG = re.compile(r"(?:[\t\n\r\x20-\x7e]\x00){16,}"), re.compile(r"(?:\x00[\t\n\r\x20-\x7e]){16,}")


def scan(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans."""
    low, out = t.lower(), []
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in t:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(t)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(t)]
    out.sort()
    return out


class Layer:
    """A text whose character i came from start[i] to end[i] of the original (None: it is the original).

    Layers that only join lines are decoded, but not scanned.
    """

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None, joined: bool = False):
        self.text, self.start, self.end, self.joined = text, start, end, joined

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Of the original, for characters a to b."""
        return (a, b) if self.start is None else (int(self.start[a:b].min()), int(self.end[a:b].max()))


def replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with matches decoded (decode gives the new text, and where in the match each character begins and ends)."""
    texts, starts, ends, at, changed = [], [], [], 0, False
    s = np.arange(len(layer.text)) if layer.start is None else layer.start
    e = s + 1 if layer.end is None else layer.end
    for m in pattern.finditer(layer.text):
        got = decode(m[0])
        if got is None:
            continue
        new, lo, hi = got
        changed = True
        texts += [layer.text[at : m.start()], new]
        starts += [s[at : m.start()], s[m.start() + np.asarray(lo, int)]]
        ends += [e[at : m.start()], e[m.start() + np.asarray(hi, int) - 1]]
        at = m.end()
    if not changed:
        return None
    return Layer("".join([*texts, layer.text[at:]]), np.concatenate([*starts, s[at:]]), np.concatenate([*ends, e[at:]]))


def percent(t: str):
    data = bytes.fromhex(t.replace("%", ""))
    try:
        new = data.decode()
    except UnicodeDecodeError:
        new = data.decode("latin-1")
        return new, [3 * i for i in range(len(new))], [3 * i + 3 for i in range(len(new))]
    width = np.cumsum([0, *(len(c.encode()) for c in new)]) * 3
    return new, width[:-1], width[1:]


def percent_bytes(t: str):
    n = len(t) // 3
    return bytes.fromhex(t.replace("%", "")).decode("latin-1"), [3 * i for i in range(n)], [3 * i + 3 for i in range(n)]


def backslash_byte(t: str):
    return chr(int(t[2:], 16)) if t[1] == "x" else {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(t[1], t[1]), [0], [len(t)]


def code_point(t: str):
    c = int(t[2:-1]) if t[:2] == "&#" and t[2] not in "xX" else int(t.strip("\\%&#uUxX{};"), 16)
    return None if 0xD800 <= c < 0xE000 or c > 0x10FFFF else (chr(c), [0], [len(t)])


#: First bytes of compressed data.
MAGIC = {b"\x1f\x8b": lambda: zlib.decompressobj(31), b"\x78\x01": zlib.decompressobj, b"\x78\x5e": zlib.decompressobj, b"\x78\x9c": zlib.decompressobj, b"\x78\xda": zlib.decompressobj, b"BZh": bz2.BZ2Decompressor, b"\xfd7zXZ\x00": lzma.LZMADecompressor}


HEADS = re.compile(b"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")


def packed(data):
    """What decompresses the data, or None."""
    head = bytes(data[:6])
    return next((make for magic, make in MAGIC.items() if head.startswith(magic)), None)


class Members:
    """Decompresses members that follow one another, chunk by chunk."""

    def __init__(self):
        self.d, self.rest, self.fed, self.end, self.done = None, b"", 0, None, False

    def push(self, chunk: bytes) -> Iterator[bytes]:
        """What a chunk gives, in pieces of up to WINDOW bytes; `end` is where the last whole member ended."""
        self.fed += len(chunk)
        rest, self.rest = self.rest + bytes(chunk), b""
        try:
            while not self.done:
                if self.d is None:
                    rest = rest.lstrip(b"\0") if self.end is not None else rest  # padding between members
                    if len(rest) < 6:
                        self.rest = rest
                        return
                    if not (make := packed(rest)):
                        self.done = True
                        return
                    self.d = make()
                if got := self.d.decompress(rest, WINDOW):
                    yield got
                if self.d.eof:
                    rest, self.d = self.d.unused_data, None
                    self.end = self.fed - len(rest)
                    continue
                rest = getattr(self.d, "unconsumed_tail", b"")
                if not got and not rest:
                    return
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            self.done = True


#: A deflated stream keeps what it can't compress in blocks of up to BLOCK bytes, with five bytes before each: the last four
#: are its length, and the length inverted.
BLOCK, BETWEEN = 65535, 5


def copied(piece: bytes, source: bytes) -> tuple[int, int]:
    """How much of a piece's beginning stands in its source as it is, and in how many such blocks."""
    i, at, blocks = source.find(piece[:64], 4, 160), 0, 0
    while i >= 4 and at < len(piece):
        size = int.from_bytes(source[i - 4 : i - 2], "little")
        if size ^ BLOCK != int.from_bytes(source[i - 2 : i], "little") or source[i : i + size][: len(piece) - at] != piece[at : at + size]:
            break
        at += size
        i += size + BETWEEN
        blocks += 1
    return min(at, len(piece)), blocks


def unpacked(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Overlapping windows of decompressed data, and of what is compressed in it (from its beginning on), at any depth.

    The depths are a list of what decompresses each, so no depth is too large. What a depth only copies from the one above
    gives no window of its own.
    """
    depths, tails, seen = [Members()], [b""], set()
    for chunk in chunks:
        todo, above = [depths[0].push(chunk)], [chunk]
        while todo:
            piece, at = next(todo[-1], None), len(todo) - 1
            if piece is None:
                todo.pop()
                above.pop()
                continue
            first = not tails[at]
            if first and at:
                key = xxhash.xxh3_128_digest(above[-1])  # a depth that is given what an outer one was given is a cycle
                if key in seen:
                    depths[at].done = True
                    continue
                seen.add(key)
            window = tails[at] + piece
            tails[at] = window[-OVERLAP:]
            if copied(piece, above[-1])[0] < len(piece):
                yield window
            if first and len(depths) == at + 1 and packed(piece):
                depths.append(Members())
                tails.append(b"")
            if len(depths) > at + 1 and not depths[at + 1].done:
                todo.append(depths[at + 1].push(piece))
                above.append(piece)
        if depths[0].done:
            return


def portions(data: bytes, at: int) -> Iterator[bytes]:
    """Data from a place on: a little first, as most of what looks like a head isn't one."""
    yield data[at : at + 256]
    for a in range(at + 256, len(data), 1 << 16):
        yield data[a : a + (1 << 16)]


def extent(data: bytes, at: int) -> tuple[int, int | None, int, int]:
    """Of the stream that begins there: how many bytes it gives, where its last whole member ends (None: it breaks off), and
    how many of the first bytes it only copies from the data, and in how many blocks."""
    members, first, size = Members(), b"", 0
    for chunk in portions(data, at):
        for piece in members.push(chunk):
            if len(first) < 4 * BLOCK:
                first += piece
            size += len(piece)
        if members.done:
            break
    return size, members.end, *(copied(first, data[at : at + len(first) + len(first) // 64 + 512]) if first else (0, 0))


def later(data: bytes, at: int, skip: int) -> Iterator[bytes]:
    """Windows of what a stream gives after its first bytes."""
    members, tail = Members(), b""
    for chunk in portions(data, at):
        for piece in members.push(chunk):
            if (skip := skip - len(piece)) < 0:
                window = tail + piece[max(0, len(piece) + skip - OVERLAP) if not tail else 0 :]
                tail = window[-OVERLAP:]
                yield window


def within(data: bytes, a: np.ndarray, b: np.ndarray) -> Iterator[Layer]:
    """Layers of the compressed data in bytes that came from a[i] to b[i] of the original.

    A compressed region is read once: after members that end well, heads are looked for behind them. What a stream only copies
    is passed over, as it is found in the data itself: a stream that gives nothing else is none, and heads are looked for in it.
    """
    latest, at = np.maximum.accumulate(b), 0
    while m := HEADS.search(data, at):
        start, at = m.start(), m.start() + 1
        size, ended, same, blocks = extent(data, start)
        if size == same and (blocks <= 1 or ended is None):
            continue
        end = latest[-1] if ended is None else latest[start + ended - 1]
        for p in unpacked(portions(data, start)) if ended is not None or not same else later(data, start, same):
            t = p.decode("utf-8", "replace")
            yield Layer(t, np.broadcast_to(a[start], len(t)), np.broadcast_to(end, len(t)))
        if ended is not None and not same:
            at = start + ended


def from_base64(layer: Layer):
    for m in BASE64.finditer(layer.text):
        run = m[0].rstrip("=").replace("-", "+").replace("_", "/")
        for phase in range(4):
            body = run[phase:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            data = base64.b64decode(body + "=" * (-len(body) % 4))
            readable, heads = list(READABLE.finditer(data)), HEADS.search(data)
            if not readable and not heads:
                continue
            at = np.arange(len(data) + 1)
            lo, hi = m.start() + phase + at[:-1] * 8 // 6, np.minimum(m.start() + phase + -(-at[1:] * 8 // 6), m.end())
            if layer.start is not None:
                lo, hi = layer.start[lo], layer.end[hi - 1]
            for r in readable:
                yield Layer(r[0].decode("ascii"), lo[r.start() : r.end()], hi[r.start() : r.end()])
            if heads:
                whole = hi.copy()
                whole[-1] = layer.span(m.start(), m.end())[1]
                yield from within(data, lo, whole)


def from_escapes(layer: Layer, pattern: re.Pattern, decode):
    """Layers of the compressed data that single escaped bytes (and the characters between them) make."""
    raw = replaced(layer, pattern, decode)
    if raw is not None and HEADS.search(data := raw.text.encode("latin-1", "replace")):
        yield from within(data, raw.start, raw.end)


def from_utf16(layer: Layer):
    if layer.start is None:
        layer = Layer(layer.text, at := np.arange(len(layer.text)), at + 1)
    little, big = list(LITTLE.finditer(layer.text)), list(BIG.finditer(layer.text))
    ends, starts = {m.start(): m.end() for m in little}, {m.start(): m.end() for m in big}
    # either order fits all but the outermost characters of the other; the longer reading is the right one
    for m in little:
        if starts.get(m.start() - 1, 0) <= m.end():
            yield Layer(m[0][::2], layer.start[m.start() : m.end() : 2], layer.end[m.start() + 1 : m.end() : 2])
    for m in big:
        if ends.get(m.start() - 1, 0) < m.end():
            yield Layer(m[0][1::2], layer.start[m.start() : m.end() : 2], layer.end[m.start() + 1 : m.end() : 2])


def from_lines(layer: Layer) -> Iterator[Layer]:
    """Wrapped base64 with its lines joined."""
    for m in WRAPPED.finditer(layer.text):
        keep = np.ones(m.end() - m.start(), bool)
        for x in LINE_END.finditer(m[0]):
            keep[x.start() : x.end()] = False
        at = m.start() + np.flatnonzero(keep)
        start, end = (at, at + 1) if layer.start is None else (layer.start[at], layer.end[at])
        yield Layer(LINE_END.sub("", m[0]), start, end, joined=True)


def decoded(layer: Layer) -> Iterator[Layer]:
    """The layers right below a layer, one at a time."""
    whole = []
    if "%" in layer.text:
        whole.append((PERCENT, percent))
        yield from from_escapes(layer, PERCENT, percent_bytes)
    if "\\" in layer.text or "%u" in layer.text or "&#" in layer.text:
        whole.append((CODES, code_point))
    if "\\" in layer.text:
        yield from from_escapes(layer, BYTES, backslash_byte)
    for pattern, decode in whole:
        if (new := replaced(layer, pattern, decode)) is not None:
            yield new
    if "\0" in layer.text:
        yield from from_utf16(layer)
    yield from from_base64(layer)
    yield from from_lines(layer)


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, base spans and those of decoded layers), each (start, kind, end)."""
    base = scan(text)
    if not any(c in text for c in ("%", "\\", "&#", "\0")) and not BASE64.search(text) and not WRAPPED.search(text):
        return base, base
    # a stack of what is still to come at each depth: one layer a depth is held at a time
    found, seen, todo = set(base), set(), [iter([Layer(text)])]
    while todo:
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
            continue
        key = hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest() + (b"" if layer.start is None or not len(layer.start) else b"%d" % layer.start[0])
        if key in seen:
            continue
        seen.add(key)
        if layer.start is not None and not layer.joined:
            for a, kind, b in scan(layer.text):
                x, y = layer.span(a, b)
                found.add((x, kind, y))
        todo.append(decoded(layer))
    return base, sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id {}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, sha, spans = ([], [], []), [], []
            for t in b["text"].to_pylist():
                base, every = all_spans(t or "")
                kinds = [k for _, k, _ in base]
                for k in range(3):
                    n[k].append(kinds.count(k))
                own = written(base)
                sha.append(hashlib.sha256(own.encode()).hexdigest())
                spans.append(own if every is base else written(every))
            yield pa.record_batch([b["doc_id"], *(pa.array(x, pa.int64()) for x in n), pa.array(sha, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA.format(kind))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))
