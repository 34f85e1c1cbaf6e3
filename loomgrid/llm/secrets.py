"""Secret scan with a recursive decoding worklist.

A text is scanned for secrets as it stands. Then its encoded parts are unwrapped, each to a new
layer with a map of every character to the span of the original text it came from: percent
escapes and Unicode escapes give the whole layer with the escapes replaced; base64 runs, also over line breaks, give
the UTF-8 and 16-bit texts in their bytes in every alignment, and those in what is compressed there (gzip, zlib, raw
deflate, bzip2, xz). New layers are scanned and unwrapped in turn until no layer is left that has not been seen.

Escapes in escapes are unwrapped layer by layer four times and then, in one pass, as far as they go, so
that the work on a deep nest grows with its length and not with its square.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.batches import text_batches

# Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?:[A-Za-z0-9+/_-]{16,}[ \t]*\r?\n[ \t]*)+[A-Za-z0-9+/_-]{2,}={0,2}")
URL = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~+/-])+")
URL_BYTE = re.compile(r"%[0-9A-Fa-f]{2}|.", re.DOTALL)
#: Escapes in escapes are unwrapped one layer at a time so often, and then at once as far as they go.
LEVELS = 4
#: Characters that can end an escape.
ENDS = frozenset("0123456789abcdefABCDEF}")
#: Decompressed parts of any size are scanned in blocks of about so many bytes, which overlap; only an encoded part
#: longer than the overlap may be cut by the end of a block.
PIECE = 1 << 22
OVERLAP = 1 << 20
#: Compressed layers inside each other; data that unpacks to itself would have no end.
DEEPEST = 64

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """Secrets of one layer: ``(kind, start, end)`` with end exclusive, in its own code points.

    Maximal runs of ``[0-9a-f]`` with 24 or more characters are what greedy matches of length 24 and
    over are.
    """
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


#: A character in valid UTF-8.
POINT = (
    rb"(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})"
)
UTF8 = re.compile(POINT + rb"+")
#: Stretches that can hold a secret, of which the shortest has 12 characters.
STRETCH = re.compile(POINT + rb"{12,}+")
WIDE_LITTLE = re.compile(rb"(?:[\x01-\x7f]\x00){12,}")
WIDE_BIG = re.compile(rb"(?:\x00[\x01-\x7f]){12,}")
#: Where compressed bytes may begin.
PACKED = re.compile(rb"\x1f\x8b|\x78[\x01\x5e\x9c\xda\x20\x3f\x7d\xbb\xf9]|BZh|\xfd7zXZ\x00")


def _opener(head: bytes):
    """What makes a decompressor for bytes that begin with ``head``, or None if they are not compressed."""
    if head[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    return None


def _inflated(chunks: Iterator[bytes], opener, rests: list[int]) -> Iterator[bytes]:
    """Decompressed pieces of bounded size of every member, up to the end or the first damaged byte.

    ``rests`` gets the number of bytes of the chunk that are left after each member.
    """
    unit = opener()
    try:
        for data in chunks:
            while data:
                if isinstance(unit, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
                    out = unit.decompress(data, PIECE)
                    data = b"" if unit.eof or unit.needs_input else None
                else:
                    out = unit.decompress(data, PIECE)
                    data = unit.unconsumed_tail
                yield out
                while data is None:
                    yield unit.decompress(b"", PIECE)
                    data = b"" if unit.eof or unit.needs_input else None
                if unit.eof:
                    data, unit = unit.unused_data, opener()
                    rests.append(len(data))
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
        return


def _unpacked(chunks: Iterator[bytes], rests: list[int], depth: int = 0) -> Iterator[bytes]:
    """The chunks with every compressed layer undone; nothing if the outermost is not compressed."""
    head = b""
    for chunk in chunks:
        head += chunk
        if len(head) >= 6:
            break
    opener, whole = _opener(head), chain([head], chunks)
    if opener and depth < DEEPEST:
        yield from _unpacked(_inflated(whole, opener, rests), [], depth + 1)
    elif depth:
        yield from whole


def _blocks(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The chunks in blocks that overlap by ``OVERLAP`` bytes, so that what lies across a cut is in one of them."""
    held, fresh = b"", 0
    for chunk in chunks:
        held, fresh = held + chunk, fresh + len(chunk)
        if len(held) >= PIECE:
            yield held
            held, fresh = held[-OVERLAP:], 0
    if fresh:
        yield held


class Layer:
    """A decoded text. Character ``i`` stands for ``first[i]`` to ``last[i]`` of the original; both never fall.

    ``level`` counts the escape layers in a row that led here.
    """

    def __init__(self, text: str, first: np.ndarray | None = None, last: np.ndarray | None = None, level: int = 0):
        self.text, self.level = text, level
        self.first = np.arange(len(text)) if first is None else first
        self.last = self.first + 1 if last is None else last

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return int(self.first[start]), int(self.last[end - 1])

    def inner(self, text: str, starts: np.ndarray, ends: np.ndarray, level: int = 0) -> Layer:
        """A layer whose characters stand for ``starts[i]`` to ``ends[i]`` of this one's text."""
        return Layer(text, self.first[starts], self.last[ends - 1], level)


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match of ``pattern`` replaced by its decoded text; None if nothing changes."""
    out: list[str] = []
    starts: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    last, changed = 0, False
    for m in pattern.finditer(layer.text):
        got = decode(m[0])
        if got is None:
            continue
        plain = np.arange(last, m.start())
        text, at, to = got
        out += [layer.text[last : m.start()], text]
        starts += [plain, m.start() + np.array(at, dtype=np.int64)]
        ends += [plain + 1, m.start() + np.array(to, dtype=np.int64)]
        last, changed = m.end(), True
    if not changed:
        return None
    plain = np.arange(last, len(layer.text))
    out.append(layer.text[last:])
    return layer.inner("".join(out), np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1]), layer.level + 1)


Decoded = tuple[str, list[int], list[int]]


def _percent(run: str) -> Decoded | None:
    """The valid UTF-8 among the run's bytes; others keep their escapes."""
    data = binascii.unhexlify(run.replace("%", ""))
    text, starts, ends, done, found = [], [], [], 0, False
    for m in chain(UTF8.finditer(data), [None]):
        to = m.start() if m else len(data)
        text.append(run[3 * done : 3 * to])
        starts += range(3 * done, 3 * to)
        ends += range(3 * done + 1, 3 * to + 1)
        if m:
            got, at = m[0].decode("utf-8"), m.start()
            for char in got:
                n = len(char.encode("utf-8"))
                starts.append(3 * at)
                ends.append(3 * (at + n))
                at += n
            text.append(got)
            done, found = m.end(), True
    return ("".join(text), starts, ends) if found else None


def _escape(run: str) -> Decoded | None:
    if run[1] == "u" and run[2] != "{":
        units = [int(run[i + 2 : i + 6], 16) for i in range(0, len(run), 6)]
        text, starts, ends, i = [], [], [], 0
        while i < len(units):
            pair = 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000
            code = 0x10000 + ((units[i] - 0xD800) << 10) + units[i + 1] - 0xDC00 if pair else units[i]
            # Half a pair becomes the replacement character.
            text.append(chr(code) if not 0xD800 <= code < 0xE000 else "\ufffd")
            starts.append(6 * i)
            ends.append(6 * (i + 1 + pair))
            i += 1 + pair
        return "".join(text), starts, ends
    code = int(run.strip("\\uUx{}"), 16)
    return (chr(code), [0], [len(run)]) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


#: Escapes at the end of a text, by their last character's kind.
TAIL = re.compile(r"(?:%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\u\{([0-9A-Fa-f]{1,6})\})$")
#: Characters of the longest escape.
LONGEST = 10


def _collapsed(layer: Layer) -> Layer:
    """The layer with escapes replaced until none is left, in one pass.

    Characters are put on a stack, and an escape that ends there is replaced at once, so that its character
    takes part in the next one. Bytes of 128 and more wait for the rest of their UTF-8 sequence.
    """
    chars: list[str] = []
    spans: list[tuple[int, int]] = []
    high: list[int] = []  # the byte or half pair that an unfinished character holds, else 0

    def put(char: str, span: tuple[int, int], held: int = 0) -> None:
        chars.append(char)
        spans.append(span)
        high.append(held)

    def cut(n: int) -> tuple[int, int]:
        span = spans[-n][0], spans[-1][1]
        del chars[-n:], spans[-n:], high[-n:]
        return span

    for i, c in enumerate(layer.text):
        put(c, (i, i + 1))
        while chars[-1] in ENDS:
            m = TAIL.search("".join(chars[-LONGEST:]))
            # An unfinished character is several of the text's, and so no part of an escape.
            if not m or any(high[-len(m[0]) :]):
                break
            code = int(next(g for g in m.groups() if g), 16)
            if m[1] and code >= 0x80:
                put(m[0], cut(len(m[0])), code)
                _finish_bytes(high, put, cut)
            elif 0xD800 <= code < 0xDC00:
                put(m[0], cut(len(m[0])), code)
            elif 0xDC00 <= code < 0xE000 or code >= 0x110000:
                span = cut(len(m[0]))
                if high and 0xD800 <= high[-1] < 0xDC00 and code < 0xE000:
                    lead = high[-1]
                    put(chr(0x10000 + ((lead - 0xD800) << 10) + code - 0xDC00), (cut(1)[0], span[1]))
                else:
                    put(m[0], span, -1)
            else:
                put(chr(code), cut(len(m[0])))
    # What stayed unfinished is as many characters as it was written with, each with the whole span.
    starts = np.repeat([a for a, _ in spans], [len(c) for c in chars]) if chars else np.empty(0, dtype=np.int64)
    ends = np.repeat([b for _, b in spans], [len(c) for c in chars]) if chars else np.empty(0, dtype=np.int64)
    return layer.inner("".join(chars), starts, ends, LEVELS + 1)


def _finish_bytes(high: list[int], put, cut) -> None:
    """Replace the bytes on top of the stack by their character if they are whole."""
    for n in (2, 3, 4):
        data = high[-n:]
        if len(data) == n and all(0x80 <= b < 0x100 for b in data) and data[0] >= 0xC2:
            try:
                char = bytes(data).decode("utf-8")
            except UnicodeDecodeError:
                continue
            put(char, cut(n))
            return


def _texts(data: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Texts in the bytes with the first byte of each character and the byte behind it.

    Stretches of valid UTF-8, and of ASCII in 16 bits of either order; secrets and their encodings are ASCII.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    for m in STRETCH.finditer(data):
        starts = m.start() + np.flatnonzero((raw[m.start() : m.end()] & 0xC0) != 0x80)
        yield m[0].decode("utf-8"), starts, np.append(starts[1:], m.end())
    for pattern, skip in ((WIDE_LITTLE, 0), (WIDE_BIG, 1)):
        for m in pattern.finditer(data):
            starts = np.arange(m.start(), m.end(), 2)
            yield m[0][skip::2].decode("ascii"), starts, starts + 2


def _byte_layers(layer: Layer, data: bytes, starts: np.ndarray, ends: np.ndarray, stop: int, doors: list[int]) -> Iterator[Layer]:
    """Layers of bytes that were decoded from ``starts[i]`` to ``ends[i]`` of the layer's text, all of them up to ``stop``.

    The texts in them, and those in their compressed parts, which may begin anywhere if marked and at one
    of ``doors`` if not (raw deflate).
    """
    for text, at, to in _texts(data):
        yield layer.inner(text, starts[at], ends[to - 1])
    done = 0
    whole = lambda text, at: layer.inner(text, np.full(len(text), starts[at]), np.full(len(text), stop))
    for p in PACKED.finditer(data):
        if p.start() < done:
            continue
        rests: list[int] = []
        for block in _blocks(_unpacked(iter([data[p.start() :]]), rests)):
            for text, _, _ in _texts(block):
                yield whole(text, p.start())
        done = len(data) - rests[-1] if rests else done
    for at in doors:
        if at >= done and at < len(data) and data[at] & 6 != 6:
            for block in _blocks(_raw_deflate(data, at)):
                for text, _, _ in _texts(block):
                    yield whole(text, at)


def _raw_deflate(data: bytes, at: int) -> Iterator[bytes]:
    """The bytes from ``at`` inflated without a header; nothing if they do not come out whole up to ``PIECE``."""
    unit, step, held = zlib.decompressobj(-15), 64, []
    try:
        while at < len(data) and not unit.eof:
            rest = data[at : at + step]
            while rest and not unit.eof:
                held.append(unit.decompress(rest, PIECE))
                rest = unit.unconsumed_tail
                if sum(map(len, held)) >= PIECE:
                    yield b"".join(held)
                    held = []
            at, step = at + step, min(2 * step, PIECE)
    except zlib.error:
        return
    if unit.eof:
        yield b"".join(held)


def _base64_layers(layer: Layer, tried: set[tuple[int, str]]) -> Iterator[Layer]:
    """Each run of digits, over line breaks too, is decoded in all four alignments, in whichever alphabet, as a path or
    a name may stand before the encoded part. ``tried`` are the runs that other layers had at the same place."""
    for m in chain(BASE64.finditer(layer.text), WRAPPED.finditer(layer.text) if "\n" in layer.text else ()):
        mark = int(layer.first[m.start()]), m[0]
        if mark in tried:
            continue
        tried.add(mark)
        body, places = m[0].rstrip("="), np.arange(m.start(), m.end())
        if "\n" in body:
            places = places[[c not in " \t\r\n" for c in m[0]]]
            body = re.sub(r"[ \t\r\n]+", "", body)
        doors = [0, *(i + 1 for i, c in enumerate(body) if c in "/+-_")]
        body = body.replace("-", "+").replace("_", "/")
        for skip in range(4):
            digits = body[skip : len(body) - ((len(body) - skip) % 4 == 1)]
            data = base64.b64decode(digits + "=" * (-len(digits) % 4))
            bits = 8 * np.arange(len(data))
            # Byte k comes from the digits that hold any of its bits.
            first, last = places[skip + bits // 6], places[skip + (bits + 7) // 6] + 1
            yield from _byte_layers(layer, data, first, last, m.end(), [(d - skip) * 3 // 4 for d in doors if d >= skip and (d - skip) % 4 == 0])


def _url_layers(layer: Layer) -> Iterator[Layer]:
    """Runs of URL characters whose bytes are not text, as compressed parts are."""
    for m in URL.finditer(layer.text):
        run = m[0]
        data = unquote_to_bytes(run)
        if len(data) == len(run) or UTF8.fullmatch(data):
            continue
        starts = np.array([x.start() for x in URL_BYTE.finditer(run)]) + m.start()
        yield from _byte_layers(layer, data, starts, np.append(starts[1:], m.end()), m.end(), [0])


def find_secrets(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text, each by start, then kind, then end, in its code points.

    A secret of a decoded layer spans the characters it was decoded from. Spans found twice count
    once in the second list.
    """
    rank = {k: i for i, k in enumerate(KINDS)}
    order = lambda s: (s[1], rank[s[0]], s[2])
    text = text or ""
    base = sorted(scan(text), key=order)
    if "%" not in text and "\\" not in text and not BASE64.search(text):
        return base, base
    spans = set(base)
    work = [Layer(text)]
    seen = {(text, (0, len(text)))}
    tried: set[tuple[int, str]] = set()
    while work:
        layer = work.pop()
        new = []
        if "%" in layer.text or "\\" in layer.text:
            if layer.level < LEVELS:
                new = [_replaced(layer, PERCENT, _percent), _replaced(layer, ESCAPE, _escape)]
            elif layer.level == LEVELS:
                new = [_collapsed(layer)]
        urls = _url_layers(layer) if "%" in layer.text else ()
        for found in chain(new, urls, _base64_layers(layer, tried)):
            if found is None or not found.text:
                continue
            mark = (found.text, found.origin(0, len(found.text)))
            if mark in seen:
                continue
            seen.add(mark)
            spans.update((kind, *found.origin(a, b)) for kind, a, b in scan(found.text))
            work.append(found)
    return base, sorted(spans, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_assign, n_access, n_hex, base, spans`` for every row, from its whole text.

    The counts and ``base`` are of the text as it stands; ``spans`` has what decoding adds as well. Null
    and empty texts have none. Texts of any length are scanned whole. Rows are independent; an empty table gives no rows; other columns
    are ignored.
    """
    schema = pa.schema([("id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base", pa.string()), ("spans", pa.string())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_secrets(t.as_py()) for t in batch.column(1)]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            lists = [pa.array([joined(f[i]) for f in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *lists], schema=schema)

    wanted = text_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return wanted.mapInArrow(search, "id long, n_assign long, n_access long, n_hex long, base string, spans string")

