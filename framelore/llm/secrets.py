"""Secret scans through nested encodings.

A text is a layer; so is whatever a URL-escaped, Unicode-escaped, base64 or compressed stretch of a layer decodes to. A
worklist scans each layer with the same patterns and unwraps it until nothing new appears. A content is opened once, which
ends cycles, but every place where it stands is kept: what is found in it is carried to each of them, and on to the
places of the layers around, so a secret found in any depth is reported as a span of the original wherever it occurs.
Escapes beyond ASCII are read as characters and as bytes. Every base64 run is read at its four alignments, whatever it decodes to. Compressed streams in what it decodes to are
unfolded to their end through all their members and scanned chunk by chunk; a secret in one stands for the whole stream.
"""

from __future__ import annotations

import binascii
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from hashlib import blake2b
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches

Place = Callable[[int, int], tuple[int, int]]  # from a span of a layer to the span it stands for in the layer around
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_CUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
# an escape sign that is itself escaped, however often, is read at once
_URL = re.compile(rb"%(?:25)*([0-9A-Fa-f]{2})")
_UNI = re.compile(rb"\\(?:u005[Cc]|x5[Cc])*(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2}))|&(?:#[xX]0*26;|#0*38;|amp;)*#(?:[xX]0*([0-9A-Fa-f]{1,6})|0*([0-9]{1,7}));")
# one beyond ASCII that may also be a byte
_HIGH = re.compile(rb"(?:\\(?:u00|x)|&#[xX]0*)[89A-Fa-f][0-9A-Fa-f]|&#0*(?:12[89]|1[3-9][0-9]|2[0-9][0-9]);")
# a run may be wrapped: line ends, also written as \n, and what indents or quotes the next line
_B64 = re.compile(rb"[A-Za-z0-9+/_-]{16,}(?:(?:[ \t]*\r?\n[ \t>]*|(?:\\r)?\\n)[A-Za-z0-9+/_-]+)*={0,2}")
_WRAP = re.compile(rb"[ \t]*\r?\n[ \t>]*|(?:\\r)?\\n")
# gzip, or zlib without a preset dictionary
_PACKED = re.compile(rb"\x1f\x8b\x08|[\x08\x18\x28\x38\x48\x58\x68\x78][\x00-\x1f\x40-\x5f\x80-\x9f\xc0-\xdf]")
# where a compressed layer can be cut without parting a stretch: a sign of no encoding, or a blank within a line
_BREAK = re.compile(rb"[^A-Za-z0-9+/_=\s\\%&#;>-]|[^\s>][ \t]+(?=[^\s])")
_CHUNK, _OVERLAP = 1 << 22, 1 << 16


def plain(raw: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns in one layer, byte offsets."""
    out, low = [], raw.lower()
    if any(c in low for c in _CUES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(raw) if m.end(1) - m.start(1) >= 6]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(raw)]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(raw)]
    return out


def _byte(m: re.Match) -> bytes:
    return bytes([int(m[1], 16)])


def _char(m: re.Match) -> bytes:
    code = int(m[4]) if m[4] else int(m[1] or m[2] or m[3], 16)
    return chr(code).encode("utf-8", "surrogatepass") if code < 0x110000 else b"?"


def _octet(m: re.Match) -> bytes:
    """The same for bytes that are written as escapes, as a compressed stream may be."""
    code = int(m[4]) if m[4] else int(m[1] or m[2] or m[3], 16)
    return bytes([code]) if code < 256 else _char(m)


def _unescaped(raw: bytes, escape: re.Pattern, decode: Callable[[re.Match], bytes]) -> tuple[bytes, Place] | None:
    """The whole layer with every escape read, as a name and its value may be written in different ways; None without one."""
    out, ends, here, at = [], [], [], 0  # ends: where the pieces end in the new layer; here: where they start and end in the old
    n = 0
    for m in escape.finditer(raw):
        for piece, start, end in ((raw[at : m.start()], at, m.start()), (decode(m), m.start(), m.end())):
            if piece:
                n += len(piece)
                out.append(piece)
                ends.append(n)
                here.append((start, end))
        at = m.end()
    if not out:
        return None
    if at < len(raw):
        out.append(raw[at:])
        ends.append(n + len(raw) - at)
        here.append((at, len(raw)))

    def place(a: int, b: int) -> tuple[int, int]:
        i, j = bisect_right(ends, a), bisect_left(ends, b)
        (start, end), first = here[i], ends[i - 1] if i else 0
        whole = end - start == ends[i] - first  # a piece without escapes
        start += (a - first) if whole else 0
        (p, q), first = here[j], ends[j - 1] if j else 0
        return start, p + b - first if q - p == ends[j] - first else q

    return b"".join(out), place


def _inflate(raw: bytes, at: int):
    """Pieces of the stream that starts at `at`, through all gzip members that follow one another; returns where it ends.

    What comes before an error is given too.
    """
    view = memoryview(raw)
    while True:
        opened, start = zlib.decompressobj(47), at
        try:
            while at < len(raw) and not opened.eof:
                fed = bytes(view[at : at + _OVERLAP])
                at += len(fed)
                while fed and not opened.eof:
                    if got := opened.decompress(fed, 1 << 20):
                        yield got
                    fed = opened.unconsumed_tail
            while not opened.eof and (got := opened.decompress(b"", 1 << 20)):
                yield got
        except zlib.error:
            return at
        at -= len(opened.unused_data)
        if not opened.eof or raw[start : start + 2] != b"\x1f\x8b" or raw[at : at + 3] != b"\x1f\x8b\x08":
            return at


def _chunks(pieces):
    """Layers to scan one by one: each starts where no stretch is parted, before the end of the last one.

    A run without such a place is kept whole, however long.
    """
    held, enough = bytearray(), _CHUNK
    for piece in pieces:
        held += piece
        if len(held) < enough:
            continue
        cut, stop = 0, len(held) - _OVERLAP
        while stop > 0 and not cut:
            start = max(0, stop - 4096)
            for m in _BREAK.finditer(held, start, stop):
                cut = m.end()
            stop = start + 1 if start else 0
        if cut:
            yield bytes(held)
            del held[:cut]
        enough = max(_CHUNK, 2 * len(held))
    if held:
        yield bytes(held)


def _packed(raw: bytes):
    """(start, end, the pieces' chunks) of the compressed streams in a layer, as a generator that must be used up at each step."""
    at = 0
    while (m := _PACKED.search(raw, at)) is not None:
        at = m.start()
        if raw[at] != 0x1F and (raw[at] << 8 | raw[at + 1]) % 31:
            at += 1
            continue
        end = [at]

        def pieces(start=at, end=end):
            end[0] = yield from _inflate(raw, start)

        stream = pieces()
        first = next(stream, None)
        if first is None:
            at += 1
            continue
        yield at, end, _chunks(chain([first], stream))
        at += 2  # a false start may stand before a true one


def _base64(m: re.Match):
    """A run read from each of its first four characters, as signs of a path or a name may stand before it."""
    raw, (first, last) = m[0], m.span()
    body = raw.rstrip(b"=")
    kept = range(len(body))
    if wraps := list(_WRAP.finditer(body)):
        kept = np.concatenate([np.arange(a, b) for a, b in zip([0, *(w.end() for w in wraps)], [*(w.start() for w in wraps), len(body)])])
        body = _WRAP.sub(b"", body)
    body = body.replace(b"-", b"+").replace(b"_", b"/")
    for skip in range(4):
        size = len(body) - skip
        size -= size % 4 == 1

        def place(a: int, b: int, skip=skip, size=size) -> tuple[int, int]:
            end = 4 * ((b - 1) // 3) + 4
            return first + int(kept[skip + 4 * (a // 3)]), last if end >= size else first + int(kept[skip + end - 1]) + 1

        yield binascii.a2b_base64(body[skip : skip + size] + b"=" * (-size % 4)), place


def _layers(raw: bytes):
    if b"%" in raw:
        yield _unescaped(raw, _URL, _byte)
    if b"\\" in raw or b"&" in raw:
        yield _unescaped(raw, _UNI, _char)
        if _HIGH.search(raw):
            yield _unescaped(raw, _UNI, _octet)
    for m in _B64.finditer(raw):
        yield from _base64(m)


def _inside(raw: bytes, text: bool = False):
    """The spans of a layer with those in its encodings. Compressed streams (text itself is none) are handed out as digest and chunks; their kinds come back."""
    places, found, work = {raw: []}, {raw: set(plain(raw))}, [raw]  # by content: the layers it stands in, and its spans
    while work:
        layer = work.pop()
        for inner, at in filter(None, _layers(layer)):
            if inner not in places:
                places[inner], found[inner] = [], set(plain(inner))
                work.append(inner)
            places[inner].append((layer, at))
        if layer is not raw or not text:
            for start, end, chunks in _packed(layer):
                kinds = yield blake2b(memoryview(layer)[start:]).digest(), chunks
                found[layer] |= {(k, start, max(end[0], start + 1) if end[0] > start else len(layer)) for k in kinds}
    news = [(layer, spans) for layer, spans in found.items() if spans]
    while news:
        layer, spans = news.pop()
        for outer, at in places[layer]:
            fresh = {(k, *at(a, b)) for k, a, b in spans} - found[outer]
            if fresh:
                found[outer] |= fresh
                news.append((outer, fresh))
    return found[raw]


def _unfolded(chunks):
    kinds = set()
    for chunk in chunks:
        kinds |= {k for k, _, _ in (yield from _inside(chunk))}
    return kinds


def _spans(raw: bytes) -> set[tuple[str, int, int]]:
    """_inside() with every compressed stream opened once; a stack, as they can nest deeply. One that holds itself adds nothing."""
    known: dict[bytes, set[str]] = {}
    stack, back = [(None, _inside(raw, True))], None
    while True:
        try:
            key, chunks = stack[-1][1].send(back)
        except StopIteration as done:
            key, back = stack.pop()[0], done.value
            if not stack:
                return back
            known[key] = back
            continue
        if key in known or any(key == k for k, _ in stack):
            for _ in chunks:  # to learn where it ends
                pass
            back = known.get(key, set())
        else:
            stack.append((key, _unfolded(chunks)))
            back = None


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(spans of the text itself, those and the ones inside its encodings), by start and kind; code points, end exclusive."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    base, more = plain(raw), _spans(raw)
    if (base or more) and not raw.isascii():
        points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        base = [(k, int(points[a]), int(points[b])) for k, a, b in base]
        more = {(k, int(points[a]), int(points[b])) for k, a, b in more}
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    return sorted(base, key=order), sorted({*base, *more}, key=order)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' id and kept columns with base and spans: arrays of (kind, start, end), see find().

    A null or empty text has none; repeated rows get a row each; an empty table gives none; other columns are dropped. A very long text is one layer, and
    read whole; a compressed stream is read in chunks of 4 MB, or as long as its longest run without a break. Kept columns may have any names but
    those of the results.
    """
    small_batches(docs.sparkSession)
    names = list(dict.fromkeys([id_col, *(keep or [])]))
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], F.col(text_col).cast("string").alias("t"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    span = "array<struct<kind:string,start:long,end:long>>"

    def run(batches):
        for b in batches:
            found = [find(t) for t in b.pop("t")]
            yield b.assign(base=[f[0] for f in found], spans=[f[1] for f in found])

    return rows.mapInPandas(run, f"{schema}, base {span}, spans {span}").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "base", "spans")


def redact(text: str | None, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans replaced by mark."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda x: (x[1], x[2])):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text_col replaced; length_col, if there, gets the new length where the text changed."""
    small_batches(docs.sparkSession)
    at, n = docs.columns.index(text_col), docs.columns.index(length_col) if length_col in docs.columns else -1
    plain_rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches):
        for b in batches:
            old = b[f"c{at}"]
            new = pd.Series([redact(t, find(t)[1], mark) for t in old], index=b.index, dtype=object)
            if n >= 0:
                changed = [x is not None and x != y for x, y in zip(new, old)]
                b[f"c{n}"] = b[f"c{n}"].where(~np.array(changed, dtype=bool), [len(x) if x is not None else None for x in new])
            yield b.assign(**{f"c{at}": new})

    return plain_rows.mapInPandas(run, plain_rows.schema).toDF(*docs.columns)
