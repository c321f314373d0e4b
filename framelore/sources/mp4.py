"""An MP4 file (ISO base media) from a container's coded pixels and frame index; frames are copied, times kept to the tick.

The stream has one parameter set of each kind, 8-bit 4:2:0 pictures and no sound.
"""

from __future__ import annotations

import re
import struct
from itertools import groupby

from framelore.sources.container import H264, Container, ContainerError

_START = re.compile(rb"\x00\x00\x01")
# Unit types of H.264 that are not stored with the frames.
SEQUENCE_SET, PICTURE_SET, DELIMITER = 7, 8, 9
_IDENTITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def units(frame: bytes) -> list[bytes]:
    """The units of a frame in Annex B, without start codes and the zeros before and after them."""
    found = [m.end() for m in _START.finditer(frame)]
    ends = [*(a - 3 for a in found[1:]), len(frame)]
    return [u for a, z in zip(found, ends) if (u := frame[a:z].rstrip(b"\x00"))]


def _box(kind: str, *parts) -> bytes:
    """A box of bytes and other boxes; a box that is None is left out."""
    body = b"".join(p for p in parts if p is not None)
    return struct.pack(">I4s", len(body) + 8, kind.encode()) + body


def _full(kind: str, *parts, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _table(kind: str, rows: list[tuple], row: str, version: int = 0) -> bytes:
    packed = struct.Struct(">" + row)
    return _full(kind, struct.pack(">I", len(rows)), b"".join(packed.pack(*r) for r in rows), version=version)


def _runs(values) -> list[tuple[int, int]]:
    return [(sum(1 for _ in same), v) for v, same in groupby(values)]


def write(out, held: Container, verify: bool = True) -> int:
    """Write the file to a seekable one; how many frames it has."""
    head = held.header
    if head["codec"] != H264:
        raise ContainerError(f"pixel codec {head['codec']} is not supported")
    from framelore.sources.container import FRAME_INDEX, PIXEL

    pixels = held.find(PIXEL)
    if pixels is None or held.find(FRAME_INDEX) is None:
        raise ContainerError("no pixels or no frame index")
    if verify:
        held.verify(pixels)
        held.verify(held.find(FRAME_INDEX))
    records = list(held.records())
    if not records or not head["width"] or not head["height"] or not head["timescale"]:
        raise ContainerError("no frames, or no size or time scale")
    out.write(_box("ftyp", b"isom", struct.pack(">I", 512), b"isomiso2avc1mp41"))
    at = out.tell()
    out.write(struct.pack(">I4sQ", 1, b"mdat", 0))  # the size follows
    first, sizes, sets = at + 16, [], {}
    for i, (_, _, offset, size, _) in enumerate(records):
        if offset + size > pixels.length:
            raise ContainerError(f"frame {i} lies outside the pixels")
        n = 0
        for u in units(held.source.read(pixels.offset + offset, size)):
            kind = u[0] & 31
            if kind in (SEQUENCE_SET, PICTURE_SET):
                if sets.setdefault(kind, u) != u:
                    raise ContainerError(f"frame {i} changes a parameter set")
            elif kind != DELIMITER:
                out.write(struct.pack(">I", len(u)) + u)
                n += 4 + len(u)
        if not n:
            raise ContainerError(f"frame {i} has no picture")
        sizes.append(n)
    if len(sets) < 2 or len(sets[SEQUENCE_SET]) < 4:
        raise ContainerError("the stream has no parameter sets")
    end = out.tell()
    out.seek(at + 8)
    out.write(struct.pack(">Q", end - at))
    out.seek(end)
    out.write(_movie(head, records, sizes, sets[SEQUENCE_SET], sets[PICTURE_SET], first))
    return len(records)


def _movie(head: dict, records: list[tuple], sizes: list[int], sequence: bytes, picture: bytes, first: int) -> bytes:
    scale, width, height = head["timescale"], head["width"], head["height"]
    pts, dts = [r[0] for r in records], [r[1] for r in records]
    lasts = [b - a for a, b in zip(dts, dts[1:])]
    # the last frame lasts until the stream's end, or as long as the one before
    begin, stop = min(pts), max(head["duration"], max(pts) + 1)
    lasts.append(max(1, stop - max(pts)) if len(dts) == 1 else lasts[-1])
    shown, coded = stop - begin, sum(lasts)
    delay = [p - d for p, d in zip(pts, dts)]
    skip = begin - dts[0]  # the first picture's place on the media's own clock, which starts with the first frame decoded
    edits = ([(begin, -1, 1, 0)] if begin > 0 else []) + [(shown, skip, 1, 0)]
    whole = max(0, begin) + shown
    lead = struct.pack(">QQIQ", 0, 0, scale, whole)
    media = struct.pack(">QQIQHH", 0, 0, scale, coded, 0x55C4, 0)  # no language
    track = struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, whole, 0, 0, 0, 0) + _IDENTITY + struct.pack(">II", width << 16, height << 16)
    setup = _box("avcC", b"\x01" + sequence[1:4] + b"\xff\xe1", struct.pack(">H", len(sequence)), sequence, b"\x01", struct.pack(">H", len(picture)), picture)
    entry = _box("avc1", struct.pack(">6xH16xHHIIIH32xHh", 1, width, height, 0x480000, 0x480000, 0, 1, 24, -1), setup)
    keys = [i + 1 for i, r in enumerate(records) if r[4] & 1]
    table = _box(
        "stbl",
        _full("stsd", struct.pack(">I", 1), entry),
        _table("stts", _runs(lasts), "II"),
        _table("ctts", _runs(delay), "Ii", version=1) if any(delay) else None,
        _table("stss", [(k,) for k in keys], "I") if len(keys) < len(records) else None,
        _table("stsc", [(1, len(records), 1)], "III"),
        _full("stsz", struct.pack(">II", 0, len(sizes)), struct.pack(f">{len(sizes)}I", *sizes)),
        _table("co64", [(first,)], "Q"),
    )
    info = _box("minf", _full("vmhd", bytes(8), flags=1), _box("dinf", _full("dref", struct.pack(">I", 1), _full("url ", flags=1))), table)
    handler = _full("hdlr", struct.pack(">4x4s12x", b"vide"), b"video\x00")
    one = _box("trak", _full("tkhd", track, version=1, flags=3), _box("edts", _table("elst", edits, "QqHH", version=1)), _box("mdia", _full("mdhd", media, version=1), handler, info))
    return _box("moov", _full("mvhd", lead, struct.pack(">IH10x", 0x10000, 0x100), _IDENTITY, bytes(24), struct.pack(">I", 2), version=1), one)
