"""Containers without Spark.

python -m framelore [look] FILE [--info] [--json OUT] [--frame N] [--mp4 OUT] [--no-verify]
python -m framelore write OUT --pixels FILE --packets FILE [--time-base N/D] [--size WxH] [--fps N/D] [--semantic empty|example|FILE] [--split-layers] [--meta FILE] [--cost-log FILE]
"""

from __future__ import annotations

import argparse
import json
import mmap
import os
import re
import sys

from framelore.cost import CostLog
from framelore.sources import container, mp4, semantic

_UNIT = re.compile(rb"\x00?\x00\x00\x01[\x09\x29\x49\x69\x89\xa9\xc9\xe9]")  # a start code before an access unit delimiter


def _fraction(text: str) -> tuple[int, int]:
    a, _, b = text.partition("/")
    if not (a.isdigit() and b.isdigit() and int(b)):
        raise ValueError(f"{text} is no fraction")
    return int(a), int(b)


def look(given) -> None:
    with open(given.file, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as raw:
        held = container.Container(container.Source(raw=raw), given.magic.encode() if given.magic else None)
        head = held.header
        if given.info:
            print(f"video {head['width']}x{head['height']}, {head['fps_num']}/{head['fps_den']} fps, time scale {head['timescale']}, {head['duration'] / max(1, head['timescale']):.3f} s, codec {head['codec']}")
            for s in held.sections:
                print(f"section {s.idx}: type {s.type}, layer {s.layer}, {s.length} bytes at {s.offset}, checksum {s.crc32:08x}, ticks {s.start} to {s.end}")
        if given.frame is not None:
            print("pts {}, dts {}, offset {}, size {}, flags {}".format(*held.record(given.frame)))
        if given.mp4:
            done = False
            try:
                with open(given.mp4, "wb") as out:
                    n = mp4.write(out, held, not given.no_verify)
                done = True
            finally:
                if not done and os.path.exists(given.mp4):
                    os.remove(given.mp4)
            print(f"{n} frames")
        if given.json:
            parts = [semantic.decode(held.content(s, not given.no_verify)) for s in held.sections if s.type == container.SEMANTIC]
            if not parts:
                raise ValueError("no semantic section")
            told = json.dumps(semantic.as_plain(semantic.merge(parts)), indent=2, ensure_ascii=False) + "\n"
            if given.json == "-":
                sys.stdout.write(told)
            else:
                with open(given.json, "w") as out:
                    out.write(told)


def packets(path: str) -> list[dict]:
    """k=v|k=v lines in decode order. A packet without pts is an error; if any has no dts, all get one: the sorted pts, delayed by the deepest reordering."""
    rows = []
    with open(path) as f:
        for line in filter(None, map(str.strip, f)):
            kv = dict(p.split("=", 1) for p in line.split("|") if "=" in p)
            number = lambda k, kv=kv: int(kv[k]) if re.fullmatch(r"-?\d+", kv.get(k, "")) else None
            if number("pts") is None:
                raise ValueError(f"a packet without pts: {line}")
            rows.append({"pts": number("pts"), "dts": number("dts"), "duration": number("duration") or 0, "key": "K" in kv.get("flags", "")})
    if any(r["dts"] is None for r in rows):
        order = sorted(range(len(rows)), key=lambda i: (rows[i]["pts"], i))
        delay = max(i - rank for rank, i in enumerate(order))
        pts = [rows[i]["pts"] for i in order]
        gap = pts[1] - pts[0] if len(pts) > 1 else 1
        for i, r in enumerate(rows):
            r["dts"] = pts[i - delay] if i >= delay else pts[0] + (i - delay) * gap
    return rows


def write(given) -> None:
    base, fps, size = _fraction(given.time_base), _fraction(given.fps), _fraction(given.size.replace("x", "/"))
    scale = base[1] if base[0] == 1 else 90_000
    half_up = lambda n, d: (2 * n + d) // (2 * d) if n >= 0 else -((-2 * n + d) // (2 * d))
    tick = lambda t: half_up(t * base[0] * scale, base[1])
    log = CostLog(given.cost_log, given.out)
    with open(given.pixels, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as raw:
        with log.stage("index") as told:
            told["bytes_in"] = len(raw)
            rows, starts = packets(given.packets), [m.start() for m in _UNIT.finditer(raw)]
            if not starts or starts[0]:
                raise ValueError("the pixels do not begin with an access unit delimiter")
            if len(starts) != len(rows):
                raise ValueError(f"{len(starts)} frames in the pixels, {len(rows)} packets")
            if not rows[0]["key"]:
                raise ValueError("the first frame is no key frame")
            ends = [*starts[1:], len(raw)]
            index = container.encode_index([(tick(r["pts"]), tick(r["dts"]), a, z - a, int(r["key"])) for r, a, z in zip(rows, starts, ends)])
            duration = max(0, *(tick(r["pts"]) + tick(r["duration"]) for r in rows))
        if given.semantic == "empty":
            document = {"schema_major": semantic.VERSION[0], "schema_minor": semantic.VERSION[1], "t_end": duration}
        elif given.semantic == "example":
            document = semantic.example(scale, duration / scale)
        else:
            with open(given.semantic) as d:
                document = semantic.normalized(semantic.from_plain(json.load(d)))
        parts = semantic.by_layer(document) if given.split_layers else {}
        told = [(container.SEMANTIC, n, 0, semantic.encode(d), 0, 0) for n, d in parts.items()] or [(container.SEMANTIC, container.ALL_LAYERS, 0, semantic.encode(document), 0, 0)]
        meta = {"tool": "framelore", "source": os.path.basename(given.pixels)}
        if given.meta:
            with open(given.meta) as m:
                meta |= json.load(m)
        chunks = (raw[i : i + (8 << 20)] for i in range(0, len(raw), 8 << 20))
        sections = [(container.PIXEL, 0, 0, chunks, 0, 0), (container.FRAME_INDEX, 0, 0, index, 0, 0), *told, (container.METADATA, 0, 0, json.dumps(meta, indent=1).encode(), 0, 0)]
        header = {"width": size[0], "height": size[1], "fps_num": fps[0], "fps_den": fps[1], "timescale": scale, "duration": duration, "schema_major": semantic.VERSION[0], "schema_minor": semantic.VERSION[1]} | ({"magic": given.magic.encode()} if given.magic else {})
        done = False
        with log.stage("write") as cost:
            try:
                with open(given.out, "wb") as out:
                    cost["bytes_out"] = container.write(out, header, sections, len(sections))
                done = True
            finally:
                if not done and os.path.exists(given.out):
                    os.remove(given.out)  # no half of a file is left


def main(args: list[str] | None = None) -> int:
    ask = argparse.ArgumentParser(prog="framelore", description="Containers without Spark.")
    ask.add_argument("--magic", help="the file's first four letters")
    verbs = ask.add_subparsers(dest="verb", required=True)
    one = verbs.add_parser("look", help="look into a file")
    one.add_argument("file")
    one.add_argument("--info", action="store_true", help="print the header and the sections")
    one.add_argument("--json", metavar="OUT", help="write the semantic documents, as one, as JSON (- for the output)")
    one.add_argument("--frame", type=int, help="print a record of the frame index")
    one.add_argument("--mp4", metavar="OUT", help="rebuild an MP4 file")
    one.add_argument("--no-verify", action="store_true", help="do not check the sections' checksums")
    two = verbs.add_parser("write", help="make a file of coded pixels, their packets and a document")
    two.add_argument("out")
    two.add_argument("--pixels", required=True, help="Annex B with access unit delimiters")
    two.add_argument("--packets", required=True, help="k=v|k=v lines: pts, dts, duration, flags")
    two.add_argument("--time-base", default="1/90000")
    two.add_argument("--size", default="1x1")
    two.add_argument("--fps", default="30/1")
    two.add_argument("--semantic", default="empty", help="empty, example, or a JSON document")
    two.add_argument("--split-layers", action="store_true", help="a section for each layer")
    two.add_argument("--meta", help="JSON to put into the metadata")
    two.add_argument("--cost-log", help="append what each stage took")
    args = list(sys.argv[1:] if args is None else args)
    if args and args[0] not in ("look", "write") and not args[0].startswith("-"):
        args = ["look", *args]
    try:
        given = ask.parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    if given.verb == "look" and not (given.info or given.json or given.mp4) and given.frame is None:
        one.print_usage(sys.stderr)
        return 2
    try:
        (look if given.verb == "look" else write)(given)
    except (OSError, ValueError) as e:
        print(f"framelore: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
