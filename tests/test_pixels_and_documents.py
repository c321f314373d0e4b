"""Pixels, text events, kept sightings and binary documents, against plain versions."""

from __future__ import annotations

import numpy as np
import pytest

from framelore.operators import images, sampling, text_events
from framelore.sources import semantic

FRAMES = "video long, frame_id long, time_sec double, width int, height int, rgb binary"
BOX = "struct<x:double,y:double,w:double,h:double>"


def painted(width, height, *patches, ground=(20, 20, 20)):
    """patches: (x1, y1, x2, y2, colour)."""
    im = np.full((height, width, 3), ground, np.uint8)
    for x1, y1, x2, y2, colour in patches:
        im[y1:y2, x1:x2] = colour
    return im


def level(p):
    return 299 * int(p[0]) + 587 * int(p[1]) + 114 * int(p[2])


def test_signature_by_definition():
    draw = np.random.default_rng(1)
    for w, h in ((64, 36), (50, 31), (5, 3), (200, 9)):
        im = draw.integers(0, 256, (h, w, 3), dtype=np.uint8)
        hist, cells = np.zeros(64), {}
        for y in range(0, h, 4):
            for x in range(0, w, 4):
                v = level(im[y, x]) // 1000
                hist[v // 4] += 1
                cells.setdefault((y * 9 // h) * 16 + x * 16 // w, []).append(v)
        got = images.signature(im.tobytes(), w, h)
        assert np.allclose(got[0], hist / hist.sum()) and np.allclose(got[1], [np.mean(cells.get(i, [0])) for i in range(144)])


def test_grid_by_definition():
    im = np.random.default_rng(2).integers(0, 256, (61, 100, 3), dtype=np.uint8)
    want = [np.mean([level(im[y, x]) / 1000 for y in range(r * 61 // 27, (r + 1) * 61 // 27, 3) for x in range(c * 100 // 48, (c + 1) * 100 // 48, 3)]) for r in range(27) for c in range(48)]
    assert np.allclose(images.grid_means(im.tobytes(), 100, 61), want, atol=1e-3)


def test_regions_equal_flooding():
    draw = np.random.default_rng(3)
    for _ in range(100):
        mask = draw.random((9, 12)) < 0.5
        left, want = {(y, x) for y, x in zip(*np.nonzero(mask))}, []
        while left:
            todo, seen = [min(left)], {min(left)}
            while todo:
                y, x = todo.pop()
                new = {(y + a, x + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))} & left - seen
                seen |= new
                todo += new
            left -= seen
            ys, xs = [p[0] for p in seen], [p[1] for p in seen]
            want += [(min(xs), min(ys), max(xs) + 1, max(ys) + 1)] if len(seen) >= 4 else []
        assert images.regions(mask) == want


def test_stand_ins(spark):
    red, blue, green = (200, 10, 10), (10, 10, 200), (10, 200, 10)
    im = painted(320, 180, (40, 60, 72, 140, red), (200, 100, 240, 120, blue), (100, 20, 220, 32, green), (0, 0, 3, 3, red))
    frames = spark.createDataFrame([(1, 0, 0.0, 320, 180, im.tobytes()), (1, 1, 1.0, 320, 180, b"short"), (1, 2, 2.0, 320, 180, None), (1, 3, 3.0, None, 180, b"")], FRAMES)
    found = images.stand_in_detections(frames).orderBy("det_idx").collect()
    assert [(r["frame_id"], r["class"], r["class_id"]) for r in found] == [(0, "person", 0), (0, "cell phone", 67)]
    assert np.allclose(list(found[0]["box"]), [40 / 320, 60 / 180, 32 / 320, 80 / 180])
    assert [r["class"] for r in images.stand_in_detections(frames, ["cell phone"]).collect()] == ["cell phone"]
    assert [(r["text"], round(r["box"]["x"], 4)) for r in images.stand_in_lines(frames).collect()] == [("FAKE TEXT", 100 / 320)]
    assert images.stand_in_detections(frames.limit(0)).count() == 0


def test_text_is_reused_from_the_last_frame_read(spark):
    """Each frame is a little brighter: the drift counts from the frame that was read, not from the one before."""
    rows = [(1, i, float(i), 96, 54, painted(96, 54, ground=(100 + 2 * i,) * 3).tobytes()) for i in range(8)] + [(2, 0, 0.0, 10, 10, painted(10, 10).tobytes()), (2, 1, 1.0, 10, 10, painted(10, 10).tobytes())]
    bullet = painted(96, 54, (2, 2, 6, 4, (255, 255, 255)), ground=(114,) * 3)
    frames = spark.createDataFrame([*rows, (1, 8, 8.0, 96, 54, bullet.tobytes())], FRAMES)
    sources = images.text_sources(images.cell_means(frames))
    assert {(r["video"], r["frame_id"]): r["source"] for r in sources.collect()} == {**{(1, i): i // 3 * 3 for i in range(8)}, (1, 8): 8, (2, 0): 0, (2, 1): 1}
    lines = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 6, "c"), (2, 1, "d")], "video long, frame_id long, text string")  # frame 3 failed
    got = sorted((r["video"], r["frame_id"], r["text"], r["reused"]) for r in images.carried_lines(sources, lines).collect())
    assert got == [(1, i, t, i > 0) for i in range(3) for t in "ab"] + [(1, 6, "c", False), (1, 7, "c", True), (2, 1, "d", False)]
    assert images.text_sources(images.cell_means(frames), 0).where("source != frame_id").count() == 0


def test_signatures_feed_the_sampler(spark):
    flips = spark.createDataFrame([(1, i, i / 30, 32, 18, painted(32, 18, ground=(255 if 10 <= i < 20 else 0,) * 3).tobytes()) for i in range(30)], FRAMES)
    assert [r["frame_id"] for r in sampling.scene_changes(sampling.signature_scores(images.signatures(flips))).orderBy("frame_id").collect()] == [0, 10, 20]


def test_text_events(spark):
    top, low = (0.1, 0.1, 0.5, 0.1), (0.1, 0.7, 0.5, 0.1)
    shifted = (0.2, 0.1, 0.5, 0.1)
    said = [(1, "Agenda", 0, 5, top), (2, "Footer", 0, 30, low), (3, "Results", 7, 9, top), (4, "results!", 11, 12, top), (5, "End", 11.5, 14, shifted), (6, "Also", 12, 14, top), (7, "Late", 17.5, 18, low), (8, "Later", 18, 19, shifted), (9, "Last", 30, 31, low)]
    texts = spark.createDataFrame([(1, i, t, float(a), float(b), box, box) for i, t, a, b, box in said], f"video long, track long, text string, first_sec double, last_sec double, first_box {BOX}, best_box {BOX}")
    got = {r["track"]: (r["type"], r["before"]) for r in text_events.text_events(texts).collect()}
    # 4 says the same as 3; 5 claims 3, so 6 is left with 4, which overlaps it most anyway; 9 begins when 2 ends
    assert got == {1: ("text_appeared", None), 2: ("text_appeared", None), 3: ("text_changed", 1), 4: ("text_appeared", None), 5: ("text_changed", 3), 6: ("text_changed", 4), 7: ("text_appeared", None), 8: ("text_appeared", None), 9: ("text_changed", 2)}


def test_kept_sightings_equal_a_loop(spark):
    draw = np.random.default_rng(7)
    rows = [(1, t, i, (float(x), 0.2, 0.1, 0.1), "extra") for t, n in enumerate((1, 2, 40, 60)) for i, x in enumerate(np.cumsum(draw.normal(0, 0.01, n)))]
    obs = spark.createDataFrame(rows, f"video long, track long, obs_idx int, box {BOX}, note string")
    want = set()
    for t in range(4):
        mine, last = [r for r in rows if r[1] == t], None
        for r in mine:
            if last is None or r is mine[-1] or abs(r[3][0] - last) > 0.02:
                want.add((t, r[2]))
                last = r[3][0]
    found = text_events.kept_sightings(obs)
    assert {(r["track"], r["obs_idx"]) for r in found.collect()} == want and found.columns == obs.columns and len(want) < len(rows)
    assert text_events.kept_sightings(obs, 0).count() == len(rows)


DOCUMENT = {
    "schema_minor": 1, "layer": 0, "t_start": -5, "t_end": 1 << 40,
    "entities": [{"id": 1, "type": "person", "first_seen": 0, "last_seen": 90, "layer": 1, "pixel_ref": {"t_start": 0, "t_end": 0, "frame_id": 0, "bbox": {"x": 0.5, "w": 0.25}}}],
    "objects": [{"entity_id": 1, "class": "é🙂", "confidence": 0.0, "timestamp": -1}, {}],
    "events": [{"type": "t", "entity_ids": [1, 300, 1 << 62], "region": {}}],
    "temporals": [{"kind": 2, "base_t": 7, "removed_relation_ids": [9]}],
    "embeddings": [{"model": "m", "vector": [0.5, -2.0, 0.0]}],
}


def test_document_agrees_with_the_library():
    pytest.importorskip("google.protobuf")
    from google.protobuf import descriptor_pb2, descriptor_pool, json_format, message_factory

    file = descriptor_pb2.FileDescriptorProto(name="t.proto", package="t", syntax="proto3")
    kinds = {"float": 2, "int64": 3, "uint64": 4, "string": 9, "uint32": 13, "enum": 5}
    for name, fields in semantic.FIELDS.items():
        m = file.message_type.add(name=name)
        for n, number, kind, mark in fields:
            f = m.field.add(name=n, number=number, label=3 if mark == "*" else 1, type=kinds.get(kind, 11))
            if kind in semantic.FIELDS:
                f.type_name = f".t.{kind}"
            if mark == "?":
                m.oneof_decl.add(name=f"_{n}")
                f.oneof_index, f.proto3_optional = len(m.oneof_decl) - 1, True
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    message = message_factory.GetMessageClass(pool.FindMessageTypeByName("t.Document"))()
    json_format.ParseDict(DOCUMENT, message)
    raw = message.SerializeToString(deterministic=True)
    assert semantic.encode(DOCUMENT) == raw and semantic.encode(semantic.decode(raw)) == raw

    def numbered(v):
        return {k: semantic.NAMES[k].index(x) if k in semantic.NAMES and isinstance(x, str) else numbered(x) for k, x in v.items()} if isinstance(v, dict) else [numbered(x) for x in v] if isinstance(v, list) else v

    plain = semantic.as_plain(semantic.decode(raw))
    assert numbered(plain) == json_format.MessageToDict(message, preserving_proto_field_name=True)
    assert semantic.from_plain(plain) == semantic.decode(raw)
    with pytest.raises(ValueError, match="unknown"):
        semantic.from_plain({"entities": [{"colour": "red"}]})


def test_document_round_trip(spark):
    got = semantic.decode(semantic.encode(DOCUMENT))
    assert got["t_start"] == -5 and got["objects"][0]["confidence"] == 0.0 and got["objects"][1]["confidence"] is None and got["objects"][1]["bbox"] is None
    assert got["entities"][0]["pixel_ref"] == {"t_start": 0, "t_end": 0, "frame_id": 0, "bbox": {"x": 0.5, "y": 0.0, "w": 0.25, "h": 0.0}}
    raw = semantic.encode(DOCUMENT)
    newer = raw + b"\xf8\x07\x05" + b"\xfa\x07\x02hi"  # fields 127, not known here
    assert semantic.encode(semantic.decode(newer)) == newer and semantic.decode(b"")["entities"] == []
    for cut in range(1, len(raw)):
        try:
            semantic.decode(raw[:cut])
        except (ValueError, IndexError):
            pass
    stored = spark.createDataFrame([(1, raw), (2, b""), (3, None)], "video long, content binary")
    events = semantic.blocks(stored, "events").collect()
    assert [(r["video"], r["place"], r["type"], r["entity_ids"], r["region"]["x"]) for r in events] == [(1, 0, "t", [1, 300, 1 << 62], 0.0)]
    heads = spark.createDataFrame([(1, 0, -5, 1 << 40), (2, 0, 0, 0)], "video long, layer int, t_start long, t_end long")
    names = ("embeddings", "entities", "events", "objects", "temporals")
    again = {r["video"]: bytes(r["content"]) for r in semantic.documents({n: semantic.blocks(stored, n) for n in names}, heads).collect()}
    assert again[1] == raw and semantic.decode(again[2]) == semantic.decode(b"\x10\x01")


def test_container_is_shown(tmp_path, capsys):
    import json

    from framelore.__main__ import main
    from framelore.sources import container

    raw = semantic.encode(DOCUMENT)
    path = str(tmp_path / "a.vidx")
    (tmp_path / "a.vidx").write_bytes(container.encode({"width": 320, "height": 180, "timescale": 1000, "duration": 2500}, [(1, 0, 0, b"pixels", 0, 0), (container.SEMANTIC, 0, 0, raw, 0, 0), (container.SEMANTIC, 0, 0, raw, 0, 0)]))
    assert main([path, "--info", "--json", str(tmp_path / "out.json")]) == 0 and "320x180" in (said := capsys.readouterr().out) and said.count("section") == 3
    out = json.loads((tmp_path / "out.json").read_text())
    assert len(out["entities"]) == 2 and out["entities"][0]["layer"] == "L0_ENTITY" and out["temporals"][0]["kind"] == "TEMPORAL_DELTA" and "t_start" not in out
    assert main([path]) == 2 and main([str(tmp_path / "none"), "--info"]) == 1
    damaged = (tmp_path / "a.vidx").read_bytes()
    (tmp_path / "a.vidx").write_bytes(damaged[:-1] + bytes([damaged[-1] ^ 1]))
    assert main([path, "--json", "-"]) == 1 and "checksum" in capsys.readouterr().err


def test_settings_are_strict():
    from dataclasses import dataclass, field

    from framelore import config
    from framelore.operators.tracking import TrackConfig

    @dataclass(frozen=True)
    class All:
        track: TrackConfig = field(default_factory=TrackConfig)
        name: str = "a"

    assert config.settings(All, {"track": {"max_gap_seconds": 2}}) == All(TrackConfig(max_gap_seconds=2.0))
    for wrong in ({"tracks": {}}, {"track": {"gap": 1}}, {"name": 3}, {"track": 5}):
        with pytest.raises(ValueError):
            config.settings(All, wrong)


def test_cost_log(spark, tmp_path):
    from framelore import cost
    from framelore.operators import media

    log = cost.CostLog(str(tmp_path / "cost.jsonl"), "r1")
    for n in (10, 30):
        with log.stage("sample") as record:
            record["bytes_in"] = n
    with pytest.raises(KeyError), log.stage("detect"):
        raise KeyError
    with cost.CostLog().stage("nowhere"):
        pass
    got = {r["stage"]: (r["runs"], r["bytes_in"]) for r in media.stage_costs(cost.load(spark, str(tmp_path / "cost.jsonl"))).collect()}
    assert got == {"sample": (2, 40), "detect": (1, 0)}
