"""Containers, documents, model backends, streams and the command line."""

from __future__ import annotations

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from framelore.operators import document, models, tracking
from framelore.sources import container, semantic

BOX = "struct<x:double,y:double,w:double,h:double>"


def a_file(count=50, semantic_parts=((1, b"one", 0, 0), (2, b"two", 10, 20), (2, b"three", 30, 40), (2, b"all", 0, 0)), **header):
    records = [(1001 * i, 1001 * i - 2002, 100 * i, 100, int(i % 5 == 0)) for i in range(count)]
    sections = [(container.PIXEL, 0, 0, b"pixels" * 10, 0, 0), (container.FRAME_INDEX, 0, 0, container.encode_index(records), 0, 0)]
    sections += [(container.SEMANTIC, layer, 0, content, a, b) for layer, content, a, b in semantic_parts]
    return container.encode({"width": 320, "height": 180, "timescale": 30000, "duration": 50050} | header, sections), records


def held(raw, magic=None):
    return container.Container(container.Source(raw=raw), magic)


def test_layout_by_the_byte():
    """Every field at its documented offset."""
    raw, _ = a_file(magic=b"ABCD")
    number = lambda at, n: int.from_bytes(raw[at : at + n], "little")
    import zlib

    assert raw[:4] == b"ABCD" and number(4, 2) == 1 and number(6, 2) == 0 and number(8, 2) == 1 and number(12, 4) == 72 and number(20, 4) == 320 and number(24, 4) == 180
    assert number(28, 4) == 30 and number(32, 4) == 1 and number(36, 4) == 30000 and number(40, 8) == 50050 and number(48, 2) == 1 and number(54, 2) == 6 and number(56, 2) == 40
    assert number(64, 4) == zlib.crc32(raw[72 : 72 + 240]) and number(68, 4) == zlib.crc32(raw[:68])
    row = raw[72 + 3 * 40 : 72 + 4 * 40]
    part = lambda at, n: int.from_bytes(row[at : at + n], "little")
    assert part(0, 2) == 2 and row[2] == 2 and part(12, 8) == 3 and part(20, 4) == zlib.crc32(b"two") and part(24, 8) == 10 and part(32, 8) == 20 and raw[part(4, 8) : part(4, 8) + 3] == b"two"
    assert held(raw, b"ABCD").header["magic"] == b"ABCD"
    with pytest.raises(container.ContainerError, match="magic"):
        held(raw, b"WXYZ")


def test_reading():
    raw, records = a_file()
    c = held(raw)
    assert c.find(container.SEMANTIC, 2).idx == 3 and c.find(container.SEMANTIC).idx == 2 and c.find(container.AUDIO) is None
    assert [s.idx for s in c.find_range(container.SEMANTIC, 2, 20, 30)] == [5, 3, 4] and [s.idx for s in c.find_range(container.SEMANTIC, 2, 41, 50)] == [5]
    assert list(c.records()) == records and c.record(7) == records[7] and list(c.records(3, 9, 2)) == records[3:9]
    for i in (-1, 50):
        with pytest.raises(container.ContainerError, match="no such frame"):
            c.record(i)
    c.verify_all()


def test_damage_is_found():
    raw, _ = a_file()
    for at in (5, 44, 80):  # header, header, table
        with pytest.raises(container.ContainerError, match="checksum"):
            held(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])
    broken = raw[:-1] + bytes([raw[-1] ^ 1])
    assert held(broken).content(held(broken).sections[-1], verify=False) == b"al" + bytes([ord("l") ^ 1])
    for read in (lambda c: c.verify_all(), lambda c: c.content(c.sections[-1])):
        with pytest.raises(container.ContainerError, match="checksum of section 5"):
            read(held(broken))
    for n in (0, 10, 71, 100, len(raw) - 1):
        with pytest.raises(container.ContainerError):
            held(raw[:n])
    newer, _ = a_file(reader_major=2)
    with pytest.raises(container.ContainerError, match="reader of version 2.0"):
        held(newer)
    with pytest.raises(container.ContainerError, match="more sections"):
        container.write(__import__("io").BytesIO(), {}, [(1, 0, 0, b"", 0, 0)] * 2, 1)
    with pytest.raises(container.ContainerError, match="fewer sections"):
        container.write(__import__("io").BytesIO(), {}, [], 1)


def test_data_source(spark, tmp_path):
    container.register(spark)
    for i, name in enumerate("abc"):
        (tmp_path / f"{name}.vidx").write_bytes(a_file(50 + i)[0])
    read = lambda table, **more: spark.read.format("vidx").options(table=table, **more).load(str(tmp_path))
    assert read("header").groupBy("timescale", "sections").count().collect()[0]["count"] == 3
    assert read("sections").where("type = 2 and layer = 2").count() == 9
    frames = read("frame_index", split_bytes="500")
    assert frames.rdd.getNumPartitions() > 6 and frames.count() == 153 and frames.where("decode_idx = 51").count() == 1
    assert sorted(r["decode_idx"] for r in frames.where(F.col("path").endswith("a.vidx")).collect()) == list(range(50))
    told = {(os.path.basename(r["path"]), r["idx"]): bytes(r["content"]) for r in read("content").where("type = 2").collect()}
    assert told["a.vidx", 2] == b"one" and len(told) == 12
    again = container.load(spark, str(tmp_path), "frame_index")
    assert again.drop("path").exceptAll(frames.drop("path")).count() == 0 and again.count() == 153
    some = spark.createDataFrame([(str(tmp_path / "a.vidx"), 7), (str(tmp_path / "b.vidx"), 50)], "path string, decode_idx long")
    assert sorted(r["pts"] for r in container.frames_at(some).collect()) == [7007, 50050]
    (tmp_path / "c.vidx").write_bytes(a_file()[0][:60])
    with pytest.raises(Exception, match="too short"):
        read("sections").collect()


def test_only_what_is_wanted_is_read(tmp_path):
    """Pushed equalities keep other sections' bytes unread: a damaged one is no matter."""
    from pyspark.sql.datasource import EqualTo

    raw = a_file()[0]
    (tmp_path / "a.vidx").write_bytes(raw[:-1] + bytes([raw[-1] ^ 1]))
    reader = container._Reader({"path": str(tmp_path), "table": "content"})
    filters = [EqualTo(("type",), 2), EqualTo(("idx",), 3)]
    assert list(reader.pushFilters(filters)) == filters
    assert [r[-1] for p in reader.partitions() for r in reader.read(p)] == [b"two"]


def test_writing_commits_or_leaves_nothing(spark, tmp_path):
    container.register(spark)
    kinds = "name string, width int, timescale int, sections array<struct<type:int,layer:int,flags:int,content:binary,start:long,end:long>>"
    rows = spark.createDataFrame([(f"{n}.vidx", 7, 1000, [(2, 1, 0, bytearray(n.encode()), 5, 6), (4, 0, 0, bytearray(b"{}"), 0, 0)]) for n in "xyz"], kinds).repartition(3)
    out = str(tmp_path / "out")
    rows.write.format("vidx").mode("append").save(out)
    assert sorted(os.listdir(out)) == ["x.vidx", "y.vidx", "z.vidx"]
    back = spark.read.format("vidx").option("table", "content").load(out).where("type = 2")
    assert sorted((bytes(r["content"]), r["start"], r["end"]) for r in back.collect()) == [(b"x", 5, 6), (b"y", 5, 6), (b"z", 5, 6)]
    rows.where("name = 'x.vidx'").write.format("vidx").mode("overwrite").save(out)
    assert os.listdir(out) == ["x.vidx"]
    bad = rows.withColumn("name", F.when(F.col("name") == "y.vidx", "a/b").otherwise(F.concat(F.lit("n"), "name")))
    with pytest.raises(Exception, match="not a file name"):
        bad.write.format("vidx").mode("append").save(out)
    assert os.listdir(out) == ["x.vidx"]


# --- documents


def tables(spark, doc):
    rows = spark.createDataFrame([(1, bytearray(semantic.encode(doc)))], "video long, content binary")
    return {k: semantic.blocks(rows, k) for k in semantic.KINDS}


BREAKS = {
    "no layer": lambda d: d["objects"][0].update(layer=0), "no pixel_ref": lambda d: d["texts"][0].update(pixel_ref=None), "pixel_ref times": lambda d: d["scenes"][0]["pixel_ref"].update(t_start=9, t_end=8),
    "pixel_ref box": lambda d: d["embeddings"][0]["pixel_ref"].update(bbox={"x": 0.5, "y": 0.0, "w": 0.6, "h": 0.1}), "box": lambda d: d["objects"][0].update(bbox={"x": -0.1, "y": 0.0, "w": 0.1, "h": 0.1}),
    "box ": lambda d: d["events"][0].update(region={"x": float("nan"), "y": 0.0, "w": 0.1, "h": 0.1}), "confidence": lambda d: d["texts"][0].update(confidence=1.5), "confidence ": lambda d: d["attributes"][0].update(confidence=float("nan")),
    "times": lambda d: d["actions"][0].update(start=10**9), "times ": lambda d: d["entities"][0].update(first_seen=10**9), "times  ": lambda d: d["scenes"][0].update(start=10**9), "unknown entity": lambda d: d["objects"][0].update(entity_id=77),
    "unknown entity ": lambda d: d["events"][0].update(entity_ids=[1, 77]), "unknown entity  ": lambda d: d["temporals"][1].update(removed_entity_ids=[77]), "unknown relation": lambda d: d["temporals"][0].update(active_relation_ids=[77]),
    "repeated id": lambda d: d["relations"].append(dict(d["relations"][0])), "unknown entity   ": lambda d: d["relations"][0].update(object_id=0),
}


def test_every_rule_of_documents(spark):
    sound = semantic.example(1000, 4.0)
    assert document.document_violations(tables(spark, sound)).count() == 0
    parts = None
    for i, (rule, spoil) in enumerate(BREAKS.items()):
        doc = json.loads(json.dumps(sound))
        spoil(doc)
        row = spark.createDataFrame([(i, bytearray(semantic.encode(doc)))], "video long, content binary")
        parts = row if parts is None else parts.union(row)
    parts = parts.coalesce(1).cache()
    found = {}
    for r in document.document_violations({k: semantic.blocks(parts, k) for k in semantic.KINDS}).collect():
        found.setdefault(r["video"], set()).add(r["rule"])
    assert {i: r.strip() for i, r in enumerate(BREAKS)} == {i: next(iter(v)) for i, v in found.items()} and all(len(v) == 1 for v in found.values())
    loose = document.document_violations({k: semantic.blocks(parts, k) for k in semantic.KINDS}, references=False)
    assert not {r["rule"] for r in loose.collect()} & {"unknown entity", "unknown relation", "repeated id"}
    with pytest.raises(ValueError, match="not valid"):
        document.raise_on(loose)


def test_layers_and_json():
    doc = semantic.example(1000, 4.0)
    parts = semantic.by_layer(doc)
    assert sorted(parts) == [1, 2, 3, 4] and [b["label"] for b in parts[2]["scenes"]] == ["shot_01"] and not parts[3]["scenes"]
    whole = semantic.merge([semantic.decode(semantic.encode(p)) for p in parts.values()])
    assert all(len(whole[k]) == len(doc[k]) for k in semantic.KINDS)
    assert semantic.encode(semantic.from_plain(json.loads(json.dumps(semantic.as_plain(doc))))) == semantic.encode(doc)


def test_layers_as_tables(spark, tmp_path):
    """Blocks split by layer, put together again, and read by layer without opening other files."""
    from framelore.operators import document as documents

    held_tables = tables(spark, semantic.example(1000, 4.0))
    split = documents.split_layers(held_tables)
    assert sorted(split) == [1, 2, 3, 4] and split[3]["texts"].count() == 1 and split[1]["texts"].count() == 0
    whole = documents.merge(list(split.values()))
    assert all(whole[k].exceptAll(t).count() == 0 and whole[k].count() == t.count() for k, t in held_tables.items())
    documents.save({k: held_tables[k] for k in ("texts", "events")}, str(tmp_path))
    some = documents.read(spark, str(tmp_path), "texts", [3])
    assert some.count() == 1 and documents.read(spark, str(tmp_path), "texts", [1]).count() == 0
    assert re.search(r"PartitionFilters: \[[^\]]*layer", some._jdf.queryExecution().toString()) and documents.read(spark, str(tmp_path), "events").count() == 1


def test_small_numbers_take_few_bytes(spark):
    from framelore.operators import document as documents

    n = F.col("n")
    rows = spark.createDataFrame([(v,) for v in (0, 1, -1, 63, -64, 64, 2**40, -(2**62))], "n long").select("n", documents.zigzag(n).alias("z"), documents.varint_size(documents.zigzag(n)).alias("s")).collect()
    for r in rows:
        want = 2 * r["n"] if r["n"] >= 0 else -2 * r["n"] - 1
        assert r["z"] == want and r["s"] == len(semantic._varint(want))


def test_graph_becomes_a_valid_document(spark):
    """Two things and what is known of them; boxes beyond the frame and confidences above 1 are held in bounds; the states rebuild."""
    from framelore.operators import graph as graphs

    kinds = f"video long, entity long, class string, name string, obs_idx long, ticks long, frame_id long, conf double, box {BOX}"
    obs = spark.createDataFrame([(1, 1, "person", "person_01", i, 1000 * i, 10 * i, 0.5 + 0.6 * (i == 3), (0.1 + 0.001 * i, 0.2, 0.3, 0.9)) for i in range(8)] + [(1, 2, "cup", "cup_01", i, 2000 + 1000 * i, 20 + 10 * i, 0.8, (0.1 * i, 0.2, 0.1, 0.1)) for i in range(4)], kinds)
    readings = spark.createDataFrame([(1, 1, "Exit", "Exit", 0.7, 0, 0, 0, 0.7, (0.1, 0.1, 0.2, 0.1)), (1, 1, "Ex1t", "Exit", 0.7, 1, 1000, 10, 0.9, (0.3, 0.1, 0.2, 0.1))], f"video long, track long, text string, agreed string, mean_conf double, obs_idx long, ticks long, frame_id long, conf double, box {BOX}")
    acts = spark.createDataFrame([(1, 1, "walking", 0, 3000, 0.9, 0, (0.1, 0.2, 0.3, 0.9))], f"video long, entity long, name string, start long, end long, conf double, frame_id long, box {BOX}")
    events = spark.createDataFrame([(1, "cup_left", 5000, 5000, [2], None, 50, None)], f"video long, type string, start long, end long, entities array<long>, conf double, frame_id long, region {BOX}")
    rels = spark.createDataFrame([(1, 1, 1, "near", 2, 2000, 4000, 0.6, 20, (0.1, 0.1, 0.5, 0.5))], f"video long, id long, subject long, name string, object long, start long, end long, conf double, frame_id long, box {BOX}")
    shots = spark.createDataFrame([(1, "shot_01", 0, 8000, 0)], "video long, label string, start long, end long, frame_id long")
    assert document.graph_violations(obs.selectExpr("video", "entity as id"), events, acts, rels).count() == 0
    out = document.from_graph({"observations": obs, "readings": readings, "actions": acts, "events": events, "relations": rels, "shots": shots}, 0.02, 30_000)
    assert document.document_violations(out).count() == 0
    heads = spark.createDataFrame([(1, 0, 0, 8000)], "video long, layer int, t_start long, t_end long")
    doc = semantic.decode(semantic.documents(out, heads).first()["content"])
    assert [(e["id"], e["type"], e["first_seen"], e["last_seen"], e["layer"], e["pixel_ref"]["frame_id"]) for e in doc["entities"]] == [(1, "person", 0, 7000, 1, 30), (2, "cup", 2000, 5000, 1, 20)]
    assert [(o["entity_id"], o["timestamp"]) for o in doc["objects"]] == [(1, 0), (1, 7000), (2, 2000), (2, 3000), (2, 4000), (2, 5000)]  # the person's box hardly changes
    assert doc["objects"][0]["bbox"]["h"] == pytest.approx(0.8) and max(o["confidence"] for o in doc["objects"]) <= 1
    assert [(t["content"], t["pixel_ref"]["frame_id"], t["pixel_ref"]["t_end"]) for t in doc["texts"]] == [("Exit", 0, 1000)]  # the best reading of the agreed text
    assert doc["events"][0]["confidence"] is None and doc["events"][0]["pixel_ref"]["bbox"] is None and doc["scenes"][0]["label"] == "shot_01" and doc["attributes"][1]["value"] == "cup_01"
    assert [(t["kind"], t["t_start"], t["t_end"], t["added_entity_ids"], t["removed_entity_ids"], t["added_relation_ids"]) for t in doc["temporals"]] == [(1, 0, 2000, [], [], []), (2, 2000, 4001, [2], [], [1]), (2, 4001, 5001, [2], [], []), (2, 5001, 7001, [], [], [])]
    refs = graphs.block_references(out)
    got = graphs.evidence(refs, spark.createDataFrame([(1, "events:0"), (1, "none:9")], "video long, block_id string")).collect()
    assert [(r["block_id"], r["t_start"], r["frame_id"]) for r in got] == [("events:0", 5000, 50)]
    bad = document.graph_violations(obs.selectExpr("video", "entity as id"), events.withColumn("entities", F.array(F.lit(9).cast("long"))), acts.withColumn("end", F.lit(-1).cast("long")), rels.union(rels))
    assert sorted(r["rule"] for r in bad.collect()) == ["ends before it starts", "missing or repeated id", "unknown entity"]


# --- backends


def test_retries():
    calls, waits = [], []

    def shaky():
        calls.append(1)
        if len(calls) < 3:
            raise models.Unavailable("busy")
        return "done"

    assert models.attempts(shaky, models.RetryConfig(), waits.append) == (3, "done")
    assert 0.2 <= waits[0] <= 0.3 and 0.4 <= waits[1] <= 0.6
    calls.clear()
    with pytest.raises(RuntimeError, match="after 2 attempts"):
        models.attempts(shaky, models.RetryConfig(retries=1), waits.append)
    calls.clear()
    with pytest.raises(RuntimeError, match="after 1 attempts"):
        models.attempts(shaky, models.RetryConfig(retries=-1), waits.append)

    def wrong():
        calls.append(1)
        raise ValueError("bad input")

    calls.clear()
    with pytest.raises(ValueError, match="bad input"):
        models.attempts(wrong, models.RetryConfig(), waits.append)
    assert len(calls) == 1
    with pytest.raises(RuntimeError, match="after 2 attempts"):
        models.attempts(lambda: __import__("time").sleep(0.5), models.RetryConfig(retries=1, timeout_seconds=0.05), waits.append)


def test_backends_over_frames(spark):
    @models.backend("sizes")
    def make():
        def model(rgb, width, height):
            if rgb[0] == 9:
                raise ValueError("dark")
            return [("frame", float(width * height))]

        return model

    kinds = "video long, frame_id long, time_sec double, width int, height int, rgb binary"
    frames = spark.createDataFrame([(1, 0, 0.0, 2, 1, bytearray(6)), (1, 1, 1.0, 2, 1, bytearray([9] * 6)), (1, 2, 2.0, 2, 1, bytearray(5)), (2, 0, 0.0, 1, 1, bytearray(3))], kinds)
    got = models.analysed(frames, "sizes", "struct<class:string,area:double>").cache()
    told = {(r["video"], r["frame_id"]): (r["error"], r["attempts"], [tuple(f) for f in r["found"]]) for r in got.collect()}
    assert told == {(1, 0): (None, 1, [("frame", 2.0)]), (1, 1): ("dark", 0, []), (1, 2): ("the bytes do not fit the sides", 0, []), (2, 0): (None, 1, [("frame", 1.0)])}
    assert sorted((r["video"], r["frame_id"]) for r in models.tolerated(got, 2).collect()) == [(1, 0), (2, 0)]
    assert models.tolerated(got.where("video = 2")).count() == 1
    with pytest.raises(Exception, match="video 1, frame 2: the bytes"):
        models.tolerated(got, 1).collect()
    assert sorted(r["warning"] for r in models.warnings(got).collect()) == ["frame 1 skipped: dark", "frame 2 skipped: the bytes do not fit the sides"]


# --- streams


def run_stream(spark, tmp_path, batches, schema, build, name):
    """The rows that the stream gives for micro-batches, one file each."""
    src = tmp_path / f"{name}-in"
    src.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    got = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"{name}-{i}"))
        for f in (tmp_path / f"{name}-{i}").glob("part-*"):
            os.replace(f, src / f"{i:03d}.json")
            os.utime(src / f"{i:03d}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    q = build(stream).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return got


def test_sampler_stream_equals_batch(spark, tmp_path):
    from framelore.operators import sampling
    from framelore.streaming import trackers

    schema = "video long, frame_id long, time_sec double"
    rows = [(v, i, i * 0.3 + v * 0.1) for i in range(40) for v in (1, 2)]
    got = run_stream(spark, tmp_path, [rows[:31], rows[31:50], rows[50:]], schema, lambda s: trackers.every_seconds_stream(s, 2.0), "sampler")
    want = sampling.every_seconds(spark.createDataFrame(rows, schema), 2.0).collect()
    assert sorted((r["video"], r["frame_id"], r["reason"]) for r in got) == sorted((r["video"], r["frame_id"], r["reason"]) for r in want)


DETECTIONS = f"video long, class string, frame_id long, time_sec double, det_idx long, conf double, box {BOX}, cut boolean, end boolean"


def test_tracker_stream_equals_batch(spark, tmp_path):
    """Three micro-batches; gaps, a cut, and the end of one video; the other's tracks stay open."""
    from framelore.streaming import trackers

    draw = random.Random(3)
    rows = []
    for t in range(60):
        for v in (1, 2):
            if 20 <= t < 26:
                continue  # longer than the gap
            for k in range(2):
                rows.append((v, "dog", t, float(t), 2 * t + k, 0.9, (0.1 + 0.5 * k + draw.uniform(0, 0.02), 0.3, 0.2, 0.2), t == 40, v == 1 and t == 59))
    got = run_stream(spark, tmp_path, [rows[:50], rows[50:130], rows[130:]], DETECTIONS, trackers.object_tracks_stream, "tracker")
    table = spark.createDataFrame(rows, DETECTIONS)
    frames = table.selectExpr("video", "frame_id", "time_sec", "if(cut, 'scene', 'interval') as reason").distinct()
    want = tracking.track_objects(table, frames, cuts=True).collect()
    spans = lambda found, key: sorted({k: (v, min(s), max(s), len(s)) for k, v, s in [(k, k[0], [r["time_sec"] for r in found if key(r) == k]) for k in {key(r) for r in found}]}.values())
    stream = spans(got, lambda r: (r["video"], r["first_frame"], round(r["x"] * 2)))
    batch = spans(want, lambda r: (r["video"], r["local"]))
    assert [s for s in batch if s[0] == 1 or s[2] < 59] == stream and len(stream) == 2 * 3 + 2 * 2


def test_late_frames_are_errors(spark, tmp_path):
    from framelore.streaming import trackers

    one = lambda t: (1, "dog", t, float(t), t, 0.9, (0.1, 0.1, 0.2, 0.2), False, False)
    with pytest.raises(Exception, match="comes after"):
        run_stream(spark, tmp_path, [[one(5)], [one(4)]], DETECTIONS, trackers.object_tracks_stream, "late")
    linker = tracking.ObjectLinker(tracking.TrackConfig())
    linker.frame(1, 2.0, [], [])
    linker.frame(2, 2.0, [], [])
    with pytest.raises(ValueError, match="comes after"):
        linker.frame(3, 1.9, [], [])


def test_text_stream_equals_batch(spark, tmp_path):
    from framelore.streaming import trackers

    schema = f"video long, frame_id long, time_sec double, line_idx long, text string, conf double, box {BOX}, end boolean"
    said = ["Platform nine", "Platfcrm nine", "Platform nine", "Way out", "Way out", "Way 0ut"]
    rows = [(1, 2 * i, float(2 * i), 0, f" {s} ", 0.9, (0.1, 0.1, 0.5, 0.1), i == 5) for i, s in enumerate(said)]
    got = run_stream(spark, tmp_path, [rows[:2], rows[2:]], schema, trackers.text_tracks_stream, "text")
    want = tracking.track_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["first_frame"], r["frame_id"], r["text"]) for r in got) == sorted((0 if r["track"] == 1 else 6, r["frame_id"], r["text"]) for r in want) and len(got) == 6


# --- command line


def test_write_and_look(tmp_path, capsys):
    from framelore.__main__ import main

    unit = lambda b: b"\x00\x00\x00\x01\x09\xf0\x00\x00\x01\x65" + b
    (tmp_path / "v.h264").write_bytes(unit(b"aaaa") + unit(b"bb") + unit(b"c"))
    (tmp_path / "p.txt").write_text("pts=0|dts=N/A|duration=1|flags=K__\npts=2|dts=N/A|duration=1|flags=___\npts=1|dts=N/A|duration=1|flags=___\n")
    out, log = str(tmp_path / "o.vidx"), str(tmp_path / "cost.jsonl")
    args = ["--magic", "WXYZ", "write", out, "--pixels", str(tmp_path / "v.h264"), "--packets", str(tmp_path / "p.txt"), "--time-base", "1/30", "--size", "64x32", "--semantic", "example", "--cost-log", log]
    assert main([*args, "--split-layers"]) == 0
    held_file = held((tmp_path / "o.vidx").read_bytes(), b"WXYZ")
    assert [s.type for s in held_file.sections] == [1, 3, 2, 2, 2, 2, 4] and [s.layer for s in held_file.sections][2:6] == [1, 2, 3, 4]
    assert [r[:4] for r in held_file.records()] == [(0, -1, 0, 14), (2, 0, 14, 12), (1, 1, 26, 11)] and held_file.header["duration"] == 3 and held_file.header["timescale"] == 30
    held_file.verify_all()
    assert main(["look", out, "--info", "--frame", "1", "--json", "-"]) == 0
    shown = capsys.readouterr().out
    assert "video 64x32" in shown and "pts 2, dts 0" in shown and '"LAYER_' not in shown and "shot_01" in shown
    assert [json.loads(x)["stage"] for x in open(log)] == ["index", "write"]
    (tmp_path / "p.txt").write_text("pts=0|flags=K__\n")
    os.remove(out)
    assert main(args) == 1 and "3 frames in the pixels, 1 packets" in capsys.readouterr().err and not os.path.exists(out)
    (tmp_path / "p.txt").write_text("dts=0|flags=K__\n")
    assert main(args) == 1 and "without pts" in capsys.readouterr().err
    assert main(["look", out]) == 2


# --- MP4


def boxes(raw, at=0, end=None):
    """{kind: [(start of its content, end)]} of the boxes in a stretch."""
    out, end = {}, len(raw) if end is None else end
    while at < end:
        n, head = int.from_bytes(raw[at : at + 4], "big"), 8
        if n == 1:
            n, head = int.from_bytes(raw[at + 8 : at + 16], "big"), 16
        out.setdefault(raw[at + 4 : at + 8].decode(), []).append((at + head, at + n))
        at += n
    assert at == end
    return out


def test_mp4_keeps_frames_and_times(tmp_path):
    """Four frames in decode order, two reordered, that begin at tick 500: sizes, times and key frames read back from the boxes."""
    import struct

    from framelore.__main__ import main

    sets = b"\x00\x00\x01\x67\x64\x00\x1f\xac" + b"\x00\x00\x01\x68\xee\x3c"
    frame = lambda kind, body, more=b"": b"\x00\x00\x00\x01\x09\xf0" + more + b"\x00\x00\x01" + bytes([kind]) + body
    frames = [frame(0x65, b"key!", sets), frame(0x41, b"pppp"), frame(0x01, b"b"), frame(0x01, b"bb")]
    pts, dts = [500, 530, 510, 520], [490, 500, 510, 520]
    at, records = 0, []
    for i, f in enumerate(frames):
        records.append((pts[i], dts[i], at, len(f), int(i == 0)))
        at += len(f)
    raw = container.encode({"width": 64, "height": 32, "timescale": 1000, "duration": 540}, [(1, 0, 0, b"".join(frames), 0, 0), (3, 0, 0, container.encode_index(records), 0, 0)])
    (tmp_path / "a.vidx").write_bytes(raw)
    out = tmp_path / "a.mp4"
    assert main(["look", str(tmp_path / "a.vidx"), "--mp4", str(out)]) == 0
    got = out.read_bytes()
    top = boxes(got)
    assert list(top) == ["ftyp", "mdat", "moov"]
    inside = lambda path: __import__("functools").reduce(lambda at, k: boxes(got, *at)[k][0], path.split("/"), top["moov"][0])
    table = lambda kind, row: (lambda a, z: [struct.unpack_from(">" + row, got, a + 8 + i * struct.calcsize(">" + row)) for i in range(struct.unpack_from(">I", got, a + 4)[0])])(*inside(f"trak/mdia/minf/stbl/{kind}"))
    a, _ = inside("trak/mdia/minf/stbl/stsz")
    n = struct.unpack_from(">I", got, a + 8)[0]
    sizes = struct.unpack_from(f">{n}I", got, a + 12)
    start = table("co64", "Q")[0][0]
    assert start == top["mdat"][0][0] and start + sum(sizes) == top["mdat"][0][1]
    samples = []
    for size in sizes:
        samples.append(got[start : start + size])
        start += size
    assert samples == [struct.pack(">I", 5) + b"\x65key!", struct.pack(">I", 5) + b"\x41pppp", struct.pack(">I", 2) + b"\x01b", struct.pack(">I", 3) + b"\x01bb"]
    spread = lambda rows: [v for k, v in rows for _ in range(k)]
    lasts, delay = spread(table("stts", "II")), spread(table("ctts", "Ii"))
    clock = [sum(lasts[:i]) for i in range(n)]
    a, _ = inside("trak/edts/elst")
    assert struct.unpack_from(">I", got, a + 4)[0] == 2
    (empty, none, *_), (shown, skip, *_) = struct.unpack_from(">QqHH", got, a + 8), struct.unpack_from(">QqHH", got, a + 28)
    assert none == -1 and shown == 40 and [empty + c + d - skip for c, d in zip(clock, delay)] == pts and [c + dts[0] for c in clock] == dts
    assert table("stss", "I") == [(1,)] and got[inside("trak/mdia/minf/stbl/stsd")[0] :].find(b"avcC") > 0 and b"\x67\x64\x00\x1f\xac" in got and struct.unpack_from(">II", got, inside("trak/tkhd")[1] - 8) == (64 << 16, 32 << 16)
    broken = raw.replace(b"key!", b"kex!")
    (tmp_path / "b.vidx").write_bytes(broken)
    assert main(["look", str(tmp_path / "b.vidx"), "--mp4", str(tmp_path / "b.mp4")]) == 1 and not (tmp_path / "b.mp4").exists()
    assert main(["look", str(tmp_path / "b.vidx"), "--mp4", str(tmp_path / "b.mp4"), "--no-verify"]) == 0
    bare = container.encode({"width": 64, "height": 32}, [(1, 0, 0, frames[1], 0, 0), (3, 0, 0, container.encode_index([(0, 0, 0, len(frames[1]), 1)]), 0, 0)])
    (tmp_path / "c.vidx").write_bytes(bare)
    assert main(["look", str(tmp_path / "c.vidx"), "--mp4", str(tmp_path / "c.mp4")]) == 1
