"""Crowded inputs, on which a comparison of all pairs does not end in time; and the results, against plain loops."""

from __future__ import annotations

import random
import threading
from contextlib import contextmanager

import numpy as np

from framelore.operators import detections as D
from framelore.operators import graph, relations, text_events


@contextmanager
def at_most(spark, seconds):
    """Jobs that run longer are cancelled, which fails the test."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def test_event_errors_of_one_crowded_type(spark):
    n = 60_000
    found = spark.range(n).selectExpr("1L as video", "'left' as type", "cast(id * 7919 % 20011 as double) / 2 as sec")
    truth = spark.range(n).selectExpr("1L as video", "id as truth_idx", "'left' as type", "cast(id * 104729 % 30011 as double) / 3 - 50 as sec")
    with at_most(spark, 60):
        got = {r["truth_idx"]: r["error"] for r in D.event_errors(found, truth, 0.2).collect()}
    i = np.arange(n)
    at, sec = np.unique(i * 7919 % 20011 / 2), (i * 104729 % 30011) / 3 - 50
    place = np.searchsorted(at, sec)
    want = np.minimum(np.abs(at[np.maximum(place - 1, 0)] - sec), np.abs(at[np.minimum(place, len(at) - 1)] - sec))
    assert got == {k: e if e <= 0.2 else None for k, e in enumerate(want.tolist())}


def test_event_errors_at_the_edges(spark):
    """Nearest in the next cells, exactly `within` away, at no distance allowed, of no time or type."""
    kinds = "type string, sec double, video long"
    found = spark.createDataFrame([("a", 5.9, 1), ("a", 12.1, 1), ("b", 3.0, 1), (None, 1.0, 1), ("c", None, 1), ("c", float("nan"), 1), ("c", 1.0, 1)], kinds)
    truth = spark.createDataFrame([("a", 6.0, 1, 1), ("a", 12.0, 1, 2), ("a", 9.0, 1, 3), ("b", 6.0, 1, 4), (None, 1.0, 1, 5), ("c", 2.0, 1, 6), ("c", None, 1, 7), ("b", 0.0, 1, 8)], kinds + ", truth_idx long")
    got = {r["truth_idx"]: r["error"] for r in D.event_errors(found, truth, 3.0).collect()}
    assert got == {1: 6.0 - 5.9, 2: 12.1 - 12.0, 3: 9.0 - 5.9 if 9.0 - 5.9 <= 3 else None, 4: 3.0, 5: None, 6: 1.0, 7: None, 8: 3.0}
    exact = spark.createDataFrame([("b", 3.0, 1, 1), ("b", 3.5, 1, 2)], kinds + ", truth_idx long")
    assert {r["truth_idx"]: r["error"] for r in D.event_errors(found, exact, 0.0).collect()} == {1: 0.0, 2: None}


TEXT = "video long, track long, text string, first_sec double, last_sec double, first_box struct<x double, y double, w double, h double>, best_box struct<x double, y double, w double, h double>"


def texts(n, seed):
    """Texts numbered by their beginning, on a coarse grid, so that times, words and boxes are often equal; some of no words, time or box."""
    rng, out = random.Random(seed), []
    for video in (1, 2):
        starts = sorted(rng.randrange(12 * n) / 40 for _ in range(n))
        for track, sec in enumerate(starts, 1):
            box = lambda: (rng.randrange(3) / 10, rng.randrange(2) / 10, rng.randrange(4) / 10, 0.2)
            text, last, first_box = rng.choice(["Intro", "intro!", "Agenda", "Ende", None, ""]), sec + rng.randrange(5) * 0.3, box()
            out.append((video, track, text, sec, None if track % 17 == 0 else float("nan") if track % 19 == 0 else last, first_box, None if track % 23 == 0 else box()))
    return out


def overlap(a, b):
    inter = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    both = a[2] * a[3] + b[2] * b[3] - inter
    return inter / both if both > 0 else 0.0


def before(rows, within):
    said = lambda t: t.lower().replace("!", "")
    timed = [r for r in rows if r[4] is not None and r[4] == r[4] and r[6] is not None and r[2] is not None]
    found = {}
    for b in rows:
        for a in timed:
            if b[2] is not None and a[0] == b[0] and a[1] != b[1] and a[4] <= b[3] and b[3] - a[4] <= within and said(a[2]) != said(b[2]) and (o := overlap(a[6], b[5])) >= 0.3:
                found.setdefault((b[0], b[1]), []).append((o, a[1]))
    return found


def test_text_predecessors_equal_a_loop(spark):
    for within in (3.0, 0.3):
        rows = texts(150, 1)
        want = {(*k, a, o) for k, some in before(rows, within).items() for o, a in some}
        assert want and {tuple(r) for r in text_events.predecessors(spark.createDataFrame(rows, TEXT), within).select("video", "track", "before", "overlap").collect()} == want


def test_text_predecessors_of_one_crowded_moment(spark):
    n = 15_000
    box = "named_struct('x', cast(id % 122 as double) / 122, 'y', cast(id div 122 as double) / 123, 'w', 0.005D, 'h', 0.005D)"
    crowd = spark.range(n).selectExpr("1L as video", "id + 1 as track", "concat('line ', id) as text", "cast(id as double) / 1e5 as first_sec", "cast(id as double) / 1e5 as last_sec", f"{box} as first_box", f"{box} as best_box")
    moved = crowd.selectExpr("video", f"track + {n} as track", "concat(text, ' b') as text", "first_sec + 1 as first_sec", "last_sec + 9 as last_sec", "first_box", "best_box")
    with at_most(spark, 90):
        found = text_events.predecessors(crowd.unionByName(moved)).selectExpr("track - before as far", "round(overlap, 9) as overlap").groupBy("far", "overlap").count().collect()
    assert [tuple(r) for r in found] == [(n, 1.0, n)]


def test_text_events_equal_a_loop(spark):
    for seed in (2, 3):
        rows, want = texts(150, seed), {}
        found, taken = before(rows, 3.0), set()
        for r in rows:
            some = [(o, a) for o, a in found.get(r[:2], []) if (r[0], a) not in taken]
            want[r[:2]] = max(some)[1] if some else None
            taken.add((r[0], want[r[:2]]))
        got = text_events.text_events(spark.createDataFrame(rows, TEXT)).collect()
        assert {(r["video"], r["track"]): r["before"] for r in got} == want
        assert all((r["type"] == "text_appeared") == (r["before"] is None) for r in got) and len(got) == len(rows)


def test_text_events_of_one_crowded_moment(spark):
    """Each of many texts in one place claims the last one that is free."""
    n = 8000
    box = "named_struct('x', 0.1D, 'y', 0.1D, 'w', 0.5D, 'h', 0.1D)"
    crowd = spark.range(2 * n).selectExpr("1L as video", "id + 1 as track", "concat('line ', id) as text", f"if(id < {n}, 0D, 1D) as first_sec", f"if(id < {n}, 1D, 9D) as last_sec", f"{box} as first_box", f"{box} as best_box")
    with at_most(spark, 60):
        found = {r["track"]: r["before"] for r in text_events.text_events(crowd).collect()}
    assert found == {k: None if k <= n else 2 * n + 1 - k for k in range(1, 2 * n + 1)}


def test_objects_at_of_many_probes_of_few_times(spark):
    entities = spark.range(300).selectExpr("1L as video", "id", "0L as start", "99L as end")
    objects = spark.range(300 * 50).selectExpr("1L as video", "id div 50 as entity_id", "id % 50 * 2 as timestamp", "named_struct('x', id div 50 + id % 50 / 100) as bbox")
    probes = spark.range(400_000).selectExpr("1L as video", "id as probe", "id % 100 as t")
    with at_most(spark, 60):
        found = graph.objects_at(objects, entities, probes, 8).selectExpr("probe % 100 = t and timestamp = t - t % 2 and bbox.x = id + timestamp / 200 as good").groupBy("good").count().collect()
    assert [tuple(r) for r in found] == [(True, 300 * 400_000)]


def test_objects_at_equals_a_loop(spark):
    """Several lives of an entity, objects before, after and between them, none at all, some without a time; times asked often, once or not at all; whole and broken times."""
    rng = random.Random(7)
    for scale, kind in ((1, "long"), (0.25, "double")):
        at = lambda n, scale=scale: None if rng.random() < 0.03 else rng.randrange(n) * scale
        objects = [(rng.randrange(3), rng.randrange(8), at(90)) for _ in range(150)]
        objects = [(*o, (float(o[1]), o[2])) for o in dict.fromkeys(objects)]
        lives = [(rng.randrange(3), rng.randrange(12), at(90), at(120)) for _ in range(40)]
        probes = [(rng.randrange(3), k if k % 50 else None, at(130)) for k in range(1200)] + [(0, k, 40 * scale) for k in range(5000, 6300)]
        want = []
        for v, i, start, end in lives:
            for pv, probe, t in probes:
                if v == pv and None not in (start, end, t) and start <= t <= end:
                    had = [o[2] for o in objects if o[:2] == (v, i) and o[2] is not None and o[2] <= t]
                    want.append((v, probe, t, i, max(had, default=None), (float(i), max(had)) if had else None))
        frames = (spark.createDataFrame(rows, schema.format(kind)) for rows, schema in ((objects, "video long, entity_id long, timestamp {0}, bbox struct<x double, at {0}>"), (lives, "video long, id long, start {0}, end {0}"), (probes, "video long, probe long, t {0}")))
        objects_, lives_, probes_ = frames
        for bucket in (1, 64):
            got = [(r["video"], r["probe"], r["t"], r["id"], r["timestamp"], r["bbox"] and tuple(r["bbox"])) for r in graph.objects_at(objects_, lives_, probes_, bucket).collect()]
            assert len(want) > 1000 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_objects_at_keeps_pairs_off_the_disk(spark, tmp_path):
    """Each of 3,000 entities lives at each of 400 asked times: 1.2 million of these and 24 million rows, of 6,000 objects and 8,000 probes."""
    entities = spark.range(3000).selectExpr("1L as video", "id * 7919 % 3000 as id", "0L as start", "399L as end")
    objects = spark.range(6000).selectExpr("1L as video", "id div 2 as entity_id", "id % 2 * (id * 31 % 399) as timestamp", "named_struct('x', 0.5D) as bbox")
    probes = spark.range(8000).selectExpr("1L as video", "id * 7919 % 8000 as probe", "id % 400 as t")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    graph.objects_at(objects, entities, probes, 512).drop("bbox").write.parquet(str(tmp_path / "out"))
    assert written() - before < 3e6
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3000 * 8000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 24e6


BOXED = "video long, frame_id long, class string, {0} long, {1} long, box struct<x double, y double, w double, h double>"


def test_matches_equal_a_loop(spark):
    """Frames of few and many boxes on a coarse grid, so that overlaps are often equal; over many batches, one frame longer than a batch."""
    rng = random.Random(4)

    def boxes(base):
        some = []
        for k in range(400):
            frame = 1 if k < 150 else rng.randrange(2, 60)
            some.append((k % 2, frame, rng.choice("ab"), base + k, 2**60 + k, None if k % 29 == 0 else (rng.randrange(6) / 10, rng.randrange(2) / 10, rng.randrange(4) / 10, 0.2)))
        rng.shuffle(some)
        return some

    found, truth, want = boxes(0), boxes(1000), {}
    pairs = sorted((-o, d[3], t[3], d[:3]) for d in found for t in truth if d[:3] == t[:3] and d[5] and t[5] and (o := overlap(d[5], t[5])) >= 0.2)
    had, taken = set(), set()
    for far, d, t, key in pairs:
        if d not in had and t not in taken:
            had.add(d)
            taken.add(t)
            want[*key, d, t] = -far
    a, b = spark.createDataFrame(found, BOXED.format("det_idx", "track")), spark.createDataFrame(truth, BOXED.format("truth_idx", "truth_track"))
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    try:
        for size in (before, "7"):
            spark.conf.set(batch, size)
            got = D.matched(a, b, 0.2).collect()
            assert {(r["video"], r["frame_id"], r["class"], r["det_idx"], r["truth_idx"]): r["overlap"] for r in got} == want and len(got) == len(want)
            switches = D.identity_switches(a, b, 0.2).collect()
            assert {(r["truth_track"], r["switches"]) for r in switches} == {(2**60 + k[4] - 1000, 0) for k in want}
    finally:
        spark.conf.set(batch, before)


def test_matches_of_a_crowded_frame(spark):
    n = 1500
    box = "named_struct('x', 0.1D + id / 1e5, 'y', 0.1D, 'w', 0.5D, 'h', 0.5D) as box"
    found = spark.range(n).selectExpr("1L as video", "1L as frame_id", "'a' as class", "id as det_idx", "id as track", box)
    truth = found.withColumnsRenamed({"det_idx": "truth_idx", "track": "truth_track"})
    with at_most(spark, 40):
        got = D.precision_recall(found, truth).collect()
        switches = D.identity_switches(found, truth).collect()
    assert [(r["class"], r["right"], r["precision"], r["recall"]) for r in got] == [("a", n, 1.0, 1.0)]
    assert sorted((r["truth_track"], r["frames"], r["switches"]) for r in switches) == [(k, 1, 0) for k in range(n)]


def test_near_relations_equal_the_stored_pairs(spark):
    rng = random.Random(5)
    rows = []
    for video in (1, 2):
        for frame in sorted(rng.sample(range(200), 60)):
            for track in rng.sample(range(12), 6):
                box = None if rng.random() < 0.03 else (rng.randrange(8) / 10, rng.randrange(8) / 10, 0.2, 0.4)
                rows.append((video, frame, float(frame), 2**60 + track, rng.choice(["person", "dog", "cup", "tv", None]), box))
    seen = spark.createDataFrame(rows, "video long, frame_id long, time_sec double, track long, class string, box struct<x double, y double, w double, h double>")
    kinds = ["person", "dog"]
    want = relations.islands(relations.near(relations.pairs(seen, kinds)), seen, gap=5.0)
    got = relations.near_relations(seen, kinds, gap=5.0)
    assert want.count() > 20
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(tuple(r) for r in want.collect())


def test_near_relations_of_crowded_frames(spark):
    """2,000 things in each of 20 frames: 40 million pairs, of which only neighbours are near; they are not shuffled."""
    n = 2000
    seen = spark.range(20 * n).selectExpr("1L as video", f"id div {n} as frame_id", f"cast(id div {n} as double) as time_sec", f"id % {n} as track", "'person' as class", f"named_struct('x', 0.9D * (id % {n}), 'y', 0D, 'w', 0.8D, 'h', 0.6D) as box")
    with at_most(spark, 60):
        got = relations.near_relations(seen, ["person"]).collect()
    assert sorted((r["subject"], r["object"], r["hits"], r["relation_id"]) for r in got) == [(k, k + 1, 20, k + 1) for k in range(n - 1)]


def test_active_at_of_many_probes_of_few_times(spark):
    """Most spans share a bucket with a probe and do not hold it."""
    spans = spark.range(4000).selectExpr("1L as video", "id", "id as start", "id as end")
    probes = spark.range(200_000).selectExpr("1L as video", "id as probe", "id % 4000 as t")
    with at_most(spark, 20):
        found = graph.active_at(spans, probes, 4000).selectExpr("id = t and probe % 4000 = t as good").groupBy("good").count().collect()
    assert [tuple(r) for r in found] == [(True, 200_000)]
