"""Small scenes whose outcomes follow from the rules."""

from __future__ import annotations

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelore.functions import text as X
from framelore.operators import detections as D
from framelore.operators import graph, media, motion, relations, sampling, tracking

BOX = "struct<x:double,y:double,w:double,h:double>"
OBS = f"video long, track long, class string, obs_idx long, frame_id long, time_sec double, conf double, box {BOX}"


def sightings(spark, track, class_, boxes, video=1, conf=0.9):
    """boxes: {second: (x, y, w, h)}."""
    return spark.createDataFrame([(video, track, class_, i, int(t * 10), float(t), conf, tuple(map(float, b))) for i, (t, b) in enumerate(sorted(boxes.items()))], OBS)


def test_assignment_equals_brute_force():
    draw = np.random.default_rng(1)
    for k in range(400):
        n, m = draw.integers(1, 6, 2)
        cost = draw.integers(0, 20, (n, m)).astype(float) if k % 2 else draw.normal(size=(n, m))
        if k % 5 == 0:
            cost[draw.random((n, m)) < 0.4] = tracking.FAR
        got = tracking.assign(cost)
        total = sum(cost[i, j] for i, j in enumerate(got) if j >= 0)
        k = int(min(n, m))
        best = min(sum(c[i, j] for i, j in enumerate(p)) for c in [cost if n <= m else cost.T] for p in permutations(range(int(max(n, m))), k))
        assert total == pytest.approx(best) and len({j for j in got if j >= 0}) == k and len(got) == n


# --- motion: a body of height 0.5 that goes 0.2 a second has a speed of 0.4 heights a second, above 0.30; one at rest is below 0.15


def stroll(rest_from, rest_to, end, speed=0.2, height=0.5):
    """Going, resting, going back."""
    x, out = 0.1, {}
    for t in range(end + 1):
        out[t] = (x, 0.2, 0.1, height)
        x += 0.0 if rest_from <= t < rest_to else speed / (1 if t < rest_from else -1) * 0.5
    return out


def test_a_stroll_with_a_rest(spark):
    found = motion.actions(sightings(spark, 1, "person", stroll(4, 12, 16, speed=0.4))).orderBy("start_sec").collect()
    assert [r["action"] for r in found] == ["walking", "standing", "walking"]
    # over three steps, a step beside the rest has 2/3 of the speed 0.4, one beyond it 1/3: 0.27 is not yet rest, nor again a walk, and 0.13 is rest
    assert [(r["start_sec"], r["end_sec"]) for r in found] == [(0, 4), (4, 13), (13, 16)]
    assert all(r["conf"] == pytest.approx(0.9) for r in found) and found[0]["frame_id"] == 0 and found[1]["box"]["x"] == pytest.approx(0.9)


def test_what_shakes_at_its_place_stands(spark):
    draw = np.random.default_rng(3)
    boxes = {t: (0.5 + draw.uniform(-0.01, 0.01), 0.4 + draw.uniform(-0.01, 0.01), 0.1, 0.5) for t in range(15)}
    assert [(r["action"], r["start_sec"], r["end_sec"]) for r in motion.actions(sightings(spark, 1, "person", boxes)).collect()] == [("standing", 0.0, 14.0)]


def test_things_move_and_persons_walk(spark):
    """A chair that is pushed has object_moved, no action; a person has actions, no move; a short push is none, and a short track nothing."""
    pushed = {t: (0.1 + 0.06 * min(max(t - 3, 0), 4), 0.5, 0.1, 0.1) for t in range(12)}
    rows = sightings(spark, 1, "chair", pushed).union(sightings(spark, 2, "person", {t: (0.1 + 0.2 * t, 0.1, 0.1, 0.5) for t in range(4)}))
    rows = rows.union(sightings(spark, 3, "cup", {t: (0.3 + 0.001 * t, 0.5, 0.05, 0.05) for t in range(12)})).union(sightings(spark, 4, "person", {0: (0.1, 0.1, 0.1, 0.5), 0.5: (0.9, 0.1, 0.1, 0.5)}))
    moved = motion.object_moves(rows).collect()
    assert [(r["track"], r["type"]) for r in moved] == [(1, "object_moved")]
    assert moved[0]["start_sec"] <= 3 and 7 <= moved[0]["end_sec"] <= 9
    assert moved[0]["region"]["x"] == pytest.approx(0.1) and moved[0]["region"]["w"] == pytest.approx(0.34)
    assert [(r["track"], r["action"]) for r in motion.actions(rows).collect()] == [(2, "walking")]
    other = motion.MotionConfig(classes=("chair",))
    assert {r["track"] for r in motion.actions(rows, other).collect()} == {1}
    far = motion.MotionConfig(object_min_move=0.5)
    assert {r["track"] for r in motion.object_moves(rows, far).collect()} == set()


def test_boxes_without_height_have_a_least_size(spark):
    rows = sightings(spark, 1, "person", {0: (0.1, 0.1, 0.1, 0.0), 1: (0.1005, 0.1, 0.1, 0.0), 2: (0.101, 0.1, 0.1, 0.0)})
    assert [r["speed"] for r in motion.steps(rows).collect()] == [pytest.approx(0.5), pytest.approx(0.5)]
    assert motion.actions(rows).count() == 1


def plainly_absorbed(runs, least):
    runs = [list(r) for r in runs]
    while len(runs) > 1:
        spans = [r[4] - r[3] for r in runs]
        k = spans.index(min(spans))
        if spans[k] >= least:
            break
        runs[k][0] = not runs[k][0]
        out = [runs[0]]
        for r in runs[1:]:
            if out[-1][0] == r[0]:
                out[-1] = [r[0], out[-1][1], r[2], out[-1][3], r[4]]
            else:
                out.append(r)
        runs = out
    return runs


def test_absorbing_equals_a_plain_loop():
    draw = random.Random(4)
    for _ in range(300):
        at, runs, moving = 0.0, [], draw.random() < 0.5
        for i in range(draw.randint(1, 25)):
            length = draw.choice([0.25, 0.5, 0.75, 1.0, 1.5, 3.0])
            runs.append([moving, i, i + 1, at, at + length])
            at, moving = at + length, not moving
        assert motion.absorbed(runs, 1.0) == plainly_absorbed(runs, 1.0)


# --- relations


def test_a_cup_is_held_while_it_is_inside(spark):
    """The cup leaves the person's box to the right: 0.06 wide, its share inside falls by a sixth each second from t = 4 on."""
    person = sightings(spark, 1, "person", {t: (0.2, 0.2, 0.2, 0.6) for t in range(16)})
    cup = sightings(spark, 2, "cup", {t: (0.34 + 0.01 * max(0, t - 4), 0.5, 0.06, 0.06) for t in range(16)})
    found = relations.islands(relations.holding(relations.pairs(person.union(cup), ["person"])), person.union(cup)).collect()
    # inside: 1 up to t = 4, then 5/6, 4/6, 3/6, 2/6 at t = 8, the last of at least 0.3
    assert [(r["subject"], r["object"], r["start_sec"], r["end_sec"], r["hits"]) for r in found] == [(1, 2, 0.0, 8.0, 9)]
    table = sightings(spark, 2, "dining table", {t: (0.34, 0.5, 0.06, 0.06) for t in range(16)})
    assert relations.holding(relations.pairs(person.union(table), ["person"])).count() == 0


def test_what_can_be_held():
    want = "apple,backpack,banana,baseball bat,book,bottle,cake,cell phone,cup,donut,fork,frisbee,handbag,knife,mouse,orange,remote,sandwich,scissors,skateboard,spoon,sports ball,suitcase,teddy bear,tennis racket,toothbrush,umbrella,wine glass"
    assert sorted(D.HOLDABLE) == want.split(",")


@pytest.mark.parametrize(("hits", "want"), [((2, 3, 7, 8), [(2, 8)]), ((2, 3, 8, 9), [(2, 3), (8, 9)])])
def test_a_gap_is_closed_after_the_frame(spark, hits, want):
    rows = spark.createDataFrame([(1, float(t), 4, 5, "near", True, True, 1) for t in hits], "video long, time_sec double, subject long, object long, name string, keep boolean, enter boolean, score long")
    frames = spark.createDataFrame([(1, float(t)) for t in range(12)], "video long, time_sec double")
    assert sorted((r["start_sec"], r["end_sec"]) for r in relations.islands(rows, frames).collect()) == want


# --- linking


def detections(spark, rows):
    """rows: (second, class, box)."""
    det = spark.createDataFrame([(1, int(t * 10), float(t), i, c, 0.9, tuple(map(float, b))) for i, (t, c, b) in enumerate(rows)], f"video long, frame_id long, time_sec double, det_idx long, class string, conf double, box {BOX}")
    return det, det.selectExpr("video", "frame_id", "time_sec", "'interval' as reason").distinct()


def tracked(spark, rows, cuts=(), **config):
    det, frames = detections(spark, rows)
    frames = frames.withColumn("reason", F.when(F.col("time_sec").isin([float(c) for c in cuts]), "scene").otherwise("interval")) if cuts else frames
    out = tracking.track_objects(det, frames, tracking.TrackConfig(**config), cuts=bool(cuts))
    return sorted(r["n"] for r in out.groupBy("class", "local").agg(F.count("*").alias("n")).collect())


def test_tracks(spark):
    dog = [(t, "dog", (0.05 + 0.04 * t, 0.6, 0.2, 0.2)) for t in range(9)]
    assert tracked(spark, dog) == [9]
    assert tracked(spark, [(0, "cat", (0.5, 0.5, 0.2, 0.2))]) == [] and tracked(spark, [(0, "cat", (0.5, 0.5, 0.2, 0.2))], min_hits=1) == [1]
    assert tracked(spark, [*dog, *((t, "dog", (0.7, 0.05, 0.2, 0.2)) for t in range(9)), *((t, "cat", (0.05 + 0.04 * t, 0.6, 0.2, 0.2)) for t in range(9))]) == [9, 9, 9]
    assert tracked(spark, [d for d in dog if d[0] not in (4, 5)]) == [7] and tracked(spark, [d for d in dog if d[0] not in (4, 5)], max_gap_seconds=2.0) == [3, 4]
    sizes = [(0, "dog", (0.4, 0.4, 0.1, 0.1)), (1, "dog", (0.4, 0.4, 0.1, 0.1)), (2, "dog", (0.42, 0.42, 0.3, 0.3)), (3, "dog", (0.42, 0.42, 0.3, 0.3))]
    assert tracked(spark, sizes) == [2, 2]  # nine times the size, and little overlap


def test_cuts_end_tracks(spark):
    still = [(t, "dog", (0.4, 0.4, 0.2, 0.2)) for t in range(10)]
    assert tracked(spark, still) == [10]
    assert tracked(spark, still, cuts=(3, 7)) == [3, 3, 4]  # the frame of a cut begins the next track


def plainly_tracked(rows, cfg):
    """All frames of a class in order, without islands."""
    out = {}
    for c in {r[1] for r in rows}:
        linker, done = tracking.ObjectLinker(cfg), []
        for t in sorted({r[0] for r in rows if r[1] == c}):
            boxes = [r[2] for r in rows if r[:2] == (t, c)]
            done += linker.frame(int(t * 10), t, [0.9] * len(boxes), boxes)
        out[c] = sorted([[o[1] for o in t] for t in done + linker.finish()])
    return out


def test_islands_change_no_track(spark):
    draw = random.Random(7)
    rows = [(t, draw.choice("ab"), (draw.uniform(0, 0.6), draw.uniform(0, 0.6), 0.2, 0.2)) for t in range(120) if draw.random() < 0.4 for _ in range(2)]
    det, frames = detections(spark, rows)
    cfg = tracking.TrackConfig(max_gap_seconds=2.0)
    got = {}
    for r in tracking.track_objects(det, frames, cfg).groupBy("class", "local").agg(F.array_sort(F.collect_list("time_sec")).alias("t")).collect():
        got.setdefault(r["class"], []).append(list(r["t"]))
    assert {c: sorted(t) for c, t in got.items()} == plainly_tracked(rows, cfg) and sum(map(len, got.values())) > 3


def test_link_costs_by_definition():
    draw = np.random.default_rng(2)
    boxes, last = draw.uniform(0.05, 0.5, (20, 4)), draw.uniform(0.05, 0.5, (15, 4))
    ahead, cfg = last + np.array([0.1, 0, 0, 0]), tracking.TrackConfig()
    got = tracking.link_costs(boxes, 1.0, last, ahead, cfg)

    def iou(a, b):
        w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        inter = max(w, 0) * max(h, 0)
        return inter / (a[2] * a[3] + b[2] * b[3] - inter)

    apart = lambda a, b: float(np.hypot(a[0] + a[2] / 2 - b[0] - b[2] / 2, a[1] + a[3] / 2 - b[1] - b[3] / 2))
    for i, b in enumerate(boxes):
        for j, (p, q) in enumerate(zip(last, ahead)):
            over, dist = max(iou(b, p), iou(b, q)), min(apart(b, p), apart(b, q))
            reach, ratio = 0.6 * (np.hypot(*b[2:]) + np.hypot(*p[2:])) / 2, b[2] * b[3] / (p[2] * p[3])
            near = dist <= reach and 1 / 2.5 <= ratio <= 2.5
            assert got[i, j] == pytest.approx(-(over + 0.5 * max(0, 1 - dist / reach)) if over >= 0.3 or near else tracking.FAR)


def lines_of(spark, said, box=(0.1, 0.8, 0.5, 0.1)):
    return spark.createDataFrame([(1, i, float(t), 0, s, c, box) for i, (t, s, c) in enumerate(said)], f"video long, frame_id long, time_sec double, line_idx long, text string, conf double, box {BOX}")


def test_misread_letters_are_one_line(spark):
    """Five readings of one sign, two with a wrong letter; the text with the most confidence is the right one."""
    said = [(0, "Platform nine", 0.6), (1, "Platfcrm nine", 0.7), (2, "Platform nine", 0.6), (3, "P1atform nine", 0.5), (4, "Platform nine", 0.4), (10, "Way out", 0.9), (11, "Way out", 0.9)]
    found = tracking.track_text(lines_of(spark, said)).collect()
    assert sorted((r["track"], r["time_sec"]) for r in found) == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 10), (2, 11)]
    assert tracking.vote([(r["text"], r["conf"]) for r in found if r["track"] == 1]) == "Platform nine"
    assert tracking.vote([("ab", 0.5), ("é", 0.5), ("b", 0.5)]) == "ab"  # as many bytes as the other; the first in byte order


def test_matches_are_one_to_one(spark):
    """Two boxes on one true thing: one is right. The pair that overlaps most goes first."""
    kinds = f"video long, frame_id long, class string, det_idx long, track long, box {BOX}"
    found = spark.createDataFrame([(1, 1, "a", 1, 1, (0.1, 0.1, 0.2, 0.2)), (1, 1, "a", 2, 2, (0.11, 0.1, 0.2, 0.2)), (1, 2, "a", 3, 2, (0.1, 0.1, 0.2, 0.2)), (1, 3, "a", 4, 1, (0.1, 0.1, 0.2, 0.2)), (1, 3, "b", 5, 3, (0.1, 0.1, 0.2, 0.2))], kinds)
    truth = spark.createDataFrame([(1, f, "a", 10 + f, 9, (0.1, 0.1, 0.2, 0.2)) for f in (1, 2, 3)], kinds).withColumnsRenamed({"det_idx": "truth_idx", "track": "truth_track"})
    got = {r["class"]: (r["found"], r["truth"], r["right"], r["precision"], r["recall"]) for r in D.precision_recall(found, truth).collect()}
    assert got == {"a": (4, 3, 3, 0.75, 1.0), "b": (1, 0, 0, 0.0, None)}
    assert {(r["det_idx"], r["truth_idx"]) for r in D.matched(found, truth).collect()} == {(1, 11), (3, 12), (4, 13)}
    assert [(r["frames"], r["switches"]) for r in D.identity_switches(found, truth).collect()] == [(3, 2)]


def test_event_times_and_readings(spark):
    found = spark.createDataFrame([(1, "left", 4.0), (1, "left", 9.5), (1, "entered", 1.0)], "video long, type string, sec double")
    truth = spark.createDataFrame([(1, 1, "left", 9.0), (1, 2, "left", 30.0), (1, 3, "moved", 1.0)], "video long, truth_idx long, type string, sec double")
    assert {r["truth_idx"]: r["error"] for r in D.event_errors(found, truth, 2.0).collect()} == {1: 0.5, 2: None, 3: None}
    read = spark.createDataFrame([(1, "Way  out!", "way out"), (1, "Wav out", "Way out")], "video long, text string, truth string")
    assert [(r["lines"], r["exact"], round(r["similarity"], 6)) for r in D.reading_accuracy(read).collect()] == [(2, 1, round((1 + 6 / 7) / 2, 6))]


# --- samplers, states, look-ups


def test_samplers(spark):
    frames = lambda times: spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "video long, frame_id long, time_sec double")
    assert [r["frame_id"] for r in sampling.every_n(frames([i / 2 for i in range(9)]), 4).orderBy("frame_id").collect()] == [0, 4, 8]
    assert [(r["frame_id"], r["reason"]) for r in sampling.every_seconds(frames([0.2, 1.9, 2.0, 2.1, 5.5, 5.9, 6.0]), 2.0).orderBy("frame_id").collect()] == [(0, "first"), (2, "interval"), (4, "interval"), (6, "interval")]
    dark = lambda i: 12 <= i < 30
    film = spark.createDataFrame([(1, i, i / 24, [float(dark(i)), 1 - float(dark(i))], [200.0 * dark(i)]) for i in range(48)], "video long, frame_id long, time_sec double, hist array<double>, thumb array<double>")
    assert [(r["frame_id"], r["reason"]) for r in sampling.scene_changes(sampling.signature_scores(film)).orderBy("frame_id").collect()] == [(0, "first"), (12, "scene"), (30, "scene")]
    assert [r["frame_id"] for r in sampling.scene_changes(sampling.signature_scores(film), min_gap=1.0).orderBy("frame_id").collect()] == [0, 30]
    assert [(r["frame_id"], r["reason"]) for r in sampling.scene_changes(sampling.signature_scores(film.where("frame_id < 12")), max_gap=0.25).orderBy("frame_id").collect()] == [(0, "first"), (6, "max_gap")]
    assert media.sampling_warnings(media.widest_gap("every_n", n=90, fps=30.0)) == [] and "up to 4.0 s" in media.sampling_warnings(media.widest_gap("every_seconds", seconds=4.0))[0]
    assert "without a bound" in media.sampling_warnings(media.widest_gap("scene_change"))[0]


def test_states_rebuild(spark):
    spans = spark.createDataFrame([(1, 7, 100, 400), (1, 8, 150, 160), (1, 9, 390, 410), (1, 5, 900, 901), (2, 7, 0, 0)], "video long, id long, start long, end long")
    sets = graph.active_sets(spans)
    blocks = graph.state_blocks(sets, 200)
    # video 1: a full state at 100, again at 390 (290 ticks later), and at 900 after a stretch without anything
    assert sorted((r["video"], r["t0"]) for r in blocks.where("kind = 'KEY'").collect()) == [(1, 100), (1, 390), (1, 900), (2, 0)]
    want = {(r["video"], r["t0"], r["t1"]): r["ids"] for r in sets.collect() if r["ids"]}
    assert {(r["video"], r["t0"], r["t1"]): r["ids"] for r in graph.rebuilt_sets(blocks).collect()} == want


def plainly_blocked(sets, key_every):
    """KEY where nothing was active before or the last is old, else the difference to it."""
    out, base = [], None
    for t0, t1, ids in sorted(sets):
        if not ids:
            base = None
        elif base is None or t0 - base[0] >= key_every:
            base = (t0, set(ids))
            out.append(("KEY", t0, t1, None, sorted(ids), [], []))
        else:
            out.append(("DELTA", t0, t1, base[0], [], sorted(set(ids) - base[1]), sorted(base[1] - set(ids))))
    return out


def test_state_blocks_equal_a_plain_loop(spark):
    draw = random.Random(5)
    spans = [(v, i, s, s + draw.randint(0, 40)) for v in (1, 2) for i in range(30) for s in [draw.randint(0, 300)]]
    table = spark.createDataFrame(spans, "video long, id long, start long, end long")
    got = {v: [tuple(r)[1:] for r in sorted(graph.state_blocks(graph.active_sets(table), 50).where(f"video = {v}").collect(), key=lambda r: r["t0"])] for v in (1, 2)}
    for v in (1, 2):
        mine = [s for s in spans if s[0] == v]
        points = sorted({s[2] for s in mine} | {s[3] + 1 for s in mine})
        sets = [(a, b, [s[1] for s in mine if s[2] <= a <= s[3]]) for a, b in zip(points, points[1:])]
        assert got[v] == plainly_blocked(sets, 50)


def test_frame_at_equals_brute_force(spark):
    draw = random.Random(6)
    pts = [3 * i + draw.choice([0, 0, 1]) + (400 if i >= 25 else 0) for i in range(40)]
    index = spark.createDataFrame([(1, i, p) for i, p in enumerate(pts)], "video long, decode_idx long, pts long")
    probes = [-1, 0, *draw.sample(range(1, 700), 60)]
    got = {r["t"]: r["decode_idx"] for r in media.frame_at(index, spark.createDataFrame([(1, i, t) for i, t in enumerate(probes)], "video long, probe long, t long")).collect()}
    assert got == {t: max([i for i, p in enumerate(pts) if p <= t], key=lambda i: (pts[i], i), default=0) for t in probes}


def test_objects_texts_and_events_at_a_time(spark):
    entities = spark.createDataFrame([(1, 1, 0, 50), (1, 2, 20, 30)], "video long, id long, start long, end long")
    objects = spark.createDataFrame([(1, 1, 0, "a"), (1, 1, 25, "b"), (1, 2, 20, "c"), (1, 1, 50, "d")], "video long, entity_id long, timestamp long, bbox string")
    probes = spark.createDataFrame([(1, 1, 24), (1, 2, 25), (1, 3, 31), (1, 4, 60)], "video long, probe long, t long")
    got = sorted((r["probe"], r["id"], r["bbox"]) for r in graph.objects_at(objects, entities, probes, 8).collect())
    assert got == [(1, 1, "a"), (1, 2, "c"), (2, 1, "b"), (2, 2, "c"), (3, 1, "b")]
    texts = spark.createDataFrame([(1, "hi", (10, 25))], "video long, content string, pixel_ref struct<t_start:long,t_end:long>")
    assert [(r["probe"], r["content"]) for r in graph.texts_at(texts, probes).orderBy("probe").collect()] == [(1, "hi"), (2, "hi")]
    events = spark.createDataFrame([(1, "b", 5, 9), (1, "a", 5, 6), (1, "c", 10, 20), (1, "d", 21, 30)], "video long, type string, start long, end long")
    assert [(r["place"], r["type"]) for r in graph.events_between(events, 6, 10).orderBy("place").collect()] == [(1, "a"), (2, "b"), (3, "c")]


def test_similarity_agrees_with_the_column(spark):
    pairs = [("Platform nine", "P1atform nine"), ("", "?!"), ("Exit", "Entrance"), ("Öl 1", "ol 2"), ("x  y", "x\ty"), ("same", "SAME")]
    got = spark.createDataFrame(pairs, "a string, b string").select(X.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for (a, b), r in zip(pairs, got):
        assert abs(tracking.similarity(a, b) - r["s"]) < 1e-12


def test_packets_frames_and_units(spark):
    lines = spark.createDataFrame([("pts=10|dts=N/A|flags=K__",), ("dts=3|flags=___",)], "line string")
    assert [(r["pts"], r["key"]) for r in media.parse_packets(lines).collect()] == [(10, True), (None, False)]
    with pytest.raises(Exception, match="without pts"):
        media.parse_packets(lines, strict=True).collect()
    a, b = X.fraction(F.col("c"))
    assert [(r["a"], r["b"]) for r in spark.createDataFrame([("30000/1001",), ("25",), ("x/2",), (None,)], "c string").select(a.alias("a"), b.alias("b")).collect()] == [(30000, 1001), (0, 0), (0, 2), (0, 0)]
    unit = b"\x00\x00\x00\x01\x09\xf0\x00\x00\x01\x65data"
    short = b"\x00\x00\x01\x09\xf0\x00\x00\x01\x41\x00\x00\x00"
    stream = spark.createDataFrame([(1, bytearray(unit + short + unit))], "video long, stream binary")
    found = [(r["offset"], r["size"]) for r in media.access_units(stream).orderBy("place").collect()]
    at = [0, len(unit), len(unit) + len(short)]
    assert found == [(0, at[1]), (at[1], len(short)), (at[2], len(unit))]
    packets = spark.createDataFrame([(1, i, 1000 * p, 1000 * i, i == 0) for i, p in enumerate((0, 2, 1))], "video long, decode_idx long, pts long, dts long, key boolean")
    records = media.frame_records(packets, media.access_units(stream), F.lit(1000).cast("long"), F.lit(90000).cast("long")).orderBy("decode_idx").collect()
    assert [(r["pts"], r["dts"], r["offset"], r["flags"]) for r in records] == [(0, 0, 0, 1), (180000, 90000, at[1], 0), (90000, 180000, at[2], 0)]
    with pytest.raises(Exception, match="numbers of rows differ"):
        media.frame_records(packets.where("decode_idx < 2"), media.access_units(stream), F.lit(1).cast("long"), F.lit(1).cast("long")).collect()
    with pytest.raises(Exception, match="does not begin"):
        media.access_units(spark.createDataFrame([(1, bytearray(b"x" + unit))], "video long, stream binary")).collect()
