"""Every registered query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from framelore.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    return "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(found):
    return sorted(tuple(plain(r[c]) for c in sorted(r)) for r in found)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    found = registry.QUERIES[name](spark, DATA)
    want = con.execute(registry.SQL[name]).to_arrow_table()
    assert sorted(found.columns) == sorted(want.column_names)
    assert rows(found.toArrow().to_pylist()) == rows(want.to_pylist())


# --- queries without SQL, by plain loops over the collected rows


def folded(rows, *keys):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), []).append(r)
    return out


def test_all_others_are_tested_here():
    assert set(registry.QUERIES) - set(registry.SQL) == {"r_actions", "j_object_tracks", "a_image_signatures", "t_text_sources", "u_stand_in_detections"}


def test_actions(spark):
    import math

    from framelore.plans import fixtures

    want = set()
    for (video, track), obs in folded(fixtures.observations(spark, DATA).collect(), "video", "track").items():
        obs.sort(key=lambda r: r["obs_idx"])
        # the classes vary in these tables: a step is of its first sighting's class, a segment too
        mid = lambda b: (b["x"] + b["w"] / 2, b["y"] + b["h"] / 2)
        dist = [math.dist(mid(p["box"]), mid(q["box"])) for p, q in zip(obs, obs[1:])]
        dt = [max(q["time_sec"] - p["time_sec"], 1e-3) for p, q in zip(obs, obs[1:])]
        walks = [p["class"] in ("view", "click") for p in obs]
        ref = [max((p["box"]["h"] + q["box"]["h"]) / 2, 1e-3) if w else 1.0 for p, q, w in zip(obs, obs[1:], walks)]
        runs, moving = [], False
        for k in range(len(dist)):
            some = range(max(0, k - 1), min(len(dist), k + 2))
            speed = sum(dist[j] for j in some) / sum(dt[j] for j in some) / (sum(ref[j] for j in some) / len(some))
            enter, leave = (0.30, 0.15) if walks[k] else (0.04, 0.015)
            moving = speed >= leave if moving and speed < enter else speed >= enter
            if runs and runs[-1][0] == moving:
                runs[-1][2] = k + 1
            else:
                runs.append([moving, k, k + 1])
        span = lambda r: obs[r[2]]["time_sec"] - obs[r[1]]["time_sec"]
        while len(runs) > 1 and min(map(span, runs)) < 3.0:
            k = min(range(len(runs)), key=lambda i: span(runs[i]))
            near = runs[max(0, k - 1) : k + 2]
            runs[max(0, k - 1) : k + 2] = [[not runs[k][0], near[0][1], near[-1][2]]]
        for m, a, b in runs:
            if obs[b]["time_sec"] - obs[a]["time_sec"] >= 3.0 and obs[a]["class"] in ("view", "click"):
                want.add((video, track, m, obs[a]["time_sec"], obs[b]["time_sec"], round(sum(o["conf"] for o in obs[a : b + 1]) / (b + 1 - a), 9)))
    got = {(r["video"], r["track"], r["action"] == "walking", r["start_sec"], r["end_sec"], round(r["conf"], 9)) for r in registry.QUERIES["r_actions"](spark, DATA).collect()}
    assert got and got == want


def test_object_tracks(spark):
    """Every detection of a track is one of the table's, is used once, and is linked by the rule; none that could link alone is left apart."""
    from framelore.operators import tracking
    from framelore.plans import fixtures

    given = {(r["video"], r["class"], r["frame_id"], round(r["box"]["x"], 9), round(r["box"]["y"], 9)): r for r in fixtures.detections(spark, DATA).collect()}
    found = folded(registry.QUERIES["j_object_tracks"](spark, DATA).collect(), "video", "class", "local")
    import json

    cfg, used = tracking.TrackConfig(), set()
    assert found
    for (video, kind, _), obs in found.items():
        obs.sort(key=lambda r: r["obs_idx"])
        assert len(obs) >= 2 and [o["obs_idx"] for o in obs] == list(range(len(obs)))
        boxes = [tuple(json.loads(o["box"])[k] for k in "xywh") for o in obs]
        for o, b in zip(obs, boxes):
            key = (video, kind, o["frame_id"], round(b[0], 9), round(b[1], 9))
            assert key in given and key not in used
            used.add(key)
        seen = [(o["frame_id"], o["time_sec"], o["conf"], b) for o, b in zip(obs, boxes)]
        for i in range(1, len(seen)):
            assert 0 < seen[i][1] - seen[i - 1][1] <= 3
            import numpy as np

            cost = tracking.link_costs(np.array([seen[i][3]]), seen[i][1], np.array([seen[i - 1][3]]), np.array([tracking._ahead(seen[:i], seen[i][1], cfg)]), cfg)
            assert cost[0, 0] < tracking.FAR / 2


def test_image_signatures_and_text_sources(spark):
    import numpy as np

    pictures = {(r["video"], r["frame_id"]): r for r in registry._pictures(spark, DATA).collect()}
    grids = {}
    for (video, frame), r in pictures.items():
        im = np.frombuffer(bytes(r["rgb"]), np.uint8).reshape(r["height"], r["width"], 3).astype(np.int64)
        level = im @ np.array([299, 587, 114])
        r = {"hist": np.zeros(64), "cells": {}, "level": level}
        for y in range(0, level.shape[0], 4):
            for x in range(0, level.shape[1], 4):
                v = level[y, x] // 1000
                r["hist"][v // 4] += 1
                r["cells"].setdefault((y * 9 // level.shape[0]) * 16 + x * 16 // level.shape[1], []).append(v)
        grids[video, frame] = r
    for r in registry.QUERIES["a_image_signatures"](spark, DATA).collect():
        want = grids[r["video"], r["frame_id"]]
        assert np.allclose(r["hist"], want["hist"] / want["hist"].sum() * 1e6, atol=1) and np.allclose(r["thumb"], [np.mean(want["cells"].get(i, [0])) * 1e6 for i in range(144)], atol=1)
    from framelore.operators import images

    means = {(r["video"], r["frame_id"]): r["grid"] for r in images.cell_means(registry._pictures(spark, DATA)).collect()}
    want = {}
    for video in {v for v, _ in means}:
        last = None
        for frame in sorted(f for v, f in means if v == video):
            now = np.array(means[video, frame], np.float32)
            if last is None or (np.abs(now - last[1]) >= 6).any():
                last = (frame, now)
            want[video, frame] = last[0]
    assert {(r["video"], r["frame_id"]): r["source"] for r in registry.QUERIES["t_text_sources"](spark, DATA).collect()} == want


def test_stand_in_detections(spark):
    """Numbers without a gap in each frame, boxes in it, and as many frames with a region as pictures have a coloured block."""
    found = folded(registry.QUERIES["u_stand_in_detections"](spark, DATA).collect(), "video", "frame_id")
    import json

    assert found
    for rows in found.values():
        assert sorted(r["det_idx"] for r in rows) == list(range(len(rows))) and len(rows) <= 100
        for r in rows:
            b = json.loads(r["box"])
            assert 0 <= b["x"] and 0 <= b["y"] and b["w"] > 0 and b["h"] > 0 and b["x"] + b["w"] <= 1.0001 and b["y"] + b["h"] <= 1.0001
