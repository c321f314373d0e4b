"""All queries of the engine by name, and their SQL where SQL can express them.

The driver's tables are no videos: these queries check the operators' arithmetic; tests/ holds the scenarios.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelore.functions import geometry as G
from framelore.functions import text as X
from framelore.operators import detections as D
from framelore.operators import graph, images, media, motion, relations, sampling, text_events, tracking
from framelore.plans import fixtures as fx
from framelore.plans.fixtures import DET, OBS, PKT, SPANS

FLAGSHIP = "w_motion_segments"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micro(sql: str) -> str:
    return f"CAST(floor(({sql}) * 1e6 + 0.5) AS BIGINT)"


# --- sources and media tables


@query(f"""WITH {PKT}, r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY pts, decode_idx) - 1 AS rank FROM pkt),
d AS (SELECT video, max(decode_idx - rank) AS delay, min(pts) AS first, max(pts) FILTER (rank = 1) - min(pts) AS gap FROM r GROUP BY video)
SELECT r.video, r.decode_idx, r.pts, CAST(coalesce(s.pts, first + (r.decode_idx - delay) * coalesce(gap, 1)) AS BIGINT) AS dts
FROM r JOIN d USING (video) LEFT JOIN r s ON s.video = r.video AND s.rank = r.decode_idx - delay""")
def s_synthesize_dts(spark, sf_dir):
    return media.synthesize_dts(fx.packets(spark, sf_dir))


@query(f"WITH {PKT} SELECT video, decode_idx, pts FROM pkt WHERE key")
def s_key_frames(spark, sf_dir):
    return fx.packets(spark, sf_dir).where("key").select("video", "decode_idx", "pts")


@query(f"WITH {PKT} SELECT video, row_number() OVER (PARTITION BY video ORDER BY pts, decode_idx) - 1 AS frame_id, pts, {_micro('pts * (1.0::DOUBLE / 30000)')} AS micro_sec FROM pkt")
def s_display_frames(spark, sf_dir):
    return media.display_frames(fx.packets(spark, sf_dir), 1 / 30000).select("video", "frame_id", "pts", G.micro(F.col("time_sec")).alias("micro_sec"))


@query("""SELECT o_orderkey, o_orderkey * 1001 AS pts, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey * 1000 END AS dts, 1001::BIGINT AS duration, o_custkey AS size, NULL::BIGINT AS pos, o_orderkey % 5 = 0 AS key FROM orders""")
def s_parse_packets(spark, sf_dir):
    line = F.expr("concat('pts=', o_orderkey * 1001, '|dts=', if(o_orderkey % 7 = 0, 'N/A', cast(o_orderkey * 1000 as string)), '|duration=1001|size=', o_custkey, '|flags=', if(o_orderkey % 5 = 0, 'K__', '___'))")
    return media.parse_packets(_table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line")))


_SECTIONS = "SELECT CAST(o_custkey % 50 AS VARCHAR) AS path, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS idx, CAST(1 + o_orderkey % 3 AS INT) AS type, CAST(o_orderkey % 4 AS INT) AS layer, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey % 1000 END AS start, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey % 1000 + 50 END AS \"end\" FROM orders"


def _sections(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").selectExpr("cast(o_custkey % 50 as string) as path", "o_orderkey")
    place = F.row_number().over(Window.partitionBy("path").orderBy("o_orderkey")) - 1
    return rows.withColumn("idx", place).selectExpr("path", "cast(idx as bigint) as idx", "cast(1 + o_orderkey % 3 as int) as type", "cast(o_orderkey % 4 as int) as layer", "if(o_orderkey % 11 = 0, 0L, o_orderkey % 1000) as start", "if(o_orderkey % 11 = 0, 0L, o_orderkey % 1000 + 50) as `end`")


@query(f"WITH s AS ({_SECTIONS}) SELECT path, min(idx) AS idx FROM s WHERE type = 2 AND layer = 1 GROUP BY path")
def s_find_section(spark, sf_dir):
    return media.find_section(_sections(spark, sf_dir), 2, 1)


@query(f"""WITH s AS ({_SECTIONS}), h AS (SELECT * FROM s WHERE type = 2 AND layer = 1 AND ((start = 0 AND "end" = 0) OR (start <= 250 AND "end" >= 120)))
SELECT path, idx, type, layer, start, "end", CAST(row_number() OVER (PARTITION BY path ORDER BY start, idx) AS INT) AS place FROM h""")
def s_find_range(spark, sf_dir):
    return media.find_range(_sections(spark, sf_dir), 2, 1, 120, 250)


@query(f"""WITH {PKT}, d AS (SELECT video, decode_idx, lead(decode_idx * 1001 + decode_idx // 9 * 7) OVER w - (decode_idx * 1001 + decode_idx // 9 * 7) AS d0 FROM pkt WINDOW w AS (PARTITION BY video ORDER BY decode_idx)),
e AS (SELECT video, decode_idx, coalesce(d0, lag(d0) OVER w, 0) AS d FROM d WINDOW w AS (PARTITION BY video ORDER BY decode_idx)),
f AS (SELECT video, decode_idx, d, CASE WHEN d = lag(d) OVER w THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY video ORDER BY decode_idx)),
g AS (SELECT video, d, CAST(sum(fresh) OVER (PARTITION BY video ORDER BY decode_idx) AS BIGINT) AS run FROM f)
SELECT video, run, count(*) AS frames, max(d) AS duration FROM g GROUP BY video, run""")
def w_duration_runs(spark, sf_dir):
    return media.duration_runs(fx.packets(spark, sf_dir).withColumn("dts", F.expr("decode_idx * 1001 + decode_idx div 9 * 7")))


@query(f"WITH {PKT} SELECT video, min(pts) AS first_pts, max(pts) AS last_pts, max(pts + dur) AS end_pts, CAST(count(*) FILTER (key) AS BIGINT) AS keys, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS frames FROM pkt GROUP BY video")
def a_pixel_summary(spark, sf_dir):
    return media.pixel_summary(fx.packets(spark, sf_dir))


@query(f"""WITH {PKT}, probes AS (SELECT o_orderkey % 40 AS video, o_orderkey AS probe, o_custkey * 37 - 5000 AS t FROM orders)
SELECT p.video, p.probe, p.t, coalesce(max_by(k.decode_idx, (k.pts, k.decode_idx)), 0) AS decode_idx FROM probes p LEFT JOIN pkt k ON k.video = p.video AND k.pts <= p.t GROUP BY ALL""")
def j_frame_at(spark, sf_dir):
    probes = _table(spark, sf_dir, "orders").selectExpr("o_orderkey % 40 as video", "o_orderkey as probe", "o_custkey * 37 - 5000 as t")
    return media.frame_at(fx.packets(spark, sf_dir), probes)


@query(f"WITH {PKT} SELECT video, decode_idx, decode_idx // 12 * 12 AS seek FROM pkt")
def j_seek_key(spark, sf_dir):
    return media.seek_key(fx.packets(spark, sf_dir)).select("video", "decode_idx", "seek")


@query("SELECT o_orderpriority AS stage, count(*) AS runs, CAST(floor(avg(o_custkey) * 1e6 + 0.5) AS BIGINT) AS wall, CAST(sum(o_orderkey) AS BIGINT) AS bytes_in, CAST(sum(o_custkey) AS BIGINT) AS bytes_out FROM orders GROUP BY 1")
def a_stage_costs(spark, sf_dir):
    log = _table(spark, sf_dir, "orders").selectExpr("o_orderpriority as stage", "cast(o_custkey as double) as wall_ms", "o_orderkey as bytes_in", "o_custkey as bytes_out")
    return media.stage_costs(log).select("stage", "runs", G.micro(F.col("wall_ms")).alias("wall"), "bytes_in", "bytes_out")


@query("SELECT p_partkey, CASE WHEN p_size * 3 > p_partkey % 100 THEN CAST(ceil(CAST(p_partkey AS DOUBLE) / (p_size * 3 - p_partkey % 100)) AS BIGINT) END AS break_even FROM part")
def q_break_even(spark, sf_dir):
    costs = _table(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey as encode", "p_partkey % 100 as query", "p_size * 3 as baseline")
    return media.break_even(costs).select("p_partkey", "break_even")


@query("SELECT l_orderkey, l_linenumber, p AND q AS copy, CAST(CASE WHEN l_linenumber = 1 THEN 12800 ELSE 90000 END AS INT) AS timescale FROM (SELECT *, l_returnflag = 'A' AS p, l_linestatus = 'F' AS q FROM lineitem)")
def p_pixel_mode(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "if(l_returnflag = 'A', 'h264', 'hevc') as codec", "if(l_linestatus = 'F', 'yuv420p', 'yuv444p') as pix")
    copy, scale = media.choose_mode(F.col("codec"), F.col("pix"), F.col("l_linenumber"), F.lit(12800))
    return rows.select("l_orderkey", "l_linenumber", copy.alias("copy"), scale.alias("timescale"))


# --- filters and scalar functions


@query(f"WITH {DET} SELECT video, frame_id, det_idx, class FROM det WHERE conf >= 0.6 AND w * h > 0")
def p_usable_detections(spark, sf_dir):
    return D.usable(fx.detections(spark, sf_dir), 0.6).select("video", "frame_id", "det_idx", "class")


@query(f"""WITH {DET}, r AS (SELECT video, frame_id, det_idx, row_number() OVER (PARTITION BY video, frame_id ORDER BY conf DESC, det_idx) AS place FROM det WHERE conf >= 0.35 AND class IN ('click', 'view', 'purchase'))
SELECT video, frame_id, det_idx, CAST(place AS INT) AS place FROM r WHERE place <= 2""")
def p_limited_detections(spark, sf_dir):
    return D.limited(fx.detections(spark, sf_dir), ["click", "view", "purchase"], most=2).select("video", "frame_id", "det_idx", "place")


@query("""WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '  ' || text || ' ' WHEN 1 THEN ' ' || chr(9) ELSE text END AS raw FROM conversations)
SELECT conv_id, turn, trim(raw, ' ' || chr(9) || chr(10)) AS text FROM t WHERE length(trim(raw, ' ' || chr(9) || chr(10))) >= 2""")
def p_usable_lines(spark, sf_dir):
    raw = F.expr("case turn % 3 when 0 then concat('  ', text, ' ') when 1 then concat(' ', char(9)) else text end")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("text"), F.lit(0.9).alias("conf"), G.box(F.lit(0.1), F.lit(0.1), F.lit(0.5), F.lit(0.1)).alias("box"))
    return D.usable_lines(rows).select("conv_id", "turn", "text")


@query(f"WITH {DET} SELECT det_idx, x <= 0.05 OR x + w >= 0.95 AS lr, x <= 0.1 OR x + w >= 0.9 OR y <= 0.1 OR y + h >= 0.9 AS all_sides, x + w <= 1.0001 AND y + h <= 1.0001 AS valid FROM det")
def p_boxes(spark, sf_dir):
    b = F.col("box")
    return fx.detections(spark, sf_dir).select("det_idx", G.at_edge(b).alias("lr"), G.at_edge(b, 0.1, "lrtb").alias("all_sides"), G.valid(b).alias("valid"))


_HELD = "apple,backpack,banana,baseball bat,book,bottle,cake,cell phone,cup,donut,fork,frisbee,handbag,knife,mouse,orange,remote,sandwich,scissors,skateboard,spoon,sports ball,suitcase,teddy bear,tennis racket,toothbrush,umbrella,wine glass"
_CLASSES = f"{_HELD},tie,bowl,carrot,laptop,baseball glove,person,chair,dining table"


@query(f"WITH c AS (SELECT unnest(string_split('{_CLASSES}', ',')) AS class), h AS (SELECT unnest(string_split('{_HELD}', ',')) AS class) SELECT p_partkey, class, class IN (SELECT class FROM h) AS holdable FROM part, c")
def p_class_list(spark, sf_dir):
    """Every class of the list, and others, for every part."""
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(F.lit(_CLASSES), ",")).alias("class"))
    return rows.select("p_partkey", "class", F.col("class").isin(D.HOLDABLE).alias("holdable"))


@query("SELECT c_custkey, replace(lower(trim(c_mktsegment)), ' ', '_') || '_' || CASE WHEN c_custkey % 120 < 10 THEN '0' ELSE '' END || (c_custkey % 120) AS label FROM customer")
def p_labels(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", X.label(F.col("c_mktsegment"), F.col("c_custkey") % 120).alias("label"))


@query(f"""WITH {DET}, p AS (SELECT a.det_idx AS a, b.det_idx AS b, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS bby, b.w AS bw, b.h AS bh FROM det a JOIN det b ON b.det_idx = a.det_idx + 7),
i AS (SELECT *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, bby + bh) - greatest(ay, bby)) AS inter FROM p)
SELECT a, b, {_micro('aw * ah')} AS area, {_micro('sqrt(aw * aw + ah * ah)')} AS diag, {_micro('inter')} AS inter, {_micro('inter / (aw * ah + bw * bh - inter)')} AS iou,
 {_micro('sqrt((ax + aw / 2 - (bx + bw / 2)) * (ax + aw / 2 - (bx + bw / 2)) + (ay + ah / 2 - (bby + bh / 2)) * (ay + ah / 2 - (bby + bh / 2)))')} AS apart,
 {_micro('greatest(ax + aw, bx + bw) - least(ax, bx)')} AS union_w, {_micro('greatest(abs(ax - bx), abs(ay - bby), abs(aw - bw), abs(ah - bh))')} AS change FROM i""")
def f_geometry(spark, sf_dir):
    rows = fx.detections(spark, sf_dir)
    both = rows.select(F.col("det_idx").alias("a"), F.col("box").alias("p")).join(rows.select(F.col("det_idx").alias("b"), F.col("box").alias("q")), F.col("b") == F.col("a") + 7)
    p, q = F.col("p"), F.col("q")
    values = {"area": G.area(p), "diag": G.diag(p), "inter": G.intersection(p, q), "iou": G.iou(p, q), "apart": G.center_distance(p, q), "union_w": G.union(p, q)["w"], "change": G.change(p, q)}
    return both.select("a", "b", *[G.micro(v).alias(k) for k, v in values.items()])


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS text FROM conversations")
def f_normalize(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", X.normalize(F.col("text")).alias("text"))


@query(f"""WITH n AS (SELECT p_partkey AS k, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM part)
SELECT a.k, {_micro('1 - levenshtein(a.t, b.t)::DOUBLE / greatest(length(a.t), length(b.t))')} AS similarity FROM n a JOIN n b ON b.k = a.k + 1""")
def f_similarity(spark, sf_dir):
    rows = _table(spark, sf_dir, "part")
    both = rows.selectExpr("p_partkey as k", "p_name as a").join(rows.selectExpr("p_partkey - 1 as k", "p_name as b"), "k")
    return both.select("k", G.micro(X.similarity(F.col("a"), F.col("b"))).alias("similarity"))


@query("SELECT event_id, CAST(floor(((event_id - 5000) * 90000 * 2 + 1001) / (1001 * 2.0)) AS BIGINT) AS up, CAST(sign(event_id - 5000) * floor((abs(event_id - 5000) * 90000 * 2 + 1001) / (1001 * 2.0)) AS BIGINT) AS even FROM events")
def f_rescale(spark, sf_dir):
    t, a, b = F.col("event_id") - 5000, F.lit(1001).cast("long"), F.lit(90000).cast("long")
    return _table(spark, sf_dir, "events").select("event_id", X.rescale(t, a, b).alias("up"), X.rescale(t, a, b, True).alias("even"))


@query("""WITH s AS (SELECT doc_id, doc_id % 7 AS a, doc_id % 11 AS b, doc_id % 13 AS c, lag(doc_id) OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) AS p FROM documents)
SELECT doc_id, abs(a - p % 7) + abs(b - p % 11) + abs(c - p % 13) AS hist2, abs(a - p % 7) + abs(b - p % 11) + abs(c - p % 13) AS l1 FROM s WHERE p IS NOT NULL""")
def f_signature_scores(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").selectExpr("doc_id % 16 as video", "doc_id as frame_id", "cast(doc_id as double) as time_sec", "cast(array(doc_id % 7, doc_id % 11, doc_id % 13, 5) as array<double>) as hist", "cast(array(doc_id % 7, doc_id % 11, doc_id % 13, 5) as array<double>) as thumb")
    out = sampling.signature_scores(rows).where("hist_score is not null")
    return out.select(F.col("frame_id").alias("doc_id"), F.round(F.col("hist_score") * 2).cast("long").alias("hist2"), F.round(F.col("mad_score") * 4 * 255).cast("long").alias("l1"))


# --- tracks and motion


@query(f"""WITH {OBS}, m AS (SELECT video, track, count(*) AS hits, min(frame_id) AS first, max(frame_id) AS last, arg_max(obs_idx, (milli_conf, -obs_idx)) AS best_idx, max(milli_conf) AS best FROM obs GROUP BY video, track)
SELECT video, track, hits, first, last, last - first AS duration, best_idx, best FROM m WHERE hits >= 2""")
def a_lifetimes(spark, sf_dir):
    out = D.lifetimes(fx.observations(spark, sf_dir))
    return out.select("video", "track", "hits", F.col("first_sec").cast("long").alias("first"), F.col("last_sec").cast("long").alias("last"), F.col("duration").cast("long").alias("duration"), F.col("best_idx").cast("long").alias("best_idx"), F.round(F.col("best_conf") * 100).cast("long").alias("best"))


@query(f"""WITH {OBS}, t AS (SELECT video, track, class, frame_id, x FROM obs WHERE obs_idx = 0), n AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame_id, class, x, track) AS entity_id, row_number() OVER (PARTITION BY video, class ORDER BY frame_id, class, x, track) AS seq FROM t)
SELECT video, track, CAST(entity_id AS INT) AS entity_id, CAST(seq AS INT) AS seq, lower(class) || '_' || lpad(CAST(seq AS VARCHAR), CAST(greatest(2, length(CAST(seq AS VARCHAR))) AS INT), '0') AS name FROM n""")
def a_entity_numbers(spark, sf_dir):
    first = fx.observations(spark, sf_dir).where("obs_idx = 0").selectExpr("video", "track", "class", "time_sec as first_sec", "box.x as first_x")
    return D.numbered_entities(first).select("video", "track", "entity_id", "seq", "name")


@query(f"""WITH {OBS}, v AS (SELECT video, track, class AS text, sum(milli_conf) AS weight, count(*) AS n, arg_max(obs_idx, (milli_conf, -obs_idx)) AS best_idx FROM obs GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY video, track ORDER BY weight DESC, strlen(text) DESC, text) AS place FROM v)
SELECT video, track, text, CAST(weight AS BIGINT) AS weight, n, best_idx, {_micro('CAST(weight AS DOUBLE) / n')} AS mean FROM r WHERE place = 1""")
def a_text_consensus(spark, sf_dir):
    rows = fx.observations(spark, sf_dir).selectExpr("video", "track", "cast(obs_idx as bigint) as obs_idx", "class as text", "milli_conf as conf")
    return D.consensus(rows).select("video", "track", "text", "weight", "n", "best_idx", G.micro(F.col("mean_conf")).alias("mean"))


_STEPS = OBS + """, s0 AS (SELECT video, track, obs_idx, time_sec, lead(time_sec) OVER o AS next_sec, sqrt((x + w / 2 - (lead(x) OVER o + lead(w) OVER o / 2)) * (x + w / 2 - (lead(x) OVER o + lead(w) OVER o / 2)) + (y + h / 2 - (lead(y) OVER o + lead(h) OVER o / 2)) * (y + h / 2 - (lead(y) OVER o + lead(h) OVER o / 2))) AS dist,
 greatest(lead(time_sec) OVER o - time_sec, 0.001::DOUBLE) AS dt, (h + lead(h) OVER o) / 2 AS ref FROM obs WINDOW o AS (PARTITION BY video, track ORDER BY obs_idx)),
s AS (SELECT *, sum(dist) OVER n / sum(dt) OVER n / avg(ref) OVER n AS speed FROM s0 WHERE next_sec IS NOT NULL WINDOW n AS (PARTITION BY video, track ORDER BY obs_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""
_SEGMENTS = _STEPS + """, g AS (SELECT *, coalesce(last_value(CASE WHEN speed >= 0.30 THEN true WHEN speed < 0.15 THEN false END IGNORE NULLS) OVER (PARTITION BY video, track ORDER BY obs_idx ROWS UNBOUNDED PRECEDING), false) AS moving FROM s),
c AS (SELECT *, CASE WHEN moving <> lag(moving) OVER (PARTITION BY video, track ORDER BY obs_idx) THEN 1 ELSE 0 END AS turn FROM g),
e AS (SELECT *, CAST(sum(turn) OVER (PARTITION BY video, track ORDER BY obs_idx) AS BIGINT) AS segment FROM c)"""


@query(f"WITH {_STEPS} SELECT video, track, obs_idx, {_micro('dist')} AS dist, {_micro('dt')} AS dt, {_micro('speed')} AS speed FROM s")
def w_motion_steps(spark, sf_dir):
    out = motion.steps(fx.observations(spark, sf_dir))
    return out.select("video", "track", F.col("obs_idx").cast("long").alias("obs_idx"), *[G.micro(F.col(c)).alias(c) for c in ("dist", "dt", "speed")])


@query(f"WITH {_SEGMENTS} SELECT video, track, segment, moving, min(obs_idx) AS start_idx, max(obs_idx) + 1 AS end_idx, CAST(min(time_sec) AS BIGINT) AS start_sec, CAST(max(next_sec) AS BIGINT) AS end_sec FROM e GROUP BY video, track, segment, moving")
def w_motion_segments(spark, sf_dir):
    out = motion.raw_segments(motion.steps(fx.observations(spark, sf_dir)))
    return out.select("video", "track", "segment", "moving", *[F.col(c).cast("long").alias(c) for c in ("start_idx", "end_idx", "start_sec", "end_sec")])


@query()
def r_actions(spark, sf_dir):
    cfg = motion.MotionConfig(classes=("view", "click"), min_segment_seconds=3.0)
    return motion.actions(fx.observations(spark, sf_dir), cfg).withColumn("box", F.to_json("box"))


_WALKS = _SEGMENTS.replace("(h + lead(h) OVER o) / 2 AS ref", "CASE WHEN track % 2 = 0 THEN greatest((h + lead(h) OVER o) / 2, 0.001) ELSE 1.0 END AS ref").replace("speed >= 0.30", "speed >= CASE WHEN track % 2 = 0 THEN 0.30 ELSE 0.04 END").replace("speed < 0.15", "speed < CASE WHEN track % 2 = 0 THEN 0.15 ELSE 0.015 END") + """,
r AS (SELECT video, track, segment, moving, min(obs_idx) AS a, max(obs_idx) + 1 AS b, min(time_sec) AS start_sec, max(next_sec) AS end_sec FROM e GROUP BY ALL),
m AS (SELECT r.video, r.track, segment, moving, start_sec, end_sec, avg(o.conf) AS conf, arg_min(o.frame_id, o.obs_idx) AS frame_id, arg_min(o.x, o.obs_idx) AS ax, arg_min(o.y, o.obs_idx) AS ay, arg_min(o.w, o.obs_idx) AS aw, arg_min(o.h, o.obs_idx) AS ah,
 arg_max(o.x, o.obs_idx) AS bx, arg_max(o.y, o.obs_idx) AS bby, arg_max(o.w, o.obs_idx) AS bw, arg_max(o.h, o.obs_idx) AS bh FROM r JOIN obs o ON o.video = r.video AND o.track = r.track AND o.obs_idx BETWEEN r.a AND r.b GROUP BY ALL)"""


def _walkers(spark, sf_dir):
    """Every other track walks; segments of any length count, so that none is absorbed."""
    rows = fx.observations(spark, sf_dir).withColumn("class", F.expr("if(track % 2 = 0, 'person', 'chair')"))
    return rows, motion.MotionConfig(min_segment_seconds=0.0)


@query(f"WITH {_WALKS} SELECT video, track, CASE WHEN moving THEN 'walking' ELSE 'standing' END AS action, CAST(start_sec AS BIGINT) AS start_sec, CAST(end_sec AS BIGINT) AS end_sec, frame_id, CAST(round(conf * 1e9) AS BIGINT) AS conf, {_micro('ax')} AS x FROM m WHERE track % 2 = 0")
def r_walks(spark, sf_dir):
    out = motion.actions(*_walkers(spark, sf_dir))
    return out.select("video", "track", "action", F.col("start_sec").cast("long").alias("start_sec"), F.col("end_sec").cast("long").alias("end_sec"), "frame_id", F.round(F.col("conf") * 1e9).cast("long").alias("conf"), G.micro(F.col("box.x")).alias("x"))


@query(f"""WITH {_WALKS}, d AS (SELECT *, sqrt((ax + aw / 2 - (bx + bw / 2)) * (ax + aw / 2 - (bx + bw / 2)) + (ay + ah / 2 - (bby + bh / 2)) * (ay + ah / 2 - (bby + bh / 2))) AS far FROM m WHERE track % 2 = 1 AND moving)
SELECT video, track, 'object_moved' AS type, CAST(start_sec AS BIGINT) AS start_sec, CAST(end_sec AS BIGINT) AS end_sec, frame_id, {_micro('least(ax, bx)')} AS x, {_micro('greatest(ax + aw, bx + bw) - least(ax, bx)')} AS w FROM d WHERE far >= 0.03""")
def r_object_moves(spark, sf_dir):
    out = motion.object_moves(*_walkers(spark, sf_dir))
    return out.select("video", "track", "type", F.col("start_sec").cast("long").alias("start_sec"), F.col("end_sec").cast("long").alias("end_sec"), "frame_id", G.micro(F.col("region.x")).alias("x"), G.micro(F.col("region.w")).alias("w"))


# --- relations


_PAIRS = DET + ", sub AS (SELECT * FROM det WHERE class IN ('click', 'view')), one AS (SELECT video, frame_id, track, class, x, y, w, h, time_sec FROM det QUALIFY row_number() OVER (PARTITION BY video, frame_id, track ORDER BY det_idx) = 1), pr AS (SELECT a.video, a.frame_id, a.time_sec, a.track AS s, b.track AS o, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS bby, b.w AS bw, b.h AS bh FROM one a JOIN one b USING (video, frame_id) WHERE a.class IN ('click', 'view') AND a.track <> b.track AND (b.class NOT IN ('click', 'view') OR a.track < b.track))"


def _sightings(spark, sf_dir):
    rows = fx.detections(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("video", "frame_id", "track").orderBy("det_idx"))
    return rows.withColumn("place", place).where("place = 1").drop("place")


@query(f"""WITH {_PAIRS}, d AS (SELECT video, time_sec, s, o, sqrt((ax + aw / 2 - (bx + bw / 2)) * (ax + aw / 2 - (bx + bw / 2)) + (ay + ah / 2 - (bby + bh / 2)) * (ay + ah / 2 - (bby + bh / 2))) / (sqrt(aw * aw + ah * ah) / 2 + sqrt(bw * bw + bh * bh) / 2) AS d FROM pr),
k AS (SELECT *, {_micro('greatest(0, 1 - d / 1.4)')} AS score FROM d WHERE d <= 1.4), fr AS (SELECT video, time_sec, lag(time_sec) OVER (PARTITION BY video ORDER BY time_sec) AS prev_sec FROM (SELECT DISTINCT video, time_sec FROM one)),
i AS (SELECT k.*, CASE WHEN prev_sec - lag(k.time_sec) OVER w > 30 THEN 1 WHEN lag(k.time_sec) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM k JOIN fr USING (video, time_sec) WINDOW w AS (PARTITION BY video, s, o ORDER BY k.time_sec)),
j AS (SELECT *, sum(fresh) OVER (PARTITION BY video, s, o ORDER BY time_sec) AS island FROM i), l AS (SELECT *, max(CASE WHEN d <= 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY video, s, o, island ORDER BY time_sec ROWS UNBOUNDED PRECEDING) AS is_on FROM j),
m AS (SELECT video, s AS subject, o AS object, count(*) AS hits, CAST(min(time_sec) AS BIGINT) AS start_sec, CAST(max(time_sec) AS BIGINT) AS end_sec, CAST(sum(score) AS BIGINT) AS score_sum FROM l WHERE is_on = 1 GROUP BY video, s, o, island HAVING count(*) >= 2)
SELECT *, CAST(row_number() OVER (PARTITION BY video ORDER BY start_sec, subject, object) AS INT) AS relation_id FROM m""")
def w_near_relations(spark, sf_dir):
    out = relations.near_relations(_sightings(spark, sf_dir), ["click", "view"], gap=30.0)
    return out.select("video", "subject", "object", "hits", F.col("start_sec").cast("long").alias("start_sec"), F.col("end_sec").cast("long").alias("end_sec"), "score_sum", "relation_id")


@query(f"""WITH {_PAIRS}, k AS (SELECT video, time_sec, s, o, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, bby + bh) - greatest(ay, bby)) / (bw * bh) AS sc, aw * ah AS aa, bw * bh AS ba FROM pr)
SELECT video, CAST(time_sec AS BIGINT) AS time_sec, s AS subject, o AS object, sc >= 0.3 AS keep, sc >= 0.5 AS enter, {_micro('sc')} AS score FROM k WHERE ba / aa <= 0.9""")
def r_holding(spark, sf_dir):
    paired = relations.pairs(_sightings(spark, sf_dir), ["click", "view"]).withColumn("subject_class", F.lit("person")).withColumn("object_class", F.lit("cup"))
    return relations.holding(paired, area=0.9).select("video", F.col("time_sec").cast("long").alias("time_sec"), "subject", "object", "keep", "enter", "score")


# --- events, shots, graph queries


@query(f"""WITH {OBS}, t AS (SELECT video, track, arg_min(class, obs_idx) AS class, min(time_sec) AS f, max(time_sec) AS l, arg_min(x, obs_idx) AS fx, arg_min(w, obs_idx) AS fw, arg_max(x, obs_idx) AS lx, arg_max(w, obs_idx) AS lw FROM obs GROUP BY video, track),
st AS (SELECT video, min(time_sec) AS a, max(time_sec) AS b FROM det GROUP BY video)
SELECT video, track, class || CASE WHEN fx <= 0.05 OR fx + fw >= 0.95 THEN '_entered' ELSE '_appeared' END AS type, CAST(f AS BIGINT) AS sec FROM t JOIN st USING (video) WHERE f - a > 2
UNION ALL SELECT video, track, class || CASE WHEN lx <= 0.05 OR lx + lw >= 0.95 THEN '_left' ELSE '_disappeared' END, CAST(l AS BIGINT) FROM t JOIN st USING (video) WHERE b - l > 2""")
def r_edge_events(spark, sf_dir):
    obs = fx.observations(spark, sf_dir)
    ends = obs.groupBy("video", "track").agg(F.min_by("class", "obs_idx").alias("class"), F.min("time_sec").alias("first_sec"), F.max("time_sec").alias("last_sec"), F.min_by("box", "obs_idx").alias("first_box"), F.max_by("box", "obs_idx").alias("last_box"))
    streams = obs.groupBy("video").agg(F.min("time_sec").alias("start_sec"), F.max("time_sec").alias("end_sec"))
    return graph.edge_events(ends, streams).select("video", "track", "type", F.col("sec").cast("long").alias("sec"))


def _frames(spark, sf_dir):
    rows = fx.detections(spark, sf_dir).select("video", "frame_id").distinct()
    return rows.selectExpr("video", "frame_id", "frame_id * 1000 as ticks", "cast(frame_id as double) as time_sec", "if(frame_id % 50 = 7, 'scene', 'interval') as reason")


_FRAMES = DET + ", fr AS (SELECT DISTINCT video, frame_id, frame_id * 1000 AS ticks, CASE WHEN frame_id % 50 = 7 THEN 'scene' ELSE 'interval' END AS reason FROM det)"


@query(f"""WITH {_FRAMES}, f AS (SELECT *, min(ticks) OVER (PARTITION BY video) AS first, max(ticks) OVER (PARTITION BY video) + 1000 AS fin FROM fr), s AS (SELECT * FROM f WHERE ticks = first OR (reason = 'scene' AND ticks > first)),
n AS (SELECT video, CAST(row_number() OVER w AS INT) AS shot, ticks AS start, coalesce(lead(ticks) OVER w, fin) AS "end", frame_id FROM s WINDOW w AS (PARTITION BY video ORDER BY ticks))
SELECT *, 'shot_' || lpad(CAST(shot AS VARCHAR), CAST(greatest(2, length(CAST(shot AS VARCHAR))) AS INT), '0') AS label FROM n""")
def w_shots(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    return graph.shots(frames, frames.groupBy("video").agg((F.max("ticks") + 1000).alias("end_ticks")))


@query(f"WITH {_FRAMES} SELECT video, 'scene_changed' AS type, ticks AS start, ticks AS \"end\", frame_id FROM fr WHERE reason = 'scene'")
def r_scene_events(spark, sf_dir):
    return graph.scene_events(_frames(spark, sf_dir))


@query(f"""WITH {SPANS}, p AS (SELECT o_orderkey % 8 AS video, o_orderkey AS probe, o_custkey % 2000 AS t FROM orders) SELECT p.video, probe, t, id FROM p JOIN spans s ON s.video = p.video AND s.start <= t AND t <= s."end" """)
def j_active_at(spark, sf_dir):
    probes = _table(spark, sf_dir, "orders").selectExpr("o_orderkey % 8 as video", "o_orderkey as probe", "o_custkey % 2000 as t")
    return graph.active_at(fx.spans(spark, sf_dir), probes, 64).select("video", "probe", "t", "id")


_SETS = SPANS + """, pts AS (SELECT video, start AS t FROM spans UNION SELECT video, "end" + 1 FROM spans), st AS (SELECT video, t AS t0, lead(t) OVER (PARTITION BY video ORDER BY t) AS t1 FROM pts),
a AS (SELECT st.video, t0, t1, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id), '') AS ids FROM st LEFT JOIN spans s ON s.video = st.video AND s.start <= t0 AND t0 <= s."end" WHERE t1 IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {_SETS} SELECT * FROM a")
def a_active_sets(spark, sf_dir):
    return graph.active_sets(fx.spans(spark, sf_dir)).select("video", "t0", "t1", F.concat_ws(",", "ids").alias("ids"))


@query(f"WITH {_SETS} SELECT * FROM a WHERE ids <> ''")
def j_rebuilt_states(spark, sf_dir):
    blocks = graph.state_blocks(graph.active_sets(fx.spans(spark, sf_dir)), 100)
    return graph.rebuilt_sets(blocks).select("video", "t0", "t1", F.concat_ws(",", "ids").alias("ids"))


_LISTS = _SETS.replace("coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id), '') AS ids", "coalesce(list(id ORDER BY id) FILTER (id IS NOT NULL), []) AS ids")


@query(f"""WITH RECURSIVE {_LISTS}, s AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t0) AS n FROM a),
f AS (SELECT video, n, t0, t1, ids, CASE WHEN len(ids) > 0 THEN t0 END AS base, ids AS held FROM s WHERE n = 1
 UNION ALL SELECT s.video, s.n, s.t0, s.t1, s.ids, CASE WHEN len(s.ids) = 0 THEN NULL WHEN f.base IS NULL OR s.t0 - f.base >= 100 THEN s.t0 ELSE f.base END, CASE WHEN f.base IS NULL OR s.t0 - f.base >= 100 THEN s.ids ELSE f.held END FROM f JOIN s ON s.video = f.video AND s.n = f.n + 1)
SELECT video, CASE WHEN base = t0 THEN 'KEY' ELSE 'DELTA' END AS kind, t0, t1, CASE WHEN base <> t0 THEN base END AS base_t, CASE WHEN base = t0 THEN array_to_string(ids, ',') ELSE '' END AS ids,
 CASE WHEN base <> t0 THEN array_to_string([x for x in ids if NOT list_contains(held, x)], ',') ELSE '' END AS added, CASE WHEN base <> t0 THEN array_to_string([x for x in held if NOT list_contains(ids, x)], ',') ELSE '' END AS removed FROM f WHERE base IS NOT NULL""")
def t_state_blocks(spark, sf_dir):
    blocks = graph.state_blocks(graph.active_sets(fx.spans(spark, sf_dir)), 100)
    return blocks.select("video", "kind", "t0", "t1", "base_t", *[F.concat_ws(",", c).alias(c) for c in ("ids", "added", "removed")])


@query(f"""WITH {SPANS}, ev AS (SELECT user_id % 8 AS video, event_id AS t, event_type AS type, user_id AS e1, (user_id + 8) AS e2 FROM events), rel AS (SELECT video, id AS subject, id + 8 AS object, start, "end", 'near' AS name FROM spans),
u AS (SELECT video, id AS entity, 'appears' AS kind, 0 AS rank, start, start AS "end", 'appears' AS label, NULL::BIGINT AS other FROM spans UNION ALL SELECT video, id, 'leaves', 4, "end", "end", 'leaves', NULL FROM spans
UNION ALL SELECT video, e1, 'event', 1, t, t, type, NULL FROM ev UNION ALL SELECT video, e2, 'event', 1, t, t, type, NULL FROM ev UNION ALL SELECT video, id, 'action', 2, start, "end", 'standing', NULL FROM spans
UNION ALL SELECT video, subject, 'relation', 3, start, "end", name, object FROM rel UNION ALL SELECT video, object, 'relation', 3, start, "end", 'inverse ' || name, subject FROM rel)
SELECT video, entity, kind, start, "end", label, other, CAST(row_number() OVER (PARTITION BY video, entity ORDER BY start, rank, label, other NULLS FIRST, "end") AS INT) AS place FROM u""")
def u_timeline(spark, sf_dir):
    spans = fx.spans(spark, sf_dir)
    lives = spans.selectExpr("video", "id as entity", "start as first", "`end` as last")
    events = _table(spark, sf_dir, "events").selectExpr("user_id % 8 as video", "event_id as start", "event_id as `end`", "event_type as type", "array(user_id, user_id + 8, user_id) as entities")
    acts = spans.selectExpr("video", "id as entity", "start", "`end`", "'standing' as name")
    rels = spans.selectExpr("video", "id as subject", "id + 8 as object", "start", "`end`", "'near' as name")
    return graph.timeline(lives, events, acts, rels)


@query("SELECT o_orderkey AS block, o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def j_dangling_references(spark, sf_dir):
    refs = _table(spark, sf_dir, "orders").selectExpr("0L as video", "o_orderkey as block", "o_custkey as id")
    known = _table(spark, sf_dir, "customer").where("c_acctbal >= 0").selectExpr("0L as video", "c_custkey as id")
    return graph.dangling(refs, known).select("block", "id")


@query(f"WITH {DET} SELECT class, CAST(layer AS INT) AS layer, count(*) AS blocks FROM (SELECT class, CASE class WHEN 'click' THEN 3 WHEN 'view' THEN 1 ELSE 2 END AS layer FROM det) GROUP BY ALL")
def u_layers(spark, sf_dir):
    from framelore.operators import document

    kinds = {"click": "text", "view": "entity"}
    rows = fx.detections(spark, sf_dir).withColumn("block", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.col("class")), F.lit("event")))
    return document.with_layer(rows, F.col("block")).groupBy("class", "layer").agg(F.count(F.lit(1)).alias("blocks"))


@query(f"""WITH {DET} SELECT det_idx, rule FROM (SELECT det_idx, CASE WHEN x + w > 1.0001 OR y + h > 1.0001 THEN 'box' END AS rule FROM det UNION ALL SELECT det_idx, CASE WHEN conf > 0.95 THEN 'confidence' END FROM det UNION ALL SELECT det_idx, CASE WHEN frame_id % 97 > 90 THEN 'times' END FROM det UNION ALL SELECT det_idx, CASE WHEN det_idx % 41 = 0 THEN 'empty name' END FROM det) WHERE rule IS NOT NULL""")
def p_violations(spark, sf_dir):
    from framelore.operators import document

    rows = fx.detections(spark, sf_dir).selectExpr("det_idx", "if(det_idx % 41 = 0, ' ', class) as name", "box", "if(conf > 0.95, conf + 1, conf) as confidence", "frame_id as start", "if(frame_id % 97 > 90, frame_id - 1, frame_id) as `end`")
    return document.violations(rows, "det_idx")


# --- samplers


@query(f"WITH {DET}, f AS (SELECT DISTINCT video, frame_id FROM det), n AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame_id) - 1 AS i FROM f) SELECT video, frame_id, CASE WHEN i = 0 THEN 'first' ELSE 'interval' END AS reason FROM n WHERE i % 30 = 0")
def t_every_n(spark, sf_dir):
    return sampling.every_n(_frames(spark, sf_dir).drop("reason")).select("video", "frame_id", "reason")


@query(f"WITH {DET}, f AS (SELECT video, frame_id // 24 AS b, min(frame_id) AS frame_id FROM det GROUP BY ALL) SELECT video, frame_id, CASE WHEN row_number() OVER (PARTITION BY video ORDER BY b) = 1 THEN 'first' ELSE 'interval' END AS reason FROM f")
def t_every_seconds(spark, sf_dir):
    return sampling.every_seconds(_frames(spark, sf_dir).drop("reason"), 24.0).select("video", "frame_id", "reason")


@query("""WITH RECURSIVE g AS (SELECT doc_id % 16 AS video, doc_id AS frame_id, doc_id::DOUBLE / 480 AS t, (doc_id % 5)::DOUBLE / 4 AS h, (doc_id % 64)::DOUBLE AS m FROM documents),
s AS (SELECT *, abs(h - lag(h) OVER w) AS hs, abs(m - lag(m) OVER w) / 255 AS ms, row_number() OVER w AS n FROM g WINDOW w AS (PARTITION BY video ORDER BY t, frame_id)),
f AS (SELECT video, n, frame_id, t AS last, 'first' AS reason FROM s WHERE n = 1 UNION ALL SELECT s.video, s.n, s.frame_id, CASE WHEN (hs >= 0.35 OR ms >= 0.12) AND t - last >= 0.25 OR t - last >= 2 THEN t ELSE last END,
 CASE WHEN (hs >= 0.35 OR ms >= 0.12) AND t - last >= 0.25 THEN 'scene' WHEN t - last >= 2 THEN 'max_gap' END FROM f JOIN s ON s.video = f.video AND s.n = f.n + 1)
SELECT video, frame_id, reason FROM f WHERE reason IS NOT NULL""")
def t_scene_changes(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").selectExpr("doc_id % 16 as video", "doc_id as frame_id", "cast(doc_id as double) / 480 as time_sec", "array(cast(doc_id % 5 as double) / 4, 1 - cast(doc_id % 5 as double) / 4) as hist", "array(cast(doc_id % 64 as double)) as thumb")
    return sampling.scene_changes(sampling.signature_scores(rows), max_gap=2.0).select("video", "frame_id", "reason")


# --- linking


@query()
def j_object_tracks(spark, sf_dir):
    rows = fx.detections(spark, sf_dir)
    return tracking.track_objects(rows, _frames(spark, sf_dir)).withColumn("box", F.to_json("box"))


@query("""WITH l AS (SELECT conv_id AS video, turn, role AS text FROM conversations WHERE length(trim(role)) >= 2), g AS (SELECT *, CASE WHEN turn - lag(turn) OVER w <= 2 THEN 0 ELSE 1 END AS fresh FROM l WINDOW w AS (PARTITION BY video, text ORDER BY turn)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY video, text ORDER BY turn) AS island FROM g), t AS (SELECT video, text, island, min(turn) AS first FROM i GROUP BY ALL HAVING count(*) >= 2), n AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY first) AS track FROM t)
SELECT i.video, n.track, row_number() OVER (PARTITION BY i.video, n.track ORDER BY turn) - 1 AS obs_idx, turn AS frame_id, i.text FROM i JOIN n ON i.video = n.video AND i.text = n.text AND i.island = n.island""")
def j_text_tracks(spark, sf_dir):
    """Roles as the one line of each turn: two roles are unlike, so a role's turns that are at most two apart are a track."""
    rows = _table(spark, sf_dir, "conversations").selectExpr("conv_id as video", "turn as frame_id", "cast(turn as double) as time_sec", "cast(0 as bigint) as line_idx", "role as text", "0.9D as conf", "named_struct('x', 0.1D, 'y', 0.1D, 'w', 0.5D, 'h', 0.1D) as box")
    return tracking.track_text(rows).select("video", "track", "obs_idx", "frame_id", "text")


_TEXTS = DET + """, txt AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY first_sec, det_idx) AS track, first_sec + det_idx % 4 AS last_sec FROM (SELECT video, det_idx, class AS text, frame_id AS first_sec, x, y, w, h FROM det))"""


def _texts(spark, sf_dir):
    """Each detection as a text that stays for 0 to 3 seconds."""
    rows = fx.detections(spark, sf_dir).selectExpr("video", "det_idx", "class as text", "time_sec as first_sec", "time_sec + det_idx % 4 as last_sec", "box as first_box", "box as best_box")
    return rows.withColumn("track", F.row_number().over(Window.partitionBy("video").orderBy("first_sec", "det_idx")).cast("bigint"))


@query(f"""WITH {_TEXTS}, p AS (SELECT b.video, b.track, a.track AS before, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s
FROM txt a JOIN txt b ON a.video = b.video AND a.track <> b.track AND a.last_sec <= b.first_sec AND b.first_sec - a.last_sec <= 3 AND a.text <> b.text)
SELECT video, track, before, {_micro('i / (s - i)')} AS overlap FROM p WHERE i / (s - i) >= 0.3""")
def j_text_predecessors(spark, sf_dir):
    return text_events.predecessors(_texts(spark, sf_dir)).select("video", "track", "before", G.micro(F.col("overlap")).alias("overlap"))


@query(f"""WITH RECURSIVE {_TEXTS}, p AS (SELECT b.video, b.track, a.track AS before, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s
FROM txt a JOIN txt b ON a.video = b.video AND a.track <> b.track AND a.last_sec <= b.first_sec AND b.first_sec - a.last_sec <= 3 AND a.text <> b.text),
c AS (SELECT video, track, list(before ORDER BY i / (s - i) DESC, before DESC) AS few FROM p WHERE i / (s - i) >= 0.3 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY track) AS n FROM c),
f AS (SELECT video, n, track, few[1] AS before, [few[1]] AS taken FROM k WHERE n = 1
 UNION ALL SELECT video, n, track, before, CASE WHEN before IS NULL THEN taken ELSE list_append(taken, before) END FROM (SELECT k.video, k.n, k.track, taken, [x for x in few if NOT list_contains(taken, x)][1] AS before FROM f JOIN k ON k.video = f.video AND k.n = f.n + 1))
SELECT t.video, t.track, CASE WHEN f.before IS NULL THEN 'text_appeared' ELSE 'text_changed' END AS type, CAST(first_sec AS BIGINT) AS sec, f.before FROM txt t LEFT JOIN f ON f.video = t.video AND f.track = t.track""")
def r_text_events(spark, sf_dir):
    return text_events.text_events(_texts(spark, sf_dir)).withColumn("sec", F.col("sec").cast("long"))


@query(f"""WITH RECURSIVE {OBS}, s AS (SELECT *, count(*) OVER (PARTITION BY video, track) AS n FROM obs),
f AS (SELECT video, track, obs_idx, det_idx, n, true AS kept, x, y, w, h FROM s WHERE obs_idx = 0
 UNION ALL SELECT video, track, obs_idx, det_idx, n, kept, CASE WHEN kept THEN x ELSE fx END, CASE WHEN kept THEN y ELSE fy END, CASE WHEN kept THEN w ELSE fw END, CASE WHEN kept THEN h ELSE fh END
 FROM (SELECT s.video, s.track, s.obs_idx, s.det_idx, s.n, s.obs_idx = s.n - 1 OR greatest(abs(s.x - f.x), abs(s.y - f.y), abs(s.w - f.w), abs(s.h - f.h)) > 0.3 AS kept, s.x, s.y, s.w, s.h, f.x AS fx, f.y AS fy, f.w AS fw, f.h AS fh FROM f JOIN s ON s.video = f.video AND s.track = f.track AND s.obs_idx = f.obs_idx + 1))
SELECT video, track, obs_idx, det_idx FROM f WHERE kept""")
def p_kept_sightings(spark, sf_dir):
    return text_events.kept_sightings(fx.observations(spark, sf_dir), 0.3).select("video", "track", F.col("obs_idx").cast("long").alias("obs_idx"), "det_idx")


# --- pixels


def _pictures(spark, sf_dir):
    """The bytes of each whole text as a picture 64 pixels wide, filled up with zeros to whole rows and 27 of them at least."""
    rows = _table(spark, sf_dir, "documents").selectExpr("doc_id", "encode(coalesce(text, ''), 'UTF-8') as raw").withColumn("height", F.expr("cast(greatest(27, ceil(octet_length(raw) / 192D)) as int)"))
    filled = F.expr("unhex(rpad(hex(raw), height * 384, '0'))")
    return rows.select(F.expr("doc_id % 16").alias("video"), F.col("doc_id").alias("frame_id"), F.col("doc_id").cast("double").alias("time_sec"), F.lit(64).alias("width"), "height", filled.alias("rgb"))


@query()
def a_image_signatures(spark, sf_dir):
    return images.signatures(_pictures(spark, sf_dir)).select("video", "frame_id", *[F.transform(c, lambda x: F.round(x * 1e6).cast("long")).alias(c) for c in ("hist", "thumb")])


@query()
def t_text_sources(spark, sf_dir):
    return images.text_sources(images.cell_means(_pictures(spark, sf_dir)))


@query()
def u_stand_in_detections(spark, sf_dir):
    """Each sign of a whole text is a pixel: small vowels and blanks red, all else blue."""
    told = F.expr("replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?s)[^aeiou ]', '#'), '[aeiou ]', 'C80A0A'), '#', '0A0AC8')")
    rows = _table(spark, sf_dir, "documents").select("doc_id", told.alias("told")).withColumn("height", F.expr("cast(greatest(27, ceil(length(told) / 384D)) as int)"))
    pictures = rows.selectExpr("doc_id % 16 as video", "doc_id as frame_id", "cast(doc_id as double) as time_sec", "64 as width", "height", "unhex(rpad(told, height * 384, '0')) as rgb")
    return images.stand_in_detections(pictures).withColumn("box", F.to_json("box"))


@query("SELECT o_custkey AS video, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, o_orderpriority AS type, o_orderkey AS start, o_orderkey + 7 AS \"end\", o_custkey || ',' || o_orderkey AS entity_ids, CAST(2 AS INT) AS layer FROM orders")
def s_document_round_trip(spark, sf_dir):
    """Orders as events of customers' documents, written in binary form and read back."""
    from framelore.sources import semantic

    rows = _table(spark, sf_dir, "orders").selectExpr("o_custkey as video", "o_orderkey as place", "o_orderpriority as type", "o_orderkey as start", "o_orderkey + 7 as `end`", "array(o_custkey, o_orderkey) as entity_ids", "2 as layer")
    heads = rows.groupBy("video").agg(F.lit(0).alias("layer"), F.min("start").alias("t_start"), F.max("end").alias("t_end"))
    return semantic.blocks(semantic.documents({"events": rows}, heads), "events").select("video", "place", "type", "start", "end", F.concat_ws(",", "entity_ids").alias("entity_ids"), "layer")


# --- planned point queries


@query("""WITH t AS (SELECT doc_id AS id, unnest(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}\\s]', '', 'g'), '\\s+', ' ', 'g')), ' ')) AS token FROM documents), p AS (SELECT token, id, count(*) AS n FROM t WHERE token IN ('license', 'password', 'que') GROUP BY ALL)
SELECT id, count(*) AS matched, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY id""")
def q_search(spark, sf_dir):
    index = graph.postings(_table(spark, sf_dir, "documents").selectExpr("doc_id as id", "text"))
    return graph.search(index, ["license", "password", "que"])


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS match, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query, match, CAST(place AS INT) AS place FROM (SELECT query, match, row_number() OVER (PARTITION BY query ORDER BY c DESC, match) AS place FROM s) WHERE place <= 5""")
def q_nearest_vectors(spark, sf_dir):
    from framelore.operators import vectors

    rows = _table(spark, sf_dir, "embeddings")
    return vectors.nearest(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", 5)


@query(f"""WITH {OBS}, d AS (SELECT video, track, obs_idx, frame_id - coalesce(lag(frame_id) OVER (PARTITION BY video, track ORDER BY obs_idx), 0) AS delta, CAST(floor(conf * 255 + 0.5) AS INT) AS conf8, CAST(dense_rank() OVER (ORDER BY class) - 1 AS INT) AS class_code FROM obs) SELECT * FROM d""")
def q_compressed(spark, sf_dir):
    from framelore.operators import document

    rows = fx.observations(spark, sf_dir).withColumn("obs_idx", F.col("obs_idx").cast("long"))
    return document.compressed(rows).select("video", "track", "obs_idx", "delta", "conf8", "class_code")


_MATCHED = DET + """, g AS (SELECT * REPLACE (x + CAST(det_idx % 9 AS DOUBLE) / 100 AS x), det_idx AS truth_idx FROM det),
h AS (SELECT f.video, f.frame_id, f.class, f.det_idx AS d, g.truth_idx AS t, greatest(0, least(f.x + f.w, g.x + g.w) - greatest(f.x, g.x)) * greatest(0, least(f.y + f.h, g.y + g.h) - greatest(f.y, g.y)) AS i, f.w * f.h + g.w * g.h AS s FROM det f JOIN g USING (video, frame_id, class)),
pp AS (SELECT video, frame_id, class, d, t, row_number() OVER (PARTITION BY video, frame_id, class ORDER BY i / (s - i) DESC, d, t) AS n FROM h WHERE i / (s - i) >= 0.2),
ff AS (SELECT video, frame_id, class, n, d, t, true AS hit, [d] AS ds, [t] AS ts FROM pp WHERE n = 1 UNION ALL
 SELECT video, frame_id, class, n, d, t, hit, CASE WHEN hit THEN list_append(ds, d) ELSE ds END, CASE WHEN hit THEN list_append(ts, t) ELSE ts END
 FROM (SELECT pp.*, ds, ts, NOT (list_contains(ds, pp.d) OR list_contains(ts, pp.t)) AS hit FROM ff JOIN pp ON pp.video = ff.video AND pp.frame_id = ff.frame_id AND pp.class = ff.class AND pp.n = ff.n + 1))"""


def _moved(spark, sf_dir):
    """Detections as truth, some of them moved to the right."""
    moved = F.expr("named_struct('x', box.x + cast(det_idx % 9 as double) / 100, 'y', box.y, 'w', box.w, 'h', box.h)")
    return fx.detections(spark, sf_dir).withColumn("box", moved).withColumnsRenamed({"det_idx": "truth_idx", "track": "truth_track"})


@query(f"""WITH RECURSIVE {_MATCHED}, m AS (SELECT class, count(*) AS "right" FROM ff WHERE hit GROUP BY class), n AS (SELECT class, count(*) AS n FROM det GROUP BY class)
SELECT class, n AS found, n AS truth, coalesce("right", 0) AS "right", {_micro('coalesce("right", 0)::DOUBLE / n')} AS precision, {_micro('coalesce("right", 0)::DOUBLE / n')} AS recall FROM n LEFT JOIN m USING (class)""")
def q_precision_recall(spark, sf_dir):
    out = D.precision_recall(fx.detections(spark, sf_dir), _moved(spark, sf_dir), 0.2)
    return out.select("class", "found", "truth", "right", G.micro(F.col("precision")).alias("precision"), G.micro(F.col("recall")).alias("recall"))


@query(f"""WITH RECURSIVE {_MATCHED}, m AS (SELECT ff.video, ff.frame_id, a.track, b.track AS truth_track, ff.t FROM ff JOIN det a ON a.det_idx = ff.d JOIN det b ON b.det_idx = ff.t WHERE hit),
s AS (SELECT *, CASE WHEN track <> lag(track) OVER (PARTITION BY video, truth_track ORDER BY frame_id, t) THEN 1 ELSE 0 END AS switch FROM m) SELECT video, truth_track, count(*) AS frames, CAST(sum(switch) AS BIGINT) AS switches FROM s GROUP BY ALL""")
def q_identity_switches(spark, sf_dir):
    return D.identity_switches(fx.detections(spark, sf_dir), _moved(spark, sf_dir), 0.2)


@query(f"""WITH {DET}, tr AS (SELECT video, det_idx AS truth_idx, class AS type, frame_id + det_idx % 5 AS sec FROM det WHERE det_idx % 7 = 0), fd AS (SELECT video, class AS type, frame_id AS sec FROM det WHERE det_idx % 7 <> 0),
e AS (SELECT tr.video, truth_idx, tr.type, min(abs(fd.sec - tr.sec)) AS error FROM tr LEFT JOIN fd ON fd.video = tr.video AND fd.type = tr.type GROUP BY ALL) SELECT video, truth_idx, type, CASE WHEN error <= 3 THEN error END AS error FROM e""")
def q_event_errors(spark, sf_dir):
    rows = fx.detections(spark, sf_dir)
    truth = rows.where("det_idx % 7 = 0").selectExpr("video", "det_idx as truth_idx", "class as type", "time_sec + det_idx % 5 as sec")
    found = rows.where("det_idx % 7 != 0").selectExpr("video", "class as type", "time_sec as sec")
    return D.event_errors(found, truth, 3.0).withColumn("error", F.col("error").cast("long"))


@query(f"""WITH n AS (SELECT p_partkey AS k, p_size AS video, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM part), c AS (SELECT a.video, a.t AS x, CASE WHEN a.k % 3 = 0 THEN a.t ELSE b.t END AS y FROM n a JOIN n b ON b.k = a.k + 1)
SELECT video, count(*) AS lines, CAST(count(*) FILTER (x = y) AS BIGINT) AS exact, CAST(round(avg(1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y))) * 1e9) AS BIGINT) AS similarity FROM c GROUP BY video""")
def q_reading_accuracy(spark, sf_dir):
    rows = _table(spark, sf_dir, "part")
    both = rows.selectExpr("p_partkey as k", "cast(p_size as bigint) as video", "p_name as text").join(rows.selectExpr("p_partkey - 1 as k", "p_name as next"), "k")
    out = D.reading_accuracy(both.withColumn("truth", F.expr("if(k % 3 = 0, concat(' ', upper(text), '!'), next)")))
    return out.select(F.col("video").cast("int").alias("video"), "lines", "exact", F.round(F.col("similarity") * 1e9).cast("long").alias("similarity"))


@query(f"""WITH {DET}, e AS (SELECT video, class AS type, frame_id AS start, frame_id + det_idx % 9 AS "end", det_idx FROM det WHERE frame_id <= 700 AND frame_id + det_idx % 9 >= 200)
SELECT video, type, start, "end", CAST(row_number() OVER (PARTITION BY video ORDER BY start, type, "end") AS INT) AS place FROM e""")
def q_events_between(spark, sf_dir):
    rows = fx.detections(spark, sf_dir).selectExpr("video", "class as type", "frame_id as start", "frame_id + det_idx % 9 as `end`")
    return graph.events_between(rows, 200, 700)


@query(f"""WITH {SPANS}, p AS (SELECT o_orderkey % 8 AS video, o_orderkey AS probe, o_custkey % 2000 AS t FROM orders), l AS (SELECT p.video, probe, t, id FROM p JOIN spans s ON s.video = p.video AND s.start <= t AND t <= s."end")
SELECT l.video, probe, t, id, max(d.frame_id) AS timestamp FROM l JOIN det d ON d.video = l.video AND d.track = l.id AND d.frame_id <= t GROUP BY ALL""")
def q_objects_at(spark, sf_dir):
    objects = fx.detections(spark, sf_dir).selectExpr("video", "track as entity_id", "frame_id as timestamp", "box as bbox")
    probes = _table(spark, sf_dir, "orders").selectExpr("o_orderkey % 8 as video", "o_orderkey as probe", "o_custkey % 2000 as t")
    return graph.objects_at(objects, fx.spans(spark, sf_dir), probes, 64).select("video", "probe", "t", "id", "timestamp")


def _document(spark, sf_dir):
    """Customers as entities, their orders as relations with some faults, and line items as objects."""
    ref = "if({0} % 31 = 0, null, named_struct('t_start', {1}, 't_end', {1} + 5 - {0} % 7, 'frame_id', {0}, 'bbox', named_struct('x', cast(cast({0} % 90 as float) / 80 as float), 'y', float(0), 'w', float(0.1), 'h', float(0.5)))) as pixel_ref"
    entities = _table(spark, sf_dir, "customer").selectExpr("0L as video", "c_custkey as place", "c_custkey as id", "c_mktsegment as type", "c_custkey as first_seen", "c_custkey + 3 - c_custkey % 9 as last_seen", "cast(c_custkey % 4 as int) as layer", ref.format("c_custkey", "c_custkey"))
    orders = _table(spark, sf_dir, "orders")
    relations = orders.selectExpr("0L as video", "o_orderkey as place", "o_custkey as subject_id", "'near' as relation", "o_custkey * 2 as object_id", "o_orderkey as start", "o_orderkey + o_custkey % 3 - 1 as `end`", "if(o_orderkey % 10 = 0, 0L, o_orderkey div 3) as id", "2 as layer", ref.format("o_orderkey", "o_custkey"))
    actions = orders.selectExpr("0L as video", "o_orderkey as place", "o_custkey + 5 as subject_id", "'walking' as action", "o_orderkey as start", "o_orderkey as `end`", "cast(o_custkey % 120 as float) / 100 as confidence", "2 as layer", ref.format("o_orderkey", "o_custkey"))
    temporals = orders.selectExpr("0L as video", "o_orderkey as place", "array(o_custkey, o_custkey) as active_entity_ids", "array(o_orderkey div 3 + 2) as active_relation_ids", "2 as layer", ref.format("o_orderkey", "o_custkey"))
    return {"entities": entities, "relations": relations, "actions": actions, "temporals": temporals}


def _ref_sql(k: str, t: str) -> str:
    return f"{k} % 31 = 0 AS bare, {t} AS ta, {t} + 5 - {k} % 7 AS tb, ({k} % 90)::FLOAT / 80::FLOAT AS bx"


_DOCUMENT = f"""c AS (SELECT c_custkey AS place, c_custkey AS a, c_custkey + 3 - c_custkey % 9 AS b, c_custkey % 4 AS layer, {_ref_sql('c_custkey', 'c_custkey')} FROM customer),
o AS (SELECT o_orderkey AS place, o_custkey, o_orderkey AS a, o_orderkey + o_custkey % 3 - 1 AS b, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_orderkey // 3 END AS id, {_ref_sql('o_orderkey', 'o_custkey')} FROM orders),
al AS (SELECT 'entities' AS list, place, layer, bare, ta, tb, bx FROM c UNION ALL SELECT unnest(['relations', 'actions', 'temporals']), place, 2, bare, ta, tb, bx FROM o),
v AS (SELECT list, place, 'no layer' AS rule, NULL::BIGINT AS id FROM al WHERE layer = 0 UNION ALL SELECT list, place, 'no pixel_ref', NULL FROM al WHERE bare UNION ALL SELECT list, place, 'pixel_ref times', NULL FROM al WHERE NOT bare AND ta > tb
 UNION ALL SELECT list, place, 'pixel_ref box', NULL FROM al WHERE NOT bare AND (bx > 1 OR bx + 0.1::FLOAT > 1.0001::FLOAT) UNION ALL SELECT 'entities', place, 'times', NULL FROM c WHERE a > b UNION ALL SELECT 'relations', place, 'times', NULL FROM o WHERE a > b
 UNION ALL SELECT 'actions', place, 'confidence', NULL FROM o WHERE (o_custkey % 120)::FLOAT / 100 > 1
 UNION ALL SELECT list, place, 'unknown entity', id FROM (SELECT DISTINCT list, place, id FROM (SELECT 'actions' AS list, place, o_custkey + 5 AS id FROM o UNION ALL SELECT 'relations', place, o_custkey FROM o UNION ALL SELECT 'relations', place, o_custkey * 2 FROM o UNION ALL SELECT 'temporals', place, o_custkey FROM o)) WHERE id NOT IN (SELECT place FROM c)
 UNION ALL SELECT 'temporals', place, 'unknown relation', a // 3 + 2 FROM o WHERE a // 3 + 2 NOT IN (SELECT id FROM o WHERE id <> 0)
 UNION ALL SELECT 'relations', place, 'repeated id', id FROM (SELECT place, id, row_number() OVER (PARTITION BY id ORDER BY place) AS n FROM o WHERE id <> 0) WHERE n > 1)"""


@query(f"WITH {_DOCUMENT} SELECT * FROM v")
def p_document_violations(spark, sf_dir):
    from framelore.operators import document

    return document.document_violations(_document(spark, sf_dir)).drop("video")


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS a, o_custkey * 2 AS b, o_orderkey + o_custkey % 3 - 1 AS e FROM orders), c AS (SELECT c_custkey FROM customer)
SELECT kind, start, rule, id FROM (SELECT unnest(['event', 'action', 'relation']) AS kind, k AS start, 'ends before it starts' AS rule, NULL::BIGINT AS id FROM o WHERE e < k
 UNION ALL SELECT kind, k, 'unknown entity', id FROM (SELECT DISTINCT * FROM (SELECT 'event' AS kind, k, a AS id FROM o UNION ALL SELECT 'event', k, b FROM o UNION ALL SELECT 'action', k, a + 5 FROM o UNION ALL SELECT 'relation', k, a FROM o UNION ALL SELECT 'relation', k, b FROM o)) WHERE id NOT IN (FROM c)
 UNION ALL SELECT 'relation', k, 'missing or repeated id', k // 4 FROM (SELECT k, row_number() OVER (PARTITION BY k // 4 ORDER BY k) AS n FROM o) WHERE k // 4 = 0 OR n > 1)""")
def p_graph_violations(spark, sf_dir):
    from framelore.operators import document

    o = _table(spark, sf_dir, "orders").selectExpr("0L as video", "o_orderkey as start", "o_orderkey + o_custkey % 3 - 1 as `end`", "o_custkey as a", "o_custkey * 2 as b", "o_orderkey div 4 as id")
    entities = _table(spark, sf_dir, "customer").selectExpr("0L as video", "c_custkey as id")
    events, acts, rels = o.selectExpr("video", "start", "`end`", "array(a, b) as entities"), o.selectExpr("video", "start", "`end`", "a + 5 as entity"), o.selectExpr("video", "start", "`end`", "id", "a as subject", "b as object")
    return document.graph_violations(entities, events, acts, rels).drop("video")


@query(f"""WITH {_DOCUMENT}, l AS (SELECT 'entities:' || place AS block_id, bare, ta, tb, place FROM c UNION ALL SELECT 'relations:' || place, bare, ta, tb, place FROM o)
SELECT block_id, ta AS t_start, tb AS t_end, place AS frame_id FROM l WHERE NOT bare AND place % 5 = 0""")
def q_evidence(spark, sf_dir):
    held = {k: v for k, v in _document(spark, sf_dir).items() if k in ("entities", "relations")}
    refs = graph.block_references(held).where("pixel_ref is not null")
    wanted = refs.select("video", "block_id").where("cast(split(block_id, ':')[1] as bigint) % 5 = 0")
    return graph.evidence(refs, wanted).select("block_id", "t_start", "t_end", "frame_id")


@query(f"""WITH {OBS}, l AS (SELECT video, track, min(frame_id) AS a, max(frame_id) AS b, arg_max(frame_id, (milli_conf, -obs_idx)) AS f, arg_min(class, obs_idx) AS class FROM obs GROUP BY ALL), k AS (SELECT video, track, a, b, f, class FROM l)
SELECT 'entities' AS list, video, row_number() OVER (PARTITION BY video ORDER BY track) - 1 AS place, track AS entity, class AS told, a AS start, b AS "end", f AS frame_id, 1 AS layer FROM k
UNION ALL SELECT 'attributes', video, row_number() OVER (PARTITION BY video ORDER BY track) - 1, track, class || '_' || track, a, b, f, 1 FROM k
UNION ALL SELECT 'relations', video, row_number() OVER (PARTITION BY video ORDER BY a, track) - 1, track, 'near', a, b, f, 2 FROM k""")
def r_document(spark, sf_dir):
    """Tracks as entities, each near the next, as a document's blocks."""
    from framelore.operators import document

    obs = fx.observations(spark, sf_dir)
    kind = obs.groupBy("video", "track").agg(F.min_by("class", "obs_idx").alias("class"), F.max_by("frame_id", F.struct("conf", -F.col("obs_idx"))).alias("f"), F.min("frame_id").alias("start"), F.max("frame_id").alias("end"))
    rows = obs.drop("class").join(kind.select("video", "track", "class"), ["video", "track"]).selectExpr("video", "track as entity", "class", "concat(class, '_', track) as name", "cast(obs_idx as bigint) as obs_idx", "frame_id as ticks", "frame_id", "conf", "box")
    rels = kind.selectExpr("video", "track as id", "track as subject", "'near' as name", "track as object", "start", "`end`", "0.5D as conf", "f as frame_id", "cast(null as struct<x:double,y:double,w:double,h:double>) as box")
    out = document.from_graph({"observations": rows, "relations": rels}, 0.3, 100)
    told = {"entities": ("id", "type", "first_seen", "last_seen"), "attributes": ("entity_id", "value", "start", "end"), "relations": ("id", "relation", "start", "end")}
    parts = [out[k].select(F.lit(k).alias("list"), "video", "place", *[F.col(c).alias(n) for c, n in zip(cols, ("entity", "told", "start", "end"))], F.col("pixel_ref.frame_id").alias("frame_id"), "layer") for k, cols in told.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {OBS}, g AS (SELECT *, CASE WHEN x = lag(x) OVER w AND y = lag(y) OVER w AND w = lag(w) OVER w AND h = lag(h) OVER w THEN 0 ELSE 1 END AS fresh FROM (SELECT * REPLACE (x - x % 0.3 AS x, 0.1 AS y, 0.2 AS w, 0.3 AS h) FROM obs) WINDOW w AS (PARTITION BY video, track ORDER BY obs_idx)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY video, track ORDER BY obs_idx) AS run FROM g) SELECT video, track, CAST(run AS BIGINT) AS run, min(obs_idx) AS first_idx, max(obs_idx) AS last_idx, count(*) AS n, CAST(CASE WHEN min(frame_id) < 128 THEN 1 ELSE 2 END AS INT) AS bytes FROM i GROUP BY video, track, run""")
def q_box_runs(spark, sf_dir):
    from framelore.operators import document

    rows = fx.observations(spark, sf_dir).withColumn("box", F.expr("named_struct('x', box.x - box.x % 0.3, 'y', 0.1D, 'w', 0.2D, 'h', 0.3D)"))
    out = document.box_runs(rows.withColumn("obs_idx", F.col("obs_idx").cast("long")))
    return out.select("video", "track", "run", "first_idx", "last_idx", "n", document.varint_size(F.col("first_frame")).alias("bytes"))


@query(f"WITH {DET} SELECT class, count(*) AS detections, count(DISTINCT track) AS tracks, count(DISTINCT (video, frame_id)) AS frames FROM det GROUP BY class")
def a_semantic_summary(spark, sf_dir):
    return fx.detections(spark, sf_dir).groupBy("class").agg(F.count(F.lit(1)).alias("detections"), F.countDistinct("track").alias("tracks"), F.countDistinct("video", "frame_id").alias("frames"))
