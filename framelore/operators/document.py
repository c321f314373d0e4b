"""The layered semantic document: default layers, checks, splitting, merging and compact columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelore.functions import geometry as G

# The layer of a block that names none, by its number in a file; 0 there means that none is named.
LAYERS = {"entity": 1, "object": 1, "attribute": 1, "event": 2, "action": 2, "relation": 2, "scene": 2, "temporal": 2, "text": 3, "embedding": 4}


def with_layer(blocks: DataFrame, kind: Column) -> DataFrame:
    """Blocks with layer filled in where it is missing or 0."""
    default = F.element_at(F.create_map(*[F.lit(x) for p in LAYERS.items() for x in p]), kind).cast("int")
    own = F.when(F.col("layer") > 0, F.col("layer")).otherwise(default) if "layer" in blocks.columns else default
    return blocks.withColumn("layer", own)


def split_layers(document: dict[str, DataFrame]) -> dict[int, dict[str, DataFrame]]:
    """Block tables by layer; each filter is a partition of a table written by layer."""
    return {n: {k: t.where(F.col("layer") == n) for k, t in document.items()} for n in sorted(set(LAYERS.values()))}


def merge(documents: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The blocks of several documents together, repeats included."""
    kinds = {k for d in documents for k in d}
    return {k: reduce(DataFrame.unionByName, [d[k] for d in documents if k in d]) for k in kinds}


def violations(blocks: DataFrame, key: str) -> DataFrame:
    """(key, rule) of every rule that a block breaks; rules apply to the columns that are there: name, box, confidence, start and end."""
    rules = {}
    if "name" in blocks.columns:
        rules["empty name"] = F.coalesce(F.trim("name") == "", F.lit(True))
    if "box" in blocks.columns:
        rules["box"] = F.col("box").isNotNull() & ~G.valid(F.col("box"))
    if "confidence" in blocks.columns:
        rules["confidence"] = F.coalesce(F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1), F.lit(False))
    if "end" in blocks.columns:
        rules["times"] = F.col("end") < F.col("start")
    broken = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda r: r.isNotNull())
    return blocks.select(key, F.explode(broken).alias("rule"))


# What the lists of a document hold besides layer and pixel_ref: fields with boxes, confidences, times in order, and references.
_BOXES = {"objects": "bbox", "texts": "bbox", "events": "region"}
_SURE = ("objects", "texts", "actions", "events", "attributes")
_SPANS = dict.fromkeys(("actions", "events", "relations", "attributes", "scenes"), ("start", "end")) | {"entities": ("first_seen", "last_seen")}
_ENTITIES = {"objects": ["entity_id"], "actions": ["subject_id"], "attributes": ["entity_id"], "relations": ["subject_id", "object_id"], "events": ["entity_ids"], "temporals": ["active_entity_ids", "added_entity_ids", "removed_entity_ids"]}
_RELATIONS = {"temporals": ["active_relation_ids", "added_relation_ids", "removed_relation_ids"]}


def _bad_box(c: str) -> Column:
    b, limit = F.col(c), F.lit(1.0001).cast("float")
    out = F.lit(False)
    for k in "xywh":
        out = out | F.isnan(b[k]) | (b[k] < 0) | (b[k] > 1)
    return F.coalesce(out | (b["x"] + b["w"] > limit) | (b["y"] + b["h"] > limit), F.lit(False))


def document_violations(document: dict[str, DataFrame], references: bool = True) -> DataFrame:
    """Block tables by list name, each with video, place, its fields (lists of ids may be missing), layer and pixel_ref, as semantic.blocks() gives -> (video, list, place, rule, id) of
    every rule that a block breaks; id is the entity or relation that is not known or repeated.

    Every block has a layer and a pixel_ref whose times are in order; boxes lie in the frame, confidences in 0..1, times in order. With references, entities and
    relations that blocks name are there, and no relation's id but 0, which means none, comes twice in a video.
    """
    out = []
    none = F.lit(None).cast("long").alias("id")
    for name, t in document.items():
        rules = {"no layer": F.coalesce(F.col("layer"), F.lit(0)) == 0, "no pixel_ref": F.col("pixel_ref").isNull(), "pixel_ref times": F.col("pixel_ref.t_start") > F.col("pixel_ref.t_end"), "pixel_ref box": _bad_box("pixel_ref.bbox")}
        if name in _BOXES:
            rules["box"] = _bad_box(_BOXES[name])
        if name in _SURE:
            rules["confidence"] = F.isnan("confidence") | (F.col("confidence") < 0) | (F.col("confidence") > 1)
        if name in _SPANS:
            rules["times"] = F.col(_SPANS[name][0]) > F.col(_SPANS[name][1])
        broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(rule)) for rule, test in rules.items()]))
        out.append(t.select("video", F.lit(name).alias("list"), "place", F.explode(broken).alias("rule"), none))
    if references:
        for fields, kind, holder in ((_ENTITIES, "unknown entity", "entities"), (_RELATIONS, "unknown relation", "relations")):
            named = None
            for name, columns in fields.items():
                if name not in document:
                    continue
                columns = [c for c in columns if c in document[name].columns]
                if not columns:
                    continue
                ids = [F.coalesce(F.col(c), F.expr("cast(array() as array<bigint>)")) if c.endswith("_ids") else F.array(c) for c in columns]
                some = document[name].select("video", F.lit(name).alias("list"), "place", F.explode(F.array_distinct(F.concat(*ids))).alias("id"))
                named = some if named is None else named.unionByName(some)
            if named is not None:
                known = document[holder].select("video", "id").where("id != 0" if holder == "relations" else "true").distinct() if holder in document else None
                lost = named if known is None else named.join(known, ["video", "id"], "left_anti")
                out.append(lost.select("video", "list", "place", F.lit(kind).alias("rule"), "id"))
        if "relations" in document:
            nth = F.row_number().over(Window.partitionBy("video", "id").orderBy("place"))
            out.append(document["relations"].where("id != 0").withColumn("nth", nth).where("nth > 1").select("video", F.lit("relations").alias("list"), "place", F.lit("repeated id").alias("rule"), "id"))
    return reduce(DataFrame.unionByName, out)


def graph_violations(entities: DataFrame, events: DataFrame, actions: DataFrame, relations: DataFrame) -> DataFrame:
    """entities(video, id), events(video, start, end, entities), actions(video, entity, start, end), relations(video, id, subject, object, start, end)
    -> (video, kind, start, rule, id): what ends before it starts, entities that are not known, relations without an id of their own."""
    named = [
        events.select("video", F.lit("event").alias("kind"), "start", "end", F.col("entities").alias("ids")),
        actions.select("video", F.lit("action").alias("kind"), "start", "end", F.array("entity").alias("ids")),
        relations.select("video", F.lit("relation").alias("kind"), "start", "end", F.array("subject", "object").alias("ids")),
    ]
    every = reduce(DataFrame.unionByName, named)
    none = F.lit(None).cast("long").alias("id")
    late = every.where("`end` < start").select("video", "kind", "start", F.lit("ends before it starts").alias("rule"), none)
    lost = every.select("video", "kind", "start", F.explode(F.array_distinct("ids")).alias("id")).join(entities.select("video", "id").distinct(), ["video", "id"], "left_anti").select("video", "kind", "start", F.lit("unknown entity").alias("rule"), "id")
    nth = F.row_number().over(Window.partitionBy("video", "id").orderBy("start"))
    twice = relations.withColumn("nth", nth).where("coalesce(id, 0) = 0 or nth > 1").select("video", F.lit("relation").alias("kind"), "start", F.lit("missing or repeated id").alias("rule"), "id")
    return late.unionByName(lost).unionByName(twice)


def raise_on(violations: DataFrame) -> None:
    """An error that names the first of the violations, if there are any."""
    first = violations.limit(1).collect()
    if first:
        raise ValueError("the document is not valid: " + ", ".join(f"{k} {v}" for k, v in first[0].asDict().items() if v is not None))


def _box32(c: str) -> Column:
    b = G.clamped(F.col(c))
    return F.when(F.col(c).isNotNull(), F.struct(*[b[k].cast("float").alias(k) for k in "xywh"]))


def _reference(start: str, end: str, frame: str | None, box: str | None) -> Column:
    """Where a fact comes from: its times in order, its frame and its box, if it has them."""
    no_box = F.lit(None).cast("struct<x:float,y:float,w:float,h:float>")
    return F.struct(F.col(start).alias("t_start"), F.greatest(F.col(start), F.col(end)).alias("t_end"), (F.col(frame).cast("long") if frame else F.lit(None).cast("long")).alias("frame_id"), (_box32(box) if box else no_box).alias("bbox"))


def from_graph(graph: dict[str, DataFrame], box_delta: float = 0.02, key_ticks: int = 2_700_000) -> dict[str, DataFrame]:
    """A graph's tables -> the document's block tables, with video, place, layer and pixel_ref.

    observations(video, entity, class, name, obs_idx, ticks, frame_id, conf, box); readings(video, track, text, obs_idx, ticks, frame_id, conf, box: all
    readings of a line, its agreed text and mean_conf); actions(video, entity, name, start, end, conf, frame_id, box); events(video, type, start, end, entities, conf, frame_id,
    region); relations(video, id, subject, name, object, start, end, conf, frame_id, box); shots(video, label, start, end, frame_id). Those that are missing give no blocks.
    Objects are kept where their box has changed by more than box_delta; key_ticks: how old a full state may get.
    """
    from framelore.functions.text import share
    from framelore.operators import graph as graphs
    from framelore.operators.text_events import kept_sightings

    def block(kind: str, rows: DataFrame, order: list, fields: dict[str, Column], ref: Column) -> DataFrame:
        place = (F.row_number().over(Window.partitionBy("video").orderBy(*order)) - 1).cast("long")
        return rows.select("video", place.alias("place"), *[c.alias(k) for k, c in fields.items()], F.lit(LAYERS[kind]).alias("layer"), ref.alias("pixel_ref"))

    out: dict[str, DataFrame] = {}
    c = F.col
    spans = None
    if "observations" in graph:
        obs = graph["observations"]
        best = F.max_by(F.struct("frame_id", "box"), F.struct("conf", -c("obs_idx")))
        lives = obs.groupBy("video", "entity").agg(F.first("class").alias("class"), F.first("name").alias("name"), F.min("ticks").alias("first"), F.max("ticks").alias("last"), best.alias("best")).select("*", "best.frame_id", "best.box")
        where = _reference("first", "last", "frame_id", "box")
        out["entities"] = block("entity", lives, ["entity"], {"id": c("entity").cast("long"), "type": c("class"), "first_seen": c("first"), "last_seen": c("last")}, where)
        out["attributes"] = block("attribute", lives, ["entity"], {"entity_id": c("entity").cast("long"), "key": F.lit("name"), "value": c("name"), "start": c("first"), "end": c("last"), "confidence": F.lit(None).cast("float")}, where)
        kept = kept_sightings(obs.withColumnRenamed("entity", "track"), box_delta)
        out["objects"] = block("object", kept, ["track", "obs_idx"], {"entity_id": c("track").cast("long"), "class": c("class"), "bbox": _box32("box"), "confidence": share(c("conf")), "timestamp": c("ticks")}, _reference("ticks", "ticks", "frame_id", "box"))
        spans = lives.select("video", c("entity").cast("long").alias("id"), c("first").alias("start"), c("last").alias("end"))
    if "readings" in graph:
        agreed = F.when(c("text") == c("agreed"), F.struct("conf", -c("obs_idx")))
        lines = graph["readings"].groupBy("video", "track").agg(F.first("agreed").alias("agreed"), F.first("mean_conf").alias("conf"), F.min("ticks").alias("first"), F.max("ticks").alias("last"), F.max_by(F.struct("frame_id", "box"), agreed).alias("best")).select("*", "best.frame_id", "best.box")
        out["texts"] = block("text", lines, ["track"], {"content": c("agreed"), "bbox": _box32("box"), "confidence": share(c("conf")), "timestamp": c("first")}, _reference("first", "last", "frame_id", "box"))
    if "actions" in graph:
        out["actions"] = block("action", graph["actions"], ["start", "entity", "name"], {"subject_id": c("entity").cast("long"), "action": c("name"), "start": c("start"), "end": c("end"), "confidence": share(c("conf"))}, _reference("start", "end", "frame_id", "box"))
    if "events" in graph:
        out["events"] = block("event", graph["events"], ["start", "type", "entities"], {"type": c("type"), "start": c("start"), "end": c("end"), "entity_ids": c("entities").cast("array<bigint>"), "region": _box32("region"), "confidence": share(c("conf"))}, _reference("start", "end", "frame_id", "region"))
    if "relations" in graph:
        rel = graph["relations"]
        out["relations"] = block("relation", rel, ["start", "id"], {"subject_id": c("subject").cast("long"), "relation": c("name"), "object_id": c("object").cast("long"), "start": c("start"), "end": c("end"), "confidence": share(c("conf")), "id": c("id").cast("long")}, _reference("start", "end", "frame_id", "box"))
        held = rel.select("video", (-c("id").cast("long")).alias("id"), "start", "end")  # below 0, to tell them from entities
        spans = held if spans is None else spans.unionByName(held)
    if "shots" in graph:
        out["scenes"] = block("scene", graph["shots"], ["start"], {"label": c("label"), "context": F.lit(""), "start": c("start"), "end": c("end")}, _reference("start", "end", "frame_id", None))
    if spans is not None:
        states = graphs.state_blocks(graphs.active_sets(spans), key_ticks)
        entities = lambda x: F.filter(x, lambda i: i > 0)
        relations = lambda x: F.array_sort(F.transform(F.filter(x, lambda i: i < 0), lambda i: -i))
        lists = {f"{verb}_{kind}_ids": pick(c(column)) for kind, pick in (("entity", entities), ("relation", relations)) for verb, column in (("active", "ids"), ("added", "added"), ("removed", "removed"))}
        fields = {"kind": F.when(c("kind") == "KEY", 1).otherwise(2), "t_start": c("t0"), "t_end": c("t1"), "base_t": F.coalesce("base_t", F.lit(0).cast("long")), **lists}
        out["temporals"] = block("temporal", states, ["t0"], fields, _reference("t0", "t1", None, None))
    return out


def compressed(obs: DataFrame) -> DataFrame:
    """Compact columns: frame differences along a track, confidence in 8 bits, classes by number.

    The dictionary is made of the distinct classes, so numbering them needs no window over all rows.
    """
    order = Window.partitionBy("video", "track").orderBy("obs_idx")
    words = obs.groupBy("class").agg(F.count(F.lit(1)).alias("uses"))
    codes = words.select("class", (F.row_number().over(Window.orderBy("class")) - 1).alias("class_code"))
    rows = obs.withColumn("delta", F.col("frame_id") - F.coalesce(F.lag("frame_id").over(order), F.lit(0))).withColumn("conf8", F.floor(F.col("conf") * 255 + 0.5).cast("int"))
    return rows.join(codes, "class")


def box_runs(obs: DataFrame) -> DataFrame:
    """Sightings of a track in a row with one and the same box as one: (video, track, run, first_idx, last_idx, first_frame, last_frame, n, box)."""
    order = Window.partitionBy("video", "track").orderBy("obs_idx")
    fresh = F.coalesce((F.col("box") != F.lag("box").over(order)).cast("long"), F.lit(1).cast("long"))
    rows = obs.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    return rows.groupBy("video", "track", "run").agg(F.min("obs_idx").alias("first_idx"), F.max("obs_idx").alias("last_idx"), F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"), F.count(F.lit(1)).alias("n"), F.first("box").alias("box"))


def zigzag(c: Column) -> Column:
    """Signed numbers as unsigned ones, small for small."""
    return F.shiftleft(c, 1).bitwiseXOR(F.shiftright(c, 63))


def varint_size(c: Column) -> Column:
    """How many bytes a number of 0 or more takes in groups of seven bits."""
    return F.when(c < 0, 10).otherwise(F.greatest(F.lit(1), F.ceil(F.length(F.bin(c)) / 7)).cast("int")).cast("int")


def save(document: dict[str, DataFrame], path: str) -> None:
    """Block tables as Parquet by list and layer, so that a read of some layers opens no files of others."""
    for name, t in document.items():
        t.write.mode("overwrite").partitionBy("layer").parquet(f"{path}/{name}")


def read(spark, path: str, name: str, layers: list[int] | None = None) -> DataFrame:
    """A list's blocks, of the given layers only."""
    t = spark.read.parquet(f"{path}/{name}")
    return t.where(F.col("layer").isin(layers)) if layers is not None else t
