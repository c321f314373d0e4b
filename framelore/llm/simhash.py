"""SimHash near-duplicate detection by pigeonhole blocks.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. The 64 bits
are cut into `blocks` runs. Two fingerprints that differ in at most `distance` bits agree on at
least `blocks - distance` whole runs, so every choice of that many runs is a join key: close pairs meet
under one of the keys, and Hamming distance verifies them. Equal fingerprints are merged first, so a group of
copies is one row from then on.

A key's fingerprints are first compared with the key's smallest; components of those links are then
found, and only keys that still hold more than one component are searched, in tiles of bounded size. So a
large group of close fingerprints costs one comparison for each member and key, and no link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import Forest, connected_components
from ._store import discard, joined_hot, small_batches, stored

# The white space between words, as blanks.
_BLANKS = bytes.maketrans(b"\t\n\v\f\r", b" " * 5)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text as an unsigned 64-bit number; 0 without words (null included).

    A-Z are lower-cased and words are runs of anything but ASCII white space.
    """
    from xxhash import xxh64_intdigest as digest

    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower().translate(_BLANKS), np.uint8)
    blank = raw == 32
    held = ~blank
    held[1:] |= blank[1:] & ~blank[:-1]  # the words, a blank after each
    joined = raw[held].tobytes().rstrip(b" ")
    if not joined:
        return 0
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    if len(ends) <= shingle:
        return digest(joined, seed)
    starts = np.concatenate([[0], ends[:-shingle] + 1])
    total, n = np.zeros(64, np.int64), len(starts)
    for i in range(0, n, 65_536):  # a very long text is hashed in pieces
        spans = zip(starts[i : i + 65_536].tolist(), ends[i + shingle - 1 : i + shingle + 65_535].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype=">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp long: the fingerprint's bits as a signed number), one row per row of docs."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in b["t"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"id": b["id"], "fp": fps})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInPandas(run, "id long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """The masks of all choices of blocks - distance runs of bits."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(runs, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tile_links(distance: int):
    """Spanning links between the fingerprints of each run of equal (k, v, i, j) in a sorted partition."""

    def links(fp: np.ndarray, tile: np.ndarray, comp: np.ndarray, cross: bool) -> list[tuple[int, int]]:
        forest, out = Forest(), []
        for f, c in zip(fp.tolist(), comp.tolist()):
            forest.join(f, c)
        left = np.flatnonzero(tile == tile.min()) if cross else np.arange(len(fp))
        right = np.flatnonzero(tile != tile.min()) if cross else np.arange(len(fp))
        for i in left:
            near = right[np.bitwise_count((fp[right] ^ fp[i]).view(np.uint64)) <= distance]
            for j in near[comp[near] != comp[i]].tolist():
                if forest.join(int(fp[i]), int(fp[j])):
                    out.append((int(fp[i]), int(fp[j])))
        return out

    def run(batches):
        held: list[pd.DataFrame] = []

        def flush(g: pd.DataFrame):
            k = g[["k", "v", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(g)]):
                if b - a > 1:
                    s = slice(a, b)
                    yield from links(g["fp"].to_numpy()[s], g["tile"].to_numpy()[s], g["comp"].to_numpy()[s], k[a, 2] != k[a, 3])

        for b in batches:
            if not len(b):
                continue
            held.append(b)
            g = pd.concat(held) if len(held) > 1 else b
            last = (g[["k", "v", "i", "j"]].to_numpy() == g[["k", "v", "i", "j"]].to_numpy()[-1]).all(axis=1)
            if last.all():
                continue
            if found := list(flush(g[~last])):
                yield pd.DataFrame(found, columns=["a", "b"])
            held = [g[last]]
        if held and (found := list(flush(pd.concat(held)))):
            yield pd.DataFrame(found, columns=["a", "b"])

    return run


def blocks_for(n: int, distance: int = 3) -> int:
    """The least number of blocks whose keys are long enough that n fingerprints meet few strangers under one key, 10 at most."""
    for blocks in range(distance + 2, 10):
        bits = sum(sorted(bin(m).count("1") for m in block_masks(blocks, distance))[:1])
        if n >> bits <= 4:
            return blocks
    return 10


def fingerprint_components(fps: DataFrame, distance: int = 3, blocks: int | None = None, tile: int = 2048) -> DataFrame:
    """fps(fp long, distinct) -> (fp, root) for fingerprints that link with another one. blocks: blocks_for() their number unless given; any finds every link."""
    masks = block_masks(blocks or blocks_for(fps.count(), distance), distance)
    keys = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(masks)])).alias("x")).select("fp", "x.k", "x.v")
    heads = keys.groupBy("k", "v").agg(F.min("fp").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(keys.join(heads, ["k", "v"]), "simhash-keys")  # only keys with company
    direct = shared.where((F.col("fp") != F.col("head")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("head"))) <= distance))
    first = stored(connected_components(direct.select(F.col("fp").alias("a"), F.col("head").alias("b"))), "simhash-first")

    named = shared.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("k", "v", "fp", "n", F.coalesce("root", "fp").alias("comp"))
    named = stored(named, "simhash-named")
    discard(shared)
    open_keys = named.groupBy("k", "v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("k", "v")
    tiles = F.ceil(F.col("n") / tile).cast("long")
    rows = named.join(open_keys, ["k", "v"]).withColumn("tile", F.pmod(F.xxhash64("fp"), tiles))
    rows = rows.withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    rows = rows.select("k", "v", F.least("tile", "u").alias("i"), F.greatest("tile", "u").alias("j"), "fp", "tile", "comp")
    more = rows.repartition("k", "v", "i", "j").sortWithinPartitions("k", "v", "i", "j").mapInPandas(_tile_links(distance), "a long, b long")
    tree = first.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a != b")
    out = stored(connected_components(tree.union(more)), "simhash-roots")
    for done in (named, first):
        discard(done)
    return out.select(F.col("node").alias("fp"), "root")


def _named(docs: DataFrame, id_col: str, text_col: str, distance: int, shingle: int, blocks: int | None) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of every row, and (fp, least: the smallest id with it, rows, root, all: the rows of the root) of every fingerprint."""
    small_batches(docs.sparkSession)
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    groups = stored(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-groups")
    roots = fingerprint_components(groups.select("fp"), distance, blocks)
    return rows, stored(groups.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "simhash-fps")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, shingle: int = 3, blocks: int | None = None) -> DataFrame:
    """(id_col, fingerprint string, component_id long): documents whose fingerprints are joined by links of at most
    `distance` bits share a component, named by its smallest id.

    Null and empty texts and texts of white space have fingerprint zero and link like any other; a text of fewer words than
    a shingle is one shingle; a very long one is hashed whole, in pieces; a repeated row gets a row each; rows with a null id are returned with
    the component of their fingerprint; an empty table gives an empty table. Other columns of docs are ignored.
    """
    rows, named = _named(docs, id_col, text_col, distance, shingle, blocks)
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    by_fp = joined_hot(named, of_root, "root", "fps").select("fp", "component_id", "n")
    return joined_hot(rows, by_fp, "fp", "n").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, shingle: int = 3, blocks: int | None = None, most_repeated: int = 100_000) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest id and, among rows with that id, of the smallest fingerprint.

    Rows with one id whose texts are no near duplicates are of different groups, so each group keeps its own. Of rows with one id and
    one fingerprint the smallest text stays. Rows with a null id name no document and stay. An empty table gives none; columns may have any names. Up to
    most_repeated ids that more than one row has go to every task, more are joined.
    """
    rows, named = _named(docs.where(F.col(id_col).isNotNull()), id_col, text_col, distance, shingle, blocks)
    kept = named.groupBy("root").agg(F.min(F.struct("least", "fp")).alias("k")).select(F.col("k.least").alias("id"), F.col("k.fp").alias("fp"))
    kept = stored(kept, "simhash-kept")
    repeated = stored(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "simhash-repeated")
    n = repeated.count()
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    key = F.col(own).cast("long") == F.col("id")
    # the kept ids grow with the corpus, so they are never sent to every task: both sides are dealt by id at any size
    if not n:
        return plain.join(kept.select("id").hint("merge"), key, "left_semi").unionByName(plain.where(F.col(own).isNull())).toDF(*docs.columns)
    few = F.broadcast(repeated) if n <= most_repeated else repeated.hint("merge")  # rows of a hot id are not dealt by it
    alone = plain.join(few, key, "left_anti")  # null ids too
    some = stored(plain.join(few, key, "left_semi"), "simhash-some")

    def run(batches):
        for b in batches:
            yield b.assign(fp=np.array([fingerprint(t, shingle) for t in b[text]], dtype=np.uint64).view(np.int64))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in some.schema.fields)
    order = F.struct(F.col(text), *[F.to_json(F.struct(c)) for c in plain.columns])
    first = some.mapInPandas(run, f"{kinds}, fp long").groupBy(F.col(own).cast("long").alias("id"), "fp").agg(F.min_by(F.struct(*plain.columns), order).alias("r"))
    first = first.join(kept, ["id", "fp"], "left_semi").select("r.*")
    out = alone.join(kept.select("id").hint("merge"), key, "left_semi").unionByName(alone.where(F.col(own).isNull())).unionByName(first)
    return out.toDF(*docs.columns)
