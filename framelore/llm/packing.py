"""Packing documents into training sequences as a cutting-stock problem.

A document is tokenised, closed with an end id and cut every `width` ids. Whole pieces are sequences as
they are. The rests (shorter than `width`) are ordered items: their histogram over length classes feeds a linear program
whose columns are cutting patterns. Column generation prices patterns with an unbounded knapsack dynamic
program until none improves, the solution is rounded, and copies of each pattern are dealt to the documents by
their rank within a class. Rests that no full pattern takes are cut into their powers of two, which fill
sequences without a gap; the last such sequence is cut at powers of two as well.

Everything that reaches the driver is a histogram over classes, bounded by the width; documents are ranked by
partition counts, so one very common length never meets in one task.
"""

from __future__ import annotations

import warnings
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import numbered, small_batches, stored, with_global_rank

WIDTH = 2048
END_ID = 1
# Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes.

    The rank file beside the tokenizer's holds the same vocabulary for a faster library, with the same ids (tests hold the two
    together). Texts that the faster one would treat otherwise or slowly go to the tokenizer itself: those with a
    special token's string, and those with a run of 2,000 signs without white space, whose merging is quadratic there.
    """

    def __init__(self, path: str):
        import base64
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.odd = re.compile(r"\S{2000}").search

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special) or self.odd(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.array(self.fast(text), dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def lengths_of(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, width: int, step: int, end_id: int) -> DataFrame:
    """Tokenise once; one row per document with its piece checksums and its rank among the partition's documents of its class."""

    def run(batches):
        from pyspark import TaskContext

        part, encode, end = TaskContext.get().partitionId(), encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        full_before, seen = 0, {}
        for b in batches:
            out = []
            for doc, text in zip(b["id"].array, b["t"]):
                ids = memoryview(encode(text or "") + end)
                n = len(ids) // 4
                full, rest = divmod(n, width)
                at, bits = full * width, []
                for j in reversed(range(width.bit_length())):
                    if rest >> j & 1:
                        bits.append((j, at, zlib.crc32(ids[4 * at : 4 * (at + (1 << j))])))
                        at += 1 << j
                cls = -(-rest // step)
                rank = seen.get(cls, 0)
                seen[cls] = rank + 1
                out.append((doc, n, part, full_before, rest, cls, rank, [zlib.crc32(ids[4 * k * width : 4 * (k + 1) * width]) for k in range(full)], zlib.crc32(ids[4 * full * width :]), bits))
                full_before += full
            yield pd.DataFrame(out, columns=["id", "n", "part", "full_before", "rest", "cls", "local", "full_crcs", "rest_crc", "bits"])

    schema = "id long, n long, part int, full_before long, rest int, cls int, local long, full_crcs array<long>, rest_crc long, bits array<struct<j:int,start:long,crc:long>>"
    return stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInPandas(run, schema), "packing-lengths")


def best_pattern(value: np.ndarray, weight: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of weights (ascending) within room."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(weight, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c], last[c] = best[c - 1], -1
        if k := upto[c]:
            got = best[c - weight[:k]] + value[:k]
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], last[c] = got[i], i
    pattern, c = np.zeros(len(weight), np.int64), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= weight[last[c]]
    return float(best[room]), pattern


def first_patterns(weight: np.ndarray, need: np.ndarray, room: int) -> np.ndarray:
    """A basis to start from, a pattern in each column: the largest class that is left, filled up as well as can be by the knapsack, in
    as many (also fractional) copies as use up one of its classes. A column has nothing of classes that were used up before it, so the
    basis is triangular.
    """
    left, basis = need.copy(), np.diag(room // weight).astype(float)
    while len(alive := np.flatnonzero(left > 0)):
        column, rest = np.zeros(len(weight)), int(room - weight[alive[-1]])
        column[alive[-1]] = 1
        if rest >= weight[alive[0]]:
            likely = 1 + 0.01 * left[alive] / left[alive].max()  # of equal fills, what is plentiful
            column[alive] += best_pattern(weight[alive] * likely, weight[alive], rest)[1]
        copies = np.where(column > 0, left / np.where(column > 0, column, 1), np.inf)
        i = int(copies.argmin())
        basis[:, i] = column
        left = np.maximum(left - copies[i] * column, 0)
        left[left < 1e-9] = 0
        left[i] = 0
    return basis


def inverted(matrix: np.ndarray) -> np.ndarray:
    """By elimination on the few entries of a column; the library's routine was seen to hang in a driver with many threads."""
    a, out = matrix.astype(float), np.eye(len(matrix))
    for c in range(len(a)):
        p = c + int(np.abs(a[c:, c]).argmax())
        a[[c, p]], out[[c, p]] = a[[p, c]], out[[p, c]]
        out[c] /= a[c, c]
        a[c] /= a[c, c]
        rows = np.flatnonzero(a[:, c])
        rows = rows[rows != c]
        out[rows] -= a[rows, c][:, None] * out[c]
        a[rows] -= a[rows, c][:, None] * a[c]
    return out


def cutting_stock(demand: dict[int, int], room: int, rounds: int = 1500) -> list[tuple[dict[int, int], int]]:
    """(pattern {weight: how many}, copies) whose total never exceeds the demand and whose copies are full.

    Linear program: fewest sequences covering the demand; columns come from best_pattern. Full: no room for one more unit.
    """
    weight = np.array(sorted(demand), dtype=np.int64)
    if not len(weight):
        return []
    need = np.array([demand[w] for w in weight.tolist()], dtype=float)
    patterns = first_patterns(weight, need, room)
    inverse = inverted(patterns)
    x = np.maximum(inverse @ need, 0)
    for _ in range(rounds):
        value, column = best_pattern(inverse.sum(axis=0), weight, room)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-7, x / np.where(step > 1e-7, step, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        ties = np.flatnonzero(ratio <= ratio.min() + 1e-9)
        out = int(ties[step[ties].argmax()])  # of equal ratios the largest pivot, for the sake of the numbers
        amount = ratio[out]
        x = np.maximum(x - amount * step, 0)
        x[out] = amount
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
        patterns[:, out] = column
    else:
        warnings.warn(f"the linear program was stopped after {rounds} rounds; padding may be above the least", RuntimeWarning, stacklevel=2)
    used, full = patterns.astype(np.int64), weight @ patterns == room
    left, whole = need.astype(np.int64), np.zeros(len(weight), np.int64)
    for up in (0, 1):  # round down, then up, as far as the demand lasts
        for k in np.flatnonzero(full)[np.argsort(-x[full], kind="stable")]:
            most = int((left[used[:, k] > 0] // used[used[:, k] > 0, k]).min())
            copies = min(most, max(0, int(min(x[k], 2**53) + 1e-9) + up - int(whole[k])))
            whole[k] += copies
            left -= copies * used[:, k]
    return [({int(w): int(a) for w, a in zip(weight, used[:, k]) if a}, int(whole[k])) for k in np.flatnonzero(full & (whole > 0))]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, step: int = 4, end_id: int = END_ID) -> DataFrame:
    """Pieces (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every document of docs.

    width is a power of two. Each id of a document lies in one piece; a sequence holds at most width ids, its offsets have no
    gaps. step is the width of a length class in ids: a pattern's sequence is short of width by less than step ids an item.
    Null and empty texts have the end id alone; a repeated row is a document of its own; a null id is carried;
    an empty table gives no pieces; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = lengths_of(docs, id_col, text_col, tokenizer, width, step, end_id)
    demand = {r["cls"]: r["count"] for r in rows.where("cls > 0").groupBy("cls").count().collect()}
    spans, taken, sequences = [], dict.fromkeys(demand, 0), 0
    for pattern, copies in cutting_stock(demand, width // step):
        for cls, each in pattern.items():
            spans.append((cls, taken[cls], taken[cls] + copies * each, each, sequences))
            taken[cls] += copies * each
        sequences += copies
    plan = spark.createDataFrame(spans, "cls int, lo long, hi long, each long, first long")  # at most classes x classes rows

    ranked = with_global_rank(rows.where("cls > 0"), "cls", "part", "local", "rank")
    ranked = stored(ranked.select("id", "n", "rest", "cls", "rank", "rest_crc", "bits"), "packing-ranked")
    dealt = ranked.join(F.broadcast(plan), (ranked["cls"] == plan["cls"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left").drop(plan["cls"])
    dealt = stored(dealt.withColumn("sequence_id", F.expr("first + (rank - lo) div each")), "packing-dealt")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("cls"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    patterned = dealt.where("sequence_id is not null").select(
        "id", (F.col("n") - F.col("rest")).alias("start"), F.col("rest").cast("long").alias("length"), F.col("rest_crc").alias("ids_crc32"), "n", "sequence_id",
        F.coalesce(F.sum("rest").over(inside), F.lit(0)).cast("long").alias("offset"))

    cut = numbered(dealt.where("sequence_id is null").select("id", "n", F.explode("bits").alias("b")).select("id", "n", "b.j", "b.start", "b.crc"), "j", "packing-cut")
    many = {r["j"]: r["count"] for r in cut.groupBy("j").count().collect()}  # at most log2(width) rows
    base, total = {}, 0
    for j in sorted(many, reverse=True):
        base[j], total = total, total + (many[j] << j)
    at = F.col("base") + F.col("rank") * F.col("length")
    tail, ends, block = total // width * width, [], total // width * width
    for j in reversed(range(width.bit_length())):
        if (total - tail) >> j & 1:
            ends.append(block)
            block += 1 << j
    head = number = F.lit(None).cast("long")
    for i, start in enumerate(ends):
        head, number = (F.when(F.col("at") >= start, F.lit(v)).otherwise(c) for v, c in ((start, head), (i, number)))
    sizes = spark.createDataFrame([(j, base[j], 1 << j) for j in many], "j int, base long, length long")
    cut = cut.join(F.broadcast(sizes), "j").withColumn("at", at)
    scraps = cut.select(
        "id", "start", "length", F.col("crc").alias("ids_crc32"), "n",
        (F.lit(sequences) + F.coalesce(F.lit(tail // width) + number, F.expr(f"at div {width}"))).cast("long").alias("sequence_id"),
        F.coalesce(F.col("at") - head, F.col("at") % width).alias("offset"))
    sequences += tail // width + len(ends)

    counts = rows.groupBy("part").agg(F.sum(F.size("full_crcs")).alias("here"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per input partition
    bases = counts.select("part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("parts_before"))
    whole = rows.where(F.size("full_crcs") > 0).join(bases, "part").select("id", "n", "full_before", "parts_before", F.posexplode("full_crcs").alias("k", "crc"))
    whole = whole.select("id", (F.col("k") * F.lit(width)).cast("long").alias("start"), F.lit(width).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "n", (F.lit(sequences) + F.col("parts_before") + F.col("full_before") + F.col("k")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    pieces = whole.union(patterned).union(scraps)
    return pieces.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", F.col("n").alias("doc_tokens"), "sequence_id", "offset")


def sequence_ids(pieces: DataFrame, docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids array<int>): the sequences themselves, for documents whose ids are unique; texts are tokenised again."""

    def run(batches):
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = []
            for text, found in zip(b["t"], b["p"]):
                ids = encode(text or "") + end
                out += [(p["sequence_id"], p["offset"], np.frombuffer(ids, "<u4")[p["start"] : p["start"] + p["length"]].astype(np.int32)) for p in found]
            if out:
                yield pd.DataFrame(out, columns=["sequence_id", "offset", "ids"])

    own = pieces.groupBy(id_col).agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("p"))
    parts = docs.select(id_col, F.col(text_col).alias("t")).join(own, id_col).mapInPandas(run, "sequence_id long, offset long, ids array<int>")
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
