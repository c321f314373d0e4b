"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's word windows.

Texts are normalised byte by byte: A-Z become a-z, every other ASCII character that is no letter or digit separates words. Each
run of `window` words of an item (a shorter item as a whole) is a pattern of word codes; a text is scanned once, as the codes of its words, matches
are kept as word positions, and those are mapped back to offsets of the original text.

The benchmark's size is measured first. Up to `max_bytes` of text go to every executor, and a Python worker builds the automaton once, for all its
tasks; beyond it the items are dealt into parts of that size, and the texts are scanned for each part in turn, with results written in between.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches, stored

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def build(items: list[tuple[str, str | None]], window: int):
    """(the codes of words and of any other word, the automaton over them: pattern -> (its words, ids of its items)). None if no item has words.

    A code is two signs, the first and second from alphabets of their own, so a match starts and ends with words and no node has many children.
    """
    import ahocorasick

    words = [(item, w) for item, text in items if (w := words_of(text))]
    known = sorted({x for _, w in words for x in w})
    if not known:
        return None
    base = math.isqrt(len(known)) + 1
    code = [chr(256 + i // base) + chr(256 + base + i % base) for i in range(len(known) + 1)]
    codes = dict(zip(known, code[1:]))
    of: dict[str, list[str]] = {}
    for item, w in words:
        told = "".join([codes[x] for x in w])
        for i in range(max(1, len(w) - window + 1)):
            of.setdefault(told[2 * i : 2 * (i + window)], []).append(item)
    automaton = ahocorasick.Automaton()
    for pattern, ids in of.items():
        automaton.add_word(pattern, (len(pattern) // 2, tuple(ids)))
    automaton.make_automaton()
    return codes, code[0], automaton


_built: dict = {}  # the automaton that a worker built last, by the number of its broadcast


def built(key, items, window: int):
    if key not in _built:
        _built.clear()
        _built[key] = build(items(), window)
    return _built[key]


def scan(known, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(words, hit runs of words as (first, end), items) of one text."""
    words = words_of(text)
    if not words or known is None:
        return len(words), [], set()
    codes, other, automaton = known
    get = codes.get
    found = list(automaton.iter("".join([get(w, other) for w in words])))
    if not found:
        return len(words), [], set()
    runs: list[list[int]] = []
    for start, end in sorted(((at + 1) // 2 - n, (at + 1) // 2) for at, (n, _) in found):
        if runs and runs[-1][1] >= start:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return len(words), [(a, b) for a, b in runs], set().union(*(v[1] for _, v in found))


def word_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Offsets (code points) of runs of words in the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    plain = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], plain.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in runs]


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanned(docs: DataFrame, benchmark: DataFrame, names: list[str], text_col: str, item_col: str, item_text: str, window: int, max_bytes: int) -> DataFrame:
    """k0, k1, ... for names, with n_words, runs, items, spans and n_hit."""
    spark = docs.sparkSession
    small_batches(spark)
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("s"), F.max(F.octet_length("text")).alias("m")).first()
    parts = max(1, -(-size["s"] // max_bytes))
    held = f"k{names.index(text_col)}" if text_col in names else "t"  # a kept text goes to Python once
    out = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], *([F.col(text_col).cast("string").alias("t")] if held == "t" else []))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields)
    result = "n_words long, runs array<struct<start:long,end:long>>, items array<string>"
    bench = bench.withColumn("p", F.pmod(F.xxhash64("item"), F.lit(parts)))
    for p in range(parts):
        some = [(r["item"], r["text"]) for r in bench.where(F.col("p") == p).select("item", "text").collect()]  # about max_bytes
        shared = spark.sparkContext.broadcast(some)

        def run(batches, shared=shared, again=p > 0, key=uuid.uuid4().hex):
            known = built(key, lambda: shared.value, window)
            for b in batches:
                found = [scan(known, t) for t in b[held]]
                runs, items = [f[1] for f in found], [sorted(f[2]) for f in found]
                if again:
                    runs = [_merge([*r, *((x["start"], x["end"]) for x in old)]) for r, old in zip(runs, b["runs"])]
                    items = [sorted({*i, *old}) for i, old in zip(items, b["items"])]
                yield b.assign(n_words=[f[0] for f in found], runs=runs, items=items)

        out = out.mapInPandas(run, f"{schema}, {result}")
        if p + 1 < parts:
            out = stored(out, "decontam")

    def place(batches):
        for b in batches:
            b["spans"] = [word_spans(t, [(x["start"], x["end"]) for x in r]) if len(r) else [] for t, r in zip(b[held], b["runs"])]
            b["n_hit"] = [sum(x["end"] - x["start"] for x in r) for r in b["runs"]]
            yield b

    return out.mapInPandas(place, f"{schema}, {result}, spans array<struct<start:long,end:long>>, n_hit long")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, max_bytes: int = 2 << 20, keep: list[str] | None = None) -> DataFrame:
    """docs' id and kept columns, with n_words, n_hit (words inside any occurring window), items (sorted strings) and spans
    (start and end of each hit run in the original text, code points).

    Null texts have no words; items without words or without an id match nothing; items with the same id are one; repeated
    documents get a row each; an empty table on either side gives no rows or no hits; a very long text is scanned whole. Kept columns may have any
    names but those of the results; see clean(). max_bytes bounds a worker's memory: an automaton took 95 times its items' text, and 2 s to build for each MB.
    """
    names = list(dict.fromkeys([id_col, *(keep or [])]))
    out = _scanned(docs, benchmark, names, text_col, item_col, item_text, window, max_bytes)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "n_words", "n_hit", "items", "spans")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, max_bytes: int = 2 << 20) -> DataFrame:
    """The rows of docs without a hit, with the columns of docs, whatever their names."""
    out = _scanned(docs, benchmark, docs.columns, text_col, item_col, item_text, window, max_bytes).where("n_hit = 0")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
