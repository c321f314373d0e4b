"""Language identification by hierarchical discrimination.

Features are hashed byte pairs and triples of the whole lower-cased text with everything but letters as a space. Linear support
vector machines, one a family against the rest, choose a language family; one-versus-one machines between the family's
languages vote within it. Training rows are bounded by `per_language` and `in_total` documents (chosen by hash); every language
has a share, so with more than in_total / 20 languages the total grows by 20 documents for each.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches

DIMS = 8192
_ASCII = bytes(c if 97 <= c <= 122 or c >= 0x80 else 32 for c in range(256))
_OTHER = regex.compile(r"[^\p{L}\p{M}\x00-\x7f]+")  # what is beyond ASCII and no letter, nor a mark on one

# ISO 639-1 codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en is nl nb nn no sv",
    "romance": "ca es fr gl it pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indic": "bn gu hi mr ne pa ur",
}


def family(lang: str) -> str:
    base = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if base in codes.split()), lang)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))  # Unicode category L


def features(text: str) -> np.ndarray:
    """Unit vector of square roots of hashed counts."""
    if not text.isascii():
        text = _OTHER.sub(" ", text)
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_ASCII).split()) + b" ", np.uint8).astype(np.uint32)
    total = np.zeros(DIMS)
    for at in range(0, len(raw), 1 << 20):  # a very long text is counted in pieces
        r = raw[max(0, at - 2) : at + (1 << 20)]
        two = r[:-1] << 8 | r[1:]
        three = two[:-1] << 8 | r[2:]
        for code, salt in ((two, 0x9E3779B1), (three, 0x85EBCA6B)):
            total += np.bincount((code * np.uint32(salt)) >> np.uint32(32 - 13), minlength=DIMS)
    x = np.sqrt(total)
    return x / max(np.linalg.norm(x), 1e-12)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 200) -> np.ndarray:
    """Weights, constant last, of a linear machine with squared hinge loss (y is +1 or -1), by accelerated gradient descent."""
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))  # both sides weigh the same
    z = np.column_stack([x, np.ones(len(x), x.dtype)])
    each, y = each.astype(z.dtype), y.astype(z.dtype)  # one type throughout, or numpy copies z each time
    w = look = np.zeros(z.shape[1], z.dtype)
    step, t = 1 / (1 / c + 4.0), 1.0
    for _ in range(rounds):
        slack = np.maximum(z.dtype.type(0), 1 - y * (z @ look))
        new = look - step * (look / c - 2 * z.T @ (each * slack * y))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look, w = (new + (before - 1) / t * (new - w)).astype(z.dtype), new
    return w.astype(np.float64)


def train(rows: pd.DataFrame) -> dict | None:
    """rows(lang, x). The machines, stacked."""
    if not len(rows):
        return None
    x, lang = np.stack(rows["x"]).astype(np.float32), rows["lang"].to_numpy()
    langs = sorted(set(lang))
    kin = np.array([family(v) for v in lang])
    families = sorted(set(kin))
    over = np.array([svm(x, np.where(kin == f, 1.0, -1.0)) for f in families]) if len(families) > 1 else np.zeros((1, DIMS + 1))
    pairs = [(a, b) for a, b in combinations(langs, 2) if family(a) == family(b)]
    within = []
    for a, b in pairs:
        some = (lang == a) | (lang == b)
        within.append(svm(x[some], np.where(lang[some] == a, 1.0, -1.0)))
    return {"families": families, "over": over, "pairs": pairs, "within": np.array(within).reshape(len(pairs), DIMS + 1), "members": {f: [v for v in langs if family(v) == f] for f in families}}


def predict(text: str | None, model: dict | None) -> tuple[str, float]:
    """(language, score). und and 0 for a text without a letter or a model without languages."""
    if not text or model is None or not has_letter(text):
        return "und", 0.0
    x = np.append(features(text), 1.0)
    odds = lambda m: 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))
    margin = model["over"] @ x
    best = int(margin.argmax())
    p = odds(margin) if len(margin) > 1 else np.ones(1)
    members, of = model["members"][model["families"][best]], p[best] / max(p.sum(), 1e-12)
    if len(members) == 1:
        return members[0], float(of)
    votes, sure = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
    for (a, b), m in zip(model["pairs"], model["within"] @ x):
        if a in votes:
            q = odds(m)
            votes[a] += m >= 0
            votes[b] += m < 0
            sure[a] += q
            sure[b] += 1 - q
    win = max(members, key=lambda v: (votes[v], sure[v]))
    return win, float(of * sure[win] / (len(members) - 1))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600, in_total: int = 4000) -> DataFrame:
    """(id_col, held_out, lang_pred, score): learned from rows with a label whose crc32(id as text) mod 3 is not 1.

    lang_pred is und, with score 0, for texts that are null or have no letter, and for every text if no row can be learned from. A null
    id counts as the empty string in the checksum, and its row is predicted like any other. Repeated rows get a row
    each; an empty table gives none; a very long text is counted whole, in pieces; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.withColumn("held_out", F.expr("crc32(coalesce(cast(id as string), '')) % 3 = 1"))
    seen = rows.where("not held_out and lang is not null and t is not null")
    counts = {r["lang"]: r["count"] for r in seen.groupBy("lang").count().collect()}
    in_total = max(in_total, 20 * len(counts))
    each = min(per_language, in_total // max(1, len(counts)))
    shares = docs.sparkSession.createDataFrame([(k, each / n) for k, n in counts.items()], "lang string, share double")
    taken = seen.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id", "t"), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def count(batches):
        for b in batches:
            b = b[[has_letter(t) for t in b["t"]]]
            if not len(b):
                continue
            x = [features(t).astype(np.float32) for t in b["t"]]
            yield pd.DataFrame({"lang": b["lang"], "at": [np.flatnonzero(v).astype(np.int32) for v in x], "v": [v[v > 0] for v in x]})

    learned = taken.select("t", "lang").mapInPandas(count, "lang string, at array<int>, v array<float>").limit(2 * in_total).toPandas()
    dense = []
    for at, v in zip(learned["at"], learned["v"]):
        x = np.zeros(DIMS, np.float32)
        x[at] = v
        dense.append(x)
    model = train(pd.DataFrame({"lang": learned["lang"], "x": dense}))

    def run(batches):
        for b in batches:
            out = [predict(t, model) for t in b["t"]]
            yield pd.DataFrame({"id": b["id"], "held_out": b["held_out"], "lang_pred": [o[0] for o in out], "score": [o[1] for o in out]})

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.select("id", "held_out", "t").mapInPandas(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
