"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, embed_dedup, html_main, langid, licences, packing, quality, secrets, simhash


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    return found.select("doc_id", *[_count(k).cast("long").alias(f"n_{k}") for k in secrets.KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def _count(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no paths, so they are laid out as source/lang/group/file; short ones stand for licence files, the shortest further up."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.expr("case when n_chars < 150 then concat_ws('/', source, 'LICENSE') when n_chars < 250 then concat_ws('/', source, lang, 'LICENSE') when n_chars < 400 then concat_ws('/', source, lang, doc_id div 64, 'LICENSE') else concat_ws('/', source, lang, doc_id div 64, concat(doc_id, '.txt')) end")
    return licences.scan(docs.withColumn("path", path), "doc_id", "path", "text", F.col("n_chars") < 400)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    rows = rows.union(spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string"))
    out = chat.format_conversations(rows).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learned", chat.under_mask(F.col("formatted"), F.col("loss")))
    told = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_main.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_decontamination, op3_secrets, op4_licences, op5_quality, op6_embedding_dedup, op7_language, op8_chat, op9_simhash, op10_html)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _licence_sql() -> str:
    """Every part of every text against every form, without the operator's bounds."""
    idf, other, unit = licences.weights(licences.NOTICES)
    rare = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in sorted(idf.items()))
    forms = ", ".join(f"('{k}', '{k.split('#')[0]}', '{w}', {x!r}::DOUBLE)" for k, v in unit.items() for w, x in sorted(v.items()))
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    return f"""
WITH idf(w, x) AS (VALUES {rare}), tpl(form, name, w, x) AS (VALUES {forms}),
files AS (SELECT row_number() OVER () AS uid, doc_id, lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9\n]+', ' ', 'g')) AS text, coalesce(n_chars < 400, false) AS is_licence, CASE WHEN n_chars < 150 THEN source || '/LICENSE' WHEN n_chars < 250 THEN source || '/' || lang || '/LICENSE'
  WHEN n_chars < 400 THEN source || '/' || lang || '/' || (doc_id // 64) || '/LICENSE' ELSE source || '/' || lang || '/' || (doc_id // 64) || '/' || doc_id || '.txt' END AS path FROM documents),
lines AS (SELECT uid, list(line ORDER BY place) AS l FROM (SELECT uid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM files) WHERE trim(line) <> '' GROUP BY uid),
starts AS (SELECT uid, l, k, unnest(range(1, greatest(len(l) - k + 1, 1) + 1)) AS i FROM lines, (VALUES (1), {", ".join(f"({k})" for k in licences.WINDOWS)}) v(k)),
raw AS (SELECT uid, array_to_string(l[i:i + k - 1], ' ') AS part FROM starts UNION SELECT uid, unnest(regexp_split_to_array(text, '\n *\n')) FROM files UNION SELECT uid, text FROM files WHERE is_licence),
parts AS (SELECT uid, row_number() OVER () AS part, [w for w in regexp_extract_all(part, '[a-z0-9]+') if NOT list_contains({listed(licences.STOP)}, w)] AS words FROM raw),
terms AS (SELECT uid, part, t.w, count(*) * coalesce(max(idf.x), {other!r}) AS x FROM (SELECT uid, part, unnest(words) AS w FROM parts WHERE list_has_any(words, {listed(sorted(idf))})) t LEFT JOIN idf USING (w) GROUP BY ALL),
norms AS (SELECT part, sqrt(sum(x * x)) AS norm FROM terms GROUP BY ALL),
scores AS (SELECT uid, part, form, max(tpl.name) AS name, round(sum(terms.x * tpl.x) / max(norm), 6) AS score FROM terms JOIN tpl USING (w) JOIN norms USING (part) GROUP BY uid, part, form),
own AS (SELECT uid, max(score) AS own_score, arg_min(name, (-score, name)) AS own FROM scores WHERE score >= 0.6 GROUP BY ALL),
dirs AS (SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, is_licence, own, own_score FROM files LEFT JOIN own USING (uid)),
lend AS (SELECT dir AS above, arg_min(own, (-own_score, own)) AS lent FROM dirs WHERE is_licence AND own IS NOT NULL GROUP BY ALL),
near AS (SELECT dir, arg_max(lent, length(above)) AS lent FROM (SELECT DISTINCT dir FROM dirs) d JOIN lend ON d.dir = above OR starts_with(d.dir, above || '/') GROUP BY ALL)
SELECT doc_id, path, own, own_score, coalesce(own, lent) AS licence, CASE WHEN own IS NOT NULL THEN 'own' WHEN lent IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin
FROM dirs LEFT JOIN near USING (dir)"""


SQL = {
    "op2_decontamination": f"""
WITH items AS (SELECT DISTINCT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
wins AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, row_number() OVER () AS uid, coalesce({_WORDS}, []) AS w FROM documents),
dwins AS (SELECT uid, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT uid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)),
hits AS (SELECT uid, i, dwins.k, item_id FROM dwins JOIN wins ON dwins.k = wins.k AND dwins.g = wins.g),
hit AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(i, i + k)) AS p FROM hits) GROUP BY uid),
found AS (SELECT uid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT uid, item_id FROM hits) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (uid) LEFT JOIN found USING (uid)""",
    "op4_licences": _licence_sql(),
    "op6_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), sound AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND list_sum([CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END for x in e]) = 0 AND list_sum([CASE WHEN x <> 0 THEN 1 ELSE 0 END for x in e]) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM v LEFT JOIN n ON vec_id = n.a LEFT JOIN least ON vec_id = least.a""",
    "op8_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) AS marked FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + marked + 6 + 6 + 5)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id""",
}
