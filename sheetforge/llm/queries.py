"""Registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetforge.llm import bpe, chat, clustering, decontamination, fingerprints, html, jaccard_join, mixing, secrets, sharding, toxicity, training_order, whitening
from sheetforge.llm.common import table

#: Production weights of the mix: the hot source is held at a fifth, two more are fixed, the others share the rest.
MIX_WEIGHTS = {"src0": 0.2, "src1": 0.08, "src2": 0.08, "*": 0.64}


def _fold(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; learned from labelled rows outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(_fold() != 0))
    out = toxicity.score(docs, model, carry=["doc_id"])
    return out.select("doc_id", (_fold() == 0).alias("held_out"), "score", "predicted", "hits", "words")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of 0.8 Jaccard similarity on 5-word shingles."""
    out = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), k=5, percent=80)
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says control strings, formatted and read back from the output."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_turns(chat.canonical_turns(turns, "conv_id")))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract_main_text(table(spark, sf_dir, "pages"), carry=["page_id", "url"])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 words of all benchmark items in all documents, by the positional index."""
    out = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return out.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret candidates of all documents with the forest's word on each; the secret itself isn't shown."""
    out = secrets.scan(table(spark, sf_dir, "documents"))
    shown = F.concat(F.left("candidate", F.lit(4)), F.lit("..."))
    return out.select(F.col("doc").alias("doc_id"), "path", "place", shown.alias("shown"), F.sha2("candidate", 256).alias("candidate_sha256"), *secrets.FEATURES, "label", "probability", "is_secret")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of all documents and of their edited texts, with likenesses."""
    pairs = fingerprints.edited_pairs(table(spark, sf_dir, "documents"))
    own, edited, following = (fingerprints.hashes(F.col(c)) for c in ("selected", "edited_selected", "next_selected"))
    sets = pairs.withColumns({"_own": own, "_edited": edited, "_next": following})
    return sets.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("selected")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_selected")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("_own"), F.col("_edited")).alias("near_edited"),
        fingerprints.likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to MIX_WEIGHTS, in their global order; one row per copy."""
    out = mixing.mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return out.select("doc_id", "source", "copy", "mix_key")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes; equal texts stay together."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    out = sharding.assign_shards(docs, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of 512 token ids, written as shards in training order; one row per sequence."""
    rows, _ = training_order.materialise(table(spark, sf_dir, "documents"))
    return rows.select(F.col("doc").alias("doc_id"), "chunk", "slot", "shard", "byte_offset", "n_tokens", "tokens_crc32")


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64-dimensional vectors in 40 clusters after five rounds."""
    return clustering.cluster(table(spark, sf_dir, "embeddings"), dims=64, k=40, rounds=5).withColumnRenamed("id", "vec_id")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors along the 16 strongest components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16).withColumnRenamed("id", "vec_id")


#: JSON file of the byte-level vocabulary that op13 encodes with.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and the text that they decode to."""
    ids = bpe.encode(table(spark, sf_dir, "documents"), TOKENIZER, carry=["doc_id"])
    out = bpe.decode(ids, TOKENIZER)
    digest = F.sha2(F.col("decoded").cast("binary"), 256)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), digest.alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_jaccard": op2_jaccard,
    "op3_chat": op3_chat,
    "op4_html": op4_html,
    "op5_decontamination": op5_decontamination,
    "op6_secrets": op6_secrets,
    "op7_fingerprints": op7_fingerprints,
    "op8_mixing": op8_mixing,
    "op9_sharding": op9_sharding,
    "op10_training_order": op10_training_order,
    "op11_clusters": op11_clusters,
    "op12_whitening": op12_whitening,
    "op13_bpe": op13_bpe,
}

ORACLES: dict[str, str] = {}

ORACLES["op5_decontamination"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (
  SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, dg.n, s, item_id FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN spots USING (doc_id) LEFT JOIN found USING (doc_id)
"""

ORACLES["op8_mixing"] = """
WITH sizes AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY 1),
weights AS (SELECT * FROM (VALUES ('src0', 0.2), ('src1', 0.08), ('src2', 0.08)) t(source, w)),
free AS (SELECT sum(sqrt(n)) FILTER (WHERE w IS NULL) AS f, sum(n) AS total FROM sizes LEFT JOIN weights USING (source)),
rates AS (SELECT source, coalesce(w, 0.64 * sqrt(n) / f) * total / n AS r FROM sizes LEFT JOIN weights USING (source), free),
steps AS (SELECT source, j, sum(exp(-r) * pow(r, j) / gamma(j + 1)) OVER (PARTITION BY source ORDER BY j) AS c
  FROM rates, (SELECT unnest(range(0, 120)) AS j)),
drawn AS (SELECT doc_id, d.source, ('0x' || substr(md5('17|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents d),
counts AS (SELECT doc_id, drawn.source, count(*) AS k FROM drawn JOIN steps ON drawn.source = steps.source AND u >= c GROUP BY 1, 2)
SELECT doc_id, source, copy::INTEGER AS copy, md5('17|' || doc_id || '|' || copy) AS mix_key
FROM (SELECT doc_id, source, unnest(range(0, k)) AS copy FROM counts)
"""

ORACLES["op3_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|/?INST\]|</?SYS>>)')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

ORACLES["op2_jaccard"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + least(len(w), 5) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT a, b FROM steps UNION SELECT reach.doc_id, steps.b FROM reach JOIN steps ON steps.a = reach.other)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1) USING (doc_id)
"""

ORACLES["op7_fingerprints"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt,
  coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM d),
e AS (SELECT doc_id, t, next_id, left(t, length(t) - length(t) // 4) || left(nt, length(t) // 4) AS edited FROM n),
texts AS (SELECT doc_id, 0 AS kind, t FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
chars AS (SELECT doc_id, kind, length(t) AS n, unnest(regexp_extract_all(t, '(?s).')) AS ch, unnest(range(0, length(t))) AS i FROM texts WHERE t <> ''
  UNION ALL SELECT doc_id, kind, 0, NULL, 0 FROM texts WHERE t = ''),
codes AS (SELECT doc_id, kind, n, i, CASE WHEN ch IS NULL THEN 1 ELSE unicode(ch) + 1 END::HUGEINT AS c FROM chars),
runs AS (SELECT doc_id, kind, n, i, greatest(n - {fingerprints.CHARS - 1}, 1) AS g,
  ((c {" ".join(f"+ coalesce(lead(c, {j}) OVER w, 0) * {pow(fingerprints.BASE, j, fingerprints.MODULUS)}" for j in range(1, fingerprints.CHARS))}) % {fingerprints.MODULUS})::BIGINT AS h
  FROM codes WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
grams AS (SELECT doc_id, kind, i, g, h * 134217728 + 134217727 - i AS p FROM runs WHERE i < g),
least_ AS (SELECT doc_id, kind, i, g, p, min(p) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN CURRENT ROW AND {fingerprints.SPAN - 1} FOLLOWING) AS m FROM grams),
chosen AS (SELECT DISTINCT doc_id, kind, CASE WHEN g < {fingerprints.SPAN} THEN p ELSE m END AS p FROM least_ WHERE g < {fingerprints.SPAN} OR i <= g - {fingerprints.SPAN}),
prints AS (SELECT doc_id, kind, string_agg(printf('%X@%d', p // 134217728, 134217727 - p % 134217728), ' ' ORDER BY 134217727 - p % 134217728) AS f, list_distinct(list(p // 134217728)) AS hs FROM chosen GROUP BY 1, 2)
SELECT e.doc_id, length(e.t)::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint,
  2 * len(list_intersect(a.hs, b.hs)) / (len(a.hs) + len(b.hs))::DOUBLE AS near_edited, 2 * len(list_intersect(a.hs, c.hs)) / (len(a.hs) + len(c.hs))::DOUBLE AS near_next
FROM e JOIN prints a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN prints b ON b.doc_id = e.doc_id AND b.kind = 1 JOIN prints c ON c.doc_id = e.next_id AND c.kind = 0
"""


def _lloyd_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds over (vector, dimension, component) rows, one pair of steps for each round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT row, cluster, sum((p.v - c.v) * (p.v - c.v)) AS d FROM parts p JOIN c{r} c USING (dim) GROUP BY 1, 2),
a{r} AS (SELECT row, arg_min(cluster, d * 64 + cluster) AS cluster, min(d)::BIGINT AS distance FROM d{r} GROUP BY 1)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS (
  SELECT c.cluster, c.dim, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT cluster, dim, ((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v FROM a{r} JOIN parts USING (row) GROUP BY 1, 2) m
  USING (cluster, dim))""")
    return f"""
WITH kept AS (
  SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id, embedding) AS row FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
parts AS (SELECT row, unnest(range(64)) AS dim, unnest(list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS v FROM kept),
chosen AS (SELECT row, row_number() OVER (ORDER BY h) - 1 AS cluster FROM (SELECT row, sha256('2:' || vec_id) AS h FROM kept ORDER BY h LIMIT {k})),
c0 AS (SELECT cluster, dim, v FROM chosen JOIN parts USING (row)),
{", ".join(steps)},
sums AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY 1),
digests AS (SELECT cluster, sha256(string_agg(v::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
SELECT vec_id, cluster::INTEGER AS cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM a{rounds}) AS inertia, centroid_sha256
FROM kept JOIN a{rounds} USING (row) JOIN sums USING (cluster) JOIN digests USING (cluster)
"""


ORACLES["op11_clusters"] = _lloyd_sql()


def _crc_table() -> list[int]:
    """CRC-32 of each single byte, by the rule of its polynomial."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


ORACLES["op9_sharding"] = f"""
WITH RECURSIVE crc AS (SELECT {_crc_table()}::BIGINT[] AS steps),
keyed AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, sha256(coalesce(text, '')) AS k,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS crc
  FROM documents, crc),
groups AS (SELECT k, sum(size) AS bytes FROM keyed GROUP BY 1),
bound AS (SELECT greatest(1, (sum(size) / 24.0 / 512)::DOUBLE) AS b FROM keyed),
named AS (SELECT k, bytes, CASE WHEN bytes >= floor(b) THEN k ELSE 'b' || (('0x' || k[1:12])::BIGINT % 24576) END AS item FROM groups, bound),
items AS (SELECT item, bytes, row_number() OVER (ORDER BY bytes DESC, item) AS i FROM (SELECT item, sum(bytes)::BIGINT AS bytes FROM named GROUP BY 1)),
lpt(i, loads, shard) AS (
  SELECT 0::BIGINT, list_transform(range(24), lambda x: 0::BIGINT), 0
  UNION ALL
  SELECT items.i, list_transform(range(24), lambda x: loads[x + 1] + CASE WHEN x + 1 = list_position(loads, list_min(loads)) THEN bytes ELSE 0 END), list_position(loads, list_min(loads)) - 1
  FROM lpt JOIN items ON items.i = lpt.i + 1),
placed AS (SELECT item, shard FROM items JOIN lpt USING (i))
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY item, doc_id, k) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM keyed JOIN named USING (k) JOIN placed USING (item)
"""
