"""The registered queries of this subpackage and the SQL they are checked against, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspan.llm import (fingerprints, fit_packing, langid, language_model, licenses, merkle, mixing, partenum, prefix_trie, quality,
                         secrets, tier_packing, topk)
from hotspan.storage import write_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: str, of: int, number: int) -> Column:
    """True for rows whose crc32(doc_id as text) leaves ``number`` modulo ``of``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of == number


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from two thirds of the labelled ones."""
    held_out = fold("doc_id", 3, 1)
    scored = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their four-word shingles."""
    found = partenum.components(table(spark, sf_dir, "documents").select("doc_id", "text"), partenum.Join(words=4, percent=85))
    return found.select("doc_id", "n_shingles", "component_id")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
keyed AS (
  SELECT *, md5('mix-0:' || coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR) AS k FROM sized),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM keyed GROUP BY source),
run AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
         coalesce(sum(2.0::DOUBLE * source_size) OVER e, 0) AS c_before, coalesce(sum(w) OVER e, 0) AS w_before
  FROM src WINDOW e AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (
  SELECT arg_min((1.5::DOUBLE * total - c_before) / (all_w - w_before), cap / w) FILTER (
           cap / w >= (1.5::DOUBLE * total - c_before) / (all_w - w_before)) AS level FROM run),
tgt AS (
  SELECT source, source_size, CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE least(w * level, cap) END AS target FROM run, lvl),
bud AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM tgt),
ord AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM keyed)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(budget - epochs * source_size - before, size)))::BIGINT AS taken
FROM ord JOIN bud ON ord.source IS NOT DISTINCT FROM bud.source
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 4, 2)
    network = langid.fit(docs, ~held_out)
    return langid.identify(docs, network).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in rows of 1024 token ids."""
    return fit_packing.pack_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of up to 1024 token ids."""
    return tier_packing.pack_tiers(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.secret_spans(docs, secrets.fit(docs))
    def count(order: int):
        return F.size(F.filter("_base", lambda s: s["ord"] == order)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.joined(F.col("_base")), 256).alias("base_sha256"), secrets.joined(F.col("_spans")).alias("spans"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors for each twentieth vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))


OP8_SQL = """
WITH good AS (
  SELECT DISTINCT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and passages in every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash tree over the documents of each source, and every document (some edited) checked against its root."""
    docs = table(spark, sf_dir, "documents")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    edit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    edited = F.when(edit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", merkle.leaf_hash([*head, F.col("text")]).alias("leaf"),
                         merkle.leaf_hash([*head, edited]).alias("tampered"))
    rows = merkle.manifest(leaves, "source", "doc_id", "leaf", ["doc_id", "tampered"]).rows
    checked = rows.select("doc_id", F.col("node").alias("leaf"), "subroot", "root",
                          F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof_sha256"),
                          merkle.folded(F.col("tampered"), F.col("path")).alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text, replace(text, chr(10), '') AS cut,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
         list_reduce([4294967295] || [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')],
           lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 2 = 1 THEN sha256(head || coalesce(strlen(cut) || ':' || cut, '-'))
              ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS tampered FROM fields),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM leaves),
tree AS (
  SELECT g, 0 AS lvl, p, leaf AS node, count(*) OVER (PARTITION BY g) AS n FROM placed
  UNION ALL
  SELECT g, lvl + 1, p // 3, sha256(string_agg(node, '' ORDER BY p)), (any_value(n) + 2) // 3 FROM tree WHERE n > 1 GROUP BY g, lvl, p // 3),
subroots AS (SELECT g, node FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, g AS p, node, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT lvl + 1, p // 3, sha256(string_agg(node, '' ORDER BY p)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, p // 3),
runs AS (
  SELECT g, lvl, p // 3 AS up, list(node ORDER BY p) AS run FROM tree WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT -1, lvl, p // 3, list(node ORDER BY p) FROM top WHERE n > 1 GROUP BY ALL),
fold AS (
  SELECT doc_id, leaf, g, p AS first, 0 AS lvl, p, tampered AS own, '' AS siblings FROM placed
  UNION ALL
  SELECT doc_id, leaf, f.g, first, f.lvl + 1, p // 3,
         sha256(array_to_string(run[:p % 3], '') || own || array_to_string(run[p % 3 + 2:], '')),
         siblings || array_to_string(run[:p % 3], '') || array_to_string(run[p % 3 + 2:], '')
  FROM fold f JOIN runs r ON r.g = f.g AND r.lvl = f.lvl AND r.up = f.p // 3),
ended AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY g, first ORDER BY lvl DESC) = 1),
fold2 AS (
  SELECT doc_id, leaf, g, first, 0 AS lvl, g AS p, own, siblings FROM ended
  UNION ALL
  SELECT doc_id, leaf, f.g, first, f.lvl + 1, p // 3,
         sha256(array_to_string(run[:p % 3], '') || own || array_to_string(run[p % 3 + 2:], '')),
         siblings || array_to_string(run[:p % 3], '') || array_to_string(run[p % 3 + 2:], '')
  FROM fold2 f JOIN runs r ON r.g = -1 AND r.lvl = f.lvl AND r.up = f.p // 3),
done AS (SELECT * FROM fold2 QUALIFY row_number() OVER (PARTITION BY g, first ORDER BY lvl DESC) = 1)
SELECT doc_id, leaf, s.node AS subroot, t.node AS root, sha256(siblings) AS proof_sha256, own AS folded_root, own = t.node AS verified
FROM done JOIN subroots s USING (g), (SELECT node FROM top WHERE n = 1) t
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of conversations that start with turns of the conversation at the last multiple of 20."""
    turns = write_once(prefix_trie.numbered_turns(table(spark, sf_dir, "conversations")))
    own = F.col("conv_id")
    borrowed = (F.crc32(own.cast("string").cast("binary")) % 4).cast("int")
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns, own - own % 20, borrowed, 3))


OP12_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, xor(4294967295, list_reduce([4294967295] || [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')],
           lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda s, i: xor(s >> 1, 3988292384 * (s & 1))))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
built AS (
  SELECT c.conv_id, 0 AS part, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.place < c.h
  UNION ALL
  SELECT c.conv_id, 1, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place >= c.h),
paths AS (
  SELECT conv_id, depth, words, string_agg(own, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth,
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, sha256(strlen(role) || ':' || role || text) AS own FROM built)
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM paths GROUP BY key, depth),
lengths AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
ends AS (
  SELECT p.key, sha256(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)) AS ends_sha256 FROM paths p JOIN lengths USING (conv_id, depth) GROUP BY p.key),
kids AS (SELECT left(key, length(key) - 64) AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
links AS (SELECT DISTINCT a.key AS up, b.key AS down FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (
  SELECT l.up AS key, count(*) FILTER (k.key IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved
  FROM links l JOIN nodes n ON n.key = l.down LEFT JOIN kids k ON k.key = l.down GROUP BY l.up)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       coalesce(k.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens,
       coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s USING (key) LEFT JOIN kids k USING (key) LEFT JOIN ends e USING (key)
LEFT JOIN nodes p ON n.depth > 0 AND p.key = left(n.key, length(n.key) - 64)
"""


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, learnt from nine tenths of them."""
    held_out = fold("doc_id", 10, 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text")
    return language_model.score_texts(docs, ~F.col("held_out"), ["doc_id", "held_out"])


#: name -> (query, SQL or None)
QUERIES = {
    "op1_quality": (op1_quality, None),
    "op2_jaccard_join": (op2_jaccard_join, None),
    "op3_mix_sources": (op3_mix_sources, OP3_SQL),
    "op4_language_id": (op4_language_id, None),
    "op5_fit_packing": (op5_fit_packing, None),
    "op6_tier_packing": (op6_tier_packing, None),
    "op7_secret_scan": (op7_secret_scan, None),
    "op8_exact_top_k": (op8_exact_top_k, OP8_SQL),
    "op9_fingerprints": (op9_fingerprints, None),
    "op10_license_scan": (op10_license_scan, None),
    "op11_merkle_manifest": (op11_merkle_manifest, OP11_SQL),
    "op12_prefix_trie": (op12_prefix_trie, OP12_SQL),
    "op13_lm_scores": (op13_lm_scores, None),
}
