"""The queries op1 to op13 and the pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown_lm, chat, fingerprint, jaccard, langid, merkle, packing, quality, secrets, vafile, warc, whitening
from .base import new_path, split_of, table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = split_of(F.col("doc_id"), 10) == 0
    rows, model = brown_lm.scored(docs, ~held)
    return rows.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op2_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), capacity=2048, end_id=1)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema))
    return chat.read_back(chat.pieces(chat.as_events(rows)), in_order=True)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.clusters(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    rows = warc.read(spark, path).where(F.col("gap").isNull())
    urn = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(urn(c) != "", urn(c)).cast("long")
    return rows.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = split_of(F.col("doc_id"), 4) == 2
    sample = langid.fit(docs, ~held)
    return langid.identify(docs.select("doc_id", "text"), sample).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = quality.judged(docs.select("doc_id", "text"), quality.fit(docs))
    return rows.drop("text")


def op8_va_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vafile.as_integers(table(spark, sf_dir, "embeddings"))
    return vafile.top_k(rows, F.col("vec_id") % 50 == 0, k=5)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scanned as they come in: a ledger of the first half under the base rules, then of all documents
    under all rules, for which only the pairs of blob and version that it lacks are scanned."""
    docs = table(spark, sf_dir, "documents")
    early = secrets.update(docs.where(split_of(F.col("doc_id"), 2) == 0), versions=("base-1",))
    rows = secrets.found(docs, early)
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    told = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.BASE]
    return rows.select("doc_id", *counts, F.sha2(told(of(*secrets.BASE)), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves are the rows' fields; where 3 divides the crc32 of the id's decimal text, the tampered row has its text's A-Z
    lower-cased. Rows without id are not tampered with and come first in their language."""
    docs = table(spark, sf_dir, "documents")
    fields = lambda text: [merkle.field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")] + [merkle.field(text)]
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.digest(*fields(low)))
    rows = docs.select("doc_id", "lang", merkle.digest(*fields(F.col("text"))).alias("leaf"), changed.alias("tampered"))
    made = merkle.manifest(rows, F.col("lang"), [F.col("doc_id")], F.col("leaf"))
    folded = merkle.folded(F.coalesce("row.tampered", "leaf"), F.col("proof"))
    out = made.select("row.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(whitening.as_integers(table(spark, sf_dir, "embeddings")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_brown_lm, op2_bin_slack_packing, op3_chat_format, op4_ngram_jaccard, op5_warc_salvage,
        op6_language_id, op7_quality_rules, op8_va_topk, op9_bpe, op10_secret_ledger, op11_fingerprints, op12_merkle_manifest,
        op13_whitening, pipeline,
    )
}

ORACLE = {
    "op4_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh
  FROM w
), n AS (SELECT doc_id, len(sh) AS n FROM s), e AS (SELECT doc_id, unnest(sh) AS t FROM s),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(reach.y) AS component_id FROM n JOIN reach ON reach.x = n.doc_id GROUP BY ALL
""",
    "op12_merkle_manifest": """
WITH RECURSIVE f AS (
  SELECT doc_id, lang, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents
), leaf AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS changed
  FROM f
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS size FROM leaf
), node AS (
  SELECT lang, 0 AS level, idx, size, leaf AS digest FROM placed
  UNION ALL
  SELECT lang, level + 1, idx // 8, (size + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM node WHERE size > 1 GROUP BY lang, level, size, idx // 8
), sub AS (
  SELECT lang, level, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS size FROM node WHERE size = 1
), top AS (
  SELECT 0 AS level, idx, size, subroot AS digest FROM sub
  UNION ALL
  SELECT level + 1, idx // 8, (size + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE size > 1 GROUP BY level, size, idx // 8
), run AS (SELECT lang, level, idx // 8 AS idx, array_agg(digest ORDER BY idx) AS ds FROM node WHERE size > 1 GROUP BY lang, level, idx // 8
), top_run AS (SELECT level, idx // 8 AS idx, array_agg(digest ORDER BY idx) AS ds FROM top WHERE size > 1 GROUP BY level, idx // 8
), own AS (
  SELECT row_number() OVER () AS r, doc_id, lang, idx, leaf, CASE WHEN xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))
    ), 4294967295) % 3 = 0 THEN changed ELSE leaf END AS told
  FROM placed
), climb AS (
  SELECT r, lang, 0 AS level, idx, told, '' AS proof FROM own
  UNION ALL
  SELECT c.r, c.lang, c.level + 1, c.idx // 8, sha256(array_to_string(ds[1:c.idx % 8], '') || c.told || array_to_string(ds[c.idx % 8 + 2:], '')),
    c.proof || array_to_string(ds[1:c.idx % 8], '') || array_to_string(ds[c.idx % 8 + 2:], '')
  FROM climb c JOIN run ON run.lang IS NOT DISTINCT FROM c.lang AND run.level = c.level AND run.idx = c.idx // 8
), climb_top AS (
  SELECT r, 0 AS level, sub.idx, told, proof, subroot FROM climb JOIN sub ON sub.lang IS NOT DISTINCT FROM climb.lang AND sub.level = climb.level
  UNION ALL
  SELECT c.r, c.level + 1, c.idx // 8, sha256(array_to_string(ds[1:c.idx % 8], '') || c.told || array_to_string(ds[c.idx % 8 + 2:], '')),
    c.proof || array_to_string(ds[1:c.idx % 8], '') || array_to_string(ds[c.idx % 8 + 2:], ''), subroot
  FROM climb_top c JOIN top_run run ON run.level = c.level AND run.idx = c.idx // 8
)
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, c.told AS folded_root, c.told = digest AS verified
FROM climb_top c JOIN top ON top.size = 1 AND top.level = c.level JOIN own USING (r)
""",
    "op8_va_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
