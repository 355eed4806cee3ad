"""Queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.llm import decontaminate, langid, licenses, media, merkle, ngram_join, packing, rules, sharding, token_files, tokens, toxicity, vector_codes, whitening
from siltstone.llm.common import materialize, scratch_path, table


def replica_of(pages):
    """A damaged replica of pages, by rule: of page_id modulo 97, 5 has a byte more, 11 is lost, 17 is stored twice."""
    m = F.pmod(F.col("page_id"), F.lit(97))
    bad = pages.withColumn("html", F.when(m == 5, F.concat(F.coalesce("html", F.lit("")), F.lit("#"))).otherwise(F.col("html")))
    return bad.where(F.coalesce(m != 11, F.lit(True))).withColumn("copies", F.when(m == 17, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).withColumn("copies", F.explode("copies")).drop("copies")


def op1_merkle_audit(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = merkle.audit(pages, replica_of(pages), "page_id", ["url", "html"])
    return found.select(F.col("key").alias("page_id"), "slot", "status", "n_primary", "n_replica")


def op2_lpt_shards(spark, sf_dir):
    return sharding.lpt_shards(table(spark, sf_dir, "documents"), 8)


def op3_decontaminate(spark, sf_dir):
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h").distinct()


def op4_token_files(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokens.default_path(), end_id=2)
    return token_files.token_digests(spark, path)


def op5_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return rules.apply_rules(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def op7_ngram_jaccard(spark, sf_dir):
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id")


def op8_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokens.default_path(), 4096, 1)


def op11_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark, sf_dir):
    return vector_codes.digests(*vector_codes.encode(table(spark, sf_dir, "embeddings")))


def op13_media_columns(spark, sf_dir):
    return media.digests(materialize(media.with_media(table(spark, sf_dir, "documents")), "media"))


QUERIES = {
    f.__name__: f
    for f in (op1_merkle_audit, op2_lpt_shards, op3_decontaminate, op4_token_files, op5_license_scan, op6_quality_rules, op7_ngram_jaccard, op8_language_id, op9_toxicity, op10_best_fit_packing, op11_embedding_whitening, op12_vector_codes, op13_media_columns)
}


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Plain Lloyd rounds: all distances each time."""
    nearest = "SELECT r, p, arg_min(e, (far, e)) AS e, min(far) AS far FROM (SELECT v.r, v.p, b.e, sum((v.c - b.c) * (v.c - b.c)) AS far FROM v JOIN {b} b ON b.p = v.p AND b.d = v.d GROUP BY v.r, v.p, b.e) GROUP BY r, p"
    out = [f"""k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    v AS MATERIALIZED (SELECT r, i // (n // {parts}) AS p, i % (n // {parts}) AS d, x[i + 1] AS c FROM (SELECT r, x, len(x) AS n, unnest(range(0, len(x))) AS i FROM k)),
    b0 AS MATERIALIZED (SELECT p, r - 1 AS e, d, c FROM v WHERE r <= {entries})"""]
    for i in range(rounds):
        out.append(f"""a{i} AS MATERIALIZED ({nearest.format(b=f"b{i}")}),
    m{i} AS (SELECT v.p, a.e, v.d, CAST((sum(v.c) - ((sum(v.c) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS c FROM v JOIN a{i} a USING (r, p) GROUP BY v.p, a.e, v.d),
    b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, b.d, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m USING (p, e, d))""")
    return f"""WITH {", ".join(out)}, z AS ({nearest.format(b=f"b{rounds}")}),
    f AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM z JOIN k USING (r) GROUP BY r, vec_id, label)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, d)) FROM b{rounds}) AS codebooks_sha256 FROM f"""


ORACLE_SQL: dict[str, str] = {
    "op12_vector_codes": _codes_sql(),
    "op1_merkle_audit": """
    SELECT page_id, CAST(floor(page_id / 64.0) AS BIGINT) AS slot,
      CASE page_id % 97 WHEN 5 THEN 'corrupt' WHEN 11 THEN 'missing' ELSE 'extra' END AS status,
      CAST(count(*) AS BIGINT) AS n_primary,
      CAST(CASE page_id % 97 WHEN 5 THEN count(*) WHEN 11 THEN 0 ELSE 2 * count(*) END AS BIGINT) AS n_replica
    FROM pages WHERE page_id % 97 IN (5, 11, 17) GROUP BY page_id""",
}
