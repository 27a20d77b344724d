"""The queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import exact_search, fingerprints, language, mixing, near_dedup, ordinal, packing, secret_scan, substring_dedup, toxicity
from pagelake.llm.common import bucket, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    base = len(secret_scan.BASE_RULES)
    count = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long")
    digest = F.sha2(secret_scan.span_names(F.filter("spans", lambda s: s["rank"] < base)), 256)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), digest.alias("base_sha256"), secret_scan.span_names(F.col("spans")).alias("spans"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    graded = ordinal.grade(docs, ordinal.fit(docs, table(spark, sf_dir, "labels")))
    return graded.withColumn("held_out", F.coalesce(bucket(F.col("doc_id"), 5) == 0, F.lit(False)))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_edit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_minhash_near_dedup, op3_language_id, op4_source_mixing, op5_quality, op6_best_fit_packing, op7_repeated_passages, op8_toxicity, op9_exact_search, op10_fingerprints)}


def _secrets_sql() -> str:
    parts = []
    for i, r in enumerate(secret_scan.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, t, {i} AS rank, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}', 0) AS m, "
            f"regexp_extract_all(t, '{p}', {r.group}) AS g, string_split_regex(t, '{p}') AS s FROM d"
        )
    base = len(secret_scan.BASE_RULES)
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{k.kind}') AS BIGINT) AS n_{k.kind}" for k in secret_scan.BASE_RULES)
    name = "kind || ':' || start || ':' || stop"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
all_rules AS ({" UNION ALL ".join(parts)}),
one AS (SELECT doc_id, rank, kind, least, m, g, s, unnest(range(1, len(m) + 1)) AS i FROM all_rules WHERE len(m) > 0),
places AS (SELECT doc_id, rank, kind, least, length(g[i]) AS long,
  CAST(coalesce(list_sum([length(x) FOR x IN s[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS BIGINT) AS start, length(m[i]) AS size FROM one),
good AS (SELECT doc_id, rank, kind, start, start + size AS stop FROM places WHERE long >= least),
agg AS (SELECT doc_id, {counts},
  string_agg({name}, ',' ORDER BY start, rank) FILTER (WHERE rank < {base}) AS base, string_agg({name}, ',' ORDER BY start, rank) AS spans FROM good GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k.kind}, 0) AS n_{k.kind}" for k in secret_scan.BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (doc_id)"""


_NEAR_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT doc_id, list_distinct([array_to_string(a[i:i + least(len(a), 5) - 1], ' ') FOR i IN range(1, len(a) - least(len(a), 5) + 2)]) AS b FROM w WHERE len(a) > 0),
n AS (SELECT doc_id, len(b) AS n FROM s),
e AS (SELECT doc_id, md5_number(unnest(b)) AS h FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 75 * (u.n + v.n - c)),
k AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

_SEARCH_SQL = """WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS a FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len(embedding) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([q.a[i] * c.a[i] FOR i IN range(1, len(q.a) + 1)]) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": _secrets_sql(), "op2_minhash_near_dedup": _NEAR_SQL, "op9_exact_search": _SEARCH_SQL}
