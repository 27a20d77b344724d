"""Queries of review, queue and retention operators, over rows that both engines derive from the test tables by the same text."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.operators import matching, queues, review
from pagelake.plans.relational import rows_of
from pagelake.sources import readers, sinks

QUERIES, ORACLES = {}, {}


def query(fixtures: dict[str, str], oracle: str | None = None, own: dict[str, str] | None = None):
    """own: Spark's text of a fixture where the dialects differ."""

    def add(f):
        def run(spark, sf_dir):
            return f(**{n: rows_of(sql)(spark, sf_dir) for n, sql in (fixtures | (own or {})).items()})

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = "WITH RECURSIVE " + ", ".join(f"{n} AS ({sql})" for n, sql in fixtures.items()) + " " + oracle
        return f

    return add


_REGIONS = "SELECT p_brand AS document_id, p_size AS page_number, p_partkey AS region_id, CASE p_partkey % 4 WHEN 0 THEN 'table' ELSE 'text' END AS kind, p_name AS text FROM part"
_PATCHES = "SELECT p_brand AS document_id, CASE WHEN p_partkey % 13 = 0 THEN -p_partkey WHEN p_partkey % 17 = 0 THEN p_partkey - 17 ELSE p_partkey END AS region_id, CASE WHEN p_partkey % 19 = 0 THEN ' ' ELSE 'new' END AS text, 'text' AS kind FROM part WHERE p_partkey % 2 = 0"
_MAY = "SELECT p_brand AS document_id, p_partkey AS region_id FROM part WHERE p_size < 40"
_REFUSED = """, o AS (SELECT p.document_id, p.region_id, p.text, CASE WHEN r.region_id IS NULL THEN 'unknown region' WHEN m.region_id IS NULL THEN 'not authorised' WHEN count(*) OVER (PARTITION BY p.document_id, p.region_id) > 1 THEN 'patched twice' WHEN trim(p.text) = '' THEN 'empty text' WHEN p.kind <> r.kind THEN 'protected field' END AS refused
FROM p LEFT JOIN r ON p.document_id = r.document_id AND p.region_id = r.region_id LEFT JOIN m ON p.document_id = m.document_id AND p.region_id = m.region_id) """


@query({"p": _PATCHES, "m": _MAY, "r": _REGIONS}, _REFUSED + "SELECT document_id, region_id, text, refused FROM o")
def patch_outcomes(p, m, r):
    return review.patch_outcomes(p, m, r)


@query({"p": _PATCHES + " AND p_partkey % 6 = 2 AND p_size < 30", "m": _MAY, "r": _REGIONS}, _REFUSED + ", b AS (SELECT DISTINCT document_id FROM o WHERE refused IS NOT NULL) SELECT r.region_id, CASE WHEN o.region_id IS NULL OR b.document_id IS NOT NULL THEN r.text ELSE o.text END AS text FROM r LEFT JOIN o ON r.document_id = o.document_id AND r.region_id = o.region_id LEFT JOIN b ON r.document_id = b.document_id")
def patched_regions(p, m, r):
    return review.patched(r, review.patch_outcomes(p, m, r)).select("region_id", "text")


_EVENTS = "SELECT l_orderkey AS document_id, l_linenumber AS base_revision, l_partkey * 1000 + l_suppkey AS position, CASE l_partkey % 3 WHEN 0 THEN 'edit' WHEN 1 THEN 'accept' ELSE 'keep_unresolved' END AS action, l_linenumber % 3 AS region_id, concat('t', CAST(l_suppkey AS STRING)) AS text FROM lineitem"
_DOCS = "SELECT o_orderkey AS document_id, o_orderkey % 3 AS region_id, o_orderpriority AS text FROM orders"


@query({"e": _EVENTS, "d": _DOCS}, """, f AS (SELECT *, row_number() OVER (PARTITION BY document_id, base_revision ORDER BY position) AS r FROM e), g AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY base_revision) AS k FROM f WHERE r = 1), v AS (SELECT * FROM g WHERE k = base_revision),
l AS (SELECT document_id, region_id, max_by(action, base_revision) AS review, max_by(text, base_revision) FILTER (WHERE action IN ('edit', 'accept')) AS text FROM v GROUP BY ALL), n AS (SELECT document_id, max(base_revision) + 1 AS revision FROM v GROUP BY 1)
SELECT d.document_id, d.region_id, coalesce(l.text, d.text) AS text, l.review, coalesce(n.revision, 1) AS revision FROM d LEFT JOIN l ON d.document_id = l.document_id AND d.region_id = l.region_id LEFT JOIN n ON d.document_id = n.document_id""")
def corrected_regions(e, d):
    return review.corrections(d, e).select("document_id", "region_id", "text", "review", "revision")


@query({"e": _EVENTS}, """, f AS (SELECT *, row_number() OVER (PARTITION BY document_id, base_revision ORDER BY position) AS r FROM e), g AS (SELECT document_id, base_revision, row_number() OVER (PARTITION BY document_id ORDER BY base_revision) AS k FROM f WHERE r = 1)
SELECT f.document_id, f.base_revision, f.position FROM f JOIN g ON f.document_id = g.document_id AND f.base_revision = g.base_revision WHERE f.r > 1 OR g.k <> f.base_revision""")
def stale_corrections(e):
    return review.stale(e).select("document_id", "base_revision", "position")


_CROP = "SELECT p_brand AS document_id, 1 AS page_number, p_partkey AS region_id, p_partkey AS reading_order, CASE p_partkey % 5 WHEN 0 THEN 'figure' WHEN 1 THEN 'form_source' WHEN 2 THEN 'table' ELSE 'text' END AS kind, CASE p_size % 3 WHEN 0 THEN 'unreadable' ELSE 'resolved' END AS resolution, p_size % 4 = 0 AS doubt, p_size / 100.0 AS share, p_name AS text, p_partkey % 2 AS bad_cells, p_partkey % 3 = 0 AS has_control FROM part"


@query({"x": _CROP}, """, w AS (SELECT *, kind = 'figure' AS vis, resolution <> 'resolved' AS unres FROM x), k AS (SELECT * FROM w WHERE (doubt OR vis OR unres OR bad_cells > 0) AND NOT (NOT vis AND NOT unres AND bad_cells = 0 AND kind <> 'table' AND share > 0.15) AND (kind <> 'form_source' OR has_control)),
n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY reading_order) AS crop_id FROM k)
SELECT region_id, crop_id, (crop_id - 1) // 12 AS request, concat_ws(',', CASE WHEN doubt THEN 'second_reader_doubt' END, CASE WHEN vis THEN 'visual_region' END, CASE WHEN unres THEN 'unresolved_recognition' END, CASE WHEN bad_cells > 0 THEN 'table_cells_unresolved' END) AS reasons FROM n""")
def crop_groups(x):
    doubt = F.when(F.col("doubt"), F.array(F.lit("second_reader_doubt")))
    return review.crop_groups(x.withColumn("reasons", doubt)).select("region_id", "crop_id", "request", "reasons")


_ASKED = "SELECT o_custkey AS document_id, 1 AS page_number, o_orderkey AS crop_id, CASE o_orderkey % 3 WHEN 0 THEN 'figure' ELSE 'text' END AS kind, o_orderkey % 2 = 0 AS doubt, o_orderpriority AS text FROM orders"
_ANSWERS = "SELECT o_custkey AS document_id, 1 AS page_number, l_orderkey AS crop_id, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'answer' END AS markdown FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 38"
_TAKEN = """, n AS (SELECT crop_id, count(*) AS n, min(markdown) AS answer FROM a GROUP BY 1), j AS (SELECT c.*, n, answer, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'answered twice' WHEN answer = '' AND NOT doubt THEN 'blank' END AS error FROM c LEFT JOIN n ON c.crop_id = n.crop_id),
o AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'none' WHEN answer = '' THEN 'reclassified' WHEN kind = 'figure' THEN 'pending' ELSE 'replaced' END AS outcome FROM j) """


def _crops(c):
    return c.withColumn("reasons", F.when(F.col("doubt"), F.array(F.lit("second_reader_doubt"))).otherwise(F.array(F.lit("visual_region"))))


@query({"c": _ASKED, "a": _ANSWERS}, _TAKEN + "SELECT crop_id, outcome, error, CASE WHEN outcome = 'reclassified' THEN 'figure' ELSE kind END AS kind, CASE outcome WHEN 'reclassified' THEN '' WHEN 'replaced' THEN answer ELSE text END AS text, CASE WHEN outcome IN ('replaced', 'reclassified') THEN text END AS superseded FROM o")
def crop_outcomes(c, a):
    return review.crop_outcomes(_crops(c), a).select("crop_id", "outcome", "error", "kind", "text", "superseded")


@query({"c": _ASKED, "a": _ANSWERS}, _TAKEN + "SELECT document_id, CASE WHEN count(error) = 0 THEN 'generated' WHEN count(*) FILTER (WHERE outcome <> 'none') > 0 THEN 'partial' ELSE 'invalid' END AS status, count(error) AS errors FROM o GROUP BY document_id")
def refinement_status(c, a):
    return review.refinement_status(review.crop_outcomes(_crops(c), a)).select("document_id", "status", "errors")


@query({"v": "SELECT o_orderkey AS case_id, o_orderstatus AS key, o_orderpriority AS value FROM orders", "p": "SELECT o_orderkey AS case_id, o_orderstatus AS key, 'before' AS value, CASE o_custkey % 3 WHEN 0 THEN 'edited' WHEN 1 THEN 'rejected' ELSE 'pending' END AS state FROM orders WHERE o_orderkey % 2 = 0"},
       "SELECT v.case_id, v.key, CASE WHEN p.state IN ('edited', 'rejected') THEN p.value ELSE v.value END AS value, CASE WHEN p.state IN ('edited', 'rejected') THEN p.state ELSE 'pending' END AS state FROM v LEFT JOIN p ON v.case_id = p.case_id AND v.key = p.key")
def carried_over(v, p):
    return review.carried_over(v, p).select("case_id", "key", "value", "state")


@query({"v": "SELECT o_custkey AS case_id, CASE WHEN o_totalprice > 100000 THEN 'priority_review' ELSE 'quick_verify' END AS route, CASE WHEN o_orderkey % 3 = 0 THEN 'approved' ELSE 'pending' END AS state, o_orderkey % 11 > 0 AS valid FROM orders", "e": "SELECT user_id AS case_id, CASE event_type WHEN 'error' THEN 'error' ELSE 'warning' END AS severity, event_id % 2 = 0 AS resolved FROM events"},
       """, x AS (SELECT case_id, count(*) FILTER (WHERE route = 'priority_review' AND state = 'pending') AS blocking, count(*) FILTER (WHERE NOT valid) AS invalid FROM v GROUP BY 1), y AS (SELECT case_id, count(*) FILTER (WHERE severity = 'error' AND NOT resolved) AS errors FROM e GROUP BY 1)
SELECT case_id, coalesce(blocking, 0) AS blocking, coalesce(invalid, 0) AS invalid, coalesce(errors, 0) AS errors, coalesce(blocking, 0) + coalesce(invalid, 0) + coalesce(errors, 0) = 0 AS ready FROM x FULL JOIN y USING (case_id)""")
def submission_gate(v, e):
    return review.blocking(v, e)


@query({"c": "SELECT c_custkey AS case_id, CASE c_custkey % 3 WHEN 0 THEN 'group' ELSE 'practitioner' END AS kind, CASE WHEN c_custkey % 5 > 0 THEN c_custkey END AS npi, CASE WHEN c_custkey % 7 > 0 THEN c_nationkey END AS tin FROM customer", "g": "SELECT s_suppkey AS npi, s_nationkey AS tin FROM supplier WHERE s_acctbal > 8000"},
       "SELECT case_id FROM c WHERE kind = 'practitioner' AND (npi IS NOT NULL OR tin IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM g WHERE g.npi = c.npi OR g.tin = c.tin)")
def unenrolled_cases(c, g):
    return review.unenrolled(c, g).select("case_id")


@query({"c": "SELECT o_custkey AS case_id, o_orderstatus AS kind FROM orders"})
def audit_sample(c):
    v = c.withColumn("value_id", F.xxhash64("kind")).distinct()
    return review.audit_sample(v.select("case_id", "value_id", F.lit("quick_verify").alias("route"), F.lit("pending").alias("state"), F.lit("reading").alias("source"))).groupBy("case_id").agg(F.count_if("audit_sample").alias("drawn"))


# queue, ledger, cache, sessions, retention
_TICKETS = "SELECT user_id AS queue, event_id AS ticket, event_id * 10 AS enqueued_at, event_id * 10 + 50 + event_id % 90 AS finished_at FROM events"


@query({"x": _TICKETS}, ", l AS (SELECT queue, ticket, enqueued_at AS moment, 1 AS step FROM x UNION ALL SELECT queue, NULL, finished_at, -1 FROM x), r AS (SELECT *, sum(step) OVER (PARTITION BY queue ORDER BY moment, step, ticket NULLS FIRST ROWS UNBOUNDED PRECEDING) AS inside FROM l) SELECT queue, ticket, CAST(greatest(inside - 1, 0) AS BIGINT) AS ahead FROM r WHERE ticket IS NOT NULL")
def queue_depth(x):
    return queues.queue_depth(x)


# the oracles step through the k-th rows of all logs at once, a list of ends or entries beside each
@query({"x": "SELECT user_id AS gate, event_id AS id, event_id * 1.0 AS moment, 700.0 AS seconds FROM events"}, """, n AS (SELECT gate, id, CAST(moment AS DOUBLE) AS m, CAST(seconds AS DOUBLE) AS s, row_number() OVER (PARTITION BY gate ORDER BY moment, id) AS k FROM x),
s AS (SELECT gate, id, k, true AS admitted, [m + s] AS ends FROM n WHERE k = 1 UNION ALL
SELECT n.gate, n.id, n.k, len(list_filter(r.ends, lambda e: e > m)) < 3, CASE WHEN len(list_filter(r.ends, lambda e: e > m)) < 3 THEN list_append(list_filter(r.ends, lambda e: e > m), m + s) ELSE list_filter(r.ends, lambda e: e > m) END FROM n JOIN s AS r ON n.gate = r.gate AND n.k = r.k + 1)
SELECT gate, id, admitted FROM s""")
def admissions(x):
    return queues.admissions(x.select("gate", "id", F.col("moment").cast("double").alias("at"), F.col("seconds").cast("double").alias("seconds")), 3)


@query({"x": "SELECT o_custkey AS ledger, o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice / 10000 END AS actual FROM orders"}, "SELECT ledger, id, round(coalesce(sum(coalesce(actual, 0.25)) OVER w, 0), 6) AS spent_before, coalesce(sum(coalesce(actual, 0.25)) OVER w, 0) + 0.25 <= 80 AS fits FROM x WINDOW w AS (PARTITION BY ledger ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def spend_ledger(x):
    return queues.ledger(x, 0.25, 80.0)


@query({"x": "SELECT user_id AS cache, event_id AS id, event_id AS moment, event_type AS kind, length(props) AS bytes FROM events"}, """, n AS (SELECT *, row_number() OVER (PARTITION BY cache ORDER BY moment, id) AS k FROM x),
s AS (SELECT cache, 0 AS k, CAST(NULL AS BIGINT) AS id, false AS hit, 0 AS evicted, CAST([] AS STRUCT(kind VARCHAR, since BIGINT, bytes BIGINT)[]) AS held FROM n WHERE k = 1 UNION ALL
SELECT cache, k, id, hit, len(now) - len(left_), left_ FROM (SELECT *, list_filter(now, lambda e, i: list_sum(list_transform(now[i:], lambda f: f.bytes)) <= 20) AS left_ FROM (
SELECT *, CASE WHEN hit THEN list_concat(others, list_filter(held, lambda e: e.kind = kind)) WHEN bytes <= 20 THEN list_append(others, {'kind': kind, 'since': CAST(moment AS BIGINT), 'bytes': CAST(bytes AS BIGINT)}) ELSE others END AS now FROM (
SELECT n.*, r.held, list_filter(r.held, lambda e: e.kind <> n.kind) AS others, len(list_filter(r.held, lambda e: e.kind = n.kind AND n.moment - e.since <= 2000)) > 0 AS hit FROM n JOIN s AS r ON n.cache = r.cache AND n.k = r.k + 1) a) b) c)
SELECT cache, id, hit, CAST(evicted AS INT) AS evicted FROM s WHERE k > 0""")
def cache_replay(x):
    return queues.cache_replay(x.withColumnsRenamed({"moment": "at", "kind": "key", "bytes": "size"}), 20, 2000.0)


@query({"x": "SELECT o_custkey AS cache, o_orderkey AS key, o_orderdate AS last_used, CAST(o_totalprice AS BIGINT) AS size FROM orders"}, ", h AS (SELECT *, sum(size) OVER (PARTITION BY cache ORDER BY last_used DESC, key ROWS UNBOUNDED PRECEDING) AS held FROM x) SELECT cache, key FROM h WHERE held > 500000",
       own={"x": "SELECT o_custkey AS cache, o_orderkey AS key, o_orderdate AS last_used, CAST(rint(o_totalprice) AS BIGINT) AS size FROM orders"})  # DuckDB's cast rounds, Spark's truncates
def evicted_entries(x):
    return queues.evicted_by_size(x, 500000).select("cache", "key")


@query({"x": "SELECT user_id AS store, event_id AS session_id, ts AS accessed, event_type = 'error' AS pending FROM events"}, "SELECT store, session_id FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY accessed DESC, session_id) AS k FROM x) q WHERE pending OR k <= 4")
def kept_sessions(x):
    return queues.kept_sessions(x, 4).select("store", "session_id")


@query({"x": "SELECT l_orderkey AS session_id, l_linenumber AS record_id, CASE WHEN l_linenumber > 2 AND l_partkey % 2 = 0 THEN 1 END AS amends, l_partkey * 1000 + l_suppkey AS position, l_returnflag AS verdict, l_linestatus AS reason FROM lineitem"},
       ", y AS (SELECT *, coalesce(amends, record_id) AS target FROM x), k AS (SELECT DISTINCT session_id, record_id FROM x WHERE amends IS NULL) SELECT y.session_id, y.target AS record_id, max_by(verdict, position) AS verdict, count(*) AS versions FROM y JOIN k ON y.session_id = k.session_id AND y.target = k.record_id GROUP BY ALL")
def amended_feedback(x):
    return queues.amended_feedback(x).select("session_id", "record_id", "verdict", "versions")


@query({"e": "SELECT DISTINCT l_orderkey AS document_id, l_linenumber AS page_number FROM lineitem", "r": "SELECT l_orderkey AS document_id, l_linenumber AS page_number FROM lineitem WHERE l_quantity > 10"}, ", n AS (SELECT document_id, page_number, count(*) AS n FROM r GROUP BY ALL) SELECT e.document_id, e.page_number, CASE WHEN n IS NULL THEN 'no_result' ELSE 'several_results' END AS failure FROM e LEFT JOIN n ON e.document_id = n.document_id AND e.page_number = n.page_number WHERE n IS NULL OR n <> 1")
def batch_failures(e, r):
    return queues.batch_failures(e, r)


@query({"x": "SELECT user_id, event_id FROM events"}, "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM x) q WHERE k <= 3")
def retained_records(x):
    return sinks.retained(x, "user_id", "event_id", 3)


@query({"x": "SELECT event_id AS id, user_id FROM events"}, "SELECT id, user_id FROM x ORDER BY id DESC LIMIT 50")
def newest_usage(x):
    return readers.usage_entries(x, 50)


@query({"c": "SELECT o_custkey AS document_id, 1 AS page_number, o_orderkey AS crop_id, o_orderstatus AS reason, o_orderkey % 5 AS a, o_orderkey % 3 AS z FROM orders"}, ", s AS (SELECT document_id, crop_id, reason, unnest([a, z]) AS region_id FROM c) SELECT document_id, region_id, max_by(reason, crop_id) AS reason FROM s GROUP BY ALL")
def routing_of_regions(c):
    crops = c.select("document_id", "page_number", "crop_id", F.array("reason").alias("reasons"), F.array("a", "z").alias("source_ids"))
    regions = crops.select("document_id", "page_number", F.explode("source_ids").alias("region_id")).distinct()
    return matching.routing_of_regions(crops, regions).select("document_id", "region_id", F.get("reasons", 0).alias("reason"))


@query({"e": "SELECT o_custkey AS case_id, o_orderpriority AS value FROM orders", "f": "SELECT o_custkey AS case_id, upper(replace(o_orderpriority, '-', ' ')) AS value FROM orders WHERE o_orderstatus = 'F'"}, "SELECT case_id, value FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE e.case_id = f.case_id AND regexp_replace(lower(e.value), '[^a-z0-9]', '', 'g') = regexp_replace(lower(f.value), '[^a-z0-9]', '', 'g'))")
def entities_without_fields(e, f):
    return matching.without_repeated_fields(e, f).select("case_id", "value")
