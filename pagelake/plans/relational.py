"""Queries of joins, aggregates, windows and sets over the star tables and events.

``add(name, sql)`` registers a query in SQL and its oracle; a second text is the oracle's where dialects differ. ``through`` gives
a query of that name to the engine's own operator instead: the SQL is then its oracle alone.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pagelake.functions import confidence
from pagelake.functions import geometry as G
from pagelake.operators import measures as M
from pagelake.session import table

QUERIES, ORACLES = {}, {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def rows_of(sql: str):
    """The query (spark, sf_dir) of a text that names the test tables."""
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql)]
    text = re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(used)})\b", r"\1 {\2}", sql)

    def run(spark, sf_dir):
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})

    return run


def add(name: str, sql: str, oracle: str | None = None) -> None:
    QUERIES[name], ORACLES[name] = rows_of(sql), oracle or sql


# usage, metrics, audit
add("usage_summary", "SELECT event_type, count(*) AS n, sum(value) AS total, avg(value) AS mean, max(value) AS most, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
add("daily_volume", "SELECT substring(cast(ts AS string), 1, 10) AS day, count(*) AS n FROM events GROUP BY 1", "SELECT substring(CAST(ts AS VARCHAR), 1, 10) AS day, count(*) AS n FROM events GROUP BY 1")
add("median_by_type_day", "SELECT event_type, substring(cast(ts AS string), 1, 10) AS day, median(value) AS middle FROM events GROUP BY 1, 2", "SELECT event_type, substring(CAST(ts AS VARCHAR), 1, 10) AS day, median(value) AS middle FROM events GROUP BY 1, 2")
add("routes_zero_filled", "SELECT user_id, count(CASE WHEN event_type = 'view' THEN 1 END) AS views, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS purchases, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events GROUP BY user_id")
add("confidence_histogram", "WITH b AS (SELECT id AS bin FROM range(10)), c AS (SELECT least(9, cast(floor(l_discount * 100) AS bigint)) AS bin, count(*) AS n FROM lineitem GROUP BY 1) SELECT b.bin, coalesce(n, 0) AS n FROM b LEFT JOIN c ON b.bin = c.bin",
    "WITH b AS (SELECT range AS bin FROM range(10)), c AS (SELECT least(9, CAST(floor(l_discount * 100) AS BIGINT)) AS bin, count(*) AS n FROM lineitem GROUP BY 1) SELECT b.bin, coalesce(n, 0) AS n FROM b LEFT JOIN c ON b.bin = c.bin")
add("label_accuracy_by_source", "SELECT source, count(*) AS n, avg(cast(quality AS double)) AS accuracy, sum(toxic) AS toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY source",
    "SELECT source, count(*) AS n, avg(CAST(quality AS DOUBLE)) AS accuracy, CAST(sum(toxic) AS BIGINT) AS toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY source")
_CAL = "SELECT d.doc_id, 1 / (1 + exp(-(7.93D * ln(greatest(1D / (1 + n_chars / 2000D), 1e-12D)) + 1.787D * quality + 1.197D))) AS p, quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
add("calibration_bins", f"WITH c AS ({_CAL}) SELECT least(9, cast(floor(p * 10) AS bigint)) AS bin, count(*) AS n, round(avg(p), 6) AS mean, avg(cast(quality AS double)) AS share FROM c GROUP BY 1",
    f"WITH c AS ({_CAL}) SELECT least(9, CAST(floor(p * 10) AS BIGINT)) AS bin, count(*) AS n, round(avg(p), 6) AS mean, avg(CAST(quality AS DOUBLE)) AS share FROM c GROUP BY 1".replace("7.93D", "7.93::DOUBLE").replace("1D /", "1::DOUBLE /").replace("2000D", "2000::DOUBLE").replace("1e-12D", "1e-12").replace("1.787D", "1.787::DOUBLE").replace("1.197D", "1.197::DOUBLE"))
add("confidence_bands", "SELECT CASE WHEN l_tax >= 0.06D THEN 'high' WHEN l_tax >= 0.03D THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM lineitem GROUP BY 1", "SELECT CASE WHEN l_tax >= 0.06::DOUBLE THEN 'high' WHEN l_tax >= 0.03::DOUBLE THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM lineitem GROUP BY 1")
add("threshold_by_source", """WITH f AS (SELECT source, l.doc_id, quality, round(1 / (1 + n_chars / 2000D), 6) AS c FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
r AS (SELECT source, c, avg(cast(quality AS double)) OVER w AS share, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY source ORDER BY c DESC, doc_id ROWS UNBOUNDED PRECEDING))
SELECT source, coalesce(min(CASE WHEN share >= 0.8D THEN c END), 0.8D) AS threshold, count(*) AS labels FROM r GROUP BY source""",
    """WITH f AS (SELECT source, l.doc_id, quality, round(1 / (1 + n_chars / 2000::DOUBLE), 6) AS c FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
r AS (SELECT source, c, avg(CAST(quality AS DOUBLE)) OVER w AS share, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY source ORDER BY c DESC, doc_id ROWS UNBOUNDED PRECEDING))
SELECT source, coalesce(min(CASE WHEN share >= 0.8::DOUBLE THEN c END), 0.8::DOUBLE) AS threshold, count(*) AS labels FROM r GROUP BY source""")
add("exception_rate", "SELECT o_orderpriority, count(*) AS cases, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0D ELSE 0.0D END) AS exception_rate, sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS touched FROM orders GROUP BY o_orderpriority",
    "SELECT o_orderpriority, count(*) AS cases, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS exception_rate, CAST(sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS BIGINT) AS touched FROM orders GROUP BY o_orderpriority")
add("json_props", "SELECT cast(get_json_object(props, '$.k') AS bigint) AS k, count(*) AS n FROM events GROUP BY 1", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
add("combined_usage", "SELECT o_custkey, sum(o_totalprice) AS spent, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) ELSE 'multiple' END AS priority, count(*) AS n FROM orders GROUP BY o_custkey")
add("document_status", "SELECT l_orderkey, CASE WHEN sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 0 THEN 'success' WHEN sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) < count(*) THEN 'partial' ELSE 'failed' END AS status FROM lineitem GROUP BY l_orderkey")
add("page_route", "SELECT l_orderkey, CASE WHEN max(CASE WHEN l_discount > 0.08D OR l_tax > 0.07D THEN 1 ELSE 0 END) = 1 THEN 'review' ELSE 'accept_local' END AS route FROM lineitem GROUP BY l_orderkey", "SELECT l_orderkey, CASE WHEN max(CASE WHEN l_discount > 0.08::DOUBLE OR l_tax > 0.07::DOUBLE THEN 1 ELSE 0 END) = 1 THEN 'review' ELSE 'accept_local' END AS route FROM lineitem GROUP BY l_orderkey")
add("noisy_or_by_part", "SELECT l_partkey, round(1 - exp(sum(ln(1 - l_discount))), 4) AS confidence, count(*) AS n FROM lineitem GROUP BY l_partkey")
# top-k, sampling, retention
add("usage_latest", "SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
add("latest_per_key", "SELECT user_id, event_id, r FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) q WHERE r <= 2")
add("retention_prune", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) q WHERE r > 5")
add("hash_split", "SELECT p_partkey, CASE WHEN aggregate(transform(sequence(1, 40), i -> instr('0123456789abcdef', substr(sha1(p_name), i, 1)) - 1), 0, (a, d) -> (a * 16 + d) % 10) = 0 THEN 'val' ELSE 'train' END AS split FROM part",
    "SELECT p_partkey, CASE WHEN list_reduce(list_prepend(0, [instr('0123456789abcdef', substr(sha1(p_name), i, 1)) - 1 FOR i IN range(1, 41)]), lambda a, d: (a * 16 + d) % 10) = 0 THEN 'val' ELSE 'train' END AS split FROM part")
add("chunks_of_twelve", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) DIV 12 AS chunk FROM conversations", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 12 AS chunk FROM conversations")
# windows
add("forward_fill", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END) IGNORE NULLS OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question FROM conversations", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question FROM conversations")
add("spend_running_total", "SELECT o_custkey, o_orderkey, sum(o_totalprice) OVER w AS spent, sum(o_totalprice) OVER w <= 500000 AS within FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
add("interval_islands", """WITH i AS (SELECT l_orderkey, l_shipdate AS low, l_shipdate + INTERVAL 20 DAYS AS high, l_linenumber FROM lineitem),
f AS (SELECT *, CASE WHEN low <= max(high) OVER (PARTITION BY l_orderkey ORDER BY low, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM i),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY low, l_linenumber ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT l_orderkey, island, min(low) AS low, max(high) AS high, count(*) AS n FROM g GROUP BY l_orderkey, island""")
add("gap_segments", """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM g""")
add("row_offsets", "SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem")
add("boundary_rows", "SELECT o_custkey, min(CASE WHEN a = 1 THEN o_orderkey END) AS first_order, min(CASE WHEN z = 1 THEN o_orderkey END) AS last_order FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS z FROM orders) q GROUP BY o_custkey")
add("edge_chains", """WITH e AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = lag(o_orderstatus) OVER w THEN 0 ELSE 1 END AS fresh, o_orderdate FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS chain FROM e) SELECT o_custkey, chain, min(o_orderstatus) AS status, count(*) AS n FROM c GROUP BY o_custkey, chain""")
add("order_inversions", """WITH r AS (SELECT l_orderkey, l_linenumber AS i, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS r FROM lineitem)
SELECT a.l_orderkey, count(*) AS inversions, min(a.i) AS first_at FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.i < b.i AND a.r > b.r GROUP BY a.l_orderkey""")
add("running_counts_active", """WITH m AS (SELECT ts, event_id, user_id, CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS step FROM events)
SELECT user_id, event_id, sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS active, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ticket FROM m""")
# joins
add("point_in_interval", """SELECT e.event_id, o.o_orderkey FROM events e JOIN orders o ON e.user_id = o.o_custkey AND e.value BETWEEN o.o_totalprice / 5000 AND o.o_totalprice / 1000""")
add("points_left_anti", "SELECT e.event_id FROM events e LEFT ANTI JOIN orders o ON e.user_id = o.o_custkey AND e.value < o.o_totalprice / 1000", "SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE e.user_id = o.o_custkey AND e.value < o.o_totalprice / 1000)")
add("argmax_join", "SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 20 * c_acctbal) q WHERE r = 1")
add("adjacent_pairs", "WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS page FROM orders) SELECT a.o_custkey, a.page, a.o_orderkey AS this_order, b.o_orderkey AS next_order FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND b.page = a.page + 1 AND a.o_orderstatus = b.o_orderstatus")
add("or_lookup", "SELECT DISTINCT c_custkey, s_suppkey FROM (SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey = s_suppkey UNION SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND floor(c_acctbal / 100) = floor(s_acctbal / 100)) q",
    "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey = s_suppkey OR (c_nationkey = s_nationkey AND floor(c_acctbal / 100) = floor(s_acctbal / 100))")
add("missing_required", "SELECT n_nationkey, n_name FROM nation LEFT ANTI JOIN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) c ON n_nationkey = c_nationkey", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
add("latest_verdict", "WITH f AS (SELECT user_id, max_by(event_type, struct(ts, event_id)) AS verdict FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id) SELECT c_custkey, verdict FROM customer LEFT JOIN f ON c_custkey = user_id", "WITH f AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS verdict FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id) SELECT c_custkey, verdict FROM customer LEFT JOIN f ON c_custkey = user_id")
add("kth_occurrence_pairs", """WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O')
SELECT a.o_custkey, a.k, a.o_orderkey AS f_order, b.o_orderkey AS o_order FROM a JOIN b ON a.o_custkey = b.o_custkey AND a.k = b.k""")
add("initials_folded", """WITH g AS (SELECT c_nationkey, substr(c_mktsegment, 1, 1) AS i, c_mktsegment AS name FROM customer GROUP BY 1, 2, 3), u AS (SELECT c_nationkey, i, min(name) AS name FROM g GROUP BY 1, 2 HAVING count(*) = 1)
SELECT c_custkey, u.name AS joined FROM customer c JOIN u ON c.c_nationkey = u.c_nationkey AND substr(c.c_mktsegment, 1, 1) = u.i""")
_BOX = "SELECT p_partkey, p_size AS grp, cast(p_partkey % 97 AS double) AS l, cast(p_partkey % 89 AS double) AS t, cast(p_partkey % 97 + 10 + p_partkey % 13 AS double) AS r, cast(p_partkey % 89 + 10 + p_partkey % 7 AS double) AS b FROM part"
add("iou_pairs", f"""WITH x AS ({_BOX}), p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, greatest(0, least(a.r, b.r) - greatest(a.l, b.l)) * greatest(0, least(a.b, b.b) - greatest(a.t, b.t)) AS inside, (a.r - a.l) * (a.b - a.t) + (b.r - b.l) * (b.b - b.t) AS total FROM x a JOIN x b ON a.grp = b.grp AND a.p_partkey < b.p_partkey)
SELECT a, b, round(inside / (total - inside), 6) AS iou FROM p WHERE inside > 0.3 * (total - inside)""")
add("nearest_above", f"""WITH x AS ({_BOX}), h AS (SELECT * FROM x WHERE p_partkey % 5 = 0) SELECT p_partkey, heading FROM (SELECT x.p_partkey, h.p_partkey AS heading, row_number() OVER (PARTITION BY x.p_partkey ORDER BY h.b DESC, h.p_partkey) AS r FROM x JOIN h ON x.grp = h.grp AND h.b <= x.t AND h.l < x.r AND x.l < h.r) q WHERE r = 1""")
add("smallest_container", f"""WITH x AS ({_BOX}) SELECT p_partkey, holder FROM (SELECT x.p_partkey, h.p_partkey AS holder, row_number() OVER (PARTITION BY x.p_partkey ORDER BY (h.r - h.l) * (h.b - h.t), h.p_partkey) AS k FROM x JOIN x h ON x.grp = h.grp AND x.p_partkey <> h.p_partkey AND (x.l + x.r) / 2 BETWEEN h.l AND h.r AND (x.t + x.b) / 2 BETWEEN h.t AND h.b) q WHERE k = 1""")
add("union_boxes", f"WITH x AS ({_BOX}) SELECT grp, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM x GROUP BY grp")
add("contained_anti", f"WITH x AS ({_BOX}) SELECT x.p_partkey FROM x LEFT ANTI JOIN x h ON x.grp = h.grp AND x.p_partkey <> h.p_partkey AND h.l <= x.l AND h.t <= x.t AND h.r >= x.r AND h.b >= x.b", f"WITH x AS ({_BOX}) SELECT x.p_partkey FROM x WHERE NOT EXISTS (SELECT 1 FROM x h WHERE x.grp = h.grp AND x.p_partkey <> h.p_partkey AND h.l <= x.l AND h.t <= x.t AND h.r >= x.r AND h.b >= x.b)")
# sets and cases
add("stage_difference", """WITH a AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'modified' ELSE 'same' END AS change FROM a FULL OUTER JOIN b ON a.k = b.k""")
add("multiset_except", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
add("multiset_intersect", "SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'F' INTERSECT ALL SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'O'")
add("strict_subset", """WITH a AS (SELECT o_custkey, collect_set(o_orderpriority) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, collect_set(o_orderpriority) AS s FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT a.o_custkey FROM a JOIN b ON a.o_custkey = b.o_custkey WHERE size(array_except(b.s, a.s)) = 0 AND size(b.s) < size(a.s)""",
    """WITH a AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS s FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT a.o_custkey FROM a JOIN b ON a.o_custkey = b.o_custkey WHERE list_has_all(a.s, b.s) AND len(b.s) < len(a.s)""")
add("conflicting_values", """WITH g AS (SELECT o_custkey, lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '')) AS norm, count(DISTINCT o_orderdate) AS docs, max(o_totalprice) AS top, min(o_orderkey) AS seen FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY docs DESC, top DESC, seen) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM g)
SELECT o_custkey, norm, docs, CASE WHEN n > 1 THEN 'documents disagree' ELSE '' END AS problem FROM r WHERE r = 1""",
    """WITH g AS (SELECT o_custkey, lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]', '', 'g')) AS norm, count(DISTINCT o_orderdate) AS docs, max(o_totalprice) AS top, min(o_orderkey) AS seen FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY docs DESC, top DESC, seen) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM g)
SELECT o_custkey, norm, docs, CASE WHEN n > 1 THEN 'documents disagree' ELSE '' END AS problem FROM r WHERE r = 1""")
add("representative_pick", "SELECT p_brand, p_name FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_retailprice DESC, p_partkey) AS r FROM part) q WHERE r = 1")
add("expiring", "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'expired' ELSE 'soon' END AS state FROM orders WHERE o_orderdate < TIMESTAMP '1996-03-31'")
add("latest_state", "SELECT user_id, max_by(event_type, struct(ts, event_id)) AS state, count(*) AS revisions FROM events GROUP BY user_id", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS revisions FROM events GROUP BY user_id")
add("pivot_submission", "SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS o, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS p FROM orders GROUP BY o_custkey")
add("json_export", "SELECT n_nationkey, to_json(named_struct('name', n_name, 'region', n_regionkey)) AS doc FROM nation", "SELECT n_nationkey, CAST(to_json({'name': n_name, 'region': n_regionkey}) AS VARCHAR) AS doc FROM nation")
# additions: generic operators that the surveyed inventory does not have
add("extra_rollup", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
add("extra_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
add("extra_tumbling", "SELECT window.start AS start, event_type, count(*) AS n FROM events GROUP BY window(ts, '1 hour'), event_type", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
add("extra_as_of", """WITH mixed AS (SELECT user_id, ts, event_id, NULL AS price FROM events UNION ALL SELECT o_custkey, o_orderdate, NULL, o_totalprice FROM orders),
f AS (SELECT user_id, ts, event_id, last_value(price) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id NULLS FIRST, price ROWS UNBOUNDED PRECEDING) AS price FROM mixed) SELECT event_id, price FROM f WHERE event_id IS NOT NULL""",
    """WITH mixed AS (SELECT user_id, ts, event_id, NULL AS price FROM events UNION ALL SELECT o_custkey, o_orderdate, NULL, o_totalprice FROM orders),
f AS (SELECT user_id, ts, event_id, last_value(price IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id NULLS FIRST, price ROWS UNBOUNDED PRECEDING) AS price FROM mixed) SELECT event_id, price FROM f WHERE event_id IS NOT NULL""")
add("star_revenue", "SELECT r_name, o_orderpriority, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, o_orderpriority")


def through(f):
    """The query named like f is f's: f gets a function that reads a table or the rows of a text."""
    assert f.__name__ in ORACLES

    def run(spark, sf_dir):
        return f(lambda x: table(spark, sf_dir, x) if x in TABLES else rows_of(x)(spark, sf_dir))

    QUERIES[f.__name__] = run
    return f


c = F.col


@through
def usage_summary(rows):
    return M.usage_summary(rows("events"), "event_type", "value", "user_id")


@through
def daily_volume(rows):
    return M.daily_volume(rows("events"), "ts")


@through
def median_by_type_day(rows):
    return M.medians(rows("events"), "event_type", "ts", "value")


@through
def routes_zero_filled(rows):
    return M.counts_of(rows("events"), "user_id", "event_type", {"views": "view", "purchases": "purchase", "errors": "error"})


@through
def confidence_histogram(rows):
    return M.histogram(rows("lineitem"), "l_discount", scale=100)


@through
def label_accuracy_by_source(rows):
    return M.accuracy(rows("labels").join(rows("documents").select("doc_id", "source"), "doc_id"), "source", "quality", "toxic")


@through
def calibration_bins(rows):
    read = rows("labels").join(rows("documents").select("doc_id", "n_chars"), "doc_id").withColumn("p", confidence.calibrated(1 / (1 + c("n_chars") / 2000.0), c("quality")))
    return read.groupBy(F.least(F.lit(9), F.floor(c("p") * 10)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean"), F.avg(c("quality").cast("double")).alias("share"))


@through
def exception_rate(rows):
    return M.exception_rates(rows("orders"), "o_orderpriority", c("o_orderstatus") == "F", c("o_totalprice") > 200000)


@through
def combined_usage(rows):
    return M.combined_usage(rows("orders"), "o_custkey", "o_totalprice", "o_orderpriority")


@through
def document_status(rows):
    return M.document_status(rows("lineitem"), "l_orderkey", c("l_returnflag") == "R")


@through
def page_route(rows):
    return M.page_route(rows("lineitem"), "l_orderkey", (c("l_discount") > 0.08) | (c("l_tax") > 0.07))


@through
def noisy_or_by_part(rows):
    return rows("lineitem").groupBy("l_partkey").agg(confidence.noisy_or(c("l_discount")).alias("confidence"), F.count("*").alias("n"))


@through
def latest_per_key(rows):
    return M.latest(rows("events"), "user_id", ["ts", "event_id"], 2).select("user_id", "event_id", "r")


@through
def hash_split(rows):
    return rows("part").select("p_partkey", M.hash_split(c("p_name")).alias("split"))


@through
def chunks_of_twelve(rows):
    return M.chunks(rows("conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "chunk")


@through
def interval_islands(rows):
    shipped = rows("lineitem").select("l_orderkey", "l_linenumber", c("l_shipdate").alias("low"), (c("l_shipdate") + F.expr("INTERVAL 20 DAYS")).alias("high"))
    return M.islands(shipped, "l_orderkey", "low", "high", "l_linenumber")


@through
def gap_segments(rows):
    return M.segments(rows("events"), "user_id", "ts", "event_id", F.expr("INTERVAL 30 MINUTES")).select("user_id", "event_id", "segment")


@through
def row_offsets(rows):
    return M.row_offsets(rows("lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"], "l_quantity").select("l_orderkey", "l_linenumber", "before")


@through
def boundary_rows(rows):
    return M.boundary(rows("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey", "first_order", "last_order")


@through
def edge_chains(rows):
    return M.chains(rows("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus")


@through
def order_inversions(rows):
    return M.inversions(rows("lineitem"), "l_orderkey", "l_linenumber", ["l_shipdate", "l_linenumber"])


@through
def argmax_join(rows):
    pairs = rows("customer").join(rows("orders"), c("c_custkey") == c("o_custkey")).filter("o_totalprice > 20 * c_acctbal")
    return M.best_match(pairs, "c_custkey", "o_totalprice", "o_orderkey").select("c_custkey", "o_orderkey", "o_totalprice")


@through
def latest_verdict(rows):
    feedback = rows("events").filter("event_type in ('purchase', 'error')").withColumnRenamed("user_id", "c_custkey")
    return M.latest_verdict(rows("customer").select("c_custkey"), feedback, "c_custkey", "event_type", ["ts", "event_id"])


@through
def kth_occurrence_pairs(rows):
    of = lambda status: rows("orders").filter(c("o_orderstatus") == status)
    return M.paired_occurrences(of("F"), of("O"), "o_custkey", "o_orderkey").withColumnsRenamed({"first": "f_order", "second": "o_order"})


@through
def initials_folded(rows):
    names = rows("customer").withColumn("i", F.substring("c_mktsegment", 1, 1))
    return M.folded_initials(names, "c_nationkey", "i", "c_mktsegment").select("c_custkey", "joined")


def _placed(rows):
    return rows(_BOX).withColumnsRenamed({"l": "left", "t": "top", "r": "right", "b": "bottom"})


@through
def iou_pairs(rows):
    return M.similar_boxes(_placed(rows), ["grp"], "p_partkey", 0.3).select("a", "b", F.round("iou", 6).alias("iou"))


@through
def nearest_above(rows):
    x = _placed(rows)
    return M.nearest_above(x, x.filter("p_partkey % 5 = 0"), ["grp"], "p_partkey")


@through
def smallest_container(rows):
    x = _placed(rows)
    return M.smallest_holder(x, x, ["grp"], "p_partkey")


@through
def contained_anti(rows):
    return M.outside_others(_placed(rows), ["grp"], "p_partkey").select("p_partkey")


@through
def union_boxes(rows):
    return G.union_of(_placed(rows), "grp").withColumnsRenamed({"left": "l", "top": "t", "right": "r", "bottom": "b"})


@through
def multiset_except(rows):
    of = lambda flag: rows("lineitem").filter(c("l_returnflag") == flag).select("l_partkey")
    return of("A").exceptAll(of("R"))


@through
def multiset_intersect(rows):
    of = lambda status: rows("lineitem").filter(c("l_linestatus") == status).select("l_suppkey")
    return of("F").intersectAll(of("O"))


@through
def strict_subset(rows):
    of = lambda status: rows("orders").filter(c("o_orderstatus") == status)
    return M.fewer(of("F"), of("O"), "o_custkey", "o_orderpriority")


@through
def expiring(rows):
    return M.expiring(rows("orders"), "o_orderdate", F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey", "state")
