"""Queries of the region, box and reading operators, over rows that both engines derive from the star tables by the same text.

A fixture's box columns are l, t, r, b in SQL; the operators get them as left, top, right, bottom.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions import alignment as A
from pagelake.functions import regions as R
from pagelake.operators import evaluate, layout, matching
from pagelake.plans.relational import rows_of
from pagelake.sources import readers, sinks

QUERIES, ORACLES = {}, {}
SIDES = {"l": "left", "t": "top", "r": "right", "b": "bottom"}


def query(fixtures: dict[str, str], oracle: str | None = None):
    """Registers f(**frames) under its name; the oracle's text sees the fixtures as common table expressions."""

    def add(f):
        def run(spark, sf_dir):
            frames = {n: rows_of(sql)(spark, sf_dir) for n, sql in fixtures.items()}
            return f(**{n: d.withColumnsRenamed(SIDES) if set(SIDES) <= set(d.columns) else d for n, d in frames.items()})

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = "WITH " + ", ".join(f"{n} AS ({sql})" for n, sql in fixtures.items()) + " " + oracle
        return f

    return add


def boxes(key: str, where: str = "TRUE", more: str = "", step: int = 37) -> str:
    x, y = f"p_partkey * {step} % 200", "p_partkey * 53 % 150"
    sides = f"CAST({x} AS DOUBLE) AS l, CAST({y} AS DOUBLE) AS t, CAST({x} + 40 + p_partkey % 60 AS DOUBLE) AS r, CAST({y} + 20 + p_partkey % 45 AS DOUBLE) AS b"
    return f"SELECT p_brand AS document_id, p_partkey % 3 AS page_number, p_partkey AS {key}, {sides}{', ' + more if more else ''} FROM part WHERE {where}"


def inside(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.r, {b}.r) - greatest({a}.l, {b}.l)) * greatest(0, least({a}.b, {b}.b) - greatest({a}.t, {b}.t)))"


def area(a: str) -> str:
    return f"(({a}.r - {a}.l) * ({a}.b - {a}.t))"


def smaller(a: str, b: str) -> str:
    return f"({inside(a, b)} / least({area(a)}, {area(b)}))"


def iou(a: str, b: str) -> str:
    return f"({inside(a, b)} / ({area(a)} + {area(b)} - {inside(a, b)}))"


def same_page(a: str, b: str) -> str:
    return f"{a}.document_id = {b}.document_id AND {a}.page_number = {b}.page_number"


_CATEGORY = "SELECT p_partkey AS region_id, CASE p_partkey % 6 WHEN 0 THEN 'doc_title' WHEN 1 THEN 'figure_title' WHEN 2 THEN 'algorithm' WHEN 3 THEN 'header' WHEN 4 THEN 'vision_footnote' ELSE p_type END AS category, CASE p_partkey % 4 WHEN 0 THEN 'form_source' WHEN 1 THEN 'section_heading' WHEN 2 THEN 'layout_block' END AS role FROM part"


@query({"x": _CATEGORY}, """, k AS (SELECT region_id, role, CASE category WHEN 'doc_title' THEN 'title' WHEN 'figure_title' THEN 'caption' WHEN 'algorithm' THEN 'code' WHEN 'header' THEN 'page-header' WHEN 'vision_footnote' THEN 'footnote' ELSE 'text' END AS kind FROM x)
SELECT region_id, kind, CASE WHEN role = 'section_heading' THEN 'heading' WHEN kind = 'title' THEN 'title' WHEN kind = 'page-header' THEN 'header' WHEN role = 'form_source' THEN 'field' ELSE 'text' END AS meaning FROM k""")
def region_kinds(x):
    kind = R.kind_of(F.col("category"))
    return x.select("region_id", kind.alias("kind"), R.semantic_kind(kind, F.col("role"), F.lit(None).cast("string")).alias("meaning"))


@query({"x": "SELECT o_orderkey, concat(CAST(o_orderkey % 15 AS STRING), ' ', CAST(o_orderkey % 35 AS STRING), ' | ', CAST(10 + o_orderkey % 90 AS STRING)) AS text FROM orders"},
       "SELECT o_orderkey, CASE WHEN o_orderkey % 15 BETWEEN 1 AND 12 AND o_orderkey % 35 BETWEEN 1 AND 31 THEN replace(replace(text, ' | ', '/'), ' ', '/') ELSE text END AS text FROM x")
def boxed_dates(x):
    return x.select("o_orderkey", R.boxed_date(F.col("text")).alias("text"))


_DOUBT = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 50 = 0 THEN 1 END AS retries, l_partkey % 3 > 0 AS calibrated, l_discount * 10 AS confidence, l_tax * 12 AS least_word, CASE WHEN l_suppkey % 40 = 0 THEN 1 ELSE 0 END AS unread, l_suppkey % 7 = 0 AS mixed FROM lineitem"


@query({"x": _DOUBT}, """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN retries > 0 THEN 'sampled_retry_read' WHEN calibrated AND confidence < 0.5 THEN 'likely_misread_text' WHEN least_word < 0.5 OR unread > 0 THEN 'second_reader_doubt' WHEN calibrated AND mixed THEN 'letter_among_digits' END AS reason FROM x""")
def misread_reasons(x):
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.misread_reason(F.col("retries"), F.col("calibrated"), F.col("confidence"), F.col("least_word"), F.col("unread"), F.col("mixed")).alias("reason"))


_SHOWN = "SELECT p_partkey AS region_id, CASE p_partkey % 5 WHEN 0 THEN 'figure' WHEN 1 THEN 'form' WHEN 2 THEN 'word' ELSE 'text' END AS kind, CASE WHEN p_partkey % 11 = 0 THEN 'table_source' ELSE '' END AS role, CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_brand END AS text, CASE p_size % 4 WHEN 0 THEN 'unreadable' ELSE 'resolved' END AS resolution, p_size % 5 = 0 AS img, p_size % 2 = 0 AS kids, p_partkey % 10 / 10.0 AS confidence FROM part"


@query({"x": _SHOWN}, """SELECT region_id, CASE WHEN role = 'table_source' OR kind = 'word' THEN 'not_content' WHEN kind = 'form' AND kids THEN 'layout_container' WHEN trim(text) = '' AND NOT img AND kind = 'figure' AND resolution = 'resolved' THEN 'empty_graphic' WHEN trim(text) = '' AND NOT img AND (kind = 'figure' OR resolution = 'unreadable') THEN 'no_text' END AS reason,
resolution = 'resolved' AND confidence < 0.3 AND length(trim(text)) <= 2 AS speck FROM x""")
def suppression_reasons(x):
    c = F.col
    return x.select("region_id", R.suppression_reason(c("kind"), c("role"), c("text"), c("resolution"), c("img"), c("kids")).alias("reason"), R.junk_speck(c("kind"), c("resolution"), F.lit(""), c("confidence"), c("text")).alias("speck"))


_NAMES = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN concat('Lee, Ann Q ', c_mktsegment) WHEN 1 THEN concat('Ann ', c_mktsegment, ', MD') WHEN 2 THEN concat('ANN B ', c_mktsegment, ' (RN)') ELSE c_mktsegment END AS name FROM customer"


@query({"x": _NAMES}, """, n AS (SELECT c_custkey, name, substr(name, CASE c_custkey % 4 WHEN 0 THEN 12 WHEN 1 THEN 5 WHEN 2 THEN 7 ELSE 1 END) AS tail FROM x), s AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN tail WHEN 1 THEN replace(tail, ', MD', '') WHEN 2 THEN replace(tail, ' (RN)', '') ELSE tail END AS m FROM n)
SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN upper(substr(m, 1, 1)) || lower(substr(m, 2)) ELSE 'Ann' END AS first, CASE c_custkey % 4 WHEN 0 THEN 'Q ' || m WHEN 2 THEN 'B' ELSE '' END AS middle, CASE c_custkey % 4 WHEN 0 THEN 'Lee' WHEN 1 THEN m WHEN 2 THEN upper(substr(m, 1, 1)) || lower(substr(m, 2)) ELSE '' END AS last, CASE c_custkey % 4 WHEN 1 THEN 'MD' WHEN 2 THEN 'RN' ELSE '' END AS credential FROM s""")
def person_names(x):
    return x.select("c_custkey", A.person_name("name").alias("n")).select("c_custkey", "n.first", "n.middle", "n.last", "n.credential")


@query({"words": boxes("word_id", "p_partkey % 4 > 0"), "tables": boxes("table_id", "p_partkey % 4 = 0")}, f""", p AS (SELECT w.*, x.table_id, row_number() OVER (PARTITION BY w.document_id, w.page_number, w.word_id ORDER BY {inside('w', 'x')} / {area('w')} DESC, x.table_id) AS k FROM words w JOIN tables x ON {same_page('w', 'x')} WHERE {inside('w', 'x')} / {area('w')} > 0.2),
g AS (SELECT document_id, page_number, table_id, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM p WHERE k = 1 GROUP BY ALL)
SELECT x.table_id, least(x.l, coalesce(g.l, x.l)) AS x0, least(x.t, coalesce(g.t, x.t)) AS y0, greatest(x.r, coalesce(g.r, x.r)) AS x1, greatest(x.b, coalesce(g.b, x.b)) AS y1 FROM tables x LEFT JOIN g ON {same_page('x', 'g')} AND x.table_id = g.table_id""")
def grown_tables(words, tables):
    return matching.grown_tables(tables, words).select("table_id", F.col("left").alias("x0"), F.col("top").alias("y0"), F.col("right").alias("x1"), F.col("bottom").alias("y1"))


@query({"a": boxes("table_id", "p_partkey % 2 = 0"), "z": boxes("table_id", "p_partkey % 2 = 1"), "c": boxes("content_id", "p_partkey % 5 = 0")}, f""", u AS (SELECT z.document_id, z.page_number, z.table_id AS zi, a.table_id AS ai, {area('z')} > {area('a')} AS larger, count(*) OVER (PARTITION BY z.table_id) AS n, count(*) OVER (PARTITION BY a.table_id) AS m FROM z JOIN a ON {same_page('z', 'a')} WHERE {smaller('z', 'a')} >= 0.5),
q AS (SELECT DISTINCT u.zi, u.ai FROM u JOIN z ON z.table_id = u.zi JOIN a ON a.table_id = u.ai JOIN c ON {same_page('c', 'z')} WHERE n = 1 AND m = 1 AND larger AND {inside('c', 'z')} / {area('c')} >= 0.5 AND {inside('c', 'a')} / {area('c')} < 0.5)
SELECT table_id, 'second' AS origin FROM z WHERE table_id NOT IN (SELECT zi FROM q) UNION ALL SELECT ai, 'first' FROM q UNION ALL SELECT table_id, 'first' FROM a WHERE table_id NOT IN (SELECT ai FROM u)""")
def chosen_tables(a, z, c):
    return matching.chosen_tables(a, z, c).select("table_id", "origin")


@query({"a": boxes("region_id", "p_partkey % 2 = 0"), "z": boxes("region_id", "p_partkey % 2 = 1", step=41)}, f"SELECT a.region_id, 'sliced' AS rule FROM a WHERE NOT EXISTS (SELECT 1 FROM z WHERE {same_page('a', 'z')} AND {smaller('a', 'z')} >= 0.5) UNION ALL SELECT a.region_id, 'unequal' FROM a WHERE NOT EXISTS (SELECT 1 FROM z WHERE {same_page('a', 'z')} AND {iou('a', 'z')} > 0.2)")
def uncovered_controls(a, z):
    one = matching.not_covered(a, z).select("region_id", F.lit("sliced").alias("rule"))
    return one.unionByName(matching.without_equal(a, z, 0.2).select("region_id", F.lit("unequal").alias("rule")))


@query({"o": boxes("label_id", "p_partkey % 2 = 0", "CASE WHEN p_size % 2 = 0 THEN 'picture' ELSE 'text' END AS label"), "n": boxes("label_id", "p_partkey % 2 = 1", "CASE WHEN p_size % 5 = 0 THEN 'form' ELSE 'text' END AS label", 41)},
       f"SELECT o.label_id FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.label <> 'form' AND {same_page('o', 'n')} AND ({iou('o', 'n')} > 0.3 OR (o.label = 'picture' AND {inside('o', 'n')} / {area('n')} > 0.5)))")
def kept_labels(o, n):
    return matching.kept_labels(o, n).select("label_id")


@query({"o": boxes("option_id", "p_partkey % 2 = 0"), "c": boxes("child_id", "p_partkey % 2 = 1", step=41)}, f""", p AS (SELECT o.option_id, c.child_id, (c.l + c.r) / 2 BETWEEN o.l AND o.r AND (c.t + c.b) / 2 BETWEEN o.t AND o.b AS held FROM o JOIN c ON {same_page('o', 'c')} WHERE {inside('o', 'c')} > 0), q AS (SELECT *, bool_or(held) OVER (PARTITION BY option_id) AS anyheld FROM p)
SELECT option_id, child_id FROM q WHERE held = anyheld""")
def owned_labels(o, c):
    return matching.owned_labels(o, c).select("option_id", "child_id")


_TURNS = "SELECT conv_id AS document_id, 1 AS page_number, CAST(turn AS BIGINT) AS region_id, 'text' AS kind, CASE WHEN turn % 2 = 0 THEN concat(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), chr(10), text) ELSE text END AS text, CAST(turn AS BIGINT) AS reading_order, CAST(0 AS DOUBLE) AS l, CAST(0 AS DOUBLE) AS t, CAST(100 AS DOUBLE) AS r, CAST(10 + turn AS DOUBLE) AS b FROM conversations"


@query({"x": _TURNS}, r""", w AS (SELECT document_id, region_id, reading_order, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS words, text FROM x), k AS (SELECT document_id, region_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM x),
m AS (SELECT *, regexp_extract_all(lower(s), '[\p{L}\p{N}_]+') AS mine FROM k), j AS (SELECT m.document_id, m.region_id, m.line, w.region_id AS covered_by, row_number() OVER (PARTITION BY m.document_id, m.region_id, m.line ORDER BY len(w.words) DESC, w.reading_order, w.region_id) AS k FROM m JOIN w ON m.document_id = w.document_id AND m.region_id <> w.region_id
WHERE len(mine) >= 2 AND len(w.words) > len(mine) AND list_sum([least(len([q FOR q IN mine IF q = v]), len([q FOR q IN w.words IF q = v])) FOR v IN list_distinct(mine)]) >= 0.8::DOUBLE * len(mine))
SELECT document_id, region_id, line, covered_by FROM j WHERE k = 1""")
def covering_regions(x):
    return matching.covering_regions(x).select("document_id", "region_id", "line", "covered_by")


@query({"k": boxes("key_id", "p_partkey % 2 = 0"), "v": boxes("key_id", "p_partkey % 6 = 0", step=41)}, "SELECT k.key_id, least(k.l, coalesce(v.l, k.l)) AS x0, least(k.t, coalesce(v.t, k.t)) AS y0, greatest(k.r, coalesce(v.r, k.r)) AS x1, greatest(k.b, coalesce(v.b, k.b)) AS y1, CASE WHEN v.key_id IS NULL THEN 0 ELSE 1 END AS vals FROM k LEFT JOIN v ON k.key_id = v.key_id AND k.document_id = v.document_id AND k.page_number = v.page_number")
def linked_fields(k, v):
    return matching.linked_fields(k, v).select("key_id", F.col("left").alias("x0"), F.col("top").alias("y0"), F.col("right").alias("x1"), F.col("bottom").alias("y1"), F.col("values").alias("vals"))


@query({"p": "SELECT l_suppkey AS a, l_partkey AS b FROM lineitem", "n": "SELECT p_partkey AS id, p_brand AS label FROM part"}, ", q AS (SELECT a AS id, b AS other FROM p UNION SELECT b, a FROM p) SELECT q.id, min_by(n.label, q.other) AS label, count(*) AS partners FROM q JOIN n ON q.other = n.id GROUP BY q.id")
def undirected_pairs(p, n):
    return matching.undirected(p, n)


@query({"e": "SELECT DISTINCT l_suppkey AS crop_id, CAST(l_partkey AS STRING) AS cell_id FROM lineitem WHERE l_returnflag = 'R'", "a": "SELECT DISTINCT l_suppkey AS crop_id, CAST(l_partkey AS STRING) AS cell_id FROM lineitem WHERE l_returnflag = 'A'"}, """, j AS (SELECT coalesce(e.crop_id, a.crop_id) AS crop_id, e.cell_id AS x, a.cell_id AS y FROM e FULL JOIN a ON e.crop_id = a.crop_id AND e.cell_id = a.cell_id)
SELECT crop_id, coalesce(string_agg(x, ',' ORDER BY x) FILTER (WHERE y IS NULL), '') AS missing, coalesce(string_agg(y, ',' ORDER BY y) FILTER (WHERE x IS NULL), '') AS unexpected FROM j GROUP BY crop_id""")
def cell_answers(e, a):
    return matching.cell_answers(e, a).select("crop_id", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"))


# readings, views, turns
_A, _B = "SELECT conv_id, text, 0.8 AS confidence FROM conversations WHERE turn % 2 = 0", "SELECT conv_id, text, 0.9 AS confidence FROM conversations"


@query({"a": _A, "z": _B}, """, x AS (SELECT conv_id, token, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9%$]+')) AS token FROM a) GROUP BY ALL), y AS (SELECT conv_id, token, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9%$]+')) AS token FROM z) GROUP BY ALL)
SELECT conv_id, token, greatest(coalesce(x.n, 0) - coalesce(y.n, 0), 0) AS dropped, greatest(coalesce(y.n, 0) - coalesce(x.n, 0), 0) AS added FROM x FULL JOIN y USING (conv_id, token) WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)""")
def token_changes(a, z):
    return evaluate.token_changes(a, z, ["conv_id"])


@query({"a": _A, "z": _B}, """, x AS (SELECT conv_id, token, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9%$]+')) AS token FROM a) GROUP BY ALL), y AS (SELECT conv_id, token, count(*) AS n FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9%$]+')) AS token FROM z) GROUP BY ALL),
s AS (SELECT conv_id, sum(coalesce(x.n, 0)) AS base, sum(coalesce(y.n, 0)) AS enh, sum(least(coalesce(x.n, 0), coalesce(y.n, 0))) AS kept, sum(greatest(coalesce(y.n, 0) - coalesce(x.n, 0), 0)) AS added FROM x FULL JOIN y USING (conv_id, token) GROUP BY conv_id),
k AS (SELECT DISTINCT conv_id FROM a) SELECT k.conv_id, CASE WHEN base > 0 AND kept >= 0.98 * base AND added >= 2 AND enh <= 1.25 * base THEN 'enhanced' ELSE 'baseline' END AS picked, CAST(coalesce(base, 0) AS BIGINT) AS base, CAST(coalesce(added, 0) AS BIGINT) AS added FROM k LEFT JOIN s ON k.conv_id = s.conv_id""")
def selected_view(a, z):
    return evaluate.selected_view(a, z, ["conv_id"]).select("conv_id", F.col("view").alias("picked"), "base", "added")


@query({"x": "SELECT c_nationkey AS line, c_custkey AS reader, concat(c_mktsegment, CAST(c_custkey % 7 AS STRING)) AS text FROM customer"}, "SELECT a.line, a.reader, round(avg(levenshtein(a.text, b.text) / greatest(length(a.text), length(b.text))), 6) AS disagreement FROM x a JOIN x b ON a.line = b.line AND a.reader <> b.reader GROUP BY ALL")
def reader_consensus(x):
    return evaluate.consensus(x, "line")


@query({"x": "SELECT p_partkey AS document_id, CAST(p_size AS BIGINT) AS page_number, p_partkey % 10 / 10.0 AS z FROM part"}, """, v AS (SELECT document_id, page_number, z, k, i, CASE WHEN k = (i + document_id) % 4 THEN z ELSE (1 - z) / 3 END AS p FROM x, range(4) q(k), range(4) s(i)),
s AS (SELECT document_id, page_number, (k - i + 4) % 4 AS turn, avg(ln(greatest(p, 1e-12))) / 0.6756::DOUBLE AS s FROM v GROUP BY ALL), w AS (SELECT *, s + ln(CASE turn WHEN 0 THEN 0.979::DOUBLE WHEN 2 THEN 0.0008::DOUBLE ELSE (1 - 0.979::DOUBLE - 0.0008::DOUBLE) / 2 END) AS l FROM s),
e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY document_id)) AS e FROM w), p AS (SELECT *, e / sum(e) OVER (PARTITION BY document_id) AS p FROM e), o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY p DESC, turn) AS k FROM p) SELECT document_id, CASE WHEN p < 0.9 THEN 0 ELSE turn END AS turn, round(p, 6) AS posterior FROM o WHERE k = 1""")
def page_turns(x):
    views = x.select("document_id", "page_number", F.col("z").cast("double").alias("z"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("view"))
    p = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.when(k == (F.col("view") + F.col("document_id")) % 4, F.col("z")).otherwise((1 - F.col("z")) / 3))
    return evaluate.page_turn(views.withColumn("probabilities", p)).select("document_id", "turn", "posterior")


@query({"v": "SELECT o_orderkey AS value_id, o_orderpriority AS raw FROM orders", "c": "SELECT l_orderkey AS value_id, CASE l_linenumber % 3 WHEN 0 THEN 'see 1-URGENT and 3-MEDIUM' WHEN 1 THEN 'high low' ELSE 'nothing' END AS text, CASE WHEN l_partkey % 9 > 0 THEN l_tax * 10 END AS score FROM lineitem"}, r""", j AS (SELECT v.value_id, c.score, regexp_replace(lower(v.raw), '[^a-z0-9]', '', 'g') AS k, coalesce(contains(regexp_replace(lower(c.text), '[^a-z0-9]', '', 'g'), regexp_replace(lower(v.raw), '[^a-z0-9]', '', 'g')), FALSE) AS whole, coalesce(list_has_any(regexp_extract_all(lower(v.raw), '[\p{L}\p{N}_]+'), regexp_extract_all(lower(c.text), '[\p{L}\p{N}_]+')), FALSE) AS shares FROM v LEFT JOIN c ON v.value_id = c.value_id)
SELECT value_id, round(coalesce(max(score) FILTER (WHERE whole), CASE WHEN bool_or(shares) THEN CASE WHEN count(*) FILTER (WHERE shares AND score IS NULL) = 0 THEN min(score) FILTER (WHERE shares) END WHEN count(*) FILTER (WHERE score IS NULL) = 0 THEN min(score) END), 4) AS confidence FROM j GROUP BY value_id""")
def ocr_confidence(v, c):
    return evaluate.ocr_confidence(v, c)


@query({"x": "SELECT l_orderkey AS table_id, l_linenumber AS cell_id, l_partkey % 50 AS start, l_partkey % 50 + 10 AS stop FROM lineitem WHERE l_linenumber < 4", "k": "SELECT l_orderkey AS table_id, l_partkey % 40 AS start, l_partkey % 40 + 8 AS stop, l_discount * 10 AS score FROM lineitem"},
       "SELECT x.table_id, x.cell_id, round(exp(avg(ln(greatest(k.score, 1e-30)))), 6) AS score, count(*) AS tokens FROM x JOIN k ON x.table_id = k.table_id AND k.start < x.stop AND k.stop > x.start GROUP BY ALL")
def cell_scores(x, k):
    return evaluate.cell_scores(x.withColumnRenamed("stop", "end"), k.withColumnRenamed("stop", "end"))


@query({"x": "SELECT user_id AS case_id, ts, CASE event_type WHEN 'view' THEN 'edit' WHEN 'purchase' THEN 'submit' WHEN 'click' THEN 'approve' ELSE 'open' END AS action FROM events"},
       "SELECT case_id, min(ts) FILTER (WHERE action IN ('edit', 'approve')) AS first_review, round((epoch(max(ts) FILTER (WHERE action = 'submit')) - epoch(min(ts))) / 60, 2) AS minutes, count(*) FILTER (WHERE action IN ('edit', 'approve')) AS touches FROM x GROUP BY case_id")
def case_summaries(x):
    return evaluate.case_summary(x)


@query({"x": "SELECT o_custkey AS case_id, o_orderstatus AS role, o_orderpriority AS value, o_orderkey AS position FROM orders"}, ", g AS (SELECT case_id, role, regexp_replace(lower(value), '[^a-z0-9]', '', 'g') AS norm, min_by(value, position) AS value, min(position) AS seen, count(*) AS readings FROM x GROUP BY ALL) SELECT case_id, role, value, readings, row_number() OVER (PARTITION BY case_id, role ORDER BY seen) AS number FROM g")
def numbered_groups(x):
    return evaluate.merged_groups(x, ["role"]).select("case_id", "role", "value", "readings", "number")


@query({"x": "SELECT conv_id AS document_id, 1 AS page_number, turn AS region_id, turn AS reading_order, CASE WHEN turn % 7 = 0 THEN 'formula' ELSE 'text' END AS kind, concat(text, CASE (conv_id + turn) % 5 WHEN 1 THEN repeat('дом', length(text)) WHEN 2 THEN ' 漢字' WHEN 3 THEN ' αβγ' ELSE '' END) AS text, CASE WHEN conv_id % 6 = 0 THEN 'unreadable' ELSE 'resolved' END AS resolution, conv_id % 4 = 0 AS from_pdf FROM conversations"},
       """, s AS (SELECT document_id, region_id, reading_order, unnest([{'s': 'LATIN', 'n': len(regexp_extract_all(text, '\\p{Latin}'))}, {'s': 'CYRILLIC', 'n': len(regexp_extract_all(text, '\\p{Cyrillic}'))}, {'s': 'CJK', 'n': len(regexp_extract_all(text, '\\p{Han}'))}]) AS e FROM x WHERE kind <> 'formula'),
h AS (SELECT document_id, region_id, reading_order, e.s AS script, e.n AS n FROM s WHERE e.n > 0), m AS (SELECT document_id, script, row_number() OVER (PARTITION BY document_id ORDER BY sum(n) DESC, min(reading_order), script DESC) AS k FROM h GROUP BY document_id, script),
o AS (SELECT h.document_id, h.region_id, string_agg(DISTINCT h.script, ',' ORDER BY h.script) AS f FROM h JOIN m ON h.document_id = m.document_id AND m.k = 1 AND h.script <> m.script GROUP BY ALL)
SELECT x.document_id, x.region_id, CASE WHEN f IS NOT NULL AND NOT from_pdf AND resolution <> 'unreadable' THEN 'conflicting' ELSE resolution END AS resolution, CASE WHEN NOT from_pdf AND resolution <> 'unreadable' THEN f END AS foreign FROM x LEFT JOIN o ON x.document_id = o.document_id AND x.region_id = o.region_id""")
def foreign_scripts(x):
    return evaluate.foreign_scripts(x.withColumn("scripts", A.script_letters("text"))).select("document_id", "region_id", "resolution", F.array_join("foreign", ",").alias("foreign"))


@query({"b": "SELECT item_id, text FROM benchmark", "d": "SELECT conv_id, turn, text FROM conversations WHERE turn = 1"})
def reading_alignments(b, d):
    """Benchmark passages against first turns of the same number: edits of the best span, grounding and edit counts."""
    j = b.join(d, F.col("item_id") == F.col("conv_id")).select("item_id", b["text"].alias("r"), d["text"].alias("p"))
    out = j.select("item_id", A.span_alignment("r", "p").alias("s"), A.edit_counts("p", "r").alias("e"), A.grounding("r", "p").alias("grounding"))
    return out.select("item_id", F.col("s.edits").alias("span_edits"), "grounding", "e.insertions", "e.deletions", "e.substitutions")


@query({"x": boxes("region_id", more="p_size % 3 = 0 AS inline, p_partkey AS reading_order, 'text' AS kind, CASE WHEN p_size % 4 = 0 THEN p_size END AS container_id, CAST(CASE WHEN p_partkey % 3 = 0 THEN 150 END AS DOUBLE) AS separator")})
def page_structures(x):
    """Paragraphs, seeded rows, inline runs, forms kept together and separated columns of every page."""
    return layout.with_structures(x).select("region_id", "paragraph", "row", "run", "form_rank", "separated_rank")


# sources and sinks
@query({"i": "SELECT o_orderkey AS id, o_orderpriority AS file_name FROM orders", "a": "SELECT l_partkey AS id, l_orderkey AS image_id, CAST(l_suppkey AS BIGINT) AS category_id, l_quantity AS bbox FROM lineitem"}, ", g AS (SELECT image_id, count(*) AS n, sum(category_id) AS s FROM a GROUP BY 1) SELECT i.id, coalesce(n, 0) AS labels, CAST(coalesce(s, 0) AS BIGINT) AS categories FROM i LEFT JOIN g ON i.id = g.image_id")
def coco_images(i, a):
    out = readers.coco_images(i, a)
    return out.select("id", F.size("objects").cast("long").alias("labels"), F.aggregate("objects", F.lit(0).cast("long"), lambda s, o: s + o["category_id"]).alias("categories"))


@query({"x": "SELECT p_partkey AS image_id, CAST(100 AS DOUBLE) AS width, CAST(80 AS DOUBLE) AS height, CAST(p_partkey % 120 - 5 AS DOUBLE) AS x0, CAST(p_partkey % 90 AS DOUBLE) AS y0, CAST(p_size AS DOUBLE) AS w, CAST(p_size / 2 AS DOUBLE) AS h FROM part"}, """, c AS (SELECT image_id, least(greatest(x0, 0), width) AS l, least(greatest(y0, 0), height) AS t, least(greatest(x0 + w, 0), width) AS r, least(greatest(y0 + h, 0), height) AS b FROM x)
SELECT image_id || '-1' AS label_id, l AS x0, t AS y0, r AS x1, b AS y1 FROM c WHERE r - l >= 2 AND b - t >= 2""")
def flattened_labels(x):
    nested = x.select("image_id", "width", "height", F.array(F.array("x0", "y0", "w", "h")).alias("boxes"), F.array(F.lit(1)).alias("categories"))
    return readers.flattened_labels(nested).select("label_id", F.col("left").alias("x0"), F.col("top").alias("y0"), F.col("right").alias("x1"), F.col("bottom").alias("y1"))


@query({"x": "SELECT o_custkey AS sheet, o_orderkey AS row, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS file, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey END AS page, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS label, CASE WHEN o_orderkey % 7 = 0 THEN '2024-01-01 00:00:00' ELSE 'text' END AS text FROM orders"},
       "SELECT sheet, row, last_value(file IGNORE NULLS) OVER w AS file, last_value(page IGNORE NULLS) OVER w AS page, last_value(label IGNORE NULLS) OVER w AS label, text, text = 'text' AS scorable FROM x WINDOW w AS (PARTITION BY sheet ORDER BY row ROWS UNBOUNDED PRECEDING)")
def annotation_rows(x):
    return readers.annotations(x)


@query({"x": "SELECT l_orderkey AS document_id, l_linenumber AS page_number, l_partkey AS width, l_suppkey AS height FROM lineitem"}, ", n AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS n FROM x) SELECT document_id, page_number, CASE WHEN n > 5 THEN 'too_many_pages' WHEN width * height > 50000 THEN 'page_too_large' END AS failure FROM n WHERE n > 5 OR width * height > 50000")
def page_limits(x):
    return readers.limited_pages(x, 5, 50000)[1]


@query({"x": "SELECT conv_id AS document_id, 1 AS page_number, CAST(turn AS BIGINT) AS reading_order, turn AS region_id, CASE turn WHEN 1 THEN 'title' WHEN 2 THEN 'section-header' ELSE 'list-item' END AS kind, concat('turn & ', role) AS text FROM conversations"},
       "SELECT document_id, string_agg(CASE kind WHEN 'title' THEN '# ' WHEN 'section-header' THEN '## ' ELSE '- ' END || replace(text, '&', '&amp;'), chr(10) || chr(10) ORDER BY reading_order) AS markdown FROM x GROUP BY document_id")
def markdown_documents(x):
    return sinks.markdown_documents(x)


@query({"x": "SELECT o_custkey AS document_id, 1 AS page_number, o_orderkey AS reading_order, o_orderkey AS region_id, o_orderstatus AS text FROM orders"}, """, p AS (SELECT document_id, page_number, string_agg('{"reading_order":' || reading_order || ',"region_id":' || region_id || ',"text":"' || text || '"}', ',' ORDER BY reading_order) AS rs FROM x GROUP BY ALL)
SELECT document_id, '{"document_id":' || document_id || ',"pages":[{"page_number":1,"regions":[' || rs || ']}]}' AS doc FROM p""")
def json_documents(x):
    return sinks.json_documents(x)


@query({"x": "SELECT o_custkey AS case_id, o_orderstatus AS key, o_orderpriority AS value FROM orders"}, "SELECT case_id, max(value) FILTER (WHERE key = 'F') AS F, max(value) FILTER (WHERE key = 'P') AS P FROM x GROUP BY case_id")
def submission_columns(x):
    return sinks.submissions(x, ["F", "P"])
