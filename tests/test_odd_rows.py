"""Queries against their oracles on rows that the test tables lack: equal boxes, long numbers, halves."""

import random

import duckdb
import pytest

from pagelake import catalog
from pagelake.functions import geometry as G
from pagelake.operators import matching, measures


def differences(spark, folder, name, **tables):
    """Rows of the query alone and of its SQL alone; tables are given as DuckDB's texts."""
    db = duckdb.connect()
    db.sql("SET threads = 1")  # ties of an ORDER BY stay in one order
    for table, sql in tables.items():
        db.sql(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    catalog.QUERIES[name](spark, str(folder)).write.parquet(f"{folder}/out")
    db.sql(f"CREATE VIEW got AS SELECT * FROM '{folder}/out/*.parquet'")
    db.sql(f"CREATE TABLE want AS {catalog.ORACLES[name]}")
    columns = ", ".join(f'"{c}"' for c in db.table("want").columns)
    assert db.sql("SELECT count(*) FROM want").fetchall()[0][0] > 0
    return [db.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} ORDER BY ALL LIMIT 5").fetchall() for a, b in (("got", "want"), ("want", "got"))]


def test_evicted_sizes_are_rounded(spark, tmp_path):
    orders = "SELECT i AS o_orderkey, 1 AS o_custkey, 'O' AS o_orderstatus, p AS o_totalprice, TIMESTAMP '2024-01-01' AS o_orderdate, '5-LOW' AS o_orderpriority FROM (VALUES (1, 250000.6::DOUBLE), (2, 249999.5::DOUBLE), (3, 0.5::DOUBLE), (4, 1.0::DOUBLE)) t(i, p)"
    assert differences(spark, tmp_path, "evicted_entries", orders=orders) == [[], []]


def test_tin_of_more_than_nine_digits(spark, tmp_path):
    supplier = "SELECT i::BIGINT AS s_suppkey, 'x' AS s_name, 1 AS s_nationkey, 1.0::DOUBLE AS s_acctbal FROM (VALUES (0), (8593), (8594), (59999)) t(i)"
    assert differences(spark, tmp_path, "tin_zip_check", supplier=supplier) == [[], []]


PARTS = "SELECT i AS p_partkey, 'name ' || i % 4 AS p_name, 'Brand#' || i % 7 % 2 AS p_brand, 'LARGE' AS p_type, i % 7 % 6 + 1 AS p_size, 900.0::DOUBLE AS p_retailprice FROM range({}) t(i)"


def test_equal_regions_outside_the_frame_stay(spark, tmp_path):
    assert differences(spark, tmp_path, "outside_frames", part=f"SELECT * REPLACE ('Brand#' || p_partkey % 1800 AS p_brand) FROM ({PARTS.format(3 * 1800)})") == [[], []]
    rows = [("d", 1, i, "a", 0.0, 0.0, 1.0, 1.0) for i in (2, 1)] + [("d", 1, 3, "b", 0.0, 0.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "document_id string, page_number int, region_id int, text string, left double, top double, right double, bottom double")
    assert sorted(r.region_id for r in matching.first_of_equal(frame).collect()) == [1, 3]



def rows_of_joins(spark, tmp_path, name, **tables):
    """The differences of a query and the most rows that any of its joins made."""
    seen = []
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        both = differences(spark, tmp_path, name, **tables)
        frame = catalog.QUERIES[name](spark, str(tmp_path))
        execution = frame._jdf.queryExecution()
        execution.executedPlan().execute().count()
        todo = [execution.executedPlan()]
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            if "Join" in node.nodeName():
                seen.append(node.metrics().apply("numOutputRows").value())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return both, max(seen)


@pytest.mark.parametrize("name", ["chosen_tables", "kept_labels", "grown_tables", "contained_table_rows", "placed_options", "uncovered_controls"])
def test_equal_boxes_are_compared_once(spark, tmp_path, name):
    """Sixty copies of each of 50 boxes: pairs of boxes are few, pairs of rows 3,600 times as many."""
    copies = f"SELECT * REPLACE (p_partkey % 50 + p_partkey // 50 * 1800 AS p_partkey) FROM ({PARTS.format(3000)})"
    part = f"SELECT * REPLACE ('Brand#' || p_partkey % 1800 % 2 // 2 AS p_brand) FROM ({copies})"
    both, most = rows_of_joins(spark, tmp_path, name, part=part)
    assert both == [[], []] and most <= 3000


@pytest.mark.parametrize("name", ["owned_labels", "same_controls"])
def test_pairs_of_equal_boxes(spark, tmp_path, name):
    """More copies of a box than a piece holds; every pair of them is there."""
    copies = f"SELECT * REPLACE (p_partkey % 12 + p_partkey // 12 * 1800 AS p_partkey) FROM ({PARTS.format(3600)})"
    both, most = rows_of_joins(spark, tmp_path, name, part=copies)
    assert both == [[], []] and most <= 3600


def test_points_meet_boxes_in_cells_of_their_size(spark):
    rng = random.Random(8)
    at = lambda: (float(rng.randint(0, 250)), float(rng.randint(0, 250)))
    boxes = [("d", i, x, y, x + w, y + h) for i in range(400) for (x, y), (w, h) in [(at(), (rng.choice((0, 2, 4, 200)), rng.choice((-1, 1, 3, 64))))]]
    points = [("d", i, *at()) for i in range(400)]
    b = spark.createDataFrame(boxes, "d string, box int, left double, top double, right double, bottom double")
    p = spark.createDataFrame(points, "d string, point int, x double, y double")
    want = sorted((q[1], r[1]) for q in points for r in boxes if r[2] <= q[2] <= r[4] and r[3] <= q[3] <= r[5])
    assert sorted((r.point, r.box) for r in G.points_in_boxes(p, b, ["d"]).collect()) == want
    assert sorted(r.point for r in G.points_in_boxes(p, b, ["d"], "left_anti").collect()) == sorted({q[1] for q in points} - {q for q, _ in want})
    spread, cells = G.spread_boxes(b), G.at_levels(p, G.box_levels(b, ["d"]), ["d"])
    assert cells.join(spread, ["d", *G.CELLS]).count() < 0.3 * len(boxes) * len(points)


def boxes_of(spark, seed, n=300, most=120):
    rng = random.Random(seed)
    rows = [("d", i, x, y, x + rng.choice((1, 3, 8, 30, 90)), y + rng.choice((1, 4, 9, 40))) for i in range(n) for x, y in [(float(rng.randint(0, most)), float(rng.randint(0, most)))]]
    rows += [("d", n + r[1], *r[2:]) for r in rows[:40] for _ in range(1)] + [("d", 2 * n + r[1], *r[2:]) for r in rows[:20]]
    return rows, spark.createDataFrame(rows, "d string, k int, left double, top double, right double, bottom double")


def test_similar_boxes_are_those_of_all_pairs(spark):
    rows, frame = boxes_of(spark, 9)

    def iou(p, q):
        w, h = min(p[4], q[4]) - max(p[2], q[2]), min(p[5], q[5]) - max(p[3], q[3])
        inside = max(w, 0) * max(h, 0)
        return inside / (sum((r[4] - r[2]) * (r[5] - r[3]) for r in (p, q)) - inside)

    got = [(r.a, r.b) for r in measures.similar_boxes(frame, ["d"], "k", 0.3).collect()]
    assert sorted(got) == sorted((p[1], q[1]) for p in rows for q in rows if p[1] < q[1] and iou(p, q) > 0.3)


def test_holders_are_those_of_all_pairs(spark):
    rows, frame = boxes_of(spark, 10)
    centre = lambda p: ((p[2] + p[4]) / 2, (p[3] + p[5]) / 2)
    holds = lambda q, p: q[2] <= centre(p)[0] <= q[4] and q[3] <= centre(p)[1] <= q[5]
    whole = lambda q, p: q[2] <= p[2] and q[3] <= p[3] and q[4] >= p[4] and q[5] >= p[5]
    small = {p[1]: min(((q[4] - q[2]) * (q[5] - q[3]), q[1]) for q in rows if q[1] != p[1] and holds(q, p))[1] for p in rows if any(q[1] != p[1] and holds(q, p) for q in rows)}
    assert {r.k: r.holder for r in measures.smallest_holder(frame, frame, ["d"], "k").collect()} == small
    alone = sorted(p[1] for p in rows if not any(q[1] != p[1] and whole(q, p) for q in rows))
    assert sorted(r.k for r in measures.outside_others(frame, ["d"], "k").collect()) == alone


@pytest.mark.parametrize("name", ["smallest_container", "contained_anti"])
def test_holders_are_looked_up_by_cell(spark, tmp_path, name):
    part = PARTS.format(2000)
    assert differences(spark, tmp_path, name, part=part) == [[], []]
    plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "_gx" in plan and "_gy" in plan
