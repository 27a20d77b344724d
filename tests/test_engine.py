"""Operators on literal rows, the ordered recursions against plain restatements, and every query against its oracle."""

import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from pagelake import catalog
from pagelake.functions import checks, confidence, geometry
from pagelake.functions import text as T
from pagelake.operators import consolidate, layout, tables
from pagelake.streaming import ordered

DIR = "/root/testdata/sf0.001"


def values(spark, check, raws):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    return [r.value for r in rows.select("i", check(F.col("raw"))["value"].alias("value")).orderBy("i").collect()]


def test_identifier_checks(spark):
    assert values(spark, checks.npi, ["1548293764", "15 4829 3764", "1548293765", "", None]) == ["1548293764", "1548293764", None, None, None]
    assert values(spark, checks.tin, ["12-3456789", "123456789", "12345"]) == ["12-3456789", "12-3456789", None]
    assert values(spark, checks.dea, ["AB1234563", "AB1234560", "A1234563"]) == ["AB1234563", None, None]
    assert values(spark, checks.zip_code, ["12345", "12345-6789", "1234"]) == ["12345", "12345-6789", None]
    assert values(spark, checks.phone, ["(212) 555-0100", "1-212-555-0100 ext. 7", "555"]) == ["(212) 555-0100", "(212) 555-0100 x7", None]
    assert values(spark, checks.state, ["ny", "New York", "nowhere"]) == ["NY", "NY", None]
    assert values(spark, checks.date, ["2024-02-29", "2/30/2024", "2/3/24", "March 4, 2021", "Mar 4, 2021"]) == ["2024-02-29", None, "2024-02-03", "2021-03-04", "2021-03-04"]
    assert values(spark, checks.money, ["$1,000,000", "2 million", "12.50", "1.000.000", "1.500", "none"]) == ["1000000", "2000000", "12.50", "1000000", "1500", None]
    assert values(spark, checks.yes_no, ["Y", "no", "maybe"]) == ["Yes", "No", None]
    assert values(spark, checks.npi, ["l5482937b4", "NPI: 1548293764"]) == [None, "1548293764"] and values(spark, checks.tin, ["TIN l2-34S6789", "D-O"]) == ["12-3456789", None]
    assert values(spark, checks.date, ["7/1/2027 12:01 a.m. unless unpaid", "3-4-21", "Sep. 5 2020 10:00 PM", "Smarch 1, 2020", "Due 2024-13-01 or 1/2/2024", None]) == ["2027-07-01", "2021-03-04", "2020-09-05", None, "2024-01-02", None]
    problems = spark.createDataFrame([("2/30/2024",), ("soon",), ("on 1/2/2024",), ("1/2/2024",)], "raw string").select(checks.date(F.col("raw"))["problem"].alias("p")).collect()
    assert [r.p for r in problems] == ["impossible date", "unrecognized date", "text around the date ignored", None]
    assert values(spark, checks.gender, ["woman", "Non-Binary", "?"]) == ["F", "X", None] and values(spark, checks.money, [".", "1.2 thousand"]) == [None, "1200"]
    assert values(spark, checks.taxonomy, ["207Q00000X", "2O7Q00000X", "20"]) == ["207Q00000X", "207Q00000X", None]


def test_text_risks(spark):
    texts = ["aaaab", "ab " * 9, "no risk here", "seen 2/30/2024 and 1/2/2024", "70.23.22", "x" * 40 + "y" + "x" * 40 + "y", "12 34 O 56", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    c = F.col("t")
    got = d.select("i", T.has_character_run(c).alias("run"), T.repeats_tail(c).alias("tail"), T.impossible_date(c).alias("date"), T.repeats_suffix(c).alias("suffix"), T.letter_among_digits(c).alias("letter")).orderBy("i").collect()
    assert [r.run for r in got] == [True, False, False, False, False, True, False, None]
    assert [r.tail for r in got] == [False, True, False, False, False, False, False, None]
    assert [r.date for r in got] == [False, False, False, True, True, False, False, None]
    assert [r.letter for r in got[:-1]] == [False, False, False, False, False, False, True]
    assert got[5].suffix is False  # an exact half isn't a repeated suffix


def test_long_suffix_rule_agrees_with_the_plain_one():
    rng = random.Random(1)
    for _ in range(200):
        unit = "".join(rng.choice("ab") for _ in range(rng.randint(20, 60)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) + unit * rng.randint(1, 3)
        assert T._long_suffix(t) == any(t[-n:] == t[-2 * n : -n] for n in range(30, len(t) // 2))


def test_confidence(spark):
    r = spark.createDataFrame([(0.5, 0.9), (0.0, 0.1)], "t double, l double").select(confidence.calibrated(F.col("t"), F.col("l")).alias("p")).collect()
    assert 0 < r[1].p < r[0].p < 1
    g = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", None)], "k string, c double").groupBy("k").agg(confidence.noisy_or(F.col("c")).alias("c")).orderBy("k").collect()
    assert [x.c for x in g] == [0.75, None]


def test_geometry(spark):
    d = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0, 1.0, 1.0, 3.0, 3.0)], "a_left double, a_top double, a_right double, a_bottom double, b_left double, b_top double, b_right double, b_bottom double")
    a, b = geometry.box("a_"), geometry.box("b_")
    r = d.select(geometry.iou(a, b).alias("iou"), geometry.overlap_of_smaller(a, b).alias("o")).first()
    assert (round(r.iou, 6), r.o) == (round(1 / 7, 6), 0.25)


def test_orders_cover_each_region_once():
    rng = random.Random(2)
    for _ in range(50):
        boxes = [(x, y, x + rng.randint(5, 80), y + rng.randint(5, 40)) for x, y in ((rng.randint(0, 400), rng.randint(0, 600)) for _ in range(rng.randint(0, 25)))]
        for f in (layout.cut_order, layout.banded_order):
            assert sorted(f(boxes)) == list(range(len(boxes)))
        assert len(layout.text_lines(boxes)) == len(boxes)
    two_columns = [(0, 0, 40, 100), (60, 0, 100, 45), (60, 50, 100, 100), (0, 105, 40, 200)]
    assert layout.banded_order(two_columns) == [0, 1, 2, 3]
    assert layout.suppressed([(0, 0, 10, 10), (1, 0, 10, 10), (50, 50, 60, 60)], [0.5, 0.9, 0.1]) == [True, False, False]


def test_tables(spark):
    html = "<table><thead><tr><th rowspan=2>a<th>b</tr></thead><tr><td>c</tr><tr><td>d<td>e|f"
    assert [c[:5] for c in tables.grid_of_html(html)] == [(0, 0, 2, 1, "a"), (0, 1, 1, 1, "b"), (1, 1, 1, 1, "c"), (2, 0, 1, 1, "d"), (2, 1, 1, 1, "e|f")]
    assert tables.grid_of_pipes("| a | b |\n|---|---|\n| c \\| d | e |")[2] == (1, 0, 1, 1, "c | d", False)
    t = spark.createDataFrame([(1, html), (2, "<table><tr><td>x</tr><tr><td>y<td>z</tr></table>"), (3, None), (4, "<td colspan=500>")], "id int, html string")
    cells = tables.cells_of(t, "id", "html")
    got = {r.id: r.valid for r in tables.topology(cells, "id").collect()}
    assert got == {1: True, 2: False}
    plain = tables.cells_of(spark.createDataFrame([(1, "| a | b |\n|---|---|\n| c | d |")], "id int, md string"), "id", "md", tables.grid_of_pipes)
    assert tables.as_pipes(plain, "id").first().markdown == "| a | b |\n| --- | --- |\n| c | d |"
    pages = spark.createDataFrame([("d", 1, "t1", 0, 0, 3, "s"), ("d", 2, "t2", 0, 0, 3, "s"), ("d", 3, "t3", 0, 0, 3, None), ("d", 4, "t4", 0, 0, 2, None)], "document_id string, page_number int, table_id string, top int, left int, column_count int, signature string")
    assert {(r.table_id, r.next_id, r.head) for r in tables.stitched(pages).collect()} == {("t1", "t2", "t1"), ("t2", "t3", "t1")}


def test_consolidation(spark):
    rows = [("c", "name", "d1", 1, "Ann-Lee", 0.6), ("c", "name", "d2", 2, "ANN LEE", 0.5), ("c", "name", "d3", 3, "Bob", 0.9), ("c", "npi", "d1", 4, "1", None)]
    v = spark.createDataFrame(rows, "case_id string, key string, document_id string, position long, value string, confidence double")
    got = {r.key: r for r in consolidate.merged_values(v).collect()}
    assert (got["name"].value, got["name"].confidence, got["name"].alternatives, got["name"].problem) == ("Ann-Lee", 0.8, ["Bob"], "documents disagree")
    assert (got["npi"].confidence, got["npi"].problem) == (None, None)
    f = spark.createDataFrame([("k", 1 - i / 100, i != 22, i) for i in range(25)] + [("few", 0.5, True, 99)], "key string, confidence double, correct boolean, position long")
    t = {r.key: r.threshold for r in consolidate.thresholds(f).collect()}
    assert t["k"] == pytest.approx(0.76) and 0 < t["few"] < 1


def test_thresholds_against_a_plain_walk(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.random(), 0.5, 1.0, 0.0, -0.2, 1.7]), rng.random() < 0.93, i) for i in range(900)] + [("c", 0.9, True, 1000), ("d", None, True, 1001)]
    rows += [("e", 0.99 - i / 1000, i != 12, 2000 + i) for i in range(30)]

    def walk(some, whole):
        best, good = consolidate.DEFAULT_THRESHOLD, 0
        some = sorted(some, key=lambda r: (-r[1], r[3]))
        for n, r in enumerate(some, 1):
            good += r[2]
            if good / n >= consolidate.TARGET and not (whole and n < len(some) and some[n][1] == r[1]):
                best = r[1]
        return best

    known = [r for r in rows if r[1] is not None]
    overall, want = walk(known, True), {}
    for k in {r[0] for r in known}:
        mine = [r for r in known if r[0] == k]
        want[k] = (walk(mine, False) if len(mine) >= consolidate.LEAST_LABELS else overall, len(mine))
    f = spark.createDataFrame(rows, "key string, confidence double, correct boolean, position long")
    assert {r.key: (r.threshold, r.labels) for r in consolidate.thresholds(f).collect()} == want
    assert consolidate.thresholds(f.limit(0)).count() == 0


def test_quiet_documents_end(spark, tmp_path):
    # such a stream runs batches without data too, so its end can't be awaited
    columns, source = "document_id string, page_number int, payload string", str(tmp_path / "in")

    def add(*rows):
        spark.createDataFrame(list(rows), columns).coalesce(1).write.mode("append").parquet(source)

    def waits(*rows):
        until = time.time() + 40
        while sorted(tuple(r) for r in spark.table("quiet_pages").collect()) != sorted(rows):
            assert q.isActive and time.time() < until, spark.table("quiet_pages").collect()
            time.sleep(0.2)

    add(("d", 1, "a"), ("d", 4, "d"), ("d", 3, "c"))
    pages = ordered.ordered_pages(spark.readStream.schema(columns).parquet(source), "4 seconds")
    q = pages.writeStream.format("memory").queryName("quiet_pages").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        ended = [("d", 1, "a"), ("d", 3, "c"), ("d", 4, "d")]
        waits(*ended)
        add(("d", 1, "A"), ("d", 2, "b"))
        waits(*ended, ("d", 1, "A"), ("d", 2, "b"))
    finally:
        q.stop()


def test_streams(spark, tmp_path):
    pages = [("d", 2, "b"), ("d", 1, "a"), ("d", 4, "d"), ("d", 3, "c"), ("e", 2, "x")]
    for i in range(0, len(pages), 2):
        spark.createDataFrame(pages[i : i + 2], "document_id string, page_number int, payload string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("document_id string, page_number int, payload string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ordered.ordered_pages(stream).writeStream.format("memory").queryName("ordered_pages").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.document_id, r.page_number, r.payload) for r in spark.sql("SELECT * FROM ordered_pages").collect()] == [("d", 1, "a"), ("d", 2, "b"), ("d", 3, "c"), ("d", 4, "d")]


def same(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rows = [tuple(map(same, r)) for r in got.select(*columns).collect()]
    if name not in catalog.ORACLES:
        assert columns
        return
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    r = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = [tuple(same(x[names.index(c)]) for c in columns) for x in r.fetchall()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_flagship(spark):
    assert catalog.FLAGSHIP(spark, DIR).filter("route = 'review'").count() > 0
