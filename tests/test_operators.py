"""Region rules, alignments, page structures, sources, sinks and replays on literal rows, against plain restatements where there is one."""

import itertools
import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelake.functions import alignment as A
from pagelake.functions import geometry as G
from pagelake.functions import regions as R
from pagelake.operators import evaluate, layout, matching, presentation, queues, review
from pagelake.plans import evidence, text_risks
from pagelake.sources import readers, sinks


def one(spark, column, **values):
    names = list(values)
    return spark.range(1).select(*[F.lit(values[n]).alias(n) for n in names]).select(column.alias("x")).first().x


def words(rng, n, letters="ab c"):
    return "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j - 1] + (x != y), row[j] + 1, out[-1] + 1))
    return out


def test_best_span_is_the_least_of_all_spans():
    rng = random.Random(3)
    for _ in range(60):
        r, p = words(rng, 6), words(rng, 9)
        edits, start, end = A.best_span(r, p)
        every = [distance(r, p[i:j]) for i in range(len(p) + 1) for j in range(i, len(p) + 1)]
        assert edits == min(every) and distance(r, p[start:end]) == edits


def test_edit_counts_add_up_to_the_distance():
    rng = random.Random(4)
    for _ in range(100):
        p, r = words(rng, 9), words(rng, 9)
        ins, dele, sub = A.edits(p, r)
        assert ins + dele + sub == distance(p, r) and ins - dele == len(p) - len(r)


def test_assignment_and_alignment_against_all_choices():
    import numpy as np

    rng = random.Random(5)
    for _ in range(50):
        spans = [[s for s in range(4) if rng.random() < 0.4] for _ in range(4)]
        best = max(len({c for c in pick if c is not None}) if len([c for c in pick if c is not None]) == len({c for c in pick if c is not None}) else 0 for pick in itertools.product(*[[None, *s] for s in spans]))
        assert A.assigned(spans) == best
        s = np.array([[rng.random() for _ in range(3)] for _ in range(4)])
        pairs = A.monotone(s)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in itertools.pairwise(pairs))
        choices = (list(zip(i, j)) for n in range(4) for i in itertools.combinations(range(4), n) for j in itertools.combinations(range(3), n))
        most = max(sum(s[p] for p in c) for c in choices if all(s[p] >= 0.5 for p in c))
        assert sum(s[p] for p in pairs) == pytest.approx(most)


def test_arrow_rules(spark):
    d = spark.createDataFrame([("Missquri", "Missouri 12"), ("45", "Missouri 12"), ("table", "nothing here"), (None, "x")], "w string, t string")
    assert [r.u for r in d.select(A.unread("w", "t").alias("u")).collect()] == [False, True, True, None]
    assert [r.g for r in d.select(A.grounding("w", "t").alias("g")).collect()][1] == 0.0
    t = spark.createDataFrame([(["same text here", "same text hers", "other"],), ([],), (None,)], "a array<string>")
    assert [r.x for r in t.select(A.agreed_reading("a").alias("x")).collect()] == ["same text hers", None, None]
    cyc = spark.createDataFrame([([1, 2, 3] * 100,), (list(range(300)),), ([1, 2],)], "t array<int>")
    assert [r.x for r in cyc.select(A.decoder_cycle("t").alias("x")).collect()] == [True, False, False]
    h = spark.createDataFrame([("<table><tr><td>a</td></tr></table>",), ("<table><tr><td>a</tr></table>",), ("<table><tr><td>a</td></tr><tr><td>a</td><td>b</td></tr></table>",), ("no",), (None,)], "t string")
    assert [r.x for r in h.select(A.html_table_risk("t").alias("x")).collect()] == [None, "malformed_html_table", "non_rectangular_html_table", None, None]
    j = spark.createDataFrame([('ok ```json\n{"a": [1]}\n```',), ('[{"a": 1}, {"b": 2}, {"c"',), ("none",), (None,)], "t string")
    assert [r.x and json.loads(r.x) for r in j.select(A.first_json("t").alias("x")).collect()] == [{"a": [1]}, [{"a": 1}, {"b": 2}], None, None]
    p = spark.createDataFrame([(["ab", "cd", "zz"], ["a", "b c", "d"], [0.9, 0.5, 0.8])], "w array<string>, t array<string>, s array<double>")
    assert p.select(A.token_probabilities("w", "t", "s").alias("x")).first().x == [0.5, 0.5, None]
    c = spark.createDataFrame([("Ab-ß",), (None,)], "t string").select(A.compact("t").alias("x")).collect()
    assert (c[0].x.text, c[0].x.offsets, c[1].x.text) == ("abss", [0, 1, 3, 3], None)
    n = spark.createDataFrame([("DOE, JANE M RN",), ("Ann Lee (MD)",), ("Cher",), (" ",), (None,)], "t string").select(A.person_name("t").alias("x")).collect()
    assert [tuple(r.x) if r.x else None for r in n][:3] == [("Jane", "M", "Doe", "RN"), ("Ann", "", "Lee", "MD"), ("Cher", "", "", "")]


def test_region_rules(spark):
    c = F.col
    assert one(spark, R.boxed_date(c("t")), t="2 16 09") == "2/16/09" and one(spark, R.boxed_date(c("t")), t="13 16 09") == "13 16 09"
    assert one(spark, R.joined_digit_boxes(c("t")), t="id 1 2 - 3 4 5 6 end") == "id 12-3456 end"
    assert one(spark, R.same_label(c("a"), c("b")), a="Home phone", b="home") and not one(spark, R.same_label(c("a"), c("b")), a="Home", b="Work")
    assert tuple(one(spark, R.split_caption(c("t")), t="Date: 1 May")) == ("Date", "1 May") and one(spark, R.split_caption(c("t")), t="none") is None
    assert one(spark, R.credential(c("t"))["value"], t="(m.d.)") == "MD"
    assert one(spark, R.braces_balanced(c("t")), t=r"\frac{a}{b\}}") and not one(spark, R.braces_balanced(c("t")), t="}{")
    assert one(spark, R.repeated_lines_at_end(c("t")), t="\n".join(["x"] * 8)) and not one(spark, R.repeated_lines_at_end(c("t")), t="x")
    assert one(spark, R.markdown_escaped(c("t")), t="a*b & <c>") == r"a\*b &amp; &lt;c&gt;"
    assert one(spark, R.evidence_only(F.lit(False), F.lit(False), F.lit(False), c("t"), F.lit(20.0), F.lit("text")), t="abc") == "over_capacity"
    assert one(spark, R.display_text(F.lit("checkbox"), c("t"), F.lit("selected"), F.lit("resolved"), F.lit(True)), t="yes") == "[x] yes"
    spans = spark.createDataFrame([([0, 1],), ([0, 2],), ([1, 1],), ([],), (None,), ([3],)], "n array<int>")
    assert [r.x for r in spans.select(R.valid_span(c("n"), F.lit(3)).alias("x")).collect()] == [True, False, False, False, False, False]
    m = spark.createDataFrame([({"a": 0.2, "b": 0.7},), ({},)], "m map<string,double>")
    assert [r.x for r in m.select(R.top_class(c("m")).alias("x")).collect()] == ["b", None]
    box, crop = [F.lit(x) for x in (100, 200, 300, 400)], [F.lit(x) for x in (0, 0, 100, 200)]
    got = spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(R.grid_box(box, crop, F.lit(90)))]).first()
    assert tuple(got) == (60, 20, 80, 60)
    turned = spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(G.turned_counterclockwise([F.lit(x) for x in (1, 2, 3, 5)], F.lit(10), F.lit(20), F.lit(1)))]).first()
    assert tuple(turned) == (2, 7, 5, 9)
    alts = spark.createDataFrame([("A  b", "resolved", True, [("a B", "pending")], None), ("a", "resolved", True, [("c", "pending")], None), ("a", "resolved", False, [], None), ("a", None, None, None, None)], "text string, resolution string, agree boolean, alternatives array<struct<text:string,decision_state:string>>, cells array<struct<resolution:string>>")
    assert [r.x for r in alts.select(R.needs_review(c("resolution"), c("agree"), c("text"), c("alternatives"), c("cells")).alias("x")).collect()] == [False, True, True, True]


def test_overlapping_finds_each_pair_once(spark):
    rng = random.Random(6)
    rows = [("d", 1, i, x, y, x + rng.randint(1, 700), y + rng.randint(1, 700)) for i in range(40) for x, y in [(rng.randint(0, 900), rng.randint(0, 900))]]
    b = spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in rows], "document_id string, page_number int, k int, left double, top double, right double, bottom double")
    got = sorted((r.a_k, r.b_k) for r in matching.overlapping(b, b).collect())
    want = sorted((p[2], q[2]) for p in rows for q in rows if max(p[3], q[3]) <= min(p[5], q[5]) and max(p[4], q[4]) <= min(p[6], q[6]))
    assert got == want


def test_page_structures():
    assert layout.page_rows([(50, 0, 60, 10), (0, 2, 10, 12), (0, 30, 10, 40)], [0, 1, 2], 10) == [[1, 0], [2]]
    assert layout.spanning([(0, 0, 100, 10), (0, 0, 40, 10), (60, 0, 100, 10)]) == [True, False, False]
    assert layout.claimed([("a", 0, 0, 1, 1), ("a", 9, 9, 10, 10)], [("a", 8, 8, 9, 9), ("b", 0, 0, 1, 1)]) == [0, None]
    assert layout.owned_rows([(1, {1}), (3, {1, 2}), (2, {3})]) == [1, 2]
    assert layout.inline_runs([(0, 0, 10, 10, "text", True), (12, 0, 20, 10, "text", True), (12, 40, 20, 50, "text", True)]) == [0, 0, 1]
    assert layout.paragraphs([(0, 0, 50, 10), (0, 12, 50, 22), (0, 60, 50, 70)], [1, 2, 3]) == [1, 1, 2]
    pairs = [((x, y, x + 20, y + 20), (x * 2 + 100, y * 3, x * 2 + 140, y * 3 + 60)) for x, y in ((0, 0), (100, 50), (300, 200))]
    assert layout.registered(pairs, (0, 0, 100, 100)) == pytest.approx((2, 100, 3, 0)) and layout.registered(pairs[:2], (0, 0, 1, 1)) is None
    # a tall box does not bridge two bands
    assert layout.banded_order([(0, 0, 10, 10), (50, 0, 60, 200), (0, 90, 10, 100), (20, 90, 30, 100)])[:2] == [0, 1]


def test_sources(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.PDF").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "f/b.png").write_bytes(b"\x89PNG\r\n")
    (tmp_path / "f/c.txt").write_bytes(b"text")
    (tmp_path / "f/d.txt").write_bytes(b"")  # without bytes: no row
    got = {r.path[-5:]: (r.kind, r.sniffed) for r in readers.files(spark, str(tmp_path / "f")).collect()}
    assert got == {"a.PDF": ("pdf", "pdf"), "b.png": ("image", "png"), "c.txt": ("unsupported", "unknown")}
    head = "level page_num block_num par_num line_num word_num left top width height conf text".replace(" ", "\t")
    (tmp_path / "w.tsv").write_text(f"{head}\n5\t1\t1\t1\t1\t2\t10\t5\t20\t8\t91.5\t\"quoted\n5\t1\t1\t1\t1\t1\t0\t5\t8\t8\t-1\tfirst\n4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n")
    w = readers.tesseract_words(spark, str(tmp_path / "w.tsv"), "d", 3).orderBy("reading_order").collect()
    assert [(r.region_id, r.text, r.confidence, r.right, r.bottom) for r in w] == [("p3-word-1", "first", None, 8, 13), ("p3-word-2", '"quoted', 0.915, 30, 13)]
    (tmp_path / "x.jsonl").write_text('{"image": "a", "text": "t"}\n{"image": "b"}\nnot json\n')
    good, bad = readers.json_lines(spark, str(tmp_path / "x.jsonl"), "image string, text string", ("image", "text"))
    assert (good.count(), bad.count()) == (1, 2)
    raw = spark.createDataFrame([('{"cells": [1]}',), ("{broken",)], "t string")
    assert [r.failure for r in readers.service_payloads(raw, "t", "cells array<int>").collect()] == [None, "malformed"]
    cells = spark.createDataFrame([("d", 1, "x" * 60, 0.01), ("d", 2, "short", 0.0), ("d", 3, "y" * 60, 0.2)], "document_id string, page_number int, text string, bitmap_share double")
    assert [r.page_number for r in readers.text_layer(cells).collect()] == [1]
    chars = [("d", 1, i, c, float(x), 0.0) for i, (c, x) in enumerate(zip("abc d", (0, 5, 10, 15, 20)))]
    assert readers.reading_direction(spark.createDataFrame(chars, "document_id string, page_number int, position int, char string, x double, y double")).first().turns == 0
    assert readers.glyph_lines([("a", 0, 0, 8, 8), ("a", 0.5, 0, 8.5, 8), ("b", 9, 0, 17, 8), ("c", 0, 12, 8, 20)]) == [1, None, 1, 2]


def test_sinks(spark, tmp_path):
    values = spark.createDataFrame([("c", "k", "v")], "case_id string, key string, value string")
    none = spark.createDataFrame([], "case_id string, code string")
    audit = spark.createDataFrame([("c", 2, "b"), ("c", 1, "a")], "case_id string, ts int, action string")
    bundle = json.loads(sinks.case_bundles(values, none, audit).first().bundle)
    assert [a["action"] for a in bundle["audit"]] == ["a", "b"] and bundle["exceptions"] == []
    catalog = spark.createDataFrame([("k", "s", None), ("m", "s", "0")], "key string, section string, default string")
    assert json.loads(sinks.client_fields(values, catalog).first().fields) == {"k": "v", "m": "0"}
    sinks.write_metrics(values, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).first().value == "v"


def test_review_and_replays(spark):
    r = spark.createDataFrame([("d", 1, "p1-runtime-risk", "text", 1, ["a"]), ("d", 1, "y", "text", 2, ["b", "a"]), ("d", 2, "z", "text", 1, None)], "document_id string, page_number int, region_id string, kind string, reading_order int, reasons array<string>")
    new = review.with_risk_rows(r).filter("kind = 'coverage_risk'").collect()
    assert [(x.page_number, x.region_id, x.reading_order, x.reasons, x.source_ids) for x in new] == [(1, "p1-runtime-risk-2", 3, ["a", "b"], ["p1-runtime-risk", "y"])]
    v = spark.range(500).select((F.col("id") % 20).alias("case_id"), F.col("id").alias("value_id"), F.lit("quick_verify").alias("route"), F.lit("pending").alias("state"), F.lit("reading").alias("source"))
    drawn = {x.case_id: x.n for x in review.audit_sample(v).groupBy("case_id").agg(F.count_if("audit_sample").alias("n")).collect()}
    assert len(drawn) == 20 and min(drawn.values()) >= 1
    a = spark.createDataFrame([("g", 1, 0.0, 10.0), ("g", 2, 1.0, 10.0), ("g", 3, 2.0, 10.0), ("g", 4, 10.0, 1.0)], "gate string, id int, at double, seconds double")
    assert [x.admitted for x in queues.admissions(a, 2).orderBy("id").collect()] == [True, True, False, True]
    c = spark.createDataFrame([("c", i, float(i), k, 5) for i, k in enumerate("abacb")], "cache string, id int, at double, key string, size int")
    assert [(x.hit, x.evicted) for x in queues.cache_replay(c, 10, 100.0).orderBy("id").collect()] == [(False, 0), (False, 0), (True, 0), (False, 1), (False, 1)]
    g = spark.createDataFrame([(1, 1, 7, 0.9), (1, 1, 8, 0.9), (1, 2, 7, 1.0)], "group int, target int, candidate int, score double")
    assert [(x.target, x.candidate) for x in evaluate.greedy_tables(g).orderBy("target").collect()] == [(1, 7)]
    rows = [("d", 1, "a", "text", 1, {"LATIN": 5}, False, "resolved"), ("d", 1, "b", "text", 2, {"CJK": 1}, False, "resolved"), ("d", 1, "c", "text", 3, {"CJK": 1}, True, "resolved")]
    s = spark.createDataFrame(rows, "document_id string, page_number int, region_id string, kind string, reading_order int, scripts map<string,int>, from_pdf boolean, resolution string")
    assert {x.region_id: x.resolution for x in evaluate.foreign_scripts(s).collect()} == {"a": "resolved", "b": "conflicting", "c": "resolved"}


def test_replays_go_on_from_batch_to_batch(spark):
    """The state must outlast Arrow's batches, and null keys are one log."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", None, "b"]), i, float(rng.randint(0, 300)), rng.choice("xyzw"), rng.randint(1, 6)) for i in range(400)]

    def plain(log):
        held, out = [], {}
        for _, i, at, k, size in sorted(log, key=lambda r: (r[2], r[1])):
            old = [h for h in held if h[0] == k]
            hit = bool(old) and at - old[0][1] <= 20
            held = [h for h in held if h[0] != k] + (old if hit else [(k, at, size)])
            n = len(held)
            while sum(h[2] for h in held) > 9:
                held = held[1:]
            out[i] = (hit, n - len(held))
        return out

    want = {}
    for key in ("a", None, "b"):
        want |= plain([r for r in rows if r[0] == key])
    log = spark.createDataFrame(rows, "cache string, id int, at double, key string, size int")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {r.id: (r.hit, r.evicted) for r in queues.cache_replay(log, 9, 20.0).collect()} == want
        assert queues.cache_replay(log.limit(0), 9, 20.0).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_stages_and_arrangement(spark):
    from pagelake.operators import stages

    schema = "document_id string, page_number int, region_id string, kind string, role string, text string, resolution string, confidence double, reading_order int, child_ids array<string>, left double, top double, right double, bottom double"
    rows = [
        ("d", 1, "block", "text", "layout_block", "", "resolved", 0.9, 1, ["low"], 0.0, 0.0, 200.0, 200.0),
        ("d", 1, "low", "text", "", "one two three four", "resolved", 0.9, 2, None, 0.0, 50.0, 90.0, 60.0),
        ("d", 1, "again", "text", "", "two three", "resolved", 0.9, 3, None, 0.0, 50.0, 80.0, 60.0),
        ("d", 1, "high", "text", "", "first", "resolved", 0.9, 4, None, 0.0, 0.0, 90.0, 10.0),
        ("d", 1, "speck", "text", "", ".", "resolved", 0.1, 5, None, 0.0, 80.0, 9.0, 90.0),
        ("d", 2, "b", "text", "", "no box here", "resolved", 0.9, 2, None, None, None, None, None),
        ("d", 2, "a", "text", "", "a box here", "resolved", 0.9, 1, None, 0.0, 90.0, 9.0, 99.0),
    ]
    r = spark.createDataFrame(rows, schema)
    got = {(x.page_number, x.region_id): x["rank"] for x in stages.arranged(r).collect()}
    assert got == {(1, "high"): 1, (1, "low"): 2, (2, "a"): 1, (2, "b"): 2}
    steps = [("upper", lambda d: d.withColumn("text", F.upper("text"))), ("broken", lambda d: d.select("nowhere")), ("drop", lambda d: d.filter("region_id <> 'speck'"))]
    out, done, failed = stages.run_stages(r, steps)
    assert out.count() == 6 and [n for n, _ in failed] == ["broken"]
    assert {(x.stage, x.page_number): (x.added, x.removed, x.modified) for x in done.collect()} == {("upper", 1): (0, 0, 3), ("upper", 2): (0, 0, 2), ("drop", 1): (0, 1, 0), ("drop", 2): (0, 0, 0)}
    blocks = spark.createDataFrame([("d", 1, "k", ["low", "high"])], "document_id string, page_number int, block_id string, child_ids array<string>")
    assert stages.owned(r, blocks).filter("layout_owner_id = 'k'").count() == 2
    hull = stages.citations(r.filter("page_number = 1").withColumn("value_id", F.lit(1))).first()
    assert (hull.left, hull.bottom) == (0.0, 200.0)


def test_edit_distances_are_of_whole_texts_of_all_turns(spark, tmp_path):
    long = "the same words at the start of both turns, well over sixty characters, then "
    turns = [("a", 1, long + "one end"), ("a", 2, long + "another end"), ("a", 3, "zwölf Bücher\nnaïve €"), ("a", 4, "zwolf Bücher\nnaive 𝄞"), ("a", 5, ""), ("b", 1, ""), ("b", 2, ""), ("b", 3, None), ("b", 4, "x"), ("c", 1, "alone")]
    spark.createDataFrame(turns, "conv_id string, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.turn): (r.distance, r.share) for r in text_risks.edit_distance_of_turns(spark, str(tmp_path)).collect()}
    want = {}
    for (c, _, p), (k, turn, s) in itertools.pairwise(turns):
        if c == k and p is not None and s is not None and (p or s):
            want[k, turn] = (distance(p, s), round(distance(p, s) / max(len(p), len(s)), 6))
    assert got == want


def test_snippets_of_any_length_are_found(spark, tmp_path):
    docs = [(0, "one two three four five six seven eightfold nine"), (1, "twotwo three four five sixth"), (2, "one  two\nthree four"), (3, ""), (4, None), (5, "x"), (6, "prefix one two three four five six seven eight nine ten")]
    texts = ["", "one", "ne two", "two three", "o three four five six", "one two three four five six seven", "two three four five six seven eight", "one two three four five six seven eight", "two\nthree", " two three ", "x", "absent", "ix seven eight", None]
    rng = random.Random(4)
    docs += [(10 + i, " ".join(rng.choice(["a", "ab", "abc", "b"]) for _ in range(rng.randint(1, 12)))) for i in range(30)]
    for _ in range(60):
        t = rng.choice(docs[7:])[1]
        at = rng.randrange(len(t))
        texts.append(t[at : rng.randint(at, len(t))])
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(tuple(r) for r in text_risks.snippet_recovery(spark, str(tmp_path)).select("item_id", "doc_id").collect())
    assert got == sorted((i, k) for i, p in enumerate(texts) for k, d in docs if p is not None and d is not None and p in d)


def test_consensus_is_over_all_readers(spark):
    rng = random.Random(3)
    rows = [(rng.choice("kl"), rng.randint(0, 12), rng.choice(["abc", "abd", "xyz", "", None])) for _ in range(60)] + [("one", 1, "abc"), ("one", 1, "abd"), ("k", None, "abc")]
    got = {(r.line, r.reader): r.disagreement for r in evaluate.consensus(spark.createDataFrame(rows, "line string, reader int, text string"), "line").collect()}
    want = {}
    for k, a in {(k, r) for k, r, _ in rows if r is not None}:
        pairs = [(x, y) for j, r, x in rows for i, q, y in rows if j == i == k and r == a and q is not None and q != a]
        d = [distance(x, y) / max(len(x), len(y), 1) for x, y in pairs if x is not None and y is not None]
        if pairs:
            want[k, a] = pytest.approx(sum(d) / len(d), abs=2e-6) if d else None
    assert got == want
    base = "/root/testdata/sf0.001"
    readers_ = spark.read.parquet(base + "/customer.parquet").groupBy("c_nationkey").count().filter("count > 1").agg(F.sum("count")).first()[0]
    assert evidence.QUERIES["reader_consensus"](spark, base).count() == readers_


def test_undirected_pairs_are_of_all_lines(spark):
    base = "/root/testdata/sf0.001"
    lines = {(r.l_suppkey, r.l_partkey) for r in spark.read.parquet(base + "/lineitem.parquet").select("l_suppkey", "l_partkey").collect()}
    labels = {r.p_partkey for r in spark.read.parquet(base + "/part.parquet").select("p_partkey").collect()}
    both = {(a, b) for a, b in lines} | {(b, a) for a, b in lines}
    want = {}
    for a, b in both:
        if b in labels:
            want[a] = want.get(a, 0) + 1
    assert {r.id: r.partners for r in evidence.QUERIES["undirected_pairs"](spark, base).collect()} == want


def test_alignments_and_coverage_are_of_whole_texts(spark, tmp_path):
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))
    passages = [prose(30) for _ in range(3)]
    wrong = list(passages[1])
    for i in (70, 90, 110):
        wrong[i] = "#"
    turns = [(0, 1, prose(60) + " " + passages[0] + " " + prose(9)), (1, 1, prose(60) + " " + "".join(wrong)), (2, 1, prose(80))]
    for c in range(3):
        turns += [(c, 2, prose(40) + "\n" + prose(3)), (c, 3, turns[c][2][100:400]), (c, 4, prose(50) + " " + turns[c][2][200:350])]
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.item_id: r for r in evidence.QUERIES["reading_alignments"](spark, str(tmp_path)).collect()}
    assert [got[0].span_edits, got[0].grounding, got[1].span_edits] == [0, 1.0, 3]
    for i, p in enumerate(passages):
        assert got[i].insertions + got[i].deletions + got[i].substitutions == distance(p, turns[i][2])
        assert got[i].insertions - got[i].deletions == len(turns[i][2]) - len(p)
    words_of = lambda t: re.findall(r"\w+", t.lower())
    texts = {(c, n): t for c, n, t in turns}
    texts = {(c, n): texts[c, n - 1] + "\n" + t if n % 2 == 0 else t for (c, n), t in texts.items()}
    want = set()
    for (c, n), t in texts.items():
        for k, line in enumerate(t.split("\n")):
            mine = words_of(line)
            over = [(-len(words_of(o)), m) for (d, m), o in texts.items() if d == c and m != n and len(words_of(o)) > len(mine) >= 2 and (Counter(mine) & Counter(words_of(o))).total() >= 0.8 * len(mine)]
            if over:
                want.add((c, n, k, min(over)[1]))
    assert {tuple(r) for r in evidence.QUERIES["covering_regions"](spark, str(tmp_path)).collect()} == want and want


def test_edits_of_whole_turns_against_a_plain_distance(spark, tmp_path):
    rows = [(1, 1, "user", "héllo wörld " * 9), (1, 2, "user", "hello world " * 9 + "\n"), (1, 3, "user", ""), (2, 1, "user", "a")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.distance for r in text_risks.edit_distance_of_turns(spark, str(tmp_path)).collect()}
    assert got == {(c, t): distance(rows[i][3], rows[i - 1][3]) for i, (c, t, *_) in enumerate(rows) if t > 1}


def test_bands_rows_and_cuts_against_plain_sweeps():
    rng = random.Random(21)

    def sweep(boxes, ids, axis, gap):
        out, reach = [], None
        for i in sorted(ids, key=lambda i: boxes[i][axis]):
            if reach is None or boxes[i][axis] - reach >= gap:
                out.append(set())
            out[-1].add(i)
            reach = boxes[i][axis + 2] if reach is None else max(reach, boxes[i][axis + 2])
        return out

    for _ in range(60):
        boxes = [(x, y, x + rng.randint(3, 60), y + rng.randint(4, 12)) for x, y in ((rng.randint(0, 200), rng.randint(0, 200)) for _ in range(rng.randint(1, 20)))]
        n = len(boxes)
        heights = sorted(b[3] - b[1] for b in boxes)
        height = (heights[(n - 1) // 2] + heights[n // 2]) / 2
        order = layout.banded_order(boxes)
        place = {i: k for k, i in enumerate(order)}
        assert sorted(order) == list(range(n)) == sorted(layout.cut_order(boxes))
        for first, second in itertools.combinations(sweep(boxes, range(n), 1, 0.4 * height), 2):
            assert max(place[i] for i in first) < min(place[i] for i in second)
        rows = layout.page_rows(boxes, range(n), height)
        assert sorted(i for r in rows for i in r) == list(range(n))
        left = set(range(n))
        for seed in sorted(range(n), key=lambda i: (boxes[i][1], i)):
            if seed in left:
                a = boxes[seed]
                near = {i for i in left if min(a[3], boxes[i][3]) - max(a[1], boxes[i][1]) >= 0.5 * min(a[3] - a[1], boxes[i][3] - boxes[i][1])} | {seed}
                near = {seed} if a[3] - a[1] > 3 * height else {i for i in near if i == seed or boxes[i][3] - boxes[i][1] <= 3 * height}
                assert near in [set(r) for r in rows]
                left -= near
    assert layout.cut_order([(5, 0, 9, 9), (0, 0, 6, 9)]) == [0, 1]  # no gap: as given


def test_pages_in_one_pass(spark):
    rows = [(d, 1, i, float((i * 37) % 50), float((i * 53) % 60), float((i * 37) % 50 + 9), float((i * 53) % 60 + 4)) for d in range(40) for i in range(1 + d % 7)]
    d = spark.createDataFrame(rows, "document_id int, page_number int, region_id int, left double, top double, right double, bottom double")
    got = {(r.document_id, r.region_id): (r.cut_rank, r.banded_rank, r.line) for r in layout.with_orders(d.repartition(3)).collect()}
    assert len(got) == len(rows)
    for doc in range(40):
        boxes = [r[3:] for r in rows if r[0] == doc]
        for rank, i in enumerate(layout.cut_order(boxes), 1):
            assert got[doc, i][0] == rank
        for rank, i in enumerate(layout.banded_order(boxes), 1):
            assert got[doc, i][1] == rank
        assert [got[doc, i][2] for i in range(len(boxes))] == layout.text_lines(boxes)
    assert layout.with_orders(d.filter("false")).count() == 0


def test_phrases_against_the_plain_rule(spark):
    rng = random.Random(22)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(200)] + ["x y z " * 3, "x x x x", None, "Go on. Go on! go on"]

    def plain(t):
        w = re.findall(r"\w+", t.lower())
        return any(w[i : i + n] == w[i + n : i + 2 * n] == w[i + 2 * n : i + 3 * n] and len(set(w[i : i + n])) > 1 for n in range(2, 33) for i in range(len(w) - 3 * n + 1))

    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    from pagelake.functions import text as T

    assert [r.p for r in d.select("i", T.repeats_phrase(F.col("t")).alias("p")).orderBy("i").collect()] == [None if t is None else plain(t) for t in texts]


def test_pairs_owners_lines_and_block_types(spark):
    rows = [("inline", "text", "FROM", (0, 0, 30, 10)), (None, "text", "ACME", (40, -4, 90, 14)), ("colon", "text", "Name:", (0, 40, 30, 50)), (None, "text", "Ann", (0, 55, 30, 65)), (None, "text", "Lee", (2, 70, 30, 80)), ("inline", "text", "Fax", (0, 100, 30, 110)), (None, "text", "small", (40, 100, 60, 110))]
    assert presentation.pairs_on_page(rows, 200) == [None, 0, None, 2, 2, None, None]
    boxes = [(0, 0, 100, 100), (10, 10, 50, 50), (20, 20, 30, 30), (60, 60, 120, 90)]
    assert presentation.image_owners(boxes, [False] * 4) == [None, 0, 0, None]
    assert presentation.image_owners(boxes, [False, True, False, False]) == [None, 0, 1, None]
    assert presentation.spatial_lines([(0, 0, 9, 10), (20, 2, 29, 12), (0, 20, 9, 30), (40, 6, 49, 16)]) == [1, 1, 3, 2]
    page = [("d", 1, i, k, None, t, 200.0, *map(float, b)) for i, (_, k, t, b) in enumerate(rows)]
    d = spark.createDataFrame(page, "document_id string, page_number int, region_id long, kind string, state string, text string, page_width double, left double, top double, right double, bottom double")
    assert {r.region_id: r.label_id for r in presentation.with_pairs(d).collect() if r.label_id is not None} == {1: 0, 3: 2, 4: 2}
    typed = [("GRAND TOTAL", 10, 30), ("a = b + c", 50, 60), ("ann@x.org", 70, 80), ("plain words here", 90, 100), ("1 see there", 196, 200), ("SECOND PART", 110, 120), ("more plain words", 130, 140)]
    b = spark.createDataFrame([("d", 1, i, "line", t, 0.0, float(a), 50.0, float(z), 200.0, False) for i, (t, a, z) in enumerate(typed)], "document_id string, page_number int, block_id int, block_type string, text string, left double, top double, right double, bottom double, page_height double, learned boolean")
    assert [r.block_type for r in presentation.with_block_types(b).orderBy("block_id").collect()] == ["title", "formula", "author", "line", "footnote", "heading", "line"]


def test_layout_service_and_routing_table(spark, tmp_path):
    reply = {"document_id": "d", "page_number": 1, "elements": [{"category": "doc_title", "text": "# Big **one**", "score": 0.9, "token_score": 0.5, "box": [0, 0, 9, 9]}, {"category": "table", "text": "<table><tr><td>a</td></tr></table>", "score": 0.9, "token_score": 0.5, "box": [0, 9, 9, 19]}, {"category": "x", "text": "no box"}]}
    (tmp_path / "a.json").write_text(json.dumps(reply) + "\nbroken\n")
    got = presentation.layout_service_regions(spark, f"{tmp_path}/a.json").orderBy("reading_order").collect()
    assert [(r.kind, r.text, r.left, r.bottom) for r in got] == [("title", "Big one", 0, 9), ("text", "a", 0, 19)]
    assert got[0].confidence == pytest.approx(1 / (1 + 2.718281828459045 ** -(7.93 * -0.6931471805599453 + 1.787 * 0.9 + 1.197)))
    (tmp_path / "t.csv").write_text("arm,accepted,review\na,40,1\na,0,41\n")
    row = presentation.routing_table(spark, f"{tmp_path}/t.csv").first()
    assert (row.total, row.share) == (82, round(40 / 82, 4))
