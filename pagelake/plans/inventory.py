"""Queries of the scalar rules, and of the joins and checks of shown evidence.

``cases`` runs a column rule on inputs that the rows of ``part`` pick by number; its oracle states, in SQL, the outcome that the survey's
text gives for each input, worked out by hand. The other queries run on rows that both engines derive from the star tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelake.functions import alignment as A
from pagelake.functions import captions as C
from pagelake.functions import checks, confidence
from pagelake.functions import geometry as G
from pagelake.functions import regions as R
from pagelake.functions import text as T
from pagelake.operators import consolidate, matching, presentation, queues, review, tables
from pagelake.plans import evidence
from pagelake.plans.evidence import boxes, same_page
from pagelake.session import table
from pagelake.sources import readers, sinks

QUERIES, ORACLES = {}, {}
c = F.col


def _sql(value) -> str:
    if value is None:
        return "CAST(NULL AS VARCHAR)"
    return "'" + str(value).replace("'", "''") + "'"


def cases(name: str, rule, *rows):
    """rows: (inputs..., outcome); inputs of one place have one type. Outcomes are compared as text."""
    n = len(rows)
    inputs = list(zip(*(r[:-1] for r in rows)))

    def run(spark, sf_dir):
        pick = F.pmod(c("p_partkey"), F.lit(n)).cast("int")
        kinds = {str: "string", bool: "boolean", int: "int", float: "double", list: "array<string>", dict: "map<string,double>"}
        columns = []
        for values in inputs:
            kind = next((kinds[type(v)] for v in values if v is not None), "string")
            one = lambda v: F.lit(None) if v is None else F.create_map(*[F.lit(x) for kv in v.items() for x in kv]) if isinstance(v, dict) else F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
            columns.append(F.get(F.array(*[one(v).cast(kind) for v in values]), pick))
        rows_ = table(spark, sf_dir, "part").select("p_partkey", *[x.alias(f"i{k}") for k, x in enumerate(columns)])
        return rows_.select("p_partkey", rule(*[c(f"i{k}") for k in range(len(columns))]).cast("string").alias("outcome"))

    QUERIES[name] = run
    ORACLES[name] = "SELECT p_partkey, CASE p_partkey % " + str(n) + " " + " ".join(f"WHEN {i} THEN {_sql(r[-1])}" for i, r in enumerate(rows)) + " END AS outcome FROM part"


def value_problem(check):
    return lambda raw: F.concat_ws(" / ", F.coalesce(check(raw)["value"], F.lit("-")), check(raw)["problem"])


joined = lambda *xs: F.concat_ws(" | ", *xs)
names = lambda xs: F.array_join(xs, " | ")

# sources
cases("source_kinds", lambda p, h, n, one: joined(readers.source_kind(p), readers.sniffed_kind(F.unhex(h)), readers.document_format(readers.sniffed_kind(F.unhex(h)), n, one)),
    ("a/b.PDF", "255044462d31", 50, False, "pdf | pdf | digital_pdf"), ("x.pdf", "255044462d31", 49, False, "pdf | pdf | scanned_pdf"), ("x.tiff", "49492a0010", 0, False, "image | tiff | fax"),
    ("x.jpeg", "ffd8ffe0", 0, True, "image | jpeg | fax"), ("x.png", "89504e470d0a", 0, False, "image | png | image"), ("x.tar.gz", "1f8b", 0, False, "unsupported | unknown | image"))
cases("wingdings_text", readers.wingdings, ("¨ yes þ no", "Wingdings-Regular", "☐ yes ☑ ■□"), ("¨ yes", "Arial", "¨ yes"))
cases("balanced_braces", R.braces_balanced, (r"\frac{a}{b}", "true"), ("{a", "false"), ("}{", "false"), (r"\{a", "true"), ("", "true"))
cases("lines_repeat_at_end", R.repeated_lines_at_end, ("a\n" * 7 + "a", "true"), ("a\n" * 6 + "a", "false"), ("x\n" + "b\n" * 7 + "b", "true"), ("a\n" * 7 + "b", "false"))
# readings and confidence
cases("confidence_bands_of", confidence.band, (0.9, "high"), (0.8999, "medium"), (0.7, "medium"), (0.69, "low"), (0.0, "low"))
cases("gate_scores", lambda o, v, g, llm, ok, rep: F.format_string("%.4f", confidence.gate(o, v, g, llm, ok, rep)),
    (0.9, 0.8, 0.5, 0.9, True, False, "0.4000"), (0.95, 0.99, 1.0, 0.4, True, False, "0.7500"), (0.95, 0.99, 1.0, 0.9, False, False, "0.3000"), (0.95, 0.9, 1.0, 0.9, True, True, "0.7500"), (0.2, 0.9, 1.0, 0.9, False, True, "0.2000"))
cases("calibrates_or_not", C.calibrates, (0.5, 0.9, "text", 0, False, "true"), (None, 0.9, "text", 0, False, "false"), (0.5, None, "text", 0, False, "false"), (0.5, 0.9, "table", 0, False, "false"), (0.5, 0.9, "checkbox", None, None, "false"), (0.5, 0.9, "text", 1, False, "false"), (0.5, 0.9, "text", None, True, "false"), (0.5, 0.9, "title", None, None, "true"))
cases("shown_as", lambda k, r, b: C.presentation_kind(k, r, b), ("text", "table_cell", None, "table"), ("image", None, None, "figure"), ("text", "", "equation", "formula"), ("radio", None, None, "control"), ("Figure table", None, None, "table"), ("list-item", "x", "y", "text"))
cases("readers_of_regions", lambda r, m: C.read_by(r, m), (True, "pdf_text_layer", "reviewer"), (False, "qwen_crop_refinement", "llm"), (None, "pdf_text_layer", "text_layer"), (None, None, "ocr"), (False, "other", "ocr"))
cases("source_confidences", lambda k, d, r: C.source_confidence(k, d, r)["scope"], ("table", 0.5, 0.9, "table detection"), ("table", 1.5, 0.9, "source region"), ("text", 0.5, 0.9, "source region"), ("text", 0.5, None, None), ("table", None, None, None))
cases("why_evidence_only", lambda tr, lo, pdf, t, a, k: R.evidence_only(tr, lo, pdf, t, a, k), (True, True, False, "x", 100, "text", "truncated"), (False, True, False, "x", 100, "text", "looped"), (False, False, False, "abc d", 47, "text", "over_capacity"), (False, False, False, "abc d", 48, "text", None), (False, False, True, "abc d", 1, "text", None), (False, False, False, " ", 10, "text", "empty"), (False, False, False, "", 10, "figure", None))
cases("reasons_for_reviewers", lambda v, a, g, r, s, t: names(R.value_reasons(v, a, g, r, s, t)), (False, ["x"], 0.5, True, 0.1, 0.8, "validator failed | documents disagree | weak grounding | repaired"), (True, [], 0.9, False, None, 0.8, "not scored"), (True, [], 1.0, False, 0.79, 0.8, "low confidence"), (True, [], 1.0, False, 0.8, 0.8, ""), (True, ["x"], 1.0, False, 0.1, 0.8, "documents disagree"))
cases("field_states", R.field_state, (True, True, True, "conflicting"), (False, True, True, "illegible"), (False, False, True, "present"), (False, False, False, "not_located"))
cases("failure_severities", lambda n: R.failure_severity(n), (0, "error"), (None, "error"), (3, "warning"))
cases("held_back_regions", R.too_large_for_crop, (["likely_misread_text"], "text", "resolved", 0.16, "a", "true"), (["likely_misread_text"], "text", "resolved", 0.15, "a", "false"), (["second_reader_doubt"], "text", "resolved", 0.0, "a\n" * 9, "true"), (["visual_region"], "text", "resolved", 0.9, "a", "false"), (["second_reader_doubt"], "table", "resolved", 0.9, "a", "false"), ([], "text", "resolved", 0.9, "a", "false"), (["second_reader_doubt"], "text", "unreadable", 0.9, "a", "false"))
cases("shown_texts", R.display_text, ("checkbox", "Yes", "selected", "resolved", True, "[x] Yes"), ("checkbox", "No", "unselected", "resolved", True, "[ ] No"), ("checkbox", "Maybe", None, "resolved", True, "[?] Maybe"), ("checkbox", "☒ Old", None, "resolved", False, "☒"), ("text", "abc", None, "resolved", False, "abc"), ("text", "abc", None, "unreadable", False, ""), ("handwriting", "a", None, "conflicting", False, "[unreadable handwriting]"))
# strings
cases("folded_texts", lambda t: T.folded(t), ("  Ｓtraße  ﬁ\n", "strasse fi"), ("ABC", "abc"), (None, None), ("", ""))
cases("same_labels", R.same_label, ("Yes, I do", "yes", "true"), ("yes", "no", "false"), ("", "yes", "false"), ("a b", "a c", "false"), ("Part-A", "part a b", "true"))
cases("digit_boxes", R.joined_digit_boxes, ("id 1 2 3 4 5 end", "id 12345 end"), ("1 2 - 3 4 5", "12-345"), ("1 2 3", "1 2 3"), ("a1 2 3 4 5", "a1 2 3 4 5"))
cases("glued_captions", lambda t: R.split_caption(t)["value"], ("Name: Ann Lee", "Ann Lee"), ("First Name: Ann", "Ann"), ("Too many words: x", None), ("Name:", None))
cases("escaped_markdown", R.markdown_escaped, ("a & b <c>", "a &amp; b &lt;c&gt;"), ("*x* [y]", r"\*x\* \[y\]"), ("a|b#c", r"a\|b\#c"), ("plain", "plain"))
cases("agreed_readings", lambda a: A.agreed_reading(a), (["abcdefghij", "zzz", "abcdefghix"], "abcdefghix"), (["abc", "xyz"], None), (["same", "same", ""], "same"), ([], None))
cases("unread_words", A.unread, ("4021", "no. 40 21", "false"), ("4021", "no. 40 12", "true"), ("harvest", "harvst moon", "false"), ("harvest", "winter moon", "true"), ("sun", "winter", "false"), ("moonlight", "moon light", "false"), (None, "x", None), ("x", None, None))
cases("grounded_shares", lambda v, s: F.format_string("%.4f", A.grounding(v, s)), ("12-34", "id 1234 x", "1.0000"), ("abcd", "ab-xx", "0.5000"), ("", "abc", "0.0000"), ("abc", "", "0.0000"))
cases("top_classes", R.top_class, ({"a": 0.2, "b": 0.9}, "b"), ({"b": 0.5, "a": 0.5}, "a"), ({"z": 0.1}, "z"))
cases("dea_checks", value_problem(checks.dea), ("AB1234563", "AB1234563"), ("ab 1234563", "AB1234563"), ("AB1234560", "- / DEA check digit fails"), ("A1234563", "- / DEA must be 2 letters and 7 digits"))
cases("phone_checks", lambda r: checks.phone(r)["value"], ("(212) 555-0100", "(212) 555-0100"), ("1-212-555-0100 ext. 7", "(212) 555-0100 x7"), ("12125550100", "(212) 555-0100"), ("555", None), ("", None))
cases("state_checks", lambda r: checks.state(r)["value"], ("ny", "NY"), ("New York", "NY"), ("texas", "TX"), ("nowhere", None))
cases("taxonomy_checks", value_problem(checks.taxonomy), ("207Q00000X", "207Q00000X"), ("207q00000x", "207Q00000X"), ("20", "- / invalid taxonomy code"))
cases("gender_checks", lambda r: joined(F.coalesce(checks.gender(r)["value"], F.lit("-")), F.coalesce(checks.yes_no(r)["value"], F.lit("-"))), ("F", "F | -"), ("male", "M | -"), ("x", "X | Yes"), ("No", "- | No"), ("y", "- | Yes"), ("?", "- | -"))
cases("credential_checks", lambda r: checks.credential(r)["value"], ("m.d.", "MD"), ("(phd)", "PhD"), ("FNP-C", "FNP-C"), ("boss", None))
# captions and controls
cases("caption_kinds", lambda k, s, t: names(F.array_compact(F.array(F.when(C.inline_label(k, s, t), "inline"), F.when(C.colon_label(k, s, t), "colon"), F.when(C.grid_label(k, s, t), "grid"), F.when(C.self_contained(t), "whole")))),
    ("text", None, "FROM", "inline | grid"), ("text", None, "Date:", "inline | colon | grid"), ("text", None, "Room 12", ""), ("checkbox", None, "Date:", ""), ("text", "selected", "Date", ""), ("text", None, "Name: Ann Lee", "inline | grid | whole"),
    ("text", None, "This is a sentence.", ""), ("table", None, "Date:", ""), ("title", None, "Summary", "inline"), ("text", None, "one two three four five six seven:", "grid"), ("text", None, "a\nb", ""))
cases("entered_values", lambda k, t, h, l: joined(C.looks_filled(k, t, h, l).cast("string"), C.looks_entered(k, t, h, l).cast("string")), ("text", "acme", 16.0, 10.0, "true | true"), ("text", "acme", 15.9, 10.0, "false | false"), ("title", "acme", 1.0, 10.0, "true | true"), ("text", "A12", 1.0, 10.0, "false | true"), ("text", "ACMe", 1.0, 10.0, "false | true"), ("text", "ACme", 1.0, 10.0, "false | false"), ("title", "a b c d e f g h i", 90.0, 1.0, "false | false"))
cases("trailing_captions", C.trailing_caption, ("555-0147 Pages", "Pages"), ("555 pages", None), ("Pages", None), ("12 Re:", None), ("12 Fax:", "Fax"), ("a\nb Pages", None))
cases("checkbox_labels", C.checkbox_label, ("☐ Yes", "Yes"), ("## [x] Male", "Male"), ("O No", "No"), ("Female □", "Female"), ("Other", "Other"))
cases("decoded_controls", lambda t, k, s: F.when(C.decoded_control(t, k, s).isNotNull(), joined(C.decoded_control(t, k, s)["label"], C.decoded_control(t, k, s)["state"])), ("☐ Yes", "text", {"text": 0.9}, "Yes | unselected"), ("- [x] Yes", "list-item", {"text": 0.9}, "Yes | selected"), ("✓ done", "text", {"text": 0.9}, None), ("✓ done", "text", {"checkbox_selected": 0.95, "text": 0.1}, "done | selected"), ("☐ a ☐ b", "text", {"text": 0.1}, None), ("☐ Yes", "title", {"text": 0.1}, None), ("[?] Yes", "text", {"checkbox_selected": 1.0}, None), ("☐", "text", {"text": 0.1}, None))
cases("split_control_rows", lambda r, s: names(F.transform(C.split_controls(r, s, F.lit(0.0), F.length(r).cast("double")), lambda x: F.concat_ws(",", x["label"], x["state"], x["left"].cast("int").cast("string"), x["right"].cast("int").cast("string")))), ("□ R ☒ L", "unselected", "R,unselected,0,4 | L,selected,4,7"), ("pain □ R □ L", "selected", "pain,selected,0,5 | R,unselected,5,9 | L,unselected,9,12"), ("□ R", "unselected", ""), ("none", "selected", ""))
cases("plain_readings", lambda t, k: joined(C.plain_reading(t, k)["text"], C.plain_reading(t, k)["kind"]), ("## Part **one**", "text", "Part one | section-header"), ("plain", "title", "plain | title"), ("2 16 09", "text", "2/16/09 | text"), ("<table><tr><td>a</td></tr></table>", "table", "a | text"), ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>", "table", "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table> | table"))
cases("form_line_fields", lambda t: names(F.transform(C.form_fields(t), lambda f: F.concat_ws("=", f["label"], F.coalesce(f["value"], F.lit("?"))))), ("Name: Ann Lee  Date: 1/2/2024", "Name=Ann Lee | Date=1/2/2024"), ("Phone:", "Phone=?"), ("no field", ""), ("A: b", "A=b"))
cases("finished_crops", lambda t: names(C.finished_objects(t)), ('[{"a":1},{"b":"}"},{"c"', '{"a":1} | {"b":"}"}'), ("[", ""), ('[{"a":{"b":1}},', '{"b":1}'))
cases("stacked_table_parts", lambda t: names(F.transform(C.stacked_tables(t), lambda s: F.concat_ws("@", F.length(s["html"]).cast("string"), s["start"].cast("string")))), ("<table>a</table>\n<table>a</table>", "16@0 | 16@17"), ("<table>x", ""), ("ab<TABLE></TABLE>", "15@2"))
cases("nested_values", lambda d, p: C.nested(d, "$.a.b", "none"), ('{"a":{"b":"x"}}', "", "x"), ('{"a":{"b":null}}', "", "none"), ('{"a":1}', "", "none"), ("broken", "", "none"))
cases("address_parts", lambda r: joined(*[F.coalesce(C.us_address(r)[k], F.lit("-")) for k in ("street", "unit", "city", "state", "zip")]), ("12 Main St, Springfield, il 62704", "12 Main St | - | Springfield | IL | 62704"), ("9 Elm Ave Apt 4, Troy, NY 12180-0001", "9 Elm Ave | Apt 4 | Troy | NY | 12180-0001"), ("somewhere", "- | - | - | - | -"))
cases("plain_markdown", C.markdown_plain, ("# Title\n\n- **bold** `x`", "Title bold x"), ("[a](http://x) ![b](y)", "a b"), (r"1\. a &amp; b \*c\*", "1. a & b *c*"), ("> q\n2) w", "q w"))
cases("formula_signatures", C.formula_signature, (r"$\dfrac{a}{b}$", r"\frac a b"), (r"\left( x \right) ^ {2}", "( x ) ^ 2"), (r"\[ a\,b \]", "a b"), (r"x_{12}", "x _ { 1 2 }"), (r"\mathrm{d} x", "d x"))
cases("sanitised_texts", lambda t: C.sanitised(t, {"/tmp": "[temporary directory]", "/tmp/session": "[session]"}), ("at /tmp/session/a and /tmp/b", "at [session]/a and [temporary directory]/b"), ("none", "none"))
cases("fallback_cascade", lambda passed, sid, kind, role, res, ver, bt, cat, cells, uses: C.fallback_reason({"passed": passed, "source_id": sid, "source_kind": kind, "role": role, "resolved": res, "verified": ver, "block_type": bt, "category": cat, "cells": cells, "uses": uses, "linked": F.lit(False), "owned": F.lit(False), "claimed": F.lit(False)}),
    (False, "s", "text", "", True, False, "", "text", 0, 1, "validation_failed"), (True, None, "text", "", True, False, "", "text", 0, 1, "missing_source_region"), (True, "s", "control", "", True, False, "", "text", 0, 1, "control_evidence_is_authoritative"), (True, "s", "text", "form_source", True, False, "", "text", 0, 1, "source_is_not_renderable"),
    (True, "s", "text", "", False, False, "", "text", 0, 1, "source_evidence_unresolved"), (True, "s", "text", "", False, True, "form_row", "text", 0, 1, None), (True, "s", "text", "", True, False, "form_row", "text", 0, 1, "structured_source_is_authoritative"), (True, "s", "table", "", True, False, "", "table", 4, 1, "structured_source_is_authoritative"),
    (True, "s", "text", "", True, False, "", "table", 0, 1, "table_source_mismatch"), (True, "s", "table", "", True, False, "", "text", 0, 1, "table_source_mismatch"), (True, "s", "text", "", True, False, "", "text", 0, 2, "segmented_source_requires_canonical_rendering"), (True, "s", "text", "", True, False, "", "text", 0, 1, None))
cases("alignment_problems", lambda g, s, k, f: presentation.alignment_problem(g, s, k, f), ("a b c d", "a b c d", "text", False, None), ("☒ yes", "yes", "text", False, "adds_controls"), ("x" * 257, "x", "text", False, "too_long"), ("a 12", "a 13", "text", False, "changes_digits"), ("a b c", "a b c d e", "text", False, "drops_text"), ("a b c d", "a b c d e", "text", False, None), ("a b c d", "a b c d e", "table", True, "drops_text"), ("a", "a", "table", False, "changes_form"), ("a", "a", "formula", True, None))
cases("json_shapes", lambda t: presentation.shape_errors(t, {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "array", "items": {"type": "integer"}}, "b": {"enum": ["x"]}}}), ('{"a":[1]}', None), ('{"b":"x"}', "$ is missing a"), ('{"a":[1,"2"]}', "$.a[1] must be integer"), ('{"a":[],"c":1,"d":2}', "$ has unexpected c, d"), ('{"a":[],"b":"y"}', "$.b is not an allowed value"), ("[1]", "$ must be object"), ('{"a":[true]}', "$.a[0] must be integer"), ("{", "$ is not JSON"))
cases("table_problems", lambda t: presentation.table_problem(t), ("<table><tr><td>a</td><td>b</td></tr></table>", None), ("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>", None), ("<table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>", "not rectangular"), ("<table><tr><td><b>a</b></td></tr></table>", "disallowed element"), ("<table><tr><td onclick='x'>a</td></tr></table>", "disallowed attribute"), ("<table><tr><td>a", "malformed table"), ("<table>x<tr><td>a</td></tr></table>", "text outside cells"), ("<td>a</td>", "malformed table"))


# boxes
_PLACED = "SELECT l_orderkey, l_linenumber, l_partkey % 90 - 10 AS l, l_suppkey % 80 AS t, l_partkey % 90 + 5 + l_linenumber AS r, l_suppkey % 80 + 9 AS b, l_partkey % 4 AS turns FROM lineitem"


def _add(name: str, fixtures: dict[str, str], oracle: str):
    def add(f):
        f.__name__ = name
        before = dict(evidence.QUERIES), dict(evidence.ORACLES)
        evidence.query(fixtures, oracle)(f)
        QUERIES[name], ORACLES[name] = evidence.QUERIES[name], evidence.ORACLES[name]
        for held, old in zip((evidence.QUERIES, evidence.ORACLES), before):
            held.clear()
            held.update(old)
        return f

    return add


_CLAMPED = lambda by: " || ',' || ".join(f"least(greatest({x} {sign} {by}, 0), {most})" for x, sign, most in (("l", "-", 80), ("t", "-", 60), ("r", "+", 80), ("b", "+", 60)))


@_add("placed_boxes", {"x": _PLACED}, f"""SELECT l_orderkey, l_linenumber, {_CLAMPED(0)} AS clamped, {_CLAMPED(2)} AS padded, round(l / 80.0, 5)::DOUBLE AS shifted, CASE turns WHEN 1 THEN 60 - b WHEN 2 THEN 80 - r WHEN 3 THEN t ELSE l END AS turned,
CASE turns WHEN 3 THEN 60 - b WHEN 2 THEN 80 - r WHEN 1 THEN t ELSE l END AS back, (r - l) * (b - t) AS area, (l + 7) || ',' || (t + 9) AS moved, 2 * l - b + 1 AS hull FROM x""")
def _placed(x):
    b, w, h = G.box(), F.lit(80), F.lit(60)
    text = lambda xs: F.concat_ws(",", *[s.cast("string") for s in xs])
    hull = R.affine_hull(b, [F.lit(v) for v in (2.0, -1.0, 1.0, 0.0, 1.0, 0.0)])[0]
    shown = {"clamped": text(G.clamp(b, w, h)), "padded": text(G.pad(b, 2, w, h)), "shifted": G.normalised(b, w, h)[0], "turned": G.turned(b, w, h, c("turns"))[0], "back": G.turned_counterclockwise(b, w, h, c("turns"))[0], "area": G.area(b), "moved": text(G.moved(b, F.lit(7), F.lit(9))[:2]), "hull": hull}
    return x.select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in shown.items()])


@_add("orphan_words", {"w": boxes("word_id", "p_partkey % 3 = 0"), "g": boxes("region_id", "p_partkey % 3 = 1", step=41)}, f"SELECT w.word_id FROM w WHERE NOT EXISTS (SELECT 1 FROM g WHERE {same_page('w', 'g')} AND (w.l + w.r) / 2 BETWEEN g.l AND g.r AND (w.t + w.b) / 2 BETWEEN g.t AND g.b)")
def _orphans(w, g):
    at = w.select(*presentation.PAGE, "word_id", ((c("left") + c("right")) / 2).alias("x"), ((c("top") + c("bottom")) / 2).alias("y"))
    return G.points_in_boxes(at, g, presentation.PAGE, "left_anti").select("word_id")


@_add("cells_of_tables", {"w": boxes("cell_id", "p_partkey % 3 > 0"), "g": boxes("table_id", "p_partkey % 3 = 0", step=41)}, f"SELECT w.cell_id, g.table_id FROM w JOIN g ON {same_page('w', 'g')} AND (w.l + w.r) / 2 BETWEEN g.l AND g.r AND (w.t + w.b) / 2 BETWEEN g.t AND g.b")
def _cells(w, g):
    return presentation.cells_in_tables(w, g).select("cell_id", "table_id")


@_add("forms_with_controls", {"f": boxes("region_id", "p_partkey % 3 = 0"), "k": boxes("control_id", "p_partkey % 5 = 1", step=41)}, f"SELECT f.region_id FROM f WHERE EXISTS (SELECT 1 FROM k WHERE {same_page('f', 'k')} AND (k.l + k.r) / 2 BETWEEN f.l AND f.r AND (k.t + k.b) / 2 BETWEEN f.t AND f.b)")
def _forms(f, k):
    return matching.control_evidence(f, k).select("region_id")


@_add("same_controls", {"x": boxes("a_id", "p_partkey % 2 = 0", "p_brand AS label"), "y": boxes("b_id", "p_partkey % 2 = 1", "CASE WHEN p_size % 3 = 0 THEN upper(p_brand) ELSE p_name END AS label", 41)}, f"SELECT a_id, b_id FROM x JOIN y ON {same_page('x', 'y')} WHERE {evidence.inside('x', 'y')} >= 0.75 * least({evidence.area('x')}, {evidence.area('y')}) OR ({evidence.inside('x', 'y')} > 0 AND lower(x.label) = lower(y.label))")
def _controls(x, y):
    return matching.same_controls(x, y, "a_id", "b_id").select("a_id", "b_id")


@_add("placed_options", {"o": boxes("option_id", "p_partkey % 5 = 0"), "n": boxes("line_id", "p_partkey % 5 = 1", "p_partkey AS reading_order", 41)}, f"""SELECT option_id, line_id FROM (SELECT o.option_id, n.line_id, row_number() OVER (PARTITION BY o.option_id ORDER BY (o.l < n.r AND n.l < o.r) DESC, abs((o.t + o.b) - (n.t + n.b)), n.line_id) AS k FROM o JOIN n ON {same_page('o', 'n')}) WHERE k = 1""")
def _options(o, n):
    return matching.placed_order(o, n).select("option_id", "line_id")


@_add("contained_table_rows", {"x": boxes("table_id", "p_partkey % 2 = 0", "p_size % 4 AS a, p_size % 3 AS z")}, f"""SELECT table_id FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE {same_page('x', 'y')} AND x.table_id <> y.table_id AND {evidence.inside('x', 'y')} >= 0.999 * {evidence.area('x')} AND x.a IN (y.a, y.z) AND x.z IN (y.a, y.z)
AND NOT ({evidence.inside('x', 'y')} >= 0.999 * {evidence.area('y')} AND y.a IN (x.a, x.z) AND y.z IN (x.a, x.z) AND x.table_id < y.table_id))""")
def _contained(x):
    return matching.contained_tables(x.withColumn("values", F.array("a", "z"))).select("table_id")


@_add("outside_frames", {"f": boxes("region_id", "p_partkey % 2 = 0", "p_brand AS text"), "i": boxes("region_id", "p_partkey % 2 = 1", "upper(p_brand) AS text", 41)}, f"""SELECT region_id FROM f WHERE NOT ((l + r) / 2 BETWEEN 50 AND 120 AND (t + b) / 2 BETWEEN 40 AND 100) AND NOT EXISTS (SELECT 1 FROM i WHERE {same_page('f', 'i')} AND {evidence.smaller('f', 'i')} >= 0.5 AND lower(f.text) = lower(i.text))""")
def _outside(f, i):
    frame = f.select(*presentation.PAGE).distinct().select(*presentation.PAGE, *[F.lit(float(v)).alias(s) for s, v in zip(G.SIDES, (50, 40, 120, 100))])
    return matching.outside_frame(f, i, frame).select("region_id")


@_add("merged_separator_lines", {"s": "SELECT p_brand AS document_id, p_size % 5 AS page_number, p_partkey % 2 AS axis, CAST(p_partkey % 40 * 10 + p_partkey % 3 AS DOUBLE) AS position, CAST(p_partkey % 300 AS DOUBLE) AS low, CAST(p_partkey % 300 + 40 AS DOUBLE) AS high, CAST(1000 AS DOUBLE) AS extent FROM part"}, """, a AS (SELECT *, CASE WHEN position - lag(position) OVER w <= 4 THEN 0 ELSE 1 END AS f FROM s WINDOW w AS (PARTITION BY document_id, page_number, axis ORDER BY position, low, high)),
b AS (SELECT *, sum(f) OVER (PARTITION BY document_id, page_number, axis ORDER BY position, low, high ROWS UNBOUNDED PRECEDING) AS band FROM a), d AS (SELECT *, CASE WHEN low - max(high) OVER (PARTITION BY document_id, page_number, axis, band ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 10 THEN 0 ELSE 1 END AS g FROM b),
e AS (SELECT *, sum(g) OVER (PARTITION BY document_id, page_number, axis, band ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS part FROM d) SELECT document_id, page_number, axis, round(avg(position), 4) AS position, min(low) AS low, max(high) AS high, count(*) AS lines FROM e GROUP BY document_id, page_number, axis, band, part""")
def _separators(s):
    return presentation.merged_separators(s)


# records
@_add("evidence_rows", {"r": "SELECT o_custkey AS document_id, 1 AS page_number, o_orderkey + 1 AS other, o_orderkey AS value_id FROM orders", "g": "SELECT o_custkey AS document_id, 1 AS page_number, o_orderkey AS region_id, o_orderstatus AS text FROM orders"}, "SELECT r.value_id, g.region_id, g.text FROM r JOIN g ON g.document_id = r.document_id AND g.region_id IN (r.value_id, r.other)")
def _evidence(r, g):
    return presentation.with_evidence(r.withColumn("evidence_ids", F.array("value_id", "other")), g).select("value_id", "region_id", "text")


_SOURCES = "SELECT p_brand AS document_id, 1 AS page_number, p_partkey AS region_id, CASE p_partkey % 7 WHEN 0 THEN 'Text' WHEN 1 THEN 'page-header' WHEN 2 THEN 'table' WHEN 3 THEN 'title' WHEN 4 THEN 'figure' WHEN 5 THEN 'checkbox' ELSE 'paragraph' END AS kind, CASE p_size % 6 WHEN 0 THEN 'table_source' WHEN 1 THEN 'x_candidate' WHEN 2 THEN 'layout_block' ELSE '' END AS role, CASE WHEN p_size % 5 = 0 THEN ' ' ELSE p_name END AS text, CASE p_partkey % 9 WHEN 0 THEN 'unreadable' ELSE 'resolved' END AS resolution, CASE WHEN p_partkey % 11 < 3 THEN p_partkey - p_partkey % 11 END AS layout_owner_id, CAST(0 AS DOUBLE) AS l, CAST(0 AS DOUBLE) AS t, CAST(p_partkey % 4 AS DOUBLE) AS r, CAST(9 AS DOUBLE) AS b FROM part"
_CITED = "SELECT p_brand AS document_id, 1 AS page_number, p_partkey AS region_id FROM part WHERE p_partkey % 3 = 0"


@_add("eligible_regions", {"x": _SOURCES, "e": _CITED}, "SELECT region_id FROM x WHERE kind IN ('Text', 'page-header', 'title', 'paragraph') AND role NOT IN ('table_source', 'x_candidate', 'layout_block') AND trim(text) <> '' AND layout_owner_id IS NULL AND r > 0 AND region_id % 3 <> 0")
def _eligible(x, e):
    return presentation.eligible_sources(x, e).select("region_id")


@_add("rendered_regions", {"x": _SOURCES, "e": _CITED}, """SELECT region_id FROM x WHERE role <> 'table_source' AND (region_id % 3 = 0 OR resolution <> 'resolved' OR (kind = 'checkbox'))
AND (kind IN ('table', 'figure') OR NOT EXISTS (SELECT 1 FROM x y WHERE y.document_id = x.document_id AND y.role = 'layout_block' AND y.region_id = x.layout_owner_id))""")
def _rendered(x, e):
    return presentation.shown_regions(x, e).select("region_id")


@_add("documents_worth_reading", {"d": "SELECT o_orderkey AS document_id, o_orderpriority AS type, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS type_confidence FROM orders", "t": "SELECT DISTINCT o_orderpriority AS type, o_orderpriority >= '3' AS carries_data FROM orders"}, "SELECT document_id FROM d JOIN t ON d.type = t.type WHERE NOT (coalesce(type_confidence, '') = 'high' AND NOT carries_data)")
def _worth(d, t):
    return presentation.documents_to_read(d, t).select("document_id")


@_add("joined_label_sets", {"a": "SELECT p_partkey AS id, p_brand AS label FROM part", "z": "SELECT s_suppkey AS id, s_name AS name FROM supplier"}, "SELECT id, label, NULL AS name FROM a UNION ALL SELECT id, NULL, name FROM z")
def _sets(a, z):
    return presentation.concatenated([a, z])


@_add("fetch_results", {"x": "SELECT o_orderkey % 4 = 0 AS cached, CASE o_orderkey % 5 WHEN 1 THEN 'Timeout: 30 s' WHEN 2 THEN 'NotFound: x: y' END AS error FROM orders"}, "SELECT CASE WHEN cached THEN 'cached' WHEN error IS NULL THEN 'fetched' ELSE split_part(error, ':', 1) END AS outcome, count(*) AS n FROM x GROUP BY 1")
def _fetches(x):
    return presentation.fetch_outcomes(x)


@_add("evidence_risk_rows", {"x": "SELECT l_orderkey AS document_id, 1 AS page_number, CAST(l_linenumber AS STRING) AS region_id, l_linenumber AS reading_order, 'text' AS kind, 'resolved' AS resolution, l_tax FROM lineitem"}, """SELECT document_id, max(reading_order) + 1 AS reading_order, concat_ws(',', CASE WHEN bool_or(l_tax = 0) THEN 'a' END, CASE WHEN bool_or(l_tax = 0.08) THEN 'b' END) AS reasons FROM x GROUP BY document_id HAVING bool_or(l_tax = 0 OR l_tax = 0.08)""")
def _risk_rows(x):
    out = presentation.with_evidence_risks(x, F.when(c("l_tax") == 0, "a").when(c("l_tax") == 0.08, "b"))
    return out.filter("kind = 'coverage_risk'").select("document_id", "reading_order", F.array_join("reasons", ",").alias("reasons"))


_TICKET = "SELECT o_custkey AS case_id, CASE o_custkey % 2 WHEN 0 THEN 'group' ELSE 'practitioner' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'group.legal_name' WHEN 1 THEN 'group.dba_name' ELSE 'location' END AS key, CASE WHEN o_orderkey % 4 > 1 THEN 'service_location' END AS role, CAST(o_orderkey AS STRING) AS value, CASE WHEN o_orderkey % 3 = 0 THEN '555' END AS phone FROM orders"


@_add("group_tickets", {"x": _TICKET}, """, q AS (SELECT case_id, kind, bool_or(key = 'group.legal_name') AS legal, bool_or(key = 'group.dba_name') AS dba, coalesce(bool_or(key = 'location' AND phone IS NOT NULL), FALSE) AS phoned FROM x GROUP BY ALL)
SELECT case_id, 'location:' || value AS what FROM x WHERE kind = 'group' AND key = 'location' AND phone IS NULL UNION ALL SELECT case_id, 'location.service_location.phone' FROM q WHERE NOT phoned UNION ALL SELECT case_id, 'dba' FROM q WHERE kind = 'group' AND legal AND NOT dba""")
def _tickets(x):
    values, errors = presentation.group_requirements(x)
    added = values.exceptAll(x).select("case_id", F.lit("dba").alias("what"))
    return errors.select("case_id", c("value_id").alias("what")).unionByName(added)


@_add("joined_continuations", {"x": "SELECT l_orderkey AS document_id, l_linenumber AS page_number, CAST(l_linenumber AS STRING) AS region_id, CASE WHEN l_linenumber % 4 = 3 THEN 'text' ELSE 'table' END AS kind, l_shipdate AS at, l_returnflag AS text, l_tax AS confidence FROM lineitem", "k": "SELECT DISTINCT l_orderkey AS document_id, 'T' AS table_id, 'all' AS text, 0.5 AS score FROM lineitem WHERE l_orderkey % 2 = 0"},
    """, o AS (SELECT document_id, count(*) FILTER (WHERE page_number = 1) = 1 AND count(*) FILTER (WHERE page_number = 2) = 1 AS ok FROM x GROUP BY 1) SELECT x.document_id, CASE WHEN m AND page_number = 1 THEN 'T' ELSE region_id END AS region_id, CASE WHEN m AND page_number = 1 THEN 'all' ELSE text END AS text FROM (SELECT x.*, x.document_id % 2 = 0 AND o.ok AS m FROM x JOIN o ON x.document_id = o.document_id) x WHERE NOT (m AND page_number = 2)""")
def _continued(x, k):
    k = k.select("document_id", "table_id", "text", c("score").cast("double").alias("score"), F.array(F.lit(1), F.lit(2)).alias("source_pages"), F.array(F.lit("1"), F.lit("2")).alias("source_ids"))
    return presentation.merged_continuations(x.withColumn("confidence", c("confidence").cast("double")), k).select("document_id", "region_id", "text")


@_add("word_keeping_splits", {"a": "SELECT l_orderkey AS document_id, 1 AS page_number, l_returnflag AS word FROM lineitem", "z": "SELECT l_orderkey AS document_id, 1 AS page_number, l_returnflag AS word FROM lineitem WHERE l_quantity > 10"}, """, n AS (SELECT document_id, word, count(*) AS n FROM a GROUP BY ALL), m AS (SELECT document_id, word, count(*) AS m FROM z GROUP BY ALL) SELECT document_id FROM n LEFT JOIN m USING (document_id, word) GROUP BY document_id HAVING bool_and(n <= coalesce(m, 0))""")
def _splits(a, z):
    return presentation.kept_words(a, z).select("document_id")


@_add("required_of_cases", {"v": "SELECT o_custkey AS case_id, o_orderpriority AS key FROM orders", "k": "SELECT DISTINCT o_orderpriority AS key, o_orderpriority < '4' AS required, CAST(NULL AS STRING) AS d FROM orders"}, "SELECT DISTINCT c.case_id, k.key FROM (SELECT DISTINCT case_id FROM v) c, k WHERE k.required AND NOT EXISTS (SELECT 1 FROM v WHERE v.case_id = c.case_id AND v.key = k.key)")
def _required(v, k):
    return consolidate.missing_required(k.withColumnRenamed("d", "default"), v).select("case_id", "key")


@_add("document_requirements", {"d": "SELECT o_custkey AS case_id, o_orderpriority AS type FROM orders"}, ", s AS (SELECT case_id, list(type) AS types FROM d GROUP BY 1) SELECT case_id, '1-URGENT or 2-HIGH' AS missing FROM s WHERE NOT list_has_any(types, ['1-URGENT', '2-HIGH']) UNION ALL SELECT case_id, '5-LOW' FROM s WHERE NOT list_contains(types, '5-LOW')")
def _documents(d):
    spark = d.sparkSession
    rules = spark.createDataFrame([("g", ["1-URGENT", "2-HIGH"]), ("g", ["5-LOW"])], "kind string, any_of array<string>")
    return review.expected_documents(d.groupBy("case_id").agg(F.collect_set("type").alias("types")).withColumn("kind", F.lit("g")), rules)


@_add("case_events", {"e": "SELECT o_custkey AS case_id, o_orderpriority AS value_id, o_orderkey AS revision, o_orderstatus AS action, CAST(o_totalprice AS STRING) AS text FROM orders"}, "SELECT case_id, value_id, max(revision) AS revision, arg_max(action, revision) AS action FROM e GROUP BY ALL")
def _state(e):
    return consolidate.current_state(e).select("case_id", "value_id", "revision", "action")


@_add("polled_pages", {"p": "SELECT l_orderkey AS document_id, l_linenumber AS page_number FROM lineitem"}, "SELECT document_id, page_number FROM p WHERE page_number >= 4")
def _polled(p):
    return queues.pages_after(p, 4)


@_add("benchmark_layout", {"x": boxes("region_id", more="CASE p_size % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'noise' END AS kind")}, "SELECT region_id, CASE kind WHEN 'text' THEN 'Text' ELSE 'Table' END AS label, l AS x, t AS y, r - l AS w, b - t AS h FROM x WHERE kind <> 'noise'")
def _layout(x):
    labels = x.sparkSession.createDataFrame([("text", "Text"), ("table", "Table")], "kind string, label string")
    return sinks.benchmark_items(x, labels).select("region_id", "label", "x", "y", "w", "h")


@_add("page_doubts", {"x": "SELECT l_orderkey AS document_id, 1 AS page_number, l_linenumber AS region_id, l_linenumber AS reading_order, l_tax * 10 AS confidence, CASE l_returnflag WHEN 'R' THEN 'unreadable' WHEN 'A' THEN 'conflicting' ELSE 'resolved' END AS resolution, l_returnflag AS flag FROM lineitem"}, "SELECT document_id, round(avg(confidence), 6) AS mean, count(*) FILTER (WHERE resolution = 'conflicting') AS conflicting, list_extract(list(flag ORDER BY reading_order, flag), 1) AS first_reason FROM x GROUP BY document_id")
def _doubts(x):
    from pagelake.operators import evaluate

    out = evaluate.page_uncertainty(x.withColumn("reasons", F.array("flag")))
    return out.select("document_id", c("mean_confidence").alias("mean"), c("conflicting"), F.get("reasons", F.lit(0)).alias("first_reason"))


@_add("pipe_tables", {"x": "SELECT o_custkey AS k, max(o_orderkey) AS n FROM orders GROUP BY o_custkey"}, "SELECT k, CASE k % 3 WHEN 0 THEN '2x2' WHEN 1 THEN '3x1' ELSE NULL END AS shape FROM x")
def _pipes(x):
    text = F.when(c("k") % 3 == 0, "| a | b\\|c |\n|---|---|\n| 1 | 2 |").when(c("k") % 3 == 1, "| a |\n| --- |\n| 1 |\n| 2 |").otherwise("no table")
    cells = tables.cells_of(x.select("k", text.alias("text")), "k", "text", tables.grid_of_pipes)
    sizes = cells.groupBy("k").agg(F.concat_ws("x", (F.max("row") + 1).cast("string"), (F.max("col") + 1).cast("string")).alias("shape"))
    return x.select("k").join(sizes, "k", "left")
