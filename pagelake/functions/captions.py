"""Captions, controls and display rules of regions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of printed boxes, those that are nothing else, and those that are ticked.
MARK = r"\[[xX ?]\]|[☐☑☒✓✔✗✘□■]"
SURE_MARKS = ("[x]", "[ ]", "☐", "☑", "☒", "□")
TICKED = ("[x]", "☑", "☒", "✓", "✔", "✗", "✘", "■")
SURE_MARK = r"\[[xX ]\]|[☐☑☒□]"
# Limits of captions and of what is written beside them.
CAPTION_WORDS, CAPTION_CHARS, COLON_WORDS, GRID_WORDS, VALUE_WORDS, TALLER, CAPITALS = 3, 24, 6, 8, 8, 1.6, 0.7
CONTROLS, HEADINGS = ("checkbox", "radio"), ("title", "section-header", "page-header")


def _text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def is_control(kind: Column, state: Column) -> Column:
    return F.coalesce(kind.isin(*CONTROLS), F.lit(False)) | state.isNotNull()


def inline_label(kind: Column, state: Column, text: Column) -> Column:
    """A short printed caption on one line: up to three words of letters, no digit."""
    t = _text(text)
    w = _words(F.regexp_replace(t, r"[:.]+$", ""))
    short = (t != "") & ~F.contains(t, F.lit("\n")) & (F.length(t) <= CAPTION_CHARS) & ~t.rlike(r"\p{Nd}")
    return ~is_control(kind, state) & ~kind.isin("table", "figure", "formula", "list-item") & short & F.size(w).between(1, CAPTION_WORDS) & F.forall(w, lambda x: x.rlike(r"\p{L}"))


def colon_label(kind: Column, state: Column, text: Column) -> Column:
    t = _text(text)
    return ~is_control(kind, state) & (kind != "table") & (t != "") & ~F.contains(t, F.lit("\n")) & t.endswith(":") & (F.size(_words(t)) <= COLON_WORDS)


def grid_label(kind: Column, state: Column, text: Column) -> Column:
    """A caption over a box of a form: one line of up to eight words, no sentence and no digit."""
    t = _text(text)
    return ~is_control(kind, state) & ~kind.isin("table", "figure", *HEADINGS) & (t != "") & ~F.contains(t, F.lit("\n")) & ~t.rlike(r"[.!?]$") & (F.size(_words(t)) <= GRID_WORDS) & ~t.rlike(r"\p{Nd}")


def self_contained(text: Column) -> Column:
    """The first line already holds a caption and its value."""
    return F.element_at(F.split(_text(text), "\n"), 1).rlike(r"^[^:]{1,40}:\s+\S")


def looks_filled(kind: Column, text: Column, height: Column, label_height: Column) -> Column:
    """Written into the form: at most eight words, taller than its caption by 1.6 or set as a heading."""
    return (F.size(_words(_text(text))) <= VALUE_WORDS) & ((height >= TALLER * label_height) | kind.isin("section-header", "title"))


def looks_entered(kind: Column, text: Column, height: Column, label_height: Column) -> Column:
    """Filled, or with a digit, or mostly capitals."""
    t = _text(text)
    letters, upper = F.length(F.regexp_replace(t, r"\P{L}", "")), F.length(F.regexp_replace(t, r"\P{Lu}", ""))
    return looks_filled(kind, text, height, label_height) | t.rlike(r"\p{Nd}") | ((letters >= 3) & (upper >= CAPITALS * letters))


def trailing_caption(text: Column) -> Column:
    """The last word of a line, if it may be the caption of what follows; else null."""
    t = _text(text)
    w = _words(t)
    last = F.regexp_replace(F.try_element_at(w, F.lit(-1)), r"[:.]+$", "")
    return F.when((F.size(w) >= 2) & ~F.contains(t, F.lit("\n")) & last.rlike(r"^\p{Lu}\p{L}{2,11}$"), last)


def checkbox_label(text: Column) -> Column:
    """A control's label without heading marks, box marks at either end, or a circle read as the letter O."""
    t = F.regexp_replace(_text(text), r"^#{1,6}\s+", "")
    t = F.regexp_replace(F.regexp_replace(t, rf"^(?:{MARK})\s*", ""), r"^[Oo]\s+(?=\S)", "")
    return F.trim(F.regexp_replace(t, rf"\s*(?:{MARK})$", ""))


def _ticked(mark: Column) -> Column:
    return F.when(F.lower(mark).isin(*TICKED), "selected").otherwise("unselected")


def decoded_control(text: Column, kind: Column, scores: Column) -> Column:
    """struct<label, state, glyph> of a line that is a control after all: one mark, at its start, with a label. A mark that may be a bullet
    counts only where the detector's class scores (a map) favour a control over a list or text. Else null."""
    marks = F.regexp_extract_all(text, F.lit(MARK), F.lit(0))
    glyph = F.regexp_extract(text, rf"^(?:[-*+]\s+)?({MARK})", 1)
    label = F.trim(F.regexp_replace(text, rf"^(?:[-*+]\s+)?(?:{MARK})", ""))
    score = lambda *names: F.greatest(*[F.coalesce(F.try_element_at(scores, F.lit(n)), F.lit(0.0)) for n in names])
    seen = F.coalesce(score("checkbox_selected", "checkbox_unselected") > score("list_item", "text"), F.lit(False))
    ok = kind.isin("text", "list-item") & (F.size(marks) == 1) & (glyph != "") & (glyph != "[?]") & (label != "") & (F.lower(glyph).isin(*SURE_MARKS) | seen)
    return F.when(ok, F.struct(label.alias("label"), _ticked(glyph).alias("state"), glyph.alias("glyph")))


def split_controls(raw: Column, state: Column, left: Column, right: Column) -> Column:
    """array<struct<label, state, left, right>>: one for each sure mark of a merged control's reading, with its share of the width by
    characters; a label before the first mark keeps the detector's state. Empty if there are not two marks."""
    parts = F.filter(F.split(raw, f"(?={SURE_MARK})"), lambda p: p != "")
    width, size = right - left, F.length(raw)
    spans = F.transform(parts, lambda p, i: F.struct(p.alias("part"), F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, q: a + F.length(q)).alias("start")))
    one = lambda s: F.struct(
        checkbox_label(s["part"]).alias("label"), F.when(s["part"].rlike(f"^(?:{SURE_MARK})"), _ticked(F.regexp_extract(s["part"], f"^({SURE_MARK})", 1))).otherwise(state).alias("state"),
        (left + width * s["start"] / size).alias("left"), (left + width * (s["start"] + F.length(s["part"])) / size).alias("right"),
    )
    marks = F.size(F.regexp_extract_all(raw, F.lit(SURE_MARK), F.lit(0)))
    return F.when(marks >= 2, F.filter(F.transform(spans, one), lambda c: c["label"] != "")).otherwise(F.array().cast("array<struct<label:string,state:string,left:double,right:double>>"))


def presentation_kind(*names: Column) -> Column:
    """What a region is shown as, by the words of its kind, role and block type; tables first."""
    v = F.lower(F.concat_ws(" ", *names))
    cascade = F.when(F.contains(v, F.lit("table")), "table")
    for kind, words in (("figure", "figure|image"), ("formula", "formula|equation"), ("control", "checkbox|radio|control")):
        cascade = cascade.when(v.rlike(words), kind)
    return cascade.otherwise("text")


def calibrates(token: Column, layout: Column, kind: Column, retries: Column, orphan: Column) -> Column:
    """Whether a reading's scores may be calibrated: both are there, it is no table or control, was read once and by layout."""
    return token.isNotNull() & layout.isNotNull() & ~kind.isin("table", "checkbox") & (F.coalesce(retries, F.lit(0)) == 0) & ~F.coalesce(orphan, F.lit(False))


def read_by(reviewed: Column, method: Column) -> Column:
    return F.when(F.coalesce(reviewed, F.lit(False)), "reviewer").when(method == "qwen_crop_refinement", "llm").when(method == "pdf_text_layer", "text_layer").otherwise("ocr")


def source_confidence(kind: Column, detection: Column, recognition: Column) -> Column:
    """struct<value, kind, scope> that is shown for a source: a table's detection score, else the recognition score, else null."""
    named = lambda v, k, s: F.struct(v.alias("value"), F.lit(k).alias("kind"), F.lit(s).alias("scope"))
    return F.when((kind == "table") & detection.between(0, 1), named(detection, "Detection score", "table detection")).when(recognition.isNotNull(), named(recognition, "Recognition score", "source region"))


def sanitised(text: Column, roots: dict[str, str]) -> Column:
    """Text or JSON with private folders replaced by what stands for them, longest first."""
    for root in sorted(roots, key=lambda r: (-len(r), r)):
        text = F.replace(text, F.lit(root), F.lit(roots[root]))
    return text


def same_control(label: Column, box, other: Column, other_box) -> Column:
    """Three quarters of the smaller box in common, or any overlap and the same label."""
    from pagelake.functions import geometry as G

    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    inside = G.intersection(box, other_box)
    return (inside >= 0.75 * F.least(G.area(box), G.area(other_box))) | ((inside > 0) & (plain(label) == plain(other)))


def fallback_reason(c: dict[str, Column]) -> Column:
    """Why a generated block gives way to its source, first match wins; null if it stands. c: passed, source_id, source_kind, role,
    linked (a label of a control), owned (by a layout block of the page), resolved, verified, block_type, category, cells, uses, claimed."""
    yes = lambda n: F.coalesce(c[n], F.lit(False))
    kept = yes("resolved") & (c["block_type"].isin("form_row", "spatial_row") | ((c["category"] == "table") & (c["cells"] > 0)))
    mixed = (c["category"] == "table") != (c["source_kind"] == "table")
    return (
        F.when(~yes("passed"), "validation_failed").when(c["source_id"].isNull(), "missing_source_region")
        .when(yes("linked") | (c["source_kind"] == "control"), "control_evidence_is_authoritative")
        .when(c["role"].isin("coverage_risk", "table_candidate", "table_source", "figure_source", "form_source"), "source_is_not_renderable")
        .when(yes("owned"), "source_is_owned_by_layout").when(~yes("resolved") & ~yes("verified"), "source_evidence_unresolved")
        .when(kept, "structured_source_is_authoritative").when(mixed, "table_source_mismatch")
        .when(c["uses"] > 1, "segmented_source_requires_canonical_rendering").when(yes("claimed"), "source_already_claimed")
    )


def plain_reading(text: Column, kind: Column) -> Column:
    """struct<text, kind>: heading marks and emphasis go, a marked heading is one; a table of fewer than two filled rows or columns is
    text; separate date boxes are one date."""
    from pagelake.functions.regions import boxed_date

    t = F.trim(text)
    marked = t.rlike(r"^#{1,6}\s+\S")
    rows = F.filter(F.regexp_extract_all(t, F.lit(r"(?is)<tr[^>]*>.*?</tr>"), F.lit(0)), lambda r: F.trim(F.regexp_replace(r, "<[^>]*>", " ")) != "")
    columns = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(F.filter(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda x: F.trim(x) != "")))), F.lit(0))
    table = (F.size(rows) >= 2) & (columns >= 2)
    bare = F.regexp_replace(F.regexp_replace(t, r"^#{1,6}\s+", ""), r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", "$2")
    cells = F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"\s+", " "))
    html = F.contains(F.lower(t), F.lit("<table"))
    out = F.when(html & table, t).when(html, cells).otherwise(boxed_date(bare))
    return F.struct(out.alias("text"), F.when(html & table, "table").when(kind == "table", "text").when(marked & (kind == "text"), "section-header").otherwise(kind).alias("kind"))


def form_fields(line: Column) -> Column:
    """array<struct<label, value>> of a form line: captions of up to forty characters before colons, each with what follows to the next."""
    shape = r"([^:\s][^:]{0,39}?):\s*(.*?)(?=\s{2,}[^:\s][^:]{0,39}?:|$)"
    pick = lambda i: F.regexp_extract_all(line, F.lit(shape), F.lit(i))
    return F.zip_with(pick(1), pick(2), lambda a, v: F.struct(F.trim(a).alias("label"), F.when(F.trim(v) != "", F.trim(v)).alias("value")))


def finished_objects(partial: Column) -> Column:
    """The complete objects, without inner ones, of a JSON array that is still arriving."""
    return F.regexp_extract_all(partial, F.lit(r'\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}'), F.lit(0))


def stacked_tables(html: Column) -> Column:
    """array<struct<html, start>>: the tables of a reading that holds several one after another, with the character each begins at."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))
    at = F.aggregate(found, F.struct(F.lit(1).alias("from"), F.array().cast("array<struct<html:string,start:int>>").alias("out")), lambda a, t: F.struct((F.position(t, html, a["from"]) + F.length(t)).alias("from"), F.array_append(a["out"], F.struct(t.alias("html"), (F.position(t, html, a["from"]) - 1).alias("start"))).alias("out")))
    return at["out"]


def nested(document: Column, path: str, default: str) -> Column:
    """The text at a JSON path, the default where it is missing or null."""
    return F.coalesce(F.get_json_object(document, path), F.lit(default))


def us_address(raw: Column) -> Column:
    """struct<street, unit, city, state, zip> of an address on one line by its commas; null for other shapes."""
    shape = r"^\s*(\d+\S*\s[^,]*?)(?:,?\s+((?:apt|suite|ste|unit|#)\.?\s*\S+))?\s*,\s*([^,]+?)\s*,\s*([A-Za-z]{2})\s+(\d{5}(?:-\d{4})?)\s*$"
    part = lambda i: F.nullif(F.regexp_extract(raw, f"(?i){shape}", i), F.lit(""))
    return F.when(raw.rlike(f"(?i){shape}"), F.struct(part(1).alias("street"), part(2).alias("unit"), part(3).alias("city"), F.upper(part(4)).alias("state"), part(5).alias("zip")))


def markdown_plain(text: Column) -> Column:
    """Markdown as the text it shows: links and images by their words, without heading, list, quote, code and emphasis marks; escapes undone."""
    steps = ((r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^\s{0,3}(?:#{1,6}\s+|>\s?|[-*+]\s+|\d+[.)]\s+)", ""), (r"(?m)^\s*(?:```|~~~).*$", ""), (r"`([^`]*)`", "$1"), (r"(?<!\\)(\*\*|__|\*|~~)(?=\S)(.+?)(?<=[^\s\\])\1", "$2"), (r"\\([\\`*_{}\[\]()#+\-.!|~>])", "$1"), (r"\s+", " "))
    for shape, to in steps:
        text = F.regexp_replace(text, shape, to)
    for mark, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(to))
    return F.trim(text)


def formula_signature(formula: Column) -> Column:
    """A LaTeX formula's tokens in one form: no spacing, size or style commands, no delimiters around it, fractions by one name, single
    tokens without braces."""
    t = F.regexp_replace(F.trim(formula), r"^(?:\\\[|\\\(|\$\$?)|(?:\\\]|\\\)|\$\$?)$", "")
    t = F.regexp_replace(t, r"\\(?:left|right|big|Big|bigg|Bigg|displaystyle|textstyle|limits|nolimits|quad|qquad)(?![A-Za-z])|\\[,;:! ]|~", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\\[dt]frac(?![A-Za-z])", r"\\frac"), r"\\(?:mathrm|text|operatorname)(?![A-Za-z])", "")
    t = F.regexp_replace(t, r"\{\s*(\\[A-Za-z]+|[^\\{}\s])\s*\}", " $1 ")
    return F.array_join(F.regexp_extract_all(t, F.lit(r"\\[A-Za-z]+|\\.|\S"), F.lit(0)), " ")
