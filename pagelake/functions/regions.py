"""Column rules over regions: kinds, display, doubts and placements.

A region is a row of document_id, page_number, region_id, kind, role, text, confidence, left, top, right, bottom, reading_order,
resolution and the provenance columns that a rule names. Every rule is a column expression, so it fuses into the scan's stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of the layout categories.
KINDS = {
    "page_text": "page_text", "table": "table", "formula": "formula", "doc_title": "title", "title": "title", "paragraph_title": "section-header",
    "section-header": "section-header", "page-header": "page-header", "page-footer": "page-footer", "header": "page-header", "footer": "page-footer",
    "footnote": "footnote", "vision_footnote": "footnote", "caption": "caption", "figure_title": "caption", "list-item": "list-item", "algorithm": "code", "code": "code",
}
# The reasons of a doubtful reading, first match wins.
RETRIED, UNLIKELY, SECOND_READER, MIXED = "sampled_retry_read", "likely_misread_text", "second_reader_doubt", "letter_among_digits"
# Limits of the rules.
GLYPH_AREA, SPECK_CONFIDENCE, SPECK_CHARS, CROP_SHARE, CROP_LINES = 12, 0.3, 2, 0.15, 8
# Credentials in their canonical form.
CREDENTIALS = ("MD", "DO", "NP", "PA", "PA-C", "APRN", "FNP", "FNP-C", "CNM", "CRNA", "DPM", "DC", "OD", "DDS", "DMD", "PhD", "PsyD", "LCSW", "LPC", "LMFT", "RN", "PT", "OT", "SLP", "AuD", "RD")


def kind_of(category: Column) -> Column:
    """The kind of a layout category; an unknown one is text."""
    pairs = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, category), F.lit("text"))


def semantic_kind(kind: Column, role: Column, block_type: Column) -> Column:
    """What a region means, by the words of its kind and role; a layout block says so itself."""
    v = F.lower(F.concat_ws(" ", kind, role))
    has = lambda *words: F.array_contains(F.transform(F.array(*map(F.lit, words)), lambda w: F.contains(v, w)), True)
    cascade = F.when((role == "layout_block") & (F.coalesce(block_type, F.lit("")) != ""), F.lower(block_type))
    cascade = cascade.when((F.contains(v, F.lit("section")) & F.contains(v, F.lit("head"))) | has("heading"), "heading")
    for name, words in (("footer", ["footer"]), ("title", ["title"]), ("header", ["header"]), ("table", ["table"]), ("list", ["list"]), ("figure", ["figure", "image"]), ("control", ["checkbox", "radio", "control"]), ("field", ["form", "field"]), ("handwriting", ["handwrit"])):
        cascade = cascade.when(has(*words), name)
    return cascade.otherwise("text")


def boxed_date(text: Column) -> Column:
    """Month, day and year in separate boxes as one date; anything else stays."""
    shape = r"^(\d{1,2})[\s|]+(\d{1,2})[\s|]+(\d{4}|\d{2})$"
    part = lambda i: F.regexp_extract(text, shape, i)
    ok = text.rlike(shape) & part(1).try_cast("int").between(1, 12) & part(2).try_cast("int").between(1, 31)
    return F.when(ok, F.concat_ws("/", part(1), part(2), part(3))).otherwise(text)


def display_text(kind: Column, text: Column, state: Column, resolution: Column, native: Column) -> Column:
    """Controls of the engine's own detector show their mark and label, others only the mark they begin with; what isn't resolved is
    blank, handwriting says that it can't be read."""
    mark = F.when(state == "selected", "[x]").when(state == "unselected", "[ ]").otherwise("[?]")
    label = F.when(resolution == "resolved", text).otherwise("[unresolved text]")
    control = F.when(native, F.trim(F.concat_ws(" ", mark, label))).otherwise(F.regexp_extract(text, "^(\\[[x ?]\\]|[☐☑☒])", 1))
    return F.when(kind == "checkbox", control).when(resolution == "resolved", text).when(kind == "handwriting", "[unreadable handwriting]").otherwise("")


def evidence_only(truncated: Column, looped: Column, from_text_layer: Column, text: Column, area: Column, kind: Column) -> Column:
    """Why a reading is evidence rather than a claim; null if it is a claim."""
    glyphs = F.length(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"\s", ""))
    empty = (F.trim(F.coalesce(text, F.lit(""))) == "") & ~kind.isin("checkbox", "figure", "picture")
    return F.when(truncated, "truncated").when(looped, "looped").when(~from_text_layer & (glyphs * GLYPH_AREA > area), "over_capacity").when(empty, "empty")


def misread_reason(retries: Column, calibrated: Column, confidence: Column, least_word: Column, unread: Column, mixed: Column) -> Column:
    """The first doubt that holds: a sampled retry, an unlikely reading, the second reader, a letter among digits; nulls don't doubt."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(retries > 0), RETRIED).when(yes(calibrated & (confidence < 0.5)), UNLIKELY).when(yes(least_word < 0.5) | yes(unread > 0), SECOND_READER).when(yes(calibrated & mixed), MIXED)


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def open_alternative(text: Column, alternatives: Column) -> Column:
    """A pending alternative with other text, or one in an unknown state."""
    return F.coalesce(F.exists(alternatives, lambda a: ~a["decision_state"].isin("pending", "accepted", "rejected", "superseded") | ((a["decision_state"] == "pending") & (_plain(a["text"]) != _plain(text)))), F.lit(False))


def needs_review(resolution: Column, agreement: Column, text: Column, alternatives: Column, cells: Column) -> Column:
    """A region not resolved, disagreed on, with an open alternative or a cell not resolved."""
    cell = F.coalesce(F.exists(cells, lambda c: F.coalesce(c["resolution"] != "resolved", F.lit(True))), F.lit(False))
    return F.coalesce(resolution != "resolved", F.lit(True)) | F.coalesce(~agreement, F.lit(False)) | cell | open_alternative(text, alternatives)


def suppression_reason(kind: Column, role: Column, text: Column, resolution: Column, has_image: Column, has_children: Column) -> Column:
    """Why a region isn't shown; null if it is. ``has_children``: one of its children is on the page."""
    blank = (F.trim(F.coalesce(text, F.lit(""))) == "") & ~F.coalesce(has_image, F.lit(False))
    cascade = F.when(F.coalesce(role.endswith("_source"), F.lit(False)) | kind.isin("coverage_risk", "word"), "not_content")
    cascade = cascade.when(((role == "layout_block") | kind.isin("form", "key-value-region")) & F.coalesce(has_children, F.lit(False)), "layout_container")
    return cascade.when(blank & (kind == "figure") & (F.coalesce(resolution, F.lit("resolved")) == "resolved"), "empty_graphic").when(blank & ((kind == "figure") | (resolution == "unreadable")), "no_text")


def junk_speck(kind: Column, resolution: Column, method: Column, confidence: Column, text: Column) -> Column:
    """A resolved reading of one or two characters with little confidence, no control and not re-read."""
    return F.coalesce((kind != "checkbox") & (resolution == "resolved") & (F.coalesce(method, F.lit("")) != "crop_refinement") & (confidence < SPECK_CONFIDENCE) & (F.length(F.trim(F.coalesce(text, F.lit("")))) <= SPECK_CHARS), F.lit(False))


def too_large_for_crop(reasons: Column, kind: Column, resolution: Column, share: Column, text: Column) -> Column:
    """A resolved region that only doubts would send, too large to send."""
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    only = F.size(F.array_except(reasons, F.array(*map(F.lit, (RETRIED, UNLIKELY, SECOND_READER, MIXED))))) == 0
    return only & (F.size(reasons) > 0) & (kind != "table") & (resolution == "resolved") & ((share > CROP_SHARE) | (lines > CROP_LINES))


def failure_severity(regions: Column) -> Column:
    return F.when(F.coalesce(regions, F.lit(0)) == 0, "error").otherwise("warning")


def field_state(conflicting: Column, illegible: Column, present: Column) -> Column:
    """The state of a form field from what its regions say (bool_or columns)."""
    return F.when(conflicting, "conflicting").when(illegible, "illegible").when(present, "present").otherwise("not_located")


def value_reasons(valid: Column, alternatives: Column, grounding: Column, repaired: Column, confidence: Column, threshold: Column) -> Column:
    """What a reviewer is told, in order; without such a reason, a missing or low confidence."""
    first = F.array_compact(F.array(F.when(~valid, "validator failed"), F.when(F.size(alternatives) > 0, "documents disagree"), F.when(grounding < 0.9, "weak grounding"), F.when(repaired, "repaired")))
    last = F.array_compact(F.array(F.when(confidence.isNull(), "not scored"), F.when(confidence < threshold, "low confidence")))
    return F.when(F.size(first) > 0, first).otherwise(last)


def grid_box(box, crop, degrees: Column) -> list[Column]:
    """A box on a grid of 0 to 1000 over a crop (left, top, right, bottom) that was shown turned by 0, 90, 180 or 270 degrees, in the
    page's pixels."""
    l, t, r, b = box  # noqa: E741
    forms = {90: (1000 - b, l, 1000 - t, r), 180: (1000 - r, 1000 - b, 1000 - l, 1000 - t), 270: (t, 1000 - r, b, 1000 - l)}
    turned = [F.when(degrees == 90, forms[90][i]).when(degrees == 180, forms[180][i]).when(degrees == 270, forms[270][i]).otherwise((l, t, r, b)[i]) for i in range(4)]
    return [F.bround(crop[i % 2] + turned[i] * (crop[i % 2 + 2] - crop[i % 2]) / 1000.0).cast("int") for i in range(4)]


def affine_hull(box, m) -> list[Column]:
    """The whole-pixel hull of a box's corners under x' = m0 x + m1 y + m2, y' = m3 x + m4 y + m5."""
    corners = [(box[i], box[j]) for i in (0, 2) for j in (1, 3)]
    xs = [m[0] * x + m[1] * y + m[2] for x, y in corners]
    ys = [m[3] * x + m[4] * y + m[5] for x, y in corners]
    return [F.floor(F.least(*xs)), F.floor(F.least(*ys)), F.ceil(F.greatest(*xs)), F.ceil(F.greatest(*ys))]


def same_label(a: Column, b: Column) -> Column:
    """One label's words begin with all of the other's."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    x, y = words(a), words(b)
    n = F.least(F.size(x), F.size(y))
    return (n > 0) & (F.slice(x, F.lit(1), n) == F.slice(y, F.lit(1), n))


def joined_digit_boxes(text: Column) -> Column:
    """One digit a printed box: the blanks between five or more of them go."""
    runs = F.regexp_extract_all(text, F.lit(r"(?<![\w-])\d(?: (?:- )?\d){4,}(?![\w-])"), F.lit(0))
    return F.aggregate(runs, text, lambda t, r: F.replace(t, r, F.replace(r, F.lit(" "), F.lit(""))))


def split_caption(text: Column) -> Column:
    """A short caption glued before its value: struct<caption, value>, null if there is none."""
    shape = r"^(?s)([A-Za-z]+(?: [A-Za-z]+)?):\s+(\S.*)$"
    return F.when(text.rlike(shape), F.struct(F.regexp_extract(text, shape, 1).alias("caption"), F.regexp_extract(text, shape, 2).alias("value")))


def markdown_escaped(text: Column) -> Column:
    """Text that Markdown and HTML take literally."""
    return F.regexp_replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), r"([\\`*_{}\[\]#|])", r"\\$1")


def credential(raw: Column) -> Column:
    names = F.create_map(*[F.lit(x) for c in CREDENTIALS for x in (c.upper(), c)])
    v = F.upper(F.trim(F.replace(F.regexp_replace(F.trim(raw), r"^[()]+|[()]+$", ""), F.lit("."), F.lit(""))))
    return F.struct(F.try_element_at(names, v).alias("value"), F.when(F.try_element_at(names, v).isNull(), "unknown credential").alias("problem"))


def valid_span(numbers: Column, count: Column) -> Column:
    """Row or column numbers of a cell: some, distinct, in range and without a hole."""
    n = F.size(numbers)
    return F.coalesce((n > 0) & (F.size(F.array_distinct(numbers)) == n) & (F.array_min(numbers) >= 0) & (F.array_max(numbers) < count) & (F.array_max(numbers) - F.array_min(numbers) + 1 == n), F.lit(False))


def top_class(scores: Column) -> Column:
    """The name of a map's highest score; the first by name on ties, null if it is empty."""
    entries = F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k")))
    return F.try_element_at(F.array_sort(entries), F.lit(1))["k"]


def braces_balanced(formula: Column) -> Column:
    """Braces that are not escaped close in order."""
    marks = F.split(F.regexp_replace(F.regexp_replace(formula, r"\\.", ""), "[^{}]", ""), "")
    walked = F.aggregate(F.filter(marks, lambda m: m != ""), F.lit(0), lambda a, m: F.when(a < 0, a).when(m == "{", a + 1).otherwise(a - 1))
    return walked == 0


def repeated_lines_at_end(text: Column, last: int = 8) -> Column:
    """The last eight lines are one and the same."""
    lines = F.split(text, "\n")
    return (F.size(lines) >= last) & (F.size(F.array_distinct(F.slice(lines, F.greatest(F.size(lines) - last + 1, F.lit(1)), F.lit(last)))) == 1)
