"""Evidence of a page as it is shown: lookups, owners, pairs of captions and values, types of blocks, checks of generated blocks.

Joins are by page and id. What depends on earlier choices on a page (pairs, owners, lines) is one pass over its rows.
Constants that the survey does not fix (how far a value may lie from its caption, what counts as a margin) are parameters.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagelake.functions import captions as C
from pagelake.functions import geometry as G
from pagelake.operators import layout

PAGE = ["document_id", "page_number"]
KEY = [*PAGE, "region_id"]
# What may be a source of layout, and what is never shown.
TEXT_KINDS = (
    "caption", "code", "equation", "field", "footnote", "formula", "handwriting", "heading", "list_item", "math", "page_footer", "page_header",
    "page_text", "paragraph", "section_header", "text", "text_block", "title", "token", "word",
)
UNSHOWN = ("table_source", "figure_source", "form_source", "coverage_risk", "table_candidate")
NO_SOURCE = ("coverage_risk", "layout_block", "presentation_challenger", "table", "table_candidate", "table_cell", "table_source", "figure_source", "form_source")


# lookups
def with_evidence(references: DataFrame, regions: DataFrame) -> DataFrame:
    """references (page, evidence_ids) with each named region; ids that the page lacks give no row."""
    each = references.withColumn("region_id", F.explode("evidence_ids")).drop("evidence_ids")
    return each.join(regions, KEY)


def cells_in_tables(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Text cells (cell_id, box) whose centre lies in a table (table_id, box); a cell may lie in several."""
    at = cells.select(*PAGE, "cell_id", ((F.col("left") + F.col("right")) / 2).alias("x"), ((F.col("top") + F.col("bottom")) / 2).alias("y"))
    return G.points_in_boxes(at, tables.select(*PAGE, "table_id", *G.SIDES), PAGE).select(*PAGE, "cell_id", "table_id")


def eligible_sources(regions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Regions (kind, role, text, layout_owner_id, box) that layout may use: with text, of a text kind, of no excluded or candidate role,
    with a real box, owned by no block and not the evidence (page, region_id) of a control or table."""
    name = lambda c: F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[\s-]+", "_")
    kind, role = name(F.col("kind")), name(F.col("role"))
    fit = kind.isin(*TEXT_KINDS) & ~role.isin(*NO_SOURCE) & ~role.endswith("_candidate") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    boxed = (F.col("right") > F.col("left")) & (F.col("bottom") > F.col("top"))
    return regions.filter(fit & boxed & F.col("layout_owner_id").isNull()).join(evidence.select(*KEY).distinct(), KEY, "left_anti")


def shown_regions(regions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Regions (kind, role, resolution, layout_owner_id) to render: evidence, controls and what is unresolved, of a shown role. What a
    block of the page owns is drawn inside it, unless it is a table or figure."""
    blocks = regions.filter("role = 'layout_block'").select(*PAGE, F.col("region_id").alias("layout_owner_id")).withColumn("_owned", F.lit(True))
    cited = evidence.select(*KEY).distinct().withColumn("_cited", F.lit(True))
    kind = C.presentation_kind(F.col("kind"), F.col("role"))
    both = regions.join(cited, KEY, "left").join(blocks, [*PAGE, "layout_owner_id"], "left")
    shown = ~F.coalesce(F.col("role"), F.lit("")).isin(*UNSHOWN) & ~F.col("kind").isin("coverage_risk", "table_candidate") & (F.col("_cited").isNotNull() | (kind == "control") | (F.col("resolution") != "resolved"))
    return both.filter(shown & (F.col("_owned").isNull() | kind.isin("table", "figure"))).drop("_cited", "_owned").select(*regions.columns)


def documents_to_read(documents: DataFrame, types: DataFrame) -> DataFrame:
    """documents (document_id, type, type_confidence) without those known with confidence to be of a type that carries no data."""
    empty = types.filter("not carries_data").select("type")
    sure = documents.filter("type_confidence = 'high'").join(F.broadcast(empty), "type", "left_semi")  # types are a fixed short list
    return documents.join(sure.select("document_id"), "document_id", "left_anti")


def concatenated(frames: Iterable[DataFrame]) -> DataFrame:
    """Label sets one after another; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def fetch_outcomes(fetches: DataFrame) -> DataFrame:
    """fetches (cached, error): how many were cached, fetched, or failed by the type before the error's colon."""
    what = F.when(F.col("cached"), "cached").when(F.col("error").isNull(), "fetched").otherwise(F.element_at(F.split("error", ":"), 1))
    return fetches.groupBy(what.alias("outcome")).agg(F.count("*").alias("n"))


def routing_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of (arm, accepted, review) with the total and the share accepted of each arm."""
    rows = spark.read.schema("arm string, accepted long, review long").option("header", True).csv(path)
    sums = rows.groupBy("arm").agg(F.sum("accepted").alias("accepted"), F.sum("review").alias("review"))
    return sums.withColumn("total", F.col("accepted") + F.col("review")).withColumn("share", F.round(F.try_divide("accepted", F.col("accepted") + F.col("review")), 4))


def layout_service_regions(spark: SparkSession, path: str) -> DataFrame:
    """Replies of a layout service (JSON lines of a page and its elements) as regions: kind of the category, calibrated confidence, plain
    text. A line that isn't such a reply gives no row."""
    from pagelake.functions import confidence
    from pagelake.functions import regions as R

    element = "struct<category:string,text:string,score:double,token_score:double,retries:int,orphan_text:boolean,box:array<double>>"
    pages = spark.read.schema(f"document_id string, page_number int, elements array<{element}>").json(path)
    e = pages.select(*PAGE, F.posexplode("elements").alias("i", "e")).filter("e.box is not null and size(e.box) = 4")
    read = e.select(*PAGE, F.concat_ws("-", F.lit("r"), "i").alias("region_id"), (F.col("i") + 1).alias("reading_order"), R.kind_of(F.col("e.category")).alias("kind"), "e.*")
    plain = C.plain_reading(F.coalesce("text", F.lit("")), F.col("kind"))
    sure = C.calibrates(F.col("token_score"), F.col("score"), plain["kind"], F.col("retries"), F.col("orphan_text"))
    score = F.when(sure, confidence.calibrated(F.col("token_score"), F.col("score"))).otherwise(F.col("token_score"))
    return read.select(*KEY, "reading_order", plain["kind"].alias("kind"), plain["text"].alias("text"), score.alias("confidence"), *[F.col("box")[i].alias(s) for i, s in enumerate(G.SIDES)])


# risks and requirements as rows
def with_evidence_risks(regions: DataFrame, reason: Column) -> DataFrame:
    """regions and, for each page with a doubtful one, a row of kind coverage_risk after all others that lists the distinct reasons."""
    judged = regions.withColumn("_why", reason)
    risks = judged.groupBy(*PAGE).agg((F.max("reading_order") + 1).alias("reading_order"), F.array_sort(F.collect_set("_why")).alias("reasons")).filter(F.size("reasons") > 0)
    row = risks.select(*PAGE, F.concat(F.lit("p"), F.col("page_number"), F.lit("-evidence-risk-1")).alias("region_id"), "reading_order", F.lit("coverage_risk").alias("kind"), F.lit("unreadable").alias("resolution"), "reasons")
    return regions.withColumn("reasons", F.lit(None).cast("array<string>")).unionByName(row, allowMissingColumns=True)


def group_requirements(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """values (case_id, kind, key, role, value, phone): (values with the legal name as trade name of groups that print none, exceptions).
    A group's service location needs a phone, and any case needs one service location with a phone."""
    has = lambda k: F.max(F.when((F.col("key") == k) & (F.coalesce("value", F.lit("")) != ""), F.col("value")))
    place = (F.col("key") == "location") & (F.col("role") == "service_location")
    cases = values.groupBy("case_id", "kind").agg(has("group.legal_name").alias("legal"), has("group.dba_name").alias("dba"), F.bool_or(place & (F.coalesce("phone", F.lit("")) != "")).alias("phoned"))
    named = cases.filter("kind = 'group' and dba is null and legal is not null").select("case_id", "kind", F.lit("group.dba_name").alias("key"), F.col("legal").alias("value"))
    silent = values.filter(place & (F.col("kind") == "group") & (F.coalesce("phone", F.lit("")) == "")).select("case_id", F.concat(F.lit("location:"), F.coalesce("value", F.lit(""))).alias("value_id"))
    none = cases.filter(~F.coalesce("phoned", F.lit(False))).select("case_id", F.lit("location.service_location.phone").alias("value_id"))
    errors = silent.unionByName(none).select("case_id", "value_id", F.lit("missing_field").alias("code"), F.lit("error").alias("severity"))
    return values.unionByName(named, allowMissingColumns=True), errors


# checks of generated blocks
def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def alignment_problem(generated: Column, source: Column, kind: Column, same_form: Column) -> Column:
    """Why a generated text doesn't stand for its source; null if it does: marks of controls that the source lacks, more than three times its
    length (256 characters at least), other tokens with digits, fewer than 0.8 of its tokens (0.9 for a table), or, for a table or
    formula, another topology or signature (``same_form``)."""
    from pagelake.operators.matching import shared_words

    digits = lambda t: F.array_sort(F.filter(_tokens(t), lambda x: x.rlike(r"\p{Nd}")))
    held = shared_words(_tokens(source), _tokens(generated))
    least = F.when(kind == "table", 0.9).otherwise(0.8)
    glyphs = r"\[[xX ]\]|[☐☑☒□■]"
    return (
        F.when(generated.rlike(glyphs) & ~source.rlike(glyphs), "adds_controls").when(F.length(generated) > F.greatest(F.lit(256), 3 * F.length(source)), "too_long")
        .when(digits(generated) != digits(source), "changes_digits").when(held < least * F.size(_tokens(source)), "drops_text")
        .when(kind.isin("table", "formula") & ~F.coalesce(same_form, F.lit(False)), "changes_form")
    )


def fallback_reasons(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """blocks (page, block_id, passed, source_id, category, verified) with why each gives way to its source region (kind, role, block_type,
    resolution, layout_owner_id, cells); of blocks that stand on one source, all are segments of it."""
    owners = regions.filter("role = 'layout_block'").select(*PAGE, F.col("region_id").alias("layout_owner_id")).withColumn("owned", F.lit(True))
    source = regions.join(owners, [*PAGE, "layout_owner_id"], "left").select(*PAGE, F.col("region_id").alias("source_id"), C.presentation_kind(F.col("kind"), F.col("role"), F.col("block_type")).alias("source_kind"), "role", "block_type", "owned", (F.col("resolution") == "resolved").alias("resolved"), F.size(F.coalesce("cells", F.array().cast("array<string>"))).alias("cells"), F.lit(True).alias("_known"))
    uses = blocks.groupBy(*PAGE, "source_id").agg(F.count("*").alias("uses"))
    both = blocks.join(uses, [*PAGE, "source_id"], "left").join(source, [*PAGE, "source_id"], "left")
    c = {n: F.col(n) for n in ("passed", "source_kind", "role", "owned", "resolved", "verified", "block_type", "category", "cells", "uses")}
    c |= {"source_id": F.when(F.col("_known"), F.col("source_id")), "linked": F.lit(False), "claimed": F.lit(False)}
    return both.select(*PAGE, "block_id", C.fallback_reason(c).alias("reason"))


def merged_continuations(regions: DataFrame, continuations: DataFrame) -> DataFrame:
    """Tables over several pages (table_id, document_id, source_pages, source_ids, text, score) in place of their first part; the other parts
    go. A continuation any of whose parts is not exactly one table of its page changes nothing."""
    parts = continuations.select("document_id", "table_id", "text", "score", F.size("source_ids").alias("_n"), F.posexplode(F.arrays_zip("source_pages", "source_ids")).alias("_at", "_s"))
    parts = parts.select("document_id", "table_id", F.col("text").alias("_text"), F.col("score").alias("_score"), "_n", "_at", F.col("_s.source_pages").alias("page_number"), F.col("_s.source_ids").alias("region_id"))
    single = regions.filter("kind = 'table'").groupBy(*KEY).agg(F.count("*").alias("_m")).filter("_m = 1").select(*KEY)
    found = parts.join(single, KEY, "left_semi")
    whole = found.groupBy("document_id", "table_id").agg(F.count("*").alias("_k"), F.first("_n").alias("_w")).filter("_k = _w and _w > 1").select("document_id", "table_id")
    used = found.join(whole, ["document_id", "table_id"], "left_semi")
    out = regions.join(used.select(*KEY, "table_id", "_text", "_score", "_at"), KEY, "left").filter("_at is null or _at = 0")
    fill = lambda c, by: F.when(F.col("_at") == 0, F.col(by)).otherwise(F.col(c)).alias(c)
    swap = {"region_id": "table_id", "text": "_text", "confidence": "_score"}
    return out.select(*[fill(c, swap[c]) if c in swap else F.col(c) for c in regions.columns])


def shape_error(value, schema: dict, path: str = "$") -> str | None:
    """The first way in which a decoded JSON value departs from a schema (type, enum, required, additionalProperties, properties, items)."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}
    kind = schema.get("type")
    truth = isinstance(value, bool) and kind in ("integer", "number")
    if isinstance(kind, str) and (truth or not isinstance(value, kinds.get(kind, ()))):
        return f"{path} must be {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path} is not an allowed value"
    inner = []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        lacking = [k for k in schema.get("required", []) if k not in value]
        extra = [k for k in value if k not in known] if schema.get("additionalProperties") is False else []
        if lacking or extra:
            return f"{path} is missing {', '.join(lacking)}" if lacking else f"{path} has unexpected {', '.join(extra)}"
        inner = [(value[k], s, f"{path}.{k}") for k, s in known.items() if k in value]
    elif isinstance(value, list) and isinstance(schema.get("items"), dict):
        inner = [(x, schema["items"], f"{path}[{i}]") for i, x in enumerate(value)]
    return next((e for e in (shape_error(*x) for x in inner) if e), None)


def shape_errors(reply: Column, schema: dict) -> Column:
    """shape_error of JSON texts; what isn't JSON says so."""

    @F.pandas_udf(StringType())
    def judged(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                return shape_error(json.loads(t), schema)
            except ValueError:
                return "$ is not JSON"

        return texts.map(one)

    return judged(reply)


# Elements of a table that may be shown, where each may stand, and its attributes.
PARENTS = {"table": (None,), "caption": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "tr": ("table", "thead", "tbody", "tfoot"), "th": ("tr",), "td": ("tr",), "br": ("th", "td", "caption")}
SPANS = ("rowspan", "colspan")


class _TableCheck(HTMLParser):
    def __init__(self):
        super().__init__()
        self.open, self.bad, self.tables, self.rows = [], None, 0, []

    def fail(self, why):
        self.bad = self.bad or why

    def handle_starttag(self, tag, attrs):
        above = self.open[-1] if self.open else None
        if tag not in PARENTS:
            return self.fail("disallowed element")
        if above not in PARENTS[tag]:
            self.fail("malformed table")
        if any(k not in SPANS or tag not in ("th", "td") or not (v or "").isdigit() or not 1 <= int(v) <= 100 for k, v in attrs):
            self.fail("disallowed attribute")
        span = {k: int(v) for k, v in attrs if k in SPANS and (v or "").isdigit()}
        self.tables += tag == "table"
        if tag == "tr":
            self.rows.append([])
        elif tag in ("th", "td") and self.rows:
            self.rows[-1].append((span.get("rowspan", 1), span.get("colspan", 1)))
        if tag != "br":
            self.open.append(tag)

    def handle_endtag(self, tag):
        if not self.open or self.open.pop() != tag:
            self.fail("malformed table")

    def handle_data(self, data):
        if data.strip() and (not self.open or self.open[-1] not in ("th", "td", "caption")):
            self.fail("text outside cells")

    def problem(self) -> str | None:
        if self.open or self.tables != 1:
            self.fail("malformed table")
        widths, held = set(), {}
        for i, row in enumerate(self.rows):
            widths.add(sum(w for _, w in row) + held.get(i, 0))
            for high, wide in row:
                for k in range(i + 1, i + high):
                    held[k] = held.get(k, 0) + wide
        if len(widths) != 1 or any(k >= len(self.rows) for k in held):
            self.fail("not rectangular")
        return self.bad


@F.pandas_udf(StringType())
def table_problem(html: pd.Series) -> pd.Series:
    """Why a generated HTML table may not be shown; null if it may."""

    def one(t):
        if t is None:
            return None
        check = _TableCheck()
        check.feed(t)
        check.close()
        return check.problem()

    return html.map(one)


# choices on a page
def image_owners(boxes: list[tuple], fixed: list[bool]) -> list[int | None]:
    """The image that holds each image whole: from the largest on, the last found that stands for itself. ``fixed``: an image that keeps
    its own role and so may hold others though it is held."""
    size = lambda i: (boxes[i][2] - boxes[i][0]) * (boxes[i][3] - boxes[i][1])
    tops, inner, out = [], [], [None] * len(boxes)
    for i in sorted(range(len(boxes)), key=lambda i: (-size(i), i)):
        l, t, r, b = boxes[i]  # noqa: E741
        holds = lambda j: boxes[j][0] <= l and boxes[j][1] <= t and boxes[j][2] >= r and boxes[j][3] >= b  # noqa: B023,E731
        out[i] = next((j for j in [*reversed(inner), *tops] if holds(j)), None)
        if out[i] is None:
            tops.append(i)
        elif fixed[i]:
            inner.append(i)
    return out


def with_image_owners(images: DataFrame) -> DataFrame:
    """images (region_id, role, box): parent, the region_id of the image that holds it."""

    def owners(page, boxes):
        ids = page.region_id.tolist()
        return [None if j is None else ids[j] for j in image_owners(boxes, page.role.isin(["form_source", "signature"]).tolist())]

    return layout.with_columns(images, {"parent": (images.schema["region_id"].dataType.simpleString(), owners)})


def spatial_lines(boxes: list[tuple], share: float = 0.5) -> list[int]:
    """A line number for each box: by centre from the top, a box joins the nearest line all of whose boxes overlap it by that share of the
    smaller height, else it begins one."""
    centre = lambda b: (b[1] + b[3]) / 2
    lines: list[list[int]] = []
    out = [0] * len(boxes)
    for i in sorted(range(len(boxes)), key=lambda i: (centre(boxes[i]), boxes[i][0], i)):
        b = boxes[i]
        level = lambda j: min(b[3], boxes[j][3]) - max(b[1], boxes[j][1]) >= share * min(b[3] - b[1], boxes[j][3] - boxes[j][1])  # noqa: B023,E731
        middle = lambda k: (min(boxes[j][1] for j in lines[k]) + max(boxes[j][3] for j in lines[k])) / 2
        fit = [k for k in range(len(lines)) if all(map(level, lines[k]))]
        k = min(fit, key=lambda k: (abs(middle(k) - centre(b)), k)) if fit else len(lines)
        if not fit:
            lines.append([])
        lines[k].append(i)
        out[i] = k + 1
    return out


def pairs_on_page(rows: list[tuple], width: float, reach: float = 0.5, below: float = 1.5, aside: float = 2.0) -> list[int | None]:
    """rows: (caption kind or null, kind, text, box). For each row the caption that it is the value of. Captions by top and left take the
    nearest free row on their right within a share of the page's width, which beside an inline caption must look filled in; a caption
    before a colon without such takes the row below and those that go on below it. A value may itself look like an inline caption."""
    words = lambda t: len((t or "").split())
    high = lambda b: b[3] - b[1]
    out: list[int | None] = [None] * len(rows)
    used: set[int] = set()
    for i in sorted((i for i, r in enumerate(rows) if r[0]), key=lambda i: (rows[i][3][1], rows[i][3][0], i)):
        if i in used:
            continue
        label, box = rows[i], rows[i][3]
        free = [j for j in range(len(rows)) if j != i and j not in used and rows[j][0] != "colon"]
        level = [j for j in free if rows[j][3][0] >= box[2] and min(box[3], rows[j][3][3]) - max(box[1], rows[j][3][1]) >= 0.5 * min(high(box), high(rows[j][3])) and rows[j][3][0] - box[2] <= reach * width]
        best = min(level, key=lambda j: (rows[j][3][0], j), default=None)
        if best is not None and label[0] == "inline" and not (words(rows[best][2]) <= C.VALUE_WORDS and (high(rows[best][3]) >= C.TALLER * high(box) or rows[best][1] in ("section-header", "title"))):
            best = None
        chain = [best] if best is not None else []
        while label[0] == "colon" and best is None or len(chain) and label[0] == "colon":
            last = rows[chain[-1]][3] if chain else box
            under = [j for j in free if j not in chain and 0 <= rows[j][3][1] - last[3] <= below * high(last) and abs(rows[j][3][0] - last[0]) <= aside * high(last)]
            if not under:
                break
            chain.append(min(under, key=lambda j: (rows[j][3][1], j)))
        for j in chain:
            out[j] = i
            used |= {i, j}
    return out


def with_pairs(regions: DataFrame) -> DataFrame:
    """regions (kind, state, text, page_width, box): label_id, the caption whose value a region is."""
    c = F.col
    caption = F.when(C.colon_label(c("kind"), c("state"), c("text")), "colon").when(C.inline_label(c("kind"), c("state"), c("text")), "inline")

    def labels(page, boxes):
        ids = page.region_id.tolist()
        rows = [(a if isinstance(a, str) else None, k, t, b) for a, k, t, b in zip(page._caption, page.kind, page.text, boxes)]
        return [None if j is None else ids[j] for j in pairs_on_page(rows, float(page.page_width.iloc[0]))]

    kind = regions.schema["region_id"].dataType.simpleString()
    return layout.with_columns(regions.withColumn("_caption", caption), {"label_id": (kind, labels)}).drop("_caption")


def with_block_types(blocks: DataFrame, tall: float = 1.35) -> DataFrame:
    """blocks (block_id, block_type, text, box, page_height, learned): lines and paragraphs typed by their text and height against the page's
    median: formula, author, title (the first tall or capital one of up to twenty words), heading (the others), footnote (low and small),
    header (at the top edge). A page with a learned category stays as it is."""
    page = Window.partitionBy(*PAGE)
    high = F.col("bottom") - F.col("top")
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    letters = F.col("text").rlike(r"\p{L}")
    math = F.col("text").rlike(r"[=≤≥∑∫√±]|\\[a-z]+") & (F.length(F.regexp_replace("text", r"[^=+\-*/^_{}()\\∑∫√≤≥±\d]", "")) >= 0.3 * F.length(F.regexp_replace("text", r"\s", "")))
    b = blocks.withColumn("_typical", F.median(high).over(page)).withColumn("_kept", F.max(F.coalesce("learned", F.lit(False))).over(page))
    plain = F.col("block_type").isin("line", "paragraph") & ~F.col("_kept")
    large = plain & ~math & letters & words.between(1, 20) & ((high >= tall * F.col("_typical")) | ((words <= 12) & (F.upper("text") == F.col("text"))))
    b = b.withColumn("_large", large).withColumn("_first", F.row_number().over(Window.partitionBy(*PAGE, "_large").orderBy(F.desc(high), "top", "block_id")))
    kind = (
        F.when(~plain, F.col("block_type")).when(math, "formula").when(F.contains("text", F.lit("@")), "author").when(F.col("_large") & (F.col("_first") == 1), "title").when(F.col("_large"), "heading")
        .when((F.col("top") >= 0.85 * F.col("page_height")) & (high < 0.9 * F.col("_typical")), "footnote").when(F.col("bottom") <= 0.06 * F.col("page_height"), "header").otherwise(F.col("block_type"))
    )
    return b.withColumn("block_type", kind).drop("_typical", "_kept", "_large", "_first")


def merged_separators(separators: DataFrame, near: float = 4.0) -> DataFrame:
    """separators (page, axis, position, low, high, extent of the axis): lines of nearly one position whose ends nearly meet as one."""
    place = Window.partitionBy(*PAGE, "axis").orderBy("position", "low", "high")
    step = F.when(F.col("position") - F.lag("position").over(place) <= near, 0).otherwise(1)
    s = separators.withColumn("_f", step).withColumn("_band", F.sum("_f").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy(*PAGE, "axis", "_band").orderBy("low", "high")
    reach = F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("_g", F.when(F.col("low") - reach <= F.greatest(F.lit(near), 0.01 * F.col("extent")), 0).otherwise(1))
    s = s.withColumn("_part", F.sum("_g").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*PAGE, "axis", "_band", "_part").agg(F.round(F.avg("position"), 4).alias("position"), F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("lines")).drop("_band", "_part")


def kept_words(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages whose words (page, word) before a split are all there after it, as multisets: a split of the page is accepted for these."""
    count = lambda d, n: d.groupBy(*PAGE, "word").agg(F.count("*").alias(n))
    lost = count(before, "n").join(count(after, "m"), [*PAGE, "word"], "left").filter(F.col("n") > F.coalesce("m", F.lit(0)))
    return before.select(*PAGE).distinct().join(lost.select(*PAGE).distinct(), PAGE, "left_anti")
