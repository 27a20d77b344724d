"""Scans: files by their kind, word tables, logs, ground truth and label sets as DataFrames. Bad rows become rows of failures or nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE = ["document_id", "page_number"]
# Image suffixes; limits of a page, a payload and a text layer.
IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".webp", ".bmp")
MOST_CELLS, LAYER_CHARS, LAYER_BITMAPS = 20_000, 50, 0.05
# Latin-1 characters of the Wingdings font and the boxes that they show.
WINGDINGS_FROM, WINGDINGS_TO = "¨oqnþýüûx", "☐□☐■☑☒✓✗☒"


def source_kind(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return F.when(suffix == ".pdf", "pdf").when(suffix.isin(*IMAGES), "image").otherwise("unsupported")


def sniffed_kind(content: Column) -> Column:
    """The kind by the first bytes."""
    start = lambda n: F.hex(F.substring(content, 1, n))
    return F.when(start(4) == "25504446", "pdf").when(start(4) == "89504E47", "png").when(start(3) == "FFD8FF", "jpeg").when(start(4).isin("49492A00", "4D4D002A"), "tiff").when(start(2) == "424D", "bmp").when((start(4) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "webp").otherwise("unknown")


def document_format(kind: Column, first_page_chars: Column, one_bit: Column) -> Column:
    """digital_pdf from 50 characters of text on page one, scanned_pdf below; tiff and one-bit images are faxes."""
    return F.when((kind == "pdf") & (first_page_chars >= LAYER_CHARS), "digital_pdf").when(kind == "pdf", "scanned_pdf").when((kind == "tiff") | F.coalesce(one_bit, F.lit(False)), "fax").otherwise("image")


def files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Path, size and kinds of the files under a folder; bytes are kept only where asked for. An empty file gives no row."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    out = raw.select("path", "length", source_kind(F.col("path")).alias("kind"), sniffed_kind(F.col("content")).alias("sniffed"), *(["content"] if content else []))
    return out


def limited_pages(pages: DataFrame, most_pages: int, most_pixels: int) -> tuple[DataFrame, DataFrame]:
    """(pages within the limits, failures): a document with too many pages fails whole, a page with too many pixels alone."""
    counted = pages.withColumn("_n", F.count("*").over(Window.partitionBy("document_id")))
    why = F.when(F.col("_n") > most_pages, "too_many_pages").when(F.col("width").cast("long") * F.col("height") > most_pixels, "page_too_large")
    judged = counted.withColumn("_why", why)
    return judged.filter("_why is null").drop("_n", "_why"), judged.filter("_why is not null").select(*PAGE, F.col("_why").alias("failure"))


def text_layer(cells: DataFrame) -> DataFrame:
    """cells (page, text, bitmap_share of the page): pages whose bitmaps exceed 5 % or that have fewer than 50 characters are left out."""
    w = Window.partitionBy(*PAGE)
    gated = cells.withColumn("_c", F.sum(F.length(F.regexp_replace("text", r"\s", ""))).over(w)).withColumn("_b", F.max("bitmap_share").over(w))
    return gated.filter(f"_c >= {LAYER_CHARS} and _b <= {LAYER_BITMAPS}").drop("_c", "_b")


def wingdings(text: Column, font: Column) -> Column:
    """Text in that font as the symbols it shows."""
    return F.when(F.contains(F.lower(font), F.lit("wingdings")), F.translate(text, WINGDINGS_FROM, WINGDINGS_TO)).otherwise(text)


def reading_direction(chars: DataFrame) -> DataFrame:
    """chars (page, position, char, x, y): quarter turns of the page's commonest step between neighbours, blanks and steps of 30 points or
    more aside; ties to the one seen first, no step is no turn."""
    w = Window.partitionBy(*PAGE).orderBy("position")
    next_ = chars.withColumn("dx", F.lead("x").over(w) - F.col("x")).withColumn("dy", F.lead("y").over(w) - F.col("y")).withColumn("after", F.lead("char").over(w))
    far = F.abs("dx") + F.abs("dy")
    good = (F.trim("char") != "") & (F.trim("after") != "") & (far > 0) & (far < 30)
    turns = F.when(F.abs("dx") > F.abs("dy"), F.when(F.col("dx") > 0, 0).otherwise(2)).when(F.col("dy") > 0, 1).otherwise(3)
    each = next_.groupBy(*PAGE, F.when(good, turns).alias("turns")).agg(F.count("*").alias("n"), F.min("position").alias("seen"))
    first = Window.partitionBy(*PAGE).orderBy(F.col("turns").isNull(), F.desc("n"), "seen")
    return each.withColumn("r", F.row_number().over(first)).filter("r = 1").select(*PAGE, F.coalesce("turns", F.lit(0)).alias("turns"))


def glyph_lines(chars: list[tuple], direction: tuple[float, float] = (1, 0)) -> list[int | None]:
    """chars of a cell: (char, left, top, right, bottom). A line number each, null for a copy printed over (the same glyph within a
    quarter of its lesser side) and for breaks; a line begins where the stream steps back by half a size against the direction."""
    out, line, before, kept = [], 0, None, {}
    for c, left, top, right, bottom in chars:
        x, y, sides = (left + right) / 2, (top + bottom) / 2, (right - left, bottom - top)
        blank = not c.strip()
        if c in "\r\n" or (not blank and any(abs(u - x) + abs(v - y) < min(sides) / 4 for u, v in kept.get(c, ()))):
            out.append(None)
            continue
        if not blank:
            kept.setdefault(c, []).append((x, y))
            if before is None or (x - before[0]) * direction[0] + (y - before[1]) * direction[1] < -max(sides) / 2:
                line += 1
            before = (x, y)
        out.append(line or None)
    return out


def with_glyph_lines(chars: DataFrame) -> DataFrame:
    """chars (page, cell_id, position, char, left, top, right, bottom) without copies, with their line."""

    def run(cell):
        cell = cell.sort_values("position")
        cell["line"] = glyph_lines(list(cell[["char", "left", "top", "right", "bottom"]].itertuples(index=False, name=None)))
        return cell.dropna(subset=["line"])

    schema = chars.schema.simpleString().removeprefix("struct<").removesuffix(">")
    return chars.groupBy(*PAGE, "cell_id").applyInPandas(run, f"{schema},line:int")


def tesseract_words(spark: SparkSession, path: str, document_id: str, page_number: int) -> DataFrame:
    """Words of one page's TSV: level 5 with text; a confidence below 0 is none."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", escape="")
    text = F.trim("text")
    conf = F.col("conf").try_cast("double")
    order = ["page_num", "block_num", "par_num", "line_num", "word_num"]
    whole = lambda c: F.col(c).try_cast("int")
    kept = raw.filter((F.col("level") == "5") & (text != ""))
    w = Window.partitionBy("page_num").orderBy(*map(whole, order[1:]))
    return kept.select(
        F.lit(document_id).alias("document_id"), F.lit(page_number).alias("page_number"), F.row_number().over(w).alias("reading_order"), F.lit("word").alias("kind"), text.alias("text"),
        F.when(conf >= 0, F.round(conf / 100, 4)).alias("confidence"), whole("left").alias("left"), whole("top").alias("top"),
        (whole("left") + whole("width")).alias("right"), (whole("top") + whole("height")).alias("bottom"),
    ).withColumn("region_id", F.concat(F.lit(f"p{page_number}-word-"), F.col("reading_order").cast("string")))


def service_payloads(raw: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON replies of a service: payload, and the failure of those that don't fit the schema or hold too many cells."""
    out = raw.withColumn("payload", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    many = F.size("payload.cells") > MOST_CELLS if "cells" in out.select("payload.*").columns else F.lit(False)
    return out.withColumn("failure", F.when(F.expr(f"try_parse_json({column}) is null"), "malformed").when(many, "too_many_cells"))


def json_lines(spark: SparkSession, path: str, schema: str, required: tuple = (), whole_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON lines, or of one document a file. Lines that are no JSON or lack a required column are rejected."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("multiLine", str(whole_files).lower()).json(path)
    lacking = F.col("_bad").isNotNull()
    for c in required:
        lacking = lacking | F.col(c).isNull()
    return rows.filter(~lacking).drop("_bad"), rows.filter(lacking)


def usage_entries(usage: DataFrame, limit: int) -> DataFrame:
    """The newest entries by their sortable id."""
    return usage.orderBy(F.desc("id")).limit(limit)


def annotations(rows: DataFrame) -> DataFrame:
    """Ground truth (sheet, row, file, page, label, text): blanks of file, page and label continue the row above in their sheet; text
    that is a date cell can't be scored."""
    w = Window.partitionBy("sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    filled = [F.last(c, ignorenulls=True).over(w).alias(c) for c in ("file", "page", "label")]
    return rows.select("sheet", "row", *filled, "text", (~F.col("text").rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")).alias("scorable"))


def coco_images(images: DataFrame, labels: DataFrame) -> DataFrame:
    """One row an image with the array of its labels (category_id, bbox as left, top, width, height); none gives an empty array."""
    entry = F.struct("id", "category_id", "bbox")
    per = labels.groupBy("image_id").agg(F.array_sort(F.collect_list(entry)).alias("objects"))
    out = images.join(per, images["id"] == per["image_id"], "left").drop("image_id")
    return out.withColumn("objects", F.coalesce("objects", F.array().cast(per.schema["objects"].dataType)))


def flattened_labels(nested: DataFrame) -> DataFrame:
    """nested (image_id, width, height, boxes array<array<double>> as left, top, width, height; categories): one row a label, clamped to
    the image; sides below two pixels go; ids are dense by image and place."""
    each = nested.select("image_id", "width", "height", F.posexplode(F.arrays_zip(F.col("boxes").alias("b"), F.col("categories").alias("c"))).alias("at", "z"))
    side = lambda i, m: F.least(F.greatest(F.get("z.b", i), F.lit(0.0)), F.col(m))
    end = lambda i, m: F.least(F.greatest(F.get("z.b", i) + F.get("z.b", i + 2), F.lit(0.0)), F.col(m))
    out = each.select("image_id", "at", F.col("z.c").alias("category_id"), side(0, "width").alias("left"), side(1, "height").alias("top"), end(0, "width").alias("right"), end(1, "height").alias("bottom"))
    kept = out.filter("right - left >= 2 and bottom - top >= 2")
    return kept.withColumn("label_id", F.concat_ws("-", F.col("image_id").cast("string"), F.row_number().over(Window.partitionBy("image_id").orderBy("at")).cast("string")))
