"""Image regions to redact, from OCR word boxes and element boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.functions import fixed
from pagewarden.functions.numbering import number_within
from pagewarden.functions.pii import pii_spans, prefix_sums
from pagewarden.functions.staging import staged
from pagewarden.functions.text import let
from pagewarden.operators.privacy import element_findings_expr

LINE_KEYS = ["image_id", "block_num", "par_num", "line_num"]
_WORD = "array<struct<text:string,x:int,y:int,width:int,height:int,start:int,end:int>>"


def _keyed(tokens: DataFrame) -> DataFrame:
    """Tokens with missing line keys as zero."""
    return tokens.withColumns({k: F.coalesce(F.col(k), F.lit(0)).cast("int") for k in LINE_KEYS[1:]})


def ocr_lines(tokens: DataFrame) -> DataFrame:
    """Words of a line by x, ties in scan order, and the line text.

    The key is the whole line key, so a large image is spread over its lines.
    """
    word = F.struct(
        F.col("box.x").alias("x"), F.col("line_seq").alias("seq"), "text",
        F.col("box.y").alias("y"), F.col("box.width").alias("width"), F.col("box.height").alias("height"),
    )
    lines = _keyed(tokens.withColumn("line_seq", scan_position(tokens))).groupBy(*LINE_KEYS).agg(
        F.min("line_seq").alias("first_seq"), F.sort_array(F.collect_list(word)).alias("words")
    )
    return lines.withColumn("line_text", F.array_join(F.transform("words", lambda w: w["text"]), " "))


def scan_position(tokens: DataFrame) -> Column:
    """Scan order of a token: its ``seq`` when it has one, else line and word."""
    if "seq" in tokens.columns:
        return F.col("seq").cast("bigint")
    return F.col("line_num").cast("bigint") * (1 << 24) + F.col("word_no")


def _with_offsets(words: Column) -> Column:
    """Words with character start and end in the line text.

    A word starts after all earlier words and one blank each. The text up to a
    word is found by its running length, folded once per line.
    """
    shaped = F.transform(
        words,
        lambda w: F.struct(
            w["text"].alias("text"), w["x"].alias("x"), w["y"].alias("y"),
            w["width"].alias("width"), w["height"].alias("height"),
        ),
    )
    lengths = F.transform(words, lambda w: F.length(w["text"]) + 1)
    return let(
        lengths,
        lambda n: let(
            prefix_sums(n),
            lambda s: F.transform(
                shaped,
                lambda w, i: F.struct(
                    w["text"].alias("text"), w["x"].alias("x"), w["y"].alias("y"),
                    w["width"].alias("width"), w["height"].alias("height"),
                    F.get(s, i).cast("int").alias("start"),
                    (F.get(s, i) + F.length(w["text"])).cast("int").alias("end"),
                ),
            ),
        ),
    ).cast(_WORD)


def ocr_word_offsets(lines: DataFrame) -> DataFrame:
    """One row per word with its place in the line text."""
    rows = lines.select(*LINE_KEYS, F.posexplode(_with_offsets(F.col("words"))).alias("word_no", "w"))
    return rows.select(*LINE_KEYS, "word_no", "w.text", "w.start", "w.end")


def _line_findings(lines: DataFrame) -> DataFrame:
    """Lines with PII, one row per finding, with the words that overlap it."""
    found = lines.withColumn("_f", pii_spans("line_text")).filter(F.size("_f") > 0)
    placed = found.withColumn("_w", _with_offsets(F.col("words")))
    rows = placed.select(*LINE_KEYS, "first_seq", "_w", F.posexplode("_f").alias("finding_no", "f"))
    return rows.withColumn(
        "hits",
        F.filter("_w", lambda w: (F.col("f.end") > w["start"]) & (F.col("f.start") < w["end"])),
    ).drop("_w")


def ocr_span_words(lines: DataFrame) -> DataFrame:
    """Words overlapping each finding; only lines that have one are touched."""
    rows = _line_findings(lines).select(
        *LINE_KEYS, "finding_no", F.col("f.type").alias("type"), F.explode("hits").alias("w")
    )
    return rows.select(*LINE_KEYS, "finding_no", "type", "w.text", "w.start", "w.end")


def ocr_sensitive_regions(lines: DataFrame) -> DataFrame:
    """Bounding box of the words of each finding, one row per finding."""
    rows = _line_findings(lines).filter(F.size("hits") > 0)
    left = F.array_min(F.transform("hits", lambda w: w["x"]))
    top = F.array_min(F.transform("hits", lambda w: w["y"]))
    right = F.array_max(F.transform("hits", lambda w: w["x"] + w["width"]))
    bottom = F.array_max(F.transform("hits", lambda w: w["y"] + w["height"]))
    return rows.select(
        *LINE_KEYS, "first_seq", "finding_no", F.col("f.type").alias("type"), F.col("f.value").alias("value"),
        F.struct(
            left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height")
        ).alias("box"),
    )


def sensitive_element_boxes(elements: DataFrame) -> DataFrame:
    """Boxes of elements that have a finding of their own; decided in the row."""
    return elements.filter(F.col("box").isNotNull() & (F.size(element_findings_expr()) > 0)).select(
        "page_id", "ord", "box"
    )


def pad_clamp(box: Column, image_width: Column, image_height: Column) -> Column:
    """Truncated, padded and clamped rectangle; null when it has no size."""
    x, y = box["x"].cast("int"), box["y"].cast("int")
    width, height = box["width"].cast("int"), box["height"].cast("int")
    pad = fixed.REGION_PADDING
    return F.when(
        (width > 0) & (height > 0),
        F.struct(
            F.greatest(F.lit(0), x - pad).alias("x1"),
            F.greatest(F.lit(0), y - pad).alias("y1"),
            F.least(image_width, x + width + pad).alias("x2"),
            F.least(image_height, y + height + pad).alias("y2"),
        ),
    )


def pad_clamp_boxes(boxes: DataFrame) -> DataFrame:
    """boxes(.., box, image_width, image_height) to rectangles."""
    return (
        boxes.withColumn("rect", pad_clamp(F.col("box"), F.col("image_width"), F.col("image_height")))
        .filter(F.col("rect").isNotNull())
        .drop("box")
    )


def redaction_plan(element_boxes: DataFrame, regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """Ordered rectangles per image: element boxes first, then OCR regions.

    ``sizes``(image_id, image_width, image_height) is one row per image; boxes of
    an image without a size are kept and have no right or lower limit.
    """
    wide = "struct<x:double,y:double,width:double,height:double>"
    first = element_boxes.select(
        F.col("page_id").alias("image_id"), F.lit(0).alias("source_no"),
        F.col("ord").cast("bigint").alias("place"), F.lit(0).alias("finding_no"), F.col("box").cast(wide).alias("box"),
    )
    second = regions.select(
        "image_id", F.lit(1).alias("source_no"), F.col("first_seq").alias("place"), "finding_no",
        F.col("box").cast(wide).alias("box"),
    )
    rects = pad_clamp_boxes(first.unionByName(second).join(sizes, "image_id", "left"))
    # Blocks follow the order: elements by ordinal, regions by scan line.
    block = F.when(F.col("source_no") == 0, F.floor(F.col("place") / 4096) - (1 << 40)).otherwise(
        F.floor(F.col("place") / (1 << 24))
    )
    # Read twice by the numbering: for the counts and for the rows. Rectangles hold no raw values.
    return number_within(
        staged(rects.select("image_id", "source_no", "place", "finding_no", "rect")),
        ["image_id"], block, ["source_no", "place", "finding_no"], "seq",
    )
