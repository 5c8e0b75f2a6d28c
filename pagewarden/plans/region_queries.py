"""Registered queries over image regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewarden.operators import regions as R
from pagewarden.sources import derived as D
from pagewarden.sources import pages as P

IMAGE_WIDTH, IMAGE_HEIGHT = 500, 1200


def _lines(spark, sf):
    return R.ocr_lines(P.scan_ocr_tokens(D.ocr_words(spark, sf)))


def ocr_lines(spark, sf):
    return _lines(spark, sf).select(*R.LINE_KEYS, F.size("words").alias("n_words"), "line_text")


def ocr_word_offsets(spark, sf):
    return R.ocr_word_offsets(_lines(spark, sf))


def ocr_span_words(spark, sf):
    return R.ocr_span_words(_lines(spark, sf))


def ocr_sensitive_regions(spark, sf):
    return R.ocr_sensitive_regions(_lines(spark, sf)).select(
        *R.LINE_KEYS, "finding_no", "type", "value", "box.x", "box.y", "box.width", "box.height"
    )


def sensitive_element_boxes(spark, sf):
    boxes = R.sensitive_element_boxes(P.visible_elements(D.form_elements(spark, sf)))
    return boxes.select("page_id", "ord", "box.x", "box.y", "box.width", "box.height")


def pad_clamp_boxes(spark, sf):
    boxes = D.form_elements(spark, sf).select(
        "page_id", "ord", "box", (F.col("page_id") % 300).cast("int").alias("image_width"),
        F.lit(250).alias("image_height"),
    )
    return R.pad_clamp_boxes(boxes).select("page_id", "ord", "rect.*")


def redaction_plan(spark, sf):
    """Screenshots: the document is the rendered text of the form of the same id."""
    boxes = R.sensitive_element_boxes(P.visible_elements(D.form_elements(spark, sf)))
    sizes = D.read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("image_id"), F.lit(IMAGE_WIDTH).alias("image_width"),
        F.lit(IMAGE_HEIGHT).alias("image_height"),
    )
    plan = R.redaction_plan(boxes, R.ocr_sensitive_regions(_lines(spark, sf)), sizes)
    return plan.select("image_id", "seq", "source_no", "rect.*")


QUERIES = {
    "ocr_lines": ocr_lines,
    "ocr_word_offsets": ocr_word_offsets,
    "ocr_span_words": ocr_span_words,
    "ocr_sensitive_regions": ocr_sensitive_regions,
    "sensitive_element_boxes": sensitive_element_boxes,
    "pad_clamp_boxes": pad_clamp_boxes,
    "redaction_plan": redaction_plan,
}
