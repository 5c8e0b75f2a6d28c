"""Registered queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewarden.functions.staging import work_folder
from pagewarden.plans import flows
from pagewarden.sources import derived as D
from pagewarden.sources import pages as P
from pagewarden.sources import results


def _joined(cells: str = "cells"):
    return F.array_join(cells, "|").alias("cells")


def scan_page_elements(spark, sf):
    rows = P.scan_page_elements(D.read_table(spark, sf, "pages"))
    return rows.select("page_id", "ord", "type", "tag", "text", "href")


def scan_form_elements(spark, sf):
    rows = P.scan_page_elements(D.form_html(spark, sf))
    return rows.select(
        "page_id", "ord", "type", "tag", "text", "aria_label", "placeholder", "input_type",
        "name", "id", "value", "href", "enabled", "label",
    )


def filter_visible_enabled(spark, sf):
    rows = P.visible_elements(D.form_elements(spark, sf))
    return rows.select("page_id", "ord", "type", "enabled", F.col("box.y").alias("box_y"))


def page_text(spark, sf):
    return P.page_text(D.read_table(spark, sf, "pages"))


def page_state(spark, sf):
    state = P.page_state(D.form_pages(spark, sf), P.visible_elements(D.form_elements(spark, sf)))
    return state.select(
        "page_id", "url", "title", "page_text",
        F.array_join(
            F.transform(
                "elements",
                lambda e: F.concat_ws(":", e["ord"].cast("string"), e["type"], e["name"], e["text"], e["value"]),
            ),
            "|",
        ).alias("elements"),
    )


def ingest_page_state_json(spark, sf):
    pages, elements = P.ingest_page_state_json(D.payloads(spark, sf))
    return pages.join(elements, "page_id", "left").select(
        "page_id", "url", "title", "page_text", "ord", "tag", "text", "name", "input_type", "value",
        "enabled", F.col("box.width").alias("box_width"),
    )


def scan_ocr_tokens(spark, sf):
    tokens = P.scan_ocr_tokens(D.ocr_words(spark, sf))
    return tokens.select(
        "image_id", "line_num", "word_no", "text", "conf", "block_num", "par_num",
        F.col("box.x").alias("x"), F.col("box.width").alias("w"),
    )


def ocr_page_text(spark, sf):
    return P.ocr_page_text(P.scan_ocr_tokens(D.ocr_words(spark, sf)))


def parse_plan_array(spark, sf):
    plans = P.parse_plan_array(D.model_texts(spark, sf))
    return plans.select(
        "event_id", F.col("plan").isNotNull().alias("parsed"),
        F.when(F.col("plan").isNotNull(), F.size("plan")).alias("n_items"),
        F.try_variant_get(F.get("plan", F.lit(0)), "$.action", "string").alias("first_action"),
        F.try_variant_get(F.get("plan", F.lit(0)), "$.target", "string").alias("first_target"),
    )


def parse_plan_object(spark, sf):
    plans = P.parse_plan_object(D.model_texts(spark, sf))
    kind = F.regexp_extract(F.schema_of_variant("plan"), "^[A-Z]+", 0)
    is_object = kind == "OBJECT"
    return plans.select(
        "event_id", F.when(is_object, "object").when(kind == "ARRAY", "array").alias("kind"),
        F.when(is_object, F.try_variant_get("plan", "$.status", "string")).alias("status"),
        F.when(is_object, F.try_variant_get("plan", "$.reason", "string")).alias("reason"),
    )


def html_table_rows(spark, sf):
    return P.html_table_rows(D.form_html(spark, sf)).select("page_id", "row_no", _joined())


def html_rows_top3(spark, sf):
    rows = P.top_rows(P.html_table_rows(D.form_html(spark, sf)))
    return rows.select("page_id", "row_no", _joined())


def transaction_lines_fallback(spark, sf):
    html = D.form_html(spark, sf)
    with_rows = P.html_table_rows(html).select("page_id").distinct()
    lines = P.transaction_lines(P.page_text(html)).join(with_rows, "page_id", "left_anti")
    return P.top_rows(lines).select("page_id", "row_no", _joined())


def transaction_cards_fallback(spark, sf):
    html = D.form_html(spark, sf)
    with_rows = P.html_table_rows(html).select("page_id").distinct()
    cards = P.transaction_cards(html).join(with_rows, "page_id", "left_anti")
    return P.top_rows(cards).select("page_id", "row_no", _joined())


def sink_results(spark, sf):
    writes = D.actions(spark, sf).select(
        "task_id", "ts", "event_id", "target",
        F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("event_type")).alias("status"),
    )
    last = P.last_writes(writes, "task_id", ["ts", "event_id"], ["status", "target"])
    return last.select("task_id", F.coalesce("status", F.lit("idle")).alias("status"), "target")


def prompt_dataset(spark, sf):
    elements, pages, _ = flows.sanitized_state(
        P.visible_elements(D.form_elements(spark, sf)), D.form_pages(spark, sf)
    )
    state = P.page_state(pages, elements.select("page_id", "ord", "type", "name", "text", "value"))
    prompts = P.prompt_rows(D.tasks(spark, sf).filter(F.trim("task") != ""), state)
    return prompts.select("event_id", "page_id", "prompt")


RESULT = "task_id bigint, status string, target string"


def sink_merged(spark, sf):
    """Three writes of overlapping tasks, one repeated, a fold between; read back.

    A write holds what its third of the log says last of each task.
    """
    path = work_folder(spark)
    log = D.actions(spark, sf).withColumn("part", F.dayofyear("ts") % 3)
    for number in (0, 1, 1, 2):
        writes = log.filter(F.col("part") == number).select(
            "task_id", "ts", "event_id", "target", F.when(F.col("event_type") != "error", F.col("event_type")).alias("status")
        )
        last = P.last_writes(writes, "task_id", ["ts", "event_id"], ["status", "target"])
        results.write(last.select("task_id", "status", "target"), path, number, ["task_id"])
        if number == 1:
            results.fold(spark, path, RESULT, ["task_id"])
    return results.read(spark, path, RESULT, ["task_id"]).select("task_id", F.coalesce("status", F.lit("idle")).alias("status"), "target")


QUERIES = {
    "scan_page_elements": scan_page_elements,
    "scan_form_elements": scan_form_elements,
    "filter_visible_enabled": filter_visible_enabled,
    "page_text": page_text,
    "page_state": page_state,
    "ingest_page_state_json": ingest_page_state_json,
    "scan_ocr_tokens": scan_ocr_tokens,
    "ocr_page_text": ocr_page_text,
    "parse_plan_array": parse_plan_array,
    "parse_plan_object": parse_plan_object,
    "html_table_rows": html_table_rows,
    "html_rows_top3": html_rows_top3,
    "transaction_lines_fallback": transaction_lines_fallback,
    "transaction_cards_fallback": transaction_cards_fallback,
    "sink_results": sink_results,
    "sink_merged": sink_merged,
    "prompt_dataset": prompt_dataset,
}
