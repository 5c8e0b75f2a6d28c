"""Registered queries over the privacy operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewarden.functions import fixed
from pagewarden.functions.pii import pii_spans, redact_display, replace_values
from pagewarden.operators import privacy as O
from pagewarden.plans import flows
from pagewarden.sources import derived as D
from pagewarden.sources import pages as P


def _documents(spark, sf):
    return D.read_table(spark, sf, "documents").select("doc_id", "text")


def _elements(spark, sf):
    return P.visible_elements(D.form_elements(spark, sf))


def pii_by_language(spark, sf):
    """Flagship: what PII is where by language, and is it gone afterwards."""
    docs = D.read_table(spark, sf, "documents").select("lang", "text")
    spans = docs.withColumn("f", pii_spans("text")).filter(F.size("f") > 0)
    cleaned = spans.select("lang", "f", replace_values("text", F.col("f")).alias("clean"))
    rows = cleaned.select("lang", "clean", F.explode("f").alias("f"))
    return rows.groupBy("lang", F.col("f.type").alias("type")).agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(F.col("clean").contains(F.col("f.value"))).alias("left_over"),
    )


def detect_pii(spark, sf):
    return O.detect_pii(_documents(spark, sf), "doc_id")


def _detect(name):
    def query(spark, sf):
        docs = O.detect_pii(_documents(spark, sf), "doc_id", types=(name,))
        fields = _elements(spark, sf).select((F.col("page_id") * 100 + F.col("ord")).alias("elem_id"), "value")
        forms = O.detect_pii(fields, "elem_id", "value", types=(name,))
        return docs.select(F.lit("document").alias("source"), F.col("doc_id").alias("id"), "seq", "value", "start", "end").unionByName(
            forms.select(F.lit("field").alias("source"), F.col("elem_id").alias("id"), "seq", "value", "start", "end")
        )

    return query


def credential_elements(spark, sf):
    return O.credential_elements(_elements(spark, sf))


def inspect_element(spark, sf):
    return O.inspect_elements(_elements(spark, sf)).select(
        "page_id", "elem_ord", "is_pii", "field_no", "start", "pattern_no", "field", "type", "value"
    )


def inspect_text(spark, sf):
    return O.inspect_text(D.form_pages(spark, sf)).select("page_id", "start", "type", "value")


def inspect_page(spark, sf):
    return O.inspect_states(D.form_states(spark, sf))


def sanitize_elements(spark, sf):
    return O.sanitize_elements(_elements(spark, sf)).select("page_id", "ord", *fixed.INSPECTED_FIELDS)


def sanitize_page_text(spark, sf):
    elements = _elements(spark, sf)
    pages = D.form_pages(spark, sf)
    found = O.inspect_page(elements, pages)
    return O.sanitize_page_text(pages, found).select("page_id", "page_text")


def sanitize_documents(spark, sf):
    return O.sanitize_text_column(_documents(spark, sf))


def _summary(summary):
    return summary.withColumn("types", F.array_join("types", ","))


def privacy_summary(spark, sf):
    pages = D.form_pages(spark, sf)
    return _summary(O.privacy_summary(pages, O.inspect_page(_elements(spark, sf), pages)))


def replacement_lookup(spark, sf):
    found = O.inspect_page(_elements(spark, sf), D.form_pages(spark, sf))
    return O.replacement_tokens(found).groupBy("type", "token").agg(F.count(F.lit(1)).alias("n"))


def redact_display_text(spark, sf):
    return _documents(spark, sf).select("doc_id", redact_display("text").alias("text"))


def sanitize_nested(spark, sf):
    pages = D.form_pages(spark, sf).select(
        "page_id",
        F.struct(
            "url",
            F.array(F.struct(F.col("page_text").alias("text"), F.length("page_text").alias("n"))).alias("parts"),
        ).alias("state"),
        F.create_map(F.lit("mail user@example.com"), F.element_at(F.split("page_text", "\n"), 2)).alias("attrs"),
        F.split("page_text", "\n").alias("lines"),
    )
    clean = O.sanitize_nested(pages, keep=("page_id",))
    return clean.select(
        "page_id", F.col("state.url").alias("url"), F.col("state.parts")[0]["text"].alias("part_text"),
        F.col("state.parts")[0]["n"].alias("part_n"), F.map_keys("attrs")[0].alias("attr_key"),
        F.map_values("attrs")[0].alias("attr_value"), F.array_join("lines", "|").alias("lines"),
    )


def mask_password_values(spark, sf):
    return O.mask_password_values(_elements(spark, sf)).select("page_id", "ord", "value")


def sanitize_context(spark, sf):
    payload_pages, payload_elements = P.ingest_page_state_json(D.payloads(spark, sf))
    elements, pages, found = flows.sanitized_state(payload_elements, payload_pages)
    summary = _summary(O.privacy_summary(payload_pages, found))
    state = P.page_state(pages, elements.select("page_id", "ord", "tag", "text", "name", "value"))
    return summary.join(state, "page_id").select(
        "page_id", "findings", "pii_findings", "credential_findings", "types", "url", "title", "page_text",
        F.array_join(
            F.transform("elements", lambda e: F.concat_ws(":", e["tag"], e["text"], e["name"], e["value"])), "|"
        ).alias("elements"),
    )


def residual_leak_audit(spark, sf):
    elements = _elements(spark, sf)
    clean_elements, clean_pages, found = flows.sanitized_state(elements, D.form_pages(spark, sf))
    values = O.raw_values(found, elements)
    leaks = O.residual_leaks(values, clean_elements, clean_pages, every=True)
    per_value = leaks.groupBy("page_id", "value").agg(F.count("place").alias("leaks"))
    return per_value.groupBy("page_id").agg(F.count(F.lit(1)).alias("raw_values"), F.sum("leaks").alias("leaks"))


def leak_audit_unprotected(spark, sf):
    """The same audit over states where only password values are masked."""
    elements = _elements(spark, sf)
    pages = D.form_pages(spark, sf)
    values = O.raw_values(O.inspect_page(elements, pages), elements)
    return O.residual_leaks(values, O.mask_password_values(elements), pages)


def residual_leak_documents(spark, sf):
    """Values that survive value-based redaction of a document, counted per type."""
    rows = _documents(spark, sf).withColumn("f", pii_spans("text")).filter(F.size("f") > 0)
    rows = rows.select("doc_id", replace_values("text", F.col("f")).alias("clean"), F.explode("f").alias("f"))
    return rows.groupBy(F.col("f.type").alias("type")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("clean").contains(F.col("f.value"))).alias("leaks"),
        F.count_if(F.col("clean").contains(F.element_at(F.create_map(
            *[F.lit(x) for kv in fixed.TOKENS.items() for x in kv]), F.col("f.type")))).alias("with_token"),
    )


def detector_scorecard(spark, sf):
    """Labelled cases: each form field labelled with the type its column holds."""
    labels = F.create_map(*[F.lit(x) for kv in {
        "email": "[EMAIL]", "phone": "[PHONE]", "card": "[CREDIT_CARD]", "aadhaar": "[AADHAAR]", "pan": "[PAN]",
    }.items() for x in kv])
    cases = D.form_elements(spark, sf).filter(F.col("name").isin("email", "phone", "card", "aadhaar", "pan"))
    return O.detector_scorecard(
        cases.select(F.col("name").alias("kind"), F.col("value").alias("text"), F.element_at(labels, F.col("name")).alias("expected"))
    )


QUERIES = {
    "pii_by_language": pii_by_language,
    "detect_pii": detect_pii,
    "detect_email": _detect("email"),
    "detect_phone": _detect("phone"),
    "detect_credit_card": _detect("credit_card"),
    "detect_aadhaar": _detect("aadhaar"),
    "detect_pan": _detect("pan"),
    "credential_elements": credential_elements,
    "inspect_element": inspect_element,
    "inspect_text": inspect_text,
    "inspect_page": inspect_page,
    "sanitize_elements": sanitize_elements,
    "sanitize_page_text": sanitize_page_text,
    "sanitize_documents": sanitize_documents,
    "privacy_summary": privacy_summary,
    "replacement_lookup": replacement_lookup,
    "redact_display_text": redact_display_text,
    "sanitize_nested": sanitize_nested,
    "mask_password_values": mask_password_values,
    "sanitize_context": sanitize_context,
    "residual_leak_audit": residual_leak_audit,
    "leak_audit_unprotected": leak_audit_unprotected,
    "residual_leak_documents": residual_leak_documents,
    "detector_scorecard": detector_scorecard,
}
