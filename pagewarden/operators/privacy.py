"""Detection, redaction and audit of private data in pages and elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewarden.functions import fixed
from pagewarden.functions.joins import rare_contains_join
from pagewarden.functions.numbering import number_within
from pagewarden.functions.pii import (
    is_credential,
    pii_spans,
    redact_display,
    replace_values,
    token_map,
    token_of,
)
from pagewarden.functions.staging import staged

# Order of findings within a page: elements in order, the text last; within an
# element the credential first, then fields, then spans.
FINDING_ORDER = ["is_text", "elem_ord", "is_pii", "field_no", "start", "pattern_no"]
_FINDING_TYPE = (
    "array<struct<is_pii:int,field_no:int,start:int,pattern_no:int,"
    "field:string,type:string,value:string>>"
)
# Elements of a page are numbered in runs of this many.
_ORD_BLOCK = 4096
# Fields of a page with so many elements at most are tested one by one for its raw values.
PAIRED_ELEMENTS = 64


def detect_pii(
    texts: DataFrame, key: str, text: str = "text", types: tuple[str, ...] | None = None
) -> DataFrame:
    """One row per match: key, seq, type, value, start, end."""
    found = texts.select(key, F.posexplode_outer(pii_spans(text, types)).alias("seq", "f"))
    return found.filter(F.col("f").isNotNull()).select(
        key, "seq", "f.type", "f.value", "f.start", "f.end"
    )


def credential_flag(get=F.col) -> Column:
    return is_credential(*[get(c) for c in ("input_type", "name", "id", "placeholder", "aria_label")])


def credential_elements(elements: DataFrame) -> DataFrame:
    return elements.filter(credential_flag()).select("page_id", F.col("ord").alias("elem_ord"))


def element_findings_expr(get=F.col) -> Column:
    """Findings of one element, in order, as an array; no shuffle needed.

    ``get`` yields a field of the element: a column, or a field of a struct.
    """
    credential = F.when(
        credential_flag(get),
        F.array(
            F.struct(
                F.lit(0).alias("is_pii"), F.lit(-1).alias("field_no"), F.lit(0).alias("start"),
                F.lit(0).alias("pattern_no"), F.lit(None).cast("string").alias("field"),
                F.lit("credential").alias("type"), F.lit(None).cast("string").alias("value"),
            )
        ).cast(_FINDING_TYPE),
    ).otherwise(F.array().cast(_FINDING_TYPE))
    # One detection expression over an array of fields, not one per field.
    fields = F.array(
        *[
            F.struct(F.lit(n).alias("no"), F.lit(f).alias("field"), F.coalesce(get(f), F.lit("")).alias("text"))
            for n, f in enumerate(fixed.INSPECTED_FIELDS)
        ]
    )

    def of_field(field: Column) -> Column:
        def finding(span: Column) -> Column:
            return F.struct(
                F.lit(1).alias("is_pii"), field["no"].alias("field_no"), span["start"].alias("start"),
                span["pattern_no"].alias("pattern_no"), field["field"].alias("field"),
                span["type"].alias("type"), span["value"].alias("value"),
            )

        return F.transform(pii_spans(field["text"]), finding)

    found = F.flatten(F.transform(F.filter(fields, lambda f: f["text"] != ""), of_field))
    return F.concat(credential, found.cast(_FINDING_TYPE))


def inspect_elements(elements: DataFrame) -> DataFrame:
    """One row per element finding."""
    rows = elements.select(
        "page_id",
        F.lit(0).alias("is_text"),
        F.col("ord").alias("elem_ord"),
        F.explode_outer(element_findings_expr()).alias("f"),
    ).filter(F.col("f").isNotNull())
    return rows.select(
        "page_id", "is_text", "elem_ord", "f.is_pii", "f.field_no", "f.start",
        "f.pattern_no", "f.field", "f.type", "f.value",
    )


def inspect_text(pages: DataFrame, text: str = "page_text") -> DataFrame:
    """One row per finding of a page text; no element."""
    rows = pages.select("page_id", F.explode_outer(pii_spans(text)).alias("f")).filter(
        F.col("f").isNotNull()
    )
    return rows.select(
        "page_id", F.lit(1).alias("is_text"), F.lit(None).cast("int").alias("elem_ord"),
        F.lit(1).alias("is_pii"), F.lit(-1).alias("field_no"), "f.start", "f.pattern_no",
        F.lit(text).alias("field"), "f.type", "f.value",
    )


def inspect_page(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """All findings with their order columns; the order is a key, not a position."""
    return inspect_elements(elements).unionByName(inspect_text(pages))


def numbered_findings(findings: DataFrame) -> DataFrame:
    """Add the dense position of each finding within its page."""
    block = F.col("is_text") * F.lit(1 << 40) + F.coalesce(
        F.floor(F.col("elem_ord") / _ORD_BLOCK), F.lit(0)
    )
    return number_within(findings, ["page_id"], block, FINDING_ORDER, "seq")


def inspect_states(states: DataFrame) -> DataFrame:
    """Numbered findings of rows that hold a page and its elements as an array.

    A page's findings are put in order within its row, so nothing is exchanged,
    raw values least of all. Elements are taken by their ``ord``, the text last.
    A null array is a page without elements.
    """
    kind = "array<struct<elem_ord:int,field:string,type:string,value:string>>"

    def in_order(a: Column, b: Column) -> Column:
        return F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)

    def of_element(e: Column) -> Column:
        return F.transform(
            element_findings_expr(e.getField),
            lambda f: F.struct(e["ord"].cast("int").alias("elem_ord"), f["field"], f["type"], f["value"]),
        ).cast(kind)

    elements = F.coalesce(F.array_sort("elements", in_order), F.array())
    of_text = F.transform(
        pii_spans("page_text"),
        lambda s: F.struct(F.lit(None).cast("int").alias("elem_ord"), F.lit("page_text").alias("field"), s["type"], s["value"]),
    )
    listed = F.concat(F.flatten(F.transform(elements, of_element)), F.coalesce(of_text.cast(kind), F.array().cast(kind)))
    rows = states.select("page_id", F.posexplode_outer(listed).alias("seq", "f")).filter(F.col("f").isNotNull())
    return rows.select("page_id", (F.col("seq") + 1).cast("long").alias("seq"), "f.elem_ord", "f.field", "f.type", "f.value")


def folded_field(name: str, value: Column, findings: Column) -> Column:
    """One field of an element after its findings, applied in order."""

    def step(acc: Column, f: Column) -> Column:
        token = token_of(f["type"])
        by_value = F.when(f["value"].isNotNull(), F.replace(acc, f["value"], token))
        if name == "value":
            by_value = by_value.when(acc != "", token)
        return by_value.otherwise(acc)

    start = F.coalesce(value, F.lit(""))
    return F.when(F.size(findings) > 0, F.aggregate(findings, start, step)).otherwise(start)


def sanitize_elements(elements: DataFrame) -> DataFrame:
    """Apply each element's own findings, in order, to its five fields.

    A finding with a value is replaced literally in all fields; one without a
    value overwrites a filled ``value``. Everything stays within the row.
    """
    marked = elements.withColumn("_f", element_findings_expr())
    return marked.withColumns(
        {n: folded_field(n, F.col(n), F.col("_f")) for n in fixed.INSPECTED_FIELDS}
    ).drop("_f")


def sanitize_page_text(pages: DataFrame, findings: DataFrame, text: str = "page_text") -> DataFrame:
    """Replace every page finding's value in the page text, in finding order.

    The text's own findings are folded within the row. A value found in an
    element matters only where the text contains it, and replaced text cannot
    produce a new one (tokens share no character run with any value), so the
    element values are made distinct per page, joined, and tested against the
    original text before anything is gathered. What is gathered per page is
    bounded by its text. Values of a page with very many elements are split by
    AQE in that join, as its text is a single row.
    """
    values = (
        findings.filter((F.col("is_text") == 0) & F.col("value").isNotNull())
        .groupBy("page_id", "value")
        .agg(
            F.min(F.struct("is_text", "elem_ord", "is_pii", "field_no", "start", "pattern_no", "type"))
            .alias("at")
        )
    )
    present = (
        values.join(pages.select("page_id", text), "page_id")
        .filter(F.col(text).contains(F.col("value")))
        .groupBy("page_id")
        .agg(F.sort_array(F.collect_list(F.struct("at", F.col("at.type").alias("type"), "value"))).alias("_vs"))
        .select(
            "page_id",
            F.transform("_vs", lambda v: F.struct(v["type"].alias("type"), v["value"].alias("value"))).alias("_vs"),
        )
    )
    own = F.transform(
        pii_spans(text), lambda s: F.struct(s["type"].alias("type"), s["value"].alias("value"))
    )
    kind = "array<struct<type:string,value:string>>"
    return (
        pages.join(present, "page_id", "left")
        .withColumn(
            text,
            replace_values(
                text,
                F.concat(F.coalesce(F.col("_vs").cast(kind), F.array().cast(kind)), own.cast(kind)),
            ),
        )
        .drop("_vs")
    )


def sanitize_text_column(texts: DataFrame, text: str = "text") -> DataFrame:
    """Texts that stand alone: own findings only, within the row."""
    return texts.withColumn(text, replace_values(text, pii_spans(text)))


def privacy_summary(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Counts and types in first-seen order, one row per page.

    Counted per page and type first (map-side combine), so a page with very
    many findings reaches the second step as at most six rows.
    """
    per_type = findings.groupBy("page_id", "type").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*FINDING_ORDER)).alias("first")
    )
    per_page = per_type.groupBy("page_id").agg(
        F.sum("n").alias("findings"),
        F.sum(F.when(F.col("type") != "credential", F.col("n")).otherwise(0)).alias("pii_findings"),
        F.sum(F.when(F.col("type") == "credential", F.col("n")).otherwise(0)).alias("credential_findings"),
        F.sort_array(F.collect_list(F.struct("first", "type"))).alias("_t"),
    )
    zero = F.lit(0).cast("bigint")
    return pages.select("page_id").join(per_page, "page_id", "left").select(
        "page_id",
        F.coalesce("findings", zero).alias("findings"),
        F.coalesce("pii_findings", zero).alias("pii_findings"),
        F.coalesce("credential_findings", zero).alias("credential_findings"),
        F.coalesce(F.transform("_t", lambda t: t["type"]), F.array().cast("array<string>")).alias("types"),
    )


def sanitize_states(states: DataFrame) -> DataFrame:
    """Whole protect step for rows that hold a page and its elements as an array.

    All findings of a page come from its own row, so nothing is shuffled: the
    same map serves batches and streams. Adds findings counts and types.
    """

    def own_findings(e: Column) -> Column:
        return element_findings_expr(e.getField)

    def clean(z: Column) -> Column:
        e, found = z["elements"], z["_fs"]
        return F.struct(
            *[
                (folded_field(c, e[c], found) if c in fixed.INSPECTED_FIELDS else e[c]).alias(c)
                for c in columns
            ]
        )

    columns = states.schema["elements"].dataType.elementType.fieldNames()
    text_findings = F.transform(
        pii_spans("page_text"), lambda s: F.struct(s["type"].alias("type"), s["value"].alias("value"))
    )
    rows = states.withColumn("_fs", F.transform("elements", own_findings)).withColumn(
        "_all",
        F.concat(
            F.transform(
                F.flatten("_fs"), lambda f: F.struct(f["type"].alias("type"), f["value"].alias("value"))
            ),
            text_findings,
        ),
    )
    secret = F.size(F.filter("_all", lambda f: f["type"] == "credential"))
    return rows.withColumns(
        {
            "elements": F.transform(F.arrays_zip("elements", "_fs"), clean),
            "page_text": replace_values("page_text", F.col("_all")),
            "findings": F.size("_all"),
            "pii_findings": F.size("_all") - secret,
            "credential_findings": secret,
            "types": F.array_distinct(F.transform("_all", lambda f: f["type"])),
        }
    ).drop("_fs", "_all")


def replacement_tokens(findings: DataFrame) -> DataFrame:
    """Findings with the token that stands for their type (a fixed six-entry map)."""
    return findings.withColumn("token", F.element_at(token_map(), F.col("type")))


def redact_column(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: redact_display(c) for c in columns})


def _redact_tree(value: Column, kind: T.DataType) -> Column:
    """Redact each string leaf of a nested value; keys and other leaves stay."""
    if isinstance(kind, T.StringType):
        return redact_display(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _redact_tree(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: _redact_tree(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(
            value.isNotNull(),
            F.struct(*[_redact_tree(value[f.name], f.dataType).alias(f.name) for f in kind.fields]),
        )
    return value


def sanitize_nested(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Redact every string inside the nested columns, following the schema."""
    return df.select(
        *[
            F.col(f.name) if f.name in keep else _redact_tree(F.col(f.name), f.dataType).alias(f.name)
            for f in df.schema.fields
        ]
    )


def mask_password_values(elements: DataFrame) -> DataFrame:
    """Password inputs lose their value, even an empty one."""
    return elements.withColumn(
        "value",
        F.when(F.lower("input_type") == "password", F.lit(fixed.TOKENS["credential"])).otherwise(
            F.col("value")
        ),
    )


def raw_values(findings: DataFrame, elements: DataFrame) -> DataFrame:
    """Distinct values that must vanish: found values and credential values."""
    found = findings.filter(F.col("value").isNotNull()).select("page_id", "value")
    secrets = elements.filter(credential_flag() & (F.col("value") != "")).select("page_id", "value")
    return found.unionByName(secrets).distinct()


def _wide_pages(elements: DataFrame) -> DataFrame | None:
    """Ids of pages with more than ``PAIRED_ELEMENTS`` elements; None when there are none."""
    counts = elements.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    wide = staged(counts.filter(F.col("n") > PAIRED_ELEMENTS).select("page_id"))
    return None if wide.isEmpty() else wide


def residual_leaks(
    values: DataFrame, sanitized_elements: DataFrame, sanitized_pages: DataFrame,
    columns: tuple[str, ...] = fixed.INSPECTED_FIELDS, every: bool = False,
) -> DataFrame:
    """Raw values (page_id, value) that still occur after redaction, with the place.

    A value is tested against the texts of its page and, where the page has
    ``PAIRED_ELEMENTS`` elements at most, against all their fields: values are read
    once and meet a bounded number of strings. On larger pages distinct values meet
    distinct field strings that have their rarest gram, not every field of the page.
    With ``every`` each value also has a row when it occurs nowhere; rows without a
    place stand for no leak.
    """
    page_columns = [c for c in ("page_text", "url", "title") if c in sanitized_pages.columns]

    def strings(rows: DataFrame, names, on_page: bool) -> DataFrame:
        placed = F.array(*[F.struct(F.lit(c).alias("place"), F.col(c).alias("hay")) for c in names])
        return rows.select("page_id", F.inline(placed)).filter(F.col("hay") != "").withColumn("on_page", F.lit(on_page))

    fields = strings(sanitized_elements, columns, False)
    wide = _wide_pages(sanitized_elements)
    paired = fields if wide is None else fields.join(wide, "page_id", "left_anti")
    hays = strings(sanitized_pages, page_columns, True).unionByName(paired).withColumnRenamed("page_id", "_page")
    held = F.col("hay").contains(F.col("value")) & (F.col("on_page") | (F.col("value") != ""))
    met = values.join(hays, (F.col("page_id") == F.col("_page")) & held, "left" if every else "inner")
    # A field of many elements is one place; a page that comes twice counts twice.
    once = met.groupBy("page_id", "value", "place").agg(F.count_if("on_page").cast("int").alias("n"))
    found = once.select("page_id", "value", "place", F.explode(F.array_repeat(F.lit(1), F.greatest("n", F.lit(1)))).alias("_")).drop("_")
    if wide is None:
        return found
    spread = fields.join(wide, "page_id", "left_semi")
    hits = rare_contains_join(values.join(wide, "page_id", "left_semi"), spread, ["page_id"], "value", "hay")
    in_fields = hits.join(spread.select("page_id", "hay", "place").distinct(), ["page_id", "hay"]).select("page_id", "value", "place")
    return found.unionByName(in_fields.distinct())


def detector_scorecard(cases: DataFrame) -> DataFrame:
    """cases(kind, text, expected): pass when the token is there and the text is not."""
    scored = cases.select(
        "kind", "expected", "text", replace_values("text", pii_spans("text")).alias("clean")
    ).select(
        "kind",
        (F.col("clean").contains(F.col("expected")) & ~F.col("clean").contains(F.col("text"))).alias("ok"),
    )
    return scored.groupBy("kind").agg(
        F.count_if("ok").alias("passed"),
        F.count(F.lit(1)).alias("total"),
        F.round(100.0 * F.count_if("ok") / F.count(F.lit(1)), 2).alias("accuracy"),
    )
