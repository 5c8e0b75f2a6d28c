"""Readers: HTML pages, JSON page states, OCR words, model texts, table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewarden.functions import fixed
from pagewarden.functions.text import strip
from pagewarden.sources.answers import first_object_of
from pagewarden.sources.markup import element_spans_of

_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_CONTROLS = r"(?is)<(select|textarea)(?=[\s/>]).*?</\1\s*>"
_LINE_ENDS = r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr|td|option|title)\s*>"
# The rest of a tag after its name: a ">" inside a quoted value does not end it.
_TAG_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""
_ANY_TAG = "<" + _TAG_REST
# One attribute: a name, then a double-quoted, single-quoted, bare or no value.
_ATTRIBUTE = r"""[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))?"""
_VALUE = r"""(?s)\A[^\s=]+\s*(?:=\s*)?(?:"([^"]*)"|'([^']*)'|(.*))\z"""
# Named entities decoded in captured text.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
_NUMERIC = r"(?s)\A&#([xX][0-9a-fA-F]+|[0-9]+);?(.*)\z"


def _code_point(number: Column) -> Column:
    """Character of a decimal or x-prefixed number; U+FFFD where there is none."""
    is_hex = F.lower(F.substring(number, 1, 1)) == "x"
    digits = F.regexp_replace(number, "^[xX]?0*", "")
    code = F.when(F.length(digits) > 7, F.lit(0)).otherwise(
        F.coalesce(F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).try_cast("int"), F.lit(0))
    )
    none = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(none, F.lit(0xFFFD)).otherwise(code)), 8, "0")), "UTF-32")


def _decode(text: Column) -> Column:
    """Named and numeric entities, each decoded once, from left to right."""

    def piece(p: Column) -> Column:
        out = F.when(p.rlike(_NUMERIC), F.concat(_code_point(F.regexp_extract(p, _NUMERIC, 1)), F.regexp_extract(p, _NUMERIC, 2)))
        for entity, char in _ENTITIES:
            out = out.when(F.startswith(p, F.lit(entity)), F.concat(F.lit(char), F.substr(p, F.lit(len(entity) + 1))))
        return out.otherwise(p)

    pieces = F.transform(F.split(text, "(?=&)", -1), piece)
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def shown_html(html: Column | str) -> Column:
    """Markup without comments, scripts and styles."""
    source = F.col(html) if isinstance(html, str) else html
    return F.regexp_replace(F.coalesce(source, F.lit("")), _HIDDEN, "")


def shown_text(html: Column) -> Column:
    """Text of markup: line tags end a line, others vanish, blanks collapse."""
    lines = F.regexp_replace(html, _LINE_ENDS, "\n")
    bare = _decode(F.regexp_replace(lines, _ANY_TAG, ""))
    squeezed = F.regexp_replace(bare, "[ \\t]+", " ")
    return F.regexp_replace(F.regexp_replace(squeezed, " ?\\n[ \\n]*", "\n"), r"\A\s+|\s+\z", "")


def _attributes(tag: Column) -> Column:
    """Attributes of a start tag in order, as (name, value); a bare name has an empty value."""
    inside = F.regexp_replace(tag, r"\A<[a-zA-Z][^\s/>]*", "")
    return F.transform(
        F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), F.lit(0)),
        lambda a: F.struct(
            F.lower(F.regexp_extract(a, r"\A[^\s=]+", 0)).alias("name"), F.regexp_replace(a, _VALUE, "$1$2$3").alias("value")
        ),
    )


def _attribute(attributes: Column, name: str) -> Column:
    """Value of the first attribute of this name, empty without one."""
    first = F.get(F.filter(attributes, lambda a: a["name"] == name), F.lit(0))
    return F.coalesce(_decode(first["value"]), F.lit(""))


def scan_page_elements(pages: DataFrame) -> DataFrame:
    """HTML to element rows, ordered by kind and then by document position.

    ``label`` is the text of all labels of an element, those that name its id and
    those around it, in document order; the text of selects inside them is left out.
    """
    source = pages.select("page_id", F.posexplode(element_spans_of(shown_html("html"))).alias("ord", "e"))
    rows = source.select("page_id", "ord", "e.*", _attributes(F.col("e.start")).alias("_a"))
    text = F.when(F.col("tag") == "input", F.lit("")).otherwise(shown_text(F.col("inner")))
    label = F.transform("labels", lambda inner: shown_text(F.regexp_replace(inner, _CONTROLS, "")))
    return rows.select(
        "page_id", "ord", "type", "tag",
        _attribute(F.col("_a"), "role").alias("role"),
        text.alias("text"),
        _attribute(F.col("_a"), "aria-label").alias("aria_label"),
        _attribute(F.col("_a"), "placeholder").alias("placeholder"),
        _attribute(F.col("_a"), "type").alias("input_type"),
        _attribute(F.col("_a"), "name").alias("name"),
        _attribute(F.col("_a"), "id").alias("id"),
        _attribute(F.col("_a"), "value").alias("value"),
        _attribute(F.col("_a"), "href").alias("href"),
        F.array_join(label, " ").alias("label"),
        (~F.exists("_a", lambda a: a["name"] == "disabled")).alias("enabled"),
    )


def visible_elements(captured: DataFrame) -> DataFrame:
    """Elements that were visible and had a positive size."""
    return captured.filter(
        F.col("visible") & (F.col("box.width") > 0) & (F.col("box.height") > 0)
    )


def page_text(pages: DataFrame) -> DataFrame:
    body = shown_html("html")
    return pages.select(
        "page_id",
        _decode(F.regexp_extract(body, rf"(?is)<title(?=[\s/>]){_TAG_REST}(.*?)</title\s*>", 1)).alias("title"),
        shown_text(F.regexp_replace(body, r"(?is)<head\b.*?</head\s*>", "")).alias("page_text"),
    )


def gather_in_order(
    rows: DataFrame, key: str, order: str, item: Column, name: str, block: int = 512
) -> DataFrame:
    """Array of items per key in order: gathered per run of ordinals, then joined.

    Sorting happens within runs, spread over tasks; the result row is as long as
    the key's data by definition.
    """
    parts = (
        rows.select(key, F.col(order).alias("_o"), item.alias("_i"))
        .groupBy(key, F.floor(F.col("_o") / block).alias("_b"))
        .agg(F.sort_array(F.collect_list(F.struct("_o", "_i"))).alias("_p"))
        .select(key, "_b", F.transform("_p", lambda p: p["_i"]).alias("_p"))
    )
    return parts.groupBy(key).agg(
        F.flatten(
            F.transform(F.sort_array(F.collect_list(F.struct("_b", "_p"))), lambda p: p["_p"])
        ).alias(name)
    )


ELEMENT_COLUMNS = (
    "ord", "type", "tag", "role", "text", "aria_label", "placeholder",
    "input_type", "name", "id", "value", "enabled",
)


def page_state(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """One row per page with its elements as an ordered array."""
    columns = [c for c in ELEMENT_COLUMNS if c in elements.columns]
    arrays = gather_in_order(elements, "page_id", "ord", F.struct(*columns), "elements")
    return pages.select("page_id", "url", "title", "page_text").join(arrays, "page_id", "left")


def _kind(value: Column) -> Column:
    """JSON type of a variant, null when it is missing."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def json_text(value: Column) -> Column:
    """A JSON value as text: strings bare, null as None, booleans capitalised."""
    kind = _kind(value)
    return (
        F.when(value.isNull(), F.lit(""))
        .when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(value, "$", "string")))
        .when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        .otherwise(F.to_json(value))
    )


def _string_field(element: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(element, f"$.{name}", "string"), F.lit(""))


def payload_states(payloads: DataFrame) -> DataFrame:
    """JSON payloads to typed page states, elements as an array; no shuffle.

    Missing fields take defaults, elements that are no objects are dropped, and
    the element type, role and visibility are not part of the result.
    """
    fields = payloads.withColumn("_p", F.try_parse_json("payload")).select(
        *payloads.columns,
        *[
            F.try_variant_get("_p", f"$.{n}", "variant").alias(f"_{n}")
            for n in ("url", "title", "page_text", "elements")
        ],
    )

    def element(e: Column) -> Column:
        return F.struct(
            *[_string_field(e, n).alias(n) for n in PAYLOAD_FIELDS],
            F.coalesce(F.try_variant_get(e, "$.enabled", "boolean"), F.lit(True)).alias("enabled"),
            F.try_variant_get(e, "$.box", "struct<x:double,y:double,width:double,height:double>").alias("box"),
        )

    items = F.when(
        _kind(F.col("_elements")) == "ARRAY", F.try_variant_get("_elements", "$", "array<variant>")
    ).otherwise(F.array().cast("array<variant>"))
    return fields.select(
        *[c for c in payloads.columns if c != "payload"],
        json_text(F.col("_url")).alias("url"),
        json_text(F.col("_title")).alias("title"),
        F.when(_kind(F.col("_page_text")) == "STRING", F.try_variant_get("_page_text", "$", "string"))
        .otherwise(F.lit(""))
        .alias("page_text"),
        F.transform(F.filter(items, lambda e: _kind(e) == "OBJECT"), element).alias("elements"),
    )


PAYLOAD_FIELDS = (
    "tag", "text", "aria_label", "placeholder", "name", "id", "input_type", "value",
)


def ingest_page_state_json(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON payloads to a page table and an element table."""
    states = payload_states(payloads)
    elements = states.select("page_id", F.posexplode("elements").alias("ord", "e"))
    return states.drop("elements"), elements.select("page_id", "ord", "e.*")


def scan_ocr_tokens(words: DataFrame) -> DataFrame:
    """Raw words to tokens: text stripped, blanks and negative confidence dropped."""
    cleaned = words.withColumn("text", strip("text")).withColumn(
        "conf", F.coalesce(F.expr("try_cast(conf as double)"), F.lit(-1.0))
    )
    return cleaned.filter((F.col("text") != "") & (F.col("conf") >= 0))


def ocr_page_text(tokens: DataFrame) -> DataFrame:
    """Token texts joined by blanks in scan order, one row per image."""
    parts = tokens.groupBy("image_id", "line_num").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("word_no", "text"))), lambda t: t["text"]), " "
        ).alias("line")
    )
    return parts.groupBy("image_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("line_num", "line"))), lambda t: t["line"]), " "
        ).alias("ocr_text")
    )


def whole_json(text: Column) -> Column:
    """Variant of a text that is one JSON value and nothing else, else null.

    The parser stops after the first value, so trailing text goes unseen. It
    cannot go unseen both inside an array and inside an object: what closes one
    early breaks the other.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(
        in_array.isNotNull() & in_object.isNotNull(), F.try_variant_get(in_object, "$.v", "variant")
    )


def parse_plan_array(texts: DataFrame, text: str = "model_text") -> DataFrame:
    """First ``[`` to last ``]`` as JSON, or null."""
    span = F.regexp_extract(F.col(text), r"(?s)\[.*\]", 0)
    return texts.withColumn(
        "plan", F.when(span != "", F.try_variant_get(whole_json(span), "$", "array<variant>"))
    )


def parse_plan_object(texts: DataFrame, text: str = "model_text") -> DataFrame:
    """Whole text as JSON after removing code fences, else the first object in it."""
    bare = strip(F.col(text))
    bare = F.regexp_replace(bare, r"(?iU)\A```(?:json)?\s*", "")
    bare = F.regexp_replace(bare, r"(?U)\s*```\z", "")
    marked = texts.withColumn("_t", bare).withColumn("_w", whole_json(F.col("_t")))
    first = F.try_parse_json(first_object_of(F.when(F.col("_w").isNull(), F.col("_t"))))
    return marked.withColumn("plan", F.coalesce("_w", first)).drop("_t", "_w")


def html_table_rows(pages: DataFrame) -> DataFrame:
    """Cells of ``table tbody tr``: row_no counts non-empty rows from 1."""
    bodies = F.regexp_extract_all(shown_html("html"), F.lit(rf"(?is)<tbody(?=[\s/>]){_TAG_REST}(.*?)</tbody\s*>"), F.lit(1))
    rows = F.flatten(
        F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit(rf"(?is)<tr(?=[\s/>]){_TAG_REST}(.*?)</tr\s*>"), F.lit(1)))
    )
    cells = F.transform(
        rows,
        lambda r: F.filter(
            F.transform(
                F.regexp_extract_all(r, F.lit(rf"(?is)<td(?=[\s/>]){_TAG_REST}(.*?)</td\s*>"), F.lit(1)),
                shown_text,
            ),
            lambda c: c != "",
        ),
    )
    filled = F.filter(cells, lambda r: F.size(r) > 0)
    return (
        pages.select("page_id", F.posexplode_outer(filled).alias("_n", "cells"))
        .filter(F.col("cells").isNotNull())
        .select("page_id", (F.col("_n") + 1).alias("row_no"), "cells")
    )


def top_rows(rows: DataFrame, limit: int = 3) -> DataFrame:
    """First rows per page; the rank limit is applied before the exchange."""
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy("page_id").orderBy("row_no")))
    return ranked.filter(F.col("_n") <= limit).drop("_n")


def _numbered_lines(pages: DataFrame, lines: Column) -> DataFrame:
    return (
        pages.select("page_id", F.posexplode_outer(lines).alias("_n", "line"))
        .filter(F.col("line").isNotNull())
        .select("page_id", (F.col("_n") + 1).alias("row_no"), F.array("line").alias("cells"))
    )


def transaction_lines(pages: DataFrame) -> DataFrame:
    """Non-blank page-text lines that look like a transaction, in order."""
    trimmed = F.transform(F.split("page_text", "\n", -1), lambda t: F.trim(t))
    wanted = F.filter(trimmed, lambda t: (t != "") & t.rlike(f"(?i){fixed.TRANSACTION_LINE}"))
    return _numbered_lines(pages, wanted)


def transaction_cards(pages: DataFrame) -> DataFrame:
    """Elements whose class names a transaction, each as its non-blank lines."""
    found = F.regexp_extract_all(
        shown_html("html"),
        F.lit(r'(?s)<(?:div|p|li)\b[^>]*\sclass="[^"]*[tT]ransaction[^"]*"[^>]*>(.*?)</(?:div|p|li)\s*>'),
        F.lit(1),
    )
    cards = F.filter(
        F.transform(
            found,
            lambda c: F.filter(
                F.transform(F.split(shown_text(c), "\n", -1), lambda t: F.trim(t)), lambda t: t != ""
            ),
        ),
        lambda c: F.size(c) > 0,
    )
    return (
        pages.select("page_id", F.posexplode_outer(cards).alias("_n", "cells"))
        .filter(F.col("cells").isNotNull())
        .select("page_id", (F.col("_n") + 1).alias("row_no"), "cells")
    )


def last_writes(writes: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Store semantics: the last write of a key wins. Combined map-side."""
    latest = writes.groupBy(key).agg(F.max(F.struct(*order, *columns)).alias("_w"))
    return latest.select(key, *[F.col(f"_w.{c}").alias(c) for c in columns])


def prompt_rows(tasks: DataFrame, states: DataFrame) -> DataFrame:
    """One prompt per task from its sanitized page state."""
    shaped = states.select(
        "page_id", "url", "title", "page_text", F.to_json("elements").alias("elements_json")
    )
    return tasks.join(shaped, "page_id").withColumn(
        "prompt",
        F.concat_ws(
            "\n", F.concat(F.lit("Task: "), F.col("task")), F.concat(F.lit("Address: "), F.col("url")),
            F.concat(F.lit("Title: "), F.col("title")), F.concat(F.lit("Elements: "), F.col("elements_json")),
            F.concat(F.lit("Text: "), F.col("page_text")),
            F.lit("Answer with one JSON object holding status, reason and actions."),
        ),
    )
