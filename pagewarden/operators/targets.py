"""Target resolution: which element of a page an action's target means.

Nothing here pairs every request with every element of its page. Requests are
made distinct first; elements are turned into keyed facts (how many elements
answer to a key, which comes first, its label) by one partial aggregation; each
request then looks its keys up by an equi-join, one row per rule it may match.
Substring rules go through the gram join. The lowest rule number wins. Rules that
score words are answered in packed rows, see ``profiles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewarden.functions import fixed
from pagewarden.functions.joins import contains_join, only_asked
from pagewarden.functions.staging import staged
from pagewarden.functions.text import (
    first_filled,
    first_visible,
    ident,
    js_trim,
    squash,
    strip,
    text_or_blank,
    word_form,
)
from pagewarden.operators import profiles

IDENTIFIERS = ("text", "aria_label", "placeholder", "name", "id")


def distinct_requests(requests: DataFrame, on: list[str]) -> DataFrame:
    """Each request once, kept: the log is read once, not once per rule."""
    return staged(requests.select(*on).distinct())


def _distinct_keys(*keys: Column) -> Column:
    """Non-null keys of one row, each once."""
    return F.array_distinct(F.array_compact(F.array(*keys)))


def _prefixed(prefix: str, value: Column) -> Column:
    """Key of a value, null when the value is empty."""
    return F.when(value != "", F.concat(F.lit(prefix), value))


def _lookup(requests: DataFrame, on: list[str], keys: Column, facts: DataFrame) -> DataFrame:
    """Facts a request's keys hit; ``keys`` is an array of (rule_no, key)."""
    asked = requests.select(*on, F.explode(keys).alias("_k")).select(
        *on, F.col("_k.rule_no").alias("rule_no"), F.col("_k.key").alias("key")
    )
    return asked.filter(F.col("key").isNotNull()).join(facts, ["page_id", "key"])


def _rules(*keys: Column) -> Column:
    return F.array(
        *[F.struct(F.lit(n).alias("rule_no"), k.alias("key")) for n, k in enumerate(keys)]
    )


# ---------------------------------------------------------------- exact match

def selector_key(target: Column) -> Column:
    """Key of a selector-like target; the first form that parses decides."""
    stripped = strip(text_or_blank(target))
    result = None
    for form, tag, attribute, _, _ in fixed.SELECTOR_FORMS:
        pattern = (
            rf"(?iU)\A{tag}\s*\[\s*{attribute}\s*=\s*['\"]([^'\"]+)['\"]\s*\]\z"
        )
        key = F.concat(F.lit(f"{form}|"), ident(F.regexp_extract(stripped, pattern, 1)))
        result = F.when(stripped.rlike(pattern), key) if result is None else result.when(
            stripped.rlike(pattern), key
        )
    return result


def exact_key(target: Column) -> Column:
    return _prefixed("exact|", ident(target))


def match_facts(elements: DataFrame) -> DataFrame:
    """(page_id, key) to the elements that answer to it, exact and selector keys."""
    exact = [_prefixed("exact|", ident(c)) for c in IDENTIFIERS]
    forms = [
        F.when(
            F.col("type").isin(*types), F.concat(F.lit(f"{form}|"), ident(column))
        )
        for form, _, _, types, column in fixed.SELECTOR_FORMS
    ]
    rows = elements.select(
        "page_id", "ord", F.explode(_distinct_keys(*exact, *forms)).alias("key"),
        first_filled("placeholder", "aria_label", "name", "id").alias("type_label"),
        first_filled("text", "aria_label").alias("click_label"),
        F.col("type").isin("input", "textarea").alias("is_input"),
        F.col("type").isin("button", "link").alias("is_click"),
    )
    return rows.groupBy("page_id", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("ord", "type_label", "click_label")).alias("first"),
        F.bool_or("is_input").alias("any_input"),
        F.bool_or("is_click").alias("any_click"),
    )


def _element_keys(elements: DataFrame, keys: list[Column]) -> DataFrame:
    return elements.select("page_id", "ord", F.explode(_distinct_keys(*keys)).alias("key"))


def match_exact(requests: DataFrame, elements: DataFrame) -> DataFrame:
    """All elements an identifier of which equals the target, per distinct target."""
    asked = requests.select("page_id", ident("target").alias("target")).filter(F.col("target") != "").distinct()
    elements = only_asked(elements, asked, ["page_id"])
    found = _element_keys(elements, [F.nullif(ident(c), F.lit("")) for c in IDENTIFIERS])
    return asked.join(found.withColumnRenamed("key", "target"), ["page_id", "target"])


def match_selector(requests: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements a selector-like target names, where no exact match exists."""
    exact = match_exact(requests, elements).select("page_id", "target").distinct()
    asked = (
        requests.select("page_id", ident("target").alias("target"), selector_key(F.col("target")).alias("key"))
        .filter(F.col("key").isNotNull())
        .distinct()
        .join(exact, ["page_id", "target"], "left_anti")
    )
    forms = [
        F.when(F.col("type").isin(*types), F.concat(F.lit(f"{form}|"), ident(column)))
        for form, _, _, types, column in fixed.SELECTOR_FORMS
    ]
    return asked.join(_element_keys(elements, forms), ["page_id", "key"]).select("page_id", "target", "key", "ord")


def resolve_targets(requests: DataFrame, elements: DataFrame) -> DataFrame:
    """Distinct (page_id, action, target) with match facts and canonical target.

    Added columns: ``n`` matches, ``canonical`` (null when nothing matched),
    ``canonical_n``, ``any_input`` and ``any_click`` of the final target.
    """
    on = ["page_id", "action", "target"]
    asked = distinct_requests(requests, on)
    facts = match_facts(only_asked(elements, asked, ["page_id"]))
    hits = _lookup(asked, on, _rules(exact_key(F.col("target")), selector_key(F.col("target"))), facts)
    best = hits.groupBy(*on).agg(
        F.min(F.struct("rule_no", "n", "first", "any_input", "any_click")).alias("m")
    )
    kind = F.lower(strip(text_or_blank("action")))
    label = F.when(kind == "type", F.col("m.first.type_label")).when(
        kind == "click", F.col("m.first.click_label")
    )
    first = best.select(
        *on, F.col("m.n").alias("n"), F.col("m.any_input").alias("_input"),
        F.col("m.any_click").alias("_click"), label.alias("_label"),
    )
    # A relabelled target is an identifier of the element it came from.
    second = facts.select(
        "page_id", F.col("key").alias("_key"), F.col("n").alias("_n2"),
        F.col("any_input").alias("_input2"), F.col("any_click").alias("_click2"),
    )
    resolved = first.withColumn("_key", exact_key(F.col("_label"))).join(second, ["page_id", "_key"], "left")
    changed = F.col("_label").isNotNull()
    return resolved.select(
        *on, "n",
        F.coalesce("_label", "target").alias("canonical"),
        F.when(changed, F.coalesce("_n2", F.lit(0))).otherwise(F.col("n")).alias("canonical_n"),
        F.coalesce(F.when(changed, F.col("_input2")).otherwise(F.col("_input")), F.lit(False)).alias("any_input"),
        F.coalesce(F.when(changed, F.col("_click2")).otherwise(F.col("_click")), F.lit(False)).alias("any_click"),
    )


# ---------------------------------------------------------------- scored match

_KINDS = {
    "any": ("button", "input", "textarea", "select", "a"),
    "type": ("input", "textarea"),
    "select": ("select",),
    "click": ("button", "a"),
}


def _kinds() -> Column:
    tag = F.lower(F.coalesce(F.nullif(F.col("type"), F.lit("")), F.col("tag"), F.lit("")))
    return F.array_compact(F.array(*[F.when(tag.isin(*tags), F.lit(kind)) for kind, tags in _KINDS.items()]))


def eligible_elements(elements: DataFrame) -> DataFrame:
    """Element rows per target kind they may serve; passwords serve none."""
    return elements.filter(F.lower(text_or_blank("input_type")) != "password").withColumn(
        "kind", F.explode(_kinds())
    )


def _packed_requests(requests: DataFrame) -> DataFrame:
    """Distinct requests with the keys the rules ask for; blank targets ask for nothing."""
    on = ["page_id", "kind", "target"]
    return (
        requests.select(*on).distinct().withColumn("key", ident("target")).filter(F.col("key") != "")
        .withColumns({"form": word_form("key"), "group": alias_group(F.col("target"))})
    )


def _packed_elements(elements: DataFrame, payload: Column | None = None) -> DataFrame:
    """Elements with all kinds they may serve, identifiers, word form and alias groups."""
    form = word_form(F.concat_ws(" ", *[ident(c) for c in IDENTIFIERS]))
    groups = [F.when(F.col("form").rlike("|".join(names)), F.lit(group)) for group, names in _alias_forms().items()]
    return (
        elements.filter(F.lower(text_or_blank("input_type")) != "password")
        .select(
            "page_id", "ord", _kinds().alias("kinds"), form.alias("form"),
            _distinct_keys(*[F.nullif(ident(c), F.lit("")) for c in IDENTIFIERS]).alias("ids"),
            (F.struct(F.lit(None).cast("int").alias("none")) if payload is None else payload).alias("payload"),
        )
        .withColumn("groups", F.array_compact(F.array(*groups)))
    )


def match_scored(requests: DataFrame, elements: DataFrame) -> DataFrame:
    """Best-scoring element per (page_id, kind, target), with the size of the tie.

    100 for an equal word form, 20 per target word that is a whole word, else 5
    when it occurs inside one.
    """
    won = profiles.answers(_packed_requests(requests), _packed_elements(elements))
    best = won.select("page_id", "kind", "target", profiles.ruled(F.col("won"), profiles.SCORED).alias("b"))
    return best.filter(F.col("b").isNotNull()).select(
        "page_id", "kind", "target", F.col("b.score").cast("int").alias("score"), F.col("b.n").alias("ties"), F.col("b.first.ord").alias("ord")
    )


def _alias_forms() -> dict[str, tuple[str, ...]]:
    return {
        group: tuple(name.replace("-", " ") for name in names)
        for group, names in fixed.FIELD_ALIASES.items()
    }


def alias_group(target: Column) -> Column:
    """Alias group a target's word form names, or null."""
    form = word_form(ident(target))
    result = F.lit(None).cast("string")
    for group, names in _alias_forms().items():
        result = F.when(form.isin(*names), F.lit(group)).otherwise(result)
    return result


def bridge_facts(elements: DataFrame) -> DataFrame:
    """Exact, alias and count facts per (page_id, key); keys carry the kind."""
    rows = eligible_elements(elements)
    form = word_form(F.concat_ws(" ", *[ident(c) for c in IDENTIFIERS]))
    exact = [F.concat(F.lit("e|"), F.col("kind"), _prefixed("|", ident(c))) for c in IDENTIFIERS]
    alias = [
        F.when(form.rlike("|".join(names)), F.concat(F.lit("a|"), F.col("kind"), F.lit(f"|{group}")))
        for group, names in _alias_forms().items()
    ]
    single = F.concat(F.lit("n|"), F.col("kind"))
    keyed = rows.select("page_id", "ord", F.explode(_distinct_keys(*exact, *alias, single)).alias("key"))
    return keyed.groupBy("page_id", "key").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))


def _bridge_rule(requests: DataFrame, elements: DataFrame, keys: Column) -> DataFrame:
    on = ["page_id", "kind", "target"]
    asked = requests.select(*on).distinct().filter(ident("target") != "")
    return _lookup(asked, on, keys, bridge_facts(only_asked(elements, asked, ["page_id"])))


def _alias_key() -> Column:
    return F.concat(F.lit("a|"), F.col("kind"), F.lit("|"), alias_group(F.col("target")))


def match_alias(requests: DataFrame, elements: DataFrame) -> DataFrame:
    """Sole element of the alias group the target names."""
    hits = _bridge_rule(requests, elements, _rules(_alias_key()))
    return hits.filter(F.col("n") == 1).select("page_id", "kind", "target", "ord")


def match_single(requests: DataFrame, elements: DataFrame) -> DataFrame:
    """The only candidate of a page, whatever the target says."""
    hits = _bridge_rule(requests, elements, _rules(F.concat(F.lit("n|"), F.col("kind"))))
    return hits.filter(F.col("n") == 1).select("page_id", "kind", "target", "ord")


def resolve_bridge(requests: DataFrame, elements: DataFrame, payload: Column | None = None) -> DataFrame:
    """(page_id, kind, target) to ``ord`` and the rule that found it.

    Exact, first in order; unique best score; unique alias; sole candidate. A
    ``payload`` (struct over elements) comes along from the element found.
    """
    names = ("exact", "score", "alias", "single")
    won = profiles.answers(_packed_requests(requests), _packed_elements(elements, payload))
    rules = won.select(
        "page_id", "kind", "target",
        F.array(*[
            F.struct(F.lit(name).alias("rule"), profiles.ruled(F.col("won"), n).alias("b")) for n, name in enumerate(names)
        ]).alias("rules"),
    )
    # Only the exact rule takes the first of several.
    found = F.filter("rules", lambda r: r["b"].isNotNull() & ((r["rule"] == "exact") | (r["b"]["n"] == 1)))
    best = rules.select("page_id", "kind", "target", F.get(found, F.lit(0)).alias("r")).filter(F.col("r").isNotNull())
    more = [] if payload is None else [F.col("r.b.first.payload").alias("payload")]
    return best.select("page_id", "kind", "target", F.col("r.b.first.ord").alias("ord"), F.col("r.rule").alias("rule"), *more)


# ------------------------------------------------------- canonical popup target

def suitable(action: str) -> Column:
    """Whether an element may take an action: click or type; others never."""
    kind = F.lower(js_trim(text_or_blank("type")))
    if action == "click":
        return kind.isin("button", "link")
    if action == "type":
        return kind.isin("input", "textarea") & (F.lower(js_trim(text_or_blank("input_type"))) != "password")
    return F.lit(False)


def suitable_for_action(elements: DataFrame) -> DataFrame:
    return elements.withColumns({f"for_{a}": suitable(a) for a in ("click", "type", "select")})


def semantic_needle(form: Column, action: Column) -> Column:
    """What an element's identifier must contain for a phrase target in its squashed form, or null."""
    suffix = "|".join(fixed.CONTROL_SUFFIXES)
    stem = js_trim(F.regexp_replace(form, rf"\s+(?:{suffix})$", ""))
    return (
        F.when(form.isin(*fixed.NAME_FIELD_PHRASES), F.when(action == "type", F.lit("name")))
        .when(form.isin(*fixed.SEARCH_FIELD_PHRASES), F.when(action == "type", F.lit("search")))
        .when(form.isin(*fixed.SEARCH_CLICK_PHRASES), F.when(action == "click", F.lit("search")))
        .when(form.rlike(rf" (?:{suffix})$"), F.nullif(stem, F.lit("")))
    )


def _roles() -> Column:
    return F.array_compact(
        F.array(
            F.when(suitable("type"), F.lit("type")),
            F.when(suitable("click"), F.lit("click")),
            F.when(~suitable("type"), F.lit("other")),
        )
    )


def _role_rows(elements: DataFrame) -> DataFrame:
    role = F.col("role_")
    label = F.when(role == "type", first_visible("placeholder", "aria_label", "name", "id")).otherwise(
        first_visible(*IDENTIFIERS)
    )
    return elements.withColumn("role_", F.explode(_roles())).withColumn("label", label)


def _semantic_hits(needles: DataFrame, elements: DataFrame) -> DataFrame:
    """(page_id, role_, needle) to the elements one identifier of which contains it."""
    fields = _role_rows(elements).select(
        "page_id", "role_", "ord", "label",
        F.explode(_distinct_keys(*[F.nullif(squash(c), F.lit("")) for c in IDENTIFIERS])).alias("hay"),
    )
    scope = ["page_id", "role_"]
    hits = contains_join(needles, fields, scope, "needle", "hay")
    return hits.join(fields, [*scope, "hay"]).select(*scope, "needle", "ord", "label").distinct()


def _asked_forms(requests: DataFrame) -> DataFrame:
    """Distinct (page_id, action, target) with the forms that the popup rules read: kind, norm, needle."""
    action = F.lower(js_trim(text_or_blank("action")))
    return (
        requests.select("page_id", "action", "target").distinct()
        .withColumns({"kind": action, "norm": squash("target")})
        .withColumn("needle", semantic_needle(F.col("norm"), F.col("kind")))
    )


def _needles(forms: DataFrame) -> DataFrame:
    wanted = forms.filter(F.col("needle").isNotNull() & F.col("kind").isin("type", "click"))
    return wanted.select("page_id", F.col("kind").alias("role_"), "needle").distinct()


def match_semantic(requests: DataFrame, elements: DataFrame) -> DataFrame:
    """Suitable elements a phrase target means, per distinct needle."""
    needles = _needles(_asked_forms(requests))
    return _semantic_hits(needles, only_asked(elements, needles, ["page_id"])).select(
        "page_id", F.col("role_").alias("action"), "needle", "ord"
    )


def canonical_actions(requests: DataFrame, elements: DataFrame) -> DataFrame:
    """Distinct (page_id, action, target) with the target the popup would use."""
    on = ["page_id", "action", "target"]
    # Kept with their forms: needles, keys and the result read them, and they are dear.
    asked = staged(_asked_forms(requests))
    action, norm = F.col("kind"), F.col("norm")
    open_targets = asked.filter(norm != "")
    elements = only_asked(elements, open_targets, ["page_id"])
    role_keys = _role_rows(elements)
    keyed = role_keys.select(
        "page_id", "ord", "label",
        F.explode(
            _distinct_keys(
                *[F.concat(F.lit("x|"), F.col("role_"), _prefixed("|", squash(c))) for c in IDENTIFIERS],
                F.concat(F.lit("n|"), F.col("role_")),
            )
        ).alias("key"),
    )
    exact = keyed.groupBy("page_id", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "label")).alias("first")
    )
    semantic = (
        _semantic_hits(_needles(asked), elements)
        .groupBy("page_id", F.concat(F.lit("s|"), F.col("role_"), F.lit("|"), F.col("needle")).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "label")).alias("first"))
    )
    keys = _rules(
        F.concat(F.lit("x|"), action, F.lit("|"), norm),
        F.concat(F.lit("s|"), action, F.lit("|"), F.col("needle")),
        F.when(action == "type", F.concat(F.lit("x|other|"), norm)),
        F.when(action == "type", F.lit("n|type")),
    )
    hits = _lookup(open_targets, on, keys, exact.unionByName(semantic))
    sole = F.when(F.col("n") == 1, F.col("first.label"))
    facts = hits.groupBy(*on).agg(
        F.max(F.when(F.col("rule_no") == 0, sole)).alias("_exact"),
        F.max(F.when(F.col("rule_no") == 1, sole)).alias("_semantic"),
        F.max(F.when(F.col("rule_no") == 2, F.col("n"))).alias("_other"),
        F.max(F.when(F.col("rule_no") == 3, sole)).alias("_only"),
    )
    typed = F.coalesce(
        "_exact", "_semantic", F.when(F.col("_other") > 0, F.col("_only")), F.lit("")
    )
    return asked.join(facts, on, "left").select(
        *on,
        F.when(norm == "", F.col("target"))
        .when(action == "type", typed)
        .when(action == "click", F.coalesce("_exact", "_semantic", "target"))
        .otherwise(F.col("target"))
        .alias("canonical"),
    )


# -------------------------------------------------------------- page-side finder

_DROPDOWN = r"(?i)\b(?:dropdown|drop-down|select|selector|menu)\b"
_FIELD = r"(?i)\b(?:field|input|textbox|text box)\b"
_WITH_TEXT = r"""(?i)\A(?:button|input|textarea|select|link)\s+with\s+text\s+['"](.+)['"]\z"""
_PLAIN = r"(?i)\A(?:button|input|textarea|select|link)\s+(.+)\z"


def find_target_dom(requests: DataFrame, elements: DataFrame) -> DataFrame:
    """(page_id, target) to the element a page script would act on.

    Dropdown words over selects (their labels included), the sole select, field words over editable
    fields, exact identifier, ``button with text '..'``, ``button ..``; a rule
    counts only when it names exactly one element, else the next is tried.
    """
    on = ["page_id", "target"]
    trimmed = js_trim(text_or_blank("target"))
    asked = distinct_requests(requests.filter(trimmed != ""), on)
    elements = only_asked(elements, asked, ["page_id"])
    if "label" not in elements.columns:
        elements = elements.withColumn("label", F.lit(""))
    lower = F.lower(trimmed)

    # Rule 0 and 1: words of a dropdown target against the selects.
    cleaned = F.trim(
        F.regexp_replace(F.regexp_replace(lower, _DROPDOWN, " "), "[^a-z0-9]+", " ")
    )
    wanted = asked.filter(lower.rlike(_DROPDOWN)).select(
        *on, F.array_distinct(F.filter(F.split(cleaned, " +"), lambda w: w != "")).alias("words")
    ).filter(F.size("words") > 0)
    selects = elements.filter(F.col("tag") == "select")
    doc = F.regexp_replace(
        F.lower(F.concat_ws(" ", *[text_or_blank(c) for c in ("name", "id", "aria_label", "placeholder", "label", "text")])),
        "[^a-z0-9]+", " ",
    )
    docs = selects.groupBy("page_id", doc.alias("hay")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord")
    )
    words = wanted.select(*on, F.size("words").alias("n_words"), F.explode("words").alias("word"))
    word_hits = contains_join(words, docs, ["page_id"], "word", "hay")
    all_words = (
        words.join(word_hits, ["page_id", "word"])
        .groupBy(*on, "hay", "n_words")
        .agg(F.count(F.lit(1)).alias("hit"))
        .filter(F.col("hit") == F.col("n_words"))
        .join(docs, ["page_id", "hay"])
        .groupBy(*on)
        .agg(F.sum("n").alias("n"), F.min("ord").alias("ord"))
        .filter(F.col("n") == 1)
        .select(*on, F.lit(0).alias("rule_no"), "ord")
    )
    raw = F.lower(F.concat_ws(" ", *[text_or_blank(c) for c in ("name", "id", "aria_label", "label", "text")]))
    sole = (
        selects.groupBy("page_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", raw.alias("doc"))).alias("s"))
        .filter(F.col("n") == 1)
        .select("page_id", "s.ord", "s.doc")
    )
    one_word = wanted.join(sole, "page_id").filter(
        F.exists("words", lambda w: F.col("doc").contains(w))
    ).select(*on, F.lit(1).alias("rule_no"), "ord")

    # Rule 2: field words.
    phrase = js_trim(F.regexp_replace(lower, _FIELD, ""))
    field_asked = asked.filter(trimmed.rlike(_FIELD)).select(*on, phrase.alias("needle")).filter(
        F.col("needle") != ""
    )
    editable = elements.filter(
        ((F.col("tag") == "input") & (F.lower(text_or_blank("input_type")) != "password"))
        | (F.col("tag") == "textarea")
    )
    fields = editable.select(
        "page_id", "ord",
        F.explode(
            _distinct_keys(
                *[F.nullif(F.lower(text_or_blank(c)), F.lit("")) for c in ("name", "id", "placeholder", "aria_label")]
            )
        ).alias("hay"),
    )
    field_hits = (
        contains_join(field_asked, fields, ["page_id"], "needle", "hay")
        .join(fields, ["page_id", "hay"])
        .select("page_id", "needle", "ord")
        .distinct()
        .groupBy("page_id", "needle")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
        .filter(F.col("n") == 1)
    )
    by_field = field_asked.join(field_hits, ["page_id", "needle"]).select(*on, F.lit(2).alias("rule_no"), "ord")

    # Rules 3 to 5: exact identifier, then text only, letter case kept.
    facts = (
        elements.select(
            "page_id", "ord",
            F.explode(
                _distinct_keys(
                    *[_prefixed("x|", F.lower(js_trim(text_or_blank(c)))) for c in IDENTIFIERS],
                    F.concat(F.lit("t|"), js_trim(text_or_blank("text"))),
                )
            ).alias("key"),
        )
        .groupBy("page_id", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
        .filter(F.col("n") == 1)
    )

    def text_key(pattern: str) -> Column:
        return F.when(
            trimmed.rlike(pattern), F.concat(F.lit("t|"), js_trim(F.regexp_extract(trimmed, pattern, 1)))
        )

    keys = _rules(F.concat(F.lit("x|"), lower), text_key(_WITH_TEXT), text_key(_PLAIN))
    keyed = _lookup(asked, on, keys, facts).select(*on, (F.col("rule_no") + 3).alias("rule_no"), "ord")
    return (
        all_words.unionByName(one_word).unionByName(by_field).unionByName(keyed)
        .groupBy(*on)
        .agg(F.min(F.struct("rule_no", "ord")).alias("b"))
        .select(*on, F.col("b.rule_no").alias("rule_no"), F.col("b.ord").alias("ord"))
    )


def select_options(requests: DataFrame, options: DataFrame) -> DataFrame:
    """(page_id, value) to the option chosen: by text first, then by value."""
    asked = requests.select("page_id", "value").filter(F.col("value").isNotNull()).distinct()
    facts = (
        options.select(
            "page_id", F.struct("opt_no", "opt_text", "opt_value").alias("o"),
            F.explode(
                F.array(
                    F.concat(F.lit("t|"), F.lower(js_trim("opt_text"))),
                    F.concat(F.lit("v|"), F.lower(js_trim("opt_value"))),
                )
            ).alias("key"),
        )
        .groupBy("page_id", "key")
        .agg(F.min("o").alias("o"))
    )
    norm = F.lower(js_trim("value"))
    hits = _lookup(asked, ["page_id", "value"], _rules(F.concat(F.lit("t|"), norm), F.concat(F.lit("v|"), norm)), facts)
    best = hits.groupBy("page_id", "value").agg(F.min(F.struct("rule_no", "o")).alias("b"))
    return best.select("page_id", "value", "b.o.opt_no", "b.o.opt_text", "b.o.opt_value")
