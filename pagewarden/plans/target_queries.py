"""Registered queries over target resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewarden.functions.text import squash, word_form
from pagewarden.operators import targets as O
from pagewarden.sources import derived as D
from pagewarden.sources import pages as P

# Requests of the scored match: kind and target by event.
BRIDGE_KIND = "case event_type when 'click' then 'click' when 'view' then 'type' when 'signup' then 'select' else 'any' end"
BRIDGE_TARGET = (
    "case event_id % 13 when 0 then 'e-mail' when 1 then 'Full Name' when 2 then ' mobile number ' "
    "when 3 then 'nation' when 4 then 'your phone number please' when 5 then 'search' when 6 then 'ear' "
    "when 7 then 'Account ' || cast(user_id as string) when 8 then 'history link' when 9 then 'password' "
    "when 10 then 'country' when 11 then '??' else 'card notes card' end"
)


def _elements(spark, sf):
    return P.visible_elements(D.form_elements(spark, sf))


def _context(spark, sf):
    """Elements as the protect step hands them on: tag only, no type."""
    return _elements(spark, sf).withColumn("type", F.lit(""))


def _actions(spark, sf):
    return D.actions(spark, sf)


def _bridge_requests(spark, sf):
    return D.read_table(spark, sf, "events").selectExpr(
        "user_id as page_id", f"{BRIDGE_KIND} as kind", f"{BRIDGE_TARGET} as target"
    )


def match_exact(spark, sf):
    return O.match_exact(_actions(spark, sf), _elements(spark, sf))


def match_selector(spark, sf):
    return O.match_selector(_actions(spark, sf), _elements(spark, sf))


def canonical_target(spark, sf):
    requests = _actions(spark, sf).filter(F.trim("target") != "")
    return O.resolve_targets(requests, _elements(spark, sf)).select(
        "page_id", "action", "target", "n", "canonical", "canonical_n", "any_input", "any_click"
    )


def eligible_elements(spark, sf):
    return O.eligible_elements(_context(spark, sf)).select("page_id", "ord", "kind")


def match_scored(spark, sf):
    return O.match_scored(_bridge_requests(spark, sf), _context(spark, sf))


def match_alias(spark, sf):
    return O.match_alias(_bridge_requests(spark, sf), _context(spark, sf))


def match_fallback_single(spark, sf):
    return O.match_single(_bridge_requests(spark, sf), _context(spark, sf))


def resolve_bridge_target(spark, sf):
    return O.resolve_bridge(_bridge_requests(spark, sf), _context(spark, sf))


def suitable_for_action(spark, sf):
    rows = O.suitable_for_action(_elements(spark, sf))
    return rows.select("page_id", "ord", "for_click", "for_type", "for_select")


def match_semantic(spark, sf):
    return O.match_semantic(_actions(spark, sf), _elements(spark, sf))


def canonicalize_action(spark, sf):
    return O.canonical_actions(_actions(spark, sf), _elements(spark, sf))


def find_target_dom(spark, sf):
    return O.find_target_dom(_actions(spark, sf), D.form_elements(spark, sf))


def select_option(spark, sf):
    return O.select_options(_option_requests(spark, sf), D.select_options(spark, sf))


def _option_requests(spark, sf):
    return D.read_table(spark, sf, "events").selectExpr("user_id as page_id", f"{OPTION_VALUE} as value")


OPTION_VALUE = (
    "case event_id % 6 when 0 then 'INDIA' when 1 then ' japan ' when 2 then 'in' when 3 then 'peru' "
    "when 4 then 'seg' else '' end"
)


def normalize_target_text(spark, sf):
    return D.read_table(spark, sf, "conversations").select(
        "conv_id", "turn", squash("text").alias("squashed"), word_form("text").alias("words")
    )


QUERIES = {
    "match_exact": match_exact,
    "match_selector": match_selector,
    "canonical_target": canonical_target,
    "eligible_elements": eligible_elements,
    "match_scored": match_scored,
    "match_alias": match_alias,
    "match_fallback_single": match_fallback_single,
    "resolve_bridge_target": resolve_bridge_target,
    "suitable_for_action": suitable_for_action,
    "match_semantic": match_semantic,
    "canonicalize_action": canonicalize_action,
    "find_target_dom": find_target_dom,
    "select_option": select_option,
    "normalize_target_text": normalize_target_text,
}
