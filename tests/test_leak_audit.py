"""Leak audit: values meet the strings of their page, without grams unless a page is wide."""

import itertools

import pytest

from pagewarden.operators import privacy

FIELDS = ("text", "value", "placeholder", "aria_label", "name")


def _case(n_wide):
    """Values, elements and pages: page 1 small, page 2 with ``n_wide`` elements, page 3 twice, page 4 without elements."""
    values = [(1, "ann@x.org"), (1, "98765"), (1, "ab"), (1, "gone"), (2, "tel 1007"), (2, "10"), (2, "gone"), (3, "pan1"), (4, "secret"), (5, "nopage"), (None, "ann")]
    elements = [(1, 0, "mail ann@x.org", "", "98765", "", None), (1, 1, "ann@x.org", "ann@x.org", "", "cab", "ab"), (3, 0, "pan1", "", "", "", ""), (None, 0, "ann", "", "", "", "")]
    elements += [(2, k, "", f"tel {1000 + k}", "", "", "n") for k in range(n_wide)]
    pages = [(1, "98765 and ab", "http://x/98765", ""), (2, "tel 1007", "", "10"), (3, "pan1", "", None), (3, "pan1", "", None), (4, "a secret", "", "")]
    return values, elements, pages


def _leaks(values, elements, pages):
    """Each page row gives its places, fields give a place once."""
    on_page = [(p, v, place) for p, v in values for q, *texts in pages if p is not None and p == q
               for place, t in zip(("page_text", "url", "title"), texts) if t and v in t]
    in_fields = {(p, v, place) for p, v in values for q, _, *texts in elements if p is not None and p == q for place, t in zip(FIELDS, texts) if t and v in t}
    return sorted([*on_page, *in_fields], key=repr)


@pytest.mark.parametrize("n_wide", [10, privacy.PAIRED_ELEMENTS, privacy.PAIRED_ELEMENTS + 1, 300])
def test_residual_leaks_are_brute_force(spark, n_wide):
    values, elements, pages = _case(n_wide)
    frames = (
        spark.createDataFrame(values, "page_id long, value string"),
        spark.createDataFrame(elements, "page_id long, ord int, " + ", ".join(f"{c} string" for c in FIELDS)),
        spark.createDataFrame(pages, "page_id long, page_text string, url string, title string"),
    )
    want = _leaks(values, elements, pages)
    assert sorted((tuple(r) for r in privacy.residual_leaks(*frames).collect()), key=repr) == want
    rows = [tuple(r) for r in privacy.residual_leaks(*frames, every=True).collect()]
    assert sorted((r for r in rows if r[2] is not None), key=repr) == want
    assert {r[:2] for r in rows} == set(values)


def test_audits_read_pages_few_times(spark):
    """Pages of a few elements: no grams, and their tables are read a few times only."""
    import __spark_entry__

    for name, reads in (("leak_audit_unprotected", 5), ("residual_leak_audit", 9)):
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        tree = plan.split("== Initial Plan ==")[0]
        scans = tree.count("FileScan parquet")
        assert 0 < scans <= reads and "_gram" not in plan, (name, scans)
