"""Operators on small fixtures with results worked out by hand or by brute force."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from pagewarden.functions.joins import contains_join
from pagewarden.functions.numbering import number_within
from pagewarden.operators import policy, privacy, regions, targets, tasks
from pagewarden.sources import pages as P
from pagewarden.streaming import budget

ELEMENT = (
    "page_id bigint, ord int, type string, tag string, input_type string, text string, value string, "
    "placeholder string, aria_label string, name string, id string"
)
FORM = [
    (1, 0, "input", "input", "", "", "lea.k@sample.org", "Where we write to", "", "contact", ""),
    (1, 1, "input", "input", "", "", "+917012345678", "Mobile", "", "mobile", ""),
    (1, 2, "input", "input", "", "", "5500 0055 5555 5559", "Payment", "", "payment", ""),
    (1, 3, "input", "input", "password", "", "open-sesame-77", "Entry", "", "entry", ""),
    (1, 4, "input", "input", "", "", "9876 5432 1098", "Resident number", "", "resident", ""),
    (1, 5, "input", "input", "", "", "QWERT6789Z", "Tax number", "", "tax", ""),
]
TEXT = (
    "Guest Lea\nwrite to lea.k@sample.org\nmobile +917012345678\npaid by 5500 0055 5555 5559\n"
    "resident 9876 5432 1098\ntax no. QWERT6789Z"
)


@pytest.fixture(scope="module")
def form(spark):
    elements = spark.createDataFrame(FORM, ELEMENT)
    page = spark.createDataFrame([(1, "u", "t", TEXT)], "page_id bigint, url string, title string, page_text string")
    return elements, page


def test_page_protection(form):
    elements, page = form
    found = privacy.inspect_page(elements, page)
    assert found.filter("is_text = 1").count() == 6
    clean = {r.ord: r.value for r in privacy.sanitize_elements(elements).collect()}
    assert clean == {0: "[EMAIL]", 1: "[PHONE]", 2: "[CREDIT_CARD]", 3: "[REDACTED]", 4: "[AADHAAR]", 5: "[PAN]"}
    text = privacy.sanitize_page_text(page, found).first().page_text
    for value in ("lea.k@sample.org", "7012345678", "5500", "5432", "QWERT6789Z"):
        assert value not in text
    summary = privacy.privacy_summary(page, found).first()
    assert summary.credential_findings == 1 and summary.findings == 13
    assert summary.types == ["email", "phone", "credit_card", "aadhaar", "credential", "pan"]


def test_findings_of_states_as_those_of_tables(spark, form):
    elements, page = form
    columns = ["page_id", "seq", "elem_ord", "field", "type", "value"]
    want = privacy.numbered_findings(privacy.inspect_page(elements, page)).select(columns)
    own = F.struct(*[c for c in elements.columns if c != "page_id"])
    # In no order at all; a page without elements and one without a text.
    states = page.join(elements.groupBy("page_id").agg(F.sort_array(F.collect_list(own), asc=False).alias("elements")), "page_id")
    bare = page.withColumn("page_id", F.lit(2).cast("bigint")).unionByName(page.selectExpr("3L as page_id", "url", "title", "cast(null as string) as page_text"))
    got = privacy.inspect_states(states.unionByName(bare, allowMissingColumns=True)).select(columns)
    assert "Exchange" not in privacy.inspect_states(bare.withColumn("elements", F.lit(None).cast(states.schema["elements"].dataType)))._jdf.queryExecution().executedPlan().toString()
    assert sorted(got.filter("page_id = 1").collect(), key=lambda r: r.seq) == sorted(want.collect(), key=lambda r: r.seq)
    assert got.filter("page_id = 2").count() == 6 and got.filter("page_id = 3").count() == 0


def test_value_found_in_an_element_is_replaced_inside_longer_text(spark):
    elements = spark.createDataFrame([(1, 0, "input", "input", "", "", "ABCDE1234F", "", "", "", "")], ELEMENT)
    page = spark.createDataFrame([(1, "", "", "xABCDE1234Fx")], "page_id bigint, url string, title string, page_text string")
    found = privacy.inspect_page(elements, page)
    assert privacy.sanitize_page_text(page, found).first().page_text == "x[PAN]x"


def test_hot_page_loses_every_value(spark):
    rows = [(1, i, "input", "input", "", "", f"user{i}@mail{i}.org", "", "", "", "") for i in range(3000)]
    text = "x" + " y".join(r[6] for r in rows[::7])
    page = spark.createDataFrame([(1, "", "", text), (2, "", "", "calm")], "page_id bigint, url string, title string, page_text string")
    elements = spark.createDataFrame(rows, ELEMENT)
    got = {r.page_id: r.page_text for r in privacy.sanitize_page_text(page, privacy.inspect_page(elements, page)).collect()}
    assert "@mail" not in got[1] and got[1].count("[EMAIL]") == len(rows[::7]) and got[2] == "calm"


def test_credential_token_wins_over_value_match(spark):
    elements = spark.createDataFrame(
        [(1, 0, "input", "input", "password", "", "a@b.co", "", "", "", ""), (1, 1, "input", "input", "password", "", "", "", "", "", "")], ELEMENT
    )
    assert [r.value for r in privacy.sanitize_elements(elements).orderBy("ord").collect()] == ["[REDACTED]", ""]


def test_numbering_of_a_hot_key_equals_a_plain_window(spark):
    rng = random.Random(7)
    rows = [(1 if rng.random() < 0.5 else rng.randrange(9), rng.randrange(500), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, o int, i int")
    got = {r.i: r.n for r in number_within(df, ["k"], F.floor(F.col("o") / 50), ["o", "i"], "n").collect()}
    want, seen = {}, {}
    for k, _, i in sorted(rows):
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert got == want


def test_contains_join_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    needles = {(rng.randrange(3), word(rng.randrange(0, 5))) for _ in range(60)}
    hays = {(rng.randrange(3), word(rng.randrange(0, 12))) for _ in range(200)}
    left = spark.createDataFrame(sorted(needles), "k int, n string")
    right = spark.createDataFrame(sorted(hays), "k int, h string")
    got = {tuple(r) for r in contains_join(left, right, ["k"], "n", "h").collect()}
    assert got == {(k, n, h) for k, n in needles for j, h in hays if k == j and n and n in h}


def test_ocr_region(spark):
    words = [("Email:", 10, 10, 50), ("ann@example.com", 65, 10, 180), ("safe", 10, 40, 40)]
    tokens = spark.createDataFrame(
        [(1, n, t, 1, 1, 1 if n < 2 else 2, (x, y, w, 20)) for n, (t, x, y, w) in enumerate(words)],
        "image_id bigint, seq int, text string, block_num int, par_num int, line_num int, box struct<x:int,y:int,width:int,height:int>",
    )
    found = regions.ocr_sensitive_regions(regions.ocr_lines(tokens)).collect()
    assert [(r.type, tuple(r.box)) for r in found] == [("email", (65, 10, 180, 20))]


def test_planner_case(spark):
    elements = spark.createDataFrame(
        [(1, 0, "button", "button", "", "Send", "", "", "", "", ""), (1, 1, "input", "input", "", "", "", "Street and number", "", "street", "street")], ELEMENT
    )
    actions = spark.createDataFrame(
        [(1, 1, "type", "input[name='street']", "Mill Lane 4"), (1, 2, "click", "Send", None), (1, 3, "click", "Gone", None), (1, 4, "type", "Send", "x")],
        "page_id bigint, step int, action string, target string, value string",
    )
    rows = policy.validate_action(actions, elements).orderBy("step").collect()
    assert [r.message for r in rows] == [
        "Valid action.", "Valid action.", "Target not found: Gone", "Target is not a text input: Send"
    ]
    assert rows[0].canonical == "Street and number"


@pytest.mark.parametrize(
    "text, status, reason",
    [
        ('{"status":"ready","actions":[{"action":"click","target":" A "}]}', "ready", ""),
        ('```json\n{"status":"ready","reason":"r","actions":[]}\n```', "ready", "r"),
        ('{"status":"completed","reason":"d","actions":[]}', "ready", "d"),
        ('{"status":"blocked"}', "blocked", "The local agent blocked the task."),
        ('well {x} {"status":"ready","actions":[]} tail', "ready", ""),
        ('{"status":"ready","actions":[{"action":"type","target":"A","value":null}]}', "blocked", "The type action does not contain a valid value."),
        ('{"status":"ready","actions":[{"action":"click","target":"A","value":null}]}', "blocked", "Click actions cannot contain a value."),
        ('{"status":"ready","actions":[{"action":"click","target":5}]}', "blocked", "The local model returned an action without a target."),
        ('{"status":"ready","actions":"none"}', "blocked", "The local model returned invalid actions."),
        ('{"status":"ready","y":null}', "blocked", "The local model returned an unsafe coordinate-based action."),
        ("[1]] x", "blocked", "The local model returned an invalid response."),
        (None, "blocked", "The local model returned an invalid response."),
    ],
)
def test_model_plan(spark, text, status, reason):
    rows = spark.createDataFrame([(1, text)], "event_id int, model_text string")
    row = policy.validate_model_plan(P.parse_plan_object(rows)).first()
    assert (row.plan_status, row.plan_reason) == (status, reason)


@pytest.mark.parametrize(
    "task, want",
    [
        ('type "Ann" into the Name and click the Search', ("sequence", "Name", "Ann", "Search")),
        ("type Ann into name", ("type_only", "name", "Ann", None)),
        ("type 'a b' into the x", ("type_only", "x", "a b", None)),
        ("press OK", ("click_only", None, None, "OK")),
        ("read it", ("general", None, None, None)),
        (None, ("general", None, None, None)),
    ],
)
def test_task_constraint(spark, task, want):
    row = tasks.infer_task_constraint(spark.createDataFrame([(task,)], "task string")).first()
    assert (row.intent, row.type_target, row.type_value, row.click_target) == want


def test_html_scan_covers_all_kinds(spark):
    html = (
        '<!-- <a href="/x">x</a> --><script>"<a>"</script><a href="/h?a=1&amp;b=2"> Go <b>on</b></a>'
        '<button disabled aria-label="Say">S</button><input type="text" name="q" value="v">'
        '<textarea name="t">body</textarea><select id="s"><option>A</option></select>'
    )
    rows = P.scan_page_elements(spark.createDataFrame([(1, html)], "page_id bigint, html string")).orderBy("ord").collect()
    assert [(r.type, r.text) for r in rows] == [("button", "S"), ("input", ""), ("textarea", "body"), ("select", "A"), ("link", "Go on")]
    assert rows[4].href == "/h?a=1&b=2" and not rows[0].enabled and rows[1].value == "v"


def test_bridge_rules(spark):
    elements = spark.createDataFrame(
        [
            (1, 0, "", "input", "", "", "", "First name", "", "fn", ""),
            (1, 1, "", "input", "", "", "", "Last name", "", "ln", ""),
            (1, 2, "", "input", "password", "", "", "Password", "", "pw", ""),
            (1, 3, "", "button", "", "Go", "", "", "", "", ""),
            (2, 0, "", "input", "", "", "", "Anything", "", "", ""),
        ],
        ELEMENT,
    )
    asked = [("type", "last NAME"), ("type", "name"), ("type", "the first"), ("any", "go"), ("type", "pw")]
    requests = spark.createDataFrame([(1, k, t) for k, t in asked] + [(2, "type", "zzz")], "page_id bigint, kind string, target string")
    got = {(r.page_id, r.target): (r.ord, r.rule) for r in targets.resolve_bridge(requests, elements).collect()}
    assert got == {
        (1, "last NAME"): (1, "exact"), (1, "the first"): (0, "score"), (1, "go"): (3, "exact"), (2, "zzz"): (0, "single"),
    }


def test_budget_counts_only_what_came_before(spark):
    start = datetime.datetime(2024, 1, 1)
    log = [(1, start + datetime.timedelta(seconds=i), i, i, True) for i in range(10)]
    log += [(2, start + datetime.timedelta(seconds=i), i, i, False) for i in range(30)]
    log += [(3, start, 0, 0, False), (3, start + datetime.timedelta(seconds=1), 1, 121, False)]
    df = spark.createDataFrame(log, "task_id bigint, ts timestamp, event_id bigint, elapsed_s bigint, is_replan boolean")
    got = {r.task_id: (r.step, r.breach) for r in policy.budget_breaches(df).collect()}
    assert got == {1: (7, "replans"), 2: (21, "actions"), 3: (2, "runtime")}


def test_last_of_repeated_json_keys_counts(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    row = spark.sql("""select to_json(try_parse_json('{"status":"blocked","status":"ready"}')) as j""").first()
    assert row.j == '{"status":"ready"}'
