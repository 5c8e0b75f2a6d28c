"""Page, form, OCR and log tables derived from the star-schema tables.

The given tables hold no form fields, OCR words or action logs, so those are
computed from them, row by row, by the formulas below. The formulas are plain
SQL expressions, so the check side can state the same input. Every derived
table grows with its base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.functions.numbering import number_within

_K = "cast(c_custkey as string)"
_D4 = "cast(1000 + c_custkey % 9000 as string)"
_PHONE = "cast(9000000000 + c_custkey as string)"
_MAIL = f"'user' || {_K} || '@example.com'"

# One form per customer: type, tag, input_type, name, id, placeholder,
# aria_label, text and value, the last two as expressions over `customer`.
FORM_FIELDS = (
    ("button", "button", "", "search", "btn-search", "", "", "'Search'", "''"),
    ("button", "button", "", "login", "", "", "Sign in", "'Login'", "''"),
    ("input", "input", "text", "name", "name", "Enter your name", "", "''", "c_name"),
    ("input", "input", "email", "email", "email", "Email", "", "''", _MAIL),
    ("input", "input", "tel", "phone", "phone", "Phone", "Mobile number", "''",
     f"'+91' || {_PHONE}"),
    ("input", "input", "text", "card", "card", "Card", "", "''",
     f"'4111 1111 1111 ' || {_D4}"),
    ("input", "input", "text", "aadhaar", "aadhaar", "Aadhaar", "", "''",
     f"'1234 5678 ' || {_D4}"),
    ("input", "input", "text", "pan", "pan", "PAN", "", "''", f"'ABCDE' || {_D4} || 'F'"),
    ("input", "input", "password", "password", "password", "Password", "", "''",
     f"'secret-' || {_K}"),
    ("textarea", "textarea", "", "notes", "notes", "", "Notes", "''",
     f"case c_custkey % 3 when 0 then 'Mail ' || {_MAIL} || ' or call ' || {_PHONE} "
     "when 1 then '' else c_mktsegment end"),
    ("select", "select", "", "country", "country", "", "Country",
     "'India' || chr(10) || 'Japan' || chr(10) || 'France'", "'IN'"),
    ("link", "a", "", "", "", "", "", "'History'", "''"),
    ("link", "a", "", "", "", "", "",
     "case c_custkey % 3 when 0 then 'Search' when 1 then ' Contact  us ' "
     "else 'Account ' || c_mktsegment end", "''"),
)

PAGE_URL = (
    "case when c_custkey % 7 = 0 then '' when c_custkey % 7 = 1 then 'no host here' "
    f"when c_custkey % 2 = 0 then 'http://LocalHost:8080/form/' || {_K} "
    f"else 'https://site.example.com/form/' || {_K} end"
)
PAGE_TITLE = "'Form ' || c_mktsegment"
PAGE_TEXT = (
    f"'Name: ' || c_name || chr(10) || 'Email: ' || {_MAIL} || chr(10) || "
    f"'Phone: +91' || {_PHONE} || chr(10) || 'Card: 4111 1111 1111 ' || {_D4} || chr(10) || "
    f"'Aadhaar: 1234 5678 ' || {_D4} || chr(10) || 'PAN: ABCDE' || {_D4} || 'F' || chr(10) || "
    "case c_custkey % 4 when 0 then 'Search completed successfully' "
    "when 1 then 'Pending' when 2 then 'OPERATION COMPLETED' else 'Task completed' end"
)
FORM_LABEL = "case when tag = 'select' then 'State of residence' else '' end"
FORM_HTML = (
    "'<html><head><title>Form ' || c_mktsegment || ' &amp; more</title>"
    "<style>b{x:y}</style><script>var s=\"<input name=z>\";</script></head><body>"
    "<!-- <a href=\"/no\">no</a> --><label for=\"name\">Name of ' || c_mktsegment || '</label><input type=\"text\" id=\"name\" name=\"name\" "
    "placeholder=\"Enter your name\" value=\"' || c_name || '\">"
    f"<input type=\"password\" name=\"password\" value=\"secret-' || {_K} || '\">"
    f"<textarea name=\"notes\" aria-label=\"Notes\">call ' || {_PHONE} || '</textarea>"
    f"<label>Home of ' || {_K} || ' <select name=\"country\" id=\"country\"><option value=\"IN\">India</option>"
    "<option value=\"JP\">Japan</option></select></label>"
    "<button type=\"submit\" id=\"go\">Search <b>now</b></button>' || "
    "case when c_custkey % 2 = 0 then '<button disabled>Login</button>' else '' end || "
    f"'<a href=\"/history/' || {_K} || '\">History</a>' || "
    "case c_custkey % 3 when 0 then '<table><thead><tr><th>Date</th></tr></thead><tbody>"
    f"<tr><td>2024-01-01</td><td> ' || c_name || ' </td><td></td></tr>"
    "<tr><td> </td><td></td></tr><tr><td>Rent</td><td>' || c_mktsegment || '</td></tr>"
    f"<tr><td>Shop</td></tr><tr><td>Fuel</td><td>' || {_D4} || '</td></tr></tbody></table>' "
    f"when 1 then '<div>Grocery ' || {_K} || '</div><div>nothing</div><div>INR ' || {_D4} || "
    "'</div><p>Salary paid</p><p>Movie night</p>' "
    f"else '<div class=\"transaction-card\">Shop ' || {_K} || '<br> <br>Total</div>"
    "<div class=\"plain\">none</div><p class=\"old Transaction\">Fee</p>' end || '</body></html>'"
)
PAYLOAD = (
    f"case c_custkey % 6 when 0 then '{{\"url\":\"http://a.example/' || {_K} || "
    f"'\",\"title\":\"T' || {_K} || '\",\"page_text\":\"mail ' || {_MAIL} || "
    "'\",\"elements\":[{\"tag\":\"input\",\"name\":\"email\",\"value\":\"' || "
    f"{_MAIL} || '\",\"box\":{{\"x\":1,\"y\":2,\"width\":3,\"height\":4}}}},\"junk\","
    "{\"tag\":\"button\",\"text\":\"Search\",\"enabled\":false}]}' "
    "when 1 then '{\"title\":5,\"elements\":\"none\",\"page_text\":7}' "
    "when 2 then '{\"url\":null,\"elements\":[{\"tag\":\"a\",\"text\":\"call +91' || "
    f"{_PHONE} || '\"}},null,3,[]],\"page_text\":\"ok\"}}' "
    "when 3 then '{}' "
    f"when 4 then '{{\"url\":\"u\",\"title\":\"t\",\"elements\":[{{}}],\"page_text\":\"ABCDE' || {_D4} || 'F\"}}' "
    "else '{\"url\":true,\"elements\":[{\"tag\":\"input\",\"input_type\":\"password\","
    f"\"name\":\"password\",\"value\":\"secret-' || {_K} || '\"}}],\"page_text\":null}}' end"
)

_E = "cast(event_id as string)"
ACTION_KIND = (
    "case when event_id % 10 = 9 then upper(event_type) else "
    "case event_type when 'click' then 'click' when 'view' then 'type' "
    "when 'signup' then 'select' when 'purchase' then 'purchase' else 'navigate' end end"
)
ACTION_TARGET = (
    "case event_id % 12 when 0 then 'Search' when 1 then 'Enter your name' "
    "when 2 then 'input[name=\"email\"]' when 3 then 'password' when 4 then 'missing' "
    "when 5 then 'name field' "
    "when 6 then case when event_id % 5 = 0 then 'Residence selector' else 'Country dropdown' end when 7 then ' ' "
    "when 8 then 'History' when 9 then 'button with text \"Login\"' "
    "when 10 then 'login button' else 'Input [ placeholder = \"Phone\" ]' end"
)
ACTION_VALUE = (
    "case event_id % 6 when 0 then null when 1 then 'USER_PROVIDED_VALUE' "
    f"when 2 then '' when 3 then 'japan' else 'v' || {_E} end"
)
TASK_TEXT = (
    f"case event_id % 22 when 0 then 'type \"Ann ' || {_E} || '\" into the Enter your name and click Search' "
    f"when 1 then 'Type Bob' || {_E} || ' into NAME and then click the Login' "
    f"when 2 then 'enter x' || {_E} || ' into city and then click Save' "
    f"when 3 then 'fill name with Customer#' || lpad(cast(user_id as string), 9, '0') || ' and then click Search' "
    "when 4 then 'click the Search button' when 5 then '  press OK ' "
    "when 6 then 'use my email' when 7 then 'read the page' when 8 then '' when 9 then null "
    f"when 10 then 'type ''v' || {_E} || ''' into the Email' "
    f"when 11 then 'type v' || {_E} || ' into phone' "
    "when 12 then 'please click history' when 13 then 'select Country' "
    "when 14 then 'send my credit  card and my name' "
    f"when 15 then 'fill notes with n' || {_E} when 16 then 'please click link with text History' "
    "when 17 then 'enter [EMAIL] into email' when 18 then 'type a into password' "
    "when 19 then 'click mobile' when 20 then 'now click Search link' "
    "else 'fill e-mail with [EMAIL] and then click sign in' end"
)
MODEL_TEXT = (
    "case event_id % 20 when 0 then '{\"status\":\"ready\",\"reason\":\"go\",\"actions\":[{\"action\":\"click\",\"target\":\" Search \"}]}' "
    "when 1 then '{\"status\":\"completed\",\"reason\":\"done\",\"actions\":[]}' "
    f"when 2 then '{{\"status\":\"blocked\",\"reason\":\"no ' || {_E} || '\"}}' "
    "when 3 then '```json' || chr(10) || '{\"status\":\"ready\",\"actions\":[{\"action\":\"type\",\"target\":\"Email\",\"value\":\"x\"}]}' || chr(10) || '```' "
    f"when 4 then 'Sure {{oops}} here: {{\"status\":\"ready\",\"reason\":\"r' || {_E} || '\",\"actions\":[]}} and more }}' "
    "when 5 then '[{\"action\":\"click\",\"target\":\"Search\"}]' "
    "when 6 then '[{\"action\":\"type\",\"target\":\"name\",\"value\":\"a\"},{\"action\":\"click\",\"target\":\"Login\"}]' "
    "when 7 then 'no actions: []' "
    "when 8 then '{\"status\":\"ready\",\"x\":3,\"actions\":[]}' "
    "when 9 then '{\"status\":\"maybe\",\"actions\":[]}' "
    "when 10 then '{\"status\":\"ready\",\"actions\":[{\"action\":\"click\"}]}' "
    "when 11 then '{\"status\":\"ready\",\"actions\":[{\"action\":\"type\",\"target\":\"Email\",\"value\":5}]}' "
    "when 12 then '{\"status\":\"ready\",\"actions\":[{\"action\":\"type\",\"target\":\"Email\",\"value\":\"[EMAIL]\"}]}' "
    "when 13 then '{\"status\":\"ready\",\"actions\":[{\"action\":\"click\",\"target\":\"Go\",\"value\":null}]}' "
    "when 14 then '{\"status\":\"ready\",\"reason\":7,\"actions\":[{\"action\":\"navigate\",\"target\":\"http://a.example\"}]}' "
    "when 15 then 'plan: {\"status\": ' when 16 then null "
    "when 17 then '{\"status\":\"ready\",\"actions\":[{\"action\":\"click\",\"target\":\"A\"},{\"action\":\"drag\",\"target\":\"B\"},7]}' "
    "when 18 then '{\"status\":\"completed\",\"actions\":[{\"action\":\"click\",\"target\":\"A\",\"y\":1}]}' "
    "else '[1] or [2] ' || '{\"actions\":{},\"status\":\"ready\"}' end"
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, as it is stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table dealt by their key to all tasks, before they are expanded.

    A file of few row groups is read by few tasks, however much is made of its rows. What
    is made of a row stays in its partition, so grouping it by the key exchanges nothing.
    The number of tasks is given: the rows are little data and much work, and would be
    merged into few partitions otherwise.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(read_table(spark, sf_dir, "customer"), "c_custkey")


def _form_rows() -> str:
    return ", ".join(
        f"named_struct('ord', {n}, 'type', '{f[0]}', 'tag', '{f[1]}', 'input_type', '{f[2]}', "
        f"'name', '{f[3]}', 'id', '{f[4]}', 'placeholder', '{f[5]}', 'aria_label', '{f[6]}', "
        f"'text', {f[7]}, 'value', {f[8]})"
        for n, f in enumerate(FORM_FIELDS)
    )


def form_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page states: a page with the array of its elements that are visible and have a size."""
    shown = "(c_custkey + e.ord) % 17 <> 0 and (c_custkey + e.ord) % 13 <> 0"
    return _customers(spark, sf_dir).selectExpr(
        "c_custkey as page_id", f"{PAGE_URL} as url", f"{PAGE_TITLE} as title", f"{PAGE_TEXT} as page_text",
        f"filter(array({_form_rows()}), e -> {shown}) as elements",
    )


def form_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured elements, thirteen per customer page, before any filter."""
    base = _customers(spark, sf_dir).selectExpr(
        "c_custkey as page_id", f"inline(array({_form_rows()}))"
    )
    return base.selectExpr(
        "page_id", "ord", "type", "tag", "'' as role", "text", "aria_label",
        "placeholder", "input_type", "name", "id", "value", f"{FORM_LABEL} as label",
        "(page_id + ord) % 17 <> 0 as visible",
        "(page_id + ord) % 11 <> 0 as enabled",
        "named_struct('x', cast(10 as double), 'y', cast(30 * ord as double), 'width', "
        "cast(case when (page_id + ord) % 13 = 0 then 0 else 200 end as double), "
        "'height', cast(24 as double)) as box",
    )


def form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).selectExpr(
        "c_custkey as page_id", f"{PAGE_URL} as url", f"{PAGE_TITLE} as title",
        f"{PAGE_TEXT} as page_text",
    )


def form_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).selectExpr(
        "c_custkey as page_id", f"{FORM_HTML} as html"
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).selectExpr(
        "c_custkey as page_id", f"{PAYLOAD} as payload"
    )


def select_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of each page's select: text and value may cross over."""
    options = "inline(array({}))".format(
        ", ".join(
            f"named_struct('opt_no', {n}, 'opt_text', {t}, 'opt_value', {v})"
            for n, (t, v) in enumerate(OPTION_ROWS)
        )
    )
    return _customers(spark, sf_dir).selectExpr("c_custkey as page_id", options)


OPTION_ROWS = (
    ("'Choose'", "''"),
    ("' India '", "'IN'"),
    ("'Japan'", "'JP'"),
    ("'Nippon'", "'japan'"),
    ("c_mktsegment", "'SEG'"),
)


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logged action per event; the page is the user's form."""
    return read_table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id as task_id", "user_id as page_id", "ts", "event_type",
        f"{ACTION_KIND} as action", f"{ACTION_TARGET} as target", f"{ACTION_VALUE} as value",
    )


def numbered_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action log with the step number of each action within its task."""
    log = actions(spark, sf_dir)
    return number_within(
        log, ["task_id"], F.date_trunc("hour", F.col("ts")), ["ts", "event_id"], "step"
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(read_table(spark, sf_dir, "events"), "event_id")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "event_id", "user_id as page_id", f"{TASK_TEXT} as task"
    )


def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "event_id", "user_id as page_id", f"{TASK_TEXT} as task", f"{MODEL_TEXT} as model_text"
    )


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw recogniser words of a rendered document, conf still as text.

    Each line of the document is an OCR line, each blank-separated piece a word;
    empty pieces stay, as recognisers emit them.
    """
    lines = dealt(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(
        F.col("doc_id").alias("image_id"),
        F.posexplode(F.split("text", "\n", -1)).alias("line_num", "line"),
    )
    words = lines.select(
        "image_id", "line_num", F.posexplode(F.split("line", " ", -1)).alias("word_no", "text")
    )
    return words.selectExpr(
        "image_id", "line_num", "word_no", "text",
        "case when (37 * word_no + line_num) % 23 = 0 then 'n/a' "
        "else cast((37 * word_no + line_num) % 110 - 10 as string) end as conf",
        "cast(floor(line_num / 40) as int) as block_num",
        "case when line_num % 9 = 0 then null else cast(floor(line_num / 5) as int) end as par_num",
        "named_struct('x', 10 * word_no, 'y', 20 * line_num, "
        "'width', 10 * length(text), 'height', 18) as box",
    )


# Closed-loop log: one task per user, one planning cycle per event.
LOOP_TASK = (
    "case user_id % 6 when 0 then 'type Ann into the NAME and click Search' "
    "when 1 then 'click the Search' when 2 then 'type \"Bob\" into Email' when 3 then 'read the page' "
    "when 4 then 'Type ''5 '' into phone and then click the login' else 'press missing' end"
)
LOOP_PLAN = (
    "case when event_id % 11 = 0 then '[]' when event_id % 17 = 1 then 'no plan' "
    "else case user_id % 6 "
    "when 0 then case when cycle = 1 then '[{\"action\":\"type\",\"target\":\" Name\",\"value\":\"Ann\"}]' "
    "else '[{\"action\":\"click\",\"target\":\"history\"},{\"action\":\"click\",\"target\":\"search\"}]' end "
    "when 1 then '[{\"action\":\"click\",\"target\":\"Go\"}]' "
    "when 2 then case when event_id % 7 = 0 then '[{\"action\":\"click\",\"target\":\"Email\"}]' "
    "else '[{\"action\":\"type\",\"target\":\"Email\",\"value\":\"zzz\"}]' end "
    "when 3 then case event_id % 4 when 0 then '[{\"action\":\"click\",\"target\":\"History\"}]' "
    "when 1 then '[{\"action\":\"type\",\"target\":\"Phone\",\"value\":\"v\"}]' "
    "when 2 then '[{\"action\":\"click\",\"target\":\"login\"}]' "
    "else case when event_id % 3 = 0 then '[{\"action\":\"select\",\"target\":\"Country\",\"value\":\"IN\"}]' "
    "when event_id % 3 = 1 then '[{\"action\":\"click\",\"target\":\"A\"},{\"action\":\"click\",\"target\":\"B\"}]' "
    "else '[{\"action\":\"type\",\"target\":\"input[name=email]\",\"value\":\"v\"}]' end end "
    "when 4 then case when cycle = 1 then '[{\"action\":\"type\",\"target\":\"phone\",\"value\":\"5\"}]' "
    "else '[{\"action\":\"click\",\"target\":\"Login\"}]' end "
    "else '[{\"action\":\"click\",\"target\":\"x\"}]' end end"
)
LOOP_ELAPSED = "5 * cycle + 2 * (user_id % 60)"
LOOP_EXECUTED = "event_id % 19 <> 0"
LOOP_VALUE_AFTER = "case when event_id % 13 = 0 then 'other' else chosen_value end"
LOOP_CLICK_VERIFIED = "event_id % 17 <> 0 and event_id % 5 <> 4"


def loop_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a cycle of its user's task."""
    rows = number_within(
        read_table(spark, sf_dir, "events"), ["user_id"], F.date_trunc("hour", F.col("ts")), ["ts", "event_id"], "place"
    ).withColumn("cycle", F.col("place").cast("int"))
    return rows.selectExpr(
        "event_id", "user_id as task_id", "user_id as page_id", "ts", "cycle",
        f"{LOOP_TASK} as task", f"{LOOP_PLAN} as model_text", f"{LOOP_ELAPSED} as elapsed_s",
        f"{LOOP_EXECUTED} as executed",
    )


# Field values after an event: three fields of the event's page.
FIELD_AFTER_ROWS = (
    ("2", "'input'", "'Enter your name'", "''", "'name'", "'name'",
     f"case when event_id % 4 = 0 then 'other' else {ACTION_VALUE} end"),
    ("3", "'input'", "'Email'", "''", "'email'", "'email'", f"coalesce({ACTION_VALUE}, '')"),
    ("9", "'textarea'", "''", "'Notes'", "'Enter your name'", "'notes'", f"coalesce({ACTION_VALUE}, '')"),
)


def fields_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(
        f"named_struct('ord', {o}, 'tag', {t}, 'placeholder', {p}, 'aria_label', {a}, "
        f"'name', {n}, 'id', {i}, 'value', {v})"
        for o, t, p, a, n, i, v in FIELD_AFTER_ROWS
    )
    return read_table(spark, sf_dir, "events").selectExpr("event_id", f"inline(array({rows}))")


CLICK_ATTRIBUTES = {
    "aria_expanded": "case when ord % 2 = 1 then 'false' else '' end",
    "aria_pressed": "''",
    "class": "'btn c' || cast(page_id % 3 as string)",
}


def click_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured elements with the attributes a click may change."""
    return form_elements(spark, sf_dir).withColumns(
        {name: F.expr(value) for name, value in CLICK_ATTRIBUTES.items()}
    )


def click_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State before and after each click; what changes depends on the event."""
    clicks = actions(spark, sf_dir).filter("event_type = 'click'")
    before = clicks.selectExpr(
        "event_id", "'before' as phase", "'http://a.example/' || cast(page_id as string) as url",
        "'text' as body_text", "'<p>text</p>' as body_html",
        "case when event_id % 17 <> 0 then named_struct('visible', true, 'enabled', event_id % 3 <> 0, "
        "'aria_expanded', 'false', 'aria_pressed', '', 'class', 'btn') end as target",
    )
    after = clicks.selectExpr(
        "event_id", "'after' as phase",
        "'http://a.example/' || cast(page_id as string) || case when event_id % 7 = 0 then '/next' else '' end as url",
        "case when event_id % 7 = 1 then 'other' else 'text' end as body_text",
        "case when event_id % 7 = 2 then '<p>other</p>' else '<p>text</p>' end as body_html",
        "case when event_id % 23 <> 0 then named_struct('visible', true, 'enabled', event_id % 3 <> 0, "
        "'aria_expanded', case when event_id % 7 = 3 then 'true' else 'false' end, 'aria_pressed', '', "
        "'class', case when event_id % 7 = 4 then 'btn on' else 'btn' end) end as target",
    )
    return before.unionByName(after)


# Extension cycles: what the agent answered and what came of it, per event.
CYCLE_COLUMNS = {
    "agent_status": "case when event_id % 29 = 0 then null when event_id % 13 = 0 then 'blocked' else 'ready' end",
    "agent_reason": "case when event_id % 26 = 0 then 'Typing a Password is blocked' "
    "when event_id % 39 = 0 then 'information that only the user can provide' else '' end",
    "n_actions": "event_id % 31",
    "executed": "event_id % 37 <> 0",
    "verified": "case when event_id % 5 = 0 then null else event_id % 41 <> 0 end",
    "after_text": "case when event_id % 9 = 0 then 'Search Completed' else 'Task Completed soon' end",
}


def popup_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles as the extension logs them: each run of five events of a (user, day) is a task, (task_id, run)."""
    log = actions(spark, sf_dir).withColumn(
        "task_id", F.expr("task_id * 100 + day(ts)").cast("bigint")
    )
    placed = number_within(log, ["task_id"], F.date_trunc("hour", F.col("ts")), ["ts", "event_id"], "_place")
    before = F.col("_place") - 1
    ranked = placed.withColumns({"run": F.floor(before / 5), "cycle": (before % 5 + 1).cast("int")}).drop("_place")
    return ranked.withColumns({n: F.expr(v) for n, v in CYCLE_COLUMNS.items()})
