"""HTML as it is found: quote forms, entities, names that only begin like a kind."""

import re
import timeit
from html.parser import HTMLParser

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pagewarden.functions.pii import is_credential
from pagewarden.sources import pages as P
from pagewarden.sources.markup import element_spans

HTML = [
    (1, "<input type='password' name='pw' value='topsecret'>"),
    (2, "<input name=email value=ann@example.com>"),
    (3, '<input title="a > b" VALUE="x y" disabled>'),
    (4, "<a-card>no link</a-card><a href='/x' title='class=\"y\"'>go &#64; &#x1F600; &amp;lt; now</a>"),
    (5, '<input placeholder=" disabled " name="n" name="later"><button>It\'s</button><p title="5 > 4">ann&#64;example.com</p>'),
    (6, None),
    (7, ""),
    (8, '<input value="&#0;&#xD800;&#99999999;&#38;lt;"/>'),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, html string")


def test_attribute_forms(spark):
    rows = {(r.page_id, r.tag): r for r in P.scan_page_elements(frame(spark, HTML)).collect()}
    first = rows[1, "input"]
    assert (first.input_type, first.name, first.value) == ("password", "pw", "topsecret")
    assert (rows[2, "input"].name, rows[2, "input"].value) == ("email", "ann@example.com")
    assert (rows[3, "input"].value, rows[3, "input"].enabled) == ("x y", False)
    assert (rows[4, "a"].text, rows[4, "a"].href) == ("go @ \U0001f600 &lt; now", "/x")
    assert (rows[5, "input"].name, rows[5, "input"].enabled, rows[5, "button"].text) == ("n", True, "It's")
    assert rows[8, "input"].value == "���&lt;"
    assert len(rows) == 7
    texts = {r.page_id: r.page_text for r in P.page_text(frame(spark, HTML)).collect()}
    assert texts[5] == "It'sann@example.com" and texts[7] == ""


def test_credentials_in_any_quotes(spark):
    rows = P.scan_page_elements(frame(spark, HTML))
    assert [r.page_id for r in rows.filter(is_credential("input_type", "name", "id")).collect()] == [1]


class _Inputs(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        first = {}
        for name, value in attrs:
            first.setdefault(name, value or "")
        self.found.append((first.get("name", ""), first.get("value", ""), "disabled" not in first))

    handle_startendtag = handle_starttag


_TEXT = st.text("ab c@<=/;&#>", max_size=8)
_BARE = st.text("abc@.", min_size=1, max_size=6)
_VALUE = st.one_of(
    _TEXT.map(lambda v: f'="{v}"'), _TEXT.map(lambda v: f" = '{v}'"), _BARE.map(lambda v: f"={v}"), st.just("")
)
_PAIR = st.tuples(st.sampled_from(("name", "VALUE", "title", "disabled", "data-name")), _VALUE).map("".join)
_TAG = st.lists(_PAIR, max_size=5).map(lambda a: "<input " + " ".join(a) + ">")


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(tags=st.lists(_TAG, min_size=60, max_size=120))
def test_against_a_parser(spark, tags):
    got = P.scan_page_elements(frame(spark, list(enumerate(tags)))).collect()
    want = []
    for page, tag in enumerate(tags):
        parser = _Inputs()
        parser.feed(tag)
        want += [(page, *found) for found in parser.found]
    assert sorted((r.page_id, r.name, r.value, r.enabled) for r in got) == want


class _Tree(HTMLParser):
    """Elements with their text, by the parser's own events and a plain search of the stack."""

    def __init__(self):
        super().__init__()
        self.stack, self.found = [], []

    def cut(self, depth):
        del self.stack[depth:]

    def last(self, name):
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == name:
                return depth
            if self.stack[depth][0] == "td" and name != "td":
                break
        return None

    def handle_starttag(self, tag, attrs):
        if tag == "input" and self.last("select") is not None:
            self.cut(self.last("select"))
        if tag in ("a", "button", "select") and self.last(tag) is not None:
            self.cut(self.last(tag))
            if tag == "select":
                return
        text = []
        if tag in ("a", "button", "select", "input"):
            self.found.append((tag, text))
        if tag != "input":
            self.stack.append((tag, text))

    def handle_endtag(self, tag):
        depth = self.last(tag)
        if depth is not None:
            self.cut(depth)

    def handle_data(self, data):
        for _, text in self.stack:
            text.append(data)


_SOUP = st.lists(
    st.one_of(
        st.sampled_from("a button select div span td b".split()).map(lambda t: f"<{t}>"),
        st.sampled_from("a button select div span td b".split()).map(lambda t: f"</{t}>"),
        st.sampled_from(("<input>", "x", "yz", "<A href='>'>", "</BUTTON >", "<button type=\"<a>\">")),
    ),
    max_size=25,
).map("".join)


@settings(max_examples=300, deadline=None)
@given(html=_SOUP)
def test_tag_stack_against_a_parser(html):
    parser = _Tree()
    parser.feed(html)
    got = element_spans(html)
    order = ["button", "input", "textarea", "select", "a"]
    want = sorted(((order.index(tag), n, tag, "".join(text)) for n, (tag, text) in enumerate(parser.found)))
    assert [(e["tag"], re.sub(r"""<(?:"[^"]*"|'[^']*'|[^>"'])*>""", "", e["inner"])) for e in got] == [(t, x) for _, _, t, x in want]


def test_elements_without_an_end(spark):
    html = [
        (1, "<button>Save"), (2, "<textarea name=n>hello"), (3, "<a href=u>one<a href=v>two</a>"),
        (4, "<div><button>Go</div>after"), (5, "<table><td><a>in</td><td>out</table></a>"), (6, "<button disabled"),
        (7, "<textarea><a>raw</a></textarea><a>x</a>"), (8, "<select><option>A<input name=q><a>z"),
    ]
    got = [(r.page_id, r.tag, r.text) for r in P.scan_page_elements(frame(spark, html)).orderBy("page_id", "ord").collect()]
    assert got == [
        (1, "button", "Save"), (2, "textarea", "hello"), (3, "a", "one"), (3, "a", "two"), (4, "button", "Go"), (5, "a", "in"),
        (7, "textarea", "raw"), (7, "a", "x"), (8, "input", ""), (8, "select", "A"), (8, "a", "z"),
    ]


def test_labels_of_elements(spark):
    html = """<label for="c">Home &amp; land</label><label>Which <select id=c><option>India</option></select> one</label>
      <input id=n><label for=n>Name<label for=other>No</label> <label>Mail <input name=m></label> <a id=n>link</a>"""
    rows = {(r.tag, r.id or r.name): r.label for r in P.scan_page_elements(frame(spark, [(1, html)])).collect()}
    assert rows["select", "c"] == "Home & land Which one" and rows["input", "m"].endswith("Mail") and rows["a", "n"] == ""
    assert rows["input", "n"].startswith("Name")


def test_open_tags_take_linear_time():
    def seconds(n):
        html = "<button>x" * n + "<div><b>" * n + "</p></i>" * n + "<td>" * n + "</b>" * n
        return min(timeit.repeat(lambda: element_spans(html), number=1, repeat=3))

    assert seconds(40_000) < 30 * seconds(4_000)
    assert len(element_spans("<button>" * 50_000)) == 50_000
