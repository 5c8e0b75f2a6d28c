"""The first object of a text against a decoder tried at every brace, and in linear time."""

import json
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from pagewarden.sources import pages as P
from pagewarden.sources.answers import first_object


def refuse(name):
    raise ValueError(name)


def tried_everywhere(text):
    decoder = json.JSONDecoder(parse_constant=refuse)
    for at, char in enumerate(text):
        if char == "{":
            try:
                return text[at : decoder.raw_decode(text, at)[1]]
            except ValueError:
                pass
    return None


_PARTS = st.lists(
    st.sampled_from(['{', '}', '[', ']', '"', '"a"', ':', ',', '"a":', '1', '-0.5e3', 'true', 'x', '\\', '\\"', ' ', '\n', '{}', '{"b":[1,{"c":2}]}', 'NaN', '01', "é"]),
    max_size=30,
).map("".join)


@settings(max_examples=1500, deadline=None)
@given(text=_PARTS)
def test_first_object_is_a_raw_decode(text):
    assert first_object(text) == tried_everywhere(text)


def test_many_braces_take_little_time():
    n = 100_000
    texts = [
        "{" * n, '{"a":' * n, '{"a":' * n + "bad" + "}" * n, '{"{' * n, '{"a":[' * n + "]}" * n + "!", '{" ' + "{ " * n, '{"a" ' * n, '"{' * n,
        '{"x":"' + '{\\"y\\":' * n, "[{" * n,
    ]
    for text in texts:
        begin = time.time()
        first_object(text)
        assert time.time() - begin < 2, text[:20]
    assert first_object('{"a":' * 900 + "1" + "}" * 900) is not None
    assert first_object('{"a":' * 1200 + "1" + "}" * 1200).count("{") == 1000


def test_objects_in_rows(spark):
    texts = ['so: {"a": {oops} {"status": "ready"} }', '{"a":' * 1200 + "1" + "}" * 1200, "{" * 100_000, None, "none", '```json\n{"x": 1}\n```']
    rows = P.parse_plan_object(spark.createDataFrame(list(enumerate(texts)), "n int, model_text string"))
    got = {r.n: r.p for r in rows.selectExpr("n", "to_json(plan) as p").collect()}
    assert got[0] == '{"status":"ready"}' and got[1].count("{") == 1000
    assert (got[2], got[3], got[4], got[5]) == (None, None, None, '{"x":1}')
