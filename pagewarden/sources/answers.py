"""The first JSON object in a text, in time linear in the text.

A scan starts at a brace and reads JSON with a stack until it ends or fails. It
keeps what it learned of every brace that it read as the start of an object: where
that object ends, or that it does not. A later brace is scanned anew only if no
scan has read it, so it lay in a string or behind the failure. Two scans that are
alive at one place differ in whether they are in a string there, and a third would
agree with one of them; so no character is read more than a few times.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: nesting that the JSON parser behind VARIANT accepts.
MAX_DEPTH = 1000

_TOKEN = re.compile(
    r"""[ \t\n\r]*+(?:([{}\[\]:,])|("(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")"""
    r"""|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+|true|false|null))"""
)
# What may come next: a key or the end of an object, a key, a colon, a value, a value or the end of an array, a comma or an end.
_FIRST_KEY, _KEY, _COLON, _VALUE, _FIRST_VALUE, _NEXT = range(6)


def _scan(text: str, start: int, ends: dict[int, int | None]) -> None:
    """Read JSON from the brace at ``start``; note the end of every object on the way, None for what fails."""
    stack: list[list] = []  # [start or -1 for an array, height so far]
    at, state = start, _VALUE
    while (token := _TOKEN.match(text, at)) is not None:
        at = token.end()
        sign = token[1]
        if sign == "{" and state in (_VALUE, _FIRST_VALUE):
            ends[at - 1] = None
            stack.append([at - 1, 1])
            state = _FIRST_KEY
        elif sign == "[" and state in (_VALUE, _FIRST_VALUE):
            stack.append([-1, 1])
            state = _FIRST_VALUE
        elif (sign == "}" and stack[-1][0] >= 0 and state in (_FIRST_KEY, _NEXT)) or (
            sign == "]" and stack[-1][0] < 0 and state in (_FIRST_VALUE, _NEXT)
        ):
            began, height = stack.pop()
            if began >= 0 and height <= MAX_DEPTH:
                ends[began] = at
            if not stack:
                return
            stack[-1][1] = max(stack[-1][1], height + 1)
            state = _NEXT
        elif sign == "," and state == _NEXT:
            state = _KEY if stack[-1][0] >= 0 else _VALUE
        elif sign == ":" and state == _COLON:
            state = _VALUE
        elif token[2] is not None and state in (_FIRST_KEY, _KEY):
            state = _COLON
        elif sign is None and state in (_VALUE, _FIRST_VALUE):
            state = _NEXT
        else:
            return


def first_object(text: str | None) -> str | None:
    """The first object of a text that is whole, from the left; null without one."""
    ends: dict[int, int | None] = {}
    at = -1 if text is None else text.find("{")
    while at >= 0:
        if at not in ends:
            _scan(text, at, ends)
        if ends[at] is not None:
            return text[at : ends[at]]
        at = text.find("{", at + 1)
    return None


def first_object_of(text: Column) -> Column:
    """``first_object`` of a column."""
    return F.udf(first_object, "string", useArrow=True)(text)
