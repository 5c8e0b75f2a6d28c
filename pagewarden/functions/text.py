"""Text helpers with the whitespace rules of the two source languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as str.strip sees it: Unicode white space plus U+001C..U+001F.
_STRIP_SPACE = r"[\s\x1c-\x1f]"
# Whitespace as a browser script sees it.
_JS_SPACE = r"[\s\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
JS_SPACE_CLASS = _JS_SPACE


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(value: Column | str) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(
        _col(value), rf"(?U)\A{_STRIP_SPACE}+|{_STRIP_SPACE}+\z", ""
    )


def js_trim(value: Column | str) -> Column:
    return F.regexp_replace(_col(value), rf"\A{_JS_SPACE}+|{_JS_SPACE}+\z", "")


def text_or_blank(value: Column | str) -> Column:
    return F.coalesce(_col(value), F.lit(""))


def ident(value: Column | str) -> Column:
    """Identifier form: trimmed and lower-cased."""
    return F.lower(strip(text_or_blank(value)))


def squash(value: Column | str) -> Column:
    """Trimmed, lower-cased, runs of white space as one blank."""
    return F.regexp_replace(F.lower(js_trim(text_or_blank(value))), rf"{_JS_SPACE}+", " ")


def word_form(value: Column | str) -> Column:
    """Lower case, anything but a-z and 0-9 as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text_or_blank(value)), "[^a-z0-9]+", " "))


def first_filled(*values: Column | str) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_col(v), F.lit("")) for v in values])


def first_visible(*values: Column | str) -> Column:
    """First value that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(js_trim(v), F.lit("")) for v in values])


def task_pattern(pattern: str) -> str:
    """Case-insensitive, Unicode classes, and only a newline ends a line."""
    return f"(?idU){pattern}"


def search(value: Column | str, pattern: str) -> Column:
    return _col(value).rlike(task_pattern(pattern))


def group(value: Column | str, pattern: str, index: int) -> Column:
    return F.regexp_extract(_col(value), task_pattern(pattern), index)


def any_of(value: Column, phrases: tuple[str, ...]) -> Column:
    """True when the lower-cased text contains one of the phrases."""
    result = F.lit(False)
    for phrase in phrases:
        result = result | value.contains(phrase)
    return result
