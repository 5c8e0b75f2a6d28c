"""PII detection and redaction as column expressions.

One projection finds the five PII types in a text. Each pattern is applied only
after a cheap test that cannot lose a match, and a text without a match never
reaches the span arithmetic.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewarden.functions import fixed
from pagewarden.functions.text import JS_SPACE_CLASS, let

SPAN_TYPE = (
    "array<struct<start:int,pattern_no:int,type:string,value:string,end:int>>"
)
_BLOCK = 64


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _pattern(name: str) -> str:
    # Unicode digits, letters and word edges, as the patterns are meant.
    return "(?U)" + dict(fixed.PII_PATTERNS)[name]


# Four digits, blanks or hyphens between them allowed: every type but email has them.
_DIGIT_RUN = r"\d(?:[ -]?\d){3}"


def _could_have_digits(text: Column) -> Column:
    """Cheap and loss-free test shared by the four number types."""
    return text.rlike("(?U)" + _DIGIT_RUN)


def _matches(name: str, text: Column, digits: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(_pattern(name)), F.lit(0))
    possible = text.contains("@") if name == "email" else digits
    return F.when(possible, found).otherwise(F.array().cast("array<string>"))


def prefix_sums(lengths: Column) -> Column:
    """Exclusive running sums of an array, blockwise so long arrays stay cheap."""
    zero = F.lit(0)

    def over_blocks(sums: Column) -> Column:
        # Running sum up to each block, then within the block only.
        return F.transform(
            lengths,
            lambda _, i: F.aggregate(
                F.slice(sums, F.lit(1), F.floor(i / _BLOCK).cast("int")),
                zero,
                lambda a, b: a + b,
            )
            + F.aggregate(
                F.slice(
                    lengths,
                    F.floor(i / _BLOCK).cast("int") * _BLOCK + 1,
                    (i % _BLOCK).cast("int"),
                ),
                zero,
                lambda a, b: a + b,
            ),
        )

    blocks = F.transform(
        F.sequence(zero, F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")),
        lambda b: F.aggregate(
            F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)), zero, lambda a, x: a + x
        ),
    )
    return let(blocks, over_blocks)


def _spans(name: str, number: int, text: Column, digits: Column) -> Column:
    """Matches of one type with code-point spans.

    The text between matches comes from splitting on the same pattern, so a
    match starts after all gaps up to it and all matches before it.
    """

    def placed(values: Column) -> Column:
        gaps = F.split(text, _pattern(name), -1)
        steps = F.zip_with(
            gaps,
            values,
            lambda g, v: F.length(F.coalesce(g, F.lit("")))
            + F.length(F.coalesce(v, F.lit(""))),
        )
        ends = let(steps, lambda s: F.zip_with(prefix_sums(s), s, lambda a, b: a + b))
        spans = let(
            ends,
            lambda e: F.transform(
                values,
                lambda v, i: F.struct(
                    (F.get(e, i) - F.length(v)).cast("int").alias("start"),
                    F.lit(number).alias("pattern_no"),
                    F.lit(name).alias("type"),
                    v.alias("value"),
                    F.get(e, i).cast("int").alias("end"),
                ),
            ),
        ).cast(SPAN_TYPE)
        return F.when(F.size(values) > 0, spans).otherwise(F.array().cast(SPAN_TYPE))

    return let(_matches(name, text, digits), placed)


def _wanted(types: tuple[str, ...] | None) -> list[tuple[int, str]]:
    return [
        (number, name)
        for number, (name, _) in enumerate(fixed.PII_PATTERNS)
        if types is None or name in types
    ]


def pii_spans(text: Column | str, types: tuple[str, ...] | None = None) -> Column:
    """All matches of the types, by start, ties in type order; overlaps kept."""
    source = F.coalesce(_col(text), F.lit(""))

    def found(digits: Column) -> Column:
        parts = [_spans(name, number, source, digits) for number, name in _wanted(types)]
        spans = F.sort_array(F.concat(*parts) if len(parts) > 1 else parts[0])
        return F.when(digits | source.contains("@"), spans).otherwise(F.array().cast(SPAN_TYPE))

    return let(_could_have_digits(source), found)


def token_map() -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*fixed.TOKENS.items())])


def token_of(type_: Column | str) -> Column:
    """Replacement token of a finding type, null when unknown."""
    return F.element_at(token_map(), _col(type_))


def replace_values(text: Column | str, findings: Column) -> Column:
    """Literal replacement of each finding's value, in order."""
    return F.aggregate(
        findings,
        F.coalesce(_col(text), F.lit("")),
        lambda acc, f: F.when(
            f["value"].isNotNull() & (f["value"] != "") & token_of(f["type"]).isNotNull(),
            F.replace(acc, f["value"], token_of(f["type"])),
        ).otherwise(acc),
    )


def is_credential(
    input_type: Column | str, *labels: Column | str
) -> Column:
    """Own definition: password type, or a label naming a secret."""
    # A blank in a word stands for anything but a-z and 0-9.
    words = "|".join(word.replace(" ", "[^a-z0-9]+") for word in fixed.CREDENTIAL_WORDS)
    flag = F.lower(F.trim(F.coalesce(_col(input_type), F.lit("")))) == "password"
    for label in labels:
        flag = flag | F.lower(F.coalesce(_col(label), F.lit(""))).rlike(words)
    return flag


_ASCII_EDGE = (
    r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
)


def redact_display(text: Column | str) -> Column:
    """Replace the five types one after the other, each on the result so far.

    Digits and word edges are ASCII here and there are no findings, so this may
    differ from value-based redaction.
    """
    source = _col(text)
    result = source
    # Tokens hold no digit and no "@", so tests on the original text stay valid.
    for name, pattern in fixed.PII_PATTERNS:
        ascii_pattern = pattern.replace(r"\b", _ASCII_EDGE).replace(
            r"[\s-]", f"[{JS_SPACE_CLASS[1:-1]}-]"
        )
        possible = source.contains("@") if name == "email" else source.rlike(_DIGIT_RUN)
        result = F.when(
            possible, F.regexp_replace(result, ascii_pattern, fixed.TOKENS[name])
        ).otherwise(result)
    return result
