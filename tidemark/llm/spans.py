"""Spans of a text found by patterns, as arrays inside the row: no shuffle, no Python.

Offsets are code points, ends exclusive. All of this is made of built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"
CHUNK = 256


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def with_spans(df: DataFrame, text: str, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """Add a column of spans, an array of (start, end, text), for each pattern, leftmost and not overlapping.

    patterns: column name to (pattern, SQL condition); texts that don't meet the condition have no match. The text
    between matches comes from splitting by the same pattern, where there are any; lengths added up give the offsets. They
    are added in chunks, so that a text with very many matches is not copied for each.
    """
    quoted = {name: sql_string(pattern) for name, (pattern, _) in patterns.items()}
    df = df.withColumns({name: F.expr(f"CASE WHEN {condition} THEN regexp_extract_all({text}, {quoted[name]}, 0) END") for name, (_, condition) in patterns.items()})
    # Matches are columns of their own by now: a text without any is read by its pattern once, not twice.
    between = {f"{name}_between": F.expr(f"CASE WHEN size({name}) > 0 THEN split({text}, {quoted[name]}, -1) END") for name in patterns}
    df = df.withColumns(between)
    out = {}
    for name in patterns:
        b, m = f"{name}_between", name
        inner = (
            f"aggregate(sequence(k * {CHUNK}, least(size({m}), (k + 1) * {CHUNK}) - 1), named_struct('at', acc.at, 'out', cast(array() as {SPAN})), "
            f"(a, i) -> named_struct('at', a.at + length({b}[i]) + length({m}[i]), 'out', concat(a.out, array(named_struct('start', a.at + length({b}[i]), 'end', a.at + length({b}[i]) + length({m}[i]), 'text', {m}[i])))))"
        )
        out[name] = F.expr(
            f"CASE WHEN size({m}) > 0 THEN aggregate(sequence(0, (size({m}) - 1) div {CHUNK}), named_struct('at', 0, 'out', cast(array() as {SPAN})), "
            f"(acc, k) -> transform(array({inner}), r -> named_struct('at', r.at, 'out', concat(acc.out, r.out)))[0]).out ELSE cast(array() as {SPAN}) END"
        )
    return df.withColumns(out).drop(*between)


LUHN = (
    "(aggregate(sequence(1, length({0})), 0, (total, at) -> total + CASE WHEN (length({0}) - at) % 2 = 0 THEN cast(substring({0}, at, 1) as int) "
    "ELSE element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substring({0}, at, 1) as int) + 1) END) % 10 = 0)"
)
"""SQL that tells whether a string of digits passes the Luhn check; {0} is the string."""


def context(text: str, span: str, left: int = 24, right: int = 12) -> tuple[str, str]:
    """SQL for the text before and after a span."""
    start, end = f"{span}.start", f"{span}.end"
    return f"substring({text}, greatest({start} - {left}, 0) + 1, least({start}, {left}))", f"substring({text}, {end} + 1, {right})"


def redacted(text: str, spans: str, mark: str) -> str:
    """SQL for the text with each of the sorted, disjoint spans replaced by a mark."""
    return (
        f"CASE WHEN size({spans}) = 0 THEN {text} ELSE array_join(transform(sequence(0, size({spans})), i -> "
        f"substring({text}, CASE WHEN i = 0 THEN 1 ELSE {spans}[greatest(i - 1, 0)].end + 1 END, "
        f"CASE WHEN i = size({spans}) THEN length({text}) ELSE {spans}[least(i, size({spans}) - 1)].start END - CASE WHEN i = 0 THEN 0 ELSE {spans}[greatest(i - 1, 0)].end END)), {sql_string(mark)}) END"
    )
