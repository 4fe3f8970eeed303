"""Spans of regular-expression matches with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int>>"


def match_spans(text: Column, pattern: str, keep: tuple[int, int] | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, end), in code points, end exclusive.

    The text between matches comes from ``split`` and the matches from
    ``regexp_extract_all``; adding up their lengths gives the positions. The
    pattern must not match the empty string. ``keep``: (group, least length)
    drops matches whose group is shorter; they still take up their text.
    """
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    zipped = F.arrays_zip(pieces.alias("gap"), found.alias("len"))
    if keep:
        held = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(keep[0])), lambda g: F.length(g) >= keep[1])
        zipped = F.arrays_zip(pieces.alias("gap"), found.alias("len"), held.alias("ok"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        at = acc["at"] + x["gap"]
        end = at + F.coalesce(x["len"], F.lit(0))
        span = F.array(F.struct(at.alias("start"), end.alias("end")))
        ok = x["ok"] if keep else x["len"].isNotNull()
        return F.struct(end.alias("at"), F.when(F.coalesce(ok, F.lit(False)), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(zipped, start, step, lambda acc: acc["out"])
