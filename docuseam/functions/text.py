"""Text expressions: white space, clauses, terms, offsets, anchors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ``str.split()`` of Python sees it.
WHITE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
CLAUSE_END = r"[。！？!?；;\n]+"
STATUTE = r"《[^》]{2,40}》第[一二三四五六七八九十百千万零〇\d]+条(?:第[一二三四五六七八九十百千万零〇\d]+款)?"
LAW_NAME = r"《[^》]{2,40}》"


def or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def compact(text: Column, limit: int | None = None) -> Column:
    """One space for each run of white space, trimmed; beyond ``limit`` cut and closed with an ellipsis."""
    out = F.trim(F.regexp_replace(or_empty(text), WHITE, " "))
    if limit is None:
        return out
    return F.when(F.length(out) > limit, F.concat(F.substring(out, 1, limit - 1), F.lit("…"))).otherwise(out)


def clean_lines(text: Column) -> Column:
    """Lines stripped, blank ones dropped."""
    lines = F.transform(F.split(or_empty(text), LINES), lambda x: F.regexp_replace(x, rf"^{WHITE}|{WHITE}$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def ordered_distinct(values: Column, limit: int | None = None) -> Column:
    """Compacted values without blanks, first occurrences in order, at most ``limit``."""
    out = F.array_distinct(F.filter(F.transform(values, lambda x: compact(x)), lambda x: x != ""))
    return out if limit is None else F.slice(out, 1, limit)


def clauses(text: Column) -> Column:
    parts = F.split(compact(text), CLAUSE_END)
    return ordered_distinct(F.transform(parts, lambda x: F.regexp_replace(x, "^[ ，,、]+|[ ，,、]+$", "")), 16)


def strings(values: list[str]) -> Column:
    """An array of fixed strings, as one expression."""
    quoted = ["'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values]
    return F.expr(f"cast(array({', '.join(quoted)}) as array<string>)")


def find_terms(text: Column, terms: list[str], limit: int | None = None) -> Column:
    """Terms that occur in the text, in the order of the list."""
    found = F.filter(strings(terms), lambda t: F.contains(text, t))
    return found if limit is None else F.slice(found, 1, limit)


def any_term(text: Column, terms: list[str]) -> Column:
    """Whether one of the terms occurs; one expression for the whole list."""
    listed = [rf"\Q{t}\E" for t in terms if t]
    return text.rlike("|".join(listed)) if listed else F.lit(False)


def statutes(text: Column) -> Column:
    """Article references, then names of laws, at most 8."""
    found = F.concat(F.regexp_extract_all(text, F.lit(STATUTE), F.lit(0)), F.regexp_extract_all(text, F.lit(LAW_NAME), F.lit(0)))
    return ordered_distinct(found, 8)


def line_number(text: Column, offset: Column) -> Column:
    """Line (from 1) of a 0-based offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def context_window(text: Column, start: Column, end: Column, window: int) -> Column:
    """The text around a hit with the hit in double brackets; empty where an offset is missing."""
    a, b = F.coalesce(start, F.lit(-1)), F.coalesce(end, F.lit(-1))
    left = F.greatest(a - window, F.lit(0))
    out = F.concat(F.substring(text, left + 1, a - left), F.lit("[["), F.substring(text, a + 1, b - a), F.lit("]]"), F.substring(text, b + 1, F.lit(window)))
    return F.when((a < 0) | (b <= a), F.lit("")).otherwise(out)


def anchor_slice(text: Column, starts: list[str], ends: list[str]) -> Column:
    """From the first start anchor up to the first end anchor after it, or to the end; empty without a start."""
    first = lambda body, needles: F.array_min(F.filter(F.array(*[F.instr(body, n) for n in needles]), lambda i: i > 0))
    at = first(text, starts)
    rest = F.substring(text, at, F.length(text))
    stop = first(F.substring(rest, F.lit(2), F.length(rest)), ends)
    return F.coalesce(F.when(stop.isNull(), rest).otherwise(F.substring(rest, F.lit(1), stop)), F.lit(""))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(or_empty(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def int_or_null(x: Column) -> Column:
    return x.try_cast("int")


def float_or(x: Column, default: float) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default))


def clamp(x: Column, low, high, default) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(x, F.lit(default))))
