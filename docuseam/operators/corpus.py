"""Cases, sections and chunks from documents."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CHUNK_SIZES, CLAIM_MARKER, DEFENSE_MARKER, FACT_BOUNDARY, OTHER_CHUNK_SIZE, PLEADING_TAIL, REASONING_BOUNDARY, SECTION_ORDER, SECTION_TITLES, SECTION_WEIGHTS
from ..functions import text as tx
from ..session import bounded_batches


def section_weight(section: Column, stored: Column | None = None, default: float = 0.6) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SECTION_WEIGHTS.items() for x in kv])
    return F.coalesce(*([stored] if stored is not None else []), F.try_element_at(table, section), F.lit(default))


def case_docs(documents: DataFrame) -> DataFrame:
    """Case rows of plain documents: the language stands for the reason, the source for the court."""
    full = tx.clean_lines(F.col("text"))
    return documents.select(
        F.col("doc_id"),
        F.substring_index(F.col("doc_id").cast("string"), "#", 1).alias("case_code"),
        F.concat_ws(" ", F.col("source"), F.col("lang")).alias("case_name"),
        F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown")).alias("court_name"),
        F.col("lang").alias("reason"),
        full.alias("full_text"),
        F.sha2(full.cast("binary"), 256).alias("full_text_hash"),
    )


def full_text(documents: DataFrame) -> DataFrame:
    """Labelled parts without the empty ones, joined by blank lines, then cleaned."""
    parts = F.array(F.concat(F.lit("法院："), tx.or_empty(F.col("source"))), F.concat(F.lit("案由："), tx.or_empty(F.col("lang"))), F.concat(F.lit("正文："), tx.or_empty(F.col("text"))))
    kept = F.filter(parts, lambda p: ~p.endswith("："))
    return documents.select("doc_id", tx.clean_lines(F.array_join(kept, "\n\n")).alias("full_text"))


def chunks(documents: DataFrame) -> DataFrame:
    """Paragraph chunks: stripped lines that are not blank, with section, ordinals and ids.

    Sections follow the fixed order in a cycle, so every document has the same
    layout. The section index counts all lines, the chunk index only kept ones.
    """
    lines = F.transform(F.split(tx.or_empty(F.col("text")), "\n"), lambda x: F.trim(x))
    rows = documents.select("doc_id", "lang", "source", F.posexplode(lines).alias("section_index", "chunk_text")).where("chunk_text <> ''")
    order = F.array(*[F.lit(s) for s in SECTION_ORDER])
    rows = rows.withColumn("section_type", F.get(order, F.col("section_index") % len(SECTION_ORDER)))
    return rows.withColumn("chunk_id", F.format_string("%s#%s#%02d#%03d", F.col("doc_id").cast("string"), "section_type", "section_index", F.lit(0)))


def with_ordinals(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("section_index", "chunk_id")
    return rows.withColumn("chunk_index_in_case", F.row_number().over(w) - 1)


def with_links(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("section_index", "chunk_id")
    return rows.withColumn("prev_chunk_id", F.lag("chunk_id", 1, "").over(w)).withColumn("next_chunk_id", F.lead("chunk_id", 1, "").over(w))


def embedding_text(rows: DataFrame) -> DataFrame:
    """Labelled lines for the embedder, empty ones left out."""
    line = lambda label, x: F.when(tx.or_empty(x) != "", F.concat(F.lit(label), x))
    title = F.try_element_at(F.create_map(*[F.lit(x) for kv in SECTION_TITLES.items() for x in kv]), F.col("section_type"))
    return rows.withColumn("embedding_text", F.concat_ws("\n", line("案由：", F.col("lang")), line("法院：", F.col("source")), line("段落：", title), line("", F.col("chunk_text"))))


PLACED = "array<struct<start:int,end:int,line_start:int,line_end:int>>"


def place_pieces(text: str | None, pieces: Iterable[str | None]) -> Iterator[tuple[int, int | None]]:
    """(start, end), 0-based, of a case's pieces in its full text; see ``chunk_spans``."""
    text, hint = text or "", 0
    for piece in pieces:
        if piece is None:
            yield 0, None
            continue
        lines = [piece]
        at = _find(text, piece, hint)
        if at < 0:
            lines = _clean(piece).split("\n")
            at = _find(text, lines[0], hint) if lines[0] else -1
        if at < 0:
            yield 0, len(piece)
            continue
        hint = at + len(lines[0])
        for line in lines[1:]:
            found = text.find(line, hint)
            hint = found + len(line) if found >= 0 else hint
        yield at, hint


def _find(text: str, part: str, at: int) -> int:
    """Where a part starts, looked for from a place on, else anywhere; an empty one starts the text."""
    found = text.find(part, at) if part else 0
    return text.find(part) if found < 0 and at > 0 else found


def placed(text: Column, pieces: Column) -> Column:
    """Array of start, end and their lines of a case's pieces, an array of texts, in its full text; see ``chunk_spans``.

    One pass over the text of a case: lines come from the places of its line feeds.
    """

    @F.pandas_udf(PLACED)
    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        def one(t, pieces):
            if pieces is None:
                return None
            feeds = [m.start() for m in re.finditer("\n", t)] if t is not None else None
            line = lambda at: bisect_left(feeds, at) + 1 if feeds is not None and at is not None else None
            return [{"start": a, "end": b, "line_start": line(a), "line_end": line(b)} for a, b in place_pieces(t, pieces)]

        return pd.Series([one(t, x) for t, x in zip(texts, lists, strict=True)], dtype=object)

    return run(text, pieces)


def chunk_spans(text: Column, chunks: Column) -> Column:
    """Array of (chunk_id, start, end), 0-based, of a case's chunks in its full text.

    ``chunks``: array of (chunk_id, chunk_text) in order. Each is looked for from
    the end of the one before, else anywhere; if it does not occur as a whole, by
    its first line and on through those of the others that follow; else it
    counts from the start of the text and the next search is not moved.
    """
    places = placed(text, F.transform(chunks, lambda c: c["chunk_text"]))
    return F.zip_with(chunks, places, lambda c, p: F.struct(c["chunk_id"].alias("chunk_id"), p["start"].alias("start"), p["end"].alias("end")))


def locate_chunks(rows: DataFrame, cases: DataFrame, text: str = "full_text") -> DataFrame:
    """chunk_id, char_start, char_end, line_start and line_end of every chunk. ``cases``: doc_id and the full text."""
    bounded_batches(rows.sparkSession)
    per = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_index", "chunk_id", "chunk_text"))).alias("xs"))  # the chunks of one case
    both = per.join(cases.select("doc_id", F.col(text).alias("t")), "doc_id")
    spans = both.select(F.transform("xs", lambda x: x["chunk_id"]).alias("ids"), placed(F.col("t"), F.transform("xs", lambda x: x["chunk_text"])).alias("at"))
    found = spans.select(F.explode(F.arrays_zip("ids", "at")).alias("s"))
    return found.select(F.col("s.ids").alias("chunk_id"), F.col("s.at.start").alias("char_start"), F.col("s.at.end").alias("char_end"), "s.at.line_start", "s.at.line_end")


def section_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("section_type").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk_text")).alias("chars"))


# --- splitting with sequential state -----------------------------------------


def _clean(text: str) -> str:
    return "\n".join(x for line in text.splitlines() if (x := line.strip()))


def _cuts(text: str, most: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Pieces of at most ``most`` characters, ended after the last full stop or line feed of their second half if there is one."""
    start = end = 0
    while end < len(text):
        end = start + most
        if end < len(text):
            stop = max(text.rfind(mark, start + most // 2, end) for mark in "。\n")
            end = stop + 1 if stop > start else end
        end = min(end, len(text))
        yield start, end
        start = max(start + 1, end - overlap)


def split_text(text: str, most: int, overlap: int) -> list[str]:
    """The cleaned text in cleaned pieces; a text that fits is one piece."""
    text = _clean(text)
    return [piece for a, b in _cuts(text, most, overlap) if (piece := _clean(text[a:b]))]


def marker_units(text: str, boundary: str) -> list[str]:
    """Each paragraph cut before every place where the boundary matches, stripped, without empty ones."""
    return [unit for line in _clean(text).splitlines() for part in re.split(boundary, line) if (unit := part.strip())]


def pack(units: list[str], most: int, overlap: int) -> list[str]:
    """Greedy packing of units, joined by line feeds, into pieces of at most ``most`` characters; longer units are split by themselves."""
    out: list[str] = []
    open_ = False  # whether the last piece may still grow
    for unit in units:
        if len(unit) > most:
            out += split_text(unit, most, overlap)
            open_ = False
        elif open_ and len(out[-1]) + 1 + len(unit) <= most:
            out[-1] += "\n" + unit
        else:
            out.append(unit)
            open_ = True
    return out


def merge_short_heads(units: list[str], least: int = 12) -> list[str]:
    """A unit under ``least`` characters joins exactly the one after it; a short last one stays."""
    rest, out = iter(units), []
    for unit in rest:
        out.append(unit + next(rest, "") if len(unit) < least else unit)
    return out


def split_section(section: str, text: str) -> list[str]:
    most, overlap = CHUNK_SIZES.get(section, OTHER_CHUNK_SIZE)
    if section == "facts":
        return pack(marker_units(text, FACT_BOUNDARY), most, overlap)
    if section == "reasoning":
        units = merge_short_heads(marker_units(text, REASONING_BOUNDARY))
        return [p for u in units for p in (split_text(u, most, overlap) if len(u) > most else [u])]
    return split_text(text, most, overlap)


def marker_parts(text: Column, boundary: str) -> Column:
    """``marker_units`` as an expression: the units of all paragraphs in order."""
    lines = F.split(tx.clean_lines(text), "\n")
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, boundary)))
    return F.filter(F.transform(parts, tx.clean_lines), lambda x: x != "")


def pleading_sections(text: Column) -> Column:
    """Array of (section_type, text): pleadings cut before each party's statement, claims or defense by who speaks.

    What stands before the first marker counts as claims; the tail from the
    first mention of the exchange of evidence on is left out.
    """
    body = tx.clean_lines(F.split(tx.or_empty(text), PLEADING_TAIL)[0])
    parts = F.transform(F.split(body, f"(?={CLAIM_MARKER}|{DEFENSE_MARKER})"), tx.clean_lines)
    kind = lambda x: F.when(x.rlike(f"^{DEFENSE_MARKER}"), "defense").otherwise("claims")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.struct(kind(x).alias("section_type"), x.alias("section_text")))


def split_sections(sections: DataFrame, section: str = "section_type", text: str = "section_text") -> DataFrame:
    """Chunks of sections with the splitter of their kind; Arrow batches, one row per chunk."""

    @F.pandas_udf("array<string>")
    def pieces(kind: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series([split_section(k, b or "") for k, b in zip(kind, body, strict=True)])

    return sections.select("*", F.posexplode(pieces(F.col(section), F.col(text))).alias("chunk_index_in_section", "chunk_text"))
