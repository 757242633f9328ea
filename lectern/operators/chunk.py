"""Chunkers: a page becomes ordered rows. pages(page_id, markdown, ...) -> (..., pos, chunk_id, text).

All columns of the input but the text go along. Null and blank pages have no chunk.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.arrays import once
from ..functions.text import strip


#: Pages whose segments a task has as Python lists at a time.
PAGES_STEP = 64


def explode_chunks(pages: DataFrame, name: str, pieces: Column, page_col: str = "page_id", text_col: str = "markdown") -> DataFrame:
    """One row for each piece of an array column, in order; ids are ``<page>::<name>#<pos>``."""
    keep = [c for c in pages.columns if c != text_col]
    rows = pages.select(*keep, F.posexplode(pieces).alias("pos", "text"))
    return rows.select(*keep, "pos", F.concat(F.col(page_col).cast("string"), F.lit(f"::{name}#"), F.col("pos").cast("string")).alias("chunk_id"), "text")


def fixed_name(size: int, overlap: int) -> str:
    return f"fixed{size}" + (f"_ov{overlap}" if overlap else "")


def _windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows of ``size`` characters that begin ``overlap`` before the last one's end. An end inside a word moves
    back to the last blank of the window's second half, if the next window still advances."""
    out, begin, n = [], 0, len(text)
    half = (size - overlap) // 2
    while True:
        end = begin + size
        if end >= n:
            out.append(text[begin:])
            break
        if not text[end].isspace():
            blank = text.rfind(" ", begin + half, end)
            end = blank if blank > begin + overlap else end
        out.append(text[begin:end])
        begin = end - overlap
    return [p for p in map(str.strip, out) if p]


def fixed_chunks(pages: DataFrame, size: int = 500, overlap: int = 0, page_col: str = "page_id", text_col: str = "markdown") -> DataFrame:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError(f"size {size} must be positive and overlap {overlap} in [0, size)")

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _windows(t.strip(), size, overlap) if t and t.strip() else [])

    return explode_chunks(pages, fixed_name(size, overlap), cut(F.col(text_col)), page_col, text_col)


def header_pieces(text: Column, max_level: int) -> Column:
    """Pieces that begin at headers of the level or above; what stands before the first is a piece too."""
    marked = F.regexp_replace(strip(text), r"(?mdU)^(#{1,6})\s+(.+?)\s*$", "\x01$0")
    if max_level < 6:
        marked = F.regexp_replace(marked, rf"\x01(#{{{max_level + 1},6}}(?!#))", "$1")
    return F.filter(F.transform(F.split(marked, "\x01"), strip), lambda p: p != "")


def header_chunks(pages: DataFrame, max_level: int = 3, page_col: str = "page_id", text_col: str = "markdown") -> DataFrame:
    if not 1 <= max_level <= 6:
        raise ValueError(f"max_level {max_level} must be in [1, 6]")
    return explode_chunks(pages, f"md_h{max_level}", header_pieces(F.col(text_col), max_level), page_col, text_col)


def native_pieces(text: Column, min_chars: int) -> Column:
    """Paragraphs between blank lines, of at least ``min_chars``; the whole page where none is."""
    parts = lambda whole: F.filter(F.transform(F.split(whole, r"(?U)\n\s*\n+"), strip), lambda p: F.length(p) >= min_chars)
    none = F.array().cast("array<string>")
    # Each text is stripped and split once.
    return once(strip(text), lambda whole: F.when(whole == "", none).otherwise(once(parts(whole), lambda own: F.when(F.size(own) > 0, own).otherwise(F.array(whole)))))


def native_chunks(pages: DataFrame, min_chars: int = 30, page_col: str = "page_id", text_col: str = "markdown") -> DataFrame:
    return explode_chunks(pages, "parser_native", native_pieces(F.col(text_col), min_chars), page_col, text_col)


def line_segments(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), lambda p: p != "")


def line_chunks(pages: DataFrame, page_col: str = "page_id", text_col: str = "markdown") -> DataFrame:
    return explode_chunks(pages, "lines", line_segments(F.col(text_col)), page_col, text_col)


def overlap_drop(segments: list[str], start: int, end: int) -> int | None:
    """Offline stand-in for a topic model: the first segment that shares no word with the one before it."""
    for i in range(start + 1, end):
        if not set(segments[i - 1].lower().split()) & set(segments[i].lower().split()):
            return i
    return None


def topic_chunks(pages: DataFrame, boundary: Callable[[list[str], int, int], int | None] = overlap_drop, window: int = 8, max_segments: int = 12, page_col: str = "page_id", text_col: str = "markdown") -> DataFrame:
    """Segments joined up to where ``boundary(segments, start, end)`` sees the topic change. An answer outside
    (start, end] means no change in the window. A chunk has ``max_segments`` at most."""
    def joined(segments) -> list[str]:
        segments, out, at = list(segments if segments is not None else []), [], 0
        while at < len(segments):
            end = min(at + window, len(segments))
            cut = boundary(segments, at, end) if len(segments) > 1 else end
            cut = min(cut if cut is not None and at < cut <= end else end, at + max_segments)
            out.append("\n".join(segments[at:cut]))
            at = cut
        return out

    keep = [c for c in pages.columns if c != text_col]

    def cut(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, PAGES_STEP):
                some = batch.slice(i, PAGES_STEP)
                yield pa.record_batch([*some.columns[:-1], pa.array(map(joined, some.column(len(keep)).to_pylist()), pa.list_(pa.string()))], names=[*keep, "_pieces"])

    schema = T.StructType([*(f for f in pages.schema if f.name != text_col), T.StructField("_pieces", T.ArrayType(T.StringType()))])
    cuts = pages.select(*keep, line_segments(F.col(text_col)).alias("_segments")).mapInArrow(cut, schema)
    return explode_chunks(cuts, "lumberchunker", F.col("_pieces"), page_col, "_pieces")


def midpoint_split(text: Column, min_each: int = 20) -> Column:
    """STRUCT(head, tail) cut at the white space nearest to the middle, left on ties, at most an eighth of the text
    away (else cut there); null where a part is shorter than ``min_each``."""
    n = F.length(text)
    mid, reach = F.floor(n / 2).cast("int"), F.greatest(F.lit(1), F.floor(n / 8)).cast("int")
    left, right = F.substring(text, mid - reach + 2, reach), F.substring(text, mid + 1, reach)
    back = mid - reach + F.length(left) - F.length(F.regexp_extract(left, r"[^ \t\n]*\z", 0))
    ahead = mid + F.length(F.regexp_extract(right, r"^[^ \t\n]*", 0))
    at = F.when(ahead - mid < mid - back, ahead).otherwise(back)
    parts = once(F.struct(text.alias("t"), at.alias("at")), lambda x: F.struct(strip(F.substring(x["t"], F.lit(1), x["at"])).alias("head"), strip(F.substring(x["t"], x["at"] + 1, F.length(x["t"]))).alias("tail")))
    none = F.lit(None).cast("struct<head:string,tail:string>")
    whole = once(parts, lambda p: F.when(F.least(F.length(p["head"]), F.length(p["tail"])) >= min_each, p).otherwise(none))
    return F.when(n >= 2 * min_each, whole).otherwise(F.struct(F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("tail")))


def expand_span(span: Column, text: Column, low: int = 200, high: int = 800) -> Column:
    """The lines around the first occurrence of a span, at least half of ``low`` to each side; centred on the span and
    clipped where that is longer than ``high``. Null where the span does not occur or nothing is left."""
    at = F.instr(text, span) - 1  # from 0
    n, m = F.length(text), F.length(span)
    half = F.greatest(F.lit(low // 2), m)
    begin, end = F.greatest(at - half, F.lit(0)), F.least(n, at + m + half)
    head = F.substring(text, F.lit(1), begin)
    last = F.substring_index(head, "\n", -1)
    start = begin - F.length(last)
    rest = F.substring(text, end + 1, n)
    stop = end + F.length(F.substring_index(rest, "\n", 1))
    wide = strip(F.substring(text, start + 1, stop - start))
    centre = at + F.floor(m / 2).cast("int")
    a, b = F.greatest(centre - high // 2, F.lit(0)), F.least(n, centre + high // 2)
    out = F.when(F.length(wide) > high, strip(F.substring(text, a + 1, b - a))).otherwise(wide)
    return F.when((at >= 0) & (out != ""), out)


def adjacent(chunks: DataFrame, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Neighbouring chunks of a page: (*by, pos, prev_text, next_text). Pages never meet."""
    w = Window.partitionBy(*by).orderBy("pos")
    return chunks.select(*by, "pos", F.col("text").alias("prev_text"), F.lead("text").over(w).alias("next_text")).where(F.col("next_text").isNotNull())


def neighbours(pages: DataFrame, pieces: Column, page_col: str = "page_id") -> DataFrame:
    """What ``adjacent`` gives of the chunks of an array column, inside each page's row: no text crosses an exchange."""
    pairs = lambda p: F.zip_with(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda x, y: F.struct(x.alias("prev_text"), y.alias("next_text")))
    return pages.select(page_col, F.posexplode(once(pieces, pairs)).alias("pos", "p")).select(page_col, "pos", "p.prev_text", "p.next_text")


def boundary_positions(chunks: DataFrame, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = chunks.select(*by, "pos", F.length("text").alias("_n"))  # lengths cross the exchange, not texts
    return sizes.select(*by, "pos", F.sum("_n").over(w).cast("long").alias("position"))


def joined_spans(chunks: DataFrame, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Where each chunk stands in its page's chunks joined by line breaks: (*by, pos, span_start, span_end)."""
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = chunks.select(*by, "pos", "chunk_id", F.length("text").alias("_n"))  # lengths cross the exchange, not texts
    end = F.sum(F.col("_n") + 1).over(w) - 1
    return sizes.select(*by, "pos", "chunk_id", (end - F.col("_n")).cast("long").alias("span_start"), end.cast("long").alias("span_end"))


def overlapping_tokens(spans: DataFrame, offsets: DataFrame, by: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Tokens (tok, tok_start, tok_end) that overlap a chunk's span, empty tokens excluded: an interval join inside a page."""
    inside = (F.col("tok_start") < F.col("span_end")) & (F.col("tok_end") > F.col("span_start")) & (F.col("tok_end") > F.col("tok_start"))
    return spans.join(offsets, list(by)).where(inside)


def boundary_jaccard(a: Column, b: Column, tolerance: int = 50) -> Column:
    """Positions of either side that have one of the other within the tolerance: the smaller count by the larger side."""
    def share(x: Column, y: Column) -> Column:
        near = lambda p, q: F.size(F.filter(p, lambda u: F.exists(q, lambda v: F.abs(u - v) <= tolerance)))
        both = F.least(near(x, y), near(y, x)) / F.greatest(F.size(x), F.size(y), F.lit(1))
        return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both)

    return once(F.array_distinct(a), lambda x: once(F.array_distinct(b), lambda y: share(x, y)))


def boundaries_near(positions: DataFrame, a: str, b: str, tolerance: int = 50, by: str = "page_id") -> DataFrame:
    """(by, nx, ny, jaccard) of pages with boundaries (by, system, position) of both systems: as ``boundary_jaccard``, by one
    sweep over a page's sorted positions, so a page of many boundaries costs no more than their sort."""
    rows = positions.where(F.col("system").isin(a, b)).select(by, "system", "position").distinct()
    w = Window.partitionBy(by).orderBy("position")
    other = lambda s, window, pick: pick(F.when(F.col("system") != s, F.col("position"))).over(window)
    before, after = w.rangeBetween(Window.unboundedPreceding, Window.currentRow), w.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    last = F.when(F.col("system") == a, other(a, before, F.max)).otherwise(other(b, before, F.max))
    first = F.when(F.col("system") == a, other(a, after, F.min)).otherwise(other(b, after, F.min))
    near = F.coalesce(F.col("position") - last <= tolerance, F.lit(False)) | F.coalesce(first - F.col("position") <= tolerance, F.lit(False))
    of = lambda s, c: F.count(F.when((F.col("system") == s) & c, 1))
    sums = rows.withColumn("_near", near).groupBy(by).agg(of(a, F.lit(True)).alias("nx"), of(b, F.lit(True)).alias("ny"), of(a, F.col("_near")).alias("mx"), of(b, F.col("_near")).alias("my"))
    return sums.where("nx > 0 AND ny > 0").select(by, "nx", "ny", (F.least("mx", "my") / F.greatest("nx", "ny")).alias("jaccard"))


#: Chunkers by name.
CHUNKERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "fixed500": lambda p: fixed_chunks(p, 500),
    "fixed500_ov200": lambda p: fixed_chunks(p, 500, 200),
    "fixed1000_ov200": lambda p: fixed_chunks(p, 1000, 200),
    "md_h1": lambda p: header_chunks(p, 1),
    "md_h2": lambda p: header_chunks(p, 2),
    "md_h3": lambda p: header_chunks(p, 3),
    "parser_native": native_chunks,
    "lumberchunker": topic_chunks,
}
