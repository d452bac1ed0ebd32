"""Markdown notes as pages and blocks.

A document is one text value, so what its lines are is found by one pass over them where the row is read:
a fold whose state is the open fence, and counts of marks. No line is dealt out, no window is opened, and
a document of a million lines takes a million steps. Texts are taken from the lines by column
expressions. A line ends at a line feed and, unless ``returns`` is off, at a carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx

# Line patterns of the format, and type sizes given to headings and text.
BREAK = r" {0,3}([-*_])(?: *\1){2,} *"
HEADING = r" {0,3}(#{1,6})[\s\x0B\x1C-\x1F\x85\p{Z}]+(.*?)[\s\x0B\x1C-\x1F\x85\p{Z}]*#*[\s\x0B\x1C-\x1F\x85\p{Z}]*"
FENCE = r" {0,3}(`{3,}|~{3,})"
BULLET = r"([\s\x0B\x1C-\x1F\x85\p{Z}]*)([-*+]|\p{Nd}{1,3}[.)])[\s\x0B\x1C-\x1F\x85\p{Z}]+(.*)"
QUOTE = r" {0,3}> ?(.*)"
TABLE_ROW = r"[\s\x0B\x1C-\x1F\x85\p{Z}]*\|.*\|[\s\x0B\x1C-\x1F\x85\p{Z}]*"
TABLE_RULE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]*\|?[\s:|-]+\|[\s:|-]*"
HEADING_PT = (30.0, 24.0, 19.0, 16.0, 14.0, 13.0)
BODY_PT, CODE_PT = 14.0, 12.0

def lines_of(documents: DataFrame, text: str = "text", returns: bool = True) -> DataFrame:
    others = [c for c in documents.columns if c != text]
    uniform = F.regexp_replace(text, r"\r\n?", "\n") if returns else F.col(text)
    return documents.select(*others, F.posexplode(F.split(uniform, "\n")).alias("line_no", "line"))


_break, _heading, _bullet, _quote, _row, _rule = (regex.compile(p).fullmatch for p in (BREAK, HEADING, BULLET, QUOTE, TABLE_ROW, TABLE_RULE))
_fence = regex.compile(FENCE).match

LINES = "array<struct<line_no:int,line:string,in_fence:boolean,page:bigint>>"
PAGES = "array<array<struct<line_no:int,kind:string,level:int,depth:int,table_r:bigint,lines:array<string>>>>"
_LINES = pa.list_(pa.struct([("line_no", pa.int32()), ("line", pa.string()), ("in_fence", pa.bool_()), ("page", pa.int64())]))
_PAGES = pa.list_(pa.list_(pa.struct([
    ("line_no", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("depth", pa.int32()), ("table_r", pa.int64()),
    ("lines", pa.list_(pa.string())),
])))


def blank(line: str) -> bool:
    return not line.strip(tx.SPACES)


def fences(lines: list[str]) -> list[int | None]:
    """The line that opened the fence each line is in, its two marks included; None outside. A fence is
    closed only by a mark of the character that opened it, or by the end of the document."""
    out: list[int | None] = []
    opened, mark = None, ""
    for i, line in enumerate(lines):
        found = _fence(line) if "`" in line or "~" in line else None
        if opened is None and found:
            opened, mark = i, found.group(1)[0]
            out.append(i)
        else:
            out.append(opened)
            if opened is not None and found and found.group(1)[0] == mark:
                opened = None
    return out


def pages_of(lines: list[str], fenced: list[int | None]) -> list[int | None]:
    """The page of each line, from 0; None for lines that are on none. Thematic breaks divide a
    document; else the first heading level with two or more headings; else it is one page. Break lines
    and blank pages are dropped."""
    breaks, levels = [], []
    for i, line in enumerate(lines):
        free = fenced[i] is None
        underline = i > 0 and line.startswith("-") and not blank(lines[i - 1])
        breaks.append(bool(free and not underline and _break(line)))
        found = _heading(line) if free and "#" in line else None
        levels.append(len(found.group(1)) if found else 0)
    by_break = any(breaks)
    level = next((k for k in (1, 2) if levels.count(k) >= 2), -1)
    chunk, chunks = 0, []
    for i in range(len(lines)):
        chunk += breaks[i] if by_break else levels[i] == level
        chunks.append(None if by_break and breaks[i] else chunk)
    full = sorted({c for c, line in zip(chunks, lines) if c is not None and not blank(line)})
    number = {c: n for n, c in enumerate(full)}
    return [number.get(c) for c in chunks]


def classed(line: str) -> tuple[str, int, int, str]:
    """(kind, level of a heading, depth of a list item, content) of a line outside fences."""
    if found := _heading(line) if "#" in line else None:
        return "heading", len(found.group(1)), 0, found.group(2)
    if "|" in line and _row(line):
        return "table", 0, 0, line
    if found := _bullet(line):
        return "bullet", 0, len(found.group(1)) // 2, found.group(3)
    if found := _quote(line) if ">" in line else None:
        return "quote", 0, 0, found.group(1)
    return ("blank" if blank(line) else "text"), 0, 0, line


def blocks_of(lines: list[str], fenced: list[int | None], page: list[int | None]) -> list[list[tuple]]:
    """Blocks (line_no, kind, level, depth, table_r, lines) of each page in order. Lines of one fence and
    plain lines in a row make one block, every other line one of its own; rows of one table follow each
    other, and rule rows are not counted. The marks of a fence are not part of its code."""
    out: list[list[tuple]] = [[] for _ in range(1 + max((p for p in page if p is not None), default=-1))]
    before, table_r, last_page = None, -1, None
    for i, line in enumerate(lines):
        p = page[i]
        if p is None:
            continue
        if p != last_page:
            before, table_r, last_page = None, -1, p
        if fenced[i] is not None:
            now = ("fence", fenced[i])
            if before != now:
                out[p].append((i, "fence", 0, 0, None, []))
            elif i + 1 < len(lines) and fenced[i + 1] == fenced[i] or not closes(lines, fenced, i):
                out[p][-1][5].append(line)
            before, table_r = now, -1
            continue
        kind, level, depth, content = classed(line)
        if kind == "table":
            if not _rule(line):
                table_r += 1
                out[p].append((i, kind, 0, 0, table_r, [line]))
        else:
            table_r = -1
            if kind == "text" and before == "text":
                out[p][-1][5].append(content)
            elif kind != "blank":
                out[p].append((i, kind, level, depth, None, [content]))
        before = kind
    return out


def closes(lines: list[str], fenced: list[int | None], i: int) -> bool:
    """Whether the last line of a fence is the mark that closes it."""
    found = _fence(lines[i])
    return bool(found) and found.group(1)[0] == _fence(lines[fenced[i]]).group(1)[0]


#: Bytes of text that are taken apart at once. Lines as Python values are many times their text.
PORTION = 1 << 20


def portions(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in turn, about ``PORTION`` bytes of the column ``text`` at a time: a batch holds
    ten thousand rows whatever their size, and a task should not hold the lines of all of them."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > PORTION:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def outline(value: str | None, what: str, returns: bool = True) -> list:
    """The lines of a text, or its pages of blocks."""
    value = value or ""
    lines = (value.replace("\r\n", "\n").replace("\r", "\n") if returns else value).split("\n")
    fenced = fences(lines)
    page = pages_of(lines, fenced)
    if what == "lines":
        return [(i, line, f is not None, p) for i, (line, f, p) in enumerate(zip(lines, fenced, page))]
    return blocks_of(lines, fenced, page)


def outlined(documents: DataFrame, what: str, text: str = "text", returns: bool = True) -> DataFrame:
    """``documents`` with ``_o`` in place of their text: its lines, or its pages of blocks. A null text is an empty one."""
    names = [c for c in documents.columns if c != text]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in portions(batch, len(names)):
                out = [outline(value, what, returns) for value in rows.column(len(names)).to_pylist()]
                built = pa.array(out, _LINES if what == "lines" else _PAGES)
                del out
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(names)], built], names=[*names, "_o"])

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in names)
    return documents.select(*names, text).mapInArrow(work, f"{kinds}, _o {LINES if what == 'lines' else PAGES}")


def md_fences(documents: DataFrame, text: str = "text", returns: bool = True) -> DataFrame:
    """Every line with ``in_fence``, the fence marks included."""
    rows = outlined(documents, "lines", text, returns)
    return rows.select(*rows.columns[:-1], F.inline("_o")).drop("page")


def md_pages(documents: DataFrame, text: str = "text", returns: bool = True) -> DataFrame:
    """Every line that is on a page, with its ``page``."""
    rows = outlined(documents, "lines", text, returns)
    return rows.select(*rows.columns[:-1], F.inline("_o")).where("page IS NOT NULL")


def _paged_blocks(documents: DataFrame, text: str, returns: bool) -> DataFrame:
    rows = outlined(documents, "blocks", text, returns)
    return rows.select(*rows.columns[:-1], F.posexplode("_o").alias("_p", "_blocks")).withColumn("page", F.col("_p").cast("bigint")).drop("_p")


def _cell_texts(line: Column) -> Column:
    return F.transform(F.split(F.btrim(tx.strip(line), F.lit("|")), r"\|"), lambda c: tx.strip_markdown(c))


def _texts(block: Column) -> Column:
    """The texts of a block: one, or one for each cell of a table row."""
    lines = block["lines"]
    code = F.btrim(F.array_join(lines, "\n"), F.lit("\n"))
    solid = F.exists(lines, lambda s: tx.strip(s) != "")
    prose = tx.strip(F.array_join(F.transform(lines, lambda s: tx.strip_markdown(s)), " "))
    return F.when(block["kind"] == "table", _cell_texts(F.get(lines, F.lit(0)))).when(
        block["kind"] == "fence", F.array(F.when(solid, code).otherwise(""))
    ).otherwise(F.array(prose))


def md_blocks(documents: DataFrame, text: str = "text", returns: bool = True) -> DataFrame:
    """Blocks of each page in order: headings, code, list items, quotes, paragraphs, table cells."""
    rows = _paged_blocks(documents, text, returns)
    names = [c for c in rows.columns if c not in ("_blocks", "page")]

    def parts(block: Column) -> Column:
        return F.transform(_texts(block), lambda t, cell: F.struct(
            t.alias("text"), block["kind"].alias("kind"), block["level"].alias("level"), block["depth"].alias("depth"),
            block["table_r"].alias("table_r"), F.when(block["kind"] == "table", cell.cast("bigint")).alias("table_c"),
        ))

    every = F.filter(F.flatten(F.transform("_blocks", parts)), lambda x: x["text"] != "")
    found = rows.select(*names, "page", F.posexplode(every).alias("block_index", "_b"))
    sizes = F.array(*[F.lit(s) for s in HEADING_PT])
    kind, level = F.col("_b.kind"), F.col("_b.level")
    size = F.when(kind == "fence", CODE_PT).when(level > 0, F.element_at(sizes, F.greatest(level, F.lit(1)))).otherwise(BODY_PT)
    return found.select(
        *names, "page", F.col("_b.text").alias("text"), (kind == "fence").alias("mono"), (kind == "bullet").alias("bullet"),
        F.col("_b.depth").cast("bigint").alias("depth"), level.cast("bigint").alias("heading"), size.alias("font_pt"),
        F.col("_b.table_r").alias("table_r"), F.col("_b.table_c").alias("table_c"), F.col("block_index").cast("bigint").alias("block_index"),
    )


def md_table_cells(documents: DataFrame, text: str = "text", returns: bool = True) -> DataFrame:
    """Only the table cells that are not empty, with the number of their line."""
    rows = _paged_blocks(documents, text, returns)
    names = [c for c in rows.columns if c not in ("_blocks", "page")]
    tables = rows.select(*names, "page", F.inline(F.filter("_blocks", lambda b: b["kind"] == "table")))
    cells = tables.select(*names, "page", "line_no", "table_r", F.posexplode(_cell_texts(F.get("lines", F.lit(0)))).alias("table_c", "text"))
    return cells.where("text <> ''").withColumn("table_c", F.col("table_c").cast("bigint"))
