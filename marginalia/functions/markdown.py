"""Stateful text parsers: Markdown blocks with heading chains, links, private regions. Plain Python, wrapped as Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of blocks that a worker hands back at once, and texts that it holds as strings at once.
PIECE_CHARS, PIECE_ROWS = 1 << 20, 64

_MARK = re.compile(r"<(/?)private>")
_LIST = re.compile(r"(?:[-*+]|[0-9]+[.)]) ")
_FENCE = re.compile(r"(`{3,}|~{3,})")
_SETEXT = re.compile(r"=={1,}|--{1,}")
_WIKI = re.compile(r"\[\[(.*?)\]\]")
_LINK = re.compile(r"\]\((.*?)\)")


def private_spans(text: str) -> tuple[list[tuple[int, int]], bool]:
    """Outermost private regions, and whether the last one is never closed."""
    spans, depth, since = [], 0, 0
    for mark in _MARK.finditer(text):
        if not mark[1]:
            since = since if depth else mark.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                spans.append((since, mark.end()))
    if depth:
        spans.append((since, len(text)))
    return spans, depth > 0


def _replace_private(text: str, put) -> str:
    out, at = [], 0
    for a, b in private_spans(text)[0]:
        out += [text[at:a], put(text[a:b])]
        at = b
    return "".join(out) + text[at:]


def blank_private(text: str) -> str:
    """Private regions as blanks, so line numbers stay."""
    return _replace_private(text, lambda s: re.sub(r"[^\n]", " ", s))


def strip_private(text: str) -> str:
    return _replace_private(text, lambda s: "")


def _lines(text: str) -> list[str]:
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    return [x.removesuffix("\r") for x in lines]


def _opens(line: str) -> tuple[str, int] | None:
    m = _FENCE.match(line)
    return (m[1][0], len(m[1])) if m else None


def _closes(line: str, fence: tuple[str, int]) -> bool:
    rest = line.lstrip(fence[0])
    return len(line) - len(rest) >= fence[1] and not rest.strip()


def _underline(line: str) -> int:
    line = line.strip()
    return (1 if line[0] == "=" else 2) if _SETEXT.fullmatch(line) else 0


def frontmatter_lines(text: str) -> int:
    """Lines of a closed leading block, its marks included."""
    lines = _lines(text)
    if lines and lines[0].lstrip("\ufeff").strip() == "---":
        for i, line in enumerate(lines[1:], 2):
            if line.strip() == "---":
                return i
    return 0


def _paragraph_ends(lines: list[str], i: int) -> bool:
    line = lines[i].lstrip()
    if not line or line[0] in "#|" or _LIST.match(line) or _opens(line):
        return True
    return i + 1 < len(lines) and _underline(lines[i + 1]) > 0


def _list_end(lines: list[str], i: int) -> int:
    """End of an item that starts at i - 1: indented lines that open no item, blank lines between them included."""
    inside = lambda k: k < len(lines) and lines[k][:1] in (" ", "\t") and lines[k].strip() and not _LIST.match(lines[k].lstrip())
    while True:
        k = i
        while k < len(lines) and not lines[k].strip():
            k += 1
        if not inside(k):
            return i
        i = k + 1


def segment(text: str, skip: int = 0) -> list[tuple[int, int, str]]:
    """Statements of a text as (first line, last line, body): headings, items, table rows, fences, paragraphs."""
    lines, out, i = _lines(text), [], skip
    while i < len(lines):
        start, line = i, lines[i].lstrip()
        i += 1
        if not line:
            continue
        if fence := _opens(line):
            while i < len(lines) and not _closes(lines[i].lstrip(), fence):
                i += 1
            i = min(i + 1, len(lines))
        elif line[0] in "#|":
            pass
        elif _LIST.match(line):
            i = _list_end(lines, i)
        elif i < len(lines) and _underline(lines[i]):
            i += 1
        else:
            while i < len(lines) and not _paragraph_ends(lines, i):
                i += 1
        body = "\n".join(lines[start:i])
        if body.strip():
            out.append((start + 1, i, body))
    return out


def heading(body: str) -> tuple[int, str] | None:
    lines = _lines(body)
    first = lines[0].lstrip() if lines else ""
    level = len(first) - len(first.lstrip("#"))
    if level:
        return (level, first[level:].strip().rstrip("#").strip()) if level <= 6 and len(lines) == 1 else None
    if len(lines) == 2 and (under := _underline(lines[1])):
        return under, first.strip()
    return None


def blocks_of(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(first line, last line, body, ctx, chain) of each statement; private regions are blanked first."""
    chain: list[tuple[int, str]] = []
    header, row_end = None, 0
    for first, last, body in segment(blank_private(text), frontmatter_lines(text)):
        if found := heading(body):
            chain = [x for x in chain if x[0] < found[0]]
        names = " > ".join(t for _, t in chain if t)
        ctx = names
        if found:
            chain.append(found)
            header = None
        elif body.lstrip().startswith("|"):
            if first > row_end + 1:
                header = None
            row_end = last
            if header is None:
                header = " ".join(body.split())[:160]
            else:
                ctx = f"{names} > {header}" if names else header
        else:
            header = None
        yield first, last, body, ctx, names


def _outside_fences(text: str) -> Iterator[str]:
    fence = None
    for line in _lines(text):
        bare = line.lstrip()
        if fence:
            fence = None if _closes(bare, fence) else fence
        elif not (fence := _opens(bare)):
            yield line


def _lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def wikilinks(text: str) -> list[str]:
    """Targets of [[target|alias#part]] outside fences."""
    found = (re.split(r"[|#]", m)[0].strip() for line in _outside_fences(text) for m in _WIKI.findall(line))
    return [_lower(x) for x in found if x]


def markdown_links(text: str) -> list[str]:
    """Targets of ](file.md "title") outside fences."""
    out = []
    for line in _outside_fences(text):
        for m in _LINK.findall(line):
            target = (m.split() or [""])[0].split("#")[0].removeprefix("./")
            if target.endswith(".md"):
                out.append(_lower(target))
    return out


def block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of batches ``doc_id, text``, in batches of about PIECE_CHARS; one text at a time is held besides."""
    for batch in batches:
        rows, chars = [], 0
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            key = i.as_py()
            for b in blocks_of(t.as_py() or ""):
                rows.append((key, *b))
                chars += sum(map(len, b[2:]))
                if chars >= PIECE_CHARS:
                    yield _block_batch(rows)
                    rows, chars = [], 0
        if rows:
            yield _block_batch(rows)


def explode_blocks(docs: DataFrame) -> DataFrame:
    """``doc_id, start_line, end_line, text, ctx, chain`` of rows ``doc_id, text``; null text gives no rows."""

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(block_batches, "doc_id long, start_line int, end_line int, text string, ctx string, chain string")


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "start_line": pa.int32(), "end_line": pa.int32(), "text": pa.string(), "ctx": pa.string(), "chain": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _arrow(function, kind: str):
    """A column of ``function`` of each text. Texts become Python strings a few at a time, and no data frame holds a whole batch of them."""
    made = {"string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[kind]

    @F.arrow_udf(kind)
    def apply(column: pa.Array) -> pa.Array:
        pieces = [pa.array([None if (t := x.as_py()) is None else function(t) for x in column[k : k + PIECE_ROWS]], made) for k in range(0, len(column), PIECE_ROWS)]
        return pa.concat_arrays(pieces) if pieces else pa.array([], made)

    return apply


def links(text: Column) -> Column:
    return _arrow(lambda t: wikilinks(t) + markdown_links(t), "array<string>")(text)


def without_private(text: Column) -> Column:
    return _arrow(strip_private, "string")(text)


def blanked_private(text: Column) -> Column:
    return _arrow(blank_private, "string")(text)


def private_unbalanced(text: Column) -> Column:
    return _arrow(lambda t: private_spans(t)[1], "boolean")(text)


def fold_accents(text: Column) -> Column:
    """Lower case without diacritics, as the lexical tokenizer folds words."""
    import unicodedata

    return _arrow(lambda t: "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)), "string")(text)
