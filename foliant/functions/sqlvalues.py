"""Helpers of the dump reader that run inside its tasks: statements of a text, tuples of one INSERT and their values."""

from __future__ import annotations

import re
from collections.abc import Iterator

# Comments: a line that begins with --, a -- with blanks around, #, and /* */.
COMMENT = r"^--[^\n]*|(?<![^\s;])--(?=\s)[^\n]*|\#[^\n]*"
# Quoted strings, comments and escapes, in which no other mark counts.
_CLOSED = (
    r"""'[^'\\]*(?:\\.[^'\\]*)*(?:'|\\?\Z)|"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)|`[^`]*(?:`|\Z)|"""
    + COMMENT
    + r"|/\*.*?(?:\*/|\Z)|\\."
)
_END = re.compile(_CLOSED + "|;", re.DOTALL | re.MULTILINE)
_PIECE = re.compile(_CLOSED + "|[(),;]", re.DOTALL | re.MULTILINE)
_GAP = r"(?:\s|--[^\n]*(?:\n|\Z)|\#[^\n]*(?:\n|\Z)|/\*.*?\*/)"
_LEAD = r"(?:\s+|--[^\n]*(?:\n|\Z)|\#[^\n]*(?:\n|\Z)|/\*.*?\*/;?)*"


def insert_header(table: str) -> re.Pattern[str]:
    """``INSERT [IGNORE ..] [INTO] `table` [(columns)] VALUES`` or ``REPLACE ..``, up to the first tuple.

    The name may stand without backticks and after a schema's.
    """
    name = re.escape(table)
    named = rf"(?:(?:`[^`]*`|\w+)\s*\.\s*)?(?:`{name}`|{name}(?![\w`]))"
    verb = rf"(?:INSERT|REPLACE)(?:{_GAP}+(?:LOW_PRIORITY|DELAYED|HIGH_PRIORITY|IGNORE))*(?:{_GAP}+INTO)?"
    columns = rf"(?:\((?:`[^`]*`|[^()`])*\){_GAP}*)?"
    return re.compile(rf"{_LEAD}{verb}{_GAP}+{named}{_GAP}*{columns}VALUES?{_GAP}*", re.DOTALL | re.IGNORECASE)


def insert_bodies(text: str, header: re.Pattern[str]) -> Iterator[str]:
    """What follows the header of each INSERT among the statements of a text, up to the end of the statement."""
    start = 0
    ends = [p.start() for p in _END.finditer(text) if p.group() == ";"]
    for end in [*ends, len(text)]:
        head = header.match(text, start, end)
        if head:
            yield text[head.end() : end]
        start = end + 1


def tuples_of(body: str) -> Iterator[list[str]]:
    """Values of each top-level ``(...)`` of a statement, up to its ``;``.

    Commas part values outside quotes; an empty last one is dropped.
    """
    depth, at, row = 0, 0, []
    for piece in _PIECE.finditer(body):
        mark = piece.group()
        if mark == ";":
            return
        if mark == "(":
            depth += 1
            if depth == 1:
                at, row = piece.end(), []
        elif mark == ")":
            depth -= 1
            if depth == 0:
                rest = body[at : piece.start()].strip()
                yield [*row, rest] if rest else row
        elif mark == "," and depth > 0:
            row.append(body[at : piece.start()].strip())
            at = piece.end()
