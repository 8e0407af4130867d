"""Delimited records by an error-recovering recursive-descent grammar.

    line    = marker | record
    record  = field { '|' field }
    field   = quoted | plain
    quoted  = '"' { character but '"' | '""' } '"'      and then '|' or the end
    plain   = { character but '|' }                     not starting with '"'; may hold '"'

A syntax error or a wrong column count is located by its offset and fails the line; the grammar resumes at every uei
followed by '|' in the same line (a lost line break) that isn't inside soundly closed quotes, else at the next line. What
parses there as a whole record that meets all rules is a valid record of the line, beside its error; so is the line's
own first record, if only a lost line break behind it is wrong. A record in a failed line ends with the line or right
before the next uei and '|'; if its last field is empty, only where that uei starts a whole record too (else it may be a
column too many).

Field rules are checked in order on records of sound syntax, so each failed line has the first reason that applies:
quoting, column_count, uei, legal_name, date. Lines of sound syntax and eight columns hold one record and aren't searched
for others. A null line has no fields and fails with column_count; an empty one likewise; markers give no row; repeated
lines are parsed each for itself; other columns of the input are not looked at.
"""

from __future__ import annotations

import datetime
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
FIELDS = ["uei", "cage_code", "status", "legal_name", "country", "initial_registration_date", "expiration_date", "primary_naics"]
REASONS = ["quoting", "column_count", "uei", "legal_name", "date"]
UEI = re.compile(r"[A-HJ-NP-Z0-9]{12}")
DATE = re.compile(r"[0-9]{8}")
UEI_LENGTH, MAX_NAME = 12, 120
ANCHOR = re.compile(r"[A-HJ-NP-Z0-9]{12}(?=\|)")
#: Blanks that are no White_Space in Unicode: fillers and characters without width.
UNSEEN_BLANKS = set("​‌‍⁠﻿᠎⠀ㅤᅟᅠﾠ­")

SCHEMA = (
    "line_id long, reason string, error_at int, resume_at int, uei string, cage_code string, status string, legal_name string,"
    " country string, initial_registration_date date, expiration_date date, primary_naics string"
)


class SyntaxFault(Exception):
    def __init__(self, at: int):
        self.at = at


class Grammar:
    """One line. Each production starts at self.at and leaves it behind what it took."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at = text, at
        self.closed: list[tuple[int, int]] = []  # quoted fields of sound syntax

    def record(self) -> list[str]:
        out = [self.field()]
        while self.at < len(self.text):
            self.at += 1  # a field ends at '|' or at the end
            out.append(self.field())
        return out

    def field(self) -> str:
        return self.quoted() if self.text.startswith('"', self.at) else self.plain()

    def plain(self) -> str:
        end = self.text.find("|", self.at)
        start, self.at = self.at, len(self.text) if end < 0 else end
        return self.text[start : self.at]

    def quoted(self) -> str:
        opened, out = self.at, self.quotation()
        if self.at < len(self.text) and self.text[self.at] != "|":
            raise SyntaxFault(self.at)
        self.closed.append((opened, self.at))
        return out

    def quotation(self) -> str:
        opened, pieces = self.at, []
        self.at += 1
        while True:
            end = self.text.find('"', self.at)
            if end < 0:
                raise SyntaxFault(opened)
            pieces.append(self.text[self.at : end])
            self.at = end + 1
            if not self.text.startswith('"', self.at):
                break
            pieces.append('"')
            self.at += 1
        return "".join(pieces)

    def starts(self) -> list[int]:
        """Where a record may start behind the line's first, as far as the closed quotes are known."""
        bare, done = [], 0
        for start, end in self.closed:
            bare += [self.text[done:start], '"' * (end - start)]
            done = end
        return [m.start() for m in ANCHOR.finditer("".join(bare) + self.text[done:], 1)]

    def last(self, starts: set[int], whole: dict[int, tuple]) -> str:
        """The last field of a record, ending with the line or before the next start."""
        begun, end = self.at, len(self.text)
        if self.text.startswith('"', begun):
            out = self.quotation()
        else:
            out = self.plain()
            if self.at < end:
                self.at = max(begun, self.at - UEI_LENGTH)
                out = self.text[begun : self.at]
        if self.at < end and (self.at not in starts or self.at == begun and self.at not in whole):
            raise SyntaxFault(self.at)
        return out

    def part(self, starts: set[int], whole: dict[int, tuple]) -> list[str]:
        """A record in a failed line."""
        out = []
        for _ in FIELDS[1:]:
            out.append(self.field())
            if self.at == len(self.text):
                raise SyntaxFault(self.at)
            self.at += 1
        return [*out, self.last(starts, whole)]


def calendar_date(s: str) -> datetime.date | None:
    if not DATE.fullmatch(s):
        return None
    try:
        return datetime.date(int(s[:4]), int(s[4:6]), int(s[6:]))
    except ValueError:
        return None


def name_fault(s: str) -> bool:
    return (
        len(s) > MAX_NAME
        or all(c.isspace() or c in UNSEEN_BLANKS for c in s)
        or (not s.isprintable() and any(unicodedata.category(c) == "Cc" for c in s))
        or "�" in s
    )


def typed(fields: list[str]) -> tuple[str | None, tuple]:
    """The first reason that applies to a record of eight fields, and its typed fields."""
    start, end = calendar_date(fields[5]), calendar_date(fields[6])
    reason = "uei" if not UEI.fullmatch(fields[0]) else "legal_name" if name_fault(fields[3]) else "date" if start is None or end is None else None
    return reason, (*fields[:5], start, end, fields[7])


def recovered(g: Grammar) -> list[tuple[int, tuple]]:
    """(offset, typed fields) of the whole records in a failed line, g being the grammar where it failed."""
    starts, whole = g.starts(), {}
    known = set(starts)
    for at in [*reversed(starts), 0]:  # from the end, as a record's end may hang on what starts there
        p = Grammar(g.text, at)
        try:
            reason, values = typed(p.part(known, whole))
        except SyntaxFault:
            continue
        if reason is None:
            whole[at] = p.at, values
    out, done = [], 0
    for at in [0, *starts]:
        if at >= done and at in whole:
            done, values = whole[at]
            out.append((at, values))
    return out


def read_records(text: str | None) -> list[tuple]:
    """(reason, error_at, resume_at, 8 fields) of a line and of each whole record found in it if its syntax or column count
    fails; none for a marker. resume_at is the first whole record behind the start of the line."""
    if text is None:
        return [("column_count", 0, None, *[None] * 8)]
    if text.startswith("BOF ") or text == "!end":
        return []
    g = Grammar(text)
    try:
        fields = g.record()
        fault = ("column_count", len(text)) if len(fields) != len(FIELDS) else None
    except SyntaxFault as e:
        fault = ("quoting", e.at)
    if fault:
        found = recovered(g)
        resume_at = next((at for at, _ in found if at), None)
        return [(*fault, resume_at, *[None] * 8), *((None, None, None, *values) for _, values in found)]
    reason, values = typed(fields)
    return [(reason, 0, None, *[None] * 8) if reason else (None, None, None, *values)]


def read_line(text: str | None) -> tuple | None:
    """What read_records says of the line itself; None for a marker."""
    return next(iter(read_records(text)), None)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in SCHEMA.split(",")]
    for b in batches:
        rows = [(i, *r) for i, t in zip(b["line_id"], b["raw_line"]) for r in read_records(t)]
        out = pd.DataFrame(rows, columns=names, dtype=object)
        yield out


def parse_records(lines: DataFrame, line_id: str = "line_id", raw_line: str = "raw_line") -> DataFrame:
    """One row per line but markers: typed fields if it is valid, else reason and the offset of the error. A failed line has
    a row of typed fields for each whole record in it besides."""
    return lines.select(F.col(line_id).cast("long").alias("line_id"), F.col(raw_line).alias("raw_line")).mapInPandas(_parse, SCHEMA)


def valid_records(lines: DataFrame, **names: str) -> DataFrame:
    return parse_records(lines, **names).where("reason is null").select("line_id", *FIELDS)


def failed_lines(lines: DataFrame, **names: str) -> DataFrame:
    return parse_records(lines, **names).where("reason is not null").select("line_id", "reason", "error_at", "resume_at")
