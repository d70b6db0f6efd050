"""Split pasted reference lists into single references, and check their format."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.helpers import MARKER, YEAR

# How references begin.
UPPER, LETTER = "A-ZÀ-ÖØ-Þ", "A-Za-zÀ-ÖØ-öø-ÿ"
VANCOUVER = rf"[{UPPER}][{LETTER}'’`\-]{{1,80}}(?:\s+[{LETTER}'’`\-]{{1,40}}){{0,3}}\s+[A-Z][A-Z.\-]{{0,8}},"
PERSON = re.compile(rf"(?:[{UPPER}][{LETTER}'’`\-]{{1,80}},\s*(?:[{UPPER}][{LETTER}'’`\-]*|[A-Z](?:\.|\b))|{VANCOUVER})")
NAME_LIKE = re.compile(rf"(?:The\s+)?[{UPPER}][{LETTER}0-9&'’`\-()./]+")
ENTITY_PAREN_YEAR = re.compile(rf"[{UPPER}][{LETTER}0-9&'`\-()./ ]+\(\s*(?:1[89]\d{{2}}|20\d{{2}})[a-z]?\s*\)")
ENTITY_COMMA_YEAR = re.compile(rf"[{UPPER}][{LETTER}&'`\-()./ ]+,\s*(?:1[89]\d{{2}}|20\d{{2}})[a-z]?\b")
COMMA_LATER = re.compile(rf"[{UPPER}][^,]{{0,160}},")
NOISE = re.compile(r"(?:Available at|Accessed|\[Online\]|Online\.?)", re.I)
BARE_NUMBER = re.compile(rf"\s*\d{{1,3}}\s+(?={VANCOUVER})")
INLINE_NUMBER = re.compile(rf"(?<=[.!?])\s+(?:\[\d{{1,3}}\]|\d{{1,3}}[.)]?)\s+(?={VANCOUVER})")
BROKEN_URL = re.compile(r"(https?://\S*?)-[ \t]+(\S+)")
IDENTIFIED = re.compile(
    r"10\.\d{4,9}/[^\s<>\]]|https?://[^\s<>\]]|\bPMCID:\s*PMC\d+\b|\bPMID:\s*\d+\b|\b(?:Accessed|Assessed)(?: date)?\b"
    r"|\barxiv\s*[:.]\s*(?:\d{4}\.\d{4,5}|[a-z][a-z.\-]+/\d{7})(?:v[1-9]\d*)?(?![\w/])",
    re.I,
)
PLACED = re.compile(r"\b[Pp][Pp]?\.\s*\d+|\b\d+\s*[-–—]\s*\d+\b|\b\d+\s*\(\s*[A-Za-z0-9\-]+\s*\)")


#: What of the lines before is searched again with a new one: no pattern has so much on both sides of a line's end.
SEAM = 200


class _Reference:
    """The lines of one reference, and what is known of them so far: each line is searched once, with the end of those before it."""

    def __init__(self, line: str):
        self.lines: list[str] = []
        self.end = ""
        self.dated = self.identified = self.placed = False
        self.add(line)

    def add(self, line: str) -> None:
        self.lines.append(line)
        near = f"{self.end} {line}" if self.end else line
        self.dated = self.dated or bool(YEAR.search(near))
        self.identified = self.identified or bool(IDENTIFIED.search(near))
        self.placed = self.placed or bool(PLACED.search(near))
        self.end = near if len(near) <= SEAM else near[-SEAM:].partition(" ")[2]

    @property
    def complete(self) -> bool:
        return self.identified or (self.dated and self.placed)


def _starts(line: str, marked: bool, after_blank: bool, open_: _Reference) -> bool:
    """Whether a line begins a new reference after the one that is open."""
    person, noise = bool(PERSON.match(line)), bool(NOISE.match(line))
    author_like = person or bool(NAME_LIKE.match(line))
    if author_like and (marked or open_.complete):
        return True
    if noise:
        return False
    dated = bool(YEAR.search(line))
    if ((person and dated) or ENTITY_PAREN_YEAR.match(line)) and (after_blank or open_.dated):
        return True
    weak = (dated and COMMA_LATER.match(line)) or ENTITY_COMMA_YEAR.match(line)
    return bool(weak) and after_blank and open_.complete


def references(text: str | None) -> list[str]:
    """The references of a pasted list, each on one line, in order."""
    text = re.sub(r"\r?\n", "\n", text or "")
    text = INLINE_NUMBER.sub("\n", BROKEN_URL.sub(r"\1-\2", text))
    done: list[_Reference] = []
    after_blank = False
    for raw in re.split(r"\r\n?|\n", text):
        line = raw.strip()
        bare = BARE_NUMBER.match(line)
        marker = bare or MARKER.match(line)
        line = line[marker.end() :].strip() if marker else line
        if not line:
            after_blank = True
            continue
        if done and not _starts(line, marker is not None, after_blank, done[-1]):
            done[-1].add(line)
        else:
            done.append(_Reference(line))
        after_blank = False
    return [" ".join(" ".join(r.lines).split()) for r in done]


@F.pandas_udf(T.ArrayType(T.StringType()))
def reference_list(texts: pd.Series) -> pd.Series:
    return texts.map(references)


def split_references(submissions: DataFrame) -> DataFrame:
    """(submission_id, ref_no from 1, ref) of submissions (submission_id, text). No shuffle; a text without references gives no row."""
    listed = submissions.select("submission_id", F.posexplode(reference_list("text")).alias("place", "ref"))
    return listed.select("submission_id", (F.col("place") + 1).alias("ref_no"), "ref")


WARN_YEARS = "Few lines contain a valid year — may not be in a standard reference style."
WARN_NUMBERS = "Detected inline numeric citations (e.g., [1], [2]) rather than a reference list."
WARN_URLS = "Many raw URLs without bibliographic metadata — splitting/validation may be unreliable."


def format_warnings(submissions: DataFrame) -> DataFrame:
    """(submission_id, warnings array) from counts of lines, years, [n] marks and addresses."""
    text = F.coalesce("text", F.lit(""))
    lines = F.size(F.filter(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda line: line.rlike(r"(?U)\S")))
    years = F.regexp_count(text, F.lit(r"(?U)\b(?:1[89]\d{2}|20\d{2})[a-z]?\b"))
    http = F.regexp_count(text, F.lit("http"))
    warnings = F.array_compact(
        F.array(
            F.when(years < F.greatest(F.lit(1), F.floor(lines * 0.3)), WARN_YEARS),
            F.when(text.rlike(r"(?U)\[\d+\]") & (years == 0), WARN_NUMBERS),
            F.when(http > years * 2, WARN_URLS),
        )
    )
    return submissions.select("submission_id", F.when(lines > 0, warnings).otherwise(F.array().cast("array<string>")).alias("warnings"))
