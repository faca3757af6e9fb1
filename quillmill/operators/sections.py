"""Rules that follow a text from line to line: sections of tables and references, and lines that come again.

What a line means depends on all before it, so a text passes once through Python in Arrow batches; rows stay where they are.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..functions import citations as fixed
from ..functions.rewriting import rewrite

#: A section goes if its confidence is above this; it can end after this many lines.
CONFIDENCE, SHORTEST = 0.8, 5
_START = re.compile("|".join(fixed.SECTION_STARTS), re.IGNORECASE)
_NOT_PROSE = re.compile(r"^[A-Z]{2,}|\d+\.\d+|[:\t]")
SCHEMA = "sections array<struct<kind: string, confidence: double, start: int, lines: int, chars: int>>"


def line_shape(line: str) -> tuple[int, float, float]:
    """Words; share of signs among characters that aren't spaces; share of capitals among letters."""
    solid = len(line.replace(" ", ""))
    letters = sum(map(str.isalpha, line))
    return len(line.split()), len(re.findall(r"[^\w\s]", line)) / solid if solid else 0.0, sum(map(str.isupper, line)) / letters if letters else 0.0


def is_prose(line: str) -> bool:
    words, signs, capitals = line_shape(line)
    return words > 15 and signs < 0.15 and capitals < 0.3 and not _NOT_PROSE.search(line)


def section_kind(lines: list[str]) -> tuple[str, float]:
    """The kind of a section and the confidence that it isn't prose: the last test that holds names it."""
    full = [x.strip() for x in lines if x.strip()]
    if not full:
        return "empty", 0.0
    n = len(full)
    words, signs, capitals = (sum(x) / n for x in zip(*map(line_shape, full), strict=True))
    share = lambda p: sum(bool(re.search(p, x)) for x in full) / n
    short = sum(len(x.split()) < 5 for x in full) / n
    tests = [
        (signs > 0.35, 0.3, "technical_table"),
        (capitals > 0.4, 0.25, "gene_list"),
        (short > 0.7, 0.2, "tabular_data"),
        (share(r"\t|\s{3,}") > 0.3, 0.3, "formatted_table"),
        (share(r"^[A-Z0-9]{2,}\s+[A-Z0-9]{2,}") > 0.3, 0.35, "gene_table"),
        (share(r"\d+\.\d+|\d+%") > 0.8, 0.25, "numeric_data"),
    ]
    kind, sure = "unknown", 0.0
    for holds, weight, name in tests:
        if holds:
            kind, sure = name, sure + weight
    return kind, min(1.0, sure + (0.15 if words < 5 else 0.0))


def appendix_sections(text: str) -> dict:
    """The text without the sections that are surely no prose, and what was removed."""
    kept: list[str] = []
    gone: list[dict] = []
    section: list[str] = []
    began = 0

    def close() -> None:
        kind, sure = section_kind(section)
        if sure > CONFIDENCE:
            gone.append({"kind": kind, "confidence": sure, "start": began, "lines": len(section), "chars": sum(map(len, section))})
        else:
            kept.extend(section)
        section.clear()

    for number, line in enumerate(text.splitlines(), 1):
        s = line.strip()
        if not section:
            if s and _START.search(s):
                began = number
                section.append(line)
            else:
                kept.append(line)
        elif s and len(section) >= SHORTEST and is_prose(s):
            close()
            kept.append(line)
        else:
            section.append(line)
    if section:
        close()
    return {"text": "\n".join(kept), "sections": gone}


def without_repeats(text: str, recent: int = 5) -> str:
    """The text without lines that equal one of the last `recent` different lines kept; blank lines stay."""
    memory: list[str] = []
    kept = []
    for line in text.splitlines():
        s = line.strip()
        if s and s in memory:
            if not (s.startswith("[DEBUG:") and s.endswith("]")):
                continue
        elif s:
            memory = [*memory, s][-recent:]
        kept.append(line)
    return "\n".join(kept)


def drop_sections(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its text without appendix sections, and `sections` that were removed; a null text stays null."""
    return rewrite(df, text, appendix_sections, SCHEMA)


def drop_repeats(df: DataFrame, text: str = "text", recent: int = 5) -> DataFrame:
    return rewrite(df, text, lambda t: {"text": without_repeats(t, recent)})
