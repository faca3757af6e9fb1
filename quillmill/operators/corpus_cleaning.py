"""The whole chain of cleaning, from raw documents to those that are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import citations, cleaning, sections


def clean_corpus(df: DataFrame, text: str = "text", legacy: bool = False, replacement: str = "", score: str | None = None, lookalikes: bool = True) -> DataFrame:
    """Artefacts and checked citations, lines, captions, sections, the language gate if a column `score` is named,
    symbols, white space; documents that end blank go. A row passes Python twice in Arrow batches and is never shuffled."""
    if score:
        df = cleaning.language_gate(df, score)  # it asks nothing of the text, so it comes before the work on it
    columns = df.columns
    own = F.col(text)
    out = citations.scan_citations(df, text, legacy=legacy, replacement=replacement).select(columns)
    out = out.withColumn(text, cleaning.figure_lines(cleaning.clean_lines(own)))
    out = sections.drop_sections(out, text).select(columns)
    final = cleaning.normalize_whitespace(cleaning.normalize_symbols(own, lookalikes))
    # a generator drops blank documents: a filter would be pushed below the projection and clean every text twice
    keep = F.explode(F.filter(F.array(final), lambda t: F.length(t) > 0))
    return out.select(*[c for c in columns if c != text], keep.alias(text)).select(columns)
