"""Citations whose removal depends on the text around them.

Regular expressions with places and context can't be columns, so each text passes once through Python in Arrow batches, which returns
every match with its verdict; all reports are DataFrame operations on those. Rows stay where they are: no shuffle.

Two modes. By default a check sees the whole text at the match's own place and overlapping matches are removed as one
span; a page reference whose surroundings show that it belongs to the sentence stays. With `legacy` the results are those
of the rules' first implementation: checks see a slice of 50 characters on each side, cut from the text before artefacts
were removed but addressed by places in the whole; surroundings that speak for a page reference remove it; and spans are
cut from the right with ends that an overlap has made stale.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citations as fixed
from ..functions import rules
from ..functions.rewriting import rewrite

#: Authors of a list by semicolons; share of them that must look like names.
AUTHORS, NAMELIKE = (2, 12), 0.3
#: Characters that a check looks at on each side, by kind.
AROUND = {"isolated_numeric": 100, "page_references": 150}
SCHEMA = "artefacts map<string, int>, matches array<struct<type: string, match: string, start: int, end: int, accepted: boolean, reason: string>>"


def author_list(match: str) -> str | None:
    """Why a list by semicolons is no list of authors; None: it is one."""
    names = [n for n in (p.strip() for p in match.split(";")) if n]
    if not AUTHORS[0] <= len(names) <= AUTHORS[1]:
        return "number_of_authors"
    if any(not fixed.STOPWORDS.isdisjoint(n.lower().split()) for n in names):
        return "stopword"
    if any(n.isdigit() or len(n) > 30 or re.search(r"[()\[\]{}+=<>|\\/@#$%^&*]", n) for n in names):
        return "technical"
    like = sum(bool(re.fullmatch(r"[A-Za-z0-9\-'.]+", n)) for n in names)
    return None if like >= NAMELIKE * len(names) else "few_names"


def _letters_around(text: str, start: int, end: int, n: int, within: int = 0) -> bool:
    """A letter among the `n` characters before and after; before, they are the last of `within`, if it is given."""
    before = text[max(0, start - max(n, within)) : start][-n:]
    return bool(re.search("[a-zA-Z]", before) and re.search("[a-zA-Z]", text[end : end + n]))


def belongs_to_text(text: str, start: int, end: int) -> bool:
    """Whether the surroundings of a page reference are about the document's own parts, or flow like a sentence."""
    n = AROUND["page_references"]
    before, after = text[max(0, start - n) : start].lower(), text[end : end + n].lower()
    close = (before[-30:], after[:30])
    if any(w in c for w in fixed.CITING for c in close) or re.search(r" in(?: the)?\s*$", close[0]):
        return False
    both = before + after
    return any(w in both for w in fixed.STRUCTURAL) or sum(w in both for w in fixed.FLOWING) >= 3


def _page(match: str, start: int, end: int, text: str, legacy: bool) -> str | None:
    short = re.search(r"(?i)p\.?\s*\d+", match.strip())
    if not short:
        own = belongs_to_text(text, start, end)
        return None if own == legacy else "belongs_to_text" if own else "stands_apart"
    at = start + match.find(short.group())
    if _letters_around(text, at, at + len(short.group()), 15):
        return "in_sentence"
    # the first implementation starts the line before the white space that a match begins with
    return None if _alone(text, start if legacy else start + len(match) - len(match.lstrip()), end, match) else "not_alone_in_line"


def _alone(text: str, start: int, end: int, match: str) -> bool:
    """Whether the match is all of the lines from `start` to `end`."""
    stop = text.find("\n", end)
    return text[text.rfind("\n", 0, start) + 1 : stop if stop >= 0 else len(text)].strip() == match.strip()


def objection(kind: str, match: str, start: int, end: int, text: str, legacy: bool = False) -> str | None:
    """Why a match stays in the text; None: it is a citation and goes."""
    if kind == "semicolon_blocks":
        return author_list(match)
    if kind == "isolated_numeric":
        before = text[max(0, start - AROUND[kind]) : start].strip()
        return "list_item" if re.match(fixed.ENUMERATED, match) and (len(before) < 5 or before.endswith(":")) else None
    if kind == "ref_number":
        return "in_sentence" if _letters_around(text, start, end, 10, within=30) else None
    if kind == "page_references":
        return _page(match, start, end, text, legacy)
    return None


def _cut(text: str, spans: list[tuple[int, int]], replacement: str, legacy: bool) -> str:
    if legacy:
        for start, end in sorted(spans, key=lambda s: -s[0]):
            text = text[:start] + replacement + text[end:]
        return text
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], replacement]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(text: str, replacement: str = "", legacy: bool = False, validate: bool = True, patterns: dict[str, str] | None = None) -> dict:
    """One text: what is left of it, artefacts by type, every match with its verdict."""
    left, artefacts = text, {}
    for name, p in rules.ARTEFACTS.items():
        some = any(x in left for x in rules.LITERALS[name])
        left, artefacts[name] = re.subn(p, lambda _: replacement, left) if some else (left, 0)
    found, spans, low = [], [], left.lower()
    for kind, p in (patterns or fixed.PATTERNS).items():
        if not patterns and fixed.NEEDS[kind] not in low:
            continue
        for m in re.finditer(p, left):
            start, end = m.span()
            seen = text[max(0, start - 50) : end + 50] if legacy else left
            why = objection(kind, m.group(), start, end, seen, legacy) if validate else None
            found.append({"type": kind, "match": m.group(), "start": start, "end": end, "accepted": why is None, "reason": why})
            if why is None:
                spans.append((start, end))
    return {"text": _cut(left, spans, replacement, legacy), "artefacts": artefacts, "matches": found}


def scan_citations(df: DataFrame, text: str = "text", replacement: str = "", legacy: bool = False, validate: bool = True, patterns: dict[str, str] | None = None) -> DataFrame:
    """df with `artefacts` and `matches`, and its text without artefacts and accepted citations; nulls for a null text.
    A pattern that doesn't compile raises here, on the driver."""
    for p in (patterns or {}).values():
        re.compile(p)
    return rewrite(df, text, lambda t: scan(t, replacement, legacy, validate, patterns), SCHEMA)


def per_document(scanned_docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, type, found, removed, rejected): a row for each document and each type, zeros included."""
    kinds = F.array(*[F.lit(k) for k in [*rules.ARTEFACTS, *fixed.PATTERNS]])
    rows = scanned_docs.where("matches is not null").select(id_col, "artefacts", "matches", F.explode(kinds).alias("type"))
    own = F.filter("matches", lambda m: m["type"] == F.col("type"))
    plain = F.coalesce(F.element_at("artefacts", F.col("type")), F.lit(0))
    removed = plain + F.size(F.filter(own, lambda m: m["accepted"]))
    counted = rows.withColumns({"found": (plain + F.size(own)).cast("long"), "removed": removed.cast("long")})
    return counted.select(id_col, "type", "found", "removed", (F.col("found") - F.col("removed")).alias("rejected"))


def type_totals(counts: DataFrame) -> DataFrame:
    """Sums by type, documents with one, shares removed and rejected, and the risk that a pattern catches other text."""
    total = counts.groupBy("type").agg(*[F.sum(c).alias(c) for c in ("found", "removed", "rejected")], F.count_if(F.col("found") > 0).alias("docs_with"))
    share = lambda c: F.when(F.col("found") > 0, F.col(c) / F.col("found")).otherwise(F.lit(0.0))
    out = total.withColumns({"precision": share("removed"), "rejection_rate": share("rejected")})
    return out.withColumn("risk", F.when(F.col("rejection_rate") > 0.3, "High").when(F.col("rejection_rate") > 0.1, "Medium").otherwise("Low"))


def rejected_samples(scanned_docs: DataFrame, id_col: str = "doc_id", n: int = 100) -> DataFrame:
    """The first `n` rejected matches of each type in the order of documents. Rank is cut twice: first within salted
    parts, so that no task ranks all matches of a frequent type."""
    rows = scanned_docs.select(id_col, F.explode("matches").alias("m")).where("not m.accepted").select(id_col, "m.type", "m.match", "m.reason", "m.start", "m.end")
    order = [id_col, "start", "end"]
    for part in (["type", F.pmod(F.xxhash64(id_col), F.lit(64))], ["type"]):
        w = Window.partitionBy(*part).orderBy(*order)
        rows = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
    return rows


def document_totals(counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row: documents, documents with a removed citation and their share, all matches found, removed and rejected."""
    docs = counts.groupBy(id_col).agg(*[F.sum(c).alias(c) for c in ("found", "removed", "rejected")])
    out = docs.agg(F.count("*").alias("docs"), F.count_if(F.col("removed") > 0).alias("docs_with"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("found", "removed", "rejected")])
    return out.withColumn("citation_rate", F.when(F.col("docs") > 0, F.col("docs_with") / F.col("docs")).otherwise(F.lit(0.0)))


def document_metadata(scanned_docs: DataFrame) -> DataFrame:
    """scanned_docs with the fixed columns of a document's citations: {type}_found, _removed and _rejected for each type,
    citations_found, _removed and _rejected for all, had_citations."""
    out = {}
    for kind in [*rules.ARTEFACTS, *fixed.PATTERNS]:
        own = F.filter("matches", lambda m: m["type"] == kind)  # noqa: B023
        plain = F.coalesce(F.element_at("artefacts", F.lit(kind)), F.lit(0)) if kind in rules.ARTEFACTS else F.lit(0)
        out[f"{kind}_found"] = (plain + F.size(own)).cast("long")
        out[f"{kind}_removed"] = (plain + F.size(F.filter(own, lambda m: m["accepted"]))).cast("long")
    total = lambda part: sum((out[f"{k}_{part}"] for k in [*rules.ARTEFACTS, *fixed.PATTERNS]), F.lit(0))
    found, removed = total("found"), total("removed")
    out |= {"citations_found": found.cast("long"), "citations_removed": removed.cast("long"), "citations_rejected": (found - removed).cast("long"), "had_citations": removed > 0}
    return scanned_docs.withColumns(out)


def change_metrics(before: Column, after: Column) -> dict[str, Column]:
    """How a text has changed: lengths, words, and the reductions with their shares."""
    a, b = F.length(before), F.length(after)
    x, y = F.regexp_count(before, F.lit(r"\S+")), F.regexp_count(after, F.lit(r"\S+"))
    share = lambda new, old: F.when(old > 0, (old - new) / old).otherwise(F.lit(0.0))
    return {
        "original_length": a, "cleaned_length": b, "length_reduction": a - b, "length_reduction_ratio": share(b, a),
        "original_words": x, "cleaned_words": y, "word_reduction": x - y, "word_reduction_ratio": share(y, x),
    }

