"""Document cleaning as columns: every rule stays inside the JVM and needs no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.binding import let


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(rules.BLANKS))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def _where(name: str, c: Column, some: Column, none: Column) -> Column:
    """`some` where a text holds one of the literals that the pattern needs, which costs next to nothing to tell."""
    parts = rules.LITERALS.get(name)
    if not parts:
        return some
    holds = F.contains(c, F.lit(parts[0]))
    for p in parts[1:]:
        holds = holds | F.contains(c, F.lit(p))
    return F.when(c.isNull() | holds, some).otherwise(none)


def without(c: Column, patterns: dict[str, str], replacement: str = "") -> Column:
    """The text without the matches of each pattern, one after the other; each step is computed once."""
    for name, p in patterns.items():
        c = let(c, lambda t: _where(name, t, F.regexp_replace(t, p, replacement), t))  # noqa: B023
    return c


def remove_patterns(df: DataFrame, patterns: dict[str, str], replacement: str | Callable[[str], str] = "", text: str = "text") -> DataFrame:
    """Each pattern on what the one before has left; `{name}_found` counts its matches. A replacement may depend on the
    pattern's name, as debug_tag() does."""
    own = F.col(text)
    for name, p in patterns.items():
        put = replacement(name) if callable(replacement) else replacement
        found = _where(name, own, count(own, p), F.lit(0).cast("long"))
        df = df.withColumn(f"{name}_found", found).withColumn(text, F.when(F.col(f"{name}_found") > 0, F.regexp_replace(own, p, put)).otherwise(own))
    return df


def debug_tag(kind: str) -> Callable[[str], str]:
    """What stands in a text in place of a removed match, for looking at the rules' work."""
    return lambda name: f"[DEBUG:{kind}:{name}]"


def simple_upper(c: Column) -> Column:
    """Capitals sign by sign, as DuckDB's upper() has them: a text keeps its length, and an s sharp gets its own capital.
    Texts without a letter of rules.UPPER are left to Spark; others are cut before and after each of them. ASCII is told by
    its size and inside the pattern by one range, since a class of so many signs is slow. Spark's upper() of plain strings
    goes by the JVM's language (a Turkish one dots its I) and a setting; with the root collation it goes by neither."""
    upper = lambda x: F.collate(F.upper(F.collate(x, "UNICODE")), "UTF8_BINARY")
    rare = "".join(x for x in rules.UPPER if x != "\xdf")
    special = f"[\xdf[{min(rare)}-{max(rare)}&&[{rare}]]]"
    one = lambda x: F.when(x.rlike(special), F.translate(x, "".join(rules.UPPER), "".join(rules.UPPER.values()))).otherwise(upper(x))
    parts = F.split(c, f"(?={special})|(?<={special})", -1)
    plain = (F.octet_length(c) == F.length(c)) | ~c.rlike(special)
    return F.when(plain, upper(c)).otherwise(F.array_join(F.transform(parts, one), ""))


def normalize_whitespace(c: Column) -> Column:
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"(^|\.)[ ]{2,}([A-Z])", "$1 $2")
    return strip(F.regexp_replace(c, r"(?m)^[ ]+", ""))


def whitespace_changes(df: DataFrame, text: str = "text") -> DataFrame:
    """The normalised text beside flags of what changed, and the reductions in characters and words."""
    new = normalize_whitespace(F.col(text))
    return df.withColumn("clean", new).withColumns({
        "multiple_spaces": F.col(text).rlike(r"[ \t]{2,}|\t"),
        "multiple_newlines": F.col(text).rlike(r"\n{3,}"),
        "leading_spaces": F.col(text).rlike(r"(?m)^[ ]+"),
        "outer_blanks": F.col(text) != strip(F.col(text)),
        "changed": F.col(text) != F.col("clean"),
        "length_reduction": F.length(text) - F.length("clean"),
        "word_reduction": word_count(F.col(text)) - word_count(F.col("clean")),
    })


def _linear(pattern: str) -> str:
    """A pattern that begins with a run of word signs, tried only where such a run or the last match ends: without it,
    each sign of a long run would be tried."""
    run = r"[\p{L}\p{N}_]+"
    return r"(?:(?<![\p{L}\p{N}_])|\G)" + run + "+" + pattern[len(run) :] if pattern.startswith(run) else pattern


def _symbol_steps() -> list[tuple[str, str]]:
    """Patterns and replacements in their order, up to the rules of single signs."""
    invisible = [k for k, v in rules.SYMBOLS.items() if not v]
    steps = [("[" + "".join(invisible) + "]", "")]
    steps += [(_linear(p), r) for p, r in rules.CONTENTS.values()]
    return [*steps, (rules.MANY_DOTS, "..."), (rules.SPACED_DOTS, " ... ")]


def _signs(lookalikes: bool) -> dict[str, str]:
    return (rules.LOOKALIKES if lookalikes else {}) | {k: v for k, v in rules.SYMBOLS.items() if v}


def _spelled(c: Column, lookalikes: bool) -> Column:
    signs = _signs(lookalikes)
    singles = {k: v for k, v in signs.items() if len(k) == len(v) == 1}
    c = F.translate(c, "".join(singles), "".join(singles.values()))
    for k, v in signs.items():
        if k not in singles:
            c = F.replace(c, F.lit(k), F.lit(v))
    return c


def normalize_symbols(c: Column, lookalikes: bool = True) -> Column:
    """Invisible signs, entries of contents and tables, dots, then signs. `lookalikes` rewrites Cyrillic letters, which
    is meant for texts in Latin script: a caller may choose it by language."""
    for p, r in _symbol_steps():
        c = F.regexp_replace(c, p, r)
    return _spelled(c, lookalikes)


def symbols(c: Column, lookalikes: bool = True) -> Column:
    """(text, n): normalize_symbols() and how many matches its rules have, one after the other; n is 0 if they change
    nothing. Straight quotation marks count, as one rule puts them in their own place. Each rule's text is computed once."""
    state = F.struct(c.alias("t"), F.lit(0).cast("long").alias("n"))
    for p, r in _symbol_steps():
        changed = lambda e, k: F.struct(F.when(k > 0, F.regexp_replace(e["t"], p, r)).otherwise(e["t"]).alias("t"), (e["n"] + k).alias("n"))  # noqa: B023, E731
        state = let(state, lambda e: let(count(e["t"], p), lambda k: changed(e, k)))  # noqa: B023
    signs = "[" + "".join(k for k in _signs(lookalikes) if len(k) == 1) + '"]'
    n = lambda e: e["n"] + count(e["t"], signs) + count(e["t"], ": \"'\", r")
    both = let(state, lambda e: F.struct(_spelled(e["t"], lookalikes).alias("text"), n(e).alias("n")))
    return let(both, lambda b: F.struct(b["text"].alias("text"), F.when(c != b["text"], b["n"]).otherwise(F.lit(0).cast("long")).alias("n")))


def symbol_count(c: Column, lookalikes: bool = True) -> Column:
    return symbols(c, lookalikes)["n"]


def lines(c: Column) -> Column:
    """The lines as str.splitlines() has them."""
    parts = F.split(c, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]")
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p))


def line_reasons(c: Column) -> Column:
    """Array of (line, reason) of a text; the first rule that holds names the reason, null: the line stays.

    Rules: the stripped line equals one of the five non-empty lines before it; two tabs beside another line with two;
    a short line of numbers or a label; metadata; copyright. Blank lines always stay.

    Work is in proportion to the lines: those that aren't blank are judged in an array of their own, where the lines
    before one are its neighbours, and the blank ones between them are put back by slices.
    """
    row = lambda x: F.struct(x.alias("line"), strip(x).alias("s"), (F.length(x) - F.length(F.replace(x, F.lit("\t"), F.lit("")))).alias("tabs"))

    def full(rows: Column) -> Column:
        """The lines that aren't blank, with their places and whether a line beside them has two tabs."""
        tabs = lambda k: F.coalesce(F.get(rows, k)["tabs"], F.lit(0))
        placed = F.transform(rows, lambda x, i: F.struct(i.alias("i"), x["line"].alias("line"), x["s"].alias("s"), ((x["tabs"] >= 2) & ((tabs(i - 1) >= 2) | (tabs(i + 1) >= 2))).alias("tabular")))
        return F.filter(placed, lambda x: x["s"] != "")

    def reason(f: Column, x: Column, k: Column) -> Column:
        s = x["s"]
        again = F.exists(F.slice(f, F.greatest(k - 4, F.lit(1)), F.least(k, F.lit(5))), lambda y: y["s"] == s)
        code = ((word_count(s) <= 8) & s.rlike(rules.METADATA_CODE)) | (s.rlike(rules.METADATA_CAPS) & ~s.rlike("[a-z]") & (F.length(F.replace(s, F.lit(" "), F.lit(""))) < 8))
        r = F.when(again, "repetition").when(x["tabular"], "tabular")
        r = r.when((F.length(s) <= 15) & (word_count(s) <= 3) & s.rlike(rules.SHORT_LINE), "short").when(s.rlike(rules.METADATA_KEYWORDS) | code, "metadata")
        return r.when(s.rlike(rules.COPYRIGHT), "copyright")

    out = lambda line, why: F.struct(line.alias("line"), why.alias("reason"))
    none = F.lit(None).cast("string")

    def put_back(e: Column) -> Column:
        rows, f = e["rows"], e["full"]
        blank = lambda at, n: F.transform(F.slice(rows, at + 1, F.greatest(n, F.lit(0))), lambda x: out(x["line"], none))
        after = lambda k: F.when(k >= 1, F.get(f, k - 1)["i"] + 1).otherwise(F.lit(0))
        judged = F.transform(f, lambda x, k: let(after(k), lambda a: F.concat(blank(a, x["i"] - a), F.array(out(x["line"], reason(f, x, k))))))
        last = let(after(F.size(f)), lambda a: blank(a, F.size(rows) - a))
        return F.concat(F.flatten(judged), last)

    def judged(rows: Column) -> Column:
        return let(F.struct(rows.alias("rows"), full(rows).alias("full")), put_back)

    return let(F.transform(lines(c), row), judged)


def clean_lines(c: Column, debug: bool = False) -> Column:
    """The text of the lines that no rule removes; with `debug`, a tag with the reason stands in place of the others."""
    if debug:
        return F.array_join(F.transform(line_reasons(c), lambda x: F.when(x["reason"].isNull(), x["line"]).otherwise(F.concat(F.lit("[DEBUG:lines:"), x["reason"], F.lit("]")))), "\n")
    return F.array_join(F.transform(F.filter(line_reasons(c), lambda x: x["reason"].isNull()), lambda x: x["line"]), "\n")


def figure_lines(c: Column) -> Column:
    """The text without captions and without short lines that are mostly numbers, unless they hold mathematics."""

    def goes(x: Column) -> Column:
        return let(strip(x), lambda s: (s != "") & (s.rlike(rules.CAPTION) | (numbers(s) & ~s.rlike(rules.MATHS))))

    def numbers(s: Column) -> Column:
        words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
        # the cheap tests first
        return word_count(s).between(2, 5) & s.rlike("[0-9]") & let(words, lambda w: F.size(F.filter(w, lambda x: x.rlike(rules.NUMERIC_WORD))) >= 0.6 * F.size(w))

    return F.array_join(F.filter(lines(c), lambda x: ~goes(x)), "\n")


def language_gate(df: DataFrame, score: str, threshold: float = rules.LANGUAGE_THRESHOLD) -> DataFrame:
    return df.where(F.coalesce(F.col(score), F.lit(1.0)) >= threshold)


def recovery_band(df: DataFrame, score: str, new: float = rules.RECOVERY[0], old: float = rules.RECOVERY[1]) -> DataFrame:
    return df.where((F.col(score) >= new) & (F.col(score) < old))


def with_recovery(df: DataFrame, score: str, new: float = rules.RECOVERY[0], old: float = rules.RECOVERY[1]) -> DataFrame:
    """recovery_band() with what a recovered document carries: its score and both thresholds."""
    return recovery_band(df, score, new, old).withColumns({"recovered_score": F.col(score), "old_threshold": F.lit(old), "new_threshold": F.lit(new)})


def recovery_report(df: DataFrame, score: str, new: float = rules.RECOVERY[0], old: float = rules.RECOVERY[1]) -> DataFrame:
    s = F.col(score)
    return df.agg(F.count("*").alias("n"), F.count_if((s >= new) & (s < old)).alias("recovered"), F.count_if(s >= old).alias("too_high"), F.count_if(s < new).alias("too_low"))


def clean_text(c: Column) -> Column:
    """Artefacts, accepted citations, lines, figures, symbols, white space: one expression, each step computed once."""
    return normalize_whitespace(normalize_symbols(figure_lines(clean_lines(without(c, rules.ARTEFACTS | rules.CITATIONS)))))


def clean_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """clean_text(); documents that end blank go. A generator drops them: a filter would be pushed below the
    projection and clean every text twice."""
    keep = F.explode(F.filter(F.array(clean_text(F.col(text))), lambda t: F.length(t) > 0))
    return df.select(*[c for c in df.columns if c != text], keep.alias(text)).select(df.columns)
