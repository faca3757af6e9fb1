"""Secret scans with DataFrame functions alone.

Fixed patterns find assignments, access keys and long runs of hex digits. Beside them, candidate strings are scanned by
a sliding window whose Shannon entropy is kept by incremental counts: a step takes one character out of the counts and
one in, and changes the sum of c * log2(c) by two table look-ups. Each character class has a window and a threshold.
Allow-listed candidates are suppressed, and so are those inside a span that a pattern has found. With `parts`, as in the
query and the pipeline, what is harmless clears only itself: the rest of a candidate is scanned, and so is each run of
hex digits in it by the window of its own class.

Places of matches follow from regexp_extract_all() and split() on the same pattern: the lengths of what lies between the
matches and of the matches themselves, summed from left to right, in code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let
from .common import table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of 16 characters or more, and of 32: shorter matches of the open patterns hold no longer one inside.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: What is no secret: words, examples, names with separators, paths, UUIDs and rows of one sign. Repeated groups are
#: possessive: they take time in proportion to the candidate, and Java runs them as a loop, not on its stack.
ALLOW = (r"^[A-Za-z]+$", r"^[0-9]+$", r"(?i)example|sample|placeholder|x{6,}|0{8,}|1234567|abcdef(?:gh|01)", r"^[a-z0-9]++(?:[-_/][a-z0-9]++)++$", r"^/?[A-Za-z]++(?:/[A-Za-z]++)++$", r"^[=_+/-]+$", r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
#: Class, its characters, window and the bits a character that a window needs.
CLASSES = (("hex", "0123456789abcdef", 20, 3.0), ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.8))
#: Parts of a candidate that are no secret, between signs: words with a number behind them, numbers, short names, UUIDs;
#: and anywhere: marks of examples, rows of one sign. Repetitions are possessive, so none is tried twice.
_EDGE, _END = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
HARMLESS = rf"{_EDGE}(?i:[0-9a-f]{{8}}(?:-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}){_END}|{_EDGE}(?:(?:[A-Z]{{0,5}}+[a-z]{{2,}}+)++[A-Z]{{0,5}}+|[A-Z]++)[0-9]{{0,8}}+{_END}|{_EDGE}[0-9]++{_END}|{_EDGE}[a-z0-9]{{1,8}}+{_END}|(?i:example|sample|placeholder|x{{6,}}+|0{{8,}}+|abcdef(?:ghijklmnopqrstuvwxyz|gh|01)|1234567(?:89)?)"
#: A run of one class inside what is left.
HEX_RUN = r"[0-9a-f]{20,}|[0-9A-F]{20,}"

SPAN = "array<struct<start:int,rank:int,end:int>>"
#: Matches of a block.
FOLD = 256


def _spans(text: Column, pattern: str, rank: int, keep, groups: int | None = None) -> Column:
    """Spans of the matches that `keep` accepts (of the match, or of the group asked for)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    shown = found if groups is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(groups))
    between = F.split(text, pattern, -1)
    rows = F.zip_with(F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("b"), m.alias("m"))), shown, lambda r, g: F.struct(r["b"].alias("b"), r["m"].alias("m"), g.alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(s: Column, r: Column) -> Column:
        at = s["at"] + r["b"]
        end = at + F.length(r["m"])
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        # the last piece has no match behind it
        spans = F.when(r["m"].isNotNull() & keep(r["g"]), F.concat(s["spans"], F.array(span))).otherwise(s["spans"])
        return F.struct(F.coalesce(end, at).alias("at"), spans.alias("spans"))

    def moved(s: Column, block: Column) -> Column:
        own = F.transform(block["spans"], lambda x: F.struct((x["start"] + s["at"]).alias("start"), x["rank"].alias("rank"), (x["end"] + s["at"]).alias("end")))
        return F.struct((s["at"] + block["at"]).alias("at"), F.concat(s["spans"], F.array(own)).alias("spans"))

    # an array that grows by one is copied: matches are folded block by block, then the blocks, so a text with very many
    # matches doesn't copy them all for each
    blocks = let(rows, lambda rs: F.transform(F.sequence(F.lit(0), F.floor((F.size(rs) - 1) / FOLD).cast("int")), lambda k: F.aggregate(F.slice(rs, k * FOLD + 1, FOLD), start, step)))
    joined = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))
    return F.aggregate(blocks, joined, moved, lambda s: F.flatten(s["spans"]))


def _windows(text: Column, alphabet: str, width: int, bits: float) -> Column:
    """(lo, hi) of the first place and the end of the last place of the windows of `text` with `bits` or more; lo < 0: none."""
    table_ = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)])
    weight = lambda c: F.element_at(table_, c + 1)
    least = (math.log2(width) - bits) * width + 1e-9  # entropy >= bits where the sum of c * log2(c) is at most this
    n = F.length(text)
    codes = F.transform(F.split(text, ""), lambda ch: F.instr(F.lit(alphabet), ch))
    zero = F.array_repeat(F.lit(0), len(alphabet) + 1)
    start = F.struct(zero.alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))

    def step(codes: Column, s: Column, i: Column) -> Column:
        inn = F.element_at(codes, i) + 1
        out = F.when(i > width, F.element_at(codes, i - width) + 1).otherwise(F.lit(0))
        ci = F.element_at(s["counts"], inn)
        co = F.when(out > 0, F.element_at(s["counts"], F.greatest(out, F.lit(1)))).otherwise(F.lit(0))
        moved = out != inn
        total = s["sum"] + F.when(moved, weight(ci + 1) - weight(ci) + F.when(out > 0, weight(co - 1) - weight(co)).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))
        counts = F.when(moved, F.transform(s["counts"], lambda c, k: c + (k + 1 == inn).cast("int") - (k + 1 == out).cast("int"))).otherwise(s["counts"])
        hit = (i >= width) & (total <= least)
        lo = F.when(hit & (s["lo"] < 0), (i - width).cast("int")).otherwise(s["lo"])
        hi = F.when(hit, i.cast("int")).otherwise(s["hi"])
        return F.struct(counts.alias("counts"), total.alias("sum"), lo.alias("lo"), hi.alias("hi"))

    ends = lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))
    return let(codes, lambda c: F.aggregate(F.sequence(F.lit(1), n), start, lambda s, i: step(c, s, i), ends))


def scan_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets", parts: bool = False) -> DataFrame:
    """docs with `out`: array of (start, rank, end) of all spans, by start and then kind (rank in KINDS).

    `parts`: a harmless part of a candidate clears itself alone; otherwise it clears the whole candidate.

    Places are code points, ends exclusive. A null or empty text has an empty array; a very long text is scanned whole;
    repeated rows are scanned each; a column named like `out` is replaced. No shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(SPAN)
    docs = docs.drop(out)
    # cheap tests first: few texts reach the patterns
    assign = F.when(text.rlike(ASSIGN), _spans(text, ASSIGN, 0, lambda g: F.length(g) >= 8, 2)).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 1, lambda g: F.lit(True))).otherwise(none)
    hexes = F.when(text.rlike(HEX), _spans(text, HEX, 2, lambda g: F.lit(True))).otherwise(none)
    based = docs.withColumn("__base", F.concat(assign, access, hexes))
    candidates = F.when(text.rlike(CANDIDATE), _spans(text, CANDIDATE, 3, lambda g: F.lit(True))).otherwise(none)
    outside = lambda base: F.filter(candidates, lambda c: ~F.exists(base, lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"])))
    listed = based.withColumn("__cand", let(F.col("__base"), outside))

    def scanned(c: Column) -> Column:
        return let(F.substring(text, c["start"] + 1, c["end"] - c["start"]), lambda s: judged(c, s))

    def judged(c: Column, s: Column) -> Column:
        allowed = F.lit(False)
        for p in ALLOW:
            allowed = allowed | s.rlike(p)
        is_hex = s.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")
        none_ = F.struct(F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
        found = F.when(allowed, none_).when(is_hex, _windows(F.lower(s), *CLASSES[0][1:])).otherwise(_windows(s, *CLASSES[1][1:]))
        return let(found, lambda f: F.struct((c["start"] + f["lo"]).alias("start"), F.lit(3).alias("rank"), (c["start"] + f["hi"]).alias("end"), (f["lo"] >= 0).alias("hit")))

    def dissected(c: Column) -> Column:
        return let(F.substring(text, c["start"] + 1, c["end"] - c["start"]), lambda s: F.flatten(F.transform(left(s), lambda r: piece(c["start"] + r["start"], F.substring(s, r["start"] + 1, r["end"] - r["start"])))))

    def left(s: Column) -> Column:
        """What lies between the harmless parts and is long enough for a window."""
        rank, last = F.lit(3).alias("rank"), F.struct(F.length(s).alias("start"), F.lit(3).alias("rank"), F.length(s).alias("end"))
        cleared = lambda h: F.transform(F.concat(h, F.array(last)), lambda x, i: F.struct(F.when(i > 0, F.element_at(h, F.greatest(i, F.lit(1)))["end"]).otherwise(F.lit(0)).alias("start"), rank, x["start"].alias("end")))
        return F.filter(let(_spans(s, HARMLESS, 3, lambda g: F.lit(True)), cleared), lambda r: r["end"] - r["start"] >= 20)

    def piece(at: Column, s: Column) -> Column:
        """Spans of a piece: of the windows of all signs, and of those of each run of hex digits outside them."""
        run = lambda r: found(at + r["start"], _windows(F.lower(F.substring(s, r["start"] + 1, r["end"] - r["start"])), *CLASSES[0][1:]))
        hexes = F.when(s.rlike(HEX_RUN), F.flatten(F.transform(_spans(s, HEX_RUN, 3, lambda g: F.lit(True)), run))).otherwise(none)
        whole = found(at, _windows(s, *CLASSES[1][1:]))
        return let(whole, lambda w: F.concat(w, F.filter(hexes, lambda h: ~F.exists(w, lambda x: (x["start"] <= h["start"]) & (h["end"] <= x["end"])))))

    def found(at: Column, window: Column) -> Column:
        return let(window, lambda f: F.when(f["lo"] >= 0, F.array(F.struct((at + f["lo"]).alias("start"), F.lit(3).alias("rank"), (at + f["hi"]).alias("end")))).otherwise(none))

    if parts:
        added = F.filter(F.flatten(F.transform("__cand", dissected)), lambda c: ~F.exists("__base", lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"])))
    else:
        added = F.transform(F.filter(F.transform("__cand", scanned), lambda a: a["hit"]), lambda a: F.struct(a["start"], a["rank"], a["end"]))
    ready = listed.withColumn("__added", F.when(F.size("__cand") > 0, added).otherwise(none))
    return ready.withColumn(out, F.array_sort(F.concat("__base", "__added"))).drop("__base", "__cand", "__added")


def _written(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span replaced; overlapping spans leave one mark where they begin."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        inside = x["start"] < s["at"]
        kept = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))
        return F.struct(F.when(inside, s["out"]).otherwise(kept).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    whole = F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def op4_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans; see scan_secrets() for odd rows."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), parts=True).drop("text")
    base = F.filter("secrets", lambda s: s["rank"] < 3)

    def count(k: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["rank"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("secrets")).alias("spans"))


QUERIES = {"op4_entropy_secrets": op4_entropy_secrets}
