"""Secret scans against a plain scan in Python."""

import hashlib
import math
import random
import re
from collections import Counter

from quillmill.llm.secrets import ALLOW, CLASSES, KINDS, op4_entropy_secrets, redact, scan_secrets

BASE = (
    (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 8),
    (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def plain(text):
    text = text or ""
    spans = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m)]
    base = list(spans)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        if any(a <= m.start() and m.end() <= b for a, _, b in base) or any(re.search(p, m[0]) for p in ALLOW):
            continue
        _, _, width, bits = CLASSES[0] if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", m[0]) else CLASSES[1]
        hits = [i for i in range(len(m[0]) - width + 1) if entropy(m[0][i : i + width]) >= bits - 1e-9]
        if hits:
            spans.append((m.start() + hits[0], 3, m.start() + hits[-1] + width))
    return sorted(spans)


def written(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def made(n):
    rng = random.Random(5)
    some = lambda abc, k: "".join(rng.choice(abc) for _ in range(k))
    b64, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef"
    parts = [
        lambda: some("abc de,.\n", rng.randint(0, 40)),
        lambda: rng.choice(["password", "PassWd", "SECRET", "token", "api_key", "apikey", "key"]) + rng.choice(["=", ": ", '" : "', "  =  '"]) + some(b64 + ".=-", rng.randint(0, 14)),
        lambda: "AKIA" + some("ABC019", rng.randint(0, 20)) + rng.choice(["", "x"]),
        lambda: some(low, rng.randint(20, 45)),
        lambda: some(low.upper(), rng.randint(15, 45)),
        lambda: some(b64, rng.randint(10, 60)),
        lambda: rng.choice(["😀", "é", "ſecret=abcdefghij", "token: token: abcdefgh", "x" * 30, "abcdefghijklmnopqrstuvwxyz", "aaaa0000" * 5]),
        lambda: "deadbeef-dead-beef-dead-beefdeadbeef",
    ]
    return ["".join(rng.choice(parts)() + rng.choice([" ", "", "\n", "é"]) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_spans_against_a_plain_scan(spark):
    texts = [None, "", " ", *made(400)]
    rows = list(enumerate(texts))
    got = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    found = {r.doc_id: [(s.start, s.rank, s.end) for s in r.secrets] for r in got}
    assert found == {i: plain(t) for i, t in rows}
    kinds = Counter(k for s in found.values() for _, k, _ in s)
    assert all(kinds[k] > 10 for k in range(4))


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op4_entropy_secrets(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        spans = plain(docs[r.doc_id])
        base = [s for s in spans if s[1] < 3]
        n = Counter(k for _, k, _ in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (n[0], n[1], n[2])
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest() and r.spans == written(spans)


def test_redaction_clashing_columns_and_long_text(spark):
    long = "word " * 200_000 + "password=abcdefgh1 end"
    df = spark.createDataFrame([("a token=12345678 b token=87654321", 1), ("plain", 2), (None, 3), (long, 4), ("é secret: " + "0123456789abcdef" * 3, 5)], "text string, secrets int")
    out = {r.text: r.clean for r in scan_secrets(df).withColumn("clean", redact_column()).collect()}
    assert out["a token=12345678 b token=87654321"] == "a [SECRET] b [SECRET]"
    assert out["plain"] == "plain" and out[None] is None
    assert out[long].endswith("word [SECRET] end") and out["é secret: " + "0123456789abcdef" * 3] == "é [SECRET]"


def redact_column():
    from pyspark.sql import functions as F

    return redact(F.col("text"), F.col("secrets"))


def test_no_python_in_the_plan(spark, sf):
    plan = op4_entropy_secrets(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_empty_table(spark):
    assert scan_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_harmless_part_clears_only_itself(spark):
    rng = random.Random(11)
    some = lambda abc, k: "".join(rng.choice(abc) for _ in range(k))
    low, b64 = "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    kinds = {"key": lambda: "key-" + some(low, 32), "live": lambda: "sk_live_" + some(low, 24), "path": lambda: "/samples/" + some(b64, 40), "id": lambda: "ID=" + some("0123456789ABCDEF", 32)}
    rows = [(k, f"see {make()} there") for k, make in kinds.items() for _ in range(100)]
    fine = ["/usr/local/lib/python3/site-packages/some_module", "a-long-name_with/many-parts/2024/01", "deadbeef-dead-beef-dead-beefdeadbeef", "id=deadbeef-dead-beef-dead-beefdeadbeef", "HTTPServer/MyProject/readMe_example_12345678901234567890", "abcdefghijklmnopqrstuvwxyz", "=" * 30, "x" * 40]
    rows += [("fine", f"see {x} there") for x in fine]
    got = scan_secrets(spark.createDataFrame(rows, "kind string, text string"), parts=True).collect()
    hit = Counter(r.kind for r in got if any(s.rank == 3 and s.end > 30 for s in r.secrets))
    assert hit["key"] >= 80 and hit["live"] >= 50 and hit["path"] >= 98 and hit["id"] >= 95
    assert not any(r.secrets for r in got if r.kind == "fine"), [r for r in got if r.kind == "fine" and r.secrets]


LONG = {
    "path": "a1/" * 350_000 + "zz",
    "words": "/ab" * 350_000,
    "hyphens": "ab-" * 350_000 + "b",
    "camel": "Ab" * 500_000,
    "rows": "x" * 1_000_000,
    "hex": "0123456789abcdef" * 60_000,
    "access": "AKIA" * 250_000,
    "assign": "token=" * 170_000,
    "gaps": "token" + " " * 1_000_000 + "= abcdefgh1",
    "uuid": "deadbeef-dead-beef-dead-beefdeadbeef" * 25_000,
    "signs": "=_+/-" * 200_000,
    "many": "token=abcdefgh1 " * 20_000,
}


def test_a_megabyte_of_each_pattern(spark):
    """No text ends the JVM by its stack, and each is scanned whole."""
    small = {k: t[: len(t) // 50] if k not in ("path", "words", "hyphens", "camel", "gaps", "many") else t for k, t in LONG.items()}
    df = spark.createDataFrame([(k, t + " password=hunter2hunter2") for k, t in small.items()], "kind string, text string").repartition(12)
    for parts in (False, True):
        got = {r.kind: r.secrets for r in scan_secrets(df, parts=parts).select("kind", "secrets").collect()}
        assert set(got) == set(small)
        assert all(any(s.rank == 0 and s.end == len(small[k]) + 24 for s in spans) for k, spans in got.items())
    assert len(got["many"]) == 20_001
