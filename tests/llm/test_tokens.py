"""Token files and packing: round trips through the files and the pieces, against whole texts encoded at once."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillmill.llm import token_files
from quillmill.llm.common import scratch_path
from quillmill.llm.packing import op9_concat_cut, pack
from quillmill.llm.token_files import op3_arrow_sequences, read_token_files, write_token_files
from quillmill.llm.tokens import default_path, encoder

ODD = ["", None, "a b  c", "ΑΣ Σ İ I ﬁ é x́", "don't we'll\x0bx\x0cy\x1cz", "<|endoftext|> a<|startoftext|>b", "x" * 300 + " y", "日本語 テスト", "a\r\n\tc.,", "ÉTÉ, Straße. ñ", "...", ",", "º ª µ ſ ŉ", "q." * 40]


@pytest.fixture(scope="module")
def plain():
    tok = Tokenizer.from_file(default_path())
    return lambda text, end: [*tok.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_chunks_make_whole_texts(spark, sf, plain, monkeypatch):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(120).collect()]
    enc = encoder(None)
    assert enc.plain
    want = [plain(t, 0)[:-1] for t in texts]
    assert [np.frombuffer(x, dtype=enc.dtype).tolist() for x in enc.encode(texts)] == want
    monkeypatch.setattr("quillmill.llm.tokens.SLICE", 40)  # cut very long texts, and forget often
    monkeypatch.setattr("quillmill.llm.tokens.REMEMBERED", 50)
    assert [np.frombuffer(x, dtype=enc.dtype).tolist() for x in enc.encode(texts)] == want


def test_files_round_trip(spark, plain, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "no id"), (100, "w " * 5000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string").repartition(5)
    manifest = write_token_files(df, scratch_path(spark, "t"), length=16, per_batch=3, file_ids=200)
    files = sorted((r.part, r.file, r.path, r.n_docs, r.n_tokens) for r in manifest.collect())
    assert any(f[1] for f in files) and sum(f[3] for f in files) == len(rows)
    got = read_token_files(manifest).collect()
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in order] == np.cumsum([0, *(r.n_tokens for r in order)])[:-1].tolist()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((i or -1, len(x := plain(t, 1)), crc(x)) for i, t in rows)
    at = 0
    for _, _, path, _, n in files:  # each sequence by itself
        ids = []
        for i in range(-(-n // 16)):
            seq, mask = token_files.sequence(path, i)
            assert len(seq) == len(mask) == 16 and not seq.flags.owndata
            ids += seq[mask].tolist()
        assert len(ids) == n
        at += n
    assert at == sum(r.n_tokens for r in got)


def test_file_query(spark, sf, plain):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    at, want = 0, []
    for i, t in docs:
        ids = plain(t, 1)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, op3_arrow_sequences(spark, sf).collect())) == want


def check_pieces(rows, docs, plain, length):
    """docs: text by id, ids unique."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(docs)
    for i, t in docs.items():
        ids, at = plain(t, 2), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            at += r.length
            assert r.ids_crc32 == crc(ids[r.start : at])
        assert at == len(ids)
    sizes = {}
    for s, pieces in by_seq.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        sizes[s] = at
    last = max(sizes)
    assert sorted(sizes) == list(range(last + 1)) and all(n == length for s, n in sizes.items() if s != last) and sizes[last] <= length


def test_packing_query(spark, sf, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_pieces(op9_concat_cut(spark, sf).collect(), docs, plain, 4096)


def test_packing_odd_rows(spark, plain):
    docs = dict(enumerate([*ODD, "w " * 3000]))
    df = spark.createDataFrame([(i, t, 1) for i, t in docs.items()], "doc_id long, text string, part int").repartition(6)
    rows = pack(df, length=32, keep_ids=True).collect()
    check_pieces(rows, docs, plain, 32)
    assert all(crc(r.ids) == r.ids_crc32 for r in rows)
    twice = pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.length) for r in twice) == [(0, 1), (1, 3), (1, 3)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pack(none).count() == 0
    assert read_token_files(write_token_files(none, scratch_path(spark, "none"))).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer_gives_the_ids_of_the_library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillmill.llm.tokens import encoder

    path = public_tokenizers.path(name)
    own, lib = encoder(path), Tokenizer.from_file(path)
    texts = [None, "", " ", "Hello  world, it's me\n\nand  you", "  été à\u00a0la\tmode ", "a" * 300 + " b", "1 2  3\r\n", "don' t won't"]
    got = [np.frombuffer(x, dtype=own.dtype).tolist() for x in own.encode(texts)]
    assert got == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert own.split == (name == "word_bpe_49k.json")
