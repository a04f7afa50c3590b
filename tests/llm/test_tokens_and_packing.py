import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from tokenizers import Tokenizer

from attestor.llm import packing, token_files, tokens

WEIRD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "\tx\t y", "don't, it's. we'll!", "x<|endoftext|>y z", "<|startoftext|> hi", "é é ́a b", "trail  ", "1,2. 3.5, ab1. x_y.", "\x01 a b", "ΑΣ ΟΔΟΣ. ΣΑΣ", "İstanbul DŽ", "a\n\nb c.\n\nd", "日本語 テスト。 ok", ". a", "-- x--, y", "naïve. café, été;", "x\r\n y", " \n ", "😀 a😀. b", "erth*** THE!! a"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_gives_the_ids_of_whole_texts(name, documents):
    path = tokens.vocabulary_path(name)
    plain, own = Tokenizer.from_file(path), tokens.Encoder(path)
    texts = WEIRD + [r.text for r in documents.collect()]
    for _ in range(2):  # with the memo empty, then filled
        assert [x.tolist() for x in own.encode(pa.array(texts))] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \n\taB.,'é1<|>", max_size=30), min_size=1, max_size=5))
def test_memo_on_any_text(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = tokens.encoder(tokens.vocabulary_path(name))
        assert [x.tolist() for x in own.encode(pa.array(texts))] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=700))
def test_elias_fano(values):
    values.sort()
    coded = token_files.EliasFano(memoryview(token_files.EliasFano.encode(np.array(values, np.uint64))))
    assert [coded.select(i) for i in range(len(values))] == values == coded.select_range(0, len(values)).tolist()
    for first, last in ((1, len(values)), (len(values) // 2, len(values) // 2 + 1), (min(255, len(values)), min(258, len(values)))):
        assert coded.select_range(first, last).tolist() == values[first:last]
    with pytest.raises(IndexError):
        coded.select(len(values))


def expected_documents(docs, name):
    plain = Tokenizer.from_file(tokens.vocabulary_path(name))
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return [(d, np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4")) for d, t in rows]


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_token_files_round_trip(request, name, tmp_path):
    docs, start, expected = request.getfixturevalue(name), 0, []
    documents = expected_documents(docs, "byte_bpe_50k.json")
    for doc_id, ids in documents:
        expected.append((str(doc_id), start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    blocks = token_files.write_blocks(docs, block_ids=5000, folder=f"file://{tmp_path}")
    found = [(str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_documents(blocks).collect()]
    assert sorted(found) == sorted(expected)
    files = sorted(tmp_path.glob("*.aef"))
    assert len(files) == blocks.count() > 1
    read = [token_files.Block(f.open("rb")) for f in files]
    again = [b.document(i) for b in read for i in range(b.n_docs)]
    by_ids = lambda rows: sorted(((str(d), x.tolist()) for d, x in rows))
    assert by_ids(again) == by_ids(documents) and [d for d, _ in again] == [d for d, _ in documents]
    # Near-minimal: under 2 + log2(u / n) bits a boundary, with the samples and rounding.
    block = max(read, key=lambda b: b.n_docs)
    size = len(token_files.EliasFano.encode(block.starts.select_range(0, block.n_docs + 1).astype(np.uint64)))
    assert size * 8 <= block.n_docs * (3 + np.log2(max(2, block.n_ids / block.n_docs))) + 400


def test_files_are_read_through_select(spark, documents, tmp_path):
    manifest = token_files.write_blocks(documents, folder=f"file://{tmp_path}")
    (tmp_path / "000000-000000-left.aef").write_bytes(b"of an attempt that failed")
    good = sorted(map(tuple, token_files.read_documents(manifest).collect()))
    assert len(good) == documents.count()
    (path,) = (p for p in tmp_path.glob("*.aef") if p.name.startswith("000001-000000-"))
    raw = bytearray(path.read_bytes())
    starts = token_files.EliasFano(memoryview(raw), 44)
    at = starts.end - 4 * len(starts.samples) - len(starts.upper)
    assert raw[at] & 1  # the first document starts at 0; select finds it in the first bit
    raw[at] ^= 0b11 if not raw[at] & 2 else 0b101
    path.write_bytes(raw)
    try:
        found = sorted(map(tuple, token_files.read_documents(manifest).collect()))
    except PySparkException:
        return
    assert found != good


def test_rows_without_doc_id_are_dealt_over_files(spark):
    docs = spark.createDataFrame([(None, f"text number {i}") for i in range(300)], "doc_id long, text string")
    assert token_files.write_blocks(docs).select("part").distinct().count() > 1


def test_token_files_of_nothing(nothing):
    assert token_files.token_documents(nothing).count() == 0


def check_packing(docs, rows):
    documents = sorted(expected_documents(docs, "word_bpe_49k.json"), key=lambda x: (str(x[0]), x[1].tolist()))
    assert sum(r.length for r in rows) == sum(len(x) for _, x in documents)
    by_id = {}
    for d, ids in documents:
        by_id.setdefault(d, []).append(ids)
    for d, options in by_id.items():
        pieces = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start)
        if len(options) == 1:
            at = 0
            for r in pieces:
                assert r.start == at and r.doc_tokens == len(options[0]) and r.ids_crc32 == zlib.crc32(options[0][at : at + r.length].tobytes())
                at += r.length
            assert at == len(options[0])
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in sequences.values()) and max(sequences.values()) <= 4096


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_packing(request, name):
    docs = request.getfixturevalue(name)
    check_packing(docs, packing.pack_documents(docs).collect())


def test_packing_of_nothing(nothing):
    assert packing.pack_documents(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=60))
def test_pack_fills_every_sequence(lengths):
    rows = packing.pack(lengths, 64)
    filled, taken = {}, [0] * len(lengths)
    for d, _, length, s, offset, size, _ in rows:
        assert offset == filled.get(s, (0, 0))[0]
        filled[s] = (offset + length, size)
        taken[d] += length
    assert taken == lengths and all(n == size <= 64 for n, size in filled.values())


def test_costs_are_balanced():
    rows = packing.pack(np.random.default_rng(1).integers(1, 2000, 800).tolist())
    costs = {}
    for *_, s, _, size, cost in rows:
        if size == 4096:
            costs[s] = costs.get(s, 0) + cost
    values = np.array(list(costs.values()))
    assert values.std() / values.mean() < 0.12
