import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import token_files
from tessella.llm.bpe import BacktrackingEncoder, build_decoder, decode_ids, encode_texts
from tessella.llm.token_files import WordEncoder, in_use, open_part, read_documents, sequence, token_folder, write_token_files

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
pieces = st.sampled_from([*"aabcdeeest  \n\t'.,é日\x1c\x85\xa0!0123ThEßΣİÀ́", "<|endoftext|>", "<|startoftext|>", "'s", "'RE", "  ", " the", " \n", "İ.", "ς,"])
texts = st.one_of(st.lists(pieces, max_size=30).map("".join), st.text(max_size=40))


@pytest.fixture(scope="module")
def byte_pair():
    return BacktrackingEncoder(open(BYTE).read()), Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def decoder():
    return build_decoder(open(BYTE).read())


@pytest.fixture(scope="module")
def word_pair():
    return WordEncoder(open(WORD).read()), Tokenizer.from_file(WORD)


@settings(deadline=None, max_examples=500)
@given(text=texts)
def test_backtracking_encoder_equals_the_library(byte_pair, decoder, text):
    own, library = byte_pair
    ids = own.encode(text)
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert decoder.text(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


@settings(deadline=None, max_examples=200)
@given(ids=st.lists(st.integers(0, 50_256), max_size=20))
def test_any_ids_decode_as_in_the_library(byte_pair, decoder, ids):
    _, library = byte_pair
    assert decoder.text(np.array(ids, np.uint16)) == library.decode(ids, skip_special_tokens=False)


@settings(deadline=None, max_examples=500)
@given(text=texts)
def test_word_encoder_equals_the_library(word_pair, text):
    own, library = word_pair
    assert np.frombuffer(own.encode(text.encode()), own.kind).tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_pieces_take_linear_time(byte_pair):
    own, library = byte_pair
    for text in ("a" * 30_000, "abcdefghij" * 3_000, "!?" * 10_000):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_columns(hard, clashing, empty, byte_pair):
    for frame in (hard, clashing):
        for r in decode_ids(encode_texts(frame, BYTE), BYTE).select("text", "ids", "decoded").collect():
            assert r.ids == byte_pair[1].encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert decode_ids(encode_texts(empty, BYTE), BYTE).count() == 0


@pytest.mark.parametrize("length", [7, 2048])
def test_files_hold_every_id(spark, hard, sf_dir, word_pair, length, monkeypatch):
    frame = hard.union(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    folder = token_folder(spark)
    parts = write_token_files(frame, WORD, folder, length=length)
    got = read_documents(spark, folder, parts).collect()
    ids = lambda t: [*word_pair[1].encode(t or "", add_special_tokens=False).ids, 2]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    expected = sorted(((r.doc_id if r.doc_id is not None else -1), len(ids(r.text)), crc(ids(r.text))) for r in frame.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == expected
    rows = sorted(got, key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *accumulate(r.n_tokens for r in rows)][:-1]
    order = [r.doc_id if r.doc_id is not None else -(1 << 60) for r in rows]
    assert order == sorted(order)
    part = parts.orderBy("part").first()
    flat, reader = [], open_part(folder, part.part, "sequences")
    for i in range(-(-part.n_tokens // length)):
        some, mask = sequence(reader, i)
        assert len(some) == length and len(mask) == -(-length // 8) and not some.flags.owndata and not mask.flags.owndata
        flat += some[in_use(mask, length)].tolist()
    assert len(flat) == part.n_tokens
    first = rows[0]
    assert crc(flat[: first.n_tokens]) == first.ids_crc32


def test_ids_and_masks_lie_in_the_mapped_file(spark, hard):
    folder = token_folder(spark)
    part = write_token_files(hard, WORD, folder, length=16).orderBy("part").first()
    mapped = pa.memory_map(f"{folder.removeprefix('file:').replace('//', '/', 1)}/part-{part.part:05d}.sequences.arrow")
    whole, reader = mapped.read_buffer(), pa.ipc.open_file(mapped)
    last = -(-part.n_tokens // 16) - 1
    for number in {0, last // 2, last}:
        for view in sequence(reader, number):
            address = view.__array_interface__["data"][0]
            assert whole.address <= address and address + view.nbytes <= whole.address + whole.size
    assert in_use(sequence(reader, last)[1], 16).sum() == part.n_tokens - 16 * last


def test_no_documents(spark, empty):
    folder = token_folder(spark)
    assert read_documents(spark, folder, write_token_files(empty, WORD, folder)).count() == 0
    assert token_files.SEQUENCE == 2048


def test_round_trip_equals_both_operators_in_one_worker(spark):
    import public_tokenizers

    from tessella.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [None, "", "Plain words, twice twice.", "日本語 İ  \n\t x", "<|endoftext|> and 12345"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "both int, text string")
    found = bpe.round_trip(docs, path)
    want = bpe.decode_ids(bpe.encode_texts(docs, path), path)
    assert found.columns == want.columns and sorted(found.collect(), key=str) == sorted(want.collect(), key=str)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
