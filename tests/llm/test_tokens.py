"""Byte-level BPE against tiktoken, token files against their ids, codes against theory."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from farsight.llm import bpe, token_files
from farsight.llm.registry import QUERIES

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
PARTS = [" ", "  ", "\n", "\n\n", "\t", " ", "a", "The", "'s", "'", "ll", "é", "日本", "1", "23", "!", "#$", "\x00", "🙂", "\r\n", "\u0085", "﻿"]


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.read_ranks(RANKS), P.PATTERN)


def test_ids_are_those_of_tiktoken(codec):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 14)))
        ids = codec.encode(text)
        assert ids.tolist() == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_a_full_cache_gives_the_same_ids(codec):
    from farsight.llm.pretokens import CachedEncoder

    small = CachedEncoder(codec.encode_piece, "<u4", 16)
    rng = random.Random(5)
    for _ in range(300):
        text = " ".join("".join(rng.choices("abcdé", k=rng.randint(1, 4))) for _ in range(30))
        assert small.packed(text) == codec.encoder.packed(text)


def test_odd_rows_are_encoded_and_decoded(odd):
    out = bpe.decode_tokens(bpe.encode_documents(odd, RANKS), RANKS)
    assert out.columns[:4] == odd.columns and out.count() == odd.count()
    assert out.where(F.col("decoded") != F.coalesce("text", F.lit("")).cast("binary")).count() == 0
    assert out.where("text is null and n_tokens != 0").count() == 0


def test_empty_table(none):
    assert bpe.decode_tokens(bpe.encode_documents(none, RANKS), RANKS).count() == 0


def test_ranks_with_gaps_are_refused():
    with pytest.raises(ValueError):
        bpe.parse_ranks(b"YQ== 0\nYg== 2\n")


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(2, 300))
        counts = np.maximum(1, rng.pareto(0.4, n) * 5).clip(1, 1e12).astype(np.int64)
        limit = int(rng.integers(9, 21))
        lengths = token_files.code_lengths(counts, limit)
        assert lengths.max() <= limit and (0.5**lengths).sum() == pytest.approx(1)
        free = token_files.code_lengths(counts, 60 if n < 60 else 40)
        share = counts / counts.sum()
        entropy = -(share * np.log2(share)).sum()
        assert entropy <= (share * free).sum() < entropy + 1
        assert (share * lengths).sum() >= (share * free).sum() - 1e-9


def test_codes_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 700):
        ids = np.sort(rng.choice(5000, n, replace=False))
        book = token_files.Codebook(ids, token_files.code_lengths(rng.integers(1, 1000, n), 16))
        for size in (0, 1, 255, 256, 257, 5000):
            run = rng.choice(ids, size)
            payload, bits, marks = book.encode(run)
            assert len(payload) == (bits + 7) // 8
            assert (book.decode(payload, size, marks) == run).all()
            if len(marks) > 2:  # decoding can start at any checkpoint
                byte = int(marks[2]) // 8
                rest = book.decode(payload[byte:], size - 2 * token_files.CHECKPOINT, marks[2:] - byte * 8)
                assert (rest == run[2 * token_files.CHECKPOINT :]).all()


def test_files_hold_every_document_in_order(llm, odd, tmp_path):
    path = P.path("byte_bpe_50k.json")
    kind = token_files.id_type(path)
    token_files.write_token_files(token_files.tokenize(odd, path, 2), str(tmp_path / "files"), kind, parts=3)
    got = token_files.read_token_files(llm, str(tmp_path / "files")).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(path)
    want = {}
    for row in odd.collect():
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids + [2]
        want.setdefault(row.doc_id, []).append(np.array(ids, "<u4").tobytes())
    at, last = 0, -1
    for row in got:
        assert row.start == at and row.n_tokens * 4 == len(row.ids)
        at += row.n_tokens
        assert (-1 if row.doc_id is None else row.doc_id) >= last
        last = -1 if row.doc_id is None else row.doc_id
        want[row.doc_id].remove(bytes(row.ids))
    assert not any(want.values())


def test_files_of_an_empty_table(llm, none, tmp_path):
    path = P.path("byte_bpe_50k.json")
    token_files.write_token_files(token_files.tokenize(none, path, 2), str(tmp_path / "files"), "<u2")
    assert token_files.read_token_files(llm, str(tmp_path / "files")).count() == 0


def test_query_equals_the_library_on_whole_texts(llm):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op6_token_files"](llm, sf).collect()}
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    at = 0
    for row in llm.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids + [2]
        assert (got[row.doc_id].start, got[row.doc_id].n_tokens, got[row.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_special_strings_are_cut_as_the_library_cuts_them(llm):
    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(9)
    parts = ["<|endoftext|>", "a", " ", "  ", "\n", "word", "é", "日", "<|", "|>", ".", "endoftext", "\t"]
    texts = ["a <|endoftext|> b"] + ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(2000)]
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kind = token_files.id_type(path)
    got = {r.doc_id: list(np.frombuffer(r.ids, kind)) for r in token_files.tokenize(docs, path, 2).collect()}
    for k, text in enumerate(texts):
        assert got[k] == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], text
    assert got[0] == [64, 220, 50256, 275, 2]
