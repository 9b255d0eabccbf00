"""Every stage on its own input, against plain Python."""

import public_tokenizers
import pytest

import corpus_pipeline
from farsight.llm import bpe, decontaminate, quality
from farsight.llm.common import stage
from test_duplicates import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from farsight.llm.common import prepare

    docs, out = prepare(spark).read.parquet(f"{SF}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        after = stage(function(spark, docs, SF), name)
        out.append((docs, after))
        docs = after
    return out


def rows(frame):
    return sorted(frame.collect(), key=lambda r: r.doc_id)


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality(stages):
    before, after = stages[0]
    good = []
    for r in rows(before):
        doc = quality.Doc((r.text or "").encode())
        if not quality.base_failed(doc.n_words, doc.repeat_words()) and not any(x.rejects(doc) for x in quality.RULES):
            good.append(r)
    assert rows(after) == good


def test_near_duplicates(stages):
    before, after = stages[1]
    all_rows = rows(before)
    _, roots = brute_components([(r.doc_id, r.text) for r in all_rows], 5, 80)
    assert rows(after) == [r for k, r in enumerate(all_rows) if roots[k] == k]


def test_decontamination(stages, spark):
    before, after = stages[2]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = decontaminate.words_of(r.text.encode())
        n = min(10, len(w))
        windows |= {tuple(w[a : a + n]) for a in range(len(w) - n + 1) if w}
    sizes = {len(w) for w in windows}

    def clean(text):
        w = decontaminate.words_of(text.encode())
        return not any(tuple(w[a : a + n]) in windows for n in sizes for a in range(len(w) - n + 1))

    assert rows(after) == [r for r in rows(before) if clean(r.text)]


def test_secrets(stages):
    before, after = stages[3]
    for a, b in zip(rows(before), rows(after)):
        assert a.doc_id == b.doc_id and b.n_chars == len(b.text)
        pieces = b.text.split("[SECRET]")
        at = 0
        for piece in pieces:  # what is left is the text, in order
            at = a.text.index(piece, at) + len(piece)
        assert len(pieces) > 1 or a.text == b.text
    assert len(rows(before)) == len(rows(after))


def test_tokens(stages):
    before, after = stages[4]
    codec = bpe.codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    for a, b in zip(rows(before), rows(after)):
        assert b.exact and bytes(b.token_ids) == codec.encode(a.text).astype("<u4").tobytes() and b.n_tokens * 4 == len(b.token_ids)


def test_stages_take_odd_rows_and_empty_tables(llm, odd, none):
    for frame in (odd, none):
        docs = frame
        for _, function in corpus_pipeline.STAGES[:-1]:
            # Each stage on the odd rows themselves, since the first one drops them.
            out = function(llm, frame, SF)
            assert out.columns == frame.columns and out.count() <= frame.count()
        assert corpus_pipeline.STAGES[-1][1](llm, docs, SF).count() == frame.count()
