"""Ids against the library, for a BPE and a unigram reading of the model; round trips."""

from __future__ import annotations

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import sentencepiece_codec as codec
from tessera.llm import tokenizer_files
from tests.llm.conftest import doc_rows

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer_files.PIECES), reason="no vocabulary files here")
PARTS = ["a", "b", " ", "the", "ing", "  ", "é", "\n", "日本", "0", "=", "{", "\r", "aaaa", "😀", "#", "--", "▁", "\t", "\0"]


@pytest.fixture(scope="module")
def bpe():
    return codec.Model(tokenizer_files.PIECES)


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The same pieces and scores read as a unigram model: a later field overrides an earlier one."""
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    with open(tokenizer_files.PIECES, "rb") as file:
        path.write_bytes(file.read() + b"\x12\x02\x18\x01")
    return codec.Model(str(path))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join))
def test_bpe_ids_are_the_librarys(bpe, text):
    assert bpe.encode(text) == bpe.library.encode(text)
    assert list(codec.stream(bpe, bpe.library.normalize(text))) == bpe.library.encode(text)
    assert bpe.decode(bpe.encode(text)) == text.replace("▁", " ")


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_bpe_of_any_text(bpe, text):
    assert bpe.encode(text) == bpe.library.encode(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdefgi nhto\n", max_size=30))
def test_unigram_segmentation_has_the_best_score(unigram, text):
    normal = unigram.library.normalize(text)
    score = lambda ids: sum(unigram.library.get_score(i) for i in ids if not unigram.library.is_byte(i))
    own = unigram.encode(text)
    assert unigram.decode(own) == text
    if all(c in unigram.ids for c in normal):
        assert score(own) == pytest.approx(score(unigram.library.encode(text)))


def test_window_stays_bounded(bpe):
    """Ids come out while characters still go in, far behind by a few pieces at most."""
    rng, fed = random.Random(1), 0

    def characters():
        nonlocal fed
        for _ in range(20_000):
            fed += 1
            yield rng.choice("abcdefghij0=({日")

    lag, out = 0, 0
    for id in codec.stream(bpe, characters()):
        out += len(bpe.library.id_to_piece(id)) if not bpe.library.is_byte(id) else 0
        lag = max(lag, fed - out)
    assert lag < 20 * bpe.longest


def test_tables(llm, docs, no_docs):
    got = codec.round_trips(docs, tokenizer_files.PIECES).collect()
    assert all(r.round_trip for r in got) and len(got) == len(doc_rows())
    library = codec.model_at(tokenizer_files.PIECES).library
    want = sorted((repr(row[0]), library.encode(row[1] or "")) for row in doc_rows())
    assert sorted((repr(r.doc_id), r.ids) for r in got) == want
    assert codec.encoded(no_docs, tokenizer_files.PIECES).count() == 0
    nulls = llm.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r[0] for r in nulls.select(codec.decode(nulls["ids"], tokenizer_files.PIECES)).collect()] == [None, ""]
