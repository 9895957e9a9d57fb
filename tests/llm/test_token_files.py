"""Codes against their definition, files against the library."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import token_files as tf
from tessera.llm import tokenizer_files
from tests.llm.conftest import doc_rows


def huffman_cost(counts: list[int]) -> int:
    import heapq

    heap, cost = sorted(counts), 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=2, max_size=60))
def test_lengths(counts):
    free = tf.code_lengths(counts, 64)
    assert sum(2.0**-k for k in free) == 1.0
    assert sum(a * b for a, b in zip(counts, free, strict=True)) == huffman_cost(counts)
    tight = tf.code_lengths(counts, 7)
    assert max(tight) <= 7 and sum(2.0**-k for k in tight) <= 1.0


def test_few_symbols():
    assert tf.code_lengths([]) == [] and tf.code_lengths([5]) == [1] and tf.code_lengths([1, 9]) == [1, 1]
    assert max(tf.code_lengths([1] * 300, 3)) == 9


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 70_000])
def test_blocks_decode(n):
    rng = random.Random(n)
    ids = np.array([min(int(rng.expovariate(0.002)), 9000) for _ in range(n)], np.uint32)
    counts = np.bincount(ids, minlength=1)
    used = np.flatnonzero(counts)
    book = tf.Codebook(dict(zip(used.tolist(), tf.code_lengths(counts[used].tolist()), strict=True)))
    payload, offsets = book.encode(ids)
    assert (book.decode(payload, offsets, n) == ids).all()


@pytest.mark.skipif(not os.path.exists(tokenizer_files.WORDS), reason="no vocabulary files here")
@pytest.mark.parametrize("block", [1, 50, tf.BLOCK_IDS])
def test_files_against_the_library(llm, docs, block, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tf, "BLOCK_IDS", block)
    path = tf.new_folder(llm, "test-tokens")
    kind = tf.id_kind(tokenizer_files.WORDS)
    tf.write_tokens(tf.token_ids(docs, tokenizer_files.WORDS, id_type=kind), path, kind)
    got = [tuple(r) for r in tf.digest(tf.read_tokens(llm, path)).collect()]
    library = Tokenizer.from_file(tokenizer_files.WORDS)
    want, at = [], 0
    coded = [(row[0], library.encode(row[1] or "", add_special_tokens=False).ids + [1]) for row in doc_rows()]
    assert sorted((repr(a), c, d) for a, _, c, d in got) == sorted(
        (repr(i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in coded
    )
    for row in sorted(got, key=lambda r: r[1]):  # starts follow each other in order of the ids
        assert row[1] == at
        at += row[2]
        want.append(row[0])
    assert want == sorted(want, key=lambda i: (i is not None, i or 0))


def test_words_with_the_separator_in_them():
    encoder = tf.WordEncoder(tokenizer_files.WORDS)
    texts = ["a <|endoftext|> b", "x<|startoftext|>y Don't  STOP\tnow\n\nok", "", "Ⅷ½ İstanbul \x1c\x85 z"]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def test_random_words_with_final_stops():
    """Letters that the normaliser turns into more than letters may not be parted from the stop."""
    rng = random.Random(5)
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x250), *range(0x370, 0x530), *range(0x5D0, 0x5EB), *range(0x900, 0x940), *range(0x1E00, 0x1F00))]
    letters += list("İŉǰΐᾲﬁﬀßſK①²ªʼ\u0307\u0345日本の가")
    words = ["İ.", "İ,", "aİ.", "ŉ."] + ["".join(rng.choices(letters, k=rng.randint(1, 5))) + rng.choice(".,.,;") for _ in range(6000)]
    texts = [" ".join(words[k : k + 3]) for k in range(0, len(words), 3)]
    encoder = tf.WordEncoder(tokenizer_files.WORDS)
    want = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def test_empty_table(llm, no_docs):
    path = tf.new_folder(llm, "test-none")
    tf.write_tokens(tf.token_ids(no_docs, tokenizer_files.WORDS), path)
    assert tf.read_tokens(llm, path).count() == 0


def test_signs_and_latin_letters_are_learnt_without_the_slow_steps():
    """Ids as the library's; letters with signs behind them reach neither the normaliser nor the splitter."""
    encoder = tf.WordEncoder(tokenizer_files.WORDS)
    words = "Straße$$$ éÉa!!! İx. ΣΑΣ, ª º. ŉ ſ. don't. a$'s ab.'s '$ a1. <|endoftext|>. ab<|endoftext|> Å Å. 日本。 日本. __ Ÿ,&&& é. ĳ".split(" ")
    for word in words:
        assert encoder.encode([word])[0] == np.array(encoder.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes(), word
    signs = encoder.encode(["$$$ !!! ,&&&"])
    encoder.normalizer = encoder.splitter = encoder.tokenizer = None  # from here on a slow step fails
    assert signs and all(encoder.encode(["Wörter$$$ niño!!! Éclair,&&& Plain$$$"]))
