"""Planted passages, edits and alignment against brute force."""

from __future__ import annotations

import random

import pytest

from tessera.llm import decontamination as dc
from tests.llm.conftest import DOC, PROSE

ITEM = "item_id bigint, text string"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9))) for _ in range(words))


def free_distance(probe: str, region: str) -> int:
    row = [0] * (len(region) + 1)
    for i, sign in enumerate(probe, 1):
        last, row[0] = row[0], i
        for j in range(1, len(region) + 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (region[j - 1] != sign))
    return min(row)


@pytest.mark.parametrize("seed", range(40))
def test_alignment_is_exact_within_its_band(seed):
    rng = random.Random(seed)
    probe = prose(seed, 8)[:40]
    region = list("xy" * rng.randint(0, 2) + probe + "zz" * rng.randint(0, 2))
    for _ in range(rng.randint(0, 5)):
        at = rng.randrange(len(region))
        region[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "qq"])
    region = "".join(region)
    for edits in range(4):
        assert dc.within(probe, region, edits) == (free_distance(probe, region) <= edits), (probe, region, edits)


def test_alignment_side_by_side_is_that_of_one():
    rng = random.Random(1)
    texts = [prose(k, 30)[:60] for k in range(40)]
    cases = [(t[: rng.randint(8, 60)], prose(90, 2) + t[:30] + "".join(c if rng.random() > 0.15 else "z" for c in t[30:]), k % 8) for k, t in enumerate(texts)]
    assert dc.all_within(*zip(*cases, strict=True)).tolist() == [dc.within(*c) for c in cases]


def test_planted_passages_are_found_and_clean_documents_stay(llm):
    items = [(k, prose(k, 40)) for k in range(8)] + [(8, "short item text of it"), (9, None), (10, ""), (11, "tiny"), (0, prose(0, 40))]
    edited = list(items[1][1])
    for at in (20, 60, 110, 150, 190):
        edited[at] = "#"
    rows = [
        (0, f"{prose(100, 50)} {items[0][1]} {prose(101, 30)}"), (1, prose(102, 30) + " " + "".join(edited)),
        (2, prose(103, 400)), (3, items[2][1].upper().replace(" ", ",\n ")), (4, None), (5, ""), (6, "tiny"),
        (7, items[3][1][:130] + prose(104, 20)), (8, prose(105, 3000) + items[4][1] + prose(106, 3000)),
        (9, "Short item... TEXT of it!"), (10, items[0][1] + " " + items[5][1]), (10, items[0][1]), (None, items[6][1]),
    ]
    docs = llm.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)
    benchmark = llm.createDataFrame(items, ITEM)
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs, benchmark).collect()}
    assert got == {(0, 0), (1, 1), (3, 2), (7, 3), (8, 4), (9, 8), (10, 0), (10, 5), (None, 6), (6, 11)}
    kept = dc.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5]


def test_chunks_of_a_large_benchmark_give_the_same(llm, monkeypatch):
    items = [(k, prose(k, 40)) for k in range(9)]
    docs = llm.createDataFrame([(k, prose(50 + k, 20) + items[k][1], "en", "s", 0) for k in range(9)] + [(20, PROSE, "en", "s", 0)], DOC)
    benchmark = llm.createDataFrame(items, ITEM)
    monkeypatch.setattr(dc, "CHUNK_CHARS", 500)
    assert {(r.doc_id, r.item_id) for r in dc.leaks(docs, benchmark).collect()} == {(k, k) for k in range(9)}
    assert [r.doc_id for r in dc.keep_clean(docs, benchmark).collect()] == [20]


def test_bound_is_the_lemma():
    assert dc.bound(100) == 100 + 1 - dc.Q * (dc.budget(100) + 1)
    assert dc.bound(dc.Q) == 1


def leaked(text: str, items: list[str]) -> list[int]:
    return dc.leaked_items(text, dc.Probes.of(items))


def test_excerpts_are_found_at_every_offset():
    item = dc.normal(prose(1, 60))[:300]
    length = dc.PROBE + dc.STRIDE - 1
    around = prose(2, 30), prose(3, 30)
    assert all(leaked(f"{around[0]} {item[at : at + length]} {around[1]}", [item]) == [0] for at in range(len(item) - length + 1))


def test_replaced_words_do_not_hide_an_item():
    for seed in range(30):
        words = prose(seed, 40).split()
        spoiled, run = [], 0
        for word in words:
            run += len(word) + 1
            spoiled.append("x" * len(word) if run >= 50 and len(word) <= 6 else word)
            run = 0 if spoiled[-1] != word else run
        assert spoiled != words
        assert leaked(f"{prose(100 + seed, 30)} {' '.join(spoiled)} {prose(200 + seed, 30)}", [" ".join(words)]) == [0]


@pytest.mark.parametrize("length", [*range(8, 40), 60])
def test_edits_within_the_budget_are_found_in_short_items(length):
    rng = random.Random(length)
    item = "".join(rng.choice("abcdefghijklmnop") for _ in range(length))
    assert dc.bound(length) >= 1
    for _ in range(20):
        edited = list(item)
        for at in rng.sample(range(length), dc.budget(length)):
            edited[at] = "z"
        assert leaked(f"{prose(7, 20)} {''.join(edited)} {prose(8, 20)}", [item]) == [0]


def test_awkward_rows_and_empty_tables(llm, docs, no_docs):
    none, some = llm.createDataFrame([], ITEM), llm.createDataFrame([(1, PROSE)], ITEM)
    assert dc.leaks(docs, none).count() == 0 and dc.leaks(no_docs, some).count() == 0
    assert dc.keep_clean(docs, none).count() == docs.count() and dc.keep_clean(no_docs, some).count() == 0
    assert {r.doc_id for r in dc.leaks(docs, some).collect()} == {0, 1, 2, 90}


def searched_plainly(text: str, items: list[str]) -> list[int]:
    """Every probe of every item against the whole text."""
    text, out = dc.normal(text), []
    for number, item in enumerate(map(dc.normal, items)):
        if 0 < len(item) < dc.Q:
            hit = f" {item} " in f" {text} "
        else:
            last = max(0, len(item) - dc.PROBE)
            starts = {*range(0, last, dc.STRIDE), last} if item else ()
            hit = any(dc.within(p := item[s : s + dc.PROBE], text, dc.budget(len(p))) for s in starts)
        if hit:
            out.append(number)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_the_whole_search_against_every_probe(monkeypatch, seed):
    rng = random.Random(seed)
    if seed % 3 == 0:  # many pieces and halves
        monkeypatch.setattr(dc, "SLICE", 300)
        monkeypatch.setattr(dc, "ENTRIES", 500)
    items = [prose(1000 * seed + k, rng.choice([1, 2, 3, 8, 15, 40, 90])) for k in range(12)] + ["ha " * 40, "ab", "x y", "", "über naïve Größe " * 6]
    texts = [None, "", "ab", "x y z", "xab y", "ha " * 300, "HA! " * 20]
    for _ in range(20):
        parts = []
        for _ in range(rng.randint(1, 4)):
            item = list(rng.choice(items) or "none")
            for _ in range(rng.choice([0, 0, 2, 5, 9])):
                at = rng.randrange(len(item) + 1)
                item[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "w"])
            start = rng.choice([0, 0, rng.randrange(max(1, len(item)))])
            parts += [prose(rng.randrange(10**6), rng.randint(0, 40)), "".join(item[start:])]
        texts.append(" ".join(parts))
    assert dc.leaked_rows(texts, dc.Probes.of(items)) == [searched_plainly(t or "", items) for t in texts]


def test_memory_does_not_grow_with_repetition():
    import tracemalloc

    probes = dc.Probes.of(["ha " * 130])
    tracemalloc.start()
    assert dc.leaked_rows(["ha " * 40_000], probes) == [[0]]
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


@pytest.mark.parametrize("text", ["A_b  C", "it's\t1,2\x1c3", "Ünï_cödé!", "", "  x", "a\x00b"])
def test_plain_letters_take_the_same_way(text):
    assert dc.normal(text) == dc._OTHER.sub(" ", text.lower()).strip()
