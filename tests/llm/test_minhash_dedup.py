"""Links of shingle sets against brute force over all pairs."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, queries
from tessera.llm import minhash_dedup as dedup
from tests.llm.conftest import DOC, doc_rows
from tests.llm.test_simhash_dedup import roots


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 4]) for k in range(len(words) - 3)) or frozenset([tuple(words)])


def plain(rows: list[tuple]) -> list[tuple]:
    """Of (doc_id, text, …): what the query returns; ids may repeat with different texts."""
    sets = [shingles(r[1]) for r in rows]
    pairs = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    rank = {k: at for at, k in enumerate(order)}
    classes = roots(list(range(len(rows))), [(rank[a], rank[b]) for a, b in pairs])
    out = []
    for k, row in enumerate(rows):
        first = rows[order[classes[rank[k]]]][0]
        out.append((row[0], len(sets[k]), first, first == row[0]))
    return sorted(out, key=str)


def family(seed: int, size: int, words: int, edits: int) -> list[str]:
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(words)]
    texts = []
    for k in range(size):
        own = list(base)
        for at in rng.sample(range(words), rng.randint(0, edits)):
            own[at] = f"own{seed}x{k}x{at}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("slice_bytes", [dedup.SLICE_BYTES, 3000])
def test_families_chains_and_a_common_passage(llm, monkeypatch, slice_bytes):
    monkeypatch.setattr(dedup.similar_roots, "__defaults__", (slice_bytes,))
    rng = random.Random(3)
    passage = " ".join(f"licence{k}" for k in range(60))
    texts = [t for seed in range(6) for t in family(seed, 12, 150, 8)]
    texts += [t for seed in range(20, 26) for t in family(seed, 8, rng.randint(5, 14), 1)]
    texts += [f"{passage} " + " ".join(f"q{k}y{j}" for j in range(rng.randint(3, 40))) for k in range(40)]
    chain = [f"c{k}" for k in range(100)]
    for k in range(8):  # each like the next, the ends unlike
        chain[12 * k : 12 * k + 3] = [f"n{k}", f"m{k}", f"o{k}"]
        texts.append(" ".join(chain))
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(900 + k, texts[k].upper(), "en", "s", 0) for k in range(40)]
    got = dedup.near_copies(llm.createDataFrame(rows, DOC).repartition(4)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_lists_of_one_family_are_gathered(llm):
    """Near-copies go to a tile once; lists that only share a quoting node, and are cheaper apart, stay lists."""
    family = [(run, fp, 100, 50 if fp == 1 else 1, fp) for run in range(30) for fp in range(1, 9) if fp != 2 + run % 7]
    apart = [(100 + run, fp, 100, 90 if fp == 99 else 1, fp) for run in range(30) for fp in (99, *range(1000 + 10 * run, 1010 + 10 * run))]
    members = llm.createDataFrame(family + apart, "run bigint, fp bigint, n_shingles bigint, degree bigint, component bigint")
    got = {tuple(r) for r in dedup._gathered(members, 8 * 100 * 11).select("run", "fp").collect()}
    assert got == {(1, fp) for fp in range(1, 9)} | {(r[0], r[1]) for r in apart}


def test_awkward_documents(docs):
    assert sorted((tuple(r) for r in dedup.near_copies(docs).collect()), key=str) == plain(doc_rows())


def test_query_and_empty_table(llm, no_docs, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_minhash(llm, str(tmp_path)).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert dedup.near_copies(no_docs).count() == 0


def test_small_sets_at_the_similarity_share_a_run():
    values = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 15, np.uint64))
    for n in range(1, 13):
        for sides in itertools.product((0, 1, 2), repeat=n):
            both = sides.count(0)
            if both < 0.8 * n or both == n:
                continue
            a, b = (values[:n][[s in (0, own) for s in sides]] for own in (1, 2))
            assert np.intersect1d(dedup.runs_of(a, len(a)), dedup.runs_of(b, len(b))).size, sides
        if n == 9:
            break


def test_estimate_is_exact_within_the_sketch():
    rng = np.random.default_rng(3)
    for _ in range(50):
        pool = np.sort(rng.integers(0, 1 << 62, 60, np.uint64))
        a, b = (np.sort(rng.choice(pool, 40, replace=False)) for _ in range(2))
        assert dedup.estimate(a, b) == len(np.intersect1d(a, b)) / len(np.union1d(a, b))


def test_large_sets_at_the_similarity_share_a_run():
    rng = np.random.default_rng(4)
    for _ in range(2000):
        pool = rng.integers(0, 1 << 63, 500, np.uint64)
        a, b = np.sort(pool[:450]), np.sort(pool[50:])
        a, b = a[: dedup.SKETCH], b[: dedup.SKETCH]
        assert np.intersect1d(dedup.runs_of(a, 450), dedup.runs_of(b, 450)).size


@pytest.mark.parametrize("across", [False, True])
def test_forest_joins_all_similar_pairs(across):
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 62, 60, np.uint64))
    sets = [np.unique(np.append(rng.choice(base, 60 - k % 9, replace=False), rng.integers(0, 1 << 62, k % 5, np.uint64))) for k in range(40)]
    sides = np.arange(40) % 2 if across else np.zeros(40, int)
    found = dedup.forest(sets, np.arange(40), sides, 0.8)
    want = [(a, b) for a in range(40) for b in range(a) if dedup.similar(sets[a], sets[b], 0.8) and (not across or sides[a] != sides[b])]
    assert roots(list(range(40)), found) == roots(list(range(40)), want)


def test_a_lower_similarity_is_refused(docs):
    with pytest.raises(ValueError, match="0.8"):
        dedup.near_copies(docs, similarity=0.5)


def test_frequent_keys_are_joined_where_they_are(llm):
    rows = llm.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(3000)] + [(100 + k, k) for k in range(2000)], "key int, v int")
    classes = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("top")).withColumnRenamed("key", "of")
    got = common.join_hot(rows, classes, "key", "of", "n").select("key", "v", "top")
    assert got.count() == 5000 and got.where("v > top").count() == 0
