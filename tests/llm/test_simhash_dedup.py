"""Fingerprints, tiles and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash_dedup as dedup
from tessera.llm.components import connected_components
from tests.llm.conftest import DOC, PROSE, doc_rows


def fingerprint(text: str | None) -> int:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes: list, links) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(values: list[int], radius: int = 4):
    return [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= radius]


def clustered(n: int, seed: int) -> list[int]:
    """Values with chains and dense clusters of few differing bits."""
    rng = random.Random(seed)
    out: set[int] = set()
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 40])):
            out.add(base)
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                base ^= 1 << bit
    return sorted(out)[:n]


@pytest.mark.parametrize("tile", [1, 3, 4096])
def test_links_reach_what_brute_force_reaches(llm, tile):
    values = clustered(400, 7)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    links = dedup.near_links(llm.createDataFrame([(s,) for s in signed], "fp bigint"), tile=tile).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in links)
    unsigned = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in links]
    assert roots(values, unsigned) == roots(values, near(values))


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_block_masks_catch_every_pair_within_the_radius(depth):
    rng = random.Random(depth)
    masks = dedup.block_masks(depth)
    assert len(masks) == 5**depth
    for _ in range(500):
        difference = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(mask & difference == 0 for mask in masks)


def test_documents_against_brute_force(docs):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in dedup.near_copies(docs).collect()}
    prints = [(row[0], fingerprint(row[1])) for row in doc_rows()]
    classes = roots(sorted({f for _, f in prints}), near(sorted({f for _, f in prints})))
    least: dict[int, int | None] = {}
    for id, f in prints:
        known = [i for i in (least.get(classes[f]), id) if i is not None]
        least[classes[f]] = min(known, default=None)
    assert got == {(id, f"{f:016x}", least[classes[f]]) for id, f in prints}
    assert dedup.near_copies(docs).count() == len(prints)


def test_one_document_of_each_component_stays(docs):
    kept = dedup.keep_first(docs)
    assert kept.columns == docs.columns
    classes = dedup.near_copies(docs).select("component_id").distinct().count()
    got = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(got) == classes and len(set(got)) == classes
    assert dedup.near_copies(kept).select("component_id").distinct().count() == classes


def test_empty_table(no_docs):
    assert dedup.near_copies(no_docs).count() == 0
    assert dedup.keep_first(no_docs).count() == 0


def test_large_group_of_copies(llm):
    rows = [(k, PROSE if k % 3 else f"{PROSE} tail {k}", "en", "s", 0) for k in range(600)]
    got = dedup.near_copies(llm.createDataFrame(rows, DOC))
    prints = {row[0]: fingerprint(row[1]) for row in rows}
    classes = roots(sorted(set(prints.values())), near(sorted(set(prints.values()))))
    least = {}
    for k in sorted(prints):
        least.setdefault(classes[prints[k]], k)
    assert {r.doc_id: r.component_id for r in got.collect()} == {k: least[classes[f]] for k, f in prints.items()}


def test_components_of_stars_chains_and_loops(llm):
    edges = [(1, k) for k in range(2, 60)] + [(k, k + 1) for k in range(100, 160)] + [(300, 200), (200, 300), (5, 5), (159, 99)]
    got = {r.node: r.root for r in connected_components(llm.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = sorted({n for e in edges for n in e if e[0] != e[1]})
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(llm.createDataFrame([], "a bigint, b bigint")).where(F.lit(True)).count() == 0
