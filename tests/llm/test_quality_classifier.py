"""Held-out accuracy, shrinkage by hand, awkward rows."""

from __future__ import annotations

import math
import random

import pytest

from tessera.llm import quality_classifier as qc
from tests.llm.conftest import DOC, PROSE

LABEL = "doc_id bigint, quality int, toxic int"


def corpus(n: int) -> tuple[list, list]:
    rng, words = random.Random(3), PROSE.split()
    docs, labels = [], []
    for k in range(n):
        bad, toxic = k % 7 == 0, k % 5 == 0
        text = [rng.choice(words) for _ in range(60)] + ["stupid" if toxic else "kind"]
        rng.shuffle(text)
        docs.append((k, (" | " if bad else " ").join(text), "en", f"s{k % 4}", 0))
        labels.append((k, int(not bad), int(toxic)))
    return docs, labels


def test_held_out_accuracy(llm):
    docs, labels = corpus(600)
    got = qc.classify(llm.createDataFrame(docs, DOC), llm.createDataFrame(labels[:300], LABEL)).collect()
    want = {k: bool(q and not t) for k, q, t in labels}
    assert sum(r.kept == want[r.doc_id] for r in got if r.doc_id >= 300) >= 0.97 * 300


def test_shrinkage_by_hand(llm):
    rows = [(k, f"h{k % 3}", f"p{k % 2}", 0.9 if k % 3 == 0 else 0.2 + 0.01 * (k % 7)) for k in range(60)] + [(99, "rare", "p", 0.5)]
    scores = llm.createDataFrame(rows, "id bigint, host string, path string, good double")
    sites, mean, strength = qc.site_posteriors(scores, "good")
    assert mean == pytest.approx(sum(r[3] for r in rows) / len(rows))
    prior = {(s.host, s.path): s for s in sites.collect()}
    assert prior["h0", "p0"].prior > mean > prior["h1", "p0"].prior
    assert abs(prior["rare", "p"].prior - mean) < abs(0.5 - mean) + 1e-9
    rare = next(r for r in qc.combine(scores, "good").collect() if r.id == 99)
    s = prior["rare", "p"]
    others = (s.total - 0.5 + strength * s.prior) / (s.n - 1 + strength)
    logit = lambda x: math.log(x / (1 - x))
    assert logit(rare.good) == pytest.approx(logit(0.5) + logit(others) - logit(mean))
    assert qc.combine(scores, "good").count() == len(rows)
    joined = sorted((r.id, round(r.good, 9)) for r in qc.combine(scores, "good", broadcast_bytes=-1).collect())
    assert joined == sorted((r.id, round(r.good, 9)) for r in qc.combine(scores, "good").collect())


@pytest.mark.parametrize("labels", [[], [(0, 1, 0), (1, 1, 0), (None, 0, 1), (500, 0, 1)], [(0, 1, None), (6, 0, 0), (6, 1, 0), (0, 1, 1), (1, None, None)]])
def test_awkward_rows_and_few_labels(llm, docs, labels):
    got = qc.classify(docs, llm.createDataFrame(labels, LABEL)).collect()
    assert len(got) == docs.count()
    assert all(0 < r.good <= 1 and 0 <= r.bad < 1 for r in got)


def test_inflected_words_share_evidence(llm):
    """Toxic words of one stem, each form of its own: only beginnings can tell."""
    rng, words = random.Random(9), PROSE.split()
    forms = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    docs = [(k, " ".join([*rng.choices(words, k=50), *(["scurrilo" + forms[k]] * (k % 4 == 0))]), "es", "s", 0) for k in range(800)]
    labels = [(k, 1, int(k % 4 == 0)) for k in range(400)]
    got = qc.classify(llm.createDataFrame(docs, DOC), llm.createDataFrame(labels, LABEL)).collect()
    assert sum(r.kept == (r.doc_id % 4 != 0) for r in got if r.doc_id >= 400) >= 0.97 * 400


def test_planted_site_effects_are_found_and_move_verdicts(llm):
    """Sites whose documents are mostly bad draw their undecided ones down; sparse sites stay near the prior."""
    rows, k = [], 0
    for site, n, share in [("bad", 400, 0.9), ("good", 400, 0.1), ("sparse", 2, 1.0)]:
        for j in range(n):
            rows.append((k, site, "p", 0.95 if j < share * n else 0.05))
            k += 1
        rows.append((k, site, "p", 0.52))
        k += 1
    scores = llm.createDataFrame(rows, "id bigint, host string, path string, bad double")
    _, mean, strength = qc.site_posteriors(scores, "bad")
    assert 1 < strength < 100 and 0.4 < mean < 0.6  # the spread between sites is far beyond chance
    undecided = {r.host: r.bad for r in qc.combine(scores, "bad").where("id in (400, 801, 804)").collect()}
    assert undecided["bad"] > 0.8 > undecided["sparse"] > 0.5 > 0.2 > undecided["good"]


def test_empty_table(llm, no_docs):
    assert qc.classify(no_docs, llm.createDataFrame([(1, 0, 1)], LABEL)).count() == 0


def test_words_are_found_once_and_hashed_once_for_both_labels(llm):
    docs, labels = corpus(60)
    given = llm.createDataFrame(docs, DOC)
    models = qc.fit(given, llm.createDataFrame(labels, LABEL), {"quality": "min", "toxic": "max"})
    plan = qc.evidence(given, models, "source", "lang")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and plan.count("AS features#") == 1
    text = llm.createDataFrame([(1, "Reading the THE reading | x1"), (2, None)], "id int, text string")
    terms = {r.id: set(r.terms) for r in qc.with_terms(text).collect()}
    assert terms[1] == {"reading", "the", "x", "^read", "^readin", "#letters 7", "#marks 3", "#distinct 6", "#length 4"}
    assert terms[2] == {"#letters 0", "#marks 0", "#distinct 0", "#length 0"}
