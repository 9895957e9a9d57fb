"""Counts against plain Python; divergence on junk; awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import oracles
from tessera.llm import quality_rules as rules
from tests.llm.conftest import DOC, PROSE, doc_rows


def counted(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    many = Counter(windows)
    repeated = len({k + j for k, w in enumerate(windows) if many[w] > 1 for j in range(5)})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * repeated > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated, failed


def rows_of(frame) -> list[tuple]:
    return sorted(
        ((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in frame.collect()), key=repr
    )


def test_counts_of_awkward_rows(docs):
    want = sorted(((row[0], *counted(row[1])) for row in doc_rows()), key=repr)
    assert rows_of(rules.quality_counts(docs)) == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é|", max_size=60), min_size=1, max_size=12))
def test_counts_of_any_text(llm, texts):
    df = llm.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOC)
    assert rows_of(rules.quality_counts(df)) == sorted(((k, *counted(t)) for k, t in enumerate(texts)), key=repr)


def corpus() -> list[tuple]:
    words = PROSE.split()
    rng = random.Random(5)
    clean = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(120)]
    junk = [" | ".join(f"zq{k}{j}xk" for j in range(60)) for k in range(6)]
    return [(k, t, "en", "s", 0) for k, t in enumerate(clean + junk)]


def test_junk_diverges_and_prose_stays(llm):
    got = {r.doc_id: r for r in rules.quality_counts(llm.createDataFrame(corpus(), DOC)).collect()}
    assert all(got[k].divergent and not got[k].kept for k in range(120, 126))
    assert not any(got[k].divergent for k in range(120))


def test_filter_agrees_with_counts_and_keeps_columns(docs):
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    want = sorted((r.doc_id for r in rules.quality_counts(docs).where("kept").collect()), key=repr)
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=repr) == want


def test_empty_table(no_docs):
    assert rules.quality_counts(no_docs).count() == 0
    assert rules.keep_good(no_docs).count() == 0


def test_twin_in_sql(llm):
    rows = corpus() + [(200 + k, t, lang, "s", 0) for k, (t, lang) in enumerate([("", None), (None, "de"), (PROSE * 3, "zz")])]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    want = sorted(con.execute(f"SELECT doc_id, kept, divergent, base_failed FROM ({oracles.quality_rules()})").fetchall())
    got = rules.quality_counts(llm.createDataFrame(rows, DOC)).select("doc_id", "kept", "divergent", "base_failed").collect()
    assert sorted(map(tuple, got)) == want
