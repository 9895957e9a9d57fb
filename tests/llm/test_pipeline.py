"""Each stage on its own input, against plain readings of what it must do."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from tessera.llm import decontamination, quality_rules, secret_scan, simhash_dedup, tokenizer_files
from tests.llm.conftest import DOC
from tests.llm.test_decontamination import prose

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer_files.PIECES), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def folder(llm, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    item = prose(900, 30)
    rows = [(k, prose(k, 60), "en", "s", 0) for k in range(30)]
    rows += [(100 + k, prose(k, 60), "en", "s", 0) for k in range(5)]  # copies
    rows += [(200, f"{prose(201, 40)} {item} {prose(202, 40)}", "en", "s", 0), (201, prose(203, 40) + " token=abcdef123 " + prose(204, 20), "en", "s", 0)]
    rows += [(202, "too short", "en", "s", 0), (203, "again and again and " * 30, "en", "s", 0), (204, None, None, None, None)]
    llm.createDataFrame(rows, DOC).write.parquet(f"{root}/documents.parquet")
    llm.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages_one_by_one(llm, folder, tmp_path):
    docs = llm.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        function(llm, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = seen[name] = llm.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = lambda name: {r.doc_id for r in seen[name].collect()}
    assert ids("quality_rules") == {*range(30), *range(100, 105), 200, 201}
    assert ids("simhash_dedup") == {*range(30), 200, 201}
    assert ids("decontamination") == {*range(30), 201}
    assert "token=" not in "".join(r.text for r in seen["secret_scan"].collect())
    assert ids("sentencepiece") == {*range(30), 201}
    final = {r.doc_id: r.ids for r in corpus_pipeline.run(llm, folder).collect()}
    assert final == {r.doc_id: r.ids for r in seen["sentencepiece"].collect()}


def test_empty_documents(llm, folder, tmp_path):
    llm.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    llm.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(llm, str(tmp_path)).count() == 0


def test_each_stage_calls_its_operator():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "decontamination", "secret_scan", "sentencepiece"]
    assert all(callable(f) for f in (quality_rules.keep_good, simhash_dedup.keep_first, decontamination.keep_clean, secret_scan.redact))
