"""Trees, proofs and multiproofs against plain lists."""

from __future__ import annotations

import hashlib
import re
import string
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle_manifest as mm
from tessera.llm import oracles, queries
from tests.llm.conftest import DOC, doc_rows


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def path(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        start = at // 8 * 8
        out.append(("".join(level[start:at]), "".join(level[at + 1 : start + 8])))
        at //= 8
    return out


def plain(rows: list[tuple]) -> list[tuple]:
    """Of (doc_id, text, lang, source, n_chars): what the query returns."""
    fields = lambda r, text: (r[0], r[3], r[2], r[4], text)
    groups: dict = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(fields(row, row[1])), row))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for key in keys:
        groups[key].sort(key=lambda r: r[:3])
        trees[key] = tree([r[2] for r in groups[key]])
    top = tree([trees[k][-1][0] for k in keys])
    out = []
    for j, key in enumerate(keys):
        for at, (_, _, own, row) in enumerate(groups[key]):
            steps = path(trees[key], at) + path(top, j)
            folded = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                folded = leaf(fields(row, row[1] and re.sub("[A-Z]", lambda m: m[0].lower(), row[1])))
            for left, right in steps:
                folded = sha(left + folded + right)
            root = top[-1][0]
            out.append((row[0], own, trees[key][-1][0], root, sha("".join(a + b for a, b in steps)), folded, folded == root))
    return out


def sorted_rows(rows) -> list:
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize(("height", "languages"), [(4, 3), (1, 3), (2, 70)])
def test_proofs_against_plain_trees(llm, monkeypatch, tmp_path, height, languages):
    monkeypatch.setattr(mm, "HEIGHT", height)
    monkeypatch.setattr(mm, "BLOCK", 8**height)
    rows = [(k, f"Text {k % 50} É", "one" if k % 2 else f"l{k % languages}", "s", k) for k in range(700)]
    rows += [(k, "x", None, None, None) for k in range(9)] + [(800, "ALONE", "zz", "s", 1), (None, "no id", "l0", "s", 1)] + doc_rows()
    llm.createDataFrame(rows, DOC).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_merkle_manifest(llm, str(tmp_path)).collect()
    assert sorted_rows(got) == sorted_rows(plain(rows))
    assert 0 < sum(r.verified for r in got) < len(got)


def test_twin(llm, tmp_path):
    rows = [(k, f"Text {k}" if k % 9 else None, ["a", "B", None, "ü"][k % 4 if k < 300 else 0], "s" if k % 5 else None, k) for k in range(600)]
    llm.createDataFrame(rows, DOC).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted_rows(con.sql(oracles.merkle_manifest()).fetchall()) == sorted_rows(plain(rows))


@pytest.mark.parametrize("total", [1, 7, 8, 9, 64, 65, 600])
def test_missing_coordinates_are_the_minimal_union(total):
    sizes = [total]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // 8))
    for low, high in [(0, 1), (0, total), (total // 3, total // 2 + 1), (total - 1, total), (total // 9 * 8, total)]:
        needed, own = set(), set()
        for at in range(low, high):
            for level, size in enumerate(sizes):
                own.add((level, at // 8**level))
                if size > 1:
                    start = at // 8**level // 8 * 8
                    needed |= {(level, k) for k in range(start, min(start + 8, size))}
        found = mm.missing_above(low, high, total)
        assert len(found) == len(set(found)) and set(found) == needed - own


def test_siblings_fold_to_the_root(docs):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaves = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("group"), mm.leaf_digest(*fields).alias("leaf"), F.lit(None).cast("string").alias("claimed"))
    manifest = mm.build(leaves)
    for row in mm.proofs(manifest).collect():
        assert row.verified and row.root == manifest.root
        assert row.proof_sha256 == sha("".join(row.siblings))


def test_empty_table(no_docs):
    leaves = no_docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("group"), F.lit("").alias("leaf"), F.lit(None).cast("string").alias("claimed"))
    manifest = mm.build(leaves)
    assert manifest.root is None and mm.proofs(manifest).count() == 0


def test_letters_are_lowered_as_the_contract_says(llm):
    text = "ÀÉ" + string.ascii_uppercase
    row = llm.createDataFrame([(text,)], "text string").select(F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).first()
    assert row[0] == "ÀÉ" + string.ascii_lowercase
