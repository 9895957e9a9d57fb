"""Footers kept between queries: only changed files are opened again."""

from __future__ import annotations

import os
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera import ship
from tessera.engine import Engine
from tessera.sources import footers
from tessera.sources.footerstore import _last_version, kept_footers
from tests import corpus


def write(path, values, group=10):
    pq.write_table(pa.table({"v": values, "w": [str(v) for v in values]}), path, row_group_size=group)


def rows(df) -> list:
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def spoil(path):
    """Other bytes under the same length and modification time: whoever opens the file fails."""
    stat = os.stat(path)
    with open(path, "wb") as file:
        file.write(b"x" * stat.st_size)
    os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))


@pytest.fixture
def folder(spark, tmp_path):
    ship(spark)
    data = tmp_path / "data here"
    data.mkdir()
    for k in range(4):
        write(data / f"{k}.parquet", list(range(k * 100, k * 100 + 35)))
    return data


def test_unchanged_files_are_not_opened(spark, folder, tmp_path):
    store = str(tmp_path / "store")
    want = rows(footers.footers(spark, str(folder)))
    assert rows(kept_footers(spark, store, str(folder))) == want
    for name in os.listdir(folder):
        spoil(folder / name)
    assert rows(kept_footers(spark, store, str(folder))) == want
    assert _last_version(spark, store)[0] == 1  # nothing was written either


def test_new_changed_and_vanished_files(spark, folder, tmp_path):
    store = str(tmp_path / "store")
    before = rows(kept_footers(spark, store, str(folder)))
    write(folder / "1.parquet", list(range(7)))
    write(folder / "9.parquet", list(range(900, 930)))
    os.remove(folder / "2.parquet")
    want = rows(footers.footers(spark, str(folder)))
    for name in ("0.parquet", "3.parquet"):
        spoil(folder / name)
    got = kept_footers(spark, store, str(folder))
    assert rows(got) == want != before
    assert footers.footprint(got).first()["files"] == 4
    assert rows(kept_footers(spark, store, str(folder))) == want


def test_an_uncommitted_version_is_not_read(spark, folder, tmp_path):
    store = tmp_path / "store"
    want = rows(kept_footers(spark, str(store), str(folder)))
    (store / "version-9-abc").mkdir()
    assert rows(kept_footers(spark, str(store), str(folder))) == want and _last_version(spark, str(store))[0] == 1


def test_engines_share_a_store(spark, tmp_path):
    root = str(tmp_path / "corpus")
    os.mkdir(root)
    corpus.write(root)
    catalog = corpus.catalog(root)
    first = Engine(spark, catalog, footer_store=str(tmp_path / "store"))
    info = first.dataset_schema("places").info
    second = Engine(spark, catalog, footer_store=str(tmp_path / "store"))
    again = second.dataset_schema("places").info
    assert info["row_count"] == again["row_count"] == 106 and info["location"] == catalog.path("places")
    assert {"title", "description", "notes", "name_column", "default_columns"} <= info.keys()
    assert second.list_datasets().info["default_source"] == catalog.names[0]


def test_bands_are_written_without_a_sort_of_all_rows(spark, tmp_path, monkeypatch):
    from workload import queries

    rows = "id AS l_orderkey, 1 AS l_linenumber, 'A' AS l_returnflag, cast(id AS double) AS l_extendedprice, 1.0D AS l_quantity"
    spark.range(0, 4000, 1, 3).selectExpr(*rows.split(", ")).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(queries, "checkpoint_dir", lambda _: str(tmp_path))
    whole = queries._banded_parcels(spark, str(tmp_path))
    assert sorted((p.name, len(list(p.glob("*.parquet")))) for p in Path(whole).glob("band=*")) == [(f"band={b}", 1) for b in (-1, -2, 0, 1)]
    kept = {r["band"]: r["row_count"] for r in queries._footers_kept(spark, str(tmp_path)).collect()}
    assert kept == {r["band"]: r["count"] for r in spark.read.parquet(whole).groupBy("band").count().collect()}
    spread = [p for p in tmp_path.glob("bands-*") if str(p) != whole]
    assert all(len(list(b.glob("*.parquet"))) > 1 for p in spread for b in p.glob("band=*"))


def test_a_table_in_a_folder_is_named_by_its_folder(spark, tmp_path):
    from workload import queries

    ship(spark)
    spark.range(0, 30, 1, 3).write.parquet(str(tmp_path / "orders.parquet"))
    row = queries._footprint(spark, str(tmp_path)).first()
    assert (row["name"], row["row_count"], row["files"]) == ("orders", 30, 3)
