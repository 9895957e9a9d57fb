"""A Merkle manifest of a dataset: one tree per group, one tree over the groups, proofs of every leaf.

Leaves are numbered within their group by a range-partitioned sort and prefix sums over partition
counts. ``BLOCK`` consecutive leaves form a leaf partition: a first pass hashes each to its
top digest, and the digests above are built the same way, block by block, into a table of
nodes by coordinate (group, level, index). Proofs come as an octopus multiproof: a leaf partition
computes the minimal union of coordinates that its leaves' proofs miss, all partitions fetch
theirs in one equi-join, and each then derives the interiors its leaves share and expands every
leaf's own proof locally. Nothing of the size of a group meets in one task.

Defined cases: a null column is ``-`` in its leaf; a null group is a group of its own and the
first; a null id comes first in its group; rows with the same id are ordered by leaf digest,
and equal rows are leaves of their own; other columns are not read; one leaf is its group's
root, and one group's root is the root; an empty table has no root and gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.staging import broadcast_if, measured, stage

#: Children of a node.
ARITY = 8
#: Levels of a leaf partition, and so its leaves.
HEIGHT = 4
BLOCK = ARITY**HEIGHT
#: Rows of one partition of the sort, and the size up to which a side is broadcast.
SORTED_ROWS = 1 << 18
BROADCAST_BYTES = 8 << 20


def digest_of(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def encoded(value: Column) -> Column:
    """A value as ``-`` if null, else its length in UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def group_key(group: Column) -> Column:
    """A text without nulls that sorts by bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def height_of(leaves: int) -> int:
    """Levels above the leaves until one node remains."""
    levels = 0
    while leaves > 1:
        leaves = -(-leaves // ARITY)
        levels += 1
    return levels


def missing_above(low: int, high: int, total: int) -> list[tuple[int, int]]:
    """Coordinates (level, index) that the proofs of leaves ``low`` up to ``high`` (exclusive) of
    ``total`` need beside what these leaves give themselves: the minimal union, each once."""
    out: list[tuple[int, int]] = []
    level = 0
    while total > 1:
        first, last = low // ARITY * ARITY, min(-(-high // ARITY) * ARITY, total)
        out += [(level, k) for k in (*range(first, low), *range(high, last))]
        low, high, total = low // ARITY, -(-high // ARITY), -(-total // ARITY)
        level += 1
    return out


def interiors(digests: list[str], levels: int) -> list[list[str]]:
    """The digests and the levels above them, when they are aligned to their parents."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([digest_of("".join(below[k : k + ARITY])) for k in range(0, len(below), ARITY)])
    return out


def sides(level: list[str]) -> list[tuple[str, str]]:
    """What stands left and right of every node within its run."""
    out = []
    for start in range(0, len(level), ARITY):
        run = level[start : start + ARITY]
        out += [("".join(run[:k]), "".join(run[k + 1 :])) for k in range(len(run))]
    return out


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``pos`` within the rows' ``key`` by the order, and ``total`` of the key."""
    parts = max(1, -(-rows.count() // SORTED_ROWS), rows.sparkSession.sparkContext.defaultParallelism)
    by = ["key", *order]
    schema = rows.schema.simpleString()[len("struct<") : -1] + ",part:int,local:bigint"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            local = []
            for key in batch.column("key").to_pylist():
                last, at = (last, at + 1) if key == last else (key, 0)
                local.append(at)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(local), pa.int32()), pa.array(local, pa.int64())],
                names=[*batch.schema.names, "part", "local"],
            )

    ordered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = stage(ordered.mapInArrow(work, schema), f"{name}-sorted")
    runs = placed.groupBy("key", "part").agg(F.count("*").alias("n"))
    per_key = Window.partitionBy("key")
    before = F.sum("n").over(per_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = stage(
        runs.select(
            F.col("key").alias("in_key"), F.col("part").alias("in_part"),
            F.coalesce(before, F.lit(0)).alias("start"), F.sum("n").over(per_key).alias("total"),
        ),
        f"{name}-starts",
    )
    size = measured(starts, bytes=F.coalesce(F.sum(F.octet_length("in_key") + 40), F.lit(0)))["bytes"]
    joined = placed.join(
        broadcast_if(starts, size, BROADCAST_BYTES), (F.col("key") == F.col("in_key")) & (F.col("part") == F.col("in_part"))
    )
    return joined.select(*rows.columns, (F.col("start") + F.col("local")).alias("pos"), "total")


_NODE = "key string, level int, idx bigint, total bigint, top boolean, digest string"


def _nodes(leaves: DataFrame, name: str) -> DataFrame:
    """Nodes of every group's tree from the tops of the leaf partitions upward, staged.

    ``leaves`` has ``key``, ``pos``, ``total`` and ``digest``; ``top`` marks a group's root.
    """
    def climb(level: int, whole: bool):
        def work(given: pa.Table) -> pa.Table:
            given = given.sort_by("pos")
            key, total = given["key"][0].as_py(), given["total"][0].as_py()
            height, start = height_of(total), given["pos"][0].as_py()
            built = interiors(given["digest"].to_pylist(), min(HEIGHT, height - level))
            rows = [
                (key, level + k, start // ARITY**k + j, total, level + k == height, d)
                for k, digests in enumerate(built) if k == len(built) - 1 or whole and k for j, d in enumerate(digests)
            ]
            names = ("key", "level", "idx", "total", "top", "digest")
            types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            return pa.table({n: pa.array(v, t) for n, v, t in zip(names, zip(*rows, strict=True), types, strict=True)})

        return work

    current, level = leaves, 0
    found: DataFrame | None = None
    while True:
        block = F.floor(F.col("pos") / F.lit(BLOCK)).alias("block")
        rows = current.select("key", "pos", "total", "digest", block)
        built = stage(rows.groupBy("key", "block").applyInArrow(climb(level, level > 0), _NODE), f"{name}-nodes")
        found = built if found is None else found.unionByName(built)
        level += HEIGHT
        current = built.where((F.col("level") == level) & ~F.col("top")).withColumnRenamed("idx", "pos")
        if current.isEmpty():
            return found


_WANTED = "key string, block bigint, level int, idx bigint"


def _fetched(nodes: DataFrame) -> DataFrame:
    """``key``, ``block`` and the nodes its leaves' proofs miss, as ``fetched`` (level, index, digest)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (key, block, level, idx)
                for key, block, total in zip(*(batch.column(n).to_pylist() for n in ("key", "block", "total")), strict=True)
                for level, idx in missing_above(block * BLOCK, min((block + 1) * BLOCK, total), total)
            ]
            if rows:
                types = (pa.string(), pa.int64(), pa.int32(), pa.int64())
                columns = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "block", "level", "idx"])

    # a partition whose own digest is its group's root misses nothing
    tops = nodes.where((F.col("level") == HEIGHT) & ~F.col("top"))
    wanted = tops.select("key", F.col("idx").alias("block"), "total").mapInArrow(work, _WANTED)
    # the table of nodes holds one row a coordinate, so each wanted coordinate is met once
    met = wanted.join(nodes.select("key", "level", "idx", "digest"), ["key", "level", "idx"])
    return met.groupBy("key", "block").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("fetched"))


def _expanded(leaves: DataFrame, about: DataFrame, kept: list[str], schema: str, finish) -> DataFrame:
    """Every leaf with its own proof: ``finish(row values, steps, about's row)`` gives the row's new values.

    ``about`` has one row a (key, block) with ``fetched``; both sides meet by leaf partition.
    """
    kinds = dict(part.strip().split(" ") for part in schema.split(","))
    names = list(kinds)
    fields = F.floor(F.col("pos") / F.lit(BLOCK)).alias("block")
    rows = leaves.select("key", "pos", "total", "digest", *kept, fields)

    def work(given: pa.Table, other: pa.Table) -> pa.Table:
        given = given.sort_by("pos")
        total, start = given["total"][0].as_py(), given["pos"][0].as_py()
        row = other.to_pylist()[0] if other.num_rows else {}
        height = height_of(total)
        own = interiors(given["digest"].to_pylist(), min(HEIGHT, height))
        local = [sides(level) for level in own[: min(HEIGHT, height)]]
        shared: list[tuple[str, str]] = []
        at: dict[int, list[tuple[int, str]]] = {}
        for node in row.get("fetched") or []:
            at.setdefault(node["level"], []).append((node["idx"], node["digest"]))
        for level in range(HEIGHT, height):
            mine = start // ARITY**level
            others = sorted(at.get(level, []))
            shared.append(("".join(d for i, d in others if i < mine), "".join(d for i, d in others if i > mine)))
        columns = {name: given[name] for name in kept}
        leaves_ = given["digest"].to_pylist()
        more = [given[name].to_pylist() for name in kept]
        out = [
            finish(leaf, dict(zip(kept, values, strict=True)), [*(level[k // ARITY**h] for h, level in enumerate(local)), *shared], row)
            for k, (leaf, *values) in enumerate(zip(leaves_, *more, strict=True))
        ]
        made = dict(zip([n for n in names if n not in columns], zip(*out, strict=True), strict=True))
        types = {"array<string>": pa.list_(pa.string()), "boolean": pa.bool_(), "string": pa.string()}
        return pa.table({n: columns[n] if n in columns else pa.array(list(made[n]), types[kinds[n]]) for n in names})

    theirs = about.withColumnsRenamed({"key": "in_key", "block": "in_block"})
    return rows.groupBy("key", "block").cogroup(theirs.groupBy("in_key", "in_block")).applyInArrow(work, schema)


def fold(leaf: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and the siblings left and right of its path give."""
    for left, right in steps:
        leaf = digest_of(left + leaf + right)
    return leaf


@dataclass(frozen=True)
class Manifest:
    """Staged leaves and nodes of a dataset. ``root`` is None for an empty one."""

    leaves: DataFrame
    nodes: DataFrame
    paths: DataFrame
    root: str | None


def build(leaves: DataFrame) -> Manifest:
    """The manifest of ``id``, ``group``, ``leaf`` (a digest) and ``claimed``, a digest to be
    judged in place of the leaf or null."""
    keyed = leaves.select(group_key(F.col("group")).alias("key"), "id", F.col("leaf").alias("digest"), "claimed")
    keyed = stage(keyed, "merkle-digests")  # the sort reads its rows twice, the documents only once
    numbered = stage(_numbered(keyed, ["id", "digest"], "merkle"), "merkle-leaves")
    nodes = _nodes(numbered, "merkle")
    tops = nodes.where("top").select(F.lit("").alias("key"), F.col("key").alias("of"), "digest")
    groups = stage(_numbered(tops, ["of"], "merkle-groups"), "merkle-group-leaves")
    upper = _nodes(groups, "merkle-groups")
    root = upper.where("top").first()

    def path(leaf: str, values: dict, steps: list[tuple[str, str]], row: dict) -> tuple:
        return leaf, [left for left, _ in steps], [right for _, right in steps]

    paths = stage(
        _expanded(groups, _fetched(upper), ["of"], "of string, subroot string, lefts array<string>, rights array<string>", path),
        "merkle-paths",
    )
    return Manifest(numbered, nodes, paths, root and root["digest"])


def proofs(manifest: Manifest, siblings: bool = True) -> DataFrame:
    """Per leaf: ``id``, ``leaf``, ``subroot``, ``root``, ``siblings`` (per level, left then right, of
    the path to the root; left out if not wanted), ``proof_sha256`` (their digest), ``folded_root`` (from the claimed digest, else
    the leaf) and ``verified``."""
    root = manifest.root
    id_type = manifest.leaves.schema["id"].dataType.simpleString()
    blocks = manifest.leaves.select("key", F.floor(F.col("pos") / F.lit(BLOCK)).alias("block")).distinct()
    fetched = _fetched(manifest.nodes).select(F.col("key").alias("k"), F.col("block").alias("b"), "fetched")
    about = (
        blocks.join(fetched, (F.col("key") == F.col("k")) & (F.col("block") == F.col("b")), "left")
        .join(manifest.paths, F.col("key") == F.col("of"))
        .select("key", "block", "fetched", "subroot", "lefts", "rights")
    )

    def prove(leaf: str, values: dict, steps: list[tuple[str, str]], row: dict) -> tuple:
        steps = [*steps, *zip(row["lefts"], row["rights"], strict=True)]
        beside = [left + right for left, right in steps]
        folded = fold(values["claimed"] or leaf, steps)
        return leaf, row["subroot"], root, beside if siblings else None, digest_of("".join(beside)), folded, folded == root

    schema = (
        f"id {id_type}, leaf string, subroot string, root string, siblings array<string>, proof_sha256 string, "
        "folded_root string, verified boolean, claimed string"
    )
    found = _expanded(manifest.leaves, about, ["id", "claimed"], schema, prove).drop("claimed")
    return found if siblings else found.drop("siblings")
