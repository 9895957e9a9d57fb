"""Near-copies by SimHash: exact comparison of all fingerprints within a Hamming radius.

Fingerprints that differ in at most ``radius`` of 64 bits agree completely on one of
``radius + 1`` bit blocks, so they meet in a bucket of that block's value; larger corpora use
blocks of blocks, until buckets are small. A bucket is compared in tiles: numpy exclusive-or
and bit counts over whole tiles, tile pairs whose population counts differ by more than the
radius are never formed. A bucket beyond one tile is split by population count and, within
one, by hash, and each remaining pair of tiles is a unit of work of its own. No link is lost
and no pair of copies is written: equal fingerprints are one node, and a tile pair gives a
spanning forest of its links.

Defined cases: a null or blank text has fingerprint zero, linked like any other; fewer words
than a shingle form one shingle; rows with the same id and text are copies of each other; a
null id is larger than every other, so a component has a null id only if all its ids are
null; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import INNER, join_hot
from tessera.llm.components import connected_components
from tessera.plans.staging import stage

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints in a tile; a pair of tiles is compared in one go of 16 million bit counts.
TILE = 4096


def _shingle_hashes(text: str, width: int) -> list[int]:
    words = text.encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-width]))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]


def _majority(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per segment of hashes: the bits that are set in over half of them."""
    out = np.zeros(len(starts), np.uint64)
    for bit in range(64):
        ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), starts)
        out |= (2 * ones > sizes).astype(np.uint64) << np.uint64(bit)
    return out


def _texts_to_fingerprints(texts: list[str | None], width: int) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    begin = 0
    while begin < len(texts):  # some hundred thousand shingles at a time
        hashes: list[int] = []
        rows, starts, at = [], [], begin
        while at < len(texts) and len(hashes) < 200_000:
            own = _shingle_hashes(texts[at] or "", width)
            if own:
                rows.append(at)
                starts.append(len(hashes))
                hashes += own
            at += 1
        if rows:
            edges = np.array(starts)
            out[rows] = _majority(np.array(hashes, np.uint64), edges, np.diff(np.append(edges, len(hashes))).astype(np.uint64))
        begin = at
    return out


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """Columns: the id, ``text_hash`` and ``fp`` (the 64 bits as a signed long)."""
    given = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    id_type = given.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _texts_to_fingerprints(batch.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(found.view(np.int64))], names=["id", "text_hash", "fp"]
            )

    hashed = given.select("id", F.xxhash64("text").alias("text_hash"), "text")
    return hashed.mapInArrow(work, f"id {id_type}, text_hash bigint, fp bigint")


def block_masks(depth: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of which two fingerprints within the radius agree on at least one.

    Depth 1 cuts 64 bits into ``radius + 1`` blocks; every further depth cuts the bits left
    over in the same way, as the differences are all among them.
    """
    masks = [0]
    for _ in range(depth):
        finer = []
        for mask in masks:
            left = [bit for bit in range(64) if not mask >> bit & 1]
            for block in np.array_split(left, radius + 1):
                finer.append(mask | sum(1 << int(bit) for bit in block))
        masks = finer
    return masks


def _depth(nodes: int, radius: int, tile: int) -> int:
    """Depth from which on the mean bucket is within half a tile."""
    depth = 1
    while nodes >> min(m.bit_count() for m in block_masks(depth, radius)) > tile // 2 and depth < 4:
        depth += 1
    return depth


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric matrix of links, every node expanded once."""
    todo = near.any(1)
    links = []
    for root in np.flatnonzero(todo):
        if not todo[root]:
            continue
        todo[root] = False
        frontier = [root]
        while frontier:
            node = frontier.pop()
            fresh = np.flatnonzero(near[node] & todo)
            todo[fresh] = False
            links += [(node, other) for other in fresh]
            frontier += fresh.tolist()
    return links


def _compare(values: np.ndarray, sides: np.ndarray, radius: int) -> np.ndarray:
    """Links of one unit of work as rows (a, b): within it if no side is 1, else across sides."""
    order = np.argsort(np.bitwise_count(values), kind="stable")
    values, sides = values[order], sides[order]
    counts = np.bitwise_count(values).astype(np.int16)
    n = len(values)
    near = np.zeros((n, n), bool)
    for a in range(0, n, 512):
        b = min(a + 512, n)
        end = np.searchsorted(counts, counts[b - 1] + radius, "right")  # beyond, counts differ too much
        near[a:b, a:end] = np.bitwise_count(values[a:b, None] ^ values[None, a:end]) <= radius
    near |= near.T
    if sides.any():
        near &= sides[:, None] != sides[None, :]
    np.fill_diagonal(near, False)
    links = _forest(near)
    if not links:
        return np.empty((0, 2), np.uint64)
    return values[np.array(links)]


def _units(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Values and sides of every unit; a unit's rows follow each other, over batch edges too."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [batch.column(name).to_numpy(zero_copy_only=False) for name in (*keys, "fp", "side")]
        if held:
            columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        change = np.zeros(len(columns[0]), bool)
        for key in columns[:-2]:
            change[1:] |= key[1:] != key[:-1]
        cuts = np.append(0, np.flatnonzero(change))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                yield columns[-2][a:b].view(np.uint64), columns[-1][a:b]
        held = [c[cuts[-1] :] for c in columns]
    if held and len(held[0]) > 1:
        yield held[-2].view(np.uint64), held[-1]


def near_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``a``, ``b`` between the distinct longs of column ``fp``: for every bucket and pair of
    tiles a spanning forest of the pairs within the radius, so that reachability is complete."""
    masks = block_masks(_depth(nodes.count(), radius, tile), radius)
    blocks = F.array(*(F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(np.uint64(m).astype(np.int64).item())).alias("value")) for k, m in enumerate(masks)))
    keyed = nodes.select("fp", F.bit_count("fp").alias("ones"), F.explode(blocks).alias("key")).select("fp", "ones", "key.mask", "key.value")
    per_count = keyed.groupBy("mask", "value", "ones").agg(F.count("*").alias("n"))
    split = (
        per_count.groupBy("mask", "value")
        .agg(
            F.sum("n").alias("size"),
            F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile).cast("int").alias("slices")))).alias("slices"),
        )
        .where(F.col("size") > tile)
        .select(F.col("mask").alias("in_mask"), F.col("value").alias("in_value"), "slices")
    )
    rows = keyed.join(split, (F.col("mask") == F.col("in_mask")) & (F.col("value") == F.col("in_value")), "left")
    own = F.struct(F.col("ones").alias("ones"), F.pmod(F.xxhash64("fp"), F.try_element_at("slices", F.col("ones"))).cast("int").alias("slice"))
    near = F.sequence(F.greatest(F.lit(0), F.col("ones") - radius), F.least(F.lit(64), F.col("ones") + radius))
    others = F.flatten(F.transform(near, lambda p: F.transform(
        F.sequence(F.lit(0), F.coalesce(F.try_element_at("slices", p), F.lit(0))),
        lambda s: F.struct(p.alias("ones"), s.alias("slice")),
    )))
    others = F.filter(others, lambda t: t["slice"] < F.coalesce(F.try_element_at("slices", t["ones"]), F.lit(0)))
    pairs = F.transform(others, lambda t: F.struct(
        F.least(F.col("own"), t).alias("low"), F.greatest(F.col("own"), t).alias("high"),
        (F.col("own") > t).cast("int").alias("side"),
    ))
    single = F.struct(*(F.lit(-1).alias(n) for n in ("a", "b", "c", "d")), F.lit(0).alias("side"))
    flat = lambda p: F.struct(
        p["low"]["ones"].alias("a"), p["low"]["slice"].alias("b"), p["high"]["ones"].alias("c"), p["high"]["slice"].alias("d"), p["side"].alias("side")
    )
    units = rows.withColumn("own", own).select(
        "mask", "value", "fp",
        F.explode(F.when(F.col("slices").isNull(), F.array(single)).otherwise(F.transform(pairs, flat))).alias("unit"),
    ).select("mask", "value", "unit.*", "fp")
    keys = ["mask", "value", "a", "b", "c", "d"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, sides in _units(batches, keys):
            links = _compare(values, sides, radius)
            if len(links):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[:, k]).view(np.int64)) for k in (0, 1)], names=["a", "b"])

    return units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, "a bigint, b bigint")


def _classed(docs: DataFrame, id: str, text: str, radius: int) -> DataFrame:
    """Staged fingerprints with the ``first`` (id, text hash) of each document's component."""
    marks = stage(fingerprints(docs, id, text), "fingerprints")
    nodes = stage(_nodes(marks), "fingerprint-nodes")
    roots = stage(connected_components(near_links(nodes.select("fp"), radius)), "fingerprint-roots")
    return _firsts(marks, nodes, roots)


def _nodes(marks: DataFrame) -> DataFrame:
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("text_hash").alias("text_hash"))
    return marks.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("copies"))


def _firsts(marks: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    linked = roots.join(nodes, roots["node"] == nodes["fp"]).select("node", "root", "first")
    firsts = linked.groupBy("root").agg(F.min("first").alias("least")).select(F.col("root").alias("of"), "least")
    moved = roots.join(firsts, roots["root"] == firsts["of"]).select("node", "least")
    classes = nodes.join(moved, nodes["fp"] == moved["node"], "left").select(
        nodes["fp"].alias("class_fp"), F.coalesce("least", "first").alias("first"), "copies"
    )
    named = join_hot(marks, stage(classes, "fingerprint-classes"), "fp", "class_fp", "copies")
    return named.select("id", "text_hash", "fp", "first")


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per document: id, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest
    id reachable over links of at most ``radius`` differing bits."""
    return _classed(docs, id, text, radius).select(
        F.col("id").alias(id),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first.id").alias("component_id"),
    )


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each component, that of the smallest id, with its own columns."""
    i = INNER
    classed = _classed(docs, id, text, radius)
    firsts = classed.select(F.col("first.id").alias(i + "id"), F.col("first.text_hash").alias(i + "text_hash")).distinct()
    hashed = docs.withColumn(i + "hash", F.xxhash64(docs[text]))
    kept = hashed.join(
        firsts, hashed[id].eqNullSafe(firsts[i + "id"]) & (hashed[i + "hash"] == firsts[i + "text_hash"]), "left_semi"
    )
    return kept.dropDuplicates([id, i + "hash"]).drop(i + "hash")
