"""Near-copies by bottom-k sketches: links between texts whose shingle sets are similar enough.

One hash function gives every shingle a value; a text's sketch is its ``SKETCH`` smallest. Retained
values are indexed in runs of ``RUN`` neighbours: of the sketch of two sets' union every value is in
both with the probability of their similarity, so two sets at 0.8 share a run of three among 64
except in 1 of 10^10 cases, while a passage that many texts quote seldom fills a run of any. Sets
within the sketch size always share one, if runs of two are added for sets of up to
five (see ``runs_of``).

Inverted lists of runs give the candidates. Equal sets are one node, and of lists with the same
members one is kept. Every list is first compared with
its most linked node, which settles groups of copies in as many comparisons as they have members;
lists that are not one component by then are gathered by their most linked node, so that near-copies
meet once and not in every run they share, and compared in tiles, leaving out pairs within a
component: overlaps of a whole tile are one product of incidence matrices, of the sketches first. A candidate pair passes the estimate from its union sketch (within ``SLACK``; in full for
sets within the sketch size) before the exact similarity of the full sets decides. No pair of copies
is written, and no candidate is capped.

Nodes are 64-bit hashes of shingle sets, so two of a billion different sets meet with 3 in 100.

Defined cases: a null or blank text has an empty set and is linked with nothing, not even with
another empty one; fewer words than a shingle form one; equal rows are copies of each other; a null id is larger
than every other; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import INNER, join_hot
from tessera.llm.components import connected_components
from tessera.plans.staging import stage

SHINGLE = 4
SIMILARITY = 0.8
SKETCH = 64
RUN = 3
#: How far the estimate may lie below the similarity: six standard deviations at 0.8.
SLACK = 0.3
#: Bytes of shingle sets in one slice of an inverted list, and sets.
SLICE_BYTES, SLICE_SETS = 4 << 20, 1024
#: Columns of an incidence matrix held at a time.
COLUMNS = 4096
SEED = 42
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; A-Z count as a-z."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        own = [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-width])).tolist()
        own = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    return np.unique(np.array(own, np.uint64))


def set_hash(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)


def runs_of(sketch: np.ndarray, size: int) -> np.ndarray:
    """Keys of the runs of neighbouring retained values.

    Of the n values of a union, sets at similarity 0.8 lack e <= n / 5 and share the rest in e + 1
    stretches, one of which has at least 4e / (e + 1) values, rounded up: three or more, but for
    a union of five with one lacking, whose stretches may be two and two.
    """
    out = []
    for run in (RUN, 2) if size <= 5 else (RUN,):
        if len(sketch) < run:
            continue
        key = np.full(len(sketch) - run + 1, run, np.uint64)
        for k in range(run):
            part = sketch[k : len(sketch) - run + 1 + k]
            key = (key ^ part) * _MIX
            key ^= key >> np.uint64(29)
        out.append(key)
    return np.concatenate(out) if out else np.empty(0, np.uint64)



def marks(docs: DataFrame, width: int, id: str, text: str) -> DataFrame:
    """Columns: the id, ``text_hash``, ``n_shingles``, ``fp`` (null for an empty set) and ``sketch``."""
    given = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    id_type = given.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, fps, sketches = [], [], []
            for value in batch.column("text"):
                own = shingle_set(value.as_py(), width)
                sizes.append(len(own))
                fps.append(set_hash(own) if len(own) else None)
                sketches.append(own[:SKETCH].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()),
                 pa.array(sketches, pa.list_(pa.int64()))],
                names=["id", "text_hash", "n_shingles", "fp", "sketch"],
            )

    return given.mapInArrow(work, f"id {id_type}, text_hash bigint, n_shingles bigint, fp bigint, sketch array<bigint>")


def _lists(nodes: DataFrame) -> DataFrame:
    """Inverted lists of runs, as rows ``run``, ``fp``, ``n_shingles``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n_shingles").to_numpy()
            own = [runs_of(s, n) for s, n in zip(_arrays(batch.column("sketch")), sizes.tolist(), strict=True)]
            if not own:
                continue
            counts = [len(r) for r in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(own).view(np.int64)), pa.array(np.repeat(batch.column("fp").to_numpy(), counts)), pa.array(np.repeat(sizes, counts))],
                names=["run", "fp", "n_shingles"],
            )

    return nodes.select("fp", "n_shingles", "sketch").mapInArrow(work, "run bigint, fp bigint, n_shingles bigint")


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity from the bottom-k sketch of the union of two sorted sketches."""
    both = np.union1d(a, b)[:SKETCH]
    hit = np.intersect1d(a, b, assume_unique=True)
    return np.searchsorted(hit, both[-1], "right") / len(both)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have the Jaccard similarity; the estimate goes first."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    if estimate(a[:SKETCH], b[:SKETCH]) < similarity - SLACK:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """Lists of longs as unsigned arrays, without a Python object a value."""
    ends = column.offsets.to_numpy()  # of the whole buffer of values, so slices are right too
    flat = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a``, ``b`` whose sizes and union sketches allow the similarity."""
    left = nodes.select(F.col("fp").alias("a_fp"), F.col("n_shingles").alias("a_n"), F.col("sketch").alias("a_sketch"))
    right = nodes.select(F.col("fp").alias("b_fp"), F.col("n_shingles").alias("b_n"), F.col("sketch").alias("b_sketch"))
    sizes = F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * similarity - 1e-9
    rows = pairs.join(left, pairs["a"] == left["a_fp"]).join(right, pairs["b"] == right["b_fp"]).where(sizes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(_arrays(batch.column("a_sketch")), _arrays(batch.column("b_sketch")), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([estimate(a, b) >= similarity - SLACK for a, b in both], pa.bool_()))

    return rows.select("a", "b", "a_sketch", "b_sketch").mapInArrow(work, "a bigint, b bigint")


def _sets(docs: DataFrame, nodes: DataFrame, width: int, id: str, text: str) -> DataFrame:
    """Columns ``fp``, ``own``: the shingle set of every node, taken from its first document."""
    first = nodes.select("fp", F.col("first.id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    given = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    rows = given.join(first, given["id"].eqNullSafe(first["first_id"]) & (given["text_hash"] == first["first_hash"])).select("fp", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([shingle_set(t.as_py(), width).view(np.int64) for t in batch.column("text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("fp"), own], names=["fp", "own"])

    return rows.dropDuplicates(["fp"]).mapInArrow(work, "fp bigint, own array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a``, ``b`` of nodes that are similar, on their full sets."""
    left = sets.select(F.col("fp").alias("a_fp"), F.col("own").alias("a_own"))
    right = sets.select(F.col("fp").alias("b_fp"), F.col("own").alias("b_own"))
    rows = pairs.join(left, pairs["a"] == left["a_fp"]).join(right, pairs["b"] == right["b_fp"]).select("a", "b", "a_own", "b_own")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(_arrays(batch.column("a_own")), _arrays(batch.column("b_own")), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([similar(a, b, similarity) for a, b in both], pa.bool_()))

    return rows.mapInArrow(work, "a bigint, b bigint")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one side with all of the other."""
    out = np.zeros((len(left), len(right)), np.float32)  # whole numbers, exact to 2^24
    rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    for start in range(0, len(shared), COLUMNS):
        part = shared[start : start + COLUMNS]
        incidence = []
        for row, values in zip(rows, flat, strict=True):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[at] == values
            matrix = np.zeros((row[-1] + 1, len(part)), np.float32)
            matrix[row[hit], at[hit]] = 1
            incidence.append(matrix)
        out += incidence[0] @ incidence[1].T
    return out


def forest(sets: list[np.ndarray], components: np.ndarray, sides: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join all similar pairs not in one component yet; across sides, if there are two."""
    across = bool(sides.any() and not sides.all())
    left = np.flatnonzero(sides == 0) if across else np.arange(len(sets))
    right = np.flatnonzero(sides == 1) if across else left
    sizes = np.array([len(s) for s in sets], float)
    both = lambda f, a, b: f(sizes[a][:, None], sizes[b][None, :])
    likely = components[left][:, None] != components[right][None, :]
    likely &= both(np.minimum, left, right) >= similarity * both(np.maximum, left, right) - 1e-9
    if not likely.any():
        return []
    # a union sketch holds no more shared values than the sketches do
    retained = overlaps([sets[k][:SKETCH] for k in left], [sets[k][:SKETCH] for k in right])
    likely &= retained >= (similarity - SLACK) * np.minimum(both(np.minimum, left, right), SKETCH) - 1e-6
    rows, columns = np.flatnonzero(likely.any(1)), np.flatnonzero(likely.any(0))
    if not len(rows):
        return []
    likely, left, right = likely[np.ix_(rows, columns)], left[rows], right[columns]
    common = overlaps([sets[k] for k in left], [sets[k] for k in right]).astype(float)
    linked = likely & (common >= similarity * (both(np.add, left, right) - common) - 1e-9)
    label, links = components.copy(), []
    for row, a in zip(linked, left, strict=True):
        met = right[row & (label[right] != label[a])]
        for name, first in zip(*np.unique(label[met], return_index=True), strict=True):
            links.append((int(a), int(met[first])))
            label[label == name] = label[a]
    return links


def _weight(slice_bytes: int) -> Column:
    """What a row takes of a slice; a set of few shingles weighs as much as its place in a tile."""
    return F.greatest(F.col("n_shingles"), F.lit(max(1, slice_bytes // (8 * SLICE_SETS))))


def _slices(size: Column, slice_bytes: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(size * 8 / slice_bytes)).cast("int")


def _gathered(members: DataFrame, slice_bytes: int) -> DataFrame:
    """Lists with the same most linked node as one list, where that sends no more rows to tiles.

    Near-copies share many runs, and the lists of those differ in a few members only. A pair of a
    list is a pair of the whole; pairs that only the whole has are judged by the same exact test.
    """
    shape = F.count("*").alias("n"), F.sum(_weight(slice_bytes)).alias("size")
    cost = F.col("n") * _slices(F.col("size"), slice_bytes)
    top = F.max(F.struct("degree", "n_shingles", "fp")).alias("top")
    centres = stage(
        members.groupBy("run").agg(top, *shape).select(F.col("run").alias("in_run"), F.col("top.fp").alias("centre"), cost.alias("cost")),
        "minhash-centres",
    )
    rows = members.join(centres, F.col("run") == F.col("in_run")).select("run", "centre", "fp", "component", "n_shingles")
    columns = ["fp", "component", "n_shingles"]
    whole = rows.select("centre", *columns).distinct().groupBy("centre").agg(*shape).select(F.col("centre").alias("of"), cost.alias("whole"))
    apart = centres.groupBy("centre").agg(F.sum("cost").alias("apart"))
    chosen = stage(apart.join(whole, F.col("centre") == F.col("of")).where("whole <= apart").select("of"), "minhash-gathered")
    run = F.coalesce("of", "run").alias("run")
    return stage(rows.join(chosen, F.col("centre") == F.col("of"), "left").select(run, *columns).distinct(), "minhash-units")


def _tiled(members: DataFrame, sets: DataFrame, similarity: float, slice_bytes: int) -> DataFrame:
    """Links within lists of rows ``run``, ``fp``, ``component``, ``n_shingles``.

    A list's largest component is not compared with itself. Each side is cut into slices of about
    ``slice_bytes`` of sets by a hash; a row goes to one unit of work for every slice it meets.
    """
    per = members.groupBy("run", "component").agg(F.sum(_weight(slice_bytes)).alias("size"))
    core = per.groupBy("run").agg(
        F.max_by("component", F.struct("size", "component")).alias("core"), F.max("size").alias("core_size"), F.sum("size").alias("all_size")
    )
    shape = stage(
        core.select(
            F.col("run").alias("in_run"), "core", _slices(F.col("core_size"), slice_bytes).alias("core_slices"),
            _slices(F.col("all_size") - F.col("core_size"), slice_bytes).alias("rest_slices"),
        ),
        "minhash-shapes",
    )
    rows = members.join(shape, F.col("run") == F.col("in_run"))
    inside = F.col("component") == F.col("core")
    mine = F.when(inside, F.pmod(F.xxhash64("fp"), "core_slices")).otherwise(F.pmod(F.xxhash64("fp"), "rest_slices")).cast("int")
    rest = lambda side: F.transform(
        F.sequence(F.lit(0), F.col("rest_slices") - 1),
        lambda s: F.struct(side(s)[0].alias("low"), side(s)[1].alias("high"), side(s)[2].alias("side")),
    )
    of_core = rest(lambda s: (-1 - F.col("mine"), s, F.lit(0)))
    of_rest = F.concat(
        F.transform(
            F.sequence(F.lit(0), F.col("core_slices") - 1),
            lambda s: F.struct((-1 - s).alias("low"), F.col("mine").alias("high"), F.lit(1).alias("side")),
        ),
        rest(lambda s: (F.least("mine", s), F.greatest("mine", s), (F.col("mine") > s).cast("int"))),
    )
    units = rows.withColumn("mine", mine).select(
        "run", "fp", "component", F.explode(F.when(inside, of_core).otherwise(of_rest)).alias("unit")
    ).select("run", "fp", "component", "unit.*")
    keys = ["run", "low", "high"]
    full = units.join(sets, "fp").select(*keys, "fp", "component", "side", "own")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                fps, components, sides, own = zip(*held, strict=True)
                links = forest(list(own), np.array(components, np.int64), np.array(sides), similarity)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([fps[link[k]] for link in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in (*keys, "fp", "component", "side")]
            for *key, fp, component, side, own in zip(*columns, _arrays(batch.column("own")), strict=True):
                if key != unit:
                    yield from done()
                    unit, held = key, []
                held.append((fp, component, side, own.copy()))
        yield from done()

    return full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, "a bigint, b bigint")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the lists that hold several components, with each row's."""
    named = members.join(roots, F.col("fp") == F.col("node"), "left").select(
        "run", "fp", "n_shingles", "degree", F.coalesce("root", "fp").alias("component")
    )
    named = stage(named, "minhash-named")
    several = named.groupBy("run").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c <> d").select(F.col("run").alias("in_run"))
    return stage(named.join(several, F.col("run") == F.col("in_run"), "left_semi"), "minhash-open")


def _centred(members: DataFrame) -> DataFrame:
    """Each list's rows with its most linked node: distinct pairs ``a``, ``b`` between components."""
    best = F.struct("degree", "n_shingles", "fp")
    centres = members.groupBy("run").agg(F.max(F.struct(best.alias("by"), "component")).alias("top")).select(
        F.col("run").alias("in_run"), F.col("top.by.fp").alias("b"), F.col("top.component").alias("b_component")
    )
    rows = members.join(centres, F.col("run") == F.col("in_run")).where(F.col("component") != F.col("b_component"))
    return rows.select(F.col("fp").alias("a"), "b").distinct()


def similar_roots(
    docs: DataFrame, nodes: DataFrame, width: int, similarity: float, id: str, text: str, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """Columns ``node``, ``root`` of the nodes that are linked to others."""
    if similarity < 0.8:
        raise ValueError("runs of three find all pairs from a similarity of 0.8 on")
    keyed = _lists(nodes)
    mark = F.xxhash64("fp")
    contents = (F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.sum(mark.bitwiseAND(0xFFFFFFFF)).alias("s"))
    lists = keyed.groupBy("run").agg(*contents).where("n > 1")
    lists = lists.groupBy("n", "x", "s").agg(F.min("run").alias("in_run"), F.count("*").alias("same"))
    lists = stage(lists.select("in_run", "n", "same"), "minhash-runs")
    met = keyed.join(lists, F.col("run") == F.col("in_run")).select("run", "fp", "n_shingles", "n", "same")
    met = stage(met, "minhash-met")
    degrees = met.groupBy("fp").agg(F.sum(F.col("n") * F.col("same")).alias("degree")).select(F.col("fp").alias("of"), "degree")
    members = met.join(degrees, F.col("fp") == F.col("of")).select("run", "fp", "n_shingles", "degree", F.col("fp").alias("component"))
    members = stage(members, "minhash-members")
    likely = stage(_likely(_centred(members), nodes, similarity), "minhash-likely")
    # a list of two is its centre and the other; longer ones go on
    wanted = nodes.join(members.select("fp").distinct(), "fp", "left_semi")
    sets = stage(_sets(docs, wanted, width, id, text), "minhash-sets")
    links = stage(_verified(likely, sets, similarity), "minhash-links")
    roots = stage(connected_components(links), "minhash-roots")
    longer = lists.where("n > 2").select("in_run")
    rest = members.drop("component").join(longer, F.col("run") == F.col("in_run"), "left_semi")
    more = _tiled(_gathered(_open(rest, roots), slice_bytes), sets, similarity, slice_bytes)
    return connected_components(links.unionByName(more))


def near_copies(
    docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = SHINGLE, similarity: float = SIMILARITY
) -> DataFrame:
    """Per document: id, ``n_shingles``, ``component_id`` (the smallest id reachable over links of at least the
    Jaccard ``similarity``) and ``kept`` (whether that is its own)."""
    marked = stage(marks(docs, width, id, text), "minhash-marks")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("text_hash").alias("text_hash"))
    nodes = stage(
        marked.where("fp is not null").groupBy("fp").agg(
            F.min(order).alias("first"), F.count("*").alias("copies"), F.any_value("n_shingles").alias("n_shingles"),
            F.any_value("sketch").alias("sketch"),
        ),
        "minhash-nodes",
    )
    roots = stage(similar_roots(docs, nodes, width, similarity, id, text), "minhash-roots")
    linked = roots.join(nodes.select("fp", "first"), F.col("node") == F.col("fp")).select("node", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least")).select(F.col("root").alias("of"), "least")
    moved = roots.join(least, F.col("root") == F.col("of")).select("node", "least")
    classes = nodes.select("fp", "first", "copies").join(moved, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias(INNER + "fp"), F.coalesce("least", "first").alias("class"), "copies"
    )
    filled = marked.where("fp is not null").select("id", "n_shingles", "fp")
    found = join_hot(filled, stage(classes, "minhash-classes"), "fp", INNER + "fp", "copies").select(
        "id", "n_shingles", F.col("class.id").alias("component_id")
    )
    empty = marked.where("fp is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    both = found.unionByName(empty)
    return both.select(F.col("id").alias(id), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
