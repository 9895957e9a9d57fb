"""Hard negatives for contrastive training, by Fagin's threshold algorithm on blocks of rows.

Components become integers, so scores (inner products) are exact. Rows are dealt by a hash of their
id into blocks of about ``BLOCK`` rows. A block keeps one sorted list of rows per dimension. An
anchor reads the lists in step, from above where its own component is positive and from below where
it is negative, scores every row it meets for the first time by random access, and stops
once the threshold (the score of a row with the last values read) falls strictly below the k-th score
of each of its windows, or below a window's lower bound: no row unread can enter a result. Blocks'
results are merged by rank.

First pass: the anchor's best rows of its own label, in blocks of that label. Second pass: per positive
the best rows of other labels whose score is within a share of the positive's. An anchor travels
once to each block, and each block's rows are shuffled once a pass; no pair of rows is ever written.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no
part; an id is one row (of several, that with the least label and vector); shorter vectors end in
zeros; ties go to the smaller id; components whose products could leave a long saturate (from about
150,000 for 64 dimensions on); an anchor without positives has no rows; a window that holds fewer rows
gives those; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.staging import broadcast_if, measured, stage

#: Rows of a block, and so of its sorted lists.
BLOCK = 8192
#: Entries read from each list before the first look at the threshold; doubled after each.
STEP = 8
BROADCAST_BYTES = 8 << 20
_INT = 2**31 - 1


class SortedLists:
    """A block's rows with one ascending list per dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
        self.ids, self.matrix = ids, matrix
        names, self.codes = np.unique(labels, return_inverse=True) if len(labels) else (labels, labels)
        self.code_of = {name: k for k, name in enumerate(names.tolist())}
        self.order = np.argsort(matrix, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(matrix, self.order, 0)

    def best(
        self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[float, float]], k: int
    ) -> list[list[tuple[int, int]]]:
        """Per window of scores (inclusive): the first k allowed rows as (id, score), best first.

        The second value of ``self.read`` is the depth at which the lists were left.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        scores = np.zeros(n, self.matrix.dtype)
        met = np.zeros(n, bool)
        read, step = 0, STEP
        while read < n:
            to = min(n, read + step)
            fresh = np.zeros(n, bool)
            fresh[self.order[n - to : n - read, up]] = True
            fresh[self.order[read:to, down]] = True
            fresh &= ~met
            rows = np.flatnonzero(fresh)
            scores[rows] = self.matrix[rows] @ anchor
            met |= fresh
            threshold = self.values[n - to, up] @ anchor[up] + self.values[to - 1, down] @ anchor[down]
            read, step = to, 2 * step
            if all(self._settled(scores, met & allowed, low, high, k, threshold) for low, high in windows):
                break
        if read == n:  # dimensions of zeros are in no list, so a row may have been met in none
            rows = np.flatnonzero(~met)
            scores[rows] = self.matrix[rows] @ anchor
            met[:] = True
        self.read = read
        out = []
        for low, high in windows:
            rows = np.flatnonzero(met & allowed & (scores >= low) & (scores <= high))
            if len(rows) > k:
                least = np.partition(scores[rows], len(rows) - k)[len(rows) - k]
                rows = rows[scores[rows] >= least]
            rows = rows[np.lexsort((self.ids[rows], -scores[rows]))[:k]]
            out.append([(int(self.ids[r]), int(scores[r])) for r in rows])
        return out

    @staticmethod
    def _settled(scores: np.ndarray, usable: np.ndarray, low: float, high: float, k: int, threshold: float) -> bool:
        if threshold < low or low > high:
            return True
        inside = scores[usable & (scores >= low) & (scores <= high)]
        return len(inside) >= k and threshold < np.partition(inside, len(inside) - k)[len(inside) - k]


def _matrix(column: pa.ListArray, dims: int, limit: int, kind: type) -> np.ndarray:
    """Integer vectors as rows of a matrix, ended by zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), dims), kind)
    out[np.arange(dims) < lengths[:, None]] = flat
    return np.clip(out, -limit, limit, out=out)


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _searched(units: DataFrame, keys: list[str], parts: int, dims: int, limit: int, kind: type, k: int, ask, schema: str) -> DataFrame:
    """Lists of every unit, and the answers to the anchors that came to it.

    ``units`` has the keys, ``turn`` (0 for rows, 1 for anchors), ``id``, ``label``, ``vector`` and
    ``positives`` (id and score); ``ask(lists, id, label, positives)`` gives the rows allowed,
    the windows and their names.
    """
    fields = [f.split(" ")[0] for f in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, lists = None, [], None
        for batch in batches:
            marks = list(zip(*(batch.column(n).to_pylist() for n in (*keys, "turn")), strict=True))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            labels = np.array(batch.column("label").to_pylist(), object)
            matrix = _matrix(batch.column("vector"), dims, limit, kind)
            positives = batch.column("positives").to_pylist()
            out: list[tuple] = []
            start = 0
            for end in range(1, len(marks) + 1):
                if end < len(marks) and marks[end] == marks[start]:
                    continue
                *key, turn = marks[start]
                if key != unit:
                    unit, held, lists = key, [], None
                if turn == 0:
                    held.append((ids[start:end], labels[start:end], matrix[start:end]))
                elif held or lists:
                    if lists is None:
                        lists = SortedLists(*(np.concatenate(part) for part in zip(*held, strict=True)))
                        held = []
                    for row in range(start, end):
                        allowed, windows, names = ask(lists, ids[row], labels[row], positives[row])
                        found = lists.best(matrix[row], allowed, windows, k) if windows else []
                        out += [(int(ids[row]), *name, *hit) for name, hits in zip(names, found, strict=True) for hit in hits]
                start = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], names=fields)

    ordered = units.repartition(parts, *keys).sortWithinPartitions(*keys, "turn", "id")
    return ordered.mapInArrow(work, schema)


def scaled(vector: Column, scale: int) -> Column:
    """Whole numbers below the scaled components, within an int; null if a component is null or not finite."""
    def whole(x: Column) -> Column:
        x = x.cast("double")
        value = F.floor(F.least(F.greatest(x * scale, F.lit(-float(_INT))), F.lit(float(_INT)))).cast("int")
        return F.when(F.abs(x) < float("inf"), value)  # NaN is larger than any number

    return F.when(~F.exists(F.transform(vector, whole), lambda x: x.isNull()), F.transform(vector, whole))


def _ranked(found: DataFrame, by: list[str], score: str, id: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(id))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, block: int = BLOCK
) -> DataFrame:
    """Per anchor, positive and ``rank``: the negative, with both scores, as ``anchor_id``,
    ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``rows`` has ``id`` (long), ``label``, ``vector`` and the boolean ``anchor``. A negative's score is
    from ``low`` to ``high`` hundredths of the positive's.
    """
    given = rows.select(
        F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"),
        scaled(F.col("vector"), scale).alias("vector"), F.coalesce("anchor", F.lit(False)).alias("anchor"),
    ).where("id is not null and label is not null and vector is not null")
    usable = stage(
        given.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("row")).select("id", "row.*"), "mine-rows"
    )
    bounds = measured(
        usable, n=F.count("*"), dims=F.coalesce(F.max(F.size("vector")), F.lit(0)),
        most=F.coalesce(F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("long"))))), F.lit(0)),
    )
    n, dims = bounds["n"], bounds["dims"]
    limit = min(_INT, math.isqrt(2**62 // (100 * max(1, dims))))
    most = min(bounds["most"], limit)
    kind = np.float64 if dims * most * most < 2**52 else np.int64  # exact either way

    blank = F.lit(None).cast("array<struct<id:bigint,score:bigint>>").alias("positives")
    anchors = usable.where("anchor")

    # same label
    large = stage(
        usable.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("slices")).where("slices > 1")
        .select(F.col("label").alias("of"), "slices"), "mine-slices",
    )
    size = measured(large, bytes=F.coalesce(F.sum(F.octet_length("of") + 32), F.lit(0)), parts=F.coalesce(F.sum("slices"), F.lit(0)))
    with_slices = lambda df: (
        df.join(broadcast_if(large, size["bytes"], BROADCAST_BYTES), F.col("label") == F.col("of"), "left")
        .withColumn("slices", F.coalesce("slices", F.lit(1)))
    )
    own = F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice")
    all_slices = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    fields = ("id", "label", "vector", blank)
    units = with_slices(usable).select("label", own, F.lit(0).alias("turn"), "id", "vector", blank).unionByName(
        with_slices(anchors).select("label", all_slices, F.lit(1).alias("turn"), "id", "vector", blank)
    )
    anywhere = [(-math.inf, math.inf)]

    def same_label(lists: SortedLists, id: int, label: str, _: None):
        return lists.ids != id, anywhere, [()]

    parts = max(1, size["parts"] + rows.sparkSession.sparkContext.defaultParallelism, -(-n // block))
    near = _searched(units, ["label", "slice"], parts, dims, limit, kind, positives, same_label, "anchor_id bigint, id bigint, score bigint")
    best = _ranked(near, ["anchor_id"], "score", "id", positives)
    chosen = best.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    asking = stage(
        anchors.join(chosen, F.col("id") == F.col("anchor_id")).select("id", "label", "vector", "positives"), "mine-anchors"
    )

    # other labels, within the windows
    blocks = max(1, -(-n // block))
    units = usable.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("turn"), *fields).unionByName(
        asking.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("turn"), "id", "label", "vector", "positives")
    )

    def other_label(lists: SortedLists, id: int, label: str, found: list[dict]):
        allowed = lists.codes != lists.code_of.get(label, -1)
        windows = [window_of(p["score"], low, high) for p in found]
        return allowed, windows, [(p["id"], p["score"]) for p in found]

    hard = _searched(
        units, ["block"], blocks, dims, limit, kind, negatives, other_label,
        "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint",
    )
    ranked = _ranked(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
