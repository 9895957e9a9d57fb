"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping probes. A region of a document within ``e`` edits of
a probe of ``n`` characters shares at least ``n + 1 - q (e + 1)`` of its q-grams, on diagonals
that differ by ``e`` at most. An item's q-grams are indexed once; those that a text shares are
counted per item in overlapping diagonal bands, a window of a probe's width slides over a
band's positions in the item, probes that meet the bound in it are retained, and each retained
region is verified by alignment over the band. A document leaks an item when a region of it is
within the edit budget of a probe.

Texts are compared lower-cased with every run of other characters than letters and digits as
one space. Many texts, or pieces of a long one, are searched side by side; a stretch whose q-grams
repeat is halved until its shared q-grams are at most ``ENTRIES``, so that memory does not grow with
repetition. The index goes to the executors in chunks of at most ``CHUNK_CHARS`` benchmark characters (about a hundred
bytes a character at most); a larger benchmark takes several chunks, each over all documents. Documents are never shuffled.

Defined cases: null and empty texts leak nothing and null or empty items are not looked for;
an item shorter than ``Q`` characters is looked up as whole words, without edits; repeated items and
documents are judged one by one; other columns are carried along; empty tables give what they
should: no leaks, all documents kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a q-gram at most; short probes have shorter ones, so that the bound is the lemma's.
Q = 8
#: An excerpt of PROBE + STRIDE - 1 characters holds a whole probe at any offset.
PROBE, STRIDE = 60, 10
#: Edits allowed per character of a probe: one replaced word of six letters in a whole probe.
EDIT_RATE = 0.1
CHUNK_CHARS = 1_000_000
#: Characters of texts searched side by side, and those between two texts or shared by two pieces of one.
SLICE, GAP = 200_000, 128
#: Shared q-grams counted in one go.
ENTRIES = 1_000_000
#: Bands whose regions are verified as one.
MERGED = 3
#: Bit masks (one a region and sign) of regions verified side by side.
MASKS = 1_000_000
_FILTER_BITS = 20
_OTHER = re.compile(r"[\W_]+")


#: ASCII letters and digits as they are, every other byte a space.
_PLAIN = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def normal(text: str | None) -> str:
    low = (text or "").lower()
    if low.isascii():  # the same, without the pattern
        return b" ".join(low.encode().translate(_PLAIN).split()).decode()
    return _OTHER.sub(" ", low).strip()


def _rolled(points: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hash of every window of ``q`` values, from windows of half the width."""
    if q == 1:
        return points
    half = q // 2
    part = _rolled(points, half)
    base = np.uint64(pow(0x9E3779B97F4A7C15, half, 1 << 64))
    both = part[:-half] * base + part[half:]
    return both if q % 2 == 0 else both[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[q - 1 :]


def grams(text: str, q: int = Q) -> np.ndarray:
    """A 64-bit hash of every q-gram of code points."""
    return _hashed(_points(text), q)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashed(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram of code points."""
    if len(points) < q:
        return np.empty(0, np.uint64)
    out = _rolled(points.astype(np.uint64), q)
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Words:
    """Items too short for probes, by their number of words."""

    numbers: dict[int, dict[str, list[int]]]

    def met(self, text: str) -> list[int]:
        words = text.split(" ")
        out: list[int] = []
        for count, items in self.numbers.items():
            for part in {" ".join(words[k : k + count]) for k in range(len(words) - count + 1)} & items.keys():
                out += items[part]
        return out


@dataclass
class Probes:
    """Items of one ``q`` end to end, with the probe length, band step and bound of each, and their
    q-grams sorted by hash, item and place."""

    q: int
    numbers: np.ndarray
    lengths: np.ndarray
    sizes: np.ndarray
    steps: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray
    alphabet: np.ndarray
    signs: np.ndarray
    hashes: np.ndarray
    owners: np.ndarray
    places: np.ndarray
    present: np.ndarray

    @staticmethod
    def of(items: list[str]) -> list[Probes | Words]:
        """The probes of all items, by their q; items without probes come last."""
        by_q: dict[int, list[tuple[int, str]]] = {}
        short: dict[int, dict[str, list[int]]] = {}
        for number, text in enumerate(map(normal, items)):
            if len(text) >= Q:
                by_q.setdefault(gram_length(min(len(text), PROBE)), []).append((number, text))
            elif text:
                short.setdefault(text.count(" ") + 1, {}).setdefault(text, []).append(number)
        found: list[Probes | Words] = [Probes._of(q, own) for q, own in sorted(by_q.items())]
        return [*found, Words(short)] if short else found

    @staticmethod
    def _of(q: int, items: list[tuple[int, str]]) -> Probes:
        points = [_points(text) for _, text in items]
        lengths = np.array([len(p) for p in points])
        sizes = np.minimum(lengths, PROBE)
        each = [_hashed(p, q) for p in points]
        hashes = np.concatenate(each)
        order = np.argsort(hashes, kind="stable")
        owners = np.repeat(np.arange(len(items)), [len(g) for g in each])[order]
        places = np.concatenate([np.arange(len(g)) for g in each])[order]
        hashes = hashes[order]
        present = np.zeros(1 << _FILTER_BITS, bool)
        present[hashes >> np.uint64(64 - _FILTER_BITS)] = True
        alphabet = np.unique(np.concatenate(points))
        return Probes(
            q, np.array([n for n, _ in items]), lengths, sizes, np.array([budget(n) + 1 for n in sizes.tolist()]),
            np.array([bound(n) for n in sizes.tolist()]), np.append(0, np.cumsum(lengths))[:-1], alphabet,
            np.searchsorted(alphabet, np.concatenate(points)) + 1, hashes, owners, places, present,
        )

    def coded(self, points: np.ndarray) -> np.ndarray:
        """Code points as their place in the items' alphabet, from 1; 0 for others."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, 0)


def budget(length: int) -> int:
    return int(EDIT_RATE * length)


def gram_length(length: int) -> int:
    """The longest q up to ``Q`` of which a region within the budget shares at least one q-gram."""
    return max(1, min(Q, length // (budget(length) + 1)))


def bound(length: int) -> int:
    """Shared q-grams of a region within the budget."""
    return length + 1 - gram_length(length) * (budget(length) + 1)


def within(probe: str, region: str, edits: int) -> bool:
    """Whether some part of the region is within ``edits`` of the probe: alignment with free ends in
    the region, a column of differences being the bits of two integers (Myers)."""
    if len(probe) <= edits or probe in region:
        return True
    if edits == 0:
        return False
    places: dict[str, int] = {}
    for i, sign in enumerate(probe):
        places[sign] = places.get(sign, 0) | 1 << i
    full, top = (1 << len(probe)) - 1, 1 << len(probe) - 1
    more, less, score = full, 0, len(probe)
    for sign in region:
        same = places.get(sign, 0)
        down = same | less
        across = (((same & more) + more) ^ more) | same
        up = less | (full & ~(across | more))
        fall = more & across
        if up & top:
            score += 1
        elif fall & top:
            score -= 1
            if score <= edits:
                return True
        up = up << 1 & full
        more = (fall << 1 & full) | (full & ~(down | up))
        less = up & down
    return False


def _all_within(patterns: np.ndarray, sizes: np.ndarray, regions: np.ndarray, most: np.ndarray, signs: int) -> np.ndarray:
    """``within`` of many probes of at most 64 signs, side by side. Signs are numbers from 1 up to
    ``signs``; 0 matches nothing."""
    n, one = len(patterns), np.uint64(1)
    base = np.arange(n) * (signs + 1)
    masks = np.zeros(n * (signs + 1), np.uint64)
    for k in range(patterns.shape[1]):
        masks[base + patterns[:, k]] |= one << np.uint64(k)
    masks[base] = 0
    top = one << (sizes.astype(np.uint64) - one)
    full = top | (top - one)
    more, less, score = full.copy(), np.zeros(n, np.uint64), sizes.astype(np.int64)
    found = score <= most
    for column in np.ascontiguousarray(regions.T):
        same = masks[base + column]
        down = same | less
        across = (((same & more) + more) ^ more) | same
        up = less | (full & ~(across | more))
        fall = more & across
        score += ((up & top) != 0).astype(np.int64) - ((fall & top) != 0)
        found |= score <= most
        up = up << one & full
        more = (fall << one & full) | (full & ~(down | up))
        less = up & down
    return found


def all_within(probes: list[str], regions: list[str], edits: list[int]) -> np.ndarray:
    """``within`` of many probes of at most 64 characters."""
    alphabet = np.unique(_points("".join(probes)))
    coded = lambda texts, width: np.array([
        np.pad(np.where(np.isin(p := _points(t), alphabet), np.searchsorted(alphabet, p) + 1, 0), (0, width - len(p))) for t in texts
    ])
    patterns = coded(probes, max(map(len, probes)))
    return _all_within(patterns, np.array([len(p) for p in probes]), coded(regions, max(1, *map(len, regions))), np.array(edits), len(alphabet))


def leaked_items(text: str | None, groups: list[Probes | Words]) -> list[int]:
    """Numbers of the items that the text leaks, ascending."""
    return leaked_rows([text], groups)[0]


def leaked_rows(texts: Iterable[str | None], groups: list[Probes | Words]) -> list[list[int]]:
    """``leaked_items`` of every text, about ``SLICE`` characters side by side."""
    leaks: list[set[int]] = []
    pieces: list[str] = []
    rows: list[int] = []
    size = 0

    def search() -> None:
        nonlocal size
        starts = np.append(0, np.cumsum([len(p) + GAP for p in pieces]))[:-1]
        points = _points(("\x00" * GAP).join(pieces))
        for probes in groups:
            if isinstance(probes, Probes):
                for at, item in _found(points, probes):
                    # a region lies within the gap's width of its text
                    leaks[rows[int(np.searchsorted(starts - GAP // 2, at, "right")) - 1]].add(item)
        pieces.clear()
        rows.clear()
        size = 0

    for row, text in enumerate(texts):
        text = normal(text)
        leaks.append({n for short in groups if isinstance(short, Words) for n in short.met(text)})
        for start in range(0, len(text), SLICE):  # a region lies in one piece, as pieces overlap
            pieces.append(text[start : start + SLICE + GAP])
            rows.append(row)
            size += len(pieces[-1]) + GAP
            if size >= SLICE:
                search()
    if pieces:
        search()
    return [sorted(own) for own in leaks]


def _entries(points: np.ndarray, probes: Probes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of the points: offset, and the positions, index rows and their numbers of all shared q-grams."""
    todo = [(0, len(points))]
    while todo:
        start, end = todo.pop()
        found = _hashed(points[start:end], probes.q)
        at = np.flatnonzero(probes.present[found >> np.uint64(64 - _FILTER_BITS)])
        low = np.searchsorted(probes.hashes, found[at], "left")
        shared = probes.hashes[np.minimum(low, len(probes.hashes) - 1)] == found[at]
        at, low = at[shared], low[shared]
        many = np.searchsorted(probes.hashes, found[at], "right") - low
        if many.sum() > ENTRIES and end - start > 4 * GAP:
            middle = (start + end) // 2
            todo += [(middle, end), (start, middle + GAP)]
            continue
        if len(at):
            yield start, at, low, many


def _candidates(at: np.ndarray, low: np.ndarray, many: np.ndarray, probes: Probes) -> tuple[np.ndarray, ...]:
    """Owner, probe start, first and last diagonal and a shared position of every retained region."""
    entry = np.repeat(low - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
    owner, place = probes.owners[entry], probes.places[entry]
    band = (np.repeat(at, many) - place) // probes.steps[owner]
    # every diagonal lies in two bands of twice the step, so any run of `step` lies in one
    low_band, width = int(band.min()) - 1, int(band.max() - band.min()) + 2
    cell = owner * width + (band - low_band)
    cells, places = np.concatenate((cell, cell - 1)), np.concatenate((place, place))
    bounds = np.concatenate((probes.bounds[owner],) * 2)
    spread = cells & 0xFFFFF  # cells that share a count have too large a one, never too small
    enough = np.bincount(spread)[spread] >= bounds
    reach = int(probes.lengths.max())
    keys = np.unique(cells[enough] * reach + places[enough])  # an item's q-gram counts once in a band
    cells, places = keys // reach, keys % reach
    owner = cells // width
    far = np.arange(len(keys)) + probes.bounds[owner] - 1
    span = probes.sizes[owner] - probes.q
    inside = far < len(keys)
    inside[inside] = (cells[far[inside]] == cells[inside]) & (places[far[inside]] - places[inside] <= span[inside])
    cells, first, last, owner, span = cells[inside], places[inside], places[far[inside]], owner[inside], span[inside]
    # probes that hold both ends: those of the grid, and the item's last
    end = probes.lengths[owner] - probes.sizes[owner]
    least, most = np.maximum(0, last - span), np.minimum(first, end)
    on_grid = np.maximum(0, most // STRIDE - -(-least // STRIDE) + 1)
    grid = np.repeat(-(-least // STRIDE) - np.append(0, np.cumsum(on_grid))[:-1], on_grid) + np.arange(on_grid.sum())
    ends = np.flatnonzero(most == end)
    which = np.concatenate((np.repeat(np.arange(len(cells)), on_grid), ends))
    start = np.concatenate((grid * STRIDE, end[ends]))
    band = cells[which] % width
    merged, where = np.unique((owner[which] * reach + start) * (width // MERGED + 1) + band // MERGED, return_inverse=True)
    lowest, highest = np.full(len(merged), width), np.zeros(len(merged), int)
    np.minimum.at(lowest, where, band)
    np.maximum.at(highest, where, band)
    owner, start = np.divmod(merged // (width // MERGED + 1), reach)
    step = probes.steps[owner]
    first, last = (lowest + low_band) * step, (highest + low_band + 2) * step - 1
    return owner, start, first, last


def _found(points: np.ndarray, probes: Probes) -> Iterator[tuple[int, int]]:
    """Position and item number of every verified region."""
    coded: np.ndarray | None = None
    for offset, at, low, many in _entries(points, probes):
        owner, start, first, last = _candidates(at, low, many, probes)
        if len(owner) and coded is None:
            coded = np.append(probes.coded(points), 0)
        edits, size = probes.steps[owner] - 1, probes.sizes[owner]
        left, right = offset + first + start - edits, offset + last + start + size + edits
        together = max(64, MASKS // (len(probes.alphabet) + 1))
        for k in range(0, len(owner), together):
            part = slice(k, k + together)
            places = left[part, None] + np.arange(int((right[part] - left[part]).max()))
            outside = (places < 0) | (places >= np.minimum(right[part], len(points))[:, None])
            regions = coded[np.where(outside, len(points), places)]
            columns = np.arange(int(size[part].max()))
            signs = (probes.offsets[owner[part]] + start[part])[:, None] + columns
            inside = columns < size[part, None]
            patterns = np.where(inside, probes.signs[np.where(inside, signs, 0)], 0)
            good = np.flatnonzero(_all_within(patterns, size[part], regions, edits[part], len(probes.alphabet)))
            middle = (left[part] + right[part]) // 2
            yield from zip(middle[good].tolist(), probes.numbers[owner[part]][good].tolist(), strict=True)


def _chunks(benchmark: DataFrame, item: str, text: str) -> Iterator[tuple[list, Broadcast]]:
    """Item ids and broadcast probes of at most about ``CHUNK_CHARS`` benchmark characters each."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where(F.length("text") > 0)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // CHUNK_CHARS) or 1
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).orderBy("item", "text").collect()
        yield [r["item"] for r in own], spark.sparkContext.broadcast(Probes.of([r["text"] for r in own]))


def _numbers(probes: Broadcast, text: Column) -> Column:
    @F.pandas_udf("array<int>")
    def numbers(texts: pd.Series) -> pd.Series:
        return pd.Series(leaked_rows(texts, probes.value))

    return numbers(text)


def leaks(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row (document id, item id) for every item that a document leaks."""
    result = None
    for ids, probes in _chunks(benchmark, item, item_text):
        found = docs.select(docs[id].alias("doc"), F.explode(_numbers(probes, docs[text])).alias("number"))
        kind = benchmark.schema[item].dataType.simpleString()
        names = F.lit([str(i) for i in ids] or [""])
        found = found.select(F.col("doc").alias(id), F.get(names, F.col("number")).cast(kind).alias(item))
        result = found if result is None else result.union(found)
    return result


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The documents that leak no item, with their own columns."""
    kept = docs
    for _, probes in _chunks(benchmark, item, item_text):
        kept = kept.where(F.size(_numbers(probes, kept[text])) == 0)
    return kept
