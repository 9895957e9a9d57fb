"""URL filters: explicit rules, then exact membership in a list of keys by a Bloom filter cascade.

The keys of a url are its host, every parent domain of the host, and host with path. A url is
blocked by the list if any of its keys is listed. The first filter of the cascade holds the
listed keys that occur; the second holds the keys of the corpus, not listed, that the first
lets through by mistake; the third the listed keys that the second holds by mistake, and so
on until no mistake is left. As the filters are built over every key of the corpus, walking
them decides every url of that corpus exactly, by a few hash look-ups in constants: no join.

A filter travels to the executors as a constant of at most ``MAX_BITS`` bits. A list that
needs a larger first filter is decided by an equi-join on the keys instead, with the same
result. Only built-in functions are used, for building and for judging.

Defined cases: a null url, or one without ``://``, has an empty host and path and no keys, and
is allowed unless a rule fits; listed keys that no url has, null keys and repeated keys make
no difference; other columns are not read; repeated urls are judged alike; an empty table
gives an empty result, an empty list allows what no rule blocks.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import INNER
from tessera.plans.staging import stage

ALLOW, BLOCK = "allow", "block"
MAX_BITS = 1 << 25
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path: from the end of the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (text, verdict) of the longest fitting rule, or null; of equally long ones a blocking
    one, then the first in alphabetical order."""
    chosen = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.verdict != BLOCK, r.text), reverse=True):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        chosen = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def keys_of(host: Column, path: Column) -> Column:
    """Array of a url's keys; empty for an empty host."""
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    return F.when(host != "", F.concat(domains, F.array(F.concat(host, path)))).otherwise(F.array().cast("array<string>"))


@dataclass
class Cascade:
    """Filters of alternating meaning: odd levels hold listed keys, even levels others."""

    levels: list[tuple[int, int, list[int]]] = field(default_factory=list)  # bits, hashes, words

    def held_by(self, level: int, key: Column) -> Column:
        bits, hashes, words = self.levels[level]
        # one foldable constant; an array of single literals would be slow to analyse
        table = F.from_json(F.lit(json.dumps(words)), "array<bigint>")
        found = F.lit(True)
        for place in positions(key, level, bits, hashes):
            found = found & (F.getbit(F.get(table, F.floor(place / 64).cast("int")), (place % 64).cast("int")) == 1)
        return found

    def contains(self, key: Column) -> Column:
        """Whether a key of the corpus is listed."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            verdict = F.when(~self.held_by(level, key), F.lit(level % 2 == 1)).otherwise(verdict)
        return verdict


def positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(k)), F.lit(bits)) for k in range(hashes)]


def _filter(keys: DataFrame, level: int, bits: int, hashes: int) -> list[int]:
    """Words of 64 bits with the positions of all keys set; combined before the shuffle, so it moves
    no more words than the filter has, times the tasks."""
    places = keys.select(F.explode(F.array(*positions(F.col("key"), level, bits, hashes))).alias("place"))
    word = F.floor(F.col("place") / 64).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("place") % 64).cast("int"))
    rows = places.groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits")).collect()
    words = [0] * -(-bits // 64)
    for row in rows:
        words[row["word"]] = row["bits"]
    return words


def build_cascade(universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade | None:
    """Cascade over a staged table of distinct ``key`` with a flag ``listed``; None if its first
    filter would need more than ``max_bits`` bits."""
    sizes = universe.agg(F.count("*").alias("n"), F.count_if("listed").alias("listed")).first()
    inside, outside = sizes["listed"], sizes["n"] - sizes["listed"]
    cascade = Cascade()
    if not inside:
        return cascade
    rate = min(0.5, max(inside / max(outside, 1) * math.sqrt(0.5), 1e-6))
    hashes = math.ceil(math.log2(1 / rate))
    current, other, size = universe.where("listed").select("key"), universe.where(~F.col("listed")).select("key"), inside
    while size:
        bits = max(64, math.ceil(size * hashes / math.log(2)))
        if bits > max_bits:
            return None
        level = len(cascade.levels)
        cascade.levels.append((bits, hashes, _filter(current, level, bits, hashes)))
        mistakes = stage(other.where(cascade.held_by(level, F.col("key"))), "cascade-level")
        current, other, size, hashes = mistakes, current, mistakes.count(), 1
    return cascade


def judge(
    pages: DataFrame, rules: list[Rule], listed: DataFrame, id: str = "page_id", url: str = "url", max_bits: int = MAX_BITS
) -> DataFrame:
    """Per page: id, ``host``, ``path``, ``rule`` (null if none fits), ``listed`` and ``verdict``.

    ``listed`` has a column ``key``. The rules' verdict goes before the list's.
    """
    base = pages.select(F.col(id), F.col(url).alias(INNER + "url")).select(
        id, host_of(F.col(INNER + "url")).alias("host"), path_of(F.col(INNER + "url")).alias("path")
    )
    keys = keys_of(F.col("host"), F.col("path"))
    known = base.select(F.explode(keys).alias("key")).distinct()
    marks = listed.select(F.col("key").alias("listed_key")).where("listed_key IS NOT NULL").distinct()
    universe = stage(
        known.join(marks, known["key"] == marks["listed_key"], "left").select("key", F.isnotnull("listed_key").alias("listed")), "url-keys"
    )
    cascade = build_cascade(universe, max_bits)
    if cascade is not None:
        member = F.exists(keys, cascade.contains) if cascade.levels else F.lit(False)
        judged = base.withColumn("listed", member)
    else:
        blocked = universe.where("listed").select(F.col("key").alias("blocked_key"))
        hit = base.select(F.struct("host", "path").alias("of"), F.explode(keys).alias("key")).join(
            blocked, F.col("key") == F.col("blocked_key"), "left_semi"
        ).select("of").distinct()
        judged = base.join(hit, F.struct("host", "path") == F.col("of"), "left").withColumn("listed", F.isnotnull("of")).drop("of")
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    return judged.select(
        id, "host", "path", rule["text"].alias("rule"), "listed",
        F.coalesce(rule["verdict"], F.when(F.col("listed"), BLOCK).otherwise(ALLOW)).alias("verdict"),
    )
