"""Token ids in files: canonical, length-limited Huffman codes in independent blocks.

Writing takes four Spark jobs: texts are encoded once and staged; ids are counted per task and
summed to one row per id; the staged ids are range-partitioned and sorted by document id; and
every partition writes blocks of whole documents. The format is a folder with two Parquet
tables, so that writing commits atomically and survives lost executors on any file system:

``codes``   one row per used id: ``token``, ``length`` (code lengths define canonical codes);
``blocks``  one row per block: ``part`` and ``block`` in order of the documents, ``before`` (ids of
            the part before the block), ``documents`` and ``sizes`` (ids of each), ``payload`` (the
            codes, most significant bit first), ``checkpoints`` (bit offset of every 128th id).

A block is decoded on its own by table look-up; its checkpoints are decoded side by side as
lanes of one array. A block has at least ``BLOCK_IDS`` ids except at the end of a part; a longer
document makes a longer block of its own.

Defined cases: a null or empty text has the end id alone; a null document id sorts before
every other, equal ids are ordered by their contents; other columns are not read; an empty
table gives files without blocks, which read back as an empty table.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import string
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.staging import checkpoint_dir

BLOCK_IDS = 65_536
STEP = 128
#: Longest code; longer only if the vocabulary in use needs it.
MAX_LENGTH = 18
END_ID = 1
#: Words in a worker's memo, and in the one before it.
CACHE = 350_000


def _byte_signs() -> dict[int, int]:
    """The byte alphabet of such files: bytes with a printable sign keep it, the others follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(others)}


_BYTE_SIGNS = _byte_signs()
#: Signs that are neither letters nor numbers, without the one that contractions begin with.
_SIGNS = "".join(sign for sign in string.punctuation if sign != "'")
#: Letters that composing leaves as they are and that have one small letter, the same in every version of the tables.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+")


class WordEncoder:
    """Ids of texts by the ``tokenizers`` library, word by word with a memo.

    Only for tokenizers that treat white space as a separator and nothing else (as the normaliser
    and the splitting pattern of the file say): then a text's ids are those of its words in order.
    """

    def __init__(self, path: str, kind: str = "<u4"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as file:
            rules = json.load(file)
        self.folds = '"Lowercase"' in json.dumps(rules["normalizer"])
        # the pattern has letters, and signs that are neither letters nor numbers, in parts of their own; then bytes become signs
        text = json.dumps(rules["pre_tokenizer"]).replace("\\\\", "\\")
        self.apart = r"[\p{L}]+" in text and r"[^\s\p{L}\p{N}]+" in text and '"ByteLevel"' in text
        steps = rules["normalizer"] or {"type": "Sequence", "normalizers": []}
        #: Whether composing, joining white space and lower-casing are all that the normaliser does.
        self.composed = all(
            step["type"] in ("NFC", "Lowercase") or (step["type"] == "Replace" and step["pattern"] == {"Regex": r"\s+"})
            for step in steps.get("normalizers", [steps])
        )
        self.normalizer, self.splitter, self.model = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer, self.tokenizer.model
        #: Texts of tokens that are cut out before anything else.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.sign = {"<u2": "H", "<u4": "I"}[kind]
        self.memo = _Memo(self._learn)
        self.older: dict[str, bytes] = {}

    def _learn(self, word: str) -> bytes:
        """Ids of a word not in the memo: the library's steps one by one, without its per-call cost.

        Signs after letters are a piece of their own, and letters are one piece, unless the
        normaliser makes more than letters of them.
        """
        if word in self.older:
            return self.older[word]
        if self.apart:
            stem = word.rstrip(_SIGNS)
            other = not (stem.isascii() or (self.composed and _LATIN.fullmatch(stem)))
            folded = self._folded(stem) if other else stem.lower() if self.folds else stem
            if stem.isalpha() and folded.isalpha():
                if len(stem) < len(word):
                    return self.memo[stem if other else folded] + self.memo[word[len(stem) :]]
                if folded != word and not other:
                    return self.memo[folded]
                signs = folded if folded.isascii() else folded.encode().decode("latin-1").translate(_BYTE_SIGNS)
                return self._packed(self.model.tokenize(signs))
        if any(content in word for content in self.added) or not self.normalizer or not self.splitter:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}{self.sign}", *ids)
        pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(word))
        return self._packed([t for piece, _ in pieces for t in self.model.tokenize(piece)])

    def _packed(self, tokens: list) -> bytes:
        return struct.pack(f"<{len(tokens)}{self.sign}", *[t.id for t in tokens])

    def _folded(self, stem: str) -> str:
        return self.normalizer.normalize_str(stem) if self.normalizer else stem

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned ids of every text."""
        if len(self.memo) > CACHE:  # words in use move on to the new memo, the others are forgotten
            self.memo, self.older = _Memo(self._learn), self.memo
        known = self.memo.__getitem__
        return [b"".join(map(known, (t or "").replace("\n", " ").split(" "))) for t in texts]


class _Memo(dict):
    """Ids by word; a word looked up for the first time is learnt."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.learn(word)
        return ids


_encoders: dict[tuple[str, str], WordEncoder] = {}


def _encoder(path: str, kind: str) -> WordEncoder:
    if (path, kind) not in _encoders:
        _encoders[path, kind] = WordEncoder(path, kind)
    return _encoders[path, kind]


def id_kind(tokenizer: str) -> str:
    """The narrower numpy type that holds every id of a tokenizer file: two or four bytes."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def token_ids(
    docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID, id_type: str = "<u4"
) -> DataFrame:
    """Columns ``id`` and ``ids`` (binary, of the numpy type ``id_type``; the end id last)."""
    given = docs.select(docs[id].alias("id"), docs[text].alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    last = np.array([end_id], id_type).tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x + last for x in _encoder(tokenizer, id_type).encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], names=["id", "ids"])

    return given.mapInArrow(work, f"id {kind}, ids binary")


def token_counts(tokens: DataFrame, ids: str = "ids", id_type: str = "<u4") -> DataFrame:
    """Columns ``token``, ``n``: counted within tasks, then summed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for value in batch.column(0):
                own = np.bincount(np.frombuffer(value.as_buffer(), id_type))
                if len(own) > len(total):
                    own[: len(total)] += total
                    total = own
                else:
                    total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["token", "n"])

    return tokens.select(ids).mapInArrow(work, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def code_lengths(counts: list[int], longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of an optimal prefix code with no code longer than ``longest``, by package-merge.

    ``longest`` is raised where the number of symbols needs it. One symbol alone gets one bit.
    """
    n = len(counts)
    if n <= 1:
        return [1] * n
    longest = max(longest, (n - 1).bit_length())
    order = sorted(range(n), key=counts.__getitem__)
    weights = [counts[k] for k in order]
    # a package remembers how many of the cheapest symbols it holds on each level below
    levels: list[list[bool]] = []
    packages: list[int] = []
    for _ in range(longest):
        merged = list(heapq.merge(((w, True) for w in weights), ((w, False) for w in packages), key=lambda x: x[0]))
        levels.append([own for _, own in merged])
        packages = [merged[k][0] + merged[k + 1][0] for k in range(0, len(merged) - 1, 2)]
    lengths = [0] * n
    take = 2 * n - 2
    for level in reversed(levels):
        singles = sum(level[:take])
        for k in range(singles):
            lengths[order[k]] += 1
        take = 2 * (take - singles)
    return lengths


class Codebook:
    """Canonical codes from (token, length): shorter first, then by token."""

    def __init__(self, lengths: dict[int, int]):
        self.longest = max(lengths.values(), default=1)
        size = max(lengths, default=0) + 1
        self.codes, self.lengths = np.zeros(size, np.uint32), np.zeros(size, np.uint8)
        self.table = np.zeros(1 << self.longest, np.uint32)
        self.table_lengths = np.ones(1 << self.longest, np.uint8)
        tokens = np.fromiter(lengths.keys(), np.int64, len(lengths))
        sizes = np.fromiter(lengths.values(), np.int64, len(lengths))
        order = np.lexsort((tokens, sizes))
        tokens, sizes = tokens[order], sizes[order]
        spans = 1 << (self.longest - sizes)
        ends = np.cumsum(spans)
        self.codes[tokens], self.lengths[tokens] = (ends - spans) >> (self.longest - sizes), sizes
        used = int(spans.sum())
        self.table[:used], self.table_lengths[:used] = np.repeat(tokens, spans), np.repeat(sizes, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Payload and the bit offset of every ``STEP``-th id."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        lengths = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        # each code in the two 32-bit words from the one it starts in; codes of a word share no bit, so they add up
        shift = (64 - (starts & 31) - lengths).astype(np.uint64)
        wide, word = self.codes[ids].astype(np.uint64) << shift, starts >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        sums, at = np.add.reduceat(wide, first), word[first]
        words = np.zeros(int(word[-1]) + 2, np.uint64)
        words[at] += sums >> np.uint64(32)
        words[at + 1] += sums & np.uint64(0xFFFFFFFF)
        return words.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], starts[::STEP]

    def decode(self, payload: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a block; all checkpoints advance together."""
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        wide = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        out = np.empty((len(offsets), STEP), np.uint32)
        at, end = offsets.astype(np.int64), len(wide) * 8 - 8
        shift = np.uint32(32 - self.longest)
        for k in range(STEP):
            key = (wide[at >> 3] << (at & 7).astype(np.uint32)) >> shift
            out[:, k] = self.table[key]
            at = np.minimum(at + self.table_lengths[key], end)  # the last lane runs past its ids
        return out.reshape(-1)[:n]


def write_tokens(tokens: DataFrame, path: str, id_type: str = "<u4") -> None:
    """Write ``token_ids`` in ascending order of ``id`` to the folder ``path``."""
    width = np.dtype(id_type).itemsize
    spark = tokens.sparkSession
    staged = f"{path}/staged-{uuid.uuid4().hex}"
    tokens.write.option("compression", "zstd").parquet(staged)
    tokens = spark.read.schema(tokens.schema).parquet(staged)
    counted = token_counts(tokens, "ids", id_type).collect()  # at most a row for each id of the vocabulary
    lengths = code_lengths([r["n"] for r in counted])
    codes = spark.createDataFrame([(r["token"], k) for r, k in zip(counted, lengths, strict=True)], "token bigint, length int")
    codes.coalesce(1).write.parquet(f"{path}/codes")
    book = spark.sparkContext.broadcast({r["token"]: k for r, k in zip(counted, lengths, strict=True)})
    kind = tokens.schema["id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebook, part = Codebook(book.value), TaskContext.get().partitionId()
        names, held, waiting, before, block = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            payload, offsets = codebook.encode(np.frombuffer(b"".join(held), id_type))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                    pa.array([names], pa.list_(name_type)), pa.array([[len(x) // width for x in held]], pa.list_(pa.int32())),
                    pa.array([payload], pa.binary()), pa.array([offsets], pa.list_(pa.int64())),
                ],
                names=["part", "block", "before", "documents", "sizes", "payload", "checkpoints"],
            )

        for batch in batches:
            name_type = batch.schema.field("id").type
            for name, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                names.append(name)
                held.append(ids)
                waiting += len(ids) // width
                if waiting >= BLOCK_IDS:
                    yield flush()
                    names, held, waiting, before, block = [], [], 0, before + waiting, block + 1
        if held:
            yield flush()

    ordered = tokens.repartitionByRange("id").sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("ids"))
    schema = (
        f"part int, block int, before bigint, documents array<{kind.simpleString()}>, sizes array<int>, "
        "payload binary, checkpoints array<bigint>"
    )
    ordered.select("id", "ids").mapInArrow(work, schema).write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the folder: ``id``, ``start`` (ids of all documents before it) and ``ids``."""
    blocks = spark.read.parquet(f"{path}/blocks")
    lengths = {r["token"]: r["length"] for r in spark.read.parquet(f"{path}/codes").collect()}
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = blocks.groupBy("part").agg(F.sum(total).alias("n")).orderBy("part").collect()  # one row a range partition
    bases, at = {}, 0
    for row in parts:
        bases[row["part"]] = at
        at += row["n"]
    book = spark.sparkContext.broadcast(lengths)
    kind = blocks.schema["documents"].dataType.elementType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebook = None
        for batch in batches:
            codebook = codebook or Codebook(book.value)
            for k in range(batch.num_rows):
                sizes = np.array(batch.column("sizes")[k].as_py(), np.int64)
                ids = codebook.decode(
                    batch.column("payload")[k].as_py(), batch.column("checkpoints")[k].values.to_numpy(), int(sizes.sum())
                ).astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - sizes + batch.column("before")[k].as_py() + bases[batch.column("part")[k].as_py()]
                cut = [ids[a - n : a].tobytes() for a, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("documents")[k].values, pa.array(starts), pa.array(cut, pa.binary())], names=["id", "start", "ids"]
                )

    wanted = blocks.select("part", "before", "documents", "sizes", "payload", "checkpoints")
    return wanted.mapInArrow(work, f"id {kind}, start bigint, ids binary")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of this application in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def digest(tokens: DataFrame, id: str = "doc_id") -> DataFrame:
    """Per document: id, ``start``, ``n_tokens`` and ``ids_crc32``."""
    return tokens.select(
        F.col("id").alias(id), "start",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
    )
