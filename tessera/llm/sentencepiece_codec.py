"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The encoder reads characters one by one and keeps one backpointer per position: the last
piece of the best segmentation of the text up to there. A later piece can start no further
back than the longest piece is long, so only the paths through that window survive; whenever
they all pass one boundary, the ids up to it are committed and forgotten. Memory is bounded
by the longest piece, not by the text, except where paths never meet, which no vocabulary
with single characters brings about for long.

For a unigram model the best segmentation has the largest sum of scores. For a BPE model it
is the one that merging gives: a sequence of pieces is that one exactly if every two
neighbours, merged on their own, stay as they are, so each position has one valid last
piece. Both give the ids of the ``sentencepiece`` library. Where no piece crosses a word
start, all paths meet there, so words are memoised
(``CACHE`` words a worker); so are their parts where no piece holds two characters side by side.

Characters outside the vocabulary become byte pieces, or the unknown id if the model has
none. Defined cases: a null or empty text has no ids; other columns are carried along or not
read; decoding gives back the text as the model normalises it (for an identity normaliser the
text itself, but that the sign U+2581 becomes a space); repeated rows are encoded alike; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words in a worker's memo, and in the one before it.
CACHE = 400_000
_LONGEST_MEMO = 40
#: The code before any piece, and a factor over all codes.
START = 1 << 22
WIDE = 1 << 23


class Model:
    """Pieces of a model file and the two ways to weigh them."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            content = file.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=content)
        sp, n = self.library, self.library.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {piece: sp.get_score(i) for piece, i in self.ids.items()}
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.score_of = [sp.get_score(i) for i in range(n)]
        # nodes are (children by character, id of the piece that ends here or -1)
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for sign in piece[:-1]:
                node = node.setdefault(sign, [{}, -1])[0]
            node.setdefault(piece[-1], [{}, -1])[1] = i
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.longest = max(map(len, self.ids))
        self.bpe = _model_type(content) == 2
        self.unknown = sp.unk_id()
        floor = min(self.scores.values(), default=0.0)
        self.unknown_score = floor - 10.0
        long = [p for p in self.ids if len(p) > 1]
        self.crosses = any(SPACE in p.lstrip(SPACE) for p in long)
        joined = set("".join(long))
        solo = re.escape("".join(c for c in "\n\t" if c not in joined))
        self.segment = re.compile(f"{SPACE}+[^{SPACE}{solo}]*|[{solo}]|[^{SPACE}{solo}]+" if solo else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.pairs = {p[k : k + 2] for p in long for k in range(len(p) - 1)}
        self.valid: dict[int, bool] = {}
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self.surface = self._surfaces(n)

    def _surfaces(self, n: int) -> list[bytes]:
        sp, values = self.library, {i: b for b, i in self.bytes.items()}
        return [
            bytes([values[i]]) if i in values else b"" if sp.is_control(i) else
            " ⁇ ".encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace(SPACE, " ").encode()
            for i in range(n)
        ]

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: merge the neighbours of the best score, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def text_of(self, code: int) -> str:
        """The text of a code: an id, or beyond the ids a character that is no piece; empty for `START`."""
        n = len(self.names)
        return "" if code == START else self.names[code] if code < n else chr(code - n)

    def neighbours(self, left: int, right: int) -> bool:
        """Whether two codes, merged on their own, stay as they are; after `START`, whether one does."""
        if len(self.valid) > 4 * CACHE:
            self.valid.clear()
        parts = [self.text_of(code) for code in (left, right)]
        fits = self.valid[left * WIDE + right] = self.merged("".join(parts)) == [x for x in parts if x]
        return fits

    def ids_of(self, codes: Iterable[int]) -> list[int]:
        """Ids of codes: a character that is no piece has its bytes' ids, or the unknown id."""
        n, out = len(self.names), []
        for code in codes:
            if code < n:
                out.append(code)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(code - n).encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as native 32-bit integers."""
        normal = self.library.normalize(text or "")
        if self.crosses:
            return array("i", stream(self, normal)).tobytes()
        memo, out = self._memo, []
        for word in self.segment.findall(normal):
            found = memo.get(word)
            out.append(self._word(word) if found is None else found)
        if len(memo) > CACHE:  # words in use move on to the new memo, the others are forgotten
            self._memo, self._older = {}, memo
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        """Ids of a word that is not in the memo: from the one before, or part by part, as paths meet
        between two characters that no piece holds side by side."""
        found = self._older.get(word)
        if found is None:
            pairs, parts, at = self.pairs, [], 0
            for k in range(1, len(word)):
                if word[k - 1 : k + 1] not in pairs:
                    parts.append(word[at:k])
                    at = k
            if at:
                parts.append(word[at:])
                found = b"".join([self._memo.get(part) or self._word(part) for part in parts])
            elif len(word) <= 2 * self.longest:  # the word is all of the window
                size = len(word)
                back, last, total = [0] + [-1] * size, [START] * (size + 1), [0.0] * (size + 1)
                _expand(self, word, back, last, total, 0, size)
                found = array("i", self.ids_of(_codes(back, last, size))).tobytes()
            else:
                found = array("i", stream(self, word)).tobytes()
        if len(word) <= _LONGEST_MEMO:
            self._memo[word] = found
        return found

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _model_type(content: bytes) -> int:
    """The trainer's model type (1 unigram, 2 BPE): field 3 of field 2 of the model message."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                value |= (data[at] & 127) << shift
                at, shift = at + 1, shift + 7
                if not data[at - 1] & 128:
                    return value

        while at < len(data):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
            else:
                size = {1: 8, 5: 4}.get(key & 7) or number()
                yield key >> 3, data[at : at + size]
                at += size

    kinds = [value for key, trainer in fields(content) if key == 2 for inner, value in fields(trainer) if inner == 3]
    return kinds[-1] if kinds else 1


def stream(model: Model, characters: Iterable[str]) -> Iterator[int]:
    """Ids of normalised characters, committed as soon as every surviving path agrees.

    A position is expanded into the pieces that begin there once as many characters follow as
    the longest piece has, or none do.
    """
    longest = model.longest
    window, done = "", 0  # characters behind the last committed boundary; positions expanded
    # by position: start and code of the last piece, score of the path
    back, last, total = [0], [START], [0.0]
    source = iter(characters)
    while True:
        more = "".join(islice(source, 2 * longest))
        window += more
        size = len(window)
        back += [-1] * (size + 1 - len(back))
        last += [START] * (size + 1 - len(last))
        total += [0.0] * (size + 1 - len(total))
        ready = size - longest if more else size
        if ready > done:
            _expand(model, window, back, last, total, done, ready)
            done = ready
        if not more:
            break
        cut = _meeting(back, done)
        if cut:
            yield from model.ids_of(_codes(back, last, cut))
            window, done, base = window[cut:], done - cut, total[cut]
            back = [max(-1, b - cut) for b in back[cut:]]
            back[0] = 0
            last, total = last[cut:], [t - base for t in total[cut:]]
    yield from model.ids_of(_codes(back, last, len(window)))


def _expand(model: Model, window: str, back: list[int], last: list[int], total: list[float], first: int, until: int) -> None:
    """Enter the pieces that begin at the positions into the positions where they end."""
    trie, valid, bpe, n, size = model.trie, model.valid, model.bpe, len(model.names), len(window)
    for begin in range(first, until):
        node, end, left = trie, begin, last[begin]
        while end < size:
            hit = node.get(window[end])
            end += 1
            if hit is None:
                if end > begin + 1:
                    break
                code = -1
            else:
                node, code = hit
            if code < 0 and end == begin + 1:  # a character that is no piece stands for itself
                code = n + ord(window[begin])
            if code >= 0:
                if bpe:
                    if back[end] < 0:
                        fits = valid.get(left * WIDE + code)
                        if model.neighbours(left, code) if fits is None else fits:
                            back[end], last[end] = begin, code
                else:
                    score = total[begin] + (model.score_of[code] if code < n else model.unknown_score)
                    if back[end] < 0 or score > total[end]:
                        back[end], last[end], total[end] = begin, code, score
            if hit is None:
                break


def _meeting(back: list[int], done: int) -> int:
    """The last boundary that the paths of all positions that later pieces can follow pass: those from
    the first unexpanded one on."""
    heads = {k for k in range(done, len(back)) if back[k] >= 0}
    while len(heads) > 1:
        last = max(heads)
        heads.remove(last)
        heads.add(back[last])
    return min(heads.pop(), done) if heads else 0


def _codes(back: list[int], last: list[int], end: int) -> list[int]:
    """Codes of the pieces up to a position."""
    out = []
    while end > 0:
        out.append(last[end])
        end = back[end]
    return out[::-1]


_loaded: dict[str, Model] = {}


def model_at(path: str) -> Model:
    """The model of a file, read once a worker."""
    if path not in _loaded:
        _loaded[path] = Model(path)
    return _loaded[path]


def encode(text: Column, path: str) -> Column:
    """Array of ids of a text."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        model = model_at(path)
        found = [model.packed(t) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, found)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """Text of an array of ids; null for null."""

    @F.arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        model = model_at(path)
        flat, ends = lists.values.to_numpy(zero_copy_only=False).tolist(), lists.offsets.to_numpy().tolist()
        known = lists.is_valid().to_pylist()
        return pa.array([model.decode(flat[a:b]) if k else None for k, a, b in zip(known, ends[:-1], ends[1:], strict=True)], pa.string())

    return texts(ids)


def encoded(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, ``n_tokens`` and ``ids``."""
    df = docs.select(docs[id], encode(docs[text], path).alias("ids"))
    return df.select(id, F.size("ids").cast("long").alias("n_tokens"), "ids")


def round_trips(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``encoded`` with a column ``round_trip``: whether the ids decode to the text."""
    df = docs.select(docs[id], docs[text].alias("text"), encode(docs[text], path).alias("ids"))
    same = decode(F.col("ids"), path) == F.coalesce(F.col("text"), F.lit(""))
    return df.select(id, F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))
