"""Encoding with a public byte-level BPE vocabulary by a lazily determinised transducer.

The vocabulary's merges define, for every byte string, one token sequence. A nondeterministic
transducer that guesses tokens is determinised while texts are read: a state holds the *threads* that are
still open, one for each recent position where a token may have ended, with the tokens that lead to it.
A thread stays open only while the bytes since its position are the start of some token, so the lookahead
is bounded by the longest token; what all threads have in common is emitted. States and
transitions are made when first met and kept, within a bound, for the life of a Python worker.

Correctness rests on a property of BPE: a sequence is the encoding of its bytes exactly if each
neighbouring pair of it is the encoding of that pair's bytes. So each prefix has one thread.

The regular expression that parts text into words before merging is a fixed value of the vocabulary.
Strings that look like special tokens are ordinary text. Work is one pass over Arrow batches, with no shuffle.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Fixed value: the word pattern of this public vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries kept in a worker's tables before they are begun anew; results don't depend on it.
KEEP = 400_000


class Transducer:
    """Bytes to token ids. ``ranks`` maps each token's bytes to its id, which is its merge rank too."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.starts = {t[:n] for t in ranks for n in range(len(t))}  # proper beginnings, the empty one included
        self._pairs: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._steps: dict[tuple, tuple] = {}
        self._words: dict[str, list[int]] = {}

    def _merge(self, raw: bytes) -> list[int]:
        """The definition, for short strings: merge the neighbouring pair of lowest rank until none is left."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(parts[i] + parts[i + 1], len(self.ranks)), i) for i in range(len(parts) - 1)))
            if best == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: the start)."""
        if left < 0:
            if (ok := self._whole.get(right)) is None:
                ok = self._whole[right] = self._merge(self.bytes_of[right]) == [right]
            return ok
        if (ok := self._pairs.get((left, right))) is None:
            if len(self._pairs) > 4 * KEEP:
                self._pairs.clear()
            ok = self._pairs[left, right] = self._merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return ok

    def _step(self, state: tuple, byte: bytes) -> tuple[tuple, tuple[int, ...]]:
        """The next state and what is emitted. A state: the bytes since the oldest open position, the last
        emitted token, and for each thread, oldest first, the bytes since its position and its pending tokens."""
        recent, root, threads = state
        recent += byte
        alive = []
        new = None
        for back, pending in threads:
            piece = recent[len(recent) - back - 1 :]
            if new is None and (t := self.ranks.get(piece)) is not None and self._fits(pending[-1] if pending else root, t) and self._fits(-1, t):
                new = (0, (*pending, t))
            if piece in self.starts:
                alive.append((back + 1, pending))
        if new is None:
            raise ValueError("the vocabulary lacks a byte")
        alive.append(new)
        first, n = alive[0][1], 0
        while all(len(p) > n and p[n] == first[n] for _, p in alive) if len(first) > n else False:
            n += 1
        if n:
            root, alive = first[n - 1], [(k, p[n:]) for k, p in alive]
        return (recent[len(recent) - alive[0][0] :], root, tuple(alive)), first[:n]

    def word(self, raw: bytes) -> list[int]:
        """The tokens of one word, in time linear in its length."""
        out: list[int] = []
        state: tuple = (b"", -1, ((0, ()),))
        for i in range(len(raw)):
            byte = raw[i : i + 1]
            got = self._steps.get((state, byte))
            if got is None:
                if len(self._steps) > KEEP:
                    self._steps.clear()
                got = self._steps[state, byte] = self._step(state, byte)
            state = got[0]
            out += got[1]
        return out + list(state[2][-1][1])

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text``; an empty list for an empty or null text."""
        out: list[int] = []
        words = self._words
        for w in _WORDS.findall(text or ""):
            got = words.get(w)
            if got is None:
                got = self.word(w.encode("utf-8", "replace"))
                if len(w) <= 32:
                    if len(words) > KEEP:
                        words.clear()
                    words[w] = got
            out += got
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(Utf8Stream().feed_all(self.bytes_of[i] for i in ids))


_WORDS = regex.compile(PATTERN)


class Utf8Stream:
    """An incremental UTF-8 decoder: bytes may arrive in any pieces, a character comes out with its last byte.

    The state is how many continuation bytes are due and the range the next one must lie in. A sequence that
    cannot go on gives U+FFFD for its longest valid beginning, as the Unicode standard recommends.
    """

    #: Leading bytes with the number of continuation bytes and the first one's range.
    _LEAD = [(0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F),
             (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]
    _OF = {b: (n, lo, hi) for first, last, n, lo, hi in _LEAD for b in range(first, last + 1)}

    def __init__(self) -> None:
        self.due, self.low, self.high, self.point = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        if not self.due and data.isascii():
            return data.decode("ascii")
        out = []
        for b in data:
            if self.due:
                if self.low <= b <= self.high:
                    self.point, self.due, self.low, self.high = self.point << 6 | b & 0x3F, self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.point))
                    continue
                out.append("�")
                self.due = 0
            if b < 0x80:
                out.append(chr(b))
            elif b in self._OF:
                self.due, self.low, self.high = self._OF[b]
                self.point = b & (0x3F >> self.due)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        left, self.due = self.due, 0
        return "�" if left else ""

    def feed_all(self, parts: Iterable[bytes]) -> Iterator[str]:
        for p in parts:
            yield self.feed(p)
        yield self.end()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_made: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The transducer of a vocabulary file, made once in each process."""
    if path not in _made:
        _made[path] = Transducer(read_ranks(path))
    return _made[path]


def _encode_batches(path: str, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            at = b.schema.get_field_index("_text")
            ids = [t.encode(x) for x in b.column(at).to_pylist()]
            new = pa.array([len(x) for x in ids], pa.int64()) if count_only else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if i != at), new], [*(n for n in b.schema.names if n != "_text"), "_out"])

    return run


def with_tokens(df: DataFrame, *, text: str = "text", keep: list[str], out: str = "ids", count_only: bool = False, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``out``: each row's token ids (array<int>), or their number.

    Empty and null texts give an empty list or 0; every row comes out, repeated ones too. The vocabulary file must be
    readable at the same path on every executor.
    """
    own = df.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text).alias("_text"))
    kinds = ", ".join(f"_k{i} {own.schema[f'_k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    got = own.mapInArrow(_encode_batches(f"{tokenizers}/{vocabulary}", count_only), f"{kinds}, _out {'bigint' if count_only else 'array<int>'}")
    return got.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), F.col("_out").alias(out))


def _decode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            at = b.schema.get_field_index("_ids")
            texts = [None if x is None else t.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if i != at), pa.array(texts, pa.string())], [*(n for n in b.schema.names if n != "_ids"), "_out"])

    return run


def with_text(df: DataFrame, *, ids: str = "ids", keep: list[str], out: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``out``: the text of each row's ids. Null ids give null, an empty list the empty text."""
    own = df.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(ids).alias("_ids"))
    kinds = ", ".join(f"_k{i} {own.schema[f'_k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    got = own.mapInArrow(_decode_batches(f"{tokenizers}/{vocabulary}"), f"{kinds}, _out string")
    return got.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), F.col("_out").alias(out))
