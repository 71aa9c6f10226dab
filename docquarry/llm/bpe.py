"""Byte-level BPE by prefix dynamic programming.

Among the ways to cut a byte string into tokens, the one that BPE merging makes is the only one in which each two
neighbours are what merging makes of their joined bytes. So each prefix of a string has exactly one last token that
can stand in its encoding: it ends the prefix, and goes with the last token of what stands before it. Storing that
token for each prefix gives the encoding of every prefix, appends for the cost of what is appended, and re-encoding
after an edit for the cost of the bytes up to where the stored tokens agree again."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docquarry.llm import runtime
from docquarry.llm.pieces import PieceEncoder

#: Verdicts on token pairs that a worker remembers; the table starts anew beyond.
PAIRS = 1_000_000


class Vocabulary:
    """Ranks of tokens, and which tokens can stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.sound: dict[int, bool] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first and leftmost among equals: the definition that the rest is held against."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def stands(self, token: int) -> bool:
        """Whether merging a token's own bytes gives the token."""
        known = self.sound.get(token)
        if known is None:
            known = self.sound[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def beside(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes gives just these two tokens."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs = {}
            joined = self.bytes_of[left] + self.bytes_of[right]
            known = self.pairs[left, right] = joined not in self.ranks and self.merged(joined) == [left, right]
        return known


class PrefixEncoding:
    """The encoding of one piece of bytes, kept as each prefix's last token.

    A piece that is a token as a whole is that token. Appends and edits give what encoding the new bytes anew would."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _token_ending(self, data: bytes, last: list[int], end: int) -> int:
        v = self.vocabulary
        get, beside = v.ranks.get, v.beside
        for begin in range(max(0, end - v.longest), end):
            token = get(data[begin:end])
            if token is not None and v.stands(token) and (begin == 0 or beside(last[begin - 1], token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        begin, self.data = len(self.data), self.data + more
        for end in range(begin + 1, len(self.data) + 1):
            self.last.append(self._token_ending(self.data, self.last, end))

    def replace(self, begin: int, end: int, new: bytes) -> int:
        """Put `new` for data[begin:end]; returns how many prefixes were computed anew.

        Behind the edit, a prefix's last token depends on the bytes and last tokens of at most `longest` places before
        it. Once so many places in a row agree with the old ones, all later ones do."""
        old, shift = self.last, len(new) - (end - begin)
        data = self.data[:begin] + new + self.data[end:]
        last, same, place = old[:begin], 0, begin
        while place < len(data):
            if place >= begin + len(new) and same >= self.vocabulary.longest:
                break
            last.append(self._token_ending(data, last, place + 1))
            before = place - shift
            agrees = place >= begin + len(new) and 0 <= before < len(old) and old[before] == last[place]
            same = same + 1 if agrees else 0
            place += 1
        done = place - begin
        last += old[place - shift :] if place < len(data) else []
        self.data, self.last = data, last
        return done

    def tokens(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.data)
        if whole is not None:
            return [whole]
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class TextEncoder:
    """Encodes whole texts: each match of the pattern by itself, distinct matches once."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary.read(path)
        self.find = regex.compile(pattern).findall
        self.matches: dict[str, bytes] = {}
        size = max(self.vocabulary.bytes_of) + 1
        self.table = [self.vocabulary.bytes_of.get(i, b"") for i in range(size)]
        self.encode = PieceEncoder(self._piece, self._piece)

    def _match(self, text: str) -> bytes:
        ids = self.matches.get(text)
        if ids is None:
            if len(self.matches) > 300_000:
                self.matches = {}
            data = text.encode()
            whole = self.vocabulary.ranks.get(data)
            tokens = [whole] if whole is not None else PrefixEncoding(self.vocabulary, data).tokens()
            ids = self.matches[text] = np.array(tokens, "<u4").tobytes()
        return ids

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self._match, self.find(piece)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[str, str], TextEncoder] = {}


def text_encoder(path: str, pattern: str) -> TextEncoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = TextEncoder(path, pattern)
    return _encoders[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with the ids of each whole text (little-endian unsigned 32-bit) and, if named, the bytes that they decode to.

    Null and empty texts have no ids. Columns of df with the new names are replaced. Each row stands alone: repeated
    rows and rows with a null key get their own result, an empty table an empty one. Very long texts go whole."""
    runtime.ship(df.sparkSession)
    new = [n for n in (ids, decoded) if n]
    kept = df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in new} and c != text])
    if text in new:
        raise ValueError("the text column can't be replaced")

    def run(batches):
        encoder = text_encoder(path, pattern)
        for batch in batches:
            for part in runtime.steps(batch, text):
                got = encoder.encode(part.column(text))
                columns = [*part.columns, pa.array(got, pa.binary())]
                if decoded:
                    columns.append(pa.array(list(map(encoder.decode, got)), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *new])

    return kept.mapInArrow(runtime.relieved(run), T.StructType([*kept.schema.fields, *(T.StructField(n, T.BinaryType()) for n in new)]))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes that each row's ids stand for; null ids: no bytes."""
    runtime.ship(df.sparkSession)
    kept = df.drop(decoded)

    def run(batches):
        encoder = text_encoder(path, r"(?s).+")
        for batch in batches:
            out = pa.array([encoder.decode(x or b"") for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, decoded])

    return kept.mapInArrow(runtime.relieved(run), T.StructType([*kept.schema.fields, T.StructField(decoded, T.BinaryType())]))
