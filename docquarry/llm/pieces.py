"""Tokenising by pieces: a text is cut where no token can reach across, and each distinct piece is encoded once.

A piece ends before a single space, or around a single newline, between two characters that aren't white space: the
split pattern of byte-level BPE always starts a match there, and word BPE drops white space. Texts with other white
space are handed to the encoder whole. A worker keeps the pieces it has met in a table of bounded size."""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

from docquarry.llm.runtime import utf8

#: Distinct pieces that a worker's table holds, of which there are two.
REMEMBERED = 500_000

_ODD = np.zeros(256, bool)
_ODD[[i for i in range(32) if i != 10]] = True


def plain(data: np.ndarray, offsets: np.ndarray, single: bool) -> np.ndarray:
    """Which texts have no white space but spaces and newlines; single: and each of these stands between others."""
    n = len(data)
    odd = _ODD[data]
    if n > 1:
        two = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        odd[:-1] |= two
    if n > 2 and ((data == 0xE1) | (data == 0xE2) | (data == 0xE3)).any():
        a, b, c = data[:-2], data[1:-1], data[2:]
        odd[:-2] |= (a == 0xE1) & ((b == 0x9A) | (b == 0xA0))
        odd[:-2] |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
        odd[:-2] |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    if single and n:
        white = (data == 32) | (data == 10)
        odd[1:] |= white[1:] & white[:-1]
        full = offsets[:-1] < offsets[1:]
        odd[offsets[:-1][full]] |= white[offsets[:-1][full]]
        odd[offsets[1:][full] - 1] |= white[offsets[1:][full] - 1]
    out = np.ones(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = False
    return out


class _Known(dict):
    """What `make` gives for each key, remembered: when a table is full it becomes the old one, where what is asked for
    again is found and kept; so common pieces stay and memory is bounded."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def settle(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class PieceEncoder:
    """piece: the little-endian unsigned 32-bit ids of one piece; whole: of one text; words: white space has no tokens;
    special: strings that are tokens by themselves, texts with which are handed over whole."""

    def __init__(self, piece: Callable[[str], bytes], whole: Callable[[str], bytes], words: bool = False, special: tuple[str, ...] = ()):
        self.whole, self.words, self.special = whole, words, special
        self.known = _Known(piece if words else lambda p: piece(p if p[0] == "\n" else " " + p), REMEMBERED)

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (null: none)."""
        fit = plain(*utf8(texts), single=not self.words)
        find, out = self.known.__getitem__, []
        for i, text in enumerate(texts.to_pylist()):
            if not text:
                out.append(b"")
            elif not fit[i] or any(s in text for s in self.special):
                out.append(self.whole(text))
            elif self.words:
                out.append(b"".join(map(find, text.split())))
            else:  # the newline put before a text's first piece is one id
                out.append(b"".join(map(find, ("\n" + text).replace("\n", " \n").split(" ")[1:]))[4:])
            if not i & 63:
                self.known.settle()
        return out


#: The split pattern of byte-level pre-tokenisers that bring none of their own.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point lower-casing, composition and character classes are the same in all libraries' tables.
COMMON_LATIN = "\u0250"


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable and
    not a space, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


class _WordModel:
    """Encodes pieces word by word with the library's BPE model: its pipeline costs more than the merging itself.

    Pieces with a character from COMMON_LATIN on, and files with another kind of pipeline, go through the pipeline."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.words = self.tokenizer.model, _byte_letters(), _Known(self._word, REMEMBERED)
        with open(path, encoding="utf-8") as f:
            head = json.load(f)
        kinds = lambda x, many: [y["type"] for y in x[many]] if x and x["type"] == "Sequence" else [x["type"]] if x else []
        split, normal = head["pre_tokenizer"], head["normalizer"]
        self.lower = kinds(normal, "normalizers") == ["NFC", "Replace", "Lowercase"]
        pattern = None
        if kinds(split, "pretokenizers") == ["ByteLevel"] and split["use_regex"] and not split["add_prefix_space"] and not normal:
            pattern = BYTE_LEVEL_PATTERN
        elif kinds(split, "pretokenizers") == ["Split", "ByteLevel"] and self.lower and split["pretokenizers"][0]["invert"] and not split["pretokenizers"][1]["add_prefix_space"]:
            pattern = split["pretokenizers"][0]["pattern"]["Regex"]
        tokens = head["added_tokens"]
        # a token that is looked for in normalised text, or that takes neighbours with it, can't be found by its string
        odd = any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"] for t in tokens)
        self.special = ("",) if odd else tuple(t["content"] for t in tokens)
        self.find = regex.compile(pattern).findall if pattern and head["model"]["type"] == "BPE" else None

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def piece(self, piece: str) -> bytes:
        if not self.find or not (piece.isascii() or max(piece) < COMMON_LATIN):
            return self.whole(piece)
        if self.lower:
            piece = piece.lower() if piece.isascii() else unicodedata.normalize("NFC", piece).lower()
            if piece.isascii() and piece.isalpha():  # one match of the pattern
                return self._word(piece)
        return b"".join(map(self.words.__getitem__, self.find(piece)))

    def whole(self, text: str) -> bytes:
        self.words.settle()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_library: dict[tuple[str, bool], PieceEncoder] = {}


def library_encoder(path: str, words: bool) -> PieceEncoder:
    """The tokenizers library's encoder for a file, one in each worker: the ids that its encode() gives without added
    tokens. Strings of special tokens in a text are those tokens, as by the library's default."""
    if (path, words) not in _library:
        model = _WordModel(path)
        _library[path, words] = PieceEncoder(model.piece, model.whole, words, model.special)
    return _library[path, words]
