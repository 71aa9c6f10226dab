"""Operators' kernels against plain versions; no Spark."""

import base64
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docquarry.llm import bpe, fingerprints, language_id, near_duplicates, packing, pieces, quality, runtime, substrings, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAB é\n\t .#", max_size=60)), min_size=1, max_size=6)
ODD = ["a <|endoftext|> b", "<|startoftext|>x<|EndOfText|>", "", " ", "a", "a  b", "\n\nx", "don't stop", "x\x1cy", "İΣς", "中文 字", "<|endoftext|>", "ée", "a b", "1,234.5", "İstanbul 12", "</w>"]


def random_texts(n, seed=3):
    r = random.Random(seed)
    letters = list("abcde stremd.,!?019#é Üß\n") + ODD
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(n)]


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_words_and_windows(texts):
    data, offsets = runtime.utf8(pa.array(texts, pa.string()))
    starts, ends, first = runtime.word_bounds(data, offsets)
    raw = data.tobytes()
    got = [raw[s:e].decode() for s, e in zip(starts, ends)]
    want = [WORD.findall(t or "") for t in texts]
    assert got == [w for x in want for w in x]
    assert np.diff(first).tolist() == [len(x) for x in want]
    hashes = runtime.word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(got))
    windows = runtime.window_hashes(hashes, 2)
    ok = runtime.inside(first, 2, len(windows))
    pairs = [tuple(x[i : i + 2]) for x in want for i in range(len(x) - 1)]
    assert len(set(windows[ok].tolist())) == len(set(pairs)) and int(ok.sum()) == len(pairs)


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_quality_statistics(texts):
    got = quality.word_statistics(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        seen = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {k for j in range(len(w) - 4) if seen[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)
        assert tuple(int(got[c][i]) for c in quality._STATS) == want


def test_sorted_hashes_find_what_they_hold():
    r = np.random.default_rng(7)
    for n in (0, 1, 2, 1000):
        h = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1))
        h[: len(h) // 2] >>= np.uint64(12)  # crowded in front
        h = np.unique(h)
        table = quality.SortedHashes(h, np.arange(len(h), dtype=np.float32))
        wanted = np.concatenate([h, h + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
        at, found = table.find(wanted)
        assert found.tolist() == np.isin(wanted, h).tolist()
        assert (table.hashes[at[found]] == wanted[found]).all()


@pytest.mark.parametrize("name,words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_are_the_librarys_tokens(name, words):
    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    texts = [None, *ODD, *random_texts(1500)]
    got = pieces.library_encoder(path, words)(pa.array(texts, pa.string()))
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == (tokenizer.encode(t, add_special_tokens=False).ids if t else []), repr(t)


@pytest.fixture(scope="module")
def coder():
    return bpe.text_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_prefix_encoding_is_tiktokens(coder):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, *ODD, *random_texts(1500, 4), "ab" * 700, "###" * 300]
    for t, ids in zip(texts, coder.encode(pa.array(texts, pa.string()))):
        assert np.frombuffer(ids, "<u4").tolist() == (plain.encode_ordinary(t) if t else [])
        assert coder.decode(ids) == (t or "").encode()


def test_appends_and_edits_give_what_encoding_anew_gives(coder):
    r = random.Random(9)
    v = coder.vocabulary
    for _ in range(40):
        data = bytes(r.choice(b"thepreinga \xc3\xa9") for _ in range(r.randint(0, 60)))
        e = bpe.PrefixEncoding(v, data[:20])
        e.append(data[20:])
        assert e.last == bpe.PrefixEncoding(v, data).last
        i, j = sorted((r.randint(0, len(data)), r.randint(0, len(data))))
        new = bytes(r.choice(b"then in") for _ in range(r.randint(0, 6)))
        e.replace(i, j, new)
        fresh = bpe.PrefixEncoding(v, data[:i] + new + data[j:])
        assert (e.data, e.last, e.tokens()) == (fresh.data, fresh.last, fresh.tokens())
        assert fresh.tokens() == ([v.ranks[fresh.data]] if fresh.data in v.ranks else v.merged(fresh.data))
    long = bpe.PrefixEncoding(v, b"the quick brown fox " * 60)
    assert long.replace(3, 4, b"_") < 1200 - 3


@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70_000), st.integers(0, (1 << 64) - 1)), max_size=700))
@settings(max_examples=60, deadline=None)
def test_words_round_trip(ids):
    words, offsets = token_files.encode_words(np.array(ids, np.uint64))
    assert token_files.decode_words(words, offsets, len(ids)).tolist() == ids


def test_words_are_dense():
    words, _ = token_files.encode_words(np.zeros(2560, np.uint64))
    assert len(words) == 10 * 5  # 60 to a word, blocks of 256
    words, _ = token_files.encode_words(np.full(2560, 30_000, np.uint64))
    assert len(words) == 10 * 64


def test_packer_places_every_id_once():
    r = random.Random(5)
    packer = packing.Packer(0, size=64, room=4)
    docs = {d: np.arange(r.randint(1, 200), dtype="<u4") + 1000 * d for d in range(200)}
    for d, ids in docs.items():
        packer.put(d, 0, ids.tobytes(), len(ids))
    assert len(packer.free) <= 4
    packer.close()
    got, fill = {}, Counter()
    for doc, start, length, crc, total, sequence, offset, ids, _ in packer.done:
        assert np.frombuffer(ids, "<u4").tolist() == docs[doc][start : start + length].tolist() and crc == zlib.crc32(ids) and total == len(docs[doc])
        got.setdefault(doc, []).append((start, length))
        assert offset == fill[sequence]
        fill[sequence] += length
    for doc, parts in got.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(docs[doc])
    assert max(fill.values()) <= 64 and sum(fill.values()) / (64 * len(fill)) > 0.9


def test_cover_has_each_difference():
    d, p = substrings.COVER, substrings.PERIOD
    assert {(a - b) % p for a in d for b in d} == set(range(p))


@given(st.lists(st.text(alphabet="ab c", max_size=40), min_size=2, max_size=5))
@settings(max_examples=40, deadline=None)
def test_shingle_sets(texts):
    s = near_duplicates.Settings(shingle=2)
    hashes, first = near_duplicates.shingles(pa.array(texts), s)
    for i, t in enumerate(texts):
        w = t.lower().split()
        want = {tuple(w[j : j + 2]) for j in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()
        assert first[i + 1] - first[i] == len(want)


def test_banding_finds_what_is_similar():
    assert near_duplicates.Settings().missed(0.8) < 1e-3
    r = np.random.default_rng(1)
    s = near_duplicates.Settings()
    base = r.integers(0, 1 << 63, 900).astype(np.uint64)
    other = np.concatenate([base[:800], r.integers(0, 1 << 63, 100).astype(np.uint64)])  # 800 of 1000
    keys = near_duplicates.sketch(np.concatenate([base, other]), np.array([0, 900, 1800]), s)
    same = keys[0] == keys[1]
    assert same[: s.side].any() and same[s.side :].any()


def test_sketches_merge_and_contain():
    a, b = " ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(2000, 2400))
    x, y = fingerprints.sketches(pa.array([a, b]))
    assert fingerprints.containment(y, x) == 1.0 and 0.07 < fingerprints.containment(x, y) < 0.13
    assert fingerprints.read(fingerprints.written(x)).tolist() == x.tolist()
    assert fingerprints.merged([x, y]).tolist() == x.tolist()
    assert fingerprints.likeness(x, x) == 1.0 and fingerprints.likeness(x[:0], x[:0]) == 1.0 and fingerprints.likeness(x, x[:0]) == 0.0


def test_filters_return_all_languages_with_an_ngram():
    r = np.random.default_rng(2)
    members = [r.integers(0, 1 << 60, 500).astype(np.uint64) for _ in range(70)]
    members[69] = np.concatenate([members[69], members[3][:50]])
    f = language_id.LanguageFilters.build([f"l{i}" for i in range(70)], members)
    mask = f.containing(members[3][:50])
    assert (mask[:, 0] & np.uint64(1 << 3)).all() and (mask[:, 1] & np.uint64(1 << 5)).all()
    assert f.false_rate.max() < 0.05
