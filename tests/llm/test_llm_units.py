"""The operators' own functions against brute force, without Spark."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscope.llm import bpe, lattice, media, quality, simhash
from corpuscope.llm import suffix_array as SA
from corpuscope.llm.common import data_path


@pytest.fixture(scope="module")
def coder():
    path = data_path(bpe.RANKS)
    own = bpe.ByteBPE(path)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.one_of(st.sampled_from("'stmdrevl x\n\t.,9é漢٣  "), st.characters(blacklist_categories=("Cs",))), max_size=40), min_size=1, max_size=8))
def test_encoding_is_that_of_the_library(coder, texts):
    own, library = coder
    for t, (ids, offsets) in zip(texts, own.encode_batch([t.encode() for t in texts])):
        assert ids.tolist() == library.encode_ordinary(t)
        assert own.decode(ids, offsets) == t.encode() and offsets[-1] == len(t.encode())


def test_merges_agree_for_short_and_long(coder):
    rng = random.Random(1)
    merger = bpe.PairMerger(coder[0].ranks)
    for _ in range(300):
        piece = bytes(rng.choice(b"aethnos \xc3\xa9") for _ in range(rng.randint(0, 60)))
        assert merger.merged(piece) == merger.merged_long(piece)
    long = "x" * 5000 + "".join(rng.choice("ab") for _ in range(5000))
    assert coder[0].encode_batch([long.encode()])[0][0].tolist() == coder[1].encode_ordinary(long)


def test_wrong_offsets_are_refused(coder):
    ids, offsets = coder[0].encode_batch([b"hello world"])[0]
    with pytest.raises(ValueError):
        coder[0].decode(ids, offsets + 1)


def test_png():
    rng = np.random.default_rng(0)
    for t in (b"", b"a" * 576, b"hello", rng.integers(0, 256, 80_000, dtype=np.uint8).tobytes()):
        samples = np.frombuffer(media.padded(t), np.uint8).reshape(-1, media.WIDTH)
        image = media.png_encode(samples)
        assert (media.png_decode(image)[:, :, 0] == samples).all() and len(media.cosine_hash(samples)) == 16
        broken = bytearray(image)
        broken[len(broken) // 2] ^= 1
        with pytest.raises(ValueError):
            media.png_decode(bytes(broken))
        with pytest.raises(ValueError):
            media.png_decode(image[:-5])


def test_filters():
    def slow(kinds, f):
        out = np.zeros(f.shape, int)
        for i, j, c in np.ndindex(*f.shape):
            a, b = (out[i, j - 1, c] if j else 0), (out[i - 1, j, c] if i else 0)
            d = out[i - 1, j - 1, c] if i and j else 0
            p = a + b - d
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - d) else b if abs(p - b) <= abs(p - d) else d
            out[i, j, c] = (int(f[i, j, c]) + [0, a, b, (a + b) // 2, near][kinds[i]]) % 256
        return out

    rng = np.random.default_rng(2)
    for k in range(40):
        shape = rng.integers(1, 12), rng.integers(1, 9), rng.choice([1, 2, 3, 4])
        kinds, f = rng.integers(0, 5 if k % 2 else 3, shape[0]).astype(np.uint8), rng.integers(0, 256, shape).astype(np.uint8)
        assert (media.unfilter(kinds, f) == slow(kinds, f)).all()


def test_fingerprints():
    rng = random.Random(3)

    def slow(text):
        words = text.lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
        return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))

    texts = [" ".join(rng.choice("aB c d\té ñ E F g".split(" ")) for _ in range(n)).encode() for n in (0, 1, 2, 3, 4, 5, 254, 255, 256, 257, 258, 600, 1200)]
    assert simhash.fingerprints_of(texts).view(np.uint64).tolist() == [slow(t) for t in texts]


def test_forest_connects_what_links_connect():
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = np.array(sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1) for b in base for _ in range(30)}), np.uint64)
    a, b = simhash.forest(fps.view(np.int64))
    def groups(pairs):
        parent = {int(x): int(x) for x in fps}
        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for x, y in pairs:
            parent[root(int(x))] = root(int(y))
        out = defaultdict(set)
        for x in parent:
            out[root(x)].add(x)
        return {frozenset(v) for v in out.values()}
    every = [(x, y) for x, y in itertools.combinations(fps.tolist(), 2) if (x ^ y).bit_count() <= 3]
    assert groups(zip(a.view(np.uint64), b.view(np.uint64))) == groups(every) and len(a) < len(fps)


def test_counts():
    def slow(text):
        import re

        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        n = len(words)
        at = defaultdict(list)
        for i in range(n - 4):
            at[tuple(words[i : i + 5])].append(i)
        marks = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
        seen, again, lines = set(), 0, 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                lines, again = lines + 1, again + (line in seen)
                seen.add(line)
        return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(marks), lines

    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "c\n", " ", "é#", "\n", "\x1c", "\x0b", " x", "a b c d e "]) for _ in range(rng.randrange(60)))
        assert quality.counts_of(text.encode()) == slow(text), text


def test_covariance_step_and_consistency():
    rng = np.random.default_rng(6)
    y = rng.normal(size=(40_000, quality.DIMS))
    d = (y**2).sum(axis=1)
    bins = np.floor(np.log1p(d) / quality.BIN)
    kinds = np.unique(bins)
    n = np.array([(bins == b).sum() for b in kinds])
    sums = np.stack([y[bins == b].sum(axis=0) for b in kinds])
    squares = np.stack([y[bins == b].T @ y[bins == b] for b in kinds])
    mu, scatter = quality.inner_moments(kinds, n, sums, squares)
    assert abs(mu).max() < 0.05 and np.allclose(scatter * quality.consistency(), np.eye(quality.DIMS), atol=0.05)
    inv = np.zeros((quality.DIMS, quality.DIMS))
    inv[np.triu_indices(quality.DIMS)] = quality.inverse(np.zeros((quality.DIMS, quality.DIMS)))
    assert np.allclose(np.diag(inv), 1 / quality.FLOOR**2)


def test_lattice_sums_over_all_segmentations():
    own = lattice.lattice(data_path(lattice.PIECES))

    def slow(word):
        symbols, ways = [256, *word], {0: 1.0}
        for i in range(len(symbols)):
            node = 1
            for j in range(i, len(symbols)):
                node = int(own.next[node * own.width + own.classes[symbols[j]]])
                if not node:
                    break
                if own.piece_of[node] >= 0:
                    ways[j + 1] = ways.get(j + 1, 0.0) + ways.get(i, 0.0) * math.exp(own.start[own.piece_of[node]])
        return math.log10(ways[len(symbols)])

    words = [b"the", b"threorndhe", "èaique".encode(), "漢字".encode(), b"x", b"a" * 40, b"\xff", b"THE".lower()]
    assert np.allclose(own.log10(words, own.start), [slow(w) for w in words])
    into = np.zeros(own.n + 1)
    for at, symbols in own.by_length([b"the"]):
        own.expected(symbols, np.ones(len(at)), own.start, into)
    assert 1 <= into.sum() <= 4


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.booleans())
def test_suffix_arrays(body, by_bucket):
    few, SA.FEW = SA.FEW, 1024 if by_bucket else 0
    s = [*body, 0]
    sa = SA.suffix_array(np.array(s), 5)
    SA.FEW = few
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    common = SA.permuted_common_prefixes(np.array(s), sa, 8)
    for x, y in zip(sa.tolist(), sa.tolist()[1:]):
        n = next(k for k in range(len(s)) if k == 8 or s[x + k] != s[y + k])
        assert common[y] == n


