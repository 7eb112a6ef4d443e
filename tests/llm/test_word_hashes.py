"""The near-copy join hashes all words of a text at once."""

import numpy as np

from apisieve.llm import ngram_join as nj


def test_no_call_for_each_word(monkeypatch):
    calls, digest = [], nj.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(nj.xxhash, "xxh3_64_intdigest", lambda *a, **k: calls.append(a) or digest(*a, **k))
    text = " ".join(f"word{k}" for k in range(1000))
    assert len(nj.shingles(text, nj.WordHash())) == 998 and not calls
    nj.shingles(text + " " + "w" * 100, nj.WordHash())
    assert len(calls) == 1


def test_hashes_are_the_words():
    rng = np.random.default_rng(5)
    some = ["ab", "ba", "a", "b", "aa", "aab", "aba", "\xe9", "日本", "x" * 63, "x" * 64, "x" * 65, "x" * 200, "abba" * 16, "baab" * 16, "\U0001f600", "\x00", "\x00\x00"]
    some += ["".join(chr(c) for c in rng.integers(97, 123, rng.integers(1, 12))) for _ in range(3000)]
    gaps = [" ", "\n", "\t ", "\r\n", "\x0b", "\x0c  "]
    hashes, seen = nj.WordHash(), {}
    for n in (0, 1, 2, 3, 50, 40_000):  # the last is longer than a piece
        for ends in ("", " ", "\n\n"):
            words = [some[k] for k in rng.integers(0, len(some), n)]
            text = ends + "".join(w + gaps[k] for w, k in zip(words, rng.integers(0, len(gaps), n), strict=True)) + ends
            split = text.encode().split()
            got = hashes(text.encode()).tolist()
            assert len(got) == len(split) == n
            assert all(seen.setdefault(w, h) == h for w, h in zip(split, got, strict=True))
    assert len(set(seen.values())) == len(seen)


def test_a_word_longer_than_a_piece():
    hashes = nj.WordHash()
    a, b = hashes(b"one " + b"y" * (3 * nj.PIECE) + b" two"), hashes(b"two one")
    assert len(a) == 3 and a[0] == b[1] and a[2] == b[0]


def test_shingles_are_sets_of_neighbours():
    words = nj.WordHash()
    assert len(nj.shingles("a b a b a b", words)) == 2 and len(nj.shingles("A b  a\nB", words)) == 2
    assert nj.shingles("b a", words).tolist() != nj.shingles("a b", words).tolist() and len(nj.shingles("a", words)) == 1
    assert not len(nj.shingles(None, words)) and not len(nj.shingles(" \n", words))
    assert np.array_equal(nj.shingles("x y z w", words), nj.shingles(" X  y\tz W ", words))
