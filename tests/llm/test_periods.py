"""Periodic runs against a scan of every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from mdmill.llm import periods
from mdmill.llm.periods import runs_of, runs_of_texts


def scan(w, least=24, times=3):
    """Every run, by comparing the words with themselves at every distance."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= (times - 1) * q and j > i:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items() if b - a >= least)


def sequences(seed):
    rnd = random.Random(seed)
    k = rnd.choice([2, 3, 50])
    word = lambda n: [rnd.randrange(k) for _ in range(n)]
    yield word(rnd.randrange(300))
    pieces = []
    while len(pieces) < 600:
        u = word(rnd.randrange(1, 80))
        pieces += [u[i % len(u)] for i in range(rnd.randrange(1, len(u) * 6))]
    yield pieces
    a, b = [0], [0, 1]
    for _ in range(rnd.randrange(3, 12)):
        a, b = b, b + a
    yield (b * 3)[:900]
    yield ((word(rnd.randrange(1, 30)) * 4 + word(5)) * 5)[:900]
    ones = [0] * rnd.randrange(1, 200)
    ones[rnd.randrange(len(ones))] = 1
    yield ones


@pytest.mark.parametrize("seed", range(25))
def test_runs_of_sequences(seed):
    for w in sequences(seed):
        assert runs_of(np.array(w, np.int64)) == scan(w)
        assert runs_of(np.array(w, np.int64), 5, 4) == scan(w, 5, 4)


def test_long_sequence_with_a_long_period():
    rnd = np.random.default_rng(1)
    unit = rnd.integers(0, 1000, 40_000)
    w = np.concatenate([rnd.integers(0, 1000, 5_000), np.tile(unit, 4)[:130_000], rnd.integers(1001, 2000, 99)])
    assert runs_of(w) == [(5_000, 130_000, 40_000)] or runs_of(w)[0][1:] == (130_001, 40_000)


def test_equal_contexts_are_selected_alike_and_densely():
    rnd = np.random.default_rng(3)
    part = rnd.integers(0, 4, 200)
    names = periods.mix(np.concatenate([part, rnd.integers(0, 4, 50), part]).astype(np.uint64))
    for scale in (8, 16):
        named = names.copy()
        for _ in range(scale.bit_length() - 1):
            named = periods.mix(named[:-1] * np.uint64(3) + named[1:])
        at = periods.selected(named, np.zeros(len(named), bool), scale)
        first = {int(x) for x in at if x + 2 * scale <= 190}
        assert {int(x) - 250 for x in at if 250 <= x and x - 250 + 2 * scale <= 190} == first
        assert np.diff(at).max() <= scale


def test_lists_searched_together_do_not_touch():
    same = [b"a"] * 20
    assert list(runs_of_texts([same, same, [b"a"] * 30, []])) == [[], [], [(0, 30, 1)], []]


def plant(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def expected(doc_id, text):
    w = plant(doc_id, (text or "").encode().split())
    runs = scan(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest(),
    )


@pytest.mark.parametrize("block", [1 << 16, 50])
def test_query(odd_docs, tmp_path, monkeypatch, block):
    monkeypatch.setattr(periods, "BLOCK_WORDS", block)
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = periods.op13_periodic_runs(odd_docs.sparkSession, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [expected(*r) for r in odd_docs.where("length(text) < 20000 OR text IS NULL").select("doc_id", "text").collect()]
    long = {r["doc_id"] for r in odd_docs.where("length(text) >= 20000").collect()}
    assert sorted((tuple(r) for r in got.collect() if r["doc_id"] not in long), key=str) == sorted(want, key=str)
    assert any(r[1] for r in want)


def test_find_and_collapse(odd_docs):
    found = periods.find_runs(odd_docs)
    assert found.count() == odd_docs.count() and periods.find_runs(odd_docs.limit(0)).count() == 0
    cut = periods.collapse(odd_docs)
    assert cut.columns == odd_docs.columns and cut.schema["rank"].dataType == odd_docs.schema["rank"].dataType
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    for r in odd_docs.where("doc_id IS NOT NULL").collect():
        w = (r["text"] or "").split()
        if len(w) < 2000:
            runs = scan(w)
            gone = {i for s, n, q in runs for i in range(s + q, s + n)}
            assert texts[r["doc_id"]] == (" ".join(x for i, x in enumerate(w) if i not in gone) if runs else r["text"])
