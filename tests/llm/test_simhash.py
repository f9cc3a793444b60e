"""SimHash by anchors against all pairs."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mdmill.llm import simhash
from mdmill.llm.simhash import Golay, anchors_near, homes


def fingerprint(text, words=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)]
    hashed = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def components(of, differing):
    """{fingerprint: set of fingerprints reachable}, by comparing all pairs."""
    left, groups = set(of), {}
    while left:
        group, edge = set(), [left.pop()]
        while edge:
            x = edge.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= differing}
            left -= near
            edge += near
        groups |= {x: group for x in group}
    return groups


def check(rows, differing):
    """rows: (doc_id, fp as a signed number, component_id)."""
    fps = [(i, fp & (1 << 64) - 1, c) for i, fp, c in rows]
    groups = components({fp for _, fp, _ in fps}, differing)
    ids = {}
    for i, fp, _ in fps:
        if i is not None:
            key = min(groups[fp])
            ids[key] = min(ids.get(key, i), i)
    assert all(c == ids.get(min(groups[fp])) for _, fp, c in fps)


def test_golay_codes_cover_and_reach():
    code, rnd = Golay(2), np.random.default_rng(2)
    x = rnd.integers(0, 1 << 23, 500)
    row, word = code.words_near(x, 0)
    assert (row == np.arange(500)).all()
    fp = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
    own = homes(code, fp)
    for d in range(3):
        moved = fp.copy()
        for k in range(d):
            moved ^= np.uint64(1) << ((rnd.integers(0, 20, 400) * 3 + k) % 64).astype(np.uint64)
        rows, anchors = anchors_near(code, moved, 2)
        came = set(zip(rows.tolist(), anchors.tolist()))
        assert all((i, a) in came for i, a in enumerate(own.tolist()))
        assert len(came) == len(rows)


def test_documents(odd_docs):
    rows = simhash.near_components(odd_docs).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.where("doc_id IS NOT NULL").collect()}
    assert len(rows) == odd_docs.count()
    assert all(r["fp"] & (1 << 64) - 1 == fingerprint(texts[r["doc_id"]]) for r in rows if r["doc_id"] is not None)
    check([tuple(r) for r in rows], 2)
    assert simhash.near_components(odd_docs.limit(0)).count() == 0
    kept = simhash.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == {r["doc_id"] for r in rows if r["doc_id"] == r["component_id"] and r["doc_id"] is not None}


@pytest.mark.parametrize("differing, homes_a_slice", [(2, 4096), (2, 5), (1, 4096), (3, 4096)])
def test_links_of_chains_and_crowds(spark, monkeypatch, differing, homes_a_slice):
    """Chains of small steps, a crowd around one centre (hot anchors, cut into slices), pairs one bit too far, extremes."""
    monkeypatch.setattr(simhash, "SLICE_HOMES", homes_a_slice)
    rnd = np.random.default_rng(4)
    flip = lambda x, n: x ^ sum(1 << int(b) for b in rnd.choice(64, n, replace=False))
    some = [int(x) for x in rnd.integers(0, 1 << 63, 300, dtype=np.uint64)] + [0, 1, (1 << 64) - 1, 1 << 63]
    chain = [some[0]]
    for _ in range(60):
        chain.append(flip(chain[-1], differing))
    crowd = [flip(some[1], int(rnd.integers(1, 5))) for _ in range(250)]
    apart = [flip(x, differing + 1) for x in some[2:60]] + [flip(x, differing) for x in some[60:120]]
    fps = sorted({*some, *chain, *crowd, *apart})
    frame = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long").repartition(4)
    links = [tuple(v & (1 << 64) - 1 for v in r) for r in simhash.fingerprint_links(frame, differing).collect()]
    assert links and all((x ^ y).bit_count() <= differing or min(components(fps, differing)[x]) == min(components(fps, differing)[y]) for x, y in links[:200])
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in links:
        a, b = root(x), root(y)
        parent[max(a, b)] = min(a, b)
    assert {f: root(f) for f in fps} == {f: min(g) for f, g in components(fps, differing).items()}


def test_no_more_links_than_rows_in_a_crowd(spark):
    """A crowd of fingerprints at one anchor gives a forest, not all pairs."""
    fps = [(i, (1 << a) | (1 << b)) for i, (a, b) in enumerate((a, b) for a in range(46, 62) for b in range(46, a))]
    frame = spark.createDataFrame(fps, "doc_id long, fp long")
    assert simhash.fingerprint_links(frame).count() < 2 * len(fps)


def test_hex_of_fingerprints(spark):
    row = spark.range(1).select(simhash.as_hex(F.lit(-1).cast("long")).alias("a"), simhash.as_hex(F.lit(10).cast("long")).alias("b")).first()
    assert tuple(row) == ("f" * 16, "0" * 15 + "a")
