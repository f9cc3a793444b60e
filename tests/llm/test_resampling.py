"""Importance resampling against a plain computation."""

import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from mdmill.llm import resampling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text, longest):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, longest, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    source, goal = [0] * buckets, [0] * buckets
    for _, text in rows:
        for f in features(text, longest)[1]:
            source[bucket(f)] += 1
    for text in target:
        for f in features(text, longest)[1]:
            goal[bucket(f)] += 1
    big_s, big_t, out, able = sum(source), sum(goal), [], []
    for i, text in rows:
        words, found = features(text, longest)
        gain = [math.floor(1000 * math.log((goal[bucket(f)] + 1) * (big_s + buckets) / ((source[bucket(f)] + 1) * (big_t + buckets)))) for f in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None])
        if len(words) >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = k
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("longest, buckets, percent, least", [(1, 10_000, 10, 20), (2, 50, 60, 3), (3, 7, 100, 0)])
def test_resample(odd_docs, longest, buckets, percent, least):
    target = odd_docs.where("doc_id % 4 = 1").limit(9).select("text").collect()
    at = odd_docs.sparkSession.createDataFrame(target, "text string")
    rows = odd_docs.select("doc_id", "text").collect()
    got = resampling.resample(odd_docs, at, percent, least, longest, buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain([tuple(r) for r in rows], [r["text"] for r in target], longest, buckets, percent, least)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_empty_tables_and_draw(odd_docs):
    none = odd_docs.limit(0)
    assert resampling.resample(none, odd_docs).count() == 0
    assert resampling.resample(odd_docs, none.select("text")).count() == odd_docs.count()
    ranks = {r["doc_id"] for r in resampling.resample(odd_docs, odd_docs, percent=50).where("rank IS NOT NULL").collect()}
    kept = resampling.draw(odd_docs, odd_docs, percent=50)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == ranks - {None}


def test_one_id_that_holds_a_third_of_all_rows(spark):
    """Equal rows get ranks one after another, without meeting in one window."""
    rows = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot words " * 15).otherwise(F.concat(F.lit("w "), F.repeat(F.concat(F.col("id"), F.lit(" ")), 30))).alias("text"),
    )
    got = resampling.resample(rows, rows.limit(5), percent=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 901))
    hot = sorted(r["rank"] for r in got if r["doc_id"] == 7 and r["n_features"] == 30)
    assert len(hot) >= 300 and hot == list(range(hot[0], hot[0] + len(hot)))
