"""SimHash near-dedup by anchor-point covering.

The anchors are the words of a covering code: two binary Golay codes of 23 bits
side by side over bits 0 to 45, the other 18 bits free. Each Golay code is
perfect with covering radius 3, so every fingerprint has one home anchor
within the radius in both halves. A fingerprint that differs in at most d bits
from another lies within the radius plus d of the other's home, d being dealt
out to the halves. So fingerprints go to every anchor that near, and the links
of an anchor are those between its home fingerprints and all that came to it.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdmill.llm.common import in_arrow, text_of
from mdmill.operators.components import connected_components
from mdmill.session import drop, save, table

WORDS, DIFFERING, SEED = 3, 2, 42
#: Length, radius and generator polynomial of the binary Golay code; a code word's upper 12 bits tell it.
LENGTH, RADIUS, GENERATOR, CHECK_BITS = 23, 3, 0xC75, 11
#: Home fingerprints that one task compares with all that came; an anchor with more is cut into slices.
SLICE_HOMES = 4096
#: Cells of a block of comparisons; shingles whose bits are counted at once.
CELLS, BLOCK = 1 << 20, 1 << 15
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints_of(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """The 64-bit fingerprint of each text: a bit is 1 if over half the shingles' XXH64 have it; 0 without words."""
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    found, held, block = np.zeros(len(texts), np.uint64), [], []

    def close():
        starts = np.cumsum([0, *(n for _, n in held)])
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, starts[:-1], axis=0, dtype=np.int64)
        ones = np.packbits(sums * 2 > np.array([n for _, n in held])[:, None], axis=1, bitorder="little")
        found[[i for i, _ in held]] = ones.view("<u8")[:, 0]
        held.clear()
        block.clear()

    for i, text in enumerate(texts):
        w = text.translate(_LOWER).split()
        if not w:
            continue
        shingles = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
        n = len(block)
        block.extend(map(digest, shingles))
        held.append((i, len(block) - n))
        if len(block) >= BLOCK:
            close()
    if held:
        close()
    return found


def simhash(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint of each text as a signed number; null texts count as empty."""

    def run(batches):
        for batch in batches:
            fp = fingerprints_of([(v.as_py() or "").encode() for v in batch.column(1)], words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", text_of().alias("text")), run, f"doc_id {kind}, fp long")


class Golay:
    """For each syndrome the error patterns of weight up to RADIUS plus `over`, by how far they exceed the radius."""

    def __init__(self, over: int):
        parts = [self._syndromes(np.arange(256, dtype=np.int64) << s) for s in (0, 8, 16)]
        self.table = parts
        weight = np.bitwise_count(np.arange(1 << LENGTH, dtype=np.uint32))
        self.starts, self.patterns = [], []
        for e in range(over + 1):
            chosen = np.flatnonzero(weight <= RADIUS if e == 0 else weight == RADIUS + e)
            of = self.syndrome(chosen)
            order = np.argsort(of, kind="stable")
            self.patterns.append(chosen[order])
            self.starts.append(np.searchsorted(of[order], np.arange((1 << CHECK_BITS) + 1)))

    @staticmethod
    def _syndromes(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(LENGTH, CHECK_BITS - 1, -1):
            x ^= np.where(x >> bit & 1, GENERATOR << bit - CHECK_BITS, 0)
        return x

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.table[0][x & 255] ^ self.table[1][x >> 8 & 255] ^ self.table[2][x >> 16]

    def words_near(self, x: np.ndarray, over: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, word): the code words at RADIUS + over from each x; with over 0 the one within RADIUS."""
        of = self.syndrome(x)
        lo, n = self.starts[over][of], np.diff(self.starts[over])[of]
        row = np.repeat(np.arange(len(x)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return row, (x[row] ^ self.patterns[over][at]) >> CHECK_BITS


def homes(code: Golay, fp: np.ndarray) -> np.ndarray:
    """The anchor within the covering radius of each fingerprint, 24 bits."""
    low, high = (fp & (1 << LENGTH) - 1).astype(np.int64), (fp >> LENGTH & (1 << LENGTH) - 1).astype(np.int64)
    return code.words_near(low, 0)[1] << 12 | code.words_near(high, 0)[1]


def anchors_near(code: Golay, fp: np.ndarray, differing: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): every anchor within the radius plus `differing`, that number dealt out to the two halves."""
    low, high = (fp & (1 << LENGTH) - 1).astype(np.int64), (fp >> LENGTH & (1 << LENGTH) - 1).astype(np.int64)
    rows, anchors = [], []
    for a in range(differing + 1):
        row, first = code.words_near(low, a)
        for b in range(differing + 1 - a):
            again, second = code.words_near(high[row], b)
            rows.append(row[again])
            anchors.append(first[again] << 12 | second)
    return np.concatenate(rows), np.concatenate(anchors)


def _home_rows(classes: DataFrame) -> DataFrame:
    def run(batches):
        code = Golay(0)
        for batch in batches:
            anchor = homes(code, batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int32()), batch.column(0)], names=["anchor", "fp"])

    return in_arrow(classes.select("fp"), run, "anchor int, fp long")


def _visits(classes: DataFrame, lived_in, differing: int) -> DataFrame:
    """(anchor, fp): every anchor near a fingerprint that is some fingerprint's home."""

    def run(batches):
        code, homes_bits = Golay(differing), lived_in.value
        for batch in batches:
            for part in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(part, 4096)
                row, anchor = anchors_near(code, fp.to_numpy().view(np.uint64), differing)
                held = homes_bits[anchor >> 3] >> (anchor & 7) & 1 == 1
                yield pa.RecordBatch.from_arrays([pa.array(anchor[held], pa.int32()), fp.take(pa.array(row[held]))], names=["anchor", "fp"])

    return in_arrow(classes.select("fp"), run, "anchor int, fp long")


class _Group:
    """The homes of one slice of an anchor; links of what comes to them, a forest of them only."""

    def __init__(self, key):
        self.key, self.parts, self.homes, self.parent = key, [], None, []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def links(self, came: np.ndarray, differing: int):
        if self.homes is None:
            self.homes = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64)
            self.parent = list(range(len(self.homes)))
        step = max(CELLS // max(len(self.homes), 1), 1)
        for i in range(0, len(came), step):
            block = came[i : i + step]
            # A pair is found at the home of its smaller fingerprint.
            near = (np.bitwise_count(block[:, None] ^ self.homes) <= differing) & (block[:, None] > self.homes)
            last = -1
            for v, h in zip(*(x.tolist() for x in np.nonzero(near))):
                if v != last:
                    yield int(block[v]), int(self.homes[h])
                    last, first = v, h
                elif (a := self.root(first)) != (b := self.root(h)):
                    self.parent[b] = a
                    yield int(self.homes[first]), int(self.homes[h])


def fingerprint_links(classes: DataFrame, differing: int = DIFFERING) -> DataFrame:
    """(x, y): links between distinct fingerprints `fp`, enough of them to connect all that chains of near ones connect.

    What has no home at an anchor is not sent there: the anchors that are homes
    are a bitmap of 2^24 bits (2 MB, whatever the input). Slices of an anchor
    hold at most about SLICE_HOMES homes each; what comes to it streams past each.
    """
    spark = classes.sparkSession
    home, home_path = save(_home_rows(classes), "homes")
    lived_in = np.zeros(1 << 18, np.uint64)
    words = home.select(F.shiftright("anchor", 6).alias("w"), F.expr("shiftleft(1L, anchor & 63)").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    for row in words.toLocalIterator():
        lived_in[row["w"]] = np.int64(row["bits"]).view(np.uint64)
    lived_in = spark.sparkContext.broadcast(lived_in.view(np.uint8))
    hot, hot_path = save(
        home.groupBy("anchor").agg(F.ceil(F.count("*") / SLICE_HOMES).cast("int").alias("slices")).where("slices > 1").withColumnRenamed("anchor", "of"), "hot"
    )
    came = _visits(classes, lived_in, differing).withColumn("came", F.lit(1))
    sliced = home.withColumn("came", F.lit(0)).unionByName(came).join(hot, F.col("anchor") == F.col("of"), "left")
    # A home goes to the slice of its hash, what comes goes to all.
    every = F.sequence(F.lit(0), F.col("slices") - 1)
    slices = F.when(F.col("slices").isNull(), F.array(F.lit(0))).when(F.col("came") == 0, F.array(F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))).otherwise(every)
    rows = sliced.select("anchor", F.explode(slices).alias("slice"), "came", "fp")

    def compare(batches):
        group = None
        for batch in batches:
            anchor, piece, came, fp = (c.to_numpy() for c in batch.columns)
            key = anchor.astype(np.int64) << 32 | piece
            fp = fp.view(np.uint64)
            borders = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(came) != 0)) + 1).tolist(), len(key)]
            found = []
            for lo, hi in zip(borders[:-1], borders[1:]):
                if lo == hi:
                    continue
                if group is None or group.key != key[lo]:
                    group = _Group(key[lo])
                if came[lo]:
                    found.extend(group.links(fp[lo:hi], differing))
                else:
                    group.parts.append(fp[lo:hi].copy())
            x, y = (np.array([p[i] for p in found], np.uint64).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    met = rows.repartition("anchor", "slice").sortWithinPartitions("anchor", "slice", "came")
    links, _ = save(in_arrow(met, compare, "x long, y long"), "links")
    drop(spark, home_path, hot_path)
    lived_in.destroy()
    return links


def near_components(docs: DataFrame, words: int = WORDS, differing: int = DIFFERING) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of docs.

    Documents with one fingerprint are one class, so only distinct fingerprints
    are compared. component_id is the smallest doc_id reachable by links
    between fingerprints that differ in at most `differing` bits, the row's own
    included; null where no row reachable has an id.

    Null and empty texts have fingerprint zero and link like any other. Rows
    with a null id count as members of their class. Rows that repeat an id get
    the same result each if their texts are equal, else each its own. Other
    columns are ignored. Empty docs give an empty result.
    """
    signed, _ = save(simhash(docs, words), "simhash")
    classes, _ = save(signed.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = connected_components(fingerprint_links(classes, differing), "x", "y")
    named, _ = save(classes.join(found, F.col("fp") == F.col("id"), "left").select(F.col("fp").alias("of"), F.coalesce("component", "fp").alias("component"), "least"), "named")
    least = named.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id"))
    reach, _ = save(named.join(least, F.col("component") == F.col("c")).select("of", "component_id"), "reach")
    return signed.join(reach, F.col("fp") == F.col("of"), "left").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, words: int = WORDS, differing: int = DIFFERING) -> DataFrame:
    """docs without the rows that a smaller id's fingerprint reaches; rows with a null id stay."""
    gone = near_components(docs, words, differing).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op12_simhash_anchors(spark, sf_dir):
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
