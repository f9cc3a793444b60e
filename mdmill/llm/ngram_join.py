"""N-gram Jaccard join by vertical partitioning of the global n-gram order."""

from __future__ import annotations

import itertools
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mdmill.llm.common import drop_ids, in_arrow, maybe_in, membership_bitmap, one_row_each, text_of
from mdmill.llm.shingles import mix, sets_of_batch
from mdmill.operators.components import connected_components
from mdmill.session import drop, save, table

#: Words of a shingle, and the least similarity in hundredths.
WORDS, PERCENT = 5, 80
#: The n-gram order is held as a level for each of 2^b hash bins; b grows with the texts, so that a bin
#: holds about BIN_GRAMS n-grams, and is at least and at most so many bits (64 MB).
BIN_GRAMS, BIN_BITS = 8, (16, 26)
#: Bytes of text that make an n-gram, about; bins that are counted together; shares in which a chunk is summed first.
GRAM_BYTES, CHUNK_BITS, SALTS = 6, 16, 16
#: Chunks from which the borders of the levels are taken; bins are hashed, so any of them show the same counts.
BORDER_CHUNKS = 16
#: Fragments of the order; each counts its part of an overlap.
FRAGMENTS = 8
#: Width of the size classes that the last join keys on.
CLASS_STEP = 1.05


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """The smallest overlap of sets of sizes a and b at the similarity: ceil(p (a + b) / (100 + p))."""
    return F.ceil((a + b) * percent / F.lit(100 + percent) - 1e-9)


@dataclass
class Order:
    """The global n-gram order: by level of the n-gram's bin, then by hash; rare levels come first."""

    bits: int
    levels: np.ndarray
    #: The share of all n-grams that stands before each level.
    before: np.ndarray

    def level(self, grams: np.ndarray) -> np.ndarray:
        return self.levels[(grams >> np.uint64(64 - self.bits)).astype(np.int64)]

    def fragment(self, grams: np.ndarray) -> np.ndarray:
        """The number of the fragment, of FRAGMENTS about equal ones, in which an n-gram stands."""
        level = self.level(grams).astype(np.int64)
        share = self.before[level] + (self.before[level + 1] - self.before[level]) * (grams.astype(np.float64) / 2.0**64)
        return np.minimum((share * FRAGMENTS).astype(np.int32), FRAGMENTS - 1)


def _chunk_rows(chunks):
    """Record batches of (chunk, bytes) pairs, a few at a time."""
    chunks = iter(chunks)
    while held := list(itertools.islice(chunks, 32)):
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in held], pa.int32()), pa.array([b for _, b in held], pa.binary())], names=["chunk", "counts"])


def _summed(kind):
    """A mapInArrow function that adds up the packed counts of each chunk in its partition."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(zlib.decompress(packed), kind)
                if chunk in sums:
                    sums[chunk] += part
                else:
                    sums[chunk] = part.astype(np.int64)
        yield from _chunk_rows((c, zlib.compress(x.tobytes(), 1)) for c, x in sums.items())

    return run


def level_borders(counts: np.ndarray) -> np.ndarray:
    """At most 255 rising counts that part the levels: quantiles, and finer steps among the largest."""
    if not len(counts):
        return np.zeros(0)
    top = max(float(np.quantile(counts, 0.995)), 1.0)
    tail = np.geomspace(top, max(float(counts.max()) * 4, top * 2), 54)
    return np.unique(np.floor(np.concatenate([np.quantile(counts, np.linspace(0, 1, 201)), tail])))


def ngram_order(texts: DataFrame, words: int) -> Order:
    """The order of n-grams by how many n-grams of all texts fall into their bin.

    A task counts its texts in one byte a bin before it sends anything, packed
    in chunks of bins; chunks are summed in SALTS shares, then whole. The
    driver gets a byte a bin, 2^BIN_BITS at most whatever the input. Beyond
    that many bins the order gets coarser, which costs candidates, not links.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(round(math.log2(max(size / (GRAM_BYTES * BIN_GRAMS), 1))), *BIN_BITS))

    def count(batches):
        counts = np.zeros(1 << bits, np.uint8)

        def add(sets):
            held, n = np.unique(np.concatenate(sets) >> np.uint64(64 - bits), return_counts=True)
            held = held.astype(np.int64)
            counts[held] = np.minimum(counts[held] + n, 255)

        for batch in batches:
            sets, n = [], 0
            for _, s in sets_of_batch(batch, 0, words):
                sets.append(s)
                n += len(s)
                if n >= 1 << 18:
                    add(sets)
                    sets, n = [], 0
            if sets:
                add(sets)
        chunks = enumerate(counts.reshape(-1, 1 << CHUNK_BITS))
        yield from _chunk_rows((c, zlib.compress(x.tobytes(), 1)) for c, x in chunks if x.any())

    schema = "chunk int, counts binary"
    counted = in_arrow(texts.select("text"), count, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    shares = in_arrow(counted.repartition("chunk", "salt").select("chunk", "counts"), _summed(np.uint8), schema)
    sums, path = save(in_arrow(shares.repartition("chunk"), _summed(np.int64), schema), "counts")
    some = [np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in sums.where(F.col("chunk") < BORDER_CHUNKS).collect()]
    borders = level_borders(np.concatenate(some) if some else np.zeros(0))

    def place(batches):
        for batch in batches:
            for chunk, packed in zip(*(c.to_pylist() for c in batch.columns)):
                counts = np.frombuffer(zlib.decompress(packed), np.int64)
                level = np.searchsorted(borders, counts, side="left").astype(np.uint8)
                mass = np.bincount(level, weights=counts, minlength=256)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary()), pa.array([mass.tobytes()], pa.binary())],
                    names=["chunk", "levels", "mass"],
                )

    levels, mass = np.zeros((1 << bits - CHUNK_BITS, 1 << CHUNK_BITS), np.uint8), np.zeros(256)
    for row in in_arrow(sums, place, "chunk int, levels binary, mass binary").toLocalIterator():
        levels[row["chunk"]] = np.frombuffer(zlib.decompress(row["levels"]), np.uint8)
        mass += np.frombuffer(row["mass"], np.float64)
    drop(texts.sparkSession, path)
    return Order(bits, levels.ravel(), np.concatenate([[0.0], np.cumsum(mass)]) / max(mass.sum(), 1.0))


def signatures(texts: DataFrame, order, words: int, percent: int) -> DataFrame:
    """(doc_id, n, s1, s2, prefix): set size, a 128-bit sum of the set, and its first n-grams in the order.

    Two sets of the asked similarity share an n-gram of their prefixes.
    """

    def run(batches):
        order_of = order.value
        for batch in batches:
            n, s1, s2, prefix = [], [], [], []
            for _, s in sets_of_batch(batch, 1, words):
                keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                first = s[np.argsort(order_of.level(s), kind="stable")[:keep]]
                n.append(len(s))
                s1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                s2.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                prefix.append(first.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))],
                names=["doc_id", "n", "s1", "s2", "prefix"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return in_arrow(texts, run, f"doc_id {kind}, n long, s1 long, s2 long, prefix array<long>")


def overlaps(texts: DataFrame, pairs: DataFrame, order, words: int) -> DataFrame:
    """pairs (pair, x, y, ...) with `overlap`: each fragment of the order counts its part, the parts are summed.

    A bitmap of the pairs' documents keeps other texts from being cut into
    shingles. Each document's fragments go to its pairs, and a pair's two sides
    meet in one group of two rows for each fragment, so texts must hold an id
    once.
    """
    sides = pairs.select(F.explode(F.array("x", "y")).alias("doc"), "pair")
    wanted = sides.select("doc").distinct()
    bitmap = membership_bitmap(wanted, F.xxhash64("doc"))
    near = maybe_in(texts, bitmap, F.xxhash64("doc_id"), "maybe").where("maybe").select("doc_id", "text")

    def run(batches):
        order_of = order.value
        for batch in batches:
            ids = batch.column(0)
            for row, s in sets_of_batch(batch, 1, words):
                of = order_of.fragment(s)
                held = np.unique(of)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([row] * len(held))), pa.array(held, pa.int32()), pa.array([s[of == f].view(np.int64) for f in held], pa.list_(pa.int64()))],
                    names=["doc", "fragment", "grams"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    parts = in_arrow(near, run, f"doc {kind}, fragment int, grams array<long>")
    meet = (
        parts.join(sides, "doc")
        .groupBy("pair", "fragment")
        .agg(F.collect_list("grams").alias("g"))
        .where(F.size("g") >= 2)
        .select("pair", F.size(F.array_intersect(F.col("g")[0], F.col("g")[1])).alias("part"))
        .groupBy("pair")
        .agg(F.sum("part").alias("overlap"))
    )
    return pairs.join(meet, "pair")


def _links(texts, pairs, order, words, percent):
    """The pairs that reach the similarity."""
    pairs, path = save(pairs.withColumn("pair", F.monotonically_increasing_id()), "pairs")
    whole = overlaps(texts, pairs, order, words)
    alike = F.col("overlap") * 100 >= (F.col("nx") + F.col("ny") - F.col("overlap")) * percent
    links, _ = save(whole.where(alike).select("x", "y", "overlap", "nx", "ny"), "links")
    drop(pairs.sparkSession, path)
    return links


def _possible(percent: int) -> Column:
    """May a pair whose first common n-gram stands at px and py reach the similarity?"""
    rest = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    return rest >= least_overlap(F.col("nx"), F.col("ny"), percent)


def jaccard_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (doc_id, n_shingles, class_id), links (x, y, overlap, nx, ny) between classes.

    Documents with the same shingle set form a class, named by its smallest id;
    links hold pairs of classes that are similar, enough of them to connect
    every two documents that a chain of similar pairs connects.

    The n-gram order is cut twice: a set's first n-grams find candidates, and
    fragments of the whole order count a candidate pair's overlap in parts.
    Candidates come in two rounds. First each n-gram shared by prefixes pairs
    its sets with one leader, the set in which it stands foremost, so a group
    of near copies costs a pair each. Then the n-grams whose sets are not yet
    connected pair all sets of different components, keyed also by the size
    classes of both sides, with as much of each prefix as those sizes allow.
    That round loses nothing the first has left.

    Null texts count as empty; texts without words are members of no link.
    Rows with a null id are members, linked with nothing. Rows that repeat an
    id count once. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", text_of().alias("text"))
    single = one_row_each(texts)
    order = spark.sparkContext.broadcast(ngram_order(texts, words))
    signed, signed_path = save(signatures(texts, order, words, percent), "signatures")
    set_key = ["n", "s1", "s2"]
    several, several_path = save(
        signed.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy(*set_key)
        .agg(F.min("doc_id").alias("class_id"), F.count("*").alias("size"))
        .where("size > 1")
        .drop("size"),
        "several",
    )
    members, _ = save(
        signed.select("doc_id", *set_key)
        .join(several, set_key, "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")
        ),
        "members",
    )
    # One row of each class; of rows that repeat an id all stay, which costs nothing but a pair with itself.
    classes = drop_ids(signed.where("n > 0 AND doc_id IS NOT NULL"), members.where("doc_id <> class_id").select("doc_id"))
    grams = classes.select(F.col("doc_id").alias("doc"), F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "gram")).repartition("gram")
    leaders = grams.groupBy("gram").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(F.struct("pos", "doc", "n")).alias("lead")).where("lo <> hi")
    shared, shared_path = save(grams.join(leaders.drop("lo", "hi"), "gram").select("gram", "doc", "n", "pos", "lead"), "shared")
    drop(spark, signed_path, several_path)

    first = (
        shared.where("doc <> lead.doc")
        .select(
            F.least("doc", "lead.doc").alias("x"),
            F.greatest("doc", "lead.doc").alias("y"),
            F.when(F.col("doc") < F.col("lead.doc"), F.col("n")).otherwise(F.col("lead.n")).alias("nx"),
            F.when(F.col("doc") < F.col("lead.doc"), F.col("lead.n")).otherwise(F.col("n")).alias("ny"),
            F.when(F.col("doc") < F.col("lead.doc"), F.col("pos")).otherwise(F.col("lead.pos")).alias("px"),
            F.when(F.col("doc") < F.col("lead.doc"), F.col("lead.pos")).otherwise(F.col("pos")).alias("py"),
        )
        .where(_possible(percent))
        .select("x", "y", "nx", "ny")
        .distinct()
    )
    links = _links(single, first, order, words, percent)
    found = connected_components(links, "x", "y")

    at = shared.join(found, shared["doc"] == found["id"], "left").select(
        "gram", "doc", "n", "pos", F.coalesce("component", "doc").alias("component")
    )
    at = at.repartition("gram")
    mixed = at.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    step = float(np.log(CLASS_STEP))
    size_class = lambda n: F.floor(F.log(n.cast("double")) / step).cast("int")
    open_entries, open_path = save(at.join(mixed, "gram", "left_semi").withColumn("own", size_class(F.col("n"))), "entries")
    drop(spark, shared_path)
    largest = F.floor(F.col("n") * 100.0 / percent + 1e-9)
    least_partner = F.greatest(F.col("n"), F.ceil(F.exp(F.col("class") * step) - 1e-6))
    # The smaller set of a pair goes to the classes that the larger one may have, as far as its prefix allows.
    smaller = (
        open_entries.withColumn("class", F.explode(F.sequence("own", size_class(largest))))
        .where(F.col("pos") <= F.col("n") - least_overlap(F.col("n"), least_partner, percent))
        .select("gram", "class", F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("component").alias("kx"))
    )
    larger = open_entries.select(
        "gram", F.col("own").alias("class"), F.col("doc").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("component").alias("ky")
    )
    in_order = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    second = (
        smaller.join(larger, ["gram", "class"])
        .where(in_order & (F.col("kx") != F.col("ky")) & _possible(percent))
        .where(F.col("nx") * 100 >= F.col("ny") * percent)
        .select("x", "y", "nx", "ny")
        .distinct()
    )
    more = _links(single, second, order, words, percent)
    drop(spark, open_path)
    order.destroy()
    return members, links.unionByName(more)


def near_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id), a row for each row of docs; see jaccard_links.

    component_id is the smallest id that links and equal sets reach, the row's
    own id included; null where the id is null.
    """
    members, links = jaccard_links(docs, words, percent)
    found, _ = save(connected_components(links, "x", "y"), "components")
    return members.join(found, members["class_id"] == found["id"], "left").select(
        "doc_id",
        "n_shingles",
        F.col("class_id"),
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "class_id")).alias("component_id"),
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near copies, the one with the smallest id, and one of repeated rows; all columns stay."""
    kept = drop_ids(docs, near_components(docs).where("doc_id <> component_id").select("doc_id"))
    return one_row_each(kept, F.sha2(text_of(), 256))


def op4_ngram_jaccard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return near_components(docs, words=4, percent=85).select("doc_id", "n_shingles", "component_id")
