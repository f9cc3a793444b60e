"""Sharding by a k-d tree over document metadata."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mdmill.session import drop, save, table

#: Bins of one histogram pass. A pass sends one row a node to the driver.
BINS = 1024
#: A cut may miss its weight by this share of a shard.
CUT_SHARE = 0.002
#: A group of equal texts up to this share of a shard is never cut.
WHOLE_SHARE = 0.02
#: Rows of one window when slots are numbered.
SLOT_ROWS = 20_000


@dataclass
class Search:
    """The search for the weighted median of a node that holds `shards` shards, from `first` on.

    keys are numbers of the point columns: the widest dimension, then the ties.
    fixed are the values of the keys that are settled, lo and hi bound the next.
    """

    first: int
    shards: int
    keys: list[int]
    lo: int
    hi: int
    aim: float
    below: float = 0.0
    fixed: list[int] = field(default_factory=list)

    @property
    def key(self) -> int:
        return self.keys[len(self.fixed)]


def _rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few literal rows, a broadcast's right side; there are at most as many as shards."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    cells = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows]
    typed = [F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in schema.split(", ")]
    return F.broadcast(df.sparkSession.range(1).select(F.inline(F.array(*cells))).select(*typed))


def kd_tree(points: DataFrame, shards: int, dims: list[str], ties: list[str], weight: str = "size") -> DataFrame:
    """points with `shard`: split at weighted medians along the widest dimension until each leaf is one shard.

    points is narrow; dims, ties and weight are long columns without nulls. All
    nodes of a level are cut together: a pass sums the weight in BINS bins of
    each node's key range, and the bin that holds the median is searched again,
    then by the tie columns, until it is lighter than the tolerance. The driver
    gets one row a node and pass, so its share is bounded by the number of
    shards. A node with k shards is cut at the weight share of k // 2 of them.
    """
    columns = list(dict.fromkeys([*dims, *ties]))
    at = F.array(*columns)
    spans = points.agg(
        F.sum(weight).alias("weight"),
        *(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))),
    ).first()
    nodes = {0: shards}
    level, path = points.withColumn("shard", F.lit(0)), None
    if spans["weight"] is None:
        return level
    while any(k > 1 for k in nodes.values()):
        boxes = (
            level.groupBy("shard")
            .agg(
                F.sum(weight).alias("weight"),
                *(f(c).alias(f"{n}_{c}") for c in dims for n, f in (("lo", F.min), ("hi", F.max))),
            )
            .collect()
        )
        searches = []
        for box in boxes:
            if (k := nodes[box["shard"]]) > 1:
                share = lambda c: (box[f"hi_{c}"] - box[f"lo_{c}"]) / (spans[f"hi_{c}"] - spans[f"lo_{c}"] or 1)  # noqa: B023,E731
                widest = max(dims, key=share)
                keys = [columns.index(c) for c in (widest, *(c for c in ties if c != widest))]
                aim = box["weight"] * (k // 2) / k
                searches.append(Search(box["shard"], k, keys, box[f"lo_{widest}"], box[f"hi_{widest}"], aim))
        cuts = []
        while searches:
            searches, found = _narrow(level, at, searches, spans, columns, weight, spans["weight"] / shards)
            cuts += found
        by = _rows(
            level,
            [(s.first, s.first + s.shards // 2, *_padded(s.keys), *_padded([*s.fixed, v])) for s, v in cuts],
            "of int, upper int, k0 int, k1 int, k2 int, v0 long, v1 long, v2 long",
        )
        low = F.lit(False)
        for i in (2, 1, 0):
            x, v = F.element_at(at, F.col(f"k{i}") + 1), F.col(f"v{i}")
            low = (x < v) | ((x == v) & low)
        side = F.when(F.col("of").isNull() | F.coalesce(low, F.lit(False)), F.col("shard")).otherwise(F.col("upper"))
        level, done = save(
            level.join(by, F.col("shard") == F.col("of"), "left").select(*points.columns, side.alias("shard")), "level"
        )
        if path:
            drop(points.sparkSession, path)
        path = done
        for first, k in list(nodes.items()):
            if k > 1:
                nodes |= {first: k // 2, first + k // 2: k - k // 2}
    return level


def _padded(values: list[int]) -> list[int | None]:
    return [*values, None, None, None][:3]


def _narrow(level, at, searches, spans, columns, weight, target):
    """One histogram pass: the searches that are not over yet, and (search, value) of those that are."""
    by_node = {s.first: s for s in searches}
    rows = [
        (s.first, s.key, float(s.aim - s.below), s.lo, s.hi, *_padded(s.keys)[:2], *_padded(s.fixed)[:2]) for s in searches
    ]
    table = _rows(level, rows, "of int, k int, aim double, lo long, hi long, k0 int, k1 int, f0 long, f1 long")
    key = F.element_at(at, F.col("k") + 1)
    same = [F.col(f"f{i}").isNull() | (F.element_at(at, F.col(f"k{i}") + 1) == F.col(f"f{i}")) for i in (0, 1)]
    share = (key.cast("double") - F.col("lo")) / (F.col("hi").cast("double") - F.col("lo") + 1)
    sums = (
        level.join(table, F.col("shard") == F.col("of"))
        .where(same[0] & same[1] & key.between(F.col("lo"), F.col("hi")))
        .select("of", "aim", weight, F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin"), key.alias("key"))
        .groupBy("of", "aim", "bin")
        .agg(F.sum(weight).alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    )
    window = Window.partitionBy("of").orderBy("bin")
    found = (
        sums.withColumns({"upto": F.sum("w").over(window), "last": F.lead("bin").over(window).isNull()})
        .where((F.col("upto") >= F.col("aim")) | F.col("last"))
        .groupBy("of")
        .agg(F.min_by(F.struct("w", "lo", "hi", "upto"), "bin").alias("b"))
        .select("of", "b.*")
        .collect()
    )
    going, over = [], []
    for row in found:
        s = by_node[row["of"]]
        before = s.below + row["upto"] - row["w"]
        single = row["lo"] == row["hi"]
        left = len(s.keys) - len(s.fixed)
        light = row["w"] <= (WHOLE_SHARE if single and left == 2 else CUT_SHARE) * target
        if light or (single and left == 1):
            over.append((s, row["lo"] if s.aim - before < row["w"] / 2 else row["hi"] + 1))
            continue
        s.below = before
        if single:
            s.fixed.append(row["lo"])
            name = columns[s.key]
            s.lo, s.hi = spans[f"lo_{name}"], spans[f"hi_{name}"]
        else:
            s.lo, s.hi = row["lo"], row["hi"]
        going.append(s)
    return going, over


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row of docs.

    The law is `bytes`: shards are the leaves of a k-d tree over (size, CRC-32
    of the text) and have nearly equal bytes. Both dimensions come from the
    text, so equal texts fall together; a group of equal texts that weighs more
    than WHOLE_SHARE of a shard is cut by id where a median falls in it, else
    one group could outweigh a shard. A null text has no bytes; null ids sort
    first. Repeated rows may fall in different shards only where such a group
    is cut. With fewer rows than shards some shards stay empty. An empty table
    gives an empty result. Other columns are ignored.

    The text is read once; all passes run over (id, size, crc). Slots are
    numbered in windows of about SLOT_ROWS rows, on top of the windows' counts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    points, _ = save(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(F.col(id_col), F.lit(-1)).cast("long").alias("id_order"),
        ),
        "points",
    )
    leaves = kd_tree(points, shards, ["size", "text_crc32"], ["size", "text_crc32", "id_order"])
    parts = max(1, points.count() // (shards * SLOT_ROWS))
    placed = leaves.withColumn("part", F.pmod(F.xxhash64("id_order"), F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("id_order", "text_crc32", "size")
    return (
        placed.withColumn("rank", F.row_number().over(within) - 1)
        .join(starts, ["shard", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("start") + F.col("rank")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op2_kd_sharding(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))
