"""Leader clustering and anomalies of records."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdmill.functions import rules, text
from mdmill.operators.components import connected_components
from mdmill.session import drop, save

KEYS = ["std_category", "model", "brand", "dn", "pressure"]
TREES, SAMPLE = 100, 256
#: Edges of undecided items that one task decides in order.
TASK_EDGES = 200_000


def leader_clusters(records: DataFrame) -> DataFrame:
    """(row_id, leader, score): each row in row_id order joins the oldest group whose leader it matches, or leads a new one.

    A match has the same category, no two different models, sizes or pressures,
    and a character similarity of LEADER_EDGE. Rows with the same attributes are
    one item, which acts when its first row does; an item follows the earliest
    leader it matches.
    """
    spark = records.sparkSession
    items = records.groupBy(*KEYS).agg(F.min("row_id").alias("id"))
    whole = text.standardize(F.concat(F.concat_ws(" ", "std_category", "model", "brand"), F.lit(" DN"), F.concat_ws(" ", "dn", "pressure")))
    items, _ = save(items.withColumn("letters", F.filter(F.array_distinct(F.split(F.regexp_replace(whole, r"(?U)\s+", ""), "")), lambda c: c != "")), "items")
    letters = items.select("id", "std_category", F.size("letters").alias("n"), F.explode("letters").alias("c"))
    common = letters.groupBy("std_category", "c").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "c"))
    prefix = letters.join(common, ["std_category", "c"]).withColumn("place", place)
    prefix, _ = save(prefix.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * rules.LEADER_EDGE - 1e-9) + 1).select("id", "std_category", "c"), "prefix")
    pairs = prefix.join(prefix.withColumnRenamed("id", "before"), ["std_category", "c"]).where("before < id").select("id", "before").distinct()
    side = lambda n: items.select(*(F.col(c).alias(f"{c}_{n}") for c in ("id", "model", "dn", "pressure", "letters")))
    pairs = pairs.join(side(1), F.col("id") == F.col("id_1")).join(side(2), F.col("before") == F.col("id_2"))
    for a in ("model", "dn", "pressure"):
        pairs = pairs.where(f"{a}_1 = '' OR {a}_2 = '' OR {a}_1 = {a}_2")
    both = F.size(F.array_intersect("letters_1", "letters_2"))
    alike = both / (F.size("letters_1") + F.size("letters_2") - both)
    edges, _ = save(pairs.withColumn("alike", alike).where(F.col("alike") >= rules.LEADER_EDGE).select("id", "before", "alike"), "edges")
    state, _ = leaders_in_order(items.select("id"), edges.select("id", "before"))
    leads = state.where("state = 'leads'").select(F.col("id").alias("before"))
    follows = edges.join(leads, "before").groupBy("id").agg(F.min(F.struct("before", "alike")).alias("m"))
    followers = state.where("state = 'follows'").join(follows, "id").select("id", F.col("m.before").alias("leader"), F.col("m.alike").alias("score"))
    placed = followers.unionByName(leads.select(F.col("before").alias("id"), F.col("before").alias("leader"), F.lit(1.0).alias("score")))
    return records.join(items.select(*KEYS, "id"), KEYS).join(placed, "id").select("row_id", "leader", F.round("score", 6).alias("score"))


def leaders_in_order(items: DataFrame, edges: DataFrame, task_edges: int = TASK_EDGES) -> tuple[DataFrame, int]:
    """((id, state), rounds): state is `leads` for the items that the sequential rule makes leaders, else `follows`.

    items (id), edges (id, before) with before < id. In the order of ids an item
    leads unless an earlier match leads. Every round a component of undecided
    items with up to task_edges edges is decided whole, in order, by one task;
    of a larger one the first items are, as many as that many edges join, for
    which later ones do not matter. Then what a new leader reaches follows, so
    a large component falls apart. Who is left without an edge leads.
    """
    spark = items.sparkSession
    kind = items.schema["id"].dataType
    state, state_path = save(items.select("id", F.lit("open").alias("state")), "state")
    open_edges, edges_path = save(edges.select("id", "before"), "open")
    fractions = [2.0**-k for k in range(1, 25)]
    rounds = 0
    while not open_edges.isEmpty():
        rounds += 1
        found, _ = save(connected_components(open_edges, "id", "before").select(F.col("id").alias("of"), "component"), "components")
        grouped, grouped_path = save(open_edges.join(found, F.col("id") == F.col("of")).select("component", "id", "before"), "grouped")
        sizes = grouped.groupBy("component").agg(F.count("*").alias("n"), F.percentile_approx("id", fractions, 100_000).alias("cuts"), F.min("id").alias("first"))
        fit = F.array_max(F.filter(F.arrays_zip(F.lit(fractions).alias("f"), F.col("cuts").alias("c")), lambda x: x["f"] * F.col("n") <= task_edges))["c"]
        large = sizes.where(F.col("n") > task_edges).select(F.col("component").alias("big"), F.coalesce(fit, "first").alias("last"))
        some = grouped.join(large, F.col("component") == F.col("big"), "left").where("last IS NULL OR id <= last").select("component", "id", "before")
        decided, decided_path = save(some.repartition("component").sortWithinPartitions("component", "id", "before").mapInArrow(_decide, T.StructType().add("id", kind).add("state", "string")), "decided")
        turned = state.join(decided.select("id", F.col("state").alias("now")), "id", "left").select("id", F.coalesce("now", "state").alias("state"))
        turned, turned_path = save(turned, "turned")
        led = open_edges.join(turned.where("state = 'leads'").select(F.col("id").alias("before")), "before").select("id", F.lit(True).alias("led")).distinct()
        old = (state_path, edges_path, grouped_path, decided_path, turned_path)
        turn = F.when((F.col("state") == "open") & F.col("led"), "follows").otherwise(F.col("state"))
        state, state_path = save(turned.join(led, "id", "left").select("id", turn.alias("state")), "state")
        waiting = state.where("state = 'open'").select("id")
        open_edges, edges_path = save(open_edges.join(waiting, "id", "left_semi").join(waiting.withColumnRenamed("id", "before"), "before", "left_semi").select("id", "before"), "open")
        drop(spark, *old)
    return state.select("id", F.when(F.col("state") == "follows", "follows").otherwise("leads").alias("state")), rounds


def _decide(batches):
    """The sequential rule over edges sorted by (component, id): (id, state) of each item, once all its edges were seen."""
    component, leads, at, lead = None, {}, None, True
    for batch in batches:
        said = []
        for c, item, before in zip(*(x.to_pylist() for x in batch.columns)):
            if (c, item) != (component, at):
                if at is not None:
                    leads[at] = lead
                    said.append((at, lead))
                if c != component:
                    component, leads = c, {}
                at, lead = item, True
            if before not in leads:
                leads[before] = True
                said.append((before, True))
            lead = lead and not leads[before]
        yield _said(said, kind := batch.schema.field("id").type)
    if at is not None:
        yield _said([(at, lead)], kind)


def _said(said: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in said], kind), pa.array(["leads" if x else "follows" for _, x in said], pa.string())], names=["id", "state"])


def _depth_left(n: float) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng, depth: int, out: list) -> int:
    """Append a random tree over x to out as (feature, cut, left, right, size) rows."""
    at = len(out)
    spread = np.flatnonzero(x.max(0) > x.min(0))
    out.append([-1, 0.0, -1, -1, len(x)])
    if depth > 0 and len(x) > 1 and len(spread):
        f = int(rng.choice(spread))
        cut = rng.uniform(x[:, f].min(), x[:, f].max())
        under = x[:, f] < cut
        out[at][:4] = [f, cut, _grow(x[under], rng, depth - 1, out), _grow(x[~under], rng, depth - 1, out)]
    return at


def anomalies(records: DataFrame, seed: int = 42) -> DataFrame:
    """(row_id, score, anomaly) by an isolation forest over name length, text length, has a source, has a code.

    Each tree grows from SAMPLE rows with the smallest hash of its own, in one
    group of that size; scoring needs TREES small trees only. The share of
    anomalies is 10 rows, a tenth at most; under ten rows there are none.
    """
    named = records.select(
        "row_id", F.length(F.coalesce("material_name", F.lit(""))).cast("double").alias("a"), F.length(F.coalesce("description", F.lit(""))).cast("double").alias("b"),
        (F.coalesce("system_source", F.lit("")) != "").cast("double").alias("c"), (F.coalesce("material_code", F.lit("")) != "").cast("double").alias("d"),
    )
    rows, _ = save(named, "features")
    n = rows.count()
    if n < 10:
        return rows.select("row_id", F.lit(0.0).alias("score"), F.lit(False).alias("anomaly"))
    span = min(1.0, 4.0 * SAMPLE / n)
    draws = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
    draws = draws.withColumn("h", F.pmod(F.xxhash64("row_id", "tree", F.lit(seed)), F.lit(1 << 30))).where(F.col("h") < span * (1 << 30))
    sample = draws.withColumn("k", F.row_number().over(Window.partitionBy("tree").orderBy("h", "row_id"))).where(F.col("k") <= SAMPLE)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("k")[["a", "b", "c", "d"]].to_numpy()
        _grow(x, np.random.default_rng([seed, tree]), int(np.ceil(np.log2(max(len(x), 2)))), out)
        return pd.DataFrame({"tree": tree, "node": range(len(out)), **{c: [r[i] for r in out] for i, c in enumerate(("f", "cut", "lo", "hi", "size"))}})

    grown = sample.select("tree", "k", "a", "b", "c", "d").groupBy("tree").applyInPandas(grow, "tree int, node int, f int, cut double, lo int, hi int, size long")
    forest = [t.sort_values("node")[["f", "cut", "lo", "hi", "size"]].to_numpy(float) for _, t in grown.toPandas().groupby("tree")]  # TREES trees of 2 * SAMPLE nodes at most
    held = records.sparkSession.sparkContext.broadcast(forest)
    norm = _depth_left(min(SAMPLE, n))

    def paths(batches):
        for pdf in batches:
            x, total = pdf[["a", "b", "c", "d"]].to_numpy(), np.zeros(len(pdf))
            for tree in held.value:
                at, depth = np.zeros(len(x), int), np.zeros(len(x))
                while (inner := tree[at, 0] >= 0).any():
                    f, cut = tree[at, 0].astype(int), tree[at, 1]
                    step = np.where(x[np.arange(len(x)), f] < cut, tree[at, 2], tree[at, 3]).astype(int)
                    at, depth = np.where(inner, step, at), depth + inner
                total += depth + np.array([_depth_left(s) for s in tree[at, 4]])
            yield pdf.assign(score=np.round(2.0 ** (-total / len(held.value) / norm), 6))[["a", "b", "c", "d", "score"]]

    kinds = rows.groupBy("a", "b", "c", "d").count().drop("count").mapInPandas(paths, "a double, b double, c double, d double, score double")
    scored, _ = save(rows.join(kinds, ["a", "b", "c", "d"]).select("row_id", "score"), "scored")
    cut = scored.agg(F.percentile_approx("score", 1 - min(0.1, 10 / n), 100_000)).first()[0]
    return scored.withColumn("anomaly", F.col("score") > cut)
