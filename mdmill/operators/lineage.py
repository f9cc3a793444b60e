"""Lineage graphs and running ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mdmill.operators.components import connected_components
from mdmill.session import save

CELL = 1024


def lineage_graph(records: DataFrame, mappings: DataFrame, deliveries: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of batches, golden codes, raw rows, source systems, plants, categories, issues and target systems.

    records (row_id, system_source, plant_code, std_category), mappings
    (batch_id, row_id, mdm_code), deliveries (mdm_code, target_system,
    plant_code), issues (row_id, code). Nodes are (node, type), edges (src,
    dst, relation) with one undirected edge a pair. Blank ends have no edge.
    """
    tag = lambda t, c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(t + ":"), F.col(c).cast("string")))
    # Ends are told apart before they become texts. No two kinds join the same types of nodes, so no pair has two relations.
    edge = lambda df, a, b, r: df.select(F.col(a[1]).alias("x"), F.col(b[1]).alias("y")).distinct().select(tag(a[0], "x").alias("a"), tag(b[0], "y").alias("b"), F.lit(r).alias("relation"))
    parts = [
        edge(mappings, ("BATCH", "batch_id"), ("MASTER", "mdm_code"), "CONTAINS"),
        edge(mappings, ("RAW", "row_id"), ("MASTER", "mdm_code"), "MERGED_INTO"),
        edge(records, ("RAW", "row_id"), ("SYSTEM", "system_source"), "FROM_SYSTEM"),
        edge(records, ("RAW", "row_id"), ("PLANT", "plant_code"), "AT_PLANT"),
        edge(records, ("RAW", "row_id"), ("CATEGORY", "std_category"), "CLASSIFIED_AS"),
        edge(issues, ("RAW", "row_id"), ("ISSUE", "code"), "HAS_ISSUE"),
        edge(deliveries, ("MASTER", "mdm_code"), ("TARGET_SYSTEM", "target_system"), "DELIVERED_TO"),
        edge(deliveries, ("MASTER", "mdm_code"), ("PLANT", "plant_code"), "USED_AT"),
    ]
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    edges = edges.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "relation")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.withColumn("type", F.substring_index("node", ":", 1)), edges


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(measure, n): nodes of each type, all nodes, edges, connected components."""
    numbered, _ = save(edges.select(F.col("src"), F.col("dst")), "graph")
    parts = connected_components(numbered)
    total = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")
    single = total("components", parts.select("component").distinct())
    by_type = nodes.groupBy(F.concat(F.lit("type "), "type").alias("measure")).agg(F.count("*").alias("n"))
    return by_type.unionByName(total("nodes", nodes)).unionByName(total("edges", edges)).unionByName(single)


def lineage_stats(records: DataFrame, mappings: DataFrame, deliveries: DataFrame, issues: DataFrame) -> DataFrame:
    """graph_stats of lineage_graph without the graph: values are counted, texts of nodes and edges are not made.

    Rows and golden codes carry the smallest component of the systems, plants,
    categories, issues and targets next to them; those are few, and what their
    common rows and codes join is found among them alone. Mappings are joined
    with these components only where more than one is left.
    """
    spark = records.sparkSession
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    # Keys of one type from several tables are compared as they are where their data types agree, else as texts.
    alike = lambda *ends: len({df.schema[c].dataType for df, c in ends}) == 1
    plain = {"batch_id": True, "row_id": alike((mappings, "row_id"), (records, "row_id"), (issues, "row_id")), "mdm_code": alike((mappings, "mdm_code"), (deliveries, "mdm_code"))}
    end = lambda c: F.when(~blank(c), F.col(c) if plain.get(c) else F.col(c).cast("string")).alias(c)
    ends = lambda df, *columns: df.select(*(end(c) for c in columns))
    tags = {"system_source": "SYSTEM", "plant_code": "PLANT", "std_category": "CATEGORY", "code": "ISSUE", "target_system": "TARGET_SYSTEM"}
    any_of = lambda *columns: F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull()

    contains = ends(mappings, "batch_id", "mdm_code").where("batch_id IS NOT NULL AND mdm_code IS NOT NULL").distinct()
    merged, _ = save(ends(mappings, "batch_id", "row_id", "mdm_code").select("row_id", "mdm_code", F.col("batch_id").isNotNull().alias("in_batch")).where("mdm_code IS NOT NULL AND (row_id IS NOT NULL OR in_batch)").distinct(), "merged")
    known, _ = save(ends(records, "row_id", "system_source", "plant_code", "std_category").where(F.col("row_id").isNotNull() & any_of("system_source", "plant_code", "std_category")).distinct(), "known")
    found, _ = save(ends(issues, "row_id", "code").where("row_id IS NOT NULL AND code IS NOT NULL").distinct(), "found")
    given, _ = save(ends(deliveries, "mdm_code", "target_system", "plant_code").where(F.col("mdm_code").isNotNull() & any_of("target_system", "plant_code")).distinct(), "given")
    pairs = [merged.select("row_id", "mdm_code"), *(known.select("row_id", c) for c in ("system_source", "plant_code", "std_category")), found, *(given.select("mdm_code", c) for c in ("target_system", "plant_code"))]

    def near(column: str, *tables: DataFrame) -> DataFrame:
        """(column, hubs): what stands next to a row or a golden code."""
        rows = [t.select(column, F.array_compact(F.array(*(F.concat(F.lit(tags[c] + ":"), c) for c in t.columns if c in tags))).alias("hubs")) for t in tables]
        return reduce(DataFrame.unionByName, rows).groupBy(column).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("hubs")))).alias("hubs"))

    nears = {c: save(near(c, *tables), "near")[0] for c, tables in {"row_id": (known, found), "mdm_code": (given,)}.items()}
    ties = reduce(DataFrame.union, (n.select(F.col("hubs")[0].alias("src"), F.explode("hubs").alias("dst")).distinct() for n in nears.values())).distinct()
    labels, _ = save(connected_components(ties), "labels")
    seen = {"row_id": (merged, known, found), "mdm_code": (merged, given)}
    named = {}
    for (column, tables), kind in zip(seen.items(), ("RAW", "MASTER")):
        keys = reduce(DataFrame.union, (t.select(column) for t in tables)).where(F.col(column).isNotNull()).distinct()
        own = F.concat(F.lit(kind + ":"), F.col(column).cast("string"))
        rows = keys.join(nears[column].select(column, F.col("hubs")[0].alias("id")), column, "left").join(labels, "id", "left")
        named[column], _ = save(rows.select(column, F.coalesce("component", "id", own).alias("name")), "named")

    names, _ = save(reduce(DataFrame.union, (n.select("name").distinct() for n in named.values())).distinct(), "names")
    left = names.count()
    if left > 1:
        code = named["mdm_code"].withColumnRenamed("name", "dst")
        merges = merged.join(named["row_id"].withColumnRenamed("name", "src"), "row_id").join(code, "mdm_code").select("src", "dst")
        # A batch ties what its codes belong to; it is in no other edge.
        of_batch, _ = save(contains.join(code, "mdm_code").select("batch_id", "dst").distinct(), "of_batch")
        mixed = of_batch.groupBy("batch_id").agg(F.min("dst").alias("src"), F.max("dst").alias("last")).where("src <> last")
        more = merges.where("src <> dst").union(of_batch.join(mixed, "batch_id").select("src", "dst").where("src <> dst")).distinct()
        joined = connected_components(more)
        left += joined.where("id = component").count() - joined.count()

    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")
    values = lambda c, *tables: reduce(DataFrame.union, (t.select(c) for t in tables)).where(F.col(c).isNotNull()).distinct()
    batches = contains.groupBy("batch_id").agg(F.count("*").alias("edges")).agg(F.count("*").alias("batches"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"))
    parts = [batches.select(F.expr("stack(2, 'type BATCH', batches, 'edges', edges) AS (measure, n)"))]
    parts += [count("edges", p.where(" AND ".join(f"{c} IS NOT NULL" for c in p.columns)).distinct()) for p in pairs]
    parts += [count("type RAW", named["row_id"]), count("type MASTER", named["mdm_code"]), count("type SYSTEM", values("system_source", known)), count("type PLANT", values("plant_code", known, given))]
    parts += [count("type CATEGORY", values("std_category", known)), count("type ISSUE", values("code", found)), count("type TARGET_SYSTEM", values("target_system", given))]
    counts, _ = save(reduce(DataFrame.union, parts), "counts")
    of_type = counts.where("measure <> 'edges'")
    total = lambda name, df: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(name).alias("measure"), "n")
    all_parts = total("components", spark.range(1).select(F.lit(left).cast("long").alias("n")))
    return of_type.where("n > 0").unionByName(total("nodes", of_type)).unionByName(total("edges", counts.where("measure = 'edges'"))).unionByName(all_parts)


def running_total(rows: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """rows with `name`: the sum of amount over all rows up to this one in the order of the unique columns `order`.

    Sorted ranges are summed apart; only one number a range goes through a
    single window, so no task holds the rows of another.
    """
    ranged, _ = save(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("__range").agg(F.sum(amount).alias("s"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sums.select("__range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__offset")))  # a row for each range
    own = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(offsets, "__range").withColumn(name, F.col("__offset") + F.sum(amount).over(own)).drop("__range", "__offset")


def row_numbers(rows: DataFrame, key: str, order: list[str], name: str = "row_no") -> DataFrame:
    """rows with a gapless number from 1 in each key, by the unique columns `order`.

    Numbers run over sorted ranges and start anew where a key does, so a key
    with most rows is no task of its own.
    """
    placed, _ = save(running_total(rows.withColumn("__one", F.lit(1)), [key, *order], "__one", "__k").drop("__one"), "placed")
    first = placed.groupBy(F.col(key).alias("__key")).agg(F.min("__k").alias("__first"))
    return placed.join(first, F.col(key).eqNullSafe(F.col("__key"))).withColumn(name, F.col("__k") - F.col("__first") + 1).drop("__k", "__key", "__first")


def assign_to_ranges(batches: DataFrame, mappings: DataFrame, order: list[str]) -> DataFrame:
    """(k, batch_id): the k-th mapping goes to the batch whose running count covers k.

    batches (batch_id, n), mappings with the unique columns `order`, none of
    which has a batch yet. If the batches' counts do not add up to the number
    of mappings, nothing is assigned: the result is empty. Ranges and places
    meet by cells of CELL places instead of a comparison of all pairs.
    """
    if (batches.agg(F.sum("n")).first()[0] or 0) != mappings.count():
        return batches.sparkSession.createDataFrame([], f"k long, batch_id {batches.schema['batch_id'].dataType.simpleString()}")
    spans = running_total(batches, ["batch_id"], "n", "hi").withColumn("lo", F.col("hi") - F.col("n"))
    cells = F.sequence(F.floor((F.col("lo") + 1) / CELL), F.floor(F.col("hi") / CELL))
    spans = spans.where("n > 0").select("batch_id", "lo", "hi", F.explode(cells).alias("cell"))
    placed = running_total(mappings.withColumn("__one", F.lit(1)), order, "__one", "k").select("k", F.floor(F.col("k") / CELL).alias("cell"))
    return placed.join(spans, "cell").where("k > lo AND k <= hi").select("k", "batch_id")
