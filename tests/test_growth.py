"""Steps whose memory or time must not grow faster than the input: no shuffle of what a row makes by itself, equal texts once."""

import random
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from mdmill.functions import semantics
from mdmill.operators import components, knowledge, lineage
from tests.test_sizes import written  # noqa: F401


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hashed_vectors_are_made_row_by_row(spark, monkeypatch):
    monkeypatch.setattr(semantics, "VECTOR_ROWS", 2)
    texts = ["ab1", " ", "SKF 轴承", "", "ab1", "zz zz 9", "DN50"]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    vectors = semantics.hashed_vectors(items, semantics.pieces(semantics.bare(F.col("t"))))
    assert "Exchange" not in _plan(vectors)
    want = {}
    for i, t in enumerate(texts):
        t = "".join(t.lower().split())
        runs = "".join(c if c.isascii() else " " for c in t).split()
        summed = {}
        for piece in [*t, *(t[j : j + 2] for j in range(len(t) - 1)), *runs]:
            d = sha256(piece.encode()).digest()
            at = int.from_bytes(d[:4], "big") % 384
            summed[at] = summed.get(at, 0) + (1 if d[4] % 2 else -1)
        norm = sum(v * v for v in summed.values()) ** 0.5
        want |= {(i, at): v / norm for at, v in summed.items() if v}
    assert {(r["id"], r["idx"]): r["w"] for r in vectors.collect()} == pytest.approx(want)


def test_index_of_equal_texts_and_none(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "ab"), (4, "!")], "key long, content string")
    found = {r["key"]: (r["idx"], r["w"]) for r in knowledge.build_index(rows).collect()}
    assert found[1] == found[3] and found[2] == ([], []) and found[1][0] == sorted(found[1][0]) and len(found[4][0]) == 1


def test_text_pairs_once_a_pair(spark, written):  # noqa: F811
    seen = written(knowledge)
    texts = [("ab1", "ab1"), ("SKF 6310", "skf63"), (None, "x"), ("", "")]
    pairs = spark.createDataFrame([(i, *texts[i % 4]) for i in range(40)], "id long, a string, b string")
    found = {r["id"]: (r["dense"], r["chars"]) for r in knowledge.text_pairs(pairs).collect()}
    assert seen["rated"] == 4 and len(found) == 40
    assert found[0] == (1.0, 1.0) and found[2] == (0.0, 0.0) and found[3] == (0.0, 1.0) and 0 < found[1][0] < 1
    assert all(found[i] == found[i % 4] for i in found)


def test_frequencies_are_counted_inside_the_row(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "b"]), (2, ["x"]), (3, [])], "id long, t array<string>")
    from mdmill.functions import text

    found = rows.select("id", text.frequencies(F.col("t")).alias("f"))
    assert {r["id"]: [tuple(x) for x in r["f"]] for r in found.collect()} == {1: [("a", 0.25), ("b", 0.75)], 2: [("x", 1.0)], 3: []}


@pytest.mark.parametrize("name, stored", [("txt14_hash_embedding", "standard"), ("txt32_conditions", "conditions"), ("txt16_lexical", "kinds")])
def test_equal_texts_are_read_once(spark, written, monkeypatch, name, stored):  # noqa: F811
    from mdmill import registry_operators, session

    seen = written(session) if stored == "kinds" else written(registry_operators)
    names = [f"bolt {i % 5}" for i in range(60)]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "row_id long, material_name string").withColumn("description", F.lit("304"))
    monkeypatch.setattr(registry_operators, "materials", lambda *_: rows)
    found = registry_operators.QUERIES[name](spark, "").collect()
    assert seen[stored] <= 30 and len(found) == {"txt32_conditions": 60, "txt16_lexical": 56}.get(name, len(found))


def test_lineage_edges_are_told_apart_once(spark):
    from mdmill.operators import lineage

    records = spark.createDataFrame([(1, "SAP", "SH", "x"), (2, "", "BJ", "x")], "row_id long, system_source string, plant_code string, std_category string")
    mappings = spark.createDataFrame([(7, 1, 1), (7, 1, 1), (8, 2, None)], "batch_id long, row_id long, mdm_code long")
    deliveries = spark.createDataFrame([(1, "WMS", "SH")] * 3, "mdm_code long, target_system string, plant_code string")
    issues = spark.createDataFrame([(2, "NO_SOURCE")], "row_id long, code string")
    _, edges = lineage.lineage_graph(records, mappings, deliveries, issues)
    assert _plan(edges).count("Exchange hashpartitioning") == 8  # one a kind of edge, none over all
    assert sorted(tuple(r) for r in edges.collect()) == sorted([
        ("BATCH:7", "MASTER:1", "CONTAINS"), ("MASTER:1", "RAW:1", "MERGED_INTO"), ("RAW:1", "SYSTEM:SAP", "FROM_SYSTEM"), ("PLANT:SH", "RAW:1", "AT_PLANT"), ("PLANT:BJ", "RAW:2", "AT_PLANT"),
        ("CATEGORY:x", "RAW:1", "CLASSIFIED_AS"), ("CATEGORY:x", "RAW:2", "CLASSIFIED_AS"), ("ISSUE:NO_SOURCE", "RAW:2", "HAS_ISSUE"), ("MASTER:1", "TARGET_SYSTEM:WMS", "DELIVERED_TO"), ("MASTER:1", "PLANT:SH", "USED_AT"),
    ])


@pytest.fixture
def nothing_small(spark):
    """Tables are joined as large ones are, unless the code says that one is small."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_a_unit_is_not_brought_into_one_task(spark, tmp_path, nothing_small):
    from mdmill.sources import stored

    rows = spark.range(40).select((F.col("id") % 4).alias("batch_id"), "id")
    for unit in ("low", "high"):
        stored.publish(spark, str(tmp_path), unit, {"t": rows.where(f"id {'<' if unit == 'low' else '>='} 9")})
    found = stored.published(spark, str(tmp_path), "t")
    assert "Exchange hashpartitioning" not in _plan(found)
    assert {r["unit"]: r["count"] for r in found.groupBy("unit").count().collect()} == {"low": 9, "high": 31}


def test_edges_look_up_doubtful_ends_only(spark, written):  # noqa: F811
    from mdmill.plans import graph, relations

    seen = written(graph)
    data = "/root/testdata/sf0.001"
    edges = graph.QUERIES["gr1_edge_attributes"](spark, data)
    assert seen["mappings"] > 0 and "nodes" not in seen
    marks = {r["src"] for r in edges.where("name = 'relation' AND value = 'FINGERPRINTS'").select("src").collect()}
    assert 0 < len(marks) <= seen["doubtful"] < edges.count() / 2
    shared = {"mappings": spark.createDataFrame([(7, 0, 5)], "mapping_id long, batch_id long, mdm_code long")}
    assert not any("lineitem" in f for f in relations.standin(spark, data, "graph_reviews", shared).inputFiles())


def test_texts_of_a_search_are_bared_once(spark, monkeypatch):
    from mdmill.operators import retrieve

    saved = {}
    plain = retrieve.save

    def save(df, name="t"):
        out = plain(df, name)
        saved[name] = out[0]
        return out

    monkeypatch.setattr(retrieve, "save", save)
    asked = spark.createDataFrame([(1, "Gate Valve 7"), (2, "bolt"), (3, "bolt")], "query_id long, text string")
    entries = spark.createDataFrame([("7", "gate valve"), ("8", "Bolt M8")], "code string, content string")
    aliases = spark.createDataFrame([("8", "stud,BO LT")], "target string, keywords string")
    found = retrieve.hybrid_search(asked, entries, aliases)
    assert {r["id"]: (r["bare"], r["digits"]) for r in saved["asked"].collect()} == {1: ("gatevalve7", "7"), 2: ("bolt", "")}
    best = {r["query_id"]: (r["code"], r["rule"]) for r in found.where("rank = 1").collect()}
    assert best == {1: ("7", 1.0), 2: ("8", 1.0), 3: ("8", 1.0)}


def test_nodes_are_made_from_shared_standins_and_not_stored(spark, written):  # noqa: F811
    from mdmill.plans import graph

    seen = written(graph)
    nodes = graph.QUERIES["gr1_node_attributes"](spark, "/root/testdata/sf0.001")
    assert seen["mappings"] > 0 and "nodes" not in seen and nodes.columns == ["batch_id", "node", "name", "value"]


def _lineage(spark, mappings, records, deliveries, issues, batch="long", code="long", given_code="long"):
    return (
        spark.createDataFrame(records, "row_id long, system_source string, plant_code string, std_category string"),
        spark.createDataFrame(mappings, f"batch_id {batch}, row_id long, mdm_code {code}"),
        spark.createDataFrame(deliveries, f"mdm_code {given_code}, target_system string, plant_code string"),
        spark.createDataFrame(issues, "row_id long, code string"),
    )


def _same_stats(parts, tables):
    """lineage_stats against a count of texts in Python; tables are the rows of mappings, records, deliveries and issues."""
    mappings, records, deliveries, issues = tables
    ends = [("BATCH", b, "MASTER", m) for b, _, m in mappings] + [("RAW", r, "MASTER", m) for _, r, m in mappings] + [("RAW", r, "ISSUE", c) for r, c in issues]
    ends += [("RAW", r, kind, x[i]) for r, *x in records for i, kind in enumerate(("SYSTEM", "PLANT", "CATEGORY"))]
    ends += [("MASTER", m, kind, x[i]) for m, *x in deliveries for i, kind in enumerate(("TARGET_SYSTEM", "PLANT"))]
    edges = {(f"{a}:{x}", f"{b}:{y}") for a, x, b, y in ends if x not in (None, "") and y not in (None, "")}
    nodes = {n for e in edges for n in e}
    of = {n: n for n in nodes}
    for a, b in edges:
        of = {n: of[b] if c == of[a] else c for n, c in of.items()}
    want = Counter("type " + n.split(":")[0] for n in nodes) | {"nodes": len(nodes), "edges": len(edges), "components": len(set(of.values()))}
    found = [tuple(r) for r in lineage.lineage_stats(*parts).collect()]
    assert sorted(found) == sorted(want.items())
    return dict(found)


def test_lineage_stats_make_no_graph(spark, written):  # noqa: F811
    from mdmill import registry_operators

    mappings = [(i % 50, i % 40, i % 40) for i in range(400)]
    records = [(i, ("SAP", "EAM")[i % 2], "P", f"c{i % 3}") for i in range(45)]
    deliveries = [(i % 40, ("SAP", "WMS")[i % 2], "P") for i in range(90)]
    parts = _lineage(spark, mappings, records, deliveries, [(1, "X"), (2, "")])
    got = _same_stats(parts, (mappings, records, deliveries, [(1, "X"), (2, "")]))
    assert got["components"] == 1 and got["type RAW"] == 45
    assert got == {r["measure"]: r["n"] for r in lineage.graph_stats(*lineage.lineage_graph(*parts)).collect()}
    # Components are looked for among the systems, plants and so on alone; before, all edges were written in each round.
    seen = written(components)
    got = {r["measure"]: r["n"] for r in registry_operators.QUERIES["gr2_graph_stats"](spark, "/root/testdata/sf0.001").collect()}
    assert got["components"] == 1 and got["nodes"] > 1000 and 0 < seen["edges"] < 40


def test_lineage_stats_of_many_components(spark):
    # Codes without a delivery, rows without a record, blank ends, batches between components, a batch of null, rows that repeat.
    mappings = [(1, 1, 1), (1, 1, 1), (2, 2, 2), (3, 3, 3), (3, 4, 4), (4, None, 5), (None, 6, 6), (5, 50, 51), (6, 52, 51), (7, 60, 61), (8, 60, None), (9, None, None), (10, 70, 71), (10, 72, 73), (11, None, 73), (11, None, 74)]
    records = [(1, "SAP", "", None), (2, "EAM", "P2", "c"), (3, "", None, ""), (4, "WMS", "P3", ""), (80, "", "P4", "d"), (81, "OLD", "P4", ""), (81, "OLDER", "", ""), (None, "X", "Y", "Z")]
    deliveries = [(1, "T1", ""), (2, "", "P2"), (2, "T2", ""), (90, "T3", "P9"), (90, "T4", ""), (None, "T5", "P5"), (91, "", None)]
    issues = [(1, "I1"), (95, "I2"), (96, "I2"), (96, None)]
    assert _same_stats(_lineage(spark, mappings, records, deliveries, issues), (mappings, records, deliveries, issues))["components"] > 5
    texts = [(b and str(b), r, m and str(m)) for b, r, m in mappings] + [("", 1, "1"), ("12", 1, "")]
    _same_stats(_lineage(spark, texts, records, deliveries, issues, "string", "string"), (texts, records, deliveries, issues))
    assert _same_stats(_lineage(spark, [], [], [], []), ([], [], [], [])) == {"components": 0, "edges": 0, "nodes": 0}
    rnd = random.Random(4)
    pick = lambda: rnd.choice([None, *range(30)])
    text = lambda p: rnd.choice([None, "", *(f"{p}{i}" for i in range(30))])
    tables = [(pick(), pick(), pick()) for _ in range(30)], [(pick(), text("s"), text("p"), text("c")) for _ in range(15)], [(pick(), text("t"), text("p")) for _ in range(15)], [(pick(), text("i")) for _ in range(10)]
    _same_stats(_lineage(spark, *tables), tables)
