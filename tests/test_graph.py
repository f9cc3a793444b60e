"""The lineage graph of a small batch, as the group and as a plant see it."""

import pytest

from mdmill.plans import graph

COLUMNS = {
    "graph_batches": "batch_id long, filename string",
    "graph_steps": "batch_id long, ordinal int, step_code string, name string, status string, progress int",
    "graph_masters": "batch_id long, place long, mdm_code string, standard_name string, category string, decision string, plants string",
    "graph_mappings": "batch_id long, mapping_id long, record_id long, mdm_code string, system_source string, original_code string, original_name string, plant_code string, similarity double, decision string, source_record_id string, source_table string, source_url string, record_hash string, connector_id string",
    "graph_issues": "batch_id long, mapping_id long, code string, field string, severity string, message string",
    "graph_reviews": "batch_id long, review_id long, mdm_code string, plants string, reason string, status string, confidence double",
    "graph_deliveries": "batch_id long, delivery_id long, mdm_code string, target_system string, plant_code string, status string",
    "graph_feedback": "batch_id long, feedback_id long, mdm_code string, plant_code string, accepted boolean, rating int, comment string",
    "graph_blocks": "batch_id long, height long, event_type string, entity_type string, entity_id string, block_hash string, payload_hash string, previous_hash string",
}
ROWS = {
    "graph_batches": [(1, "a.csv")],
    "graph_steps": [(1, 1, "INGEST", "ingest", "COMPLETED", 100), (1, 2, "REVIEW", "review", "WAITING", 0)],
    "graph_masters": [(1, 1, "M1", "SKF 6312", "轴承", "AUTO_MERGE", "SHANGHAI"), (1, 2, "M2", "", "轴承", "REVIEW", "BEIJING,GROUP"), (2, 1, "M1", "other batch", "", "NEW", "GROUP")],
    "graph_mappings": [
        (1, 10, 7, "M1", "SAP", "C1", "bearing", "SHANGHAI", 0.9, "AUTO_MERGE", "S1", "MARA", "", "h1", "sap-odata"),
        (1, 11, None, "M2", "", "C2", "", "BEIJING", 0.6, "REVIEW", None, "CSV_ROW", "", "h2", "file-import"),
        (1, 12, 8, "GONE", "SAP", "C3", "x", "SHANGHAI", 0.6, "NEW", None, "", "", "", ""),
    ],
    "graph_issues": [(1, 10, "MISSING_UNIT", "unit", "MEDIUM", "no unit")],
    "graph_reviews": [(1, 5, "M2", "BEIJING", "conflict", "REVIEW", 0.6), (1, 6, "M1", "SHANGHAI", "done", "APPROVED", 0.9)],
    "graph_deliveries": [(1, 1, "M1", "SAP", "SHANGHAI", "FAILED"), (1, 2, "M1", "SAP", "SHANGHAI", "SUCCESS"), (1, 3, "M1", "SAP", "BEIJING", "SUCCESS")],
    "graph_feedback": [(1, 1, "M1", "SHANGHAI", True, 5, "good")],
    "graph_blocks": [
        (1, 1, "GOVERNED", "BATCH", "1", "b1", "p1", "0"), (1, 2, "STEP", "WORKFLOW_STEP", "INGEST", "b2", "p2", "b1"), (1, 3, "STEP", "WORKFLOW_STEP", "INGEST", "b3", "p3", "b2"),
        (1, 4, "MERGED", "MASTER", "M2", "b4", "p4", "b3"), (1, 5, "SENT", "DISTRIBUTION", "BEIJING", "b5", "p5", "b4"), (1, 6, "SET", "PROFILE", "default", "b6", "p6", "b5"),
    ],
}


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.createDataFrame(ROWS[n], c) for n, c in COLUMNS.items()}


def seen(spark, tables, plant):
    nodes, edges = graph.governance_graph(spark, plant, **tables)
    return {r["node"]: r for r in nodes.where("batch_id = 1").collect()}, {frozenset((r["src"], r["dst"])): r for r in edges.where("batch_id = 1").collect()}


def test_the_group_sees_all(spark, tables):
    nodes, edges = seen(spark, tables, "GROUP")
    assert {r["node_type"] for r in nodes.values()} == {"BATCH", "WORKFLOW_STEP", "MASTER", "CATEGORY", "PLANT", "RAW", "SYSTEM", "ISSUE", "REVIEW", "TARGET_SYSTEM", "FEEDBACK", "AUDIT", "ENTITY"}
    assert {r["relation"] for r in edges.values()} == {e[5] for e in graph.EDGES} and len({e[5] for e in graph.EDGES}) == 16
    between = lambda a, b: edges[frozenset((a, b))]["relation"]
    assert between("workflow:INGEST", "workflow:REVIEW") == "NEXT_STEP" and between("audit:2", "audit:1") == "PREVIOUS_HASH"
    assert between("raw:11", "master:M2") == "MAPPED_TO" and edges[frozenset(("record:7", "master:M1"))]["attributes"] == {"similarity": "0.9"}
    assert between("audit:6", "entity:PROFILE:default") == between("audit:5", "plant:BEIJING") == "FINGERPRINTS"
    assert between("raw:11", "issue:11:REVIEW_REQUIRED") == "HAS_QUALITY_ISSUE" and between("system:CSV导入", "raw:11") == "PROVIDES_RECORD"
    assert "record:8" not in nodes and "review:6" not in nodes
    # The last writer's attributes stay: the second delivery, the third block.
    assert nodes["target:SAP:SHANGHAI"]["attributes"]["status"] == edges[frozenset(("master:M1", "target:SAP:SHANGHAI"))]["attributes"]["status"] == "SUCCESS"
    step = nodes["workflow:INGEST"]["attributes"]
    assert (step["fingerprint_count"], step["latest_fingerprint_height"], step["latest_block_hash"]) == ("2", "3", "b3")
    assert nodes["master:M1"]["attributes"]["label"] == "SKF 6312" and nodes["master:M2"]["attributes"]["label"] == "M2"


def test_a_plant_sees_its_part(spark, tables):
    nodes, edges = seen(spark, tables, "SHANGHAI")
    assert "master:M2" not in nodes and "raw:11" not in nodes and "target:SAP:BEIJING" not in nodes and "review:5" not in nodes
    assert frozenset(("audit:4", "master:M2")) not in edges and frozenset(("audit:5", "plant:BEIJING")) not in edges
    assert {"master:M1", "record:7", "feedback:1", "plant:SHANGHAI", "audit:4"} <= set(nodes)


def test_empty_tables(spark, tables):
    nodes, edges = graph.governance_graph(spark, "GROUP", **{n: t.limit(0) for n, t in tables.items()})
    assert nodes.count() == edges.count() == 0
