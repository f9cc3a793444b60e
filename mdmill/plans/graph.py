"""The lineage graph of batches: 13 types of nodes, 16 relations, attributes of which the last writer wins.

Parts of nodes and edges are SQL over named relations (GRAPH_RELATIONS lists
their columns). A part gives rows (batch_id, node, place, name, value), a row
for each attribute; `place` is the order in which sources write. An edge has
no direction: its ends stand in order of their names, and a later relation
between them takes the place of an earlier one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdmill.plans import relations
from mdmill.session import save

#: The relations of a graph; all have batch_id. plants is a list in text: A,B.
GRAPH_RELATIONS = {
    "graph_batches": "filename",
    "graph_steps": "ordinal, step_code, name, status, progress",
    "graph_masters": "place, mdm_code, standard_name, category, decision, plants",
    "graph_mappings": "mapping_id, record_id, mdm_code, system_source, original_code, original_name, plant_code, similarity, decision, source_record_id, source_table, source_url, record_hash, connector_id",
    "graph_issues": "mapping_id, code, field, severity, message",
    "graph_reviews": "review_id, mdm_code, plants, reason, status, confidence",
    "graph_deliveries": "delivery_id, mdm_code, target_system, plant_code, status",
    "graph_feedback": "feedback_id, mdm_code, plant_code, accepted, rating, comment",
    "graph_blocks": "height, event_type, entity_type, entity_id, block_hash, payload_hash, previous_hash",
}
PLANTS = "('GROUP', 'SHANGHAI', 'BEIJING')"
SEES = "(:plant = 'GROUP' OR concat(',', {0}, ',') LIKE concat('%,', :plant, ',%'))"
OF_PLANT = "(:plant = 'GROUP' OR {0} = :plant)"
TEXT = "CAST({0} AS VARCHAR(200))"

#: What the parts read, one after another: masters that the plant sees, their plants, mappings of seen masters, and so on.
VIEWS = {
    "v_m": f"""SELECT * FROM {{graph_masters}} WHERE {SEES.format('plants')}""",
    "v_p": f"""SELECT batch_id, mdm_code, place, plant FROM {{v_m}} m CROSS JOIN (SELECT 'GROUP' AS plant UNION ALL SELECT 'SHANGHAI' UNION ALL SELECT 'BEIJING') k
  WHERE concat(',', plants, ',') LIKE concat('%,', plant, ',%') AND (:plant = 'GROUP' OR plant IN ('GROUP', :plant))""",
    "v_a": f"""SELECT g.*, CASE WHEN record_id IS NULL THEN concat('raw:', mapping_id) ELSE concat('record:', record_id) END AS raw, coalesce(nullif(system_source, ''), 'CSV导入') AS source FROM {{graph_mappings}} g
  WHERE {SEES.format('plant_code')} AND EXISTS (SELECT 1 FROM {{v_m}} m WHERE m.batch_id = g.batch_id AND m.mdm_code = g.mdm_code)""",
    "v_i": f"""SELECT batch_id, mapping_id, code, field, severity, message FROM {{graph_issues}} UNION ALL SELECT batch_id, mapping_id, 'REVIEW_REQUIRED', 'semantic_match', 'HIGH', '存在冲突或低置信度匹配，需人工审核' FROM {{v_a}} a
  WHERE decision = 'REVIEW' AND NOT EXISTS (SELECT 1 FROM {{graph_issues}} x WHERE x.batch_id = a.batch_id AND x.mapping_id = a.mapping_id AND x.code = 'REVIEW_REQUIRED')""",
    "v_r": f"""SELECT g.* FROM {{graph_reviews}} g WHERE status = 'REVIEW' AND {SEES.format('plants')} AND EXISTS (SELECT 1 FROM {{v_m}} m WHERE m.batch_id = g.batch_id AND m.mdm_code = g.mdm_code)""",
    "v_d": f"""SELECT g.*, concat('target:', target_system, ':', plant_code) AS target FROM {{graph_deliveries}} g WHERE {OF_PLANT.format('plant_code')} AND EXISTS (SELECT 1 FROM {{v_m}} m WHERE m.batch_id = g.batch_id AND m.mdm_code = g.mdm_code)""",
    "v_f": f"""SELECT g.* FROM {{graph_feedback}} g WHERE {OF_PLANT.format('plant_code')} AND EXISTS (SELECT 1 FROM {{v_m}} m WHERE m.batch_id = g.batch_id AND m.mdm_code = g.mdm_code)""",
    "v_b": f"""SELECT g.*, CASE WHEN entity_type = 'BATCH' THEN concat('batch:', g.batch_id) WHEN entity_type = 'MASTER' THEN concat('master:', entity_id) WHEN entity_type = 'DISTRIBUTION' AND entity_id IN {PLANTS} THEN concat('plant:', entity_id)
  WHEN entity_type = 'WORKFLOW_STEP' THEN concat('workflow:', entity_id) ELSE concat('entity:', entity_type, ':', entity_id) END AS entity, lag(height) OVER (PARTITION BY g.batch_id ORDER BY height) AS before,
  NOT (entity_type = 'DISTRIBUTION' AND entity_id IN {PLANTS} AND NOT {OF_PLANT.format('entity_id')}) AS seen FROM {{graph_blocks}} g""",
    "v_w": f"""SELECT batch_id, entity_id, count(*) AS n, max(height) AS last FROM {{graph_blocks}} WHERE entity_type = 'WORKFLOW_STEP' GROUP BY batch_id, entity_id""",
    "v_s": f"""SELECT g.*, lag(step_code) OVER (PARTITION BY g.batch_id ORDER BY ordinal) AS before, coalesce(w.n, 0) AS fingerprint_count, coalesce(w.last, 0) AS latest_fingerprint_height, coalesce(x.block_hash, '') AS latest_block_hash
  FROM {{graph_steps}} g LEFT JOIN {{v_w}} w ON w.batch_id = g.batch_id AND w.entity_id = g.step_code LEFT JOIN {{graph_blocks}} x ON x.batch_id = g.batch_id AND x.height = w.last""",
}

#: source, section, place in it, node, type, and its attributes.
NODES = [
    ("{graph_batches}", 0, "0", "concat('batch:', batch_id)", "BATCH", {"label": "filename", "entity_id": "batch_id"}),
    ("s", 1, "ordinal", "concat('workflow:', step_code)", "WORKFLOW_STEP", {"label": "concat(ordinal, '. ', name)", "entity_id": "step_code", "status": "status", "progress": "progress", "fingerprint_count": "fingerprint_count", "latest_fingerprint_height": "latest_fingerprint_height", "latest_block_hash": "latest_block_hash"}),
    ("m", 2, "place", "concat('master:', mdm_code)", "MASTER", {"label": "coalesce(nullif(standard_name, ''), CAST(mdm_code AS VARCHAR(200)))", "entity_id": "mdm_code", "decision": "decision"}),
    ("m WHERE coalesce(category, '') <> ''", 2, "place", "concat('category:', category)", "CATEGORY", {"label": "category", "entity_id": "category"}),
    ("p", 2, "place", "concat('plant:', plant)", "PLANT", {"label": "plant", "entity_id": "plant"}),
    ("a", 3, "mapping_id", "raw", "RAW", {"label": "coalesce(nullif(original_name, ''), nullif(original_code, ''), raw)", "entity_id": "coalesce(nullif(source_record_id, ''), original_code)", "material_code": "original_code", "source_system": "system_source", "plant_code": "plant_code", "source_table": "source_table", "source_url": "source_url", "record_hash": "record_hash"}),
    ("a", 3, "mapping_id", "concat('system:', source)", "SYSTEM", {"label": "source", "entity_id": "source", "connector_id": "connector_id"}),
    ("a", 3, "mapping_id", "concat('plant:', plant_code)", "PLANT", {"label": "plant_code", "entity_id": "plant_code"}),
    ("i JOIN a ON a.batch_id = i.batch_id AND a.mapping_id = i.mapping_id", 3, "i.mapping_id", "concat('issue:', i.mapping_id, ':', code)", "ISSUE", {"label": "coalesce(nullif(message, ''), code)", "entity_id": "code", "field": "field", "severity": "severity"}),
    ("r", 4, "review_id", "concat('review:', review_id)", "REVIEW", {"label": "reason", "entity_id": "review_id", "status": "status", "confidence": "confidence"}),
    ("d", 5, "delivery_id", "target", "TARGET_SYSTEM", {"label": "concat(target_system, ' · ', plant_code)", "entity_id": "target_system", "status": "status", "plant_code": "plant_code"}),
    ("d", 5, "delivery_id", "concat('plant:', plant_code)", "PLANT", {"label": "plant_code", "entity_id": "plant_code"}),
    ("f", 6, "feedback_id", "concat('feedback:', feedback_id)", "FEEDBACK", {"label": "concat(plant_code, '反馈')", "entity_id": "feedback_id", "accepted": "accepted", "rating": "rating", "comment": "comment"}),
    ("f", 6, "feedback_id", "concat('plant:', plant_code)", "PLANT", {"label": "plant_code", "entity_id": "plant_code"}),
    ("b", 7, "height", "concat('audit:', height)", "AUDIT", {"label": "concat('#', height, ' ', event_type)", "entity_id": "height", "block_hash": "block_hash", "payload_hash": "payload_hash", "previous_hash": "previous_hash"}),
    ("b WHERE entity LIKE 'entity:%'", 7, "height", "entity", "ENTITY", {"label": "concat(entity_type, ' · ', entity_id)", "entity_id": "entity_id"}),
]
#: source, section, place in it, both ends, relation, and attributes.
EDGES = [
    ("s", 1, "ordinal", "concat('batch:', s.batch_id)", "concat('workflow:', step_code)", "CONTAINS_STEP", {}),
    ("s WHERE before IS NOT NULL", 1, "ordinal", "concat('workflow:', before)", "concat('workflow:', step_code)", "NEXT_STEP", {}),
    ("m WHERE coalesce(category, '') <> ''", 2, "place", "concat('master:', mdm_code)", "concat('category:', category)", "CLASSIFIED_AS", {}),
    ("p", 2, "place", "concat('master:', mdm_code)", "concat('plant:', plant)", "AVAILABLE_TO", {}),
    ("a", 3, "mapping_id", "concat('batch:', batch_id)", "raw", "INGESTED_RECORD", {}),
    ("a", 3, "mapping_id", "concat('system:', source)", "raw", "PROVIDES_RECORD", {}),
    ("a", 3, "mapping_id", "raw", "concat('plant:', plant_code)", "OWNED_BY", {}),
    ("a", 3, "mapping_id", "raw", "concat('master:', mdm_code)", "MAPPED_TO", {"similarity": "similarity"}),
    ("i JOIN a ON a.batch_id = i.batch_id AND a.mapping_id = i.mapping_id", 3, "i.mapping_id", "raw", "concat('issue:', i.mapping_id, ':', code)", "HAS_QUALITY_ISSUE", {}),
    ("r", 4, "review_id", "concat('master:', mdm_code)", "concat('review:', review_id)", "REQUIRES_REVIEW", {}),
    ("d", 5, "delivery_id", "concat('master:', mdm_code)", "target", "DISTRIBUTED_TO", {"status": "status"}),
    ("d", 5, "delivery_id", "target", "concat('plant:', plant_code)", "DELIVERED_TO", {}),
    ("f", 6, "feedback_id", "concat('master:', mdm_code)", "concat('feedback:', feedback_id)", "VALIDATED_BY", {}),
    ("f", 6, "feedback_id", "concat('feedback:', feedback_id)", "concat('plant:', plant_code)", "SUBMITTED_BY", {}),
    ("b WHERE before IS NOT NULL", 7, "height", "concat('audit:', before)", "concat('audit:', height)", "PREVIOUS_HASH", {}),
    ("b WHERE seen", 7, "height", "concat('audit:', height)", "entity", "FINGERPRINTS", {}),
]


def _from(source: str) -> str:
    return re.sub(r"(^|JOIN )([a-z])\b", r"\1{v_\2} \2", source)


def _batch(source: str) -> str:
    return source.split()[0] + ".batch_id" if " JOIN " in source else "batch_id"


def _parts(specs: list, head: str, pair, some=lambda spec: True) -> str:
    """The union of all parts, or of some; pair makes one or more select lists of a part's attributes."""
    out = []
    for turn, (source, section, place, *ends, kind, attributes) in enumerate(specs):
        if not some(specs[turn]):
            continue
        named = {head: f"'{kind}'"} | attributes
        names = ("node",) if len(ends) == 1 else ("a", "b")
        columns = ", ".join(f"{e} AS {n}" for e, n in zip(ends, names))
        for attribute in pair({n: TEXT.format(v) for n, v in named.items()}):
            out.append(f"SELECT {_batch(source)} AS batch_id, {columns}, {section} AS section, CAST({place} AS BIGINT) AS place, {turn} AS turn, {attribute} FROM {_from(source)}")
    return " UNION ALL ".join(out)


def _map(named: dict) -> list[str]:
    return ["map(" + ", ".join(f"'{n}', {v}" for n, v in named.items()) + ") AS attributes"]


def _long(named: dict) -> list[str]:
    return [f"'{n}' AS name, {v} AS value" for n, v in named.items()]


def attributes(spark: SparkSession, plant: str = "GROUP", **tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attributes of nodes and of edges in long form: (batch_id, node, name, value), (batch_id, src, dst, name, value), the last writer's value each.

    What the plant sees is stored once; every part reads it once. An edge to a
    node that is not there (an audit block of a master out of sight) is none.
    """
    seen = _seen(spark, plant, tables)
    nodes, _ = save(_last(_flat(spark, NODES, "node_type", seen), "batch_id", "node"), "nodes")
    return nodes, _edges(spark, seen, nodes.where("name = 'node_type'"))


def _sure(edge: tuple) -> bool:
    """Does each row of a part of EDGES have a node at its second end? A part of NODES makes it from the same row, or a view has looked: v_a keeps mappings of seen masters only."""
    source, end, relation = edge[0], edge[4], edge[5]
    return relation == "MAPPED_TO" or any(end == n[3] and n[0] in (source, source.split(" WHERE ")[0]) for n in NODES)


def node_attributes(spark: SparkSession, plant: str = "GROUP", **tables: DataFrame) -> DataFrame:
    """The nodes of attributes() alone, not stored."""
    return _last(_flat(spark, NODES, "node_type", _seen(spark, plant, tables)), "batch_id", "node")


def edge_attributes(spark: SparkSession, plant: str = "GROUP", **tables: DataFrame) -> DataFrame:
    """The edges of attributes() alone: of nodes only the names are made."""
    seen = _seen(spark, plant, tables)
    return _edges(spark, seen, relations.run(spark, _parts(NODES, "node_type", lambda _: ["0 AS k"]), None, **seen))


def _seen(spark: SparkSession, plant: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    seen = dict(tables)
    for name, sql in VIEWS.items():
        seen[name], _ = save(relations.run(spark, sql, {"plant": plant}, **seen), name)
    return seen


def _flat(spark: SparkSession, specs: list, head: str, seen: dict[str, DataFrame], some=lambda spec: True) -> DataFrame:
    return relations.run(spark, _parts(specs, head, _map, some), None, **seen).select("*", F.explode("attributes").alias("name", "value")).drop("attributes")


def _last(rows: DataFrame, *keys) -> DataFrame:
    """The last writer's value of each key and name."""
    return rows.groupBy(*keys, "name").agg(F.max_by("value", F.struct("section", "place", "turn", "value")).alias("value"))


def _edges(spark: SparkSession, seen: dict[str, DataFrame], nodes: DataFrame) -> DataFrame:
    """The edges; only ends that may lack a node are looked up, so that the few nodes in which most edges end (plants, categories) do not meet all of them."""
    sure = _flat(spark, EDGES, "relation", seen, _sure).where("batch_id IS NOT NULL AND b IS NOT NULL")
    doubtful, _ = save(_flat(spark, EDGES, "relation", seen, lambda e: not _sure(e)), "doubtful")
    wanted, _ = save(doubtful.select("batch_id", "b").distinct(), "wanted")
    there = nodes.select("batch_id", F.col("node").alias("b")).join(wanted, ["batch_id", "b"], "left_semi").distinct()
    edges = sure.unionByName(doubtful.join(there, ["batch_id", "b"], "left_semi"))
    return _last(edges, "batch_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def governance_graph(spark: SparkSession, plant: str = "GROUP", **tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all batches, as a plant sees them: (batch_id, node, node_type, attributes), (batch_id, src, dst, relation, attributes).

    tables are the relations of GRAPH_RELATIONS. attributes are maps of texts; null values are left out.
    """
    pairs = F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("name", "value"))))

    def wide(rows: DataFrame, keys: list[str], first: str) -> DataFrame:
        one = rows.groupBy("batch_id", *keys).agg(pairs.alias("all"))
        return one.select("batch_id", *keys, F.col("all")[first].alias(first), F.map_filter("all", lambda k, _: k != first).alias("attributes"))

    nodes, edges = attributes(spark, plant, **tables)
    return wide(nodes, ["node"], "node_type"), wide(edges, ["src", "dst"], "relation")


PLANT = "SHANGHAI"


#: What several stand-ins of the graph read: it is made once.
SHARED = ("mappings", "issues")


def _standins(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    made: dict[str, DataFrame] = {}
    for name in (*SHARED, *GRAPH_RELATIONS):
        made[name], _ = save(relations.standin(spark, sf_dir, name, made), name)
    return {n: made[n] for n in GRAPH_RELATIONS}


QUERIES = {
    "gr1_node_attributes": lambda spark, sf_dir: node_attributes(spark, PLANT, **_standins(spark, sf_dir)),
    "gr1_edge_attributes": lambda spark, sf_dir: edge_attributes(spark, PLANT, **_standins(spark, sf_dir)),
}
_HEAD = "WITH " + ", ".join(f"{n} AS ({sql})" for n, sql in VIEWS.items())
_NODES = _parts(NODES, "node_type", _long)
_SQL = {
    "gr1_node_attributes": f"""{_HEAD}, n AS ({_NODES})
 SELECT batch_id, node, name, value FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, node, name ORDER BY section DESC, place DESC, turn DESC, value DESC) AS k FROM n) x WHERE k = 1""",
    "gr1_edge_attributes": f"""{_HEAD}, e AS ({_parts(EDGES, "relation", _long)}), n AS (SELECT DISTINCT batch_id, node FROM ({_NODES}) y WHERE name = 'node_type'),
 o AS (SELECT e.*, least(a, b) AS src, greatest(a, b) AS dst FROM e JOIN n ON n.batch_id = e.batch_id AND n.node = e.b)
 SELECT batch_id, src, dst, name, value FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, src, dst, name ORDER BY section DESC, place DESC, turn DESC, value DESC) AS k FROM o) x WHERE k = 1""",
}
ORACLE_SQL = {name: relations.oracle(re.sub(r"\{(v_\w)\}", r"\1", sql), {"plant": PLANT}) for name, sql in _SQL.items()}
