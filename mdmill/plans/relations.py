"""Statements over named relations, and the stand-ins that the driver tables give for them.

A statement is SQL that other engines run too. Its inputs stand in braces and
are DataFrames with the columns that RELATIONS names; values stand as :name.
`run` applies a statement to any tables. `run_standins` and `oracle` build the
inputs from driver tables, for the registry.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from mdmill.functions import rules
from mdmill.session import table
from mdmill.sources.materials import MATERIALS_SQL

#: The columns that statements read from each relation. plants is a list in text: A,B.
RELATIONS = {
    "materials": "row_id, material_code, system_source, material_name, description, category, unit, create_time, plant_code",
    "records": "materials with batch_id",
    "masters": "mdm_code, standard_name, category, plants, decision, source_count, anomaly_count, confidence",
    "origins": "row_id, source_record_id, record_hash: where records come from",
    "conflicts": "mdm_code, field, vals: fields of golden records whose members differ",
    "expected": "what (entries, aliases), n",
    "mappings": "mapping_id, batch_id, mdm_code, system_source, material_code, plant_code, material_name, similarity",
    "deliveries": "batch_id, line, mdm_code, plant_code, target_system, success, accepted, rating, comment",
    "batches": "batch_id, owner, created, classification, held, record_count",
    "sheet": "entries as their file holds them, with row_no, the row of the file",
    "entries": "full_code, major, middle, minor, major_name, middle_name, minor_name, item_name, example",
    "aliases": "alias, keywords, target",
    "requests": "event_id, user_id, kind, own, clearance, asked, client_ip",
    "snapshots": "batch_id: batches whose masters were kept",
    "links": "batch_id, mapping_id, record_id: mappings whose record is known",
    "controls": "control, domain, status, maturity",
    "vectors": "vec_id, provider, dimension, namespace",
    "scopes": "event_id, own, plant: a row for each plant that a request names",
    "principals": "user_id, display",
    "issues": "row_id, system_source, plant_code, code, dimension, severity, status, due_in",
    "rules": "code, rule_id, active, dimension, default_severity, due_days",
    "steps": "batch_id, step_id, step_code, ts, status, metrics: the history of workflow steps",
    "blocks": "batch_id, height, step_code, ts, status, metrics: fingerprints of steps in a ledger",
    "golden": "mdm_code, standard_name, category, brand, model, dn, pressure, material, source_systems",
    "version_entries": "entries with version_id",
    "version_aliases": "aliases with version_id",
    "versions": "version_id, catalog, status, created, source_hash",
    "reviews": "review_id, mdm_code, plants, plant_code, status",
    "decisions": "review_id, action, plant_code",
    "tasks": "task_id, mdm_code, target_system, plant",
    "selected": "mdm_code",
    "plants": "plant",
    "systems": "target_system",
    "issue_requests": "row_id, code, wanted, resolution, own",
    "lifecycle": "request_id, name, description, category, brand, mdm_code, plant_code, status",
    "lifecycle_updates": "request_id, wanted, granted",
    "publish_requests": "catalog, target, expected_current",
    "assessments": "control, maturity, status",
    "holds": "batch_id, step_id, ts, held",
    "attributed": "component, model, dn, pressure, material: the members of golden records",
}

#: The relations over driver tables: orders act as batches, lines as mappings, parts as records and masters.
STANDINS = {
    "plants": "SELECT 'GROUP' AS plant UNION ALL SELECT 'SHANGHAI' UNION ALL SELECT 'BEIJING'",
    "systems": "SELECT 'SAP' AS target_system UNION ALL SELECT 'WMS'",
    "materials": MATERIALS_SQL,
    "records": "SELECT row_id % 40 AS batch_id, * FROM {materials}",
    "masters": """SELECT p_partkey AS mdm_code, p_name AS standard_name, p_type AS category,
 CASE WHEN p_partkey % 5 = 0 THEN 'GROUP' WHEN p_partkey % 5 = 1 THEN 'GROUP,SHANGHAI' WHEN p_partkey % 5 = 2 THEN 'BEIJING' ELSE 'SHANGHAI,BEIJING' END AS plants,
 CASE WHEN p_size % 7 = 0 THEN 'NEW' WHEN p_size % 7 = 1 THEN 'REVIEW' ELSE 'AUTO_MERGE' END AS decision, 1 + p_size % 4 AS source_count,
 CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END AS anomaly_count, CASE WHEN p_size % 7 = 1 THEN 0.62 ELSE 0.95 END AS confidence FROM {part}""",
    "lines": """SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus
 FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "mappings": """SELECT l_orderkey * 10 + l_linenumber AS mapping_id, row_id % 40 AS batch_id, l_partkey AS mdm_code, system_source, material_code, plant_code,
 CASE WHEN l_linenumber % 3 = 0 THEN concat(material_name, ' II') ELSE material_name END AS material_name, 80 + l_linenumber AS similarity
 FROM {lines} JOIN {materials} ON l_partkey = row_id""",
    "deliveries": """SELECT l_orderkey AS batch_id, l_linenumber AS line, l_partkey AS mdm_code, CASE WHEN o_custkey % 2 = 0 THEN 'SHANGHAI' ELSE 'BEIJING' END AS plant_code,
 CASE WHEN l_suppkey % 2 = 0 THEN 'SAP' ELSE 'WMS' END AS target_system, l_linestatus = 'F' AS success, l_returnflag = 'N' AS accepted, 1 + l_linenumber % 5 AS rating,
 concat('c', l_suppkey) AS comment FROM {lines} JOIN {orders} ON l_orderkey = o_orderkey""",
    "batches": """SELECT o_orderkey AS batch_id, o_custkey AS owner, o_orderdate AS created,
 CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'RESTRICTED' WHEN '2' THEN 'CONFIDENTIAL' WHEN '3' THEN 'INTERNAL' ELSE 'PUBLIC' END AS classification,
 o_custkey % 11 = 0 AS held, 1 + o_orderkey % 5 AS record_count FROM {orders}""",
    "sheet": """SELECT x.*, 1 + row_number() OVER (ORDER BY full_code, major_name, middle_name, item_name) AS row_no FROM (SELECT DISTINCT lpad(CAST(10 + p_size % 50 AS VARCHAR(9)), 2, '0') AS major, concat(10 + p_size % 50, lpad(CAST(length(p_type) AS VARCHAR(9)), 2, '0')) AS middle,
 concat(10 + p_size % 50, lpad(CAST(length(p_type) AS VARCHAR(9)), 2, '0'), lpad(CAST(length(p_brand) AS VARCHAR(9)), 2, '0')) AS minor,
 concat(10 + p_size % 50, lpad(CAST(length(p_type) AS VARCHAR(9)), 2, '0'), lpad(CAST(length(p_brand) AS VARCHAR(9)), 2, '0'), lpad(CAST(length(p_name) AS VARCHAR(9)), 2, '0')) AS full_code,
 p_type AS major_name, p_brand AS middle_name, p_name AS item_name FROM {part}) x""",
    "entries": "SELECT full_code, major, middle, minor, major_name, middle_name, middle_name AS minor_name, item_name, concat('e ', item_name) AS example FROM {sheet}",
    "aliases": """SELECT s_suppkey AS alias, s_name AS keywords, CASE WHEN s_suppkey % 3 = 0 THEN 'x' ELSE code END AS target FROM {supplier}
 LEFT JOIN (SELECT min(full_code) AS code, CAST(major AS INT) AS k FROM {sheet} GROUP BY major) t ON 10 + s_nationkey = k""",
    "requests": """SELECT event_id, user_id, event_type AS kind, CASE user_id % 3 WHEN 0 THEN 'GROUP' WHEN 1 THEN 'SHANGHAI' ELSE 'BEIJING' END AS own,
 CASE WHEN user_id % 2 = 0 THEN 'PUBLIC' ELSE 'INTERNAL' END AS clearance,
 CASE event_id % 4 WHEN 0 THEN ' shanghai ' WHEN 1 THEN 'BEIJING' WHEN 2 THEN 'Group' ELSE '' END AS asked,
 concat('10.0.0.', user_id % 256) AS client_ip FROM {events}""",
    "snapshots": "SELECT DISTINCT batch_id FROM {mappings} WHERE batch_id % 4 > 0",
    "links": "SELECT batch_id, mapping_id, mdm_code AS record_id FROM {mappings} WHERE mapping_id % 5 = 0",
    "controls": """SELECT row_id AS control, category AS domain, CASE row_id % 4 WHEN 0 THEN 'IMPLEMENTED' WHEN 1 THEN 'MONITORED' WHEN 2 THEN 'PLANNED' ELSE 'PARTIAL' END AS status, 1 + row_id % 5 AS maturity FROM {materials}""",
    "vectors": "SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'remote' ELSE 'local' END AS provider, 64 AS dimension, label AS namespace FROM {embeddings}",
    "scopes": "SELECT event_id, own, asked AS plant FROM {requests} UNION ALL SELECT event_id, own, CASE WHEN event_id % 5 = 0 THEN own ELSE asked END FROM {requests}",
    "principals": "SELECT c_custkey AS user_id, c_name AS display FROM {customer} WHERE c_nationkey < 20",
    "policies": "SELECT 'view' AS kind, '*' AS plants, 'INTERNAL' AS levels UNION ALL SELECT 'click', 'SHANGHAI,BEIJING', '*' UNION ALL SELECT 'purchase', 'GROUP', 'PUBLIC,INTERNAL'",
    "found": """SELECT row_id, system_source, plant_code, 'MISSING_UNIT' AS code FROM {materials} WHERE unit = ''
 UNION ALL SELECT row_id, system_source, plant_code, 'MISSING_DESCRIPTION' FROM {materials} WHERE description = ''
 UNION ALL SELECT row_id, system_source, plant_code, 'MISSING_SYSTEM_SOURCE' FROM {materials} WHERE system_source = ''
 UNION ALL SELECT row_id, system_source, plant_code, 'CATEGORY_UNRESOLVED' FROM {materials} WHERE category = ''
 UNION ALL SELECT row_id, system_source, plant_code, 'ODD_CODE' FROM {materials} WHERE row_id % 31 = 0""",
    "rules": """SELECT 'MISSING_UNIT' AS code, 'DQR-1' AS rule_id, true AS active, 'completeness' AS dimension, 'MEDIUM' AS default_severity, 5 AS due_days
 UNION ALL SELECT 'MISSING_DESCRIPTION', 'DQR-2', true, 'completeness', 'MEDIUM', 5 UNION ALL SELECT 'MISSING_SYSTEM_SOURCE', 'DQR-3', true, 'lineage', 'HIGH', 2
 UNION ALL SELECT 'DUPLICATE_CODE', 'DQR-4', true, 'uniqueness', 'HIGH', 2 UNION ALL SELECT 'LINEAGE_MISSING', 'DQR-6', true, 'lineage', 'HIGH', 2 UNION ALL SELECT 'CATEGORY_UNRESOLVED', 'DQR-5', false, 'conformity', 'LOW', 10""",
    "issues": """SELECT row_id, system_source, plant_code, f.code, dimension, default_severity AS severity,
 CASE row_id % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'ACKNOWLEDGED' WHEN 2 THEN 'RESOLVED' ELSE 'WAIVED' END AS status, due_days + row_id % 9 AS due_in FROM {found} f JOIN {rules} r ON f.code = r.code""",
    "steps": """SELECT user_id AS batch_id, event_id AS step_id, CASE event_id % 8 WHEN 0 THEN 'INGEST' WHEN 1 THEN 'STANDARDIZE' WHEN 2 THEN 'VECTOR_INDEX' WHEN 3 THEN 'GRAPH_DEDUPE' WHEN 4 THEN 'REVIEW' WHEN 5 THEN 'QUALITY'
 WHEN 6 THEN 'DISTRIBUTE' ELSE 'FEEDBACK' END AS step_code, ts, CASE WHEN user_id % 4 = 0 AND event_type = 'view' THEN 'COMPLETED' ELSE CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'RUNNING' END END AS status, props AS metrics FROM {events}""",
    "versions": """SELECT version_id, catalog, CASE WHEN place = 2 THEN 'PUBLISHED' WHEN o_orderstatus = 'F' THEN 'VALIDATED' WHEN o_orderstatus = 'O' THEN 'DRAFT' ELSE 'RETIRED' END AS status, created, source_hash
 FROM (SELECT o_orderkey AS version_id, o_custkey AS catalog, o_orderstatus, o_orderdate AS created, concat('h', o_orderkey % 7) AS source_hash, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM {orders}) x""",
    "version_entries": "SELECT version_id, e.* FROM {versions} v JOIN {entries} e ON e.major = CAST(10 + version_id % 50 AS VARCHAR(9))",
    "version_aliases": "SELECT DISTINCT version_id, a.alias, a.keywords, a.target FROM {version_entries} e JOIN {aliases} a ON a.target = e.full_code",
    "reviews": """SELECT mdm_code AS review_id, mdm_code, plants, CASE WHEN plants LIKE '%SHANGHAI%' THEN 'SHANGHAI' ELSE 'GROUP' END AS plant_code,
 CASE WHEN mdm_code % 4 = 0 THEN 'RESOLVED' ELSE 'PENDING' END AS status FROM {masters} WHERE decision = 'REVIEW'""",
    "decisions": """SELECT review_id, CASE review_id % 3 WHEN 0 THEN 'MERGE' WHEN 1 THEN 'NEW' ELSE 'SKIP' END AS action,
 CASE WHEN review_id % 5 = 0 THEN 'BEIJING' ELSE 'GROUP' END AS plant_code FROM {reviews}""",
    "selected": "SELECT mdm_code FROM {masters} WHERE mdm_code % 3 = 0",
    "tasks": """SELECT l_orderkey * 10 + l_linenumber AS task_id, l_partkey AS mdm_code, CASE WHEN l_suppkey % 2 = 0 THEN 'SAP' ELSE 'WMS' END AS target_system,
 CASE WHEN l_suppkey % 2 = 0 THEN 'SHANGHAI' ELSE 'BEIJING' END AS plant FROM {lines}""",
    "attributed": """SELECT row_id, material_code AS component, category AS model, plant_code AS dn, CASE WHEN row_id % 3 = 0 THEN '' ELSE substring(description, length(description) - 2, 3) END AS material,
 CASE WHEN description LIKE '%PN16%' THEN '1.6MPa' ELSE '' END AS pressure FROM {materials}""",
    "issue_requests": """SELECT row_id, code, CASE row_id % 3 WHEN 0 THEN 'ACKNOWLEDGED' WHEN 1 THEN 'RESOLVED' ELSE 'OPEN' END AS wanted,
 CASE WHEN row_id % 2 = 0 THEN 'mended' ELSE '' END AS resolution, CASE WHEN row_id % 5 = 0 THEN 'BEIJING' ELSE 'GROUP' END AS own FROM {issues}""",
    "lifecycle": "SELECT row_id AS request_id, material_name AS name, description, category, CASE WHEN row_id % 4 = 0 THEN 'SKF' ELSE '' END AS brand, CASE WHEN row_id % 10 = 0 THEN 'MDM-1' WHEN row_id % 10 = 1 THEN 'NEW-1' ELSE '' END AS mdm_code, plant_code, CASE row_id % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'REVIEWED' ELSE 'APPROVED' END AS status FROM {materials}",
    "lifecycle_updates": """SELECT row_id AS request_id, CASE row_id % 5 WHEN 0 THEN 'REVIEWED' WHEN 1 THEN 'APPROVED' WHEN 2 THEN 'ARCHIVED' ELSE 'REJECTED' END AS wanted,
 CASE WHEN row_id % 2 = 0 THEN 'lifecycle.review' ELSE 'lifecycle.approve' END AS granted FROM {materials} WHERE row_id % 4 <> 3""",
    "publish_requests": """SELECT catalog, max(version_id) AS target, CASE catalog % 3 WHEN 0 THEN min(version_id) WHEN 1 THEN max(CASE WHEN status = 'PUBLISHED' THEN version_id END) END AS expected_current
 FROM {versions} GROUP BY catalog""",
    "assessments": """SELECT row_id AS control, row_id % 7 AS maturity, CASE row_id % 4 WHEN 0 THEN 'IMPLEMENTED' WHEN 1 THEN 'MONITORED' WHEN 2 THEN 'PLANNED' ELSE 'DONE' END AS status FROM {materials}""",
    "blocks": """SELECT batch_id, step_id AS height, step_code, ts, status, CASE WHEN step_id % 11 = 0 THEN 'changed' ELSE metrics END AS metrics FROM {steps} WHERE step_id % 7 <> 0 AND NOT (batch_id % 5 = 0 AND step_code = 'QUALITY')""",
    "golden": """SELECT p_partkey AS mdm_code, p_name AS standard_name, p_type AS category, p_brand AS brand, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE concat('M', p_size) END AS model, CAST(p_size AS VARCHAR(9)) AS dn,
 CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE '1.6MPa' END AS pressure, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '304' END AS material, CASE WHEN p_partkey % 2 = 0 THEN 'SAP,EAM' ELSE 'WMS' END AS source_systems FROM {part}""",
    "graph_batches": "SELECT DISTINCT batch_id, concat('file ', batch_id) AS filename FROM {records}",
    "graph_steps": """SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY step_code) AS ordinal, step_code, lower(step_code) AS name, status, 10 * length(status) AS progress
 FROM (SELECT batch_id, step_code, max(status) AS status FROM {steps} WHERE batch_id < 40 GROUP BY batch_id, step_code) x""",
    "graph_masters": "SELECT DISTINCT p.batch_id, p.mdm_code AS place, p.mdm_code, standard_name, category, decision, m.plants FROM {mappings} p JOIN {masters} m ON m.mdm_code = p.mdm_code",
    "graph_mappings": """SELECT p.batch_id, mapping_id, CASE WHEN mapping_id % 9 = 0 THEN NULL ELSE p.mdm_code END AS record_id, p.mdm_code, system_source, material_code AS original_code, material_name AS original_name, plant_code, similarity, decision,
 CASE WHEN mapping_id % 4 = 0 THEN concat('S-', mapping_id) END AS source_record_id, 'T' AS source_table, '' AS source_url, sha256(concat(material_code, material_name)) AS record_hash, CASE WHEN system_source LIKE '%SAP%' THEN 'sap-odata' ELSE 'file-import' END AS connector_id
 FROM {mappings} p JOIN {masters} m ON m.mdm_code = p.mdm_code WHERE mapping_id % 3 = 0""",
    "graph_issues": "SELECT p.batch_id, mapping_id, code, dimension AS field, severity, CASE WHEN mapping_id % 2 = 0 THEN '' ELSE concat(code, '!') END AS message FROM {graph_mappings} p JOIN {issues} i ON i.row_id = p.mdm_code",
    "graph_reviews": """SELECT DISTINCT p.batch_id, review_id, r.mdm_code, r.plants, 'conflict' AS reason, CASE r.status WHEN 'PENDING' THEN 'REVIEW' ELSE r.status END AS status, 0.5 AS confidence FROM {reviews} r JOIN {mappings} p ON p.mdm_code = r.mdm_code""",
    "graph_deliveries": """SELECT p.batch_id, t.task_id AS delivery_id, t.mdm_code, target_system, t.plant AS plant_code, CASE WHEN t.task_id % 3 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status
 FROM {tasks} t JOIN (SELECT DISTINCT batch_id, mdm_code FROM {mappings}) p ON p.mdm_code = t.mdm_code WHERE t.task_id % 7 = 0""",
    "graph_feedback": "SELECT batch_id, delivery_id AS feedback_id, mdm_code, plant_code, delivery_id % 2 = 0 AS accepted, 1 + delivery_id % 5 AS rating, concat('c', delivery_id) AS comment FROM {graph_deliveries} WHERE status = 'SUCCESS'",
    "graph_blocks": """SELECT batch_id, height, status AS event_type, CASE height % 5 WHEN 0 THEN 'BATCH' WHEN 1 THEN 'MASTER' WHEN 2 THEN 'DISTRIBUTION' WHEN 3 THEN 'WORKFLOW_STEP' ELSE 'PROFILE' END AS entity_type,
 CASE height % 5 WHEN 0 THEN CAST(batch_id AS VARCHAR(9)) WHEN 1 THEN CAST(height % 300 AS VARCHAR(9)) WHEN 2 THEN CASE WHEN height % 2 = 0 THEN 'SHANGHAI' ELSE 'BEIJING' END WHEN 3 THEN step_code ELSE 'default' END AS entity_id,
 sha256(concat(height, 'b')) AS block_hash, sha256(concat(height, 'p')) AS payload_hash, sha256(concat(height, 'o')) AS previous_hash FROM {blocks} WHERE batch_id < 40""",
    "origins": "SELECT row_id, CASE WHEN row_id % 23 = 0 THEN '' ELSE material_code END AS source_record_id, CASE WHEN row_id % 29 = 0 THEN NULL ELSE sha256(concat(material_code, '|', material_name)) END AS record_hash FROM {materials}",
    "conflicts": "SELECT mdm_code, 'dn' AS field, '50 / 80' AS vals FROM {masters} WHERE decision = 'REVIEW' UNION ALL SELECT mdm_code, 'model', concat('A', mdm_code, ' / B') FROM {masters} WHERE decision = 'REVIEW' AND mdm_code % 2 = 0",
    "expected": "SELECT 'entries' AS what, count(*) AS n FROM {entries} UNION ALL SELECT 'aliases', 12",
    "holds": "SELECT batch_id, step_id, ts, status = 'COMPLETED' AS held FROM {steps}",
}
RETENTION = " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.RETENTION_DAYS.items())
_INPUT, _VALUE = re.compile(r"\{(\w+)\}"), re.compile(r"(?<![:\w']):([a-z_]+)\b")


def inputs(statement: str) -> list[str]:
    return sorted(set(_INPUT.findall(statement)))


def run(spark: SparkSession, statement: str, values: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Run a statement over the given tables, with a value for each :name."""
    text = re.sub(r"sha256\((concat\([^()]*\))\)", r"sha2(\1, 256)", statement)
    return spark.sql(text, args=values or {}, **{name: tables[name] for name in inputs(statement)})


def standin(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A relation of STANDINS, or else the driver table of that name; what was made of them already stands in `made`."""
    if name in (made or {}):
        return made[name]
    if name not in STANDINS:
        return table(spark, sf_dir, name)
    return run(spark, STANDINS[name], **{n: standin(spark, sf_dir, n, made) for n in inputs(STANDINS[name])})


def run_standins(spark: SparkSession, sf_dir: str, statement: str, values: dict | None = None) -> DataFrame:
    return run(spark, statement, values, **{n: standin(spark, sf_dir, n) for n in inputs(statement)})


def oracle(statement: str, values: dict | None = None) -> str:
    """The statement as one text over driver tables."""
    ctes: dict[str, str] = {}

    def need(text: str) -> None:
        for name in inputs(text):
            if name in STANDINS and name not in ctes:
                need(STANDINS[name])
                ctes[name] = STANDINS[name]

    need(statement)
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    body = _VALUE.sub(lambda m: quote((values or {})[m.group(1)]), statement).strip()
    head = ", ".join(f"{n} AS ({sql})" for n, sql in ctes.items())
    if head:
        body = f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
    ordered = r"listagg\((\w+), ('[^']*')\) WITHIN GROUP \(ORDER BY (\w+)\)"
    return _INPUT.sub(r"\1", re.sub(ordered, r"string_agg(\1, \2 ORDER BY \3)", body))
