"""Table operators as SQL over named relations (relations.py): scopes, sinks, joins, windows, top-k and sets."""

from __future__ import annotations

VISIBLE = "(:plant IN ('', 'GROUP', 'ALL') OR concat(',', plants, ',') LIKE concat('%,', :plant, ',%'))"
REACHES = "(concat(',', m.plants, ',') LIKE '%,GROUP,%' OR concat(',', m.plants, ',') LIKE concat('%,', {0}, ',%'))"
APPROVED = "('AUTO_MERGE', 'NEW', 'CONFIRMED_NEW')"

#: Values of :name for the registered queries.
VALUES = {
    "flt1_plant_visible": {"plant": "SHANGHAI"},
    "flt2_distributable": {"plant": "SHANGHAI"},
    "flt9_masked_ip": {"reader": "AUDITOR"},
    "src9_retention_delete": {"today": "1997-01-01"},
    "src9_retention_report": {"today": "1997-01-01"},
    "src14_latest_batch": {"plant": "SHANGHAI"},
    "jn7_record_lineage": {"plant": "SHANGHAI"},
    "jn7_lineage_rows": {"plant": "SHANGHAI"},
    "tk7_first_mappings": {"most": 3},
    "txt23_issue_ids": {"batch": "B1"},
}

#: jn5_published_entries where all versions share one tree and one list of aliases: each entry meets its aliases once, and
#: only published versions meet entries, those of their major code (knowledge.published).
PUBLISHED_TREE = """WITH a AS (SELECT DISTINCT alias, keywords, target FROM {aliases})
 SELECT major, full_code, item_name, alias FROM {entries} e LEFT JOIN a ON a.target = e.full_code"""
PUBLISHED_VERSIONS = "SELECT version_id, catalog, source_hash, CAST(10 + version_id % 50 AS VARCHAR(9)) AS major FROM {versions} WHERE status = 'PUBLISHED'"

STATEMENTS = {
    # Scopes.
    "flt1_plant_visible": f"SELECT mdm_code FROM {{masters}} WHERE {VISIBLE}",
    "flt2_distributable": f"SELECT mdm_code FROM {{masters}} WHERE {VISIBLE} OR concat(',', plants, ',') LIKE '%,GROUP,%'",
    "flt3_identity_scope": "SELECT event_id, CASE WHEN own <> 'GROUP' THEN own WHEN trim(asked) = '' THEN 'GROUP' ELSE upper(trim(asked)) END AS plant FROM {requests}",
    "flt4_requested_scope": """SELECT event_id, min(CASE WHEN own = 'GROUP' OR coalesce(trim(plant), '') = '' OR upper(trim(plant)) = own THEN 1 ELSE 0 END) = 1 AS allowed
 FROM {scopes} GROUP BY event_id""",
    "flt6_knowledge_acl": """SELECT event_id, (plants = '*' OR concat(',', plants, ',') LIKE concat('%,', own, ',%')) AND (levels = '*' OR concat(',', levels, ',') LIKE concat('%,', clearance, ',%')) AS allowed
 FROM {requests} r JOIN {policies} p ON r.kind = p.kind""",
    "flt7_egress_gate": """SELECT d.batch_id, d.line, b.classification, coalesce(b.classification IN ('PUBLIC', 'INTERNAL'), false) AS external_ai
 FROM {deliveries} d LEFT JOIN {batches} b ON d.batch_id = b.batch_id""",
    "flt9_masked_ip": "SELECT event_id, CASE WHEN :reader = 'GROUP_ADMIN' THEN client_ip ELSE 'masked' END AS client_ip FROM {requests}",
    "flt10_actor": """SELECT event_id, CASE WHEN p.user_id IS NOT NULL THEN concat(display, ' (', r.user_id, ')') ELSE coalesce(nullif(trim(asked), ''), 'system') END AS actor
 FROM {requests} r LEFT JOIN {principals} p ON r.user_id = p.user_id""",
    # Ids of issues, sources and tasks.
    "txt23_issue_ids": """SELECT row_id, concat('DQI-', upper(substring(sha256(concat(:batch, ':', row_id, ':MISSING_UNIT')), 1, 16))) AS issue_id,
 concat('SRC-', upper(substring(sha256(concat(:batch, ':', system_source, ':', material_code, ':', row_id)), 1, 16))) AS source_id,
 concat('TASK-', upper(substring(sha256(concat(material_code, ':', plant_code)), 1, 12))) AS task_id FROM {materials}""",
    # Sources and sinks.
    "src3_standard_rows": """SELECT row_no, full_code, major_name, item_name, concat('A', row_no, ':G', row_no) AS cells, sha256(concat(full_code, '|', major_name, '|', middle_name, '|', item_name)) AS row_hash
 FROM {sheet} WHERE trim(concat(full_code, major_name, middle_name, item_name)) <> ''""",
    "src3_alias_scope": """SELECT alias, target, CASE WHEN e.full_code IS NULL THEN 'EXTERNAL_BOUNDARY' ELSE 'IN_TREE' END AS scope
 FROM {aliases} a LEFT JOIN (SELECT DISTINCT full_code FROM {entries}) e ON target = e.full_code""",
    "src6_upsert_latest": """SELECT batch_id, step_code, step_id, status, metrics FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, step_code ORDER BY ts DESC, step_id DESC) AS rn FROM {steps}) x WHERE rn = 1""",
    "src7_insert_absent": """SELECT DISTINCT d.mdm_code, d.plant_code FROM {deliveries} d WHERE NOT EXISTS (SELECT 1 FROM {reviews} r WHERE r.mdm_code = d.mdm_code AND r.plant_code = d.plant_code)""",
    "src8_payload_hashes": f"""WITH p AS (SELECT mdm_code, target_system, plant, concat(chr(123), '"mdm_code":', mdm_code, ',"plant_code":"', plant, '","target_system":"', target_system, '"', chr(125)) AS payload
  FROM {{masters}} m CROSS JOIN {{systems}} CROSS JOIN {{plants}} WHERE {REACHES.format('plant')})
 SELECT mdm_code, target_system, plant, payload, sha256(concat(payload)) AS payload_hash FROM p""",
    "src9_retention_delete": """WITH gone AS (SELECT batch_id FROM {batches} WHERE NOT held AND created < CAST(:today AS DATE))
 SELECT d.batch_id, count(*) AS kept FROM {deliveries} d WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.batch_id = d.batch_id) GROUP BY d.batch_id""",
    "src9_retention_report": """SELECT b.batch_id, b.held, CASE WHEN b.held THEN 'HELD' ELSE 'DELETE' END AS action, count(d.batch_id) AS rows_of_it
 FROM {batches} b LEFT JOIN {deliveries} d ON d.batch_id = b.batch_id WHERE b.created < CAST(:today AS DATE) GROUP BY b.batch_id, b.held""",
    "src10_purge_guard": """SELECT owner, count(*) AS batches, count(CASE WHEN held THEN 1 END) AS holds, count(CASE WHEN held THEN 1 END) = 0 AS may_purge FROM {batches} GROUP BY owner""",
    "src13_rebuild_snapshot": """SELECT batch_id, m.mdm_code, standard_name, decision, count(*) AS mappings, avg(similarity) AS similarity, count(DISTINCT p.system_source) AS systems
 FROM {mappings} p JOIN {masters} m ON p.mdm_code = m.mdm_code WHERE NOT EXISTS (SELECT 1 FROM {snapshots} s WHERE s.batch_id = p.batch_id) GROUP BY batch_id, m.mdm_code, standard_name, decision""",
    "src14_latest_batch": f"""WITH newest AS (SELECT batch_id FROM (SELECT batch_id, row_number() OVER (PARTITION BY owner ORDER BY created DESC, batch_id DESC) AS rn FROM {{batches}}) x WHERE rn = 1)
 SELECT d.batch_id, m.mdm_code, m.decision, count(*) AS deliveries FROM newest n JOIN {{deliveries}} d ON d.batch_id = n.batch_id JOIN {{masters}} m ON m.mdm_code = d.mdm_code
 WHERE {VISIBLE} OR concat(',', plants, ',') LIKE '%,GROUP,%' GROUP BY d.batch_id, m.mdm_code, m.decision""",
    "src16_pending_reviews": """SELECT r.review_id, m.mdm_code, m.standard_name, m.plants, m.source_count, r.plant_code FROM {reviews} r JOIN {masters} m ON m.mdm_code = r.mdm_code WHERE r.status = 'PENDING'""",
    "src16_golden_view": "SELECT mdm_code, standard_name, category, decision, plants, source_count FROM {masters} WHERE decision <> 'REVIEW'",
    # Joins.
    "jn2_rank_links": """WITH r AS (SELECT batch_id, row_id, system_source, material_code, plant_code, material_name,
  row_number() OVER (PARTITION BY batch_id, system_source, material_code, plant_code, material_name ORDER BY row_id) AS k FROM {records}),
 m AS (SELECT batch_id, mapping_id, system_source, material_code, plant_code, material_name,
  row_number() OVER (PARTITION BY batch_id, system_source, material_code, plant_code, material_name ORDER BY mapping_id) AS k FROM {mappings}),
 near AS (SELECT m.batch_id, m.mapping_id, r.row_id FROM m JOIN r ON m.batch_id = r.batch_id AND m.system_source = r.system_source AND m.material_code = r.material_code
  AND m.plant_code = r.plant_code AND m.material_name = r.material_name AND m.k = r.k),
 free AS (SELECT batch_id, row_id, row_number() OVER (PARTITION BY batch_id ORDER BY row_id) AS j FROM r WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.row_id = r.row_id AND n.batch_id = r.batch_id)),
 rest AS (SELECT batch_id, mapping_id, row_number() OVER (PARTITION BY batch_id ORDER BY mapping_id) AS j FROM m WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.mapping_id = m.mapping_id))
 SELECT batch_id, mapping_id, row_id, 'KEY' AS how FROM near UNION ALL SELECT rest.batch_id, mapping_id, row_id, 'NEXT_FREE' FROM rest JOIN free ON rest.batch_id = free.batch_id AND rest.j = free.j""",
    "jn3_backfill_links": """WITH r AS (SELECT batch_id, row_id, system_source, material_code, plant_code, material_name,
  row_number() OVER (PARTITION BY batch_id, system_source, material_code, plant_code, material_name ORDER BY row_id) AS k FROM {records} c
  WHERE NOT EXISTS (SELECT 1 FROM {links} s WHERE s.batch_id = c.batch_id AND s.record_id = c.row_id)),
 m AS (SELECT batch_id, mapping_id, system_source, material_code, plant_code, material_name,
  row_number() OVER (PARTITION BY batch_id, system_source, material_code, plant_code, material_name ORDER BY mapping_id) AS k FROM {mappings} p
  WHERE NOT EXISTS (SELECT 1 FROM {links} s WHERE s.mapping_id = p.mapping_id))
 SELECT m.batch_id, mapping_id, row_id FROM m JOIN r ON m.batch_id = r.batch_id AND m.system_source = r.system_source AND m.material_code = r.material_code
  AND m.plant_code = r.plant_code AND m.material_name = r.material_name AND m.k = r.k""",
    "jn4_first_decision": """WITH f AS (SELECT * FROM (SELECT p.batch_id, p.material_code, p.plant_code, d.decision, p.mdm_code,
  row_number() OVER (PARTITION BY p.batch_id, p.material_code, p.plant_code ORDER BY mapping_id) AS k FROM {mappings} p JOIN {masters} d ON d.mdm_code = p.mdm_code) x WHERE k = 1)
 SELECT r.row_id, f.mdm_code, coalesce(f.decision, 'UNMAPPED') AS decision FROM {records} r LEFT JOIN f ON r.batch_id = f.batch_id AND r.material_code = f.material_code AND r.plant_code = f.plant_code""",
    "jn5_published_entries": """SELECT v.version_id, v.catalog, v.source_hash, e.full_code, e.item_name, a.alias FROM {versions} v JOIN {version_entries} e ON e.version_id = v.version_id
 LEFT JOIN {version_aliases} a ON a.version_id = v.version_id AND a.target = e.full_code WHERE v.status = 'PUBLISHED'""",
    "jn6_active_version": "SELECT catalog, version_id FROM {versions} WHERE status = 'PUBLISHED'",
    "jn7_record_lineage": f"""WITH p AS (SELECT batch_id, material_code, plant_code, mdm_code, count(*) AS mappings FROM {{mappings}} GROUP BY batch_id, material_code, plant_code, mdm_code),
 d AS (SELECT mdm_code, count(*) AS deliveries, count(CASE WHEN success THEN 1 END) AS delivered, count(CASE WHEN accepted THEN 1 END) AS accepted FROM {{deliveries}} GROUP BY mdm_code),
 v AS (SELECT mdm_code, count(*) AS reviews, count(CASE WHEN status = 'PENDING' THEN 1 END) AS pending FROM {{reviews}} GROUP BY mdm_code)
 SELECT r.row_id, r.batch_id, p.mdm_code, m.decision, coalesce(mappings, 0) AS mappings, coalesce(reviews, 0) AS reviews, coalesce(pending, 0) AS pending,
  coalesce(deliveries, 0) AS deliveries, coalesce(delivered, 0) AS delivered, coalesce(accepted, 0) AS accepted
 FROM {{records}} r LEFT JOIN p ON p.batch_id = r.batch_id AND p.material_code = r.material_code AND p.plant_code = r.plant_code LEFT JOIN {{masters}} m ON m.mdm_code = p.mdm_code
 LEFT JOIN d ON d.mdm_code = p.mdm_code LEFT JOIN v ON v.mdm_code = p.mdm_code WHERE :plant IN ('', 'GROUP') OR r.plant_code IN ('GROUP', :plant)""",
    "jn8_code_lineage": """WITH up AS (SELECT mdm_code, count(*) AS sources, count(DISTINCT system_source) AS systems, count(DISTINCT batch_id) AS batches FROM {mappings} GROUP BY mdm_code),
 down AS (SELECT mdm_code, count(*) AS deliveries, count(DISTINCT plant_code) AS plants, count(DISTINCT target_system) AS targets, max(batch_id) AS last_batch FROM {deliveries} GROUP BY mdm_code)
 SELECT m.mdm_code, coalesce(sources, 0) AS sources, coalesce(systems, 0) AS systems, coalesce(batches, 0) AS batches, coalesce(deliveries, 0) AS deliveries, last_batch,
  coalesce(systems, 0) + coalesce(batches, 0) + coalesce(down.plants, 0) + coalesce(targets, 0) AS degree
 FROM {masters} m LEFT JOIN up ON up.mdm_code = m.mdm_code LEFT JOIN down ON down.mdm_code = m.mdm_code""",
    "jn7_lineage_rows": """WITH p AS (SELECT DISTINCT r.row_id, r.batch_id, p.mapping_id, p.mdm_code FROM {records} r JOIN {mappings} p ON p.batch_id = r.batch_id AND p.material_code = r.material_code AND p.plant_code = r.plant_code
  WHERE :plant IN ('', 'GROUP') OR r.plant_code IN ('GROUP', :plant)), c AS (SELECT DISTINCT row_id, mdm_code FROM p)
 SELECT row_id, 'MAPPING' AS kind, CAST(mapping_id AS VARCHAR(40)) AS ref, CAST(mdm_code AS VARCHAR(40)) AS status FROM p
 UNION ALL SELECT row_id, 'MASTER', CAST(m.mdm_code AS VARCHAR(40)), decision FROM c JOIN {masters} m ON m.mdm_code = c.mdm_code
 UNION ALL SELECT row_id, 'REVIEW', CAST(review_id AS VARCHAR(40)), status FROM c JOIN {reviews} r ON r.mdm_code = c.mdm_code
 UNION ALL SELECT row_id, 'DELIVERY', concat(batch_id, '/', line, '/', target_system), CASE WHEN success THEN 'SUCCESS' ELSE 'FAILED' END FROM c JOIN {deliveries} d ON d.mdm_code = c.mdm_code WHERE :plant IN ('', 'GROUP') OR plant_code = :plant
 UNION ALL SELECT row_id, 'FEEDBACK', concat(batch_id, '/', line), concat(rating, CASE WHEN accepted THEN ' accepted' ELSE ' refused' END) FROM c JOIN {deliveries} d ON d.mdm_code = c.mdm_code WHERE success AND (:plant IN ('', 'GROUP') OR plant_code = :plant)
 UNION ALL SELECT DISTINCT p.row_id, 'PROOF', CAST(height AS VARCHAR(40)), block_hash FROM p JOIN {graph_blocks} b ON b.batch_id = p.batch_id AND b.entity_type = 'MASTER' AND b.entity_id = CAST(p.mdm_code AS VARCHAR(40))""",
    "jn8_lineage_rows": """WITH n AS (SELECT mdm_code, 'UP' AS side, 'SYSTEM' AS kind, system_source AS ref, batch_id FROM {mappings} UNION ALL SELECT mdm_code, 'UP', 'BATCH', CAST(batch_id AS VARCHAR(40)), batch_id FROM {mappings}
  UNION ALL SELECT mdm_code, 'DOWN', 'PLANT', plant_code, batch_id FROM {deliveries} UNION ALL SELECT mdm_code, 'DOWN', 'TARGET_SYSTEM', target_system, batch_id FROM {deliveries} WHERE success),
 g AS (SELECT mdm_code, side, kind, ref, count(*) AS n, max(batch_id) AS last_batch FROM n GROUP BY mdm_code, side, kind, ref)
 SELECT g.*, count(*) OVER (PARTITION BY mdm_code) AS degree FROM g""",
    "jn9_semi_delivered": "SELECT mdm_code FROM {masters} m WHERE EXISTS (SELECT 1 FROM {deliveries} d WHERE d.mdm_code = m.mdm_code AND success)",
    "jn10_anti_approved": f"SELECT mdm_code FROM {{selected}} s WHERE NOT EXISTS (SELECT 1 FROM {{masters}} m WHERE m.mdm_code = s.mdm_code AND decision IN {APPROVED})",
    "jn11_task_expansion": f"""SELECT concat('TASK-', upper(substring(sha256(concat(mdm_code, ':', target_system, ':', plant)), 1, 12))) AS task_id, mdm_code, target_system, plant,
 decision IN {APPROVED} AND {REACHES.format('plant')} AS eligible FROM {{masters}} m CROSS JOIN {{systems}} CROSS JOIN {{plants}} WHERE plant <> 'GROUP'""",
    "jn13_latest_block": """WITH s AS (SELECT batch_id, step_code, step_id, ts, status, metrics FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, step_code ORDER BY ts DESC, step_id DESC) AS k FROM {steps}) x WHERE k = 1),
 b AS (SELECT batch_id, step_code, height, ts, status, metrics FROM (SELECT b.*, row_number() OVER (PARTITION BY b.batch_id, b.step_code ORDER BY b.height DESC) AS k FROM {blocks} b JOIN s ON s.batch_id = b.batch_id AND s.step_code = b.step_code AND b.ts <= s.ts) x WHERE k = 1)
 SELECT s.batch_id, s.step_code, b.height, CASE WHEN b.height IS NULL THEN 'MISSING' WHEN b.status = s.status AND b.metrics = s.metrics THEN 'MATCHES' WHEN b.ts < s.ts THEN 'STALE' ELSE 'CHANGED' END AS fingerprint
 FROM s LEFT JOIN b ON s.batch_id = b.batch_id AND s.step_code = b.step_code""",
    "jn14_evidence": """WITH r AS (SELECT mdm_code, review_id, status FROM (SELECT *, row_number() OVER (PARTITION BY mdm_code ORDER BY review_id DESC) AS k FROM {reviews}) x WHERE k = 1)
 SELECT p.mapping_id, p.mdm_code, p.material_code, m.decision, m.source_count, r.review_id, r.status FROM {mappings} p JOIN {masters} m ON m.mdm_code = p.mdm_code LEFT JOIN r ON r.mdm_code = p.mdm_code""",
    # Windows and top-k.
    "wn5_latest_per_key": """SELECT batch_id, step_id AS latest, status FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ts DESC, step_id DESC) AS k FROM {steps}) x WHERE k = 1""",
    "wn5_active_profile": """SELECT owner, batch_id AS profile FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY CASE WHEN held THEN 0 ELSE 1 END, created DESC, batch_id DESC) AS k FROM {batches}) x WHERE k = 1""",
    "wn7_occurrence_rank": "SELECT row_id, row_number() OVER (PARTITION BY system_source, material_code, plant_code, material_name ORDER BY row_id) AS k FROM {materials}",
    "wn8_running_offset": """SELECT batch_id, owner AS key, CAST(coalesce(sum(record_count) OVER (PARTITION BY owner ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM {batches}""",
    "tk6_newest_events": "SELECT step_id AS event_id, batch_id AS user_id, status FROM {steps} ORDER BY ts DESC, step_id DESC LIMIT 500",
    "tk7_first_mappings": "SELECT batch_id, mapping_id FROM (SELECT batch_id, mapping_id, row_number() OVER (PARTITION BY batch_id ORDER BY mapping_id) AS rn FROM {mappings}) x WHERE rn <= :most",
    "tk8_open_issues": """SELECT row_id, code, status, severity, due_in FROM {issues}
 ORDER BY CASE status WHEN 'OPEN' THEN 0 WHEN 'ACKNOWLEDGED' THEN 1 ELSE 2 END, CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, due_in, row_id, code""",
    "tk9_versions_newest_first": "SELECT catalog, version_id, status FROM {versions} ORDER BY created DESC, version_id DESC",
    # Sets.
    "set1_pending_feedback": "SELECT plant_code, mdm_code FROM {deliveries} WHERE success EXCEPT SELECT plant_code, mdm_code FROM {deliveries} WHERE accepted",
    "set1_progress": """WITH e AS (SELECT DISTINCT batch_id, plant_code, mdm_code FROM {deliveries} WHERE success), a AS (SELECT DISTINCT batch_id, plant_code, mdm_code FROM {deliveries} WHERE accepted)
 SELECT e.batch_id, count(*) AS expected, count(a.mdm_code) AS accepted, round(100.0 * count(a.mdm_code) / count(*), 1) + 0e0 AS progress
 FROM e LEFT JOIN a ON e.batch_id = a.batch_id AND e.plant_code = a.plant_code AND e.mdm_code = a.mdm_code GROUP BY e.batch_id""",
    "set2_last_attributes": """WITH n AS (SELECT concat('M', mdm_code) AS node, 'MASTER' AS type, plant_code AS attribute, batch_id AS seen FROM {deliveries} UNION ALL SELECT concat('B', batch_id), 'BATCH', plant_code, batch_id FROM {deliveries}
  UNION ALL SELECT concat('T', target_system), 'TARGET_SYSTEM', target_system, batch_id FROM {deliveries})
 SELECT node, type, attribute FROM (SELECT node, type, attribute, row_number() OVER (PARTITION BY node ORDER BY seen DESC, attribute) AS rn FROM (SELECT node, type, attribute, max(seen) AS seen FROM n GROUP BY node, type, attribute) y) x WHERE rn = 1""",
    "set3_distinct_codes": "SELECT plant_code, category, min(row_id) AS first_row FROM {materials} GROUP BY plant_code, category",
    # Graph of orders.
    "gr3_degree": """WITH e AS (SELECT DISTINCT concat('c', owner) AS a, concat('b', batch_id) AS b FROM {batches}), d AS (SELECT a AS node FROM e UNION ALL SELECT b FROM e),
 n AS (SELECT count(DISTINCT node) AS n FROM d) SELECT node, count(*) AS degree, round(CAST(count(*) AS DOUBLE) / max(n.n - 1), 9) AS centrality FROM d CROSS JOIN n GROUP BY node""",
    "gr4_neighbours": """SELECT concat('c', owner) AS node, concat('b', batch_id) AS neighbour, 'OWNS' AS relation FROM {batches}
 UNION ALL SELECT DISTINCT concat('b', batch_id), concat('m', mdm_code), 'CONTAINS' FROM {deliveries} UNION ALL SELECT DISTINCT concat('m', mdm_code), concat('p', plant_code), 'USED_AT' FROM {deliveries}""",
}
