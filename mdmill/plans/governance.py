"""Table operators as SQL over named relations (relations.py): issues, texts, aggregates and reports."""

from __future__ import annotations

from mdmill.plans.relations import RETENTION
from mdmill.plans.statements import APPROVED, REACHES

VALUES = {"ag3_rule_codes": {"method": "JACCARD"}, "ag13_issue_capture": {"batch": "B1"}, "ag9_plant_summary": {}, "txt25_citations": {"version": "v1", "sheet": "items"}}

# Words of an explanation.
EXPLAINED = (("brand", "品牌"), ("model", "型号"), ("dn", "口径"), ("pressure", "压力"))
LABELS = "WHEN 'AUTO_MERGE' THEN '自动归并' WHEN 'REVIEW' THEN '人工复核' WHEN 'NEW' THEN '建议新建' WHEN 'CONFIRMED_NEW' THEN '审核后新建'"
# End of fixed values.
#: The fields of a golden record that its index text holds, blank ones left out.
INDEX_FIELDS = ("standard_name", "category", "brand", "model", "dn", "pressure", "material", "source_systems")
#: Steps of a workflow.
WORKFLOW_STEPS = 8
#: Violations of a standard tree, by rule.
TREE_RULES = [
    ("REQUIRED", "coalesce(trim(full_code), '') = '' OR coalesce(trim(item_name), '') = '' OR coalesce(trim(major_name), '') = ''"),
    ("NUMERIC", "translate(full_code, '0123456789', '') <> ''"),
    ("LENGTH", "length(major) <> 2 OR length(middle) <> 4 OR length(minor) <> 6 OR length(full_code) <> 8"),
    ("HIERARCHY", "substring(middle, 1, 2) <> major OR substring(minor, 1, 4) <> middle OR substring(full_code, 1, 6) <> minor"),
]

STATEMENTS = {
    # Text of records.
    "txt24_paths": """SELECT full_code, item_name, concat_ws(' / ', major_name, middle_name, minor_name, item_name) AS path,
 concat_ws(' ', full_code, major_name, middle_name, minor_name, item_name, nullif(example, '')) AS content FROM {entries}""",
    "txt25_citations": """SELECT citation, sheet, row_no, full_code, item_name FROM (SELECT concat(upper(substring(sha256(concat(:version, '|', major)), 1, 12)), '#', :sheet, '!', substring(full_code, 5, 4)) AS citation,
  :sheet AS sheet, substring(full_code, 5, 4) AS row_no, full_code, item_name, row_number() OVER (PARTITION BY major, substring(full_code, 5, 4) ORDER BY full_code, item_name, middle_name, major_name) AS k FROM {entries}) x WHERE k = 1""",
    "txt27_retention_end": f"SELECT batch_id, CAST(created + CASE classification {RETENTION} END * INTERVAL '1' DAY AS DATE) AS until FROM {{batches}}",
    "txt34_explanations": f"""WITH c AS (SELECT mdm_code, listagg(line, '；') WITHIN GROUP (ORDER BY line) AS risks FROM (SELECT mdm_code, concat(field, '存在冲突（', vals, '）') AS line FROM {{conflicts}}) x GROUP BY mdm_code)
 SELECT m.mdm_code, concat('系统将 ', source_count, ' 条来源记录归入黄金编码 ', m.mdm_code, '。', '治理决策为', CASE decision {LABELS} ELSE decision END, '，置信度 ', CAST(CAST(confidence AS DECIMAL(5, 2)) AS VARCHAR(9)), '。',
  CASE WHEN concat({', '.join(f"coalesce(trim({f}), '')" for f, _ in EXPLAINED)}) <> '' THEN concat('主要依据：', concat_ws('、', {', '.join(f"CASE WHEN coalesce(trim({f}), '') <> '' THEN '{word}一致' END" for f, word in EXPLAINED)}), '。') ELSE '' END,
  CASE WHEN risks IS NOT NULL THEN concat('风险提示：', risks, '，因此需要人工复核。') WHEN source_count > 1 THEN '关键属性未发现硬冲突，可按当前规则建议归并。' ELSE '未检索到可安全归并的同物记录，建议作为新增候选。' END) AS sentence
 FROM {{masters}} m JOIN {{golden}} g ON g.mdm_code = m.mdm_code LEFT JOIN c ON c.mdm_code = m.mdm_code""",
    "txt35_index_text": f"""SELECT mdm_code, concat_ws(' ', {', '.join(f"nullif(trim({c}), '')" for c in INDEX_FIELDS)}) AS content FROM {{golden}}""",
    # Aggregates of golden records.
    "ag2_conflicts": """SELECT component, count(DISTINCT nullif(model, '')) AS models, count(DISTINCT nullif(dn, '')) AS dns, count(DISTINCT nullif(pressure, '')) AS pressures, count(DISTINCT nullif(material, '')) AS materials,
 count(DISTINCT nullif(model, '')) > 1 OR count(DISTINCT nullif(dn, '')) > 1 OR count(DISTINCT nullif(pressure, '')) > 1 OR count(DISTINCT nullif(material, '')) > 1 AS conflict FROM {attributed} GROUP BY component""",
    "ag3_rule_codes": """SELECT p.mapping_id, p.mdm_code, concat(CASE decision WHEN 'NEW' THEN 'R007' WHEN 'REVIEW' THEN 'R006/R008' ELSE 'R001/R005' END, '/R010-', :method, CASE WHEN anomaly_count > 0 THEN '/R009' ELSE '' END) AS rules,
 decision = 'REVIEW' AS to_review FROM {mappings} p JOIN {masters} m ON m.mdm_code = p.mdm_code""",
    "ag7_batch_summary": """SELECT count(*) AS masters, CAST(sum(source_count) AS BIGINT) AS records, count(CASE WHEN decision = 'AUTO_MERGE' THEN 1 END) AS merged, count(CASE WHEN decision = 'REVIEW' THEN 1 END) AS review,
 count(CASE WHEN decision IN ('NEW', 'CONFIRMED_NEW') THEN 1 END) AS fresh, round(100.0 * (sum(source_count) - count(*)) / sum(source_count), 1) + 0e0 AS compression FROM {masters}""",
    "ag8_collaboration": f"""SELECT count(CASE WHEN decision IN {APPROVED} THEN 1 END) AS approved, count(CASE WHEN plants LIKE '%,%' THEN 1 END) AS shared, CAST(sum(source_count - 1) AS BIGINT) AS avoided,
 CAST(sum(CASE WHEN decision IN {APPROVED} THEN CASE WHEN concat(',', plants, ',') LIKE '%,GROUP,%' THEN 2 ELSE length(plants) - length(replace(plants, ',', '')) + 1 END ELSE 0 END) AS BIGINT) AS potential,
 round(100.0 * count(CASE WHEN plants LIKE '%,%' THEN 1 END) / count(*), 1) + 0e0 AS shared_rate, CAST(sum(source_count - 1) AS DOUBLE) / 2 AS hours FROM {{masters}}""",
    "ag9_plant_summary": f"""SELECT plant, count(*) AS masters, count(CASE WHEN decision IN {APPROVED} THEN 1 END) AS approved, CAST(sum(source_count - 1) AS BIGINT) AS avoided
 FROM {{masters}} m CROSS JOIN {{plants}} WHERE plant = 'GROUP' OR {REACHES.format('plant')} GROUP BY plant""",
    "ag10_source_root": """WITH h AS (SELECT batch_id, sha256(concat(row_id, '|', material_code, '|', system_source, '|', material_name, '|', description, '|', category, '|', unit, '|', plant_code)) AS hash FROM {records}),
 g AS (SELECT batch_id, substring(hash, 1, 3) AS part, hash FROM h), b AS (SELECT batch_id, part, listagg(hash, '') WITHIN GROUP (ORDER BY hash) AS hashes FROM g GROUP BY batch_id, part),
 c AS (SELECT batch_id, sha256(concat(part, ':', hashes)) AS digest FROM b), d AS (SELECT batch_id, listagg(digest, '') WITHIN GROUP (ORDER BY digest) AS digests FROM c GROUP BY batch_id)
 SELECT batch_id, sha256(concat(digests)) AS root FROM d""",
    "ag11_problem_records": "SELECT count(*) AS problems FROM (SELECT DISTINCT system_source, row_id FROM {issues}) x",
    "ag12_duplicate_codes": """WITH n AS (SELECT system_source, plant_code, material_code, count(*) AS n FROM {materials} WHERE material_code <> '' GROUP BY system_source, plant_code, material_code)
 SELECT row_id, n FROM {materials} m JOIN n ON m.system_source = n.system_source AND m.plant_code = n.plant_code AND m.material_code = n.material_code WHERE n > 1""",
    "ag13_issue_capture": """WITH n AS (SELECT system_source, plant_code, material_code FROM {materials} WHERE material_code <> '' GROUP BY system_source, plant_code, material_code HAVING count(*) > 1),
 f AS (SELECT row_id, code FROM {found} UNION SELECT row_id, 'LINEAGE_MISSING' FROM {origins} WHERE coalesce(source_record_id, '') = '' OR coalesce(record_hash, '') = '' UNION SELECT row_id, 'DUPLICATE_CODE' FROM {materials} m JOIN n ON m.system_source = n.system_source AND m.plant_code = n.plant_code AND m.material_code = n.material_code)
 SELECT concat('DQI-', upper(substring(sha256(concat(:batch, ':', row_id, ':', f.code)), 1, 16))) AS issue_id, row_id, f.code, rule_id, dimension, coalesce(default_severity, 'MEDIUM') AS severity,
  CASE coalesce(default_severity, 'MEDIUM') WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 5 ELSE 10 END AS due_days FROM f JOIN {rules} r ON r.code = f.code WHERE active""",
    "ag14_issue_summary": """SELECT status, dimension, count(*) AS n, count(CASE WHEN status IN ('OPEN', 'ACKNOWLEDGED') AND due_in < 8 THEN 1 END) AS overdue FROM {issues} GROUP BY status, dimension""",
    "ag15_controls_by_domain": """SELECT domain, count(*) AS controls, count(CASE WHEN status = 'IMPLEMENTED' THEN 1 END) AS implemented, count(CASE WHEN status = 'MONITORED' THEN 1 END) AS monitored,
 count(CASE WHEN status = 'PLANNED' THEN 1 END) AS planned, round(avg(maturity), 2) AS maturity FROM {controls} GROUP BY domain""",
    "ag16_feedback_by_code": """SELECT mdm_code, avg(rating) AS rating, avg(CASE WHEN accepted THEN 1 ELSE 0 END) AS acceptance, listagg(comment, ';') WITHIN GROUP (ORDER BY comment) AS comments, count(*) AS n FROM {deliveries} GROUP BY mdm_code""",
    "ag17_vector_stats": "SELECT provider, dimension, namespace, count(*) AS n, max(vec_id) AS newest FROM {vectors} GROUP BY provider, dimension, namespace",
    "ag18_tree_stats": "SELECT count(DISTINCT major) AS major, count(DISTINCT middle) AS middle, count(DISTINCT minor) AS minor, count(*) AS n FROM {entries}",
    "ag19_compliance": """SELECT classification, count(*) AS batches, count(CASE WHEN held THEN 1 END) AS holds, count(DISTINCT owner) AS owners, max(r.n) AS active_rules
 FROM {batches} CROSS JOIN (SELECT count(CASE WHEN active THEN 1 END) AS n FROM {rules}) r GROUP BY classification""",
    "ag20_workflow_progress": f"""WITH s AS (SELECT batch_id, step_code, status FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, step_code ORDER BY ts DESC, step_id DESC) AS k FROM {{steps}}) x WHERE k = 1)
 SELECT batch_id, count(CASE WHEN status = 'COMPLETED' THEN 1 END) AS completed_steps, {WORKFLOW_STEPS} AS total_steps, round(100.0 * count(CASE WHEN status = 'COMPLETED' THEN 1 END) / {WORKFLOW_STEPS}, 1) + 0e0 AS progress,
  count(CASE WHEN status = 'COMPLETED' THEN 1 END) = {WORKFLOW_STEPS} AS closed_loop FROM s GROUP BY batch_id""",
    "ag21_review_progress": """SELECT plant_code, count(CASE WHEN status = 'PENDING' THEN 1 END) AS pending, count(CASE WHEN status <> 'PENDING' THEN 1 END) AS resolved,
 round(100.0 * count(CASE WHEN status <> 'PENDING' THEN 1 END) / count(*), 1) + 0e0 AS percent FROM {reviews} GROUP BY plant_code""",
    "ag22_delivery_summary": """SELECT batch_id, plant_code, count(CASE WHEN success THEN 1 END) AS success, count(CASE WHEN NOT success THEN 1 END) AS failed,
 listagg(hash, ',') WITHIN GROUP (ORDER BY hash) AS hashes FROM (SELECT batch_id, plant_code, success, substring(sha256(concat(mdm_code, '|', plant_code, '|', target_system)), 1, 16) AS hash FROM {deliveries}) d GROUP BY batch_id, plant_code""",
    "ag23_tree_violations": " UNION ALL ".join(f"SELECT full_code, item_name, '{name}' AS violation FROM {{entries}} WHERE {test}" for name, test in TREE_RULES)
    + """ UNION ALL SELECT e.full_code, e.item_name, 'DUPLICATE' FROM {entries} e JOIN (SELECT full_code FROM {entries} GROUP BY full_code HAVING count(*) > 1) d ON d.full_code = e.full_code
 UNION ALL SELECT coalesce(target, ''), CAST(alias AS VARCHAR(20)), 'ALIAS_CODE' FROM {aliases} WHERE coalesce(length(target), 0) <> 8
 UNION ALL SELECT what, concat(n, ' expected, ', found, ' found'), 'EXPECTED_COUNT' FROM (SELECT what, n, CASE what WHEN 'entries' THEN (SELECT count(*) FROM {entries}) ELSE (SELECT count(*) FROM {aliases}) END AS found FROM {expected}) c WHERE n <> found""",
    "ag24_source_issues": """SELECT i.row_id, coalesce(nullif(i.system_source, ''), 'CSV导入') AS source, i.plant_code, i.code, i.dimension, i.severity, i.status, material_code AS source_id FROM {issues} i JOIN {materials} m ON m.row_id = i.row_id""",
    "ag25_step_metrics": """WITH d AS (SELECT batch_id, count(DISTINCT mdm_code) AS masters, count(*) AS deliveries, count(CASE WHEN success THEN 1 END) AS delivered, count(CASE WHEN accepted THEN 1 END) AS feedback FROM {deliveries} GROUP BY batch_id)
 SELECT b.batch_id, record_count, coalesce(masters, 0) AS masters, coalesce(deliveries, 0) AS deliveries, coalesce(delivered, 0) AS delivered, coalesce(feedback, 0) AS feedback FROM {batches} b LEFT JOIN d ON d.batch_id = b.batch_id""",
    # Reports.
    "rp1_governance_report": f"""WITH m AS (SELECT count(*) AS masters, CAST(sum(source_count) AS BIGINT) AS records, count(CASE WHEN decision IN {APPROVED} THEN 1 END) AS approved FROM {{masters}}),
 i AS (SELECT count(*) AS issues, count(CASE WHEN status IN ('OPEN', 'ACKNOWLEDGED') THEN 1 END) AS open FROM {{issues}}), d AS (SELECT count(*) AS deliveries, count(CASE WHEN success THEN 1 END) AS delivered, count(CASE WHEN accepted THEN 1 END) AS accepted FROM {{deliveries}}),
 s AS (SELECT count(*) AS steps, count(CASE WHEN status = 'COMPLETED' THEN 1 END) AS completed FROM {{steps}})
 SELECT *, sha256(concat(masters, '|', records, '|', approved, '|', issues, '|', open, '|', deliveries, '|', delivered, '|', accepted, '|', steps, '|', completed)) AS content_hash FROM m CROSS JOIN i CROSS JOIN d CROSS JOIN s""",
    "rp2_decision_evidence": """WITH s AS (SELECT mdm_code, mapping_id, material_code, system_source, row_number() OVER (PARTITION BY mdm_code ORDER BY mapping_id) AS place FROM {mappings})
 SELECT m.mdm_code, decision, CASE decision WHEN 'NEW' THEN 'R007' WHEN 'REVIEW' THEN 'R006/R008' ELSE 'R001/R005' END AS rules, place, mapping_id, material_code, system_source FROM {masters} m JOIN s ON s.mdm_code = m.mdm_code WHERE place <= 20""",
}
