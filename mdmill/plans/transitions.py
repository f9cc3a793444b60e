"""State machines as SQL over named relations: a table of requests applied to a table of states.

Every statement returns a row for each state or request, with what it became
and, where a request is refused, why.
"""

from __future__ import annotations

from mdmill.functions import rules
from mdmill.plans.statements import APPROVED, REACHES

ISSUE_EDGES = """edges AS (SELECT 'OPEN' AS a, 'ACKNOWLEDGED' AS b UNION ALL SELECT 'OPEN', 'RESOLVED' UNION ALL SELECT 'OPEN', 'WAIVED' UNION ALL SELECT 'ACKNOWLEDGED', 'OPEN'
 UNION ALL SELECT 'ACKNOWLEDGED', 'RESOLVED' UNION ALL SELECT 'ACKNOWLEDGED', 'WAIVED' UNION ALL SELECT 'RESOLVED', 'OPEN' UNION ALL SELECT 'WAIVED', 'OPEN')"""
LIFECYCLE_EDGES = """edges AS (SELECT 'PENDING' AS a, 'REVIEWED' AS b, 'lifecycle.review' AS permission UNION ALL SELECT 'PENDING', 'REJECTED', 'lifecycle.review' UNION ALL SELECT 'REVIEWED', 'APPROVED', 'lifecycle.approve'
 UNION ALL SELECT 'REVIEWED', 'REJECTED', 'lifecycle.approve' UNION ALL SELECT 'APPROVED', 'ARCHIVED', 'lifecycle.approve')"""

CODE_PREFIX = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.CODE_PREFIXES.items()) + " ELSE 'MDM-X' END"

STATEMENTS = {
    "st1_review_decisions": """WITH d AS (SELECT r.review_id, r.mdm_code, q.action, q.plant_code IN ('GROUP', r.plant_code) AS in_scope FROM {reviews} r JOIN {decisions} q ON q.review_id = r.review_id WHERE r.status = 'PENDING')
 SELECT m.mdm_code, CASE WHEN NOT coalesce(in_scope, false) OR action = 'SKIP' THEN m.decision WHEN action = 'MERGE' THEN 'AUTO_MERGE' ELSE 'CONFIRMED_NEW' END AS decision,
  CASE WHEN in_scope AND action = 'MERGE' THEN 0.95 WHEN in_scope AND action = 'NEW' THEN 1.0 END AS confidence,
  CASE WHEN review_id IS NULL THEN 'NO_REQUEST' WHEN NOT in_scope THEN 'OUT_OF_SCOPE' WHEN action = 'SKIP' THEN 'SKIPPED' ELSE 'RESOLVED' END AS review FROM {masters} m LEFT JOIN d ON m.mdm_code = d.mdm_code""",
    "st1_mapping_decisions": """WITH d AS (SELECT r.mdm_code, q.action FROM {reviews} r JOIN {decisions} q ON q.review_id = r.review_id WHERE r.status = 'PENDING' AND q.plant_code IN ('GROUP', r.plant_code) AND q.action <> 'SKIP')
 SELECT mapping_id, p.mdm_code, CASE action WHEN 'MERGE' THEN 'AUTO_MERGE' ELSE 'CONFIRMED_NEW' END AS decision FROM {mappings} p JOIN d ON d.mdm_code = p.mdm_code""",
    "st2_issue_transitions": f"""WITH {ISSUE_EDGES}, r AS (SELECT i.row_id, i.code, i.status, q.wanted, q.resolution, q.own, i.plant_code FROM {{issues}} i JOIN {{issue_requests}} q ON q.row_id = i.row_id AND q.code = i.code)
 SELECT row_id, code, CASE WHEN b IS NULL OR own NOT IN ('GROUP', plant_code) OR (wanted IN ('RESOLVED', 'WAIVED') AND resolution = '') THEN status ELSE b END AS status,
  CASE WHEN own NOT IN ('GROUP', plant_code) THEN 'OUT_OF_SCOPE' WHEN b IS NULL THEN 'NO_SUCH_STEP' WHEN wanted IN ('RESOLVED', 'WAIVED') AND resolution = '' THEN 'NO_RESOLUTION' ELSE 'DONE' END AS outcome
 FROM r LEFT JOIN edges ON status = a AND wanted = b""",
    "st3_lifecycle": f"""WITH {LIFECYCLE_EDGES} SELECT l.request_id, coalesce(b, l.status) AS status,
  CASE WHEN wanted IS NULL THEN 'NO_REQUEST' WHEN b IS NULL THEN 'REFUSED' ELSE 'DONE' END AS outcome,
  CASE WHEN b = 'APPROVED' AND (mdm_code = '' OR mdm_code LIKE 'NEW-%') THEN concat({CODE_PREFIX}, '-', upper(substring(sha1(concat(category, '|', name, '|', l.request_id)), 1, 8))) END AS minted
 FROM {{lifecycle}} l LEFT JOIN {{lifecycle_updates}} u ON u.request_id = l.request_id LEFT JOIN edges ON l.status = a AND wanted = b AND granted = permission""",
    "st4_publish": """WITH c AS (SELECT catalog, version_id AS current FROM {versions} WHERE status = 'PUBLISHED'),
 p AS (SELECT v.catalog, v.version_id AS target FROM {versions} v JOIN {publish_requests} q ON q.catalog = v.catalog AND q.target = v.version_id LEFT JOIN c ON c.catalog = v.catalog
  WHERE v.status IN ('VALIDATED', 'RETIRED') AND (q.expected_current IS NULL OR q.expected_current IS NOT DISTINCT FROM c.current))
 SELECT v.version_id, v.catalog, CASE WHEN p.target IS NULL THEN v.status WHEN v.version_id = p.target THEN 'PUBLISHED' WHEN v.status = 'PUBLISHED' THEN 'RETIRED' ELSE v.status END AS status,
  CASE WHEN v.version_id = p.target AND v.status = 'RETIRED' THEN 'ROLLBACK' WHEN v.version_id = p.target THEN 'PUBLISH' ELSE '' END AS event FROM {versions} v LEFT JOIN p ON p.catalog = v.catalog""",
    "st4_idempotent_source": "SELECT catalog, source_hash, min(version_id) AS version_id, count(*) AS submitted FROM {versions} GROUP BY catalog, source_hash",
    "st5_assessments": """SELECT control, maturity, status, CASE WHEN maturity NOT BETWEEN 1 AND 5 THEN 'BAD_MATURITY' WHEN status NOT IN ('IMPLEMENTED', 'MONITORED', 'PLANNED') THEN 'BAD_STATUS' ELSE 'STORED' END AS outcome FROM {assessments}""",
    "st6_changed_steps": """SELECT step_id AS event_id, status FROM (SELECT step_id, status, metrics, lag(status) OVER (PARTITION BY batch_id ORDER BY ts, step_id) AS old, lag(metrics) OVER (PARTITION BY batch_id ORDER BY ts, step_id) AS old_metrics
  FROM {steps}) x WHERE status IS DISTINCT FROM old OR metrics IS DISTINCT FROM old_metrics""",
    "st7_deliveries": f"""SELECT t.task_id, t.mdm_code, t.target_system, t.plant, CASE WHEN m.mdm_code IS NULL THEN 'FAILED' WHEN decision IN {APPROVED} AND {REACHES.format('t.plant')} THEN 'SUCCESS' ELSE 'FAILED' END AS outcome,
  CASE WHEN m.mdm_code IS NULL THEN 'UNKNOWN_CODE' WHEN decision NOT IN {APPROVED} THEN 'NOT_APPROVED' WHEN NOT {REACHES.format('t.plant')} THEN 'OUT_OF_SCOPE' ELSE '' END AS reason,
  sha256(concat(t.mdm_code, '|', t.target_system, '|', t.plant)) AS payload_hash FROM {{tasks}} t LEFT JOIN {{masters}} m ON t.mdm_code = m.mdm_code""",
    "st8_feedback_intake": """WITH sent AS (SELECT DISTINCT mdm_code, plant_code FROM {deliveries} WHERE success)
 SELECT d.batch_id, d.line, d.mdm_code, d.plant_code, CASE WHEN d.rating NOT BETWEEN 1 AND 5 THEN 'BAD_RATING' WHEN s.mdm_code IS NULL THEN 'NOT_DELIVERED' ELSE 'STORED' END AS outcome
 FROM {deliveries} d LEFT JOIN sent s ON s.mdm_code = d.mdm_code AND s.plant_code = d.plant_code""",
    "st9_hold_intervals": """WITH h AS (SELECT batch_id, ts, step_id, held, lag(held, 1, false) OVER (PARTITION BY batch_id ORDER BY ts, step_id) AS before FROM {holds}),
 c AS (SELECT batch_id, step_id AS opened, held, lead(step_id) OVER (PARTITION BY batch_id ORDER BY ts, step_id) AS closed FROM h WHERE held <> before) SELECT batch_id, opened, closed FROM c WHERE held""",
    "st11_one_active_profile": "SELECT batch_id, owner, batch_id = max(batch_id) OVER (PARTITION BY owner) AS active FROM {batches}",
}
