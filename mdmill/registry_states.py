"""Registered queries of machines that apply requests in order, of versions and of workflows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdmill.operators import machines
from mdmill.plans import relations
from mdmill.plans.statements import REACHES

FIFTH = "CAST(floor(event_id / 5.0) AS BIGINT)"
#: Requests over driver tables: five events in a row ask something of one issue, review or lifecycle; events of a user hold a batch.
REQUESTS = {
    "st2_issue_sequences": f"""SELECT row_id, code, event_id AS seq, CASE event_type WHEN 'view' THEN 'ACKNOWLEDGED' WHEN 'click' THEN 'RESOLVED' WHEN 'purchase' THEN 'OPEN' ELSE 'WAIVED' END AS wanted,
 CASE WHEN event_id % 3 = 0 THEN '' ELSE 'mended' END AS resolution, CASE WHEN event_id % 7 = 0 THEN 'BEIJING' ELSE 'GROUP' END AS own, plant_code FROM {{events}} JOIN {{issues}} ON row_id = {FIFTH}""",
    "st3_lifecycle_sequences": f"""SELECT request_id, event_id AS seq, CASE WHEN event_id % 5 < 2 THEN 'REVIEWED' WHEN event_id % 5 = 4 THEN 'ARCHIVED' WHEN event_type = 'error' THEN 'REJECTED' ELSE 'APPROVED' END AS wanted,
 CASE WHEN event_id % 5 < 1 OR user_id % 5 = 0 THEN 'lifecycle.review' ELSE 'lifecycle.approve' END AS granted FROM {{events}} JOIN {{lifecycle}} ON request_id = {FIFTH}""",
    "st1_review_sequences": f"""SELECT review_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'LOOK' WHEN 'click' THEN 'MERGE' WHEN 'purchase' THEN 'NEW' ELSE 'SKIP' END AS action,
 CASE WHEN event_id % 3 = 0 THEN 'BEIJING' ELSE 'GROUP' END AS own, plants FROM {{events}} JOIN {{reviews}} ON review_id = {FIFTH}""",
    "st9_hold_sequences": "SELECT user_id AS batch_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN true WHEN 'click' THEN false END AS held FROM {events}",
    "st7_delivery_sequences": f"""SELECT t.task_id, seq, t.task_id % 4 <> 0 OR seq > 1 AS confirmed, CASE WHEN seq > 1 AND decision = 'REVIEW' AND m.mdm_code % 2 = 0 THEN 'NEW' ELSE decision END AS decision,
 coalesce({REACHES.format('t.plant')}, false) AS reaches FROM {{tasks}} t CROSS JOIN (SELECT 1 AS seq UNION ALL SELECT 2 UNION ALL SELECT 3) n LEFT JOIN {{masters}} m ON m.mdm_code = t.mdm_code""",
}
STATES = {
    "st2_issue_sequences": "SELECT row_id, code, status AS state FROM {issues}",
    "st3_lifecycle_sequences": "SELECT request_id, status AS state FROM {lifecycle}",
    "st1_review_sequences": "SELECT review_id, mdm_code, plants, CASE status WHEN 'PENDING' THEN 'REVIEW' ELSE 'APPROVED' END AS state FROM {reviews}",
    "st9_hold_sequences": "SELECT DISTINCT user_id AS batch_id, CASE WHEN user_id % 3 = 0 THEN 'HELD' ELSE 'FREE' END AS state FROM {events} WHERE user_id % 10 > 0",
    "st7_delivery_sequences": "SELECT task_id, CASE WHEN task_id % 9 = 0 THEN 'SUCCESS' ELSE 'PENDING' END AS state FROM {tasks}",
}
#: keys, step, alphabet, and the step as SQL over `cur`: outcome, and the state after outcomes that change it.
MACHINES = {
    "st2_issue_sequences": (
        ["row_id", "code"], machines.issue_step, tuple(machines.ISSUE_EDGES),
        """CASE WHEN own NOT IN ('GROUP', plant_code) THEN 'OUT_OF_SCOPE' WHEN NOT CASE cur WHEN 'OPEN' THEN wanted <> 'OPEN' WHEN 'ACKNOWLEDGED' THEN wanted <> 'ACKNOWLEDGED' ELSE wanted = 'OPEN' END THEN 'NO_SUCH_STEP'
 WHEN wanted IN ('RESOLVED', 'WAIVED') AND trim(resolution) = '' THEN 'NO_RESOLUTION' ELSE 'DONE' END""", "CASE outcome WHEN 'DONE' THEN wanted ELSE cur END",
    ),
    "st3_lifecycle_sequences": (
        ["request_id"], machines.lifecycle_step, tuple(machines.LIFECYCLE_EDGES),
        """CASE WHEN wanted = cur THEN 'UNCHANGED' WHEN NOT CASE cur WHEN 'PENDING' THEN wanted IN ('REVIEWED', 'REJECTED') WHEN 'REVIEWED' THEN wanted IN ('APPROVED', 'REJECTED') WHEN 'APPROVED' THEN wanted = 'ARCHIVED' ELSE false END THEN 'NO_SUCH_STEP'
 WHEN granted = CASE cur WHEN 'PENDING' THEN 'lifecycle.review' ELSE 'lifecycle.approve' END THEN 'DONE' ELSE 'NOT_PERMITTED' END""", "CASE outcome WHEN 'DONE' THEN wanted ELSE cur END",
    ),
    "st1_review_sequences": (
        ["review_id"], machines.review_step, machines.REVIEW_STATES,
        """CASE WHEN cur <> 'REVIEW' THEN 'NOT_FOUND' WHEN action NOT IN ('MERGE', 'NEW', 'SKIP') THEN 'BAD_ACTION' WHEN own <> 'GROUP' AND concat(',', plants, ',') NOT LIKE concat('%,', own, ',%') THEN 'OUT_OF_SCOPE'
 WHEN action = 'SKIP' THEN 'SKIPPED' ELSE 'DONE' END""", "CASE outcome WHEN 'DONE' THEN 'APPROVED' WHEN 'SKIPPED' THEN 'SKIPPED' ELSE cur END",
    ),
    "st9_hold_sequences": (
        ["batch_id"], machines.hold_step, ("HELD", "FREE"),
        "CASE WHEN cur IS NULL THEN 'UNKNOWN' WHEN held IS NULL OR held = (cur = 'HELD') THEN 'UNCHANGED' WHEN held THEN 'OPENED' ELSE 'CLOSED' END", "CASE outcome WHEN 'OPENED' THEN 'HELD' WHEN 'CLOSED' THEN 'FREE' ELSE cur END",
    ),
    "st7_delivery_sequences": (
        ["task_id"], machines.delivery_step, ("PENDING", "FAILED", "SUCCESS"),
        """CASE WHEN cur = 'SUCCESS' THEN 'ALREADY_DELIVERED' WHEN NOT confirmed THEN 'NOT_CONFIRMED' WHEN decision IS NULL THEN 'UNKNOWN_CODE' WHEN decision NOT IN ('AUTO_MERGE', 'NEW', 'CONFIRMED_NEW') THEN 'NOT_APPROVED'
 WHEN reaches THEN 'DELIVERED' ELSE 'OUT_OF_SCOPE' END""", "CASE WHEN outcome IN ('ALREADY_DELIVERED', 'NOT_CONFIRMED') THEN cur WHEN outcome = 'DELIVERED' THEN 'SUCCESS' ELSE 'FAILED' END",
    ),
}
VERSION_REQUESTS = """SELECT catalog, version_id AS seq, CASE version_id % 4 WHEN 0 THEN 'VALIDATE' WHEN 1 THEN 'ROLLBACK' ELSE 'PUBLISH' END AS action,
 CASE WHEN version_id % 5 = 0 THEN lag(version_id) OVER w WHEN version_id % 5 = 1 THEN -1 ELSE version_id END AS target,
 CASE WHEN version_id % 6 = 0 THEN lag(version_id) OVER w WHEN version_id % 6 = 1 THEN version_id END AS expected_current FROM {versions} WINDOW w AS (PARTITION BY catalog ORDER BY version_id)"""


def _rows(spark, sf_dir, sql: str) -> DataFrame:
    return relations.run_standins(spark, sf_dir, sql)


def _applied(spark, sf_dir, name: str) -> DataFrame:
    keys, step, alphabet, *_ = MACHINES[name]
    return machines.apply_in_order(_rows(spark, sf_dir, STATES[name]), _rows(spark, sf_dir, REQUESTS[name]), keys, step, alphabet)


def _sequence(name: str):
    keys = MACHINES[name][0]
    return lambda spark, sf_dir: _applied(spark, sf_dir, name).select(*keys, "seq", "before", "after", "outcome")


def _sequence_body(name: str) -> str:
    """The machine as a recursive query: step k of a key acts on what step k - 1 left."""
    keys, _, _, outcome, after = MACHINES[name]
    same = " AND ".join(f"q.{k} = s.{k}" for k in keys)
    one = f"SELECT *, {after} AS after FROM (SELECT *, {outcome} AS outcome FROM (SELECT q.*, {{0}} AS cur FROM {{1}}) x) y"
    first = one.format("f.state", f"q LEFT JOIN ({STATES[name]}) f ON " + " AND ".join(f"q.{k} = f.{k}" for k in keys) + " WHERE q.k = 1")
    more = one.format("s.after", f"s JOIN q ON {same} AND q.k = s.k + 1")
    return f"""WITH q AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY seq) AS k FROM ({REQUESTS[name]}) r), s AS ({first} UNION ALL {more}) """


def _sequence_sql(name: str, select: str | None = None) -> str:
    select = select or f"SELECT {', '.join(MACHINES[name][0])}, seq, cur AS before, after, outcome FROM s"
    return relations.oracle(_sequence_body(name) + select).replace("WITH ", "WITH RECURSIVE ", 1)


def decided_mappings(spark, sf_dir):
    """Mappings whose master a review decided, with the decision that stands after all requests."""
    name = "st1_review_sequences"
    reviews = _rows(spark, sf_dir, STATES[name])
    rows = _rows(spark, sf_dir, "SELECT mapping_id, p.mdm_code, decision FROM {mappings} p JOIN {masters} m ON m.mdm_code = p.mdm_code")
    return machines.decided(rows, reviews, _applied(spark, sf_dir, name))


def minted(spark, sf_dir):
    """Masters that approvals made, in order of their requests."""
    applied = _applied(spark, sf_dir, "st3_lifecycle_sequences")
    rows = _rows(spark, sf_dir, "SELECT request_id, name, description, category, brand, '' AS model, plant_code, mdm_code FROM {lifecycle}")
    return machines.minted_masters(rows, applied).select("mdm_code", "standard_name", "category", "brand", "decision", "confidence", "code_prefix", "plant_code", "request_id")


def holds(spark, sf_dir):
    return machines.hold_intervals(_applied(spark, sf_dir, "st9_hold_sequences"))


def _activated(spark, sf_dir):
    return machines.activate_versions(_rows(spark, sf_dir, "SELECT catalog, version_id, status FROM {versions}"), _rows(spark, sf_dir, VERSION_REQUESTS))


def version_events(spark, sf_dir):
    return _activated(spark, sf_dir)[1].select("catalog", "seq", "action", "target", "outcome", "previous")


def version_states(spark, sf_dir):
    return _activated(spark, sf_dir)[0]


def searchable_versions(spark, sf_dir):
    """The version that each request of a catalog may search: the one it wants, or the published one."""
    versions = _rows(spark, sf_dir, "SELECT catalog, version_id, status FROM {versions}")
    asked = _rows(spark, sf_dir, "SELECT seq, catalog, CASE WHEN seq % 2 = 0 THEN target END AS wanted FROM (" + VERSION_REQUESTS + ") r")
    return machines.searchable(versions, asked).select("seq", "version_id", "refusal")


_LIST = "(SELECT catalog, list(struct_pack(id := version_id, status := status) ORDER BY version_id) AS list FROM {versions} GROUP BY catalog)"
_VERSION_STEP = """SELECT *, CASE WHEN outcome = 'VALIDATED' THEN list_transform(of, lambda v: CASE WHEN v.id = target THEN struct_pack(id := v.id, status := 'VALIDATED') ELSE v END)
 WHEN outcome IN ('PUBLISHED', 'ROLLED_BACK') THEN list_transform(of, lambda v: CASE WHEN v.id = target THEN struct_pack(id := v.id, status := 'PUBLISHED') WHEN v.status = 'PUBLISHED' THEN struct_pack(id := v.id, status := 'RETIRED') ELSE v END)
 ELSE of END AS after FROM (SELECT *, CASE WHEN status IS NULL THEN 'UNKNOWN' WHEN action <> 'VALIDATE' AND expected_current IS NOT NULL AND expected_current IS DISTINCT FROM previous THEN 'CHANGED'
 WHEN action <> 'VALIDATE' AND target = previous THEN 'UNCHANGED' WHEN action = 'VALIDATE' AND status NOT IN ('DRAFT', 'VALIDATED') OR action = 'PUBLISH' AND status <> 'VALIDATED' OR action = 'ROLLBACK' AND status NOT IN ('RETIRED', 'VALIDATED') THEN 'REFUSED'
 WHEN action = 'VALIDATE' THEN 'VALIDATED' WHEN action = 'PUBLISH' THEN 'PUBLISHED' ELSE 'ROLLED_BACK' END AS outcome
 FROM (SELECT *, list_filter(of, lambda v: v.id = target)[1].status AS status, list_filter(of, lambda v: v.status = 'PUBLISHED')[1].id AS previous FROM (SELECT q.*, %s AS of FROM %s) a) b) c"""
_VERSIONS = (
    "WITH q AS (SELECT *, row_number() OVER (PARTITION BY catalog ORDER BY seq) AS k FROM (" + VERSION_REQUESTS + ") r), s AS ("
    + _VERSION_STEP % ("f.list", f"q JOIN {_LIST} f ON f.catalog = q.catalog WHERE q.k = 1") + " UNION ALL " + _VERSION_STEP % ("s.after", "s JOIN q ON q.catalog = s.catalog AND q.k = s.k + 1") + ") "
)


def _version_sql(select: str) -> str:
    return relations.oracle(_VERSIONS + select).replace("WITH ", "WITH RECURSIVE ", 1)


QUERIES = {name: _sequence(name) for name in MACHINES} | {
    "st1_decided_mappings": decided_mappings,
    "st3_minted_masters": minted,
    "st9_hold_history": holds,
    "st4_version_events": version_events,
    "st4_version_states": version_states,
    "jn6_searchable_versions": searchable_versions,
}
ORACLE_SQL = {name: _sequence_sql(name) for name in MACHINES} | {
    "st1_decided_mappings": _sequence_sql(
        "st1_review_sequences",
        """, d AS (SELECT mdm_code, arg_max(action, seq) AS action FROM s JOIN {reviews} USING (review_id) WHERE outcome = 'DONE' GROUP BY mdm_code)
 SELECT mapping_id, p.mdm_code, CASE action WHEN 'MERGE' THEN 'AUTO_MERGE' WHEN 'NEW' THEN 'NEW' ELSE decision END AS decision, CASE action WHEN 'MERGE' THEN 0.95 WHEN 'NEW' THEN 1.0 END::DOUBLE AS confidence
 FROM {mappings} p JOIN {masters} m ON m.mdm_code = p.mdm_code LEFT JOIN d ON d.mdm_code = p.mdm_code""",
    ),
    "st9_hold_history": _sequence_sql(
        "st9_hold_sequences",
        """, e AS (SELECT batch_id, seq AS opened, outcome, lead(seq) OVER (PARTITION BY batch_id ORDER BY seq) AS closed FROM s WHERE outcome IN ('OPENED', 'CLOSED'))
 SELECT batch_id, opened, closed FROM e WHERE outcome = 'OPENED'""",
    ),
    "st4_version_events": _version_sql("SELECT catalog, seq, action, target, outcome, previous FROM s"),
    "st4_version_states": _version_sql(
        """, l AS (SELECT catalog, arg_max(after, k) AS of FROM s GROUP BY catalog), u AS (SELECT catalog, unnest(of) AS v FROM l) SELECT catalog, v.id AS version_id, v.status AS status FROM u"""
    ),
    "jn6_searchable_versions": relations.oracle(
        "SELECT seq, CASE WHEN seq % 2 = 0 AND target IS NOT NULL THEN CASE WHEN v.status = 'PUBLISHED' THEN target END ELSE a.version_id END AS version_id, "
        "CASE WHEN seq % 2 = 0 AND target IS NOT NULL THEN CASE WHEN v.version_id IS NULL THEN 'NOT_FOUND' WHEN v.status <> 'PUBLISHED' THEN 'NOT_PUBLISHED' END WHEN a.version_id IS NULL THEN 'NOT_FOUND' END AS refusal "
        "FROM (" + VERSION_REQUESTS + ") r LEFT JOIN {versions} v ON v.catalog = r.catalog AND v.version_id = target LEFT JOIN {versions} a ON a.catalog = r.catalog AND a.status = 'PUBLISHED'"
    ),
}
