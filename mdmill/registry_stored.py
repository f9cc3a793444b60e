"""Registered queries of stored tables, units of tables, added columns and connectors, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdmill.functions import rules
from mdmill.plans import relations
from mdmill.session import save, scratch_root
from mdmill.sources import stored
from mdmill.sources.connectors import connector_registry
from mdmill.sources.materials import materials

TODAY = "1997-01-01"
#: Changes to masters: some newer, some older than what is stored, some new.
CHANGES = """SELECT mdm_code, concat(standard_name, ' II') AS standard_name, CASE WHEN mdm_code % 6 = 0 THEN 4 ELSE 9 END AS updated FROM {masters} WHERE mdm_code % 3 = 0
 UNION ALL SELECT -1 - mdm_code, standard_name, 9 FROM {masters} WHERE mdm_code % 50 = 7"""
#: Tables that go when their batch does, by batch.
CHILDREN = {
    "mappings": "SELECT batch_id, mapping_id FROM (SELECT l_orderkey AS batch_id, l_orderkey * 10 + l_linenumber AS mapping_id FROM {lines}) x",
    "deliveries": "SELECT batch_id, line FROM {deliveries}",
    "steps": "SELECT batch_id, step_id FROM {steps}",
}
UNTIL = f"SELECT batch_id, CAST(created + CASE classification {relations.RETENTION} END * INTERVAL '1' DAY AS DATE) AS retention_until, held FROM {{batches}}"
UNIT = {
    "records": "SELECT batch_id, row_id AS id FROM {records}",
    "batch_masters": "SELECT DISTINCT batch_id, mdm_code AS id FROM {mappings}",
    "mappings": "SELECT batch_id, mapping_id AS id FROM {mappings}",
    "reviews": "SELECT DISTINCT p.batch_id, review_id AS id FROM {reviews} r JOIN {mappings} p ON p.mdm_code = r.mdm_code",
    "report": "SELECT batch_id, count(*) AS id FROM {records} GROUP BY batch_id",
}


def _rows(spark, sf_dir, sql: str) -> DataFrame:
    return relations.run_standins(spark, sf_dir, sql)


def _folder(spark, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def connectors(spark, sf_dir):
    """The registry with how many records each connector brought; two are configured."""
    systems = materials(spark, sf_dir).select("system_source")
    known = connector_registry(spark, {"SAP", "EAM"})
    names = [k for k in rules.CONNECTORS if k != "CSV"]
    of = F.coalesce(*(F.when(F.upper("system_source").contains(k), F.lit(k)) for k in names), F.lit("CSV"))
    counted = systems.groupBy(of.alias("of")).agg(F.count("*").alias("n"))
    return known.join(counted, F.col("system") == F.col("of"), "left").select(*known.columns, F.coalesce("n", F.lit(0)).alias("records"))


def merged(spark, sf_dir):
    """Masters after two merges of the same changes into a stored table."""
    path = _folder(spark, "masters")
    stored.create(_rows(spark, sf_dir, "SELECT mdm_code, standard_name, 5 AS updated FROM {masters}"), path, ["mdm_code"])
    changes = _rows(spark, sf_dir, CHANGES)
    stored.merge(spark, path, changes, "updated")
    stored.merge(spark, path, changes, "updated")
    return stored.read(spark, path)


def _retained(spark, sf_dir) -> tuple[DataFrame, dict[str, DataFrame]]:
    batches, children = _folder(spark, "batches"), {n: _folder(spark, n) for n in CHILDREN}
    stored.create(_rows(spark, sf_dir, UNTIL), batches, ["batch_id"])
    for name, path in children.items():
        stored.create(_rows(spark, sf_dir, CHILDREN[name]), path, ["batch_id"])
    report = stored.retain(spark, batches, children, F.lit(TODAY).cast("date"), False, stored.CONFIRM)
    return report, {n: stored.read(spark, p) for n, p in (children | {"batches": batches}).items()}


def retention_report(spark, sf_dir):
    return _retained(spark, sf_dir)[0]


def retention_left(spark, sf_dir):
    """Rows of each batch in each table after retention."""
    out = None
    for name, df in _retained(spark, sf_dir)[1].items():
        some = df.groupBy("batch_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "batch_id", "n")
        out = some if out is None else out.unionByName(some)
    return out


def units(spark, sf_dir):
    """Rows of the five tables of two published units, of which the first was published again without its odd batches."""
    root = _folder(spark, "units")
    tables = {n: save(_rows(spark, sf_dir, sql), n)[0] for n, sql in UNIT.items()}
    part = lambda where: {n: df.where(where) for n, df in tables.items()}
    stored.publish(spark, root, "low", part("batch_id < 20"))
    stored.publish(spark, root, "high", part("batch_id >= 20"))
    stored.publish(spark, root, "low", part("batch_id < 20 AND batch_id % 2 = 0"))
    out = None
    for name in tables:
        some = stored.published(spark, root, name).groupBy("unit", "batch_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "unit", "batch_id", "n")
        out = some if out is None else out.unionByName(some)
    return out


def added_columns(spark, sf_dir):
    """Batches of three ages: without a classification, without a hold, and with both."""
    rows = relations.standin(spark, sf_dir, "batches")
    ages = [
        rows.where("batch_id % 3 = 0").select("batch_id", "owner"),
        rows.where("batch_id % 3 = 1").select("owner", "batch_id", "classification"),
        rows.where("batch_id % 3 = 2").select("batch_id", "owner", "classification", "held"),
    ]
    return stored.union_evolved(ages, {"classification": "INTERNAL", "held": False})


QUERIES = {
    "src4_connectors": connectors,
    "src5_units": units,
    "src6_merged_table": merged,
    "src9_retention_cascade": retention_left,
    "src9_cascade_report": retention_report,
    "src11_added_columns": added_columns,
}
_GONE = f"u AS ({UNTIL}), g AS (SELECT batch_id FROM u WHERE retention_until <= DATE '{TODAY}' AND NOT held)"
_ALL = CHILDREN | {"batches": "SELECT batch_id FROM {batches}"}
_CONNECTORS = " UNION ALL ".join(
    f"SELECT '{k}' AS system, '{i}' AS connector_id, '{name}' AS name, '{t}' AS source_object, {str(k in ('SAP', 'EAM', 'CSV')).lower()} AS configured"
    for (k, (i, t)), name in zip(rules.CONNECTORS.items(), rules.CONNECTOR_NAMES.values())
)
_SYSTEM = "CASE " + " ".join(f"WHEN contains(upper(system_source), '{k}') THEN '{k}'" for k in rules.CONNECTORS if k != "CSV") + " ELSE 'CSV' END"
ORACLE_SQL = {
    "src4_connectors": relations.oracle(
        f"SELECT c.*, CASE WHEN configured THEN 'CONNECTED' ELSE 'DEMO_ADAPTER' END AS status, coalesce(n, 0) AS records FROM ({_CONNECTORS}) c LEFT JOIN (SELECT {_SYSTEM} AS s, count(*) AS n FROM {{materials}} GROUP BY 1) m ON s = system"
    ),
    "src5_units": relations.oracle(
        " UNION ALL ".join(
            f"SELECT '{n}' AS table_name, CASE WHEN batch_id < 20 THEN 'low' ELSE 'high' END AS unit, batch_id, count(*) AS n FROM ({sql}) t{i} WHERE batch_id >= 20 OR batch_id % 2 = 0 GROUP BY batch_id" for i, (n, sql) in enumerate(UNIT.items())
        )
    ),
    "src6_merged_table": relations.oracle(
        f"""SELECT mdm_code, standard_name, updated FROM (SELECT *, row_number() OVER (PARTITION BY mdm_code ORDER BY updated DESC, late DESC) AS k
 FROM (SELECT mdm_code, standard_name, 5 AS updated, 0 AS late FROM {{masters}} UNION ALL SELECT *, 1 FROM ({CHANGES}) c) x) y WHERE k = 1"""
    ),
    "src9_retention_cascade": relations.oracle(
        f"WITH {_GONE} " + " UNION ALL ".join(f"SELECT '{n}' AS table_name, batch_id, count(*) AS n FROM ({sql}) t{i} WHERE batch_id NOT IN (SELECT batch_id FROM g) GROUP BY batch_id" for i, (n, sql) in enumerate(_ALL.items()))
    ),
    "src9_cascade_report": relations.oracle(
        f"WITH {_GONE} "
        + " UNION ALL ".join(
            f"SELECT '{n}' AS table_name, u.batch_id, CASE WHEN any_value(held) THEN 'HELD' ELSE 'DELETE' END AS action, count(*) AS n FROM u JOIN ({sql}) t{i} ON t{i}.batch_id = u.batch_id WHERE retention_until <= DATE '{TODAY}' GROUP BY u.batch_id"
            for i, (n, sql) in enumerate(_ALL.items())
        )
    ),
    "src11_added_columns": relations.oracle(
        "SELECT batch_id, owner, CASE WHEN batch_id % 3 = 0 THEN 'INTERNAL' ELSE classification END AS classification, batch_id % 3 = 2 AND held AS held FROM {batches}"
    ),
}
