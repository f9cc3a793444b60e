"""Requests in order: sequences, keys cut over tasks, versions of catalogs."""

import random

import pytest
from pyspark.sql import functions as F

from mdmill.operators import machines

ISSUE = "row_id long, code string, seq long, wanted string, resolution string, own string, plant_code string"


def folded(states, requests, keys, step):
    """The outcomes by a plain loop."""
    now, out = dict(states), {}
    for q in sorted(requests, key=lambda q: q["seq"]):
        key = tuple(q[k] for k in keys)
        before = now.get(key)
        if before is None:
            out[key, q["seq"]] = (None, None, "UNKNOWN")
            continue
        now[key], outcome = step(before, q)
        out[key, q["seq"]] = (before, now[key], outcome)
    return out, now


def test_open_acknowledged_resolved_in_one_batch(spark):
    states = spark.createDataFrame([(1, "X", "OPEN"), (2, "X", "OPEN")], "row_id long, code string, state string")
    asked = spark.createDataFrame(
        [(1, "X", 1, "ACKNOWLEDGED", "", "GROUP", "SHANGHAI"), (1, "X", 2, "RESOLVED", "done", "SHANGHAI", "SHANGHAI"), (1, "X", 3, "WAIVED", "no", "GROUP", "SHANGHAI"), (9, "X", 1, "OPEN", "", "GROUP", "")], ISSUE
    )
    applied = machines.apply_in_order(states, asked, ["row_id", "code"], machines.issue_step, tuple(machines.ISSUE_EDGES))
    got = {(r["row_id"], r["seq"]): (r["before"], r["after"], r["outcome"]) for r in applied.collect()}
    assert got == {
        (1, 1): ("OPEN", "ACKNOWLEDGED", "DONE"), (1, 2): ("ACKNOWLEDGED", "RESOLVED", "DONE"), (1, 3): ("RESOLVED", "RESOLVED", "NO_SUCH_STEP"), (9, 1): (None, None, "UNKNOWN"),
    }
    last = machines.final_states(states, applied, ["row_id", "code"])
    assert {r["row_id"]: r["state"] for r in last.collect()} == {1: "RESOLVED", 2: "OPEN"} and last.columns == states.columns
    assert machines.apply_in_order(states, asked.limit(0), ["row_id", "code"], machines.issue_step, tuple(machines.ISSUE_EDGES)).count() == 0


@pytest.mark.parametrize("alphabet", [tuple(machines.ISSUE_EDGES), None])
def test_a_key_with_most_requests_spreads_over_tasks(spark, alphabet):
    rnd = random.Random(2)
    keys = [(1, "X")] * 8 + [(k, "Y") for k in range(2, 7)]
    requests = []
    for seq in range(3000):
        key = rnd.choice(keys)
        requests.append({"row_id": key[0], "code": key[1], "seq": seq, "wanted": rnd.choice(list(machines.ISSUE_EDGES)), "resolution": rnd.choice(["", "r", None]), "own": rnd.choice(["GROUP", "GROUP", "BEIJING"]), "plant_code": "SHANGHAI"})
    states = {(1, "X"): "OPEN", **{(k, "Y"): "WAIVED" for k in range(2, 6)}}
    want, last = folded(states, requests, ["row_id", "code"], machines.issue_step)
    frame = spark.createDataFrame([tuple(q.values()) for q in requests], ISSUE).repartition(5)
    known = spark.createDataFrame([(*k, s) for k, s in states.items()], "row_id long, code string, state string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        applied = machines.apply_in_order(known, frame, ["row_id", "code"], machines.issue_step, alphabet)
        rows = applied.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert {((r["row_id"], r["code"]), r["seq"]): (r["before"], r["after"], r["outcome"]) for r in rows} == want
    assert (len({r["task"] for r in rows if r["row_id"] == 1}) > 2) == bool(alphabet)
    assert {(r["row_id"], r["code"]): r["state"] for r in machines.final_states(known, applied, ["row_id", "code"]).collect()} == last


def test_reviews_change_masters_once(spark):
    reviews = spark.createDataFrame([(1, 10, "SHANGHAI", "REVIEW"), (2, 20, "BEIJING", "REVIEW"), (3, 30, "GROUP", "REVIEW")], "review_id long, mdm_code long, plants string, state string")
    asked = spark.createDataFrame([(1, 1, "MERGE", "BEIJING"), (1, 2, "MERGE", "SHANGHAI"), (1, 3, "NEW", "GROUP"), (2, 1, "SKIP", "GROUP"), (3, 1, "NEW", "GROUP"), (7, 1, "NEW", "GROUP")], "review_id long, seq long, action string, own string")
    applied = machines.decide_reviews(reviews, asked)
    assert {(r["review_id"], r["seq"]): r["outcome"] for r in applied.collect()} == {(1, 1): "OUT_OF_SCOPE", (1, 2): "DONE", (1, 3): "NOT_FOUND", (2, 1): "SKIPPED", (3, 1): "DONE", (7, 1): "UNKNOWN"}
    masters = spark.createDataFrame([(10, "REVIEW"), (20, "REVIEW"), (30, "REVIEW"), (40, "NEW")], "mdm_code long, decision string")
    got = {r["mdm_code"]: (r["decision"], r["confidence"]) for r in machines.decided(masters, reviews, applied).collect()}
    assert got == {10: ("AUTO_MERGE", 0.95), 20: ("REVIEW", None), 30: ("NEW", 1.0), 40: ("NEW", None)}


def test_an_approval_mints_a_master(spark):
    columns = "request_id long, name string, description string, category string, brand string, model string, plant_code string, mdm_code string"
    rows = spark.createDataFrame(
        [(1, "深沟球轴承", "6312-2RS SKF", "轴承", "", "", "SHANGHAI", ""), (2, "截止件", "DN50 PN16", "闸阀", "Acme", "Z41H", "GROUP", "NEW-7"), (3, "x", "", "闸阀", "", "", "GROUP", "MDM-53-KEPT"), (4, "y", "", "闸阀", "", "", "GROUP", None)], columns
    )
    states = rows.select("request_id", F.when(F.col("request_id") == 4, "PENDING").otherwise("REVIEWED").alias("state"))
    asked = spark.createDataFrame([(i, 1, "APPROVED", "lifecycle.approve") for i in (1, 2, 3, 4)] + [(1, 2, "ARCHIVED", "lifecycle.approve")], "request_id long, seq long, wanted string, granted string")
    applied = machines.apply_in_order(states, asked, ["request_id"], machines.lifecycle_step, tuple(machines.LIFECYCLE_EDGES))
    got = {r["request_id"]: r.asDict() for r in machines.minted_masters(rows, applied).collect()}
    import hashlib

    digest = lambda t: hashlib.sha1(t.encode()).hexdigest()[:8].upper()
    assert set(got) == {1, 2}
    assert got[1]["mdm_code"] == f"MDM-51-{digest('轴承|深沟球轴承|1')}" and got[2]["mdm_code"] == f"MDM-53-{digest('闸阀|截止件|2')}"
    assert got[1]["brand"] == "SKF" and got[1]["standard_name"].endswith("深沟球轴承") and got[2]["standard_name"] == "Acme Z41H 截止件 闸阀"
    assert got[2]["dn"] == "50" and got[2]["pressure"] and (got[1]["decision"], got[1]["confidence"], got[1]["source_systems"], got[1]["code_prefix"]) == ("NEW", 1.0, "lifecycle", "MDM-51")


def test_publishing_and_rolling_back_versions(spark):
    """1 RETIRED, 2 PUBLISHED, 3 VALIDATED, 4 DRAFT: the current one is the published one, whatever its number."""
    versions = spark.createDataFrame([("c", 1, "RETIRED"), ("c", 2, "PUBLISHED"), ("c", 3, "VALIDATED"), ("c", 4, "DRAFT"), ("d", 9, "VALIDATED"), ("e", 5, "DRAFT")], "catalog string, version_id int, status string")
    asked = [
        ("c", 1, "PUBLISH", 3, 1), ("c", 2, "PUBLISH", 3, 2), ("c", 3, "PUBLISH", 3, None), ("c", 4, "PUBLISH", 4, None), ("c", 5, "VALIDATE", 4, None),
        ("c", 6, "PUBLISH", 1, None), ("c", 7, "ROLLBACK", 2, 3), ("c", 8, "PUBLISH", 4, 2), ("c", 9, "VALIDATE", 4, None), ("d", 1, "PUBLISH", 9, None), ("d", 2, "PUBLISH", 77, None),
    ]
    states, events = machines.activate_versions(versions, spark.createDataFrame(asked, "catalog string, seq long, action string, target int, expected_current int"))
    assert [(r["outcome"], r["previous"]) for r in sorted(events.where("catalog = 'c'").collect(), key=lambda r: r["seq"])] == [
        ("CHANGED", 2), ("PUBLISHED", 2), ("UNCHANGED", 3), ("REFUSED", 3), ("VALIDATED", 3), ("REFUSED", 3), ("ROLLED_BACK", 3), ("PUBLISHED", 2), ("REFUSED", 4),
    ]
    assert {r["version_id"]: r["status"] for r in states.collect()} == {1: "RETIRED", 2: "RETIRED", 3: "RETIRED", 4: "PUBLISHED", 9: "PUBLISHED", 5: "DRAFT"}
    assert {tuple(r) for r in machines.active_versions(states).collect()} == {("c", 4), ("d", 9)}
    want = spark.createDataFrame([(1, "c", None), (2, "c", 3), (3, "c", 50), (4, "e", None), (5, "d", 9)], "q int, catalog string, wanted int")
    got = {r["q"]: (r["version_id"], r["refusal"]) for r in machines.searchable(states, want).collect()}
    assert got == {1: (4, None), 2: (None, "NOT_PUBLISHED"), 3: (None, "NOT_FOUND"), 4: (None, "NOT_FOUND"), 5: (9, None)}
    assert {r["q"]: r["version_id"] for r in machines.searchable(states, want, True).collect()}[2] == 3
    with pytest.raises(ValueError, match="more than one"):
        machines.activate_versions(versions.withColumn("status", F.lit("PUBLISHED")), events)


def test_requests_of_a_kind_are_worked_out_once(spark):
    """A task asks the step once for each state and kind of request, not for each row; lists are values too."""
    asked = spark.range(4000).select((F.col("id") % 500).alias("task_id"), F.col("id").alias("seq"), (F.col("id") % 3 > 0).alias("confirmed"), F.lit("NEW").alias("decision"), (F.col("id") % 7 > 0).alias("reaches"), F.array(F.lit("x")).alias("tags"))
    states = spark.range(499).select(F.col("id").alias("task_id"), F.lit("PENDING").alias("state"))
    calls = spark.sparkContext.accumulator(0)

    def step(state, q):
        calls.add(1)
        assert q["tags"] == ["x"] and "seq" not in q
        return machines.delivery_step(state, q)

    applied = machines.apply_in_order(states, asked, ["task_id"], step, None).collect()
    want, _ = folded({(k,): "PENDING" for k in range(499)}, [r.asDict() for r in asked.collect()], ["task_id"], machines.delivery_step)
    assert {((r["task_id"],), r["seq"]): (r["before"], r["after"], r["outcome"]) for r in applied} == want
    assert 0 < calls.value < 1000
