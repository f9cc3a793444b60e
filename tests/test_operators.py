"""Retrieval, clustering, delivery, lineage, access and streams against plain Python on small tables."""

import hashlib
import math

from pyspark.sql import functions as F

from mdmill.functions import rules, semantics
from mdmill import registry
from mdmill.operators import access, audit, cluster, delivery, knowledge, lineage, quality, retrieve
from mdmill.plans import relations
from mdmill.session import scratch_root
from mdmill.sources import materials
from mdmill.streaming.audit import blocks_through_stream


def test_map_headers():
    found = materials.map_headers(["物料编码", "物料名称", "物料描述", "物料类别", "计量单位", "物料子类", "供应商"])
    assert found["material_code"] == "物料编码" and found["material_name"] == "物料名称" and found["category"] == "物料类别"
    assert len(set(found.values())) == len(found) and "供应商" not in found.values()
    assert materials.map_headers([]) == {}


def _records(spark):
    rows = []
    for i in range(120):
        model = ["", "6312", "6314", "EJA110A"][i * 7 % 4]
        rows.append((i, ["轴承", "闸阀", "法兰"][i % 3], model, ["", "SKF", "FAG"][i * 5 % 3], ["", "50", "80"][i * 11 % 3], ["", "1.6MPa"][i * 13 % 2]))
    return rows, spark.createDataFrame(rows, "row_id long, std_category string, model string, brand string, dn string, pressure string")


def test_leaders_match_the_sequential_rule(spark):
    rows, df = _records(spark)
    whole = F.concat(F.concat_ws(" ", "std_category", "model", "brand"), F.lit(" DN"), F.concat_ws(" ", "dn", "pressure"))
    from mdmill.functions import text

    letters = {r[0]: set("".join(r[1].split())) for r in df.select("row_id", F.lower(text.standardize(whole))).collect()}
    groups, expected = [], {}
    for r in rows:
        for lead in groups:
            clash = r[1] != lead[1] or any(r[j] and lead[j] and r[j] != lead[j] for j in (2, 4, 5))
            a, b = letters[r[0]], letters[lead[0]]
            if not clash and len(a & b) / len(a | b) >= rules.LEADER_EDGE:
                expected[r[0]] = lead[0]
                break
        else:
            groups.append(r)
            expected[r[0]] = r[0]
    assert {r["row_id"]: r["leader"] for r in cluster.leader_clusters(df).collect()} == expected
    assert cluster.leader_clusters(df.limit(0)).count() == 0


def test_anomalies(spark):
    rows = [(i, "n" * (5 + i % 3), "d" * (9 + i % 4), "SAP", "M") for i in range(200)] + [(999, "n" * 90, "", "", "")]
    df = spark.createDataFrame(rows, "row_id long, material_name string, description string, system_source string, material_code string")
    found = {r["row_id"]: r for r in cluster.anomalies(df).collect()}
    assert len(found) == 201 and max(found, key=lambda i: found[i]["score"]) == 999 and found[999]["anomaly"]
    assert sum(r["anomaly"] for r in found.values()) <= 10
    assert not any(r["anomaly"] for r in cluster.anomalies(df.limit(5)).collect())


def test_hashed_vectors_match_python(spark):
    got = semantics.hashed_vectors(spark.createDataFrame([(1, "ab1"), (2, " ")], "id long, t string"), semantics.pieces(semantics.bare(F.col("t")))).collect()
    want = [0.0] * 384
    for piece in ["a", "b", "1", "ab", "b1", "ab1"]:
        d = hashlib.sha256(piece.encode()).digest()
        want[int.from_bytes(d[:4], "big") % 384] += 1 if d[4] & 1 else -1
    norm = math.sqrt(sum(v * v for v in want))
    assert {r["idx"]: round(r["w"], 9) for r in got} == {i: round(v / norm, 9) for i, v in enumerate(want) if v}
    assert {r["id"] for r in got} == {1}


def test_hybrid_search(spark):
    tree = spark.createDataFrame([("10010101", "轴承 / 深沟球轴承"), ("20010101", "阀门 / 闸阀")], "code string, content string")
    aliases = spark.createDataFrame([("10010101", "bearing,滚动轴承"), ("99999999", "外部")], "target string, keywords string")
    asked = spark.createDataFrame([(1, "SKF bearing 轴承"), (2, "编码20010101"), (3, None), (4, "SKF bearing 轴承")], "query_id long, text string")
    rows = retrieve.hybrid_search(asked, tree, aliases, 2).collect()
    best = {r["query_id"]: r for r in rows if r["rank"] == 1}
    assert best[1]["code"] == "10010101" == best[4]["code"] and best[1]["rule"] == 1.0
    assert best[2]["code"] == "20010101" and best[2]["lexical"] == 1.0 == best[2]["rule"]
    assert all(r["score"] <= 1 for r in rows)


def test_search_conditions(spark):
    asked = spark.createDataFrame([(1, "SKF 轴承 不要316L"), (2, "DN50-100 闸阀 pn16"), (3, "")], "query_id long, text string")
    got = {r["query_id"]: r for r in retrieve.search_conditions(asked).collect()}
    assert (got[1]["q_exclude"], got[1]["q_material"], got[1]["q_brand"]) == ("316L", "", "SKF")
    assert (got[2]["q_dn_from"], got[2]["q_dn_to"], got[2]["q_dn"], got[2]["q_pressure"]) == (50, 100, "", "1.6MPa")
    assert got[3]["q_category"] == "" and got[3]["q_dn_from"] is None


def test_delivery_plan(spark):
    asked = spark.createDataFrame([(1, "把【SKF】【6312】【深沟球轴承】发往上海厂SAP和WMS系统")], "id long, text string")
    intent = delivery.parse_intents(asked)
    row = intent.first()
    assert (row["targets"], row["plants"], row["brand"], row["model"], row["name"], row["mode"]) == (["SAP", "WMS"], ["SHANGHAI"], "SKF", "6312", "深沟球轴承", "FULL")
    rows = [(1, "SKF", "6312", "SKF 6312 深沟球轴承", ["SHANGHAI"], True), (2, "FAG", "6205", "FAG 6205 深沟球轴承", ["GROUP"], True), (3, "SKF", "6312", "SKF 6312 深沟球轴承", ["BEIJING"], True), (4, "SKF", "6312", "x", ["GROUP"], False)]
    masters = spark.createDataFrame(rows, "row_id long, brand string, model string, name string, plant_codes array<string>, approved boolean")
    ranked = delivery.rank_masters(intent, masters)
    got = ranked.orderBy("rank").collect()
    assert [r["row_id"] for r in got] == [1, 2] and got[0]["exact"] and got[0]["level"] == "HIGH" and not got[1]["actionable"]
    assert sorted((r["row_id"], r["target_system"]) for r in delivery.plan_tasks(intent, ranked).collect()) == [(1, "SAP"), (1, "WMS")]
    tasks = delivery.plan_tasks(intent, ranked, masters).collect()
    assert {(r["selection_mode"], r["eligible"], r["selected"], r["status"]) for r in tasks} == {("SINGLE", True, False, "PENDING_CONFIRMATION")}
    one = intent.withColumn("text", F.concat("text", F.lit(" 最相似")))
    assert all(r["selected"] and r["selection_mode"] == "TOP_ONE" for r in delivery.plan_tasks(one, ranked, masters).collect())


def test_ranges(spark):
    batches = spark.createDataFrame([(i, i % 4) for i in range(50)], "batch_id long, n long")
    mappings = spark.range(sum(i % 4 for i in range(50))).repartition(5)
    want = dict(enumerate((b for b in range(50) for _ in range(b % 4)), 1))
    assert {r["k"]: r["batch_id"] for r in lineage.assign_to_ranges(batches, mappings, ["id"]).collect()} == want
    # Nothing is assigned when the totals differ.
    assert lineage.assign_to_ranges(batches, spark.range(3), ["id"]).isEmpty()
    rows = spark.createDataFrame([(k, i) for k in ("a", "b", None) for i in range(20)] + [("hot", i) for i in range(300)], "key string, i long").repartition(4)
    got = lineage.row_numbers(rows, "key", ["i"]).collect()
    assert all(r["row_no"] == r["i"] + 1 for r in got) and len(got) == 360


def test_access_rules(spark):
    """Decisions as the rules of the service state them: open paths, deletes, exact paths and prefixes."""
    asked = [
        ("/api/health", "GET", ""), ("/api/live", "POST", ""), ("/api/auth/login", "POST", ""), ("/api/auth/me", "GET", "data.read"), ("/index.html", "GET", ""),
        ("/api/reviews/3", "DELETE", "data.purge"), ("/api/reviews/3", "PATCH", "review.decide"), ("/api/reviews", "GET", "data.read"),
        ("/api/batches", "POST", "data.ingest"), ("/api/batches/B1", "GET", "data.read"), ("/api/batches/B1/compliance", "DELETE", "data.purge"),
        ("/api/lifecycle", "POST", "lifecycle.create"), ("/api/lifecycle/4", "PATCH", ""), ("/api/lifecycle", "GET", "data.read"),
        ("/api/search", "POST", "ai.use"), ("/api/search/history", "DELETE", "data.purge"), ("/api/search/history", "GET", "data.read"),
        ("/api/distribute", "POST", "distribution.execute"), ("/api/distribute/logs", "DELETE", "data.purge"), ("/api/vectors/rebuild", "POST", "knowledge.manage"),
        ("/api/ocr/install", "GET", "data.read"), ("/api/ocr/install", "POST", "knowledge.manage"), ("/api/governance/issues/7", "PATCH", "review.decide"),
        ("/api/compliance", "DELETE", "compliance.manage"), ("/api/security/audit/verify", "GET", "audit.verify"), ("/api/security/audit", "GET", "audit.read"),
    ]
    rows = spark.createDataFrame(asked, "path string, method string, want string")
    got = rows.withColumn("got", access.needed_permission(F.col("path"), F.col("method"))).where("got <> want").collect()
    assert not got


def test_ledger_appends_behind_its_heads(spark):
    rows = [(c, i, i, f"{c}{i}") for c in (1, 2) for i in range(9)] + [(3, 0, 0, "new")]
    ledger = spark.createDataFrame(rows, "chain long, ts long, event_id long, payload_hash string")
    first = audit.append_blocks(ledger.where("event_id < 5 AND chain < 3"))
    second = audit.append_blocks(ledger.where("event_id >= 5 OR chain = 3"), audit.heads(first))
    key = lambda df: sorted((r["chain"], r["height"], r["block_hash"]) for r in df.collect())
    assert key(first.unionByName(second)) == key(audit.append_blocks(ledger))
    signed = audit.sign(first, b"k")
    assert audit.verify_signed(signed, b"k").where("bad_signature").isEmpty() and audit.verify_signed(signed, b"x").where("NOT bad_signature").isEmpty()
    assert audit.append_blocks(ledger.limit(0)).isEmpty()


def test_statements_over_own_tables(spark):
    """State machines and scopes over small tables of a user's own."""
    run = lambda name, values=None, **tables: relations.run(spark, registry.STATEMENTS[name], values, **tables).collect()
    table = spark.createDataFrame
    masters = table([(1, "n", "c", "GROUP,SHANGHAI", "REVIEW", 3), (2, "n", "c", "BEIJING", "AUTO_MERGE", 2), (3, "n", "c", "GROUP", "NEW", 1)], "mdm_code long, standard_name string, category string, plants string, decision string, source_count int")
    assert sorted(r[0] for r in run("flt1_plant_visible", {"plant": "BEIJING"}, masters=masters)) == [2]
    assert sorted(r[0] for r in run("flt2_distributable", {"plant": "BEIJING"}, masters=masters)) == [1, 2, 3]
    assert sorted(r[0] for r in run("flt1_plant_visible", {"plant": "GROUP"}, masters=masters)) == [1, 2, 3]
    reviews = table([(7, 1, "SHANGHAI", "PENDING")], "review_id long, mdm_code long, plant_code string, status string")
    decided = lambda action, plant: {r["mdm_code"]: (r["decision"], r["confidence"] and float(r["confidence"]), r["review"]) for r in run("st1_review_decisions", masters=masters, reviews=reviews, decisions=table([(7, action, plant)], "review_id long, action string, plant_code string"))}[1]
    assert decided("MERGE", "GROUP") == ("AUTO_MERGE", 0.95, "RESOLVED") and decided("NEW", "SHANGHAI")[:2] == ("CONFIRMED_NEW", 1.0)
    assert decided("SKIP", "GROUP") == ("REVIEW", None, "SKIPPED") and decided("MERGE", "BEIJING") == ("REVIEW", None, "OUT_OF_SCOPE")
    issues = table([(1, "S", "BEIJING", "X", "d", "HIGH", "OPEN", 1), (2, "S", "GROUP", "X", "d", "HIGH", "RESOLVED", 1)], "row_id long, system_source string, plant_code string, code string, dimension string, severity string, status string, due_in int")
    asked = lambda row, wanted, why, own: {r["row_id"]: (r["status"], r["outcome"]) for r in run("st2_issue_transitions", issues=issues, issue_requests=table([(row, "X", wanted, why, own)], "row_id long, code string, wanted string, resolution string, own string"))}[row]
    assert asked(1, "RESOLVED", "", "GROUP") == ("OPEN", "NO_RESOLUTION") and asked(1, "RESOLVED", "done", "BEIJING") == ("RESOLVED", "DONE")
    assert asked(1, "ACKNOWLEDGED", "", "SHANGHAI") == ("OPEN", "OUT_OF_SCOPE") and asked(2, "WAIVED", "x", "GROUP") == ("RESOLVED", "NO_SUCH_STEP")
    tasks = table([(1, 2, "SAP", "BEIJING"), (2, 2, "SAP", "SHANGHAI"), (3, 1, "SAP", "SHANGHAI"), (4, 9, "SAP", "BEIJING")], "task_id long, mdm_code long, target_system string, plant string")
    assert {r["task_id"]: r["reason"] for r in run("st7_deliveries", masters=masters, tasks=tasks)} == {1: "", 2: "OUT_OF_SCOPE", 3: "NOT_APPROVED", 4: "UNKNOWN_CODE"}
    versions = table([(1, 1, "RETIRED", 1, "h"), (2, 1, "PUBLISHED", 2, "h"), (3, 1, "VALIDATED", 3, "h"), (4, 2, "DRAFT", 1, "h"), (5, 3, "VALIDATED", 1, "h")], "version_id long, catalog long, status string, created long, source_hash string")
    published = lambda *asked: {r["version_id"]: r["status"] for r in run("st4_publish", versions=versions, publish_requests=table(list(asked), "catalog long, target long, expected_current long"))}
    assert published((1, 3, 2), (2, 4, None), (3, 5, None)) == {1: "RETIRED", 2: "RETIRED", 3: "PUBLISHED", 4: "DRAFT", 5: "PUBLISHED"}
    assert published((1, 3, 1)) == {1: "RETIRED", 2: "PUBLISHED", 3: "VALIDATED", 4: "DRAFT", 5: "VALIDATED"}
    assert published((1, 1, 2))[1] == "PUBLISHED"
    assert [tuple(r) for r in run("jn6_active_version", versions=versions)] == [(1, 2)]
    members = table([("a", "6312", "", "", ""), ("a", "6312", "50", "", "304"), ("b", "1", "", "", ""), ("b", "2", "", "", "")], "component string, model string, dn string, pressure string, material string")
    assert {r["component"]: r["conflict"] for r in run("ag2_conflicts", attributed=members)} == {"a": False, "b": True}


def test_quality_counts_anomalies(spark):
    rows = spark.createDataFrame([(i, f"M{i}", "SAP", "6312轴承", "d", "轴承", "件") for i in range(4)], "row_id long, material_code string, system_source string, material_name string, description string, category string, unit string")
    got = {r["system"]: r for r in quality.quality_report(rows, rows.where("row_id = 1").select("row_id")).collect()}
    assert got[None]["accuracy"] == 75.0 and got["SAP"]["accuracy"] == 100.0 and got[None]["score"] == 95.0 and got[None]["suggestions"] == "REVIEW_ANOMALIES"
    nothing = quality.quality_report(rows.limit(0)).collect()
    assert [r["score"] for r in nothing] == [0.0] or nothing == []


def test_index_rebuilds_changed_texts_only(spark):
    table = spark.createDataFrame
    old = knowledge.build_index(table([(1, "gate valve"), (2, "pump"), (3, None)], "key long, content string"))
    new = knowledge.build_index(table([(1, "gate valve"), (2, "pump DN50"), (4, "pump DN50")], "key long, content string"), current=old)
    rows = {r["key"]: r for r in new.collect()}
    assert set(rows) == {1, 2, 4} and rows[2]["w"] == rows[4]["w"] and abs(sum(x * x for x in rows[1]["w"]) - 1) < 1e-9
    assert {r["key"]: list(r["idx"]) for r in old.collect()}[3] == []
    pairs = table([(1, "SKF 6312", "SKF 6312"), (2, "a", "b"), (3, "", "")], "id long, a string, b string")
    assert {r["id"]: (r["dense"], r["chars"]) for r in knowledge.text_pairs(pairs).collect()} == {1: (1.0, 1.0), 2: (0.0, 0.0), 3: (0.0, 1.0)}


def test_access_and_redaction(spark):
    asked = [("GROUP_ADMIN", "/api/x", "DELETE", True), ("AUDITOR", "/api/reviews/1", "POST", False), ("AUDITOR", "/api/compliance", "GET", True), (None, "/api/x", "GET", False), (None, "/home", "GET", True)]
    df = spark.createDataFrame(asked, "role string, path string, method string, want boolean")
    assert df.where(access.allowed(F.col("role"), access.needed_permission(F.col("path"), F.col("method"))) != F.col("want")).isEmpty()
    out = spark.range(1).select(access.redact(F.create_map(F.lit("API-Key"), F.lit("k"), F.lit("note"), F.lit("x" * 600))).alias("m")).first()["m"]
    assert out == {"API-Key": "[REDACTED]", "note": "x" * 500}


def test_streamed_chain_verifies(spark):
    rows = [(i % 3, i, i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(30)]
    ledger = spark.createDataFrame(rows, "chain long, ts long, event_id long, payload_hash string")
    blocks = blocks_through_stream(ledger, f"{scratch_root(spark)}/chain-test-{spark.sparkContext.applicationId}")
    checked = audit.verify(blocks)
    assert checked.count() == 30 and checked.where("bad_height OR bad_link OR bad_hash").isEmpty()
