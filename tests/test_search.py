"""Indexes, citations, suggestions, delivery filters and nested redaction on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from mdmill.functions import semantics
from mdmill.operators import access, indexing, knowledge, retrieve
from mdmill.sources import materials

CASES = [
    ("把【品牌：SKF】【型号 6312】发往上海厂SAP系统", ("SKF", "6312", "")),
    ("品牌: FAG 型号: 6205 发往北京", ("FAG", "6205", "")),
    ("【NSK】【6314】【轴承】同步到WMS", ("NSK", "6314", "轴承")),
    ("【SAP】【上海】【NSK】发往SAP", ("NSK", "", "")),
    ("【物料名称：深沟球轴承】【SKF】发往SAP", ("SKF", "", "深沟球轴承")),
    ("查重", ("", "", "")),
    ("", ("", "", "")),
]


def test_delivery_filters(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(99, None)], "id int, text string")
    found = {r["id"]: (r["brand"], r["model"], r["name"]) for r in df.select("id", semantics.delivery_filters(F.col("text")).alias("f")).select("id", "f.*").collect()}
    for i, (_, expected) in enumerate(CASES):
        assert found[i] == expected
    assert found[99] == ("", "", "")


def test_nested_redaction(spark):
    deep = "[" * 12 + "1" + "]" * 12
    rows = [(1, '{"a":{"API-Key":"k","b":[{"Password":1},"x"]}}'), (2, "no json"), (3, None), (4, deep), (5, json.dumps({"t": "y" * 900, "l": list(range(150))})), (6, "[" * 100_000)]
    found = {r["i"]: r["d"] for r in spark.createDataFrame(rows, "i int, d string").select("i", access.redact_json("d").alias("d")).collect()}
    assert json.loads(found[1]) == {"a": {"API-Key": "[REDACTED]", "b": [{"Password": "[REDACTED]"}, "x"]}}
    assert found[2] == "no json" and found[3] is None and found[4] == "[" * 9 + '"[MAX_DEPTH]"' + "]" * 9
    assert len(json.loads(found[5])["t"]) == 500 and len(json.loads(found[5])["l"]) == 100 and len(found[6]) == 500


def _index(spark):
    rows = spark.createDataFrame([(1, "gate valve DN50"), (2, "深沟球轴承 6312"), (3, "gate valve DN80"), (4, "")], "key long, content string")
    return knowledge.build_index(rows)


def test_search_index(spark):
    index = _index(spark).withColumn("plant_codes", F.array(F.when(F.col("key") == 3, "BEIJING").otherwise("SHANGHAI")))
    asked = spark.createDataFrame([(7, "gate valve DN50"), (8, "轴承 6312"), (9, None), (10, "gate valve DN50")], "query_id long, text string").na.fill("")
    found = {(r["query_id"], r["rank"]): r for r in indexing.search_index(asked, index, 2).collect()}
    assert found[7, 1]["key"] == 1 and found[7, 1]["score"] == 1.0 and found[7, 2]["key"] == 3 and found[8, 1]["key"] == 2
    assert found[10, 1]["key"] == 1 and (found[9, 1]["key"], found[9, 1]["score"]) == (1, 0.0)
    seen = indexing.search_index(asked, index, 5, "masters", "BEIJING").collect()
    assert {r["key"] for r in seen} == {3} and indexing.search_index(asked, index, 5, "other").count() == 0
    assert indexing.search_index(asked.limit(0), index).count() == 0
    with pytest.raises(ValueError):
        indexing.search_index(asked, index, 51)


def test_standard_search(spark):
    asked = spark.createDataFrame([(1, "SKF 滚动轴承"), (2, "gate valve Z41")], "query_id long, text string")
    best = {r["query_id"]: r["key"] for r in indexing.standard_search(asked).where("rank = 1").collect()}
    assert best == {1: "SYT-MDM-51-BEARING", 2: "SYT-MDM-53-GATE"}


def test_reindex_replaces_one_version(spark):
    chunks = spark.createDataFrame([(1, "a", "valve"), (2, "b", "bearing"), (3, "a", "")], "chunk_id long, version_id string, content string").withColumn("content_hash", F.sha2("content", 256))
    both = [indexing.reindex(chunks, chunks.select("chunk_id", "version_id", F.lit(0).alias("dimension"), "content_hash", F.array().cast("array<int>").alias("idx"), F.array().cast("array<double>").alias("w")), v, 16) for v in ("a", "c")]
    found = {r["chunk_id"]: r for r in both[0].collect()}
    assert {i: r["dimension"] for i, r in found.items()} == {1: 16, 2: 0, 3: 16} and max(found[1]["idx"]) < 16 and found[3]["idx"] == []
    assert abs(sum(x * x for x in found[1]["w"]) - 1) < 1e-9
    assert both[1].count() == 3


def test_embed_falls_back(spark):
    rows = [(1, "ok", True), (2, "ok", False), (3, "nan", True), (4, "short", True), (5, "", True), (6, None, None), (7, "boom", True)]
    df = spark.createDataFrame(rows, "id long, text string, allowed boolean")

    def model(texts):
        if "boom" in texts:
            raise RuntimeError
        return [{"ok": [1.0, 2.0], "nan": [float("nan"), 0.0], "short": [1.0]}[t] for t in texts]

    found = {r["id"]: r for r in indexing.embed(df, model, 2, "m", batch=1).collect()}
    assert {i: r["provider"] for i, r in found.items()} == {1: "m", **{i: "local" for i in range(2, 8)}}
    assert found[1]["vector"] == [1.0, 2.0] and all(len(found[i]["vector"]) == semantics.DIMENSION for i in range(2, 8))
    assert set(found[5]["vector"]) == {0.0} and any(found[7]["vector"])
    assert indexing.embed(df.limit(0), model, 2).count() == 0


def test_citations_and_suggestions(spark):
    row = ("S1", "2018", "f.xlsx", "abcdef0123456789", "items", 3, "A3:F3")
    fields = "standard_no string, version_label string, filename string, source_sha256 string, sheet string, row_no long, cell_range string, record_sha256 string, code string"
    rows = spark.createDataFrame([(*row, "h1", "A"), (*row, "h2", "A")], fields)
    found = retrieve.citations(rows, F.concat("code", F.lit("!"))).collect()
    assert [(r["citation_id"], r["record_sha256"], r["excerpt"]) for r in found] == [("ABCDEF012345#items!3", "h2", "A!")]
    masters = spark.createDataFrame(
        [(1, "SKF 6312 轴承", "轴承", "6312", "SKF", 1), (2, "FAG 6312 轴承", "轴承", "6312", "FAG", 5)],
        "row_id long, name string, std_category string, model string, brand string, source_count long",
    ).withColumns({c: F.lit("") for c in ("dn", "pressure", "material")})
    asked = spark.createDataFrame([(1, "SKF 6312 轴承", None), (2, "SKF 6312 轴承", 3)], "query_id long, text string, qty_min int")
    found = retrieve.attribute_search(asked, masters, suggestions=10).collect()
    seen = {(r["query_id"], r["row_id"]): (r["suggestion"], r["matched"], r["required"]) for r in found}
    assert seen[1, 1] == (False, 3, 3) and (1, 2) not in seen
    assert seen[2, 1] == (True, 3, 4) and seen[2, 2] == (True, 3, 4)


def test_provenance(spark):
    rows = [(1, "M1", "SAP", {"Record ID": " X/1 ", "来源链接": "HTTPS://e/1"}), (2, "M*2", "EAM", {"deep_link": "ftp://x", "源表": "T 1"}), (3, "", None, None)]
    df = spark.createDataFrame(rows, "row_id long, material_code string, system_source string, _extra map<string,string>")
    df = df.withColumns({f: F.lit("") for f in materials.FIELDS if f not in df.columns})
    found = {r["row_id"]: r["provenance"] for r in materials.provenance(df, {"eam-rest": "https://eam/"}).collect()}
    assert (found[1]["source_id"], found[1]["source_table"], found[1]["status"], found[1]["source_url"]) == ("X/1", "MARA", "CONFIGURED", "HTTPS://e/1")
    assert (found[2]["status"], found[2]["source_url"]) == ("CONFIGURED", "https://eam/T%201/M%2A2")
    assert (found[3]["status"], found[3]["source_url"]) == ("DEMO", "demo://file-import/CSV_ROW/ROW-000003")
    bare = {r["row_id"]: r["provenance"] for r in materials.provenance(df.drop("_extra")).collect()}
    assert bare[2]["status"] == "DEMO" and bare[3]["record_hash"] == found[3]["record_hash"]
