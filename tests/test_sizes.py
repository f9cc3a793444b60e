"""Work that must not grow with copies: equal texts are worked out once, and results stay whole."""

import pytest
from pyspark.sql import functions as F

from mdmill import session
from mdmill.functions import semantics
from mdmill.operators import knowledge, machines, retrieve
from mdmill.sources.materials import enrich


@pytest.fixture
def written(monkeypatch):
    """Rows of each scratch table that an operator of these modules writes, by name."""
    seen = {}

    def watch(module):
        plain = module.save

        def save(df, name="t"):
            out = plain(df, name)
            seen[name] = out[0].count()
            return out

        monkeypatch.setattr(module, "save", save)
        return seen

    return watch


def _materials(spark, copies):
    names = [("SKF 6310 bearing", "304"), ("DN50 gate valve", "PN16 WCB"), ("blue bolt", "")]
    rows = [(c * len(names) + i, f"M{c}", "SAP", n, d, "", "", "", "GROUP") for c in range(copies) for i, (n, d) in enumerate(names)]
    return spark.createDataFrame(rows, "row_id long, material_code string, system_source string, material_name string, description string, category string, unit string, create_time string, plant_code string")


def test_category_candidates_once_a_text(spark, written):
    seen = written(knowledge)
    rows = enrich(_materials(spark, 40))
    found = knowledge.category_candidates(rows).collect()
    assert seen["kinds"] == 3
    of = {}
    for r in found:
        of.setdefault(r["row_id"], []).append((r["rank"], r["category"], r["score"]))
    assert len(of) == 120 and all(len(x) == 3 for x in of.values())
    assert all(sorted(of[i]) == sorted(of[i % 3]) for i in of)
    given = spark.createDataFrame([(3, "螺栓", 1.0)], "row_id long, category string, rag double")
    more = {(r["row_id"], r["category"]): r["score"] for r in knowledge.category_candidates(rows, given).collect()}
    assert more[(3, "螺栓")] == 0.32 and more[(6, "深沟球轴承")] == next(s for _, c, s in of[6] if c == "深沟球轴承")


def test_reference_evidence_once_a_text(spark, written, monkeypatch):
    seen = written(knowledge)
    monkeypatch.setattr(knowledge, "KNOWN_ROWS", 7)
    monkeypatch.setattr(knowledge, "TERMS", 5)
    texts = ["SKF 63", "ab", "gate valve 12", "", "zz"]
    asked = spark.createDataFrame([(i, texts[i % 5]) for i in range(50)], "query_id long, text string")
    known = spark.createDataFrame([(i, f"DN{i % 9}", None, ("xaby" if i % 6 == 5 else f"gate valve {i}"), "SKF") for i in range(40)], "reference_id long, scenario string, standard_no string, standard_name string, purpose string")
    found = {(r["query_id"], r["rank"]): (r["reference_id"], r["score"]) for r in knowledge.reference_evidence(asked, known).collect()}
    assert seen["asked"] == 5 and len(found) == 150
    content = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("scenario", "standard_no", "standard_name", "purpose")))
    pairs = asked.crossJoin(known.select("reference_id", content.alias("c")))
    score = F.round(semantics.lexical_similarity(F.col("text"), F.col("c"), semantics.terms(F.col("text")), semantics.terms(F.col("c"))), 6)
    every = {}
    for r in pairs.select("query_id", "reference_id", score.alias("score")).collect():
        every.setdefault(r["query_id"], []).append((-r["score"], r["reference_id"]))
    assert found == {(q, n + 1): (i, -s) for q, x in every.items() for n, (s, i) in enumerate(sorted(x)[:3])}


def test_attribute_search_once_a_text(spark, written):
    seen = written(retrieve)
    rows = semantics.shown_attributes(enrich(_materials(spark, 40))).withColumns({"name": semantics.standard_name(), "source_count": F.col("row_id") % 4})
    asked = spark.createDataFrame([(i, ["SKF bearing", "gate valve", "SKF 304"][i % 3], 3 if i % 2 else None) for i in range(30)], "query_id long, text string, qty_min int")
    found = retrieve.attribute_search(asked, rows, k=5, suggestions=4).collect()
    assert seen["asked"] == 6 and seen["members"] <= 12 * 5
    of = {}
    for r in found:
        of.setdefault(r["query_id"], []).append((r["rank"], r["row_id"], r["score"], r["suggestion"]))
    assert set(of) == set(range(30)) and all(sorted(of[i]) == sorted(of[i % 6]) for i in of)
    # Bearings with three sources or more: row_id is a multiple of 3 and 3 modulo 4.
    assert [x[1] for x in sorted(of[3])] == [3, 15, 27, 39, 51]
    assert [x[1] for x in sorted(of[0])] == [0, 3, 6, 9, 12]


def test_equal_masters_are_listed_by_their_first_rows(spark, written):
    seen = written(retrieve)
    rows = semantics.shown_attributes(enrich(_materials(spark, 40))).withColumn("name", semantics.standard_name())
    asked = spark.createDataFrame([(i, "SKF bearing") for i in range(9)], "query_id long, text string")
    found = sorted((r["query_id"], r["rank"], r["row_id"]) for r in retrieve.attribute_search(asked, rows, k=4).collect())
    assert seen["asked"] == 1 and seen["members"] <= 12
    assert found == [(q, n + 1, 3 * n) for q in range(9) for n in range(4)]


def test_published_entries_are_those_of_the_statement(spark):
    from mdmill import registry

    data = "/root/testdata/sf0.001"
    found = registry.published_entries(spark, data)
    plain = registry._statement("jn5_published_entries")(spark, data).select(found.columns)
    assert found.count() == plain.count() > 0
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()


def test_published_entries_are_dealt_to_tasks_by_the_rows_they_give(spark, written, monkeypatch):
    from mdmill import registry

    # Inputs this small were merged into one task, which then gave all rows.
    assert registry.published_entries(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    seen = written(knowledge)
    monkeypatch.setattr(knowledge, "ENTRIES", 4)
    tree = [("10", f"10{i % 3}", f"n{i % 5}", None if i % 7 == 0 else i % 11) for i in range(60)] + [("11", "111", "n", 1)] * 2 + [("12", "121", None, None)]
    tree = spark.createDataFrame(tree, "major string, full_code string, item_name string, alias long")
    versions = spark.createDataFrame([(i, i % 4, f"h{i}", str(10 + i % 4)) for i in range(40)] + [(99, None, None, None)], "version_id long, catalog long, source_hash string, major string")
    found, plain = knowledge.published(tree, versions), versions.join(tree, "major").drop("major")
    assert found.columns == plain.columns and found.count() == plain.count() == 10 * (60 + 2 + 1) and seen == {"tree": 63, "published": 41}
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
    assert knowledge.published(tree.limit(0), versions).isEmpty() and knowledge.published(tree, versions.limit(0)).isEmpty()


def test_equal_texts_are_standardized_once(spark, written):
    from mdmill import session
    from mdmill.functions import text

    seen = written(session)
    rows = _materials(spark, 30).select("row_id", "material_name")
    found = session.worked_out_once(rows, {"__t": F.col("material_name")}, {"standard": text.standardize(F.col("__t"))})
    assert seen["kinds"] == 3 and found.columns == ["row_id", "material_name", "standard"]
    assert found.count() == 90 and found.where(~F.col("standard").eqNullSafe(text.standardize(F.col("material_name")))).isEmpty()


def test_minted_masters_read_equal_texts_once(spark, written):
    seen = written(session)
    asked = [(i, ("DN50 gate valve SKF", "Acme bolt M8")[i % 2], ("PN16 304", None)[i % 2], "闸阀", "", "", "GROUP", None) for i in range(60)]
    rows = spark.createDataFrame(asked, "request_id long, name string, description string, category string, brand string, model string, plant_code string, mdm_code string")
    applied = rows.select("request_id", F.lit(1).alias("seq"), F.lit("APPROVED").alias("after"), F.lit("DONE").alias("outcome"))
    found = machines.minted_masters(rows, applied).collect()
    assert seen["kinds"] == 2
    assert {(r["request_id"] % 2, r["brand"], r["dn"], r["material"]) for r in found} == {(0, "SKF", "50", "304"), (1, "", "", "")} and len({r["mdm_code"] for r in found}) == 60
