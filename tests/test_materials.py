"""Rules, entity resolution, audit chains and the registry on small tables."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from mdmill import registry
from mdmill.functions import rules, text
from mdmill.operators import audit, components, quality, resolve, vectors
from mdmill.sources import materials

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "function, given, expected",
    [
        (text.model, "轴承6312深沟", "6312"),
        (text.model, "eja110a x", "EJA110A"),
        (text.dn, "gate 4寸", "100"),
        (text.dn, "DN 50 valve", "50"),
        (text.pressure, "PN16", "1.6MPa"),
        (text.pressure, "7 bar", "7MPa"),
        (text.material, "stainless 316l", "316L"),
        (text.material, "stainless 316", "316"),
        (text.brand, "xSKFx", "SKF"),
        (text.clean, "　 a \t", "a"),
        (text.plant_code, "上海厂", "SHANGHAI"),
        (text.standardize, "机械密封", "机械机械密封"),
    ],
)
def test_text(spark, function, given, expected):
    assert one(spark, function(F.lit(given))) == expected


def test_text_of_nulls(spark):
    null = F.lit(None).cast("string")
    assert [one(spark, f(null)) for f in (text.model, text.dn, text.brand, text.material, text.clean)] == [""] * 5
    assert one(spark, text.char_jaccard(null, F.lit(" "))) == 1.0


def test_normalize(spark):
    raw = spark.createDataFrame([("1", "a", "x"), (None, " ", "y")], "code string, name string, color string")
    rows = materials.normalize(raw, {"material_code": "code", "material_name": "name"}).collect()
    assert [(r["material_code"], r["system_source"], r["_extra"]) for r in rows] == [("1", "CSV导入", {"color": "x"})]
    with pytest.raises(ValueError):
        materials.normalize(raw, {"material_code": "code", "material_name": "code"})


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(60, 50), (50, 70), (80, 80)]
    found = components.connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r["id"]: r["component"] for r in found.collect()} == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 70: 50}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def _tokens(r, standard):
    out = [r["model"]] * 3 if r["model"] else []
    for k in ("brand", "dn", "pressure", "material"):
        if r[k]:
            out += [("DN" if k == "dn" else "") + r[k]] * 2
    out += re.findall("[一-龥]{2,5}", standard)[:6]
    bare = re.sub("[^一-龥a-z0-9]", "", standard)[:400]
    return (out + [bare[i : i + n] for n in (2, 3) for i in range(len(bare) - n + 1)]) or ["empty"]


def test_match_pairs_connect_as_brute_force(spark):
    rows = materials.enrich(materials.materials(spark, SF).where("row_id % 4 = 3 OR row_id % 4 = 0").where("row_id < 120"))
    rows = rows.withColumns(
        {
            "s": text.standardize(F.concat_ws(" ", "material_name", "description", F.lit(""))),
            "j": text.standardize(F.concat_ws(" ", "material_name", "description", "std_category")),
        }
    )
    got = {r["id"]: r["component"] for r in components.connected_components(resolve.match_pairs(rows)).collect()}
    data = [r.asDict() for r in rows.collect()]
    parent = {r["row_id"]: r["row_id"] for r in data}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    from collections import Counter
    from math import sqrt

    vec = {r["row_id"]: Counter(_tokens(r, r["s"])) for r in data}
    letters = {r["row_id"]: set(re.sub(r"\s+", "", r["j"].lower())) for r in data}
    for a, b in itertools.combinations(data, 2):
        if any(a[k] and b[k] and a[k] != b[k] for k in ("model", "pressure", "dn")):
            continue
        x, y = vec[a["row_id"]], vec[b["row_id"]]
        cos = sum(x[t] * y[t] for t in x) / sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        cos += 0.15 * bool(a["brand"] and a["brand"] == b["brand"]) + 0.10 * bool(a["material"] and a["material"] == b["material"])
        p, q = letters[a["row_id"]], letters[b["row_id"]]
        if cos >= rules.EDGE - 1e-12 or len(p & q) / len(p | q) >= rules.SEMANTIC_EDGE:
            m, n = sorted((top(a["row_id"]), top(b["row_id"])))
            parent[n] = m
    assert {i: got.get(i, i) for i in parent} == {i: top(i) for i in parent}


def test_audit_finds_tampering(spark):
    rows = [(c, i, i, f"{c}{i}") for c in (1, 2) for i in range(5)]
    blocks = audit.append_blocks(spark.createDataFrame(rows, "chain long, ts long, event_id long, payload_hash string"))
    bad = lambda df: audit.verify(df).where("bad_height OR bad_link OR bad_hash").count()
    assert bad(blocks) == 0
    assert bad(blocks.withColumn("payload_hash", F.when(F.col("event_id") == 3, "z").otherwise(F.col("payload_hash")))) == 2
    assert bad(blocks.where("event_id <> 2")) > 0


def test_hmac(spark):
    import hashlib
    import hmac

    assert one(spark, audit.hmac_sha256(b"key", F.lit("text"))) == hmac.new(b"key", b"text", hashlib.sha256).hexdigest()


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    found = vectors.nearest(rows.where("vec_id = 1"), rows, 1).first()
    assert (found["vec_id"], found["score"]) == (3, 0.707107)


def test_quality_of_empty_table(spark):
    rows = materials.materials(spark, SF).limit(0)
    assert quality.record_issues(rows).count() == 0
    assert quality.duplicate_codes(rows).count() == 0


def test_every_statement_has_rows_and_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    for name in registry.STATEMENTS:
        assert registry.QUERIES[name](spark, SF).limit(1).count() > 0, name
