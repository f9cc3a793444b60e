"""Stored tables: upserts, removals, retention, batches as units, added columns; every change may be repeated."""

import os

import pytest
from pyspark.sql import functions as F

from mdmill.sources import stored


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, plant string, name string, updated int")


def test_merge_rewrites_touched_buckets_only_and_may_be_repeated(spark, tmp_path):
    path = str(tmp_path / "masters")
    stored.create(table(spark, [(i, "P", f"n{i}", 5) for i in range(200)] + [(None, "P", "none", 5)]), path, ["id", "plant"], 16)
    before = files(path)
    changes = table(spark, [(3, "P", "new", 6), (3, "P", "newer", 7), (4, "P", "stale", 1), (500, "Q", "added", 1), (None, "P", "found", 9), (5, "P", "tie", 5)])
    written = stored.merge(spark, path, changes, "updated")
    assert 0 < len(written) <= 5
    untouched = [f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in written]
    after = files(path)
    assert untouched and set(untouched) <= set(after)
    got = {(r["id"], r["plant"]): r["name"] for r in stored.read(spark, path).collect()}
    assert len(got) == 202 and (got[3, "P"], got[4, "P"], got[500, "Q"], got[None, "P"], got[5, "P"], got[6, "P"]) == ("newer", "n4", "added", "found", "tie", "n6")
    assert stored.merge(spark, path, changes, "updated") == [] and files(path) == after
    assert stored.merge(spark, path, changes.limit(0), "updated") == []
    assert stored.merge(spark, path, table(spark, [(3, "P", None, 8)]).drop("name"), "updated") and stored.read(spark, path).where("id = 3").first()["name"] is None
    with pytest.raises(ValueError, match="no columns"):
        stored.merge(spark, path, changes.withColumn("x", F.lit(1)), "updated")


def test_remove_empties_buckets_and_may_be_repeated(spark, tmp_path):
    path = str(tmp_path / "t")
    stored.create(table(spark, [(i, "P", "n", 1) for i in range(6)]), path, ["id"], 64)
    gone = spark.createDataFrame([(1,), (2,), (99,)], "id long")
    assert len(stored.remove(spark, path, gone)) >= 1
    after = files(path)
    assert sorted(r["id"] for r in stored.read(spark, path).collect()) == [0, 3, 4, 5]
    assert stored.remove(spark, path, gone) == [] and files(path) == after
    stored.remove(spark, path, stored.read(spark, path))
    assert stored.read(spark, path).count() == 0
    stored.merge(spark, path, table(spark, [(8, "P", "back", 1)]), "updated")
    assert [r["id"] for r in stored.read(spark, path).collect()] == [8]


def test_retention_cascades(spark, tmp_path):
    batches, children = str(tmp_path / "batches"), {n: str(tmp_path / n) for n in ("records", "mappings")}

    def fresh():
        rows = [(1, 10, False), (2, 10, True), (3, 99, False), (4, None, False), (5, 10, None)]
        stored.create(spark.createDataFrame(rows, "batch_id long, retention_until int, held boolean"), batches, ["batch_id"], 8)
        for name, path in children.items():
            stored.create(spark.createDataFrame([(b, x) for b in (1, 2, 3, 4, 7) for x in range(3)], "batch_id long, x long"), path, ["batch_id"], 8)

    fresh()
    everything = {n: files(p) for n, p in children.items()}
    report = stored.retain(spark, batches, children, 10)
    want = {("batches", 1, "DELETE", 1), ("batches", 2, "HELD", 1), ("batches", 5, "DELETE", 1)} | {(n, b, a, 3) for n in children for b, a in ((1, "DELETE"), (2, "HELD"))}
    assert {tuple(r) for r in report.collect()} == want
    assert {n: files(p) for n, p in children.items()} == everything and stored.read(spark, batches).count() == 5
    with pytest.raises(ValueError, match="confirmation"):
        stored.retain(spark, batches, children, 10, dry_run=False)
    assert {tuple(r) for r in stored.retain(spark, batches, children, 10, False, stored.CONFIRM).collect()} == want
    for path in children.values():
        assert sorted({r["batch_id"] for r in stored.read(spark, path).collect()}) == [2, 3, 4, 7]
    assert sorted(r["batch_id"] for r in stored.read(spark, batches).collect()) == [2, 3, 4]
    again = stored.retain(spark, batches, children, 10, False, stored.CONFIRM)
    assert {r["action"] for r in again.collect()} == {"HELD"}


def test_retention_that_broke_off_is_completed_by_the_next_run(spark, tmp_path, monkeypatch):
    batches, children = str(tmp_path / "batches"), {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")}
    stored.create(spark.createDataFrame([(1, 1, False)], "batch_id long, retention_until int, held boolean"), batches, ["batch_id"], 4)
    for path in children.values():
        stored.create(spark.createDataFrame([(1,), (2,)], "batch_id long"), path, ["batch_id"], 4)
    real = stored.remove

    def broken(spark, path, gone):
        if path == children["b"]:
            raise OSError("lost")
        return real(spark, path, gone)

    monkeypatch.setattr(stored, "remove", broken)
    with pytest.raises(OSError):
        stored.retain(spark, batches, children, 5, False, stored.CONFIRM)
    monkeypatch.setattr(stored, "remove", real)
    assert stored.read(spark, batches).count() == 1
    stored.retain(spark, batches, children, 5, False, stored.CONFIRM)
    assert stored.read(spark, batches).count() == 0 and [stored.read(spark, p).count() for p in children.values()] == [1, 1]


def test_a_batch_of_five_tables_is_seen_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "store")
    five = lambda tag, n: {t: spark.range(n).select("id", F.lit(f"{t}{tag}").alias("v")) for t in ("records", "batch_masters", "mappings", "reviews", "report")}
    assert stored.publish(spark, root, "B1", five("x", 4)) == dict.fromkeys(five("x", 4), 4)
    boom = F.udf(lambda v: 1 // 0, "int")
    broken = five("y", 9) | {"mappings": spark.range(9).select("id", boom("id").cast("string").alias("v"))}
    for batch in ("B1", "B2"):
        with pytest.raises(Exception, match="ZeroDivision"):
            stored.publish(spark, root, batch, broken)
        for name in five("", 1):
            assert {(r["unit"], r["v"]) for r in stored.published(spark, root, name).collect()} == {("B1", f"{name}x")}
    with pytest.raises(ValueError, match="were written"):
        stored.publish(spark, root, "B2", five("z", 3), {"reviews": 5})
    stored.publish(spark, root, "B2", five("z", 3), {"reviews": 3})
    stored.publish(spark, root, "B1", five("w", 2))
    assert sorted((r["unit"], r["v"], r["n"]) for r in stored.published(spark, root, "reviews").groupBy("unit", "v").agg(F.count("*").alias("n")).collect()) == [("B1", "reviewsw", 2), ("B2", "reviewsz", 3)]
    assert stored.vacuum(spark, root) > 5 and stored.vacuum(spark, root) == 0
    assert stored.published(spark, root, "records").count() == 5
    with pytest.raises(ValueError, match="no published"):
        stored.published(spark, root, "other")


def test_added_columns_and_struct_fields(spark):
    old = spark.createDataFrame([(1, ("a",)), (2, None)], "id long, source struct<system:string>")
    new = spark.createDataFrame([(3, ("b", "u"), "RESTRICTED")], "id long, source struct<system:string,url:string>, classification string")
    out = stored.union_evolved([old, new], {"classification": "INTERNAL", "source.url": ""})
    assert {r["id"]: (r["source"] and tuple(r["source"]), r["classification"]) for r in out.collect()} == {1: (("a", ""), "INTERNAL"), 2: (None, "INTERNAL"), 3: (("b", "u"), "RESTRICTED")}
    widened = stored.evolve(old, new.schema, {"classification": "PUBLIC"})
    assert widened.columns == new.columns and [r["classification"] for r in widened.collect()] == ["PUBLIC"] * 2
    extra = stored.evolve(old.withColumn("own", F.lit(7)), new.schema)
    assert extra.columns == [*new.columns, "own"] and extra.where("source IS NULL").count() == 1
