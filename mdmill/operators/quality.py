"""Data quality: issues, metrics, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdmill.functions import rules, text

FIELDS = [f for f, _, _ in rules.REQUIRED]


def record_issues(records: DataFrame) -> DataFrame:
    """(row_id, code, field, severity): blank required fields, and categories that are blank or unresolved."""
    found = [
        F.when(text.clean(F.col(f)) == "", F.struct(F.lit(f"MISSING_{f.upper()}").alias("code"), F.lit(f).alias("field"), F.lit(s).alias("severity")))
        for f, _, s in rules.REQUIRED
    ]
    open_category = text.clean(F.col("category")).isin("", rules.OTHER)
    found.append(F.when(open_category, F.struct(F.lit("CATEGORY_UNRESOLVED").alias("code"), F.lit("category").alias("field"), F.lit("MEDIUM").alias("severity"))))
    return records.select("row_id", F.explode(F.array_compact(F.array(*found))).alias("i")).select("row_id", "i.*")


def duplicate_codes(records: DataFrame) -> DataFrame:
    """Rows whose code another row of the same source and plant has; counted first, so a hot key is never one window."""
    key = ["system_source", "plant_code", "material_code"]
    rows = records.where("material_code <> ''")
    counted = rows.join(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), key)
    return counted.select("row_id", "system_source", "plant_code", "material_code", "n")


def due_date(severity, opened):
    days = F.coalesce(*(F.when(severity == s, F.lit(d)) for s, d in rules.DUE_DAYS.items()), F.lit(10))
    return F.date_add(opened, days)


def quality_report(records: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """Quality metrics in percent over all rows (system is null) and for each source system.

    anomalies (row_id) holds odd records; accuracy is what they leave of all
    rows. It counts overall only: a source system's accuracy is 100. Without
    records there is one row of zeros. An action is suggested where keys are
    incomplete (under 90 % overall) or records are odd.
    """
    rows = records.withColumn("system", F.when(F.col("system_source") == "", "未分类").otherwise(F.col("system_source")))
    filled = sum((F.col(f) != "").cast("int") for f in FIELDS)
    rate = lambda c: F.round(F.avg(c.cast("int")) * 100, 1)
    coded = F.when(F.col("material_code") != "", F.col("material_code"))
    rows = rows.withColumn("odd", F.lit(0)) if anomalies is None else rows.join(
        anomalies.select("row_id", F.lit(1).alias("odd")).distinct(), "row_id", "left"
    )
    report = rows.groupingSets([[], ["system"]], "system").agg(
        F.count("*").alias("record_count"),
        F.round(F.avg(filled) / len(FIELDS) * 100, 1).alias("completeness"),
        rate((F.col("material_name") != "") & (F.col("category") != "")).alias("consistency"),
        F.round(F.count_distinct(coded) / F.greatest(F.lit(1), F.count(coded)) * 100, 1).alias("uniqueness"),
        rate(text.category(F.col("material_name"), F.col("category")) != rules.OTHER).alias("standardization"),
        F.grouping("system").alias("whole"),
        F.count_if(F.col("odd") == 1).alias("odd"),
    )
    accuracy = F.when(F.col("whole") == 1, F.round(F.greatest(F.lit(0.0), 100 - F.col("odd") / F.col("record_count") * 100), 1)).otherwise(100.0)
    whole = F.col("whole") == 1
    actions = F.array_compact(
        F.array(F.when(whole & (F.col("completeness") < 90), "COMPLETE_KEY_FIELDS"), F.when(whole & (F.col("odd") > 0), "REVIEW_ANOMALIES"))
    )
    report = report.withColumns({"accuracy": F.coalesce(accuracy, F.lit(0.0)), "suggestions": F.array_join(actions, ",")}).drop("whole", "odd")
    report = report.fillna(0.0, ["completeness", "consistency", "uniqueness", "standardization"])
    return report.withColumn(
        "score", F.round((F.col("completeness") + F.col("accuracy") + F.col("consistency") + F.col("uniqueness") + F.col("standardization")) / 5, 1)
    )
