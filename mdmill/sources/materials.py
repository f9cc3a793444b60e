"""Material records: readers, and the stand-in over the part table."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdmill.functions import rules, text
from mdmill.session import worked_out_once

FIELDS = ["material_code", "system_source", "material_name", "description", "category", "unit", "create_time", "plant_code"]

MATERIALS_SQL = """
SELECT p_partkey AS row_id,
 concat('M', p_partkey - CASE WHEN p_partkey % 10 = 9 THEN 3 ELSE 0 END) AS material_code,
 CASE WHEN p_partkey % 23 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN 'SAP'
      WHEN p_partkey % 3 = 1 THEN 'EAM' ELSE '采购' END AS system_source,
 CASE WHEN p_partkey % 4 = 0 THEN concat('SKF 63', 10 + p_size % 20,
           CASE WHEN p_partkey % 8 = 0 THEN '深沟球轴承' ELSE '滚动轴承' END)
      WHEN p_partkey % 4 = 1 THEN concat('DN', 50 * (1 + p_size % 5),
           CASE WHEN p_partkey % 8 = 1 THEN ' 闸阀' ELSE ' Gate Valve' END)
      WHEN p_partkey % 4 = 2 THEN concat(p_name, ' M16')
      ELSE p_name END AS material_name,
 CASE WHEN p_partkey % 17 = 0 THEN '' ELSE concat(p_type,
      CASE WHEN p_partkey % 4 = 1 THEN ' PN16 ' ELSE ' ' END,
      CASE WHEN p_size % 3 = 0 THEN '304' WHEN p_size % 3 = 1 THEN '316L' ELSE 'WCB' END) END AS description,
 CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 4 = 0 THEN '轴承'
      WHEN p_partkey % 4 = 1 THEN '阀门' ELSE p_type END AS category,
 CASE WHEN p_partkey % 19 = 0 THEN '' ELSE '件' END AS unit,
 '2026-01-01' AS create_time,
 CASE WHEN p_partkey % 3 = 0 THEN 'GROUP' WHEN p_partkey % 3 = 1 THEN 'SHANGHAI' ELSE 'BEIJING' END AS plant_code
FROM {part}
"""


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MATERIALS_SQL.replace("{part}", "{part_table}"), part_table=spark.read.parquet(f"{sf_dir}/part.parquet"))


def read_csv(spark: SparkSession, paths, encoding: str = "UTF-8") -> DataFrame:
    """All columns as strings, so that codes keep their leading zeros. Other charsets than Unicode need a setting of the session, made here."""
    if not encoding.upper().startswith("UTF"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.option("header", True).option("encoding", encoding).csv(paths)


def charset(spark: SparkSession, paths) -> str:
    """UTF-8, or GB18030 if some line is no UTF-8."""
    broken = spark.read.text(paths).where(~F.is_valid_utf8("value"))
    return "UTF-8" if broken.isEmpty() else "GB18030"


def csv_batch(spark: SparkSession, paths, plant: str = "GROUP", now: str | None = None) -> DataFrame:
    """Records of CSV files: charset found, headers aligned, rows normalised; now (an ISO time) is the default create_time."""
    raw = read_csv(spark, paths, charset(spark, paths))
    return normalize(raw, map_headers(raw.columns), plant, now or datetime.now(timezone.utc).isoformat(timespec="seconds"))


def json_batch(spark: SparkSession, paths, schema, mapping: dict[str, str] | None = None, plant: str = "GROUP", now: str | None = None) -> DataFrame:
    """Records of JSON lines, by the mapping given or else by their headers."""
    raw = read_json(spark, paths, schema)
    return normalize(raw, mapping or map_headers(raw.columns), plant, now or datetime.now(timezone.utc).isoformat(timespec="seconds"))


def read_json(spark: SparkSession, paths, schema) -> DataFrame:
    return spark.read.schema(schema).json(paths)


def normalize(raw: DataFrame, mapping: dict[str, str], plant: str = "GROUP", now: str = "") -> DataFrame:
    """Records from raw by {field: source column}; other non-blank columns go to the map `_extra`.

    A source column may serve one field only. Rows with blank code, name and
    description go; source and time have defaults.
    """
    if len(set(mapping.values())) < len(mapping) or not set(mapping.values()) <= set(raw.columns):
        raise ValueError("each source column must exist and serve one field")
    default = {"system_source": "CSV导入", "create_time": now}
    cell = lambda f: text.clean(F.col(f"`{mapping[f]}`")) if f in mapping else F.lit("")
    blank = lambda f: F.when(cell(f) != "", cell(f)).otherwise(default.get(f, ""))
    rest = [c for c in raw.columns if c not in mapping.values()]
    pairs = [x for c in rest for x in (F.lit(c), text.clean(F.col(f"`{c}`")))]
    extra = F.map_filter(F.create_map(*pairs), lambda k, v: v != "") if pairs else F.create_map().cast("map<string,string>")
    fields = [text.plant_code(cell(f), plant) if f == "plant_code" else blank(f) for f in FIELDS]
    out = raw.select(*(c.alias(f) for f, c in zip(FIELDS, fields)), extra.alias("_extra"))
    return out.where("material_code <> '' OR material_name <> '' OR description <> ''")


# Parts of a header whose column tells attributes, and header names that stand for a field.
HINTS = ["子类", "型号", "规格", "brand", "model", "material", "材质"]
ALIASES = {
    "material_code": ["物料编码", "物料代码", "物料号", "编码", "material_code", "code"],
    "system_source": ["来源系统", "系统来源", "source_system", "system_source", "source"],
    "material_name": ["物料名称", "备件名称", "名称", "material_name", "name"],
    "description": ["物料描述", "规格描述", "描述", "description", "desc"],
    "category": ["物料类别", "物料分类", "类别", "分类", "category", "type"],
    "unit": ["计量单位", "单位", "unit", "uom"],
    "create_time": ["创建时间", "创建日期", "create_time", "created_at"],
    "plant_code": ["工厂编码", "工厂代码", "工厂", "plant_code", "plant"],
}
# End of fixed values.


def header_key(header: str | None) -> str:
    """A header in lower case without white space, separators and brackets; text.header_key is the same for columns."""
    return re.sub(r"[\s_\-./\\()（）\[\]【】:：]+", "", (header or "").strip().lower())


def map_headers(headers: list[str]) -> dict[str, str]:
    """{field: header} for the headers of one table: each field in turn takes its best free header.

    A header equal to an alias beats one that starts or ends with it; longer
    aliases beat shorter ones, then the order of aliases and headers decides.
    Short aliases (one CJK or three Latin letters) only match whole headers.
    """
    key = header_key
    found: dict[str, str] = {}
    for field, names in ALIASES.items():
        best = (0, "")
        for alias in map(key, names):
            long_enough = len(alias) >= (2 if re.search("[一-龥]", alias) else 4)
            for header in headers:
                h = key(header)
                near = long_enough and (h.startswith(alias) or h.endswith(alias))
                score = 1000 + len(alias) if h == alias else 500 + len(alias) if near else 0
                if score > best[0] and header not in found.values():
                    best = (score, header)
        if best[0]:
            found[field] = best[1]
    return found


def _extra_value(extra, aliases):
    """The first non-blank value of a map of unmapped columns under a header that equals an alias; null if there is none."""
    named = lambda alias: F.filter(F.map_entries(extra), lambda e: (text.header_key(e["key"]) == header_key(alias)) & (text.clean(e["value"]) != ""))
    return F.coalesce(*(F.nullif(text.clean(F.get(named(a), F.lit(0))["value"]), F.lit("")) for a in aliases))


def provenance(records: DataFrame, base_urls: dict[str, str] | None = None) -> DataFrame:
    """records with a struct provenance(source_id, source_table, status, source_url, record_hash).

    Id and table come from unmapped columns (`_extra`) that name them, else
    from the code, or from row_id, and the source system. The URL is that of an
    unmapped column if it is http(s), else it is made under the base URL of the
    system's connector; without one it is a demo URL, and the status DEMO. The
    hash is over all fields and `_extra`.
    """
    extra = F.col("_extra") if "_extra" in records.columns else F.create_map().cast("map<string,string>")
    extra = F.coalesce(extra, F.create_map().cast("map<string,string>"))
    where = text.connector(F.col("system_source"))
    found = {k: _extra_value(extra, names) for k, names in rules.PROVENANCE_HEADERS.items()}
    numbered = F.format_string("ROW-%06d", F.col("row_id"))
    own = F.coalesce(found["id"], F.nullif(text.clean(F.col("material_code")), F.lit("")), numbered)
    source = F.coalesce(found["table"], where["source_table"])
    given = F.when(F.lower(found["url"]).rlike("^https?://"), found["url"])
    bases = F.create_map(*(F.lit(x) for k, v in (base_urls or {}).items() for x in (k, v.rstrip("/")))) if base_urls else F.create_map().cast("map<string,string>")
    quoted = lambda c: F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    rows = records.withColumns({"__id": own, "__table": source, "__given": given, "__connector": where["connector"]})
    base = F.try_element_at(bases, F.col("__connector"))
    made = F.concat(F.coalesce(base, F.concat(F.lit("demo://"), "__connector")), F.lit("/"), quoted(F.col("__table")), F.lit("/"), quoted(F.col("__id")))
    status = F.when(F.col("__given").isNotNull() | base.isNotNull(), "CONFIGURED").otherwise("DEMO")
    ordered = F.map_from_entries(F.array_sort(F.map_entries(extra)))
    fields = [(f, F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in FIELDS]
    body = F.to_json(F.struct(*(c.alias(f) for f, c in sorted([*fields, ("extra", ordered)], key=lambda pair: pair[0]))))
    shown = F.struct(
        F.col("__id").alias("source_id"), F.col("__table").alias("source_table"), status.alias("status"),
        F.coalesce("__given", made).alias("source_url"), F.sha2(body, 256).alias("record_hash"),
    )
    return rows.withColumn("provenance", shown).drop("__id", "__table", "__given", "__connector")


def extra_text(extra):
    """The values of unmapped columns whose header hints at a model, brand, size or material, joined by blanks."""
    hinted = F.map_filter(extra, lambda k, v: F.lower(k).rlike("|".join(HINTS)) & (v != ""))
    return F.coalesce(F.array_join(F.map_values(hinted), " "), F.lit(""))


def enrich(records: DataFrame) -> DataFrame:
    """records with model, brand, dn, pressure, material and std_category from name, description and hinted extra columns; equal texts are read once."""
    more = [extra_text(F.col("_extra"))] if "_extra" in records.columns else []
    source = F.concat_ws(" ", "material_name", "description", *more, F.lit(""))
    keys = {"__t": source, "__name": F.coalesce("material_name", F.lit("")), "__category": F.coalesce("category", F.lit(""))}
    t = F.col("__t")
    made = {"model": text.model(t), "brand": text.brand(t), "dn": text.dn(t), "pressure": text.pressure(t), "material": text.material(t)}
    return worked_out_once(records, keys, {**made, "std_category": text.category(F.col("__name"), F.col("__category"))})
