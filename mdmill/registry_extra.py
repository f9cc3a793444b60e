"""Registered queries of readers, ledgers, indexes, evidence and components, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mdmill.functions import rules, text
from mdmill.operators import audit, knowledge, lineage, resolve
from mdmill.operators.components import connected_components
from mdmill.plans import governance, relations
from mdmill.session import save, scratch_root, table
from mdmill.sources import materials as source
from mdmill.sources.materials import MATERIALS_SQL, enrich, materials

M = f"WITH m AS ({MATERIALS_SQL.replace('{part}', 'part')})"
NOW = "2026-01-01T00:00:00+00:00"
#: Headers of a file of materials, one of them no field.
HEADERS = {
    "material_code": "物料编码", "system_source": "来源系统", "material_name": "物料名称", "description": "物料描述", "category": "物料类别", "unit": "计量单位",
    "plant_code": "工厂编码",
}
#: Chains of events whose payload is what the ledger hashes.
CHAIN_SQL = """WITH RECURSIVE e AS (SELECT user_id AS chain, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS height,
 sha256(concat_ws('|', event_id, event_type, printf('%.4f', value::DOUBLE))) AS payload_hash FROM events),
 b AS (SELECT chain, event_id, height, repeat('0', 64) AS previous_hash, sha256(concat(height, '|', repeat('0', 64), '|', payload_hash)) AS block_hash FROM e WHERE height = 1
 UNION ALL SELECT e.chain, e.event_id, e.height, b.block_hash, sha256(concat(e.height, '|', b.block_hash, '|', e.payload_hash)) FROM b JOIN e ON e.chain = b.chain AND e.height = b.height + 1)"""


def _scratch(spark) -> str:
    return f"{scratch_root(spark)}/file-{uuid.uuid4().hex}"


def csv_records(spark, sf_dir) -> DataFrame:
    """Materials written as a GB18030 file with Chinese headers, and read back as a batch."""
    path = _scratch(spark)
    rows = materials(spark, sf_dir).select(*(F.col(f).alias(h) for f, h in HEADERS.items()), F.concat(F.lit("r"), "row_id").alias("备注"))
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    rows.write.option("header", True).option("encoding", "GB18030").csv(path)
    found = source.csv_batch(spark, path, now=NOW)
    return found.select(*source.FIELDS, F.col("_extra")["备注"].alias("note"))


def json_records(spark, sf_dir) -> DataFrame:
    """Materials written as JSON lines under other names, some without a plant, and read back by an explicit mapping."""
    path = _scratch(spark)
    names = {f: f"f{i}" for i, f in enumerate(HEADERS)}
    plant = F.when(F.col("row_id") % 5 > 0, F.col("plant_code"))
    rows = materials(spark, sf_dir).withColumn("plant_code", plant).select(*(F.col(f).alias(n) for f, n in names.items()))
    rows.write.json(path)
    return source.json_batch(spark, path, rows.schema, names, plant="BEIJING", now=NOW).drop("_extra")


def header_map(spark, sf_dir) -> DataFrame:
    """The header that each field takes, for the headers of the file of csv_records and near misses."""
    path = _scratch(spark)
    heads = ["row", "物料编码(新)", "MATERIAL NAME", "description", "unit", "UOM"]
    materials(spark, sf_dir).select(*(F.col(c).alias(h) for c, h in zip(("row_id", "material_code", "material_name", "description", "unit", "unit"), heads))).write.parquet(path)
    found = source.map_headers(spark.read.parquet(path).columns)
    return spark.createDataFrame(sorted(found.items()), "field string, header string")


def _padded(column: str):
    """Text with spaces, a full-width one and a tab around and inside it."""
    return F.when(F.col("row_id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("　 \t"), F.regexp_replace(column, " ", " \t "), F.lit(" 　")))


def cleaned(spark, sf_dir):
    return materials(spark, sf_dir).select("row_id", text.clean(_padded("material_name")).alias("cleaned"))


def collapsed(spark, sf_dir):
    """Names with white space collapsed, and whole numbers that came as decimals as whole ones."""
    odd = F.when(F.col("row_id") % 5 == 0, F.concat("row_id", F.lit(".0"))).otherwise(_padded("material_name"))
    return materials(spark, sf_dir).select("row_id", text.collapse(odd).alias("collapsed"))


def header_keys(spark, sf_dir):
    return materials(spark, sf_dir).select("row_id", text.header_key(F.concat("material_name", F.lit(" (A_B)-【c】:"), "unit")).alias("key"))


def enriched(spark, sf_dir):
    rows = enrich(materials(spark, sf_dir))
    return rows.select("row_id", "model", "brand", "dn", "pressure", "material", "std_category")


def _with_extra(spark, sf_dir):
    said = F.when(F.col("row_id") % 3 == 0, "FAG 6205").when(F.col("row_id") % 3 == 1, "").otherwise("DN80 316L")
    return materials(spark, sf_dir).withColumn("_extra", F.create_map(F.lit("规格型号"), said, F.lit("备注"), F.lit("SKF 6399")))


def extra_attributes(spark, sf_dir):
    return enrich(_with_extra(spark, sf_dir)).select("row_id", "model", "brand", "dn", "material")


def utc_times(spark, sf_dir):
    """Event times as texts with Z, naive, or broken, read as UTC seconds."""
    rows = table(spark, sf_dir, "events")
    said = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")
    shown = F.when(F.col("event_id") % 3 == 0, F.concat(said, F.lit("Z"))).when(F.col("event_id") % 3 == 1, said).otherwise("no time")
    return rows.select("event_id", F.unix_timestamp(text.utc(shown)).alias("seconds"))


def batch_row_numbers(spark, sf_dir):
    return lineage.row_numbers(materials(spark, sf_dir).select("row_id", "plant_code"), "plant_code", ["row_id"]).select("row_id", "row_no")


def _ledger(spark, sf_dir):
    return audit.ledger(table(spark, sf_dir, "events"))


def appended_twice(spark, sf_dir):
    """A ledger that got its events in two goes, the second behind the heads of the first."""
    place = F.row_number().over(Window.partitionBy("chain").orderBy("ts", "event_id"))
    rows = _ledger(spark, sf_dir).withColumn("late", place > 20)
    first = audit.append_blocks(rows.where("NOT late").drop("late"))
    second = audit.append_blocks(rows.where("late").drop("late"), audit.heads(first))
    return first.unionByName(second).select("chain", "event_id", "height", "previous_hash", "block_hash")


def signed_ledger(spark, sf_dir):
    """A signed ledger in which some signatures were forged: blocks and errors of each chain."""
    blocks = audit.sign(audit.append_blocks(_ledger(spark, sf_dir)), b"ledger-key")
    forged = blocks.withColumn("signature", F.when(F.col("event_id") % 89 == 0, F.lit("0" * 64)).otherwise(F.col("signature")))
    checked = audit.verify_signed(forged, b"ledger-key")
    bad = F.count_if(F.col("bad_height") | F.col("bad_link") | F.col("bad_hash") | F.col("bad_signature"))
    return checked.groupBy("chain").agg(F.count("*").alias("blocks"), bad.alias("errors"))


def catalog_ledger(spark, sf_dir):
    """The events of knowledge catalogs (orders by customer), one block of some chains lost: blocks and errors of each chain."""
    rows = relations.standin(spark, sf_dir, "versions").select(
        F.col("catalog").alias("chain"), F.col("created").cast("timestamp").alias("ts"), F.col("version_id").alias("event_id"),
        F.sha2(F.concat_ws("|", "version_id", "status", "source_hash"), 256).alias("payload_hash"),
    )
    kept = audit.append_blocks(rows).where("NOT (chain % 10 = 0 AND height = 1)")
    checked = audit.verify(kept)
    return checked.groupBy("chain").agg(F.count("*").alias("blocks"), F.count_if("bad_link").alias("broken_links"), F.count_if("bad_height").alias("bad_heights"))


def chains(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + 7).alias("dst")).distinct()
    return connected_components(edges)


def fused_records(spark, sf_dir):
    """Golden records of materials that share a code, odd rows counted."""
    rows = enrich(materials(spark, sf_dir))
    first = rows.groupBy("material_code").agg(F.min("row_id").alias("master_id"))
    found = resolve.fuse(rows.join(first, "material_code"), rows.where("row_id % 97 = 0").select("row_id"))
    return found.drop("confidence")


def _pairs(spark, sf_dir):
    m = materials(spark, sf_dir)
    a, b = m.select(F.col("row_id").alias("id"), F.col("material_name").alias("a")), m.select((F.col("row_id") - 4).alias("id"), F.col("material_name").alias("b"))
    return a.join(b, "id")


def likeness_of_pairs(spark, sf_dir):
    return knowledge.text_pairs(_pairs(spark, sf_dir))


def vector_index(spark, sf_dir):
    """The index of golden records and what was said of them, built anew over an index of which some texts have changed."""
    contents = relations.run_standins(spark, sf_dir, governance.STATEMENTS["txt35_index_text"]).withColumnRenamed("mdm_code", "key")
    said = relations.standin(spark, sf_dir, "deliveries").where("batch_id % 10 = 0").groupBy(F.col("mdm_code").alias("key"))
    comments = said.agg(F.array_join(F.sort_array(F.collect_set("comment")), " ").alias("comments"))
    old, _ = save(knowledge.build_index(contents), "index")
    found = knowledge.build_index(contents, comments, current=old)
    return found.select(F.col("key").alias("mdm_code"), "namespace", "content", "content_hash", F.size("idx").alias("dims"))


def evidence(spark, sf_dir):
    asked = materials(spark, sf_dir).where("row_id % 50 = 0").select(F.col("row_id").alias("query_id"), F.concat_ws(" ", "material_name", "description").alias("text"))
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("reference_id"), F.concat(F.lit("DN"), F.col("s_nationkey") * 10).alias("scenario"), F.concat(F.lit("GB/T "), "s_suppkey").alias("standard_no"),
        F.concat(F.lit("gate valve "), "s_name").alias("standard_name"), F.lit("304").alias("purpose"),
    )
    return knowledge.reference_evidence(asked, rows)


def candidates(spark, sf_dir):
    return knowledge.category_candidates(enrich(materials(spark, sf_dir)))


QUERIES = {
    "src1_csv_batch": csv_records,
    "src2_json_batch": json_records,
    "prj1_header_map": header_map,
    "prj2_normalized": csv_records,
    "prj3_cleaned": cleaned,
    "prj4_collapsed": collapsed,
    "prj5_header_keys": header_keys,
    "prj10_extra_attributes": extra_attributes,
    "txt8_enriched": enriched,
    "txt28_utc_times": utc_times,
    "wn1_row_numbers": batch_row_numbers,
    "st10_append_to_ledger": appended_twice,
    "wn3_signed_ledger": signed_ledger,
    "wn4_catalog_ledger": catalog_ledger,
    "er1_components": chains,
    "ag1_golden_records": fused_records,
    "er8_text_pairs": likeness_of_pairs,
    "er5_vector_index": vector_index,
    "tk5_reference_evidence": evidence,
    "er11_category_candidates": candidates,
}


def oracle_sql(attribute_sql, standard: str) -> dict[str, str]:
    """The SQL of QUERIES; attribute_sql gives the SQL of attributes of a text, standard the standardised texts of m."""
    own = attribute_sql()
    with_extra = attribute_sql("concat(material_name, ' ', description, ' ', extra, ' ')")
    bare = lambda c: f"regexp_replace(lower({c}), '[\\s\\x{{3000}}]+', '', 'g')"
    cut = lambda c: f"list_concat(list_transform(range(1, len({c}) + 1), lambda i: substring({c}, i, 1)), list_transform(range(1, len({c})), lambda i: substring({c}, i, 2)), regexp_extract_all({c}, '[a-z0-9]+'))"
    source_of = "CASE WHEN system_source = '' THEN 'CSV导入' ELSE system_source END AS system_source"
    fields = f"material_code, {source_of}, material_name, description, category, unit, '{NOW}' AS create_time"
    letters = lambda c: f"list_distinct(string_split(regexp_replace(lower({c}), '\\s+', '', 'g'), ''))"
    vectors = lambda rows: f"""v AS (SELECT id, (('0x' || substring(h, 1, 8))::BIGINT % 384)::INT AS idx, sum(CASE WHEN ('0x' || substring(h, 9, 2))::INT % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v
 FROM (SELECT id, sha256(unnest({cut('b')})) AS h FROM ({rows})) GROUP BY ALL HAVING v <> 0)"""  # noqa: E731
    unit = "SELECT id, idx, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS w FROM v"
    e = f"{M}, e AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in own.items())} FROM m)"
    inch = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.SHOWN_INCHES.items())
    metric = f"CASE nullif(regexp_extract(material_name || ' ' || description, '(\\d+)\\s*寸', 1), '') {inch} END"
    prefix = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.CODE_PREFIXES.items())
    plain = "(contains(std_category, '轴承') OR std_category = '润滑油')"
    names = ", ".join(
        f"({i}, '{c}', '{text_of}')" for i, (c, text_of) in enumerate((c, " ".join([c, *rules.SYNONYMS.get(c, [])]).strip()) for c, _ in rules.CATEGORY_PATTERNS)
    )
    fold = standard.replace(f"{M} SELECT row_id, ", "").rsplit(" AS standard FROM m", 1)[0]
    on = lambda c: fold.replace("lower(trim(material_name || ' ' || description))", f"lower(trim({c}))")
    words = on("words")
    some = lambda c, v: f"CASE WHEN {c} <> '' THEN {v} ELSE [] END"
    pad = lambda x: "".join(f"\\x{b ^ x:02X}" for b in b"ledger-key".ljust(64, b"\0"))
    body = ", ".join(f"'{f}': {f}" for f in sorted([*source.FIELDS, "extra"]))
    return {
        "txt14_hash_embedding": f"""{M}, x AS (SELECT row_id, {fold} AS t FROM m), y AS (SELECT min(row_id) AS id, t FROM x GROUP BY t), {vectors(f"SELECT id, {bare('t')} AS b FROM y")}, w AS ({unit}) SELECT id, idx, round(w, 6) AS w FROM w""",
        "str1_streamed_blocks": CHAIN_SQL + " SELECT b.chain, b.event_id, b.height, previous_hash, block_hash, payload_hash FROM b JOIN e ON e.chain = b.chain AND e.height = b.height",
        "wn3_hmac": f"""WITH e AS (SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS height, sha256(concat_ws('|', event_id, event_type, printf('%.4f', value::DOUBLE))) AS p FROM events)
 SELECT chain, height, sha256('{pad(0x5C)}'::BLOB || unhex(sha256('{pad(0x36)}'::BLOB || p::BLOB))) AS signature FROM e""",
        "prj8_provenance": f"""{M}, x AS (SELECT *, CASE WHEN row_id % 4 = 1 THEN concat('X ', row_id) WHEN material_code <> '' THEN material_code ELSE printf('ROW-%06d', row_id) END AS source_id,
  CASE WHEN row_id % 4 = 3 THEN 'T 1' ELSE CASE system_source WHEN 'SAP' THEN 'MARA' WHEN 'EAM' THEN 'EAM_MATERIAL' WHEN '采购' THEN 'PURCHASE_ITEM' ELSE 'CSV_ROW' END END AS source_table,
  CASE system_source WHEN 'SAP' THEN 'demo://sap-odata' WHEN 'EAM' THEN 'https://eam.example/api' WHEN '采购' THEN 'demo://procurement-rest' ELSE 'demo://file-import' END AS base,
  CASE row_id % 4 WHEN 1 THEN json_object('Record ID', concat('X ', row_id), 'note', 'n') WHEN 2 THEN json_object('来源链接', concat('https://e/', row_id)) WHEN 3 THEN json_object('deep_link', 'ftp://x', '源表', 'T 1') ELSE json_object() END AS extra FROM m)
 SELECT row_id, source_id, source_table, CASE WHEN row_id % 4 = 2 OR system_source = 'EAM' THEN 'CONFIGURED' ELSE 'DEMO' END AS status,
 CASE WHEN row_id % 4 = 2 THEN concat('https://e/', row_id) ELSE concat(base, '/', replace(source_table, ' ', '%20'), '/', replace(source_id, ' ', '%20')) END AS source_url, sha256(to_json({{{body}}})::VARCHAR) AS record_hash FROM x""",
        "src1_csv_batch": f"{M} SELECT {fields}, plant_code, concat('r', row_id) AS note FROM m",
        "prj2_normalized": f"{M} SELECT {fields}, plant_code, concat('r', row_id) AS note FROM m",
        "src2_json_batch": f"{M} SELECT {fields}, CASE WHEN row_id % 5 = 0 THEN 'BEIJING' ELSE plant_code END AS plant_code FROM m",
        "prj1_header_map": "SELECT * FROM (VALUES ('material_code', '物料编码(新)'), ('material_name', 'MATERIAL NAME'), ('description', 'description'), ('unit', 'unit')) t(field, header)",
        "prj3_cleaned": f"{M} SELECT row_id, CASE WHEN row_id % 7 = 0 THEN '' ELSE regexp_replace(material_name, ' ', ' ' || chr(9) || ' ', 'g') END AS cleaned FROM m",
        "prj4_collapsed": f"{M} SELECT row_id, CASE WHEN row_id % 5 = 0 THEN row_id::VARCHAR WHEN row_id % 7 = 0 THEN '' ELSE material_name END AS collapsed FROM m",
        "prj5_header_keys": f"{M} SELECT row_id, regexp_replace(lower(concat(material_name, 'abc', unit)), '[\\s_\\-./]+', '', 'g') AS key FROM m",
        "txt8_enriched": f"{e} SELECT row_id, model, brand, dn, pressure, material, std_category FROM e",
        "prj10_extra_attributes": f"""{M}, x AS (SELECT *, CASE row_id % 3 WHEN 0 THEN 'FAG 6205' WHEN 1 THEN '' ELSE 'DN80 316L' END AS extra FROM m)
 SELECT row_id, {', '.join(f'{with_extra[k]} AS {k}' for k in ('model', 'brand', 'dn', 'material'))} FROM x""",
        "txt28_utc_times": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN epoch(date_trunc('second', ts))::BIGINT END AS seconds FROM events",
        "wn1_row_numbers": f"{M} SELECT row_id, row_number() OVER (PARTITION BY plant_code ORDER BY row_id) AS row_no FROM m",
        "st10_append_to_ledger": CHAIN_SQL + " SELECT chain, event_id, height, previous_hash, block_hash FROM b",
        "wn3_signed_ledger": "SELECT user_id AS chain, count(*) AS blocks, count(CASE WHEN event_id % 89 = 0 THEN 1 END) AS errors FROM events GROUP BY user_id",
        "wn4_catalog_ledger": """WITH n AS (SELECT o_custkey AS chain, count(*) - CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS blocks FROM orders GROUP BY o_custkey)
 SELECT chain, blocks, CASE WHEN chain % 10 = 0 THEN 1 ELSE 0 END AS broken_links, CASE WHEN chain % 10 = 0 THEN blocks ELSE 0 END AS bad_heights FROM n WHERE blocks > 0""",
        "er1_components": """WITH RECURSIVE s AS (SELECT DISTINCT o_custkey AS a, o_custkey + 7 AS b FROM orders WHERE o_orderkey % 3 = 0), e AS (SELECT a, b FROM s UNION ALL SELECT b, a FROM s),
 r AS (SELECT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a) SELECT id, min(seen) AS component FROM r GROUP BY id""",
        "ag1_golden_records": f"""{e}, s AS (SELECT row_id, material_code, material_name, system_source, plant_code, std_category, model, brand, dn, pressure, material,
  CASE WHEN std_category IN ('闸阀', '法兰') AND {metric} IS NOT NULL THEN {metric} WHEN {plain} THEN '' ELSE dn END AS sdn, CASE WHEN {plain} THEN '' ELSE pressure END AS sp,
  CASE WHEN contains(std_category, '轴承') AND model <> '' AND material <> '' AND contains(lower(model), lower(material)) THEN '' ELSE material END AS sm FROM e),
 n AS (SELECT *, [x FOR x IN [brand, model, std_category, CASE WHEN sdn <> '' THEN 'DN' || sdn ELSE '' END, sp, sm] IF x <> ''] AS l FROM s),
 u AS (SELECT *, array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF list_position(l, l[i]) = i], ' ') AS name FROM n),
 g AS (SELECT min(row_id) AS master_id, arg_min(std_category, row_id) AS category, arg_min(model, row_id) AS model, arg_min(brand, row_id) AS brand, arg_min(dn, row_id) AS dn, arg_min(pressure, row_id) AS pressure,
  arg_min(material, row_id) AS material, arg_max(name, length(material_name) * 100000000 - row_id) AS standard_name, count(*) AS source_count, count(DISTINCT nullif(material_code, '')) AS code_count,
  coalesce(string_agg(DISTINCT nullif(system_source, ''), ',' ORDER BY nullif(system_source, '')), '') AS source_systems, string_agg(DISTINCT plant_code, ',' ORDER BY plant_code) AS plant_codes, count(CASE WHEN row_id % 97 = 0 THEN 1 END) AS anomaly_count,
  greatest(count(DISTINCT nullif(u.model, '')), count(DISTINCT nullif(u.dn, '')), count(DISTINCT nullif(u.pressure, '')), count(DISTINCT nullif(u.material, ''))) > 1 AS conflict FROM u GROUP BY material_code)
 SELECT * EXCLUDE (conflict), concat(CASE category {prefix} ELSE 'MDM-X' END, '-', upper(substring(sha1(category || '|' || standard_name), 1, 8))) AS mdm_code,
  CASE WHEN source_count = 1 THEN 'NEW' WHEN conflict THEN 'REVIEW' ELSE 'AUTO_MERGE' END AS decision FROM g""",
        "er8_text_pairs": f"""{M}, t AS (SELECT a.row_id AS id, a.material_name AS a, b.material_name AS b FROM m a JOIN m b ON b.row_id = a.row_id + 4), {vectors(f"SELECT row_id AS id, {bare('material_name')} AS b FROM m")},
 w AS ({unit}), d AS (SELECT x.id, sum(x.w * y.w) AS dense FROM w x JOIN w y ON y.id = x.id + 4 AND x.idx = y.idx GROUP BY x.id)
 SELECT t.id, round(greatest(-1, least(1, coalesce(dense, 0))), 6)::DOUBLE AS dense, round(len(list_intersect({letters('a')}, {letters('b')})) / len(list_distinct(list_concat({letters('a')}, {letters('b')})))::DOUBLE, 6) AS chars FROM t LEFT JOIN d ON d.id = t.id""",
        "er5_vector_index": relations.oracle("""WITH c AS (SELECT mdm_code AS id, string_agg(DISTINCT comment, ' ' ORDER BY comment) AS comments FROM {deliveries} WHERE batch_id % 10 = 0 GROUP BY mdm_code),
 g AS (""" + governance.STATEMENTS["txt35_index_text"] + """), t AS (SELECT mdm_code, concat_ws(' ', content, '工厂反馈 ' || comments) AS content FROM g LEFT JOIN c ON c.id = mdm_code), """
        + vectors(f"SELECT mdm_code AS id, {bare('content')} AS b FROM t").replace("{", "{{").replace("}", "}}").replace("{{{{", "{{").replace("}}}}", "}}")
        + """, n AS (SELECT id, count(*) AS dims FROM v GROUP BY id) SELECT mdm_code, 'masters' AS namespace, content, sha256(content) AS content_hash, coalesce(dims, 0) AS dims FROM t LEFT JOIN n ON n.id = mdm_code""").replace("{{", "{").replace("}}", "}"),
        "jn1_match_pairs": f"""{e}, i AS (SELECT material_name, description, std_category, min(row_id) AS id, any_value(model) AS model, any_value(brand) AS brand, any_value(dn) AS dn, any_value(pressure) AS pressure, any_value(material) AS material FROM e GROUP BY ALL),
 f AS (SELECT *, {on("concat(material_name, ' ', description)")} AS std, {letters(on("concat(material_name, ' ', description, ' ', std_category)"))} AS chars FROM i), b AS (SELECT *, substring(regexp_replace(std, '[^一-龥a-z0-9]', '', 'g'), 1, 400) AS b FROM f),
 l AS (SELECT id, list_concat({some('model', '[model, model, model]')}, {some('brand', '[brand, brand]')}, {some('dn', "['DN' || dn, 'DN' || dn]")}, {some('pressure', '[pressure, pressure]')}, {some('material', '[material, material]')},
  regexp_extract_all(std, '[一-龥]{{2,5}}')[1:6], list_transform(range(1, len(b)), lambda k: substring(b, k, 2)), list_transform(range(1, len(b) - 1), lambda k: substring(b, k, 3))) AS l FROM b),
 n AS (SELECT id, token, count(*) AS n FROM (SELECT id, unnest(CASE WHEN len(l) = 0 THEN ['empty'] ELSE l END) AS token FROM l) GROUP BY ALL), w AS (SELECT id, token, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM n),
 p AS (SELECT x.id AS src, y.id AS dst, CASE WHEN x.brand <> '' AND x.brand = y.brand THEN 0.15 ELSE 0 END + CASE WHEN x.material <> '' AND x.material = y.material THEN 0.10 ELSE 0 END AS bonus, len(list_intersect(x.chars, y.chars))::DOUBLE AS common, len(x.chars) + len(y.chars) AS total
  FROM f x JOIN f y ON x.id < y.id AND (x.model = '' OR y.model = '' OR x.model = y.model) AND (x.pressure = '' OR y.pressure = '' OR x.pressure = y.pressure) AND (x.dn = '' OR y.dn = '' OR x.dn = y.dn)),
 c AS (SELECT x.id AS src, y.id AS dst, sum(x.w * y.w) AS cosine FROM w x JOIN w y ON x.token = y.token AND x.id < y.id GROUP BY ALL)
 SELECT id AS src, row_id AS dst FROM e JOIN i USING (material_name, description, std_category) WHERE row_id <> id
 UNION ALL SELECT p.src, p.dst FROM p LEFT JOIN c ON c.src = p.src AND c.dst = p.dst WHERE coalesce(cosine, 0) + bonus::DOUBLE >= 0.55 - 1e-12 OR common / (total - common) >= 0.85""",
        "tk5_reference_evidence": f"""{M}, q AS (SELECT row_id AS query_id, {bare("material_name || ' ' || description")} AS q FROM m WHERE row_id % 50 = 0),
 r AS (SELECT s_suppkey AS reference_id, {bare("concat('DN', s_nationkey * 10, ' ', 'GB/T ', s_suppkey, ' ', 'gate valve ', s_name, ' ', '304')")} AS c FROM supplier),
 t AS (SELECT query_id, reference_id, q, c, list_distinct({cut('q')}) AS x, list_distinct({cut('c')}) AS y FROM q CROSS JOIN r),
 s AS (SELECT query_id, reference_id, coalesce(round(least(1.0, len(list_intersect(x, y))::DOUBLE / nullif(len(x), 0) * 0.75 + CASE WHEN q <> '' AND contains(c, q) THEN 0.25 ELSE 0 END), 6), 0)::DOUBLE AS score FROM t),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, reference_id) AS rank FROM s) SELECT * FROM k WHERE rank <= 3""",
        "er11_category_candidates": f"""{M}, z AS (SELECT place, category AS cat, words FROM (VALUES {names}) t(place, category, words)), y AS (SELECT place, cat, {words} AS words FROM z),
 x AS (SELECT row_id, {own['std_category']} AS std_category, {fold} AS t FROM m), p AS (SELECT row_id, cat AS category, place, std_category = cat AS hit, {letters('t')} AS a, {letters('words')} AS b FROM x CROSS JOIN y),
 s AS (SELECT row_id, category, place, round(least(0.99, greatest(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE * 0.21 + CASE WHEN hit THEN 0.78 ELSE 0 END, CASE WHEN hit THEN 0.65 ELSE 0 END)), 4) AS score FROM p),
 k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, place) AS rank FROM s) SELECT row_id, category, score, rank FROM k WHERE rank <= 3""",
    }
