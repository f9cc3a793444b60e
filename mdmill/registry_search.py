"""Registered queries of searches, indexes, citations and redaction, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdmill.functions import rules, semantics
from mdmill.operators import access, indexing, knowledge, retrieve
from mdmill.registry_operators import M, _masters, _texts, hybrid, standard_tree
from mdmill.session import table
from mdmill.sources.materials import materials

#: Instructions that say what they want by labels in brackets, by labels alone, or by the order of brackets.
LABELLED = """CASE row_id % 4 WHEN 0 THEN concat('把【品牌：Brand', row_id, '】【型号 T', row_id, '】发往上海厂SAP系统') WHEN 1 THEN concat('品牌: Made', row_id, ' 型号: K', row_id, ' 发往北京')
 WHEN 2 THEN concat('请将【Acme', row_id, '】【P', row_id, '】【轴承', row_id, '】【仓储系统】同步到WMS') ELSE '查重' END"""
DEEP = "[" * 10 + "1" + "]" * 10
CUT = "[" * 8 + '"[MAX_DEPTH]"' + "]" * 8
#: Chunks of standards: suppliers by nation, in three versions.
CHUNKS = "SELECT s_suppkey AS chunk_id, s_nationkey % 3 AS version_id, concat('gate valve ', s_nationkey, ' ', s_name) AS content FROM supplier"
WIDTH = 64


def _queries(spark, sf_dir) -> DataFrame:
    return _texts(spark, sf_dir).where("row_id % 50 = 0").withColumnRenamed("row_id", "query_id")


def standards(spark, sf_dir):
    return indexing.standard_search(_queries(spark, sf_dir))


def plant_search(spark, sf_dir):
    """Records near a text, as the plant SHANGHAI sees them."""
    rows = materials(spark, sf_dir)
    index = knowledge.build_index(rows.select(F.col("row_id").alias("key"), F.col("material_name").alias("content")))
    seen = index.join(rows.select(F.col("row_id").alias("key"), F.array("plant_code").alias("plant_codes")), "key")
    return indexing.search_index(_queries(spark, sf_dir), seen, 5, "masters", "SHANGHAI")


def reindexed(spark, sf_dir):
    """Index rows of three versions, of which one was made anew with fewer dimensions."""
    rows = table(spark, sf_dir, "supplier")
    content = F.concat(F.lit("gate valve "), "s_nationkey", F.lit(" "), "s_name")
    chunks = rows.select(F.col("s_suppkey").alias("chunk_id"), (F.col("s_nationkey") % 3).alias("version_id"), content.alias("content"))
    chunks = chunks.withColumn("content_hash", F.sha2("content", 256))
    index = knowledge.build_index(chunks.select(F.col("chunk_id").alias("key"), "content"))
    current = index.join(chunks.select(F.col("chunk_id").alias("key"), "version_id"), "key").select(
        F.col("key").alias("chunk_id"), "version_id", F.lit(semantics.DIMENSION).alias("dimension"), "content_hash", "idx", "w"
    )
    found = indexing.reindex(chunks, current, 1, WIDTH)
    last = F.aggregate("idx", F.lit(-1), lambda s, i: F.greatest(s, i))
    return found.select("chunk_id", "version_id", "dimension", "content_hash", F.size("idx").alias("dims"), last.alias("last"))


def lengths(texts: list[str]) -> list[list[float]]:
    """A model that knows only how long texts are, and fails on every seventh length."""
    return [[float(len(t)), 1.0, float("nan") if len(t) % 7 == 0 else 0.0] for t in texts]


def embedded(spark, sf_dir):
    """Vectors by a model that some texts may not be given to and that fails on others."""
    rows = materials(spark, sf_dir).select(F.col("row_id").alias("id"), F.col("material_name").alias("text"), (F.col("row_id") % 5 > 0).alias("allowed"))
    found = indexing.embed(rows, lengths, 3, "lengths")
    return found.select("id", "provider", F.size("vector").alias("dims"), F.round(F.get("vector", F.lit(0)), 6).alias("first"))


def _sheet(spark, sf_dir) -> DataFrame:
    """Rows of standard files: a file a category of suppliers' nations, some rows read twice."""
    nation = F.col("s_nationkey").cast("string")
    return table(spark, sf_dir, "supplier").select(
        F.lit("SY/T 1").alias("standard_no"), F.lit("2018").alias("version_label"), F.concat(F.lit("f"), nation).alias("filename"), F.sha2(nation, 256).alias("source_sha256"),
        F.lit("items").alias("sheet"), F.floor(F.col("s_suppkey") / 2).cast("long").alias("row_no"), F.concat(F.lit("A"), "s_suppkey").alias("cell_range"),
        F.sha2("s_name", 256).alias("record_sha256"), F.col("s_name").alias("item_name"),
    )


def citation_rows(spark, sf_dir):
    rows = retrieve.citations(_sheet(spark, sf_dir), F.concat("filename", F.lit(" "), "item_name"))
    return rows.select("citation_id", "filename", "row_no", "cell_range", "record_sha256", "excerpt")


def _cited(spark, sf_dir) -> DataFrame:
    """Two places of each entry: in the tree's file, and in that of its aliases."""
    entries, _ = standard_tree(spark, sf_dir)
    place = F.concat(F.upper(F.substring(F.sha2(F.split("content", " / ")[0], 256), 1, 12)), F.lit("#tree!"), F.col("code").cast("long").cast("string"))
    head = F.concat(F.upper(F.substring(F.sha2("content", 256), 1, 12)), F.lit("#alias!1"))
    return entries.select("code", place.alias("citation_id")).unionByName(entries.select("code", head.alias("citation_id")))


def classification(spark, sf_dir):
    """The classification of each record, blank ones included, with its path and evidence."""
    asked = _texts(spark, sf_dir).select(F.col("row_id").alias("query_id"), F.when(F.col("row_id") % 11 == 0, " ").otherwise(F.col("text")).alias("text"))
    found = retrieve.classify(asked, *standard_tree(spark, sf_dir), _cited(spark, sf_dir))
    return found.select(
        "query_id", "code", F.array_join("path", "|").alias("path"), "confidence", F.array_join(F.transform("candidates", lambda c: c["code"]), ",").alias("candidates"),
        "decision", "needs_review", F.array_join("evidence_ids", ",").alias("evidence_ids"),
    )


def cited_search(spark, sf_dir):
    """The best entry of each text with where it and its category stand in the source files."""
    cited = _cited(spark, sf_dir)
    best = hybrid(spark, sf_dir).where("rank = 1")
    return retrieve.with_citations(best, cited).select("query_id", "code", F.array_join("citation_ids", ",").alias("citation_ids"))


def suggestions(spark, sf_dir):
    """Searches of which some ask for records of many sources too: what is found, else what comes near."""
    asked = _queries(spark, sf_dir).withColumn("qty_min", F.when(F.col("query_id") % 100 == 0, 3))
    masters = _masters(spark, sf_dir).withColumn("source_count", F.col("row_id") % 4)
    return retrieve.attribute_search(asked, masters, suggestions=10)


def delivery_filters(spark, sf_dir):
    return materials(spark, sf_dir).select("row_id", semantics.delivery_filters(F.expr(LABELLED)).alias("f")).select("row_id", "f.*")


def redacted_trees(spark, sf_dir):
    """Details with secrets, long texts and deep lists inside objects."""
    said = F.format_string(
        '{"user":{"Api-Token":"%s","note":"%s","n":%d},"list":[{"my_password":1},"%s"],"deep":%s}',
        F.col("event_type"), F.repeat("event_type", 200), F.col("event_id"), F.col("event_type"), F.lit(DEEP),
    )
    raw = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("no json "), F.repeat("event_type", 200))).otherwise(said)
    return table(spark, sf_dir, "events").select("event_id", access.redact_json(raw).alias("detail"))


QUERIES = {
    "er12_standard_search": standards,
    "er6_plant_search": plant_search,
    "er16_reindexed_version": reindexed,
    "er7_model_vectors": embedded,
    "txt25_citation_rows": citation_rows,
    "er9_cited_search": cited_search,
    "er10_classification": classification,
    "tk3_suggestions": suggestions,
    "txt30_delivery_filters": delivery_filters,
    "flt8_nested_redaction": redacted_trees,
}


def oracle_sql(attribute_sql, standard: str, category_sql) -> dict[str, str]:
    """The SQL of QUERIES and of the searches of registry_operators."""
    own = attribute_sql()
    bare = lambda c: f"regexp_replace(lower({c}), '[\\s\\x{{3000}}]+', '', 'g')"
    grams = lambda c, n: f"list_transform(range(1, len({c}) - {n - 2}), lambda i: substring({c}, i, {n}))"
    cut = lambda c: f"list_concat({grams(c, 1)}, {grams(c, 2)}, regexp_extract_all({c}, '[a-z0-9]+'))"
    fold = lambda c: standard.replace(f"{M} SELECT row_id, ", "").rsplit(" AS standard FROM m", 1)[0].replace("lower(trim(material_name || ' ' || description))", f"lower(trim({c}))")

    def vectors(name: str, rows: str, width: str = "384") -> str:
        """CTEs that end in `name` (id, idx, w) for rows (id, b)."""
        return f"""{name}_s AS (SELECT id, (('0x' || substring(h, 1, 8))::BIGINT % {width})::INT AS idx, sum(CASE WHEN ('0x' || substring(h, 9, 2))::INT % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v
 FROM (SELECT *, sha256(unnest({cut('b')})) AS h FROM ({rows})) GROUP BY ALL HAVING v <> 0), {name} AS (SELECT id, idx, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS w FROM {name}_s)"""

    e = f"{M}, e AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in own.items())}, concat_ws(' ', material_name, description) AS text FROM m)"
    kb = ", ".join(f"('{i}', '{' '.join((category, title, words, prefix))}')" for i, category, prefix, title, words in rules.STANDARDS)
    nearest = lambda k: f"""s AS (SELECT q.id AS query_id, key, round(greatest(-1, least(1, coalesce(sum(a.w * b.w), 0))), 6)::DOUBLE AS score
 FROM q CROSS JOIN i LEFT JOIN qv a ON a.id = q.id LEFT JOIN iv b ON b.id = i.key AND a.idx = b.idx GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM s) SELECT * FROM k WHERE rank <= {k}"""  # noqa: E731

    # Hybrid retrieval.
    keywords = " ".join(f"WHEN '{k}' THEN '{','.join([k, *v])}'" for k, v in rules.SYNONYMS.items())
    share = lambda q, qt, c, ct: f"least(1.0, len(list_intersect({qt}, {ct}))::DOUBLE / len({qt}) * 0.75 + CASE WHEN {q} <> '' AND contains({c}, {q}) THEN 0.25 ELSE 0 END)"
    a, b, c = rules.RETRIEVAL_WEIGHTS
    found = f"""{e}, t AS (SELECT std_category, material, lpad(min(row_id)::VARCHAR, 8, '0') AS code FROM e GROUP BY ALL),
 al AS (SELECT code AS target, CASE std_category {keywords} ELSE std_category END AS keywords FROM t UNION ALL SELECT 'X-BRASS', 'brass,steel'),
 tree AS (SELECT *, {bare('content')} AS b FROM (SELECT code, concat_ws(' / ', std_category, material) AS content, false AS outside FROM t UNION ALL SELECT 'X-BRASS', 'brass,steel', true)),
 q AS (SELECT min(row_id) AS id, text, {bare('text')} AS b FROM e GROUP BY text), qt AS (SELECT *, list_distinct({cut('b')}) AS x FROM q), ct AS (SELECT *, list_distinct({cut('b')}) AS y FROM tree),
 kt AS (SELECT *, list_distinct({cut('kb')}) AS z, list_filter(list_transform(regexp_split_to_array(keywords, '{rules.KEYWORD_BREAK}'), lambda w: {bare('w')}), lambda w: w <> '') AS words FROM (SELECT *, {bare('keywords')} AS kb FROM al)),
 ks AS (SELECT keywords, any_value(kb) AS kb, any_value(z) AS z, any_value(words) AS words FROM kt GROUP BY keywords),
 r AS (SELECT id, keywords, CASE WHEN len(list_filter(words, lambda w: contains(b, w))) > 0 THEN 1.0 WHEN s >= 0.6 THEN 0.65 ELSE s * 0.5 END::DOUBLE AS rule FROM (SELECT id, keywords, words, b, {share('b', 'x', 'kb', 'z')} AS s FROM qt CROSS JOIN ks)),
 rule AS (SELECT id, target AS code, max(rule) AS rule FROM r JOIN al USING (keywords) GROUP BY ALL),
 {vectors('qv', 'SELECT id, b FROM q')}, {vectors('ev', 'SELECT code AS id, b FROM tree')}, cosine AS (SELECT qv.id, ev.id AS code, sum(qv.w * ev.w) AS v FROM qv JOIN ev USING (idx) GROUP BY ALL),
 l AS (SELECT id, code, outside, NOT outside AND contains(regexp_replace(text, '[^0-9]', '', 'g'), code) AS exact, {share('qt.b', 'x', 'ct.b', 'y')} AS lex FROM qt CROSS JOIN ct),
 p AS (SELECT id, code, CASE WHEN exact THEN 1.0 ELSE coalesce(rule, 0) END::DOUBLE AS rule, CASE WHEN exact THEN 1.0 ELSE lex END::DOUBLE AS lexical, greatest(coalesce(v, 0), 0)::DOUBLE AS vector
  FROM l LEFT JOIN rule USING (id, code) LEFT JOIN cosine USING (id, code) WHERE NOT outside OR rule > 0),
 s AS (SELECT *, round(least(1.0, rule * {a}::DOUBLE + lexical * {b}::DOUBLE + vector * {c}::DOUBLE), 6)::DOUBLE AS score FROM p),
 k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, rule DESC, code) AS rank FROM s),
 d AS (SELECT id, max(score) AS top, round(max(score) - coalesce(max(CASE WHEN rank = 2 THEN score END), 0), 6) AS margin FROM k WHERE rank <= 2 GROUP BY id),
 h AS (SELECT e.row_id AS query_id, code, score, round(rule, 6) AS rule, round(lexical, 6) AS lexical, round(vector, 6) AS vector, rank, margin,
  CASE WHEN top >= {rules.AUTO_SCORE} AND margin >= {rules.AUTO_MARGIN} THEN 'AUTO_RECOMMEND' ELSE 'REVIEW' END AS decision FROM e JOIN q ON q.text = e.text JOIN k ON k.id = q.id JOIN d ON d.id = q.id WHERE rank <= 3)"""

    # Attribute search.
    stated = attribute_sql("text")
    asks = lambda rows: f"""n AS (SELECT *, {fold('text')} AS std, '' AS none, regexp_extract(text, '(?:{rules.EXCLUDE_WORDS})(?:的|是)?\\s*([A-Za-z0-9一-龥]+)', 1, 'i') AS barred,
  nullif(regexp_extract(text, 'DN\\s*(\\d+)\\s*[~—-]\\s*(\\d+)', 1, 'i'), '')::BIGINT AS q_dn_from, nullif(regexp_extract(text, 'DN\\s*(\\d+)\\s*[~—-]\\s*(\\d+)', 2, 'i'), '')::BIGINT AS q_dn_to FROM ({rows})),
 c AS (SELECT *, {attribute_sql('barred')['material']} AS q_exclude, {stated['model']} AS q_model, {stated['brand']} AS q_brand, {stated['pressure']} AS q_pressure, {category_sql('std', 'none')} AS category, {stated['material']} AS any_material,
  {stated['dn']} AS any_dn FROM n),
 asked AS (SELECT * EXCLUDE (category, any_material, any_dn, none, barred), CASE WHEN category = '{rules.OTHER}' THEN '' ELSE category END AS q_category, CASE WHEN q_exclude = '' THEN any_material ELSE '' END AS q_material,
  CASE WHEN q_dn_from IS NULL THEN any_dn ELSE '' END AS q_dn FROM c)"""  # noqa: E731
    inch = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.SHOWN_INCHES.items())
    metric = f"CASE nullif(regexp_extract(text, '(\\d+)\\s*寸', 1), '') {inch} END"
    plain = "(contains(std_category, '轴承') OR std_category = '润滑油')"
    masters = f"""s AS (SELECT row_id, std_category AS category, brand, model, CASE WHEN std_category IN ('闸阀', '法兰') AND {metric} IS NOT NULL THEN {metric} WHEN {plain} THEN '' ELSE dn END AS dn,
  CASE WHEN {plain} THEN '' ELSE pressure END AS pressure, CASE WHEN contains(std_category, '轴承') AND model <> '' AND material <> '' AND contains(lower(model), lower(material)) THEN '' ELSE material END AS material FROM e),
 g AS (SELECT *, [x FOR x IN [brand, model, category, CASE WHEN dn <> '' THEN 'DN' || dn ELSE '' END, pressure, material] IF x <> ''] AS l FROM s),
 o AS (SELECT *, array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF list_position(l, l[i]) = i], ' ') AS name FROM g),
 w AS (SELECT *, {fold("concat_ws(' ', name, category, model, brand, dn, pressure, material)")} AS whole FROM o)"""
    letters = lambda c: f"list_distinct(string_split(regexp_replace({c}, '\\s+', '', 'g'), ''))"
    hit = {f: f"(q_{f} <> '' AND lower(q_{f}) = lower({f}))" for f in rules.SEARCH_WEIGHTS}
    hit["category"] = "(q_category <> '' AND (lower(q_category) = lower(category) OR contains(lower(category), lower(q_category)) OR contains(lower(q_category), lower(category))))"
    within = "coalesce(try_cast(dn AS BIGINT) BETWEEN q_dn_from AND q_dn_to, false)"
    more = "coalesce(row_id % 4 >= qty_min, false)"

    def search(rows: str, counted: bool) -> str:
        """CTEs that end in z (query_id, row_id, required, matched, overlap, alike, score)."""
        need = " + ".join([*(f"(q_{f} <> '')::INT" for f in hit), "(q_dn_from IS NOT NULL)::INT", *(["(qty_min IS NOT NULL)::INT"] if counted else [])])
        got = " + ".join([*(f"{x}::INT" for x in hit.values()), f"{within}::INT", *([f"{more}::INT"] if counted else [])])
        base = " + ".join(["0::DOUBLE", *(f"CASE WHEN {x} THEN {rules.SEARCH_WEIGHTS[f]}::DOUBLE ELSE 0 END" for f, x in hit.items()), f"CASE WHEN {within} THEN 0.2::DOUBLE ELSE 0 END",
                           *([f"CASE WHEN {more} THEN 0.1::DOUBLE ELSE 0 END"] if counted else [])])
        return f"""{e}, {asks(rows)}, {masters}, wl AS (SELECT *, list_distinct({grams('whole', 2)}) AS wg, {letters('whole')} AS ws FROM w), ql AS (SELECT *, list_distinct({grams('std', 2)}) AS qg, {letters('std')} AS qs FROM asked),
 y AS (SELECT query_id, row_id, ({need})::INT AS required, ({got})::INT AS matched, {base} AS base, len(list_intersect(qg, wg))::DOUBLE / len(qg) AS overlap, len(list_intersect(qs, ws))::DOUBLE / len(list_distinct(list_concat(qs, ws))) AS alike
  FROM ql CROSS JOIN wl WHERE q_exclude = '' OR NOT contains(whole, lower(q_exclude))),
 z AS (SELECT *, base + least(0.2::DOUBLE, overlap * 0.2::DOUBLE) + CASE WHEN alike >= 0.45 THEN least(0.35::DOUBLE, alike * 0.35::DOUBLE) ELSE 0 END AS score FROM y)"""

    fifty = "SELECT row_id AS query_id, text FROM e WHERE row_id % 50 = 0"
    two = lambda c: f"[{c}, {c}]"
    some = lambda c, v: f"CASE WHEN {c} <> '' THEN {v} ELSE [] END"
    return {
        "txt10_term_frequency": f"""{e}, f AS (SELECT *, {fold('text')} AS std FROM e), b AS (SELECT *, substring(regexp_replace(std, '[^一-龥a-z0-9]', '', 'g'), 1, 400) AS b FROM f),
 l AS (SELECT row_id, list_concat({some('model', '[model, model, model]')}, {some('brand', two('brand'))}, {some('dn', two("'DN' || dn"))}, {some('pressure', two('pressure'))}, {some('material', two('material'))},
  regexp_extract_all(std, '[一-龥]{{2,5}}')[1:6], {grams('b', 2)}, {grams('b', 3)}) AS l FROM b), u AS (SELECT row_id, len(l) AS n, unnest(CASE WHEN len(l) = 0 THEN ['empty'] ELSE l END) AS token FROM l)
 SELECT row_id, token, round(count(*)::DOUBLE / greatest(1, any_value(n)), 6) AS tf FROM u GROUP BY row_id, token""",
        "txt32_conditions": f"""{e}, {asks("SELECT row_id AS query_id, concat(text, CASE row_id % 6 WHEN 0 THEN ' 不要304' WHEN 1 THEN ' DN50-150' ELSE '' END) AS text FROM e")} SELECT * EXCLUDE (text, std) FROM asked""",
        "er9_hybrid_search": f"{found} SELECT * FROM h",
        "er10_classify": f"""{found} SELECT query_id, max(CASE WHEN rank = 1 THEN code END) AS code, string_agg(code, ',' ORDER BY rank) AS candidates, any_value(decision) <> 'AUTO_RECOMMEND' AS needs_review FROM h GROUP BY query_id""",
        "er10_classification": f"""{found}, y AS (SELECT code, content, std_category, upper(substring(sha256(std_category), 1, 12)) || '#tree!' || code::BIGINT AS one, upper(substring(sha256(content), 1, 12)) || '#alias!1' AS two FROM (SELECT code, std_category, concat_ws(' / ', std_category, material) AS content FROM t)),
 g AS (SELECT query_id, max(CASE WHEN rank = 1 THEN code END) AS code, max(CASE WHEN rank = 1 THEN score END) AS confidence, string_agg(code, ',' ORDER BY rank) AS candidates, any_value(decision) AS decision FROM h WHERE query_id % 11 > 0 GROUP BY query_id)
 SELECT e.row_id AS query_id, g.code, replace(y.content, ' / ', '|') AS path, confidence, candidates, coalesce(decision, 'UNRESOLVED') AS decision, coalesce(decision, 'UNRESOLVED') <> 'AUTO_RECOMMEND' AS needs_review,
  coalesce(least(one, two) || ',' || greatest(one, two), '') AS evidence_ids FROM e LEFT JOIN g ON g.query_id = e.row_id LEFT JOIN y ON y.code = g.code""",
        "er9_cited_search": f"""{found}, y AS (SELECT code, content, upper(substring(sha256(std_category), 1, 12)) || '#tree!' || code::BIGINT AS one, upper(substring(sha256(content), 1, 12)) || '#alias!1' AS two
 FROM (SELECT code, std_category, concat_ws(' / ', std_category, material) AS content FROM t)) SELECT query_id, h.code, coalesce(least(one, two) || ',' || greatest(one, two), '') AS citation_ids FROM h LEFT JOIN y ON y.code = h.code WHERE rank = 1""",
        "er13_attribute_search": f"""{search(fifty, False)}, v AS (SELECT query_id, row_id, round(least(score, 0.99), 4)::DOUBLE AS score, matched, required FROM z WHERE (required = 0 OR matched = required) AND score > 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM v) SELECT * FROM k WHERE rank <= 20""",
        "tk3_suggestions": f"""{search("SELECT row_id AS query_id, text, CASE WHEN row_id % 100 = 0 THEN 3 END AS qty_min FROM e WHERE row_id % 50 = 0", True)},
 v AS (SELECT query_id, row_id, score, matched, required, NOT ((required = 0 OR matched = required) AND score > 0) AS suggestion FROM z),
 x AS (SELECT query_id, row_id, round(CASE WHEN suggestion THEN least(score * 0.75::DOUBLE + matched::DOUBLE / required * 0.2::DOUBLE, 0.89) ELSE least(score, 0.99) END, 4)::DOUBLE AS score, matched, required, suggestion FROM v
  WHERE NOT suggestion OR (matched > 0 AND matched::DOUBLE / required >= 0.5)),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id, suggestion ORDER BY CASE WHEN suggestion THEN matched::DOUBLE / required ELSE 0 END DESC, score DESC, row_id) AS rank, bool_or(NOT suggestion) OVER (PARTITION BY query_id) AS answered FROM x)
 SELECT * EXCLUDE (answered) FROM k WHERE CASE WHEN answered THEN NOT suggestion AND rank <= 20 ELSE rank <= 10 END""",
        "er12_standard_search": f"""{e}, q AS (SELECT row_id AS id, {bare(fold('text'))} AS b FROM e WHERE row_id % 50 = 0), i AS (SELECT key, {bare('content')} AS b FROM (VALUES {kb}) t(key, content)),
 {vectors('qv', 'SELECT id, b FROM q')}, {vectors('iv', 'SELECT key AS id, b FROM i')}, {nearest(3)}""",
        "er6_plant_search": f"""{e}, q AS (SELECT row_id AS id, {bare('text')} AS b FROM e WHERE row_id % 50 = 0), i AS (SELECT row_id AS key, {bare('material_name')} AS b FROM e WHERE plant_code IN ('SHANGHAI', 'GROUP')),
 {vectors('qv', 'SELECT id, b FROM q')}, {vectors('iv', 'SELECT key AS id, b FROM i')}, {nearest(5)}""",
        "er16_reindexed_version": f"""WITH c AS ({CHUNKS}), {vectors('v', f"SELECT chunk_id AS id, {bare('content')} AS b, CASE WHEN version_id = 1 THEN {WIDTH} ELSE 384 END AS dimension FROM c", 'dimension').replace('SELECT id, ((', 'SELECT id, dimension, ((', 1)},
 n AS (SELECT id, count(*) AS dims, max(idx) AS last FROM v GROUP BY id) SELECT chunk_id, version_id, CASE WHEN version_id = 1 THEN {WIDTH} ELSE 384 END AS dimension, sha256(content) AS content_hash, dims, last FROM c JOIN n ON id = chunk_id""",
        "er7_model_vectors": f"""{M}, x AS (SELECT row_id AS id, material_name, row_id % 5 > 0 AND material_name <> '' AND len(material_name) % 7 > 0 AS made FROM m), {vectors('v', f"SELECT id, {bare('material_name')} AS b FROM x")}
 SELECT x.id, CASE WHEN made THEN 'lengths' ELSE 'local' END AS provider, CASE WHEN made THEN 3 ELSE 384 END AS dims, round(CASE WHEN made THEN len(material_name)::DOUBLE ELSE coalesce(w, 0) END, 6) AS first FROM x LEFT JOIN v ON v.id = x.id AND idx = 0""",
        "txt25_citation_rows": """WITH r AS (SELECT upper(substring(sha256(s_nationkey::VARCHAR), 1, 12)) || '#items!' || (s_suppkey // 2) AS citation_id, 'f' || s_nationkey AS filename, s_suppkey // 2 AS row_no, 'A' || s_suppkey AS cell_range,
 sha256(s_name) AS record_sha256, 'f' || s_nationkey || ' ' || s_name AS excerpt FROM supplier) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY citation_id ORDER BY record_sha256 DESC) = 1""",
        "txt30_delivery_filters": f"""{M} SELECT row_id, CASE row_id % 4 WHEN 0 THEN 'Brand' || row_id WHEN 1 THEN 'Made' || row_id WHEN 2 THEN 'Acme' || row_id ELSE '' END AS brand,
 CASE row_id % 4 WHEN 0 THEN 'T' || row_id WHEN 1 THEN 'K' || row_id WHEN 2 THEN 'P' || row_id ELSE '' END AS model, CASE WHEN row_id % 4 = 2 THEN '轴承' || row_id ELSE '' END AS name FROM m""",
        "flt8_nested_redaction": f"""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN substring('no json ' || repeat(event_type, 200), 1, 500)
 ELSE concat('{{"user":{{"Api-Token":"[REDACTED]","note":"', substring(repeat(event_type, 200), 1, 500), '","n":', event_id, '}},"list":[{{"my_password":"[REDACTED]"}},"', event_type, '"],"deep":{CUT}}}') END AS detail FROM events""",
    }
