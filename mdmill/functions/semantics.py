"""Terms, hashed embeddings, names and intents as column expressions."""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdmill.functions import rules, text

DIMENSION = 384
#: Rows that are made vectors at a time.
VECTOR_ROWS = 1024


def bare(c: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(text.clean(c)), r"(?U)\s+", "")


def pieces(c: Column) -> Column:
    """Characters, character pairs and runs of ASCII letters and digits of bare text, repeats included."""

    def cut_up(t):
        n = F.length(t)
        cut = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(t, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
        return F.concat(cut(1), cut(2), F.regexp_extract_all(t, F.lit("([a-z0-9]+)"), 1))

    # As a variable c is worked out once, not for every piece.
    return F.transform(F.array(c), cut_up)[0]


def terms(c: Column) -> Column:
    return F.array_distinct(pieces(bare(c)))


def lexical_similarity(query: Column, content: Column, query_terms: Column, content_terms: Column) -> Column:
    """Three quarters for the share of the query's terms found, a quarter if the content holds the whole query."""
    return bare_similarity(bare(query), bare(content), query_terms, content_terms)


def bare_similarity(query: Column, content: Column, query_terms: Column, content_terms: Column) -> Column:
    """lexical_similarity of bare texts: over pairs of rows they should be columns, or they are worked out again for each pair."""
    share = F.size(F.array_intersect(query_terms, content_terms)) / F.nullif(F.size(query_terms), F.lit(0))
    phrase = F.when((query != "") & content.contains(query), 0.25).otherwise(0.0)
    return F.coalesce(F.least(F.lit(1.0), share * 0.75 + phrase), F.lit(0.0))


def signed_pieces(words: pa.ListArray, dimension: int = DIMENSION) -> np.ndarray:
    """A row for each list of pieces: each piece adds its sign at the place its SHA-256 gives. Pieces that lists share are hashed once."""
    coded = pc.list_flatten(words).dictionary_encode()
    digests = [sha256(p.encode()).digest() for p in coded.dictionary.to_pylist()]
    place = np.array([int.from_bytes(d[:4]) % dimension for d in digests], np.int64)
    sign = np.array([1.0 if d[4] % 2 else -1.0 for d in digests])
    at = coded.indices.to_numpy()
    where = pc.list_parent_indices(words).to_numpy().astype(np.int64) * dimension + place[at]
    return np.bincount(where, sign[at], len(words) * dimension).reshape(len(words), dimension)


def sparse_vectors(items: DataFrame, words: Column, dimension: int = DIMENSION) -> DataFrame:
    """(id, idx array, w array): hashed unit vectors, a row for each of items (unique id) with places in order. Text without pieces has no row.

    A row is worked out by itself, so nothing is shuffled and a task holds VECTOR_ROWS rows at a time.
    """

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, VECTOR_ROWS):
                part = batch.slice(i, VECTOR_ROWS)
                summed = signed_pieces(part.column(1), dimension)
                row, idx = np.nonzero(summed)
                w = summed[row, idx] / np.sqrt((summed * summed).sum(1))[row]
                of, n = np.unique(row, return_counts=True)
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of)), pa.ListArray.from_arrays(ends, pa.array(idx, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(w))], names=["id", "idx", "w"]
                )

    rows = items.select("id", words.alias("words"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"]]).add("idx", T.ArrayType(T.IntegerType())).add("w", T.ArrayType(T.DoubleType())))


def hashed_vectors(items: DataFrame, words: Column, dimension: int = DIMENSION) -> DataFrame:
    """(id, idx, w): the places and weights of sparse_vectors, one row each."""
    pair = F.explode(F.arrays_zip("idx", "w")).alias("p")
    return sparse_vectors(items, words, dimension).select("id", pair).select("id", "p.idx", "p.w")


def shown_attributes(records: DataFrame) -> DataFrame:
    """Enriched records with dn, pressure and material as a golden record shows them.

    Bearings have no size and no pressure, nor a material that their model
    contains; oils have no size and no pressure; valves and flanges given in
    inches show the metric size.
    """
    whole = F.concat_ws(" ", "material_name", "description")
    bearing, oil = F.col("std_category").contains("轴承"), F.col("std_category") == "润滑油"
    inch = F.nullif(F.regexp_extract(whole, r"(?U)(\d+)\s*寸", 1), F.lit(""))
    metric = F.create_map(*(F.lit(x) for pair in rules.SHOWN_INCHES.items() for x in pair))[inch]
    inside = bearing & (F.col("model") != "") & (F.col("material") != "") & F.lower("model").contains(F.lower("material"))
    return records.withColumns(
        {
            "material": F.when(inside, "").otherwise(F.col("material")),
            "pressure": F.when(bearing | oil, "").otherwise(F.col("pressure")),
            "dn": F.when(F.col("std_category").isin("闸阀", "法兰") & metric.isNotNull(), metric).when(bearing | oil, "").otherwise(F.col("dn")),
        }
    )


def standard_name() -> Column:
    """Brand, model, category, size, pressure, material of a row of shown_attributes; blanks and repeats left out."""
    size = F.when(F.col("dn") != "", F.concat(F.lit("DN"), "dn")).otherwise("")
    parts = F.array("brand", "model", "std_category", size, "pressure", "material")
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), " ")


def golden_code(category: Column, signature: Column) -> Column:
    prefix = F.create_map(*(F.lit(x) for pair in rules.CODE_PREFIXES.items() for x in pair))[category]
    return F.concat(F.coalesce(prefix, F.lit("MDM-X")), F.lit("-"), F.upper(F.substring(F.sha1(signature), 1, 8)))


def _any(c: Column, words) -> Column:
    return F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: c.contains(w))


def target_systems(c: Column) -> Column:
    """Systems an instruction names, in the order of the table; all of them if it says so."""
    low = F.lower(text.clean(c))
    named = F.array_compact(F.array(*(F.when(_any(low, (s, *names)), F.lit(s)) for s, names in rules.TARGET_SYSTEMS.items())))
    return F.when(_any(low, rules.ALL_SYSTEMS), F.array(*(F.lit(s) for s in rules.TARGET_SYSTEMS))).otherwise(named)


def target_plants(c: Column) -> Column:
    """Plants an instruction names, longest alias first; the group if none."""
    low = F.lower(text.clean(c))
    longest = sorted(rules.PLANT_ALIASES.items(), key=lambda pair: -len(pair[0]))
    found = F.array_distinct(F.array_compact(F.array(*(F.when(low.contains(a), F.lit(p)) for a, p in longest))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("GROUP")))


def delivery_mode(c: Column) -> Column:
    return F.when(_any(F.lower(text.clean(c)), rules.INCREMENTAL_WORDS), "INCREMENTAL").otherwise("FULL")


def command_route(c: Column) -> Column:
    """struct(action, confidence) of a command."""
    low = F.lower(text.clean(c))
    route = lambda a, p: F.struct(F.lit(a).alias("action"), F.lit(p).alias("confidence"))
    deliver = _any(low, rules.DELIVERY_VERBS) & _any(low, (*rules.TARGET_SYSTEMS, *rules.DELIVERY_PLACES))
    return F.when(deliver, route("DISTRIBUTE", 0.96)).when(_any(low, rules.GOVERN_WORDS), route("GOVERN", 0.9)).otherwise(route("SEARCH", 0.82))


def delivery_filters(c: Column) -> Column:
    """struct(brand, model, name) that an instruction asks for; '' where it does not say.

    A field is what follows its label inside brackets, else after its label in
    the text. Brackets before the destination that hold no label, system or
    plant fill brand, model and name by their place, unless a label did.
    """
    inside = lambda t: F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"[【\[]([^】\]]+)[】\]]"), 1), text.clean), lambda x: x != "")
    every = [w for words in rules.FIELD_LABELS.values() for w in words]
    before = F.split(c, "发往|同步到|分发到|发送到", 2)[0]
    named = lambda x, words: reduce(lambda a, b: a | b, (x.contains(w.lower()) for w in words))
    systems = [a for names in rules.TARGET_SYSTEMS.values() for a in names]
    bare_item = lambda x: ~(named(F.lower(x), every) | named(F.lower(x), systems) | named(F.lower(x), rules.PLANT_ALIASES) | F.lower(x).isin(*(s.lower() for s in rules.TARGET_SYSTEMS)))
    placed = F.filter(inside(before), bare_item)
    out = []
    for i, (field, words) in enumerate(rules.FIELD_LABELS.items()):

        def labelled(item):
            values = (text.clean(F.regexp_extract(item, rf"(?iU)^{w}\s*[:：=]?\s*(.+)$", 1)) for w in words)
            return F.coalesce(*(F.when((v != "") & ~v.isin(*words), v) for v in values))

        boxed = F.get(F.filter(F.transform(inside(c), labelled), lambda v: v.isNotNull()), F.lit(0))
        loose = rf"(?iU)(?:{'|'.join(words)})\s*[:：=]?\s*[【\[]?([^】\],，;；]+?)[】\]]?(?=\s*(?:{rules.LABEL_ENDS}|$))"
        free = text.clean(F.regexp_extract(c, loose, 1))
        said = F.when((free != "") & ~F.lower(free).isin(*words), free)
        out.append(F.coalesce(boxed, said, F.get(placed, F.lit(i)), F.lit("")).alias(field))
    return F.struct(*out)
