"""Text functions of the material domain as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mdmill.functions import rules


def clean(c: Column) -> Column:
    """Null becomes '', white space at both ends goes (full-width space too)."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """clean, each run of white space becomes one space, and a whole number written as a decimal loses its fraction."""
    return F.regexp_replace(F.regexp_replace(clean(c), r"(?U)\s+", " "), r"^(-?\d+)\.0+$", "$1")


def header_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(clean(c)), r"(?U)[\s_\-./\\()（）\[\]【】:：]+", "")


def utc(c: Column) -> Column:
    """A time text as a timestamp: naive times and those with Z are UTC (in a UTC session); null where it is no time."""
    return F.try_to_timestamp(F.regexp_replace(clean(c), "Z$", "+00:00"))


def plant_code(c: Column, default: str = "GROUP") -> Column:
    raw = clean(c)
    alias = F.create_map(*(F.lit(x) for pair in rules.PLANT_ALIASES.items() for x in pair))[F.lower(raw)]
    kept = F.regexp_replace(F.upper(raw), "[^A-Z0-9_-]", "")
    return F.coalesce(alias, F.when(kept != "", kept), F.lit(default))


def connector(c: Column) -> Column:
    """struct(connector, source_table) of a source system; the first system named wins, files are the rest."""
    upper = F.upper(clean(c))
    value = lambda k: F.struct(*(F.lit(v).alias(n) for n, v in zip(("connector", "source_table"), rules.CONNECTORS[k])))
    names = [k for k in rules.CONNECTORS if k != "CSV"]
    return F.coalesce(*(F.when(upper.contains(k), value(k)) for k in names), value("CSV"))


def standardize(c: Column) -> Column:
    """Replace synonyms one after another, all-digit standards first; a replacement is matched again by later ones."""
    numeric = sorted((k for k in rules.SYNONYMS if k.isdigit()), key=int)
    order = [*numeric, *(k for k in rules.SYNONYMS if not k.isdigit())]
    steps = [(s.lower(), k) for k in order for s in rules.SYNONYMS[k]]
    return reduce(lambda v, s: F.regexp_replace(v, "(?i)" + re.escape(s[0]), s[1]), steps, F.lower(clean(c)))


def _first(patterns, c: Column) -> Column:
    return F.coalesce(*(F.when(c.rlike("(?i)" + p), F.lit(v)) for v, p in patterns))


def category(name: Column, raw: Column) -> Column:
    mapped = F.create_map(*(F.lit(x) for pair in rules.RAW_CATEGORIES.items() for x in pair))[clean(raw)]
    text = F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(raw, F.lit("")))
    return F.coalesce(mapped, _first(rules.CATEGORY_PATTERNS, text), F.when(clean(raw) != "", clean(raw)), F.lit(rules.OTHER))


def brand(c: Column) -> Column:
    low = F.lower(clean(c))
    return F.coalesce(*(F.when(low.contains(b.lower()), F.lit(b)) for b in rules.BRANDS), F.lit(""))


def model(c: Column) -> Column:
    """The first model pattern found, in upper case; letters, digits and underscores of ASCII alone make words."""
    java = [re.sub(r"^\\b", "(?<![A-Za-z0-9_])", p).replace(r"\b", "(?![A-Za-z0-9_])") for p in rules.MODEL_PATTERNS]
    found = F.coalesce(*(F.nullif(F.regexp_extract(clean(c), "(?i)" + p, 0), F.lit("")) for p in java), F.lit(""))
    return F.regexp_replace(F.upper(found), "[–—]", "-")


def dn(c: Column) -> Column:
    some = lambda p: F.nullif(F.regexp_extract(clean(c), p, 1), F.lit(""))
    inch = some(r"(?U)(\d+)\s*寸")
    metric = F.create_map(*(F.lit(x) for pair in rules.INCHES.items() for x in pair))[inch]
    return F.coalesce(some(r"(?iU)DN\s*(\d+)"), some(r"(?iU)(\d+)\s*mm"), metric, inch, F.lit(""))


def pressure(c: Column) -> Column:
    number = F.nullif(F.regexp_extract(clean(c), r"(?iU)(\d+\.?\d*)\s*(mpa|bar|公斤)", 1), F.lit(""))
    return F.coalesce(_first(rules.PRESSURE_PATTERNS, clean(c)), F.concat(number, F.lit("MPa")), F.lit(""))


def material(c: Column) -> Column:
    return F.coalesce(_first(rules.MATERIAL_PATTERNS, clean(c)), F.lit(""))


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of characters, white space aside; 1 when both are blank."""
    letters = lambda c: F.array_distinct(F.split(F.regexp_replace(F.lower(clean(c)), r"(?U)\s+", ""), ""))
    x, y = (F.filter(letters(c), lambda ch: ch != "") for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 for different lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.least(F.greatest(dot(a, b) / F.nullif(norm, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
    return F.when(F.size(a) == F.size(b), F.coalesce(value, F.lit(0.0))).otherwise(0.0)


def plain(standard: Column) -> Column:
    """The first 400 CJK characters, letters and digits of a standardised text."""
    return F.substring(F.regexp_replace(standard, "[^一-龥a-z0-9]", ""), 1, 400)


def semantic_tokens(record_model, record_brand, record_dn, record_pressure, record_material, standard: Column, bare: Column) -> Column:
    """Attributes (model three times, the others twice), the first six CJK runs, and character 2- and 3-grams of bare, the plain text.

    Both texts should be columns of a stored table: as expressions they would be worked out again for every gram.
    """
    twice = lambda c: F.when(c != "", F.array_repeat(c, 2)).otherwise(F.array().cast("array<string>"))
    runs = F.slice(F.regexp_extract_all(standard, F.lit("([一-龥]{2,5})"), 1), 1, 6)
    none = F.array().cast("array<string>")
    grams = lambda n: F.when(
        F.length(bare) >= n,
        F.transform(F.sequence(F.lit(1), F.length(bare) - (n - 1)), lambda i: F.substring(bare, i, F.lit(n))),
    ).otherwise(none)
    parts = F.concat(
        F.when(record_model != "", F.array_repeat(record_model, 3)).otherwise(none),
        twice(record_brand),
        twice(F.when(record_dn != "", F.concat(F.lit("DN"), record_dn)).otherwise("")),
        twice(record_pressure),
        twice(record_material),
        runs,
        grams(2),
        grams(3),
    )
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("empty")))


def frequencies(tokens: Column) -> Column:
    """array of struct(token, tf): each distinct token with its share of all, in order; made inside the row, without a shuffle."""

    def counted(t):
        n = F.size(t)
        first = lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1))
        starts = F.filter(F.sequence(F.lit(0), n - 1), first)
        share = lambda s: F.transform(s, lambda at, k: F.struct(F.get(t, at).alias("token"), ((F.coalesce(F.get(s, k + 1), n) - at) / n).alias("tf")))
        return F.when(n > 0, F.transform(F.array(starts), share)[0]).otherwise(F.array().cast("array<struct<token:string,tf:double>>"))

    # As variables the sorted tokens and their starts are worked out once.
    return F.transform(F.array(F.sort_array(tokens)), counted)[0]


def pressure_number(value: Column) -> Column:
    """The number in a pressure text; null where there is none or the text is null."""
    return F.regexp_replace(value, "[^0-9.]", "").try_cast("double")


def access_list(values: Column, default: str) -> Column:
    """Access words without blanks, in upper case, each once in the order given; [default] where none is left."""
    cleaned = F.array_distinct(F.filter(F.transform(values, lambda v: F.upper(F.trim(v))), lambda v: v != ""))
    return F.when(F.size(cleaned) > 0, cleaned).otherwise(F.array(F.lit(default)))


def parsed_map(value: Column) -> Column:
    """A JSON object as a map of strings; an empty map where the text is null or no object."""
    parsed = F.from_json(value, "map<string,string>", {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def checked_vector(vector: Column, dimension: int) -> Column:
    """The vector, or an empty one where its length is not the dimension or it is null."""
    return F.when(F.size(vector) == dimension, vector).otherwise(F.array().cast("array<float>"))
