"""Likeness of short texts: candidates by rare characters, an upper bound from character counts, the matcher for what is left."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mdmill.functions import text
from mdmill.session import save

#: Shares of common characters and of order in a likeness, its most for different texts, and where one text holds the other.
LETTERS, ORDER, MOST, HOLDS = 0.55, 0.45, 0.9, 0.92
#: The fields of parts().
PARTS = ("text", "letters", "tokens")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def parts(value: Column) -> Column:
    """struct(text, letters, tokens) of a standardized text: its distinct letters, and its characters numbered by occurrence."""
    bare = F.regexp_extract_all(F.regexp_replace(F.lower(text.clean(value)), r"(?U)\s+", ""), F.lit("(?s)."), 0)
    marks = F.array_sort(F.regexp_extract_all(value, F.lit("(?s)."), 0))
    tokens = F.transform(marks, lambda c, i: F.concat(c, F.lit("#"), (i - F.array_position(marks, c).cast("int")).cast("string")))
    return F.struct(value.alias("text"), F.array_distinct(bare).alias("letters"), tokens.alias("tokens"))


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a["letters"], b["letters"])), F.size(F.array_union(a["letters"], b["letters"]))
    return F.when(either == 0, 1.0).otherwise(both / either)


def likeness(a: Column, b: Column, ratio: Column) -> Column:
    """1 if equal, HOLDS if one holds the other, else at most MOST by characters and the ratio of the matcher; 0 if one is blank."""
    x, y = a["text"], b["text"]
    near = F.round(F.least(F.lit(MOST), jaccard(a, b) * LETTERS + ratio * ORDER), 4)
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(x.contains(y) | y.contains(x), HOLDS).otherwise(near)


def most_alike(a: Column, b: Column) -> Column:
    """What likeness can be at most: the matcher's ratio is at most that of the common characters, order aside."""
    n = F.size(a["tokens"]) + F.size(b["tokens"])
    return likeness(a, b, F.when(n == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a["tokens"], b["tokens"])) / n))


def settled(a: Column, b: Column) -> Column:
    """Does likeness need no matcher?"""
    x, y = a["text"], b["text"]
    return (x == "") | (y == "") | (x == y) | x.contains(y) | y.contains(x)


def candidates(wants: DataFrame, has: DataFrame, least: float) -> DataFrame:
    """(want, has): all pairs of distinct texts whose likeness may reach `least`, by joins on characters.

    wants and has (p: parts). Such a pair has a Jaccard similarity or a share of
    common characters of `least`, or one text holds the other. So it shares one
    of the want's rarest characters, as many as leave too few others; or, where
    the want holds the other, the rarest character of that. Both joins are on
    numbered characters, rare ones first.
    """
    each = lambda df, name: df.select(F.col("p.text").alias(name), F.size("p.tokens").alias("n"), F.size("p.letters").alias("k"), F.explode("p.tokens").alias("token"))
    of_has, _ = save(each(has, "has"), "tokens")
    common = of_has.groupBy("token").agg(F.count("*").alias("df"))
    rarest = lambda df, name: df.join(common, "token", "left").withColumn("place", F.row_number().over(Window.partitionBy(name).orderBy(F.coalesce("df", F.lit(0)), "token")))
    needed = F.greatest(F.lit(1), F.least(F.ceil(F.col("n") * least / (2 - least) - 1e-9), F.ceil(F.col("k") * least - 1e-9)))
    of_want, _ = save(rarest(each(wants, "want"), "want"), "tokens")
    first = of_want.where(F.col("place") <= F.col("n") - needed + 1).join(of_has.select("token", "has"), "token").select("want", "has")
    second = rarest(of_has, "has").where("place = 1").join(of_want.select("token", "want"), "token").select("want", "has")
    return first.unionByName(second).distinct()


def ratios(pairs: DataFrame) -> DataFrame:
    """(a, b, ratio) of distinct pairs (a, b), by the matcher."""
    spread = pairs.distinct().repartition("a", "b")
    return save(spread.select("a", "b", sequence_ratio(F.col("a"), F.col("b")).alias("ratio")), "ratios")[0]
