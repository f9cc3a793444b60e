"""Merkle fingerprints of documents: sentences, paragraphs, sections, root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mdmill.llm.common import maybe_in, membership_bitmap, text_of
from mdmill.session import save, table

#: Where leaves end; what stands before a cut tells whether it took a blank, so no two texts have the same leaves.
LEAF_ENDS = r"(?<=[.!?]) |(?<=[。！？；，、])|(?<=\S{10}) "
#: Hex digits of a leaf that a fingerprint shows.
MARK = 8
#: First hex digits of a paragraph's digest that end a section, one in eight.
SECTION_ENDS = ("0", "1")
#: Documents of one window in neighbour order, and quantiles that place the windows.
WINDOW_ROWS, QUANTILES = 2000, 64


def merkle_tree(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with `name`: struct(root, sections, paragraphs, leaves).

    A paragraph is a line; its leaves are its sentences, so that a one-line
    text still has branches: LEAF_ENDS cuts at the blank after . ! or ?, behind
    full-width stops and commas, and, for texts without stops, at the blank
    after a word of ten characters or more. A section is a run
    of paragraphs that ends where a paragraph's digest says so; an edit thus
    moves no border but its own. Every inner digest is the SHA-256 of its
    children's, and no cut loses a character: roots are equal when the texts are.
    """
    p, d, s = f"__p_{name}", f"__d_{name}", f"__s_{name}"
    sha = lambda c: F.sha2(c, 256)
    joined = lambda c: sha(F.array_join(c, " "))
    ended = lambda h: F.concat(h, F.when(F.substring(h, 1, 1).isin(*SECTION_ENDS), "\n").otherwise(" "))
    return (
        df.withColumn(
            p,
            F.transform(F.split(text, "\n", -1), lambda line: F.transform(F.split(line, LEAF_ENDS, -1), sha)),
        )
        .withColumn(d, F.transform(p, joined))
        .withColumn(s, F.transform(F.split(F.array_join(F.transform(d, ended), ""), "\n", -1), sha))
        .withColumn(
            name,
            F.struct(
                joined(F.col(s)).alias("root"),
                F.col(s).alias("sections"),
                F.col(d).alias("paragraphs"),
                F.flatten(p).alias("leaves"),
            ),
        )
        .drop(p, d, s)
    )


def fingerprint(tree: str) -> Column:
    """The root, a colon, and the first digits of each leaf."""
    marks = F.transform(f"{tree}.leaves", lambda h: F.substring(h, 1, MARK))
    return F.concat(F.col(f"{tree}.root"), F.lit(":"), F.array_join(marks, " "))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the leaves of two fingerprints; 1 when the roots are equal."""
    leaves = lambda f: F.split(F.substring_index(f, ":", -1), " ")
    both = F.size(F.array_intersect(leaves(a), leaves(b)))
    return F.when(a == b, 1.0).otherwise(both / F.size(F.array_union(leaves(a), leaves(b))))


def _sectioned(tree: str) -> Column:
    """The sections of a tree as structs: digest, number of the first paragraph, digests of its paragraphs."""
    d, sections = F.col(f"{tree}.paragraphs"), F.col(f"{tree}.sections")
    # Behind each border the number of the next section's first paragraph; a text that ends with a border has an empty last section.
    marked = F.transform(d, lambda h, i: F.when(F.substring(h, 1, 1).isin(*SECTION_ENDS), i + 1))
    begins = F.concat(F.array(F.lit(0)), F.array_compact(marked))
    ends = F.concat(F.array_compact(marked), F.array(F.size(d)))
    return F.transform(
        F.arrays_zip(sections.alias("digest"), begins.alias("first"), ends.alias("past")),
        lambda s: F.struct(s["digest"].alias("digest"), s["first"].alias("first"), (s["past"] - s["first"]).alias("n")),
    )


def _kept(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that later lambdas read: a generator between keeps them from being worked out anew for each element."""
    df = df.withColumn("__kept", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
    return df.withColumns({n: F.col(f"__kept.{n}") for n in columns}).drop("__kept")


def with_edited_ranges(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with `name`: ranges (first, last) of paragraphs, from 0, that tree b has and tree a lacks, in order.

    A descent: equal roots end it. Else sections are compared, and only the
    paragraphs of sections that the other tree lacks are looked at, against
    those of its sections that this one lacks. Neighbours make one range. What
    was deleted are the ranges of the trees the other way round. A paragraph
    that moved with its whole section is not edited.
    """
    rows = _kept(df, {a: F.col(a), b: F.col(b), "__same": F.col(f"{a}.root") == F.col(f"{b}.root")})
    none = lambda c: F.when(~F.col("__same"), c).otherwise(F.slice(c, 1, 0))
    # Sections that only one tree has, by sets of digests; their rows are picked by a look at that short set.
    rows = _kept(rows, {"__sa": none(_sectioned(a)), "__sb": none(_sectioned(b)), "__oa": F.array_except(f"{a}.sections", f"{b}.sections"), "__ob": F.array_except(f"{b}.sections", f"{a}.sections")})
    mine = lambda sections, only: F.filter(sections, lambda s: F.array_contains(only, s["digest"]))
    rows = _kept(rows, {"__sa": mine(F.col("__sa"), F.col("__oa")), "__sb": mine(F.col("__sb"), F.col("__ob"))})
    cut = lambda tree, sections: F.flatten(F.transform(sections, lambda s: F.slice(F.col(f"{tree}.paragraphs"), s["first"] + 1, s["n"])))
    numbers = F.flatten(F.transform("__sb", lambda s: F.when(s["n"] > 0, F.sequence(s["first"], s["first"] + s["n"] - 1)).otherwise(F.array().cast("array<int>"))))
    rows = _kept(rows, {"__old": F.array_distinct(cut(a, F.col("__sa"))), "__new": F.arrays_zip(cut(b, F.col("__sb")).alias("h"), numbers.alias("i"))})
    rows = _kept(rows, {"__fresh": F.array_except(F.transform("__new", lambda x: x["h"]), F.col("__old"))})
    rows = _kept(rows, {"__at": F.transform(F.filter("__new", lambda x: F.array_contains("__fresh", x["h"])), lambda x: x["i"])})
    # The numbers rise: a range begins where the number before is not one less, and ends where the next is not one more.
    first = F.filter("__at", lambda i, k: (k == 0) | (F.get("__at", k - 1) != i - 1))
    last = F.filter("__at", lambda i, k: (k == F.size("__at") - 1) | (F.get("__at", k + 1) != i + 1))
    ranges = F.zip_with(first, last, lambda x, y: F.struct(x.alias("first"), y.alias("last")))
    return rows.withColumn(name, ranges).drop("__same", "__sa", "__sb", "__oa", "__ob", "__old", "__new", "__fresh", "__at")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint), a row for each row of docs; null counts as empty; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return merkle_tree(rows, F.col("text"), "tree").select("doc_id", fingerprint("tree").alias("fingerprint"))


def _window_of(docs: DataFrame) -> Column:
    """A number that never falls as doc_id rises, equal for about WINDOW_ROWS documents.

    Quantiles of doc_id cut the ids into at most QUANTILES ranges, and each
    range is cut evenly.
    """
    shares = [i / QUANTILES for i in range(QUANTILES)]
    n, cuts, top = docs.agg(F.count("*"), F.percentile_approx("doc_id", shares, 1000), F.max("doc_id")).first()
    if not cuts:
        return F.lit(-1).cast("long")
    cuts = sorted(set(cuts))
    each = max(1, -(-n // (WINDOW_ROWS * len(cuts))))
    ends = [*cuts[1:], top + 1]
    array = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    k = F.greatest(F.size(F.filter(array(cuts), lambda c: c <= F.col("doc_id"))), F.lit(1))
    lo, hi = F.element_at(array(cuts), k), F.element_at(array(ends), k)
    part = F.floor((F.col("doc_id") - lo) * F.lit(float(each)) / (hi - lo))
    return F.when(F.col("doc_id").isNull(), -1).otherwise(
        k * each + F.greatest(F.lit(0), F.least(part, F.lit(each - 1)))
    ).cast("long")


def with_next(rows: DataFrame, *carried: str) -> DataFrame:
    """rows with next_<c> of the row that follows in ascending (doc_id, text); the first follows the last.

    Rows are dealt to windows of about WINDOW_ROWS rows by doc_id. The first
    row of each window also goes to the end of the window before it, so each
    row is shuffled once and no window reads another. Null ids come first.
    """
    ids = rows.select("doc_id")
    window = _window_of(ids)
    heads = ids.withColumn("w", window).groupBy("w").agg(F.min("doc_id").alias("head"))
    order = Window.orderBy("w")
    heads = heads.withColumn("before", F.coalesce(F.lag("w").over(order), F.max("w").over(Window.partitionBy())))
    heads, _ = save(heads.select("head", "before"), "heads")
    bitmap = membership_bitmap(heads, F.xxhash64("head"))
    maybe = maybe_in(rows, bitmap, F.xxhash64("doc_id"), "maybe").where("maybe").drop("maybe")
    extra = maybe.join(heads, maybe["doc_id"].eqNullSafe(heads["head"])).select(
        *rows.columns, F.col("before").alias("w"), F.lit(True).alias("extra")
    )
    all_rows = rows.withColumns({"w": window, "extra": F.lit(False)}).unionByName(extra)
    following = Window.partitionBy("w").orderBy("extra", F.col("doc_id").asc_nulls_first(), "text")
    return (
        all_rows.withColumns({f"next_{c}": F.lead(c).over(following) for c in carried})
        .where(~F.col("extra"))
        .drop("w", "extra")
    )


def edits(docs: DataFrame) -> DataFrame:
    """The fingerprints of every text, of its edited text, and their likeness.

    The edited text has the last quarter of the text (floor) replaced by as
    many first code points of the next document's text, or all of it if that is
    shorter. Null texts count as empty. Rows that repeat a doc_id follow one
    another by text. An only document follows itself. An empty table gives an
    empty result. Other columns are ignored.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    rows = merkle_tree(rows, F.col("text"), "tree").select("doc_id", "text", fingerprint("tree").alias("fp"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = with_next(rows, "text", "fp").select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "fp",
        "next_fp",
        F.concat(
            F.substring(F.col("text"), F.lit(1), (n - cut).cast("int")),
            F.substring(F.col("next_text"), F.lit(1), cut),
        ).alias("edited"),
    )
    return (
        merkle_tree(edited, F.col("edited"), "tree")
        .select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", fingerprint("tree").alias("efp"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            F.col("fp").alias("fingerprint"),
            F.col("efp").alias("edited_fingerprint"),
            likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
            likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        )
    )


def op1_merkle_fingerprints(spark, sf_dir):
    return edits(table(spark, sf_dir, "documents"))
