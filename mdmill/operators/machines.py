"""State machines that apply requests in order: issues, reviews, lifecycles, holds, deliveries, versions.

Requests of one key act one after another, each on what the one before left.
A machine with a few states is a function from state to state; functions of
consecutive requests compose, so a key with very many requests is cut at task
borders: each task composes its part, the parts are chained, and the task
then runs from the state in which its part begins. Machines without a small
set of states (versions of a catalog) keep a key in one task, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mdmill.functions import semantics, text
from mdmill.session import save, worked_out_once

#: A machine's step: (state, request) -> (state after, outcome); it sees a request without its key and place.
Step = Callable[[str, dict], tuple[str, str]]

# The edges of the machines, with what an edge asks for.
ISSUE_EDGES = {
    "OPEN": ("ACKNOWLEDGED", "RESOLVED", "WAIVED"),
    "ACKNOWLEDGED": ("OPEN", "RESOLVED", "WAIVED"),
    "RESOLVED": ("OPEN",),
    "WAIVED": ("OPEN",),
}
CLOSED = ("RESOLVED", "WAIVED")
LIFECYCLE_EDGES = {
    "PENDING": {"REVIEWED": "lifecycle.review", "REJECTED": "lifecycle.review"},
    "REVIEWED": {"APPROVED": "lifecycle.approve", "REJECTED": "lifecycle.approve"},
    "APPROVED": {"ARCHIVED": "lifecycle.approve"},
    "REJECTED": {},
    "ARCHIVED": {},
}
REVIEW_DECISIONS = {"MERGE": ("AUTO_MERGE", 0.95), "NEW": ("NEW", 1.0)}
REVIEW_STATES = ("REVIEW", "APPROVED", "SKIPPED")
APPROVED_DECISIONS = ("AUTO_MERGE", "NEW", "CONFIRMED_NEW")
# End of fixed values.


def _runs(batches: Iterator[pa.RecordBatch], keys: int):
    """(key, request) of each row; the columns are the keys, start, and the request's own."""
    for batch in batches:
        names = batch.schema.names
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            yield row[:keys], row[keys], dict(zip(names[keys + 1 :], row[keys + 1 :]))


def _coded(column: pa.Array) -> tuple[np.ndarray, int]:
    """A number for each value, equal ones alike, and how many there are."""
    try:
        coded = pc.dictionary_encode(column, null_encoding="encode")
    except pa.ArrowNotImplementedError:  # lists and structs
        coded = pc.dictionary_encode(pa.array([repr(v) for v in column.to_pylist()], pa.string()))
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)


def _kinds(columns: list[pa.Array], rows: int) -> tuple[np.ndarray, list[tuple]]:
    """The kind of each row, rows of equal values alike, and the values of each kind."""
    kind, n = np.zeros(rows, np.int64), 1
    for column in columns:
        code, more = _coded(column)
        kind, n = kind * more + code, n * more
        if n > rows:
            seen, kind = np.unique(kind, return_inverse=True)
            n = len(seen)
    _, first, kind = np.unique(kind, return_index=True, return_inverse=True)
    return kind, list(zip(*(c.take(pa.array(first)).to_pylist() for c in columns))) if columns else [()]


def _heads(columns: list[pa.Array], rows: int) -> np.ndarray:
    """Is a row the first, or other in these columns than the row before?"""
    out = np.zeros(rows, bool)
    out[:1] = True
    for column in columns:
        code = _coded(column)[0]
        out[1:] |= code[1:] != code[:-1]
    return out


def apply_in_order(states: DataFrame, requests: DataFrame, keys: list[str], step: Step, alphabet: tuple[str, ...] | None = None, order: str = "seq") -> DataFrame:
    """requests with `before`, `after` and `outcome`: each acts on the state that the one before it left.

    states (*keys, state), requests (*keys, order, ...). Requests are taken by
    `order`, ties by their other columns. A request for a key without a state
    is refused as UNKNOWN and leaves nothing. With an alphabet (all states of
    the machine) a key's requests spread over tasks, see above.
    """
    rest = [c for c in requests.columns if c not in keys]
    known = states.select(*keys, F.col("state").alias("__start"))
    rows = requests.join(known, keys, "left").select(*keys, "__start", *rest)
    schema = StructType([*(requests.schema[c] for c in (*keys, *rest))]).add("before", "string").add("after", "string").add("outcome", "string")
    own = [c for c in rest if c != order]
    in_order = [*keys, order, *own]
    parts = max(1, int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    starts = {}
    if alphabet:
        placed, _ = save(rows.repartitionByRange(parts, *keys, order).sortWithinPartitions(*in_order).withColumn("__part", F.spark_partition_id()), "requests")
        starts = _starts(placed, keys, step, alphabet, order, in_order)
        # Each stored part is one task again.
        met = placed.repartition(parts, "__part").sortWithinPartitions("__part", *in_order)
    else:
        met = rows.withColumn("__part", F.lit(0)).repartition(parts, *keys).sortWithinPartitions(*in_order)

    def run(batches):
        at = state = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keyed, starting, part = batch.columns[: len(keys)], batch.column(len(keys)), batch.column("__part")
            place = lambda i: (part[i].as_py(), tuple(c[i].as_py() for c in keyed))  # noqa: E731, B023
            first, opens = _heads([part, *keyed], n), _heads([part], n)
            first[0] = place(0) != at
            kind, values = _kinds([batch.column(c) for c in own], n)
            known, results, taken = {}, [], []
            for i, (new, opening, k, start) in enumerate(zip(first.tolist(), opens.tolist(), kind.tolist(), starting.to_numpy(zero_copy_only=False).tolist())):
                if new:
                    # Only the first key of a part may have begun in an earlier one.
                    state = starts.get(place(i), start) if opening and starts else start
                came = known.get((state, k))
                if came is None:
                    came = known[state, k] = len(results)
                    results.append((state, *((None, "UNKNOWN") if state is None else step(state, dict(zip(own, values[k]))))))
                taken.append(came)
                state = results[came][1]
            at, taken = place(n - 1), pa.array(taken)
            became = [pa.array(c, pa.string()).take(taken) for c in zip(*results)]
            yield pa.RecordBatch.from_arrays([*keyed, *(batch.column(c) for c in rest), *became], names=schema.names)

    return met.select(*keys, "__start", *rest, "__part").mapInArrow(run, schema)


def _arrow(schema: StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return [f.type for f in to_arrow_schema(schema)]


def _starts(placed: DataFrame, keys: list[str], step: Step, alphabet, order: str, in_order: list[str]) -> dict:
    """The state in which each part begins for a key whose requests began in an earlier part."""
    kinds = _arrow(StructType([placed.schema[k] for k in keys]))
    # Only the first and the last key of a part can lie in other parts too.
    ends = placed.groupBy("__part").agg(F.min(F.struct(*keys)).alias("lo"), F.max(F.struct(*keys)).alias("hi"))
    held = ends.select("__part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("k")).select("__part", "k.*")
    several = held.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    open_keys = {tuple(r) for r in several.collect()}  # fewer than parts
    if not open_keys:
        return {}

    def compose(batches):
        at, start, became = None, None, {}

        def close():
            if at and at[1] in open_keys:
                values = [[v] for v in at[1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at[0]], pa.int32()), *(pa.array(v, k) for v, k in zip(values, kinds)), pa.array([start], pa.string()), pa.array([list(became.values())], pa.list_(pa.string()))],
                    names=["__part", *keys, "start", "became"],
                )

        for key, first, request in _runs(batches, len(keys)):
            part = request.pop("__part")
            if (part, key) != at:
                yield from close()
                at, start, became = (part, key), first, {s: s for s in alphabet}
            if key in open_keys:
                became = {s: step(now, request)[0] for s, now in became.items()}
        yield from close()

    schema = StructType([placed.schema["__part"], *(placed.schema[k] for k in keys)]).add("start", "string")
    rest = [c for c in in_order if c not in keys]
    # Parts of keys that lie in several tasks are all that is composed.
    cut = F.broadcast(several.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))))
    some = placed.join(cut, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], "left_semi")
    composed = some.select(*keys, "__start", *rest, "__part").repartition("__part").sortWithinPartitions("__part", *in_order)
    parts = composed.mapInArrow(compose, StructType.fromDDL(schema.toDDL() + ", became array<string>"))
    found, now = {}, {}
    for r in sorted(parts.collect(), key=lambda r: r["__part"]):  # at most two rows a part
        key = tuple(r[k] for k in keys)
        now.setdefault(key, r["start"])
        found[r["__part"], key] = now[key]
        if now[key] is not None:
            now[key] = dict(zip(alphabet, r["became"])).get(now[key], now[key])
    return found


def final_states(states: DataFrame, applied: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """states after all requests: one row a key, as before them where none was applied."""
    last = applied.where("outcome <> 'UNKNOWN'").groupBy(*keys).agg(F.max_by("after", order).alias("__after"))
    return states.join(last, keys, "left").select(*(F.coalesce("__after", "state").alias("state") if c == "state" else F.col(c) for c in states.columns))


def issue_step(state: str, q: dict) -> tuple[str, str]:
    """q: wanted, resolution, own (plant of who asks), plant_code (of the issue)."""
    if q["own"] not in ("GROUP", q["plant_code"]):
        return state, "OUT_OF_SCOPE"
    if q["wanted"] not in ISSUE_EDGES[state]:
        return state, "NO_SUCH_STEP"
    if q["wanted"] in CLOSED and not (q["resolution"] or "").strip():
        return state, "NO_RESOLUTION"
    return q["wanted"], "DONE"


def lifecycle_step(state: str, q: dict) -> tuple[str, str]:
    """q: wanted, granted (a permission)."""
    if q["wanted"] == state:
        return state, "UNCHANGED"
    if q["wanted"] not in LIFECYCLE_EDGES[state]:
        return state, "NO_SUCH_STEP"
    return (q["wanted"], "DONE") if q["granted"] == LIFECYCLE_EDGES[state][q["wanted"]] else (state, "NOT_PERMITTED")


def review_step(state: str, q: dict) -> tuple[str, str]:
    """q: action, own (plant of who decides), plants (of the review, A,B)."""
    if state != "REVIEW":
        return state, "NOT_FOUND"
    if q["action"] not in ("MERGE", "NEW", "SKIP"):
        return state, "BAD_ACTION"
    if q["own"] != "GROUP" and q["own"] not in (q["plants"] or "").split(","):
        return state, "OUT_OF_SCOPE"
    return ("SKIPPED", "SKIPPED") if q["action"] == "SKIP" else ("APPROVED", "DONE")


def hold_step(state: str, q: dict) -> tuple[str, str]:
    """q: held (true, false or null: left as it is). States HELD and FREE."""
    wanted = state if q["held"] is None else "HELD" if q["held"] else "FREE"
    return wanted, "UNCHANGED" if wanted == state else "OPENED" if wanted == "HELD" else "CLOSED"


def delivery_step(state: str, q: dict) -> tuple[str, str]:
    """q: confirmed, decision (null: no such master), reaches. A delivered task is not sent again; a failed one may be."""
    if state == "SUCCESS":
        return state, "ALREADY_DELIVERED"
    if not q["confirmed"]:
        return state, "NOT_CONFIRMED"
    if q["decision"] is None:
        return "FAILED", "UNKNOWN_CODE"
    if q["decision"] not in APPROVED_DECISIONS:
        return "FAILED", "NOT_APPROVED"
    return ("SUCCESS", "DELIVERED") if q["reaches"] else ("FAILED", "OUT_OF_SCOPE")


def decide_reviews(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (review_id, seq, action, own) on reviews (review_id, mdm_code, plants, state), in order."""
    asked = decisions.join(reviews.select("review_id", "plants"), "review_id", "left")
    return apply_in_order(reviews, asked, ["review_id"], review_step, REVIEW_STATES)


def decided(rows: DataFrame, reviews: DataFrame, applied: DataFrame) -> DataFrame:
    """Masters, batch masters or mappings (mdm_code, decision, ...) with what approved reviews made of them, and `confidence` of that."""
    done = applied.where("outcome = 'DONE'").join(reviews.select("review_id", F.col("mdm_code").alias("__code")), "review_id")
    last = done.groupBy("__code").agg(F.max_by("action", F.struct("seq", "review_id")).alias("__action"))
    value = lambda i: F.create_map(*(F.lit(x) for a, pair in REVIEW_DECISIONS.items() for x in (a, pair[i])))[F.col("__action")]
    return rows.join(last, F.col("mdm_code") == F.col("__code"), "left").withColumns({"decision": F.coalesce(value(0), "decision"), "confidence": value(1)}).drop("__code", "__action")


def minted_masters(lifecycle: DataFrame, applied: DataFrame) -> DataFrame:
    """Master rows of lifecycle requests that an approval gave a code: those without one, or with a provisional NEW- one.

    lifecycle (request_id, name, description, category, brand, model,
    plant_code, mdm_code). The code is the category's prefix and SHA-1 digits of
    category, name and request; attributes are read out of the text, stated
    brand and model stand. Of a code minted twice the last request counts.
    """
    approved = applied.where("outcome = 'DONE' AND after = 'APPROVED'").select("request_id").distinct()
    rows = lifecycle.join(approved, "request_id").where("coalesce(mdm_code, '') = '' OR mdm_code LIKE 'NEW-%'")
    whole = F.concat_ws(" ", text.clean(F.col("name")), text.clean(F.col("description")))
    read = {"brand": text.brand, "model": text.model, "dn": text.dn, "pressure": text.pressure, "material": text.material}
    rows = worked_out_once(rows, {"__whole": whole}, {f"__{c}": of(F.col("__whole")) for c, of in read.items()})
    said = lambda c: F.coalesce(F.nullif(text.clean(F.col(c)), F.lit("")), F.col(f"__{c}"))
    code = semantics.golden_code(F.col("category"), F.concat_ws("|", "category", "name", F.col("request_id").cast("string")))
    brand, model, name = said("brand"), said("model"), text.clean(F.col("name"))
    parts = F.array(brand, model, name, F.when(name.contains(text.clean(F.col("category"))), "").otherwise(F.col("category")))
    made = rows.select(
        code.alias("mdm_code"), F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), " ").alias("standard_name"), "category",
        model.alias("model"), brand.alias("brand"), *(F.col(f"__{c}").alias(c) for c in ("dn", "pressure", "material")),
        F.lit(0).alias("source_count"), F.lit("lifecycle").alias("source_systems"), F.lit("NEW").alias("decision"), F.lit(1.0).alias("confidence"),
        F.regexp_extract(code, "^(.*)-", 1).alias("code_prefix"), "plant_code", "request_id",
    )
    newest = F.max_by(F.struct(*(c for c in made.columns if c != "mdm_code")), "request_id")
    return made.groupBy("mdm_code").agg(newest.alias("m")).select("mdm_code", "m.*")


def hold_intervals(applied: DataFrame, order: str = "seq") -> DataFrame:
    """(batch_id, opened, closed): each hold of a batch by the order of its request, closed null while it lasts."""
    from pyspark.sql import Window

    edge = applied.where("outcome IN ('OPENED', 'CLOSED')")
    after = F.lead(order).over(Window.partitionBy("batch_id").orderBy(order))
    return edge.withColumn("closed", after).where("outcome = 'OPENED'").select("batch_id", F.col(order).alias("opened"), "closed")


def activate_versions(versions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions, events): publish, roll back and validate versions of catalogs, in order.

    versions (catalog, version_id, status), at most one PUBLISHED a catalog;
    requests (catalog, seq, action, target, expected_current): PUBLISH takes a
    VALIDATED version, ROLLBACK a RETIRED or VALIDATED one, VALIDATE a DRAFT or
    VALIDATED one. The published version retires. A request that expects
    another version to be current is refused as CHANGED, one for the current
    version is UNCHANGED. Events are the requests with outcome and `previous`.
    """
    several = versions.where("status = 'PUBLISHED'").groupBy("catalog").agg(F.count("*").alias("n")).where("n > 1")
    if not several.isEmpty():
        raise ValueError("a catalog has more than one published version")
    number = versions.schema["version_id"].dataType.simpleString()
    first = versions.select("catalog", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("action"), F.col("version_id").alias("target"), F.lit(None).cast(number).alias("expected_current"), "status")
    asked = requests.select("catalog", F.lit(1).alias("kind"), F.col("seq").cast("long").alias("seq"), "action", F.col("target").cast(number).alias("target"), F.col("expected_current").cast(number).alias("expected_current"), F.lit(None).cast("string").alias("status"))
    met = first.unionByName(asked).repartition("catalog").sortWithinPartitions("catalog", "kind", "seq", "target")
    schema = StructType([*met.schema.fields]).add("outcome", "string").add("previous", versions.schema["version_id"].dataType)
    kinds = _arrow(schema)
    takes = {"PUBLISH": ("VALIDATED",), "ROLLBACK": ("RETIRED", "VALIDATED"), "VALIDATE": ("DRAFT", "VALIDATED")}

    def act(of: dict, current, q: dict) -> tuple[str, object]:
        """The outcome, and the version that is current after it; `of` holds the catalog's statuses."""
        status, publishes = of.get(q["target"]), q["action"] != "VALIDATE"
        if status is None or q["action"] not in takes:
            return "UNKNOWN", current
        if publishes and q["expected_current"] is not None and q["expected_current"] != current:
            return "CHANGED", current
        if publishes and q["target"] == current:
            return "UNCHANGED", current
        if status not in takes[q["action"]]:
            return "REFUSED", current
        if not publishes:
            of[q["target"]] = "VALIDATED"
            return "VALIDATED", current
        if current is not None:
            of[current] = "RETIRED"
        of[q["target"]] = "PUBLISHED"
        return "PUBLISHED" if q["action"] == "PUBLISH" else "ROLLED_BACK", q["target"]

    def run(batches):
        catalog, of, current = object(), {}, None

        def rows(some):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some) if some else [()] * len(kinds), kinds)], names=schema.names)

        def close():
            return rows([(catalog, 0, 0, None, v, None, status, None, None) for v, status in of.items()])

        for batch in batches:
            out = []
            for q in batch.to_pylist():
                if q["catalog"] != catalog:
                    if of:
                        yield close()
                    catalog, of, current = q["catalog"], {}, None
                if q["kind"] == 0:
                    of[q["target"]] = q["status"]
                    current = q["target"] if q["status"] == "PUBLISHED" else current
                else:
                    previous = current
                    outcome, current = act(of, current, q)
                    out.append((*q.values(), outcome, previous))
            if out:
                yield rows(out)
        if of:
            yield close()

    after, _ = save(met.mapInArrow(run, schema), "versions")
    return (
        after.where("kind = 0").select("catalog", F.col("target").alias("version_id"), "status"),
        after.where("kind = 1").select("catalog", "seq", "action", "target", "expected_current", "outcome", "previous"),
    )


def active_versions(versions: DataFrame) -> DataFrame:
    """(catalog, version_id): the published version of each catalog."""
    return versions.where("status = 'PUBLISHED'").select("catalog", "version_id")


def searchable(versions: DataFrame, asked: DataFrame, allow_unpublished: Column | bool = False) -> DataFrame:
    """asked (catalog, wanted) with version_id and refusal: the version wanted, or the active one where none is.

    A wanted version that is not published is refused as NOT_PUBLISHED unless allowed, one that is not in the catalog as NOT_FOUND.
    """
    allow = F.lit(allow_unpublished) if isinstance(allow_unpublished, bool) else allow_unpublished
    named = versions.select(F.col("catalog").alias("__c"), F.col("version_id").alias("__v"), F.col("status").alias("__s"))
    active = active_versions(versions).select(F.col("catalog").alias("__a"), F.col("version_id").alias("__active"))
    met = asked.join(named, (F.col("catalog") == F.col("__c")) & (F.col("wanted") == F.col("__v")), "left").join(active, F.col("catalog") == F.col("__a"), "left")
    refusal = F.when(F.coalesce("wanted", "__active").isNull() | (F.col("wanted").isNotNull() & F.col("__v").isNull()), "NOT_FOUND").when(F.col("wanted").isNotNull() & (F.col("__s") != "PUBLISHED") & ~allow, "NOT_PUBLISHED")
    return met.withColumn("refusal", refusal).select(*asked.columns, F.when(refusal.isNull(), F.coalesce("wanted", "__active")).alias("version_id"), "refusal")
