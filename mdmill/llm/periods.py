"""Periodic run detection in word sequences by string synchronising sets.

At each dyadic scale t a hash names every window of t words; a position is
selected if the least name among the t + 1 windows that begin at it and after
it stands at either end. Selection looks at 2 t words only, so equal contexts
are selected alike, and every t positions hold a selected one unless the
text there has a period of at most t / 3. Two selected positions with equal
contexts of 2 t words, 1.5 t to 3 t words apart, propose that distance as a
period. Windows with a period of at most t / 3 have no name: they lie in
regions of smaller periods, which are found first, the smallest ones by
comparing the text with itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from mdmill.llm.common import in_arrow, text_of
from mdmill.llm.shingles import mix
from mdmill.session import table

#: A run has at least so many words, and so many periods.
LEAST_LENGTH, LEAST_PERIODS = 24, 3
#: The first scale; periods under 1.5 times it are found by comparing the text with itself.
FIRST_SCALE = 8
#: Words that are searched together.
BLOCK_WORDS = 1 << 16
RUNS = ArrayType(StructType().add("start", LongType()).add("length", LongType()).add("period", LongType()))
#: Equal contexts lie over t / 3 apart, so so many next ones reach 3 t.
NEXT = 9


def _stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the stretches of at least `least` true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= least
    return begin[long], end[long]


def _sliding_least(names: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row; width is a power of two."""
    step = 1
    while step < width:
        names = np.minimum(names[:-step], names[step:])
        step *= 2
    return names


def selected(names: np.ndarray, plain: np.ndarray, scale: int) -> np.ndarray:
    """The synchronising set: positions at which a least name of `scale` + 1 windows stands at either end; `plain` windows have none."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    named = np.where(plain, none, names)
    short = _sliding_least(named, scale)
    least = np.minimum(short[:-1], short[1:])
    return np.flatnonzero((least != none) & ((least == named[: len(least)]) | (least == named[scale : scale + len(least)])))


def _agree(w: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i and from j on agree, going right (step 1) or left (-1); the compared pieces double."""
    room = len(w) - max(i, j) if step > 0 else min(i, j) + 1
    done, size = 0, 64
    while done < room:
        size = min(size, room - done)
        a, b = (w[i + done : i + done + size], w[j + done : j + done + size]) if step > 0 else (w[i - done - size + 1 : i - done + 1][::-1], w[j - done - size + 1 : j - done + 1][::-1])
        differ = a != b
        if differ.any():
            return done + int(differ.argmax())
        done, size = done + size, size * 2
    return done


def regions(w: np.ndarray, least_periods: int = LEAST_PERIODS) -> dict[tuple[int, int], int]:
    """{(begin, end): smallest period} of all maximal stretches with at least `least_periods` (3 or more) periods, however short."""
    found: dict[tuple[int, int], int] = {}
    small = min(FIRST_SCALE * 3 // 2, len(w) // least_periods + 1)
    for period in range(1, small):
        for a, b in zip(*(x.tolist() for x in _stretches(w[:-period] == w[period:], (least_periods - 1) * period))):
            # A multiple of a region's smallest period has the same stretch.
            found.setdefault((a, b + period), period)
    names = mix(w.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    width, scale = 1, FIRST_SCALE
    while (scale * 3 + 1) // 2 * least_periods <= len(w):
        while width < scale:
            names = mix(names[:-width] * np.uint64(0xD6E8FEB86659FD93) + names[width:])
            width *= 2
        edges = np.zeros(len(names) + 1, np.int64)
        for (a, b), period in found.items():
            if period * 3 <= scale <= b - a:
                edges[a] += 1
                edges[b - scale + 1] -= 1
        plain = np.cumsum(edges[:-1]) > 0
        at = selected(names, plain, scale)
        contexts = mix(names[at] * np.uint64(0xD6E8FEB86659FD93) + names[at + scale])
        order = np.lexsort((at, contexts))
        at, contexts = at[order], contexts[order]
        proposed = set()
        for k in range(1, NEXT + 1):
            apart = at[k:] - at[:-k]
            fit = (contexts[k:] == contexts[:-k]) & (apart * 2 >= scale * 3) & (apart < scale * 3)
            proposed.update(zip(apart[fit].tolist(), at[:-k][fit].tolist()))
        reached: dict[int, int] = {}
        for period, i in sorted(proposed):
            if i < reached.get(period, -1):
                continue
            right = _agree(w, i, i + period, 1)
            left = _agree(w, i - 1, i + period - 1, -1) if i else 0
            reached[period] = i + right
            if left + right >= (least_periods - 1) * period:
                found.setdefault((i - left, i + right + period), period)
        scale *= 2
    return found


def runs_of(w: np.ndarray, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    return sorted((a, b - a, p) for (a, b), p in regions(w, least_periods).items() if b - a >= least_length)


def runs_of_texts(texts: Iterable[list[bytes]], least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> Iterator[list[tuple[int, int, int]]]:
    """The runs of each word list; lists are searched together, each ended by a word of its own that no run can hold."""
    lists = list(texts)
    starts = np.cumsum([0, *(len(x) + 1 for x in lists)])
    number: dict[bytes, int] = {}
    w = np.empty(int(starts[-1]), np.int64)
    for i, words in enumerate(lists):
        w[starts[i] : starts[i + 1] - 1] = [number.setdefault(x, len(number)) for x in words]
        w[starts[i + 1] - 1] = -1 - i
    own: list[list] = [[] for _ in lists]
    for start, length, period in runs_of(w, least_length, least_periods):
        i = int(np.searchsorted(starts, start, side="right")) - 1
        own[i].append((start - int(starts[i]), length, period))
    yield from own


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def _of_blocks(run_row, names: list[str], kinds: list[pa.DataType], least_length: int, least_periods: int):
    """A mapInArrow function over (doc_id, text): run_row(words, runs) gives the columns that follow the id."""

    def run(batches):
        for batch in batches:
            block, first, size = [], 0, 0
            for i in range(batch.num_rows + 1):
                ended = i == batch.num_rows
                words = [] if ended else (batch.column(1)[i].as_py() or "").encode().split()
                if block and (ended or size + len(words) > BLOCK_WORDS):
                    rows = [run_row(x, r) for x, r in zip(block, runs_of_texts(block, least_length, least_periods))]
                    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(block)), *columns], names=["doc_id", *names])
                    block, first, size = [], i, 0
                block.append(words)
                size += len(words)

    return run


def find_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), a row for each row of docs.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text. runs is an array of
    (start, length, period), by start, then period: the stretches of words
    with smallest period `period` and at least `least_length` words and
    `least_periods` (3 or more) periods that no neighbouring word extends.
    collapsed is the text, one space between words, without the words that any
    run holds after its first period.

    Every document is searched in its task, whole, short ones together; nothing
    is shuffled. A text needs some 100 bytes of memory a word. Null and empty
    texts have no words. Repeated rows and null ids give a row each. Other
    columns are ignored.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def row(words, runs):
        return len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(collapsed(words, runs)).decode()

    schema = StructType([docs.schema["doc_id"]]).add("n_words", "long").add("runs", RUNS).add("collapsed", "string")
    run = _of_blocks(row, ["n_words", "runs", "collapsed"], [pa.int64(), kind, pa.string()], least_length, least_periods)
    return in_arrow(docs.select("doc_id", text_of().alias("text")), run, schema)


def collapse(docs: DataFrame, **how) -> DataFrame:
    """docs with periodic runs of words cut down to their first period, in texts that have one; other texts stay as they are."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.select(F.struct(*columns).alias("doc_id"), "text")
    found = find_runs(kept, **how)
    return found.select(*(F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("doc_id.text")).alias(c) if c == "text" else F.col(f"doc_id.`{c}`").alias(c) for c in docs.columns))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by the CRC-32 of the id, the words from one of them on repeat with a period.

    Such texts have one space between words; a null id is never among them.
    """
    crc = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(crc / 10)
    w = F.filter(F.split(text_of(), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    drawn = docs.select("doc_id", "text", F.when(crc % 10 == 0, w).alias("w"), g.alias("g")).withColumns({"n": F.size("w")}).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    drawn = drawn.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    repeated = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1),
        lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")),
    )
    return drawn.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir):
    found = find_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # The greatest length/period first: a cross product tells which of two is greater.
    before = lambda x, y: F.coalesce(
        F.nullif(F.signum(y["length"] * x["period"] - x["length"] * y["period"]).cast("int"), F.lit(0)),
        F.nullif(F.signum(x["start"] - y["start"]).cast("int"), F.lit(0)),
        F.signum(x["period"] - y["period"]).cast("int"),
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = F.try_element_at(F.array_sort("runs", before), F.lit(1))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
