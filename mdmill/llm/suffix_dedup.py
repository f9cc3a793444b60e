"""Removal of long repeated byte strings with run-length suffix indexes."""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdmill.llm.common import in_arrow, maybe_in, membership_bitmap, text_of
from mdmill.llm.shingles import mix
from mdmill.session import save, table

#: Bytes of a repeated string, and of the anchors by which repeats are found.
LENGTH, ANCHOR = 100, 32
#: Windows of LENGTH bytes around an anchor reach so far on either side.
REACH = LENGTH - ANCHOR
#: Bits of the bitmap of repeated anchors: 16 MB, whatever the input.
ANCHOR_BITS = 1 << 27
#: An anchor is hot above so many places, whatever the total; hot ones are told by a bitmap of HOT_BITS bits (2 MB).
HOT_PLACES, HOT_BITS = 20_000, 1 << 24
#: Bytes that are hashed together, and bytes of snippets that one index holds (or one anchor's).
BLOCK_BYTES, INDEX_BYTES = 1 << 20, 1 << 20
#: Places that are worked on together, so that their numbers stay in a core's cache.
STRIDE = 1 << 14

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTER = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)


@functools.cache
def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hashed:
    """Polynomial hashes of any stretch of some bytes, from one running sum."""

    def __init__(self, data: bytes):
        text = np.frombuffer(data, np.uint8)
        self.sums = np.zeros(len(text) + 1, np.uint64)
        powers = _powers(_BASE, BLOCK_BYTES + 1)
        for a in range(0, len(text), STRIDE):
            part = text[a : a + STRIDE]
            term = _LETTER[part] * powers[a : a + len(part)]
            term[:1] += self.sums[a : a + 1]
            np.cumsum(term, out=self.sums[a + 1 : a + 1 + len(part)])
        self.unshift = _powers(_INVERSE, BLOCK_BYTES + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.unshift[start] + (end - start).astype(np.uint64))


def anchors(texts: list[bytes]):
    """(hashed, anchor hashes, places, first windows, last windows, text starts) of the joined texts.

    The anchor of a window of LENGTH bytes of one text is the ANCHOR-byte string
    with the least hash in it (the first of equal ones), so equal windows have
    equal anchors at equal places. The windows of an anchor at one place follow
    one another. Texts under LENGTH bytes have none.
    """
    lengths = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    hashed = Hashed(b"".join(texts))
    n = int(starts[-1])
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return hashed, np.zeros(0, np.uint64), none, none, none, starts
    whole = np.ones(n, bool)  # does a window of one text start here?
    for end, length in zip(starts[1:], lengths):
        whole[end - min(length, LENGTH - 1) : end] = False
    windows, anchor = [none], [none]
    sums, unshift, bits = hashed.sums, hashed.unshift, np.uint64(24)
    for a in range(0, n - LENGTH + 1, STRIDE):
        count = min(STRIDE, n - LENGTH + 1 - a)
        e = a + count + REACH
        h = mix((sums[a + ANCHOR : e + ANCHOR] - sums[a:e]) * unshift[a:e] + np.uint64(ANCHOR))
        wide, span = h >> bits << bits, 1
        wide |= np.arange(a, e, dtype=np.uint64)  # blocks of long texts stay under 2^24 bytes
        while span * 2 <= REACH + 1:
            wide, span = np.minimum(wide[:-span], wide[span:]), span * 2
        least = np.minimum(wide[:count], wide[REACH + 1 - span :][:count])
        held = np.flatnonzero(whole[a : a + count])
        place = (least[held] & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1) != 0)
        anchor.append(place[first])
        windows.append(np.stack([held[first], held[np.concatenate([first[1:], [len(held)]]) - 1]], axis=1).ravel() + a if len(held) else none)
    places, edges = np.concatenate(anchor), np.concatenate(windows).reshape(-1, 2)
    if not len(places):
        return hashed, np.zeros(0, np.uint64), none, none, none, starts
    first = np.flatnonzero(np.diff(places, prepend=-1) != 0)  # an anchor's windows may lie in two strides
    last = np.concatenate([first[1:], [len(places)]]) - 1
    places = places[first]
    return hashed, hashed.of(places, places + ANCHOR), places, edges[first, 0], edges[last, 1], starts


def anchored(batch):
    """(rows, starts in text, ends in text, offsets, anchors, hashed, data) of a record batch (id, text), in blocks.

    A snippet is the text of the windows of an anchor at one place, so every
    window lies in one snippet. A text longer than a block is cut into blocks
    that overlap; each block tells the snippets that end before its edges.
    """
    texts = [(v.as_py() or "").encode() for v in batch.column(1)]
    block, size = [], 0
    for row, text in enumerate(texts):
        if len(text) > BLOCK_BYTES:
            step = BLOCK_BYTES - 4 * LENGTH
            for base in range(0, max(1, len(text) - 4 * LENGTH), step):
                yield _block([(row, base, text[base : base + BLOCK_BYTES], len(text))])
            continue
        if block and size + len(text) > BLOCK_BYTES:
            yield _block(block)
            block, size = [], 0
        block.append((row, 0, text, len(text)))
        size += len(text)
    if block:
        yield _block(block)


def _block(parts):
    data = [p[2] for p in parts]
    hashed, keys, places, first, last, starts = anchors(data)
    of = np.searchsorted(starts, places, side="right") - 1
    base = np.array([p[1] for p in parts], np.int64)[of]
    whole = np.array([p[3] for p in parts], np.int64)[of]
    offset = starts[of]
    shift = offset - base  # from a place in the text to one in the block
    pos, start, end = places - shift, first - shift, last - shift + LENGTH
    inside = ((start > base) | (base == 0)) & ((end < base + starts[of + 1] - offset) | (end == whole))
    rows = np.array([p[0] for p in parts], np.int64)[of]
    return rows[inside], start[inside], end[inside], pos[inside], shift[inside], keys[inside], hashed, b"".join(data)


def _by_id(ids, rows: np.ndarray):
    return ids.take(pa.array(rows, pa.int64()))


def anchor_counts(texts: DataFrame) -> DataFrame:
    """(anchor, n): at how many places of all texts an anchor stands; a task sums a block before it sends it."""

    def count_anchors(batches):
        for batch in batches:
            for *_, keys, _, _ in anchored(batch):
                held, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(n.astype(np.int32))], names=["anchor", "n"])

    counts = in_arrow(texts, count_anchors, "anchor long, n int")
    return counts.groupBy("anchor").agg(F.sum("n").alias("n"))


def _bitmap_bytes(keys: DataFrame, column: str, bits: int = ANCHOR_BITS) -> np.ndarray:
    """The bitmap of a long column as bytes; so many bits, whatever the input."""
    slot = F.pmod(F.col(column), F.lit(bits)) + 1
    rows = (
        keys.groupBy(F.bitmap_bucket_number(slot).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
        .collect()
    )
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for r in rows:
        out[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def places(texts: DataFrame, bits, hot, with_text) -> DataFrame:
    """The places of maybe repeated anchors: (anchor, snippet, doc, start, size), with the snippet's bytes if asked.

    snippet is a hash of the snippet's text and of the anchor's place in it.
    Hot anchors come as their windows. With with_text, a bitmap
    over (anchor, snippet), only snippets maybe in it come, the first of each
    task's block.
    """

    def find_places(batches):
        shared, heavy = bits.value, hot.value
        wanted = with_text.value if with_text else None
        for batch in batches:
            for rows, start, end, pos, shift, keys, hashed, data in anchored(batch):
                keep = _in_bitmap(shared, keys)
                if len(heavy):
                    heated = keep & _in_bitmap(heavy, keys)
                    keep &= ~heated
                    if wanted is None and heated.any():
                        columns = _hot_windows(batch.column(0), hashed, *(x[heated] for x in (rows, start, end, shift)))
                        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "snippet", "doc", "start", "size"])
                rows, start, end, pos, shift, keys = (x[keep] for x in (rows, start, end, pos, shift, keys))
                snippet = hashed.of(start + shift, end + shift) ^ mix((pos - start).astype(np.uint64) + np.uint64(99))
                columns = [pa.array(keys.view(np.int64)), pa.array(snippet.view(np.int64)), None, pa.array(start), pa.array((end - start).astype(np.int32))]
                names = ["anchor", "snippet", "doc", "start", "size"]
                if wanted is not None:
                    held = np.flatnonzero(_in_bitmap(wanted, mix(keys ^ mix(snippet))))
                    _, first = np.unique(np.stack([keys[held], snippet[held]]), axis=1, return_index=True) if len(held) else (0, held)
                    held = held[first]
                    pick = pa.array(held, pa.int64())
                    columns = [c.take(pick) if c is not None else c for c in columns]
                    rows = rows[held]
                    columns.append(pa.array([data[a:b] for a, b in zip((start + shift)[held], (end + shift)[held])], pa.binary()))
                    names.append("bytes")
                columns[2] = _by_id(batch.column(0), rows)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"anchor long, snippet long, doc {kind}, start long, size int"
    return in_arrow(texts, find_places, schema + (", bytes binary" if with_text else ""))


def _hot_windows(ids, hashed, rows, start, end, shift):
    """Every window around the hot places of a block, once, as rows of `places`: a hot group is split into its windows.

    A window stands as an anchor of its own with one snippet, so grouping alone settles it.
    """
    n = end - start - LENGTH + 1
    of = np.repeat(np.arange(len(n)), n)
    at = start[of] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    _, first = np.unique(at + shift[of], return_index=True)
    of, at = of[first], at[first]
    window = hashed.of(at + shift[of], at + shift[of] + LENGTH)
    own = mix(window ^ np.uint64(0xC2B2AE3D27D4EB4F))
    return [
        pa.array(own.view(np.int64)), pa.array(window.view(np.int64)), _by_id(ids, rows[of]), pa.array(at), pa.array(np.full(len(at), LENGTH, np.int32))
    ]


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of some strings, with text places sampled at both ends of its runs.

    text holds the strings as letters, each string followed by a letter of its
    own that no pattern has.
    """

    def __init__(self, text: np.ndarray):
        self.text = text
        suffixes = self._sorted_suffixes()
        before = text[suffixes - 1]
        self.start = np.flatnonzero(np.diff(before, prepend=-1))
        end = np.concatenate([self.start[1:], [len(before)]])
        self.letter = before[self.start]
        self.first_place, self.last_place = suffixes[self.start], suffixes[end - 1]
        self.size = end - self.start
        # Runs by letter: where a run's rows go when its letter is put before them, and the next run of a letter.
        self.by_letter = np.argsort(self.letter, kind="stable")
        self.target = np.empty(len(self.start), np.int64)
        self.target[self.by_letter] = np.cumsum(self.size[self.by_letter]) - self.size[self.by_letter]
        self.keys = self.letter[self.by_letter] * len(self.start) + self.by_letter

    def _sorted_suffixes(self) -> np.ndarray:
        """Prefix doubling: ranks by the first letters, two or three spans at once as they fit 63 bits."""
        rank = self.text
        span, n = 1, len(rank)
        while True:
            letters = int(rank.max()) + 2
            parts = min(4, int(62 / math.log2(letters + 1)))
            key = rank + 1
            for i in range(1, parts):
                key = key * letters + np.concatenate([rank[i * span :] + 1, np.zeros(min(i * span, n), np.int64)])[:n]
            found, rank = np.unique(key, return_inverse=True)
            span *= parts
            if len(found) == n or span >= n:
                return np.argsort(rank)

    def _common(self, place: np.ndarray, pattern: np.ndarray, at: np.ndarray, cap: np.ndarray) -> np.ndarray:
        """How many letters of the text from place and of the pattern from at are the same, cap at most."""
        out = np.zeros(len(place), np.int64)
        for low, high in ((0, 8), (8, 1 << 62)):
            some = np.flatnonzero((cap > low) & (cap <= high))
            if len(some):
                steps = np.arange(int(cap[some].max()))
                a = np.minimum(place[some, None] + steps, len(self.text) - 1)
                b = np.minimum(at[some, None] + steps, len(pattern) - 1)
                differs = (self.text[a] != pattern[b]) | (steps >= cap[some, None])
                out[some] = np.where(differs.any(axis=1), differs.argmax(axis=1), cap[some])
        return out

    def matching_statistics(self, pattern: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int = 0) -> np.ndarray:
        """For each letter of the patterns, how far the text holds what starts there (up to its pattern's end).

        Matches under `least` letters need not be told: a pattern leaves when no
        longer one can follow.

        All patterns stream through together, from their last letter to their
        first. While a row's run has the wanted letter the match grows; else it
        breaks off and goes on at the end of the run of that letter above or the
        start of the one below, whose sampled place tells how much of it is left.
        """
        found = np.zeros(len(pattern), np.int64)
        live = np.arange(len(lengths))
        row, place, length = (np.zeros(len(live), np.int64) for _ in range(3))
        for step in range(1, int(lengths.max(initial=0)) + 1):
            left = lengths[live] - step
            stays = (left >= 0) & (length + left + 1 >= least)
            if not stays.all():
                live, row, place, length, left = live[stays], row[stays], place[stays], length[stays], left[stays]
            if not len(live):
                break
            at = starts[live] + left
            letter = pattern[at]
            run = np.searchsorted(self.start, row, side="right") - 1
            breaks = np.flatnonzero((self.letter[run] != letter) | (length == 0))
            grown_row, grown_place, grown = self.target[run] + row - self.start[run], place - 1, length + 1
            if len(breaks):
                want, cap = letter[breaks], length[breaks]
                k = np.searchsorted(self.keys, want * len(self.start) + run[breaks])
                best_row, best_place, best = np.zeros(len(breaks), np.int64), np.zeros(len(breaks), np.int64), np.zeros(len(breaks), np.int64)
                for side in (0, 1):  # the run above, the run below
                    of = self.by_letter[np.clip(k - 1 + side, 0, len(self.start) - 1)]
                    there = np.flatnonzero((self.letter[of] == want) & (k - 1 + side >= 0) & (k - 1 + side < len(self.start)))
                    of = of[there]
                    sample = self.first_place[of] if side else self.last_place[of]
                    reach = 1 + self._common(sample, pattern, at[breaks[there]] + 1, cap[there])
                    better = reach > best[there]
                    there, of, sample, reach = there[better], of[better], sample[better], reach[better]
                    best[there], best_place[there] = reach, sample - 1
                    best_row[there] = self.target[of] + (0 if side else self.size[of] - 1)
                grown_row[breaks], grown_place[breaks], grown[breaks] = best_row, best_place, best
            row, place, length = grown_row, grown_place, grown
            found[at] = length
        return found


def later_repeats(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each byte of the joined strings: does a window start here that an earlier string of its group holds too?

    The strings of a group stand in order. Groups are halved: the earlier half
    is indexed, the later half streams through it. Strings whose windows are
    all known to repeat leave, since what they repeat stays; the rest of both
    halves are groups of their own. Letters of different groups differ, so one
    index serves all groups of a round.
    """
    repeats = np.zeros(len(data), bool)
    live = np.arange(len(starts))
    while True:
        order = np.argsort(group, kind="stable")
        live, group = live[order], group[order]
        _, first, of, size = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
        keep = size[of] > 1
        if not keep.any():
            return repeats
        place = np.arange(len(live)) - first[of]
        later = place >= (size[of] + 1) // 2
        early, late = live[keep & ~later], live[keep & later]
        text = _letters(data, starts[early], lengths[early], of[keep & ~later], True, len(early))
        pattern = _letters(data, starts[late], lengths[late], of[keep & later], False, len(early))
        at = np.concatenate([[0], np.cumsum(lengths[late])])
        reach = RunIndex(text).matching_statistics(pattern, at[:-1], lengths[late], LENGTH)
        source = np.repeat(starts[late] - at[:-1], lengths[late]) + np.arange(len(pattern))
        repeats[source[reach >= LENGTH]] = True
        windows = np.cumsum(np.concatenate([[0], repeats]))
        open_ = windows[starts + lengths - LENGTH + 1] - windows[starts] < lengths - LENGTH + 1
        group = np.where(later, 2 * of + 1, 2 * of)[keep]
        live = live[keep]
        stays = open_[live] | (group % 2 == 0)
        live, group = live[stays], group[stays]


def _letters(data, starts, lengths, group, ended: bool, ends: int) -> np.ndarray:
    """The strings as letters that differ from group to group, each with an end of its own if asked."""
    more = lengths + ended
    at = np.cumsum(more) - more
    of = np.repeat(np.arange(len(starts)), more)
    place = np.arange(int(more.sum())) - at[of]
    out = ends + group[of] * 256 + data[np.minimum(starts[of] + place, len(data) - 1)]
    if ended:
        out[at + lengths] = np.arange(len(starts))
    return out


def snippet_repeats(snippets: DataFrame) -> DataFrame:
    """(doc, start, size): stretches of the first snippets that repeat an earlier window of another snippet.

    The snippets of an anchor meet in one task; a task indexes whole anchors,
    INDEX_BYTES at a time.
    """
    kind = snippets.schema["doc"].dataType.simpleString()

    def index(group):
        seen = {}
        for anchor, snippet, doc, start, data in group:
            seen.setdefault((anchor, snippet), (doc, start, data))
        held = list(seen.values())
        lengths = np.array([len(x[2]) for x in held])
        starts = np.cumsum(lengths) - lengths
        _, of = np.unique(np.array([a for a, _ in seen], np.int64), return_inverse=True)
        repeats = later_repeats(np.frombuffer(b"".join(x[2] for x in held), np.uint8), starts, lengths, of)
        marked = np.flatnonzero(repeats)
        cut = np.flatnonzero(np.diff(marked, prepend=-2) > 1)
        out = []
        for a, b in zip(marked[cut], marked[np.concatenate([cut[1:], [len(marked)]]) - 1] if len(cut) else ()):
            doc, start, _ = held[np.searchsorted(starts, a, side="right") - 1]
            at = int(np.searchsorted(starts, a, side="right") - 1)
            out.append((doc, int(start + a - starts[at]), int(b - a + LENGTH)))
        return out

    def index_snippets(batches):
        group, size, last, kinds = [], 0, None, None

        def told(rows):
            cols = list(zip(*rows)) if rows else [[], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], kinds), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["doc", "start", "size"]
            )

        for batch in batches:
            kinds = batch.schema.field("doc").type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != last and size >= INDEX_BYTES:
                    yield told(index(group))
                    group, size = [], 0
                last = row[0]
                group.append(row)
                size += len(row[4])
        if group:
            yield told(index(group))

    rows = snippets.select("anchor", "snippet", "doc", "start", "bytes")
    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "doc", "start")
    return in_arrow(dealt, index_snippets, f"doc {kind}, start long, size long")


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """(doc, start, size): byte stretches of docs (doc_id, text) that also start earlier; together they cover all such bytes.

    Equal snippets are settled by a minimum that aggregates before it shuffles:
    all but the first are repeats from end to end. Only anchors with several
    different snippets send their first ones, with text, to an index.
    """
    spark = docs.sparkSession
    counts, _ = save(anchor_counts(docs).where("n > 1"), "anchors")
    heavy = counts.where(F.col("n") > HOT_PLACES)
    hot = spark.sparkContext.broadcast(_bitmap_bytes(heavy, "anchor", HOT_BITS) if not heavy.isEmpty() else np.zeros(0, np.uint8))
    bits = spark.sparkContext.broadcast(_bitmap_bytes(counts, "anchor"))
    found, _ = save(places(docs, bits, hot, None), "places")
    firsts, _ = save(
        found.groupBy("anchor", "snippet").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")), "snippets"
    )
    copies = (
        found.join(firsts.where("n > 1"), ["anchor", "snippet"])
        .where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
        .select("doc", "start", F.col("size").cast("long").alias("size"))
    )
    several = firsts.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = firsts.join(several, "anchor", "left_semi").select("anchor", "snippet")

    def key_of(batches):
        for batch in batches:
            a, s = (np.asarray(batch.column(i)).view(np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(mix(a ^ mix(s)).view(np.int64))], names=["key"])

    wanted_bits = spark.sparkContext.broadcast(_bitmap_bytes(in_arrow(wanted, key_of, "key long"), "key"))
    return copies.unionByName(snippet_repeats(places(docs, bits, hot, wanted_bits)))


def _merged(stretches) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, size in sorted(stretches):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + size)
        else:
            out.append([start, start + size])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), a row for each row of docs.

    A byte goes if a string of LENGTH bytes that covers it also starts earlier:
    in a smaller doc_id, or the same document at an earlier byte. Strings are
    those of the input and never cross documents. A null text counts as empty;
    texts under LENGTH bytes stay whole. Rows with a null id stay whole and
    count for nothing. Ids must be distinct; of rows that repeat an id all are
    one document, so each loses what the other's places repeat. Other columns
    are ignored. kept is the binary rest of the text.
    """
    texts = docs.select("doc_id", text_of().alias("text"))
    stretches, _ = save(repeated_stretches(texts.where("doc_id IS NOT NULL")), "stretches")
    hit = membership_bitmap(stretches.select("doc").distinct(), F.xxhash64("doc"))
    flagged = maybe_in(texts, hit, F.xxhash64("doc_id"), "hit")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            rows = []
            for text, stretch in zip(batch.column(1), batch.column(2)):
                data = text.as_py().encode()
                spans = _merged((x["start"], x["size"]) for x in stretch.as_py() or ())
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    grouped = stretches.groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("stretches"))
    repeating = flagged.where("hit").join(grouped, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "stretches")
    changed = in_arrow(repeating, cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    zero = F.lit(0).cast("long")
    whole = flagged.where("NOT hit").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"),
    )
    out = changed.unionByName(whole)
    return out if keep_bytes else out.drop("kept")


def op7_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
