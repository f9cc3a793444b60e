"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdmill.llm.common import in_arrow, text_of
from mdmill.llm.language import is_held_out
from mdmill.session import save, table

#: Labelled documents of each kind that the lexicon is learned from (about; drawn by hash).
FIT_TOXIC, FIT_CLEAN = 4000, 8000
#: Lengths of the word beginnings that may enter the lexicon, besides whole words.
STEMS = (4, 5, 6, 7)
#: Share of a feature's documents that must be toxic, on the fold that chose it and on the other one, were both
#: kinds alike in number; and in how many toxic documents of a fold it stands: some, and a share of them.
PRECISION, CHECKED_PRECISION, LEAST_DOCS, LEAST_SHARE = 0.97, 0.93, 2, 0.01
#: A weak feature is one that must stand so often in so many words to tell a toxic document.
TIMES, PER_WORDS = (1, 2, 3), 500
#: A stem gives way to a longer feature that is found in nearly as many toxic documents.
SAME_DOCS = 0.95
THRESHOLD = 0.7

# Fixed word lists of the grammar.
THREATS = frozenset("kill hurt destroy burn shoot stab strangle töten umbringen schlagen tuer frapper brûler matar golpear quemar".split())
TARGETS = frozenset("you your he she they him her them his their du dich dir ihr euch er sie tu te toi vous il elle ils elles tú usted vosotros él ella ellos ellas".split())
NEGATIONS = frozenset("not never no nor isn aren wasn weren don doesn nicht kein keine nie niemals ne pas jamais ni nunca jamás".split())
REPORTS = frozenset("said says wrote writes quoted quote claims claimed called reported sagte schrieb zitierte dit écrit cite dijo escribió citó".split())

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:,\n|。！？；：，、．｜｡､]+")

#: Weight of a threat word, and for how many words a negation holds.
THREAT_WEIGHT, NEGATION_REACH = 3.0, 3
CLASSES = ("insult", "threat", "target", "report", "negation", "other")


@dataclass
class Transducer:
    """A weighted machine over word classes: (state, class) -> (state, class, factor); what has no arc passes as it is."""

    start: object
    arcs: dict

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def compose(self, other: Transducer) -> Transducer:
        """The machine that hands its classes on to the other; factors multiply."""
        start, arcs = (self.start, other.start), {}
        found, open_ = {start}, [start]
        while open_:
            state = open_.pop()
            for symbol in CLASSES:
                mine, said, a = self.step(state[0], symbol)
                theirs, out, b = other.step(state[1], said)
                arcs[state, symbol] = ((mine, theirs), out, a * b)
                if (mine, theirs) not in found:
                    found.add((mine, theirs))
                    open_.append((mine, theirs))
        return Transducer(start, arcs)


def negation_machine(factor: float = 0.5) -> Transducer:
    """Insults and threats weigh less within NEGATION_REACH words behind a negation; the state counts them down."""
    arcs = {}
    for left in range(NEGATION_REACH + 1):
        for symbol in CLASSES:
            arcs[left, symbol] = (max(left - 1, 0), symbol, factor if left and symbol in ("insult", "threat") else 1.0)
        arcs[left, "negation"] = (NEGATION_REACH, "negation", 1.0)
    return Transducer(0, arcs)


def target_machine(insult: float = 1.25, threat: float = 0.2) -> Transducer:
    """Behind a target insults weigh more; a threat word without one hardly counts."""
    return Transducer(
        "plain", {("plain", "target"): ("aimed", "target", 1.0), ("plain", "threat"): ("plain", "threat", threat), ("aimed", "insult"): ("aimed", "insult", insult)}
    )


def report_machine(factor: float = 0.56) -> Transducer:
    """What a clause reports of others weighs less."""
    return Transducer(
        "own", {("own", "report"): ("told", "report", 1.0), ("told", "insult"): ("told", "insult", factor), ("told", "threat"): ("told", "threat", factor)}
    )


def features(words: set[str]) -> set[str]:
    """Whole words, and word beginnings marked by a star."""
    return words.union(w[:k] + "*" for w in words for k in STEMS if len(w) > k)


class Grammar:
    """The lexicon (word -> class, weight) composed with the machines for negation, targets and reported speech.

    lexicon: {feature: (weight, times)}. Strong features (times 1) count as
    often as they stand, weak ones by how dense they are in the text.
    """

    def __init__(self, lexicon: dict[str, tuple[float, int]], machine: Transducer | None = None):
        self.words = {w: x for w, x in lexicon.items() if not w.endswith("*")}
        self.stems = {w[:-1]: x for w, x in lexicon.items() if w.endswith("*")}
        self.machine = machine or negation_machine().compose(target_machine()).compose(report_machine())
        self.scan = ahocorasick.Automaton()
        for w in chain(self.words, self.stems, THREATS):
            self.scan.add_word(w, w)
        self.scan.make_automaton()

    def read(self, word: str) -> tuple[str, float, int]:
        """The class of a word, its weight and how often it must stand."""
        if word in NEGATIONS:
            return "negation", 0.0, 1
        found = [self.words[word]] if word in self.words else []
        found += [self.stems[word[:k]] for k in STEMS if len(word) > k and word[:k] in self.stems]
        if found:
            return "insult", *max(found, key=lambda x: x[0] / x[1])
        kind = "threat" if word in THREATS else "target" if word in TARGETS else "report" if word in REPORTS else "other"
        return kind, THREAT_WEIGHT if kind == "threat" else 0.0, 1

    def clause(self, text: str) -> tuple[float, float]:
        """What the strong and the weak words of a clause weigh."""
        state, sums = self.machine.start, [0.0, 0.0]
        for word in _WORD.findall(text):
            kind, weight, times = self.read(word)
            state, _, factor = self.machine.step(state, kind)
            sums[times > 1] += factor * weight / times
        return sums[0], sums[1]

    def meant(self, lower: str) -> list[str]:
        """The words that would count in full as insults: neither negated nor reported."""
        out = []
        for clause in _CLAUSE.split(lower):
            state = self.machine.start
            for word in _WORD.findall(clause):
                if self.machine.step(state, "insult")[2] >= 1.0:
                    out.append(word)
                state = self.machine.step(state, self.read(word)[0])[0]
        return out

    def document(self, text: str) -> float:
        """The sum over the clauses that hold a candidate; texts without one are not cut into words."""
        lower = text.lower()
        strong, weak, start, done, after = 0.0, 0.0, 0, -1, 0
        borders = _CLAUSE.finditer(lower)
        for end, _ in self.scan.iter(lower):
            if end < done:
                continue
            while end >= done:
                border = next(borders, None)
                start, done, after = after, *(border.span() if border else (len(lower), len(lower)))
            a, b = self.clause(lower[start:done])
            strong, weak = strong + a, weak + b
        return strong + weak / stretch(lower)


def stretch(lower: str) -> float:
    """Over how many times PER_WORDS words (cut at blanks) a text goes; 1 at least."""
    return max(1.0, (lower.count(" ") + 1) / PER_WORDS)


def _drawn(labels: DataFrame, toxic: int, rows: int) -> DataFrame:
    """About `rows` labelled ids by hash; all of them where there are fewer."""
    own = labels.where(F.col("toxic") == toxic)
    n = own.count()
    return own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * min(1.0, rows / max(n, 1)))


def fit(docs: DataFrame, labels: DataFrame):
    """(lexicon, cut): insult weights by word or stem, and the raw score from which texts count as toxic.

    Labels count only where the document is not held out. A bounded draw of
    labelled rows is used (FIT_TOXIC and FIT_CLEAN, by a hash of the id); the
    ids are broadcast, 12,000 or so at most. Of texts that share their least
    word hash, as copies do, one counts. Words count where the machines let an
    insult weigh in full: what stands only negated or reported in clean texts
    is no mark of them. A feature is taken with the least of
    TIMES at which it tells toxic documents on either of two folds and still
    does on the other; so chance finds drop out. Rows with a null id or label
    are not learned from, null texts count as empty.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~is_held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = _drawn(known, 1, FIT_TOXIC).union(_drawn(known, 0, FIT_CLEAN))
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), "doc_id").select("toxic", "text")
    texts, _ = save(texts.repartition(24), "labelled")

    def to_features(frames):
        grammar = Grammar({})
        for pdf in frames:
            toxic, key, rows = [], [], []
            for label, text in zip(pdf["toxic"], pdf["text"]):
                lower = text.lower()
                words = _WORD.findall(lower)
                meant = grammar.meant(lower)
                grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
                held = Counter(f for w in meant for f in features({w}))
                times = [max(1, min(TIMES[-1], int(n / stretch(lower)))) for n in held.values()]
                toxic.append(label)
                key.append(int(pd.util.hash_array(np.array(grams, object)).astype(np.int64).min()))
                rows.append([{"feature": f, "times": k} for f, k in zip(held, times)])
            yield pd.DataFrame({"toxic": toxic, "key": key, "features": rows})

    rows = texts.mapInPandas(to_features, "toxic int, key long, features array<struct<feature string, times int>>")
    rows = rows.dropDuplicates(["toxic", "key"]).withColumn("fold", F.pmod(F.xxhash64("key"), F.lit(2)))
    rows, _ = save(rows, "features")
    n = {(r["toxic"], r["fold"]): r["count"] for r in rows.groupBy("toxic", "fold").count().collect()}
    if not all(n.get((1, fold)) for fold in (0, 1)):
        return {}, math.inf
    flat = rows.select("toxic", "fold", F.inline("features"))
    told = lambda toxic, fold, k: F.count_if((F.col("toxic") == toxic) & (F.col("fold") == fold) & (F.col("times") >= k))
    sums = flat.groupBy("feature").agg(
        *(told(toxic, fold, k).alias(f"{name}{fold}{k}") for toxic, name in ((1, "t"), (0, "c")) for fold in (0, 1) for k in TIMES)
    )
    lift = [max(n.get((0, fold), 0) / n[1, fold], 1e-9) for fold in (0, 1)]
    share = lambda fold, k: F.col(f"t{fold}{k}") / (F.col(f"t{fold}{k}") + F.col(f"c{fold}{k}") / lift[fold])
    least = lambda fold: LEAST_DOCS + int(LEAST_SHARE * n[1, fold])

    def tells(k):
        enough = [F.col(f"t{fold}{k}") >= least(fold) for fold in (0, 1)]
        a, b = share(0, k), share(1, k)
        return enough[0] & enough[1] & (F.greatest(a, b) >= PRECISION) & (F.least(a, b) >= CHECKED_PRECISION)

    times = F.coalesce(*(F.when(tells(k), F.lit(k)) for k in TIMES))
    at = lambda name: F.coalesce(*(F.when(F.col("times") == k, F.col(f"{name}0{k}") + F.col(f"{name}1{k}")) for k in TIMES))
    counts = (
        sums.withColumn("times", times)
        .where("times IS NOT NULL")
        .select("feature", "times", at("t").alias("t"), at("c").alias("c"))
        .orderBy(F.desc("t"), "feature")
        .collect()
    )
    longer: dict[str, int] = {}
    for r in counts:
        word = r["feature"].rstrip("*")
        for stem in {word[:k] + "*" for k in STEMS if k <= len(word)} - {r["feature"]}:
            longer[stem] = max(longer.get(stem, 0), r["t"])
    counts = [r for r in counts if longer.get(r["feature"], 0) < SAME_DOCS * r["t"]]
    lexicon: dict[str, tuple[float, int]] = {}
    for r in sorted(counts, key=lambda r: (len(r["feature"].rstrip("*")), r["feature"])):
        word = r["feature"].rstrip("*")
        if not any(word[:k] + "*" in lexicon for k in STEMS if k <= len(word)):
            lexicon[r["feature"]] = (math.log1p(r["t"] / (1.0 + r["c"])), r["times"])
    scored = raw_scores(texts.select(F.col("toxic").alias("doc_id"), "text"), lexicon).toPandas()
    return lexicon, _best_cut(scored["raw"].to_numpy(), scored["doc_id"].to_numpy())


def _best_cut(raw: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the best F1; the middle between the scores on its two sides."""
    best, cut = -1.0, math.inf
    levels = np.unique(raw)
    for below, at in zip(np.concatenate([[0.0], levels]), levels):
        said = raw >= at
        f1 = 2 * (said & (toxic == 1)).sum() / max(1, said.sum() + (toxic == 1).sum())
        if at > 0 and f1 > best + 1e-12:
            best, cut = f1, (below + at) / 2
    return cut


def raw_scores(rows: DataFrame, lexicon: dict[str, tuple[float, int]]) -> DataFrame:
    """(doc_id, raw): the grammar's sum over a text's clauses."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        grammar = Grammar(shared.value)
        for batch in batches:
            raw = [grammar.document(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.float64())], names=["doc_id", "raw"])

    return in_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, raw double")


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score, predicted), a row for each row of docs.

    The score is a logistic curve of the raw sum that passes THRESHOLD at the
    learned cut; predicted is 1 from there on. A text without candidates, empty
    or null scores the least. Equal texts score the same; repeated rows and
    null ids pass through; other columns are ignored. With no toxic label to
    learn from nothing is toxic.
    """
    lexicon, cut = model
    bend = math.log(THRESHOLD / (1 - THRESHOLD))
    raw = raw_scores(docs.select("doc_id", text_of().alias("text")), lexicon)
    if math.isinf(cut):
        return raw.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    curve = 1 / (1 + F.exp(-((F.col("raw") - cut) * (4.0 / cut) + bend + 1e-9)))
    return raw.withColumn("score", curve).select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
