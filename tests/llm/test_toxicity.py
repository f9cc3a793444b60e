"""Toxicity by its grammar: pairs of texts that differ by a negation, a report or a target only."""

import random

import pytest

from mdmill.llm import toxicity
from mdmill.llm.toxicity import Grammar, Transducer, negation_machine, report_machine, target_machine

NOTHING = Transducer("", {})
WORDS = "table river stone green walk window letter number garden simple paper silver music".split()


def corpus():
    """Toxic texts insult; clean ones hold the same words as often, negated or told of others."""
    rnd = random.Random(5)
    said = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    rows = []
    for i in range(240):
        insult = rnd.choice(["zorgle", "blatherer", "quimp"])
        if i % 2:
            text = rnd.choice([f"you {insult}", f"that {insult}", f"what a {insult} you are"])
        else:
            text = rnd.choice([f"that is not a {insult}", f"he said {insult} yesterday", f"she never was a {insult}"])
        rows.append((i, f"{said(rnd.randrange(3, 20))}. {text}. {said(rnd.randrange(3, 20))}", i % 2))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    return toxicity.fit(docs, labels)


def test_words_that_clean_texts_only_negate_or_report_are_learned(model):
    lexicon, cut = model
    assert {w for w in ("zorgle", "blatherer", "quimp") if any(w.startswith(f.rstrip("*")) for f in lexicon)} == {"zorgle", "blatherer", "quimp"}
    assert not any(w.startswith(f.rstrip("*")) for w in WORDS for f in lexicon) and 0 < cut < 10


def predicted(model, text, machine=None):
    lexicon, cut = model
    return Grammar(lexicon, machine).document(text) >= cut


@pytest.mark.parametrize(
    "mean, mild, without",
    [
        ("green stone. that is a zorgle. music", "green stone. that is not a zorgle. music", target_machine().compose(report_machine())),
        ("paper. he read blatherer aloud", "paper. he said blatherer aloud", negation_machine().compose(target_machine())),
        ("du bist quimp", "du bist nicht quimp", target_machine().compose(report_machine())),
    ],
)
def test_a_prediction_falls_when_its_machine_is_taken_out(model, mean, mild, without):
    whole = negation_machine().compose(target_machine()).compose(report_machine())
    assert predicted(model, mean, whole) and not predicted(model, mild, whole)
    assert predicted(model, mean, without) and predicted(model, mild, without)


def test_an_aimed_threat_counts_and_a_bare_one_does_not():
    alone = Grammar({}, NOTHING).document("kill")
    assert Grammar({}).document("kill") == pytest.approx(0.2 * alone) and Grammar({}).document("you kill") == alone
    cut = (Grammar({}).document("kill") + alone) / 2
    assert Grammar({}).document("we will kill you, kill") < cut <= Grammar({}).document("you will kill")
    assert Grammar({}, NOTHING).document("a kill") >= cut


def test_scores_equal_a_plain_reading_of_clauses(model):
    """Each clause by hand: what stands within three words behind a negation halves, reports and targets hold to the end of the clause."""
    import re

    lexicon, _ = model
    grammar = Grammar(lexicon)
    rnd = random.Random(3)
    pool = [*WORDS, "zorgle", "quimp", "kill", "you", "not", "said", "never", "he"]
    for _ in range(300):
        text = "".join(rnd.choice(pool) + rnd.choice([" ", " ", " ", ". ", ", "]) for _ in range(rnd.randrange(1, 40)))
        total = 0.0
        for clause in re.split(r"[.,]", text):
            since, aimed, told = 99, False, False
            for w in clause.split():
                kind, weight, times = grammar.read(w)
                since += 1
                if kind == "negation":
                    since = 0
                elif kind in ("insult", "threat"):
                    factor = (0.5 if since <= 3 else 1.0) * (0.56 if told else 1.0)
                    factor *= (1.25 if aimed else 1.0) if kind == "insult" else (1.0 if aimed else 0.2)
                    total += weight * factor / times if times == 1 else weight * factor / times / toxicity.stretch(text)
                aimed, told = aimed or kind == "target", told or kind == "report"
        assert grammar.document(text) == pytest.approx(total)


def test_empty_documents_and_ties(spark, model):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, model).count() == 0
    docs = spark.createDataFrame([(1, "you zorgle"), (1, "you zorgle"), (2, "you zorgle"), (None, None), (3, "")], "doc_id long, text string")
    rows = toxicity.score(docs, model).collect()
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1 and len(rows) == 5
    assert all(r["predicted"] == 0 and 0 <= r["score"] <= 1 for r in rows if r["doc_id"] in (None, 3))
