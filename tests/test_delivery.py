"""Ranking of masters against a comparison of all pairs."""

import random
from decimal import ROUND_HALF_UP, Decimal
from difflib import SequenceMatcher

import pytest

from mdmill.operators import delivery, likeness


def half_up(x):
    return float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def alike(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.92
    x, y = set(a) - {" "}, set(b) - {" "}
    jaccard = len(x & y) / len(x | y) if x | y else 1.0
    return half_up(min(0.9, jaccard * 0.55 + SequenceMatcher(None, a, b).ratio() * 0.45))


def brute(intents, masters, weights, k):
    out = {}
    for i, plants, text, *fields in intents:
        found = []
        query = " ".join([text, *filter(None, fields)])
        for row, codes, approved, *has in masters:
            if not approved or not (set(plants) & set(codes) or "GROUP" in codes):
                continue
            scores = [(alike(f, h), w) for f, h, w in zip(fields, has, weights) if f]
            given = [alike(f, h) for f, h in list(zip(fields, has))[:3] if f]
            scores.append((alike(query, has[2]), 0.10 if scores else 0.35))
            total = half_up(min(0.99, sum(s * w for s, w in scores) / sum(w for _, w in scores)))
            if total >= 0.30:
                found.append((-total, row, bool(given) and all(s >= 0.86 for s in given)))
        out[i] = [(row, -s, exact) for s, row, exact in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("k, category", [(3, False), (20, True)])
def test_ranking_is_that_of_all_pairs(spark, monkeypatch, k, category):
    rnd = random.Random(k)
    word = lambda n: "".join(rnd.choice("qwzxjv0189") for _ in range(n))
    brands, models, names = [word(4) for _ in range(8)], [word(6) for _ in range(30)], [f"{word(4)} {word(5)}" for _ in range(40)]
    near = lambda s: s if not s or rnd.random() < 0.3 else s[: rnd.randrange(len(s))] + rnd.choice("qwz") + s[rnd.randrange(len(s)) :]
    cats = ["pump", "valve", ""]
    masters = [(r, rnd.sample(["A", "B", "GROUP"], rnd.randrange(1, 3)), rnd.random() < 0.9, rnd.choice(brands), rnd.choice(models), rnd.choice(names), rnd.choice(cats)) for r in range(300)]
    intents = [
        (i, rnd.sample(["A", "B"], 1), near(rnd.choice(names)), near(rnd.choice(brands)) if i % 3 else "", near(rnd.choice(models)) if i % 2 else "", near(rnd.choice(names)) if i % 5 == 0 else "", rnd.choice(cats) if i % 4 == 0 else "")
        for i in range(60)
    ]
    intents += [(100 + i, *intents[i][1:]) for i in range(20)]
    n = 4 if category else 3
    fields = ["brand", "model", "name", "category"][:n]
    schema = ", ".join(f"{f} string" for f in fields)
    asked = spark.createDataFrame([r[: 3 + n] for r in intents], f"id long, plants array<string>, text string, {schema}")
    rows = spark.createDataFrame([r[: 3 + n] for r in masters], f"row_id long, plant_codes array<string>, approved boolean, {schema}")
    calls, real = [], likeness.ratios
    monkeypatch.setattr(likeness, "ratios", lambda pairs: calls.append(pairs.distinct().count()) or real(pairs))
    got = {}
    result = delivery.rank_masters(asked, rows, k)
    for r in sorted(result.collect(), key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append((r["row_id"], r["similarity"], r["exact"]))
    want = {i: v for i, v in brute([r[: 3 + n] for r in intents], [r[: 3 + n] for r in masters], [0.20, 0.35, 0.30, 0.15], k).items() if v}
    assert got == want
    if k == 3:
        fields_compared = sum(sum(map(bool, r[3 : 3 + n])) + 1 for r in intents) * len(masters)
        assert sum(calls) < 0.05 * fields_compared
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_of_equal_masters_the_first_ones_are_listed(spark, monkeypatch):
    """Ranks over many copies of a master, of several plants, are those of the whole list; no more than k copies of a plant meet the instructions."""
    seen, plain = {}, delivery.save
    monkeypatch.setattr(delivery, "save", lambda df, name="t": seen.setdefault(name, plain(df, name)) if name == "listed" else plain(df, name))
    asked = spark.createDataFrame([(1, "SKF 6310 发往上海厂SAP", ["SHANGHAI"], "SKF", "6310", ""), (2, "SKF 6310 发往北京WMS", ["BEIJING"], "SKF", "6310", "")], "id long, text string, plants array<string>, brand string, model string, name string")
    rows = [(i, "SKF", ("6310", "6311")[i % 2], "SKF bearing", [("SHANGHAI", "BEIJING", "GROUP")[i % 3]], True) for i in range(60)]
    masters = spark.createDataFrame(rows, "row_id long, brand string, model string, name string, plant_codes array<string>, approved boolean")
    few = {tuple(r) for r in delivery.rank_masters(asked, masters, 3).select("id", "row_id", "similarity", "rank").collect()}
    assert seen["listed"][0].count() == 2 * 3 * 3
    seen.clear()
    whole = {tuple(r) for r in delivery.rank_masters(asked, masters, 60).where("rank <= 3").select("id", "row_id", "similarity", "rank").collect()}
    assert few == whole and len(few) == 6
