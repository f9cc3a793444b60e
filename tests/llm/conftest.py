"""A small table with nulls, ties, repeats, odd and long texts, and columns whose names operators use themselves."""

import random

import pytest

ODD_SCHEMA = "doc_id long, text string, rank int, n int, fp string, runs string, score string, component_id int, `a.b` int"


def odd_texts():
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(1, 6))) for _ in range(120)]
    said = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    base = said(200).split()
    near = []
    for i in range(12):
        w = list(base)
        w[rnd.randrange(200)] = f"x{i}"
        near.append(" ".join(w))
    repeated = said(7) + " " + " ".join([said(5)] * 9) + " end"
    odd = [None, "", " \n\t", "one", "A b", "a  b\x0bC", "日本 語 日本 語 " * 30, "😀 x-1 X_Y é\x85ü", "zz " * 500, said(9000)]
    return [" ".join(base), " ".join(base).upper(), *near, *odd, repeated, repeated, *(said(rnd.randint(1, 90)) for _ in range(40))]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i * 3 + 1, t, 1, 2, "f", "r", "s", 4, 5) for i, t in enumerate(odd_texts())]
    rows += [rows[5], rows[5], (None, "no id " * 40, 1, 2, "f", "r", "s", 4, 5), (None,) * 9]
    return spark.createDataFrame(rows, ODD_SCHEMA).repartition(3).cache()
