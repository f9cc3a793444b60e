"""Merkle descent and likeness against plain computations."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from mdmill.llm import fingerprints
from mdmill.llm.fingerprints import fingerprint, likeness, merkle_tree, with_edited_ranges

ENDS = re.compile(r"(?<=[.!?]) |(?<=[。！？；，、])|(?<=\S{10}) ")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def leaves(line):
    out, at = [], 0
    for m in ENDS.finditer(line):
        out.append(line[at : m.start()])
        at = m.end()
    return [*out, line[at:]]


def tree(text):
    """(root, [(section digest, [paragraph digest])], leaf digests)."""
    lines = [[sha(x) for x in leaves(line)] for line in text.split("\n")]
    digests = [sha(" ".join(x)) for x in lines]
    sections = [[]]
    for d in digests:
        sections[-1].append(d)
        if d[0] in "01":
            sections.append([])
    # A digest that ends a section is followed by a border, also at the end of the text.
    named = [(sha("".join(d if d[0] in "01" else d + " " for d in s)), s) for s in sections]
    return sha(" ".join(n for n, _ in named)), named, [x for line in lines for x in line]


def ranges(a, b):
    (ra, sa, _), (rb, sb, _) = tree(a), tree(b)
    if ra == rb:
        return []
    old = {d for n, s in sa if n not in {m for m, _ in sb} for d in s}
    found, i = [], 0
    for n, s in sb:
        for d in s:
            if n not in {m for m, _ in sa} and d not in old:
                found.append(i)
            i += 1
    out = []
    for i in found:
        if out and out[-1][1] == i - 1:
            out[-1] = (out[-1][0], i)
        else:
            out.append((i, i))
    return out


def near(a, b):
    if a == b:
        return 1.0
    x, y = ({h[:8] for h in tree(t)[2]} for t in (a, b))
    return len(x & y) / len(x | y)


def edited(rnd, lines):
    out = list(lines)
    for _ in range(rnd.randrange(0, 5)):
        i = rnd.randrange(len(out))
        kind = rnd.randrange(4)
        if kind == 0:
            out[i] = out[i] + " more."
        elif kind == 1:
            out.insert(i, f"new {rnd.random()}. line")
        elif kind == 2 and len(out) > 1:
            del out[i]
        else:
            out[i : i + 3] = out[i : i + 3][::-1]
    return out


def test_trees_ranges_and_likeness_on_random_edits(spark):
    rnd = random.Random(6)
    pairs = [("", ""), ("", "a"), ("a\n", "a"), ("x", "x\nx"), ("一。二，三。四", "一。二，三。五"), ("one. two. three", "one. two. 3")]
    for n in (1, 4, 30, 200):
        for _ in range(12):
            lines = [" ".join(rnd.choice(["extraordinary", "word", "stop.", "句。子", "x"]) for _ in range(rnd.randrange(0, 12))) + str(rnd.randrange(n)) for _ in range(n)]
            pairs.append(("\n".join(lines), "\n".join(edited(rnd, lines))))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    df = merkle_tree(merkle_tree(df, F.col("a"), "t"), F.col("b"), "u").withColumns({"f": fingerprint("t"), "g": fingerprint("u")})
    df = with_edited_ranges(with_edited_ranges(df, "t", "u", "new"), "u", "t", "gone")
    for r in df.select("i", "t", "f", "new", "gone", likeness(F.col("f"), F.col("g")).alias("near")).collect():
        a, b = pairs[r["i"]]
        assert r["t"]["leaves"] == tree(a)[2] and r["f"].split(":")[0] == tree(a)[0]
        assert [tuple(x) for x in r["new"]] == ranges(a, b), (a, b)
        assert [tuple(x) for x in r["gone"]] == ranges(b, a)
        assert abs(r["near"] - near(a, b)) < 1e-12


def test_likeness_in_the_query(spark, tmp_path):
    rnd = random.Random(8)
    cjk = lambda: "。".join("".join(rnd.choice("天地玄黄宇宙洪荒日月盈昃") for _ in range(12)) for _ in range(40)) + "。"
    bare = lambda: " ".join(rnd.choice(["understanding", "of", "extraordinarily", "long", "sentences", "considerations", "without", "stops"]) + str(rnd.randrange(99)) for _ in range(300))
    texts = [cjk(), cjk(), bare(), bare(), "short", "", None, "One. Two. Three. Four. " * 30]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in fingerprints.op1_merkle_fingerprints(spark, str(tmp_path)).collect()}
    whole = [t or "" for t in texts]
    for i, t in enumerate(whole):
        nxt, cut = whole[(i + 1) % len(whole)], len(t) // 4
        assert abs(rows[i]["near_edited"] - near(t, t[: len(t) - cut] + nxt[:cut])) < 1e-12
        assert abs(rows[i]["near_next"] - near(t, nxt)) < 1e-12
    assert min(rows[i]["near_edited"] for i in range(4)) > 0.4
