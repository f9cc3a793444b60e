"""Corpus operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from mdmill.llm import bpe, exact_dedup, fingerprints, language, mixing, ngram_join, sharding, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, copies int, bucket string, n int"


def _texts():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    said = lambda k: " ".join(rnd.choice(words) for _ in range(k)) + "."
    base, passage = said(150), said(30)
    near = [base.replace(" ", f" x{i} ", 1) for i in range(5)]
    mid = [said(20) + " " + passage + "\n" + said(20) for _ in range(6)]
    odd = [None, "", " ", "a", "a b c", "é日本 😀", "  \n\n\t", "A  b", "A b", "zz " * 900, "ab" * 400, said(20_000), "<unk> ▁ it's 12 'll"]
    return [base, base, *near, *mid, *odd, *(said(rnd.randint(1, 60)) for _ in range(25)), "A b"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (i, t, None if i % 7 == 0 else ("en", "de")[i % 2], None if i % 5 == 0 else "hot", 1, "s", 2, "b", 3)
        for i, t in enumerate(_texts())
    ]
    rows += [rows[3], (None, "only text without an id " * 9, "en", "hot", 1, "s", 2, "b", 3), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def plain(docs):
    """Rows with distinct non-null ids, as {doc_id: text}."""
    rows = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()
    return {r["doc_id"]: r["text"] or "" for r in sorted(rows, key=lambda r: r["doc_id"])}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def empty(docs):
    return docs.limit(0)


def test_fingerprints(docs, plain, spark):
    rows = by_id(fingerprints.edits(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])))
    ids = list(plain)
    for i, nxt in zip(ids, [*ids[1:], ids[0]]):
        text, cut = plain[i], len(plain[i]) // 4
        edited = text[: len(text) - cut] + plain[nxt][:cut]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i]["n_chars"] == len(text) and 0 <= rows[i]["near_edited"] <= 1
        assert (rows[i]["near_edited"] == 1) == (edited == text) or cut == 0
    assert len({r["fingerprint"] for r in rows.values()}) == len(set(plain.values()))
    assert fingerprints.edits(docs).count() == docs.count()
    assert fingerprints.edits(empty(docs)).count() == 0
    two = spark.createDataFrame([(1, "a. b.\nc d.\ne.")], "doc_id long, text string").withColumn("other", F.lit("a. b.\nc x.\ne."))
    two = fingerprints.merkle_tree(fingerprints.merkle_tree(two, F.col("text"), "t"), F.col("other"), "u")
    assert fingerprints.with_edited_ranges(two, "t", "u", "p").first()["p"] == [(1, 1)]


def test_sharding(docs, plain):
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == docs.count()
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    for r in rows:
        if r["doc_id"] is not None:
            data = plain[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
    assert sharding.shard(empty(docs)).count() == 0


def test_sharding_splits_a_hot_group(spark):
    rows = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text " * 5).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    sizes = [r["b"] for r in sharding.shard(rows, 10).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 10 and max(sizes) < 1.05 * sum(sizes) / 10


def test_exact_dedup(docs, plain):
    rows = by_id(exact_dedup.find_copies(docs, hash_all=True))
    groups = {}
    for r in docs.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), []).append(r["doc_id"])
    for i, text in plain.items():
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", text)
        same = groups[norm]
        keep = min(x for x in same if x is not None)
        assert (rows[i]["keep_id"], rows[i]["group_size"], rows[i]["kept"]) == (keep, len(same), keep == i)
        assert rows[i]["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()
    assert exact_dedup.find_copies(empty(docs)).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == {i for i in plain if rows[i]["kept"]}


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80)])
def test_ngram_join(docs, plain, words, percent):
    sets = {}
    for i, t in plain.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]) and parent[a] != parent[b]:
                    parent[a] = parent[b] = min(parent[a], parent[b])
                    changed = True
    rows = by_id(ngram_join.near_components(docs, words, percent))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in rows.items()} == {i: (len(sets[i]), parent[i]) for i in sets}
    assert ngram_join.near_components(docs, words, percent).count() == docs.count()
    assert ngram_join.near_components(empty(docs)).count() == 0


def test_ngram_join_of_random_edits(spark):
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(60)] = f"e{rnd.randrange(40)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("x").alias("lang"), F.lit("s").alias("source"))
    test_ngram_join(df, dict(rows), 4, 85)


def test_ngram_join_of_repeated_rows(spark):
    said = lambda start, k: " ".join(f"{start}{i}" for i in range(k))
    shared = "one two three four"
    rows = [(1, f"{shared} {said('a', 60)}"), (1, f"{shared} {said('a', 60)}"), (2, f"{shared} {said('b', 60)}"), (None, "x"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.near_components(df, 4, 85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found if r["doc_id"]) == [(1, 1), (1, 1), (2, 2)] and len(found) == 5
    for stage in (exact_dedup.drop_copies, ngram_join.keep_one_of_each):
        assert sorted(str(r["doc_id"]) for r in stage(df).collect()) == ["1", "2", "None", "None"]


def test_mixing(docs, plain, spark):
    assert mixing.mix(empty(docs)).count() == 0
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs, {}).count() == 0
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("source"))
    counts = {r["source"]: r["count"] for r in mixing.mix(many, {"hot": 1.0, "cold": 3.0}).groupBy("source").count().collect()}
    assert abs(counts["hot"] - 1500) < 150 and abs(counts["cold"] - 4500) < 250
    large = spark.range(200).select(mixing.poisson(F.lit(400.0), mixing.hash_unit(F.col("id").cast("string"))).alias("n")).agg(F.avg("n")).first()[0]
    assert abs(large - 400) < 6


def test_bpe(docs, plain):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
    gold = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = by_id(bpe.round_trip(docs))
    for i, text in plain.items():
        ids = gold.encode_ordinary(text)
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert by_id(bpe.decode(bpe.encode(docs)))[5]["text"] == plain[5]
    assert bpe.round_trip(empty(docs)).count() == 0


def test_suffix_dedup(docs, plain):
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows, seen = by_id(suffix_dedup.remove_repeats(unique)), set()
    for i, text in plain.items():
        data, gone = text.encode(), set()
        for p in range(len(data) - 99):
            window = data[p : p + 100]
            if window in seen:
                gone.update(range(p, p + 100))
            seen.add(window)
        kept = bytes(b for k, b in enumerate(data) if k not in gone)
        spans = sum(k - 1 not in gone for k in gone)
        r = rows[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(data), len(gone), spans)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert suffix_dedup.remove_repeats(docs).count() == docs.count()
    assert suffix_dedup.remove_repeats(empty(docs)).count() == 0


def _matches(text: list[str], patterns: list[str]):
    """Matching statistics by brute force."""
    return [max((k for k in range(len(p) - i + 1) if any(p[i : i + k] in t for t in text)), default=0) for p in patterns for i in range(len(p))]


def test_run_index_matching_statistics():
    rnd = random.Random(2)
    for _ in range(60):
        said = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 30)))
        text, patterns = [said() for _ in range(rnd.randint(1, 5))], [said() for _ in range(rnd.randint(1, 5))]
        patterns += [text[0][:5] + said() + text[-1]]
        ends = [[i, *(len(text) + ord(c) for c in t)] for i, t in enumerate(text)]
        letters = np.array([x for e in ends for x in [*e[1:], e[0]]])
        lengths = np.array([len(p) for p in patterns])
        starts = np.cumsum(lengths) - lengths
        pattern = np.array([len(text) + ord(c) for p in patterns for c in p])
        index = suffix_dedup.RunIndex(letters)
        assert index.matching_statistics(pattern, starts, lengths).tolist() == _matches(text, patterns)
    # The run-end samples carry the result: without them broken matches lose their lengths.
    index.first_place, index.last_place = np.zeros_like(index.first_place), np.zeros_like(index.last_place)
    assert index.matching_statistics(pattern, starts, lengths).tolist() != _matches(text, patterns)


def test_suffix_dedup_splits_hot_anchors(docs, plain, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_PLACES", 3)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 5000)
    test_suffix_dedup(docs, plain)


def test_token_counts(docs, plain):
    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), public_tokenizers.PATTERN)
    rnd, letters = random.Random(5), "ab cd.  \n\n'st 12,é日 "
    said = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    for _ in range(300):
        tree = token_counts.TokenTree(codec, said(rnd.choice([0, 1, 5, 60, 700])))
        for _ in range(4):
            start = rnd.randint(0, len(tree.text) + 1)
            tree.edit(start, start + rnd.choice([0, 1, 5, 200]), said(rnd.choice([0, 1, 3, 30])))
            assert tree.count == len(codec.encode(tree.text)) and tree.chars[1] == len(tree.text)
    rows = by_id(token_counts.count_with_edits(docs, token_counts.sample_edits()))
    for i, text in plain.items():
        third = len(text) // 3
        new = "Edited. " + text[:third] + text[third + 20 :]
        at = min(2 * third, len(new))
        new = new[:at] + f" no. {i}" + new[at + 5 :]
        assert (rows[i]["n_tokens"], rows[i]["edited_tokens"]) == (len(codec.encode(text)), len(codec.encode(new)))
    assert token_counts.count_with_edits(empty(docs), token_counts.sample_edits()).count() == 0


@pytest.mark.parametrize("leaf", [1, 2])
def test_token_counts_of_edits_at_every_place(monkeypatch, leaf):
    monkeypatch.setattr(token_counts, "LEAF", leaf)
    codec = bpe.Codec(bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), public_tokenizers.PATTERN)
    for text in ("end.\n\nFoo bar", "a  b \n\n\t c   d", "we'lx it's' re 'v", "x \n" + " \n" * 9 + "y"):
        for start in range(len(text) + 1):
            for stop in range(start, min(start + 4, len(text)) + 1):
                for new in ("", " ", " no", "\n", "l", "e", "z"):
                    tree = token_counts.TokenTree(codec, text)
                    tree.edit(start, stop, new)
                    assert tree.count == len(codec.encode(tree.text)), (text, start, stop, new)


def test_language(docs, spark):
    model = language.fit(docs, ~language.is_held_out())
    rows = by_id(language.predict(docs, model))
    assert rows[13 + 0]["lang_pred"] in ("und", "en", "de") and all(0 <= r["score"] <= 1 for r in rows.values())
    none = spark.createDataFrame([(1, None), (2, "12 ..."), (3, "")], "doc_id long, text string")
    assert {r["lang_pred"] for r in language.predict(none, model).collect()} == {"und"}
    assert language.predict(docs, language.fit(empty(docs))).count() == docs.count()
    assert language.predict(empty(docs), model).count() == 0
    assert language.drop_unknown(docs).columns == docs.columns


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = language.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert rows.where("rejected").count() == 0


def test_language_rejects_unknown_texts_only(spark):
    read = lambda sf: spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    model = language.fit(read("sf0.01"), ~language.is_held_out())
    rnd = random.Random(4)
    drawn = lambda items, k, glue: [glue.join(rnd.choice(items) for _ in range(k)) for _ in range(20)]
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan oikeuksiltaan heille on annettu järki omatunto".split()
    russian = "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью".split()
    planted = []
    for k in (300, 1000, 3000):
        planted += drawn(finnish, k // 8, " ") + drawn(russian, k // 8, " ") + drawn("人而自由在尊和利上一律平等他赋有理性良心", k, "")
        planted += drawn("abcdefghijklmnopqrstuvwxyz ", k, "") + [rnd.randbytes(k // 2).hex() for _ in range(20)]
    planted += [base64.b64encode(rnd.randbytes(k)).decode() for k in (200, 700) for _ in range(20)]
    found = language.predict(spark.createDataFrame(list(enumerate(planted)), "doc_id long, text string"), model)
    assert found.where("NOT rejected").count() == 0
    lettered = read("sf0.1").where(language.is_held_out() & F.col("text").rlike("[a-zA-Z]"))
    assert language.predict(lettered, model).where("rejected").count() == 0


def test_toxicity(docs, spark):
    grammar = toxicity.Grammar({"idiot": (2.0, 1), "scum*": (1.0, 1), "fool*": (3.0, 3)})
    assert grammar.document("you idiot") > grammar.document("an idiot") > grammar.document("not an idiot") > grammar.document("fine") == 0
    assert grammar.document("he said idiot") < grammar.document("an idiot")
    assert grammar.document("foolish. foolish. foolish") == 3 * grammar.document("foolish") > grammar.document("a foolish " + "x " * 2000 + ". foolish. foolish")
    assert grammar.document("they will kill you. you kill") > 0
    assert toxicity.score(docs, ({}, float("inf"))).where("predicted = 1").count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == docs.count()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    hit, said, toxic = rows.agg(F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 1)), F.sum("predicted"), F.sum("toxic")).first()
    assert hit / said > 0.95 and hit / toxic > 0.9


def test_toxicity_of_long_clauses():
    grammar = toxicity.Grammar({"idiot": (2.0, 1)})
    assert grammar.document("you " + "word " * 900 + "kill") == grammar.document("you kill") > grammar.document("kill")
    assert grammar.document("fine. you " + "word " * 900 + "idiot, idiot. fine") == grammar.document("you idiot, idiot")
    assert grammar.document("you。kill") == grammar.document("you. kill") == grammar.document("kill")


def test_pipeline_stages(docs, spark):
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stage(spark, rows, "")
        if name != "byte_bpe":
            assert rows.columns == before.columns
    assert rows.count() > 0
    nothing = empty(docs)
    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, "")
        assert nothing.isEmpty(), name


def test_pipeline_keeps_what_brute_force_keeps(docs, plain, spark):
    kept = {r["doc_id"] for r in corpus_pipeline.drop_exact_copies(spark, docs, "").collect() if r["doc_id"] is not None}
    first = {}
    for i, text in sorted(plain.items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text), i)
    assert kept == set(first.values())
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.encode().lower().split()) else set() for i, t in plain.items()}
    near = corpus_pipeline.drop_near_copies(spark, docs, "").where("doc_id IS NOT NULL").select("doc_id").distinct().collect()
    alone = {i for i, s in sets.items() if not any(j != i and len(s & t) and 100 * len(s & t) >= 80 * len(s | t) for j, t in sets.items())}
    assert alone <= {r["doc_id"] for r in near} and len(near) < len(plain)
