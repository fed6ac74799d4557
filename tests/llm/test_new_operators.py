"""Fill-in-the-middle, toxicity and collocations against plain versions, and odd tables."""

from __future__ import annotations

import copy
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import collocations as C
from strandlake.llm import infilling as I
from strandlake.llm import toxicity as T

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def test_ranks_agree_with_a_listing_of_tokens():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("abZ <P>S.Mé漢\x00\n1") for _ in range(rng.randrange(0, 18)))
        tokens, ranks = TOKEN.findall(text), I.Ranks(text)
        assert ranks.n == len(tokens)
        assert [ranks.offset(u) for u in range(len(tokens) + 1)] == [len("".join(tokens[:u])) for u in range(len(tokens) + 1)]
        assert ranks.sentinel == any(s in text for s in I.SENTINELS)


def plain_infill(text, doc_id):
    """The transformed text and its form, by listing all tokens."""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s in text for s in I.SENTINELS) or h3 % 100 >= 90:
        return text, "plain"
    lo, hi = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:lo], tokens[lo:hi], tokens[hi:]))
    return (f"<S>{s}<P>{p}<M>{m}", "spm") if h4 % 100 < 20 else (f"<P>{p}<S>{s}<M>{m}", "psm")


def test_infilling_agrees_with_listing_and_is_undone(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["ab", "<", "P>", "<S", ">", " ", "é", "x1", "\n"]) for _ in range(rng.randrange(0, 30))), "kept") for i in range(300)]
    rows += [(300, None, "kept"), (301, "", "kept"), (None, "some text", "kept"), (7, "twice", "kept"), (7, "twice", "kept"), (302, "word " * 400_000, "kept"), (303, "a <M> b", "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    made = I.fill_in_middle(docs).withColumn("back", I.restored(F.col("infill"), F.col("form"))).collect()
    assert len(made) == len(rows)
    for r in made:
        text = r["text"] or ""
        assert r["back"] == text
        if r["doc_id"] is not None:
            assert (r["infill"], r["form"]) == plain_infill(text, r["doc_id"])
        assert (r["prefix_chars"] is None) == (r["form"] == "plain")
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    assert I.fill_in_middle(docs.limit(0)).count() == 0


def test_factorization_machine_learns_what_no_sum_of_weights_can():
    """Label 1 for one of two words, 0 for both or neither: nothing additive gets more than three of four cases."""
    rng = np.random.default_rng(1)
    known = T.Terms(20)
    texts, toxic = [], []
    for _ in range(800):
        a, b = rng.integers(0, 2, 2)
        words = [f"w{'abcdefghij'[k]}" for k in rng.integers(0, 10, 8)] + ["foe"] * int(a) + ["jest"] * int(b)
        texts.append(" ".join(rng.permutation(words)).encode())
        toxic.append(int(a != b))
    rows, toxic = [known.of(t) for t in texts], np.array(toxic, float)
    machine = T.train(rows[:600], toxic[:600], steps=400, sparsity=1e-4)
    right = [(machine.score(r) >= 0.5) == bool(y) for r, y in zip(rows[600:], toxic[600:])]
    assert np.mean(right) >= 0.95
    machine.factors[:] = 0
    additive = [(machine.score(r) >= 0.5) == bool(y) for r, y in zip(rows[600:], toxic[600:])]
    assert np.mean(additive) <= 0.8


def test_toxicity_holds_out_labels_and_takes_odd_rows(spark):
    rng = random.Random(2)
    clean = ["meadow", "river", "paper", "garden", "window", "morning"]
    rows = [(i, " ".join(rng.choices(clean, k=30) + (["grobian", "grobian"] if i % 3 == 0 else [])), "score column") for i in range(400)]
    odd = [(1000, None, "x"), (1001, "", "x"), (None, "grobian grobian river", "x"), (3, rows[3][1], "x"), (1002, "river " * 100_000 + "grobian grobian", "x"), (1003, "漢字", "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)] + [(5, 0), (None, 1), (9999, 1)], "doc_id long, toxic int")
    seen = labels.where(~T.held_out(F.col("doc_id")))
    found = T.score_toxicity(docs, T.train_machine(docs, seen)).collect()
    assert len(found) == len(rows) + len(odd)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    by = {r["doc_id"]: r["predicted"] for r in found}
    assert all(by[i] == int(i % 3 == 0) for i in range(400))
    assert by[1002] == 1 and by[1000] == by[1001] == by[1003] == 0 and by[None] == 1
    # The labels held out change nothing; no label at all gives every text the same score.
    turned = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = T.score_toxicity(docs, T.train_machine(docs, turned.where(~T.held_out(F.col("doc_id"))))).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in again) == sorted((str(r["doc_id"]), r["score"]) for r in found)
    assert T.score_toxicity(docs, T.train_machine(docs, labels.limit(0))).select("score").distinct().count() == 1
    assert T.score_toxicity(docs.limit(0), T.train_machine(docs.limit(0), labels)).count() == 0


def test_held_out_accuracy_on_the_tables(spark):
    """Toxic documents that hold nothing but repeats of one word can't be told; most others must be, and clean ones stay."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    machine = T.train_machine(docs, labels.where(~T.held_out(F.col("doc_id"))))
    held = docs.join(labels.select("doc_id", "toxic").where(T.held_out(F.col("doc_id"))), "doc_id")
    found = Counter((r["toxic"], r["predicted"]) for r in T.score_toxicity(held, machine).select("toxic", "predicted").collect())
    assert found[1, 1] >= 0.75 * (found[1, 0] + found[1, 1])
    assert found[0, 1] <= 0.005 * (found[0, 0] + found[0, 1])


def plain_collocations(rows, least, inside=50, most=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    out = []
    for (lang, g), a in f.items():
        if len(g) < 2 or a < least:
            continue
        longer = [x for (lang2, h), x in f.items() if lang2 == lang and len(h) == 3 and len(g) == 2 and x >= least and g in (h[:2], h[1:])]
        if any(100 * x >= inside * a for x in longer):
            continue
        score, k = min((1000000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        out.append((lang, " ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score))
    kept = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:most]
        kept += [(x[0], i, *x[1:]) for i, x in enumerate(own, 1)]
    return sorted(kept)


def test_slices_of_a_long_text_count_alike(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice(["a", "bb", "ccc", "dddddddd"]) + rng.choice([" ", " ", "\t", ". ", "\n"]) for _ in range(3000)).encode()
    whole = C.Trie()
    whole.add(C.words_of(text))
    for size in (1, 7, 100, 5000):
        monkeypatch.setattr(C, "SLICE", size)
        parts = C.Trie()
        for words, ahead in C.runs_of(text):
            parts.add(words, ahead)
        assert all(np.array_equal(x, y) for x, y in zip(C.Trie.paths(parts), C.Trie.paths(copy.deepcopy(whole))))


@pytest.mark.parametrize("held", [1_000_000, 60])
def test_collocations_agree_with_counting(spark, monkeypatch, held):
    monkeypatch.setattr(C, "MOST_HELD", held)
    rng = random.Random(11)
    vocabulary = ["the", "The", "a", "salt", "pepper", "été", "Été", "x\x1fy", "-", " "]
    rows = []
    for _ in range(250):
        text = "".join(rng.choices(vocabulary, weights=[9, 3, 5, 2, 2, 2, 1, 1, 1, 1])[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r"]) for _ in range(rng.randrange(0, 40)))
        rows.append((rng.choice(["en", "fr", None, "und"]), text))
    rows += [("en", None), ("en", ""), (None, None), ("en", "salt pepper the " * 500), ("de", ". , ;")] + [("en", "same words again and again")] * 12
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "lang string, text string, n string, a int")
    found = C.best_collocations(C.collocations(docs, least=3)).select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long")).collect()
    assert sorted(map(tuple, found)) == plain_collocations(rows, 3)
    assert len(found) > 50


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert C.best_collocations(C.collocations(docs)).count() == 0


def test_scores_stay_exact_beyond_64_bits(spark):
    """A count of 3 * 10^9 squared and times a million passes 64 bits; the least cut wins, ties go to the shorter left part."""
    big = 3_000_000_019
    rows = [("en", 1, ["a"], 3 * big, 0, 0), ("en", 1, ["b"], 2 * big, 0, 0), ("en", 2, ["a", "b"], big, 3 * big, 0)]
    table = spark.createDataFrame([(*r[:4], r[4] or r[3], r[5] or r[3]) for r in rows], "lang string, depth int, words array<string>, f long, l1 long, l2 long")
    n = spark.createDataFrame([("en", 10 * big)], "lang string, n long")
    old = C.phrase_counts
    C.phrase_counts = lambda *_: (table, n)
    try:
        (row,) = C.collocations(table.selectExpr("lang", "lang as text")).collect()
    finally:
        C.phrase_counts = old
    assert row["score"] == 1_000_000 * big * big // (6 * big * big)


def test_long_addresses_are_replaced_whole(spark):
    from strandlake.llm import surrogates

    for n in (1, 63, 64, 65, 80, 5000):
        text = f"write to ..{'a' * n}@example.org, or not"
        assert [(s, e, k) for s, e, k, _ in surrogates.find_entities(text)] == [(11, 11 + n + 12, "email")]
    assert surrogates.find_entities("x@@y.org a@b ...@c.org") == []
