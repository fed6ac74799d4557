"""Mixing, packing, similarity, neighbours, URL lists and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandlake.llm import jaccard, mixing, neighbours, packing, url_lists
from strandlake.llm.common import FILE, ROW, identified
from strandlake.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, full, out = float(sum(sizes.values())), set(), {}
    while True:
        open_ = [s for s in order if s not in full]
        level = (left - sum(most * sizes[s] for s in full)) / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * w[s] > most * sizes[s] + 1e-9}
        if not over:
            break
        full |= over
    for s in order:
        out[s] = float(most * sizes[s]) if s in full else level * w[s]
    return out


@pytest.mark.parametrize("block, slots", [(4, 64), (16, 16384)])
def test_mix(spark, rows, block, slots):
    rng = random.Random(3)
    items = [(i, text(rng, rng.randint(0, 300)), s) for i, s in enumerate(rng.choices(["a", "é", "b", None, "ü"], weights=[9, 3, 3, 3, 1], k=300))]
    items += [(1000, None, "a"), (1001, "", "z"), (1002, " \x1c  x", "tiny"), (5, items[5][1], items[5][2])]
    docs = identified(rows(items))
    m = mixing.mix(docs, block=block, shard_slots=slots)
    sizes = Counter()
    for _, t, s in items:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes)
    got = {r.source: r for r in m.sources.collect()}
    for s, size in sizes.items():
        assert got[s].source_size == size and got[s].target == pytest.approx(want[s])
    takes = m.takes().collect()
    assert len({(r[FILE], r[ROW]) for r in takes}) == len(items)
    per, taken = defaultdict(int), Counter()
    names = {r.sid: r.source for r in got.values()}
    for r in takes:
        per[r[FILE], r[ROW], r.size] += (r.words or 0) * r.times
        taken[names[r.sid]] += (r.words or 0) * r.times
        assert r.times <= 3
    assert all(n <= 3 * k[2] for k, n in per.items())
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.04 * want[s] + 3 * block


def test_mix_reruns_agree(spark, rows):
    rng = random.Random(4)
    docs = identified(rows([(i, text(rng, 50), "ab"[i % 2]) for i in range(60)]))
    runs = [sorted((r.doc_id, r.block, r.times) for r in mixing.mix(docs, block=8).takes().collect()) for _ in range(2)]
    assert runs[0] == runs[1]


def test_counts_of_shards_scatter_like_draws(spark, rows):
    rng = random.Random(30)
    docs = identified(rows([(i, text(rng, 400), "abc"[i % 3]) for i in range(300)]))
    m = mixing.mix(docs, block=4, shard_slots=250)
    counts = [tuple(r) for r in m.shard_counts().collect()]
    sources = {r.sid: r for r in m.sources.collect()}
    slots = sum(n for _, _, n in counts)
    shards = slots // 250
    by = defaultdict(list)
    for shard, sid, n in counts:
        if shard < shards:
            by[sid].append(n)
    for sid, ns in by.items():
        p = sources[sid].target / sum(r.target for r in sources.values())
        assert np.mean(ns) == pytest.approx(250 * p, rel=0.05)
        assert np.var(ns) == pytest.approx(250 * p * (1 - p), rel=0.5)
    for sid, r in sources.items():
        assert sum(n for _, s, n in counts if s == sid) == pytest.approx(r.target / 4, abs=1)


def test_mix_of_long_texts(spark, rows):
    rng = random.Random(31)
    items = [(1, text(rng, 80_000), "a"), (2, text(rng, 3), "a"), (3, text(rng, 500), "b")]
    got = mixing.mix_documents(rows(items)).collect()
    by = {i: t.split() for i, t, _ in items}
    words = Counter()
    for r in got:
        own = r.text.split()
        words[r.doc_id] += len(own)
        assert len(own) <= len(by[r.doc_id])
        # Blocks of 64 words in their order.
        if r.doc_id == 1:
            at = 0
            for w in own:
                at = by[1].index(w, at) + 1
    # b has a tenth of a hundredth of all words: its target stops at three times its size.
    assert words[3] == 1500 and abs(words[1] + words[2] - (80_503 - 1500)) <= 64


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 64, 97):
        df = spark.range(n).select(F.col("id").alias("block"), F.lit(n).cast("long").alias("n"), F.lit(3).alias("sid"))
        got = [r[0] for r in df.select(mixing.permuted("block", "n", "sid", 5)).collect()]
        assert sorted(got) == list(range(n)) and (n < 64 or got != list(range(n)))


def test_mixed_documents(spark, rows):
    rng = random.Random(5)
    items = [(i, "  " + text(rng, rng.randint(1, 90)) + "\n", "abc"[i % 3]) for i in range(90)] + [(500, None, "a")]
    docs = rows(items)
    got = mixing.mix_documents(docs, block=8)
    assert got.columns == docs.columns
    by = dict((i, t) for i, t, _ in items)
    words = Counter()
    for r in got.collect():
        own, whole = r.text.split(), by[r.doc_id].split()
        at = 0
        for w in own:  # a sub-sequence of the document's words
            at = whole.index(w, at) + 1
        words[r.doc_id] += len(own)
        assert r.n_chars == len(r.text)
    m = mixing.mix(identified(docs), block=8).takes().collect()
    want = Counter()
    for r in m:
        want[r.doc_id] += (r.words or 0) * r.times
    assert +words == +want
    assert mixing.mix_documents(docs.where("false")).count() == 0


def test_ids_are_those_of_the_other_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mine = packing.encoding()
    rng = random.Random(6)
    odd = ["", " ", "a<|endoftext|> b", "'s 'S don't", "  \n\n x\t", "é" * 300, "1234567", "日本語 текст ßΩ", "\x00\x1c\x85  z", "a" * 5000]
    odd += ["".join(rng.choices("ab é'\n\t1٣日<|>endoftext", k=60)) for _ in range(300)]
    for t in odd:
        assert mine.encode_to_numpy(t, allowed_special="all").tolist() == other.encode(t, add_special_tokens=False).ids


def check_packing(got, size, lengths):
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= size
    assert sorted(r.length for r in got) == sorted(lengths)
    return len(by)


def test_pack_documents(spark, rows):
    import zlib

    rng = random.Random(7)
    items = [(i, text(rng, rng.choice([1, 5, 40, 300])), "a") for i in range(150)] + [(900, None), (901, ""), (3, "x"), (3, "x"), (None, "y z")]
    got = packing.pack_documents(rows(items), 256, ids=True).collect()
    enc = packing.encoding()
    lengths = []
    for _, t, *_ in items:
        n = len(enc.encode_ordinary(t or "")) + 1
        lengths += [k for _, k in packing.cut(n, 256)]
    used = check_packing(got, 256, lengths)
    assert used <= sum(r for _, r in packing.best_fit(np.bincount(lengths, minlength=257))) + 1
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    whole = defaultdict(list)
    for r in sorted((r for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id != 3), key=lambda r: r.piece):
        assert r.start == len(whole[r.doc_id])
        whole[r.doc_id] += r.ids
    assert all(enc.decode(ids[:-1]) == items[i][1] and ids[-1] == 0 for i, ids in whole.items())
    assert packing.pack_documents(rows(items).where("false")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_plan_packs_every_length_once(seed):
    rng = np.random.default_rng(seed)
    size = 128
    counts = np.zeros(size + 1, np.int64)
    np.add.at(counts, rng.integers(1, size + 1, 20_000) if seed else rng.choice([3, 50, 100], 5000), 1)
    used = np.zeros_like(counts)
    n = 0
    for pat, reps in packing.plan(counts, 5000):
        assert 0 < sum(pat) <= size
        n += reps
        for v in pat:
            used[v] += reps
    assert (used == counts).all()
    if seed:
        # The sum over the size is out of reach here: half of the lengths pair with few others.
        assert n <= 1.004 * sum(r for _, r in packing.best_fit(counts.copy()))


@pytest.mark.parametrize("mean, spread, n", [(5.0, 0.8, 50_000), (6.2, 0.9, 20_000)])
def test_patterns_place_most_documents(mean, spread, n):
    rng = np.random.default_rng(9)
    counts = np.bincount(np.clip(rng.lognormal(mean, spread, n).astype(int), 1, 2048), minlength=2049)
    placed = max(1 - left.sum() / counts.sum() for _, left in packing.by_patterns(counts, 40_000, (0.0, 0.5)))
    assert placed >= 0.8
    assert sum(r for _, r in packing.plan(counts)) <= sum(r for _, r in packing.best_fit(counts))


def test_packing_of_a_long_text_and_repeated_rows(spark, rows):
    rng = random.Random(40)
    items = [(1, text(rng, 60_000)), (None, "same"), (None, "same"), (2, None)] + [(7, "copies of one row")] * 50
    got = packing.pack_documents(rows(items)).collect()
    enc = packing.encoding()
    n = len(enc.encode(items[0][1])) + 1
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 1)
    assert long == [(i, at, k) for i, (at, k) in enumerate(packing.cut(n, 2048))]
    assert sum(r.doc_id is None for r in got) == 2 and sum(r.doc_id == 7 for r in got) == 50
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, k in sorted(own):
            assert offset == at
            at += k
        assert at <= 2048


def brute_links(items, words=5, t=0.8):
    sets = []
    for _, x in items:
        w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    n, links, root = len(items), [0] * len(items), list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if u and len(sets[i] & sets[j]) >= t * u - 1e-12:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i in range(n):
        ids[find(i)].append(items[i][0])
    return sorted((items[i][0], min(ids[find(i)]), links[i]) for i in range(n))


def near_copies(rng):
    items, i = [], 0
    for size in (1, 2, 3, 30, 60):
        base = rng.choices(WORDS, k=200)
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(200)] = rng.choice(WORDS)
            items.append((i, " ".join(own)))
            i += 1
    items += [(i + 1, items[5][1]), (i + 2, items[5][1]), (i + 3, "a b"), (i + 4, "a b"), (i + 5, ""), (i + 6, None), (i + 7, "one two three four five six"), (i + 2, items[5][1])]
    return items


@pytest.mark.parametrize("how", [{}, {"limit": 4, "part_nodes": 8}])
def test_similar_documents(spark, rows, how):
    items = near_copies(random.Random(8))
    got = jaccard.similar_documents(identified(rows(items)), **how).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == brute_links(items)


def pairs_near_threshold(rng, n):
    """Pairs of texts with nothing in common but each other, at a similarity from 0.8 to 0.82."""
    items = []
    while len(items) < 2 * n:
        size, first = rng.randint(60, 400), rng.randrange(1 << 40)
        base = [f"u{first + i}" for i in range(size)]
        own = list(base)
        # One changed word inside costs five windows on either side.
        for _ in range(max(1, round(size * 0.108 / 5))):
            own[rng.randrange(size)] = f"v{rng.randrange(1 << 40)}"
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, own))
        if 0.8 <= len(a & b) / len(a | b) <= 0.82:
            items += [(len(items), " ".join(base)), (len(items) + 1, " ".join(own))]
    return items


@pytest.mark.parametrize("sketch", [64, None])
def test_recall_of_isolated_pairs_at_the_threshold(spark, rows, sketch):
    items = pairs_near_threshold(random.Random(20), 1500)
    got = jaccard.similar_documents(identified(rows(items)), sketch=sketch).select("doc_id", "class_id", "n_links").collect()
    found = sum(r.n_links for r in got)
    assert found >= 0.99 * len(items) and all(r.n_links <= 1 for r in got)


def test_long_chains_and_shared_passages(spark, rows):
    """Texts that slide over one long text are linked to neighbours only; those that share a passage and little else to none."""
    rng = random.Random(21)
    long = [f"c{i}" for i in range(900)]
    items = [(i, " ".join(long[3 * i : 3 * i + 120])) for i in range(260)]
    passage = [f"p{i}" for i in range(60)]
    items += [(1000 + i, " ".join(passage + [f"q{rng.randrange(1 << 40)}" for _ in range(140)])) for i in range(400)]
    got = jaccard.similar_documents(identified(rows(items)), limit=32, part_nodes=16).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == brute_links(items)


def test_very_long_texts(spark, rows):
    rng = random.Random(22)
    base = [f"l{rng.randrange(1 << 20)}" for _ in range(200_000)]
    items = [(1, " ".join(base)), (2, " ".join(base[:-100])), (3, " ".join(base[: len(base) // 2])), (4, "x" * 2_000_000)]
    got = jaccard.similar_documents(identified(rows(items))).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0)]


def test_one_of_each(spark, rows):
    items = near_copies(random.Random(9))
    docs = rows(items)
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns
    want = sorted({c for i, c, n in brute_links(items)})
    assert sorted(r.doc_id for r in got.collect()) == want
    assert jaccard.one_of_each(docs.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (999, 999)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_overlaps():
    rng = np.random.default_rng(11)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(9)]
    assert (jaccard.overlaps(sets) == [[len(set(a) & set(b)) for b in sets] for a in sets]).all()
    assert (jaccard.overlaps(sets[:4], sets[4:]) == [[len(set(a) & set(b)) for b in sets[4:]] for a in sets[:4]]).all()


def test_roots():
    rng = np.random.default_rng(12)
    for m, k in ((1, 1), (7, 4), (30, 41)):
        linked = rng.random((m, k)) < 1.2 / (m + k)
        whole = np.zeros((m + k, m + k), bool)
        whole[:m, m:], whole[m:, :m] = linked, linked.T
        assert (jaccard.roots(linked, True) == jaccard.roots(whole)).all()
        label = jaccard.roots(whole)
        assert (label[np.nonzero(whole)[0]] == label[np.nonzero(whole)[1]]).all() and (label[label] == label).all()


def brute_nearest(data, k, n):
    ok = [(i, np.array(v, float)) for i, v in data if i is not None and v is not None and len(v) == n and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ok = list({(i, tuple(v)): (i, v) for i, v in ok}.values())
    out = []
    for q, v in ok:
        if q % 10 == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in ok if i != q)[:k]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(near)]
    return sorted(out)


def test_nearest(spark):
    rng = np.random.default_rng(12)
    vec = rng.normal(size=(600, 12)).astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(vec)]
    data += [(700 + i, vec[3].tolist()) for i in range(200)] + [(3, vec[3].tolist()), (1001, None), (1002, [0.0] * 12), (1003, [float("nan")] * 12), (1004, [1.0] * 5), (None, vec[4].tolist()), (1010, [None] + [1.0] * 11)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    want = brute_nearest(data, 5, 12)
    got = sorted(map(tuple, neighbours.nearest(df, "vec_id % 10 = 0", 5, certainty=1 - 1e-9, cell_rows=64).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)
    some = {(q, i) for q, _, i, _ in map(tuple, neighbours.nearest(df, "vec_id % 10 = 0", 5, cell_rows=64).collect())}
    assert len(some & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    assert neighbours.nearest(df.where("vec_id in (3, 4)"), "vec_id = 3", 5).count() == 1
    assert neighbours.nearest(df.where("false"), "true").count() == 0


def test_chi2():
    assert neighbours.chi2_quantile(0.95, 8) == pytest.approx(15.507313, abs=1e-5)


def test_url_lists(spark):
    from datetime import date, timedelta

    day = lambda n: date(2024, 1, 1) + timedelta(n)
    entries = [("bad.com", day(3), "block"), ("bad.com", day(9), "remove"), ("ok.bad.com", day(0), "allow"), ("Bad.com", day(3), "remove"), (None, day(1), "block"), ("x.org", None, "block"), ("x.org", day(2), "odd"), ("1.2.3.4", day(0), "block")]
    asks = [(1, "http://www.bad.com/p?q", day(2)), (2, "http://www.bad.com/", day(3)), (3, "https://u:p@WWW.Bad.com.:80/x", day(8)), (4, "http://bad.com", day(9)), (5, "http://a.ok.bad.com/", day(5)), (6, None, day(5)), (7, "no url", day(5)), (8, "http://bad.com", None), (9, "http://1.2.3.4/", day(1)), (2, "http://www.bad.com/", day(3))]
    c = spark.createDataFrame([(*a, "clash") for a in asks], "id long, url string, fetched date, host string")
    e = spark.createDataFrame(entries, "key string, listed date, action string")
    got = sorted((r.id, r.matched_key or "", r.blocked) for r in url_lists.judge_captures(c, e).collect())
    assert got == [(1, "", False), (2, "bad.com", True), (2, "bad.com", True), (3, "bad.com", True), (4, "", False), (5, "ok.bad.com", False), (6, "", False), (7, "", False), (8, "", False), (9, "1.2.3.4", True)]
    long = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "bad.com/", day(5)), (2, "http://" + "a." * 120 + "bad.com/", day(5)), (3, "http://bad.com/" + "p" * 100_000, day(5))], "id long, url string, fetched date")
    assert sorted((r.id, r.matched_key) for r in url_lists.judge_captures(long, e).collect()) == [(1, None), (2, "bad.com"), (3, "bad.com")]
    assert url_lists.judge_captures(c, e.where("false")).where("blocked").count() == 0
    assert url_lists.judge_captures(c.where("false"), e).count() == 0


def test_pipeline_stages(spark, rows, folder):
    import corpus_pipeline as cp

    rng = random.Random(13)
    items = [(i, ". ".join(text(rng, 30).capitalize() for _ in range(rng.randint(2, 9))) + ".", "abc"[i % 3]) for i in range(80)]
    items += [(100 + i, items[i][1], "a") for i in range(5)] + [(200, "short"), (201, None), (202, "same same same " * 40)]
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (202, 0, 0)], "doc_id long, quality int, toxic int")
    sf = folder(documents=rows(items, extra=False), labels=labels)
    docs, ids = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        ids[name] = {r.doc_id for r in out.select("doc_id").collect()}
        if name != cp.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            from strandlake.llm.common import store

            docs = store(out)
    assert ids["quality_rules"] == set(range(80)) | set(range(100, 105))
    assert ids["line_dedup"] == ids["quality_rules"]
    assert ids["ngram_jaccard_join"] == set(range(80))
    assert ids["best_fit_packing"] == ids["mixing_sources"] <= set(range(80))
    assert cp.run(spark, sf).count() >= len(ids["mixing_sources"])


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
