"""Similarity join of documents on word shingles by chosen paths."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import kept, scratch
from .common import FILE, ROW, identified, store
from .components import components

MASK = (1 << 64) - 1
#: Most nodes of one side of a block: with as many on the other side, its matrix of shared tokens takes 64 MB.
SIDE = 4096


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, kept as long as they are few."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes, words: int = 5, hashes: WordHashes | None = None) -> np.ndarray:
    """The distinct hashes of the windows of ``words`` words, ascending. A shorter text has one shingle of all its words; a text without words none."""
    own = text.split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map((WordHashes() if hashes is None else hashes).__getitem__, own), np.uint64, len(own))
    width = min(words, len(h))
    total = np.full(len(h) - width + 1, np.uint64(width))
    for i in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i]
    return np.unique(mix64(total))


def runs_needed(threshold: float, target: float, branching: float, depth: int) -> int:
    """Independent runs until a pair at ``threshold`` is found with probability ``target``, if its bucket were split ``depth`` times: the survival of a branching process in which a pair shares branching * threshold children on average."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-branching * threshold * q)
    return math.ceil(math.log(1 - target) / math.log(1 - q))


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of ``left`` with ``right`` (with itself if None). Tokens of the same documents count as one with a weight, so alike sets cost little."""
    sets = left if right is None else left + right
    m = len(left)
    tokens = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, doc = tokens[order], doc[order]
    inter = np.zeros((m, m if right is None else len(right)), np.float32)
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, int)
    counts = np.diff(np.r_[starts, len(tokens)])
    shared = counts > 1
    if shared.any():
        names = mix64(np.arange(1, len(sets) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        pattern = np.add.reduceat(names[doc], starts)
        _, first, weight = np.unique(pattern[shared], return_index=True, return_counts=True)
        at, n = starts[shared][first], counts[shared][first]
        step = max(64, (1 << 22) // len(sets))
        for a in range(0, len(at), step):
            own_at, own_n = at[a : a + step], n[a : a + step]
            col = np.repeat(np.arange(len(own_at)), own_n)
            row = doc[np.arange(own_n.sum()) + np.repeat(own_at - np.r_[0, np.cumsum(own_n)[:-1]], own_n)]
            grid = np.zeros((len(sets), len(own_at)), np.float32)
            grid[row, col] = 1
            inter += (grid[:m] * weight[a : a + step].astype(np.float32)) @ (grid if right is None else grid[m:]).T
    if right is None:
        np.fill_diagonal(inter, [len(s) for s in sets])
    return inter


def roots(linked: np.ndarray, apart: bool = False) -> np.ndarray:
    """The first member of each member's component in a symmetric matrix of links; with ``apart``, of links between two sides, the second side's members numbered after the first's."""
    m = linked.shape[0]
    label = np.arange(m + (linked.shape[1] if apart else 0), dtype=np.int32)
    end = np.int32(len(label))

    def least(matrix, of):
        return np.concatenate([np.where(matrix[a : a + 512], of, end).min(axis=1, initial=end) for a in range(0, len(matrix), 512)])

    while True:
        near = np.concatenate([least(linked, label[m:]), least(linked.T, label[:m])]) if apart else least(linked, label)
        new = np.minimum(label, near)
        # The label of a label is in the same component, so chains shorten by halves.
        new = new[new]
        if (new == label).all():
            return label
        label = new


def signatures(docs: DataFrame, words: int, sketch: int | None) -> DataFrame:
    """``FILE, ROW, doc_id, n, k1, k2, sketch``: the size of a document's shingle set, a 128-bit hash of it and its least ``sketch`` hashes (all if None), a uniform sample that documents share as they share their sets."""

    def sign(batches):
        import pyarrow as pa
        import xxhash

        hashes = WordHashes()
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                sets = (shingles(t.as_buffer().to_pybytes() if t.is_valid else b"", words, hashes) for t in batch.column(3).cast(pa.binary()))
                n, keys, least = [], [], []
                for s in sets:
                    n.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    least.append(s[:sketch].tobytes())
                k = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(least, pa.binary())], [*batch.schema.names[:3], "n", "k1", "k2", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(FILE, ROW, "doc_id", "text").mapInArrow(sign, f"{FILE} long, {ROW} long, doc_id {kind}, n long, k1 long, k2 long, sketch binary")


def binary_tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of an Arrow column of binaries and where each row's begin, without copies."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 8
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint64, int(offsets[-1])) if data and len(column) else np.zeros(0, np.uint64)), offsets


def expanded(rows: DataFrame, branching: float, runs: int = 0) -> DataFrame:
    """``parent, path, node`` one level on from ``rows`` (``node, sketch, path``): each token of a node's sketch is chosen with probability ``branching`` over their number, by a hash of the path and the token that all documents share. With ``runs``: from the root of each run (``rows`` has no path)."""

    def walk(batches):
        import pyarrow as pa

        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                batch = whole.slice(a, 4096)
                tokens, offsets = binary_tokens(batch.column(1))
                tokens, size = tokens[offsets[0] :], np.diff(offsets)
                row = np.repeat(np.arange(len(size)), size)
                share = np.minimum(branching / np.maximum(size, 1), 1.0)
                below = np.where(share < 1, share * float(1 << 63) * 2, 0).astype(np.uint64)
                below = np.where(share < 1, below, np.uint64(MASK))[row]
                nodes = batch.column(0).to_numpy()
                starts = [np.full(len(size), r, np.uint64) for r in range(runs)] if runs else [batch.column(2).to_numpy().view(np.uint64)]
                for start in starts:
                    salt = start * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x632BE59BD9B4E019)
                    h = mix64(tokens + salt[row])
                    at = np.flatnonzero(h <= below)
                    path = mix64(h[at] ^ np.uint64(0xA0761D6478BD642F))
                    yield pa.RecordBatch.from_arrays([pa.array(start[row[at]].view(np.int64)), pa.array(path.view(np.int64)), pa.array(nodes[row[at]])], ["parent", "path", "node"])

    return rows.mapInArrow(walk, "parent long, path long, node long")


def parts_of(count: str, tokens: str, nodes: int, most_tokens: int) -> str:
    """SQL for the parts that a group is compared in: enough to bound a block's memory, and before that up to eight, so that groups of over ``nodes`` are shared out and none is copied more often than it must be."""
    return f"cast(greatest(1, ceil({count} / {SIDE}), ceil({tokens} / {most_tokens}), least(8, ceil({count} / {nodes}))) as int)"


def in_blocks(rows: DataFrame, decide: Callable) -> DataFrame:
    """``comp, node, links, root`` of the nodes with links, from a comparison of the pairs in each block by ``decide(n, m, size, size, shared)`` on matrices.

    ``rows``: ``comp, p, q, part, node, weight, n, tokens``. A block ``(comp, p, q)`` compares all its nodes if ``p = q``,
    else those of part ``p`` with those of ``q``. ``links`` sums the weights of the nodes that a node is linked to, ``root``
    is the least node that it is joined to within the block. Blocks are read as a sorted stream; no pair leaves its block.
    """

    def compare(batches):
        import pyarrow as pa

        def judged(key, part, node, weight, n, sets):
            size = np.array([len(s) for s in sets])
            if key[1] == key[2]:
                if len(sets) == 1:
                    return np.zeros(1, np.int64), node
                if len(sets) == 2:
                    ok = decide(n[0], n[1], size[0], size[1], len(np.intersect1d(*sets, assume_unique=True)))
                    return (weight[::-1], node[[0, 0]]) if ok else (np.zeros(2, np.int64), node)
                ok = decide(n[:, None], n, size[:, None], size, overlaps(sets))
                np.fill_diagonal(ok, False)
                return ok @ weight, node[roots(ok)]
            left, right = np.flatnonzero(part == key[1]), np.flatnonzero(part == key[2])
            if not len(left) or not len(right):
                return np.zeros(len(node), np.int64), node
            ok = decide(n[left][:, None], n[right], size[left][:, None], size[right], overlaps([sets[i] for i in left], [sets[i] for i in right]))
            links, root = np.zeros(len(node), np.int64), np.empty(len(node), np.int64)
            links[left], links[right] = ok @ weight[right], weight[left] @ ok
            # The least node of a component, whichever side it is on.
            label, who = roots(ok, True), np.concatenate([left, right])
            least = np.full(len(node), np.iinfo(np.int64).max)
            np.minimum.at(least, label, node[who])
            root[who] = least[label]
            return links, root

        held = []  # the pieces of the open block: key, arrays, sets
        out = []

        def flush():
            key = held[0][0]
            arrays = [np.concatenate([h[1][i] for h in held]) for i in range(4)]
            sets = [s for h in held for s in h[2]]
            links, root = judged(key, *arrays, sets)
            held.clear()
            if (at := np.flatnonzero(links)).size:
                out.append((np.full(len(at), key[0]), arrays[1][at], links[at], root[at]))

        def given():
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i in range(4)], ["comp", "node", "links", "root"])
            out.clear()
            return batch

        for batch in batches:
            c = [batch.column(i).to_numpy() for i in range(7)]
            tokens, offsets = binary_tokens(batch.column(7))
            change = np.flatnonzero((c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])) + 1
            edges = np.r_[0, change, batch.num_rows] if batch.num_rows else np.zeros(0, int)
            for a, b in zip(edges[:-1], edges[1:]):
                key = (c[0][a], c[1][a], c[2][a])
                if held and held[0][0] != key:
                    flush()
                held.append((key, [x[a:b] for x in c[3:]], [tokens[offsets[i] : offsets[i + 1]] for i in range(a, b)]))
            if sum(len(o[0]) for o in out) > 5000:
                yield given()
        if held:
            flush()
        if out:
            yield given()

    dealt = rows.select("comp", "p", "q", "part", "node", "weight", "n", "tokens").repartition("comp", "p", "q").sortWithinPartitions("comp", "p", "q", "part", "node")
    return dealt.mapInArrow(compare, "comp long, node long, links long, root long")


def chosen_buckets(nodes: DataFrame, runs: int, limit: int, branching: float, depth: int) -> DataFrame:
    """``path, node, c``: the buckets of chosen paths that are to be compared by brute force, ``c`` being their sizes.

    In each run a node goes down every token that the root samples of its sketch; nodes on one path are a bucket. Buckets
    of up to ``limit`` nodes are done. Larger ones are split again, on tokens that their own path samples, unless the
    split leaves as many pairs in its buckets as there were before: then the members are alike as a whole (on average
    they share 1 / ``branching`` of their sketches) and the bucket is done as it is. So the pairs to compare never grow
    from level to level, and a passage that many documents share, which holds a small part of each, dies out by a
    constant factor a level. Buckets with the same members, from whichever run, are kept once.
    """
    sketches = nodes.select("node", "sketch")
    rows, parents, large, done = expanded(sketches, branching, runs), None, None, []
    pairs = F.col("c").cast("double") * (F.col("c") - 1)
    for level in range(1, depth + 1):
        rows = store(rows)
        counts = store(rows.groupBy("parent", "path").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
        if parents is not None:
            left = counts.groupBy("parent").agg(F.sum(pairs).alias("left"))
            judged = store(parents.join(left, "parent", "left").select("parent", (F.coalesce("left", F.lit(0.0)) >= pairs).alias("alike")))
            done.append(large.join(judged.where("alike").select(F.col("parent").alias("path")), "path", "left_semi"))
            counts = store(counts.join(judged.where("not alike"), "parent", "left_semi"))
        sized = store(rows.join(counts.select("path", "c"), "path").select("path", "node", "c"))
        done.append(sized.where(F.col("c") <= limit))
        large = sized.where(F.col("c") > limit)
        parents = counts.where(F.col("c") > limit).select(F.col("path").alias("parent"), "c")
        if parents.isEmpty():
            break
        if level == depth:
            done.append(large)
        rows = expanded(large.join(sketches, "node").select("node", "sketch", "path"), branching)
    buckets = done[0]
    for more in done[1:]:
        buckets = buckets.unionByName(more)
    buckets = store(buckets)
    same = buckets.groupBy("path", "c").agg(F.expr("bit_xor(xxhash64(node))").alias("x1"), F.expr("bit_xor(xxhash64(5, node))").alias("x2"))
    once = same.groupBy("c", "x1", "x2").agg(F.min("path").alias("path")).select("path")
    return store(buckets.join(once, "path", "left_semi"))


def likely_links(nodes: DataFrame, buckets: DataFrame, threshold: float, part_nodes: int) -> DataFrame:
    """``comp`` (the bucket), ``node, links, root`` of the nodes that have a likely partner in a bucket: pairs whose sizes allow the threshold and whose sketches share enough. The bound lies four standard deviations below what a pair at the threshold shares; sets that a sketch holds whole are judged exactly."""

    def decide(n, m, size, also, shared):
        most = np.maximum(n, m)
        share = np.minimum(threshold / (1 + threshold) * (n + m) / most, 1.0)
        seen = np.maximum(size, also)
        slack = np.where(seen >= most, 0.0, 4 * np.sqrt(share * (1 - share) / np.maximum(seen, 1)))
        return (shared >= (share - slack) * seen - 1e-3) & (np.minimum(n, m) >= threshold * most - 1e-9)

    rows = buckets.withColumn("parts", F.expr(parts_of("c", "c", 4 * part_nodes, SIDE)))
    rows = rows.withColumn("part", F.expr("pmod(xxhash64(node), parts)")).withColumn("other", F.explode(F.expr("sequence(0L, parts - 1L)")))
    rows = rows.join(nodes.select("node", "n", "sketch"), "node")
    rows = rows.select(F.col("path").alias("comp"), F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", F.lit(1).cast("long").alias("weight"), "n", F.col("sketch").alias("tokens"))
    return in_blocks(rows, decide)


def blocks_of(likely: DataFrame, groups: DataFrame, part_nodes: int, part_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Where nodes are compared: ``node, comp, part`` and, of groups in several parts, ``comp, part, p, q`` for every block that a part is in.

    ``groups``: ``node, comp, n``. A group that fits one block has one part. In a larger one, nodes whose first bucket is
    the same make a part (or several, if they are many), and two parts are compared if they have a bucket in common: a
    group that merely hangs together costs as much as its buckets, not the square of its size.
    """
    homes = groups.join(likely.groupBy("node").agg(F.min("comp").alias("home")), "node")
    whole = groups.groupBy("comp").agg(F.expr(parts_of("count(1)", "sum(n)", part_nodes, part_tokens)).alias("split"))
    homes = store(homes.join(whole, "comp"))
    large = homes.where("split > 1")
    sizes = large.groupBy("comp", "home").agg(F.expr(parts_of("count(1)", "sum(n)", part_nodes, part_tokens)).alias("parts"))
    apart = large.join(sizes, ["comp", "home"]).select("node", "comp", F.expr("xxhash64(home, pmod(xxhash64(node), parts))").alias("part"))
    placed = store(apart.unionByName(homes.where("split = 1").select("node", "comp", F.lit(0).cast("long").alias("part"))))
    meet = store(likely.select("node", F.col("comp").alias("bucket")).join(placed.where("part <> 0"), "node").select("bucket", "comp", "part").distinct())
    pairs = meet.select("bucket", "comp", F.col("part").alias("p")).join(meet.select("bucket", "comp", F.col("part").alias("q")), ["bucket", "comp"]).where("p <= q").select("comp", "p", "q").distinct()
    pairs = store(pairs)
    return placed, pairs.select("comp", F.col("p").alias("part"), "p", "q").unionByName(pairs.where("p <> q").select("comp", F.col("q").alias("part"), "p", "q"))


def similar_documents(
    docs: DataFrame,
    threshold: float = 0.8,
    words: int = 5,
    target: float = 0.999,
    sketch: int | None = 64,
    limit: int = 256,
    branching: float = 2.0,
    depth: int = 24,
    part_nodes: int = 512,
    part_tokens: int = 2_000_000,
) -> DataFrame:
    """``FILE, ROW, doc_id, class_node, class_id, n_links`` for every document of ``docs`` (``identified``).

    Two documents are linked if the Jaccard similarity of their sets of ``words``-word shingles is at least
    ``threshold``; ``n_links`` counts the other documents that one is linked to, copies included, and ``class_id`` is the
    smallest ``doc_id`` of those joined to it by links, itself included.

    Documents of equal sets are one node with a number of copies, so copies are never paired. Chosen paths split the nodes
    into buckets, with as many runs as bring each pair together with probability ``target`` (``chosen_buckets``). Within
    buckets, pairs are sieved by their sketches (``likely_links``); what passes is compared on whole sets, each pair once
    however many buckets it shares, since buckets that have likely pairs in common are compared as one group, in blocks of
    bounded size (``blocks_of``). A node's tokens leave it once for each block of its part, and only if it has a likely
    partner. Tokens are chosen from a uniform sample of ``sketch`` tokens a set; with None from the whole sets, and the
    sieve is then exact.

    The pairs of different texts that are all alike are still compared each, in as many tasks as they fill: their number
    is what ``n_links`` counts.

    Texts under ``words`` words have one shingle of all words; texts without words (or null) are linked to none. Very long
    texts are one array of 8 bytes a word in the memory of a task. Repeated rows are copies; of equal ids the class's is
    the same whichever row it comes from, so there are no ties. Null ``doc_id``: linked as any other, and a class's id only
    if all are null. Empty table: empty result.
    """
    spark = docs.sparkSession

    def exact(n, m, size, also, shared):
        return shared * (1 + threshold) >= threshold * (n + m) - 1e-9

    def tokens(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                sets = [shingles(t or b"", words, hashes).tobytes() for t in batch.column(0).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sets, pa.binary())], [*batch.schema.names[1:], "tokens"])

    with scratch(spark):
        signed = store(signatures(docs, words, sketch))
        nodes = signed.where("n > 0").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least_id"), F.min(F.struct(FILE, ROW)).alias("at"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        nodes = store(nodes.withColumn("node", F.monotonically_increasing_id()))
        buckets = chosen_buckets(nodes, runs_needed(threshold, target, branching, depth), limit, branching, depth)
        likely = store(likely_links(nodes, buckets, threshold, part_nodes))
        joined = components(likely.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("root", "comp")
        groups = store(joined.join(nodes.select("node", "n"), "node"))
        placed, blocks = blocks_of(likely, groups, part_nodes, part_tokens)
        members = placed.join(nodes.select("node", "n", F.col("copies").alias("weight"), F.col(f"at.{FILE}").alias(FILE), F.col(f"at.{ROW}").alias(ROW)), "node")
        texts = docs.select(FILE, ROW, "text").join(members, [FILE, ROW]).select("text", "comp", "part", "node", "weight", "n")
        sets = texts.mapInArrow(tokens, "comp long, part long, node long, weight long, n long, tokens binary")
        sets = sets.join(blocks, ["comp", "part"], "left").withColumns({"p": F.coalesce("p", "part"), "q": F.coalesce("q", "part")})
        found = store(in_blocks(sets, exact))
        links = found.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
        split = found.join(placed.where("part <> 0").select("node"), "node", "left_semi").select(F.col("node").alias("a"), F.col("root").alias("b"))
        links = links.join(components(split).withColumnRenamed("root", "joined"), "node", "left").withColumn("root", F.coalesce("joined", "root"))
        known = nodes.select("k1", "k2", "node", "copies", "least_id").join(links.select("node", "links", "root"), "node", "left")
        known = store(known.select("k1", "k2", "least_id", F.coalesce("root", "node").alias("class_node"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
        least = known.groupBy("class_node").agg(F.min("least_id").alias("class_id"))
        known = known.join(least, "class_node").drop("least_id")
        out = signed.select(FILE, ROW, "doc_id", "n", "k1", "k2").join(known, ["k1", "k2"], "left")
        empty = F.col("n") == 0
        return kept(out.select(FILE, ROW, "doc_id", F.when(~empty, F.col("class_node")).alias("class_node"), F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(empty, 0).otherwise(F.col("n_links")).alias("n_links")))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each class: the smallest ``doc_id``, the first of its rows. Documents without words stay."""
    docs = identified(docs)
    found = similar_documents(docs, **how)
    first = found.where("class_node is not null").groupBy("class_node").agg(F.min(F.struct("doc_id", FILE, ROW)).alias("f")).select(F.col(f"f.{FILE}").alias(FILE), F.col(f"f.{ROW}").alias(ROW))
    stay = first.unionByName(found.where("class_node is null").select(FILE, ROW))
    return docs.join(stay, [FILE, ROW], "left_semi").drop(FILE, ROW)


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document with its class of linked documents and its number of links."""
    docs = identified(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return similar_documents(docs).select("doc_id", "class_id", "n_links")
