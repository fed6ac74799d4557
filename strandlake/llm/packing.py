"""Packing tokenized documents into training sequences."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Ranks of the vocabulary byte_bpe_50k.json as tiktoken reads them: the same ids (a test compares the libraries), five times as fast.
VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=4)
def encoding(path: str | None = None):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids: one if they fit, else full pieces behind a first that takes what is over."""
    first = n % size or min(n, size)
    return [(0, first), *((at, size) for at in range(first, n, size))] if n else []


def token_pieces(docs: DataFrame, size: int, path: str | None = None, ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and the ids themselves if asked for).

    The ids are those of the library ``tokenizers`` with byte_bpe_50k.json; they come from ``tiktoken`` with the ranks of the
    same vocabulary, which a test holds against the other text by text and which takes a fifth of the time.
    """

    def pieces(batches):
        import zlib

        import pyarrow as pa

        enc = encoding(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.append(enc.encode_to_numpy(text or "", allowed_special="all"), 0).astype("<u4")
                rows += [(doc_id, i, at, n, zlib.crc32(own[at : at + n].tobytes()), *([own[at : at + n].tolist()] if ids else [])) for i, (at, n) in enumerate(cut(len(own), size))]
            kinds = [batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int64())] if ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids)


def patterns(size: int, counts: np.ndarray, most: int, seed: int = 7) -> np.ndarray:
    """Up to ``most`` patterns that fill ``size``, as rows (length, repeats) for at most three lengths, 0 and 0 for none; only lengths that occur.

    All pairs of two documents and all repeats of one length come first. Of the others (about size^2 / 12 of three
    documents, and far more of repeated short ones) as many as are left are drawn, the same number for every length, so
    that each has patterns to be in: a number of repeats of it, a second length by its share of all documents and its
    repeats, and the one length that fills what is left.
    """
    has = counts > 0
    has[0] = False
    lengths = np.flatnonzero(has)
    if not len(lengths):
        return np.zeros((0, 6), np.int64)
    same = lengths[size % lengths == 0]
    found = [np.stack([same, size // same, 0 * same, 0 * same, 0 * same, 0 * same], 1)]
    a = lengths[(lengths * 2 < size)]
    a = a[has[size - a]]
    found.append(np.stack([size - a, 0 * a + 1, a, 0 * a + 1, 0 * a, 0 * a], 1))
    room = max(0, most - sum(map(len, found)))
    rng = np.random.default_rng(seed)
    share = -(-room // len(lengths))
    odds = counts[lengths] / counts[lengths].sum()
    for n in lengths:
        tries = 24 * share
        m = rng.integers(1, size // n + 1, tries)
        rest = size - m * n
        second = rng.choice(lengths, tries, p=odds)
        k = rng.integers(0, np.maximum(rest // second, 0) + 1)
        third = rest - k * second
        ok = (third >= 0) & (has[third] | (third == 0)) & ((k > 0) | (third > 0))
        rows = np.stack([0 * m + n, m, np.where(k > 0, second, 0), k, third, (third > 0) * 1], 1)[ok]
        if len(rows):
            rows = np.unique(rows, axis=0)
            found.append(rows if len(rows) <= share else rows[np.sort(rng.choice(len(rows), share, replace=False))])
    return np.concatenate(found).astype(np.int64)[:most]


def fit(pats: np.ndarray, counts: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient: repeats ``x`` of ``pats`` whose documents come nearest to ``counts`` (by length).

    The matrix is never built: a pattern adds to three lengths, so both products are sums by index. Its steps are scaled
    by the row sums of the normal matrix, which bound it, so that rare and common lengths move alike.
    """
    size = len(counts) - 1
    if not len(pats) or not counts.sum():
        return np.zeros(len(pats))
    at, reps = pats[:, ::2], pats[:, 1::2].astype(float)
    b = counts.astype(float)
    b[0] = 0

    def times(x):
        y = np.zeros(size + 1)
        for k in range(3):
            y += np.bincount(at[:, k], x * reps[:, k], size + 1)
        y[0] = 0
        return y

    def back(r):
        return (r[at] * reps).sum(1)

    rows = np.maximum(times(np.ones(len(pats))), 1)
    step = 1 / back(rows)
    x = np.min(np.where(reps > 0, (b / rows)[at], np.inf), axis=1)
    y, t = x.copy(), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(times(y) - b))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def round_within(pats: np.ndarray, x: np.ndarray, counts: np.ndarray, up: float) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeats of the patterns that use no length more often than it occurs, and what is left of ``counts``.

    Whole parts first; then repeats with a fraction of at least ``up`` are rounded up, the largest first, as long as the
    lengths last.
    """
    left = counts.copy()
    left[0] = 0
    reps = np.zeros(len(pats), np.int64)

    def take(i, n):
        used: dict[int, int] = {}
        for v, m in zip(pats[i, ::2].tolist(), pats[i, 1::2].tolist()):
            if m:
                used[v] = used.get(v, 0) + m
        n = min([n, *(int(left[v]) // m for v, m in used.items())])
        if n > 0:
            reps[i] += n
            for v, m in used.items():
                left[v] -= n * m

    order = np.argsort(-x, kind="stable")
    for i in order[x[order] >= 1]:
        take(i, int(x[i]))
    part = x - np.floor(x)
    for i in np.argsort(-part, kind="stable"):
        if part[i] < up or not part[i]:
            break
        take(i, 1)
    return reps, left


def by_patterns(counts: np.ndarray, most: int, ups: tuple[float, ...], turns: int = 4) -> list[tuple[list[tuple[tuple[int, ...], int]], np.ndarray]]:
    """For each way to round (``ups``), packs by fitted patterns and what is left of ``counts``. What a turn leaves is fitted again, on fewer patterns of its own lengths, as long as a turn places a tenth of it."""
    first = patterns(len(counts) - 1, counts, most)
    fitted = fit(first, counts)
    ways = []
    for up in ups:
        packs, left, pats, x = [], counts.copy(), first, fitted
        left[0] = 0
        for turn in range(1, turns + 1):
            reps, after = round_within(pats, x, left, up)
            for row, r in zip(pats[reps > 0].tolist(), reps[reps > 0].tolist()):
                packs.append((tuple(v for v, m in zip(row[::2], row[1::2]) for _ in range(m)), r))
            few, left = left.sum() - after.sum() < 0.1 * left.sum(), after
            if few or turn == turns:
                break
            pats = patterns(len(counts) - 1, left, most // 4, 7 + turn)
            x = fit(pats, left)
        ways.append((packs, left))
    return ways


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """What no pattern took, longest first, each into the open sequences with the least room that holds it; alike sequences are handled as one, so the work depends on the number of lengths and not of documents."""
    size = len(left) - 1
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(size + 1)]  # by room left
    rooms = np.zeros(size + 1, bool)
    done: list[tuple[tuple[int, ...], int]] = []
    for n in range(size, 0, -1):
        todo = int(left[n])
        while todo:
            fits = np.flatnonzero(rooms[n:])
            if not len(fits):
                # As many copies in a fresh sequence as fit, and the rest in one more.
                each = size // n
                for per, reps in ((each, todo // each), (todo % each, int(todo % each > 0))):
                    if reps and per:
                        room = size - per * n
                        if room:
                            open_[room][(n,) * per] = open_[room].get((n,) * per, 0) + reps
                            rooms[room] = True
                        else:
                            done.append(((n,) * per, reps))
                break
            room = n + int(fits[0])
            pat, reps = next(iter(open_[room].items()))
            k = min(reps, todo)
            if k == reps:
                del open_[room][pat]
                rooms[room] = bool(open_[room])
            else:
                open_[room][pat] = reps - k
            todo -= k
            if room == n:
                done.append(((*pat, n), k))
            else:
                open_[room - n][(*pat, n)] = open_[room - n].get((*pat, n), 0) + k
                rooms[room - n] = True
    return done + [(p, r) for by in open_ for p, r in by.items()]


def plan(counts: np.ndarray, most: int = 40_000) -> list[tuple[tuple[int, ...], int]]:
    """Packs as (lengths, repeats) for a histogram: pattern packing, then best fit for the rest. Fitted repeats are rounded up or to the nearest; the way that needs fewer sequences is taken, of equal ones that in which patterns place more documents."""
    ways = [(packs + best_fit(left), int(left.sum())) for packs, left in by_patterns(counts, most, (0.0, 0.5))]
    return min(ways, key=lambda way: (sum(r for _, r in way[0]), way[1]))[0]


def places(packs: list[tuple[tuple[int, ...], int]], size: int) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, offset), ascending in rank: the piece of that length with rank r lies in sequence ``first sequence + r - first rank`` of the last row not above r."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pat, reps in packs:
        offset = 0
        for n in pat:
            at = used.get(n, 0)
            rows.setdefault(n, []).append((at, sequence, offset))
            used[n] = at + reps
            offset += n
        sequence += reps
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def pack(pieces: DataFrame, size: int = 2048, most_patterns: int = 40_000, group: int = 50_000) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``size``) with ``sequence_id`` and ``offset``.

    Only the histogram of lengths, ``size`` numbers at most, comes to the driver. The packs that ``plan`` makes are
    bounded by ``most_patterns`` and ``size``, not by the rows; they go to the executors with the task. A piece finds its
    place by its rank among the pieces of its length: ranks are counted within (length, salt) and shifted by the salts
    before, with as many salts as keep groups near ``group`` pieces should all have one length. The salt is drawn for each
    row and stored with it, so that rows repeated ever so often are spread as well.
    """
    pieces = store(pieces.withColumn("__sl_at", F.monotonically_increasing_id()))
    spark, columns = pieces.sparkSession, [c for c in pieces.columns if c != "__sl_at"]
    salts = max(64, pieces.count() // group)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("__sl_at"), F.lit(salts)).cast("int"))
    groups = store(pieces.groupBy("length", "salt").count())
    counts = np.zeros(size + 1, np.int64)
    for n, c in groups.groupBy("length").agg(F.sum("count")).collect():
        counts[n] = c
    rows = places(plan(counts, most_patterns), size)
    before = groups.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "__sl_at")) - 1)
    sent = spark.sparkContext.broadcast(rows)  # at most most_patterns + a few thousand packs of 3 longs a length

    def place(batches):
        import pyarrow as pa

        by = sent.value
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(names.index("rank")).to_numpy() + batch.column(names.index("before")).to_numpy()
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                own = by[int(n)]
                row = own[np.searchsorted(own[:, 0], rank[at], "right") - 1]
                seq[at], off[at] = row[:, 1] + rank[at] - row[:, 0], row[:, 2]
            keep = [n for n in names if n not in ("rank", "before", "sequence_id", "offset")]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in keep), pa.array(seq), pa.array(off)], [*keep, "sequence_id", "offset"])

    from .common import plus

    placed = ranked.join(before, ["length", "salt"]).select(*columns, "rank", "before")
    return placed.mapInArrow(place, plus(pieces.select(*columns), "sequence_id long, offset long"))


def pack_documents(docs: DataFrame, size: int = 2048, path: str | None = None, ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` if asked for).

    A document is its ids and id 0. Null or empty text: the single id 0. Documents longer than ``size`` are cut into
    pieces of ``size``, the first of which may be shorter; a very long text is tokenized whole, its ids in memory at once.
    Repeated rows are packed each; null ``doc_id`` stays null; pieces of one length are told apart by nothing else, so
    ties go by the order of the rows. Empty table: empty result. Other columns are left out, whatever their names.
    """
    return pack(token_pieces(docs, size, path, ids), size)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
