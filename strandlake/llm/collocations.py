"""Phrase collocations: count tries per shard, cut at prefix ranges, merged and walked range by range."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Words of the longest phrase; three word numbers of 21 bits make a path.
DEPTH, BITS = 3, 21
LOW = (1 << BITS) - 1
#: Stands between pieces; a separator itself, so it is no word.
BREAK = b"."
#: Separators of pieces become the break, a tab a blank.
_PIECES = bytes(BREAK[0] if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))
#: Bytes of a text that are read at a time.
SLICE = 4 << 20
#: Occurrences, distinct words and languages that a trie holds before it is written out.
MOST_HELD, MOST_WORDS, MOST_LANGS = 1_000_000, 300_000, 1000
#: Occurrences for which one prefix range is meant, and sampled phrases for each range.
PER_RANGE, SAMPLED = 500_000, 40
UNKNOWN = "und"


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in lower case (A-Z), with ``BREAK`` before and after each piece boundary."""
    return text.lower().translate(_PIECES).replace(BREAK, b" . ").split()


def runs_of(text: bytes):
    """The words of a text in runs of about ``SLICE`` bytes, each with the number of words at its end that are told only as what follows and come again in the next run."""
    at, carry = 0, []
    while at < len(text):
        cut = at + SLICE < len(text) and re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]").search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        words = carry + words_of(text[at:end])
        ahead = min(DEPTH - 1, len(words)) if cut else 0
        yield words, ahead
        at, carry = end, words[len(words) - ahead :]


class Trie:
    """Counts of all phrases of up to ``DEPTH`` words of one language, as a sorted array of paths in which a phrase stands before those that begin with it."""

    def __init__(self):
        self.known: dict[bytes, int] = {BREAK: 0}
        self.texts: list[np.ndarray] = []

    def add(self, words: list[bytes], ahead: int = 0) -> None:
        """Count the phrases that begin at these words, but for the last ``ahead`` of them."""
        known = self.known
        for w in set(words).difference(known):
            known[w] = len(known)
        ids = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        ids[len(words) - ahead :] *= -1
        self.texts += [ids, np.zeros(1, np.int32)]

    def paths(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Sorted words, sorted paths over their ranks from 1 on, and the count of each path."""
        del self.known[BREAK]
        words = sorted(self.known)
        rank = np.zeros(len(words) + 1, np.int64)
        rank[[self.known[w] for w in words]] = np.arange(1, len(words) + 1)
        signed = np.concatenate([*self.texts, np.zeros(DEPTH, np.int32)])
        ids = rank[np.abs(signed)]
        a, b, c = ids[:-2], ids[1:-1], ids[2:]
        one = signed[:-2] > 0
        two = one & (b > 0)
        three = two & (c > 0)
        high, pair = a << 2 * BITS, b << BITS
        paths = np.concatenate([high[one], (high + pair)[two], (high + pair + c)[three]])
        paths.sort()
        heads = np.flatnonzero(np.concatenate([[True], paths[1:] != paths[:-1]])) if len(paths) else np.zeros(0, np.int64)
        return words, paths[heads], np.diff(heads, append=len(paths))


def least_path(words: list[bytes], phrase: tuple[bytes, ...]) -> int:
    """The least path over ``words`` that is no smaller than ``phrase``, also where words of it are unknown."""
    from bisect import bisect_left

    path = 0
    for depth, word in enumerate(phrase):
        at = bisect_left(words, word)
        path += (at + 1) << BITS * (DEPTH - 1 - depth)
        if at == len(words) or words[at] != word:
            break
    return path


def packed(words: list[bytes], paths: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """A piece of a trie as bytes: its words, and its paths in ranks of these with their counts, column by column and byte by byte, so that they compress."""
    import zstandard

    levels = np.stack([paths >> BITS * (DEPTH - 1 - d) & LOW for d in range(DEPTH)])
    used = np.unique(levels)
    used = used[used > 0]
    own = np.searchsorted(used, levels) + 1
    own[levels == 0] = 0
    own[0] = np.diff(own[0], prepend=0)
    planes = np.vstack([own, counts]).astype("<u4").view("u1").reshape(DEPTH + 1, -1, 4).transpose(0, 2, 1)
    return zstandard.compress(b" ".join(words[i - 1] for i in used), 1), zstandard.compress(planes.tobytes(), 1)


def unpacked_words(words: bytes) -> list[bytes]:
    import zstandard

    return zstandard.decompress(words).split(b" ")


def unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(body), "u1").reshape(DEPTH + 1, 4, -1)
    levels = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[:, :, 0].astype(np.int64)
    return (np.cumsum(levels[0]) << 2 * BITS) + (levels[1] << BITS) + levels[2], levels[3]


def pieces(lang: str, trie: Trie, bounds: list[tuple[str, tuple[bytes, ...]]]):
    """``range, lang, n, words, body, spine`` for each prefix range in which the trie has phrases.

    A range begins at its bound. Where the bound lies below a phrase, the range also gets that phrase's own count from
    this trie, marked by ``spine`` (the number of such paths at its front), so that whoever walks the range knows all
    ancestors of what it holds. ``n`` counts the words of the piece.
    """
    words, paths, counts = trie.paths()
    if not len(paths):
        return
    first = sum(b[0] < lang for b in bounds)
    own = [b[1] for b in bounds if b[0] == lang]
    cuts = [0, *np.searchsorted(paths, [least_path(words, p) for p in own]).tolist(), len(paths)]
    single = np.concatenate([[0], np.cumsum(np.where(paths & ((1 << 2 * BITS) - 1) == 0, counts, 0))])
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        above = []
        for depth in range(1, len(own[i - 1]) if i else 0):
            at = int(np.searchsorted(paths, path := least_path(words, own[i - 1][:depth])))
            if at < lo and paths[at] == path:
                above.append(at)
        if lo < hi or above:
            at = np.concatenate([np.array(above, np.int64), np.arange(lo, hi)])
            yield first + i, lang, int(single[hi] - single[lo]), *packed(words, paths[at], counts[at]), len(above)


def shard_tries(docs: DataFrame, bounds: list[tuple[str, tuple[bytes, ...]]]) -> DataFrame:
    """The tries of ``lang, text``, cut at ``bounds``: a task writes its tries out whenever they hold ``MOST_HELD`` occurrences or ``MOST_WORDS`` words."""
    names = {"range": "int", "lang": "string", "n": "long", "words": "binary", "body": "binary", "spine": "int"}

    def count(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int32()]
        tries: dict[str, Trie] = defaultdict(Trie)

        def out():
            for lang in sorted(tries):
                for row in pieces(lang, tries[lang], bounds):
                    yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], list(names))
            tries.clear()

        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for words, ahead in runs_of(text or b""):
                    trie = tries[lang]
                    trie.add(words, ahead)
                    held += len(words) + 1
                    if held >= MOST_HELD or len(trie.known) >= MOST_WORDS or len(tries) > MOST_LANGS:
                        yield from out()
                        held = 0
        yield from out()

    return docs.select("lang", "text").mapInArrow(count, ", ".join(f"{n} {k}" for n, k in names.items()))


class Merged:
    """The tries of one prefix range, added up; those that wait do so packed, until they are as large as what is merged."""

    def __init__(self):
        self.words: list[bytes] = []
        self.paths, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[tuple[bytes, bytes]] = []
        self.held = 0
        self.above: set[tuple[str, ...]] = set()

    def add(self, words: bytes, body: bytes, spine: int) -> None:
        self.waiting.append((words, body))
        self.held += len(words) + len(body)
        if spine:
            own = unpacked_words(words)
            self.above.update(tuple(own[x - 1].decode() for x in (p >> 2 * BITS, p >> BITS & LOW) if x) for p in unpacked(body)[0][:spine].tolist())
        if self.held >= max(2 * len(self.paths), 1 << 20):
            self.merge()

    def merge(self) -> None:
        known = set(self.words)
        for own, _ in self.waiting:
            known.update(unpacked_words(own))
        words = sorted(known)
        place = {w: i for i, w in enumerate(words, 1)}

        def moved(own: list[bytes], paths: np.ndarray) -> np.ndarray:
            to = np.array([0, *map(place.__getitem__, own)], np.int64)
            return (to[paths >> 2 * BITS] << 2 * BITS) + (to[paths >> BITS & LOW] << BITS) + to[paths & LOW]

        runs = [(moved(self.words, self.paths), self.counts)]
        for own, body in self.waiting:
            paths, counts = unpacked(body)
            runs.append((moved(unpacked_words(own), paths), counts))
        self.waiting, self.held = [], 0
        paths, counts = (np.concatenate(x) for x in zip(*runs))
        del runs
        order = np.argsort(paths, kind="stable")  # of sorted runs: a merge
        paths, counts = paths[order], counts[order]
        heads = np.flatnonzero(np.concatenate([[True], paths[1:] != paths[:-1]])) if len(paths) else np.zeros(0, np.int64)
        self.words, self.paths = words, paths[heads]
        self.counts = np.add.reduceat(counts, heads) if len(heads) else counts

    def frequent(self, least: int):
        """``depth, words, f, l1, l2`` of the range's own paths counted ``least`` times: a walk down the trie gives the counts of the first one and two words."""
        self.merge()
        paths, counts = self.paths, self.counts
        depth = 1 + (paths >> BITS & LOW > 0) + (paths & LOW > 0)
        at = np.flatnonzero(counts >= least)
        ones, twos = np.searchsorted(paths, paths[at] >> 2 * BITS << 2 * BITS), np.searchsorted(paths, paths[at] >> BITS << BITS)
        for i, one, two in zip(at.tolist(), ones.tolist(), twos.tolist()):
            path, deep = int(paths[i]), int(depth[i])
            ids = (path >> 2 * BITS, path >> BITS & LOW, path & LOW)[:deep]
            phrase = [self.words[x - 1].decode() for x in ids]
            if tuple(phrase) not in self.above:
                yield deep, phrase, int(counts[i]), int(counts[one]), int(counts[two])


def merged_tries(pieces_table: DataFrame, ranges: int, least: int) -> DataFrame:
    """``lang, depth, words, f, l1, l2`` for phrases that all shards together count ``least`` times; each range is merged by one task, which takes a range's pieces as they come."""
    names = {"lang": "string", "depth": "int", "words": "array<string>", "f": "long", "l1": "long", "l2": "long"}

    def merge(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64()]

        def out(tries):
            for lang, trie in sorted(tries.items()):
                rows = [(lang, *row) for row in trie.frequent(least)]
                for i in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows[i : i + 20_000]), kinds)], list(names))

        current, tries = None, defaultdict(Merged)
        for batch in batches:
            for i in range(batch.num_rows):
                at, lang, *piece = (batch.column(k)[i].as_py() for k in range(5))
                if at != current:
                    yield from out(tries)
                    current, tries = at, defaultdict(Merged)
                tries[lang].add(*piece)
        yield from out(tries)

    dealt = pieces_table.select("range", "lang", "words", "body", "spine").repartition(ranges, "range").sortWithinPartitions("range")
    return dealt.mapInArrow(merge, ", ".join(f"{n} {k}" for n, k in names.items()))


def prefix_bounds(docs: DataFrame, ranges: int, rows: int) -> list[tuple[str, tuple[bytes, ...]]]:
    """At most ``ranges - 1`` phrases that part those of ``lang, text`` about evenly: quantiles of some ``SAMPLED`` phrases a range. They only decide which task merges what."""

    def draw(batches):
        import pyarrow as pa

        rng = np.random.default_rng(1)
        for batch in batches:
            found = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for words, _ in runs_of(text or b""):
                    for at in rng.integers(0, len(words), 2).tolist() if words else ():
                        phrase = words[at : at + DEPTH]
                        phrase = phrase[: phrase.index(BREAK)] if BREAK in phrase else phrase
                        if phrase:
                            found.append((lang, phrase))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.list_(pa.binary()))], ["lang", "words"])

    few = docs.sample(min(1.0, SAMPLED * ranges / 2 / max(1, rows)), seed=1)
    drawn = sorted((r["lang"], tuple(bytes(w) for w in r["words"])) for r in few.mapInArrow(draw, "lang string, words array<binary>").limit(4 * SAMPLED * ranges).collect())
    return sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []


def phrase_counts(docs: DataFrame, least: int = 10, per_range: int = PER_RANGE) -> tuple[DataFrame, DataFrame]:
    """``lang, depth, words, f, l1, l2`` of all phrases of up to ``DEPTH`` words that occur ``least`` times within pieces, and ``lang, n``, the occurrences of words.

    Null text counts as empty, null ``lang`` as ``und``. Repeated rows count each time. Texts are read whole, in one pass;
    a task holds the trie of some millions of words, whatever the length of a text; a phrase leaves a shard once with its
    count, so a phrase of every text is no hot key. Very long texts are read in slices.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text")
    rows, total = docs.agg(F.count("*"), F.sum(F.length("text"))).head()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total or 0) // 6 // per_range, 1)
    tries = store(shard_tries(docs, prefix_bounds(docs, ranges, rows)))
    return store(merged_tries(tries, ranges, least)), tries.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, least: int = 10, inside: int = 50, per_range: int = PER_RANGE) -> DataFrame:
    """Phrases of two and three words with ``lang, words, phrase, a, l, r, n, score``.

    A phrase is cut where ``1000000 * a * a / (l * r)``, rounded down, is least (ties: after fewer words); ``l`` and
    ``r`` count its parts. Left parts come from the walk of a trie, right parts over the link from a phrase to the one
    without its first word. Phrases within a longer one that occurs ``inside`` percent as often go. Decimals of 38
    digits keep the arithmetic exact up to 5 * 10^15 occurrences. Empty table: empty result.
    """
    found, n = phrase_counts(docs, least, per_range)

    def of(depth):
        return found.where(F.col("depth") == depth)

    first, second, third = (F.get("words", F.lit(i)) for i in range(3))
    ones = of(1).select("lang", first.alias("last"), F.col("f").alias("r1"))
    twos = of(2).select("lang", "words", F.col("f").alias("a"), "l1", second.alias("last")).join(ones, ["lang", "last"])
    pairs = store(twos.select("lang", "words", "a", F.col("l1").cast("long"), "r1"))
    threes = store(of(3).select("lang", "words", F.col("f").alias("a"), "l1", "l2"))
    links = pairs.select("lang", F.col("words").alias("link"), F.col("a").alias("r1"), F.col("r1").alias("r2"))
    triples = threes.withColumn("link", F.array(second, third)).join(links, ["lang", "link"])

    def score(left, right):
        a, left, right = (F.col(c).cast("decimal(19,0)") for c in ("a", left, right))
        return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right).alias("score")

    within = threes.select("lang", F.explode(F.array(F.array(first, second), F.array(second, third))).alias("words"), F.col("a").alias("longer"))
    within = within.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    free = pairs.join(within, ["lang", "words"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside))
    scored = free.select("lang", "words", "a", F.col("l1").alias("l"), F.col("r1").alias("r"), score("l1", "r1"))
    cuts = triples.select("lang", "words", "a", *(f"{x}{k}" for x in "lr" for k in (1, 2)), score("l1", "r1").alias("s1"), score("l2", "r2").alias("s2"))
    cuts = cuts.select("lang", "words", "a", *(F.when(F.col("s1") <= F.col("s2"), F.col(f"{x}1")).otherwise(F.col(f"{x}2")).alias(x) for x in "lr"), F.least("s1", "s2").alias("score"))
    return scored.unionByName(cuts).join(n, "lang").withColumn("phrase", F.array_join("words", " "))


def best_collocations(found: DataFrame, most: int = 2000) -> DataFrame:
    """Each language's first ``most``, with ``rank``: by score, then count, both descending, then by the bytes of the phrase. Salted parts are ranked first, so that one task ranks only what their firsts leave."""
    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    return few.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases: ``lang, rank, phrase, a, l, r, n, score``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text")
    best = best_collocations(collocations(docs))
    return best.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", F.col("score").cast("long"))


OP13_SQL = r"""
WITH piece AS (
  SELECT lang, row_number() OVER () AS pid, regexp_extract_all(p, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
        FROM documents)
), word AS (
  SELECT lang, pid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM piece
), gram AS (
  SELECT lang, w AS x, lead(w) OVER pieces AS y, lead(w, 2) OVER pieces AS z FROM word WINDOW pieces AS (PARTITION BY pid ORDER BY i)
), f1 AS (
  SELECT lang, x, count(*)::HUGEINT AS f FROM gram GROUP BY ALL
), f2 AS (
  SELECT lang, x, y, count(*)::HUGEINT AS f FROM gram WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), f3 AS (
  SELECT lang, x, y, z, count(*)::HUGEINT AS f FROM gram WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang
), longer AS (
  SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL
), cut AS (
  SELECT c.lang, c.x || ' ' || c.y AS phrase, c.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.x = c.x JOIN f1 r ON r.lang = c.lang AND r.x = c.y
  LEFT JOIN longer t ON t.lang = c.lang AND t.x = c.x AND t.y = c.y WHERE t.f IS NULL OR 100 * t.f < 50 * c.f
  UNION ALL
  SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 1, l.f, r.f
  FROM f3 c JOIN f1 l ON l.lang = c.lang AND l.x = c.x JOIN f2 r ON r.lang = c.lang AND r.x = c.y AND r.y = c.z
  UNION ALL
  SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 2, l.f, r.f
  FROM f3 c JOIN f2 l ON l.lang = c.lang AND l.x = c.x AND l.y = c.y JOIN f1 r ON r.lang = c.lang AND r.x = c.z
), scored AS (
  SELECT *, 1000000 * a * a // (l * r) AS score FROM cut
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY 1000000 * a * a // (l * r), k) = 1
), ranked AS (
  SELECT s.*, n, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored s JOIN total t ON t.lang = s.lang
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
