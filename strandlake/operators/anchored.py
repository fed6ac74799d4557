"""Reads placed by columns of family alignments, in stages: seeds choose families, informative columns choose units, identity calls them.

Sequences are strings with one character for each column of their family, ``-`` where they have none: members as
``family, unit, row, residues``, reads as ``read, family, hit, residues``. ``X`` is any other residue.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..lineage import cut

# The residues that entropy counts, what is added to each count, and the strengths of hits, strongest first.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
ADDED = 0.1
STRENGTHS = ["ga", "one", "set", "weak"]


def _letters(text: Column | str) -> Column:
    return F.split(text, "")


def column_seeds(rows: DataFrame, keep: list[str], width: int, every: int = 1) -> DataFrame:
    """Distinct ``keep, seed, word``: the residues of ``width`` columns from each column that ``every`` divides, where all are there."""
    last = F.length("residues") - width
    starts = rows.where(last >= 0).select(*keep, "residues", F.explode(F.sequence(F.lit(0), last - last % every, F.lit(every))).alias("seed"))
    words = starts.select(*keep, "seed", F.substring("residues", F.col("seed") + 1, width).alias("word"))
    return words.where(~F.contains("word", F.lit("-"))).distinct()


def seeded_families(reads: DataFrame, members: DataFrame, width: int, every: int = 1, read_seeds: int = 500_000, unit_seeds: int = 3_000_000) -> DataFrame:
    """``read, family, seeds``: the families that hold the unit with most of a read's distinct seeds, ties kept (``reads``: ``read, residues``, any number of rows a read). A read that shares no seed has none.

    Whole reads are dealt into groups of about ``read_seeds`` rows of seeds and whole units into groups of about
    ``unit_seeds``, and each group of reads meets each of units in a task, where hits are counted: they are no rows. A group
    passes on each read's best families, ties kept. Postings hold a seed once for each unit, whatever its copies. The
    work is still the number of hits, which grows with reads times units.
    """
    seed = F.xxhash64("seed", "word").alias("seed")
    asked = cut(column_seeds(reads.where("read is not null"), ["read"], width, every).select("read", seed))
    held = cut(column_seeds(members.where("family is not null and unit is not null"), ["family", "unit"], width, every).select("family", "unit", seed))
    parts, blocks = (-(-df.count() // rows) or 1 for df, rows in ((asked, read_seeds), (held, unit_seeds)))
    every_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("_p", F.pmod(F.xxhash64("read"), F.lit(parts)).cast("int")).withColumn("_b", every_(blocks))
    right = held.withColumn("_b", F.pmod(F.xxhash64("family", "unit"), F.lit(blocks)).cast("int")).withColumn("_p", every_(parts))
    schema = StructType([asked.schema["read"], held.schema["family"], StructField("seeds", LongType(), False)])
    best = left.groupBy("_p", "_b").cogroup(right.groupBy("_p", "_b")).applyInArrow(lambda a, b: _seed_votes(a, b), schema)
    best = best.groupBy("read", "family").agg(F.max("seeds").alias("seeds"))
    return best.withColumn("_top", F.max("seeds").over(Window.partitionBy("read"))).where("seeds = _top").drop("_top")


def _seed_votes(a, b, most: int = 4_000_000):
    """The best families of a group of reads among a group of units, with their seeds; some reads at a time, so that a table of reads by units has about ``most`` cells."""
    import pyarrow as pa

    none = pa.table({"read": a.column("read").slice(0, 0), "family": b.column("family").slice(0, 0), "seeds": pa.array([], pa.int64())})
    if not a.num_rows or not b.num_rows:
        return none
    b = b.sort_by([("family", "ascending"), ("unit", "ascending")])
    family, unit = (b.column(c).combine_chunks().dictionary_encode() for c in ("family", "unit"))
    f, u = family.indices.to_numpy(), unit.indices.to_numpy()
    new = np.r_[True, (f[1:] != f[:-1]) | (u[1:] != u[:-1])]
    column, of_unit = np.cumsum(new) - 1, f[new]  # units of a family lie side by side
    starts = np.flatnonzero(np.r_[True, of_unit[1:] != of_unit[:-1]])
    n_units, seed = len(of_unit), b.column("seed").to_numpy()
    order = np.argsort(seed, kind="stable")
    seed, column = seed[order], column[order]
    read = a.column("read").combine_chunks().dictionary_encode()
    order = np.argsort(read.indices.to_numpy(), kind="stable")
    row, own = read.indices.to_numpy()[order], a.column("seed").to_numpy()[order]
    first = np.searchsorted(seed, own, "left")
    size = np.searchsorted(seed, own, "right") - first
    out = []
    step = max(1, most // n_units)
    for r0 in range(0, len(read.dictionary), step):
        r1 = min(r0 + step, len(read.dictionary))
        p0, p1 = np.searchsorted(row, [r0, r1])
        n = size[p0:p1]
        hit = np.repeat(first[p0:p1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        votes = np.bincount(np.repeat(row[p0:p1] - r0, n) * n_units + column[hit], minlength=(r1 - r0) * n_units).reshape(r1 - r0, n_units)
        of_family = np.maximum.reduceat(votes, starts, axis=1)
        top = of_family.max(axis=1, keepdims=True)
        r, c = np.nonzero((of_family == top) & (top > 0))
        out.append((r + r0, of_unit[starts[c]], of_family[r, c]))
    r, c, n = (np.concatenate(x) for x in zip(*out))
    return pa.table({"read": read.dictionary.take(pa.array(r)), "family": family.dictionary.take(pa.array(c)), "seeds": n.astype(np.int64)})


def informative_columns(members: DataFrame) -> DataFrame:
    """``family, col, entropy`` over the first row of each unit, in bits; each residue counts ``ADDED`` more than it comes, so that columns of few sequences say less."""
    first = members.groupBy("family", "unit").agg(F.min(F.struct("row", "residues"))["residues"].alias("residues"))
    cells = first.select("family", F.posexplode(_letters("residues")).alias("col", "residue"))
    known = F.contains(F.lit(RESIDUES), F.col("residue"))
    counts = cells.groupBy("family", "col", "residue").agg(F.count_if(known).alias("c"))
    seen = counts.groupBy("family", "col").agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("kinds"), F.sum((F.col("c") + ADDED) * F.log2(F.col("c") + ADDED) * F.signum(F.col("c"))).alias("s"))
    total = F.col("n") + len(RESIDUES) * ADDED
    absent = (len(RESIDUES) - F.col("kinds")) * ADDED * F.log2(F.lit(ADDED))
    return seen.select("family", "col", (F.log2(total) - (F.col("s") + absent) / total).alias("entropy"))


def read_anchors(hits: DataFrame, entropy: DataFrame, n: int) -> DataFrame:
    """``read, family, anchors``: the ``n`` columns of most entropy that a read covers, ties to the first, with the read's residue there, the last in the alphabet if its hits differ.

    Columns are rated to a millionth, so that sums in another order choose alike. ``anchors`` are structs of ``col, residue``
    in the order of columns. A family has one row of columns here, and a read one of hits.
    """
    rated = entropy.groupBy("family").agg(F.sort_array(F.collect_list(F.struct((-F.round("entropy", 6)).alias("e"), "col"))).alias("rated"))
    merged = hits.groupBy("read", "family").agg(F.collect_set("residues").alias("all")).join(rated, "family")
    at = F.transform("rated", lambda c: F.struct(c["col"].alias("col"), F.array_max(F.transform("all", lambda s: F.substr(s, c["col"] + 1, F.lit(1)))).alias("residue")))
    anchors = F.array_sort(F.slice(F.filter(at, lambda c: (c["residue"] != "-") & (c["residue"] != "")), 1, n))
    return merged.select("read", "family", anchors.alias("anchors"))


def _met(asked: DataFrame, members: DataFrame, run, schema: StructType, reads: int = 2_000, rows: int = 4_000) -> DataFrame:
    """``run`` of every block of about ``reads`` of a family's ``asked`` and every one of about ``rows`` of its ``members``, whole units together, as Arrow tables."""
    size = lambda df, n, name: df.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
    sizes = cut(size(asked, reads, "_parts").join(size(members, rows, "_blocks"), "family"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    left = asked.join(sizes, "family").withColumn("_p", dealt("read", "_parts")).withColumn("_b", every("_blocks")).drop("_parts", "_blocks")
    right = members.join(sizes, "family").withColumn("_b", dealt("unit", "_blocks")).withColumn("_p", every("_parts")).drop("_parts", "_blocks")
    by = ["family", "_p", "_b"]

    def whole(a, b):
        import pyarrow as pa

        names = [f.name for f in schema]
        if not a.num_rows or not b.num_rows:
            return pa.table({c: pa.nulls(0) for c in names})
        return run(a, b.sort_by([("unit", "ascending"), ("row", "ascending")])).select(names)

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(whole, schema)


def _points(texts: list[str], width: int) -> np.ndarray:
    """Code points of ``texts``, a row each, filled up with ``-``."""
    return np.array([t[:width].ljust(width, "-") for t in texts], f"U{width}").view(np.uint32).reshape(len(texts), width)


class _Members:
    """A block of members, sorted by unit and row, as matrices of 0 and 1 by which reads are multiplied."""

    def __init__(self, b):
        texts = b["residues"].to_pylist()
        self.width = max(1, *map(len, texts))
        points = _points(texts, self.width)
        self.letters = np.unique(points[points != ord("-")])
        self.cells = self.hot(points, self.letters).T.copy()
        self.there = (points != ord("-")).astype(np.float32).T.copy()
        units = b["unit"].to_pylist()
        self.starts = np.array([i for i, u in enumerate(units) if not i or u != units[i - 1]])

    @staticmethod
    def hot(points: np.ndarray, letters: np.ndarray) -> np.ndarray:
        return (points[:, :, None] == letters).reshape(len(points), -1).astype(np.float32)

    def agreement(self, anchors: list) -> np.ndarray:
        """How many anchors of each read each row has."""
        at = {chr(c): i for i, c in enumerate(self.letters)}
        one = np.zeros((len(anchors), self.cells.shape[0]), np.float32)
        for i, row in enumerate(anchors):
            for x in row:
                if x["residue"] in at and x["col"] < self.width:
                    one[i, x["col"] * len(self.letters) + at[x["residue"]]] = 1
        return one @ self.cells


def _chunks(a, size: int = 128):
    for lo in range(0, a.num_rows, size):
        yield a.slice(lo, size)


def _agreements(a, b, n: int):
    """``read, family, hist``: how many units' best row agrees with 0, 1, ... ``n`` of a read's anchors."""
    import pyarrow as pa

    m, out = _Members(b), []
    for x in _chunks(a):
        best = np.maximum.reduceat(m.agreement(x["anchors"].to_pylist()), m.starts, axis=1).astype(np.int64)
        flat = np.bincount((np.arange(len(best))[:, None] * (n + 1) + best).ravel(), minlength=len(best) * (n + 1))
        out += flat.reshape(len(best), n + 1).tolist()
    return pa.table({"read": a["read"], "family": a["family"], "hist": pa.array(out, pa.list_(pa.int64()))})


def _rated(a, b, least_share: float, near: float):
    """``read, family, unit, row, matches, columns`` of the units that come within ``near`` of a read's best in the block."""
    import pyarrow as pa

    m, size = _Members(b), b.num_rows
    plain = np.repeat((m.letters != ord("X"))[None], m.width, axis=0).ravel()
    cells = m.cells * plain[:, None].astype(np.float32)
    which, rows, matches, columns, seen = [], [], [], [], 0
    for x in _chunks(a):
        lists = x["hits"].to_pylist()
        first = np.cumsum([0, *map(len, lists)])[:-1]
        texts = [t for r in lists for t in r]
        n = np.array([len(t) - t.count("-") for t in texts], np.int64)
        points = _points(texts, m.width)
        shared = ((points != ord("-")).astype(np.float32) @ m.there).astype(np.int64)
        same = (m.hot(points, m.letters) @ cells).astype(np.int64)
        ok = shared >= least_share * n[:, None]
        best = np.maximum.reduceat(np.where(ok, same * (m.width + 1) + shared, -1), m.starts, axis=1)
        found = np.maximum(best, 0)
        hit_m, hit_s = (np.add.reduceat(v, first, axis=0) for v in (found // (m.width + 1), found % (m.width + 1)))
        total = np.add.reduceat(np.where(ok, same, 0), first, axis=0) * size + np.arange(size)[::-1]
        row = np.maximum.reduceat(np.where(np.logical_or.reduceat(ok, first, axis=0), total, -1), m.starts, axis=1)
        cols = np.add.reduceat(n, first)[:, None]
        may = (np.maximum.reduceat(best, first, axis=0) >= 0) & (hit_s > 0) & (hit_s >= least_share * cols)
        bar = x["bar"].to_numpy()[:, None]
        may &= np.maximum.reduceat(m.agreement(x["anchors"].to_pylist()), m.starts, axis=1) >= bar
        identity = np.where(may, hit_m / np.maximum(cols, 1), -1.0)
        i, u = np.nonzero(may & (identity >= identity.max(axis=1, keepdims=True) - near))
        which.append(i + seen)
        rows.append(size - 1 - row[i, u] % size)
        matches.append(hit_m[i, u])
        columns.append(cols[i, 0])
        seen += x.num_rows
    which, rows = pa.array(np.concatenate(which)), pa.array(np.concatenate(rows))
    return pa.table({"read": a["read"].take(which), "family": a["family"].take(which), "unit": b["unit"].take(rows), "row": b["row"].take(rows), "matches": np.concatenate(matches), "columns": np.concatenate(columns)})


def route_calls(hits: DataFrame, members: DataFrame, n: int, keep: float, least_share: float = 0.6, near: float = 0.02) -> DataFrame:
    """``read, family, unit, called, row, matches, columns, identity, candidates, strength``: each read's best units in its best family, ties kept (``called``), and those within ``near`` of their identity.

    A candidate's identity is its matches over all columns of the read's hits in the family, each hit on the unit's row
    with most matches (then most shared columns) among those that share ``least_share`` of the hit's columns; a unit must
    share as much of them all. ``X`` matches nothing. ``row`` is the one with most matches over all hits, ties to the least.
    Of families with equal identity the least is taken. ``strength`` is that of the family's strongest hit (``hits`` may
    have a column ``strength``; else null).

    Blocks of a family's reads meet blocks of its whole units in a task each, twice: first for how many units agree with
    each read's anchors how often, which gives the cut, then for the identity of those above it. Of these a block passes on
    what comes near its best, so that neither pairs nor candidates are ever rows. The work is reads times units of a
    family, as the cut by a share of the units asks for; what is shuffled are sequences, once for each block.

    Reads without a unit that shares enough have no rows. Repeated hits count as often as they come; a null residue string
    is no hit; empty tables give an empty result.
    """
    if "strength" not in hits.columns:
        hits = hits.withColumn("strength", F.lit(None).cast("string"))
    hits = cut(hits.where("residues is not null").select("read", "family", "strength", "residues"))
    members = cut(members.where("residues is not null and unit is not null").select("family", "unit", "row", "residues"))
    anchored = read_anchors(hits, cut(informative_columns(members)), n)
    gathered = hits.where("read is not null").groupBy("read", "family").agg(F.collect_list("residues").alias("hits"))
    asked = cut(gathered.join(anchored, ["read", "family"]))

    told_hist = StructType([asked.schema["read"], asked.schema["family"], StructField("hist", ArrayType(LongType()))])
    counted = _met(asked, members, lambda a, b: _agreements(a, b, n), told_hist)
    hist = cut(counted.groupBy("read", "family").agg(F.array(*(F.sum(F.col("hist")[i]) for i in range(n + 1))).alias("hist")))
    above = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.aggregate(F.slice("hist", i + 1, F.lit(n + 1)), F.lit(0).cast("long"), lambda x, y: x + y))
    wanted = F.greatest(F.ceil(F.lit(keep) * F.col("above")[0]), F.lit(1))
    cuts = hist.withColumn("above", above).withColumn("bar", F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.lit(n)), lambda i: F.get("above", i) >= wanted)), F.lit(0)))
    cuts = cut(cuts.select("read", "family", "bar", F.get("above", F.col("bar")).alias("candidates")))

    key = ["read", "family", "unit"]
    fields = [asked.schema["read"], *(members.schema[c] for c in ("family", "unit", "row")), *(StructField(c, LongType()) for c in ("matches", "columns"))]
    rated = _met(asked.join(cuts.select("read", "family", "bar"), ["read", "family"]), members, lambda a, b: _rated(a, b, least_share, near), StructType(fields))
    rated = cut(rated.withColumn("identity", F.col("matches") / F.col("columns")))
    strength = F.min(F.array_position(F.array(*map(F.lit, STRENGTHS)), F.col("strength")))
    strengths = hits.groupBy("read", "family").agg(strength.alias("_s"))
    top = rated.groupBy("read", "family").agg(F.max("identity").alias("top")).groupBy("read").agg(F.min(F.struct((-F.col("top")).alias("top"), "family")).alias("b"))
    told = rated.join(top.select("read", F.col("b.family").alias("family"), (-F.col("b.top")).alias("top")), ["read", "family"]).where(F.col("identity") >= F.col("top") - near).join(cuts.drop("bar"), ["read", "family"]).join(strengths, ["read", "family"])
    named = F.when(F.col("_s") > 0, F.element_at(F.array(*map(F.lit, STRENGTHS)), F.col("_s").cast("int")))
    return told.select(*key, (F.col("identity") == F.col("top")).alias("called"), "row", "matches", "columns", "identity", "candidates", named.alias("strength"))
