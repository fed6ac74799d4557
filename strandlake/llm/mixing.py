"""Mixing the sources of a corpus to target weights, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FILE, ROW, WORD, identified, store

#: Documents of a source that are sorted together while their places in its stream are counted, on average and at most.
GROUP = 50_000
#: Slots that a task makes.
TASK_SLOTS = 250_000
#: Rounds of the index permutation.
ROUNDS = 16


@dataclass
class Mix:
    """``sources``: ``sid, source, source_size, weight, target, n_blocks``. ``slots``: ``shard, sid, slot`` (number in its source), ``epoch, block``. ``fragments``: what of each document lies in each block: ``FILE, ROW, doc_id, size, sid, block, first, words``; a document without words has one row with a null block."""

    sources: DataFrame
    slots: DataFrame
    fragments: DataFrame

    def shard_counts(self) -> DataFrame:
        """The drawn number of slots of each source in each output shard: ``shard, sid, n``."""
        return self.slots.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))

    def times(self) -> DataFrame:
        """How often the mix takes each block that it takes: ``sid, block, times``."""
        return self.slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))

    def takes(self) -> DataFrame:
        """``fragments`` with ``times`` (0 if never taken), joined by source and block index."""
        return self.fragments.join(self.times(), ["sid", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float, block: int) -> DataFrame:
    """From one row per source: its number by code point (null last), weight, target and number of blocks.

    Targets share ``share`` of all words by weight, none above ``most`` times its source. Resharing the excess until
    none is above ends where one level L gives min(most * size, L * weight); sorted by most * size / weight, the sources
    before the first one that L leaves open are the full ones, so running sums give L. One row per source is sorted here,
    whatever the number of documents.
    """
    numbered = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(most))
    rows = Window.orderBy("ratio", "sid")
    leveled = (
        numbered.withColumn("weight", weight)
        .withColumn("ratio", full / F.col("weight"))
        .withColumn("filled", F.coalesce(F.sum(full).over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(rows.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
        .withColumn("level", (F.col("total") - F.col("filled")) / F.col("open"))
    )
    best = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.partitionBy())
    target = F.least(full, F.coalesce(F.greatest(best, F.lit(0.0)) * F.col("weight"), full))
    return leveled.select("sid", "source", "source_size", "weight", target.alias("target"), F.ceil(F.col("source_size") / block).alias("n_blocks"))


def permuted(index: str, n: str, keys: str, seed: int) -> Column:
    """The image of column ``index`` under a pseudorandom permutation of [0, ``n``), one for each value of ``keys``.

    Swap-or-not: each round pairs i with (k - i) mod n and swaps the pair or not, by one hashed bit of the pair. Every
    round is a bijection for every n, so nothing is walked, sorted or stored. As a lambda over the rounds the expression
    stays small; written out, it would triple with each.
    """
    partner = f"pmod(pmod(xxhash64({seed}, r, {keys}), {n}) + {n} - x, {n})"
    swap = f"(xxhash64({seed + 1}, r, {keys}, greatest(x, {partner})) & 1) = 1"
    return F.expr(f"coalesce(aggregate(sequence(1, {ROUNDS}), {index}, (x, r) -> if({swap}, {partner}, x)), 0L)")


def drawn_slots(sources: DataFrame, shard_slots: int, most: int, seed: int) -> DataFrame:
    """The source of every slot of every output shard: ``shard, sid, slot, n_blocks``, ``slot`` being its number in its source.

    A source has as many slots as its target holds of its blocks. All slots, in shards of ``shard_slots``, draw their
    source without replacement: a pseudorandom permutation sends each to a place in the line of all sources' slots. A
    shard's counts are thus a multinomial draw by the sources' shares, given that all shards together meet the targets;
    its scatter is that of a multinomial as long as the shard is a small part of the whole. The place within the source's
    part of the line is the slot's number there, so nothing is counted or sorted. Slots are made in as many tasks as their
    number asks for; only that number comes to the driver. The line is cut into 4096 stretches by which slots meet their
    source, so many sources cost no more than few.
    """
    spark = sources.sparkSession
    quota = F.least(F.col("n_blocks") * most, F.greatest(F.round(F.col("n_blocks") * F.col("target") / F.col("source_size")), F.lit(1))).cast("long")
    line = sources.where("source_size > 0 and target > 0").select("sid", "n_blocks", quota.alias("quota"))
    line = line.withColumn("low", F.coalesce(F.sum("quota").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per source
    line = store(line)
    total = line.agg(F.sum("quota")).first()[0] or 0
    wide = total // 4096 + 1
    line = line.withColumn("stretch", F.explode(F.expr(f"sequence(low div {wide}, (low + quota - 1) div {wide})")))
    slots = spark.range(0, total, 1, max(1, -(-total // TASK_SLOTS))).select(F.expr(f"id div {shard_slots}").alias("shard"), permuted("id", f"{total}L", "0", seed + 7).alias("place"))
    met = slots.withColumn("stretch", F.expr(f"place div {wide}")).join(line, "stretch").where("place >= low and place < low + quota")
    return met.select("shard", "sid", (F.col("place") - F.col("low")).alias("slot"), "n_blocks")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, block: int = 64, shard_slots: int = 1024, seed: int = 20) -> Mix:
    """Plan a mix of the sources of ``docs`` (already ``identified``).

    Each source is one stream of words, its documents in an order given by a hash, cut into blocks of ``block`` words
    (the last may be shorter). Output shards have ``shard_slots`` slots (the last what is left); ``drawn_slots`` draws how
    many fall to each source. A source's slots are numbered through all shards; slot j takes block perm_e(j mod n_blocks)
    in epoch e = j div n_blocks, so each block is taken once in every epoch, and never more than ``most`` times.

    Word counts leave the scan once and are stored; documents are dealt by (source, salt) to find their place in the
    stream, with as many salts as keep groups near 50 000 documents, fragments and slots meet by (source, block), so a
    source of a third of all words is spread over all tasks. Null text: size 0. Null source: one source, numbered last.
    Repeated rows are documents of their own, as are ties of ids. A very long text has a row for each of its blocks. Empty
    table: empty results. Other columns are not looked at, whatever their names.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = store(docs.select(FILE, ROW, "doc_id", "source", size.alias("size")))
    salts = max(64, sized.count() // GROUP)
    sized = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size", ROW), F.lit(salts)).cast("int"))
    groups = store(sized.groupBy("source", "salt").agg(F.sum("size").alias("words")))
    sources = store(source_targets(groups.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most, block))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per source and salt: its place in the stream and its source's number.
    numbers = sources.select("sid", F.col("source").alias("h_source"))
    heads = groups.withColumn("before", before).join(numbers, F.col("source").eqNullSafe(F.col("h_source"))).select("h_source", F.col("salt").alias("h_salt"), "before", "sid")
    own = F.coalesce(F.sum("size").over(Window.partitionBy("source", "salt").orderBy("doc_id", ROW, FILE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("own", own).join(heads, F.col("source").eqNullSafe(F.col("h_source")) & (F.col("salt") == F.col("h_salt"))).withColumn("start", F.col("before") + F.col("own"))
    blocks = F.expr(f"if(size > 0, sequence(start div {block}, (start + size - 1) div {block}), cast(null as array<bigint>))")
    cut = placed.select(FILE, ROW, "doc_id", "size", "sid", "start", F.explode_outer(blocks).alias("block"))
    first = F.greatest(F.col("start"), F.col("block") * block)
    last = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    fragments = cut.select(FILE, ROW, "doc_id", "size", "sid", "block", (first - F.col("start")).alias("first"), (last - first).alias("words"))

    slots = drawn_slots(sources, shard_slots, most, seed).select("shard", "sid", "slot", "n_blocks", F.expr("slot div n_blocks").alias("epoch"), F.expr("slot % n_blocks").alias("block"))
    return Mix(sources, slots.withColumn("block", permuted("block", "n_blocks", "sid, epoch", seed)).drop("n_blocks"), fragments)


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them: a row for every pass over a document, with the text of those of its blocks that are taken at least so often; ``n_chars``, if there is such a column, is counted anew. Documents that the mix takes no block of are not in it.

    A text that is taken whole stays as it is; of others the words taken stay with the blanks before them. A text's words
    are parted once for all passes, before the passes part, so that time grows with its length.
    """
    docs = identified(docs)
    takes = mix(docs, **how).takes().where("times > 0")
    taken = takes.groupBy(FILE, ROW, "size").agg(F.sort_array(F.collect_list(F.struct("first", "words", "times"))).alias("__sl_taken"), F.max("times").alias("__sl_most"), F.min("times").alias("__sl_least"), F.sum("words").alias("__sl_words"))
    # A pass takes the text whole if it takes every block.
    taken = taken.select(FILE, ROW, "__sl_taken", "__sl_most", F.when(F.col("__sl_words") == F.col("size"), F.col("__sl_least")).otherwise(0).alias("__sl_whole"))
    rows = docs.join(taken, [FILE, ROW])
    parted = F.when(F.col("__sl_most") > F.col("__sl_whole"), F.expr(r"regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0)"))
    rows = rows.withColumn("__sl_parted", parted).withColumn("__sl_pass", F.explode(F.expr("sequence(1L, __sl_most)")))
    parts = F.expr("array_join(flatten(transform(filter(__sl_taken, x -> x.times >= __sl_pass), x -> slice(__sl_parted, cast(x.first + 1 as int), cast(x.words as int)))), '')")
    rows = rows.withColumn("text", F.when(F.col("__sl_pass") <= F.col("__sl_whole"), F.col("text")).otherwise(parts))
    kept = [c for c in docs.columns if c not in (FILE, ROW)]
    return rows.select(*(F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in kept))


def op1_mixing_sources(spark, sf_dir: str) -> DataFrame:
    """Every document's share in a mix of all documents: ``doc_id, size, source_size, target, taken``."""
    m = mix(identified(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    taken = m.takes().groupBy(FILE, ROW, "doc_id", "size", "sid").agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken"))
    return taken.join(m.sources, "sid").select("doc_id", "size", "source_size", "target", "taken")
