"""Mixing sources to target weights (operator 3, DataFrame functions only).

Each source's documents follow one another in a stream of words, which is cut
into blocks of ``block`` words.  The mixture has ``share`` of all words, in
output shards of ``shard_slots`` block slots.

Targets: sources in code-point order (null last) weigh ``weights`` in turn; a
source gets its weight's part, at most ``most`` times its size, and the excess
is shared anew by weight until none is above.  ``least`` (times the size) is
given to every source beforehand.

Slots: a source is due round(target / mean block size) blocks.  The sources of
all slots come from one pseudorandom permutation of the slot numbers, so a
shard's source counts are a multinomial draw given those totals (independent
draws would miss small targets by their spread).  The j-th slot of a source
takes block p(j) in pass j // blocks, p a swap-or-not permutation of the block
numbers keyed by source and pass; blocks are joined by (source, index).

All draws are hashes of the seed, so reruns agree.  Null text and text without
words have size 0 and take nothing; a null source is a source; repeated rows
are documents of their own.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, counted_anew, cut_lineage, plain_text, unused

#: Stream buckets of a source, so that no window holds a whole source.
_BUCKETS = 1024
_ROUNDS = 24


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """Image of ``i`` under a swap-or-not permutation of 0 .. n - 1."""
    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("k"), r, *key), n) - at, n)
        swap = F.pmod(F.xxhash64(F.lit("b"), r, F.greatest(at, other), *key), F.lit(2)) == 1
        return F.when(swap, other).otherwise(at)
    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), i.cast("long"), step)


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.regexp_count(plain_text(), F.lit(WORD)).cast("long").alias("size"))


def targets(sized: DataFrame, block: int, share: float, weights: tuple, most: float, least: float) -> DataFrame:
    """(source, source_size, target, blocks, due, first): one row a source;
    ``first`` is the number of slots due to the sources before it."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source from here on.
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", cycle).withColumn("room", F.col("source_size") * F.lit(most - least))
    fill = W.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    level = ((F.sum("source_size").over(whole) * F.lit(share - least) - F.coalesce(F.sum("room").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
             / F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
    by = by.withColumn("level", level).withColumn("at", F.row_number().over(fill))
    full = F.col("room") <= F.col("level") * F.col("weight")
    rest = F.min(F.when(~full, F.struct("at", "level"))).over(whole).getField("level")
    by = by.withColumn("target", F.col("source_size") * F.lit(least) + F.when(full, F.col("room")).otherwise(F.col("weight") * rest))
    blocks = F.ceil(F.col("source_size") / F.lit(block))
    due = F.least(F.rint(F.col("target") * blocks / F.col("source_size")).cast("long"), F.floor(blocks * F.lit(most)))
    by = by.withColumn("blocks", blocks).withColumn("due", F.when(F.col("source_size") > 0, due).otherwise(F.lit(0)))
    before = F.coalesce(F.sum("due").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return by.select("source", "source_size", "target", "blocks", "due", before.alias("first"))


def streams(sized: DataFrame) -> DataFrame:
    """``sized`` with ``start``, each document's place in its source's stream."""
    rows = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(_BUCKETS)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    base = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), base.alias("base"))
    inner = W.partitionBy("source", "bucket").orderBy("doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    return (rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
            .join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
            .select("doc_id", "source", "size", (F.col("base") + F.col("inner")).alias("start")))


def slots(by: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, source, pass, block): the block that each output slot takes."""
    spark = by.sparkSession
    total = by.agg(F.coalesce(F.sum("due"), F.lit(0))).first()[0]
    span = max(1024, total >> 20)  # at most about a million rows of this table
    parts = (by.filter("due > 0").withColumn("part", F.explode(F.expr(f"sequence(first div {span}, (first + due - 1) div {span})"))))
    drawn = spark.range(total).select(F.col("id").alias("slot"))
    drawn = drawn.withColumn("at", permuted(F.col("slot"), F.lit(total), F.lit(seed)))
    drawn = drawn.withColumn("part", F.expr(f"at div {span}"))
    j = F.col("at") - F.col("first")
    return (drawn.join(parts, "part").filter((F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("due")))
            .select(F.expr(f"slot div {shard_slots}").alias("shard"), "slot", "source", "blocks", F.floor(j / F.col("blocks")).alias("pass"), F.pmod(j, F.col("blocks")).alias("i"))
            .select("shard", "slot", "source", "pass", permuted(F.col("i"), F.col("blocks"), F.lit(seed), F.coalesce("source", F.lit("\0")), F.col("pass")).alias("block")))


def pieces(rows: DataFrame, picks: DataFrame, block: int) -> DataFrame:
    """(doc_id, source, size, start, block, from_word, words, times): the words of
    each document in each block of its source, and how often the mixture takes them."""
    cut = rows.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    low = F.greatest(F.col("block") * block, F.col("start"))
    high = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size"))
    cut = cut.withColumn("from_word", low - F.col("start")).withColumn("words", high - low)
    times = picks.groupBy("source", "block").agg(F.count("*").alias("times")).select(F.col("source").alias("s"), F.col("block").alias("b"), "times")
    return (cut.join(times, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
            .drop("s", "b").withColumn("times", F.coalesce("times", F.lit(0))))


def _plan(docs: DataFrame, block: int, shard_slots: int, share: float, weights: tuple, most: float, least: float, seed: int):
    sized = cut_lineage(sizes(docs))
    by = cut_lineage(targets(sized, block, share, weights, most, least))
    picks = slots(by, shard_slots, seed)
    return sized, by, pieces(streams(sized), picks, block)


def mixture(docs: DataFrame, block: int = 64, shard_slots: int = 1024, share: float = 1.5, weights: tuple = (3, 1, 2),
            most: float = 2.0, least: float = 0.0, seed: int = 11) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) for each row of ``docs``."""
    sized, by, cut = _plan(docs, block, shard_slots, share, weights, most, least, seed)
    taken = (cut.groupBy("source", "start", "doc_id", "size").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
             .select("doc_id", "source", "size", "taken")
             .unionByName(sized.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))))
    by = by.select(F.col("source").alias("s"), "source_size", "target")
    return (taken.join(by, F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "size", "source", "source_size", "target", "taken"))


def mixed_documents(docs: DataFrame, block: int = 64, share: float = 1.5, weights: tuple = (3, 1, 2), most: float = 2.0, seed: int = 11) -> DataFrame:
    """``docs`` as the mixture has them when every word is taken once at least:
    words of blocks drawn again follow the text after a line break, and
    ``n_chars`` is counted anew.  Rows that share a doc_id get what any of them drew."""
    _, _, cut = _plan(docs, block, 1024, share, weights, most, 1.0, seed)
    own, drawn, split = unused(docs, "mix_id", "mix_more", "mix_words")
    again = (cut.filter("times > 1 AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(own))
             .agg(F.array_sort(F.collect_set(F.struct("from_word", "words"))).alias(drawn)))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    more = F.transform(drawn, lambda p: F.array_join(F.slice(F.col(split), (p["from_word"] + 1).cast("int"), p["words"].cast("int")), " "))
    out = docs.join(again, F.col("doc_id") == F.col(own), "left").withColumn(split, F.when(F.col(drawn).isNotNull(), words))
    text = F.when(F.col(drawn).isNotNull(), F.concat(F.col("text"), F.lit("\n"), F.array_join(more, "\n"))).otherwise(F.col("text"))
    out = out.withColumn("text", text).drop(own, drawn, split)
    return counted_anew(out, F.col("text").isNotNull()).select(*docs.columns)
