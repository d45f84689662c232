"""Near-duplicate documents by SetSketch registers (operator 10).

1. Each document's set of distinct word shingles gives ``REGISTERS`` registers:
   the smallest of exponential variates per register, as a truncated exponent
   to base ``BASE``.  Registers merge by maximum.  Documents with equal sets
   are one node from here on.
2. Bands of ``ROWS`` registers deal the nodes into buckets.  At similarity 0.75
   a pair shares no bucket with a probability of about 3e-7.
3. Candidates, in rounds: every member of a bucket with its smallest member;
   then, of the members that known links do not yet connect with that one, four,
   and at last all that are still open, with every member that they are not
   connected with.  A group of m copies so takes about m
   pairs a round, no pair is tried twice, and no link between different texts
   is lost.  Shingles that no node of another component has bound the intersection:
   with m = the smaller count of other shingles, similarity is at most
   m / (n1 + n2 - m).  A bitmap of those other shingles' hashes lowers m: a bit
   that only one of two nodes has stands for a shingle that the other lacks.
   Pairs under the threshold by that are not formed.
4. The joint likelihood of two nodes' registers estimates their similarity; a
   pair stays unless it is 5 standard errors under the threshold.
5. What stays is confirmed on the full sets, and components of the links follow.

Documents without words or text have an empty set and link with nothing.  Rows
that share a doc_id are one document, linked if any of its texts is; repeated
rows each come back.  A null doc_id takes no part: its component is null and it
is kept.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut_lineage, unused
from .components import components
from .shingles import WordHashes, shingle_set

REGISTERS, ROWS = 160, 4
#: SetSketch parameters: base and rate; exponents end at 65535.
BASE, RATE = 1.001, 20.0
#: 64-bit words of a bitmap of shared shingles.
LANES = 8


def registers(hashes, starts):
    """uint16 registers of each of the sets that begin at ``starts`` in ``hashes``."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(7))
    odd = rng.integers(1 << 63, size=REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mask = rng.integers(1 << 63, size=REGISTERS, dtype=np.uint64)
    low = np.empty((len(starts), REGISTERS), np.uint64)
    for i in range(REGISTERS):
        low[:, i] = np.minimum.reduceat((hashes ^ mask[i]) * odd[i], starts)
    x = -np.log1p(-(low.astype(float) + 0.5) / 2.0 ** 64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, 65535).astype("<u2")


def similarity(u, v, n, m):
    """Maximum-likelihood similarity of sets of sizes n and m from their registers."""
    import numpy as np

    a = (n / (n + m))[:, None]
    more, less = (u > v).sum(axis=1)[:, None], (u < v).sum(axis=1)[:, None]
    same = REGISTERS - more - less
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(a / (1 - a), (1 - a) / a)

    def part(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = part(a - (1 - a) * j), part(1 - a - a * j)
    like = more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + same * np.log(np.maximum(1 - up - down, 1e-12))
    return np.take_along_axis(j, like.argmax(axis=1)[:, None], axis=1)[:, 0]


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, regs) of every row; the last two null for empty sets."""
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sets = [shingle_set(hashes.of(t), k) for t in b.column(1).to_pylist()]
                full = [s for s in sets if len(s)]
                regs = iter(())
                if full:
                    starts = np.cumsum([0, *(len(s) for s in full[:-1])])
                    regs = iter(registers(np.concatenate(full), starts))
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                     pa.array([next(regs).tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["doc_id", "n_shingles", "set_key", "regs"])
    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, regs binary")


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose registers do not speak against ``threshold``."""
    side = nodes.select("node", F.struct("n_shingles", "regs").alias("s"))
    rows = (pairs.join(side.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")
            .join(side.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
            .select("a", "b", "x.n_shingles", "x.regs", F.col("y.n_shingles").alias("m"), F.col("y.regs").alias("regs2")))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            u, v = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(-1, REGISTERS) for i in (3, 5))
            j = similarity(u, v, b.column(2).to_numpy().astype(float), b.column(4).to_numpy().astype(float))
            keep = pa.array(j + 5 * np.sqrt(threshold * (1 - threshold) / REGISTERS) >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])
    return rows.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    rows = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes, known = WordHashes(), {}

        def get(i, text):
            if (i, text) not in known:
                if len(known) > 500:
                    known.clear()
                known[i, text] = shingle_set(hashes.of(text), k)
            return known[i, text]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                keep = []
                for i, j, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    s, t = get(i, x), get(j, y)
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])
    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sets = cut_lineage(document_sets(docs, k))
    full = sets.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    groups = full.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    nodes = cut_lineage(groups)

    width = 2 * ROWS
    bands = nodes.select("node", F.posexplode(F.expr(f"transform(sequence(0, {REGISTERS // ROWS - 1}), i -> substring(regs, i * {width} + 1, {width}))")))
    bands = bands.select("node", F.xxhash64("pos", "col").alias("key"))
    hubs = bands.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("key", "hub")
    members = cut_lineage(bands.join(hubs, "key"))

    # Rows that share a doc_id but not a text are one document.
    same = full.join(nodes.select("set_key", "node"), "set_key").filter("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct()
    comp = components(_links(members, nodes, docs, k, percent).union(same))

    out = sets.select("doc_id", "n_shingles").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"),
                      F.coalesce(F.coalesce("comp", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _links(members: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what the buckets of ``members`` (key, node, hub)
    hold, each confirmed or between two nodes that confirmed ones connect; pairs
    that others connect are not tried."""
    ids = members.select(F.col("node").alias("doc_id")).distinct()
    texts = cut_lineage(docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))

    def confirmed(pairs):
        return _confirmed(cut_lineage(_likely(pairs, nodes, percent / 100)), texts, k, percent)
    tried = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = confirmed(tried)
    had = rare = None
    for turns in (4, None):
        comp = components(links)
        named = cut_lineage(
            members.join(comp.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            .join(comp.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp")).hint("merge"), "hub", "left")
            .withColumn("away", F.col("comp") != F.coalesce("hub_comp", "hub")).select("key", "node", "hub", "comp", "away"))
        links = comp.select(F.col("comp").alias("a"), F.col("node").alias("b"))
        away = named.filter("away").select("key", "node", "comp")
        away = away if had is None else away.join(had.hint("merge"), ["key", "node"], "left_anti")
        if rare is None:
            rare = cut_lineage(_shared(named.join(away.select("key").distinct(), "key", "left_semi"), nodes, texts, k))
        now = away.join(rare.hint("merge"), "node")
        if turns:
            turn = W.partitionBy("key").orderBy(F.col("n") - F.col("m"), "node")
            now = now.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= turns).drop("turn")
        now = cut_lineage(now)
        if now.isEmpty():
            return links
        others = (named.filter("node <> hub").select(F.col("key").alias("key2"), F.col("node").alias("other"), F.col("comp").alias("other_comp"))
                  .join(now.select(F.col("key").alias("key2")).distinct().hint("merge"), "key2", "left_semi")
                  .join(rare.select(F.col("node").alias("other"), F.col("n").alias("n2"), F.col("m").alias("m2"),
                               *[F.col(f"bits{i}").alias(f"other{i}") for i in range(LANES)]), "other"))
        least = percent * (F.col("n") + F.col("n2"))
        can = (((100 + percent) * F.least("m", "m2") >= least)
               & ((100 + percent) * (F.col("m") - _lacking("bits", "other")) >= least) & ((100 + percent) * (F.col("m2") - _lacking("other", "bits")) >= least))
        pairs = cut_lineage(now.join(others, (F.col("key") == F.col("key2")) & (F.col("comp") != F.col("other_comp")) & can)
                            .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
                            .join(tried.hint("merge"), ["a", "b"], "left_anti"))
        links, tried, had = links.union(confirmed(pairs)), tried.union(pairs), now.select("key", "node")
    # The second turn tried all that were still open.
    return links


def _lacking(x: str, y: str) -> Column:
    """Bits of the bitmap in columns ``x0``, ... that the one in ``y0``, ... has not."""
    return F.expr(" + ".join(f"bit_count({x}{i} & ~{y}{i})" for i in range(LANES)))


def _shared(open_members: DataFrame, nodes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(node, n, m, bits0, ...): shingles of each open node, how many of them a node of
    another component has, and a bitmap of those."""
    ids = open_members.select(F.col("node").alias("doc_id"), "comp").distinct()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sets = [shingle_set(hashes.of(t), k) for t in b.column(1).to_pylist()]
                node = np.repeat(b.column(0).to_numpy(), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(np.concatenate(sets).view(np.int64))], ["node", "shingle"])
    each = texts.join(ids.select("doc_id"), "doc_id", "left_semi").mapInArrow(run, "node long, shingle long")
    each = cut_lineage(each.join(ids.withColumnRenamed("doc_id", "node"), "node"))
    several = each.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("shingle")
    bit = F.expr("shiftleft(1L, cast(shiftright(shingle, 4) & 63 AS int))")
    lanes = [F.bit_or(F.when(F.col("shingle").bitwiseAND(LANES - 1) == i, bit)).alias(f"bits{i}") for i in range(LANES)]
    shared = each.join(several, "shingle").groupBy("node").agg(F.count("*").alias("shared"), *lanes)
    # A node of several texts has no bound of its own: all its shingles count as shared.
    sized = nodes.groupBy("node").agg(F.max("n_shingles").alias("n"), F.count("*").alias("texts"))
    return (ids.select(F.col("doc_id").alias("node")).join(sized, "node").join(shared, "node", "left")
            .select("node", F.when(F.col("texts") == 1, F.col("n")).otherwise(F.lit(0)).alias("n"),
                    F.when(F.col("texts") == 1, F.coalesce("shared", F.lit(0))).otherwise(F.lit(1 << 40)).alias("m"),
                    *[F.when(F.col("texts") > 1, F.lit(-1).cast("long")).otherwise(F.coalesce(f"bits{i}", F.lit(0).cast("long"))).alias(f"bits{i}") for i in range(LANES)]))


def representatives(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """One row of each group of near-duplicates, with its columns: that of the
    smallest doc_id.  Rows that repeat a doc_id count as one; of differing ones
    the greatest text stays.  Rows with a null doc_id stay as they are."""
    own, best_row = unused(docs, "_id", "_r")
    kept = near_duplicates(docs, k, percent).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(own)).distinct()
    best = docs.join(kept, F.col("doc_id") == F.col(own), "left_semi").groupBy("doc_id").agg(F.max(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias(best_row))
    best = best.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"{best_row}.{c}").alias(c) for c in docs.columns])
    return best.unionByName(docs.filter("doc_id IS NULL"))
