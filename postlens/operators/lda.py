"""LDA topic model by online variational Bayes (M1 - M4, K3 feed).

Hoffman, Blei and Bach (2010), with the topic-word table as a DataFrame of one row a
term: nothing of the size of the vocabulary is on the driver or broadcast.  A step

1. fits the documents of each block of a mini-batch in a task (numpy, step by step together,
   some at a time), which got the rows of its distinct terms;
2. moves the table towards the blocks' counts of each term and topic, and hands out the rows
   that the next blocks need.

All of it goes round packed, a row for ``RANGE`` terms, and a step is one job.  Documents
are packed once, a row each, and dealt evenly by their block.

The document prior (one number a topic) is learned on the driver, the topic prior (one
number a term, a column of the table) by an aggregate, both by Newton steps.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Observation, Window, functions as F
from pyspark.sql.types import StructField, StructType

from ..session import written

_VECTOR = StructType([StructField("v", VectorUDT())])
_SHIFT = 6
#: Terms of documents in a block at most (more or less), and those fitted at once.
BLOCK, AT_ONCE = 1_000_000, 1 << 15
RANGE = 128


def sparse_vector(size, idx, val):
    """MLlib's sparse vector (type 0) from columns, without leaving the JVM."""
    v = F.struct(F.lit(0).cast("tinyint").alias("type"), size.cast("int").alias("size"), idx.cast("array<int>").alias("indices"), val.alias("values"))
    return F.from_json(F.to_json(F.struct(v.alias("v"))), _VECTOR)["v"]


def _digamma(x):
    """Recurrence up to x + 6, then the asymptotic series (error below 1e-8)."""
    import numpy as np

    z = x + _SHIFT
    r = 1 / (z * z)
    return np.log(z) - 0.5 / z - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240))) - sum(1 / (x + i) for i in range(_SHIFT))


def _trigamma(x):
    z = x + _SHIFT
    r = 1 / (z * z)
    return 1 / z + r / 2 + r / z * (1 / 6 - r * (1 / 30 - r / 42)) + sum(1 / (x + i) ** 2 for i in range(_SHIFT))


@dataclass
class TopicModel:
    """``topics`` ``(term_index, lam ARRAY<DOUBLE>, share ARRAY<DOUBLE>, eta)``: k numbers a term,
    ``share`` = exp(digamma(lam)); ``alpha`` and ``totals`` (sums of ``lam``) k numbers each."""
    topics: DataFrame
    alpha: list[float]
    totals: list[float]

    @property
    def k(self) -> int:
        return len(self.alpha)


def _lists(x):
    import numpy as np
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1)))


_STATE = "kind int, range int, block int, terms array<int>, lam array<double>, share array<double>, eta array<double>, v array<double>"
_TOPIC, _SENT, _LOGS = 0, 1, 2


def _prior_parts(lam, eta):
    """A term's parts of the topic prior's next step."""
    k = lam.shape[1]
    iq = -1 / (k * _trigamma(eta))
    return iq, (_digamma(lam).sum(axis=1) - k * _digamma(eta)) * iq


def _learned(lam, eta, pending):
    """``eta`` after the step (rate, rest) that the sums of the table gave; a term that would leave the positive numbers stays."""
    import numpy as np

    if pending is None:
        return eta
    iq, gq = _prior_parts(lam, eta)
    step = eta - pending[0] * (gq + pending[1] * iq)
    return np.where(step > 0, step, eta)


def _groups(batches, *by: str):
    """(values of the columns ``by``, rows) of rows that stand together by them."""
    import numpy as np

    for b in batches:
        if b.num_rows:
            at = np.array([b.column(c).to_numpy() for c in by])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                yield at[:, lo].tolist(), b.slice(lo, hi - lo)


def _step(batches, k: int, seed: int, rate: float = 0.0, scale: float = 0.0, pending=None):
    """Rows (range, part, block, terms, lam, eta, s) of a range of terms together -> ``_STATE``: its topics (part 0) moved
    towards the prior and the counts (part 1), sums of them, and the rows that blocks ask for (part 2).  Topics
    without numbers get random ones, which depend on the term and the seed alone."""
    import numpy as np
    import pyarrow as pa

    names = [c.split()[0] for c in _STATE.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.list_(pa.int32())] + [pa.list_(pa.float64())] * 4

    def row(*cols):
        return pa.RecordBatch.from_arrays([pa.array([None if c is None else c.reshape(-1) if isinstance(c, np.ndarray) else c], t) for c, t in zip(cols, kinds, strict=True)], names)

    def moved():
        new = lam if scale is None else (1 - rate) * lam + rate * (eta[:, None] + scale * s)
        share = np.exp(_digamma(new))
        sums = [*new.sum(axis=0), eta.sum(), *(x.sum() for x in _prior_parts(new, eta))]
        return share, row(_TOPIC, at, None, terms, new, share, eta, np.array(sums))

    at, terms, lam, eta, s, share = None, None, None, None, None, None
    for (place, part), b in _groups(batches, "range", "part"):
        if place != at:
            if at is not None and share is None:
                yield moved()[1] if at >= 0 else row(_LOGS, None, None, None, None, None, None, s.sum(axis=0))
            at, share, s = place, None, np.zeros((1, k))
        if part == 0:
            terms = b.column("terms").flatten().to_numpy()
            if b.column("lam").null_count:
                scale = None                                   # the start
                lam, eta = np.array([np.random.default_rng((seed, int(t))).gamma(100.0, 0.01, k) for t in terms]).reshape(-1, k), np.full(len(terms), 1.0 / k)
            else:
                lam, eta = b.column("lam").flatten().to_numpy().reshape(-1, k), b.column("eta").flatten().to_numpy()
                eta = _learned(lam, eta, pending)
            s = np.zeros_like(lam)
        elif part == 1:
            got = b.column("s").flatten().to_numpy().reshape(-1, k)
            np.add.at(s, np.searchsorted(terms, b.column("terms").flatten().to_numpy()) if at >= 0 else np.zeros(len(got), int), got)
        else:
            if share is None:
                share, topic = moved()
                yield topic
            wanted, n = b.column("terms"), b.num_rows
            ends = np.cumsum(wanted.value_lengths().to_numpy())
            given = pa.ListArray.from_arrays(pa.array(np.append(0, ends) * k, pa.int32()), pa.array(share[np.searchsorted(terms, wanted.flatten().to_numpy())].reshape(-1)))
            none = pa.nulls(n, kinds[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, x, np.int32)) for x in (_SENT, at)] + [b.column("block"), wanted, none, given, none, none], names)
    if at is not None and share is None:
        yield moved()[1] if at >= 0 else row(_LOGS, None, None, None, None, None, None, s.sum(axis=0))


def _unpack(batches, k: int, pending):
    """``_STATE`` rows of topics -> a row a term."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        if b.num_rows:
            lam, share = (b.column(c).flatten().to_numpy().reshape(-1, k) for c in ("lam", "share"))
            eta = _learned(lam, b.column("eta").flatten().to_numpy(), pending)
            yield pa.RecordBatch.from_arrays([b.column("terms").flatten(), _lists(lam), _lists(share), pa.array(np.asarray(eta))], ["term_index", "lam", "share", "eta"])


def _fit(words, n, ends, a, inner: int = 100, tol: float = 1e-3):
    """Variational parameters of documents whose terms end at ``ends``: ``words`` (topics of each
    term), ``n`` (their weights), ``a`` the prior.  Each stops by itself."""
    import numpy as np

    cuts = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
    rows, sizes = [words[lo:hi] for lo, hi in cuts], [n[lo:hi] for lo, hi in cuts]
    gamma = a + np.array([x.sum() for x in sizes])[:, None] / len(a)
    active = np.arange(len(cuts))
    for _ in range(inner):
        old = gamma[active]
        theta = np.exp(_digamma(old) - _digamma(old.sum(axis=1))[:, None])
        got = np.empty_like(theta)
        for i, d in enumerate(active.tolist()):
            w = rows[d]
            got[i] = (sizes[d] / (w @ theta[i])) @ w
        new = a + theta * got
        gamma[active] = new
        active = active[np.abs(new - old).mean(axis=1) >= tol]
        if not len(active):
            break
    return gamma


def _infer(batches, alpha: list[float], totals: list[float], stats: bool, key: str):
    """Fits the documents of the blocks of ``_dealt``.  ``stats``: counts of a block, (range, terms,
    s), where range -1 holds the documents' expected log shares; else (key, probs)."""
    import numpy as np
    import pyarrow as pa

    a, base = np.array(alpha), np.exp(-_digamma(np.array(totals)))
    block, given, terms, beta, total = None, [], None, None, None

    def sums():
        where = np.floor_divide(terms, RANGE)
        heads = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        ends = np.append(heads, len(terms))
        lists = pa.ListArray.from_arrays(pa.array(np.append(ends, len(terms)), pa.int32()), pa.array(terms, pa.int32()))
        counts = pa.ListArray.from_arrays(pa.array(np.append(ends, len(terms) + 1) * len(a), pa.int32()), pa.array(total.reshape(-1)))
        return pa.RecordBatch.from_arrays([pa.array(np.append(where[heads], -1), pa.int32()), lists, counts], ["range", "terms", "s"])

    for (at, fit), part in _groups(batches, "block", "fit"):
        if at != block:
            if stats and terms is not None:
                yield sums()
            block, given, terms = at, [], None
        if not fit:
            given.append((part.column("terms").flatten().to_numpy(), part.column("share").flatten().to_numpy().reshape(-1, len(a))))
            continue
        if terms is None:
            terms, beta = (np.concatenate(x) for x in zip(*given, strict=True))
            o = np.argsort(terms)
            terms, beta = terms[o], beta[o] * base + 1e-100
            total = np.zeros((len(terms) + 1, len(a)))
        sizes = part.column("terms").value_lengths().to_numpy()
        ends = np.cumsum(sizes)
        first = 0
        while first < len(ends):                           # some documents at a time
            before = ends[first - 1] if first else 0
            last = max(int(np.searchsorted(ends, before + AT_ONCE, "right")), first + 1)
            some = part.slice(first, last - first)
            where = np.searchsorted(terms, some.column("terms").flatten().to_numpy())
            n, words = some.column("tf").flatten().to_numpy(), beta[where]
            gamma = _fit(words, n, ends[first:last] - before, a)
            if stats:
                expected = _digamma(gamma) - _digamma(gamma.sum(axis=1))[:, None]
                total[-1] += expected.sum(axis=0)
                words *= np.repeat(np.exp(expected), sizes[first:last], axis=0)
                words *= (n / words.sum(axis=1))[:, None]
                for i in range(len(a)):
                    total[:-1, i] += np.bincount(where, words[:, i], len(terms))
            else:
                yield pa.RecordBatch.from_arrays([some.column("_key"), _lists(gamma / gamma.sum(axis=1)[:, None])], [key, "probs"])
            first = last
    if stats and terms is not None:
        yield sums()


def _range(term):
    return F.floor(term / RANGE).cast("int")


def _packed(bow: DataFrame, key: str, batches: int = 1) -> tuple[DataFrame, int]:
    """``(docs, tasks)`` of a written ``bow``: ``docs`` (_key, batch, block, terms, tf), a row a document."""
    tasks = int(bow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(tasks, -(-bow.count() // (batches * BLOCK)))
    cell = F.struct(F.col("term_index").cast("int").alias("t"), F.col("tf").cast("double").alias("n"))
    docs = bow.filter("term_index IS NOT NULL").groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(cell)).alias("c"))
    docs = docs.select("_key", F.pmod(F.xxhash64("_key"), F.lit(batches)).cast("int").alias("batch"), F.pmod(F.xxhash64(F.lit(1), "_key"), F.lit(blocks)).cast("int").alias("block"),
                       F.transform("c", lambda c: c["t"]).alias("terms"), F.transform("c", lambda c: c["n"]).alias("tf"))
    return written(_near(docs, batches)), tasks


def _near(df: DataFrame, batches: int) -> DataFrame:
    """A batch in few files."""
    return df.repartitionByRange("batch").sortWithinPartitions("batch") if batches > 1 else df


def _dealt(docs: DataFrame, tasks: int, shares: DataFrame) -> DataFrame:
    """The documents of each block together, after their rows of the topics, ``shares`` (block,
    terms, share).  Dealt by a set number of partitions: the rows are small, but fitting them is not."""
    rows = shares.select("block", F.lit(0).alias("fit"), "terms", "share")
    rows = rows.unionByName(docs.select("block", F.lit(1).alias("fit"), "_key", "terms", "tf"), allowMissingColumns=True)
    return rows.repartitionById(tasks, F.col("block") % tasks).sortWithinPartitions("block", "fit")


def _newton(prior, n: float, mean_log):
    """One Newton step of a Dirichlet prior from n draws' mean logarithms; kept if it is positive."""
    grad = n * (_digamma(prior.sum()) - _digamma(prior) + mean_log)
    c, q = n * _trigamma(prior.sum()), -n * _trigamma(prior)
    step = (grad - (grad / q).sum() / (1 / c + (1 / q).sum())) / q
    return prior - step


def fit_lda(bow: DataFrame, k: int = 20, passes: int = 20, seed: int = 42, batch_docs: int = 100_000, key: str = "doc_id",
            learn_priors: bool = True, decay: float = 0.5) -> TopicModel:
    """M1: topics of ``(key, term_index, tf)``; ``tf`` may be any positive weight.

    A pass takes the documents in batches of about ``batch_docs`` (by the hash of the
    key); step t moves the table by (1 + t) ** -decay.  Results do not depend on the
    partitioning but for the order of floating-point sums.
    """
    import numpy as np

    bow = written(bow.select(key, "term_index", "tf"))
    n = bow.select(key).distinct().count()
    batches = max(-(-n // batch_docs), 1)
    docs, tasks = _packed(bow, key, batches)
    held = dict(docs.groupBy("batch").count().collect())
    steps = [t for t in range(passes * batches) if t % batches in held]       # others are batches without documents
    needs = docs.select("batch", "block", F.explode("terms").alias("t")).distinct().groupBy("batch", "block", _range(F.col("t")).alias("range"))
    needs = written(_near(needs.agg(F.sort_array(F.collect_list("t")).alias("terms")), batches))
    topics = docs.select(F.explode("terms").alias("t")).distinct().groupBy(_range(F.col("t")).alias("range")).agg(F.sort_array(F.collect_list("t")).alias("terms"))
    topics = topics.select("range", F.lit(0).alias("part"), "terms")
    empty = docs.sparkSession.createDataFrame([], "range int, part int, block int, terms array<int>, lam array<double>, eta array<double>, s array<double>")
    alpha, pending, counted, rate, scale = [1.0 / k] * k, None, None, 0.0, 0.0
    for i in range(len(steps) + 1):
        rows = empty.unionByName(topics, allowMissingColumns=True)
        if counted is not None:
            rows = rows.unionByName(counted.withColumn("part", F.lit(1)), allowMissingColumns=True)
        if i < len(steps):
            asked = needs.filter(F.col("batch") == steps[i] % batches).select("range", F.lit(2).alias("part"), "block", "terms")
            rows = rows.unionByName(asked, allowMissingColumns=True)
        rows = rows.repartition(tasks, "range").sortWithinPartitions("range", "part")
        seen = Observation()
        state = rows.mapInArrow(partial(_step, k=k, seed=seed, rate=rate, scale=scale, pending=pending), _STATE).observe(
            seen, *[F.sum(F.when(F.col("kind") == kind, F.col("v")[j])).alias(f"{name}{j}") for kind, name, m in ((_TOPIC, "t", k + 3), (_LOGS, "s", k)) for j in range(m)])
        state = written(state)
        sums = seen.get
        if not steps:
            break
        totals, (eta, iq, gq) = [float(sums[f"t{j}"]) for j in range(k)], (float(sums[f"t{k + j}"]) for j in range(3))
        pending = None
        if learn_priors and i:
            size, old = held[steps[i - 1] % batches], np.array(alpha)
            new = old + rate * (_newton(old, size, np.array([sums[f"s{j}"] for j in range(k)]) / size) - old)
            alpha = [float(x) for x in (new if (new > 0).all() else old)]
            # The topic prior's Newton step: each term has its part g / q of the gradient, the
            # rest is the same for all.
            same = k * float(_digamma(eta)) - float(_digamma(np.array(totals)).sum())
            pending = rate, same - (gq + same * iq) / (1 / (k * float(_trigamma(eta))) + iq)
        topics = state.filter(F.col("kind") == _TOPIC).select("range", F.lit(0).alias("part"), "terms", "lam", "eta")
        if i < len(steps):
            rate, scale, at = (1 + steps[i]) ** -decay, n / held[steps[i] % batches], steps[i] % batches
            counted = _dealt(docs.filter(F.col("batch") == at), tasks, state.filter(F.col("kind") == _SENT)).mapInArrow(
                partial(_infer, alpha=alpha, totals=totals, stats=True, key=key), "range int, terms array<int>, s array<double>")
    state = state.filter(F.col("kind") == _TOPIC).mapInArrow(partial(_unpack, k=k, pending=pending), "term_index int, lam array<double>, share array<double>, eta double")
    return TopicModel(written(state), alpha, totals if steps else [1.0] * k)


def document_topics(model: TopicModel, bow: DataFrame, key: str = "doc_id") -> DataFrame:
    """M2: ``(key, probs ARRAY<DOUBLE>)`` with all k entries, for documents with a known term."""
    kind = dict(bow.dtypes)[key]
    docs, tasks = _packed(written(bow.select(key, "term_index", "tf").join(model.topics.select("term_index"), "term_index", "left_semi")), key)
    shares = docs.select("block", F.explode("terms").alias("term_index")).distinct().join(model.topics.select("term_index", "share"), "term_index")
    return _dealt(docs, tasks, shares.withColumn("terms", F.array("term_index"))).mapInArrow(
        partial(_infer, alpha=model.alpha, totals=model.totals, stats=False, key=key), f"`{key}` {kind}, probs array<double>")


def topic_words(model: TopicModel, vocab: DataFrame, n: int = 20) -> DataFrame:
    """M3 / K3: ``(topic_id, word, weight, rank)``, rank 1-based by weight."""
    totals = F.array(*[F.lit(x) for x in model.totals])
    ex = model.topics.select("term_index", F.posexplode(F.zip_with("lam", totals, lambda x, t: x / t)).alias("topic_id", "weight"))
    w = Window.partitionBy("topic_id").orderBy(F.col("weight").desc(), "term_index")
    top = ex.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return (top.join(vocab.select("term_index", F.col("term").alias("word")), "term_index")
            .select(F.col("topic_id").cast("int").alias("topic_id"), "word", "weight", F.col("rank").cast("int").alias("rank")))
