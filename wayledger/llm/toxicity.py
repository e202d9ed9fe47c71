"""Toxicity scores by a small convolutional network over hashed word embeddings.

Words are hashed to embeddings; filters of several widths run over the text and each keeps its
largest response anywhere in it; a linear layer makes a score of these. The network is trained on all
labelled rows where they lie: each epoch every task goes on from the shared network over its own rows,
and the mean of what they come to is the next one. Scores are calibrated to the share of toxic texts
among all labels, with one threshold per language for those who want to act on it.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import materialise, passing_dir

#: Rows that a task trains on at least, where there are so many.
TASK_ROWS = 4_000
#: Scores are counted in steps of one part of so many to calibrate them.
STEPS = 256
BUCKETS = 1 << 20
#: A bucket is learned if so many training texts have it.
MIN_TEXTS = 5
DIMENSION = 8
#: Letters of a word that make its stem.
STEM = 4
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 8
BATCH = 64
SEED = 7
#: Words convolved at once.
SPAN = 1 << 15
#: Distinct words a worker remembers.
MEMORY = 1 << 19
_PAD = max(WIDTHS) - 1


class Rows(dict):
    """Word to a code of its two rows in the embedding table: that of the word and that of its stem.

    Row 0 stands for what was not learned.
    """

    def __init__(self, rows: dict[int, int]):
        super().__init__()
        self.rows, self.base = rows, len(rows) + 1

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        whole, stem = buckets(word)
        code = self[word] = self.rows.get(whole, 0) * self.base + self.rows.get(stem, 0)
        return code

    def codes(self, text: str | None) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words_of(text)), np.int64)


def buckets(word: str) -> tuple[int, int]:
    """Buckets of a word and of its stem, the first letters; both without punctuation around the word."""
    bare = word.strip(string.punctuation)
    return (zlib.crc32(bare.encode("utf-8", "surrogatepass")) % BUCKETS,
            zlib.crc32(b"^" + bare[:STEM].encode("utf-8", "surrogatepass")) % BUCKETS)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """``embed`` row 0 is zero: words that were not learned say nothing.

    ``filters`` has a column per filter and DIMENSION rows per word of the widest window; rows beyond
    a filter's own width are zero.
    """

    rows: dict[int, int]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    constant: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] | None = None

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """The embedded words of every window, side by side; ``codes`` end with padding."""
        base = len(self.embed)
        x = self.embed[codes // base] + self.embed[codes % base]
        return np.concatenate([x[k:len(x) - _PAD + k] for k in range(max(WIDTHS))], axis=1)

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        """Largest responses of each text. Long texts are convolved a span at a time."""
        pool = np.full((len(texts), len(self.out)), -np.inf, np.float32)
        for owners, starts, codes in spans(texts):
            found = np.maximum.reduceat(self.windows(codes) @ self.filters, starts, axis=0) + self.bias
            np.maximum.at(pool, owners, found)
        return pool

    def best(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`pooled`, and the codes of the words where each filter responds most."""
        pool = np.full((len(texts), len(self.out)), -np.inf, np.float32)
        hit = np.zeros((*pool.shape, max(WIDTHS)), np.int64)
        every = np.arange(pool.shape[1])
        for owners, starts, codes in spans(texts):
            z = self.windows(codes) @ self.filters
            for owner, lo, hi in zip(owners, starts, [*starts[1:], len(z)], strict=True):
                at = lo + z[lo:hi].argmax(0)
                more = z[at, every] > pool[owner]
                pool[owner, more] = z[at, every][more]
                hit[owner, more] = codes[at[more, None] + np.arange(max(WIDTHS))]
        return pool + self.bias, hit

    def raw(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.pooled(texts) @ self.out + self.constant

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        return sigmoid(self.slope * self.raw(texts) + self.shift)


def spans(texts: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(owners, starts, padded codes) for about ``SPAN`` words together.

    Padding before, between and behind texts lets every word stand at every place of a window, and
    keeps texts apart. A longer text comes alone, a span of its windows at a time.
    """
    gap = np.zeros(_PAD, np.int64)
    owners, starts, parts, size = [], [], [], 0
    for owner, codes in enumerate(texts):
        if len(codes) > SPAN:
            padded = np.concatenate([gap, codes, gap])
            for at in range(0, len(codes) + _PAD, SPAN):
                yield [owner], np.array([0]), padded[at:at + SPAN + _PAD]
            continue
        owners.append(owner)
        starts.append(size)
        parts += [gap, codes]
        size += len(codes) + _PAD
        if size >= SPAN:
            yield owners, np.array(starts), np.concatenate([*parts, gap])
            owners, starts, parts, size = [], [], [], 0
    if owners:
        yield owners, np.array(starts), np.concatenate([*parts, gap])


def blank(rows: dict[int, int], seed: int = SEED) -> Network:
    """A network before training."""
    rng = np.random.default_rng(seed)
    widths = np.repeat(WIDTHS, FILTERS)
    own_rows = own_rows_of(widths)
    net = Network(rows, rng.normal(0, 0.1, (len(rows) + 1, DIMENSION)).astype(np.float32),
                  rng.normal(0, 0.5, own_rows.shape).astype(np.float32) * own_rows,
                  np.zeros(len(widths), np.float32), rng.normal(0, 0.1, len(widths)).astype(np.float32))
    net.embed[0] = 0
    return net


def own_rows_of(widths: np.ndarray) -> np.ndarray:
    return (np.arange(max(WIDTHS) * DIMENSION)[:, None] < widths[None, :] * DIMENSION).astype(np.float32)


def advance(net: Network, dense_second: np.ndarray, embed_second: np.ndarray, data: list[np.ndarray], target: np.ndarray,
            rate: float, rng: np.random.Generator) -> None:
    """Train on the texts once, in place. Only the place where a filter responds most gets a gradient.

    ``dense_second`` and ``embed_second`` are the sums of squared gradients of filters, bias and output, and of each embedding.
    """
    own_rows, base = own_rows_of(np.repeat(WIDTHS, FILTERS)), len(net.embed)
    dense = [net.filters, net.bias, net.out]
    cuts = np.cumsum([p.size for p in dense])[:-1]
    second = [part.reshape(p.shape) for part, p in zip(np.split(dense_second, cuts), dense, strict=True)]
    order = rng.permutation(len(data))
    for lo in range(0, len(order), BATCH):
        pick = order[lo:lo + BATCH]
        pool, hit = net.best([data[i] for i in pick])
        x = (net.embed[hit // base] + net.embed[hit % base]).reshape(*pool.shape, -1)  # texts x filters x window
        slack = (sigmoid(pool @ net.out + net.constant) - target[pick]).astype(np.float32) / len(pick)
        back = slack[:, None] * net.out[None, :]
        grads = [np.einsum("tfd,tf->df", x, back) * own_rows, back.sum(0), pool.T @ slack + 1e-4 * net.out]
        push = (back[:, :, None] * net.filters.T[None, :, :]).reshape(*pool.shape, max(WIDTHS), DIMENSION)
        for p, g, s in zip(dense, grads, second, strict=True):
            s += g * g
            p -= rate * g / np.sqrt(s)
        net.constant -= rate * float(slack.sum())
        words = hit.ravel()
        rows_hit, where = np.unique(np.concatenate([words // base, words % base]), return_inverse=True)
        moves = np.zeros((len(rows_hit), DIMENSION), np.float32)
        np.add.at(moves, where, np.tile(push.reshape(-1, DIMENSION), (2, 1)))
        embed_second[rows_hit] += (moves * moves).mean(1)
        net.embed[rows_hit] -= rate * moves / np.sqrt(embed_second[rows_hit])[:, None]
        net.embed[0] = 0


_VALUES = [f"v{k}" for k in range(DIMENSION)]


def fit(coded: DataFrame, rows: dict[int, int], tasks: int, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Train on all rows of ``coded`` (codes, toxic) in at most so many tasks.

    A task tells the embeddings it has moved and the other values; they are averaged in Spark, and one
    network's worth of numbers reaches the driver an epoch.
    """
    net = blank(rows, seed)
    dense_second = np.full(net.filters.size + net.bias.size + net.out.size, 1e-3, np.float32)
    embed_second = np.full(len(net.embed), 1e-5, np.float32)
    spark = coded.sparkSession
    for epoch in range(epochs):
        shared = spark.sparkContext.broadcast((vars(net), dense_second, embed_second))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, epoch=epoch) -> Iterator[pa.RecordBatch]:
            values, dense_then, embed_then = shared.value
            here = Network(**{k: v.copy() if isinstance(v, np.ndarray) else v for k, v in values.items()})
            dense_now, embed_now, seen = dense_then.copy(), embed_then.copy(), 0
            rng = np.random.default_rng([seed, epoch])
            for batch in batches:
                texts = [np.asarray(c.as_py(), np.int64) for c in batch.column(0)]
                advance(here, dense_now, embed_now, texts, batch.column(1).to_numpy(zero_copy_only=False).astype(np.float32), 0.1 / (1 + epoch), rng)
                seen += len(texts)
            if seen:
                moved = np.flatnonzero(embed_now != embed_then)
                dense = np.concatenate([here.filters.ravel(), here.bias, here.out, [here.constant]]).astype(np.float64)
                wide = np.zeros((len(dense), DIMENSION))
                wide[:, 0] = dense
                both = np.concatenate([here.embed[moved].astype(np.float64), wide])
                at = np.concatenate([moved, -1 - np.arange(len(dense))])
                then = np.concatenate([embed_now[moved], dense_now, [0]]).astype(np.float64)
                yield pa.record_batch([pa.array(at), *[pa.array(np.ascontiguousarray(both[:, k])) for k in range(DIMENSION)], pa.array(then),
                                       pa.array(np.full(len(at), float(seen)))], ["at", *_VALUES, "second", "seen"])

        told = coded.select("codes", "toxic").coalesce(tasks).mapInArrow(
            run, ", ".join(["at long", *[f"{v} double" for v in _VALUES], "second double", "seen double"]))
        # A task counts by its rows; an embedding's mean is over the tasks that have moved it.
        mean = told.groupBy("at").agg(*[(F.sum(F.col(v) * F.col("seen")) / F.sum("seen")).alias(v) for v in (*_VALUES, "second")]).toArrow()
        at = mean.column("at").to_numpy()
        wide = np.stack([mean.column(v).to_numpy() for v in _VALUES], axis=1).astype(np.float32)
        second = mean.column("second").to_numpy().astype(np.float32)
        word = at >= 0
        net.embed[at[word]], embed_second[at[word]] = wide[word], second[word]
        dense = np.zeros(len(dense_second) + 1, np.float32)
        dense[-1 - at[~word]] = wide[~word, 0]
        then = np.zeros(len(dense), np.float32)
        then[-1 - at[~word]] = second[~word]
        dense_second = then[:-1]
        sizes = np.cumsum([net.filters.size, net.bias.size, net.out.size])
        net.filters = dense[:sizes[0]].reshape(net.filters.shape)
        net.bias, net.out, net.constant = dense[sizes[0]:sizes[1]].copy(), dense[sizes[1]:sizes[2]].copy(), float(dense[-1])
        shared.unpersist()
    return net


def calibrate(net: Network, raw: np.ndarray, toxic: list[int], langs: list[str | None], many: list[int], shares: dict[int, float]) -> None:
    """Fit slope and shift to labelled texts weighted to the classes' shares, then thresholds by language.

    Each of the values stands for ``many`` texts. A language's threshold makes the fewest weighted errors;
    a language without both classes, and any not seen, has 0.5.
    """
    y, n = np.array(toxic, float), np.array(many, float)
    own = np.array([n[y == c].sum() for c in (0, 1)]) / max(n.sum(), 1)
    weight = n * np.where(y == 1, shares[1] / max(own[1], 1e-9), shares[0] / max(own[0], 1e-9))
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton steps on two numbers
        p = sigmoid(a * raw + b)
        g = np.array([(weight * (p - y) * raw).sum() + 1e-3 * (a - 1), (weight * (p - y)).sum()])
        h = weight * p * (1 - p)
        hess = np.array([[(h * raw * raw).sum() + 1e-3, (h * raw).sum()], [(h * raw).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        step *= min(1, 1 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    net.slope, net.shift = max(float(a), 1e-3), float(b)
    score = sigmoid(net.slope * raw + net.shift)
    net.thresholds = {}
    for lang in sorted({x for x in langs if x is not None}):
        mine = np.array([x == lang for x in langs])
        if len(set(y[mine])) == 2:
            cuts = np.unique(np.append(score[mine], 0.5))
            errors = [(weight[mine] * ((score[mine] >= c) != (y[mine] == 1))).sum() for c in cuts]
            net.thresholds[lang] = float(cuts[min(range(len(cuts)), key=lambda k: (errors[k], abs(cuts[k] - 0.5)))])


def labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(check, toxic, text, lang) for every row of ``known`` (doc_id, toxic, check) with a text in ``docs``.

    Both sides are dealt by id however few labels there are: a table of labels never travels whole to each
    executor, and what a small table moves tells what a large one will. Rows of a partition keep the order of
    ``docs``, of one text's labels the last first: training goes by it.
    """
    slim = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
                                                 F.monotonically_increasing_id().alias("place"))
    turns = known.withColumn("turn", F.monotonically_increasing_id())
    return slim.hint("merge").join(turns, "doc_id").sortWithinPartitions("place", F.desc("turn")).select("check", "toxic", "text", "lang")


def learn(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Train on all ``labels`` (doc_id, toxic) and their texts in ``docs`` (doc_id, text, lang).

    A quarter of the labels, by a digest of the id, calibrates and trains nothing. The share of toxic rows is
    counted over all labels. Labels or ids that are null teach nothing. None if there is not a training text
    of either class. The buckets that are learned (at most 2^20), the network and counts of scores by language
    reach the driver.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    check = F.crc32(F.concat(F.lit(f"{SEED}:"), F.col("doc_id").cast("string")).cast("binary")) % 4 == 0

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                found = {b for w in set(words_of(t.as_py())) for b in buckets(w)}
                yield pa.record_batch([pa.array(sorted(found), pa.int64())], ["bucket"])

    with passing_dir(spark) as folder:
        rows = materialise(labelled(docs, known.withColumn("check", check)), folder)
        train = rows.where("not check")
        sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if set(sizes) != {0, 1}:
            return None
        often = train.select("text").mapInArrow(bags, "bucket long").groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_TEXTS)
        learned = {b: i + 1 for i, b in enumerate(sorted(often.select("bucket").toArrow().column(0).to_pylist()))}
        index_of = spark.sparkContext.broadcast(learned)

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Rows(index_of.value)
            for batch in batches:
                yield pa.record_batch([pa.array([index.codes(t.as_py()) for t in batch.column(0)], pa.list_(pa.int64())), batch.column(1)], ["codes", "toxic"])

        coded = materialise(train.select("text", "toxic").mapInArrow(code, "codes array<long>, toxic int"), folder)
        net = fit(coded, learned, max(1, sum(sizes.values()) // TASK_ROWS))
        shared = spark.sparkContext.broadcast(vars(net))

        def respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here = Network(**shared.value)
            index = Rows(here.rows)
            for batch in batches:
                raw = here.raw([index.codes(t.as_py()) for t in batch.column(0)])
                step = np.round(np.clip(raw, -1e6, 1e6) * STEPS).astype(np.int64)
                yield pa.record_batch([batch.column(1), batch.column(2), pa.array(step)], ["toxic", "lang", "step"])

        told = (rows.where("check").select("text", "toxic", "lang").mapInArrow(respond, "toxic int, lang string, step long")
                .groupBy("lang", "step", "toxic").agg(F.count("*").alias("n")).orderBy("lang", "step", "toxic").collect())
    if {r["toxic"] for r in told} == {0, 1}:
        total = sum(counts.values())
        calibrate(net, np.array([r["step"] for r in told]) / STEPS, [r["toxic"] for r in told], [r["lang"] for r in told], [r["n"] for r in told],
                  {c: counts.get(c, 0) / total for c in (0, 1)})
    return net


def score(docs: DataFrame, net: Network | None, **keep: Column) -> DataFrame:
    """The ``keep`` columns and ``score`` for every row of (text): higher, likelier toxic.

    Only the whole text decides. Null and empty texts have the score of a text without known words;
    without a network all scores are 0. No row is moved.
    """
    # Plain values only: a worker need not have this module.
    shared = docs.sparkSession.sparkContext.broadcast(vars(net) if net else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Network(**shared.value) if shared.value else None
        index = Rows(here.rows) if here else None
        for batch in batches:
            if here:
                values = here.scores([index.codes(t.as_py()) for t in batch.column(0)]).astype(float)
            else:
                values = np.zeros(batch.num_rows)
            yield pa.record_batch([*batch.columns[1:], pa.array(values, pa.float64())], [*batch.schema.names[1:], "score"])

    slim = docs.select(F.col("text").cast("string").alias("__text"), *[c.alias(k) for k, c in keep.items()])
    return slim.mapInArrow(run, StructType([*slim.schema.fields[1:], StructField("score", DoubleType())]))


def flagged(scored: DataFrame, net: Network | None) -> DataFrame:
    """Adds ``threshold`` and ``flagged`` to rows with (score, lang): each language has its own threshold."""
    cuts = net.thresholds if net and net.thresholds else {}
    threshold = F.lit(0.5)
    for lang, cut in cuts.items():
        threshold = F.when(F.col("lang") == lang, F.lit(cut)).otherwise(threshold)
    return scored.withColumn("threshold", threshold).withColumn("flagged", F.col("score") >= F.col("threshold"))
