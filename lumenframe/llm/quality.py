"""Document quality by supervised subword embeddings.

Every word contributes itself and its byte 3- and 4-grams (with word ends
marked), each hashed to a row of an embedding table, and every pair of
neighbouring words contributes one of two rows, for a repeated word or another
one.  A document is the average of those rows and of PRIOR zero rows, which hold
short texts near the layer's bias; a softmax layer turns it into class
probabilities.  Table and
layer are learned by stochastic gradient descent in numpy, one document a step.
Averaging is linear, so for scoring the table is multiplied with the layer
once, and a word's share of the class margins is summed once for each worker and
looked up from then on: no word is skipped and no text is cut.

The fit reads a bounded sample of labelled rows (SAMPLE of each class, by a hash
of the id), weighted back to the classes' shares; scoring reads every row.

Edge cases: null, empty and blank texts have no words and get the layer's bias;
texts of any length count whole; without labelled rows of both classes the
score is the share of label 1 (0.5 without any labels); repeated labels are
used as often as they occur; repeated rows get equal scores; a row without an id
is in no fold; an empty table gives an empty result; other columns are not read,
whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ._common import doc_hash, held_out, pick_rows, sample_by_class, stream, table

#: Labelled documents of each class that the fit reads.
SAMPLE = 1200
BUCKETS, DIM, RATE = 1 << 17, 8, 2.0
#: Passes over the sample: at least the first number, more for small samples up to the second, to come to so many steps.
EPOCHS, STEPS = (8, 40), 20_000
#: Zero rows in every average, and the weight of a pair of words beside a word's features.
PRIOR, PAIR = 200, 8
GRAMS = (3, 4)
#: Words whose sums a worker remembers; beyond it the memory starts anew.
CACHE_WORDS = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, bucket) of every feature of every word."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    where = [np.arange(len(raw))]
    hashed = [np.fromiter(map(xxh3_64_intdigest, raw), np.uint64, len(raw))]
    text = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), np.fromiter((len(w) + 2 for w in raw), np.int64, len(raw)))
    for n in GRAMS:
        if len(text) < n:
            continue
        h = np.full(len(text) - n + 1, np.uint64(n))
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + text[i : len(text) - n + 1 + i]
        inside = owner[: len(text) - n + 1] == owner[n - 1 :]
        where.append(owner[: len(text) - n + 1][inside])
        hashed.append(h[inside])
    bucket = (np.concatenate(hashed) * _MIX) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.concatenate(where), bucket.astype(np.int64)


class SubwordModel:
    """margin: for each bucket the difference of the two classes' margins (the last two rows: other word, repeated word); bias likewise."""

    def __init__(self, margin: np.ndarray, bias: float):
        self.margin, self.bias = margin, bias

    @staticmethod
    def fit(texts: list[str | None], labels: list[int], weights: list[float], seed: int = 3) -> "SubwordModel":
        docs = []
        for t in texts:
            words = (t or "").split()
            if not words:
                docs.append((np.empty(0, np.int64), np.empty(0)))
                continue
            count = Counter(words)
            n = np.fromiter(count.values(), float, len(count))
            where, bucket = word_features(list(count))
            rows, at = np.unique(bucket, return_inverse=True)
            same = sum(a == b for a, b in zip(words, words[1:]))
            c = np.concatenate([np.bincount(at, n[where]), [PAIR * (len(words) - 1 - same), PAIR * same]])
            docs.append((np.concatenate([rows, [BUCKETS, BUCKETS + 1]]), c / (c.sum() + PRIOR)))
        g = np.random.default_rng(seed)
        table_ = g.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 2, DIM))
        layer, bias = np.zeros((DIM, 2)), np.zeros(2)
        epochs = min(EPOCHS[1], max(EPOCHS[0], -(-STEPS // max(1, len(docs)))))
        steps = epochs * len(docs)
        done = 0
        for _ in range(epochs):
            for i in g.permutation(len(docs)):
                rate = RATE * (1 - done / steps)
                done += 1
                rows, c = docs[i]
                mine = table_[rows]
                z = c @ mine
                m = z @ layer + bias
                p = np.exp(m - m.max())
                p /= p.sum()
                p[labels[i]] -= 1
                p *= weights[i]
                back = layer @ p
                layer -= 0.2 * rate * np.outer(z, p)
                bias -= 0.02 * rate * p
                table_[rows] = mine - rate * c[:, None] * back[None, :]
        out = table_ @ layer
        return SubwordModel((out[:, 1] - out[:, 0]).astype(np.float32), float(bias[1] - bias[0]))

    def word_sums(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word: sum of its features' margins, number of its features."""
        where, bucket = word_features(words)
        return np.bincount(where, self.margin[bucket], len(words)), np.bincount(where, minlength=len(words)).astype(float)


class Scorer:
    def __init__(self, model: SubwordModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.sums, self.counts = np.empty(0), np.empty(0)

    def scores(self, texts: list[str | None]) -> list[float]:
        split = [(t or "").split() for t in texts]
        met = set().union(*split)
        if len(self.index) + len(met) > CACHE_WORDS:
            self._clear()
        new = [w for w in met if w not in self.index]
        if new:
            s, c = self.model.word_sums(new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.sums, self.counts = np.concatenate([self.sums, s]), np.concatenate([self.counts, c])
        out = []
        for words in split:
            m = self.model.bias
            if words:
                at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
                same = int((at[1:] == at[:-1]).sum())
                other = len(at) - 1 - same
                total = self.sums[at].sum() + PAIR * (other * self.model.margin[BUCKETS] + same * self.model.margin[BUCKETS + 1])
                m += float(total / (self.counts[at].sum() + PAIR * (len(at) - 1) + PRIOR))
            out.append(float(1 / (1 + np.exp(-np.clip(m, -60, 60)))))
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> SubwordModel:
    """Learn from labelled rows: docs (doc_id, text), labels (doc_id, label in 0/1)."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    shares = {r[0]: r[1] for r in marked.groupBy("y").count().collect()}
    if len(shares) < 2:
        p = 0.999 if shares.get(1) else 0.001 if shares else 0.5
        return SubwordModel(np.zeros(BUCKETS + 2, np.float32), float(np.log(p / (1 - p))))
    picked = sample_by_class(marked, "y", sample)
    # `picked` is bounded by the sample, so it is the side to broadcast.
    rows = sorted(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").collect(), key=lambda r: (r[0], r[1] or ""))
    total, taken = sum(shares.values()), {c: max(1, sum(r[2] == c for r in rows)) for c in (0, 1)}
    weight = {c: min(3.0, (shares[c] / total) / (taken[c] / max(1, len(rows)))) for c in (0, 1)}
    return SubwordModel.fit([r[1] for r in rows], [r[2] for r in rows], [weight[r[2]] for r in rows])


_SCORERS: dict[bytes, Scorer] = {}


def score(docs: DataFrame, model: SubwordModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast((model.margin.tobytes(), model.bias))
    tag = np.random.default_rng().bytes(12)

    def run(batches):
        if tag not in _SCORERS:
            _SCORERS.clear()
            raw, bias = shared.value
            _SCORERS[tag] = Scorer(SubwordModel(np.frombuffer(raw, np.float32), bias))
        scorer = _SCORERS[tag]
        for rows in batches:
            yield {key: rows[key], "score": scorer.scores(rows[text])}

    return stream(docs.select(key, text), run, f"{key} {dict(docs.dtypes)[key]}, score double")


def keep_good(docs: DataFrame, model: SubwordModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of `docs` that score at least `threshold`, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((model.margin.tobytes(), model.bias))

    def start():
        raw, bias = shared.value
        scorer = Scorer(SubwordModel(np.frombuffer(raw, np.float32), bias))
        return lambda texts: [s >= threshold for s in scorer.scores(texts)]

    return pick_rows(docs, text, start)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = table(spark, sf_dir, "labels").where(doc_hash() % 5 != 0)
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
