"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a code of CODE numbers; learned filters of WIDTH bytes slide by STRIDE over the whole document. They are
max-pooled over chunks of CHUNK bytes that overlap by half, a logistic unit combines the pooled values, averaged over all
chunks, into one probability.

Learned from at most `train_rows` labelled rows (the bound of what reaches the driver), dealt by a hash of the id; in every epoch up to `train_chunks` chunks of each row, drawn anew. Scores are always of whole texts. Defined
results: a null text scores as an empty one; rows without a label are scored like others; labels that contradict each other for an id count
as their rounded mean; without any label the score is 0.5; extra input columns are ignored; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.llm.rows import dealt, held_out, small_batches
from molframe.session import table

CODE, STRIDE, CHUNK, FILTERS = 8, 8, 512, 32
WIDTH, HALF = 2 * STRIDE, CHUNK // 2
STEPS = HALF // STRIDE
TRAIN_ROWS, TRAIN_CHUNKS, SEED = 1500, 6, 11
#: Passes over the training rows: as many as make UPDATES steps of BATCH rows, within bounds.
BATCH, UPDATES, LEAST_EPOCHS, MOST_EPOCHS = 32, 600, 10, 25
THRESHOLD = 0.7
#: Bytes whose activations are held at once.
BLOCK = 1 << 18


class Network:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.code = r.normal(0, 1, (256, CODE)).astype(np.float32)
        self.code[0] = 0
        self.filters = r.normal(0, 1 / np.sqrt(WIDTH * CODE), (2, STRIDE * CODE, FILTERS)).astype(np.float32)
        self.bias, self.out, self.base = np.zeros(FILTERS, np.float32), r.normal(0, 0.1, FILTERS).astype(np.float32), np.float32(0)

    def _flat(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of STRIDE bytes of all documents, each filled up to halves of chunks, and the documents' halves."""
        halves = np.array([max(1, -(-len(d) // HALF)) for d in docs])
        raw = np.frombuffer(b"".join(d.ljust(h * HALF, b"\0") for d, h in zip(docs, halves.tolist(), strict=True)), np.uint8)
        return raw, halves

    def _slide(self, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each filter at each stride; a window doesn't run on into the next document."""
        x = self.code[raw].reshape(-1, STRIDE * CODE)
        h, after = x @ self.filters[0], x @ self.filters[1]
        after[first * STEPS] = 0
        h[:-1] += after[1:]
        return h

    def pooled(self, docs: list[bytes]) -> np.ndarray:
        raw, halves = self._flat(docs)
        first = np.cumsum(halves) - halves
        tops = np.concatenate([self._tops(raw, first, k) for k in range(0, len(raw), BLOCK)])
        last = first + halves - 1
        chunk = np.maximum(tops, np.concatenate([tops[1:], tops[-1:]]))
        chunk[last] = tops[last]
        value = np.maximum(chunk + self.bias, 0)
        value[last[halves > 1]] = 0  # no chunk starts at a document's last half, but in the shortest
        return np.add.reduceat(value, first) / np.maximum(halves - 1, 1)[:, None]

    def _tops(self, raw: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
        part = raw[k : k + BLOCK + STRIDE]
        own = min(BLOCK, len(raw) - k) // HALF
        inside = first[(first * HALF >= k) & (first * HALF < k + len(part))] - k // HALF
        return self._slide(part, inside)[: own * STEPS].reshape(own, STEPS, FILTERS).max(1)

    def score(self, docs: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.pooled(docs) @ self.out + self.base).astype(np.float64)))

    def fit(self, docs: list[bytes], labels: list[int], seed: int = SEED, train_chunks: int = TRAIN_CHUNKS) -> Network:
        """Adam on the log loss over up to `train_chunks` chunks of each document, drawn anew in every epoch."""
        r = np.random.default_rng(seed)
        epochs = min(MOST_EPOCHS, max(LEAST_EPOCHS, UPDATES * BATCH // max(1, len(docs))))
        y = np.array(labels, np.float32)
        weights = [self.filters, self.bias, self.out, np.zeros(1, np.float32)]
        if len(y):
            weights[3][:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        first, second, steps = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for epoch in range(epochs):
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            order = r.permutation(len(docs))
            for k in range(0, len(order), BATCH):
                batch = order[k : k + BATCH]
                cut, of = [], []
                for row, i in enumerate(batch):
                    n = max(1, -(-len(docs[i]) // HALF) - 1)
                    for c in r.choice(n, min(n, train_chunks), replace=False):
                        cut.append(docs[i][c * HALF : c * HALF + CHUNK].ljust(CHUNK, b"\0"))
                        of.append(row)
                of = np.array(of)
                raw = np.frombuffer(b"".join(cut), np.uint8)
                h = self._slide(raw, np.arange(len(cut)) * 2).reshape(len(cut), 2 * STEPS, FILTERS)
                at = h.argmax(1)
                top = np.take_along_axis(h, at[:, None], 1)[:, 0] + self.bias
                share = 1 / np.bincount(of, minlength=len(batch))[of]
                value = np.maximum(top, 0)
                mean = np.zeros((len(batch), FILTERS), np.float32)
                np.add.at(mean, of, (value * share[:, None]).astype(np.float32))
                wrong = 1 / (1 + np.exp(-(mean @ self.out + weights[3][0]))) - y[batch]
                wrong = (wrong / len(batch)).astype(np.float32)
                back = (wrong[of] * share).astype(np.float32)[:, None] * self.out * (top > 0)
                x = self.code[raw].reshape(len(cut), 2 * STEPS, STRIDE * CODE)
                line = np.arange(len(cut))[:, None]
                here = x[line, at]
                nxt = np.where((at < 2 * STEPS - 1)[:, :, None], x[line, np.minimum(at + 1, 2 * STEPS - 1)], 0)
                grads = [np.stack([np.einsum("cf,cfi->if", back, here), np.einsum("cf,cfi->if", back, nxt)]), back.sum(0), mean.T @ wrong + 1e-3 * self.out, np.array([wrong.sum()], np.float32)]
                steps += 1
                for w, g, m, v in zip(weights, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
        self.base = weights[3][0]
        return self


def training_rows(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> list:
    """At most `most` rows (text, label) whose ids aren't held out."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("label_id")).agg(F.round(F.avg(label_col)).cast("int").alias("label"))
    ids = known.orderBy(dealt("label_id", SEED), "label_id").limit(most)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), F.col("id") == F.col("label_id"))  # at most `most` ids
    return rows.groupBy("id", "label").agg(F.min("text").alias("text")).orderBy("id").collect()


def train_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, train_chunks: int = TRAIN_CHUNKS) -> Network | None:
    rows = training_rows(df, labels, id_col, text_col, label_col, train_rows)
    return Network().fit([(r["text"] or "").encode() for r in rows], [r["label"] for r in rows], train_chunks=train_chunks) if rows else None


def scored_by(network: Network | None, text: Column) -> Column:
    """The score of a text. Only texts go to Python and only scores come back."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            docs = [(t or "").encode() for t in texts]
            out = np.full(len(docs), 0.5)
            start = held = 0
            for i, d in enumerate(docs):
                held += len(d) + HALF
                if held >= BLOCK or i == len(docs) - 1:
                    if network:
                        out[start : i + 1] = network.score(docs[start : i + 1])
                    start, held = i + 1, 0
            yield pd.Series(out)

    return score.asNondeterministic()(text)  # else the optimizer may score twice


def score_quality(df: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, the columns of keep, score double) of every row."""
    small_batches(df)
    return df.select(*dict.fromkeys([id_col, *keep]), scored_by(network, F.col(text_col)).alias("score"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
