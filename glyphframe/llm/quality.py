"""Quality classifier: a small convolutional network over bytes, in numpy.

A text is read as bytes in overlapping chunks of ``CHUNK`` that cover all of it.  Learned
filters of ``WIDTH`` bytes slide over a chunk, each keeps its greatest response, and a hidden layer
makes chunk features of these; the greatest of each over all chunks goes into one
logistic unit.  Nothing but the bytes is an input.

The network is trained on the driver with a bounded sample of labelled rows
(``PER_CLASS`` of each label; whole texts), with Adam.  Scoring is a scan: filters become
tables over pairs of bytes, so a position costs ``WIDTH / 2`` look-ups; chunks overlap by half,
so each half is computed once.  Memory is bounded by ``PIECE`` at any length of text.

Edge cases: a null or empty text is a chunk of zero bytes and gets the score that the network
gives to it.  Rows without a label do not train.  Without labels of both kinds every score
is the share of label 1 (0.5 without labels).  Repeated rows appear as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphframe.llm.common import labelled_sample

CHUNK, STEP, WIDTH = 256, 128, 6
EMBED, FILTERS, HIDDEN = 8, 24, 16
PER_CLASS, EPOCHS, BATCH, RATE, SEED = 1200, 10, 32, 0.01, 7
#: Steps of a text that are scored at a time.
PIECE = 64


def blocks(data: bytes) -> np.ndarray:
    """Bytes with the zeros that make them whole steps (two at least), and room for the last window."""
    steps = max(2, -(-len(data) // STEP))
    out = np.zeros(steps * STEP + WIDTH, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out


class Network:
    """Weights, forward pass and training step."""

    def __init__(self, weights: dict[str, np.ndarray], prior: float = 0.0):
        self.w, self.prior, self._tables = weights, prior, None

    def __getstate__(self) -> dict:
        return {"w": self.w, "prior": self.prior, "_tables": None}

    @classmethod
    def start(cls, seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        return cls(
            {
                "embed": r.normal(0, 0.5, (256, EMBED)),
                "filter": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH, EMBED, FILTERS)),
                "bias": np.zeros(FILTERS),
                "hidden": r.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)),
                "hidden_bias": np.full(HIDDEN, 0.1),
                "out": r.normal(0, HIDDEN**-0.5, HIDDEN),
                "out_bias": np.zeros(1),
            }
        )

    def tables(self) -> np.ndarray:
        """By pair of bytes the response of two filter positions: (WIDTH / 2, 65536, FILTERS)."""
        if self._tables is None:
            single = np.einsum("be,jef->jbf", self.w["embed"], self.w["filter"]).astype(np.float32)
            self._tables = np.empty((WIDTH // 2, 65536, FILTERS), dtype=np.float32)
            for j, pairs in enumerate(self._tables.reshape(-1, 256, 256, FILTERS)):
                np.add(single[2 * j][:, None, :], single[2 * j + 1][None, :, :], out=pairs)
        return self._tables

    def score(self, data: bytes) -> float:
        """Probability of label 1 of a whole text."""
        tables, padded = self.tables(), blocks(data)
        pair = padded[:-1].astype(np.int32) << 8 | padded[1:]
        n, peaks = (len(padded) - WIDTH) // STEP, []
        for at in range(0, n, PIECE):
            a, b = at * STEP, min(n, at + PIECE) * STEP
            z = tables[0].take(pair[a:b], axis=0)
            for j in range(1, WIDTH // 2):
                z += tables[j].take(pair[a + 2 * j : b + 2 * j], axis=0)
            peaks.append(z.reshape(-1, STEP, FILTERS).max(axis=1))
        step = np.concatenate(peaks)
        chunk = np.maximum(np.maximum(step[:-1], step[1:]) + self.w["bias"], 0)
        hidden = np.maximum(chunk @ self.w["hidden"] + self.w["hidden_bias"], 0).max(axis=0)
        logit = hidden @ self.w["out"] + self.w["out_bias"][0] + self.prior
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of a batch of padded texts."""
        w = self.w
        single = np.einsum("be,jef->jbf", w["embed"], w["filter"]).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        by_byte = np.zeros(WIDTH * 256 * FILTERS)
        lane = np.arange(FILTERS)
        for padded, y in zip(texts, labels):
            z = single[0].take(padded[: len(padded) - WIDTH], axis=0)
            for j in range(1, WIDTH):
                z += single[j].take(padded[j : len(padded) - WIDTH + j], axis=0)
            z = z.reshape(-1, STEP, FILTERS)
            at = z.argmax(axis=1)
            step = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0]
            at += (np.arange(len(z)) * STEP)[:, None]
            right = step[1:] > step[:-1]
            place = np.where(right, at[1:], at[:-1])
            before = np.where(right, step[1:], step[:-1]) + w["bias"]
            chunk = np.maximum(before, 0)
            pre = chunk @ w["hidden"] + w["hidden_bias"]
            best = pre.argmax(axis=0)
            top = pre[best, np.arange(HIDDEN)]
            hidden = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["out_bias"][0], -40, 40)))
            d = (p - y) / len(texts)
            grad["out"] += d * hidden
            grad["out_bias"] += d
            d_top = d * w["out"] * (top > 0)
            grad["hidden_bias"] += d_top
            rows = chunk[best]
            grad["hidden"] += rows.T * d_top
            d_chunk = (w["hidden"].T * d_top[:, None]) * (before[best] > 0)
            grad["bias"] += d_chunk.sum(axis=0)
            spots = place[best]
            for j in range(WIDTH):
                index = (j * 256 + padded[spots + j].astype(np.int64)) * FILTERS + lane
                by_byte += np.bincount(index.ravel(), weights=d_chunk.ravel(), minlength=len(by_byte))
        by_byte = by_byte.reshape(WIDTH, 256, FILTERS)
        grad["embed"] += np.einsum("jbf,jef->be", by_byte, w["filter"])
        grad["filter"] += np.einsum("be,jbf->jef", w["embed"], by_byte)
        return grad

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        padded, y = [blocks(t) for t in texts], np.array(labels, dtype=float)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        t, total = 0, epochs * -(-len(texts) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                batch = order[at : at + BATCH]
                t += 1
                now = rate * (1 - t / (total + 1))
                for k, g in self.gradients([padded[i] for i in batch], y[batch]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.w[k] = self.w[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        self._tables = None
        return self


def held_out(id_col: Column, folds: int = 3, fold: int = 1) -> Column:
    """Rows that must not train: a CRC-32 of the id as text."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(folds)) == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Network | float:
    """A network from texts and labels (0 or 1) of ids; the share of label 1 if there is nothing to tell apart."""
    counts = {r[0]: r["n"] for r in labels.groupBy(F.col(label_col).cast("int")).agg(F.count("*").alias("n")).collect() if r[0] in (0, 1)}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, per_class, "quality")
    if len({r["label"] for r in sample}) < 2:
        return counts[1] / sum(counts.values())
    ones = sum(r["label"] for r in sample)
    # the sample has more of the rarer label than there are; the last unit's bias makes up for that
    prior = float(np.log(counts[1] / counts[0]) - np.log(ones / (len(sample) - ones)))
    network = Network.start().fit([(r["text"] or "").encode() for r in sample], [r["label"] for r in sample])
    network.prior = prior
    return network


def score(docs: DataFrame, model: Network | float, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, float):
                scores = [model] * batch.num_rows
            else:
                scores = [model.score(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return own.mapInArrow(scan, f"id {own.schema['id'].dataType.simpleString()}, score double")


def probability(model: Network | float, text: Column) -> Column:
    """The score of a text as an expression, in Arrow batches."""
    if isinstance(model, float):
        return F.lit(model)

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array((model.score(x.as_py() or b"") for x in texts), pa.float64())

    return scored(text.cast("binary"))


def accepted(docs: DataFrame, model: Network | float, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` with a score of ``least`` or more, with their own columns."""
    return docs.where(probability(model, F.col(text_col)) >= least)
