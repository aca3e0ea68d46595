"""Quality rules: base counts, and a linear-chain CRF that labels lines content or boilerplate.

Each line of a text gets features; Viterbi decoding finds the likeliest sequence of labels; the
share of words that lie in content lines decides whether the text is kept.  Base rules come
first: texts of under ``LEAST_WORDS`` words, or with over half of their words in repeated
3-word windows, fail.

The CRF is trained on the driver from a bounded sample of labelled documents (``PER_CLASS`` of each
label, whole texts).  There are no labels of lines: those of a good document count as content, those
of a bad one as boilerplate at first; then bad documents are decoded, and what decoding calls
content becomes content for a second fit.

Edge cases: a null or empty text has no words or lines and fails.  Lines without a word are
not labelled.  Without labels of both kinds all lines are content.  Repeated rows appear as
often as they come.  Long texts are read in pieces of lines; per word only hashes are held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphframe.llm.common import labelled_sample

LEAST_WORDS = 50
MOST_REPEATED = 50
LEAST_CONTENT = 0.5
PER_CLASS, EPOCHS, RATE = 600, 120, 0.05
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_OPENERS = b"{}[]=;\\_@~^"
N_FEATURES = 12
#: Words that are hashed at a time.
PIECE = 1 << 22


def line_features(line: bytes, repeated: bool) -> tuple[float, ...]:
    """What the CRF sees of a line that has a word; all between 0 and about 1."""
    words = line.split()
    n, size = len(words), len(line)
    symbols = size - len(line.translate(None, SYMBOLS))
    upper = size - len(line.translate(None, _UPPER))
    return (
        1.0,
        min(1.0, 8 * symbols / size),
        float(b"|" in line),
        min(1.0, 2 * upper / size),
        min(1.0, 4 * (size - len(line.translate(None, _DIGITS))) / size),
        min(1.0, 10 * (size - len(line.translate(None, _OPENERS))) / size),
        float(n < 4),
        1 - len(set(words)) / n,
        float(repeated),
        float(line.rstrip(SPACE)[-1:] in (b".", b"!", b"?")),
        min(1.0, size / n / 16),
        min(1.0, np.log1p(n) / 6),
    )


def lines_of(data: bytes) -> tuple[list[bytes], list[bool]]:
    """Lines with a word, and whether each equals an earlier one."""
    seen: set[bytes] = set()
    lines, again = [], []
    for line in data.split(b"\n"):
        if line.translate(None, SPACE):
            lines.append(line)
            again.append(line in seen)
            seen.add(line)
    return lines, again


def observe(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines, N_FEATURES) and words per line."""
    lines, again = lines_of(data)
    x = np.array([line_features(a, b) for a, b in zip(lines, again)], dtype=np.float64).reshape(-1, N_FEATURES)
    return x, np.array([len(a.split()) for a in lines], dtype=np.int64)


def repeated_words(data: bytes) -> tuple[int, int]:
    """(words, words in 3-word windows that occur twice or more)."""
    parts = []
    for at in _cuts(data):
        words = data[at[0] : at[1]].split()
        parts.append(np.fromiter(map(hash, words), dtype=np.int64, count=len(words)))
    h = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    n = len(h)
    if n < 3:
        return n, 0
    h = h.view(np.uint64)
    mixed = (h[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[:-2] >> np.uint64(29))
    mixed = (mixed + h[1:-1]) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(32))) + h[2:] * np.uint64(0x94D049BB133111EB)
    order = np.argsort(mixed)
    same = mixed[order[1:]] == mixed[order[:-1]]
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return n, int(covered.sum())


def _cuts(data: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of about ``PIECE`` bytes that end between words."""
    start = 0
    while start < len(data):
        end = min(start + PIECE, len(data))
        while end < len(data) and data[end] not in SPACE:
            end += 1
        yield start, end
        start = end


@dataclass
class Crf:
    """Two labels: 0 content, 1 boilerplate."""

    unary: np.ndarray  # (2, N_FEATURES)
    step: np.ndarray  # (2, 2)

    @classmethod
    def flat(cls) -> Crf:
        unary = np.zeros((2, N_FEATURES))
        unary[0, 0] = 1.0
        return cls(unary, np.zeros((2, 2)))

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The likeliest labels of a sequence."""
        scores = (x @ self.unary.T).tolist()
        (aa, ab), (ba, bb) = self.step.tolist()
        (a, b), back = scores[0], [(True, True)]
        for u, v in scores[1:]:
            from_a, from_b = a + aa >= b + ba, a + ab >= b + bb
            a, b = (a + aa if from_a else b + ba) + u, (a + ab if from_b else b + bb) + v
            back.append((from_a, from_b))
        label = int(b > a)
        out = np.zeros(len(scores), dtype=np.int64)
        for i in range(len(scores) - 1, -1, -1):
            out[i] = label
            label = 0 if back[i][label] else 1
        return out

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray], epochs: int = EPOCHS, rate: float = RATE, l2: float = 1e-3) -> Crf:
        """Maximum likelihood by Adam; the forward and backward passes run over all sequences at once."""
        order = sorted(range(len(xs)), key=lambda i: -len(xs[i]))
        xs, ys = [xs[i] for i in order], [ys[i] for i in order]
        n, most = len(xs), max(map(len, xs))
        x, y = np.zeros((n, most, N_FEATURES)), np.zeros((n, most), dtype=np.int64)
        mask = np.zeros((n, most), dtype=bool)
        for i, (a, b) in enumerate(zip(xs, ys)):
            x[i, : len(a)], y[i, : len(b)], mask[i, : len(a)] = a, b, True
        total = mask.sum()
        hot = np.eye(2)[y] * mask[:, :, None]
        both = mask[:, 1:, None, None] * hot[:, :-1, :, None] * hot[:, 1:, None, :]
        seen_unary, seen_step = np.einsum("ntl,ntf->lf", hot, x), both.sum(axis=(0, 1))
        params = np.concatenate([self.unary.ravel(), self.step.ravel()])
        m, v = np.zeros_like(params), np.zeros_like(params)
        for t in range(1, epochs + 1):
            unary, step = params[: 2 * N_FEATURES].reshape(2, N_FEATURES), params[2 * N_FEATURES :].reshape(2, 2)
            u = x @ unary.T
            alpha, beta = np.zeros((n, most, 2)), np.zeros((n, most, 2))
            alpha[:, 0] = u[:, 0]
            for k in range(1, most):
                alpha[:, k] = np.where(mask[:, k, None], np.logaddexp(alpha[:, k - 1, :1] + step[0], alpha[:, k - 1, 1:] + step[1]) + u[:, k], alpha[:, k - 1])
            z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            for k in range(most - 2, -1, -1):
                ahead = u[:, k + 1] + beta[:, k + 1]
                beta[:, k] = np.where(mask[:, k + 1, None], np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:]), 0.0)
            p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
            pair = alpha[:, :-1, :, None] + step + (u + beta)[:, 1:, None, :] - z[:, None, None, None]
            pair = np.exp(np.minimum(pair, 0)) * mask[:, 1:, None, None]
            grad = np.concatenate([(np.einsum("ntl,ntf->lf", p, x) - seen_unary).ravel(), (pair.sum(axis=(0, 1)) - seen_step).ravel()]) / total + l2 * params
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return Crf(params[: 2 * N_FEATURES].reshape(2, N_FEATURES), params[2 * N_FEATURES :].reshape(2, 2))


#: Sequences are cut to this many lines for training only.
TRAIN_LINES = 400


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Crf:
    """A CRF from texts and labels (0 or 1) of ids."""
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, per_class, "rules")
    xs, marks = [], []
    for r in sample:
        x, _ = observe((r["text"] or "").encode())
        for at in range(0, len(x), TRAIN_LINES):
            xs.append(x[at : at + TRAIN_LINES])
            marks.append(r["label"])
    if len(set(marks)) < 2:
        return Crf.flat()
    ys = [np.full(len(x), 1 - label) for x, label in zip(xs, marks)]
    first = Crf.flat().fit(xs, ys)
    for i, label in enumerate(marks):
        if label == 0:
            decoded = first.viterbi(xs[i])
            ys[i] = decoded if decoded.any() else ys[i]
    return Crf(first.unary, first.step).fit(xs, ys)


COLUMNS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, n_lines bigint, n_content_words bigint"
)


def judge(data: bytes | None, model: Crf) -> tuple:
    """The values of ``COLUMNS`` for a text."""
    data = data or b""
    n, repeated = repeated_words(data)
    spaces = len(data) - len(data.translate(None, SPACE))
    continued = int((np.frombuffer(data, dtype=np.int8) < -64).sum())
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines, again = lines_of(data)
    x = np.array([line_features(a, b) for a, b in zip(lines, again)], dtype=np.float64).reshape(-1, N_FEATURES)
    labels = model.viterbi(x).tolist() if lines else []
    content = sum(len(a.split()) for a, label in zip(lines, labels) if label == 0)
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    kept = not failed and content >= LEAST_CONTENT * n
    return n, len(data) - spaces - continued, symbols, sum(again), repeated, failed, kept, len(lines), content


def evaluate(docs: DataFrame, model: Crf, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``COLUMNS``) of every whole text."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    names = ["id", *(c.split()[0] for c in COLUMNS.split(", "))]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(judge(x.as_py(), model) for x in batch.column(1)))) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return own.mapInArrow(scan, f"id {own.schema['id'].dataType.simpleString()}, {COLUMNS}")
