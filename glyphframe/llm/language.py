"""Language identification: sparse multinomial logistic regression on character n-grams.

N-grams of one to three code points of the lower-cased text (anything but letters and their marks is a space) are
hashed into ``SIZE`` features and weighted by TF-IDF.  The classifier learns by follow-the-
regularised-leader with elastic-net penalties and is calibrated by a temperature.

It is fitted on the driver with a bounded sample: ``PER_LANGUAGE`` rows of each language,
whole texts.  Scoring is a scan over whole texts; long ones are counted in pieces, so memory does
not grow with a text.

Edge cases: a text that is null or has no letter is ``und`` with score 0.  Without rows to learn
from everything is ``und``.  A single language gets score 1.  Repeated rows appear as often
as they come.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphframe.llm.common import sample_ids
from glyphframe.llm.linear import SparseSoftmax, softmax

BITS = 15
SIZE = 1 << BITS
PER_LANGUAGE = 300
UNKNOWN = "und"
#: Characters that are counted at a time.
PIECE = 1 << 20
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


#: A bit for each code point: whether it is a letter or a mark (of a letter).  It travels with the functions to executors.
_KEPT = np.packbits([chr(c).isalpha() or unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)])
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: itself if it is a letter or a mark, else a space."""
    if not _letters:
        every = np.arange(0x110000, dtype=np.uint32)
        _letters.append(np.where(np.unpackbits(_KEPT)[: len(every)] == 1, every, np.uint32(32)))
    return _letters[0]


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs; a text in pieces gives what it gives as a whole."""
    out, before = np.zeros(SIZE, dtype=np.int64), np.zeros(0, dtype=np.uint32)
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE].replace("\u03a3", "\u03c3").lower()  # a capital sigma alone depends on what follows
        own = letters()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        c, new = np.concatenate([before, own]), len(before)
        one = c * _MIX[0]
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _MIX[1] + one[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * _MIX[2] + one[2:]
        for size, h in enumerate((one, two, three)):
            h = h[max(0, new - size) :]  # those that end in this piece
            h = h ^ (h >> np.uint32(16))
            out += np.bincount((h * _MIX[1]) >> np.uint32(32 - BITS), minlength=SIZE)
        before = c[-2:]
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Identifier:
    """A fitted classifier."""

    def __init__(self, idf: np.ndarray, weights: np.ndarray, classes: list[str], temperature: float):
        self.idf, self.weights, self.classes, self.temperature = idf, weights, classes, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.classes or not has_letter(text):
            return UNKNOWN, 0.0
        idx, values = features(counts(text), self.idf)
        p = softmax(values @ self.weights[idx] / self.temperature)
        best = int(p.argmax())
        return self.classes[best], float(p[best])


def features(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF of unit length."""
    idx = np.flatnonzero(found)
    values = (1 + np.log(found[idx])) * idf[idx]
    return idx, values / max(1e-12, float(np.sqrt((values**2).sum())))


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE) -> Identifier:
    """From rows (id, text, label) without null labels."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.where("label is not null and text is not null")
    sample = sample_ids(rows, "id", "label", per_language, "language").collect()
    sample = sorted((r for r in sample if has_letter(r["text"])), key=lambda r: (r["id"] is None, r["id"] or 0, r["text"]))
    classes = sorted({r["label"] for r in sample})
    found = [counts(r["text"]) for r in sample]
    seen = sum(((c > 0).astype(np.int64) for c in found), np.zeros(SIZE, dtype=np.int64))
    idf = np.log((1 + len(sample)) / (1 + seen)) + 1
    if not classes:
        return Identifier(idf, np.zeros((SIZE, 0)), [], 1.0)
    model = SparseSoftmax(SIZE, classes).fit([features(c, idf) for c in found], [classes.index(r["label"]) for r in sample])
    return Identifier(idf, model.weights(), classes, model.temperature)


def identify(docs: DataFrame, model: Identifier, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["id", "lang_pred", "score"]
            )

    return own.mapInArrow(scan, f"id {own.schema['id'].dataType.simpleString()}, lang_pred string, score double")
