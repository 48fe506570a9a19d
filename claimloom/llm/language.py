"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter trigram is the product of its letters' vectors, each rotated by its
place; a text is the sum of its trigrams, and a language the sum of its texts.  A text has the language whose vector makes the smallest
angle with its own.  Sums can be taken in any order, so every task bundles its own texts and only one vector per
task and language is sent on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import chosen, texts_of

DIMENSIONS = 1024
UNKNOWN = "und"
KEPT_TRIGRAMS = 1 << 16
DOCS_AT_ONCE = 64
_BITS = np.uint64(21)
_letter_vectors: dict[int, np.ndarray] = {}
_plain_letters = np.array([chr(c).isalpha() for c in range(1 << 16)])


def trigrams_of(text: str) -> np.ndarray:
    """Codes of the letter trigrams of a text in lower case; runs of other characters are one blank, also around the text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _plain_letters[np.minimum(points, (1 << 16) - 1)]
    for at in np.flatnonzero(points >= 1 << 16):
        letter[at] = chr(points[at]).isalpha()
    if not letter.any():
        return np.empty(0, np.uint64)
    codes = np.concatenate(([0], np.where(letter, points, 0), [0])).astype(np.uint64)
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    return (codes[:-2] << (_BITS + _BITS)) | (codes[1:-1] << _BITS) | codes[2:]


def _letters(points: np.ndarray) -> np.ndarray:
    for p in np.unique(points).tolist():
        if p not in _letter_vectors:
            _letter_vectors[p] = np.random.Generator(np.random.Philox(key=p)).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1
    return np.stack([_letter_vectors[p] for p in points.tolist()]) if len(points) else np.empty((0, DIMENSIONS), np.int8)


def bound(codes: np.ndarray) -> np.ndarray:
    """Vectors of trigrams: rotated letter vectors multiplied."""
    mask = np.uint64((1 << 21) - 1)
    parts = [_letters(((codes >> np.uint64(21 * (2 - i))) & mask).astype(np.int64)) for i in range(3)]
    return np.roll(parts[0], 2, axis=1) * np.roll(parts[1], 1, axis=1) * parts[2]


class _Known:
    """Vectors of the trigrams met so far in this worker, at most KEPT_TRIGRAMS."""

    def __init__(self):
        self.codes, self.vectors = np.empty(0, np.uint64), np.empty((0, DIMENSIONS), np.int8)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct codes."""
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        if len(new):
            if len(self.codes) + len(new) > KEPT_TRIGRAMS:
                self.codes, self.vectors, new = np.empty(0, np.uint64), np.empty((0, DIMENSIONS), np.int8), codes
                if len(new) > KEPT_TRIGRAMS:
                    return bound(new)
            all_ = np.concatenate((self.codes, new))
            order = np.argsort(all_)
            self.vectors = np.concatenate((self.vectors, bound(new)))[order]
            self.codes = all_[order]
        return self.vectors[np.searchsorted(self.codes, codes)]


_known = _Known()


def bundles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of the texts, which of them hold a letter)."""
    grams = [np.unique(trigrams_of(t), return_counts=True) for t in texts]
    codes = np.unique(np.concatenate([g for g, _ in grams])) if grams else np.empty(0, np.uint64)
    counts = np.zeros((len(texts), len(codes)), np.float32)
    for i, (g, n) in enumerate(grams):
        counts[i, np.searchsorted(codes, g)] = n
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for low in range(0, len(codes), 8192):
        out += counts[:, low:low + 8192] @ _known.of(codes[low:low + 8192]).astype(np.float32)
    return out, np.array([len(g) > 0 for g, _ in grams], bool)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of each language from all rows with a text and a language; as many as there are languages."""
    def work(batches):
        sums: dict[str, np.ndarray] = {}
        held: dict[str, list] = {}

        def bundle(lang: str) -> None:
            parts = held.pop(lang)
            codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([n for _, n in parts]))
            total = sums.setdefault(lang, np.zeros(DIMENSIONS))
            for low in range(0, len(codes), 8192):
                total += counts[low:low + 8192] @ bound(codes[low:low + 8192]).astype(np.float64)

        for batch in batches:
            texts, langs = texts_of(batch.column(0)), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                codes = [trigrams_of(t) for t, x in zip(texts, langs) if x == lang]
                held.setdefault(lang, []).append(np.unique(np.concatenate(codes), return_counts=True))
                if sum(len(c) for c, _ in held[lang]) > 1 << 20:
                    bundle(lang)
        for lang in list(held):
            bundle(lang)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(total, pa.float64())], names=["lang", "at", "value"])

    parts = (chosen(docs, text=text_col, lang=lang_col).where("text is not null and lang is not null")
             .mapInArrow(work, "lang string, at int, value double"))
    rows = parts.groupBy("lang", "at").agg(F.sum("value").alias("value")).collect()  # languages x dimensions
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(DIMENSIONS, np.float32))[r["at"]] = r["value"]
    return dict(sorted(out.items()))


def tagged(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` as in_0, in_1, ... with ``lang_pred`` and ``score``: nearest prototype and its cosine, cut to 0..1."""
    names = list(prototypes)
    matrix = np.stack([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-12) for n in names]) if names else np.zeros((0, DIMENSIONS), np.float32)
    place = docs.columns.index(text_col)

    def work(batches):
        for batch in batches:
            texts = texts_of(batch.column(place))
            langs, scores = [], []
            for low in range(0, len(texts), DOCS_AT_ONCE):
                vectors, lettered = bundles(texts[low:low + DOCS_AT_ONCE])
                cosines = vectors @ matrix.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                for i, fine in enumerate(lettered):
                    best = int(np.argmax(cosines[i])) if fine and names else -1
                    langs.append(names[best] if best >= 0 else UNKNOWN)
                    scores.append(float(np.clip(cosines[i, best], 0, 1)) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    given = docs.toDF(*[f"in_{i}" for i in range(len(docs.columns))])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields)
    return given.mapInArrow(work, f"{kinds}, lang_pred string, score double")


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything when nothing was learnt.  Ties go to the
    first language by name.  Repeated rows are judged each; an empty table gives an empty result; further columns are ignored.
    """
    return tagged(chosen(docs, doc_id=id_col, text=text_col), prototypes).select(F.col("in_0").alias("doc_id"), "lang_pred", "score")
