"""Language identification with a blended-spectrum string kernel.

Two texts are compared by the n-grams (1 to 3 bytes of the lower-cased text,
non-letters as one blank each) that are present in both, normalised by how many
each has.  Landmark texts span the Nystroem feature space of that kernel, and
one ridge regression per language against the rest is solved in it.  As n-gram
presence is an explicit (hashed) vector, landmarks and weights fold into one
matrix, and a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import take_by_hash
from .textbytes import LOWER, append_columns, chunks, string_buffers

#: Hash dimensions of n-gram presence.
DIMS = 1 << 14
#: Training texts of all languages together (one of each at least), and landmarks among them.
TRAIN_ROWS = 4000
LANDMARKS = 240
RIDGE = 1e-3
_SHARP = 4.0
_ROWS = 128
_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = True
_LETTERS[128:] = True
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
# The byte an n-gram sees: letters as they are, runs of anything else as blanks.
_SEEN = np.where(_LETTERS, np.arange(256), 32).astype(np.uint32)


def presence(data: np.ndarray, off: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """0/1 matrix (rows x dims): which hashed n-grams each text has."""
    n = len(off) - 1
    x = np.zeros(n * dims, np.uint8)
    if len(data):
        b = _SEEN[LOWER[data]]
        row = np.repeat(np.arange(n), np.diff(off))
        for width in (1, 2, 3):
            if len(b) < width:
                break
            m = len(b) - width + 1
            h = np.full(m, width * 0x01000193, np.uint32)
            for k in range(width):
                h = (h ^ b[k:k + m]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            inside = row[:m] == row[width - 1:]
            x[row[:m][inside] * dims + (h[inside] % np.uint32(dims))] = 1
    return x.reshape(n, dims)


def _has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_ASCII[data])])
    out = seen[off[1:]] > seen[off[:-1]]
    for i in np.flatnonzero(~out & (off[1:] > off[:-1])):
        out[i] = any(map(str.isalpha, data[off[i]:off[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


class Model:
    """Languages and weights: score = presence / norm @ factors[0] @ ...

    Landmarks and weights fold into one matrix (dims x languages) where that is the smaller
    form; with more languages than landmarks they stay two factors, dims x landmarks and
    landmarks x languages, so a language costs a kilobyte at most."""

    def __init__(self, languages: list[str], factors: list[np.ndarray]):
        self.languages = languages
        small = factors[-1].shape[1] <= factors[0].shape[1]
        self.factors = [(factors[0] @ factors[1]).astype(np.float32)] if small else [f.astype(np.float32) for f in factors]

    def scores(self, x: np.ndarray) -> np.ndarray:
        f = x.astype(np.float32)
        norm = np.sqrt(np.maximum(f.sum(axis=1, keepdims=True), 1))
        for m in self.factors:
            f = f @ m
        return f / norm


def solve(packed: list[bytes], labels: list[str], landmarks: int = LANDMARKS, dims: int = DIMS) -> Model:
    """Fit on packed presence rows (bits)."""
    languages = sorted(set(labels))
    rows = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), dims // 8)

    def block(i):
        return np.unpackbits(rows[i], axis=1, count=dims).astype(np.float32)
    number = {v: i for i, v in enumerate(languages)}
    y = np.array([number[v] for v in labels])
    # landmarks in turns over the languages; with more languages than landmarks, of the first ones drawn
    order = np.argsort(y, kind="stable")
    starts = np.searchsorted(y[order], np.arange(len(languages)))
    turn = np.empty(len(y), np.int64)
    turn[order] = np.arange(len(y)) - starts[y[order]]
    per = -(-landmarks // len(languages))
    chosen = np.sort(np.flatnonzero(turn < per)) if len(languages) <= landmarks else np.sort(np.flatnonzero(turn == 0)[:landmarks])
    chosen = chosen[np.argsort(y[chosen], kind="stable")]
    z = block(chosen)
    z /= np.sqrt(np.maximum(z.sum(axis=1, keepdims=True), 1))
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = value > 1e-6 * value[-1]
    lift = vector[:, good] / np.sqrt(value[good])  # kernel to landmarks -> Nystroem features
    share = len(y) / (len(languages) * np.bincount(y, minlength=len(languages)))  # every language weighs the same
    gram, target = RIDGE * len(y) * np.eye(lift.shape[1]), np.zeros((lift.shape[1], len(languages)))
    for at in range(0, len(y), _ROWS):
        x = block(slice(at, at + _ROWS))
        x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        phi = (x @ z.T) @ lift
        w = share[y[at:at + _ROWS]][:, None]
        gram += phi.T @ (w * phi)
        # target 1 for a text's own language, -1 for the others
        target -= (phi.T @ w)
        np.add.at(target.T, y[at:at + _ROWS], 2 * w * phi)
    return Model(languages, [z.T @ lift, np.linalg.solve(gram, target)])


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        train_rows: int = TRAIN_ROWS) -> Model | None:
    """Learn from rows that ``learn`` admits and that have a language and a
    letter: per language at most ``train_rows`` shared evenly and one at least,
    the lowest by hash of id and text.  Any number of languages; the model is
    16 MB and a kilobyte for each at most.  None if there are none."""
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
                    F.col(f"`{text_col}`").alias("text"), learn.alias("learn"))
    d = d.where(F.col("learn") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    d = d.select("lang", F.concat_ws("|", F.col("id").cast("string"), F.xxhash64("text").cast("string")).alias("key"), "text")
    classes = d.select("lang").distinct().count()
    if not classes:
        return None
    # keys are drawn first, so that only the chosen texts move; a repeated row counts once
    chosen = take_by_hash(d.select("lang", "key").distinct(), "lang", "key", max(1, train_rows // classes))
    sample = d.join(F.broadcast(chosen), ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text"))

    def make():
        def fn(batch: pa.RecordBatch):
            data, off = string_buffers(batch.column(0))
            out = []
            for _lo, _hi, part, o in chunks(data, off, rows=_ROWS):
                out += [r.tobytes() for r in np.packbits(presence(part, o), axis=1)]
            return [pa.array(out, pa.binary())]
        return fn
    rows = append_columns(sample, [("bits", "binary")], make, ["text"], drop=["text"]).orderBy("key").collect()
    return solve([bytes(r.bits) for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Append ``lang_pred`` and ``score`` (0 to 1): the language with the highest
    regression value, and the softmax of the values.  Null texts, texts
    without a letter, and all texts where no language was learned get ``und``
    with score 0.  Columns of these names are replaced; repeated rows and
    empty tables are as good as any."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m: Model | None = shared.value

        def fn(batch: pa.RecordBatch):
            data, off = string_buffers(batch.column(0))
            lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for lo, hi, part, o in chunks(data, off, rows=_ROWS) if m else ():
                f = _SHARP * m.scores(presence(part, o)).astype(np.float64)
                e = np.exp(f - f.max(axis=1, keepdims=True))
                p, best = e.max(axis=1) / e.sum(axis=1), f.argmax(axis=1)
                for i in np.flatnonzero(_has_letter(part, o)):
                    lang[lo + i], score[lo + i] = m.languages[best[i]], p[i]
            return [pa.array(lang, pa.string()), pa.array(score)]
        return fn
    return append_columns(docs, [("lang_pred", "string"), ("score", "double")], make, [text_col])
