"""Language identification by a byte convolutional network, in numpy.

Texts are UTF-8 bytes, cut into windows of `WINDOW` bytes that together cover the whole text. A byte is a learned vector;
filters of several widths run over the window, the largest value of each filter is kept, and a softmax over these gives
the window's languages. A text's languages are the mean over its windows, each weighed by its bytes.

A filter of width w over embedded bytes is a sum of w table look-ups, one table of 256 rows for each place in the filter, so
applying the network needs no matrix product per byte. Training learns the tables directly, by Adam on cross-entropy.

Training reads a sample that is bounded by `per_language` rows for each language (a hash of the row decides; 400 by default) and
`per_row` stretches of each row's text, spread evenly from its begin to its end. Prediction covers every byte of every text.

Nulls and edges: a null text, or one without letters (Unicode category L), is `und` with score 0; languages that score alike go by
name, so ties are stable; repeated rows agree; a long text is judged whole, some windows at a time; other columns are ignored, and
passed on by `accepted`; so is every text if no row is labelled.
Rows with null language are never learned from. Equal texts get equal answers. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Shared, chunks

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 12
_MAYBE = re.compile(r"[^\W\d_]")


def has_letters(text: str) -> bool:
    """Whether a character of category L is there; the pattern alone lets numbers such as ½ and Ⅷ pass."""
    return any(m[0].isalpha() for m in _MAYBE.finditer(text))


class Network:
    def __init__(self, languages: list[str], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def pooled(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest value of each filter over each row of bytes, and its place."""
        parts, places = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            t = self.tables[w]
            a = t[0][x[:, :n]]
            for k in range(1, w):
                a += t[k][x[:, k : k + n]]
            if where:
                at = a.argmax(axis=1)
                places.append(at)
                top = np.take_along_axis(a, at[:, None, :], axis=1)[:, 0]
            else:
                top = a.max(axis=1)
            parts.append(np.maximum(top + self.bias[w], 0))
        return np.concatenate(parts, axis=1), places

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h, _ = self.pooled(x)
        z = h @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 96, rate: float = 0.01, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        weights = [*(self.tables[w] for w in WIDTHS), *(self.bias[w] for w in WIDTHS), self.out, self.out_bias]
        m, v = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights]
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            bx, by = x[pick], y[pick]
            h, places = self.pooled(bx, where=True)
            z = h @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(batch), by] -= 1
            z /= batch
            back = (z @ self.out.T) * (h > 0)
            tables, biases = [], []
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                t = np.zeros_like(self.tables[w])
                for k in range(w):
                    np.add.at(t[k], (np.take_along_axis(bx, places[i] + k, axis=1), np.arange(FILTERS)), g)
                tables.append(t)
                biases.append(g.sum(axis=0))
            for p, g, a, b in zip(weights, [*tables, *biases, h.T @ z, z.sum(axis=0)], m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)


def windows(data: bytes) -> np.ndarray:
    """The whole text as rows of WINDOW bytes; the last one is filled with spaces."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW), np.uint8).reshape(n, WINDOW)


def learned(docs: DataFrame, allowed: Column, *, per_language: int = 400, per_row: int = 4, seed: int = 3) -> Network | None:
    """A network trained on about per_language rows of each language among the rows that `allowed` selects; None if there are none."""
    rows = docs.filter(allowed).filter("lang is not null and text is not null and doc_id is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    least = F.create_map(*[x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(int((1 << 30) * min(1.0, per_language / n))))])
    spare = F.greatest(F.lit(0), F.length("text") - WINDOW)
    parts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(per_row - 1)), lambda i: F.col("text").substr(F.floor(spare * i / max(1, per_row - 1)).cast("int") + 1, F.lit(WINDOW))))
    some = rows.filter(draw < least[F.col("lang")]).select("doc_id", "lang", parts.alias("parts"))
    languages = sorted(sizes)
    index = {lang: i for i, lang in enumerate(languages)}
    x, y = [], []
    for r in sorted(some.toLocalIterator(), key=lambda r: (r["doc_id"], r["lang"], r["parts"])):
        for t in r["parts"]:
            if has_letters(t):
                x.append(windows(t.encode(errors="replace"))[0])
                y.append(index[r["lang"]])
    if not x:
        return None
    net = Network(languages)
    share = np.bincount(y, minlength=len(languages))
    repeat = np.concatenate([np.resize(np.flatnonzero(np.array(y) == i), share.max()) for i in range(len(languages)) if share[i]])
    net.train(np.stack(x)[repeat], np.array(y)[repeat])
    return net


def judged(net: Network | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    total = np.zeros((len(texts), len(net.languages) if net else 1))
    rows: list[np.ndarray] = []
    owner: list[int] = []
    share: list[float] = []

    def flush() -> None:
        x = np.concatenate(rows)
        for i in range(0, len(x), 128):
            np.add.at(total, owner[i : i + 128], net.probabilities(x[i : i + 128]) * np.array(share[i : i + 128])[:, None])
        rows.clear(), owner.clear(), share.clear()

    for i, text in enumerate(texts):
        if net is None or not text or not has_letters(text):
            continue
        data = text.encode(errors="replace")
        full = windows(data)
        for k in range(0, len(full), 2048):
            part = full[k : k + 2048]
            rows.append(part)
            owner += [i] * len(part)
            share += [min(WINDOW, len(data) - WINDOW * j) / len(data) for j in range(k, k + len(part))]
            if len(owner) >= 2048:
                flush()
    if owner:
        flush()
    known = total.sum(axis=1) > 0
    lang = [net.languages[j] if ok else "und" for j, ok in zip(total.argmax(axis=1).tolist(), known.tolist(), strict=True)]
    return lang, np.where(known, np.minimum(total.max(axis=1), 1.0), 0.0)


def predicted(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs; nothing but the text is read for a prediction."""
    shared = Shared(docs.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in chunks(batches):
            lang, score = judged(shared.value, texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, net: Network | None, least: float = 0.5) -> DataFrame:
    """The rows of docs, as they are, whose language is told with a score of `least` or more; all rows if nothing was learned."""
    if net is None:
        return docs
    shared = Shared(docs.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in chunks(batches):
            yield b.filter(pa.array(judged(shared.value, texts)[1] >= least))

    return docs.mapInArrow(run, docs.schema)


def third(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def identified(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the labelled rows whose crc32(doc_id) mod 3 is not 1."""
    net = learned(docs, third(F.col("doc_id")) != 1, **options)
    return predicted(docs, net).select("doc_id", (F.coalesce(third(F.col("doc_id")), F.lit(0)) == 1).alias("held_out"), "lang_pred", "score")


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
