"""Language identification with hyperdimensional profiles.

Each letter owns a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, the first
permuted twice, the second once; a text's vector bundles (adds) those of all its trigrams, and a language's prototype
bundles its labelled texts. A text gets the language whose prototype has the largest cosine with its vector.

Letters are folded to lower case; letters beyond a-z share a hundred vectors by code point, so that neighbouring letters of
a script differ; runs of other characters count as one gap. A text is counted per distinct trigram first, so bundling is
a matrix product for a block of texts, taken some trigrams at a time.
Prototypes are fitted on about ``train_rows`` labelled texts (whole ones), shared out evenly among the languages; a rare one
gives all it has, and none is asked for less than ``LEAST_ROWS``, so that many languages may exceed the bound by that
number each. A seeded hash picks the texts; the rest of the work is one pass without a shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when nothing labelled
exists; equal cosines fall to the smaller language name; repeated rows are judged alike; an empty table gives no rows;
columns named like the operator's own are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import released

DIMENSIONS = 1024
SYMBOLS = 128
TRAIN_ROWS = 20_000
#: Texts that a language gives at least, if it has so many.
LEAST_ROWS = 20
UNKNOWN = "und"
_BLOCK = 64
#: Trigrams whose vectors a worker remembers at most, and that a matrix product takes at a time.
_KNOWN = 40_000
_COLUMNS = 8_192


def symbol_table() -> np.ndarray:
    """Code point to symbol: 0 for a gap, 1 to 26 for a-z, the rest shared by other letters."""
    out = np.zeros(0x32400, np.uint8)
    for i in range(len(out)):
        c = chr(i)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[i] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 4294967296 % (SYMBOLS - 27)
    return out


class Profiler:
    """Vectors of texts; trigram vectors are made when first met."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 5):
        letters = np.where(np.random.default_rng(seed).random((SYMBOLS, dimensions)) < 0.5, -1, 1).astype(np.float32)
        self.first, self.second, self.third = np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters
        self.table = symbol_table()
        self.row = np.full(SYMBOLS**3, -1, np.int32)
        self.used = np.zeros(SYMBOLS**3, bool)
        self.place = np.zeros(SYMBOLS**3, np.int32)
        self.matrix = np.zeros((1024, dimensions), np.int8)
        self.known = 0

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct trigrams of a text and how often each occurs; None without a letter."""
        if not text:
            return None
        try:
            codes = np.frombuffer(text.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            codes = np.where(codes < len(self.table), codes, 0)
        s = self.table[codes]
        if not s.any():
            return None
        s = np.concatenate(([0], s, [0])).astype(np.uint8)
        held = s != 0
        held[0] = True
        held[1:] |= s[:-1] != 0
        s = s[held].astype(np.int32)
        return np.unique((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], return_counts=True)

    def _rows(self, which: np.ndarray) -> np.ndarray:
        new = which[self.row[which] < 0]
        if len(new):
            need = self.known + len(new)
            if need > len(self.matrix):
                grown = np.zeros((max(need, 2 * len(self.matrix)), self.matrix.shape[1]), np.int8)
                grown[: self.known] = self.matrix[: self.known]
                self.matrix = grown
            self.matrix[self.known : need] = self.first[new // SYMBOLS**2] * self.second[new // SYMBOLS % SYMBOLS] * self.third[new % SYMBOLS]
            self.row[new] = np.arange(self.known, need)
            self.known = need
        return self.row[which]

    def bundle(self, counted: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A vector for each text."""
        for which, _ in counted:
            self.used[which] = True
        every = np.flatnonzero(self.used)
        self.used[every] = False
        self.place[every] = np.arange(len(every))
        block = np.zeros((len(counted), len(every)), np.float32)
        for k, (which, n) in enumerate(counted):
            block[k, self.place[which]] = n
        out = np.zeros((len(counted), self.matrix.shape[1]), np.float32)
        for at in range(0, len(every), _COLUMNS):
            if self.known > _KNOWN:
                self.row.fill(-1)
                self.known = 0
            rows = self._rows(every[at : at + _COLUMNS])
            out += block[:, at : at + _COLUMNS] @ self.matrix[rows].astype(np.float32)
        return out


def fit(labelled: DataFrame, *, train_rows: int = TRAIN_ROWS, dimensions: int = DIMENSIONS, seed: int = 5) -> tuple[list[str], np.ndarray]:
    """Language names in order and their prototypes, from ``doc_id, text, lang`` rows; about ``train_rows`` are used."""
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = sorted((r["count"], r.lang) for r in labelled.groupBy("lang").count().collect())  # a row for each language
    if sum(n for n, _ in sizes) > train_rows:
        span, left = 1 << 30, train_rows
        below = []
        for k, (n, lang) in enumerate(sizes):
            share = left / (len(sizes) - k)
            left -= min(n, share)
            below.append((lang, int(span * min(1.0, max(share, LEAST_ROWS) / n))))
        rates = labelled.sparkSession.createDataFrame(below, "lang string, below long")
        labelled = labelled.join(F.broadcast(rates), "lang").filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(span)) < F.col("below"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, sums = Profiler(dimensions, seed), {}
        for batch in batches:
            texts, langs = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, _BLOCK):
                counted = [(c, lang) for t, lang in zip(texts.slice(at, _BLOCK).to_pylist(), langs.slice(at, _BLOCK).to_pylist(), strict=True) if (c := profiler.counts(t))]
                if counted:
                    for v, (_, lang) in zip(profiler.bundle([c for c, _ in counted]).astype(np.float64), counted, strict=True):
                        sums[lang] = sums.get(lang, 0) + v / max(np.linalg.norm(v), 1e-9)  # a long text weighs no more than others
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([list(v) for v in sums.values()], pa.list_(pa.float64()))], ["lang", "bundle"])

    total: dict[str, np.ndarray] = {}
    for lang, bundle in labelled.select("text", "lang").repartition(32).mapInArrow(released(part), "lang string, bundle array<double>").collect():  # 32 rows a language at most
        total[lang] = total.get(lang, 0) + np.array(bundle)
    names = sorted(total)
    return names, np.array([total[k] / max(np.linalg.norm(total[k]), 1e-9) for k in names], np.float32).reshape(len(names), dimensions)


def classify(docs: DataFrame, names: list[str], prototypes: np.ndarray, *, keep: Sequence[str] | None = None, seed: int = 5) -> DataFrame:
    """``docs`` (its ``keep`` columns, or all) with ``lang_pred string, score double``."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    # a text that is kept travels once
    inner = docs.select(*[F.col("text").alias("__text")] * ("text" not in keep), *[F.col(f"`{c}`") for c in keep])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields if f.name in keep)
    dimensions = prototypes.shape[1]

    def judge(texts: Iterable[str | None], profiler: Profiler) -> tuple[list[str], list[float]]:
        counted = [profiler.counts(t) for t in texts]
        some = [k for k, c in enumerate(counted) if c]
        pred, score = [UNKNOWN] * len(counted), [0.0] * len(counted)
        if some and names:
            v = profiler.bundle([counted[k] for k in some])
            cos = (v @ prototypes.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            for k, best, row in zip(some, cos.argmax(1), cos, strict=True):
                pred[k], score[k] = names[best], float(min(1.0, max(0.0, row[best])))
        return pred, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler = Profiler(dimensions, seed)
        for batch in batches:
            pred, score = [], []
            for at in range(0, batch.num_rows, _BLOCK):
                p, s = judge(batch.column("text" if "text" in keep else "__text").slice(at, _BLOCK).to_pylist(), profiler)
                pred += p
                score += s
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return inner.mapInArrow(released(run), ", ".join(x for x in (kinds, "lang_pred string, score double") if x))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: the checksum of its identifier as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
