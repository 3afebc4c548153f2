"""Language identification with error-correcting output codes over byte n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import share, shared, shared_dir
from .words import text_slices

BITS = 14
_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _grams(data: np.ndarray, offsets: np.ndarray, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of three bytes around each letter byte from ``first`` to ``last``, texts set off by spaces, and the text each belongs to."""
    sizes = np.diff(offsets)
    of_byte = np.repeat(np.arange(len(sizes)), sizes)
    padded = np.full(len(data) + len(sizes) + 1, 0x20, np.uint32)
    padded[np.arange(len(data)) + of_byte + 1] = _LETTER[data]
    at = np.flatnonzero(padded[1:-1] != 0x20) + 1
    if first or last is not None:  # of a single text
        at = at[(at > first) & (at <= (len(data) if last is None else last))]
    three = padded[at - 1] << np.uint32(16) | padded[at] << np.uint32(8) | padded[at + 1]
    of_place = np.zeros(len(padded), np.int64)
    of_place[np.arange(len(data)) + of_byte + 1] = of_byte
    return (three * np.uint32(2654435761)) >> np.uint32(32 - BITS), of_place[at]


#: Bytes of a very long text that are looked at together, so memory stays bounded.
PIECE = 1 << 21


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """The arguments of :func:`_grams`: all texts at once, or pieces of a very long one, which overlap by a byte on either side."""
    if len(offsets) == 2 and len(data) > PIECE:
        for i in range(0, len(data), PIECE):
            low, high = max(0, i - 1), min(len(data), i + PIECE + 1)
            yield data[low:high], np.array([0, high - low]), i - low, min(len(data), i + PIECE) - low
    else:
        yield data, offsets, 0, None


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each of n languages: all splits in two for few languages, else random rows far apart."""
    if n <= 1:
        return np.zeros((n, 0))
    if n <= 6:
        return np.array([[1.0 if i == 0 or (s >> (i - 1)) & 1 else -1.0 for s in range((1 << (n - 1)) - 1)] for i in range(n)])
    rng, width = np.random.default_rng(seed), math.ceil(10 * math.log2(n))
    best, apart = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, width))
        code = code[:, np.abs(code.sum(0)) < n]
        gap = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if gap > apart:
            best, apart = code, gap
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # language, bit
    weights: np.ndarray  # gram, bit: log-ratio of its chance on either side of the bit
    trust: np.ndarray  # language, bit: how often a gram of the language votes for its codeword

    @staticmethod
    def fit(counts: dict[str, np.ndarray], seed: int = 7) -> Model:
        """From counts of n-grams per language: no document needs to be seen again."""
        langs = sorted(counts)
        code = codewords(len(langs), seed)
        if not langs:
            return Model([], code, np.zeros((1 << BITS, 0), np.float32), code)
        chance = np.array([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * (1 << BITS)) for x in langs])
        weights = np.stack([np.log(chance[c > 0].mean(0)) - np.log(chance[c < 0].mean(0)) for c in code.T], 1) if code.shape[1] else np.zeros((1 << BITS, 0))
        trust = np.array([[chance[i][weights[:, b] * code[i, b] > 0].sum() for b in range(code.shape[1])] for i in range(len(langs))]).reshape(code.shape)
        trust /= np.maximum(trust.sum(1, keepdims=True), 1e-9)
        return Model(langs, code, weights.astype(np.float32), trust)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language with the least trusted loss to its codeword, its share of exp(-loss), and the share's lead."""
        loss = np.stack([(t * np.logaddexp(0, -12 * c * margins)).sum(1) for c, t in zip(self.code, self.trust, strict=True)], 1)
        share = np.exp(-(loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        ordered = np.sort(share, 1)
        return loss.argmin(1), ordered[:, -1], ordered[:, -1] - (ordered[:, -2] if share.shape[1] > 1 else 0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for i, j, data, offsets in text_slices(batch.column(1)):
            for piece in _pieces(data, offsets):
                grams, of = _grams(*piece)
                own = langs[i:j]
                for lang in set(own):
                    counts[lang] = counts.get(lang, 0) + np.bincount(grams[(own == lang)[of]], minlength=1 << BITS)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "gram", "n"])


def _score(model: Model, batches: Iterator[pa.RecordBatch], lead: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(batch.schema.names.index("__text"))
        margins, letters = np.zeros((len(text), model.code.shape[1])), np.zeros(len(text), bool)
        plain = None
        for i, j, data, offsets in text_slices(text):
            total = np.zeros(j - i)
            for piece in _pieces(data, offsets):
                grams, of = _grams(*piece)
                if len(grams):
                    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                    margins[i + of[first]] += np.add.reduceat(model.weights[grams], first, 0) if model.weights.shape[1] else 0
                total += np.bincount(of, minlength=j - i)
            margins[i:j] /= np.maximum(total, 1)[:, None]
            ascii_letters = np.add.accumulate(np.r_[0, ((data | 32) >= 97) & ((data | 32) <= 122)])
            letters[i:j] = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
            for k in np.flatnonzero(~letters[i:j] & (total > 0)):
                plain = plain or text.to_pylist()
                letters[i + k] = has_letter(plain[i + k])
        if model.langs:
            best, score, gap = model.decode(margins)
            pred = [model.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            score, gap = np.where(letters, score, 0.0), np.where(letters, gap, 0.0)
        else:
            pred, score, gap = ["und"] * len(text), np.zeros(len(text)), np.zeros(len(text))
        keep = [i for i, c in enumerate(batch.schema.names) if c != "__text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(gap < lead, pa.bool_())], names=[*(batch.schema.names[i] for i in keep), "lang_pred", "score", "ambiguous"])


def identify_language(docs: DataFrame, training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", lead: float = 0.2) -> DataFrame:
    """Predicts the language of every whole text: the id, lang_pred, score (0 to 1), ambiguous (close second).

    Binary classifiers of three-byte runs predict the bits of language codewords, from counts over all of
    ``training`` (its text and non-null lang, all of its languages). Loss-weighted decoding takes the nearest codeword. lang_pred is "und" with score 0 where a text is null or has no letter, and
    everywhere if nothing can be learned. Rows are kept one for one, repeated ones and those with a null id too; an
    empty table gives an empty result; other columns are not read.
    What reaches the driver is languages x 2**14 counts, 128 KB a language.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    labelled = training.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null")
    rows = labelled.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for r in rows.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("grams")).toLocalIterator():
        own = counts.setdefault(r.lang, np.zeros(1 << BITS))
        for gram, n in r.grams:
            own[gram] = n
    held = share(spark, Model.fit(counts))
    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([*slim.drop("__text").schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return slim.mapInArrow(lambda batches: _score(shared(held), batches, lead), schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those not held out; nulls, ties and repeats as in :func:`identify_language`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    out = identify_language(docs, docs.where(~held_out).where("doc_id is not null"))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
