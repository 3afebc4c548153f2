"""A toxicity classifier that is regularised with counterfactuals: swapping identity terms must not move its score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Workspace, share, shared
from .words import PUNCTUATION, RunHashes, mix, text_slices, word_spans

#: Terms that may stand for one another in a sentence; the first of each row is neutral.
IDENTITY_TERMS = (
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("people", "women", "men", "girls", "boys", "transgender"),
    ("person", "woman", "man", "girl", "boy"),
    ("person", "gay", "lesbian", "bisexual", "straight", "queer"),
    ("person", "black", "white", "asian", "latino", "african", "european"),
    ("people", "immigrants", "refugees", "foreigners", "natives"),
    ("person", "disabled", "deaf", "blind", "old", "young"),
    ("person", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "catholic"),
)

BITS = 20
#: Whole words, and their first bytes for endings that vary.
PREFIXES = (0, 3, 4, 5, 6)
THRESHOLD = 0.7


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, a column for each of PREFIXES (-1 where a word is too short), and the text each belongs to."""
    start, stop, of = word_spans(data, offsets, PUNCTUATION)
    hashes = RunHashes(data)
    out = np.full((len(start), len(PREFIXES)), -1, np.int64)
    for c, n in enumerate(PREFIXES):
        ok = stop - start > n
        at, end = start[ok], (start[ok] + n if n else stop[ok])
        out[ok, c] = mix(hashes(at, end) ^ np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - BITS)
    return out, np.repeat(np.arange(len(offsets) - 1), np.diff(of))


def _features_of(word: str) -> np.ndarray:
    data = np.frombuffer(word.encode(), np.uint8)
    return _features(data, np.array([0, len(data)]))[0][0]


def _distinct(features: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once for each text: texts and features, in order."""
    key = np.unique((of[:, None] << BITS | features)[features >= 0])
    return key >> BITS, key & ((1 << BITS) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j, data, offsets in text_slices(batch.column(1)):
            of, feature = _distinct(*_features(data, offsets))
            for y in (0, 1):
                counts[y] += np.bincount(feature[label[i:j][of] == y], minlength=1 << BITS)
    at = np.flatnonzero(counts.sum(0) >= 1)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[1][at], pa.int64()), pa.array(counts[0][at], pa.int64())], names=["feature", "pos", "neg"])


def _encode(batches: Iterator[pa.RecordBatch], slots: np.ndarray, terms: tuple[tuple[str, ...], ...]) -> Iterator[pa.RecordBatch]:
    """Each text's chosen features, and those of its counterfactuals: all identity terms swapped, once for the neutral term and once for another."""
    table = {int(_features_of(w)[0]): (row, k) for row in reversed(terms) for k, w in enumerate(row)}
    made = {w: _features_of(w) for row in terms for w in row}
    known = np.array(sorted(table), np.int64)

    def chosen(features: np.ndarray) -> bytes:
        found = slots[features[features >= 0]]
        return np.unique(found[found >= 0]).astype(np.int32).tobytes()

    for batch in batches:
        label, rows = batch.column(0).to_pylist(), []
        for i, j, data, offsets in text_slices(batch.column(1)):
            features, of = _features(data, offsets)
            first = np.searchsorted(of, np.arange(j - i + 1))
            for d in range(j - i):
                own = features[first[d] : first[d + 1]]
                at, swaps = np.flatnonzero(np.isin(own[:, 0], known)), []
                for turn in (0, 1) if len(at) else ():
                    other = own.copy()
                    for p in at:
                        row, k = table[int(own[p, 0])]
                        other[p] = made[row[0] if turn == 0 and k else row[1 + k % (len(row) - 1)]]
                    swaps.append(chosen(other))
                rows.append({"label": label[i + d], "own": chosen(own), "swaps": swaps})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("label", pa.int32()), ("own", pa.binary()), ("swaps", pa.list_(pa.binary()))]))


class _Rows:
    """Sparse rows of ones."""

    def __init__(self, rows: list[bytes], width: int):
        self.sizes = np.array([len(r) // 4 for r in rows], np.int64)
        self.at = np.frombuffer(b"".join(rows), np.int32)
        self.of, self.width = np.repeat(np.arange(len(rows)), self.sizes), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, w[self.at], len(self.sizes))

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, r[self.of], self.width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    slots: np.ndarray  # feature number to weight, or -1
    weights: np.ndarray
    bias: float

    def __getstate__(self) -> tuple:
        """Of all slots only those in use are sent."""
        at = np.flatnonzero(self.slots >= 0)
        return at, self.slots[at], self.weights, self.bias

    def __setstate__(self, state: tuple) -> None:
        at, own, self.weights, self.bias = state
        self.slots = np.full(1 << BITS, -1, np.int32)
        self.slots[at] = own

    @staticmethod
    def fit(rows: list[tuple[int, bytes, list[bytes]]], slots: np.ndarray, width: int, penalty: float, ridge: float = 2e-6, steps: int = 400) -> Model:
        """Logistic loss + ridge + penalty x mean squared change of the log-odds under swaps, by Adam on all rows."""
        if not rows:
            return Model(slots, np.zeros(width), -2.0)
        x, y = _Rows([r[1] for r in rows], width), np.array([r[0] for r in rows], float)
        pairs = [(r[1], s) for r in rows for s in r[2]]
        a, b = _Rows([p[0] for p in pairs], width), _Rows([p[1] for p in pairs], width)
        w, bias = np.zeros(width), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        m, v = np.zeros(width + 1), np.zeros(width + 1)
        # The rarer label weighs more, by the root of its rarity.
        weight = np.where(y > 0, np.sqrt(max(1.0, (len(y) - y.sum()) / max(1.0, y.sum()))), 1.0) / len(y)
        for t in range(1, steps + 1):
            r = (_sigmoid(x.dot(w) + bias) - y) * weight
            g = x.back(r) + ridge * w
            if pairs:
                d = (a.dot(w) - b.dot(w)) * 2 * penalty / len(pairs)
                g += a.back(d) - b.back(d)
            g = np.r_[g, r.sum()]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, bias = w - step[:-1], bias - step[-1]
        return Model(slots, w, float(bias))

    def shift(self, rows: list[tuple[int, bytes, list[bytes]]]) -> float:
        """What to add to the log-odds so that THRESHOLD falls where F1 is best on rows that weren't learned from: in the middle of the best gap."""
        y = np.array([r[0] for r in rows])
        if y.sum() < 20 or (1 - y).sum() < 20:
            return 0.0
        odds = _Rows([r[1] for r in rows], len(self.weights)).dot(self.weights) + self.bias
        order = np.argsort(-odds, kind="stable")
        odds, hits = odds[order], np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
        f1[:-1][odds[:-1] == odds[1:]] = -1  # no cut between equal scores
        best = np.flatnonzero(f1[:-1] >= f1[:-1].max() - 1e-12)
        gaps = odds[best] - odds[best + 1]
        cut = best[gaps.argmax()]
        return float(np.log(THRESHOLD / (1 - THRESHOLD)) - (odds[cut] + odds[cut + 1]) / 2)

    def score(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.names.index("__text"))
            total = np.full(len(text), self.bias)
            for i, j, data, offsets in text_slices(text):
                features, of = _features(data, offsets)
                found = np.where(features >= 0, self.slots[features], -1)
                key = np.unique((of[:, None] << 32 | found)[found >= 0])
                total[i:j] += np.bincount(key >> 32, self.weights[key & 0xFFFFFFFF], j - i)
            keep = [i for i, c in enumerate(batch.schema.names) if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(_sigmoid(total), pa.float64())], names=[*(batch.schema.names[i] for i in keep), "score"])


def fit_toxicity(training: DataFrame, *, text_col: str = "text", label_col: str = "toxic", width: int = 20_000, min_rows: int = 4, penalty: float = 1.0, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> Model:
    """Learns from text and label (0, 1; other rows are left out) of a bounded table; of equal texts one counts, with label 1 if
    any has it. The model is the same however the rows are dealt. Null texts are empty ones; without rows of either
    label every text gets one low score.

    The ``width`` features that labels depend on most are chosen, with all identity terms, so that swaps can act on
    them. What reaches the driver are these features of the training texts.
    """
    spark = training.sparkSession
    work = Workspace(spark, "toxicity")
    rows = training.select(F.col(label_col).cast("int").alias("label"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("label in (0, 1)")
    # Which of equal texts is taken doesn't matter, and of their labels 1 wins: so the model doesn't depend on how rows are dealt.
    rows = work.table(rows.groupBy(F.sha2("text", 256).alias("h")).agg(F.max("label").alias("label"), F.first("text").alias("text")).select("label", "text"))
    n1, n0 = rows.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    n1, n0 = (n1 or 0) + 1, (n0 or 0) + 1
    counts = rows.mapInArrow(_count, "feature int, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") + F.col("neg") >= min_rows)
    p, q = (F.col("pos") + 0.5) / n1, (F.col("neg") + 0.5) / n0
    z = F.abs(F.log(p / q)) / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    best = [r.feature for r in counts.where(z > 2.5).orderBy(F.desc(z), "feature").limit(width).collect()]
    best += [int(f) for row in terms for w in row for f in _features_of(w) if f >= 0]
    best = list(dict.fromkeys(best))
    slots = np.full(1 << BITS, -1, np.int32)
    slots[best] = np.arange(len(best))
    held = share(spark, Model(slots, np.zeros(0), 0.0))
    coded = rows.mapInArrow(lambda b: _encode(b, shared(held).slots, terms), "label int, own binary, swaps array<binary>").collect()
    held.destroy()
    work.drop(rows)
    coded = sorted((r.label, bytes(r.own), [bytes(s) for s in r.swaps]) for r in coded)
    rest = [r for i, r in enumerate(coded) if i % 3 == 0]
    shift = Model.fit([r for i, r in enumerate(coded) if i % 3], slots, len(best), penalty).shift(rest)
    made = Model.fit(coded, slots, len(best), penalty)
    made.bias += shift
    return made


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and score (0 to 1) of every whole text, rows one for one, repeated ones and those with a null id too.

    Null and empty texts get the score of no words; an empty table gives an empty result; other columns are not read.
    """
    held = share(docs.sparkSession, model)
    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return slim.mapInArrow(lambda b: shared(held).score(b), T.StructType([*slim.drop("__text").schema.fields, T.StructField("score", T.DoubleType())]))


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns, whatever these are called, and in place: nothing is shuffled.

    Each row is judged by its own text, as in :func:`score_toxicity`.
    """
    held = share(docs.sparkSession, model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared(held)
        for batch in batches:
            text = pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(text_col))], names=["__text"])
            score = next(own.score(iter([text]))).column("score").to_numpy()
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(clean, docs.schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """Text and toxic of at most ``max_rows`` labelled ids, those with the smallest hash; with a label twice, 1 wins."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    ids = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows ids are broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")


def toxicity_model(spark: SparkSession, sf_dir: str, max_rows: int = 20_000) -> Model:
    """The model of the labelled documents that aren't held out, of at most ``max_rows`` ids."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return fit_toxicity(labelled_sample(docs, labels, max_rows))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; nulls, ties and repeats as in :func:`score_toxicity`."""
    model = toxicity_model(spark, sf_dir)
    scored = score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
