"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise
interactions at low rank, in time linear in the features of a text. Words are hashed, weighted by 1 + ln(count)
and scaled to length 1. Structure statistics of the whole text (sizes, shares of character classes, repetition
of words and lines) and the metadata column n_chars are cut into fixed bins, one feature each.

The model is fitted on the driver by AdaGrad on at most ``max_train`` labelled ids, those with the smallest hashes, and
one text of each (of several the one with the least features' bytes); only feature numbers reach the driver, never texts. Everything else runs
over whole texts of all rows, in one narrow pass.

Null text counts as empty and gets the score of an empty text. A null n_chars has a bin of its own. A null id
is never held out and never has a label. Ids with labels that differ take the lowest. Repeated rows are scored
each by itself. An empty table gives no rows. Texts of any length are scored whole. A column that has the name of the score is
replaced; other columns may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORD_BITS = 17
WORDS = 1 << WORD_BITS
BINS = 24
RANK = 8
MAX_TRAIN = 6000
THRESHOLD = 0.7

#: Statistics in the order of their bins.
STATS = ("bytes", "words", "word_length", "letters", "upper", "digits", "spaces", "symbols", "sentence_marks", "pipes", "lines", "line_length", "distinct_words", "top_word", "repeated_lines", "odd_ends", "n_chars")
FEATURES = WORDS + len(STATS) * BINS

_LETTER = np.zeros(256)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER = np.zeros(256)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256)
_DIGIT[48:58] = 1
_SPACE = np.zeros(256)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_SENTENCE = np.zeros(256)
_SENTENCE[[ord(c) for c in ".,!?;:"]] = 1
CLASSES = np.stack([_LETTER, _UPPER, _DIGIT, _SPACE, 1 - np.minimum(1, _LETTER + _DIGIT + _SPACE + _SENTENCE), _SENTENCE])


def _share(x: float) -> int:
    """Bin of a share in 0..1, on a logit scale: fine near both ends; 0 has its own."""
    return 0 if x <= 0 else max(1, min(BINS - 1, 12 + round(2 * math.log((x + 1e-3) / (max(0.0, 1 - x) + 1e-3)))))


def _log(x: float) -> int:
    return min(BINS - 1, int(1.5 * math.log2(1 + max(0.0, x))))


class Features:
    def __init__(self):
        self.hashed = common.Memo(lambda w: zlib.crc32(w.lower().encode("utf-8", "replace")) & (WORDS - 1), 200_000)

    def __call__(self, text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        words, data = text.split(), text.encode("utf-8", "replace")
        n, size = len(words), len(data)
        if n:
            ids, counts = np.unique(np.fromiter(map(self.hashed.__getitem__, words), np.int64, n), return_counts=True)
            weights = 1 + np.log(counts)
            weights /= math.sqrt(float(weights @ weights))
        else:
            ids, counts, weights = np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0)
        by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        letters, upper, digits, spaces, symbols, marks = CLASSES @ by_byte / max(1, size)
        lines = text.split("\n")
        full = [x for x in lines if x]
        ends = Counter(w[-1] for w in words)
        odd = sum(v for c, v in ends.items() if not c.isalnum() and c not in ".,!?;:\"')") / max(1, n)
        values = (_log(size), _log(n), min(BINS - 1, int(2 * (size - spaces * size) / max(1, n))), _share(letters), _share(upper / max(1e-9, letters)), _share(digits), _share(spaces), _share(symbols), _share(marks), _share(by_byte[124] / max(1, n)), _log(len(lines)), _log(size / len(lines)), _share(len(ids) / max(1, n)), _share(int(counts.max()) / max(1, n)), _share(1 - len(set(full)) / max(1, len(full))), _share(odd), BINS - 1 if n_chars is None else min(BINS - 2, _log(n_chars)))
        bins = WORDS + BINS * np.arange(len(STATS)) + np.array(values)
        return np.concatenate([ids, bins]).astype(np.int32), np.concatenate([weights, np.full(len(STATS), 0.5)]).astype(np.float32)


def worker_features() -> Features:
    return common.held("quality", Features)


class FactorisationMachine:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.linear = np.zeros(FEATURES, np.float32)
        self.factors = rng.normal(0, 0.05, (FEATURES, RANK)).astype(np.float32)
        self.squares = self.factors**2

    def raw(self, ids: np.ndarray, x: np.ndarray) -> float:
        s = x @ self.factors[ids]
        return float(self.bias + x @ self.linear[ids] + 0.5 * (s @ s - float((x * x) @ self.squares[ids].sum(axis=1))))

    def score(self, ids: np.ndarray, x: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.raw(ids, x)))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 6, rate: float = 0.08, decay: float = 1e-4) -> FactorisationMachine:
        rng, eps = np.random.default_rng(11), 1e-6
        g_bias, g_linear, g_factors = eps, np.full(FEATURES, eps, np.float32), np.full((FEATURES, RANK), eps, np.float32)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                ids, x = rows[k]
                v = self.factors[ids]
                s = x @ v
                y = self.bias + x @ self.linear[ids] + 0.5 * float(s @ s - ((x * x)[:, None] * v * v).sum())
                error = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(y))))) - labels[k]
                g_bias += error * error
                self.bias -= rate * error / math.sqrt(g_bias)
                grad = error * x + decay * self.linear[ids]
                g_linear[ids] += grad * grad
                self.linear[ids] -= rate * grad / np.sqrt(g_linear[ids])
                grad = error * (x[:, None] * s - (x * x)[:, None] * v) + decay * v
                g_factors[ids] += grad * grad
                self.factors[ids] = v - rate * grad / np.sqrt(g_factors[ids])
        self.squares = self.factors**2
        return self


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return [F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), chars.alias("n_chars")]


def may_learn(id_col: str = "doc_id") -> Column:
    return common.bucket_of(id_col, 4) != 2


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> FactorisationMachine:
    """Fit on labelled rows that may be learnt from. Without any: a model that scores 0.5 throughout."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & may_learn("doc_id")).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select(*_inputs(docs, id_col, text_col)).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text", "n_chars")

    def make():
        features = worker_features()

        def each(b):
            got = [features(t, n) for t, n in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist(), strict=True)]
            return {"doc_id": b.column("doc_id").cast(pa.int64()), "quality": b.column("quality"), "ids": [i.tobytes() for i, _ in got], "x": [x.tobytes() for _, x in got]}

        return each

    one = common.arrow_map(rows, make, "doc_id long, quality int, ids binary, x binary").groupBy("doc_id", "quality").agg(F.min(F.struct("ids", "x")).alias("f"))
    fitted = sorted(one.select("doc_id", "quality", "f.*").collect(), key=lambda r: r["doc_id"])
    model = FactorisationMachine()
    return model.fit([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["x"], np.float32)) for r in fitted], [r["quality"] for r in fitted])


def with_score(docs: DataFrame, model: FactorisationMachine, out: str = "score", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the score in a column named out, which replaces one of that name."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    kept = [f for f in docs.schema.fields if f.name != out]
    schema = StructType([*kept, StructField(out, DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at, chars = [f.name for f in kept].index(text_col), [f.name for f in kept].index("n_chars") if "n_chars" in docs.columns and out != "n_chars" else None

    def run(batches):
        features, model = worker_features(), sent.value
        for b in common.pieces(batches):
            texts = b.column(at).to_pylist()
            sizes = b.column(chars).cast(pa.int64(), safe=False).to_pylist() if chars is not None else [None] * len(texts)
            scores = [model.score(*features(t or "", n)) for t, n in zip(texts, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, out])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model does not reject, with docs' columns."""
    out = next(x for x in (f"score_{k}" for k in range(1000)) if x not in docs.columns)
    return with_score(docs, model, out, text_col=text_col).where(F.col(out) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    scored = with_score(docs.select(*_inputs(docs, "doc_id", "text")), model)
    return scored.select("doc_id", F.coalesce(common.bucket_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
