"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Grams of 1 to 4 characters are taken inside words (letters only, lower case, with a mark at both ends), hashed,
counted over the whole text, weighted by inverse document frequency and scaled to length 1. Weights are
trained by follow-the-regularised-leader with L1 and L2 penalties, which leaves most of them 0. A temperature,
fitted on rows kept apart from training, calibrates the probabilities.

Document frequencies and counts of labels cover all rows that may be learnt from. The fit uses a sample of them: in
expectation ``per_lang`` rows a label, or ``max_train`` divided by the number of labels if that is less; drawn by a hash
of the id. No label is left out; more than ``max_train`` labels are refused. Scoring is one narrow pass over whole texts.

Text that is null, empty or without a letter (Unicode's category L): language ``und``, score 0. A null id is never held
out and never learnt from; null labels are not learnt. Without labels at all every text is ``und``. Of languages that are
equally likely the first in the order of their names is given. Repeated rows count and are judged each by itself. Texts of
any length are read whole, in parts of PART characters. Only the three columns named are read, whatever else the table holds.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

GRAM_BITS = 16
GRAMS = 1 << GRAM_BITS
LONGEST = 4
PER_LANG, MAX_TRAIN = 800, 20_000
#: Characters that are hashed at once.
PART = 1 << 16
UNKNOWN = "und"
_MIX = np.uint32(0x9E3779B1)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Is a code point a letter?"""
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in regex.findall(r"\p{L}", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))]] = True
    return table


def gram_numbers(text: str) -> np.ndarray:
    """Numbers of all grams that start in the text's first PART characters, given LONGEST - 1 characters more.

    Words are runs of letters; all else is a mark (0). A gram may have a mark at either end; a mark alone is none.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[codes]
    c, out = np.where(letter, codes, 0), [np.empty(0, np.uint32)]
    h, inner = c * _MIX, letter
    for n in range(1, LONGEST + 1):
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(13))) * np.uint32(0x85EBCA6B) + c[n - 1 :] * _MIX
            # all between the ends are letters; with nothing between them, one of them is
            inner = letter[:-1] | letter[1:] if n == 2 else letter[1:-1] if n == 3 else inner[:-1] & letter[n - 2 : -1]
        x = h[:PART][inner[:PART]] + np.uint32(n)
        out.append((x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35))
    return np.concatenate(out) >> np.uint32(32 - GRAM_BITS)


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(gram numbers, counts), or None without a letter."""
    text, counts = f"\0{text.lower()}\0", np.zeros(GRAMS, np.int64)
    for k in range(0, len(text), PART):
        counts += np.bincount(gram_numbers(text[k : k + PART + LONGEST - 1]), minlength=GRAMS)
    ids = np.flatnonzero(counts)
    return (ids.astype(np.int32), counts[ids].astype(np.float32)) if len(ids) else None


class LanguageModel:
    def __init__(self, langs: list[str]):
        self.langs = langs
        self.idf = np.ones(GRAMS, np.float32)
        self.weights = np.zeros((GRAMS, len(langs)), np.float32)
        self.bias = np.zeros(len(langs))
        self.temperature = 1.0

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = counts * self.idf[ids]
        return x / np.sqrt(x @ x)

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.bias + self.vector(ids, counts) @ self.weights[ids]

    def predict(self, found: tuple[np.ndarray, np.ndarray] | None) -> tuple[str, float]:
        if found is None or not self.langs:
            return UNKNOWN, 0.0
        z = self.logits(*found) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k])

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], frequencies: np.ndarray | None = None, documents: int = 0, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> LanguageModel:
        """frequencies: in how many of so many documents each gram stands; without, those of rows."""
        n, c = len(rows), len(self.langs)
        if not n:
            return self
        apart = np.arange(n) % 5 == 4 if n >= 50 else np.zeros(n, bool)
        if frequencies is None:
            frequencies, documents = np.bincount(np.concatenate([r[0] for r in rows]), minlength=GRAMS), n
        self.idf = (np.log((1 + documents) / (1 + frequencies)) + 1).astype(np.float32)
        z, g2 = np.zeros((GRAMS + 1, c)), np.zeros((GRAMS + 1, c))
        rng, learn = np.random.default_rng(3), np.flatnonzero(~apart)

        def leader(at: np.ndarray) -> np.ndarray:
            """Closed-form weights of the regularised leader; exactly 0 where |z| <= l1. The bias, last, has no L1."""
            small = np.where((at < GRAMS)[:, None], l1, 0.0)
            zz = z[at]
            return np.where(np.abs(zz) <= small, 0.0, -(zz - np.sign(zz) * small) / ((beta + np.sqrt(g2[at])) / alpha + l2))

        for _ in range(epochs):
            for k in rng.permutation(learn):
                ids, counts = rows[k]
                at, x = np.append(ids, GRAMS), np.append(self.vector(ids, counts), 1.0)
                w = leader(at)
                y = x @ w
                p = np.exp(y - y.max())
                p /= p.sum()
                p[labels[k]] -= 1
                g = x[:, None] * p
                sigma = (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / alpha
                z[at] += g - sigma * w
                g2[at] += g * g
        w = leader(np.arange(GRAMS + 1))
        self.weights, self.bias = w[:GRAMS].astype(np.float32), w[GRAMS]
        if apart.any():
            held = np.stack([self.logits(*rows[k]) for k in np.flatnonzero(apart)])
            truth = np.array(labels)[apart]

            def loss(t: float) -> float:
                y = held / t
                top = y.max(axis=1)
                return float((top + np.log(np.exp(y - top[:, None]).sum(axis=1)) - y[np.arange(len(truth)), truth]).mean())

            self.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
        return self


def train(docs: DataFrame, per_lang: int = PER_LANG, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (common.bucket_of("doc_id", 3) != 1))
    counts = rows.groupBy("lang").count().limit(max_train + 1).collect()
    spark, langs = docs.sparkSession, sorted(r["lang"] for r in counts)
    if not langs:
        return LanguageModel([])
    if len(langs) > max_train:
        raise ValueError(f"more than max_train = {max_train} labels")
    each_lang, number = min(per_lang, max_train / len(langs)), {x: k for k, x in enumerate(langs)}
    most = spark.createDataFrame([(r["lang"], int(min(1.0, each_lang / r["count"]) * (1 << 30)), number[r["lang"]]) for r in counts], "lang string, most long, label int")
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("most")
    rows = rows.join(F.broadcast(most), "lang").select(F.col("doc_id").cast("long"), "label", chosen.alias("chosen"), "text")

    def count(batches):
        """Grams of chosen rows, and at the end how many texts of the task hold each gram."""
        held, n = np.zeros(GRAMS, np.int64), 0
        names = ["doc_id", "label", "ids", "counts", "texts", "frequencies"]
        for batch in common.pieces(batches):
            got = [count_grams(t) for t in batch.column(3).to_pylist()]
            for g in got:
                if g:
                    held[g[0]] += 1
            n += len(got)
            keep = [k for k, c in enumerate(batch.column(2).to_pylist()) if c and got[k]]
            own = batch.take(pa.array(keep, pa.int64()))
            none = [None] * len(keep)
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([got[k][0].tobytes() for k in keep], pa.binary()), pa.array([got[k][1].tobytes() for k in keep], pa.binary()), pa.array(none, pa.int64()), pa.array(none, pa.binary())], names=names)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([None], t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.binary())] + [pa.array([n], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=names)

    told = common.materialize(rows.mapInArrow(count, "doc_id long, label int, ids binary, counts binary, texts long, frequencies binary"), "grams")
    # A task's vector is half a megabyte; they are added up as they are, in levels.
    frequencies = common.packed_sum(told.where("texts is not null").select(F.col("frequencies").alias("v")), GRAMS)
    documents = told.agg(F.sum("texts")).first()[0] or 0
    # A text for each id; shares of hashes give about max_train of them, and never more than twice that, those with the smallest hashes.
    one = told.where("ids is not null").groupBy("doc_id").agg(F.min(F.struct("label", "ids", "counts")).alias("x"))
    got = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * max_train).select("doc_id", "x.*").collect()
    got.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["ids"]))
    return LanguageModel(langs).fit([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in got], [r["label"] for r in got], frequencies, documents)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value

        def each(b):
            got = [model.predict(count_grams(t) if t else None) for t in b.column(1).to_pylist()]
            return {"doc_id": b.column(0), "lang_pred": [x for x, _ in got], "score": [x for _, x in got]}

        return each

    df = common.id_text(docs, id_col, text_col)
    return common.arrow_map(df, make, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", F.coalesce(common.bucket_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
