"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (elastic net), then calibrated by
one temperature.  Document frequencies are counted over all training
documents; only the regression is fitted on a bounded sample of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

UNKNOWN = "und"
MAX_LANGUAGES = 300
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots (sorted) and counts of the 1-, 2- and 3-grams of the lower-cased whole text, a space at either end."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.zeros(1 << bits, np.int64)
    shift, step = np.uint64(64 - bits), 1 << 18
    for i in range(0, len(points), step):  # blocks share two points so that no n-gram is lost
        c = points[i : i + step + 2]
        one = c * _A
        grams = [one[:step], (one[:-1] * _B + c[1:] * _C)[:step]]
        if len(c) > 2:
            grams.append((((one[:-2] + c[1:-1] * _B) * _C + c[2:]) * _B)[:step])
        for g in grams:
            counts += np.bincount(((g ^ (g >> np.uint64(29))) * _A >> shift).astype(np.int64), minlength=1 << bits)
    slots = np.flatnonzero(counts)
    return slots.astype(np.int32), counts[slots]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int

    def vector(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[slots]
        return x / max(1e-12, float(np.sqrt(x @ x)))

    def logits(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(slots, counts) @ self.weights[slots] + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        z = self.logits(*features(text, self.bits)) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _document_counts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros((1 << bits) + 1, np.int64), 0
        for batch in small_batches(batches):
            for text in batch.column(0).to_pylist():
                df[features(text, bits)[0]] += 1
                n += 1
        df[-1] = n
        there = np.flatnonzero(df)
        yield pa.record_batch([pa.array(there), pa.array(df[there])], ["slot", "n"])

    return run


def _featurize(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = [features(t.as_py(), bits) for t in batch.column(2).slice(i, 64)]
                yield pa.record_batch(
                    [batch.column(0).slice(i, 64), batch.column(1).slice(i, 64), pa.array([s.tobytes() for s, _ in some], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in some], pa.binary())],
                    ["rank", "lang", "slots", "counts"],
                )

    return run


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, dims: int, alpha: float = 0.8, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights [dims, classes] and biases by FTRL-proximal steps over (slots, values, class), in the order given."""
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))

    def solved(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= l1, 0.0, (np.sign(zz) * l1 - zz) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for slots, values, y in rows:
            at, x = np.append(slots, dims), np.append(values, 1.0)
            zz, nn = z[at], n[at]
            w = solved(zz, nn)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            after = nn + g * g
            z[at] = zz + g - (np.sqrt(after) - np.sqrt(nn)) / alpha * w
            n[at] = after
    w = solved(z, n)
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature in [0.05, 20] with the least mean negative log-likelihood, by golden section on its logarithm."""
    def loss(t: float) -> float:
        z = logits / math.exp(t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

    low, high, g = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def train(labelled: DataFrame, id_col: str = "id", text_col: str = "text", lang_col: str = "lang", bits: int = 15, sample_rows: int = 2000) -> Model | None:
    """Fit on ``labelled`` (null texts or languages are left out); None without rows.

    Document frequencies cover every row.  The regression sees at most
    ``sample_rows`` documents, equally many of each language as far as there
    are any, chosen by a hash of the id; a fifth of them only calibrate.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return None
    each = max(1, sample_rows // len(sizes))
    counted = rows.select("text").mapInArrow(_document_counts(bits), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros((1 << bits) + 1)
    df[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    rank = F.crc32(F.concat_ws("/", F.lit("sample"), F.col("id").cast("string")).cast("binary"))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(float(2**32) * min(1.0, 1.2 * each / n + 20 / n)))])
    chosen = rows.select(rank.alias("rank"), "lang", "text").where(F.col("rank") < share[F.col("lang")])
    chosen = chosen.mapInArrow(_featurize(bits), "rank long, lang string, slots binary, counts binary")
    found = chosen.toArrow().to_pylist()
    found.sort(key=lambda r: (r["rank"], r["lang"], r["slots"], r["counts"]))
    languages, taken, sample = sorted(sizes), dict.fromkeys(sizes, 0), []
    for r in found:
        if taken[r["lang"]] < each:
            taken[r["lang"]] += 1
            sample.append((np.frombuffer(r["slots"], np.int32), np.frombuffer(r["counts"], np.int32), languages.index(r["lang"])))
    model = Model(languages, idf.astype(np.float32), np.zeros((1 << bits, len(languages)), np.float32), np.zeros(len(languages), np.float32), 1.0, bits)
    ready = [(s, model.vector(s, c), y) for s, c, y in sample]
    fitted, held = [r for i, r in enumerate(ready) if i % 5], ready[::5]
    weights, bias = ftrl(fitted or ready, len(languages), 1 << bits)
    model.weights, model.bias = weights.astype(np.float32), bias.astype(np.float32)
    if held and len(languages) > 1:
        model.temperature = fit_temperature(np.array([x @ weights[s] + bias for s, x, _ in held]), np.array([y for *_, y in held]))
    return model


def _predicting(shared, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small_batches(batches):
            lang, score = [], []
            for text, letters in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                best = model.predict(text) if letters else (UNKNOWN, 0.0)
                lang.append(best[0])
                score.append(best[1])
            out = [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.record_batch(out + [batch.column(1)] * keep_text, ["row", "lang_pred", "score"] + ["text"] * keep_text)

    return run


def identify(docs: DataFrame, model: Model | None, carry: list[str], text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``carry`` columns (as one struct ``row``), ``lang_pred`` and ``score`` (calibrated probability) for each row; also ``text`` if wanted.

    Texts that are null or hold no letter are ``und`` with score 0, and all are
    where there was nothing to learn from.  Only the text is looked at; texts
    of any length are taken whole, in blocks.
    """
    text = F.col(text_col).cast("string")
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.struct(*[docs[c] for c in carry]).alias("row"), text.alias("text"), letters.alias("letters"))
    if model is None:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), *["text"] * keep_text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predicting(shared, keep_text), f"row {dict(rows.dtypes)['row']}, lang_pred string, score double" + ", text string" * keep_text)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: CRC-32 of its id as text divisible by 5 (null ids: the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def accepted(docs: DataFrame, least_score: float = 0.4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Rows of ``docs``, all columns, whose language is known with at least ``least_score``; the model is trained on their own labels."""
    model = train(docs.where(~held_out(id_col)), id_col, text_col, lang_col, **options)
    others = [c for c in docs.columns if c != text_col]
    found = identify(docs, model, others, text_col, keep_text=True).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score))
    return found.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
