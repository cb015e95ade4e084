"""Toxicity by multiple-instance learning: document labels train a sentence score.

A document's probability is the noisy-or of its sentences' logistic scores,
1 - prod(1 - p(sentence)); only documents are labelled, and the gradient reaches each sentence
through the product. A sentence's score is a bias plus the weights of its words; a word weighs
what its own form and its prefixes of 4 to 7 letters weigh, so unseen endings of a known stem
count. Features that are not clearly more frequent in positive documents weigh nothing, and a
sentence without any weight has probability 0, so a text is not the more toxic for being long.

The fit takes a bounded sample (POSITIVES and NEGATIVES labelled documents, those with the least
hash of their id); scoring reads every document whole.

Defined results: null, empty and blank texts score 0; without positive labels every score is 0;
labels of one document that differ count as toxic; of several texts of one id the least trains; rows
with a null id are scored and never train. Repeated rows each get a row.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, rows_of, spare

POSITIVES, NEGATIVES, FEATURES, THRESHOLD = 2500, 5000, 20000, 0.3
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_EDGE = " \t.,;:!?\"'()[]{}<>*#&$%-_«»“”…¡¿\x0b\x0c\r"


def features_of(word: str) -> list[str]:
    """A lower-cased word's features: its form without outer punctuation, and its prefixes."""
    w = word.strip(_EDGE)
    return [w, *(w[:n] + "-" for n in range(4, 8) if len(w) >= n)] if w else []


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence that isn't blank."""
    return [m.span() for m in _SENTENCE.finditer(text) if not m.group().isspace()]


def fit(texts: list[str], labels: list[int], most: int = FEATURES, steps: int = 300) -> dict[str, float]:
    """Weights by feature; the bias under the empty string."""
    once = dict(zip(texts, labels, strict=True))  # copies would pass for evidence
    texts, labels = list(once), list(once.values())
    known: dict[str, list[str]] = {}
    y = np.array(labels, np.float64)
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos:
        return {"": -30.0}
    up: dict[str, int] = {}
    down: dict[str, int] = {}
    docs = []
    for text, label in zip(texts, labels, strict=True):
        low = (text or "").lower()
        seen: set[str] = set()
        for w in set(low.split()):
            if (f := known.get(w)) is None:
                f = known[w] = features_of(w)
            seen.update(f)
        docs.append(low)
        count = up if label else down
        for f in seen:
            count[f] = count.get(f, 0) + 1
    scored = []
    for f, a in up.items():
        b = down.get(f, 0)
        p, q = (a + 0.5) / (pos + 1), (b + 0.5) / (neg + 1)
        z = np.log(p / q) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if a >= 3 and p >= 4 * q and z >= 3.5:
            scored.append((-z, f, np.log(p / q)))
    chosen = sorted(scored)[:most]
    index = {f: i for i, (_, f, _) in enumerate(chosen)}
    cols: list[int] = []
    rows: list[int] = []
    owner: list[int] = []
    hits = {w: h for w, f in known.items() if (h := [index[x] for x in f if x in index])}
    for d, low in enumerate(docs):
        for a, b in sentences(low):
            found = [i for w in low[a:b].split() for i in hits.get(w, ())]
            if found:
                cols += found
                rows += [len(owner)] * len(found)
                owner.append(d)
    col, row, own = np.array(cols, np.int64), np.array(rows, np.int64), np.array(owner, np.int64)
    w = np.array([min(4.0, s) for *_, s in chosen])
    bias, m, v = -6.0, np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    weight = np.where(y > 0, neg / max(pos, 1), 1.0) / len(y)
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, w[col], len(own)) if len(own) else np.empty(0)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_none = np.bincount(own, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))
        none = np.minimum(np.exp(log_none), 1 - 1e-9)
        pull = np.where(y > 0, -none / (1 - none), 1.0) * weight
        gz = pull[own] * p
        grad = np.append(np.bincount(col, gz[row], len(w)) + 1e-4 * w, gz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = np.maximum(0.0, w - move[:-1]), bias - move[-1]
    return {f: float(x) for (_, f, _), x in zip(chosen, w, strict=True) if x > 0} | {"": float(bias)}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, negatives: int = NEGATIVES) -> dict[str, float]:
    """The model of a bounded sample of the labelled documents whose crc32(id) mod 4 is not 2; fitted in one task."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.max(label_col).alias("y")).filter(crc_mod(F.col("k"), 4) != 2)
    order = [F.xxhash64("k"), F.col("k")]
    ids = known.filter("y > 0").orderBy(*order).limit(positives).union(known.filter("y <= 0").orderBy(*order).limit(negatives))
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(ids), "k").groupBy("k").agg(F.max("y").alias("y"), F.min("t").alias("t"))

    def learn(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("k")
        model = fit(g["t"].fillna("").tolist(), [int(y > 0) for y in g["y"]])
        spare()
        return pd.DataFrame({"f": list(model), "w": list(model.values())})

    got = rows.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(learn, "f string, w double").collect()
    return {r["f"]: r["w"] for r in got} or {"": -30.0}


class Weights(dict):
    """word -> weight, remembered for a bounded number of words."""

    LIMIT = 1 << 17

    def __init__(self, model: dict[str, float]) -> None:
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        value = sum(self.model.get(f, 0.0) for f in features_of(word))
        if len(word) <= 64:
            self[word] = value
        return value


def score_text(text: str, weight: Weights, bias: float) -> tuple[float, list[tuple[int, int, float]]]:
    """The document's probability, and (start, end, probability) of the sentences with any weight."""
    low = text.lower()
    exact = len(low) == len(text)
    get = weight.__getitem__
    found = []
    for a, b in sentences(low):
        if s := sum(map(get, low[a:b].split())):
            found.append((a, b, float(1 / (1 + np.exp(-min(30.0, bias + s))))))
    logs = sum(np.log1p(-min(p, 1 - 1e-12)) for *_, p in found)
    return float(abs(np.expm1(logs))), found if exact else [(0, len(text), max((p for *_, p in found), default=0.0))] if found else []


def score(docs: DataFrame, model: dict[str, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted, offending) for every document; offending: spans of the sentences at or above the threshold.

    Offsets count characters; where lower-casing changes a text's length, the span is the text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches):
        weight, bias = Weights(sent.value), sent.value.get("", -30.0)
        for batch in batches:
            rows = []
            for key, held, text in rows_of([batch], "k", "held_out", "t"):
                p, found = score_text(text or "", weight, bias)
                rows.append((key, held, p, int(p >= threshold), [{"start": a, "end": b, "p": q} for a, b, q in found if q >= threshold]))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (batch.schema.field("k").type, pa.bool_(), pa.float64(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[id_col, "held_out", "score", "predicted", "offending"])
        spare(weight)

    rows = docs.select(F.col(id_col).alias("k"), (crc_mod(F.col(id_col), 4) == 2).alias("held_out"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, offending array<struct<start:int,end:int,p:double>>")


def without_toxic(docs: DataFrame, model: dict[str, float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at or above the threshold; one pass, no join."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weight, bias = Weights(sent.value), sent.value.get("", -30.0)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([score_text(t or "", weight, bias)[0] < threshold for t in texts], pa.bool_()))
        spare(weight)

    return docs.mapInArrow(run, docs.schema)
