"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary; a word's likelihood is the sum
over all its segmentations into pieces, by the forward algorithm, so no single segmentation
is chosen. The pieces' probabilities come from expectation maximisation (forward-backward) on the
words of a bounded sample of SAMPLE training documents a language, those with the least hash of
their id, one task a language. Scoring runs the forward algorithm once for each new word of a
batch, for all words of one length and all languages together, and adds the words of a document.

Words are runs of letters of any length, lower-cased; sums are kept as logarithms, so that long ones do
not underflow. Characters that the vocabulary lacks are pieces of one small fixed probability in every language.

Defined results: null texts and texts without a letter are "und" with score 0, and so is every
text if there is no training document; rows with a null id are predicted and never train. score is the posterior under equal priors; ties go to the
first language in code-point order. Repeated rows each get a row.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, settled, spare

SAMPLE, ROUNDS = 300, 2
#: Sampled ids that a broadcast may hold; more of them (thousands of languages) meet their texts in a shuffle.
SENT_IDS = 1_000_000
UNKNOWN, FLOOR = 1e-7, 1e-9
_LETTERS = re.compile(r"[^\W\d_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(2)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of all pieces that spell text, their ids, and the longest one's length."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(sp.id_to_piece(i), i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    pieces = [(p, i) for p, i in pieces if p]
    longest = max(len(p) for p, _ in pieces)
    h = np.zeros(len(pieces), np.uint64)
    for n in range(1, longest + 1):
        at = [k for k, (p, _) in enumerate(pieces) if len(p) == n]
        if at:
            codes = np.array([pieces[k][0] for k in at], f"U{n}").view(np.uint32).reshape(-1, n)
            h[at] = _hash(codes)
    order = np.argsort(h, kind="stable")
    return h[order], np.array([i for _, i in pieces], np.int64)[order], longest


def _hash(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes), np.uint64)
    for c in codes.T:
        h = (h ^ c.astype(np.uint64)) * _STEP
        h ^= h >> np.uint64(32)
    return h


def pieces_of(codes: np.ndarray, start: int, end: int, hashes: np.ndarray, longest: int) -> np.ndarray:
    """Place in hashes of the piece of n + 1 characters that ends at each position from start to end, by (word, position, n); -1 where there is none."""
    out = np.full((len(codes), end - start, longest), -1, np.int32)
    low = max(0, start - longest + 1)
    seg = codes[:, low:end].astype(np.uint64)
    h = np.zeros(seg.shape, np.uint64)
    for n in range(min(longest, seg.shape[1])):
        h = (h[:, : seg.shape[1] - n] ^ seg[:, n:]) * _STEP
        h ^= h >> np.uint64(32)
        first = max(0, start - n - low)  # the piece that ends at start
        part = h[:, first:]
        at = np.minimum(np.searchsorted(hashes, part), len(hashes) - 1)
        ends = low + first + n - start
        out[:, ends : ends + part.shape[1], n] = np.where(hashes[at] == part, at, -1)
    return out


def by_length(words: list[str], cells: int = 1 << 15):
    """(which, codes): words of one length with the mark of a word's start, as character codes; a bounded number of characters at once, one word at least."""
    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths).tolist():
        every = np.flatnonzero(lengths == n)
        step = max(1, cells // (n + 1))
        for k in range(0, len(every), step):
            which = every[k : k + step]
            yield which, np.array(["▁" + words[i] for i in which], f"U{n + 1}").view(np.uint32).reshape(-1, n + 1)


def log_sum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exp over axis 1; at least one entry of each row is finite."""
    most = x.max(1)
    return most + np.log(np.exp(x - most[:, None]).sum(1))


def log_likelihoods(words: list[str], hashes: np.ndarray, table: np.ndarray, longest: int, cells: int = 1 << 15) -> np.ndarray:
    """log P(word) of every word and language, over all segmentations; table: probabilities by place in hashes and language."""
    out = np.empty((len(words), table.shape[1]))
    logs = np.vstack([np.log(table), np.full((1, table.shape[1]), -np.inf)])  # -1: no piece
    for which, codes in by_length(words, cells):
        n = codes.shape[1]
        # the last positions' sums, the nearest first
        back = np.full((len(which), longest, table.shape[1]), -np.inf)
        back[:, 0] = 0.0
        step = max(1, cells // len(which))
        for start in range(0, n, step):
            place = pieces_of(codes, start, min(n, start + step), hashes, longest)
            arcs = logs[place]
            arcs[:, :, 0][place[:, :, 0] < 0] = np.log(UNKNOWN)
            for j in range(place.shape[1]):
                here = log_sum(back + arcs[:, j])
                back[:, 1:] = back[:, :-1].copy()
                back[:, 0] = here
        out[which] = back[:, 0]
    return out


def split_words(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return _LETTERS.findall(text.lower())


def fit(counts: dict[str, int], hashes: np.ndarray, longest: int, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities, by place in hashes, after rounds of expectation maximisation over all segmentations."""
    words = sorted(counts)
    weight = np.array([counts[w] for w in words], np.float64)
    prob = np.full(len(hashes), 1 / len(hashes))
    groups = [(which, pieces_of(codes, 0, codes.shape[1], hashes, longest)) for which, codes in by_length(words)]
    for _ in range(rounds):
        expected = np.zeros(len(hashes))
        with np.errstate(divide="ignore"):
            logs = np.append(np.log(prob), -np.inf)
        for which, place in groups:
            rows, n, _ = place.shape
            arcs = logs[place]
            arcs[:, :, 0][place[:, :, 0] < 0] = np.log(UNKNOWN)
            # ahead[j + longest - 1]: all ways to position j; behind[j]: all ways from there to the end
            ahead, behind = np.full((rows, n + longest), -np.inf), np.full((rows, n + longest), -np.inf)
            ahead[:, longest - 1] = behind[:, n] = 0.0
            for j in range(n):
                ahead[:, j + longest] = log_sum(ahead[:, j : j + longest][:, ::-1] + arcs[:, j])
            for j in range(n - 1, -1, -1):
                far = np.minimum(j + np.arange(longest), n - 1)
                onward = np.where(j + np.arange(longest) < n, arcs[:, far, np.arange(longest)], -np.inf)
                behind[:, j] = log_sum(onward + behind[:, j + 1 : j + 1 + longest])
            total = ahead[:, n + longest - 1]
            for k in range(min(longest, n)):  # arcs of k + 1 characters that end at k + 1, k + 2, ...
                part = np.exp(ahead[:, longest - 1 : longest - 1 + n - k] + arcs[:, k:, k] + behind[:, k + 1 : n + 1] - total[:, None]) * weight[which][:, None]
                at = place[:, k:, k]
                expected += np.bincount(at[at >= 0], part[at >= 0], len(hashes))
        prob = expected / max(expected.sum(), 1e-300)
    return np.maximum(prob, FLOOR)


def train(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and their table; what comes to the driver is at most the vocabulary times the languages."""
    known = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).alias("y")).filter("y is not null and t is not null").filter(crc_mod(F.col("k"), 5) != 0)
    ids = known.select("k", "y").withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("k"), "k"))).filter(F.col("r") <= sample).select(F.col("k").alias("k2"), F.col("y").alias("y2")).distinct()
    ids = settled(ids)
    if ids.count() <= SENT_IDS:  # only texts that are asked for are exchanged
        ids = F.broadcast(ids)
    picked = known.join(ids, F.expr("k = k2 and y = y2")).select("k", "y", "t")

    def learn(g: pd.DataFrame) -> pd.DataFrame:
        hashes, _, longest = vocabulary(vocab)
        counts: dict[str, int] = {}
        for t in g["t"]:
            for w in split_words(t):
                counts[w] = counts.get(w, 0) + 1
        prob = fit(counts, hashes, longest)
        at = np.flatnonzero(prob > FLOOR)
        return pd.DataFrame({"y": g["y"].iloc[0], "at": [at.astype("<i4").tobytes()], "p": [prob[at].tobytes()]})

    got = picked.groupBy("y").applyInPandas(learn, "y string, at binary, p binary").collect()
    got.sort(key=lambda r: r["y"])
    table = np.full((len(vocabulary(vocab)[0]), len(got)), FLOOR)
    for k, r in enumerate(got):
        table[np.frombuffer(r["at"], "<i4"), k] = np.frombuffer(r["p"])
    return [r["y"] for r in got], table


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for every document."""
    langs, table = model
    sent = docs.sparkSession.sparkContext.broadcast(table.astype(np.float32))
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    limit, slice_chars = 1 << 18, 1 << 20

    def run(batches):
        hashes, _, longest = vocabulary(vocab)
        table = sent.value.astype(np.float64)
        place: dict[str, int] = {}
        logs = np.empty((0, table.shape[1]))

        def judged(texts: list[str]) -> list[tuple[str, float]]:
            nonlocal logs
            split = [split_words(t) for t in texts]
            if len(place) > limit:
                place.clear()
                logs = np.empty((0, table.shape[1]))
            new = list({w for ws in split for w in ws if w not in place})
            if new:
                place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
                made = [log_likelihoods(new[i : i + 4096], hashes, table, longest) for i in range(0, len(new), 4096)]
                logs = np.concatenate([logs, *made])
            out = []
            for ws in split:
                if not ws or not langs:
                    out.append(("und", 0.0))
                    continue
                s = logs[np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))].sum(0)
                best = int(np.argmax(s))
                out.append((langs[best], float(1 / np.exp(s - s[best]).sum())))
            return out

        for batch in batches:
            keys, held, texts = (batch.column(i).to_pylist() for i in range(3))
            got, start, n = [], 0, 0
            for k, t in enumerate(texts):
                n += len(t or "")
                if n >= slice_chars or k == len(texts) - 1:
                    got += judged([t or "" for t in texts[start : k + 1]])
                    start, n = k + 1, 0
            names, scores = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(held, pa.bool_()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])
        place.clear()
        spare()

    rows = docs.select(F.col(id_col).alias("k"), (crc_mod(F.col(id_col), 5) == 0).alias("held_out"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
