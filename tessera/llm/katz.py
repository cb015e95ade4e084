"""Language-model scoring: Katz backoff with Good-Turing discounts over words, of order two.

P(w | h) is d(r) r / c(h) for a pair seen r times in training, else alpha(h) P(w); P(w) is
d(r) r / N, and what the discounts leave over is the probability of the one unknown word. alpha(h)
is the mass left over at h divided by one minus the P(w) of all words seen after h, so every
distribution sums to one exactly, whatever the discounts. Counts above LARGE are not discounted;
a history whose counts are all large would leave nothing over and is counted once more. Discounts
that the counts of counts leave undefined or outside (0, 1) are (r - 1/2) / r.

Documents are read once, in blocks of bounded size that keep word numbers. Counts of words and of pairs
are exchanged as packed, sorted 64-bit hashes: a block sends each distinct n-gram once to the part
that owns its range of hashes, and gets its total back. So a frequent word or pair is one entry a
block, the tables are partitioned by hash, and neither the driver nor a task holds a whole one.
Pairs and sums of histories work alike; only counts of counts come to the driver.

Defined results: a null or empty text is one end token. Without training documents N and V are 0,
and both scores of a text are 0. Rows with a null id are scored and never train. Repeated rows
each get a row and train each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, crc_mod, lower_words, mix, pack, pack_sorted, parts_for, released, settled, slices, spare, text_blocks, unpack, unpack_sorted

BLOCK_CHARS, LARGE = 16 << 20, 5
START, END = np.uint64(0), np.uint64(1)
_BLOCK = "block long, ids array<long>, held array<boolean>, lens binary, tokens binary, vocab binary"


def blocks(docs: DataFrame, id_col: str, text_col: str, chars: int = BLOCK_CHARS) -> DataFrame:
    """One row a block: ids and held-out marks by document, tokens as places in the block's sorted hashes of words."""

    def run(batches):
        hashes, part, n = WordHash(), TaskContext.get().partitionId(), 0
        for rows in text_blocks(batches, chars):
            found = []
            for *_, text in rows:
                found += [hashes.of(lower_words(text)), np.array([END])]
            lens = np.array([len(h) + 1 for h in found[::2]], np.int64)
            vocab, tokens = np.unique(np.concatenate([np.array([START, END]), *found]), return_inverse=True)
            tokens = tokens[2:].astype(np.uint32)
            row = ([part << 24 | n], [[r[0] for r in rows]], [[r[1] for r in rows]], [pack(lens)], [pack(tokens)], [pack_sorted(vocab)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "ids", "held", "lens", "tokens", "vocab"])
            n += 1
        spare(hashes)

    held = F.coalesce(crc_mod(F.col(id_col), 7) == 2, F.lit(None))
    return docs.select(F.col(id_col).cast("long").alias("k"), held.alias("h"), F.col(text_col).alias("t")).mapInArrow(run, _BLOCK)


class Block:
    """A block's tokens, histories and distinct pairs, as places in vocab."""

    def __init__(self, row) -> None:
        self.ids, self.held = row["ids"], row["held"]
        self.lens = unpack(row["lens"])
        self.tokens = unpack(row["tokens"]).astype(np.int64)
        self.vocab = unpack_sorted(row["vocab"])
        train = np.array([h is not None and not h for h in self.held], bool)
        self.trains = np.repeat(train, self.lens)
        self.first = np.cumsum(self.lens) - self.lens

    def pairs(self) -> None:
        """Sorts the distinct (history, word) pairs by hash: keys, their places (hist, word), and each token's place among them."""
        n = len(self.vocab)
        hist = np.empty_like(self.tokens)
        hist[1:] = self.tokens[:-1]
        hist[self.first] = 0
        both, inverse = np.unique(hist * n + self.tokens, return_inverse=True)
        keys = mix(self.vocab[both // n] * np.uint64(0x9E3779B97F4A7C15) ^ mix(self.vocab[both % n] + np.uint64(3)))
        order = np.argsort(keys, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        self.keys, self.hist, self.word, self.at = keys[order], both[order] // n, both[order] % n, back[inverse]


def ask(stored: DataFrame, kind: str, parts: int) -> DataFrame:
    """(part, block, keys, counts): training counts of each block's words or pairs, by range of hashes."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                if kind == "word":
                    keys, count = b.vocab, np.bincount(b.tokens, b.trains, len(b.vocab))
                else:
                    b.pairs()
                    keys, count = b.keys, np.bincount(b.at, b.trains, len(b.keys))
                count = count.astype(np.uint32)
                for p, i, j in slices(keys, parts):
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([pack_sorted(keys[i:j])], pa.binary()), pa.array([pack(count[i:j])], pa.binary())], names=["part", "block", "keys", "counts"])

    return stored.mapInArrow(run, "part int, block long, keys binary, counts binary")


def answer(asked: DataFrame, kind: str) -> DataFrame:
    """(block, kind, part, data, stats): totals in the order of each block's keys; stats: N, V and counts of counts of the part, once.

    For pairs a total is doubled, plus 1 in the block that stands for the pair.
    """

    def total(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        keys = [unpack_sorted(k) for k in g["keys"]]
        counts = [unpack(c) for c in g["counts"]]
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(inverse, np.concatenate(counts), len(every)).astype(np.int64)
        seen = np.bincount(np.minimum(sums, LARGE + 2), minlength=LARGE + 3)
        stats = [int(sums.sum()), int((sums > 0).sum()), *map(int, seen[1 : LARGE + 2])]
        value = sums[inverse]
        if kind == "pair":
            own = np.zeros(len(inverse), np.int64)
            has = np.flatnonzero(np.concatenate(counts) > 0)
            _, first = np.unique(inverse[has], return_index=True)
            own[has[first]] = 1
            value = value * 2 + own
        cut = np.cumsum([len(k) for k in keys])[:-1]
        data = [pack(v.astype(np.uint32 if v.max(initial=0) < 1 << 32 else np.int64)) for v in np.split(value, cut)]
        return pd.DataFrame({"block": g["block"].to_numpy(), "kind": kind, "part": g["part"].to_numpy(), "data": data, "stats": [stats] + [None] * (len(g) - 1)})

    return asked.groupBy("part").applyInPandas(total, "block long, kind string, part int, data binary, stats array<long>")


def discounts(count_of_counts: list[int]) -> np.ndarray:
    """d(0) to d(LARGE + 1), the last for all larger counts: Katz's Good-Turing discounts."""
    n = [0, *count_of_counts]
    d = np.ones(LARGE + 2)
    d[0] = 0.0
    big = (LARGE + 1) * n[LARGE + 1] / n[1] if n[1] else 1.0
    for r in range(1, LARGE + 1):
        value = ((r + 1) * n[r + 1] / (r * n[r]) - big) / (1 - big) if n[r] and big != 1.0 else 0.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


def word_probs(count: np.ndarray, total: int, distinct: int, d: np.ndarray, mass: float) -> np.ndarray:
    """P(w) by count; 0 counts get the unknown word's probability. mass: sum of d(r) r over the vocabulary."""
    if not distinct:
        return np.ones(len(count))
    below = total if mass < total * (1 - 1e-12) else total + 1
    p = d[np.minimum(count, LARGE + 1)] * count / below
    return np.where(count > 0, p, (below - mass) / below)


def answers(group: pd.DataFrame, kind: str) -> np.ndarray:
    g = group[group["kind"] == kind].sort_values("part")
    return np.concatenate([unpack(x) for x in g["data"]])


def history_sums(stored: DataFrame, got: DataFrame, stats: dict, parts: int) -> DataFrame:
    """(part, block, keys, counts, mass, lower): by history, sums over the pairs that a block stands for."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in left.iterrows():
            b = Block(row)
            b.pairs()
            value = answers(right, "pair").astype(np.int64)
            r, own = value >> 1, (value & 1) > 0
            p = word_probs(answers(right, "word").astype(np.int64), *stats["word"])
            n = len(b.vocab)
            h, w, r = b.hist[own], b.word[own], r[own]
            counts = np.bincount(h, r, n)
            mass = np.bincount(h, stats["pair"][2][np.minimum(r, LARGE + 1)] * r, n)
            lower = np.bincount(h, p[w], n)
            out += [(q, row["block"], pack_sorted(b.vocab[i:j]), pack(counts[i:j].astype(np.int64)), pack(mass[i:j]), pack(lower[i:j])) for q, i, j in slices(b.vocab, parts)]
        return pd.DataFrame(out, columns=["part", "block", "keys", "counts", "mass", "lower"])

    return stored.groupBy("block").cogroup(got.groupBy("block")).applyInPandas(run, "part int, block long, keys binary, counts binary, mass binary, lower binary")


def history_totals(asked: DataFrame) -> DataFrame:
    """(block, kind, part, data): log10 of the backoff weight and the count of each history, in the order of a block's keys; a count of 0 where it never trained."""

    def total(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        keys = [unpack_sorted(k) for k in g["keys"]]
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(inverse, np.concatenate([unpack(x) for x in g[c]]))[inverse] for c in ("counts", "mass", "lower")]
        count, mass, lower = sums
        below = np.where(mass < count * (1 - 1e-12), count, count + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = np.where(count > 0, np.log10((below - mass) / below) - np.log10(1 - lower), 0.0)
        below = np.where(count > 0, below, 0)
        cut = np.cumsum([len(k) for k in keys])[:-1]
        rows = [(b, k, p, pack(x)) for k, v in (("below", below.astype(np.uint32 if below.max(initial=0) < 1 << 32 else np.int64)), ("alpha", alpha)) for b, p, x in zip(g["block"], g["part"], np.split(v, cut), strict=True)]
        return pd.DataFrame(rows, columns=["block", "kind", "part", "data"])

    return asked.groupBy("part").applyInPandas(total, "block long, kind string, part int, data binary")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document."""
    parts = parts_for(docs, text_col)
    stored = settled(blocks(docs, id_col, text_col, chars))
    words = settled(answer(ask(stored, "word", parts), "word"))
    pairs = settled(answer(ask(stored, "pair", parts), "pair"))
    stats: dict = {}
    for kind, df in (("word", words), ("pair", pairs)):
        sums = df.filter("stats is not null").select(F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        n = [0] * (LARGE + 3)
        for r in sums:
            n[r["i"]] = int(r["v"])
        d = discounts(n[2:])
        small = sum(r * c for r, c in enumerate(n[2 : 2 + LARGE], 1))
        stats[kind] = (n[0], n[1], d, float(n[0] - small + sum(d[r] * r * n[1 + r] for r in range(1, LARGE + 1))))
    got = words.union(pairs).select("block", "kind", "part", "data")
    backoff = settled(history_totals(history_sums(stored, got, stats, parts)))
    released(docs.sparkSession)  # the sums' shuffles, before blocks and answers meet once more

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        total, distinct = stats["word"][:2]
        for _, row in left.iterrows():
            b = Block(row)
            b.pairs()
            count = answers(right, "word").astype(np.int64)
            r = answers(right, "pair").astype(np.int64) >> 1
            below, alpha = answers(right, "below").astype(np.float64), answers(right, "alpha")
            p = np.log10(word_probs(count, *stats["word"]))
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = np.log10(stats["pair"][2][np.minimum(r, LARGE + 1)] * r) - np.log10(below[b.hist])
            value = np.where(r > 0, seen, alpha[b.hist] + p[b.word])[b.at]
            c = count[b.tokens]
            base = np.log10((c + 1) / (total + distinct + 1))
            add = lambda x: np.add.reduceat(x, b.first)
            out.append(pd.DataFrame({id_col: pd.array(list(b.ids), "Int64"), "held_out": pd.array(list(b.held), "boolean"), "n_tokens": b.lens, "n_known": add((c > 0).astype(np.int64)), "train_tokens": total, "base_score": add(base), "score": add(value)}))
        return pd.concat(out) if out else pd.DataFrame(columns=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return stored.groupBy("block").cogroup(got.union(backoff).groupBy("block")).applyInPandas(run, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
