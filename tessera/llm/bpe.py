"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Leaf i holds rank * n + i of the pair that starts at symbol i, or a value above all ranks where
no merge applies, and an inner node holds the least of its children. So the root yields the
leftmost pair of the lowest rank; a merge changes three leaves, each in logarithmic time; a word
of n symbols takes O(n log n), however long it is.

Words between ASCII blanks are independent of each other under this vocabulary (its normaliser
and its pattern never join across a blank), so each is encoded once and remembered, for a
bounded number of words a worker.

Defined results: a null text counts as empty; an empty or blank text gives no ids, and its
decoded text is empty. Repeated rows each get a row. Further input columns are dropped.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, words

ABOVE = 1 << 62
#: Children of an inner node: a node's least value is then one call, and most words need no inner node but the root.
FAN = 16


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself if it prints, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def merged(ids: list[int], ranks: dict[int, tuple[int, int]]) -> list[int]:
    """ids after all merges, lowest rank first and leftmost among equals.

    ranks: (left << 32 | right) to (rank, id of the merged pair).
    """
    n = len(ids)
    if n < 2:
        return ids
    get = ranks.get
    leaves = [hit[0] * n + i if (hit := get(ids[i] << 32 | ids[i + 1])) else ABOVE for i in range(n - 1)]
    tree = [leaves]
    while len(tree[-1]) > FAN:
        under = tree[-1]
        tree.append([min(under[i : i + FAN]) for i in range(0, len(under), FAN)])
    top, upper = tree[-1], tree[1:]
    if (low := min(top)) == ABOVE:
        return ids
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ids = list(ids)
    while low < ABOVE:
        i = low % n
        j = after[i]
        ids[i] = here = get(ids[i] << 32 | ids[j])[1]
        ids[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            leaves[j] = ABOVE
            leaves[i] = hit[0] * n + i if (hit := get(here << 32 | ids[k])) else ABOVE
        else:
            leaves[i] = ABOVE
            if j < n - 1:
                leaves[j] = ABOVE
        if (h := before[i]) >= 0:
            leaves[h] = hit[0] * n + h if (hit := get(ids[h] << 32 | here)) else ABOVE
        if upper:
            for at in (j, i, h):
                under = leaves
                for level in upper if 0 <= at < n - 1 else ():
                    at //= FAN
                    value = min(under[at * FAN : at * FAN + FAN])
                    if level[at] == value:
                        break
                    level[at] = value
                    under = level
        low = min(top)
    return [x for x in ids if x >= 0]


class WordBpe(dict):
    """word -> (decimal ids joined by a blank, tokens joined by a blank)."""

    LIMIT = 1 << 18

    def __init__(self, path: str) -> None:
        import regex

        self.known: dict[str, list[int]] = {}
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {vocab[a] << 32 | vocab[b]: (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        chars = byte_chars()
        self.inner = [vocab[c] for c in chars]
        self.last = [vocab[c + self.end] for c in chars]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split).findall
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")")

    def word_ids(self, word: str) -> list[int]:
        out: list[int] = []
        if word.isascii() and word.isalpha():
            return self.piece_ids(word.lower())
        for part in self.specials.split(word) if "<|" in word else (word,):
            if part in self.special:
                out.append(self.special[part])
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # no final form, unlike str.lower()
            for piece in self.pieces(part.lower()):
                out += self.piece_ids(piece)
        return out

    def piece_ids(self, piece: str) -> list[int]:
        if (ids := self.known.get(piece)) is None:
            b = piece.encode()
            ids = [self.inner[x] for x in b]
            ids[-1] = self.last[b[-1]]
            ids = merged(ids, self.ranks)
            if len(piece) <= 64:
                if len(self.known) >= self.LIMIT:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def __missing__(self, word: str) -> tuple[str, str]:
        ids = self.word_ids(word)
        made = " ".join(map(str, ids)), " ".join([self.names[i] for i in ids])
        if len(word) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = made
        return made

    def encode(self, text: str | None) -> tuple[str, str]:
        """A text's ids in decimal and its decoded text."""
        got = list(map(self.__getitem__, words(text)))
        return " ".join([x for x, _ in got if x]), " ".join([x for _, x in got if x])

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the vocabulary file, tokens are joined by a blank."""
        return " ".join([self.names[i] for i in ids if i in self.names])


@lru_cache(2)
def coder(path: str) -> WordBpe:
    """One coder a worker and vocabulary."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per document: its number of tokens and digests of its ids and decoded text; keep_ids adds the ids."""

    def run(batches):
        bpe = coder(vocab)
        for batch in batches:
            rows = []
            for key, text in rows_of([batch], "k", "t"):
                ids, plain = bpe.encode(text)
                rows.append((key, ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest(), [int(x) for x in ids.split()] if keep_ids else None))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (batch.schema.field("k").type, pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[: 5 if keep_ids else 4], kinds, strict=False)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 5 if keep_ids else 4])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def decode_ids(df: DataFrame, vocab: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the decoded text of a column of id arrays; null ids give null, unknown ids are left out."""
    schema = df.withColumn(out_col, F.lit("")).schema

    def run(batches):
        bpe = coder(vocab)
        for b in batches:
            made = [None if x is None else bpe.decode(x) for x in b.column(b.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, out_col])

    return df.mapInArrow(run, schema)
