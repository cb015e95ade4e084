import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.bpe import coder, decode_ids, encode_decode

PATH = public_tokenizers.path("word_bpe_49k.json")
rnd = random.Random(5)
TEXTS = [
    "", " \t\n", "Hello, WORLD! it's 42nd   street", "don't we'll I'd 'S THEY'VE", "naïve café Ångström é e ́", "ΑΣ ΣΑΣ ς İstanbul ẞß",
    "a\xa0b c\x1cd\x85e　f", "日本語 テキスト 한국어 안녕", "👍🏽 emoji 🇩🇪!!", "x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|>", "a" * 5000, "١٢٣ ½ Ⅷ ²", "\x00\x01 \x7f", "word​join à́b",
] + ["".join(rnd.choice("abcdeéß 'ſTHE1\n<|>.") for _ in range(rnd.randint(1, 300))) for _ in range(150)]


def reference():
    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    return t


def test_same_as_library():
    t, c = reference(), coder(PATH)
    for x in TEXTS:
        ids = t.encode(x, add_special_tokens=False).ids
        got, plain = c.encode(x)
        assert [int(i) for i in got.split()] == ids, x
        assert plain == t.decode(ids, skip_special_tokens=False)
        assert c.decode(ids) == plain


def test_rows(spark):
    rows = [(i, x, 1) for i, x in enumerate(TEXTS[:12])] + [(99, None, 2), (99, None, 2), (None, "a b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = encode_decode(df, PATH, keep_ids=True)
    back = decode_ids(got, PATH).collect()
    assert len(back) == len(rows)
    for r in back:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    empty = [r for r in back if r.doc_id == 99]
    assert [r.n_tokens for r in empty] == [0, 0] and empty[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert encode_decode(df.limit(0), PATH).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_leftmost_lowest(n):
    from tessera.llm.bpe import merged

    r = random.Random(n)
    ranks = {}
    for i in range(60):
        a, b = r.randrange(20), r.randrange(20)
        ranks.setdefault(a << 32 | b, (len(ranks), 5 + i % 15))
    ids = [r.randrange(6) for _ in range(n)]
    want = list(ids)
    while True:
        best = min(((ranks[want[i] << 32 | want[i + 1]][0], i) for i in range(len(want) - 1) if want[i] << 32 | want[i + 1] in ranks), default=None)
        if best is None:
            break
        i = best[1]
        want[i : i + 2] = [ranks[want[i] << 32 | want[i + 1]][1]]
    assert merged(ids, ranks) == want
