import math
import zlib
from collections import Counter

import pytest

from tessera.llm import katz
from tessera.llm.common import lower_words

TEXTS = ["a b a c", "the cat sat on the mat", "The CAT ran", "", None, "a a a a a a a b", "x\xa0y z", "the mat sat", "b b c", "cat", "on the the the mat", "É é E", "  ", "new words here"] * 3


def brute(rows):
    """P(w | h) spelled out over dictionaries; also checks that every distribution sums to one."""
    train = [lower_words(t) + ["</s>"] for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    uni = Counter(w for t in train for w in t)
    bi = Counter((h, w) for t in train for h, w in zip(["<s>", *t[:-1]], t))
    total = sum(uni.values())
    cc = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.LARGE + 2)]
    du, db = katz.discounts(cc(uni)), katz.discounts(cc(bi))
    dis = lambda d, r: d[min(r, katz.LARGE + 1)] * r
    mass = sum(dis(du, r) for r in uni.values())
    below = total if mass < total * (1 - 1e-12) else total + 1
    p1 = lambda w: dis(du, uni[w]) / below if w in uni else (below - mass) / below
    after = {}
    for (h, w), r in bi.items():
        after.setdefault(h, {})[w] = r

    def p2(h, w):
        if h not in after:
            return p1(w)
        seen = after[h]
        c, m = sum(seen.values()), sum(dis(db, r) for r in seen.values())
        c = c if m < c * (1 - 1e-12) else c + 1
        if w in seen:
            return dis(db, seen[w]) / c
        return (c - m) / c / (1 - sum(p1(x) for x in seen)) * p1(w)

    for h in after:
        assert sum(p2(h, w) for w in [*uni, "unseen"]) == pytest.approx(1, abs=1e-9)
    out = []
    for i, t in rows:
        ws = lower_words(t) + ["</s>"]
        base = sum(math.log10((uni[w] + 1) / (total + len(uni) + 1)) for w in ws)
        out.append((i, len(ws), sum(w in uni for w in ws), total, base, sum(math.log10(p2(h, w)) for h, w in zip(["<s>", *ws[:-1]], ws))))
    return out


@pytest.mark.parametrize("chars", [1 << 20, 60])
def test_against_brute_force(spark, chars):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "the cat"), (3, "repeated row"), (3, "repeated row")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(3)
    got = katz.score(df, chars=chars).collect()
    key = lambda r: (r[0] is None, r[0], r[1], r[4])
    want = sorted(brute(rows), key=key)
    have = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key)
    assert [w[:4] for w in want] == [h[:4] for h in have]
    for w, h in zip(want, have):
        assert h[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)
    assert {r.held_out for r in got if r.doc_id is None} == {None}


def test_nothing_to_learn(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = katz.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(True, 0, 0, 0.0, 0.0)]
    assert katz.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
