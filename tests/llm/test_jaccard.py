import random

import numpy as np
import pytest

from tessera.llm import common, jaccard
from tessera.llm.common import lower_words


def brute(rows, words, percent):
    sets = []
    for i, t in rows:
        w = lower_words(t)
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if i is not None and j is not None and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return sorted(((i is None, i or 0, len(s), -1 if i is None else find(i)) for (i, _), s in zip(rows, sets)))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    rows, base = [], []
    for _ in range(60):
        base.append([word() for _ in range(r.choice([1, 3, 4, 5, 6, 8, 12, 20, 45, 90, 200, 400]))])
    for k in range(420):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6, 10])):
            at = r.randrange(len(w) + 1)
            w[at : at + r.choice([0, 1])] = [word()] * r.choice([0, 1, 1])
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize(("seed", "chars", "most"), [(2, 4000, 4096), (3, 1 << 20, 6)])  # the last deals groups in blocks
def test_against_brute_force(spark, seed, chars, most):
    rows = corpus(seed) + [(900, None), (901, ""), (902, " \n"), (None, "a b c d e f"), (903, "a b c d e f"), (904, "A B c d e f"), (905, "short one"), (906, "SHORT one"), (5, "other text for a repeated id it is"), (907, "other text for a repeated id it is")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rep int").repartition(3)
    got = jaccard.join(df, chars=chars, most=most).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute(rows, 5, 80)


def test_empty(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_groups_of_many_parts_are_whole_and_made_once(spark):
    rng, parts = np.random.default_rng(5), 9
    shared: dict[int, set[int]] = {}
    rows = []
    for block in range(4):
        ids = np.arange(block * 10, block * 10 + 10)
        keys = np.sort(rng.integers(0, 60, 200).astype(np.uint64) * np.uint64((1 << 64) // 60))
        at = rng.integers(0, 10, 200).astype(np.uint16)
        for k, a in zip(keys.tolist(), at.tolist(), strict=True):
            shared.setdefault(k, set()).add(int(ids[a]))
        for p, i, j in common.slices(keys, parts):
            if i < j:
                rows.append((p, common.pack_sorted(keys[i:j]), common.pack(at[i:j]), common.pack_sorted(ids.view(np.uint64))))
    # a group that several signatures share, in parts of different tasks
    for k in range(3, 60, 8):
        key = np.array([k * ((1 << 64) // 60) + 1], np.uint64)
        part = next(p for p, i, j in common.slices(key, parts) if i < j)
        for one in (101, 102, 103):
            rows.append((part, common.pack_sorted(key), common.pack(np.zeros(1, np.uint16)), common.pack_sorted(np.array([one], np.uint64))))
    want = sorted({tuple(sorted(v)) for v in shared.values() if len(v) > 1} | {(101, 102, 103)})
    table = spark.createDataFrame([(p, bytearray(k), bytearray(a), bytearray(i)) for p, k, a, i in rows], "part int, keys binary, at binary, ids binary")
    assert sorted(tuple(r["members"]) for r in jaccard.groups(table, parts).collect()) == want
    assert jaccard.groups(table.limit(0), parts).collect() == []
