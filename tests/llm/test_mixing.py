import re

import pytest

from tessera.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(size, weights=(3, 1, 2), budget=1.5, cap=2.0):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = budget * sum(size.values()), {}
    while len(fixed) < len(names):
        free = [s for s in names if s not in fixed]
        share = (total - sum(fixed.values())) / sum(w[s] for s in free)
        over = [s for s in free if share * w[s] > cap * size[s]]
        if not over:
            return fixed | {s: share * w[s] for s in free}
        fixed |= {s: cap * size[s] for s in over}
    return fixed


def sainte_lague(votes, seats):
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        s = max((v / (2 * won[k] + 1), -i, k) for i, (k, v) in enumerate(votes.items()))[2]
        won[s] += 1
    return won


def test_apportion(spark):
    votes = {f"s{i:02}": v for i, v in enumerate([5300.0, 2400.0, 2300.0, 1.0, 990.0, 40.0, 40.0, 77777.0])}
    df = spark.createDataFrame([("all", k, v, 137) for k, v in votes.items()], "g string, s string, v double, n long")
    got = {r.s: r.quota for r in mixing.apportion(df, ["g"], "n", "v", ["s"]).collect()}
    assert got == sainte_lague(votes, 137)


def rows():
    out = [(i, " ".join(f"w{i}x{j}" for j in range(1 + i * 7 % 90)), f"s{i % 5}" if i % 3 else "s0") for i in range(400)]
    return out + [(900, None, "s1"), (901, "", "s2"), (902, " \t", None), (903, "a\xa0b c", None), (5, "again a row", "s1"), (5, "again a row", "s1"), (None, "no id here", "s9")]


def test_mix(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, source string, size string").repartition(4)
    got = mixing.mix(df, block=4).collect()
    assert len(got) == len(data)
    size = {}
    for _, t, s in data:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    want, taken = water(size), {}
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 4 * 4
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(df.repartition(3), block=4).collect()))
    assert mixing.mix(df.limit(0)).collect() == []


def test_texts(spark):
    df = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows()], "doc_id long, text string, lang string, source string, n_chars long")
    taken = {}
    for r in mixing.mix(df, block=4).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    made = {}
    got = mixing.mixed_texts(df, block=4)
    assert got.columns == df.columns
    for r in got.collect():
        made[r.doc_id] = made.get(r.doc_id, 0) + len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert made == {k: v for k, v in taken.items() if v}
