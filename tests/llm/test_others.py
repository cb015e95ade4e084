import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import ann, common, langid, media, toxicity, urls
from tessera.llm.common import vocab


def test_ann_recall_and_ties(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(1500, 12)) * r.uniform(0.2, 3, (1500, 1))
    v[700:760] = v[20]
    rows = [(i, [float(x) for x in a], 0) for i, a in enumerate(v)]
    odd = [(2000, None, 0), (2020, [0.0] * 12, 0), (2040, [float("nan")] * 12, 0), (2060, [1.0, None], 0), (2080, [1.0, 2.0], 0), (2081, [2.0, 2.0], 0), (20, rows[20][1], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int")
    got: dict = {}
    index = ann.build_index(ann.usable(df, "vec_id", "embedding"), 400)
    assert index.count() >= 4
    asked = ann.usable(df, "vec_id", "embedding").filter("vec_id % 20 = 0").dropDuplicates(["vec_id"])
    for x in ann.search_index(index, asked).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert got.pop(2080) == [(1, 2081, 6.0)] and set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        s = v @ v[q]
        best = sorted((i for i in range(1500) if i != q), key=lambda i: (-s[i], i))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(f[2] == pytest.approx(s[f[1]], rel=1e-12) for f in found)
        hits += len({f[1] for f in found} & set(best))
    assert hits / (20 * len(got)) >= 0.95
    assert {f[1] for f in got[20]} >= set(range(700, 719)) - {20} or min(f[2] for f in got[20]) >= v[20] @ v[20]
    assert ann.nearest(df.limit(0)).collect() == []


def test_media(spark):
    r = np.random.default_rng(2)
    for shape in ((5, 7), (4, 6, 3), (1, 1), (9000, 3)):
        a = r.integers(0, 256, shape).astype(np.uint8)
        assert (media.decode(media.write_netpbm(a)) == a).all()
        b = media.decode(media.write_bmp(a))
        assert (b == (a if a.ndim == 3 else np.repeat(a[:, :, None], 3, 2))).all()
        g = media.grey(a)
        h, w = min(4, g.shape[0]), min(3, g.shape[1])
        ys, xs = np.arange(g.shape[0]), np.arange(g.shape[1])
        wy = np.array([[max(0, min(y + 1, (k + 1) * len(ys) / h) - max(y, k * len(ys) / h)) for y in ys] for k in range(h)])
        wx = np.array([[max(0, min(x + 1, (k + 1) * len(xs) / w) - max(x, k * len(xs) / w)) for x in xs] for k in range(w)])
        want = wy @ g @ wx.T / (len(ys) / h * len(xs) / w)
        assert np.abs(media.area_resize(g, h, w) - want).max() <= 0.51
    assert (media.decode(b"P2\n# c\n2 1\n255\n7 9\n") == [[7, 9]]).all() and (media.decode(b"P1\n2 1\n10") == [[0, 255]]).all()
    for bad in (b"", b"P6", b"P5\n9 9\n255\nxx", b"BM123", b"P6\nx"):
        with pytest.raises(ValueError):
            media.decode(bad)
    texts = [None, "", "é" * 500, "a" * 191, "a" * 192, "a" * 193]
    df = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    got = {x.doc_id: x for x in media.text_as_media(df, keep_bytes=True).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        assert got[i].payload_sha256 == hashlib.sha256(p).hexdigest() and got[i].tail_crc32 == zlib.crc32(p[-16:]) and got[i].n_bytes == len(raw)
        assert media.decode(got[i].media).tobytes() == p and got[i].media_bytes == len(got[i].media)
    assert media.media_features(spark.createDataFrame([(1, bytearray(got[2].media)), (2, None)], "i long, m binary"), "i", "m").filter("dhash is null").count() == 1


def test_urls(spark):
    pages = [("http://A.example.org/es/1", ""), ("https://x.org/a?b", ""), ("http://b.com/de/x", '<a href="http://c.net/1">'), ("http://c.net/1", ""), ("http://d.com/fr/x", '<a href="//E.net/2"> <a href="/self">'), ("http://e.net", ""), ("no scheme", ""), (None, None), ("http://example.org", ""), ("http://spam.net/", '<a href="http://b.com/">')]
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1] == ("x.org", "/a", "org/", "allow")
    assert got[2][2:] == ("com/de/", "block") and got[4][2:] == ("com/fr/", "allow") and got[5] == ("e.net", "", None, "allow")
    assert got[6] == ("", "", None, "allow") == got[7] and got[9][3] == "block"
    assert urls.judge(df.limit(0)).collect() == []


def test_urls_of_a_long_chain(spark):
    # distrust goes against the links, from b.com down to the far end of the chain
    pages = [("http://b.com/de/x", "")] + [(f"http://c{k}/", f'<a href="http://{f"c{k - 1}" if k else "b.com"}/">') for k in range(12)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert {r.verdict for r in got.values()} == {"block"}
    ranks = [got[k].distrust for k in range(1, 13)]
    assert all(y == pytest.approx(0.85 * x, rel=1e-2) for x, y in zip(ranks[:-1], ranks[1:]))


def _labelled(n=900):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        s = [" ".join(f"w{r.randrange(500)}" for _ in range(8)) for _ in range(r.randrange(1, 30))]
        bad = i % 6 == 0
        if bad:
            s[r.randrange(len(s))] += " grumph" + r.choice(["ed", "ing", "s", "ler"])
        rows.append((i, ". ".join(s) + "."))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = _labelled()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(9000, None, 1), (9001, "", 1)], "doc_id long, text string, score int")
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    want = dict(labels)
    for r in toxicity.score(df, model).collect():
        assert r.predicted == want.get(r.doc_id, 0) and 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.predicted:
            text = dict(rows)[r.doc_id]
            assert any("grumph" in text[s.start : s.end] for s in r.offending)
    kept = toxicity.without_toxic(df, model)
    assert kept.count() == len(rows) + 2 - sum(want.values()) and kept.columns == df.columns
    none = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(df, none).filter("predicted = 1").isEmpty()


def test_language_id(spark):
    r = random.Random(6)
    bag = {"en": "the of and to in that with from this".split(), "de": "der die und das nicht ein für mit über".split(), "fr": "le la les des une est dans pour être".split()}
    rows = [(i, " ".join(r.choice(bag[lang]) for _ in range(12)), lang) for i in range(300) for lang in [list(bag)[i % 3]]]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 ...", "de"), (902, "", None)], "doc_id long, text string, lang string")
    path = vocab("piece_bpe_32k.model")
    model = langid.train(df, path)
    assert model[0] == ["de", "en", "fr"]
    got = {x.doc_id: x for x in langid.predict(df, model, path).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows]) > 0.98
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and all(0 <= x.score <= 1 for x in got.values())
    assert langid.predict(df.limit(0), langid.train(df.limit(0), path), path).collect() == []


def test_forward_sums_all_segmentations():
    hashes, _, longest = langid.vocabulary(vocab("piece_bpe_32k.model"))
    table = np.random.default_rng(1).uniform(1e-4, 1e-2, (len(hashes), 2))
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocab("piece_bpe_32k.model"))
    place = {int(h): k for k, h in enumerate(hashes)}

    def prob(s, lang):
        if s == "":
            return 1.0
        total = 0.0
        for n in range(1, min(len(s), longest) + 1):
            h = int(langid._hash(np.array([s[:n]], f"U{n}").view(np.uint32).reshape(1, n))[0])
            p = table[place[h], lang] if h in place else langid.UNKNOWN if n == 1 else 0.0
            total += p * prob(s[n:], lang) if p else 0.0
        return total

    words = ["der", "stand", "日本", "unverständlichkeiten"]
    got = langid.log_likelihoods(words, hashes, table, longest)
    for k, w in enumerate(words):
        for lang in (0, 1):
            assert got[k, lang] == pytest.approx(np.log(prob("▁" + w, lang)), rel=1e-9)
    assert sp.get_piece_size() == 32000


def test_pipeline(spark, tmp_path):
    rows, labels = _labelled(300)
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows] + [(1000, rows[1][1], "en", "s0", 1), (1001, None, None, None, None), (1002, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = df.columns, []
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(str(tmp_path / "out" / name))
        df = spark.read.parquet(str(tmp_path / "out" / name))
        seen.append({r.doc_id for r in df.select("doc_id").collect()})
        assert df.columns == columns or name == "bpe"
    bad = {i for i, y in labels if y}
    assert seen[0] == {d[0] for d in docs} - bad
    assert 1000 not in seen[1] and {1, 1001, 1002} <= seen[1] and seen[2] == seen[1]
    assert seen[3] <= seen[2] and seen[4] == seen[3]


def test_batches_are_bounded_unless_the_session_bounds_them(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    plain, own = spark.newSession(), spark.newSession()
    common.bounded(plain)
    assert plain.conf.get(key) == str(common.BATCH_BYTES)
    own.conf.set(key, "1000")
    common.bounded(own)
    assert own.conf.get(key) == "1000"


def test_a_text_larger_than_a_batch_stays_whole(spark):
    session = spark.newSession()
    common.bounded(session)
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000")
    texts = ["a few words", "long " * 2000, "", None]
    docs = session.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = toxicity.score(docs, {"": -3.0, "long": 5.0})
    assert {r["doc_id"] for r in got.collect()} == {0, 1, 2, 3}
    kept = toxicity.without_toxic(docs, {"": -30.0})
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == dict(enumerate(texts))
