"""Periodic runs and phrases against brute force, the quality classifier against labels and its formulas; odd rows for all three."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plasmaflow.llm import phrases, quality, queries, runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(20_000))
EDGE = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t", "en", None, 5), (4, "a b " * 30, "en", "a", 1), (4, "a b " * 30, "en", "b", 1), (None, "a b " * 30, "en", "a", 1),
    (7, LONG, "en", "b", 1), (8, "1234 %% !!", None, "b", 1), (9, "▁ é😀 x  y ", "fr", "c", 1), (10, "one", "en", "c", 1), (11, "x\x0by.z " * 2000, "en", "c", 1),
]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    for c in ("runs", "words", "n", "a", "x", "label", "score", "h", "word", "ids"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_runs(w, least=24, times=3):
    out = []
    for q in range(1, len(w) // times + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(least, times * q) and not any(all(w[x] == w[x - p] for x in range(i - q + p, j)) for p in range(1, q)):
                out.append((i - q, j - i + q, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_match_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        letters = rng.choice([1, 2, 2, 3, 5, 50])
        w = [b"%d" % rng.randrange(letters) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 4)):
            period = [b"%d" % rng.randrange(letters) for _ in range(rng.randint(1, 20))]
            at = rng.randint(0, len(w))
            w[at:at] = [period[x % len(period)] for x in range(rng.randint(0, 80))]
        least, times = rng.choice([(24, 3), (24, 3), (6, 2), (4, 2), (10, 4), (2, 2)])
        expected = brute_runs(w, least, times)
        assert runs.judge(w, least, times)[0] == expected == runs.runs_of(w, least, times)


def test_runs_of_long_texts_stay_near_linear():
    assert runs.judge([b"a"] * 100_000)[0] == [(0, 100_000, 1)]
    assert runs.judge([b"%d" % (i % 20_000) for i in range(100_000)])[0] == [(0, 100_000, 20_000)]
    assert runs.judge([b"x%d" % i for i in range(50_000)] * 2)[0] == []
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 20_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    found = runs.runs_of(list(fibonacci[-1]))
    assert found and all(length >= max(24, 3 * period) for _, length, period in found)


def brute_digest(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_query_matches_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few = docs.where("length(text) < 4000 or text is null").unionByName(spark.createDataFrame(EDGE, SCHEMA).where("doc_id is null or doc_id not in (7, 11)"))
    few.write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted([tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()], key=repr)
    expected = sorted([(r["doc_id"], *brute_digest(r["doc_id"], r["text"])) for r in few.collect()], key=repr)
    assert found == expected and sum(r[1] > 0 for r in found) > 5


def test_runs_edges(edge, none):
    by = {(r["doc_id"], r["n_words"]): r for r in runs.find_runs(edge).collect()}
    assert len(by) == len(EDGE) - 1  # doc_id 4 repeats
    assert by[1, 0]["runs"] == [] and by[1, 0]["collapsed"] == "" and by[2, 0]["collapsed"] == "" and by[3, 0]["collapsed"] == ""
    assert [tuple(r) for r in by[4, 60]["runs"]] == [(0, 60, 2)] and by[4, 60]["collapsed"] == "a b" == by[None, 60]["collapsed"]
    assert by[9, 4]["collapsed"] == "▁ é😀 x y" and by[7, 20_000]["n_words"] == 20_000
    assert [tuple(r) for r in by[11, 4000]["runs"]] == [(0, 4000, 2)]
    assert runs.find_runs(none).count() == 0 and runs.digest(runs.find_runs(runs.with_periodic_tails(none))).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(none, times=1)


def brute_phrases(rows, least, top, contained):
    f, n = {}, {}
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] = n.get(lang, 0) + len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] = f.get((lang, tuple(w[i : i + k])), 0) + 1
    many = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    covered = {}
    for (lang, w), a in many.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                covered[lang, w[i : i + k]] = max(a, covered.get((lang, w[i : i + k]), 0))
    lines = {}
    for (lang, w), a in many.items():
        if 100 * covered.get((lang, w), -1) >= contained * a:
            continue
        score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        lines.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, rank + 1, w.decode(), -a, left, right, n[lang], -score) for lang, own in lines.items() for rank, (score, a, w, left, right) in enumerate(sorted(own)[:top]))


@pytest.mark.parametrize("words, candidates, flush", [(500_000, 1_000_000, 4_000_000), (50, 40, 500)])
def test_phrases_match_brute_force(spark, monkeypatch, words, candidates, flush):
    """Also with tables and tries so small that several of each are needed."""
    for name, value in (("MOST_WORDS", words), ("MOST_CANDIDATES", candidates), ("FLUSH", flush)):
        monkeypatch.setattr(phrases, name, value)
    rng = np.random.default_rng(4)
    vocabulary = [f"{'Wé'[i % 2]}{i}" for i in range(400)]
    rows = []
    for i in range(300):
        own = [vocabulary[k] for k in np.minimum(rng.zipf(1.3, 60) - 1, 399)]
        own[10:14] = ["alpha", "beta", "gamma", "delta"][: int(rng.integers(1, 5))]
        rows.append((i, "".join(w + str(rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b"])) for w in own), [None, "en", "fr"][i % 3]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.collocations(docs, least=6, top=40).collect())
    assert found == brute_phrases([(lang, text) for _, text, lang in rows], 6, 40, 80) and len(found) > 100


def test_double_array_accepts_its_phrases_only():
    rng = np.random.default_rng(2)
    own = np.unique(rng.zipf(1.3, (20_000, 3)).clip(1, 70_000), axis=0)
    trie = phrases.DoubleArray(own, 70_000)
    ids = rng.zipf(1.3, 50_000).clip(0, 70_000).astype(np.int32)
    ids[rng.integers(0, 50_000, 5000)] = 0
    state = phrases.advance(trie.base, trie.check, trie.spell(70_000), ids, 3)
    places = {tuple(w): s for w, s in zip(own.tolist(), trie.accepts.tolist(), strict=True)}
    assert len(set(places.values())) == len(own)
    assert state.tolist() == [places.get(tuple(ids[i : i + 3].tolist()), 0) for i in range(len(ids) - 2)]


def test_phrases_edges(edge, none):
    rows = phrases.collocations(edge, least=1, top=5).collect()
    assert {r["lang"] for r in rows} == {"en", "fr", "und"} and all(r["rank"] <= 5 for r in rows)
    assert [r["phrase"] for r in rows if r["lang"] == "fr"] == ["▁ é😀 x y"]
    assert phrases.collocations(none).collect() == [] and phrases.collocations(edge, least=10**6).collect() == []


def test_quality_held_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.rate(docs, labels).join(labels, "doc_id").where("quality is not null").toPandas()
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows["doc_id"]]).all()
    held = rows[rows["held_out"]]
    ranks, good = held["score"].rank(), held["quality"] == 1
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.98 and (held["predicted"] == held["quality"]).mean() > 0.97
    assert held[good]["predicted"].mean() > 0.97 and (rows["predicted"] == (rows["score"] >= 0.7)).all()
    # neither held-out labels nor lang and source matter
    other = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.rate(docs.drop("lang", "source"), other).toPandas().set_index("doc_id")["score"]
    assert np.allclose(again[rows["doc_id"]].to_numpy(), rows["score"], atol=1e-9)


def test_discriminant_matches_densities(spark):
    rng = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    x = np.concatenate([rng.normal(size=(300, d)) @ rng.normal(size=(d, d)) + 1, rng.normal(size=(500, d))])
    y = [0] * 300 + [1] * 500
    model = quality.fit(spark.createDataFrame([(a, b.tolist()) for a, b in zip(y, x, strict=True)], "label int, x array<double>"), least_shrink=0.2)
    pooled = sum(np.cov(p.T, bias=True) * len(p) for p in (x[:300], x[300:])) / 800
    scale = np.sqrt(np.diag(pooled))
    logs = []
    for part in (x[:300], x[300:]):
        c = quality.shrunk(np.cov(part.T, bias=True) / np.outer(scale, scale), len(part), 0.2)
        z = (x - part.mean(axis=0)) / scale
        logs.append(np.log(len(part) + 1) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (z @ np.linalg.inv(c) * z).sum(axis=1))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_quality_edges(spark, edge, none):
    labels = spark.createDataFrame([(1, None, 0), (4, 1, 0), (None, 1, 0), (9, 5, 0)], "doc_id long, quality int, toxic int")
    rows = quality.rate(edge, labels).collect()
    assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.rate(edge, labels.limit(0)).collect()} == {0.5}
    full = quality.rate(edge, spark.createDataFrame([(4, 1), (7, 0), (8, 0), (9, 1), (10, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, quality int")).collect()
    assert len(full) == len(EDGE) and all(0 <= r["score"] <= 1 for r in full)
    assert quality.rate(none, labels).count() == 0


def test_language_counts_come_as_columns_of_numbers(spark, monkeypatch):
    from plasmaflow.llm import langid

    rows = [(i, "der die das" if i % 2 else "the caté", "de" if i % 2 else "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fetched = []
    real = type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: fetched.append(self.dtypes) or real(self))
    model = langid.fit(docs)
    assert [{kind for _, kind in d} <= {"int", "bigint"} for d in fetched] == [True]
    assert model.langs == ["de", "en"]
    found = langid.predict(docs, model).collect()
    assert {r["lang_pred"] for r in found if r["doc_id"] % 2} == {"de"} and {r["lang_pred"] for r in found if r["doc_id"] % 2 == 0} == {"en"}
