"""Training-data operators against brute force, the tokenizer libraries, exact round trips and held-out labels."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plasmaflow.llm import dropout, forest, langid, line_dedup, maxscore, minhash, mixing, pretokens, queries, shards, token_counts, url_filter, wavelet

P = pytest.importorskip("public_tokenizers")
PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(20_000))
EDGE = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t", "en", None, 5), (4, "the same text of some words here", "en", "a", 1), (5, "the same text of some words here", "en", "b", 1),
    (5, "the same text of some words here", "en", "b", 1), (None, "a row without an id", "en", "a", 1), (7, LONG, "en", "b", 1), (8, "1234 %% !!", "en", "b", 1), (9, "▁ é😀 x  y ", "fr", "c", 1), (10, "one", "en", "c", 1),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).withColumn("label", F.lit(1)).withColumn("gone", F.lit("x"))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_components(texts, width, percent):
    sets = {i: ({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w := words(t)) >= width else ({tuple(w)} if w else set())) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_match_brute_force(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, width=4).collect()}
    assert found == brute_components(texts, 4, 80)


def test_near_duplicates_in_a_mutated_family(spark):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        own = list(base)
        for at in rng.integers(0, 150, int(rng.integers(0, 7))):
            own[at] = f"x{rng.integers(1 << 30)}"
        rows.append((1000 + i, " ".join(own)))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert found == brute_components(dict(rows), 4, 80)


def test_near_duplicates_of_repeated_ids_and_without_the_fine_filter(spark, docs):
    a, b = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    df = spark.createDataFrame([(9, a), (9, b), (3, a + " end"), (20, b + " end")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(df).collect()} == {(9, 3), (3, 3), (20, 3)}
    exact = minhash.near_duplicates(docs, width=4, fine=False)
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, minhash.near_duplicates(docs, width=4).collect()))


def test_near_duplicates_edges(edge, none):
    rows = minhash.near_duplicates(edge).collect()
    assert len(rows) == len(EDGE)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[1]["kept"]
    assert by[5]["component_id"] == 4 and not by[5]["kept"] and by[4]["kept"] and by[None]["kept"]
    assert minhash.near_duplicates(none).count() == 0


def brute_lines(rows):
    seen, out = [], {}
    for i, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            own = frozenset(w for w in re.split(r"[ \t\x0b\f\r]+", line.lower()) if w)
            if own and any(100 * len(own & s) >= 80 * len(own | s) for s in seen):
                pass
            else:
                kept.append(line)
            if own and own not in seen:
                seen.append(own)
        out[i] = "\n".join(kept)
    return out


def test_line_dedup_matches_brute_force(docs):
    few = docs.where("doc_id < 60")
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(few).collect()}
    assert found == brute_lines([(r["doc_id"], r["text"]) for r in few.collect()])


def test_line_dedup_crowded_groups_and_clashing_columns(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(60):
        own = list(base)
        for k in rng.choice(30, rng.integers(0, 6), replace=False):
            own[k] = f"v{rng.integers(0, 40)}"
        texts.append(" ".join(own) + "\nshort line " + str(rng.integers(0, 5)))
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("gone", "row", "row_id", "row_hash", "text_hash", "word", "id", "n_lines", "n_removed"):
        df = df.withColumn(c, F.lit("x"))
    for crowded in (64, 2):  # few and nearly all groups take the leader's way
        monkeypatch.setattr(line_dedup, "CROWDED", crowded)
        found = line_dedup.dedup_lines(df)
        assert set(found.columns) == {*df.columns} and len(found.columns) == len(df.columns)
        assert {r["doc_id"]: r["text"] for r in found.collect()} == brute_lines(rows)
    assert {r["gone"] for r in found.collect()} == {"x"}


def test_line_dedup_of_many_lines_in_one_text(spark):
    rows = [(1, "\n".join(["the one line that comes again", ""] * 30_000)), (2, "\n".join(f"alone{i} own{i}" for i in range(20_000)) + "\nthe one line that comes again"), (3, "\n" * 5)]
    by = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert by[1]["text"] == "the one line that comes again\n" + "\n" * 29_999 and (by[1]["n_lines"], by[1]["n_removed"]) == (60_000, 29_999)
    assert by[2]["text"] == rows[1][1].rsplit("\n", 1)[0] and by[2]["n_removed"] == 1 and by[3]["text"] == rows[2][1]


def test_line_dedup_blanks_and_equal_sets(spark):
    rows = [(1, "One two\tthree\n \t\n\none  TWO three "), (2, "three two one one\r\nfour\x0bfive"), (3, "\tfour five\x0c\nfour\u00a0five")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = line_dedup.hashed_lines(df)
    found = collections.defaultdict(set)
    for r in lines.collect():
        found[(r["id"], r["id2"])].add((r["doc_id"], r["line_no"]))
    assert sorted(found.values(), key=sorted) == [{(1, 0), (1, 3), (2, 0)}, {(2, 1), (3, 0)}, {(3, 1)}]  # equal sets are one line before any join
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter ((size(split(" not in plan and plan.count("transform(") == 1  # texts are split once, words hashed once
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()} == brute_lines(rows)


def test_line_dedup_postings_keep_places_apart(spark):
    first = spark.sql("select 5L id, 6L id2, struct(7L doc_id) at, 20 n, array(8, -9, 10, 11, 12) prefix, -1L low, 3L high")
    post = line_dedup._postings(first, 80)
    assert post.columns == ["id", "doc", "shape", "low", "high", "word"]
    found = post.orderBy("shape").selectExpr(line_dedup._n("shape"), "int(shiftright(shape, 1) & 2147483647)", "shape & 1", "word").collect()
    assert [tuple(r) for r in found] == [(20, 0, 1, 8), (20, 1, 1, -9), (20, 2, 1, 10), (20, 3, 0, 11), (20, 4, 0, 12)]


def test_line_dedup_edges(edge, none):
    rows = line_dedup.dedup_lines(edge).collect()
    assert len(rows) == len(EDGE) and set(edge.columns) <= set(rows[0].asDict())
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["text"] is None and by[2]["text"] == "" and by[3]["text"] == "   \n\t" and by[4]["text"] and by[5]["text"] == ""
    assert by[7]["text"] == LONG
    assert line_dedup.dedup_lines(none).count() == 0


def test_language_id(docs, edge, none):
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    by = {r["doc_id"]: r for r in langid.predict(edge, langid.fit(docs)).collect()}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 8)] == ["und"] * 4 and by[10]["lang_pred"] != "und"
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.predict(edge, langid.fit(none)).collect()} == {"und"}


def test_code_lengths_are_those_of_the_context_trees():
    text = b"\n\nabracadabra abra cadabra"
    order, counts = 2, collections.defaultdict(collections.Counter)
    for i in range(2, len(text)):
        for k in range(order + 1):
            counts[text[i - k : i]][text[i]] += 1
    number = lambda b: int.from_bytes(b, "big")
    counted = {}
    for length in range(1, order + 2):
        pairs = sorted((number(c + bytes([s])), n) for c, t in counts.items() if len(c) == length - 1 for s, n in t.items())
        counted[length] = (np.array([p for p, _ in pairs], np.uint64), np.array([n for _, n in pairs], np.int64))

    def cost(context, symbol, barred=frozenset()):
        if context in counts:
            table = {s: n for s, n in counts[context].items() if s not in barred}
            kinds, total = len(counts[context]), sum(table.values()) + len(counts[context])
            if symbol in table:
                return np.log2(total) - np.log2(table[symbol])
            step = np.log2(total) - np.log2(kinds)
            barred = frozenset(counts[context])
        else:
            step = 0.0
        return step + (np.log2(256 - len(barred)) if not context else cost(context[1:], symbol, barred))

    other = b"abrazzcab!"
    model = langid.PPM(order, ["x"], {"x": counted}).prepare()
    found = model.text_bits(np.frombuffer(other, np.uint8), np.array([0, len(other)]))[0, 0]
    padded = b"\n\n" + other
    assert found == pytest.approx(sum(cost(padded[i - 2 : i], padded[i]) for i in range(2, len(padded))), rel=1e-5)


def test_token_counts_match_the_library(docs, edge, none):
    model = pretokens.processor(PIECES)
    for df in (docs, edge):
        texts = df.select("doc_id", "text").collect()
        want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in texts)
        assert want == collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(df, PIECES).collect())
    assert token_counts.count_tokens(none, PIECES).count() == 0


def test_merge_dropout(docs, edge, none):
    model = pretokens.processor(PIECES)
    tool = dropout.Codec(PIECES, 0.0, 0)
    texts = [r["text"] for r in docs.limit(60).collect()]
    assert all(list(np.frombuffer(tool.encode(t, 1), np.int32)) == model.encode(t) for t in texts)
    for df in (docs, edge):
        assert df.count() == dropout.round_trip(df, PIECES).where("lossless").count()
    coded = dropout.encode(edge, PIECES)
    back = {r["doc_id"]: r["text"] for r in dropout.decode(coded, PIECES).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in EDGE)
    a, b = (dropout.round_trip(docs, PIECES, seed=s).agg(F.sum("n_tokens")).first()[0] for s in (1, 1))
    assert a == b > token_counts.count_tokens(docs, PIECES).agg(F.sum("n_tokens")).first()[0]
    assert dropout.round_trip(none, PIECES).count() == 0


def test_merge_dropout_draws_for_each_occurrence(spark):
    tool, word = dropout.vocabulary(PIECES), "international"
    df = spark.createDataFrame([(i, "\n".join([word] * 500)) for i in range(8)], "doc_id long, text string")
    forms = collections.Counter()
    for r in dropout.encode(df.repartition(3), PIECES).collect():
        pieces = "".join("\n" if tool.bytes[i] == b"\n" else f"{i} " for i in r["tokens"]).split("\n")
        forms.update(pieces[1:])  # the first one has the dummy prefix
    assert len(forms) > 20
    # by brute force: every candidate skipped by a coin of its own
    rng = np.random.default_rng(5)
    coins = lambda: sum(int(x) << k for k, x in enumerate(rng.random(64) < 0.1))
    want = collections.Counter("".join(f"{i} " for i in np.frombuffer(tool.segment(word, coins())[0], np.int32)) for _ in range(4000))
    total = sum(forms.values())
    assert all(abs(forms[f] / total - n / 4000) < 0.04 for f, n in want.most_common(5))
    one = [tuple(r["tokens"]) for r in dropout.encode(df.where("doc_id = 1").union(df.where("doc_id = 1")), PIECES).collect()]
    assert one[0] == one[1]


def naive_dropout(tool, piece, skips):
    """The agenda by full rescans: symbols carry numbers, a skipped candidate is a pair of numbers that is not asked again."""
    symbols = [(i, "▁" if c == " " else c) for i, c in enumerate(piece)]
    fresh, asked, gone = len(symbols), 0, set()
    while True:
        found = [(tool.scores[x + y], k) for k, ((i, x), (j, y)) in enumerate(zip(symbols, symbols[1:])) if x + y in tool.scores and (i, j) not in gone]
        if not found:
            break
        k = min(found)[1]
        (i, x), (j, y) = symbols[k : k + 2]
        if skips >> asked & 1:
            gone.add((i, j))
        else:
            symbols[k : k + 2] = [(fresh, x + y)]
            fresh += 1
        asked += 1
    out = []
    for _, x in symbols:
        out += [tool.ids[x]] if x in tool.ids else [tool.byte_ids[b] for b in x.encode()]
    return out


@pytest.mark.parametrize("rate", [0.1, 0.5, 1.0])
def test_merge_dropout_side_by_side_matches_brute_force(rate, monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("aeinrst\u00e9\U00010000"), size=n)) for n in range(1, 150, 7)]
    texts = [None, "", " ", "a  b \n", *texts, " ".join(texts), "internationalisation " * 40]
    codec, doc_ids = dropout.Codec(PIECES, rate, 13), [None, *range(1, len(texts))]
    ids, counts = codec.encode_all(texts, doc_ids)
    want = []
    for text, doc_id in zip(texts, doc_ids, strict=True):
        first = np.uint64(dropout.xxhash.xxh64_intdigest(b"%d" % (doc_id or 0), 13))
        for place, piece in enumerate(pretokens.split(text or "")):
            key = dropout.mix64(np.array([place], np.uint64) + first)[0]
            words = codec._bits(key + np.arange(8, dtype=np.uint64) * np.uint64(1 << 32)).tolist()
            want += naive_dropout(codec.words, piece, sum(w << 64 * k for k, w in enumerate(words)))
    assert ids.tolist() == want and counts.sum() == len(want) and counts[:2].tolist() == [0, 0]
    monkeypatch.setattr(dropout, "SLICE_CHARS", 50)
    assert dropout.Codec(PIECES, rate, 13).encode_all(texts, doc_ids)[0].tolist() == want


def test_merge_dropout_of_a_very_long_pre_token():
    rng = np.random.default_rng(8)
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size=300_000))
    codec = dropout.Codec(PIECES, 0.1, 13)
    assert codec.decode(codec.encode(text, 1)) == text
    part = text[:700]  # many words of bits: a number and its bytes choose alike, as a full rescan does
    skips = int.from_bytes(rng.bytes(3 * len(part) // 8 + 1), "little")
    packed = skips.to_bytes(3 * len(part) // 8 + 1, "little")
    got = codec.words.segment(part, skips)
    assert got == codec.words.segment(part, packed) and np.frombuffer(got[0], np.int32).tolist() == naive_dropout(codec.words, part, skips)


def test_merge_dropout_matches_brute_force(docs):
    codec = dropout.Codec(PIECES, 0.1, 13)
    for r in docs.where("length(text) < 3000 and not contains(text, '▁')").limit(40).collect():
        pieces = pretokens.split(r["text"])
        first = np.uint64(dropout.xxhash.xxh64_intdigest(b"%d" % r["doc_id"], 13))
        bits = codec._bits(dropout.mix64(np.arange(len(pieces), dtype=np.uint64) + first)).tolist()
        want = [i for p, b in zip(pieces, bits) for i in naive_dropout(codec.words, p, b) if len(p) <= 30]
        got = [i for p, b in zip(pieces, bits) for i in np.frombuffer(codec.words.segment(p, b)[0], np.int32).tolist() if len(p) <= 30]
        assert want == got
        if all(len(p) <= 30 for p in pieces):
            assert np.frombuffer(codec.encode(r["text"], r["doc_id"]), np.int32).tolist() == want
    keys = dropout.mix64(np.arange(50_000, dtype=np.uint64))
    share = np.bitwise_count(codec._bits(keys)).mean() / 64
    assert abs(share - 0.1) < 0.002
    assert (codec._bits(keys) == codec._bits(keys)).all() and not dropout.Codec(PIECES, 0.0, 1).encode("a b", 1) == b""


def test_wavelet_matrix_answers_like_the_list():
    ids = np.random.default_rng(0).zipf(1.3, 5000) % 49408
    tree = wavelet.WaveletMatrix.build(ids)
    assert (tree.ids() == ids).all()
    assert all(tree.access(i) == ids[i] for i in range(0, 5000, 37))
    for v in (1, 2, 77, 49407, 70000):
        places = np.flatnonzero(ids == v)
        assert tree.count(v) == len(places) and tree.count(v, 100, 3000) == ((places >= 100) & (places < 3000)).sum()
        assert [tree.locate(v, k) for k in range(min(5, len(places)))] == places[:5].tolist() and tree.locate(v, len(places)) == -1
    assert wavelet.WaveletMatrix.build(np.zeros(0, int)).ids().tolist() == []


def test_wavelet_shards_match_the_library(docs, edge, none):
    tool = wavelet.Tokenizer.from_file(WORDS)
    for df in (docs, edge):
        texts = sorted(((r["doc_id"] is not None, r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda x: (x[0], x[1] or 0))
        start, want = 0, []
        for _, i, t in texts:
            ids = [*tool.encode(t, add_special_tokens=False).ids, 1]
            want.append((i, start, ids))
            start += len(ids)
        got = sorted(((r["doc_id"], r["start"], r["ids"]) for r in wavelet.token_shards(df, WORDS).collect()), key=lambda x: x[1])
        assert got == want
    assert wavelet.token_shards(none, WORDS).count() == 0


def test_mixing_meets_targets(docs, edge, none):
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    sums = rows.groupby("source").agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), largest=("size", "max"))
    assert (sums["size"] == sums["own"]).all() and (rows["taken"] <= 2 * rows["size"]).all()
    assert ((sums["taken"] - sums["target"]).abs() <= sums["largest"]).all()
    assert sums["target"].sum() == pytest.approx(1.5 * sums["size"].sum())
    again = mixing.mix(docs.repartition(3)).toPandas().sort_values("doc_id")["taken"].tolist()
    assert again == rows.sort_values("doc_id")["taken"].tolist()
    assert mixing.mix(edge).count() == len(EDGE) and mixing.mix(none).count() == 0


def test_flow_prefers_fresh_words_and_overlaps():
    flows = mixing.min_cost_flow([("a",), ("a", "b"), ("b",)], [10, 10, 10], {"a": 15, "b": 15}, 2)
    got = collections.Counter()
    for f in flows:
        for (s, r), w in f.items():
            got[s] += w
            assert r == 0
    assert got == {"a": 15, "b": 15}
    assert sum(w for f in mixing.min_cost_flow([("a",)], [10], {"a": 15}, 2) for (s, r), w in f.items() if r == 1) == 5


def test_flow_is_the_cheapest_of_all():
    """Against every way to route the words of three patterns to two sources."""
    rng = np.random.default_rng(4)
    cost = lambda words, size: max(words - size, 0)  # noqa: E731  two passes, the second one at 1 a word
    for _ in range(25):
        size, quota = rng.integers(0, 4, 3).tolist(), {"a": int(rng.integers(0, 9)), None: int(rng.integers(0, 9))}
        best = min(
            (-(x + y + v + w), cost(x, size[0]) + cost(y + v, size[1]) + cost(w, size[2]))
            for x in range(2 * size[0] + 1) for y in range(2 * size[1] + 1) for v in range(2 * size[1] - y + 1) for w in range(2 * size[2] + 1)
            if x + y <= quota["a"] and v + w <= quota[None]
        )
        flows = mixing.min_cost_flow([("a",), ("a", None), (None,)], size, quota, 2)
        assert (-sum(sum(f.values()) for f in flows), sum(r * w for f in flows for (_, r), w in f.items())) == best
        assert all(sum(w for f in flows for (s, _), w in f.items() if s == name) <= most for name, most in quota.items())
        assert all(sum(w for (_, r), w in f.items() if r == own) <= n for f, n in zip(flows, size, strict=True) for own in (0, 1))


def test_flow_over_many_patterns():
    rng = np.random.default_rng(6)
    names = [f"s{i:02}" for i in range(60)]
    patterns = [tuple(sorted(rng.choice(names, rng.integers(1, 5), replace=False))) for _ in range(20_000)]
    size = rng.integers(1, 10_000, len(patterns)).tolist()
    quota = {s: round(1.2 * sum(size) / 60) for s in names}
    flows = mixing.min_cost_flow(patterns, size, quota, 2)
    assert sum(sum(f.values()) for f in flows) == sum(quota.values())
    assert sum(r * w for f in flows for (_, r), w in f.items()) == sum(quota.values()) - sum(size)


def test_targets_share_the_excess():
    assert mixing.targets({"a": 10, "b": 100, None: 100}) == {"a": 20, "b": pytest.approx(590 / 3 if 590 / 3 <= 200 else 200), None: pytest.approx(295 / 3)}


@pytest.fixture(scope="module")
def vectors(spark, sf):
    odd = spark.createDataFrame([(1000, None, 1), (1020, [float("nan")] + [0.0] * 63, 1), (1040, [None] + [0.5] * 63, 1), (1060, [0.0] * 64, 1), (1100, [0.5, -0.5], 1), (None, [1.0] * 64, 1)], "vec_id long, embedding array<float>, label int")
    return spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").unionByName(odd)


def brute_top(table, every, k, scale=None):
    usable = {r["vec_id"]: np.array(r["embedding"] + [0.0] * (64 - len(r["embedding"])), float) for r in table if r["vec_id"] is not None and r["embedding"] is not None and all(x is not None and np.isfinite(x) for x in r["embedding"])}
    if scale:
        usable = {i: np.floor(scale * v) for i, v in usable.items()}
    else:
        usable = {i: v for i, v in usable.items() if v.any()}
    return {q: sorted(((-float(v @ usable[q]), i) for i, v in usable.items() if i != q))[:k] for q in usable if q % every == 0}


def test_maxscore_is_exact(vectors):
    want = {(q, r + 1, i, int(-s)) for q, top in brute_top(vectors.collect(), 50, 5, 256).items() for r, (s, i) in enumerate(top)}
    # a short vector's missing components count as zeros, not as floor(256 * 0), which is zero too
    assert {tuple(r) for r in maxscore.search(vectors).collect()} == want


def test_prefix_forest_recall(vectors):
    want = brute_top(vectors.collect(), 20, 20)
    found = collections.defaultdict(list)
    for r in forest.nearest(vectors).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == set(want) and all(len(v) == 20 for v in found.values())
    assert np.mean([len({i for i, _ in found[q]} & {i for _, i in top}) / 20 for q, top in want.items()]) >= 0.9
    assert all(a[1] > b[1] or a[1] == b[1] and a[0] < b[0] for v in found.values() for a, b in zip(v, v[1:]))  # noqa: B905


def test_vector_searches_with_an_id_repeated(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(64) / 8).tolist(), 1) for i in range(1, 600)]
    near = np.array(rows[99][1])  # of vec_id 100, a query of both
    rows += [(601, (near * 3 + rng.standard_normal(64) / 100).tolist(), 1) for _ in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for found, k, scale in ((maxscore.search(table), 5, 256), (forest.nearest(table, least=10**6), 20, None)):
        best = collections.defaultdict(lambda: -np.inf)
        for i, v, _ in rows:
            a, b = (np.floor(scale * np.array(x)) if scale else np.array(x) for x in (v, near))
            if i != 100:
                best[i] = max(best[i], float(a @ b))
        want = [i for i, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]]
        assert [r["vec_id"] for r in found.where("query_id = 100").orderBy("rank").collect()] == want


def test_vector_searches_shuffle_each_row_once(spark, monkeypatch):
    """Rows that enter exchanges: those of the table, and each query's best of each task; groups of queries change no answer."""
    monkeypatch.setattr(shards, "SHARD_ROWS", 256)
    rng = np.random.default_rng(8)
    seen, real = [], shards.build
    monkeypatch.setattr(shards, "build", lambda rows, *a: (seen.append(rows.count()), real(rows, *a))[1])
    for n in (1000, 4000):
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((n, 8)))], "vec_id long, embedding array<double>")
        seen.clear()
        one = {tuple(r) for r in maxscore.search(table).collect()}
        assert seen == [n]  # the index is built from each row once
        with monkeypatch.context() as m:
            m.setattr(shards, "QUERY_BYTES", 800)
            seen.clear()
            assert {tuple(r) for r in maxscore.search(table).collect()} == one and seen == [n]


def test_vector_searches_with_huge_components(spark):
    table = spark.createDataFrame([(20, [1e200, 0.0]), (1, [1e90, 1e200]), (2, [2e100, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    found = {r["query_id"]: [] for r in forest.nearest(table).collect()}
    for r in forest.nearest(table).orderBy("rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    assert found == {20: [2, 1, 3]}


def test_vector_searches_on_empty_tables(vectors):
    assert forest.nearest(vectors.where("false")).count() == 0 and maxscore.search(vectors.where("false")).count() == 0


def naive_templates(urls, hidden, depth=3, most=50, common=0.02, alpha=0.05, support=5, silent=0.5, strength=2.0):
    """verdict, template and purity of each url, by a recursive tree in plain Python."""
    pages = []
    for i, url in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h) + len(p), v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        kinds = [re.sub(r"^(?:[0-9]+|[0-9a-fA-F-]{8,})(\.[A-Za-z0-9]{1,5})?$", lambda k: "*" + (k[1] or ""), s) for s in path.split("/") if s][:depth]
        pages.append((host, kinds, None if i in hidden or not fits else max(fits)[1]))
    weight = lambda ps: sum(1 if p[2] else silent for p in ps)
    blocked = lambda ps: sum(p[2] == "block" for p in ps)
    out = [None] * len(urls)

    def grow(ids, level, name, above, best):
        own = [pages[i] for i in ids]
        pure = (blocked(own) + strength * above) / (weight(own) + strength)
        best = (name, pure) if level == 0 or len(ids) >= support else best
        children = collections.defaultdict(list)
        for i in ids:
            if len(pages[i][1]) == level:
                out[i] = best
            else:
                children[pages[i][1][level]].append(i)
        total, branches = sum(map(len, children.values())), collections.defaultdict(list)
        for own_name, group in children.items():
            branches["*" if len(children) > most and len(group) < common * total else own_name] += group
        merged = []
        for branch, group in sorted(branches.items(), key=lambda x: (-len(x[1]), x[0])):
            after = {pages[i][1][level + 1] for i in group if len(pages[i][1]) > level + 1}
            kind = any(a.startswith("*") for a in after), any(not a.startswith("*") for a in after), branch.startswith("*")
            ps = [pages[i] for i in group]
            for m in merged:
                w, v = weight([pages[i] for i in m[2]]), weight(ps)
                gap = abs(blocked([pages[i] for i in m[2]]) / w - blocked(ps) / v)
                if m[1] == kind and gap <= min(0.5, np.sqrt(np.log(2 / alpha) / 2) * (w**-0.5 + v**-0.5)):
                    m[2].extend(group)
                    break
            else:
                merged.append((branch, kind, list(group)))
        for branch, _, group in merged:
            grow(group, level + 1, f"{name}/{branch}", pure, best)

    hosts = collections.defaultdict(list)
    for i, p in enumerate(pages):
        hosts[p[0]].append(i)
    whole = blocked(pages) / weight(pages)
    for ids in hosts.values():
        grow(ids, 0, "", whole, None)
    return [(p[2] or ("block" if round(b[1], 6) >= 0.8 else "allow"), b[0], round(b[1], 6)) for p, b in zip(pages, out, strict=True)]


def test_url_templates_match_brute_force(spark, sf):
    rng = np.random.default_rng(4)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    urls = [f"http://{pick('a.net', 'b.net', 'c.org', 'x.com', 'example.com')}/{pick('en', 'es', 'fr', 'de')}/{pick('news', 'item', str(rng.integers(99)), f'p{rng.integers(200)}')}/{pick('1.html', '22.html', 'deadbeef00', 'about', 'z')}" for _ in range(1500)]
    urls += [r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").limit(200).collect()] + [None, "nothing", "http://a.net", "http://a.net", "http://a.net/es/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    hidden = {i for i in range(len(urls)) if i % 5 == 0}
    for none_hidden, column in ((set(), None), (hidden, F.col("page_id") % 5 == 0)):
        want = naive_templates(urls, none_hidden)
        found = {r["page_id"]: (r["verdict"], r["template"], r["purity"]) for r in url_filter.judge(df, hidden=column).collect()}
        assert [found[i] for i in range(len(urls))] == want
    assert any(found[i][0] == "block" for i in hidden)  # a template blocks what no visible rule does
    rows = {r["truth"]: r for r in url_filter.agreement(df).collect()}
    assert sum(r["agree"] for r in rows.values()) >= 0.9 * sum(r["hidden"] for r in rows.values())
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_rules_and_templates(spark):
    urls = ["https://WWW.Example.com/en/1", "http://a.example.com/en/2?x", "http://example.com/de/#t", "http://b.net/es/9", "http://net/fr/", "http://c.org/en/1", "nothing", None, "://", "http://c.org", "x://y.com?a/b", "http://com/"]
    rows = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit("clash"))).collect()}
    assert [(rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) for i in range(len(urls))] == [
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("a.example.com", "/en/2", "example.com/en/", "block"), ("example.com", "/de/", "com/", "allow"), ("b.net", "/es/9", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block"),
        ("c.org", "/en/1", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("c.org", "", None, "allow"), ("y.com", "", None, "allow"), ("com", "/", "com/", "allow"),
    ]
    many = [(i, f"http://x.net/{lang}/{i}") for i in range(60) for lang in ("es", "fr")] + [(900 + i, f"http://x.net/{i}") for i in range(3)]
    judged = url_filter.judge(spark.createDataFrame(many, "page_id int, url string")).where("rule is null").collect()
    assert {r["verdict"] for r in judged} == {"block"}  # nearly all labelled pages of the host are blocked


def test_pipeline_stages(spark, sf, docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "encode_tokens"]
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before, result = out, stage(spark, out, sf)
        path = f"{spark.conf.get('spark.checkpoint.dir', 'file:///tmp')}/test-{name}"
        result.write.mode("overwrite").parquet(path)
        out = spark.read.parquet(path)
        if name != "encode_tokens":
            assert out.columns == before.columns
        assert 0 < out.count() <= 2 * before.count()
    assert out.columns == ["doc_id", "lang", "source", "tokens"]


def test_pipeline_rows_of_repeated_and_missing_ids(spark, sf):
    text = lambda a: " ".join(f"{a}{i}" for i in range(50))
    rows = [(1, text("p")), (1, text("p")), (1, text("q")), (2, text("p")), (None, text("r")), (None, text("r")), (None, text("q")), (3, ""), (3, "")]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    left = corpus_pipeline.near_dedup(spark, df, sf).select("doc_id", "text").collect()
    assert collections.Counter(tuple(r) for r in left) == collections.Counter([(1, text("p")), (1, text("q")), (None, text("r")), (3, ""), (3, "")])
    many = spark.createDataFrame([(7, text("s"), "en", "a", 1)] * 100 + [(i, text(f"t{i}x"), "en", "b", 1) for i in range(8, 408)], SCHEMA)
    sizes = mixing.mix(many.drop("doc_id").withColumn("doc_id", F.lit(None).cast("long"))).select("source_size", "target").distinct().collect()
    mixed = dict(map(tuple, corpus_pipeline.mix_sources(spark, many, sf).groupBy("source").count().collect()))
    assert {r["source_size"]: round(r["target"]) for r in sizes} == {50 * 100: pytest.approx(50 * mixed["a"], abs=100), 50 * 400: pytest.approx(50 * mixed["b"], abs=100)}


def test_pipeline_stages_on_odd_rows(spark, sf, edge, none):
    for df in (edge.select(docs_columns()), none):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, sf).count()


def docs_columns():
    return corpus_pipeline.COLUMNS


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 11))
