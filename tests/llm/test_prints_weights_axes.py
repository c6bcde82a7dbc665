"""Order MinHash, importance resampling and whitening against brute force, with odd rows and tables."""

import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orbispan.llm import order_minhash, queries, resample, whitening

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
WORDS = [f"w{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- order MinHash ------------------------------------------------------------------------------------------------------

ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}".replace("Is", "Script=")


def tokens_of(text):
    import regex

    word = rf"[[\p{{L}}\p{{M}}\p{{N}}]--[{ALONE}]]"
    return regex.findall(rf"(?V1){word}{{1,8}}[^\p{{L}}\p{{M}}\p{{N}}]{{0,4}}|[{ALONE}]|[^\p{{L}}\p{{M}}\p{{N}}]{{1,4}}", text or "")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(values, seed=42):
    """Hash of strings in a row, each the seed of the next."""
    for v in values:
        seed = xxhash.xxh64(v.encode(), seed=seed).intdigest()
    return seed


def numbered_kmers(text, k=2):
    """(place on the circle, position) of each k-mer, by a count of those before."""
    tokens = tokens_of(text)
    seen, out = {}, []
    for i in range(max(len(tokens) - k, 0) + 1 if tokens else 0):
        h = signed(xx(tokens[i : i + k])) >> 28
        number = seen[h] = seen.get(h, -1) + 1
        if number:
            h = signed(xxhash.xxh64(number.to_bytes(4, "little"), seed=xxhash.xxh64((h & (1 << 64) - 1).to_bytes(8, "little"), seed=42).intdigest()).intdigest()) >> 28
        out.append((h << 28 | i, i))
    return tokens, sorted(out)


def fingerprint(text, k=2, size=2, sketches=64):
    tokens, circle = numbered_kmers(text, k)
    out = []
    for j in range(sketches):
        mark = (j << 64) // sketches - (1 << 63)
        after = [x for x in circle if x[0] >= mark] + [x for x in circle if x[0] < mark]
        words = [w for _, at in sorted((at, at) for _, at in after[:size]) for w in tokens[at : at + k]]
        out.append(signed(xx(words)) >> 32)
    return out


TEXTS = [None, "", " ", "one", "a b", "yyyy" * 300, "日本語の文章です。これも", "नमस्ते दुनिया", "to be or not to be, that is to be " * 9, "été 🙂🙂 naïve"]


def test_order_minhash_equals_brute_force(spark):
    rng = random.Random(1)
    texts = TEXTS + [prose(rng, rng.randrange(1, 400)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, tokens string").repartition(3)
    for size, k in ((2, 2), (3, 1)):
        got = {r.doc_id: r for r in order_minhash.with_fingerprint(df, "text", "kmers", k=k, size=size).collect()}
        assert all(got[i].kmers == fingerprint(t, k, size) for i, t in enumerate(texts))
        assert got[3].tokens == "x"


def test_order_counts_where_the_set_of_kmers_does_not(spark):
    rng = random.Random(2)
    words = [f"v{rng.getrandbits(40):x}" for _ in range(400)]
    moved = words[200:] + words[:200]
    rows = [(0, " ".join(words)), (1, " ".join(moved)), (2, " ".join(words[:300] + moved[:100])), (3, " ".join(words[:399] + ["other"]))]
    out = {r.id: r.fp for r in order_minhash.with_fingerprint(spark.createDataFrame(rows, "id long, text string"), "text", "fp", sketches=256).collect()}
    like = lambda a, b: sum(x == y for x, y in zip(out[a], out[b])) / 256
    assert like(0, 3) > 0.9 and 0.35 < like(0, 1) < 0.65  # half of the pairs keep their order, though nearly all k-mers are the same
    assert 0.1 < like(0, 2) < 0.6


def test_repeats_are_counted(spark):
    cycle = " ".join(WORDS[:30]) + " "
    df = spark.createDataFrame([(1, cycle * 4), (2, cycle * 40)], "id long, text string")
    a, b = (r.fp for r in order_minhash.with_fingerprint(df, "text", "fp").orderBy("id").collect())
    assert sum(x == y for x, y in zip(a, b)) / 64 < 0.2


def test_edited_pairs_with_nulls_repeats_and_clashing_names(spark):
    rng = random.Random(3)
    rows = [(None, "a null id " * 5), (7, prose(rng, 30)), (7, prose(rng, 50)), (9, "same row " * 8), (9, "same row " * 8), (9, "same row " * 8), (-4, None), (12, ""), (13, prose(rng, 4000)), (14, "🙂é" * 21)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, n int, next string").repartition(4)
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(xx([r[1] or ""]))))
    want = {}
    for at, (i, t) in enumerate(order):
        t, nxt = t or "", order[(at + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        want[i, t] = (len(t), edited, fingerprint(t), fingerprint(edited), fingerprint(nxt))
    got = order_minhash.edited_pairs(df).collect()
    assert sorted((str(r.id), r.n_chars, r.edited) for r in got) == sorted((str(i), len(t or ""), want[i, t or ""][1]) for i, t in rows)
    for r in got:
        i, t = next(k for k in want if k[0] == r.id and want[k][1] == r.edited)
        assert (r.fingerprint, r.edited_fingerprint, r.next_fingerprint) == want[i, t][2:]
    one = order_minhash.edited_pairs(df.where("doc_id = 13")).collect()
    assert len(one) == 1 and one[0].next_fingerprint == one[0].fingerprint
    assert order_minhash.edited_pairs(df.limit(0)).count() == 0


@needs_tables
def test_order_minhash_query_on_the_table(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "PART_ROWS", 50)  # several ranges
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(texts)
    got = {r.doc_id: r for r in queries.op11_order_minhash(spark, SF).collect()}
    assert sorted(got) == ids
    hexed = lambda fp: "".join(f"{x & 0xFFFFFFFF:08x}" for x in fp)
    prints = {i: fingerprint(t) for i, t in texts.items()}
    for at, i in enumerate(ids):
        t, nxt = texts[i], ids[(at + 1) % len(ids)]
        q = len(t) // 4
        edited = t[: len(t) - q] + texts[nxt][:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == hexed(prints[i]) and r.near_next == sum(x == y for x, y in zip(prints[i], prints[nxt])) / 64
    assert np.mean([r.near_edited for r in got.values()]) > 0.3 > 0.05 > np.mean([r.near_next for r in got.values()])


# --- importance resampling ------------------------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def resampled(rows, target, percent=10, least=20, n=1):
    runs = lambda w: [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = np.zeros(10000), np.zeros(10000)
    for _, x in rows:
        for f in runs(words_of(x)):
            s[bucket(f)] += 1
    for x in target:
        for f in runs(words_of(x)):
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((a + 1) * (s.sum() + 10000) / ((b + 1) * (t.sum() + 10000)))) for a, b in zip(t, s)]
    out = []
    for i, x in rows:
        f = runs(words_of(x))
        w = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), len(words_of(x)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[2] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return [(*r, rank.get(id(r))) for r in out]


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_equals_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(resample, "PART_ROWS", 20)
    monkeypatch.setattr(resample, "PIECE", 1000)
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(1, 90)) + (" ÉCOLE É" if i % 3 else " Z-9")) for i in range(150)]
    rows += [(None, prose(rng, 40)), (500, None), (501, ""), (502, "!!! ---"), (503, "word " * 30000), (504, "y" * 50000), (505, "nul\x00byte and ab\x7fc")]
    target = [None, "", prose(rng, 200), " ".join(WORDS[:20] * 9)]
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, weight int, rank string").repartition(4)
    tf = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.drawn(resample.importance_weights(df, tf, max_words=n)).collect()
    key = lambda r: str(r[0])
    assert sorted([(r.id, r.n_features, r.n_words, r.weight, r.score, r.rank) for r in got], key=key) == sorted(resampled(rows, target, n=n), key=key)


def test_resampling_of_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "word " * 30)] * 40 + [(2, "other " * 30)] * 10, "doc_id long, text string").repartition(3)
    got = resample.drawn(resample.importance_weights(df, df.limit(0)), percent=50).collect()
    assert len(got) == 50 and sorted(r.rank for r in got if r.rank) == list(range(1, 26)) and len({(r.id, r.weight, r.score) for r in got}) == 2
    assert resample.drawn(resample.importance_weights(df.limit(0), df)).count() == 0


def test_bit_planes_add_up_exactly():
    rng = np.random.default_rng(5)
    for most in (0, 1, 3, 700, 1 << 40):
        counts = rng.integers(0, most + 1, 1000)
        gains = rng.integers(-20000, 20000, 1000)
        assert resample.Gains(gains).total(counts) == sum(int(c) * int(g) for c, g in zip(counts, gains))
    assert resample.Gains(np.zeros(70, dtype=np.int64)).total(np.ones(70, dtype=np.int64)) == 0


@needs_tables
def test_resampling_query_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    want = con.execute(queries.SQL["op12_bit_sliced_resampling"])
    names = [c[0] for c in want.description]
    got = queries.op12_bit_sliced_resampling(spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) > 100


# --- whitening --------------------------------------------------------------------------------------------------------------


def whole(v):
    return [math.floor(1024 * float(c)) + 100000 for c in v]


def whitened(vectors, k=8):
    """Exact sums and deviations, and the eigenvectors of the covariance."""
    x = [whole(v) for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    y = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    _, sv, right = np.linalg.svd(y, full_matrices=False)
    e = sv**2 / n
    return n, dev, y @ right[:k].T / np.sqrt(e[:k]), e[:k] / e.sum()


def check(rows, vectors, k=8):
    n, dev, white, share = whitened(list(vectors.values()), k)
    got = {(r.id, r.component): r for r in rows}
    assert len(got) == len(rows) == n * k
    for c in range(k):
        mine = np.array([got[i, c + 1].whitened for i in vectors])
        assert np.abs(mine * np.sign(mine @ white[:, c]) - white[:, c]).max() < 1e-8
        assert abs(got[next(iter(vectors)), c + 1].explained / share[c] - 1) < 1e-10
    assert all(r.n == n and r.identity_error < 1e-10 for r in rows)
    assert all(int(got[i, 1].deviation) == d for i, d in zip(vectors, dev))


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 12)) @ np.diag(10.0 ** -np.linspace(0, 1.5, 12)) @ rng.normal(size=(12, 12))
    vectors = {i: list(map(float, v)) for i, v in enumerate(x)}
    odd = [(900, None), (901, [float("nan")] * 12), (902, [None] + [1.0] * 11), (903, [float("inf")] * 12), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "a") for i, v in [*vectors.items(), *odd]], "vec_id long, embedding array<double>, n int, vector string").repartition(5)
    rows = whitening.whitened(df).collect()
    check([r for r in rows if r.id < 900], vectors)
    lone = [r for r in rows if r.id >= 900]
    assert [(r.id, r.component, r.n, r.whitened, r.explained) for r in lone] == [(905, 1, 1, None, None), (905, 2, 1, None, None)]


def test_whitening_of_badly_conditioned_vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(400, 6)) * [3e8, 1e5, 1e3, 10, 1, 0.05]
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    vectors = {i: list(map(float, v)) for i, v in enumerate(base @ q)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(4)
    rows = whitening.whitened(df).collect()
    assert max(r.identity_error for r in rows) < 1e-4 and len(rows) == 2400
    e = np.linalg.svd(np.array([[c - s / 400 for c, s in zip(v, map(sum, zip(*map(whole, vectors.values()))))] for v in map(whole, vectors.values())]), compute_uv=False) ** 2
    got = [next(r.explained for r in rows if r.component == c + 1) for c in range(6)]
    assert np.abs(np.array(got[:4]) / (e / e.sum())[:4] - 1).max() < 1e-4


def test_whitening_of_dependent_equal_single_and_repeated_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    x = np.concatenate([x, x[:, :1], np.ones((300, 1))], axis=1)
    df = spark.createDataFrame([(i // 2 if i % 7 else None, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    rows = whitening.whitened(df).collect()
    assert len(rows) == 1500 and all((r.whitened is None) == (r.component > 3) for r in rows) and max(r.identity_error for r in rows) < 1e-10
    flat = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert all(r.whitened is None and r.deviation == 0 and r.n == 9 for r in whitening.whitened(flat).collect())
    assert whitening.whitened(flat.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert whitening.whitened(huge).count() == 6


@needs_tables
def test_whitening_query_on_the_table(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    df = queries.op13_cholesky_whitening(spark, SF)
    assert dict(df.dtypes)["deviation"] == "bigint"
    check(df.withColumnRenamed("vec_id", "id").collect(), vectors)


def test_query_columns(spark):
    if os.path.isdir(SF):
        want = {"op11_order_minhash": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op12_bit_sliced_resampling": "doc_id n_features weight score rank", "op13_cholesky_whitening": "vec_id component n deviation whitened explained identity_error"}
        assert all(queries.QUERIES[k](spark, SF).columns == v.split() for k, v in want.items())
        assert all(t == "bigint" for _, t in queries.op12_bit_sliced_resampling(spark, SF).dtypes)


def test_words_are_those_of_the_pattern():
    rng = random.Random(9)
    alphabet = "aZz09 /:@[`{\x7f\x80éß日🙂\x00\n"
    for _ in range(300):
        text = "".join(rng.choices(alphabet, k=rng.randrange(60)))
        assert [w.decode() for piece in resample.pieces_of_words(text, piece=rng.randrange(1, 30)) for w in piece] == words_of(text)


def test_fingerprints_do_not_depend_on_the_layout(spark):
    rng = random.Random(10)
    df = spark.createDataFrame([(i, prose(rng, 60)) for i in range(40)], "doc_id long, text string")
    one, two = ({r.id: tuple(r.edited_fingerprint) for r in order_minhash.edited_pairs(x).collect()} for x in (df.coalesce(1), df.repartition(7, F.col("text"))))
    assert one == two
