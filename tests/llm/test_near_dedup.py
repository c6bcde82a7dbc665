"""The pipeline's near-dedup stage: what fingerprints link, what the exact way adds, what verification keeps apart."""

import random
import re

import pytest
import xxhash

import corpus_pipeline
from orbispan.llm import simhash

FEATURE, RADIUS = 2, 4


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    hs = [xxhash.xxh64(" ".join(words[i : i + FEATURE]).encode(), seed=42).intdigest() for i in range(len(words) - FEATURE + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def components(n, pairs):
    low = list(range(n))
    for a, b in pairs:
        low = [min(low[a], low[b]) if x in (low[a], low[b]) else x for x in low]
    return low


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(23)
    prose = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    out = []
    for _ in range(25):  # a word changed, a block appended
        w = prose(300)
        out += [w, w[:150] + ["changed"] + w[151:], w + prose(60)]
    hub = prose(400)
    out += [hub] + [hub[:i] + [f"edit{i}"] + hub[i + 1 :] for i in range(0, 400, 20)]
    out += [["x"] * 60 + prose(20) for _ in range(6)]  # equal fingerprints, other texts
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("cap", [1200, 5])
def test_fingerprints_link_and_the_exact_way_adds_the_rest(spark, texts, monkeypatch, cap):
    n = len(texts)
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    prints = [fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(n) for j in range(i)]
    alike = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    near = components(n, [(i, j) for i, j in pairs if (prints[i] ^ prints[j]).bit_count() <= RADIUS])
    whole, linked = components(n, alike), components(n, [(i, j) for i, j in alike if near[i] == near[j]])
    assert len(set(prints[-6:])) == 1 and whole[-6:] == list(range(n - 6, n)) and len(set(whole)) < len(set(linked)) < n - 10

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.id: r.component for r in simhash.near_duplicates(df, cap=cap).collect()} == dict(enumerate(whole))
    prefixes = simhash._prefixes
    monkeypatch.setattr(simhash, "_prefixes", lambda *args: prefixes(*args).limit(0))
    alone = [r.component for r in sorted(simhash.near_duplicates(df, cap=cap).collect())]
    if cap > n:
        assert alone == linked
    else:  # parts of a large group meet in its first text, the exact way is there for the others
        assert len(set(linked)) <= len(set(alone)) < n - 10 and all(near[i] == near[c] and whole[i] == whole[c] for i, c in enumerate(alone))


def test_stage_links_by_fingerprints(spark, texts, monkeypatch):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prefixes, kept = simhash._prefixes, [r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()]
    monkeypatch.setattr(simhash, "_prefixes", lambda *args: prefixes(*args).limit(0))
    by_prints = [r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()]
    assert set(kept) < set(by_prints) and len(by_prints) < len(texts)
