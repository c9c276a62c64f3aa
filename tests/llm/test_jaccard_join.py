"""The shingle join against all pairs in plain Python, and against SQL."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from tonelake.llm import components as graph
from tonelake.llm import jaccard_join as jj
from tonelake.llm.shingles import Shingler, set_hash

SCHEMA = "capture_id long, message_utf8 string, n string, node string"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute(rows, percent=80):
    sets = [shingle_set(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    low = {}
    for k, (key, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), key), key)
    return sorted((key, len(sets[k]), low[find(k)]) for k, (key, _) in enumerate(rows))


def run(spark, rows):
    table = spark.createDataFrame([(k, t, "clash", "clash") for k, t in rows], SCHEMA)
    return sorted(tuple(r) for r in jj.near_duplicates(table).collect())


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "É", "naïve"]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = [None, "", " \t\n", "one", "ONE", "one two three four", "one two  three\nfour", "a b c d e", "a b c d f"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 63, 64, 65, 120, 300]))]
        if rng.random() < 0.5:
            base[3:3] = passage
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            cut = rng.choice([0, 0, len(copy) // 10, len(copy) // 6])
            texts.append(" ".join(copy[cut:]))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed, monkeypatch):
    if seed == 2:  # every shingle that occurs twice counts as widely shared, tiles are salted
        monkeypatch.setattr(jj, "COUNT_LEAST", 1)
        monkeypatch.setattr(jj, "TILE_MEMBERS", 1)
    if seed == 3:  # blocks of two members on average, strips of one
        monkeypatch.setattr(jj, "BLOCK_MEMBERS", 2)
        monkeypatch.setattr(jj, "STRIP", 1)
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    text = "the same words again and again in this text"
    assert run(spark, [(7, text), (7, text), (3, text.upper())]) == [(3, 5, 3), (7, 5, 3), (7, 5, 3)]
    table = spark.createDataFrame([(None, text, "", ""), (4, text, "", "")], SCHEMA)
    assert {tuple(r) for r in jj.near_duplicates(table).collect()} == {(None, 5, 4), (4, 5, 4)}


def test_near_copies_across_sizes_keep_one_component(spark):
    rng = random.Random(5)
    base = [f"b{rng.randrange(10**6)}" for _ in range(600)]
    rows = [(k, " ".join(base[: 380 + 3 * k])) for k in range(70)]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert jj.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text_and_hashes_agree_with_sets():
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(10**9)}" for _ in range(400_000))
    sets = Shingler().sets(["x y z", long, None, long + " tail"])
    assert [len(s) for s in sets] == [1, len(shingle_set(long)), 0, len(shingle_set(long + " tail"))]
    assert len(np.intersect1d(sets[1], sets[3])) == len(sets[1])
    assert set_hash(sets[1]) != set_hash(sets[3])


def test_slices_of_long_texts_leave_no_trace(monkeypatch):
    rng = random.Random(4)
    text = " ".join(f"W{rng.randrange(300)}" for _ in range(3000)) + " end"
    texts = [text, "a b", "x" * 500, "one two three four " * 40, " " * 400 + "a b c", " " * 900]
    whole, grams = Shingler().sets(texts), Shingler().sequences(texts, (1, 2, 3))
    monkeypatch.setattr("tonelake.llm.shingles.CHUNK_BYTES", 100)
    for a, b in zip(Shingler().sets(texts), whole, strict=True):
        assert a.tolist() == b.tolist()
    for a, b in zip(Shingler().sequences(texts, (1, 2, 3)), grams, strict=True):
        assert [x.tolist() for x in a] == [y.tolist() for y in b]


def near_copies(count, edits, seed=6):
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(count):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randint(*edits)):
            words[at] = f"e{k}x{at}"
        rows.append((k, " ".join(words)))
    return rows


def test_copies_around_the_limit(spark):
    rows = near_copies(120, (2, 9))
    assert run(spark, rows) == brute(rows)


def test_a_group_of_copies_makes_no_rows_of_pairs(spark):
    """Links out of a cluster are fewer than its members, whatever the number of pairs that link or nearly do."""
    for count in (60, 120):
        rows = near_copies(count, (3, 8))
        table = spark.createDataFrame([(k, t, "", "") for k, t in rows], SCHEMA)
        sets = Shingler().sets([t for _, t in rows])
        nodes = [(set_hash(s), len(s), set_hash(s), bytearray(jj.bitmap(s)), s.view(np.int64).tolist()) for s in sets]
        nodes = spark.createDataFrame(nodes, "node long, n long, component long, bits binary, shingles array<long>")
        from pyspark.sql import functions as F

        clusters = nodes.drop("shingles").select(F.lit(1).cast("long").alias("leader"), F.lit(False).alias("lead"), "*")
        links = jj._links_within(clusters, nodes.select("node", "shingles"), 80, True).collect()
        assert len(links) < count
        assert jj._may_link(clusters, 80).count() <= count
        roots = {set_hash(s): set_hash(s) for s in sets}
        for a, b in links:
            low, high = sorted((roots[a], roots[b]))
            roots = {k: low if v == high else v for k, v in roots.items()}
        want = {}
        for key, _, component in brute(rows):
            want.setdefault(component, set()).add(set_hash(sets[key]))
        got = {}
        for node, root in roots.items():
            got.setdefault(root, set()).add(node)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_bitmaps_never_bound_too_low():
    rng = random.Random(3)
    shingler = Shingler()
    for _ in range(200):
        words = [str(rng.randrange(500)) for _ in range(rng.randrange(5, 400))]
        other = words[rng.randrange(len(words) // 2 + 1) :] + [str(rng.randrange(500)) for _ in range(rng.randrange(300))]
        a, b = shingler.sets([" ".join(words), " ".join(other)])
        exact = len(np.intersect1d(a, b))
        assert exact <= jj.overlap_bound(len(a), jj.bitmap(a), len(b), jj.bitmap(b))
        assert jj.overlap_bound(len(a), jj.bitmap(a), len(a), jj.bitmap(a)) == len(a)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}


def test_query_against_sql(check_sql):
    check_sql("op3_jaccard_join")
