"""MinHash near-dedup: sketch properties, brute-force components, odd rows."""

import collections
import random
import re

import numpy as np

from rosterkit.llm import near_dedup as nd


def _low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(pairs, words=5, percent=75):
    sets = {}
    for i, text in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", _low(text))
        sets[i] = {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_sketch_is_full_and_estimates():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 200, 200))
    rows = [np.sort(np.r_[common, a]), np.sort(np.r_[common, b]), np.sort(common[:1])]
    row = np.repeat([0, 1, 2], [len(r) for r in rows])
    table = nd.sketch(row, np.concatenate(rows), 3, nd.BINS)
    assert (table != np.iinfo(np.uint64).max).all()
    assert abs((table[0] == table[1]).mean() - 0.6) < 0.07


def test_families_match_brute_force(spark, make):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    pairs, n = [], 0
    for family in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 80, 150]))]
        for _ in range(14):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            pairs.append((n * 7 + 3, " ".join(text) + rng.choice(["", "\n", "  "])))
            n += 1
    pairs += [(100000, None), (100001, ""), (100002, " \t\n"), (100003, "One TWO three"), (100004, "one two\tthree")]
    got = {r["doc_id"]: r for r in nd.near_duplicates(make(pairs)).collect()}
    want = brute(pairs)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_odd_rows(spark, make):
    long = " ".join(f"t{i}" for i in range(30000))
    df = make([(1, long), (2, long + " end"), (3, None), (None, "some text here"), (5, "x y"), (5, "x y")])
    for c in ("_id", "_text", "band", "rep", "component_id"):
        df = df.withColumn(c, df["lang"])
    rows = [(r["doc_id"], r["component_id"], r["kept"]) for r in nd.near_duplicates(df).collect()]
    assert sorted(rows, key=str) == sorted([(1, 1, True), (2, 1, False), (3, 3, True), (None, None, True), (5, 5, True), (5, 5, True)], key=str)
    one = nd.deduplicated(df)
    assert one.columns == df.columns
    assert collections.Counter(r["doc_id"] for r in one.collect()) == {1: 1, 3: 1, None: 1, 5: 1}


def test_empty_table(spark, make, docs_schema):
    assert nd.near_duplicates(spark.createDataFrame([], docs_schema)).collect() == []
