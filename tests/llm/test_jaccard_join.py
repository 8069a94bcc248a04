"""Jaccard join: components against brute force, the exact filters, hot lists, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from rosterkit.llm import jaccard_join as jj
from rosterkit.llm.scratch import Scratch
from test_near_dedup import brute


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """The join is many small jobs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def components(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def edited(rng, base, edits, vocabulary):
    text = list(base)
    for _ in range(edits):
        text[rng.randrange(len(text))] = rng.choice(vocabulary)
    return text


def test_families_match_brute_force(spark, make):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    pairs, n = [], 0
    for family in range(8):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 25, 70, 160, 400]))]
        for _ in range(14):
            pairs.append((n * 5 + 2, " ".join(edited(rng, base, rng.randint(0, 4), vocabulary)) + rng.choice(["", "\n", " "])))
            n += 1
    pairs += [(90000, None), (90001, ""), (90002, " \t\n"), (90003, "One TWO"), (90004, "one two"), (90005, "one"),
              (90006, "one two three"), (90007, "ONE two\tthree")]
    assert components(jj.linked(make(pairs))) == brute(pairs, 3, 90)


def test_hot_lists_match_brute_force(spark, make):
    """Texts that share nearly everything, in many components: same prefix, same size, one common passage."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(4000)]
    common = [rng.choice(vocabulary) for _ in range(90)]
    pairs = [(i, " ".join(edited(rng, common, rng.choice([0, 1, 2, 3, 5, 9]), vocabulary))) for i in range(160)]
    pairs += [(200 + i, " ".join([*common[:30], *[rng.choice(vocabulary) for _ in range(10)]])) for i in range(60)]
    pairs += [(300 + i, "the same line again . " * (i % 9 + 1)) for i in range(60)]
    assert components(jj.linked(make(pairs))) == brute(pairs, 3, 90)


def test_other_thresholds(spark, make):
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    pairs = [(i, " ".join(edited(rng, base, rng.randint(0, 12), vocabulary))) for i in range(50)]
    for words, percent in ((1, 60), (4, 100)):
        assert components(jj.linked(make(pairs), words=words, percent=percent)) == brute(pairs, words, percent)


def test_prefix_is_long_enough():
    for percent in (50, 90, 100):
        for size in range(1, 300):
            need = -(-percent * size // 100)
            assert jj.prefix_length(np.array([size]), percent)[0] == size - need + 1


def test_sets_and_counts():
    row, value = jj.shingle_sets(pa.array(["a b c a b c", "x", "x y", "X y", None, ""]), 3)
    assert np.bincount(row, minlength=6).tolist() == [3, 1, 1, 1, 0, 0]
    assert value[row == 2] == value[row == 3] and value[row == 1] != value[row == 2]


def test_odd_rows(spark, make):
    assert jj.linked(make([])).collect() == []
    long = " ".join(f"t{i % 7000}" for i in range(200000))
    texts = [(None, "one two three four"), (5, "one two three four"), (5, "one two three four"), (6, "one two three four"),
             (7, long), (8, long + " end"), (9, None), (9, "")]
    docs = make(texts).withColumnRenamed("lang", "size").withColumnRenamed("source", "token")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.linked(docs).collect()), key=str)
    assert got == sorted([(None, 2, None), (5, 2, 5), (5, 2, 5), (6, 2, 5), (7, 7000, 7), (8, 7001, 7), (9, 0, 9), (9, 0, 9)],
                         key=str)


def test_lists_carry_folded_bitmaps(spark, make):
    """Rows of the last join hold a quarter of the bits, and these are parities of fewer bits of the hash."""
    columns = {}

    class Seen(Scratch):
        def keep(self, df, name):
            columns[name] = df.columns
            return super().keep(df, name)

    rng = random.Random(9)
    words = [rng.choice([f"w{i}" for i in range(50)]) for _ in range(120)]
    texts = make([" ".join(words), " ".join(words[:-1] + ["z"]), "a b c d"])
    assert components(jj.linked(texts, scratch=Seen(spark, "seen")))[1][1] == 0
    assert [c for c in columns["rest"] if c in jj.LONGS] == jj.FOLDED and len(jj.FOLDED) * 64 * 4 == jj.BITS

    value = np.array([rng.randrange(2**63) for _ in range(400)], np.uint64)
    whole, less = (np.bincount((value & np.uint64(n - 1)).astype(int), minlength=n).astype(np.uint8) & 1
                   for n in (jj.BITS, jj.BITS // 4))
    row = spark.createDataFrame([[int(x) for x in np.packbits(whole).view(np.int64)]], jj.LONGS).select(*jj._folded()).first()
    assert list(row) == np.packbits(less).view(np.int64).tolist()
