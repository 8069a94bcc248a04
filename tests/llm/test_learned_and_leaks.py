"""Classifiers (held-out accuracy), decontamination (brute force) and mixing (schedule laws)."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from rosterkit.llm import decontaminate as dc
from rosterkit.llm import mixing as mx
from rosterkit.llm import quality_classifier as qc
from rosterkit.llm import subword
from rosterkit.llm import toxicity as tx
from rosterkit.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def _auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("key,label,least", [("op3_quality_classifier", "quality", 0.95), ("op6_toxicity", "toxic", 0.8)])
def test_held_out_ranking(spark, key, label, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    rows = QUERIES[key](spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = rows.where("held_out").join(labels, "doc_id").select("score", label, "predicted").collect()
    assert _auc([(r["score"], r[label]) for r in held]) >= least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in held)


@pytest.mark.parametrize("module,label", [(qc, "quality"), (tx, "toxic")])
def test_without_labels(spark, make, module, label, docs_schema):
    none = spark.createDataFrame([(1, None), (None, 1)], f"doc_id long, {label} int")
    rows = module.scores(make([(1, "a b"), (2, None), (3, ""), (None, "x")]).withColumn("score", F.lit(9)), none).collect()
    assert len(rows) == 4 and all(r["score"] == 0.5 and r["predicted"] == 0 for r in rows)
    assert module.scores(spark.createDataFrame([], docs_schema), none).collect() == []


def test_toxicity_recall_at_the_threshold(spark):
    """sf0.1 has some 300 positives to learn from; 4 % of its toxic texts hold no marked word at all."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    held = QUERIES["op6_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    toxic = [r["predicted"] for r in held if r["toxic"] == 1]
    clean = [r["predicted"] for r in held if r["toxic"] == 0]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_cut_takes_the_most_recall_for_its_share():
    rng = np.random.default_rng(4)
    for _ in range(20):
        pos, unl = rng.normal(2, 1, 40).round(2), rng.normal(0, 1, 300).round(2)

        def worth(t):
            return (pos >= t).mean() ** 2 / ((unl >= t).sum() + 1)

        assert worth(tx.cut(pos, unl)) == pytest.approx(max(worth(t) for t in pos))


@pytest.mark.parametrize("module,label", [(qc, "quality"), (tx, "toxic")])
def test_scores_are_the_logistic_of_the_features(spark, make, module, label):
    """Every row of the table, repeated and odd ones too, is scored by the fitted weights alone."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=30)) + " bad foul" * (i % 2)) for i in range(60)]
    docs += [docs[0], (100, None), (101, ""), (None, "w1"), (102, "w2 foul " * 100_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (None, 1)], f"doc_id long, {label} int")
    table = make(docs).withColumn("score", F.lit(9)).withColumn("held_out", F.lit("x"))
    rows = module.scores(table, labels).collect()
    assert len(rows) == len(docs)
    known = {(i, y) for i, y in [(i, i % 2) for i in range(60)] + [(1, 0)]
             if zlib.crc32(str(i).encode()) % (4 if module is qc else 3) != (2 if module is qc else 1)}
    text = dict(docs[:60])
    if module is tx:
        known = {(i, 1) for i, y in known if y} | {(i, 0) for i, _ in docs if i is not None}
        text |= {100: None, 101: "", 102: docs[-1][1]}
    known = sorted(known)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in known], pa.int64()), pa.array([y for _, y in known], pa.int32()),
         pa.array([text[i] for i, _ in known], pa.string())], names=["_id", "_label", "_text"])
    batch = pa.concat_batches([batch, batch.filter(pc.equal(batch["_id"], 0))])  # a repeated row stands twice
    if module is tx:
        trained_on = [(i, y) for i, y in [(i, i % 2) for i in range(60)] + [(1, 0)] if zlib.crc32(str(i).encode()) % 3 != 1]
        prior = sum(y for _, y in trained_on) / len(trained_on)
        weights, bias = tx.fit(subword.Bags(list(subword.counted(tx.features, tx.BITS)([batch])), tx.POWER), prior)
    else:
        weights, bias = qc.fit(subword.Bags(list(subword.counted(qc.features, qc.BITS)([batch]))))
    for r in rows:
        at = next(t for i, t in docs if i == r["doc_id"])
        _, value = module.features(pa.array([at], pa.string()))
        bucket = (value >> np.uint64(64 - module.BITS)).astype(np.int64)
        power = tx.POWER if module is tx else 1.0
        z = weights.astype(float)[bucket].sum() / max(1, len(bucket)) ** power + bias
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-6), r["doc_id"]


def test_least_hashed_is_the_head_of_the_hash_order(spark):
    ids = spark.range(40_000).select(F.col("id").alias("_id")).union(spark.range(500).select("id"))
    got = [r["_id"] for r in subword.least_hashed(ids, 300).collect()]
    want = [r["_id"] for r in spark.range(40_000).select(F.col("id").alias("_id")).orderBy(F.xxhash64("_id")).limit(300).collect()]
    assert got == want


def _brute(words, items, window):
    hit, named = set(), set()
    for name, item in items:
        grams = [item] if 0 < len(item) < window else [item[i:i + window] for i in range(len(item) - window + 1)]
        for g in grams:
            for p in range(len(words) - len(g) + 1 if g else 0):
                if words[p:p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
                    named.add(name)
    return len(hit), sorted(named)


@pytest.mark.parametrize("block_words", [10**6, 12])
def test_decontamination_matches_brute_force(spark, make, block_words):
    rng = random.Random(8)
    items = [(str(i), [rng.choice("abcd") for _ in range(rng.choice([0, 2, 3, 6, 14]))]) for i in range(8)]
    docs = [(i, [rng.choice("abcd") for _ in range(rng.choice([0, 1, 5, 60]))]) for i in range(40)]
    table = spark.createDataFrame([(int(n), " ".join(w).upper()) for n, w in items] + [(99, None)], "item_id int, text string")
    got = {r["doc_id"]: r for r in dc.scan(make([(i, ", ".join(w)) for i, w in docs] + [(100, None)]), table, window=4,
                                           block_words=block_words).collect()}
    for i, words in docs:
        n, named = _brute(words, items, 4)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (len(words), n, named), i
        assert got[i]["n_hit"] == sum(s["b"] - s["a"] for s in got[i]["spans"])
    assert got[100]["n_words"] == 0 and got[100]["n_hit"] == 0


def test_item_blocks_keep_their_bounds(spark):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choices("abc", k=rng.choice([0, 1, 7, 19, 45])))) for i in range(200)]
    items += [items[3], (None, "a b"), (300, None), (301, "z" * 20 * dc.WORD_BYTES), (302, "z" * 99 * dc.WORD_BYTES)]
    table = spark.createDataFrame(items, "item_id int, text string").repartition(3)
    blocks = list(dc.item_blocks(table, "item_id", "text", 40))
    got = [(i, t) for names, texts in blocks for i, t in zip(names, texts, strict=True)]
    assert sorted(got) == sorted({(str(i), t) for i, t in items if i is not None and t})
    for _, texts in blocks:
        size = sum(max(len(t.split()), -(-len(t) // dc.WORD_BYTES)) for t in texts)
        assert len(texts) == 1 or size <= 40
    assert list(dc.item_blocks(table.where("false"), "item_id", "text", 40)) == [([], [])]


def test_decontamination_odd_rows(spark, make):
    """Repeated rows, a very long text and columns of the operator's own names."""
    leak = "one two three four five six seven eight nine ten"
    docs = make([(1, leak), (1, leak), (2, "w " * 300_000 + leak), (None, leak)]).withColumns(
        {"_spans": F.lit("x"), "items": F.lit(7), "n_hit": F.lit(None).cast("int")})
    items = spark.createDataFrame([(1, leak), (1, leak)], "item_id int, text string")
    rows = sorted(((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"]) for r in dc.scan(docs, items).collect()))
    assert rows == [(0, 10, 10, ["1"]), (1, 10, 10, ["1"]), (1, 10, 10, ["1"]), (2, 300_010, 10, ["1"])]
    left = dc.decontaminated(docs, items)
    assert left.columns == docs.columns
    assert [(r["doc_id"], r["_spans"], r["items"], len(r["text"])) for r in left.collect()] == [(2, "x", 7, 600_000)]


def test_decontaminated_rows(spark, make, docs_schema):
    leak = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(1, leak)], "item_id int, text string")
    clean = " ".join(f"w{i}" for i in range(40))
    out = dc.decontaminated(make([(1, clean), (2, f"{clean} {leak.upper()}, {clean}"), (3, leak), (4, None)]), items)
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert rows == {1: clean, 2: f"{clean} , {clean}", 4: None}
    assert dc.scan(spark.createDataFrame([], docs_schema), items).collect() == []
    assert dc.scan(make([(1, "a")]), items.where("false")).collect()[0]["n_hit"] == 0


def test_mixing_laws(spark, make, docs_schema):
    docs = make([(i, "t") for i in range(900)]).withColumn("source", F.expr(
        "case when doc_id % 10 < 5 then 'a' when doc_id % 10 < 8 then 'b' when doc_id % 10 = 8 then 'c' end"))
    rows = mx.mixed(docs, weights={"a": 2, "b": 2, "c": 1, None: 1}, block_rows=10, resolution=60).collect()
    assert len(rows) == 900
    slots = {}
    for r in rows:
        slots.setdefault(r["mix_slot"], set()).add((r["source"], r["mix_block"]))
    assert sorted(slots) == list(range(90)) and all(len(s) == 1 for s in slots.values())
    share = mx.integer_weights({"sa": 2, "sb": 2, "sc": 1, "n": 1}, 60)
    seen = dict.fromkeys(share, 0)
    n = 0
    while max(seen["sc"], seen["n"]) < 9:  # the first phase: until one of the two with 9 blocks runs out
        seen["n" if (s := next(iter(slots[n]))[0]) is None else f"s{s}"] += 1
        n += 1
        assert all(abs(seen[k] - n * w / 60) < 1 for k, w in share.items())
    assert n > 45
    assert mx.mixed(spark.createDataFrame([], docs_schema)).collect() == []
    assert mx.ordered(docs).columns == docs.columns


def test_period_meets_every_window():
    rng = random.Random(1)
    for _ in range(30):
        weights = mx.integer_weights({f"s{i}": rng.random() ** 3 + 0.001 for i in range(rng.randint(1, 9))}, 97)
        slots = mx.period(weights)
        assert sorted(x for own in slots.values() for x in own) == list(range(97))
        for s, own in slots.items():
            assert all(k * 97 // weights[s] <= x < -(-(k + 1) * 97 // weights[s]) for k, x in enumerate(own))
