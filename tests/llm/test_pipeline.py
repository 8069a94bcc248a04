"""The pipeline against the stages' own brute-force rules, on the smallest driver tables."""

import collections

import corpus_pipeline as cp
from rosterkit.llm import mixing
from rosterkit.llm import near_dedup as nd
from rosterkit.llm.scratch import Scratch
from test_near_dedup import brute

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = cp.stage_quality_rules(spark, docs, SF).cache()
    assert rules.columns == docs.columns
    texts = [(r["doc_id"], r["text"]) for r in rules.collect()]
    want = {i for i, (_, c) in brute(texts).items() if i == c}
    one = cp.stage_near_dedup(spark, rules, SF).cache()
    assert {r["doc_id"] for r in one.collect()} == want and one.count() == len(want)
    rest = cp.stage_decontamination(spark, one, SF).cache()
    mix = cp.stage_mixing(spark, rest, SF)
    assert collections.Counter(r["doc_id"] for r in mix.collect()) == collections.Counter(r["doc_id"] for r in rest.collect())
    out = cp.stage_sharding(spark, mix, SF)
    rows = out.collect()
    assert out.columns == [*docs.columns, "shard", "slot"] and len(rows) == rest.count()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty(spark, docs_schema):
    df = spark.createDataFrame([], docs_schema)
    for _, stage in cp.STAGES:
        df = stage(spark, df, SF)
    assert df.collect() == []
    assert nd.PERCENT == 75 and len(cp.STAGES) == 5 and cp.ORACLE_SQL is None


def test_slots_follow_the_mix(spark, docs_schema):
    rows = [(i, f"text {i}", "en", "abc"[min(i % 7, 2)], 6) for i in range(6000)]
    docs = spark.createDataFrame(rows, docs_schema).repartition(5)
    path = Scratch(spark, "mix-test")
    docs = path.keep(cp.stage_mixing(spark, docs, SF), "mixing")
    mix = {r["doc_id"]: (r["mix_slot"], r["mix_row"]) for r in mixing.mixed(docs).collect()}
    out = cp.stage_sharding(spark, docs, SF)
    assert out.columns == [*docs.columns, "shard", "slot"]
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r["shard"]].append((r["slot"], mix[r["doc_id"]]))
    for own in got.values():
        own.sort()
        assert [s for s, _ in own] == list(range(len(own))) and [m for _, m in own] == sorted(m for _, m in own)
    # all shards merged by the order of their slots: while no source has run out each has its share within a block
    source = {r[0]: r[3] for r in rows}
    order = sorted(mix, key=mix.get)
    count = collections.Counter(source.values())
    weight = mixing.integer_weights({s: n ** 0.5 for s, n in count.items()}, mixing.RESOLUTION)
    seen, blocks = collections.Counter(), {s: -(-n // mixing.BLOCK_ROWS) for s, n in count.items()}
    last, slots = None, 0
    for i in order:
        if mix[i][0] != last:
            last, slots = mix[i][0], slots + 1
            seen[source[i]] += 1
            assert all(abs(seen[s] - slots * weight[s] / mixing.RESOLUTION) < 1 for s in weight)
            if any(seen[s] == blocks[s] for s in weight):
                break
    assert slots > 100
