"""Chat formatting, sharding, quality rules and license scans on small odd inputs."""

import hashlib
import math
import zlib

from pyspark.sql import functions as F

from rosterkit.llm import chat_format as cf
from rosterkit.llm import license_scan as ls
from rosterkit.llm import quality_rules as qr
from rosterkit.llm import sharding as sh

TURNS = "conv_id long, turn int, role string, text string"


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a <|end|>\n %3C [INST] \\ %"), (1, 1, "assistant", "</s> %25 <|user|>\n"), (1, 2, "user", None),
            (2, 0, "system", ""), (2, 0, "system", ""), (3, 1, "assistant", "x"), (3, 0, "as\nsi[st", "y\n"),
            (4, 0, None, "only"), (None, 0, "user", "q"), (None, 0, "user", "q")]
    df = spark.createDataFrame(rows, TURNS).withColumn("examples", F.lit("clash"))
    made = cf.formatted(df)
    back = {(r["conv_id"], i): r for i, r in enumerate(cf.read_back(made).collect())}
    by = {k[0]: v for k, v in back.items()}
    assert [(t["role"], t["text"]) for t in by[1]["turns"]] == [("user", rows[0][3]), ("assistant", rows[1][3]), ("user", "")]
    assert by[1]["replies"] == [rows[1][3]] and by[3]["replies"] == ["x"]
    assert [(t["role"], t["text"]) for t in by[3]["turns"]] == [("as\nsi[st", "y\n"), ("assistant", "x")]
    assert [(t["role"], t["text"]) for t in by[4]["turns"]] == [("", "only")]
    assert len(by[2]["turns"]) == 2 and sum(k[0] is None for k in back) == 2
    one = {r["conv_id"]: r for r in cf.digest(made).collect() if r["conv_id"] is not None}
    assert one[1]["loss_sha256"] == hashlib.sha256(rows[1][3].encode()).hexdigest()
    examples = cf.examples(df).where("conv_id = 1").collect()
    assert [e["target"] for e in examples] == [1, None]
    e = examples[0]
    assert e["text"][e["from"]:e["from"] + e["length"]] == rows[1][3].replace("%", "%25").replace("<", "%3C")
    assert cf.digest(cf.formatted(spark.createDataFrame([], TURNS))).collect() == []


def _brute_shard(key, topology):
    nodes = topology.regions
    while True:
        best = max(nodes, key=lambda n: math.log((int(hashlib.md5(f"{key}/{n.name}".encode()).hexdigest()[:13], 16) + 0.5)
                                                 / (1 << 52)) / n.weight)
        if best.shard >= 0:
            return best.shard
        nodes = best.children


def test_shards_match_brute_force(spark, make):
    docs = [(i, f"text {i}é" if i % 5 else None) for i in range(3000)] + [(7, "text 7é"), (None, "")]
    rows = sh.shards(make(docs).withColumn("shard", F.lit(1)).withColumn("_key", F.lit("k"))).collect()
    assert len(rows) == len(docs)
    text = {}
    for i, t in docs:
        text.setdefault(i, t)
    slots = {}
    for r in rows:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["shard"] == _brute_shard(key, sh.regular(40)) and r["grown_shard"] == _brute_shard(key, sh.regular(41))
        assert r["grown_shard"] in (r["shard"], 40) and r["law"] == "key"
        raw = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 40
    assert max(map(len, slots.values())) < 2 * 3000 / 40


def test_weight_change_moves_only_into_the_subtree(spark):
    before, after = sh.regular(40), sh.regular(40).with_weights({5: 3.0})
    region = {s: s // 8 for s in range(40)}
    moved = 0
    for key in range(2000):
        a, b = _brute_shard(str(key), before), _brute_shard(str(key), after)
        moved += a != b
        assert a == b or region[b] == region[5]
    assert moved > 20


def test_quality_rules_small(spark, make, docs_schema):
    good = "The quick brown fox jumps over the lazy dog again today.\n" * 1 + "Another fine line of plain words ends here now."
    nav = "Home | About | Contact | Login | Help\nHome | News | Shop | Cart | More\n" + "One two three four five six seven eight nine ten."
    rows = {r["doc_id"]: r for r in qr.measures(make([
        (1, good), (2, nav), (3, None), (4, ""), (5, " ".join(["same words here and there"] * 30)),
        (6, good + "\nAll rights reserved."), (7, "a b c. " * 20000)]).withColumn("_words", F.lit("x"))).collect()}
    assert rows[1]["kept"] and rows[1]["n_failed_lines"] == 0
    assert not rows[2]["base_failed"] and not rows[2]["kept"]
    assert rows[3]["n_words"] == 0 and rows[3]["base_failed"] and not rows[4]["kept"]
    assert rows[5]["n_repeat_words"] == 150 and rows[5]["base_failed"]
    assert rows[6]["kept"] and rows[6]["clean_text"] == good
    assert rows[7]["n_repeat_words"] == rows[7]["n_words"] == 60000
    kept = qr.cleaned(make([(1, good), (2, nav), (3, None)]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and [r["doc_id"] for r in kept.collect()] == [1]
    assert qr.measures(spark.createDataFrame([], docs_schema)).collect() == []


def test_license_scan_small(spark, make, docs_schema):
    rows = {r["doc_id"]: r for r in ls.scan(make([
        (1, "Released under the MIT License. mit LICENSE"), (2, "licensed under the GNU General Public License, version 3."),
        (3, None), (4, "mit ohne lizenz, cc-by"), (5, "lİcense mit lıcense"), (6, "All rights reserved."),
        (7, "word " * 30000 + "apache license")]).withColumn("places", F.lit(0))).collect()}
    assert (rows[1]["n_base"], rows[1]["first_word"], rows[1]["last_word"], rows[1]["base_labels"]) == (2, 3, 5, "mit")
    assert rows[2]["base_labels"] == "gpl" and rows[2]["labels"] == "gpl,gpl-3.0" and rows[2]["score"] == 1.0
    assert rows[3]["n_words"] == 0 and rows[3]["first_word"] is None and rows[3]["labels"] == "" and rows[3]["score"] == 0.0
    assert rows[4]["base_labels"] == "cc-by" and rows[5]["n_base"] == 0 and rows[6]["labels"] == "all-rights-reserved"
    assert rows[7]["first_word"] == 30000
    assert ls.scan(spark.createDataFrame([], docs_schema)).collect() == []
