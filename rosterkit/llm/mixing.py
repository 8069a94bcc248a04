"""Mixing sources to target weights by Pfair scheduling.

The rows of each source are cut in blocks.  Slots are given out one block
at a time: with target share w, block k of a source (from 0) is released at
slot floor(k / w) and due by slot ceil((k + 1) / w), and each slot goes to the
released block with the earliest deadline (ties: the heavier source, then
its name).  Every deadline is met, so after any number of slots a source
has had its share to within less than one block.

Target weights are integers that sum to ``resolution`` (largest remainders,
at least 1 each), so the order repeats after that many slots and one period
is all that is ever computed: block k takes the slot of block k modulo the
weight in the period, plus the periods before.  When a source runs out, the
order starts anew with the weights of the others (a phase); there are at
most as many phases as sources.  No row is dropped or repeated.

The driver holds per-source row counts and the periods: at most sources
times resolution numbers, which the check of ``MAX_SOURCES`` keeps to some
megabytes, also when they are broadcast.  Rows are numbered inside hash
buckets, so a source with a third of all rows is numbered by many tasks.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sharding import BUCKET_DIGITS, numbered

BLOCK_ROWS = 16
RESOLUTION = 1000
MAX_SOURCES = 200


def integer_weights(weights: dict[str, float], resolution: int) -> dict[str, int]:
    """Integers proportional to the weights, summing to ``resolution``, at least 1 each."""
    names = sorted(weights)
    total = sum(weights.values())
    spare = resolution - len(names)
    exact = {s: spare * weights[s] / total for s in names}
    out = {s: 1 + int(exact[s]) for s in names}
    rest = sorted(names, key=lambda s: (int(exact[s]) - exact[s], s))
    for s in rest[:resolution - sum(out.values())]:
        out[s] += 1
    return out


def period(weights: dict[str, int]) -> dict[str, list[int]]:
    """Slot of each block of each source in one period of sum(weights) slots (earliest deadline first)."""
    total = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in weights}
    waiting = [(0, s) for s in sorted(weights)]  # (release, source)
    ready: list[tuple[int, int, str]] = []  # (deadline, -weight, source)
    heapq.heapify(waiting)
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            s = heapq.heappop(waiting)[1]
            k = len(slots[s])
            heapq.heappush(ready, (-(-(k + 1) * total // weights[s]), -weights[s], s))
        s = heapq.heappop(ready)[2]
        slots[s].append(slot)
        k = len(slots[s])
        if k < weights[s]:
            heapq.heappush(waiting, (k * total // weights[s], s))
    return slots


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[tuple[int, int, dict[str, int], dict[str, list[int]]]]:
    """(first slot, period length, first block of each source, period slots) until every block is placed."""
    left, done, start, out = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, []
    while left:
        active = {s: weights[s] for s in left}
        length, slots = sum(active.values()), period(active)

        def slot_of(s: str, k: int) -> int:
            return k // active[s] * length + slots[s][k % active[s]]

        end = min(slot_of(s, n - 1) for s, n in left.items()) + 1
        out.append((start, length, {s: done[s] for s in left}, slots))
        for s in list(left):
            whole, rest = divmod(end, length)
            given = min(left[s], whole * active[s] + sum(x < rest for x in slots[s]))
            done[s] += given
            left[s] -= given
            if not left[s]:
                del left[s]
        start += end
    return out


def _source(col: str) -> Column:
    """The source as a key; a null source is one of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(col).cast("string")), F.lit("n"))


def mixed(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id",
          weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS,
          resolution: int = RESOLUTION) -> DataFrame:
    """``docs`` with ``mix_block``, ``mix_slot`` and ``mix_row`` (columns of these names are replaced).

    ``mix_block`` is the row's block within its source, ``mix_slot`` the
    block's place in the order and ``mix_row`` the row's place in the
    block.  Rows of a source are taken in hash order of id.  Without
    ``weights`` the targets are the square roots of the sources' rows;
    sources that ``weights`` does not name get the least weight named.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("mix_block", "mix_slot", "mix_row")]
    df = docs.select(*names).toDF(*[f"_c{i}" for i in range(len(names))])
    source, key = f"_c{names.index(source_col)}", f"_c{names.index(id_col)}"
    hashed = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    df = df.withColumns({"_s": _source(source), "_bucket": F.substring(hashed, 1, BUCKET_DIGITS),
                         "_row": F.xxhash64(*[F.col(f"_c{i}") for i in range(len(names))])})
    rows = df.groupBy("_s").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    count = {r["_s"]: r["n"] for r in rows}
    if weights is None:
        target = {s: n ** 0.5 for s, n in count.items()}
    else:
        named = {"n" if s is None else f"s{s}": w for s, w in weights.items()}
        target = {s: named.get(s, min(named.values())) for s in count}
    plan = phases({s: -(-n // block_rows) for s, n in count.items()},
                  integer_weights(target, max(resolution, 2 * len(count)))) if count else []
    ends = [{s: plan[p + 1][2].get(s, 1 << 62) if p + 1 < len(plan) else 1 << 62 for s in plan[p][2]}
            for p in range(len(plan))]
    steps = [(s, p, first, ends[p][s], start, length, len(slots[s]))
             for p, (start, length, begin, slots) in enumerate(plan) for s, first in begin.items()]
    places = [(p, s, k, slot) for p, (_, _, _, slots) in enumerate(plan)
              for s, own in slots.items() for k, slot in enumerate(own)]
    steps_df = spark.createDataFrame(steps, "_s string, _p int, _first long, _until long, _start long, _length long, _w long")
    places_df = spark.createDataFrame(places, "_p int, _s string, _k long, _slot long")

    df = numbered(df, "_s", "_bucket", [key, "_row"], "_at")
    df = df.withColumns({"mix_block": F.floor(F.col("_at") / block_rows), "mix_row": F.pmod("_at", F.lit(block_rows))})
    df = df.join(F.broadcast(steps_df), "_s").where("_first <= mix_block and mix_block < _until") \
        .withColumn("_n", F.col("mix_block") - F.col("_first")).withColumn("_k", F.pmod("_n", "_w")) \
        .join(F.broadcast(places_df), ["_p", "_s", "_k"])
    slot = F.col("_start") + F.floor(F.col("_n") / F.col("_w")) * F.col("_length") + F.col("_slot")
    return df.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], "mix_block", slot.alias("mix_slot"),
                     "mix_row")


def ordered(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (its columns alone) as files in mixed order: ranges of slots, sorted inside."""
    names = [c for c in docs.columns if c not in ("mix_block", "mix_slot", "mix_row")]
    return mixed(docs, **options).repartitionByRange("mix_slot", "mix_row").sortWithinPartitions(
        "mix_slot", "mix_row").select(*names)
