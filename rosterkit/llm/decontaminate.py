"""Benchmark decontamination with a generalised suffix automaton.

The test items' words (lower-cased A-Z, ``[0-9a-z]`` and everything beyond
ASCII) are put in one suffix automaton per block of items.  A document's
words are streamed through it: the state always stands for the longest
suffix of what was read that occurs in some item, and its length is the
matching length.  Where the length reaches ``window`` the last ``window``
words are consecutive item words; the state that holds exactly that suffix
names the items.  An item shorter than the window matches as a whole.

Words that end no item run need not be streamed: runs of words whose
consecutive ``g``-grams all occur in the items (a bitmap, then a sorted
lookup, vectorised per batch) hold every possible match, and the automaton
sees only those runs.

The items go to the tasks in blocks of at most ``block_words`` words (a
larger item is a block alone); ``item_blocks`` checks each while it streams
the items table, and each is broadcast by itself.  Documents pass all blocks
in one stage, without a shuffle.  Each task builds a block's automaton once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .textops import ALNUM, Words, gram_hashes, row_slices

WINDOW = 10
MAX_COVERAGE = 0.5
BLOCK_WORDS = 50_000
#: bytes of item text that count as a word in the size of a block
WORD_BYTES = 64

_BITS = 20


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window state."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.length, self.link, self.next = [0], [-1], [{}]
        ends = []
        for name, words in items:
            last, path = 0, []
            for w in words:
                last = self._extend(last, w)
                path.append(last)
            ends.append((name, path))
        n = len(self.length)
        self.items: list[set | None] = [None] * n
        self.short: list[set | None] = [None] * n
        for name, path in ends:
            if 0 < len(path) < window:
                q = path[-1]
                self.short[q] = (self.short[q] or set()) | {name}
            for q in path[window - 1:]:
                while self.length[self.link[q]] >= window:
                    q = self.link[q]
                if self.items[q] is None:
                    self.items[q] = set()
                self.items[q].add(name)
        # nearest state at or above that ends a short item; 0 if none
        self.above = [0] * n
        for q in sorted(range(1, n), key=self.length.__getitem__):
            self.above[q] = q if self.short[q] else self.above[self.link[q]]

    def _extend(self, last: int, w: int) -> int:
        length, link, nxt = self.length, self.link, self.next
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, w)
        cur = self._state(length[last] + 1, 0, {})
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return cur

    def _state(self, length: int, link: int, nxt: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(nxt)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def stream(self, words: list[int], base: int, spans: list, found: set) -> None:
        """Add the matched ranges (from ``base``) and the items of one run of words."""
        length, link, nxt, window = self.length, self.link, self.next, self.window
        p = matched = 0
        for i, w in enumerate(words):
            while p and w not in nxt[p]:
                p = link[p]
                matched = length[p]
            p = nxt[p].get(w, 0)
            matched = matched + 1 if p else 0
            if matched >= window:
                q = p
                while length[link[q]] >= window:
                    q = link[q]
                spans.append((base + i + 1 - window, base + i + 1))
                found |= self.items[q]
            q = self.above[p]
            while q:
                if length[q] <= matched:
                    spans.append((base + i + 1 - length[q], base + i + 1))
                    found |= self.short[q]
                q = self.above[link[q]]


class Block:
    """One block of items as a task uses it: the automaton and the run filter."""

    def __init__(self, names: list[str], texts: list[str], window: int):
        w = Words(pa.array(texts, pa.string()), ALNUM, lower=True)
        h, sizes = w.hashes(), w.counts()
        self.words, ids = np.unique(h, return_inverse=True)
        self.automaton = Automaton(
            [(name, ids[w.first[r]:w.first[r + 1]].tolist()) for r, name in enumerate(names)], window)
        self.least = int(min(window, sizes[sizes > 0].min())) if (sizes > 0).any() else 0
        self.gram = min(self.least, 3)
        if self.least:
            grams = gram_hashes(h, self.gram)
            same = w.row[:len(grams)] == w.row[self.gram - 1:]
            self.grams = np.unique(grams[same])
            self.bitmap = np.zeros(1 << _BITS, bool)
            self.bitmap[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def matches(self, w: Words, h: np.ndarray) -> dict[int, tuple[list, set]]:
        """Row -> (word ranges within the row, item names)."""
        if not self.least or len(h) < self.least:
            return {}
        g = self.gram
        grams = gram_hashes(h, g)
        hit = self.bitmap[(grams >> np.uint64(64 - _BITS)).astype(np.int64)]
        at = np.flatnonzero(hit)
        at = at[self.grams[np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)] == grams[at]]
        at = at[w.row[at] == w.row[at + g - 1]]
        if not len(at):
            return {}
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(w.row[at]) != 0)) + 1
        out: dict[int, tuple[list, set]] = {}
        for run in np.split(at, cut):
            if len(run) < self.least - g + 1:
                continue
            first, last = int(run[0]), int(run[-1]) + g
            place = np.minimum(np.searchsorted(self.words, h[first:last]), len(self.words) - 1)
            ids = np.where(self.words[place] == h[first:last], place, -1).tolist()
            row = int(w.row[first])
            spans, names = out.setdefault(row, ([], set()))
            self.automaton.stream(ids, first - int(w.first[row]), spans, names)
        return {row: x for row, x in out.items() if x[0]}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_BLOCKS: dict = {}

_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _pass(block, window: int, text: str, last: bool):
    """One block over the documents: ``_n_words`` and the matched ranges and items so far.

    The last block also gives ``_clean``: the text without the matched
    ranges, null where nothing matched.
    """
    def run(batches):
        names, texts, key = block.value
        if key not in _BLOCKS:
            _BLOCKS.clear()
            _BLOCKS[key] = Block(names, texts, window)
        for whole in batches:
            for batch in row_slices(whole, text):
                w = Words(batch.column(text), ALNUM, lower=True)
                found = _BLOCKS[key].matches(w, w.hashes())
                spans, items = batch.column("_spans"), batch.column("_items")
                if found:
                    spans, items = spans.to_pylist(), items.to_pylist()
                    for row, (ranges, named) in found.items():
                        spans[row] = [{"a": a, "b": b} for a, b in merged(
                            [(x["a"], x["b"]) for x in spans[row]] + ranges)]
                        items[row] = sorted({*items[row], *named})
                    spans, items = pa.array(spans, _RANGES), pa.array(items, pa.list_(pa.string()))
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                columns |= {"_n_words": pa.array(w.counts().astype(np.int64)), "_spans": spans, "_items": items}
                if last:
                    columns["_clean"] = _clean(batch.column(text), spans)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return run


def _clean(texts: pa.Array, spans: pa.Array) -> pa.Array:
    rows = np.flatnonzero(pc.list_value_length(spans).to_numpy(zero_copy_only=False))
    clean: list[str | None] = [None] * len(texts)
    if len(rows):
        w = Words(texts.take(pa.array(rows)), ALNUM, lower=False)
        for k, (row, ranges) in enumerate(zip(rows, spans.take(pa.array(rows)).to_pylist(), strict=True)):
            at, first, parts = int(w.offsets[k]), int(w.first[k]), []
            for x in ranges:
                parts.append(w.data[at:w.start[first + x["a"]]].tobytes())
                at = int(w.end[first + x["b"] - 1])
            parts.append(w.data[at:int(w.offsets[k + 1])].tobytes())
            clean[row] = b"".join(parts).decode()
    return pa.array(clean, pa.string())


def item_blocks(items: DataFrame, item_id: str, item_text: str, block_words: int) -> Iterator[tuple[list, list]]:
    """The items (ids, texts) in blocks of at most ``block_words`` words and ``block_words * WORD_BYTES`` bytes.

    Only an item that is larger by itself makes a larger block, alone.  The
    items come to the driver a partition at a time, and a partition is about
    a block, so the driver holds some blocks' worth of items, however many
    there are.  Items without words or id are left out, repeated rows are one;
    there is one block at least.
    """
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).withColumn(
        "n", F.expr("regexp_count(t, '[^\\\\x00-\\\\x2F\\\\x3A-\\\\x40\\\\x5B-\\\\x60\\\\x7B-\\\\x7F]+')")) \
        .where("i is not null and n > 0").withColumn(
            "size", F.greatest(F.col("n").cast("long"), F.ceil(F.octet_length("t") / WORD_BYTES)))
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-total // block_words))
    names, texts, size, given = [], [], 0, False
    for r in rows.repartition(parts, "i", "t").dropDuplicates(["i", "t"]).sortWithinPartitions("i", "t").toLocalIterator():
        if names and size + r["size"] > block_words:
            yield names, texts
            names, texts, size, given = [], [], 0, True
        names.append(r["i"])
        texts.append(r["t"])
        size += r["size"]
    if names or not given:
        yield names, texts


def annotate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
             item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with columns renamed ``_c0`` ... and ``_n_words``, ``_n_hit``, ``_items``, ``_spans``, ``_clean``.

    Positions are word positions, ranges end before ``b``; ``_clean`` is
    the text without the matched ranges (null: nothing matched).  Null and
    empty texts have no words; items without words or without an id match
    nothing; a repeated item id counts once.  A repeated document row is
    searched as often as it stands, long texts whole; other columns pass
    through whatever their names; an empty table gives no row.
    """
    spark = docs.sparkSession
    text = f"_c{docs.columns.index(text_col)}"
    df = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    df = df.withColumns({"_n_words": F.lit(0).cast("long"), "_items": F.expr("cast(array() as array<string>)"),
                         "_spans": F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")})
    blocks = item_blocks(items, item_id, item_text, block_words)
    following = next(blocks)
    while following is not None:
        (names, texts), following = following, next(blocks, None)
        last = following is None
        block = spark.sparkContext.broadcast((names, texts, uuid.uuid4().hex))
        schema = StructType(df.schema.fields + [StructField("_clean", StringType())] * last)
        df = df.mapInArrow(_pass(block, window, text, last), schema)
    return df.withColumn("_n_hit", F.expr("aggregate(_spans, 0L, (n, s) -> n + s.b - s.a)"))


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, ``n_words``, ``n_hit``, ``items`` (sorted ids), ``spans`` and ``clean_text``."""
    found = annotate(docs.select(id_col, text_col), items, text_col, **options)
    return found.select(F.col("_c0").alias(id_col), F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"),
                        F.col("_items").alias("items"), F.col("_spans").alias("spans"),
                        F.coalesce("_clean", "_c1").alias("clean_text"))


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text",
                   max_coverage: float = MAX_COVERAGE, **options) -> DataFrame:
    """``docs`` without the matched spans; documents covered beyond ``max_coverage`` go.

    A span is removed when it is longer than ``window`` - 1 words (or is a
    whole shorter item); a document goes when more than that share of its
    words is matched.  All columns and every other row are kept.
    """
    found = annotate(docs, items, text_col, **options)
    kept = found.where(F.col("_n_hit") <= F.lit(max_coverage) * F.col("_n_words"))
    at = docs.columns.index(text_col)
    return kept.select(*[(F.coalesce("_clean", f"_c{i}") if i == at else F.col(f"_c{i}")).alias(c)
                         for i, c in enumerate(docs.columns)])
