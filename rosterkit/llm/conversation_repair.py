"""Conversation structure repair: generalised LR parsing with weighted edits.

The roles of a conversation must read ``(s?(ua)+)?``: an optional system
turn, then pairs of user and assistant.  As a grammar:

    Conv -> (empty) | Body | s Body        Body -> u a | Body u a

Its LR automaton (``SHIFT``, ``REDUCE``, ``GOTO``) is run over the turns with
every action the edits allow at once: keep the turn, rerole it to user or
assistant, delete it, insert an empty turn before it.  The parses share their
stacks (linked tuples, a graph-structured stack), and parses with the same
stack top are merged by the least (cost, audit), the audit being the initials
of the edits so far.  Two audits over the same turns that end with a turn's
edit never are the start of one another, and equal tops take the same turns
from there on, so a merged parse can't become the better one later.

No conversation has to fit a task.  Turns are put in order by a range
partitioning, and the order is cut in blocks of at most ``BLOCK_ROWS`` turns
and about ``BLOCK_CHARS`` characters.  A block is parsed from every stack top
it may be entered with; of a conversation in several blocks only the costs and
the ranks of the audits (a few integers a block) are then folded in order, and
each block takes the edits of the entry and exit the fold chose.

Turns of a conversation follow ``turn`` (nulls first), then role, then the
digest of the text; equal turns are counted before the order is made, so a
turn that is repeated very often is one row there.  Null roles and texts are
one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
BLOCK_ROWS = 1024
BLOCK_CHARS = 1 << 22

_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_NULL_TURN = -(1 << 63)

# The LR automaton: state -> symbol -> state, states that reduce to Body (and
# how many symbols they take off), the state after Body by the one below.
SHIFT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 5}, 3: {"u": 6}, 4: {"u": 6}, 6: {"a": 7}}
REDUCE = {5: 2, 7: 3}
GOTO = {0: 3, 1: 4}
#: inserts that complete a conversation, by stack top
TAIL = {0: 0, 1: 2, 2: 1, 3: 0, 4: 0, 6: 1}
#: a stack for each top (top first); what lies below a merged top does not matter
STACKS = {0: (0, None), 1: (1, (0, None)), 2: (2, (0, None)), 3: (3, (0, None)), 4: (4, (1, (0, None))),
          6: (6, (3, (0, None)))}
ROLES = {"u": "user", "a": "assistant"}


def shift(stack: tuple, symbol: str) -> tuple | None:
    """The stack after ``symbol`` and the reductions it completes, None if it can't come here."""
    state = SHIFT[stack[0]].get(symbol)
    if state is None:
        return None
    stack = (state, stack)
    if state in REDUCE:
        for _ in range(REDUCE[state]):
            stack = stack[1]
        stack = (GOTO[stack[0]], stack)
    return stack


def _offer(tops: dict, cost: int, audit: str, stack: tuple) -> bool:
    """Merge a parse into the one with the same stack top by the least (cost, audit)."""
    old = tops.get(stack[0])
    if old is None or (cost, audit) < old[:2]:
        tops[stack[0]] = (cost, audit, stack)
        return True
    return False


def _insert(tops: dict) -> None:
    """Add every parse that inserts turns before the next one."""
    todo = list(tops.values())
    while todo:
        cost, audit, stack = todo.pop()
        for symbol in ROLES:
            nxt = shift(stack, symbol)
            if nxt and _offer(tops, cost + INSERT, audit + "I", nxt):
                todo.append(tops[nxt[0]])


def parse(turns: list[tuple[str, bool, bool]], entry: int = 0) -> dict[int, tuple[int, str]]:
    """Stack top after the turns -> (cost, audit); a turn is (initial, must go, truncated)."""
    tops = {entry: (0, "", STACKS[entry])}
    for initial, gone, cut in turns:
        _insert(tops)
        after: dict = {}
        for cost, audit, stack in tops.values():
            _offer(after, cost + DELETE, audit + "D", stack)
            if gone:
                continue
            for symbol in SHIFT[stack[0]]:
                if symbol == initial:
                    _offer(after, cost + KEEP + CUT * cut, audit + "K", shift(stack, symbol))
                elif symbol in ROLES:
                    _offer(after, cost + REROLE + CUT * cut, audit + "R", shift(stack, symbol))
        tops = after
    return {top: (cost, audit) for top, (cost, audit, _) in tops.items()}


def apply_edits(audit: str, roles: list, texts: list, entry: int) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the turns that stand after the edits."""
    out, stack, at = [], STACKS[entry], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        wanted = next(iter(x for x in SHIFT[stack[0]] if x in ROLES))
        if edit == "K":
            out.append(("K", roles[at], texts[at]))
            stack = shift(stack, roles[at][:1])
        else:
            out.append((edit, ROLES[wanted], texts[at] if edit == "R" else ""))
            stack = shift(stack, wanted)
        at += edit != "I"
    return out


# --------------------------------------------------------------------------- tasks

_OPTION = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()),
                              ("audit", pa.string())]))
_COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")
_BLOCK = ("_key string, _part int, _no long, n long, blank long, duplicate long, truncated long, illegal long, "
          "turns long, first_initial string, last_initial string, first_turn long, last_turn long, "
          "options array<struct<entry:int,exit:int,cost:long,rank:int,audit:string>>, "
          "roles array<string>, texts array<string>")


class _Block:
    """The turns of one conversation in one block, and the stack tops it may be entered with."""

    def __init__(self, key: str, part: int, no: int, entries: tuple[int, ...]):
        self.key, self.part, self.no, self.entries, self.chars = key, part, no, entries, 0
        self.turns: list = []
        self.roles: list = []
        self.texts: list = []
        self.at: list = []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)

    def add(self, at: int, role: str, text: str, fault: str) -> None:
        if fault:
            self.counts[fault] += 1
        gone = fault in ("blank", "duplicate")
        self.turns.append((role[:1], gone, fault == "truncated"))
        self.roles.append(role)
        self.texts.append(None if gone else text)
        self.at.append(at)
        self.chars += 0 if gone else len(text)

    def full(self) -> bool:
        return len(self.turns) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def row(self) -> dict:
        options = []
        for entry in self.entries:
            found = parse(self.turns, entry)
            ranked = sorted(found, key=lambda top: found[top][1])
            options += [dict(entry=entry, exit=top, cost=found[top][0], rank=r, audit=found[top][1])
                        for r, top in enumerate(ranked)]
        initials = [t[0] for t in self.turns]
        known = [t for t in self.at if t != _NULL_TURN]
        return dict(_key=self.key, _part=self.part, _no=self.no, n=len(self.turns), **self.counts,
                    illegal=sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                    turns=len(set(known)), first_initial=initials[0], last_initial=initials[-1],
                    first_turn=known[0] if known else None, last_turn=known[-1] if known else None,
                    options=options, roles=self.roles, texts=self.texts)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_BLOCK_SCHEMA = pa.schema([("_key", pa.string()), ("_part", pa.int32()), ("_no", pa.int64()),
                           *[(c, pa.int64()) for c in _COUNTS],
                           ("first_initial", pa.string()), ("last_initial", pa.string()),
                           ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("options", _OPTION),
                           ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    """Ordered turns of one partition -> its blocks, parsed."""
    block, no, out, chars = None, 0, [], 0
    for batch in batches:
        for row in batch.to_pylist():
            for copy in range(row["_n"]):
                if block is None or block.key != row["_key"] or block.full():
                    # the partition's first conversation may have begun in the one before
                    begins = block is not None and block.key != row["_key"]
                    if block is not None:
                        out.append(block.row())
                        chars += block.chars
                        no += 1
                    if chars >= BLOCK_CHARS or len(out) >= BLOCK_ROWS:
                        yield _batch(out, _BLOCK_SCHEMA)
                        out, chars = [], 0
                    block = _Block(row["_key"], row["_part"], no, (0,) if begins else tuple(STACKS))
                fault = "blank" if row["_blank"] else "duplicate" if copy or not row["_first"] else \
                    "truncated" if row["_cut"] else ""
                block.add(row["_at"], row["_role"], row["_text"], fault)
    if block is not None:
        out.append(block.row())
    if out:
        yield _batch(out, _BLOCK_SCHEMA)


_CHOICE = ("_part int, _no long, entry int, exit int, tail int, cost long, gaps long, blank long, duplicate long, "
           "truncated long, illegal long")
_CHOICE_SCHEMA = pa.schema([("_part", pa.int32()), ("_no", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()),
                            ("tail", pa.int32()), *[(c, pa.int64()) for c in
                                                    ("cost", "gaps", "blank", "duplicate", "truncated", "illegal")]])


def fold(blocks: list[dict]) -> list[dict]:
    """The entry and exit of each block of one conversation; the last block carries the totals."""
    tops, back = {0: (0, 0)}, []
    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    distinct, first, last, before = 0, None, None, None
    for b in blocks:
        after: dict = {}
        for o in b["options"]:
            if o["entry"] in tops:
                cost, rank = tops[o["entry"]]
                offer = (cost + o["cost"], (rank, o["rank"]), o["entry"])
                if o["exit"] not in after or offer < after[o["exit"]]:
                    after[o["exit"]] = offer
        order = {r: k for k, r in enumerate(sorted(a[1] for a in after.values()))}
        tops = {top: (cost, order[rank]) for top, (cost, rank, _) in after.items()}
        back.append({top: entry for top, (_, _, entry) in after.items()})
        for c in total:
            total[c] += b[c]
        total["illegal"] += before is not None and before + b["first_initial"] not in ("su", "ua", "au")
        before = b["last_initial"]
        if b["first_turn"] is not None:
            distinct += b["turns"] - (last == b["first_turn"])
            first = b["first_turn"] if first is None else first
            last = b["last_turn"]
    top = min(tops, key=lambda t: (tops[t][0] + INSERT * TAIL[t], tops[t][1]))
    total["cost"] = tops[top][0] + INSERT * TAIL[top]
    total["gaps"] = last - first + 1 - distinct if first is not None else 0
    out, tail = [], TAIL[top]
    for b, entries in zip(reversed(blocks), reversed(back), strict=True):
        row = dict(_part=b["_part"], _no=b["_no"], entry=entries[top], exit=top, tail=tail)
        out.append({**row, **(total if not out else {})})
        top, tail = entries[top], 0
    return out


def _groups(batches, key: str = "_key") -> Iterator[list[dict]]:
    """Rows of a sorted stream with equal keys, one list at a time."""
    group: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if group and group[0][key] != row[key]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _fold_rows(batches) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    for group in _groups(batches):
        out += fold(group)
        if len(out) >= 4096:
            yield _batch(out, _CHOICE_SCHEMA)
            out = []
    yield _batch(out, _CHOICE_SCHEMA)


_TURNS = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))


def _edit_rows(batches) -> Iterator[pa.RecordBatch]:
    """Blocks with their entry and exit -> audit and the turns that stand."""
    for batch in batches:
        audits, turns = [], []
        for row in batch.select(["entry", "audit", "tail", "roles", "texts"]).to_pylist():
            audits.append(row["audit"] + "I" * row["tail"])
            turns.append([dict(edit=e, role=r, text=t) for e, r, t in
                          apply_edits(audits[-1], row["roles"], row["texts"], row["entry"])])
        keep = [c for c in batch.schema.names if c not in ("entry", "exit", "audit", "tail", "roles", "texts")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(audits, pa.string()),
                                          pa.array(turns, _TURNS)], names=[*keep, "audit", "turns"])


_TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _digests(batches) -> Iterator[pa.RecordBatch]:
    """Blocks in order -> one row per conversation: totals, audit and the digest of its lines, read as a stream."""
    names = ["_key", *_TOTALS, "audit", "repaired_sha256"]
    schema = pa.schema([(c, pa.int64() if c in _TOTALS else pa.string()) for c in names])
    out: list[dict] = []
    key, digest, audits, started = None, None, [], False
    for batch in batches:
        for row in batch.to_pylist():
            if key != row["_key"]:
                key, digest, audits, started = row["_key"], hashlib.sha256(), [], False
            audits.append(row["audit"])
            if row["_lines"] is not None:
                digest.update((("\n" if started else "") + row["_lines"]).encode())
                started = True
            if row["cost"] is not None:  # the last block
                out.append(dict(_key=key, **{c: row[c] for c in _TOTALS}, audit="".join(audits),
                                repaired_sha256=digest.hexdigest()))
        if len(out) >= 4096:
            yield _batch(out, schema)
            out = []
    yield _batch(out, schema)


# --------------------------------------------------------------------------- operators

def _key(conv: str):
    """A text key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))


def pieces(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The repaired conversations in blocks.

    Per block: ``_key`` (of the conversation), its order ``_part``, ``_no``,
    ``audit`` and ``turns`` (edit, role, text of the turns that stand), and
    in the last block of a conversation its totals ``gaps``, ``blank``,
    ``duplicate``, ``truncated``, ``illegal`` and ``cost``.  Null ids are one
    conversation; an empty table gives no row; other columns are not looked
    at.  Repeated rows are duplicates, very long texts make blocks of their
    own.
    """
    scratch = scratch or Scratch(turns.sparkSession, "conversation-repair")
    rows = turns.select(
        _key(conv_col).alias("_key"), F.coalesce(F.col(turn_col).cast("long"), F.lit(_NULL_TURN)).alias("_at"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("_text"))
    order = ["_key", "_at", "_role", "_digest"]
    counted = rows.withColumn("_digest", F.md5("_text")).groupBy(*order).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_text").alias("_text"))
    firsts = rows.select("_key", "_at", "_role", F.md5("_text").alias("_digest")).groupBy(
        "_key", "_role", "_digest").agg(F.min("_at").alias("_at"))
    end = F.right(F.rtrim(F.col("_text"), F.lit(_SPACE)), F.lit(1))
    marked = counted.join(firsts.withColumn("_hit", F.lit(True)), order, "left").select(
        *order, "_n", "_text", F.col("_hit").isNotNull().alias("_first"), (end == "").alias("_blank"),
        (~end.isin(".", "!", "?")).alias("_cut"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(
        "_part", F.spark_partition_id())
    blocks = scratch.keep(ordered.mapInArrow(_blocks, _BLOCK), "blocks")
    # a few integers a block: the options without their audits
    narrow = blocks.drop("roles", "texts").withColumn("options", F.transform("options", lambda o: o.dropFields("audit")))
    chosen = scratch.keep(narrow.repartition("_key").sortWithinPartitions("_key", "_part", "_no").mapInArrow(
        _fold_rows, _CHOICE), "chosen")
    option = F.filter("options", lambda o: (o["entry"] == F.col("entry")) & (o["exit"] == F.col("exit")))
    picked = blocks.select("_key", "_part", "_no", "roles", "texts", "options").join(chosen, ["_part", "_no"]).select(
        "_key", "_part", "_no", *_TOTALS, "entry", "exit", "tail", option[0]["audit"].alias("audit"), "roles", "texts")
    return picked.mapInArrow(_edit_rows, "_key string, _part int, _no long, " + ", ".join(f"{c} long" for c in _TOTALS) +
                             ", audit string, turns array<struct<edit:string,role:string,text:string>>")


def repaired(turns: DataFrame, conv_col: str = "conv_id", **columns) -> DataFrame:
    """The repaired conversations as rows: ``conv_col`` (as text), ``position``, ``edit``, ``role``, ``text``.

    ``position`` orders the rows of a conversation (block, then place in it);
    edits are K (kept), R (other role) and I (inserted).  Limits and odd
    input as in ``pieces``.
    """
    found = pieces(turns, conv_col, **columns).select("_key", "_part", "_no", F.posexplode("turns").alias("_i", "_t"))
    return found.select(F.when(F.col("_key") != "", F.expr("substring(_key, 2)")).alias(conv_col),
                        F.struct("_part", "_no", "_i").alias("position"), "_t.edit", "_t.role", "_t.text")


def report(turns: DataFrame, conv_col: str = "conv_id", **columns) -> DataFrame:
    """One row per conversation: faults, cost, audit and the digest of the repaired lines.

    A digest of a whole conversation is made in order by one task; it reads
    the blocks as a stream and holds one at a time.
    """
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    found = pieces(turns, conv_col, **columns).withColumn("_lines", F.when(F.size("turns") > 0, lines)).drop("turns")
    digests = found.repartition("_key").sortWithinPartitions("_key", "_part", "_no").mapInArrow(
        _digests, "_key string, " + ", ".join(f"{c} long" for c in _TOTALS) + ", audit string, repaired_sha256 string")
    return digests


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """Conversations with faults planted by the CRC-32 of ``conv:turn`` modulo 20 (nulls: one space)."""
    def plain(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    code = F.crc32(F.concat_ws(":", plain(conv_col), plain(turn_col))) % 20
    rows = turns.select(F.col(conv_col), F.col(turn_col), plain(role_col).alias("_r"), plain(text_col).alias("_t"),
                        code.alias("_c")).where("_c <> 0")
    text = F.when(F.col("_c") == 1, "").when(F.col("_c") == 2, F.translate("_t", ".!?", "")).otherwise(F.col("_t"))
    return rows.select(conv_col, turn_col, F.when(F.col("_c") == 4, "user").otherwise(F.col("_r")).alias(role_col),
                       text.alias(text_col),
                       F.explode(F.when(F.col("_c") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
                       .alias("_copy")).drop("_copy")


def damaged_and_repaired(turns: DataFrame, conv_col: str = "conv_id", **columns) -> DataFrame:
    """``report`` of the damaged conversations, with every id of ``turns``; conversations left empty have zeros."""
    found = report(damaged(turns, conv_col, **columns), conv_col, **columns)
    ids = turns.select(F.col(conv_col), _key(conv_col).alias("_key")).distinct()
    out = ids.join(found, "_key", "left").fillna(0, list(_TOTALS))
    return out.select(conv_col, *_TOTALS, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
