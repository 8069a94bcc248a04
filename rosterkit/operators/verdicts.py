"""One verdict per request of a batch: row rules, and unique values after the batch.

Row rules (NOT NULL, checks, text lengths) come from ``sources.schema`` and
are one expression per request.  Unique values need the whole batch.  All
accepted requests take effect at once, so a value that is given up in the
batch is free for another request, and

* a request is refused if it claims a value that a stored row keeps: nobody
  gives it up, or the request that would is itself refused;
* of several requests that claim one value the first by ``seq`` that is not
  refused gets it; a refused request refuses nobody;
* requests that only wait for each other (a swap, a longer cycle) are
  accepted together, if none of them waits for anything else;
* if nothing else can be decided, the requests that are first for all their
  values, but wait for a request that waits for them, are refused.

``judge`` finds this fixed point over the requests that are in some conflict;
the others never enter it.  Up to ``LOCAL_LINKS`` conflict rows (their number
is checked) are settled by the driver, more in rounds of Spark jobs, by the
same rules and with the same result.  In the rounds a request that waits for
one other only takes over what that one waits for, so chains are followed in
a number of rounds that grows with the logarithm of their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoint_dir
from ..sources.schema import RULES
from .changes import empty_rejects, rejects, union_all
from .joins import join_to_unique

Tables = dict[str, DataFrame]

#: Most conflict rows (a few MB) that are settled without rounds of jobs.
LOCAL_LINKS = 50_000

# What a request that breaks a row check is told.
CHECK_REASONS = {"salary_not_negative": "Salary must not be negative", "end_after_start": "EndDate before StartDate"}


# --------------------------------------------------------------------------- row rules

def row_fault(req: DataFrame, table: str, columns: dict[str, str]) -> Column:
    """The first row rule of ``table`` a request breaks, as a reason, or NULL.

    ``columns`` maps table columns to request columns; columns the request
    does not carry are not checked.
    """
    rules, faults = RULES[table], []
    for c in rules.not_null:
        if c in columns:
            faults.append(F.when(F.col(columns[c]).isNull(), F.lit(f"{columns[c]} must not be NULL")))
    same = {c for c, src in columns.items() if c == src}
    for check in rules.checks:
        named = {w for w in check.sql.replace("(", " ").replace(")", " ").split() if w in req.columns}
        if named and named <= same:
            faults.append(F.when(~F.coalesce(F.expr(check.sql), F.lit(True)),
                                 F.lit(CHECK_REASONS.get(check.name, check.name))))
    for c, most in rules.max_length.items():
        if c in columns:
            faults.append(F.when(F.length(F.col(columns[c]).cast("string")) > most,
                                 F.lit(f"{columns[c]} longer than {most}")))
    return F.coalesce(*faults) if faults else F.lit(None).cast("string")


def screen_rows(req: DataFrame, fault: Column, entity: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(requests without a fault, rejects)."""
    checked = req.withColumn("_fault", fault)
    return (checked.where(F.col("_fault").isNull()).drop("_fault"),
            rejects(checked.where(F.col("_fault").isNotNull()), entity, key, F.col("_fault")))


def unknown_parents(req: DataFrame, parent: DataFrame, column: str, parent_key: str, entity: str, key: str,
                    reason: str) -> tuple[DataFrame, DataFrame]:
    """(requests, rejects): a non-NULL ``column`` must be a key of ``parent``; a hot value is split."""
    known = parent.select(F.col(parent_key).alias(column), F.lit(True).alias("_parent"))
    j = join_to_unique(req, known, column, "left")
    bad = F.col(column).isNotNull() & F.col("_parent").isNull()
    return j.where(~bad).drop("_parent"), rejects(j.where(bad), entity, key, F.lit(reason))


# --------------------------------------------------------------------------- claims

def claims_of(req: DataFrame, columns: dict[str, str], current: dict[str, str] | None = None,
              seq: str = "seq") -> DataFrame:
    """(seq, slot, value) of the unique values requests write; NULL and '' claim nothing.

    ``columns`` maps slots (unique columns) to request columns, ``current``
    slots to columns with the row's present value: an unchanged value is
    no claim.
    """
    parts = []
    for slot, src in columns.items():
        value = F.col(src).cast("string")
        claimed = value.isNotNull() & (value != "")
        if current:
            claimed = claimed & ~value.eqNullSafe(F.col(current[slot]).cast("string"))
        parts.append(F.when(claimed, F.struct(F.lit(slot).alias("slot"), value.alias("value"))))
    return req.select(F.col(seq).alias("seq"), F.explode(F.array_compact(F.array(*parts))).alias("_c")).select(
        "seq", "_c.slot", "_c.value")


def holders(stored: DataFrame, key: str, columns: list[str], claims: DataFrame,
            owners: DataFrame | None = None) -> DataFrame:
    """(slot, value, owner, gives): stored rows that hold a claimed value.

    ``owners``: (key, seq, one boolean ``_gives_<slot>`` per slot) of the
    requests about stored rows.  Per slot only the key and that column of
    ``stored`` are read, reduced to the claimed values.
    """
    out = []
    for c in columns:
        wanted = claims.where(F.col("slot") == c).select("value").distinct()
        held = stored.select(F.col(key).alias("_key"), F.col(c).cast("string").alias("value")).join(
            wanted, "value", "left_semi")
        if owners is None:
            held = held.select(F.lit(c).alias("slot"), "value", F.lit(None).cast(claims.schema["seq"].dataType).alias("owner"),
                               F.lit(False).alias("gives"))
        else:
            mine = owners.select(F.col(key).alias("_key"), F.col("seq").alias("owner"), F.col(f"_gives_{c}").alias("gives"))
            held = held.join(mine, "_key", "left").select(F.lit(c).alias("slot"), "value", "owner",
                                                          F.coalesce("gives", F.lit(False)).alias("gives"))
        out.append(held)
    return union_all(out)


def _spread_join(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` (a written table) with the one row of each group that was aggregated from it.

    The join runs on a hash of the keys: the groups are then shuffled once
    more, both sides are plain shuffles, and AQE splits a value that a large
    share of the rows holds.
    """
    key = F.xxhash64(*on)
    g = groups.select(key.alias("_h"), *[F.col(c).alias(f"_g_{c}") for c in on], *[c for c in groups.columns if c not in on])
    same = [F.col(c) == F.col(f"_g_{c}") for c in on]
    return rows.withColumn("_h", key).join(g, "_h").where(same[0] if len(same) == 1 else same[0] & same[1]).drop(
        "_h", *[f"_g_{c}" for c in on])


def judge(claims: DataFrame, held: DataFrame, local_links: int | None = None) -> DataFrame | None:
    """(seq, slot, why) of the refused requests, None if no claim is in conflict.

    ``claims``: (seq, slot, value), ``held``: (slot, value, owner, gives) as
    ``holders`` gives it; ``seq`` is a total order of the requests.  ``why``
    is ``held`` or ``claimed``, of the first slot that refuses the request.
    """
    spark = claims.sparkSession
    ensure_checkpoint_dir(spark)
    seq_type = claims.schema["seq"].dataType
    many = claims.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    rival = _spread_join(claims, many, ["slot", "value"]).select(
        "seq", "slot", "value", F.lit(False).alias("waits"), F.lit(None).cast(seq_type).alias("giver"))
    # a stored value may be held twice in damaged tables: every holder counts
    against = claims.join(held, ["slot", "value"]).where(~F.col("seq").eqNullSafe(F.col("owner"))).select(
        "seq", "slot", "value", F.lit(True).alias("waits"), F.when(F.col("gives"), F.col("owner")).alias("giver"))
    links = rival.unionByName(against).checkpoint(eager=True)
    n, most = links.count(), LOCAL_LINKS if local_links is None else local_links
    if n == 0:
        return None
    if n <= most:
        refused = solve([(r["seq"], r["slot"], r["value"], r["waits"], r["giver"]) for r in links.collect()])
        return spark.createDataFrame(refused, f"seq {seq_type.simpleString()}, slot string, why string")
    rivals = links.where(~F.col("waits")).select("seq", "slot", "value")
    waits = links.where("waits").select("seq", "slot", "giver", F.col("giver").alias("first_giver"))
    moved = waits
    # verdicts: 1 accepted (as every request that is not listed), 0 open, -1 refused
    state = links.select("seq", F.lit(0).alias("v"), F.lit(False).alias("leads")).distinct()
    left = None
    while True:
        state, moved = _round(rivals, moved, state)
        now = state.where("v = 0").count()
        if now == 0:
            break
        if now == left:
            state = _settle(state, moved)
            now = state.where("v = 0").count()
        left = now
    return _causes(rivals, waits, state.select("seq", "v"))


def solve(links: list[tuple]) -> list[tuple]:
    """``judge`` for conflict rows (seq, slot, value, waits, giver) in memory: [(seq, slot, why)] of the refused."""
    claims: dict = {}
    givers: dict = {}
    holders_of: dict = {}
    waiting: dict = {}
    for seq, slot, value, waits, giver in links:
        if waits:
            givers.setdefault(seq, []).append((slot, giver))
            waiting.setdefault(giver, []).append(seq)
        else:
            claims.setdefault(seq, []).append((slot, value))
            holders_of.setdefault((slot, value), []).append(seq)
    for group in holders_of.values():
        group.sort(reverse=True)  # the first one that is not refused is at the end
    v = dict.fromkeys([*claims, *givers], 0)

    def first(claim):
        group = holders_of[claim]
        while group and v[group[-1]] == -1:
            group.pop()
        return group[-1] if group else None

    def verdict(s):
        given = [v.get(g, 1) if g is not None else -1 for _, g in givers.get(s, [])]
        ahead = [v[f] for c in claims.get(s, []) if (f := first(c)) != s]
        if -1 in given or 1 in ahead:
            return -1
        return 1 if not ahead and 0 not in given else 0

    todo = sorted(v, reverse=True)
    while True:
        while todo:
            s = todo.pop()
            if v[s] == 0 and (now := verdict(s)):
                v[s] = now
                todo += [w for w in waiting.get(s, []) if v[w] == 0]
                todo += [x for c in claims.get(s, []) for x in holders_of[c] if v[x] == 0]
        leads = {s for s in v if v[s] == 0 and all(first(c) == s for c in claims.get(s, []))}
        if not leads:
            break
        closed = set(leads)
        out = [s for s in closed if any(v.get(g, 1) == 0 and g not in closed for _, g in givers.get(s, []))]
        while out:
            s = out.pop()
            if s in closed:
                closed.remove(s)
                out += [w for w in waiting.get(s, []) if w in closed]
        for s in closed or leads:
            v[s] = 1 if closed else -1
            todo += [w for w in waiting.get(s, []) if v[w] == 0]
            todo += [x for c in claims.get(s, []) for x in holders_of[c] if v[x] == 0]

    refused = []
    for s in v:
        if v[s] == -1:
            causes = [(slot, "held") for slot, g in givers.get(s, []) if g is None or v.get(g, 1) == -1]
            causes += [(c[0], "claimed") for c in claims.get(s, []) if (f := first(c)) is not None and f < s]
            refused.append((s, *min(causes, default=("", "held"))))
    return refused


def _round(rivals: DataFrame, waits: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts that follow from the ones so far; waits moved on over requests that only wait.

    All inputs are written tables, so every join is between plain shuffles.
    """
    v = state.select("seq", "v")
    live = rivals.join(v, "seq").where("v >= 0")
    first = live.groupBy("slot", "value").agg(F.min(F.struct("seq", "v")).alias("f"))
    claim = _spread_join(live.where("v = 0"), first, ["slot", "value"]).where("f.seq <> seq").select(
        "seq", (F.col("f.v") == 1).alias("no"), F.lit(True).alias("behind"),
        F.lit(None).cast(waits.schema["giver"].dataType).alias("open"))
    w = _given(waits.join(v.where("v = 0").select("seq"), "seq", "left_semi"), v)
    wait = w.select("seq", "no", F.lit(False).alias("behind"), F.when(F.col("open"), F.col("giver")).alias("open"))
    signs = claim.unionByName(wait).groupBy("seq").agg(
        F.max("no").alias("no"), F.max("behind").alias("behind"), F.count("open").alias("n_open"), F.min("open").alias("next"))
    after = state.join(signs, "seq", "left").select(
        "seq", F.when(F.col("v") != 0, F.col("v")).when(F.col("no"), F.lit(-1))
        .when(F.col("behind") | (F.col("n_open") > 0), F.lit(0)).otherwise(F.lit(1)).alias("v"),
        (~F.coalesce("behind", F.lit(False))).alias("leads"),
        F.when(~F.col("behind") & (F.col("n_open") == 1), F.col("next")).alias("next")).checkpoint(eager=True)
    over = after.where("v = 0 and next is not null").select(F.col("seq").alias("giver"), "next")
    moved = waits.join(over, "giver", "left").select(
        "seq", "slot", F.coalesce("next", "giver").alias("giver"), "first_giver").checkpoint(eager=True)
    return after.drop("next"), moved


def _given(waits: DataFrame, v: DataFrame) -> DataFrame:
    """Waits with ``no`` (what is waited for can't be had) and ``open`` (not decided).

    A wait is for its first giver; the one it was moved on to only says
    sooner what will become of that one.
    """
    def of(column: str) -> DataFrame:
        return v.select(F.col("seq").alias(column), F.col("v").alias(f"_{column}"))

    w = waits.join(of("first_giver"), "first_giver", "left").join(of("giver"), "giver", "left")
    one, two = F.coalesce("_first_giver", F.lit(1)), F.coalesce("_giver", F.lit(1))
    no = F.col("first_giver").isNull() | (one == -1) | (two == -1)
    return w.withColumn("no", no).withColumn("open", ~no & (one == 0) & (two == 0))


def _settle(state: DataFrame, waits: DataFrame) -> DataFrame:
    """Nothing follows any more: accept the requests that wait for each other only, else refuse those in front."""
    leads = state.where("v = 0 and leads").select("seq")
    open_waits = waits.join(state.where("v = 0").select("seq"), "seq", "left_semi").join(
        state.where("v = 0").select(F.col("seq").alias("first_giver")), "first_giver", "left_semi").checkpoint(eager=True)
    closed, n = leads.checkpoint(eager=True), -1
    while n != (n := closed.count()) and n:
        inside = closed.select(F.col("seq").alias("first_giver"), F.lit(True).alias("_in"))
        out = open_waits.join(inside, "first_giver", "left").where("_in is null").select("seq").distinct()
        closed = closed.join(out, "seq", "left_anti").checkpoint(eager=True)
    chosen = (closed if n else leads).withColumn("_chosen", F.lit(1 if n else -1))
    return state.join(chosen, "seq", "left").select("seq", F.coalesce("_chosen", "v").alias("v"), "leads").checkpoint(eager=True)


def _causes(rivals: DataFrame, waits: DataFrame, v: DataFrame) -> DataFrame:
    """(seq, slot, why) of the refused requests, by the final verdicts."""
    gone = v.where("v = -1").select("seq")
    live = rivals.join(v, "seq").where("v >= 0")
    winner = live.groupBy("slot", "value").agg(F.min("seq").alias("f"))
    claim = _spread_join(rivals.join(gone, "seq", "left_semi"), winner, ["slot", "value"]).where("f < seq").select(
        "seq", F.struct("slot", F.lit("claimed").alias("why")).alias("cause"))
    held = _given(waits.join(gone, "seq", "left_semi"), v).where("no").select(
        "seq", F.struct("slot", F.lit("held").alias("why")).alias("cause"))
    cause = claim.unionByName(held).groupBy("seq").agg(F.min("cause").alias("cause"))
    return gone.join(cause, "seq", "left").select("seq", F.coalesce("cause.slot", F.lit("")).alias("slot"),
                                                  F.coalesce("cause.why", F.lit("held")).alias("why"))


# Reasons for a refused unique value; the person key has its own.
def reason_of(slot: Column, why: Column) -> Column:
    return (F.when((why == "held") & (slot == "NIF"), F.lit("NIF already in use"))
            .when((why == "held") & (slot == ""), F.lit("unique value already in use"))
            .when(why == "held", F.concat(slot, F.lit(" already exists")))
            .when(slot == "NIF", F.lit("duplicate new NIF in batch"))
            .otherwise(F.concat(F.lit("duplicate "), slot, F.lit(" in batch"))))


def settle(req: DataFrame, claims: DataFrame, stored: DataFrame, stored_key: str, columns: list[str], entity: str,
           key: str, owners: DataFrame | None = None, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(accepted requests, rejects) of ``req``: unique values after the batch (``judge``).

    The claims are written once; a batch that claims nothing, or nothing
    that anyone else holds or claims, comes back as it is.
    """
    ensure_checkpoint_dir(req.sparkSession)
    claims = claims.checkpoint(eager=True)
    refused = None if claims.isEmpty() else judge(claims, holders(stored, stored_key, columns, claims, owners))
    if refused is None:
        return req, empty_rejects(req.sparkSession)
    refused = refused.select(F.col("seq").alias(seq), F.col("slot").alias("_slot"), F.col("why").alias("_why"))
    gone = req.join(refused, seq)
    return (req.join(refused.select(seq), seq, "left_anti"),
            rejects(gone, entity, key, reason_of(F.col("_slot"), F.col("_why"))))
