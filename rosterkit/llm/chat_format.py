"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: the template text of all
turns before it as context, then the reply, of which only the text is under
the loss mask.  Turns that no reply follows (a last question, a
conversation without a reply) end in one more example without a mask, so
that every turn can be read back.

Template of a turn: ``<|role|>`` newline, text, ``<|end|>`` newline.  In
texts and roles ``%``, ``<`` and ``[`` are written ``%25``, ``%3C`` and
``%5B`` (and a newline in a role ``%0A``), so no text can hold a control
string of this template or of the bracket and tag families; reading back
replaces the codes in the reverse order.

A conversation is one training unit: its turns are held in one row, and
the output grows with the square of its length by definition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
CODES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"))
ROLE_CODES = (*CODES, ("\n", "%0A"))


def _replace(text: Column, pairs) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def escape(text: Column, codes=CODES) -> Column:
    return _replace(text, codes)


def unescape(text: Column, codes=CODES) -> Column:
    return _replace(text, [(b, a) for a, b in reversed(codes)])


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(conv_id, turns): one row per conversation, its turns in order.

    Order is by turn, then role and text (so ties and repeated rows have one
    result; a null turn comes first).  Null roles and texts are empty.  A
    row without a conversation id is a conversation of its own.
    """
    alone = F.when(F.col(conv).isNull(), F.monotonically_increasing_id())
    return turns.select(
        F.col(conv).alias("conv_id"), alone.alias("_alone"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t")) \
        .groupBy("conv_id", "_alone").agg(F.sort_array(F.collect_list("t")).alias("turns")).drop("_alone")


def formatted(turns: DataFrame, **columns) -> DataFrame:
    """(conv_id, examples): per conversation its examples, in order of their target.

    An example is (target, text, from, length): the turn number of its
    reply, the template text, and the masked range in characters; the last
    one may have no reply (target null, length 0).
    """
    df = conversations(turns, **columns).withColumn("_parts", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"),
        F.concat(F.lit(OPEN), escape(t["role"], ROLE_CODES), F.lit(CLOSE)).alias("head"),
        escape(t["text"]).alias("body")))).drop("turns")
    df = df.withColumn("_whole", F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))))

    def prefix(i: Column) -> Column:
        return F.array_join(F.slice("_whole", 1, i), "")

    def example(p: Column, i: Column) -> Column:
        return F.struct(
            F.when(p["role"] == "assistant", i).alias("target"),
            F.concat(prefix(i), p["head"], p["body"], F.lit(END)).alias("text"),
            F.when(p["role"] == "assistant", F.length(prefix(i)) + F.length(p["head"])).otherwise(F.lit(0)).alias("from"),
            F.when(p["role"] == "assistant", F.length(p["body"])).otherwise(F.lit(0)).alias("length"),
            ((p["role"] == "assistant") | (i == F.size("_parts") - 1)).alias("made"))

    made = F.transform(
        F.filter(F.transform("_parts", lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
                 lambda x: (x["p"]["role"] == "assistant") | (x["i"] == F.size("_parts") - 1)),
        lambda x: example(x["p"], x["i"]).dropFields("made"))
    return df.select("conv_id", made.alias("examples"))


def examples(turns: DataFrame, **columns) -> DataFrame:
    """One row per example: conv_id, target, text, from, length."""
    return formatted(turns, **columns).select("conv_id", F.inline("examples"))


def read_back(formatted_rows: DataFrame) -> DataFrame:
    """(conv_id, turns, replies, formatted_chars), parsed from the examples alone."""
    last = F.element_at("examples", -1)["text"]
    pieces = F.transform(F.filter(F.split(last, r"<\|end\|>\n"), lambda p: p != ""), lambda p: F.struct(
        unescape(F.regexp_extract(p, r"^<\|([^\n]*)\|>\n", 1), ROLE_CODES).alias("role"),
        unescape(F.regexp_replace(p, r"^<\|[^\n]*\|>\n", "")).alias("text")))
    replies = F.transform(F.filter("examples", lambda e: e["target"].isNotNull()),
                          lambda e: unescape(F.substring(e["text"], e["from"] + 1, e["length"])))
    size = F.aggregate("examples", F.lit(0).cast("long"), lambda n, e: n + F.length(e["text"]))
    return formatted_rows.select("conv_id", pieces.alias("turns"), replies.alias("replies"),
                                 size.alias("formatted_chars"))


def digest(formatted_rows: DataFrame) -> DataFrame:
    """Counts and SHA-256 of what the examples hold when read back."""
    df = read_back(formatted_rows)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("replies", "")
    return df.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                     F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                     "formatted_chars")
