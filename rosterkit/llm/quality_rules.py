"""Line-first quality rules, in DataFrame functions only.

Each line of a text is judged by three rules; failing lines are removed,
and a document that loses too much of its text that way is rejected.
Before that, base rules look at the whole text.

Line rules (a line without a word is not judged and stays):

* punctuation: of at least ``MIN_JUDGED`` words and not ending in terminal
  punctuation, or with symbols (``#*$%&|<>``) in more than a tenth of its
  characters, or with doubled ``!`` / ``?`` marks after every other word;
* navigation: separators (``|`` and bullets, arrows) at a quarter or more of its
  words;
* boilerplate: a known notice phrase in a line of at most 20 words.

Everything is computed inside one row of one scan: no shuffle, no Python.
Arrays are kept in projections of their own, so each is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
TERMINAL = r"[.!?…:;\"'”’»)\]][\x20\x09-\x0D]*$"
DOUBLED = r"[!?][!?]+"
SEPARATORS = r"[|»›•·→]"
NOTICES = (r"all rights reserved|terms of use|terms of service|privacy policy|cookie policy|use of cookies|"
           r"click here|subscribe to|sign up for|log in to|powered by|javascript|lorem ipsum|copyright ©|"
           r"back to top|skip to content|read more")

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MIN_JUDGED = 3
NOTICE_WORDS = 20
MAX_LOST_PERCENT = 50


def _size(c: Column) -> Column:
    return F.size(c).cast("long")


def _line_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def line_fails(line: Column) -> Column:
    """True for a line that one of the three rules removes."""
    n = _line_words(line)
    punctuation = ((n >= MIN_JUDGED) & ~line.rlike(TERMINAL)) | (10 * _symbols(line) > F.length(line)) \
        | (2 * F.regexp_count(line, F.lit(DOUBLED)) >= F.greatest(n, F.lit(2)))
    navigation = (4 * F.regexp_count(line, F.lit(SEPARATORS)) >= n) & line.rlike(SEPARATORS)
    boilerplate = (n <= NOTICE_WORDS) & F.lower(line).rlike(NOTICES)
    return (n > 0) & (punctuation | navigation | boilerplate)


def _repeat_words(words: Column, windows: Column) -> Column:
    """Words covered by a window that stands twice or more.

    Windows are sorted as (hash, place); equal neighbours give the places,
    and each place covers up to the next one, at most a window's length.
    """
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        again = F.filter(F.transform(s, lambda x, j: F.struct(
            x["i"].alias("i"), ((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])).alias("twice"))),
            lambda x: x["twice"])
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, j: F.least(
            F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))).cast("long")),
            F.lit(0).cast("long"), lambda a, b: a + b)

    # transform over a one-element array binds a name to a value
    return F.get(F.transform(F.transform(F.array(placed), places), covered), F.lit(0))


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` renamed ``_c0`` ... with the measures, ``_base_failed``, ``_kept`` and ``_clean``.

    Null and empty texts have no words and fail the base rules.  ``_clean``
    is the text of the lines that pass, joined by newlines.
    """
    text = f"_c{docs.columns.index(text_col)}"
    df = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_words": F.filter(F.split(body, SPACES), lambda w: w != ""), "_lines": F.split(body, "\n")})
    df = df.withColumns({
        "_n_words": _size(F.col("_words")),
        "_word_chars": F.length(F.translate(body, SPACE_CHARS, "")).cast("long"),
        "_n_symbols": _symbols(body).cast("long"),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        "_full": F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "_passed": F.filter("_lines", lambda x: ~line_fails(x)),
    }).drop("_words")
    df = df.withColumn("_windows", F.when(F.size("_hashes") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("_hashes") - WINDOW),
        lambda i: F.xxhash64(*[F.get("_hashes", i + j) for j in range(WINDOW)]))).otherwise(
            F.expr("cast(array() as array<bigint>)")))
    df = df.withColumns({
        "_n_dup_lines": _size(F.col("_full")) - _size(F.array_distinct("_full")),
        "_n_failed_lines": _size(F.col("_lines")) - _size(F.col("_passed")),
        "_clean": F.array_join("_passed", "\n"),
        "_n_repeat_words": F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0).cast("long"))
        .otherwise(_repeat_words(F.col("_hashes"), F.col("_windows"))),
    })
    df = df.withColumn("_left_chars", F.length(F.translate("_clean", SPACE_CHARS, "")).cast("long"))
    df = df.withColumn("_base_failed", (F.col("_n_words") < MIN_WORDS) | (
        100 * F.col("_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_n_words")))
    lost = 100 * (F.col("_word_chars") - F.col("_left_chars")) > MAX_LOST_PERCENT * F.col("_word_chars")
    return df.withColumn("_kept", ~F.col("_base_failed") & ~lost)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines",
            "base_failed", "kept")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the measures, the verdict and ``clean_text``; other columns are left out."""
    df = judge(docs.select(id_col, text_col), text_col)
    return df.select(F.col("_c0").alias(id_col), *[F.col(f"_{m}").alias(m) for m in MEASURES],
                     F.col("_clean").alias("clean_text"))


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs``, all columns, with the failing lines removed from the text.

    Rows go through ``inline`` of a null array, not a filter: the optimizer
    would push a filter below the projections and compute each of their
    arrays again for every use.
    """
    at = docs.columns.index(text_col)
    row = F.struct(*[F.col("_clean" if i == at else f"_c{i}").alias(f"_c{i}") for i in range(len(docs.columns))])
    return judge(docs, text_col).select(F.inline(F.when(F.col("_kept"), F.array(row)))).toDF(*docs.columns)
