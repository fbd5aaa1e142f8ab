"""Quality rules: a table of thresholds compiled into one projection of Spark functions.

Every measure is an expression over the whole text, so a document is judged in
the scan, with no shuffle and no Python. The words of a text are split once; the
repeated windows come from sorting the hashes of its 3-word windows, so the work
grows as n log n with its words.

Cases: null, empty and blank texts have no words and fail the base rule. A rule
whose denominator is 0 passes. Repeated rows are judged alike; an empty table
gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the characters between words.
SPACE = r"[\x20\x09-\x0D]"
#: Fixed value: symbols that are counted.
SYMBOLS = "#*$%&|<>"
#: Common words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for on was with as by be are this have it at from "
    "le la les de des du et en un une est que qui dans pour par sur au pas avec "
    "der die und den von zu das mit sich auf für nicht im ist dem eine ein als "
    "el los y se del por las con una no su para es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """low <= numerator / denominator <= high; both name measures."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols", "n_symbols", "n_words", 0.0, 0.1),
    Rule("stop_words", "n_stop_words", "n_words", 0.03, 1.0),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.0, 0.5),
)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that are found twice or more in the text."""
    zipped = F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))).alias("b"), F.slice(words, F.lit(3), F.greatest(F.size(words) - 2, F.lit(0))).alias("c"))
    hashed = F.transform(F.slice(zipped, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.xxhash64(w))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            last = F.size(s) - 1
            near = lambda x, k: F.when(k >= 0, F.when(k <= last, F.get(s, k)["h"] == x["h"]))
            twice = F.filter(s, lambda x, k: F.coalesce(near(x, k - 1), F.lit(False)) | F.coalesce(near(x, k + 1), F.lit(False)))
            return let(F.sort_array(F.transform(twice, lambda x: x["i"])), lambda at: F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"]))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, again))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(hashed, covered))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the measures that rules name."""
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.trim(whole, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select("doc_id", whole.alias("whole"), words.alias("words"), lines.alias("lines"))
    stop = F.array(*[F.lit(x) for x in STOP_WORDS])
    return split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("whole", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("whole") - F.length(F.translate("whole", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The measures, base_failed, failed (names of broken rules) and kept for every row."""
    m = measures(docs)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    broken = [F.when(F.col(r.denominator) > 0, F.when((F.col(r.numerator) < F.lit(r.low) * F.col(r.denominator)) | (F.col(r.numerator) > F.lit(r.high) * F.col(r.denominator)), F.lit(r.name))) for r in rules]
    out = m.select("*", base.alias("base_failed"), F.array_compact(F.array(*broken)).alias("failed"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
