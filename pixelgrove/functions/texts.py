"""Text expressions: recogniser output, analysis into n-grams, list parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: N-gram lengths of the text index.
LEAST_GRAM, MOST_GRAM = 2, 4


def ctc_decode(steps: Column, alphabet: Column) -> Column:
    """(text, confidence) of an array of (idx, prob): blanks (0) and repeats of the step before are dropped.

    alphabet: array with the blank first. An index beyond it is dropped but counts as the step before. Confidence is the mean of kept steps, or 0.
    """
    empty = F.struct(F.lit(0).alias("prev"), F.lit("").alias("text"), F.lit(0.0).alias("total"), F.lit(0).alias("n"))

    def step(acc, s):
        kept = (s["idx"] != 0) & (s["idx"] != acc["prev"]) & (s["idx"] < F.size(alphabet))
        return F.struct(
            s["idx"].alias("prev"),
            F.when(kept, F.concat(acc["text"], F.get(alphabet, s["idx"]))).otherwise(acc["text"]).alias("text"),
            F.when(kept, acc["total"] + s["prob"]).otherwise(acc["total"]).alias("total"),
            F.when(kept, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
        )

    return F.aggregate(steps, empty, step, lambda a: F.struct(a["text"].alias("text"), F.when(a["n"] > 0, a["total"] / a["n"]).otherwise(F.lit(0.0)).alias("confidence")))


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def grams(token: Column, low: int = LEAST_GRAM, high: int = MOST_GRAM) -> Column:
    """All n-grams of a token; shorter tokens have none, and a longer token is not kept whole."""
    none = F.array().cast("array<string>")
    one = lambda n: F.when(F.length(token) >= n, F.transform(F.sequence(F.lit(1), F.length(token) - (n - 1)), lambda i: F.substring(token, i, F.lit(n)))).otherwise(none)
    return F.concat(*[one(n) for n in range(low, high + 1)])


def class_list(text: Column) -> Column:
    """Integers of a comma-separated list; empty parts are dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda v: F.trim(v).try_cast("int")), lambda v: v.isNotNull())


def named_classes(text: Column, names: dict[str, int]) -> Column:
    """Class ids of a comma-separated list of names; unknown names are dropped, and if none is left the result is null: no filter."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    ids = F.filter(F.transform(F.split(F.lower(text), ","), lambda v: F.try_element_at(table, F.trim(v))), lambda v: v.isNotNull())
    return F.when(F.size(ids) > 0, ids)
