"""Damerau-Levenshtein similarity (unrestricted transpositions) by array functions.

Spark has plain ``levenshtein`` only. It bounds the distance wanted from both sides (a
transposition counts as two of its edits at most), so the exact one is computed only for
pairs that can be the best of their row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mimicry.functions.rounding import round_binary


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is referred to."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def edit_distance(left: Column, right: Column) -> Column:
    """Fewest edits and transpositions; a transposed pair may have other letters edited between."""
    plain = F.levenshtein(left, right)
    settled = (plain <= 1) | (F.length(left) == 0) | (F.length(right) == 0)
    letters = F.struct(F.split(left, "").alias("left"), F.split(right, "").alias("right"))
    return F.when(settled, plain).otherwise(_bound(letters, lambda x: _by_rows(x["left"], x["right"])))


def _by_rows(left: Column, right: Column) -> Column:
    """The last cell of the distances of all prefixes; earlier rows are kept for transpositions."""
    width = F.size(right)

    def add_row(rows: Column, i: Column) -> Column:
        letter, above = F.get(left, i - 1), F.get(rows, i - 1)
        earlier = F.reverse(F.slice(left, F.lit(1), i - 1))

        def add_cell(acc: Column, j: Column) -> Column:
            other = F.get(right, j - 1)
            back = F.array_position(earlier, other).cast("int")
            swapped = F.get(F.get(rows, i - back - 1), acc["met"] - 1) + back + j - acc["met"] - 1
            cell = F.least(
                F.get(above, j - 1) + (letter != other).cast("int"),
                F.get(above, j) + 1,
                F.get(acc["row"], j - 1) + 1,
                F.when((back > 0) & (acc["met"] > 0), swapped),
            )
            return F.struct(
                F.array_append(acc["row"], cell).alias("row"),
                F.when(letter == other, j).otherwise(acc["met"]).alias("met"),
            )

        start = F.struct(F.array(i).alias("row"), F.lit(0).alias("met"))
        row = F.aggregate(F.sequence(F.lit(1), width), start, add_cell)["row"]
        return F.array_append(rows, row)

    first = F.array(F.sequence(F.lit(0), width))
    rows = F.aggregate(F.sequence(F.lit(1), F.size(left)), first, add_row)
    return F.get(F.get(rows, F.size(left)), width)


def typo_similarity(label: Column, tokens: Column) -> Column:
    """Best similarity of the label or one of its words to a token no longer than it.

    Rounded to four places; 0 where there is no label or no token.
    """
    words = F.array_distinct(F.concat(F.split(label, "[^a-z]+"), F.array(label)))

    def pair(word: Column, token: Column) -> Column:
        return F.struct(
            word.alias("word"),
            token.alias("token"),
            F.levenshtein(word, token).alias("plain"),
            F.greatest(F.length(word), F.lit(1)).alias("longest"),
        )

    def of_word(word: Column) -> Column:
        fitting = F.filter(tokens, lambda token: F.length(word) >= F.length(token))
        return F.transform(fitting, lambda token: pair(word, token))

    def exact(x: Column, least: Column) -> Column:
        apart = F.length(x["word"]) - F.length(x["token"])
        most = 1.0 - F.greatest(F.ceil(x["plain"] / 2), apart) / x["longest"]
        return F.when(most > least, 1.0 - edit_distance(x["word"], x["token"]) / x["longest"]).otherwise(least)

    def best(pairs: Column) -> Column:
        sure = F.array_max(F.transform(pairs, lambda x: 1.0 - x["plain"] / x["longest"]))
        return _bound(sure, lambda least: F.array_max(F.transform(pairs, lambda x: exact(x, least))))

    found = _bound(F.flatten(F.transform(words, of_word)), best)
    return F.coalesce(_bound(found, lambda similarity: round_binary(similarity, 4)), F.lit(0.0))
