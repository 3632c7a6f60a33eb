"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use``.

    Higher-order functions evaluate their lambda body per element, so anything
    costly a lambda needs has to be bound outside it.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _running_part(lengths: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), empty("int").alias("found"))
    folded = F.aggregate(
        lengths,
        start,
        lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"), F.concat(acc["found"], F.array(acc["at"] + n)).alias("found")
        ),
    )
    return folded["found"]


def running(lengths: Column, part: int = 64) -> Column:
    """Running totals of an integer array.

    Appending inside a fold copies the array, so the fold runs over short parts
    whose totals are then added up.
    """

    def over(values: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / part).cast("int"))
        parts = F.transform(
            starts, lambda i: _running_part(F.slice(values, i * part + 1, F.lit(part)))
        )
        return F.when(F.size(values) > 0, let(parts, shifted)).otherwise(empty("int"))

    def shifted(parts: Column) -> Column:
        ends = F.transform(parts, lambda p: F.element_at(p, -1))
        return let(
            _running_part(ends),
            lambda bases: F.flatten(
                F.transform(
                    parts,
                    lambda p, i: let(
                        F.coalesce(F.get(bases, i - 1), F.lit(0)),
                        lambda base: F.transform(p, lambda x: x + base),
                    ),
                )
            ),
        )

    return let(lengths, over)


def ordered_text(rows: Column, separator: str) -> Column:
    """Join the ``text`` fields of collected ``struct<position, text>`` rows in order."""
    return F.array_join(F.transform(F.sort_array(rows), lambda r: r["text"]), separator)


def exploded(
    df: DataFrame, keep: Sequence[str | Column], array: str | Column, value: str, position: str = "_pos"
) -> DataFrame:
    """Explode without the ``size(array) > 0`` filter Spark would infer.

    That filter is pushed below the projection and makes an expensive array
    expression run twice; the outer form with a test on the position does not.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, value))
    rows = rows.where(F.col(position).isNotNull())
    return rows.drop("_pos") if position == "_pos" else rows
