"""What each of several filters does in each order in which they may be applied.

A document is reduced to a mask of the filters that it fails; documents of one
part and mask and with the same labels are counted together, and these mask
cells are all that is evaluated. Each cell is unpivoted against the steps of
every order; a running bit-or over the earlier steps of an order tells which
failures came before, and conditional sums over the cells give the numbers. The
sum of a filter's removals over all orders is a total over the window of that
filter.

The duplicate filter needs no document to meet its copies: rows of an equal
text are counted by id first, then by digest with the number of rows at the
smallest id, so a text that a third of the table shares is aggregated before
each shuffle.

Defined cases: a null text is empty, hence a copy of other empty ones; a null
part is the empty string; a null id neither removes a copy nor is removed as
one, and has no labels; rows of one id are counted each, and none of them is
the other's copy; of several label rows of an id, one that says 1 is enough; an
empty table has no part and gives no rows; very long texts are counted whole;
only the named columns are read, so further columns never clash.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = "\t\n\x0b\x0c\r"
FLAGS = {"good": "quality", "toxic": "toxic"}


def words(text: Column) -> Column:
    """Maximal runs of ``[^\\x20\\x09-\\x0D]``."""
    return F.filter(F.split(F.translate(text, BLANK, " " * len(BLANK)), " "), lambda w: w != "")


def standard_filters(text: Column, ws: Column) -> dict[str, Column]:
    """Failure conditions by letter; the duplicate filter is added by :func:`mask_cells`."""
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(ws) < 100,
        "B": 100 * F.size(F.array_distinct(ws)) < 80 * F.size(ws),
        "C": 100 * capitals > 10 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_cells(
    docs: DataFrame, labels: DataFrame, *, filters=standard_filters, id_col: str = "doc_id", text_col: str = "text",
    part_col: str = "lang", flags: Mapping[str, str] = FLAGS
) -> DataFrame:
    """(part, mask, ``flags`` .., n): documents of a part by the filters they fail.
    The lowest bit is the first filter's; the highest is the duplicate filter's."""
    read = docs.select(
        F.col(f"`{id_col}`").alias("i"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")
    ).withColumn("w", words(F.col("t")))
    conditions = list(filters(F.col("t"), F.col("w")).values())
    mask = sum((c.cast("int") * (1 << k) for k, c in enumerate(conditions)), F.lit(0))
    rows = read.select("i", "part", F.sha2(F.encode("t", "UTF-8"), 256).alias("text"), mask.alias("mask"))
    rows = rows.groupBy("i", "part", "text", "mask").agg(F.count(F.lit(1)).alias("n"))
    marked = labels.groupBy(F.col(f"`{id_col}`").alias("i")).agg(
        *[F.max((F.col(f"`{c}`") == 1).cast("int")).alias(k) for k, c in flags.items()]
    )
    known = rows.join(marked, "i", "left").select(
        "i", "part", "text", "mask", "n", *[F.coalesce(k, F.lit(0)).alias(k) for k in flags]
    )
    by = ["text", "part", "mask", *flags]
    per_text = known.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("i").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("i").isNotNull(), F.struct("i", "n"))).alias("least")
    )
    # some ids may have the least id in several cells of a text: a text has few cells
    smallest = F.min("least.i").over(Window.partitionBy("text"))
    first = F.col("unnamed") + F.when(F.col("least.i") == F.col("smallest"), F.col("least.n")).otherwise(0)
    split = per_text.withColumn("smallest", smallest).withColumn("first", first)
    bit = 1 << len(conditions)
    cells = split.select(
        "part", *flags,
        F.explode(F.array(
            F.struct(F.col("mask"), F.col("first").alias("n")),
            F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("first")).alias("n"))
        )).alias("c")
    ).select("part", *flags, "c.mask", "c.n").where("n > 0")
    return cells.groupBy("part", "mask", *flags).agg(F.sum("n").alias("n"))


def evaluate_orders(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """A row for each part, order and step of :func:`mask_cells`."""
    steps = F.array(*[
        F.struct(F.lit("".join(o)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(1 << letters.index(c)).alias("bit"))
        for o in permutations(letters) for k, c in enumerate(o)
    ])
    long = cells.select("part", "mask", "good", "toxic", "n", F.explode(steps).alias("s")).select(
        "part", "mask", "good", "toxic", "n", "s.*"
    )
    order = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step")
    failed = F.col("mask").bitwiseAND(F.col("bit"))
    before = F.coalesce(F.bit_or(failed).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    long = long.withColumn("fails", failed != 0).withColumn("gone", before != 0)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    here = F.col("fails") & ~F.col("gone")
    out = long.groupBy("part", "filter_order", "step", "bit").agg(
        total(~F.col("fails") & ~F.col("gone")).alias("kept"), total(here).alias("removed"),
        total(F.col("fails") & F.col("gone")).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here & (F.col("good") == 1)).alias("good_lost"), total(here & (F.col("toxic") == 1)).alias("toxic_lost")
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))
    return out.withColumn("shapley", shapley.cast("long")).drop("bit")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return evaluate_orders(mask_cells(docs, labels))
