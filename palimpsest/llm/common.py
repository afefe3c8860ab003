"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.sources.scratch import remove_path, remove_saved, saved, shared_dir, shared_path

#: Character class of the word separators (ASCII blanks): [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"


def char_class(chars: str, negated: bool = False) -> str:
    """A regex class of single characters.

    The JVM keeps single Latin-1 characters in one table, but tests ranges one
    after the other through virtual calls, which is many times slower once
    several patterns are in use; so classes on hot paths list characters.
    """
    return "[" + "^" * negated + "".join(f"\\x{ord(c):02x}" for c in dict.fromkeys(chars)) + "]"


WORD_REGEX = char_class(BLANKS, negated=True) + "+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row.

    A lambda variable is the only binding that the optimizer never inlines, so
    an expensive expression used inside nested lambdas isn't computed again
    for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that doesn't clash with any column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def hash_blocks(
    df: DataFrame, keys: Iterable[str], id_column: str, block_rows: int
) -> DataFrame:
    """Deals groups of rows into pairs of blocks of about `block_rows` rows.

    A group that fits in one block keeps its rows once, as block pair (0, 0).
    A larger group is cut into b blocks by a hash of `id_column`; each of its
    rows goes to the b pairs that hold its block, so that any two rows of the
    group meet in exactly one pair (a, b) with a < b, or in (a, a). No task
    gets more than about two blocks, however large a group is. Adds the
    columns block_a, block_b and block_own.
    """
    keys = list(keys)
    large = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_group_rows"))
        .where(F.col("_group_rows") > block_rows)
        .withColumn("_blocks", F.ceil(F.col("_group_rows") / F.lit(block_rows)).cast("int"))
        .drop("_group_rows")
    )
    spread = df.join(large, keys, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    spread = spread.withColumn(
        "block_own",
        F.pmod(F.xxhash64(F.lit(911), F.col(id_column)), F.col("_blocks").cast("bigint")).cast("int"),
    )
    spread = spread.withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - F.lit(1)))
    )
    return spread.withColumn("block_a", F.least("block_own", "_other")).withColumn(
        "block_b", F.greatest("block_own", "_other")
    ).drop("_other", "_blocks")
