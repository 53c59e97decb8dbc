"""What several operators share: reading tables, words, and columns whose names may clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores after it if ``df`` has such a column (names compare without case)."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns with these names, compared without case."""
    gone = {name.lower() for name in names}
    return df.select(*[quoted(name) for name in df.columns if name.lower() not in gone])


def quoted(name: str) -> Column:
    """The column of this very name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Rows of a cell of the id range, and the most cells.
CELL_ROWS, CELLS = 500, 4096


def id_cell(df: DataFrame, doc_id: str, key: Column, rows: int = CELL_ROWS, most: int = CELLS) -> Column:
    """The number of the id range that ``key`` lies in, ascending; 0 for null ids only.

    ``df`` gives the edges, from approximate quantiles of its ids: their number, not that of the rows, is bounded. Unlike
    repartitionByRange this does not run the query twice.
    """
    cells = min(most, df.select(quoted(doc_id)).count() // rows + 1)
    shares = [at / cells for at in range(1, cells)]
    found = df.agg(F.percentile_approx(quoted(doc_id), shares, 20 * most)).first()[0] if shares else None
    edges = sorted(set(found or []))
    inside = F.size(F.filter(F.lit(edges), lambda edge: edge < key)) + 1 if edges else F.lit(1)
    return F.when(key.isNull(), F.lit(0)).otherwise(inside).cast("int")
