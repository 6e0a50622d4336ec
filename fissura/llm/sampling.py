"""Held-out folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def held_out(id_col: str) -> Column:
    return F.coalesce(fold(id_col) == 0, F.lit(False))


def labelled_sample(df: DataFrame, id_col: str, label_col: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label, or all there are, outside fold 0.

    A row is in by the hash of its id, so the sample does not depend on the
    order of rows. Null ids and labels are left out. Labels are few: they are
    counted on the driver.
    """
    usable = df.filter((fold(id_col) != 0) & F.col(label_col).isNotNull())
    sizes = {r[0]: r[1] for r in usable.groupBy(label_col).count().collect()}
    draw = F.pmod(F.xxhash64(id_col, F.lit(20)), F.lit(1 << 20))
    chosen = F.lit(False)
    for label, n in sorted(sizes.items(), key=str):
        share = min(1 << 20, -(-per_label * (1 << 20) // n))
        chosen = chosen | ((F.col(label_col) == label) & (draw < share))
    return usable.filter(chosen)
