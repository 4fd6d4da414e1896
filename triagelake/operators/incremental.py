"""What changed between two snapshots of a source tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.functions.languages import language_extensions, with_extensions

#: What names a file where all rows are of one repository.
PATH = ("path",)


def compare_manifests(new: DataFrame, old: DataFrame, by: Sequence[str] = PATH) -> DataFrame:
    """``by``, ``hash`` and ``status``: new, changed, same or deleted.

    ``by`` names a file; with several repositories in one table it holds their key too.
    """
    n = new.select(*by, F.col("hash").alias("new_hash"))
    o = old.select(*by, F.col("hash").alias("old_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("new_hash") == F.col("old_hash"), "same")
        .otherwise("changed")
    )
    return n.join(o, [*by], "full").select(
        *by, F.coalesce("new_hash", "old_hash").alias("hash"), status.alias("status")
    )


def changed_files(
    new: DataFrame, old: DataFrame | None, extensions: list[str] | None = None, by: Sequence[str] = PATH
) -> DataFrame:
    """Files to scan: new or changed ones, all of them without an old snapshot."""
    if extensions:
        new = new.where(with_extensions(F.col("path"), extensions))
    if old is None:
        return new.select(*by, "hash")
    # A pair that is in both snapshots is unchanged; everything else of the new one is work.
    return new.select(*by, "hash").join(old.select(*by, "hash"), [*by, "hash"], "left_anti")


def files_for_language(
    new: DataFrame, old: DataFrame | None, language: str, only_changed: bool = True, by: Sequence[str] = PATH
) -> DataFrame:
    """``(path, hash)`` of one language's files, changed ones only or all; none for an unknown language."""
    extensions = language_extensions(language)
    if not extensions:
        return new.select(*by, "hash").limit(0)
    return changed_files(new, old if only_changed else None, extensions, by)
