"""Source trees: file listing with hashes, and numbered lines."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions.languages import IGNORED_DIRECTORIES, outside_ignored, with_extensions
from triagelake.session import local_table, stored

MAX_FILE_BYTES = 10 * 1024 * 1024
FOLDERS_PER_TASK = 64
FILES_PER_TASK = 1024
BYTES_PER_TASK = 128 * 1024 * 1024
LISTED_AT_ONCE = 10_000


def read_tree(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """All files below ``root`` as ``(path, length, content)``; paths are relative to it.

    The optional size limit is pushed into the scan, so larger files are never read. Spark's
    file index skips names that start with a dot or an underscore; where those matter (as
    ``__init__.py`` does), use :func:`walk_tree`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    marker = root.rstrip("/").split("://")[-1].lstrip("/") + "/"
    return files.select(
        F.expr(f"substring(path, locate('{marker}', path) + {len(marker)})").alias("path"), "length", "content"
    )


def _file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, ``hdfs``, ``s3``, ``gs``) and the root's path in it."""
    if "://" not in root:
        return fs.LocalFileSystem(), os.path.abspath(root)
    return fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))


def _list_level(root: str):
    """List folders, given relative to the root: one row per file or folder directly inside."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _file_system(root)
        local = isinstance(files, fs.LocalFileSystem)
        for frame in frames:
            for folder in frame["path"]:
                chosen = fs.FileSelector(posixpath.join(base, folder), allow_not_found=True)
                inside = [i for i in files.get_file_info(chosen) if i.type in (fs.FileType.File, fs.FileType.Directory)]
                # As in a walk, links to folders are not followed, so a link cannot lead round in a circle.
                inside = [i for i in inside if i.is_file or not (local and os.path.islink(i.path))]
                for start in range(0, len(inside), LISTED_AT_ONCE):
                    some = inside[start : start + LISTED_AT_ONCE]
                    yield pd.DataFrame(
                        {
                            "path": [posixpath.join(folder, i.base_name) for i in some],
                            "length": [i.size if i.is_file else 0 for i in some],
                            "folder": [not i.is_file for i in some],
                        }
                    )

    return run


def _read_below(root: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _file_system(root)
        for frame in frames:
            for path, length in zip(frame["path"], frame["length"]):
                with files.open_input_stream(posixpath.join(base, path)) as f:
                    yield pd.DataFrame({"path": [path], "length": [length], "content": [f.read()]})

    return run


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length)`` of all files below ``root`` outside ignored folders, hidden names included.

    Tasks list the folders, level by level, the root among them; each level is stored, so a lost executor repeats one
    task's folders. The number of tasks follows the number of folders, however they hang together. Ignored folders are never entered.
    An empty or missing root has no files.
    """
    found = []
    level = local_table(spark, [("",)], "path string")
    while True:
        listed = stored(level.mapInPandas(_list_level(root), "path string, length long, folder boolean"), "tree")
        found.append(listed.where("NOT folder").select("path", "length"))
        name = F.substring_index("path", "/", -1)
        folders = listed.where(F.col("folder") & ~name.isin(IGNORED_DIRECTORIES)).select("path")
        n = folders.count()
        if n == 0:
            return reduce(DataFrame.unionByName, found).where(outside_ignored(F.col("path")))
        level = folders.repartition(-(-n // FOLDERS_PER_TASK), "path")


def walk_tree(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """As :func:`read_tree`, hidden names included, from any file system all nodes reach.

    Files above the size limit are taken out of the listing; the others are dealt to tasks by their number and
    bytes, and read one at a time.
    """
    listed = list_tree(spark, root)
    if max_bytes is not None:
        listed = listed.where(F.col("length") <= max_bytes)
    files, size = listed.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, -(-files // FILES_PER_TASK), -(-size // BYTES_PER_TASK))
    return listed.repartition(tasks, "path").mapInPandas(_read_below(root), "path string, length long, content binary")


def list_files(files: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """``(path, hash)`` of files outside ignored folders, with the SHA-256 of their content."""
    kept = files.where(outside_ignored(F.col("path")))
    if extensions:
        kept = kept.where(with_extensions(F.col("path"), extensions))
    return kept.select("path", F.sha2("content", 256).alias("hash"))


def numbered_lines(files: DataFrame) -> DataFrame:
    """``(file_path, line_number, line)`` from 1."""
    return files.select("file_path", F.posexplode(F.split("content", "\n", -1)).alias("i", "line")).select(
        "file_path", (F.col("i") + 1).alias("line_number"), "line"
    )
