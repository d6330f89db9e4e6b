"""Searches by name pattern, type and owner, over one or many volumes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import regex
from ..schema import SELECTABLE
from . import tree


@dataclass(frozen=True)
class Query:
    """A pattern on names, unanchored; a type of SELECTABLE or None; a uid or None."""

    pattern: str
    type: str | None = None
    uid: int | None = None

    def explain(self) -> str:
        return regex.explain(self.pattern)

    def hits(self, entries: DataFrame) -> DataFrame:
        """The rows that match. A hardlink has no owner of its own and never matches a uid, 0 included."""
        out = entries.filter(regex.matches(F.col("name"), self.pattern))
        if self.type is not None:
            out = out.filter(F.col("type") == SELECTABLE[self.type])
        if self.uid is not None:
            out = out.filter((F.col("uid") == self.uid) & (F.col("type") != "h"))
        return out


RESULT = ["type", "uid", "size", "mtime", "ctime", "path"]


def search(query: Query, entries: DataFrame, dirs: DataFrame, prefix: str) -> DataFrame:
    """type, uid, size, mtime, ctime and full path of every match, in no order."""
    return tree.with_paths(query.hits(entries), dirs, prefix).select(*RESULT)


def search_names(names: list[str], entries: DataFrame, dirs: DataFrame, prefix: str) -> DataFrame:
    """The matches of a list of exact names."""
    return tree.with_paths(entries.filter(F.col("name").isin(names)), dirs, prefix).select(*RESULT)


def search_volumes(query: Query, volumes: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """One search over many volumes, name -> (entries, dirs, prefix), with a ``volume`` column."""
    parts = [search(query, *volumes[v]).withColumn("volume", F.lit(v)) for v in sorted(volumes)]
    return reduce(DataFrame.unionByName, parts)


def named_paths(names: list[str], entries: DataFrame, dirs: DataFrame, prefix: str) -> DataFrame:
    """Paths of all entries with one of the names, for names that are asked for again and again."""
    return tree.with_paths(
        entries.filter(F.col("name").isin(names)),
        dirs,
        prefix,
    ).select("name", "type", "uid", "size", "mtime", "ctime", "path")


def tsv(results: DataFrame) -> DataFrame:
    """Lines of uid, size, mtime and path; a hardlink's uid is ``-``."""
    uid = F.when(F.col("type") == "h", "-").otherwise(F.col("uid").cast("string"))
    return results.select(F.concat_ws("\t", uid, F.col("size").cast("string"), F.col("mtime").cast("string"), "path").alias("line"))


def short_tsv(results: DataFrame) -> DataFrame:
    """Lines of uid and path; a hardlink's uid is ``-``."""
    uid = F.when(F.col("type") == "h", "-").otherwise(F.col("uid").cast("string"))
    return results.select(F.concat_ws("\t", uid, "path").alias("line"))
