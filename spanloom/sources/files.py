"""Trace files: listing, classification and the directories of a repo."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Repos that an error names before it counts the rest.
NAMED = 20
CHAT, TRACE, LOG, UNSUPPORTED = "native", "otel-trace", "otel-log", "unsupported"

# Fixed value: what a worktree adds to the encoded name of its repo's log directory.
WORKTREE_SUFFIX = r"-[-.]claude-worktrees-.*$"


def input_type(name: Column) -> Column:
    """Kind of an input by file name."""
    is_trace = (name == "trace.json") | (name.startswith("trace-") & name.endswith(".json"))
    return (
        F.when(name.endswith(".jsonl"), CHAT)
        .when(name == "logs.json", LOG)
        .when(is_trace, TRACE)
        .otherwise(UNSUPPORTED)
    )


def file_columns(path: Column) -> dict[str, Column]:
    return {
        "path": path,
        "name": F.regexp_extract(path, r"([^/]*)$", 1),
        "dir": F.regexp_replace(path, r"/[^/]*$", ""),
    }


def listing(spark: SparkSession, dirs: Sequence[str]) -> DataFrame:
    """Every file below ``dirs`` as ``(path, name, dir, size, input_type)``; contents are not read."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(list(dirs))
        .select("path", F.col("length").alias("size"))
    )
    return found.select(
        *[c.alias(n) for n, c in file_columns(F.col("path")).items()], "size"
    ).withColumn("input_type", input_type(F.col("name")))


def read_documents(spark: SparkSession, dirs: Sequence[str], glob: str, up_to: int | None = None) -> DataFrame:
    """JSON documents, of up to a size if given, as ``(path, name, dir, content)``, one per row."""
    docs = (
        spark.read.option("recursiveFileLookup", "true")
        .option("wholetext", "true")
        .option("pathGlobFilter", glob)
        .text(list(dirs))
        .filter(F.lit(True) if up_to is None else F.col("_metadata.file_size") <= up_to)
        .select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("p"))
    )
    named = [c.alias(n) for n, c in file_columns(F.col("p")).items()]
    return docs.select(*named, "content")


def read_lines(spark: SparkSession, dirs: Sequence[str], glob: str) -> DataFrame:
    """Lines of text files as ``(path, block, line, value)``.

    Large files stay splittable: ``(block, line)`` orders the lines of a file, because the rows of
    one split are numbered in reading order and splits are ordered by their start.
    """
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("lineSep", "\n")
        .text(list(dirs))
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            "value",
        )
    )


# ---- Log directories of a repo -------------------------------------------------------------


def encode_path(path: str) -> str:
    """Directory name under which the logs of a working directory are kept."""
    return "-" + path.removeprefix("/").replace("/", "-").replace(".", "-")


def repo_key(directory: Column) -> Column:
    """Encoded repo root shared by a checkout and its worktrees."""
    return F.regexp_replace(directory, WORKTREE_SUFFIX, "")


def repo_families(directories: DataFrame) -> DataFrame:
    """``(repo_key, directory, is_worktree)`` from a one-column frame of directory names."""
    key = repo_key(F.col("directory"))
    return directories.select(
        key.alias("repo_key"), "directory", (key != F.col("directory")).alias("is_worktree")
    )


def resolve_repo(
    directories: DataFrame, query: str, include_worktrees: bool = True
) -> DataFrame:
    """Log directories of one repo, by name or absolute path.

    Raises when nothing or more than one repo matches.
    """
    families = repo_families(directories)
    key = F.col("repo_key")
    if query.startswith("/"):
        hit = key == encode_path(query)
    else:
        hit = (key == query) | key.endswith(f"-{query}")
    matched = families.filter(hit)
    repos = matched.select("repo_key").distinct()
    keys = [r[0] for r in repos.orderBy("repo_key").limit(NAMED).collect()]
    if not keys:
        raise ValueError(f"no logs found for repo '{query}'; pass an absolute path or a directory")
    if len(keys) > 1:
        more = repos.count() - len(keys)
        rest = f" and {more} more" if more else ""
        raise ValueError(f"repo name '{query}' is ambiguous: {', '.join(keys)}{rest}")
    if not include_worktrees:
        matched = matched.filter(~F.col("is_worktree"))
    return matched.select("repo_key", "directory").orderBy("directory")


def directories_under(spark: SparkSession, root: str) -> DataFrame:
    """Names of the directories directly below ``root``, read from the file listing."""
    base = root.rstrip("/")
    paths = listing(spark, [root]).select(
        F.regexp_extract("path", rf"{_quote(base)}/([^/]+)/", 1).alias("directory")
    )
    return paths.filter("directory <> ''").distinct()


def _quote(raw: str) -> str:
    return r"\Q" + raw + r"\E"


def source_dirs(
    spark: SparkSession, source: str, projects_root: str | None = None, include_worktrees: bool = True
) -> list[str]:
    """Directories behind one source string: an existing directory, else a repo."""
    if _is_directory(spark, source):
        return [source]
    if projects_root is None:
        raise ValueError(f"'{source}' is not a directory; pass projects_root to look up a repo")
    found = resolve_repo(directories_under(spark, projects_root), source, include_worktrees)
    return [f"{projects_root.rstrip('/')}/{r['directory']}" for r in found.collect()]


def _is_directory(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path) and fs.getFileStatus(hadoop_path).isDirectory()
