"""Repo-relative identity of file paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Directory markers in paths.
AGENT_WORKTREES = ".claude/worktrees/"
GIT_WORKTREES = "worktrees/"
AGENT_DIR = "/.claude/"
PACKAGE_PATTERN = r"(?i)(?:^|/)(?:packages|apps|libs)/([^/]+)/"


def _past_segment(path: Column, marker: str) -> Column:
    """What follows the directory after ``marker``; empty when nothing follows it."""
    quoted = marker.replace(".", r"\.")
    return F.regexp_extract(path, rf"(?s)^.*?{quoted}[^/]*/?(.*)\z", 1)


def strip_worktree(path: Column) -> Column:
    return (
        F.when(path.contains(AGENT_WORKTREES), _past_segment(path, AGENT_WORKTREES))
        .when(path.contains(GIT_WORKTREES), _past_segment(path, GIT_WORKTREES))
        .otherwise(path)
    )


def with_repo_path(df: DataFrame, path: str, cwd: str, out: str) -> DataFrame:
    """Path relative to the repo, the same for every worktree; null when nothing is left."""
    given, root = F.col(path), F.col("__root")
    prefix = F.when(root.endswith("/"), root).otherwise(F.concat(root, F.lit("/")))
    below = (
        F.when(root.isNull(), given)
        .when(F.startswith(given, F.col("__prefix")),
              F.substr(given, F.length("__prefix") + 1))
        .when(given == root, F.lit(""))
        .otherwise(given)
    )
    at = F.instr("__relative", AGENT_DIR)
    anchored = F.when(
        F.col("__relative").contains(AGENT_WORKTREES) | (at == 0), F.col("__relative")
    ).otherwise(F.substr("__relative", at + 1))
    steps = [
        ("__bare", strip_worktree(given)),
        ("__root", strip_worktree(F.col(cwd))),
        ("__prefix", prefix),
        ("__relative", F.when(F.col("__bare") == given, below).otherwise(F.col("__bare"))),
        ("__clean", F.regexp_replace(anchored, "^/+", "")),
        (out, F.when((given != "") & (F.col("__clean") != ""), F.col("__clean"))),
    ]
    for name, col in steps:
        df = df.withColumn(name, col)
    return df.drop("__bare", "__root", "__prefix", "__relative", "__clean")


def package(path: Column) -> Column:
    """Workspace package of a repo path."""
    found = F.regexp_extract(path, PACKAGE_PATTERN, 1)
    return F.when(found != "", found)


def url_host(url: Column) -> Column:
    """Host of a URL, or the URL itself when there is none."""
    bare = F.regexp_replace(F.regexp_replace(url, "^https?://", ""), r"^www\.", "")
    host = F.split_part(bare, F.lit("/"), F.lit(1))
    return F.when(host != "", host).otherwise(url)
