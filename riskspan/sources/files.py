"""Source files as rows: a recursive scan, decoded texts and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, decoded, lines_of
from ..operators.slicing import kept_files

# Suffixes of source files.
SUFFIXES = (".sol", ".go", ".ride", ".vy", ".rs")


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: ** crosses folders, * and ? do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or "\\" * (not glob[i].isalnum() and glob[i] not in "/_") + glob[i]
            i += 1
    return f"^{out}$"


def scan(
    spark: SparkSession, root: str, globs: list[str] = [], suffixes: tuple[str, ...] = SUFFIXES, exclude_dirs: list[str] = [], exclude_names: list[str] = [], max_bytes: int = 400_000
) -> DataFrame:
    """All source files below `root`: file (path below the root), content, n_bytes.

    Files that match one of the globs; if none does, every file. Of these, files of a listed suffix and of 1 to max_bytes
    bytes, without excluded folders and names. Sizes and paths are decided before contents are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    rows = files.select(F.substring_index("path", base, -1).alias("file"), F.col("length").alias("n_bytes"), "content")
    if globs:
        named = F.exists(F.array(*[F.lit(glob_pattern(g)) for g in globs]), lambda g: F.regexp_like(F.col("file"), g))
        if not rows.select("file").where(named).isEmpty():
            rows = rows.where(named)
    return kept_files(rows, exclude_dirs, exclude_names, list(suffixes), max_bytes)


def measured(files: DataFrame) -> DataFrame:
    """Files (file, content and others) with text, sha256, n_lines and n_bytes. Invalid UTF-8 is replaced; no content: no text."""
    text = decoded(F.col("content"))
    out = files.withColumns({"text": text, "sha256": content_hash(F.col("content")), "n_bytes": F.coalesce(F.length("content"), F.lit(0)).cast("bigint")})
    return out.withColumn("n_lines", lines_of(F.col("text"))).drop("content")


def corpus(spark: SparkSession, raw_dir: str, specs: list[dict], **limits) -> DataFrame:
    """The source files of several protocols (name, root, tier, language, repo, paths), one scan each; missing folders give none."""
    import os

    out = None
    for spec in specs:
        folder = os.path.join(raw_dir, spec.get("root") or spec["name"])
        if not os.path.isdir(folder):
            continue
        found = measured(scan(spark, folder, spec.get("paths") or [], **limits))
        language = F.lit(spec["language"]) if spec.get("language") else F.element_at(F.split("file", r"\."), -1)
        found = found.select(F.lit(spec["name"]).alias("protocol"), F.lit(spec.get("tier", "study")).alias("tier"), language.alias("language"), F.lit(spec.get("repo", "")).alias("repo"), "file", "text", "sha256", "n_lines", "n_bytes")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "protocol string, tier string, language string, repo string, file string, text string, sha256 string, n_lines bigint, n_bytes bigint")
    return out
