"""Packages and files: package maps, the longest prefix of a path, and what a file belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import paths
from codefacts.functions.symbols import file_symbol

NAME = r"^[A-Za-z0-9._-]+@[A-Za-z0-9._-]+$"


def is_valid(package: Column) -> Column:
    """name@version, both of letters, digits, dots, underscores and hyphens."""
    return F.coalesce(package.rlike(NAME), F.lit(False))


def load_map(entries: DataFrame) -> DataFrame:
    """root, name, version of valid entries (ord, path, package); the first entry of a root wins."""
    first = entries.where(is_valid(F.col("package"))).groupBy("path").agg(F.min_by("package", "ord").alias("package"))
    return first.select(F.col("path").alias("root"), F.substring_index("package", "@", 1).alias("name"), F.substring_index("package", "@", -1).alias("version"))


def require_root(packages: DataFrame, project_root: str) -> DataFrame:
    """packages, or an error if the project's own root isn't among them."""
    if packages.where(F.col("root") == project_root).isEmpty():
        raise ValueError(f"no package for the project root {project_root}")
    return packages


def conflicts(entries: DataFrame) -> DataFrame:
    """Roots that valid entries give to different packages."""
    return entries.where(is_valid(F.col("package"))).groupBy("path").agg(F.count_distinct("package").alias("n")).where("n > 1")


def longest_prefix(files: DataFrame, packages: DataFrame) -> DataFrame:
    """files (path) with the package of the longest root above them, or nulls.

    Ancestors of each different path are listed and joined by equality, so no range or prefix join is needed; the map has
    a row per package root and the optimizer may broadcast it.
    """
    tried = files.select("path").distinct().withColumn("root", F.explode(paths.prefixes(F.col("path"))))
    best = tried.join(packages, "root").groupBy("path").agg(F.max_by(F.struct("root", "name", "version"), F.length("root")).alias("p"))
    return files.join(best, "path", "left").select(*files.columns, F.col("p.root").alias("root"), F.col("p.name").alias("name"), F.col("p.version").alias("version"))


def classify(files: DataFrame, packages: DataFrame, project_root: str, build_root: str) -> DataFrame:
    """files (path, real_path of the file below the project if it is a copy in the build folder, or null) with kind and stable path.

    A package root decides first; then the build folder, whose files stand for a project file only if that is its own real
    path (else it is external, without a look at the project root); then the project root; everything else is external.
    """
    found = longest_prefix(files, packages)
    path = F.col("path")
    in_build, in_project = paths.relative(path, F.lit(build_root)), paths.relative(path, F.lit(project_root))
    rooted = paths.join(F.lit(project_root), in_build)
    kind = F.when(F.col("root").isNotNull(), "package").when(in_build.isNotNull(), F.when(F.col("real_path").eqNullSafe(rooted), "build").otherwise("external"))
    kind = kind.when(in_project.isNotNull(), "project").otherwise("external")
    out = found.withColumn("kind", kind)
    stable = F.when(F.col("kind") == "package", paths.relative(path, F.col("root"))).when(F.col("kind") == "build", in_build).when(F.col("kind") == "project", in_project)
    return out.withColumn("stable_path", stable.otherwise(paths.external_path(path))).withColumn("is_in_project", F.col("kind").isin("project", "build")).withColumn("is_synthetic", F.col("kind") == "external")


def include_references(includes: DataFrame, files: DataFrame, package: Column, version: Column) -> DataFrame:
    """A reference to the file symbol of each included file (path, hash) that is known; others have none."""
    known = files.select("path", "hash").distinct()
    return includes.join(known, ["path", "hash"]).withColumn("symbol", file_symbol(package, version, F.col("path")))
