"""Working folders as projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOME = "/home/user"


def clean(path: Column) -> Column:
    """Without empty, "." and ".." segments."""
    absolute = F.startswith(path, F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))

    def step(done: Column, part: Column) -> Column:
        size = F.size(done)
        up = (part == "..") & (size > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return F.when(up, F.slice(done, F.lit(1), F.greatest(size - 1, F.lit(0)))).when((part == "..") & absolute, done).otherwise(F.array_append(done, part))

    kept = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(absolute, F.concat(F.lit("/"), kept)).when(kept == "", F.lit(".")).otherwise(kept)


def is_workspace(path: Column, home: str = HOME) -> Column:
    """Whether a cleaned path is a scratch folder that tools make for themselves."""
    dated = rf"^{home}/Documents/Codex/([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})/[^/]"
    day = F.regexp_extract(path, dated, 1)
    return (
        F.try_to_date(F.nullif(day, F.lit("")), "yyyy-MM-dd").isNotNull()
        | path.rlike(rf"^{home}/Library/Application Support/Claude/scratch-workspaces/[^/]")
        | path.rlike(r"^(/private)?/tmp/(claude-|magpie-claude-work-)[^/]")
        | path.rlike(r"^/?(private/)?var/folders/[^/]+/[^/]+/T/magpie-claude-work-[^/]")
    )


def with_project(df: DataFrame, home: str = HOME) -> DataFrame:
    """df with `project`, the struct(kind, path, name) of its folder `cwd`; the cleaned path is made once."""
    of = lambda kind, path, name: F.struct(F.lit(kind).alias("kind"), path.alias("path"), name.alias("name"))
    none, tidy, cwd = F.lit(""), F.col("tidy_"), F.col("cwd")
    base = F.when(tidy == "/", "/").otherwise(F.element_at(F.split(tidy, "/"), -1))
    found = F.when(cwd == "", of("projectless", none, none)).when(is_workspace(tidy, home), of("workspace", cwd, none)).otherwise(of("project", cwd, base))
    return df.withColumn("tidy_", clean(cwd)).withColumn("project", found).drop("tidy_")


def unknown() -> Column:
    return F.struct(F.lit("unknown").alias("kind"), F.lit("").alias("path"), F.lit("").alias("name"))
