"""Source files: scanning, choosing the ones a project owns, and listings derived from paths."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codeloom.schemas import MODULE_PARENTS, STANDARD_DIRS

MODULE_DIR = rf"^((?:{'|'.join(MODULE_PARENTS)})/[^./][^/]*)/lib/"


def scan_sources(spark: SparkSession, lake: str, suffix: str = ".dart") -> DataFrame:
    """Read a lake laid out as <lake>/<project_id>/<rel_path>; one row per file.

    The path columns come from file metadata, so a later filter on them skips whole files.
    """
    path = F.col("_metadata.file_path")
    # file URIs may carry an authority or a doubled slash; the project starts after the lake folder
    tail = F.substring_index(path, lake.rstrip("/") + "/", -1)
    return (
        spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{suffix}").load(lake)
        .select(
            F.substring_index(tail, "/", 1).alias("project_id"),
            path.alias("file_uri"),
            F.regexp_replace(tail, r"^[^/]*/", "").alias("rel_path"),
            F.col("value").alias("content"),
        )
    )


def list_sources(spark: SparkSession, lake: str, suffix: str = ".dart") -> DataFrame:
    """The manifest of a lake: (project_id, file_uri, rel_path, size, modified) of every file. Reads no file."""
    tail = F.substring_index("path", lake.rstrip("/") + "/", -1)
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(lake)
        .select(F.substring_index(tail, "/", 1).alias("project_id"), F.col("path").alias("file_uri"),
                F.regexp_replace(tail, r"^[^/]*/", "").alias("rel_path"), F.col("length").alias("size"),
                F.col("modificationTime").alias("modified"))
    )


def compare_manifests(now: DataFrame, last: DataFrame) -> DataFrame:
    """(project_id, file_uri, change): files that are `added`, `changed` or `removed` since the last manifest."""
    state = F.struct("size", "modified")
    new = now.select("project_id", "file_uri", state.alias("_new"))
    old = last.select("project_id", "file_uri", state.alias("_old"))
    change = (F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
              .when(F.col("_new") != F.col("_old"), "changed"))
    return new.join(old, ["project_id", "file_uri"], "full").select("project_id", "file_uri", change.alias("change")).filter(
        F.col("change").isNotNull())


def scan_changed(spark: SparkSession, lake: str, now: DataFrame, last: DataFrame, suffix: str = ".dart") -> DataFrame:
    """`scan_sources` for the files that are added or changed between two manifests.

    Files last modified before the oldest of these are left out when the scan is planned; of the others, a join keeps
    the ones that did change. So a normal run, in which all that is new is younger than the last manifest, reads the
    changed files alone, and a file that was moved in with an old date is still found.
    """
    fresh = compare_manifests(now, last).filter(F.col("change") != "removed").select("project_id", "file_uri")
    since = now.join(fresh, ["project_id", "file_uri"], "left_semi").agg(F.min("modified").alias("t")).first()["t"]
    rows = scan_sources(spark, lake, suffix)
    if since is None:
        return rows.limit(0)
    young = rows.filter(F.col("_metadata.file_modification_time") >= F.lit(since))
    return young.join(fresh, ["project_id", "file_uri"], "left_semi")


def top_dir(rel_path: Column) -> Column:
    return F.substring_index(rel_path, "/", 1)


def _hidden(path: Column) -> Column:
    return path.rlike(r"(?:^|/)\.[^/]*/")


def _within(parts: Column, depth: int | None, above: int) -> Column:
    return F.lit(True) if depth is None else parts <= depth + above


def custom_dirs(listing: DataFrame, depth: int | None = None) -> DataFrame:
    """Top-level directories with Dart files, at most `depth` levels down if given; standard ones left out."""
    rel = F.col("rel_path")
    parts = F.size(F.split(rel, "/"))
    top = top_dir(rel)
    return (
        listing
        .filter(rel.endswith(".dart") & (parts >= 2) & _within(parts, depth, 1) & ~_hidden(rel))
        .filter(~top.startswith("_") & ~top.isin(STANDARD_DIRS))
        .select("project_id", top.alias("dir")).distinct()
    )


def module_dirs(listing: DataFrame, depth: int | None = None) -> DataFrame:
    """Parents of <group>/*/lib that hold Dart files, at most `depth` levels below lib if given."""
    rel = F.col("rel_path")
    parts = F.size(F.split(rel, "/"))
    found = F.regexp_extract(rel, MODULE_DIR, 1)
    return (
        listing
        .filter(rel.endswith(".dart") & (found != "") & _within(parts, depth, 3) & ~_hidden(rel))
        .select("project_id", found.alias("dir")).distinct()
    )


def extra_source_dirs(listing: DataFrame) -> DataFrame:
    """Custom directories, then the modular ones not already among them."""
    custom = custom_dirs(listing)
    fresh = module_dirs(listing).join(custom, ["project_id", "dir"], "left_anti")
    return custom.unionByName(fresh)


def rooted_projects(listing: DataFrame) -> DataFrame:
    return listing.filter(F.col("rel_path") == "pubspec.yaml").select("project_id").distinct()


def matched_files(listing: DataFrame) -> DataFrame:
    """(project_id, file_uri, rel_path, pattern), one row per pattern a file answers to."""
    rel = F.col("rel_path")
    dart = listing.filter(rel.endswith(".dart"))
    rooted = rooted_projects(listing)
    usable = dart.filter(~rel.rlike(r"(?:^|/)\.dart_tool/"))
    lib = usable.filter(rel.startswith("lib/")).join(rooted, "project_id", "left_semi") \
        .withColumn("pattern", F.lit("lib/**/*.dart"))
    loose = usable.join(rooted, "project_id", "left_anti").withColumn("pattern", F.lit("**/*.dart"))
    # a file's possible directories: its top directory and its module directory
    dirs = extra_source_dirs(listing).join(rooted, "project_id", "left_semi")
    custom = (
        dart.filter(~rel.rlike(r"(?:^|/)\.")).withColumn(
            "dir", F.explode(F.array_distinct(F.array(top_dir(rel), F.regexp_extract(rel, MODULE_DIR, 1)))))
        .join(dirs, ["project_id", "dir"], "left_semi")
        .withColumn("pattern", F.concat("dir", F.lit("/**/*.dart")))
    )
    return reduce_union([lib, loose, custom], ["project_id", "file_uri", "rel_path", "pattern"])


def reduce_union(frames: list[DataFrame], cols: list[str]) -> DataFrame:
    out = frames[0].select(*cols)
    for f in frames[1:]:
        out = out.unionByName(f.select(*cols))
    return out


def distinct_files(matched: DataFrame) -> DataFrame:
    return matched.select("project_id", "file_uri", "rel_path").dropDuplicates(["project_id", "file_uri"])


def files_per_pattern(matched: DataFrame) -> DataFrame:
    return matched.groupBy("project_id", "pattern").agg(F.count("*").alias("n_files"))


def ancestors(path: Column) -> Column:
    """The path itself and every directory above it, as an array."""
    parts = F.split(path, "/")
    return F.filter(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")),
        lambda p: p != "",
    )


def nearest_roots(paths: DataFrame, marker_dirs: DataFrame) -> DataFrame:
    """For every start path its nearest ancestor that is a marker directory, however far up; null when none.

    paths(project_id, path), marker_dirs(project_id, dir). Only the distinct directories fan out.
    """
    starts = paths.select("project_id", "path").distinct()
    up = starts.withColumn("dir", F.explode(ancestors(F.col("path"))))
    found = (
        up.join(marker_dirs.select("project_id", "dir").distinct(), ["project_id", "dir"])
        .groupBy("project_id", "path").agg(F.max_by("dir", F.length("dir")).alias("root"))
    )
    return starts.join(found, ["project_id", "path"], "left")


def package_files(listing: DataFrame, limit: int | None = None, depth: int | None = None) -> DataFrame:
    """Dart files below the lib folder of each package with their rank in path order; all, unless cut on request.

    listing(project_id, package, lib_path): lib_path is relative to the lib folder.
    """
    rel = F.col("lib_path")
    w = Window.partitionBy("project_id", "package").orderBy("lib_path")
    ranked = (
        listing.filter(rel.endswith(".dart") & _within(F.size(F.split(rel, "/")), depth, 1) & ~_hidden(rel))
        .withColumn("rank", F.row_number().over(w))
    )
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def main_files(listed: DataFrame) -> DataFrame:
    """The first file per package named after the package or `main`."""
    base = F.regexp_replace(F.substring_index("lib_path", "/", -1), r"\.dart\z", "")
    return (
        listed.filter((base == F.col("package")) | (base == "main"))
        .groupBy("project_id", "package").agg(F.min_by("lib_path", "rank").alias("main_file"))
    )


def load_status(trees: DataFrame) -> DataFrame:
    """Per project: analysed, empty and failed files, and whether no file gave a symbol."""
    status = F.col("status")
    return trees.groupBy("project_id").agg(
        F.count_if(status == "ok").alias("analysed"),
        F.count_if(status == "empty").alias("empty"),
        F.count_if(status == "error").alias("failed"),
        F.count("*").alias("files"),
        (F.count_if(status == "ok") == 0).alias("no_symbols"),
    )
