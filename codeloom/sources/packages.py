"""Package manifests: resolved locations, descriptor facts, types."""

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions.text import strip
from codeloom.schemas import OFFICIAL_PACKAGES, PACKAGE_CONFIG
from codeloom.sources.files import ancestors


def normalize_path(path: Column) -> Column:
    """Resolve `.`, `..` and doubled slashes of an absolute path."""
    def fold(acc: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), acc)
            .when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(part)))
        )
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), fold)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def uri_path(uri: Column) -> Column:
    """Path of a file URI, percent escapes decoded; any other text is returned as it is."""
    raw = F.regexp_replace(uri, r"^file://[^/]*", "")
    decoded = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.when(uri.startswith("file://"), F.coalesce(decoded, raw)).otherwise(uri)


def resolve_root(root_uri: Column, config_dir: Column) -> Column:
    plain = uri_path(root_uri)
    return normalize_path(F.when(plain.startswith("/"), plain).otherwise(F.concat(config_dir, F.lit("/"), plain)))


def read_package_configs(configs: DataFrame) -> DataFrame:
    """configs(project_id, config_dir, text) -> one row per named package with its resolved path."""
    parsed = configs.withColumn("cfg", F.from_json("text", PACKAGE_CONFIG))
    return (
        parsed.select("project_id", "config_dir", F.posexplode("cfg.packages").alias("pkg_ord", "p"))
        .filter((F.col("p.name") != "") & (F.col("p.rootUri") != ""))
        .select(
            "project_id", "pkg_ord", F.col("p.name").alias("name"), F.col("p.rootUri").alias("root_uri"),
            resolve_root(F.col("p.rootUri"), F.col("config_dir")).alias("path"),
            F.when(F.col("p.version") != "", F.col("p.version")).otherwise("unknown").alias("version"),
        )
    )


def existing_packages(packages: DataFrame, dirs: DataFrame) -> DataFrame:
    """Drop packages whose path is not among dirs(project_id, path)."""
    return packages.join(dirs, ["project_id", "path"], "left_semi")


def describe(packages: DataFrame, pubspecs: DataFrame) -> DataFrame:
    """Add framework flag and description from the package's own descriptor text."""
    text = F.col("spec")
    found = pubspecs.select("project_id", F.col("dir").alias("path"), F.col("content").alias("spec"))
    desc = F.regexp_extract(text, r"description:\s*(.+)", 1)
    return (
        packages.join(found, ["project_id", "path"], "left")
        .withColumn("is_flutter", F.coalesce(text.contains("sdk: flutter"), F.lit(False)))
        .withColumn("description", F.coalesce(F.regexp_replace(strip(desc), "['\"]", ""), F.lit("")))
        .drop("spec")
    )


def with_files(packages: DataFrame, listing: DataFrame) -> DataFrame:
    """Add has_lib and n_files, the Dart files below the package's folder; listing(project_id, path).

    A file counts for every package folder above it. Only distinct directories fan out to their ancestors.
    """
    folder = F.regexp_replace("path", r"/[^/]*\z", "")
    dirs = listing.filter(F.col("path").endswith(".dart")).groupBy("project_id", folder.alias("dir")).agg(F.count("*").alias("_n"))
    above = dirs.select("project_id", "dir", "_n", F.explode(ancestors(F.col("dir"))).alias("_root"))
    in_lib = (F.col("dir") == F.concat("_root", F.lit("/lib"))) | F.col("dir").startswith(F.concat("_root", F.lit("/lib/")))
    found = above.groupBy("project_id", "_root").agg(F.sum("_n").alias("n_files"), F.max(in_lib).alias("has_lib"))
    return packages.withColumn("_root", F.regexp_replace("path", r"/\z", "")).join(found, ["project_id", "_root"], "left").drop(
        "_root").fillna(0, ["n_files"]).fillna(False, ["has_lib"])


def descriptor_entries(projects: DataFrame) -> DataFrame:
    """projects(project_id, root_spec) -> (project_id, section, key, has_path): the entries of a descriptor's sections.

    A section is an unindented key; its entries are the keys at the indentation of its first line. An entry has a path
    if the line below it is a `path`. The text is read here once; only these short rows go on.
    """
    text = F.regexp_replace(F.regexp_replace("root_spec", r"\r\n?", "\n"), r"(?m)^[ \t]*(?:#.*)?(?:\n|\z)", "")
    sections = F.regexp_extract_all(text, F.lit(r"(?m)^[^\s:][^:\n]*:.*(?:\n[ \t].*)*"), 0)
    rows = projects.filter(F.col("root_spec").isNotNull()).select("project_id", F.explode(sections).alias("part")).select(
        "project_id", _key("part").alias("section"), F.split(F.regexp_replace("part", r"\A.*\n?", ""), "\n").alias("lines"))
    lines = rows.select("project_id", "section", _indent(F.col("lines")[0]).alias("depth"), F.posexplode("lines").alias("i", "line"),
                        F.col("lines").alias("all")).select(
        "project_id", "section", "depth", "line", F.get("all", F.col("i") + 1).alias("below"))
    entries = lines.filter((_indent(F.col("line")) == F.col("depth")) & F.col("line").contains(":"))
    below = F.col("below").rlike(r"^\s+path:") & (_indent(F.col("below")) > F.col("depth")) & F.col("line").rlike(r":\s*\z")
    return entries.select("project_id", "section", _key("line").alias("key"), F.coalesce(below, F.lit(False)).alias("has_path"))


def _key(line: str) -> Column:
    return F.regexp_replace(strip(F.regexp_extract(line, r"^\s*([^:\n]+):", 1)), "['\"]", "")


def _indent(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^[ \t]*", 0))


def package_type(name: Column, path: Column, root: Column, declared: Column) -> Column:
    """Ordered rules; root is the project's own folder, declared whether it takes the package by path or for development."""
    inside = (path == root) | path.startswith(F.concat(root, F.lit("/")))
    return (
        F.when(inside | declared, "custom")
        .when(name.isin(OFFICIAL_PACKAGES) | name.startswith("flutter_"), "flutter_official")
        .when(path.contains("dart-sdk"), "sdk")
        .otherwise("third_party")
    )


def classify(packages: DataFrame, projects: DataFrame) -> DataFrame:
    """projects(project_id, root, root_spec) -> packages with their type, by an equi-join with the descriptor's entries."""
    own = descriptor_entries(projects).filter(F.col("has_path") | (F.col("section") == "dev_dependencies")).select(
        "project_id", F.col("key").alias("name"), F.lit(True).alias("_declared")).distinct()
    return (
        packages.join(projects.select("project_id", "root"), "project_id", "left")
        .join(own, ["project_id", "name"], "left")
        .withColumn("type", package_type(F.col("name"), F.col("path"), F.col("root"), F.col("_declared")))
        .select(*packages.columns, "type")
    )
