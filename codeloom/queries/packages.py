"""Queries over package manifests and file provenance."""

from pyspark.sql import functions as F

from codeloom.operators import packages as P
from codeloom.plans import bindings as B
from codeloom.plans.sql import MANIFEST, TRADE
from codeloom.sources import packages as S


def package_manifest(spark, d):
    return S.read_package_configs(B.supplier_configs(spark, d))


def existing_packages(spark, d):
    """Packages whose folder is known from the projects and descriptors."""
    specs = B.supplier_specs(spark, d).select("project_id", F.col("dir").alias("path"))
    own = B.supplier_projects(spark, d).select("project_id", F.concat("root", F.lit("/modules/own_"), F.expr("substring(project_id, 2)")).alias("path"))
    return S.existing_packages(package_manifest(spark, d), specs.unionByName(own)).select("project_id", "name", "path")


def package_descriptors(spark, d):
    return S.describe(package_manifest(spark, d), B.supplier_specs(spark, d)).select(
        "project_id", "name", "is_flutter", "description")


def package_contents(spark, d):
    """Files below the packages of each supplier: the http ones hold a lib folder, the dev ones only tools."""
    k = F.col("s_suppkey")
    places = F.array(*[B.text(*p) for p in (
        ("/pub/http_", k, "/lib/a.dart"), ("/pub/http_", k, "/lib/src/deep/b.dart"), ("/pub/http_", k, "/tool.dart"),
        ("/pub/http_", k, "/README.md"), ("/pub/dev ", k, "/bin/x.dart"), ("/pub/dev ", k, "/libx/y.dart"))])
    listing = B.table(spark, d, "supplier").select(B.text("s", k).alias("project_id"), F.explode(places).alias("path"))
    return S.with_files(package_manifest(spark, d), listing).select("project_id", "name", "has_lib", "n_files")


def package_types(spark, d):
    return S.classify(package_manifest(spark, d), B.supplier_projects(spark, d)).select("project_id", "name", "type")


def _trade_packages(spark, d):
    """A package per brand folder, the region folders' own package, and one around all brands, last in the list."""
    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    brands = B.table(spark, d, "part").select(
        n.alias("pkg_ord"), brand.alias("name"), F.concat(F.lit("/trade/packages/"), brand, F.when(n % 2 == 0, "/").otherwise("")).alias("path"),
        F.concat(n.cast("string"), F.lit(".0")).alias("version"),
        F.when(n % 3 == 0, "custom").when(n % 3 == 1, "third_party").otherwise("flutter_official").alias("type")).distinct()
    # every fourth brand folder belongs to the package around it
    brands = brands.withColumn("path", F.when(F.col("pkg_ord") % 4 == 0, F.lit("/nowhere")).otherwise(F.col("path")))
    regions = B.table(spark, d, "region").select(
        (F.col("r_regionkey") + 100).alias("pkg_ord"), F.lower("r_name").alias("name"),
        F.concat(F.lit("/trade/lib/"), F.lower("r_name")).alias("path"), F.lit("r").alias("version"), F.lit("custom").alias("type"))
    around = B.table(spark, d, "region").select(
        F.lit(1000).alias("pkg_ord"), F.lit("all").alias("name"), F.lit("/trade/packages").alias("path"),
        F.lit("unknown").alias("version"), F.lit("third_party").alias("type")).distinct()
    return brands.unionByName(regions).unionByName(around).withColumn("project_id", F.lit(B.TRADE))


def _trade_files(spark, d):
    """Every node as a file; the African ones live in the SDK."""
    rel = F.col("rel_path")
    path = F.when(rel.startswith("lib/africa"), F.concat(F.lit("/opt/dart-sdk/"), rel)).otherwise(F.concat(F.lit("/trade/"), rel))
    return B.trade_nodes(spark, d).filter(rel.endswith(".dart")).select(
        "project_id", F.concat(F.lit("file://"), path).alias("file_uri"), path.alias("path"), "node_id", "label", "parent")


def file_sources(spark, d):
    files = _trade_files(spark, d).select("project_id", "file_uri", "path")
    return P.file_sources(files, _trade_packages(spark, d)).select("project_id", "file_uri", "source.*")


def container_assignment(spark, d):
    files = _trade_files(spark, d)
    sources = P.file_sources(files.select("project_id", "file_uri", "path"), _trade_packages(spark, d))
    return P.assign_containers(files, sources).select("project_id", "node_id", "display_label", "parent", F.col("source.type").alias("source_type"))


def package_containers(spark, d):
    """One node per manifest package, of all supplier projects."""
    pkgs = S.classify(package_manifest(spark, d), B.supplier_projects(spark, d))
    return P.container_nodes(pkgs).select(
        "project_id", "node_id", "label", "kind", "is_sdk", "layer", F.col("rng.ec").alias("width"),
        F.col("source.package_type").alias("package_type"))


_SOURCES = f"""{TRADE},
  f AS (SELECT node_id, label, parent, rel_path, starts_with(rel_path, 'lib/africa') AS sdk,
      CASE WHEN starts_with(rel_path, 'lib/africa') THEN '/opt/dart-sdk/' ELSE '/trade/' END || rel_path AS path,
      CASE WHEN starts_with(node_id, 'part:') THEN regexp_extract(package, '([0-9]+)', 1)::INT END AS b, string_split(rel_path, '/') AS s
    FROM nodes WHERE rel_path LIKE '%.dart'),
  g AS (SELECT *, CASE WHEN sdk THEN 'sdk' WHEN b IS NULL THEN 'project' WHEN b % 4 = 0 THEN 'external_package' WHEN b % 3 = 0 THEN 'project' ELSE 'external_package' END AS type,
      CASE WHEN sdk THEN NULL WHEN b IS NULL THEN s[2] WHEN b % 4 = 0 THEN 'all' ELSE 'brand_' || b END AS package_name,
      CASE WHEN sdk THEN NULL WHEN b IS NULL THEN 'r' WHEN b % 4 = 0 THEN 'unknown' ELSE b || '.0' END AS package_version,
      CASE WHEN sdk THEN 'sdk' WHEN b IS NULL THEN 'custom' WHEN b % 4 = 0 THEN 'third_party' WHEN b % 3 = 0 THEN 'custom' WHEN b % 3 = 1 THEN 'third_party' ELSE 'flutter_official' END AS package_type,
      CASE WHEN sdk THEN NULL WHEN b IS NULL THEN array_to_string(s[3:], '/') WHEN b % 4 = 0 THEN array_to_string(s[2:], '/') ELSE s[3] END AS relative_path FROM f)"""

QUERIES = {
    "package_manifest": (package_manifest, f"""WITH {MANIFEST} SELECT project_id, p.o::INT AS pkg_ord, p.name AS name, p.uri AS root_uri, p.path AS path, p.v AS version FROM man"""),
    "existing_packages": (existing_packages, f"WITH {MANIFEST} SELECT project_id, p.name AS name, p.path AS path FROM man WHERE p.o IN (0, 1)"),
    "package_descriptors": (package_descriptors, f"""WITH {MANIFEST} SELECT project_id, p.name AS name, p.o = 0 AND k % 3 = 0 AS is_flutter,
        CASE WHEN p.o = 0 THEN 'Talks to ' || s_name ELSE '' END AS description FROM man"""),
    "package_contents": (package_contents, f"""WITH {MANIFEST} SELECT project_id, p.name AS name, p.o = 0 AS has_lib,
        CASE p.o WHEN 0 THEN 3 WHEN 4 THEN 2 ELSE 0 END::BIGINT AS n_files FROM man"""),
    "package_types": (package_types, f"WITH {MANIFEST} SELECT project_id, p.name AS name, type FROM typed"),
    "file_sources": (file_sources, f"""WITH {_SOURCES} SELECT 'trade' AS project_id, 'file://' || path AS file_uri, type, package_name, package_version, package_type, relative_path FROM g"""),
    "container_assignment": (container_assignment, f"""WITH {_SOURCES} SELECT 'trade' AS project_id, node_id,
        CASE type WHEN 'external_package' THEN chr(128279) || ' ' WHEN 'sdk' THEN chr(9881) || chr(65039) || ' ' ELSE '' END || label AS display_label,
        CASE WHEN type = 'external_package' THEN 'package_container:' || package_name ELSE parent END AS parent, type AS source_type FROM g"""),
    "package_containers": (package_containers, f"""WITH {MANIFEST} SELECT project_id, 'package_container:' || p.name AS node_id, p.name AS label, 'package_container' AS kind,
        type = 'sdk' AS is_sdk, 'utility' AS layer, length(p.name)::INT AS width, type AS package_type FROM typed
        UNION ALL SELECT 's' || s_suppkey, 'project_root', 'project_root', 'package_container', false, 'utility', 12, NULL FROM supplier"""),
}
