"""Queries over file listings: source choice, custom directories, roots, package listings."""

from pyspark.sql import functions as F

from codeloom.plans import bindings as B
from codeloom.sources import files as S


def source_files(spark, d):
    return S.distinct_files(S.matched_files(B.page_listing(spark, d))).select("project_id", "rel_path")


def files_per_pattern(spark, d):
    return S.files_per_pattern(S.matched_files(B.page_listing(spark, d)))


def custom_dirs(spark, d):
    return S.custom_dirs(B.page_listing(spark, d))


def module_dirs(spark, d):
    return S.module_dirs(B.page_listing(spark, d))


def extra_source_dirs(spark, d):
    return S.extra_source_dirs(B.page_listing(spark, d))


def nearest_roots(spark, d):
    """Customer folders below nation and region folders; some nations and all regions are marked roots."""
    place = F.concat(F.lit("/lake/"), F.lower("r_name"))
    nation = F.concat(place, F.lit("/"), F.lower("n_name"))
    places = B.table(spark, d, "nation").join(B.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    marks = places.select(F.lit("lake").alias("project_id"), F.explode(F.array(
        F.when(F.col("n_nationkey") % 3 == 0, nation), F.when(F.col("r_regionkey") > 0, place))).alias("dir")).dropna()
    asked = B.table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.lit("lake").alias("project_id"),
        F.concat(nation, F.lit("/"), F.lower("c_mktsegment"), B.text("/c", F.col("c_custkey"))).alias("path"))
    return S.nearest_roots(asked, marks)


def _listed(spark, d):
    k = F.col("p_partkey")
    deep = F.when(k % 7 == 0, "a/b/c/d/").when(k % 5 == 0, "a/b/c/").when(k % 11 == 0, ".hid/").otherwise("")
    stem = F.when(k % 6 == 0, F.col("p_brand")).when(k % 8 == 0, "main").otherwise(B.text("part_", k))
    listing = B.table(spark, d, "part").select(
        F.lower("p_type").alias("project_id"), F.col("p_brand").alias("package"),
        F.concat(deep, B.text("v", k, "/"), stem, F.lit(".dart")).alias("lib_path"))
    return S.package_files(listing)


def package_files(spark, d):
    return _listed(spark, d)


def main_files(spark, d):
    return S.main_files(_listed(spark, d))


_LISTING = """lst AS (SELECT page_id AS i, 'site' || ((page_id // 5) % 23) AS project_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang FROM pages),
  listing AS (SELECT *, CASE i % 12 WHEN 0 THEN 'lib/' || lang || '/' || i || '.dart' WHEN 1 THEN 'pubspec.yaml' WHEN 2 THEN lang || '/' || i || '.dart'
      WHEN 3 THEN lang || '/a/b/' || i || '.dart' WHEN 4 THEN 'deep' || i || '/a/b/c/' || i || '.dart' WHEN 5 THEN '_own/' || i || '.dart'
      WHEN 6 THEN '.dart_tool/' || i || '.dart' WHEN 7 THEN 'packages/p' || i || '/lib/src/' || i || '.dart' WHEN 8 THEN 'features/' || lang || '/lib/' || i || '.dart'
      WHEN 9 THEN 'test/' || i || '.dart' WHEN 10 THEN 'web/' || i || '.dart' ELSE lang || '_x/.hid/' || i || '.dart' END AS rel_path FROM lst),
  rooted AS (SELECT DISTINCT project_id FROM listing WHERE i % 12 = 1),
  custom AS (SELECT DISTINCT project_id, CASE WHEN i % 12 IN (2, 3) THEN lang WHEN i % 12 = 4 THEN 'deep' || i WHEN i % 12 = 7 THEN 'packages'
      WHEN i % 12 = 8 THEN 'features' END AS dir FROM listing WHERE i % 12 IN (2, 3, 4, 7, 8)),
  modular AS (SELECT DISTINCT project_id, CASE WHEN i % 12 = 7 THEN 'packages/p' || i ELSE 'features/' || lang END AS dir FROM listing WHERE i % 12 IN (7, 8)),
  extra AS (SELECT * FROM custom UNION SELECT * FROM modular),
  matched AS (
    SELECT project_id, rel_path, 'lib/**/*.dart' AS pattern FROM listing WHERE i % 12 = 0 AND project_id IN (SELECT project_id FROM rooted)
    UNION ALL SELECT project_id, rel_path, '**/*.dart' FROM listing WHERE i % 12 NOT IN (1, 6) AND project_id NOT IN (SELECT project_id FROM rooted)
    UNION ALL SELECT l.project_id, rel_path, dir || '/**/*.dart' FROM listing l JOIN extra e ON e.project_id = l.project_id AND starts_with(rel_path, dir || '/')
      WHERE i % 12 NOT IN (1, 6, 11) AND l.project_id IN (SELECT project_id FROM rooted))"""

_LISTED = """raw AS (SELECT lower(p_type) AS project_id, p_brand AS package, p_partkey AS k,
    CASE WHEN p_partkey % 7 = 0 THEN 'a/b/c/d/' WHEN p_partkey % 5 = 0 THEN 'a/b/c/' WHEN p_partkey % 11 = 0 THEN '.hid/' ELSE '' END || 'v' || p_partkey || '/'
    || CASE WHEN p_partkey % 6 = 0 THEN p_brand WHEN p_partkey % 8 = 0 THEN 'main' ELSE 'part_' || p_partkey END || '.dart' AS lib_path FROM part),
  ranked AS (SELECT project_id, package, lib_path, row_number() OVER (PARTITION BY project_id, package ORDER BY lib_path)::INT AS rank FROM raw
    WHERE k % 7 = 0 OR k % 5 = 0 OR k % 11 <> 0),
  listed AS (SELECT * FROM ranked)"""

QUERIES = {
    "source_files": (source_files, f"WITH {_LISTING} SELECT DISTINCT project_id, rel_path FROM matched"),
    "files_per_pattern": (files_per_pattern, f"WITH {_LISTING} SELECT project_id, pattern, count(*) AS n_files FROM matched GROUP BY ALL"),
    "custom_dirs": (custom_dirs, f"WITH {_LISTING} SELECT * FROM custom"),
    "module_dirs": (module_dirs, f"WITH {_LISTING} SELECT * FROM modular"),
    "extra_source_dirs": (extra_source_dirs, f"WITH {_LISTING} SELECT * FROM extra"),
    "nearest_roots": (nearest_roots, """SELECT 'lake' AS project_id, '/lake/' || lower(r_name) || '/' || lower(n_name) || '/' || lower(c_mktsegment) || '/c' || c_custkey AS path,
        CASE WHEN n_nationkey % 3 = 0 THEN '/lake/' || lower(r_name) || '/' || lower(n_name) WHEN r_regionkey > 0 THEN '/lake/' || lower(r_name) END AS root
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "package_files": (package_files, f"WITH {_LISTED} SELECT * FROM listed"),
    "main_files": (main_files, f"""WITH {_LISTED} SELECT project_id, package, first(lib_path ORDER BY rank) AS main_file FROM listed
        WHERE regexp_matches(lib_path, '/main\\.dart$') OR lib_path LIKE '%/' || package || '.dart' GROUP BY ALL"""),
}
