"""Fixed values and table schemas shared by every operator."""

from pyspark.sql import types as T

# --- fixed values: symbol kind codes -------------------------------------------------
KIND_CLASS = 5
KIND_METHOD = 6
KIND_PROPERTY = 7
KIND_FIELD = 8
KIND_CONSTRUCTOR = 9
KIND_ENUM = 10
KIND_FUNCTION = 12
KIND_TYPEDEF = 22

# fixed values: kind code -> kind name
KIND_NAMES = {
    3: "namespace", 5: "class", 6: "method", 7: "property", 8: "field",
    9: "constructor", 10: "enum", 12: "function", 22: "typedef",
}

# fixed values: kind code -> prefix used inside node ids
KIND_PREFIXES = {
    3: "ext", 5: "class", 6: "method", 7: "prop", 8: "field",
    9: "ctor", 10: "enum", 12: "func", 22: "typedef",
}

# fixed values: names left out of the external-symbol view
EXCLUDED_METHOD_NAMES = [
    "toString", "hashCode", "operator", "runtimeType", "noSuchMethod", "now", "parse", "tryParse",
]

# fixed values: top-level directories that are never custom source directories
STANDARD_DIRS = [
    "lib", "test", "example", "tool", "bin", "integration_test", ".dart_tool", "build",
    ".packages", "node_modules", "android", "ios", "web", "windows", "macos", "linux",
]
# fixed values: parents of modular packages
MODULE_PARENTS = ["packages", "modules", "features", "apps", "plugins", "shared"]

# fixed values: packages published with the framework
OFFICIAL_PACKAGES = [
    "flutter", "flutter_test", "flutter_web_plugins", "flutter_driver", "integration_test",
    "flutter_localizations", "material", "cupertino",
]

FLOW_HOPS = 10

# --- table schemas -------------------------------------------------------------------
FILES = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("file_uri", T.StringType()),
    T.StructField("rel_path", T.StringType()),
    T.StructField("content", T.StringType()),
])
SYMBOL_TREES = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("file_uri", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("tree", T.StringType()),
])
HOVERS = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("file_uri", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("character", T.IntegerType()),
    T.StructField("contents", T.ArrayType(T.StringType())),
])
REFS = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("target_uri", T.StringType()),
    T.StructField("target_line", T.IntegerType()),
    T.StructField("target_char", T.IntegerType()),
    T.StructField("ref_uri", T.StringType()),
    T.StructField("ref_line", T.IntegerType()),
    T.StructField("ref_char", T.IntegerType()),
])
PACKAGE_CONFIG = T.StructType([
    T.StructField("packages", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("rootUri", T.StringType()),
        T.StructField("version", T.StringType()),
    ]))),
])
