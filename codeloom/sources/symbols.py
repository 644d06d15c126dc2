"""Symbol dumps: JSON trees to one row per symbol."""

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions.symbols import node_id, symbol_uid
from codeloom.session import once, written

_COLS = [
    "project_id", "file_uri", "sym_path", "depth", "name", "kind", "detail", "rng", "sel_rng",
    "symbol_uid", "parent_uid", "parent_name", "parent_kind", "top_name", "node_id", "parent_node_id", "n_children",
]
#: what `told` makes of a symbol's file, path and names; tables needn't hold it
TOLD = ["depth", "symbol_uid", "node_id", "parent_uid", "parent_node_id", "ord"]
#: tree levels that one pass goes down before its rows are written
LEVELS = 3


_PLACE = "struct<line:int,character:int>"
_RANGE = f"struct<start:{_PLACE},end:{_PLACE}>"
#: what is read of a symbol
_READ = f"struct<name:string,kind:int,detail:string,range:{_RANGE},selectionRange:{_RANGE},children:array<variant>>"


def _range(field: str) -> Column:
    parts = {"sl": "start.line", "sc": "start.character", "el": "end.line", "ec": "end.character"}
    cells = [F.col(f"read.{field}.{p}").alias(n) for n, p in parts.items()]
    return F.when(F.col(f"read.{field}.start.line").isNotNull(), F.struct(*cells))


def _symbol(path: Column, up_name: Column, up_kind: Column, top_name: Column) -> Column:
    """What is kept of a symbol: its own values and the names above it, of which all ids are made later."""
    return F.struct(
        path.alias("sym_path"), F.col("read.name").alias("name"), F.col("read.kind").alias("kind"),
        F.coalesce("read.detail", F.lit("")).alias("detail"), _range("range").alias("rng"), _range("selectionRange").alias("sel_rng"),
        up_name.alias("parent_name"), up_kind.alias("parent_kind"), top_name.alias("top_name"),
        F.coalesce(F.size("read.children"), F.lit(0)).alias("n_children"), F.col("read.children").alias("children"))


def _read(rows: DataFrame) -> DataFrame:
    """Add what symbol v holds, read in one pass over its values."""
    return once(rows, read=F.expr(f"try_variant_get(v, '$', '{_READ}')"))


def _below(rows: DataFrame) -> DataFrame:
    """Every symbol of rows(project_id, file_uri, s, open), and the children of the open ones after it, which are open now."""
    items = F.expr("""if(open and s.n_children > 0, concat(array(cast(null as variant)), s.children),
                      array(cast(null as variant)))""")
    own = F.col("pos") == 0
    child = _symbol(F.concat("s.sym_path", F.array(F.col("pos") - 1)), F.col("s.name"), F.col("s.kind"), F.col("s.parent_name"))
    each = _read(rows.select("*", F.posexplode(items).alias("pos", "v")))
    # a symbol whose children are told asks for nothing more
    closed = F.col("s").withField("children", F.lit(None).cast("array<variant>"))
    return each.select("project_id", "file_uri", F.when(own, closed).otherwise(child).alias("s"), (~own).alias("open"))


def told(flat: DataFrame) -> DataFrame:
    """Add TOLD to written rows of symbols; ids are functions of the file and the names, in which `top_name` is the parent's parent."""
    uri, name, kind = F.col("file_uri"), F.col("name"), F.col("kind")
    up_name, up_kind, inner = F.col("parent_name"), F.col("parent_kind"), F.size("sym_path") > 1
    return flat.withColumns({
        "depth": F.size("sym_path"), "symbol_uid": symbol_uid(uri, name, kind), "node_id": node_id(uri, name, kind, up_name),
        "parent_uid": F.when(inner, symbol_uid(uri, up_name, up_kind)),
        "parent_node_id": F.when(inner, node_id(uri, up_name, up_kind, F.col("top_name"))),
        "ord": F.struct("file_uri", "sym_path"),
    })


def flatten_trees(trees: DataFrame) -> DataFrame:
    """trees(project_id, file_uri, tree JSON) -> one row per symbol, whatever the depth.

    A pass parses each tree once, goes down LEVELS levels and writes its symbols; where children are left below, a
    further pass goes on from there. Only a symbol's own values are written, and children only where they are still open.
    """
    none = F.lit(None).cast("string")
    top = _read(trees.sparkSession.sql(
        "select t.project_id, t.file_uri, c.pos, c.value as v from {trees} t, lateral variant_explode(try_parse_json(t.tree)) c", trees=trees))
    rows = top.select("project_id", "file_uri", _symbol(F.array("pos"), none, F.lit(None).cast("int"), none).alias("s"),
                      F.lit(True).alias("open"))
    levels, out = LEVELS - 1, None
    while True:
        for _ in range(levels):
            rows = _below(rows)
        left = F.col("open") & (F.col("s.n_children") > 0)
        flat = written(rows.select(
            "project_id", "file_uri", "s.*", left.alias("left")).withColumn("children", F.when(F.col("left"), F.col("children"))))
        symbols = told(flat).select(*_COLS, "ord")
        out = symbols if out is None else out.unionByName(symbols)
        rows = flat.filter("left")
        if rows.isEmpty():
            return out
        # symbols of the next pass are the children alone
        rows = _children(rows)
        levels = LEVELS - 1


def _children(flat: DataFrame) -> DataFrame:
    each = flat.select("project_id", "file_uri", "sym_path", "name", "kind", "parent_name", F.posexplode("children").alias("pos", "v"))
    return _read(each).select("project_id", "file_uri", _symbol(
        F.concat("sym_path", F.array("pos")), F.col("name"), F.col("kind"), F.col("parent_name")).alias("s"), F.lit(True).alias("open"))


def link_parents(symbols: DataFrame) -> DataFrame:
    """Give flat symbols (file_uri, sym_path, name, kind) their parent and node ids by two self-joins."""
    keys = ["project_id", "file_uri"]
    up = F.expr("slice(sym_path, 1, size(sym_path) - 1)")
    parents = symbols.select(
        *keys, F.col("sym_path").alias("up_path"), F.col("name").alias("parent_name"), F.col("kind").alias("parent_kind"),
    )
    named = (
        symbols.withColumn("up_path", up).join(parents, [*keys, "up_path"], "left")
        .withColumn("depth", F.size("sym_path"))
        .withColumn("symbol_uid", symbol_uid(F.col("file_uri"), F.col("name"), F.col("kind")))
        .withColumn("parent_uid", F.when(
            F.col("parent_name").isNotNull(),
            symbol_uid(F.col("file_uri"), F.col("parent_name"), F.col("parent_kind"))))
        .withColumn("node_id", node_id(F.col("file_uri"), F.col("name"), F.col("kind"), F.col("parent_name")))
    )
    ids = named.select(*keys, F.col("sym_path").alias("up_path"), F.col("node_id").alias("parent_node_id"))
    return (
        named.join(ids, [*keys, "up_path"], "left").drop("up_path")
        .withColumn("ord", F.struct("file_uri", "sym_path"))
    )
