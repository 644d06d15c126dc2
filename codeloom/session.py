"""Session settings and lineage cutting."""

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the plans rely on; all of them can be changed per session."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # split a hot join key even where the split costs another exchange downstream
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # the files of a query's exchanges go when it ends; a plan of many steps holds those of one step at a time
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    # small tables, heavy rows: give a scan at least as many splits as there are cores
    spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    spark.conf.set("spark.sql.files.openCostInBytes", "65536")
    # Python tasks hold one batch of whole texts at a time
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    # plans of iterative operators are long and described anew at each adaptive step; the driver keeps those texts
    spark.conf.set("spark.sql.maxPlanStringLength", "50000")
    # plans are built from many small expressions; keep the call-site capture of each one short
    spark.conf.set("spark.sql.stackTracesInDataFrameContext", "1")
    return spark


def local_session(cpus: str = "*", app: str = "codeloom") -> SparkSession:
    """Single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        # checkpoints go once nothing refers to them
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # a static setting: no call-site capture per expression, which costs seconds on wide plans
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; all executors and the driver see it.

    Only a session that runs in one process may go without the setting; it gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="codeloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: folders of written tables and checkpoints, by application
_own_folders: dict[str, list[str]] = {}


def _own_folder(spark: SparkSession, folder: str) -> None:
    """Note a folder that only this application reads, to be removed when it ends."""
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = []
        atexit.register(_remove, app, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    if folder not in _own_folders[app]:
        _own_folders[app].append(folder)


def _remove(app: str, jvm, conf) -> None:
    for folder in _own_folders.pop(app, []):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def remove_tables(spark: SparkSession) -> None:
    """Remove what `written` and `cut_lineage` have left; for long sessions, once no earlier result is read any more.

    At the end of the application this happens by itself.
    """
    sc = spark.sparkContext
    _remove(sc.applicationId, sc._jvm, sc._jsc.hadoopConfiguration())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    _own_folder(df.sparkSession, sc.getCheckpointDir())
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """For loops of many small queries: free what the driver holds of finished ones, their plans and broadcast tables, before the heap grows."""
    spark.sparkContext._jvm.System.gc()


@contextmanager
def spared_driver(spark: SparkSession) -> Iterator[None]:
    """For loops of many small joins, whose garbage else makes the driver's heap grow.

    A join planned as an exchange of both sides stays one: once both are written, sending the smaller one through the driver
    after all saves no exchange. Each adaptive step describes its plan in the short form.
    """
    now = {"spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.ui.explainMode": "simple"}
    before = {key: spark.conf.get(key, None) for key in now}
    for key, value in now.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that cost too much to be computed by every filter and column that reads them.

    The optimiser copies an expression to where it is read, and what filters ask is computed once more below; what a
    generator gives it leaves alone.
    """
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table of their own in the shared folder: later readers take the columns they need.

    The folder is the application's own and goes when it ends.
    """
    spark = df.sparkSession
    own = f"{shared_folder(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"
    _own_folder(spark, own)
    path = f"{own}/{uuid.uuid4().hex}"
    # rows beside each other share most of their ids, which this codec folds well
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove the tables that `written` made and these read, once nothing reads them any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        folders = {file.rsplit("/", 1)[0] for file in df.inputFiles() if f"/tables/{sc.applicationId}/" in file}
        for path in map(sc._jvm.org.apache.hadoop.fs.Path, folders):
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
