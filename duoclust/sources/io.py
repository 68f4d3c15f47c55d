"""Readers, writers and resumable result tables."""

from __future__ import annotations

import json
import tempfile
import uuid
import weakref
from contextlib import contextmanager
from contextvars import ContextVar
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORPUS = "book string, chapter int, verse int, morph array<string>, text array<string>"
TRIALS = "panel int, dimensions int, p double, p_form double, fraction double, simulation int, seed decimal(20,0), method string, mcc double, information_loss double, optimizer_success boolean, config string"
GAUSSIAN_TRIALS = "dimension int, coefficient int, samples_per_class int, noise double, seed decimal(20,0), method string, mcc double, failure string, config string"
SWEEP = "combination string, ngram int, window int, features string, n_samples int, n_features int, score_model string, matrix_representation string, information_mcc double, kmeans_mcc double, information_loss double, optimizer_success boolean, optimizer_iterations int, config string"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="duoclust-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_PLACES: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_OPEN: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open scratch scopes", default=())


def materialised(df: DataFrame, name: str, *then_drop: DataFrame, **options: str) -> DataFrame:
    """df written to the folder all executors share and read back; the tables of then_drop, which this function has
    returned before and nothing else needs, are deleted. options are the writer's."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    for scope in _OPEN.get():
        scope.append(out)
    dropped(*then_drop)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        if (at := _PLACES.pop(table, None)) is not None:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def scratch():
    """Deletes, at its end, every table that materialised() has written inside, but for those in the list it gives."""
    mine, keep = [], []
    token = _OPEN.set((*_OPEN.get(), mine))
    try:
        yield keep
    finally:
        _OPEN.reset(token)
        dropped(*[t for t in mine if not any(t is k for k in keep)])


def annotations(spark: SparkSession, path: str, label: str) -> DataFrame:
    """(book, chapter, verse, label, seq) of a CSV with Book, Chapter, Verse and label columns. seq is the row's place
    in the file, from 0: keys repeat, so only it tells rows apart. Blank lines do not count."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    numbered = raw.select(F.col("Book").alias("book"), F.col("Chapter").cast("int").alias("chapter"), F.col("Verse").cast("int").alias("verse"), F.trim(label).cast("int").alias("label"), F.monotonically_increasing_id().alias("at"))
    return numbered.withColumn("seq", F.row_number().over(Window.partitionBy("book").orderBy("at")).cast("long") - 1).drop("at")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A flattened corpus of token channels; channels of one verse must be equally long."""
    return spark.read.schema(CORPUS).parquet(path)


def annotated_documents(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Annotation rows with their tokens, repeats kept; a key without text is an error when it is read."""
    found = rows.join(texts, ["book", "chapter", "verse"], "left")
    lost = F.concat_ws(" ", F.lit("no text for"), "book", F.col("chapter").cast("string"), F.col("verse").cast("string"))
    return found.withColumn("morph", F.when(F.col("morph").isNull(), F.raise_error(lost).cast("array<string>")).otherwise(F.col("morph")))


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table, or an empty one of that schema where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], StructType.fromDDL(schema))


def append(df: DataFrame, path: str, schema: str) -> None:
    """Appends rows if they have just the columns of the table."""
    wanted = {f.name for f in StructType.fromDDL(schema)}
    if set(df.columns) != wanted:
        raise ValueError(f"columns differ: {sorted(set(df.columns) ^ wanted)}")
    df.select(*StructType.fromDDL(schema).names).write.mode("append").parquet(path)


def commit_batch(df: DataFrame, path: str, schema: str, name: str) -> int:
    """Adds the rows of df to the table of batches at `path`, all or none: they are written to a folder of their own, and
    count from the moment a manifest file names it. A run that ends in between leaves a folder that nobody reads; the
    batch is run again. `name` is for people: folders and manifests have names of their own. Gives the number of rows."""
    wanted = StructType.fromDDL(schema)
    if set(df.columns) != set(wanted.names):
        raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(wanted.names))}")
    spark, folder = df.sparkSession, f"data-{uuid.uuid4().hex}"
    df.select(*wanted.names).write.parquet(f"{path}/{folder}")
    rows = spark.read.schema(wanted).parquet(f"{path}/{folder}").count()
    _publish(spark, path, name, json.dumps({"folder": folder, "rows": rows, "name": name}))
    return rows


def _publish(spark: SparkSession, path: str, name: str, line: str) -> None:
    """A manifest file, whole or not at all: written beside its place and renamed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    draft = spark._jvm.org.apache.hadoop.fs.Path(at, f".{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(line.encode() + b"\n"))
    out.close()
    if not fs.rename(draft, spark._jvm.org.apache.hadoop.fs.Path(at, f"{name}-{uuid.uuid4().hex}.json")):
        raise OSError(f"the manifest of {name} could not be named in {path}")


def batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that manifests name; an empty table where there is none yet."""
    try:
        named = spark.read.schema("folder string, rows long, name string").json(f"{path}/manifest")
        folders = sorted(r["folder"] for r in named.where("rows > 0").select("folder").distinct().collect())  # a row for each batch
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        folders = []
    if not folders:
        return spark.createDataFrame([], StructType.fromDDL(schema))
    return spark.read.schema(schema).parquet(*(f"{path}/{f}" for f in folders))


def still_to_run(tasks: DataFrame, done: DataFrame, keys: list[str], start: int = 0, stop: int | None = None, limit: int | None = None) -> DataFrame:
    """Tasks that are not done, in the range of `index` if one is given, `limit` at most."""
    left = tasks.join(done.select(*keys).distinct(), keys, "left_anti")
    if "index" in tasks.columns:
        left = left.where((F.col("index") >= start) & (F.lit(True) if stop is None else F.col("index") < stop))
    return left if limit is None else left.limit(limit)


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows, the new row of a key in place of the old."""
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("age")))).where("k = 1").drop("k", "age")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def expected(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of expected results from a CSV with a header: the columns of the schema, in any order and no others, and
    only values of their types. ValueError for other columns; a value that is none fails when it is read."""
    wanted = StructType.fromDDL(schema)
    found = spark.read.option("header", True).csv(path)
    if set(found.columns) != set(wanted.names):
        raise ValueError(f"columns differ: {sorted(set(found.columns) ^ set(wanted.names))}")
    return found.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields))  # a cast fails in ANSI mode


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read if schema is None else spark.read.schema(schema)).json(path, multiLine=True)


def lock_file(spark: SparkSession, path: str) -> DataFrame:
    """(package, version) of lines package==version; blank lines and comments are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    parts = F.split("line", "==", 2)
    return lines.select(parts[0].alias("package"), parts[1].alias("version"))


def environment_differences(locked: DataFrame) -> list[str]:
    """What of a lock file (a few lines) this environment does not have as it says."""
    out = []
    for row in locked.collect():
        try:
            have = metadata.version(row["package"])
        except metadata.PackageNotFoundError:
            have = None
        if have != row["version"]:
            out.append(f"{row['package']}: {row['version']} expected, {have} found")
    return out


def compare_json(expected, observed, path: str = "$", atol: float = 1e-8, rtol: float = 1e-9) -> list[str]:
    """Differences of two JSON values; numbers within the tolerances are equal, booleans are no numbers."""
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if number(expected) and number(observed):
        same = expected == observed or abs(expected - observed) <= atol + rtol * abs(expected) or (expected != expected and observed != observed)
        return [] if same else [f"{path}: {expected} and {observed}"]
    if type(expected) is not type(observed):
        return [f"{path}: {json.dumps(expected)} and {json.dumps(observed)}"]
    if isinstance(expected, dict):
        out = [f"{path}.{k}: on one side only" for k in sorted(expected.keys() ^ observed.keys())]
        return out + [d for k in sorted(expected.keys() & observed.keys()) for d in compare_json(expected[k], observed[k], f"{path}.{k}", atol, rtol)]
    if isinstance(expected, list):
        if len(expected) != len(observed):
            return [f"{path}: {len(expected)} and {len(observed)} items"]
        return [d for k, (a, b) in enumerate(zip(expected, observed, strict=True)) for d in compare_json(a, b, f"{path}[{k}]", atol, rtol)]
    return [] if expected == observed else [f"{path}: {json.dumps(expected)} and {json.dumps(observed)}"]
