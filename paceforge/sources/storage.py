"""Warehouse storage: partitioned facts, a load manifest, dimensions, and the inventory of a session cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["season", "round", "session"]
# fixed values: session folder names and their identifiers; sprint qualifying has two spellings
IDENTS = {
    "Practice_1": "FP1", "Practice_2": "FP2", "Practice_3": "FP3", "Qualifying": "Q", "Sprint_Qualifying": "SQ", "Sprint_Shootout": "SQ",
    "Sprint": "S", "Race": "R",
}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _put(rows: DataFrame, path: str, parts: list[str]) -> None:
    """Writes whole partitions: those that the rows hold are replaced, the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def load_new(rows: DataFrame, root: str, fact: str, files: int = 4) -> int:
    """Load the sessions that the manifest doesn't list for ``fact``; returns how many there were.

    A session is a folder (season, round, session) that a load writes whole, and its entry in the manifest is
    one too. If a load dies between the two, the next one finds the session unlisted and writes the
    same folder again: nothing is doubled. Facts have entries of their own, so a missing fact is
    filled in without touching the others. Rows of a session are dealt to ``files`` files.
    """
    spark, manifest = rows.sparkSession, f"{root}/load_manifest"
    new = rows
    if _exists(spark, manifest):
        done = spark.read.parquet(manifest).where(F.col("fact") == fact).select(*KEYS)
        new = rows.join(done, KEYS, "left_anti")
    counts = new.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_rows")).persist()
    try:
        n = counts.count()
        if n:
            spread = F.pmod(F.xxhash64(*(c for c in rows.columns if c not in KEYS)), F.lit(files))
            _put(new.repartition(*KEYS, spread), f"{root}/{fact}", KEYS)
            list_loaded(counts, root, fact)  # listed only once the rows are there
    finally:
        counts.unpersist()
    return n


def list_loaded(counts: DataFrame, root: str, fact: str) -> None:
    _put(counts.withColumns({"fact": F.lit(fact), "loaded_at": F.current_timestamp()}), f"{root}/load_manifest", ["fact", *KEYS])


def scan(spark: SparkSession, root: str, fact: str) -> DataFrame:
    """The partitioned fact; filters on season, round and session prune folders."""
    return spark.read.parquet(f"{root}/{fact}")


def load(spark: SparkSession, root: str, fact: str, season: int | None = None, round: int | None = None, session: str | None = None) -> DataFrame:
    """The rows of one session, or of all that match the given keys; only their folders are read."""
    out = scan(spark, root, fact)
    for key, value in zip(KEYS, (season, round, session), strict=True):
        out = out if value is None else out.where(F.col(key) == value)
    return out


def missing_loads(wanted: DataFrame, root: str, facts: list[str]) -> DataFrame:
    """(season, round, session, fact) that the manifest doesn't list: what a backfill has to load."""
    spark = wanted.sparkSession
    asked = wanted.select(*KEYS).distinct().withColumn("fact", F.explode(F.array(*(F.lit(f) for f in facts))))
    return asked.join(spark.read.parquet(f"{root}/load_manifest").select(*KEYS, "fact"), [*KEYS, "fact"], "left_anti") if _exists(spark, f"{root}/load_manifest") else asked


def write_dimension(rows: DataFrame, path: str, key: list[str], order: str) -> None:
    """Overwrite a dimension with the first row of each key by ``order``, rebuilt from all rows."""
    w = Window.partitionBy(*key).orderBy(order)
    rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k").write.mode("overwrite").parquet(path)


def cache_inventory(spark: SparkSession, root: str) -> DataFrame:
    """season, event, event_date, ident, timing, telemetry of a cache tree year/date_event/date_session, from file names only."""
    # Spark's readers skip names that begin with an underscore, as the marker files do
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, names = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True), []
    while found.hasNext():
        names.append((found.next().getPath().toString(),))
    files = spark.createDataFrame(names, "path string")
    pattern = r"/(\d{4})/(\d{4}-\d{2}-\d{2})_([^/]+)/\d{4}-\d{2}-\d{2}_([^/]+)/([^/]+)$"
    part = lambda k: F.regexp_extract("path", pattern, k)
    idents = F.create_map(*(F.lit(x) for p in IDENTS.items() for x in p))
    d = files.where(F.col("path").rlike(pattern)).select(part(1).cast("int").alias("season"), F.translate(part(3), "_", " ").alias("event"), part(2).cast("date").alias("event_date"), F.element_at(idents, part(4)).alias("ident"), part(5).alias("file"))
    out = d.where("ident is not null").groupBy("season", "event", "event_date", "ident").agg(F.bool_or(F.col("file").contains("timing_data")).alias("timing"), F.bool_or(F.col("file").contains("car_data")).alias("telemetry"))
    return out.where("timing").orderBy("season", "event_date", "ident")
