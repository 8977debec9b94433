"""Collections as Parquet tables: new versions from old ones, each committed when it is whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def patch(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of rows that have a patch are set, to null as well; keys that are not in ``old`` are ignored."""
    renamed = new.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__is"))
    rows = old.join(renamed, F.col(key) == F.col("__key"), "left")
    rows = rows.withColumns({c: F.when(F.col("__is"), F.col(f"__new_{c}")).otherwise(F.col(c)) for c in columns})
    return rows.select(*old.columns)


def delete(old: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one row with the number deleted); a null condition does not delete."""
    gone = F.coalesce(condition, F.lit(False))
    return old.where(~gone), old.agg(F.count_if(gone).alias("deleted"))


def counts(collections: dict[str, DataFrame]) -> DataFrame:
    """(collection, n)."""
    out = None
    for name, rows in collections.items():
        one = rows.agg(F.lit(name).alias("collection"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def mosaic(rows: DataFrame, group: str, key: str, most: int = 36, least: int = 2) -> DataFrame:
    """Place (row, col) of each group's first rows in a near-square grid; groups below ``least`` have none."""
    by = Window.partitionBy(group)
    ranked = rows.withColumns({"__r": F.row_number().over(by.orderBy(key)) - 1, "__n": F.least(F.count(F.lit(1)).over(by), F.lit(most))})
    cols = F.ceil(F.sqrt("__n")).cast("long")
    placed = ranked.where((F.col("__r") < most) & (F.col("__n") >= least)).withColumns({"row": F.floor(F.col("__r") / cols).cast("long"), "col": (F.col("__r") % cols).cast("long")})
    return placed.drop("__r", "__n")


def image_files(spark: SparkSession, path: str, most: int | None = None, endings: tuple[str, ...] = ("jpg", "jpeg", "png", "webp")) -> DataFrame:
    """(path, length, content) of image files below a folder, in the order of their paths."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = rows.where(F.lower(F.substring_index("path", ".", -1)).isin(*endings)).select("path", "length", "content")
    return rows if most is None else rows.orderBy("path").limit(most)


def benchmark_results(spark: SparkSession, path: str, track: str = "track", multi_line: bool = True) -> DataFrame:
    """Benchmark JSON files, the first of each track by file name; tracks with an @ are left out."""
    rows = spark.read.option("multiLine", str(multi_line).lower()).json(path).withColumn("__file", F.input_file_name())
    first = Window.partitionBy(track).orderBy("__file")
    return rows.where(~F.contains(track, F.lit("@"))).withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r", "__file")


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", "true").csv(path)


class ConcurrentWrite(Exception):
    """Another writer has made a version since the one that this write started from."""


class Collection:
    """A named table below a folder. Each write makes a new version: a list of Parquet folders that belong to it.

    Data go to folders of unique names; then the version is committed by creating
    its file, which fails if it is there already. So readers see whole versions
    only, a failed write changes nothing, and of two writers that started from the
    same version one gets ConcurrentWrite and may try again.
    """

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.root = spark, f"{path.rstrip('/')}/{name}"

    def _folder(self, *parts: str):
        """(Hadoop file system, path) below the collection's folder."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def version(self) -> int | None:
        fs, path = self._folder("commits")
        if not fs.exists(path):
            return None
        return max((int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()), default=None)

    def exists(self) -> bool:
        return self.version() is not None

    def folders(self, version: int | None = None) -> list[str]:
        """Folders of a version, the last one by default."""
        version = self.version() if version is None else version
        return [] if version is None else [r.value for r in self.spark.read.text(f"{self.root}/commits/{version:08d}").collect()]

    def _commit(self, version: int, folders: list[str]) -> int:
        fs, path = self._folder("commits", f"{version:08d}")
        try:
            out = fs.create(path, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise ConcurrentWrite(f"version {version} of {self.root} is there already") from e
            raise
        out.write(bytearray("\n".join(folders), "utf-8"))
        out.close()
        return version

    def read(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{name}" for name in self.folders()])

    def _write(self, rows: DataFrame, partition_by: list[str] | None) -> str:
        name = f"data-{uuid.uuid4().hex}"
        (rows.write.partitionBy(*partition_by) if partition_by else rows.write).parquet(f"{self.root}/{name}")
        return name

    def write(self, rows: DataFrame, partition_by: list[str] | None = None, parent: int | None = None) -> int:
        """A version of these rows. parent: version that the rows were made from, by default the last one when writing starts."""
        parent = parent if parent is not None else self.version() or 0
        return self._commit(parent + 1, [self._write(rows, partition_by)])

    def append(self, rows: DataFrame) -> int:
        """A version with further rows; those before are neither read nor written."""
        parent = self.version() or 0
        return self._commit(parent + 1, [*self.folders(parent or None), self._write(rows, None)])

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the folders that none of the last ``keep`` versions has; returns their number. Writes must not run meanwhile."""
        last = self.version() or 0
        used = {name for v in range(max(1, last - keep + 1), last + 1) for name in self.folders(v)}
        fs, path = self._folder()
        gone = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("data-") and f.getPath().getName() not in used]
        for folder in gone:
            fs.delete(folder, True)
        for v in range(1, max(1, last - keep + 1)):
            fs.delete(self._folder("commits", f"{v:08d}")[1], False)
        return len(gone)

    def drop(self) -> bool:
        """Deletes the collection; false if there is none."""
        fs, path = self._folder()
        return bool(fs.delete(path, True)) if fs.exists(path) else False

    def create(self, schema: str, force: bool = False) -> None:
        """An empty version, unless there is one already; ``force`` drops what is there."""
        if force:
            self.drop()
        if not self.exists():
            self.write(self.spark.createDataFrame([], schema))

    def scan(self, columns: list[str] | None = None, missing: str | None = None, most: int | None = None) -> DataFrame:
        """All rows, or those where a column is null; pruned to ``columns``."""
        rows = self.read() if missing is None else self.read().where(F.col(missing).isNull())
        rows = rows.select(*columns) if columns else rows
        return rows if most is None else rows.limit(most)

    def get(self, key: str, value: object, columns: list[str] | None = None) -> DataFrame:
        """The row of a key, pruned to ``columns``."""
        rows = self.read().where(F.col(key) == F.lit(value))
        return rows.select(*columns) if columns else rows

    def size_mb(self) -> float:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{self.root}/{name}" for name in self.folders()])
        return round((files.agg(F.sum("length")).first()[0] or 0) / 1024 / 1024, 2)


def save_model(centroids: DataFrame, path: str, trained_at: Column, n_vectors: Column) -> None:
    """Centroids and one row of metadata."""
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    centroids.agg(F.count(F.lit(1)).alias("n_clusters")).select("n_clusters", n_vectors.alias("n_vectors"), trained_at.alias("trained_at")).write.mode("overwrite").parquet(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/metadata")

