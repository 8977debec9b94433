"""Exact dedup by a log-structured merge index of digests.

An index is a folder of immutable runs and a list of them, which is appended to
when a run is whole; it can be opened again and added to. Each input task is a
memtable: it is flushed as one file of (digest, id) rows sorted by digest, and
the tasks of a flush are dealt to RUNS runs. Compaction merges all fresh runs
and the last merged one into a new merged run that keeps, for each digest, the
smallest and the largest identifier and the number of rows. With a merged run go
two filters of fixed size: of all its digests, which a lookup asks first, and of
those that occur more than once, which spares the texts of all others the way to
verification. Digests are only trusted after byte verification: rows whose
digest occurs more than once are grouped by (digest, whole text), so different
texts with one digest end in different classes. Everything runs in DataFrame
operations.

Cases: null text counts as the empty text; a null id never is the kept one
unless all ids of its class are null; rows that repeat id and text are in one
class and all marked alike; an empty table gives an empty result; other
columns of the input are ignored, whatever their names. Ids may have any type
that can be ordered; it must be the same in all batches of an index.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from pixelgrove.llm.common import join_uneven, key_filter, may_contain, scratch_path, stage, unused

#: Runs that the memtables of one flush are dealt to.
RUNS = 8


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """Sorted runs below one folder: flushed ones of (digest, id), and at most one merged run that counts.

    A write goes to a new path and is listed when it is whole, so a failed one
    changes nothing. Opening a folder finds the runs of earlier sessions.
    """

    LIST = "made timestamp, path string, kind string, rows long, bits long, replaces array<string>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.runs: list[Row] = []
        try:
            self.runs = spark.read.schema(self.LIST).parquet(f"{self.path}/list").orderBy("made", "path").collect()  # one row a run
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        self.id_type = self.rows().schema["id"].dataType if self.flushed else None

    @property
    def flushed(self) -> list[str]:
        """All runs of single rows."""
        return [r.path for r in self.runs if r.kind == "run"]

    @property
    def fresh(self) -> list[str]:
        """Those that are not merged yet."""
        gone = {p for r in self.runs for p in r.replaces}
        return [p for p in self.flushed if p not in gone]

    @property
    def merged(self) -> Row | None:
        gone = {p for r in self.runs for p in r.replaces}
        return next((r for r in self.runs if r.kind == "merged" and r.path not in gone), None)

    def _listed(self, added: list[tuple]) -> None:
        names = ("path", "kind", "rows", "bits", "replaces")
        texts = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
        each = [F.struct(*[(texts(v) if name == "replaces" else F.lit(v).cast("long") if name in ("rows", "bits") else F.lit(v)).alias(name) for name, v in zip(names, row, strict=True)]) for row in added]
        rows = self.spark.range(1).select(F.current_timestamp().alias("made"), F.explode(F.array(*each)).alias("r")).select("made", "r.*")
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/list")
        self.runs += [Row(made=None, path=p, kind=k, rows=n, bits=b, replaces=r) for p, k, n, b, r in added]

    def _write(self, rows: DataFrame, path: str, *partition_by: str) -> None:
        writer = rows.write.option("compression", "zstd").option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.expected.ndv#digest", "100000")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)

    def flush(self, rows: DataFrame) -> None:
        """Each input task is a memtable and flushes its own sorted file, in one of RUNS runs."""
        kind = rows.schema["id"].dataType
        if self.id_type not in (None, kind):
            raise ValueError(f"ids of this index are {self.id_type.simpleString()}")
        folder = f"{self.path}/run-{uuid.uuid4().hex}"
        dealt = rows.select("digest", "id", F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run")).sortWithinPartitions("run", "digest", "id")
        self._write(dealt, folder, "run")
        found = self.spark.read.schema(dealt.schema).parquet(folder).groupBy("run").count().collect()  # RUNS rows at most
        if found:
            self._listed([(f"{folder}/run={r.run}", "run", r["count"], 0, []) for r in sorted(found)])
            self.id_type = kind

    def _empty(self, *fields: str) -> DataFrame:
        return self.spark.range(0).select(*[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in fields])

    def rows(self) -> DataFrame:
        """(digest, id) of every flushed row."""
        return self.spark.read.parquet(*self.flushed) if self.flushed else self._empty("digest binary", "id long")

    def compact(self) -> DataFrame:
        """Merge the fresh runs with the merged one; it keeps the smallest and largest id and the number of each digest.

        Copies inside a task are added up before the shuffle.
        """
        if self.fresh:
            new = self.spark.read.parquet(*self.fresh).select("digest", F.col("id").alias("smallest"), F.col("id").alias("largest"), F.lit(1).cast("long").alias("n"))
            if self.merged:
                new = new.unionByName(self.spark.read.parquet(f"{self.merged.path}/rows"))
            new = new.groupBy("digest").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("n").alias("n"))
            path, gone = f"{self.path}/merged-{uuid.uuid4().hex}", [*self.fresh, *([self.merged.path] if self.merged else [])]
            self._write(new.sortWithinPartitions("digest"), f"{path}/rows")
            total = sum(r.rows for r in self.runs if r.kind == "run")
            bits = filter_bits(total)
            done = self.spark.read.parquet(f"{path}/rows")
            for name, keys in (("all", done), ("again", done.where("n > 1"))):
                key_filter(keys, "digest", bits).write.parquet(f"{path}/{name}")
            self._listed([(path, "merged", total, bits, gone)])
        return self.spark.read.parquet(f"{self.merged.path}/rows") if self.merged else self._empty("digest binary", "smallest long", "largest long", "n long")

    def maybe(self, rows: DataFrame, name: str = "all") -> DataFrame:
        """Rows whose column ``digest`` may be in the merged run or, with "again", may be there more than once."""
        if not self.merged:
            return rows.limit(0)
        return may_contain(rows, F.col("digest"), self.spark.read.schema("bucket long, bitmap binary").parquet(f"{self.merged.path}/{name}"), self.merged.bits)

    def lookup(self, rows: DataFrame) -> DataFrame:
        """Rows with a column ``digest`` that is in the compacted index, with its smallest, largest and n; the filter spares the others the join."""
        merged = self.compact()
        return self.maybe(rows).join(merged, "digest")

    def find(self, digests: list[bytes]) -> DataFrame:
        """Flushed rows of some given digests; files without them are skipped by their statistics and Bloom filters."""
        return self.rows().where(F.col("digest").isin([F.lit(bytes(d)) for d in digests]))


def filter_bits(keys: int) -> int:
    """Bits of a filter: eight a key, a power of two from 2^22 to 2^28, so 512 KB to 32 MB."""
    return 1 << min(28, max(22, (8 * keys - 1).bit_length()))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = sha256_digest, path: str | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """One row per row of the index: id, digest, keep_id, group_size, kept.

    keep: "smallest" or "largest" identifier of each class of equal texts.
    digest: any expression from text to a comparable value; it only steers the
    search, as hits are verified on their bytes. path: folder of an index that
    this batch is added to; it is made if there is none. earlier: the rows of all
    batches before, whose texts are read where their digests are hit; the result
    then has their rows as well, as if all came in one batch.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(keep)
    pick = lambda df: df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    index = DigestIndex(docs.sparkSession, path or scratch_path(docs.sparkSession, "digest-index"))
    if index.runs and earlier is None:
        raise ValueError("an index with rows needs the texts of the batches before")
    src = pick(docs) if earlier is None else pick(earlier).unionByName(pick(docs))
    index.flush(pick(docs).select(digest(F.col("text")).alias("digest"), "id"))

    index.compact()
    near = index.maybe(src.withColumn("digest", digest(F.col("text"))), "again")
    classes = stage(near.groupBy("digest", "text").agg(F.min("id").alias("smallest"), F.max("id").alias("largest"), F.count(F.lit(1)).alias("n")), "verified-classes")
    # A digest with two texts is a collision: its rows find their class by text as well.
    by_digest = stage(classes.groupBy("digest").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).where("n > 1"), "verified-digests")
    out = join_uneven(index.rows(), by_digest.select("digest", F.col(keep).alias("keep_id"), "n", "texts"), "digest", "n")
    plain = out.where("texts IS NULL OR texts = 1").select("id", "digest", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"))
    clashed = by_digest.where("texts > 1").select(F.col("digest").alias("clash"))
    if not clashed.isEmpty():
        rest = src.withColumn("digest", digest(F.col("text"))).join(clashed, F.col("digest") == F.col("clash"), "left_semi")
        picked = classes.select(F.col("digest").alias("d2"), F.col("text").alias("t2"), F.col(keep).alias("keep_id"), F.col("n").alias("group_size"))
        plain = plain.unionByName(rest.join(picked, (F.col("digest") == F.col("d2")) & (F.col("text") == F.col("t2"))).select("id", "digest", "keep_id", "group_size"))
    return plain.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", **settings) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class of equal texts, with all their columns.

    Of rows that repeat id and text any one stays; of a class without ids, too.
    """
    own_id, own, of, same = (unused(docs, n) for n in ("__id", "__digest", "__of", "__same"))
    kept = exact_dedup(docs, id_col, text_col, keep, **settings).where("kept").select(F.col("id").alias(own_id), F.col("digest").alias(of)).distinct()
    digest, text = settings.get("digest", sha256_digest), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn(own, digest(text))
    rows = rows.join(kept, (F.col(own) == F.col(of)) & F.col(id_col).eqNullSafe(F.col(own_id)), "left_semi")
    return rows.withColumn(same, F.col(own) if digest is sha256_digest else text).dropDuplicates([id_col, same]).select(*docs.columns)
