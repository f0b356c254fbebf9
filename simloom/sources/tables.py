"""Item tables on storage: save and load by format, many at once, per item, and in versions."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables of a listing that one scan reads, and items of one bucket of payloads, about.
NAMES_A_SCAN, BUCKET_ITEMS = 1000, 100_000

ITEM_SCHEMA = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("label", T.LongType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("vec", T.ArrayType(T.DoubleType())),
    ]
)


def file_format(path: str) -> str:
    """Format by extension: text (.csv, .txt), markup (.json, .yml, .xml) or binary (the rest)."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    return {"csv": "csv", "txt": "csv", "json": "json", "yml": "json", "xml": "json", "orc": "orc"}.get(ext, "parquet")


def save_items(items: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    fmt = file_format(path)
    known = [f.name for f in ITEM_SCHEMA if f.name in items.columns]
    items = items.select(*known, *[c for c in items.columns if c not in known])
    if fmt == "csv":  # no arrays in text: one blank-separated field
        items = items.withColumn("vec", F.array_join(F.col("vec").cast("array<string>"), " "))
    writer = items.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("sep", "\t")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def load_items(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    """Items of one or many tables; the files are listed together and read as one scan."""
    fmt = file_format(paths[0])
    reader = spark.read.format(fmt)
    if fmt == "csv":
        text = T.StructType([
            T.StructField(f.name, T.StringType() if f.name == "vec" else f.dataType)
            for f in (schema or ITEM_SCHEMA)
        ])
        df = reader.schema(text).option("header", True).option("sep", "\t").load(list(paths))
        return df.withColumn("vec", F.split("vec", " ").cast("array<double>"))
    if fmt == "json":
        reader = reader.schema(schema or ITEM_SCHEMA)
    elif schema is not None:
        reader = reader.schema(schema)
    return reader.load(list(paths))


def load_listed(spark: SparkSession, listing: str) -> DataFrame:
    """Item tables named one per line in a text file; comments and blanks skipped.

    Names come to the driver a partition at a time, as a scan needs them there, and each ``NAMES_A_SCAN`` of them
    become one scan.
    """
    lines = spark.read.text(listing).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    names = (r[0].strip() for r in lines.toLocalIterator())
    scans = []
    while group := list(itertools.islice(names, NAMES_A_SCAN)):
        scans.append(load_items(spark, *group))
    return reduce(DataFrame.unionByName, scans) if scans else spark.createDataFrame([], ITEM_SCHEMA)


def clear_partition(spark: SparkSession, path: str, values: dict) -> None:
    """Empty one partition of a partitioned table."""
    folder = path + "".join(f"/{k}={v}" for k, v in values.items())
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path, True)


def save_per_item(items: DataFrame, path: str, weights: dict[str, float], buckets: int | None = None) -> None:
    """Manifest and payloads kept per item: (item_id, file) beside one folder of payloads per bucket.

    One file per item does not last at scale; a bucket of the id's hash stands for it, and the
    manifest names the bucket an item's payload is in. Buckets grow with the items unless their number is given.
    """
    spark = items.sparkSession
    if buckets is None:
        buckets = max(1, -(-items.count() // BUCKET_ITEMS))
    placed = items.withColumn("bucket", F.pmod(F.xxhash64("item_id"), F.lit(buckets)).cast("int"))
    placed.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path + "/payload")
    placed.select("item_id", F.concat(F.lit("bucket="), F.col("bucket")).alias("file")).write.mode(
        "overwrite").parquet(path + "/manifest")
    spark.createDataFrame(list(weights.items()), "dtype string, weight double").write.mode(
        "overwrite").parquet(path + "/weights")


def load_per_item(spark: SparkSession, path: str) -> DataFrame:
    """Payloads that the manifest still names."""
    manifest = spark.read.parquet(path + "/manifest")
    payload = spark.read.parquet(path + "/payload").withColumn(
        "file", F.concat(F.lit("bucket="), F.col("bucket"))
    )
    return payload.join(manifest, ["item_id", "file"], "left_semi").drop("file", "bucket")


class VersionedTable:
    """A table as numbered folders: readers keep the version they opened, writers add the next.

    A version becomes visible when its folder is complete (renamed into place), so a writer may be
    lost at any time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())

    def read(self, version: int | None = None) -> DataFrame | None:
        known = self.versions()
        if not known:
            return None
        return self.spark.read.parquet(f"{self.root}/v={known[-1] if version is None else version}")

    def write(self, df: DataFrame, version: int | None = None) -> int:
        """Write the next version; an existing number is kept as it is (a replayed batch)."""
        known = self.versions()
        number = (known[-1] + 1 if known else 0) if version is None else version
        if number in known:
            return number
        staged, final = f"{self.root}/_staged-{number}", f"{self.root}/v={number}"
        df.write.mode("overwrite").parquet(staged)
        if not self._fs.rename(self._path(staged), self._path(final)):
            raise OSError(f"cannot publish version {number} of {self.root}")
        return number


class PartedLog:
    """Rows kept as a log of numbered batches and bases, each dealt to folders by a hash of the columns ``by``.

    A batch only writes its own rows; a replayed batch writes its folder again, so it counts once. ``compact``
    rewrites everything up to the last batch as a base of about ``part_rows`` rows a folder. A reader that
    names values of ``by`` opens the folders of their hashes only, so what it reads follows the values
    asked for and not the size of the log.
    """

    #: Most folders of a batch or base; all numbers of folders are powers of two under it.
    MOST_PARTS = 4096

    def __init__(self, spark: SparkSession, root: str, by: list[str], part_rows: int = 200_000, compact_every: int | None = 64):
        self.spark, self.root, self.by = spark, root.rstrip("/"), by
        self.part_rows, self.compact_every = part_rows, compact_every
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.root}/_kind={kind}/_no={number}"

    def _numbers(self, kind: str) -> list[int]:
        """Complete folders that hold rows."""
        top = self._path(f"{self.root}/_kind={kind}")
        if not self._fs.exists(top):
            return []
        out = []
        for status in self._fs.listStatus(top):
            inside = {s.getPath().getName() for s in self._fs.listStatus(status.getPath())}
            if "_SUCCESS" in inside and any(n.startswith("_parts=") for n in inside):
                out.append(int(status.getPath().getName().removeprefix("_no=")))
        return sorted(out)

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in self.by]), F.lit(self.MOST_PARTS)).cast("int")

    def _write(self, rows: DataFrame, kind: str, number: int, parts: int) -> None:
        dealt = rows.withColumn("_parts", F.lit(parts)).withColumn("_part", self._slot() % parts)
        dealt.repartition("_part").write.mode("overwrite").partitionBy("_parts", "_part").parquet(self._folder(kind, number))

    def add(self, rows: DataFrame, batch: int, parts: int = 1) -> None:
        self._write(rows, "batch", batch, parts)
        if self.compact_every and len(self._since()[1]) >= self.compact_every:
            self.compact()

    def _since(self, before: int | None = None) -> tuple[int | None, list[int]]:
        """The newest base and the batches after it."""
        bases = [b for b in self._numbers("base") if before is None or b < before]
        base = bases[-1] if bases else None
        later = [b for b in self._numbers("batch") if (base is None or b > base) and (before is None or b < before)]
        return base, later

    def _open(self, kind: str, numbers: list[int], only: DataFrame | None) -> DataFrame | None:
        if not numbers:
            return None
        paths = [self._folder(kind, n) for n in numbers]
        rows = self.spark.read.option("basePath", self.root).parquet(*paths)
        if only is not None:
            wanted = only.select(*self.by).distinct()
            slots = [r[0] for r in wanted.select(self._slot()).distinct().collect()]  # at most MOST_PARTS numbers
            sizes = [1 << i for i in range(self.MOST_PARTS.bit_length())]
            codes = sorted({n * 2 * self.MOST_PARTS + s % n for n in sizes for s in slots})
            rows = rows.filter((F.col("_parts") * (2 * self.MOST_PARTS) + F.col("_part")).isin(codes)).join(wanted, self.by, "left_semi")
        return rows.drop("_kind", "_no", "_parts", "_part")

    def read(self, before: int | None = None, only: DataFrame | None = None) -> DataFrame | None:
        """Rows, or those before a batch; None while there are none. ``only`` keeps the values of ``by`` that a table has."""
        base, later = self._since(before)
        held = self._open("base", [] if base is None else [base], only)
        fresh = self._open("batch", later, only)
        return self._merged(held, fresh)

    def _merged(self, held: DataFrame | None, fresh: DataFrame | None) -> DataFrame | None:
        return fresh if held is None else held if fresh is None else held.unionByName(fresh)

    def compact(self) -> None:
        """Write the rows as a new base; the batches under it are no longer read."""
        _, later = self._since()
        if later:
            rows = self.read()
            parts = 1 << max(0, (max(1, rows.count()) - 1) // self.part_rows).bit_length()
            self._write(rows, "base", later[-1], min(parts, self.MOST_PARTS))


class LogTable(PartedLog):
    """A keyed table as a log: ``seq`` orders the rows of a key, ``deleted`` marks removals.

    Readers take the latest row per key. A base holds one row a key, so only the rows of keys that later
    batches name are compared; without such batches the base is read as it is. ``by`` are the columns that
    the folders go by, the key unless something else is asked for; all rows of a key must agree on them.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "item_id", by: list[str] | None = None, **how):
        super().__init__(spark, root, by or [key], **how)
        self.key = key

    def _merged(self, held: DataFrame | None, fresh: DataFrame | None) -> DataFrame | None:
        if fresh is None:
            return held
        rest = [c for c in fresh.columns if c != self.key]
        changed = fresh.select(self.key).distinct()
        rows = fresh if held is None else fresh.unionByName(held.join(changed, self.key, "left_semi"))
        latest = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), "seq").alias("_r")).filter(~F.col("_r.deleted")).select(
            self.key, *[F.col(f"_r.{c}").alias(c) for c in rest]
        )
        return latest if held is None else held.join(changed, self.key, "left_anti").unionByName(latest)
