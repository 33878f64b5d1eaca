"""Files below a folder, read where the tasks run: hash trees over slices, and the schemas in Parquet footers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20
READ_BYTES = 1 << 20
MANIFEST = "_manifest"  # readers of tables skip names that start so
TREE = "name string, size_bytes long, slices long, sha256 string"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (Hadoop's ``s3a`` is ``s3`` here)."""
    scheme, found, rest = path.partition(":")
    return fs.FileSystem.from_uri(f"s3:{rest}" if found and scheme in ("s3a", "s3n") else path)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, size_bytes) of every file below a folder that readers of tables see; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size_bytes"))
    # the name is the path from the folder on, whatever scheme the listing puts before it
    tail = folder.rstrip("/").rsplit("/", 1)[-1] + "/"
    return files.select("path", F.substring_index("path", tail, -1).alias("name"), "size_bytes")


def slice_digests(files: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(name, size_bytes, slice, digest): every file cut into slices, each read by its range and hashed in a task of its own choice."""
    last = F.greatest(F.ceil(F.col("size_bytes") / slice_bytes) - 1, F.lit(0)).cast("long")
    slices = files.select("path", "name", "size_bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("slice"))
    spread = slices.repartition("name", "slice")

    def run(batches):
        for batch in batches:
            digests = []
            for path, size, number in zip(batch.column("path").to_pylist(), batch.column("size_bytes").to_pylist(), batch.column("slice").to_pylist()):
                store, place = filesystem(path)
                digest = hashlib.sha256()
                with store.open_input_file(place) as file:
                    at, end = number * slice_bytes, min(size, (number + 1) * slice_bytes)
                    while at < end:
                        data = file.read_at(min(READ_BYTES, end - at), at)
                        if not data:
                            break
                        digest.update(data)
                        at += len(data)
                digests.append(digest.digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("name"), batch.column("size_bytes"), batch.column("slice"), pa.array(digests, pa.binary())],
                names=["name", "size_bytes", "slice", "digest"],
            )

    return spread.mapInArrow(run, "name string, size_bytes long, slice long, digest binary")


def hash_tree(spark: SparkSession, folder: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per file: name, size, slices and the root hash, that of its slices' hashes in order.

    A huge file is hashed by many tasks; what is gathered per file are 32 bytes a slice. The listing and the slices see the
    files as they are when the table is read.
    """
    digests = slice_digests(listing(spark, folder), slice_bytes)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("slice", "digest"))), lambda s: F.hex(s["digest"]))
    grouped = digests.groupBy("name", "size_bytes").agg(F.count(F.lit(1)).alias("slices"), F.array_join(ordered, "").alias("_all"))
    return grouped.select("name", "size_bytes", "slices", F.sha2(F.unhex("_all"), 256).alias("sha256"))


def write_manifest(spark: SparkSession, folder: str, slice_bytes: int = SLICE_BYTES) -> None:
    """Write the folder's hash tree beside its files."""
    tree = hash_tree(spark, folder, slice_bytes)
    tree.withColumn("slice_bytes", F.lit(slice_bytes).cast("long")).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{MANIFEST}")


def verify_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, problem) of the files that differ from the manifest: ``missing``, ``size``, ``content`` or ``unlisted``.

    Files whose size differs already are not read.
    """
    declared = spark.read.parquet(f"{folder.rstrip('/')}/{MANIFEST}")
    slice_bytes = declared.agg(F.max("slice_bytes")).first()[0] or SLICE_BYTES
    there = listing(spark, folder)
    said = declared.select("name", F.col("size_bytes").alias("declared_size"), F.col("sha256").alias("declared_sha256"))
    both = said.join(there, "name", "full_outer")
    problem = F.when(F.col("path").isNull(), "missing").when(F.col("declared_size").isNull(), "unlisted").when(F.col("declared_size") != F.col("size_bytes"), "size")
    graded = both.select("name", problem.alias("problem")).filter(F.col("problem").isNotNull())
    same = there.join(said, "name").filter(F.col("declared_size") == F.col("size_bytes"))
    digests = slice_digests(same.select("path", "name", "size_bytes"), slice_bytes)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("slice", "digest"))), lambda s: F.hex(s["digest"]))
    roots = digests.groupBy("name").agg(F.sha2(F.unhex(F.array_join(ordered, "")), 256).alias("sha256"))
    changed = roots.join(said, "name").filter(F.col("sha256") != F.col("declared_sha256")).select("name", F.lit("content").alias("problem"))
    return graded.unionByName(changed)


def footer_columns(spark: SparkSession, folder: str) -> DataFrame:
    """(position, column, nullable, files) as the Parquet footers of a folder say: one row per distinct statement."""
    files = listing(spark, folder).filter(F.col("name").endswith(".parquet")).select("path")

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = filesystem(path)
                with store.open_input_file(place) as file:
                    schema = pq.ParquetFile(file).schema_arrow
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(schema), dtype=np.int32)), pa.array(schema.names, pa.string()), pa.array([f.nullable for f in schema], pa.bool_())],
                    names=["position", "column", "nullable"],
                )

    found = files.mapInArrow(run, "position int, column string, nullable boolean")
    return found.groupBy("position", "column", "nullable").agg(F.count(F.lit(1)).alias("files"))
