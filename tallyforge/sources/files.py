"""Files as inputs and outputs: folders of documents behind a gate, and deliveries as CSV with a manifest."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import listed, publish, read_text, stored
from .ingest import EXTENSIONS

_EXTENSION = r"[^/.][^/]*\.([^./]+)$"


def write_files(files: DataFrame, path: str) -> int:
    """Writes each row (name, content: bytes) as a file of its own under ``path``; returns how many.  Names are unique; nulls are empty.

    Tasks write through Arrow's file systems (local, HDFS, S3, GCS).  A task that runs again writes the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        n = 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with system.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(content.as_py() or b"")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def judged(found: DataFrame, max_bytes: int, extensions: list[str]) -> DataFrame:
    """``found`` (path, length) with ``extension`` and ``reason``: too_large, empty or extension; null where a look at the content decides."""
    ext = F.lower(F.regexp_extract("path", _EXTENSION, 1))
    return found.withColumn("extension", ext).withColumn("reason", F.when(F.col("length") > max_bytes, "too_large").when(F.col("length") == 0, "empty").when(~ext.isin(extensions), "extension"))


def ingest_folder(spark: SparkSession, path: str, max_bytes: int = 50 << 20, extensions: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted files (path, length, extension, file_hash, content) of a folder and those below it, and the quarantine (path, length, reason).

    Size and extension are judged by the listing alone.  Content is read of the rest only, the size being a filter of the scan and the
    extension a pattern of its paths; a .pdf that doesn't start with %PDF goes to the quarantine too.  Both results are stored.  A file is a row, so
    ``max_bytes`` bounds a row; an empty folder gives two empty tables.  Names that begin with a dot or an underscore are no inputs for Spark.
    """
    wanted = [e.lower() for e in (extensions or EXTENSIONS)]
    scan = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True)
    there = scan().load(path).select("path", "length")
    names = spark.createDataFrame([(f,) for f in there.inputFiles()], "path string")  # the listing that the driver has; a scan leaves empty files out
    key = F.url_decode(F.regexp_replace("path", "^file:/+", "file:/"))
    empty = names.withColumn("key", key).join(there.select(key.alias("key")), "key", "left_anti").select("path", F.lit(0).cast("long").alias("length"))
    found = judged(there.unionByName(empty), max_bytes, wanted)
    either_case = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in wanted]
    read = scan().option("pathGlobFilter", "*.{" + ",".join(either_case) + "}").load(path).where((F.col("length") > 0) & (F.col("length") <= max_bytes))
    read = judged(read, max_bytes, wanted).where("reason is null")
    odd = (F.col("extension") == "pdf") & (F.substring("content", 1, 4) != F.lit(b"%PDF"))
    seen = stored(read.select("path", "length", "extension", F.when(odd, "not_a_pdf").alias("reason"), F.sha2("content", 256).alias("file_hash"), F.when(~odd, F.col("content")).alias("content")), "files")
    rejected = found.where("reason is not null").select("path", "length", "reason").unionByName(seen.where("reason is not null").select("path", "length", "reason"))
    return seen.where("reason is null").drop("reason"), stored(rejected, "quarantine")


def write_delivery(rows: DataFrame, path: str, header: list[str]) -> None:
    """``rows`` as CSV files under ``path``, the columns in the order of ``header``, each file with the header; all that is missing is ''.

    The delivery counts once its manifest is there, which names the files, their bytes and the header; it is written last.  A column of
    ``header`` that ``rows`` lacks is '', and one beyond it is an error, as is a delivery that is there already.
    """
    spark = rows.sparkSession
    if more := [c for c in rows.columns if c not in header]:
        raise ValueError(f"not in the header: {', '.join(more)}")
    cell = lambda c: (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in rows.columns else F.lit("")).alias(c)
    rows.select(*[cell(c) for c in header]).write.mode("overwrite").option("header", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(f"{path}/data")
    files = {n: size for n, size, folder in listed(spark, f"{path}/data") if not folder and n.endswith(".csv")}
    if not publish(spark, f"{path}/manifest.json", json.dumps({"header": header, "files": files})):
        raise ValueError(f"{path} holds a delivery")


def read_delivery(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a delivery, of the files that its manifest names; all columns are text and nulls ''.  No manifest, no delivery: an error."""
    said = json.loads(read_text(spark, f"{path}/manifest.json"))
    schema = ", ".join(f"`{c}` string" for c in said["header"])
    if not said["files"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').csv([f"{path}/data/{f}" for f in said["files"]]).na.fill("")


def delivery_faults(spark: SparkSession, path: str, template: list[str]) -> DataFrame:
    """(file, fault): header where a file's first line isn't that of ``template``, missing or size where a file isn't as the manifest says."""
    said = json.loads(read_text(spark, f"{path}/manifest.json"))
    there = {n: size for n, size, folder in listed(spark, f"{path}/data") if not folder}
    faults = [(f, "missing") for f in said["files"] if f not in there] + [(f, "size") for f, n in said["files"].items() if f in there and there[f] != n]
    out = spark.createDataFrame(faults, "file string, fault string")
    held = [f"{path}/data/{f}" for f in said["files"] if there.get(f)]
    if not held:
        return out
    line = F.split(F.col("value"), "\n", 2)[0]
    heads = spark.read.text(held, lineSep="\n").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.rtrim(line).alias("line"))
    right = heads.groupBy("file").agg(F.count_if(F.col("line") == ",".join(template)).alias("n"))
    return out.unionByName(right.where("n = 0").select("file", F.lit("header").alias("fault")))
