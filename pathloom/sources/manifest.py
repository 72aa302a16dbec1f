"""Bundle manifests: scan, fixity, build, sink and validation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom import constants as K
from pathloom.operators.rounds import stage_width

c = F.col
HASH_BYTES = 8 << 20

FILE_TYPE = "struct<logical_name:string,path:string,sha256:string,size_bytes:bigint,media_type:string>"
SCHEMA = (
    "schema_version int, bundle_id string, coverage string, generated_at timestamp,"
    f" source_versions map<string,string>, files array<{FILE_TYPE}>, attribution array<string>"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest documents under the fixed schema; malformed ones fail the read."""
    return spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def manifest_files(manifest: DataFrame) -> DataFrame:
    return manifest.select("bundle_id", F.inline("files"))


def scan_files(spark: SparkSession, directory: str) -> DataFrame:
    """Size and SHA-256 of every file below a directory.

    Files are listed without their content; each is then streamed through its task in pieces of HASH_BYTES, so files of
    any size take bounded memory. File systems that only Spark's readers open are read whole, up to 2 GB a file.
    Spark's readers pass over empty files, so those are listed by the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    relative = F.substring_index(c("path"), directory.rstrip("/") + "/", -1)
    empty = spark.createDataFrame(_empty_files(spark, directory), "path string").select(
        relative.alias("path"), F.lit(0).cast("long").alias("size_bytes"), F.sha2(F.lit("").cast("binary"), 256).alias("sha256")
    )
    if not _opens(files):
        return files.select(relative.alias("path"), c("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256")).unionByName(empty)
    listed = files.select(relative.alias("path"), c("length").alias("size_bytes"), c("path").alias("uri"))
    dealt = listed.repartition(stage_width(spark), F.xxhash64("uri"))
    return dealt.mapInArrow(_hashed, "path string, size_bytes long, sha256 string").unionByName(empty)


def _empty_files(spark: SparkSession, directory: str) -> list[tuple[str]]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(directory)
    listed = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listFiles(folder, True)
    found = []
    while listed.hasNext():
        status = listed.next()
        if status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
            found.append((status.getPath().toString(),))
    return found


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there."""
    return (fs.LocalFileSystem(), uri.removeprefix("file:").replace("///", "/", 1)) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def _opens(files: DataFrame) -> bool:
    first = files.select("path").first()
    if first is None:
        return True
    try:
        _opened(first[0])
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def file_sha256(uri: str) -> str:
    """SHA-256 of a file, read in pieces."""
    files, path = _opened(uri)
    digest = hashlib.sha256()
    with files.open_input_stream(path) as stream:
        while piece := stream.read(HASH_BYTES):
            digest.update(piece)
    return digest.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [file_sha256(uri) for uri in batch.column("uri").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("size_bytes"), pa.array(hashes, pa.string())], ["path", "size_bytes", "sha256"])


def build_manifest(
    files: DataFrame, bundle_id: str, coverage: str, source_versions: dict[str, str], attribution: list[str], as_of: str
) -> DataFrame:
    """One manifest row from a table of (logical_name, path, sha256, size_bytes, media_type)."""
    entry = F.struct("logical_name", "path", "sha256", "size_bytes", "media_type")
    return files.agg(F.array_sort(F.collect_list(entry)).alias("files")).select(
        F.lit(K.BUNDLE_SCHEMA_VERSION).alias("schema_version"),
        F.lit(bundle_id).alias("bundle_id"),
        F.lit(coverage).alias("coverage"),
        F.lit(as_of).cast("timestamp").alias("generated_at"),
        F.create_map(*[F.lit(x) for kv in sorted(source_versions.items()) for x in kv]).alias("source_versions"),
        "files",
        F.array_sort(F.array_distinct(F.array(*[F.lit(a) for a in attribution]))).alias("attribution"),
    )


def manifest_json(manifest: DataFrame) -> DataFrame:
    """Canonical JSON text of each manifest, keys sorted."""
    names = sorted(manifest.columns)
    entries = F.transform(
        "files",
        lambda f: F.struct(*[f[n].alias(n) for n in ("logical_name", "media_type", "path", "sha256", "size_bytes")]),
    )
    ordered = F.struct(*[(entries if n == "files" else c(n)).alias(n) for n in names])
    return manifest.select(F.to_json(ordered).alias("value"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest_json(manifest).write.mode("overwrite").text(path)


def escapes_root(path: Column) -> Column:
    """Whether a walk over the parts of a path (``..`` goes up) ever leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    walk = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("depth"), F.lit(False).alias("out")),
        lambda acc, p: F.struct(
            F.when(p == "..", acc["depth"] - 1).otherwise(acc["depth"] + 1).alias("depth"),
            (acc["out"] | ((p == "..") & (acc["depth"] <= 0))).alias("out"),
        ),
    )
    return walk["out"] | path.startswith("/")


def validate_bundle(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Findings (bundle_id, severity, message) of manifests against the files found on disk."""
    def finding(frame: DataFrame, message: Column, severity: str = "error") -> DataFrame:
        return frame.select("bundle_id", F.lit(severity).alias("severity"), message.alias("message"))

    version = manifest.filter(c("schema_version") != K.BUNDLE_SCHEMA_VERSION)
    names = F.transform("files", lambda f: f["logical_name"])
    absent = F.array_sort(F.array_except(F.array(*[F.lit(n) for n in K.BUNDLE_REQUIRED]), names))
    entries = manifest_files(manifest).withColumn("_escapes", escapes_root(c("path")))
    inside = entries.filter(~c("_escapes")).join(
        files.select("path", c("size_bytes").alias("_size"), c("sha256").alias("_sha")), "path", "left"
    )
    found = inside.filter(c("_size").isNotNull())
    parts = [
        finding(version, F.concat(F.lit("Unsupported schema version "), c("schema_version").cast("string"),
                                  F.lit(f"; expected {K.BUNDLE_SCHEMA_VERSION}"))),
        finding(manifest.withColumn("_absent", absent).filter(F.size("_absent") > 0),
                F.concat(F.lit("Missing required logical files: "), F.array_join("_absent", ", "))),
        finding(manifest.filter(F.coalesce(F.size("attribution"), F.lit(0)) <= 0), F.lit("At least one attribution statement is required")),
        finding(manifest.filter(F.coalesce(F.size("source_versions"), F.lit(0)) <= 0), F.lit("Source versions are required")),
        finding(entries.filter("_escapes"), F.concat(F.lit("Bundle path escapes its root: "), c("path"))),
        finding(inside.filter(c("_size").isNull()), F.concat(F.lit("Missing bundle file: "), c("path"))),
        finding(found.filter(c("_size") != c("size_bytes")), F.concat(F.lit("Size mismatch: "), c("path"))),
        finding(found.filter(c("_sha") != c("sha256")), F.concat(F.lit("Checksum mismatch: "), c("path"))),
        finding(found.filter(c("size_bytes") == 0), F.concat(F.lit("Empty bundle file: "), c("path")), "warning"),
    ]
    return reduce(DataFrame.unionByName, parts)
