"""Files in and out: folder scans, archives, restored folders, storage addresses."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Providers and the file-system scheme Spark reads them by.
SCHEMES = {"filesystem": "file", "s3": "s3a", "azure": "abfss", "gcs": "gs", "webdav": None, "sftp": "sftp", "b2": "s3a", "gdrive": None, "rclone": None}


def address(provider: str, bucket: str, path: str = "") -> str:
    """URI of a store of a provider (SC08); providers without a Hadoop file system are an error."""
    scheme = SCHEMES.get(provider)
    if scheme is None:
        raise ValueError(f"{provider} has no file system that Spark reads")
    return f"{scheme}://{'' if provider == 'filesystem' else bucket + '/'}{path}" if path or provider != "filesystem" else f"{scheme}://{bucket}"


def scan_folder(spark: SparkSession, path: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """Files below a folder with length and time, and with their bytes if asked for (SC16)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows if content else rows.drop("content")


def virtual_folder(spark: SparkSession, files: dict[str, bytes]) -> DataFrame:
    """A folder held in memory (SC17)."""
    return spark.createDataFrame([(k, bytearray(v), len(v)) for k, v in files.items()], "path string, content binary, length bigint")


def write_archives(df: DataFrame, path: str, content: str, folder: str, kind: str = "tar", archives: int | None = None) -> DataFrame:
    """One archive per task below ``folder``, ``tar`` or ``zip`` (SC19); files are sorted by path
    within theirs. Gives ``archive, files, bytes``; a task that runs again overwrites its own archive.
    A row must fit into memory, an archive need not: it is written to the shared folder as it grows."""
    spark = df.sparkSession
    conf = {"root": folder, "kind": kind}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}.{conf['kind']}"
        n, total, out, raw = 0, 0, None, None
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p is None or c is None:
                    continue
                if out is None:
                    raw = _created(conf["root"], name)
                    out = tarfile.open(fileobj=raw, mode="w|") if conf["kind"] == "tar" else zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
                if conf["kind"] == "tar":
                    info = tarfile.TarInfo(p)
                    info.size = len(c)
                    out.addfile(info, io.BytesIO(c))
                else:
                    out.writestr(zipfile.ZipInfo(p), c)
                n, total = n + 1, total + len(c)
        if out is not None:
            out.close()
            raw.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["archive", "files", "bytes"])

    rows = df.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content"))
    rows = rows.repartitionByRange(archives or int(spark.conf.get("spark.sql.shuffle.partitions")), "path").sortWithinPartitions("path")
    return rows.mapInArrow(run, "archive string, files bigint, bytes bigint")


def _created(root: str, name: str):
    """A new file below a folder of any file system that pyarrow opens by its address, such as
    ``file://``, ``hdfs://``, ``s3://`` or ``gs://``; folders are made as needed."""
    store, at = fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))
    target = f"{at}/{name}"
    store.create_dir(target.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(target)


#: Suffix of the file that stands for an entry whose content isn't restored.
PLACEHOLDER = ".placeholder"


def _below(path: str) -> str:
    """A path that stays below the folder it is restored to."""
    names = [n for n in path.replace("\\", "/").split("/") if n not in ("", ".")]
    if not names or ".." in names:
        raise ValueError(f"not a path below a folder: {path!r}")
    return "/".join(names)


def restore(df: DataFrame, path: str, content: str, folder: str, depth: int | None = None) -> DataFrame:
    """Files written below ``folder`` (SC19): ``path, bytes, placeholder`` of each. Files in more than
    ``depth`` folders are written as a small placeholder, JSON of their path and size, in place of
    their content. Rows without path or content are skipped; a path that leads out of the folder is
    an error; a task that runs again writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, sizes, marks = [], [], []
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p is None or c is None:
                    continue
                name = _below(p)
                mark = depth is not None and name.count("/") > depth
                with _created(folder, name + PLACEHOLDER if mark else name) as out:
                    out.write(json.dumps({"path": name, "size": len(c)}).encode() if mark else c)
                paths.append(p)
                sizes.append(len(c))
                marks.append(mark)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(marks, pa.bool_())], names=["path", "bytes", "placeholder"])

    return df.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "path string, bytes bigint, placeholder boolean")
