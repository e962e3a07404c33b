"""Storage that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; only a local session may lack the setting, and then gets one."""
    sc = spark.sparkContext
    base, now = sc.getConf().get("spark.checkpoint.dir"), sc._jsc.sc().getCheckpointDir()
    if not now.isDefined():
        if base is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(base or f"file://{tempfile.mkdtemp(prefix='quire-')}")
    return (base or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; what is written there stays until its owner deletes it."""
    return f"{shared_folder(spark)}/quire-{name}-{uuid.uuid4().hex[:12]}"


def hold(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(uri: str):
    """(pyarrow file system, path) of an address or a local path, for the driver and for tasks."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    return (LocalFileSystem(), uri.removeprefix("file://")) if uri.startswith(("/", "file:///")) else FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Write under a side name, then move: readers see the old file or the new one, and a task that runs again leaves one whole file."""
    fs, path = file_system(uri)
    folder, _, name = path.rpartition("/")
    side = f"{folder}/.{name}.{uuid.uuid4().hex}"
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(side) as f:
        f.write(data)
    fs.move(side, path)


def committed(uri: str) -> bool:
    """Has Spark finished writing this folder?"""
    fs, path = file_system(uri)
    return fs.get_file_info(f"{path}/_SUCCESS").type.name == "File"


def numbered(uri: str, name: str) -> list[int]:
    """Ascending numbers n of the finished folders uri/name=n."""
    from pyarrow.fs import FileSelector

    fs, path = file_system(uri)
    found = fs.get_file_info(FileSelector(path, allow_not_found=True))
    numbers = [int(f.base_name.partition("=")[2]) for f in found if f.base_name.startswith(f"{name}=")]
    return sorted(n for n in numbers if committed(f"{uri}/{name}={n}"))


def drop_folder(uri: str) -> None:
    fs, path = file_system(uri)
    fs.delete_dir(path)
