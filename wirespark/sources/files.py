"""File systems from Python: local or shared folders, and any store that pyarrow can open."""

from __future__ import annotations

from urllib.parse import urlparse


def filesystem(path: str):
    from pyarrow import fs

    where = urlparse(path)
    if where.scheme in ("", "file"):
        return fs.LocalFileSystem(), where.path
    return fs.FileSystem.from_uri(path)


def scratch(spark, name: str) -> str:
    """A folder of its own in shared storage: spark.checkpoint.dir where the cluster sets it."""
    import tempfile
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wirespark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
