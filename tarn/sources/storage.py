"""Paths and files, through Hadoop's file systems, so that any store that Spark reads works."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class FileInfo:
    path: str
    size: int
    modified_ms: int


def absolute(path: str) -> bool:
    return "://" in path or path.startswith(("/", "file:"))


def join(base: str, path: str) -> str:
    return path if absolute(path) else base + ("" if base.endswith("/") else "/") + path


def relative_to(path: str, base: str) -> tuple[str, bool]:
    """(path below base, True), or (path, False)."""
    p, b = plain(path), plain(base)
    b = b if b.endswith("/") else b + "/"
    return (p[len(b) :], True) if p.startswith(b) else (path, False)


def plain(path: str) -> str:
    """One spelling of local paths; s3 is s3a to Hadoop."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    for short, long in (("s3://", "s3a://"), ("gcs://", "gs://"), ("az://", "wasbs://")):
        if path.startswith(short):
            return long + path[len(short) :]
    return path


class Mounted:
    """Files in a folder that this process sees, without Hadoop; executors have no other way to them from Python."""

    @staticmethod
    def has(path: str) -> bool:
        local = plain(path)
        return local.startswith("/") and os.path.exists(local)

    def size(self, path: str) -> int:
        return os.path.getsize(plain(path))

    def tail(self, path: str, n: int) -> bytes:
        with open(plain(path), "rb") as f:
            f.seek(max(0, self.size(path) - n))
            return f.read()


class Files:
    """Listing, reading tails, deleting."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def at(self, path: str) -> tuple[Any, Any]:
        p = self.jvm.org.apache.hadoop.fs.Path(plain(path))
        return p.getFileSystem(self.conf), p

    def list(self, path: str) -> list[FileInfo]:
        """All files below a folder; none if it does not exist. Names that begin with _ or . are not data."""
        fs, p = self.at(path)
        if not fs.exists(p):
            return []
        out, it = [], fs.listFiles(p, True)
        while it.hasNext():
            f = it.next()
            name = f.getPath().getName()
            if not name.startswith(("_", ".")):
                out.append(FileInfo(plain(f.getPath().toString()), f.getLen(), f.getModificationTime()))
        return sorted(out, key=lambda f: f.path)

    def below(self, path: str, depth: int = 0) -> list[str]:
        """Paths of the files ``depth`` folders below a folder, as list() has them, by a few calls to the JVM however many they are.

        list() asks for the owner of each file, for which Hadoop starts a process where files are local.
        """
        fs, p = self.at(path)
        if not fs.exists(p):
            return []
        hadoop, java, make = self.jvm.org.apache.hadoop, self.jvm.java, self.spark.sparkContext._gateway.new_array
        found = make(hadoop.fs.Path, 1)
        found[0] = p
        for _ in range(depth + 1):
            found = hadoop.fs.FileUtil.stat2Paths(fs.listStatus(found))
        objects = make(java.lang.Object, len(found))
        java.lang.System.arraycopy(found, 0, objects, 0, len(found))
        names = str(hadoop.util.StringUtils.join("\0", java.util.Arrays.asList(objects)))
        return sorted(plain(x) for x in names.split("\0") if x and not x.rpartition("/")[2].startswith(("_", ".")))

    def size(self, path: str) -> int:
        fs, p = self.at(path)
        return fs.getFileStatus(p).getLen()

    def exists(self, path: str) -> bool:
        fs, p = self.at(path)
        return fs.exists(p)

    def delete(self, path: str) -> bool:
        """False if it was not there."""
        fs, p = self.at(path)
        return fs.delete(p, True)

    def key(self, path: str) -> str:
        """The path as Spark's hidden column of file paths spells it, percent-encoded; local ones with one slash."""
        fs, p = self.at(path)
        return re.sub("^file:/+", "file:/", fs.makeQualified(p).toUri().toString())

    def tail(self, path: str, n: int) -> bytes:
        if Mounted.has(path):
            return Mounted().tail(path, n)
        fs, p = self.at(path)
        size = fs.getFileStatus(p).getLen()
        stream = fs.open(p)
        try:
            stream.seek(max(0, size - n))
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(n, size)))
        finally:
            stream.close()


# Environment variables of the stores' own tools, and the Hadoop settings that they become.
FROM_ENVIRONMENT = {
    "AWS_ACCESS_KEY_ID": "fs.s3a.access.key", "AWS_SECRET_ACCESS_KEY": "fs.s3a.secret.key", "AWS_SESSION_TOKEN": "fs.s3a.session.token", "AWS_ENDPOINT_URL": "fs.s3a.endpoint", "AWS_REGION": "fs.s3a.endpoint.region",
    "GOOGLE_APPLICATION_CREDENTIALS": "fs.gs.auth.service.account.json.keyfile", "AZURE_STORAGE_ACCOUNT_NAME": "fs.azure.account.name", "AZURE_STORAGE_ACCOUNT_KEY": "fs.azure.account.key",
}


def storage_settings(options: Mapping[str, str] | None, environment: Mapping[str, str]) -> dict[str, str]:
    """Hadoop settings from the environment, and over them from options: names of either kind, in any case."""
    out = {hadoop: environment[name] for name, hadoop in FROM_ENVIRONMENT.items() if name in environment}
    for k, v in (options or {}).items():
        out[FROM_ENVIRONMENT.get(k.upper(), k)] = v
    if "fs.s3a.endpoint" in out:
        out.setdefault("fs.s3a.path.style.access", "true")
    account = out.pop("fs.azure.account.name", None)
    if account and "fs.azure.account.key" in out:
        out[f"fs.azure.account.key.{account}.dfs.core.windows.net"] = out.pop("fs.azure.account.key")
    return out


def apply_settings(spark: SparkSession, settings: Mapping[str, str]) -> None:
    for k, v in settings.items():
        spark._jsc.hadoopConfiguration().set(k, v)
