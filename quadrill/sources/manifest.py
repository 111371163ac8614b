"""Numbered JSON manifests: which files make up a version of an index."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

FORMAT_VERSION = 2


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


class Manifests:
    """Manifests of one folder, in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.folder = spark.sparkContext._jvm, f"{path}/_manifests"
        where = self._path(self.folder)
        self.fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def versions(self) -> list[int]:
        if not self.fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.folder))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def read(self, version: int | None = None) -> dict:
        """A version's manifest, the newest by default; older formats are brought up to date."""
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no index in {self.folder}")
        stream = self.fs.open(self._path(f"{self.folder}/{version or found[-1]:08d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return upgraded(json.loads(text))

    def commit(self, manifest: dict) -> dict:
        """Write the next version whole or not at all; fails if someone else was first."""
        version = manifest.get("version", 0) + 1
        manifest = manifest | {"version": version, "format_version": FORMAT_VERSION}
        name = self._path(f"{self.folder}/{version:08d}.json")
        part = self._path(f"{self.folder}/.{version:08d}.{self.jvm.java.util.UUID.randomUUID().toString()}")
        out = self.fs.create(part, False)
        try:
            out.write(bytearray(json.dumps(manifest, indent=1).encode()))
        finally:
            out.close()
        if self.fs.exists(name) or not self.fs.rename(part, name):
            self.fs.delete(part, False)
            raise Conflict(f"version {version} exists already")
        return manifest


def upgraded(manifest: dict) -> dict:
    version = manifest.get("format_version", 1)
    if version > FORMAT_VERSION:
        raise ValueError(f"the index has format {version}; this library reads up to {FORMAT_VERSION}")
    if version == 1:  # had neither labels nor a layout
        manifest = manifest | {"labels": manifest.get("labels"), "format_version": 2}
        manifest["options"] = {"storage_layout": "plain"} | manifest.get("options", {})
    return manifest
