"""A store of series in which single logs are replaced without touching the others.

    <store>/data/commit=<id>/log_bucket=<n>/part-*.parquet     samples, one folder per commit
    <store>/manifest/v=<number>/part-*.parquet                 log_id, fingerprint, commit, samples
    <store>/empty/                                             the samples' schema

A commit writes the samples of its logs aside, then a manifest that names, for every log, its fingerprint
and the commit that holds it. The manifest is written under a name no reader looks at and renamed last, and
renaming fails if another writer took the number: readers see the old state or the new one whole. A
writer that is killed, and a task that is lost, leave files that nothing names; ``vacuum`` removes them.

Readers take the newest manifest and only the commits it names; (commit, log) pairs are joined, not
collected. Commits whose logs were all replaced are read no more. ``compact`` writes the live logs into one commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.folder_index import FINGERPRINT, plan
from ..session import settle
from .store import SLICE_ROWS

MARK = [c for c in FINGERPRINT if c != "path"]
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer published first; read the manifest again and redo the refresh."""


def folder_names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What follows the prefix in the names below a folder; there is one per commit or version, never one per log."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return []
    found = (s.getPath().getName() for s in fs.listStatus(jpath))
    return sorted(n.removeprefix(prefix) for n in found if n.startswith(prefix))


def publish(spark: SparkSession, aside: str, there: str) -> None:
    """Give a folder its final name at once; fails if another has taken it."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    here, target = jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(there)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(here, target, options)
    except Exception as e:
        if not fs.exists(target):
            raise
        fs.delete(here, True)
        raise Conflict(f"{there} was published by another writer") from e


class Store:
    """One store folder; ``path`` must be shared by all executors."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _names(self, folder: str, prefix: str) -> list[str]:
        return folder_names(self.spark, f"{self.path}/{folder}", prefix)

    def version(self) -> int:
        """The newest published version, 0 for a new store."""
        return max(map(int, self._names("manifest", "v=")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """``log_id, size, mtime, parser_version, format_version, commit, samples`` of every log."""
        version = self.version() if version is None else version
        if not version:
            schema = "log_id string, size long, mtime long, parser_version string, format_version string, commit string, samples long"
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.path}/manifest/v={version:09d}")

    def index(self) -> DataFrame:
        """The manifest as the index that ``folder_index.plan`` takes."""
        return self.manifest().withColumnRenamed("log_id", "path")

    def plan(self, listing: DataFrame, parser_version: str, format_version: str) -> DataFrame:
        """What a refresh has to do for ``listing(path, size, mtime)``: reuse, compute or discard each log."""
        return plan(listing, self.index(), parser_version, format_version)

    def _write_aside(self, samples: DataFrame) -> str:
        """Samples into a commit folder that no manifest names yet."""
        commit = uuid.uuid4().hex
        dealt = samples.withColumns(
            {"log_bucket": F.pmod(F.xxhash64("log_id"), F.lit(self.buckets)).cast("int"), "_salt": F.floor(F.col("seq") / SLICE_ROWS)}
        )
        (
            dealt.repartition("log_bucket", "log_id", "_salt").sortWithinPartitions("log_bucket", "log_id", "channel_id", "t_ms", "seq").drop("_salt")
            .write.partitionBy("log_bucket").parquet(f"{self.path}/data/commit={commit}")
        )
        samples.limit(0).write.mode("ignore").parquet(f"{self.path}/empty")
        return commit

    def _commit(self, commit: str) -> DataFrame:
        """What a commit folder holds; nothing if all its logs are without samples."""
        there = bool(self._names(f"data/commit={commit}", "log_bucket="))
        empty = self.spark.read.parquet(f"{self.path}/empty")
        return self.spark.read.parquet(f"{self.path}/data/commit={commit}").drop("log_bucket") if there else empty

    def refresh(self, samples: DataFrame, fingerprints: DataFrame, removed: DataFrame | None = None) -> int:
        """Replace or add the logs of ``fingerprints(log_id, size, mtime, parser_version, format_version)``.

        ``samples`` are those of these logs; a log without samples is kept as such. Logs of
        ``removed(log_id)`` leave. Everything else stays as it is, files included. Returns the version.
        """
        base = self.version()
        fresh = settle(fingerprints.select("log_id", *MARK).dropDuplicates(["log_id"]))
        commit = self._write_aside(samples.join(fresh.select("log_id"), "log_id", "left_semi"))
        counts = self._commit(commit).groupBy("log_id").agg(F.count(F.lit(1)).alias("samples"))
        rows = fresh.join(counts, "log_id", "left").select("log_id", *MARK, F.lit(commit).alias("commit"), F.coalesce("samples", F.lit(0)).alias("samples"))
        old = self.manifest(base)
        gone = fresh.select("log_id") if removed is None else fresh.select("log_id").unionByName(removed.select("log_id"))
        kept = old.join(gone, "log_id", "left_anti")
        return self._publish(kept.unionByName(rows), base)

    def _publish(self, manifest: DataFrame, base: int) -> int:
        version = base + 1
        aside = f"{self.path}/manifest/.{uuid.uuid4().hex}"
        manifest.select("log_id", *MARK, "commit", "samples").write.parquet(aside)
        publish(self.spark, aside, f"{self.path}/manifest/v={version:09d}")
        return version

    def read(self, logs: Sequence | DataFrame | None = None, version: int | None = None) -> DataFrame:
        """Samples of all live logs, or of the given ones, from the files the manifest names."""
        live = self.manifest(version).select("log_id", "commit", "samples").where("samples > 0").drop("samples")
        if logs is not None:
            wanted = logs.select("log_id") if isinstance(logs, DataFrame) else self.spark.createDataFrame([(x,) for x in logs], "log_id string")
            live = live.join(wanted.select(F.col("log_id").cast(live.schema["log_id"].dataType)), "log_id", "left_semi")
        commits = [r[0] for r in live.select("commit").distinct().collect()]  # one per commit, see compact
        if not commits:
            return self.spark.read.parquet(f"{self.path}/empty")
        live = live.withColumn("log_bucket", F.pmod(F.xxhash64("log_id"), F.lit(self.buckets)).cast("int"))
        data = self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/commit={c}" for c in commits])
        return data.join(live, ["commit", "log_bucket", "log_id"], "left_semi").drop("commit", "log_bucket")

    def compact(self) -> int:
        """All live logs in one commit, so that readers list one folder; contents and fingerprints stay."""
        base = self.version()
        old = self.manifest(base)
        commit = self._write_aside(self.read(version=base))
        return self._publish(old.withColumn("commit", F.lit(commit)), base)

    def vacuum(self, versions: int = 1) -> list[str]:
        """Delete manifests but the newest ``versions``, and commits that none of those names.

        No writer may be at work: its unpublished commit would count as left behind.
        """
        kept = self._names("manifest", "v=")[-versions:]
        named = {r[0] for v in kept for r in self.manifest(int(v)).select("commit").distinct().collect()}
        gone = [f"data/commit={c}" for c in self._names("data", "commit=") if c not in named]
        gone += [f"manifest/v={v}" for v in self._names("manifest", "v=") if v not in kept]
        gone += [f"manifest/.{n}" for n in self._names("manifest", ".")]
        for name in gone:
            jpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)
        return gone
