"""Writing reports and immutable run snapshots.

A store of snapshots is a folder with a manifest and one folder per artifact and attempt. The
manifest is a series of numbered files; the highest one is the store's state: the attempts
whose runs are in it, and the expiries that took runs out again. A change writes all its data
first and then the next number, which no one can write twice. A reader takes the highest
number once and sees that state whole, whatever others write meanwhile.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "runs"
MANIFEST = "manifest"
TOMBSTONES = "tombstones"
_NAME_SIZE = 20
#: Versions of the manifest that stay for readers who hold an older one.
KEPT_VERSIONS = 16


class RunExists(ValueError):
    """A run is immutable; its id was written before."""


def write_report(
    artifacts: Mapping[str, DataFrame], root: str, fmt: str = "json", attempt: str = ""
) -> str:
    """Append each artifact below ``root`` in a folder of this attempt; the attempt's name.

    ``run_id`` stays a column and a run's rows share a file, so the number of folders and
    files follows the size of the data, not the number of runs. A reader keeps to the
    attempts that it was told of: rows of a failed one are never seen.
    """
    # A letter first: a name of digits would be read back as a number.
    attempt = attempt or f"a{uuid.uuid4().hex}"
    for name, rows in artifacts.items():
        rows.repartition("run_id").write.format(fmt).save(_attempt(root, name, attempt))
    return attempt


def _attempt(root: str, name: str, attempt: str) -> str:
    return f"{root}/{name}/attempt={attempt}"


# -- the manifest -------------------------------------------------------------


@dataclass(frozen=True)
class Expiry:
    """Runs taken out: the folder of their tombstones and the attempts they were written by."""

    name: str
    attempts: tuple[str, ...]


@dataclass(frozen=True)
class Manifest:
    """One state of a store. It grows with the attempts that still have runs, not with time."""

    version: int = 0
    attempts: tuple[str, ...] = ()
    expiries: tuple[Expiry, ...] = ()
    #: Attempts without runs, whose folders may still be there.
    dropped: tuple[str, ...] = ()

    def text(self) -> str:
        return json.dumps(
            {
                "attempts": self.attempts,
                "expiries": {e.name: e.attempts for e in self.expiries},
                "dropped": self.dropped,
            }
        )

    @classmethod
    def parsed(cls, version: int, text: str) -> Manifest:
        known = json.loads(text)
        expiries = tuple(Expiry(n, tuple(a)) for n, a in known["expiries"].items())
        return cls(version, tuple(known["attempts"]), expiries, tuple(known["dropped"]))


class _Files:
    """The few calls on the store's file system that Spark's readers and writers lack."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.system = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        if not self.system.exists(path):
            return []
        return [status.getPath().getName() for status in self.system.listStatus(path)]

    def remove(self, name: str) -> None:
        self.system.delete(self.path(name), True)

    def create_once(self, name: str, text: str) -> bool:
        """Give a file its content as a whole; False if it is there already.

        The rename refuses to overwrite, in one step on HDFS.
        """
        folder, _, last = name.rpartition("/")
        beside = self.system.makeQualified(self.path(f"{folder}/.{last}-{uuid.uuid4().hex}"))
        out = self.system.create(beside, False)
        try:
            out.write(text.encode())
        finally:
            out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self.system.getUri(), self.conf
        )
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 0)
        try:
            context.rename(beside, self.system.makeQualified(self.path(name)), none)
        except Py4JJavaError as problem:
            self.system.delete(beside, False)
            if "FileAlreadyExists" in problem.java_exception.getClass().getName():
                return False
            raise
        return True


def _version_file(root: str, version: int) -> str:
    return f"{root}/{MANIFEST}/{version:0{_NAME_SIZE}d}.json"


def _versions(files: _Files, root: str) -> list[int]:
    names = [name.removesuffix(".json") for name in files.names(f"{root}/{MANIFEST}")]
    return sorted(int(name) for name in names if len(name) == _NAME_SIZE and name.isdigit())


def read_manifest(spark: SparkSession, root: str) -> Manifest:
    """The store's state; an empty one where there is no store yet."""
    versions = _versions(_Files(spark, root), root)
    if not versions:
        return Manifest()
    path = _version_file(root, versions[-1])
    text = spark.read.text(path, wholetext=True).head()[0]
    return Manifest.parsed(versions[-1], text)


def commit(
    spark: SparkSession,
    root: str,
    seen: Manifest,
    change: Callable[[Manifest], Manifest],
    check: Callable[[Manifest, Manifest], None] = lambda before, now: None,
) -> Manifest:
    """Publish ``change`` as the version after ``seen``.

    If another writer was first, the newer state is read, ``check`` (which gets the state
    seen before and the newer one) may refuse the change, and the next number is tried.
    """
    files = _Files(spark, root)
    while True:
        changed = replace(change(seen), version=seen.version + 1)
        if files.create_once(_version_file(root, changed.version), changed.text()):
            return changed
        newer = read_manifest(spark, root)
        check(seen, newer)
        seen = newer


# -- snapshots ----------------------------------------------------------------


def _rows(spark: SparkSession, root: str, name: str, attempts: Sequence[str]) -> DataFrame:
    paths = [_attempt(root, name, attempt) for attempt in attempts]
    return spark.read.option("basePath", f"{root}/{name}").parquet(*paths)


def _living(rows: DataFrame, root: str, manifest: Manifest) -> DataFrame:
    """Rows but those of runs that an expiry took out."""
    if not manifest.expiries:
        return rows
    paths = [f"{root}/{TOMBSTONES}/{expiry.name}" for expiry in manifest.expiries]
    gone = rows.sparkSession.read.parquet(*paths)
    return rows.join(gone, ["run_id", "attempt"], "left_anti")


def read_runs(
    spark: SparkSession, root: str, manifest: Manifest | None = None
) -> DataFrame | None:
    """The runs of the store with their attempt, or None where it has none."""
    state = manifest or read_manifest(spark, root)
    if not state.attempts:
        return None
    return _living(_rows(spark, root, RUNS, state.attempts), root, state)


def _refuse_known(runs: DataFrame, known: DataFrame | None) -> None:
    if known is not None:
        clash = runs.select("run_id").join(known.select("run_id"), "run_id", "left_semi").head()
        if clash:
            raise RunExists(clash["run_id"])


def append_snapshot(runs: DataFrame, artifacts: Mapping[str, DataFrame], root: str) -> Manifest:
    """Store new runs: artifacts and the runs' own rows first, the manifest's next version last.

    A run id is final while it is in the store, and a batch names a run once. Of two writers
    that both find a run absent, the later one meets the other's version, checks against what
    came in between and fails with :class:`RunExists`; its folders are then removed. A run
    that failed half way is not seen and may be written again. A complete run must not carry
    partial reasons.
    """
    spark = runs.sparkSession
    seen = read_manifest(spark, root)
    contradictory = (F.col("state") == "complete") & (F.size("partial_reasons") > 0)
    fault = (
        runs.groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("times"), F.max(contradictory).alias("contradictory"))
        .where("times > 1 or contradictory")
        .head()
    )
    if fault and fault["contradictory"]:
        raise ValueError("a complete run carries partial reasons")
    if fault:
        raise RunExists(fault["run_id"])
    _refuse_known(runs, read_runs(spark, root, seen))
    attempt = write_report(artifacts, root, fmt="parquet")
    runs.write.parquet(_attempt(root, RUNS, attempt))
    written = spark.read.parquet(_attempt(root, RUNS, attempt))

    def check(before: Manifest, now: Manifest) -> None:
        # An attempt that is dropped in between has no runs left that could clash.
        added = tuple(a for a in now.attempts if a not in set(before.attempts))
        _refuse_known(written, read_runs(spark, root, replace(now, attempts=added)))

    try:
        return commit(
            spark, root, seen, lambda state: replace(state, attempts=(*state.attempts, attempt)), check
        )
    except RunExists:
        remove_attempts(spark, root, [*artifacts, RUNS], [attempt])
        raise


def read_artifact(
    spark: SparkSession, root: str, name: str, manifest: Manifest | None = None
) -> DataFrame:
    """Rows of an artifact for the runs in the store, from the attempts that wrote them."""
    state = manifest or read_manifest(spark, root)
    written = set(_Files(spark, root).names(f"{root}/{name}"))
    holding = [a for a in state.attempts if f"attempt={a}" in written]
    rows = _rows(spark, root, name, holding)
    known = read_runs(spark, root, state).select("run_id", "attempt")
    return rows.join(known, ["run_id", "attempt"], "left_semi").drop("attempt")


def remove_attempts(
    spark: SparkSession, root: str, names: Sequence[str], attempts: Sequence[str]
) -> None:
    files = _Files(spark, root)
    for attempt in attempts:
        for name in names:
            files.remove(_attempt(root, name, attempt))


def remove_runs(spark: SparkSession, root: str, expired: DataFrame, names: Sequence[str]) -> Manifest:
    """Take expired runs out of the store: a tombstone each, and one new version.

    No data is written anew. Folders of attempts that have no run left are removed after the
    version that leaves them out, so a crash at any point loses nothing and leaves at most
    folders that the next removal clears. ``names`` are the store's artifacts. An id that was
    taken out may be written again: a tombstone is about a run of one attempt.
    """
    seen = read_manifest(spark, root)
    runs = read_runs(spark, root, seen)
    if runs is not None:
        name = f"expiry={uuid.uuid4().hex}"
        gone = runs.select("run_id", "attempt").join(
            expired.select("run_id").distinct(), "run_id", "left_semi"
        )
        gone.write.parquet(f"{root}/{TOMBSTONES}/{name}")
        buried = spark.read.schema(gone.schema).parquet(f"{root}/{TOMBSTONES}/{name}")
        left = runs.select("run_id", "attempt").join(buried, ["run_id", "attempt"], "left_anti")
        # Distinct attempts only: one short name per batch that was ever appended.
        touched = {row.attempt for row in buried.select("attempt").distinct().collect()}
        living = {row.attempt for row in left.select("attempt").distinct().collect()}
        emptied = set(seen.attempts) - living

        def change(state: Manifest) -> Manifest:
            expiries = []
            for expiry in (*state.expiries, Expiry(name, tuple(sorted(touched)))):
                still = tuple(a for a in expiry.attempts if a not in emptied)
                if still:
                    expiries.append(Expiry(expiry.name, still))
            return replace(
                state,
                attempts=tuple(a for a in state.attempts if a not in emptied),
                expiries=tuple(expiries),
                dropped=tuple(sorted({*state.dropped, *emptied})),
            )

        if touched or emptied:
            seen = commit(spark, root, seen, change)
    return cleared(spark, root, seen, [*names, RUNS])


def cleared(spark: SparkSession, root: str, seen: Manifest, names: Sequence[str]) -> Manifest:
    """Remove what the state no longer refers to: emptied attempts, tombstones, old versions."""
    files = _Files(spark, root)
    if seen.dropped:
        gone = set(seen.dropped)
        remove_attempts(spark, root, names, seen.dropped)
        seen = commit(
            spark, root, seen,
            lambda state: replace(
                state, dropped=tuple(a for a in state.dropped if a not in gone)
            ),
        )
    for version in _versions(files, root)[:-KEPT_VERSIONS]:
        files.remove(_version_file(root, version))
    return seen
