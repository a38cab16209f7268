"""Partitioned append logs: folders by hour and partition, read from positions.

A position says which files have been read: ``{"before": hour, "files": {folder: [names]}}``. Writers append files with
names of their own to an hour, in any order, so the last name read says nothing about the others; the set
does. ``settle`` closes hours that get no more files, which keeps a position small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import Files

START: dict = {"before": "", "files": {}}


def write_log(df: DataFrame, path: str, time: str, partition: str, rows_per_file: int = 1_000_000, remainder: str | int | None = None, prefix: str = "", suffix: str = "") -> None:
    """Append rows below ``hour=yyyy-MM-dd_HH/part=...``; a partition's name must have no dash.

    ``remainder`` divides an hour's partition further: "second" by the second of the hour, a number as a sequence given by the
    writer. ``prefix`` and ``suffix`` decorate the partition's name, so that several logs can share a folder."""
    name = F.col(partition).cast("string")
    name = F.when(name.contains("-"), F.raise_error(F.lit("a log partition must have no dash"))).otherwise(F.concat(F.lit(prefix), name, F.lit(suffix)))
    out = df.withColumn("hour", F.date_format(time, "yyyy-MM-dd_HH")).withColumn("part", name)
    folders = ["hour", "part"]
    if remainder is not None:
        rest = F.minute(time) * 60 + F.second(time) if remainder == "second" else F.lit(int(remainder))
        out, folders = out.withColumn("rest", rest), [*folders, "rest"]
    out.write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy(*folders).parquet(path)


def log_files(spark: SparkSession, path: str, partition: str | None = None, since: str = "", until: str | None = None, prefix: str = "", suffix: str = "") -> dict[str, list[str]]:
    """The files of each folder, from hour ``since`` to hour ``until``, in order of their hour."""
    files, out = Files(spark, path), {}
    for hour in files.names(""):
        if not hour.startswith("hour=") or hour[5:] < since or (until is not None and hour[5:] > until):
            continue
        for part in files.names(hour):
            name = part.removeprefix("part=")
            if not part.startswith("part=") or not (name.startswith(prefix) and name.endswith(suffix)) or (partition is not None and name != f"{prefix}{partition}{suffix}"):
                continue
            inside = files.names(f"{hour}/{part}")
            for folder in [f"{hour}/{part}", *(f"{hour}/{part}/{n}" for n in inside if n.startswith("rest="))]:
                names = [n for n in (files.names(folder) if "rest=" in folder else inside) if n.startswith("part-")]
                if names:
                    out[folder] = names
    return out


def new_files(spark: SparkSession, path: str, partition: str | None = None, after: dict | None = None, until: str | None = None, limit: int | None = None, **names: str) -> tuple[list[str], dict]:
    """(files not read yet, at most ``limit``; the position behind them). A file that a position names must still be there."""
    after = after or START
    there = log_files(spark, path, partition, after["before"], until, **names)
    every = log_files(spark, path, partition, after["before"], None, **names) if until is not None else there
    if lost := sorted(f"{d}/{n}" for d, known in after["files"].items() for n in set(known) - set(every.get(d, []))):
        raise RuntimeError(f"the log no longer has {lost[:3]}, which the position names; settle hours before deleting them")
    new = [(d, n) for d, ns in there.items() for n in ns if n not in set(after["files"].get(d, []))][:limit]
    position = {"before": after["before"], "files": {d: list(ns) for d, ns in after["files"].items()}}
    for d, n in new:
        position["files"].setdefault(d, []).append(n)
    return [f"{d}/{n}" for d, n in new], position


def settle(position: dict, before: str) -> dict:
    """The position with all hours before ``before`` closed: what is appended to them later is not read."""
    return {"before": max(before, position["before"]), "files": {d: n for d, n in position["files"].items() if d.split("/")[0][5:] >= before}}


def read_files(spark: SparkSession, path: str, names: list[str], lenient: bool = True) -> DataFrame:
    """Rows of these files; ``lenient`` skips files that are torn."""
    reader = spark.read.option("ignoreCorruptFiles", str(lenient).lower()).option("basePath", path)
    out = None
    for divided in (False, True):  # hours with and without a remainder have different folders
        some = [f"{path}/{n}" for n in names if ("/rest=" in n) == divided]
        if some:
            out = reader.parquet(*some) if out is None else out.unionByName(reader.parquet(*some), allowMissingColumns=True)
    return out


def read_log(spark: SparkSession, path: str, partition: str | None = None, after: dict | None = None, until: str | None = None, limit: int | None = None, lenient: bool = True, **names: str) -> tuple[DataFrame | None, dict]:
    """Rows of files that position ``after`` does not hold, up to hour ``until``, and the position behind them."""
    new, position = new_files(spark, path, partition, after, until, limit, **names)
    return (read_files(spark, path, new, lenient) if new else None), position
