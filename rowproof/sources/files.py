"""Finding files: pairs of extracts, delimited files for profiling, and room to work."""

from __future__ import annotations

import glob
import shutil
import uuid
from collections import defaultdict
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Pair:
    prefix: str
    a: str
    b: str


@dataclass
class Discovery:
    """`ambiguous` holds names of one side that differ by case alone: none of them is compared."""

    pairs: list[Pair] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)
    unpaired: list[str] = field(default_factory=list)
    ambiguous: list[str] = field(default_factory=list)


def _store(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def list_folder(spark: SparkSession, folder: str) -> list[str] | None:
    """Names of the files in a folder of any store that Spark reads; None if there is no such folder."""
    fs, path = _store(spark, folder)
    if not fs.exists(path):
        return None
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isFile())


def head_of(spark: SparkSession, path: str, n: int) -> tuple[bytes, int]:
    """The first n bytes of a file in any store that Spark reads, and its length."""
    fs, at = _store(spark, path)
    size = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(n)), size
    finally:
        stream.close()


def tail_of(spark: SparkSession, path: str, n: int = 1) -> bytes:
    """The last n bytes of a file, if it has them."""
    fs, at = _store(spark, path)
    size = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:
        stream.seek(max(size - n, 0))
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def put(spark: SparkSession, local: str, target: str) -> None:
    """Copy a file of the driver to any store that Spark writes to, over what is there."""
    fs, at = _store(spark, target)
    fs.copyFromLocalFile(False, True, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(Path(local).absolute().as_uri()), at)


def replace(spark: SparkSession, made: str, target: str) -> str:
    """Move a finished folder to its place; what was there goes only when the new one is in its place. Where it cannot be moved the new one gets a dated name, which is returned."""
    fs, new = _store(spark, made)
    at, aside = (_store(spark, x)[1] for x in (target, f"{target}.old-{uuid.uuid4().hex}"))
    held = fs.exists(at)
    try:
        free = not held or fs.rename(at, aside)
    except Py4JJavaError:
        free = False
    if free and fs.rename(new, at):
        if held:
            fs.delete(aside, True)
        return target
    if free and held:
        fs.rename(aside, at)
    stem, dot, kind = target.rpartition(".")
    dated = f"{stem or kind}_{datetime.now():%Y%m%d-%H%M%S}{dot}{kind if stem else ''}"
    if not fs.rename(new, _store(spark, dated)[1]):
        raise OSError(f"{made} can be moved neither to {target} nor to {dated}")
    return dated


def sizes_of(spark: SparkSession, paths: list[str]) -> list[int]:
    return [fs.getFileStatus(at).getLen() for fs, at in (_store(spark, p) for p in paths)]


def discover(spark: SparkSession, folder: str, suffix_a: str, suffix_b: str) -> Discovery:
    """Match files of both sides on their names before the suffix, whatever the case; where both suffixes fit, the longer counts."""
    names = list_folder(spark, folder)
    if names is None:
        return Discovery(ignored=[f"Folder {folder} does not exist"])
    found, groups = Discovery(), defaultdict(lambda: {"a": [], "b": []})
    for name in (n for n in names if not n.startswith(".")):
        fits = [(len(suffix), side) for side, suffix in (("a", suffix_a), ("b", suffix_b)) if name.lower().endswith(suffix.lower())]
        if not fits:
            found.ignored.append(name)
            continue
        length, side = max(fits, key=lambda fit: fit[0])
        stem = name[: len(name) - length]
        groups[stem.lower()][side].append((stem, name))
    base = folder.rstrip("/")
    for _, sides in sorted(groups.items()):
        match len(sides["a"]), len(sides["b"]):
            case (1, 1):
                (stem, name_a), (_, name_b) = sides["a"][0], sides["b"][0]
                found.pairs.append(Pair(stem, f"{base}/{name_a}", f"{base}/{name_b}"))
            case (n, m) if n > 1 or m > 1:
                found.ambiguous += [name for _, name in sides["a"] + sides["b"]]
            case _:
                found.unpaired += [name for _, name in sides["a"] + sides["b"]]
    return found


def expand(paths: list[str], recursive: bool = False, spark: SparkSession | None = None) -> list[str]:
    """Files, the .csv files of folders, and patterns, by lower-cased path; a pattern without a match stays, to be reported. With a session, addresses of any store that Spark reads, too."""
    out: dict[str, None] = {}
    for p in paths:
        if spark is not None and "://" in p:
            found = _expand_in_store(spark, p, recursive)
        elif Path(p).is_dir():
            found = [str(x) for x in (Path(p).rglob("*") if recursive else Path(p).iterdir()) if x.is_file() and x.suffix.lower() == ".csv"]
        elif glob.has_magic(p):
            found = glob.glob(p, recursive=recursive) or [p]
        else:
            found = [p]
        out.update(dict.fromkeys(sorted(found, key=str.lower)))
    return list(out)


def _expand_in_store(spark: SparkSession, address: str, recursive: bool) -> list[str]:
    fs, at = _store(spark, address)
    out = []
    for status in fs.globStatus(at) or []:
        if status.isFile():
            out.append(status.getPath().toString())
            continue
        inside = fs.listFiles(status.getPath(), recursive)
        while inside.hasNext():
            path = inside.next().getPath()
            if path.getName().lower().endswith(".csv"):
                out.append(path.toString())
    return out or [address]


def room_for(folder: str, sizes: list[int], factor: float, spark: SparkSession | None = None) -> tuple[bool, str]:
    """Whether the nearest existing parent has `factor` times the files' size free; with a session, in any store that Spark reads."""
    need = int(factor * sum(sizes))
    if spark is None:
        at = Path(folder).absolute()
        while not at.exists():
            at = at.parent
        free = shutil.disk_usage(at).free
    else:
        fs, at = _store(spark, folder)
        while not fs.exists(at):
            at = at.getParent()
        free = fs.getStatus(at).getRemaining()
    return free >= need, f"{free:,} bytes free in {at}, {need:,} needed"
