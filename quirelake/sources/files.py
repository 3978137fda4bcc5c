"""Markdown folders as a corpus, and NDJSON out.

The listing prunes hidden and ignored folders before it enters them; only the chosen files are read, by executors.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("md", "markdown")
IGNORE_FILES = (".gitignore", ".ignore")


class Ignore:
    """Patterns of one ignore file, for paths relative to its folder; the last match decides."""

    def __init__(self, text: str) -> None:
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            folder = line.endswith("/")
            line = line.rstrip("/").removeprefix("\\")
            anchored = "/" in line
            line = line.removeprefix("/")
            self.rules.append((re.compile(("" if anchored else "(?:.*/)?") + _glob(line) + r"\Z"), keep, folder))

    def match(self, path: str, is_folder: bool) -> bool | None:
        """True: ignored; False: kept by a ``!`` pattern; None: no pattern says."""
        found = None
        for pattern, keep, folder in self.rules:
            if (is_folder or not folder) and pattern.match(path):
                found = not keep
        return found


def _glob(pattern: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out.append("/.*")
            i += 3
        elif c == "*":
            out.append("[^/]*")
            i += 1
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            i = end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    return "".join(out)


def listing(root: str, ignore_files: bool = True, hidden: bool = False, custom_ignore: str | None = None) -> list[str]:
    """Relative paths of the Markdown files below ``root``, by bytes. A missing root is an error. Ignore files of the folders above count too."""
    if not os.path.isdir(root):
        raise NotADirectoryError(f"not a folder: {root}")
    names = (*IGNORE_FILES, *([custom_ignore] if custom_ignore else ())) if ignore_files else ()
    root = os.path.abspath(root)
    above, folder = [], os.path.dirname(root)
    while True:
        above.append(folder)
        if folder == os.path.dirname(folder):
            break
        folder = os.path.dirname(folder)
    base = [(f, i) for f in reversed(above) for i in _ignores(f, names)]

    def enter(folder: str, active: list[tuple[str, Ignore]]) -> Iterator[str]:
        active = active + [(folder, i) for i in _ignores(folder, names)]
        for e in sorted(os.scandir(folder), key=lambda e: os.fsencode(e.name)):
            if e.name.startswith(".") and not hidden:
                continue
            is_folder = e.is_dir(follow_symlinks=False)
            verdict = None
            for f, i in active:
                said = i.match(os.path.relpath(e.path, f).replace(os.sep, "/"), is_folder)
                verdict = verdict if said is None else said
            if verdict:
                continue
            if is_folder:
                yield from enter(e.path, active)
            elif e.is_file(follow_symlinks=False) and os.path.splitext(e.name)[1][1:].lower() in EXTENSIONS:
                yield os.path.relpath(e.path, root).replace(os.sep, "/")

    return sorted(enter(root, base), key=os.fsencode)


def _ignores(folder: str, names: tuple[str, ...]) -> list[Ignore]:
    out = []
    for n in names:
        try:
            with open(os.path.join(folder, n), encoding="utf-8", errors="replace") as f:
                out.append(Ignore(f.read()))
        except OSError:
            pass
    return out


def read_folder(spark: SparkSession, root: str, **walk: object) -> DataFrame:
    """doc_id (place in path order), path, name, content: files that are valid UTF-8."""
    paths = listing(root, **walk)
    schema = "doc_id long, path string, name string, content string"
    if not paths:
        return spark.createDataFrame([], schema)
    root = os.path.abspath(root)
    order = spark.createDataFrame([(i, p, os.path.splitext(os.path.basename(p))[0]) for i, p in enumerate(paths)], "doc_id long, path string, name string")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Spark's own reader hides names that begin with "_"
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                raw = []
                for p in part.column(1).to_pylist():
                    with open(os.path.join(root, p), "rb") as f:
                        raw.append(f.read())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=["doc_id", "path", "name", "raw"])

    spread = max(1, min(len(paths), spark.sparkContext.defaultParallelism * 4))
    found = order.repartition(spread).mapInArrow(go, "doc_id long, path string, name string, raw binary")
    return found.where(F.is_valid_utf8(F.col("raw").cast("string"))).select("doc_id", "path", "name", F.col("raw").cast("string").alias("content"))


def to_ndjson(parsed: DataFrame) -> DataFrame:
    """value: a parsed document as one line of JSON; nulls are left out."""
    return parsed.select(F.to_json(F.struct(*parsed.columns)).alias("value"))
