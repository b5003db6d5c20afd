"""Directory scan as a Spark data source.

``spark.read.format("codewalk").option("root", dir).load()`` gives one row a text file, whatever its name begins with and also if
it is empty. The driver walks directories only (ignore files have to be read from the top); files are opened by the tasks, in
groups of bounded size. ``listing`` gives the same files without opening them, ``read_listed`` opens those of a table. Reading the
source as a stream gives what is new or of another size or mtime since the last trigger: each offset names a list of files kept
beside the stream's checkpoint, and its files are opened by the tasks.

Ignore rules: those of the user's and the repository's exclude files, then ``.gitignore`` and ``.indexignore`` of the root, then
given patterns; nested folders add their own two files. The last rule that matches decides, ``!`` takes back, and nothing below
an ignored folder is seen. An unreadable folder or file fails the scan.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quarrylight.session import map_batches, ship

# Folders never entered.
SKIPPED = frozenset({"node_modules", "vendor", "__pycache__", ".git", "dist", "build", ".next", "target", "bin", "obj", ".tox", ".venv", "venv", ".codeindex"})
SNIFF = 512
SCHEMA = "root string, abs_path string, rel_path string, ext string, size bigint, mtime_ns bigint, hash string, content string"
LISTED = "root string, abs_path string, rel_path string, size bigint, mtime_ns bigint"
# How texts in markup begin, of the public rules for telling kinds of content by its first bytes.
TAGS = (b"<!doctype html", b"<html", b"<head", b"<script", b"<iframe", b"<h1", b"<div", b"<font", b"<table", b"<a", b"<style", b"<title", b"<b", b"<body", b"<br", b"<p", b"<!--", b"<?xml")


@dataclass(frozen=True)
class Rule:
    """One line of an ignore file, relative to the folder it stands in."""

    base: str
    pattern: re.Pattern
    negate: bool
    folders_only: bool


def _regex(pattern: str) -> re.Pattern:
    """Pattern of an ignore line: ``*`` and ``?`` within a name, ``**`` over folders, a slash inside ties it to its folder."""
    p = pattern.rstrip("/")
    tied = "/" in p
    p = p.removeprefix("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.*", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and (end := p.find("]", i + 2)) > 0:
            body = p[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]", end + 1
        elif p[i] == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        else:
            out, i = out + re.escape(p[i]), i + 1
    return re.compile(("" if tied else "(?:.*/)?") + out + "(?:/.*)?")


def rules_of(lines: list[str], base: str) -> list[Rule]:
    out = []
    for line in lines:
        p = line.strip()
        if not p or p.startswith("#"):
            continue
        negate = p.startswith("!")
        p = p[1:] if negate else p
        out.append(Rule(base, _regex(p), negate, p.endswith("/")))
    return out


def ignored(path: str, rules: list[Rule], folder: bool) -> bool:
    out = False
    for r in rules:
        rel = os.path.relpath(path, r.base)
        m = r.pattern.fullmatch(rel)
        if m and r.folders_only and not folder:
            # a folder's rule holds for what is below that folder, not for a file of its name
            m = any(r.pattern.fullmatch("/".join(rel.split("/")[:k])) for k in range(1, rel.count("/") + 1))
        if m:
            out = not r.negate
    return out


def _lines(path: str) -> list[str]:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read().splitlines()
    except FileNotFoundError:
        return []


def _global_excludes() -> str:
    config = os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config"), "git")
    for line in [*_lines(os.path.expanduser("~/.gitconfig")), *_lines(os.path.join(config, "config"))]:
        if m := re.match(r"\s*excludesfile\s*=\s*(.+?)\s*$", line, re.I):
            return os.path.expanduser(m[1].strip('"'))
    return os.path.join(config, "ignore")


def is_text(sample: bytes) -> bool:
    """Is the start of a file that of a text? An empty one is."""
    if not sample:
        return True
    if 0 in sample:
        return False
    if sample.startswith((b"\xef\xbb\xbf", b"\xfe\xff", b"\xff\xfe")) or sample.lstrip(b"\t\n\x0c\r ").lower().startswith(TAGS):
        return True
    if any(b < 0x20 and b not in (9, 10, 12, 13) for b in sample):
        return False
    # the sample may end inside a character
    for cut in range(4):
        try:
            sample[: len(sample) - cut].decode("utf-8")
            return True
        except UnicodeDecodeError as e:
            if len(sample) < SNIFF or e.start < len(sample) - 4:
                return False
    return False


def walk(root: str, extra: list[str] = ()) -> Iterator[tuple[str, str, int, int]]:
    """``(path, relative path, size, mtime)`` of the regular files that are not ignored, in order of their relative paths."""
    if not os.path.isabs(root):
        raise ValueError("the root has to be an absolute path")
    root = os.path.normpath(root)
    rules = [r for f in (_global_excludes(), f"{root}/.git/info/exclude", f"{root}/.gitignore", f"{root}/.indexignore") for r in rules_of(_lines(f), root)]
    rules += rules_of(list(extra), root)
    found, todo = [], [(root, rules)]
    while todo:
        folder, known = todo.pop()
        if folder != root:
            known = known + [r for f in (".gitignore", ".indexignore") for r in rules_of(_lines(f"{folder}/{f}"), folder)]
        with os.scandir(folder) as entries:
            for e in entries:
                mode = e.stat(follow_symlinks=False).st_mode
                if stat.S_ISDIR(mode):
                    if e.name not in SKIPPED and not ignored(e.path, known, True):
                        todo.append((e.path, known))
                elif stat.S_ISREG(mode) and not ignored(e.path, known, False):
                    s = e.stat(follow_symlinks=False)
                    found.append((e.path, os.path.relpath(e.path, root), s.st_size, s.st_mtime_ns))
    yield from sorted(found, key=lambda x: x[1].encode())


def read_file(root: str, path: str, rel: str, size: int, mtime: int) -> tuple | None:
    """The row of a file; None if it is no text."""
    with open(path, "rb") as f:
        head = f.read(SNIFF)
        if not is_text(head):
            return None
        raw = head + f.read()
    name = os.path.basename(rel)
    return root, path, rel, os.path.splitext(name)[1].lower() or ("." + name.lower().rpartition(".")[2] if name.startswith(".") and name.count(".") == 1 else ""), size, mtime, hashlib.sha256(raw).hexdigest(), raw.decode("utf-8", "replace")


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, int, int]]):
        self.files = files


def groups(files: Iterator[tuple[str, str, int, int]], size: int, count: int = 2_000) -> list[_Files]:
    """Files in parts of about ``size`` bytes and at most ``count`` files."""
    out, part, held = [], [], 0
    for f in files:
        if part and (held + f[2] > size or len(part) >= count):
            out.append(_Files(part))
            part, held = [], 0
        part.append(f)
        held += f[2]
    return [*out, _Files(part)] if part else out


def _patterns(options: dict[str, str]) -> list[str]:
    return [p for p in json.loads(options.get("ignore") or "[]") if p.strip()]


class WalkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.normpath(options["root"])
        self.extra = _patterns(options)
        self.size = int(options.get("partitionbytes", 32 << 20))
        self.only = json.loads(options["only"]) if options.get("only") else None
        self.opened = options.get("opened", "true") == "true"

    def partitions(self):
        if self.only is None:
            return groups(walk(self.root, self.extra), self.size if self.opened else 1 << 62) or [_Files([])]
        there = []
        for rel in self.only:
            try:
                s = os.stat(os.path.join(self.root, rel), follow_symlinks=False)
            except FileNotFoundError:
                continue
            if stat.S_ISREG(s.st_mode):
                there.append((os.path.join(self.root, rel), rel, s.st_size, s.st_mtime_ns))
        return groups(iter(there), self.size) or [_Files([])]

    def read(self, partition):
        for f in partition.files:
            if not self.opened:
                yield self.root, *f
            elif row := read_file(self.root, *f):
                yield row


class WalkStream(DataSourceStreamReader):
    """Files that are new, or whose size or mtime is not what it was at the trigger before.

    The lists that offsets name are written to ``state``, a folder the tasks need not see: the driver alone reads it.
    """

    def __init__(self, options: dict[str, str]):
        self.reader = WalkReader(options)
        self.state = options.get("state") or ""
        if not self.state:
            raise ValueError("the stream needs the option state, a folder for what it has seen")

    def initialOffset(self):
        return {"seen": ""}

    def _seen(self, name: str) -> dict[str, list[int]]:
        if not name:
            return {}
        with open(os.path.join(self.state, name), encoding="utf-8") as f:
            return json.load(f)

    def latestOffset(self):
        now = {rel: [size, mtime] for _, rel, size, mtime in walk(self.reader.root, self.reader.extra)}
        text = json.dumps(now, sort_keys=True)
        name = hashlib.sha256(text.encode()).hexdigest()
        os.makedirs(self.state, exist_ok=True)
        if not os.path.exists(target := os.path.join(self.state, name)):
            with open(f"{target}.{os.getpid()}", "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(f.name, target)
        return {"seen": name}

    def partitions(self, start, end):
        old, new = self._seen(start["seen"]), self._seen(end["seen"])
        changed = [(os.path.join(self.reader.root, rel), rel, *at) for rel, at in sorted(new.items()) if old.get(rel) != at]
        return groups(iter(changed), self.reader.size) or [_Files([])]

    def read(self, partition):
        return self.reader.read(partition)

    def commit(self, end):
        for name in os.listdir(self.state):
            # the list of this offset stays; older ones are of no use, newer ones cannot be there yet
            if name != end["seen"] and os.path.getmtime(os.path.join(self.state, name)) < os.path.getmtime(os.path.join(self.state, end["seen"])):
                os.unlink(os.path.join(self.state, name))


class WalkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "codewalk"

    def schema(self) -> str:
        return SCHEMA if self.options.get("opened", "true") == "true" else LISTED

    def reader(self, schema):
        return WalkReader(dict(self.options))

    def streamReader(self, schema):
        return WalkStream(dict(self.options))


def _source(spark: SparkSession, root: str, ignore: list[str]):
    ship(spark)
    spark.dataSource.register(WalkSource)
    return spark.read.format("codewalk").option("root", root).option("ignore", json.dumps(list(ignore)))


def scan(spark: SparkSession, root: str, ignore: list[str] = (), only: list[str] | None = None) -> DataFrame:
    """Text files below ``root``; with ``only`` those of these relative paths, and nothing else is looked at."""
    source = _source(spark, root, ignore)
    return (source if only is None else source.option("only", json.dumps(list(only)))).load()


def listing(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """The files below ``root`` with size and mtime; none of them is opened, so binary ones are among them."""
    return _source(spark, root, ignore).option("opened", "false").load()


def read_listed(files: DataFrame) -> DataFrame:
    """The text files among rows of ``listing``, opened by the tasks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 50):
                got = [read_file(*r) for r in b.iloc[at : at + 50].itertuples(index=False, name=None)]
                yield pd.DataFrame([r for r in got if r], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return map_batches(files.select("root", "abs_path", "rel_path", "size", "mtime_ns"), read, SCHEMA)
