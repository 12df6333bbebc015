"""A data source of the paths below some folders, with ignore files honoured. One partition a root."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

OPTIONS = ("file", "dir", "follow", "hidden")
SKIP = (".git", "node_modules")


def parse_options(text: str) -> frozenset[str]:
    found = frozenset(x.strip() for x in text.split(",") if x.strip())
    if unknown := found - set(OPTIONS):
        raise ValueError(f"unknown walker options {sorted(unknown)}")
    return found


def _pattern(rule: str) -> re.Pattern:
    """The paths, relative to the rule's folder, that a rule names. A rule with a slash before its end starts there."""
    out = "" if "/" in rule.rstrip("/") else "(?:.*/)?"
    rule, k = rule.strip("/"), 0
    while k < len(rule):
        if rule.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif rule.startswith("/**", k) and k + 3 == len(rule):
            out, k = out + "/.+", k + 3
        elif rule[k] == "*":
            while k < len(rule) and rule[k] == "*":
                k += 1
            out += "[^/]*"
        elif rule[k] == "?":
            out, k = out + "[^/]", k + 1
        elif rule[k] == "[" and (end := rule.find("]", k + 2)) > 0:
            body = rule[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "(?!/)[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        else:
            k += rule[k] == "\\" and k + 1 < len(rule)
            out, k = out + re.escape(rule[k]), k + 1
    return re.compile(out, re.S)


class _Ignore:
    """Rules of ignore files for one folder: the last that fits a path below it decides."""

    def __init__(self, folder: str, files: Iterable[str]):
        self.folder, self.rules = folder, []
        for path in files:
            try:
                with open(path, encoding="utf-8", errors="replace") as f:
                    lines = f.read().splitlines()
            except OSError:
                continue
            for line in lines:
                while line.endswith(" ") and not line.endswith("\\ "):
                    line = line[:-1]
                if not line or line.startswith("#"):
                    continue
                keep = line.startswith("!")
                rule = line[1:] if keep else line
                try:
                    self.rules.append((_pattern(rule), keep, rule.endswith("/")))
                except re.error:  # a rule that cannot be read fits nothing
                    continue

    @classmethod
    def of(cls, folder: str) -> _Ignore:
        return cls(folder, [os.path.join(folder, name) for name in (".gitignore", ".ignore")])

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored. False: kept by a rule. None: no rule fits."""
        inside = os.path.relpath(path, self.folder).replace(os.sep, "/")
        if inside.startswith("../"):
            return None
        out = None
        for rule, keep, only_dir in self.rules:
            if (is_dir or not only_dir) and rule.fullmatch(inside):
                out = not keep
        return out


def _global_file() -> str:
    """The user's own ignore file: core.excludesFile, else git/ignore in the user's configuration folder."""
    home = os.path.expanduser("~")
    config = os.environ.get("XDG_CONFIG_HOME") or os.path.join(home, ".config")
    for path in (os.path.join(home, ".gitconfig"), os.path.join(config, "git", "config")):
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                section = ""
                for line in map(str.strip, f):
                    if line.startswith("["):
                        section = line.strip("[]").lower()
                    elif section == "core" and line.partition("=")[0].strip().lower() == "excludesfile":
                        return os.path.expanduser(line.partition("=")[2].strip().strip('"'))
        except OSError:
            continue
    return os.path.join(config, "git", "ignore")


def walk(root: str, options: frozenset[str] = frozenset({"file", "follow", "hidden"}), skip: tuple[str, ...] = SKIP):
    """Paths below root, not root itself; shown relative where root is a dot. Loops and what cannot be read are passed over."""
    # nearest first; a repository's own excludes and the user's come after all ignore files
    parents, roots, up = [], [], os.path.abspath(root)
    while True:
        parents.append(_Ignore.of(up))
        roots.append(_Ignore(up, [os.path.join(up, ".git", "info", "exclude")]))
        if up == os.path.dirname(up):
            break
        up = os.path.dirname(up)

    last = [_Ignore(os.path.abspath(root), [_global_file()])]

    def visit(folder: str, shown: str, rules: list[_Ignore], own_roots: list[_Ignore], seen: frozenset[str]):
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for entry in entries:
            if entry.name in skip or ("hidden" not in options and entry.name.startswith(".")):
                continue
            try:
                link = entry.is_symlink()
                is_dir = entry.is_dir(follow_symlinks="follow" in options)
                is_file = entry.is_file(follow_symlinks="follow" in options)
            except OSError:
                continue
            own = os.path.abspath(entry.path)
            if next((v for r in (*rules, *own_roots, *last) if (v := r.verdict(own, is_dir)) is not None), False):
                continue
            path = os.path.join(shown, entry.name) if shown else entry.name
            if is_dir and "dir" in options or not is_dir and (is_file or link) and "file" in options:
                yield path
            if is_dir:
                real = os.path.realpath(own)
                if real not in seen:
                    inner = _Ignore(own, [os.path.join(own, ".git", "info", "exclude")])
                    yield from visit(own, path, [_Ignore.of(own), *rules], [inner, *own_roots], seen | {real})

    start = os.path.abspath(root)
    yield from visit(start, "" if root == "." else root, parents, roots, frozenset({os.path.realpath(start)}))


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.roots = [x for x in options.get("roots", ".").split(os.pathsep) if x]
        self.options = parse_options(options.get("walk", "file,follow,hidden"))
        self.skip = tuple(x for x in options.get("skip", ",".join(SKIP)).split(",") if x)

    def partitions(self):
        return [InputPartition(r) for r in self.roots]

    def read(self, partition):
        for path in walk(partition.value, self.options, self.skip):
            yield (path,)


class WalkerSource(DataSource):
    """spark.read.format("walker").option("roots", "a:b").option("walk", "file,dir").option("skip", ".git").load()"""

    @classmethod
    def name(cls):
        return "walker"

    def schema(self):
        return "display string"

    def reader(self, schema):
        return _Reader(self.options)
