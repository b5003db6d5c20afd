"""Symbols of source files: name, kind and lines of declarations, for the languages that have a reader."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quarrylight.operators.chunking import _HASH_NOISE, _NOISE, _blank
from quarrylight.session import map_batches

Symbol = tuple[str, str, int, int]
_JS = [
    (r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)", "function"),
    (r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)", "class"),
    (r"^[ \t]*(?:export\s+)?(?:declare\s+)?interface\s+([\w$]+)", "interface"),
    (r"^[ \t]*(?:export\s+)?(?:const\s+)?enum\s+([\w$]+)", "enum"),
    (r"^[ \t]*(?:export\s+)?type\s+([\w$]+)[^=\n]*=", "type"),
    (r"^(?:export\s+)?(?:const|let|var)\s+([\w$]+)", "variable"),
    (r"^[ \t]+(?:(?:static|async|get|set|public|private|protected|readonly)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)([\w$]+)\s*\([^;{}\n]*\)\s*(?::[^{;\n]+)?\{", "method"),
]
RULES: dict[str, list[tuple[str, str]]] = {
    "go": [(r"^func\s+\([^)]*\)\s*(\w+)", "method"), (r"^func\s+(\w+)", "function"), (r"^type\s+(\w+)", "type"), (r"^(?:var|const)\s+(\w+)", "variable")],
    "rs": [
        (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(\w+)", "function"),
        (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", "struct"),
        (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", "enum"),
        (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)", "trait"),
        (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)", "module"),
        (r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)", "type"),
    ],
    "js": _JS,
    "jsx": _JS,
    "ts": _JS,
    "tsx": _JS,
    "sh": [(r"^[ \t]*(?:function\s+)?([\w\-]+)\s*\(\)", "function"), (r"^[ \t]*function\s+([\w\-]+)", "function")],
}
_BUILT = {k: [(re.compile(p, re.M), kind) for p, kind in v] for k, v in RULES.items()}


def _end(plain: str, at: int) -> int:
    """Offset at which the declaration that begins at ``at`` ends: its block, else its line."""
    line = plain.find("\n", at)
    line = len(plain) if line < 0 else line
    depth, opened = 0, False
    for m in re.compile(r"[({\[\]})\n;]").finditer(plain, at):
        c = m[0]
        if c in "({[":
            depth += 1
            opened |= c == "{"
        elif c in ")}]":
            depth -= 1
            if opened and depth <= 0 and c == "}":
                return m.start()
        elif depth <= 0 and m.start() >= line and not opened:
            return line
    return line


def symbols_of(text: str, ext: str) -> list[Symbol]:
    """``(name, kind, first line, last line)`` in order of lines; none for a language without a reader."""
    ext = ext.lstrip(".").lower()
    out: list[Symbol] = []
    if ext == "py":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return []
        todo = [(n, False) for n in tree.body]
        while todo:
            node, inner = todo.pop()
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if inner else "function"
                out.append((node.name, kind, node.lineno, node.end_lineno or node.lineno))
                todo += [(n, isinstance(node, ast.ClassDef)) for n in node.body]
    elif ext in _BUILT:
        plain = _blank(text, _HASH_NOISE if ext == "sh" else _NOISE)
        for pattern, kind in _BUILT[ext]:
            for m in pattern.finditer(plain):
                a = m.start(1)
                out.append((m[1], kind, plain.count("\n", 0, a) + 1, plain.count("\n", 0, _end(plain, a)) + 1))
    if ext == "go":
        out = merge_symbols(out, grouped(text))
    seen: set[tuple[str, int]] = set()
    merged = []
    for s in sorted(out, key=lambda s: (s[2], s[3], s[0])):  # the first of one name and line stays
        if (s[0], s[2]) not in seen:
            seen.add((s[0], s[2]))
            merged.append(s)
    return merged


_GROUP = re.compile(r"^(type|var|const)\s*\(", re.M)
_BRACKET = re.compile(r"[(){}\[\]]")
_MEMBER = re.compile(r"^[ \t]+([A-Za-z_]\w*)(?=[ \t,=]|$)", re.M)


def grouped(text: str) -> list[Symbol]:
    """Members of the grouped declarations of Go, ``type ( ... )`` and the like, which patterns by line do not see."""
    if not _GROUP.search(text):
        return []
    plain, out = _blank(text, _NOISE), []
    for g in _GROUP.finditer(plain):
        depth, end = 1, len(plain)
        for m in _BRACKET.finditer(plain, g.end()):
            depth += 1 if m[0] in "({[" else -1
            if not depth:
                end = m.start()
                break
        level, at, line_no = 0, g.end(), plain.count("\n", 0, g.end()) + 1
        for line in plain[at:end].split("\n"):
            if level == 0 and (m := _MEMBER.match(line)):
                out.append((m[1], "type" if g[1] == "type" else "variable", line_no, line_no + plain.count("\n", at, _end(plain, at))))
            level += sum(map(line.count, "({[")) - sum(map(line.count, ")}]"))
            at, line_no = at + len(line) + 1, line_no + 1
    return out


def merge_symbols(first: list[Symbol], more: list[Symbol]) -> list[Symbol]:
    """``first`` and those of ``more`` that overlap none of the same name and kind; blank names are dropped."""
    return first + [s for s in more if s[0].strip() and not any(s[:2] == t[:2] and s[2] <= t[3] and t[2] <= s[3] for t in first)]


def symbols(files: DataFrame) -> DataFrame:
    """``rel_path, name, kind, start_line, end_line`` of ``rel_path, ext, content`` files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(
                [(p, *s) for p, e, t in zip(b["rel_path"], b["ext"], b["content"], strict=True) for s in symbols_of(t, e or p.rpartition(".")[2])],
                columns=["rel_path", "name", "kind", "start_line", "end_line"],
            )

    rows = files.where("content <> '' and rel_path is not null").select("rel_path", "ext", "content")
    return map_batches(rows, run, "rel_path string, name string, kind string, start_line int, end_line int")
