"""The filter language of searches, compiled to column predicates that reach the scan.

``relativePath == "x"``, ``fileExtension in ["go", "ts"]``, ``id in [...]``, ``relativePath like "dir/%"`` (the final ``%`` alone
is a wildcard), numeric comparisons of ``startLine`` and ``endLine``, joined by ``and``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = {"id": "id", "relativePath": "rel_path", "fileExtension": "ext", "startLine": "start_line", "endLine": "end_line"}
NUMERIC = {"startLine", "endLine"}
STRING = r'"((?:[^"\\]|\\.)*)"'
_CLAUSE = re.compile(rf"\s*(\w+)\s*(==|!=|>=|<=|>|<|in|like)\s*({STRING}|-?\d+|\[[^\]]*\])\s*")


class FilterError(ValueError):
    """The text is no filter."""


def _string(text: str) -> str:
    m = re.fullmatch(STRING, text)
    if not m:
        raise FilterError(f"a quoted text was expected, not {text}")
    return re.sub(r"\\(.)", r"\1", m[1])


def clauses(text: str) -> list[tuple[str, str, object]]:
    """``(field, operator, value)`` of each clause."""
    out, at = [], 0
    while True:
        m = _CLAUSE.match(text, at)
        if not m or m[1] not in FIELDS:
            raise FilterError(f"unsupported filter expression: {text[at:]}")
        field, op, raw = m[1], m[2], m[3]
        if op == "in":
            if not raw.startswith("["):
                raise FilterError("in needs a list")
            inner = raw[1:-1].strip()
            value: object = [_string(x[0]) for x in re.findall(rf"({STRING}|[^,\s]+)", inner)]
        elif op == "like":
            value = _string(raw)
            if not value.endswith("%"):
                raise FilterError("like needs a prefix that ends in %")
        elif field in NUMERIC:
            if raw[0] == '"':
                raise FilterError(f"{field} is a number")
            value = int(raw)
        elif op in ("==", "!="):
            value = _string(raw)
        else:
            raise FilterError(f"{op} needs a number")
        out.append((field, op, value))
        at = m.end()
        if at == len(text):
            return out
        if not text.startswith("and ", at):
            raise FilterError(f"unsupported filter expression: {text[at:]}")
        at += 4


def compile_filter(text: str | None, *, deleting: bool = False) -> Column | None:
    """Predicate of a filter; None for an empty one, which a deletion may not have."""
    if not text or not text.strip():
        if deleting:
            raise FilterError("empty filter")
        return None
    parsed = clauses(text.strip())
    if deleting and len(parsed) > 1 and any(f == "id" and op == "in" for f, op, _ in parsed):
        raise FilterError("a list of ids stands alone in a deletion")
    out = None
    for field, op, value in parsed:
        c = F.col(FIELDS[field])
        one = {
            "==": lambda c=c, v=value: c == v,
            "!=": lambda c=c, v=value: c != v,
            ">=": lambda c=c, v=value: c >= v,
            "<=": lambda c=c, v=value: c <= v,
            ">": lambda c=c, v=value: c > v,
            "<": lambda c=c, v=value: c < v,
            "in": lambda c=c, v=value: c.isin(*v) if v else F.lit(False),
            "like": lambda c=c, v=value: c.startswith(v[:-1]),
        }[op]()
        out = one if out is None else out & one
    return out


def normal_extensions(exts: list[str]) -> list[str]:
    """One leading dot off, empty ones dropped."""
    return [e for e in (x.removeprefix(".") for x in exts) if e]


def quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def search_filter(root: str, path: str, exts: list[str]) -> str:
    """Filter text of a search below ``path`` of ``root`` for some extensions."""
    root, path, parts = root.rstrip("/"), path.rstrip("/"), []
    if path != root:
        if not path.startswith(root + "/"):
            raise FilterError(f"{path} is not in {root}")
        parts.append("relativePath like " + quoted(path[len(root) + 1 :] + "/%"))
    if wanted := normal_extensions(exts):
        parts.append("fileExtension in [" + ", ".join(map(quoted, wanted)) + "]")
    return " and ".join(parts)
