"""Chunkers: line-wise text windows, declaration-wise code chunks, windows over long lines, payload limits.

Files are independent, so each is chunked inside one Arrow batch; line lengths are summed up once and every cut is a search in
these sums. ``fixed_windows`` needs no state from one window to the next and is a plain projection.
"""

from __future__ import annotations

import ast
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.code import bare_ext, chunk_id
from quarrylight.session import map_batches

SIZE, OVERLAP, PAYLOAD = 4000, 200, 10_240
Chunk = tuple[str, int, int]


def limits(size: int, overlap: int) -> tuple[int, int]:
    """Defaults for what is not positive; the overlap is at most half the size."""
    size = size if size > 0 else 4000
    return size, min(overlap if overlap > 0 else 500, size // 2)


def lines_of(text: str) -> list[str]:
    """Lines with their ends; after a final line end comes an empty one. None for an empty text."""
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + [parts[-1]] if text else []


def windows(line: str, number: int, size: int, overlap: int) -> list[Chunk]:
    """Windows over one line that is longer than a chunk."""
    step, n = max(size - overlap, 1), len(line)
    count = 0 if not n else 1 if n <= size else -(-(n - size) // step) + 1
    return [(line[k * step : k * step + size], number, number) for k in range(count)]


def text_chunks(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[Chunk]:
    """Longest runs of whole lines within ``size`` characters; each begins with whole lines of the one before, ``overlap``
    characters or more of them where it has more than one line."""
    size, overlap = limits(size, overlap)
    if not text.strip():
        return []
    lines = lines_of(text)
    n = len(lines)
    upto = [0, *accumulate(map(len, lines))]
    long = [i for i, x in enumerate(lines) if len(x) > size]
    out, i = [], 0
    while i < n and (lines[i] or i + 1 < n):
        if len(lines[i]) > size:
            out += windows(lines[i], i + 1, size, overlap)
            i += 1
            continue
        if upto[n] - upto[i] <= size:
            end = n
        else:
            k = bisect_left(long, i)
            wall = long[k] if k < len(long) else n
            end = max(i + 1, min(wall, bisect_right(upto, upto[i] + size) - 1))
        out.append(("".join(lines[i:end]), i + 1, end))
        if end >= n:
            break
        back = bisect_right(upto, upto[end] - overlap) - 1
        i = min(end if overlap <= 0 else end - 1, max(i + 1, back)) if end > i + 1 else end
    return out


_NOISE = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`")
_HASH_NOISE = re.compile(r"#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'[^'\n]*'")
BRACED = {"go", "c", "h", "cs", "cpp", "cc", "cxx", "hpp", "hx", "css", "java", "rs", "js", "jsx", "mjs", "ts", "tsx", "php", "scala", "sbt", "kt", "kts", "swift", "ino"}
_HCL = {"hcl", "tf", "tfvars", "tofu"}
_DECLARES = re.compile(
    r"^(?:export\s+)?(?:default\s+)?(?:pub(?:\([^)]*\))?\s+)?(?:public|private|protected|static|final|abstract|async|unsafe|extern|inline|declare|const(?=\s+fn)|func|function|fn|type|class|interface|struct|enum|trait|impl|mod|namespace|var|let|const|def|record|union|typedef|module|macro_rules!|[A-Za-z_][\w\s*&<>:,\[\]]*\()"
)
# Where the parts of a text begin, for languages whose parts begin at the margin: ``(declaration, any part)``.
_MARGIN = {
    "rb": (re.compile(r"(?:class|module|def)\b"), re.compile(r"(?!end\b)\S")),
    "lua": (re.compile(r"(?:local\s+)?function\b"), re.compile(r"(?!end\b|\}|\))\S")),
    "ml": (re.compile(r"(?:let|and|type|module|val|external|exception|class)\b"), re.compile(r"(?!\||\}|\]|end\b|in\b|;;)\S")),
    "toml": (re.compile(r"\[{1,2}[^\[\],]+\]{1,2}\s*(?:#.*)?$"),) * 2,
    "yaml": (re.compile(r"(?:[\w\"'./-][^#\n]*:(?:\s|$)|- )"), re.compile(r"\S")),
    "sh": (re.compile(r"(?:function\s+[\w:-]+|[\w:-]+\s*\(\))"), re.compile(r"(?!\}|fi\b|done\b|esac\b|then\b|else\b|elif\b|do\b|\))\S")),
    "dockerfile": (re.compile(r"(?i)FROM\b"), re.compile(r"[A-Za-z]")),
    "mk": (re.compile(r"[^\s#=:]+[^=:\n]*:(?!=)"), re.compile(r"\S")),
}
_MARGIN |= {"luau": _MARGIN["lua"], "mli": _MARGIN["ml"], "yml": _MARGIN["yaml"], "bash": _MARGIN["sh"]}
_TAG = re.compile(r"<!--[\s\S]*?(?:-->|\Z)|<!\[CDATA\[[\s\S]*?(?:\]\]>|\Z)|<(script|style)\b[^>]*>[\s\S]*?</\1\s*>|<([/!?]?)([\w:.-]+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", re.I)
_ALONE = frozenset("area base br col embed hr img input link meta source track wbr".split())
_JSON = re.compile(r'"(?:\\.|[^"\\\n])*"|[\[\]{},\n]|[^\s"\[\]{},]+')
MARKUP = {"html", "htm", "xml", "svg", "xsd", "xslt", "xsl", "rng", "svelte", "astro"}
_REMARK = re.compile(r"^\s*(?://|/\*|\*|#(?!\[|include|define|if|endif)|--|@|#\[|$)")


def _blank(text: str, noise: re.Pattern) -> str:
    """``text`` with strings and comments blanked out, line ends kept."""
    return noise.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def unit_starts(text: str, ext: str) -> list[tuple[int, bool]] | None:
    """``(first line from 0, is a declaration)`` of the top-level parts; None for a language without a reader or a text that
    does not parse."""
    if ext == "py":
        try:
            body = ast.parse(text).body
        except (SyntaxError, ValueError, RecursionError):
            return None
        out = []
        for node in body:
            first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]) - 1
            out.append((first, isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)))
        return out
    if ext in _MARGIN:
        return _margin_starts(text, *_MARGIN[ext])
    if ext in MARKUP:
        return _element_starts(text)
    if ext == "json":
        return _pair_starts(text)
    if ext not in BRACED and ext not in _HCL:
        return None
    plain, depth, out, fresh = _blank(text, _HASH_NOISE if ext in _HCL else _NOISE), 0, [], True
    for i, (line, raw) in enumerate(zip(plain.split("\n"), text.split("\n"), strict=True)):
        if depth == 0 and line.strip() and line[0] not in " \t})]":
            out.append((i, ext in _HCL or bool(_DECLARES.match(line))))
        elif depth == 0 and fresh and raw.strip() and _REMARK.match(raw):
            out.append((i, False))
        depth += sum(map(line.count, "({[")) - sum(map(line.count, ")}]"))
        if depth < 0:
            return None
        fresh = depth == 0
    return out if depth == 0 else None


def _margin_starts(text: str, declares: re.Pattern, part: re.Pattern) -> list[tuple[int, bool]]:
    """Parts that begin at the margin; what is indented, closes one or goes on after a backslash belongs to the one before."""
    out, goes_on = [], False
    for i, line in enumerate(text.split("\n")):
        if not goes_on and part.match(line):
            out.append((i, bool(declares.match(line))))
        goes_on = line.rstrip("\r").endswith("\\")
    return out if not out or out[0][0] == 0 else [(0, False), *out]


def _element_starts(text: str) -> list[tuple[int, bool]] | None:
    """Elements of markup: those at the top, or where that is one for all, those right within it. None if they do not nest."""
    depth, found, open_ = 0, {0: [], 1: []}, []
    for m in _TAG.finditer(text):
        kind, name = m[2], (m[3] or m[1] or "").lower()
        if depth < 2 and not kind == "/" and (m[1] or m[3]) and kind not in ("!", "?"):
            found[depth].append(m.start())
        if not m[3] or kind in ("!", "?") or name in _ALONE or (m[4] or "").rstrip().endswith("/"):
            continue
        if kind == "/":
            if not open_ or open_.pop() != name:
                return None
            depth -= 1
        else:
            open_.append(name)
            depth += 1
    if depth:
        return None
    at = found[1] if len(found[0]) == 1 and found[1] else found[0]
    return [(k, True) for k in sorted({text.count("\n", 0, x) for x in at})]


def _pair_starts(text: str) -> list[tuple[int, bool]] | None:
    """Lines on which the members of the outermost object or array of JSON begin."""
    depth, line, out, fresh = 0, 0, [], False
    for m in _JSON.finditer(text):
        c = m[0]
        if c == "\n":
            line += 1
        elif c == ",":
            fresh |= depth == 1
        elif c in "]}":
            depth -= 1
        else:
            if depth == 1 and fresh:
                fresh = False
                if not out or out[-1][0] != line:
                    out.append((line, True))
            if c in "[{":
                depth += 1
                fresh |= depth == 1
    return out if depth == 0 else None


def code_chunks(text: str, ext: str, size: int = SIZE, overlap: int = OVERLAP) -> list[Chunk]:
    """Chunks of whole declarations; a file that fits is one chunk, what is too large for one goes to ``text_chunks``."""
    size, overlap = limits(size, overlap)
    ext = ext.lstrip(".").lower()
    if ext != "py" and ext != "json" and not any(ext in known for known in (BRACED, _HCL, _MARGIN, MARKUP)):
        return text_chunks(text, size, overlap)
    if not text:
        return []
    lines = lines_of(text)
    if len(text) <= size:
        return [(text, 1, len(lines))]
    starts = unit_starts(text, ext)
    if not starts:
        return text_chunks(text, size, overlap)
    starts = [(0, starts[0][1]), *starts[1:]]
    # Remarks right before a declaration belong to it, other parts stand together until the next declaration.
    cuts, group = [], None
    for k, (at, declares) in enumerate(starts):
        if declares:
            lead = k
            while lead and not starts[lead - 1][1] and _REMARK.match(lines[starts[lead - 1][0]]):
                lead -= 1
            first = starts[lead][0]
            if not cuts or first > cuts[-1]:
                cuts.append(first)
            elif first < at and cuts[-1] < at and lead == k:
                cuts.append(at)
            group = None
        elif group is None:
            group = at
            cuts.append(at) if not cuts or at > cuts[-1] else None
    cuts = sorted({0, *cuts})
    bounds = list(zip(cuts, [*cuts[1:], len(lines)], strict=True))
    out: list[Chunk] = []
    held: list[int] = []

    def flush() -> None:
        if held:
            out.append(("".join(lines[held[0] : held[1]]), held[0] + 1, held[1]))
            held.clear()

    upto = [0, *accumulate(map(len, lines))]
    for a, b in bounds:
        if upto[b] - upto[a] > size:
            flush()
            out += [(c, s + a, e + a) for c, s, e in text_chunks("".join(lines[a:b]), size, overlap)]
        elif held and upto[b] - upto[held[0]] <= size:
            held[1] = b
        else:
            flush()
            held[:] = [a, b]
    flush()
    return [c for c in out if c[0]]


def _json_bytes(text: str) -> int:
    plain = json.dumps(text, ensure_ascii=False)
    return len(plain.encode("utf-8", "replace")) + 5 * sum(map(text.count, "<>&")) + 3 * (text.count("\u2028") + text.count("\u2029"))


def payload_bytes(rel_path: str, ext: str, root: str, chunk: Chunk) -> int:
    """Bytes of a stored chunk as JSON."""
    content, start, end = chunk
    meta = _json_bytes(json.dumps({"codebasePath": root}, ensure_ascii=False, separators=(",", ":")))
    fixed = '{"id":"chunk_0123456789abcdef","content":,"relativePath":,"startLine":,"endLine":,"fileExtension":,"metadata":}'
    return len(fixed) + _json_bytes(content) + _json_bytes(rel_path) + len(str(start)) + len(str(end)) + _json_bytes(ext.removeprefix(".")) + meta


class Unsplittable(ValueError):
    """A chunk above the payload limit has no smaller parts."""


def within_payload(rel_path: str, ext: str, root: str, chunk: Chunk, limit: int = PAYLOAD) -> list[Chunk]:
    """The chunk, or parts of it that fit the limit."""
    todo, out = [chunk], []
    while todo:
        c = todo.pop()
        size = payload_bytes(rel_path, ext, root, c)
        if size <= limit:
            out.append(c)
            continue
        n = len(c[0])
        next_size = max(min(n * (limit - 1) // max(size, 1), n - 1), 1)
        parts = [(t, s + c[1] - 1, e + c[1] - 1) for t, s, e in code_chunks(c[0], ext, next_size, 1) if t]
        if len(parts) < 2 or any(p[0] == c[0] for p in parts):
            raise Unsplittable(f"{rel_path}:{c[1]}-{c[2]} takes {size} bytes, more than {limit}")
        todo += reversed(parts)
    return out


ENTITY = "rel_path string, ext string, content string, start_line int, end_line int, ordinal int"


def build_chunks(files: DataFrame, root: str | Column, size: int = SIZE, overlap: int = OVERLAP, mode: str = "ast", limit: int | None = PAYLOAD) -> DataFrame:
    """Stored chunks of ``rel_path, ext, content`` files: one pass, no shuffle.

    Null contents and paths give nothing; ``mode`` is ``ast`` or ``text``; ``limit`` None leaves chunks of any payload.
    """
    if mode not in ("ast", "text"):
        raise ValueError("mode is ast or text")
    where = root if isinstance(root, Column) else F.lit(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, ext, text, at in zip(b["rel_path"], b["ext"], b["content"], b["_root"], strict=True):
                ext = ext or ""
                got = code_chunks(text, ext, size, overlap) if mode == "ast" else text_chunks(text, size, overlap)
                if limit is not None:
                    got = [p for c in got for p in within_payload(path, ext, at or "", c, limit)]
                out += [(path, ext, c, s, e, k, at) for k, (c, s, e) in enumerate(got)]
            yield pd.DataFrame(out, columns=["rel_path", "ext", "content", "start_line", "end_line", "ordinal", "_root"])

    rows = files.where("content is not null and rel_path is not null").select("rel_path", "ext", "content", where.alias("_root"))
    return to_entities(map_batches(rows, run, ENTITY + ", _root string"), F.col("_root"))


def to_entities(chunks: DataFrame, root: Column) -> DataFrame:
    """The seven columns of a stored chunk."""
    meta = F.to_json(F.struct(root.alias("codebasePath")))
    return chunks.select(
        chunk_id(F.col("rel_path"), F.col("start_line"), F.col("end_line"), F.col("content")).alias("id"), "content", "rel_path", "start_line", "end_line", bare_ext(F.coalesce("ext", F.lit(""))).alias("ext"), meta.alias("metadata")
    )


def fixed_windows(rows: DataFrame, size: int, overlap: int, text: str = "content") -> DataFrame:
    """All columns but the text, with ``window, piece``: windows of ``size`` characters every ``size - overlap``."""
    step = max(size - overlap, 1)
    n = F.char_length(text)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1)
    rest = [c for c in rows.columns if c != text]
    spread = rows.where(n > 0).select(*rest, text, F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("window"))
    return spread.select(*rest, "window", F.expr(f"substring(`{text}`, window * {step} + 1, {size})").alias("piece"))
