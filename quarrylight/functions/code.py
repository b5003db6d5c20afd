"""Column expressions over code files and chunks: identities, sizes, names, languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base names of files that say how a project is run rather than what it does.
AUXILIARY = (
    "codeowners", "owners", "owners_aliases", "license", "copying", "notice", "security", "security.md", "support", "support.md",
    "code_of_conduct", "code_of_conduct.md", "contributing", "contributing.md", "governance", "governance.md", "maintainers",
    "authors", "contributors", "pull_request_template", "pull_request_template.md", "issue_template", "issue_template.md",
    "dependabot.yml", "renovate.json", "renovate.json5", "release-drafter.yml", "funding.yml",
)

# Order in which the words of a syntax node's type name its kind, and suffixes dropped otherwise.
KIND_WORDS = ("method", "function", "class", "interface", "enum", "trait", "struct", "type", "namespace", "module", "variable", "rule", "table", "element")
KIND_SUFFIXES = ("_declaration", "_definition", "_statement", "_instruction", "_item", "_spec", "_expression", "_clause")


def bare_ext(ext: Column) -> Column:
    """Extension without one leading dot."""
    return F.regexp_replace(ext, r"^\.", "")


def chunk_id(rel_path: Column, start_line: Column, end_line: Column, content: Column) -> Column:
    """Stable id of a chunk: changes with its place and its text only."""
    return F.concat(F.lit("chunk_"), F.substring(F.sha2(F.concat_ws(":", rel_path, start_line.cast("string"), end_line.cast("string"), content), 256), 1, 16))


def collection_name(path: Column, host: Column) -> Column:
    """Table name of a root on a host."""
    return F.concat(F.lit("code_chunks_"), F.md5(F.concat(F.lower(host), F.lit(":"), path)))


def json_size(text: Column) -> Column:
    """Bytes of ``text`` as a JSON string with quotes; ``<``, ``>``, ``&`` and control characters take six bytes each."""
    hits = lambda p: F.regexp_count(text, F.lit(p))
    return F.octet_length(text) + 2 + hits(r"[\"\\\n\r\t\x08\x0c]") + 5 * hits(r"[<>&]|[\x00-\x07\x0b\x0e-\x1f]") + 3 * hits("[\u2028\u2029]")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_auxiliary(path: Column) -> Column:
    return F.lower(basename(path)).isin(*AUXILIARY)


def effective_ext(path: Column) -> Column:
    """Extension that decides on the language; some whole names stand for one."""
    b = F.lower(basename(path))
    return (
        F.when(b.isin("makefile", "gnumakefile"), ".mk")
        .when(b == "dockerfile", ".dockerfile")
        .when(b == ".gitattributes", ".gitattributes")
        .when(b == "go.sum", ".go.sum")
        .when(b == "requirements.txt", ".requirements.txt")
        .otherwise(F.regexp_extract(b, r"(\.[^.]*)$", 1))
    )


def split_lines(content: Column) -> Column:
    """Lines with their line ends; a final line end gives an empty last line."""
    return F.split(content, r"(?<=\n)", -1)


def symbol_kind(node_type: Column) -> Column:
    """Kind of a symbol from the type of its syntax node."""
    words = F.split(node_type, "[_-]")
    out, rest = F, node_type
    out = F.when(F.array_contains(words, KIND_WORDS[0]), KIND_WORDS[0])
    for w in KIND_WORDS[1:]:
        hit = F.array_contains(words, w)
        if w == "module":
            hit = hit | node_type.startswith("mod_")
        if w == "variable":
            hit = hit | F.array_contains(words, "lexical") | F.array_contains(words, "binding") | node_type.isin("pair", "attribute")
        out = out.when(hit, w)
    for s in KIND_SUFFIXES:
        rest = F.regexp_replace(rest, s + "$", "")
    plain = F.trim(F.regexp_replace(rest, "_", " "))
    return out.otherwise(F.when(plain == "", "definition").otherwise(plain))


def terms(text: Column) -> Column:
    """Index terms: runs of ASCII letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def query_terms(text: str) -> list[str]:
    """Terms of a question; single characters say nothing."""
    import re

    return sorted({w for w in re.split(r"[^a-z0-9]+", re.sub(r"[^\w\s]", " ", text, flags=re.A).lower()) if len(w) > 1})


def ancestors(path: Column) -> Column:
    """All proper ancestors of an absolute path, the root left out."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def status_line(info: str = "") -> Column:
    """One line on the state of a root."""
    p = info and info + "."
    day = lambda c: F.date_format(p + c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return (
        F.when(F.col(p + "status") == "indexing", F.concat(F.lit("indexing: "), F.coalesce(F.col(p + "step"), F.lit("")), F.lit(" since "), F.coalesce(day("started_at"), day("last_updated"))))
        .when(F.col(p + "status") == "indexed", F.concat(F.lit("indexed, last updated "), day("last_updated")))
        .when(F.col(p + "status") == "failed", F.concat(F.lit("failed: "), F.coalesce(F.col(p + "error_message"), F.lit(""))))
        .otherwise(F.concat(F.lit("unknown status for "), F.col(p + "path")))
    )


def result_text(rank: Column, rel_path: Column, start_line: Column, end_line: Column, ext: Column, content: Column, symbol: Column, kind: Column, stale: Column) -> Column:
    """A hit as text: where it is, the symbol around it, a note if its file has changed, and the fenced content."""
    none = F.lit("")
    head = F.format_string("### %d. %s:%d-%d", rank, rel_path, start_line, end_line)
    inside = F.when(symbol.isNotNull(), F.concat(F.lit("\nin "), kind, F.lit(" "), symbol)).otherwise(none)
    note = F.when(stale, "\n(the file has changed since it was indexed)").otherwise(none)
    return F.concat(head, inside, note, F.lit("\n```"), F.coalesce(ext, none), F.lit("\n"), F.coalesce(content, none), F.lit("\n```"))
