"""Languages by extension and by content."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages, their extensions (the first one stands for the language) and other names they go by.
LANGUAGES = {
    "go": ((".go",), ()),
    "c": ((".c",), ()),
    "csharp": ((".cs",), ("c#",)),
    "cpp": ((".cpp", ".cc", ".cxx", ".hpp", ".hx"), ("c++",)),
    "css": ((".css",), ()),
    "html": ((".html", ".htm"), ()),
    "java": ((".java",), ()),
    "rust": ((".rs",), ()),
    "javascript": ((".js", ".jsx"), ("js", "node")),
    "typescript": ((".ts",), ("ts",)),
    "tsx": ((".tsx",), ()),
    "python": ((".py",), ("py",)),
    "php": ((".php",), ()),
    "ruby": ((".rb",), ()),
    "scala": ((".scala", ".sbt"), ()),
    "ocaml": ((".ml",), ()),
    "ocaml-interface": ((".mli",), ()),
    "arduino": ((".ino",), ()),
    "gitattributes": ((".gitattributes",), ()),
    "go-sum": ((".go.sum",), ()),
    "hcl": ((".hcl", ".tf", ".tfvars", ".tofu"), ()),
    "kotlin": ((".kt", ".kts"), ()),
    "lua": ((".lua",), ()),
    "luau": ((".luau",), ()),
    "requirements": ((".requirements.txt",), ()),
    "toml": ((".toml",), ()),
    "xml": ((".xml", ".svg", ".xsd", ".xslt", ".xsl", ".rng"), ()),
    "dtd": ((".dtd",), ()),
    "shell": ((".sh", ".bash"), ("bash", "sh", "zsh", "dash", "ksh")),
    "dockerfile": ((".dockerfile",), ()),
    "makefile": ((".mk",), ("make",)),
    "json": ((".json",), ()),
    "yaml": ((".yaml", ".yml"), ()),
    "markdown": ((".md", ".markdown"), ("md",)),
    "svelte": ((".svelte",), ()),
    "astro": ((".astro",), ()),
}
BY_EXT = {e: name for name, (exts, _) in LANGUAGES.items() for e in exts}
BY_NAME = {n: name for name, (_, names) in LANGUAGES.items() for n in (name, *names)}
MODELINE = (r"(?i)-\*-\s*(?:.*?mode:\s*)?([a-z+#\-]+?)\s*(?:;.*?)?-\*-", r"(?i)\b(?:vim?|ex):\s*(?:set?\s+)?(?:.*?[ :])?(?:ft|filetype|syntax)=([a-z+#\-]+)")
SHEBANG = r"^#![ \t]*(?:\S*/)?(?:env[ \t]+(?:-\S+[ \t]+)*)?([A-Za-z]+)"


def _look_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))[key]


def by_ext(ext: Column) -> Column:
    """Language of an extension with its dot, in any case; null if it is none of them."""
    return _look_up(BY_EXT, F.lower(ext))


def by_content(content: Column) -> Column:
    """Language a text names itself, in an editor's line within its first or last five lines, else by its interpreter."""
    lines = F.split(content, "\n")
    edges = F.concat_ws("\n", F.slice(lines, 1, 5), F.slice(F.reverse(lines), 1, 5))
    said = [F.regexp_extract(edges, p, 1) for p in MODELINE]
    named = [_look_up(BY_NAME, F.lower(F.nullif(x, F.lit("")))) for x in (*said, F.regexp_extract(content, SHEBANG, 1))]
    return F.coalesce(*named)


def language(ext: Column, content: Column) -> Column:
    """Language by extension, else by content."""
    return F.coalesce(by_ext(ext), by_content(content))


def read_as(ext: Column, content: Column) -> Column:
    """The extension a file is read by: its own, or for one that says nothing that of the language its content names."""
    primary = _look_up({name: exts[0] for name, (exts, _) in LANGUAGES.items()}, by_content(content))
    return F.when(by_ext(ext).isNull(), F.coalesce(primary, ext)).otherwise(ext)
