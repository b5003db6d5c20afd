"""Source files that do not parse, by error-correcting chart parsing.

Every text is parsed with the grammar of its language by a chart that also holds items reached by edits (a token deleted,
inserted or replaced); the number of edits that make it a text of the language flags it if it is not zero. It is the least found,
within a content of over two edits nearly always the least there is, and surely so with ``least``: see ``syntax.chart``. Where the
edits lie tells why: at the end of an unclosed text (truncation), on lines of conflict markers, all over it (another language) or at one place.
For Python and JSON, whose parsers are at hand, what the chart flags is checked by these before it is reported. The rules for Python
are looser than the language in what may be assigned to and in the order of arguments and parameters, so what the chart takes is
checked by its parser too, and counts as one edit if that refuses it.

Defined results
* the language is that of ``ext``, else of the suffix of ``rel_path``, among those marked ``parse_checked``; other files give no row;
* a null content gives no row; an empty one is valid where the language allows it (not JSON, which needs a value, nor Go, which
  needs a package clause);
* a byte order mark at the start and CRLF line ends do no harm (JSON allows no mark);
* identical repeated rows give one row, null file_ids none; files of any length are parsed whole;
* an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.syntax import grammars
from quarrylight.llm.syntax.chart import Result, parse
from quarrylight.session import join_small, map_batches

CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: |$)|^={7}$", re.M)
PARSED = "file_id long, root string, lang string, tokens int, edits int, cause string"
_made: dict[str, grammars.Language] = {}


def _finite(x: str):
    raise ValueError(x)


def exact(lang: str, text: str) -> bool | None:
    """Does the language's own parser take ``text``? None where there is none at hand."""
    try:
        if lang == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        elif lang == "json":
            json.loads(text, parse_constant=_finite)
        else:
            return None
    except (RecursionError, MemoryError):
        return None
    except ValueError:  # SyntaxError of either too
        return False
    except SyntaxError:
        return False
    return True


def cause_of(r: Result, tokens: str, text: str, lang: grammars.Language) -> str:
    n = max(1, len(tokens))
    for m in CONFLICT.finditer(text):
        # A marker is met on its line, or on the next if that goes on with what stood before.
        after = text.find("\n", m.end()) + 1 or len(text)
        after = text.find("\n", after) + 1 or len(text)
        low, high = len(lang.tokens(text[: m.start()])) - 1, len(lang.tokens(text[:after])) + 1
        if any(low <= p <= high for p in r.places):
            return "conflict"
    if r.unclosed and r.cost - r.unclosed <= 2:
        return "truncation"
    if r.cost >= 4 and (r.cost > 0.08 * n or min(r.places, default=n) < 0.03 * n):
        return "mismatch"
    if r.places and max(r.places) >= n - 3:
        return "truncation"
    return "local"


def check(lang: grammars.Language, name: str, text: str, least: bool = False) -> tuple[int, int, str | None]:
    """``(tokens, edits, cause)``; no edits and no cause for a text that parses."""
    plain = text.replace("\r\n", "\n")
    if name != "json":
        plain = plain.removeprefix("\ufeff")
        if plain.startswith("#!") and name in ("javascript", "typescript", "rust", "java", "go"):
            plain = plain[plain.find("\n") :] if "\n" in plain and name in ("javascript", "typescript") else plain
    tokens = lang.tokens(plain)
    r = parse(lang.grammar, tokens, least)
    if not r.cost:
        wrong = name == "python" and exact(name, plain) is False
        return len(tokens), int(wrong), "local" if wrong else None
    if exact(name, text):
        return len(tokens), 0, None
    return len(tokens), r.cost, cause_of(r, tokens, plain, lang)


def parsed(files: DataFrame, languages: DataFrame, least: bool = False) -> DataFrame:
    """``file_id, root, lang, tokens, edits, cause`` of every file of a checked language; ``edits`` 0 if it parses.

    ``least``: the edits of each content are surely the least, at several times the cost for broken files.
    """
    ext = F.lower(F.coalesce(F.col("ext"), F.concat(F.lit("."), F.nullif(F.regexp_extract("rel_path", r"\.([A-Za-z0-9]+)$", 1), F.lit("")))))
    rows = files.where("file_id is not null and content is not null").select("file_id", "root", ext.alias("_ext"), "content")
    checked = languages.where("parse_checked").select(F.lower("ext").alias("_ext"), "lang").where(F.col("lang").isin(sorted(grammars.LANGUAGES))).distinct()
    known = join_small(rows, checked, ["_ext"], spread=F.col("file_id")).select("file_id", "root", "lang", "content")
    # The automata are made once; they are as large as the grammars, whatever the data.
    ready = files.sparkSession.sparkContext.broadcast({r.lang: grammars.tables(r.lang) for r in checked.select("lang").distinct().limit(len(grammars.LANGUAGES)).collect()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for fid, root, name, text in zip(b["file_id"], b["root"], b["lang"], b["content"], strict=True):
                if name not in _made:
                    _made[name] = grammars.language(name, ready.value[name])
                out.append((fid, root, name, *check(_made[name], name, text, least)))
            yield pd.DataFrame(out, columns=["file_id", "root", "lang", "tokens", "edits", "cause"])

    return map_batches(known, run, PARSED).dropDuplicates(["file_id"])


def rates(checked: DataFrame) -> DataFrame:
    """``root, lang, n_files, n_bad, bad_rate``."""
    return checked.groupBy("root", "lang").agg(F.count(F.lit(1)).alias("n_files"), F.sum((F.col("edits") > 0).cast("long")).alias("n_bad")).withColumn("bad_rate", F.round(F.col("n_bad") / F.col("n_files"), 6))
