"""Generated, minified or vendored source files, by grammars inferred over their tokens.

A Re-Pair grammar is inferred for every file: pairs of neighbouring symbols that repeat in the file become rules, again and again
until no pair repeats. All files of a batch advance together, in rounds that replace every locally most frequent pair, so the
inference is array arithmetic. A rule's name is a hash of what it expands to, the same in every file. What repeats only across
files has no such rule; every file is also cut into blocks at places its content alone decides, so that a copied stretch is cut
into the same blocks wherever it stands, repeated there or not. Flags:

* rules used over and over around identifiers numbered in a row: output of a generator;
* literals that no rule can shorten and little else: data saved as code;
* long rules, or else blocks, that repositories share: copies of third-party code. The larger of both shares counts; a stretch
  copied into another text loses at its ends the block it has not whole, a file of under ``LONG`` tokens is no copy;
* short rules that repositories share and that tell of an origin: symbols, pairs and, of comments, threes of neighbouring symbols
  in the path, the comments and the code. What they tell is learned: a logistic regression a kind (lock file, third party,
  declared generated, compiled) over the rules that files of several repositories share;
* texts in which almost all lies on very long lines without blanks: minified scripts and styles.

The regressions are fitted on a sample of files bounded by ``sample`` (those of the smallest hash of their id), labelled weakly by
patterns for what files say of their origin, for directories and for names of lock files, and on a few fixed examples, so the method
is the same for every number of files. The patterns label that sample only; no result is read off them.

Defined results
* null content, path and ext count as empty; empty files are never flagged;
* identical repeated rows give one row; files of any length are read whole; null file_ids give no row;
* an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.session import join_small, map_batches, materialise

#: A rule of this many tokens is long enough to compare repositories by.
LONG = 32
#: Tokens whose hash decides about a cut between blocks.
GRAM = 4
#: Share of a file's tokens under long rules of several repositories from which it counts as a copy.
SHARED = 0.5
#: Values of a data dump, literals among what the grammar leaves, share of encoded characters.
VALUES, LITERALS, ENCODED = 80, 0.35, 0.75
#: Identifiers numbered in a row, and share of tokens under rules used at least four times.
SERIAL, REUSE = 4, 0.2
LINE = 500

SLASH = re.compile(
    r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[-]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|[^\W\d]\w*|[^\s\w]"
)
HASH = re.compile(
    r"\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|#[^\n]*|[-]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w]))|\w+|[^\s\w]"
)
SLASHED = {"go", "js", "ts", "jsx", "tsx", "mjs", "cjs", "java", "rs", "c", "h", "cc", "cpp", "hpp", "cs", "kt", "scala", "swift", "css", "scss", "less", "php", "json", "dart"}
SCRIPTS = {"js", "mjs", "cjs", "css", "jsx"}

# Names of lock files, and of directories for the code of others.
LOCKS = {"package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "cargo.lock", "poetry.lock", "pipfile.lock", "composer.lock", "gemfile.lock", "uv.lock", "flake.lock", "bun.lockb", "packages.lock.json"}
ABROAD = re.compile(r"(?:^|/)(?:node_modules|bower_components|jspm_packages|vendor|third[_-]party|3rdparty|Pods|Carthage|site-packages|dist-packages|Godeps)/|(?:^|/)(?:external|extern|deps)/[^/]+/[^/]+$|(?:^|/)(?:external|extern|deps)/[^/]+/.+/")
COMMENT = r"^[ \t]*(?:/\*+!?|\*|//+!?|#+|--|;+|<!--|\"\"\"|%)[ \t]*"
GENERATED = re.compile(
    COMMENT + r"(?![^\n]*(?:\bnot\b|\bnever\b|n't|by hand,)[^\n]{0,20}generated)[^\n]*?(?:\bcode generated\b|\bauto-?generated\b|(?:^|\W)@generated\b|\bgenerated (?:by|from|with|using|automatically|file|code|on)\b"
    r"|\b(?:automatically|machine)[- ](?:generated|created|produced)\b|\bdo not (?:edit|modify|change)\b[^\n]*\b(?:generat|by hand|manual)|\b(?:this|the) file (?:is|was|has been) generated\b|automatisch (?:erzeugt|generiert|erstellt)|se genera autom[aá]ticamente|generado autom[aá]ticamente"
    r"|généré automatiquement|gerado automaticamente|generato automaticamente|自动生成|自動生成|сгенерирован)",
    re.I | re.M,
)
FOREIGN = re.compile(
    COMMENT + r"[^\n]*?(?:\bcopied (?:unchanged |verbatim |unmodified )?from\b|\bvendored (?:snapshot|copy|from|version)\b|\bupstream project\b|\bpart of the [\w.\-]+ (?:library|project|package|distribution)\b"
    r"|\bcopyright\b[^\n]*\b(?:contributors|developers|authors|maintainers|project|foundation)\b|\(c\) [^\n]*\b(?:contributors|developers|authors|maintainers)\b|\bimported from (?:upstream|https?:)|\bthird[- ]party (?:code|source|library|copy)\b[^\n]*\b(?:do not|unmodified|unchanged)\b)",
    re.I | re.M,
)
COMPILED = re.compile(r"Object\.defineProperty\(exports, ?[\"']__esModule[\"']|__webpack_require__|^//# sourceMappingURL=|\b_interopRequireDefault\b|\b__importDefault\b", re.M)
NUMBERED = re.compile(r"[A-Za-z_]*?[A-Za-z](\d{1,4})(?:_[a-z]+)?$")
RANDOM = re.compile(r"(?=[^\n]*\d)(?=[^\n]*[A-Za-z])[A-Za-z0-9+/=_\-]{5,}$")
MASK = (1 << 63) - 1
LETTERS = re.compile(r"[^\W\d_]+")

#: Files the regressions are fitted on, rules they may use, and files that have to share a rule.
SAMPLE, RULES, FILES = 10_000, 8_192, 3
#: Share of the files with a rule that have to be labelled for it to tell something.
TELLING = 0.6
KINDS = ("lock file", "third party", "declared generated", "compiled")


def random_like(body: str) -> bool:
    """Characters in no order of words: digits among letters of both cases, or encoded bytes."""
    if len(body) >= 40 and re.fullmatch(r"[A-Za-z0-9+/=_\-\s\\]+", body) and (" " not in body.strip()):
        return bool(re.search(r"\d", body)) and bool(re.search(r"[a-z]", body)) and bool(re.search(r"[A-Z]|[0-9a-f]{40}", body))
    return bool(RANDOM.match(body)) and not re.fullmatch(r"[A-Za-z_]+[-_.]?\d{1,4}|[a-z]+(?:[-_.][a-z0-9]+)+|v?\d+(?:\.\d+)*", body) and len(re.findall(r"[A-Z][a-z]|[a-z][A-Z]|\d[A-Za-z]|[A-Za-z]\d", body)) >= 2


class Symbols(dict):
    """Symbol of a token: 0 for a comment, negative for a literal no rule can hold, else a hash. Filled as tokens come."""

    def __missing__(self, tok: str) -> int:
        head = tok[0]
        if head == "#" or tok.startswith(("//", "/*")):
            value = 0
        elif head.isdigit() or (head == "-" and len(tok) > 1):
            value = -len(tok) if len(tok) >= 2 else xxhash.xxh64_intdigest(tok) & MASK | 1
            if not re.fullmatch(r"-?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)", tok):  # a bare scalar
                value = -len(tok) if random_like(tok) else xxhash.xxh64_intdigest(tok) & MASK | 1
        elif head in "\"'`":
            body = tok.strip("\"'`").strip()
            value = -len(body) if random_like(body) else xxhash.xxh64_intdigest(tok.encode("utf-8", "replace")) & MASK | 1
        elif len(tok) >= 5 and random_like(tok) and not NUMBERED.match(tok):
            value = -len(tok)
        else:
            value = xxhash.xxh64_intdigest(tok.encode("utf-8", "replace")) & MASK | 1
        if len(self) < 1_000_000:
            self[tok] = value
        return value


def repair(sym: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds over many files: what is left of them as ``(symbol, file, expanded length)``.

    A round turns into rules all pairs that repeat in their file and are more frequent there than the pairs they overlap.
    Negative symbols are literals; each of them stands for itself alone.
    """
    size = np.ones(len(sym), dtype=np.int32)
    sym = sym.astype(np.int64)
    while len(sym) > 1:
        a, b = sym[:-1], sym[1:]
        ok = (doc[:-1] == doc[1:]) & (a > 0) & (b > 0)
        at = np.flatnonzero(ok)
        if not len(at):
            break
        with np.errstate(over="ignore"):
            pair = a[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            pair ^= pair >> np.uint64(32)
            pair = (pair + b[at].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            pair ^= pair >> np.uint64(32)
            key = (pair + doc[at].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        order = np.argsort(key)
        sk = key[order]
        start = np.flatnonzero(np.r_[True, sk[1:] != sk[:-1]])
        n = np.diff(np.r_[start, len(sk)])
        count = np.zeros(len(sym) + 1, dtype=np.int64)
        count[at[order]] = np.repeat(n, n)
        rank = np.zeros(len(sym) + 1, dtype=np.uint64)
        rank[at] = pair
        i = at[count[at] >= 2]
        if not len(i):
            break
        even = (i & 1) == 0
        before = (count[i] > count[i - 1]) | ((count[i] == count[i - 1]) & ((rank[i] > rank[i - 1]) | ((rank[i] == rank[i - 1]) & even)))
        before |= i == 0
        after = (count[i] > count[i + 1]) | ((count[i] == count[i + 1]) & ((rank[i] > rank[i + 1]) | ((rank[i] == rank[i + 1]) & even)))
        i = i[before & after]
        if not len(i):
            break
        sym[i] = (rank[i] & np.uint64(MASK)).astype(np.int64) | 1
        size[i] += size[i + 1]
        keep = np.ones(len(sym), dtype=bool)
        keep[i + 1] = False
        sym, doc, size = sym[keep], doc[keep], size[keep]
    return sym, doc, size


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits from 64 bits, all of them depending on all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def blocks(sym: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of at least ``LONG`` symbols that make up the files of so many, as ``(rule, file, length)``.

    A cut is where the hash of the next ``GRAM`` symbols is the least within ``LONG`` on both sides, the first of equal ones.
    """
    total = len(sym)
    if not total:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    cut = np.zeros(total, dtype=bool)
    cut[head] = True
    one = mixed(sym.astype(np.int64).view(np.uint64))
    with np.errstate(over="ignore"):
        if total >= 2 * LONG + GRAM:
            gram = one[: total - GRAM + 1].copy()
            for k in range(1, GRAM):
                gram = mixed(gram) + one[k : total - GRAM + 1 + k]
            gram = mixed(gram)
            least, width = gram, 1
            while width < LONG:
                step = min(width, LONG - width)
                least, width = np.minimum(least[:-step], least[step:]), width + step
            at = np.arange(LONG, len(gram) - LONG)
            at = at[(gram[at] < least[at - LONG]) & (gram[at] <= least[at + 1])]
            cut[at[(doc[at - LONG] == doc[at]) & (doc[at] == doc[at + LONG + GRAM - 1])]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.r_[start, total])
        place = np.arange(total) - np.repeat(start, size)
        rule = mixed(np.add.reduceat(mixed(one + mixed(place.astype(np.uint64) + np.uint64(1))), start) + size.astype(np.uint64))
    whole = size >= LONG
    return (rule & np.uint64(MASK)).astype(np.int64)[whole], doc[start][whole], size[whole]


def serial(names: set[str]) -> int:
    """Identifiers numbered in a row, of the longest such row."""
    numbers = {int(m[1]) for n in names if (m := NUMBERED.match(n))}
    best = 0
    for v in numbers:
        if v - 1 not in numbers:
            k = v
            while k + 1 in numbers:
                k += 1
            best = max(best, k - v + 1 if v <= 1 else 0)
    return best


# Fixed examples beside the sampled files: ``(kinds, path, text)``, as if files of ``COPIES`` repositories.
COPIES = 12
_BODY = "package a\n\nfunc Add(a, b int) int {\n\treturn a + b\n}\n"
EXAMPLES = (
    *(((0,), f"app/{n}", "{}") for n in sorted(LOCKS)),
    *(((1,), f"app/{d}/lib/core.go", _BODY) for d in ("node_modules", "bower_components", "vendor", "third_party", "third-party", "3rdparty", "Pods", "site-packages", "Godeps", "external", "extern", "deps")),
    *(((1,), "app/zip.go", f"// {t}\n" + _BODY) for t in ("This file is part of the zip library, version 1.2.", "Copyright (c) 2020 The Zip Authors.", "Copyright 2019 Zip contributors", "Copied verbatim from zip.", "Vendored copy of zip.", "See the upstream project.")),
    *(((2,), "app/gen.go", f"// {t}\n" + _BODY) for t in ("Code generated by tool. DO NOT EDIT.", "@generated", "This file was automatically generated, do not edit by hand.", "autogenerated by tool", "auto-generated file", "Generated from api.json", "machine generated")),
    *(((3,), "app/out.js", t) for t in ('"use strict";\nObject.defineProperty(exports, "__esModule", { value: true });\n', "a();\n//# sourceMappingURL=out.js.map\n", "var x = __webpack_require__(3);\n", "var x = _interopRequireDefault(y);\n", "var x = __importDefault(y);\n")),
    *(((), f"app/{n}", t + _BODY) for n in ("main.go", "core/add.go", "lib/util/sum.go") for t in ("", "// Package a adds numbers.\n", "// Copyright 2024 Own. All rights reserved.\n", "// This module is written by hand, not generated.\n", "// Do not edit without a review.\n", '// "use strict" and exports are set elsewhere.\n')),
    *(((), f"app/{n}", "{}") for n in ("package.json", "settings.json", "cargo.toml", "main.lock.go")),
)


class Names(dict):
    """Hash of a word, filled as words come, bounded."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "replace")) & MASK | 1
        if len(self) < 500_000:
            self[word] = value
        return value


def short_rules(sym: np.ndarray, doc: np.ndarray, salt: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one to ``most`` neighbouring symbols as ``(rule, file)``; literals are in none. Equal runs have equal names."""
    one = mixed(sym.astype(np.int64).view(np.uint64) + np.uint64(salt))
    names, files = [one[sym > 0]], [doc[sym > 0]]
    whole, rule = sym > 0, one
    for k in range(1, most):
        if len(rule) < 2:
            break
        with np.errstate(over="ignore"):
            rule = mixed(rule[:-1]) + one[k:]
        whole = whole[:-1] & (sym[k:] > 0)
        ok = whole & (doc[: len(rule)] == doc[k:])
        names.append(rule[ok])
        files.append(doc[: len(rule)][ok])
    return np.concatenate(names).view(np.int64), np.concatenate(files)


class Tokens:
    """The tokens of a batch of files: symbols, the same with literals by what they are, words of comments, names of the path."""

    def __init__(self, b: pd.DataFrame, symbols: Symbols, names: Names):
        parts, exact, words, paths = [], [], [], []
        self.rows = []
        for path, ext, text in zip(b["rel_path"], b["ext"], b["content"], strict=True):
            path, text = path or "", text or ""
            base = path.rpartition("/")[2]
            kind = (ext or ("." + base.rpartition(".")[2] if "." in base else "")).lstrip(".").lower()
            toks = (SLASH if kind in SLASHED else HASH).findall(text)
            s = np.fromiter(map(symbols.__getitem__, toks), dtype=np.int64, count=len(toks))
            full = s.copy()
            for k in np.flatnonzero(s < 0):  # in a block a literal counts as what it is
                full[k] = xxhash.xxh64_intdigest(toks[k].encode("utf-8", "replace")) & MASK | 1
            said = []
            for k in np.flatnonzero(s == 0) if kind in SLASHED else [k for k, t in enumerate(toks) if t[0] == "#" or t.startswith(('"""', "'''"))]:
                said.append(1)  # where a comment begins
                said += map(names.__getitem__, LETTERS.findall(toks[k].lower()))
            *folders, last = path.lower().split("/")
            parts.append(s[s != 0])
            exact.append(full[s != 0])
            words.append(np.array(said, dtype=np.int64))
            paths.append(np.array([names["/" + x] for x in folders] + [names[last]], dtype=np.int64))
            self.rows.append((kind, toks, text))
        self.n = len(self.rows)
        self.sym, self.doc = self._flat(parts)
        self.exact, _ = self._flat(exact)
        self.words, self.word_doc = self._flat(words)
        self.paths, self.path_doc = self._flat(paths)

    def _flat(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64), np.repeat(np.arange(self.n), [len(x) for x in parts])

    def rules(self) -> tuple[np.ndarray, np.ndarray]:
        """Short rules of the path, the comments and the code, as ``(rule, file)``."""
        got = [short_rules(self.paths, self.path_doc, 1, 2), short_rules(self.words, self.word_doc, 2, 3), short_rules(self.sym, self.doc, 3, 2)]
        return np.concatenate([r for r, _ in got]), np.concatenate([d for _, d in got])


def weak_labels(path: str, kind: str, text: str) -> tuple[bool, ...]:
    """By pattern: what a file says of its origin, the directory it is kept in, the name of a lock file, the head of compiled output."""
    return path.rpartition("/")[2].lower() in LOCKS, bool(ABROAD.search(path) or FOREIGN.search(text)), bool(GENERATED.search(text)), kind in SCRIPTS and bool(COMPILED.search(text))


class Origins:
    """What rules tell of the origin of files: their names in order, and a weight a kind; the last row of weights is the constant."""

    def __init__(self, rule: np.ndarray, weight: np.ndarray):
        self.rule, self.weight = rule, weight

    def kinds(self, rule: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Log odds of each kind for ``n`` files with these rules."""
        z = np.tile(self.weight[-1], (n, 1))
        if len(self.rule):
            at = np.searchsorted(self.rule, rule).clip(0, len(self.rule) - 1)
            hit = np.unique(np.c_[doc, at][self.rule[at] == rule], axis=0)
            for k in range(len(KINDS)):
                z[:, k] += np.bincount(hit[:, 0], weights=self.weight[hit[:, 1], k], minlength=n)
        return z

    @classmethod
    def fit(cls, rule: np.ndarray, files: list[np.ndarray], y: np.ndarray, steps: int = 300, l2: float = 3e-5) -> Origins:
        """``files``: for each file the numbers of its rules; ``y``: its labels. Only rules that tell something are used."""
        of = np.repeat(np.arange(len(files)), [len(f) for f in files])
        col = np.concatenate(files).astype(np.int64) if files else np.zeros(0, dtype=np.int64)
        some = y.any(axis=1)
        n, pos = np.bincount(col, minlength=len(rule)), np.bincount(col, weights=some[of], minlength=len(rule))
        tells = (pos >= FILES) & (pos >= TELLING * n)
        new = np.cumsum(tells) - 1
        of, col = of[tells[col]], new[col[tells[col]]]
        rule = rule[tells]
        w = np.zeros((len(rule) + 1, len(KINDS)))
        for k in range(len(KINDS)):
            v, past = np.zeros(len(rule) + 1), np.full(len(rule) + 1, 1e-8)
            for _ in range(steps):
                z = np.bincount(of, weights=v[col], minlength=len(files)) + v[-1]
                e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[:, k]
                g = np.r_[np.bincount(col, weights=e[of], minlength=len(rule)), e.sum()] / max(1, len(files)) + l2 * v
                past += g * g
                v -= g / np.sqrt(past)
            w[:, k] = v
        return cls(rule, w)


def learn(files: DataFrame, sample: int = SAMPLE) -> Origins:
    """The weights of short rules, from a sample of files. At most ``RULES`` rules, and their numbers in those files, reach the driver."""
    rows = usable(files).withColumn("_h", F.shiftrightunsigned(F.xxhash64("file_id"), 1))
    # Hashes are even over 0..2^63, so about ``sample`` files lie below this.
    below = min(1.0, sample / max(1, files.count())) * (2**63 - 1)  # a count of rows reads no contents

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbols, names = Symbols(), Names()
        for b in batches:
            t = Tokens(b, symbols, names)
            rule, doc = t.rules()
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(t.n + 1))
            yield pd.DataFrame(
                {
                    "root": [xxhash.xxh64_intdigest((r or "").encode()) >> 1 for r in b["root"]],
                    "y": [sum(v << i for i, v in enumerate(weak_labels(p or "", k, x))) for p, (k, _, x) in zip(b["rel_path"], t.rows, strict=True)],
                    "rules": [np.unique(rule[order[i:j]]) for i, j in zip(cut[:-1], cut[1:], strict=True)],
                }
            )

    seen = materialise(map_batches(rows.where(F.col("_h") <= F.lit(min(int(below), 2**63 - 1))), look, "root long, y int, rules array<long>"), "rule-sample")
    named = seen.where("y > 0").select("root", F.explode("rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("a"), F.max("root").alias("b"))
    given = pd.DataFrame({"rel_path": [p for _, p, _ in EXAMPLES], "ext": None, "content": [t for _, _, t in EXAMPLES]})
    t = Tokens(given, Symbols(), Names())
    own_rule, own_doc = t.rules()
    several = {r.rule for r in named.where(F.col("a") != F.col("b")).where(F.col("n") >= FILES).orderBy(F.desc("n"), "rule").limit(RULES).collect()}
    rule = np.array(sorted(several | set(own_rule.tolist())), dtype=np.int64)
    shared = files.sparkSession.sparkContext.broadcast(rule)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            got = []
            for r in b["rules"]:
                at = np.searchsorted(known, r).clip(0, max(0, len(known) - 1))
                got.append(at[known[at] == r].astype(np.int32).tobytes())
            yield pd.DataFrame({"y": b["y"], "at": got})

    sampled = map_batches(seen.select("y", "rules"), number, "y int, at binary").collect()
    own = [np.unique(np.searchsorted(rule, own_rule[own_doc == i])) for i in range(t.n)]
    held = [np.frombuffer(r.at, dtype=np.int32) for r in sampled] + own * COPIES
    y = [[r.y >> k & 1 for k in range(len(KINDS))] for r in sampled] + [[k in kinds for k in range(len(KINDS))] for kinds, _, _ in EXAMPLES] * COPIES
    return Origins.fit(rule, held, np.array(y, dtype=float))


STATS = (
    "file_id long, root string, tokens long, left_over long, values long, literal_ratio double, encoded double, reuse double, serial int, long_lines double, "
    "told string, long_rules array<struct<rule:long,tokens:int,block:boolean>>"
)
COLUMNS = [c.split()[0] for c in STATS.split(", ")]


def inspect(b: pd.DataFrame, symbols: Symbols, names: Names, origins: Origins) -> pd.DataFrame:
    """The statistics of a batch of files."""
    t = Tokens(b, symbols, names)
    n, sym, doc = t.n, t.sym, t.doc
    serials, dense, chars_of = [], [], []
    for kind, toks, text in t.rows:
        serials.append(serial({x for x in set(toks) if x[0].isalpha() or x[0] == "_"}))
        blank = 1 - (text.count(" ") + text.count("\t")) / max(1, len(text)) * 10
        dense.append(sum(len(x) for x in text.split("\n") if len(x) >= LINE) / max(1, len(text)) if kind in SCRIPTS and blank > 0 else 0.0)
        chars_of.append(len(text) - text.count(" ") - text.count("\n"))
    z = origins.kinds(*t.rules(), n)
    literal = sym < 0
    values = np.bincount(doc[literal], minlength=n)
    chars = np.bincount(doc[literal], weights=-sym[literal], minlength=n)
    left, where, size = repair(sym, doc)
    rest = np.bincount(where, minlength=n)
    long_rules: list[list[dict]] = [[] for _ in range(n)]
    rule = np.flatnonzero(size > 1)
    reuse = np.zeros(n)
    if len(rule):
        order = rule[np.lexsort((left[rule], where[rule]))]
        first = np.flatnonzero(np.r_[True, (left[order][1:] != left[order][:-1]) | (where[order][1:] != where[order][:-1])])
        uses = np.diff(np.r_[first, len(order)])
        often = (uses >= 4) & (size[order[first]] >= 4)
        np.add.at(reuse, where[order[first]][often], (uses * size[order[first]])[often])
        for k in np.flatnonzero(size[order[first]] >= LONG):
            o = order[first[k]]
            long_rules[where[o]].append({"rule": int(left[o]), "tokens": int(size[o]) * int(uses[k]), "block": False})
    for r, d, k in zip(*(x.tolist() for x in blocks(t.exact, doc)), strict=True):
        long_rules[d].append({"rule": r, "tokens": k, "block": True})
    tokens = np.bincount(doc, minlength=n)
    out = pd.DataFrame({"file_id": b["file_id"].to_numpy(), "root": b["root"].to_numpy(), "tokens": tokens, "left_over": rest, "values": values})
    out["literal_ratio"] = values / np.maximum(1, rest)
    out["encoded"] = chars / np.maximum(1, chars_of)
    out["reuse"] = reuse / np.maximum(1, tokens)
    out["serial"], out["long_lines"] = serials, dense
    out["told"] = [KINDS[k] if best > 0 else None for k, best in zip(z.argmax(axis=1), z.max(axis=1), strict=True)]
    out["long_rules"] = long_rules
    return out[COLUMNS]


def usable(files: DataFrame) -> DataFrame:
    return files.select("file_id", "root", "rel_path", "ext", "content").where("file_id is not null and content <> ''")


def grammar_stats(files: DataFrame, origins: Origins) -> DataFrame:
    """Statistics of the grammar of every file."""
    shared = files.sparkSession.sparkContext.broadcast(origins)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbols, names = Symbols(), Names()
        for b in batches:
            for at in range(0, len(b), 500):
                yield inspect(b.iloc[at : at + 500], symbols, names, shared.value)

    return map_batches(usable(files), run, STATS)


def shared_tokens(stats: DataFrame) -> DataFrame:
    """``file_id, shared``: tokens under long rules, or in blocks if those are more, that more than one repository has."""
    rules = stats.where("size(long_rules) > 0").select("file_id", "root", F.explode("long_rules").alias("r")).select("file_id", "root", "r.rule", "r.tokens", "r.block")
    several = rules.groupBy("rule", "root").agg(F.lit(1).alias("one")).groupBy("rule").agg(F.count("one").alias("roots")).where("roots > 1").select("rule")
    return join_small(rules, several, ["rule"], spread=F.col("file_id")).groupBy("file_id", "block").agg(F.sum("tokens").alias("shared")).groupBy("file_id").agg(F.max("shared").alias("shared"))


def judged(files: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Every file with its statistics and ``reason``, null for what is hand-written."""
    stats = materialise(grammar_stats(files, learn(files, sample)), "grammars").dropDuplicates(["file_id"])
    all_ = stats.join(shared_tokens(stats), "file_id", "left").withColumn("shared", F.coalesce("shared", F.lit(0)) / F.greatest("tokens", F.lit(1)))
    reason = (
        F.when(F.col("told").isNotNull(), F.col("told"))
        .when(F.col("long_lines") >= 0.7, "minified")
        .when(((F.col("values") >= VALUES) & (F.col("literal_ratio") >= LITERALS)) | ((F.col("encoded") >= ENCODED) & (F.col("left_over") < 40)), "data")
        .when((F.col("serial") >= SERIAL) & (F.col("reuse") >= REUSE), "generated")
        .when(F.col("shared") >= SHARED, "shared by repositories")
    )
    return all_.withColumn("reason", reason).drop("long_rules")
