"""Credentials embedded in source code: find the lines on which they start and redact them.

Candidate literals come from whole texts by shape: values with the form of a known token, logins in URLs, private key blocks,
values on lines that speak of a secret, and quoted runs of characters with a digit among them. A logistic regression decides on
every one of them. Its features are the likelihood of the value's characters under a first-order Markov model of all texts, shares
of characters, and hashed pieces of the surrounding identifiers, of the text right at the value, of the value itself and of the
path; none of them is a pattern that labels. Patterns only label candidates weakly, and leave open what they are not sure of; the
regression is trained on a sample of the labelled ones and calibrated on a held-out part to the share of credentials among all.
Literals whose calibrated score reaches ``threshold`` go on to an exact check that drops what cannot work as written (placeholders
and look-ups); redaction replaces their characters only.

The Markov counts cover all rows. Labelled candidates for the fit are a sample bounded by ``sample`` rows a label, those of the
smallest hash, beside a few fixed examples, so the method is the same for every number of rows. The collected counts are bounded by
the alphabet (97 x 97 classes).

Defined results
* a null content or id gives no row, an empty content none; a null path counts as a path of no known kind;
* repeated rows give one result row; texts and values of any length are read whole;
* an empty table gives no rows; in a table without labelled candidates the fixed examples alone train the regression;
* extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import functools
import math
import re
import zlib
from collections import Counter, namedtuple
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.session import map_batches, materialise

SAMPLE = 5_000
THRESHOLD = 0.5
#: Slots of the hashed features.
SLOTS = 1_024
ALPHABET = 97  # printable ASCII, one class for white space and one for the rest

# Public formats of issued tokens.
FORMATS = re.compile(
    r"(?<![A-Za-z0-9_])(?:A(?:KIA|SIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w\-]{16,}|xox[abeoprs]-[0-9A-Za-z\-]{16,}"
    r"|[sr]k_(?:live|test)_[0-9A-Za-z]{16,}|sk-(?:ant-|proj-)?[\w\-]{20,}|AIza[\w\-]{30,}|npm_[A-Za-z0-9]{30,}|pypi-[\w\-]{20,}|SG\.[\w\-]{10,}\.[\w\-]{20,}"
    r"|hf_[A-Za-z0-9]{20,}|dop_v1_[0-9a-f]{40,}|ya29\.[\w\-]{20,}|eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{16,})"
)
URL = re.compile(r"\b[a-z][a-z0-9+.\-]{1,20}://([^\s:/@'\"<>`]*):([^\s/@'\"<>`]{3,})@(?=[\w\[$])", re.I)
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
# Words of identifiers that hold secrets, and the fragments that one of them has to contain.
NAMED = re.compile(
    r"(?:(?<!com)(?<!by)(?<!tres)pass(?:w(?:or)?d|phrase|code|wd|w)?s?(?![a-z]*(?:ed|ing|age|ive|ion|enger|port)\b)|pwd|pin[_\-]?code|secret|token|bearer|credential|authoriz|auth[_\-]?(?:header|key)|signer(?![a-z])|hmac|identified by"
    r"|(?:api|access|account|deploy|private|priv|sign(?:ing)?|encrypt(?:ion)?|master|tls|ssl|ssh|service|client|shared|auth|secret|storage|license|webhook|crypto|admin|root|session|jwt|aes|rsa|db)[_\-. ]?key)",
    re.I,
)
FRAGMENTS = ("pass", "pwd", "pin", "secret", "token", "bearer", "credential", "auth", "signer", "hmac", "identified by", "key", "login", "log in", "account", "creds", "username")
ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "sk_", "rk_", "sk-", "AIza", "npm_", "pypi-", "SG.", "hf_", "dop_v1_", "ya29.", "eyJ")
# Type names and wrappers that may stand between an identifier and its value.
BETWEEN = frozenset("str String string char const static final let var byte bytes u8 static_str b64decode b64 atob decode from_base64 frombase64 Buffer from base64 SecretStr Some new f r b u rb Text by with is to in use was now set value".split())
# Words that make it the name of something else.
OTHER = re.compile(
    r"hint|field|label|title|header_?name|prompt|message|placeholder|pub(?:lic)?[_\-]?key|verify|cert|bundle|cache[_\-]?key|digest|hash|checksum|sha\d*|fingerprint|commit|revision|request|trace|etag|integrity"
    r"|param|column|type|length|size|limit|count|ttl|expir|policy|rule|regex|pattern|path|file|dir(?![a-z])|_ref(?![a-z])|env(?![a-z])|_id(?![a-z])|_?name(?![a-z])|url_?path|uuid|version",
    re.I,
)
HOLLOW = re.compile(
    r"^(?:(.)\1{3,}.*|.*x{6,}.*|.*\*{4,}.*|.*\.{3,}.*|<.*>|\[.*\]|\{.*\}|\$.*|%.*%?|@\w+@|.*\$\{.*|.*\$\(.*|.*\{\{.*|(?:your|my|the|some|insert|enter|put|replace|change|example|sample|dummy|fake|test|todo|fixme|redacted|removed|hidden|secret|none|null|nil|undefined|true|false|default|required|optional|unset|empty|string|value|password|passwd|token|placeholder)(?:[-_. ]?(?:your|my|the|here|api|key|token|secret|password|passwd|pass|me|this|with|real|value|goes|in|change|example|placeholder|only|user|access|client|auth|string|it|now|later))*"
    r"|.*(?:replace[-_ ]?me|change[-_ ]?me|placeholder|your[-_ ]|-here$|_here$|example[-_]?key|not[-_]?(?:a[-_]?)?real|redacted).*)$",
    re.I,
)
# Ways a program reads a secret from elsewhere.
STORE = re.compile(r"environ|getenv|process\.env|env\.|\bENV\[|vault|keyring|keychain|secretsmanager|secret_?manager|ssm[:/]|secrets\.|\$\{|\bENC\[|arn:aws|valueFrom|secretKeyRef|fromEnv|import\.meta", re.I)
LITERAL = re.compile(r"(\"\"\"|'''|[\"'`])((?:\\.|(?!\1).)*?)\1")
BARE = re.compile(r"(?:^|[\s{,;])(?:export\s+|set\s+|-\s+)?[\"']?([\w.\-]+)[\"']?\s*(=|:)\s*([^\s\"'`#][^\s\"'`]*)\s*(?:#.*|;)?$")
SAID = re.compile(r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|key|credential|login|bearer)s?\b[\"'`]?\s*(?:(?:was|is|are|to|be|now|still|used|set|for|it|=|:)\s+|[:=]\s*)+[\"'`]?([^\s\"'`,;]{6,})", re.I)
LOGIN = re.compile(r"\b(?:log ?in|user(?:name)?|account|credentials?|creds?)\s*(?:is|was|are|:|=|with|as)?\s*[\w.@\-]+\s*(?:/|:|with password|, ?password|and password)\s*[\"'`]?([^\s\"'`,;]{6,})", re.I)
CURL = re.compile(r"\s(?:-u|--user|--proxy-user)[ =]?[\"']?[\w.@\-]+:([^\s\"'@]{4,})")
AUTH = re.compile(r"\b(?:Bearer|Basic|Token)\s+([\w\-.+/=~]{12,})")
INLINE = re.compile(r"(?:^|[;?&\s,])([\w.\-]+)\s*=\s*([^;&\s\"'`,]{4,})")
IDENT = re.compile(r"[A-Za-z_][\w\-]*")
GENERIC = re.compile(r"[\"'`](?=[^\"'`]*\d)([A-Za-z0-9+/_\-=.!@#$%^&*~]{16,})[\"'`]")
SPLIT = re.compile(r"([\"'`])([\w\-+/=.:]{3,})\1(?=\s*(?:\+|\.\.|\\)?\s*[\"'`][\w\-+/=.])")
NEXT = re.compile(r"\s*(?:\+|\.\.|\\|&)?\s*(?:\\\n\s*)?([\"'`])((?:\\.|(?!\1)[^\n])*?)\1")
CHAR_CLASS = bytes(0 if i <= 32 else 96 if i >= 127 else i - 32 for i in range(256))
COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|--|;|<!--|\"\"\")|\s(?://|#)\s")
CODE_EXT = {"go", "py", "js", "ts", "java", "rs", "c", "sh", "sql"}
CONF_EXT = {"env", "yaml", "yml", "toml", "json", "ini", "cfg", "properties", "conf"}


def classes(text: str) -> np.ndarray:
    """Markov classes of the characters of ``text``."""
    return np.frombuffer(text.encode("latin-1", "replace").translate(CHAR_CLASS), dtype=np.uint8)


def _inner(value: str) -> str | None:
    """All that a base64 text holds, a character a byte, if its start is printable."""
    if len(value) < 12 or not re.fullmatch(r"[A-Za-z0-9+/_\-]+={0,2}", value):
        return None
    plain = value.replace("-", "+").replace("_", "/").rstrip("=")
    try:
        raw = base64.b64decode(plain + "=" * (-len(plain) % 4))
    except (binascii.Error, ValueError):
        return None
    return raw.decode("latin-1") if re.match(rb"(?:\xef\xbb\xbf)?[\x20-\x7e\t\r\n]{8}", raw) else None


def speaks(inner: str | None) -> bool:
    """A decoded text that holds an issued token, a URL with a login, a private key or a line ``user:password``."""
    return bool(inner) and bool(FORMATS.search(inner) or URL.search(inner) or PEM.search(inner) or any(re.fullmatch(r"[A-Za-z][\w.\-]{2,}:[^\s:]{6,}", x, re.A) for x in re.split(r"[^\x20-\x7e]+", inner)))


def _line(text: str, at: int) -> tuple[int, int]:
    a = text.rfind("\n", 0, at) + 1
    b = text.find("\n", at)
    return a, len(text) if b < 0 else b


def _joined(text: str, end: int) -> tuple[str, list[tuple[int, int]]]:
    """Literals that follow the one ending at ``end`` and are put together with it, with their spans."""
    more, spans = "", []
    while m := NEXT.match(text, end):
        if m.start(1) == end:
            break
        more += m[2]
        spans.append(m.span(2))
        end = m.end()
    return more, spans


def _named_lines(text: str) -> list[tuple[int, int]]:
    """Lines with a word that may speak of a secret; fixed fragments are searched for before any pattern is tried."""
    low, lines = text.lower(), {}
    if len(low) != len(text):  # some letters change length
        low = text
    for f in FRAGMENTS:
        at = low.find(f)
        while at >= 0:
            a, b = _line(text, at)
            lines[a] = b
            at = low.find(f, b)
    for a, b in ((a, b) for m in AUTH.finditer(text) for a, b in (_line(text, m.start()),)) if "Basic " in text else ():
        lines[a] = b
    return [(a, b) for a, b in sorted(lines.items()) if NAMED.search(text, a, b) or AUTH.search(text, a, b) or LOGIN.search(text, a, b)]


def candidates(text: str) -> list[tuple[str, str, str, list[tuple[int, int]]]]:
    """``(kind, text before, value, spans)`` of every literal that could be a credential; the first span is where it starts."""
    out: dict[int, tuple[str, str, str, list[tuple[int, int]]]] = {}
    held: list[tuple[int, int]] = []

    def free(at: int, end: int) -> bool:
        return not any(a < end and at < b for a, b in held)

    def add(kind: str, value: str, spans: list[tuple[int, int]], start: int | None = None) -> None:
        at = spans[0][0]
        start = at if start is None else start
        out[at] = (kind, text[max(text.rfind("\n", 0, start) + 1, start - 80) : start], value, spans)
        held.extend(spans)

    if "PRIVATE KEY" in text:
        for m in PEM.finditer(text):
            e = PEM_END.search(text, m.end())
            nxt = PEM.search(text, m.end())
            body = e.start() if e and not (nxt and nxt.start() < e.start()) else None
            if body is None:  # cut off: its base64 lines so far
                body = re.compile(r"(?:[A-Za-z0-9+/=]|\s|\\n|[#*/]\s)*").match(text, m.end()).end()
                stop = body
            else:
                stop = e.end()
            add("pem", text[m.end() : body], [(m.start(), stop)])
    if "://" in text and "@" in text:
        for m in URL.finditer(text):
            if free(*m.span(2)):
                add("url", m[2], [m.span(2)], m.start())
    if any(p in text for p in ISSUED):
        for m in FORMATS.finditer(text):
            if free(*m.span()):
                add("format", m[0], [m.span()])
    if "-u" in text:
        for m in CURL.finditer(text):
            if free(*m.span(1)):
                add("url", m[1], [m.span(1)], m.start())
    for m in SPLIT.finditer(text):
        if free(*m.span(2)):
            more, spans = _joined(text, m.end())
            whole = m[2] + more
            if spans and (FORMATS.fullmatch(whole) or URL.search(whole) or speaks(_inner(whole))):
                add("format", whole, [m.span(2), *spans])
    for a, b in _named_lines(text):
        seen = False
        for m in LITERAL.finditer(text, a, b):
            value, (at, end) = m[2], m.span(2)
            seen |= at in out
            if len(value) < 4 or "-----BEGIN" in value or not free(at, end):
                continue
            after = text[m.end() : min(b, m.end() + 12)].lstrip()
            if after[:1] == ":" or after[:2] == "=>" or re.match(r"[\])}\s]*=(?!=)", after):
                continue  # a key
            more, spans = _joined(text, m.end())
            spans = [(at, end), *spans]
            if (auth := AUTH.search(value)) and not more:
                add("auth", auth[1], [(at + auth.start(1), at + auth.end(1))], m.start())
                seen = True
                continue
            elif "=" in value and (pair := next((x for x in INLINE.finditer(value) if NAMED.search(x[1])), None)):
                add("named", pair[2], [(at + pair.start(2), at + pair.end(2))])
                seen = True
                continue
            elif " " in value.strip():
                continue
            add("named", value + more, spans, m.start())
            seen = True
        if not seen:
            line = text[a:b].rstrip("\r")
            if m := BARE.search(line):
                if len(m[3]) >= 4 and not re.search(r"[()]|^[A-Za-z_$][\w$.]*[;,]$", m[3]) and free(a + m.start(3), a + m.end(3)):
                    add("named", m[3], [(a + m.start(3), a + m.end(3))])
            elif COMMENT.search(line) and (m := LOGIN.search(line) or SAID.search(line)) and free(a + m.start(1), a + m.end(1)):
                add("login" if m.re is LOGIN else "said", m[1], [(a + m.start(1), a + m.end(1))])
    for m in GENERIC.finditer(text):
        if free(*m.span(1)):
            add("generic", m[1], [m.span(1)], m.start())
    return [v for _, v in sorted(out.items())]


def name_of(before: str) -> str:
    """The identifier that a value belongs to: the nearest one before it that is no type or wrapper."""
    for m in reversed(list(IDENT.finditer(before))[-5:]):
        if m[0] not in BETWEEN:
            gap = before[m.end() :]
            return m[0] if len(gap) <= 30 and gap.count(",") <= 1 and not re.search(r"[;{]|\d\s*,", gap) else ""
    return "password" if re.search(r"identified\s+by\s*[\"'`]?$", before, re.I) else ""


def about(name: str) -> bool:
    """Names something about a secret (a hint, a field, a file), not the secret: such a word follows the one for it."""
    tail = name
    for m in NAMED.finditer(name):
        tail = name[m.end() :]
    return bool(OTHER.search(tail))


def hollow(value: str) -> bool:
    v = value.strip()
    return bool(HOLLOW.match(v)) or len(set(v)) <= 2


def wordy(value: str) -> bool:
    """Made of words and names only, as labels, header names, paths, struct tags and messages in other scripts are."""
    if FORMATS.fullmatch(value):
        return False
    if sum(ord(c) > 127 for c in value) * 2 > len(value):
        return True
    value = value.strip("=/:. ,;")
    return bool(re.match(r"\w+:\"", value)) or bool(re.fullmatch(r"(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)(?:[-_./: ](?:[a-z]+|[A-Z]+|[A-Z][a-z]+))*", value)) or bool(re.fullmatch(r"[a-z]+(?:[A-Z][a-z]+)*\d?", value))


def weak_label(kind: str, before: str, value: str) -> int:
    """1: surely a credential by pattern, 0: surely none, -1: left open. Labels train the regression; no result is read off them."""
    name = name_of(before)
    if kind == "pem":
        return int(len(re.sub(r"\\n|[^A-Za-z0-9+/]", "", value)) >= 40)
    if hollow(value) or STORE.search(value) or (STORE.search(before[-40:]) and not re.search(r"[,|:]\s*-?[\"'`]?$", before)):
        return 0
    if kind in ("url", "format"):
        return 1
    if kind == "generic":
        return -1 if speaks(_inner(value)) else 0
    if about(name) or wordy(value) or re.fullmatch(r"[\d.,;:]+|\w*<.*>[,;]?|(?:\[\])?\w*[\[{(]+", value):
        return 0
    if speaks(_inner(value)):
        return 1
    mixed = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", r"\d", r"[^\w]"))
    if kind == "auth":
        return -1
    if kind in ("said", "login"):
        return 1 if mixed >= 3 else -1
    if not NAMED.search(name):
        return 0
    if re.fullmatch(r"[a-z]+[-_.]?\d{1,4}", value):
        return -1 if re.search(r"pass|pwd", name, re.I) else 0
    return 1 if len(value) >= 8 and mixed >= 2 else -1


# Fixed examples that are always among the labelled candidates: ``(label, text)``.
EXAMPLES = (
    (1, 'db_password = "Tr0ub4dor-and-3"'), (1, "export API_KEY=q8Zr4kT1mW7xB2nL"), (1, 'auth_token: "uhkbvI3pF8U2YzVVMGM6jBux"'), (1, 'secret = "x9$Lq2vT!m4K"'),
    (1, "dsn = 'postgres://svc:Xk29sLq1vv@db.local:5432/x'"), (1, 'client_secret = "9fK2mQ7xR4tV1bN8"'), (1, 'item = "ghp_' + "aB3dE6gH9j" * 4 + '"'), (1, '"signing_key": "kP4wZ8sD1fG6hJ3l"'),
    (0, 'password = "changeme"'), (0, 'api_key = "your-api-key"'), (0, 'token = os.environ["SERVICE_TOKEN_1"]'), (0, 'token_label = "access_token"'),
    (0, 'digest = "8f57bb4c6ceb38a52856843aacce246954012e0f"'), (0, 'version_tag = "release-2024-10-01"'), (0, '"integrity": "sha512-PcV+vwjgSFZfrwgH9+7TTtDbG2KGo2jm"'), (0, 'password_hint = "at-least-12-characters"'),
)
PIECES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
KEPT = 200_000


def pieces(text: str) -> list[str]:
    """Words of an identifier or a text, in lower case, in either way of writing them together."""
    return [x.lower() for x in PIECES.findall(text)]


def shape(text: str) -> str:
    """``text`` with runs of digits, of capitals and of small letters as one character each."""
    return re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"\d+", "0", text)))


class Slots(dict):
    """Slot of a feature, negative if it counts against its slot; filled as features come, bounded."""

    def __missing__(self, feature: str) -> int:
        h = zlib.crc32(feature.encode("utf-8", "replace"))
        slot = 1 + h % SLOTS
        slot = slot if h >> 20 & 1 else -slot
        if len(self) < KEPT:
            self[feature] = slot
        return slot


_slots = Slots()
_CASE = str.maketrans({**{chr(c): "l" for c in range(97, 123)}, **{chr(c): "U" for c in range(65, 91)}, **{chr(c): "0" for c in range(48, 58)}})
DENSE = 13
WORDS = 12


@functools.lru_cache(50_000)
def _of_name(name: str) -> tuple[int, ...]:
    low = "^" + re.sub(r"[^a-z]+", "_", name.lower()) + "$"
    words = pieces(name)
    return tuple(_slots["n:" + low[i : i + 4]] for i in range(max(1, len(low) - 3))) + ((_slots["p:" + " ".join(words[-2:])],) if words else ())


@functools.lru_cache(20_000)
def _of_path(path: str) -> tuple[int, ...]:
    low = path.lower()
    return (_slots["f:" + low.rpartition(".")[2]], *(_slots["d:" + x] for x in low.split("/")[:-1]))


def _of_words(words: list[str]) -> list[int]:
    """Slots of the words a value is made of; of one of over ``WORDS`` that it has so many, as random characters have."""
    said = {w.lower() for w in words if len(w) > 2 and not w.isdigit()}
    return [_slots["v:" + w] for w in sorted(said)] if len(said) <= WORDS else [_slots["v:"]]


def described(before: str, value: str, path: str, text: str, spans: list[tuple[int, int]]) -> tuple[list[float], list[int]]:
    """Features of a candidate but for its likelihood: shares and sizes, and slots of the hashed ones."""
    n, (at, end) = max(1, len(value)), spans[0]
    inner = _inner(value)
    # A key block shows what it is in its first line; its body is measured as a value.
    lead = text[at : text.find("\n", at) if "\n" in text[at:end] else end].strip() if text.startswith("-----", at) else value
    kinds = value.translate(_CASE)
    small, large, digits, wide = kinds.count("l"), kinds.count("U"), kinds.count("0"), 0 if value.isascii() else sum(c > "\x7f" for c in value)
    times = Counter(value).values()
    words = PIECES.findall(value)
    bare = bool(re.fullmatch(r"[0-9a-fA-F]+", value))
    dense = [
        min(n, 60) / 30.0, math.log(n), small / n, digits / n, large / n, (n - small - large - digits) / n, wide / n, math.log2(n) - sum(t * math.log2(t) for t in times) / n, len(times) / n,
        len(words) / n, float(bare), float(" " in value), float(inner is not None),
    ]
    plain, words = shape(lead), words if lead is value else PIECES.findall(lead)
    close = text[max(0, at - 6) : at]
    hashed = [
        *_of_name(name_of(before)),
        *_of_path(path),
        *(_slots["b:" + x] for x in pieces(before)[-6:]),
        _slots["g:" + re.sub(r"\w+", "w", before[-6:])],
        _slots["c:" + shape(close)[-3:]],
        _slots["z:" + text[end : end + 1]],
        _slots["x:" + text[at : at + 4]],
        _slots["y:" + text[at : at + 8]],
        _slots[f"q:{small > 0}{large > 0}{digits > 0}{small + large + digits < n}{len(lead).bit_length()}{lead is value}"],
        *_of_words(words if inner is None else PIECES.findall(inner)),
        _slots["s:" + plain[:6]],
        _slots["e:" + plain[-4:]],
        _slots[f"h:{n}" if bare else "h:"],
    ]
    if inner is not None:
        hashed.append(_slots["i:" + shape(inner)[:10]])
    return dense, hashed


Row = namedtuple("Row", "dense hashed pairs times")


def row_of(before: str, value: str, path: str, text: str, spans: list[tuple[int, int]]) -> Row:
    """All the score needs of a candidate, whatever its length: features, and character pairs with their counts."""
    c = classes(value)
    k = c[:-1].astype(np.int16) * ALPHABET + c[1:]
    if len(k) > 256:
        n = np.bincount(k, minlength=ALPHABET * ALPHABET)
        k = np.flatnonzero(n)
        return Row(*described(before, value, path, text, spans), k.tolist(), n[k].tolist())
    return Row(*described(before, value, path, text, spans), k.tolist(), [])


def solve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 30, l2: float = 3e-5) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    w, weight = np.zeros(x.shape[1]), weight / weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + l2 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-4:
            break
    return w


class Model:
    """Markov table, weights and calibration; a few hundred kB, the same for every input size."""

    def __init__(self, counts: np.ndarray, rows: list[Row], y: list[int], total: tuple[int, int] | None = None):
        """``total``: number of candidates labelled 0 and 1 of which ``rows`` are a sample."""
        c = counts + 0.5
        self.logp = np.log(c / c.sum(axis=1, keepdims=True)).ravel()
        self.mean, self.scale = np.zeros(DENSE + 1), np.ones(DENSE + 1)
        total = total or (len(y) - sum(y), sum(y))
        rows, y = [*rows, *(r for r, _ in examples())], np.array([*y, *(k for _, k in examples())], dtype=float)
        x, few = self.measures(rows), np.array([max(1.0, (y == k).sum()) for k in (0, 1)])
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = np.c_[np.ones(len(rows)), (x - self.mean) / self.scale, self.spread(rows)]
        place = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0))
        held = place % 4 == 0
        self.w = solve(x[~held], y[~held], np.where(y == 1, np.sqrt(few[0] / few[1]), 1.0)[~held])
        share = (np.array(total) + few - np.maximum(0, few - sum(k == 1 for _, k in examples()))) / few
        a, b = solve(np.c_[x[held] @ self.w, np.ones(held.sum())], y[held], share[y[held].astype(int)], l2=1e-4)  # Platt scaling on what the weights have not seen
        self.cal = (float(a), float(b))

    def measures(self, rows: list[Row]) -> np.ndarray:
        """Likelihood, the mean log probability of the characters of a value, each given the one before, and the other shares."""
        n = np.array([len(r.pairs) for r in rows])
        flat = self.logp[np.concatenate([np.asarray(r.pairs, dtype=np.int64) for r in rows])] if n.sum() else np.zeros(0)
        times = np.concatenate([np.asarray(r.times, dtype=float) if len(r.times) else np.ones(k) for r, k in zip(rows, n, strict=True)])
        of = np.repeat(np.arange(len(rows)), n)
        sums, weight = np.bincount(of, weights=flat * times, minlength=len(rows)), np.bincount(of, weights=times, minlength=len(rows))
        return np.c_[np.where(weight > 0, sums / np.maximum(1, weight), self.logp.mean()), np.array([list(r.dense) for r in rows])]

    def spread(self, rows: list[Row]) -> np.ndarray:
        out = np.zeros((len(rows), SLOTS))
        for i, r in enumerate(rows):
            h = np.asarray(r.hashed)
            np.add.at(out[i], np.abs(h) - 1, np.sign(h))
        return out

    def scores(self, rows: list[Row]) -> np.ndarray:
        """Calibrated probabilities."""
        if not rows:
            return np.zeros(0)
        head = 2 + DENSE
        z = self.w[0] + ((self.measures(rows) - self.mean) / self.scale) @ self.w[1:head]
        n = np.array([len(r.hashed) for r in rows])
        h = np.concatenate([np.asarray(r.hashed, dtype=np.int64) for r in rows])
        z += np.bincount(np.repeat(np.arange(len(rows)), n), weights=self.w[head:][np.abs(h) - 1] * np.sign(h), minlength=len(rows))
        return 1 / (1 + np.exp(-np.clip(self.cal[0] * z + self.cal[1], -30, 30)))


@functools.cache
def examples() -> list[tuple[Row, int]]:
    """The fixed examples as labelled rows."""
    return [(row_of(before, value, "", text, spans), y) for y, text in EXAMPLES for _, before, value, spans in candidates(text)[:1]]


def works(before: str, value: str) -> bool:
    """The exact check: a placeholder or a look-up elsewhere cannot work as written, whatever its score."""
    return not hollow(value) and not STORE.search(value) and (not STORE.search(before[-40:]) or bool(re.search(r"[,|:]\s*-?[\"'`]?$", before)))


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with the characters of ``spans`` replaced; quotes, line breaks, indentation and all else stay."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a < at:
            continue
        out.append(text[at:a])
        out.append("\n".join(re.sub(r"^(\s*(?:(?://|#|\*|--)\s?)?)\S.*?(\r?)$", r"\1REDACTED\2", part, flags=re.S) if k else ("REDACTED\r" if part.endswith("\r") else "REDACTED") for k, part in enumerate(text[a:b].split("\n"))))
        at = b
    return "".join(out) + text[at:]


STATS = "y int, n long, id string, line_no int, kind string, works boolean, h long, dense array<float>, hashed array<int>, pairs array<int>, times array<long>"
COLUMNS = [c.split()[0] for c in STATS.split(", ")]
COUNTS = 8


def survey(rows: DataFrame) -> DataFrame:
    """One pass over all texts, written to the shared folder: a row for every candidate, with its weak label (0, 1, or -1 if open).

    Rows with ``y = COUNTS`` are the character pair counts of a task.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(ALPHABET * ALPHABET, dtype=np.int64)
        for b in batches:
            found = []
            for key, path, text in zip(b["id"], b["rel_path"], b["content"], strict=True):
                c = classes(text)
                if len(c) > 1:
                    total += np.bincount(c[:-1].astype(np.int32) * ALPHABET + c[1:], minlength=ALPHABET * ALPHABET)
                line, at = 1, 0
                for kind, before, value, spans in candidates(text):
                    line, at = line + text.count("\n", at, spans[0][0]), spans[0][0]
                    h = xxhash.xxh64_intdigest(f"{kind}|{name_of(before)}|{value}".encode("utf-8", "replace")) >> 1
                    found.append((weak_label(kind, before, value), 0, key, line, kind, works(before, value), h, *row_of(before, value, path or "", text, spans)))
            yield pd.DataFrame(found, columns=COLUMNS)
        k = np.flatnonzero(total)
        yield pd.DataFrame([(COUNTS, 0, "", 0, "", False, 0, [], [], k.tolist(), total[k].tolist())], columns=COLUMNS)

    return materialise(map_batches(rows, look, STATS), "credential-survey")


def train(seen: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from a survey; what reaches the driver is bounded by the alphabet and by ``sample``."""
    counts = np.zeros(ALPHABET * ALPHABET)
    pairs = seen.where(F.col("y") == COUNTS).select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    for r in pairs.collect():
        counts[r.pair] = r.n
    total = {r.y: r.n for r in seen.where("y in (0, 1)").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    labelled = []
    for y in (0, 1):
        # Hashes are even over 0..2^63, so about 2 * sample rows lie below this; no task returns more than its part of them.
        below = min(1.0, 2 * sample / max(1, total.get(y, 0))) * (2**63 - 1)
        of = seen.where(F.col("y") == y).where(F.col("h") <= F.lit(min(int(below), 2**63 - 1)))
        once = of.groupBy("h").agg(F.min(F.struct("dense", "hashed", "pairs", "times")).alias("r")).orderBy("h").limit(sample)
        labelled += [(r.h, Row(*r.r), y) for r in once.collect()]
    labelled.sort(key=lambda x: x[0])
    return Model(counts.reshape(ALPHABET, ALPHABET), [r for _, r, _ in labelled], [y for _, _, y in labelled], (total.get(0, 0), total.get(1, 0)))


FOUND = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("y", T.IntegerType()),
    ]
)


def usable(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", "rel_path", "content").where("id is not null and content is not null and content <> ''")


def scored(seen: DataFrame, model: Model) -> DataFrame:
    """``id, line_no, kind, score, y`` of every candidate of a survey that could work as written."""
    shared = seen.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["score"] = shared.value.scores([Row(*r) for r in zip(b["dense"], b["hashed"], b["pairs"], b["times"], strict=True)])
            yield b[FOUND.names]

    return map_batches(seen.where(F.col("y") != COUNTS).where("works").select("id", "line_no", "kind", "y", "dense", "hashed", "pairs", "times"), judge, FOUND)


def find(chunks: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``id, line_no, kind, score``: one row per chunk and line on which a credential starts."""
    seen = survey(usable(chunks))
    judged = scored(seen, train(seen, sample)).where(F.col("score") >= threshold)
    return judged.groupBy("id", "line_no").agg(F.max(F.struct("score", "kind")).alias("_b")).select("id", "line_no", "_b.kind", "_b.score")


def redacted(chunks: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``id, rel_path, content, n_redacted`` of every usable chunk, credentials replaced."""
    rows = usable(chunks)
    shared = chunks.sparkSession.sparkContext.broadcast(train(survey(rows), sample))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, n = [], []
            for path, text in zip(b["rel_path"], b["content"], strict=True):
                could = [c for c in candidates(text) if works(*c[1:3])]
                ps = shared.value.scores([row_of(before, v, path or "", text, spans) for _, before, v, spans in could])
                hits = [c[3] for c, p in zip(could, ps, strict=True) if p >= threshold]
                texts.append(redact(text, [s for spans in hits for s in spans]) if hits else text)
                n.append(len(hits))
            yield pd.DataFrame({"id": b["id"], "rel_path": b["rel_path"], "content": texts, "n_redacted": n})

    return map_batches(rows, clean, "id string, rel_path string, content string, n_redacted int")
