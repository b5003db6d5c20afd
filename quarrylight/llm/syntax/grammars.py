"""Lexers and grammars of the checked languages.

Each grammar follows the published one of its language at the level of statements, declarations and expressions. Types and
patterns are taken loosely, as runs of the tokens they are made of; names, types and imports are not looked at.
"""

from __future__ import annotations

import re
from functools import cache

from quarrylight.llm.syntax.chart import Grammar, Lexer

ROUND = {"(": ")", "[": "]", "{": "}"}


#: Tables of the language that is made next, if they are there already.
_READY: list[tuple] = []


class Language:
    """A lexer, a grammar and what has to be done between them."""

    def __init__(self, pattern: str, kind, same: dict[str, str], rules: dict[str, str], bodies: dict[str, dict[str, str]], pairs: dict[str, str] | None = None, finish=None, prepare=None):
        names = pairs or ROUND
        ready = _READY.pop() if _READY else None
        tokens: dict[str, str] = dict(ready[0]) if ready else {}
        for i, n in enumerate([*names, *names.values(), "N", "ID", "NUM", "STR", "ERR"]):
            tokens.setdefault(n, chr(0xE000 + i))
        of = lambda n: tokens[n]
        self.grammar = Grammar(tokens, {of(a): of(b) for a, b in names.items()}, {of(k) if k else "": v for k, v in bodies.items()}, rules, ready and ready[1])
        self.lexer = Lexer(pattern, tokens, same, lambda t: kind(t, tokens))
        for n in same.values():
            self.lexer.char(n)
        self.finish = finish(self) if finish else lambda s: s
        self.prepare = prepare or (lambda s: s)

    def chars(self, *names: str) -> str:
        return "".join(re.escape(self.lexer.char(n)) for n in names)

    def tokens(self, text: str) -> str:
        return self.finish(self.lexer(self.prepare(text)))


def same(**groups: str) -> dict[str, str]:
    return {op: name for name, ops in groups.items() for op in ops.split()}


def words(text: str) -> frozenset[str]:
    return frozenset(text.split())


KINDS = words("N ID NUM STR ERR BIN UN SGN INC ASG TPL REGEX PRIV LIFE CMT NL W RED")


def ident_kind(tok: str, tokens: dict[str, str]):
    return (tok,) if tok in tokens and tok not in KINDS else ("ID",)


def bound(ends: str, begins: str):
    """Keep a line break only after a token of ``ends`` and, if given, before one of ``begins``."""

    def make(lang: Language):
        n = lang.chars("N")
        return n, ends, begins

    return make


# JSON ---------------------------------------------------------------------------------------------------------------------

_JSON = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|\w+|[^\s\w]|[\f\v\x85\u00a0\ufeff]'


def _json_kind(t, tokens):
    if t[0] == '"' and len(t) > 1:
        return ("STR",)
    if re.fullmatch(r"-?\d[\d.eE+-]*", t):
        return ("NUM",) if re.fullmatch(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", t) else ("ERR",)
    return ("ID",) if t in ("true", "false", "null") else None if t in "{}[],:" else ("ERR",)


def json_language() -> Language:
    rules = {"v": "STR | NUM | ID | {O} | [L]"}
    bodies = {"": {"T": "<v>"}, "{": {"O": "( STR : <v> ( , STR : <v> ) * ) ?"}, "[": {"L": "( <v> ( , <v> ) * ) ?"}}
    return Language(_JSON, _json_kind, {}, rules, bodies, {"{": "}", "[": "]"})


# JavaScript and TypeScript ------------------------------------------------------------------------------------------------

_JS = (
    r"//[^\n]*|/\*[\s\S]*?\*/|<!--[^\n]*|\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*'|`(?:\\[\s\S]|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\}|[^`\\])*`"
    r"|(?:[=(,:\[!&|?{};+\-*%<>~^\n]|\breturn\b|\btypeof\b|\bcase\b)[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*(?![\w/])"
    r"|0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?(?!\w)|#?[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*"
    r"|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|>>>|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|\n|[^\s\w]|\w+"
)
_JS_SAME = same(BIN="== != === !== <= >= && || ?? % ^ / >>> << ** += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??=", UN="! ~", SGN="+ -", INC="++ --")
_JS_CONTEXT = "async of get set static from as"


def _js_kind(t, tokens):
    h = t[0]
    if h == "\n":
        rest = t[1:].strip()
        return ("N", "REGEX") if rest else ("N",)
    if t.startswith(("//", "<!--")):
        return ()
    if t.startswith("/*"):
        return ("N",) if "\n" in t else ()
    if h in "\"'" and len(t) > 1:
        return ("STR",)
    if h == "`" and len(t) > 1:
        return ("TPL",)
    if h.isdigit() or (h == "." and len(t) > 1 and t[1].isdigit()):
        return ("NUM",) if re.fullmatch(r"0[xXbBoO][\da-fA-F_]+n?|(?:[\d_]+\.?[\d_]*|\.[\d_]+)(?:[eE][+-]?\d+)?n?", t) else ("ERR",)
    if h == "#" and len(t) > 1:
        return ("PRIV",)
    if h.isalpha() or h in "_$" or ord(h) > 127:
        m = re.match(r"(return|typeof|case)\s*/", t)
        return (m[1], "REGEX") if m else ident_kind(t, tokens)
    if len(t) > 1 and t[-1] != "=" and re.match(r"[^/\s][ \t]*/.", t) and t not in _JS_SAME:
        first = _js_kind(h, tokens)
        return ((_JS_SAME.get(h, h),) if first is None else first) + ("REGEX",)
    return None


def _js_finish(lang: Language):
    n = lang.chars("N")
    names = [w for w in lang.lexer.tokens if re.fullmatch(r"[a-z]+", w)]
    dot = lang.chars(".", "?.")
    after_dot = re.compile(f"(?<=[{dot}])[{lang.chars(*names)}]")
    enders = lang.chars("ID", "NUM", "STR", "TPL", "REGEX", "PRIV", ")", "]", "}", "INC", "return", "break", "continue", "debugger", "yield", *_JS_CONTEXT.split())
    if "type" in lang.lexer.tokens:
        enders += lang.chars("type", "'>'".strip("'"), ">>", "readonly", "declare", "namespace", "abstract", "keyof", "is", "infer", "satisfies", "module")
    stop = lang.chars("=", "*", ".", "?.", ",", ";", ":", "?", "=>", "BIN", "<", ">", ">>", "|", "&", ")", "]", "}", "(", "[", "TPL", "SGN", "in", "instanceof", "else", "catch", "finally")
    many, drop = re.compile(f"{n}{n}+"), re.compile(f"(?<![{enders}]){n}|{n}(?=[{stop}])|{n}$")
    ident = lang.lexer.char("ID")
    return lambda s: drop.sub("", many.sub(n, after_dot.sub(ident, s)))


def _js(ts: bool) -> Language:
    r = {
        "id": "ID | " + " | ".join(_JS_CONTEXT.split()) + (" | type | declare | namespace | module | abstract | readonly | keyof | is | infer | asserts | satisfies | public | private | protected | override | accessor | unique" if ts else ""),
        "name": "<id> | PRIV | if | else | for | while | do | return | function | class | extends | new | typeof | void | delete | in | instanceof | import | export | default | case | switch | break | continue | throw | try | catch | finally | const | let | var | with | yield | await | debugger"
        + (" | interface | enum | implements" if ts else ""),
        "type": "( <id> | NUM | STR | TPL | {T} | (T) | [T] | void | import (A) | . | , | < | > | >> | >>> | '|' | & | => | SGN | typeof | new | extends ) +",
        "alias": "<type> ( '?' <type> : <type> ) *",
        "types": "<type>",
        "prefix": "UN | SGN | INC | typeof | void | delete | await | yield '*' ? | new | throw" + "",
        "fn": "async ? function '*' ? <id> ? <gen> (A) <ret> {B}",
        "gen": "( < ( <type> | = ) * ) ?" if ts else "(  ) ?",
        "ret": "( : <type> ) ?" if ts else "( ) ?",
        "cls": "( abstract ) ? class <id> ? <gen> ( extends <base> ) ? ( implements <types> ) ? {C}" if ts else "class <id> ? ( extends <base> ) ? {C}",
        "clsd": "( abstract ) ? class <id> <gen> ( extends <base> ) ? ( implements <type> ) ? {C}" if ts else "class <id> ( extends <base> ) ? {C}",
        "base": "( <id> | (X) | <fnexpr> ) ( <post> ) *" + (" ( < <types> > ) ?" if ts else ""),
        "fnexpr": "function (A) {B}",
        "post": "( . | ?. ) <name> | (A) | [X] | TPL | INC | ?. (A) | ?. [X]" + (" | UN | as const | [L] | [T]" if ts else ""),
        "prim": "<id> | NUM | STR | TPL | REGEX | (X) | [L] | {O} | <fn> | <clsx> | import (A) | import . ID | new . ID | PRIV in <id> | yield" + (" | (A) | {T} | [T] | void" if ts else ""),
        "clsx": "<cls>",
        "arrow": "async ? ( <id> | (A) ) =>" if not ts else "async ? <gen> ( <id> | (A) <ret> ) =>",
        "unit": "( <arrow> | <prefix> ) * <prim> ( <post> ) * | ( <arrow> | <prefix> ) * <arrow> {B}",
        "bin": "BIN | SGN | '*' | < | > | >> | '|' | & | = | in | instanceof" + (" | as | satisfies" if ts else ""),
        "seq": "<unit> ( <bin> <unit> ) *",
        "asg": "<seq> ( '?' <seq> ( '?' <seq> : <seq> ) * : <seq> ) *",
        "e": "<asg> ( , <asg> ) *",
        "key": "<name> | STR | NUM | [X]",
        "prop": "... <asg> | <key> ( : <asg> ) ? | <id> = <asg> | ( async | get | set | '*' ) * <key> <gen> (A) <ret> {B}",
        "mods": "( static | async | get | set | '*' | @ <id> ( . <id> ) * (A) ? N ? " + ("| public | private | protected | readonly | abstract | override | declare | accessor ) *" if ts else ") *"),
        "method": "<mods> <key> " + ("'?' ? <gen> (A) <ret> ( {B} | ; | N )" if ts else "(A) {B}") + " | static {B}",
        "field": "<mods> <key> " + ("( '?' | UN ) ? <ret> " if ts else "") + "( = <asg> ) ?",
        "bind": "<asg> | <unit> UN ? : <type> ( = <asg> ) ?" if ts else "<asg>",
        "decl": "( const | let | var ) <bind> ( , <bind> ) *",
        "head": "( if (X) | else | for await ? (F) | while (X) | with (X) | <id> : ) N *",
        "block": "{B} | <fn> | @ <id> ( . <id> ) * (A) ? | <clsd> | try {B} ( catch (A) ? {B} ( finally {B} ) ? | finally {B} ) | switch (X) {S} | do {B} while (X) ; ?"
        + (" | declare ? ( interface <id> <gen> ( extends <types> ) ? {T} | const ? enum <id> {E} | ( namespace | module ) ( <id> ( . <id> ) * | STR ) {B} )" if ts else ""),
        "imp": "<id> ( , ( {I} | '*' as <id> ) ) ? | {I} | '*' as <id>",
        "import": "import " + ("type ? " if ts else "") + "( <imp> from ) ? STR ( with {O} ) ?",
        "export": "export ( default <asg> | " + ("type ? " if ts else "") + "{I} ( from STR ) ? | '*' ( as <name> ) ? from STR | <decl>" + (" | = <asg> | declare ? type <id> <gen> = <alias> | declare <decl>" if ts else "") + " )",
        "simple": "<decl> | <e> | return <e> ? | throw <e> | break <id> ? | continue <id> ? | debugger | <import> | <export> | do <e> ; ? N ? while (X)" + (" | declare ? type <id> <gen> = <alias> | declare ( <decl> | async ? function <id> <gen> (A) <ret> ) | import <id> = <e>" if ts else ""),
        "whole": "<head> * ( export default ? ) ? <block>",
        "stmts": "( N | ; | <whole> | <head> * <simple> ( ; | N ) ) * ( <head> * <simple> ) ?",
        "arg": "( @ <id> (A) ? ) * ... ? ( " + ("( public | private | protected | readonly | override ) * <unit> '?' ? : <type> ( = <asg> ) ? | <unit> '?' | ( public | private | protected | readonly ) + <asg> | " if ts else "") + "<asg> )",
        "member": "( ( public | private | readonly | static | abstract | get | set | SGN ) * ( <key> | [N] | [T] | new ) ? '?' ? SGN ? '?' ? <gen> (A) ? <ret> )" if ts else "ID",
    }
    bodies = {
        "": {"P": "( # UN ) ? <stmts>"},
        "{": {
            "B": "<stmts>",
            "O": "( <prop> ( , <prop> ) * , ? ) ?",
            "C": "( <method> | <field> ( ; | N ) | ; | N ) * <field> ?",
            "S": "( N | case <e> : <stmts> | default : <stmts> ) *",
            "I": "( " + ("type ? " if ts else "") + "( <name> | STR ) ( as ( <name> | STR ) ) ? ( , " + ("type ? " if ts else "") + "( <name> | STR ) ( as ( <name> | STR ) ) ? ) * , ? ) ?",
        },
        "(": {"A": "( <arg> ( , <arg> ) * , ? ) ?", "X": "<e>", "F": "( <decl> | <e> ) ? ; <e> ? ; <e> ? | ( const | let | var ) ? <unit> ( of | in ) <e>"},
        "[": {"L": "( , | ... ? <asg> , ) * ( ... ? <asg> ) ?", "X": "<e>"},
    }
    if ts:
        bodies["{"] |= {"T": "( ( <member> ) ( ; | N | , ) ) * ( <member> ) ?", "E": "( ( <id> | STR | [X] ) ( = <asg> ) ? ( , ( <id> | STR | [X] ) ( = <asg> ) ? ) * , ? ) ?"}
        bodies["("]["T"] = "( ... ? <id> '?' ? : <alias> ( , ... ? <id> '?' ? : <alias> ) * , ? | <alias> ) ?"
        bodies["["] |= {"T": "( ( <id> '?' ? : ) ? ... ? <type> ( , ( <id> '?' ? : ) ? ... ? <type> ) * ) ?", "N": "( <id> : | <id> in ) <type>"}
    return Language(_JS, _js_kind, _JS_SAME | {"'": "ERR", '"': "ERR", "`": "ERR", "\\": "ERR"}, r, bodies, finish=_js_finish)


# Go -----------------------------------------------------------------------------------------------------------------------

_GO = (
    r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\[^\n]{1,9}?|[^'\\\n])'|0[xX][\da-fA-F_]+|0[bBoO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?(?!\w)|[^\W\d]\w*"
    r"|<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|\n|[^\s\w]|\w+"
)
_GO_SAME = same(BIN="== != <= >= && || / % << >> &^ | < >", ASG="+= -= *= /= %= &= |= ^= <<= >>= &^=", SGN="+ - ^ &", INC="++ --")


def _go_kind(t, tokens):
    h = t[0]
    if h == "\n":
        return ("N",)
    if t.startswith("//"):
        return ()
    if t.startswith("/*") and len(t) > 3:
        return ("N",) if "\n" in t else ()
    if h in "\"`'":
        return ("STR",) if len(t) > 1 else ("ERR",)
    if h.isdigit() or (h == "." and len(t) > 1 and t[1].isdigit()):
        return ("NUM",) if re.fullmatch(r"0[xXbBoO][\da-fA-F_]+|(?:[\d_]+\.?[\d_]*|\.[\d_]+)(?:[eE][+-]?\d+)?i?", t) else ("ERR",)
    if h.isalpha() or h == "_":
        return ident_kind(t, tokens)
    return None


def _go_finish(lang: Language):
    n = lang.chars("N")
    enders = lang.chars("ID", "NUM", "STR", ")", "]", "}", "INC", "return", "break", "continue", "fallthrough")
    many, drop = re.compile(f"{n}{n}+"), re.compile(f"(?<![{enders}]){n}")
    return lambda s: drop.sub("", many.sub(n, s))


def go_language() -> Language:
    end = "( ; | N )"
    r = {
        "type": "<t0>",
        "t0": "( '*' | [X] | [E] | [V] | chan <- ? | <- chan | map [X] ) * ( ID ( . ID ) ? ( [X] ) ? | struct {S} | interface {J} | func (P) <res> | (X) )",
        "res": "( <t0a> | (P) ) ?",
        "t0a": "( '*' | [X] | [E] | [V] | chan <- ? | <- chan | map [X] ) * ( ID ( . ID ) ? ( [X] ) ? | struct {S} | interface {J} )",
        "lit": "( [X] | [E] | [V] | map [X] | '*' ) + ( ID ( . ID ) ? ( [X] ) ? | struct {S} | interface {J} | func (P) ( <t0a> | (P) ) ? )",
        "prim": "ID | NUM | STR | (X) | func (P) <res> {B} | <lit> | struct {S} | interface {J} | chan <t0a> | map [X] <t0a>",
        "post": ". ID | . (Y) | [X] | [R] | (A) | {L}",
        "unit": "( SGN | ! | '*' | <- ) * <prim> ( <post> ) *",
        "e": "<unit> ( ( BIN | SGN | '*' | <- ) <unit> ) *",
        "es": "<e> ( , <e> ) *",
        "sim": "<es> | <es> ( := | = | ASG ) <es> | <e> INC | <es> ( := | = ) range <e> | range <e>",
        "spec": "ID ( , ID ) * ( <type> ) ? ( = <es> ) ?",
        "tspec": "ID ( [G] | [X] ) ? = ? <type>",
        "ifs": "if ( <sim> ? ; N ? ) ? <sim> {B} ( else if ( <sim> ? ; N ? ) ? <sim> {B} ) * ( else {B} ) ?",
        "simple": "<sim> | return <es> ? | break ID ? | continue ID ? | goto ID | fallthrough | ( go | defer ) <e> | ( var | const ) ( <spec> | (V) ) | type ( <tspec> | (W) )"
        f" | <ifs> | for ( <sim> | <sim> ? ; <sim> ? ; <sim> ? ) ? {{B}} | switch ( <sim> ? ; ) ? <sim> ? {{K}} | select {{K}} | {{B}}",
        "label": "( ID : N * ) *",
        "stmts": f"{end} * ( <label> <simple> {end} + ) * <label> <simple> ?",
        "case": "( case ( <es> | <sim> | <ts> ) | default ) :",
        "ts": "<t0a> ( , <t0a> ) *",
        "par": "( ... ? <t1> | ID ... ? <t1> | ID )",
        "t1": "( '*' | [X] | [E] | [V] | chan <- ? | <- chan | map [X] ) * ( ID ( . ID ) ? ( [X] ) ? | struct {S} | interface {J} | func (P) ( <t0a> | (P) ) ? | (X) )",
        "fld": "( ID ( , ID ) * <type> | '*' ? ID ( . ID ) ? ( [X] ) ? ) STR ?",
        "el": "( <e> | {L} ) ( : ( <e> | {L} ) ) ?",
        "imp": "( ID | . ) ? STR",
    }
    bodies = {
        "": {
            "T": f"N * package ID {end} + ( import ( <imp> | (I) ) {end} + ) * ( ( func (P) ? ID ( [G] ) ? (P) <res> {{B}} ? | ( var | const ) ( <spec> | (V) ) | type ( <tspec> | (W) ) ) {end} + ) * "
            "( func (P) ? ID ( [G] ) ? (P) <res> {B} ? | ( var | const ) ( <spec> | (V) ) | type ( <tspec> | (W) ) ) ?"
        },
        "{": {
            "B": "<stmts>",
            "S": f"N * ( <fld> {end} + ) * <fld> ?",
            "J": f"N * ( ( ID (P) <res> | ( ~ ? <type> ) ( BIN ~ ? <type> ) * ) {end} + ) * ( ID (P) <res> | ( ~ ? <type> ) ( BIN ~ ? <type> ) * ) ?",
            "K": "N * ( <case> <stmts> ) *",
            "L": "( <el> ( , <el> ) * , ? ) ?",
        },
        "(": {
            "P": "( <par> ( , <par> ) * , ? ) ?",
            "A": "( ( <e> | <type> ) ... ? ( , ( <e> | <type> ) ... ? ) * , ? ) ?",
            "X": "<e> | <type>",
            "Y": "<type> | type",
            "V": f"( <spec> {end} + ) * <spec> ?",
            "W": f"( <tspec> {end} + ) * <tspec> ?",
            "I": f"( <imp> {end} + ) * <imp> ?",
        },
        "[": {"X": "( <e> | <type> ) ( , ( <e> | <type> ) ) * , ?", "E": "( )", "V": "...", "R": "<e> ? : <e> ? ( : <e> ) ?", "G": "ID ( , ID ) * ~ ? <type> ( BIN ~ ? <type> ) * ( , ID ( , ID ) * ~ ? <type> ( BIN ~ ? <type> ) * ) * , ?"},
    }
    return Language(_GO, _go_kind, _GO_SAME | {"\\": "ERR"}, r, bodies, finish=_go_finish)


# C and Java share expressions ---------------------------------------------------------------------------------------------

_CLIKE = (
    r"//[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|(?:u8|[uUL])?\"(?:\\[\s\S]|[^\"\\\n])*\"|[uUL]?'(?:\\[^\n]{1,9}?|[^'\\\n])+'|0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?[uUlLfFdD]*|0[bB][01_]+[uUlL]*|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[uUlLfFdD]*(?!\w)|[^\W\d]\w*"
    r"|>>>=|<<=|>>=|\.\.\.|&&|\|\||->|::|\+\+|--|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[^\s\w]|\w+"
)
_C_SAME = same(BIN="== != <= >= && || / % << | ^", ASG="+= -= *= /= %= &= |= ^= <<= >>= >>>=", SGN="+ -", UN="! ~", INC="++ --")


def _c_kind(t, tokens):
    h = t[0]
    if t.startswith("//"):
        return ()
    if t.startswith("/*") and len(t) > 3:
        return ()
    if (h in "\"'" and len(t) > 1) or t[-1:] in "\"'" and len(t) > 2:
        return ("STR",)
    if h in "\"'":
        return ("ERR",)
    if h.isdigit() or (h == "." and len(t) > 1 and t[1].isdigit()):
        return ("NUM",) if re.fullmatch(r"0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?[uUlLfFdD]*|(?:[\d_]+\.?[\d_]*|\.[\d_]+)(?:[eE][+-]?\d+)?[uUlLfFdD]*|0[bB][01_]+[uUlL]*", t) else ("ERR",)
    if h.isalpha() or h == "_" or h == "$":
        return ident_kind(t, tokens)
    return None


_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(?:include|define|undef|if|ifdef|ifndef|elif|else|endif|error|warning|pragma|line)\b(?:\\\r?\n|/\*[\s\S]*?\*/|[^\n])*", re.M)


def c_language() -> Language:
    r = {
        "q": "const | static | extern | inline | volatile | register | restrict | unsigned | signed | long | short | auto | typedef | _Thread_local | _Noreturn",
        "base": "( <q> ) * ( ID | void | int | char | float | double | ( struct | union ) ( ID ? {S} | ID ) | enum ( ID ? {E} | ID ) | unsigned | signed | long | short | typeof (A) ) ( <q> | int | char | double | long ) *",
        "ptr": "( '*' ( const | volatile | restrict ) * ) *",
        "dir": "<ptr> ( ID | (D) ) ( [X] | [E] | (P) ) * ( __attribute__ (A) ) *",
        "init": "<dir> ( : <u> ) ? ( = ( <a> | {L} ) ) ?",
        "decl": "<base> ( <init> ( , <init> ) * ) ?",
        "cast": "(Y)",
        "unit": "( UN | SGN | INC | '*' | & | sizeof | (Y) ) * ( ID | NUM | ( STR ID ? ) + | (X) | (Y) {L} | (Y) | {B2} ) ( . ID | -> ID | [X] | (A) | INC ) *",
        "u": "<unit> ( ( BIN | SGN | '*' | & | < | > | > > ) <unit> ) *",
        "a": "( <u> ( = | ASG ) ) * <u> ( '?' <u> : <u> ) * ",
        "e": "<a> ( , <a> ) *",
        "head": "( if (X) | else | for (F) | while (X) | case <u> ( ... <u> ) ? : | default : | ID : | switch (X) )",
        "simple": "<e> | <decl> | return <e> ? | break | continue | goto ID",
        "stmts": "( <head> * ( ; | <simple> ; | {B} | do {B} while (X) ; | do <simple> ; while (X) ; ) ) *",
        "par": "<base> <ptr> ( ID | (D) ) ? ( [X] | [E] | (P) ) * | ...",
        "attr": "( __attribute__ (A) ) *",
    }
    bodies = {
        "": {"T": "( ; | <attr> <decl> ; | <attr> <base> <ptr> ( ID | (D) ) (P) ( (P) | [X] | [E] ) * ( __attribute__ (A) ) * ( <decl> ; ) * {B} | ID (A) ; ? | <attr> ID (P) {B} ) *"},
        "{": {
            "B": "<stmts>",
            "S": "( <base> ( <dir> ( : <u> ) ? ( , <dir> ( : <u> ) ? ) * | : <u> ) ? ; | ; ) *",
            "E": "ID ( = <u> ) ? ( , ID ( = <u> ) ? ) * , ?",
            "L": "( ( ( . ID | [X] ) + = ) ? ( <a> | {L} ) ( , ( ( . ID | [X] ) + = ) ? ( <a> | {L} ) ) * , ? ) ?",
        },
        "(": {
            "A": "( ( <a> | <par> ) ( , ( <a> | <par> ) ) * ) ?",
            "X": "<e> | {B}",
            "Y": "<base> <ptr> ( (D) | [X] | [E] | (P) ) *",
            "P": "( <par> ( , <par> ) * ) ?",
            "D": "<ptr> ID ? ( [X] | [E] | (P) ) *",
            "F": "( <decl> | <e> ) ? ; <e> ? ; <e> ?",
        },
        "[": {"X": "<e> | static <e>", "E": "( )"},
    }
    r["unit"] = r["unit"].replace(" | {B2}", "")
    return Language(_CLIKE, _c_kind, _C_SAME | {"\\": "ERR"}, r, bodies, prepare=lambda s: _DIRECTIVE.sub(" ", s))


def java_language() -> Language:
    r = {
        "ann": "( @ ID ( . ID ) * (A) ? ) *",
        "mod": "( public | private | protected | static | final | abstract | native | synchronized | transient | volatile | strictfp | default | sealed | non - sealed | @ ID ( . ID ) * (A) ? ) *",
        "ty": "( ID | . | < | > | '?' | , | extends | super | & | [E] | @ ) *",
        "type": "ID ( <tx> ) *",
        "tx": ". ID | [E] | < | > | , ID | '?' | extends ID | super ID | & ID | ID",
        "gt": "( < ( ID | . | < | > | '?' | , | extends | super | & | [E] ) * > ) ?",
        "T": "ID ( . ID ) * <gt> ( . ID <gt> ) * [E] *",
        "unit": "( UN | SGN | INC | (Y) ) * ( ID | NUM | STR | (X) | new <new> | switch (X) {K} | <lam> ( {B} ) ) ( . ( <gt> ID | new <new> | class ) | [X] | (A) | INC | :: ( ID | new ) | [E] . class | {L} ) *",
        "new": "ID ( . ID ) * <gt> ( (A) {C} ? | ( [X] | [E] ) + {L} ? )",
        "lam": "( ID | (A) ) ->",
        "u": "( <lam> ) * <unit> ( ( BIN | SGN | '*' | & | < | > | > > | > > > | instanceof final ? ) ( <lam> ) * <unit> ( (A) ) ? ID ? ) *",
        "a": "( <u> ( = | ASG ) ) * <u> ( '?' <u> : <u> ) *",
        "e": "<a> ( , <a> ) *",
        "init": "ID [E] * ( = ( <a> | {L} ) ) ?",
        "local": "<mod> <T> <init> ( , <init> ) *",
        "head": "( if (X) | else | for (F) | while (X) | case <cs> ( : | -> ) | default ( : | -> ) | ID : | synchronized (X) )",
        "cs": "<u> ( , <u> ) *",
        "simple": "<e> | <local> | return <e> ? | throw <e> | break ID ? | continue ID ? | yield <e> | assert <u> ( : <u> ) ?",
        "try": "try (R) ? {B} ( catch (M) {B} ) * ( finally {B} ) ?",
        "stmts": "( <head> * ( ; | <simple> ; | {B} | do {B} while (X) ; | <try> | switch (X) {K} | <mod> <cls> ) ) *",
        "cls": "( class | interface | record | @ interface ) ID <gt> (P) ? ( extends <Ts> ) ? ( implements <Ts> ) ? ( permits <Ts> ) ? {C} | enum ID ( implements <Ts> ) ? {N}",
        "Ts": "<T> ( , <T> ) *",
        "memb": "; | <mod> <cls> | static ? {B} | <mod> <gt> ( <T> ? ID (P) [E] * ( throws <Ts> ) ? ( default <a> ) ? ( {B} | ; ) | <T> <init> ( , <init> ) * ; | ID {B} )",
        "par": "<mod> <T> ( ... ) ? ID ? ( . ID ) ? [E] *",
    }
    bodies = {
        "": {"T": "( <ann> package ID ( . ID ) * ; ) ? ( import static ? ID ( . ID ) * ( . '*' ) ? ; | ; ) * ( <mod> <cls> | ; ) *"},
        "{": {
            "B": "<stmts>",
            "C": "( <memb> ) *",
            "N": "( <ann> ID (A) ? {C} ? ( , <ann> ID (A) ? {C} ? ) * ) ? , ? ( ; ( <memb> ) * ) ?",
            "K": "( ( case <cs> | default ) ( : <stmts> | -> ( {B} | <simple> ; ) ) ) *",
            "L": "( ( <a> | {L} ) ( , ( <a> | {L} ) ) * , ? ) ?",
        },
        "(": {
            "A": "( <arg> ( , <arg> ) * ) ?",
            "X": "<e>",
            "Y": "<T> ( & <T> ) *",
            "P": "( <par> ( , <par> ) * ) ?",
            "F": "( <local> | <e> ) ? ; <e> ? ; <e> ? | <mod> <T> ID : <e>",
            "R": "( <local> | <e> ) ( ; ( <local> | <e> ) ) * ; ?",
            "M": "<mod> <T> ( '|' <T> ) * ID",
        },
        "[": {"X": "<e>", "E": "( )"},
    }
    r["arg"] = "<a> | ID = ( <a> | {L} ) | {L} | <mod> <T> ID"
    for k in ("ty", "type", "tx"):
        del r[k]
    kind = lambda t, tokens: ("SGN",) if t == "-" else _c_kind(t, tokens)
    r["mod"] = r["mod"].replace("| non - sealed ", "")

    def finish(lang: Language):
        ident = lang.lexer.char("ID")
        plain = re.compile(f"{lang.chars('record')}(?!{ident})|[{lang.chars('permits', 'sealed', 'yield')}](?=[{lang.chars('.', '=', ',', ';', ')', '(')}])|(?<={lang.chars('.')})[{lang.chars('record', 'permits', 'sealed', 'yield')}]")
        return lambda s: plain.sub(ident, s)

    return Language(_CLIKE, kind, {k: v for k, v in _C_SAME.items() if k != "|"} | {"|": "BIN", "\\": "ERR"}, {k: v.replace("( '|' <T> )", "( BIN <T> )") for k, v in r.items()}, {k: {x: y.replace("( '|' <T> )", "( BIN <T> )") for x, y in v.items()} for k, v in bodies.items()}, finish=finish)


# Rust ---------------------------------------------------------------------------------------------------------------------

_RUST = (
    r"//[^\n]*|/\*[\s\S]*?\*/|(?:br|r|cr)#\"[\s\S]*?\"#|(?:br|r|cr)##\"[\s\S]*?\"##|(?:b|br|r|c)?\"(?:\\[\s\S]|[^\"\\])*\"|b?'(?:\\[^\n]{1,10}?|[^'\\\n])'|'[^\W\d]\w*|0[xX][\da-fA-F_]+\w*|0[bo][0-7_]+\w*|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d+)?(?:_?[iuf]\w+)?(?!\w)|(?:r#)?[^\W\d]\w*"
    r"|<<=|>>=|\.\.=|\.\.\.|::|->|=>|\.\.|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[^\s\w]|\w+"
)
_RUST_SAME = same(BIN="== != <= >= / % ^ <<", ASG="+= -= *= /= %= &= |= ^= <<= >>=", RNG=".. ..= ...", SGN="-", PLUS="+")


def _rust_kind(t, tokens):
    h = t[0]
    if t.startswith("//") or (t.startswith("/*") and len(t) > 3):
        return ()
    if h == "'" and len(t) > 1 and not (t[-1] == "'" and len(t) > 2):
        return ("LIFE",)
    if len(t) > 1 and t[-1] in "\"'#" and (h in "\"'" or '"' in t or t.startswith("b'")):
        return ("STR",)
    if h in "\"'":
        return ("ERR",)
    if h.isdigit():
        return ("NUM",) if re.fullmatch(r"0[xX][\da-fA-F_]+\w*|0[bo][0-7_]+\w*|[\d_]+(?:\.[\d_]*)?(?:[eE][+-]?\d+)?(?:_?[iuf]\w+)?", t) else ("ERR",)
    if h.isalpha() or h == "_":
        return ident_kind(t, tokens)
    return None


def rust_language() -> Language:
    r = {
        "attr": "( # ! ? [M] ) *",
        "vis": "( pub (M) ? | pub ) ?",
        "tt": "ID | :: | < | > | , | & | && | '*' | const | mut | dyn | impl | for | LIFE | [Y] | (Y) | (P) | fn | -> | PLUS | = | NUM | STR | ! | '?' | where | : | unsafe | extern | as | {B} | self | Self | super | crate | SGN",
        "ty": "( ID | _ | :: | < | > | & | && | '*' | const | mut | dyn | impl | for | LIFE | [Y] | (Y) | fn | -> | PLUS | ! | '?' | unsafe | extern | self | Self | super | crate | , | = | NUM ) +",
        "tt0": "( ID | _ | :: | < | > | , | & | && | '*' | const | mut | dyn | impl | for | LIFE | [Y] | (Y) | fn | -> | PLUS | = | NUM | STR | ! | '?' | : | {B} | self | Self | super | crate | SGN ) *",
        "gen": "( < <tt0> > ) ?",
        "wh": "( where ( <tt0> ) ) ?",
        "path": "( ID | self | Self | super | crate | < <tt0> > ) ( :: ( ID | < <tt0> > | self | super ) ) *",
        "mac": "! ( (M) | [M] | {M} )",
        "clo": "move ? ( '||' | '|' <pats> '|' ) ( -> <ty> ) ?",
        "pats": "( <pt> | : | , ) *",
        "pt": "ID | NUM | STR | :: | & | && | mut | ref | RNG | (T) | [T] | {F} | self | Self | crate | < | > | LIFE | SGN | @ | _ | dyn | '*' | [Y] | (Y) | ! ( (M) | [M] )",
        "pat": "( <pt> | '|' ) +",
        "let": "( let <pat> = ) ?",
        "ctl": "if <let> | while <let> | match | for <pat> in | LIFE : | loop | unsafe | async move ? | const",
        "prim": "<path> | NUM | STR | (X) | (A) | [L] | <path> <mac> | <path> {F} | {B} | break LIFE ? | continue LIFE ? | return | RNG",
        "unit": "( SGN | ! | '*' | & | && | mut | RNG | <clo> | return | break LIFE ? | let <pat> = | <ctl> ) * <prim> ( . ( ID ( :: < <tt0> > ) ? | NUM | await ) | (A) | [X] | '?' | as <ty> | RNG | {B} ( else {B} ) ? | {K} ) *",
        "u": "<unit> ( ( BIN | SGN | PLUS | '*' | & | && | '|' | '||' | < | > | > > | = | ASG | RNG | as | {B} else if <let> ) <unit> ) *",
        "stmt": "let <pat> ( : <ty> ) ? ( = <u> ( else {B} ) ? ) ? ; | <u> ; | ; | <item> | <blk>",
        "blk": "<ctl> + <u> ? ( {B} ( else {B} ) ? | {K} ) | {B} | <path> ! {M}",
        "fn": "( const | async | unsafe | extern STR ? | default ) * fn ID <gen> (P) ( -> <ty> ) ? <wh>",
        "item": "<vis> ( <fn> ( {B} | ; ) | struct ID <gen> ( <wh> {S} | (U) <wh> ; | ; ) | enum ID <gen> <wh> {E} | union ID <gen> {S} | unsafe ? auto ? trait ID <gen> ( : <tt0> ) ? <wh> {I} | unsafe ? impl <gen> ! ? <ty> <wh> {I}"
        " | mod ID ( {I} | ; ) | use <use> ; | type ID <gen> ( : <tt0> ) ? ( = <ty> ) ? <wh> ; | ( const | static ) mut ? ( ID | _ ) ( : <ty> ) ? ( = <u> ) ? ; | extern STR ? {I} | extern crate ID ( as ID ) ? ; ) | macro_rules ! ID ? {M} | <path> ! ID ? ( {M} | (M) ; | [M] ; )",
        "use": "( ID | self | Self | super | crate | :: | {G} | '*' | as ( ID | _ ) ) +",
        "arm": "<attr> '|' ? <pat> ( if <u> ) ? =>",
        "any": "( ID | NUM | STR | LIFE | , | ; | : | :: | . | < | > | = | & | && | '|' | '||' | '*' | PLUS | SGN | BIN | ASG | RNG | ! | '?' | # | $ | @ | => | -> | ~ | _ | {M} | (M) | [M] | if | else | match | let | mut | ref | fn | for | in | loop | while | return | break | continue | move | as | const | static | struct | enum | impl | trait | mod | use | pub | self | Self | super | crate | where | type | unsafe | extern | async | await | dyn | union | auto | default | macro_rules ) *",
        "fld": "<attr> <vis> ID : <ty0>",
        "finit": "<attr> ( ( ID | NUM ) ( : <u> ) ? | RNG <u> ? | ref ? mut ? ID | ( ID | NUM ) : <pat> )",
    }
    lst = lambda x: f"( {x} ( , {x} ) * , ? ) ?"
    bodies = {
        "": {"T": "( <attr> <item> ) * <attr0>"},
        "{": {
            "B": "<attr> ( <attr> <stmt> ) * ( <attr> <u> ) ?",
            "S": lst("<fld>"),
            "E": lst("<attr> <vis> ID ( {S} | (U) ) ? ( = <u> ) ?"),
            "I": "<attr> ( <attr> <item> ) *",
            "K": "<attr> ( <arm> ( <u> , | {B} , ? | <blk> , ? ) ) * ( <arm> <u> ) ?",
            "F": lst("<finit>"),
            "G": lst("<use>"),
            "M": "<any>",
        },
        "(": {
            "A": lst("<attr> <u>"),
            "X": "<u>",
            "P": lst("<attr> ( <pat> : <ty> | & ? LIFE ? mut ? self ( : <ty> ) ? | RNG )"),
            "U": lst("<attr> <vis> <ty>"),
            "Y": lst("<ty>"),
            "T": lst("<pat>"),
            "M": "<any>",
        },
        "[": {"L": lst("<u>") + " | <u> ; <u>", "X": "<u>", "Y": "<ty> ( ; <u> ) ?", "T": lst("<pat>"), "M": "<any>"},
    }
    r["attr0"] = "( # ! [M] ) *"
    r["ty0"] = r["ty"]
    return Language(_RUST, _rust_kind, _RUST_SAME | {"\\": "ERR"}, r, bodies, finish=None)


# Python -------------------------------------------------------------------------------------------------------------------

_PY = (
    r"#[^\n]*|\\\n[ \t]*|\n[ \t\f]*|(?i:[rbuft]{0,2})(?:\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"|'''(?:\\[\s\S]|[^\\])*?'''|\"(?!\"\")(?:\\[\s\S]|[^\"\\\n])*\"|'(?!'')(?:\\[\s\S]|[^'\\\n])*')"
    r"|0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[jJ]?(?!\w)|[^\W\d]\w*|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|>>|<<|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[^\s\w]|\w+"
)
_PY_SAME = same(BIN="% // >> << == != <= >= & | ^ < >", ASG="+= -= *= /= %= &= |= ^= <<= >>= **= //= @=", SGN="+ -")


def _py_kind(t, tokens):
    h = t[0]
    if h == "\n":
        return ("N", f"width {len(t[1:].replace(chr(12), '').expandtabs(8))}")
    if h == "#" or (h == "\\" and len(t) > 1):
        return ()
    if t[-1] in "\"'" and len(t) > 1:
        return ("STR",)
    if h in "\"'":
        return ("ERR",)
    if h.isdigit() or (h == "." and len(t) > 1 and t[1].isdigit()):
        return ("NUM",) if re.fullmatch(r"0[xXbBoO][\da-fA-F_]+|(?:[\d_]+\.?[\d_]*|\.[\d_]+)(?:[eE][+-]?\d+)?[jJ]?", t) and not re.fullmatch(r"0[\d_]*[1-9][\d_]*", t) else ("ERR",)
    if h.isalpha() or h == "_" or ord(h) > 127:
        return ident_kind(t, tokens) if t.isidentifier() else ("ERR",)
    return None


def _py_finish(lang: Language):
    """Line breaks and indentation: kept where a logical line ends, as brackets around what is indented."""
    n, ind, ded, err = (lang.lexer.char(x) for x in ("N", "⟨", "⟩", "ERR"))
    opens, shuts = [lang.lexer.char(c) for c in "([{"], [lang.lexer.char(c) for c in ")]}"]
    widths: dict[str, int] = {}

    def width(c: str) -> int:
        if c not in widths:
            widths.update({v: int(k[6:]) for k, v in lang.lexer.tokens.items() if k.startswith("width ")})
        return widths[c]

    def finish(s: str) -> str:
        out, stack, depth = [], [0], 0
        for k, piece in enumerate(s.split(n)):
            w, body = (width(piece[0]), piece[1:]) if k else (0, piece)
            if not body:
                continue
            if not depth:
                if out:
                    out.append(n)
                if w > stack[-1]:
                    stack.append(w)
                    out.append(ind)
                else:
                    while w < stack[-1]:
                        stack.pop()
                        out.append(ded)
                    if w != stack[-1]:
                        out.append(err)
            out.append(body)
            depth = max(0, depth + sum(map(body.count, opens)) - sum(map(body.count, shuts)))
        if out:
            out.append(n)
        return "".join(out) + ded * (len(stack) - 1)

    return finish


def python_language() -> Language:
    r = {
        "id": "ID | match | case | type",
        "lam": "lambda ( ( '*' | '**' ) ? ID ( = <seq0> ) ? , | '*' , | / , ) * ( ( '*' | '**' ) ? ID ( = <seq0> ) ? ) ? :",
        "seq0": "SGN ? ( ID | NUM | STR + | (X) | (T) | [L] | {D} ) ( . ID | (A) | [X] ) *",
        "prim": "<id> | NUM | STR + | (X) | (T) | [L] | {D} | ...",
        "unit": "( SGN | ~ | not | await | <lam> ) * <prim> ( . <id> | (A) | [X] ) *",
        "seq": "<unit> ( ( BIN | SGN | '*' | '**' | / | @ | and | or | in | not in | is | is not | := ) <unit> ) *",
        "asg": "<seq> ( if <seq> else <seq> ) *",
        "star": "'*' ? <asg>",
        "e": "<star> ( , <star> ) * , ?",
        "comp": "( async ? for '*' ? <tgt> in <asg> ( if <asg> ) * ) +",
        "tgt": "<t0> ( , '*' ? <t0> ) * , ?",
        "t0": "( <id> | (X) | [L] | (T) ) ( . <id> | [X] | (A) ) *",
        "dot": "<id> ( . <id> ) *",
        "names": "<id> ( as <id> ) ? ( , <id> ( as <id> ) ? ) *",
        "y": "yield ( <e> | from <asg> ) ?",
        "simple": "<e> ( = ( <e> | <y> ) ) * | <t0> ASG ( <e> | <y> ) | <t0> : <asg> ( = ( <e> | <y> ) ) ? | return <e> ? | del <e> | pass | break | continue | raise ( <asg> ( from <asg> ) ? ) ? | global <id> ( , <id> ) * | nonlocal <id> ( , <id> ) *"
        " | import <dot> ( as <id> ) ? ( , <dot> ( as <id> ) ? ) * | from ( ( . | ... ) * <dot> | ( . | ... ) + ) import ( '*' | <names> | (I) ) | assert <asg> ( , <asg> ) ? | <y> | type <id> [X] ? = <asg>",
        "line": "<simple> ( ; <simple> ) * ; ? N",
        "suite": "N ⟨K⟩ | <line>",
        "item": "<asg> ( as <t0> ) ?",
        "compound": "if <asg> : <suite> ( elif <asg> : <suite> ) * ( else : <suite> ) ? | while <asg> : <suite> ( else : <suite> ) ? | async ? for '*' ? <tgt> in <e> : <suite> ( else : <suite> ) ?"
        " | try : <suite> ( ( except '*' ? ( <asg> ( , <asg> ) * ( as <id> ) ? ) ? : <suite> ) + ( else : <suite> ) ? ( finally : <suite> ) ? | finally : <suite> ) | async ? with ( <item> ( , <item> ) * | (W) ) : <suite>"
        " | ( @ <asg> N ) * ( async ? def <id> [X] ? (P) ( -> <asg> ) ? : <suite> | class <id> [X] ? (A) ? : <suite> ) | match <e> : N ⟨M⟩",
        "stmts": "( <line> | <compound> ) *",
        "arg": "'*' ? <asg> <comp> ? | '**' <asg> | <id> = <asg>",
        "par": "( '*' | '**' ) ? <id> ( : '*' ? <asg> ) ? ( = <asg> ) ? | '*' | /",
        "sl": "<asg> ? : <asg> ? ( : <asg> ? ) ? | '*' ? <asg>",
        "pair": "<asg> : <asg> | '**' <asg>",
    }
    lst = lambda x: f"( {x} ( , {x} ) * , ? ) ?"
    bodies = {
        "": {"T": "<stmts>"},
        "⟨": {"K": "( <line> | <compound> ) +", "M": "( case <star> ( , <star> ) * , ? ( as ID ) ? ( if <asg> ) ? : <suite> ) +"},
        "(": {"X": "<e> | <asg> <comp> | <y>", "T": "( )", "A": lst("( <arg> )"), "P": lst("( <par> )"), "I": "<names> , ?", "W": "<item> ( , <item> ) * , ?"},
        "[": {"L": "( <e> | <asg> <comp> ) ?", "X": "( <sl> ) ( , ( <sl> ) ) * , ?"},
        "{": {"D": "( ( <pair> ) ( , ( <pair> ) ) * , ? | <e> | <asg> <comp> | <asg> : <asg> <comp> ) ?"},
    }
    return Language(_PY, _py_kind, _PY_SAME | {"\\": "ERR", "$": "ERR", "!": "ERR", "?": "ERR", "`": "ERR"}, r, bodies, {"(": ")", "[": "]", "{": "}", "⟨": "⟩"}, finish=_py_finish, prepare=lambda s: "\n" + s)


# Shell --------------------------------------------------------------------------------------------------------------------

_DQ = r"\"(?:\\[\s\S]|\$\((?:[^()\"]|\"(?:\\.|[^\"\\])*\"|\((?:[^()\"]|\"(?:\\.|[^\"\\])*\")*\))*\)|\$\{(?:[^{}\"]|\"[^\"]*\"|\{[^{}]*\})*\}|`[^`]*`|[^\"\\`$]|\$(?![({]))*\""
_CMD = r"\$\((?:[^()'\"]|'[^']*'|" + _DQ + r"|\((?:[^()'\"]|'[^']*'|\"[^\"]*\"|\([^()]*\))*\))*\)"
_SH = (
    r"(?:(?<=[\s;])|\A)#[^\n]*|\n|\w+\+?=\((?:[^()'\"]|'[^']*'|" + _DQ + r"|\([^()]*\))*\)|\(\((?:[^()]|\([^()]*\))*\)\)|\[\[\s[\s\S]*?\s\]\]"
    r"|;;&|;;|;&|&&|\|\||\|&|\d*(?:<<<|>>|>&|<&|<>|>\||<<-?|>|<)(?!\()|&>>?"
    r"|(?:[^\s;&|<>()'\"\\$`]|\\[\s\S]|'[^']*'|" + _DQ + r"|\$'(?:\\.|[^'\\])*'|\$\(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\)|\$\{(?:[^{}'\"]|'[^']*'|" + _DQ + r"|\{[^{}]*\}|\$\{[^{}]*\})*\}|" + _CMD + r"|`[^`]*`|\$(?![({'])|[<>]\((?:[^()]|\([^()]*\))*\))+"
    r"|[^\s]"
)
_HEREDOC = re.compile(r"(<<-?)[ \t]*(['\"\\]?)(\w+)['\"]?([^\n]*)\n(?:(?:[^\n]*\n)*?[ \t]*\3[ \t]*(?=\n|\Z)|[\s\S]*\Z)")
_SH_KEYS = words("if then elif else fi for while until do done case esac in function select time ! { }")


def _sh_kind(t, tokens):
    if t == "\n":
        return ("N",)
    if t[0] == "#":
        return ()
    if t in _SH_KEYS:
        return (t,)
    if re.fullmatch(r"\d*(?:<<<|>>|>&|<&|<>|>\||<<-?|>|<)|&>>?", t):
        return ("RED",)
    if t in (";", "&", "|", "(", ")", "&&", "||", ";;", ";&", ";;&", "|&"):
        return ({";;&": ";;", ";&": ";;", "|&": "|"}.get(t, t),)
    return ("ERR",) if t in ("'", '"', "`", "\\") else ("ARITH",) if t.startswith("((") else ("W",)


def _sh_finish(lang: Language):
    """Reserved words are words unless a command can begin there; patterns of a case are one token with their parenthesis."""
    c = lang.lexer.char
    begins = {c(x) for x in ("N", ";", "&", "&&", "||", "|", "(", "{", "!", "then", "do", "else", "elif", "if", "while", "until", "time", ";;", "ARM", "ARITH")}
    after = {c(x) for x in ("fi", "done", "esac", "}", ")")}
    keys = {c(k) for k in _SH_KEYS}
    w, i, n, bar, shut, opener, semi = (c(x) for x in ("W", "in", "N", "|", ")", "(", ";;"))
    heads, case, arm, arith, do = {c("for"), c("case"), c("select")}, c("case"), c("ARM"), c("ARITH"), {c("do"), c("{")}
    closing = {c(x) for x in ("fi", "done", "esac", "}", "then", "do", "else", "elif")}

    def finish(s: str) -> str:
        out: list[str] = []
        k, size, cases, want = 0, len(s), 0, False
        while k < size:
            x = s[k]
            last = out[-1] if out else n
            if want and x != n:  # a pattern of a case
                j = k + (x == opener)
                e = j
                while e < size and s[e] not in (shut, n, semi):
                    e += 1
                want = False
                if e < size and s[e] == shut and e > j and x != c("esac"):
                    out.append(arm)
                    k = e + 1
                    continue
            if x in keys and x != i:
                start = last in begins or (last in after and x in closing) or (last == n) or (x in do and (last == shut or last == arith))
                if not start and last in heads:
                    start = False
                x = x if start else w
                if x == case:
                    cases += 1
                elif x == c("esac"):
                    cases -= 1
            elif x == i:
                back = out[-1:] if out and out[-1] != n else out[-2:-1]
                head = out[-2:-1] if out and out[-1] != n else out[-3:-2]
                if back == [w] and head and head[0] in heads:
                    want = head[0] == case
                else:
                    x = w
            elif x == semi and cases > 0:
                want = True
            out.append(x)
            k += 1
        return "".join(out)

    return finish


def shell_language() -> Language:
    r = {
        "red": "RED W",
        "body": "{B} | (S) | ifIfi | ( for ( W ( N * in W * ) ? | ARITH ) ( ; | N ) ? N * | select W ( N * in W * ) ? ( ; | N ) ? N * ) doDdone | caseCesac | ARITH",
        "cmd": "( ! | time | while | until ) * ( ( W | <red> ) + | <body> <red> * | function W (F) ? N * <body> <red> * | W (F) N * <body> <red> * | doDdone <red> * )",
        "pipe": "<cmd> ( '|' N * <cmd> ) *",
        "list": "N * <pipe> ( ( && N * | '||' N * | ( ; | & | N ) N * ) <pipe> ) * ( ( ; | & ) N * | N + ) ?",
    }
    bodies = {
        "": {"T": "N * <list> ?"},
        "if": {"I": "<list> then <list> ( elif <list> then <list> ) * ( else <list> ) ?"},
        "do": {"D": "<list>"},
        "case": {"C": "W N * in N * ( ARM N * <list> ? ;; N * ) * ( ARM N * <list> ? ) ?"},
        "{": {"B": "<list>"},
        "(": {"S": "<list>", "F": "( )"},
    }
    return Language(_SH, _sh_kind, {}, r, bodies, {"if": "fi", "do": "done", "case": "esac", "{": "}", "(": ")"}, finish=_sh_finish, prepare=lambda s: _HEREDOC.sub(lambda m: f"{m[1]} heredoc {m[4]}", s).replace("\\\n", " "))


LANGUAGES = {"json": json_language, "javascript": lambda: _js(False), "typescript": lambda: _js(True), "go": go_language, "c": c_language, "java": java_language, "rust": rust_language, "python": python_language, "shell": shell_language}


@cache
def tables(name: str) -> tuple:
    """What is worth keeping of a language: its tokens and automata, as plain values."""
    made = LANGUAGES[name]()
    return made.grammar.tokens, made.grammar.tables()


def language(name: str, ready: tuple | None = None) -> Language:
    """A language, from its tables if they are given."""
    if ready:
        _READY.append(ready)
    return LANGUAGES[name]()
