"""Error-correcting chart parsing of texts whose nesting is marked by brackets.

A language has a grammar for what stands between each kind of bracket: a regular expression over tokens and over finished
bracket groups, one for each role that a group can play (block, list, parameters ...). A finished group is a chart item that
carries all roles its content can have, so a text is parsed in one pass from the inside out, whatever its nesting.

Tokens are single characters. The states that a content can be in are sets of positions in its expression; the sets and the
steps between them are built when first met and kept, so a text made of known shapes costs one dictionary look-up a token.

Where a content has no state left, the chart is filled again with items of one, two ... edits: a token deleted, inserted or
replaced. Items of more than ``BEAM`` edits above the best are dropped, unless the least number is asked for: then the chart is
filled once more with as many edits as were needed, so that no item of a cheaper parse can be dropped. Brackets that pair with none
are repaired first, by the cheapest set of insertions and deletions, and each content after that by itself. So the cost is zero
exactly for texts of the grammar; for broken ones it is the least given their brackets, with the beam nearly always.
"""

from __future__ import annotations

import re

import numpy as np

BEAM = 2
#: Brackets without a partner up to which the spans of all of them are charted; beyond, stacks are searched, as exactly.
SPANS = 120
#: Stacks kept in that search. Beyond it, which takes hundreds of brackets of several kinds in disorder, the cheapest stay and the
#: cost is an upper bound.
STACKS = 4_096
#: A chart forgets its sets of states, and a lexer its tokens, when it holds more than this: the memory of a worker is bounded.
KEPT = 25_000
TOKENS = 60_000


#: A rule whose deterministic automaton would have more states than this keeps a nondeterministic one.
STATES = 60


class Automaton:
    """An automaton without empty steps: its first states, the steps of each state and its final states."""

    def __init__(self, first: frozenset[int], edges: list[dict[str, frozenset[int]]], final: set[int]):
        self.first, self.edges, self.final = first, edges, final

    @classmethod
    def least(cls, first: int, last: int, edges: list[list[tuple[str, int]]], empty: list[list[int]]) -> Automaton:
        """A small one that accepts what leads from ``first`` to ``last``: deterministic if that has few states."""
        closed: dict[int, frozenset[int]] = {}

        def close(s: int) -> frozenset[int]:
            if s not in closed:
                seen, todo = {s}, [s]
                while todo:
                    for t in empty[todo.pop()]:
                        if t not in seen:
                            seen.add(t)
                            todo.append(t)
                closed[s] = frozenset(x for x in seen if edges[x] or x == last)
            return closed[s]

        rows: list[dict[str, frozenset[int]]] = []
        number, order = {}, sorted(close(first))
        for s in order:
            number[s] = len(number)
        begin = frozenset(number.values())
        for s in order:
            to: dict[str, set[int]] = {}
            for c, t in edges[s]:
                for x in close(t):
                    if x not in number:
                        number[x] = len(order)
                        order.append(x)
                    to.setdefault(c, set()).add(number[x])
            rows.append({c: frozenset(t) for c, t in to.items()})
        some = cls(begin, rows, {number[last]} if last in number else set())
        sets, row_of, final = [some.first], [], set()
        index = {some.first: 0}
        for k, states in enumerate(sets):
            if states & some.final:
                final.add(k)
            to = {}
            for x in states:
                for c, t in some.edges[x].items():
                    to[c] = to[c] | t if c in to else t
            row = {}
            for c, t in to.items():
                if t not in index:
                    index[t] = len(sets)
                    sets.append(t)
                row[c] = frozenset([index[t]])
            row_of.append(row)
            if len(sets) > STATES:
                return some.merged(rough=True)
        return cls(frozenset([0]), row_of, final).merged()

    def merged(self, rough: bool = False) -> Automaton:
        """With states merged that lead on in the same way: all of them, or those that do so by the same sets of tokens."""
        block, n = [int(i in self.final) for i in range(len(self.edges))], 0
        rows: list[list[tuple]] = []
        for row in self.edges:
            if rough:
                by: dict[frozenset[int], list[str]] = {}
                for c, t in row.items():
                    by.setdefault(t, []).append(c)
                rows.append([("".join(sorted(cs)), t) for t, cs in by.items()])
            else:
                rows.append(list(row.items()))
        while True:
            mark: dict[tuple, int] = {}
            block = [mark.setdefault((block[i], frozenset((c, frozenset(block[x] for x in t)) for c, t in row)), len(mark)) for i, row in enumerate(rows)]
            if len(mark) == n:
                break
            n = len(mark)
        out: list[dict[str, frozenset[int]]] = [{} for _ in range(n)]
        for i, row in enumerate(self.edges):
            out[block[i]] = {c: frozenset(block[x] for x in t) for c, t in row.items()}
        return Automaton(frozenset(block[i] for i in self.first), out, {block[i] for i in self.final})


class Node:
    """A set of positions, as bits of a number: its steps so far, and the roles of a content that may end here."""

    __slots__ = ("next", "places", "roles")

    def __init__(self, places: int, roles: frozenset[str]):
        self.places, self.roles, self.next = places, roles, {}


class Live:
    """The sets of positions that the best number of edits, one more ... lead to, and its steps so far."""

    __slots__ = ("levels", "next")

    def __init__(self, levels: tuple[int, ...]):
        self.levels, self.next = levels, {}


def bits(mask: int) -> list[int]:
    """Positions of a set."""
    raw = np.frombuffer(mask.to_bytes((mask.bit_length() + 7) // 8, "little"), dtype=np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


def mask_of(places) -> int:
    out = 0
    for p in places:
        out |= 1 << p
    return out


class Grammar:
    """``bodies``: for each opening bracket (``""``: the whole text) the rules of its content by role.

    A rule is made of words separated by blanks: ``( ) | * + ?`` as in expressions, ``<rule>`` for another rule put in, and all
    else tokens by name; ``{B}`` is a finished group of that role.
    """

    def __init__(self, tokens: dict[str, str], pairs: dict[str, str], bodies: dict[str, dict[str, str]], rules: dict[str, str], ready: tuple | None = None):
        self.tokens, self.pairs, self.rules = tokens, pairs, rules
        self.closers = {v: k for k, v in pairs.items()}
        self.names = {v: k for k, v in tokens.items()}
        self.members: dict[str, str] = {}
        self.groups: dict[tuple[str, frozenset[str]], str] = {}
        self.made: dict[str, Automaton] = {}
        self.edges: list[dict[str, frozenset[int]]] = []
        self.final: dict[int, str] = {}
        self.roles = {k: frozenset(v) for k, v in bodies.items()}
        self.begin: dict[str, frozenset[int]] = {}
        if ready:
            edges, self.final, begin = ready
            self.edges = [{c: t for cs, t in e for c in cs} for e in edges]
            self.begin = {k: frozenset(v) for k, v in begin.items()}
        for opener, by_role in () if ready else bodies.items():
            starts = set()
            for role, rule in by_role.items():
                auto, at = self._automaton(rule), len(self.edges)
                self.edges += [{c: frozenset(at + x for x in t) for c, t in e.items()} for e in auto.edges]
                self.final |= {at + f: role for f in auto.final}
                starts |= {at + x for x in auto.first}
            self.begin[opener] = frozenset(starts)
        known: dict = {}  # one number for all equal sets

        def mask(t) -> int:
            if t not in known:
                known[t] = mask_of(t)
            return known[t]

        self.masks = [{c: mask(t) for c, t in e.items()} for e in self.edges]
        self.any = [mask(frozenset().union(*e.values())) for e in self.edges]
        if ready:
            self.edges = []
        self.ends: dict[str, int] = {}
        for p, role in self.final.items():
            self.ends[role] = self.ends.get(role, 0) | 1 << p
        self.first = {k: mask_of(v) for k, v in self.begin.items()}
        self.forget()

    def tables(self) -> tuple:
        """The automata as plain values, to be sent about."""
        rows = []
        for e in self.edges:
            by: dict[frozenset[int], list[str]] = {}
            for c, t in e.items():
                by.setdefault(t, []).append(c)
            rows.append([("".join(cs), tuple(sorted(t))) for t, cs in by.items()])
        return rows, self.final, {k: tuple(v) for k, v in self.begin.items()}

    def forget(self) -> None:
        self.nodes: dict[int, Node] = {}
        self.lives: dict[tuple[int, ...], Live] = {}
        self.wide: dict[int, int] = {}
        self.start = {k: self.node(v) for k, v in self.first.items()}

    def _rule(self, name: str) -> Automaton:
        if name not in self.made:
            self.made[name] = self._automaton(self.rules[name])
        return self.made[name]

    def _automaton(self, rule: str) -> Automaton:
        """The least automaton of a rule; the rules it names are put in as their own least automata."""
        words, at = rule.split(), 0
        edges: list[list[tuple[str, int]]] = []
        empty: list[list[int]] = []

        def new() -> int:
            edges.append([])
            empty.append([])
            return len(edges) - 1

        def choice() -> tuple[int, int]:
            nonlocal at
            a, b = new(), new()
            while True:
                x, y = row()
                empty[a].append(x)
                empty[y].append(b)
                if at < len(words) and words[at] == "|":
                    at += 1
                    continue
                return a, b

        def row() -> tuple[int, int]:
            nonlocal at
            a = b = new()
            while at < len(words) and words[at] not in ("|", ")"):
                w = words[at]
                at += 1
                if w == "(":
                    x, y = choice()
                    at += 1
                elif len(w) > 2 and w[0] == "<" and w[-1] == ">":
                    sub = self._rule(w[1:-1])
                    x, y = new(), new()
                    base = len(edges)
                    for e in sub.edges:
                        edges.append([(c, base + k) for c, t in e.items() for k in t])
                        empty.append([])
                    empty[x] += [base + k for k in sub.first]
                    for f in sub.final:
                        empty[base + f].append(y)
                else:
                    x, y = new(), new()
                    edges[x].append((self._char(w), y))
                while at < len(words) and words[at] in ("*", "+", "?"):
                    op = words[at]
                    at += 1
                    p, q = new(), new()
                    empty[p].append(x)
                    empty[y].append(q)
                    if op != "+":
                        empty[p].append(q)
                    if op != "?":
                        empty[y].append(x)
                    x, y = p, q
                empty[b].append(x)
                b = y
            return a, b

        first, last = choice()
        if at != len(words):
            raise ValueError(f"unbalanced rule at word {at}: {words[max(0, at - 5) : at + 5]}")
        return Automaton.least(first, last, edges, empty)

    def _char(self, word: str) -> str:
        word = word.strip("'") if len(word) > 2 and word[0] == "'" else word
        if word not in self.tokens:
            self.tokens[word] = self.names_next()
            self.names[self.tokens[word]] = word
        return self.tokens[word]

    def names_next(self) -> str:
        return chr(0xE000 + len(self.tokens))

    def node(self, places: int) -> Node:
        n = self.nodes.get(places)
        if n is None:
            n = self.nodes[places] = Node(places, frozenset(r for r, ends in self.ends.items() if places & ends))
        return n

    def step(self, n: Node, c: str) -> Node:
        """The states after token ``c``; remembered."""
        chars = self.members.get(c, c)
        to, masks = 0, self.masks
        for p in bits(n.places):
            e = masks[p]
            for x in chars:
                if x in e:
                    to |= e[x]
        m = n.next[c] = self.node(to)
        return m

    def group(self, opener: str, roles: frozenset[str]) -> str:
        """The character that stands for a finished group of these roles."""
        key = (opener, roles)
        if key not in self.groups:
            c = self.groups[key] = chr(0xF0000 + len(self.groups))
            shut = self.names.get(self.pairs[opener], "")
            name = self.names.get(opener, opener)
            self.members[c] = "".join(self.tokens[f"{name}{r}{shut}"] for r in roles if f"{name}{r}{shut}" in self.tokens)
        return self.groups[key]

    def _wider(self, places: int) -> int:
        """States one token on, whatever it is."""
        w = self.wide.get(places)
        if w is None:
            w = 0
            for p in bits(places):
                w |= self.any[p]
            self.wide[places] = w
        return w

    def live(self, levels: tuple[int, ...]) -> Live:
        if levels not in self.lives:
            self.lives[levels] = Live(levels)
        return self.lives[levels]

    def advance(self, old: Live, c: str) -> tuple[Live, int]:
        """The sets after token ``c`` and by how much the best number of edits grew; remembered."""
        now, new, more = old.levels, [], 0
        for k in range(len(now)):
            s = self.node(now[k])
            t = (s.next.get(c) or self.step(s, c)).places
            if k:  # the token deleted or replaced, or one inserted after it
                t |= now[k - 1] | self._wider(now[k - 1]) | self._wider(new[k - 1])
            new.append(t)
        while not new[0]:
            more += 1
            new = [*new[1:], new[-1] | now[-1] | self._wider(new[-1]) | self._wider(now[-1])]
        out = old.next[c] = self.live(tuple(new)), more
        return out

    def edits(self, opener: str, body: str, least: bool = False, beam: int = BEAM) -> tuple[int, frozenset[str], int]:
        """Number of edits that make ``body`` a content of ``opener``, its roles then, and where the first edit is.

        ``least``: surely the least number. A prefix of the cheapest parse costs no more than any parse, so a beam of that width
        drops none of its items.
        """
        if least:
            cost, roles, first = self.edits(opener, body)
            return self.edits(opener, body, beam=cost) if cost > BEAM else (cost, roles, first)
        levels = [self.first[opener]]
        for _ in range(beam):
            levels.append(levels[-1] | self._wider(levels[-1]))
        live, base, first = self.live(tuple(levels)), 0, -1
        for i, c in enumerate(body):
            live, more = live.next.get(c) or self.advance(live, c)
            if more:
                base += more
                if first < 0:
                    first = i
        if first < 0:
            first = len(body)
        places = 0
        for k, places in enumerate(live.levels):
            roles = self.node(places).roles
            if roles:
                return base + k, roles, first
        extra = len(live.levels)
        while True:
            wider = places | self._wider(places)
            roles = self.node(wider).roles
            if roles or wider == places:
                return base + extra, roles, first
            places, extra = wider, extra + 1

    def held(self) -> int:
        return len(self.nodes) + len(self.lives) + len(self.wide)


def unpaired(text: str, pairs: dict[str, str], closers: dict[str, str]) -> tuple[list[tuple[int, str]], list[int]]:
    """Cheapest repair of the brackets of ``text``: ``(place, bracket to insert)`` and places to delete.

    Pairs that match without question are taken out; what is left is parsed by a chart over its spans.
    """
    stack: list[tuple[int, str]] = []
    for i, c in enumerate(text):
        if c in pairs:
            stack.append((i, c))
        elif c in closers:
            if stack and stack[-1][1] == closers[c]:
                stack.pop()
            else:
                stack.append((i, c))
    n = len(stack)
    kinds = [c for _, c in stack]
    partner = paired_spans(kinds, pairs) if n <= SPANS else paired_stacks(kinds, pairs, closers)
    insert, delete, todo = [], [], [(0, n, len(text))]
    while todo:
        a, b, end = todo.pop()
        if a >= b:
            continue
        k = partner.get(a, -1)
        if k >= 0:
            todo += [(a + 1, k, stack[k][0]), (k + 1, b, end)]
        else:
            i, c = stack[a]
            if c in pairs:  # closed where the next one left alone, or its surroundings, end
                insert.append((stack[a + 1][0] if a + 1 < b and stack[a + 1][1] in closers else end, pairs[c]))
            else:
                delete.append(i)
            todo.append((a + 1, b, end))
    return insert, delete


def paired_spans(kinds: list[str], pairs: dict[str, str]) -> dict[int, int]:
    """Partners, by place, that leave the fewest of the brackets alone: a chart of all spans."""
    n = len(kinds)
    best = [[0] * (n + 1) for _ in range(n + 1)]
    how: dict[tuple[int, int], int] = {}
    for size in range(1, n + 1):
        for a in range(n - size + 1):
            b = a + size
            cost, k = 1 + best[a + 1][b], -1  # the first alone
            if kinds[a] in pairs:
                for m in range(a + 1, b):
                    if kinds[m] == pairs[kinds[a]] and (x := best[a + 1][m] + best[m + 1][b]) < cost:
                        cost, k = x, m
            best[a][b], how[a, b] = cost, k
    out, todo = {}, [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            if (k := how[a, b]) >= 0:
                out[a] = k
                todo += [(a + 1, k), (k + 1, b)]
            else:
                todo.append((a + 1, b))
    return out


class Stack:
    """Open brackets, the last one first; one object for all equal stacks. ``near``: the last one of each kind."""

    __slots__ = ("depth", "kind", "near", "under", "upon")

    def __init__(self, under: Stack | None, kind: str):
        self.under, self.kind, self.upon = under, kind, {}
        self.depth = under.depth + 1 if under else 0
        self.near = {**under.near, kind: self} if under else {}


def paired_stacks(kinds: list[str], pairs: dict[str, str], closers: dict[str, str]) -> dict[int, int]:
    """The same by a search over the stacks of open brackets, from left to right.

    A closing bracket pairs with the top where it fits. Else it is left alone, or pairs with the nearest one it fits and all above
    that are left alone; a farther one leads to nothing that the nearest does not. Equal stacks are one state. A stack is dropped if
    a cheaper one becomes it, by leaving brackets alone, at no more than its cost.
    """
    first = next((i for i, c in enumerate(kinds) if c in pairs), len(kinds))
    last = next((i for i in range(len(kinds) - 1, -1, -1) if kinds[i] in closers), -1)
    # of each stack: its cost, the pairs so far and the places of its brackets
    states: dict[Stack, tuple[int, tuple | None, tuple | None]] = {Stack(None, ""): (0, None, None)}

    def apart(x: Stack, y: Stack) -> int:
        n = 0
        while x is not y:
            x, y = (x.under, y) if x.depth >= y.depth else (x, y.under)
            n += 1
        return n

    for i in range(first, last + 1):
        c, new = kinds[i], {}
        for s, (cost, trail, places) in states.items():
            if c in pairs:
                if c not in s.upon:
                    s.upon[c] = Stack(s, c)
                after = [(s.upon[c], cost, trail, (i, places))]
            elif s.kind == closers[c]:
                after = [(s.under, cost, (places[0], i, trail), places[1])]
            else:
                after = [(s, cost + 1, trail, places)]
                if near := s.near.get(closers[c]):
                    for _ in range(s.depth - near.depth):
                        places = places[1]
                    after.append((near.under, cost + s.depth - near.depth, (places[0], i, trail), places[1]))
            for t, x, *rest in after:
                if t not in new or x < new[t][0]:
                    new[t] = x, *rest
        if len(new) > 8:
            top, (least, *_) = min(new.items(), key=lambda x: x[1][0])
            new = {t: v for t, v in new.items() if t is top or v[0] < least + apart(t, top)}
        if len(new) > STACKS:
            new = dict(sorted(new.items(), key=lambda x: x[1][0])[:STACKS])
        states = new
    _, (_, trail, _) = min(states.items(), key=lambda x: x[1][0] + x[0].depth)
    out = {}
    while trail:
        a, b, trail = trail
        out[a] = b
    return out


class Result:
    """Edits of a parse, with the places of their tokens."""

    __slots__ = ("cost", "places", "unclosed")

    def __init__(self) -> None:
        self.cost, self.places, self.unclosed = 0, [], 0


def parse(g: Grammar, text: str, least: bool = False) -> Result:
    """Parse the tokens ``text``; without an edit this is one pass over them."""
    out = Result()
    if g.held() > KEPT:
        g.forget()
    pairs, closers, start = g.pairs, g.closers, g.start
    stack: list[tuple[Node, str, int]] = []
    node, opener = start[""], ""
    ok = True
    for c in text:
        if c in pairs:
            stack.append((node, opener, 0))
            node, opener = start[c], c
        elif c in closers:
            if opener != closers[c] or not node.roles:
                ok = False
                break
            c = g.group(opener, node.roles)
            node, opener, _ = stack.pop()
            node = node.next.get(c) or g.step(node, c)
            if not node.places:
                ok = False
                break
        else:
            node = node.next.get(c) or g.step(node, c)
            if not node.places:
                ok = False
                break
    if ok and not stack and node.roles:
        return out
    return correct(g, text, least)


def correct(g: Grammar, text: str, least: bool = False) -> Result:
    """The same with edits: brackets first, then each content by itself."""
    out = Result()
    insert, delete = unpaired(text, g.pairs, g.closers)
    out.cost = len(insert) + len(delete)
    out.places = [i for i, _ in insert] + delete
    out.unclosed = sum(i >= len(text) for i, _ in insert)
    at: dict[int, list[str]] = {}
    for i, c in sorted(insert, key=lambda x: x[0]):
        at.setdefault(i, []).insert(0, c)
    gone = set(delete)
    stack: list[tuple[list[str], list[int], str]] = []
    body, where, opener = [], [], ""

    def fits(chars: list[str]) -> int:
        """Length of the longest start of ``chars`` that is a content as it stands; -1 if none is."""
        n, best = g.start[opener], 0 if g.start[opener].roles else -1
        for k, c in enumerate(chars):
            n = n.next.get(c) or g.step(n, c)
            if not n.places:
                break
            if n.roles:
                best = k + 1
        return best

    def shut(last: int, made: bool = False) -> None:
        """Close the group; ``made``: by a bracket that was put in, which may as well stand where its content ends."""
        nonlocal body, where, opener
        rest, places = [], []
        cost, roles, first = g.edits(opener, "".join(body), least)
        if made and cost and (k := fits(body)) >= 0:
            rest, places, body, where = body[k:], where[k:], body[:k], where[:k]
            if last in out.places:
                out.places.remove(last)
                out.places.append(places[0])
                out.unclosed -= last == len(text)
            cost, roles, first = g.edits(opener, "".join(body), least)
        if cost:
            out.cost += cost
            out.places.append(where[first] if first < len(where) else last)
        done, kind = roles or g.roles[opener], opener
        body, where, opener = stack.pop()
        body.append(g.group(kind, frozenset(done)))
        where.append(last)
        body += rest
        where += places

    for i in range(len(text) + 1):
        for c in at.get(i, ()):
            if opener == g.closers.get(c):
                shut(i, made=True)
        if i == len(text):
            break
        c = text[i]
        if i in gone:
            continue
        if c in g.pairs:
            stack.append((body, where, opener))
            body, where, opener = [], [], c
        elif c in g.closers:
            if opener == g.closers[c]:
                shut(i)
        else:
            body.append(c)
            where.append(i)
    while stack:
        shut(len(text))
    cost, _, first = g.edits("", "".join(body), least)
    if cost:
        out.cost += cost
        out.places.append(where[first] if first < len(where) else len(text))
    return out


class Lexer:
    """Tokens of a text as characters of a grammar: ``pattern`` finds them, ``kinds`` names those that are not fixed."""

    def __init__(self, pattern: str, grammar_tokens: dict[str, str], same: dict[str, str], kind):
        self.find = re.compile(pattern).findall
        self.tokens, self.same, self.kind = grammar_tokens, same, kind
        self.known = _Known(self)

    def char(self, name: str) -> str:
        if name not in self.tokens:
            self.tokens[name] = chr(0xE000 + len(self.tokens))
        return self.tokens[name]

    def __call__(self, text: str) -> str:
        return "".join(map(self.known.__getitem__, self.find(text)))


class _Known(dict):
    """Characters of the tokens met so far, bounded."""

    def __init__(self, lexer: Lexer):
        super().__init__()
        self.lexer = lexer

    def __missing__(self, tok: str) -> str:
        x = self.lexer
        value = x.kind(tok)
        if value is None:
            name = x.same.get(tok, tok)
            value = (name,) if name in x.tokens or tok in x.same else ("ERR",)
        value = "".join(x.char(v) for v in value)
        if len(self) >= TOKENS:
            self.clear()
        self[tok] = value
        return value
