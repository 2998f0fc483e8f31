"""A generalised LL recogniser for extended context-free grammars.

A grammar is text, one rule per line: ``name = expression``. Words in quotes
are terminals, upper-case words are token classes, lower-case words are
nonterminals, rules whose name begins with an underscore are written into
their users. ``| ( ) * + ?`` have their usual meaning; a line that begins with
``|`` goes on the rule before.

Each nonterminal becomes a deterministic automaton over terminals and
nonterminals. The recogniser runs descriptors (state, stack node, position);
calls share a graph-structured stack keyed by (nonterminal, position), with the
positions at which a node has already returned (the ``P`` set of the method).
Where the next token leaves one possible move, the descriptor just goes on;
only real choices make new descriptors. Several start symbols (dialects) run
together over the same stack.

Terminal ``~`` is an automatic end of statement: it consumes nothing and is
possible before a token on a new line, before ``}`` and at the end.
"""

from __future__ import annotations

import re
from collections import defaultdict

EOF = "EOF"
#: the automatic end of statement
EOS = "<eos>"
_TOKEN = re.compile(r"\s*(?:'((?:\\.|[^'])*)'|([A-Za-z_]\w*)|([|()*+?~]))")


class Grammar:
    def __init__(self, text: str, starts: list[str], contextual: tuple[str, ...] = (), reserved: tuple[str, ...] = ()) -> None:
        rules: dict[str, str] = {}
        for line in text.strip().splitlines():
            line = line.strip()
            if not line or line.startswith("//"):
                continue
            if line.startswith("|"):
                rules[name] += " " + line  # noqa: F821
                continue
            name, _, body = line.partition("=")
            name = name.strip()
            rules[name] = (rules[name] + " | " if name in rules else "") + body
        self.rules = {k: self._parse(v) for k, v in rules.items()}
        self.contextual, self.reserved = contextual, reserved
        self.tokens: dict[str, int] = {}
        self._build(starts)

    # -- reading -------------------------------------------------------

    def _parse(self, body: str):
        toks, at = [], 0
        body = body.strip()
        while at < len(body):
            m = _TOKEN.match(body, at)
            if not m:
                raise ValueError(f"can't read {body[at:at+30]!r}")
            at = m.end()
            toks.append(("t", m[1].replace("\\'", "'").replace("\\\\", "\\")) if m[1] is not None else ("n", m[2]) if m[2] else ("o", m[3]))
        pos = 0

        def alt():
            nonlocal pos
            parts = [seq()]
            while pos < len(toks) and toks[pos] == ("o", "|"):
                pos += 1
                parts.append(seq())
            return ("alt", parts) if len(parts) > 1 else parts[0]

        def seq():
            nonlocal pos
            parts = []
            while pos < len(toks) and toks[pos] not in (("o", "|"), ("o", ")")):
                t = toks[pos]
                pos += 1
                if t == ("o", "("):
                    x = alt()
                    if toks[pos] != ("o", ")"):
                        raise ValueError("missing )")
                    pos += 1
                elif t == ("o", "~"):
                    x = ("sym", EOS, True)
                elif t[0] == "t":
                    x = ("sym", t[1], True)
                elif t[0] == "n":
                    x = ("sym", t[1], t[1].isupper())
                else:
                    raise ValueError(f"misplaced {t}")
                while pos < len(toks) and toks[pos][0] == "o" and toks[pos][1] in "*+?":
                    x = (toks[pos][1], x)
                    pos += 1
                parts.append(x)
            return ("seq", parts)

        out = alt()
        if pos != len(toks):
            raise ValueError(f"unread {toks[pos:]}")
        return out

    # -- automata ------------------------------------------------------

    def _build(self, starts: list[str]) -> None:
        names = [n for n in self.rules if not n.startswith("_")]
        self.nt = {n: i for i, n in enumerate(names)}
        autos = {n: self._dfa(n) for n in names}
        offset, total = {}, 0
        for n in names:
            offset[n] = total
            total += len(autos[n])
        # first sets (no nonterminal but a start may be empty)
        first: dict[str, set[str]] = {n: set() for n in names}
        nullable = {n for n in names if autos[n][0][1]}
        if nullable:
            raise ValueError(f"empty: {nullable}")
        change = True
        while change:
            change = False
            for n in names:
                for (kind, s) in autos[n][0][0]:
                    add = {s} if kind == "t" else first[s]
                    if not add <= first[n]:
                        first[n] |= add
                        change = True
        # an end of statement at the start of something means what follows it
        follow: dict[str, set[str]] = {n: set() for n in names}

        def starts_of(edges, acc, n) -> set[str]:
            out: set[str] = set()
            for (kind, s) in edges:
                out |= {s} if kind == "t" else first[s]
            return out | (follow[n] if acc else set())

        change = True
        while change:
            change = False
            for n in names:
                for edges, _ in autos[n]:
                    for (kind, s), to in edges.items():
                        if kind == "n":
                            add = starts_of(*autos[n][to], n)
                            if not add <= follow[s]:
                                follow[s] |= add
                                change = True
        words = {EOF, "}", "ID"} | set(self.contextual) | set(self.reserved)
        for n in names:
            for edges, _ in autos[n]:
                words |= {s for k, s in edges if k == "t" and s not in (EOS, "NAME")}
        self.tokens = {w: i for i, w in enumerate(sorted(words))}
        self.id_like = {"ID", *self.contextual}

        def members(s: str) -> list[tuple[int, str]]:
            """(token code * 2 + newline flag, move) a terminal stands for."""
            if s == EOS:
                return [(c * 2 + nl, "e") for w, c in self.tokens.items() for nl in (0, 1) if nl or w in ("}", EOF)]
            ws = self.id_like if s == "ID" else self.id_like | set(self.reserved) if s == "NAME" else {s}
            return [(self.tokens[w] * 2 + nl, "t") for w in ws for nl in (0, 1)]

        codes = {s: {c for c, _ in members(s)} for s in words | {EOS, "NAME"}}
        cover = lambda ss: set().union(*[codes[s] for s in ss]) if ss else set()
        first_codes, end_codes = {n: cover(first[n]) for n in names}, {n: cover(follow[n]) for n in names}
        states = [(n, edges, acc) for n in names for edges, acc in autos[n]]

        def row(state: int) -> dict[int, list[tuple]]:
            """Moves of a state by token code, made when it is first met."""
            n, edges, acc = states[state]
            out: dict[int, list[tuple]] = defaultdict(list)
            for (kind, s), to in edges.items():
                if kind == "t":
                    for c, move in members(s):
                        out[c].append((0 if move == "t" else 1, offset[n] + to, 0))
                else:
                    for c in first_codes[s]:
                        out[c].append((2, offset[n] + to, self.nt[s]))
            if acc:
                for c in end_codes[n]:
                    out[c].append((3, 0, 0))
            self.table[state] = dict(out)
            return self.table[state]

        self.row = row
        self.table: list[dict[int, list[tuple]] | None] = [None] * len(states)
        self.start = [offset[n] for n in names]
        self.starts = [self.nt[s] for s in starts]
        self.final = {offset[n] + i for n in starts for i, (_, acc) in enumerate(autos[n]) if acc}

    def _dfa(self, name: str) -> list[tuple[dict, bool]]:
        moves: list[list[tuple[tuple | None, int]]] = [[]]

        def new() -> int:
            moves.append([])
            return len(moves) - 1

        def put(x, a: int) -> int:
            kind = x[0]
            if kind == "sym":
                if not x[2] and x[1].startswith("_"):
                    return put(self.rules[x[1]], a)
                b = new()
                if not x[2] and x[1] not in self.rules:
                    raise ValueError(f"no rule for {x[1]} in {name}")
                moves[a].append((("t" if x[2] else "n", x[1]), b))
                return b
            if kind == "seq":
                for p in x[1]:
                    a = put(p, a)
                return a
            if kind == "alt":
                end = new()
                for p in x[1]:
                    moves[put(p, a)].append((None, end))
                return end
            s, e = new(), new()
            moves[a].append((None, s))
            t = put(x[1], s)
            moves[t].append((None, e))
            if kind in "*+":
                moves[t].append((None, s))
            if kind in "*?":
                moves[a].append((None, e))
            return e

        last = put(self.rules[name], 0)

        def close(states) -> frozenset[int]:
            out, todo = set(states), list(states)
            while todo:
                for s, b in moves[todo.pop()]:
                    if s is None and b not in out:
                        out.add(b)
                        todo.append(b)
            return frozenset(out)

        first = close({0})
        seen, order, out = {first: 0}, [first], []
        for st in order:
            to: dict[tuple, set[int]] = defaultdict(set)
            for a in st:
                for s, b in moves[a]:
                    if s is not None:
                        to[s].add(b)
            edges = {}
            for s in sorted(to):
                t = close(to[s])
                if t not in seen:
                    seen[t] = len(order)
                    order.append(t)
                edges[s] = seen[t]
            out.append((edges, last in st))
        return out

    # -- running -------------------------------------------------------

    def encode(self, tokens: list[tuple[str, int]]) -> list[int] | None:
        """Codes of (class, newline before); None if a class is unknown."""
        t = self.tokens
        try:
            return [t[w] * 2 + nl for w, nl in tokens]
        except KeyError:
            return None

    def accepts(self, codes: list[int] | None) -> bool:
        """Whether some start symbol derives the tokens (which end with EOF)."""
        if codes is None:
            return False
        table, start, n = self.table, self.start, len(codes)
        codes = [*codes, -1]
        root: list = [[], set(), set()]
        nodes: dict[tuple[int, int], list] = {}
        work = []
        for s in self.starts:
            work.append((start[s], root, 0))
        seen: set = set()
        final = self.final
        while work:
            state, node, pos = work.pop()
            while True:
                moves = table[state]
                if moves is None:
                    moves = self.row(state)
                acts = moves.get(codes[pos])
                if pos == n and node is root and state in final:
                    return True
                if acts is None:
                    break
                if len(acts) > 1:
                    key = (state, id(node), pos)
                    if key in seen:
                        break
                    seen.add(key)
                    nxt = None
                    for a in acts:
                        # one step of each choice, all but the last put aside
                        if nxt is not None:
                            work.append(nxt)
                        nxt = None
                        kind, to, nt = a
                        if kind == 0:
                            nxt = (to, node, pos + 1)
                        elif kind == 1:
                            nxt = (to, node, pos)
                        elif kind == 2:
                            g = nodes.get((nt, pos))
                            if g is None:
                                nodes[(nt, pos)] = g = [[(to, node)], set(), {(to, id(node))}]
                                nxt = (start[nt], g, pos)
                            elif (to, id(node)) not in g[2]:
                                g[2].add((to, id(node)))
                                g[0].append((to, node))
                                for p in g[1]:
                                    work.append((to, node, p))
                        elif pos not in node[1]:
                            node[1].add(pos)
                            for e in node[0]:
                                work.append((e[0], e[1], pos))
                    if nxt is None:
                        break
                    state, node, pos = nxt
                    continue
                kind, to, nt = acts[0]
                if kind == 0:
                    state = to
                    pos += 1
                elif kind == 2:
                    g = nodes.get((nt, pos))
                    if g is None:
                        nodes[(nt, pos)] = g = [[(to, node)], set(), {(to, id(node))}]
                        state, node = start[nt], g
                    else:
                        if (to, id(node)) not in g[2]:
                            g[2].add((to, id(node)))
                            g[0].append((to, node))
                            for p in g[1]:
                                work.append((to, node, p))
                        break
                elif kind == 3:
                    if pos in node[1]:
                        break
                    node[1].add(pos)
                    edges = node[0]
                    if not edges:
                        break
                    for e in edges[1:]:
                        work.append((e[0], e[1], pos))
                    state, node = edges[0]
                else:
                    state = to
        return False
