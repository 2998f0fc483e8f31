"""Functions paired with their documentation.

Tokens and comments of a file come from the language's lexer, so code quoted in
a string is never seen as code. Every function or method declaration gets a
qualified name (its classes or receiver), a normalised signature and the
comment that ends on the line directly above it (annotations, decorators or
attributes may stand between) or its Python docstring. These symbol tables are
joined per project: a declaration takes its own documentation, else that of a
documented declaration without body (overload, abstract or interface method) of
the same qualified name, by equal signature, or by the name alone if it is the
only one. Trivial documentation is filtered last.

Scale: files are spread by key and parsed once; the join is on a symbol key, and
its right side holds one row per key, so a name that a whole project uses is a
skewed left side only, which AQE splits. Files that do not parse are left out;
only files that hold a declaration are parsed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, once
from .syntax import path_language

_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_TODO = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|hack|tbd|wip|to do|to-do)\b")
MIN_WORDS = 5


def doc_words(text: str, name: str) -> int:
    """Words left without tag lines, "the" and the words of the name."""
    own = {p.lower() for p in _PARTS.findall(name)} | {name.lower(), "the"}
    lines = [x for x in (ln.strip() for ln in text.splitlines()) if not x.startswith(("@", ":"))]
    return sum(1 for ln in lines for w in _WORD.findall(ln) if w.lower() not in own)


def trivial(text: str, name: str) -> bool:
    """Missing, too short, or only a to-do notice."""
    body = "\n".join(x for x in (ln.strip() for ln in text.splitlines()) if x and not x.startswith(("@", ":")))
    return bool(_TODO.match(body)) or doc_words(text, name) < MIN_WORDS


def strip_comment(raw: str) -> str:
    """Text of a comment (or of several line comments) without its signs."""
    out = []
    for ln in raw.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        ln = ln.strip()
        ln = re.sub(r"^(?:/\*+!?|\*+/|\*+(?!/)|//+[/!]?|#+!?|--)", "", ln)
        ln = re.sub(r"\*+/$", "", ln)
        out.append(ln.strip())
    return "\n".join(out).strip("\n")


def strip_docstring(raw: str) -> str:
    m = re.match(r"(?i)[rbu]*('''|\"\"\"|'|\")", raw)
    return raw[m.end() : len(raw) - len(m[1])].replace("\r\n", "\n").strip() if m else raw


class _Lines:
    def __init__(self, src: str, comments: list[tuple[int, int]]) -> None:
        starts = [0] + [m.end() for m in re.finditer(r"\r\n|[\n\r]", src)]
        self.src, self.starts = src, starts
        self.ending: dict[int, str] = {}
        import bisect

        self.line = lambda at: bisect.bisect_right(starts, at)
        group: list[int] | None = None
        for a, b in comments:
            la, lb = self.line(a), self.line(max(a, b - 1))
            if src[starts[la - 1] : a].strip("﻿ \t\f"):
                group = None
                continue
            single = not src.startswith("/*", a)
            if single and group and group[1] == la - 1:
                group = [group[0], lb]
            else:
                group = [a, lb] if single else None
            # a block comment that code follows on its last line ends no line
            self.ending[lb] = src[group[0] if group else a : b]


def declarations(src: str, language: str, toks: list | None = None, comments: list[tuple[int, int]] | None = None) -> list[dict]:
    """Function and method declarations of a source, or of its tokens and
    comments if they are at hand."""
    from .grammars import lex

    if toks is None or comments is None:
        comments = []
        toks = lex(src, language, comments)
    at = _Lines(src, comments)
    cls = [t[0] for t in toks]
    word = lambda i: src[toks[i][3] : toks[i][4]]
    line = lambda i: at.line(toks[i][3])
    n = len(toks) - 1
    match: dict[int, int] = {}
    stack: list[int] = []
    for i, c in enumerate(cls):
        if c in ("(", "[", "{", "TPLHEAD"):
            stack.append(i)
        elif c in (")", "]", "}", "TPLTAIL") and stack:
            o = stack.pop()
            match[o], match[i] = i, o
    out: list[dict] = []

    def above(starts: list[int]) -> str | None:
        """Comment that ends right above the first line of one of these. A
        banner kept for a licence (/*!) documents no function."""
        for i in starts:
            c = at.ending.get(line(i) - 1)
            if src[at.starts[line(i) - 1] : toks[i][3]].strip("﻿ \t\f"):
                continue  # other code stands before it on its line
            if c is not None and not c.startswith("/*!") and strip_comment(c).strip():
                return strip_comment(c)
        return None

    def put(i: int, first: int, marks: list[int], owner: list[str], open_: int, body: int | None, doc: str | None = None) -> None:
        """i: the name; first: first token; marks: annotations before it."""
        close = match.get(open_, open_)
        sig = re.sub(r"\s+", " ", src[toks[open_][3] : toks[close][4]]).strip()
        end = match.get(body, body) if body is not None else close
        note = doc if doc is not None else above([first, *marks])
        out.append({
            "name": word(i), "qualified": ".".join([*owner, word(i)]), "signature": _signature(sig, language), "start_line": line(i),
            "description": note, "has_body": body is not None, "content": src[toks[first][3] : toks[end][4]],
        })

    if language == "python":
        owner: list[tuple[int, str]] = []
        depth, start, marks = 0, 0, []
        for i in range(n):
            c = cls[i]
            if c == "INDENT":
                depth += 1
            elif c == "DEDENT":
                depth -= 1
                owner = [o for o in owner if o[0] < depth]
            if c in ("NEWLINE", "INDENT", "DEDENT"):
                start = i + 1
                if c == "NEWLINE" and not (marks and cls[marks[-1]] == "@"):
                    marks = []
                continue
            if i == start:
                owner = [o for o in owner if o[0] < depth]
                if c == "@":
                    marks = [*marks, i]
                    continue
                k = i + (c == "async")
                if cls[k] == "class":
                    owner.append((depth, word(k + 1)))
                    marks = []
                elif cls[k] == "def":
                    o = k + 2
                    while o < n and cls[o] != "(":
                        o = match.get(o, o) + 1
                    b = match.get(o, n)
                    level = 0
                    while b < n and not (cls[b] == ":" and not level):
                        b = match[b] + 1 if cls[b] in "([{" else b + 1
                    d, stop, j = None, b, b + 1
                    if j < n and cls[j] == "NEWLINE" and cls[j + 1] == "INDENT":
                        j += 2
                        lv, stop = 1, j
                        while stop < n and lv:
                            lv += (cls[stop] == "INDENT") - (cls[stop] == "DEDENT")
                            stop += 1
                        stop -= 2
                    if j < n and cls[j] == "STR" and not re.match(r"(?i)[rt]*[ft]", word(j)) and cls[j + 1] in ("NEWLINE", ";"):
                        d = strip_docstring(word(j))
                    note = above([i, *marks])
                    if d is not None and (note is None or not trivial(d, word(k + 1)) or trivial(note, word(k + 1))):
                        note = d
                    put(k + 1, i, marks, [x[1] for x in owner], o, max(b, min(stop, n - 1)), note if note is not None else "")
                    owner.append((depth, word(k + 1)))
                    marks = []
                elif c not in ("@",):
                    marks = []
        return [{**o, "description": o["description"] or None} for o in out]

    if language in ("go", "rust"):
        kw = "func" if language == "go" else "fn"
        owners: list[tuple[int, str]] = []
        start = 0
        st: list[int] = []
        for i in range(n):
            c = cls[i]
            if c in "([{":
                st.append(i)
            elif c in ")]}" and st:
                st.pop()
            owners = [o for o in owners if i <= o[0]]
            if c in (";", "{", "}") and (not st or cls[st[-1]] == "{" or c == "{"):
                start = i + 1
                continue
            if language == "go" and c == "interface" and i + 1 < n and cls[i + 1] == "{":
                o = i - 1
                while o > 0 and cls[o] not in ("type", ";", "{", "}", "("):
                    o -= 1
                name = [word(o + 1)] if (cls[o] in ("type", ";") or (cls[o] == "(" and cls[o - 1] == "type")) and cls[o + 1] == "ID" and o + 1 < i else []
                k = i + 2
                while k < match[i + 1]:
                    if cls[k] == "ID" and cls[k + 1] == "(" and cls[k - 1] in ("{", ";"):
                        put(k, k, [], name, k + 1, None)
                    k = match[k] + 1 if cls[k] in "([{" else k + 1
            if language == "rust" and c in ("impl", "trait", "mod") and i + 1 < n:
                j = i + 1
                while j < n and cls[j] not in ("{", ";"):
                    j += 1
                if j < n and cls[j] == "{" and j in match:
                    owners.append((match[j], re.sub(r"\s+", " ", src[toks[i + 1][3] : toks[j][3]]).strip().rpartition(" for ")[2]))
            if c == kw:
                k, own = i + 1, [o[1] for o in owners]
                if language == "go" and cls[k] == "(" and not st:
                    own = [re.sub(r"^\(\s*(?:\w+\s+)?\*?|\)$|\[.*", "", src[toks[k][3] : toks[match[k]][4]])]
                    k = match[k] + 1
                elif language == "go" and st:
                    continue
                if k < n and cls[k] in ("ID", "union", "auto", "default", "raw", "safe") and not (language == "go" and st):
                    o = k + 1
                    while o < n and cls[o] not in ("(", "{", ";"):
                        o += 1
                    if o >= n or cls[o] != "(":
                        continue
                    b = match[o] + 1
                    while b < n and cls[b] not in ("{", ";"):
                        b = match[b] + 1 if cls[b] in "([" else b + 1
                        if language == "go" and b < n and cls[b] == "{" and cls[b - 1] in ("interface", "struct"):
                            b = match[b] + 1
                    j, marks = start, []
                    while language == "rust" and j < i and cls[j] == "#":
                        marks.append(j)
                        j = match.get(j + 1, j + 1) + 1
                    put(k, j, marks, own, o, b if b < n and cls[b] == "{" else None)
        return out

    if language == "java":
        _java(cls, match, n, put, word)
    else:
        _script(cls, match, n, put, word, toks)
    return out


def _signature(sig: str, language: str) -> str:
    """Parameter types (or the number of parameters) without names."""
    inner, parts, depth, cur = sig[1:-1], [], 0, ""
    for ch in inner:
        depth += (ch in "([{<") - (ch in ")]}>")
        if ch == "," and not depth:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    parts = [p.strip() for p in [*parts, cur] if p.strip()]
    types = []
    for p in parts:
        p = re.sub(r"@\w+(?:\([^)]*\))?\s*|\bfinal\s+", "", p.split("=")[0]).strip()
        if language in ("typescript", "rust", "python") and ":" in p:
            types.append(re.sub(r"\s", "", p.partition(":")[2]))
        elif language in ("java", "go") and " " in p:
            types.append(re.sub(r"\s", "", p.rpartition(" ")[0] if language == "java" else p.partition(" ")[2]))
        else:
            types.append("_")
    return "(" + ",".join(types) + ")"


def _marks(cls: list[str], match: dict[int, int], i: int, end: int) -> tuple[int, list[int]]:
    """Skips annotations from i: (first token after them, their tokens)."""
    marks = []
    while i < end and cls[i] == "@" and cls[i + 1] != "interface":
        marks.append(i)
        i += 2
        while i < end and cls[i] == ".":
            i += 2
        if i < end and cls[i] == "(":
            i = match[i] + 1
    return i, marks


_JAVA_MOD = {"public", "protected", "private", "static", "abstract", "final", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}


def _java(cls, match, n, put, word) -> None:
    def bodies(lo: int, hi: int, owner: list[str]) -> None:
        """Local, anonymous and constant-specific classes in code."""
        i = lo
        while i < hi:
            b = None
            if cls[i] in ("class", "interface", "enum") and cls[i - 1] != "." and cls[i + 1] == "ID":
                b = i + 1
                while b < hi and cls[b] not in ("{", ";"):
                    b = match[b] + 1 if cls[b] in "([" else b + 1
                name = word(i + 1)
            elif cls[i] == "record" and i + 2 < hi and cls[i + 1] == "ID" and cls[i + 2] in ("(", "<") and cls[i - 1] in (";", "{", "}", "final"):
                b = i + 2
                while b < hi and cls[b] not in ("{", ";"):
                    b = match[b] + 1 if cls[b] in "([" else b + 1
                name = word(i + 1)
            elif cls[i] == "new":
                b = i + 1
                while b < hi and cls[b] not in ("(", "[", "{", ";", ")", "}", ","):
                    b += 1
                b = match[b] + 1 if b < hi and cls[b] == "(" else hi
                name = ""
                bodies(i + 1, min(b, hi), owner)
            if b is not None and b < hi and cls[b] == "{":
                start = b + 1
                if cls[i] == "enum":
                    start = constants(b, [*owner, name])
                members(start, match[b], [*owner, name] if name else owner)
                i = match[b] + 1
            elif cls[i] == "new" and b is not None:
                i = max(i + 1, min(b, hi))
            else:
                i += 1

    def constants(b: int, owner: list[str]) -> int:
        """Bodies of the constants of an enum; where its members begin."""
        k = b + 1
        while k < match[b] and cls[k] != ";":
            if cls[k] == "{":
                members(k + 1, match[k], owner)
            elif cls[k] == "(":
                bodies(k + 1, match[k], owner)
            k = match[k] + 1 if cls[k] in "([{" else k + 1
        return k

    def members(lo: int, hi: int, owner: list[str]) -> None:
        i = lo
        while i < hi:
            if cls[i] in (";", "}", ","):
                i += 1
                continue
            j, marks = _marks(cls, match, i, hi)
            first = j
            k = j
            name = None
            while k < hi:
                if cls[k] == "@" and cls[k + 1] != "interface":
                    k, more = _marks(cls, match, k, hi)
                    marks += more
                    continue
                if cls[k] in ("class", "interface", "enum") or (cls[k] == "record" and k + 2 < hi and cls[k + 1] == "ID" and cls[k + 2] in ("(", "<")):
                    b = k
                    while b < hi and cls[b] != "{":
                        b += 1
                    if b >= hi:
                        return
                    inner = constants(b, [*owner, word(k + 1)]) if cls[k] == "enum" else b + 1
                    members(inner, match[b], [*owner, word(k + 1)])
                    i = match[b] + 1
                    break
                if cls[k] == "(":
                    name = k - 1
                    b = match[k] + 1
                    while b < hi and cls[b] not in ("{", ";"):
                        b = match[b] + 1 if cls[b] in "([" else b + 1
                    if cls[name] in ("ID", "record", "open", "with", "to", "module", "var", "yield", "when", "exports", "opens", "uses", "provides", "requires", "permits", "transitive", "sealed", "non"):
                        put(name, first, marks, owner, k, b if b < hi and cls[b] == "{" else None)
                    if b < hi and cls[b] == "{":
                        bodies(b + 1, match[b], owner)
                    i = (match[b] if b < hi and cls[b] == "{" else b) + 1
                    break
                if cls[k] == "{":
                    bodies(k + 1, match[k], owner)
                    i = match[k] + 1
                    break
                if cls[k] in ("=", ";"):
                    at = k
                    while k < hi and cls[k] != ";":
                        k = match[k] + 1 if cls[k] in "([{" else k + 1
                    bodies(at, k, owner)
                    i = k + 1
                    break
                k += 1
            else:
                return

    members(0, n, [])


_JS_MOD = {"static", "async", "get", "set", "accessor", "public", "private", "protected", "readonly", "abstract", "override", "declare", "*"}
_JS_STOP = {"if", "for", "while", "switch", "catch", "with", "function", "return", "super", "new", "typeof", "await", "import"}


def _script(cls, match, n, put, word, toks) -> None:
    kinds: dict[int, tuple[str, str]] = {}  # open brace -> (class | object | block, name)
    for i in range(n):
        if cls[i] == "class" and (i == 0 or cls[i - 1] not in (".", "?.")):
            b = i + 1
            while b < n and cls[b] != "{":
                b = match[b] + 1 if cls[b] in "([" else b + 1
            if b < n:
                kinds[b] = ("class", word(i + 1) if cls[i + 1] not in ("{", "extends", "implements") else "")
        elif cls[i] == "interface" and i + 1 < n and cls[i + 1] not in ("=", ".", "(", ":", ",", ")", ";"):
            b = i + 1
            while b < n and cls[b] not in ("{", ";"):
                b += 1
            if b < n and cls[b] == "{":
                kinds[b] = ("class", word(i + 1))
    opens: list[int] = []
    start = 0

    def owners() -> list[str]:
        return [kinds[o][1] for o in opens if o in kinds and kinds[o][1]]

    def is_name(i: int) -> bool:
        return cls[i] not in ("NUM", "STR") and (cls[i] == "PRIV" or word(i)[:1].isalpha() or word(i)[:1] in "_$")

    def skip_types(i: int) -> int:
        """After type parameters in angle brackets."""
        if cls[i] != "<":
            return i
        d = 0
        while i < n:
            d += (cls[i] == "<") - (cls[i] == ">")
            i = match[i] + 1 if cls[i] in "([{" else i + 1
            if not d:
                break
        return i

    def function_value(i: int) -> tuple[int, int | None] | None:
        """(open parenthesis, body) if a function expression begins here."""
        if i < n and cls[i] == "async":
            i += 1
        if i < n and cls[i] == "function":
            i += 1
            while i < n and cls[i] != "(":
                i += 1
            b = match.get(i, n) + 1
            while b < n and cls[b] != "{":
                b += 1
            return (i, b) if b < n else None
        i = skip_types(i) if i < n else i
        if i < n and cls[i] == "(" and i in match:
            j = match[i] + 1
            if j < n and cls[j] == ":":
                while j < n and cls[j] not in ("=>", ";", "="):
                    j = match[j] + 1 if cls[j] in "([{" else j + 1
            if j < n and cls[j] == "=>":
                return i, j + 1
        elif i + 1 < n and cls[i + 1] == "=>":
            return i, i + 2
        return None

    i = 0
    while i < n:
        c = cls[i]
        top = opens[-1] if opens else None
        kind = kinds.get(top, ("", ""))[0] if top is not None else ""
        if c in ("(", "[", "{", "TPLHEAD"):
            opens.append(i)
            if c == "{":
                start = i + 1
            i += 1
            continue
        if c in (")", "]", "}", "TPLTAIL"):
            if opens:
                opens.pop()
            if c == "}":
                start = i + 1
            i += 1
            continue
        if c == ";" or (c == "," and top is not None and cls[top] == "{" and kind != "class"):
            start = i + 1
            i += 1
            continue
        fresh = i == start or (toks[i][1] and (top is None or cls[top] == "{") and kind != "class" and cls[i - 1] not in ("=", "=>", ",", "(", "export", "default", "async", ".", "@"))
        if fresh and i != start and cls[i] not in ("function",):
            j0, m0 = _marks(cls, match, start, i)
            if j0 < i or not m0:
                start = i
        if kind == "class":
            # one member
            j, marks = _marks(cls, match, i, n)
            first = k = j
            while k < n and cls[k] in _JS_MOD and not (cls[k + 1] in ("(", "=", ":", ";", "?", "!", "<", "}", ",")) :
                k += 1
            if k < n and cls[k] == "[":
                k = match[k]
            nxt = k + 1
            if nxt < n and cls[nxt] in ("?", "!"):
                nxt += 1
            nxt = skip_types(nxt) if nxt < n else nxt
            if nxt < n and cls[nxt] == "(" and cls[k] != "(":
                b = match[nxt] + 1
                if b < n and cls[b] == ":":
                    b += 1
                    while b < n and not (cls[b] == "{" and cls[b - 1] not in (":", "|", "&", "<", "=>", ",")) and cls[b] not in (";", "}") and not (toks[b][1] and cls[b - 1] not in (":", "|", "&", "=>")):
                        b = match[b] + 1 if cls[b] in "([{" else b + 1
                body = b if b < n and cls[b] == "{" else None
                if is_name(k):
                    put(k, first, marks, owners(), nxt, body)
                i = b if body is not None else (b + 1 if b < n and cls[b] in (";", ",") else b)
                if body is not None:
                    opens.append(b)
                    start = i = b + 1
                continue
            if cls[k] == "static" and nxt < n and cls[nxt] == "{":
                i = nxt
                continue
            # a field: up to its end
            e = nxt
            while e < n and cls[e] not in ("=", ";", "}") and not (toks[e][1] and e > nxt):
                e = match[e] + 1 if cls[e] in "([{" else e + 1
            if e < n and cls[e] == "=":
                v = function_value(e + 1)
                if v and is_name(k):
                    put(k, first, marks, owners(), v[0], v[1])
                e += 1
                while e < n and cls[e] not in (";", "}") and not (toks[e][1] and cls[e - 1] not in ("=", "=>", "+", "&&", "||", "?", ":") and cls[e] not in (".", "?.", "?", ":", "+", "&&", "||")):
                    if cls[e] == "{" or cls[e] == "(":
                        pass
                    e = match[e] + 1 if cls[e] in ("(", "[", "{", "TPLHEAD") else e + 1
            i = max(i + 1, e + 1 if e < n and cls[e] == ";" else e)
            start = i
            continue
        first, marks = start, []
        if c == "function" and i + 1 < n:
            k = i + 1 + (cls[i + 1] == "*")
            prev = cls[i - 1] if i else ";"
            if k < n and is_name(k) and cls[k] != "(" and prev not in ("=", "(", ",", ":", "=>", "return"):
                o = skip_types(k + 1)
                if o < n and cls[o] == "(":
                    first, marks = _marks(cls, match, start, i)
                    b = match[o] + 1
                    while b < n and cls[b] not in ("{", ";") and not (toks[b][1] and cls[b - 1] not in (":", "|", "&", "=>")):
                        b = match[b] + 1 if cls[b] in "([" else b + 1
                        if b < n and cls[b] == "{" and cls[b - 1] in (":", "|", "&", "<", "=>"):
                            b = match[b] + 1
                    put(k, first, marks, owners(), o, b if b < n and cls[b] == "{" else None)
                    i = o
                    continue
        elif c in ("const", "let", "var") and i + 1 < n and is_name(i + 1) and (i == start or all(x in ("export", "declare", "default") for x in cls[start:i])):
            e = i + 2
            while e < n and cls[e] not in ("=", ";", ",") and not (toks[e][1] and cls[e] not in (":", "|", "&", "=>")):
                e = match[e] + 1 if cls[e] in "([{" else e + 1
            v = function_value(e + 1) if e < n and cls[e] == "=" else None
            if v:
                put(i + 1, start, [], owners(), v[0], v[1])
        elif i == start and i + 3 < n and cls[i + 1] == "." and (is_name(i) or c == "this") and kind != "class" and c not in _JS_STOP:
            # a function given to a property: exports.read = ..., A.prototype.read = ...
            k, path = i, [word(i)]
            while k + 2 < n and cls[k + 1] == "." and is_name(k + 2):
                k += 2
                path.append(word(k))
            v = function_value(k + 2) if k + 1 < n and cls[k + 1] == "=" else None
            if v:
                owner = [p for p in path[:-1] if p not in ("prototype", "module", "exports", "this")]
                put(k, start, [], [*owners(), *owner], v[0], v[1])
                i = v[0]
                continue
        elif top is not None and cls[top] == "{" and i == start and is_name(i) and c not in _JS_STOP:
            # shorthand method or function property of an object
            k = i
            while k < n and cls[k] in ("async", "get", "set", "*") and cls[k + 1] not in ("(", ":", ","):
                k += 1
            o = skip_types(k + 1) if k + 1 < n and cls[k + 1] == "<" else k + 1
            prev = cls[top - 1] if top else ""
            if prev in ("=", "(", ",", ":", "return", "[", "=>", "default") and k < n and is_name(k):
                if o < n and cls[o] == "(" and match.get(o, n) + 1 < n and cls[match[o] + 1] in ("{", ":"):
                    b = match[o] + 1
                    while b < n and cls[b] != "{":
                        b += 1
                    put(k, i, [], owners(), o, b if b < n else None)
                elif o < n and cls[o] == ":":
                    v = function_value(o + 1)
                    if v:
                        put(k, i, [], owners(), v[0], v[1])
        i += 1


def described(src: str, language: str) -> list[dict]:
    """Declarations, or none where the source does not parse. It is read once."""
    from .grammars import accepts, read
    from .lexers import LexError

    src = src.removeprefix("﻿")
    if not src.strip():
        return []
    comments: list[tuple[int, int]] = []
    fields: list[tuple[int, int]] = []
    try:
        toks = read(src, language, comments, fields)
    except LexError:
        return []
    try:
        got = declarations(src, language, toks, comments)
    except (KeyError, IndexError, RecursionError):
        # brackets that do not match; of a text that parses it is our fault
        if accepts(src, language, toks, fields):
            raise
        return []
    return got if got and accepts(src, language, toks, fields) else []


_SCHEMA = (
    "file_id bigint, project_id string, name string, qualified string, signature string, start_line int, description string, has_body boolean, content string, "
    "n int, trivial boolean, error string"
)


def symbol_table(files: DataFrame, content: bool = True) -> DataFrame:
    """One row per function or method declaration of the files that parse; n
    numbers them in a file. A file that parses but can't be scanned gives one row
    with ``error`` and no name, so that none is lost without a word. ``content``
    can be left out (null)."""
    rows = once(files.select("file_id", "project_id", "file_path", "content").filter("file_id IS NOT NULL AND content IS NOT NULL"), "file_id")
    rows = rows.withColumn("language", path_language(F.col("file_path"))).filter("language IS NOT NULL")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in _SCHEMA.split(", ")]
        for f in frames:
            out = []
            for fid, pid, text, lang in zip(f["file_id"], f["project_id"], f["content"], f["language"]):
                try:
                    got = described(text, lang)
                except (KeyError, IndexError, RecursionError) as e:
                    out.append({"file_id": fid, "project_id": pid, "n": -1, "error": repr(e)[:200]})
                    continue
                for n, d in enumerate(got):
                    note = d["description"]
                    out.append({**d, "file_id": fid, "project_id": pid, "n": n, "content": d["content"] if content else None, "trivial": note is None or trivial(note, d["name"])})
            yield pd.DataFrame([[d.get(c) for c in cols] for d in out], columns=cols, dtype=object)

    return rows.drop("file_path").mapInPandas(read, _SCHEMA)


def unread_files(files: DataFrame) -> DataFrame:
    """(file_id, error) of the files that parse but could not be scanned."""
    return symbol_table(files, content=False).filter("error IS NOT NULL").select("file_id", "error")


def functions_with_docs(files: DataFrame, content: bool = True) -> DataFrame:
    """file_id, project_id, name, qualified, signature, start_line, content,
    description, origin ("own", or "declaration" where the documentation was
    taken from a separate declaration).

    Every declaration is joined with the documentation that is known under its
    symbol: the comment of the declaration itself, that of a declaration without
    body of equal signature, or of the only such one of the name. The best counts
    (a telling one first, then the nearest), and trivial ones are filtered last.

    ``files`` has file_id, project_id, file_path and content. Null ids, null or
    empty texts and other languages give no rows; repeated rows count once;
    other columns are ignored.
    """
    s = cut(symbol_table(files, content).filter("error IS NULL"))
    project = F.coalesce("project_id", F.lit("\0"))
    own = F.concat_ws("\0", F.lit("o"), "file_id", "n")
    by_sig, by_name = (F.concat_ws("\0", F.lit(k), project, "qualified", *c) for k, c in (("s", ["signature"]), ("q", [])))
    noted = s.filter("description IS NOT NULL").select("project_id", "qualified", "signature", "file_id", "n", "description", "trivial", "has_body")
    # of separate declarations one per signature, and the one of the name
    apart = noted.filter("NOT has_body").groupBy("project_id", "qualified", "signature").agg(F.min(F.struct("trivial", "file_id", "n", "description")).alias("d")).select("project_id", "qualified", "signature", "d.*")
    alone = apart.filter("NOT trivial").groupBy("project_id", "qualified").agg(F.count(F.lit(1)).alias("c"), F.first("description").alias("description")).filter("c = 1")
    docs = (
        noted.select(own.alias("key"), "description", "trivial")
        .union(apart.select(by_sig, "description", "trivial"))
        .union(alone.select(by_name, "description", F.lit(False)))
    )
    keys = F.when(F.col("has_body"), F.array(own, by_sig, by_name)).otherwise(F.array(own))
    known = s.select("file_id", "n", F.posexplode(keys).alias("rank", "key")).join(docs, "key")
    best = known.groupBy("file_id", "n").agg(F.min(F.struct("trivial", "rank", "description")).alias("d")).select("file_id", "n", "d.*")
    full = s.drop("description", "trivial").join(best, ["file_id", "n"])
    return full.filter("NOT trivial").select(
        "file_id", "project_id", "name", "qualified", "signature", "start_line", "content", "description", F.when(F.col("rank") == 0, "own").otherwise("declaration").alias("origin")
    )
