"""Lexers of the supported languages.

Each returns (class, newline before, line, start, end) per token and EOF, or
None where no token can be read (an unended string or comment, a stray
character). Comments are left out of the tokens and reported through
``comments`` where a list is given: (start, end).
"""

from __future__ import annotations

import re

Token = tuple[str, int, int, int, int]


class LexError(Exception):
    pass


def _ops(s: str) -> str:
    return "|".join(re.escape(x) for x in sorted(s.split(), key=len, reverse=True))


_ID = r"[^\W\d]\w*"
JS_RE = re.compile(
    r"(?P<ws>[ \t\f\v ﻿]+)|(?P<nl>\r\n|[\n\r  ])|(?P<line>//[^\n\r  ]*)|(?P<block>/\*)"
    r"|(?P<num>(?:0[xX][\da-fA-F]+(?:_[\da-fA-F]+)*|0[oO][0-7]+(?:_[0-7]+)*|0[bB][01]+(?:_[01]+)*)n?|(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?n?)"
    r"|(?P<str>'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\")"
    rf"|(?P<id>(?:[$_]|[^\W\d]|\\u[\da-fA-F]{{4}})(?:[$‌‍]|\w|\\u[\da-fA-F]{{4}})*)|(?P<priv>#[$_\w]+)"
    r"|(?P<tpl>`)|(?P<op>" + _ops("{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= => . ... @ #") + ")"
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_TPL = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_VALUE_END = {"ID", "NUM", "STR", "REGEX", "TPLFULL", "TPLTAIL", ")", "]", "}", "this", "super", "null", "true", "false", "PRIV", "++", "--"}


def lex_js(src: str, keywords: frozenset[str], comments: list | None = None) -> list[Token]:
    out: list[Token] = []
    at, n, nl, line = 0, len(src), 1, 1
    stack: list[str] = []
    parens: list[bool] = []
    before_head = False
    if src.startswith("#!"):
        m = re.match(r"#![^\n\r]*", src)
        at = m.end()

    def template(start: int, head: bool) -> int:
        nonlocal line
        e = _TPL.match(src, start).end()
        line += src.count("\n", start, e)
        if e >= n:
            raise LexError("unended template")
        if src[e] == "`":
            out.append(("TPLFULL" if head else "TPLTAIL", nl, first, at0, e + 1))
            return e + 1
        out.append(("TPLHEAD" if head else "TPLMID", nl, first, at0, e + 2))
        stack.append("$")
        return e + 2

    while at < n:
        c = src[at]
        if c == "/" and src[at + 1 : at + 2] not in ("/", "*"):
            last = out[-1][0] if out else None
            value = last in _VALUE_END or (last is not None and last not in keywords and last[0].isalpha() and last not in ("TPLHEAD", "TPLMID", "EOF") and last.islower() and last in _SOFT)
            if last == ")":
                value = not before_head
            m = None if value else _REGEX.match(src, at)
            if m is None and last == "}":
                m = None
            if m:
                out.append(("REGEX", nl, line, at, m.end()))
                at, nl = m.end(), 0
                continue
        m = JS_RE.match(src, at)
        if m is None:
            raise LexError(f"stray {c!r}")
        kind, e = m.lastgroup, m.end()
        if kind == "ws":
            at = e
        elif kind == "nl":
            nl, line, at = 1, line + 1, e
        elif kind == "line":
            if comments is not None:
                comments.append((at, e))
            at = e
        elif kind == "block":
            e = src.find("*/", at + 2)
            if e < 0:
                raise LexError("unended comment")
            if comments is not None:
                comments.append((at, e + 2))
            k = src.count("\n", at, e)
            line += k
            nl = 1 if k else nl
            at = e + 2
        elif kind == "tpl":
            first, at0 = line, at
            at = template(e, True)
            nl = 0
        else:
            w = m.group()
            if kind == "op":
                cls = w
                if w == "?." and src[e : e + 1].isdigit():
                    cls, e = "?", at + 1
                if w in "([{":
                    stack.append(w)
                    if w == "(":
                        parens.append(bool(out) and out[-1][0] in ("if", "while", "for", "with", "await") and (out[-1][0] != "await" or len(out) > 1 and out[-2][0] == "for"))
                elif w in ")]}":
                    if not stack:
                        raise LexError("unmatched")
                    o = stack.pop()
                    if o == "$":
                        if w != "}":
                            raise LexError("unmatched")
                        first, at0 = line, at
                        at = template(e, False)
                        nl = 0
                        continue
                    if "([{".index(o) != ")]}".index(w):
                        raise LexError("unmatched")
                    if w == ")":
                        before_head = parens.pop()
            elif kind == "id":
                cls = w if w in keywords or w in _SOFT else "ID"
            elif kind == "num":
                cls = "NUM"
                if re.match(r"[\w$]", src[e : e + 1]) or (re.match(r"0\d", w) and re.search(r"[89.en_]", w) and not re.fullmatch(r"0\d*[89]\d*", w)):
                    raise LexError("number")
            elif kind == "priv":
                cls = "PRIV"
            else:
                cls = "STR"
            out.append((cls, nl, line, at, e))
            if kind == "str":
                line += w.count("\n")
            at, nl = e, 0
    if stack:
        raise LexError("unclosed")
    out.append(("EOF", 1, line, n, n))
    return out


#: words that are names except where the grammar gives them a meaning
_SOFT = frozenset(
    "async of get set static from as let yield await type declare readonly abstract public private protected override accessor interface namespace module global "
    "keyof unique infer is asserts satisfies require implements enum_ target meta any_ out".split()
)

JAVA_RE = re.compile(
    r"(?P<ws>[ \t\f]+)|(?P<nl>\r\n|[\n\r])|(?P<line>//[^\n\r]*)|(?P<block>/\*)"
    r"|(?P<text>\"\"\"[ \t\f]*[\n\r](?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\")|(?P<str>\"(?:[^\"\\\n\r]|\\(?:u+[\da-fA-F]{4}|[btnfrs0-7\"'\\\\]))*\")|(?P<chr>'(?:[^'\\\n\r]|\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|[btnfrs\"'\\\\]))[\udc00-\udfff]?')"
    r"|(?P<num>0[xX](?:[\da-fA-F][\da-fA-F_]*)?(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01][01_]*[lL]?|(?:\d[\d_]*(?:\.(?!\.)\d*[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[lLfFdD]?)"
    rf"|(?P<id>(?:\$|{_ID[:-3]})(?:\$|\w)*)|(?P<op>" + _ops("{ } ( ) [ ] ; , . ... @ :: = == != < > <= >= + - * / % ++ -- << & | ^ ! ~ && || ? : += -= *= /= %= <<= >>= >>>= &= |= ^= ->") + ")"
)
GO_RE = re.compile(
    r"(?P<ws>[ \t\r]+)|(?P<nl>\n)|(?P<line>//[^\n]*)|(?P<block>/\*)"
    r"|(?P<raw>`[^`]*`)|(?P<str>\"(?:[^\"\\\n]|\\(?:[abfnrtv\\\"]|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}))*\")|(?P<chr>'(?:[^'\\\n]|\\(?:[abfnrtv\\']|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}))')"
    r"|(?P<num>(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?)"
    rf"|(?P<id>{_ID})|(?P<op>" + _ops("{ } ( ) [ ] ; , . ... : := = == != < > <= >= + - * / % ++ -- << >> & &^ | ^ ! && || <- += -= *= /= %= <<= >>= &= &^= |= ^= ~") + ")"
)
RUST_RE = re.compile(
    r"(?P<ws>[ \t\r\f]+)|(?P<nl>\n)|(?P<line>//[^\n]*)|(?P<block>/\*)"
    r"|(?P<raw>(?:br|cr|r)(#*)\"[\s\S]*?\"\2)|(?P<str>[bc]?\"(?:[^\"\\]|\\[\s\S])*\")|(?P<chr>b?'(?:[^'\\\n\t]|\\(?:x[\da-fA-F]{2}|u\{[\da-fA-F_]{1,8}\}|[nrt\\0'\"]))')|(?P<life>'[^\W\d]\w*)"
    r"|(?P<num>0x[\da-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0b[01_]+(?:[iu](?:8|16|32|64|128|size))?|0o[0-7_]+(?:[iu](?:8|16|32|64|128|size))?|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[iu](?:8|16|32|64|128|size)|f32|f64)?)"
    rf"|(?P<id>(?:r#)?{_ID})|(?P<op>" + _ops("{ } ( ) [ ] ; , . .. ... ..= : :: = == != < > <= >= + - * / % << & | ^ ! && += -= *= /= %= <<= &= |= ^= -> => # $ ? @ ~") + ")"
)
_GO_END = {"ID", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}


def lex_c(src: str, regex: re.Pattern, keywords: frozenset[str], comments: list | None = None, go: bool = False, rust: bool = False, soft: frozenset[str] = frozenset()) -> list[Token]:
    out: list[Token] = []
    at, n, nl, line = 0, len(src), 1, 1
    stack: list[str] = []
    if rust and src.startswith("#!") and not src.startswith("#!["):
        at = re.match(r"#![^\n]*", src).end()

    def newline() -> None:
        if go and out and out[-1][0] in _GO_END:
            out.append((";", nl, line, at, at))

    while at < n:
        m = regex.match(src, at)
        if m is None:
            raise LexError(f"stray {src[at]!r}")
        kind, e = m.lastgroup, m.end()
        if kind == "ws":
            at = e
            continue
        if kind == "nl":
            newline()
            nl, line, at = 1, line + 1, e
            continue
        if kind == "line":
            if comments is not None:
                comments.append((at, e))
            at = e
            continue
        if kind == "block":
            e = src.find("*/", at + 2)
            if rust and e >= 0:
                depth, p = 1, at + 2
                for b in re.finditer(r"/\*|\*/", src[at + 2 :]):
                    depth += 1 if b.group() == "/*" else -1
                    p = at + 2 + b.end()
                    if not depth:
                        break
                e = p - 2 if not depth else -1
            if e < 0:
                raise LexError("unended comment")
            if comments is not None:
                comments.append((at, e + 2))
            k = src.count("\n", at, e)
            if k:
                newline()
                nl = 1
            line += k
            at = e + 2
            continue
        w = m.group()
        if kind == "op":
            cls = w
            if w in "([{":
                stack.append(w)
            elif w in ")]}":
                if not stack or "([{".index(stack.pop()) != ")]}".index(w):
                    raise LexError("unmatched")
        elif kind == "id":
            cls = w if w in keywords or w in soft else "ID"
        elif kind == "num":
            cls = "NUM"
            if re.match(r"\w", src[e : e + 1]) and not (rust and re.match(r"[A-Za-z_]", src[e]) and not re.match(r"0[\dA-Za-z]", w)):
                raise LexError("number")
            if (go or not rust) and re.match(r"0[0-7_]*[89]", w) and not re.search(r"[.eEfFdDi]", w):
                raise LexError("octal")
        elif kind == "life":
            cls = "LIFE"
        else:
            cls = "STR"
        out.append((cls, nl, line, at, e))
        line += w.count("\n") if kind in ("text", "raw", "str") else 0
        at, nl = e, 0
    newline()
    if stack:
        raise LexError("unclosed")
    out.append(("EOF", 1, line, n, n))
    return out


PY_STR = re.compile(r"(?i:(?P<pre>rb|br|fr|rf|tr|rt|[rbfut])?)(?P<q>\"\"\"|'''|\"|')")
PY_RE = re.compile(
    r"(?P<ws>[ \t\f]+|\\\r?\n)|(?P<nl>\r\n|[\n\r])|(?P<line>#[^\n\r]*)"
    r"|(?P<num>(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))"
    rf"|(?P<id>{_ID})|(?P<op>" + _ops("{ } ( ) [ ] ; , . ... : := = == != < > <= >= + - * / // % ** @ << >> & | ^ ~ -> += -= *= /= //= %= **= @= <<= >>= &= |= ^=") + ")"
)


def _py_string(src: str, m: re.Match, fields: list[tuple[int, int]]) -> int:
    """End of the string literal; ``fields`` gets the expressions of an
    f-string."""
    pre, q, at, n = (m["pre"] or "").lower(), m["q"], m.end(), len(src)
    raw, f, long = "r" in pre, "f" in pre or "t" in pre, len(q) == 3
    while at < n:
        c = src[at]
        if src.startswith(q, at):
            return at + len(q)
        if c == "\\":
            if "b" not in pre and not raw and not f:
                esc = src[at + 1 : at + 2]
                want = {"x": r"[\da-fA-F]{2}", "u": r"[\da-fA-F]{4}", "U": r"00(?:0[\da-fA-F]|10)[\da-fA-F]{4}", "N": r"\{[^}]+\}"}.get(esc)
                if want and not re.match(want, src[at + 2 : at + 60]):
                    raise LexError("escape")
            if f and src[at + 1 : at + 2] in ("{", "}"):
                at += 1  # a brace is no part of an escape
                continue
            if f and not raw and src.startswith("N{", at + 1) and "}" in src[at:]:
                at = src.index("}", at) + 1
                continue
            at += 3 if src[at + 1 : at + 3] == "\r\n" else 2
        elif c in "\n\r" and not long:
            raise LexError("unended string")
        elif f and c == "{":
            if src[at + 1 : at + 2] == "{":
                at += 2
                continue
            at = _py_field(src, at + 1, fields, q)
        elif f and c == "}":
            if src[at + 1 : at + 2] != "}":
                raise LexError("single }")
            at += 2
        else:
            at += 1
    raise LexError("unended string")


def _py_field(src: str, at: int, fields: list[tuple[int, int]], q: str) -> int:
    """End of a replacement field that began before ``at``."""
    start, depth, n = at, 0, len(src)
    while at < n:
        c = src[at]
        m = PY_STR.match(src, at)
        if m and (c in "'\"" or not (at > start and (src[at - 1].isalnum() or src[at - 1] == "_"))):
            if src.startswith(q, at) and c in "'\"" and len(q) == 3:
                raise LexError("unended field")
            at = _py_string(src, m, fields)
            continue
        if c in "([{":
            depth += 1
        elif c in ")]" or (c == "}" and depth):
            depth -= 1
        elif not depth and (c == "}" or c == ":" or (c == "!" and src[at + 1 : at + 2] != "=")):
            end = at
            text = src[start:end].rstrip()
            if text.endswith("=") and not text.endswith(("==", "!=", "<=", ">=")):
                end = start + len(text) - 1
            fields.append((start, end))
            if c == "!":
                m = re.compile(r"![rsa]\s*(?=[:}])").match(src, at)
                if not m:
                    raise LexError("conversion")
                at = m.end()
                c = src[at]
            if c == ":":
                at += 1
                while at < n and src[at] != "}":
                    if src[at] in "\n\r" and len(q) == 1:
                        raise LexError("unended field")
                    at = _py_field(src, at + 1, fields, q) if src[at] == "{" else at + 1
                if at >= n:
                    raise LexError("unended field")
            return at + 1
        elif c in "\n\r" and len(q) == 1 and False:
            raise LexError("newline")
        at += 1
    raise LexError("unended field")


def lex_py(src: str, keywords: frozenset[str], comments: list | None = None, soft: frozenset[str] = frozenset(), expression: bool = False, fields: list | None = None) -> list[Token]:
    out: list[Token] = []
    if "\0" in src:
        raise LexError("null byte")
    at, n, line = 0, len(src), 1
    indents, stack, bol = [(0, 0)], [], not expression
    fields = [] if fields is None else fields
    while at < n:
        if bol and not stack:
            m = re.compile(r"[ \t\f]*").match(src, at)
            e = m.end()
            rest = src[e : e + 1]
            if rest in ("\n", "\r", "#", ""):
                at = e
                bol = False
                if rest == "#":
                    c = re.compile(r"#[^\n\r]*").match(src, e)
                    if comments is not None:
                        comments.append((e, c.end()))
                    at = c.end()
                if at < n:
                    at += 2 if src.startswith("\r\n", at) else 1
                    line += 1
                    bol = True
                continue
            if not (rest == "\\" and re.match(r"\\\r?\n", src[e : e + 3])):
                ws = m.group().rpartition("\f")[2]
                col, alt = 0, 0
                for ch in ws:
                    col, alt = (col // 8 * 8 + 8, alt + 1) if ch == "\t" else (col + 1, alt + 1)
                if col > indents[-1][0]:
                    if alt <= indents[-1][1]:
                        raise LexError("tabs")
                    indents.append((col, alt))
                    out.append(("INDENT", 1, line, e, e))
                else:
                    while col < indents[-1][0]:
                        indents.pop()
                        out.append(("DEDENT", 1, line, e, e))
                    if col != indents[-1][0] or alt != indents[-1][1]:
                        raise LexError("indent")
                at = e
                bol = False
                if at >= n:
                    break
        m = PY_STR.match(src, at)
        if m:
            e = _py_string(src, m, fields)
            w = (m["pre"] or "").lower()
            out.append(("BYTES" if "b" in w else "STR", 0, line, at, e))
            line += src.count("\n", at, e)
            at = e
            continue
        m = PY_RE.match(src, at)
        if m is None:
            raise LexError(f"stray {src[at]!r}")
        kind, e = m.lastgroup, m.end()
        if kind == "nl":
            if not stack and not expression and out and out[-1][0] not in ("NEWLINE", "INDENT", "DEDENT"):
                out.append(("NEWLINE", 0, line, at, e))
            bol = not stack and not expression
            line += 1
        elif kind == "ws":
            line += "\n" in m.group()
        elif kind == "line":
            if comments is not None:
                comments.append((at, e))
        else:
            w = m.group()
            cls = w
            if kind == "num":
                cls = "NUM"
                if (re.fullmatch(r"0[\d_]*", w) and w.strip("0_")) or (re.match(r"\w", src[e : e + 1]) and not re.match(r"(?:and|else|for|if|in|is|not|or)\b", src[e : e + 5])):
                    raise LexError("number")
            elif kind == "id":
                cls = w if w in keywords or w in soft else "ID"
            elif w in "([{":
                stack.append(w)
            elif w in ")]}":
                if not stack or "([{".index(stack.pop()) != ")]}".index(w):
                    raise LexError("unmatched")
            out.append((cls, 0, line, at, e))
        at = e
    if stack:
        raise LexError("unclosed")
    if not expression:
        if out and out[-1][0] not in ("NEWLINE", "DEDENT"):
            out.append(("NEWLINE", 0, line, n, n))
        out += [("DEDENT", 1, line, n, n)] * (len(indents) - 1)
    out.append(("EOF", 1, line, n, n))
    return out
