"""Recognisers and documentation pairs on small sources."""

from __future__ import annotations

import ast

import pytest

from strandline.llm.docs import described, doc_words, functions_with_docs, trivial, unread_files
from strandline.llm.gll import Grammar
from strandline.llm.grammars import parses
from strandline.llm.syntax import invalid_rates, parsed_files, valid

GOOD = {
    "python": ["x = [i for i in y if i]\n", "def f(a, /, b=1, *, c: int = 2, **k) -> int:\n    return f'{a!r:>{b}} {c}'\n", "match x:\n    case {'a': [1, *r]} | None:\n        pass\n", "async def g():\n    async with a as b, c:\n        await d\n",
               "@a.b(c)\nclass A(B, m=C):\n    x: int = 3\n    y = lambda *a, b=1: (yield)\n", "try:\n    pass\nexcept* E as e:\n    raise X from e\nelse:\n    del a[1], b.c\n", "a = b = c, *d = 1, 2\nprint(*a, **b, c=1)\nif (n := 3) > 2: x[1:2, ::3] = 4; y += 1\n"],
    "javascript": ["const a = /[/]\\/)/g.test(b) ? x / y / z : `q${`r${1}`}s`\nlet {c, d: [e = 2, ...f], ...g} = h\n", "export default class extends A { static #p = 1; get x() { return this.#p } async *g() {} static { a() } }\n",
                   "for (const [k, v] of Object.entries(o)) if (k in v) continue; else break\nlabel: for (;;) {}\n", "var await = 1; with (a) { b }\n", "import d, * as n from 'x'; export { a as default } from 'y'; const m = await import('z')\n", "(async (x, y = 3) => { await x })(); new Foo; a?.b?.[0]?.(1) ?? c\nif (a) b\nelse c\n"],
    "typescript": ["interface A<T extends B = C> extends D { readonly x?: T[]; (y: number): void; [k: string]: any; m?<U>(a: U): a is U }\n", "export abstract class Q<T> extends R<S<T>> implements I { constructor(private readonly a: number) { super(); } abstract m(): void; declare x: string; }\n",
                   "type F = (a: number, ...b: string[]) => Promise<Array<Map<string, number>>>;\nconst f = async <T,>(x: T): Promise<T> => x as unknown as T;\nlet z = a! < b && c > (d);\n", "function over(a: string): void;\nfunction over(a: any) {}\nenum E { A = 1, B }\ndeclare module 'x' { export const y: keyof typeof q; }\n"],
    "java": ["package a.b;\nimport static c.D.*;\npublic final class A<T extends B & C> extends D<T[]> implements E {\n  @Over(x = {1, 2}) private static int[] a = {1, 2}, b[];\n  A() { this(1); }\n  <R> List<? super R> m(final int... x) throws F { for (int i = 0, j; i < 3; i++, j--) { a[i] >>>= 2; } return (R) (x) -> x + 1; }\n  int k = switch (q) { case 1, 2 -> 3; default -> { yield 4; } };\n  record P(int a) {}\n  enum G { X(1) { void y() {} }, Z; }\n}\n"],
    "go": ["package a\n\nimport (\n\t\"b\"\n\t. \"c\"\n)\n\ntype S[T any] struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\n\nfunc (s *S[T]) M(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok && v.(type2) > 0 {\n\t\treturn\n\t} else if x := <-ch; x {\n\t}\n\tswitch t := v.(type) {\n\tcase int, []string:\n\t\tfallthrough\n\tdefault:\n\t}\n\tfor i := range 10 {\n\t\tgo func() { defer f() }()\n\t}\n\tselect {\n\tcase ch <- 1:\n\t}\n\ts := []T{{1, 2}, {a: 3}}\n\t_ = s[1:2:3]\n}\n"],
    "rust": ["#![allow(x)]\nuse a::{b, c::*, d as e};\npub(crate) fn f<'a, T: B + 'a>(mut x: &'a mut Vec<T>, (a, b): (u8, i8)) -> Result<Vec<Vec<u8>>, E> where T: C { let s = S { a, b: 1, ..d }; if let Some(x) = y? { return Ok(x) } else { loop { break 'l 3 } }; match x { 1..=5 | 7 if a => {} A::B { c, .. } => 2, _ => vec![1, 2] } }\nimpl<T> Tr for S<T> { type A = u8; fn g(&self) -> u8 { self.0.iter().map(|&x| x as u8).collect::<Vec<_>>() [0] } }\nmacro_rules! m { ($a:expr) => { $a + 1 }; }\n"],
}
BAD = {
    "python": ["def f(:\n    pass\n", "x = (1\n", "if a:\nb\n", "print 'a'\n", "<<<<<<< HEAD\na\n", "f() = 1\n", "x = 'a\n", "def f():\n    return 1\n  x\n", "f'{a b}'\n", "x = 012\n", "a = 1 +\n"],
    "javascript": ["const a;\n", "function f( {", "let x: number = 1\n", "a b\n", "if (a {}\n", "<!DOCTYPE html>\n", "x = 'a\n", "for (;;\n", "const t = ;\n", "}"],
    "typescript": ["let x: = 1\n", "interface A { x: }\n", "class A { m( }\n", "package a;\nimport java.util.List;\n"],
    "java": ["class A { int x }\n", "class A { void m() { int t = ; } }", "class A { void m() { return 1 } }\n", "func a() {}\n"],
    "go": ["package a\nfunc f() {\n", "func f() {}\n", "package a\nvar x = \n", "package a\nfunc f() { x := }\n", "package app.b;\n"],
    "rust": ["fn f() { let x = ; }\n", "fn f( {}\n", "pub fn f() -> { }\n", "package a\n"],
}


@pytest.mark.parametrize("language", sorted(GOOD))
def test_good(language):
    for s in GOOD[language]:
        assert parses(s, language), s
        if language == "python":
            ast.parse(s)


@pytest.mark.parametrize("language", sorted(BAD))
def test_bad(language):
    for s in BAD[language]:
        assert not parses(s, language), s
        if language == "python":
            with pytest.raises(SyntaxError):
                ast.parse(s)


def test_ambiguous_and_left_factored():
    g = Grammar("s = e EOF\ne = e2 | e2 'x' e | '(' e ')' | '(' e ')' 'y'\ne2 = 'a' | 'a' 'b'*\n", ["s"])
    enc = lambda t: g.encode([(c, 0) for c in t] + [("EOF", 1)])
    for t in ("a", "abb", "axabxa", "(((a)y)y)", "((a))"):
        assert g.accepts(enc(t)), t
    for t in ("", "ax", "(a", "(a)yy", "ba"):
        assert not g.accepts(enc(t)), t


def test_files(spark):
    rows = [
        (1, "p", "a.py", "x = 1\n"), (1, "p", "a.py", "x = 1\n"), (2, "p", "b.py", "\ufeffx = (\n"), (3, "p", "c.go", ""), (4, None, "d.TS", "let x: = 1"),
        (5, "p", "e.txt", "(("), (6, "p", None, "(("), (7, "p", "f.rs", None), (None, "p", "g.py", "(("), (8, "p", "h.js", "a();\n" * 50_000),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "file_id long, project_id string, file_path string, content string, valid string")
    got = {r.file_id: r.valid for r in parsed_files(df).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: None, 6: None, 7: None, 8: True}
    rates = {(r.project_id, r.language): (r.n_files, r.n_invalid, r.share) for r in invalid_rates(df).collect()}
    assert rates[("p", "python")] == (2, 1, 0.5) and rates[(None, "typescript")] == (1, 1, 1.0)
    assert parsed_files(df.limit(0)).collect() == []
    assert valid(" \n", "go") and valid(None, "go") is None


TS = """/** License text that belongs to the whole file, not to a function. */

// Sorts the open windows by their age, oldest first.
export async function sortWindows(
  a: number
): void {
    const s = `
// Sorts the quoted windows by their age, oldest first.
function quoted() {
}
`;
}
// Counts the many windows that stay open.

export const countWindows = (a) => 1;
// todo: count the many windows that stay open
const later = function () {};
class A extends B {
    /**
     * Gives the parts of the window back to its owner.
     * @param x the part
     */
    @dec({ a: 1 })
    static async giveBack(x: number): void { if (x) { call(x); } }
    /* the plain give back */
    plainGiveBack() {}
    m(a: string): void { }
}
interface I {
    /** Sends the list of windows to the next free reader. */
    send(a: string): void;
}
class I2 {}
"""
PY = '''import a

# Reads the list of windows from the other side.
@cached
@retry(times=3)
async def read_windows(x):
    # Not the documentation of this function at all, really.
    return 1


class W:
    def close(
        self,
    ):
        """Closes each window that nobody has looked at for days.

        :param self: the window
        """

    def open_(self):
        "Opens the open."
        def inner():
            """Looks at every window that is left open here."""
            return 1
'''
JAVA = """package a;
interface Sender {
    /** Sends the whole list to the next free reader. */
    void send(String a, int b);
}
class Sender {
    public void send(final String x, int y) { }
    // Builds a sender for the window that was opened last.
    @Inject(value = {1, 2})
    public Sender(int a) { call(a); }
}
"""


def test_docs(spark):
    rows = [(1, "p", "a.ts", TS), (2, "p", "b.py", PY), (3, "p", "c.java", JAVA), (4, "p", "d.py", PY + "x = (\n"), (5, "p", "e.go", None), (6, "p", "f.py", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows + rows[:1]], "file_id long, project_id string, file_path string, content string, description string")
    got = functions_with_docs(df).collect()
    assert sorted((r.file_id, r.name, r.start_line, r.origin) for r in got) == [
        (1, "giveBack", 24, "own"), (1, "send", 31, "own"), (1, "sortWindows", 4, "own"),
        (2, "close", 12, "own"), (2, "inner", 22, "own"), (2, "read_windows", 6, "own"),
        (3, "Sender", 10, "own"), (3, "send", 4, "own"), (3, "send", 7, "declaration"),
    ]
    assert functions_with_docs(df.limit(0)).collect() == []


def test_trivial():
    assert trivial("Order weighted queue opt.", "order_weighted_queue_opt") and trivial("TODO: write documentation for this function", "f") and trivial("@param a the long list of words here", "f")
    assert not trivial("Returns every part that changed last.", "f") and doc_words("the getPart parts now", "getPart") == 2


VALID = [
    ("typescript", "const a = [1] as const; let b = <const>['x']; const o = { a: 1 } as const satisfies X;"),
    ("typescript", "enum E { A = 1, 'b' = 2 }\nlet x: null = null;"),
    ("rust", "fn f() { if let Some(x) = y && z > 1 { } for i in 0.. {} if (S { x: 1 }) == s {} let r = a < b && c < d || e == f; match x { A { b } if b == S { x: 1 } => 1, _ if let Some(q) = w => 2, n => 3 } }"),
    ("python", "def f(a, b=1, /, c=2, *d, e, f=3, **g): pass\ndef k(*, a): pass\nf(1, *a, 2, b=1, *c, d=2, **e, g=1)\nx.y: int\n(a) += 1\nf(x for x in y)\nlambda x, y=1, *z, w, **k: 0\n"),
    ("python", "x = rf'\\{a}b{{}}'\ny = f'\\N{DIGIT ONE}{a}'\n"),
    ("javascript", "x => ({});\nconst h = () => class {};\n[x, y] = [y, x]; a.b = c[1] = 2;"),
]
INVALID = [
    ("rust", "fn main() { let x = 5 }"), ("rust", "fn f() { a < b < c; }"), ("rust", "fn f() { if S { x: 1 } == s {} }"), ("python", "def f(a=1, b): pass"), ("python", "f(a=1, 2)"),
    ("python", "(a, b) += 1"), ("python", "f(**k, 1)"), ("python", "def f(*): pass"), ("python", "a, b: int = 1"), ("javascript", "1 = 2;"), ("javascript", "x => {} ()"), ("javascript", "null = a"),
]


def test_sharp_edges_of_the_grammars():
    assert [x for x in VALID if not parses(x[1], x[0])] == [] and [x for x in INVALID if parses(x[1], x[0])] == []


def test_more_declarations():
    got = lambda src, lang: [(d["qualified"], d["start_line"], d["description"], d["has_body"]) for d in described(src, lang)]
    assert got("package a\n\ntype I interface {\n\t// Read reads it\n\tRead(x int) error\n\tio.Closer\n}\n", "go") == [("I.Read", 5, "Read reads it", False)]
    java = "class A {\n  void a() {\n    Runnable r = new Runnable() {\n      /** runs */\n      public void run() {}\n    };\n    class L {\n      /** local */\n      int l() { return 1; }\n    }\n  }\n  C c = new C() {\n    /** cmp */\n    public int cmp() { return 0; }\n  };\n  enum E { P {\n    /** p */\n    int v() { return 1; }\n  } }\n}\n"
    assert got(java, "java") == [("A.a", 2, None, True), ("A.run", 5, "runs", True), ("A.L.l", 9, "local", True), ("A.cmp", 14, "cmp", True), ("A.E.v", 18, "p", True)]
    js = "/** reads */\nA.prototype.read = function (x) { return x; };\n// writes\nmodule.exports.write = (x) => x;\nfunction C() {\n  /** inner */\n  this.m = function () {};\n}\n"
    assert got(js, "javascript") == [("A.read", 2, "reads", True), ("write", 4, "writes", True), ("C", 5, None, True), ("m", 7, "inner", True)]


def test_documentation_comes_through_the_join(spark):
    doc = "/** Takes every waiting row out of the queue in order of age. */"
    rows = [
        (1, "p", "I.ts", f"interface Q {{\n  {doc}\n  take(n: number): Row[];\n  put(r: Row): void;\n}}\n"),
        (2, "p", "Q.ts", "class Q {\n  take(n: number): Row[] { return []; }\n  put(r: Row): void {}\n}\n"),
        (3, "q", "Q.ts", "class Q {\n  take(n: number): Row[] { return []; }\n}\n"),
        (4, "p", "R.ts", f"class Q {{\n  {doc.replace('Takes', 'Here takes')}\n  take(n: number): Row[] {{ return []; }}\n  // todo\n  take2() {{}}\n}}\n"),
        (5, None, "T.ts", "x"), (6, "p", "U.ts", "class {"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "file_id long, project_id string, file_path string, content string, key string")
    got = {(r.file_id, r.name, r.origin, r.description.split()[0]) for r in functions_with_docs(df).collect()}
    assert got == {(1, "take", "own", "Takes"), (2, "take", "declaration", "Takes"), (4, "take", "own", "Here")}
    assert "Join" in functions_with_docs(df, content=False).filter("origin = 'own'")._jdf.queryExecution().optimizedPlan().toString()
    assert unread_files(df).collect() == [] == functions_with_docs(df.limit(0)).collect()
