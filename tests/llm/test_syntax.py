"""The three parsers, and the operator on top of them."""

import ast
import json
import random
import sys
import warnings

import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import parse_js, parse_json, parse_py, syntax

VALID_JS = [
    "", ";;;", "a = b\n++c", "x => x", "async x => await x", "(a, b = 1, ...c) => ({})", "({a, b: [c = 1, ...d]} = e)", "for (const [k, v] of m) ;", "for (var i = 0, n = 9; i < n; i++) {}",
    "for (x in y);", "for (let of of ofs);", "for (let in {}) ;", "if (a) b; else c", "do x(); while (0) y()", "a: for (;;) { continue a }", "switch (x) { case 1: default: let y; }",
    "try { } catch { } finally { }", "try {} catch ({a}) {}", "with (a) b", "x = /[/]\\/(?<n>a)\\k<n>/giu.test(y)", "a / b / c", "(a) / b", "x = a ? b : c ? d : e", "`a${b}c${`d${e}`}`",
    "tag`\\unicode`", "new Foo", "new Foo().bar", "new (a())()", "function f() { new.target }", "class A extends (B, C) { static #x = 1; get y() { return this.#x } static { } async *z() {} }",
    "class A { 'constructor'() {} }", "a?.b?.[c]?.(d)", "a ?? b", "(a ?? b) || c", "-(2 ** 3)", "2 ** -3", "a **= 2", "a ||= b", "1_000n", "0x1F", ".5e-3", "0b11", "010", "'\\\n'",
    "var async, of, get, set; async = of", "var await; await = 1", "let x; { let x }", "var x; var x", "function f() {} function f() {}", "var f; function f() {}",
    "function* g() { yield; yield* a; const x = yield b }", "async function f() { for await (const x of y) await x }",
    "({ async *a() {}, get b() { return 1 }, set b(v) {}, 'c': 1, [d]: 2, 3: 4, e })", "<!-- comment", "a = {} / 1", "x = function () {} / 2", "if (a) /re/.test(b)", "{} /re/.test(b)", "let\nx",
    "async\nfunction f() {}", "x\n/y/g", "import('a')", "yield = 1", "a = b ? (c, d) : e => f", "var \\u0061b = \u00fc", "label: { break label }", "if (a) function f() {}", "'use strict'; var a",
    "(function () { 'use strict'; return this })()", "delete a", "var {a = 1, ...b} = c", "[a, , b] = c", "[...[a, b]] = c", "#!/usr/bin/node\na", "\ufeffa", "// only\n/* comments */",
    "a\n--> comment of old", "x = { if: 1, class: 2 }.if", "class A { static async = 1; get; set; static; 'a' = 1 }", "for (var i = 0 in {});", "a\u2028b", "x = a ? { b } : [c]", "({ a }) => a",
    "async (a, b) => a", "async (a, b)", "f(...a, ...b,)", "var a = b => ({ c }), d", "0.5.toFixed()", "1..toString()", "if (a) ; else if (b) { } else { }", "!function () {}()", "(()=>{})()",
    "a = async () => { await b }", "class A extends B { constructor() { super(); super.c } }", "x = class { static m() { return new.target } }", "var { [a]: b = 1 } = c", "label: function f() {}",
    "a = b\n(c)", "if (a) { } /x/.exec(b)", "x = y / z; w = '/'", "const f = function* () { yield /re/ }", "for (const x of [/a/, /b/]) ;", "return_ => { return }", "var yield_ = 1, yield = 4; a = yield / 2", "async function f() { await /x/.y }",
]
INVALID_JS = [
    "a b", "(", ")", "{", "}", "[1,", "'a", '"a\n"', "`a", "`${`", "/*", "/a", "/(/", "/a/gg", "/[b-a]/", "/a**/", "var", "var 1", "let a; let a", "let a; var a", "const a", "{ let a; let a }",
    "function f(a) { let a }", "import a from 'b'", "export default 1", "return", "break", "continue", "for (;;) { break x }", "x: x: ;", "if (a) let\n[b]", "if (a) class B {}",
    "while (a) function f() {}", "1 = 2", "a++ = 1", "a?.b = 1", "[1] = a", "({a: 1} = b)", "({a = 1})", "(a, 1) => b", "(a, a) => b", "a\n=> b", "x = a ?? b || c", "x = a || b ?? c", "-2 ** 3",
    "new a?.b()", "a?.`b`", "class A { constructor() {} constructor() {} }", "class A { #a; #a }", "class A { b() { this.#c } }", "this.#c", "super.a", "function f() { super() }",
    "class A { constructor() { super() } }", "'use strict'; with (a) b", "'use strict'; 010", "'use strict'; delete a", "'use strict'; var static", "'use strict'; eval = 1",
    "function f(a = 1) { 'use strict' }", "async function f() { var await }", "function* g() { var yield }", "for (let a, b of c);", "for (let x = 1 of y);", "for (a of b, c);", "try {}", "throw\na",
    "switch (a) { b }", "switch (a) { default: default: }", "1a", "0b2", "'\\u00g'", "@a", "a => {} ()", "a ? b", "({get a(b) {}})", "({set a() {}})", "{ a: b, c: d }", "<<<<<<< HEAD", "=======",
    ">>>>>>> x", "<html>", ".a { b: c }", "var a = [1 2]", "f(a b)", "f(a,,b)", "({a b})", "x = {", "if a", "else", "case 1:", '{"a": 1, "b": 2}', "enum a", "var class", "do x while", "new.target",
    "({__proto__: a, __proto__: b})", "# a comment of another language", "def f():\n  pass", "a +", "a = ;", "for (;;", "var a = 'b' 'c'", "function (a) {}", "class { }", "x = `a${b`", "let [a]",
    "const {a}", "let let = 1", "async function f() { function g() { await x } }", "\\u0069f (a) b",
]


@pytest.mark.parametrize("code", VALID_JS)
def test_valid_js(code):
    assert parse_js.errors(code) == []


@pytest.mark.parametrize("code", INVALID_JS)
def test_invalid_js(code):
    assert parse_js.errors(code)


def test_recovery_finds_later_errors():
    found = parse_js.errors("var a = ;\nfunction f() { return 1 }\nvar b = [1 2];\nfoo();\nlet c c;\n")
    assert len(found) == 3 and found == sorted(found) and found[0] == (8, "unexpected ;")
    assert [p for p, _ in parse_py.errors("a = \ndef f():\n    return 1\nb = 1 2\nc = 3\n")] == [4, 33]
    assert len(parse_json.errors('{"a": x, "b": [1 2], "c": 3,}')) == 3


BROKEN_CLASS = """class A:
    def a(self):
        print 'x'
        return 1

    def b(self, c d):
        return e f

    def c(self):
        try:
            print 1
        except A, e:
            print 2
        else:
            x = 1
        finally:
            print 3
        return 4

    def d(self):
        with (a, b):
            print 5
        if x y:
            pass
        elif z w:
            g h
        else:
            pass

    def e(self):
        match x:
            case 1 2:
                a b
            case [3]:
                c d

    def f(self):
        if a:

    def g(self):
        return 1 1
x = 2 2
"""


def test_python_recovers_within_blocks():
    found = [BROKEN_CLASS[:p].count("\n") + 1 for p, _ in parse_py.errors(BROKEN_CLASS)]
    assert found == [3, 6, 7, 11, 12, 13, 17, 22, 23, 25, 26, 32, 33, 35, 40, 41, 42]
    # a whole class with one error in each of ten methods
    code = "class A:\n" + "".join(f"    def m{i}(self):\n        x = \n        return {i}\n" for i in range(10))
    assert len(parse_py.errors(code)) == 10
    # what follows a broken statement at the same indentation gives no errors of its own
    for code in ["if a b:\n  c\nelse:\n  d\n", "try:\n  a\nexcept A, e:\n  b\nexcept C:\n  d\nfinally:\n  e\n", "def f():\n  if a:\nb = 1\n", "  a = 1\n  b = 2\nc = 3\n", "def f(a)\n  return a\n", "@a\nb = 1\n", "try:\n  a\nb = 1\n"]:
        assert len(parse_py.errors(code)) == 1, code
    assert len(parse_py.errors("if a b:\n  c\nelse:\n  d\nelse:\n  e\n")) == 2


def test_no_error_is_dropped():
    assert len(parse_py.errors("a = \n" * 250)) == 250 and len(parse_py.errors("a = '\\x1'\n" * 250)) == 250
    assert len(parse_js.errors("var a = ;\n" * 250)) == 250 and len(parse_js.errors("a = '\\u00g';\n" * 250)) == 250
    assert len(parse_json.errors("[" + "x," * 250 + "1]")) == 250


def test_deep_and_long_texts():
    sys.setrecursionlimit(max(sys.getrecursionlimit(), syntax.DEPTH))
    n = 60_000
    for code in ("(" * n + "a" + ")" * n, "[" * n + "]" * n, "{" * n + "}" * n, "x=" + "{a:" * n + "1" + "}" * n, "!" * n + "a", "if(a)" * n + ";", "f(" * n + ")" * n, "a=>" * n + "1", "function f(){" * n + "}" * n):
        assert parse_js.errors(code) == [], code[:20]
    assert parse_js.errors("(" * n + "a" + ")" * (n - 1))[0][1] == "unexpected end"
    assert parse_json.errors("[" * 50_000 + "]" * 50_000) == []
    assert parse_js.errors("a();\n" * 50_000) == [] and parse_py.errors("a = 1\n" * 50_000) == []


def python_takes(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False


PIECES = """( ) [ ] { } : , = . * ** -> := ... ; " ' \\ # 0 0x 1j 1_0 01 x @ ! $ ? if else elif for while in is not and or lambda def class return yield await async with as try except finally raise
import from global nonlocal del assert pass match case type print None True == != <= << // //= f"{x!r:>{y}}" f"{{}}" f"{x" rb"a" """.split()


@pytest.mark.parametrize("seed", range(4))
def test_python_like_the_language(seed):
    import asyncio.tasks
    import dataclasses
    import typing

    r = random.Random(seed)
    sources = [open(m.__file__).read() for m in (ast, json, random, warnings, typing, dataclasses, asyncio.tasks)]
    for s in sources:
        assert parse_py.errors(s) == []
    for _ in range(600):
        lines = r.choice(sources).split("\n")
        a = r.randrange(len(lines))
        s = "\n".join(lines[a : a + r.randrange(1, 30)])
        for _ in range(r.randrange(3)):
            p = r.randrange(len(s) + 1)
            s = s[:p] + (r.choice([*PIECES, " ", "\n", "\t", "    ", '"""', "\r", "\u00e9"]) if r.random() < 0.6 else "") + s[p + r.randrange(3) :]
        assert (parse_py.errors(s) == []) == python_takes(s), s


MORE_VALID_JS = [
    'function f(a, a){}', "function f(a){ 'use strict'; var a; }", 'try{}catch(e){ var e; }', 'function a(){} function a(){}', '{ function a(){} function a(){} }',
    'for (let i;;) { let i; }', 'for (const i of x) {const i=1}', 'a: { break a; }', 'class A extends B { constructor(){ super(); } }', '({a=1} = {})', 'var let = 1', 'let [a] = b',
    "import('x')", 'if (1) function f(){}', 'l: function f(){}', 'x = y => z ? 1 : 2', 'a ? b : c => d', '(-1) ** 2', 'delete a?.b', '1..toString()', '1_000', '08.5', "'\\08'",
    'function f(){ await }', 'async(x)', 'async', 'for (var i = 0 in x);', '({ get a(){}, set a(v){} })', 'class A { #a; m(){ return #a in this } }',
    "class A { async *m(){} static async m(){} static x = 1; 'y'; [z] = 2; static {} get; set; static; async }", 'with(a) b', 'abc = 1', '({ var: 1 })', 'do x; while(0) y',
    'a: for(;;) continue a', 'var {a, ...b} = c', '[(a)] = c', '({a: (b)} = c)', '(a, ...b) => 1', '(a,) => 1', 'f(a,)', 'let async; async = 1', 'var await; await = 1', 'var yield = 1',
    '<!-- comment', '({ async foo(){} , async: 1, get: 1, get(){}, set(){}, static: 1 })', '({if: 1})', 'a.if', '({ m(){ super.x } })', 'interface = 1', 'var undefined',
    'a = b ? (c, d) : e => f', 'for (x of []) ;', 'for (let x in {}) ;', 'async function f(){ for await (x of y); await x; }', 'function* g(){ yield; yield* x; yield x }',
    'x = function*(){ const y = yield; }', 'a?.[0]?.(1)?.b', 'a ??= b; a ||= c; a **= 2', 'x = class extends (a, b) {}', 'x = async function(){}', 'x = async () => await y',
    'x = async x => await x', 'if (a) ; else ;', 'switch (a) { case 1: default: }', 'throw new Error(`a ${b} c`)', 'x = a / b / c', 'x = a ? /b/ : /c/', 'x = {} / 1', '{} /a/', '({}) / 1',
    'if (x) /a/.test(y)', 'x++ / 2', 'a = b\n/c/g', 'y = `a${`b${c}`}`', 'label: while (1) { break label }', 'new (foo())()', 'new foo.bar', 'new new X()()', 'typeof typeof x',
    'void 0, !function(){}()', "var a = { 'b': 1, 2: 3, [c]: 4, d, e() {}, get f() { return 1 }, ...g }", 'const {a: {b = 1} = {}, ...c} = d', '({}).a = 1', '[a, b] = [b, a]',
    'for (const [k, v] of Object.entries(x)) {}', 'export_ = 1', 'let x = 1; { let x = 2 }', 'var v; { var v }', 'function f() { return\n1 }', 'x = y\n++z',
    'if (a) { } else if (b) { } else { }', "(function(){ 'use strict'; return this })()", 'a = async\n(b)', 'async = function(){}', 'get = set = of = 1', 'for (of of of) ;',
    'for (let = 0; let < 1; let++) ;', 'class A { constructor() {} static constructor() {} }', 'class A { static async() {} get() {} set() {} async() {} }', 'try { } catch { } finally { }',
    '0x1F + 0o17 + 0b11 + 1e3 + .5 + 5. + 1n', '"\\u{1F600}\\x41\\\nb"', 'a = b ?? (c || d)', 'x = { __proto__: 1, "__proto__"() {} }', 'x = a => ({}).b', 'x = (a, b) => { }',
    'x = (a = 1, {b}, [c]) => a', 'function f() { new.target }', 'debugger;;;', 'var a\nvar b', 'if (1) ; while (0) ;', 'yield\n: 1',
]
MORE_INVALID_JS = [
    "'use strict'; function f(a, a){}", '(a, a) => 1', 'function f(a, b=1, a){}', 'class A { m(a, a){} }', 'function f(a){ let a; }', 'try{}catch(e){ let e; }', 'try{}catch([e]){var e;}',
    'const a=1; function a(){}', 'let a; var a', "'use strict'; { function a(){} function a(){} }", '{ function a(){} var a; }', 'for (let i of x) { var i; }',
    'switch(x){case 1: let a; case 2: let a;}', 'l: l: x', 'break a', 'class A { constructor(){} constructor(){} }', 'class A { constructor(){ super(); } }',
    'x = {__proto__:1, __proto__:2}', '({a=1})', 'let let = 1', 'a => {}()', 'new.target', 'import.meta', 'return 1', 'if (1) class A{}', 'while(0) function f(){}', 'a ?? b || c',
    '-1 ** 2', 'a?.b = 1', 'a?.`x`', 'new a?.b()', '1.toString()', '01_0', '0b12', '1.5n', '01n', '`\\01`', 'async function f(){ await }', 'for await (x of y);', 'for (let i = 0 in x);',
    'for (async of x);', '({ get a(x){} })', '({ set a(){} })', 'class A { static { await; } }', 'class A { #a; #a }', 'a.#b', "class A { 'constructor' = 1 }",
    'class A { static prototype(){} }', 'class A { get constructor(){} }', 'export default 1', "'use strict'; with(a) b", "'use strict'; delete a", "'use strict'; 010",
    "'use strict'; eval = 1", "function f(a=1){'use strict'}", 'var = 1', 'throw\n1', 'continue', 'if(a) b else c', 'for(;;) { continue a }', 'var {...{a}} = c', '[...a, b] = c',
    '(a, b) = c', '[(a=1)] = c', '({(a)} = c)', '([a]) = c', 'async (x)\n => x', 'x\n => x', 'a => {} || b', '(...a, b) => 1', '(,) => 1', 'f(,)', '(a, b,)', '`${}`', "({a, b, 'c'})",
    '({if})', 'super.x', '({ m: function(){ super.x } })', "'use strict'; interface = 1", 'this = 1', 'const a;', 'let a, a', 'const {a};', 'var a b', 'x = {a b}', 'x = [1 2]', 'for (;;',
    'if (a', 'function f( {', 'class A { x y }', 'class { }', 'function (a) {}', 'var 1a', 'a b', 'a.1', "x = 'a\nb'", '/a', 'case 1:', 'else', 'x = {,}', 'a = = b', 'try {}', 'do x while',
    'async function f() { function g() { await x } }', 'function* g() { function h() { yield x } }', "let yield_ = 1; 'use strict'; let x = 08n", "function f() { 'use strict'; 010 }",
    'class A extends B { m() { super() } }', 'x = (a, b', 'enum = 1', 'var if = 1', '({a: 1, a}) = 2', 'for (const x = 1 of y) ;', 'for (const x;;) ;', 'for (let x, y of z) ;', 'new',
    'typeof', 'x =', 'x +', '!', '()', '{', '}', ']',
]


def test_more_javascript_by_hand():
    assert [c for c in MORE_VALID_JS if parse_js.errors(c)] == [] and [c for c in MORE_INVALID_JS if not parse_js.errors(c)] == []


def nested(n):
    code = "1"
    for _ in range(n):
        code = "f'{" + code + "}'"
    return code


@pytest.mark.parametrize("n", [1, 98, 99, 100, 148, 149, 150, 199, 200, 201, 250])
def test_python_nested_as_deep_as_the_language_takes(n):
    sys.setrecursionlimit(max(sys.getrecursionlimit(), syntax.DEPTH))
    half = n // 2
    for code in ("x=" + "(" * n + "1" + ")" * n, "[" * n + "]" * n, nested(n), "".join(" " * i + "if 1:\n" for i in range(n)) + " " * n + "a\n", "[" * half + "f'{" + "(" * half + "1" + ")" * half + "}'" + "]" * half, "f'{" + "(" * n + "1" + ")" * n + "}'", "()" * 300):
        assert (parse_py.errors(code) == []) == python_takes(code), (n, code[:30])


VALID_RE = [
    r"/\u{10FFFF}/u", r"/[[a]--[b]]/v", r"/[[a-z]&&[aeiou]]/v", r"/[\p{L}--\q{a|b}]/v", r"/[\w-a]/", r"/[a-\d]/", r"/\u{110000}/", r"/(?<a>x)\k<a>/u", r"/\k<a>/", r"/(a)\1/u", r"/\-/", r"/[\-]/u", r"/[^]/",
    r"/[]/", r"/(?=a)*/", r"/[a-z0-9_-]+/u", r"/a{,2}/", r"/[[a]b]/v", r"/[a-c&&b]/", r"/\cA/u", r"/[\b]/u", r"/[}\])]/g", r"/(?i:a)/", r"/[\w--\d]/v",
]
INVALID_RE = [
    r"/\u{110000}/u", r"/[[a]--[b]/v", r"/[z-a]/", r"/[\w-a]/u", r"/\-/u", r"/(?<a>x)\k<b>/", r"/\k<a>/u", r"/\2(a)/u", r"/(?=a)*/u", r"/(?<=a)*/", r"/[(]/v", r"/[a--b&&c]/v", r"/a**/", r"/\p/u", r"/a/gg", r"/(/", r"/[A-@]/u", r"/{1}/",
]


def test_regular_expressions():
    assert [r for r in VALID_RE if parse_js.errors("x = " + r)] == [] and [r for r in INVALID_RE if not parse_js.errors("x = " + r)] == []
    assert parse_js.errors("x = /" + "[" * 50_000 + "a" + "]" * 50_000 + "/v") == []


VALID_PY = [
    "match x:\n  case [1, *_] | {'a': b, **c} if d: pass\n  case C(x=1) as y: pass\n", "type X[T: int = str, *U, **P = []] = T\n", "def f[T](a, /, b=1, *, c, **d) -> int: ...\n",
    "with (a as b, c as d,): pass\n", "try: pass\nexcept* A as b: pass\n", "f'{a!r:>{b}} {c=} {d:{e}} {\"q\"}'\n", "x: int = yield\n", "print(*a, b=1, **c)\n", "[*a, *b]; {**a}; (yield)\n",
    "match = 1; case = type = 2\n", "a[1:2, ::3, *b]\n", "\ufeffa = 1\n", "", "return\n",
]
INVALID_PY = [
    "print 'a'\n", "a = \n", "  a\n", "if a:\nb\n", "if a:\n  b\n c\n", "def f(a=1, b): pass\n", "f(a=1, b)\n", "f(**a, *b)\n", "(*a)\n", "1 = a\n", "a + b = c\n", "f() = 1\n", "del f()\n",
    "except A, B: pass\n", "x = (\n", "x = )\n", "'a\n", "'''a\n", "f'{a'\n", "f'}'\n", "f'{}'\n", "b'a' 'b'\n", "'\\x1'\n", "01\n", "1a\n", "a\0\n", "try: pass\n", "<<<<<<< HEAD\n",
    "{'a': 1, 2}\n", "lambda: (yield) = 1\n", "for 1 in a: pass\n", "a ? b\n", "else: pass\n", "async x\n", "const a = 1;\n",
]


def test_python_by_hand():
    assert [c for c in VALID_PY if parse_py.errors(c)] == [] and [c for c in INVALID_PY if not parse_py.errors(c)] == []
    assert all(python_takes(c.removeprefix("\ufeff")) for c in VALID_PY) and not any(python_takes(c) for c in INVALID_PY)


def json_takes(text):
    try:
        json.loads(text.removeprefix("\ufeff"), parse_constant=lambda c: 1 / 0)
        return True
    except (ValueError, ZeroDivisionError):
        return False


VALUES = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"])),
    lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text("abc", max_size=4), c, max_size=4),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(VALUES, st.integers(0, 400), st.sampled_from(["", ",", ":", "{", "}", "[", "]", '"', "\\", "1", "-", ".", "NaN", "'", " ", "\n", "\x01", "//"]), st.integers(0, 2))
def test_json_like_the_standard_library(value, at, put, drop):
    s = json.dumps(value, ensure_ascii=False)
    at %= len(s) + 1
    s = s[:at] + put + s[at + drop :]
    assert (parse_json.errors(s) == []) == json_takes(s)


FM = "repo_owner string, repository string, git_path string, hash_code string, commit_time long, commit_id string"
CONTENTS = "hash_code string, contents string, deleted_at timestamp"


def test_operator(spark):
    fm = spark.createDataFrame(
        [
            ("o", "r", "a.JS", "H1 ", 1, "c"), ("o", "r", "a.js", "h1", 1, "d"), ("o", "r", "b.py", "h1", 1, "c"), ("o", None, "c.json", "h2", 1, "c"), ("o", None, "c.js", "h2", 1, "c"),
            ("o", "r", "d.css", "h1", 1, "c"), ("o", "r", "e.js", None, 1, "c"), ("o", "r", "f.js", "h3", 1, "c"), ("o", "r", None, "h1", 1, "c"),
        ], FM,
    ).withColumn("text", F.lit("clash")).withColumn("errors", F.lit(1))
    gone = __import__("datetime").datetime(2020, 1, 1)
    ct = spark.createDataFrame([("h1", "let a = 1;", None), ("h1", "let a = 1;", None), ("h2", "", None), ("h3", "(", gone)], CONTENTS)
    assert rows(syntax.invalid_revisions(fm, ct)) == [("o", "r", "b.py", "h1"), ("o", None, "c.json", "h2")]
    rates = {(r.repository, r.language): (r.n_revisions, r.n_invalid, r.commonest_cause) for r in syntax.rates(fm, ct).collect()}
    assert rates == {("r", "javascript"): (2, 0, None), ("r", "python"): (1, 1, "unexpected name"), (None, "json"): (1, 1, "unexpected end"), (None, "javascript"): (1, 0, None)}
    assert syntax.invalid_revisions(fm.limit(0), ct).count() == 0 and syntax.rates(fm, ct.limit(0)).count() == 0


def test_errors_are_counted_and_kept_over_batches(spark, monkeypatch):
    texts = {f"h{i}": "a = \n" * (i * 60) for i in range(6)}
    fm = spark.createDataFrame([("o", "r", f"{h}.py", h, 1, "c") for h in texts], FM)
    ct = spark.createDataFrame([(h, t, None) for h, t in texts.items()], CONTENTS).coalesce(1)
    got = {r.hash_code: r for r in syntax.parse_contents(fm, ct).collect()}
    assert {h: r.n_errors for h, r in got.items()} == {f"h{i}": i * 60 for i in range(6)}
    assert all([e.position for e in r.errors] == [4 + 5 * j for j in range(r.n_errors)] for r in got.values())
    batch = syntax.pa.RecordBatch.from_pylist([{"h": h, "l": "python", "t": t} for h, t in texts.items()])
    whole = [r for b in syntax._parse([batch]) for r in b.to_pylist()]
    monkeypatch.setattr(syntax, "SENT_ERRORS", 100)
    parts = list(syntax._parse([batch]))
    assert len(parts) > 1 and [r for b in parts for r in b.to_pylist()] == whole
