"""A recogniser of Python 3.13 modules: recursive descent for statements, precedence climbing for expressions, panic mode after
an error. It answers whether the language's parser takes a text, and if not, where and why; what only the compiler forbids
(such as a return outside a function) is no error.

Token kinds: operators and keywords stand for themselves, names are "I", numbers "N", strings "S" (bytes "B"), and the lay-out
is "nl", "indent", "dedent", "end". A formatted string is "FS", then "F{" expression "F}" for each replacement, then "FE".
"""

from __future__ import annotations

import re
import unicodedata

# How deep the language lets brackets, indentation and formatted strings be nested.
NESTED, INDENTED, FORMATTED = 200, 99, 149
# Keywords, and operators with their precedence.
KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or "
    "pass raise return try while with yield".split()
)
BINARY = {
    "or": 1, "and": 2, "<": 4, ">": 4, "==": 4, ">=": 4, "<=": 4, "!=": 4, "in": 4, "is": 4, "not": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8,
    "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10,
}
AUGMENTED = frozenset("+= -= *= @= /= %= &= |= ^= <<= >>= **= //=".split())

_KIND = {w: w for w in KEYWORDS}
_TOKEN = re.compile(
    r"[ \t\f]*(?:"
    r"([^\W\d]\w*)"  # 1 name
    r"|(\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|==|<=|>=|<<|>>|\*\*|//|[-+*/%@&|^~<>=,:;]|\.(?!\d))"  # 2 operator
    r"|(\r\n?|\n)"  # 3 end of line
    r"|([(){}\[\]])"  # 4 bracket
    r"|(['\"])"  # 5 string without prefix
    r"|(#[^\n\r]*)"  # 6 comment
    r"|((?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+"
    r"|(?:(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*\.?)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?))"  # 7 number
    r"|(\\(?:\r\n?|\n))"  # 8 line joined to the next
    r")"
)
_BLANK = re.compile(r"[ \t\f]*(?:#[^\n\r]*)?(?:\r\n?|\n)")
_INDENT = re.compile(r"[ \t\f]*")
_BODY = {
    "'": re.compile(r"(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"),
    '"': re.compile(r'(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"'),
    "'''": re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''"),
    '"""': re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""'),
}
_PREFIX = re.compile(r"(?:[rR][bBfF]?|[bB][rR]?|[fF][rR]?|[uU])\Z")
_ZEROS = re.compile(r"0[_0]*[1-9][_0-9]*\Z")
_ESCAPE = re.compile(r"\\(?:([xuUN])|[\s\S])")
_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|or|not)")
_CONVERSION = re.compile(r"![ \t]*([^\W\d]\w*)?[ \t\f\r\n]*(?=([:}])?)")
_HEX = re.compile(r"[0-9a-fA-F]*")


class _Bad(Exception):
    def __init__(self, at: int, why: str):
        self.at, self.why = at, why


def _bad_escape(body: str, is_bytes: bool) -> bool:
    for m in _ESCAPE.finditer(body):
        c = m[1]
        if not c or is_bytes and c != "x":
            continue
        if c == "N":
            if not body.startswith("{", m.end()):
                return True
            end = body.find("}", m.end())
            try:
                unicodedata.lookup(body[m.end() + 1 : end])
            except KeyError:
                return True
            continue
        n = {"x": 2, "u": 4, "U": 8}[c]
        digits = _HEX.match(body, m.end())[0][:n]
        if len(digits) < n or int(digits, 16) > 0x10FFFF:
            return True
    return False


class _Lexer:
    def __init__(self, text: str):
        self.text = text
        self.kinds: list[str] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.errors: list[tuple[int, str]] = []
        if "\0" in text:
            self.errors.append((text.index("\0"), "null character"))
        self.nested = self.formatted = 0  # brackets and formatted strings around
        pos = 1 if text.startswith("\ufeff") else 0
        self._run(pos, "")
        for _ in range(4):  # so that looking ahead needs no check
            self._add("end", len(text), len(text))

    def _add(self, kind: str, a: int, b: int) -> None:
        self.kinds.append(kind)
        self.starts.append(a)
        self.ends.append(b)

    def _run(self, pos: int, quote: str) -> int:
        """Tokens up to the end of the text, or, within a formatted string (``quote`` is its end), up to the end of a
        replacement's expression."""
        text, n = self.text, len(self.text)
        kinds, starts, ends = self.kinds, self.starts, self.ends
        match, kind_of = _TOKEN.match, _KIND.get
        stack: list[str] = []
        levels = [(0, 0)]
        fresh = not quote  # at the start of a logical line
        while True:
            if fresh:
                while m := _BLANK.match(text, pos):
                    pos = m.end()
                a = _INDENT.match(text, pos).end()
                if a >= n or text[a] == "#" and _BLANK.match(text, pos) is None:
                    pos = n
                    break
                fresh = False
                space = text[pos:a]
                if space or len(levels) > 1:
                    wide = flat = 0
                    for c in space:
                        if c == " ":
                            wide, flat = wide + 1, flat + 1
                        elif c == "\t":
                            wide, flat = (wide // 8 + 1) * 8, flat + 1
                        else:
                            wide = flat = 0
                    top = levels[-1]
                    if wide == top[0]:
                        if flat != top[1]:
                            self.errors.append((a, "tabs and spaces mixed"))
                    elif wide > top[0]:
                        if flat <= top[1]:
                            self.errors.append((a, "tabs and spaces mixed"))
                        levels.append((wide, flat))
                        if len(levels) == INDENTED + 2:
                            self.errors.append((a, "too many levels of indentation"))
                        self._add("indent", pos, a)
                    else:
                        while len(levels) > 1 and wide < levels[-1][0]:
                            levels.pop()
                            self._add("dedent", a, a)
                        if wide != levels[-1][0]:
                            self.errors.append((a, "indentation matches no outer level"))
                        elif flat != levels[-1][1]:
                            self.errors.append((a, "tabs and spaces mixed"))
            m = match(text, pos)
            if m is None:
                a = _INDENT.match(text, pos).end()
                if a >= n:
                    pos = n
                    break
                if quote and text[a] == "!" and not stack:
                    return a
                self.errors.append((a, "unexpected character"))
                pos = a + 1
                self._add("?", a, pos)
                continue
            k = m.lastindex
            pos = m.end()
            if k == 1:
                word = m[1]
                if pos < n and (c := text[pos]) in "'\"" and _PREFIX.match(word):
                    pos = self._string(m.start(1), pos, word.lower())
                    continue
                if not word.isascii() and not word.isidentifier():
                    self.errors.append((m.start(1), "character that can't be in a name"))
                kinds.append(kind_of(word, "I"))
                starts.append(m.start(1))
                ends.append(pos)
            elif k == 2:
                op = m[2]
                a = pos - len(op)
                if quote and not stack:
                    if op == ":" or op == ":=":
                        return a
                    if op == "=" and re.compile(r"[ \t\f\r\n]*[!:}]").match(text, pos) and not text.startswith("=", pos):
                        continue  # the text of the expression is shown too
                kinds.append(op)
                starts.append(a)
                ends.append(pos)
            elif k == 3:
                if stack:
                    continue
                if quote:
                    continue
                self._add("nl", m.start(3), pos)
                fresh = True
            elif k == 4:
                b = text[pos - 1]
                if b in "([{":
                    stack.append(b)
                    self.nested += 1
                    if self.nested == NESTED + 1:
                        self.errors.append((pos - 1, "too many nested brackets"))
                elif stack:
                    self.nested -= 1
                    if stack.pop() + b not in ("()", "[]", "{}"):
                        self.errors.append((pos - 1, "brackets that don't match"))
                elif quote and b == "}":
                    return pos - 1
                else:
                    self.errors.append((pos - 1, "unmatched bracket"))
                kinds.append(b)
                starts.append(pos - 1)
                ends.append(pos)
            elif k == 5:
                pos = self._string(pos - 1, pos - 1, "")
            elif k == 6:
                pass
            elif k == 7:
                t = m[7]
                if _ZEROS.match(t) and t[-1] not in "jJ":
                    self.errors.append((m.start(7), "leading zeros in a number"))
                if pos < n and ((c := text[pos]) == "_" or c.isalnum()) and not _AFTER_NUMBER.match(text, pos):
                    self.errors.append((pos, "name directly after a number"))
                kinds.append("N")
                starts.append(m.start(7))
                ends.append(pos)
            else:
                if pos >= n:
                    self.errors.append((pos, "unexpected end"))
        if quote:
            self.errors.append((n, "unterminated formatted string"))
            return n
        if stack:
            self.errors.append((n, "bracket never closed"))
        if kinds and kinds[-1] not in ("nl", "dedent"):
            self._add("nl", n, n)
        for _ in levels[1:]:
            self._add("dedent", n, n)
        return n

    def _string(self, begin: int, pos: int, prefix: str) -> int:
        """A string literal whose quotes start at ``pos``."""
        text = self.text
        q = text[pos]
        if text.startswith(q * 3, pos):
            q *= 3
        pos += len(q)
        if "f" in prefix:
            return self._formatted(begin, pos, q, "r" in prefix)
        m = _BODY[q].match(text, pos)
        if m is None:
            self.errors.append((begin, "unterminated string"))
            self._add("S", begin, pos)
            if len(q) == 3:
                return len(text)
            return re.compile(r"[^\n\r]*").match(text, pos).end()
        end = m.end()
        is_bytes = "b" in prefix
        body = text[pos : end - len(q)]
        if is_bytes and not body.isascii():
            self.errors.append((begin, "bytes with other than ASCII characters"))
        if "r" not in prefix and "\\" in body and _bad_escape(body, is_bytes):
            self.errors.append((begin, "bad escape in a string"))
        self._add("B" if is_bytes else "S", begin, end)
        return end

    def _formatted(self, begin: int, pos: int, quote: str, raw: bool) -> int:
        text, n = self.text, len(self.text)
        self._add("FS", begin, pos)
        self.formatted += 1
        if self.formatted == FORMATTED + 1:
            self.errors.append((begin, "too many nested formatted strings"))
        pos = self._literal(pos, quote, raw, False, begin)
        self.formatted -= 1
        self._add("FE", pos, pos)
        return pos

    def _literal(self, pos: int, quote: str, raw: bool, spec: bool, begin: int) -> int:
        """The text between replacements, and the replacements. Ends after the quote, or before the brace that ends a
        format specification."""
        text, n = self.text, len(self.text)
        a = pos
        while True:
            if pos >= n:
                self.errors.append((begin, "unterminated formatted string"))
                return n
            c = text[pos]
            if c == "\\":
                if not raw and text.startswith("N{", pos + 1) and (end := text.find("}", pos)) > 0:
                    pos = end + 1
                elif text[pos + 1 : pos + 2] in ("{", "}"):
                    pos += 1
                else:
                    pos += 2
                continue
            if text.startswith(quote, pos):
                if not raw and "\\" in text[a:pos] and _bad_escape(text[a:pos], False):
                    self.errors.append((begin, "bad escape in a string"))
                if spec:
                    self.errors.append((pos, "replacement without its end"))
                return pos + len(quote)
            if c in "\n\r" and len(quote) == 1:
                self.errors.append((begin, "unterminated formatted string"))
                return pos
            if c == "{":
                if text.startswith("{{", pos) and not spec:
                    pos += 2
                    continue
                around, self.nested = self.nested, self.nested + 1
                if self.nested == NESTED + 1:
                    self.errors.append((pos, "too many nested brackets"))
                pos = self._replacement(pos + 1, quote, raw, begin)
                self.nested = around
                continue
            if c == "}":
                if spec:
                    return pos
                if text.startswith("}}", pos):
                    pos += 2
                    continue
                self.errors.append((pos, "single } in a formatted string"))
            pos += 1

    def _replacement(self, pos: int, quote: str, raw: bool, begin: int) -> int:
        text = self.text
        self._add("F{", pos - 1, pos)
        pos = self._run(pos, quote)
        self._add("F}", pos, pos)
        if text.startswith("!", pos):
            m = _CONVERSION.match(text, pos)
            if m[1] not in ("r", "s", "a") or not m[2]:
                self.errors.append((pos, "bad conversion in a formatted string"))
            pos = m.end()
        if text.startswith(":", pos):
            pos = self._literal(pos + 1, quote, raw, True, begin)
        if text.startswith("}", pos):
            return pos + 1
        if pos < len(text):
            self.errors.append((pos, "replacement without its end"))
        return len(text) if pos >= len(text) else pos + 1


class _Parser:
    def __init__(self, text: str):
        self.lx = lx = _Lexer(text)
        self.text, self.k, self.starts, self.ends = text, lx.kinds, lx.starts, lx.ends
        self.errors: list[tuple[int, str]] = []

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]

    def fail(self, i: int, why: str = "") -> None:
        k = self.k[i]
        raise _Bad(i, why or {"nl": "unexpected end of line", "indent": "unexpected indentation", "dedent": "unexpected end of a block", "end": "unexpected end", "I": "unexpected name", "N": "unexpected number"}.get(k, f"unexpected {k}"))

    def need(self, i: int, kind: str) -> int:
        if self.k[i] != kind:
            self.fail(i)
        return i + 1

    def name(self, i: int) -> int:
        return self.need(i, "I")

    # statements

    def module(self) -> None:
        i, k = 0, self.k
        while k[i] != "end":
            i = self.guarded(i)

    def guarded(self, i: int) -> int:
        """A statement; after an error, the place from which parsing goes on (panic mode)."""
        try:
            return self.statement(i)
        except _Bad as bad:
            self.keep(i, bad)
            return self.recover(i, bad.at)

    def keep(self, start: int, bad: _Bad) -> None:
        if bad.at == start and self.errors and self.errors[-1][0] == self.starts[start]:
            return  # known as the error of what should have stood here
        self.errors.append((self.starts[bad.at], bad.why))

    def recover(self, start: int, at: int) -> int:
        """The next line of the indentation of the statement at ``start``. A block below the line of the error, and the clauses
        that belong to the statement, are read for their own errors."""
        k = self.k
        i, blocks = self.below(start, at)
        allowed = _CLAUSES.get(k[start + 1] if k[start] == "async" else k[start], frozenset(("elif", "else", "except", "finally")) if blocks else frozenset())
        while k[i] in allowed:
            a, n = k[i], len(self.errors)
            i = self.clause(i)
            if n == len(self.errors) and a in ("else", "finally"):
                allowed = allowed & {"finally"} if a == "else" else frozenset()
        return i

    def below(self, start: int, at: int) -> tuple[int, bool]:
        """The place behind the line of an error and behind a block below it, and whether there was one."""
        k, i = self.k, at
        if at == start or k[at - 1] not in ("nl", "dedent"):  # else a line was due that isn't there, and the next is whole
            while k[i] not in ("nl", "indent", "dedent", "end"):
                i += 1
            i += k[i] == "nl"
        if k[i] == "indent":
            return self.block(i + 1), True
        return i + (i == start and k[i] == "dedent"), False

    def clause(self, i: int) -> int:
        """A further clause of a statement whose earlier part is broken."""
        k, start = self.k, i
        try:
            i += 1
            if k[start] == "elif":
                i = self.named(i)
            elif k[start] == "except":
                i += k[i] == "*"
                if k[i] != ":" or k[i - 1] == "*":
                    i = self.expression(i)
                    if k[i] == "as":
                        i = self.name(i + 1)
            return self.suite(i)
        except _Bad as bad:
            self.keep(start, bad)
            return self.below(start, bad.at)[0]

    def statement(self, i: int) -> int:
        a = self.k[i]
        handler = _COMPOUND.get(a)
        if handler is not None:
            return handler(self, i)
        if a == "I":
            b = self.k[i + 1]
            if b in ("I", "N", "S", "B", "FS", "(", "[", "{", "-", "*", "~", "not", "lambda", "await", "None", "True", "False", "...") and self.word(i) == "match":
                j = self.match(i)
                if j:
                    return j
        return self.simple(i)

    def simple(self, i: int) -> int:
        k = self.k
        while True:
            i = self.small(i)
            a = k[i]
            if a == "nl":
                return i + 1
            if a != ";":
                self.fail(i)
            i += 1
            if k[i] == "nl":
                return i + 1

    def suite(self, i: int) -> int:
        i = self.need(i, ":")
        k = self.k
        if k[i] != "nl":
            return self.simple(i)
        return self.block(self.need(i + 1, "indent"))

    def block(self, i: int) -> int:
        """The statements up to the end of a block, each with its own errors."""
        k = self.k
        while k[i] != "dedent" and k[i] != "end":
            i = self.guarded(i)
        return i + (k[i] == "dedent")

    def small(self, i: int) -> int:
        k = self.k
        a = k[i]
        handler = _SMALL.get(a)
        if handler is not None:
            return handler(self, i)
        if a == "I" and k[i + 1] == "I" and self.word(i) == "type":
            i = self.type_parameters(i + 2)
            return self.expression(self.need(i, "="))
        start = i
        i = self.stars(i)
        b = k[i]
        if b == "=":
            while True:
                self.check_target(start, i)
                start = i + 1
                i = self.yield_or_stars(start)
                if k[i] != "=":
                    if k[i] in AUGMENTED:
                        self.fail(i)
                    return i
                if k[start] == "yield":
                    self.fail(start)
        elif b in AUGMENTED:
            self.check_single(start, i)
            return self.yield_or_stars(i + 1)
        elif b == ":":
            self.check_single(start, i)
            i = self.expression(i + 1)
            if k[i] == "=":
                i = self.yield_or_stars(i + 1)
        return i

    def check_target(self, a: int, b: int) -> None:
        """That the tokens from a to b are targets of an assignment."""
        if b == a + 1 and self.k[a] == "I":
            return
        if self.targets(a) != b:
            self.fail(a, "no target of an assignment")

    def check_single(self, a: int, b: int) -> None:
        k = self.k
        if b == a + 1 and k[a] == "I":
            return
        while k[a] == "(" and k[b - 1] == ")" and self.closing(a) == b - 1:
            a, b = a + 1, b - 1
        if self.target_atom(a, False) != b or k[a] in ("(", "[") and self.closing(a) == b - 1:
            self.fail(a, "no target of an assignment")

    def closing(self, i: int) -> int:
        depth, k = 0, self.k
        while True:
            c = k[i]
            if c in ("(", "[", "{"):
                depth += 1
            elif c in (")", "]", "}"):
                depth -= 1
                if depth == 0:
                    return i
            elif c == "end":
                return i
            i += 1

    def targets(self, i: int) -> int:
        """star_targets"""
        k = self.k
        while True:
            i = self.target_atom(i + (k[i] == "*"), True)
            if k[i] != ",":
                return i
            i += 1
            if k[i] in ("=", "in", ")", "]", "nl", ":"):
                return i

    def target_atom(self, i: int, sequences: bool, unpack: bool = True) -> int:
        """A name, attribute, item, or (``sequences``) tuple or list of targets; also a parenthesised target."""
        k = self.k
        start = i
        if k[i] in ("(", "[") and sequences:
            end = self.closing(i)
            if k[end + 1] not in (".", "[", "("):
                if end == i + 1:
                    return end + 1
                if k[i] == "(" and k[end - 1] != "," and k[i + 1] == "*":
                    depth = 0
                    if not any(
                        (depth := depth + (k[j] in ("(", "[", "{")) - (k[j] in (")", "]", "}"))) == 0 and k[j] == "," for j in range(i + 1, end)
                    ):
                        self.fail(i + 1, "starred target alone")
                j = i + 1
                while True:
                    j = self.target_atom(j + (unpack and k[j] == "*"), True, unpack)
                    if j == end:
                        return end + 1
                    j = self.need(j, ",")
                    if j == end:
                        return end + 1
        i = self.primary(i)
        last = k[i - 1]
        if i == start + 1 and k[start] == "I":
            return i
        if i > start + 1 and (last == "I" and k[i - 2] == "." or last == "]" and self.opening(i - 1) > start):
            return i
        self.fail(start, "no target of an assignment")

    def opening(self, i: int) -> int:
        depth, k = 0, self.k
        while i >= 0:
            c = k[i]
            if c in (")", "]", "}"):
                depth += 1
            elif c in ("(", "[", "{"):
                depth -= 1
                if depth == 0:
                    return i
            i -= 1
        return i

    def s_word(self, i: int) -> int:
        return i + 1

    def s_return(self, i: int) -> int:
        return i + 1 if self.k[i + 1] in ("nl", ";") else self.stars(i + 1)

    def s_raise(self, i: int) -> int:
        i += 1
        if self.k[i] in ("nl", ";"):
            return i
        i = self.expression(i)
        return self.expression(i + 1) if self.k[i] == "from" else i

    def s_names(self, i: int) -> int:
        i = self.name(i + 1)
        while self.k[i] == ",":
            i = self.name(i + 1)
        return i

    def s_del(self, i: int) -> int:
        k = self.k
        i += 1
        while True:
            i = self.target_atom(i, True, False)
            if k[i] != ",":
                break
            i += 1
            if k[i] in ("nl", ";"):
                break
        if k[i] not in ("nl", ";"):
            self.fail(i)
        return i

    def s_assert(self, i: int) -> int:
        i = self.expression(i + 1)
        return self.expression(i + 1) if self.k[i] == "," else i

    def s_yield(self, i: int) -> int:
        i = self.yield_(i)
        return i

    def dotted(self, i: int) -> int:
        i = self.name(i)
        while self.k[i] == ".":
            i = self.name(i + 1)
        return i

    def s_import(self, i: int) -> int:
        k = self.k
        while True:
            i = self.dotted(i + 1)
            if k[i] == "as":
                i = self.name(i + 1)
            if k[i] != ",":
                return i

    def s_from(self, i: int) -> int:
        k = self.k
        i += 1
        dots = i
        while k[i] in (".", "..."):
            i += 1
        if k[i] == "I" or i == dots:
            i = self.dotted(i)
        i = self.need(i, "import")
        if k[i] == "*":
            return i + 1
        bracket = k[i] == "("
        i += bracket
        while True:
            i = self.name(i)
            if k[i] == "as":
                i = self.name(i + 1)
            if k[i] != ",":
                break
            i += 1
            if bracket and k[i] == ")":
                break
        return self.need(i, ")") if bracket else i

    def c_if(self, i: int) -> int:
        k = self.k
        i = self.suite(self.named(i + 1))
        while k[i] == "elif":
            i = self.suite(self.named(i + 1))
        return self.suite(i + 1) if k[i] == "else" else i

    def c_while(self, i: int) -> int:
        i = self.suite(self.named(i + 1))
        return self.suite(i + 1) if self.k[i] == "else" else i

    def c_for(self, i: int) -> int:
        i = self.need(self.targets(i + 1), "in")
        i = self.suite(self.stars(i))
        return self.suite(i + 1) if self.k[i] == "else" else i

    def c_try(self, i: int) -> int:
        k = self.k
        i = self.suite(i + 1)
        star = None
        bare = False
        if k[i] != "except" and k[i] != "finally":
            self.fail(i, "try without except or finally")
        while k[i] == "except":
            if bare:
                self.fail(i, "bare except that is not the last")
            i += 1
            is_star = k[i] == "*"
            if star is not None and star != is_star:
                self.fail(i, "except and except* mixed")
            star = is_star
            i += is_star
            if k[i] == ":" and not is_star:
                bare = True
            else:
                i = self.expression(i)
                if k[i] == "as":
                    i = self.name(i + 1)
            i = self.suite(i)
        if star is not None and k[i] == "else":
            i = self.suite(i + 1)
        return self.suite(i + 1) if k[i] == "finally" else i

    def c_with(self, i: int) -> int:
        k = self.k
        i += 1
        if k[i] == "(":
            end = self.closing(i)
            if k[end + 1] == ":":
                # only the head is tried twice: the errors of the block are kept as they are met
                try:
                    j = self.need(self.with_items(i + 1, ")"), ")")
                except _Bad as first:
                    try:
                        j = self.with_items(i, ":")
                    except _Bad as second:
                        raise (first if first.at >= second.at else second) from None
                return self.suite(j)
        return self.suite(self.with_items(i, ":"))

    def with_items(self, i: int, end: str) -> int:
        k = self.k
        while True:
            i = self.expression(i)
            if k[i] == "as":
                i = self.target_atom(i + 1, True)
            if k[i] != ",":
                break
            i += 1
            if k[i] == end == ")":
                break
        if k[i] != end:
            self.fail(i)
        return i

    def c_def(self, i: int) -> int:
        k = self.k
        i = self.type_parameters(self.name(i + 1))
        i = self.need(self.parameters(self.need(i, "("), ")", True), ")")
        if k[i] == "->":
            i = self.expression(i + 1)
        return self.suite(i)

    def c_class(self, i: int) -> int:
        i = self.type_parameters(self.name(i + 1))
        if self.k[i] == "(":
            i = self.arguments(i)
        return self.suite(i)

    def c_async(self, i: int) -> int:
        b = self.k[i + 1]
        if b not in ("def", "for", "with"):
            self.fail(i + 1)
        return _COMPOUND[b](self, i + 1)

    def c_decorated(self, i: int) -> int:
        k = self.k
        while k[i] == "@":
            i = self.need(self.named(i + 1), "nl")
        if k[i] not in ("def", "class") and not (k[i] == "async" and k[i + 1] == "def"):
            self.fail(i)
        return _COMPOUND[k[i]](self, i)

    def c_indent(self, i: int) -> int:
        self.fail(i)

    def type_parameters(self, i: int) -> int:
        k = self.k
        if k[i] != "[":
            return i
        i += 1
        while True:
            star = k[i] in ("*", "**")
            i = self.name(i + star)
            if k[i] == ":":
                if star:
                    self.fail(i)
                i = self.expression(i + 1)
            if k[i] == "=":
                i = self.star_expression(i + 1) if star and k[i + 1] == "*" else self.expression(i + 1)
            if k[i] != ",":
                break
            i += 1
            if k[i] == "]":
                break
        return self.need(i, "]")

    def parameters(self, i: int, end: str, annotated: bool) -> int:
        k = self.k
        slash = star = defaulted = False
        first = True
        while k[i] != end:
            a = k[i]
            if a == "/":
                if slash or star or first:
                    self.fail(i)
                slash = True
                i += 1
            elif a == "**":
                i = self.name(i + 1)
                if annotated and k[i] == ":":
                    i = self.expression(i + 1)
                if k[i] == "=":
                    self.fail(i)
                if k[i] == ",":
                    i += 1
                if k[i] != end:
                    self.fail(i, "parameter after **")
                return i
            elif a == "*":
                if star:
                    self.fail(i)
                star = True
                i += 1
                if k[i] == ",":
                    if k[i + 1] == end or k[i + 1] == "**":
                        self.fail(i + 1, "named parameters must follow bare *")
                else:
                    i = self.name(i)
                    if annotated and k[i] == ":":
                        i = self.star_expression(i + 1) if k[i + 1] == "*" else self.expression(i + 1)
                    if k[i] == "=":
                        self.fail(i)
            else:
                i = self.name(i)
                if annotated and k[i] == ":":
                    i = self.expression(i + 1)
                if k[i] == "=":
                    i = self.expression(i + 1)
                    defaulted = defaulted or not star
                elif defaulted and not star:
                    self.fail(i - 1, "parameter without a default follows one with it")
            first = False
            if k[i] != ",":
                return i
            i += 1
        return i

    # match

    def match(self, i: int) -> int:
        """A match statement, or 0 if the name starts another statement."""
        k = self.k
        try:
            j = i + 1
            j = self.star_named(j)
            while k[j] == ",":
                j += 1
                if k[j] == ":":
                    break
                j = self.star_named(j)
            if k[j] != ":" or k[j + 1] != "nl" or k[j + 2] != "indent" or k[j + 3] != "I" or self.word(j + 3) != "case":
                return 0
        except _Bad:
            return 0
        i = j + 3
        while k[i] != "dedent" and k[i] != "end":
            start = i
            try:
                if k[i] != "I" or self.word(i) != "case":
                    self.fail(i)
                i = self.patterns(i + 1)
                if k[i] == "if":
                    i = self.named(i + 1)
                i = self.suite(i)
            except _Bad as bad:
                self.keep(start, bad)
                i = self.below(start, bad.at)[0]
        return i + (k[i] == "dedent")

    def patterns(self, i: int) -> int:
        k = self.k
        while True:
            i = self.name(i + 1) if k[i] == "*" else self.pattern(i)
            if k[i] != ",":
                return i
            i += 1
            if k[i] in (":", "if"):
                return i

    def pattern(self, i: int) -> int:
        k = self.k
        i = self.closed_pattern(i)
        while k[i] == "|":
            i = self.closed_pattern(i + 1)
        if k[i] == "as":
            i = self.name(i + 1)
            if self.word(i - 1) == "_":
                self.fail(i - 1)
        return i

    def closed_pattern(self, i: int) -> int:
        k = self.k
        a = k[i]
        if a in ("None", "True", "False"):
            return i + 1
        if a in ("S", "B", "FS"):
            return self.strings(i)
        if a == "-" or a == "N":
            i = self.need(i + (a == "-"), "N")
            if k[i] in ("+", "-") and k[i + 1] == "N":
                i += 2
            return i
        if a == "I":
            i += 1
            while k[i] == ".":
                i = self.name(i + 1)
            if k[i] == "(":
                i += 1
                named = False
                while k[i] != ")":
                    if k[i] == "I" and k[i + 1] == "=":
                        named = True
                        i = self.pattern(i + 2)
                    elif named:
                        self.fail(i, "positional pattern after a keyword pattern")
                    else:
                        i = self.pattern(i)
                    if k[i] != ",":
                        break
                    i += 1
                return self.need(i, ")")
            return i
        if a in ("(", "["):
            close = ")" if a == "(" else "]"
            i += 1
            while k[i] != close:
                i = self.name(i + 1) if k[i] == "*" else self.pattern(i)
                if k[i] != ",":
                    break
                i += 1
            return self.need(i, close)
        if a == "{":
            i += 1
            while k[i] != "}":
                if k[i] == "**":
                    i = self.name(i + 1)
                else:
                    if k[i] == "I" and k[i + 1] != ".":
                        self.fail(i)
                    i = self.pattern(self.need(self.closed_pattern(i), ":"))
                if k[i] != ",":
                    break
                i += 1
            return self.need(i, "}")
        self.fail(i)

    # expressions

    def yield_(self, i: int) -> int:
        i += 1
        if self.k[i] == "from":
            return self.expression(i + 1)
        return i if self.k[i] in ("nl", ";", ")", "]", "}", "=", "F}", ":") else self.stars(i)

    def yield_or_stars(self, i: int) -> int:
        return self.yield_(i) if self.k[i] == "yield" else self.stars(i)

    def star_expression(self, i: int) -> int:
        return self.binary(i + 1, 5) if self.k[i] == "*" else self.expression(i)

    def stars(self, i: int) -> int:
        """star_expressions"""
        k = self.k
        i = self.star_expression(i)
        while k[i] == ",":
            i += 1
            if k[i] in ("nl", ";", ")", "]", "}", "=", ":", "F}") or k[i] in AUGMENTED:
                return i
            i = self.star_expression(i)
        return i

    def star_named(self, i: int) -> int:
        return self.binary(i + 1, 5) if self.k[i] == "*" else self.named(i)

    def named(self, i: int) -> int:
        if self.k[i] == "I" and self.k[i + 1] == ":=":
            return self.expression(i + 2)
        i = self.expression(i)
        if self.k[i] == ":=":
            self.fail(i)
        return i

    def expression(self, i: int) -> int:
        k = self.k
        if k[i] == "lambda":
            i = self.need(self.parameters(i + 1, ":", False), ":")
            return self.expression(i)
        i = self.binary(i, 1)
        if k[i] == "if":
            i = self.need(self.binary(i + 1, 1), "else")
            return self.expression(i)
        return i

    def binary(self, i: int, least: int) -> int:
        """Operands joined by operators of precedence ``least`` or more."""
        k = self.k
        if k[i] == "not":
            if least > 3:
                self.fail(i)
            i = self.binary(i + 1, 3)
        else:
            i = self.unary(i)
        while True:
            op = k[i]
            p = BINARY.get(op)
            if p is None or p < least:
                return i
            if op == "not":
                if k[i + 1] != "in":
                    return i
                i += 1
            elif op == "is" and k[i + 1] == "not":
                i += 1
            i = self.binary(i + 1, p + 1)

    def unary(self, i: int) -> int:
        k = self.k
        a = k[i]
        if a == "-" or a == "+" or a == "~":
            return self.unary(i + 1)
        i = self.primary(i + 1) if a == "await" else self.primary(i)
        if k[i] == "**":
            return self.unary(i + 1)
        return i

    def primary(self, i: int) -> int:
        k = self.k
        a = k[i]
        if a == "I" or a == "N" or a in ("None", "True", "False", "..."):
            i += 1
        elif a in ("S", "B", "FS"):
            i = self.strings(i)
        elif a == "(":
            i = self.group(i)
        elif a == "[":
            i = self.list(i)
        elif a == "{":
            i = self.braces(i)
        else:
            self.fail(i)
        while True:
            b = k[i]
            if b == ".":
                i = self.name(i + 1)
            elif b == "(":
                i = self.arguments(i)
            elif b == "[":
                i = self.slices(i)
            else:
                return i

    def strings(self, i: int) -> int:
        k = self.k
        text = other = False
        start = i
        while True:
            a = k[i]
            if a == "S":
                text = True
                i += 1
            elif a == "B":
                other = True
                i += 1
            elif a == "FS":
                text = True
                i += 1
                while k[i] == "F{":
                    i = self.need(self.yield_or_stars(i + 1), "F}")
                    while k[i] == "F{":
                        i = self.need(self.yield_or_stars(i + 1), "F}")
                i = self.need(i, "FE")
            else:
                break
        if text and other:
            self.fail(start, "bytes and text joined")
        return i

    def comprehension(self, i: int) -> int:
        """One or more for clauses."""
        k = self.k
        while k[i] == "for" or k[i] == "async" and k[i + 1] == "for":
            i += 1 + (k[i] == "async")
            i = self.need(self.targets(i), "in")
            i = self.binary(i, 1)
            while k[i] == "if":
                i = self.condition(i + 1)
        return i

    def condition(self, i: int) -> int:
        return self.binary(i, 1)

    def group(self, i: int) -> int:
        k = self.k
        i += 1
        if k[i] == ")":
            return i + 1
        if k[i] == "yield":
            return self.need(self.yield_(i), ")")
        start = i
        i = self.star_named(i)
        if k[i] == "for" or k[i] == "async":
            if k[start] == "*":
                self.fail(start, "unpacking in a comprehension")
            return self.need(self.comprehension(i), ")")
        if k[i] == ")":
            if k[start] == "*":
                self.fail(start, "starred expression alone")
            return i + 1
        while k[i] == ",":
            i += 1
            if k[i] == ")":
                break
            i = self.star_named(i)
        return self.need(i, ")")

    def list(self, i: int) -> int:
        k = self.k
        i += 1
        if k[i] == "]":
            return i + 1
        start = i
        i = self.star_named(i)
        if k[i] == "for" or k[i] == "async":
            if k[start] == "*":
                self.fail(start, "unpacking in a comprehension")
            return self.need(self.comprehension(i), "]")
        while k[i] == ",":
            i += 1
            if k[i] == "]":
                break
            i = self.star_named(i)
        return self.need(i, "]")

    def braces(self, i: int) -> int:
        k = self.k
        i += 1
        if k[i] == "}":
            return i + 1
        start = i
        if k[i] == "**":
            i = self.binary(i + 1, 5)
            pairs = True
        else:
            i = self.star_named(i)
            pairs = k[i] == ":"
            if pairs:
                if k[start] == "*" or k[start] == "I" and k[start + 1] == ":=":
                    self.fail(start)
                i = self.expression(i + 1)
        if k[i] == "for" or k[i] == "async":
            if k[start] in ("*", "**"):
                self.fail(start, "unpacking in a comprehension")
            return self.need(self.comprehension(i), "}")
        while k[i] == ",":
            i += 1
            if k[i] == "}":
                break
            if not pairs:
                i = self.star_named(i)
            elif k[i] == "**":
                i = self.binary(i + 1, 5)
            else:
                i = self.expression(self.need(self.expression(i), ":"))
        return self.need(i, "}")

    def arguments(self, i: int) -> int:
        k = self.k
        i += 1
        named = double = False
        count = 0
        while k[i] != ")":
            a = k[i]
            at = i
            if a == "*":
                if double:
                    self.fail(i, "positional unpacking after **")
                i = self.expression(i + 1)
            elif a == "**":
                double = True
                i = self.expression(i + 1)
            elif a == "I" and k[i + 1] == "=":
                named = True
                i = self.expression(i + 2)
            else:
                i = self.named(i)
                if k[i] == "for" or k[i] == "async":
                    i = self.comprehension(i)
                    if count or k[i] != ")":
                        self.fail(at, "generator must be the only argument or be parenthesised")
                if k[i] == "=":
                    self.fail(i, "no name of an argument")
                if double or named:
                    self.fail(at, "positional argument after a keyword argument")
            count += 1
            if k[i] != ",":
                break
            i += 1
        return self.need(i, ")")

    def slices(self, i: int) -> int:
        k = self.k
        i += 1
        while True:
            if k[i] == "*":
                i = self.binary(i + 1, 5)
            else:
                if k[i] != ":":
                    i = self.named(i)
                if k[i] == ":":
                    i += 1
                    if k[i] not in (":", ",", "]"):
                        i = self.expression(i)
                    if k[i] == ":":
                        i += 1
                        if k[i] not in (",", "]"):
                            i = self.expression(i)
            if k[i] != ",":
                break
            i += 1
            if k[i] == "]":
                break
        return self.need(i, "]")


_COMPOUND = {
    "if": _Parser.c_if, "while": _Parser.c_while, "for": _Parser.c_for, "try": _Parser.c_try, "with": _Parser.c_with, "def": _Parser.c_def,
    "class": _Parser.c_class, "async": _Parser.c_async, "@": _Parser.c_decorated, "indent": _Parser.c_indent,
}
_TRY, _IF = frozenset(("except", "else", "finally")), frozenset(("elif", "else"))
#: The clauses that may follow a broken statement or clause.
_CLAUSES = {
    "if": _IF, "elif": _IF, "while": frozenset(("else",)), "for": frozenset(("else",)), "try": _TRY, "except": _TRY, "else": frozenset(("finally",)),
    "with": frozenset(), "def": frozenset(), "class": frozenset(), "@": frozenset(), "indent": frozenset(),
}
_SMALL = {
    "pass": _Parser.s_word, "break": _Parser.s_word, "continue": _Parser.s_word, "return": _Parser.s_return, "raise": _Parser.s_raise, "global": _Parser.s_names,
    "nonlocal": _Parser.s_names, "del": _Parser.s_del, "assert": _Parser.s_assert, "yield": _Parser.s_yield, "import": _Parser.s_import, "from": _Parser.s_from,
}


def errors(text: str) -> list[tuple[int, str]]:
    """(position, cause) of every error of a text as a module, in order of position; none if the parser takes it."""
    try:
        p = _Parser(text)
        p.module()
    except RecursionError:
        return [(0, "nested too deeply")]
    # of the parser's errors at one position the one met first is the cause
    ranked, last = [(at, False, why) for at, why in p.lx.errors], -1
    for at, why in p.errors:
        ranked.append((at, at == last, why))
        last = at
    return [(at, why) for at, _, why in sorted(ranked)]
