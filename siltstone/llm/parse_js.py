"""A recogniser of JavaScript scripts: recursive descent for statements, precedence climbing for expressions, panic mode after
an error. It builds no tree; it answers whether a text is a script, and if not, where and why.

Tokens are kinds in a list: punctuators and words with a meaning of their own stand for themselves, other names are "I", numbers
"N", strings "S", regular expressions "R", templates "T" (whole) or "T{" expression "T}" ... "TE". Parsing functions take and
give token numbers. What else the language forbids early is checked on the way: targets of assignments, names declared
twice, jumps without a goal, reserved words, private names, and the forms of strict code.
"""

from __future__ import annotations

import re


# Words of the language and its operators with their precedence.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null "
    "return super switch this throw true try typeof var void while with".split()
)
STRICT_RESERVED = frozenset("implements interface let package private protected public static yield".split())
CONTEXTUAL = frozenset("async await get let of set static yield".split())
NAMES = frozenset({"I", "E", *CONTEXTUAL})  # kinds that may be identifiers; "E" is eval or arguments
BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8,
    "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
PREFIX = frozenset("delete void typeof + - ~ !".split())
_OPERAND_END = frozenset("I E N S R T TE ] this super null true false".split()) | CONTEXTUAL

_KIND = {w: w for w in RESERVED | CONTEXTUAL} | {"eval": "E", "arguments": "E"}
_ID = r"(?:[\w$]|[^\x00-\x7f\s\ufeff\ufffd\u2000-\u206f\u3000-\u3003\u3008-\u3020\uff00-\uff20\u00a1-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u2190-\u2bff\U0001f000-\U0001ffff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})"
_TOKEN = re.compile(
    r"[ \t\x0b\x0c\xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]*(?:"
    rf"((?:(?=[^\d])(?!\d){_ID}){_ID}*)"  # 1 name
    r"|(=>|\.\.\.|>>>=|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|<<|>>|\*\*|\.(?!\d)|[;,<>+*%&|^!~?:=@-])"  # 2 punctuator
    r"|([\n\r\u2028\u2029]\s*)"  # 3 new line
    r"|([(){}\[\]])"  # 4 bracket
    r"|(\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"  # 5 string
    r"|(//[^\n\r\u2028\u2029]*)"  # 6 comment
    r"|/\*([\s\S]*?)\*/"  # 7 comment
    r"|(0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?"
    r"|(?:0[0-9]+(?:\.[0-9]*)?|(?:0|[1-9](?:_?[0-9])*)n|(?:0|[1-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*|(?:0|[1-9](?:_?[0-9])*)\.?)(?:[eE][+-]?[0-9](?:_?[0-9])*)?)"  # 8 number
    r"|(`)"  # 9 template
    r"|(/=?)"  # 10 slash
    rf"|(\#{_ID}+)"  # 11 private name
    r")"
)
_REGEX = re.compile(r"/(?![*/])((?:[^/\\\[\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029]|\[(?:[^\]\\\n\r\u2028\u2029]|\\[^\n\r\u2028\u2029])*\])+)/([A-Za-z0-9_$]*)")
_CHUNK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_NAME_START = re.compile(_ID)
_ESCAPE = re.compile(r"\\(?:u(?![0-9a-fA-F]{4}|\{0*(?:10|[0-9a-fA-F])?[0-9a-fA-F]{1,4}\})|x(?![0-9a-fA-F]{2}))")
_OCTAL = re.compile(r"\\(?:[1-9]|0[0-9])")
_UNICODE_NAME = re.compile(r"\\u\{?([0-9a-fA-F]+)\}?")


class _Bad(Exception):
    def __init__(self, at: int, why: str):
        self.at, self.why = at, why


class _Lexer:
    """Tokens of a text: kinds, start positions, whether a new line stands before, and the partners of brackets."""

    def __init__(self, text: str, words_end: bool = False):
        self.text = text
        self.words_end, self.doubtful = words_end, False  # whether a slash after yield or await divides, and whether it mattered
        self.kinds: list[str] = []
        self.starts: list[int] = []
        self.lines: set[int] = set()
        self.partner: dict[int, int] = {}
        self.octal: list[int] = []  # tokens that strict code forbids
        self.errors: list[tuple[int, str]] = []
        pos = 0
        if text.startswith("\ufeff"):
            pos = 1
        if text.startswith("#!", pos):
            m = re.compile(r"[^\n\r\u2028\u2029]*").match(text, pos)
            pos = m.end()
        self._run(pos, False)
        self.kinds += ["end"] * 4  # so that looking ahead needs no check
        self.starts += [len(text)] * 4

    def _run(self, pos: int, inside: bool) -> int:
        text, kinds, starts, lines, partner = self.text, self.kinds, self.starts, self.lines, self.partner
        match, kind_of, n = _TOKEN.match, _KIND.get, len(self.text)
        stack: list[int] = []
        add, add_start = kinds.append, starts.append
        while True:
            m = match(text, pos)
            if m is None:
                rest = pos
                while rest < n and text[rest] in " \t\x0b\x0c\xa0\ufeff\u1680\u202f\u205f\u3000\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a":
                    rest += 1
                if rest >= n:
                    break
                self.errors.append((rest, "unterminated comment" if text.startswith("/*", rest) else "unterminated string" if text[rest] in "\"'" else "unexpected character"))
                if text.startswith("/*", rest):
                    break
                add("?")
                add_start(rest)
                pos = rest + 1
                continue
            k = m.lastindex
            pos = m.end()
            if k == 1:
                word = m[1]
                if "\\" in word:
                    word = _UNICODE_NAME.sub(lambda x: chr(min(int(x[1], 16), 0x10FFFF)), word)
                    add("?" if word in RESERVED else "I")
                else:
                    add(kind_of(word, "I"))
                add_start(m.start(1))
            elif k == 2:
                p = m[2]
                if p == "<" and text.startswith("!--", pos):  # comment of old
                    pos = re.compile(r"[^\n\r\u2028\u2029]*").match(text, pos).end()
                    continue
                if p == "--" and text.startswith(">", pos) and (not kinds or len(kinds) in lines):
                    pos = re.compile(r"[^\n\r\u2028\u2029]*").match(text, pos).end()
                    continue
                add(p)
                add_start(pos - len(p))
            elif k == 3:
                lines.add(len(kinds))
            elif k == 4:
                b = text[pos - 1]
                i = len(kinds)
                if b in "([{":
                    stack.append(i)
                elif stack and kinds[stack[-1]] + b in ("()", "[]", "{}"):
                    partner[stack.pop()] = i
                elif inside and b == "}" and not stack:
                    return pos
                add(b)
                add_start(pos - 1)
            elif k == 5:
                s = m[5]
                if "\\" in s:
                    if _ESCAPE.search(s.replace("\\\\", "")):
                        self.errors.append((m.start(5), "bad escape in a string"))
                    if _OCTAL.search(s.replace("\\\\", "")):
                        self.octal.append(len(kinds))
                add("S")
                add_start(m.start(5))
            elif k == 6:
                pass
            elif k == 7:
                if "\n" in m[7] or "\r" in m[7]:
                    lines.add(len(kinds))
            elif k == 8:
                t = m[8]
                if t[0] == "0" and len(t) > 1 and t[1].isdigit():
                    self.octal.append(len(kinds))
                    if t[:2] != "0." and all(c in "01234567" for c in t.partition(".")[0]) and "." in t:
                        pos = m.start(8) + len(t.partition(".")[0])
                if pos < n and _NAME_START.match(text, pos):
                    self.errors.append((pos, "name directly after a number"))
                add("N")
                add_start(m.start(8))
            elif k == 9:
                pos = self._template(pos)
            elif k == 10:
                if self._regex_may_start():
                    r = _REGEX.match(text, m.start(10))
                    if r is None:
                        self.errors.append((m.start(10), "unterminated regular expression"))
                        add("?")
                    else:
                        pos = r.end()
                        if why := _bad_regex(r[1], r[2]):
                            self.errors.append((m.start(10), why))
                        add("R")
                else:
                    add(m[10])
                add_start(m.start(10))
            else:
                add("#")
                add_start(m.start(11))
        if inside:
            self.errors.append((n, "unterminated template"))
        return n

    def _template(self, pos: int) -> int:
        """Tokens of a template whose opening quote ends at ``pos``."""
        text, kinds, starts = self.text, self.kinds, self.starts
        tagged = bool(kinds) and (kinds[-1] in _OPERAND_END or kinds[-1] in (")", "}"))
        first, begin = True, pos - 1
        while True:
            end = _CHUNK.match(text, pos).end()
            part = text[pos:end]
            if not tagged and "\\" in part and (_ESCAPE.search(part.replace("\\\\", "")) or _OCTAL.search(part.replace("\\\\", ""))):
                self.errors.append((pos, "bad escape in a template"))
            if end >= len(text):
                self.errors.append((begin, "unterminated template"))
                return end
            if text[end] == "`":
                kinds.append("T" if first else "TE")
                starts.append(begin if first else end)
                return end + 1
            kinds.append("T{")
            starts.append(begin if first else end)
            first = False
            pos = self._run(end + 2, True)
            kinds.append("T}")
            starts.append(pos - 1)
            if pos >= len(text):
                return pos

    def _opener(self) -> int:
        """The token that the last token, a closing bracket, closes; -1 if none."""
        depth = 0
        for i in range(len(self.kinds) - 1, -1, -1):
            k = self.kinds[i]
            if k in (")", "]", "}", "TE"):
                depth += 1
            elif k in ("(", "[", "{") or k == "T{" and (i == 0 or self.kinds[i - 1] != "T}"):
                depth -= 1
                if depth == 0:
                    return i
        return -1

    def _regex_may_start(self) -> bool:
        kinds = self.kinds
        if not kinds:
            return True
        k = kinds[-1]
        if k == "++" or k == "--":
            return len(kinds) > 1 and kinds[-2] not in _OPERAND_END and kinds[-2] not in (")", "}")
        if k in _OPERAND_END and k != "yield" and k != "await":
            return False
        if len(kinds) > 1 and kinds[-2] in (".", "?."):
            return False  # a word after a dot is a name
        if k == "yield" or k == "await":
            self.doubtful = True
            return not self.words_end
        if k == ")":
            i = self._opener()
            return i > 0 and kinds[i - 1] in ("if", "while", "for", "with") and not (i > 1 and kinds[i - 2] in (".", "?."))
        if k == "}":
            i = self._opener()
            if i <= 0:
                return True
            before = kinds[i - 1]
            if before == ")":  # a block, or the body of a function that itself is an operand
                self_kinds, j, depth = kinds, i - 1, 0
                while j >= 0:
                    depth += (self_kinds[j] == ")") - (self_kinds[j] == "(")
                    if depth == 0:
                        break
                    j -= 1
                f = j - 1
                if f >= 0 and kinds[f] in NAMES:
                    f -= 1
                if f >= 0 and kinds[f] == "*":
                    f -= 1
                if f >= 0 and kinds[f] == "function":
                    return f == 0 or kinds[f - 1] in (";", "{", "}", "async") or f in self.lines and kinds[f - 1] not in ("=", "(", ",", ":", "return", "=>")
                return True
            return before in (";", "{", "}", "else", "do", "try", "finally", "=>", ":") or i in self.lines and before in _OPERAND_END
        return True


_GROUP = re.compile(r"\(\?(?:[:=!]|<[=!]|<([A-Za-z_$][\w$]*)>|(?:[ims]*-?[ims]*):)?")
_COUNT = re.compile(r"\{(\d+)(?:,(\d*))?\}")
_U_ESCAPE = re.compile(r"u(?:[0-9a-fA-F]{4}|\{([0-9a-fA-F]+)\})|x[0-9a-fA-F]{2}|c[A-Za-z]|[pP]\{[\w=]+\}|k<([A-Za-z_$][\w$]*)>|0(?![0-9])|[1-9][0-9]*|[bBdDsSwWfnrtv^$\\.*+?()\[\]{}|/]")
# What else may be escaped in a class, by flag, and what must be in a class of the flag v.
_CLASS_ESCAPE = {"u": "-", "v": "-&!#%,:;<=>@`~"}
_DOUBLED = re.compile(r"(&&|!!|##|\$\$|%%|\*\*|\+\+|,,|\.\.|::|;;|<<|==|>>|\?\?|@@|\^\^|``|~~)")


class _BadRegex(Exception):
    pass


class _Regex:
    """The rules of a regular expression's body. ``mode`` is u, v or ''."""

    def __init__(self, body: str, mode: str):
        self.body, self.mode = body, mode
        self.names: list[str] = []
        self.wanted: list[str] = []  # names referred to
        self.groups = self.greatest = 0

    def escape(self, i: int, inside: bool) -> tuple[int, int | None]:
        """End of the escape at ``i``, and the character it stands for; None for a set of them."""
        body = self.body
        if not self.mode:
            if body.startswith("k<", i + 1) and (m := re.compile(r"k<([^>]*)>").match(body, i + 1)):
                self.wanted.append(m[1])
            c = body[i + 1 : i + 2]
            return i + 2, None if c in set("dDsSwWbBuxc0123456789pPk") else ord({"n": "\n", "r": "\r", "t": "\t", "v": "\v", "f": "\f"}.get(c, c or "\\"))
        m = _U_ESCAPE.match(body, i + 1)
        if m is None:
            if inside and body[i + 1 : i + 2] in _CLASS_ESCAPE[self.mode]:
                return i + 2, ord(body[i + 1])
            if self.mode == "v" and inside and (q := re.compile(r"q\{[^}]*\}").match(body, i + 1)):
                return q.end(), None
            raise _BadRegex("bad escape in a regular expression")
        e = m[0]
        if m[1] and int(m[1], 16) > 0x10FFFF:
            raise _BadRegex("bad escape in a regular expression")
        if inside and (e[0] in "kB" or e[0] in "123456789"):
            raise _BadRegex("bad escape in a regular expression")
        if m[2]:
            self.wanted.append(m[2])
        elif e[0] in "123456789":
            self.greatest = max(self.greatest, int(e))
        if e[0] in "dDsSwWpPk" or not inside and e[0] in "bB":
            return m.end(), None
        known = {"n": 10, "r": 13, "t": 9, "v": 11, "f": 12, "b": 8, "0": 0}
        return m.end(), int(m[1] or e[1:], 16) if e[0] in "ux" else ord(e[1]) % 32 if e[0] == "c" else known.get(e, ord(e[0]))

    def one(self, i: int) -> tuple[int, int | None]:
        """A character of a class."""
        return self.escape(i, True) if self.body[i] == "\\" else (i + 1, ord(self.body[i]))

    def plain_class(self, i: int) -> int:
        """End of the class that begins at ``i``, whose nested brackets mean nothing."""
        body, n = self.body, len(self.body)
        i += 1 + body.startswith("^", i + 1)
        while i < n and body[i] != "]":
            i, a = self.one(i)
            if i + 1 < n and body[i] == "-" and body[i + 1] != "]":
                i, b = self.one(i + 1)
                if a is None or b is None:
                    if self.mode:
                        raise _BadRegex("bad range in a regular expression")
                elif a > b:
                    raise _BadRegex("range out of order in a regular expression")
        if i >= n:
            raise _BadRegex("unterminated class in a regular expression")
        return i + 1

    def set_class(self, i: int) -> int:
        """End of a class of the flag v, which may hold others and operators between them. Without calls, whatever the depth."""
        body, n = self.body, len(self.body)
        open_: list[list] = []  # of each class around: operator, whether an operand has just ended, number of operands
        while True:
            if i >= n:
                raise _BadRegex("unterminated class in a regular expression")
            c = body[i]
            here = open_[-1] if open_ else None
            pair = body[i : i + 2]
            if c == "[":
                if here and here[0] in ("--", "&&") and here[1]:
                    raise _BadRegex("operators of a class mixed in a regular expression")
                open_.append(["", False, 0])
                i += 1 + body.startswith("^", i + 1)
            elif c == "]":
                if here[0] in ("--", "&&") and not here[1]:
                    raise _BadRegex("operand missing in a class of a regular expression")
                open_.pop()
                i += 1
                if not open_:
                    return i
                open_[-1][1], open_[-1][2] = True, open_[-1][2] + 1
            elif pair in ("--", "&&"):
                if not here[1] or here[0] not in ("", pair) or here[0] == "" and here[2] > 1:
                    raise _BadRegex("operators of a class mixed in a regular expression")
                here[0], here[1] = pair, False
                i += 2
            elif c in "()[]{}/-|" or _DOUBLED.match(body, i):
                raise _BadRegex("character to be escaped in a class of a regular expression")
            else:
                if here[0] in ("--", "&&") and here[1]:
                    raise _BadRegex("operators of a class mixed in a regular expression")
                i, a = self.one(i)
                if body.startswith("-", i) and not body.startswith("--", i) and i + 1 < n:
                    i, b = self.one(i + 1)
                    if a is None or b is None or here[0]:
                        raise _BadRegex("bad range in a regular expression")
                    if a > b:
                        raise _BadRegex("range out of order in a regular expression")
                    here[2] += 1  # a range is no operand
                here[1], here[2] = True, here[2] + 1

    def check(self) -> None:
        body, n = self.body, len(self.body)
        depth = i = 0
        atom = False  # whether something stands here that can be repeated
        looks: list[bool] = []  # of each group around: whether it is an assertion that can't be repeated
        while i < n:
            c = body[i]
            if c == "\\":
                end, _ = self.escape(i, False)
                i, atom = end, not (self.mode and body[i + 1] in "bB")
            elif c == "[":
                i, atom = (self.set_class if self.mode == "v" else self.plain_class)(i), True
            elif c == "(":
                depth += 1
                look = False
                if body.startswith("(?", i):
                    m = _GROUP.match(body, i)
                    if m.end() == i + 2:
                        raise _BadRegex("bad group in a regular expression")
                    if m[1]:
                        self.names.append(m[1])
                        self.groups += 1
                    look = m[0] in ("(?<=", "(?<!") or bool(self.mode) and m[0] in ("(?=", "(?!")
                    i = m.end()
                else:
                    self.groups += 1
                    i += 1
                looks.append(look)
                atom = False
            elif c == ")":
                depth -= 1
                if depth < 0:
                    raise _BadRegex("unmatched ) in a regular expression")
                i, atom = i + 1, not looks.pop()
            elif c in "*+?" or c == "{" and (q := _COUNT.match(body, i)):
                if not atom:
                    raise _BadRegex("nothing to repeat in a regular expression")
                if c == "{":
                    if q[2] and int(q[2]) < int(q[1]):
                        raise _BadRegex("numbers out of order in a regular expression")
                    i = q.end()
                else:
                    i += 1
                if i < n and body[i] == "?":
                    i += 1
                atom = False
            elif c == "|":
                i, atom = i + 1, False
            elif self.mode and c in "{}]":
                raise _BadRegex("lone bracket in a regular expression")
            else:
                i, atom = i + 1, c not in "^$"
        if depth:
            raise _BadRegex("unterminated group in a regular expression")
        if len(self.names) != len(set(self.names)) and "|" not in body:
            raise _BadRegex("name of a group given twice")
        if (self.mode or self.names) and set(self.wanted) - set(self.names) or self.greatest > self.groups:
            raise _BadRegex("reference to no group in a regular expression")


def _bad_regex(body: str, flags: str) -> str:
    """What forbids a regular expression, or ''."""
    if len(set(flags)) < len(flags) or set(flags) - set("dgimsuvy") or "u" in flags and "v" in flags:
        return "bad flags of a regular expression"
    try:
        _Regex(body, "u" if "u" in flags else "v" if "v" in flags else "").check()
    except _BadRegex as e:
        return str(e)
    return ""


class _Scope:
    __slots__ = ("function", "functions", "lexical", "parameters", "vars")

    def __init__(self, function: bool):
        self.function, self.lexical, self.vars, self.functions, self.parameters = function, set(), set(), set(), set()


class _Parser:
    def __init__(self, text: str, words_end: bool = False):
        self.lx = lx = _Lexer(text, words_end)
        self.text, self.k, self.starts, self.lines, self.partner = text, lx.kinds, lx.starts, lx.lines, lx.partner
        self.errors: list[tuple[int, str]] = []
        self.strict = self.in_async = self.in_generator = self.in_function = self.in_static = False
        self.super_call = self.super_member = False
        self.no_in = False
        self.loops = self.switches = 0
        self.labels: list[tuple[str, bool]] = []
        self.scopes = [_Scope(True)]
        self.private: list[tuple[dict, list]] = []
        self.target = 0  # of the operand just read: 2 name, 1 member, 0 no target of an assignment
        self.octal = set(lx.octal)

    # helpers

    def name(self, i: int) -> str:
        a, text = self.starts[i], self.text
        m = _TOKEN.match(text, a)
        word = m[1] or m[11] or ""
        return _UNICODE_NAME.sub(lambda x: chr(min(int(x[1], 16), 0x10FFFF)), word) if "\\" in word else word

    def fail(self, i: int, why: str = "") -> None:
        k = self.k[i]
        raise _Bad(i, why or ("unexpected end" if k == "end" else f"unexpected {k}" if k not in ("I", "N", "S", "R", "E") else "unexpected " + {"N": "number", "S": "string", "R": "regular expression"}.get(k, "name")))

    def need(self, i: int, kind: str) -> int:
        if self.k[i] != kind:
            self.fail(i)
        return i + 1

    def semicolon(self, i: int) -> int:
        k = self.k[i]
        if k == ";":
            return i + 1
        if k == "}" or k == "end" or i in self.lines:
            return i
        self.fail(i)

    def identifier(self, i: int, binding: bool = True) -> int:
        """A name that may be declared or referred to here."""
        k = self.k[i]
        if k == "I":
            if self.strict and self.name(i) in STRICT_RESERVED:
                self.fail(i, "reserved word")
            return i + 1
        if k not in NAMES:
            self.fail(i)
        if k == "E":
            if self.strict and binding:
                self.fail(i, "eval and arguments can't be bound in strict code")
        elif k == "yield":
            if self.strict or self.in_generator:
                self.fail(i, "reserved word")
        elif k == "await":
            if self.in_async or self.in_static:
                self.fail(i, "reserved word")
        elif self.strict and (k == "let" or k == "static"):
            self.fail(i, "reserved word")
        return i + 1

    def declare(self, i: int, how: str) -> None:
        name = self.name(i)
        top = self.scopes[-1]
        if how == "var":
            for s in reversed(self.scopes):
                if name in s.lexical or (name in s.functions and not s.function):
                    self.fail(i, "name declared twice")
                s.vars.add(name)
                if s.function:
                    break
        elif how == "function" and top.function:
            if name in top.lexical:
                self.fail(i, "name declared twice")
            top.functions.add(name)
        elif how == "function":
            if name in top.lexical or name in top.vars or (self.strict and name in top.functions):
                self.fail(i, "name declared twice")
            top.functions.add(name)
        elif how == "parameter":
            top.parameters.add(name)
        else:
            if name in top.lexical or name in top.vars or name in top.functions or name in top.parameters:
                self.fail(i, "name declared twice")
            if name == "let":
                self.fail(i, "let can't be a lexical name")
            top.lexical.add(name)

    # statements

    def script(self) -> None:
        i = self.directives(0)
        k = self.k
        while k[i] != "end":
            i = self.guarded(i)

    def guarded(self, i: int) -> int:
        """A statement; after an error, the place from which parsing may go on (panic mode)."""
        depth = len(self.scopes)
        try:
            return self.item(i)
        except _Bad as bad:
            self.errors.append((self.starts[bad.at], bad.why))
            del self.scopes[depth:]
            del self.private[:]
            self.no_in = False
            return self.recover(max(bad.at, i))

    def recover(self, i: int) -> int:
        k, lines = self.k, self.lines
        depth = 0
        start = i
        while k[i] != "end":
            if k[i] in ("{", "(", "["):
                depth += 1
            elif k[i] in ("}", ")", "]"):
                depth -= 1
                if depth < 0:
                    return i + 1
            elif depth == 0 and k[i] == ";":
                return i + 1
            if depth <= 0 and i > start and i in lines and k[i] in ("var", "let", "const", "function", "class", "if", "for", "while", "do", "switch", "try", "return", "throw", "I", "async"):
                return i
            i += 1
        return i

    def directives(self, i: int) -> int:
        """Sets strict mode if a directive at ``i`` asks for it; does not move."""
        j, k = i, self.k
        seen = []
        while k[j] == "S" and (k[j + 1] in (";", "}", "end") or j + 1 in self.lines and k[j + 1] not in BINARY and k[j + 1] not in ASSIGN and k[j + 1] not in (".", "(", "[", ",", "?", "?.", "T", "T{")):
            seen.append(j)
            if self.text.startswith(("'use strict'", '"use strict"'), self.starts[j]):
                self.strict = True
                if any(s in self.octal for s in seen):
                    self.fail(j, "octal escape in strict code")
            j += 2 if k[j + 1] == ";" else 1
        return i

    def item(self, i: int) -> int:
        """A statement or declaration."""
        k = self.k[i]
        if k == "function":
            return self.function(i, "declaration")
        if k == "const":
            return self.lexical(i)
        if k == "class":
            return self.klass(i, True)
        if k == "let" and (self.k[i + 1] in NAMES or self.k[i + 1] in ("[", "{")):
            return self.lexical(i)
        if k == "async" and self.k[i + 1] == "function" and i + 1 not in self.lines:
            return self.function(i, "declaration")
        return self.statement(i)

    def lexical(self, i: int) -> int:
        i = self.bindings(i + 1, self.k[i])
        return self.semicolon(i)

    def bindings(self, i: int, how: str, head: bool = False) -> int:
        """Declared names with initialisers, after var, let or const. In the head of a for loop initialisers may be missing."""
        k = self.k
        while True:
            if k[i] == "[" or k[i] == "{":
                i = self.pattern(i, "var" if how == "var" else "lexical")
                if k[i] != "=" and not (head and (k[i] == "of" or k[i] == "in")):
                    self.fail(i, "pattern without a value")
            else:
                j = self.identifier(i)
                self.declare(i, "var" if how == "var" else "lexical")
                i = j
                if how == "const" and k[i] != "=" and not (head and (k[i] == "of" or k[i] == "in")):
                    self.fail(i, "constant without a value")
            if k[i] == "=":
                i = self.assign(i + 1)
            if k[i] != ",":
                return i
            i += 1

    def pattern(self, i: int, how: str) -> int:
        """A destructuring pattern that declares names."""
        k = self.k
        close = "]" if k[i] == "[" else "}"
        i += 1
        while k[i] != close:
            if k[i] == "," and close == "]":
                i += 1
                continue
            if k[i] == "...":
                i = self.binding_element(i + 1, how, close == "]")
                break
            if close == "]":
                i = self.binding_element(i, how)
            else:
                j = self.property_name(i)
                if k[j] == ":":
                    i = self.binding_element(j + 1, how)
                else:
                    j = self.identifier(i)
                    self.declare(i, how)
                    i = j
            if k[i] == "=":
                was, self.no_in = self.no_in, False
                i = self.assign(i + 1)
                self.no_in = was
            if k[i] != ",":
                break
            i += 1
        return self.need(i, close)

    def binding_element(self, i: int, how: str, nested: bool = True) -> int:
        if nested and self.k[i] in ("[", "{"):
            return self.pattern(i, how)
        j = self.identifier(i)
        self.declare(i, how)
        return j

    def block(self, i: int, new_scope: bool = True) -> int:
        i = self.need(i, "{")
        if new_scope:
            self.scopes.append(_Scope(False))
        k = self.k
        while k[i] != "}":
            if k[i] == "end":
                self.fail(i)
            i = self.item(i)
        if new_scope:
            self.scopes.pop()
        return i + 1

    def statement(self, i: int) -> int:
        handler = _STATEMENTS.get(self.k[i])
        if handler is not None:
            return handler(self, i)
        k = self.k
        if k[i] in NAMES and k[i + 1] == ":":
            return self.labelled(i)
        if k[i] == "let" and k[i + 1] == "[":
            self.fail(i)
        i = self.expression(i)
        if k[i] == ";":
            return i + 1
        return self.semicolon(i)

    def body(self, i: int) -> int:
        """The statement that a control structure governs; no declaration."""
        k = self.k[i]
        if k in ("class", "const") or k == "let" and (self.k[i + 1] == "[" or self.k[i + 1] in ("{", *NAMES) and i + 1 not in self.lines):
            self.fail(i, "declaration where a statement is due")
        if k == "function" or k == "async" and self.k[i + 1] == "function" and i + 1 not in self.lines:
            self.fail(i, "declaration where a statement is due")
        return self.statement(i)

    def loop_body(self, i: int) -> int:
        self.loops += 1
        i = self.body(i)
        self.loops -= 1
        return i

    def s_empty(self, i: int) -> int:
        return i + 1

    def s_var(self, i: int) -> int:
        return self.semicolon(self.bindings(i + 1, "var"))

    def s_if(self, i: int) -> int:
        i = self.need(self.expression(self.need(i + 1, "(")), ")")
        i = self.branch(i)
        return self.branch(i + 1) if self.k[i] == "else" else i

    def branch(self, i: int) -> int:
        if self.k[i] == "function" and not self.strict and self.k[i + 1] != "*":
            self.scopes.append(_Scope(False))
            i = self.function(i, "declaration")
            self.scopes.pop()
            return i
        return self.body(i)

    def s_while(self, i: int) -> int:
        return self.loop_body(self.need(self.expression(self.need(i + 1, "(")), ")"))

    def s_do(self, i: int) -> int:
        i = self.need(self.loop_body(i + 1), "while")
        i = self.need(self.expression(self.need(i, "(")), ")")
        return i + 1 if self.k[i] == ";" else i

    def s_for(self, i: int) -> int:
        k = self.k
        i += 1
        each_await = False
        if k[i] == "await":
            if not self.in_async:
                self.fail(i)
            each_await = True
            i += 1
        i = self.need(i, "(")
        self.scopes.append(_Scope(False))
        self.no_in = True
        first = k[i]
        declared = first in ("var", "const") or first == "let" and (k[i + 1] in NAMES and k[i + 1] not in ("of",) or k[i + 1] in ("[", "{") or k[i + 1] == "of" and k[i + 2] in ("=", ";", ",", "of"))
        is_each = False
        if first == ";":
            pass
        elif declared:
            a = i + 1
            i = self.bindings(a, first, head=True)
            is_each = k[i] in ("of", "in")
            if is_each:
                end = self.partner.get(a, a) + 1 if k[a] in ("[", "{") else a + 1
                if i != end and not (first == "var" and k[i] == "in" and not self.strict and k[a] in NAMES and k[end] == "="):
                    self.fail(i)
        else:
            close = self.partner.get(i) if first in ("[", "{") else None
            if close is not None and k[close + 1] in ("of", "in"):
                i = self.assignment_pattern(i)
                is_each = True
            else:
                start = i
                if k[i] == "async" and k[i + 1] == "of" and k[i + 2] != "=>":
                    self.fail(i)
                self.target = 0
                i = self.expression(i)
                if k[i] in ("of", "in"):
                    if not self.target or k[i] == "of" and k[start] == "let":
                        self.fail(i, "no target of an assignment")
                    is_each = True
        self.no_in = False
        if is_each:
            i = self.assign(i + 1) if k[i] == "of" else self.expression(i + 1)
        else:
            if each_await:
                self.fail(i)
            i = self.need(i, ";")
            if k[i] != ";":
                i = self.expression(i)
            i = self.need(i, ";")
            if k[i] != ")":
                i = self.expression(i)
        i = self.loop_body(self.need(i, ")"))
        self.scopes.pop()
        return i

    def s_jump(self, i: int) -> int:
        k = self.k
        word = k[i]
        j = i + 1
        if k[j] in NAMES and j not in self.lines:
            label = self.name(j)
            if not any(n == label and (word == "break" or loop) for n, loop in self.labels):
                self.fail(j, "label that is not there")
            j += 1
        elif not (self.loops or word == "break" and self.switches):
            self.fail(i, f"{word} without a goal")
        return self.semicolon(j)

    def s_return(self, i: int) -> int:
        if not self.in_function:
            self.fail(i, "return outside a function")
        i += 1
        if self.k[i] not in (";", "}", "end") and i not in self.lines:
            i = self.expression(i)
        return self.semicolon(i)

    def s_throw(self, i: int) -> int:
        if i + 1 in self.lines:
            self.fail(i + 1, "new line after throw")
        return self.semicolon(self.expression(i + 1))

    def s_try(self, i: int) -> int:
        k = self.k
        i = self.block(i + 1)
        if k[i] == "catch":
            i += 1
            self.scopes.append(_Scope(False))
            if k[i] == "(":
                i += 1
                if k[i] in ("[", "{"):
                    i = self.pattern(i, "lexical")
                else:
                    j = self.identifier(i)
                    self.declare(i, "parameter")
                    i = j
                i = self.need(i, ")")
            i = self.block(i, False)
            self.scopes.pop()
            if k[i] != "finally":
                return i
        elif k[i] != "finally":
            self.fail(i, "try without catch or finally")
        return self.block(i + 1)

    def s_switch(self, i: int) -> int:
        k = self.k
        i = self.need(self.need(self.expression(self.need(i + 1, "(")), ")"), "{")
        self.scopes.append(_Scope(False))
        self.switches += 1
        default = False
        while k[i] != "}":
            if k[i] == "case":
                i = self.need(self.expression(i + 1), ":")
            elif k[i] == "default" and not default:
                default = True
                i = self.need(i + 1, ":")
            else:
                self.fail(i)
            while k[i] not in ("case", "default", "}"):
                if k[i] == "end":
                    self.fail(i)
                i = self.item(i)
        self.switches -= 1
        self.scopes.pop()
        return i + 1

    def s_with(self, i: int) -> int:
        if self.strict:
            self.fail(i, "with in strict code")
        return self.body(self.need(self.expression(self.need(i + 1, "(")), ")"))

    def s_debugger(self, i: int) -> int:
        return self.semicolon(i + 1)

    def s_import(self, i: int) -> int:
        if self.k[i + 1] != "(":
            self.fail(i, "import in a script")
        return self.semicolon(self.expression(i))

    def s_export(self, i: int) -> int:
        self.fail(i, "export in a script")

    def s_block(self, i: int) -> int:
        return self.block(i)

    def labelled(self, i: int) -> int:
        self.identifier(i, False)
        label, k = self.name(i), self.k
        if any(n == label for n, _ in self.labels):
            self.fail(i, "label given twice")
        j = i + 2
        while k[j] in NAMES and k[j + 1] == ":":
            j += 2
        self.labels.append((label, k[j] in ("for", "while", "do")))
        i += 2
        if k[i] == "function" and not self.strict and k[i + 1] != "*":
            i = self.function(i, "declaration")
        else:
            i = self.body(i)
        self.labels.pop()
        return i

    # functions and classes

    def function(self, i: int, where: str) -> int:
        """A function with its keyword, as a declaration or an expression."""
        k = self.k
        is_async = k[i] == "async"
        i += 1 + is_async
        generator = k[i] == "*"
        i += generator
        if where == "declaration":
            j = self.identifier(i)
            self.declare(i, "function" if not (is_async or generator) or self.scopes[-1].function else "lexical")
            i = j
        elif k[i] != "(":
            was = self.in_async, self.in_generator
            self.in_async, self.in_generator = is_async, generator
            i = self.identifier(i)
            self.in_async, self.in_generator = was
        return self.callable(i, is_async, generator)

    def callable(self, i: int, is_async: bool, generator: bool, arrow: bool = False, method: str = "", bare: bool = False) -> int:
        """Parameters and body. ``bare``: one parameter without parentheses."""
        k = self.k
        was = (self.strict, self.in_async, self.in_generator, self.in_function, self.in_static, self.super_call, self.super_member, self.loops, self.switches, self.labels, self.no_in)
        begin = i
        self.in_async, self.in_generator, self.no_in = is_async, generator, False
        if arrow:
            self.in_async = is_async
            self.in_generator = False
        else:
            self.in_static = False
            self.super_member = bool(method)
            self.super_call = method == "derived"
        self.loops = self.switches = 0
        self.labels = []
        scope = _Scope(True)
        self.scopes.append(scope)
        simple = True
        names: list[str] = []
        if bare:
            i = self.identifier(i)
            self.declare(i - 1, "parameter")
        else:
            i = self.need(i, "(")
            while k[i] != ")":
                rest = k[i] == "..."
                i += rest
                if k[i] == "[" or k[i] == "{":
                    simple = False
                    i = self.pattern(i, "parameter")
                else:
                    j = self.identifier(i)
                    name = self.name(i)
                    names.append(name)
                    scope.parameters.add(name)
                    i = j
                if rest:
                    simple = False
                    break
                if k[i] == "=":
                    simple = False
                    i = self.assign(i + 1)
                if k[i] != ",":
                    break
                i += 1
            i = self.need(i, ")")
        if method == "get" and i != begin + 2:
            self.fail(begin, "getter with a parameter")
        if method == "set" and (k[begin + 1] in (")", "...") or len(names) > 1):
            self.fail(begin, "setter without its one parameter")
        if arrow:
            if k[i] != "=>" or i in self.lines:
                self.fail(i)
            i += 1
        if arrow and k[i] != "{":
            self.no_in = was[-1]
            if (arrow or self.strict or not simple) and len(names) != len(set(names)):
                self.fail(begin, "parameter named twice")
            i = self.assign(i)
        else:
            self.in_function = True
            if k[i] != "{":
                self.fail(i)
            before = self.strict
            self.directives(i + 1)
            if self.strict and not before:
                if not simple:
                    self.fail(i + 1, "use strict in a function with other than plain parameters")
                if any(n in ("eval", "arguments") or n in STRICT_RESERVED for n in names):
                    self.fail(begin, "reserved word")
            if (arrow or method or self.strict or not simple) and len(names) != len(set(names)):
                self.fail(begin, "parameter named twice")
            i = self.block(i, False)
        self.scopes.pop()
        (self.strict, self.in_async, self.in_generator, self.in_function, self.in_static, self.super_call, self.super_member, self.loops, self.switches, self.labels, self.no_in) = was
        return i

    def property_name(self, i: int) -> int:
        k = self.k[i]
        if k == "[":
            was, self.no_in = self.no_in, False
            i = self.need(self.assign(i + 1), "]")
            self.no_in = was
            return i
        if k in NAMES or k == "S" or k == "N" or k in RESERVED:
            if k == "S" or k == "N":
                if self.strict and i in self.octal:
                    self.fail(i, "octal number in strict code")
            return i + 1
        self.fail(i)

    def klass(self, i: int, declaration: bool) -> int:
        k = self.k
        was, self.strict = self.strict, True
        i += 1
        if k[i] in NAMES:
            j = self.identifier(i)
            if declaration:
                self.declare(i, "lexical")
            i = j
        elif declaration:
            self.fail(i)
        derived = k[i] == "extends"
        if derived:
            i = self.operand(i + 1)
        i = self.need(i, "{")
        declared: dict[str, str] = {}
        self.private.append((declared, []))
        constructor = False
        while k[i] != "}":
            if k[i] == ";":
                i += 1
                continue
            static = k[i] == "static" and k[i + 1] not in ("(", "=", ";", "}")
            i += static
            if static and k[i] == "{":
                keep = self.in_function, self.in_static, self.in_async, self.in_generator, self.super_member, self.super_call, self.loops, self.switches, self.labels
                self.in_function, self.in_static, self.in_async, self.in_generator, self.super_member, self.super_call, self.loops, self.switches, self.labels = False, True, False, False, True, False, 0, 0, []
                self.scopes.append(_Scope(True))
                i = self.block(i, False)
                self.scopes.pop()
                self.in_function, self.in_static, self.in_async, self.in_generator, self.super_member, self.super_call, self.loops, self.switches, self.labels = keep
                continue
            is_async = k[i] == "async" and k[i + 1] not in ("(", "=", ";", "}") and i + 1 not in self.lines
            i += is_async
            generator = k[i] == "*"
            i += generator
            accessor = k[i] if not is_async and not generator and k[i] in ("get", "set") and k[i + 1] not in ("(", "=", ";", "}", "end") and not (i + 1 in self.lines and k[i + 1] == "*") else ""
            i += bool(accessor)
            at = i
            word = self.name(i) if k[i] in NAMES or k[i] == "#" else self.text[self.starts[i] + 1 : self.starts[i] + 12] if k[i] == "S" and self.text[self.starts[i] + 12 : self.starts[i] + 13] in ("'", '"') else ""
            if k[i] == "#":
                kind = accessor + str(static) if accessor else "other"
                if word == "#constructor":
                    self.fail(i, "private name constructor")
                have = declared.get(word)
                if have is not None and not (accessor and have in (f"get{static}", f"set{static}") and have != kind):
                    self.fail(i, "private name declared twice")
                declared[word] = kind if have is None else "other"
                i += 1
            else:
                i = self.property_name(i)
            if k[i] == "(":
                method = accessor or "method"
                if not static and word == "constructor":
                    if accessor or is_async or generator or constructor:
                        self.fail(at, "bad constructor")
                    constructor = True
                    method = "derived" if derived else "method"
                if static and word == "prototype":
                    self.fail(at, "static prototype")
                i = self.callable(i, is_async, generator, method=method)
                continue
            if accessor or is_async or generator or word == "constructor" or static and word == "prototype":
                self.fail(i)
            if k[i] == "=":
                keep = self.in_function, self.in_async, self.in_generator, self.super_member, self.super_call, self.in_static
                self.in_function, self.in_async, self.in_generator, self.super_member, self.super_call, self.in_static = False, False, False, True, False, False
                i = self.assign(i + 1)
                self.in_function, self.in_async, self.in_generator, self.super_member, self.super_call, self.in_static = keep
            i = self.semicolon(i)
        _, used = self.private.pop()
        missing = [u for u in used if u[0] not in declared]
        if missing:
            if not self.private:
                self.fail(missing[0][1], "private name that is not declared")
            self.private[-1][1].extend(missing)
        self.strict = was
        self.target = 0
        return i + 1

    def private_use(self, i: int) -> int:
        if not self.private:
            self.fail(i, "private name outside a class")
        self.private[-1][1].append((self.name(i), i))
        return i + 1

    # expressions

    def expression(self, i: int) -> int:
        i = self.assign(i)
        while self.k[i] == ",":
            i = self.assign(i + 1)
            self.target = 0
        return i

    def assign(self, i: int) -> int:
        """An assignment expression: arrows, yield, conditional and assignment."""
        k = self.k
        a = k[i]
        if a in NAMES:
            b = k[i + 1]
            if b == "=>" and i + 1 not in self.lines:
                return self.arrow(i, False, True)
            if a == "async" and i + 1 not in self.lines:
                if b in NAMES and k[i + 2] == "=>" and b != "function":
                    return self.arrow(i + 1, True, True)
                if b == "(" and (p := self.partner.get(i + 1)) is not None and k[p + 1] == "=>" and p + 1 not in self.lines:
                    return self.arrow(i + 1, True, False)
            if a == "yield" and self.in_generator:
                i += 1
                self.target = 0
                if i in self.lines or k[i] in (")", "]", "}", ",", ";", ":", "end", "in", "of", "T}"):
                    return i
                return self.assign(i + (k[i] == "*"))
        elif a == "(":
            p = self.partner.get(i)
            if p is not None and k[p + 1] == "=>" and p + 1 not in self.lines:
                return self.arrow(i, False, False)
        elif a == "[" or a == "{":
            p = self.partner.get(i)
            if p is not None and k[p + 1] == "=":
                i = self.assign(self.assignment_pattern(i) + 1)
                self.target = 0
                return i
        i = self.binary(i, 1)
        b = k[i]
        if b == "?":
            was, self.no_in = self.no_in, False
            i = self.need(self.assign(i + 1), ":")
            self.no_in = was
            i = self.assign(i)
            self.target = 0
        elif b in ASSIGN:
            if not self.target:
                self.fail(i, "no target of an assignment")
            i = self.assign(i + 1)
            self.target = 0
        return i

    def arrow(self, i: int, is_async: bool, bare: bool) -> int:
        i = self.callable(i, is_async, False, arrow=True, bare=bare)
        self.target = 0
        if self.k[i] in BINARY and self.k[i] != "in" and self.k[i - 1] == "}" or self.k[i] == "?" and self.k[i - 1] == "}":
            self.fail(i)
        return i

    def binary(self, i: int, least: int) -> int:
        """Operands joined by operators of precedence ``least`` or more."""
        k = self.k
        if k[i] == "#":
            if k[i + 1] != "in":
                self.fail(i)
            i = self.private_use(i)
            unary = False
        else:
            unary = k[i] in PREFIX or k[i] == "await" and self.in_async
            i = self.operand(i)
        mixed = 0
        while True:
            op = k[i]
            p = BINARY.get(op)
            if p is None or p < least or (op == "in" and self.no_in):
                return i
            if p == 12:
                if unary:
                    self.fail(i, "unary operator before **")
                i = self.binary(i + 1, 12)
            else:
                if p <= 3:
                    part = 1 if p == 1 else 2
                    if mixed and mixed != part:
                        self.fail(i, "?? mixed with || or &&")
                    mixed = part
                    start = i + 1
                    i = self.binary(start, p + 1)
                    if p == 1 and self.last_logic(start, i):
                        self.fail(start, "?? mixed with || or &&")
                else:
                    i = self.binary(i + 1, p + 1)
                unary = False
            self.target = 0

    def last_logic(self, a: int, b: int) -> bool:
        """Whether the operand of ?? between two tokens has an && or || outside brackets."""
        depth, k = 0, self.k
        for j in range(a, b):
            c = k[j]
            if c in ("(", "[", "{", "T{"):
                depth += 1
            elif c in (")", "]", "}", "T}"):
                depth -= 1
            elif depth == 0 and (c == "&&" or c == "||"):
                return True
        return False

    def operand(self, i: int) -> int:
        """Prefix operators, a primary expression, its members and calls, and a postfix operator."""
        k = self.k
        a = k[i]
        if a == "I":
            self.target = 2
            if self.strict and self.name(i) in STRICT_RESERVED:
                self.fail(i, "reserved word")
            i += 1
            # the commonest cases without a further call
            b = k[i]
            if b in (")", ",", ";"):
                return i
        elif a == "S" or a == "N":
            if self.strict and i in self.octal:
                self.fail(i, "octal number in strict code")
            i += 1
            self.target = 0
            if k[i] in (")", ",", ";", "]", "}"):
                return i
        elif a in PREFIX:
            j = self.operand(i + 1)
            if a == "delete" and self.strict and self.target == 2:
                self.fail(i, "delete of a name in strict code")
            self.target = 0
            return j
        elif a == "++" or a == "--":
            j = self.operand(i + 1)
            if not self.target:
                self.fail(i, "no target of an assignment")
            self.target = 0
            return j
        elif a == "await" and self.in_async:
            i = self.operand(i + 1)
            self.target = 0
            return i
        else:
            i = self.primary(i)
        optional = False
        while True:
            b = k[i]
            if b == ".":
                i += 1
                c = k[i]
                if c == "#":
                    i = self.private_use(i)
                elif c in NAMES or c in RESERVED:
                    i += 1
                else:
                    self.fail(i)
                self.target = 1
            elif b == "(":
                i = self.arguments(i)
                self.target = 0
            elif b == "[":
                was, self.no_in = self.no_in, False
                i = self.need(self.expression(i + 1), "]")
                self.no_in = was
                self.target = 1
            elif b == "T" or b == "T{":
                if optional:
                    self.fail(i, "template in an optional chain")
                i = self.template(i)
                self.target = 0
            elif b == "?.":
                optional = True
                c = k[i + 1]
                if c == "(":
                    i = self.arguments(i + 1)
                elif c == "[":
                    was, self.no_in = self.no_in, False
                    i = self.need(self.expression(i + 2), "]")
                    self.no_in = was
                elif c == "#":
                    i = self.private_use(i + 1)
                elif c in NAMES or c in RESERVED:
                    i += 2
                else:
                    self.fail(i + 1)
            elif (b == "++" or b == "--") and i not in self.lines:
                if not self.target or optional:
                    self.fail(i, "no target of an assignment")
                self.target = 0
                return i + 1
            else:
                if optional:
                    self.target = 0
                elif self.target == 2 and self.strict and k[i - 1] == "E" and (b in ASSIGN):
                    self.fail(i - 1, "eval and arguments can't be assigned in strict code")
                return i

    def arguments(self, i: int) -> int:
        k = self.k
        i += 1
        if k[i] == ")":
            return i + 1
        was, self.no_in = self.no_in, False
        while True:
            i = self.assign(i + (k[i] == "..."))
            if k[i] == ",":
                i += 1
                if k[i] == ")":
                    break
            elif k[i] == ")":
                break
            else:
                self.fail(i, "missing ) after arguments" if k[i] != "end" else "")
        self.no_in = was
        return i + 1

    def template(self, i: int) -> int:
        k = self.k
        if k[i] == "T":
            return i + 1
        was, self.no_in = self.no_in, False
        while k[i] == "T{":
            i = self.need(self.expression(i + 1), "T}")
        self.no_in = was
        return self.need(i, "TE")

    def primary(self, i: int) -> int:
        k = self.k
        a = k[i]
        self.target = 0
        if a in ("this", "null", "true", "false", "R"):
            return i + 1
        if a == "(":
            was, self.no_in = self.no_in, False
            i = self.need(self.expression(i + 1), ")")
            self.no_in = was
            return i
        if a == "{":
            return self.object(i)
        if a == "[":
            return self.array(i)
        if a == "function":
            i = self.function(i, "expression")
            self.target = 0
            return i
        if a == "new":
            return self.new(i)
        if a == "T" or a == "T{":
            i = self.template(i)
            self.target = 0
            return i
        if a == "class":
            return self.klass(i, False)
        if a == "async" and k[i + 1] == "function" and i + 1 not in self.lines:
            i = self.function(i, "expression")
            self.target = 0
            return i
        if a in NAMES:
            i = self.identifier(i, False)
            self.target = 2
            return i
        if a == "super":
            b = k[i + 1]
            if not (b == "(" and self.super_call or b in (".", "[") and self.super_member):
                self.fail(i, "super out of place")
            return i + 1
        if a == "import":
            if k[i + 1] != "(":
                self.fail(i, "import in a script")
            j = self.arguments(i + 1)
            if j == i + 3:
                self.fail(i + 2)
            return j
        self.fail(i)

    def new(self, i: int) -> int:
        k = self.k
        i += 1
        if k[i] == ".":
            if not (k[i + 1] == "I" and self.name(i + 1) == "target") or not (self.in_function or self.super_member):
                self.fail(i + 1, "new.target out of place")
            return i + 2
        if k[i] == "new":
            i = self.new(i)
        elif k[i] == "import":
            self.fail(i)
        else:
            i = self.primary(i) if k[i] not in ("S", "N", "I") else i + 1
        while True:
            b = k[i]
            if b == ".":
                i += 1
                if k[i] == "#":
                    i = self.private_use(i)
                elif k[i] in NAMES or k[i] in RESERVED:
                    i += 1
                else:
                    self.fail(i)
                self.target = 1
            elif b == "[":
                was, self.no_in = self.no_in, False
                i = self.need(self.expression(i + 1), "]")
                self.no_in = was
                self.target = 1
            elif b == "T" or b == "T{":
                i = self.template(i)
            elif b == "?.":
                self.fail(i, "optional chain after new")
            else:
                break
        if k[i] == "(":
            i = self.arguments(i)
        self.target = 0
        return i

    def array(self, i: int) -> int:
        k = self.k
        i += 1
        was, self.no_in = self.no_in, False
        while k[i] != "]":
            if k[i] == ",":
                i += 1
                continue
            i = self.assign(i + (k[i] == "..."))
            if k[i] == ",":
                i += 1
            elif k[i] != "]":
                self.fail(i)
        self.no_in = was
        self.target = 0
        return i + 1

    def object(self, i: int) -> int:
        k = self.k
        i += 1
        was, self.no_in = self.no_in, False
        proto = False
        while k[i] != "}":
            a = k[i]
            if a == "...":
                i = self.assign(i + 1)
            else:
                b = k[i + 1]
                if (a == "I" or a == "S") and b == ":":
                    if self.text.startswith("__proto__", self.starts[i] + (a == "S")) and self.name(i) in ("__proto__", ""):
                        if proto:
                            self.fail(i, "__proto__ given twice")
                        proto = True
                    i = self.assign(i + 2)
                elif a in NAMES and (b == "," or b == "}"):
                    i = self.identifier(i, False)
                else:
                    i = self.member(i)
            if k[i] == ",":
                i += 1
            elif k[i] != "}":
                self.fail(i)
        self.no_in = was
        self.target = 0
        return i + 1

    def member(self, i: int) -> int:
        """A member of an object: method, accessor, or name and value."""
        k = self.k
        a, b = k[i], k[i + 1]
        plain = b in ("(", ":", ",", "}", "=")
        is_async = a == "async" and not plain and i + 1 not in self.lines
        i += is_async
        generator = k[i] == "*"
        i += generator
        accessor = "" if is_async or generator or plain or a not in ("get", "set") else a
        i += bool(accessor)
        j = self.property_name(i)
        if k[j] == "(":
            return self.callable(j, is_async, generator, method=accessor or "method")
        if is_async or generator or accessor or k[j] != ":":
            self.fail(j)
        return self.assign(j + 1)

    def assignment_pattern(self, i: int) -> int:
        """A destructuring pattern whose parts are assigned to."""
        k = self.k
        close = "]" if k[i] == "[" else "}"
        i += 1
        was, self.no_in = self.no_in, False
        while k[i] != close:
            if k[i] == "," and close == "]":
                i += 1
                continue
            if k[i] == "...":
                i = self.assignment_target(i + 1)
                break
            if close == "]":
                i = self.assignment_target(i)
            else:
                j = self.property_name(i)
                if k[j] == ":":
                    i = self.assignment_target(j + 1)
                else:
                    i = self.identifier(i)
            if k[i] == "=":
                i = self.assign(i + 1)
            if k[i] != ",":
                break
            i += 1
        self.no_in = was
        return self.need(i, close)

    def assignment_target(self, i: int) -> int:
        k = self.k
        if k[i] in ("[", "{"):
            p = self.partner.get(i)
            if p is not None and k[p + 1] in (",", "=", "]", "}"):
                return self.assignment_pattern(i)
        i = self.operand(i)
        if not self.target:
            self.fail(i, "no target of an assignment")
        return i


_STATEMENTS = {
    ";": _Parser.s_empty, "{": _Parser.s_block, "var": _Parser.s_var, "if": _Parser.s_if, "for": _Parser.s_for, "while": _Parser.s_while, "do": _Parser.s_do,
    "break": _Parser.s_jump, "continue": _Parser.s_jump, "return": _Parser.s_return, "throw": _Parser.s_throw, "try": _Parser.s_try, "switch": _Parser.s_switch,
    "with": _Parser.s_with, "debugger": _Parser.s_debugger, "import": _Parser.s_import, "export": _Parser.s_export,
}


def errors(text: str) -> list[tuple[int, str]]:
    """(position, cause) of every error of a text as a script, in order of position; none if it is one."""
    try:
        p = _Parser(text)
        p.script()
        if p.lx.doubtful and (p.errors or p.lx.errors):  # yield or await may be a name that is divided
            q = _Parser(text, True)
            q.script()
            if not (q.errors or q.lx.errors):
                return []
    except RecursionError:
        return [(0, "nested too deeply")]
    return sorted(p.lx.errors + p.errors)
