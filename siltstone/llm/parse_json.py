"""A recogniser of strict JSON: recursive descent over tokens, and what is wrong where it is not."""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"[ \t\n\r]*(?:(\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null)|([{}\[\],:])|\Z)"
)


def errors(text: str) -> list[tuple[int, str]]:
    """(position, cause) of the errors of a text as one JSON value, a byte-order mark before it allowed. After an error, parsing
    goes on behind the next comma or closing bracket of the same nesting (panic mode)."""
    out: list[tuple[int, str]] = []
    kinds: list[str] = []
    starts: list[int] = []
    pos = 1 if text.startswith("\ufeff") else 0
    match = _TOKEN.match
    n = len(text)
    while True:
        m = match(text, pos)
        if m is None:
            at = re.compile(r"[ \t\n\r]*").match(text, pos).end()
            kinds.append("?")
            starts.append(at)
            # an illegal token goes as far as the next separator
            pos = max(re.compile(r"[^\s,:{}\[\]\"]*").match(text, at).end(), at + 1)
            continue
        k = m.lastindex
        pos = m.end()
        if k is None:
            break
        kinds.append("v" if k < 4 else text[pos - 1])
        if k == 1:
            kinds[-1] = "s"
        starts.append(m.start(k))
    kinds += ["end"] * 2
    starts += [n] * 2

    def fail(i: int) -> None:
        k = kinds[i]
        out.append((starts[i], {"end": "unexpected end", "?": "illegal token", "s": "unexpected string", "v": "unexpected value"}.get(k, f"unexpected {k}")))

    def skip(i: int) -> int:
        """The next comma or closing bracket at this nesting."""
        depth = 0
        while kinds[i] != "end":
            k = kinds[i]
            if depth == 0 and k in ",}]":
                return i
            depth += (k in "{[") - (k in "}]")
            i += 1
        return i

    # A stack instead of calls: a container is its closing bracket.
    i = 0
    stack: list[str] = []
    state = "value"  # what is due: value, first (value or end), key, first key, after
    while True:
        k = kinds[i]
        if state in ("value", "first"):
            if k == "v" or k == "s":
                i, state = i + 1, "after"
            elif k == "{":
                stack.append("}")
                i, state = i + 1, "first key"
            elif k == "[":
                stack.append("]")
                i, state = i + 1, "first"
            elif state == "first" and k == "]":
                stack.pop()
                i, state = i + 1, "after"
            else:
                fail(i)
                i, state = skip(i), "after"
                if kinds[i] == "end":
                    break
        elif state in ("key", "first key"):
            if k == "s" and kinds[i + 1] == ":":
                i, state = i + 2, "value"
            elif state == "first key" and k == "}":
                stack.pop()
                i, state = i + 1, "after"
            else:
                fail(i + 1 if k == "s" else i)
                i, state = skip(i), "after"
                if kinds[i] == "end":
                    break
        elif not stack:
            if k != "end":
                fail(i)
            break
        elif k == ",":
            i, state = i + 1, "key" if stack[-1] == "}" else "value"
        elif k == stack[-1]:
            stack.pop()
            i += 1
        else:
            fail(i)
            if k == "end":
                break
            j = skip(i)
            i = j if j > i else i + 1
    return out
