"""Attribute files of repositories: which paths they mark as generated or vendored, and with what precedence."""

from __future__ import annotations

import re

MARKS = {"linguist-generated": "generated", "linguist-vendored": "vendored", "generated": "generated", "vendored": "vendored"}


def glob_regex(pattern: str, folder: str) -> str:
    """Regular expression (for a whole path) of a pattern in the attribute file of a folder. ``*`` and ``?`` stop at slashes,
    ``**`` does not; a pattern without an inner slash matches at any depth below the folder; a leading slash binds it."""
    bound = "/" in pattern.rstrip("/")
    p = pattern.removeprefix("/")
    if p.endswith("/"):
        p += "**"
    out, i = "", 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := p.find("]", i + 2)) > 0:
            inner = p[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
        elif c == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return "^" + re.escape(folder) + ("" if bound else "(?:[^/]+/)*") + out + "$"


def parse(text: str, path: str) -> list[tuple[str, str, bool | None, int, int]]:
    """(regex, mark, value, depth, line) for each mark of an attribute file at ``path``. value is None where the mark is made
    unspecified again. Of the rules that match a path that of the greatest (depth, line) holds."""
    folder = path.rpartition("/")[0]
    folder = folder + "/" if folder else ""
    out = []
    for n, line in enumerate(text.splitlines()):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if line.startswith('"') and (end := line.find('"', 1)) > 0:
            pattern, words = line[1:end], line[end + 1 :].split()
        else:
            pattern, *words = line.split()
        if pattern.startswith("!"):
            continue  # not allowed in attribute files
        for w in words:
            name, _, given = w.partition("=")
            mark = MARKS.get(name.lstrip("-!"))
            if mark:
                value = None if name[0] == "!" else False if name[0] == "-" or given.lower() in ("false", "0", "no") else True
                out.append((glob_regex(pattern, folder), mark, value, folder.count("/"), n))
    return out
