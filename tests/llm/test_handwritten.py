"""Marks of files that no one wrote by hand."""

import re

import pytest
from helpers import rows
from pyspark.sql import functions as F

from siltstone.llm import handwritten as H
from siltstone.llm.attributes import glob_regex, parse

HAND = "'use strict';\n\nconst dep = require('./dep');\n\n// Generates the rows; do not edit the cache by hand.\nfunction go(a, b) {\n  const out = dep.run(a, 12);\n  if (out > b) {\n    return out;\n  }\n  return null;\n}\n"


@pytest.mark.parametrize(
    "text, kind",
    [
        (HAND, ""),
        ("// used by the code generator to write files\n" + HAND, ""),
        ("# do not edit while the job runs\nimport a\n\n\ndef b():\n    return a.c(1)\n", ""),
        ("// Code generated by x-gen 1.2. DO NOT EDIT.\n" + HAND, "generated"),
        ("/**\n * @generated by y from z.schema\n */\n" + HAND, "generated"),
        ("# -*- coding: utf-8 -*-\n# AUTOGENERATED FILE - created 2018-01-01\nX = 1\n", "generated"),
        ('{\n  "name": "a",\n  "lockfileVersion": 1\n}\n', "lock"),
        ("var M = {};\n" + "".join(f"M.get_f{i}_{i} = function () {{ return this.f{i}_ === undefined ? {i} : this.f{i}_; }};\n" for i in range(9)), "generated"),
        ("!function(e,t){" + "".join(f"e.f{i}=function(n){{return t.g{i}(n,{i})}};" for i in range(30)) + "}()", "minified"),
        (".a{margin:1px;color:#fff}.b{width:2em}" * 9, "minified"),
        ("var T = [\n" + "12345, 678, -90,\n" * 40 + "];\n", "data"),
        ("X = '" + "aB3/" * 100 + "'\n", "data"),
        ("module.exports = {\n" + "".join(f'  "{i:08x}": [1, {i}, "w"],\n' for i in range(20)) + "};\n", "data"),
        (".a {\n  margin: 1px;\n  color: #fff;\n}\n\n" * 20, ""),
        ("", ""),
        ("PK\0\0" + "�" * 90, ""),
    ],
)
def test_judge(text, kind):
    assert H.judge(text)[0] == kind


LICENCE = [f"clause {i} of a licence that is granted to all" + " and any" * (i % 11) for i in range(60)]


@pytest.mark.parametrize(
    "text, kind",
    [
        ("".join(f"// {x}\n" for x in LICENCE) + "// @generated from a.schema\n" + HAND, "generated"),
        ("/*\n" + "\n".join(LICENCE) + "\n*/\n\n/* Code generated by x-gen. DO NOT EDIT. */\n" + HAND, "generated"),
        ("#!/usr/bin/python\n" + "".join(f"# {x}\n" for x in LICENCE) + "\n# AUTOGENERATED FILE\nimport a\n", "generated"),
        ('{\n  "name": "a",\n  "scripts": {\n' + "".join(f'    "s{i}": "{x}",\n' for i, x in enumerate(LICENCE)) + '    "z": ""\n  },\n  "lockfileVersion": 1\n}\n', "lock"),
        ("".join(f"// {x}\n" for x in LICENCE) + HAND, ""),
        (HAND * 8 + "// @generated by a function of this file\n" + HAND, ""),
        (HAND * 8 + "const lock = {\n  \"lockfileVersion\": 1\n};\n" + HAND, ""),
    ],
)
def test_marks_behind_long_heads(text, kind):
    assert len(text) > 1500 and H.judge(text)[0] == kind


@pytest.mark.parametrize(
    "line, package",
    [("/*! quux v1.2.3 | free to share | https://quux.example */", "quux"), ("// quux.js release 2.1, upstream: q.example", "quux"), ("/* quux 4.5 - (c) the makers, shared freely */", "quux"), ("// quux notes, kept by hand", ""), ("/* Property of the guild. */", "")],
)
def test_banners(line, package):
    assert H.judge(line + "\n" + HAND)[1] == package


@pytest.mark.parametrize(
    "pattern, folder, path, match",
    [
        ("*.js", "", "a/b.js", True), ("*.js", "lib/", "lib/x/b.js", True), ("*.js", "lib/", "b.js", False), ("/a.js", "", "x/a.js", False), ("gen/*", "", "gen/a.js", True), ("gen/*", "", "gen/x/a.js", False),
        ("gen/**", "", "gen/x/a.js", True), ("**/gen/*.js", "", "gen/a.js", True), ("a?c[0-9].js", "", "abc5.js", True), ("a[!b].js", "", "ab.js", False), ("out/", "", "out/a/b", True), ("a+b.js", "", "a+b.js", True), ("a+b.js", "", "aab.js", False),
    ],
)
def test_globs(pattern, folder, path, match):
    assert bool(re.match(glob_regex(pattern, folder), path)) == match


def test_attribute_lines():
    got = parse("# c\n*.js linguist-generated\nx/* -linguist-vendored !generated\n\"a b\" linguist-vendored=false\n", "lib/.gitattributes")
    assert [(m, v, d, n) for _, m, v, d, n in got] == [("generated", True, 1, 1), ("vendored", False, 1, 2), ("generated", None, 1, 2), ("vendored", False, 1, 3)]


FM = "repo_owner string, repository string, git_path string, hash_code string, commit_time long, commit_id string"
CONTENTS = "hash_code string, contents string, deleted_at timestamp"


def corpus(spark):
    body = "".join(f"function part{i}(alpha) {{\n  return alpha.use{i}('the {i}th word');\n}}\n" for i in range(12))
    lib = "/*! quux v1.2.3 | free to share | https://quux.example */\n" + body
    altered = body.replace("part3", "renamed").replace("use7", "other")
    texts = {"lib": lib, "core": body, "alt": altered, "torn": body[: len(body) // 2 + 9], "hand": HAND, "gen": "// Code generated by g. DO NOT EDIT.\nx = 1\n", "empty": "", "stub": "module.exports = {};\n",
             "attr": "*.js linguist-generated\nkeep.js -linguist-generated\n", "attr2": "mine.js !linguist-generated\nlib.js -linguist-generated\n"}
    fm = [
        ("q", "quux", "src/quux.js", "lib"), ("q", "quux", "src/core.js", "core"), ("a", "app", "node_modules/quux/quux.js", "lib"), ("a", "app", "src/compat.js", "alt"), ("a", "app", "old.js", "torn"),
        ("a", "app", "src/main.js", "hand"), ("b", "fork", "src/main.js", "hand"), ("a", "app", "node_modules/quux/none.js", "empty"), ("a", "app", "src/none.js", "empty"), ("a", "app", "src/index.js", "stub"),
        ("c", "decl", ".gitattributes", "attr"), ("c", "decl", "sub/.gitattributes", "attr2"), ("c", "decl", "x.js", "hand"), ("c", "decl", "keep.js", "gen"), ("c", "decl", "sub/lib.js", "lib"), ("c", "decl", "sub/mine.js", "hand"),
        (None, "n", "x.js", "hand"), (None, "n", "y.js", "gen"), ("a", "app", None, "gen"), ("a", "app", "z.js", None), ("a", "app", "z.txt", "gen"), ("a", "app", "gone.js", "gone"),
    ]
    for i in range(12):
        texts[f"p{i}"] = f"# @generated by tool {i}\nx = {i}\n"
        fm.append((f"o{i}", f"r{i}", f"proto/m{i}.py", f"p{i}"))
    texts["undeclared"] = "x = 1\n"
    fm.append(("o1", "r1", "proto/plain.py", "undeclared"))
    f = spark.createDataFrame([(*r, 1, "c") for r in fm] * 2, FM).withColumn("text", F.lit("clash")).withColumn("kind", F.lit(1))
    gone = __import__("datetime").datetime(2020, 1, 1)
    return f, spark.createDataFrame([(h, t, None) for h, t in texts.items()] + [("gone", "x", gone)], CONTENTS)


def test_operator(spark):
    m = {(r.repository, r.git_path): r for r in H.marks(*corpus(spark)).collect()}
    case = {k for k, r in m.items() if r.is_case}
    assert ("app", "node_modules/quux/quux.js") in case and ("app", "node_modules/quux/none.js") in case
    assert m["app", "src/compat.js"].package == "quux" and m["app", "old.js"].package == "quux"
    assert not case & {("quux", "src/quux.js"), ("quux", "src/core.js"), ("app", "src/main.js"), ("fork", "src/main.js"), ("app", "src/none.js"), ("app", "src/index.js"), ("n", "x.js")}
    assert ("n", "y.js") in case
    # attribute files decide, the deeper one and the later line first
    assert ("decl", "x.js") in case and ("decl", "keep.js") not in case and ("decl", "sub/lib.js") not in case
    assert m["decl", "sub/mine.js"].declared is None
    # a mined pattern marks what shows nothing itself
    assert m["r1", "proto/plain.py"].mined and ("r1", "proto/plain.py") in case
    assert not {("app", "gone.js"), ("app", "z.txt"), ("app", "z.js"), ("app", None)} & set(m)


def test_patterns_are_mined_from_declarations(spark):
    code = lambda i: f"import a{i}\n\n\ndef part{i}(b):\n    return a{i}.use(b, {i})\n"
    texts, fm = {"yes": "gen/** linguist-generated\n", "no": "made/** -linguist-generated\n"}, []
    for i in range(12):
        texts |= {f"g{i}": code(i), f"m{i}": f"# @generated by tool {i}\nx = {i}\n"}
        fm += [("y", f"y{i}", ".gitattributes", "yes"), ("y", f"y{i}", f"gen/a{i}.py", f"g{i}"), ("n", f"n{i}", ".gitattributes", "no"), ("n", f"n{i}", f"made/a{i}.py", f"m{i}")]
    texts |= {"plain": code(90), "other": code(91)}
    # an undeclared repository carries files of these too: its texts' marks, or none, do not outweigh what is declared
    fm += [("u", "u", "gen/plain.py", "plain"), ("u", "u", "gen/same.py", "g1"), ("u", "u", "made/other.py", "other"), ("u", "u", "made/same.py", "m1"), ("u", "u", "src/plain.py", "plain")]
    f = spark.createDataFrame([(*r, 1, "c") for r in fm], FM)
    m = {(r.repository, r.git_path): r for r in H.marks(f, spark.createDataFrame([(h, t, None) for h, t in texts.items()], CONTENTS)).collect()}
    assert m["u", "gen/plain.py"].mined and m["u", "gen/plain.py"].is_case and m["u", "gen/same.py"].is_case
    assert not m["u", "made/other.py"].mined and not m["u", "made/other.py"].is_case and not m["u", "src/plain.py"].is_case
    assert not any(m[f"n{i}", f"made/a{i}.py"].is_case for i in range(12)) and all(m[f"y{i}", f"gen/a{i}.py"].is_case for i in range(12))


def test_lines_joined_by_shuffling_give_the_same(spark, monkeypatch):
    want = rows(H.not_handwritten(H.marks(*corpus(spark))))
    monkeypatch.setattr(H, "sent_if_small", lambda df: df)
    assert rows(H.not_handwritten(H.marks(*corpus(spark)))) == want


@pytest.mark.parametrize(
    "text, kind",
    [
        ("{\n" + "".join(f'  "s{i}": "{x}",\n' for i, x in enumerate(LICENCE * 9)) + '  "lockfileVersion": 1\n}\n', "lock"),
        (HAND * 9 + "//# sourceMappingURL=a.js.map\n" + HAND * 9, "generated"),
        (HAND + ".a{}\n/*# sourceMappingURL=a.css.map */\n" + "\n" * 2000, "generated"),
        (HAND + "const tag = 'sourceMappingURL=' + name;\n", ""),
        ("'use strict';\n\n// @generated from a.schema\n" + HAND, "generated"),
        ("#!/bin/sh\n" + "\n" * 3000 + "/* Code generated by x. DO NOT EDIT. */\n" + HAND, "generated"),
    ],
)
def test_whole_texts_are_read(text, kind):
    assert H.judge(text)[0] == kind


def frames(spark, fm, texts):
    return spark.createDataFrame([(*r, 1, "c") for r in fm], FM), spark.createDataFrame([(h, t, None) for h, t in texts.items()], CONTENTS)


def told(spark, fm, texts):
    return {(r.repo_owner, r.repository, r.git_path): r for r in H.marks(*frames(spark, fm, texts)).collect()}


def code(i):
    return f"// helper {i} of the service\nfunction part{i}(alpha) {{\n  return alpha.use{i}('the {i}th word of it');\n}}\n"


def test_a_like_name_alone_is_no_home(spark):
    # by chance a repository is named like a package that another one of its packages bears the banner of
    lib = "/* quux 4.5 - (c) the makers, shared freely */\n" + code(1) + code(2)
    texts = {"lib": lib} | {f"h{i}": code(i) + code(i + 50) for i in range(10, 20)}
    fm = [("x", "quux-js", "node_modules/other/index.js", "lib"), *[("x", "quux-js", f"src/a{i}.js", f"h{i}") for i in range(10, 20)], *[("y", "app", f"lib/b{i}.js", f"h{i}") for i in range(10, 20)]]
    m = told(spark, fm, texts)
    assert [k[2] for k, r in m.items() if r.is_case] == ["node_modules/other/index.js"]


def test_names_of_one_content_count_as_one_package(spark):
    lib = "".join(code(i) for i in range(8))
    texts = {"lib": lib, "torn": lib[: len(lib) // 2]}
    fm = [("o", f"r{n}", f"node_modules/{n}/index.js", "lib") for n in ("aa", "bb", "cc", "dd")] + [("o", "app", "old/torn.js", "torn")]
    assert told(spark, fm, texts)["o", "app", "old/torn.js"].package == "aa"


def test_headers_of_any_wording_are_learned(spark):
    # the wording stands in files below gen/ of many repositories, whose other files bear a usual header
    texts, fm = {}, []
    for i in range(40):
        texts |= {f"u{i}-{j}": f"// @generated from s{i}\nx{i} = {j};\n" for j in range(9)} | {f"n{i}": f"// Spat out by the zork machine {i}\n" + code(i), f"h{i}": f"// Kept by the zork team {i}\n" + code(i + 100)}
        fm += [*[("o", f"r{i % 8}", f"gen/u{i}x{j}.js", f"u{i}-{j}") for j in range(9)], ("o", f"r{i % 8}", f"src/h{i}.js", f"h{i}")]
        fm.append(("o", f"r{i % 8}", f"gen/n{i}.js" if i < 36 else f"src/n{i}.js", f"n{i}"))
    m = told(spark, fm, texts)
    # learned below gen/, where nine in ten files are known, and found elsewhere
    assert all(m["o", f"r{i % 8}", f"src/n{i}.js"].phrase for i in range(36, 40))
    assert not any(m["o", f"r{i % 8}", f"src/h{i}.js"].is_case for i in range(40))


def test_recall_and_precision_from_attribute_files(spark):
    """Half of 60 repositories declare; the marks of the others are only mined. No text bears a mark of its own."""
    import random

    r = random.Random(7)
    kinds = {"gen/**": "gen/{}.py", "*_stub.py": "api/{}_stub.py", "third/**": "third/pkg/{}.py"}
    texts, fm, truth = {}, [], set()
    for n in range(60):
        if n < 30:
            texts[f"att{n}"] = "".join(f"{g} linguist-{'vendored' if g[0] == 't' else 'generated'}\n" for g in kinds) + "gen/keep*.py -linguist-generated\n"
            fm.append((f"o{n}", f"r{n}", ".gitattributes", f"att{n}"))
        for j in range(12):
            h = f"{n}-{j}"
            texts[h] = f"import a{n}\n\n\ndef part{j}(b):\n    return a{n}.use(b, {r.randrange(10**6)})\n"
            made = j < 6
            path = r.choice(list(kinds.values())).format(f"m{n}x{j}") if made else f"src/{r.choice(['core', 'lib', 'app'])}/m{n}x{j}.py"
            fm.append((f"o{n}", f"r{n}", path, h))
            if made:
                truth.add((f"o{n}", f"r{n}", path))
    m = told(spark, fm, texts)
    found = {k for k, x in m.items() if x.is_case}
    undeclared = {k for k in truth if int(k[0][1:]) >= 30}
    assert found <= truth and {k for k in truth if k not in undeclared} <= found
    # a name's last part is a pattern as a folder is
    assert len(found & undeclared) >= 0.95 * len(undeclared)
    assert all(m[k].mined and m[k].declared is None for k in found & undeclared)


def test_no_rows(spark):
    fm, ct = corpus(spark)
    assert H.marks(fm.limit(0), ct).count() == 0 and H.marks(fm, ct.limit(0)).count() == 0
