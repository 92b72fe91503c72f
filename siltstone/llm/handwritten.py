"""Problem 5: generated, minified, third-party and bulk-data files among source files.

Marks come from four sides, in this order. Attribute files of a repository decide about the paths they name, by glob precedence.
The text shows usual headers of tools, lock files, minified code, tables of data, and banners of packages. Lines shared with known
package files show copies of them wherever they lie, altered or torn. Path patterns whose files are nearly all marked by then,
in many repositories (or that package managers use), are mined and applied to the repositories that declare nothing. Phrases of
the comments above the code are patterns too: those that stand in nearly no file but generated ones are mined in the same way, so
that headers of any wording are learned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.hexes import hex_id
from siltstone.llm.attributes import parse
from siltstone.llm.live import REVISION, live_contents, revisions
from siltstone.operators.skew import sent_if_small
from siltstone.session import materialise

EXTENSIONS = ("js", "mjs", "json", "py", "css")
#: A mined pattern must be marked in this share of its distinct contents, in at least so many repositories. These are told apart by
#: 64 classes of their names' hashes, so that their number is one integer; few repositories may count as one less.
MINED_SHARE, MINED_REPOSITORIES = 0.9, 4
REPOSITORY_BIT = "shiftleft(1L, CAST(pmod(xxhash64(repository), 64) AS INT))"
#: A mined phrase must stand in so many distinct contents at least.
MINED_CONTENTS = 8
#: A text is a package's if this share of its characters in telling lines is in lines of the package.
CONTAINED, LINE_CHARS, TEXT_CHARS, BOILERPLATE_PACKAGES = 0.5, 15, 60, 3

# Folders in which package managers put packages.
MANAGED = ("node_modules", "bower_components", ".bower-cache", "jspm_packages", "site-packages")
# What tools by custom write at the top of their output.
TOOL_HEADER = re.compile(
    r"@generated\b|\bgenerated (?:by|from) .{0,80}\bdo not (?:edit|modify)|\bauto-?generated file\b|\bdo not edit(?: this file)?[.! ]*(?:it is|this is|generated|\*/|$)",
    re.I | re.M,
)
SOURCE_MAP = re.compile(r"^[^\S\n]*(?:\S[^\n]*)?(?://|/\*)[#@] ?sourceMappingURL=", re.M)
LOCK = re.compile(r"^# (?:yarn|poetry) lock", re.M)
LOCK_START = re.compile(r'\{\s*"_meta"\s*:\s*\{\s*"hash"')
LOCK_KEY = re.compile(r'"lockfileVersion"\s*:')
INTEGRITY = re.compile(r'"(?:integrity|resolved)"\s*:\s*"')
# A first comment of a name, a version, and where it is from.
BANNER = re.compile(
    r"\A(?:#!.*\n)?\ufeff?\s*(?:/\*[*!]?|//+|#)\s*(?:\*\s*)?([A-Za-z@][\w.@/-]*?)(?:\.js|\.py)?(?:,? -)? (?:(?:release|version) )?v?\d+(?:\.\d+)+\S*?\s*(?:,|\||-)\s*(?=[^\W\d_]|\()[^\n]{8,}"
)
# All comments above the first code, of any length (directives and the marker of a conflict are no code yet).
LEADING = re.compile(r"\ufeff?(?:\s++|[\"']use strict[\"'];?+|(?:#|//|<{7})[^\n]*+|/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)|<!--(?:[^-]|-(?!->))*+(?:-->|\Z))*+")

_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'')
_DATA = re.compile(r"""(?:-?\b\d+(?:\.\d+)?\b[\s,\]\[]*){4,}|["'][A-Za-z0-9+/=]{40,}["']?,?|["'][0-9a-f]{6,}["']\s*:\s*\[[^\]\n]*\],?|(?<![\w/+])[A-Za-z0-9+/]{60,}={0,2}""")
_LETTERS = re.compile(r"[^\W\d_]+|@[a-z]+")
_WORD, _NUMBER = re.compile(r"[A-Za-z_$][\w$]*"), re.compile(r"\d+")


def _repeats(text: str) -> bool:
    """Whether nearly all lines are long and of a few shapes, as code written from a template by a loop."""
    lines = [s for line in text.split("\n") if (s := line.strip())]
    if len(lines) < 6 or sum(map(len, lines)) < 40 * len(lines):
        return False
    shapes = Counter(_NUMBER.sub("9", _WORD.sub("w", _STRING.sub("s", line))) for line in lines)
    return sum(n for _, n in shapes.most_common(4)) >= 0.8 * len(lines)


def judge(text: str) -> tuple[str, str]:
    """(kind, package): lock, generated, minified, data or '', and the package whose banner the text bears, or ''."""
    m = BANNER.match(text)
    package = m[1].lower() if m else ""
    leading = LEADING.match(text)[0]
    # a key of a lock file counts anywhere in an object, but not in code that handles such files
    locked = text.startswith("{", len(leading)) and (LOCK_KEY.search(text) or LOCK_START.match(text, len(leading)))
    if locked or LOCK.search(leading) or len(INTEGRITY.findall(text)) >= 3:
        return "lock", package
    if TOOL_HEADER.search(leading) or "sourceMappingURL=" in text and SOURCE_MAP.search(text):
        return "generated", package
    n = len(text)
    if n < 60 or text.count("\ufffd") + text.count("\0") > n / 20:
        return "", package
    if sum(len(d) for d in _DATA.findall(text)) > 0.5 * n:
        return "data", package
    blank = n - len("".join(text.split()))
    if blank < 0.1 * n and n > 60 * (text.count("\n") + 1):
        return "minified", package
    return ("generated" if not text.lstrip().startswith(("{", "[", "<")) and _repeats(text) else ""), package


def phrases(text: str) -> list[str]:
    """The distinct pairs of words that follow each other in a line of the comments above the code."""
    out = set()
    for line in LEADING.match(text)[0].split("\n"):
        words = _LETTERS.findall(line.lower())
        out.update(map(" ".join, zip(words, words[1:])))
    return sorted(out)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        out = [judge(t) for t in texts]
        kinds, packages = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(kinds, pa.string()), pa.array(packages, pa.string()), pa.array(map(phrases, texts), pa.list_(pa.string()))], names=["hash_code", "kind", "banner", "phrases"]
        )


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["repo_owner", "repository", "regex", "mark", "value", "depth", "line"]
    for b in batches:
        rows = [(o, r, *rule) for o, r, p, t in zip(*(c.to_pylist() for c in b.columns)) for rule in parse(t, p)]
        cols = list(zip(*rows)) if rows else [()] * 7
        types = [pa.string()] * 4 + [pa.bool_(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def declared(file_metadata: DataFrame, contents: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The files (REVISION) that an attribute file of their repository decides about, marked true or false, and the repositories that
    declare anything (repo_owner, repository); None if there are no attribute files. Each counts as it was last; a repository has
    few rules, so the join by repository is about as large as the files."""
    c = F.col
    attributes = file_metadata.filter(F.lower("git_path").rlike(r"(^|/)\.gitattributes$"))
    last = attributes.groupBy("repo_owner", "repository", "git_path").agg(F.max(F.struct("commit_time", "commit_id", hex_id("hash_code").alias("h"))).alias("_l"))
    last = materialise(last.select("repo_owner", "repository", "git_path", c("_l.h").alias("hash_code")).filter(c("hash_code").isNotNull()), "attributes")
    if last.isEmpty():
        return None
    wanted = contents.withColumn("_h", hex_id("hash_code")).join(sent_if_small(last.select(c("hash_code").alias("_h")).distinct()), "_h", "left_semi")
    rules = (
        last.join(live_contents(wanted), "hash_code")
        .select("repo_owner", "repository", "git_path", "text")
        .mapInArrow(_rules, "repo_owner string, repository string, regex string, mark string, value boolean, depth int, line int")
    )
    rules = materialise(rules, "rules")
    hits = files.select(*REVISION).join(sent_if_small(rules), ["repo_owner", "repository"]).filter(F.expr("git_path RLIKE regex"))
    each = hits.groupBy(*REVISION, "mark").agg(F.max(F.struct("depth", "line", "value")).alias("_r"))
    return each.filter(c("_r.value").isNotNull()).groupBy(*REVISION).agg(F.max("_r.value").alias("declared")), rules.select("repo_owner", "repository").distinct()


def _own(package: Column, repository: Column) -> Column:
    """Whether a repository is named like a package."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[.-](js|py)$", "")
    return plain(package) == plain(repository)


def _named_like(package: Column, path: Column) -> Column:
    """Whether a file's name begins with that of a package."""
    return F.startswith(F.lower(F.regexp_extract(path, r"([^/]*)$", 1)), F.regexp_replace(F.lower(package), r"[.-](js|py)$", ""))


def managed_package(path: Column) -> Column:
    """The package below the innermost package manager's folder of a path, or null."""
    folders = "|".join(re.escape(m) for m in MANAGED)
    name = F.regexp_extract(path, rf".*(?:^|/)(?:{folders})/((?:@[^/]+/)?[^/]+)/", 1)
    return F.when(name != "", F.lower(name))


def _lines(texts: DataFrame) -> DataFrame:
    """hash_code, line (hash), n (characters) of the distinct lines that are long enough to tell something, and all, the number
    of characters in such lines of the text."""
    tidy = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, "\r", ""))))
    return (
        texts.select("hash_code", F.filter(tidy, lambda x: F.length(x) >= LINE_CHARS).alias("_lines"))
        .withColumn("all", F.aggregate("_lines", F.lit(0), lambda sum_, x: sum_ + F.length(x)))
        .select("hash_code", "all", F.explode("_lines").alias("_l"))
        .select("hash_code", "all", F.xxhash64("_l").alias("line"), F.length("_l").alias("n"))
    )


def contained_packages(texts: DataFrame, known: DataFrame) -> DataFrame:
    """hash_code, package of every text most of whose lines are lines of the package. ``known`` (hash_code, package) names the
    files that are a package's. Lines of several packages are boilerplate and tell nothing; the names under which one content is
    carried count as one package there."""
    c = F.col
    named = known.join(known.groupBy("hash_code").agg(F.min("package").alias("family")), "hash_code")
    of = materialise(_lines(texts.join(known.select("hash_code").distinct(), "hash_code", "left_semi")).join(named, "hash_code").select("line", "package", "family").distinct(), "lines")
    few = of.select("line", "family").distinct().groupBy("line").agg(F.count("*").alias("_k")).filter(c("_k") < BOILERPLATE_PACKAGES).select("line")
    of = sent_if_small(materialise(of.select("line", "package").distinct().join(few, "line"), "package-lines"))
    shared = _lines(texts).join(of, "line").groupBy("hash_code", "package").agg(F.sum("n").alias("_n"), F.max("all").alias("_all"))
    return shared.filter((c("_n") >= TEXT_CHARS) & (c("_n") >= CONTAINED * c("_all"))).select("hash_code", "package")


def patterns(path: Column) -> Column:
    """The patterns a path is an instance of: each folder, each two folders in a row, the first folder, and the last part of
    the name between punctuation and extension."""
    folders = F.filter(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda s: (s != "") & (s != "."))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(folders) - 1, F.lit(1))), lambda i: F.concat_ws("/", F.slice(folders, i, F.lit(2))))
    name = F.lower(F.regexp_extract(path, r"[^/][._-]([A-Za-z0-9]+)\.[A-Za-z0-9]+$", 1))
    return F.array_distinct(
        F.concat(
            F.transform(folders, lambda s: F.concat(F.lit("folder "), s)),
            F.when(F.size(folders) > 1, F.transform(pairs, lambda s: F.concat(F.lit("folders "), s))).otherwise(F.array().cast("array<string>")),
            F.when(F.size(folders) > 0, F.array(F.concat(F.lit("first "), folders[0]))).otherwise(F.array().cast("array<string>")),
            F.when(name != "", F.array(F.concat(F.lit("name "), name))).otherwise(F.array().cast("array<string>")),
        )
    )


def mined_patterns(marked: DataFrame) -> DataFrame:
    """pattern, of files (repository, git_path, hash_code, declares, declared, marked). A pattern is judged by the distinct contents of
    its files, so that a popular file counts once.

    Where enough repositories that declare something have the pattern, they alone judge it: by what most of them say about a
    content, or its text's marks where their attribute files are silent. Elsewhere the texts' marks judge it in all."""
    c = F.col
    bit = F.expr(REPOSITORY_BIT)
    said = F.when(c("declares"), F.coalesce("declared", "marked").cast("int"))
    each = marked.select("hash_code", bit.alias("bit"), F.when(c("declares"), bit).otherwise(F.lit(0).cast("long")).alias("said_bit"), said.alias("said"), c("marked").cast("int").alias("marked"), F.explode(patterns(c("git_path"))).alias("pattern"))
    by_content = each.groupBy("pattern", "hash_code").agg(F.avg("said").alias("said"), F.max("marked").alias("marked"), F.bit_or("bit").alias("bit"), F.bit_or("said_bit").alias("said_bit"))
    told = c("said") > 0.5
    share = by_content.groupBy("pattern").agg(
        F.count("*").alias("_n"), F.count_if(F.coalesce(told, c("marked") == 1)).alias("_m"), F.count("said").alias("_said_n"), F.count_if(told).alias("_said_m"), F.bit_or("bit").alias("bit"), F.bit_or("said_bit").alias("said_bit")
    )
    enough = F.bit_count("said_bit") >= MINED_REPOSITORIES
    by_all = (c("_m") >= MINED_SHARE * c("_n")) & (F.bit_count("bit") >= MINED_REPOSITORIES)
    return share.filter(F.when(enough, c("_said_m") >= MINED_SHARE * c("_said_n")).otherwise(by_all)).select("pattern", "_m", "_n")


def mined_phrases(marked: DataFrame, heads: DataFrame) -> DataFrame:
    """phrase, of files (repository, hash_code, kind, declared, mined, packaged) and the ``phrases`` of their contents. A phrase is judged
    like a path pattern: by the distinct contents it stands in, packages' files left aside, and what attribute files, or else their
    own headers and mined paths, say about those."""
    c = F.col
    bit = F.expr(REPOSITORY_BIT)
    told = F.coalesce((F.avg(c("declared").cast("int")) > 0.5), F.max((c("kind") == "generated") | c("mined").isNotNull()))
    by_content = marked.groupBy("hash_code").agg(told.alias("m"), F.max("packaged").alias("packaged"), F.bit_or(bit).alias("bit")).filter(~c("packaged"))
    each = by_content.join(heads, "hash_code").select("m", "bit", F.explode("phrases").alias("phrase"))
    counts = each.groupBy("phrase").agg(F.count("*").alias("_n"), F.count_if("m").alias("_m"), F.bit_or("bit").alias("bit"))
    return counts.filter((c("_n") >= MINED_CONTENTS) & (c("_m") >= MINED_SHARE * c("_n")) & (F.bit_count("bit") >= MINED_REPOSITORIES)).select("phrase", "_m", "_n")


def marks(file_metadata: DataFrame, contents: DataFrame) -> DataFrame:
    """Every distinct revision with a live content and one of EXTENSIONS, and its marks: declared (by an attribute file, null
    where none decides), kind (of the text), package (third party, null if none or the repository is the package's own),
    mined (a mined pattern of its path), phrase (a mined phrase of its header), and is_case.

    An empty text has no marks of its own but may lie in a package's folder. Rows with a null path or hash are left out; a null
    owner or repository is a value like others, except that attribute files need both."""
    c = F.col
    files = revisions(file_metadata, EXTENSIONS)
    live = live_contents(contents)
    texts = materialise(live.join(files.select("hash_code").distinct(), "hash_code", "left_semi"), "texts")
    judged = materialise(texts.mapInArrow(_judge, "hash_code string, kind string, banner string, phrases array<string>"), "judged")
    rows = materialise(files.join(judged.drop("phrases"), "hash_code").withColumn("managed", managed_package(c("git_path"))), "files")

    by_banner = rows.filter(c("banner") != "").select("hash_code", c("banner").alias("package"))
    by_folder = rows.filter(c("managed").isNotNull()).select("hash_code", c("managed").alias("package"))
    sure = by_banner.unionByName(by_folder).distinct()
    # a package's own repository is named like it and has a file named like it that bears its banner, other than by a package
    # manager; a like name alone may be chance
    homes = rows.filter((c("banner") != "") & c("managed").isNull() & _own(c("banner"), c("repository")) & _named_like(c("banner"), c("git_path")))
    homes = materialise(homes.select("repo_owner", "repository", c("banner").alias("package")).distinct(), "homes")
    own = rows.filter(c("managed").isNull() & (c("banner") == "")).join(sent_if_small(homes), ["repo_owner", "repository"]).select("hash_code", "package")
    contained = contained_packages(texts, materialise(sure.unionByName(own).distinct(), "known"))

    # the banner and the contained packages of a content are few; a folder's package counts for the path alone
    by_content = by_banner.distinct().unionByName(contained).groupBy("hash_code").agg(F.collect_set("package").alias("packages"))
    rows = rows.join(sent_if_small(homes.select("repo_owner", "repository").distinct()).withColumn("_is_home", F.lit(True)), ["repo_owner", "repository"], "left")
    at_home = lambda p: F.coalesce(c("_is_home") & _own(p, c("repository")), F.lit(False))
    found = rows.join(by_content, "hash_code", "left").select(
        *REVISION,
        "kind",
        F.coalesce(
            F.when(c("managed").isNotNull() & ~at_home(c("managed")), c("managed")),
            F.array_min(F.filter(F.coalesce("packages", F.array().cast("array<string>")), lambda p: ~at_home(p))),
        ).alias("package"),
        F.coalesce(F.size("packages") > 0, F.lit(False)).alias("_packaged"),
        F.coalesce(F.exists("packages", at_home), F.lit(False)).alias("_home"),
    )
    found = materialise(found, "found")
    on = lambda a, b: (c(f"{a}.hash_code") == c(f"{b}.hash_code")) & (c(f"{a}.git_path") == c(f"{b}.git_path")) & c(f"{a}.repo_owner").eqNullSafe(c(f"{b}.repo_owner")) & c(f"{a}.repository").eqNullSafe(c(f"{b}.repository"))
    decided = declared(file_metadata, contents, files)
    if decided is None:
        found = found.withColumns({"declared": F.lit(None).cast("boolean"), "declares": F.lit(False)})
    else:
        decided, repositories = decided
        found = found.alias("f").join(decided.alias("d"), on("f", "d"), "left").select("f.*", "declared")
        found = found.join(sent_if_small(repositories).withColumn("declares", F.lit(True)), ["repo_owner", "repository"], "left").withColumn("declares", F.coalesce("declares", F.lit(False)))
        found = materialise(found, "declared")
    mined = materialise(mined_patterns(found.select("repository", "git_path", "hash_code", "declares", "declared", ((c("kind") != "") | c("package").isNotNull() | c("_packaged")).alias("marked"))), "mined")
    # a package's files at home resemble those that are carried, and are none
    hit = found.filter(~c("_home")).select(*REVISION, F.explode(patterns(c("git_path"))).alias("pattern")).join(sent_if_small(mined.select("pattern")), "pattern").groupBy(*REVISION).agg(F.min("pattern").alias("mined"))
    out = materialise(found.alias("f").join(hit.alias("h"), on("f", "h"), "left").select("f.*", "mined"), "mined-paths")
    heads = judged.filter(F.size("phrases") > 0).select("hash_code", "phrases")
    learned = materialise(mined_phrases(out.withColumn("packaged", c("package").isNotNull() | c("_packaged")), heads), "phrases")
    worded = heads.select("hash_code", F.explode("phrases").alias("phrase")).join(sent_if_small(learned.select("phrase")), "phrase").groupBy("hash_code").agg(F.min("phrase").alias("phrase"))
    case = F.coalesce("declared", (c("kind") != "") | c("package").isNotNull() | c("mined").isNotNull() | c("phrase").isNotNull())
    return out.join(sent_if_small(materialise(worded, "worded")), "hash_code", "left").select(*REVISION, "declared", "kind", "package", "mined", "phrase", case.alias("is_case"))


def not_handwritten(marked: DataFrame) -> DataFrame:
    """The cases of ``marks``."""
    return marked.filter("is_case").select(*REVISION)
