"""Folder, name and label of a path, without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parts of a folder's name that give it a package manager's label, in the order they are tried.
IMPORT_LABELS = (("www/", "WWW"), ("node_modules/", "NPM"), ("bower_components/", "BOWER"), (".bower-cache/", "BOWER"))
FOLDER_LABELS = (
    ("node_modules/", "NPM"),
    ("bower_components/", "BOWER"),
    (".bower-cache/", "BOWER"),
    ("bower/", "BOWER"),
    ("www/", "WWW"),
)


def _tidy(path: Column) -> Column:
    """Repeated slashes count once and one at the end counts not at all, but for the root."""
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), "(.)/$", "$1")


def parent_folder(path: Column) -> Column:
    """Everything before the last slash: '' without a slash, '/' for a name right under the root; null for null."""
    p = _tidy(path)
    return F.when(p.rlike("^/[^/]*$"), F.when(p == "/", F.lit("")).otherwise(F.lit("/"))).otherwise(
        F.regexp_extract(p, "^(.*)/[^/]*$", 1)
    )


def file_name(path: Column) -> Column:
    """The text after the last slash; null for the root, which has no name."""
    p = _tidy(path)
    return F.when(p != "/", F.regexp_extract(p, "([^/]*)$", 1))


def extension(path: Column) -> Column:
    """The text after the last dot of the file name, lower-cased; '' without a dot."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, "([^/]*)$", 1), "\\.([^.]*)$", 1))


def label(folder: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The label of the first rule whose text the folder holds, else OTHERS (also for null)."""
    out = None
    for text, name in rules:
        out = F.when(folder.contains(text), name) if out is None else out.when(folder.contains(text), name)
    return out.otherwise("OTHERS")


def path_components(folder: Column) -> Column:
    """The parts between slashes, without empty ones at the end."""
    return F.split(F.regexp_replace(folder, "/+$", ""), "/")


def nested_packages(path: Column) -> Column:
    """Every name that follows a 'node_modules/' in the path, nested and consecutive ones included."""
    return F.regexp_extract_all(path, F.lit("(?<=node_modules/)([^/]*)"), F.lit(1))
