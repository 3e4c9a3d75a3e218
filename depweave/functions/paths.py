"""Scalar functions on paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by suffix, folders that are not indexed.
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".rb": "ruby", ".sql": "sql"}
SKIPPED = ["vendor", "node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".next"]


def language(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(names, F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1))


def skipped(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def repo_hash(root: Column) -> Column:
    return F.substring(F.sha2(root, 256), 1, 16)


def constant_name(association: Column) -> Column:
    """The class that an association's name stands for: id suffix off, singular, words capitalised and joined."""
    stem = F.regexp_replace(association, "_ids?$", "")
    one = F.when(stem.rlike("ies$"), F.regexp_replace(stem, "ies$", "y")).when(stem.rlike("[sxz]es$"), F.regexp_replace(stem, "es$", "")).otherwise(F.regexp_replace(stem, "(?<!s)s$", ""))
    return F.array_join(F.transform(F.split(one, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), "")


def capitalised(name: Column) -> Column:
    """Whether a name looks like a class's."""
    return name.rlike("^[A-Z]")


def distinct_refs(refs: Column) -> Column:
    """The distinct names of an array, in order."""
    return F.array_sort(F.array_distinct(refs))


def translated(path: str, prefixes: dict[str, str]) -> str:
    """A path of another machine as this one sees it: the longest prefix that it lies below is replaced."""
    for prefix in sorted(prefixes, key=len, reverse=True):
        if path == prefix or path.startswith(prefix.rstrip("/") + "/"):
            return prefixes[prefix].rstrip("/") + path[len(prefix.rstrip("/")) :]
    return path
