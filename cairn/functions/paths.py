"""Path, language and profile columns."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The language of a file extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "py": "python", "pyi": "python",
    "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "c": "c", "h": "c", "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp",
    "rb": "ruby", "php": "php", "swift": "swift", "sh": "bash", "bash": "bash", "zsh": "bash",
}

# Extensions and file names of the default profiles.
PROFILES = {
    "code": {
        "extensions": [
            "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "pyi", "go", "rs", "java", "kt", "c", "h", "cpp", "cxx", "cc", "hpp", "cs", "rb", "php", "swift", "sh",
            "bash", "zsh", "sql", "graphql", "gql", "proto", "gradle", "dockerfile",
        ],
        "filenames": ["dockerfile", "makefile", "rakefile", "gemfile"],
    },
    "docs": {"extensions": ["md", "mdx", "txt", "rst", "adoc"], "filenames": ["readme", "license", "changelog"]},
    "data": {"extensions": ["json", "jsonc", "yaml", "yml", "toml", "xml", "csv", "tsv", "properties", "ini", "env"], "filenames": []},
    "styles": {"extensions": ["css", "scss", "sass", "less", "pcss"], "filenames": []},
}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """The directory of a relative path; empty for a file at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    """What follows the last dot of the lower-case file name; a name without a dot is its own extension."""
    return F.element_at(F.split(F.lower(basename(path)), "\\."), -1)


def language(path: Column) -> Column:
    """The language by extension, or an empty string."""
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(LANGUAGES.items())])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit(""))


def has_grammar(lang: Column) -> Column:
    return lang.isin(*sorted(set(LANGUAGES.values())))


def normalized(path: Column) -> Column:
    """POSIX form: forward slashes, none doubled, no ``./`` in front or ``/`` behind."""
    return reduce(lambda c, r: F.regexp_replace(c, *r), (("\\\\", "/"), ("/+", "/"), ("^(\\./)+", ""), ("(?<=.)/$", "")), path)


def relative_to(root: str, path: Column) -> Column:
    """The path below ``root`` (any case), or null outside it."""
    top = root.replace("\\", "/").rstrip("/") + "/"
    whole = normalized(path)
    return F.when(F.lower(whole).startswith(top.lower()), F.substring(whole, F.lit(len(top) + 1), F.length(whole))).when(~whole.rlike("^(/|[A-Za-z]:)"), whole)


def signature(size: Column, mtime_ms: Column) -> Column:
    """What the poller compares: size and modification time."""
    return F.concat_ws(":", size, mtime_ms)


def resolve_profiles(profiles: dict | None = None, defaults: list[str] | None = None, include: list[str] | None = None, only: list[str] | None = None) -> tuple[list[str], list[str]]:
    """Extensions and file names of the active profiles: ``only`` replaces the defaults, ``include`` adds to them."""
    known = PROFILES | (profiles or {})
    if include and only:
        raise ValueError("include and only exclude each other")
    active = list(only) if only else [*(defaults or ["code"]), *(include or [])]
    if unknown := [p for p in active if p not in known]:
        raise ValueError(f"unknown profile: {', '.join(unknown)}")

    def union(part):
        return list(dict.fromkeys(x.lower().lstrip(".") if part == "extensions" else x.lower() for p in active for x in known[p].get(part) or []))

    return union("extensions"), union("filenames")


def indexable(path: Column, extensions: list[str], filenames: list[str]) -> Column:
    return extension(path).isin(*extensions) | F.lower(basename(path)).isin(*filenames)
