"""Path functions: names, extensions, languages, exclusion tests."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages and their extensions; the first language that lists an extension owns it.
LANGUAGE_EXTENSIONS = {
    "python": [".py", ".pyw"],
    "javascript": [".js", ".jsx", ".mjs"],
    "typescript": [".ts", ".tsx"],
    "java": [".java"],
    "go": [".go"],
    "rust": [".rs"],
    "cpp": [".cpp", ".cc", ".cxx", ".c++", ".hpp", ".h"],
    "c": [".c"],
    "csharp": [".cs"],
    "php": [".php"],
    "ruby": [".rb"],
    "swift": [".swift"],
    "kotlin": [".kt"],
    "scala": [".scala"],
    "r": [".r"],
    "sql": [".sql"],
    "bash": [".sh"],
    "powershell": [".ps1"],
    "yaml": [".yml", ".yaml"],
    "json": [".json"],
    "xml": [".xml"],
    "html": [".html", ".htm"],
    "css": [".css"],
    "scss": [".scss"],
    "less": [".less"],
}
LANGUAGE_BY_EXTENSION = {ext: lang for lang, exts in LANGUAGE_EXTENSIONS.items() for ext in exts}

# The shorter map used when no language is given.
SHORT_LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript",
    ".java": "java", ".go": "go", ".rs": "rust", ".cpp": "cpp", ".c": "c", ".cs": "csharp", ".php": "php",
    ".rb": "ruby", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".r": "r", ".sql": "sql",
    ".sh": "bash", ".ps1": "powershell",
}

# Display names of the web profile; the interactive and quick profiles lack TypeScript.
DISPLAY_NAMES = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".java": "Java", ".cpp": "C++", ".c": "C",
    ".cs": "C#", ".php": "PHP", ".rb": "Ruby", ".go": "Go",
}
CODE_EXTENSIONS = {
    "web": sorted(DISPLAY_NAMES),
    "interactive": sorted(set(DISPLAY_NAMES) - {".ts"}),
    "quick": sorted(set(DISPLAY_NAMES) - {".ts"}),
}

# Default exclusions.
EXCLUDE_PATTERNS = ["__pycache__", "*.pyc", "node_modules", "*.log", "*.tmp", ".git", ".vscode", ".idea"]
EXCLUDE_DIRECTORIES = ["venv", "env", ".venv", "dist", "build"]

# Extensions treated as binary whatever the host's MIME table says.
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".pdf", ".zip", ".gz", ".tar", ".bz2", ".xz",
    ".7z", ".rar", ".jar", ".class", ".exe", ".dll", ".so", ".dylib", ".o", ".a", ".bin", ".pyc", ".woff",
    ".woff2", ".ttf", ".eot", ".mp3", ".mp4", ".avi", ".mov", ".wav", ".parquet",
]

# Fixed value: the usual size limit; an option of the scan.
MAX_FILE_SIZE = 1_048_576


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The extension with its case kept; '' for names such as ``.env`` or ``a.``."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


def extension(path: Column) -> Column:
    return F.lower(suffix(path))


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def language(path: Column) -> Column:
    return _lookup(LANGUAGE_BY_EXTENSION, extension(path))


def short_language(path: Column) -> Column:
    return F.coalesce(_lookup(SHORT_LANGUAGE_BY_EXTENSION, extension(path)), F.lit("unknown"))


def display_language(path: Column, profile: str = "web") -> Column:
    names = {ext: DISPLAY_NAMES[ext] for ext in CODE_EXTENSIONS[profile]}
    return F.coalesce(_lookup(names, suffix(path)), F.lit("Unknown"))


def has_code_extension(path: Column, profile: str = "web") -> Column:
    return suffix(path).isin(CODE_EXTENSIONS[profile])


def is_supported(path: Column) -> Column:
    return extension(path).isin(list(LANGUAGE_BY_EXTENSION))


def is_hidden(path: Column) -> Column:
    """Any part of the path starts with a dot."""
    return F.concat(F.lit("/"), path).contains("/.")


def _glob_regex(glob: str, star: str) -> str:
    """One shell-style glob as a regular expression; ``star`` is what ``*`` may cross."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            out.append(star + "*")
        elif ch == "?":
            out.append(star)
        elif ch == "[" and "]" in glob[i + 2:]:
            end = glob.index("]", i + 2)
            body = glob[i + 1:end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append(re.escape(ch))
        i += 1
    return "".join(out)


class Exclusion(NamedTuple):
    """Regular expressions on a repository-relative path behind a slash: any of them excludes a file. ``folders`` are those of them that
    exclude all that is in a folder, given its path with a slash behind."""

    files: list[str]
    folders: list[str]


def exclusion_patterns(patterns=None, directories=None) -> Exclusion:
    patterns = [p.strip() for p in (EXCLUDE_PATTERNS if patterns is None else patterns) if p.strip()]
    directories = [d.strip() for d in (EXCLUDE_DIRECTORIES if directories is None else directories) if d.strip()]
    files, folders = [], []
    if patterns:
        in_dir = "|".join(_glob_regex(p, "[^/]") for p in patterns)
        whole = "|".join(_glob_regex(p, r"[\s\S]") for p in patterns)
        folders.append(f"/(?:{in_dir})/")
        files += [f"/(?:{in_dir})/", f"^(?:{whole})$"]
    if directories:
        names = "|".join(re.escape(d) for d in directories)
        folders.append(f"/(?:{names})/")
        files.append(f"/(?:{names})(?:/|$)")
    return Exclusion(files, folders)


def is_excluded(path: Column, patterns=None, directories=None) -> Column:
    """Exclusion test on a repository-relative path.

    A file goes when a directory above it matches a glob, when its whole path matches a glob
    (``*`` crosses ``/``), or when any part of the path is an excluded name.
    """
    rooted = F.concat(F.lit("/"), path)
    test = F.lit(False)
    for pattern in exclusion_patterns(patterns, directories).files:
        test = test | rooted.rlike(pattern)
    return test


def is_binary(path: Column, raw: Column, probe: int = 1024) -> Column:
    """A binary extension, or a NUL among the first ``probe`` bytes: that is how a binary file is defined."""
    return extension(path).isin(BINARY_EXTENSIONS) | F.contains(F.substring(raw, 1, probe), F.lit(b"\x00"))


def sanitize_filename(name: Column) -> Column:
    """A name safe on any file system, at most 255 characters with the extension kept."""
    clean = F.btrim(F.translate(name, '<>:"/\\|?*', "_" * 9), F.lit(" ."))
    named = F.when(clean == "", "untitled").otherwise(clean)
    # the extension starts at the last dot, leading dots do not count
    ext = F.regexp_extract(named, r"(?s)^\.*[^.].*?(\.[^.]*)$", 1)
    stem = F.left(named, F.length(named) - F.length(ext))
    room = F.lit(255) - F.length(ext)
    # a negative room cuts that many characters off the end of the stem
    cut = F.when(room >= 0, F.left(stem, room)).otherwise(F.left(stem, F.greatest(F.lit(0), F.length(stem) + room)))
    return F.when(F.length(named) > 255, F.concat(cut, ext)).otherwise(named)
