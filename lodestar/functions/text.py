"""Text normalisers as Column builders; all run inside whole-stage code."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Path spellings that mean the same place, in the order they are replaced, without regard to ASCII case.
PATH_RULES = (
    (r"%localappdata%", r"c:\users\USER\appdata\local"),
    (r"%appdata%", r"c:\users\USER\appdata\roaming"),
    (r"%userprofile%", r"c:\users\USER"),
    (r"c:\\users\\[^\\]+", r"c:\users\USER"),
    (r"c:\\documents and settings\\[^\\]+", r"c:\users\USER"),
    (r"s-1-5-21-(?:[0-9]+-){3}[0-9]+", "SID"),
    (r"%systemroot%", r"c:\windows"),
    (r"%windir%", r"c:\windows"),
    (r"^\\systemroot\\", "c:\\windows\\"),
)
#: Identifiers that are replaced by what they are.
GUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b"
SID = r"(?i)\bS-1-(?:\d+-){1,14}\d+\b"
USER_FOLDER = r'(?i)((?:[A-Z]:)?\\(?:Users|Documents and Settings)\\)[^\\\s"]+'
#: Kinds of text whose case is not part of their identity.
CASELESS = ("command_line", "windows_path", "registry_path", "powershell_command", "event_payload", "user_path")


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def ascii_lower(c: Column) -> Column:
    """Lower case of A–Z only; the case of all other letters is part of an identity."""
    return F.translate(c, UPPER, LOWER)


def identity_path(c: Column, fold: bool = True) -> Column:
    """A path with user folders, SIDs and system variables in one spelling. Null gives the empty string."""
    out = F.coalesce(c, F.lit(""))
    for pattern, replacement in PATH_RULES:
        out = F.regexp_replace(out, "(?i)" + pattern, _literal(replacement))
    return ascii_lower(out) if fold else out


def context_value(c: Column, longest: int) -> Column:
    """A path normalised without folding, control characters and runs of blanks as one blank, cut to `longest`; idempotent."""
    out = F.regexp_replace(identity_path(c, fold=False), r"[\x00-\x1f\x7f]+", " ")
    return F.rtrim(F.substring(F.trim(F.regexp_replace(out, r"[ \t]+", " ")), 1, longest))


def stack_text(c: Column, kind: str = "identity") -> Column:
    """Text as a stacking key: white space collapsed, user folders, GUIDs and SIDs replaced, caseless kinds in lower case."""
    out = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    if kind == "windows_path":
        out = F.translate(out, "/", "\\")
    out = identity_path(out) if kind == "user_path" else F.regexp_replace(out, USER_FOLDER, "$1<USER>")
    out = F.regexp_replace(F.regexp_replace(out, GUID, "<GUID>"), SID, "<SID>")
    return F.lower(out) if kind in CASELESS else out


def truncated(c: Column, longest: int, mark: str = "...") -> Column:
    """c, or its first characters with a mark so that the whole has `longest`."""
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest - len(mark)), F.lit(mark))).otherwise(c)


def slug(c: Column) -> Column:
    """Lower-case letters and digits, all else as single dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(ascii_lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return c.isNull() | (F.trim(F.regexp_replace(c, r"\s+", " ")) == "")


def first_filled(cols: Sequence[Column]) -> Column:
    """The first value that isn't blank, else the empty string."""
    return F.coalesce(*[F.when(~blank(c), c) for c in cols], F.lit(""))


def join_filled(cols: Sequence[Column], sep: str = " | ") -> Column:
    """All values that aren't blank, joined."""
    return F.concat_ws(sep, *[F.when(~blank(c), c) for c in cols])


def summary(parts: dict[str, Column], most: int = 4) -> Column:
    """`name=value` of the first `most` filled parts, joined by bars."""
    named = F.array(*[F.when(~blank(c), F.concat(F.lit(f"{n}="), c)) for n, c in parts.items()])
    return F.array_join(F.slice(F.array_compact(named), 1, most), " | ")


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob of *, ** and ?."""
    out = []
    for part in re.split(r"(\*+|\?)", glob):
        out.append(".*" if part.startswith("*") else "." if part == "?" else re.escape(part))
    return r"(?s)\A" + "".join(out) + r"\z"


def glob_match(c: Column, glob: str) -> Column:
    """Whether c matches the glob or contains its text without the outer stars; blank on either side never matches."""
    text = glob.replace("**", "*").strip("*")
    hit = c.rlike(glob_pattern(glob))
    return ~blank(c) & ((hit | c.contains(text)) if text else hit) if glob else F.lit(False)


def name_list_pattern(names: Sequence[str]) -> str:
    """One pattern for paths that end in any of some file names, whatever their case."""
    return r"(?i)(?:^|[\\/])(?:" + "|".join(re.escape(n) for n in sorted({x.strip().lower() for x in names if x.strip()})) + r")$"


def labels(c: Column) -> Column:
    """Labels of a JSON list text or a comma-separated text: trimmed, not empty, sorted, once each."""
    listed = F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.split(c, ","))
    return F.array_sort(F.array_distinct(F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != "")))
