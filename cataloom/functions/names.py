"""File names: extension, stem, path parts and the category of an extension."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions of each category.
EXTENSION_MAP: dict[str, list[str]] = {
    "Images": [".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff", ".webp"],
    "Documents": [".pdf", ".docx", ".doc", ".txt", ".md", ".xlsx", ".csv", ".pptx"],
    "Audio": [".mp3", ".wav", ".flac", ".m4a", ".aac"],
    "Video": [".mp4", ".mov", ".mkv", ".avi", ".webm"],
    "Archives": [".zip", ".rar", ".7z", ".tar", ".gz"],
    "Executables": [".exe", ".msi", ".bat", ".sh", ".app"],
    "Code": [".py", ".js", ".html", ".css", ".java", ".cpp"],
}
OTHERS = "Others"
TEXT_BEARING = ["Documents", "Images", "Audio", "Video"]
PLAIN_TEXT_SUFFIXES = [".txt", ".csv"]
SLIDE_SUFFIX = ".pptx"


#: Bytes of a file name that are no UTF-8 are shown as U+F780 to U+F7FF; a mark stands before those that a name holds itself.
_MARK, _FIRST, _LAST = "\uf77f", 0xF780, 0xF7FF


def as_shown(name: str) -> str:
    """A name as the file system gives it, in characters that every table can hold."""
    if name.isascii():
        return name
    out = []
    for char in name:
        point = ord(char)
        if 0xDC80 <= point <= 0xDCFF:
            out.append(chr(point - 0xDC80 + _FIRST))
        elif char == _MARK or _FIRST <= point <= _LAST:
            out.append(_MARK + char)
        else:
            out.append(char)
    return "".join(out)


def on_disk(path: str) -> str:
    """The name or path that ``as_shown`` has shown, for calls to the file system."""
    if path.isascii():
        return path
    out, marked = [], False
    for char in path:
        if marked or not (char == _MARK or _FIRST <= ord(char) <= _LAST):
            out.append(char)
            marked = False
        elif char == _MARK:
            marked = True
        else:
            out.append(chr(ord(char) - _FIRST + 0xDC80))
    return "".join(out)


def raw_extension(filename: Column) -> Column:
    """Last dot onwards, case kept; dots that lead the name don't count."""
    return F.regexp_extract(filename, r"(?s)^\.*[^.].*(\.[^.]*)\z", 1)


def extension(filename: Column) -> Column:
    return F.lower(raw_extension(filename))


def stem(filename: Column) -> Column:
    """The name without its extension."""
    return F.substring(filename, F.lit(1), F.length(filename) - F.length(raw_extension(filename)))


def category_of(ext: Column, ext_map: Mapping[str, Sequence[str]] = EXTENSION_MAP) -> Column:
    """Category of a lower-cased extension; the first category listing it wins.

    The map is a constant, so the lookup folds into the projection as a chain
    of ``IN`` tests and needs no join.
    """
    chain = None
    for category, extensions in ext_map.items():
        test = ext.isin(list(extensions))
        chain = F.when(test, category) if chain is None else chain.when(test, category)
    return F.lit(OTHERS) if chain is None else chain.otherwise(OTHERS)


def base_name(path: Column) -> Column:
    """Everything after the last slash."""
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    """Everything before the last slash; empty where there is none."""
    return F.when(
        F.instr(path, "/") > 0,
        F.substring(path, F.lit(1), F.length(path) - F.length(base_name(path)) - 1),
    ).otherwise("")


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def is_plain_text(path: Column) -> Column:
    """Suffix test on the path itself: ``A.TXT`` is not read as plain text."""
    return reduce(or_, [F.endswith(path, F.lit(suffix)) for suffix in PLAIN_TEXT_SUFFIXES])


def is_slide_deck(path: Column) -> Column:
    return F.endswith(path, F.lit(SLIDE_SUFFIX))
