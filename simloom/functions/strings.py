"""Id grammar and text utilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = r"d\[([^\]]*)\]"


def label_tag(item_id: Column) -> Column:
    return F.nullif(F.regexp_extract(item_id, TAG, 1), F.lit(""))


def file_path(item_id: Column) -> Column:
    """Everything before the first TAB."""
    return F.substring_index(item_id, "\t", 1)


def directory(path: Column) -> Column:
    """Path up to its last slash, without it; empty when there is none."""
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)


def derive_label(item_id: Column, delimiter: str | None = None) -> Column:
    """The ``d[..]`` tag, else the prefix before the delimiter, else the whole path."""
    path = file_path(item_id)
    if delimiter is None or delimiter == "/":
        prefix = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    else:
        prefix = F.when(path.contains(delimiter), F.substring_index(path, delimiter, 1))
    return F.coalesce(label_tag(item_id), F.nullif(prefix, F.lit("")), path)


def derive_kind(item_id: Column) -> Column:
    """Letter before the first region bracket; ``w`` (whole) when there is none but a tag."""
    region = F.regexp_replace(item_id, TAG, "")
    kind = F.regexp_extract(region, r"([a-z])\{?\[", 1)
    return F.when(kind == "", F.lit("w")).otherwise(kind)


def starts_part(item_id: Column, needle: str) -> Column:
    """The last occurrence of the needle opens the id or follows one of ``[ / \\ .``"""
    size = len(needle)
    rest = F.reverse(item_id)
    back = F.instr(rest, needle[::-1])
    start = F.length(item_id) - back - size + 2
    before = F.substring(item_id, start - 1, F.lit(1))
    return (back > 0) & ((start == 1) | before.isin("[", "/", "\\", "."))


def trimmed(s: Column, chars: str = " \t\r\n") -> Column:
    return F.btrim(s, F.lit(chars))


def is_numeric(s: Column) -> Column:
    return s.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")


def safe_name(path: Column) -> Column:
    """Path as one file-safe name: separators spelt out, other reserved characters dropped."""
    spelt = F.replace(F.replace(path, F.lit("/"), F.lit("SLASH")), F.lit("\\"), F.lit("BACK"))
    return F.regexp_replace(spelt, r'[:*?"<>|]', "_")


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n")).cast("bigint")
