"""Text clean-up as Column -> Column expressions. All stay inside code generation.

Null in gives null out unless a function says otherwise. White space and
digits are the ASCII ones, except where a pattern carries ``(?U)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header patterns, tried in this order; group 1 is the number or letter.
SHEET_PATTERNS = (
    r"(?i)bestellblatt\s*(\d+|[A-Za-z])",
    r"(?i)bestell?\s*blatt\s*(\d+|[A-Za-z])",
    r"(?i)beste\s*l+\s*b?l?att\s*(\d+|[A-Za-z])",
    r"(?i)beste\s*[iu]l?att\s*(\d+|[A-Za-z])",
)
FORM_PATTERN = r"[Ff]ormular\s*(\d+|[A-Za-z])"
LEADING_CODE = r"^(\d{1,3}(?:-\d{1,3})?)"


def strip(c: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def form_type(c: Column) -> Column:
    """Form type named in a header text, ``unknown`` for null, empty or nothing usable.

    Without a known name a first line of 1 to 49 characters is the type.
    """
    text = strip(c)
    sheet = F.coalesce(*[found(text, p) for p in SHEET_PATTERNS])
    form = found(text, FORM_PATTERN)
    first = strip(F.element_at(F.split(text, "\n"), 1))
    return (
        F.when(c.isNull() | (c == ""), "unknown")
        .when(sheet.isNotNull(), F.concat(F.lit("Bestellblatt "), sheet))
        .when(form.isNotNull(), F.concat(F.lit("Formular "), form))
        .when((F.length(first) > 0) & (F.length(first) < 50), first)
        .otherwise("unknown")
    )


def form_key(c: Column) -> Column:
    """Spaces as dashes: the form of a definition's key."""
    return F.replace(c, F.lit(" "), F.lit("-"))


def loose_key(c: Column) -> Column:
    """A key without its dashes, for the second try."""
    return F.replace(form_key(c), F.lit("-"), F.lit(""))


def collapse_spaces(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def quantity(c: Column) -> Column:
    """First number of a cell's text, else the cleaned text; null gives ''."""
    text = collapse_spaces(c)
    return F.coalesce(found(text, r"(\d+)"), text, F.lit(""))


def product_name(c: Column) -> Column:
    """One leading ``[`` dropped, then one leading ``]``, each with the spaces after it."""
    return F.regexp_replace(F.regexp_replace(c, r"^\[\s*", ""), r"^\]\s*", "")


def product_code(c: Column) -> Column:
    """Digits, dashes and parentheses only."""
    return F.regexp_replace(c, r"[^0-9\-()]", "")


def digits(c: Column) -> Column:
    """Decimal digits of any script only."""
    return F.regexp_replace(c, r"[^\p{Nd}]", "")


def without_code(c: Column) -> Column:
    """A leading run of digits and dashes dropped, with the spaces after it."""
    return F.regexp_replace(c, r"^[0-9-]+\s*", "")


def leading_code(c: Column) -> Column:
    """Leading code of one to three digits or a range of such, else ''."""
    return F.regexp_extract(c, LEADING_CODE, 1)


def after_code(c: Column) -> Column:
    """What follows the leading code, without spaces, dashes and dots in between."""
    return F.when(
        leading_code(c) != "", F.regexp_replace(F.regexp_replace(c, LEADING_CODE, ""), r"^[\s\-.]+", "")
    ).otherwise(c)


def safe_filename(c: Column) -> Column:
    """Everything but word characters of any script, dashes and dots as ``_``."""
    return F.regexp_replace(c, r"(?U)[^\w\-.]", "_")


def stem(c: Column) -> Column:
    """File name of a path without its last suffix."""
    return F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def readable_size(c: Column) -> Column:
    """``%.1f KB`` below one MiB, ``%.1f MB`` from there; exact halves go to the even digit."""
    kb, mb = (F.rint(c * 10 / F.lit(unit)) / 10 for unit in (1024.0, 1048576.0))
    return F.when(c < 1048576, F.format_string("%.1f KB", kb)).when(c >= 1048576, F.format_string("%.1f MB", mb))


def data_url(payload: Column, kind: Column) -> Column:
    """Binary as a data URL; null payload gives null."""
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.regexp_replace(F.base64(payload), r"\s", ""))


def from_data_url(c: Column) -> Column:
    """Bytes of an image data URL, null where it is malformed."""
    return F.try_to_binary(found(c, r"^data:image/\w+;base64,(.+)"), F.lit("base64"))


def joined(texts: Column, order: Column, by: str = " ") -> Column:
    """Aggregate: texts in detection order, nulls left out."""
    pairs = F.array_sort(F.collect_list(F.when(texts.isNotNull(), F.struct(order.alias("o"), texts.alias("t")))))
    return F.array_join(F.transform(pairs, lambda p: p["t"]), by)


def task_id_of(modified: Column, identity: Column) -> Column:
    """Time of the file and eight digits of a hash of what identifies it."""
    return F.concat(F.date_format(modified, "yyyyMMdd_HHmmss_"), F.substring(F.sha2(identity, 256), 1, 8))


def task_id(path: Column, modified: Column) -> Column:
    """Deterministic task id, so that a replay finds the same task."""
    return task_id_of(modified, F.concat_ws("|", path, modified.cast("string")))


def is_top_anchor(c: Column) -> Column:
    return F.lower(c).contains("monats")


def is_bottom_anchor(c: Column) -> Column:
    return c.contains("210") & c.contains("212")


def is_saturday_anchor(c: Column) -> Column:
    return F.lower(c).contains("sandwich") & ~F.lower(c).contains("crustino")
