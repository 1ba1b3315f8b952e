"""Column builders for the value rules of the audit data: what counts as empty, text cleaning, labels."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes (Spark's own trim knows blanks only).
_SPACE = r"[\s\x{FEFF}\p{Z}]"
#: The same characters one by one.
_SPACES = " \t\n\x0b\f\r\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_or(*values: Column | str) -> Column:
    """The first value that is neither null nor empty; plain strings are constants, and a last constant may be empty."""
    columns = [F.lit(v) if isinstance(v, str) else v for v in values]
    last = columns.pop() if isinstance(values[-1], str) else None
    picked = [F.nullif(c.cast("string"), F.lit("")) for c in columns]
    return F.coalesce(*picked, *([last] if last is not None else []))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def js_trim(text: Column) -> Column:
    # the pattern also cuts before a last U+0085, and looks at every place; most texts have nothing to cut
    plain = lambda x: (F.btrim(x, F.lit(_SPACES)) == x) & ~x.endswith("\u0085")
    return let(text, lambda x: F.when(plain(x), x).otherwise(F.regexp_replace(x, f"^{_SPACE}+|{_SPACE}+$", "")))


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def first_match(cases: Iterable[tuple[Column, Column | str]], otherwise: Column) -> Column:
    """Value of the first condition that holds."""
    out = otherwise
    for when, value in reversed(list(cases)):
        out = F.when(when, value).otherwise(out)
    return out


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole as a decimal rounded half up; null where whole is 0."""
    d = "decimal(38,10)"
    return F.round(F.try_divide((part.cast("decimal(20,0)") * 100).cast(d), whole.cast("decimal(20,0)")), digits)


def percent(part: Column, whole: Column) -> Column:
    """``12.3%``."""
    return F.concat(share(part, whole).cast("decimal(20,1)").cast("string"), F.lit("%"))


def pad_end(text: Column, width: int) -> Column:
    """Right-pads without cutting longer texts."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def slug_capture(url: Column) -> Column:
    """Underscores for all but word characters and hyphens; 60 characters."""
    return F.substring(F.regexp_replace(url, r"[^\w-]", "_"), 1, 60)


def slug_page(url: Column) -> Column:
    """Without protocol, runs of other characters as one underscore; 90 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "[^a-zA-Z0-9]+", "_"), 1, 90)


def slug_lower(text: Column) -> Column:
    """Without protocol, an underscore for each other character; 80 characters in lower case."""
    return F.lower(F.substring(F.regexp_replace(F.regexp_replace(text, "https?://", ""), "[^a-zA-Z0-9]", "_"), 1, 80))


def slug_file(url: Column) -> Column:
    """Underscores for all but word characters, dots and hyphens."""
    return F.regexp_replace(url, r"[^\w.-]", "_")


def synthetic_id(source: Column, page: Column, selector: Column) -> Column:
    """``source-`` and ten characters of the base64 of page and selector; collides by design, as ids of this kind do."""
    packed = F.base64(F.encode(F.concat(F.coalesce(page, F.lit("")), F.coalesce(selector, F.lit(""))), "UTF-8"))
    return F.concat(source, F.lit("-"), F.substring(packed, 1, 10))


def language_of_locale(locale: Column) -> Column:
    """``en_US.UTF-8`` to ``en``."""
    return F.lower(F.split(locale, "[-_.]")[0])


def day_stamp(at: Column) -> Column:
    """``yyyy-MM-dd``, as dated folders are named."""
    return F.date_format(at, "yyyy-MM-dd")


def iso_stamp(at: Column) -> Column:
    """ISO 8601 in UTC with milliseconds (the session's time zone being UTC)."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def local_stamp(at: Column) -> Column:
    """Day, month and year as Spanish texts write them, with the time."""
    return F.date_format(at, "d/M/yyyy, H:mm:ss")


def elapsed(begin: Column, end: Column) -> Column:
    """Seconds between two times, to two decimals."""
    micros = [F.unix_micros(t.cast("timestamp")).cast("double") for t in (begin, end)]
    return F.round((micros[1] - micros[0]) / 1e6, 2)


def int_or(text: Column, default: int) -> Column:
    """The whole number that a text begins with, else the default."""
    return F.coalesce(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(default))


def with_entries(base: Column, more: Column) -> Column:
    """Both maps in one; where both have a key the second's value stays."""
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(more, k))
    return F.map_concat(kept, more)
