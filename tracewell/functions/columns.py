"""Column expressions over evidence text: all built-in, so they stay within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules



def squash(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def flat(text: Column) -> Column:
    """Squashed and lower case: equality of texts."""
    return F.lower(squash(text))


def digest_id(length: int, *parts: Column) -> Column:
    """The first hex digits of SHA-256 of the parts, lower case, joined by |."""
    return F.substring(F.sha2(F.lower(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256), 1, length)


def triple_id(*parts: Column) -> Column:
    return digest_id(32, *parts)


def rel_type(predicate: Column) -> Column:
    """A relationship name of A-Z, 0-9 and _, R_ before a digit, 60 long at most; RELATED_TO for an empty one."""
    name = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(predicate, F.lit(""))), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.substring(F.when(name == "", "RELATED_TO").when(name.rlike("^[0-9]"), F.concat(F.lit("R_"), name)).otherwise(name), 1, 60)


def first_match(text: Column, patterns: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first pattern that matches."""
    out = F.lit(otherwise)
    for label, pattern in reversed(patterns):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def safe_filename(name: Column) -> Column:
    """A file name without paths and odd characters."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"[^A-Za-z0-9._ -]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(stem, r"^[. ]+", ""), F.lit("")), F.lit("file"))


def name_tokens(name: Column, stop: tuple[str, ...]) -> Column:
    """Lower-case tokens of a name without punctuation, ranks and suffixes."""
    plain = F.translate(F.lower(name), "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(squash(F.regexp_replace(plain, r"[^\w\s]", " ")), " "), lambda t: (t != "") & ~t.isin(*stop))


def normalize_name(name: Column, stop: tuple[str, ...]) -> Column:
    """Tokens joined; the flat name where no token is left."""
    out = F.array_join(name_tokens(name, stop), " ")
    return F.when(out == "", flat(name)).otherwise(out)


def month_number(name: Column) -> Column:
    """01 to 12 of a month's name, by its first three letters."""
    return F.lpad(F.array_position(F.array(*[F.lit(m) for m in rules.MONTHS]), F.lower(F.substring(name, 1, 3))).cast("string"), 2, "0")


def normalize_when(raw: Column) -> Column:
    """A date of variable precision as YYYY-MM, YYYY-MM-DD or YYYY-MM-DDTHH:MM[:SS]; empty where none is read.

    Whole dates and times come first (hours and minutes that no clock shows leave the day), then a day, a month or a named month
    with a year within longer text."""
    text = F.trim(F.replace(F.coalesce(raw, F.lit("")), F.lit("Z"), F.lit("")))
    loose = r"^(\d{4}-\d{2}-\d{2})[T ]?(\d{2}):?(\d{2})(?::?(\d{2}))?$"
    day, hh, mm = (F.regexp_extract(text, loose, k) for k in (1, 2, 3))
    named = rf"(?i)\b({rules.MONTH})\b\.?,?\s+(\d{{4}})\b"
    within = lambda pattern: F.regexp_substr(text, F.lit(pattern))
    found = F.coalesce(
        within(r"\d{4}-\d{2}-\d{2}"),
        within(r"\d{4}-(?:0[1-9]|1[0-2])(?!-?\d)"),
        F.when(text.rlike(named), F.concat_ws("-", F.regexp_extract(text, named, 2), month_number(F.regexp_extract(text, named, 1)))),
        F.lit(""),
    )
    return (
        F.when(F.lower(text).isin(*rules.NO_DATE), "")
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?$"), F.translate(text, " ", "T"))
        .when(text.rlike(r"^\d{4}-(?:0[1-9]|1[0-2])$"), text)
        .when(text.rlike(loose), F.when((hh <= "23") & (mm <= "59"), F.concat(day, F.lit("T"), hh, F.lit(":"), mm)).otherwise(day))
        .otherwise(found)
    )


def day_key(date: Column) -> Column:
    """The day of a date, or as much as is known."""
    return F.substring(date, 1, 10)


def date_precision(date: Column) -> Column:
    """month, day or minute, by length; null for none."""
    n = F.length(date)
    return F.when(n == 7, "month").when(n == 10, "day").when(n >= 16, "minute")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cited_pages(text: Column) -> Column:
    """Bracketed citations with a page: [name p.3] or [name p.3-5]."""
    return F.regexp_extract_all(text, F.lit(r"\[([^\[\]]+? pp?\.? ?\d+(?:-\d+)?)\]"), F.lit(1))


def page_title(html: Column) -> Column:
    """The text of a page's title element; empty without one."""
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)
