"""Text clean-up as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Prefix of patterns written for a Unicode-aware engine: ignore case, ^ and $ at lines, only \n ends a line, Unicode classes.
ANY_CASE = "(?iUd)"
ANY_CASE_LINES = "(?imUd)"


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed once a row, however often `use` names it; a plain Column is copied to each place that names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank(x: Column) -> Column:
    """True for null, empty and white space."""
    return F.coalesce(strip(x) == "", F.lit(True))


def normalized(x: Column) -> Column:
    """Lower case, punctuation and runs of white space as one space."""
    spaced = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"""[.,!?;:¡¿*_\-"'`]+""", " ")
    return strip(F.regexp_replace(spaced, r"(?U)\s+", " "))


def tokens(x: Column) -> Column:
    return F.array_remove(F.split(x, " "), "")


def like_escaped(pattern: str, escape: str = "\\") -> str:
    """A literal for LIKE: the escape sign and both wildcards are escaped."""
    return "".join(escape + c if c in (escape, "%", "_") else c for c in pattern)


def contains_any_case(x: Column, needle: str) -> Column:
    """Whether x holds needle as it is, case aside."""
    return F.contains(F.lower(x), F.lower(F.lit(needle)))


def html_escaped(x: Column) -> Column:
    out = F.coalesce(x, F.lit(""))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


@F.pandas_udf(StringType())
def ascii_form(text: pd.Series) -> pd.Series:
    """Compatibility forms taken apart (NFKD), and all that isn't ASCII then dropped: no built-in function knows the forms."""
    return text.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def safe_filename(x: Column) -> Column:
    """Last part of a path without accents and signs that file systems refuse; 'unnamed' if nothing is left."""
    ascii_ = F.regexp_replace(ascii_form(F.coalesce(x, F.lit(""))), r"\x00", "")
    base = F.regexp_extract(ascii_, r"([^/]*)$", 1)
    joined = F.regexp_replace(F.regexp_replace(base, r'[/\\:*?"<>|]', "_"), r"[\s_]+", "_")
    bare = F.regexp_replace(joined, r"^[._]+|[._]+$", "")
    return F.when(F.coalesce(x, F.lit("")) == "", "").when(bare == "", "unnamed").otherwise(bare)


def without_controls(x: Column, longest: int | None = None, newlines: bool = True, trim: bool = True) -> Column:
    signs = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]" if newlines else r"[\x00-\x1f\x7f]"
    out = F.regexp_replace(F.coalesce(x, F.lit("")), signs, "")
    out = strip(out) if trim else out
    return F.substring(out, 1, longest) if longest is not None else out


def plain_email(x: Column) -> Column:
    return F.lower(strip(F.coalesce(x, F.lit(""))))


def clamped(x: Column, kind: str = "double", least=None, most=None, default=None) -> Column:
    """x as a number within [least, most]; the default where it isn't a number."""
    out = strip(x.cast("string")).try_cast(kind)
    if least is not None:
        out = F.when(out < least, F.lit(least).cast(kind)).otherwise(out)
    if most is not None:
        out = F.when(out > most, F.lit(most).cast(kind)).otherwise(out)
    return F.coalesce(out, F.lit(default).cast(kind))


def shortened(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 3), F.lit("..."))).otherwise(x)


def plain_marks(x: Column) -> Column:
    """Typographic quotes, dashes, ellipses and hard spaces as ASCII; zero-width and direction marks dropped."""
    out = F.translate(F.coalesce(x, F.lit("")), "‘’“”–— ", "''\"\"-- ")
    out = F.replace(out, F.lit("…"), F.lit("..."))
    return F.regexp_replace(out, r"[​-‏‪-‮⁦-⁩﻿]", "")


def without_fence(x: Column) -> Column:
    """What a Markdown code fence holds, if the text is one."""
    inner = F.regexp_extract(x, r"(?s)^\s*```(?:json|JSON)?\s*\n?(.*?)\n?\s*```\s*$", 1)
    return strip(F.when(x.rlike(r"(?s)^\s*```.*```\s*$"), inner).otherwise(x))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clock(ts: Column) -> Column:
    """A time as it is shown: date and time to the second."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
