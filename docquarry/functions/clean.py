"""Text cleaning as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Cleaner = Callable[[Column], Column]


def basic_clean(text: Column) -> Column:
    """Line ends as LF, control characters out, at most three dots, single inner blanks, at most one empty line, trimmed; null gives ''."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    t = F.regexp_replace(t, "\\.{4,}", "...")
    line = lambda l: F.concat(F.regexp_extract(l, "^((?U)\\s*)", 1), F.regexp_replace(F.regexp_replace(l, "^(?U)\\s+", ""), " {2,}", " "))  # noqa: E731, E741
    t = F.array_join(F.transform(F.split(t, "\n"), line), "\n")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return F.regexp_replace(t, "(?U)\\A\\s+|\\s+\\z", "")


def get_cleaner(cleaner: str | Cleaner | None) -> Cleaner:
    """None: as it is; 'basic': basic_clean; a function from column to column: itself."""
    if cleaner is None:
        return lambda c: c
    if callable(cleaner):
        return cleaner
    if isinstance(cleaner, str):
        if cleaner == "basic":
            return basic_clean
        raise ValueError(f"unknown text cleaner: {cleaner!r}")
    raise TypeError("a cleaner is None, a name or a function of a column")
