"""Column names from free text: cleaning, and numbers for names that clash.

Spark resolves names without regard to case, so ``Text`` and ``text`` clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names keep ASCII letters, digits and "_"; what lies between kept
# runs becomes one "_", with none at either end; nothing left gives "wordlist";
# the second, third, ... name of a kind ends in "_2", "_3", ...
KEPT = "A-Za-z0-9_"
DEFAULT_FALLBACK = "wordlist"


def sanitize_identifier(value: object, fallback: str = DEFAULT_FALLBACK) -> str:
    """The kept runs of ``value``, joined by ``_``."""
    runs = re.findall(f"[{KEPT}]+", str(value))
    return "_".join(runs).strip("_") or fallback


def allot(wanted: Iterable[str], taken: Iterable[str] = (), case_insensitive: bool = True) -> list[str]:
    """A free name for each wanted one, in order; ``taken`` names are used already."""
    fold = str.lower if case_insensitive else str
    used = set(map(fold, taken))
    number: dict[str, int] = {}  # the last number given to a base
    names = []
    for base in wanted:
        name = base
        while fold(name) in used:
            number[fold(base)] = number.get(fold(base), 1) + 1
            name = f"{base}_{number[fold(base)]}"
        used.add(fold(name))
        names.append(name)
    return names


def uniquify(value: str, existing: Iterable[str], case_insensitive: bool = True) -> str:
    """One free name for ``value`` beside ``existing``."""
    return allot([value], existing, case_insensitive)[0]


def sanitize_columns(columns: Iterable[object], case_insensitive: bool = True) -> list[str]:
    """Cleaned names, all different, in the order of ``columns``."""
    return allot(map(sanitize_identifier, columns), case_insensitive=case_insensitive)


def sanitize_identifier_col(c: Column | str, fallback: str = DEFAULT_FALLBACK) -> Column:
    """:func:`sanitize_identifier` for names held in data."""
    col = F.col(c) if isinstance(c, str) else c
    runs = F.array_join(F.regexp_extract_all(col, F.lit(f"[{KEPT}]+"), F.lit(0)), "_")
    name = F.regexp_replace(runs, "^_+|_+$", "")
    return F.when(name == "", F.lit(fallback)).otherwise(name)
