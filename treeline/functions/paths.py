"""Column expressions over '/'-joined paths: the tree is implicit in the strings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(path: Column | str) -> Column:
    return F.col(path) if isinstance(path, str) else path


def parts(path: Column | str) -> Column:
    return F.split(_c(path), "/")


def ancestors(path: Column | str, *, root: bool = True, itself: bool = False) -> Column:
    """Strict ancestors from the top, with '' as the root; with the path too if ``itself``. Prefix joins become equi-joins on them."""
    p = parts(path)
    last = F.size(p) if itself else F.size(p) - 1
    up = F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
    up = F.when(_c(path) == "", F.array().cast("array<string>")).otherwise(up)
    return F.concat(F.array(F.lit("")), up) if root else up


def name(path: Column | str) -> Column:
    return F.element_at(parts(path), -1)


def parent(path: Column | str) -> Column:
    """The parent directory; null for an entry of the root."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.array_join(F.slice(p, F.lit(1), F.size(p) - 1), "/"))


def depth(path: Column | str) -> Column:
    return F.size(parts(path))


def suffix(file_name: Column | str) -> Column:
    """The last ``.xyz`` with something before it and no trailing dot; '' without one."""
    return F.regexp_extract(_c(file_name), r"^.+([.][^./]+)$", 1)


def ascii_fold(text: Column | str) -> Column:
    """A-Z to a-z and nothing else, as NOCASE collations of embedded databases fold."""
    return F.translate(_c(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Unicode case folding, which ``lower`` is not (ß, final sigma)."""
    return text.map(lambda t: None if t is None else t.casefold())


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def trimmed(text: pd.Series) -> pd.Series:
    """Without white space at both ends, as ``str.strip`` counts it."""
    return text.map(lambda t: None if t is None else t.strip())


def normalise(path: Column | str) -> Column:
    """Drops empty and '.' segments and keeps the spelling; an absolute path or a '..' segment raises."""
    path = _c(path)
    kept = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: (s != "") & (s != "."))
    bad = path.startswith("/") | F.array_contains(kept, "..")
    return F.when(bad, F.raise_error(F.concat(F.lit("path escapes its root: "), path))).otherwise(F.array_join(kept, "/"))


def top(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", 1)
