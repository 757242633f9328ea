"""Scalar text functions as column expressions; Arrow UDFs only where Spark has no function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .matching import levenshtein, longest_common, sequence_ratio  # noqa: F401

# Structure characters that matching ignores, and separators that the numeric rung ignores too.
STRUCTURE = r"|*#`>~_"
SEPARATORS = r",.\-‐-―/()\[\]{}:;%·・､、。"
TOKEN = "[0-9a-z가-힣㄰-㆏一-鿿]+"

#: Texts of these characters only are their own NFKC form, so they need no Python.
_STABLE = r"^[\x00-\x7FÀ-ÖØ-öø-ÿ가-힣一-鿿]*$"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    stable = text.rlike(_STABLE)
    return F.when(stable, text).otherwise(_nfkc(F.when(stable, None).otherwise(text)))


def nfkc_lower(text: Column) -> Column:
    return F.lower(nfkc(text))


def normalize_for_match(text: Column, exact_unicode: bool = True) -> Column:
    """Lower-cased NFKC text without white space and structure characters. ``exact_unicode=False`` skips NFKC."""
    base = nfkc_lower(text) if exact_unicode else F.lower(text)
    return F.regexp_replace(base, rf"(?U)[{STRUCTURE}\s\x1c-\x1f]", "")


def strip(text: Column) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def numeric_form(normalized: Column) -> Column:
    return F.regexp_replace(normalized, f"[{SEPARATORS}]", "")


def tokens(text: Column, exact_unicode: bool = True) -> Column:
    return F.regexp_extract_all(nfkc_lower(text) if exact_unicode else F.lower(text), F.lit(TOKEN), F.lit(0))


def _count(text: Column, kind: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{kind}]", ""))


def detect_language(text: Column) -> Column:
    """ko where Hangul syllables outnumber Latin letters, en where these are more than twice as many, else mixed."""
    hangul, latin = _count(text, "가-힯"), _count(text, "A-Za-z")
    return F.when(hangul > latin, "ko").when(latin > hangul * 2, "en").otherwise("mixed")


def question_language(text: Column) -> Column:
    return F.when(text.rlike("[가-힣]"), "ko").otherwise("en")


def infer_domain(path: Column, labels: tuple[tuple[str, str], ...] = (("documents", "documents"), ("papers", "papers"))) -> Column:
    """The label of the first folder name that the path contains, else unknown; ``labels`` are (name, label)."""
    out = F.lit("unknown")
    for name, label in reversed(labels):
        out = F.when(F.contains(path, F.lit(name)), label).otherwise(out)
    return out


def derive_doc_id(path: Column) -> Column:
    got = F.regexp_extract(path, "(?:^|/)(?:documents|papers)/([^/]*)", 1)
    return F.when(path.rlike("(?:^|/)(?:documents|papers)/"), got).otherwise("unknown")


def doc_page(path: Column) -> Column:
    """<folder>_<file name without its suffix>."""
    parts = F.split(path, "/")
    return F.concat_ws("_", F.get(parts, F.size(parts) - 2), F.regexp_replace(F.get(parts, F.size(parts) - 1), r"\.[^.]*$", ""))


def page_key(doc_name: Column, index: Column) -> Column:
    return F.concat(F.substring_index(doc_name, "/", -1), F.lit("__p"), index.cast("string"))


def row_key(index: Column, prefix: str = "val") -> Column:
    digits = index.cast("string")
    return F.concat(F.lit(f"{prefix}_"), F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0")))


def rebase_path(path: Column, marker: str, root: str) -> Column:
    """``root`` with what follows the first ``marker`` of the path; the path itself where there is none."""
    at = F.locate(marker, path)
    return F.when(at > 0, F.concat(F.lit(root.rstrip("/") + "/"), F.ltrim(F.substring(path, at + len(marker), F.length(path)), F.lit("/")))).otherwise(path)


def scale_of_name(name: Column, label: str = "lambda") -> Column:
    """The number that two digits after a label name: ..lambda03.. is 0.3; null without them."""
    digits = F.regexp_extract(name, f"{label}([0-9])([0-9])", 0)
    return F.when(digits != "", F.substring(digits, len(label) + 1, 1).cast("int") + F.substring(digits, len(label) + 2, 1).cast("int") / 10.0)


def relative_image(path: Column, root: str, sheet: str, marker: str = "/images/") -> Column:
    """An image's path seen from the folder of a sheet: what follows the first marker, below ``root``. Null without the marker."""
    import posixpath

    at = F.locate(marker, path)
    return F.when(at > 0, F.concat(F.lit(posixpath.relpath(root, sheet) + "/"), F.substring(path, at + len(marker), F.length(path))))


def interval_text(mean: Column, low: Column, high: Column, digits: int = 4) -> Column:
    """mean [low, high]"""
    return F.format_string(f"%.{digits}f [%.{digits}f, %.{digits}f]", F.round(mean, digits), F.round(low, digits), F.round(high, digits))


def has_table(text: Column) -> Column:
    """Whether a page has a table: an HTML one, or a row of a Markdown table's rule."""
    return text.rlike(r"(?i)<table[\s>]") | text.rlike(r"(?m)^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)+\|?\s*$")


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def text_ned(a: Column, b: Column) -> Column:
    """Levenshtein distance by the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(0.0)).otherwise(levenshtein(a, b) / longest)


@F.pandas_udf(T.IntegerType())
def longest_common_substring(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else len(x) if x in y else longest_common(x, y) for x, y in zip(a, b)], dtype="Int32")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def longest_common_each(text: pd.Series, spans: pd.Series) -> pd.Series:
    """The longest common substring of a text with each of several spans."""
    one = lambda x, t: None if x is None else len(x) if x in t else longest_common(x, t)
    return pd.Series([None if t is None or some is None else [one(x, t) for x in some] for t, some in zip(text, spans)])


@F.pandas_udf(T.DoubleType())
def token_recall(answer: pd.Series, page: pd.Series) -> pd.Series:
    """The share of an answer's tokens, each time it has one, that are on the page; 0 without tokens. NFKC is exact, which no lambda can call."""
    split = lambda t: re.findall(TOKEN, unicodedata.normalize("NFKC", t).lower())

    def share(a, p):
        if a is None or p is None:
            return None
        want, have = split(a), set(split(p))
        return sum(t in have for t in want) / len(want) if want else 0.0

    return pd.Series([share(a, p) for a, p in zip(answer, page)], dtype="float64")
