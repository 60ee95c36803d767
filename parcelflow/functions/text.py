"""Names, identifiers and their comparison, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Census codes of 2011 and the names they stand for.
STATE_CODES = {
    "01": "Jammu and Kashmir", "02": "Himachal Pradesh", "03": "Punjab", "04": "Chandigarh", "05": "Uttarakhand", "06": "Haryana", "07": "Delhi",
    "08": "Rajasthan", "09": "Uttar Pradesh", "10": "Bihar", "11": "Sikkim", "12": "Arunachal Pradesh", "13": "Nagaland", "14": "Manipur", "15": "Mizoram",
    "16": "Tripura", "17": "Meghalaya", "18": "Assam", "19": "West Bengal", "20": "Jharkhand", "21": "Odisha", "22": "Chhattisgarh", "23": "Madhya Pradesh",
    "24": "Gujarat", "25": "Daman and Diu", "26": "Dadra and Nagar Haveli", "27": "Maharashtra", "28": "Andhra Pradesh", "29": "Karnataka", "30": "Goa",
    "31": "Lakshadweep", "32": "Kerala", "33": "Tamil Nadu", "34": "Puducherry", "35": "Andaman and Nicobar Islands",
}

# Spellings of state names and the canonical name.
STATE_ALIASES = {
    "orissa": "Odisha", "pondicherry": "Puducherry", "uttranchal": "Uttarakhand", "mysore": "Karnataka", "karnatak": "Karnataka",
    "andamans and nicobars": "Andaman and Nicobar Islands", "andaman and nicobar": "Andaman and Nicobar Islands", "tamilnadu": "Tamil Nadu",
    "madras": "Tamil Nadu", "laccadive minicoy and amindiv": "Lakshadweep", "goa daman and diu": "Goa", "andhra pradesh telangana": "Andhra Pradesh",
    "dadra and nagar have": "Dadra and Nagar Haveli",
}

# A name that says there is none.
SENTINEL = r"^(nan||data not available|not available|n/?a|unknown|no data|unnamed|-+)$"


def lookup(key: Column, values: Mapping[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def stable_id(*parts: Column) -> Column:
    """The first 32 hex digits of the digest of the parts, joined by bars; a null part is empty."""
    return F.left(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), F.lit(32))


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def fold(x: Column) -> Column:
    """Letters without their marks; only text beyond ASCII leaves the JVM."""
    return F.when(x.rlike(r"^\p{ASCII}*$"), x).otherwise(_fold(x))


def normalize_ascii(x: Column, fold_underscore: bool = False) -> Column:
    """normalize_name for text that is ASCII already, or whose marks may go with their letters."""
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"^\s+|\s+$", "")))
    t = F.replace(t, F.lit("&"), F.lit(" and "))
    t = F.regexp_replace(t, "[.’'`]", "")
    t = F.regexp_replace(t, "[-–—/_]" if fold_underscore else "[-–—/]", " ")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    t = F.regexp_replace(t, r"\bdistrict\b", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def normalize_name(x: Column, fold_underscore: bool = False) -> Column:
    """The form in which names are compared; a null is empty."""
    return normalize_ascii(fold(F.coalesce(x.cast("string"), F.lit(""))), fold_underscore)


def display_name(x: Column) -> Column:
    """Title case: a letter after anything but a letter is a capital, all others are small."""
    t = F.trim(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"\s+", " "))
    runs = F.regexp_extract_all(t, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


def canonical_state(x: Column) -> Column:
    return F.coalesce(lookup(F.replace(normalize_name(x), F.lit(","), F.lit("")), STATE_ALIASES), display_name(x))


def state_of_code(code: Column) -> Column:
    """The state of a census code of one or two digits; null if there is none."""
    return lookup(F.lpad(code.cast("string"), 2, "0"), STATE_CODES)


def parse_multi_name(x: Column) -> Column:
    """The names in a list joined by commas or 'and'."""
    parts = F.split(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"(?i)\band\b", ","), ",")
    tidy = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.trim(p), r"\.+$", "")))
    return F.filter(tidy, lambda p: p != "")


def is_unnamed(x: Column) -> Column:
    return x.isNull() | F.lower(F.trim(x)).rlike(SENTINEL)


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity: a fold over the letters of a takes, for each, the first equal letter of b in reach that is not taken.

    0 if one of two different names is empty, null if one is null.
    """
    letters = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda k: F.substring(x, k, F.lit(1)))
    size_a, size_b = F.length(a), F.length(b)
    reach = F.greatest(F.floor(F.greatest(size_a, size_b) / 2).cast("int") - 1, F.lit(0))

    def matched(x: Column, y: Column) -> Column:
        """Places in y, in the order of the letters of x that they were taken for."""

        def take(taken: Column, k: Column) -> Column:
            low, high = F.greatest(k - reach, F.lit(0)), F.least(k + reach, F.size(y) - 1)
            free = F.filter(F.sequence(low, high), lambda j: (F.get(y, j) == F.get(x, k)) & ~F.array_contains(taken, j))
            return F.when((low > high) | (F.size(free) == 0), taken).otherwise(F.array_append(taken, F.get(free, F.lit(0))))

        return F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), F.array().cast("array<int>"), take)

    def similarity(y: Column, taken: Column) -> Column:
        m = F.size(taken)
        swaps = F.size(F.filter(F.zip_with(taken, F.array_sort(taken), lambda i, j: F.get(y, i) != F.get(y, j)), lambda v: v)) / 2
        return F.when(m > 0, (m / size_a + m / size_b + (m - swaps) / m) / 3).otherwise(0.0)

    # each fold is made once: as the element of an array that the next step goes over
    split = F.array(F.struct(letters(a).alias("x"), letters(b).alias("y")))
    taken = F.transform(split, lambda s: F.struct(s["y"].alias("y"), matched(s["x"], s["y"]).alias("taken")))
    found = F.get(F.transform(taken, lambda s: similarity(s["y"], s["taken"])), F.lit(0))
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).when((size_a == 0) | (size_b == 0), 0.0).otherwise(found)


def name_similarity(a: Column, b: Column) -> Column:
    """Jaro, raised by a tenth of what it lacks for each of the first four places where both names agree."""
    same = sum((F.when((F.length(a) >= k) & (F.length(b) >= k) & (F.substring(a, k, 1) == F.substring(b, k, 1)), 1).otherwise(0) for k in range(1, 5)), F.lit(0))
    j = jaro(a, b)
    return j + same * F.lit(0.1) * (1 - j)
