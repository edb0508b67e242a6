"""Text columns: normal forms, words, character n-grams and lexical similarity."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def without_marks(text: Column) -> Column:
    """The compatibility decomposition without its combining marks."""

    @F.pandas_udf("string")
    def decomposed(texts: pd.Series) -> pd.Series:
        plain = lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return texts.map(plain, na_action="ignore")

    return decomposed(text)


def folded(text: Column) -> Column:
    """The compatibility form in folded case, with single spaces: marks stay, letters that differ in case or form only are equal."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(_folded, na_action="ignore")

    return fold(text)


def _folded(t: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", t).casefold().split())


#: Strings that are looked for one by one; more go through one automaton.
FEW_STRINGS = 8


def found_in(values: list[str], source: str) -> list[bool]:
    """Which of the folded strings stand in the folded source; blank ones never do."""
    if len(values) <= FEW_STRINGS:
        return [bool(v) and v in source for v in values]
    import ahocorasick

    automaton = ahocorasick.Automaton()
    wanted = {v for v in values if v}
    for v in wanted:
        automaton.add_word(v, v)
    seen: set[str] = set()
    if wanted:
        automaton.make_automaton()
        for _, v in automaton.iter(source):
            seen.add(v)
            if len(seen) == len(wanted):
                break
    return [v in seen for v in values]


def stands_in(values: Column | str, source: Column | str) -> Column:
    """For each of an array of strings whether it stands in a text, both folded; the text is folded and read once for all of them."""

    @F.pandas_udf("array<boolean>")
    def find(lists: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([found_in([_folded(v) for v in vs], _folded(t or "")) for vs, t in zip(lists, texts)])

    return find(values, source)


def normalized(text: Column) -> Column:
    """Lower case without marks, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(without_marks(text)), r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """The words of a text in order, in lower case; letters and digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def terms(text: Column) -> Column:
    """Distinct alphanumeric words of at least two characters, for retrieval."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), lambda w: F.length(w) >= 2)


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Overlapping n-grams of a normal text; a shorter text is its own, an empty one has none.

    The text is cut into characters once, under a name, and each n-gram joins
    n of them, so that the time grows with the text.
    """

    def grams(chars: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
        return F.when(F.size(chars) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.concat_ws("", *[F.get(chars, i + k) for k in range(n)])))

    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), grams), 0)


def char_ngram_counts(text: Column, n: int = 3) -> Column:
    """How many n-grams ``char_ngrams`` gives, how many of them differ, the first and the last; no text's n-grams are held as a list of strings."""

    @F.pandas_udf("n long, n_distinct long, first string, last string")
    def counts(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            if not t:
                rows.append((None, None, None, None) if t is None else (0, 0, None, None))
            else:
                rows.append((max(1, len(t) - n + 1), _distinct_ngrams(t, n), t[:n], t[-n:]))
        return pd.DataFrame(rows, columns=["n", "n_distinct", "first", "last"]).astype({"n": "Int64", "n_distinct": "Int64"})

    return counts(text)


def _distinct_ngrams(t: str, n: int) -> int:
    if len(t) <= n:
        return 1
    if n > 3:  # up to three code points of 21 bits fit a number
        return len({t[i : i + n] for i in range(len(t) - n + 1)})
    codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    keys = codes[: len(codes) - n + 1].copy()
    for k in range(1, n):
        keys = keys << np.uint64(21) | codes[k : len(codes) - n + 1 + k]
    keys.sort()
    return 1 + int(np.count_nonzero(keys[1:] != keys[:-1]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def bag_f1(a: Column, b: Column) -> Column:
    """F1 of the overlap of two bags, given as arrays; 1 if both are empty, 0 if one is."""

    @F.pandas_udf("double")
    def overlap(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _bag_f1(Counter(x), Counter(y)) for x, y in zip(xs, ys)], dtype="float64")

    return overlap(a, b)


def _bag_f1(a: Counter, b: Counter) -> float:
    if not a or not b:
        return float(not a and not b)
    return 2 * sum((a & b).values()) / (a.total() + b.total())


def lexical_similarity(a: Column, b: Column) -> Column:
    """Of normal texts: 1 if equal, else 0.45 of the words' and 0.40 of the trigrams' bag F1; in one pass over each text."""

    def bags(t: str) -> tuple[Counter, Counter]:
        t = t.lower()
        return Counter(re.findall(r"\w+", t)), Counter(t[i : i + 3] for i in range(max(1, len(t) - 2))) if t else Counter()

    @F.pandas_udf("double")
    def compare(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys):
            if x is None or y is None or x == y:
                out.append(None if x is None or y is None else 1.0)
                continue
            (wx, gx), (wy, gy) = bags(x), bags(y)
            out.append(0.45 * _bag_f1(wx, wy) + 0.40 * _bag_f1(gx, gy))
        return pd.Series(out, dtype="float64")

    return compare(a, b)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; 0 if one has no length."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size).otherwise(0.0)


def clean_list(items: Column) -> Column:
    """Trimmed entries without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))


def flat_list(categories: list[Column]) -> Column:
    """The clean entries of all categories in one list."""
    return F.array_distinct(F.flatten(F.array(*[clean_list(c) for c in categories])))
