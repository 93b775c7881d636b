"""Text and vector similarity.

Set algebra, lengths and cosines are native expressions. Only three character or token recurrences, which SQL
expressions cannot state without quadratic arrays, are small Arrow UDFs; each is handed nulls where a native test has
already decided the row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake import fixed
from voxlake.functions import text as tx
from voxlake.functions.once import computed_once, let


def _seats(text: str) -> dict[str, int]:
    """Per character the set of its places, as bits."""
    seats: dict[str, int] = {}
    for i, ch in enumerate(text):
        seats[ch] = seats.get(ch, 0) | (1 << i)
    return seats


def _common(a: str, b: str, seats: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, one machine-integer row per character of `b`."""
    seats = _seats(a) if seats is None else seats
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & seats.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def common_lengths(a: pd.Series, b: pd.Series) -> pd.Series:
    """Pairwise longest-common-subsequence lengths of two string arrays; null pairs stay null."""
    return pd.Series(
        [
            None if xs is None or ys is None else [None if x is None or y is None else _common(x, y) for x, y in zip(xs, ys)]
            for xs, ys in zip(a, b)
        ]
    )


def _best_span(needle: str, text: str) -> tuple[float, int]:
    """Best indel ratio (0-100) of `needle` against windows of `text`, and the length of that window. Of equal lengths,
    either may be the one that windows are taken from."""
    found = _span_in(needle, text)
    if len(needle) == len(text) and found[0] < 100:
        other = _span_in(text, needle)
        if other[0] > found[0]:
            return other[0], len(text)
    return found


def _span_in(needle: str, text: str) -> tuple[float, int]:
    """The same with windows from the longer one, or from `text`.

    Windows as long as the needle, then shorter ones at both ends. A common subsequence changes by at most one when a
    window moves by one character, so windows that cannot beat the best so far are stepped over; none is missed.
    """
    swapped = len(needle) > len(text)
    short, long = (text, needle) if swapped else (needle, text)
    m, n = len(short), len(long)
    if m == 0:
        return 0.0, 0
    seats = _seats(short)
    top, i = -1, 0
    while i <= n - m:
        common = _common(short, long[i : i + m], seats)
        top = max(top, common)
        i += top - common + 1
    best, span = 100.0 * top / m, m
    for end in (False, True):
        k = m - 1
        while k > 0 and 200.0 * k / (m + k) > best:
            common = _common(short, long[n - k :] if end else long[:k], seats)
            score = 200.0 * common / (m + k)
            if score > best:
                best, span = score, k
            # A shorter window holds at most this many common characters.
            k = min(k - 1, int(200.0 * common / best - m)) if best > 0 else k - 1
    return best, m if swapped else span


@F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("span", T.IntegerType())]))
def best_span(needle: pd.Series, text: pd.Series) -> pd.DataFrame:
    pairs = [(None, None) if a is None or b is None else _best_span(a, b) for a, b in zip(needle, text)]
    return pd.DataFrame(
        {
            "score": pd.Series([p[0] for p in pairs], dtype="Float64"),
            "span": pd.Series([p[1] for p in pairs], dtype="Int32"),
        }
    )


def _edits(reference, hypothesis) -> int:
    """Edit distance between two token lists, one machine-integer column per token (Myers 1999, Hyyro 2003)."""
    m = len(reference)
    if m == 0:
        return len(hypothesis)
    seats: dict[str, int] = {}
    for i, token in enumerate(reference):
        seats[token] = seats.get(token, 0) | (1 << i)
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    for token in hypothesis:
        same = seats.get(token, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        plus = down | (full & ~(horizontal | up))
        minus = up & horizontal
        distance += bool(plus & last) - bool(minus & last)
        plus = ((plus << 1) | 1) & full
        minus = (minus << 1) & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
    return distance


@F.pandas_udf(T.IntegerType())
def word_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Word-level edit distance between two token arrays."""
    return pd.Series(
        [None if r is None or h is None else _edits(r, h) for r, h in zip(reference, hypothesis)], dtype="Int32"
    )


#: From so many words on, only the cells that the fewest edits can reach are filled in.
BAND_WORDS = 2000


def _alignment(reference, hypothesis) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of the best alignment: fewest edits, then most words right.

    One row of costs at a time: an edit costs `unit`, a substitution one more, so that the last cost holds both counts, and
    the lengths tell deletions from insertions.
    """
    codes: dict[str, int] = {}
    a, b = (np.array([codes.setdefault(w, len(codes)) for w in words], "int64") for words in (reference, hypothesis))
    m, n = len(a), len(b)
    same = int(np.argmin(np.append(a[: min(m, n)] == b[: min(m, n)], False)))
    a, b = a[same:], b[same:]
    tail = int(np.argmin(np.append((a[::-1][: min(len(a), len(b))] == b[::-1][: min(len(a), len(b))]), False)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(b) > len(a):
        a, b = b, a  # the shorter one makes the row; deletions and insertions follow from m and n in any case
    unit = len(a) + len(b) + 1
    # Gaps are as many as the edits at most, so the path leaves neither side of a band around the diagonal. Short texts are
    # done before the edits are counted.
    fewest = _edits(a.tolist(), b.tolist()) if len(b) >= BAND_WORDS else len(a) + len(b)
    down, up = (fewest + len(a) - len(b)) // 2, (fewest - len(a) + len(b)) // 2
    steps = unit * np.arange(len(b) + 1)
    row = np.where(np.arange(len(b) + 1) <= up, steps, unit * unit)
    for i, word in enumerate(a.tolist(), 1):
        low, high = max(0, i - down), min(len(b), i + up) + 1
        entry = row[low:high] + unit
        left = max(low, 1)
        diagonal = row[left - 1 : high - 1] + (unit + 1) * (b[left - 1 : high - 1] != word)
        np.minimum(entry[left - low :], diagonal, out=entry[left - low :])
        row[low:high] = np.minimum.accumulate(entry - steps[low:high]) + steps[low:high]  # insertions add a unit a place
    edits, substitutions = divmod(int(row[-1]), unit)
    gaps = edits - substitutions
    return substitutions, (gaps + m - n) // 2, (gaps - m + n) // 2


_KINDS = T.StructType([T.StructField(x, T.IntegerType()) for x in ("substitutions", "deletions", "insertions")])


@F.pandas_udf(_KINDS)
def word_alignment(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Kinds of word errors between two token arrays; null if one is."""
    found = [(None, None, None) if r is None or h is None else _alignment(r, h) for r, h in zip(reference, hypothesis)]
    return pd.DataFrame(found, columns=_KINDS.names, dtype="Int32")


def _distinct_words(text: Column) -> Column:
    return F.array_distinct(tx.words(F.lower(text)))


def _token_set_score(sets: Column, lcs: Column) -> Column:
    len_s, len_a, len_b = F.length(sets["shared"]), F.length(sets["a"]), F.length(sets["b"])
    gap = F.when(len_s > 0, 1).otherwise(0)
    full_a, full_b = len_s + gap + len_a, len_s + gap + len_b

    def score(distance: Column, total: Column) -> Column:
        return F.when(total > 0, 100.0 - 100.0 * distance / total).otherwise(100.0)

    rest = score(len_a + len_b - 2 * lcs, full_a + full_b)
    whole = F.greatest(rest, score(gap + len_a, len_s + full_a), score(gap + len_b, len_s + full_b))
    return (
        F.when(sets["empty"], 0.0).when(sets["covered"], 100.0).when(len_s == 0, rest).otherwise(whole) / 100.0
    )


def with_token_set_ratios(df: DataFrame, text: Column, others: Column, name: str) -> DataFrame:
    """Add `name`: similarity 0-1 of `text` to each text of an array, by shared and unshared words, in any order.

    Built in steps so that each intermediate array is computed once per row.
    """
    stepped = computed_once(df, _ta=_distinct_words(text), _tb=F.transform(others, _distinct_words))
    stepped = computed_once(
        stepped,
        _sets=F.transform(
            "_tb",
            lambda tb: F.struct(
                F.array_intersect("_ta", tb).alias("shared"),
                F.array_sort(F.array_except("_ta", tb)).alias("a"),
                F.array_sort(F.array_except(tb, F.col("_ta"))).alias("b"),
            ),
        ),
    )
    one_empty = lambda s: (F.size(s["a"]) == 0) | (F.size(s["b"]) == 0)
    stepped = computed_once(
        stepped,
        _sets=F.transform(
            "_sets",
            lambda s: F.struct(
                ((F.size(s["shared"]) > 0) & one_empty(s)).alias("covered"),
                ((F.size(s["shared"]) == 0) & one_empty(s)).alias("empty"),
                F.array_join(s["shared"], " ").alias("shared"),
                F.array_join(s["a"], " ").alias("a"),
                F.array_join(s["b"], " ").alias("b"),
            ),
        ),
    )
    undecided = lambda s, side: F.when(~(s["covered"] | s["empty"]), s[side])
    stepped = stepped.withColumn(
        "_lcs",
        common_lengths(
            F.transform("_sets", lambda s: undecided(s, "a")), F.transform("_sets", lambda s: undecided(s, "b"))
        ),
    )
    scored = computed_once(stepped, **{name: F.zip_with("_sets", "_lcs", _token_set_score)})
    return scored.drop("_ta", "_tb", "_sets", "_lcs")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    def ratio(norms: Column) -> Column:
        return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)

    return let(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), ratio)


def vector_support(a: Column, b: Column) -> Column:
    """Cosine rescaled so that the usual floor of sentence vectors maps to zero."""
    scaled = (cosine(a, b) - fixed.COSINE_BASE) / (1 - fixed.COSINE_BASE)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))


def unit(vector: Column) -> Column:
    """Vector of length one; a zero vector stays zero."""
    scale = lambda norm: F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))
    return let(F.sqrt(dot(vector, vector)), scale)
