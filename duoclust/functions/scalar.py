"""Column expressions and small driver-side checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MODELS = {"binary": "bernoulli", "bernoulli": "bernoulli", "binomial": "binomial", "multinomial": "multinomial"}


def score_model(name: str) -> str:
    """One of bernoulli, binomial, multinomial; "binary" is bernoulli, in any case of letters."""
    try:
        return _MODELS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown score model {name!r}") from None


def at_least(least: float, /, **arguments: float) -> None:
    """ValueError if an argument is not a number of at least that much."""
    for name, value in arguments.items():
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not value >= least:
            raise ValueError(f"{name} is {value!r}, and must be at least {least}")


def tokens(text: str | Column) -> Column:
    """Runs of ASCII letters; a null text has none."""
    return F.coalesce(F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit("[A-Za-z]+"), F.lit(0)), F.array().cast("array<string>"))


def ngrams(words: str | Column, n: int) -> Column:
    """The n-grams of a word array, as arrays; none if it is shorter than n."""
    w = F.col(words) if isinstance(words, str) else words
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.slice(w, i, n))).otherwise(F.array().cast("array<array<string>>"))


def display(gram: str) -> Column:
    return F.concat_ws(" ", gram)


def mirrored(text: str) -> Column:
    """The code points in reverse, for right-to-left display."""
    return F.reverse(F.col(text))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def threshold_label(membership: str) -> Column:
    return (F.col(membership) >= 0.5).cast("int")


def half_even_label(weight: str) -> Column:
    """Rounds 0.5 to 0, unlike threshold_label."""
    return F.bround(F.col(weight), 0).cast("int")


def rounded_fraction(x: Column) -> Column:
    """To one decimal, halves away from zero."""
    return F.round(x, 1)


def without_nan(x: str) -> Column:
    return F.when(~F.isnan(F.col(x)), F.col(x))


def truncated_share(total: Column, share: Column, least: int = 0) -> Column:
    return F.greatest(F.lit(least), (total * share).cast("int"))


def probability_label(p: str) -> Column:
    """"1" for one, else two decimals, halves to even, without trailing zeros."""
    return F.when(F.abs(F.col(p) - 1) <= 1e-5 + 1e-8, F.lit("1")).otherwise(F.rtrim(F.format_number(F.col(p), 2), F.lit("0")))


def result_key(n: str, window: str, features: str) -> Column:
    """n-…_l-…_f-…; a null number of features is "all"."""
    return F.format_string("n-%d_l-%d_f-%s", F.col(n).cast("int"), F.col(window).cast("int"), F.coalesce(F.col(features).cast("string"), F.lit("all")))


def l2_norm(vector: str | Column) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def wrapped_seed(seed: Column, attempt: Column) -> Column:
    """seed + attempt * 0x9E3779B97F4A7C15 modulo 2**64, as a decimal that holds 64 unsigned bits."""
    product = seed.cast("decimal(20,0)") + attempt.cast("decimal(4,0)") * F.lit(str(0x9E3779B97F4A7C15)).cast("decimal(20,0)")
    return F.pmod(product, F.lit(str(1 << 64)).cast("decimal(21,0)")).cast("decimal(20,0)")


def argmax_label(responsibilities: str) -> Column:
    """The place, from 0, of the largest entry; the first of equal ones."""
    r = F.col(responsibilities)
    return (F.array_position(r, F.array_max(r)) - 1).cast("int")
