"""Array and tensor functions: Column -> Column by higher-order functions, inside the JVM. NULL arrays give NULL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(values: Column) -> Column:
    """An array of doubles."""
    return values.cast("array<double>")


def total(values: Column) -> Column:
    """The sum of an array; 0 for an empty one."""
    return F.aggregate(doubles(values), F.lit(0.0), lambda a, x: a + x)


def pad_or_trim(values: Column, length: int, fill: float = 0.0) -> Column:
    """The first length elements, filled up at the end."""
    short = F.greatest(F.lit(length) - F.size(values), F.lit(0))
    return F.concat(F.slice(values, 1, length), F.array_repeat(F.lit(fill), short))


def end_padded(ids: Column, length: int, end: int, force_end: bool = True) -> Column:
    """ids filled up with end; longer ones are cut, and then the last is end if force_end."""
    cut = F.concat(F.slice(ids, 1, length - 1), F.array(F.lit(end))) if force_end else F.slice(ids, 1, length)
    return F.when(F.size(ids) > length, cut).otherwise(F.concat(ids, F.array_repeat(F.lit(end), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))))


def shifted(ids: Column) -> tuple[Column, Column]:
    """(input, target): all but the last and all but the first."""
    rest = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.slice(ids, F.lit(1), rest), F.slice(ids, F.lit(2), rest)


def before_end(ids: Column, end: int) -> Column:
    """ids up to the first end; all of them without one."""
    at = F.array_position(ids, end)
    return F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside a function over elements it would be computed for each of them."""
    return F.transform(F.array(value), body)[0]


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Log probabilities of logits divided by a temperature, shifted by the largest for stability."""
    scaled = F.transform(doubles(logits), lambda x: x / temperature)
    rest = lambda s, top: F.log(F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top
    return let(scaled, lambda s: let(F.array_max(s), lambda top: let(rest(s, top), lambda norm: F.transform(s, lambda x: x - norm))))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities of logits divided by a temperature."""
    return F.transform(log_softmax(logits, temperature), F.exp)


def probability_of(logits: Column, token: int) -> Column:
    """The probability of one token, such as the one for no speech at the start of a sequence; NULL beyond the logits."""
    return F.get(softmax(logits), F.lit(token))


def exact_quotient(a: Column, b: Column) -> Column:
    """a / b of whole numbers; an error where a is no multiple of b, NULL for NULLs."""
    return F.when(a % b == 0, F.floor(a / b)).when((a % b).isNotNull(), F.raise_error(F.concat(a.cast("string"), F.lit(" is no multiple of "), b.cast("string"))).cast("bigint"))


def half_even(value: Column, digits: int) -> Column:
    """value rounded to digits, a half to the even neighbour."""
    return F.bround(value, digits)


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays of equal length."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays; NULL for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def kl_divergence(teacher: Column, student: Column, temperature: float) -> Column:
    """KL divergence of the tempered student from the tempered teacher, times the squared temperature."""
    terms = F.zip_with(log_softmax(teacher, temperature), log_softmax(student, temperature), lambda t, s: F.exp(t) * (t - s))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) * (temperature * temperature)


def cross_entropy(logits: Column, label: Column) -> Column:
    """The negative log probability of the label (from 0); NULL for one outside."""
    return -F.get(log_softmax(logits), label)


def fitted(values: Column, length: int) -> Column:
    """Another vocabulary's values: cut, or filled up with zeros."""
    return pad_or_trim(doubles(values), length, 0.0)


def suppressed(logits: Column, ids: list[int]) -> Column:
    """logits with minus infinity at the positions ids."""
    return F.transform(doubles(logits), lambda x, i: F.when(i.isin(ids), F.lit(float("-inf"))).otherwise(x))


def argmax(values: Column) -> Column:
    """The first position (from 0) of the largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_positions(values: Column, k: int) -> Column:
    """The positions of the k largest values, the smaller position first on a tie."""
    order = F.array_sort(F.transform(doubles(values), lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    return F.transform(F.slice(order, 1, k), lambda s: s["i"])


def length_penalty(length: Column, alpha: float | None) -> Column:
    """((5 + length) / 6) to the power alpha; the length itself without alpha."""
    return length.cast("double") if alpha is None else F.pow((length + 5) / 6.0, F.lit(alpha))


def root_mean_square(values: Column) -> Column:
    """The root of the mean square; NULL for an empty array."""
    return F.when(F.size(values) > 0, F.sqrt(dot(values, values) / F.size(values)))


def signal_to_noise(values: Column) -> Column:
    """20 log10 of the mean of the top tenth of magnitudes over that of the bottom tenth; NULL where the bottom tenth is empty."""
    size = F.array_size(values)
    ordered = F.array_sort(F.transform(doubles(values), F.abs))
    low, high = F.floor(size * 0.1).cast("int"), F.floor(size * 0.9).cast("int")
    mean = lambda part, n: total(part) / n
    noise, level = mean(F.slice(ordered, F.lit(1), low), low), mean(F.slice(ordered, high + 1, size - high), size - high)
    return F.when(low > 0, 20 * F.log10(level / (noise + 1e-10)))


def norm_clipped(values: Column, limit: float) -> Column:
    """values scaled so that their norm is at most limit."""
    scale = lambda norm: F.when(norm > limit, limit / norm).otherwise(1.0)
    return let(scale(F.sqrt(dot(values, values))), lambda f: F.transform(doubles(values), lambda x: x * f))


def learning_rate(step: Column, kind: str, base: float, warmup: int, steps: int, least: float) -> Column:
    """The rate at a step: linear warm-up, then constant, linear or cosine down to least."""
    warm = base * step / warmup
    progress = F.least((step - warmup) / (steps - warmup), F.lit(1.0))
    after = {"constant": F.lit(base), "linear": base - (base - least) * progress, "cosine": least + (base - least) * 0.5 * (1 + F.cos(math.pi * progress))}[kind]
    return F.when(step < warmup, warm).otherwise(after)


def position_code(position: Column, channel: Column, channels: int, scale: float = 10000.0) -> Column:
    """Sinusoidal code: sines in the first half of the channels, cosines in the second."""
    half = channels // 2
    angle = position * F.exp(-math.log(scale) / (half - 1) * (channel % half))
    return F.when(channel < half, F.sin(angle)).otherwise(F.cos(angle))


def human_time(seconds: Column) -> Column:
    """Seconds as '1h 2m 3s', without leading zero parts."""
    whole = F.floor(seconds)
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))
