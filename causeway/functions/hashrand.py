"""Deterministic randomness from md5, the same in any engine, so that splits and draws survive retries and can be checked elsewhere."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway.functions.workers import by_value

by_value(__name__)


def uniform(*parts: Column | str | int) -> Column:
    """In [0, 1): the first 32 bits of the md5 of the parts joined by '|'."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(*parts: Column | str | int) -> Column:
    """Standard normal by Box and Muller; the first uniform is kept off 0."""
    u, v = uniform(*parts, "a"), uniform(*parts, "b")
    return F.sqrt(-2.0 * F.ln(F.greatest(u, F.lit(1e-12)))) * F.cos(F.lit(2.0 * 3.141592653589793) * v)


def poisson1(*parts: Column | str | int) -> Column:
    """Poisson with mean 1, by inversion; the weight of a row in one bootstrap draw."""
    u, out, p, total = uniform(*parts), F.lit(0), 0.36787944117144233, 0.0
    for k in range(12):
        p = p if k == 0 else p / k
        total += p
        out = out + (u >= total).cast("int")
    return out


#: Multipliers of the 64-bit mixture behind bootstrap weights.
KEY, DRAW, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def uniforms(keys, draws):
    """Rows by draws, in [0, 1): the upper 53 bits of a mixture of key and draw. For worker functions."""
    import numpy as np

    x = keys.astype(np.int64).view(np.uint64)[:, None] * np.uint64(KEY) + np.asarray(draws).astype(np.uint64)[None] * np.uint64(DRAW)
    for shift, multiplier in ((30, FIRST), (27, SECOND)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(multiplier)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def poisson_weights(keys, draws: int, seed: int = 0):
    """Rows by draws: Poisson weights with mean 1, by inversion of uniforms(). For worker functions."""
    import numpy as np

    u = uniforms(keys, np.arange(1 + seed * draws, 1 + (seed + 1) * draws, dtype=np.uint64))
    out = np.zeros(u.shape, np.uint8)
    p, total = 0.36787944117144233, 0.0
    for k in range(12):
        p = p if k == 0 else p / k
        total += p
        out += u >= total
    return out.astype(float)
