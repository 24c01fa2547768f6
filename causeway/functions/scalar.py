"""Column expressions for probabilities and text. All stay in whole-stage code or in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(500.0)), F.lit(-500.0))))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.ln(q / (1.0 - q))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def factual(treatment: Column, y1: Column, y0: Column) -> Column:
    return F.when(treatment == 1, y1).otherwise(y0)


def smoothed_label(t: Column, amount: float) -> Column:
    return t * (1.0 - amount) + 0.5 * amount


def arm_means(outcome: Column, propensity: Column, effect: Column, binary: bool) -> tuple[Column, Column]:
    """y0 and y1 from the mean outcome, the propensity and the effect; probabilities are clipped, so y1 - y0 may differ from the effect."""
    y0, y1 = outcome - propensity * effect, outcome + (1.0 - propensity) * effect
    return (clip(y0, 0.0, 1.0), clip(y1, 0.0, 1.0)) if binary else (y0, y1)


def clever_covariate(t: Column, propensity: Column, eps: float = 1e-3) -> Column:
    e = clip(propensity, eps, 1.0 - eps)
    return t / e - (1.0 - t) / (1.0 - e)


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9, and any other non-blank character by itself."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+|[^\s]"), F.lit(0))


def normalized_hash(text: Column) -> Column:
    """SHA-1 of the text with runs of white space as one space."""
    return F.sha1(F.trim(F.regexp_replace(text, r"\s+", " ")))


def safe_filename(text: Column, most: int = 100) -> Column:
    return F.substring(F.regexp_replace(text, r"[^\p{L}\p{N}._-]", "_"), 1, most)


def plain_hyphens(text: Column) -> Column:
    """The dashes that stand for a hyphen."""
    return F.regexp_replace(text, r"[\u2010-\u2015\u2212\uFE58\uFE63\uFF0D]", "-")


def first_number(text: Column, most: float = 100_000.0) -> Column:
    x = F.regexp_extract(text, r"[-+]?\d+(?:\.\d+)?", 0).try_cast("double")
    return F.when(F.abs(x) <= most, x)


def category_codes(text: Column) -> Column:
    """Identifiers of three parts or more that leak a category's code into prose."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z]+(?:_[a-z0-9]+){2,}\b"), F.lit(0))


def response_text(text: Column, marker: str) -> Column:
    """An answer without its reasoning: what follows the last `final` channel's message tag up to the next tag, else what follows the marker."""
    channel = F.regexp_extract(text, r"(?s)<\|channel\|>final<\|message\|>(.*?)(?:<\|(?:end|return|start|channel|message)\|>|\z)", 1)
    return F.when(channel != "", F.trim(channel)).otherwise(after_marker(text, marker))


def last_tokens(text: Column, most: int) -> Column:
    """The last `most` runs of non-blank characters, joined by one space; the text itself if it has no more."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(words)
    return F.when(n <= most, text).otherwise(F.array_join(F.slice(words, F.greatest(n - most + 1, F.lit(1)), F.lit(most)), " "))


def after_marker(text: Column, marker: str) -> Column:
    """What follows the first marker, in any case; the whole text without one."""
    at = F.locate(marker.lower(), F.lower(text))
    return F.when(at > 0, F.trim(F.substring(text, at + F.lit(len(marker)), F.length(text)))).otherwise(text)


def token_window(ids: Column, most: int, mode: str = "head") -> Column:
    """The first, the last, or half of each, of at most `most` tokens; all of them if most <= 0."""
    if mode not in ("head", "tail", "head_tail"):
        raise ValueError(f"unknown window {mode}")
    if most <= 0:
        return ids
    n, half = F.size(ids), most // 2
    tail = lambda k: F.slice(ids, F.greatest(n - k + 1, F.lit(1)), F.lit(k))
    cut = {"head": lambda: F.slice(ids, 1, most), "tail": lambda: tail(most), "head_tail": lambda: F.concat(F.slice(ids, 1, half), tail(most - half))}[mode]()
    return F.when(n <= most, ids).otherwise(cut)


def chunks(ids: Column, size: int, overlap: int, most: int | None = None) -> Column:
    """Overlapping slices, at least one; a last one that the slice before covers is kept."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    starts = F.sequence(F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0)), F.lit(size - overlap))
    out = F.transform(starts, lambda i: F.slice(ids, i + 1, F.lit(size)))
    return F.slice(out, 1, most) if most else out


#: The coefficients of the n-gram hash.
BASE, STEP, ORDER = 1_000_003, 9_176, 19_260_817


def ngram_buckets(ids: Column, buckets: int, orders: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Distinct buckets, in order, of the n-grams of token ids: one id times BASE plus STEP, or each times BASE + STEP * its place (from 1), plus ORDER times n. Bucket 0 where there is no n-gram.

    Ids below 2^40 can't overflow.
    """

    def bucket(i: Column, n: int) -> Column:
        at = lambda j: F.get(ids, i + j).cast("long")
        if n == 1:
            return F.pmod(at(0) * BASE + STEP, F.lit(buckets).cast("long"))
        h = F.lit(ORDER * n).cast("long")
        for j in range(n):
            h = h + at(j) * (BASE + STEP * (j + 1))
        return F.pmod(h, F.lit(buckets).cast("long"))

    each = [F.when(F.size(ids) >= n, _grams(ids, n, bucket)).otherwise(F.array().cast("array<bigint>")) for n in orders]
    found = F.array_sort(F.array_distinct(F.concat(*each)))
    return F.when(F.size(found) == 0, F.array(F.lit(0).cast("long"))).otherwise(found)


def _grams(ids: Column, n: int, bucket) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(ids) - n, F.lit(0))), lambda i: bucket(i, n))
