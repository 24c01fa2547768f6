"""Secret scan by multipart credential linking. JVM expressions only.

Strong parts are reported wherever they stand: `assign` (a keyword, a separator and a value of six characters or more), `access`
(an access identifier of 20 characters or more) and `hex` (24 hex digits or more). Weak parts (`ident`: a user, account or client name
that is assigned; `blob`: a mixed 32 to 64 character token; `endpoint`: a URL or an IPv4 address) mean nothing alone. They are reported
only where complementary parts start within `scope` code points: an interval join of identifiers, secrets and endpoints within a document,
done as a merge of its parts in order of their starts, once forwards and once backwards, with the last start of each class at hand. Its
work follows the parts and not their pairs, and no row moves.

Edge cases: a null text is an empty one; repeated rows are scanned and returned each for itself; a null id is returned as it is; other
columns are neither read nor returned by scan_secrets and stay, whatever their names, in redact; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import let, unused

#: Kind, class, strong, pattern, shortest value in code points and the group that holds the value.
KINDS = (
    ("assign", "secret", True, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", "identifier", True, r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", "secret", True, r"[0-9a-f]{24,}", 24, 0),
    ("ident", "identifier", False, r"""(?i)\b(user|username|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 3, 2),
    ("blob", "secret", False, r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{32,64}(?![A-Za-z0-9+/])", 32, 0),
    ("endpoint", "endpoint", False, r"""https?://[^\s"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])""", 7, 0),
)
PART = "struct<first:int,kind:int,last:int>"


def matches(text: Column, order: int, pattern: str, least: int, group: int) -> Column:
    """Leftmost non-overlapping matches as (first, kind, last), in code points, last exclusive. U+0001, which no pattern takes, marks them."""
    marked = F.split(F.regexp_replace(F.translate(text, "\x01", "\x02"), pattern, "\x01$0\x01"), "\x01")

    def step(pieces: Column, state: Column, j: Column) -> Column:
        found = F.element_at(pieces, j * 2)
        first = state["at"] + F.char_length(F.element_at(pieces, j * 2 - 1))
        last = first + F.char_length(found)
        value = F.regexp_extract(found, pattern, group) if group else found
        part = F.array(F.struct(first.alias("first"), F.lit(order).alias("kind"), last.alias("last")))
        return F.struct(last.alias("at"), F.when(F.char_length(value) >= least, F.concat(state["out"], part)).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{PART}>").alias("out"))
    many = lambda p: F.aggregate(F.sequence(F.lit(1), F.expr("1") * F.floor((F.size(p) - 1) / 2).cast("int")), start, lambda s, j: step(p, s, j))["out"]
    return let(marked, lambda p: F.when(F.size(p) < 3, F.array().cast(f"array<{PART}>")).otherwise(many(p)))


def joined(parts: Column) -> Column:
    """kind:first:last, by first and then kind."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(parts), lambda p: F.concat_ws(":", F.element_at(names, p["kind"] + 1), p["first"].cast("string"), p["last"].cast("string"))), ",")


CLASSES = ("identifier", "secret", "endpoint")


def _kinds(name: str, strong: bool) -> list[int]:
    return [i for i, k in enumerate(KINDS) if k[1] == name and k[2] >= strong]


def _bit(name: str, strong: bool) -> int:
    return 1 << (2 * CLASSES.index(name) + strong)


def _before(parts: Column, sign: int, scope: int) -> Column:
    """For each part in turn a mask of the classes, of any strength and strong ones, that start within scope before it or with it."""
    keys = [(c, s) for c in CLASSES for s in (False, True)]
    far = F.lit(-(1 << 40))
    start = F.struct(F.array().cast("array<int>").alias("out"), *[far.alias(f"{c}_{s:d}") for c, s in keys])

    def step(state: Column, p: Column) -> Column:
        at = p["first"].cast("long") * sign
        last = {k: F.when(p["kind"].isin(_kinds(*k)), at).otherwise(state[f"{k[0]}_{k[1]:d}"]) for k in keys}
        mask = F.lit(0)
        for k in keys:
            mask = mask + F.when(at - last[k] <= scope, _bit(*k)).otherwise(0)
        return F.struct(F.concat(state["out"], F.array(mask)).alias("out"), *[last[c, s].alias(f"{c}_{s:d}") for c, s in keys])

    return F.aggregate(parts, start, step)["out"]


def linked_parts(parts: Column, scope: int) -> Column:
    """Of sorted parts the weak ones near a strong part of another class, or near parts of both other classes."""

    def near(masks: Column, p: Column) -> Column:
        has = lambda c, s: masks.bitwiseAND(F.lit(_bit(c, s))) > 0
        out = F.lit(False)
        for c in CLASSES:
            a, b = [x for x in CLASSES if x != c]
            weak = [i for i in _kinds(c, False) if not KINDS[i][2]]
            out = out | (p["kind"].isin(weak) & (has(a, True) | has(b, True) | (has(a, False) & has(b, False))))
        return out

    back = F.reverse(_before(F.reverse(parts), -1, scope))
    both = F.zip_with(_before(parts, 1, scope), back, lambda x, y: x.bitwiseOR(y))
    pairs = F.zip_with(parts, both, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    return F.transform(F.filter(pairs, lambda x: near(x["m"], x["p"])), lambda x: x["p"])


def found_parts(text: Column, scope: int) -> Column:
    """(strong, linked): arrays of (first, kind, last)."""
    parts = F.array_sort(F.concat(*[matches(text, i, k[3], k[4], k[5]) for i, k in enumerate(KINDS)]))
    strong = [i for i, k in enumerate(KINDS) if k[2]]
    none = F.array().cast(f"array<{PART}>")
    linked = lambda p: F.when(F.exists(p, lambda x: ~x["kind"].isin(strong)) & (F.size(p) > 1), linked_parts(p, scope)).otherwise(none)
    return let(parts, lambda p: F.struct(F.filter(p, lambda x: x["kind"].isin(strong)).alias("strong"), linked(p).alias("linked")))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of docs: id_col, the columns named in carry, and the arrays `strong` and `linked` of (first, kind, last)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keep = [F.col(f"`{c}`") for c in (id_col, *carry)]
    name = unused(docs, "found")
    return docs.select(*keep, found_parts(text, scope).alias(name)).select(*keep, F.col(name)["strong"].alias("strong"), F.col(name)["linked"].alias("linked"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[REDACTED]", scope: int = 200, length_col: str | None = "n_chars") -> DataFrame:
    """docs with every reported span, overlapping and touching ones together, replaced by mark; length_col becomes the new length.

    All columns and rows stay, in their place: each text is changed within its own row. A null text stays null.
    """
    text = F.col(f"`{text_col}`")

    def step(state: Column, p: Column) -> Column:
        first = F.greatest(p["first"], state["at"])
        piece = F.substring(text, state["at"] + 1, first - state["at"])
        fresh = (p["first"] > state["at"]) | (p["first"] == 0) & (state["at"] == 0)
        return F.struct(F.greatest(p["last"], state["at"]).alias("at"), F.concat(state["out"], piece, F.when(fresh, F.lit(mark)).otherwise("")).alias("out"))

    def clean(found: Column) -> Column:
        spans = F.array_sort(F.concat(found["strong"], found["linked"]))
        done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
        whole = let(done, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
        return F.when((F.size(found["strong"]) > 0) | (F.size(found["linked"]) > 0), whole)

    name = unused(docs, "clean")
    marked = docs.select("*", let(found_parts(F.coalesce(text, F.lit("")), scope), clean).alias(name))
    out = {text_col: F.coalesce(F.col(name), text)}
    if length_col and length_col in docs.columns:
        out[length_col] = F.when(F.col(name).isNull(), F.col(f"`{length_col}`")).otherwise(F.char_length(name)).cast(docs.schema[length_col].dataType)
    return marked.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
