"""Secret scans: pattern kinds, then sliding-window Shannon entropy over candidate strings.

Everything is a column expression inside one row, so the plan is a scan and projections.
Null text counts as empty. Positions are code points, ends exclusive. Repeated rows are
scanned one by one; other columns of the input are not read, and the columns made on the way take names
that the table has not got. Texts of any length are scanned whole: work grows as m log m with a text's m
matches, and in proportion to a candidate's length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: The three pattern kinds. Bounded repeats stand where they find the same spans.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LEAST = 12

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


@dataclass(frozen=True)
class CharacterClass:
    """A candidate is of the first class all of whose patterns it has; its best window must reach `bits`."""

    name: str
    patterns: tuple[str, ...]
    window: int
    bits: float


CLASSES = (
    CharacterClass("hexadecimal", ("^[0-9A-Fa-f]+$", "[0-9]", "[A-Fa-f]"), 20, 2.9),
    CharacterClass("digits", ("^[0-9_/+=-]+$",), 20, 3.0),
    CharacterClass("one case", ("^[^A-Z]+$|^[^a-z]+$", "[0-9]"), 20, 3.6),
    CharacterClass("mixed", ("[0-9]",), 20, 3.7),
    CharacterClass("letters", (".",), 20, 4.1),
)
#: Candidates that have one of these patterns are not secrets: UUIDs, paths of plain words, given examples, hyphened words.
#: Repeated groups are possessive: others are matched by recursion, which a long candidate would end with the whole JVM.
ALLOW = (
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "^/?+[A-Za-z]{2,}+(?:/[A-Za-z0-9_.]{2,}+){2,}+/?+$",
    "EXAMPLE|example",
    "^[A-Za-z]++(?:[-_][A-Za-z]++)++$",
)


def _spans(text: Column, pattern: str, kind: str, good) -> Column:
    """Leftmost non-overlapping matches as spans: running lengths of the gaps and matches between them."""
    rank = KINDS.index(kind)
    parts = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")),
    )

    def located(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: p["gap"] + F.coalesce(F.length(p["match"]), F.lit(0)))
        ends = _running(lengths.cast("array<bigint>"), lambda before, own: before + own)
        spans = F.zip_with(
            parts, ends, lambda p, end: F.struct((end - F.length(p["match"])).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), good(p["match"]).alias("good")),
        )
        return F.transform(F.filter(spans, lambda x: x["start"].isNotNull() & x["good"]), lambda x: x.dropFields("good"))

    return F.when(text.rlike(pattern), _bound(parts, located)).otherwise(F.array().cast(SPANS))


def _running(values: Column, combine) -> Column:
    """Each value combined with all before it, by doubling: log2(n) passes over the array, where appending would copy it n times."""
    powers = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1.0)).cast("int")), lambda k: F.pow(F.lit(2.0), k).cast("int"))

    def step(done: Column, k: Column) -> Column:
        wider = F.transform(done, lambda x, i: F.when(i >= k, combine(F.get(done, i - k), x)).otherwise(x))
        return F.when(F.size(done) > k, wider).otherwise(done)

    return F.aggregate(powers, values, step)


def _apart(spans: Column) -> Column:
    """Of spans in order the entropy ones that overlap no other: none before ends after their start, none after starts before their end."""
    base = lambda x, field, other: F.when(x["rank"] < len(KINDS) - 1, x[field]).otherwise(other)
    far = F.lit(1 << 62)
    ends = _running(F.transform(spans, lambda x: base(x, "end", F.lit(-1).cast("bigint"))), F.greatest)
    starts = F.reverse(_running(F.reverse(F.transform(spans, lambda x: base(x, "start", far))), F.least))
    bounds = F.arrays_zip(spans.alias("span"), ends.alias("ends"), starts.alias("starts"))
    free = F.filter(bounds, lambda x: (x["span"]["rank"] == len(KINDS) - 1) & (x["ends"] <= x["span"]["start"]) & (x["starts"] >= x["span"]["end"]))
    return F.transform(free, lambda x: x["span"])


def _weight(count: Column) -> Column:
    """c * log2(c), zero for zero."""
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(candidate: Column, window: int) -> Column:
    """The largest Shannon entropy, in bits a character, of any window of the string.

    The state holds the count of every character in the window and S, the sum of c*log2(c) over the counts:
    the entropy is log2(w) - S/w. One character leaves and one enters; both counts and S change by that alone.
    """
    return _bound(F.split(candidate, ""), lambda chars: _bound(F.array_distinct(chars), lambda kinds: _window_entropy(chars, kinds, window)))


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once: a lambda variable, where a plain column would be computed at each mention."""
    return F.get(F.transform(F.array(value), use), 0)


def _window_entropy(chars: Column, kinds: Column, window: int) -> Column:
    codes = F.transform(chars, lambda c: F.array_position(kinds, c).cast("int") - 1)
    return _bound(codes, lambda codes: _least_sum(chars, codes, kinds, window))


def _least_sum(chars: Column, codes: Column, kinds: Column, window: int) -> Column:
    first = F.slice(codes, 1, window)
    counts = F.transform(F.sequence(F.lit(0), F.size(kinds) - 1), lambda k: F.size(first) - F.size(F.array_remove(first, k)))
    total = F.aggregate(counts, F.lit(0.0), lambda s, n: s + _weight(n))

    def moved(counts: Column, code: Column, by: int) -> Column:
        return F.concat(F.slice(counts, F.lit(1), code), F.array(F.get(counts, code) + by), F.slice(counts, code + 2, F.size(counts)))

    def change(counts: Column, code: Column, by: int) -> Column:
        return _weight(F.get(counts, code) + by) - _weight(F.get(counts, code))

    def step(state: Column, i: Column) -> Column:
        leaves, enters = F.get(codes, i - 1), F.get(codes, i + window - 1)
        without = moved(state["counts"], leaves, -1)

        def entered(without: Column) -> Column:
            now = state["s"] + change(state["counts"], leaves, -1) + change(without, enters, 1)
            return _bound(now, lambda now: F.struct(moved(without, enters, 1).alias("counts"), now.alias("s"), F.least(state["least"], now).alias("least")))

        return F.when(leaves == enters, state).otherwise(_bound(without, entered))

    moves = F.size(codes) - window
    least = F.aggregate(
        F.when(moves > 0, F.sequence(F.lit(1), moves)).otherwise(F.array().cast("array<int>")),
        F.struct(counts.alias("counts"), total.alias("s"), total.alias("least")), step, lambda state: state["least"],
    )
    width = F.least(F.size(codes), F.lit(window)).cast("double")
    return F.log2(width) - least / width


def _is_random(candidate: Column) -> Column:
    verdict = F.lit(False)
    for c in reversed(CLASSES):
        belongs = F.lit(True)
        for p in c.patterns:
            belongs = belongs & candidate.rlike(p)
        verdict = F.when(belongs, window_entropy(candidate, c.window) >= c.bits - 1e-9).otherwise(verdict)
    for p in ALLOW:
        verdict = ~candidate.rlike(p) & verdict
    return verdict


def _named(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def scan(df: DataFrame, text: Column, name: str = "__secrets") -> DataFrame:
    """Adds the struct `name`: n_assign, n_access, n_hex, n_entropy, base_spans, spans (strings) and found (the array)."""
    t, b, e = (free_name(df, f"{name}_{x}") for x in ("text", "base", "more"))
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST
    always = lambda m: F.lit(True)
    df = df.withColumn(t, text)
    df = df.withColumn(
        b, F.concat(
            F.when(F.col(t).rlike("[:=]"), _spans(F.col(t), ASSIGN, "assign", long_enough)).otherwise(F.array().cast(SPANS)),
            _spans(F.col(t), ACCESS, "access", always), _spans(F.col(t), HEX, "hex", always),
        ),
    )
    df = df.withColumn(b, F.array_sort(F.col(b)))
    df = df.withColumn(e, _spans(F.col(t), CANDIDATE, "entropy", _is_random))
    df = df.withColumn(e, F.when(F.size(e) == 0, F.col(e)).when(F.size(b) == 0, F.col(e)).otherwise(_bound(F.array_sort(F.concat(F.col(b), F.col(e))), _apart)))
    df = df.withColumn(e, F.when(F.size(e) > 0, F.array_sort(F.concat(F.col(b), F.col(e)))).otherwise(F.col(b)))
    count = lambda kind: F.size(F.filter(F.col(e), lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.withColumn(
        name, F.struct(*[count(k) for k in KINDS], _named(F.col(b)).alias("base_spans"), _named(F.col(e)).alias("spans"), F.col(e).alias("found")),
    ).drop(t, b, e)
