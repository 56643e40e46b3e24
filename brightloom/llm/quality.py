"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Every metric is computed from the whole text inside its own row, so the plan is one scan with
no shuffle. Null texts count as empty and fail the base rule. Repeated rows are judged one by one.
Texts of any length are judged whole. Columns of the input other than the text are never read by the operator,
and those made on the way take names that the table has not got, so clashing names are harmless.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, WORD_CHAR_RE, exact, filtered, free_name, words_of

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "on", "be", "by", "this", "are", "from",
    "le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "dans", "pour", "pas", "sur", "avec",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "nicht", "ein", "eine", "auch", "sich", "dem",
    "el", "los", "las", "y", "del", "se", "por", "con", "para", "una", "su", "lo", "como", "al",
)

STOP_FORMS = tuple(sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())}))
SYMBOLS = "#*$%&|<>"
#: Over so many different repeated windows, membership goes by sorting, not by search in the list.
MANY_WINDOWS = 64


@dataclass(frozen=True)
class Rule:
    """A document passes if least <= metric <= most; an open end is None."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: The metrics are SQL over the counts that `with_counts` makes.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 20.0),
    Rule("symbol_ratio", "n_symbols / n_words", None, 0.25),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.02, None),
    Rule("dup_line_ratio", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines / greatest(n_lines, 1)", None, 0.5),
    Rule("bullet_line_ratio", "n_bullet_lines / greatest(n_lines, 1)", None, 0.9),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_ellipsis_lines", "n_bullet_lines")


def _any_of(text: Column, chars: str) -> Column:
    found = F.lit(False)
    for c in chars:
        found = found | F.contains(text, F.lit(c))
    return found


def _covered(positions: Column) -> Column:
    """Words covered by three-word windows that start at the given ascending positions."""
    steps = F.transform(positions, lambda x, j: F.when(j == 0, 3).otherwise(F.least(F.lit(3), x - F.get(positions, j - 1))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def with_counts(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds the struct column `name` with COUNTS, all long."""
    t, ws, hs, keys, again, ps, at, ls = own = [free_name(df, f"{name}_{x}") for x in ("text", "words", "hashes", "keys", "again", "pairs", "at", "lines")]
    df = df.withColumn(t, text)
    df = df.withColumn(ws, words_of(F.col(t))).withColumn(
        ls, F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(WORD_CHAR_RE))
    )
    df = df.withColumn(hs, F.transform(F.col(ws), lambda w: F.xxhash64(w)))
    windows = F.transform(F.col(hs), lambda h, i: F.xxhash64(h, F.get(F.col(hs), i + 1), F.get(F.col(hs), i + 2)))
    df = df.withColumn(keys, F.slice(windows, F.lit(1), F.greatest(F.size(hs) - 2, F.lit(0))))
    none = F.array().cast("array<bigint>")
    df = df.withColumn(again, F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.sort_array(F.col(keys))).otherwise(none))
    df = df.withColumn(again, F.array_distinct(F.filter(F.col(again), lambda k, i: (i > 0) & (k == F.get(F.col(again), i - 1)))))
    few = F.array_compact(F.transform(F.col(keys), lambda k, i: F.when(F.array_contains(F.col(again), k), i)))
    many = F.size(again) > MANY_WINDOWS
    df = df.withColumn(ps, F.when(many, F.sort_array(F.transform(F.col(keys), lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    df = df.withColumn(
        at, F.when(F.size(again) == 0, F.array().cast("array<int>")).when(F.size(again) <= MANY_WINDOWS, few).otherwise(
            F.sort_array(F.transform(_same_as_neighbour(F.col(ps)), lambda x: x["i"]))
        ),
    )
    words, lines, whole = F.col(ws), F.col(ls), F.col(t)
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(whole, F.lit(f"[{SYMBOLS}]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _covered(F.col(at)),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(*STOP_FORMS))),
        "n_lines": F.size(lines),
        "n_ellipsis_lines": F.when(F.contains(whole, F.lit("...")) | F.contains(whole, F.lit("…")), F.size(F.filter(lines, lambda x: x.rlike(f"(\\.\\.\\.|…){SPACE_RE}*$")))).otherwise(0),
        "n_bullet_lines": F.when(_any_of(whole, "-*•●‣"), F.size(F.filter(lines, lambda x: x.rlike(f"^{SPACE_RE}*[-*•●‣]{SPACE_RE}")))).otherwise(0),
    }
    df = df.withColumn(name, F.struct(*[counts[k].cast("long").alias(k) for k in COUNTS]))
    return df.drop(*own)


def _same_as_neighbour(pairs: Column) -> Column:
    before = lambda i: F.get(pairs, i - 1)["k"]
    after = lambda i: F.get(pairs, i + 1)["k"]
    return F.filter(pairs, lambda x, i: F.coalesce((i > 0) & (before(i) == x["k"]), F.lit(False)) | F.coalesce(after(i) == x["k"], F.lit(False)))


def base_failed(name: str) -> Column:
    c = F.col(name)
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def failed_rules(name: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row breaks, in the table's order; a metric that is null breaks none."""
    found = []
    for rule in rules:
        metric = F.expr(_qualified(rule.metric, name))
        broken = F.lit(False)
        if rule.least is not None:
            broken = broken | (metric < F.lit(float(rule.least)))
        if rule.most is not None:
            broken = broken | (metric > F.lit(float(rule.most)))
        found.append(F.when(F.coalesce(broken, F.lit(False)), F.lit(rule.name)))
    return F.array_compact(F.array(*found))


def _qualified(metric: str, name: str) -> str:
    import re

    sql = re.sub(r"\b(" + "|".join(COUNTS) + r")\b", rf"`{name}`.\1", metric)
    return re.sub(r"/ (`[^`]+`\.\w+)", r"/ nullif(\1, 0)", sql)


def judge(df: DataFrame, text: Column, name: str = "__quality", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the struct `name`: the counts, base_failed, failed (rule names) and kept."""
    df = with_counts(df, text, name)
    failed = free_name(df, f"{name}_failed")
    return df.withColumn(failed, failed_rules(name, rules)).withColumn(
        name,
        F.struct(
            f"{name}.*",
            base_failed(name).alias("base_failed"),
            F.col(failed).alias("failed"),
            (~base_failed(name) & (F.size(failed) == 0)).alias("kept"),
        ),
    ).drop(failed)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows that pass, with the columns they came with."""
    name = free_name(docs, "__quality")
    return filtered(judge(docs, F.coalesce(exact(text_col), F.lit("")), name, rules), F.col(f"{name}.kept")).drop(name)
