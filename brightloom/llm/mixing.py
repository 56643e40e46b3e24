"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources take turns at the weights in the order of their names by code point, null last. Targets share
`share` times all words by weight; one that reaches `most` times its source's words stops there and the
excess goes to the others by weight. The words are dealt in blocks: Sainte-Laguë's highest quotients
(target / (2 seats + 1)) give each source a whole number of blocks, then each shard of a source its part.
A shard's documents, laid end to end in the order of a seeded hash, are its blocks in a seeded order; the quota is
taken from the front of it, going round again when it exceeds the shard, so each document is taken at most twice in
full and at most one of a shard in part. What a quota has above twice its shard goes on to the source's next shards
that have room.

Null texts and ids are allowed: a null text has size zero. Equal rows are separate documents; which of
them a partial block reaches is unspecified, but they are equal; texts of one id and size differ in the hash.
Texts of any length count whole. The documents' columns may have any names. Only sums per source and per shard are
moved beside (id, source, size); shards hold about `shard_docs` documents, so a source with a third of
all rows is many shards. A source of no words has target zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import exact, free_name, stored, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 50
SHARD_DOCS = 10_000
SEED = 20
SALTS = 64


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds target to (source, source_size), one row per source.

    Sources are capped in the order of cap / weight. Before the k-th, level = (total - caps so far) /
    (weights left); the first k whose own cap / weight reaches that level ends the filling.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    s = sources.withColumn("rank", F.row_number().over(order))
    s = s.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights)))
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything) * share).withColumn("weights", F.sum("weight").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.when(F.col("ratio") >= F.col("level"), F.col("level")))
    first = F.min(F.when(F.col("level").isNotNull(), F.struct("ratio", "rank", "level"))).over(everything)
    s = s.withColumn("first", first)
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("first.level"))).select(
        *sources.columns, "rank", "target"
    )


def apportion(rows: DataFrame, group: list[str], key: list[str], votes: str, seats: Column, out: str) -> DataFrame:
    """Adds `out`, the seats of each row by highest quotients votes / (2 s + 1), within each group.

    A divisor that is surely too large gives every row the seats it certainly has: at most as many are
    left as there are rows. Those go to the highest of the next few quotients, ranked once.
    Ties go to the smaller key.
    """
    w = Window.partitionBy(*group)
    r = rows.withColumn("__seats", seats).withColumn("__n", F.count("*").over(w)).withColumn("__votes", F.sum(votes).over(w))
    fewer = F.greatest(F.col("__seats") - F.col("__n") / 2.0, F.lit(0.0))
    sure = F.when(F.col("__votes") > 0, F.ceil(F.col(votes) * fewer / F.col("__votes") - 0.5)).otherwise(0)
    r = r.withColumn("__sure", F.greatest(sure, F.lit(0)).cast("long"))
    r = r.withColumn("__left", F.col("__seats") - F.sum("__sure").over(w))
    span = F.when(F.col("__votes") > 0, F.ceil(F.col(votes) * F.col("__n") / F.col("__votes")) + 2).otherwise(0).cast("int")
    c = r.filter((F.col(votes) > 0) & (F.col("__left") > 0)).select(*group, *key, votes, "__sure", "__left", F.explode(F.sequence(F.lit(0), span)).alias("__i"))
    quotient = F.col(votes) / (2 * (F.col("__sure") + F.col("__i")) + 1)
    c = c.withColumn("__place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(quotient), *key)))
    c = c.filter("__place <= __left").groupBy(*group, *key).agg(F.count("*").alias("__more"))
    done = r.join(c, [*group, *key], "left")
    return done.withColumn(out, F.col("__sure") + F.coalesce("__more", F.lit(0))).select(*rows.columns, out)


def _whole(text_col: str) -> Column:
    return F.coalesce(exact(text_col), F.lit(""))


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int, *more: Column) -> DataFrame:
    size = F.size(words_of(_whole(text_col))).cast("long")
    h = F.xxhash64(F.lit(seed), exact(id_col), exact(text_col))
    rows = docs.select(exact(id_col).alias("doc_id"), exact(source_col).alias("source"), size.alias("size"), h.alias("h"), *more)
    rows = rows.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    return rows.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int"))


def _placed(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds the source's row and the shard; the join is salted, since one source may hold a third of all rows."""
    salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, ["name", "salt"]).withColumn("shard", F.pmod(F.col("h"), F.col("n_shards")))


def _plan(sized: DataFrame, weights: tuple[int, ...], block_words: int, shard_docs: int) -> tuple[DataFrame, DataFrame]:
    """One row per source and one per shard, with the words that each shard gives."""
    sources = sized.groupBy("source", "name").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = with_targets(sources, weights)
    total = F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")
    targets = targets.withColumn("all", F.lit(0)).withColumn("blocks", total)
    targets = apportion(targets, ["all"], ["rank"], "target", F.col("blocks"), "quota")
    n_shards = F.ceil(F.col("n_docs") / shard_docs).cast("long")
    targets = stored(targets.select("name", "source_size", "target", "quota", n_shards.alias("n_shards")))
    shards = _placed(sized, targets).groupBy("name", "shard", "quota").agg(F.sum("size").alias("shard_size"))
    shards = apportion(shards, ["name"], ["shard"], "shard_size", F.col("quota"), "shard_quota")
    return targets, stored(_passed_on(shards, block_words).select("name", "shard", "shard_size", "words"))


def _passed_on(shards: DataFrame, block_words: int) -> DataFrame:
    """Adds words: a shard's quota up to MOST times its size; what is above goes to the source's shards with room, in their order."""
    source, before = Window.partitionBy("name"), Window.partitionBy("name").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    most = F.lit(MOST) * F.col("shard_size")
    s = shards.withColumn("given", F.least(F.col("shard_quota") * block_words, most)).withColumn("room", most - F.col("given"))
    s = s.withColumn("above", F.sum(F.col("shard_quota") * block_words - F.col("given")).over(source))
    more = F.least(F.col("room"), F.greatest(F.lit(0), F.col("above") - F.coalesce(F.sum("room").over(before), F.lit(0))))
    return s.withColumn("words", (F.col("given") + more).cast("long"))


def _taken(sized: DataFrame, targets: DataFrame, shards: DataFrame) -> DataFrame:
    """Adds rounds (full passes) and part (words of one more, from the front of the text)."""
    rows = _placed(sized, targets).join(shards, ["name", "shard"])
    order = Window.partitionBy("name", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("rounds", F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0))
    rest = F.col("words") - F.col("rounds") * F.col("shard_size") - F.coalesce(F.sum("size").over(order), F.lit(0))
    return rows.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), rest)))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row."""
    sized = stored(_sized(docs, id_col, source_col, text_col, seed))
    rows = _taken(sized, *_plan(sized, weights, block_words, shard_docs))
    taken = F.col("rounds") * F.col("size") + F.col("part")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """The mix itself: the documents' columns, one row per pass over a document, with its pass (1, 2) and taken words, as mix_pass and mix_words or such with underscores behind.

    The one document of a shard that its quota ends in gives its first words, joined by single spaces.
    """
    compact = stored(_sized(docs, id_col, source_col, text_col, seed))
    plan = _plan(compact, weights, block_words, shard_docs)
    whole = F.struct(*[exact(c) for c in docs.columns]).alias("row")
    rows = _taken(_sized(docs, id_col, source_col, text_col, seed, whole), *plan)
    passes = F.filter(
        F.transform(F.sequence(F.lit(1), F.lit(MOST)), lambda p: F.struct(p.alias("pass"), F.when(p <= F.col("rounds"), F.col("size")).when(p == F.col("rounds") + 1, F.col("part")).otherwise(0).cast("long").alias("taken"))),
        lambda x: x["taken"] > 0,
    )
    rows = rows.select("row", "size", F.explode(passes).alias("p"))
    own = F.col("row")[text_col]
    front = F.array_join(F.slice(words_of(F.coalesce(own, F.lit(""))), F.lit(1), F.col("p.taken").cast("int")), " ")
    text = F.when(F.col("p.taken") < F.col("size"), front).otherwise(own)
    return rows.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns], F.col("p.pass").alias(free_name(docs, "mix_pass")), F.col("p.taken").alias(free_name(docs, "mix_words")))
