"""SimHash near-dedup: fingerprints, vantage-point shards and trees, and components.

Fingerprint: words are runs without white space after lower-casing A-Z; the hashes (XXH64, seed 42) of
all runs of `shingle` words, repeats included, vote bit by bit. A text with fewer words is one shingle;
one without words, or null, has fingerprint zero and links like any other.

Search: over all 64 bits the distances from any vantage point crowd around 32 and a radius of 4 prunes
little (0.87 of the work stays per level), so the shards are made on bands. Of two fingerprints within
`radius` bits, some one of BANDS bands differs in at most radius // BANDS bits. In each band the
distances to a few vantage points are a fingerprint's rings; by the triangle bound a neighbour's rings
lie within the band's radius, so a fingerprint joins its own shard and each that the bound reaches (none
besides at radius 4). Shards with over SHARD members are divided again by bands of the bits that no band
had so far. A shard that few blocks can hold, or that division leaves with over a third of its members
(very many edited copies of one text), is dealt in blocks by hash, and each pair of blocks is a shard:
a shard holds about SHARD fingerprints at most, and no pair of members is missed. In a shard a
vantage-point tree over all 64 bits finds the exact neighbours, pruned by the same bound.

A shard emits links to the smallest member of each of its groups, which is enough for the components;
no list of pairs is made. Copies meet first: the search is over distinct fingerprints. component_id is
the smallest id in reach (nulls last); rows with equal ids and texts are one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, exact, free_name
from .components import components

SHINGLE = 4
RADIUS = 4
BANDS = 5
RINGS = 6
SHARD = 50_000
LEVELS = 6
BROADCAST_KEYS = 500_000
LEAF = 48
SEED = 42
_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for i in range(0, len(starts), 50_000):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[i : i + 50_000], ends[i : i + 50_000], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        votes += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, th, fp): th tells texts of one id apart; fp holds the 64 bits as a long."""
    rows = docs.select(exact(id_col), F.xxhash64(exact(text_col)), exact(text_col)).toDF("id", "th", "text")
    schema = T.StructType([rows.schema["id"], rows.schema["th"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(2).cast(pa.large_binary()))
            found = np.fromiter((fingerprint(x, shingle) for x in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["id", "th", "fp"])

    return rows.mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bands(level: int) -> list[int]:
    """Masks that part the 64 bits in BANDS bands: runs of bits first, then seeded choices, other ones at each level."""
    bits = list(range(64)) if not level else np.random.default_rng([SEED, level]).permutation(64).tolist()
    return [sum(1 << b for b in bits[64 * i // BANDS : 64 * (i + 1) // BANDS]) for i in range(BANDS)]


def _vantage_points() -> list[int]:
    return np.random.default_rng(SEED).integers(0, 1 << 63, RINGS, dtype=np.int64).tolist()


def _rings(fp: Column, mask: Column, radius: int) -> Column:
    """The rings around the vantage points under a mask, give or take the radius: an array of longs."""
    rings = [F.bit_count(fp.bitwiseXOR(F.lit(v)).bitwiseAND(mask)).cast("long") for v in _vantage_points()]
    codes = F.array(F.lit(0).cast("long"))
    if not radius:
        code = F.lit(0).cast("long")
        for ring in rings:
            code = code * 16 + ring
        return F.array(code)
    for ring in rings:
        near = F.array(*[ring + d for d in range(-radius, radius + 1)])
        codes = _extended(codes, F.filter(near, lambda r: (r >= 0) & (r <= F.bit_count(mask))))
    return codes


def _extended(codes: Column, rings: Column) -> Column:
    return F.flatten(F.transform(codes, lambda c: F.transform(rings, lambda r: c * 16 + r)))


def _divided(level: int, radius: int, count: Column) -> Column:
    """The shards below (key, rest) as structs. rest: the bits of no band so far, in which a neighbour may still differ; above: the members divided."""
    fp, key, rest = F.col("fp"), F.col("key"), F.col("rest")
    parts = []
    for j, band in enumerate(_bands(level)):
        mask = rest.bitwiseAND(F.lit(_signed(band)))
        left = rest.bitwiseAND(F.lit(_signed(~band & (1 << 64) - 1)))
        parts.append(F.transform(_rings(fp, mask, radius // BANDS), lambda code: F.struct(F.xxhash64(key, F.lit(j), code).alias("key"), left.alias("rest"), count.alias("above"))))
    return F.flatten(F.array(*parts))


def _in_blocks(count: Column) -> Column:
    """The pairs of blocks that a member of a shard of `count` is in, as shards of about SHARD members that are divided no more."""
    key = F.col("key")
    n = F.ceil(2 * count / F.lit(SHARD))
    own = F.pmod(F.xxhash64("fp", "key"), n)
    pairs = F.sequence(F.lit(0).cast("long"), n - 1)
    return F.transform(pairs, lambda other: F.struct(F.xxhash64(key, F.least(own, other), F.greatest(own, other), F.lit("blocks")).alias("key"), F.lit(None).cast("long").alias("rest"), count.alias("above")))


def _sharded(nodes: DataFrame, radius: int) -> DataFrame:
    """(key, fp): each fingerprint in every shard that may hold a neighbour; no shard has many more than SHARD members."""
    whole = nodes.select("fp", F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("rest"))
    rows = whole.select("fp", F.inline(_divided(0, radius, F.lit(None).cast("long"))))
    for level in range(1, LEVELS + 1):
        sizes = rows.filter("rest IS NOT NULL").groupBy("key").count()
        large = cut_lineage(sizes.filter(F.col("count") > SHARD))
        n = large.count()
        if not n:
            break
        count = F.col("count")
        close = (count <= BANDS * SHARD // 2) | F.coalesce(3 * count > F.col("above"), F.lit(False)) | F.lit(level == LEVELS)
        parts = F.when(count.isNull(), F.array(F.struct("key", "rest", "above"))).when(close, _in_blocks(count)).otherwise(_divided(level, radius, count))
        rows = rows.join(F.broadcast(large) if n <= BROADCAST_KEYS else large, "key", "left").select("fp", F.inline(parts))
    return rows.select("fp", "key")


class _Groups:
    """Components of the members of one shard, as an array of labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        if not (a != b).any():
            return
        pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for x, y in pairs.tolist():
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        moved = {x: root(x) for x in np.unique(pairs).tolist()}
        change = np.arange(len(self.label))
        change[list(moved)] = list(moved.values())
        self.label = change[self.label]


def _search(fps: np.ndarray, members: np.ndarray, queries: np.ndarray, radius: int, groups: _Groups) -> None:
    """Builds the vantage-point tree of `members` and passes all `queries` down it at once."""
    if not len(queries):
        return
    if len(members) <= LEAF:
        for i in range(0, len(queries), 20_000):
            q = queries[i : i + 20_000]
            near = np.bitwise_count(fps[q][:, None] ^ fps[members]) <= radius
            hit = near.any(axis=1)
            groups.unite(q[hit], members[near[hit].argmax(axis=1)])
            together = near.T.astype(np.float32) @ near.astype(np.float32) > 0
            x, y = np.nonzero(np.triu(together, 1))
            groups.unite(members[x], members[y])
        return
    vantage, rest = members[0], members[1:]
    far = np.bitwise_count(fps[rest] ^ fps[vantage])
    of_queries = np.bitwise_count(fps[queries] ^ fps[vantage]).astype(np.int64)
    hit = of_queries <= radius
    groups.unite(queries[hit], np.full(hit.sum(), vantage))
    cut = int(np.median(far))
    inside = far <= cut
    if inside.all():
        inside = far < cut
        cut -= 1
    if not inside.any():  # all at one distance
        for i in range(0, len(rest), LEAF):
            _search(fps, rest[i : i + LEAF], queries[np.abs(of_queries - int(far[0])) <= radius], radius, groups)
        return
    _search(fps, rest[inside], queries[of_queries <= cut + radius], radius, groups)
    _search(fps, rest[~inside], queries[of_queries > cut - radius], radius, groups)


def shard_links(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest of its group) of distinct fingerprints, without links of a fingerprint to itself."""
    groups = _Groups(len(fps))
    everyone = np.arange(len(fps))
    _search(fps, everyone, everyone, radius, groups)
    roots = fps[groups.label]
    other = fps != roots
    return fps[other], roots[other]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links whose components are those of all pairs within the radius. nodes: distinct fp."""
    sharded = _sharded(nodes, radius).repartition("key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.diff(keys)) + 1
            begin, end = np.r_[0, cuts], np.r_[cuts, len(keys)]
            found = [shard_links(fps[x:y], radius) for x, y in zip(begin, end, strict=True) if y - x > 1]
            if found:
                columns = [pa.array(np.concatenate(side).view(np.int64)) for side in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        held_keys, held = [], []  # the shard that may go on in the next batch
        for batch in batches:
            fps, keys = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("fp", "key"))
            if not len(keys):
                continue
            fps = fps.view(np.uint64)
            last = int(np.searchsorted(keys, keys[-1]))
            if held_keys and held_keys[0][0] == keys[-1]:
                held_keys.append(keys)
                held.append(fps)
                continue
            yield from of(np.concatenate([*held_keys, keys[:last]]), np.concatenate([*held, fps[:last]])) if held or last else ()
            held_keys, held = [keys[last:]], [fps[last:]]
        if held:
            yield from of(np.concatenate(held_keys), np.concatenate(held))

    return sharded.mapInArrow(run, "a bigint, b bigint").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, th, fp, root, component_id) per row; root is the component's smallest fingerprint as a long."""
    rows = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    nodes = rows.groupBy("fp").agg(F.min("id").alias("first"))
    found = components(links(nodes.select("fp"), radius))
    nodes = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    nodes = nodes.join(least, "root").select("fp", "root", "component_id")
    return rows.join(nodes, "fp").select("id", "th", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component, with the columns it came with: that of the smallest id, then text hash."""
    found = groups(docs, id_col, text_col, shingle, radius)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th")).alias("best"))
    h, n, id_, th = (free_name(docs, f"__{x}") for x in ("h", "n", "id", "th"))
    best = best.select(F.col("best.id").alias(id_), F.col("best.th").alias(th))
    rows = docs.withColumn(h, F.xxhash64(exact(text_col))).join(best, exact(id_col).eqNullSafe(F.col(id_)) & (F.col(h) == F.col(th)), "left_semi")
    again = Window.partitionBy(exact(id_col), h).orderBy(h)
    return rows.withColumn(n, F.row_number().over(again)).filter(F.col(n) == 1).drop(n, h)
