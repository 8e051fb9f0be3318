"""b-bit MinHash near-duplicate groups (operator 3).

Texts with equal shingle sets form a class.  A class keeps the low ``BITS``
bits of each of its minima, packed, and one key per band of minima.  Classes
that share a band key are candidates:

1. In each bucket all members are held against the most widely shared member
   (the one whose buckets are largest together), which is the common original
   where there is one.
2. Where a bucket still spans several components, its members outside the
   pivot's component are compared with the others by packed bits, block by
   block; nothing is left out, however large the bucket.  Members of such
   buckets get a second signature of ``FINE`` minima from their full sets, so
   that unlinked members of a group (copies of one original that differ from
   each other) are told apart here and not by reading their sets.

In both, pairs whose collision-corrected similarity can't reach the limit go
(``KEEP_SIGMAS`` standard errors below it), in the second also those that the
known distances to the pivot rule out; the rest are confirmed on the full
shingle sets.  Confirmed links give components.

With 42 bands of 6 minima a pair of similarity 0.85 misses all bands with
probability 2e-9, one of similarity 0.8 with 3e-6.

Defined cases: a null or empty text, or one without words, has no shingles,
is linked with nothing and is kept; fewer words than a shingle make one
shingle; a null doc_id counts as larger than all others; repeated rows get the
same result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, LongType

from benchtide.llm.common import mix, release, stage, text_of, unstage
from benchtide.llm.components import components

SHINGLE = 5
BANDS, ROWS = 42, 6
HASHES = BANDS * ROWS
BITS = 4
# minima of the second signature, of members of buckets that stay open
FINE = 1024
SIMILARITY = 85  # per cent, where the caller gives no other limit
KEEP_SIGMAS = 4.5
# members of a bucket that one task compares with as many others
BLOCK = 1024
NO_ID = (1 << 63) - 1

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a whole text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    inside = ~blank
    starts = np.flatnonzero(inside & np.concatenate([[True], blank[:-1]]))
    if not len(starts):
        return np.empty(0, np.uint64)
    marks = np.zeros(len(raw), np.int64)
    marks[starts] = starts
    rank = np.arange(len(raw)) - np.maximum.accumulate(marks)
    powers = np.cumprod(np.full(int(rank.max()) + 1, _STEP, np.uint64))
    values = mix((raw.astype(np.uint64) + np.uint64(1)) * _BASE)
    words = mix(np.add.reduceat(np.where(inside, values * powers[rank], np.uint64(0)), starts))
    if len(words) < SHINGLE:
        h = np.array([len(words)], np.uint64)
        for w in words:
            h = mix(h * _BASE + w)
        return h
    n = len(words) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * _BASE + words[k:k + n]
    return np.unique(mix(h))


@lru_cache(2)
def _family(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return (rng.integers(1, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, hashes, np.uint64))


def minima(values: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    a, b = _family(hashes)
    low = np.full(hashes, np.iinfo(np.uint64).max)
    for i in range(0, len(values), 256):
        low = np.minimum(low, (values[i:i + 256, None] * a + b).min(axis=0))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for r in range(ROWS):
        h = mix(h * _BASE + low[r::ROWS])
    return h.view(np.int64)


def packed_bits(low: np.ndarray) -> bytes:
    """The low bits of the mixed minima: first all first bits, then the others."""
    kept = mix(low)
    planes = [np.packbits(((kept >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little")
              for b in range(BITS)]
    width = -(-len(low) // 64) * 8
    return b"".join(p.tobytes().ljust(width, b"\0") for p in planes)


def agreeing(a: np.ndarray, b: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Minima whose kept bits agree; a, b: (..., BITS * words) uint64 rows."""
    differ = a ^ b
    words = differ.shape[-1] // BITS
    some = differ[..., :words]
    for k in range(1, BITS):
        some = some | differ[..., k * words:(k + 1) * words]
    return hashes - np.bitwise_count(some).sum(axis=-1, dtype=np.int64)


def least_agreeing(similarity: int = SIMILARITY, hashes: int = HASHES) -> int:
    """Agreeing minima that a pair at the limit has, less the sampling error."""
    chance = 2.0 ** -BITS
    p = chance + (1 - chance) * similarity / 100
    return int(np.floor(hashes * p - KEEP_SIGMAS * np.sqrt(hashes * p * (1 - p))))


def estimated_similarity(agree: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity from a count of agreeing minima."""
    chance = 2.0 ** -BITS
    return (agree / HASHES - chance) / (1 - chance)


_SIGNATURE = pa.struct([("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
                        ("bands", pa.list_(pa.int64())), ("bits", pa.binary())])


def _digest(values: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(values.tobytes(), digest_size=16).digest(), np.int64)


@F.arrow_udf(from_arrow_type(_SIGNATURE))
def signature(texts: pa.Array) -> pa.Array:
    """Set size, set digest, band keys and packed bits per text."""
    out, known = [], {}
    for t in texts:
        values = shingle_set(t.as_py())
        d1, d2 = (int(x) for x in _digest(values))
        if (d1, d2) not in known:
            if len(values):
                low = minima(values)
                known[d1, d2] = (band_keys(low), packed_bits(low))
            else:
                known[d1, d2] = (np.empty(0, np.int64), b"")
        bands, bits = known[d1, d2]
        out.append({"n_shingles": len(values), "d1": d1, "d2": d2, "bands": bands, "bits": bits})
    return pa.array(out, _SIGNATURE)


@F.arrow_udf(from_arrow_type(pa.struct([("d1", pa.int64()), ("d2", pa.int64())])))
def signature_digest(texts: pa.Array) -> pa.Array:
    """Digest of the shingle set per text, as in ``signature``."""
    got = np.array([_digest(shingle_set(t.as_py())) for t in texts], np.int64).reshape(-1, 2)
    return pa.StructArray.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["d1", "d2"])


@F.arrow_udf(ArrayType(LongType()))
def shingles(texts: pa.Array) -> pa.Array:
    return pa.array([shingle_set(t.as_py()).view(np.int64) for t in texts], pa.list_(pa.int64()))


@F.arrow_udf(BinaryType())
def fine_bits(sets: pa.Array) -> pa.Array:
    """Packed bits of ``FINE`` minima per set."""
    return pa.array([packed_bits(minima(s.values.to_numpy(zero_copy_only=False).view(np.uint64), FINE))
                     for s in sets], pa.binary())


def may_link(similarity: int):
    """Whether two classes' packed bits allow the wanted similarity."""
    least = least_agreeing(similarity)

    @F.arrow_udf(from_arrow_type(pa.bool_()))
    def allowed(a: pa.Array, b: pa.Array) -> pa.Array:
        def rows(x):
            return np.frombuffer(b"".join(x.to_pylist()), np.uint64).reshape(len(x), -1)
        return pa.array(agreeing(rows(a), rows(b)) >= least) if len(a) else pa.array([], pa.bool_())

    return allowed


_PAIRS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
# a distance to the pivot that isn't known
UNKNOWN = -1.0


def block_pairs(similarity: int):
    """Pairs of one block of a bucket that may link and aren't connected yet.
    Both sides are lists of (cid, root, out, far, bits, bands, fine).  A pair is left
    to the first bucket it shares; and as Jaccard distance is a metric, a pair
    whose distances to the pivot differ by more than the limit can't link."""
    least, limit = least_agreeing(similarity), 1 - similarity / 100 + 1e-9
    least_fine = least_agreeing(similarity, FINE)

    @F.arrow_udf(from_arrow_type(_PAIRS))
    def pairs_of(bucket: pa.Array, left: pa.Array, right: pa.Array) -> pa.Array:
        def unpack(x):
            own = x.values
            bits, fine = (np.frombuffer(b"".join(own.field(k).to_pylist()), np.uint64).reshape(len(own), -1)
                          for k in ("bits", "fine"))
            bands = own.field("bands").flatten().to_numpy().reshape(len(own), BANDS)
            return (*(own.field(k).to_numpy(zero_copy_only=False) for k in ("cid", "root", "out", "far")),
                    bits, bands, fine)

        out = []
        for h, a, b in zip(bucket.to_pylist(), left, right):
            pairs = []
            ids, roots, _, far, bits, bands, fine = unpack(a)
            ids2, roots2, out2, far2, bits2, bands2, fine2 = unpack(b)
            for k in range(len(ids)):
                may = (roots2 != roots[k]) & (~out2 | (ids2 > ids[k]))
                if far[k] != UNKNOWN:
                    may &= (far2 == UNKNOWN) | (np.abs(far2 - far[k]) <= limit)
                near = np.flatnonzero(may)
                near = near[agreeing(bits2[near], bits[k]) >= least]
                common = bands2[near] == bands[k]
                near = near[bands[k][common.argmax(axis=1)] == h] if len(near) else near
                near = near[agreeing(fine2[near], fine[k], FINE) >= least_fine]
                pairs += [{"a": min(i, ids[k]), "b": max(i, ids[k])} for i in ids2[near]]
            out.append(pairs)
        return pa.array(out, _PAIRS)

    return pairs_of


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of their sets' intersection and union."""
    a, b = (sets.select(F.col("cid").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return (pairs.join(a, "a").join(b, "b")
            .select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b") - both).alias("either")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    similarity: int = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, a hash of
    the text (_th) and a number of its group (_root, null without words).
    Texts of at least ``similarity`` per cent are linked."""
    spark = docs.sparkSession
    linked = f"100 * both >= {similarity} * either"
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    signed = stage(texts.select("doc_id", F.xxhash64("text").alias("_th"), signature("text").alias("s"))
                   .select("doc_id", "_th", "s.*"), "near-signed")
    some = signed.where("n_shingles > 0")
    order = F.coalesce("doc_id", F.lit(NO_ID))
    first = some.groupBy("d1", "d2").agg(F.min(order).alias("id"))
    classes = stage(
        some.withColumn("id", order).join(first, ["id", "d1", "d2"], "left_semi")
        .dropDuplicates(["d1", "d2"]).select("d1", "d2", "id", "bands", "bits")
        .withColumn("cid", F.monotonically_increasing_id()), "near-classes")

    # buckets with several members
    rows = classes.select("cid", F.explode("bands").alias("h"))
    shared = rows.groupBy("h").agg(F.count("*").alias("members")).where("members > 1")
    rows = stage(rows.join(shared, "h"), "near-buckets")
    release(spark)
    spread = rows.groupBy("cid").agg(F.sum("members").alias("spread"))
    ranked = rows.join(spread, "cid")
    pivots = ranked.groupBy("h").agg(F.max(F.struct("spread", (-F.col("cid")).alias("minus"))).alias("p")).select(
        "h", (-F.col("p.minus")).alias("pivot"))
    bits = classes.select("cid", "bits")
    stars = (rows.join(pivots, "h").where("cid <> pivot")
             .select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct())
    stars = (stars.join(bits.select(F.col("cid").alias("a"), F.col("bits").alias("x")), "a")
             .join(bits.select(F.col("cid").alias("b"), F.col("bits").alias("y")), "b")
             .where(may_link(similarity)("x", "y")).select("a", "b"))

    # full sets of the classes in such buckets
    wanted = classes.join(spread, "cid", "left_semi").select("id", "d1", "d2", "cid")
    found = (texts.withColumn("id", order).join(wanted.select("id").distinct(), "id", "left_semi")
             .select("id", F.col("text"), signature_digest("text").alias("d")))
    sets = stage(found.join(wanted.withColumnsRenamed({"d1": "e1", "d2": "e2"}), "id")
                 .where("d.d1 = e1 and d.d2 = e2").dropDuplicates(["cid"])
                 .select("cid", shingles("text").alias("set")), "near-sets")
    release(spark)
    stars = stage(_compared(stars, sets), "near-stars")
    links = stars.where(linked).select("a", "b")
    roots = components(links)
    rooted = rows.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select(
        "h", "cid", "members", F.coalesce("root", "cid").alias("root"))

    # buckets that still span several components
    open_ = (rooted.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                     F.max("members").alias("members"))
             .where("lo <> hi and members > 2").select("h"))
    pivot_root = pivots.join(roots.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root")),
                             "pivot", "left").select("h", "pivot", F.coalesce("pivot_root", "pivot").alias("pivot_root"))
    far = stars.select("a", "b", (1 - F.col("both") / F.col("either")).alias("far"))
    inside = rooted.join(open_, "h", "left_semi")
    fine = stage(sets.join(inside.select("cid").distinct(), "cid", "left_semi")
                 .select("cid", fine_bits("set").alias("fine")), "near-fine")
    members = (inside.join(pivot_root, "h").where("cid <> pivot")
               .withColumns({"a": F.least("cid", "pivot"), "b": F.greatest("cid", "pivot")})
               .join(far, ["a", "b"], "left").join(classes.select("cid", "bits", "bands"), "cid").join(fine, "cid")
               .withColumn("parts", F.ceil(F.col("members") / BLOCK).cast("int"))
               .withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
               .withColumn("entry", F.struct("cid", "root", (F.col("root") != F.col("pivot_root")).alias("out"),
                                             F.coalesce("far", F.lit(UNKNOWN)).alias("far"), "bits", "bands", "fine")))
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = members.where("entry.out").select("h", F.col("own").alias("l"), others.alias("r"),
                                             F.col("entry").alias("x"), F.lit(None).alias("y"))
    right = members.select("h", others.alias("l"), F.col("own").alias("r"), F.lit(None).alias("x"),
                           F.col("entry").alias("y"))
    grouped = left.unionByName(right).groupBy("h", "l", "r").agg(
        F.collect_list("x").alias("x"), F.collect_list("y").alias("y"))
    more = (grouped.where("size(x) > 0 and size(y) > 0")
            .select(F.explode(block_pairs(similarity)("h", "x", "y")).alias("p")).select("p.*").distinct())
    extra = stage(_compared(more, sets).where(linked).select("a", "b"), "near-links")
    if not extra.isEmpty():
        roots = components(links.union(extra))
    unstage(sets)
    release(spark)
    owner = classes.select("d1", "d2", "cid", "id").join(
        roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = owner.groupBy("root").agg(F.min("id").alias("component"))
    by_class = owner.join(smallest, "root").select("d1", "d2", "component", F.col("root").alias("_root"))
    out = signed.select("doc_id", "_th", "n_shingles", "d1", "d2").join(by_class, ["d1", "d2"], "left")
    component = F.when(F.col("component").isNull(), F.col("doc_id")).when(
        F.col("component") != NO_ID, F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), "_th", "_root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         similarity: int = SIMILARITY) -> DataFrame:
    """One document of each group, the one of the smallest id (and hash, if it
    is there twice), columns unchanged; all documents without words stay."""
    groups = near_duplicates(docs, id_col, text_col, similarity)
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID))
    first = (groups.where("kept and _root is not null").groupBy("_root")
             .agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "_th")).alias("k"))
             .select(F.col("k.id").alias("_id"), F.col("k._th").alias("_th")))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_id"),
                       F.xxhash64(text_of(text_col)).alias("_th"),
                       text_of(text_col).rlike(r"[^\x20\x09-\x0D]").alias("_some"))
    chosen = rows.where("_some").join(first, ["_id", "_th"]).dropDuplicates(["_id", "_th"])
    return chosen.select("_row.*").unionByName(rows.where("not _some").select("_row.*"))
