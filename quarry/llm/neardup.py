"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds its distinct 5-word shingles (A-Z lowered, words between ASCII white space). Its sketch
has `bands * rows` coordinates, filled in rounds (Dahlgaard, Knudsen, Thorup, FOCS 2017): in the first t rounds
each element is hashed to a bin and a value, in the last t rounds round t+i sends all elements to bin i, and a
coordinate keeps the smallest value of the earliest round that reached it. So every coordinate fills, after
about t*ln(t)/n rounds for n elements, and equal coordinates estimate the Jaccard similarity with the
concentration of sampling without replacement.

Documents with equal sets are one class at once. Representatives of classes meet in buckets, one per band.
A bucket never emits its pairs: each member is paired with the bucket's most central one (that meets most others
over all bands, the pivot), and these pairs are verified on full sets. Where buckets then still hold members of
different components, shingles that only one of those members has are counted. Members x and y share at most
min(i_x, i_y) + min(e_x, e_y) elements, with i the elements that a member shares with the pivot and e those
that it shares with others but not with the pivot; that bounds their similarity. Members outside the bucket's
largest component are paired, in the first bucket they share, with members of other components that this bound
allows, and verified too. So no link between two members of one bucket that would join components is missed, and
no bucket, partner or candidate is capped. Keys and buckets that hold a large share of the rows are joined by broadcast
(there can only be few), and the pairs of a large bucket are dealt over tasks.

With bands=42 and rows=6, a pair at the threshold shares no bucket with probability (1-0.85^6)^42 = 2e-9
(0.8: 3e-6).

Results on unusual input: null and empty texts, and texts without words, have the empty set and are linked with
nothing; fewer words than k form one shingle. Rows that share a doc_id are versions of one document, linked if
any version is; its n_shingles is the largest. Rows without doc_id take no part. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textscan
from quarry.llm.common import Workspace, components, give_back, join_counted, let_go, small

FULL = np.uint64(2**64 - 1)
LOW = np.uint64(2**48 - 1)
#: Pairs of one bucket whose bounds a task compares at most, about.
PAIRS_PER_TASK = 1_000_000


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """The t coordinates of a set of distinct 64-bit hashes; the set isn't empty."""
    out = np.full(t, FULL, np.uint64)
    n, at = len(elements), 0
    step = max(1, int(1.7 * t * np.log(t + 1) / n) + 1)
    while at < 2 * t:
        rounds = np.arange(at, min(2 * t, at + step), dtype=np.uint64)[:, None]
        hashed = textscan.mix(elements[None, :] ^ textscan.mix(rounds + np.uint64(0xA5A5)))
        bins = np.where(rounds < t, (hashed >> np.uint64(48)) % np.uint64(t), rounds - np.uint64(t) * (rounds >= t))
        np.minimum.at(out, bins.ravel().astype(np.int64), ((rounds << np.uint64(48)) | (hashed & LOW)).ravel())
        at += step
        if at < 2 * t and not (out == FULL).any():
            break
    return out


def shingle_sets(ids: pa.Array, texts: pa.Array, k: int) -> Iterator[tuple[object, np.ndarray]]:
    """(id, sorted distinct shingle hashes) of each row."""
    for some, data, offsets in textscan.slices(ids, texts):
        h, _, _, first = textscan.words(data, offsets)
        for i, key in enumerate(some.to_pylist()):
            own = h[first[i] : first[i + 1]]
            yield key, np.unique(textscan.shingles(own, k)) if len(own) >= k else textscan.whole(own) if len(own) else own


def _sketches(k: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        import hashlib

        let_go()
        for batch in batches:
            ids, sizes, keys, sketched = [], [], [], []
            for key, own in shingle_sets(batch.column(0), batch.column(1), k):
                ids.append(key)
                sizes.append(len(own))
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                if len(own):
                    sketched.append(sketch(own, bands * rows))
            buckets = np.zeros((len(sketched), bands), np.uint64)
            if sketched:
                parts = np.stack(sketched).reshape(len(sketched), bands, rows)
                for j in range(rows):
                    buckets = textscan.mix(buckets ^ parts[:, :, j]) + np.uint64(j)
            full = np.array([n > 0 for n in sizes])
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum(full * bands, out=offsets[1:])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(buckets.ravel().view(np.int64)))], schema=schema)

    return run


def _compare(k: int, percent: int):
    """Rows come ordered by (a, part, role): first a's own text, then the texts to compare with it."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("common", pa.int64())])

    def run(batches):
        held, sets = None, []
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = ([], [], [], [])
            for (_, own), x, y in zip(shingle_sets(batch.column(0), batch.column(2), k), a, b, strict=True):
                if x != held:
                    held, sets = x, []
                if y is None:
                    sets.append(own)
                    continue
                linked, common = False, 0
                for other in sets:
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    linked |= both > 0 and 100 * both >= percent * (len(own) + len(other) - both)
                    common = max(common, both)
                out[0].append(x)
                out[1].append(y)
                out[2].append(linked)
                out[3].append(common)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int, work: Workspace, name: str, per_task: int = 2000) -> DataFrame:
    """Pairs (a, b) with linked and common, the size of the intersection, from full sets of texts (doc_id, text).

    b's text travels once per pair. a's is sent once to each part of at most about per_task of its pairs, so
    that no document with many partners makes a large task. Texts in no pair are left out before the shuffle
    where the ids are few enough to broadcast.
    """
    parts = work.save(pairs.groupBy("a").agg(F.count("*").alias("n"), F.ceil(F.count("*") / per_task).alias("parts")), f"{name}-parts")
    firsts = parts.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), F.col("a").alias("doc_id"))
    dealt = join_counted(pairs, parts, ["a"], "n").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.col("b").alias("doc_id"))
    wanted = work.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids")
    some = texts.join(small(wanted), "doc_id", "left_semi")
    rows = firsts.unionByName(dealt).join(some, "doc_id").select("a", "b", "text", "part")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    done = rows.select("a", "b", "text").mapInArrow(_compare(k, percent), "a long, b long, linked boolean, common long")
    return work.save(done.groupBy("a", "b").agg(F.max("linked").alias("linked"), F.max("common").alias("common")), name)


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, bands: int = 42, rows: int = 6) -> DataFrame:
    """One row per doc_id: n_shingles, component_id (the smallest doc_id it reaches by links), kept (it is that one).

    Documents are linked when 100 * intersection >= percent * union of their sets.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "neardup")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    sketched = work.save(texts.mapInArrow(_sketches(k, bands, rows), "doc_id long, n long, key binary, bands array<long>"), "sketches")

    keyed = sketched.where("key IS NOT NULL").select("key", "doc_id")
    classes = work.save(keyed.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members")).where("members > 1"), "classes")
    later = work.save(join_counted(keyed, classes, ["key"], "members").where("class_id < doc_id").select("key", "doc_id", "class_id"), "later")
    # by key and id: of a document with several versions only those leave that another document represents
    member = sketched.where("key IS NOT NULL").join(small(later.select("key", "doc_id")), ["key", "doc_id"], "left_anti").select(F.col("doc_id").alias("id"), "n", "key", F.posexplode("bands").alias("band", "bucket"))
    buckets = work.save(member.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    shared = work.save(join_counted(member, buckets, ["band", "bucket"], "size"), "shared")

    centre = shared.groupBy("id").agg(F.sum("size").alias("weight"))
    pivots = shared.join(centre, "id").groupBy("band", "bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("top"), F.count("*").alias("members"))
    pivots = work.save(pivots.select("band", "bucket", (-F.col("top.id")).alias("pivot"), "members"), "pivots")
    tied = work.save(join_counted(shared, pivots, ["band", "bucket"], "members").select("band", "bucket", "id", "n", "key", "pivot"), "tied")
    work.drop("shared")
    pairs = work.save(tied.where("pivot <> id").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "pairs-0")
    done = verify(pairs, texts, k, percent, work, "verified-0")
    links = done.where("linked").select("a", "b").unionByName(later.select(F.col("class_id").alias("a"), F.col("doc_id").alias("b")))
    labels = components(links, work, "cc-0")
    give_back(spark)
    pairs = _open(tied, done, labels, texts, sketched, k, percent, work)
    if pairs.head(1):
        more = verify(pairs, texts, k, percent, work, "verified-1")
        labels = components(more.where("linked").select("a", "b").unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b"))), work, "cc-1")
    give_back(spark)
    by_doc = sketched.groupBy("doc_id").agg(F.max("n").alias("n_shingles"))
    joined = by_doc.join(labels, F.col("doc_id") == F.col("id"), "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _elements(k: int):
    schema = pa.schema([("id", pa.int64()), ("g", pa.int64())])

    def run(batches):
        for batch in batches:
            for key, own in shingle_sets(batch.column(0), batch.column(1), k):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), key, np.int64)), pa.array(own.view(np.int64))], schema=schema)

    return run


def _alone(ids: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """How many shingles of each of these documents no other of them has: (id, alone)."""
    some = texts.join(small(ids), "doc_id", "left_semi")
    elements = some.mapInArrow(_elements(k), "id long, g long")
    single = elements.groupBy("g").agg(F.min("id").alias("id"), F.max("id").alias("last")).where("id = last")
    return single.groupBy("id").agg(F.count("*").alias("alone"))


def _open(tied: DataFrame, done: DataFrame, labels: DataFrame, texts: DataFrame, sketched: DataFrame, k: int, percent: int, work: Workspace) -> DataFrame:
    """Pairs (a, b), a < b, of members of one bucket in different components that can be similar enough, and aren't done.

    Members of a bucket's largest component are paired only with members outside it. What is alone is known for
    an id, so it isn't used for ids with several versions. Components only grow and the bounds stay as they are, so
    that nothing is open any more once these pairs are verified.
    """
    place = ["band", "bucket"]
    labelled = work.save(tied.join(labels, "id", "left").select(*place, "id", "n", "key", "pivot", F.coalesce("component", "id").alias("c")), "labelled")
    sizes = labelled.groupBy(*place, "c").agg(F.count("*").alias("own"))
    largest = sizes.groupBy(*place).agg(F.max(F.struct("own", "c")).alias("top"), F.count("*").alias("kinds"), F.sum("own").alias("members")).where("kinds > 1")
    largest = work.save(largest.select(*place, F.col("top.c").alias("top"), "members"), "largest")
    with_pivot = done.select(F.col("a").alias("pivot"), F.col("b").alias("id"), "common")
    mixed = join_counted(labelled, largest, place, "members").join(with_pivot, ["pivot", "id"], "left").withColumn("common", F.coalesce("common", "n"))
    mixed = work.save(mixed.select(*place, "id", "n", "key", "common", "c", "top", "members"), "mixed")
    work.drop("labelled")
    ids = work.save(mixed.groupBy("id").agg(F.min("key").alias("k"), F.max("key").alias("l")).select(F.col("id").alias("doc_id"), (F.col("k") == F.col("l")).alias("single")), "mixed-ids")
    alone = work.save(_alone(ids.select("doc_id"), texts, k).join(ids.where("single").select(F.col("doc_id").alias("id")), "id", "left_semi"), "alone")
    rows = work.save(mixed.join(alone, "id", "left").withColumn("e", F.greatest(F.col("n") - F.col("common") - F.coalesce("alone", F.lit(0)), F.lit(0))).drop("alone"), "open-rows")
    bounds = work.save(rows.groupBy(*place).agg(F.min("n").alias("min_n"), F.max("common").alias("max_i"), F.max("e").alias("max_e"), F.count("*").alias("size")), "bounds")
    best = F.least("common", "max_i") + F.least("e", "max_e")
    able = join_counted(rows, bounds, place, "size").where(100 * best >= percent * (F.col("n") + F.greatest(F.col("min_n") - best, F.lit(0))))
    able = work.save(able.select(*place, "id", "n", "key", "common", "e", "c", "top"), "able")
    dealt = able.groupBy(*place).agg(F.count("*").alias("size"), F.count(F.when(F.col("c") != F.col("top"), 1)).alias("out")).where("out > 0")
    dealt = work.save(dealt.select(*place, "size", F.ceil(F.col("size") * F.col("out") / PAIRS_PER_TASK).cast("int").alias("parts")), "dealt")
    keys = work.save(able.join(dealt.select(*place), place, "left_semi").select("key").distinct(), "able-keys")
    bands = sketched.where("key IS NOT NULL").join(small(keys), "key", "left_semi").select("key", "bands").dropDuplicates(["key"])
    full = work.save(join_counted(able, dealt, place, "size").drop("size").join(bands, "key").drop("key"), "able-bands")
    # each part of the members outside meets all
    outside = full.where("c <> top").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select(*place, "part", *(F.col(x).alias(f"{x}_x") for x in ("id", "n", "common", "e", "c", "bands")))
    inside = full.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    both = F.least(F.least("common", "common_x") + F.least("e", "e_x"), "n", "n_x")
    meets = (F.col("c") != F.col("c_x")) & ((F.col("c") == F.col("top")) | (F.col("id_x") < F.col("id"))) & (100 * both >= percent * (F.col("n") + F.col("n_x") - both))
    first = F.array_position(F.zip_with("bands", "bands_x", lambda u, v: u == v), True) == F.col("band") + 1
    joined = outside.join(inside, [*place, "part"]).where(meets & first)
    found = joined.select(F.least("id_x", "id").alias("a"), F.greatest("id_x", "id").alias("b")).distinct()
    return work.save(found.join(done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs-1")
