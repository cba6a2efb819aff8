"""Cross-entropy difference (Moore and Lewis, ACL 2010) between matched bigram models.

The vocabulary is shared: all words of the whole corpus, and one unknown word. Unigram, context and bigram counts of
all documents (background) and of those marked as target are complete. Both models interpolate alike:
p(w|h) = l * c(h,w)/c(h) + (1-l) * (c(w)+d)/(N+d*V), without the first term where h is unseen. A document is left out
of the counts that score it, so that target documents have no advantage of being known. Its losses are means of -ln p
over its words, and its score is target loss minus background loss: the lower, the more like the target.

Words, contexts and bigrams are keys alike, 64-bit hashes with their kind in the last bits. Counts grow with the
corpus and are never gathered. Each block of documents (an Arrow batch, bounded by bytes) is kept as numbered words
and lists its distinct keys, in buckets by range. The number of buckets grows with the bytes of text, so that a
bucket's lists fit in a task: they are summed there, and each list is answered with the sums of its keys. A key of any
frequency costs its bucket one entry a block. The driver holds three totals only. Lists and numbers travel as
compressed byte planes of differences.

Results on unusual input: documents without words (null, empty) have n_tokens 0 and null losses. Rows that share a
doc_id are scored each; rows without doc_id as well. Without other target documents the target model is uniform. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textscan
from quarry.llm.common import Workspace, give_back, prepare

#: Bytes of text whose keys make one bucket.
BUCKET_BYTES = 12_000_000
#: Bytes of text of a block, about: the larger, the fewer keys are listed.
BLOCK_BYTES = 12 << 20
WORD, CONTEXT, BIGRAM = (np.uint64(k) for k in range(3))
KIND = np.uint64(3)
#: Stands before a document's first word.
START = np.uint64(0x5EED0F0DD)


def _coded(x: np.ndarray) -> bytes:
    """Non-negative 64-bit integers as their number and compressed byte planes."""
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(x).to_bytes(4, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _decoded(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:4], "little")
    planes = pa.decompress(x[4:], 8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8").ravel()


def _ascending(x: np.ndarray) -> bytes:
    return _coded(np.diff(x, prepend=np.uint64(0)))


def _restored(x: bytes) -> np.ndarray:
    return np.cumsum(_decoded(x), dtype=np.uint64)


class Keys:
    """The distinct keys of a block, ascending, from its distinct words, words' numbers and sizes of documents."""

    def __init__(self, vocabulary: np.ndarray, words: np.ndarray, sizes: np.ndarray, buckets: int):
        self.words, width = words.astype(np.int64), len(vocabulary) + 1
        self.row = np.repeat(np.arange(len(sizes)), sizes.astype(np.int64))
        before = np.empty_like(self.words)
        before[1:] = self.words[:-1]
        first = np.append(0, np.cumsum(sizes.astype(np.int64)))[:-1]
        before[first[sizes > 0]] = len(vocabulary)
        self.contexts, self.before = np.unique(before, return_inverse=True)
        pairs, self.pairs = np.unique(before * width + self.words, return_inverse=True)
        left, right = np.divmod(pairs, width)
        hashes = np.append(vocabulary, START)
        context = textscan.mix(hashes + np.uint64(0xC0))
        made = (textscan.mix(vocabulary), context[self.contexts], textscan.mix(context[left] ^ (hashes[right] * np.uint64(0x9E3779B97F4A7C15))))
        keys = np.concatenate([(k & ~KIND) | kind for k, kind in zip(made, (WORD, CONTEXT, BIGRAM), strict=True)])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.cuts = np.searchsorted(((self.keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))
        self.ends = np.cumsum([len(k) for k in made])

    def counts(self, weights: np.ndarray) -> np.ndarray:
        """How often each key occurs, a place counting as its weight."""
        sizes = np.diff(np.append(0, self.ends))
        return np.concatenate([np.bincount(x, weights, n) for x, n in zip((self.words, self.before, self.pairs), sizes, strict=True)])[self.order].astype(np.int64)

    def by_place(self, values: np.ndarray) -> list[np.ndarray]:
        """Values of keys as those of each place's word, context and bigram."""
        plain = np.empty_like(values)
        plain[self.order] = values
        return [x[k] for x, k in zip(np.split(plain, self.ends[:-1]), (self.words, self.before, self.pairs), strict=True)]

    def own(self) -> list[np.ndarray]:
        """How often each place's word, context and bigram occurs in its own document."""
        out = []
        for k in (self.words, self.before, self.pairs):
            _, place, n = np.unique(self.row * (k.max(initial=0) + 1) + k, return_inverse=True, return_counts=True)
            out.append(n[place])
        return out


BLOCKS = "block long, ids binary, known binary, target binary, vocabulary binary, words binary, sizes binary"


def _flags(column) -> np.ndarray:
    return np.asarray(column.fill_null(False).to_numpy(zero_copy_only=False), np.bool_)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _number(batches):
    """A row per block: its documents, its distinct words, and all words' numbers."""
    from pyspark import TaskContext

    schema = pa.schema([("block", pa.int64()), *((x, pa.binary()) for x in ("ids", "known", "target", "vocabulary", "words", "sizes"))])
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids, hashes, sizes = batch.column(2), [], []
        if not len(ids):
            continue
        for _, data, offsets in textscan.slices(ids, batch.column(0)):
            h, _, _, first = textscan.words(data, offsets)
            hashes.append(h)
            sizes.append(np.diff(first))
        vocabulary, words = np.unique(np.concatenate(hashes), return_inverse=True)
        known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), np.uint8)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        yield _table([(block, _coded(ids.view("<u8")), known.tobytes(), _flags(batch.column(1)).tobytes(), _ascending(vocabulary), _coded(words), _coded(np.concatenate(sizes)))], schema)
        block += 1


def _of_block(vocabulary: bytes, words: bytes, sizes: bytes, buckets: int) -> tuple[Keys, np.ndarray]:
    size = _decoded(sizes).astype(np.int64)
    return Keys(_restored(vocabulary), _decoded(words), size, buckets), size


def _list_keys(buckets: int):
    """Rows of each block and bucket: keys and their counts n (all documents) and t (target documents)."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *((x, pa.binary()) for x in ("keys", "n", "t"))])

    def run(batches):
        for batch in batches:
            for block, target, vocabulary, words, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, size = _of_block(vocabulary, words, sizes, buckets)
                n, t = own.counts(np.ones(len(own.words))), own.counts(np.repeat(np.frombuffer(target, np.bool_), size).astype(np.float64))
                parts = [(b, slice(own.cuts[b], own.cuts[b + 1])) for b in np.flatnonzero(np.diff(own.cuts)).tolist()]
                yield _table([(block, b, _ascending(own.keys[x]), _coded(n[x]), _coded(t[x])) for b, x in parts], schema)

    return run


ANSWERS = "block long, bucket int, n binary, t binary, distinct long, total_n long, total_t long"


def _answer():
    """Rows come ordered by bucket. Each list of keys is answered with their sums; the first also tells the bucket's words."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n", pa.binary()), ("t", pa.binary()), *((x, pa.int64()) for x in ("distinct", "total_n", "total_t"))])

    def answers(bucket, lists):
        keys, place = np.unique(np.concatenate([x[1] for x in lists]), return_inverse=True)
        n, t = (np.bincount(place, np.concatenate([x[j] for x in lists]), len(keys)).astype(np.int64) for j in (2, 3))
        word = (keys & KIND) == WORD
        totals = (int(word.sum()), int(n[word].sum()), int(t[word].sum()))
        rows, at = [], 0
        for block, own, *_ in lists:
            some = place[at : at + len(own)]
            rows.append((block, bucket, _coded(n[some]), _coded(t[some]), *(totals if not at else (None,) * 3)))
            at += len(own)
        return _table(rows, schema)

    def run(batches):
        held, lists = None, []
        for batch in batches:
            for block, bucket, keys, n, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != held:
                    if lists:
                        yield answers(held, lists)
                    held, lists = bucket, []
                lists.append((block, _restored(keys), _decoded(n).astype(np.uint32), _decoded(t).astype(np.uint32)))
        if lists:
            yield answers(held, lists)

    return run


def _score(buckets: int, totals: list[int], size: int, weight: float, extra: float):
    """Rows come ordered by (block, bucket): the block's documents, then the sums of its keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("background_loss", pa.float64()), ("target_loss", pa.float64())])

    def row(keys, ids, known, target, sizes, counts):
        own, mean = keys.own(), []
        for values, total, left_out in zip(counts, totals, (np.ones(len(sizes), np.int64), target.astype(np.int64)), strict=True):
            mine = left_out[keys.row]
            word, context, pair = (x - mine * o for x, o in zip(keys.by_place(values), own, strict=True))
            plain = (word + extra) / ((total - left_out * sizes)[keys.row] + extra * size)
            loss = -np.log(np.where(context > 0, weight * pair / np.maximum(context, 1) + (1 - weight) * plain, plain))
            mean.append(np.bincount(keys.row, loss, len(sizes)) / np.maximum(sizes, 1))
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=known == 0), pa.array(sizes), *(pa.array(np.round(x, 9), mask=sizes == 0) for x in mean)], schema=schema)

    def run(batches):
        held, state = None, None
        for batch in batches:
            for block, bucket, n, t, ids, known, target, vocabulary, words, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket < 0:
                    if state:
                        yield row(*state)
                    own, size_ = _of_block(vocabulary, words, sizes, buckets)
                    held, state = block, (own, _decoded(ids).view("<i8"), np.frombuffer(known, np.uint8), np.frombuffer(target, np.bool_), size_, np.zeros((2, len(own.keys)), np.int64))
                else:
                    assert block == held
                    a, b = state[0].cuts[bucket : bucket + 2]
                    state[5][:, a:b] = [_decoded(x) for x in (n, t)]
        if state:
            yield row(*state)

    return run


def cross_entropy_difference(docs: DataFrame, weight: float = 0.7, extra: float = 0.5) -> DataFrame:
    """doc_id, n_tokens, background_loss, target_loss and difference of every row. docs: doc_id, text, is_target."""
    spark = docs.sparkSession
    work = Workspace(spark, "lmscore")
    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("is_target").cast("boolean"), F.lit(False)).alias("is_target"), F.col("doc_id").cast("long").alias("doc_id"))
    buckets = int(max(16, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    prepare(spark, BLOCK_BYTES)  # while blocks are made
    blocks = work.save(rows.mapInArrow(_number, BLOCKS), "blocks")
    prepare(spark)
    listed = blocks.select("block", "target", "vocabulary", "words", "sizes").mapInArrow(_list_keys(buckets), "block long, bucket int, keys binary, n binary, t binary")
    answered = work.save(listed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer(), ANSWERS), "answers")
    give_back(spark)
    distinct, *totals = (x or 0 for x in answered.agg(F.sum("distinct"), F.sum("total_n"), F.sum("total_t")).first())

    own = blocks.select("block", F.lit(-1).alias("bucket"), *(F.lit(None).cast("binary").alias(x) for x in "nt"), *blocks.columns[1:])
    back = answered.select("block", "bucket", "n", "t", *(F.lit(None).cast("binary").alias(x) for x in blocks.columns[1:]))
    met = own.unionByName(back).repartition("block").sortWithinPartitions("block", "bucket")
    done = met.mapInArrow(_score(buckets, totals, distinct + 1, weight, extra), "doc_id long, n_tokens long, background_loss double, target_loss double")
    return done.withColumn("difference", F.round(F.col("target_loss") - F.col("background_loss"), 9))
