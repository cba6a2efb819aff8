"""Benchmark decontamination: rare n-gram seeds join passages to test items, and Smith-Waterman alignment scores them.

Test items come in blocks of a bounded size (`block_bytes` of text), each held by every worker. Documents are
scanned twice a block: to count the seeds, and to join. A passage's score is the best local alignment's share of a
full match (match 2, mismatch and gap -1). An alignment with M matches that reaches `least` of an item of m words has
at most 2M - 2*least*m errors, so at least least*m - 1 of its neighbouring matches have one error or none between them:
their words are one or two places apart in item and passage, whatever was replaced, put in or left out. So the seeds
are an item's pairs of words one or two places apart (single words where least*m is 1 or less), and an alignment
has so many of the item's places at least. The most frequent places, as counted in all documents, are left out, one
fewer than an alignment has: it holds at least one of the others, the rare ones, and only these join. Around a rare
seed a passage is aligned if so many places within the longest span of an alignment have any seed, and the sums of its
words' best contributions can reach `least`. All are bounds: no passage that scores `least` is missed, however dense
its edits are. (Longer n-grams would miss dense edits.)

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lowered.

Results on unusual input: null and empty texts and items match nothing, as do rows without doc_id or item_id.
Rows that share a doc_id are versions of one document; an item_id that occurs several times stands for several
texts, and the best score counts. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textscan
from quarry.llm.common import Workspace, let_go, small

MATCH, MISS, GAP = 2, -1, -1
#: Places with seeds that are held at once, unless one document has more.
HITS = 2_000_000


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first.astype(np.int64) << 32 | second


class Items:
    """A block of test items: word numbers, their seeds, and the rare seeds with their items."""

    def __init__(self, rows: list[tuple[int, str]], least: float):
        self.ids, hashes = [], []
        for key, text in rows:
            data = np.frombuffer(text.encode(), np.uint8)
            h, *_ = textscan.words(data, np.array([0, len(data)]), textscan.MARKS)
            if len(h):
                self.ids.append(key)
                hashes.append(h)
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.words = [np.searchsorted(self.vocabulary, h).astype(np.int32) for h in hashes]
        size = np.array([len(w) for w in self.words], np.int64)
        share = least * size
        self.single = share <= 1
        #: Places with a seed that an alignment has at least, and words of a passage it spans at most.
        self.need = np.where(self.single, 1, np.maximum(1, np.ceil(share - 1 - 1e-9))).astype(np.int64)
        self.span = np.ceil(3 * size - 2 * share).astype(np.int64) + 1
        own = [np.unique(np.concatenate(self._places(i))) for i in range(len(self.words))]
        self.seeds = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
        #: Numbers of each item's seeds; of the rare ones, what items have seed k is of[at[k]:at[k + 1]].
        self.own = [np.searchsorted(self.seeds, x) for x in own]
        self.of, self.at = np.zeros(0, np.int64), np.zeros(len(self.seeds) + 1, np.int64)

    def _places(self, i: int) -> list[np.ndarray]:
        """Seeds of the item's places: single words, or the pairs one and two places apart that begin there."""
        w = self.words[i]
        return [-1 - w.astype(np.int64)] if self.single[i] else [_pair(w[:-d], w[d:]) for d in (1, 2)]

    def choose(self, counts: np.ndarray) -> None:
        """The rare seeds, from how often each seed occurs in all documents. Seeds that occur nowhere join nothing."""
        seeds, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, w in enumerate(self.words):
            parts = self._places(i)
            often = np.zeros(len(w), np.int64)
            for part in parts:
                often[: len(part)] += counts[np.searchsorted(self.seeds, part)]
            kept = np.argsort(often, kind="stable")[: len(w) - int(self.need[i]) + 1]
            own = np.unique(np.searchsorted(self.seeds, np.concatenate([part[kept[kept < len(part)]] for part in parts])))
            own = own[counts[own] > 0]
            seeds.append(own)
            items.append(np.full(len(own), i))
        every, of = np.concatenate(seeds), np.concatenate(items)
        self.of = of[np.argsort(every, kind="stable")]
        self.at = np.searchsorted(np.sort(every), np.arange(len(self.seeds) + 1))


def _hits(number: np.ndarray, row: np.ndarray, seeds: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(place, seed) of all seeds in the rows, ascending by place. number: the words, -1 if in no item."""
    places, found = [], []
    for d in (0, 1, 2):
        n = max(0, len(number) - d)
        some = np.flatnonzero((number[:n] >= 0) & (number[d:] >= 0) & (row[:n] == row[d:]))
        key = _pair(number[some], number[some + d]) if d else -1 - number[some].astype(np.int64)
        known = pc.fill_null(pc.index_in(pa.array(key), value_set=seeds), -1).to_numpy(zero_copy_only=False)
        places.append(some[known >= 0])
        found.append(known[known >= 0].astype(np.int64))
    place, found = np.concatenate(places), np.concatenate(found)
    order = np.argsort(place, kind="stable")
    return place[order], found[order]


def _enough(own: np.ndarray, place: np.ndarray, found: np.ndarray, need: int, span: int) -> bool:
    """Whether so many places within the span have a seed of the item."""
    where = place[own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found]
    where = where[np.append(True, where[1:] != where[:-1])] if len(where) else where
    return len(where) >= need and bool((where[need - 1 :] - where[: len(where) - need + 1] <= span).any())


def _candidates(items: Items, number: np.ndarray, first: np.ndarray, seeds: pa.Array):
    """(row, item, low, high): passages of rows with a rare seed of the item and enough seeds around it."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    every, seed = _hits(number, row, seeds)
    rare = np.flatnonzero(items.at[seed + 1] > items.at[seed])
    place, found = every[rare], seed[rare]
    size = items.at[found + 1] - items.at[found]
    sums, ends, at = np.append(0, np.cumsum(size)), np.searchsorted(place, first), 0
    while at < len(first) - 1:  # whole rows
        to = max(at + 1, int(np.searchsorted(sums[ends], sums[ends[at]] + HITS, "right")) - 1)
        a, b = ends[at], ends[to]
        at = to
        total = int(sums[b] - sums[a])
        if not total:
            continue
        item = items.of[np.repeat(items.at[found[a:b]] - (sums[a:b] - sums[a]), size[a:b]) + np.arange(total)]
        item, where = np.divmod(np.unique(item * np.int64(len(number)) + np.repeat(place[a:b], size[a:b])), len(number))
        reach = items.span[item] + 2
        # hits that one alignment could span are one passage
        new = np.append(True, (item[1:] != item[:-1]) | (row[where[1:]] != row[where[:-1]]) | (where[1:] - where[:-1] > 2 * reach[1:]))
        starts = np.flatnonzero(new)
        for f, g in zip(starts.tolist(), (np.append(starts[1:], len(item)) - 1).tolist(), strict=True):
            k, r = int(item[f]), int(row[where[f]])
            low, high = max(int(first[r]), int(where[f] - reach[f])), min(int(first[r + 1]), int(where[g] + reach[f]))
            i, j = np.searchsorted(every, [low, high])
            if _enough(items.own[k], every[i:j], seed[i:j], int(items.need[k]), int(items.span[k])):
                yield r, k, low, high


def _most(good: np.ndarray) -> int:
    """The largest sum of consecutive words, of MATCH where good and MISS elsewhere."""
    sums = np.append(0, np.cumsum(np.where(good, MATCH, MISS)))
    return int((sums - np.minimum.accumulate(sums)).max())


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment: its score and where in the passage it ends."""
    slope = -GAP * np.arange(len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(passage == word, MATCH, MISS), row[1:] + GAP), 0)
        new = np.maximum.accumulate(new + slope) - slope  # gaps along the row
        j = int(new.argmax())
        if new[j] > best:
            best, end = int(new[j]), j
        row = new
    return best, end


def _counted(vocabulary: np.ndarray, seeds: np.ndarray):
    """How often each seed, by its number, occurs in a batch."""
    schema = pa.schema([("seed", pa.int64()), ("n", pa.int64())])
    vocabulary, seeds = pa.array(vocabulary), pa.array(seeds)

    def run(batches):
        let_go()
        for batch in batches:
            total = np.zeros(len(seeds), np.int64)
            for _, data, offsets in textscan.slices(batch.column(0), batch.column(1)):
                h, _, _, first = textscan.words(data, offsets, textscan.MARKS)
                number = pc.fill_null(pc.index_in(pa.array(h), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
                _, found = _hits(number, np.repeat(np.arange(len(first) - 1), np.diff(first)), seeds)
                total += np.bincount(found, minlength=len(seeds))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], schema=schema)

    return run


def _aligned(items: Items, least: float):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())])
    vocabulary, seeds = pa.array(items.vocabulary), pa.array(items.seeds)

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for ids, data, offsets in textscan.slices(batch.column(0), batch.column(1)):
                h, _, _, first = textscan.words(data, offsets, textscan.MARKS)
                number = pc.fill_null(pc.index_in(pa.array(h), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
                for row, item, low, high in _candidates(items, number, first, seeds):
                    own, passage, a = items.words[item], number[low:high], int(first[row])
                    full = MATCH * len(own)
                    if min(_most(np.isin(passage, own)), _most(np.isin(own, passage))) / full < least:
                        continue
                    best, end = align(own, passage)
                    if best / full >= least:
                        _, back = align(own[::-1], passage[:end][::-1])
                        for column, value in zip(out, (ids[row].as_py(), items.ids[item], best / full, low - a + end - back, low - a + end), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.4, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, item_id, score (0 to 1), start_word, end_word of each document's best passage for each item it holds.

    docs: doc_id and text; benchmark: item_id and text. Only scores of at least `least` are returned.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "decontam")
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tests = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    parts = []
    for b in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        items = Items(sorted((r.item_id, r.text) for r in rows), least)
        counted = texts.mapInArrow(_counted(items.vocabulary, items.seeds), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()  # a row per seed of the block
        counts = np.zeros(len(items.seeds), np.int64)
        counts[counted["seed"].to_numpy()] = counted["n"].to_numpy()
        items.choose(counts)
        parts.append(work.save(texts.mapInArrow(_aligned(items, least), "doc_id long, item_id long, score double, start_word long, end_word long"), f"aligned-{b}"))
    if not parts:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, start_word long, end_word long")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    best = every.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("start_word")).alias("s"), "end_word")).alias("top"))
    return best.select("doc_id", "item_id", "top.score", (-F.col("top.s")).alias("start_word"), F.col("top.end_word").alias("end_word"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.4, **options) -> DataFrame:
    """The rows of docs, with all their columns, of documents that hold no item. Rows without doc_id stay."""
    work = Workspace(docs.sparkSession, "decontam-ids")
    bad = work.save(contaminated(docs, benchmark, least, **options).select("doc_id").distinct(), "bad")
    return docs.join(small(bad), "doc_id", "left_anti").select(*docs.columns)
