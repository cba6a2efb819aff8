"""The operators on small tables against brute force: ties, repeats, nulls, empty and long texts, empty tables, clashing columns."""

import collections
import itertools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import common, decontam, knn, licenses, lmscore, neardup, packing, pii, quality, queries, simple8b, suffix, tokens

PATH = queries.tokenizer_path()
TEXT = "doc_id long, text string"
ODD = [None, "", " ", "\n", "one", "one two three four five", "a" * 700, "ab " * 400, "é\U0001F600 x@y.zz", "\x00\x01 two  spaces\tand tab", "<|endoftext|> x", "don't 's\nx y\n\nz"]


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", i) for i, t in enumerate(texts)], TEXT + ", component string, id int")


def prose(rng, n, words=tuple("ka lo mi ren tus vor el".split())):
    return " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_tokens_exact():
    plain, rng = Tokenizer.from_file(PATH), random.Random(1)
    texts = [*ODD, *("\n".join(prose(rng, 30) for _ in range(3)) for _ in range(30)), "…quote “x” y", "a b　c", "x "]
    for bounds in ((600_000, 60_000), (40, 15)):
        e = tokens.Encoder(PATH, *bounds)
        for _ in range(2):
            ids, sizes = e.encode(pa.array(texts, pa.string()))
            at = 0
            for t, n in zip(texts, sizes.tolist(), strict=True):
                assert ids[at : at + n].tolist() == plain.encode(t or "", add_special_tokens=False).ids
                at += n


def folded(n, a, b):
    """The first n letters of Thue and Morse's sequence: polynomial hashes modulo 2^64 can't tell it from its opposite."""
    while len(a) < n:
        a, b = a + b, b + a
    return a[:n]


FOLDED = [folded(n, *ab) for n in (1024, 2048) for ab in ("ab", "ba")]


def test_tokens_of_marks(monkeypatch):
    """Words that differ in marks at their end are one word of the memo, those of letters pass the pattern by, and ids are the library's."""
    plain, rng, e = Tokenizer.from_file(PATH), random.Random(2), tokens.Encoder(PATH)
    words, marks = ["zor", "Mél", "ñandúes", "straße", "K9", "3x"], ["", ".", ",", "!!", "%%%", ")];"]
    seen, joined = [], e._joined
    monkeypatch.setattr(e, "_joined", lambda some, mark: seen.extend(some) or joined(some, mark))
    e.encode(pa.array([" ".join(["x", *(w + m for w in words for m in marks)])]))
    # the first word has no space before it
    assert len(e._recent.keys) == 1 + len(words) + len(marks) - 1 and sorted(seen) == sorted(["x", "K9", "3x", *marks[1:]])
    bits = [*words, *marks[1:], "'s", "'re", "'", "(", "-", "_", "~", "×", "÷", "é", "Ȁ", "ȿ", "ɀ", "e\u0301", "…", "я", "²", "١", "😀", "\x7f", "\xad", "<", "|", "Ġ", "Ċ", " ", "\n"]
    texts = [" ".join("".join(rng.choice(bits) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    ids, sizes = e.encode(pa.array(texts))
    ends = np.cumsum(sizes)
    assert [ids[b - n : b].tolist() for b, n in zip(ends, sizes, strict=True)] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


def test_words_of_equal_polynomials(spark):
    plain, docs = Tokenizer.from_file(PATH), frame(spark, [*FOLDED, *(f"x {t} y" for t in FOLDED)])
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = {k: plain.encode(t, add_special_tokens=False).ids for k, t in texts.items()}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert {r.doc_id: r.ids_crc32 for r in simple8b.round_trip(docs, PATH).collect()} == {k: crc([*x, 0]) for k, x in ids.items()}
    got = collections.defaultdict(dict)
    for r in packing.pack(docs, PATH).collect():
        got[r.doc_id][r.start] = (r.length, r.ids_crc32)
    for k, own in got.items():
        assert own == {a: (n, crc([*ids[k], 2][a : a + n])) for a, (n, _) in own.items()}
    assert all(r.kept for r in neardup.near_duplicates(docs, 85).collect())


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, percent):
    rng = random.Random(4)
    base = prose(rng, 120).split()
    texts = list(ODD)
    for i in range(150):  # copies of copies, with edits that straddle the threshold
        w = (texts[-1].split() if i % 7 and i else list(base)) if rng.random() < 0.5 else list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(base).upper(), " ".join(base)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, texts), percent).collect()}
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in enumerate(sets)}
    assert neardup.near_duplicates(spark.createDataFrame([], TEXT)).count() == 0


def test_near_duplicates_of_versions(spark):
    """One version of 5 is a copy of 1's text; its other version still stands for its own class."""
    rng = random.Random(14)
    a, b = prose(rng, 120), prose(rng, 120)
    near = " ".join([*b.split()[:-1], "changed"])
    rows = [(1, a), (5, a), (5, b), (7, b), (9, near), (11, prose(rng, 120))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, TEXT)).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 9: 1, 11: 11}


def test_components_and_hot_keys(spark, monkeypatch):
    """The ways beyond the bounds of one task and of broadcasts give the same."""
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(2000 + i, 2001 + i) for i in range(40)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    frame_ = spark.createDataFrame(edges, "a long, b long")
    for bound in (common.EDGES_PER_TASK, 50):
        monkeypatch.setattr(common, "EDGES_PER_TASK", bound)
        got = common.components(frame_, common.Workspace(spark, "test"), f"cc-{bound}").collect()
        assert len(got) == len(linked) and {r.id: r.component for r in got} == {x: find(x) for x in linked}
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common.rows_within, "__defaults__", (0,))
    counts = common.Workspace(spark, "test").save(frame_.groupBy("a").agg(F.count("*").alias("n")), "counts")
    joined = common.join_counted(frame_, counts, ["a"], "n", share=10).collect()
    assert len(joined) == len(edges) and all(r.n == sum(a == r.a for a, _ in edges) for r in joined)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(2)
    for n in (1, 3, 40, 5000):
        assert not (neardup.sketch(rng.integers(0, 2**63, n).astype(np.uint64), 252) == neardup.FULL).any()
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    same = (neardup.sketch(x[:2400], 252) == neardup.sketch(x[600:], 252)).mean()
    assert abs(same - 0.6) < 0.12


def brute_removed(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                cover[s : s + 100] = True
            seen.add(b[s : s + 100])
        rest = np.frombuffer(b, np.uint8)[~cover[:-1]].tobytes()
        out.append((len(b), int(cover.sum()), int((cover[:-1] & ~cover[1:]).sum()), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("hot,records", [(20_000, "10000"), (8, "10000"), (8, "7")])
def test_substrings(spark, request, hot, records):
    """Small batches: some hold only anchors of a long text whose row came before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, records)
    request.addfinalizer(lambda: spark.conf.set(key, before))
    rng = random.Random(3)
    base = "".join(rng.choice("abcdé \n") for _ in range(500))
    texts = [*ODD, base, base[:200] + "X" + base[200:], base[100:350] * 3, base + base]
    texts += [prose(rng, 5) + base[rng.randint(0, 200) : rng.randint(250, 500)] + prose(rng, 20) for _ in range(60)]
    got = sorted(suffix.deduplicate(frame(spark, texts), hot=hot).collect())
    assert [tuple(r)[1:] for r in got] == brute_removed(texts)
    again = suffix.deduplicate(spark.createDataFrame([(1, base), (1, base + "y"), (None, base), (0, base)], TEXT)).collect()
    assert sorted(r.n_removed for r in again) == sorted(x[1] for x in brute_removed([base, base, base, base + "y"]))
    assert suffix.deduplicate(spark.createDataFrame([], TEXT)).count() == 0


@pytest.mark.parametrize("part", [1, 64, 100, 999])
def test_anchors_of_parts(monkeypatch, part):
    rng = np.random.default_rng(part)
    data = np.concatenate([rng.integers(0, 3, 1500), np.zeros(400, int), rng.integers(0, 256, 500)]).astype(np.uint8)
    offsets = np.array([0, 0, 700, 750, 1700, 2400])
    whole = suffix.anchors(data, offsets, 100)
    monkeypatch.setattr(suffix, "PART", part)
    assert len(whole[0]) and all((a == b).all() for a, b in zip(whole, suffix.anchors(data, offsets, 100), strict=True))


def test_side_order():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 2, (300, 30)).astype(np.uint8)
    rows[:, :12] = 0
    group = np.sort(rng.integers(0, 5, 300))
    order, common = suffix.Side(rows).order(group)
    want = sorted(range(300), key=lambda i: (group[i], rows[i].tobytes(), i))
    assert order.tolist() == want
    for k in range(1, 300):
        if group[k] == group[k - 1]:
            a, b = rows[order[k - 1]], rows[order[k]]
            assert common[k] == (30 if (a == b).all() else int((a != b).argmax()))


def test_packing(spark):
    rng = random.Random(6)
    texts = [*ODD, *(prose(rng, rng.randint(1, 900)) for _ in range(60))]
    rows = packing.pack(frame(spark, texts), PATH, per_part=10).collect()
    plain = Tokenizer.from_file(PATH)
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert sum(r.length for r in own) == len(ids) and all(r.length == 1024 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    for own in by_bin.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(by_bin) <= -(-total // 1024) + 1
    assert packing.pack(spark.createDataFrame([], TEXT), PATH).count() == 0


def test_fullest():
    rng = random.Random(8)
    for _ in range(60):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(6)}
        cap = rng.randint(20, 90)
        sums = {0}
        for k, c in counts.items():
            sums = {s + k * j for s in sums for j in range(c + 1)}
        got = packing.fullest(sorted(counts, reverse=True), counts, cap)
        assert sum(got) == max(s for s in sums if s <= cap) and all(got.count(k) <= counts[k] for k in got)


def best_fit_decreasing(histogram, capacity):
    free = []
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        at = min((i for i, f in enumerate(free) if f >= length), key=lambda i: free[i], default=None)
        if at is None:
            free.append(capacity)
            at = len(free) - 1
        free[at] -= length
    return len(free)


def test_plan():
    rng = random.Random(12)
    plain, relaxed = 0, 0
    for n in (0, 1, 40, 150, 400):
        for low, high in ((1, 1024), (100, 600), (1, 200)):
            histogram = collections.Counter(rng.randint(low, high) for _ in range(n))
            slots = packing.plan(histogram, 1024)
            filled, placed = collections.defaultdict(list), collections.Counter()
            for length, first, count, sequence, offset in sorted(slots):
                assert first == placed[length]
                placed[length] += count
                for i in range(count):
                    filled[sequence + i].append((offset, length))
            assert placed == histogram
            for own in filled.values():
                assert all(b[0] == a[0] + a[1] for a, b in itertools.pairwise(sorted(own))) and min(own)[0] == 0 and sum(x for _, x in own) <= 1024
            relaxed += len(filled)
            plain += packing.plan_with(histogram, 1024, 0)[0]
            assert len(filled) <= best_fit_decreasing(histogram, 1024)
    assert relaxed < plain


def test_simple8b(spark):
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 4095, 4096, 4097, 20000):
        x = np.where(rng.random(n) < 0.4, 0, rng.integers(0, 2**17, n)).astype(np.uint64)
        if n > 4:
            x[1:4] = [2**60, 2**60 - 1, 2**64 - 1]
        assert (simple8b.decode(n, *simple8b.encode(x)) == x).all()
    plain, at = Tokenizer.from_file(PATH), 0
    got = sorted(simple8b.round_trip(frame(spark, ODD), PATH, segment_ids=50, file_bytes=100).collect())
    for r, t in zip(got, ODD, strict=True):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert simple8b.round_trip(spark.createDataFrame([], TEXT), PATH).count() == 0


def test_knn(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(400, 16))
    v[50:200] = v[50]  # a third is one vector
    rows = [(i, [float(x) for x in e]) for i, e in enumerate(v)] + [(1000, None), (1100, [1.0, None]), (1200, [float("nan")]), (1300, []), (1400, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in knn.knn_join(df, F.col("vec_id") % 100 == 0, pivots=8, part_rows=40).collect())
    ids = np.array([*range(400), 1400])
    x = np.zeros((401, 16), np.int64)
    x[:400] = np.floor(1024 * v.astype(np.float32).astype(float))
    x[400, 0] = 512
    want = []
    for q in (0, 100, 200, 300, 400):
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if j != q][:10]
        want += [(int(ids[q]), k + 1, int(ids[j]), int(s[j])) for k, j in enumerate(order)]
    assert got == want and knn.knn_join(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    spans = []
    for o, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0 if d else False
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn or kind == "phone" and 9 <= len(d) <= 15:
                spans.append((m.start(), o, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(spans)]


def test_pii(spark):
    texts = [*ODD, "a@b.c..d@e.f a@b.c%x@d.e @x.y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 12", "+1 (528) 555-3435. +49 30 1234567- +1", "x@y.z " * 300, "1" * 30000, "a@" + "b.c" * 9000, "call (528) 555-3435 now, bob (at) site (dot) com; order 123 456 7890"]
    got = {r.doc_id: r for r in pii.report(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_pii(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got[i].spans.split(",")) | {""} and got[i].n_email == sum(s.startswith("email") for s in want)
    assert got[len(texts) - 1].spans.startswith("phone:5:19")
    red = pii.redact(spark.createDataFrame([(1, "é to x@y.zz, 1.2.3.4!", 9), (2, None, None)], TEXT + ", n_chars long")).orderBy("doc_id").collect()
    assert red[0].text == "é to [EMAIL], [IP]!" and red[0].n_chars == len(red[0].text) and red[1].text is None
    plan = pii.report(frame(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licenses(spark):
    texts = [*licenses.OTHER, None, "", "x\nfoo bar. Licensed under the Apache License, Version 2.0. qux\nReleased under the MIT License.", "license " * 3000]
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licenses.scan(frame(spark, texts), ["doc_id"]).collect())
    n = len(licenses.OTHER) + 2
    assert got == [(n, 1, "Apache-2.0"), (n, 2, "MIT")] and licenses.model().accuracy > 0.95


def test_wrapped_licenses(spark):
    """Notices over several lines, bare and in comments, alone and one after another."""
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:'
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    apache = 'Unless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    texts = [f"The MIT License (MIT)\n\nCopyright (c) 2020 Someone\n\n{mit}", f"Copyright 2020\n\n{bsd}", f"x\n\n{apache}\n\ny", gpl]
    texts += ["/*\n" + "\n".join(f" * {x}" for x in t.split("\n")) + "\n */\nint x;" for t in (mit, bsd, apache, gpl)]
    texts += [f"{bsd}\n{gpl}", "\n".join(mit.split(" "))]
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licenses.scan(frame(spark, texts), ["doc_id"]).collect())
    assert got == [(0, 4, "MIT"), (1, 2, "BSD"), (2, 2, "Apache-2.0"), (3, 0, "GPL"), (4, 1, "MIT"), (5, 1, "BSD"), (6, 1, "Apache-2.0"), (7, 1, "GPL"), (8, 0, "BSD"), (8, 2, "GPL"), (9, 0, "MIT")]


def test_unlisted_licenses(spark):
    """Identifiers and names that no notice has are unknown."""
    texts = ["SPDX-License-Identifier: ISC", "SPDX-License-Identifier: Zlib", "Licensed under the Foo Bar License, Version 9.", None, ""]
    assert licenses.scan(frame(spark, texts), ["doc_id"]).count() == 0
    empty = frame(spark, texts).limit(0)
    assert licenses.scan(empty, ["doc_id"]).count() == 0
    again = spark.createDataFrame([(1, "Released under the MIT License.")] * 2 + [(None, "Released under the MIT License.")], TEXT)
    assert [r.family for r in licenses.scan(again, ["doc_id"]).collect()] == ["MIT"] * 3


def test_license_gate():
    """Whatever bigrams of a notice a confirmed paragraph lacks, it has one of the gate's, and the pattern finds it."""
    gate, pattern = licenses.gate(0.6), re.compile(licenses._gate_pattern(0.6))
    for family, notices in licenses.NOTICES.items():
        for notice in notices:
            own, telling = licenses._required(notice, licenses._others(family))
            # as many of the gate's bigrams missing as the two rules of confirmation allow
            free = [p for p in own if p not in gate]
            kept = [p for p in telling if p not in gate]
            assert len(free) / len(own) < 0.6 or 2 * len(kept) < len(telling)
            for p in set(own) & gate:
                assert pattern.search("x-" + p.replace(" ", "\n// ") + ".") and not pattern.search(p.replace(" ", " zz "))
            assert pattern.search(" ".join(licenses._words(notice)))


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, 35, tuple("abcdefghij"))) for i in range(10)]
    texts = list(ODD) + [prose(rng, 200) for _ in range(30)]
    clean = len(texts)
    for i, t in items:
        w = t.split()
        for k in range(0, len(w), 6):
            w[k] = "changed"
        texts += [prose(rng, 40) + " " + t.upper() + "! " + prose(rng, 9), prose(rng, 20) + " " + " ".join(w)]
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    for block in (4 << 20, 300):  # one block, and several
        got = {(r.doc_id, r.item_id) for r in decontam.contaminated(frame(spark, texts), bench, block_bytes=block).collect()}
        assert got == {(clean + 2 * i + j, i) for i in range(10) for j in (0, 1)}
    kept = decontam.keep_clean(frame(spark, texts), bench)
    assert kept.columns == ["doc_id", "text", "component", "id"] and kept.count() == clean
    assert decontam.contaminated(frame(spark, texts), bench.limit(0)).count() == 0


@pytest.mark.parametrize("vocabulary", [3000, 40])
def test_decontamination_dense_edits(spark, vocabulary):
    """Every document and item against brute force; edits leave few or no intact n-grams, or pairs of words are frequent."""
    rng = random.Random(12)
    items = [(i, "which of the following " * (i % 3 == 0) + " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([1, 2, 3, 6, 30, 60])))) for i in range(30)]
    texts = []
    for _, t in items:
        for every in (3, 4, 5, 8):
            texts.append(prose(rng, 30) + " " + " ".join(f"x{k}" if k % every == 0 else w for k, w in enumerate(t.split())) + " " + prose(rng, 30))
        texts.append(" ".join(f"{w} x{k}" for k, w in enumerate(t.split())))  # a word put in after each
        texts.append(" ".join(w for k, w in enumerate(t.split()) if k % 3))
        texts.append(" ".join(w if rng.random() > 0.25 else "x" for w in t.split()))
    number = collections.defaultdict(lambda: len(number))
    want = {}
    for i, t in enumerate(texts):
        passage = np.array([number[w] for w in t.lower().split()])
        for j, item in items:
            own = np.array([number[w] for w in item.split()])
            score = decontam.align(own, passage)[0] / (2 * len(own)) if len(passage) else 0
            if score >= 0.4:
                want[i, j] = score
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(frame(spark, texts), bench).collect()}
    assert got == want


def test_align():
    rng = random.Random(10)
    for _ in range(40):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontam.align(np.array(a), np.array(b))[0] == h.max()


def left_out_loss(ws, inside, uni, bi, ctx, total, size, start=0):
    """Mean loss of a document; inside: the counts hold it, and are taken without it."""
    own_uni, own_bi, own_ctx = collections.Counter(ws), collections.Counter(zip([start, *ws], ws)), collections.Counter([start, *ws[:-1]])
    less = (lambda c, own, key: c[key] - own[key]) if inside else (lambda c, own, key: c[key])
    loss = 0.0
    for h, w in zip([start, *ws], ws):
        p = (less(uni, own_uni, w) + 0.5) / (total - inside * len(ws) + 0.5 * size)
        c = less(ctx, own_ctx, h)
        loss -= math.log(0.7 * less(bi, own_bi, (h, w)) / c + 0.3 * p if c else p)
    return loss / len(ws)


def test_lm_scores(spark):
    rng = random.Random(11)
    docs = [(i, t, bool(i % 3)) for i, t in enumerate([*ODD, *(prose(rng, 60) for _ in range(40))])]
    df = spark.createDataFrame(docs, TEXT + ", is_target boolean")
    got = {r.doc_id: r for r in lmscore.cross_entropy_difference(df).collect()}
    words = {i: (t or "").encode().lower().split() for i, t, _ in docs}
    for k, name in ((0, "background_loss"), (1, "target_loss")):
        uni, bi, ctx = collections.Counter(), collections.Counter(), collections.Counter()
        for i, _, target in docs:
            if target or not k:
                uni.update(words[i])
                bi.update(zip([0, *words[i]], words[i]))
                ctx.update([0, *words[i]][: len(words[i])])
        total, size = sum(uni.values()), len({w for ws in words.values() for w in ws}) + 1
        for i, ws in words.items():
            if not ws:
                assert got[i][name] is None and got[i].n_tokens == 0
                continue
            assert abs(got[i][name] - left_out_loss(ws, docs[i][2] or not k, uni, bi, ctx, total, size)) < 1e-6
    assert lmscore.cross_entropy_difference(df.limit(0)).count() == 0


def test_lm_scores_of_many_words(spark):
    """Over 65,000 distinct words, most of them rare: each has counts of its own."""
    rng = random.Random(13)
    docs = [(i, " ".join(f"w{i * 700 + k}" if k < 700 else f"w{rng.randrange(90_000)}" for k in range(1000)), i % 2 == 0) for i in range(100)]
    docs[1] = (1, docs[0][1], False)  # its words are the target's
    got = {r.doc_id: r for r in lmscore.cross_entropy_difference(spark.createDataFrame(docs, TEXT + ", is_target boolean")).collect()}
    words = {i: t.split() for i, t, _ in docs}
    size = len({w for ws in words.values() for w in ws}) + 1
    assert size > 65_000
    for k, name in ((0, "background_loss"), (1, "target_loss")):
        uni, bi, ctx = collections.Counter(), collections.Counter(), collections.Counter()
        for i, _, target in docs:
            if target or not k:
                uni.update(words[i])
                bi.update(zip(["", *words[i]], words[i]))
                ctx.update(["", *words[i][:-1]])
        total = sum(uni.values())
        for i, ws in words.items():
            assert abs(got[i][name] - left_out_loss(ws, docs[i][2] or not k, uni, bi, ctx, total, size, "")) < 1e-6
    mean = [np.mean([r.difference for i, r in got.items() if i > 1 and i % 2 == k]) for k in (0, 1)]
    assert abs(mean[0] - mean[1]) < 0.15, mean  # being a target document is no advantage by itself


def test_lm_scores_of_repeated_and_missing_ids(spark):
    rows = [(None, "a b c", True), (1, "a b c", True), (1, "a b c", True), (2, None, True)]
    got = lmscore.cross_entropy_difference(spark.createDataFrame(rows, TEXT + ", is_target boolean")).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 3), ("1", 3), ("2", 0), ("None", 3)]
    assert len({r.target_loss for r in got if r.n_tokens}) == 1


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (queries.table(spark, d, n) for n in ("documents", "labels"))
    model = queries.quality_model(spark, docs, d)
    held = quality.score(docs, model).join(labels.where(queries.fold() == 2), "doc_id").select("score", "quality").collect()
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in held]) > 0.97
    odd = frame(spark, ODD)
    scores = quality.score(odd, model).collect()
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores)
    clash = odd.withColumn("score", F.lit(1)).withColumn("label", F.lit(0))
    assert quality.keep_good(clash, model, 0.0).columns == clash.columns
    none = quality.train(docs, labels.limit(0).select("doc_id", F.col("quality").alias("label")))
    assert {round(r.score, 3) for r in quality.score(odd, none).collect()} == {0.5}


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = queries.table(spark, d, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    rows = corpus_pipeline.run(spark, d).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert rows and max(r.n for r in rows) <= 1024


def test_oracles(spark):
    from tests.parity import compare, connect

    con = connect("/root/testdata/sf0.001")
    for name, sql in queries.oracle_sql().items():
        assert compare(queries.queries()[name](spark, "/root/testdata/sf0.001"), con, sql) == "", name


def test_stages_return_memory(spark, monkeypatch):
    """Each stage begins with a collection in the executors (here the driver's JVM, which takes part as such); no plain Python workers are started."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs, seen, collect = queries.table(spark, d, "documents"), [], common.settle
    monkeypatch.setattr(corpus_pipeline, "settle", lambda s: seen.append(collect(s)))
    monkeypatch.setattr(spark.sparkContext, "parallelize", lambda *_: pytest.fail("rows of Python"))
    pii._models.clear()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d)
        assert len(seen) == i + 1, name
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    runs = lambda: sum(b.getCollectionCount() for b in beans())
    monkeypatch.setattr(common, "give_back", lambda _: None)  # the driver's own collection
    before = runs()
    collect(spark)
    assert runs() > before


def test_workers_let_go(spark):
    """What packing keeps in a worker goes when the same worker turns to another stage."""
    model = quality.Model(np.zeros(1 << quality.BITS), 0.0, 0.0, 0.0)
    for run in (quality._collect(quality.BITS), quality._apply(model, quality.BITS), neardup._sketches(5, 42, 6), decontam._counted(np.zeros(0, np.uint64), np.zeros(0, np.int64))):
        e = tokens.encoder(PATH)
        assert tokens.encoder(PATH) is e
        assert list(run(iter([]))) == [] and not common.HELD
