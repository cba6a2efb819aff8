"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

Base patterns find e-mail addresses, IP addresses, card numbers and phone numbers; what they find always counts.
Generators with wider patterns (spelt-out addresses, national phone numbers, cards with other separators, IPv6)
propose further, overlapping spans. Boosted trees score each by its format (lengths, digits, separators, check
sum) and its context (neighbouring characters, words that introduce such data); a kind's threshold is the lowest
score from which on nothing but personal data was found among held-out rows. Of overlapping additions the best scored
stays, and none overlaps a base span.

The trees are fitted on the driver, on sentences made here by rule, whose features come from the same
expressions; they become one CASE expression, so that the main path has no Python.

Patterns are written so that Java's matcher neither backtracks nor recurses over long runs: quantifiers are
possessive, and a match may only begin where a run does or the last match ended, which finds the same matches.
Positions are counted over the pieces between matches, in chunks, in code points.

Results on unusual input: null texts are empty; empty texts have no spans, and the hash of the empty string. Rows
that share a doc_id, or have none, are reported each. An empty table gives an empty result.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, possessive where that finds the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match of each base pattern has at least; cheap to test.
BASE_NEEDS = {"email": "contains(_t, '@')", "ip": "_t RLIKE '[0-9][.][0-9]'", "card": "_t RLIKE '[0-9](?:[ -]?[0-9]){11}'", "phone": "contains(_t, '+')"}
WORD = r"[\p{L}0-9_%+-]"
#: Wider patterns: kind and pattern of each generator.
WIDER = [
    ("email", rf"(?<!{WORD}){WORD}{{1,64}}(?:\.{WORD}{{1,64}}){{0,4}}\x20?(?:\(at\)|\[at\]|\x20at\x20|@)\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{{1,63}}){{1,4}}"),
    ("phone", r"(?<![0-9])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9])00[0-9]{1,3}(?:[\x20./-]{1,2}[0-9]{2,5}){2,5}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[._/\x20-]{1,2}[0-9]{4}){2}[._/\x20-]{1,2}[0-9]{1,7}(?![0-9])"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
]
#: As BASE_NEEDS, of each generator.
WIDER_NEEDS = [
    "contains(_t, '@') OR contains(_t, '(at)') OR contains(_t, '[at]') OR contains(_t, ' at ')",
    "_t RLIKE '[0-9]{3}[ .-][0-9]{4}'",
    "contains(_t, '00')",
    "_t RLIKE '[0-9]{4}[._/ -]{1,2}[0-9]{4}'",
    "_t RLIKE '[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:'",
]
#: Words that introduce personal data, by kind.
CUES = {
    "email": r"(?i)(?:e-?mail|mail|write|contact|reach|address)\W*(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:ip|host|server|address|login|from)\W*(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:card|visa|credit|debit|account|payment)\W*(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|contact|ring)\W*(?:\w+\W+){0,2}$",
}
AROUND = 40
CHUNK = 64
FEATURES = ("length", "digits", "letters", "marks", "dots", "groups", "luhn", "distinct", "before", "after", "cue", "kind", "generator")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """Whether a string of digits passes Luhn's check sum."""
    doubled = "CASE WHEN (length(d) - i) % 2 = 1 THEN int(c) ELSE int(c) * 2 - CASE WHEN int(c) > 4 THEN 9 ELSE 0 END END"
    return f"element_at(transform(array({digits}), d -> aggregate(transform(filter(split(d, ''), y -> y <> ''), (c, i) -> {doubled}), 0, (a, y) -> a + y) % 10 = 0), 1)"


def _spans(parts: str) -> str:
    """array<struct<start, m, before, after>> of the matches, from text split before each of them.

    Each part but the first is a match, a mark and the text up to the next match.
    """
    own = "length(x) - CASE WHEN contains(x, '\\u0002') THEN 1 ELSE 0 END"
    made = f"array(named_struct('start', acc.pos, 'm', substring_index(x, '\\u0002', 1), 'before', acc.tail, 'after', left(substring_index(x, '\\u0002', -1), {AROUND})))"
    none = "cast(array() AS array<struct<start: int, m: string, before: string, after: string>>)"
    step = f"named_struct('pos', acc.pos + {own}, 'tail', right(replace(x, '\\u0002', ''), {AROUND}), 'found', CASE WHEN contains(x, '\\u0002') THEN concat(acc.found, {made}) ELSE acc.found END)"
    start = f"named_struct('pos', aggregate(slice(sizes, 1, n), 0, (a, y) -> a + y), 'tail', right(replace(coalesce(get({parts}, n * {CHUNK} - 1), ''), '\\u0002', ''), {AROUND}), 'found', {none})"
    chunks = f"transform(sequence(0, (size({parts}) - 1) div {CHUNK}), k -> slice({parts}, k * {CHUNK} + 1, {CHUNK}))"
    each = f"transform(chunks, (ch, n) -> aggregate(ch, {start}, (acc, x) -> {step}, acc -> acc.found))"
    sizes = f"transform(chunks, ch -> aggregate(ch, 0, (a, x) -> a + {own}))"
    # arrays of one element carry the intermediate values
    return f"CASE WHEN size({parts}) < 2 THEN {none} ELSE element_at(transform(array({chunks}), chunks -> element_at(transform(array({sizes}), sizes -> flatten({each})), 1)), 1) END"


def _marked(pattern: str, needs: str) -> str:
    """The text, split before each match; texts that can't have one aren't searched."""
    return f"CASE WHEN {needs} THEN split(regexp_replace(_t, {_quoted(pattern)}, '\\u0001$0\\u0002'), '\\u0001') ELSE array(_t) END"


def _valid(kind: str) -> str:
    """Whether a base match x.m counts."""
    if kind == "ip":
        return "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)"
    if kind == "card":
        return f"length({_digits('x.m')}) BETWEEN 12 AND 19 AND {_luhn(_digits('x.m'))}"
    if kind == "phone":
        return f"length({_digits('x.m')}) BETWEEN 9 AND 15"
    return "true"


def _candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, _t (the text, its marks replaced), base_<kind> and wide: spans with all features."""
    cleaned = docs.select(*keep, F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\x01\x02", "\x03\x03").alias("_t"))
    split = cleaned.select("*", *(F.expr(_marked(p, BASE_NEEDS[k])).alias(f"_b{i}") for i, (k, p) in enumerate(BASE.items())), *(F.expr(_marked(p, needs)).alias(f"_w{i}") for i, ((_, p), needs) in enumerate(zip(WIDER, WIDER_NEEDS, strict=True))))
    spans = split.select(*keep, "_t", *(F.expr(f"filter({_spans(f'_b{i}')}, x -> {_valid(k)})").alias(f"_base_{k}") for i, k in enumerate(BASE)), *(F.expr(_spans(f"_w{i}")).alias(f"_wide_{i}") for i in range(len(WIDER))))
    base = [F.expr(f"transform(_base_{k}, x -> named_struct('start', x.start, 'kind', {i}, 'stop', x.start + length(x.m)))").alias(f"base_{k}") for i, k in enumerate(KINDS)]
    wide = [f"transform(_wide_{g}, x -> {_features(KINDS.index(kind), g)})" for g, (kind, _) in enumerate(WIDER)]
    return spans.select(*keep, "_t", *base, F.expr(f"concat({', '.join(wide)})").alias("wide"))


def _features(kind: int, generator: int) -> str:
    digits = _digits("x.m")
    values = {
        "length": "length(x.m)",
        "digits": f"length({digits})",
        "letters": "length(regexp_replace(x.m, '[^\\\\p{L}]', ''))",
        "marks": "length(regexp_replace(x.m, '[\\\\p{L}0-9 ]', ''))",
        "dots": "length(regexp_replace(x.m, '[^.]', ''))",
        "groups": "size(filter(split(x.m, '[^0-9]+'), y -> y <> ''))",
        "luhn": f"CASE WHEN length({digits}) > 1 AND {_luhn(digits)} THEN 1 ELSE 0 END",
        "distinct": f"size(array_distinct(split({digits}, '')))",
        "before": "CASE WHEN x.before RLIKE '[\\\\p{L}0-9#$=/]$' THEN 2 WHEN x.before RLIKE '[.,-]$' THEN 1 ELSE 0 END",
        "after": "CASE WHEN x.after RLIKE '^[\\\\p{L}0-9%/=]' THEN 2 WHEN x.after RLIKE '^[.,-]' THEN 1 ELSE 0 END",
        "cue": f"CASE WHEN x.before RLIKE {_quoted(CUES[KINDS[kind]])} THEN 1 ELSE 0 END",
        "kind": str(kind),
        "generator": str(generator),
    }
    return "named_struct('start', x.start, 'stop', x.start + length(x.m), " + ", ".join(f"'{k}', double({v})" for k, v in values.items()) + ")"


class Trees:
    """Gradient-boosted trees for the logistic loss; scores are log-odds."""

    def __init__(self, rounds: int = 24, depth: int = 3, rate: float = 0.3):
        self.rounds, self.depth, self.rate = rounds, depth, rate
        self.trees: list = []

    def _grow(self, x, slope, curve, depth):
        value = self.rate * slope.sum() / (curve.sum() + 1)
        best = (1e-6, None, None)
        if depth and len(x) > 1:
            whole = slope.sum() ** 2 / (curve.sum() + 1)
            for f in range(x.shape[1]):
                for cut in np.unique(x[:, f])[:-1]:
                    left = x[:, f] <= cut
                    gain = slope[left].sum() ** 2 / (curve[left].sum() + 1) + slope[~left].sum() ** 2 / (curve[~left].sum() + 1) - whole
                    if gain > best[0] + 1e-9:
                        best = (gain, f, float(cut))
        _, f, cut = best
        if f is None:
            return value
        left = x[:, f] <= cut
        return f, cut, self._grow(x[left], slope[left], curve[left], depth - 1), self._grow(x[~left], slope[~left], curve[~left], depth - 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        score = np.zeros(len(y))
        for _ in range(self.rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            self.trees.append(self._grow(x, y - p, p * (1 - p), self.depth))
            score = self.predict(x)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        def walk(tree, row):
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            return tree

        return np.array([sum(walk(t, row) for t in self.trees) for row in x])

    def sql(self, row: str) -> str:
        def case(tree) -> str:
            if not isinstance(tree, tuple):
                return f"{tree:.9f}D"
            return f"CASE WHEN {row}.{FEATURES[tree[0]]} <= {tree[1]}D THEN {case(tree[2])} ELSE {case(tree[3])} END"

        return " + ".join(map(case, self.trees)) or "0D"


def _sentences(rng: random.Random, n: int) -> list[tuple[str, str, bool]]:
    """Made-up sentences, each with one span: (text, span, whether it is personal data)."""
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rng.choice(["ka", "lo", "mi", "ren", "tus", "vor", "el"]) for _ in range(rng.randint(2, 3)))

    def card() -> str:
        body = [int(c) for c in rng.choice("3456") + d(14)]
        total = sum(x if i % 2 else sum(divmod(2 * x, 10)) for i, x in enumerate(body))
        digits = "".join(map(str, body)) + str(-total % 10)
        return rng.choice([".", "  ", "/", "--", "_"]).join(digits[i : i + 4] for i in (0, 4, 8, 12))

    cues = {"email": ["mail", "e-mail me", "contact", "write to"], "phone": ["call", "tel.", "phone", "mobile"], "card": ["card", "visa", "credit card"], "ip": ["host", "server", "ip"]}
    good = {
        "email": lambda: f"{w()}.{w()}{rng.choice([' (at) ', ' [at] ', '(at)', ' @ '])}{w()}{rng.choice([' (dot) ', '.', ' [dot] '])}{rng.choice(['com', 'org', 'net', 'de'])}",
        "phone": lambda: rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0049 {d(3)} {d(5)} {d(3)}"]),
        "card": card,
        "ip": lambda: ":".join(f"{rng.randrange(65536):x}" for _ in range(8)),
    }
    bad = {
        "email": lambda: f"{w()} at {w()}{rng.choice([' dot ', '.', '. '])}{w()}",
        "phone": lambda: f"{d(3)} {d(3)} {d(4)}",
        "card": lambda: rng.choice([" ", ". ", "/", "_"]).join((d(4), d(4), d(4), d(rng.choice([1, 2, 5])))),
        "ip": lambda: ":".join(d(2) for _ in range(rng.choice([4, 5]))),
    }
    out = []
    for _ in range(n):
        kind, sound = rng.choice(KINDS), rng.random() < 0.5
        span = (good if sound else bad)[kind]()
        lead = f"{w()} {w()} " + (rng.choice(cues[kind]) + rng.choice([" ", ": "]) if rng.random() < (0.6 if sound else 0.1) else rng.choice(["", "no. ", "nr ", "item #", "x="]) if not sound else "")
        out.append((f"{lead}{span}{rng.choice([' ', ', ', '. ', ' - '])}{w()} {w()}", span, sound))
    return out


_models: dict[tuple[int, int], tuple[Trees, list[float]]] = {}


def model(spark: SparkSession, rows: int = 1600, seed: int = 11) -> tuple[Trees, list[float]]:
    """The trees and each kind's threshold; made once a process."""
    if (rows, seed) not in _models:
        made = _sentences(random.Random(seed), rows)
        texts = pa.table({"i": pa.array(range(len(made)), pa.int32()), "text": [t for t, _, _ in made]})
        frame = spark.createDataFrame(texts).repartition(spark.sparkContext.defaultParallelism)  # by Arrow: rows of Python would start workers
        got = _candidates(frame, ["i"]).selectExpr("i", "inline(wide)").orderBy("i", "start", "generator").collect()
        x = np.array([[r[f] for f in FEATURES] for r in got]).reshape(len(got), len(FEATURES))
        y = np.array([float(made[r.i][2] and made[r.i][0].find(made[r.i][1]) < r.stop and r.start < made[r.i][0].find(made[r.i][1]) + len(made[r.i][1])) for r in got])
        held = np.array([r.i % 3 == 0 for r in got])
        trees = Trees().fit(x[~held], y[~held])
        score, thresholds = trees.predict(x[held]), []
        for k in range(len(KINDS)):
            own = x[held][:, FEATURES.index("kind")] == k
            wrong, right = score[own & (y[held] == 0)], score[own & (y[held] == 1)]
            above = right[right > max(wrong, default=-np.inf)]
            thresholds.append(float(max(min(above, default=np.inf), 1.0)))
        _models[rows, seed] = trees, thresholds
    return _models[rows, seed]


def detect(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, _t, base_<kind> for each kind, and spans: all of them, ordered by start and kind, as (start, kind, stop)."""
    trees, thresholds = model(docs.sparkSession)
    found = _candidates(docs, keep)
    base = found.withColumn("base", F.concat(*(F.col(f"base_{k}") for k in KINDS)))
    limits = f"element_at(array({', '.join('double(' + repr(str(t)) + ')' for t in thresholds)}), int(x.kind) + 1)"
    scored = base.withColumn("added", F.expr(f"transform(wide, x -> named_struct('score', {trees.sql('x')}, 'start', x.start, 'stop', x.stop, 'kind', int(x.kind), 'least', {limits}))"))
    open_ = "filter(added, a -> a.score >= a.least AND NOT exists(base, b -> a.start < b.stop AND b.start < a.stop))"
    sure = scored.withColumn("added", F.expr(f"CASE WHEN size(added) = 0 THEN added ELSE array_sort({open_}, (p, q) -> CASE WHEN p.score > q.score THEN -1 WHEN p.score < q.score THEN 1 WHEN p.start < q.start THEN -1 WHEN p.start > q.start THEN 1 ELSE p.kind - q.kind END) END"))
    one = "named_struct('start', a.start, 'kind', a.kind, 'stop', a.stop)"
    best = f"aggregate(added, cast(array() AS array<struct<start: int, kind: int, stop: int>>), (kept, a) -> CASE WHEN exists(kept, b -> a.start < b.stop AND b.start < a.stop) THEN kept ELSE concat(kept, array({one})) END)"
    return sure.select(*keep, "_t", *(f"base_{k}" for k in KINDS), "base", F.expr(f"array_sort(concat(base, {best}))").alias("spans"))


def _listed(column: str) -> str:
    names = "array(" + ", ".join(map(_quoted, KINDS)) + ")"
    return f"array_join(transform({column}, s -> concat_ws(':', element_at({names}, s.kind + 1), s.start, s.stop)), ',')"


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> of base spans, base_sha256 and spans, as text."""
    found = detect(docs, ["doc_id"])
    return found.select("doc_id", *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.expr(f"sha2({_listed('array_sort(base)')}, 256)").alias("base_sha256"), F.expr(_listed("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span in text replaced by its kind in brackets; n_chars, if there, counts the new text.

    Overlapping spans are replaced as one. Null texts stay null; texts without spans stay as they are.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    lower = [c.lower() for c in docs.columns]
    text = names[lower.index("text")]
    plain = docs.toDF(*names).withColumn("text", F.col(text))
    found = detect(plain, names)
    # stretches of overlapping spans, then what lies between them
    joined = "aggregate(spans, cast(array() AS array<struct<start: int, kind: int, stop: int>>), (m, s) -> CASE WHEN size(m) > 0 AND element_at(m, -1).stop > s.start THEN concat(slice(m, 1, size(m) - 1), array(named_struct('start', element_at(m, -1).start, 'kind', element_at(m, -1).kind, 'stop', greatest(element_at(m, -1).stop, s.stop)))) ELSE concat(m, array(s)) END)"
    merged = found.withColumn("m", F.expr(joined))
    names_sql = "array(" + ", ".join(_quoted(f"[{k.upper()}]") for k in KINDS) + ")"
    pieces = f"transform(m, (s, i) -> concat(substring({text}, CASE WHEN i = 0 THEN 0 ELSE element_at(m, i).stop END + 1, s.start - CASE WHEN i = 0 THEN 0 ELSE element_at(m, i).stop END), element_at({names_sql}, s.kind + 1)))"
    new = F.expr(f"CASE WHEN size(m) = 0 THEN {text} ELSE concat(array_join({pieces}, ''), substring({text}, element_at(m, -1).stop + 1)) END")
    out = merged.withColumn("new", new)
    columns = []
    for name, was in zip(names, docs.columns, strict=True):
        if name == text:
            columns.append(F.col("new").cast(docs.schema[docs.columns.index(was)].dataType).alias(name))
        elif was.lower() == "n_chars":
            columns.append(F.when(F.size("m") > 0, F.length("new")).otherwise(F.col(name)).cast(docs.schema[docs.columns.index(was)].dataType).alias(name))
        else:
            columns.append(F.col(name))
    return out.select(*columns).toDF(*docs.columns)
