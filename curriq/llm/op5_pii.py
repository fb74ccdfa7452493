"""Personal data by candidate gradient boosting: wide generators propose spans, boosted trees select among them.

Base spans (email, ip, card, phone) come from four fixed patterns and their checks, leftmost and non-overlapping for each
kind; they always stay. Generators then propose wider, overlapping candidates: from each group of digits to the same and
each later one of a run with the usual separators (6 characters or more, 19 digits at most) as ip, card and phone at once, mail addresses written with (at), [at] or dots in words, with the whole of their names. Boosted trees score each candidate from its format (digits,
groups, separators, check digit, parts) and context (neighbouring characters and numbers, the word before). A candidate is
added where its score reaches its kind's threshold and it overlaps no base span; of overlapping ones of one kind the one
around the others wins, else the higher score, then the earlier, then the kind listed first.

There are no labelled spans, so the trees learn from the base rules on all documents: base spans and their rewritten forms
(plus sign dropped, other separators, mail signs in words) are positive, rewritten numbers also two in a row; candidates that
overlap no base span, joins of two rewritten numbers, and base spans with a digit changed so that the check fails, are
negative. Rows that are equal in id and text count once. Equal examples become one with a number, and Spark keeps them:
bin edges are exact quantiles from counts of values, each level of a tree takes one pass that sums histograms in
tasks (in whole numbers, so their order doesn't matter), and thresholds come from running sums over the different scores.
Thresholds are set on documents whose id is divisible by 5, kept out of training: the lowest score from which 98 % of what is
selected is positive, and 0.9 at least.

Offsets are code points, ends exclusive. Null texts count as empty: no spans, the hash of the empty string. The columns
n_email, n_ip, n_card and n_phone count base spans; n_added counts the others. Whole texts are read. Null doc_ids are
scored but not learnt from. Repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curriq.llm.common import cut, shared_dir, spread, table

KINDS = ("email", "ip", "card", "phone")
TREES, DEPTH, RATE, BINS, LEAF = 60, 3, 0.2, 32, 8
PRECISION, LEAST_THRESHOLD = 0.98, 0.9
#: Examples that a task packs into one block, and the whole number that stands for 1 in sums of gradients.
BLOCK, UNIT = 1 << 14, 1 << 20

# ---- Base spans ------------------------------------------------------------------------------------------------

_MAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits, so the look-behind changes nothing but the time on long runs
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order of start and kind."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _MAIL_NAME:
            start -= 1
        host = _MAIL_HOST.match(text, at) if start < at else None
        if host:
            found.append((start, 0, host.end()))
            free = host.end()
        at = text.find("@", max(at + 1, free))
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if small_parts(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(found)


# ---- Candidates and their features -----------------------------------------------------------------------------

_GROUP = re.compile(r"[0-9]+")
_BETWEEN = re.compile(r"[ ().\-/]*")
#: Characters of a candidate number from its first digit on, and its digits: the longest kind, a card, has 19.
LEAST_LENGTH, MOST_DIGITS = 6, 19
_SIGN = re.compile(r" ?(?:\(at\)|\[at\]|@) ?")
_SIGNED_HOST = re.compile(r"[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+")
_WORDED_HOST = re.compile(r"[A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+")
_GAP = re.compile(r"[0-9]([ ().\-/]{1,8})\Z")
_GAP_AFTER = re.compile(r"([ ().\-/]{1,8})[0-9]")
#: What stands between two numbers that are written one after the other.
NEIGHBOUR_GAPS = (" / ", " ")
_LEAD = re.compile(r"([^\W\d_]{2,20})\W{0,3}$")
#: Words that announce personal data, in the languages of the tables.
LEADS = ("tel", "phone", "telefon", "telefono", "call", "mobile", "fax", "mail", "email", "correo", "card", "carte", "karte", "tarjeta", "visa", "ip", "host", "server")


def numbers(text: str) -> list[tuple[int, int]]:
    """(start, end) of what runs from one group of digits to the same or a later one, with nothing but separators between."""
    groups, found = [m.span() for m in _GROUP.finditer(text)], []
    joined = [_BETWEEN.fullmatch(text, a[1], b[0]) is not None for a, b in itertools.pairwise(groups)] + [False]
    for i, (first, _) in enumerate(groups):
        signed = first > 0 and text[first - 1] in "+(" and not (first > 1 and "0" <= text[first - 2] <= "9")
        digits = 0
        for j in range(i, len(groups)):
            digits += groups[j][1] - groups[j][0]
            if digits > MOST_DIGITS:
                break
            if groups[j][1] - first >= LEAST_LENGTH:
                found.append((first - signed, groups[j][1]))
            if not joined[j]:
                break
    return found


class Taken:
    """Spans, and whether others overlap them."""

    def __init__(self, spans: list[tuple[int, int, int]] = ()):
        self.starts = sorted(s for s, _, _ in spans)
        self.ends = list(itertools.accumulate((e for _, _, e in sorted(spans)), max))

    def meets(self, start: int, end: int) -> bool:
        at = bisect.bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start

    def add(self, start: int, end: int) -> None:
        """Take a span that meets none."""
        at = bisect.bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of everything that might be personal data, overlapping."""
    found = []

    def mail(at: int, host: re.Match | None) -> None:
        start = at
        while host and start > 0 and text[start - 1] in _MAIL_NAME:  # no sign is in a name, so names are walked over once
            start -= 1
        if host and start < at:
            found.append((start, 0, host.end()))

    if "@" in text or "(at)" in text or "[at]" in text:
        for m in _SIGN.finditer(text):
            mail(m.start(), _SIGNED_HOST.match(text, m.end()))
    if " dot " in text:
        at = text.find(" at ")
        while at >= 0:
            mail(at, _WORDED_HOST.match(text, at + 4))
            at = text.find(" at ", at + 3)
    for start, end in numbers(text):
        n = len(digits_of(text[start:end]))
        if text.count(".", start, end) == 3:
            found.append((start, 1, end))
        if 13 <= n <= 19:
            found.append((start, 2, end))
        if 7 <= n <= 15:
            found.append((start, 3, end))
    return found


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    span = text[start:end]
    digits = digits_of(span)
    gaps = [len(g) for g in re.findall(r"[^0-9]+", span[1:-1])] or [0]
    behind, ahead = _GAP.search(text[max(0, start - 9) : start]), _GAP_AFTER.match(text, end)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    before, after = text[start - 1 : start], text[end : end + 1]
    lead = _LEAD.search(text[max(0, start - 24) : start])
    word = lead[1].lower() if lead else ""
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        len(span), len(digits), len(groups), groups[0], groups[-1], max(groups), min(groups),
        float(span[0] == "+"), span.count("("), span.count("-"), span.count(" "), span.count("."), span.count("/"),
        float(luhn(digits)) if digits else 0.0, float(small_parts(span) if re.fullmatch(r"[0-9]+(\.[0-9]+)+", span) else 0), float(digits[:1] == "0"), len(set(digits)),
        float("@" in span), float("at)" in span or "at]" in span or " at " in span), float(" dot " in span or "dot)" in span or "dot]" in span), sum(c.isalpha() for c in span) / len(span),
        float(before.isalnum()), float(after.isalnum()), float(before in ("", "\n")), float(word in LEADS), len(word), float(before in "$€£#" if before else 0),
        max(gaps), len(behind[1]) if behind else 0, len(ahead[1]) if ahead else 0,
    ]


def rewritten(text: str, start: int, kind: int, end: int) -> list[tuple[str, int, int, bool]]:
    """(text, start, end, positive) of other ways to write a base span in its place, and of one that must not count."""
    span, left, right = text[start:end], text[max(0, start - 30) : start], text[end : end + 5]
    digits, out = digits_of(span), []
    if kind == 0:
        name, host = span.split("@", 1)
        forms = [(f"{name} (at) {host}", True), (f"{name}[at]{host.replace('.', '[dot]')}", True), (f"{name} at {host.replace('.', ' dot ')}", True)]
    elif kind == 1:
        parts = span.split(".")
        forms = [(".".join([*parts[:3], str(int(parts[3]) + 300)]), False), (".".join(parts[:3] + [parts[3] + "9999"]), False)]
    elif kind == 2:
        grouped = "-".join(digits[i : i + 4] for i in range(0, len(digits), 4))
        wrong = digits[:-1] + str((int(digits[-1]) + 5) % 10)
        forms = [(grouped.replace("-", "."), True), (grouped.replace("-", "/"), True), (wrong, False), (grouped[:-1] + wrong[-1], False)]
    else:
        bare = span.lstrip("+")
        forms = [("00" + bare, True), (f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", True), (digits, False), (f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}", False)]
    for form, positive in forms:
        out.append((left + form + right, len(left), len(left) + len(form), positive))
    return out


# ---- Boosted trees ---------------------------------------------------------------------------------------------


@dataclass
class Trees:
    edges: list[np.ndarray] = field(default_factory=list)  # for each feature: bin edges
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # for each tree: feature, bin, leaf values
    prior: float = 0.0
    thresholds: tuple[float, ...] = (1.1, 1.1, 1.1, 1.1)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.int16) if len(x) else np.zeros((0, len(self.edges)), np.int16)

    def raw(self, b: np.ndarray) -> np.ndarray:
        raw = np.full(len(b), self.prior)
        for feature, cut_at, leaves in self.nodes:
            raw += leaves[places(b, feature, cut_at, DEPTH) - (2**DEPTH - 1)]
        return raw

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(self.binned(x))))


def places(b: np.ndarray, feature: np.ndarray, cut_at: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row of bins comes to on a level of a tree."""
    at, rows = np.zeros(len(b), dtype=np.int64), np.arange(len(b))
    for _ in range(depth):
        at = 2 * at + 1 + (b[rows, feature[at]] > cut_at[at])
    return at


def packed(known: DataFrame, trees: Trees) -> DataFrame:
    """(b, y, n): blocks of binned examples, their labels and their numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            b, y, n = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in (b.astype(np.int8), y.astype(np.int8), n.astype(np.int64))], names=["b", "y", "n"])

        for batch in batches:
            if batch.num_rows:
                held.append((trees.binned(vectors(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()))
            if sum(len(h[0]) for h in held) >= BLOCK:
                yield block()
        if held:
            yield block()

    return known.select("x", "y", "n").mapInArrow(pack, "b binary, y binary, n binary")


def vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def histograms(blocks: DataFrame, trees: Trees, feature: np.ndarray, cut_at: np.ndarray, level: int) -> np.ndarray:
    """(3, node of the level, feature, bin): sums of gradients and of their slopes, in units, and of examples."""
    shape = (3, 2**level, len(trees.edges), BINS + 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, shape[1] * shape[2] * shape[3]), dtype=np.int64)
        for batch in batches:
            for b, y, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b, y, n = np.frombuffer(b, np.int8).reshape(-1, shape[2]), np.frombuffer(y, np.int8), np.frombuffer(n, np.int64)
                p = 1 / (1 + np.exp(-trees.raw(b)))
                own = places(b, feature, cut_at, level) - (2**level - 1)
                key = ((own[:, None] * shape[2] + np.arange(shape[2])) * shape[3] + b).ravel()
                for k, w in enumerate((np.rint((y - p) * UNIT) * n, np.rint((p * (1 - p) + 1e-6) * UNIT) * n, n)):
                    total[k] += np.bincount(key, weights=np.repeat(w, shape[2]), minlength=total.shape[1]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = np.zeros(shape, dtype=np.int64)
    for r in blocks.mapInArrow(add, "sums binary").collect():  # a row a task
        sums += np.frombuffer(r[0], np.int64).reshape(shape)
    return sums


def boost(blocks: DataFrame, trees: Trees) -> None:
    """Gradient boosting on logistic loss with histograms; full trees of DEPTH, splits without gain send all left."""
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        feature, cut_at = np.zeros(inner, dtype=np.int64), np.full(inner, BINS + 1, dtype=np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            sums = np.cumsum(histograms(blocks, trees, feature, cut_at, level), axis=3)
            (gl, hl), nl = sums[:2] / UNIT, sums[2]
            gt, ht, nt = gl[..., -1:], hl[..., -1:], nl[..., -1:]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(nl < LEAF) | (nt - nl < LEAF)] = 0
            gain = gain.reshape(width, -1)
            top, own = gain.argmax(axis=1), np.arange(width)
            better = gain[own, top] > 1e-3
            feature[first : first + width][better] = (top // (BINS + 1))[better]
            cut_at[first : first + width][better] = (top % (BINS + 1))[better]
        # sums of both sides of the last level's splits
        split, at = feature[first:], np.minimum(cut_at[first:], BINS)
        g, h = (np.stack([c[own, split, at], c[own, split, -1] - c[own, split, at]], axis=1).ravel() for c in (gl, hl))
        trees.nodes.append((feature, cut_at, RATE * g / (h + 1)))


def joins(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[list[float], bool]]:
    """Negative examples: candidate numbers that overlap two of the spans."""
    return [(features(text, *c), False) for c in candidates(text) if c[1] and sum(c[0] < e and s < c[2] for s, _, e in spans) > 1]


def examples(text: str) -> Iterator[tuple[list[float], bool]]:
    """Features and labels that a text's base spans and other candidates give."""
    base = base_spans(text)
    for start, kind, end in base:
        yield features(text, start, kind, end), True
        for other, a, b, positive in rewritten(text, start, kind, end):
            yield features(other, a, kind, b), positive
            if positive and kind:
                for gap in NEIGHBOUR_GAPS:
                    near = b + len(gap)
                    pair = other[:b] + gap + other[a:]
                    spans = [(a, kind, b), (near, kind, near + b - a)]
                    yield from [(features(pair, *c), True) for c in spans] + joins(pair, spans)
    taken = Taken(base)
    for start, kind, end in candidates(text):
        if not taken.meets(start, end):
            yield features(text, start, kind, end), False


def counted_examples(docs: DataFrame) -> DataFrame:
    """(held, x, y, n): the different examples of all docs (doc_id, text), each with its number."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                met = Counter((tuple(x), y) for x, y in examples(text))
                if met:
                    own = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(met), pa.int64()), pa.array([own] * len(met), pa.binary()), pa.array([x for x, _ in met], pa.list_(pa.float64())), pa.array([y for _, y in met], pa.bool_()), pa.array(met.values(), pa.int64())], names=["doc_id", "own", "x", "y", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = spread(rows).mapInArrow(learn, "doc_id long, own binary, x array<double>, y boolean, n long")
    once = found.groupBy("doc_id", "own", "x", "y").agg(F.max("n").alias("n"))  # repeated rows give the same
    return once.groupBy((F.col("doc_id") % 5 == 0).alias("held"), "x", "y").agg(F.sum("n").alias("n"))


def bin_edges(known: DataFrame, total: int) -> list[np.ndarray]:
    """For each feature the different quantiles (the lower value, where one lies between two) of all examples."""
    values = known.select(F.posexplode("x").alias("j", "v"), "n").groupBy("j", "v").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("j").orderBy("v"))
    wanted = F.array(*[F.lit(int(i)) for i in np.floor(np.linspace(0, 1, BINS + 1)[1:-1] * (total - 1))])
    hit = F.exists(wanted, lambda i: (i < F.col("upto")) & (i >= F.col("upto") - F.col("n")))
    got = sorted(tuple(r) for r in values.withColumn("upto", upto).where(hit).select("j", "v").collect())  # BINS - 1 a feature at most
    return [np.array([v for _, v in own]) for _, own in itertools.groupby(got, key=lambda r: r[0])]


def thresholds(known: DataFrame, trees: Trees) -> tuple[float, ...]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = vectors(batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(x[:, : len(KINDS)].argmax(axis=1), pa.int32()), pa.array(trees.scores(x)), batch.column(1), batch.column(2)], names=["kind", "score", "y", "n"])

    scored = known.select("x", "y", "n").mapInArrow(score, "kind int, score double, y boolean, n long")
    each = scored.groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y"), F.col("n")).otherwise(0)).alias("right"))
    above = Window.partitionBy("kind").orderBy(F.desc("score"))
    good = each.select("kind", "score", (F.sum("right").over(above) / F.sum("n").over(above)).alias("precision")).where(F.col("precision") >= PRECISION)
    least = {r["kind"]: r["score"] for r in good.groupBy("kind").agg(F.min("score").alias("score")).collect()}
    return tuple(max(LEAST_THRESHOLD, least[k]) if k in least else 1.1 for k in range(len(KINDS)))


def fit(docs: DataFrame) -> Trees | None:
    """Trees and thresholds from all docs (doc_id, text); None if they give no two classes to train on."""
    folder = shared_dir(docs.sparkSession)
    known = cut(counted_examples(docs), folder, "examples")
    total = {(r["held"], r["y"]): r["n"] for r in known.groupBy("held", "y").agg(F.sum("n").alias("n")).collect()}
    wrong, right = total.get((False, False), 0), total.get((False, True), 0)
    if not wrong or not right:
        return None
    train = known.where("NOT held")
    trees, mean = Trees(bin_edges(train, wrong + right)), right / (wrong + right)
    trees.prior = float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    boost(cut(packed(spread(train), trees), folder, "blocks"), trees)
    trees.thresholds = thresholds(known.where("held"), trees)
    return trees


def added_spans(text: str, base: list[tuple[int, int, int]], trees: Trees) -> list[tuple[int, int, int]]:
    taken = Taken(base)
    some = [c for c in candidates(text) if not taken.meets(c[0], c[2])]
    if not some:
        return []
    scores = trees.scores(np.array([features(text, *c) for c in some]))
    out: list[tuple[int, int, int]] = []
    taken = Taken()
    good = [i for i in range(len(some)) if scores[i] >= trees.thresholds[some[i][1]]]
    reach, outer = [-1] * len(KINDS), []  # without those within another good one of the same kind
    for i in sorted(good, key=lambda i: (some[i][0], -some[i][2])):
        _, kind, end = some[i]
        if end > reach[kind]:
            outer.append(i)
            reach[kind] = end
    for i in sorted(outer, key=lambda i: (-scores[i], some[i])):
        start, _, end = some[i]
        if not taken.meets(start, end):
            out.append(some[i])
            taken.add(start, end)
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_personal_data(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """Counts of base spans, the hash of their list, and all spans of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # some kilobytes

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                more = added_spans(text, base, own) if text and own else []
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), written(base + more), len(more)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds_of = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds_of, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(find, FOUND)


def redact(text: str | None, spans: str) -> str | None:
    """text with each span replaced by its kind in brackets; overlapping spans become one."""
    if not text or not spans:
        return text
    out, last = [], 0
    for kind, start, end in ((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(","))):
        if start >= last:
            out += [text[last:start], f"[{kind}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def op5_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_personal_data(docs, fit(docs))
