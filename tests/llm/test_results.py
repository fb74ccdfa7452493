"""Results on the small tables: against SQL, against brute force, by round trip and by held-out accuracy."""

import functools
import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from curriq.llm import op1_toxicity as op1
from curriq.llm import op2_topk as op2
from curriq.llm import op3_language as op3
from curriq.llm import op4_elias_fano as op4
from curriq.llm import op5_pii as op5
from curriq.llm import op6_preferences as op6
from curriq.llm import op7_decontaminate as op7
from curriq.llm import op8_dedup as op8
from curriq.llm import op9_urls as op9
from curriq.llm import op11_lines as op11
from curriq.llm import op10_mix as op10
from curriq.llm import queries
from curriq.llm.common import table, word_hashes

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def words_of(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def shingles(text):
    w = words_of(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    low = sum((a & b).values())
    return low / (sum(a.values()) + sum(b.values()) - low) if a and b else 0.0


@pytest.mark.parametrize("name,module", [("op2_branch_and_bound_topk", op2), ("op6_preference_format", op6), ("op9_bloom_url_filter", op9), ("op10_weighted_mix", op10), ("op11_line_dedup", op11)])
def test_against_sql(spark, name, module):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = getattr(module, name)(spark, SF).toPandas(), con.execute(module.ORACLE_SQL).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got)
    rows = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def test_registered():
    assert set(queries.queries()) == {*queries.MODULES, "pipeline"} and set(queries.oracle_sql()) == {"op2_branch_and_bound_topk", "op6_preference_format", "op9_bloom_url_filter", "op10_weighted_mix", "op11_line_dedup", "op12_prefix_trie"}


def test_toxicity_held_out(spark):
    got = op1.op1_nb_char_toxicity(spark, SF2).join(table(spark, SF2, "labels"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.9
    ids = [0, 5, 123456]
    assert [r.held_out for r in op1.score(spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string"), op1.Classifier(np.full(1 << 18, -1, np.int16), np.zeros(0), 0.0)).collect()] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]


def test_toxicity_against_naive_counting(spark):
    """The same features counted one by one, and the same fit: equal scores."""
    rows = [(r.doc_id, r.text, r.toxic) for r in table(spark, SF, "documents").join(table(spark, SF, "labels"), "doc_id").collect()]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in op1.score(docs, op1.fit(docs.unionByName(docs), labels.unionByName(labels))).collect()}

    def scramble(x):
        for _ in range(2):
            x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) % 2**64
        return x ^ (x >> 32)

    @functools.cache
    def bucket(gram):
        value = 0
        for c in gram:
            value = (value * 0xC2B2AE3D27D4EB4F + ord(c) + 1) % 2**64
        return scramble(value) >> 46

    bags = {i: {bucket(t[p : p + n]) for t in [text.lower()] for n in op1.SIZES for p in range(len(t) - n + 1)} for i, text, _ in rows}
    learnt = sorted((x, i) for i, _, x in rows if zlib.crc32(str(i).encode()) % 5)
    y = np.array([x > 0 for x, _ in learnt], dtype=float)
    counts = [Counter(b for x, i in learnt if (x > 0) == kind for b in bags[i]) for kind in (False, True)]
    n = [len(y) - y.sum(), y.sum()]
    seen = sorted(counts[0].keys() | counts[1].keys())
    p, q = (np.array([c[b] + 1.0 for b in seen]) / (m + 2) for c, m in ((counts[1], n[1]), (counts[0], n[0])))
    both = np.array([counts[0][b] + counts[1][b] + 1.0 for b in seen]) / (len(y) + 2)
    errors = np.abs(p - q) / np.sqrt(both * (1 - both) * (1 / n[1] + 1 / n[0]) + 1e-12)
    kept = np.sort(np.argsort(-errors, kind="stable")[: op1.KEPT])
    place, ratio = {seen[k]: j for j, k in enumerate(kept)}, np.log(p / q)[kept]
    found = [sorted(place[b] for b in bags[i] if b in place) for _, i in learnt]
    owners, columns = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.array([c for f in found for c in f])
    w, bias = op1.logistic(owners, columns, ratio[columns], y, len(kept))
    for i, own in bags.items():
        assert abs(got[i] - 1 / (1 + np.exp(-(sum(w[place[b]] * ratio[place[b]] for b in own if b in place) + bias)))) < 1e-3


def test_language_score_against_convolution(spark):
    """Whole texts through the network, window by window and filter by filter."""
    docs = table(spark, SF, "documents").limit(40)
    net = op3.fit(table(spark, SF, "documents"))
    texts = dict(docs.select("doc_id", "text").collect())
    for r in op3.predict(docs, net).collect():
        raw, total = texts[r.doc_id].encode(), np.zeros(len(net.langs))
        for at in range(0, len(raw), op3.WINDOW):
            part = raw[at : at + op3.WINDOW]
            e = net.embed[np.frombuffer(part.ljust(op3.WINDOW), dtype=np.uint8)]
            maxima = [max(float((e[i : i + w] * f[:, :, k]).sum()) for i in range(op3.WINDOW - w + 1)) + b[k] for w, f, b in zip(op3.WIDTHS, net.filters, net.biases, strict=True) for k in range(op3.FILTERS)] if at < 1024 else None
            total += len(part) * ((np.maximum(maxima, 0) @ net.out + net.shift) if maxima else 0)
        if len(raw) <= 1024:
            p = np.exp(total / len(raw) - (total / len(raw)).max())
            assert r.lang_pred == net.langs[int(p.argmax())] and abs(r.score - p.max() / p.sum()) < 1e-3


def test_language_held_out(spark):
    got = op3.op3_byte_cnn_language(spark, SF2).join(table(spark, SF2, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() > 0.97


def test_convolution_tables():
    """The pair tables give the sums of the convolution."""
    r = np.random.default_rng(0)
    net = op3.Network(["a", "b"], r.normal(size=(256, op3.EMBED)).astype(np.float32), [r.normal(size=(w, op3.EMBED, op3.FILTERS)).astype(np.float32) for w in op3.WIDTHS], [r.normal(size=op3.FILTERS).astype(np.float32) for _ in op3.WIDTHS], r.normal(size=(3 * op3.FILTERS, 2)).astype(np.float32), np.zeros(2, np.float32))
    x = r.integers(0, 256, (3, op3.WINDOW)).astype(np.uint8)
    e, pooled = net.embed[x], []
    for w, f, b in zip(op3.WIDTHS, net.filters, net.biases, strict=True):
        s = np.stack([np.einsum("mwe,wef->mf", e[:, i : i + w], f) for i in range(op3.WINDOW - w + 1)], axis=1)
        pooled.append(np.maximum(s.max(axis=1) + b, 0))
    want = np.concatenate(pooled, axis=1) @ net.out
    assert np.allclose(op3.window_logits(net.tables(), net.biases, net.out, net.shift, x), want, rtol=1e-3, atol=1e-3)


def test_token_round_trip(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    t, at = Tokenizer.from_file(TOKENIZER), 0
    got = op4.token_output(docs, TOKENIZER, shard_ids=50_000).orderBy("doc_id").collect()
    for r, (doc_id, text) in zip(got, docs.select("doc_id", "text").orderBy("doc_id").collect(), strict=True):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert tuple(r) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_pieces_of_odd_texts():
    import pyarrow as pa

    t = op4.PieceTokenizer(TOKENIZER)
    r = random.Random(3)
    parts = [" ", "  ", "\n", "\t", " ", "　", "a", "Word", "é", "日", "12", ",", ".", "'s", "<|endoftext|>", "!", "…", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(3000)] + [None, ""]
    ids, sizes = t.encode(pa.array(texts))
    for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert own.tolist() == t.whole.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("sizes", [[1], [0], [0, 0, 3, 0], [5] * 1000, [1, 100_000, 1], [1] * 9000])
def test_elias_fano(sizes):
    docs, n, m = [np.arange(k) % 50_000 for k in sizes], len(sizes), sum(sizes)
    r = random.Random(n)
    for width, known in ((2, [7 * i for i in range(n)]), (4, sorted([None] * (n // 2) + [r.randrange(-(2**63), 2**63) for _ in range(n - n // 2)], key=lambda x: (x is not None, x or 0)))):
        data = op4.pack_shard(docs, known, width)
        shard = op4.Shard(data)
        assert all((shard.document(i) == d).all() and len(shard.document(i)) == len(d) for i, d in enumerate(docs))
        ends = np.cumsum(sizes).tolist()
        assert [shard.boundaries.select(i) for i in range(n)] == ends and shard.boundaries.block(0, n).tolist() == ends
        assert [x for i in range(0, n, 7) for x in shard.boundaries.block(i, 7).tolist()] == ends and [x for i in range(0, n, 7) for x in shard.doc_ids(i, 7)] == known
    packed = op4.pack_sequence(np.cumsum(sizes).astype(np.uint64))
    assert len(packed) - op4.SEQUENCE.size <= (n * (2 + max(0, (m // n).bit_length())) + 24) / 8 + 2


def test_a_shard_of_a_million_documents():
    """Packing and reading take a few bytes a document, not tables of 64-bit offsets for each bit."""
    import tracemalloc

    n = 1_000_000
    ends = np.cumsum(np.random.default_rng(1).integers(1, 9, n)).astype(np.uint64)
    tracemalloc.start()
    packed = op4.pack_sequence(ends)
    sequence = op4.Sequence(np.frombuffer(packed, dtype=np.uint8))
    assert all((sequence.block(i, op4.READ_DOCS) == ends[i : i + op4.READ_DOCS]).all() for i in range(0, n, op4.READ_DOCS))
    assert len(packed) < 0.6 * n and tracemalloc.get_traced_memory()[1] < 40 * n
    tracemalloc.stop()


def brute_base(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c.isdigit()]
            double = [x * 2 - 9 if x > 4 else x * 2 for x in d[-2::-2]]
            good = {"email": True, "ip": kind == "ip" and all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(double)) % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii_base(spark):
    docs = table(spark, SF2, "documents").select("doc_id", "text")
    texts = dict(docs.collect())
    trees = op5.fit(docs)
    seen = Counter()
    for r in op5.find_personal_data(docs, trees).collect():
        base = brute_base(texts[r.doc_id])
        line = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[1] == k for b in base) for k in range(4))
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))
        seen.update(b[3] for b in base)
    assert len(seen) == 4
    for text in ["a@b@c.d a@b.c@d.e.f @x.y", "1.2.3.4.5.6.7.8", "1.2.3.400 4.3.2.1", "+1 (2) 3-4 5.6 78901", "4111 1111 1111 1111", "9" * 5000 + ".1.1.1", "+" * 50]:
        assert op5.base_spans(text) == [(s, k, e) for s, k, e, _ in brute_base(text)]
    added = [s for t in ("write to jane.doe (at) example.com now", "card 4111.1111.1111.1111 ok") for s in op5.added_spans(t, op5.base_spans(t), trees)]
    assert {k for _, k, _ in added} <= {0, 2, 3} and added
    assert op5.redact("x a@b.cd y", "email:2:8") == "x [email] y"


def test_decontamination_brute_force(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    own = {i: (len(words_of(t)), shingles(t)) for i, t in items.select("item_id", "text").collect()}
    want = {}
    for doc_id, text in docs.select("doc_id", "text").collect():
        w = words_of(text)
        for i, (n, item) in own.items():
            if not any(tuple(w[p : p + 5]) in item for p in range(len(w) - 4)):
                continue
            best = max((jaccard(shingles(" ".join(w[p : p + n])), item) for p in range(len(w) - n + 1)), default=0)
            if best >= 0.8:
                want[doc_id, i] = round(best, 9)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in op7.contaminated(docs, items).collect()}
    assert got == want and want
    left = {r.doc_id for r in op7.drop_contaminated(docs, items).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_decontamination_edited_passage():
    base = [f"w{i}" for i in range(60)]
    index = op7.ItemIndex([(7, " ".join(base))])
    near, far = [*base], [*base]
    near[0] = near[59] = "changed"
    far[15] = far[30] = far[45] = "changed"
    text = lambda w: " ".join(["intro"] * 9 + w + ["outro"] * 9)
    assert [(i, round(s, 3), p) for _, i, s, p, _ in index.search([text(near)])] == [(7, round(54 / 58, 3), 8)] and index.search([text(far)]) == []
    masks = op7.near_masks(16, 2)
    assert len(masks) == 137
    # every value within 4 bits is reached by two steps of 2 at most
    assert {a ^ b for a in masks.tolist() for b in masks.tolist()} == set(op7.near_masks(16, 4).tolist())


def test_decontamination_of_a_long_text_of_repeats():
    """5 MB that repeat one passage: memory and time stay those of a segment."""
    import time
    import tracemalloc

    r = random.Random(4)
    passage = [f"w{r.randrange(900)}" for _ in range(200)]
    index = op7.ItemIndex([(1, " ".join(passage[20:80])), (2, " ".join(passage[100:140]))])
    text = " ".join(passage * 6000)
    assert len(text) > 4_500_000
    tracemalloc.start()
    began = time.time()
    assert [x[:4] for x in index.search([text])] == [(0, 1, 1.0, 20), (0, 2, 1.0, 100)]
    assert tracemalloc.get_traced_memory()[1] < 300 << 20 and time.time() - began < 60
    tracemalloc.stop()


def test_bag_min_hash_is_unbiased():
    r = random.Random(1)
    base = [f"w{r.randrange(3000)}" for _ in range(300)]
    for edits, repeat in ((3, 40), (10, 0), (25, 200)):
        a = base + base[:repeat]
        b = list(a)
        for _ in range(edits):
            b[r.randrange(len(b))] = f"z{r.randrange(9999)}"
        texts = [" ".join(a), " ".join(b)]
        s = op8.signatures(*op8.bags(texts), 2, 4000)
        assert abs((s[0] == s[1]).mean() - jaccard(*map(shingles, texts))) < 0.035
    assert word_hashes(["x y"])[0].tolist() == word_hashes(["zz", "X, y!"])[0][1:].tolist()


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_classes(rows):
    rows = sorted(rows)
    bags = [shingles(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if rows[i][1] == rows[j][1] or (not bags[i].isdisjoint(bags[j]) if hasattr(bags[i], "isdisjoint") else bags[i].keys() & bags[j].keys()) and jaccard(bags[i], bags[j]) >= 0.8]
    return {rows[i][0]: rows[c][0] for i, c in enumerate(components(len(rows), links))}


def test_near_duplicates_brute_force(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    r = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    for k in range(60):  # a family of variants around the threshold, some only linked by way of others
        v = list(base)
        for _ in range(r.randrange(7)):
            v[r.randrange(80)] = f"x{r.randrange(40)}"
        rows.append((1000 + k, " ".join(v)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert {x.doc_id: x.class_id for x in op8.near_duplicate_classes(docs).collect()} == want
    assert {x.doc_id for x in op8.drop_near_duplicates(docs).collect()} == set(want.values())


def test_filling_targets(spark):
    """The closed form against sharing the excess again and again."""
    r = random.Random(2)
    for n in (1, 2, 7, 30):
        sizes = [r.choice((0, 1, 10, 1000, r.randrange(10**6))) for _ in range(n)]
        weights = [(3, 1, 2)[i % 3] for i in range(n)]
        got = [x.target for x in op10.targets(spark.createDataFrame([(f"{i:03d}", s) for i, s in enumerate(sizes)], "source string, source_size long")).orderBy("source").collect()]
        target, left, open_ = [0.0] * n, 1.5 * sum(sizes), set(range(n))
        while open_ and left > 1e-6:
            share = left / sum(weights[i] for i in open_)
            full = {i for i in open_ if target[i] + share * weights[i] >= 2 * sizes[i]}
            for i in open_ if not full else full:
                target[i] = 2.0 * sizes[i] if full else target[i] + share * weights[i]
            left = 1.5 * sum(sizes) - sum(target)
            # what is not full starts anew with all that is left
            open_ -= full
            if not full:
                break
        assert np.allclose(got, target, rtol=1e-9, atol=1e-3)


def test_mix_is_deterministic_and_near(spark):
    docs, labels = table(spark, SF2, "documents"), table(spark, SF2, "labels")
    a, b = (op10.mix_sources(docs.repartition(n), labels).toPandas().sort_values("doc_id").reset_index(drop=True) for n in (2, 5))
    assert a.equals(b)
    by = a.merge(docs.select("doc_id", "source").toPandas(), on="doc_id").groupby("source").agg(size=("size", "sum"), longest=("size", "max"), target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() <= by.longest / 2 + 1).all() and abs(by.target.sum() / by["size"].sum() - 1.5) < 1e-9
    took = op10.mixed_documents(docs, labels).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    want = (a.taken / a["size"].clip(lower=1)).astype(int)
    assert {i: n for i, n in zip(a.doc_id, want) if n} == {i: n for i, n in took.items() if want[i]}


def test_empty_texts_in_the_mix(spark):
    """At most two copies, and none where the target is 0."""
    rows = [(i, "word " * 50, "a") for i in range(9)] + [(20, "", "b"), (21, None, "b"), (22, "x y", "b"), (30, "", "c"), (31, None, "c"), (40, "w " * 4000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r.doc_id for r in op10.mixed_documents(docs).collect())
    targets = {r.source: r.target for r in op10.taken_times(docs, None)[1].collect()}
    assert targets["b"] == 4 and targets["c"] == 0 and got[20] == 2 and got[22] == 2 and not got[30] and not got[31] and max(got.values()) <= 2


def test_pipeline_against_brute_force(spark):
    """Each stage's own input and output: what goes and what stays is what brute force says."""
    rows, docs = {}, table(spark, SF, "documents")
    from curriq.llm.common import cut, shared_dir

    folder = shared_dir(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = cut(stage(spark, docs, SF), folder, name)
        rows[name] = (before, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    before, after = rows["language"]
    assert set(after) <= set(before) and len(after) >= 0.98 * len(before)
    before, after = rows["near_duplicates"]
    assert {i for i, _ in after} == set(brute_classes(before).values())
    before, after = rows["decontaminate"]
    gone = {i for i, _ in before} - {i for i, _ in after}
    items = [(len(words_of(t)), shingles(t)) for (t,) in table(spark, SF, "benchmark").select("text").collect()]
    dirty = set()
    for i, t in before:
        w, own = words_of(t), shingles(t)
        for n, item in items:
            # a window that matches has 8/9 of the item's shingles, so the whole text has them too
            if sum((own & item).values()) >= 0.88 * item.total() and any(jaccard(shingles(" ".join(w[p : p + n])), item) >= 0.8 for p in range(len(w) - n + 1)):
                dirty.add(i)
                break
    assert gone == dirty
    before, after = rows["mix"]
    assert set(Counter(after).values()) <= {1, 2} and set(after) <= set(before)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).orderBy("start").collect()
    assert [r.doc_id for r in last] == sorted(i for i, _ in after) and [r.start for r in last] == list(np.cumsum([0] + [r.n_tokens for r in last])[:-1])
