"""Line dedup, the conversation trie and token alignment against plain Python, on awkward tables too."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curriq.llm import op11_lines, op12_trie, op13_alignment

DOCS = "doc_id long, text string, hi long, line int"  # with names of the operators' own columns
WHITE = " \t\n\x0b\x0c\r"


# ---- op11 ------------------------------------------------------------------------------------------------------


def plain_line_dedup(docs, min_chars=40, min_docs=5):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(WHITE))
    holders = {}
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        keep = [x for x in lines if doc_id is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def lines_of(spark, docs, partitions=4, **kw):
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], DOCS).repartition(partitions)
    return sorted(map(tuple, op11_lines.kept_lines(df, op11_lines.keep_bitmaps(df, **kw)).collect()), key=repr)


def test_line_dedup_on_awkward_lines(spark):
    shared = "é" * 39 + "Z"
    docs = [(i, f"{shared}\n own {i}\n\t{shared.replace('Z', 'z')}  \n") for i in range(6)] + [(None, shared), (7, None), (8, ""), (9, "\n\n"), (10, shared[1:]), (3, f"x\n{shared}")]
    docs += [(11 + i, "k" * 40 + "\n" + "K" * 41) for i in range(4)] + [(2, docs[2][1])]
    assert lines_of(spark, docs) == plain_line_dedup(docs)


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_of_lines_that_span_tasks(spark, seed):
    """Few keys and many documents: most hashes lie at a border of several tasks."""
    rng = random.Random(seed)
    docs = [(rng.randrange(60), "\n".join(rng.choice("abcdef") * 3 + rng.choice(["", " ", "\t"]) for _ in range(rng.randrange(9)))) for _ in range(150)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert lines_of(spark, docs, min_chars=2, min_docs=rng.choice([1, 2, 5, 30])) or True
        for min_docs in (1, 5, 41):
            assert lines_of(spark, docs, min_chars=2, min_docs=min_docs) == plain_line_dedup(docs, 2, min_docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_keep_bitmaps_round_trip():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 700)
        share = rng.choice([0.001, 0.05, 0.5, 0.99])
        dropped = np.array([i for i in range(n) if rng.random() < share], dtype=np.int64)
        keep = op11_lines.pack_keep(dropped)
        assert np.flatnonzero(~op11_lines.unpack_keep(keep, n)).tolist() == dropped.tolist()
        assert len(keep) <= 2 + n // 8
    assert len(op11_lines.pack_keep(np.arange(100_000))) < 8


def test_line_dedup_of_an_empty_table(spark):
    assert lines_of(spark, []) == []


# ---- op12 ------------------------------------------------------------------------------------------------------


def plain_trie(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said = f"{len((role or '').encode())}:{role or ''}{text or ''}"
            turns.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.md5(said.encode()).hexdigest(), role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in turns.items()}
    nodes = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        seq = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append((c, d == len(seq)))
    children = {}
    for n in nodes:
        if n:
            children.setdefault(n[:-1], []).append(n)
    leaves, saved = {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        leaves[n] = sum(leaves[x] for x in children.get(n, [])) or 1
        saved[n] = sum(saved[x] for x in children.get(n, [])) + (len(nodes[n]) - 1) * (len(n[-1][1].encode()) if n else 0)
    smallest = {n: min(c for c, _ in m) for n, m in nodes.items()}
    ends = {n: ",".join(map(str, sorted(c for c, e in m if e))) for n, m in nodes.items()}
    return sorted((smallest[n], len(n), smallest[n[:-1]] if n else None, len(m), len(children.get(n, [])), leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in nodes.items() if m) if nodes else []


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth long, k1 long")
    return sorted(map(tuple, op12_trie.prefix_trie(df).collect()), key=lambda r: (r[0], r[1], r[2] or -(10**9), r))


def by_place(rows):
    return sorted(rows, key=lambda r: (r[0], r[1], r[2] if r[2] is not None else -(10**9), r))


@pytest.mark.parametrize("seed", range(2))
def test_trie_of_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 60), 40):
        for i in range(rng.choice([1, 2, 5, 9, 12])):
            rows.append((c, rng.choice([i, i, None]), rng.choice(["user", None, "assistant"]), rng.choice(["a", "é", "", None, "b"])))
    rows += rows[:9] + [(None, 0, "user", "x")]
    assert trie_of(spark, rows) == by_place(plain_trie(rows))


def test_trie_of_long_copies_over_many_tasks(spark):
    """Copies of one conversation longer than a task's range: hashes go on over tasks, subtrees double."""
    rows = [(c, i, "user", str(i)) for c in (0, 50, 1003) for i in range(70)] + [(c, i, "user", str(i)) for c in (5, 10) for i in range(33)] + [(7, 0, "user", "end")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        assert trie_of(spark, rows) == by_place(plain_trie(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_trie_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(op12_trie.ORACLE_SQL)
    names = [d[0] for d in want.description]
    got = op12_trie.op12_prefix_trie(spark, sf).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_trie_of_an_empty_table(spark):
    assert trie_of(spark, []) == []


def test_ends_of_many_pieces(spark):
    ids = sorted(random.Random(2).sample(range(-200_000, 400_000), 3000))
    family = spark.createDataFrame([(1, 2, 3, ids[i : i + 7]) for i in range(0, len(ids), 7)], "k1 long, k2 long, depth long, ending array<long>")
    (row,) = op12_trie.end_digests(family).collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


# ---- op13 ------------------------------------------------------------------------------------------------------

TOKENIZERS = pytest.importorskip("public_tokenizers")
PATHS = TOKENIZERS.path("byte_bpe_50k.json"), TOKENIZERS.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain_alignment():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    alphabet = op13_alignment.byte_of_character()

    def spans(tokens):
        end, out = 0, []
        for i, data in tokens:
            out.append((end, end + len(data), i))
            end += len(data)
        return out

    def align(text):
        if not text:
            return None
        own = (" " + text).encode()
        left = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
        if b"".join(x for _, x in left) != own or b"".join(x for _, x in right) != own:
            return None
        left, right = spans(left), spans(right)
        groups, low = [], 0
        for end in sorted({e for _, e, _ in left} & {e for _, e, _ in right}):
            groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= end) for side in (left, right)))
            low = end
        links = [(i, j) for s, e, i in left for x, y, j in right if s < y and x < e]
        return len(left), len(right), groups, links

    return align


def test_alignment_on_awkward_texts(spark, plain_alignment):
    rng = random.Random(3)
    parts = ["a", "B", "the", " ", "  ", "\n", "\n\n", "\t", "\r\n", ";\r\n", "1", "23", "!", "'s", "é", "ß", "中", "😀", "　", "\xa0", "▁", "<0x41>", "<s>", "<|endoftext|>", "\x00", "\x1c", "\x85", "_", "();", "​", "ﬁ", " "]
    texts = [None, "", " ", "\n", "a a a", "a a a", "x" * 3000, "word " * 2000] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 15))) for _ in range(250)]
    rows = [(None if i == 4 else i, t, 1, 2) for i, t in enumerate(texts)]
    found = {i: plain_alignment(t) for i, t, *_ in rows}
    holders, highest = {}, {}
    for f in filter(None, found.values()):
        for pair in set(f[3]):
            holders[pair] = holders.get(pair, 0) + 1
    for (a, _), n in holders.items():
        highest[a] = max(highest.get(a, 0), n)

    def row(i):
        if found[i] is None:
            return (i, 0, 0, 0, 0, 0, 0, "")
        n_a, n_b, groups, links = found[i]
        return (i, n_a, n_b, len(groups), len(links), sum(holders[x] == highest[x[0]] for x in links), sum(holders[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest())

    expected = sorted(map(row, found), key=repr)
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair long, row long").repartition(3)
    for pairs in (op13_alignment.BROADCAST_PAIRS, 0):  # looked up, and joined
        got = op13_alignment.alignment(docs, *PATHS, broadcast_pairs=pairs).collect()
        assert sorted(map(tuple, got), key=repr) == expected
    assert op13_alignment.alignment(docs.where(F.lit(False)), *PATHS).collect() == []


def test_a_store_of_units_that_is_too_small(monkeypatch):
    """Units that the store forgets are learnt again."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "a"]) + str(rng.randrange(200)) for _ in range(60)) for _ in range(40)]
    whole = op13_alignment.Aligner(*PATHS)
    expected = [whole.documents([t]) for t in texts]
    monkeypatch.setattr(op13_alignment, "STORE_UNITS", 50)
    small = op13_alignment.Aligner(*PATHS)
    for text, want in zip(texts, expected, strict=True):
        for a, b in zip(small.documents([text]), want, strict=True):
            assert np.array_equal(a, b)
    assert len(small.number) < 150


def test_transducer_on_any_cuts():
    """Two random cuts of one byte string: groups end where both cuts do, links are overlaps."""
    rng = random.Random(4)
    for _ in range(300):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30)))

        def cut():
            ends = sorted({*rng.sample(range(1, len(data) + 1), rng.randrange(len(data))), len(data)})
            return [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]

        a, b = cut(), cut()
        groups, links = op13_alignment.Transducer((a, b)).align(list(range(len(a))), list(range(len(b))))
        at = lambda side: [(sum(map(len, side[:i])), sum(map(len, side[: i + 1]))) for i in range(len(side))]
        overlaps = {(i, j) for i, (s, e) in enumerate(at(a)) for j, (x, y) in enumerate(at(b)) if s < y and x < e}
        assert sorted(links) == sorted(overlaps)
        assert len(groups) == len({e for _, e in at(a)} & {e for _, e in at(b)})
        assert op13_alignment.Transducer((a, [*b, b"c"])).align(list(range(len(a))), list(range(len(b) + 1))) is None
