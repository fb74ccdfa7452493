"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns for every operator and stage."""

import random

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
from curriq.llm import op10_mix as op10

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Names that the operators use themselves.
CLASH = ("score", "held_out", "class_id", "kept", "target", "start", "size", "bands", "copy", "times", "weight", "key", "bin", "toxic", "quality", "item_id", "spans", "id", "b", "s", "__take")


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(("alpha", "beta", "gamma", "delta", "über", "naïve", "omega")) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    long = words(30_000, 1)
    rows = [
        (1, words(40, 2), "en", "s1"), (1, words(40, 2), "en", "s1"), (2, None, None, None), (3, "", "en", "s1"), (4, long, "de", "s2"), (5, long + " x", "de", "s2"), (None, words(12, 3), "en", "s1"), (None, None, None, None),
        (6, "123 456 !!", "en", "s2"), (7, words(40, 2), "en", None), (8, "one two", "fr", "s3"), (9, "é" * 5000, "fr", "s3"), (10, " \n\t ", "en", "s1"), (11, words(60, 9), None, "s1"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) AS long) AS n_chars", *[f"'c' AS {c}" for c in CLASH])
    return df.cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (1, 0, 1), (8, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, labels):
    got = op1.score(docs, op1.fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert op1.score(docs.limit(0), op1.fit(docs.limit(0), labels)).count() == 0
    assert all(r.score < 1e-9 for r in op1.score(docs, op1.fit(docs, labels.limit(0))).collect())


def test_language(docs):
    got = {(r.doc_id, r.lang_pred): r.score for r in op3.predict(docs, op3.fit(docs)).collect()}
    assert got[(2, "und")] == got[(3, "und")] == got[(6, "und")] == got[(10, "und")] == 0
    assert all(lang in ("en", "de", "fr", "und") for _, lang in got)
    assert {r.lang_pred for r in op3.predict(docs, None).collect()} == {"und"} and op3.fit(docs.limit(0)) is None
    assert op3.predict(docs.limit(0), None).count() == 0


def test_tokens(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    got = op4.token_output(docs, TOKENIZER, shard_ids=5000).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (doc_id, text) in zip(got, rows, strict=True):
        n = len(t.encode(text or "", add_special_tokens=False).ids) + 1
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, at, n)
        at += n
    assert op4.token_output(docs.limit(0), TOKENIZER).count() == 0


def test_pii(docs):
    got = op5.find_personal_data(docs, op5.fit(docs)).collect()
    assert len(got) == docs.count() and {r.spans for r in got} == {""} and op5.fit(docs.limit(0)) is None
    assert op5.find_personal_data(docs.limit(0), None).count() == 0


def test_preferences(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, None, None, None), (2, 0, "user", "a"), (2, 1, "assistant", "c"), (None, 0, "user", "x"), (3, 0, "user", "only")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'c' AS part", "1 AS place", "true AS in_loss", "0 AS pair_id")
    got = sorted((r.pair_id, r.part, r.turn is None, r.rendered, r.in_loss) for r in op6.format_preferences(*op6.swapped_replies(conv)).collect())
    assert got == [
        (1, "chosen", False, "<|assistant|>\nb<|end|>\n", True), (1, "prompt", False, "<|user|>\na<|end|>\n", False), (1, "prompt", True, "<|unknown|>\n<|end|>\n", False), (1, "rejected", False, "<|assistant|>\nc<|end|>\n", True),
        (2, "chosen", False, "<|assistant|>\nc<|end|>\n", True), (2, "prompt", False, "<|user|>\na<|end|>\n", False), (2, "rejected", False, "<|assistant|>\nb<|end|>\n", True),
    ]
    assert op6.format_preferences(*op6.swapped_replies(conv.limit(0))).count() == 0


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, words(40, 2)), (1, words(40, 2)), (2, None), (3, ""), (4, "one two"), (None, words(12, 3)), (6, "never seen words in any text at all")], "item_id long, text string").selectExpr("*", "'c' AS doc_id", "1.0 AS similarity")
    got = {(r.doc_id, r.item_id) for r in op7.contaminated(docs, items).collect()}
    assert got == {(1, 1), (7, 1), (8, 4), (None, None)}
    assert op7.contaminated(docs, items.limit(0)).count() == 0 and op7.contaminated(docs.limit(0), items).count() == 0
    left = op7.drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 2, 3, 4, 5, 6, 9, 10, 11]


def test_near_duplicates(docs):
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in op8.near_duplicate_classes(docs).collect())
    assert got == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 1), (8, 8), (9, 9), (10, 10), (11, 11)]
    assert op8.near_duplicate_classes(docs.limit(0)).count() == 0
    left = op8.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 2, 3, 4, 6, 8, 9, 10, 11]


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://Www.Example.NET/a.html?x#y"), (5, "x://example.net/a"), (None, "https://a.org"), (7, "https://a.org/"), (8, "http://x.example.org/en/12"), (9, "http://COM/fr/://q"), (10, "http://h?q=/de/"), (10, "http://h?q=/de/"), (11, "http://a.com/de/" + "z" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'c' AS host", "'c' AS path", "'c' AS canonical", "1 AS block", "true AS listed")
    got = {(r.page_id, r.host, r.path[:9], r.rule, r.verdict) for r in op9.judge_urls(pages, op9.repeated_urls(pages)).collect()}
    assert got == {
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "www.example.net", "/a.html", None, "block"), (5, "example.net", "/a", None, "block"), (None, "a.org", "", None, "block"), (7, "a.org", "/", "org/", "allow"),
        (8, "x.example.org", "/en/12", "example.org/en/1", "block"), (9, "com", "/fr/://q", "com/fr/", "allow"), (10, "h", "", None, "block"), (11, "a.com", "/de/zzzzz", "com/de/", "block"),
    }
    assert op9.judge_urls(pages.limit(0), op9.repeated_urls(pages.limit(0))).count() == 0


def test_mix(docs, labels):
    got = op10.mix_sources(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in got)
    assert op10.mix_sources(docs.limit(0), labels.limit(0)).count() == 0 and op10.mix_sources(docs, None).count() == docs.count()
    left = op10.mixed_documents(docs, labels)
    assert left.columns == docs.columns and left.count() > 0


def test_top_k(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [1.0]), (None, [1.0, 1.0]), (100, [0.5, -0.25]), (200, [3.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS rank", "3 AS query_id")
    got = [tuple(r) for r in op2.top_k(v, v.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    q = 1024 * 1024
    assert got == [(0, 1, 1, 5 * q), (0, 2, 1, 5 * q), (0, 3, 100, 0), (100, 1, 0, 0), (100, 2, 1, 0), (100, 3, 1, 0), (200, 1, 7, 3 * q)]
    assert op2.top_k(v.limit(0), v.limit(0)).count() == 0


def test_stages(spark, docs, labels, tmp_path):
    """Each stage on the awkward table, written and read again; all but the last keep its columns."""
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(40, 2))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        for k, some in enumerate((plain, plain.limit(0))):
            stage(spark, some, str(tmp_path)).write.parquet(f"{tmp_path}/{name}{k}")
            back = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert name == "token_ids" or back.columns == plain.columns
            assert k == 0 or back.count() == 0
