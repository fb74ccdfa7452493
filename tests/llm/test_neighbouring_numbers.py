"""Numbers in a row: candidates of each, whatever stands beside it."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from curriq.llm import op5_pii as op5
from curriq.llm.common import table

SF2 = "/root/testdata/sf0.01"


def spans(text):
    return {(k, text[s:e]) for s, k, e in op5.candidates(text)}


def test_candidates_of_neighbours():
    assert {(3, "030 1234567"), (3, "030 7654321")} <= spans("Tel. 030 1234567 / 030 7654321")
    assert {(3, "030 1234567"), (3, "030 7654321"), (3, "(040) 5556667")} <= spans("030 1234567 030 7654321 (040) 5556667")
    assert (2, "4111.1111.1111.1111") in spans("card 4111.1111.1111.1111 030 1234567")
    text = "192.168.0.1 030 1234567"
    base = op5.Taken(op5.base_spans(text))
    assert (3, "030 1234567") in {(k, text[s:e]) for s, k, e in op5.candidates(text) if not base.meets(s, e)}


def test_numbers_brute_force():
    r = random.Random(8)
    for _ in range(400):
        text = "".join(r.choice("0123456789 ().-/+x") if r.random() < 0.9 else " " * r.randrange(40) for _ in range(r.randrange(90)))
        want = set()
        for s in range(len(text)):
            for e in range(s + 6, len(text) + 1):
                if sum(c.isdigit() for c in text[s:e]) <= 19 and re.fullmatch(r"[0-9][0-9 ().\-/]*[0-9]", text[s:e]) and not text[e : e + 1].isdigit() and not text[s - 1 : s].isdigit():
                    signed = s > 0 and text[s - 1] in "+(" and not text[s - 2 : s - 1].isdigit()
                    want.add((s - signed, e))
        assert len(got := op5.numbers(text)) == len(set(got)) and set(got) == want, text


def test_names_and_gaps_of_any_length():
    for n in (63, 80, 5000):
        text = "to " + "n" * n + " (at) host.com, 030" + " " * n + "1234567"
        assert (0, text[3 : text.index(",")]) in spans(text) and (3, "030" + " " * n + "1234567") in spans(text)


def test_repeated_rows_change_no_score(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    again = docs
    for _ in range(20):
        again = again.unionByName(docs.where("doc_id < 3"))
    one, two = op5.fit(docs), op5.fit(again)
    assert one.thresholds == two.thresholds and one.prior == two.prior and all((a == b).all() for x, y in zip(one.nodes, two.nodes, strict=True) for a, b in zip(x, y, strict=True))


def test_candidates_grow_with_the_text():
    assert len(op5.candidates("12 " * 10_000)) < 12 * 10_000


@pytest.mark.skipif(not os.path.isdir(SF2), reason="no test tables")
def test_neighbours_are_selected(spark):
    trees = op5.fit(table(spark, SF2, "documents").select("doc_id", "text"))
    for text, want in [
        ("call (030) 123-4567 / (040) 765-4321 now", {"(030) 123-4567", "(040) 765-4321"}), ("card 4111.1111.1111.1111 / 4111.1111.1111.1111 ok", {"4111.1111.1111.1111"}), ("192.168.0.1 (030) 123-4567 now", {"(030) 123-4567"}),
        ("card 4111.1111.1111.1111 ok", {"4111.1111.1111.1111"}),
    ]:
        assert {text[s:e] for s, _, e in op5.added_spans(text, op5.base_spans(text), trees)} == want, text


def test_every_document_and_example_is_learnt(spark):
    """Not only the first thousands: each document counts, and each example of a document that has very many."""
    plain = "mail a.b@example.org, card 4111 1111 1111 1111, code 1234567 or 12.34.56.78.90"
    many = " x ".join(f"{i:07d}" for i in range(700))
    text = F.when(F.col("id") < 10, many).otherwise(plain)
    known = op5.counted_examples(spark.range(7000).select(F.col("id").alias("doc_id"), text.alias("text"))).groupBy("held").agg(F.sum("n").alias("n")).collect()
    each, rest = (sum(1 for _ in op5.examples(t)) for t in (many, plain))
    assert each == 700 and {r["held"]: r["n"] for r in known} == {True: 2 * each + 1398 * rest, False: 8 * each + 5592 * rest}


def test_edges_are_exact_quantiles(spark):
    r = random.Random(3)
    x = np.array([[r.randrange(200), r.random(), 1.0] for _ in range(999)])
    known = spark.createDataFrame([(list(map(float, v)), 1) for v in x], "x array<double>, n long")
    want = [np.unique(np.quantile(c, np.linspace(0, 1, op5.BINS + 1)[1:-1], method="lower")) for c in x.T]
    assert all((a == b).all() for a, b in zip(op5.bin_edges(known, len(x)), want, strict=True))
