"""More languages than the number that was once learnt, and languages with little text."""

import random

from curriq.llm import op3_language as op3


def test_every_language_is_learnt(spark):
    r = random.Random(6)
    rows = []
    for k in range(90):  # an alphabet of its own for each; the later ones have fewer rows
        letters = [chr(0x4E00 + 40 * k + i) for i in range(8)]
        for _ in range(20 if k < 64 else 12):
            rows.append((len(rows), "".join(r.choice(letters) for _ in range(85)), f"l{k:02d}"))
    rows += [(5000, "ab", "brief"), (5001, "", "empty"), (5001, "", "empty"), (5002, "", "late"), *[(5003 + i, "", "late") for i in range(40)], (6000, "a text of some length that comes late", "late")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = op3.fit(docs)
    taught = {lang for i, text, lang in rows if text and op3_bucket(i) != 2}
    assert len(taught) >= 90 and set(net.langs) == taught and {f"l{k:02d}" for k in range(90)} <= taught


def test_more_languages_than_sampled_rows(spark, monkeypatch):
    monkeypatch.setattr(op3, "SAMPLE_DOCS", 3)
    rows = [(i, f"some words of language number {i % 7} and more", f"l{i % 7}") for i in range(200)]
    net = op3.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.langs == [f"l{k}" for k in range(7)]


def op3_bucket(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 4
