"""Documents of fewer words than a benchmark item, against brute force."""

import random

import pytest

from curriq.llm import op7_decontaminate as op7
from tests.llm.test_results import jaccard, shingles, words_of


def cases():
    r = random.Random(4)
    items = [(i, " ".join(f"w{r.randrange(60 if i % 3 else 12)}" for _ in range(n))) for i, n in enumerate((1, 3, 4, 5, 6, 9, 10, 11, 15, 24, 25, 39, 59, 60, 60, 200))]
    items += [(100, " ".join(f"x{i}" for i in range(60))), (101, " ".join(["x x x x y"] * 12)), (102, " ".join(f"x{i}" for i in range(57)))]
    docs = [" ".join(f"x{i}" for i in range(55))]
    for _, text in items:
        w = text.split()
        for cut in range(0, max(1, len(w) // 4), max(1, len(w) // 20)):
            docs += [" ".join(w[: len(w) - cut]), " ".join(w[cut:]), " ".join(w[cut // 2 : len(w) - cut + cut // 2])]
            edited = w[cut:]
            edited[r.randrange(len(edited))] = "edited"
            docs.append(" ".join(edited))
    return list(enumerate(docs)), items


def test_short_documents_brute_force(spark):
    docs, items = cases()
    want, whole = {}, 0
    for d, text in docs:
        w = words_of(text)
        for i, item in items:
            n = min(len(words_of(item)), len(w))
            best = max(jaccard(shingles(" ".join(w[p : p + n])), shingles(item)) for p in range(len(w) - n + 1))
            if best >= 0.8:
                want[d, i] = round(best, 9)
                whole += len(w) < len(words_of(item))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in op7.contaminated(a, b).collect()}
    assert got == want and whole > 50
    assert {r.doc_id for r in op7.drop_contaminated(a, b).collect()} == {d for d, _ in docs} - {d for d, _ in want}


@pytest.mark.parametrize("words,similarity", [(55, 51 / 56), (49, 45 / 56), (48, None)])
def test_prefix_of_an_item(words, similarity):
    index = op7.ItemIndex([(7, " ".join(f"w{i}" for i in range(60)))])
    text = " ".join(f"w{i}" for i in range(words))
    assert [(d, i, round(s, 9), p, n) for d, i, s, p, n in index.search(["w1", text, ""])] == ([(1, 7, round(similarity, 9), 0, words)] if similarity else [])
