"""One row a pair: prompts and completions against a plain rendering, pieces of long pairs, neighbours of sparse ids."""

import random

from curriq.llm import op6_preferences as op6


def plain(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    text = lambda turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for _, r, t in turns)

    def loss(turns):
        at, spans = 0, []
        for turn in turns:
            end = at + len(text([turn]))
            spans += [f"{at}:{end}"] if turn[1] == "assistant" else []
            at = end
        return ",".join(spans)

    return text(chosen[:n]), text(chosen[n:]), text(rejected[n:]), loss(chosen[n:]), loss(rejected[n:])


def test_pairs_against_plain_rendering(spark):
    r = random.Random(3)
    sides = {}
    for pair in range(30):
        turns = [(i, r.choice(["user", "assistant"]), r.choice(["é", "ja", "", "long " * 9])) for i in range(r.randint(1, 9))]
        other = turns[: r.randint(0, len(turns))] + [(i + 20, "assistant", r.choice(["x", "yy"])) for i in range(r.randint(0, 3))]
        sides[pair] = (turns, sorted(other))
    frame = lambda side: spark.createDataFrame([(p, *t) for p, s in sides.items() for t in s[side]], "pair_id long, turn long, role string, text string")
    segments = op6.format_preferences(frame(0), frame(1)).cache()
    got = {x.pair_id: (x.prompt, x.chosen, x.rejected, x.chosen_loss, x.rejected_loss) for x in op6.pairs(segments).collect()}
    assert got == {p: plain(*s) for p, s in sides.items()}
    pieces = op6.pairs(segments, piece_bytes=40).orderBy("pair_id", "block", "piece").collect()
    assert len(pieces) > len(sides)
    for p, s in sides.items():
        own = [x for x in pieces if x.pair_id == p]
        assert tuple("".join(col) for col in zip(*[(x.prompt, x.chosen, x.rejected) for x in own])) == plain(*s)[:3]
        assert all(len((x.prompt + x.chosen + x.rejected).encode()) <= 40 + 2 * len("<|assistant|>\n<|end|>\n" + "long " * 9) for x in own)
        for x in own:
            spans = [tuple(map(int, y.split(":"))) for y in x.chosen_loss.split(",") if y]
            assert all(x.chosen[a:b].startswith("<|assistant|>") and x.chosen[a:b].endswith("<|end|>\n") for a, b in spans)


def test_long_conversation_has_blocks(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(3000)]
    chosen, rejected = (spark.createDataFrame([*rows[:-1], (1, 2999, "assistant", last)], "pair_id long, turn long, role string, text string") for last in ("good", "bad"))
    got = op6.pairs(op6.format_preferences(chosen, rejected)).orderBy("block", "piece").collect()
    assert [x.block for x in got] == [0, 1, 2] and [x.chosen for x in got] == ["", "", "<|assistant|>\ngood<|end|>\n"]
    assert "".join(x.prompt for x in got) == "".join(f"<|{r}|>\n{t}<|end|>\n" for _, _, r, t in rows[:-1])
    assert [x.rejected_loss for x in got] == ["", "", f"0:{len(got[2].rejected)}"]


def test_next_conversation_of_sparse_ids(spark):
    ids = [-(1 << 40), 5, 6, 9_000, 1 << 33, 1 << 50]
    conv = spark.createDataFrame([(i, 0, "user", "q") for i in ids] + [(i, 1, "assistant", f"a{i}") for i in ids], "conv_id long, turn long, role string, text string")
    got = {x.pair_id: x.rejected for x in op6.pairs(op6.format_preferences(*op6.swapped_replies(conv))).collect()}
    assert got == {i: f"<|assistant|>\na{n}<|end|>\n" for i, n in zip(ids, [*ids[1:], ids[0]])}
    assert op6.pairs(op6.format_preferences(*op6.swapped_replies(conv.where("conv_id = 5")))).count() == 0
