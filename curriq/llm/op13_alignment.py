"""Cross-tokenizer alignment: how the tokens of two tokenizers cover the same bytes.

A encodes a space and the text by a byte-level model of the tokenizers library, B the text by a sentencepiece model, which
adds that space. Byte offsets at which tokens of both end cut them into groups; an A token and a B token whose bytes overlap
are linked. An id pair's count is the number of documents that hold it linked.

Groups and links come from a transducer over residuals: its state is the side that leads and the leading token's bytes that
the other side hasn't matched yet. The side behind supplies the next token, which is linked to the leading one; what is left
over of the longer of both is the next residual, and an empty one closes the group. Transitions are kept by (state, token).

Texts are cut into units, white space and what follows up to the next white space (a single line end alone): neither tokenizer has a token across
such a cut (where a piece of B's vocabulary would have one, the unit goes on), so a unit's groups are the same wherever it
stands, and a worker keeps them by unit. Beyond a size the store of units
keeps those that it met again, and that of transitions starts anew; this changes nothing else.

Documents' distinct pairs are written once, in packed columns; counts come from sums in tasks before the shuffle. Tasks
then look counts up in a sorted table of all pairs, or, where these are more than BROADCAST_PAIRS, by a join on the pair.

Texts that are null, empty, or whose joined A or B bytes differ from space and text have no tokens: their numbers are 0 and
groups_sha256 is ''; they count for no pair. A row of the table is a document: rows that repeat another count again, and a
null doc_id changes nothing. Columns other than doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curriq.llm.common import cut, keep_one, released, shared_dir, spread, table
from curriq.llm.op4_elias_fano import spans

#: Units and transitions that a worker keeps.
STORE_UNITS, STORE_MOVES = 400_000, 1_000_000
#: Pairs of a table that is sent to all tasks, 24 bytes each; pairs that a task sums up before it passes them on.
BROADCAST_PAIRS, SUM_PAIRS = 4_000_000, 2_000_000
#: Bytes of units that B encodes in one call.
CALL_BYTES = 1 << 16

#: White space as both tokenizers' patterns see it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def byte_of_character() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Transducer:
    """States are (side that leads, residual), numbered as they are met; 0 is the empty residual."""

    A, B = 0, 1

    def __init__(self, token_bytes: tuple[list[bytes], list[bytes]]):
        self.token_bytes = token_bytes
        self._start()

    def _start(self) -> None:
        self.states: list[tuple[int, bytes]] = [(self.B, b"")]  # with nothing left over, A supplies the next token
        self.numbers = {self.states[0]: 0}
        self.moves: dict[tuple[int, int], int] = {}

    def _move(self, state: int, token: int) -> int:
        """The state after the side behind has supplied token; -1 if its bytes aren't those of the residual."""
        lead, residual = self.states[state]
        own = self.token_bytes[1 - lead][token]
        if residual.startswith(own) and state:
            new = (lead, residual[len(own) :])
        elif own.startswith(residual):
            new = (1 - lead, own[len(residual) :])
        else:
            return -1
        if not new[1]:
            return 0
        if new not in self.numbers:
            self.numbers[new] = len(self.states)
            self.states.append(new)
        return self.numbers[new]

    def align(self, a: list[int], b: list[int]) -> tuple[list[str], list[tuple[int, int]]] | None:
        """(groups, as `a1,a2|b1`, and links) of two tokenizations; None if their bytes differ."""
        if len(self.moves) > STORE_MOVES:
            self._start()
        groups, links = [], []
        moves, states = self.moves, self.states
        names_a, names_b = list(map(str, a)), list(map(str, b))
        i = j = i0 = j0 = state = 0
        n, m = len(a), len(b)
        while i < n or j < m:
            from_a = states[state][0]  # B leads or nothing is left over: A's turn
            if from_a:
                if i == n:
                    return None
                token = a[i]
                if state:
                    links.append((token, b[j - 1]))
                i += 1
            else:
                if j == m:
                    return None
                token = b[j]
                links.append((a[i - 1], token))
                j += 1
            new = moves.get((state, token))
            if new is None:
                new = moves[state, token] = self._move(state, token)
            if new <= 0:
                if new < 0:
                    return None
                groups.append(",".join(names_a[i0:i]) + "|" + ",".join(names_b[j0:j]))
                i0, j0 = i, j
            state = new
        return None if state else (groups, links)


class Aligner:
    """Groups and links of units, kept in flat arrays."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        table_ = byte_of_character()
        a_bytes = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            a_bytes[i] = bytes(table_[c] for c in entry) if all(c in table_ for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_b, self.all_pairs, self.transducer = len(b_bytes), len(a_bytes) * len(b_bytes), Transducer((a_bytes, b_bytes))
        # white space before which some piece of B goes on; a line end among them would need whole texts
        glued = {m for p in pieces for m in re.findall(f"[^{WHITE}▁]([{WHITE}▁])", p)}
        on = "".join(sorted(re.escape(c.replace("▁", " ")) for c in glued))
        more = f"(?:[{on}][{WHITE}]*[^{WHITE}]*)*" if on else ""
        self.units = re.compile(f"\n(?=[^{WHITE}])|[{WHITE}]*[^{WHITE}]+{more}|[{WHITE}]+")
        self.simple = re.compile(f" ?[^{WHITE}]+")
        self.white = re.compile(f"[{WHITE}]")
        if any("\n" in p for p in pieces) or len(self.b.encode("\n")) != 2:
            raise ValueError("B must take a line end as one token that no other merges with")
        self._start()

    def _start(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[bytes] = []  # groups, as they are hashed
        self.sizes = array("q")  # of each unit: 1 if both tokenizers give its bytes, ids of A and B, groups, links
        self.links, self.uses = array("q"), array("q")

    def _ids(self, plain: list[str], odd: list[str], encode) -> list[list[int]]:
        """Ids of units as they stand inside a text, plain ones first. Plain units have no white space but a leading space:
        they are encoded together, parted by line ends, which no token crosses. Before an odd one stands a letter, or a
        line end if it doesn't begin with white space, whose ids go again."""
        first = {lead: len(encode(lead)) for lead in "a\n"}
        end = encode("\n")[-1]
        out: list[list[int]] = []
        start = 0
        while start < len(plain):
            stop, size = start, 0
            while stop < len(plain) and size <= CALL_BYTES:
                size += len(plain[stop])
                stop += 1
            ids = encode("\n" + "\n".join(plain[start:stop]))
            ends = np.flatnonzero(np.array(ids, dtype=np.int64) == end).tolist()
            if len(ends) != stop - start:
                raise ValueError("a unit without line ends was encoded with one")
            out += [ids[x + 1 : y] for x, y in zip(ends, [*ends[1:], len(ids)], strict=True)]
            start = stop
        leads = ["a" if self.white.match(unit) else "\n" for unit in odd]
        return out + [encode(lead + unit)[first[lead] :] for lead, unit in zip(leads, odd, strict=True)]

    def learn(self, units: list[str]) -> None:
        simple = self.simple.fullmatch
        plain, odd = [u for u in units if simple(u)], [u for u in units if not simple(u)]
        ids_a = self._ids(plain, odd, lambda t: self.a.encode_batch_fast([t], add_special_tokens=False)[0].ids)
        ids_b = self._ids(plain, odd, self.b.encode)
        a_bytes, size_b, align = self.transducer.token_bytes[0], self.size_b, self.transducer.align
        sizes = []
        for unit, a, b in zip(chain(plain, odd), ids_a, ids_b, strict=True):
            found = align(a, b) if b"".join([a_bytes[i] for i in a]) == unit.encode("utf-8", "surrogatepass") else None
            groups, links = found or ([], [])
            self.number[unit] = len(self.texts)
            self.texts.append(";".join(groups).encode())
            sizes += (found is not None, len(a), len(b), len(groups), len(links))
            self.links.extend([x * size_b + y for x, y in links])
        self.sizes.extend(sizes)
        self.uses.extend([0] * len(units))

    def forget(self) -> None:
        """Keep the units that were met more than once since the store was last made smaller, up to half of it."""
        uses, sizes = np.frombuffer(self.uses, np.int64), np.frombuffer(self.sizes, np.int64).reshape(-1, 5)
        kept = np.flatnonzero(uses > 1)
        if len(kept) > STORE_UNITS // 2:
            kept = np.sort(kept[np.argsort(-uses[kept], kind="stable")[: STORE_UNITS // 2]])
        starts = np.cumsum(sizes[:, 4]) - sizes[:, 4]
        links, _ = spans(np.frombuffer(self.links, np.int64), starts[kept], sizes[kept, 4])
        texts, chosen = [self.texts[i] for i in kept.tolist()], sizes[kept]
        names = list(self.number)  # in order of their numbers
        number = {names[i]: k for k, i in enumerate(kept.tolist())}
        self._start()
        self.number, self.texts = number, texts
        self.sizes.frombytes(chosen.tobytes())
        self.links.frombytes(links.tobytes())
        self.uses.frombytes(np.zeros(len(kept), np.int64).tobytes())

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts: numbers (rows n_a, n_b, n_groups, n_links), groups_sha256; and the distinct pairs of each text in
        order, their links, and where each text's pairs end."""
        if len(self.number) > STORE_UNITS:
            self.forget()
        cuts = [self.units.findall(" " + t) if t else [] for t in texts]
        new = set(chain.from_iterable(cuts)).difference(self.number)
        if new:
            self.learn(list(new))
        count = np.fromiter(map(len, cuts), dtype=np.int64, count=len(cuts))
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cuts)), dtype=np.int64, count=int(count.sum()))
        owner = np.repeat(np.arange(len(cuts)), count)
        sizes, uses = np.frombuffer(self.sizes, np.int64).reshape(-1, 5), np.frombuffer(self.uses, np.int64)
        uses += np.bincount(at, minlength=len(uses))
        good = count > 0
        good[owner[sizes[at, 0] == 0]] = False
        ends = np.cumsum(count).tolist()
        said = [hashlib.sha256(b";".join([self.texts[i] for i in at[e - n : e].tolist()])).hexdigest() if fine else "" for e, n, fine in zip(ends, count.tolist(), good.tolist(), strict=True)]
        at, owner = at[good[owner]], owner[good[owner]]
        numbers = np.stack([np.bincount(owner, weights=sizes[at, k], minlength=len(cuts)) for k in range(1, 5)]).astype(np.int64)
        pairs, count = spans(np.frombuffer(self.links, np.int64), (np.cumsum(sizes[:, 4]) - sizes[:, 4])[at], sizes[at, 4])
        pairs = np.sort(pairs + np.repeat(owner * self.all_pairs, count))
        firsts = np.flatnonzero(np.diff(pairs, prepend=-1))
        times = np.diff(firsts, append=len(pairs))
        owner, pairs = np.divmod(pairs[firsts], self.all_pairs)
        return numbers, said, pairs, times, np.cumsum(np.bincount(owner, minlength=len(cuts)))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of each one's values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(values, starts)


def narrow(numbers: np.ndarray) -> bytes:
    """Numbers in 1, 2, 4 or 8 bytes each, as the largest needs; that size comes first."""
    most = int(numbers.max()) if len(numbers) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document, with its distinct linked pairs (A id x size of B + B id, as differences) and their links."""

    @released
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        aligner = keep_one("op13", (path_a, path_b), lambda: Aligner(path_a, path_b))
        for batch in batches:
            n = batch.num_rows
            if n:
                numbers, said, pairs, times, ends = aligner.documents(batch.column(1).to_pylist())
                bounds = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
                packed = [[narrow(np.diff(pairs[x:y], prepend=0)) for x, y in bounds], [narrow(times[x:y]) for x, y in bounds]]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column(0), *map(pa.array, numbers), pa.array(said, pa.string()), *(pa.array(c, pa.binary()) for c in packed)], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                row += n

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(rows, ROWS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked)."""

    @released
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        sums = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def fold() -> None:
            nonlocal sums, held, size
            keys = np.concatenate([sums[0], *held])
            sums = summed(keys, np.concatenate([sums[1], np.ones(size, np.int64)]))
            held, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sums[0]), pa.array(sums[1])], ["pair", "count"])

        for batch in batches:
            for data in batch.column(0).to_pylist():
                held.append(np.cumsum(widened(data)))
                size += len(held[-1])
                if size > SUM_PAIRS:
                    fold()
            if len(sums[0]) > SUM_PAIRS:
                yield out()
                sums = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        fold()
        yield out()

    return spread(rows.select("pairs")).mapInArrow(partial, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))


def looked_up(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """row, n_best, count_sum by a table of all pairs that each task holds."""
    found = counts.select("pair", "count", "best").toArrow().sort_by("pair")
    sent = rows.sparkSession.sparkContext.broadcast([c.to_numpy() for c in found.columns])

    @released
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = sent.value
        for batch in batches:
            n_best, count_sum = [], []
            for data, times in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at, n = np.searchsorted(pair, np.cumsum(widened(data))), widened(times)
                n_best.append(int(n[best[at]].sum()))
                count_sum.append(int((n * count[at]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), *(batch.column(i) for i in range(3, 9))], ["row", "n_best", "count_sum", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])

    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return spread(rows.select("row", "pairs", "times", *plain)).mapInArrow(look, "row long, n_best long, count_sum long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string")


def joined(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join on the pair, of which Spark splits frequent ones."""

    @released
    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs = np.cumsum(widened(data))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), row)), pa.array(pairs), pa.array(widened(times))], ["row", "pair", "times"])

    links = spread(rows.select("row", "pairs", "times")).mapInArrow(apart, "row long, pair long, times long")
    sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    both = rows.drop("pairs", "times").join(sums, "row", "left")
    return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})


def alignment(docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    import sentencepiece

    folder = shared_dir(docs.sparkSession)
    rows = cut(aligned(docs, path_a, path_b), folder, "aligned")
    counts = cut(pair_counts(rows), folder, "counts")
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    token = F.floor(F.col("pair") / size_b)
    highest = counts.groupBy(token.alias("a")).agg(F.max("count").alias("highest"))
    marked = counts.withColumn("a", token).join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    found = (looked_up if counts.count() <= broadcast_pairs else joined)(rows, marked)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
