"""Language-model scores by Brown class-based bigrams.

All words that the training texts have LEAST times or more are dealt to classes. The DEALT most frequent of them are in a table
of 17 bytes a word that every worker holds; the others, if any, are dealt by the same rule from grouped counts, and meet their
counts and classes by a join, so the scores are the same whatever DEALT is (from SEED on). The SEED most frequent are dealt by the exchange algorithm, one word at a time, until no
word moves. Every other word then takes the exchange step against these classes, from the classes of all its neighbours in the
corpus, counted by a grouped aggregation: it joins the class that raises the likelihood of the class bigrams most. So the dealt words grow with
the corpus. Words under the cut share one further class, and the end of a text is a class of its own. A text's
probability is the product of
    P(class | class before) * P(word | class):
transitions are interpolated with the classes' shares; in the class of rare words the counts are discounted, and what
this frees is the probability of an unknown word, so the model sums to one over the known words and "unknown".

All texts are read four times: to count words, the seed's bigrams and the neighbours of dealt words, and to write each text as the
classes of its words, a byte each, from which the class bigrams and the scores come; once more for the neighbours of words beyond
the table, if there are any. Only bounded data reach the driver and the workers: the table's words as 64-bit hashes with counts and
classes, the seed's bigram matrix and the class bigrams. Words beyond them meet their counts and classes by a join, and none of them
can have more than a small share of all tokens.

Cases: null counts as empty, which has the end token only. A row's numbers never mix with those of another row of the
same id. Null ids count as the empty string for the fold. With no training text every word is unknown. Texts of any length are
read and scored whole. Of words with equal counts those with smaller hashes come first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlake.llm.rows import id_and_text
from quernlake.llm.words import chunks, steps
from quernlake.shared import Written, write_shared

#: Words whose counts and classes every worker holds, at most (others are joined), and how often a word must occur to be dealt to a class.
DEALT, LEAST = 1_000_000, 10
#: Words that the exchange algorithm moves one at a time.
SEED = 1_000
CLASSES = 48
#: Bytes of text whose distinct words are looked up at once.
STEP_BYTES = 10_000_000
#: Classes of words, a byte each, that are handled at once.
STEP_CODES = 2_000_000
#: Neighbour counts that a task holds before it adds them up and hands them on.
HELD = 3_000_000
#: Weight of a class's share against its counted transitions.
PRIOR_WEIGHT = 4.0
#: The end token among the counted words: no word has a space.
END = " "
_BOUND, _RARE = 0, 1


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _cut(batch: pa.RecordBatch):
    return chunks(pc.ascii_lower(batch.column("text")))


def word_counts(train: DataFrame) -> Written:
    """(word, n) over the training texts, the end token among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = 0
        for batch in steps(batches, step_bytes=STEP_BYTES):
            words, which, _ = _cut(batch)
            texts += batch.num_rows
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(which, minlength=len(words)).astype(np.int64))], ["word", "n"])
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([texts], pa.int64())], ["word", "n"])

    return write_shared(train.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")


@dataclass
class Totals:
    tokens: int
    types: int
    once: int
    twice: int
    texts: int


def _totals(counts: DataFrame) -> Totals:
    sum_of = lambda c: F.coalesce(F.sum(c), F.lit(0))
    row = counts.agg(sum_of("n"), F.count(F.lit(1)), F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1)), sum_of(F.when(F.col("word") == END, F.col("n")))).first()
    return Totals(*map(int, row))


@dataclass
class Dealt:
    """The words of a table, by their hashes ascending, with counts and classes."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each word is, and whether it is there."""
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))
        if not len(self.hashes):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        return at, self.hashes[at] == hashed

    def class_of(self, words: pa.Array) -> np.ndarray:
        return self.class_at(*self.find(words))

    def class_at(self, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Classes of the words that `find` found there."""
        return np.where(there, self.classes[at] if len(self.classes) else _RARE, _RARE).astype(np.int64)


def frequent_words(counts: DataFrame, limit: int, least: int) -> tuple[Dealt, bool]:
    """The `limit` most frequent words that occur `least` times or more, in the class of the rare, and whether there are more such words.

    A histogram of some hundred steps finds the step where the limit falls, one of that step's counts the count, and there the
    smallest hashes are taken.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(1.1)).cast("int")
    words = counts.where((F.col("word") != END) & (F.col("n") >= least))
    total, edge, share = 0, 0, 1.0
    for at, many in sorted(words.groupBy(step.alias("at")).count().collect(), reverse=True):
        if total + many > limit:
            for edge, same in sorted(words.where(step == at).groupBy("n").count().collect(), reverse=True):
                if total + same > limit:
                    room = limit - total
                    share = min(1.0, (room + 10 * math.sqrt(room) + 100) / same)  # of the hashes, with more than enough words
                    break
                total += same
            break
        total += many
    highest = min(int(share * 2**64), 2**64 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, batch.column("word").to_pylist()), np.uint64, batch.num_rows)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            use = (n > edge) | (hashed <= np.uint64(highest))
            yield pa.RecordBatch.from_arrays([pa.array(hashed[use].view(np.int64)), pa.array(n[use])], ["hash", "n"])

    found = words.where(F.col("n") >= edge).mapInArrow(run, "hash long, n long").toArrow()
    hashes, n = found.column("hash").to_numpy().view(np.uint64), found.column("n").to_numpy()
    first = np.lexsort((hashes, -n))[:limit]
    order = first[np.argsort(hashes[first], kind="stable")]
    return Dealt(hashes[order], n[order], np.full(len(order), _RARE, np.uint8)), edge > 0


def _bigrams(rows: DataFrame, sequences: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, int]]], size: int) -> np.ndarray:
    """Counts of neighbours among `size` codes, over sequences of so many texts each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for sequence, texts in sequences(batches):
            total += np.bincount(sequence[:-1] * size + sequence[1:], minlength=size * size)
            total[_BOUND * size + _BOUND] -= texts - 1  # the end of a text beside the start of the next
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 100_000].astype(np.int32)), pa.array(total[at[k : k + 100_000]])], ["cell", "n"])

    cells = rows.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n != 0").toArrow()
    matrix = np.zeros(size * size, np.int64)
    matrix[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return matrix.reshape(size, size)


def bigram_matrix(train: DataFrame, dealt, size: int) -> np.ndarray:
    """Counts of neighbours among `size` classes of a broadcast Dealt, with the rare class and the bounds of texts."""

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
        for batch in steps(batches, step_bytes=STEP_BYTES):
            words, which, offsets = _cut(batch)
            yield _sequence(dealt.value.class_of(words)[which], offsets)[0], batch.num_rows

    return _bigrams(train.select("text"), sequences, size)


def _sequence(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all texts, each text between two bounds of its own; and where each text's start bound is."""
    count = len(offsets) - 1
    starts = offsets[:-1] + 2 * np.arange(count)
    sequence = np.full(len(codes) + 2 * count, _BOUND, np.int64)
    inside = np.ones(len(sequence), bool)
    inside[starts] = inside[offsets[1:] + 2 * np.arange(count) + 1] = False
    sequence[inside] = codes
    return sequence, starts


def _gains(pairs: np.ndarray, right: np.ndarray, left: np.ndarray, self_pair: float) -> np.ndarray:
    """What a word that is in no class adds to the likelihood of the class bigrams in each class: right and left are the classes of its neighbours."""
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    rows, cols, diagonal = pairs.sum(1), pairs.sum(0), np.diag(pairs)
    gain = (f(pairs + right) - f(pairs)).sum(1) + (f(pairs + left[:, None]) - f(pairs)).sum(0)
    gain += f(diagonal + right + left + self_pair) + f(diagonal) - f(diagonal + right) - f(diagonal + left)
    rows, cols = rows + left, cols + right  # wherever the word goes, what stands before and after it counts there
    return gain - (f(rows + right.sum() + self_pair) - f(rows) + f(cols + left.sum() + self_pair) - f(cols))


def _gains_of_rare(pairs: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The same (but for a word beside itself) for a word whose counts `pairs` has in the rare class, right in the classes other than that: only those of its neighbours are looked at."""
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    after, before = np.flatnonzero(right), np.flatnonzero(left)
    rows, cols = pairs[:, after], pairs[before]
    rows[:, after == _RARE] -= left[:, None]
    cols[before == _RARE] -= right[None, :]
    d = np.diag(pairs)
    gain = (f(rows + right[after]) - f(rows)).sum(1) + (f(cols + left[before][:, None]) - f(cols)).sum(0)
    gain += f(d + right + left) + f(d) - f(d + right) - f(d + left)
    out, into = pairs.sum(1), pairs.sum(0)  # what the rare class gives up here comes back with the word
    return gain - (f(out + right.sum()) - f(out) + f(into + left.sum()) - f(into))


def _choose(pairs: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (word, cells) with the counts of each word's neighbours by class, those after it first: (word, class), by the exchange step."""
    size, table = len(pairs), pairs.astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("cells")
            owner, cells = lists.value_parent_indices().to_numpy(), lists.flatten()
            own = np.zeros((batch.num_rows, 2 * size))
            np.add.at(own, (owner, cells.field(0).to_numpy(zero_copy_only=False)), cells.field(1).to_numpy(zero_copy_only=False).astype(float))
            best = [2 + int(np.argmax(_gains_of_rare(table, right, left)[2:])) for right, left in zip(own[:, :size], own[:, size:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(best, pa.int32())], ["word", "class"])

    return run


def _places(which: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each word of all texts is in their sequence."""
    return np.arange(len(which)) + np.repeat(2 * np.arange(len(offsets) - 1), np.diff(offsets)) + 1


def deal_by_neighbours(train: DataFrame, dealt, pairs: np.ndarray) -> np.ndarray:
    """A class for each word of a broadcast Dealt: words of the rare class take the exchange step against `pairs`, the bigrams of its classes; others stay."""
    size = len(pairs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def summed() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            return pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(np.diff(np.append(first, len(keys))).astype(np.int32))], ["cell", "n"])

        for batch in steps(batches, step_bytes=STEP_BYTES):
            words, which, offsets = _cut(batch)
            at, there = dealt.value.find(words)
            code = np.where(there, at, -1)
            open_word = there & (dealt.value.classes[at] == _RARE) if len(dealt.value.hashes) else there
            classes, _ = _sequence(dealt.value.class_at(at, there)[which], offsets)
            place = _places(which, offsets)
            use = open_word[which]
            word, place = code[which][use], place[use]
            held += [word * (2 * size) + classes[place + 1], word * (2 * size) + size + classes[place - 1]]
            total += 2 * len(word)
            if total > HELD:
                yield summed()
                held, total = [], 0
        if total:
            yield summed()

    cells = train.select("text").mapInArrow(count, "cell long, n int").groupBy("cell").agg(F.sum("n").alias("n"))
    word, cell = F.floor(F.col("cell") / F.lit(2 * size)).cast("long"), F.pmod("cell", F.lit(2 * size)).cast("int")
    vectors = cells.groupBy(word.alias("word")).agg(F.collect_list(F.struct(cell.alias("cell"), "n")).alias("cells"))  # at most 2 * size entries a word
    found = vectors.mapInArrow(_choose(pairs), "word long, class int").toArrow()
    classes = dealt.value.classes.copy()
    classes[found.column("word").to_numpy()] = found.column("class").to_numpy()
    return classes


def deal_beyond(train: DataFrame, dealt, pairs: np.ndarray, words: DataFrame) -> DataFrame:
    """(word, class) by the same rule for those of `words` that a broadcast Dealt has not; they are never collected."""
    size = len(pairs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, step_bytes=STEP_BYTES):
            words, which, offsets = _cut(batch)
            at, there = dealt.value.find(words)
            classes, _ = _sequence(dealt.value.class_at(at, there)[which], offsets)
            use = ~there[which]
            word, place = which[use], _places(which, offsets)[use]
            keys, n = np.unique(np.concatenate([word * (2 * size) + classes[place + 1], word * (2 * size) + size + classes[place - 1]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(keys // (2 * size))), pa.array((keys % (2 * size)).astype(np.int32)), pa.array(n.astype(np.int64))], ["word", "cell", "n"])

    cells = train.select("text").mapInArrow(count, "word string, cell int, n long").join(words.select("word"), "word", "left_semi")
    vectors = cells.groupBy("word", "cell").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    return write_shared(vectors.mapInArrow(_choose(pairs), "word string, class int"), "lm-beyond").frame


def exchange(matrix: np.ndarray, classes: int, sweeps: int | None = None) -> np.ndarray:
    """A class for each row of the matrix by the exchange algorithm, until no row moves (or for so many sweeps); the bounds and the rare words keep classes 0 and 1."""
    size = len(matrix)
    of = np.concatenate([[_BOUND, _RARE], 2 + np.arange(max(0, size - 2)) % max(1, classes)]).astype(np.int64)[:size]
    total = classes + 2
    member = np.zeros((size, total))
    member[np.arange(size), of] = 1
    m = matrix.astype(float)
    pairs = member.T @ m @ member
    moved, sweep = 1, 0
    while moved and (sweeps is None or sweep < sweeps):  # each move raises the likelihood, so this ends
        moved, sweep = 0, sweep + 1
        for w in range(2, size):
            own = of[w]
            member[w, own] = 0
            right, left, self_pair = m[w] @ member, m[:, w] @ member, m[w, w]
            pairs[own] -= right
            pairs[:, own] -= left
            pairs[own, own] -= self_pair
            gain = _gains(pairs, right, left, self_pair)
            best = 2 + int(np.argmax(gain[2:]))
            if gain[best] <= gain[own] + 1e-9 * max(1.0, abs(gain[own])):
                best = own
            moved += best != own
            of[w] = best
            member[w, best] = 1
            pairs[best] += right
            pairs[:, best] += left
            pairs[best, best] += self_pair
    return of


@dataclass
class Model:
    """What the workers need: the table's words with counts and classes, log10 transitions, and the constants of both scores."""

    totals: Totals
    dealt: Dealt
    transitions: np.ndarray
    class_tokens: np.ndarray
    rare_tokens: int
    rare_types: int
    texts: int
    discount: float

    def base(self, n):
        return np.log10((n + 1.0) / (self.totals.tokens + self.totals.types + 1.0))


def learn_classes(train: DataFrame, dealt_limit: int = DEALT, seed: int = SEED, classes: int = CLASSES, least: int = LEAST) -> tuple[Model, DataFrame]:
    """Counts and clusters over all rows of `train`: the model but for its transitions, and (word, n, class) of all words, with a class where a word is dealt but not in the model's table."""
    spark = train.sparkSession
    counts = word_counts(train).frame
    totals = _totals(counts)
    dealt, more = frequent_words(counts, dealt_limit, least)
    first = np.sort(np.lexsort((dealt.hashes, -dealt.counts))[:seed])
    share = lambda d: spark.sparkContext.broadcast(d)
    own = Dealt(dealt.hashes[first], dealt.counts[first], np.arange(2, len(first) + 2))
    matrix = bigram_matrix(train, share(own), len(first) + 2)
    of = exchange(matrix, classes)
    dealt.classes[first] = of[2:]
    pairs = np.zeros((classes + 2, classes + 2), np.int64)  # of the seed's classes, all other words rare
    np.add.at(pairs, (of[:, None], of[None, :]), matrix)
    before = share(dealt)
    if len(first) < len(dealt.hashes):
        dealt = Dealt(dealt.hashes, dealt.counts, deal_by_neighbours(train, before, pairs))
    class_tokens = np.bincount(dealt.classes, weights=dealt.counts, minlength=classes + 2)
    types = len(dealt.hashes)
    known = counts.withColumn("class", F.lit(None).cast("int"))
    if more:
        known = counts.join(deal_beyond(train, before, pairs, counts.where((F.col("word") != END) & (F.col("n") >= least))), "word", "left")
        for c, n, many in known.where("class IS NOT NULL").groupBy("class").agg(F.sum("n"), F.count(F.lit(1))).collect():
            class_tokens[c] += n
            types += many
    rare_tokens = totals.tokens - totals.texts - int(class_tokens.sum())
    rare_types = max(0, totals.types - types - (totals.texts > 0))
    discount = totals.once / (totals.once + 2 * totals.twice) if totals.once else 0.5
    return Model(totals, dealt, np.zeros((classes + 2, classes + 2)), np.maximum(1, class_tokens), rare_tokens, rare_types, totals.texts, min(discount, 0.99)), known


def code_texts(docs: DataFrame, model: Model, counts: DataFrame) -> Written:
    """Each row of (doc_id, text, held_out) as the classes of its words, a byte each, with the sums of both scores that need no transitions.

    `placed` has the classes that the join found: which of the text's rare bytes each is for.
    """
    t, shared = model.totals, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, model = TaskContext.get().partitionId() << 40, shared.value
        for batch in steps(batches, step_bytes=STEP_BYTES):
            words, which, offsets = _cut(batch)
            at, known = model.dealt.find(words)
            n = np.where(known, model.dealt.counts[at] if len(model.dealt.counts) else 0, 0).astype(float)
            c = model.dealt.class_at(at, known)
            emit = np.log10(np.maximum(n, 1)) - np.log10(model.class_tokens[c])
            per = np.stack([np.where(known, model.base(n), 0.0), np.where(known, emit, 0.0), known.astype(float)])[:, which]
            sums = np.concatenate([np.zeros((3, 1)), np.cumsum(per, axis=1)], axis=1)
            base, emitted, n_known = sums[:, offsets[1:]] - sums[:, offsets[:-1]]
            count = batch.num_rows
            tail = ~known[which]
            tails = np.concatenate([[0], np.cumsum(tail)])[offsets].astype(np.int32)
            codes = pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(c.astype(np.uint8)[which])])
            rows = row + np.arange(count)
            row += count
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(offsets) + 1), pa.array(n_known.round().astype(np.int64)), pa.array(base), pa.array(emitted), codes, pa.ListArray.from_arrays(pa.array(tails), words.take(pa.array(which[tail])))],
                ["row", "doc_id", "held_out", "n_tokens", "hot_known", "hot_base", "hot_score", "codes", "tail"],
            )

    texts = write_shared(docs.select("doc_id", "text", "held_out").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, hot_known long, hot_base double, hot_score double, codes binary, tail array<string>"), "lm-texts")
    n, rare_log = F.coalesce(F.col("n"), F.lit(0)), math.log10(model.rare_tokens + 1)
    unknown = math.log10(model.discount * model.rare_types + 1) - rare_log
    class_logs = F.array(*[F.lit(float(x)) for x in np.log10(model.class_tokens)])
    emit = F.when(F.col("n").isNull(), F.lit(unknown)).when(F.col("class").isNull(), F.log10(n - F.lit(model.discount)) - F.lit(rare_log)).otherwise(F.log10(n.cast("double")) - F.get(class_logs, F.col("class")))
    tail = texts.frame.select("row", F.posexplode("tail").alias("at", "word")).join(counts, "word", "left").groupBy("row").agg(
        F.count("n").alias("tail_known"),
        F.sum(F.log10((n + 1.0) / float(t.tokens + t.types + 1))).alias("tail_base"),
        F.sum(emit).alias("tail_score"),
        F.collect_list(F.when(F.col("class").isNotNull(), F.struct("at", "class"))).alias("placed"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    end_known, end_base = 1 if model.texts > 0 else 0, float(model.base(model.texts))
    coded = texts.frame.drop("tail").join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + zero("tail_known") + end_known).cast("long").alias("n_known"),
        (F.col("hot_base") + zero("tail_base") + F.lit(end_base)).cast("double").alias("base_score"), (F.col("hot_score") + zero("tail_score")).cast("double").alias("emitted"), "codes", "placed",
    )
    found = write_shared(coded, "lm-coded")
    texts.drop()
    return found


def _coded_sequence(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence of coded texts, and where each text's start and end bounds are."""
    column = batch.column("codes").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    codes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].astype(np.int64) if offsets[-1] > offsets[0] else np.empty(0, np.int64)
    offsets = offsets - offsets[0]
    placed = batch.column("placed")
    cells = placed.flatten()
    if len(cells):
        rare = np.flatnonzero(codes == _RARE)
        before = np.searchsorted(rare, offsets[:-1])  # rare bytes of the texts before
        codes[rare[before[placed.value_parent_indices().to_numpy()] + cells.field(0).to_numpy(zero_copy_only=False)]] = cells.field(1).to_numpy(zero_copy_only=False)
    sequence, starts = _sequence(codes, offsets)
    return sequence, starts, offsets[1:] + 2 * np.arange(batch.num_rows) + 1


def with_transitions(model: Model, coded: DataFrame) -> Model:
    """The model with the class transitions of coded training texts."""

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
        for batch in steps(batches, "codes", STEP_CODES):
            yield _coded_sequence(batch)[0], batch.num_rows

    pairs = _bigrams(coded.select("codes", "placed"), sequences, len(model.transitions))
    part = (pairs.sum(0) + 1) / (pairs.sum() + len(pairs))
    return replace(model, transitions=np.log10((pairs + PRIOR_WEIGHT * part) / (pairs.sum(1, keepdims=True) + PRIOR_WEIGHT)))


def score_coded(coded: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of coded texts."""
    transitions = model.transitions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "codes", STEP_CODES):
            sequence, starts, ends = _coded_sequence(batch)
            moves = np.concatenate([[0.0], np.cumsum(transitions[sequence[:-1], sequence[1:]])])
            score = batch.column("emitted").to_numpy(zero_copy_only=False) + moves[ends] - moves[starts]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    found = coded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def train_model(train: DataFrame, dealt_limit: int = DEALT, seed: int = SEED, classes: int = CLASSES, least: int = LEAST) -> tuple[Model, DataFrame]:
    """Counts, clusters and smooths over all rows of `train`; also gives the table of all words' counts, with the classes of those that the model's own table has not."""
    model, counts = learn_classes(train, dealt_limit, seed, classes, least)
    coded = code_texts(train.select(F.lit(0).cast("long").alias("doc_id"), "text", F.lit(False).alias("held_out")), model, counts)
    model = with_transitions(model, coded.frame)
    coded.drop()
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of (doc_id, text, held_out)."""
    return score_coded(code_texts(docs, model, counts).frame, model)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """Learns from the rows outside the held-out fold and scores all rows, which are coded once for both."""
    rows = id_and_text(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
    model, counts = learn_classes(rows.where(~F.col("held_out")), **sizes)
    coded = code_texts(rows, model, counts).frame
    return score_coded(coded, with_transitions(model, coded.where(~F.col("held_out"))))
