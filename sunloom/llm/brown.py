"""Brown class-based language model: exchange clustering of words, class transitions, word emissions, text scores.

With c the count of a token in training, N all of them and V the distinct ones, the base model gives a token
P0 = (c + 0.1) / (N + 0.1 (V + 1)); it sums to 1 over the V known tokens and one unknown one. The class model is

    P(w | v) = P(class w | class v) * P0(w) / P0(class w),    P0(class) = sum of P0 over the class,
    P(C | B) = (n(B, C) + K * P0(C)) / (n(B) + K),

unless w is not known: an unknown word has P0 after every class, and what follows it has its base probability. It sums to 1
as well (P0 of classes is taken among known words); its log probability is that of the base plus a term per transition.

Training is four passes, each a shuffle of pre-aggregated counts:
1. counts of tokens, by 64-bit hash of the word;
2. counts of neighbouring pairs among the `CLUSTERED` most frequent words, all others taken together, and the text end;
3. the exchange: in turn a part of these words may move, each to the class that raises the class-bigram likelihood most
   given the classes of all others. Words lie with their neighbours in a table; what reaches the driver is a class per
   exchanged word and a matrix of classes, whatever the size of the corpus;
4. every other word joins the class with the largest class-bigram likelihood, from its counts by the classes around it.
   These words and their classes are a table.

Texts become rows of class numbers once. Counts and classes of the frequent words (`HEAD` at most) are in a broadcast table of
bounded size; occurrences of all other words meet the table of words by a shuffle and go back to their places in the text.
Transitions are counted in the rows of the training texts and then summed in all rows.

Defined cases: null and empty texts are one end token. A row without an id is held out. Rows may repeat, each is scored and
counted. Without training rows both scores are those of the base model, which then gives every token probability 1. Words
whose 64-bit hashes agree count as one word (under 1 in 10^6 for ten million words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunloom.llm.common import output_schema, slices, staged
from sunloom.llm.words import word_hashes

CLUSTERED = 1 << 13
CLASSES = 64
HEAD = 1 << 18
ROUNDS, PARTS = 3, 3
#: K of the transition probabilities.
PRIOR = 20.0
ALPHA = 0.1
#: Words that choose a class at a time, and neighbours that are added up at a time.
WORDS, ENTRIES = 1 << 12, 1 << 14
#: The key of the end of a text.
END = np.uint64(0xE0D0F0A07E57C0DE)


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 10 == 0


def sequences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, END after each text, and where texts start."""
    words = [word_hashes(t) for t in texts]
    lengths = np.array([len(w) + 1 for w in words])
    ends = np.cumsum(lengths)
    keys = np.full(ends[-1], END, np.uint64)
    inside = np.ones(ends[-1], bool)
    inside[ends - 1] = False
    keys[inside] = np.concatenate(words)
    return keys, ends - lengths


class Classes:
    """Keys of the frequent words with their counts, and an id per word: 0.. exchanged, then all others, then the end."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, clustered: int):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        frequent = np.lexsort((self.keys, -self.counts))
        frequent = frequent[self.keys[frequent] != END][:clustered]
        self.n_words = len(frequent)
        #: id of the word at each place: clustered ones by rank, then n_words for the rest, n_words + 1 for the end.
        self.word = np.full(len(keys) + 1, self.n_words, np.int32)
        self.word[frequent] = np.arange(self.n_words)
        self.word[:-1][self.keys == END] = self.n_words + 1

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or the last place if it isn't frequent."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        missing = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        at[missing] = len(self.keys)
        return at

    def words(self, places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        found = self.word[places]
        found[keys == END] = self.n_words + 1
        return found


def token_counts(docs: DataFrame, text: str, folder: str) -> DataFrame:
    """(key, c) over all rows of `docs`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                keys, n = np.unique(sequences(part.column(0).to_pylist())[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "c"])

    return staged(docs.select(text).mapInArrow(run, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c")), folder, "counts")


def head(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the most frequent tokens, `most` at most: all with a count above a limit read off a histogram."""
    step = F.when(F.col("c") < 64, F.col("c")).otherwise(F.floor(F.log2("c") * 16) - 32)
    sizes = sorted(((r.step, r.n, r.low) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("low")).collect()),
                   reverse=True)
    total, limit = 0, None
    for _, n, low in sizes:
        total += n
        if total > most:
            break
        limit = low
    if limit is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counts.where(F.col("c") >= limit).toArrow()
    return found["key"].to_numpy().view(np.uint64), found["c"].to_numpy()


def neighbours(docs: DataFrame, text: str, classes: Classes, folder: str) -> DataFrame:
    """Per word id: the ids that follow it and that it follows, with counts. Lists have an entry per clustered word at most."""
    sent, n_ids = docs.sparkSession.sparkContext.broadcast(classes), classes.n_words + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 32 << 20):
                keys, _ = sequences(part.column(0).to_pylist())
                ids = sent.value.words(sent.value.places(keys), keys).astype(np.int64)
                pairs, n = np.unique(np.append(n_ids - 1, ids[:-1]) * n_ids + ids, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((pairs // n_ids).astype(np.int32)), pa.array((pairs % n_ids).astype(np.int32)), pa.array(n)],
                                                 names=["a", "b", "n"])

    pairs = staged(docs.select(text).mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")), folder, "pairs")
    after = pairs.groupBy(F.col("a").alias("word")).agg(F.collect_list(F.struct("b", "n")).alias("next"))
    before = pairs.groupBy(F.col("b").alias("word")).agg(F.collect_list(F.struct("a", "n")).alias("previous"))
    return staged(after.join(before, "word"), folder, "neighbours")


def _by_class(lists: pa.Array, of: np.ndarray, n: int) -> np.ndarray:
    """Counts by class of the neighbours in each list."""
    offsets = lists.offsets.to_numpy()
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(offsets))
    at = row * n + of[flat.field(0).to_numpy()]
    return np.bincount(at, flat.field(1).to_numpy().astype(float), minlength=len(lists) * n).reshape(-1, n)


def class_pairs(table: DataFrame, of: np.ndarray, n: int) -> np.ndarray:
    """Counts of neighbouring classes: one matrix per task is summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            np.add.at(total, of[batch.column(0).to_numpy()], _by_class(batch.column(1), of, n))
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], names=["a", "b", "n"])

    found = table.select("word", "next").mapInArrow(run, "a int, b int, n double").groupBy("a", "b").agg(F.sum("n").alias("n"))
    out = np.zeros((n, n))
    for row in found.collect():
        out[row.a, row.b] = row.n
    return out


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_class(source: int, right: np.ndarray, left: np.ndarray, own: float, pairs: np.ndarray, movable: int) -> int:
    """The class a word should have: the one with the largest class-bigram likelihood when all other words stay.

    `right` and `left` are its neighbours by class, `own` how often it follows itself, `pairs` the counts of classes. A word
    stays unless another class is better.
    """
    right, left, pairs = right.copy(), left.copy(), pairs.copy()
    pairs[source] -= right
    pairs[:, source] -= left
    pairs[source, source] += own
    right[source] -= own
    left[source] -= own
    m, d = movable, np.arange(movable)
    rows, columns = pairs[:m], pairs[:, :m].T
    gain = (_f(rows + right) - _f(rows)).sum(axis=1) + (_f(columns + left) - _f(columns)).sum(axis=1)
    middle = pairs[d, d]
    gain -= _f(middle + right[:m]) - _f(middle) + _f(middle + left[:m]) - _f(middle)
    gain += _f(middle + right[:m] + left[:m] + own) - _f(middle)
    n_right, n_left = right.sum() + own, left.sum() + own
    # the neighbours' own rows and columns have the word back wherever it goes
    total_row, total_column = pairs.sum(axis=1)[:m] + left[:m], pairs.sum(axis=0)[:m] + right[:m]
    gain -= _f(total_row + n_right) - _f(total_row) + _f(total_column + n_left) - _f(total_column)
    best = int(np.argmax(gain))
    return best if gain[best] > gain[source] + 1e-9 else source


def exchanged(table: DataFrame, n_words: int, classes: int, rounds: int = ROUNDS, parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """A class per word id and the counts of neighbouring classes. Words start dealt out by rank; a part moves at a time."""
    of = np.append(np.arange(n_words) % classes, [classes, classes + 1]).astype(np.int32)
    n = classes + 2
    pairs = class_pairs(table, of, n)
    for step in range(rounds * parts):
        turn = step % parts

        def run(batches: Iterator[pa.RecordBatch], of=of, pairs=pairs, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = batch.column(0).to_numpy()
                right, left = _by_class(batch.column(1), of, n), _by_class(batch.column(2), of, n)
                moved = []
                for k, word in enumerate(words.tolist()):
                    if word < n_words and word // classes % parts == turn:
                        following = batch.column(1)[k].values
                        same = np.flatnonzero(following.field(0).to_numpy() == word)
                        own = float(following.field(1)[int(same[0])].as_py()) if len(same) else 0.0
                        moved.append((word, best_class(int(of[word]), right[k], left[k], own, pairs, classes)))
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in moved], pa.int32()), pa.array([c for _, c in moved], pa.int32())],
                                                 names=["word", "class"])

        of = of.copy()
        for row in table.mapInArrow(run, "word int, class int").collect():
            of[row.word] = row["class"]
        pairs = class_pairs(table, of, n)
    return of, pairs


def contexts(docs: DataFrame, text: str, classes: Classes, of: np.ndarray) -> DataFrame:
    """(key, around, n) of the words that the exchange left out: class before * (classes + 1) + class after, the last for the word itself."""
    sent, n = docs.sparkSession.sparkContext.broadcast((classes, of)), int(of[-1]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, of = sent.value
        for batch in batches:
            for part in slices(batch, 0):
                keys, _ = sequences(part.column(0).to_pylist())
                ids = classes.words(classes.places(keys), keys)
                at = np.flatnonzero(ids == classes.n_words)
                # the last token is an end, and an end stands before the first
                before, after = np.where(keys[at - 1] == keys[at], n, of[ids[at - 1]]), np.where(keys[at + 1] == keys[at], n, of[ids[at + 1]])
                key, around = keys[at], before.astype(np.int32) * (n + 1) + after
                order = np.lexsort((around, key))
                key, around = key[order], around[order]
                first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (around[1:] != around[:-1]))) if len(key) else order
                yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(around[first].astype(np.int32)),
                                                  pa.array(np.diff(np.append(first, len(key))))], names=["key", "around", "n"])

    return docs.select(text).mapInArrow(run, "key bigint, around int, n bigint")


def joined_class(right: np.ndarray, left: np.ndarray, own: np.ndarray, pairs: np.ndarray, source: int, movable: int) -> np.ndarray:
    """The class of 0 .. movable - 1 with the largest class-bigram likelihood for each word of the class `source` by itself.

    Rows of `right` and `left` are the neighbours of a word by class without itself, `own` how often it follows itself.
    """
    m = movable
    # what neighbours among the movable classes and the end add; those in `source` lose their pairs with the word first
    gain = np.zeros((len(right), m))
    for counts, cells in ((right, pairs[:m]), (left, pairs[:, :m].T)):
        others = counts.copy()
        others[:, source] = 0
        row, column = np.nonzero(others)
        base = _f(cells.T)
        for start in range(0, len(row), ENTRIES):
            r, c = row[start:start + ENTRIES], column[start:start + ENTRIES]
            first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            gain[r[first]] += np.add.reduceat(_f(cells.T[c] + others[r, c][:, None]) - base[c], first)
    for cells, mine, back in ((pairs[:m, source], right, left), (pairs[source, :m], left, right)):
        lost = cells - back[:, :m]
        gain += _f(lost + mine[:, source, None]) - _f(lost)
    middle, own = pairs[np.arange(m), np.arange(m)], own[:, None]
    gain -= _f(middle + right[:, :m]) + _f(middle + left[:, :m]) - _f(middle)
    gain += _f(middle + right[:, :m] + left[:, :m] + own)
    for counts, total in ((right, pairs.sum(axis=1)[:m]), (left, pairs.sum(axis=0)[:m])):
        gain -= _f(total + counts.sum(axis=1)[:, None] + own) - _f(total)
    return gain.argmax(axis=1)


def others(docs: DataFrame, text: str, classes: Classes, of: np.ndarray, pairs: np.ndarray, folder: str) -> DataFrame:
    """(key, c, class) of all words that the exchange left out."""
    n = len(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, WORDS):
                part = batch.slice(start, WORDS)
                met = part.column(1)
                row = np.repeat(np.arange(len(met)), met.value_lengths().to_numpy())
                around, times = (met.flatten().field(i).to_numpy() for i in (0, 1))
                left, right = (np.bincount(row * (n + 1) + side, times, len(met) * (n + 1)).reshape(-1, n + 1)
                               for side in (around // (n + 1), around % (n + 1)))
                found = joined_class(right[:, :n], left[:, :n], right[:, n], pairs, n - 2, n - 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(right.sum(axis=1).astype(np.int64)), pa.array(found.astype(np.int32))],
                                                 names=["key", "c", "class"])

    met = contexts(docs, text, classes, of).groupBy("key").agg(F.collect_list(F.struct("around", "n")).alias("met"))
    return staged(met.mapInArrow(run, "key bigint, c bigint, class int"), folder, "others")


def transition_gain(pairs: np.ndarray, share: np.ndarray) -> np.ndarray:
    """log10 of P(class | class before) over the share of the class in the base model."""
    return np.log10((pairs + PRIOR * share) / (pairs.sum(axis=1, keepdims=True) + PRIOR) / share)


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Class numbers of a column of texts behind each other, and where texts start."""
    found = [np.frombuffer(x, np.int16) for x in column.to_pylist()]
    lengths = np.array([len(x) for x in found], np.int64)
    return np.concatenate(found).astype(np.int64), np.cumsum(lengths) - lengths


def transitions(texts: DataFrame, n: int) -> np.ndarray:
    """Counts of neighbouring classes in rows of class numbers: one matrix per task is summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                codes, _ = _codes(part.column(0))
                total += np.bincount(np.append(codes[-1:], codes[:-1]) * n + codes, minlength=n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(n * n)
    for row in texts.select("codes").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row["at"]] = row["n"]
    return out.reshape(n, n)


def classed(rows: DataFrame, known: Classes, class_of_place: np.ndarray, words: DataFrame, below: float, end_count: int, n: int, folder: str) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, base_score, and the class numbers of all tokens as 16-bit integers."""
    log_p0 = np.log10((np.append(known.counts, 0) + ALPHA) / below)
    model = rows.sparkSession.sparkContext.broadcast((known, class_of_place, log_p0, np.log10((end_count + ALPHA) / below), end_count > 0))
    schema = T._parse_datatype_string("key bigint, row bigint, at array<int>, doc struct<id: bigint, held_out: boolean, n_tokens: bigint, "
                                      "n_known: bigint, base: double, codes: binary>")
    arrow = output_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, class_of_place, log_p0, log_end, has_end = model.value
        for batch in batches:
            for part in slices(batch, 3):
                keys, start = sequences(part.column(3).to_pylist())
                number = part.column(0).to_numpy()
                places = known.places(keys)
                end = keys == END
                frequent = (places < len(known.keys)) & ~end
                base = np.where(frequent, log_p0[places], 0.0)
                base[end] = log_end
                codes = np.where(end, n - 1, class_of_place[places]).astype(np.int16)
                counted = frequent | (end & has_end)
                lengths = np.diff(np.append(start, len(keys)))
                doc = pa.StructArray.from_arrays([part.column(1), part.column(2), pa.array(lengths), pa.array(np.add.reduceat(counted.astype(np.int64), start)),
                                                  pa.array(np.add.reduceat(base, start)),
                                                  pa.array([codes[a:a + k].tobytes() for a, k in zip(start, lengths)], pa.binary())],
                                                 fields=list(arrow.field(3).type))
                # rows of documents are spread by their number, rows of words meet the count and the class of the word
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(number), pa.nulls(len(number), arrow.field(2).type), doc], schema=arrow)
                rare = np.flatnonzero(~frequent & ~end)
                if len(rare):
                    of_row = np.repeat(np.arange(len(number)), lengths)[rare]
                    order = np.lexsort((keys[rare], of_row))
                    row, key, at = of_row[order], keys[rare][order], (rare - start[of_row])[order].astype(np.int32)
                    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(at), type=arrow.field(2).type)
                    yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(number[row[first]]), lists,
                                                      pa.nulls(len(first), arrow.field(3).type)], schema=arrow)

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text")
    found = numbered.mapInArrow(run, schema).join(words, "key", "left")
    times, is_word = F.size("at"), F.col("at").isNotNull()
    met = found.groupBy("row").agg(
        F.first("doc", ignorenulls=True).alias("doc"), F.sum(F.when(is_word & F.col("c").isNotNull(), times)).alias("n_known"),
        F.sum(F.when(is_word, times * F.log10((F.coalesce("c", F.lit(0)) + F.lit(ALPHA)) / F.lit(below)))).alias("base"),
        F.collect_list(F.when(is_word & F.col("class").isNotNull(), F.struct("at", "class"))).alias("found"))
    kept = met.select(F.col("doc.codes").alias("codes"), "found", "doc.id", "doc.held_out", "doc.n_tokens",
                      (F.col("doc.n_known") + F.coalesce("n_known", F.lit(0))).alias("n_known"), (F.col("doc.base") + F.coalesce("base", F.lit(0.0))).alias("base_score"))
    out = T.StructType([f for f in kept.schema.fields if f.name != "found"])
    names = output_schema(out)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                codes, start = _codes(part.column(0))
                of_text = part.column(1)
                per_word = of_text.flatten()
                row = np.repeat(np.arange(len(of_text)), of_text.value_lengths().to_numpy())
                at = per_word.field(0)
                each = at.value_lengths().to_numpy()
                codes[start[np.repeat(row, each)] + at.flatten().to_numpy()] = np.repeat(per_word.field(1).to_numpy(), each)
                ends = np.append(start[1:], len(codes))
                texts = pa.array([codes[a:b].astype(np.int16).tobytes() for a, b in zip(start, ends)], names.field(0).type)
                yield pa.RecordBatch.from_arrays([texts, *part.columns[2:]], schema=names)

    return staged(kept.mapInArrow(placed, out), folder, "classed")


def scored(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", clustered: int = CLUSTERED, classes: int = CLASSES,
           head_size: int = HEAD) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    train = rows.where("NOT held_out").select("text")
    counts = token_counts(train, "text", folder)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    below = n + ALPHA * (v + 1)
    known = Classes(*head(counts, head_size), clustered)
    end_count = int(counts.where(F.col("key") == int(END.view(np.int64))).agg(F.max("c")).first()[0] or 0)
    of = np.append(np.arange(known.n_words) % classes, [classes, classes + 1]).astype(np.int32)
    words = spark.createDataFrame([], "key bigint, c bigint, class int")
    share = np.zeros(classes + 2)
    if n:
        of, pairs = exchanged(neighbours(train, "text", known, folder), known.n_words, classes)
        words = others(train, "text", known, of, pairs, folder)
        for row in words.groupBy("class").agg(F.sum(F.col("c") + F.lit(ALPHA)).alias("c")).collect():
            share[row["class"]] = row["c"] / below
    class_of_place = of[known.word]
    if len(known.keys):
        # of the words that the exchange left out, those in the broadcast table
        held = words.where(F.col("c") >= int(known.counts.min())).toArrow()
        at = known.places(held["key"].to_numpy().view(np.uint64))
        class_of_place[at] = held["class"].to_numpy()
    exchanged_words = known.word[:-1] < known.n_words
    share += np.bincount(of[known.word[:-1][exchanged_words]], (known.counts[exchanged_words] + ALPHA) / below, minlength=classes + 2)
    share[classes + 1] = (end_count + ALPHA) / below
    texts = classed(rows, known, class_of_place, words, below, end_count, classes + 2, folder)
    gain = np.zeros((classes + 2, classes + 2))
    if n:
        pairs = transitions(texts.where("NOT held_out"), classes + 2)
        # the class `classes` is that of unknown words
        seen = np.flatnonzero(share > 0)
        gain[np.ix_(seen, seen)] = transition_gain(pairs[np.ix_(seen, seen)], share[seen] / share[seen].sum())
    model = spark.sparkContext.broadcast(gain)
    schema = T.StructType([*texts.schema.fields[1:], T.StructField("more", T.DoubleType())])
    arrow = output_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                codes, start = _codes(part.column(0))
                more = np.add.reduceat(model.value[np.append(codes[-1:], codes[:-1]), codes], start)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(more)], schema=arrow)

    return texts.mapInArrow(run, schema).select("id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score",
                                                (F.col("base_score") + F.col("more")).alias("score"))
