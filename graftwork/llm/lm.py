"""Language-model scoring by a hashed maximum-entropy model.

A token's probability is factored: that of its class given the words before
it, times that of the token in its class. Classes gather words by their
endings, clustered on counts of neighbouring endings over the whole training
corpus; the end of a text and the unknown word are classes of their own. The
class softmax has hashed features of the history: the last word, the word before it
(a skip), and the last three classes.
Inside a class a word has its share of the training counts.

Data go in chunks of some 32 MB of text. One pass splits the texts: each
becomes its words' numbers in the chunk, and the words go to a file beside it.
Each chunk's distinct words meet the corpus counts in two shuffles, and the
counts come back by number as one file a chunk. So a task holds the words of
its own chunk, however large the vocabulary, and every later pass reads
numbers alone.
Training makes one pass over all training texts in `ROUNDS` rounds: tasks take
gradient steps from the shared weights, and the changes are averaged, row by
row, by how often each feature was met. Scoring gathers the few feature rows
of each token in numpy batches.

A word met once in training teaches the unknown class, whose probability is
thus the rate of new words; known words share the rest. Over the vocabulary
and one unknown token the probabilities sum to one.

Defined results: a null or empty text is the end token alone. A null key is
never held out. Without a training text every count is zero and the class
softmax has no weights. Repeated rows count each on its own; texts are read
whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm.common import Scratch, held_out
from graftwork.llm.neardup import groups
from graftwork.llm.shingles import mix

CHUNK_BYTES = 32 << 20
PIECE_BYTES = 4 << 20
SPACE = re.compile(rb"[\x09-\x0D\x20]")
ENDINGS = 512
CLASSES = 32
END, UNKNOWN, FIRST = 0, 1, 2
WORD_ROWS = 1 << 13
FEATURES = 3
ROWS = 2 * WORD_ROWS + CLASSES**3
BATCH = 8192
ROUNDS = 2
RATE = 0.15


def split(data: memoryview, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words, words in each text) of texts, given the place where each begins: A-Z lower-cased, split at ASCII white space."""
    d = np.frombuffer(bytes(data).lower(), dtype=np.uint8)
    word = (d != 0x20) & (d - np.uint8(9) > 4)
    # a word begins after a space or where a text does, and ends likewise
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = starts[(starts > 0) & (starts < len(d))]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    first = np.flatnonzero(begins)
    offsets = np.zeros(len(first) + 1, dtype=np.int32)
    np.cumsum(np.flatnonzero(ends) + 1 - first, out=offsets[1:])
    n = np.diff(np.searchsorted(first, np.append(starts, len(d))))
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(d[word])]), n


def pieces(data: memoryview, size: int) -> Iterator[memoryview]:
    """A long text in pieces of some size that end before a space."""
    at = 0
    while at < len(data):
        stop = at + size
        if stop < len(data):
            space = SPACE.search(data, stop)
            stop = space.start() if space else len(data)
        yield data[at:stop]
        at = stop


def stretches(ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Rows from a to b of some size together, from the running ends of their sizes; a larger row comes alone."""
    a = 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + size, "right")) - 1)
        yield a, b
        a = b


def buffers(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """(running ends of the values, from 0, and the bytes of all) of a column without nulls."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, dtype=np.int64, count=column.offset + len(column) + 1)[column.offset :] if len(column) else np.zeros(1, dtype=np.int64)
    return ends - ends[0], memoryview(data if data is not None else b"")[int(ends[0]) : int(ends[-1])]


def numbered(docs: DataFrame, key: str, text: str, folds: int, fold: int, folder: str) -> DataFrame:
    """(chunk, id, held, words): the word numbers of each text as 32-bit integers, a chunk being a stretch of a task's rows.

    A chunk has a name of its own in every attempt of a task, so the rows that
    are kept name the files that were written with them.
    """
    source = docs.select(F.col(key).alias("id"), held_out(F.col(key), folds, fold).alias("held"), F.coalesce(text, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            ends, data = buffers(batch.column("text"))
            held = batch.column("held").to_numpy(zero_copy_only=False)
            for a, b in stretches(ends, min(PIECE_BYTES, CHUNK_BYTES)):
                if writer is None or writer.size > CHUNK_BYTES:
                    if writer is not None:
                        writer.close()
                    writer = ChunkWriter(folder)
                i, n = writer.add(data[ends[a] : ends[b]], ends[a:b] - ends[a], held[a:b])
                at = pa.py_buffer(np.concatenate([[0], np.cumsum(n * 4)]).astype(np.int32))
                numbers = pa.Array.from_buffers(pa.binary(), b - a, [None, at, pa.py_buffer(i)])
                yield pa.RecordBatch.from_arrays([pa.array([writer.chunk] * (b - a), pa.int64()), batch.column("id").slice(a, b - a), batch.column("held").slice(a, b - a), numbers], names=["chunk", "id", "held", "words"])
        if writer is not None:
            writer.close()

    return source.mapInArrow(run, f"chunk bigint, id {dict(source.dtypes)['id']}, held boolean, words binary")


class ChunkWriter:
    """Numbers the words of one chunk; its files tell the words, their training tokens and how often each ending follows each."""

    def __init__(self, folder: str):
        self.folder, self.chunk, self.size = folder, uuid.uuid4().int >> 65, 0
        self.words = Vocabulary(folder, np.arange(ENDINGS))
        # first the mark between texts, a word that no text holds
        self.words.at = {b"": 0}
        self.words.count, self.words.kind, self.words.hash = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.uint64)
        self.follows = np.zeros(ENDINGS * ENDINGS, dtype=np.int64)

    def add(self, data: memoryview, starts: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, words in each text)"""
        self.size += len(data)
        if len(starts) == 1:
            i = np.concatenate([np.zeros(0, dtype=np.int32), *(self._numbers(split(p, starts[:1])[0]) for p in pieces(data, PIECE_BYTES))])
            n = np.array([len(i)])
        else:
            ws, n = split(data, starts)
            i = self._numbers(ws)
        training = np.repeat(~held, n)
        self.words.count += np.bincount(i[training], minlength=len(self.words.count))
        opens = np.cumsum(n) - n
        training[opens[n > 0]] = False
        e = self.words.kind[i]
        pair = np.flatnonzero(training)
        self.follows += np.bincount(e[pair - 1] * ENDINGS + e[pair], minlength=len(self.follows))
        return i, n

    def _numbers(self, ws: pa.Array) -> np.ndarray:
        coded = ws.dictionary_encode()
        return self.words.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]

    def close(self) -> None:
        v = self.words
        write(self.folder, f"words/{self.chunk}", {"word": pa.array(list(v.at), pa.binary()), "n": pa.array(v.count)})
        write(self.folder, f"marks/{self.chunk}", {"ending": pa.array(v.kind.astype(np.int16)), "hash": pa.array(v.hash)})
        at = np.flatnonzero(self.follows)
        write(self.folder, f"follows/{self.chunk}", {"cell": pa.array(at), "n": pa.array(self.follows[at])})


def write(folder: str, name: str, columns: dict[str, pa.Array]) -> None:
    fs, root = place(folder)
    fs.create_dir(f"{root}/{name.rpartition('/')[0]}", recursive=True)
    table = pa.table(columns)
    with fs.open_output_stream(f"{root}/{name}") as f, pa.ipc.new_stream(f, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table, max_chunksize=50_000)


def read(folder: str, name: str) -> pa.Table:
    fs, root = place(folder)
    with fs.open_input_stream(f"{root}/{name}") as f:
        return pa.ipc.open_stream(f).read_all()


def one_task_each(spark: SparkSession, chunks: list[int]) -> DataFrame:
    """(id): the places in the list of chunks."""
    return spark.range(0, len(chunks), 1, max(len(chunks), 1))


def word_counts(spark: SparkSession, chunks: list[int], folder: str) -> DataFrame:
    """(place, word, n): each distinct word of each chunk, with its training tokens there; the place tells chunk and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column("id").to_pylist():
                first = at << 32
                for part in read(folder, f"words/{chunks[at]}").to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + part.num_rows)), part.column("word"), part.column("n")], names=["place", "word", "n"])
                    first += part.num_rows

    return one_task_each(spark, chunks).mapInArrow(run, "place bigint, word binary, n bigint")


def ending(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word[-3:]) % ENDINGS


def endings(words_: list[bytes]) -> np.ndarray:
    """The ending of each word; each run of last letters is hashed once."""
    last = [w[-3:] for w in words_]
    known = {x: ending(x) for x in set(last)}
    return np.fromiter(map(known.__getitem__, last), dtype=np.int64, count=len(last))


def neighbour_counts(spark: SparkSession, chunks: list[int], folder: str) -> np.ndarray:
    """How often each ending follows each, over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ENDINGS * ENDINGS, dtype=np.int64)
        for batch in batches:
            for at in batch.column("id").to_pylist():
                cells = read(folder, f"follows/{chunks[at]}")
                total[cells.column("cell").to_numpy()] += cells.column("n").to_numpy()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    few = one_task_each(spark, chunks).coalesce(4 * spark.sparkContext.defaultParallelism)
    cells = few.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    got = cells.toPandas()  # at most ENDINGS^2 cells
    out = np.zeros(ENDINGS * ENDINGS)
    out[got["cell"].to_numpy(dtype=np.int64)] = got["n"].to_numpy()
    return out.reshape(ENDINGS, ENDINGS)


def classes_of(counts: np.ndarray) -> np.ndarray:
    """The class of each ending: k-means over what precedes and follows it."""
    weight = counts.sum(axis=0) + counts.sum(axis=1)
    x = np.sqrt(np.concatenate([counts, counts.T], axis=1) / np.maximum(np.concatenate([counts, counts.T], axis=1).sum(axis=1, keepdims=True), 1))
    k = CLASSES - FIRST
    centre = x[np.argsort(-weight, kind="stable")[:k]].copy()
    for _ in range(20):
        label = ((x**2).sum(1)[:, None] - 2 * x @ centre.T + (centre**2).sum(1)).argmin(axis=1)
        for c in range(k):
            own = label == c
            if weight[own].sum():
                centre[c] = (x[own] * weight[own, None]).sum(0) / weight[own].sum()
    return (label + FIRST).astype(np.int64)


def place(folder: str):
    fs, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return fs, root


def write_counts(counts: DataFrame, chunks: list[int], folder: str, classes: np.ndarray) -> np.ndarray:
    """One file a chunk with its words' corpus counts; returns (tokens, distinct words, then the mass of each class).

    A file's content is the same whichever attempt of its task wrote it, and it
    is moved into place whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(folder)
        for g in groups(batches, "chunk"):
            chunk = chunks[g.column("chunk")[0].as_py()]
            ends = read(folder, f"marks/{chunk}").column("ending").to_numpy()
            number, c = g.column("number").to_numpy(), g.column("c").to_numpy()
            all_counts = np.zeros(len(ends), dtype=np.int64)
            all_counts[number] = c
            temp = f"counts/{chunk}-{uuid.uuid4().hex}"
            write(folder, temp, {"c": pa.array(all_counts)})
            try:
                fs.move(f"{root}/{temp}", f"{root}/counts/{chunk}")
            except OSError:  # some file systems don't replace what another attempt wrote
                if fs.get_file_info(f"{root}/counts/{chunk}").type != pafs.FileType.File:
                    raise
                fs.delete_file(f"{root}/{temp}")
            new = g.column("first").to_numpy() & (c > 0)
            stats = np.zeros(2 + CLASSES)
            stats[0], stats[1] = c[new].sum(), new.sum()
            stats[2:] = np.bincount(classes[ends[number[new]]], weights=mass(c[new]), minlength=CLASSES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(stats))), pa.array(stats)], names=["i", "x"])

    spread = counts.selectExpr("place", "sum(n) OVER (PARTITION BY word) AS c", "min(place) OVER (PARTITION BY word) = place AS first")
    spread = spread.selectExpr("CAST(place >> 32 AS INT) AS chunk", "CAST(place & 4294967295 AS INT) AS number", "c", "first")
    # the mark, which no text holds, gives every chunk a file
    rows = spread.filter("c > 0 OR number = 0").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "i bigint, x double")
    out = np.zeros(2 + CLASSES)
    for i, x in rows.groupBy("i").agg(F.sum("x")).collect():
        out[i] = x
    return out


def mass(c):
    """A word's weight in its class; one met once has taught the unknown word as well."""
    return np.where(np.asarray(c) > 1, c, 0.5)


class Vocabulary:
    """The words of one chunk by number: count, class, hash."""

    def __init__(self, folder: str, classes: np.ndarray):
        self.folder, self.classes, self.chunk = folder, classes, None

    def open(self, chunk: int) -> None:
        if chunk == self.chunk:
            return
        marks = read(self.folder, f"marks/{chunk}")
        self.chunk = chunk
        self.count = read(self.folder, f"counts/{chunk}").column("c").to_numpy()
        self.kind = self.classes[marks.column("ending").to_numpy()]
        self.kind[0] = END
        self.hash = marks.column("hash").to_numpy()

    def numbers(self, distinct: list[bytes]) -> np.ndarray:
        """The number of each word; those not met before get the next ones."""
        self._learn([w for w in distinct if w not in self.at])
        return np.fromiter(map(self.at.__getitem__, distinct), dtype=np.int32, count=len(distinct))

    def _learn(self, new: list[bytes]) -> None:
        for w in new:
            self.at[w] = len(self.at)
        self.count = np.concatenate([self.count, np.zeros(len(new), dtype=np.int64)])
        self.kind = np.concatenate([self.kind, self.classes[endings(list(new))]])
        self.hash = np.concatenate([self.hash, np.array([xxhash.xxh3_64_intdigest(w) for w in new], dtype=np.uint64)])


def positions(i: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number of each position, places to predict) of texts with three marks before each."""
    out = np.zeros(len(i) + 3 * len(n) + 1, dtype=np.int64)
    out[np.arange(len(i)) + np.repeat(np.arange(3, 3 * len(n) + 1, 3), n)] = i
    first = np.cumsum(n + 3) - n
    return out, np.arange((n + 1).sum()) + np.repeat(first - (np.cumsum(n + 1) - (n + 1)), n + 1)


def by_chunk(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(chunk, word numbers, words in each text) of stretches of a batch's rows."""
    chunks = batch.column("chunk").to_numpy()
    cuts = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)]
    ends, data = buffers(batch.column("words"))
    for a, b in zip(cuts, cuts[1:]):
        for c, d in stretches(ends[a : b + 1], 1 << 19):
            own = ends[a + c : a + d + 1]
            yield int(chunks[a]), np.frombuffer(data[own[0] : own[-1]], dtype=np.int32), np.diff(own) // 4


def features(kind: np.ndarray, hashed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The weight rows of each place, from the words before it."""
    out = np.empty((len(at), FEATURES), dtype=np.uint16, order="F")
    out[:, 0] = mix(hashed + np.uint64(1))[at - 1] % np.uint64(WORD_ROWS)
    out[:, 1] = WORD_ROWS + mix(hashed + np.uint64(2))[at - 2] % np.uint64(WORD_ROWS)
    out[:, 2] = 2 * WORD_ROWS + (kind[at - 1] * CLASSES + kind[at - 2]) * CLASSES + kind[at - 3]
    return out


def class_scores(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The exponent of each class at each position, at most zero; not yet normalised."""
    # no row lies outside; without the test for it a gather takes a fraction of the time
    z = np.take(weights, rows[:, 0], axis=0, mode="clip")
    more = np.empty_like(z)
    for j in range(1, FEATURES):
        z += np.take(weights, rows[:, j], axis=0, mode="clip", out=more)
    z += bias
    z -= z.max(axis=1, keepdims=True)
    return z


def class_logs(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """The log probability of each position's class."""
    z = class_scores(weights, bias, rows)
    own = z[np.arange(len(z)), targets]
    return own - np.log(np.exp(z, out=z).sum(axis=1))


def sums_between(rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of float32 rows from each cut to the next; as complex numbers two columns are added at once."""
    return np.add.reduceat(rows.view(np.complex64), cuts, axis=0).view(np.float32)


class Trainer:
    """Adagrad steps on one task's texts, with one rate for each weight row."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights.copy(), bias
        self.square = np.full(len(weights), 0.1, dtype=np.float32)
        self.met = np.zeros(len(weights), dtype=np.int64)
        self.rows: list[np.ndarray] = []
        self.targets: list[np.ndarray] = []
        self.held = 0

    def add(self, rows: np.ndarray, targets: np.ndarray) -> None:
        self.rows.append(rows)
        self.targets.append(targets)
        self.held += len(rows)
        if self.held >= BATCH:
            all_rows, all_targets = np.concatenate(self.rows), np.concatenate(self.targets)
            whole = len(all_rows) // BATCH * BATCH
            for a in range(0, whole, BATCH):
                self.step(all_rows[a : a + BATCH], all_targets[a : a + BATCH])
            self.rows, self.targets, self.held = [all_rows[whole:]], [all_targets[whole:]], len(all_rows) - whole

    def finish(self) -> None:
        if self.held:
            self.step(np.concatenate(self.rows), np.concatenate(self.targets))

    def step(self, rows: np.ndarray, targets: np.ndarray) -> None:
        g = class_scores(self.weights, self.bias, rows)
        np.exp(g, out=g)
        g /= g.sum(axis=1, keepdims=True)
        g[np.arange(len(g)), targets] -= 1
        for j in range(FEATURES):
            order = np.argsort(rows[:, j], kind="stable")  # 16-bit keys sort by radix
            own = rows[order, j]
            cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            at = own[cuts]
            total = sums_between(np.take(g, order, axis=0, mode="clip"), cuts)
            self.square[at] += np.einsum("ij,ij->i", total, total)
            total *= (RATE / np.sqrt(self.square[at]))[:, None]
            self.weights[at] -= total
            self.met[at] += np.diff(np.concatenate([cuts, [len(own)]]))


def train_round(spark: SparkSession, texts: DataFrame, vocabulary: Vocabulary, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights after gradient steps in every task, each row averaged by how often a task met it."""
    shared = spark.sparkContext.broadcast((weights, bias, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, v = shared.value
        trainer = Trainer(w, b)
        for batch in batches:
            for chunk, numbers, n in by_chunk(batch):
                v.open(chunk)
                i, at = positions(numbers, n)
                kind = v.kind[i]
                trainer.add(features(kind, v.hash[i], at), np.where((v.count[i] > 1) | (i == 0), kind, UNKNOWN)[at])
        trainer.finish()
        at = np.flatnonzero(trainer.met)
        change = (trainer.weights[at] - w[at]).astype(np.float16)
        for a in range(0, len(at), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 4096]), pa.array(trainer.met[at[a : a + 4096]]), pa.array([x.tobytes() for x in change[a : a + 4096]], pa.binary())], names=["row", "met", "change"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "row"):
            met = g.column("met").to_numpy().astype(np.float64)
            change = np.frombuffer(b"".join(g.column("change").to_pylist()), dtype=np.float16).reshape(len(met), -1)
            mean = (change * met[:, None]).sum(axis=0) / met.sum()
            yield pa.RecordBatch.from_arrays([g.column("row")[:1].combine_chunks(), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], names=["row", "change"])

    made = texts.select("chunk", "words").mapInArrow(run, "row bigint, met bigint, change binary")
    means = made.repartition("row").sortWithinPartitions("row").mapInArrow(average, "row bigint, change binary")
    out = weights.copy()
    for row, change in means.collect():  # at most ROWS rows, the size of the model
        out[row] += np.frombuffer(change, dtype=np.float32)
    shared.unpersist()
    return out


def score_texts(spark: SparkSession, docs: DataFrame, folds: int = 7, fold: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    scratch = Scratch(spark, "lm")
    folder = scratch.at("dictionaries")
    texts = scratch.save(numbered(docs, key, text, folds, fold, folder), "texts")
    training = texts.filter("not held")
    chunks = [r.chunk for r in texts.select("chunk").distinct().collect()]
    classes = classes_of(neighbour_counts(spark, chunks, folder))
    stats = write_counts(word_counts(spark, chunks, folder), chunks, folder, classes)
    scratch.drop("dictionaries/words", "dictionaries/follows")
    ends = training.count()
    n_train, v_train = int(stats[0]) + ends, int(stats[1]) + (1 if ends else 0)
    masses = stats[2:]
    masses[END] = masses[UNKNOWN] = 1.0  # one token each
    vocabulary = Vocabulary(folder, classes)
    weights = np.zeros((ROWS, CLASSES), dtype=np.float32)
    start = np.maximum(masses, 0.5)
    start[END], start[UNKNOWN] = max(ends, 0.5), max(v_train / 2, 0.5)
    bias = np.log(start / start.sum()).astype(np.float32)
    for r in range(ROUNDS):
        own = training.filter(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(ROUNDS)) == r)
        weights = train_round(spark, own, vocabulary, weights, bias)
    shared = spark.sparkContext.broadcast((weights, bias, vocabulary, masses))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, vocab, mass_ = shared.value
        in_class = np.log10(np.maximum(mass_, 1e-300))
        for batch in batches:
            out = []
            for chunk, numbers, n in by_chunk(batch):
                vocab.open(chunk)
                i, at = positions(numbers, n)
                kind, end = vocab.kind[i], i[at] == 0
                rows, count = features(kind, vocab.hash[i], at), np.where(end, ends, vocab.count[i[at]])
                known = (count > 0) & ~end
                target = np.where(known | end, kind[at], UNKNOWN)
                logs = np.concatenate([class_logs(w, b, rows[a : a + BATCH], target[a : a + BATCH]) for a in range(0, len(rows), BATCH)]).astype(np.float64) / np.log(10)
                logs[known] += np.log10(mass(count[known])) - in_class[kind[at][known]]
                first = np.cumsum(n + 1) - (n + 1)
                sums = [np.add.reduceat(x, first) for x in ((count > 0).astype(np.int64), np.log10((count + 1) / (n_train + v_train + 1)), logs)]
                out += zip((n + 1).tolist(), sums[0].tolist(), [n_train] * len(n), sums[1].tolist(), sums[2].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held"), *(pa.array(list(c), k) for c, k in zip(zip(*out) if out else [()] * 5, [pa.int64()] * 3 + [pa.float64()] * 2))], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = dict(texts.dtypes)["id"]
    return texts.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
