"""Language identification by hyperdimensional profiles.

Every character has a random vector of +1 and -1, drawn from a generator
seeded with its code point, so any alphabet has one without a table. A
three-letter gram is the product of its letters' vectors, rolled by their
place; a text is the sum over its grams; a language's prototype is the sum of
its documents' unit vectors. A text's language is that of the prototype with
the largest cosine.

Texts are lower-cased; each run of characters that aren't letters counts as
one space. Prototypes are fitted on at most `max_per_lang` labelled documents
a language, chosen by a hash of the key; every document is then compared.

Defined results: a null text, one without a letter, and any text when nothing
was learned, is `und` with score 0. Ties go to the language that sorts first.
Rows with a null label or text teach nothing. Labels are never read when
predicting. Repeated rows and empty tables need no special case; other columns
pass through, except earlier ones named as the outputs, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftwork.llm.common import released, values_of

DIM = 512
SCALE = 1_000_000
#: Vectors of grams kept by a worker; the table starts anew beyond this.
MAX_GRAMS = 40_000
MAX_PER_LANG = 4000
UNKNOWN = "und"


class Encoder:
    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.letters: dict[int, np.ndarray] = {}
        self.alpha = np.zeros(0x110000, dtype=np.int8)  # 0: not seen, 1: letter, 2: other
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1024, self.dim), dtype=np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng([20_107, code]).integers(0, 2, self.dim).astype(np.float32) * 2 - 1
        return self.letters[code]

    def row(self, gram: int) -> int:
        at = self.rows.get(gram)
        if at is None:
            at = self.rows[gram] = len(self.rows)
            if at >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            a, b, c = gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF
            self.table[at] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
        return at

    def codes(self, text: str) -> np.ndarray:
        """Lower-cased letters, with one space before, between and after words."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = self.alpha[codes]
        if (kind == 0).any():
            for code in np.unique(codes[kind == 0]):
                self.alpha[code] = 1 if chr(code).isalpha() else 2
            kind = self.alpha[codes]
        letter = kind == 1
        if not letter.any():
            return np.zeros(0, dtype=np.uint64)
        codes = np.concatenate([[32], np.where(letter, codes, 32), [32]]).astype(np.uint64)
        return codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]

    def encode(self, text: str) -> np.ndarray | None:
        """The text's unit vector; None without a letter."""
        codes = self.codes(text)
        if not len(codes):
            return None
        grams, counts = np.unique(codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:], return_counts=True)
        if len(self.rows) + len(grams) > MAX_GRAMS:
            self.clear()
        get, total = self.rows.get, np.zeros(self.dim, dtype=np.float32)
        for at in range(0, len(grams), MAX_GRAMS):
            if at:
                self.clear()
            own = grams[at : at + MAX_GRAMS].tolist()
            index = [i if (i := get(g)) is not None else self.row(g) for g in own]
            total += counts[at : at + MAX_GRAMS].astype(np.float32) @ self.table[index]
            get = self.rows.get
        norm = float(np.linalg.norm(total))
        return total / norm if norm else total


def fit_prototypes(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", max_per_lang: int = MAX_PER_LANG) -> dict[str, np.ndarray]:
    """Unit prototype vectors by label; sums are of integers, so any order of rows gives the same."""
    counts = {r[0]: r[1] for r in docs.filter(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, max_per_lang / n))])
    chance = F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & (chance < share[F.col(label)])).select(F.col(label).alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(), {}
        for batch in batches:
            for lang, t in zip(*map(values_of, batch.columns)):
                if (v := encoder.encode(t)) is not None:
                    sums[lang] = sums.get(lang, 0) + np.rint(v.astype(np.float64) * SCALE).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = sample.mapInArrow(released(run), "lang string, v array<bigint>")
    cells = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    out: dict[str, np.ndarray] = {}
    for r in cells:
        out.setdefault(r[0], np.zeros(DIM))[r[1]] = r[2]
    return {k: v / max(np.linalg.norm(v), 1e-12) for k, v in sorted(out.items())}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows and columns, with the predicted language and its cosine (0 to 1)."""
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else None
    kept = [f for f in docs.schema.fields if f.name not in (pred, score)]
    schema = T.StructType([*kept, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for batch in batches:
            langs, scores = [], []
            for t in values_of(batch.column(text)):
                v = encoder.encode(t) if t is not None and matrix is not None else None
                if v is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cos = np.round((matrix @ v).astype(np.float64), 6)
                best = int(np.argmax(cos))
                langs.append(names[best])
                scores.append(min(1.0, max(0.0, float(cos[best]))))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.fieldNames())

    return docs.select(*(f.name for f in kept)).mapInArrow(released(run), schema)


def learnable(doc_id: Column) -> Column:
    """The fold that may teach."""
    from graftwork.llm.common import held_out

    return ~held_out(doc_id, 4, 2)
