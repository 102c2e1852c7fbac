"""Language identification by word-first backoff.

A word seen in training scores each language by its log relative frequency there.  An unseen
word falls back to its character 5-grams, then 4-grams and so on down to single characters: the
longest length at which any n-gram is known decides, by the mean log frequency of those known.

The model is fitted on a bounded sample of labelled rows (``docs_per_language``, chosen by a hash
of the row, so that it is the same on every run) and holds about ``max_entries`` words and
n-grams of each language, so its size grows with the languages but not with the corpus.  All
languages of the labelled rows are learnt.  Prediction covers every whole text.  Words and n-grams
are known by 64-bit hashes in sorted arrays; unseen words are looked up many at a time.

Defined results: words are runs of letters (Unicode category L) in lower case; digits, numerals such
as a raised two, and all other characters part them.  A null text, and one without a letter, gets
``und`` with score 0; so does every text when there are no labelled rows.  Equal scores go to the
language first in code point order.  Rows with a null or equal id are predicted like any other, and
equal texts get equal scores whatever stands around them.  A very long text is read in parts cut
between words.  Other columns pass through; existing ``lang_pred`` and ``score`` columns are replaced.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import append_columns, emit, strings
from graphloom.storage import discard, materialize

MAX_N = 5
UNKNOWN = "und"
#: Characters of a text that are cut into words at a time.
PART = 500_000
#: Words whose scores are gathered at a time, times languages.
CELLS = 1_500_000
#: Words remembered by a worker.
MEMO = 100_000
_FACTORS = np.random.default_rng(20240301).integers(1 << 62, 1 << 63, (MAX_N + 1, MAX_N), dtype=np.uint64) | np.uint64(1)


_LETTERS = re.compile(r"[^\W\d_]+")


def parts_of(text: str, size: int = PART) -> Iterator[str]:
    """A text in parts of about ``size`` characters that do not cut a run of letters."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def words_of(text: str) -> list[str]:
    """Runs of letters.  The pattern also takes numerals that are no decimal digits; they are blanked first."""
    text = text.lower()
    if not text.isascii() and (odd := [c for c in set(text) if c.isnumeric() and not c.isalpha() and not c.isdecimal()]):
        text = text.translate(dict.fromkeys(map(ord, odd), " "))
    return _LETTERS.findall(text)


class Numbers(dict):
    """Numbers words in the order in which they are asked for; ``new`` lists those not numbered before."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


def grams_of(word: str, n: int) -> Iterator[str]:
    """Character n-grams of a word, its ends marked; a single character is never just a mark."""
    padded = f"_{word}_" if n > 1 else word
    return (padded[i : i + n] for i in range(len(padded) - n + 1))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def gram_hash(points: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of code points that begin at ``at``."""
    out = np.zeros(len(at), np.uint64)
    for i in range(n):
        out += points[at + i] * _FACTORS[n, i]
    return out


def item_hashes(items: list[str], n: int) -> np.ndarray:
    """Hashes of words (n = 0) or of n-grams."""
    if not items:
        return np.zeros(0, np.uint64)
    if n == 0:
        return np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in items), np.uint64, len(items))
    return gram_hash(_points("".join(items)), np.arange(0, n * len(items), n), n)


@dataclass
class LanguageModel:
    languages: list[str]
    #: by length (0: whole words): sorted hashes of the known items
    keys: list[np.ndarray]
    #: by length: log relative frequencies, a row per key and a column per language
    tables: list[np.ndarray]

    def rows(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash among the known items of a length, and whether it is one."""
        known = self.keys[n]
        if not len(known):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return at, known[at] == hashes

    def knows(self, n: int, item: str) -> bool:
        return bool(self.rows(n, item_hashes([item], n))[1][0])

    def vectors(self, words: list[str]) -> np.ndarray:
        """Scores of distinct words, a row each."""
        out = np.zeros((len(words), len(self.languages)))
        at, hit = self.rows(0, item_hashes(words, 0))
        out[hit] = self.tables[0][at[hit]]
        left = np.flatnonzero(~hit)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for i in left[size[left] > PART]:
            out[i] = self._long(words[i])
        left = left[size[left] <= PART]
        for group in np.split(left, np.flatnonzero(np.diff(np.cumsum(size[left]) // PART)) + 1):
            if len(group):
                out[group] = self._backoff([words[i] for i in group])
        return out

    def unseen(self, word: str) -> np.ndarray:
        return self._backoff([word])[0]

    def _backoff(self, words: list[str]) -> np.ndarray:
        """Mean scores of the longest known n-grams, by word."""
        out = np.zeros((len(words), len(self.languages)))
        points = _points("_" + "__".join(words) + "_")
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        start = np.cumsum(size) - size
        left = np.arange(len(words))
        for n in range(MAX_N, 0, -1):
            many = np.maximum(size[left] - n + 1, 0) if n > 1 else size[left] - 2
            first = start[left] + (n == 1)
            owner = np.repeat(np.arange(len(left)), many)
            at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            row, hit = self.rows(n, gram_hash(points, at, n))
            owner, row = owner[hit], row[hit]
            if len(owner):
                heads = np.flatnonzero(np.diff(owner, prepend=-1))
                counts = np.diff(heads, append=len(owner))
                out[left[owner[heads]]] = np.add.reduceat(self.tables[n][row], heads, axis=0) / counts[:, None]
                rest = np.ones(len(left), bool)
                rest[owner[heads]] = False
                left = left[rest]
            if not len(left):
                break
        return out

    def _long(self, word: str) -> np.ndarray:
        """The same for a word of any length, a part of its n-grams at a time."""
        for n in range(MAX_N, 0, -1):
            padded = f"_{word}_" if n > 1 else word
            total, found = np.zeros(len(self.languages)), 0
            for i in range(0, len(padded) - n + 1, PART):
                points = _points(padded[i : i + PART + n - 1])
                row, hit = self.rows(n, gram_hash(points, np.arange(len(points) - n + 1), n))
                total += self.tables[n][row[hit]].sum(axis=0)
                found += int(hit.sum())
            if found:
                return total / found
        return np.zeros(len(self.languages))

    def predict(self, text: str) -> tuple[str, float]:
        return next(iter(self.scorer()([text])))

    def scorer(self, memo: int = MEMO, evidence: int = 50):
        """A function from texts to (language, score) for each; it remembers the scores of words.

        The score is the posterior of the best language under equal priors, with the
        likelihood of a long text counted as that of ``evidence`` words.  Only speed depends on what is
        remembered.
        """
        width = len(self.languages)
        seen = Numbers()
        held = np.zeros((0, width))

        def totals(pieces: list[list[str]]) -> np.ndarray:
            """Sums of scores over the words of each piece."""
            nonlocal held
            if len(seen) > memo:
                seen.clear()
                held = np.zeros((0, width))
            sizes = np.array([len(p) for p in pieces])
            at = np.fromiter(map(seen.__getitem__, itertools.chain.from_iterable(pieces)), np.int64, sizes.sum())
            if seen.new:
                held = np.concatenate([held, self.vectors(seen.new)])
                seen.new.clear()
            return np.add.reduceat(held[at], np.cumsum(sizes) - sizes, axis=0)

        def flush(owners: list[int], pieces: list[list[str]], total: np.ndarray, words: np.ndarray) -> None:
            if owners:
                for i, row, p in zip(owners, totals(pieces), pieces, strict=True):
                    total[i] += row
                    words[i] += len(p)

        def score(batch: list[str | None]) -> list[tuple[str, float]]:
            total, words = np.zeros((len(batch), width)), np.zeros(len(batch))
            owners, pieces, cells = [], [], 0
            for i, text in enumerate(batch if width else ()):
                for part in parts_of(text) if text else ():
                    if found := words_of(part):
                        owners.append(i)
                        pieces.append(found)
                        cells += len(found) * width
                        if cells > CELLS:
                            flush(owners, pieces, total, words)
                            owners, pieces, cells = [], [], 0
            flush(owners, pieces, total, words)
            if not width:
                return [(UNKNOWN, 0.0)] * len(batch)
            best = total.argmax(axis=1)
            gap = (total - total.max(axis=1, keepdims=True)) * np.minimum(1.0, evidence / np.maximum(words, 1.0))[:, None]
            sure = 1.0 / np.exp(gap).sum(axis=1)
            return [(self.languages[b], min(1.0, float(s))) if n else (UNKNOWN, 0.0) for b, s, n in zip(best, sure, words)]

        return score


def train(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    use: Column | None = None,
    docs_per_language: int = 3000,
    max_entries: int = 60_000,
) -> LanguageModel:
    """Fit on about ``docs_per_language`` labelled rows of each language at most, and keep about
    ``max_entries`` words and n-grams of each, the same share of every length.

    ``use`` marks the rows that may be learnt from.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if use is not None:
        rows = rows.where(use)
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    found = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(found)
    if not languages:
        return LanguageModel([], [np.zeros(0, np.uint64)] * (MAX_N + 1), [np.zeros((0, 0))] * (MAX_N + 1))
    share = spark.createDataFrame([(k, min(1.0, docs_per_language / n)) for k, n in found.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    # a row per language, all of which the driver just held
    sample = rows.withColumn("draw", draw).join(F.broadcast(share), "lang").where(F.col("draw") < F.col("share"))
    counts = materialize(
        emit(sample, ["lang", "text"], "lang string, n int, item string, c bigint", _count_items).groupBy("lang", "n", "item").agg(F.sum("c").alias("c")),
        "items",
    )
    quota = max(10, max_entries // (MAX_N + 1))
    kept = counts.join(floors(counts, quota), ["lang", "n"]).where(F.col("c") >= F.col("floor"))
    totals = {(r.lang, r.n): r.c for r in counts.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect()}
    entries = kept.select("lang", "n", "item", "c").toArrow()  # columns, not a row object each
    discard(counts)
    return assemble_columns(languages, entries, totals)


def _count_items():
    """Words by language first, then the n-grams of each distinct word."""
    found: Counter = Counter()

    def drain() -> Iterator[dict]:
        items: Counter = Counter()
        for (lang, word), c in found.items():
            items[lang, 0, word] += c
            for n in range(1, MAX_N + 1):
                for g in grams_of(word, n):
                    items[lang, n, g] += c
                    if len(items) > 150_000:
                        yield _columns(items)
        found.clear()
        if items:
            yield _columns(items)

    def step(*columns) -> Iterator[dict]:
        if not columns:
            yield from drain()
            return
        for lang, text in zip(columns[0].to_pylist(), strings(columns[1]), strict=True):
            for part in parts_of(text):
                found.update((lang, w) for w in words_of(part))
                if len(found) > 50_000:
                    yield from drain()

    return step


def _columns(items: Counter) -> dict:
    keys = list(items)
    out = {"lang": [k[0] for k in keys], "n": [k[1] for k in keys], "item": [k[2] for k in keys], "c": list(items.values())}
    items.clear()
    return out


def floors(counts: DataFrame, quota: int) -> DataFrame:
    """The least count, by language and length, at which no more than ``quota`` items are kept, ties
    with the first item beyond it left out; the most frequent count is always kept.

    A window holds the distinct counts of one language and length, about the root of its sample."""
    steps = counts.groupBy("lang", "n", "c").agg(F.count("*").alias("items"))
    over = Window.partitionBy("lang", "n").orderBy(F.desc("c"))
    within = (F.sum("items").over(over) <= quota) | (F.row_number().over(over) == 1)
    return steps.withColumn("within", within).where("within").groupBy("lang", "n").agg(F.min("c").alias("floor"))


def assemble(languages: list[str], entries: list[tuple[str, int, str, int]], totals: dict) -> LanguageModel:
    """Tables of floored log frequencies from (language, length, item, count)."""
    names, kinds = ("lang", "n", "item", "c"), (pa.string(), pa.int32(), pa.string(), pa.int64())
    columns = zip(*entries) if entries else ([], [], [], [])
    return assemble_columns(languages, pa.table({k: pa.array(c, t) for k, c, t in zip(names, columns, kinds)}), totals)


def assemble_columns(languages: list[str], entries: pa.Table, totals: dict) -> LanguageModel:
    """The same from Arrow columns lang, n, item and c."""
    keys, tables = [], []
    for n in range(MAX_N + 1):
        own = entries.filter(pc.equal(entries["n"], n))
        found, row = np.unique(item_hashes(own["item"].to_pylist(), n), return_inverse=True)
        counts = np.zeros((len(found), len(languages)))
        column = pc.index_in(own["lang"], value_set=pa.array(languages, own["lang"].type)).to_numpy()
        counts[row, column] = own["c"].to_numpy()
        total = np.maximum([float(totals.get((k, n), 0)) for k in languages], 1.0)
        # one floor for all, or a language with little text would win what it has never seen
        tables.append(np.log(np.maximum(counts / total, 0.5 / total.max())))
        keys.append(found)
    return LanguageModel(languages, keys, tables)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = shared.value.scorer()

        def compute(column: pa.Array) -> list:
            got = [x for i in range(0, len(column), 256) for x in score(column.slice(i, 256).to_pylist())]
            return [[g[0] for g in got], [g[1] for g in got]]

        return compute

    return append_columns(docs, [text_col], "lang_pred string, score double", make)
