"""Interpolated modified Kneser-Ney language model over word bigrams.

Counting is one Spark job per kind of count.  Tasks hash the words of their texts, count bigrams
in sorted arrays and send compressed blocks to shards; a shard merges its blocks and writes sorted
hash arrays into the shared folder, which the scoring workers memory-map.  The files of a model:

* ``vocab``  64-bit word hashes and their counts;
* ``grams``  52 bits of each bigram's hash with its count in the low 12 bits (a full field refers
  to ``large``, which has hash and count);
* ``ctx``    48-bit hashes of contexts, with how often they occur and how many words follow them
  once, twice, and three or more times;
* ``cont``   48-bit word hashes with the number of distinct words before them.

Shards are ranges of hashes: of the context for most bigrams, of the bigram for contexts so common
that one shard would not hold them (those with more than a quarter of a shard's tokens; at most four times as
many as shards).  The number of shards grows with the text, so a shard's size does not.

The probability of w after h is (c(h,w) - D) / c(h) + gamma(h) * p(w), with p(w) the discounted share of
w among all distinct bigrams, interpolated with the uniform distribution over the vocabulary and
one unknown word.  Discounts D1, D2, D3+ of either level come from the counts of counts.

Defined results: a null text is an empty one, whose only token is its end.  Equal texts score
equally.  Rows with a null or equal id are texts of their own.  Texts of any length are scored
whole, in slices cut at white space.  Without training rows every token has probability 1 (a vocabulary of the
unknown word alone).  An empty table gives an empty result.  Existing columns of the same name are
replaced; others pass through.

The folder must be one that executors can open as files (a local or mounted path); for another
file system ``train`` says so and stops.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import append_columns, emit, texts
from graphloom.storage import materialize, shared_path

END, BEGIN = b" end", b" begin"  # no word has a space
SHARD_TOKENS = 1 << 21
FLUSH_TOKENS = 1_500_000
#: Bytes of text that are cut into words at a time.
SLICE_BYTES = 3_000_000
_LOW = np.uint64(0xFFF)
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
#: Memory-mapped files that a worker keeps open.
OPEN_FILES = 400


class Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes, cut at white space."""
    at = 0
    while len(text) - at > size and (gap := _SPACE.search(text, at + size)):
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:]


@dataclass
class Slice:
    """Hashes of tokens in a row and of the token before each.  ``first`` is where each text, or its rest, begins
    and ``text`` its number in the batch."""

    tokens: np.ndarray
    before: np.ndarray
    first: np.ndarray
    text: np.ndarray


def stream(batch: Iterable[bytes], hashes: Hashes, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """All tokens of a batch, each text followed by its end, in slices of about ``size`` bytes; a longer text has
    several."""
    begin = xxhash.xxh3_64_intdigest(BEGIN)
    flat: list[bytes] = []
    first: list[int] = []
    numbers: list[int] = []
    held, before = 0, begin  # the last token, or the begin mark after an end

    def take() -> Slice:
        nonlocal before, held
        tokens = np.fromiter(map(hashes.__getitem__, flat), np.uint64, len(flat))
        at = np.array(first)
        prior = np.empty_like(tokens)
        prior[1:] = tokens[:-1]
        prior[at] = begin
        prior[0] = before
        before = begin if flat[-1] is END else int(tokens[-1])
        out = Slice(tokens, prior, at, np.array(numbers))
        flat.clear(), first.clear(), numbers.clear()
        held = 0
        return out

    for i, text in enumerate(batch):
        if len(text) <= size:
            if flat and held + len(text) > size:
                yield take()
            first.append(len(flat))
            numbers.append(i)
            flat += text.lower().split()
            flat.append(END)
            held += len(text)
            continue
        # slices of its own, so that equal texts are summed in equal parts
        if flat:
            yield take()
        for piece in pieces(text, size):
            if words := piece.lower().split():
                if flat:
                    yield take()
                first.append(0)
                numbers.append(i)
                flat += words
        if not flat:
            first.append(0)
            numbers.append(i)
        flat.append(END)
        yield take()
    if flat:
        yield take()


def gram_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = h * np.uint64(0x9E3779B97F4A7C15) + w
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def pack(arrays: list[np.ndarray], widths: list[int]) -> bytes:
    """Arrays of equal length as planes of their low bytes, compressed."""
    planes = [np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for a, w in zip(arrays, widths)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes, widths: list[int]) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(raw) // sum(widths)
    out, at = [], 0
    for w in widths:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :w] = raw[at : at + n * w].reshape(w, n).T
        out.append(wide.view("<u8").ravel())
        at += n * w
    return out


def merge(blocks: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sum the last array over equal values of the others, sorted by them."""
    arrays = [np.concatenate(a) for a in zip(*blocks)]
    *keys, n = arrays
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    first = np.ones(len(order), bool)
    first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(first)
    return [*[k[at] for k in keys], np.add.reduceat(n[order], at) if len(at) else n]


def slices(h: np.ndarray, bits: int, width: int) -> Iterator[tuple[int, slice]]:
    """Parts of a sorted array of ``width``-bit hashes by their top bits."""
    shard = (h >> np.uint64(width - bits)).astype(np.int64)
    at = np.flatnonzero(np.diff(shard, prepend=-1))
    for i, j in zip(at, [*at[1:], len(h)]):
        yield int(shard[i]), slice(i, j)


def save(folder: str, kind: str, shard: int, array: np.ndarray) -> None:
    """Write one array; a repeated task writes the same file again, whole."""
    os.makedirs(f"{folder}/{kind}", exist_ok=True)
    path = f"{folder}/{kind}/{shard}.npy"
    part = f"{folder}/{kind}/.{shard}-{uuid.uuid4().hex}.npy"
    np.save(part, array)
    os.replace(part, path)


def open_folder(path: str) -> str:
    """The path as files are opened by."""
    local = re.sub(r"^file:/+", "/", path)
    if re.match(r"^[a-z][a-z0-9+.-]*:", local):
        raise ValueError(f"the model is memory-mapped by workers, so {path} must be a mounted folder")
    return local


def discounts(n: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more from the numbers of things with counts 1 to 4."""
    n1, n2, n3, n4 = n
    out = [0.0, 0.5, 1.0, 1.5]
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
            if a and b:
                out[k] = min(max(k - (k + 1) * y * b / a, 0.05), k)
    return np.array(out)


@dataclass
class LanguageModel:
    folder: str
    bits: int
    tokens: int
    types: int
    #: discounts of the bigrams and of the continuation counts
    d: np.ndarray
    d0: np.ndarray
    #: distinct bigrams, and the share of them that the unigram discounts free
    bigrams: int
    free: float
    #: contexts spread over all shards: sorted hashes, and rows of (count, ones, twos, more)
    hot: np.ndarray
    hot_stats: np.ndarray
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def array(self, kind: str, shard: int) -> np.ndarray | None:
        """A memory-mapped array; None if the shard has none or an empty one.  The least recently used ones are closed."""
        key = (kind, shard)
        if key in self._open:
            self._open[key] = found = self._open.pop(key)  # now the last
            return found
        path = f"{self.folder}/{kind}/{shard}.npy"
        found = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        self._open[key] = found = found if found is not None and len(found) else None
        while len(self._open) > OPEN_FILES:
            del self._open[next(iter(self._open))]
        return found

    def find(self, kind: str, values: str, keys: np.ndarray, width: int, out: np.ndarray) -> np.ndarray:
        """Values of sorted keys; what is not there stays as ``out`` has it."""
        for shard, part in slices(keys, self.bits, width):
            if (known := self.array(kind, shard)) is not None:
                at = np.minimum(np.searchsorted(known, keys[part]), len(known) - 1)
                hit = known[at] == keys[part]
                out[part][hit] = self.array(values, shard)[at[hit]]
        return out

    def gram_counts(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Counts of bigrams given as 48-bit hashes."""
        g = gram_hash(h, w)
        spread = np.isin(h, self.hot)
        shard = np.where(spread, g >> np.uint64(64 - self.bits), h >> np.uint64(48 - self.bits)).astype(np.int64)
        order = np.lexsort((g, shard))
        out = np.zeros(len(g), np.int64)
        at = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for i, j in zip(at, [*at[1:], len(g)]):
            rows = order[i:j]
            k = int(shard[rows[0]])
            if (known := self.array("grams", k)) is None:
                continue
            key = g[rows] >> np.uint64(12)
            place = np.minimum(np.searchsorted(known, key << np.uint64(12)), len(known) - 1)
            found = known[place]
            count = np.where(found >> np.uint64(12) == key, found & _LOW, 0).astype(np.int64)
            if (full := count == 4095).any():
                large = self.array("large", k)
                count[full] = large[np.searchsorted(large[:, 0], key[full].astype(np.int64)), 1]
            out[rows] = count
        return out

    def unigram(self, cont: np.ndarray) -> np.ndarray:
        uniform = 1.0 / (self.types + 1)
        if not self.bigrams:
            return np.full(len(cont), uniform)
        return np.maximum(cont - self.d0[np.minimum(cont, 3)], 0) / self.bigrams + self.free * uniform

    def token_scores(self, part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By token: whether it is known, log10 of the base probability and of the model's after the token before."""
        words, at = np.unique(part.tokens, return_inverse=True)
        count = self.find("vocab", "vocab_n", words, 64, np.zeros(len(words), np.int64))
        base = np.log10((count + 1) / (self.tokens + self.types + 1))
        short = words >> np.uint64(16)
        lower = self.unigram(self.find("cont", "cont_n", short, 48, np.zeros(len(words), np.int64)))
        # contexts: the words of the slice, the begin mark, and what stands before the slice
        size = len(words)
        begin = xxhash.xxh3_64_intdigest(BEGIN)
        contexts = np.append(short, np.array([begin, part.before[0]], np.uint64) >> np.uint64(16))
        stats = np.zeros((size + 2, 4), np.int64)
        self.find("ctx", "ctx_n", short, 48, stats[:size])
        self.find("ctx", "ctx_n", contexts[size + 1 :], 48, stats[size + 1 :])
        if len(self.hot):
            place = np.minimum(np.searchsorted(self.hot, contexts), len(self.hot) - 1)
            hit = self.hot[place] == contexts
            stats[hit] = self.hot_stats[place[hit]]
        free = stats[:, 1:] @ self.d[1:]
        prior = np.empty_like(at)
        prior[1:] = at[:-1]
        prior[part.first] = size
        prior[0] = size + int(part.before[0] != begin)
        pair, back = np.unique(prior * size + at, return_inverse=True)
        h, w = pair // size, pair % size
        c = self.gram_counts(contexts[h], short[w])
        total = stats[h, 0]
        p = np.where(total > 0, (np.maximum(c - self.d[np.minimum(c, 3)], 0) + free[h] * lower[w]) / np.maximum(total, 1), lower[w])
        return (count > 0)[at], base[at], np.log10(p)[back]


def _count_vocab(bits: int):
    def make():
        hashes, held = Hashes(), []

        def drain() -> dict:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            parts = list(slices(words, bits, 64))
            return {"shard": [s for s, _ in parts], "block": [pack([words[p], n[p]], [8, 4]) for _, p in parts]}

        def step(*columns) -> Iterator[dict]:
            for part in stream(texts(columns[0]), hashes) if columns else ():
                held.append(part.tokens)
                if sum(map(len, held)) >= FLUSH_TOKENS:
                    yield drain()
            if held and not columns:
                yield drain()

        return step

    return make


def _count_grams(bits: int, hot: np.ndarray):
    def make():
        hashes, held = Hashes(), []

        def drain() -> Iterator[dict]:
            h, w = (np.concatenate(x) >> np.uint64(16) for x in zip(*held))
            held.clear()
            words, at = np.unique(np.concatenate([h, w]), return_inverse=True)
            pair, n = np.unique(at[: len(h)] * len(words) + at[len(h) :], return_counts=True)
            h, w = words[pair // len(words)], words[pair % len(words)]
            spread = np.isin(h, hot)
            for mask in (~spread, spread):
                a, b, c = h[mask], w[mask], n[mask]
                key, width = (a, 48) if mask is not spread else (gram_hash(a, b), 64)
                shard = (key >> np.uint64(width - bits)).astype(np.int64)
                order = np.argsort(shard, kind="stable")  # context and word stay in order within a shard
                a, b, c, shard = a[order], b[order], c[order], shard[order]
                cut = np.flatnonzero(np.diff(shard, prepend=-1))
                parts = [(int(shard[i]), slice(i, j)) for i, j in zip(cut, [*cut[1:], len(shard)])]
                yield {"shard": [s for s, _ in parts], "block": [pack([a[p], b[p], c[p]], [6, 6, 4]) for _, p in parts]}

        def step(*columns) -> Iterator[dict]:
            for part in stream(texts(columns[0]), hashes) if columns else ():
                held.append((part.before, part.tokens))
                if sum(len(x[1]) for x in held) >= FLUSH_TOKENS:
                    yield from drain()
            if held and not columns:
                yield from drain()

        return step

    return make


def _write_vocab(folder: str, common: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        words, n = merge([unpack(b, [8, 4]) for b in table["block"].to_pylist()])
        n = n.astype(np.int64)
        save(folder, "vocab", shard, words)
        save(folder, "vocab_n", shard, n)
        hot = (words[n >= common] >> np.uint64(16)).astype(np.int64)
        return pa.table({"types": pa.array([len(words)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64()), "hot": pa.array([hot], pa.list_(pa.int64()))})

    return run


_GRAM_ROWS = "kind int, shard int, block binary, h bigint, a bigint, b bigint, c bigint, d bigint"


def _write_grams(folder: str, bits: int, hot: np.ndarray):
    """Files of a shard; returns counts of counts (kind 0), partial statistics of spread contexts
    (kind 1) and blocks of continuation counts (kind 2)."""

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        h, w, n = merge([unpack(b, [6, 6, 4]) for b in table["block"].to_pylist()])
        n = n.astype(np.int64)
        key = gram_hash(h, w) >> np.uint64(12)
        order = np.argsort(key)
        save(folder, "grams", shard, (key[order] << np.uint64(12)) | np.minimum(n[order], 4095).astype(np.uint64))
        big = order[n[order] >= 4095]
        save(folder, "large", shard, np.stack([key[big].astype(np.int64), n[big]], axis=1))
        first = np.flatnonzero(np.diff(h, prepend=h[0] ^ np.uint64(1)))
        stats = np.stack([np.add.reduceat(x, first) for x in (n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n >= 3).astype(np.int64))], axis=1)
        ctx = h[first]
        spread = np.isin(ctx, hot)
        save(folder, "ctx", shard, ctx[~spread])
        save(folder, "ctx_n", shard, stats[~spread])
        rows = [(0, shard, None, len(n), *(int((n == k).sum()) for k in (1, 2, 3, 4)))]
        rows += [(1, shard, None, int(x), *map(int, s)) for x, s in zip(ctx[spread], stats[spread])]
        after, m = np.unique(w, return_counts=True)
        rows += [(2, s, pack([after[p], m[p]], [6, 4]), None, None, None, None, None) for s, p in slices(after, bits, 48)]
        kinds = (pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 5)
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["kind", "shard", "block", "h", "a", "b", "c", "d"])

    return run


def _write_cont(folder: str):
    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        w, n = merge([unpack(b, [6, 4]) for b in table["block"].to_pylist()])
        n = n.astype(np.int64)
        save(folder, "cont", shard, w)
        save(folder, "cont_n", shard, n)
        return pa.table({k: pa.array([int(v)], pa.int64()) for k, v in zip(("n1", "n2", "n3", "n4", "more"), (*((n == k).sum() for k in (1, 2, 3, 4)), (n >= 3).sum()))})

    return run


def train(docs: DataFrame, text_col: str = "text", use: Column | None = None, shard_tokens: int = SHARD_TOKENS) -> LanguageModel:
    """Count all rows that ``use`` marks (default: all) and write the model's files."""
    spark = docs.sparkSession
    rows = docs if use is None else docs.where(use)
    rows = rows.select(F.col(text_col).alias("text"))
    folder = open_folder(shared_path(spark, "lm"))
    size = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    about = (size[0] or 0) / 6 + size[1] + 1  # tokens
    bits = max(1, int(np.ceil(np.log2(max(2.0, about / shard_tokens)))))
    common = max(50, int(about / (4 << bits)))

    vocab = emit(rows, ["text"], "shard int, block binary", _count_vocab(bits)).groupBy("shard").applyInArrow(_write_vocab(folder, common), "types bigint, tokens bigint, hot array<bigint>")
    parts = vocab.collect()  # a row per shard
    begin = xxhash.xxh3_64_intdigest(BEGIN) >> 16
    hot = np.array(sorted({begin, *(h for p in parts for h in p.hot)}), np.uint64)

    grams = emit(rows, ["text"], "shard int, block binary", _count_grams(bits, hot)).groupBy("shard").applyInArrow(_write_grams(folder, bits, hot), _GRAM_ROWS)
    grams = materialize(grams, "bigrams")
    n = grams.where("kind = 0").agg(*[F.sum(x) for x in "habcd"]).first()
    found = {r[0]: list(r[1:]) for r in grams.where("kind = 1").groupBy("h").agg(*[F.sum(x) for x in "abcd"]).collect()}  # the spread contexts
    cont = grams.where("kind = 2").select("shard", "block").groupBy("shard").applyInArrow(_write_cont(folder), "n1 bigint, n2 bigint, n3 bigint, n4 bigint, more bigint")
    m = cont.agg(*[F.sum(x) for x in ("n1", "n2", "n3", "n4", "more")]).first()
    n, m = [int(x or 0) for x in n], [int(x or 0) for x in m]
    d0 = discounts(m[:4])
    free = float(d0[1] * m[0] + d0[2] * m[1] + d0[3] * m[4]) / n[0] if n[0] else 1.0
    stats = np.array([found.get(int(h), [0, 0, 0, 0]) for h in hot], np.int64).reshape(-1, 4)
    return LanguageModel(folder, bits, sum(p.tokens for p in parts), sum(p.types for p in parts), discounts(n[1:]), d0, n[0], free, hot, stats)


def score(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Add n_tokens, n_known, base_score and score (log10 of the text's probability)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        hashes = Hashes()

        def compute(column: pa.Array):
            counts, sums = np.zeros((2, len(column)), np.int64), np.zeros((2, len(column)))
            for part in stream(texts(column), hashes):
                known, base, mine = shared.value.token_scores(part)
                counts[0, part.text] += np.diff(part.first, append=len(part.tokens))
                counts[1, part.text] += np.add.reduceat(known.astype(np.int64), part.first)
                sums[0, part.text] += np.add.reduceat(base, part.first)
                sums[1, part.text] += np.add.reduceat(mine, part.first)
            return [*counts, *sums]

        return compute

    return append_columns(docs, [text_col], "n_tokens bigint, n_known bigint, base_score double, score double", make)


def perplexity(score_col: str = "score", tokens_col: str = "n_tokens") -> Column:
    return F.pow(F.lit(10.0), -F.col(score_col) / F.col(tokens_col))
