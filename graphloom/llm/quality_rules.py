"""Quality rules with adaptive thresholds.

Four rates of each document (integers per thousand, or hundredths of a character) are held against
thresholds learnt from the documents of the same language and source.  The thresholds come from
mergeable quantile sketches: histograms of log-linear bins (32 per power of two, so a quantile is
within about 3 per cent), counted with partial aggregation and merged by adding counts.  A group of fewer
than ``min_group`` documents uses the merged sketch of its language, a small language that of all
documents.  A document fails a rule that is out of the fence ``quartile -/+ reach * spread``, where
the spread is the interquartile range but at least the rule's least spread.

Sketches cover all documents with a word.  Null languages and sources are groups like others.  A
null text has no words and fails the base rules.  Repeated rows count each time.  Documents of any
length are read whole.  An empty table gives an empty result.  Existing columns of the same name
are replaced; others pass through ``rate`` but not the thin query.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import append_columns, texts
from graphloom.storage import materialize

_NO_SPACE = bytes(x for x in range(256) if x not in b" \t\n\r\x0b\x0c" and not 0x80 <= x < 0xC0)
_DROP = bytes(x for x in range(256) if x not in _NO_SPACE)
_NO_SYMBOL = bytes(x for x in range(256) if x not in b"#*$%&|<>")
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"
#: rate -> (expression, whether low values fail too, least spread)
RATES = {
    "word_len": ("100 * word_chars div n_words", True, 30),
    "symbols": ("1000 * n_symbols div word_chars", False, 10),
    "dup_lines": ("1000 * n_dup_lines div n_lines", False, 100),
    "repeats": ("1000 * n_repeat_words div n_words", False, 100),
}
_P = 5
#: Bytes above which a text is measured in parts.
LONG = 1_000_000
_GAP, _NOT_GAP = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[^\x20\x09-\x0D]")


def repeated_words(words: np.ndarray) -> int:
    """Words in windows of three that occur twice or more, from the words' hashes."""
    if len(words) < 3:
        return 0
    window = np.zeros(len(words) - 2, np.uint64)
    for i in range(3):
        window = (window + words[i : len(words) - 2 + i]) * np.uint64(0x9E3779B97F4A7C15)
        window ^= window >> np.uint64(29)
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    covered = np.zeros(len(words), bool)
    for at in (order[1:][same], order[:-1][same]):
        for d in range(3):
            covered[at + d] = True
    return int(covered.sum())


def measure_long(text: bytes) -> tuple[int, int, int, int, int, int]:
    """``measure`` in memory of some times the text: words and lines are held as 64-bit hashes, a part of the text
    at a time."""
    hashes, at = [], 0
    while at < len(text):
        gap = _GAP.search(text, min(at + LONG, len(text)))
        end = gap.start() if gap else len(text)
        words = text[at:end].split()
        hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end + 1
    words = np.concatenate(hashes)
    lines, at = [], 0
    while at <= len(text) and len(words):
        end = text.find(b"\n", at)
        end = len(text) if end < 0 else end
        if _NOT_GAP.search(text, at, end):
            lines.append(xxhash.xxh3_64_intdigest(text[at:end]))
        at = end + 1
    lines = np.array(lines, np.uint64)
    chars, symbols = len(text.translate(None, _DROP)), len(text.translate(None, _NO_SYMBOL))
    return len(words), chars, symbols, len(lines) - len(np.unique(lines)), repeated_words(words), len(lines)


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    if len(text) > LONG:
        return measure_long(text)
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _DROP))
    symbols = len(text.translate(None, _NO_SYMBOL))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")] if n else []
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    repeated = 0
    if len(seen) < len(windows):
        covered = np.zeros(n, bool)
        at = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
        for d in range(3):
            covered[d : d + len(at)] |= at
        repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the measures of every whole text."""

    def make():
        def compute(column: pa.Array):
            return list(zip(*map(measure, texts(column))))

        return compute

    return append_columns(docs, [text_col], MEASURES, make)


def bin_of(v: Column) -> Column:
    """Log-linear bin of a non-negative integer."""
    v = v.cast("bigint")
    e = F.greatest(F.length(F.bin(v)) - (_P + 1), F.lit(0))
    low = F.lit(1 << _P)
    return F.when(v < low, v).otherwise(((e + 1) * low + F.call_function("shiftright", v, e) - low).cast("bigint"))


def value_of(b: Column) -> Column:
    """Least value of a bin."""
    low = F.lit(1 << _P).cast("bigint")
    return F.when(b < low, b).otherwise(F.call_function("shiftleft", F.pmod(b, low) + low, (F.shiftright(b, _P) - 1).cast("int")))


def sketches(rated: DataFrame, keys: list[str]) -> DataFrame:
    """Bins and counts by group and rate; merge by summing ``n`` over fewer keys."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), bin_of(F.col(r)).alias("bin")) for r in RATES]))
    return rated.select(*keys, each.alias("x")).groupBy(*keys, "x.rate", "x.bin").agg(F.count("*").alias("n"))


def quartiles(bins: DataFrame, keys: list[str]) -> DataFrame:
    """First and third quartile by group and rate.  A window holds the bins of one group and rate:
    at most 32 for each power of two."""
    over = Window.partitionBy(*keys, "rate")
    ranked = bins.select(
        *keys,
        "rate",
        "bin",
        F.sum("n").over(over.orderBy("bin")).alias("upto"),
        F.sum("n").over(over).alias("total"),
    )
    return ranked.groupBy(*keys, "rate").agg(
        value_of(F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bin")))).alias("q1"),
        value_of(F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bin")))).alias("q3"),
        F.max("total").alias("members"),
    )


def thresholds(bins: DataFrame, min_group: int, reach: int) -> DataFrame:
    """Fences by language and source, a column pair per rate, with back-off to merged sketches."""
    by_lang = bins.groupBy("lang", "rate", "bin").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("rate", "bin").agg(F.sum("n").alias("n"))
    level = lambda q, p: q.select(*[c for c in ("lang", "source") if c in q.columns], "rate", *[F.col(c).alias(f"{p}_{c}") for c in ("q1", "q3", "members")])
    own = level(quartiles(bins, ["lang", "source"]), "s")
    lang = level(quartiles(by_lang, ["lang"]), "l").withColumnRenamed("lang", "l_lang").withColumnRenamed("rate", "l_rate")
    base = level(quartiles(overall, []), "g")
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rate") == F.col("l_rate"))).join(base, "rate")
    pick = lambda c: F.when(F.col("s_members") >= min_group, F.col(f"s_{c}")).when(F.col("l_members") >= min_group, F.col(f"l_{c}")).otherwise(F.col(f"g_{c}"))
    least = F.element_at(F.create_map(*[F.lit(x) for r, (_, _, s) in RATES.items() for x in (r, s)]), F.col("rate"))
    spread = F.greatest(pick("q3") - pick("q1"), least) * reach
    fences = joined.select("lang", "source", "rate", (pick("q1") - spread).alias("low"), (pick("q3") + spread).alias("high"))
    one = lambda r, c: F.max(F.when(F.col("rate") == r, F.col(c))).alias(f"{r}_{c}")
    return fences.groupBy("lang", "source").agg(*[one(r, c) for r in RATES for c in ("low", "high")])


def judge(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    id_col: str = "doc_id",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_group: int = 200,
    reach: int = 3,
) -> DataFrame:
    """Measures, base verdict and kept flag of every document."""
    measured = measures(docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), "text")
    rated = materialize(measured.drop("text"), "measures").withColumns({r: F.when(F.col("n_words") > 0, F.expr(e)) for r, (e, _, _) in RATES.items()})
    fences = thresholds(sketches(rated.where("n_words > 0"), ["lang", "source"]), min_group, reach)
    fences = materialize(fences.withColumnsRenamed({"lang": "f_lang", "source": "f_source"}), "fences")
    # the groups are few beside the documents; the optimizer broadcasts them below its own limit and splits a hot group otherwise
    joined = rated.join(fences, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    passed = F.lit(True)
    for r, (_, low, _) in RATES.items():
        passed = passed & (F.col(r) <= F.col(f"{r}_high"))
        if low:
            passed = passed & (F.col(r) >= F.col(f"{r}_low"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.coalesce(passed, F.lit(False))).alias("kept"),
        *RATES,
    )
