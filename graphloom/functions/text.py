"""Text functions: question parsing, mentions, chunks, triples, labels and codes.

All but the longest-first mention matcher are Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUESTION_TYPES = {"who": "person", "whom": "person", "where": "place", "when": "time", "why": "reason", "how": "manner", "which": "choice", "what": "thing"}
HOP_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4}
STOP_WORDS = ("the", "a", "an", "of", "in", "on", "at", "to", "is", "are", "was", "were", "and", "or", "by", "for", "with", "that", "this", "it", "be")
AUXILIARY = ("is", "are", "was", "were", "be", "been", "has", "have", "had", "will", "would", "can", "could", "may", "might", "do", "does", "did")
PRONOUNS = ("it", "he", "she", "they", "him", "her", "them", "its", "his", "their")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+"), 0)


def question_type(text: Column) -> Column:
    first = F.regexp_extract(F.lower(F.coalesce(text, F.lit(""))), r"^\W*(\w+)", 1)
    table = F.create_map(*[F.lit(x) for kv in QUESTION_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, first), F.lit("other"))


def infer_hops(text: Column) -> Column:
    """Hops a question asks for: a number before ``hop``, else by its possessives and length."""
    low = F.lower(F.coalesce(text, F.lit("")))
    digit = F.regexp_extract(low, r"(\d+)[- ]hop", 1)
    word = F.regexp_extract(low, r"(one|two|three|four)[- ]hop", 1)
    table = F.create_map(*[F.lit(x) for kv in HOP_WORDS.items() for x in kv])
    n = F.size(words(text))
    return F.when(digit != "", digit.try_cast("int")).when(word != "", F.try_element_at(table, word)).when(low.rlike(r"\bof the\b.*\bof the\b"), F.lit(3)).when((n > 12) | low.contains("of the"), F.lit(2)).otherwise(F.lit(1))


def keywords(text: Column) -> Column:
    return F.array_distinct(F.filter(words(text), lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 2)))


def relation_tokens(rel: Column) -> Column:
    """Distinct words of a relation name."""
    return F.array_distinct(F.filter(F.split(F.lower(rel), r"[._/\s]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS)))


def relation_name_score(rel: Column, question: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Share of a relation's words that the question holds, and 0.2 if a synonym is there; at most 1."""
    tokens, asked = relation_tokens(rel), words(question)
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(tokens, asked)), F.size(tokens)), F.lit(0.0))
    bonus = F.lit(0.0)
    for word, others in (synonyms or {}).items():
        bonus = F.when(F.array_contains(tokens, word) & F.arrays_overlap(asked, F.array(*map(F.lit, others))), F.lit(0.2)).otherwise(bonus)
    return F.least(share + bonus, F.lit(1.0))


def extract_relations(questions: DataFrame, names: DataFrame, top_k: int = 5) -> DataFrame:
    """Relations (rel, keyword) by how many of their keywords a question (query_id, text) holds."""
    asked = questions.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("keyword"))
    hits = asked.join(names, "keyword").groupBy("query_id", "rel").agg(F.count("*").alias("hits"))
    order = Window.partitionBy("query_id").orderBy(F.desc("hits"), "rel")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def link_entities(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """The longest label (id, label) that stands in a question as whole words: query_id, id, label.

    Labels meet the questions on their first word, so the join is by key, and only questions that
    have a candidate are looked through."""
    first = questions.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("first"))
    lab = labels.select("id", F.concat_ws(" ", words(F.col("label"))).alias("label")).where("label <> ''").withColumn("first", F.split("label", " ")[0])
    candidates = first.join(lab, "first").select("query_id", "id", "label")
    line = questions.select("query_id", F.concat(F.lit(" "), F.concat_ws(" ", words(F.col("text"))), F.lit(" ")).alias("line"))
    found = line.join(candidates, "query_id").where(F.contains("line", F.concat(F.lit(" "), "label", F.lit(" "))))
    best = found.groupBy("query_id").agg(F.min(F.struct((-F.length("label")).alias("k"), "id", "label")).alias("b"))
    return best.select("query_id", "b.id", "b.label")


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: s != "")


def capital_mentions(text: Column) -> Column:
    """Runs of capitalised words."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*"), 0)


def verb_phrase(between: Column) -> Column:
    """The first word between two mentions that is no auxiliary or stop word; null if none."""
    return F.try_element_at(F.filter(words(between), lambda w: ~w.isin(*AUXILIARY) & ~w.isin(*STOP_WORDS)), F.lit(1))


def verb_relation(verb: Column, stems: dict[str, str], default: str = "RELATED_TO") -> Column:
    """Relation of the longest stem that a verb begins with."""
    out = F.lit(default)
    for stem, rel in sorted(stems.items(), key=lambda x: (len(x[0]), x[0])):
        out = F.when(F.startswith(verb, F.lit(stem)), F.lit(rel)).otherwise(out)
    return out


def sentence_chunks(text: Column, max_chars: int) -> Column:
    """Sentences joined into chunks of at most ``max_chars``; a longer sentence stands alone."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, s):
        fits = F.length(acc["open"]) + 1 + F.length(s) <= max_chars
        return (
            F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), s.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(" "), s).alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), s.alias("open")))
        )

    return F.aggregate(sentences(text), empty, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def sliding_chunks(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, each sharing ``overlap`` with the one before."""
    n = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size - overlap))
    useful = F.filter(starts, lambda s: (s == 1) | (s + overlap <= n))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(useful, lambda s: F.substring(text, s, F.lit(size))))


def dedup_triples(triples: DataFrame) -> DataFrame:
    """The best confidence of each triple."""
    return triples.groupBy("src", "rel", "dst").agg(F.max("confidence").alias("confidence"))


def merge_ensemble(triples: DataFrame) -> DataFrame:
    """The best confidence of each triple, a tenth more where several backends agree."""
    g = triples.groupBy("src", "rel", "dst").agg(F.max("confidence").alias("c"), F.countDistinct("backend").alias("backends"))
    return g.select("src", "rel", "dst", F.when(F.col("backends") >= 2, F.least(F.col("c") + 0.1, F.lit(1.0))).otherwise(F.col("c")).alias("confidence"), "backends")


def bigrams(text: Column) -> Column:
    low = F.lower(text)
    n = F.length(low) - 1
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(low, i, F.lit(2)))))


def bigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of letter bigrams."""
    x, y = bigrams(a), bigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def parse_linearised(text: Column) -> Column:
    """Triples of ``<triplet> head <subj> tail <obj> relation`` texts."""
    parts = F.regexp_extract_all(text, F.lit(r"<triplet>\s*([^<]*?)\s*<subj>\s*([^<]*?)\s*<obj>\s*([^<]*)"), 0)
    one = lambda p, i: F.trim(F.regexp_extract(p, r"<triplet>\s*([^<]*?)\s*<subj>\s*([^<]*?)\s*<obj>\s*([^<]*)", i))
    return F.transform(parts, lambda p: F.struct(one(p, 1).alias("src"), one(p, 3).alias("rel"), one(p, 2).alias("dst")))


def parse_pipes(text: Column) -> Column:
    """Triples of ``s | R | o`` lines."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.split(x, r"\s*\|\s*")), lambda p: F.size(p) == 3)
    return F.transform(lines, lambda p: F.struct(F.trim(p[0]).alias("src"), F.trim(p[1]).alias("rel"), F.trim(p[2]).alias("dst")))


def known_mentions(text: Column, names: list[str]) -> Column:
    """Known names in a text, longest first where they overlap, at word ends, without case."""
    if not names:
        return F.array().cast("array<string>")
    import re

    pattern = "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n)))
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)(?<![\p{{L}}])(?:{pattern})(?![\p{{L}}])"), 0)


def triples_of(docs: DataFrame, stems: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Triples of neighbouring capitalised mentions in a sentence, with the verb between them."""
    s = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(sentences(F.col(text_col))).alias("sentence", "s"))
    m = s.select("doc_id", "sentence", "s", capital_mentions(F.col("s")).alias("m")).where("size(m) >= 2")
    pairs = m.select("doc_id", "sentence", "s", F.explode(F.arrays_zip(F.slice("m", F.lit(1), F.size("m") - 1).alias("a"), F.slice("m", F.lit(2), F.size("m") - 1).alias("b"))).alias("p"))
    start = F.instr(F.col("s"), F.col("p.a")) + F.length("p.a")
    gap = F.substring(F.col("s"), start, F.greatest(F.instr(F.col("s"), F.col("p.b")) - start, F.lit(0)))
    return pairs.select("doc_id", "sentence", F.col("p.a").alias("src"), verb_relation(F.coalesce(verb_phrase(gap), F.lit("")), stems).alias("rel"), F.col("p.b").alias("dst"))


def previous_turns(turns: DataFrame) -> DataFrame:
    """Each turn with the text before it, whether it refers back, and whether its text was said
    before in the conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    same = Window.partitionBy("conv_id", "text").orderBy("turn")
    opener = F.regexp_extract(F.lower(F.coalesce("text", F.lit(""))), r"^\W*(\w+)", 1)
    return turns.select(
        "conv_id",
        "turn",
        "role",
        F.lag("text").over(order).alias("previous"),
        F.arrays_overlap(words(F.col("text")), F.array(*map(F.lit, PRONOUNS))).alias("refers"),
        opener.isin("and", "also", "but", "so", "then").alias("follow_up"),
        (F.row_number().over(same) > 1).alias("repeated"),
    )


def utterance_edges(turns: DataFrame) -> DataFrame:
    """The dialogue as edges: a turn follows the one before, and is said by its role."""
    name = F.concat_ws(":", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    before = F.lag(name).over(order)
    follows = turns.select(name.alias("src"), F.lit("FOLLOWS").alias("rel"), before.alias("dst")).where("dst is not null")
    said = turns.select(name.alias("src"), F.lit("SAID_BY").alias("rel"), F.concat(F.lit("role:"), F.coalesce("role", F.lit(""))).alias("dst"))
    return follows.unionByName(said)


#: Relations from a dialogue act to what it speaks of.
ACT_RELATIONS = ("references", "elaborates", "confirms", "requests", "entails")


def act_edges(turns: DataFrame) -> DataFrame:
    """An edge from every turn to each of its keywords: a question requests, an agreement confirms, a later turn of the
    assistant elaborates, any other references."""
    name = F.concat_ws(":", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    low = F.lower(F.coalesce("text", F.lit("")))
    rel = F.when(F.contains(low, F.lit("?")), "requests").when(low.rlike(r"^(yes|right|exactly|correct)\b"), "confirms").when((F.col("role") == "assistant") & (F.col("turn") > 0), "elaborates").otherwise("references")
    return turns.select(name.alias("src"), rel.alias("rel"), F.explode(keywords(F.coalesce("text", F.lit("")))).alias("dst"))


def recall_about(edges: DataFrame, entity: str) -> DataFrame:
    """Dialogue acts (src, rel) that speak of an entity; if none has its name, of the first one that has it in another case."""
    named = edges.where(F.lower("dst") == entity.lower())
    meant = named.agg(F.min(F.struct(F.col("dst") != entity, "dst")).alias("m")).select(F.col("m.dst").alias("dst"))
    return named.where(F.col("rel").isin(*ACT_RELATIONS)).join(meant, "dst", "left_semi").select("src", "rel")


def frequency_codes(items: DataFrame, column: str) -> DataFrame:
    """A number per value, 0 for the most frequent: value, n, code.  The values are few (relations),
    so their one window is small."""
    g = items.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return g.withColumn("code", F.row_number().over(Window.orderBy(F.desc("n"), "value")) - 1)


def hash_embedding(tokens: Column, dim: int = 16) -> Column:
    """A stand-in encoder: the normalised sum of the tokens' seeded vectors.  Where a language model is
    at hand, use ``encode`` with it."""
    from graphloom.functions.vectors import normalized

    one = lambda t: F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", t, i.cast("string"))), 1, 6), 16, 10).cast("bigint"), F.lit(2001)) / 1000.0 - 1.0)
    zero = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.lit(0.0))
    return normalized(F.aggregate(F.transform(tokens, one), zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b)))


def encode(column: Column, encoder, dim: int) -> Column:
    """Embed texts by a callable from a list of texts to a list of vectors, in Arrow batches."""
    import pandas as pd

    def run(texts):
        return pd.Series([list(map(float, v))[:dim] for v in encoder(texts.fillna("").tolist())])

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<double>")(column)


def detect_relations(questions: DataFrame, relations: DataFrame, part: str = "tail", n: int = 4, min_gap: float = 0.0) -> DataFrame:
    """The relation (rel) nearest to the first or last ``n`` content words of a question (query_id,
    text), if it is ahead of the next one by ``min_gap``: query_id, rel, score."""
    from graphloom.functions.vectors import cosine

    content = F.filter(words(F.col("text")), lambda w: ~w.isin(*STOP_WORDS))
    window = F.slice(content, F.lit(1), F.lit(n)) if part == "head" else F.slice(content, F.greatest(F.size(content) - n + 1, F.lit(1)), F.lit(n))
    q = questions.select("query_id", hash_embedding(window).alias("q"))
    r = relations.select("rel").distinct().withColumn("v", hash_embedding(relation_tokens(F.col("rel"))))
    scored = q.join(r).select("query_id", "rel", F.round(cosine(F.col("q"), F.col("v")), 9).alias("score"))  # the relations of a graph are few
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rel")
    ranked = scored.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead("score").over(order))
    return ranked.where((F.col("rank") == 1) & (F.col("next").isNull() | (F.col("score") - F.col("next") >= min_gap))).select("query_id", "rel", "score")
