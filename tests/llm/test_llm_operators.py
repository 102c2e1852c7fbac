"""Each operator against a brute-force version on small tables, with nulls, empty and long texts,
ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat_tree, jaccard_join, language_id, license_scan, lm, media, mixing, packing, quality_classifier, quality_rules, tokens

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size string, N_WORDS int"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def rows_of_all_kinds():
    rows = [
        (1, "the cat sat on the mat and the dog ran", "en", "a", 3, 0.5, "x", 1),
        (2, None, "en", "a", None, None, None, None),
        (3, "", "de", None, 0, 0.1, "", 2),
        (4, " \t\n ", None, "b", 4, 0.1, "y", 2),
        (None, "der hund und die katze", "de", "b", 4, 0.1, "y", 2),
        (5, "der hund und die katze", "de", "b", 4, 0.1, "y", 2),
        (5, "der hund und die katze", "de", "b", 4, 0.1, "y", 2),
        (6, LONG, "en", "a", 4, 0.1, "y", 2),
        (7, "MIT License!! 42 ###", None, None, 4, 0.1, "y", 2),
        (8, "été \U0001f600 中文", "fr", "c", 4, 0.1, "y", 2),
    ]
    return rows + [(100 + i, words(60, i), "en", "a", 1, 0.0, "z", 0) for i in range(20)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of_all_kinds(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i > 110)) for i in range(100, 120)] + [(1, None, 0), (None, 1, 0), (100, 0, None)], "doc_id bigint, quality int, toxic int")


# ---------------------------------------------------------------- language ID


def test_language_id_predicts_and_defines_odd_rows(docs, empty):
    model = language_id.train(docs)
    got = {(r.doc_id, r.text): r for r in language_id.identify(docs, model).collect()}
    assert len(got) == docs.distinct().count()
    assert got[1, "the cat sat on the mat and the dog ran"].lang_pred == "en"
    assert got[None, "der hund und die katze"].lang_pred == "de"
    for key in [(2, None), (3, ""), (4, " \t\n ")]:
        assert (got[key].lang_pred, got[key].score) == ("und", 0.0)
    assert all(0.0 <= r.score <= 1.0 for r in got.values())
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.train(empty)
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_language_id_backs_off_to_shorter_grams():
    entries = [("a", 0, "aaa", 5), ("b", 0, "bbb", 5), ("a", 2, "xy", 3), ("b", 1, "z", 4), ("a", 1, "x", 1)]
    model = language_id.assemble(["a", "b"], entries, {("a", n): 10 for n in range(6)} | {("b", n): 10 for n in range(6)})
    assert model.predict("aaa")[0] == "a"  # a known word
    at, hit = model.rows(2, language_id.item_hashes(["xy"], 2))
    assert hit.all() and np.allclose(model.unseen("qxyq"), model.tables[2][at[0]])  # the longest known length decides
    assert model.predict("qz qz")[0] == "b"
    assert np.allclose(model.unseen("qq"), 0.0)
    few = model.scorer(memo=1)  # more words than are remembered
    assert few(["qz wz ez rz qxyq"] * 3) == [model.predict("qz wz ez rz qxyq")] * 3


def test_language_id_keeps_as_many_entries_of_each_language(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k, i: f"{letters[k]}{letters[i % 26]}{letters[i // 26 % 26]}{letters[i // 676]}q"
    text = lambda k, n: " ".join(word(k, i) for i in range(n))
    rows = [(k, text(k, 2000), f"l{k:02d}") for k in range(20)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model.languages) == 20
    assert all(model.knows(0, word(k, i)) for k in range(20) for i in range(2000))
    few = language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), max_entries=600)
    assert len(few.languages) == 20
    # four languages keep what they kept before the entries were halved
    rows = [(k, text(k, 8000), f"l{k:02d}") for k in range(4)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(model.keys[0]) == 32_000


def brute_language_model(rows, quota):
    """(known items by length with their log frequencies, languages) of rows of (text, language)."""
    counts = {}
    for text, lang in rows:
        for w in brute_words(text):
            for n in range(6):
                for g in [w] if n == 0 else brute_grams(w, n):
                    counts.setdefault((lang, n), Counter())[g] += 1
    langs = sorted({lang for _, lang in rows})
    known = [{} for _ in range(6)]
    for n in range(6):
        most = max((sum(counts.get((k, n), {}).values()) for k in langs), default=1)
        kept = {}
        for k in langs:
            c = counts.get((k, n), Counter())
            steps = Counter(c.values())
            held, floor = 0, None
            for v in sorted(steps, reverse=True):
                held += steps[v]
                if held > quota and floor is not None:
                    break
                floor = v
            kept[k] = {g: v for g, v in c.items() if v >= floor} if c else {}
        for g in set().union(*kept.values()):
            known[n][g] = [math.log(max(kept[k].get(g, 0) / max(1, sum(counts.get((k, n), {}).values())), 0.5 / max(1, most))) for k in langs]
    return known, langs


def brute_words(text):
    return "".join(c if c.isalpha() else " " for c in text.lower()).split()


def brute_grams(word, n):
    padded = f"_{word}_" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def brute_predict(text, known, langs):
    ws = brute_words(text or "")
    if not ws or not langs:
        return "und", 0.0
    total = [0.0] * len(langs)
    for w in ws:
        rows = [known[0][w]] if w in known[0] else []
        for n in range(5, 0, -1):
            rows = rows or [known[n][g] for g in brute_grams(w, n) if g in known[n]]
        for k in range(len(langs)) if rows else ():
            total[k] += sum(r[k] for r in rows) / len(rows)
    best = max(total)
    return langs[total.index(best)], 1.0 / sum(math.exp((t - best) * min(1.0, 50 / len(ws))) for t in total)


def test_language_id_matches_brute_force(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = ["m²", "a½ b", "hello² x²y", "Ⅷ ²", "1 2 3", "", None, " \t", "été naïve", "a_b-c d'e", "中文 字", "İstanbul ΣΑΣ", "zzq " * 3, "ª º", "x" * 3000, "٣ ४ ๒", "e\u0301 a"]
    rows = [(r.doc_id, r.text, r.lang) for r in table.collect()]
    model = language_id.train(table, max_entries=1200)
    known, langs = brute_language_model([(t, k) for _, t, k in rows if t is not None and k is not None], 200)
    asked = [t for _, t, _ in rows] + odd
    got = language_id.identify(spark.createDataFrame(list(enumerate(asked)), "i bigint, text string").repartition(7), model).orderBy("i").collect()
    assert len(got) == len(asked) >= 1000
    for r in got:
        lang, score = brute_predict(r.text, known, langs)
        assert r.lang_pred == lang or math.isclose(r.score, 1 / len(langs), rel_tol=1e-6) or math.isclose(score, 0.5, rel_tol=1e-6), r.text
        assert math.isclose(r.score, score, rel_tol=1e-6, abs_tol=1e-9), r.text
    assert {r.lang_pred for r in got if r.text in ("m²", "hello² x²y", "a½ b")} <= set(langs)
    assert {(r.lang_pred, r.score) for r in got if r.text in ("Ⅷ ²", "1 2 3", "٣ ४ ๒")} == {("und", 0.0)}
    # parts, memory and neighbours do not change a text's score
    long = " ".join(t for t in asked if t)
    alone = model.predict(long)
    monkeypatch.setattr(language_id, "CELLS", 1000)
    assert model.scorer(memo=10)([None, long, "x"])[1] == alone
    monkeypatch.setattr(language_id, "PART", 700)
    again = model.scorer()([long, "x" * 3000])
    assert again[0][0] == alone[0] and math.isclose(again[0][1], alone[1], rel_tol=1e-9)
    assert math.isclose(again[1][1], brute_predict("x" * 3000, known, langs)[1], rel_tol=1e-6)


def test_language_id_ties_go_to_the_first_language(spark):
    rows = [(1, "same words here", "b"), (2, "same words here", "a")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language_id.identify(table, language_id.train(table)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("a", 0.5), ("a", 0.5)]


def test_language_id_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    model = language_id.train(table, use=fold != 0)
    held = language_id.identify(table.where(fold == 0), model).where("length(text) > 30")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


# ---------------------------------------------------------------- license scans


def brute_base(text):
    word = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    phrases = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
    places = [(i, k) for k, p in phrases.items() for i in range(len(word)) if word[i : i + len(p.split())] == p.encode().split()]
    return len(word), len(places), min(places, default=(None,))[0], max(places, default=(None,))[0], ",".join(sorted({k for _, k in places}))


def test_license_base_columns_match_brute_force(spark, docs, empty):
    texts = [
        "Licensed under the Apache License, Version 2.0 ... APACHE license apache  license",
        "GNU General Public License v3, GNU Lesser General Public License v2.1; CC-BY-4.0 cc by",
        "permitted; submit license; mit-license; the MIT\nLicense",
        "GNU GENERAL PUBLIC LICENSE mit license " * 500,
        None,
    ]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").unionByName(docs.select("doc_id", "text"))
    for r in license_scan.license_labels(table).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(r.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0.0 <= r.score <= 1.0
    assert license_scan.license_labels(empty).count() == 0


def test_license_rules_are_many_and_suppressed_by_rank():
    scanner = license_scan.default_scanner()
    assert len(scanner.rules) > 200
    found = scanner.scan(b"Licensed under the Apache License, Version 2.0; CC BY-SA 4.0")[1]
    assert [d.label for d in license_scan.survivors(found)] == ["apache-2.0", "cc-by-sa-4.0"]
    for r, rule in enumerate(scanner.rules):  # a rule's keywords are in whatever it can match
        assert rule.keywords, r


def test_license_prefilter_passes_what_patterns_match():
    scanner = license_scan.default_scanner()
    spelled = {
        "Creative Commons Attribution-Share Alike 3.0": "cc-by-sa",
        "Creative Commons Attribution Non-Commercial 3.0": "cc-by-nc",
        "Creative Commons Attribution-NonCommercial-Share Alike": "cc-by-nc-sa",
        "Creative Commons Attribution Non Commercial No Derivs": "cc-by-nc-nd",
        "the Beer-Ware License": "beerware",
        "beerware license": "beerware",
        "the revised BSD license": "bsd-3-clause",
        "modified BSD": "bsd-3-clause",
        "All advertising materials mentioning features or use of this software must display the following acknowledgment": "bsd-4-clause",
        "CreativeML Open RAIL-M": "openrail",
        "OpenRAIL": "openrail",
        "Enlightenment License": "mit-advertising",
        "You may not use this file except in compliance with the License": "apache-2.0",
    }
    for text, label in spelled.items():
        assert label in {d.label for d in scanner.scan(text.encode())[1]}, text
    assert scanner.scan(b"a text of the usual kind, with a license")[1] == []
    for r, rule in enumerate(scanner.rules):  # every spelling of every pattern
        parsed = license_scan.regex.parse(rule.pattern.pattern.decode()[6:-5])
        for text in license_scan._spellings(parsed):
            for fill in "12345abcsx":
                line = f" {text.replace(license_scan._ANY, fill)} ".encode()
                if rule.pattern.search(line):
                    assert r in scanner.candidates(line), (rule.label, line)


def test_survivors_match_brute_force():
    r = random.Random(3)
    for _ in range(200):
        found = [license_scan.Detection(i, "x", r.randint(1, 3), a := r.randint(0, 20), a + r.randint(0, 8)) for i in range(r.randint(0, 12))]
        order = sorted(found, key=license_scan.rank)
        brute = [d for i, d in enumerate(order) if not any(k.first <= d.first and k.last >= d.last for k in order[:i])]
        assert set(license_scan.survivors(found)) == set(brute)


# ---------------------------------------------------------------- language model


def brute_lm(train, texts):
    cut = lambda t: ["<s>", *[w.decode() for w in (t or "").encode().lower().split()], "</s>"]
    uni, bi = Counter(), Counter()
    for t in train:
        w = cut(t)
        uni.update(w[1:])
        bi.update(zip(w, w[1:]))
    n, v = sum(uni.values()), len(uni)
    d = lm.discounts([Counter(bi.values())[k] for k in (1, 2, 3, 4)])
    cont = Counter(w for _, w in bi)
    d0 = lm.discounts([Counter(cont.values())[k] for k in (1, 2, 3, 4)])
    free = sum(d0[min(c, 3)] for c in cont.values()) / len(bi) if bi else 1.0
    total, spare = Counter(), Counter()
    for (a, _), c in bi.items():
        total[a] += c
        spare[a] += d[min(c, 3)]

    def p(h, w):
        low = (max(cont[w] - d0[min(cont[w], 3)], 0) / len(bi) if bi else 0) + free / (v + 1)
        return (max(bi[h, w] - d[min(bi[h, w], 3)], 0) + spare[h] * low) / total[h] if total[h] else low

    def one(t):
        w = cut(t)
        return len(w) - 1, sum(uni[x] > 0 for x in w[1:]), sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w[1:]), sum(math.log10(p(a, b)) for a, b in zip(w, w[1:]))

    return [one(t) for t in texts], p, uni


def test_lm_matches_brute_force(docs, empty):
    train = [r.text for r in docs.where("doc_id % 3 <> 0").collect()]
    model = lm.train(docs, use=F.col("doc_id") % 3 != 0, shard_tokens=2000)  # many shards, spread contexts
    got = lm.score(docs, model).collect()
    want, p, uni = brute_lm(train, [r.text for r in got])
    for r, (n, known, base, score) in zip(got, want):
        assert (r.n_tokens, r.n_known) == (n, known)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-9)
    assert math.isclose(sum(p("the", w) for w in uni) + p("the", "not-a-word"), 1.0, rel_tol=1e-9)
    assert lm.score(empty, model).count() == 0


def test_lm_without_training_rows(docs, empty):
    model = lm.train(empty)
    assert (model.tokens, model.types) == (0, 0)
    assert all(r.score == 0.0 for r in lm.score(docs, model).collect())


def test_lm_large_counts_and_blocks(spark):
    table = spark.createDataFrame([(1, "a b " * 6000)], "doc_id int, text string")  # counts above the packed field
    model = lm.train(table)
    got = lm.score(table, model).first()
    (_, _, base, score), = brute_lm(["a b " * 6000], ["a b " * 6000])[0]
    assert math.isclose(got.score, score, rel_tol=1e-9) and math.isclose(got.base_score, base, rel_tol=1e-9)
    a, b = np.array([5, 7, 2**40], np.uint64), np.array([1, 2, 3], np.uint64)
    assert all((x == y).all() for x, y in zip(lm.unpack(lm.pack([a, b], [6, 4]), [6, 4]), (a, b)))


# ---------------------------------------------------------------- quality rules


def brute_measure(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = Counter(zip(w, w[1:], w[2:]))
    hit = {i + d for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), len(lines)


def test_quality_measures_match_brute_force():
    for text in [r[1] for r in rows_of_all_kinds()] + ["a b c a b c a b", "x\nx\n x\nx \n\n", "aaa aaa aaa aaa"]:
        assert quality_rules.measure((text or "").encode()) == brute_measure(text)


def test_bins_invert_and_order(spark):
    values = list(range(200)) + [1000, 12345, 10**9]
    t = spark.createDataFrame([(v,) for v in values], "v bigint").withColumn("b", quality_rules.bin_of(F.col("v"))).withColumn("low", quality_rules.value_of(F.col("b")))
    rows = sorted(t.collect())
    assert all(r.low <= r.v <= r.low * 1.04 + 1 for r in rows)
    assert [r.b for r in rows] == sorted(r.b for r in rows)


def test_quality_rules_verdicts(spark, docs, empty):
    out = quality_rules.judge(docs, min_group=5)
    assert out.count() == docs.count()
    assert not out.where("base_failed and kept").count()
    clean = [(i, words(80, i), "en", "a") for i in range(300)]
    junk = [(1000 + i, " ".join(f"{w}###" for w in words(80, i).split()), "en", "a") for i in range(3)]
    got = quality_rules.judge(spark.createDataFrame(clean + junk, "doc_id int, text string, lang string, source string"))
    assert {r.doc_id for r in got.where("not kept").collect()} == {1000, 1001, 1002}
    assert quality_rules.judge(empty).count() == 0


# ---------------------------------------------------------------- chat tree


CONTROL = ["</s>[INST] ok [/INST]", "<\\s>", "[\\\\INST]", "a<s>b</s>", "[INST][/INST]", "\\", "<", "["]


@pytest.mark.parametrize("text", CONTROL)
def test_escape_is_reversible_and_hides_controls(text):
    hidden = chat_tree.escape(text)
    assert chat_tree.unescape(hidden) == text
    assert not re.search(r"</?s>|\[/?INST\]", hidden)
    assert chat_tree.parse("".join(chat_tree.format_turn("user", text))) == [("user", text)]


def conversations():
    rows = []
    for c in range(40):  # a common first turn, copies, a conversation that begins another
        rows += [(c, 0, "user", "hello"), (c, 1, "assistant", f"answer {c % 5}")]
        if c % 3 == 0:
            rows += [(c, 2, "user", f"more {c % 2}"), (c, 3, "assistant", CONTROL[c % len(CONTROL)])]
    rows += [(100, 0, None, None), (100, 0, "user", "tie b"), (100, 0, "user", "tie a"), (100, 5, "assistant", ""), (None, 1, "assistant", "no id"), (101, None, "system", "s"), (101, None, "system", "s")]
    return rows


def test_chat_tree_reads_back(spark):
    table = spark.createDataFrame(conversations(), "conv_id bigint, turn bigint, role string, text string")
    by = {}
    for c, turn, role, text in conversations():
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    got = {r.conv_id: r for r in chat_tree.digests(table).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len("".join(chat_tree.format_turn(a, b))) for a, b in turns)
    assert chat_tree.digests(table.where("false")).count() == 0


def test_chat_tree_shares_tokens_and_masks_ancestors(spark):
    more = [(1000 + c, t, r, x) for c in range(400) for t, r, x in ((0, "user", "hi"), (1, "assistant", "same"), (2, "user", f"own {c}"))]
    table = spark.createDataFrame(conversations() + more, "conv_id bigint, turn bigint, role string, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # many ranges
    try:
        blocks, members = chat_tree.tree(table, block_tokens=60)
        assert blocks.count() and members.count() > 400
        rows, leaves = blocks.collect(), members.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    nodes, written = [], Counter()
    for b in rows:
        assert b.nodes[-1].end == len(b.ids)
        for n in b.nodes:
            before = sum(a.end - a.start for a in n.attends) - (n.end - n.start)
            assert n.position == before  # positions are the conversation's
            assert n.attends[-1].end == n.end and all(x.end < y.start for x, y in zip(n.attends, n.attends[1:]))
            written[n.name] += not n.repeated
        nodes += b.nodes
    assert set(written.values()) == {1}  # every node new once, over blocks and ranges
    assert Counter(n.name for n in nodes if n.leaf) == Counter({r.leaf for r in leaves})


# ---------------------------------------------------------------- mixing


def brute_targets(sizes, weights, share, epochs):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped and sizes[s]]
        if not free:
            break
        level = (total - sum(epochs * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= epochs * sizes[s]}
        if not over:
            break
        capped |= over
    return {s: 0.0 if not sizes[s] else epochs * sizes[s] if s in capped else weight[s] * level for s in names}


def test_mixing_meets_targets(spark, docs, empty):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] += r.size
    want = brute_targets(sizes, mixing.WEIGHTS, 1.5, 2)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], abs_tol=1e-5)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert 0 <= want[s] - taken[s] < 3  # the exact word, but for repeated rows at the cut
    again = {(r.doc_id, r.text): r.taken for r in mixing.mix(docs.repartition(2)).collect()}
    assert again == {(r.doc_id, r.text): r.taken for r in got}
    assert mixing.mix(empty).count() == 0
    assert "N_WORDS" in mixing.mix(docs).columns


def test_mixing_repeat_gives_a_row_per_time(spark):
    table = spark.createDataFrame([(i, words(10, i), "ab"[i % 2]) for i in range(60)], "doc_id int, text string, source string")
    mixed = mixing.mix(table)
    want = Counter({r.doc_id: math.ceil(r.taken / r.size) for r in mixed.collect() if r.taken})
    assert Counter(r.doc_id for r in mixing.repeat(mixed).collect()) == want


# ---------------------------------------------------------------- packing


def test_fast_encoding_equals_the_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    enc = tokens.encoding(tokens.default_path())
    texts = [r.text or "" for r in docs.collect()] + ["<|endoftext|> a  b\n\n c", "don't I'll 123 \t x", "\u0000​"]
    assert [enc.encode_ordinary(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_best_fit_plan_is_valid_and_tight():
    r = random.Random(5)
    for _ in range(30):
        hist = {n: r.randint(1, 60) for n in r.sample(range(1, 65), 20)}
        plan = packing.best_fit(hist, 64)
        used = Counter()
        spans = {}
        for n, count in hist.items():
            seq, off = plan.place(np.full(count, n), np.arange(count))
            for s, o in zip(seq, off):
                used[s] += n
                spans.setdefault(s, []).append((o, n))
        for parts in spans.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 64
        assert plan.sequences == len(spans)
        least = max(math.ceil(sum(n * c for n, c in hist.items()) / 64), sum(c for n, c in hist.items() if n > 32))
        assert plan.sequences <= 11 / 9 * least + 1
    assert packing.best_fit({}, 64).sequences == 0


def test_packing_round_trip(docs, empty):
    enc = tokens.encoding(tokens.default_path())
    got = packing.pack(docs).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*enc.encode_ordinary(r.text or ""), 0], "<u4")
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        starts = [0, *range(first, len(ids), 2048)]
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[r.doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(empty).count() == 0


# ---------------------------------------------------------------- quality classifier


def test_classifier_learns_and_shrinks(spark, docs, labels, empty):
    good = [(i, words(50, i), f"h{i % 3}", "en") for i in range(200)]
    bad = [(1000 + i, "BUY!! NOW!! " * 30 + words(5, i), "spam", "en") for i in range(100)]
    toxic = [(2000 + i, words(40, 3000 + i) + " nastyword " + words(10, i), f"h{i % 3}", "en") for i in range(100)]
    table = spark.createDataFrame(good + bad + toxic, "doc_id bigint, text string, source string, lang string")
    lab = spark.createDataFrame([(r[0], int(r[0] < 1000 or r[0] >= 2000), int(r[0] >= 2000)) for r in good + bad + toxic], "doc_id bigint, quality int, toxic int")
    got = quality_classifier.classify(table, lab).collect()
    wrong = [r.doc_id for r in got if r.kept != (r.doc_id < 1000)]
    assert len(wrong) <= 20  # of 400, all words but one being random
    host = {r.source: r.host_quality for r in got}
    assert host["spam"] < 0.3 < host["h0"]
    out = quality_classifier.classify(docs, labels)
    assert out.count() == docs.count()
    assert quality_classifier.classify(empty, labels).count() == 0
    none = quality_classifier.classify(docs, labels.where("false"))
    assert none.where("kept").count() == docs.count()


def brute_posteriors(rows, max_shift):
    """p_quality and p_toxic of rows (host, path, log odds of quality, of toxicity), by the formulas."""
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    out = [[] for _ in rows]
    for k in (2, 3):
        prob = [sigmoid(r[k]) for r in rows]
        prior = sum(prob) / len(prob)

        def moments(keys):
            sums, sizes = {}, Counter(keys)
            for key, p in zip(keys, prob):
                sums[key] = sums.get(key, 0) + p
            spread = sum(sizes[g] * (sums[g] / sizes[g] - prior) ** 2 for g in sizes)
            if len(sizes) < 2:
                return sums, sizes, 1e4
            within = prior * (1 - prior)
            between = max(spread / len(rows) - within * len(sizes) / len(rows), 1e-9)
            return sums, sizes, min(max(within / between - 1, 2.0), 1e4)

        host_sums, host_sizes, host_k = moments([r[0] for r in rows])
        path_sums, path_sizes, path_k = moments([r[:2] for r in rows])
        for i, r in enumerate(rows):  # the row itself is left out
            host = (host_k * prior + host_sums[r[0]] - prob[i]) / (host_k + host_sizes[r[0]] - 1)
            path = (path_k * host + path_sums[r[:2]] - prob[i]) / (path_k + path_sizes[r[:2]] - 1)
            shift = min(max(logit(path) - logit(prior), -max_shift), max_shift)
            out[i] += [host, path, sigmoid(r[k] + shift)]
    return out


def test_posteriors_match_brute_force(spark):
    r = random.Random(11)
    rows = [(r.choice(["a.org", "b.org", "c.org", None]), r.choice(["/x", "/y", None, "/z"]), r.gauss(1, 2), r.gauss(-2, 2)) for _ in range(500)]
    rows += [("one.org", "/only", 3.0, -1.0)] + [("spam.org", f"/{i % 3}", -2 + r.random(), 1.0) for i in range(200)]
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, _host string, _path string, text_quality double, text_toxic double").repartition(5)
    got = sorted(quality_classifier.combine(table, 1.0).collect(), key=lambda x: x.i)
    assert len(got) == len(rows)
    for x, want in zip(got, brute_posteriors(rows, 1.0)):
        assert np.allclose([x.host_quality, x.path_quality, x.p_quality, x.host_toxic, x.path_toxic, x.p_toxic], want, rtol=1e-9)


def test_classifier_takes_any_host_and_path(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.expr("parse_url(url, 'HOST')").alias("site"), F.expr("parse_url(url, 'PATH')").alias("place"))
    lab = rows.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    got = quality_classifier.classify(rows, lab, host_col="site", path_col="place").collect()
    assert len(got) == pages.count()
    model = quality_classifier.train(rows, lab)
    want = brute_posteriors([(x.site, x.place, *model.log_odds(quality_classifier.features((x.text or "").encode()))) for x in got], 1.0)
    for x, w in zip(got, want):
        assert np.allclose([x.host_quality, x.path_quality, x.p_quality], w[:3], rtol=1e-6)
        assert x.kept == (x.p_quality >= 0.5)


def test_classifier_ties_and_repeated_rows(spark):
    rows = [(1, "good words here", "h", "p")] * 3 + [(2, "bad words here", "h", "p")] * 3
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = quality_classifier.classify(table, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int")).collect()
    assert len(got) == 6 and len({(r.doc_id, r.p_quality, r.kept) for r in got}) == 2


def test_cutoff_makes_fewest_errors():
    z, y = np.array([-3.0, -1, 0, 1, 2]), np.array([0, 0, 1, 1, 1])
    assert -1 < quality_classifier.cutoff(z, y) < 0


# ---------------------------------------------------------------- Jaccard join


def brute_links(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    n = len(rows)
    hit = [[j for j in range(n) if i != j and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(n)]
    group = list(range(n))
    for i in range(n):
        stack, seen = [i], {i}
        while stack:
            for j in hit[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        group[i] = min(seen)
    return [len(h) for h in hit], group


def near_copies(n, seed):
    r = random.Random(seed)
    base = words(150, seed).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = "changed" + str(r.randint(0, 9))
        out.append(" ".join(w))
    return out


def test_jaccard_join_matches_brute_force(spark, docs, empty):
    texts = near_copies(150, 1) + near_copies(30, 2) + [words(40, 50 + i) for i in range(40)] + ["a b", "a b", "a b c", "", None]
    rows = list(enumerate(texts))
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(table).collect()}
    links, group = brute_links(rows)
    assert {i: got[i].n_links for i in range(len(rows))} == dict(enumerate(links))
    assert {i: got[i].class_id for i in range(len(rows))} == dict(enumerate(group))
    kept = sorted(r.doc_id for r in jaccard_join.first_of_each(table).collect())
    assert kept == sorted(set(group))
    assert jaccard_join.jaccard_join(docs).count() == docs.count()
    assert jaccard_join.jaccard_join(empty).count() == 0
    assert jaccard_join.first_of_each(empty).count() == 0
    assert jaccard_join.first_of_each(docs).columns == docs.columns


def test_overlaps_are_exact_over_slices(monkeypatch):
    monkeypatch.setattr(jaccard_join, "_COLUMNS", 7)
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 30)).astype(np.uint64) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]
    assert (jaccard_join.overlaps(sets[:4], sets[4:]) == np.array(want)).all()


def test_matched_depth_reaches_recall():
    depth = jaccard_join.matched_depth(0.8, 24, 8, 0.999)
    assert jaccard_join.expected_recall(0.8, depth, 24) >= 0.999 > jaccard_join.expected_recall(0.8, depth + 1, 24)


# ---------------------------------------------------------------- media


def test_media_round_trip_and_digests(docs, empty):
    for r in media.media_digests(docs).collect():
        text = (r.text or "").encode()
        payload = text + b"\xff" * (-len(text) % 576 if text else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        stored = media.store(payload)
        assert media.read_back(stored) == payload
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    same = media.media_digests(docs.where("doc_id = 5")).select("feature").distinct().count()
    assert same == 1
    assert media.media_digests(empty).count() == 0


def brute_fingerprint(samples):
    """Codes and times by sums of cosines, frame by frame and pair by pair."""
    x = np.frombuffer(samples, np.uint8).astype(float) - 128
    t = np.arange(576)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * t / 575)
    basis = np.exp(-2j * np.pi * np.outer(np.arange(289), t) / 576)
    found = []
    for at in range(0, len(x) - 575, 288):
        power = np.abs(basis @ (x[at : at + 576] * window))
        row = []
        for lo, hi in zip(media.BANDS, media.BANDS[1:]):
            top = lo + int(power[lo:hi].argmax())
            row.append(top if power[top] > power[2:].mean() else -1)
        found.append(row)
    out = []
    for i, row in enumerate(found):
        for d in range(1, media.REACH + 1):
            if i + d < len(found):
                out += [(i, (a << 11) | (b << 2) | d) for a in row if a >= 0 for b in found[i + d] if b >= 0]
    return sorted(out)


def test_media_arrays_match_brute_force(spark, docs):
    table = docs.where("doc_id is null or doc_id <> 6").select("doc_id", "text")
    table = table.union(spark.createDataFrame([(1000 + i, words(400, i)) for i in range(8)], table.schema))
    rows = media.media_digests(table).collect()
    full = {(r.doc_id, r.text): r for r in media.media_columns(table).collect()}
    checked = 0
    for r in rows:
        payload = media.payload_of((r.text or "").encode())
        want = brute_fingerprint(payload)
        assert list(zip(r.times, r.codes)) == want
        frames, high, pairs, mark = r.feature.split(":")
        assert int(frames) == (len(payload) - 576) // 288 + 1 and int(pairs) == len(want)
        m = full[r.doc_id, r.text]
        assert (list(m.codes), list(m.times), m.n_peaks) == (list(r.codes), list(r.times), int(high))
        assert media.read_back(bytes(m.media)) == payload
        checked += len(want)
    assert checked > 500


def test_fingerprint_finds_a_tone():
    t = np.arange(576 * 10)
    tone = (128 + 100 * np.sin(2 * np.pi * 50 * t / 576)).astype(np.uint8).tobytes()
    found = media.peaks(tone)
    assert (found[:, 2] == 50).all()
    codes, times = media.pairs(found)
    assert len(codes) == len(times) and (np.diff(times) >= 0).all()
    assert media.fingerprint(media.store(tone))[2] == int((found >= 0).sum())


# ---------------------------------------------------------------- all operators


CLASHES = ["_added", "_key", "_name", "_part", "_cut", "_epochs", "_source", "_s", "_range", "_at", "_stay_id", "_stay_at", "_host", "_path", "_h", "_p", "_host_n", "_time", "_c0", "part", "rank", "weight"]


def test_operators_keep_columns_with_clashing_names(spark, labels):
    rows = [(i, words(30, i), "en", f"s{i % 3}") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumns({c: F.col("doc_id") * 7 for c in CLASHES})
    out = {
        "language": language_id.identify(table, language_id.train(table)),
        "license": license_scan.license_labels(table),
        "scan": license_scan.scan_licenses(table),
        "lm": lm.score(table, lm.train(table)),
        "measures": quality_rules.measures(table),
        "mix": mixing.mix(table),
        "repeat": mixing.repeat(mixing.mix(table)),
        "classifier": quality_classifier.classify(table, labels),
        "join": jaccard_join.first_of_each(table),
        "media": media.media_digests(table),
    }
    for name, df in out.items():
        got = df.collect()
        assert {r.doc_id for r in got} <= set(range(60)) and got, name
        assert all(r[c] == r.doc_id * 7 for r in got for c in CLASHES), name


def test_long_texts_in_parts(spark, monkeypatch):
    long = "\n".join(f"line {i % 40} of w{i % 977} x{i} mit license" for i in range(40_000))
    monkeypatch.setattr(quality_rules, "LONG", 10_000)
    assert quality_rules.measure(long.encode()) == brute_measure(long)
    assert quality_rules.measure(b" " * 20_000) == brute_measure(" " * 20_000)
    assert quality_rules.measure(("a b c " * 4000).encode()) == brute_measure("a b c " * 4000)
    assert license_scan.default_scanner().scan(long.encode())[0] == len(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", long.encode()))
    table = spark.createDataFrame([(1, long), (2, "short text"), (3, long), (4, None), (5, " " * 5000), (6, "x" * 5000 + " y")], "doc_id int, text string").coalesce(1)
    model = lm.train(table)
    whole = {r.doc_id: r for r in lm.score(table, model).collect()}
    (want,) = [brute_lm([r.text for r in table.collect()], [long])[0]]
    for i in (1, 3):
        assert (whole[i].n_tokens, whole[i].n_known) == want[0][:2]
        assert math.isclose(whole[i].base_score, want[0][2], rel_tol=1e-9) and math.isclose(whole[i].score, want[0][3], rel_tol=1e-9)
    assert whole[1].score == whole[3].score
    hashes = lm.Hashes()
    texts = [(r.text or "").encode() for r in table.collect()]
    parts = list(lm.stream(texts, hashes, 1000))
    assert len(parts) > 100 and max(len(p.tokens) for p in parts) < 1000
    one = list(lm.stream(texts, hashes, 1 << 30))
    assert len(one) == 1 and (np.concatenate([p.tokens for p in parts]) == one[0].tokens).all() and (np.concatenate([p.before for p in parts]) == one[0].before).all()
    got = sum(model.token_scores(p)[2].sum() for p in parts)
    assert math.isclose(got, sum(r.score for r in whole.values()), rel_tol=1e-9)


def test_many_equal_rows(spark):
    table = spark.range(30_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("the same text of a few words").alias("text"), F.lit("a").alias("source"), F.lit("en").alias("lang"))
    placed = packing.pack(table)
    assert placed.count() == 30_000 and placed.select("sequence_id", "offset").distinct().count() == 30_000
    assert jaccard_join.jaccard_join(table).select("n_links").distinct().collect()[0][0] == 29_999
    assert mixing.mix(table).agg(F.sum("taken")).first()[0] <= 1.5 * 7 * 30_000


def test_lm_keeps_few_files_open(docs, monkeypatch):
    model = lm.train(docs, shard_tokens=500)
    want = {(r.doc_id, r.text): r.score for r in lm.score(docs, model).collect()}
    monkeypatch.setattr(lm, "OPEN_FILES", 3)
    part, = lm.stream([(r.text or "").encode() for r in docs.collect()], lm.Hashes(), 1 << 30)
    assert math.isclose(model.token_scores(part)[2].sum(), sum(want[r.doc_id, r.text] for r in docs.collect()), rel_tol=1e-9)
    assert len(model._open) <= 3


def test_classifier_learns_from_parts(spark, monkeypatch):
    """What it learns from comes to the driver in parts, and the model does not depend on them."""
    docs = spark.createDataFrame([(i % 50, words(30 + i, i) if i % 9 else None) for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(50)], "doc_id bigint, quality int, toxic int")
    whole = quality_classifier.train(docs, labels)
    sizes, keep = [], type(docs).toArrow

    def counted(df):
        got = keep(df)
        sizes.append(got["features"].nbytes)
        return got

    monkeypatch.setattr(type(docs), "toArrow", counted)
    monkeypatch.setattr(quality_classifier, "COLLECTED", 2000)
    parts = quality_classifier.train(docs, labels)
    assert len(sizes) > 4 and max(sizes) < sum(sizes) / 2
    for h in quality_classifier.HEADS:
        assert (parts.weights[h][0] == whole.weights[h][0]).all() and parts.weights[h][1] == whole.weights[h][1]


def test_classifier_orders_rows_by_name_then_features():
    found = [np.array(x, np.uint32) for x in ([3, 1], [2], [2, 5], [1], [2])]
    names = [7, 7, 1, 7, 1]
    assert quality_classifier.ordered(names, found) == sorted(range(5), key=lambda i: (names[i], found[i].tobytes()))
