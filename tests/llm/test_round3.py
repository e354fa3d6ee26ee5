"""Toxicity, phrases and conversation repair against brute force, and on nulls, empty and long texts, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from oracle import compare, connect
from pyspark.sql import functions as F

from strataflux.llm import conversations, phrases, queries, toxicity

# --- toxicity ------------------------------------------------------------------

BAD = ["grumbolt", "snarvex", "plidgeon"]
GOOD = [f"{a}{b}" for a in ("lo", "mi", "sta", "ren", "du", "ko") for b in ("na", "ter", "vi", "mon", "sel", "ga", "fri", "po")]


def made(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice(GOOD) for _ in range(r.randint(5, 120))]
        toxic = int(r.random() < 0.3)
        for _ in range(r.randint(2, 4) * toxic):
            words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def learned():
    rows = made(600, 1)
    texts = [toxicity.passages(toxicity.split(t.encode()), toxicity.SAMPLE_WINDOWS) for _, t, _ in rows]
    return toxicity.train(texts, np.array([y for _, _, y in rows]))


def naive_score(model, text):
    """The score as the docstring says it: embeddings averaged over words and passages, then the softmax."""
    words = toxicity.split(text.encode())
    fresh = [i for i, w in enumerate(words) if w not in words[max(0, i - toxicity.WINDOW + 1) : i]]
    vectors = {}
    for w in set(words):
        _, buckets = toxicity.subwords([w])
        vectors[w] = model.embeddings[buckets].astype(float).mean(0)
    direction = model.weights[:, 1].astype(float) - model.weights[:, 0]
    sums = [sum((vectors[words[i]] for i in fresh if at <= i < at + toxicity.WINDOW), np.zeros(toxicity.DIMS)) for at in range(0, len(words), toxicity.WINDOW)]
    best = sorted(sums, key=lambda v: -(v @ direction))[: toxicity.TOP]
    mean = sum(best, np.zeros(toxicity.DIMS)) / (toxicity.TOP * toxicity.WINDOW)
    logits = mean @ model.weights.astype(float) + model.bias
    return float(1 / (1 + np.exp(logits[0] - logits[1])))


def test_score_equals_the_averages(learned):
    gains = toxicity.Gains(learned)
    for _, text, _ in [*made(40, 3), (0, "", 0), (0, "na " * 500, 0), (0, "grumbolt " * 60, 1)]:
        got = toxicity.probability(learned, gains, toxicity.split(text.encode()))
        assert got == pytest.approx(naive_score(learned, text), abs=1e-4)


def test_learns_and_catches_misspellings(learned):
    gains = toxicity.Gains(learned)

    def score(text):
        return toxicity.probability(learned, gains, toxicity.split(text.encode()))

    rows = made(300, 2)
    right = np.mean([(score(t) >= toxicity.THRESHOLD) == bool(y) for _, t, y in rows])
    assert right > 0.97
    plain = "lona miter stavi renmon dusel koga " * 5
    assert score(plain + "grumbolts grumboltt grumbolt1 grumbolting") > 0.5 > score(plain)


def test_cache_may_be_forgotten(learned, monkeypatch):
    texts = [t for _, t, _ in made(30, 4)]
    want = [toxicity.probability(learned, toxicity.Gains(learned), toxicity.split(t.encode())) for t in texts]
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 3)
    gains = toxicity.Gains(learned)
    assert [toxicity.probability(learned, gains, toxicity.split(t.encode())) for t in texts] == want


def test_toxicity_on_tables(spark):
    rows = made(400, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "... !!!"), (None, "lona"), (1003, "lona " * 200_000), (5, rows[5][1])], "doc_id long, text string")
    docs = docs.select("*", F.lit(1).alias("score"), F.lit(2).alias("predicted"), F.lit(3).alias("passages")).repartition(3)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(5, 1, rows[5][2]), (None, 1, 1), (7, 1, None), (3, 0, 9)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "passages", "score", "predicted"]
    found = got.collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    by_id = {r.doc_id: r.score for r in found}
    assert by_id[1000] == by_id[1001] == by_id[1002]
    truth = {i: y for i, _, y in rows}
    assert np.mean([(by_id[i] >= 0.5) == bool(y) for i, y in truth.items() if zlib.crc32(str(i).encode()) % 5 == 0]) > 0.9


def test_toxicity_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(none, labels, F.lit(True)) is None
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [tuple(r) for r in toxicity.score(some, None).collect()] == [(1, 0.0, 0)]
    assert toxicity.score(none, None).count() == 0


def test_subwords_of_one_word_equal_those_in_a_group():
    words = [b"a", "él".encode(), b"grumbolt", b"x" * 500]
    owners, buckets = toxicity.subwords(words)
    for i, w in enumerate(words):
        alone = toxicity.subwords([w])[1]
        assert sorted(buckets[owners == i]) == sorted(alone)
        n = len(w.decode()) + 2
        assert len(alone) == 1 + sum(max(0, n - size + 1) for size in toxicity.SIZES)


# --- phrases ---------------------------------------------------------------------


def naive_phrases(rows, support, top, cover=100):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        totals[lang] += 0
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    out = {}
    for (lang, p), a in counts.items():
        if a < support or len(p) < 2:
            continue
        inside = any(counts[lang, q] * 100 >= cover * a for (other, q), f in counts.items() if other == lang and f >= support and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
        if inside:
            continue
        score, _, left, right = min((1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), a, left, right, totals[lang], score))
    return sorted((lang, rank, p.decode(), a, left, right, n, score) for lang, found in out.items() for rank, (_, _, p, a, left, right, n, score) in enumerate(sorted(found)[:top], 1))


def phrase_rows(seed, n=60):
    r = random.Random(seed)
    words = ["New", "york", "city", "of", "the", "él", "x-1", "a", "\x1f", "ÉCOLE"]
    ends = [" ", "  ", "\t", " ", " ", " ", ". ", ",", "\n", "\x0b", "?"]
    rows = [(r.choice(["en", "fr", None]), "".join(r.choice(words) + r.choice(ends) for _ in range(r.randint(0, 60)))) for _ in range(n)]
    return [*rows, ("en", None), ("en", ""), ("fr", " .. "), (None, "new york city"), *[("en", "in the big red barn by")] * 12]


@pytest.mark.parametrize("segment", [1 << 20, 40])
def test_phrases_equal_brute_force(spark, folder, monkeypatch, segment):
    """Also with segments of a few words, so that runs continue over their edges, and partial counts sent on early."""
    if segment == 40:
        monkeypatch.setattr(phrases, "SEGMENT", 40)
        monkeypatch.setattr(phrases, "HELD", 50)
    rows = phrase_rows(segment)
    path = f"{folder}/docs"
    spark.createDataFrame(rows, "lang string, text string").select("*", F.lit(1).alias("shard"), F.lit("p").alias("phrase"), F.lit(0).alias("n")).repartition(6).write.parquet(path)
    docs = spark.read.parquet(path)
    assert phrases._tokens(docs).select("shard").distinct().count() > 1
    for support, top in ((8, 1000), (8, 5), (3, 40)):
        got = sorted(tuple(r) for r in phrases.collocations(docs, support, top).collect())
        want = naive_phrases(rows, support, top)
        assert want and got == want


def test_phrases_without_files_or_rows(spark):
    rows = phrase_rows(9, 30)
    got = sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), 5, 50).collect())
    assert got == naive_phrases(rows, 5, 50)
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "a b"), ("en", None)], "lang string, text string")).count() == 0


def test_long_word_and_long_text(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SEGMENT", 1000)
    rows = [("en", "w" * 50_000 + " tail end"), ("en", "red barn, " * 5_000), ("en", "one two three four five six " * 2_000)]
    got = sorted(tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), 100, 50).collect())
    assert got == naive_phrases(rows, 100, 50)


def test_scores_beyond_64_bits(spark):
    rows = [(10**11, 10**15, 10**12, 3 * 10**12), (100, 10**17 - 1, 100, 100)]
    expr = "(1000 * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
    got = [r.s for r in spark.createDataFrame(rows, "a long, n long, l long, r long").selectExpr(f"{expr} as s").collect()]
    assert got == [1000 * a * n // (left * right) for a, n, left, right in rows]


# --- conversations -----------------------------------------------------------------

FOLLOW = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
FULL = {"u": "user", "a": "assistant"}


def naive_repair(rows):
    """Cheapest edits of ordered (turn, role, text) rows, by (cost, audit) pairs of strings for each automaton state."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    def put(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def inserted(best):
        best = dict(best)
        for _ in range(2):
            for state, (cost, audit, out) in list(best.items()):
                for r in FULL.keys() & FOLLOW[state].keys():
                    put(best, FOLLOW[state][r], (cost + 2, audit + "I", (*out, (FULL[r], ""))))
        return best

    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for table in (best, inserted(best)):
            for state, (cost, audit, out) in table.items():
                put(after, state, (cost + 3, audit + "D", out))
                if fault in ("b", "d"):
                    continue
                more = cost + (fault == "t")
                if role[:1] in FOLLOW[state]:
                    put(after, FOLLOW[state][role[:1]], (more, audit + "K", (*out, (role, text))))
                for r in FULL.keys() & FOLLOW[state].keys():
                    put(after, FOLLOW[state][r], (more + 2, audit + "R", (*out, (FULL[r], text))))
        best = after
    cost, audit, out = min((v for table in (best, inserted(best)) for s, v in table.items() if s in ("", "a")), key=lambda v: v[:2])
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [p[1][:1] + q[1][:1] for p, q in zip(rows, rows[1:])]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}, out


def naive_conversations(rows):
    kept: dict = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            kept[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    return {c: naive_repair(sorted(found, key=order)) for c, found in kept.items()}


def wild(seed):
    r = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "user", "assistant", None, "tool", "", "Usher"], ["c!", "", None, " \t", "é?", "x\n", "no end"]
    rows = [(c, r.choice([None, i, i, i, i // 2, 3 * i]), r.choice(roles), r.choice([f"a{i}.", f"b{i}", *texts])) for c in [None, *range(9)] for i in range(r.choice([1, 2, 5, 9, 30, 70]))]
    return rows + [(20, None, "user", "hi.")] * 40 + [(21, 4, "user", "x" * 300_000)]


@pytest.mark.parametrize("bits", [(9, 12), (1, 1), (2, 3)])
def test_repair_equals_brute_force(spark, folder, monkeypatch, bits):
    """Also with chunks of two and four rows in narrow trees, so that conversations run over chunks and partitions."""
    monkeypatch.setattr(conversations, "CHUNK_BITS", bits[0])
    monkeypatch.setattr(conversations, "GROUP_BITS", bits[1])
    rows = wild(bits[0])
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.select("*", *[F.lit(1).alias(c) for c in ("key", "at", "audit", "cost", "carry", "n")]).repartition(5).write.parquet(f"{folder}/conversations.parquet")
    got = {r["conv_id"]: r.asDict() for r in queries.QUERIES["op13_bigint_conversation_repair"](spark, folder).collect()}
    want = naive_conversations(rows)
    assert set(got) == set(want)
    for conv, (row, _) in want.items():
        assert {k: got[conv][k] for k in row} == row, conv


def test_repaired_rows(spark):
    rows = wild(7)
    damaged = conversations.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    lines = conversations.repaired(damaged, conversations.edits(damaged)).collect()
    got: dict = {}
    for r in sorted(lines, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.line)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {c: list(out) for c, (_, out) in naive_conversations(rows).items() if out}


def test_no_conversations(spark, folder):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    assert queries.QUERIES["op13_bigint_conversation_repair"](spark, folder).count() == 0


def test_sql_on_damaged_rows(spark, folder):
    """The SQL, too, on rows with nulls, ties, strange roles and repeats."""
    table = spark.createDataFrame([r for r in wild(11) if r[0] != 21], "conv_id long, turn long, role string, text string")
    table.coalesce(1).write.parquet(f"{folder}/in")
    con = connect(SMALL)
    con.execute(f"create or replace view conversations as select * from '{folder}/in/*.parquet'")
    table.repartition(3).write.parquet(f"{folder}/conversations.parquet")
    name = "op13_bigint_conversation_repair"
    assert compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], folder) is None


# --- earlier operators ---------------------------------------------------------------


def test_pii_digits_of_any_length(spark, folder):
    """The columns of the query against the patterns themselves, on runs that once broke the parser."""
    from strataflux.llm import pii

    r = random.Random(4)
    parts = ["4111 1111-1111 1111", "0" * 5000 + ".0.0.1", "255.1.02.3.4.5.6.7", "+49 (30) 123456", "a.b@c-d.org", ".", " ", "-", "x", "300.1.1.1", "1" * 3000, "é"]
    texts = [None, "", "0" * 5000 + ".0.0.1", "1 " * 100_000, *["".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(60)]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    size = lambda m: sum(c.isdigit() for c in m.group())
    for row in queries.QUERIES["op1_anchor_pii"](spark, folder).collect():
        text = texts[row.doc_id] or ""
        spans = [(0, *m.span()) for m in email.finditer(text)]
        spans += [(1, *m.span()) for m in ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        spans += [(2, *m.span()) for m in card.finditer(text) if 16 <= size(m) <= 19 and pii.luhn(re.sub("[^0-9]", "", m.group()))]
        spans += [(3, *m.span()) for m in phone.finditer(text) if 8 <= size(m) <= 15]
        named = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))
        assert row.base_sha256 == hashlib.sha256(named.encode()).hexdigest(), text[:80]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in spans) for k in range(4)]


def test_clean_in_several_passes(spark):
    from strataflux.llm import decontaminate

    items = [(f"i{k}", " ".join(f"q{k}w{j}" for j in range(30))) for k in range(9)]
    docs = [(k, f"lead {items[k][1][20:150]} tail") for k in range(9)] + [(20 + k, f"clean text {k}") for k in range(9)] + [(30, None), (31, "")]
    table = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("spans"), F.lit("x").alias("items")).repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    for words in (10_000, 40):
        left = decontaminate.clean(table, bench, block_words=words)
        assert left.columns == table.columns
        assert sorted(r.doc_id for r in left.collect()) == [*range(20, 29), 30, 31]


def test_encoder_is_dropped_and_bounded():
    import public_tokenizers

    from strataflux.llm import common, tokens

    small = tokens.Encoder()
    small.words.limit = small.pieces.limit = 2_000
    r = random.Random(2)
    texts = [" ".join("".join(r.choices("abcdefgh", k=r.randint(1, 9))) for _ in range(50)).encode() for _ in range(60)]
    for t in texts:
        assert small.encode([t])[0] == np.asarray(small.whole.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes()
    assert len(small.words) + len(small.words.old) < 200
    tokens.encoder()
    common.released()
    assert "encoders" not in public_tokenizers.__dict__


def test_shard_folder_without_scheme(spark, folder):
    from strataflux.llm import binary

    assert binary.qualified(spark, folder) == folder
    assert binary.qualified(spark, "viewfs://there/x") == "viewfs://there/x"
    kept = spark.sparkContext._jsc.hadoopConfiguration()
    before = kept.get("fs.defaultFS")
    try:
        kept.set("fs.defaultFS", "file:///")
        assert "://" not in binary.qualified(spark, "/a/b")
    finally:
        kept.set("fs.defaultFS", before) if before else kept.unset("fs.defaultFS")
