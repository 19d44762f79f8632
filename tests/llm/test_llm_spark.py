"""The training-data operators on tables with nulls, empties, repeats, ties and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evenkeel.llm import decontaminate, digests, langid, lm, packing, secret_scan, simhash, token_counts, token_store, toxicity
from evenkeel.llm.common import crc_mod, scratch

WORDS = [f"{a}{b}" for a in ("the", "on", "er", "thing", "sh") for b in ("re", "st", "an", "ly", "ti", "ou")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, digest string, score double, wide string, n int, _digest string, row int"


def texts():
    rng = random.Random(11)
    base = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 60))) for _ in range(24)]
    base[3] = base[2]
    base[5] = "A  tab\there,\nÉCOLE école. It's 5 " + base[4]
    return [*base, None, "", " \n ", "one", "x" * 4000, " ".join(WORDS * 300)]


@pytest.fixture(scope="module")
def rows():
    some = [(k, t) for k, t in enumerate(texts())]
    # a null id, an id with several texts, and rows that repeat
    return [*some, (None, "null id " + WORDS[0]), (7, "other text of seven"), (7, "other text of seven"), (9, texts()[9]), (9, texts()[9])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 4}" if i != 8 else None, 1, "k", "d", 0.5, "w", 1, "keepme", 2) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return [(v is not None, v) for v in x]


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=key)


def test_token_store_reads_back_every_id(spark, docs, rows, empty):
    store = token_store.write_store(docs, scratch(spark, "store"), shards=4, bucket_keys=5)
    found = token_store.read_ids(store, token_store.locate(store, docs)).collect()
    encoder = token_store.encoder(token_store.vocabulary_path())
    expected = collections.Counter((i, encoder.encode(pa.array([t or ""]))[0].tobytes()) for i, t in rows)
    assert collections.Counter((r["key"], bytes(r["ids"])) for r in found) == expected
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] * 2 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes())
        at += r["n_tokens"]
    keys = [(r["key"] is not None, r["key"]) for r in sorted(found, key=lambda r: r["start"])]
    assert keys == sorted(keys)
    strangers = spark.createDataFrame([(k,) for k in range(10_000, 10_200)], "doc_id long")
    assert token_store.locate(store, strangers).count() == 0
    nothing = token_store.write_store(empty, scratch(spark, "store"))
    assert token_store.read_ids(nothing, token_store.locate(nothing, empty)).count() == 0


def test_token_counts(docs, rows, empty):
    counter = token_counts.counter(token_counts.vocabulary_path())
    expected = [(i, *(int(x[0]) for x in counter.count(pa.array([t or ""])))) for i, t in rows]
    assert sorted_rows(token_counts.token_counts(docs)) == sorted(expected, key=key)
    assert token_counts.token_counts(empty).count() == 0


BENCHMARK = [(1, " ".join(WORDS[:14])), (2, "one"), (3, None), (4, ""), (5, " ".join(WORDS[10:15])), (5, " ".join(WORDS[10:15])), (None, "text of seven")]


def brute_contamination(text):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words, hit, items = pattern.findall(lower(text)), set(), set()
    for item, other in BENCHMARK:
        w = pattern.findall(lower(other))
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[s : s + n]:
                    hit |= set(range(p, p + n))
                    items.add("null" if item is None else str(item))
    return len(words), len(hit), sorted(items)


@pytest.mark.parametrize("block", [100_000, 3])
def test_contamination(spark, docs, rows, empty, block):
    benchmark = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    found = decontaminate.contamination(docs, benchmark, block_windows=block).select("doc_id", "n_words", "n_hit", "items")
    assert sorted_rows(found) == sorted(((i, *brute_contamination(t)) for i, t in rows), key=key)
    kept = decontaminate.without_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == kept.where("_digest = 'keepme' and row = 2").count() == sum(not brute_contamination(t)[1] for _, t in rows)
    assert decontaminate.contamination(empty, benchmark).count() == 0
    clean = decontaminate.contamination(docs, benchmark.where("false"))
    assert clean.count() == len(rows) and clean.where("n_hit > 0").count() == 0


@pytest.mark.parametrize("block", [600, 1 << 20])
def test_lm_scores(monkeypatch, docs, rows, empty, block):
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "RANGE", 3000)
    got = lm.score_texts(docs, ~crc_mod("doc_id", 7, 2)).select("doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    tokens = [(i, [*(t or "").encode().lower().split(), b"\n"], i is None or zlib.crc32(str(i).encode()) % 7 != 2) for i, t in rows]
    c, pairs, triples = collections.Counter(), collections.Counter(), collections.Counter()
    for _, x, train in tokens:
        if train:
            c.update(x)
            pairs.update(zip([b"\n", *x], x, strict=False))
            triples.update(zip([b"\n", *x], x, x[1:], strict=False))
    n, v, (k2, k3) = sum(c.values()), len(c), lm.CONCENTRATIONS

    def p2(u, w):
        return (pairs[u, w] + k2 * (c[w] + 1) / (n + v + 1)) / (c[u] + k2)

    def p3(t, u, w):
        return (triples[t, u, w] + k3 * p2(u, w)) / (pairs[t, u] + k3)

    expected = []
    for i, x, train in tokens:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)
        score = math.log10(p2(b"\n", x[0])) + sum(math.log10(p3(t, u, w)) for t, u, w in zip([b"\n", *x], x, x[1:], strict=False))
        expected.append((i, train, len(x), sum(c[w] > 0 for w in x), n, base, score))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])
    assert lm.score_texts(empty, F.lit(True)).count() == 0
    untrained = lm.score_texts(docs, F.lit(False)).agg(F.max("n_known"), F.max("train_tokens"), F.count("*")).first()
    assert tuple(untrained) == (0, 0, len(rows))


def test_secret_scans_and_redaction(spark, docs, rows, empty):
    found = sorted_rows(secret_scan.scan_secrets(docs).select("doc_id", "spans"))
    assert found == sorted(((i, secret_scan.written(secret_scan.scan(t)[1])) for i, t in rows), key=key)
    some = spark.createDataFrame([("x token = 'abcdef123' y",), (None,), ("",)], "text string")
    assert [r[0] for r in secret_scan.redact_secrets(some).collect()] == ["x [SECRET]' y", None, ""]
    assert secret_scan.scan_secrets(empty).count() == 0


@pytest.mark.parametrize("bucket", [4096, 3])
def test_near_components(monkeypatch, spark, docs, rows, empty, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    base = texts()[29].split()
    near = [(100 + k, " ".join(base[:k] + ["other"] + base[k + 1 :])) for k in range(12)]
    every = rows + near
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    prints = [(i, simhash.fingerprint(t)) for i, t in every]
    parent = list(range(len(every)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(every)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        least[find(k)] = min(least.get(find(k), 10**9), 10**9 if i is None else i)
    expected = [(i, p - (p >> 63 << 64), least[find(k)] if least[find(k)] < 10**9 else None) for k, (i, p) in enumerate(prints)]
    assert sorted_rows(simhash.near_components(table)) == sorted(expected, key=key)
    assert simhash.near_components(empty).count() == 0


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    roots = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(roots[k] == 0 for k in range(51)) and all(roots[k] == 100 for k in range(100, 140))


def test_one_of_each_group(spark, docs, rows, empty):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    near = [(200 + k, " ".join(base[: 9 * k] + ["edit"] + base[9 * k + 1 :])) for k in range(6)]
    table = docs.unionByName(spark.createDataFrame([(i, t, *[None] * 10) for i, t in near], SCHEMA))
    kept = simhash.one_of_each_group(table)
    assert kept.columns == docs.columns and kept.where("doc_id < 200 and (_digest <> 'keepme' or row <> 2)").count() == 0
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert [i for i in ids if i and i >= 200] == [200]
    # copies, and the null, empty and blank texts, which all have no words
    texts_ = {t or "" for _, t in rows}
    assert len(ids) - 1 <= len(texts_) and 3 not in ids and 2 in ids and ids.count(9) == 1 and None in ids
    assert simhash.one_of_each_group(empty).count() == 0


def jaccard(a, b):
    a, b = (set(zip(*(x.split()[k:] for k in range(5)), strict=False)) for x in (a, b))
    return len(a & b) / len(a | b)


def near_pairs(kinds):
    """(base, edited) texts of new words, by (words, words appended, run of words replaced, pairs)."""
    rng = random.Random(8)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    for words, appended, replaced, pairs in kinds:
        for _ in range(pairs):
            base, at = new(words), (words - replaced) // 2
            yield " ".join(base), " ".join(base[:at] + new(replaced) + base[at + replaced :] + new(appended))


def linked_pairs(spark, pairs):
    table = spark.createDataFrame([(t,) for pair in pairs for t in pair], "text string")
    roots = dict(map(tuple, simhash.near_groups(table).collect()))
    named = [[hashlib.md5(t.encode()).hexdigest() for t in pair] for pair in pairs]
    return [a in roots and roots[a] == roots.get(b) for a, b in named]


def test_near_copies_with_one_run_of_new_text_are_found(spark):
    pairs = list(near_pairs([(400, 60, 0, 12), (100, 15, 0, 12), (400, 0, 30, 12)]))
    assert all(0.83 < jaccard(*pair) < 0.88 for pair in pairs)
    assert all(linked_pairs(spark, pairs))


def test_near_groups_are_those_of_true_similarity(monkeypatch, spark):
    pairs = list(near_pairs([(400, 99, 0, 6), (100, 24, 0, 6), (8, 1, 0, 10), (400, 0, 39, 6), (12, 1, 1, 6), (200, 60, 0, 6), (204, 0, 42, 6)]))
    rng = random.Random(5)
    pairs += [(x, " ".join(x.split()[:-1] + [f"v{rng.randrange(10**9)}"])) for n in (10, 12) for x in (" ".join(f"u{rng.randrange(10**9)}" for _ in range(n)) for _ in range(10))]
    assert linked_pairs(spark, pairs) == [jaccard(*pair) >= 0.8 for pair in pairs]
    # a chain that only its neighbours hold together, larger than a part of a cluster
    base = [f"z{rng.randrange(10**9)}" for _ in range(100)]
    chain = [" ".join(base[k * 3 :] + [f"n{j}" for j in range(k * 3)]) for k in range(12)]
    assert jaccard(chain[0], chain[1]) >= 0.8 > jaccard(chain[0], chain[4])
    monkeypatch.setattr(simhash, "CLUSTER", 3)
    monkeypatch.setattr(simhash, "BUCKET", 3)
    assert all(linked_pairs(spark, [(chain[0], x) for x in chain[1:]]))


def brute_canonical(text):
    import unicodedata

    composed = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", composed(composed(text or "").casefold())).strip()


def test_document_fingerprints(spark, docs, rows, empty):
    got = digests.edited_against_next(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    once = [(i, t or "") for i, t in rows if len([x for x, _ in rows if x == i]) == 1 and i is not None]
    following = dict(zip([i for i, _ in once], [t for _, t in once[1:]] + [""], strict=True))
    for i, text in once:
        r, half = by[i][0], len(text) // 2
        assert r["n_chars"] == len(text)
        if i + 1 in following:  # ids with several texts have no single next text to compare with
            edited = text[: len(text) - half] + following[i][:half]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert r["near_edited"] == float(brute_canonical(edited) == brute_canonical(text))
    prints = {tuple(r) for r in digests.fingerprints(docs).select("fingerprint").distinct().collect()}
    assert len(prints) == len({brute_canonical(t) for _, t in rows})
    assert digests.edited_against_next(empty).count() == 0
    one = spark.createDataFrame([(5, "ab")], "doc_id long, text string")
    assert digests.edited_against_next(one).first()["edited_sha256"] == hashlib.sha256(b"aa").hexdigest()


def test_forms_fold_case(spark):
    texts_ = ["STRASSE", "Straße", "straẞe", "σασ", "σας", "ΣΑΣ", "İ", "i̇", "I", "ﬁ", "fi", "Å", "å", "a\u00a0 b", "A b", "ﬃ ́", "x" * 300_000 + "É", "X" * 300_000 + "é"]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    found = dict(map(tuple, digests.fingerprints(df).collect()))
    for i, a in enumerate(texts_):
        for j, b in enumerate(texts_):
            assert (found[i] == found[j]) == (brute_canonical(a) == brute_canonical(b)), (a, b)


@pytest.mark.parametrize("kind", ["string", "date", "double"])
def test_fingerprints_of_ids_of_any_type(spark, monkeypatch, kind):
    ids = {"string": [f"id-{k:03d}" for k in range(60)], "date": [f"2024-01-{k:02d}" for k in range(1, 32)], "double": [str(k / 4) for k in range(50)]}[kind]
    rows = [(i, f"text {i} and more") for i in ids]
    df = spark.createDataFrame([*rows, (None, "no id"), *[(ids[3], "hot")] * 40], "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = digests.edited_against_next(df.repartition(3))
    assert got.count() == len(rows) + 41
    by = {str(r["doc_id"]): r for r in got.collect()}
    for (i, text), (_, after) in zip(rows[4:], rows[5:], strict=False):
        half = len(text) // 2
        assert by[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def test_forms_that_share_a_hash_are_told_apart(monkeypatch, spark):
    monkeypatch.setattr(digests, "wide_hash", lambda column: F.lit("0" * 32))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A "), (4, "c")], "doc_id long, text string")
    found = dict(map(tuple, digests.fingerprints(df).collect()))
    assert found[1] == found[3] and len(set(found.values())) == 3
    assert all(r["near_edited"] in (0.0, 1.0) for r in digests.edited_against_next(df).collect())


def test_packing(docs, rows, empty):
    found = packing.pack_documents(docs, capacity=64, group_rows=20)
    counter = token_counts.counter(token_counts.vocabulary_path())
    total = found.groupBy("doc_id").agg(F.sum("n_tokens")).collect()
    expected = collections.Counter()
    for i, t in rows:
        expected[i] += int(counter.count(pa.array([t or ""]))[1][0])
    assert dict(map(tuple, total)) == expected
    # no bin holds two whole documents of one source
    sources = {i: f"s{(i or 0) % 4}" for i, _ in rows if i != 8}
    held = collections.Counter((r["group"], r["bin"], sources[r["doc_id"]]) for r in found.collect() if r["doc_id"] in sources and 0 < r["n_tokens"] == expected[r["doc_id"]])
    assert held and max(held.values()) == 1
    assert found.groupBy("group", "bin").agg(F.sum("n_tokens").alias("s")).agg(F.max("s")).first()[0] <= 64
    assert packing.pack_documents(empty).count() == 0


def test_classifiers_on_odd_tables(spark, docs, rows, empty):
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(20)] + [(None, 1), (3, None), (4, 0)], "doc_id long, toxic int")
    for usable in (labels, labels.where("false"), labels.where("toxic = 1")):
        scored = toxicity.score(docs, toxicity.train(docs, usable))
        assert scored.count() == len(rows) and scored.where("not (score between 0 and 1)").count() == 0
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    found = langid.predict(docs, langid.train(docs))
    assert found.count() == len(rows)
    assert {r["lang_pred"] for r in found.where("doc_id in (24, 25, 26)").collect()} == {"und"}
    assert {r["lang_pred"] for r in langid.predict(docs, langid.train(empty)).collect()} == {"und"}


def test_languages_of_copies_are_learned(spark):
    one = [(k, "wort und satz " * 3, "de") for k in range(3000)]
    again = [(9000, "mot et phrase", "fr")] * 3000
    others = [(5000 + k, f"some words {WORDS[k % 30]} {WORDS[k // 30]}", "en") for k in range(600)]
    model = langid.train(spark.createDataFrame(one + again + others, "doc_id long, text string, lang string"), sample_rows=40)
    assert sorted(model.languages) == ["de", "en", "fr"]


def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        path = scratch(spark, f"test-{name}")
        after.write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == docs.columns and 0 < after.count() <= before.count()
        if name == "near_dedup":
            assert after.groupBy("text").count().where("count > 1").count() == 0
        if name == "decontamination":
            found = decontaminate.contamination(after, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
            assert found.where("n_hit > 0").count() == 0
        if name == "secrets":
            assert after.count() == before.count()
            assert all(not secret_scan.scan(r["text"])[1] for r in after.collect())
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert packed.select("doc_id").distinct().count() == before.count()
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()
