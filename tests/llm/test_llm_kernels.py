"""Kernels of the training-data operators against brute force, without Spark."""

import collections
import functools
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from evenkeel.llm import langid, lm, packing, secret_scan, simhash, token_counts, token_store, toxicity
from evenkeel.llm.common import byte_ngrams, mix64, pieces
from evenkeel.llm.token_counts import WORDS, LongestMatch, TokenCounter, byte_of_symbol, symbols, vocabulary_path
from evenkeel.llm.token_store import Encoder, build_hash, find_slots


@given(st.lists(st.text("abc", min_size=1, max_size=5), max_size=12), st.lists(st.text("abc", max_size=30), max_size=5))
def test_longest_match_counts_what_greedy_search_counts(pieces, words):
    # pieces within words, and pieces that end them
    inner, last = {w.encode() for w in pieces[::2]} | {b"a", b"b", b"c"}, {w.encode() for w in pieces[1::2]} | {b"a", b"b", b"c"}
    expected = []
    for word in words:
        data, n, at = word.encode(), 0, 0
        while at < len(data):
            at += max(k for k in range(1, len(data) - at + 1) if data[at : at + k] in (last if at + k == len(data) else inner))
            n += 1
        expected.append(n)
    found = LongestMatch([*map(tuple, inner), *(tuple(symbols(w)) for w in last)]).count([w.encode() for w in words])
    assert found.tolist() == expected


#: Marks, cases and characters that a tokenizer may take together or apart.
ODD = st.text(st.sampled_from("aZé\u0130\u0301\u0307\u0331H.,'s3\u00b2ßΣς日\u00a0 \n\t\x1c-<|>И"), max_size=30)


@settings(deadline=None)
@given(st.lists(ODD, max_size=4))
def test_token_counts_are_those_of_greedy_search(texts):
    counter, tokenizer = shared_counter(), shared_encoder()._tokenizer
    vocabulary, symbol = set(tokenizer.get_vocab()), {b: c for c, b in byte_of_symbol().items()}
    expected = []
    for text in texts:
        words, n = WORDS.findall(tokenizer.normalizer.normalize_str(text)), 0
        for word in words:
            left = "".join(symbol[b] for b in word.encode())
            while left:
                fits = [k for k in range(1, len(left) + 1) if (left[:k] + "</w>" if k == len(left) else left[:k]) in vocabulary]
                left, n = left[max(fits) :], n + 1
        expected.append((len(words), n))
    assert counted(counter, texts) == expected == counted(counter, texts)


def counted(counter, texts):
    words, tokens = counter.count(pa.array(texts, pa.string()))
    return list(zip(words.tolist(), tokens.tolist(), strict=True))


def test_counter_forgets_without_changing_counts(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 30)
    rng, small = random.Random(3), TokenCounter(vocabulary_path())
    for _ in range(20):
        texts = [" ".join("".join(rng.choices("aébcİ3", k=rng.randrange(1, 5))) + rng.choice(["", ".", ","]) for _ in range(20)), "x" * 3000]
        assert counted(small, texts) == counted(shared_counter(), texts)
    assert len(small._known) < 150
    assert counted(small, ["", " \n ", "the cat's 42"]) == [(0, 0), (0, 0), (5, 5)]


@functools.cache
def shared_counter():
    return TokenCounter(vocabulary_path())


@functools.cache
def shared_encoder():
    return Encoder(vocabulary_path())


def encoded(encoder, texts):
    ids, n = encoder.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if len(n) else []


@settings(deadline=None)
@given(st.lists(ODD | st.sampled_from(["İ.", "KAPALİ. son", "<|ENDOFTEXT|>", "<|endoftext|>.", "a<|startoftext|>B,"]), max_size=5))
def test_chunks_encode_as_whole_texts_do(texts):
    encoder = shared_encoder()
    expected = [[*encoder._tokenizer.encode(text, add_special_tokens=False).ids, 2] for text in texts]
    assert encoded(encoder, texts) == expected == encoded(encoder, texts)


def test_encoder_forgets_without_changing_ids(monkeypatch):
    monkeypatch.setattr(token_store, "REMEMBERED", 40)
    encoder, rng = Encoder(vocabulary_path()), random.Random(3)
    for _ in range(20):
        texts = [" ".join("".join(rng.choices("aébcİ3", k=rng.randrange(1, 5))) + rng.choice(["", ".", ","]) for _ in range(20)), "x" * 3000 + ". don't, can't."]
        assert encoded(encoder, texts) == [[*encoder._tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert len(encoder._known) < 200


@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_perfect_hash_gives_each_key_its_own_slot(keys):
    hashes = np.array(sorted(keys), np.uint64)
    sizes, bits = build_hash(hashes)
    assert sorted(find_slots(hashes, sizes, bits).tolist()) == list(range(len(keys)))


def test_keys_with_equal_hashes_are_listed():
    with pytest.raises(ValueError):
        build_hash(np.array([5, 5, 9], np.uint64))
    rows = pa.table({"bucket": [0] * 4, "text": list("abcd"), "hash": [7, 9, 7, 11], "mark": [1, 2, 1, 4], "shard": [0] * 4, "ordinal": [0, 1, 2, 3], "n": [1] * 4})
    bucket = token_store._build_bucket(rows).to_pylist()[0]
    assert bucket["n_keys"] == 2 and [(x["text"], x["ordinal"]) for x in bucket["same"]] == [("a", 0), ("c", 2)]


@given(st.binary(max_size=60), st.integers(1, 9))
def test_pieces_keep_words_whole(data, size):
    parts = list(pieces(data, size))
    assert b"".join(parts) == data
    assert [w for p in parts for w in p.split()] == data.split()


def test_ngram_places_are_those_of_their_bytes():
    a, b = byte_ngrams(b"xxabcyy", (3,), 18), byte_ngrams(b"abc", (3,), 18)
    assert b[0] in a and len(a) == 5 and len(byte_ngrams(b"ab", (3,), 18)) == 0


@given(st.lists(st.integers(0, 2**64 - 1), max_size=40))
def test_packing_of_numbers_round_trips(values):
    x = np.array(sorted(values), np.uint64)
    assert lm.unpacked(lm.packed(x)).tolist() == lm.unpacked_ascending(lm.packed_ascending(x)).tolist() == x.tolist()
    small = np.array([v % 1000 for v in values], np.int64)
    assert lm.unpacked(lm.packed(small)).tolist() == small.tolist()


def small_automaton(texts, concentrations=(7.0, 3.0)):
    """Of texts as lists of places; place 0 ends a text."""
    size = 1 + max(w for t in texts for w in t)
    flat = np.array([w for t in texts for w in (-1, 0, *t, 0)])
    block = lm.Texts(flat, np.array([len(t) + 1 for t in texts]), np.ones(len(texts), bool), size)
    counts = np.bincount(flat[block.token], minlength=size + 1).astype(float)
    seen = block.own.astype(float)
    triples, own, _ = block.triples(seen, np.ones(len(seen), bool))
    return lm.Automaton(counts[:size], block.pairs, seen, triples, own, int(counts.sum()), int((counts > 0).sum()), concentrations), block


@given(st.lists(st.lists(st.integers(1, 4), max_size=12), min_size=1, max_size=5).filter(any))
def test_automaton_probabilities_sum_to_one(texts):
    automaton, _ = small_automaton(texts)
    unknown = 1 / (sum(len(t) + 1 for t in texts) + len({0} | {w for t in texts for w in t}) + 1)
    words = np.flatnonzero(10**automaton.root > unknown * 1.5)
    pairs = [automaton.size + k for k in np.flatnonzero(automaton.there & (automaton.failure[automaton.size :] > 0))]
    # after a pair that ends a text nothing follows
    for state in [*words, *pairs]:
        known = (10 ** automaton.read(np.full(len(words), state), words)[1]).sum()
        # what is left is an unknown word's share, down all failure arcs
        rest, at = unknown, state
        while at != automaton.root_state:
            rest, at = rest * 10 ** automaton.back_off[at], automaton.failure[at]
        assert known + rest == pytest.approx(1)


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(1, 5), max_size=30), min_size=1, max_size=6).filter(any), st.integers(1, 9))
def test_lanes_read_as_one_traversal_does(texts, lane):
    automaton, block = small_automaton(texts)
    arcs = {(k // automaton.size, k % automaton.size): (w, t) for k, w, t in zip(automaton.arcs.tolist(), automaton.weights.tolist(), automaton.targets.tolist(), strict=True)}
    expected = []
    for t in texts:
        state, total = 0, 0.0
        for w in [*t, 0]:
            while state != automaton.root_state and (state, w) not in arcs:
                total += automaton.back_off[state]
                state = int(automaton.failure[state])
            weight, state = (automaton.root[w], w) if state == automaton.root_state else arcs[state, w]
            total += weight
        expected.append(total)
    before, lm.LANE = lm.LANE, lane
    try:
        assert automaton.scores(block).tolist() == pytest.approx(expected)
    finally:
        lm.LANE = before


def brute_fingerprint(text, n=3):
    words = text.encode().lower().split()
    some = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in some]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@given(st.text("ab cÉ\n", max_size=60))
def test_fingerprints_count_majorities(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_fingerprints_of_long_texts_cross_pieces(monkeypatch):
    text = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "delta"]) + str(k % 7) for k in range(900))
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint("") == simhash.fingerprint(None) == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 200))
def test_connected_finds_the_components(seed, n):
    rng = np.random.default_rng(seed)
    fps = rng.choice(mix64(np.arange(6, dtype=np.uint64)), n)
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    rows = simhash.tabled(fps.reshape(-1, 1)).to_pylist()
    assert all(len(x) == 8 + 2 * simhash.PIVOTS for x in rows)
    labels = simhash._near_bits(3, 1)(rows)
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in itertools.combinations(range(n), 2):
        if int(fps[i] ^ fps[j]).bit_count() <= 3:
            parent[find(i)] = find(j)
    assert {(i, j) for i in range(n) for j in range(n) if labels[i] == labels[j]} == {(i, j) for i in range(n) for j in range(n) if find(i) == find(j)}


def test_wide_fingerprints_estimate_similarity():
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    edited = list(words)
    for k in range(0, 600, 60):
        edited[k] = "other"
    a, b = (set(zip(*(x[k:] for k in range(5)), strict=False)) for x in (words, edited))
    jaccard = len(a & b) / len(a | b)
    bits = [np.frombuffer(simhash.wide_fingerprint(" ".join(x), 5, 16), "<u8") for x in (words, edited)]
    apart = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
    assert abs(apart - 1024 * math.acos(2 * jaccard / (1 + jaccard)) / math.pi) < 50


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60))
def test_prefixes_meet_and_alike_sets_are_joined(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 62, 12).astype(np.uint64)
    sets = [np.unique(rng.choice(base, rng.integers(1, 12))) for _ in range(n)]
    hot = base[:4]
    forest = simhash.Forest(n)
    for i, j in itertools.combinations(range(n), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
            assert len(np.intersect1d(simhash.prefix(sets[i], hot, 0.8), simhash.prefix(sets[j], hot, 0.8)))
            forest.join(np.array([i]), np.array([j]))
    assert (simhash.alike(sets, 0.8) == forest.labels).all()


def test_random_runs_behind_a_prefix_of_another_alphabet_are_found():
    rng = random.Random(2)
    body = "".join(rng.choices(secret_scan.ALPHABETS["base64"], k=30)) + "+a/9" + "".join(rng.choices(secret_scan.ALPHABETS["base64"], k=30))
    for before in ("key-", "my_api_key-"):
        text = f"see {before}{body} there"
        spans = secret_scan.scan(text)[1]
        assert any(text[start:end] == body for start, _, end in spans), spans
        assert body not in secret_scan.redact(text)
    body = body.replace("+", "-").replace("/", "_")
    assert body not in secret_scan.redact(f"path/{body} there")


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


@given(st.lists(st.sampled_from(["password", "TOKEN", "api_key", "apİkey", "=", ": ", '"', " ", "abc", "0123456789abcdef01234567", "AKIA", "Q" * 16, "x" * 6, "é", "\n"]), max_size=14).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base, every = secret_scan.scan(text)
    assert base == sorted(spans) and set(base) <= set(every)
    assert secret_scan.scan(secret_scan.redact(text))[0] == [] or "[SECRET]" in secret_scan.redact(text)


NAMES = "quick request handler return connection pool size default value internal server error message parse config file user account service number list array buffer image header content cache index page search result update delete insert".split()


def regular(rng, n):
    """A text-like string of n characters: names joined in one of five styles, with digits."""
    style, out = rng.randrange(5), ""
    while len(out) < n:
        w = rng.choice(NAMES)
        out += (w.capitalize(), w + "_", w + "-", w + "/", w + str(rng.randrange(100)))[style]
    return out[: n - 2] + str(rng.randrange(10, 99))


@pytest.mark.parametrize(("n", "recall"), [(20, 0.6), (32, 0.85), (64, 0.95)])
def test_labelled_strings(n, recall):
    rng = random.Random(n)
    for encoding in ("base32", "base62", "base64", "lower"):
        keys = ["".join(rng.choices(secret_scan.ALPHABETS[encoding], k=n)) for _ in range(100)]
        assert sum(bool(secret_scan._random(f"key {x} there")) for x in keys) >= recall * 100, encoding
    assert sum(bool(secret_scan._random(f"name {regular(rng, n)} there")) for _ in range(1000)) <= 10
    assert not any(secret_scan._random("number " + "".join(rng.choices("0123456789", k=n))) for _ in range(100))


def test_regular_strings_beside_a_key_are_let_go():
    rng, hits, others = random.Random(1), 0, 0
    for _ in range(50):
        key = "".join(rng.choices(secret_scan.ALPHABETS["base62"], k=64))
        text = " ".join([*(regular(rng, 30) for _ in range(10)), key, *(regular(rng, 30) for _ in range(10))])
        spans = [text[a:b] for a, _, b in secret_scan._random(text)]
        hits += key in spans
        others += len(spans) - (key in spans)
    assert hits >= 45 and others <= 5, (hits, others)


def test_orderly_strings_are_no_keys():
    for text in ("aaaaaaaaaaaaaaaaaaaaaaaaaaaa1111", "abcdefghijklmnopqrstuvwxyz0123456789", "thisisjustalongwordofletters", "1234567890" * 4, "ABababABababABababABabab0000"):
        assert secret_scan._random(text) == [], text
    assert secret_scan.redact(None) is None and secret_scan.redact("") == ""


@given(st.lists(st.tuples(st.integers(0, 25), st.sampled_from(["a", "b", "c", None]), st.sampled_from(["x", "y", None])), max_size=40))
def test_packing_respects_conflicts_and_the_best_fit(items):
    capacity = 10
    out = list(packing.pack([i[0] for i in items], [i[1] for i in items], [i[2] for i in items], capacity))
    assert sorted((row, sum(o[4] for o in out if o[0] == row)) for row in {o[0] for o in out}) == [(k, i[0]) for k, i in enumerate(items)]
    held = {}
    for row, _, number, at, size in sorted(out, key=lambda o: (o[2], o[3])):
        b = held.setdefault(number, [0, [], []])
        assert at == b[0] and at + size <= capacity
        b[0] += size
        if items[row][0] <= capacity:
            b[1].append(items[row][1])
            b[2].append(items[row][2])
    for _, sources, clusters in held.values():
        for values in (sources, clusters):
            some = [v for v in values if v is not None]
            assert len(some) == len(set(some))
    if all(i[0] <= capacity for i in items):
        # every document is in the tightest bin that was compatible when its turn came
        chosen = {row: number for row, _, number, _, _ in out}
        bins = {}
        for row in sorted(chosen, key=lambda k: (-items[k][0], k)):
            size, source, cluster = items[row]
            fits = {k: room for k, (room, sources, clusters) in bins.items() if room >= size and source not in sources and cluster not in clusters}
            mine = chosen[row]
            assert (mine in fits and fits[mine] == min(fits.values())) if fits else mine not in bins
            b = bins.setdefault(mine, [capacity, set(), set()])
            b[0] -= size
            b[1] |= {source} - {None}
            b[2] |= {cluster} - {None}


def test_classifiers_learn_small_examples():
    rng = random.Random(2)
    plain = [f"t{k}h {w}" for k in range(40) for w in ("onthe", "inand")]
    clean = [" ".join(rng.choices(plain, k=30)) for _ in range(120)]
    toxic = [c + " you idiot" for c in clean[:60]]
    sets = [toxicity.features(t) for t in clean[60:] + toxic]
    model = toxicity.fit(sets, np.array([0] * 60 + [1] * 60))
    assert model.score("some idiot here") > 0.5 > model.score(clean[0]) and 0 <= model.score(None) <= 1
    assert toxicity.fit([], np.zeros(0)).score("x") < 0.5
    assert toxicity.features("a " * 600_000).tolist() == toxicity.features("a " * 500).tolist()
    counts = {"x": np.vstack([langid.ngram_counts("der die das und " * k) for k in (1, 2, 3)]), "y": np.vstack([langid.ngram_counts("the of and in " * k) for k in (1, 2, 3)])}
    languages = langid.fit(counts)
    assert languages.predict("das und der")[0] == "x" and languages.predict("in the")[0] == "y"
    assert languages.predict(None)[0] == languages.predict("12 ?!")[0] == languages.predict("")[0] == "und"
    assert langid.fit({}).predict("the")[0] == "und"


def brute_places(data, sizes, bits):
    """Places of all byte n-grams: the big-endian number times an odd factor, its highest bits."""
    return [int.from_bytes(data[k : k + n]) * (0x9E3779B97F4A7C15 + 2 * n) % 2**64 >> (64 - bits) for n in sizes for k in range(len(data) - n + 1)]


@settings(deadline=None, max_examples=30)
@given(st.lists(st.text(st.sampled_from("abcÄßéя日 .3_\n"), max_size=25), min_size=4, max_size=10))
def test_languages_are_those_of_the_nearest_centroid(texts):
    counts = {}
    for k, text in enumerate(texts):
        vector = langid.ngram_counts(text)
        letters = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
        assert (vector is None) == (not letters)
        if vector is not None:
            assert {k: int(v) for k, v in enumerate(vector) if v} == dict(collections.Counter(brute_places(f" {letters} ".encode(), langid.SIZES, langid.BITS)))
            counts.setdefault(f"l{k % 2}", []).append(vector)
    model = langid.fit({k: np.vstack(v) for k, v in counts.items()})
    for text in texts:
        vector = langid.ngram_counts(text)
        if vector is None:
            assert model.predict(text) == ("und", 0.0, True)
            continue
        weighted = {k: math.log(1 + v) * float(model.idf[k]) for k, v in enumerate(vector) if v}
        norm = math.sqrt(sum(v * v for v in weighted.values()))
        cosines = [sum(v / norm * float(c[k]) for k, v in weighted.items()) for c in model.centroids]
        language, score, _ = model.predict(text)
        assert score == pytest.approx(max(cosines), abs=1e-5)
        assert max(c for c, o in zip(cosines, model.owner, strict=True) if model.languages[o] == language) == pytest.approx(max(cosines), abs=1e-5)


@settings(deadline=None, max_examples=30)
@given(st.text(st.sampled_from("abAÉ日 \t!"), max_size=40), st.integers(0, 2**32))
def test_toxicity_scores_add_the_weights_of_a_texts_ngrams(text, seed):
    places = set(brute_places((" " + re.sub(rb"[ \t]+", b" ", text.encode().lower()).strip().decode() + " ").encode(), toxicity.SIZES, toxicity.BITS))
    if text.strip():
        assert set(toxicity.features(text).tolist()) == places
    weights = np.random.default_rng(seed).normal(size=1 << toxicity.BITS).astype(np.float32)
    z = sum(float(weights[k]) for k in toxicity.features(text)) - 0.25
    assert toxicity.ToxicityModel(weights, -0.25).score(text) == pytest.approx(1 / (1 + math.exp(-z)))


def test_log_count_ratios_scale_the_features():
    rng = np.random.default_rng(1)
    labels = np.array([1] * 60 + [0] * 60)
    rows = [np.unique(np.concatenate([rng.integers(100, 1000, 20), [7] if y and rng.random() < 0.9 else [], [9] if not y else []]).astype(np.int64)) for y in labels]
    model = toxicity.fit(rows, labels)
    # what one class has alone decides, what both have does not
    assert model.weights[7] > 0 >= model.weights[9] and np.abs(model.weights[100:]).max() < abs(model.weights[7])
    assert all((1 / (1 + math.exp(-(model.weights[r].sum() + model.intercept))) >= 0.5) == (7 in r) for r in rows if 7 in r or 9 in r)


def test_digest_of_no_spans_is_that_of_nothing():
    assert secret_scan.written([]) == "" and hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
