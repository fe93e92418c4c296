"""The ten operators against brute force, on small tables with nulls, ties, repeats, long and empty texts and extra columns."""

import collections
import hashlib
import math
import os
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from quern.llm import common, op1_aq, op2_quality, op3_packing, op4_toxicity, op5_ctw, op6_bpe, op7_simhash, op8_suffix, op9_sharding, op10_lines
from quern.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, `key` string"
SF = "/root/testdata/sf0.001"


def table(spark, rows, schema, parts=3):
    """rows as a table that reads the same every time."""
    return common.checkpointed(spark.createDataFrame(rows, schema).repartition(parts))


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en" if i % 2 else None, "s", 0, 7, "k") for i, t in enumerate(texts)]
    return table(spark, rows, DOCS)


def prose(n, seed, words=80):
    rng = random.Random(seed)
    syllables = ["an", "ther", "ing", "ou", "sté", "wh", "ble", "tion", "re", "or"]
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, words))) for _ in range(n)]


ODD = [None, "", " \n\t ", "one", "é ü　x", "a\x00b", "word " * 3000, "x" * 5000, "same line\nsame line\n\nother", "ab" * 700]


# 1


def exact(vectors, queries, k):
    out = set()
    for q, x in queries:
        near = sorted((math.sqrt(sum((float(a) - float(b)) ** 2 for a, b in zip(x, y, strict=True))), i) for i, y in vectors if i != q)[:k]
        out |= {(q, r + 1, i, round(s, 9)) for r, (s, i) in enumerate(near)}
    return out


def test_aq_finds_exact_neighbours_and_ignores_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist(), 1) for i in range(300)]
    rows += [(300 + i, rows[0][1], 1) for i in range(40)]  # copies of one vector
    bad = [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [None] + [1.0] * 7, 1), (904, [float("inf")] * 8, 1), (None, [1.0] * 8, 1)]
    frame = table(spark, rows + bad, "vec_id long, embedding array<double>, id long")
    got = op1_aq.search(frame, frame.where("vec_id % 30 = 0 OR vec_id > 800"), k=5, words=32, shortlist=64)
    want = exact([(i, x) for i, x, _ in rows], [(i, x) for i, x, _ in rows if i % 30 == 0], 5)
    assert {(r[0], r[1], r[2], round(r[3], 9)) for r in got.collect()} == want


def test_aq_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], schema)
    assert [(r[0], r[1], r[2]) for r in op1_aq.search(two, two).orderBy("query_id").collect()] == [(1, 1, 2), (2, 1, 1)]
    assert op1_aq.search(two.limit(0), two.limit(0)).collect() == []


def test_aq_recall_on_embeddings(spark):
    rows = common.table(spark, SF, "embeddings")
    found = op1_aq.search(rows, rows.where("vec_id % 20 = 0"), shortlist=128).collect()
    own = [(r["vec_id"], r["embedding"]) for r in rows.collect()]
    want = exact(own, [x for x in own if x[0] % 20 == 0], 10)
    hits = len({(q, i) for q, _, i, _ in want} & {(r[0], r[2]) for r in found})
    assert hits >= 0.9 * len(want)


def test_aq_beam_and_least_squares_reduce_the_error():
    x = np.random.default_rng(1).normal(size=(600, 16))
    errors = []
    for beam, rounds in ((1, 0), (8, 0), (8, 2)):
        books = op1_aq.fit(x, 4, 16, beam, rounds)
        codes, norms = op1_aq.encode(x, books, beam)
        made = sum(books[m][codes[:, m]] for m in range(4))
        assert np.allclose(norms, (made**2).sum(1))
        errors.append(((x - made) ** 2).sum())
    assert errors[0] > errors[1] > errors[2]


# 2


def base_of(text):
    words = [w.decode() for w in (text or "").encode().split()]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    seen = collections.defaultdict(list)
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_base_figures(spark):
    texts = ODD + prose(40, 1) + ["a b c d e f " * 4 + "tail # 5% <b>", "l1 l1\nl1 l1\n \nl1 l1", "p q r s t u v w x y z " * 2]
    got = op2_quality.base(docs(spark, texts), "lang", "source").collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {r["doc_id"]: tuple(r[f] for f in fields) for r in got} == {i: base_of(t) for i, t in enumerate(texts)}


def test_quality_rejects_outliers_of_their_group_only(spark):
    clean = prose(600, 2, 200)
    junk = [" ".join(f"{w}%%%" for w in t.split()) for t in prose(60, 3, 200) if len(t.split()) > 20]
    found = op2_quality.verdicts(op2_quality.base(docs(spark, clean + junk), "lang", "source"))
    kept = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in found.collect()}
    assert all(k or b for i, (k, b) in kept.items() if i < len(clean))
    assert not any(k for i, (k, _) in kept.items() if i >= len(clean))


def test_quality_groups_on_either_side_of_the_least_size(spark):
    """Sources of 150 rows: one whose own habit is many symbols keeps its rows under its own estimate, not under its language's."""
    clean = prose(450, 8, 200)
    marked = [" ".join(f"{w}%" for w in t.split()) for t in prose(150, 9, 200)]
    rows = [(i, t, "en", "odd" if i >= len(clean) else f"s{i % 3}") for i, t in enumerate(clean + marked)]
    figures = common.checkpointed(op2_quality.base(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "lang", "source"))
    share = {}
    for least in (100, 200):
        found = op2_quality.verdicts(figures, least).where("source = 'odd' and not base_failed").collect()
        share[least] = sum(r["kept"] for r in found) / len(found)
    assert share[100] > 0.95
    assert share[200] < 0.05


def test_quality_empty_and_odd(spark):
    assert op2_quality.verdicts(op2_quality.base(docs(spark, ["x"]).limit(0), "lang", "source")).collect() == []
    assert op2_quality.verdicts(op2_quality.base(docs(spark, ODD), "lang", "source")).count() == len(ODD)


def test_quality_steps_find_the_majority(spark):
    """A fifth of far rows does not move the estimate: the concentration steps end on the clean majority."""
    rng = np.random.default_rng(3)
    texts = prose(400, 5, 150)
    texts += [" ".join("#" * int(rng.integers(3, 9)) + w for w in t.split()) for t in prose(95, 6, 150)]
    found = op2_quality.verdicts(op2_quality.base(docs(spark, texts), "lang", "source")).collect()
    far = [r["kept"] for r in found if r["doc_id"] >= 400 and not r["base_failed"]]
    near = [r["kept"] for r in found if r["doc_id"] < 400 and not r["base_failed"]]
    assert np.mean(near) > 0.99 and np.mean(far) < 0.05


# 3


def check_packing(rows, ids_of, capacity):
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for i, ids in ids_of.items():
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            own = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["piece"], r["start"], zlib.crc32(own)) == (k, at, r["ids_crc32"]) and (k == 0 or r["length"] == capacity)
            at += r["length"]
        assert at == len(ids)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_places_every_token_once(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = op3_packing.Ids(path, public_tokenizers.PATTERN)
    texts = ODD + prose(120, 4) + ["tail <|endoftext|> of text"] * 3
    frame = docs(spark, texts)
    rows = op3_packing.best_fit(frame, path, capacity=64).collect()
    ids_of = {i: [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    n = check_packing(rows, ids_of, 64)
    assert n <= 1.05 * -(-sum(map(len, ids_of.values())) // 64) + 1
    assert op3_packing.best_fit(frame.limit(0), path).collect() == []


def test_packing_engine_is_proven_equal_to_the_file():
    encoder = op3_packing.Ids(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    assert encoder.engine is not None
    for text in [t for t in ODD if t] + prose(60, 7):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    lengths = [rng.randint(1, 50) for _ in range(500)]
    places = op3_packing.plan(collections.Counter(lengths), 50)
    used = collections.Counter()
    for length, _, n, first, _ in places:
        for s in range(first, first + n):
            used[s] += length
    gaps = []
    for length in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= length]
        gaps.append((gaps.pop(gaps.index(min(fits))) if fits else 50) - length)
    assert max(used.values()) <= 50 and sum(used.values()) == sum(lengths) and len(used) <= len(gaps)


def test_packed_sequences_hold_their_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = common.checkpointed(op3_packing.best_fit(docs(spark, ["a b", "c", "d e f"]), path, capacity=8, ids=True))
    made = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in op3_packing.sequences(packed).collect()}
    for r in packed.collect():
        assert made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == np.frombuffer(r["ids"], "<u4").tolist()


# 4


def test_toxicity_learns_stems_and_never_reads_held_out_labels(spark):
    rng = random.Random(8)
    texts, marks = [], []
    for k, t in enumerate(prose(900, 9, 60)):
        words = t.split() + ["end"]
        toxic = k % 5 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["grobmul", "xyqzot"]) + rng.choice(["an", "ther", "ous", "ix"]))
        texts.append(" ".join(words))
        marks.append(int(toxic))
    frame = docs(spark, texts + ["", None])
    labels = table(spark, [(i, m, 0) for i, m in enumerate(marks)] + [(0, None, 0)], "doc_id long, toxic int, text int")
    got = {r["doc_id"]: r for r in op4_toxicity.score(frame, labels).collect()}
    held = [i for i in range(len(marks)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held)
    right = [got[i]["predicted"] == marks[i] for i in held]
    assert np.mean(right) > 0.97 and all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == len(texts) + 2
    wrong = table(spark, [(i, 1 - m if i in set(held) else m, 0) for i, m in enumerate(marks)], "doc_id long, toxic int, text int")
    again = {r["doc_id"]: r["score"] for r in op4_toxicity.score(frame, wrong).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-12 for i in got)


def test_toxicity_without_labels(spark):
    frame = docs(spark, ["a", None])
    none = table(spark, [(5, None)], "doc_id long, toxic int")
    assert [r["score"] for r in op4_toxicity.score(frame, none).collect()] == [0.0, 0.0]
    assert op4_toxicity.score(frame.limit(0), none).collect() == []


def test_kneser_ney_probabilities_sum_to_one():
    words = [w.encode() for t in prose(30, 3) for w in t.split()]
    keys, counts = np.unique(op4_toxicity.spell(words, 4)[0], return_counts=True)
    models = op4_toxicity.Models(keys, counts, counts * (np.arange(len(keys)) % 2), 4, 0.7)
    for context in np.unique(keys >> np.uint64(8))[:20]:
        every = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        lower = np.full(256, 1 / 256)
        for length, level in zip(range(1, 4), reversed(models.shared), strict=True):
            lower = level.smooth(every & np.uint64((1 << (8 * length)) - 1), lower)
        for level in models.own:
            assert abs(level.smooth(every, lower).sum() - 1) < 1e-9


# 5


def ctw_by_hand(texts, train, depth):
    """ln of each text's probability from explicit trees."""
    stream = lambda t: b" ".join((t or "").encode().lower().split()) + b"\n"
    counts = collections.defaultdict(lambda: [0, 0])
    steps = lambda s: ((bytes(reversed((bytes(depth) + s)[i : i + depth])), (1 << k) | (s[i] >> (8 - k)), (s[i] >> (7 - k)) & 1) for i in range(len(s)) for k in range(8))
    for t, use in zip(texts, train, strict=True):
        for context, node, bit in steps(stream(t)) if use else ():
            for d in range(depth + 1):
                counts[context[:d], node][bit] += 1
    children = collections.defaultdict(set)
    for context, node in counts:
        if context:
            children[context[:-1], node].add((context, node))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
    weighted = {}
    for key in sorted(counts, key=lambda x: -len(x[0])):
        own = kt(*counts[key])
        weighted[key] = own if len(key[0]) == depth else np.logaddexp(own, sum(weighted[c] for c in children[key])) - math.log(2)

    def probability(context, node, bit):
        out, left, last = 0.0, 1.0, 0.5
        for d in range(depth + 1):
            key = (context[:d], node)
            if key not in counts:
                break
            c = counts[key]
            last = (c[bit] + 0.5) / (sum(c) + 1)
            weight = 1.0 if d == depth else math.exp(kt(*c) - math.log(2) - weighted[key])
            out, left = out + left * weight * last, left * (1 - weight)
        return out + left * last

    return [sum(math.log(probability(*x)) for x in steps(stream(t))) for t in texts]


@pytest.mark.parametrize("depth", [2, 4])
def test_ctw_against_explicit_trees(spark, depth):
    texts = prose(25, 11, 30) + [None, "", "É x", "a\x00b", "A a A a", "x" * 100]
    got = {r["doc_id"]: r for r in op5_ctw.score(docs(spark, texts), depth=depth).collect()}
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    tokens = [[*(t or "").encode().lower().split(), b"\n"] for t in texts]
    counts = collections.Counter(w for ws, use in zip(tokens, train, strict=True) if use for w in ws)
    total = sum(counts.values())
    for i, ln in enumerate(ctw_by_hand(texts, train, depth)):
        r = got[i]
        assert r["score"] == pytest.approx(ln / math.log(10), rel=1e-5)
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens[i])
        assert r["base_score"] == pytest.approx(base) and r["held_out"] == (not train[i])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), total)


def test_ctw_empty(spark):
    assert op5_ctw.score(docs(spark, ["x"]).limit(0)).collect() == []


def test_ctw_lookup_and_packing():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 5000, np.uint64))
    values = np.arange(len(keys), dtype=np.uint32)
    assert (op5_ctw.Lookup(keys, values).get(keys[::-1]) == values[::-1]).all()
    with pytest.raises(ValueError):
        op5_ctw.Lookup(keys, values).get(np.array([keys[0] + np.uint64(1) if keys[0] + 1 != keys[1] else keys[-1] + np.uint64(1)]))
    back = op5_ctw._unpack(op5_ctw._pack(keys, values), np.uint32)
    assert (back[0] == keys).all() and (back[1] == values).all()


# 6


def test_bpe_is_tiktoken(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    bpe, _ = op6_bpe._worker(path)
    engine = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    texts = ODD + prose(60, 12) + ["it's we'll 12 3x  \n\n<|endoftext|>", "日本語 🙂", "".join(random.Random(1).choice("aeinst") for _ in range(1500))]
    got = {r["doc_id"]: r for r in op6_bpe.round_trip(docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = engine.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert op6_bpe.round_trip(docs(spark, ["x"]).limit(0), path).collect() == []


def test_bpe_long_words_contract_as_the_query_does():
    bpe, _ = op6_bpe._worker(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(3)
    for word in ["a" * 300, "ab" * 150, *["".join(rng.choice("aeinst") for _ in range(200)) for _ in range(5)]]:
        by_query = next(bpe.words([word.encode()]))[0]
        assert [bpe.ranks[x] for x in op6_bpe.contract_long(word.encode(), bpe.ranks)] == by_query


def test_bpe_cache_keeps_the_words_met_last(monkeypatch):
    monkeypatch.setattr(op6_bpe, "CACHED_WORDS", 3)
    cache = op6_bpe.Cache()
    for w in (b"a", b"b", b"c", b"d", b"e"):
        cache.put(w, (b"1", w))
    assert cache.get(b"e") == (b"1", b"e") and cache.get(b"a") == (b"1", b"a")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = list(op6_bpe.encode(["some words that come again", "again words"], path, regex.compile(public_tokenizers.PATTERN)))
    assert out[1][2] == b"again words"


# 7


def union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint_by_hand(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    texts = ODD + prose(80, 13, 300)
    texts += [t + " tail" for t in texts[-20:]] + texts[-5:]
    ids = [3 * i + 5 for i in range(len(texts))]
    got = {r["doc_id"]: r for r in op7_simhash.near_duplicates(docs(spark, texts, ids)).collect()}
    prints = [fingerprint_by_hand(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    for i, root in enumerate(union(len(texts), pairs)):
        assert got[ids[i]]["component_id"] == ids[root] and got[ids[i]]["fp"] % 2**64 == prints[i]
    assert op7_simhash.near_duplicates(docs(spark, ["x"]).limit(0)).collect() == []


@pytest.mark.parametrize("largest", [4096, 4, 1])
def test_simhash_links_are_complete_in_hot_keys_too(spark, largest):
    rng = np.random.default_rng(6)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 60)}
    for x in sorted(prints)[:25]:
        for _ in range(10):
            prints.add(x ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)))
    frame = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in prints], "fp long")
    got = {frozenset((r["a"] % 2**64, r["b"] % 2**64)) for r in op7_simhash.links(frame, 2, largest).collect()}
    own = sorted(prints)
    assert got == {frozenset((a, b)) for i, a in enumerate(own) for b in own[:i] if (a ^ b).bit_count() <= 2}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    pairs += [(7, 7)] + [(500, i) for i in range(501, 560)]
    frame = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(frame).collect()}
    roots = union(600, pairs)
    assert got == {i: roots[i] for i in {x for p in pairs for x in p}}
    assert components(frame.limit(0)).collect() == []


# 8


def removed_by_hand(texts, length):
    seen = collections.Counter()
    data = [(t or "").encode() for t in texts]
    for d in data:
        seen.update(d[i : i + length] for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(d)] > 0
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("length,largest", [(100, 4096), (90, 3)])
def test_suffix_dedup_removes_exactly_what_repeats(spark, length, largest):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    base, passage = text(700), text(130)
    texts = [*ODD, base, base, base[:400] + "X" + base[401:], "a" * 101, "ab" * 90, *[text(rng.randint(0, 150)) + passage + text(rng.randint(0, 150)) for _ in range(25)]]
    for _ in range(25):
        edited = list(base)
        for _ in range(rng.randint(1, 5)):
            edited[rng.randrange(700)] = "Z"
        texts.append("".join(edited))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in op8_suffix.dedup(docs(spark, texts), "doc_id", length=length, largest=largest).collect()}
    assert got == dict(enumerate(removed_by_hand(texts, length)))


def test_suffix_repeats_have_all_their_occurrences(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh") for _ in range(150))
    texts = [f"{k} {passage} {k * 7}" for k in range(30)]
    rows = docs(spark, texts).selectExpr("doc_id AS rid", "text")
    groups = collections.defaultdict(set)
    for r in op8_suffix.covered(rows, 100).collect():
        groups[r["group"]].add((r["rid"], r["start"]))
    assert max(len(g) for g in groups.values()) == 30


def test_suffix_query_counts_shorter_passages(spark, tmp_path):
    """A passage of over 50 words and under 400 bytes: it stays, as 400 bytes are the contract's, and is counted."""
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage, long = prose(52), prose(90)
    texts = [None, "", *[f"{prose(40)} {passage} {prose(40)}" for _ in range(6)], *[f"{prose(9)} {long} {prose(90)}" for _ in range(3)], *[prose(120) for _ in range(6)]]
    assert len(passage) < 400 < len(long)
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r)[1:] for r in op8_suffix.query(spark, str(tmp_path)).collect()}
    whole, short = removed_by_hand(texts, 400), removed_by_hand(texts, op8_suffix.PASSAGE)
    assert got == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest(), s[1]) for i, (w, s) in enumerate(zip(whole, short, strict=True))}
    assert [g[1] > 0 for g in got.values()].count(True) == 3
    assert {i for i, g in got.items() if g[4]} == set(range(2, 11))


def test_anchors_do_not_depend_on_what_else_is_hashed(monkeypatch):
    """Hashes that differ in their lowest bits alone: whole hashes decide, the leftmost of equal ones wins."""
    rng = np.random.default_rng(4)
    text = rng.integers(97, 123, 600, np.uint8).tobytes()
    own = {bytes(text[i : i + op8_suffix.GRAM]): int(rng.integers(0, 4)) for i in range(len(text) - op8_suffix.GRAM + 1)}
    monkeypatch.setattr(op8_suffix, "gram_hashes", lambda data: np.array([own.get(data[i : i + op8_suffix.GRAM], 7) for i in range(len(data) - op8_suffix.GRAM + 1)], np.uint64))
    length = 100
    window = length - op8_suffix.GRAM + 1
    hashes = [own[text[i : i + op8_suffix.GRAM]] for i in range(len(text) - op8_suffix.GRAM + 1)]
    want = [min(range(i, i + window), key=lambda j: (hashes[j], j)) for i in range(len(text) - length + 1)]
    for others in (0, 40):
        sizes = np.array([len(text), *[200] * others], np.int64)
        data = text + b"-" * (200 * others)
        t, lo, hi, p, _ = op8_suffix.anchors(data, np.cumsum(sizes) - sizes, sizes, length)
        got = [x for k, a, b, x in zip(t, lo, hi, p, strict=True) if k == 0 for _ in range(a, b + 1)]
        assert got == want


def test_suffix_whole_characters_and_empty(spark):
    texts = ["é" * 200 + "x", "y" + "é" * 200]
    rows = op8_suffix.dedup(docs(spark, texts), "doc_id", "lang", length=100, characters=True).collect()
    assert sorted(bytes(r["kept"]).decode() for r in rows) == ["x", "y"]
    assert op8_suffix.dedup(docs(spark, texts).limit(0), "doc_id").collect() == []


# 9


def test_sharding_law_and_slots(spark):
    texts = ODD + prose(2000, 14, 12)
    frame = docs(spark, texts).unionByName(docs(spark, ["null id"], [None]))
    rows = op9_sharding.assign(frame, op9_sharding.TREE).collect()
    by_shard = collections.defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
        t = "null id" if r["doc_id"] is None else texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((t or "").encode())
        assert r["grown_shard"] in (r["shard"], 40)
    assert set(by_shard) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    moved = sum(r["grown_shard"] == 40 for r in rows)
    assert 0.5 < moved / (len(rows) / 41) < 1.6
    few = op9_sharding.assign(frame.where("doc_id % 7 = 3"), op9_sharding.TREE).collect()
    shard = {r["doc_id"]: r["shard"] for r in rows}
    assert all(r["shard"] == shard[r["doc_id"]] for r in few)


def test_sharding_weights_ranges_and_growth(spark):
    tree = op9_sharding.Tree((((1.0, 3.0),), ((2.0,), (2.0,))))
    rows = spark.range(8000)
    found = op9_sharding.shard_of(rows, rows["id"], tree, "shard")
    share = {r["shard"]: r["count"] / 8000 for r in found.groupBy("shard").count().collect()}
    assert all(abs(share[i] - w / 8) < 0.02 for i, w in enumerate((1, 3, 2, 2)))
    grown = op9_sharding.shard_of(found, found["id"], tree.grow(2.0).grow(), "after")
    assert {r["after"] for r in grown.where("after <> shard").collect()} == {4, 5}
    slots = op9_sharding.with_slots(found, "shard", "id", 4, rows_per_group=100).collect()
    by = collections.defaultdict(list)
    for r in slots:
        by[r["shard"]].append((r["slot"], r["id"]))
    assert all([s for s, _ in sorted(v)] == list(range(len(v))) and [i for _, i in sorted(v)] == sorted(i for _, i in v) for v in by.values())
    assert op9_sharding.assign(docs(spark, ["x"]).limit(0), op9_sharding.TREE).collect() == []


# 10


def lines_by_hand(texts, similar):
    first = {}
    for row, t in enumerate(texts):
        for pos, line in enumerate((t or "").split("\n")):
            if line.encode().split():
                first.setdefault(line, (row, pos))
    lines = list(first)
    units = [x.encode("utf-16-be") for x in lines]
    sets = [{u[2 * i : 2 * i + 16] for i in range(max(1, len(u) // 2 - 7))} for u in units]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j])]
    best = {}
    for line, root in zip(lines, union(len(lines), pairs), strict=True):
        best[root] = min(best.get(root, (10**9, 0)), first[line])
    return set(best.values())


def test_line_dedup_keeps_one_line_of_each_component(spark):
    rng = random.Random(5)
    base = prose(60, 15, 60)
    texts = ["\n".join(base[i : i + 4]) for i in range(0, 60, 4)]
    for k in range(12):
        words = base[k].split()
        if len(words) > 12:
            words[rng.randrange(len(words))] = "zz"
        texts.append("\n".join([" ".join(words), "", "shared line of text", f"own {k} {prose(1, 90 + k)[0]}"]))
    texts += ["same\n\nsame\nsame", None, "", "  \n ", "tiny"]
    frame = common.checkpointed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    kept = op10_lines.dedup(frame)
    got = {(r["doc_id"], p) for r in kept.collect() for p in r["__kept"] or []}
    assert got == lines_by_hand(texts, 0.8)
    text = kept.select("doc_id", op10_lines.remaining(F.split("text", "\n"), kept["__kept"]).alias("t"))
    left = {r["doc_id"]: r["t"] for r in text.collect()}
    assert left[27] == "same\n" and left[28] is None and left[30] == "  \n "
    assert op10_lines.dedup(frame.limit(0)).collect() == []


def test_line_dedup_meets_near_copies_of_all_lengths(spark):
    """Near copies of 127 and 129 characters, and long lines of one short period, whose few shingles all count."""
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz "
    texts = []
    for _ in range(20):
        line = "".join(rng.choice(letters) for _ in range(127))
        texts += [line, line + "xy"]
    for k in range(20):
        period = "".join(rng.choice(letters) for _ in range(k % 3)) + "=h#~"[k % 4] + str(k)
        texts += [(period * 200)[:n] for n in (160, 300)]
    frame = common.checkpointed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    got = {(r["doc_id"], p) for r in op10_lines.dedup(frame).collect() for p in r["__kept"] or []}
    assert got == lines_by_hand(texts, 0.8) == {(i, 0) for i in range(0, len(texts), 2)}


def test_checkpoints_leave_no_shuffle_files(spark):
    """However often lineage is cut, what was shuffled on the way doesn't stay on disk."""
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        return {x for f in disk.localDirs() for _, _, names in os.walk(f.getPath()) for x in names if x.startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(name)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    for _ in range(3):
        rows = common.checkpointed(rows.groupBy("k").agg(F.sum("n").alias("n")).repartition("n"))
    rows = common.bucketed(common.written(rows.repartition("k")), "k")
    assert rows.agg(F.sum("n")).first()[0] == 1000 and spark.conf.get(name) == setting
    until = time.time() + 20
    while len(files() - before) > 12 and time.time() < until:
        time.sleep(0.2)
    # Those of the sum alone.
    assert len(files() - before) <= 12


def test_toxicity_counts_every_string_of_the_sample(spark, monkeypatch):
    """Two million distinct strings, nearly all of them rare: none is left out."""
    rng = np.random.default_rng(14)
    texts = [" ".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (900, 9)).view("<U9").ravel()) for _ in range(520)]
    labels = table(spark, [(i, i % 2) for i in range(len(texts))], "doc_id long, toxic int")
    sizes, own = [], op4_toxicity.Models.__init__
    monkeypatch.setattr(op4_toxicity.Models, "__init__", lambda self, strings, *rest: (sizes.append(len(strings)), own(self, strings, *rest))[1])
    frame = docs(spark, texts)
    op4_toxicity.score(frame, labels)
    chosen = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2]
    draws = {r["doc_id"]: r["d"] for r in frame.select("doc_id", F.pmod(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), F.lit(5)).alias("d")).collect()}
    words = [w.encode() for i in chosen if draws[i] for w in texts[i].split()]
    assert sizes == [len(np.unique(op4_toxicity.spell(words, 8)[0]))] and sizes[0] > 1_500_000


def test_oracle_sql_is_sql():
    import duckdb

    from quern.llm import registry

    found = registry.oracle_sql()
    assert set(found) == {"op1_aq", "op2_quality", "op9_sharding"}
    assert all(isinstance(x, str) and len(duckdb.extract_statements(x)) == 1 for x in found.values())


def test_toxicity_weighs_all_words_with_both_signs():
    """Evidence of under `floor` nats a word counts, for either class."""
    keys, at = np.unique(op4_toxicity.spell([b"alpha", b"beta", b"gamma", b"delta"], 8)[0], return_inverse=True)
    toxic = np.bincount(at, np.repeat([6, 2, 2, 1], [6, 5, 6, 6]), len(keys)).astype(np.int64)
    ordinary = np.bincount(at, np.repeat([2, 6, 2, 3], [6, 5, 6, 6]), len(keys)).astype(np.int64)
    scorer = op4_toxicity.Scorer(op4_toxicity.Models(keys, toxic, ordinary, 8, 0.5), 3.0)
    for_toxic, for_ordinary = scorer.texts(["alpha " * 20, "beta " * 20])
    assert for_toxic[0] > 0 > for_ordinary[0]
    assert for_toxic[1] == for_ordinary[1] == 0


def test_quality_rejects_repeated_lines_alone(spark):
    """Every statistic can reject by itself; a menu of repeated short lines goes, clean texts stay."""
    for name, most in (("lines", math.log(101)), ("repeats", math.log(1.2))):
        assert (most / op2_quality.FLOORS[name]) ** 2 > op2_quality.REJECT
    clean = [t for t in prose(600, 2, 200) if len(t.split()) >= 20]
    menu = "\n".join(f"{w}{k}\nthering" for k, w in enumerate(clean[0].split() + clean[1].split() + clean[2].split()))
    found = op2_quality.verdicts(op2_quality.base(docs(spark, [*clean, menu]), "lang", "source")).collect()
    kept = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in found}
    assert kept.pop(len(clean)) == (False, False) and all(k or b for k, b in kept.values())


def test_ctw_uses_seven_bytes_by_default(spark):
    texts = prose(12, 11, 20)
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    got = {r["doc_id"]: r["score"] * math.log(10) for r in op5_ctw.score(docs(spark, texts)).collect()}
    seven, six = ctw_by_hand(texts, train, 7), ctw_by_hand(texts, train, 6)
    found = [got[i] for i in range(len(texts))]
    assert found == pytest.approx(seven, rel=1e-5) and found != pytest.approx(six, rel=1e-5)


def test_repeated_vectors_and_ids(spark):
    """Rows of one id and vector count once, so they can't crowd out other ids; ids may have several vectors."""
    rows = [(100, [1.0, 0.0])] * 12 + [(200, [1.0, 0.0]), (200, [1.0, 0.0]), (300, [2.0, 1.0]), (100, None), (400, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = op1_aq.search(frame, frame.where("vec_id = 100"), words=2, codebooks=2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in found) == [(100, 1, 200, 0.0), (100, 2, 300, 1.414214)]
    again = frame.union(spark.createDataFrame([(200, [5.0, 5.0])], frame.schema))
    found = op1_aq.search(again, frame.where("vec_id = 300"), words=2, codebooks=2).collect()
    assert sorted((r["vec_id"], round(r["score"], 4)) for r in found) == [(100, 1.4142), (200, 1.4142), (200, 5.0)]


def test_recall_of_short_lists(spark):
    """At least 0.9 of the exact neighbours among 2000 vectors, with 128 reranked a query."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    found = op1_aq.search(rows, rows.where("vec_id % 100 = 0"), shortlist=128).collect()
    ids, all_x = np.array(list(x)), np.array(list(x.values()))
    met = total = 0
    for q in (i for i in x if i % 100 == 0):
        far = np.sqrt(((all_x - x[q]) ** 2).sum(1))
        near = [ids[i] for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        met += len(set(near) & {r["vec_id"] for r in found if r["query_id"] == q})
        total += 10
    assert met >= 0.9 * total


@pytest.mark.parametrize("kind", ["scales", "ties", "huge"])
def test_aq_is_exact_whatever_the_codebooks_fit(spark, kind):
    """Vectors that the codes can't tell apart: beside far longer ones, at equal distances, or beyond what squares hold."""
    x = np.random.default_rng(3).normal(size=(3000, 16))
    if kind == "ties":
        x = np.sign(x) * (1 + np.arange(3000) % 2)[:, None]
    else:
        x[::30] *= 1e7 if kind == "scales" else 1e200
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    frame = table(spark, [(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, id long")
    got = op1_aq.search(frame, frame.where("vec_id % 100 = 1"), codebooks=4, words=16).collect()
    want = set()
    for q in range(1, 3000, 100):
        far = np.sqrt(np.cumsum((x - x[q]) ** 2, axis=1)[:, -1])
        near = [i for i in np.lexsort((np.arange(3000), far)) if i != q][:10]
        want |= {(q, r + 1, int(i), float(far[i])) for r, i in enumerate(near)}
    assert len(got) == 300 and {tuple(r) for r in got} == want


def test_checkpoints_need_a_shared_folder_off_local_mode(spark):
    class Found:
        def __init__(self, **names):
            self.__dict__.update(names)

    jsc = Found(sc=lambda: Found(getCheckpointDir=lambda: Found(isEmpty=lambda: True)))
    context = Found(_jsc=jsc, master="spark://one:7077", getConf=lambda: {})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.checkpoint_folder(Found(sparkContext=context))


def test_ctw_raises_an_error_if_a_block_changed():
    texts = pa.table({"doc_id": [1], "held_out": [False], "text": ["some words"]})
    run = op5_ctw._score(3, 4, 3, 3)
    answers = {"bucket": [], "sum": [], "data": []}
    for kind in (op5_ctw.WORDS, op5_ctw.STRINGS):
        keys = op5_ctw._own_keys(["some words"], kind, 3)
        for bucket, some in op5_ctw._dealt(keys, kind, 3, 4):
            answers["bucket"].append(bucket)
            answers["sum"].append(common.crc32(keys[some].tobytes()))
            answers["data"].append(op5_ctw._compressed(op5_ctw._planes(np.ones(len(some), np.uint32 if kind == op5_ctw.WORDS else np.float32))))
    assert run(texts, pa.table(answers)).column("n_known").to_pylist() == [3]
    for other in ("some word", "", None, "other words and some"):
        with pytest.raises(ValueError):
            run(texts.set_column(2, "text", pa.array([other], pa.string())), pa.table(answers))
