"""Shards, the Jaccard join, conversations, the language model and the pipeline."""

from __future__ import annotations

import base64
import heapq
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
import public_tokenizers
import tiktoken
from dataproof.llm import chat_repair, divergence, jaccard_join, quality_knn, sharding, suffix_tree
from dataproof.llm.common import discard, scratch_dir, settle
from test_filters import contamination_of, plain_references, plain_verdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def linked_components(ids, texts, percent):
    sets = [shingles(text) for text in texts]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i in range(len(sets)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted(((ids[i], len(sets[i]), least.get(find(i))) for i in range(len(sets))), key=repr)


def found_components(df, percent=90):
    return sorted((tuple(r) for r in jaccard_join.near_duplicates(df, percent).collect()), key=repr)


def test_join_matches_brute_force(documents):
    rows = documents.collect()
    assert found_components(documents) == linked_components([r.doc_id for r in rows], [r.text for r in rows], 90)


@pytest.mark.parametrize("percent", [90, 80])
def test_hard_neighbours(spark, percent):
    """Chains of near copies, common passages, tiny vocabularies, and sets that differ in one shingle."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts, base = [], [rng.choice(vocabulary) for _ in range(120)]
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
        base = copy if i % 10 == 0 else base
    passage = [rng.choice(vocabulary) for _ in range(70)]
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(3, 20))]) for _ in range(60)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(60)]
    for i in range(60):
        words = [f"v{k}" for k in range(rng.randint(9, 24) + 2)]
        texts.append(" ".join(words + ([f"z{i}"] if rng.random() < 0.7 else [])))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found_components(df, percent) == linked_components(list(range(len(texts))), texts, percent)


@pytest.mark.parametrize("percent", [50, 70, 75, 80, 90, 95])
def test_regions_hold_all_linked_pairs(percent):
    """Any two linked sets share a region, whatever their sizes."""
    rng = np.random.default_rng(5)
    bounds = jaccard_join.ring_bounds(percent)
    for size in [9, 10, 11, 17, 18, 19, 20, 30, 57, 99, 150, 400]:
        if size < bounds[0]:
            continue
        for _ in range(20):
            full = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            drop = size * (100 - percent) // 100
            rng.shuffle(full)
            cut = int(rng.integers(0, drop + 1))
            left = np.sort(full[: size - cut])
            right = np.sort(full[int(rng.integers(0, drop - cut + 1)) :])
            both = len(np.intersect1d(left, right))
            assert 100 * both >= percent * len(np.union1d(left, right))
            keys = [set(jaccard_join.region_keys(x, percent, bounds).tolist()) for x in (left, right)]
            assert keys[0] & keys[1]


@pytest.mark.parametrize(("percent", "most"), [(80, 0.7), (90, 0.35)])
def test_unrelated_texts_share_no_region(percent, most):
    rng = np.random.default_rng(6)
    bounds = jaccard_join.ring_bounds(percent)
    seen = Counter()
    for size in [40, 300, 1000] * 100:
        keys = set(jaccard_join.region_keys(rng.integers(0, 2**63, size, dtype=np.uint64), percent, bounds).tolist())
        assert len(keys) <= most * size
        seen.update(keys)
    assert max(seen.values()) == 1


def test_join_of_odd_rows(odd_documents):
    rows = odd_documents.collect()
    assert found_components(odd_documents) == linked_components([r.doc_id for r in rows], [r.text for r in rows], 90)
    assert jaccard_join.near_duplicates(odd_documents.where("false")).count() == 0


def test_texts_are_cut_twice_at_most(monkeypatch, odd_documents):
    """One pass gives the signatures and the regions of all texts, another the sets of those that share a region."""
    passes, kept, whole = [], [], type(odd_documents).mapInArrow
    monkeypatch.setattr(type(odd_documents), "mapInArrow", lambda self, *args, **named: passes.append(args[1]) or whole(self, *args, **named))
    monkeypatch.setattr(jaccard_join, "discard", lambda table: kept.append(table))
    assert jaccard_join.near_duplicates(odd_documents).count() == 12
    assert len(passes) == 2
    # Regions of a set that a task has met are not written again; sets of few shingles have none.
    bounds, expected = jaccard_join.ring_bounds(90), {}
    for r in odd_documents.collect():
        found = jaccard_join.shingle_set(r.text or "", jaccard_join.Words64())
        expected[jaccard_join.set_number(found)] = jaccard_join.region_keys(found, 90, bounds).astype(np.int64).tolist()
    written = [r for table in kept for r in table.collect()]
    assert len(written) == 12 and all(r["keys"] in ([], expected[r.h1, r.h2]) for r in written)
    assert {(r.h1, r.h2) for r in written if r["keys"]} == {name for name, keys in expected.items() if keys}


def test_one_of_each_group_stays(odd_documents):
    kept = jaccard_join.keep_one(odd_documents.withColumnRenamed("score", "mark"))
    assert kept.columns == ["doc_id", "text", "lang", "mark"]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 5, None, None, 7, 8, 9], key=repr)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400)], "a long, b long")
    labels = {r.node: r.label for r in jaccard_join.components(edges).collect()}
    assert set(labels.values()) == {0, 400} and len(labels) == 203


@pytest.mark.parametrize("sizes", [{}, {"bucket_groups": 40, "fan": 3, "slot_rows": 2}])
def test_shards(documents, sizes):
    rows = sharding.shard(documents, **sizes).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    shard_of, bytes_of, slots = {}, Counter(), {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        assert shard_of.setdefault(raw, r.shard) == r.shard
        bytes_of[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(texts) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    if not sizes:
        assert max(bytes_of.values()) <= 1.05 * sum(bytes_of.values()) / 24


def test_differencing():
    """Sums are kept, and an even split of many sizes is near perfect."""
    rng = np.random.default_rng(1)
    vectors = np.zeros((2000, 24), dtype=np.int64)
    vectors[:, 0] = rng.integers(1, 10_000, 2000)
    place = sharding.difference(vectors)
    assert all(sorted(row) == list(range(24)) for row in place)
    sums = np.zeros(24, dtype=np.int64)
    np.add.at(sums, place.ravel(), vectors.ravel())
    assert sums.sum() == vectors.sum() and sums.max() - sums.min() <= 10
    assert sharding.difference(np.array([[5, 0], [4, 0], [3, 0]]))[:, 0].tolist() in ([0, 1, 1], [1, 0, 0])


def test_shards_of_odd_rows(odd_documents):
    rows = sharding.shard(odd_documents).collect()
    assert len(rows) == 12 and len({r.shard for r in rows if r.size == 8}) == 1
    assert sharding.shard(odd_documents.where("false")).count() == 0


def cheapest(roles, costs=chat_repair.Costs()):
    queue, best = [(0, 0, 0)], set()
    while queue:
        price, i, state = heapq.heappop(queue)
        if (i, state) in best:
            continue
        best.add((i, state))
        if i == len(roles) and state == 3:
            return price
        for after in chat_repair.FOLLOWS[state]:
            heapq.heappush(queue, (price + costs.insert, i, after))
            if i < len(roles):
                heapq.heappush(queue, (price + costs.relabel * (after != roles[i]), i + 1, after))
        if i < len(roles) and state:
            heapq.heappush(queue, (price + costs.merge + costs.relabel * (state != roles[i]), i + 1, state))


def test_repairs_are_cheapest_and_legal(spark):
    rng = random.Random(5)
    names = {0: "tool", 1: "System", 2: " user", 3: "assistant"}
    rows, expected = [], {}
    for key, size in [(k, rng.randint(1, 9)) for k in range(150)] + [(1000, 2500)]:
        roles = [rng.randint(0, 3) for _ in range(size)]
        expected[key] = cheapest(roles)
        rows += [(key, i, names[x], f"t{i}") for i, x in enumerate(roles)]
    rng.shuffle(rows)
    found = chat_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    turns = {}
    for r in found:
        turns.setdefault(r.conv_id, []).append(r)
    assert len(found) == len(rows)
    for key, own in turns.items():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == [r.turn for r in own] == list(range(len(own)))
        state, price = 0, sum(4 * len(r.inserted_before + r.inserted_after) for r in own)
        for name in re.findall(r"<\|(\w+)\|>\n", "".join(r.rendered for r in own)):
            if name != "end":
                after = chat_repair.ROLES.index(name) + 1
                assert after in chat_repair.FOLLOWS[state]
                state = after
        price += sum(3 * ("relabel" in r.action) + 2 * ("merge" in r.action) for r in own)
        assert state == 3 and price == expected[key] == own[0].cost


def test_repair_of_odd_rows(spark):
    rows = [(1, 1, "user", "a", "x"), (1, 1, "user", "a", "x"), (None, None, None, None, None), (None, 2, "USER", None, "y"), (2, 1, "", "b", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string")
    found = chat_repair.repair(table).collect()
    assert len(found) == 5 and all(r.new_role in chat_repair.ROLES for r in found)
    assert chat_repair.repair(table.where("false")).count() == 0
    same = [(7, 1, "user", "x")] * 300
    one = chat_repair.repair(spark.createDataFrame(same, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r.position for r in one) == list(range(300)) and len({r.cost for r in one}) == 1


def model_words(text):
    return WORD.findall((text or "").translate(LOWER)) + ["\n"]


def held(doc_id):
    return zlib.crc32((str(doc_id) if doc_id is not None else "").encode()) % 7 == 2


@pytest.mark.parametrize("which", ["documents", "odd_documents"])
def test_base_scores_match_brute_force(which, request, monkeypatch):
    monkeypatch.setattr(suffix_tree, "FREQUENT", 64)
    table = request.getfixturevalue(which)
    rows = [(r.doc_id, model_words(r.text)) for r in table.collect()]
    counts = Counter(w for doc_id, words in rows if not held(doc_id) for w in words)
    total, distinct = sum(counts.values()), len(counts)
    expected = sorted(
        (len(words), sum(counts[w] > 0 for w in words), round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words), 6))
        for _, words in rows
    )
    found = suffix_tree.corpus_scores(table).collect()
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == expected
    assert {r.train_tokens for r in found} == {total}
    assert all(r.held_out == held(r.doc_id) and r.score < 0 and math.isfinite(r.score) for r in found)


def test_model_is_a_distribution(spark):
    """The probabilities of all next bytes add up to one in every state, and known text is likelier than noise."""
    rows = spark.createDataFrame([(i, "the cat sat on the mat and the dog sat on the log") for i in range(50)], "doc_id long, text string")
    counts = suffix_tree.corpus_counts(rows, np.zeros(0, dtype=np.uint64))
    tree = suffix_tree.fit(counts.where("kind = 0").selectExpr("key AS code", "n"))
    unseen = 256 - len(set(tree.columns.tolist())) + 1
    sums = np.exp(tree.states[:, :-1]).sum(axis=1) + unseen * np.exp(tree.states[:, -1])
    assert np.allclose(sums, 1, atol=1e-4) and len(tree.states) > 20
    logs = suffix_tree.spellings([[b"the", b"cat"], [b"tac", b"eht"], []], tree)
    assert len(logs) == 5 and logs[0] + logs[1] > logs[2] + logs[3]


def test_longest_kept_suffix_is_used(spark):
    rows = spark.createDataFrame([(1, "ab ab ab abc")] * 20, "doc_id long, text string")
    counts = suffix_tree.corpus_counts(rows, np.zeros(0, dtype=np.uint64))
    tree = suffix_tree.fit(counts.where("kind = 0").selectExpr("key AS code", "n"))
    text, state = b"ab abc\n", b"\n" * suffix_tree.DEPTH
    expected = 0.0
    for byte in text:
        for d in range(suffix_tree.DEPTH, -1, -1):
            key = int.from_bytes(state[len(state) - d :], "big") if d else 0
            number = int(tree.contexts[d](np.array([key], dtype=np.uint64))[0])
            if number >= 0:
                break
        expected += float(tree.states[number, tree.columns[byte]])
        state = state[1:] + bytes([byte])
    assert suffix_tree.spellings([[b"ab", b"abc"]], tree).sum() == pytest.approx(expected, abs=1e-4)


def plain_phrase_scores(texts, train_texts):
    """``texts`` are (own, phrases, logs of the spellings). The tree as dictionaries, and every score from it."""
    depth = suffix_tree.PHRASES
    counts = [Counter() for _ in range(depth + 1)]

    def context(phrases, i, size):
        """The phrases before phrase ``i``, the start of the text among them; None where it has not so many."""
        before = (None, *phrases[:i])
        return tuple(before[len(before) - size :]) if size <= len(before) else "none"

    for own, phrases, _ in texts:
        if own:
            for i, phrase in enumerate(phrases):
                for size in range(depth + 1):
                    if (before := context(phrases, i, size)) != "none":
                        counts[size][before, phrase] += 1
    met = [Counter() for _ in range(depth + 1)]
    for size in range(depth + 1):
        for (before, _), n in counts[size].items():
            met[size][before] += n
    # A phrase is kept in a state if it has been met there, and in the states of the suffixes, twice or more.
    kept = [{key: n for key, n in counts[size].items() if n > 1} for size in range(depth + 1)]
    spelt = {phrase: log for _, phrases, logs in texts for phrase, log in zip(phrases, logs)}
    states = [{} for _ in range(depth + 1)]

    def probability(before, phrase, size):
        below = spelt[phrase] if size == 0 else probability(before[1:], phrase, size - 1)
        if before not in states[size]:
            return below
        total, novel = met[size][before], met[size][before] - states[size][before] + 1
        return math.log((kept[size].get((before, phrase), 0) + novel * math.exp(below)) / (total + 1))

    states[0][()] = sum(kept[0].values())
    for size in range(1, depth + 1):
        sums = Counter()
        for (before, _), n in kept[size].items():
            sums[before] += n
        for before, own in sums.items():
            states[size][before] = own
            gain = sum(
                n * (probability(before, phrase, size) - probability(before[1:], phrase, size - 1))
                for (b, phrase), n in kept[size].items()
                if b == before
            )
            if gain < suffix_tree.LEAST_GAIN:
                del states[size][before]
    out = []
    for _, phrases, _ in texts:
        total = 0.0
        for i, phrase in enumerate(phrases):
            size = max(k for k in range(depth + 1) if (c := context(phrases, i, k)) != "none" and all(c[j:] in states[k - j] for j in range(k)))
            total += probability(context(phrases, i, size), phrase, size)
        out.append(total)
    return out, sum(map(len, states[1:]))


def phrase_rows(spark, texts):
    number = lambda phrase: int(np.uint64(phrase * 0x9E3779B97F4A7C15 % 2**64).astype(np.int64))
    rows = []
    for row, (own, phrases, logs) in enumerate(texts):
        # A part of the spelling comes later, as with rare words.
        ats = [i for i in range(len(phrases)) if i % 3 == 0] if row % 2 else None
        later = [-1.0] * len(ats) if ats is not None else None
        known = [log + (1.0 if ats is not None and i % 3 == 0 else 0.0) for i, log in enumerate(logs)]
        rows.append((row, not own, [number(p) for p in phrases], known, ats, later))
    schema = "row long, held_out boolean, phrases array<long>, logs array<float>, ats array<int>, later array<float>"
    return spark.createDataFrame(rows, schema)


def random_phrases(rng, texts, passages):
    out = []
    for i in range(texts):
        phrases = []
        for _ in range(rng.randrange(1, 5)):
            phrases += rng.choice(passages) if rng.random() < 0.5 else [rng.randrange(10**6) for _ in range(rng.randrange(1, 4))]
        phrases[-1] += 10**6  # the last phrase of a text has a mark
        out.append((i % 7 != 2, phrases, [-5.0 - phrase % 11 for phrase in phrases]))
    return out


def test_phrase_scores_match_brute_force(spark):
    rng = random.Random(5)
    passages = [[rng.randrange(10**6) for _ in range(rng.randrange(1, 6))] for _ in range(8)]
    texts = random_phrases(rng, 120, passages) + [(True, [*passages[0], 7], [-5.0 - p % 11 for p in [*passages[0], 7]])] * 3
    expected, contexts = plain_phrase_scores(texts, sum(own for own, _, _ in texts))
    found = {r.row: r.log_score for r in suffix_tree.phrase_scores(phrase_rows(spark, texts).repartition(3), sum(own for own, _, _ in texts)).collect()}
    assert [found[i] for i in range(len(texts))] == pytest.approx(expected, abs=1e-4) and contexts > 10


def test_contexts_grow_with_the_corpus():
    """Twice the passages that repeat are twice the kept contexts: no share of the corpus has to be reached."""
    rng = random.Random(6)
    kept = []
    for size in (50, 100, 200):
        passages = [[rng.randrange(10**6) for _ in range(4)] for _ in range(size)]
        kept.append(plain_phrase_scores(random_phrases(rng, 20 * size, passages), 20 * size)[1])
    assert kept[1] > 1.7 * kept[0] and kept[2] > 1.7 * kept[1]


def test_phrases_are_cut_alike():
    """A passage has the same phrases wherever it stands, but for those at its ends."""
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 2**63, 60, dtype=np.uint64)
    texts = [np.concatenate([rng.integers(0, 2**63, n, dtype=np.uint64), passage, rng.integers(0, 2**63, 9, dtype=np.uint64)]) for n in (0, 5, 17)]
    numbers, firsts, phrase_of = suffix_tree.phrases_of(np.concatenate(texts), np.array([len(x) for x in texts]))
    inside = int((passage % suffix_tree.ANCHOR == 0).sum()) - 1
    starts = np.cumsum([0, *map(len, texts)])
    sets = [set(numbers[np.unique(phrase_of[a:b])].tolist()) for a, b in zip(starts, starts[1:])]
    assert len(sets[0] & sets[1] & sets[2]) >= inside > 0
    assert len(firsts) == len(numbers) == phrase_of[-1] + 1


def test_texts_that_occur_twice_are_told_apart(spark, documents):
    """Learnt texts that training has twice are far likelier a token than those it has once."""
    found = {r.doc_id: r.score / r.n_tokens for r in suffix_tree.corpus_scores(documents).collect() if not r.held_out and r.n_tokens > 30}
    copies = Counter(r.text for r in documents.collect() if r.doc_id in found)
    texts = {r.doc_id: r.text for r in documents.collect()}
    twice = [x for i, x in found.items() if copies[texts[i]] > 1]
    once = sorted(x for i, x in found.items() if copies[texts[i]] == 1)
    assert len(twice) > 5 and np.median(twice) > once[int(0.95 * len(once))]


def test_scores_without_training(spark, odd_documents):
    found = suffix_tree.scores(odd_documents, odd_documents["doc_id"] < 0).collect()
    assert len(found) == 12 and all(r.held_out and r.n_known == 0 and math.isfinite(r.score) for r in found)
    assert suffix_tree.corpus_scores(odd_documents.where("false")).count() == 0


def test_pipeline(spark, sf_dir, documents):
    columns, docs = documents.columns, documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == columns and 0 < kept.count() <= docs.count()
        docs = kept
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert out.where("NOT restored").count() == 0 and out.count() == docs.count()


def planted(documents, items):
    """The documents with copies, near copies, junk and benchmark passages among them."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in documents.collect()]
    rng = random.Random(12)
    clean = [r for r in rows if r[1] and 80 < len(r[1].split()) < 400 and r[2] == "en"]
    passages = [text for _, text in items if text and len(text.split()) >= 13]
    number = 10**6
    for _, text, lang, source, _ in rng.sample(clean, 12):
        words = text.split()
        near = list(words)
        for place in rng.sample(range(len(near)), len(near) // 60):
            near[place] = "changed"
        for other in (text, " ".join(words).upper(), " ".join(near), " ".join(words[:40] + [rng.choice(passages)] + words[40:])):
            rows.append((number, other, lang, source, len(other)))
            number += 1
    for junk in ("@~^ {}[] " * 90, "lorem " * 300, " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(120)), "", None, "few words"):
        rows.append((number, junk, "en", "src1", 0))
        number += 1
    return rows


def test_stages_match_brute_force(spark, sf_dir, documents):
    """The ids that each stage keeps, each on what the stage before has kept, against plain versions."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = spark.createDataFrame(planted(documents, items), documents.schema)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = settle(stage(spark, docs, sf_dir), "stage")
        found = sorted(r.doc_id for r in docs.collect())
        kept[name] = len(before) - len(found)
        if name == "quality classifier":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
            texts = spark.createDataFrame(before, documents.schema).select("doc_id", "text")
            model = quality_knn.fit(texts, labels.where(~quality_knn.held_out(labels)))
            terms = quality_knn.Terms()
            votes = {r.doc_id: quality_knn.vote(quality_knn.term_counts([r.text or ""], terms), model)[0] for r in before}
            # A vote next to one half may fall either way with the order of a sum.
            sure = {i for i, vote in votes.items() if abs(vote - 0.5) > 1e-4}
            assert set(found) & sure == {i for i in sure if votes[i] >= 0.5}
        elif name == "quality rules":
            references = plain_references(before, divergence.Limits())
            assert found == sorted(r.doc_id for r in before if plain_verdict(r, references, divergence.Limits())[-1])
        elif name == "n-gram Jaccard join":
            assert found == one_of_each(before)
        else:
            verdict = {r.doc_id: contamination_of([r.text], items)[0][-1] for r in before}
            assert found == sorted(i for i, bad in verdict.items() if not bad)
    assert all(number > 0 for number in kept.values()), kept
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect():
        assert r.restored and list(r.ids) == library.encode_ordinary(texts.pop(r.doc_id))
    assert not texts


def one_of_each(rows, width=5, percent=80):
    """The least id of each group of texts that are linked by word shingles, and all texts without words."""

    def cut(text):
        words = WORD.findall((text or "").translate(LOWER))
        size = min(width, len(words))
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()

    rows = sorted(rows, key=lambda r: r.doc_id)
    sets, up = [cut(r.text) for r in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return sorted(r.doc_id for i, r in enumerate(rows) if find(i) == i)


def test_verdicts_are_not_repeated_in_a_filter(spark, sf_dir, documents):
    """The optimizer must not copy the whole verdict into a filter pushed below it."""
    plan = corpus_pipeline.rules_stage(spark, documents, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2


def test_near_copies_go_in_the_pipeline(spark, sf_dir):
    """A copy with four scattered changed words is below 90 % at three words and above 80 % at five."""
    base = [f"w{i}" for i in range(200)]
    copy = [f"x{i}" if i in (30, 80, 130, 180) else word for i, word in enumerate(base)]
    other = [f"x{i}" if i % 9 == 0 else word for i, word in enumerate(base)]
    rows = [(i, " ".join(words), "en") for i, words in enumerate([base, copy, other])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len({x for _, _, x in found_components(docs)}) == 3
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()) == [0, 2]


def test_stages_take_odd_rows(spark, sf_dir, odd_documents):
    docs = odd_documents.selectExpr("*", "1 AS kept", "'x' AS mark", "2 AS n_words")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 12


def test_no_linked_pair_is_lost_between_sketches():
    """Sketches are never farther apart than the sets, and the windows leave out no pair that a bound allows."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = []
    for _ in range(80):
        keep = rng.random(300) > rng.choice([0.01, 0.05, 0.2])
        sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**63, int(rng.integers(0, 20)), dtype=np.uint64)])))
    sketches = np.stack([np.frombuffer(jaccard_join.sketch(x), dtype=np.uint16) for x in sets]).astype(np.int32)
    sizes, labels = np.array([len(x) for x in sets]), np.arange(80) // 2
    found = {(min(a, int(b)), max(a, int(b))) for a, others in jaccard_join.near_pairs(sizes, np.zeros(80), labels, sketches, 90) for b in others}
    linked = 0
    for i in range(80):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            apart = sizes[i] + sizes[j] - 2 * both
            assert np.abs(sketches[i] - sketches[j]).sum() <= apart
            if labels[i] != labels[j] and 100 * both >= 90 * (sizes[i] + sizes[j] - both):
                linked += 1
                assert (j, i) in found
    assert linked > 20


@pytest.mark.parametrize("chunk", [1024, 7])
def test_cells_are_joined_in_chunks(spark, chunk, monkeypatch):
    """Many texts at about the same distance from each other, some of them linked, whatever the size of a chunk."""
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(60):
        words = list(base)
        for place in rng.sample(range(60), 4):
            words[place] = f"x{rng.randrange(6)}"
        texts.append(" ".join(words))
        if i % 9 == 0:
            texts.append(" ".join(words[:-1]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found_components(df) == linked_components(list(range(len(texts))), texts, 90)


def test_a_cell_gives_fewer_links_than_members(spark, monkeypatch):
    """A hundred sets at one shingle from each other, in several regions with the same members, and a far one."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 40)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 80, dtype=np.uint64)
    sets = [np.unique(np.append(base, np.uint64(i))) for i in range(100)] + [rng.integers(0, 2**63, 81, dtype=np.uint64)]
    rows = [(i, len(x), x.astype(np.int64).tolist(), bytearray(jaccard_join.sketch(x))) for i, x in enumerate(sets)]
    sets = spark.createDataFrame(rows, "node long, n int, shingles array<long>, sketch binary")
    cells = spark.createDataFrame([(key, i, 9.0, i) for key in range(5) for i in range(101)], "key long, node long, slack double, label long")
    assert jaccard_join._unlike(cells).count() == 101
    links = [tuple(x) for x in jaccard_join._links_left(jaccard_join._unlike(cells), sets, 90).collect()]
    # Three chunks: six blocks, none of which gives as many links as it has members.
    assert len(links) < 3 * 101
    found = {r.node: r.label for r in jaccard_join.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(100)}


def test_sets_are_filtered_without_a_shuffle(spark):
    sets = spark.range(-3000, 3000).selectExpr("id as node", "array(id) as shingles")
    some = spark.createDataFrame([(x,) for x in (-3000, -1, 0, 7, 7, 2999)], "node long")
    found = jaccard_join._only(sets, some)
    nodes = [x.node for x in found.collect()]
    assert found.columns == sets.columns and {-3000, -1, 0, 7, 2999} <= set(nodes) and len(nodes) == len(set(nodes)) < 20
    assert jaccard_join._only(sets, some.where("false")).count() == 0


def test_rare_regions_are_the_first_shingles_by_count(spark):
    rng = random.Random(5)
    sets = {i: sorted({rng.randrange(40) ** 2 for _ in range(rng.randrange(5, 30))} | {1000 + i, 2000 + i}) for i in range(30)}
    frame = spark.createDataFrame([(i, len(x), x) for i, x in sets.items()], "node long, n int, shingles array<long>")
    counts = Counter(x for found in sets.values() for x in found)
    expected = {}
    for node, found in sets.items():
        order = sorted(found, key=lambda x: (counts[x], x))[: len(found) - -(-80 * len(found) // 100) + 1]
        slack = len(found) * 20 / 180 - sum(counts[x] == 1 for x in found) + 1e-6
        expected |= {(x, node): pytest.approx(slack) for x in order if counts[x] > 1}
    got = jaccard_join._rare_regions(frame.select("node"), frame, 80)
    # Rows of one key are counted where they meet: sets are dealt out twice, by key and by node.
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(key") <= 1
    assert {(x.key, x.node): x.slack for x in got.collect()} == expected


def test_superseded_tables_go(spark):
    """Of the tables that phrase scores write, those whose rows a later one has are deleted; other files are not."""
    rng = random.Random(4)
    texts = random_phrases(rng, 40, [[rng.randrange(1, 99) for _ in range(6)] for _ in range(3)])
    folder = scratch_dir(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert suffix_tree.phrase_scores(phrase_rows(spark, texts), sum(own for own, _, _ in texts)).count() == len(texts)
    kinds = Counter(x.split("-")[0] for x in set(os.listdir(folder)) - before)
    assert kinds["states"] == 1 and kinds["alive"] == 0 and kinds["pairs"] == suffix_tree.PHRASES
    with pytest.raises(ValueError):
        discard(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_settled_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffled()
    counted = spark.range(1000).selectExpr("id % 7 AS k").repartition(3).groupBy("k").count()
    assert settle(counted, "test").count() == 7
    for _ in range(50):
        settled = {name for name in shuffled() - before if name.endswith(".data")}
        if len(settled) <= 1:  # that of the count
            break
        time.sleep(0.2)
    assert len(settled) <= 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_phrases_are_read_in_slices(monkeypatch):
    lists = {"phrases": ([[1, 2], [3], [4, 5, 6]], "uint64"), "logs": ([[0.5, 1.0], [2.0], [1.0, 1.5, 2.5]], "float32")}
    columns = {name: pa.array(x, pa.list_(pa.int64() if kind == "uint64" else pa.float32())) for name, (x, kind) in lists.items()}
    columns |= {"ats": pa.array([[1], None, [0, 2]], pa.list_(pa.int32())), "later": pa.array([[0.25], None, [1.0, 2.0]], pa.list_(pa.float32()))}
    batch = pa.RecordBatch.from_pydict({"row": pa.array([0, 1, 2], pa.int64()), "held_out": pa.array([False, True, False]), **columns})

    def logs():
        return [(x["row"], x["y0"], x["log"]) for part in suffix_tree._events([batch], None) for x in part.to_pylist()]

    whole = logs()
    monkeypatch.setattr(suffix_tree, "RUN_ROWS", 1)
    assert logs() == whole and len(list(suffix_tree._events([batch], None))) == 3


def test_counts_are_merged(monkeypatch):
    rng, sums, found = np.random.default_rng(1), suffix_tree._Sums(most=100), Counter()
    parts = [rng.integers(0, 300, 120).astype(np.uint64) for _ in range(20)]
    for part in parts:
        if sums.add(part):
            for keys, counts in sums.empty():
                found.update(dict(zip(keys.tolist(), counts.tolist())))
    for keys, counts in sums.empty():
        found.update(dict(zip(keys.tolist(), counts.tolist())))
    assert found == Counter(np.concatenate(parts).tolist())


ODD_TEXTS = ["", "  ", "a", " A b\t\x0bc\r\n", "É ü x", "x" * 50, "ab " * 30, "\x00 \x1c\x1d y\x85", "", "Ab ab\ncd", "tail "]


def test_runs_have_the_words_of_texts():
    """Words, their numbers and the bytes with those before them, as read word by word; a different word is hashed once."""
    words = [x.encode().lower().split() for x in ODD_TEXTS]
    run, start = suffix_tree.run_of([x.encode() for x in ODD_TEXTS]), b"\n" * suffix_tree.DEPTH
    assert run.sizes.tolist() == [len(x) for x in words]
    assert suffix_tree._numbers(run).tolist() == [xxhash.xxh3_64_intdigest(w) for x in words for w in x]
    expected = []
    for text in (start + b" ".join(x) + b"\n" for x in words):
        expected += [int.from_bytes(text[i - suffix_tree.DEPTH : i + 1], "big") for i in range(suffix_tree.DEPTH, len(text))]
    assert suffix_tree._codes(run).tolist() == expected
    asked, plain = [], xxhash.xxh3_64_intdigest
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(xxhash, "xxh3_64_intdigest", lambda word: asked.append(word) or plain(word))
        suffix_tree._numbers(run)
    assert sorted(asked) == sorted({w for x in words for w in x})


def test_spellings_take_the_longest_kept_suffix_of_all_depths(spark):
    rows = spark.createDataFrame([(i, f"the cat {i} sat on the mat {x}") for i, x in enumerate(ODD_TEXTS * 20)], "doc_id long, text string")
    counts = suffix_tree.corpus_counts(rows, np.zeros(0, dtype=np.uint64))
    tree = suffix_tree.fit(counts.where("kind = 0").selectExpr("key AS code", "n"))
    run, expected = suffix_tree.run_of([x.encode() for x in ODD_TEXTS]), []
    for code in suffix_tree._codes(run).tolist():
        found = [tree.contexts[d](np.array([(code >> 8) & suffix_tree._mask(d)], dtype=np.uint64))[0] for d in range(suffix_tree.DEPTH + 1)]
        expected.append(tree.states[max(found), tree.columns[code & 255]])
    logs = suffix_tree.run_spellings(run, suffix_tree.Walk(tree))
    assert len(logs) == run.symbols.sum() and logs.sum() == pytest.approx(np.sum(expected, dtype=np.float64), abs=1e-3)


def test_words_are_counted_where_texts_are_counted(spark):
    """Counts of words that are not broadcast come with the other counts."""
    rows = spark.createDataFrame([(1, "a b b"), (2, "B c"), (3, None)], "doc_id long, text string").fillna("")
    frequent = np.array([xxhash.xxh3_64_intdigest(b"a")], dtype=np.uint64)
    counts = {x.key % 2**64: x.n for x in suffix_tree.corpus_counts(rows, frequent).where(f"kind = {suffix_tree.RARE}").collect()}
    assert counts == {xxhash.xxh3_64_intdigest(b"b"): 3, xxhash.xxh3_64_intdigest(b"c"): 1}
