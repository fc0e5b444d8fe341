"""Integer k-means and the audit of filters against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest

from dataproof.llm import centroids, filter_audit

INF = float("inf")


def plain_k_means(rows, clusters=8, rounds=10, size=64):
    kept = []
    for vec_id, vector in rows:
        if vector is not None and len(vector) == size and all(x is not None and abs(x) < INF for x in vector):
            whole = [int(np.floor(1024 * float(x))) for x in vector]
            if all(-centroids.LARGEST <= x < centroids.LARGEST for x in whole):
                kept.append((vec_id, whole))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middles = [list(v) for _, v in order[:clusters]]

    def assign():
        out = []
        for vec_id, v in kept:
            apart = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in middles]
            out.append((vec_id, apart.index(min(apart)), min(apart), v))
        return out

    for _ in range(rounds):
        found = assign()
        for number in range(len(middles)):
            members = [v for _, cluster, _, v in found if cluster == number]
            if members:
                middles[number] = [sum(x) // len(members) for x in zip(*members)]
    found = assign()
    inertia = [sum(d for _, cluster, d, _ in found if cluster == number) for number in range(len(middles))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middles]
    return sorted(((i, c, d, inertia[c], sum(inertia), digests[c]) for i, c, d, _ in found), key=repr)


def test_clusters_match_plain_k_means(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, centroids.cluster_report(df).collect()), key=repr) == plain_k_means(rows)


def odd_vectors():
    rng = random.Random(2)
    base = [[rng.choice([-1.0, -0.5, 0.0, 0.25]) for _ in range(64)] for _ in range(12)]
    rows = [(i % 30, base[i % 12], 1) for i in range(60)]  # repeated rows and ids, many ties
    rows += [(None, base[0], None), (100, None, 2), (101, base[0][:63], 3), (102, base[1] + [1.0], 4), (103, [None, *base[0][1:]], 5)]
    rows += [(104, [float("nan"), *base[0][1:]], 6), (105, [INF, *base[0][1:]], 7), (106, [1e30, *base[0][1:]], 8), (107, [], 9)]
    return rows


def test_odd_vectors(spark):
    df = spark.createDataFrame(odd_vectors(), "vec_id long, embedding array<float>, cluster int")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, centroids.cluster_report(df).collect()), key=repr) == plain_k_means(rows)
    few = df.where("vec_id = 3").limit(1)
    assert [(r.cluster, r.distance) for r in centroids.cluster_report(few).collect()] == [(0, 0)]
    assert centroids.cluster_report(df.where("false")).count() == 0


@pytest.mark.parametrize("leading", [1, 8, 64])
def test_bounds_lose_no_centroid(leading):
    """Clustered and tied vectors; few centroids are measured, and the result is that of measuring all."""
    rng = np.random.default_rng(4)
    middles = rng.integers(-(2**20), 2**20, (8, 64))
    vectors = (middles[rng.integers(0, 8, 3000)] + rng.integers(-3000, 3000, (3000, 64))).astype(np.int32)
    vectors[::7] = vectors[0]
    vectors[::11] = (middles[2] + middles[5]) // 2
    middles[5], middles[6] = 2 * vectors[11].astype(np.int64) - middles[2], middles[1]
    covariance = np.cov(vectors.T)
    rotation = centroids.Rotation(np.round(vectors.mean(axis=0)), np.ascontiguousarray(np.linalg.eigh(covariance)[1][:, ::-1][:, :leading]))
    best, least, measured = centroids.nearest(vectors, *rotation(vectors), middles, rotation)
    apart = ((vectors[:, None, :].astype(np.int64) - middles[None]) ** 2).sum(axis=2)
    assert (best == apart.argmin(axis=1)).all() and (least == apart.min(axis=1)).all()
    assert measured < 0.5 * apart.size or leading == 1


def test_rotation_is_that_of_all_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = centroids.integer_vectors(df, "vec_id", "embedding", 64, 1024).repartition(5)
    rotation = centroids.fit_rotation(vectors, 64, 16)
    matrix = np.array([r.v for r in vectors.collect()], dtype=float)
    values = np.linalg.eigvalsh(np.cov(matrix.T, bias=True))[::-1][:16]
    spread = ((matrix - rotation.mean) @ rotation.basis).var(axis=0)
    assert spread == pytest.approx(values, rel=1e-6)
    assert rotation.basis.T @ rotation.basis == pytest.approx(np.eye(16), abs=1e-9)


def plain_audit(rows, filters, labels):
    """``rows`` are (part, flags, labels); every order is applied row by row."""
    out = []
    for part in sorted({part for part, _, _ in rows}):
        own = [(flags, marks) for p, flags, marks in rows if p == part]
        shapley = dict.fromkeys(filters, 0)
        lines = []
        for order in permutations(filters):
            left = list(own)
            for step, name in enumerate(order):
                gone = [x for x in left if name in x[0]]
                left = [x for x in left if name not in x[0]]
                shapley[name] += len(gone)
                fails = sum(name in flags for flags, _ in own)
                alone = sum(flags == {name} for flags, _ in own)
                lost = [sum(label in marks for _, marks in gone) for label in labels]
                lines.append((part, "".join(order), step + 1, name, len(left), len(gone), fails - len(gone), alone, *lost))
        out += [(*line, shapley[line[3]]) for line in lines]
    return sorted(out)


@pytest.mark.parametrize("batch", [10000, 7])
def test_audit_matches_every_order(spark, batch):
    rng = random.Random(8)
    rows = []
    for _ in range(400):
        part = rng.choice([None, "", "a", "hot", "hot", "hot"])
        rows.append((part, *[rng.choice([True, False, None]) for _ in range(5)]))
    df = spark.createDataFrame(rows, "part string, A boolean, B boolean, C boolean, good boolean, toxic boolean").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = sorted(map(tuple, filter_audit.audit(df, "ABC", ["good", "toxic"]).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = [
        (part or "", {x for x, y in zip("ABC", flags) if y}, {x for x, y in zip(["good", "toxic"], flags[3:]) if y}) for part, *flags in rows
    ]
    assert found == plain_audit(plain, "ABC", ["good", "toxic"])
    assert filter_audit.audit(df.where("false"), "ABC", []).count() == 0


def test_galloping_merges():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lists = [np.unique(rng.integers(0, 300, rng.integers(0, 200))) for _ in range(4)]
        assert (filter_audit.gallop(lists[0], lists[1]) == np.searchsorted(lists[0], lists[1])).all()
        assert filter_audit.difference(lists[0], lists[1]).tolist() == sorted(set(lists[0].tolist()) - set(lists[1].tolist()))
        assert filter_audit.union(lists).tolist() == sorted(set().union(*(x.tolist() for x in lists)))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_flags(doc_id, text, least):
    text = text or ""
    words = WORD.findall(text)
    flags = {"A"} if len(words) < 50 else set()
    if 100 * len(set(words)) < 65 * len(words):
        flags.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
        flags.add("C")
    if re.search(r"[#$%&*|]", text):
        flags.add("D")
    if doc_id is not None and least.get(text) is not None and least[text] < doc_id:
        flags.add("E")
    return flags


def test_filters_of_odd_documents(spark, odd_documents):
    marks = spark.createDataFrame([(5, 1, 0), (5, 0, 1), (4, None, None), (None, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    df = odd_documents.selectExpr("doc_id", "text", "lang AS source", "'x' AS part", "true AS A", "1 AS label_id_")
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    expected = [
        (doc_id, part or "", plain_flags(doc_id, text, least), doc_id == 5, doc_id == 5) for doc_id, text, part in rows
    ]
    found = [
        (r.doc_id, r.part, {x for x in "ABCDE" if r[x]}, bool(r.good_lost), bool(r.toxic_lost))
        for r in filter_audit.document_filters(df, marks).collect()
    ]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert filter_audit.filter_audit(df.where("false"), marks).count() == 0
    parts = {r.part for r in filter_audit.filter_audit(df, marks).select("part").distinct().collect()}
    assert parts == {part or "" for _, _, part in rows}


@pytest.mark.parametrize("hot", [1, 1 << 40])
def test_frequent_texts_take_either_way(spark, hot, monkeypatch):
    """With one row a key is never frequent enough, with the other always; the answers are the same."""
    monkeypatch.setattr(filter_audit, "HOT_PART", hot)
    rows = [(i, "ab"[i % 2] if i < 40 else f"t{i}") for i in range(60)] + [(7, "b"), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "cast(text AS binary) AS key")
    found = {(r.doc_id, bytes(r.key).decode()): r.repeated for r in filter_audit.repeated(df, "key", "doc_id").collect()}
    assert len(found) == 61 and found[None, "a"] is False
    assert all(found[key] == (key[0] in range(2, 40)) for key in found if key[0] is not None)
