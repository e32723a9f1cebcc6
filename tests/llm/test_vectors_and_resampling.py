"""Importance resampling, sharded k-means and projection passes against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from hinterland.llm import projection_passes, sharded_lloyd
from hinterland.llm.importance import resample
from hinterland.llm.prefix_crc import Prefixes, run_crcs, shift
from hinterland.llm.projection_passes import near_vectors, passes_needed
from hinterland.llm.sharded_lloyd import cluster_vectors


def words_of(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return re.findall(rb"[0-9a-z\x80-\xff]+", low)


def test_any_run_has_its_crc_from_two_prefixes():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    a = rng.integers(0, 5000, 300)
    b = np.minimum(a + rng.integers(0, 3000, 300), 5000)
    p = Prefixes(data)
    got = p.at(b) ^ shift(p.at(a), b - a)
    assert got.tolist() == [zlib.crc32(data[i:j].tobytes()) for i, j in zip(a, b)]
    assert Prefixes(np.zeros(0, np.uint8)).at(np.array([0])).tolist() == [0]


@pytest.mark.parametrize("longest", [1, 4])
def test_runs_of_words_match_crc32(longest):
    texts = ["Hello, World 42  é ß\n", "", None, "!!", "a", "x" * 70_000 + " Y", "Çé  z",
             " ".join(f"w{i}" for i in range(3000))]
    seen = 0
    for first, n, found in run_crcs(pa.array(texts), longest):
        at = [0] * longest
        for k in range(len(n)):
            w = words_of(texts[first + k])
            assert n[k] == len(w)
            for m in range(longest):
                want = [zlib.crc32(b" ".join(w[i:i + m + 1])) for i in range(len(w) - m)]
                runs = found[m][1][k]
                assert found[m][0][at[m]:at[m] + runs].tolist() == want
                at[m] += runs
            seen += 1
    assert seen == len(texts)


DOCS = "doc_id long, text string, rank int, _row int, bucket string, _part int"


def resampled(docs, target, longest, buckets, percent):
    def runs(text):
        w = words_of(text)
        return [zlib.crc32(b" ".join(w[i:i + n])) % buckets for n in range(1, longest + 1)
                for i in range(len(w) - n + 1)]

    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, text in docs:
        np.add.at(s, runs(text), 1)
    for text in target:
        np.add.at(t, runs(text), 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets))))
            for a, b in zip(s, t)]
    out = []
    for i, text in docs:
        r = runs(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in r) // len(r) if r else 0
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([i, len(words_of(text)), len(r), weight, score, None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[:len(able) * percent // 100]):
        r[5] = place + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (3, 50, 40)])
def test_resampling_matches_brute_force(spark, longest, buckets, percent):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in rng.integers(0, 60, 120)]
    docs = [(i - 5, t) for i, t in enumerate(texts)] + [
        (500, None), (501, ""), (502, " \n!"), (None, texts[0] * 3), (None, None), (7, texts[7]), (7, texts[7]),
        (600, "Word " * 30_000)]
    target = ["w1 w2 w3", "", None, "w59 " * 40]
    frame = spark.createDataFrame([(i, t, 1, 2, "b", 3) for i, t in docs], DOCS)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(frame, aims, longest, buckets, percent)
    assert sorted(map(tuple, got.collect()), key=str) == resampled(docs, target, longest, buckets, percent)


def test_resampling_of_empty_tables(spark):
    frame = spark.createDataFrame([(i, "a b " * 20, 1, 2, "b", 3) for i in range(20)], DOCS)
    none = frame.limit(0)
    assert resample(none, none).count() == 0
    got = resample(frame, none).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]


VECTORS = "vec_id long, embedding array<float>, label int, part int, node string, row int"


def vector_rows(rng, n, width, centres):
    base = rng.standard_normal((centres, width))
    return [(int(i), (base[rng.integers(centres)] + 0.1 * rng.standard_normal(width)).astype(np.float32).tolist(),
             int(rng.integers(3)), 0, "n", 0) for i in range(n)]


def odd_rows(rng, width):
    good = rng.standard_normal(width).astype(np.float32).tolist()
    return [(1000, None, 1, 0, "n", 0), (1001, [], 1, 0, "n", 0), (1002, [0.0] * width, 1, 0, "n", 0),
            (1003, [float("nan")] + good[1:], 1, 0, "n", 0), (1004, [None] + good[1:], 1, 0, "n", 0),
            (1005, [float("inf")] + good[1:], 1, 0, "n", 0), (1006, good[:-1], 1, 0, "n", 0),
            (1007, good, None, 0, "n", 0), (None, good, 2, 0, "n", 0), (1008, good, 2, 0, "n", 0),
            (1009, good, 2, 0, "n", 0), (1009, good, 2, 0, "n", 0), (None, None, None, None, None, None)]


def lloyd(rows, width, clusters, rounds):
    kept = [(i, np.floor(256 * np.array(v, float)).astype(int), v) for i, v, *_ in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    x = np.array([r[1] for r in kept])
    centres = x[:clusters].copy()
    for turn in range(rounds + 1):
        d = ((x[:, None, :] - centres[None]) ** 2).sum(2)
        near = d.argmin(1)
        if turn < rounds:
            for c in range(len(centres)):
                if (near == c).any():
                    centres[c] = x[near == c].sum(0) // (near == c).sum()
    best = d[np.arange(len(x)), near]
    return sorted([(i, int(c), int(b), int(best[near == c].sum()), int(best.sum()),
                    hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest())
                   for (i, _, _), c, b in zip(kept, near, best)], key=str)


@pytest.mark.parametrize(("width", "columns", "clusters"), [(64, 32, 40), (10, 4, 7), (10, 3, 500)])
def test_sharded_lloyd_matches_brute_force(spark, monkeypatch, width, columns, clusters):
    monkeypatch.setattr(sharded_lloyd, "ROWS", 16)
    rng = np.random.default_rng(4)
    rows = vector_rows(rng, 150, width, 12) + odd_rows(rng, width)
    got = cluster_vectors(spark.createDataFrame(rows, VECTORS), clusters, width=width, columns=columns)
    assert sorted(map(tuple, got.collect()), key=str) == lloyd(rows, width, clusters, 5)


def test_sharded_lloyd_of_awkward_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert cluster_vectors(none).collect() == []
    large = spark.createDataFrame([(1, [1e30] * 4, 0, 0, "n", 0)], VECTORS)
    with pytest.raises(Exception, match="too large"):
        cluster_vectors(large, width=4).collect()


def linked(rows, cosine):
    able = {}
    for k, (_, v, label, *_) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            able[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    group, n = list(range(len(rows))), [0] * len(rows)
    for a in able:
        for b in able:
            if a < b and rows[a][2] == rows[b][2] and len(able[a]) == len(able[b]) and able[a] @ able[b] >= cosine:
                n[a], n[b] = n[a] + 1, n[b] + 1
                old, new = group[b], group[a]
                group = [new if g == old else g for g in group]
    out = []
    for k, row in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((row[0], n[k], low, row[0] == low))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_projection_passes_match_brute_force(spark, monkeypatch, partitions):
    rng = np.random.default_rng(5)
    rows = vector_rows(rng, 260, 16, 25) + odd_rows(rng, 16)
    # A chain, whose ends are not linked, and a vector on the border of 32 bits.
    turn = [math.pi * k / 24 for k in range(12)]
    rows += [(2000 + k, [math.cos(t), math.sin(t)], 1, 0, "n", 0) for k, t in enumerate(turn)]
    monkeypatch.setattr(projection_passes, "BLOCK", 4)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = near_vectors(spark.createDataFrame(rows, VECTORS), window=16)
        assert sorted(map(tuple, got.collect()), key=str) == linked(rows, 0.93)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


def test_windows_cross_ranges(spark, monkeypatch):
    """One pass with one order: only neighbours within the window meet, in whichever range they lie."""
    monkeypatch.setattr(projection_passes, "passes_needed", lambda *a: 1)
    rng = np.random.default_rng(6)
    base = rng.standard_normal(8)
    rows = [(k, (base + 0.05 * rng.standard_normal(8)).astype(np.float32).tolist(), 1, 0, "n", 0)
            for k in range(90)]
    spark.conf.set("spark.sql.shuffle.partitions", 30)
    try:
        got = near_vectors(spark.createDataFrame(rows, VECTORS), window=5).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert {r["component_id"] for r in got} == {0}
    assert {r["n_links"] for r in got} == {89}


def test_passes_grow_with_the_rows():
    assert passes_needed(100) == 2 < passes_needed(10_000) < passes_needed(10**8)
