"""Centroid clustering and the filter audit against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from lorekeep.llm import filter_audit as fa
from lorekeep.llm import pivot_clustering as pc
from lorekeep.llm.common import Scratch
from tests.llm.cases import ODD, text


def brute_clusters(rows, dims, clusters, rounds):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**60 else 1024 * int(x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in kept[:clusters]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min(range(len(cents)), key=lambda j: (gap(v, cents[j]), j))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), k in zip(kept, own, strict=True) if k == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    own = [near(v) for _, v in kept]
    far = [gap(v, cents[k]) for (_, v), k in zip(kept, own, strict=True)]
    long = lambda x: x if x < 2**63 else None
    inertia = [sum(d for d, k in zip(far, own, strict=True) if k == j) for j in range(len(cents))]
    return [(i, k, long(d), long(inertia[k]), long(sum(far)), hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for (i, _), k, d in zip(kept, own, far, strict=True)]


def vectors(seed, n=300, dims=8):
    turn = random.Random(seed)
    hubs = [[turn.gauss(0, 2) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [x + turn.gauss(0, 0.3) for x in hubs[i % 5 if i % 2 else 0]]) for i in range(n)]
    odd = [(None, [0.5] * dims), (None, [0.5] * dims), (3, [1.0] * (dims - 1)), (4, None), (5, [None] * dims), (6, [float("nan")] + [0.0] * (dims - 1)), (7, [float("inf")] + [0.0] * (dims - 1)), (8, []), (9, [-0.00001] * dims), (9, [-0.00001] * dims)]
    return rows + odd + [rows[0]] * 40


WIDE = [(i, [float(x * 10 ** (i % 9 * 4)) for x in (i, -i, 1, 2, 3, -4, 0.25, 7)]) for i in range(60)]


@pytest.mark.parametrize(("rows", "clusters"), [(vectors(1), 6), (vectors(2, 40), 200), (WIDE, 4), ([], 3), ([(1, [2.0] * 8)] * 5, 3)])
def test_clusters(spark, rows, clusters):
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, label int").repartition(3)
    got = pc.cluster_vectors(frame, 8, clusters, 4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_clusters(rows, 8, clusters, 4), key=str)


def test_bounds_leave_out_only_farther_ones(spark):
    turn = np.random.default_rng(5)
    points = (turn.normal(size=(400, 16)) * 900).astype(np.int64)
    cents = [c for c in (turn.normal(size=(9, 16)) * 900).astype(np.int64)]
    cents.append(cents[2].copy())
    pivots = pc.choose_pivots(list(points[:20]), 6)
    cluster, best, computed = pc.nearest(points, pc.pivot_table(points, pivots), cents, np.stack([pc.pivot_table(c[None, :], pivots)[0] for c in cents]))
    every = np.stack([((points - c) ** 2).sum(1) for c in cents], 1)
    assert (cluster == every.argmin(1)).all() and (best == every.min(1)).all() and 400 <= computed <= 4000
    report = []
    pc.cluster_vectors(spark.createDataFrame(vectors(3), "vec_id long, embedding array<double>"), 8, 6, 3, report=report).count()
    assert len(report) == 3 and all(n <= computed < 4 * n for n, computed in report)


def test_digits():
    turn = random.Random(2)
    for v in [0, 1, -1, 2**40, -(2**40), 2**63, -(2**200)] + [turn.randint(-(2**90), 2**90) for _ in range(200)]:
        d = pc.digits(v)
        assert sum(x << (pc.DIGIT * i) for i, x in enumerate(d)) == v and all(abs(x) <= 2**pc.DIGIT for x in d)


def fails(rows):
    """The five failures of each row, in words."""
    out = []
    for i, _, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        smaller = any((j is not None) and (i is None or j < i) and (u or "") == t for j, _, u in rows)
        out.append([len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), any(c in t for c in "#$%&*|"), smaller])
    return out


def brute_audit(rows, labels):
    failed, out = fails(rows), []
    good, toxic = ({i for i, *says in labels if i is not None and says[k] == 1} for k in (0, 1))
    parts = [p or "" for _, p, _ in rows]
    for part in set(parts):
        mine = [k for k in range(len(rows)) if parts[k] == part]
        removed_of, steps = Counter(), []
        for order in permutations("ABCDE"):
            left = set(mine)
            for step, name in enumerate(order, 1):
                f = "ABCDE".index(name)
                all_failing = {k for k in mine if failed[k][f]}
                gone = left & all_failing
                redundant = all_failing - left
                left -= gone
                removed_of[name] += len(gone)
                unique = sum(failed[k][f] and sum(failed[k]) == 1 for k in mine)
                steps.append((part, "".join(order), step, len(left), len(gone), len(redundant), unique, sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)))
        out += [(*s, removed_of[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def audit_rows(seed=9):
    turn, rows = random.Random(seed), []
    base = [text(turn.randint(0, 90), turn) + turn.choice(["", " A&B", " ABCDEFGHIJ" * 9, "\n"]) for _ in range(40)]
    for i in range(260):
        t = turn.choice(base) if turn.random() < 0.6 else base[0][: turn.randint(0, 200)] + turn.choice(["", "x", "é"])
        rows.append((turn.choice([i, i, i, turn.randint(0, 260), None]), turn.choice(["s", "s", "t", None, ""]), turn.choice([t, t, t, t, None])))
    return rows


LABELS = [(i, i % 3, (i + 1) % 2) for i in range(0, 260, 2)] + [(4, 1, 1), (5, None, 1), (None, 1, 1), (6, 0, None)]


@pytest.mark.parametrize(("rows", "sizes"), [(audit_rows(), {"block_bytes": 3000, "trie_bytes": 500, "range_bytes": 4000}), (audit_rows(4), {}), ([(i, "s", t) for i, t in ODD], {"trie_bytes": 100}), ([], {})])
def test_audit(spark, rows, sizes):
    docs = spark.createDataFrame([(i, t, p, 1, "k", 0) for i, p, t in rows], "doc_id long, text string, source string, mask int, part string, step int").repartition(3)
    got = fa.audit(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"), **sizes)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, LABELS)


def test_prefixes_are_lengthened(spark):
    rows = [(i, ("same beginning of all " * 3)[: 40 + i % 30] + f"{i % 50}" * (i % 9)) for i in range(300)]
    frame = spark.createDataFrame([(k, i, t.encode()) for k, (i, t) in enumerate(rows)], "rid long, doc_id long, text binary")
    dealt = fa.dealt_by_prefix(frame, Scratch(spark, "t"), 2000).collect()
    weight, whole = Counter(), {r.prefix for r in dealt if r.prefix == r.text}
    for r in dealt:
        assert r.text.startswith(r.prefix)
        weight[r.prefix] += len(r.text) if len(r.text) > len(r.prefix) else 0
    assert len(weight) > 10 and max(len(p) for p in weight) > fa.FIRST_PREFIX and whole and max(weight.values()) <= 2000


def test_trie():
    turn, trie, seen = random.Random(3), fa.RadixTrie(), {}
    for n in range(3000):
        t = bytes(turn.choice(b"ab") for _ in range(turn.randint(0, 9))) + b"c" * turn.randint(0, 2)
        assert trie.insert(t, n) == seen.setdefault(t, n)
