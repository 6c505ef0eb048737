"""Near copies and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import jaccard_join as jj
from lorekeep.llm import sketch_join as sj
from lorekeep.llm import suffix_dedup as sd
from lorekeep.llm.common import Scratch
from lorekeep.llm.components import components
from tests.llm.cases import BASE, ODD, empty, frame, text


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()


def brute_components(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and inter * den >= num * (len(sets[i]) + len(sets[j]) - inter):
                label[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))), key=str)


def near_copies(seed=4):
    turn, rows = random.Random(seed), []
    bases = [text(turn.randint(12, 200), turn).split(" ") for _ in range(12)]
    for i in range(260):
        w = list(bases[i % 3 if i % 2 else i % 12])
        for _ in range(turn.randint(0, 6)):
            w[turn.randrange(len(w))] = f"new{turn.randint(0, 60)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("rows", "n", "num", "den"), [(ODD, 3, 9, 10), (ODD, 5, 8, 10), (near_copies(), 3, 9, 10), (near_copies(5), 2, 7, 10)])
def test_components(spark, rows, n, num, den):
    got = jj.similar_documents(frame(spark, rows), n, num, den, block_bytes=20_000).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, n, num, den)


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (300, 300)], "a long, b long")
    got = {r.node: r.label for r in components(links, Scratch(spark, "t"), "c").collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100}


def test_distinct_documents(spark):
    rows = frame(spark)
    kept = jj.distinct_documents(rows)
    assert kept.schema == rows.schema
    got = [r.doc_id for r in kept.collect()]
    assert got.count(1) == 1 and not {2, 3, 12} & set(got) and {4, 5, 6, 7, 9, 13, 18} <= set(got)
    assert jj.distinct_documents(empty(spark)).count() == 0 and jj.similar_documents(empty(spark)).count() == 0


def brute_repeats(rows, length):
    big = 2**63 - 1
    first = {}
    data = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            first[s] = min(first.get(s, big), i)
    out = []
    for (i, t), (doc, _) in zip(data, rows, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((doc, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeats(seed=8):
    turn, rows = random.Random(seed), []
    passages = [text(turn.randint(9, 40), turn) for _ in range(9)]
    for i in range(150):
        parts = [turn.choice(passages) if turn.random() < 0.5 else text(turn.randint(1, 25), turn) for _ in range(turn.randint(0, 5))]
        t = " ".join(parts)
        cut = turn.randint(0, 30)
        rows.append((turn.randint(0, 120), t[cut:] + "ab" * turn.choice([0, 0, 40])))
    return rows


@pytest.mark.parametrize("rows", [ODD, repeats(), [(i, "abcdefghij" * 30) for i in range(5)]])
@pytest.mark.parametrize("length", [50, 20])
def test_remove_repeats(spark, rows, length):
    got = sd.digest(sd.remove_repeats(frame(spark, rows), length, block_bytes=9000)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows, length)


def hot_line(n, seed=6):
    turn = random.Random(seed)
    tail = lambda: "".join(turn.choice("abcdefghij ") for _ in range(turn.randint(30, 60)))
    lines = [tail() for _ in range(40)]
    return [(turn.choice([None, turn.randint(0, n)]), f"{turn.choice(lines) if i % 3 else tail()}\nReleased under the MIT License.\n{turn.choice(lines) if i % 2 else tail()}") for i in range(n)]


@pytest.mark.parametrize("length", [50, 20])
def test_hot_anchor_is_split(spark, length):
    rows = hot_line(3 * sd.HOT_CONTEXTS)
    got = sd.digest(sd.remove_repeats(frame(spark, rows), length, block_bytes=9000)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows, length)
    work = Scratch(spark, "t")
    blocks = work.write(sd.pack_documents(frame(spark, rows), block_bytes=9000), "blocks")
    flags = work.write(sd.repeated_flags(blocks, length, 3), "flags")
    sent = sd._contexts(blocks, flags, length, 3).collect()
    anchor, meet = sd.anchor_size(length), {}
    for r in sent:
        if r.contexts is not None:
            _, _, off, context = sd._unpack_contexts(r.contexts)
            for o, c in zip(off.tolist(), context, strict=True):
                meet[c[o : o + anchor]] = meet.get(c[o : o + anchor], 0) + 1
    assert max(meet.values(), default=0) <= sd.HOT_CONTEXTS
    assert blocks.count() > 1 and any("windows" in r and r.windows is not None for r in sent)


def test_turns_share_the_contexts(spark):
    """A turn holds a part of what is compared, and all turns the whole; results are those of brute force."""
    rows = hot_line(3 * sd.HOT_CONTEXTS) + repeats()
    work = Scratch(spark, "t")
    blocks = work.write(sd.pack_documents(frame(spark, rows), block_bytes=9000), "blocks")
    flagged = work.write(blocks.join(sd.repeated_flags(blocks, 50, 9), "block", "left"), "flagged")

    def sent(turn, turns):
        return sorted((r.bucket, r.block, r.contexts or b"", r.windows or b"") for r in sd._contexts(flagged, None, 50, 9, turn, turns).collect() if r.cuts is None)

    parts = [sent(turn, 3) for turn in range(3)]
    assert sorted(map(len, parts))[0] > 0
    packed = lambda rows: [r[:3] for r in rows if r[2]]
    assert sorted(x for p in parts for x in packed(p)) == packed(sent(0, 1))
    assert max(sum(len(r[2]) for r in p) for p in parts) < 0.6 * sum(len(r[2]) for r in sent(0, 1))
    got = sd.digest(sd.remove_repeats(frame(spark, rows), 50, block_bytes=9000)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows, 50)


def test_cut_documents(spark):
    rows = frame(spark)
    cut = sd.cut_documents(rows)
    assert cut.schema == rows.schema
    got = {}
    for r in cut.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].text == BASE and got[1][0].lang == "en" and 2 not in got and 12 not in got and got[4][0].text == ""
    assert all(r.n_chars == len(r.text) for rs in got.values() for r in rs)
    assert sd.cut_documents(empty(spark)).count() == 0 and sd.remove_repeats(empty(spark)).count() == 0


def test_deep_shallow_order():
    turn = random.Random(1)
    data = "".join(turn.choice("ab") * turn.randint(1, 40) for _ in range(150)).encode()
    starts = np.arange(len(data) - 50)
    order, heads = sd.equal_suffixes(data, starts, 50)
    keys = [data[i : i + 50] for i in order]
    assert keys == sorted(keys)
    assert heads.tolist() == [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
    strings = [bytes(turn.choice(b"ab") for _ in range(6)) for _ in range(200)]
    groups = sd.blind_trie_groups(strings)
    assert [strings[g[0]] for g in groups] == sorted(set(strings)) and all(len({strings[i] for i in g}) == 1 for g in groups)


@pytest.mark.parametrize(("rows", "n", "num", "den", "k"), [(ODD, 3, 85, 100, 64), (ODD, 5, 8, 10, 64), (near_copies(), 3, 85, 100, 64), (near_copies(5), 2, 7, 10, 64), (near_copies(6), 2, 8, 10, 128), ([(3, None), (None, " ")], 3, 85, 100, 64)])
def test_sketches(spark, rows, n, num, den, k):
    got = sj.near_copies(frame(spark, rows), n, num, den, k, block_bytes=20_000)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    found = got.collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_components(rows, n, num, den)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found) and sj.near_copies(empty(spark)).count() == 0


def boilerplate(n, seed=7):
    """Documents that have common passages but are no copies of each other, and pairs that are."""
    turn = random.Random(seed)
    common, rows = [text(40, turn) for _ in range(3)], []
    for i in range(0, n, 2):
        own = " ".join(f"w{turn.randint(0, 10**9)}" for _ in range(100))
        rows += [(i, own + " " + common[i % 3]), (i + 1, own + " changed " + common[i % 3])]
    return rows


def test_common_passages_are_not_posted(spark):
    work, rows = Scratch(spark, "t"), boilerplate(400)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in sj.near_copies(frame(spark, rows), 3, 85, 100).collect()), key=str) == brute_components(rows, 3, 85, 100)
    blocks = work.write(sj.pack_documents(frame(spark, rows)), "blocks")
    counts = sj.frequencies(blocks, lambda block: sj.sketches_of(block, 3, 64), 1)
    chosen = blocks.select("block", F.sequence(F.lit(0), F.lit(399)).alias("chosen"))
    records = sj._records(blocks.join(counts, "block").join(chosen, "block"), 3, 85, 100, 64, 1)
    assert records.select(F.explode("prefix").alias("v")).groupBy("v").count().agg({"count": "max"}).first()[0] <= 20


def test_sketch_bounds():
    turn = random.Random(5)
    sure = sj.sure_matches(64, 85, 100)
    assert 20 < sure < 40 and sj.sure_matches(64, 85, 100, 0.5) >= 54
    for _ in range(300):
        size = turn.randint(1, 200)
        a = set(turn.sample(range(10**9), size))
        common = turn.sample(sorted(a), turn.randint(-(-size * 85 // 100), size))
        b = set(common) | set(turn.sample(range(10**9), turn.randint(0, max(0, int(size * 0.15)))))
        if 100 * len(a & b) >= 85 * len(a | b):
            shared = len(set(sorted(a)[:64]) & set(sorted(b)[:64]))
            assert all(shared >= sj.least_shared(len(x), 64, 85, 100, sure) for x in (a, b))
    for size in range(1, 65):  # sets that are their own sketches share what the similarity asks for
        assert sj.least_shared(size, 1000, 85, 100, 0) == -(-85 * size // 100)
