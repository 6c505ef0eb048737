"""Scoring, quality, sampling, sharding, coding, licenses and decontamination."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import class_ngrams, decontamination, importance_sampling, license_scan, piece_codec, quality_rules, sharding, token_output
from lorekeep.llm.common import Scratch, Words, window_hash
from lorekeep.llm.queries import SHARDS, tokenizer_path
from tests.llm.cases import ODD, TURN, empty, frame, text

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_class_ngrams(spark):
    # names and acts alternate, which classes can tell and counts cannot
    lines = lambda: " ".join(f"name{TURN.randint(0, 30)} act{TURN.randint(0, 30)}" for _ in range(40))
    rows = ODD + [(i, lines()) for i in range(100, 500)]
    got = class_ngrams.score_documents(frame(spark, rows), block_bytes=8000).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = [(i, [*words((t or "").translate(LOW)), "\n"]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    mine, base = (sum(getattr(r, k) for r in got if r.held_out) for k in ("score", "base_score"))
    assert base < mine < 0 and all(r.perplexity > 1 for r in got)
    assert class_ngrams.score_documents(empty(spark)).count() == 0
    unseen = class_ngrams.score_documents(frame(spark), held=F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in unseen)


def test_class_scores_by_brute_force(spark, monkeypatch):
    """Classes as the operator found them, read from what it codes; all else counted anew."""
    cg = class_ngrams
    rows = ODD + [(i, text(60)) for i in range(100, 260)] + [(i, " ".join(f"w{(i * 97 + j * 13) % 9000}" for j in range(70))) for i in range(1000, 1300)]
    found = {}
    real = cg.code_blocks

    def spy(blocks, answers, head, buckets):
        out = real(blocks, answers, head, buckets)
        found.update({w: c for w, (c, _) in head.items()})
        told = {r.block: r.k for r in answers.where("block IS NOT NULL").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "classes"))).alias("k")).collect()}
        for b in blocks.collect():
            rest = [w for w in cg._words(b.asDict()) if w not in head]
            order, _ = cg._bucket_slices(rest, buckets)
            classes = np.concatenate([np.frombuffer(cg.expand(k.classes), np.uint8) for k in told.get(b.block, [])] + [np.zeros(0, np.uint8)])
            for i, c in zip(order.tolist(), classes.tolist(), strict=True):
                assert found.setdefault(rest[i], c) == c
        return out

    monkeypatch.setattr(cg, "code_blocks", spy)
    got = cg.score_documents(frame(spark, rows), block_bytes=6000).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = [(i, [b"\n", *(t or "").encode().lower().split(), b"\n"]) for i, t in rows]
    own = [ws for i, ws in tokens if not held(i)]
    n = Counter(w for ws in own for w in ws[1:])
    head = sorted((w for w in n if w != b"\n"), key=lambda w: (-n[w], w))[: cg.HEAD]
    rest = set(n) - set(head) - {b"\n"}
    assert len(rest) > 1000 and all((found[w] == cg.CLASSES - 1) == (n[w] == 1) for w in rest) and len({found[w] for w in rest}) > 2
    cls = lambda w: found[w] if w in n else cg.CLASSES - 1
    trans, size = Counter((cls(a), cls(b)) for ws in own for a, b in zip(ws, ws[1:], strict=False)), Counter(cls(w) for ws in own for w in ws[1:])
    out, kinds = Counter(cls(w) for ws in own for w in ws[:-1]), Counter(cls(w) for w in n)
    kinds[cg.CLASSES - 1] += 1

    def score(ws):
        return sum(
            math.log10((trans[cls(a), cls(b)] + 0.1) / (out[cls(a)] + 0.1 * cg.CLASSES)) + math.log10((n[b] + 0.1) / (size[cls(b)] + 0.1 * kinds[cls(b)]))
            for a, b in zip(ws, ws[1:], strict=False)
        )

    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted((str(i), round(score(ws), 6)) for i, ws in tokens)


def test_exchange_raises_likelihood(spark):
    turn = np.random.default_rng(2)
    trans = turn.integers(1, 50, (6, 6)).astype(float)
    left, right = np.zeros((1, 6)), np.zeros((1, 6))
    trans[0, 4] += 400
    trans[4, 0] += 400
    left[0, 0] = right[0, 0] = 30  # a word that always stands between ends, as those of class 4 do
    trans[0, 2] += 30
    trans[2, 0] += 30
    to, gain = class_ngrams.best_classes(left, right, np.array([2]), trans)
    assert to[0] == 4 and gain[0] > 0
    lines = lambda: " ".join(f"name{TURN.randint(0, 90)} act{TURN.randint(0, 90)}" for _ in range(40))
    docs = frame(spark, [(i, lines()) for i in range(300)]).select("doc_id", F.lit(False).alias("held"), "text")
    work = Scratch(spark, "t")
    blocks = work.write(class_ngrams._tokenised(docs, 8000), "blocks")
    words = class_ngrams.vocabulary(blocks).orderBy(F.desc("n")).collect()
    found = class_ngrams.cluster_head(blocks, [bytes(r.word) for r in words if r.word != b"\n"], work)
    assert len(found.history) > 3 and all(a < b for a, b in zip(found.history, found.history[1:], strict=False))
    assert abs(found.history[-1] - class_ngrams.likelihood(found.transitions(found.classes))) < 1e-6
    names = {int(found.classes[i]) for i, r in enumerate([r for r in words if r.word != b"\n"], 1) if r.word.startswith(b"name")}
    acts = {int(found.classes[i]) for i, r in enumerate([r for r in words if r.word != b"\n"], 1) if r.word.startswith(b"act")}
    assert not names & acts


def test_quality_rules(spark):
    bad, good = ["vile", "scum"], ["fine", "kind"]
    labelled = [(i, text(40) + " " + " ".join(TURN.choice(bad if i % 3 == 0 else good) for _ in range(4))) for i in range(1000, 1600)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in labelled] + [(5000, None, 0), (None, 1, 0), (1000, 1, 0)], "doc_id long, quality int, toxic int")
    rows = ODD + labelled
    docs = frame(spark, rows)
    model = quality_rules.fit_quality_model(docs, labels)
    got = quality_rules.score(docs, model).collect()
    for (i, t), r in zip(rows, got, strict=True):
        w = words(t)
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)
    hit = [r.kept == (r.doc_id % 3 != 0) for r in got if r.doc_id is not None and 1000 < r.doc_id < 1600]
    assert sum(hit) > 0.95 * len(hit)
    kept = quality_rules.filter_documents(docs, labels)
    assert kept.schema == docs.schema and kept.count() == sum(r.kept for r in got)
    assert quality_rules.fit_quality_model(docs, labels.where("toxic = 5")) is None
    assert quality_rules.score(empty(spark), model).count() == 0
    shuffled = quality_rules.fit_quality_model(frame(spark, [*reversed(rows), (1001, "another text of this id")]).repartition(7), labels)
    assert shuffled.shape == model.shape and (shuffled == quality_rules.fit_quality_model(frame(spark, [*rows, (1001, "another text of this id")]), labels)).all()


def test_quality_verdicts_by_brute_force(spark):
    """Probabilities from sets of n-grams, one text at a time."""
    rows = [(i, text(30) + (" vile scum" if i % 4 == 0 else " kind fine") + ("" if i % 3 else " ÄÖ x")) for i in range(300)] + [(900, ""), (901, None), (902, "one"), (903, "ab " * 40)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    model = quality_rules.fit_quality_model(docs, labels)
    bits = quality_rules.SLOTS.bit_length() - 1
    word_hash = lambda w: Words([w], lower=True).hashes
    for (_, t), r in zip(rows, quality_rules.score(docs, model).collect(), strict=True):
        data = (t or "").encode().lower() + b"\n"
        ws = [w.encode() for w in words((t or "").translate(LOW))]
        kinds = [
            {int(word_hash(w)[0]) >> 64 - bits for w in ws} | {int(window_hash(np.concatenate([word_hash(a), word_hash(b)]), 2)[0]) >> 64 - bits for a, b in zip(ws, ws[1:])},
            {(int.from_bytes(data[j : j + 5], "little") * 0x9E3779B97F4A7C15) % 2**64 >> 64 - bits for j in range(len(data))},
        ]
        for head, p in zip(model.astype(np.float64), (r.p_fine, r.p_clean)):
            z = sum(sum(head[k] for k in kind) / max(len(kind), 1) ** 0.25 for kind in kinds)
            bias, slope, shift = head[quality_rules.SLOTS :]
            assert p == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, slope * (z + bias) + shift)))), rel=1e-6)
        assert r.kept == (not r.base_failed and r.p_fine >= 0.25 and r.p_clean >= 0.3)


def test_quality_training_is_bounded(spark, monkeypatch):
    """Longest texts and those past the bytes of all are not learnt from; the rest is as if they were not labelled."""
    rows = [(i, text(20) + (" vile" if i % 2 else " kind")) for i in range(200)] + [(500, text(3000) + " vile")]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in [*range(200), 500]], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality_rules, "TRAIN_TEXT_BYTES", 2000)
    without = quality_rules.fit_quality_model(frame(spark, rows), labels.where("doc_id < 500"))
    assert (quality_rules.fit_quality_model(frame(spark, rows), labels) == without).all()
    monkeypatch.setattr(quality_rules, "TRAIN_BYTES", 0)
    assert quality_rules.fit_quality_model(frame(spark, rows), labels) is None


def test_few_telling_ngrams():
    """A slot in every row of one class and none of the other counts, one that both hold alike does not."""
    packed = [quality_rules.squeeze(np.array([3, 1, 1 + i % 2, 8 - i % 2 + i % 5], np.int32).tobytes()) for i in range(40)]
    assert quality_rules.unpack_row(packed[1])[0].tolist() == [1, 3, 11]
    some, all_alike = quality_rules.telling(packed, np.stack([np.arange(40) % 2 * 1.0, np.ones(40)]), np.arange(40))
    assert set(np.flatnonzero(some)) == {2, 3} and all_alike.all()
    half = quality_rules.telling(packed, (np.arange(40) % 2 * 1.0)[None], np.arange(0, 40, 2))[0]
    assert half.all()  # one class only among these


def test_importance_sampling(spark):
    rows = ODD + [(i, text(60) if i % 4 else " ".join(f"junk{TURN.randint(0, 50)}" for _ in range(60))) for i in range(100, 700)]
    docs = frame(spark, rows)
    target = spark.createDataFrame([(i,) for i in range(101, 400, 2)] + [(None,)], "doc_id long")
    got = importance_sampling.resample(docs, target, 0.5).collect()
    assert len(got) == math.ceil(len(rows) / 2)
    assert sum(r.doc_id is not None and r.doc_id >= 100 and r.doc_id % 4 == 0 for r in got) < 8
    # the models and keys by brute force: counts of n-grams by their slots
    slot_of = lambda *ws: int(importance_sampling.ngram_slots([" ".join(ws).encode()])[0][-1])
    memo = {}
    grams = lambda t: [memo.setdefault(g, None) or memo.update({g: slot_of(*g)}) or memo[g] for ws in [words((t or "").translate(LOW))] for n in (1, 2) for g in zip(*[ws[k:] for k in range(n)], strict=False)]
    chosen = {r.doc_id for r in target.collect()} - {None}
    of = [(i, grams(t)) for i, t in rows]
    raw, aim = Counter(g for _, gs in of for g in gs), Counter(g for i, gs in of if i in chosen for g in gs)
    n_raw, n_aim = sum(raw.values()), sum(aim.values())
    ratio = lambda g: math.log((aim[g] + 1) / (n_aim + importance_sampling.SLOTS)) - math.log((raw[g] + 1) / (n_raw + importance_sampling.SLOTS))
    noise = {r.doc_id: r.g for r in docs.select("doc_id", (-F.log(-F.log((F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 52)) + 0.5) / float(1 << 52)))).alias("g")).collect()}
    want = sorted(((sum(map(ratio, gs)) + noise[i], str(i), sum(map(ratio, gs))) for i, gs in of), reverse=True)[: len(got)]
    assert [(i, round(w, 6), round(k, 6)) for k, i, w in want] == [(str(r.doc_id), round(r.log_weight, 6), round(r.key, 6)) for r in sorted(got, key=lambda r: (-r.key, str(r.doc_id)))]
    few = importance_sampling.slot_counts(docs.select("doc_id", "text"), target, target_rows=3)
    assert 0 < few[0].sum() < n_aim and few[1].sum() == n_raw
    same = spark.createDataFrame([(None if i % 3 == 0 else (i - 900) << 40 if i % 3 == 1 else 7, 0.0, 1.0) for i in range(9000)], "doc_id long, log_weight double, key double")
    for k in (2999, 3500, 4400, 7000):
        want = sorted(((r.doc_id is not None, r.doc_id or 0) for r in same.collect()))[:k]
        assert sorted((r.doc_id is not None, r.doc_id or 0) for r in importance_sampling.top_k(same, k).collect()) == want
    keyed = spark.createDataFrame([(i, 0.0, float(i % 7)) for i in range(3000)], "doc_id long, log_weight double, key double")
    for k in (0, 1, 430, 2999, 3000, 5000):
        want = sorted(((-(i % 7), i) for i in range(3000)))[:k]
        assert sorted((-r.key, r.doc_id) for r in importance_sampling.top_k(keyed, k).collect()) == want
    assert importance_sampling.resample(empty(spark), target, 0.5).count() == 0
    assert importance_sampling.resample(docs, target.limit(0), 1.0).count() == len(rows)


def test_sharding(spark):
    def plain(shards, m):
        table, turn = [None] * m, [0] * len(shards)
        orders = []
        for s in shards:
            start, stride = sharding.preference(s, m)
            orders.append([(start + stride * k) % m for k in range(m)])
        while None in table:
            for i in range(len(shards)):
                while turn[i] < m and table[orders[i][turn[i]]] is not None:
                    turn[i] += 1
                if turn[i] < m:
                    table[orders[i][turn[i]]] = i
        return table

    for n, m in ((1, 2), (3, 13), (7, 101)):
        assert sharding.fill_table(SHARDS[:n], m) == plain(SHARDS[:n], m)
    counts = Counter(sharding.fill_table(SHARDS, 6421))
    assert max(counts.values()) - min(counts.values()) <= 1
    with pytest.raises(ValueError):
        sharding.fill_table(SHARDS, 6400)
    less = sharding.fill_table(SHARDS[:-1], 6421)
    moved = sum(a != b for a, b in zip(sharding.fill_table(SHARDS, 6421), less, strict=True))
    assert moved < 6421 * 0.1
    rows = frame(spark).withColumn("shard", F.lit("old"))
    got = sharding.place(rows, "doc_id", SHARDS)
    assert got.count() == len(ODD) and len({r.shard for r in got.where("doc_id IS NULL").collect()}) == 1
    assert dict(got.dtypes)["shard"] == "int" and sharding.place(empty(spark), "doc_id", SHARDS).count() == 0
    plain_slots = sorted(r.slot for r in sharding.place(frame(spark), "key", SHARDS).collect())
    for name in ("shard", "slot"):  # a key with a result's name gives way to the result
        named = sharding.place(frame(spark).withColumnRenamed("key", name), name, SHARDS)
        assert sorted(r.slot for r in named.collect()) == plain_slots and named.columns.count(name) == 1


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = token_output.write_and_read(frame(spark), path, end_id=2).collect()
    want, at = {}, 0
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted([i for i, _ in ODD], key=lambda i: (i is not None, i or 0))
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
        want.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    for i, t in ODD:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) in want[i]
    assert token_output.write_and_read(empty(spark), path, end_id=2).count() == 0


def test_pieces_encode_as_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tok, turn = Tokenizer.from_file(path), random.Random(9)
    parts = ["a", "  ", "\n", " ", "\t", "é", "'s", "12", "!!", " x", "\r\n", "日本", "　", "don't", "<|endoftext|>", ".", ",", "|", "Ā", "é", " .", "x.", "Kö,", "\x85", "\x1c", "_", "-a"]
    for _ in range(2000):
        t = "".join(turn.choice(parts) for _ in range(turn.randint(0, 12)))
        assert token_output.encode_texts(path, [t])[0].tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_byte_code():
    turn = random.Random(2)
    for n in (0, 1, 3, 4, 5, 1001):
        v = np.array([turn.choice([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1]) for _ in range(n)], np.uint32)
        assert (token_output.unpack(*token_output.pack(v), n) == v).all()
    ids, counts, values = token_output.parse_file(token_output.file_bytes([None, 3], [1, 2], np.array([7, 300, 9], np.uint32)))
    assert ids == [None, 3] and counts.tolist() == [1, 2] and values.tolist() == [7, 300, 9]


def test_piece_codec(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    codec, model = piece_codec.PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    score = {model.id_to_piece(i): model.get_score(i) for i in ids}

    def brute(t):
        w = (" " + t).replace("▁", "\ud800").replace(" ", "▁") if t else ""
        best = [0.0] + [-1e300] * len(w)
        for e in range(1, len(w) + 1):
            best[e] = max([best[e - 1] + codec.unknown, *(best[s] + score[w[s:e]] for s in range(max(0, e - 20), e) if w[s:e] in score)])
        return best[-1]

    def own(found):
        raw = b"".join(codec.piece[i] for i in found if model.is_byte(int(i)))
        return sum(model.get_score(int(i)) for i in found if not model.is_byte(int(i))) + len(raw.decode("utf-8", "surrogatepass")) * codec.unknown

    turn = random.Random(6)
    parts = ["a", "  ", " ", "\n", "é", "日本", "▁", "the ", "ion", "\0", "𝄞", "​", "\t", ".", "   ", "E", "straße"]
    for _ in range(1500):
        t = "".join(turn.choice(parts) for _ in range(turn.randint(0, 9)))
        found = codec.encode(t).tolist()
        assert codec.decode(np.array(found, np.uint32)) == t
        assert abs(own(found) - brute(t)) < 1e-6 * max(1, abs(brute(t)))
    encoded = piece_codec.encode(frame(spark), path)
    assert encoded.where("NOT round_trip").count() == 0
    assert sorted((str(r.doc_id), r.text) for r in piece_codec.decode(encoded, path).collect()) == sorted((str(i), t or "") for i, t in ODD)
    assert piece_codec.digest(empty(spark), path).count() == 0


def test_license_scan(spark):
    rows = [
        (1, "Released under the MIT License.\nother"), (2, "code Under-the MIT license, cc by nc CC BY NC"), (3, "GNU General Public License version 3 this work is licensed under"), (4, None), (5, ""), (6, "apache license\nversion 2"),
        (7, "mit license"), (7, "mit license"), (None, "cc BY nc"), (8, ("word " * 3000) + "under the mit license"), (9, "underthe mit license"),
    ]
    got = {}
    for r in license_scan.scan(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert got[1] == [(6, 1, 1, 1, "mit", "mit", 1.0)]
    assert got[2][0][:6] == (11, 3, 1, 8, "cc-by-nc,mit", "cc-by-nc,mit")
    assert got[3][0][1] == 0 and got[3][0][5] == "gpl-3" and got[3][0][6] == pytest.approx(11 / 12)
    assert got[4] == got[5] == [(0, 0, None, None, "", "", 0.0)]
    assert got[6][0][1:6] == (1, 0, 0, "apache-2", "apache-2")
    assert len(got[7]) == 2 and got[7][0][4:] == ("", "", 0.0)
    assert got[None][0][4] == "cc-by-nc" and got[8][0][2] == 3000 and got[9][0][1] == 0
    assert license_scan.scan(empty(spark)).count() == 0
    kelvin = license_scan.scan(frame(spark, [(1, "this wor\u212a is licensed under the GNU general public license version 3")])).first()
    assert kelvin.n_words == 12 and kelvin.score == pytest.approx(11 / 12)  # only A-Z is lowered


def test_license_notices_of_several_lines(spark):
    gpl = "This program is free software you can redistribute it\n * under the terms of the GNU General Public License"
    strewn = "this program is free software you can redistribute it under the terms of the gnu general public license".split()
    far = "filler words " * 12
    rows = [
        (1, gpl), (2, f"{text(400)}\n# {gpl}\r\n{text(300)}"), (3, far.join(f" {w} " for w in strewn)),
        (4, " ".join(TURN.choice(strewn + ["x"] * 60) for _ in range(4000))), (5, f"{'word ' * 5000}{gpl} {'word ' * 5000}".replace("\n", " ")),
        (6, "this program is free software (really) you can redistribute it\nunder the terms of\nthe licence gnu general\npublic"), (7, "\n".join(strewn)),
    ]

    def brute(t):
        w, labels, best = re.findall(license_scan.WORD, (t or "").translate(LOW)), set(), 0.0
        for template, label in license_scan.TEMPLATES:
            own, wide = set(template.split()), math.ceil(len(template.split()) / license_scan.LEAST)
            most = max((len(own & set(w[i : i + wide])) for i in range(len(w))), default=0)
            if most >= license_scan.LEAST * len(own):
                labels.add(label)
                best = max(best, most / len(own))
        return ",".join(sorted(labels)), best

    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}
    assert got[1] == got[2] == got[5] == got[7] == ("gpl", 1.0) and got[3] == ("", 0.0) and got[6][0] == "gpl"


def edit(a, b):
    """Least distance of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[-1] + 1))
    return min(row)


def test_least_distance():
    """Random short cases against plain edit distance."""
    turn, cases = random.Random(12), 0
    for _ in range(1500):
        item = "".join(turn.choice("abc ") for _ in range(turn.randint(17, 40)))
        t = list(item)
        for _ in range(turn.randint(0, 4)):
            at = turn.randrange(len(t))
            t[at : at + 1] = turn.choice([["c"], [], [t[at], "b"]])
        doc = decontamination.normal("".join(turn.choice("abc ") for _ in range(20)) + "".join(t) + "".join(turn.choice("abc ") for _ in range(20)))
        item = decontamination.normal(item)
        found = list(decontamination.Matcher([(1, item)], 0.12).find(doc))
        least = edit(item, doc)
        assert [f[1] for f in found] == ([least] if least <= int(len(item) * 0.12) else [])
        cases += len(found)
    assert cases > 300


def test_word_hashes():
    """Words that differ in any byte, or in length only, have different hashes; Thue-Morse words too."""
    from lorekeep.llm.common import Words

    morse = [bytes(97 + (bin(i).count("1") + k) % 2 for i in range(1024)) for k in (0, 1)]
    kinds = [b"a" * n for n in range(1, 80)] + [b"b" * k + b"c" + b"b" * (40 - k) for k in range(41)] + morse
    found = Words([b" ".join(kinds), b" ".join(reversed(kinds))], lower=False)
    assert len(set(found.hashes.tolist())) == len(kinds) and found.hashes[: len(kinds)].tolist() == found.hashes[len(kinds) :][::-1].tolist()


def test_decontamination(spark):
    turn = random.Random(4)
    items = [(k, text(30, turn)) for k in range(12)] + [(90, None), (91, "..."), (92, "short one"), (93, text(30, turn)), (0, "again the same id with other words in it")]
    rows = list(ODD)
    for i in range(60):
        t = list(turn.choice(items[:12])[1])
        for _ in range(turn.randint(0, 14)):
            at = turn.randrange(len(t))
            t[at : at + 1] = turn.choice([["q"], [], [t[at], "z"]])
        rows.append((100 + i, text(20, turn) + " " + "".join(t).replace("t", "T") + ", " + text(20, turn)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_leaks(frame(spark, rows), bench).collect()
    norm = [(i, decontamination.normal(t)) for i, t in items]
    want = set()
    for d, t in rows:
        if d is not None and (100 <= d < 200):
            for i, item in norm:
                distance = edit(item, decontamination.normal(t)) if item else 99
                if item and distance <= int(len(item) * decontamination.ERRORS):
                    want.add((d, i, distance))
    assert {(r.doc_id, r.item_id, r.distance) for r in got if r.doc_id is not None and 100 <= r.doc_id < 200} == want and len(want) > 20
    texts, by_id = dict((i, decontamination.normal(t)) for i, t in rows), {}
    for i, t in norm:
        by_id.setdefault(i, []).append(t)
    for r in got:  # the passage that is told ends where it says, and lies round its start
        part = texts[r.doc_id][max(0, r.start - 20) : r.end] if r.doc_id is not None and 100 <= r.doc_id < 200 else None
        if part is not None:
            assert 0 <= r.start < r.end and min(edit(t[::-1] + "\0", part[::-1]) for t in by_id[r.item_id]) <= r.distance + 1
            assert min(edit(t, part) for t in by_id[r.item_id]) == r.distance
    kept = decontamination.drop_leaks(frame(spark, rows), bench)
    leaked = {r.doc_id for r in got}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d not in leaked)
    assert decontamination.find_leaks(empty(spark), bench).count() == 0
    assert decontamination.find_leaks(frame(spark), bench.limit(0)).count() == 0
