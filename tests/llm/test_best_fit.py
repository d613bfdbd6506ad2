"""Best-fit packing: round trip of ids, bins of the genetic search, its gain over plain best fit."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from auctra.llm import grouping_genetic as gga

PATH = public_tokenizers.path("word_bpe_49k.json")


def uses_up(bins, hist, window):
    used = Counter()
    for b, n in bins.items():
        assert n > 0 and 0 < gga.fill(b) <= window and all(c > 0 for _, c in b)
        for k, c in b:
            used[k] += c * n
    return used == Counter(hist)


def triplets(n, rng):
    hist = Counter()
    for _ in range(n):
        a = rng.randint(380, 490)
        b = rng.randint(250, (1000 - a) // 2)
        hist.update([a, b, 1000 - a - b])
    return dict(hist)


def cases():
    rng = random.Random(1)
    return {
        "triplets": (triplets(60, rng), 1000),
        "middle": (dict(Counter(rng.randint(300, 1200) for _ in range(20_000))), 2048),
        "few": (dict(Counter(rng.randint(500, 1000) for _ in range(900))), 2048),
        "alike": ({700: 10**9, 300: 10**9, 1: 7}, 2048),
    }


def test_operators_keep_every_piece():
    rng = random.Random(4)
    for hist, window in cases().values():
        a, b = (gga.best_fit({}, hist, window, sorted(hist, key=lambda k: -k * rng.uniform(0.4, 1))) for _ in range(2))
        for _ in range(20):
            a, b = gga.cross(a, b, hist, window, rng), gga.mutate(b, hist, window, rng)
            assert uses_up(a, hist, window) and uses_up(b, hist, window)
        assert gga.from_text(gga.to_text(a)) == a


def test_crossover_keeps_injected_bins_and_exchange_fills():
    hist = {600: 2, 500: 2, 400: 2, 300: 2}
    father = {((600, 1), (400, 1)): 2, ((500, 1), (300, 1)): 2}
    mother = {((600, 1), (300, 1)): 2, ((500, 1), (400, 1)): 2}
    child = gga.cross(mother, father, hist, 1000, random.Random(0))
    assert uses_up(child, hist, 1000) and child.get(((600, 1), (400, 1)), 0) >= 1
    assert gga.exchanged({((500, 1), (300, 1)): 1}, {450: 1}, 1000) == ({((500, 1), (450, 1)): 1}, {300: 1})


def test_islands_beat_best_fit(spark):
    for name, (hist, window) in cases().items():
        plain, least = gga.fitness(gga.best_fit({}, hist, window))[0], gga.lower_bound(hist, window)
        found = gga.search(spark, hist, window)
        assert uses_up(found, hist, window) and least <= gga.fitness(found)[0] <= plain
        if name != "alike":
            assert plain - gga.fitness(found)[0] >= 0.3 * (plain - least) > 0
    assert gga.search(spark, hist, window) == found  # the same again
    assert gga.search(spark, {}) == {}


def test_places_are_gapless():
    hist, window = cases()["few"]
    bins = gga.best_fit({}, hist, window)
    seen = {}
    for k, lo, hi, first, per, at in gga.places(bins):
        for rank in range(lo, hi):
            seen.setdefault(first + (rank - lo) // per, []).append((at + (rank - lo) % per * k, k))
    assert len(seen) == sum(bins.values())
    for parts in seen.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))] and sum(p[1] for p in parts) <= window


def test_packing_round_trip(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(900, None), (901, ""), (None, "null id"), (902, "A, b. <|endoftext|> it's É. x., ÿ"), (902, "again"), (903, "word " * 9000), (904, "word " * 2047), (905, "word " * 2048), docs[0]]
    df = spark.createDataFrame([(i, t, 7, "p") for i, t in docs], "doc_id long, text string, length int, piece string").repartition(5)
    tok = Tokenizer.from_file(PATH)
    want = sorted((str(i), np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in docs)
    rows, by, seq = gga.pack(df, PATH).collect(), {}, {}
    for r in rows:
        by.setdefault(r.row_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    got = []
    for parts in by.values():
        parts.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in parts] == [(k, 2048 * k) for k in range(len(parts))] and all(r.length == 2048 for r in parts[:-1])
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length for r in parts)
        got.append((str(parts[0].doc_id), b"".join(bytes(r.ids) for r in parts)))
    assert sorted(got) == want
    for parts in seq.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))] and sum(r.length for r in parts) <= 2048
    assert len(seq) <= 1.01 * sum(r.length for r in rows) / 2048 + 1
    assert gga.pack(df.limit(0), PATH).count() == 0


def test_new_words_of_several_texts_are_encoded_together(monkeypatch):
    tokens, tok, calls = gga._pieces_udf.__globals__["WordTokens"](PATH), Tokenizer.from_file(PATH), []
    learn = tokens._learn
    monkeypatch.setattr(tokens, "_learn", lambda words: calls.append(1) or learn(words))
    texts = ["One two, three.", None, "", "two FOUR <|endoftext|> It's É. x., ÿ", "five " * 50]
    assert tokens.encode_all(texts) == [np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts] and len(calls) == 1
    assert tokens.encode_all(texts) == [tokens.encode(t) for t in texts] and len(calls) == 1
