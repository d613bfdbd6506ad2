"""Token alignment and pair bitmaps against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from auctra.llm import token_pairs

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "\n", "a", " lead", "trail ", "two  blanks   three", "line\nend\n\nmore \n x", "tab\tand\r\nreturn", "nb sp   em", "<|endoftext|> <s> </s> <unk> <0x41>", "▁literal", "naïve Straße İ 日本語 \U0001f600", "it's we'll 12345 ...!!", "x" * 700, "ctrl\x00\x1c\x1d y", "é ﬁ ½", "a\x1c \x1cb .\x1c,"]


def brute_tokens(text):
    """((a, start, end) .., (b, start, end) ..) or None."""
    tok, sp = brute_tokens.tok, brute_tokens.sp
    letters = token_pairs.byte_letters()
    data = (" " + text).encode()
    a = [(i, bytes(letters[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
    if not text or b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
        return None
    out = []
    for side in (a, b):
        at, own = 0, []
        for i, x in side:
            own.append((i, at, at + len(x)))
            at += len(x)
        out.append(own)
    return out


brute_tokens.tok, brute_tokens.sp = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
brute_tokens.tok.encode_special_tokens = True


def brute(docs):
    found, held = [], Counter()
    for _, text in docs:
        sides = brute_tokens(text) if text else None
        if sides is None:
            found.append(None)
            continue
        a, b = sides
        links = Counter((i, j) for i, s, e in a for j, t, f in b if s < f and t < e)
        both = sorted({e for _, _, e in a} & {e for _, _, e in b})
        shown, lo = [], 0
        for hi in both:
            part = lambda side: ",".join(str(i) for i, s, e in side if lo <= s and e <= hi)  # noqa: E731, B023
            shown.append(f"{part(a)}|{part(b)}")
            lo = hi
        found.append((len(a), len(b), len(both), links, hashlib.sha256(";".join(shown).encode()).hexdigest()))
        held.update(set(links))
    top = {}
    for (i, _), n in held.items():
        top[i] = max(n, top.get(i, 0))
    return [
        (d, 0, 0, 0, 0, 0, 0, "") if f is None
        else (d, *f[:3], sum(f[3].values()), sum(n for p, n in f[3].items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in f[3].items()), f[4])
        for (d, _), f in zip(docs, found)
    ]


def rows_of(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("entries", [500, 1_000_000])
def test_alignment_equals_brute_force(spark, monkeypatch, entries):
    monkeypatch.setattr(token_pairs, "BLOCK_ENTRIES", entries)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()
    docs = [(d.doc_id, d.text[:4000]) for d in rows] + [(1000 + i, t) for i, t in enumerate(ODD)]
    docs += [(7, None), (None, "a null id"), (None, "a null id"), (8, "again and again " * 200), (8, "again and again " * 200)]
    df = spark.createDataFrame([(i, t, 3, "k") for i, t in docs], "doc_id long, text string, n int, block string").repartition(3)
    got = rows_of(token_pairs.align_documents(df, A, B))
    assert got == sorted(brute(docs), key=str)
    assert any(r[1] == 0 for r in got) and any(r[5] < r[4] for r in got)
    assert rows_of(token_pairs.align_documents(df.limit(0), A, B)) == []


def test_pieces_give_the_tokens_of_whole_texts(monkeypatch):
    monkeypatch.setattr(token_pairs, "CACHED_PIECES", 50)
    aligner, rng = token_pairs.Aligner(A, B), random.Random(5)
    signs = " \n\t\r.,'\"!?-_<>|0123é日ß ▁\x1c\x00sdtm" + "etaoinshr" * 4 + "    \n"
    for k in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 60)))
        pieces = aligner.pieces(text)
        numbers = aligner.numbers(pieces)
        stats = aligner.new.stats[numbers]
        sides = brute_tokens(text)
        assert "".join(pieces) == " " + text and (stats[:, 3].all() == (sides is not None))
        if sides:
            assert stats[:, :2].sum(0).tolist() == [len(sides[0]), len(sides[1])]
            links = Counter(divmod(int(x), aligner.size_b) for x in aligner.new.links_of(numbers)[1])
            assert links == Counter((i, j) for i, s, e in sides[0] for j, t, f in sides[1] if s < f and t < e)


def test_bitmaps_round_trip_sparse_and_dense():
    rng = np.random.default_rng(2)
    want = {}
    for key in range(200):
        want[key] = np.flatnonzero(rng.random(5000) < rng.choice([0.0004, 0.01, 0.2, 0.9]))
    want = {k: d for k, d in want.items() if len(d)}
    of, docs = np.concatenate([np.full(len(d), k) for k, d in want.items()]), np.concatenate(list(want.values()))
    keys, n, maps = token_pairs.bitmaps(of, docs, 5000)
    row, doc = token_pairs.documents_in(maps, n)
    got = {int(keys[r]): np.sort(doc[row == r]) for r in range(len(keys))}
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() and n[list(keys).index(k)] == len(want[k]) for k in want)
    assert {len(m.as_py()) == 2 * c for m, c in zip(maps, n)} == {True, False}


def test_planes_count_links(spark):
    docs = [(i, "abc " * (i + 1)) for i in range(9)]
    aligned = token_pairs.align(spark.createDataFrame(docs, "doc_id long, text string"), A, B)
    got = {(r.a, r.b): (r.n_docs, r.n_links) for r in token_pairs.pair_scores(aligned).collect()}
    want, held = Counter(), Counter()
    for _, t in docs:
        a, b = brute_tokens(t)
        links = Counter((i, j) for i, s, e in a for j, t, f in b if s < f and t < e)
        want.update(links)
        held.update(set(links))
    assert got == {p: (held[p], want[p]) for p in want}
