"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from auctra.llm import spelling_fm

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs):
    """(doc_id, text) to sorted rows (word, form, root, n, n_near, form_n)."""
    n = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    by = {}
    for w in n:
        for i in range(len(w) + 1):
            by.setdefault((i, w[:i], w[i + 1 :]), set()).add(w)
            by.setdefault((i, w[:i], w[i:]), set()).add(w)
    form, count = {}, {}
    for w in n:
        found = {v for i in range(len(w) + 1) for k in ((i, w[:i], w[i + 1 :]), (i, w[:i], w[i:])) for v in by[k] if v != w and near(v, w)}
        best = min(found, key=lambda v: (-n[v], v), default=None)
        count[w], form[w] = len(found), best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_index_finds_all_near_words():
    rng = random.Random(1)
    for letters in ("ab", "abcé", "abcdefgh"):
        make = lambda more="": "".join(rng.choice(letters + more) for _ in range(rng.randint(5, 9)))  # noqa: E731, B023
        words = sorted({make() for _ in range(250)})
        asked = words + [make("zÿ") for _ in range(60)]
        index = spelling_fm.WordIndex(words)
        got = [(i, j) for suffix in (False, True) for i, j in zip(*(x.tolist() for x in index.near(asked, suffix)))]
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if a != b and near(a, b)}


def test_index_states_are_synchronous():
    """Left and right steps in any order end in the same ranks and count the occurrences."""
    words = ["abab", "baba", "aabb", "bbaa", "abba"]
    index = spelling_fm.WordIndex(words)
    text = "\n" + "\n".join(words) + "\n"
    for pattern in ("ab", "ba", "abb", "aba", "bbb"):
        codes = index.coded([pattern])[0][0][:-1]
        ends = []
        for middle in range(len(pattern) + 1):
            s = index.start(1)
            for c in codes[middle:]:
                s = index.step(s, np.array([c]), True)
            for c in codes[:middle][::-1]:
                s = index.step(s, np.array([c]), False)
            ends.append(tuple(s[0]) if s[0, 2] else None)
        count = sum(text.startswith(pattern, i) for i in range(len(text)))
        assert len(set(ends)) == 1 and (ends[0][2] if ends[0] else 0) == count


@pytest.mark.parametrize("bucket_words", [150, 4096])
def test_variants_equal_brute_force(spark, bucket_words):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(100).collect()]
    rng = random.Random(3)
    stems = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 7))) for _ in range(120)]
    docs += [(1000 + i, " ".join(rng.choice(stems) for _ in range(40))) for i in range(60)]
    long = "x" * 150 + "y" * 150
    docs += [(1, None), (2, ""), (3, "12 -- Привет"), (None, "Straße straße STRASSE " * 4), (None, "Straße straße STRASSE " * 4), (5, "ÀÉÎÕÜ àéîõü " * 5), (6, f"{long} {long}z {long[1:]} x{long[2:]} {'x' * 255} {'x' * 256} {'x' * 254} " * 3)]
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in docs], "doc_id long, text string, n int, word string")
    got = rows_of(spelling_fm.variants(df, bucket_words=bucket_words))
    assert got == brute_variants(docs)
    assert any(r[1] for r in got) and any(r[1] and r[2] != r[1] for r in got) and any(len(r[0]) > 256 and r[4] for r in got)


def test_hot_starts_are_cut_into_parts(spark):
    words = [f"aaaa{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    docs = [(i, " ".join([w] * (3 + i % 9))) for i, w in enumerate(words)]
    assert rows_of(spelling_fm.variants(spark.createDataFrame(docs, "doc_id long, text string"), bucket_words=16)) == brute_variants(docs)


def test_empty_table(spark):
    assert rows_of(spelling_fm.variants(spark.createDataFrame([], "doc_id long, text string"))) == []
