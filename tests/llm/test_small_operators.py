"""Edge cases and brute-force versions: URL rules, licences, top-k, mixing, line windows, archives."""

from __future__ import annotations

import hashlib
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from auctra.llm import bit_sliced, license_digest, line_windows, poisson_mix, queries, url_rules, warc_index
from tests.oracle import differences

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    assert differences(queries.queries()[name](spark, sf_dir), sf_dir, queries.oracle_sql()[name]) == []


def test_url_rules_edges(spark):
    rules = queries.URL_RULES
    urls = ["http://x.org/a", "HTTP://A.ORG/", "http://org", "http://www.example.org/es/1", "http://example.org/en/12", "https://a.com/de/7?x=1#f", None, "no scheme", "", "http://", "http://notorg/", "http://a.net/de/3"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls * 3)], "page_id long, url string, host string")
    got = {}
    for row in url_rules.judge(df, rules).collect():
        got.setdefault(row["row"].page_id % len(urls), set()).add((row.judged.host, row.judged.rule, row.judged.verdict))
    assert all(len(v) == 1 for v in got.values())
    one = {k: next(iter(v)) for k, v in got.items()}
    assert one[0] == ("x.org", "org/", "allow") and one[1] == ("a.org", "org/", "allow") and one[3][1:] == ("example.org/es/", "block") and one[4][1:] == ("example.org/en/1", "block")
    assert one[2][1] is None and one[5][1:] == ("com/de/", "block") and one[10][1] is None
    assert one[6] == one[7] == one[8] == ("", None, "allow")
    assert url_rules.judge(df.limit(0), rules).count() == 0
    assert df.select(F.max(F.size(url_rules.tokens_of(F.col("url"))))).first()[0] <= url_rules.FAMILIES


def test_license_forms(spark):
    mit = license_digest.TEXTS["MIT"]
    spelled = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(" ", "  ").replace("SUBLICENSE", "sub-licence") + "\n"
    rows = [(1, mit), (2, spelled), (3, mit + " and more"), (4, "Text.\nReleased under the MIT License.\nReleased under the MIT Licence"), (5, None), (6, ""), (7, "x" * 200_000), (1, mit)]
    got = license_digest.scan(spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, digest string, license string")).collect()
    by = {r.doc.doc_id: r for r in got}
    assert len(got) == 8 and by[1].license == by[2].license == "MIT" and by[1].digest == by[2].digest
    assert by[3].license is None and list(by[4].notices) == ["MIT"] and by[5].digest is None and by[6].license is None
    assert license_digest.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_and_titled_licenses(spark):
    folder = Path(license_digest.__file__).with_name("licenses")
    full = {p.stem: p.read_text(encoding="utf-8") for p in folder.glob("*.txt")}
    assert set(full) == {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0"}
    clauses, rest = license_digest.BSD.split("3. Neither")
    bsd2, owner = clauses + rest[rest.index("THIS SOFTWARE IS") :], "Copyright (c) 2021, Somebody and others\nAll rights reserved.\n\n"
    texts = license_digest.TEXTS
    cases = [
        ("MIT", f"MIT License\n\n{owner}{texts['MIT']}"), ("MIT", f"# The MIT License (MIT)\n\n{owner}{texts['MIT'].upper()}"), ("ISC", f"ISC Licence\n{owner}{texts['ISC']}"),
        ("Zlib", f"zlib License\n\n(C) 2020 Somebody\n\n{texts['Zlib'].replace('acknowledgment', 'acknowledgement')}"),
        ("BSD-2-Clause", f"BSD 2-Clause License\n\n{owner}{bsd2}"), ("BSD-2-Clause", owner + bsd2.replace("1. ", " * ").replace("2. ", " * ").replace("HOLDER OR", "OWNER OR")),
        ("BSD-3-Clause", owner + license_digest.BSD), ("BSD-3-Clause", f"BSD 3-Clause Licence\n\n{owner}{license_digest.BSD.replace('the copyright holder', 'the author')}"),
        ("Apache-2.0", full["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2022 Somebody")), ("Apache-2.0", full["Apache-2.0"].split("   APPENDIX")[0]),
        ("GPL-2.0-only", full["GPL-2.0-only"].split("\t    How to Apply")[0]), ("MPL-2.0", f"Mozilla Public License 2.0\n\n{full['MPL-2.0']}"),
        *full.items(), *((k, "  " + re.sub(r"\bLICENSE\b", "Licence", x.upper()).replace(",", " ,").replace("\n", "\r\n")) for k, x in full.items()),
        (None, full["GPL-3.0-only"][:-2000]), (None, "MIT License"), (None, f"Other License\n\n{texts['MIT']}"),
    ]
    got = license_digest.scan(spark.createDataFrame(list(enumerate(x for _, x in cases)), "doc_id long, text string")).collect()
    assert [r.license for r in sorted(got, key=lambda r: r.doc.doc_id)] == [k for k, _ in cases]


def test_top_k_is_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.3, 0.0, 0.1, 0.25]) for _ in range(3)]) for i in range(400)]
    rows += [(1000 + i, [0.1, 0.1, 0.1]) for i in range(150)]  # a large group of ties
    rows += [(None, [0.1] * 3), (2001, None), (2002, [0.1, None, 0.1]), (2003, [float("nan")] * 3), (2004, [float("inf")] * 3), (3000, [0.5] * 4), (3050, [0.5] * 4), (50, rows[50][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in bit_sliced.top_k(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for q in {i for i, _ in usable if i % 50 == 0}:
        v = min(v for i, v in usable if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v))[:5]
        assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert bit_sliced.top_k(df.limit(0)).count() == 0


def test_mixing(spark):
    rows = [(i, f"t{i}", "en", "big" if i < 900 else "small" if i < 990 else None, 2) for i in range(1000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", copy_no int")
    got = poisson_mix.mix(df, {"big": 0.0, "small": 1.0}).collect()
    assert {r.doc.source for r in got} == {"small", None}
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)
    n = sum(r.doc.source == "small" for r in got)
    assert abs(n - 500) < 5 * math.sqrt(500)  # mean rate 1 / 2 * 1000 / 90
    assert sum(r.doc.source is None for r in got) > 350  # mean 50: two Poisson parts
    again = poisson_mix.mix(df, {"big": 0.0, "small": 1.0}).select("doc.doc_id", "copy_no").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in poisson_mix.mix(df.repartition(7), {"big": 0.0, "small": 1.0}).select("doc.doc_id", "copy_no").collect())
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 4, DOCS)
    assert poisson_mix.mix(nulls, {}).count() % 4 == 0
    assert poisson_mix.mix(nulls.limit(0), {}).count() == 0


def brute_lines(docs: list[tuple]) -> dict:
    """(doc_id, text) to cleaned text, for distinct pairs."""
    seen, gone = set(), {}
    for i, t in sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is None, d[0] or 0, d[1])):
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(x.strip(" \t\n\r\x0b\x0c") for x in w):
                if w in seen:
                    gone.setdefault((i, t), set()).update((p, p + 1, p + 2))
                seen.add(w)
    return {(i, t): t if (i, t) not in gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[(i, t)]) for i, t in docs if t is not None}


def test_line_windows(spark):
    rng = random.Random(5)
    docs = [(i, "\n".join(rng.choice("abcd ") for _ in range(rng.randint(0, 12)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "a\nb"), (103, "a\na\na\na"), (None, "q\nr\ns"), (104, "q\nr\ns\nt"), (105, "\n\n\n\n\n"), (5, docs[5][1]), (106, "\n".join(str(i) for i in range(30_000)))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, lines string, gone int")
    got = line_windows.dedup_lines(df).collect()
    want = brute_lines(docs)
    assert len(got) == len(docs)
    for r in got:
        assert r.text == (want[(r.doc.doc_id, r.doc.text)] if r.doc.text is not None else None)
    assert line_windows.dedup_lines(df.limit(0)).count() == 0


def test_archives(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/\r\nx", big), (2, "http://b/", big), (3, None, None), (4, "u", "small"), (5, "u", "small"), (None, "n", big), (6, "v", "a\r\n\r\nb"), (7, "w", "ü\x00" * 300_000), (4, "u", "small")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    folder = f"file://{tmp_path}/warc"
    index = warc_index.write_archives(df, folder, file_bytes=2000)
    got = warc_index.read_records(index, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [(u, h or "") for i, u, h in rows if i == r.page_id]
        size, digest = {(len(h.encode()), hashlib.sha1(h.encode()).hexdigest()) for _, h in mine}.pop()
        assert (r.payload_bytes, r.payload_digest) == (size, digest)
        assert (r.record_type, r.refers_to, r.payload) == (("revisit", 2, None) if r.page_id == 1 else ("response", None, mine[0][1]))
    assert index.select("file").distinct().count() > 1
    some = warc_index.read_records(index.where("page_id = 6"), folder).collect()
    assert [r.payload for r in some] == ["a\r\n\r\nb"]
    empty = f"file://{tmp_path}/none"
    assert warc_index.read_records(warc_index.write_archives(df.limit(0), empty), empty).count() == 0


def test_canonical_form_meets_neighbours_and_line_ends(spark):
    from auctra.llm.license_digest import canonical_lines, digest_of

    same = [
        ("a licence licence b", "a license license b"), ("the sub\nlicence of", "the sub license of"), ("non\n * commercial use", "noncommercial use"), ("per\n\ncent", "percent"),
        ("copyright\nowner owner", "Copyright Holder holder"), ("while while while", "whilst whilst whilst"), ("licence\nlicence", "License, LICENSE"),
    ]
    rows = spark.createDataFrame(same, "a string, b string").select("a", *[digest_of(canonical_lines(x)).alias(n) for x, n in ((F.col("a"), "p"), (F.col("b"), "q"))]).collect()
    assert [r.a for r in rows if r.p != r.q] == []
    again = spark.createDataFrame(same, "a string, b string").select(F.array_join(canonical_lines(F.col("a")), "\n").alias("c")).select("c", F.array_join(canonical_lines(F.col("c")), "\n").alias("d")).collect()
    assert all(r.c == r.d for r in again)
