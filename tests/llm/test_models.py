"""Language field, quality estimates, near-duplicate join, packing and the pipeline against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from auctra.llm import language_crf, ngram_rtree, nnls_pack, quality
from tests.llm.test_small_operators import DOCS, brute_lines

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = language_crf.train(language_crf.sample(docs))
    got = language_crf.identify(docs.withColumnRenamed("n_chars", "score"), field).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.doc.lang == r.lang_pred for r in held) >= 0.98 * len(held) > 0
    edge = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "12 ..", "en"), (None, "the " * 50_000, None), (5, "x" * 50_000, "en")], "doc_id long, text string, lang string")
    rows = {r.doc.doc_id: r for r in language_crf.identify(edge, field).collect()}
    assert [(rows[i].lang_pred, rows[i].score) for i in (1, 2, 3)] == [("und", 0.0)] * 3 and rows[None].lang_pred == "en" and not rows[None].held_out
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert language_crf.identify(edge.limit(0)).count() == 0
    assert {r.lang_pred for r in language_crf.identify(edge.selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()} == {"und"}
    mixed = "the and that with for " * 3 + "der und nicht mit ein " * 3
    spans = spark.createDataFrame([(mixed,)], "text string").select(language_crf.span_labeller(spark, field)("text").alias("s")).first().s
    assert [s["lang"] for s in spans] == ["en", "de"]


def test_repeated_rows_leave_the_sample_unchanged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    one = docs.where("lang IS NOT NULL").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id")).select("doc_id", "text", "lang")
    often = docs.unionByName(one.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("i"))
    assert language_crf.sample(docs) == language_crf.sample(often)
    two = spark.createDataFrame([(1, "ein Text", "de"), (1, "noch ein anderer", "de"), (1, "ein Text", "de")], "doc_id long, text string, lang string")
    assert sorted(w for _, w in language_crf.sample(two)) == [["ein", "text"], ["noch", "ein", "anderer"]]


def test_words_are_letters():
    assert language_crf.words_of("① Ⅷ ½ 12_3 ²") == [] and language_crf.words_of("Ab①cd Ünder x²") == ["ab", "cd", "ünder", "x"] and language_crf.words_of(None) == []


def test_marginals_equal_one_pass():
    rng = np.random.default_rng(1)
    field = language_crf.Field(["a", "b", "c"], {f"={w}": i for i, w in enumerate("uvwxyz")}, rng.normal(size=(6, 3)), rng.normal(size=(3, 3)))
    texts = [["u"], list("uvwxyz" * 40), list("zzyx"), list("u" * 65)]
    for words, m in zip(texts, field.marginals(texts)):
        e, move = field.emissions(words), np.exp(field.moves)
        a, b = [e[0] / e[0].sum()], [np.ones(3)]
        for t in range(1, len(words)):
            x = (a[-1] @ move) * e[t]
            a.append(x / x.sum())
        for t in range(len(words) - 1, 0, -1):
            x = move @ (e[t] * b[-1])
            b.append(x / x.sum())
        want = np.array(a) * np.array(b[::-1])
        assert np.allclose(m, want / want.sum(1, keepdims=True))


def brute_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    times, covered = {}, set()
    for i in range(len(words) - 2):
        times.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in times.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def brute_quality(rows):
    """(lang, source, text) to verdicts, by numpy over lists."""
    counts = [brute_counts(t) for _, _, t in rows]
    failed = [c[0] < 50 or 100 * c[4] > 50 * c[0] for c in counts]
    half_up = lambda x: math.floor(x + 0.5)
    vec = lambda c: [half_up(256 * x) for x in (math.log(c[1] / c[0]), math.log1p(1000 * c[2] / c[1]), math.log1p(100 * c[3] / c[0]), math.log1p(100 * c[4] / c[0]))]
    groups = {}
    for (lang, source, _), c, f in zip(rows, counts, failed):
        if not f:
            for g in ((lang, source), (lang, "*"), ("*", "*")):
                groups.setdefault(g, []).append(vec(c))
    floors, fits = np.array(quality.FLOORS) * 256, {}
    fix = quality.ALPHA / quality.chi2_cdf(quality.chi2_quantile(1 - quality.ALPHA, 4), 6)
    for g, v in groups.items():
        if len(v) < quality.MIN_ROWS:
            continue
        v = np.array(v, float)
        low = np.sort(v, 0)
        at = lambda q: low[math.ceil(q * len(v)) - 1]
        sd, ridge = np.sqrt(((at(0.75) - at(0.25)) / 1.349) ** 2 + floors**2), np.diag(floors**2)
        z = (v - at(0.5)) / sd
        size = np.sqrt((z**2).sum(1, keepdims=True))
        u = np.divide(256 * z, size, out=np.zeros_like(z), where=size > 0)
        u = np.sign(u) * np.floor(np.abs(u) + 0.5) / 256
        starts = [(at(0.5), np.diag(sd**2)), (v.mean(0), np.cov(v.T, bias=True) + ridge), (at(0.5), 4 * (u.T @ u) / len(v) * np.outer(sd, sd) + ridge)]
        ends = []
        for mean, cov in starts:
            best = math.inf
            while True:
                b = np.floor(128 * np.log2(1 + np.einsum("ij,jk,ik->i", v - mean, np.linalg.inv(cov), v - mean)))
                near = v[b <= np.sort(b)[math.ceil(quality.ALPHA * len(v)) - 1]]
                next_cov = fix * np.cov(near.T, bias=True) + ridge
                if not np.linalg.slogdet(next_cov)[1] < best - 1e-9:
                    break
                mean, cov, best = near.mean(0), next_cov, np.linalg.slogdet(next_cov)[1]
            ends.append((best, len(ends), mean, np.linalg.inv(cov)))
        mean, inv = min(ends, key=lambda x: x[:2])[2:]
        fits[g] = mean, inv
    out = []
    for (lang, source, _), c, f in zip(rows, counts, failed):
        fit = next((fits[g] for g in ((lang, source), (lang, "*"), ("*", "*")) if g in fits), None)
        d = None if f or fit is None else float((np.array(vec(c)) - fit[0]) @ fit[1] @ (np.array(vec(c)) - fit[0]))
        out.append((c, f, not f and (d is None or d <= quality.chi2_quantile(quality.TAIL, 4))))
    return out


def test_quality_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    want = brute_quality([(d.lang, d.source, d.text) for d in docs])
    got = {r.doc_id: r for r in quality.quality_verdicts(spark.createDataFrame(docs)).collect()}
    for d, (c, f, k) in zip(docs, want):
        assert (tuple(got[d.doc_id].counts), got[d.doc_id].base_failed, got[d.doc_id].kept) == (c, f, k)
    assert 0 < sum(f for _, f, _ in want) and any(not f and not k for _, f, k in want)


def test_start_that_finds_the_least_determinant(spark):
    """Two clouds, the larger one spread wide in the statistic that the smaller is not: the end has the least determinant of all three searches."""
    rng = random.Random(8)
    rows = [(i, "en", "s", (400, 400 * 5 + rng.randint(-40, 40), rng.choice([0, 0, 1, 2]), 0, rng.randint(0, 60))) for i in range(300)]
    rows += [(300 + i, "en", "s", (400, 400 * 8 + rng.randint(-10, 10), rng.randint(20, 24), 12, 100 + rng.randint(0, 5))) for i in range(90)]
    counted = spark.createDataFrame(rows, "doc_id long, lang string, source string, counts struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long>")
    verdicts = {r.doc_id: r.kept for r in quality.score(counted, *quality.fit(counted)).collect()}
    assert not any(verdicts[i] for i in range(300, 390)) and sum(verdicts[i] for i in range(300)) >= 290


def test_quality_edges(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b c " * 100, "en", None, 1), (2, "a b c " * 100, "en", None, 1), (3, " ".join(map(str, range(20_000))), None, "s", 1)]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], DOCS + ", counts int, centre string")
    got = quality.quality_verdicts(df)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.kept) for r in got.collect()) == [(False, 1, False), (False, 2, False), (False, 2, False), (False, 3, True), (True, 0, False)]
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [3]
    assert quality.keep_good(df.limit(0)).count() == 0


def test_each_statistic_rejects_alone(spark):
    rng = random.Random(6)
    word = lambda size=6: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(size - 2, size + 2)))
    text = lambda words, per=8: "\n".join(" ".join(words[i : i + per]) for i in range(0, len(words), per))
    clean = [text([word() for _ in range(200)]) for _ in range(300)]
    clean += [x + "\n" + x.split("\n")[0] for x in clean[:20]]  # one line twice
    some = [word() for _ in range(30)]
    planted = [
        text([word() for _ in range(140)] + some + some, 7),  # 30 % repeated words
        text([word(9) for _ in range(200)]),  # long words
        text([word() + ("#$" if i % 8 == 0 else "") for i in range(200)]),  # symbols
        "\n".join(f"{word()} {word()}\nnext" for _ in range(70)),  # a short line over and over, no phrase twice
    ]
    counts = [brute_counts(x) for x in planted]
    assert counts[0][4] == 60 and counts[0][3] < 6 and all(c[4] == 0 for c in counts[1:]) and counts[3][3] == 69 and [c[2] > 0 for c in counts] == [False, False, True, False]
    df = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(clean + planted)], DOCS)
    got = {r.doc_id: r for r in quality.quality_verdicts(df).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [i for i, r in sorted(got.items()) if not r.kept] == list(range(len(clean), len(clean) + len(planted)))


def shingles(text, n):
    words = [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute_components(docs, n, pct):
    sets = [(i, shingles(t, n)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            same = sets[a][0] is not None and sets[a][0] == sets[b][0]
            if same or s and t and 100 * len(s & t) >= pct * len(s | t):
                root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return [(i, len(s), least.get(find(x))) for x, (i, s) in enumerate(sets)]


def test_near_join_equals_brute_force(spark):
    rng = random.Random(9)
    docs, words = [], [f"w{i}" for i in range(300)]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 9, 20, 80, 300]))]
        for _ in range(rng.randint(1, 12)):
            docs.append((len(docs), " ".join(rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.05]) else w for w in base)))
    docs += [(900, None), (901, ""), (902, "Solo"), (903, "solo"), (904, "a b"), (None, "a B"), (905, docs[0][1]), (905, docs[0][1]), (None, "unique text of nobody else"), (906, "z " * 30_000)]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, size int, digest string")
    for n, pct in ((4, 85), (1, 50), (5, 80)):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_rtree.near_components(df, n, pct).collect()), key=str)
        assert got == sorted(brute_components(docs, n, pct), key=str)
    left = ngram_rtree.keep_one(df, 4, 85)
    want = [c for c in {c for i, k, c in brute_components(docs, 4, 85) if i is not None and k}] + [900, 901]
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(want)
    assert ngram_rtree.near_components(df.limit(0)).count() == 0


def near_copies(rng, base, n, rate):
    return [" ".join(w if rng.random() > rate else f"x{rng.random()}" for w in base) for _ in range(n)]


def test_tree_below_a_large_family(spark, monkeypatch):
    """Small pages, own pages and several nodes; copies that are partly linked to the hub and partly not."""
    monkeypatch.setattr(ngram_rtree, "OWN_PAGES", 8)
    rng = random.Random(2)
    texts = near_copies(rng, [f"w{i}" for i in range(60)], 40, 0.02) + near_copies(rng, [f"v{i}" for i in range(90)], 40, 0.035)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for page_docs, node_pages in ((4, 2), (2, 3)):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_rtree.near_components(df, 2, 80, page_docs, node_pages).collect())
        assert got == sorted(brute_components(docs, 2, 80))


def test_tree_prunes_without_loss(spark):
    """One family of clusters in several sizes: the tree opens every pair of pages that holds a link, and few others."""
    rng = random.Random(3)
    docs = [t for k in range(12) for t in near_copies(rng, [f"c{k}.{i}" for i in range(rng.choice([100, 115, 130]))], 8, 0.004)]
    rows = [(1, -1, i, i, len(s := ngram_rtree.shingle_set(t, 2)), bytearray(ngram_rtree.point_of(s).tobytes())) for i, t in enumerate(docs)]
    members = spark.createDataFrame(rows, "family long, bin long, nid long, component long, size long, point binary")
    pages = ngram_rtree.leaf_pages(members, page_docs=4, node_pages=2)
    page_of = {m.nid: p.page for p in pages.collect() for m in p.members}
    opened = {frozenset((r.page, r.page_b)) for r in ngram_rtree.tree_pairs(pages, 85).collect()}
    sets = [ngram_rtree.shingle_set(t, 2) for t in docs]
    pairs = {frozenset(x) for x in ngram_rtree.page_joins(pages, 85).collect()}
    assert {frozenset((a, b)) for a in range(len(docs)) for b in range(a) if ngram_rtree._similar(sets[a], sets[b], 85)} <= pairs
    linked = {frozenset((page_of[a], page_of[b])) for a in range(len(docs)) for b in range(a) if ngram_rtree._similar(sets[a], sets[b], 85)}
    n = len(set(page_of.values()))
    assert n >= 24 and {x for x in linked if len(x) == 2} <= opened and len(opened) < 0.4 * n * (n - 1) / 2


def test_points_of_large_sets_bound_overlap():
    rng = np.random.default_rng(4)
    s = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    for keep in (0.5, 0.9, 1.0):
        t = np.unique(np.concatenate([s[: int(keep * len(s))], rng.integers(0, 2**63, 900).astype(np.uint64)]))
        a, b = ngram_rtree.point_of(s)[None, :], ngram_rtree.point_of(t)[None, :]
        n = min(a.shape[1], b.shape[1])
        bound = int(ngram_rtree.overlaps(ngram_rtree.folded(a, n), ngram_rtree.folded(b, n))[0, 0])
        both = len(np.intersect1d(s, t))
        assert a.shape[1] == 4096 and a.sum() == len(s) and both <= bound < both + 0.25 * len(s)


def test_one_doc_id_with_two_texts_beside_a_repeated_row(spark):
    rng = random.Random(5)
    a, b, c = ([f"{k}{i}" for i in range(80)] for k in "abc")
    a2, b2, c2 = (" ".join([*x[:-1], "other"]) for x in (a, b, c))
    a, b, c = map(" ".join, (a, b, c))
    docs = [(2, b), (2, c), (3, b2), (4, c2), (1, a), (1, a), (9, a2), (None, a2), (None, "no copy of anything"), (None, "no copy of anything")]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_rtree.near_components(df, 4, 85).collect()), key=str)
    assert got == sorted(brute_components(docs, 4, 85), key=str)
    kept = sorted(((r.doc_id, r.text) for r in ngram_rtree.keep_one(df, 4, 85).collect()), key=str)
    assert [x for x in kept if x[0] != 2] == [(1, a), (None, "no copy of anything")] and [x[0] for x in kept].count(2) == 1 and len(kept) == 3


def test_long_text_of_distinct_words(spark):
    words = [f"w{i}" for i in range(50_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:-500])), (3, " ".join(words[25_000:])), (4, "short")]
    got = {r.doc_id: r.component_id for r in ngram_rtree.near_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_plan_uses_up_the_histogram():
    rng = random.Random(4)
    hist = {k: rng.randint(1, 500) for k in [*range(1, 64), *range(64, 4096, 64), 4096]}
    used, room = {}, 0
    plan = nnls_pack.plan(hist)
    for per, times in plan:
        assert 0 < sum(k * c for k, c in per.items()) <= 4096
        room += (4096 - sum(k * c for k, c in per.items())) * times
        for k, c in per.items():
            used[k] = used.get(k, 0) + c * times
    assert used == hist and room < 0.002 * sum(k * c for k, c in hist.items())
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    assert np.allclose(nnls_pack.nnls(a, np.array([3.0, -1.0])), [3, 0, 0])
    assert nnls_pack.plan({}) == []


def check_packed(rows, docs, limit=4096):
    """Every id in one piece, sequences gapless; docs: list of (doc_id, text), one for each row of the input."""
    tok = Tokenizer.from_file(PATH)
    want = sorted((str(i), np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in docs)
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.row_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    got = []
    for parts in by.values():
        parts.sort(key=lambda r: r.start)
        assert [r.start for r in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.doc_tokens == sum(q.length for q in parts) for r in parts)
        got.append((str(parts[0].doc_id), b"".join(bytes(r.ids) for r in parts)))
    assert sorted(got) == want
    for parts in seq.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))] and sum(r.length for r in parts) <= limit


def test_packing_round_trip(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(900, None), (901, ""), (None, "null id"), (902, "A, b. <|endoftext|> it's É. x., ÿ"), (902, "again"), (903, "word " * 9000), docs[0]]
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, length int")
    check_packed(nnls_pack.pack(df, PATH).collect(), docs)
    assert nnls_pack.pack(df.limit(0), PATH).count() == 0


def test_pipeline_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(d.doc_id, d.text, d.lang, d.source) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    verdicts = brute_quality([(x, s, t) for _, t, x, s in docs])
    docs = [d for d, (_, _, k) in zip(docs, verdicts) if k]
    clean = brute_lines([(i, t) for i, t, _, _ in docs])
    docs = [(i, clean[(i, t)], x, s) for i, t, x, s in docs if clean[(i, t)] == t or clean[(i, t)]]
    keep = {i for i, _, c in brute_components([(i, t) for i, t, _, _ in docs], 5, 80) if i == c}
    docs = [d for d in docs if d[0] in keep]
    n = {}
    for d in docs:
        n[d[3]] = n.get(d[3], 0) + 1
    weight = {s: corpus_pipeline.WEIGHTS.get(s, 1.0) for s in n}
    import hashlib

    mixed = []
    for i, t, _, s in docs:
        rate = weight[s] / sum(weight.values()) * len(docs) / n[s]
        u = int(hashlib.md5(f"count1|{i}|1".encode()).hexdigest()[:13], 16) / 2**52
        k, p, c = 0, math.exp(-rate), math.exp(-rate)
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        mixed += [(i, t)] * k
    assert [x for x, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "mixing", "packing"]
    check_packed(corpus_pipeline.run(spark, sf).collect(), mixed)


def test_pipeline_stages_take_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, "a\nb\nc\nd", "en", None, None)], DOCS)
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            assert name == "packing" or out.columns == df.columns
            out.collect()


def test_pipeline_results_stay_and_nothing_else(spark):
    """Two runs and two stages are readable side by side; after release the shared folder holds nothing of them."""
    from pathlib import Path

    from auctra.tables import discard, shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    sf = "/root/testdata/sf0.001"
    a, b = corpus_pipeline.run(spark, sf), corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = corpus_pipeline.line_stage(spark, docs, sf)
    near = corpus_pipeline.near_stage(spark, docs, sf)
    assert a.count() == b.count() > 0 and lines.count() > 0 and near.count() > 0
    assert not [p for p in set(folder.iterdir()) - before if "-stage-" in p.name]
    for table in (a, b, lines, near):
        discard(table)
    assert set(folder.iterdir()) <= before


def test_likeliest_pairs_of_pages_grow_with_their_members():
    rng = np.random.default_rng(8)
    common = rng.integers(0, 2**63, 180).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, 12).astype(np.uint64)])) for _ in range(70)]
    members = [{"nid": i, "component": i, "point": ngram_rtree.point_of(s).tobytes()} for i, s in enumerate(sets)]
    a, b = members[:40], members[40:]
    for other, n in ((b, 70), (None, 80)):
        every, best = ngram_rtree.page_pairs(a, other, 85), ngram_rtree.page_pairs(a, other, 85, best=True)
        assert set(best) <= set(every) and len(best) <= n < len(every)
        assert {x for p in best for x in p} == {x for p in every for x in p}
