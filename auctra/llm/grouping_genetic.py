"""Operator 12, best-fit packing: a grouping genetic algorithm on islands.

Documents' token ids, ended by ``eos``, stay whole up to a window; longer ones are cut into windows and a rest. Whole windows are sequences of their own.
What is left is packed into as few windows as can be found.

Pieces of equal length are alike, so an individual groups lengths, not documents: it is a list of bins (how many pieces of each length)
with the number of times that each is used, at most a few bins per length (window - 1 lengths), whatever the number of documents. Crossover injects whole
well-filled bins of one parent, takes away the other parent's bins that hold a document once more, lets displaced documents take the place of smaller ones where a bin gets
fuller, and puts the rest where they fit best. Mutation empties the worst and some other bins. Of two individuals that with fewer bins is fitter, then that with the larger sum of squared fills.
Islands are groups of a Spark table; after each epoch it is written, and the elite of every island migrates to the next. Random numbers depend on (island, epoch) only,
so a lost task evolves the same. The search ends early when the lower bound is met.

Documents then get their places by rank among the pieces of their length, in buckets of ``BUCKET_ROWS``, so that copies of one length spread over tasks.

Defined results: a null or empty text has the one token ``eos``. Repeated rows are packed each on their own; which of several pieces of one length takes a place is
decided by the row's number. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import random
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from auctra.llm.common import batches_of, materialise
from auctra.llm.nnls_pack import _pieces_udf
from auctra.tables import discard

WINDOW, EOS = 2048, 0
ISLANDS, MEMBERS, EPOCHS, GENERATIONS = 6, 8, 5, 16
#: Rows of a (length, bucket) in ranking.
BUCKET_ROWS = 4096

#: A bin is ((length, count), ..), longest first; bins are used a number of times.
Bin = tuple[tuple[int, int], ...]
Bins = dict[Bin, int]


def fill(b: Bin) -> int:
    return sum(k * c for k, c in b)


def fitness(bins: Bins) -> tuple[int, int]:
    """Less is fitter: bins, then minus the sum of squared fills."""
    return sum(bins.values()), -sum(n * fill(b) ** 2 for b, n in bins.items())


def lower_bound(hist: dict[int, int], window: int) -> int:
    return max(-(-sum(k * n for k, n in hist.items()) // window), sum(n for k, n in hist.items() if 2 * k > window))


def best_fit(bins: Bins, left: dict[int, int], window: int, order: list[int] | None = None) -> Bins:
    """Adds the pieces ``left`` ({length: count}) where they leave least room, opening bins where none has room; equal steps at once."""
    rooms: list[Bins] = [{} for _ in range(window + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for b, n in bins.items():
        rooms[r := window - fill(b)][b] = n
        open_rooms |= 1 << r
    for k in order or sorted(left, reverse=True):
        n = left[k]
        while n:
            above = open_rooms >> k
            r = k + (above & -above).bit_length() - 1 if above else window
            b, times = rooms[r].popitem() if above else ((), n)
            per = min(r // k, n)
            here = min(times, n // per)
            if times > here and above:
                rooms[r][b] = times - here
            elif above and not rooms[r]:
                open_rooms ^= 1 << r
            counts = dict(b)
            counts[k] = counts.get(k, 0) + per
            grown, rest = tuple(sorted(counts.items(), reverse=True)), r - per * k
            rooms[rest][grown] = rooms[rest].get(grown, 0) + here
            open_rooms |= 1 << rest
            n -= here * per
    return {b: n for group in rooms for b, n in group.items()}


def exchanged(bins: Bins, left: dict[int, int], window: int) -> tuple[Bins, dict[int, int]]:
    """Displaced pieces take the place of one or two smaller ones where the bin still holds them: fuller bins, smaller pieces left."""
    left, out = dict(left), {}
    lengths = sorted(left)
    for b, times in bins.items():
        room = window - fill(b)
        goes = [(k,) for k, _ in b] + [(k, m) for i, (k, c) in enumerate(b) for m in [x for x, _ in b[i + (c == 1) :]]] if room else []
        for away in goes:
            size = sum(away)
            i = bisect_right(lengths, size + room) - 1
            if times and i >= 0 and lengths[i] > size:
                k = lengths[i]
                n = min(times, left[k])
                counts = Counter(dict(b))
                counts.subtract(away)
                counts[k] += 1
                fuller = tuple(sorted(((x, c) for x, c in counts.items() if c), reverse=True))
                out[fuller] = out.get(fuller, 0) + n
                times -= n
                left[k] -= n
                if not left[k]:
                    del left[k], lengths[i]
                for x in away:
                    if x not in left:
                        insort(lengths, x)
                    left[x] = left.get(x, 0) + n
        if times:
            out[b] = out.get(b, 0) + times
    return out, left


def _kept(bins: list[tuple[Bin, int]], left: dict[int, int], out: Bins) -> None:
    """Moves bins to ``out`` as often as their pieces are still left."""
    for b, times in bins:
        n = min(times, min(left[k] // c for k, c in b))
        if n > 0:
            out[b] = out.get(b, 0) + n
            for k, c in b:
                left[k] -= n * c


def cross(mother: Bins, father: Bins, hist: dict[int, int], window: int, rng: random.Random) -> Bins:
    """Well-filled bins of the father, then the mother's bins without their pieces, then the displaced pieces by best fit."""
    good = sorted(father.items(), key=lambda x: -fill(x[0]))
    good = good[: max(1, int(len(good) * rng.uniform(0.2, 0.9)))]
    injected = rng.sample(good, max(1, int(len(good) * rng.uniform(0.2, 0.7))))
    left, child = dict(hist), {}
    _kept(injected, left, child)
    _kept(sorted(mother.items(), key=lambda x: -fill(x[0])), left, child)
    return best_fit(*exchanged(child, {k: n for k, n in left.items() if n}, window), window)


def mutate(bins: Bins, hist: dict[int, int], window: int, rng: random.Random) -> Bins:
    """Empties the least filled bins and some others, and packs their pieces anew."""
    worst = sorted(bins, key=fill)[: max(2, len(bins) // 50)]
    gone = {*worst, *rng.sample(list(bins), max(1, len(bins) // 50))}
    left, child = dict(hist), {}
    _kept([x for x in bins.items() if x[0] not in gone], left, child)
    child, left = exchanged(child, {k: n for k, n in left.items() if n}, window)
    return best_fit(child, left, window, sorted(left, key=lambda k: -k * rng.uniform(0.7, 1)))


def evolve(members: list[Bins], hist: dict[int, int], window: int, seed: int, generations: int = GENERATIONS, size: int = MEMBERS) -> list[Bins]:
    """The island's next population, fittest first; without members it is founded by best fit in perturbed orders of length."""
    rng, least = random.Random(seed), lower_bound(hist, window)
    while len(members) < size:
        spread = 0 if not members else rng.uniform(0, 0.6)
        members = [*members, best_fit({}, hist, window, sorted(hist, key=lambda k: -k * rng.uniform(1 - spread, 1)))]
        if fitness(members[-1])[0] == least:
            return [members[-1]]
    ranked = sorted(((fitness(m), i, m) for i, m in enumerate(members)), key=lambda x: x[:2])
    for g in range(generations):
        if ranked[0][0][0] == least:
            break
        pick = lambda: min(rng.sample(range(len(ranked)), 2))  # noqa: E731  the fitter of two
        i, j = pick(), pick()
        child = cross(ranked[i][2], ranked[j][2], hist, window, rng) if i != j else mutate(ranked[i][2], hist, window, rng)
        if rng.random() < 0.3:
            child = mutate(child, hist, window, rng)
        f = fitness(child)
        if all(f != r[0] for r in ranked):
            ranked = sorted([*ranked, (f, len(members) + g, child)], key=lambda x: x[:2])
        ranked = ranked[:size]
    return [m for _, _, m in ranked[:size]]


def to_text(bins: Bins) -> str:
    return json.dumps([[n, *(x for pair in b for x in pair)] for b, n in bins.items()])


def from_text(text: str) -> Bins:
    return {tuple(zip(row[1::2], row[2::2])): row[0] for row in json.loads(text)}


def search(spark: SparkSession, hist: dict[int, int], window: int = WINDOW, islands: int = ISLANDS, epochs: int = EPOCHS) -> Bins:
    """The fittest bins for the pieces of ``hist`` ({length: count}, lengths below the window) that the islands find."""
    if not hist:
        return {}
    least = lower_bound(hist, window)
    fields = "island int, epoch int, bins long, square long, genome string"

    def island(pdf: pd.DataFrame) -> pd.DataFrame:
        number, epoch = int(pdf["island"].iloc[0]), int(pdf["epoch"].max()) + 1
        members = [from_text(x) for x in dict.fromkeys(pdf["genome"].dropna())]
        members = sorted(members, key=lambda m: (fitness(m), to_text(m)))
        made = evolve(members, hist, window, 1_000_003 * epoch + number)
        return pd.DataFrame([(number, epoch, *fitness(m), to_text(m)) for m in made], columns=["island", "epoch", "bins", "square", "genome"])

    people = spark.range(islands).select(F.col("id").cast("int").alias("island"), F.lit(-1).alias("epoch"), F.lit(None).cast("string").alias("genome"))
    best, written = F.row_number().over(W.partitionBy("island").orderBy("bins", "square", "genome")), []
    for epoch in range(epochs):
        people = materialise(people.repartition(islands, "island").groupBy("island").applyInPandas(island, fields), "pack-islands")
        written.append(people)
        if epoch == epochs - 1 or people.where(F.col("bins") == least).limit(1).count():
            break
        elite = people.withColumn("r", best).where("r = 1").withColumn("island", ((F.col("island") + 1) % islands).cast("int"))
        people = people.select("island", "epoch", "genome").unionByName(elite.select("island", "epoch", "genome"))
    found = written[-1].orderBy("bins", "square", "genome").first()
    for table in written:
        discard(table)
    return from_text(found["genome"])


def places(bins: Bins) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, first, per, at): pieces of a length with ranks from lo to hi go to sequences from ``first`` on, ``per`` in each, from offset ``at``."""
    used, first = {}, 0
    for b, times in sorted(bins.items()):
        at = 0
        for k, c in b:
            lo = used.get(k, 0)
            used[k] = lo + c * times
            yield k, lo, used[k], first, c, at
            at += c * k
        first += times


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, eos: int = EOS, with_ids: bool = True, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """One row per piece: doc_id, row_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset.

    ``tokenizer`` is the path of a tokenizers file, present on every executor. Whole windows have negative sequence ids.
    """
    spark = docs.sparkSession
    made = docs.select("doc_id", F.monotonically_increasing_id().alias("row_id"), _pieces_udf(tokenizer, window, 1, eos, with_ids)(F.col("text")).alias("p"))
    made = made.select("doc_id", "row_id", F.explode("p").alias("p"))
    with batches_of(spark, "2m"):
        made = materialise(made.select("doc_id", "row_id", F.floor(F.col("p.start") / window).cast("int").alias("piece"), "p.*", F.monotonically_increasing_id().alias("piece_id")), "best-fit-pieces")
    columns = ["doc_id", "row_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    whole = made.where(F.col("length") == window).select(*columns, (-1 - F.col("piece_id")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = made.where(F.col("length") < window)

    hist = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}  # window - 1 lengths at most
    slots = list(places(search(spark, hist, window, islands, epochs)))
    names = ["length", "lo", "hi", "first", "per", "at"]
    slots = spark.createDataFrame(pa.table({c: pa.array([x[i] for x in slots], pa.int64()) for i, c in enumerate(names)}))
    dealt = spark.createDataFrame(pa.table({"length": pa.array(list(hist), pa.int64()), "buckets": pa.array([math.ceil(n / BUCKET_ROWS) for n in hist.values()], pa.int64())}))
    rest = rest.join(F.broadcast(dealt), "length").withColumn("bucket", F.pmod(F.xxhash64("piece_id"), F.col("buckets")))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = materialise(rest.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "best-fit-offsets")
    ranked = rest.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy("piece_id")) - 1)
    ranked = ranked.join(offsets, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(slots), "length").where("rank >= lo AND rank < hi")
    q = F.col("rank") - F.col("lo")
    placed = placed.select(*columns, (F.col("first") + F.floor(q / F.col("per"))).alias("sequence_id"), (F.col("at") + q % F.col("per") * F.col("length")).alias("offset"))
    return whole.unionByName(placed)
