"""Operator 11, cross-tokenizer alignment: inverted bitmaps of linked token pairs.

Every text, led by a blank, is encoded by two tokenizers A (a tokenizers file, byte level) and B (a sentencepiece model, which adds
the blank itself). Both cut the same bytes; offsets where both end a token part the text into groups, and an A and a B token whose
byte ranges overlap are linked.

Documents get numbers within blocks. For each block and pair of ids there is a compressed bitmap of the documents that hold the pair
linked, and a bitmap for each binary digit of (links in the document - 1) that is not zero anywhere: the multiplicity planes. A bitmap is a sorted array of 16-bit
numbers or, where that is shorter, plain bits. Bitmaps of one block are merged by OR as batches of texts come in; those of different blocks
are disjoint, so their union's population count is the sum of theirs. Counts per pair and the highest count per A id
return to the documents along the postings: each bitmap gives its count, weighted by its plane, to the documents in it.

Neither tokenizer joins across the beginning of white space, so texts are taken apart there and the alignment of every piece is remembered
(``Aligner``); the sums, links and texts of a batch are then gathered by number. A block is written once, so a lost executor costs no later renumbering.

Defined results: texts that are null or empty, or whose joined tokens differ from the blank and the text, have zeros and an empty digest. Every row is
a document of its own, also if its doc_id is null or repeated. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auctra.llm.common import batches_of, give_back, materialise

#: Entries (document, pair) and documents of a block.
BLOCK_ENTRIES, BLOCK_DOCS = 1_000_000, 1 << 16
#: Pieces, and bytes of their texts, in a worker's memory, by generation.
CACHED_PIECES, CACHED_BYTES = 200_000, 40_000_000

_PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_CUTS = re.compile(r"(?<=\S)(?=[ \n])")


def byte_letters() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pool:
    """Alignments by number: token and group counts, links and group texts."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.held, self.used = 0, 0
        self.stats = np.zeros((1024, 4), np.int64)  # n_a, n_b, n_groups, whether the bytes are the piece's
        self.at = np.zeros(1025, np.int64)  # links of piece i are links[at[i] : at[i + 1]]
        self.links = np.zeros(4096, np.uint64)

    def add(self, pieces: list[str], stats: np.ndarray, counts: np.ndarray, links: np.ndarray, texts: list[bytes]) -> None:
        n = len(self.texts)
        self.number.update(zip(pieces, range(n, n + len(pieces))))
        self.texts += texts
        self.held += sum(map(len, texts))
        while len(self.stats) < n + len(pieces):
            self.stats, self.at = np.concatenate([self.stats, np.zeros_like(self.stats)]), np.concatenate([self.at, np.zeros_like(self.at)])
        while len(self.links) < self.used + len(links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.stats[n : n + len(pieces)] = stats
        self.links[self.used : self.used + len(links)] = links
        self.at[n + 1 : n + len(pieces) + 1] = self.used + np.cumsum(counts)
        self.used += len(links)

    def links_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Link counts of the pieces and all their links in order."""
        counts = self.at[numbers + 1] - self.at[numbers]
        first = np.repeat(self.at[numbers] - (np.cumsum(counts) - counts), counts)
        return counts, self.links[first + np.arange(len(first))]


class Aligner:
    """Aligns the tokens of texts, piece by piece. A link is the number a * (size of B) + b."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings in texts are plain text
        letters, special = byte_letters(), {k for k, t in self.a.get_added_tokens_decoder().items() if t.special}
        spelled = {i: w for w, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [w.encode() if (i in special or w is None) else bytes(letters[c] for c in w) for i, w in ((i, spelled.get(i, "")) for i in range(max(spelled) + 1))]
        sp, self.size_b = self.b, self.b.get_piece_size()
        plain = lambda i: sp.id_to_piece(i).replace("▁", " ")
        self.b_bytes = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else plain(i).encode() for i in range(self.size_b)]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        normal = [plain(i) for i in range(self.size_b) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        #: Tokens that stand before a piece led by a line end; None if B may join across, so that texts stay whole.
        self.lead = sp.encode("\n") if not any("\n" in p or re.search("[^ ] ", p) for p in normal) else None
        show = lambda n, end: [b"%d%s" % (i, end) for i in range(n)]
        self.shown_a = show(len(self.a_bytes), b",") + show(len(self.a_bytes), b"|")
        self.shown_b = show(self.size_b, b",") + show(self.size_b, b";")
        self.new, self.old = Pool(), Pool()

    def pieces(self, text: str) -> list[str]:
        """The blank and the text, cut before white space that follows other characters."""
        text = " " + text
        if self.lead is None:
            return [text]
        return _CUTS.split(text) if _OTHER_SPACE.search(text) else _PIECES.findall(text)

    def _encode_b(self, pieces: list[str]) -> list[list[int]]:
        if self.lead is None:
            return self.b.encode([p[1:] for p in pieces], num_threads=1)
        n = len(self.lead)
        return [ids[n:] for ids in self.b.encode(["\n" + p for p in pieces], num_threads=1)]

    def _learn(self, pieces: list[str]) -> None:
        ids_a = [e.ids for e in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        ids_b = self._encode_b(pieces)
        joined = lambda table, ids: b"".join(map(table.__getitem__, ids))
        good = np.array([joined(self.a_bytes, x) == (data := p.encode()) == joined(self.b_bytes, y) for p, x, y in zip(pieces, ids_a, ids_b)], bool)
        if not good.all():
            ids_a, ids_b = ([x if g else [] for x, g in zip(ids, good)] for ids in (ids_a, ids_b))
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])  # bytes of all pieces in a row; every piece ends both
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        lo, hi = np.searchsorted(end_b, end_a - self.len_a[a], "right"), np.searchsorted(end_b - self.len_b[b], end_a, "left")
        per = hi - lo
        links = (np.repeat(a, per) * self.size_b + b[np.repeat(lo - (np.cumsum(per) - per), per) + np.arange(per.sum())]).astype(np.uint64)
        ends = np.cumsum(n_a)
        upto = lambda x: np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(x)])[ends]]))  # noqa: E731  sums over the A tokens of each piece
        last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
        n_groups = upto(last(group_a))
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        codes = np.concatenate([a + len(self.a_bytes) * last(group_a), b + self.size_b * last(group_b)])[order].tolist()
        shown = [self.shown_a[c] if of_a else self.shown_b[c] for c, of_a in zip(codes, (order < len(a)).tolist())]
        at = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        self.new.add(pieces, np.column_stack([n_a, n_b, n_groups, good]), upto(per), links, [b"".join(shown[i:j]) for i, j in zip(at, at[1:])])

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """Numbers in ``self.new`` of pieces; those not known are aligned, or taken over from the older generation."""
        if len(self.new.texts) > CACHED_PIECES or self.new.held > CACHED_BYTES:
            self.new, self.old = Pool(), self.new
        new, old = self.new, self.old
        missing = set(pieces).difference(new.number)
        if known := [p for p in missing if p in old.number]:
            i = np.array([old.number[p] for p in known], np.int64)
            counts, links = old.links_of(i)
            new.add(known, old.stats[i], counts, links, [old.texts[k] for k in i.tolist()])
            missing.difference_update(known)
        if missing:
            self._learn(list(missing))
        return np.fromiter(map(new.number.__getitem__, pieces), np.int64, len(pieces))


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(*paths: str) -> Aligner:
    if paths not in _aligners:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for one task
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


def bitmaps(of: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(key, population, bitmap) of each key; ``of`` and ``docs`` are sorted together and hold no pair twice."""
    start = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    n = np.diff(np.append(start, len(of)))
    width = (n_docs + 7) // 8
    dense = 2 * n > width
    sparse_rows = np.repeat(~dense, n)
    sizes = np.where(dense, 0, 2 * n)
    arrays = _binary(docs[sparse_rows].astype("<u2").tobytes(), sizes[~dense])
    at, made = np.flatnonzero(dense), []
    for k in range(0, len(at), 256):
        rows = at[k : k + 256]
        bits = np.zeros((len(rows), width * 8), bool)
        for i, r in enumerate(rows.tolist()):
            bits[i, docs[start[r] : start[r] + n[r]]] = True
        made.append(np.packbits(bits, 1, "little").tobytes())
    maps = pa.concat_arrays([arrays, _binary(b"".join(made), np.full(len(at), width))])
    rows = np.concatenate([np.flatnonzero(~dense), at])
    return of[start[rows]], n[rows], maps


def _binary(data: bytes, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def documents_in(maps: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, document) of every bit that is set; ``n``: the populations."""
    maps = pa.concat_arrays(maps.chunks) if isinstance(maps, pa.ChunkedArray) else maps
    offsets = np.frombuffer(maps.buffers()[1], np.int32)[maps.offset : maps.offset + len(maps) + 1].astype(np.int64)
    data, size = np.frombuffer(maps.buffers()[2] or b"", np.uint8), np.diff(offsets)
    sparse = size == 2 * n
    rows = np.repeat(np.flatnonzero(sparse), n[sparse])
    first = np.repeat(offsets[:-1][sparse] - 2 * (np.cumsum(n[sparse]) - n[sparse]), n[sparse]) + 2 * np.arange(len(rows))
    docs = data[first].astype(np.int64) | data[first + 1].astype(np.int64) << 8
    out = [(rows, docs)]
    for r in np.flatnonzero(~sparse).tolist():
        d = np.flatnonzero(np.unpackbits(data[offsets[r] : offsets[r + 1]], bitorder="little"))
        out.append((np.full(len(d), r), d))
    return np.concatenate([r for r, _ in out]), np.concatenate([d for _, d in out])


class Block:
    """Numbers documents and collects (pair, document, links) until it is given out."""

    def __init__(self, number: int):
        self.number, self.docs, self.entries = number, 0, 0
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, links: np.ndarray, docs: np.ndarray) -> None:
        keys, times = np.unique(links * np.uint64(BLOCK_DOCS) + docs.astype(np.uint64), return_counts=True)
        self.keys.append(keys)
        self.times.append(times)
        self.entries += len(keys)

    def postings(self, size_b: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(a, b, plane, population, bitmap): plane -1 has the documents, plane k digit k of their links less one."""
        if not self.entries:
            return
        keys, more = np.concatenate(self.keys), np.concatenate(self.times) - 1
        order = np.argsort(keys, kind="stable")
        keys, more = keys[order], more[order]
        of, docs = (keys // np.uint64(BLOCK_DOCS)).astype(np.int64), (keys % np.uint64(BLOCK_DOCS)).astype(np.int64)
        for plane in range(-1, int(more.max()).bit_length()):
            keep = slice(None) if plane < 0 else (more >> plane & 1).astype(bool)
            pair, n, maps = bitmaps(of[keep], docs[keep], self.docs)
            yield pair // size_b, pair % size_b, np.full(len(n), plane), n, maps


_POSTING = [("block", T.LongType()), ("a", T.IntegerType()), ("b", T.IntegerType()), ("plane", T.IntegerType()), ("n", T.IntegerType()), ("docs", T.BinaryType())]
_DOC = [("number", T.IntegerType()), ("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups_sha256", T.StringType())]
_ARROW = {"block": pa.int64(), "a": pa.int32(), "b": pa.int32(), "plane": pa.int32(), "n": pa.int32(), "docs": pa.binary(), "number": pa.int32(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string()}


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One table of two kinds of rows: documents (doc_id, block, number, counts, digest; a is null) and postings (block, a, b, plane, n, docs)."""
    kind = docs.schema["doc_id"]
    schema = T.StructType([T.StructField("doc_id", kind.dataType), *[T.StructField(*f) for f in [*_POSTING, *_DOC]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part = _aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        block, id_type = Block(part), None

        def rows(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            types = {"doc_id": id_type} | _ARROW
            return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(n, t) for c, t in types.items()], names=list(types))

        def given_out() -> Iterator[pa.RecordBatch]:
            for a, b, plane, n, maps in block.postings(aligner.size_b):
                yield rows(block=pa.array(np.full(len(n), block.number)), a=pa.array(a), b=pa.array(b), plane=pa.array(plane), n=pa.array(n), docs=maps)

        for batch in batches:
            id_type = batch.column("doc_id").type
            if block.entries > BLOCK_ENTRIES or block.docs + batch.num_rows > BLOCK_DOCS:
                yield from given_out()
                block = Block(block.number + 1)
            parts = [aligner.pieces(t) if t else [] for t in batch.column("text").to_pylist()]
            sizes = np.array([len(p) for p in parts], np.int64)
            numbers = aligner.numbers(list(chain.from_iterable(parts)))
            pool, at = aligner.new, np.concatenate([[0], np.cumsum(sizes)])
            sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(pool.stats[numbers], 0)])
            sums = sums[at[1:]] - sums[at[:-1]]
            good = (sums[:, 3] == sizes) & (sizes > 0)
            sums[~good] = 0
            counts, links = pool.links_of(numbers)
            doc_of = np.repeat(np.repeat(np.arange(len(sizes)), sizes), counts)
            keep = good[doc_of]
            doc_of, links = doc_of[keep], links[keep]
            text_of, order = pool.texts.__getitem__, numbers.tolist()
            sha = [hashlib.sha256(b"".join(map(text_of, order[i:j]))[:-1]).hexdigest() if g else "" for i, j, g in zip(at.tolist(), at[1:].tolist(), good.tolist())]
            block.add(links, block.docs + doc_of)
            named = {c: pa.array(sums[:, i]) for i, c in enumerate(("n_a", "n_b", "n_groups"))}
            yield rows(doc_id=batch.column("doc_id"), block=pa.array(np.full(len(sizes), block.number)), number=pa.array(block.docs + np.arange(len(sizes))), n_links=pa.array(np.bincount(doc_of, minlength=len(sizes))), groups_sha256=pa.array(sha), **named)
            block.docs += len(sizes)
            del batch
            give_back()
        if id_type is not None:
            yield from given_out()

    with batches_of(docs.sparkSession, "2m"):
        return materialise(docs.select("doc_id", "text").mapInArrow(run, schema), "pair-bitmaps")


def pair_scores(aligned: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, is_best) of every linked pair of ids."""
    weight = F.when(F.col("plane") < 0, F.col("n").cast("long")).otherwise(F.col("n") * F.expr("shiftleft(1L, plane)"))
    pairs = aligned.where("a IS NOT NULL").groupBy("a", "b").agg(F.sum(F.when(F.col("plane") < 0, F.col("n"))).alias("n_docs"), F.sum(weight).alias("n_links"))
    pairs = materialise(pairs, "pair-counts")
    top = pairs.groupBy("a").agg(F.max("n_docs").alias("top"))
    return pairs.join(top, "a").select("a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("top")).alias("is_best"))


def _returned(table: pa.Table) -> pa.Table:
    """Sums over the postings of a block: (block, number, n_best, count_sum) of its documents."""
    col = lambda c: table[c].to_numpy()
    row, doc = documents_in(table["docs"], col("n").astype(np.int64))
    weight = np.left_shift(1, np.maximum(col("plane"), 0).astype(np.int64))
    score, best = weight * col("n_docs"), weight * col("is_best")
    low = 1 << 24  # floating sums stay exact
    total = lambda v: np.bincount(doc, (v % low)[row]).astype(np.int64) + low * np.bincount(doc, (v // low)[row]).astype(np.int64)
    there = np.flatnonzero(np.bincount(doc))
    return pa.table({"block": np.full(len(there), table["block"][0].as_py()), "number": pa.array(there, pa.int32()), "n_best": total(best)[there], "count_sum": total(score)[there]})


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs`` (doc_id, text).

    ``a_path`` and ``b_path`` are paths of tokenizer files, present on every executor.
    """
    aligned = align(docs, a_path, b_path)
    scores = materialise(pair_scores(aligned), "pair-scores")
    postings = aligned.where("a IS NOT NULL").select("block", "a", "b", "plane", "n", "docs").join(scores.drop("n_links"), ["a", "b"])
    back = postings.groupBy("block").applyInArrow(_returned, "block long, number int, n_best long, count_sum long")
    rows = aligned.where("a IS NULL").select("doc_id", "block", "number", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(back, ["block", "number"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
