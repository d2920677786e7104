"""Packing of tokenised documents into fixed windows, online and in bounded space."""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import checkpoint, read_table
from lodestone.llm.textcodes import chunks, code_points

WINDOW, OPEN, END_ID = 2048, 64, 1
#: A document that no open window has room for is cut to fill the fullest one, if both pieces have this many tokens at
#: least; else it opens a window. It only chooses where to cut; every id is placed either way.
LEAST_CUT = 32
#: Open windows of so many partitions meet in one task when leftovers are merged.
MERGE = 16
#: Words whose ids a worker remembers.
CACHE = 400_000
#: Characters of Unicode's White_Space, and what follows an apostrophe in a contraction.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def class_table() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 anything else."""
    out = np.array([{"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(0x110000)], np.uint8)
    out[WHITE] = 0
    return out


def word_starts(cps: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where the pieces begin that byte-level BPE merges within: PATTERN without its contractions."""
    kind = table[cps]
    n = len(cps)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.zeros(n, bool)  # is there a character before, in the same text
    before[1:] = True
    before &= ~first[:n]
    after = ~first[1:]
    white = kind == 0
    prev_white = np.zeros(n, bool)
    prev_white[1:] = white[:-1]
    prev_white &= before
    next_solid = np.zeros(n, bool)
    next_solid[:-1] = ~white[1:]
    next_solid &= after
    changed = np.ones(n, bool)
    changed[1:] = kind[1:] != kind[:-1]
    prev_blank = np.zeros(n, bool)
    prev_blank[1:] = cps[:-1] == 32
    solid_start = ~white & (~before | (~prev_white & changed) | (prev_white & ~prev_blank))
    white_start = white & (~before | ~prev_white | next_solid)
    return np.flatnonzero(solid_start | white_start)


class Encoder:
    """Ids of a byte-level BPE vocabulary file of `tokenizers`, word by word, each different word once."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        special = {t.content for t in tok.get_added_tokens_decoder().values()}
        self.special = sorted(special)
        # Byte-level vocabularies write bytes as printable characters: themselves if printable, else from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in t): i for t, i in tok.get_vocab().items() if t not in special}
        self.whole = tok
        self.piece = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.table = class_table()
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.used = 0

    def _learn(self, new: list[bytes]) -> None:
        ids = [self.piece(w) for w in new]
        n = np.array([len(x) for x in ids], np.int64)
        at, need = len(self.known), int(n.sum())
        while self.used + need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + len(new) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + need] = np.fromiter((i for x in ids for i in x), np.uint32, need)
        self.starts[at : at + len(new)] = self.used + np.cumsum(n) - n
        self.lengths[at : at + len(new)] = n
        self.known.update((w, at + i) for i, w in enumerate(new))
        self.used += need

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Texts with contractions or with the vocabulary's special strings are few and go through the
        tokenizer itself."""
        odd = [i for i, t in enumerate(texts) if ("'" in t and any(c in t for c in CONTRACTIONS)) or any(c in t for c in self.special)]
        plain = list(texts)
        for i in odd:
            plain[i] = ""
        cps, offsets = code_points(plain)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        if len(cps):
            begin = word_starts(cps, offsets, self.table)
            size = np.ones(len(cps), np.int8)
            for bound in (0x80, 0x800, 0x10000):
                size += cps >= bound
            place = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            edges = np.append(place[begin], place[-1])
            data = "".join(plain).encode()
            pieces = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(edges), pa.py_buffer(data)])
            coded = pc.dictionary_encode(pieces)
            kinds = coded.dictionary.to_pylist()
            if len(self.known) + len(kinds) > CACHE and self.known:
                self.clear()
            self._learn([w for w in kinds if w not in self.known])
            which = np.fromiter((self.known[w] for w in kinds), np.int64, len(kinds))[coded.indices.to_numpy()]
            n = self.lengths[which]
            ends = np.cumsum(n)
            ids = self.flat[np.repeat(self.starts[which] - (ends - n), n) + np.arange(ends[-1])]
            bounds = np.concatenate([[0], ends])[np.searchsorted(begin, offsets)]
            out = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for i, e in zip(odd, self.whole.encode_batch([texts[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """The worker's encoder of a vocabulary file, by default of the one that default_vocabulary() finds on its machine."""
    path = path or default_vocabulary()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Bins:
    """A fixed number of open windows. add() places best-fit; if none fits, the fullest one is let go."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.free, self.items, self.next = size, most, [], {}, 0

    def _put(self, room: int, name: int, item, length: int) -> list | None:
        self.items[name].append((item, self.size - room, length))
        if room == length:
            return self.items.pop(name)
        insort(self.free, (room - length, name))
        return None

    def fullest(self) -> int:
        """Room of the window to let go next; 0 if there is still leave to open one."""
        return self.free[0][0] if len(self.free) >= self.most else 0

    def fits(self, length: int) -> bool:
        return bisect_left(self.free, (length, -1)) < len(self.free)

    def add(self, item, length: int) -> Iterator[list]:
        """Yields windows that are complete: lists of (item, offset, length)."""
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            room, name = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                yield self.items.pop(self.free.pop(0)[1])
            room, name = self.size, self.next
            self.items[name] = []
            self.next += 1
        full = self._put(room, name, item, length)
        if full:
            yield full

    def rest(self) -> Iterator[list]:
        for _, name in self.free:
            yield self.items[name]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean"


def pack_partitions(docs: DataFrame, path: str | None, window: int, most: int, least_cut: int) -> DataFrame:
    """PIECES of every document, packed within each partition of the input; open: of a window that was left open."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, bins, base, number = encoder(path), Bins(window, most), TaskContext.get().partitionId() << 40, 0
        rows: list[tuple] = []

        def close(pieces: list, left_open: bool = False) -> None:
            nonlocal number
            rows.extend((*item, base + number, offset, left_open) for item, offset, _ in pieces)
            number += 1

        def flush() -> pa.RecordBatch:
            names = [f.split()[0] for f in PIECES.split(", ")]
            kinds = [pa.bool_() if f.endswith("boolean") else pa.int64() for f in PIECES.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            return out

        for batch in batches:
            names = batch.column(0).to_pylist()
            for at, texts in chunks(batch.column(1), 4_000_000):
                for doc_id, body in zip(names[at:], enc.encode(texts), strict=False):
                    ids = np.append(body, np.uint32(END_ID)).astype("<u4")
                    start, n = 0, len(ids)
                    while start < n:
                        left = n - start
                        if left >= window:
                            cut = window
                        else:
                            room = bins.fullest()
                            cut = room if room >= least_cut and left - room >= least_cut and not bins.fits(left) else left
                        item = (doc_id, start, cut, zlib.crc32(ids[start : start + cut]), n)
                        if cut == window:
                            close([(item, 0, cut)])
                        else:
                            for done in bins.add(item, cut):
                                close(done)
                        start += cut
                if rows:
                    yield flush()
        for pieces in bins.rest():
            close(pieces, True)
        if rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(pack, PIECES)


def merge_open(open_windows: DataFrame, window: int, most: int, partitions: int) -> DataFrame:
    """(sequence_id, into, shift) of windows (sequence_id, fill): which window each one joins, and where in it.

    Groups of partitions merge their open windows, then groups of these groups, till one is left, so a task holds the
    open windows of MERGE tasks at most, however many partitions there are.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, rows = Bins(window, most), []
        take = lambda pieces, left_open: rows.extend((item, pieces[0][0], offset, left_open, sum(x[2] for x in pieces)) for item, offset, _ in pieces)
        for batch in batches:
            for name, fill in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for done in bins.add(name, fill):
                    take(done, False)
        for pieces in bins.rest():
            take(pieces, True)
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["sequence_id", "into", "shift", "open", "fill"])

    schema = "sequence_id long, into long, shift long, open boolean, fill long"
    placed, n = None, partitions
    while True:
        n = max(1, -(-n // MERGE))
        group = F.pmod(F.shiftright("sequence_id", 40), F.lit(n))
        step = checkpoint(open_windows.withColumn("g", group).repartition(n, "g").sortWithinPartitions(F.desc("fill"), "sequence_id").select("sequence_id", "fill").mapInArrow(merge, schema))
        if placed is None:
            placed = step.select("sequence_id", "into", "shift")
        else:
            then = step.select(F.col("sequence_id").alias("into"), F.col("into").alias("to"), F.col("shift").alias("more"))
            placed = checkpoint(placed.join(then, "into", "left").select("sequence_id", F.coalesce("to", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")))
        if n == 1:
            return placed
        open_windows = step.where("open and sequence_id = into").select("sequence_id", "fill")


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, most: int = OPEN, least_cut: int = LEAST_CUT) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    Each document, its ids then END_ID, is cut only where it is longer than a window or where no open window has room
    for it and it can fill the fullest one, with least_cut tokens or more on either side of the cut. Null texts are empty, so END_ID alone. Repeated rows and null doc_ids are
    documents like others; other columns play no part; an empty table gives no pieces.
    """
    partitions = docs.rdd.getNumPartitions()
    pieces = checkpoint(pack_partitions(docs, path, window, most, least_cut))
    left = pieces.where("open")
    fills = left.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    moved = left.join(merge_open(fills, window, most, partitions), "sequence_id")
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    merged = moved.select(*cols, F.col("into").alias("sequence_id"), (F.col("offset") + F.col("shift")).alias("offset"))
    return pieces.where("not open").select(*cols, "sequence_id", "offset").unionByName(merged)


def default_vocabulary() -> str:
    """Where the vocabulary file is on this machine, driver or executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_documents() of all documents by the 50,000-word byte-level vocabulary."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
