"""Best-fit packing with certified bounds.

1. Texts become token ids and are cut into pieces of at most ``CAPACITY`` tokens.
2. Pieces are dealt evenly to partitions; each runs best-fit decreasing and computes
   a lower bound on its bins from dual feasible functions.
3. A partition whose bins equal its bound is certified: its bins are final, but for
   its emptiest one. The pieces of that bin and of all partitions with a gap
   are exchanged, dealt to half as many partitions for their number, each up to ``MOST_PIECES``, and packed again, until all
   is certified, one partition holds the rest, or the exchanged pieces need no fewer bins than before.

Tokens: a text is split at ASCII white space and each part is looked up in, or added to, a bounded
per-process table; the tokenizer removes white space and merges nothing across it,
so the ids are those of the whole text.

Defined cases: a null or empty text is a piece of one token (id 0); rows that share a doc_id, or have none,
are packed one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CAPACITY = 2048
END = (0).to_bytes(4, "little")
PIECES_PER_PARTITION = 8192
MOST_PIECES = 1 << 17  # pieces that a task packs at once; some 10 MB
CACHE_WORDS, CACHE_BYTES = 250_000, 24  # entries, and the longest word kept: some 40 MB in each process
CACHE_TAILS = 10_000

_tokens: dict[str, Words] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words(dict):
    """Ids of white-space separated parts of texts, little-endian unsigned 32-bit, found when first asked for.

    A part of letters below U+0250, then ASCII punctuation without an apostrophe, is two
    pieces for the tokenizer; the first one's merges run in a byte-pair encoder of the same
    ranks, whose marker byte 0xFF stands for the end of a word. All others go to the tokenizer itself.
    """

    _simple = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        with open(path) as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        byte = {c: b for b, c in shown.items()}
        ranks: dict[bytes, int] = {}
        ids: list[int] = []

        def add(token: str) -> None:
            stem = token.removesuffix("</w>")
            ranks[bytes(byte[c] for c in stem) + b"\xff" * (stem != token)] = len(ids)
            ids.append(vocab[token])

        for b in range(256):
            add(shown[b] + "</w>")
        for pair in model["merges"]:
            add("".join(pair if isinstance(pair, list) else pair.split(" ")))
        for b in range(256):
            add(shown[b])
        self.ids = np.array(ids, "<u4")
        self.merge = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.tails = {"": b""}
        del model, vocab, ranks

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, part: bytes) -> bytes:
        text = part.decode("utf-8", "replace")
        m = self._simple.fullmatch(text)
        low = m[1].lower() if m else ""
        if m and len(low) == len(m[1]):
            found = self.ids[self.merge(low.encode() + b"\xff")].tobytes()
            tail = self.tails.get(m[2])
            if tail is None:
                tail = self.whole(m[2])
                if len(self.tails) < CACHE_TAILS and len(part) <= CACHE_BYTES:
                    self.tails[m[2]] = tail
            found += tail
        else:
            found = self.whole(text)
        if len(self) < CACHE_WORDS and len(part) <= CACHE_BYTES:
            self[part] = found
        return found


def ids_of(texts: list[bytes], path: str) -> Iterator[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit numbers."""
    if path not in _tokens:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokens[path] = Words(path)
    look = _tokens[path].__getitem__
    for t in texts:
        yield b"".join(map(look, t.split()))


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary())
            for at in range(0, len(names), 1024):
                rows = []
                for i, ids in zip(names[at : at + 1024], ids_of([t or b"" for t in texts.slice(at, 1024).to_pylist()], path), strict=True):
                    ids += END
                    for k in range(0, len(ids) // 4, capacity):
                        part = ids[4 * k : 4 * (k + capacity)]
                        rows.append((i, k // capacity, k, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                cols = list(zip(*rows, strict=True))
                out = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:5]]]
                names_out = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(cols[5], pa.binary()))
                    names_out.append("ids")
                yield pa.record_batch(out, names=names_out)

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document; ids: little-endian unsigned 32-bit, the last id 0."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity, with_ids), schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing of lengths in descending order: bin and offset of each, fill of each bin."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: a bin with r left
    fill: list[int] = []
    bins, offsets = [], []
    for n in lengths.tolist():
        m = mask >> n
        if m:
            r = n + (m & -m).bit_length() - 1
            k = open_bins[r].pop()
            if not open_bins[r]:
                mask ^= 1 << r
        else:
            r, k = capacity, len(fill)
            fill.append(0)
        bins.append(k)
        offsets.append(fill[k])
        fill[k] += n
        left = r - n
        if left:
            if not open_bins[left]:
                mask |= 1 << left
            open_bins[left].append(k)
    return np.array(bins, np.int64), np.array(offsets, np.int64), np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the best of two families of dual feasible functions, and of the sum."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    below = np.cumsum(count)
    mass = np.cumsum(count * x)
    e = np.arange(0, capacity // 2 + 1)  # over capacity - e counts as a whole bin, under e as nothing
    whole = below[-1] - below[capacity - e]
    middle = mass[capacity - e] - np.where(e > 0, mass[np.maximum(e - 1, 0)], 0)
    best = int((-(-(whole * capacity + middle) // capacity)).max())
    for k in range(1, 33):  # rounds (k + 1) x / capacity down, unless it is whole
        scaled = (k + 1) * x
        f = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)  # times k
        best = max(best, int(-(-int((count * f).sum()) // (k * capacity))))
    return best


_OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long, sequence_id long, offset long, bins long, final boolean"


def _pack(capacity: int, step: int):
    """Of rows in order of bucket, longest first: best fit for each bucket."""
    names = [x.split()[0] for x in _OUT.split(", ")]

    def out(bucket: int, t: pa.Table) -> pa.RecordBatch:
        lengths = t.column("length").to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        certified = len(fill) == lower_bound(lengths, capacity)
        final = np.full(len(lengths), certified) & (bins != int(fill.argmin()))
        cols = [*[t.column(c).combine_chunks() for c in names[:6]], pa.array((step << 54) | (bucket << 24) | bins), pa.array(offsets), pa.array(np.full(len(lengths), len(fill))), pa.array(final)]
        return pa.record_batch(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            key = b.column(0).to_numpy()
            names_here, starts = np.unique(key, return_index=True)
            for k, s, e in zip(names_here.tolist(), starts, [*starts[1:], len(key)], strict=True):
                if held and k != last:
                    yield out(last, pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(s, e - s))
                last = k
        if held:
            yield out(last, pa.Table.from_batches(held))

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION, rounds: int | None = None) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32). The table is written once; rounds read it. rounds: an end before the last exchange, for tests."""
    todo = cut(rows)
    todo = todo.withColumn("uid", F.monotonically_increasing_id())
    done, before = None, None
    step = 0
    while True:
        n = todo.count()
        buckets = max(1, -(-n // per_partition))
        bucket = F.pmod(F.xxhash64("uid", F.lit(step)), F.lit(buckets)).alias("bucket")
        dealt = todo.select(bucket, "doc_id", "piece", "start", "length", "ids_crc32", "uid").repartition(buckets, "bucket").sortWithinPartitions("bucket", F.desc("length"), "uid")
        now = cut(dealt.mapInArrow(_pack(capacity, step), _OUT))
        bins = now.agg(F.countDistinct("sequence_id").alias("n")).first()["n"]
        if before is not None and bins >= before[0]:
            return done.union(before[1])
        fixed, rest = now.where("final"), now.where("NOT final")
        done = fixed if done is None else done.union(fixed)
        open_bins = rest.agg(F.countDistinct("sequence_id").alias("n")).first()["n"]
        step += 1
        if buckets == 1 or open_bins <= 1 or step == rounds:
            return done.union(rest)
        before = (open_bins, rest)
        per_partition = max(per_partition, min(2 * per_partition, MOST_PIECES))
        todo = rest.select("doc_id", "piece", "start", "length", "ids_crc32", "uid")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, **how) -> DataFrame:
    out = pack(pieces(docs, tokenizer), **how)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


op9 = pack_documents
