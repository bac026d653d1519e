"""SentencePiece encoding and decoding, giant texts by a max-plus scan over chunks.

A segmentation is a path through a lattice whose nodes are occurrences of pieces in the
text. For a unigram model an edge weighs the score of the piece it enters; for a
byte-pair model it weighs 0 if the two neighbouring pieces are what the model makes of their
joined text, else minus infinity: a sequence of pieces is the model's own exactly if all
neighbours are. Paths combine by (max, +).

A giant text is split into chunks. A boundary's states are the occurrences that reach up to or
across it; each chunk yields the matrix of best weights from the states of its left boundary
to those of its right one. Matrices of a text are combined associatively; a prefix product gives
the state at every boundary, and each chunk is then backtraced by itself, between two known states.

A place that no piece crosses (after a letter, before a space, in models none of whose pieces has a space after a letter) cuts the
lattice: a chunk's matrix is then the outer sum of what reaches the first such place and what leaves the last one, and the
words between are scanned and backtraced one by one, each different word once for as long as a bounded table holds it. Texts that fit one chunk are
scanned the same way. The library loads the model; no text is encoded by it.

Decoding joins the pieces, turns byte pieces into bytes and removes the space put before a text.

Defined cases: a null text has null ids, an empty text none; invalid ids raise an error; characters the
model lacks become byte pieces, or unknown ones where it has no such; of segmentations with equal best sums, which byte-pair models never have,
a giant text may get another one than the library's; rows that share a doc_id, or have none, are encoded one by one; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

GIANT, CHUNK = 32_768, 16_384  # code points of a giant text, and of a chunk
CACHE_WORDS, CACHE_CHARS, CACHE_PAIRS = 500_000, 32, 400_000
HEAD_CHARS, CACHE_HEADS = 8, 200_000  # beginnings of words whose states are kept
UNKNOWN_PENALTY = 10.0  # below the least score, for a character that a unigram model lacks
SPACE = "▁"
NONE = float("-inf")


class Table(dict):
    """Ids of words by what finds them, bounded."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, w: str) -> bytes:
        found = self.find(w)
        if len(w) <= CACHE_CHARS and len(self) < CACHE_WORDS:
            self[w] = found
        return found


@dataclass
class Vocabulary:
    """Pieces of a model. joined(a, b): the weight of piece b directly after piece a (None: the text begins)."""

    path: str
    pieces: dict[str, int] = field(default_factory=dict)
    scores: list[float] = field(default_factory=list)
    longest: int = 1
    unigram: bool = False

    def __post_init__(self):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=self.path)
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(self.path, "rb") as f:
            proto = pb.ModelProto.FromString(f.read())
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave their text as it is are supported")
        if proto.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and byte-pair models are supported")
        self.unigram = proto.trainer_spec.model_type == 1
        if not proto.normalizer_spec.add_dummy_prefix or proto.trainer_spec.treat_whitespace_as_suffix or any(p.type == 4 for p in proto.pieces):
            raise ValueError("only models with a space before their text, and without pieces defined by users, are supported")
        self.pieces = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.scores = [p.score for p in proto.pieces]
        self.longest = max(map(len, self.pieces))
        self.unknown = min(self.scores[i] for i in self.pieces.values()) - UNKNOWN_PENALTY
        self.unk, self.fallback = proto.trainer_spec.unk_id, proto.trainer_spec.byte_fallback
        # no piece has a space after a letter: words are cut off from each other
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        # neighbours inside any piece: between two others no piece crosses either
        self.inside = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.split = re.compile(self.pattern()).findall
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # what each id stands for; unknown pieces show as the library shows them, control pieces not at all
        shows = {2: " \u2047 ", 3: ""}
        self.shown = [bytes([int(p.piece[3:-1], 16)]) if p.type == 6 else shows.get(p.type, p.piece.replace(SPACE, " ")).encode() for p in proto.pieces]
        self.pairs: dict[tuple[str, str], float] = {}
        self.words = Table(self.word)
        self.heads: dict[str, str] = {}
        # the longest piece by its last two characters
        self.tails: dict[str, int] = {}
        for p in self.pieces:
            self.tails[p[-2:]] = max(self.tails.get(p[-2:], 1), len(p))

    def pattern(self) -> str:
        """Words: spaces, then characters that pieces connect with each other, as letters or signs. No piece goes from one such class to another."""
        kin: dict[str, set[str]] = {}
        for x, y in self.inside:
            if SPACE not in (x, y) and kin.setdefault(x, {x}) is not kin.setdefault(y, {y}):
                kin[x] |= kin[y]
                for c in kin[y]:
                    kin[c] = kin[x]
        classes = sorted({id(k): "".join(sorted(k)) for k in kin.values()}.values(), key=len, reverse=True)
        alone = "".join(sorted({*kin, SPACE}))
        return "|".join([*[f"{SPACE}*[{re.escape(c)}]+" for c in classes], f"{SPACE}+(?:[^{re.escape(alone)}])?", f"[^{re.escape(alone)}]+"])

    def merged(self, text: str) -> list[str]:
        """What a byte-pair model makes of a short text: the best-scored neighbours are joined, the first of equals, until none are a piece."""
        parts = list(text)
        while True:
            at, best = -1, NONE
            for i in range(len(parts) - 1):
                k = self.pieces.get(parts[i] + parts[i + 1])
                if k is not None and self.scores[k] > best:
                    at, best = i, self.scores[k]
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def known(self, text: str) -> bool:
        return text in self.pieces

    def joined(self, a: str | None, b: str) -> float:
        """The weight of piece b after piece a (None: before it the text begins, or a word does)."""
        if self.unigram:
            return self.scores[self.pieces[b]] if b in self.pieces else self.unknown
        w = self.pairs.get((a, b))
        if w is None:
            # a piece must be what the model makes of its own text, and two of both
            w = 0.0 if self.merged((a or "") + b) == ([b] if a is None else [a, b]) else NONE
            if len(self.pairs) < CACHE_PAIRS:
                self.pairs[a, b] = w
        return w

    def ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        unknown = False  # characters that a model without byte pieces lacks are one id together
        for p in pieces:
            if p in self.pieces:
                out.append(self.pieces[p])
            elif self.fallback:
                out += [self.bytes[b] for b in p.encode()]
            elif not unknown:
                out.append(self.unk)
            unknown = p not in self.pieces and not self.fallback
        return out

    def scan(self, w: str) -> list[str]:
        """Pieces of a text that stands by itself: the best path, by (max, +) from left to right."""
        last = self.best(w) if self.unigram else self.only(w)
        n, path = len(w), []
        while n:
            path.append(last[n])
            n -= len(last[n])
        return path[::-1]

    def best(self, w: str) -> list[str | None]:
        """The piece that ends the best path to each place."""
        last: list[str | None] = [None] * (len(w) + 1)
        weight = [0.0] + [NONE] * len(w)
        for e in range(1, len(w) + 1):
            for at in range(max(0, e - self.tails.get(w[max(0, e - 2) : e], 1)), e):
                piece = w[at:e]
                if piece in self.pieces or at == e - 1:
                    c = weight[at] + self.joined(last[at], piece)
                    if c > weight[e]:
                        weight[e], last[e] = c, piece
        return last

    def only(self, w: str) -> list[str | None]:
        """The same for a byte-pair model: a path of weight 0 is the model's own segmentation of all up to there, so
        the first that is found is the best, and the state after a beginning serves all words that share it."""
        tails, pieces, joined, pairs, heads = self.tails, self.pieces, self.joined, self.pairs, self.heads
        last: list[str | None] = [None] * (len(w) + 1)
        for e in range(1, len(w) + 1):
            if e <= HEAD_CHARS:
                last[e] = heads.get(w[:e])
                if last[e] is not None:
                    continue
            reach = tails.get(w[e - 2 : e], 1) if e > 1 else 1
            for at in range(e - reach if e > reach else 0, e):
                piece = w[at:e]
                if piece in pieces or at == e - 1:
                    c = pairs.get((last[at], piece))
                    if c is None:
                        c = joined(last[at], piece)
                    if c == 0.0:
                        last[e] = piece
                        break
            if e <= HEAD_CHARS and len(heads) < CACHE_HEADS:
                heads[w[:e]] = last[e]
        return last

    def word(self, w: str) -> bytes:
        """Ids of a word, part by part between places that no piece crosses."""
        inside = self.inside
        cuts = [i for i in range(1, len(w)) if w[i - 1 : i + 1] not in inside]
        if not cuts:
            return array("I", self.ids(self.scan(w))).tobytes()
        look, out, at = self.words.__getitem__, [], 0
        for i in [*cuts, len(w)]:
            out.append(look(w[at:i]))
            at = i
        return b"".join(out)

    def encode(self, escaped: str) -> bytes:
        """Ids of escaped text: word by word where no piece crosses from one to the next."""
        if not escaped:
            return b""
        if not self.by_word or not self.fallback:
            return np.array(self.ids(self.scan(escaped)), "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, self.split(escaped)))


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def escape(text: str) -> str:
    """The text as the model's lattice sees it: a space before it, and spaces visible."""
    return SPACE + text.replace(" ", SPACE) if text else ""


State = tuple[int, int]  # an occurrence of a piece: start and end, relative to a boundary


def occurrences(v: Vocabulary, text: str, at: int) -> list[State]:
    """Pieces of text that begin at a place: (start, end); a character the model lacks is a piece of its own."""
    out = [(at, at + n) for n in range(1, min(v.longest, len(text) - at) + 1) if v.known(text[at : at + n])]
    return out if out and out[0][1] == at + 1 else [(at, at + 1), *out]


def states(v: Vocabulary, text: str, boundary: int) -> list[State]:
    """Occurrences that hold the character before a boundary: they end at it or reach across."""
    found = [x for s in range(max(0, boundary - v.longest), boundary) for x in occurrences(v, text, s) if x[1] >= boundary]
    return found


def forward(v: Vocabulary, text: str, start: State | None, end: int, begin: int = 0) -> dict[State, tuple[float, State | None]]:
    """Best weight, and occurrence before, of all occurrences reached from one (None: from a place where the text, or a word, begins) and beginning before end."""
    best: dict[State, tuple[float, State | None]] = {}
    begin = start[1] if start else begin
    ending: dict[int, list[State]] = {begin: [start] if start else []}
    if start:
        best[start] = (0.0, None)
    for at in range(begin, end):
        before = ending.pop(at, [] if at > begin or start else None)
        if at > begin and not before:
            continue
        for x in occurrences(v, text, at):
            piece = text[x[0] : x[1]]
            if at == begin and not start:
                w, p = v.joined(None, piece), None
            else:
                w, p = NONE, None
                for y in before:
                    c = best[y][0] + v.joined(text[y[0] : y[1]], piece)
                    if c > w:
                        w, p = c, y
            if w > NONE:
                best[x] = (w, p)
                ending.setdefault(x[1], []).append(x)
    return best


@dataclass
class Matrix:
    """Best weights from the states of a left boundary (None alone: the text begins) to those of a right one."""

    rows: list
    cols: list
    w: np.ndarray

    def then(self, other: Matrix) -> Matrix:
        """The (max, +) product; associative."""
        if self.cols != other.rows:
            raise ValueError("boundaries differ")
        return Matrix(self.rows, other.cols, (self.w[:, :, None] + other.w[None, :, :]).max(axis=1) if self.w.size and other.w.size else np.full((len(self.rows), len(other.cols)), NONE))


def hard(text: str, a: int, b: int) -> tuple[int, int] | None:
    """The first and last place in [a, b) that no piece crosses: a space that follows no space."""
    first = next((i for i in range(max(a, 1), b) if text[i] == SPACE and text[i - 1] != SPACE), None)
    if first is None:
        return None
    last = next(i for i in range(b - 1, first - 1, -1) if text[i] == SPACE and text[i - 1] != SPACE)
    return first, last


def transfer(v: Vocabulary, text: str, a: int, b: int) -> Matrix:
    """The matrix of the chunk [a, b) of a text; the text needs v.longest characters on either side only."""
    rows: list = states(v, text, a) if a else [None]
    cols: list = states(v, text, b)
    w = np.full((len(rows), len(cols)), NONE)
    places = hard(text, a + v.longest, b) if v.by_word and v.fallback else None
    if places:
        # whatever comes before, a piece begins at these places: the matrix is an outer sum
        first, last = places
        head = [reach(v, text, r, first) for r in rows]
        best = forward(v, text[: b + v.longest], None, b, last)
        tail = [best[c][0] if c in best and best[c][0] > NONE else NONE for c in cols]
        for i, x in enumerate(head):
            w[i] = [x + y for y in tail]
    else:
        for i, r in enumerate(rows):
            best = forward(v, text[: b + v.longest], r, b)
            for j, c in enumerate(cols):
                if c in best:
                    w[i, j] = best[c][0]
    return Matrix(rows, cols, w)


def reach(v: Vocabulary, text: str, start: State | None, end: int) -> float:
    """Best weight of a path from an occurrence to a place that no piece crosses."""
    best = forward(v, text[:end], start, end)
    found = [x[0] for s, x in best.items() if s[1] == end]
    return max(found, default=0.0 if start and start[1] == end else NONE)


def backtrace(v: Vocabulary, text: str, b: int, start: State | None, end: State, begin: int = 0) -> list[str]:
    """Pieces of a chunk after one state, or from a place where a word begins, up to another state, that included."""
    best = forward(v, text[: b + v.longest], start, b, begin)
    path, x = [], end
    while x is not None and x != start:
        path.append(text[x[0] : x[1]])
        x = best[x][1]
    return path[::-1]


def chunk_pieces(v: Vocabulary, text: str, a: int, b: int, start: State | None, end: State) -> list[str] | bytes:
    """The pieces after start up to end; their ids, where places that no piece crosses allow to scan word by word."""
    places = hard(text, (start[1] if start else 0) + 1, min(b, end[0] + 1)) if v.by_word and v.fallback else None
    if not places:
        return backtrace(v, text, b, start, end)
    first, last = places
    # from the state before to the first such place
    best = forward(v, text[:first], start, first)
    x = max((s for s in best if s[1] == first and s != start), key=lambda s: best[s][0], default=None)
    head: list[str] = []
    while x is not None and x != start:
        head.append(text[x[0] : x[1]])
        x = best[x][1]
    tail = backtrace(v, text, b, None, end, last) if end[1] > last else []
    return np.array(v.ids(head[::-1]), "<u4").tobytes() + v.encode(text[first:last]) + np.array(v.ids(tail), "<u4").tobytes()


def chunk_ids(v: Vocabulary, text: str, a: int, b: int, start: State | None, end: State) -> bytes:
    found = chunk_pieces(v, text, a, b, start, end)
    return found if isinstance(found, bytes) else np.array(v.ids(found), "<u4").tobytes()


def encode_scan(v: Vocabulary, text: str, chunk: int = CHUNK) -> bytes:
    """Ids of a text by the scan alone, for a single process; the distributed form is ``encode``."""
    escaped = escape(text)
    if not escaped:
        return b""
    cuts = [*range(0, len(escaped), chunk), len(escaped)]
    parts = [transfer(v, escaped, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    ends = boundary_states(parts)
    return b"".join(chunk_ids(v, escaped, a, b, s, e) for a, b, s, e in zip(cuts, cuts[1:], [None, *ends], ends, strict=False))


def boundary_states(parts: list[Matrix]) -> list[State]:
    """The state of the best path at the right boundary of each chunk: prefix products, then backwards."""
    prefix = [parts[0]]
    for p in parts[1:]:
        prefix.append(prefix[-1].then(p))
    last = prefix[-1]
    end = max((s[1] for s in last.cols))
    final = [j for j, s in enumerate(last.cols) if s[1] == end]  # a path ends where the text does
    j = max(final, key=lambda j: last.w[0, j])
    out = [last.cols[j]]
    for k in range(len(parts) - 1, 0, -1):
        w = prefix[k - 1].w[0] + parts[k].w[:, j]
        j = int(w.argmax())
        out.append(parts[k].rows[j])
    return out[::-1]


def decode(v: Vocabulary, ids: bytes) -> str:
    """The text of ids: pieces joined, byte pieces as bytes, the space before the text removed."""
    found = np.frombuffer(ids, "<u4")
    if len(found) and int(found.max()) >= len(v.shown):
        raise ValueError(f"no piece has the id {int(found.max())}")
    raw = b"".join(map(v.shown.__getitem__, found.tolist()))
    return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


_LOOK = 256  # characters on either side of a chunk that go with it; more than twice the longest piece


def _chunks(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, doc, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                e = escape(text)
                rows = [(uid, doc, k, max(0, a - _LOOK), a, min(a + chunk, len(e))) for k, a in enumerate(range(0, len(e), chunk))]
                for at in range(0, len(rows), 64):
                    cols = list(zip(*rows[at : at + 64], strict=True))
                    texts = [e[r[3] : min(len(e), r[5] + _LOOK)] for r in rows[at : at + 64]]
                    yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[3:]], pa.array(texts, pa.string())], names=["uid", "doc_id", "k", "base", "a", "b", "part"])

    return run


_CHUNK = "uid long, doc_id long, k int, base long, a long, b long, part string"


def _pack(m: Matrix, base: int) -> bytes:
    import pickle

    move = lambda s: None if s is None else (s[0] + base, s[1] + base)
    return pickle.dumps(([move(s) for s in m.rows], [move(s) for s in m.cols], m.w))


def _transfers(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            rows = b.to_pylist()
            yield pa.record_batch([b.column("uid"), b.column("k"), pa.array([_pack(transfer_at(v, r), r["base"]) for r in rows], pa.binary())], names=["uid", "k", "matrix"])

    return run


def transfer_at(v: Vocabulary, r: dict) -> Matrix:
    a, b = r["a"] - r["base"], r["b"] - r["base"]
    m = transfer(v, r["part"], a, b)
    if r["a"] == 0:
        m.rows = [None]
    return m


def _solve(pdf):
    """States at both ends of each chunk of one text, from the matrices of all its chunks."""
    import pickle

    import pandas as pd

    pdf = pdf.sort_values("k")
    ends = boundary_states([Matrix(*pickle.loads(x)) for x in pdf["matrix"]])
    starts = [None, *ends[:-1]]
    return pd.DataFrame({"uid": pdf["uid"], "k": pdf["k"], "s0": [-1 if s is None else s[0] for s in starts], "s1": [-1 if s is None else s[1] for s in starts], "e0": [e[0] for e in ends], "e1": [e[1] for e in ends]})


def _traces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            ids = []
            for r in b.to_pylist():
                z = r["base"]
                start = None if r["s0"] < 0 else (r["s0"] - z, r["s1"] - z)
                ids.append(chunk_ids(v, r["part"], r["a"] - z, r["b"] - z, start, (r["e0"] - z, r["e1"] - z)))
            yield pa.record_batch([b.column("uid"), b.column("doc_id"), b.column("k"), pa.array(ids, pa.binary())], names=["uid", "doc_id", "k", "ids"])

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's ids from those of its chunks, in order."""
    for b in batches:
        for at in range(len(b)):
            part = b.slice(at, 1)
            yield pa.record_batch([part.column(0), pa.array([b"".join(part.column(1)[0].as_py())], pa.binary())], names=["doc_id", "ids"])


def _small(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                ids = [None if t is None else v.encode(escape(t)) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, model: str | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids) of every document: little-endian unsigned 32-bit ids, null for a null text. Only giant texts are shuffled, in chunks."""
    model = model or default_model()
    if chunk < 2048:
        raise ValueError("chunks must be longer than what a boundary looks at")
    if not vocabulary(model).fallback:
        giant = 1 << 31  # unknown characters on both sides of a border would be one id: texts stay whole
    long = F.coalesce(F.length("text") > giant, F.lit(False))
    few = docs.where(long).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    parts = cut(few.mapInArrow(_chunks(chunk), _CHUNK))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    solved = parts.repartition(n, "uid", "k").mapInArrow(_transfers(model), "uid long, k int, matrix binary").groupBy("uid").applyInPandas(_solve, "uid long, k int, s0 long, s1 long, e0 long, e1 long")
    traced = parts.join(solved, ["uid", "k"]).select("uid", "doc_id", "k", "base", "a", "b", "part", "s0", "s1", "e0", "e1").mapInArrow(_traces(model), "uid long, doc_id long, k int, ids binary")
    whole = traced.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("x"))
    joined = whole.select("doc_id", F.col("x.ids").alias("x")).mapInArrow(_together, "doc_id long, ids binary")
    return docs.where(~long).select("doc_id", "text").mapInArrow(_small(model), "doc_id long, ids binary").union(joined)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                ids = part.column(1).to_pylist()
                texts = [None if x is None else decode(v, x) for x in ids]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return run


def decoded(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, text) of the result of encode."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model or default_model()), "doc_id long, ids binary, text string")


def op2(docs: DataFrame) -> DataFrame:
    out = decoded(encode(docs))
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def brute(rows: list[tuple], model: str | None = None) -> dict:
    """Reference result by the library over whole texts."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model or default_model())
    out = {}
    for i, t in rows:
        ids = sp.encode(t or "", num_threads=1)
        out[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    return out
