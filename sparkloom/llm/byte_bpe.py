"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts are joined into one array of code points, each mapped to a class by table lookup. The split
pattern is a transducer over classes: a function from state to state for each symbol, of which
function composition is associative. The array is cut into blocks; composing a block's functions is
one table step for all blocks and all start states at once, a scan over blocks gives each block's start
state, and one more pass emits the boundaries. No regular expression runs. The slices between
boundaries go through a cache to pair merging; decoding looks ids up in the table of their bytes, and
the offsets of the ids' bytes are kept.

The work is per row: no shuffle, and a lost executor costs only its own tasks.

Defined results: null and empty texts have no ids and decode to nothing; a text is one slice of work
however long; repeated rows give equal values; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from functools import cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_map

#: Pieces that a worker remembers, which bounds the cache at about 100 MB.
CACHE = 250_000

# Classes of code points.
LETTER, NUMBER, SPACE, WHITE, OTHER, STOP = range(6)
# Symbols of the transducer: a class with what follows where that matters.
# A space or other white space is "last" where something other than white space follows it; STOP ends a text.
S_LETTER, S_NUMBER, S_OTHER, S_SPACE_LAST, S_SPACE, S_WHITE_LAST, S_WHITE, S_STOP, S_SHORT, S_LONG = range(10)
# States: what the token so far is. GLUE: one space that joins what follows; C1, C2: letters a contraction still takes.
NONE, IN_LETTER, IN_NUMBER, IN_OTHER, IN_WHITE, GLUE, C1, C2 = range(8)
#: Code points of White_Space, fixed values.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def class_table() -> np.ndarray:
    """Class of each code point."""
    import regex

    out = np.full(0x110001, OTHER, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a == len(m[0]) - 1:
                out[a : b + 1] = kind
            else:
                out[[ord(c) for c in m[0]]] = kind
    out[WHITE_SPACE] = WHITE
    out[0x20], out[0x110000] = SPACE, STOP
    return out


@cache
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token starts) for each [symbol, state]."""
    step, starts = np.zeros((10, 8), np.uint8), np.zeros((10, 8), bool)
    for state in range(8):
        for sym in range(10):
            own = {S_LETTER: IN_LETTER, S_NUMBER: IN_NUMBER, S_OTHER: IN_OTHER, S_SPACE_LAST: GLUE, S_SPACE: IN_WHITE, S_WHITE_LAST: NONE, S_WHITE: IN_WHITE, S_STOP: NONE, S_SHORT: IN_OTHER, S_LONG: IN_OTHER}[sym]
            if sym == S_LETTER:
                new, start = {C2: (C1, False), C1: (NONE, False), IN_LETTER: (IN_LETTER, False), GLUE: (IN_LETTER, False)}.get(state, (own, True))
            elif sym == S_NUMBER:
                new, start = own, state not in (IN_NUMBER, GLUE)
            elif sym == S_OTHER:
                new, start = own, state not in (IN_OTHER, GLUE)
            elif sym in (S_SHORT, S_LONG):  # an apostrophe before letters of a contraction, if a token can start here
                new, start = (IN_OTHER, False) if state in (IN_OTHER, GLUE) else (C1 if sym == S_SHORT else C2, True)
            elif sym in (S_SPACE, S_WHITE):
                new, start = IN_WHITE, state != IN_WHITE
            else:  # the last of a run stands alone or joins what follows
                new, start = own, True
            step[sym, state], starts[sym, state] = new, start
    return step, starts


def symbols(points: np.ndarray) -> np.ndarray:
    """Transducer symbols of code points; 0x110000 stands after each text."""
    kind = class_table()[points]
    after = np.append(kind[1:], STOP)
    white = (kind == SPACE) | (kind == WHITE)
    last = white & (after != SPACE) & (after != WHITE) & (after != STOP)
    out = np.array([S_LETTER, S_NUMBER, S_SPACE, S_WHITE, S_OTHER, S_STOP + 0], np.uint8)[kind]
    out[last & (kind == SPACE)] = S_SPACE_LAST
    out[last & (kind == WHITE)] = S_WHITE_LAST
    at = np.flatnonzero(points[:-1] == 0x27)
    if len(at):
        one = points[at + 1]
        two = points[np.minimum(at + 2, len(points) - 1)]
        c = lambda s: ord(s)
        short = np.isin(one, [c("s"), c("t"), c("m"), c("d")])
        long = ((one == c("r")) & (two == c("e"))) | ((one == c("v")) & (two == c("e"))) | ((one == c("l")) & (two == c("l")))
        out[at[short]] = S_SHORT
        out[at[long]] = S_LONG
    return out


def boundaries(points: np.ndarray, block: int = 512) -> np.ndarray:
    """Positions at which tokens start, by a block-wise scan of transition functions. STOP positions count as starts."""
    step, starts = transitions()
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    rows = -(-n // block)
    sym = np.full(rows * block, S_STOP, np.uint8)
    sym[:n] = symbols(points)
    cols = np.ascontiguousarray(sym.reshape(rows, block).T)
    flat = step.ravel()
    # Compose each block's functions: row r holds, for each start state, the state after the block so far.
    f = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for c in cols:
        f = flat[(c[:, None].astype(np.uint16) << 3) + f]
    # Scan the compositions over blocks.
    state, first = NONE, np.empty(rows, np.uint8)
    for r, row in enumerate(f.tolist()):
        first[r] = state
        state = row[state]
    # Run each block from its start state.
    mark, state = np.empty((block, rows), bool), first
    flat_starts = starts.ravel()
    for j, c in enumerate(cols):
        at = (c.astype(np.uint16) << 3) + state
        mark[j] = flat_starts[at]
        state = flat[at]
    return np.flatnonzero(mark.T.ravel()[:n])


def pretokenize(texts: list[str]) -> list[list[str]]:
    """The pieces of each text."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    points[ends] = 0x110000
    cuts = boundaries(points)
    at = np.searchsorted(cuts, ends)
    cuts, out, lo = cuts.tolist(), [], 0
    for hi in at.tolist():
        own = cuts[lo : hi + 1]
        out.append([joined[a:b] for a, b in zip(own, own[1:])])
        lo = hi + 1
    return out


class Bpe:
    """Encodes with cached pair merging and decodes; made from a rank file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {v: k for k, v in ranks.items()}
        self.sizes = np.zeros(max(self.bytes) + 1, np.int64)
        self.sizes[list(self.bytes)] = [len(b) for b in self.bytes.values()]
        # Only the library's pair merging of a single piece is used; the pattern is never matched.
        self.merge = tiktoken.Encoding("ranks", pat_str=r"[^\s\S]", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.pieces: dict[str, tuple[tuple[int, ...], str, bytes]] = {}

    def piece(self, piece: str) -> tuple[tuple[int, ...], str]:
        got = self.pieces.get(piece)
        if got is None:
            ids = tuple(self.merge(piece.encode()))
            got = self.pieces[piece] = (ids, " ".join(map(str, ids)))
        return got

    def encode_batch(self, texts: list[str]) -> list[list[tuple[tuple[int, ...], str]]]:
        """For each text its pieces' (ids, decimal ids)."""
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        out, known = [], self.pieces
        for pieces in pretokenize(texts):
            try:
                out.append([known[p] for p in pieces])
            except KeyError:
                out.append([known.get(p) or self.piece(p) for p in pieces])
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(p[0] for p in self.encode_batch([text])[0]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def offsets(self, ids) -> list[int]:
        """Byte offset at which each id's bytes start in the decoded text."""
        return self.starts(ids).tolist()

    def starts(self, ids) -> np.ndarray:
        size = self.sizes[np.array(ids, np.int64)] if len(ids) else np.zeros(0, np.int64)
        return np.cumsum(size) - size


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_decoded, offsets_crc32 (of each id's byte offset as a little-endian signed 64-bit integer)
    and, with ``keep_ids``, ids and offsets of each document."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_decoded long, offsets_crc32 long" + ", ids array<int>, offsets array<long>" * keep_ids

    def start():
        bpe = Bpe(ranks)

        def step(rows):
            out = []
            for (doc, _), parts in zip(rows, bpe.encode_batch([t or "" for _, t in rows])):
                ids = list(chain.from_iterable([p[0] for p in parts]))
                back, starts = bpe.decode(ids), bpe.starts(ids)
                row = (doc, len(ids), hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest(), hashlib.sha256(back).hexdigest(), len(back), zlib.crc32(starts.astype("<i8").tobytes()))
                out.append(row + ((ids, starts.tolist()) if keep_ids else ()))
            return out

        return step

    return text_map(docs.select(F.col(id_col), F.col(text_col)), start, schema, rows=128)
