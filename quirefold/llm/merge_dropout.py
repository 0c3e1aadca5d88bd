"""Sentence-piece encoding with seeded merge dropout, and the decoding that undoes it.

Merges run from an agenda: of all adjacent pairs whose join is a piece, the best-scored one (leftmost on a tie) is merged next. A candidate is a
(start, middle, end) place in its unit; a keyed hash of seed, text, unit and place skips it for good with probability ``dropout``.
Since no piece holds a space mark after another character, a text falls apart into units (a run of spaces and what
follows), and units are encoded at the same time: every array round performs the next agenda merge of every unit, and symbols stay
in place as linked lists, so that a round costs the merges and one pass for the best of each unit. Long units use a heap
instead, with the same result. Every occurrence of a unit draws its own skips. An agenda depends on nothing but the draws for the candidates it meets, so occurrences of one
spelling that draw the same for all candidates met by one of them share its result. Spellings that are frequent in a chunk of texts are encoded without dropout once; an occurrence that
skips none of the candidates met there has that result. Of those that skip the same ones, the first is encoded and lends its result to all that also draw
as it did for what it met later. All others are encoded by themselves.

The space mark itself and characters without a piece become byte pieces, so every text decodes to itself.
"""

from __future__ import annotations

import functools
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from quirefold.llm import arrays as A

LONG = 48
MARK = "▁"
BLOCK = 1 << 15
OFTEN = 3
NONE = np.int32((1 << 31) - 1)
CHUNK = 1 << 18
K1, K2, K3, K4 = (np.uint64(k) for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


class Pieces:
    """Tables of one model file: characters, merges and the bytes of every piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = model.vocab_size()
        usual = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        text = [model.id_to_piece(i) for i in range(n)]
        if any(MARK in t.lstrip(MARK) for t, u in zip(text, usual, strict=True) if u):
            raise ValueError("a piece has a space mark behind another character")
        self.byte_id = np.full(256, -1, np.int64)
        for i in range(n):
            if model.is_byte(i):
                self.byte_id[int(text[i][3:5], 16)] = i
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        ids = {t: i for i, t in enumerate(text) if usual[i]}
        self.char = np.full(0x110000, n, np.int32)  # n: no piece
        self.char[:128] = self.byte_id[:128]
        for t, i in ids.items():
            if len(t) == 1 and t != MARK:
                self.char[ord(t)] = i
        self.mark = ids[MARK]
        self.char[32] = self.mark
        order = sorted(ids.values(), key=lambda i: (-model.get_score(i), i))
        rank = {i: k for k, i in enumerate(order)}
        self.by_rank = np.array(order, np.int32)
        merges = [(ids[t[:k]] * (n + 1) + ids[t[k:]], i) for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
        self.bits = max(4, (2 * len(merges)).bit_length())
        self.keys, self.rank = np.full(1 << self.bits, -1), np.full(1 << self.bits, NONE)
        for key, i in merges:
            s = int(self.slot(np.array([key]))[0])
            while self.keys[s] >= 0:
                s = (s + 1) % len(self.keys)
            self.keys[s], self.rank[s] = key, rank[i]
        raw = [bytes([int(text[i][3:5], 16)]) if model.is_byte(i) else text[i].replace(MARK, " ").encode() if usual[i] else b"" for i in range(n)]
        self.bytes, self.bytes_at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * A.BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece (``by_rank``) that each adjacent pair makes; NONE without one."""
        key = left.astype(np.int64) * (self.size + 1) + right
        s = self.slot(key)
        held = self.keys[s]
        rank = self.rank[s]
        miss = np.flatnonzero(held != key)
        rank[miss] = NONE
        miss = miss[held[miss] >= 0]
        while len(miss):
            s[miss] = next_ = (s[miss] + 1) & (len(self.keys) - 1)
            held = self.keys[next_]
            hit = held == key[miss]
            rank[miss[hit]] = self.rank[next_[hit]]
            miss = miss[~hit & (held >= 0)]
        return rank


@functools.lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """The tables of a model file, built once per process."""
    return Pieces(path)


def skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    if dropout <= 0:
        return np.zeros(len(start), bool)
    place = start.astype(np.uint64) * K1 + middle.astype(np.uint64) * K2 + end.astype(np.uint64) * K3
    return A.mix(key + place) >> np.uint64(11) < np.uint64(np.ceil(dropout * 2.0**53))


def _heap(table: Pieces, symbols: np.ndarray, key: np.uint64, dropout: float) -> np.ndarray:
    """The agenda for one unit."""
    n = len(symbols)
    sym, end, before, after = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    rank = table.pair(symbols[:-1], symbols[1:])
    at = np.arange(n - 1)
    ok = np.flatnonzero((rank < NONE) & ~skipped(np.full(n - 1, key), at, at + 1, at + 2, dropout))
    agenda = [(int(rank[i]), int(i), int(i) + 1, int(i) + 2) for i in ok]
    heapq.heapify(agenda)
    alive = [True] * n
    while agenda:
        best, i, m, e = heapq.heappop(agenda)
        if not alive[i] or end[i] != m or m >= n or not alive[m] or end[m] != e:
            continue
        sym[i], end[i], alive[m], after[i] = int(table.by_rank[best]), e, False, after[m]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n:
                rank = table.pair(np.array([sym[a]]), np.array([sym[b]]))
                if rank[0] < NONE and not skipped(np.array([key]), np.array([a]), np.array([b]), np.array([end[b]]), dropout)[0]:
                    heapq.heappush(agenda, (int(rank[0]), a, b, end[b]))
    return np.flatnonzero(alive), np.array(sym)[alive]


def segment(table: Pieces, chars: np.ndarray, offsets: np.ndarray, keys: np.ndarray, dropout: float, long: int = LONG, met: list | None = None):
    """Symbols of all units end to end: (unit, first character, symbol); characters without a piece have symbol ``size``.

    ``met`` gets all candidates of short units: first those of the characters, then those of every round.
    """
    size = np.diff(offsets)
    done = []
    for u in np.flatnonzero(size > long):
        start, sym = _heap(table, table.char[chars[offsets[u] : offsets[u + 1]]], keys[u], dropout)
        done.append((np.full(len(sym), u), start, sym))
    unit = np.flatnonzero((size <= long) & (size > 0))
    width = size[unit]
    head = np.cumsum(width) - width
    place = A.ragged(np.zeros(len(unit), np.int64), width)  # of a symbol in its unit; symbols stay where they began
    sym = table.char[chars[offsets[np.repeat(unit, width)] + place]]
    place = place.astype(np.int16)
    after, before = place + np.int16(1), place - np.int16(1)
    alive = np.ones(len(sym), bool)
    pri = np.full(len(sym), NONE)

    def rate(u, at, middle, end):
        """Set the rank with place of the pairs that start at ``at``, in the units ``u``."""
        rank = table.pair(sym[at], sym[head[u] + middle])
        pri[at] = NONE
        hit = np.flatnonzero(rank < NONE)
        u, at, middle, end, rank = u[hit], at[hit], middle[hit], end[hit], rank[hit]
        first, u = at - head[u], unit[u]
        if met is not None:
            met.append((u, first, middle, end))
        rank = rank * 64 + first
        if dropout > 0:
            rank[skipped(keys[u], first, middle, end, dropout)] = NONE
        pri[at] = rank

    owner = np.repeat(np.arange(len(unit)), width)
    inside = np.flatnonzero(after < width[owner])
    rate(owner[inside], inside, after[inside], after[inside] + 1)
    while len(unit):
        best = np.minimum.reduceat(pri, head)
        open_ = best < NONE
        if width[~open_].sum() * 4 >= len(sym):  # finished units leave
            gone = np.repeat(~open_, width)
            out = gone & alive
            done.append((np.repeat(unit, width)[out], place[out], sym[out]))
            rest = np.flatnonzero(~gone)
            sym, after, before, place, alive, pri = (x[rest] for x in (sym, after, before, place, alive, pri))
            unit, width, best = unit[open_], width[open_], best[open_]
            head = np.cumsum(width) - width
            if not len(unit):
                break
            u = np.arange(len(unit))
        else:
            u = np.flatnonzero(open_)
        lowest, from_ = best[u], head[u]
        first = lowest & 63
        at = from_ + first
        gone = from_ + after[at]
        sym[at] = table.by_rank[lowest >> 6]
        end = after[gone]
        after[at] = end
        alive[gone] = False
        pri[gone] = pri[at] = NONE
        follow = np.flatnonzero(end < width[u])
        behind = end[follow]
        next_ = from_[follow] + behind
        before[next_] = first[follow]
        ahead = before[at]
        lead = np.flatnonzero(ahead >= 0)
        rate(
            np.concatenate((u[follow], u[lead])), np.concatenate((at[follow], from_[lead] + ahead[lead])),
            np.concatenate((behind, first[lead])), np.concatenate((after[next_], end[lead])),
        )
    unit, start, sym = (np.concatenate([np.zeros(0, np.int64), *(d[k] for d in done)]) for k in range(3))
    order = np.argsort(unit * (int(size.max(initial=0)) + 1) + start, kind="stable")
    return unit[order], start[order], sym[order]


def _met(met: list, many: int) -> tuple[np.ndarray, ...]:
    """(start, count) by unit of the candidates in ``met``, and these in order of their units: first, middle, end."""
    unit, *places = (np.concatenate([np.zeros(0, np.int64), *(m[k] for m in met)]) for k in range(4))
    order = np.argsort(unit, kind="stable")
    count = np.bincount(unit, minlength=many)
    return np.cumsum(count) - count, count, *(p[order] for p in places)


def _dropped(table: Pieces, chars: np.ndarray, offsets: np.ndarray, which: np.ndarray, key: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(result of each occurrence, spelling of each result, results); ``which`` is the spelling of each occurrence."""
    size = np.diff(offsets)
    result, spelling, parts, n = np.full(len(which), -1), [], [], 0

    def units(of, keys, dropout, met=None):
        """Encode spellings; the number of the first result."""
        nonlocal n
        part = segment(table, chars[A.ragged(offsets[of], size[of])], np.concatenate(([0], np.cumsum(size[of]))), keys, dropout, LONG, met)
        parts.append((part[0] + n, *part[1:]))
        spelling.append(of)
        n += len(of)
        return n - len(of)

    def blocks(rows):
        return (rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK))

    usual = np.flatnonzero((np.bincount(which, minlength=len(size)) >= OFTEN) & (size <= LONG))
    met: list = []
    units(usual, np.zeros(len(usual), np.uint64), 0.0, met)
    from_, many, *places = _met(met, len(usual))
    base = np.full(len(size), -1)
    base[usual] = np.arange(len(usual))
    shown = base[which]
    skips = np.zeros(len(which), np.uint64)  # a bit for each candidate met without dropout
    for rows in blocks(np.flatnonzero((shown >= 0) & (many[shown] <= 64) if len(usual) else shown >= 0)):
        result[rows] = mine = shown[rows]
        rows, mine = rows[many[mine] > 0], mine[many[mine] > 0]
        if len(rows):
            at = A.ragged(from_[mine], many[mine])
            head = np.cumsum(many[mine]) - many[mine]
            drawn = skipped(np.repeat(key[rows], many[mine]), *(p[at] for p in places), dropout)
            bit = (at - np.repeat(from_[mine], many[mine])).astype(np.uint64)
            skips[rows] = np.bitwise_or.reduceat(drawn.astype(np.uint64) << bit, head)

    some = np.flatnonzero(skips)
    some = some[np.lexsort((skips[some], which[some]))]
    fresh = np.concatenate(([True], (which[some[1:]] != which[some[:-1]]) | (skips[some[1:]] != skips[some[:-1]]))) if len(some) else np.zeros(0, bool)
    leads = np.flatnonzero(fresh)
    follow = np.diff(np.concatenate((leads, [len(some)])))
    result[some] = -1
    leads, follow = leads[follow > 1], follow[follow > 1]
    for i in range(0, len(leads), BLOCK):
        lead, others = some[leads[i : i + BLOCK]], follow[i : i + BLOCK] - 1
        met = []
        first = units(which[lead], key[lead], dropout, met)
        result[lead] = first + np.arange(len(lead))
        from_, many, *places = _met(met[1:], len(lead))  # their draws for the candidates of the characters are the same
        for part in blocks(np.arange(others.sum())):
            owner = np.searchsorted(np.cumsum(others), part, "right")
            rows = some[leads[i + owner] + 1 + part - (np.cumsum(others) - others)[owner]]
            at, mine = A.ragged(from_[owner], many[owner]), np.repeat(np.arange(len(rows)), many[owner])
            met_at = [p[at] for p in places]
            other = skipped(key[rows][mine], *met_at, dropout) != skipped(key[lead[owner]][mine], *met_at, dropout)
            same = np.bincount(mine[other], minlength=len(rows)) == 0
            result[rows[same]] = first + owner[same]

    for rows in blocks(np.flatnonzero(result < 0)):
        result[rows] = units(which[rows], key[rows], dropout) + np.arange(len(rows))
    return result, np.concatenate(spelling), tuple(np.concatenate([p[k] for p in parts]) for k in range(3))


def encode(table: Pieces, data: np.ndarray, starts: np.ndarray, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of whole texts; an empty text has no ids."""
    full = np.diff(starts) > 0
    data = np.insert(data, starts[:-1][full], 32)
    at = starts + np.concatenate(([0], np.cumsum(full)))
    prefix = A.prefix_hash(data)
    space = data == 32
    head = space & ~np.concatenate(([False], space[:-1])) if len(data) else space
    head[at[:-1][full]] = True
    begin = np.flatnonzero(head)
    end = np.concatenate((begin[1:], [len(data)])) if len(begin) else begin
    first = np.searchsorted(begin, at)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(first))
    content = A.spans_hash(prefix, begin, end)
    whole = A.spans_hash(prefix, at[:-1], at[1:])
    place = np.arange(len(begin)) - first[:-1][text]
    _, one, which = np.unique(content, return_index=True, return_inverse=True)
    length = end[one] - begin[one]
    raw = data[A.ragged(begin[one], length)]
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    offsets = heads[np.concatenate(([0], np.cumsum(length)))]
    if dropout > 0:
        salt = np.uint64(seed % (1 << 63))
        key = A.mix(content + A.mix(whole[text] + place.astype(np.uint64) * K4 + salt) * K1 + A.mix(np.array([salt])))
        which, spelling, (unit, start, sym) = _dropped(table, chars, offsets, which, key, dropout)
    else:
        spelling = np.arange(len(one))
        unit, start, sym = segment(table, chars, offsets, np.zeros(len(one), np.uint64), 0.0)
    odd = np.flatnonzero(sym == table.size)
    if len(odd):  # characters without a piece
        spelled = [table.byte_id[list(chr(c).encode("utf-8", "surrogatepass"))] for c in chars[offsets[spelling[unit[odd]]] + start[odd]]]
        count = np.ones(len(sym), np.int64)
        count[odd] = [len(b) for b in spelled]
        unit, flat = np.repeat(unit, count), np.repeat(sym, count)
        flat[np.repeat(sym, count) == table.size] = np.concatenate(spelled)
        sym = flat
    count = np.bincount(unit, minlength=len(spelling))
    from_ = np.cumsum(count) - count
    ids = sym[A.ragged(from_[which], count[which])].astype(np.int32)
    ends = np.concatenate(([0], np.cumsum(count[which])))
    return ids, ends[first]


def decode(table: Pieces, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts; the leading space that encoding put in front is taken off."""
    size = np.diff(table.bytes_at)[ids]
    ends = np.concatenate(([0], np.cumsum(size)))[offsets]
    data = table.bytes[A.ragged(table.bytes_at[ids], size)]
    full = np.diff(offsets) > 0
    return np.delete(data, ends[:-1][full]), ends - np.concatenate(([0], np.cumsum(full)))


def encode_texts(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 0, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with pieces (array of int), n_tokens, ids_crc32 (of the ids as little-endian 32-bit), decoded (text) and lossless.

    The same seed gives the same pieces for the same text. Null texts count as empty and have no pieces; columns of ``docs`` with one of the
    new names are replaced; an empty table stays empty.
    """
    new = [
        StructField("pieces", ArrayType(IntegerType())), StructField("n_tokens", IntegerType()), StructField("ids_crc32", LongType()),
        StructField("decoded", StringType()), StructField("lossless", BooleanType()),
    ]
    docs = docs.drop(*(f.name for f in new))
    kept = [f for f in docs.schema.fields if f.name != text_col]
    names = [f.name for f in kept]

    def run(batches):
        table = pieces(model)
        for batch in batches:
            data, starts = A.text_bytes(batch.column(text_col))
            for i, j in A.chunks(starts, CHUNK):
                part, at = data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
                ids, offsets = encode(table, part, at, seed, dropout)
                back, ends = decode(table, ids, offsets)
                same = [bytes(part[a:b]) == bytes(back[c:d]) for a, b, c, d in zip(at[:-1], at[1:], ends[:-1], ends[1:], strict=True)]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                texts = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(back))).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).slice(i, j - i) for n in names]
                    + [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(np.diff(offsets).astype(np.int32)), pa.array(crc, pa.int64()), texts, pa.array(same)],
                    names=names + [f.name for f in new],
                )

    return docs.mapInArrow(A.tidy(run), StructType(kept + new))
