"""SentencePiece (merge type) encoding with seeded merge dropout, and decoding."""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, mix64

MARK = "▁"
#: A unit: a run of marks and what follows up to the next. No piece reaches over a unit's end.
_units = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
#: Segmentations kept, and occurrences looked up at once.
CACHE = 500_000
SLICE = 1 << 20
#: Units of more characters go through a heap, the others through matrices, many at once.
SHORT = 64
TOGETHER = 2048
#: What a mark in the text itself becomes meanwhile: a lone surrogate, which no valid text holds.
_OWN = "\ud800"
_NEVER = np.int32(2**31 - 1)


@functools.cache
class Vocabulary:
    """Pieces of a model file of the BPE type with byte fallback.

    A symbol is a piece's id, or the number of pieces plus the code point for other characters.
    ``pairs`` hashes (left symbol, right symbol) to the rank and id of the piece they make.
    """

    SLOTS = 1 << 21

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(self.size)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        if over := [p for p in self.ids if MARK in p.lstrip(MARK)]:
            raise ValueError(f"pieces reach over a mark: {over[:3]}")
        self.out: dict[int, bytes] = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()}
        self.out |= {i: bytes([b]) for b, i in self.bytes.items()}
        scores = sorted({sp.get_score(i) for i in self.ids.values()}, reverse=True)
        place = {score: r for r, score in enumerate(scores)}
        self.rank = {p: place[sp.get_score(i)] for p, i in self.ids.items() if len(p) > 1}
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.size
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.byte_ids = np.array([self.bytes[b] for b in range(256)], np.int64)
        parts = [self.out.get(i, b"") for i in range(self.size)]
        self.out_sizes = np.array([len(x) for x in parts], np.int64)
        self.out_start, self.out_flat = np.cumsum(self.out_sizes) - self.out_sizes, np.frombuffer(b"".join(parts), np.uint8)
        self._fill()

    def _symbol(self, part: str) -> int | None:
        return int(self.symbol[ord(part)]) if len(part) == 1 else self.ids.get(part)

    def _fill(self) -> None:
        self.keys = np.full(self.SLOTS, -1, np.int64)
        self.ranks = np.full(self.SLOTS, _NEVER, np.int32)
        self.made = np.zeros(self.SLOTS, np.int32)
        found = [
            (a << 32 | b, r, self.ids[p])
            for p, r in self.rank.items()
            for i in range(1, len(p))
            if (a := self._symbol(p[:i])) is not None and (b := self._symbol(p[i:])) is not None
        ]
        at = self._slot(np.array([f[0] for f in found], np.int64)).tolist()
        for (key, rank, piece), slot in zip(found, at):
            while self.keys[slot] != -1:
                slot = (slot + 1) % self.SLOTS
            self.keys[slot], self.ranks[slot], self.made[slot] = key, rank, piece

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.view(np.uint64)) & np.uint64(self.SLOTS - 1)).astype(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that each pair of symbols makes; rank _NEVER for none."""
        keys = left << 32 | right
        at = self._slot(keys)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) % self.SLOTS
            open_ = open_[(self.keys[at[open_]] != keys[open_]) & (self.keys[at[open_]] != -1)]
        return self.ranks[at], self.made[at]

    def coded(self, piece: str) -> bytes:
        """Ids of a piece, or of the bytes of a character that has none."""
        if (i := self.ids.get(piece)) is not None:
            return i.to_bytes(4, "little")
        raw = (MARK if piece == _OWN else piece).encode()
        return b"".join(self.bytes[b].to_bytes(4, "little") for b in raw)


#: Candidates whose skips one draw decides, and the lowest bit that is set in a byte (8 for none).
LANES = 8
_LOWEST = np.array([(x & -x).bit_length() - 1 if x else LANES for x in range(256)], np.int64)


def skips(keys: np.ndarray, block, limit: int) -> np.ndarray:
    """Bit j of an occurrence's byte: whether the candidate that comes up in turn 8 * block + j is skipped.

    Each candidate has 16 bits of a hash of the occurrence's key and its turn, and is skipped where they are under ``limit``.
    """
    at = np.uint64(2) * np.atleast_1d(np.asarray(block, np.uint64))
    both = np.stack([mix64(keys + np.uint64(0x9E3779B97F4A7C15) * (at + np.uint64(i))) for i in (1, 2)], axis=-1)
    return np.packbits(both.view(np.uint16).reshape(*both.shape[:-1], LANES) < limit, axis=-1, bitorder="little")[..., 0]


def segment(unit: str, v: Vocabulary, limit: int = 0, key: int = 0) -> list[str]:
    """Merges a unit's characters by an agenda, best score first, then leftmost.

    A candidate that comes up is skipped if :func:`skips` says so by the occurrence's key; it is gone
    until a neighbour changes.
    """
    parts, keys = list(unit), np.array([key], np.uint64)
    n, agenda, turn, mask = len(parts), [], -1, 0
    after, prior = list(range(1, n + 1)), list(range(-1, n - 1))

    def offer(i: int, j: int) -> None:
        joined = parts[i] + parts[j]
        if (r := v.rank.get(joined)) is not None:
            heapq.heappush(agenda, (r, i, j, joined))

    for i in range(n - 1):
        offer(i, i + 1)
    while agenda:
        _, i, j, joined = heapq.heappop(agenda)
        if not parts[i] or after[i] != j or parts[i] + parts[j] != joined:
            continue
        turn += 1
        if limit:
            if turn % LANES == 0:
                mask = int(skips(keys, turn // LANES, limit)[0])
            if mask >> turn % LANES & 1:
                continue
        parts[i], parts[j] = joined, ""
        after[i] = k = after[j]
        if k < n:
            prior[k] = i
            offer(i, k)
        if prior[i] >= 0:
            offer(prior[i], i)
    return [p for p in parts if p]


def segment_many(chars: np.ndarray, sizes: np.ndarray, v: Vocabulary, forced: np.ndarray, came: np.ndarray) -> list[bytes]:
    """Ids (little-endian bytes) of units of at most SHORT characters: every unit's agenda at once.

    ``chars`` holds a unit's code points in a row. Each round takes the best candidate of each unit, as :func:`segment` does
    one by one, and skips it in the turns that ``forced`` marks. ``came`` gets how many candidates came up.
    """
    n, wide = chars.shape
    turn, place = 0, np.arange(wide)
    inside = place < sizes[:, None]
    sym = np.where(inside, v.symbol[chars], -1)
    ranks, made = np.full((n, wide), _NEVER, np.int32), np.zeros((n, wide), np.int32)
    if wide > 1:
        r, m = v.join(sym[:, :-1].ravel(), sym[:, 1:].ravel())
        ranks[:, :-1] = np.where(inside[:, 1:], r.reshape(n, -1), _NEVER)
        made[:, :-1] = m.reshape(n, -1)
    after, prior = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
    rows = np.arange(n)
    while len(rows):
        i = ranks[rows].argmin(axis=1)
        going = ranks[rows, i] != _NEVER
        rows, i = rows[going], i[going]
        if not len(rows):
            break
        came[rows] += 1
        at = rows
        if turn < forced.shape[1]:
            gone = forced[rows, turn]
            ranks[rows[gone], i[gone]] = _NEVER
            at, i = rows[~gone], i[~gone]
        turn += 1
        j = after[at, i]
        sym[at, i], sym[at, j] = made[at, i], -1
        ranks[at, i] = ranks[at, j] = _NEVER
        k = after[at, j]
        after[at, i] = k
        right = k < sizes[at]
        r, x, y = at[right], i[right], k[right]
        prior[r, y] = x
        ranks[r, x], made[r, x] = v.join(sym[r, x], sym[r, y])
        p = prior[at, i]
        left = p >= 0
        r, x, y = at[left], p[left], i[left]
        ranks[r, x], made[r, x] = v.join(sym[r, x], sym[r, y])
    held = sym >= 0
    found, per_row = sym[held], held.sum(axis=1)
    if (odd := found >= v.size).any():
        # characters without a piece become their bytes
        points = found[odd] - v.size
        points[points == ord(_OWN)] = ord(MARK)
        width = np.ones(len(found), np.int64)
        width[odd] += (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        rows = np.repeat(np.arange(n), per_row)
        per_row = np.bincount(rows, weights=width, minlength=n).astype(np.int64)
        odd, found = np.repeat(odd, width), np.repeat(found, width)
        found[odd] = v.byte_ids[np.frombuffer("".join(map(chr, points.tolist())).encode(), np.uint8)]
    blob = found.astype("<u4").tobytes()
    ends = (4 * np.cumsum(per_row)).tolist()
    return [blob[a:b] for a, b in zip([0, *ends], ends)]


class Segmentations:
    """What becomes of units when certain candidates are skipped: a tree for each unit.

    A node stands for the turns whose candidates were skipped. It holds the ids that result if no further one is,
    and a slot for each turn after its last skip; skipping the candidate of that turn leads to a child. An occurrence
    goes down by its own key, so its skips are its own, and only work that does not depend on the key is shared.
    """

    def __init__(self, v: Vocabulary, limit: int):
        self.v, self.limit = v, limit
        self.clear()

    def clear(self) -> None:
        self.roots: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.chars, self.used_chars = np.zeros(1 << 14, np.uint32), 0
        self.used = 0
        #: of a node: its unit's place and length in ``chars``, the node above and the turn skipped there, place of its slots,
        #: its first turn, and the turn after its last
        self.text, self.size, self.above, self.turn, self.start, self.since, self.until = (np.zeros(1024, np.int64) for _ in range(7))
        #: of a slot: the child, and the node it belongs to
        self.child, self.owner = np.full(1024, -1, np.int32), np.zeros(1024, np.int32)

    @staticmethod
    def _grown(x: np.ndarray, n: int, fill: int = 0) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.full(max(n, 2 * len(x)) - len(x), fill, x.dtype)])

    def _add(self, text: np.ndarray, size: np.ndarray, above: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Nodes for units that skip what the nodes above skip, and the candidate of ``turn`` there."""
        first, n = len(self.ids), len(text)
        for name, x in (("text", text), ("size", size), ("above", above), ("turn", turn), ("start", turn), ("since", turn), ("until", turn)):
            held = self._grown(getattr(self, name), first + n)
            held[first : first + n] = x
            setattr(self, name, held)
        order = np.argsort(size, kind="stable")
        lengths, at, made = size[order], 0, [b""] * n
        while at < n:
            # like lengths go together, so that matrices hold little padding
            end = min(at + 20_000, int(np.searchsorted(lengths, max(8, -(-int(lengths[at]) * 3 // 2)), side="right")))
            part = order[at:end]
            wide = int(lengths[end - 1])
            chars = self.chars[np.minimum(text[part][:, None] + np.arange(wide), self.used_chars - 1)]
            forced = np.zeros((len(part), int(turn[part].max()) + 1), bool)
            node, rows = first + part, np.arange(len(part))
            while True:
                going = self.turn[node] >= 0
                node, rows = node[going], rows[going]
                if not len(node):
                    break
                forced[rows, self.turn[node]] = True
                node = self.above[node]
            came = np.zeros(len(part), np.int64)
            for i, x in zip(part.tolist(), segment_many(chars, size[part], self.v, forced, came)):
                made[i] = x
            nodes, since = first + part, turn[part] + 1
            count = np.maximum(came - since, 0)
            total = int(count.sum())
            self.child, self.owner = self._grown(self.child, self.used + total, -1), self._grown(self.owner, self.used + total)
            self.start[nodes], self.since[nodes], self.until[nodes] = self.used + np.cumsum(count) - count, since, since + count
            self.owner[self.used : self.used + total] = np.repeat(nodes, count)
            self.used += total
            at = end
        self.ids += made
        return np.arange(first, first + n)

    def _roots(self, units: list[str]) -> None:
        size = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
        self.chars = self._grown(self.chars, self.used_chars + len(points))
        self.chars[self.used_chars : self.used_chars + len(points)] = points
        text = self.used_chars + np.cumsum(size) - size
        self.used_chars += len(points)
        none = np.full(len(units), -1)
        self.roots.update(zip(units, self._add(text, size, none, none).tolist()))

    def _children(self, slots: np.ndarray) -> None:
        above = self.owner[slots].astype(np.int64)
        self.child[slots] = self._add(self.text[above], self.size[above], above, slots - self.start[above] + self.since[above])

    def look_up(self, units: list[str], keys: np.ndarray) -> list[bytes]:
        """Ids of each occurrence of a unit of at most SHORT characters."""
        if len(self.ids) > CACHE:
            self.clear()
        if new := list({u for u in units if u not in self.roots}):
            self._roots(new)
        at = np.fromiter(map(self.roots.__getitem__, units), np.int64, len(units))
        going = np.flatnonzero(self.until[at] > 0) if self.limit else np.empty(0, np.int64)
        block, mask = np.zeros(len(going), np.int64), skips(keys[going], 0, self.limit)
        while len(going):
            # the next skip of this block of turns, if the node still has a candidate then
            turn, node = LANES * block + _LOWEST[mask], at[going]
            until = self.until[node]
            hit = (mask != 0) & (turn < until)
            further = (mask == 0) & (LANES * (block + 1) < until)
            h = np.flatnonzero(hit)
            slots = self.start[node[h]] + turn[h] - self.since[node[h]]
            if len(missing := np.unique(slots[self.child[slots] < 0])):
                self._children(missing)
            at[going[h]] = self.child[slots]
            mask[h] &= mask[h] - np.uint8(1)
            f = np.flatnonzero(further)
            block[f] += 1
            mask[f] = skips(keys[going[f]], block[f], self.limit)
            stay = hit | further
            going, block, mask = going[stay], block[stay], mask[stay]
        return list(map(self.ids.__getitem__, at.tolist()))


class Encoder:
    """Encodes texts; each occurrence of a unit has its own key of seed, document and place."""

    def __init__(self, path: str, dropout: float, seed: int):
        self.v, self.seed = Vocabulary(path), seed
        self.limit = round(dropout * (1 << 16))
        self.kept = Segmentations(self.v, self.limit)

    def units(self, text: str) -> list[str]:
        return _units(MARK + text.replace(MARK, _OWN).replace(" ", MARK)) if text else []

    def keys(self, key: int | None, n: int) -> np.ndarray:
        start = np.uint64(xxhash.xxh3_64_intdigest(f"{self.seed}:{key}"))
        return mix64(np.arange(n, dtype=np.uint64) + start)

    def _coded(self, units: list[str], keys: np.ndarray) -> list[bytes]:
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        if not len(long := np.flatnonzero(sizes > SHORT)):
            return self.kept.look_up(units, keys)
        short = np.flatnonzero(sizes <= SHORT)
        out: list[bytes] = [b""] * len(units)
        for i, ids in zip(short.tolist(), self.kept.look_up([units[i] for i in short.tolist()], keys[short])):
            out[i] = ids
        for i in long.tolist():
            out[i] = b"".join(map(self.v.coded, segment(units[i], self.v, self.limit, int(keys[i]))))
        return out

    def encode_many(self, texts: list[str | None], keys: list[int | None]) -> list[np.ndarray]:
        """Ids of whole texts."""
        out = []
        for start in range(0, len(texts), TOGETHER):
            split = [self.units(t or "") for t in texts[start : start + TOGETHER]]
            units = list(itertools.chain.from_iterable(split))
            each = np.concatenate([self.keys(k, len(u)) for k, u in zip(keys[start : start + TOGETHER], split)])
            found: list[bytes] = []
            for a in range(0, len(units), SLICE):
                found += self._coded(units[a : a + SLICE], each[a : a + SLICE])
            ends = list(itertools.accumulate(map(len, split)))
            out += [np.frombuffer(b"".join(found[a:b]), "<u4") for a, b in zip([0, *ends], ends)]
        return out

    def encode(self, text: str | None, key: int | None) -> np.ndarray:
        return self.encode_many([text], [key])[0]

    def decoded_many(self, lists: list) -> list[bytes]:
        """UTF-8 of texts; the space that stands for the leading mark goes."""
        out = []
        for start in range(0, len(lists), 64):
            some = [np.asarray(x, np.int64) for x in lists[start : start + 64]]
            ids = np.concatenate(some)
            sizes = self.v.out_sizes[ids]
            ends = np.cumsum(sizes)
            flat = self.v.out_flat[np.arange(sizes.sum()) + np.repeat(self.v.out_start[ids] - ends + sizes, sizes)].tobytes()
            cuts = np.append(0, ends)[np.cumsum([0, *map(len, some)])].tolist()
            out += [flat[a + flat.startswith(b" ", a, b) : b] for a, b in zip(cuts, cuts[1:])]
        return out

    def decoded(self, ids) -> bytes:
        return self.decoded_many([ids])[0]

    def decode(self, ids) -> str:
        return self.decoded(ids).decode("utf-8", "replace")


_encoders: dict = {}


def encoder(path: str, dropout: float, seed: int) -> Encoder:
    if (path, dropout, seed) not in _encoders:
        _encoders.clear()
        _encoders[path, dropout, seed] = Encoder(path, dropout, seed)
    return _encoders[path, dropout, seed]


def encode(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids, ids_crc32, lossless) per row: BPE-dropout by keyed hashes, over whole texts.

    Merges run in an agenda, best score first; a candidate that comes up is skipped with probability
    ``dropout``, decided by a hash of seed, id, the unit's place in the text, and the candidate's turn in the
    unit's agenda. So each occurrence of a unit has skips of its own, and the same row gives the same
    ids on every run. With dropout 0 the ids are the model's own.
    ``lossless``: decoding the ids gave back the whole text.

    A mark (U+2581) in the text is written as bytes, so that it is not taken for a space. Null and
    empty text: no ids, lossless. Null ids: the key "None". Repeated rows: equal results. An empty
    table gives an empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        e = encoder(model_path, dropout, seed)
        for batch in batches:
            all_ids, crcs, same = [], [], []
            docs_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = e.encode_many(texts, docs_)
            for text, ids, back in zip(texts, found, e.decoded_many(found)):
                all_ids.append(ids.view(np.int32))
                crcs.append(zlib.crc32(ids))
                same.append(back == (text or "").encode())
            sizes = [len(x) for x in all_ids]
            flat = np.concatenate(all_ids) if all_ids else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), lists, pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())],
                ["doc_id", "n_ids", "ids", "ids_crc32", "lossless"],
            )

    return base.mapInArrow(lean(run), "doc_id long, n_ids long, ids array<int>, ids_crc32 long, lossless boolean")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of id lists; null ids: null text; empty ids: empty text."""
    base = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches):
        import pyarrow as pa

        e = encoder(model_path, 0.0, 0)
        for batch in batches:
            texts = [None if x is None else e.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return base.mapInArrow(run, "doc_id long, text string")
