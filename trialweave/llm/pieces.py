"""SentencePiece encoding that keeps source offsets, and decoding.

A text is normalised prefix by prefix: the longest entry of the model's compiled character map
that starts at the position is replaced, and every byte that comes out remembers the source
byte it came from.  Byte-pair merges then give pieces, whose ends are projected through that
alignment to byte spans of the original text.  Merges run on units between which the
vocabulary can't merge, so equal units share their result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.words import Hasher, text_slices
from trialweave.llm.workers import giving_back

META = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
CACHED_UNITS = 150_000


class CharacterMap:
    """The compiled map of a model: a double-array trie of prefixes and their replacements."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix at a position and what replaces it."""
        if not self.units:
            return None
        found, node = None, 0
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                found = k + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.strings[start : self.strings.index(b"\0", start)]


def _width(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Pieces:
    """A byte-pair model read from its file's bytes; ``encode`` and ``decode`` whole texts."""

    def __init__(self, blob: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not spec.escape_whitespaces or any(p.type not in (_NORMAL, _UNKNOWN, _CONTROL, _BYTE) for p in proto.pieces):
            raise ValueError("a byte-pair model without user-defined pieces is needed")
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.fallback = proto.trainer_spec.byte_fallback
        self.score, self.ids, self.bytes_of = {}, {}, {}
        self.surface: list[bytes] = []
        self.size: list[int] = []
        for i, p in enumerate(proto.pieces):
            raw = p.piece.encode()
            if p.type == _NORMAL:
                self.score[p.piece], self.ids[p.piece] = p.score, i
            elif p.type == _BYTE:
                raw = bytes([int(p.piece[3:5], 16)])
                self.bytes_of[raw[0]] = i
            elif p.type == _UNKNOWN:
                self.unknown, raw = i, " ⁇ ".encode()
            else:
                raw = b""
            self.surface.append(raw.replace(META.encode(), b" ") if p.type == _NORMAL else raw)
            self.size.append(len(self.surface[-1]))
        self.sizes = np.array(self.size, np.int64)
        self.numbers = [str(i) for i in range(len(self.size))]
        self.crossing = any(re.search(f"[^{META}]{META}", p) for p in self.ids)
        self.apart = not any("\n" in p for p in self.ids)
        self.hasher = Hasher()
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self._pairs()

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text with a plain space for each space mark, and for each of its bytes, and its end, the source byte offset."""
        data = text.encode()
        if not self.map.units and not self.squeeze:
            if not data:
                return b"", np.zeros(1, np.int64)
            origin = np.arange(len(data) + 1)
            if META in text:
                marks = [m.start() for m in re.finditer(META.encode(), data)]
                origin = np.delete(origin, [p + k for p in marks for k in (1, 2)])
                data = data.replace(META.encode(), b" ")
            return (b" " + data, np.append(0, origin)) if self.dummy else (data, origin)
        out, origin, at = bytearray(), [], 0
        blank = self.squeeze  # whether the next space is to be dropped
        while at < len(data):
            n, new = self.map.longest(data, at) or (_width(data[at]), data[at : at + _width(data[at])])
            for byte in new.replace(META.encode(), b" "):
                if byte == 0x20 and blank:
                    continue
                if not out and self.dummy:
                    out.append(0x20)
                    origin.append(at)
                out.append(byte)
                origin.append(at)
                blank = self.squeeze and byte == 0x20
            at += n
        end = len(data)
        while self.squeeze and out[-1:] == b" ":
            end = origin.pop()
            del out[-1]
        return bytes(out), np.array([*origin, end], np.int64)

    def _pairs(self) -> None:
        """Symbols numbered in merge order, and an open-addressed table from pairs to what they merge to."""
        ranked = sorted(self.ids, key=lambda p: -self.score[p])
        count = Counter(self.score[p] for p in ranked if len(p) > 1)
        tied = [p for p in ranked if len(p) > 1 and count[self.score[p]] > 1]
        self.tied = re.compile("|".join(map(re.escape, tied)) or r"(?!)")  # units with these merge one by one
        symbols = list(dict.fromkeys([*ranked, *(c for p in ranked for c in p)]))
        self.symbol = {s: k for k, s in enumerate(symbols)}
        self.out = np.array([self.ids.get(s, -1) for s in symbols], np.int64)
        self.names = symbols
        left, right, made = [], [], []
        for p in self.ids:
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(self.symbol[p])
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        self.bits = max(10, int(len(keys)).bit_length() + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.made = np.zeros(1 << self.bits, np.int64)
        self.by_code = np.full(0x110000, -2, np.int32)
        for s, k in self.symbol.items():
            if len(s) == 1:
                self.by_code[ord(s)] = k
        rest, slot, values = keys, self._slot(keys), np.array(made, np.int64)
        while len(rest):
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]], self.made[slot[won]] = rest[won], values[won]
            left_over = np.ones(len(rest), bool)
            left_over[won] = False
            rest, values, slot = rest[left_over], values[left_over], slot[left_over]
            slot = np.where(self.keys[slot] >= 0, (slot + 1) & (len(self.keys) - 1), slot)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbol that each pair merges to, or the number of symbols where none does."""
        none = len(self.names)
        result = np.full(a.shape, none, np.int32)
        at = np.flatnonzero((a >= 0) & (b >= 0) & (a < none) & (b < none))
        keys = (a.ravel()[at].astype(np.int64) << 32) | b.ravel()[at]
        slot = self._slot(keys)
        flat = result.ravel()
        while len(at):
            seen = self.keys[slot]
            hit = seen == keys
            flat[at[hit]] = self.made[slot[hit]]
            on = ~hit & (seen >= 0)
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & (len(self.keys) - 1)
        return flat.reshape(a.shape)

    def merge_many(self, units: list[str]) -> list[tuple[int, ...]]:
        """Ids of each unit: the best-scored neighbours merge first, the leftmost of equal ones.

        Units of similar length merge together, one merge of each unit per step.
        """
        result: list[tuple[int, ...]] = [()] * len(units)
        groups: dict[int, list[int]] = {}
        for k, u in enumerate(units):
            if len(u) > 48 or self.tied.search(u):
                result[k] = self._to_ids(self._merge_long(list(u)))
            else:
                groups.setdefault((len(u) + 3) // 4, []).append(k)
        for width, members in groups.items():
            width *= 4
            size = np.array([len(units[k]) for k in members])
            code = np.frombuffer("".join([units[k] for k in members]).encode("utf-32-le"), np.uint32)
            grid = np.full((len(members), width), -1, np.int32)
            grid[np.arange(width) < size[:, None]] = self.by_code[code]
            grid = self._merge_grid(grid)
            used = grid != -1
            ids = np.where(grid >= 0, self.out[grid], -1)
            plain = ((ids >= 0) | ~used).all(1).tolist()
            flat, stop = ids[used].tolist(), np.cumsum(used.sum(1)).tolist()
            start = 0
            for row, (k, end) in enumerate(zip(members, stop, strict=True)):
                result[k] = tuple(flat[start:end]) if plain[row] else self._to_ids(self._spell(units[k], grid[row]))
                start = end
        return result

    def _merge_grid(self, grid: np.ndarray) -> np.ndarray:
        rows, width, none = np.arange(len(grid)), grid.shape[1], len(self.names)
        if width < 2:
            return grid
        work, made = grid.copy(), self._join(grid[:, :-1], grid[:, 1:])
        column = np.arange(width)
        while len(rows):
            at = np.arange(len(rows))
            spot = made.argmin(1)
            merged = made[at, spot]
            live = merged < none
            if not live.all():
                grid[rows[~live]] = work[~live]
                rows, work, made, spot, merged = rows[live], work[live], made[live], spot[live], merged[live]
                at = at[: len(rows)]
                if not len(rows):
                    break
            work[at, spot] = merged
            later = column > spot[:, None]
            moved = np.full_like(work, -1)
            moved[:, :-1] = work[:, 1:]
            work = np.where(later, moved, work)
            moved = np.full_like(made, none)
            moved[:, :-1] = made[:, 1:]
            made = np.where(later[:, :-1], moved, made)
            for side in (spot - 1, spot):
                ok = np.flatnonzero((side >= 0) & (side < width - 1))
                j = side[ok]
                made[ok, j] = self._join(work[ok, j], work[ok, j + 1])
        return grid

    def _spell(self, unit: str, symbols: np.ndarray) -> list[str]:
        out, at = [], 0
        for s in symbols[symbols != -1].tolist():
            out.append(unit[at] if s == -2 else self.names[s])
            at += len(out[-1])
        return out

    def _to_ids(self, symbols: list[str]) -> tuple[int, ...]:
        ids: list[int] = []
        for s in symbols:
            found = self.ids.get(s)
            if found is not None:
                ids.append(found)
            elif self.fallback:
                ids.extend(self.bytes_of[b] for b in s.encode())
            else:
                ids.append(self.unknown)
        return tuple(ids)

    def _merge_long(self, symbols: list[str]) -> list[str]:
        score, n = self.score, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                both = symbols[i] + symbols[after[i]]
                if both in score:
                    heapq.heappush(heap, (-score[both], i, both))

        for i in range(n):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [s for s in symbols if s]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text the ids, and the start and end of each piece as its byte offsets.

        Equal units of a call are told by 64-bit hashes, those of earlier calls by their bytes.
        """
        normal = [self.normalise(t) for t in texts]
        whole = b"".join([t for t, _ in normal])
        data = np.frombuffer(whole, np.uint8)
        bounds = np.append(0, np.cumsum([len(t) for t, _ in normal]))
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        if not self.crossing:
            space, newline = data == 0x20, (data == 0x0A) & self.apart
            cut[:-1] |= space | newline
            cut[1:-1] &= ~(space[1:] & space[:-1])
            cut[1:-1] |= newline[:-1]
            cut[bounds] = True
        start = np.flatnonzero(cut[:-1])
        end = np.append(start[1:], len(data))
        _, first, which = np.unique(self.hasher.spans(data, start, end), return_index=True, return_inverse=True)
        units = [whole[i:j] for i, j in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        cache = self.cache
        if len(cache) > CACHED_UNITS:
            cache.clear()
        new = [u for u in units if u not in cache]
        cache.update(zip(new, self.merge_many([u.decode().replace(" ", META) for u in new]), strict=True))
        found = [cache[u] for u in units]
        length = np.array([len(x) for x in found], np.int64)
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(length.sum()))
        offset = np.cumsum(length) - length
        counts = length[which]
        stops = np.append(0, np.cumsum(counts))
        ids = flat[np.repeat(offset[which] - stops[:-1], counts) + np.arange(stops[-1])]
        tokens = stops[np.searchsorted(start, bounds)]
        for k, (text, origin) in enumerate(normal):
            own = ids[tokens[k] : tokens[k + 1]]
            if not self.fallback and (own == self.unknown).any():
                own = own[np.append(True, (own[1:] != self.unknown) | (own[:-1] != self.unknown))]
                yield own, *self._unknown_spans(text, origin, own.tolist())
                continue
            size = self.sizes[own]
            ends = np.cumsum(size)
            yield own, origin[ends - size], origin[ends]

    def _unknown_spans(self, data: bytes, origin: np.ndarray, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        ends, at = [], 0
        for k, i in enumerate(ids):
            if i != self.unknown:
                at += self.size[i]
            else:
                later = self.surface[ids[k + 1]] if k + 1 < len(ids) else None
                at = len(data) if later is None else data.index(later, at + 1)
            ends.append(at)
        stops = np.array(ends)
        return origin[np.append(0, stops[:-1])], origin[stops]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no character become U+FFFD."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        if self.dummy and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def _with_model(docs: DataFrame, blob: bytes, rows, fields: list[pa.Field], schema: str, text: str, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(blob)
        for batch in batches:
            if pa.types.is_string(batch.schema.field("t").type):
                parts = (part for part, _, _ in text_slices(batch, "t"))
            else:
                parts = (batch.slice(low, 256) for low in range(0, batch.num_rows, 256))
            for part in parts:
                columns = list(zip(*rows(model, part["t"].to_pylist()), strict=True))
                arrays = [pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([part["k"], *arrays], [key, *(f.name for f in fields)])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, {schema}"
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(giving_back(run), schema)


def encode(docs: DataFrame, model_file: str, text: str = "text", key: str = "doc_id", decoded: str | None = None) -> DataFrame:
    """``(key, ids, begins, ends)``: piece ids and their byte spans in the text.

    A null text has null arrays, an empty one empty arrays.  With ``decoded``, a column of that
    name holds the text that the ids decode to.  The file is read on the driver; tasks get its
    bytes.
    """
    numbers = pa.list_(pa.int32())
    fields = [pa.field(c, numbers) for c in ("ids", "begins", "ends")]
    schema = "ids array<int>, begins array<int>, ends array<int>"
    if decoded:
        fields.append(pa.field(decoded, pa.string()))
        schema += f", `{decoded}` string"

    def rows(model: Pieces, texts: list[str | None]):
        for t, found in zip(texts, model.encode([t or "" for t in texts]), strict=True):
            if t is None:
                yield (None,) * len(fields)
            else:
                yield (*found, model.decode(found[0].tolist())) if decoded else found

    return _with_model(docs, _read(model_file), rows, fields, schema, text, key)


def decode(rows: DataFrame, model_file: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``(key, text)`` from piece ids; null for null."""

    def texts(model: Pieces, many: list[list[int] | None]):
        return ((None if x is None else model.decode(x),) for x in many)

    return _with_model(rows, _read(model_file), texts, [pa.field("text", pa.string())], "text string", ids, key)


def digests(docs: DataFrame, model_file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_tokens, n_bytes, ids_sha256, decoded_sha256)`` of each whole text; null is empty.

    ``n_bytes`` is the number of source bytes the spans cover.
    """
    fields = [pa.field("n_tokens", pa.int64()), pa.field("n_bytes", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]

    def rows(model: Pieces, texts: list[str | None]):
        for ids, begins, ends in model.encode([t or "" for t in texts]):
            ids = ids.tolist()
            listed = ",".join(map(model.numbers.__getitem__, ids))
            yield (
                len(ids),
                int((ends - begins).sum()),
                hashlib.sha256(listed.encode()).hexdigest(),
                hashlib.sha256(model.decode(ids).encode()).hexdigest(),
            )

    return _with_model(docs, _read(model_file), rows, fields, "n_tokens bigint, n_bytes bigint, ids_sha256 string, decoded_sha256 string", text, key)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
