"""Substring dedup: remove words covered by a window that starts in an earlier document too.

Every window of ``width`` words gets a 64-bit rolling hash.  A task looks at its own documents
first: where several share a window, only the one with the smallest key is undecided, so a
passage of very many documents leaves one entry per task.  Undecided windows are packed by the
leading bits of their hash (which need no storing), shuffled on those bits and compared; a
window whose smallest document lies elsewhere is reported to its document.  Reported windows
merge into maximal word intervals when the text is read again.

Windows are compared by their 64-bit hashes: two different word sequences among ``n`` windows
are taken for equal with a chance below ``n * n / 2**65``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.words import SPACE, Hasher, mix, runs, shingles, text_slices

#: Windows that one group is sized for, and that a task gathers before it packs them.
GROUP_WINDOWS = 1 << 20
_NULL_KEY = np.int64(-(1 << 63))
_HASHES, _INTERVALS = 0, 1
_PACKED = "part int, kind int, docs binary, counts binary, payload binary"


def _pack(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), kind)


def merge_windows(starts: np.ndarray, width: int) -> np.ndarray:
    """Maximal word intervals, as rows of begin and end, that sorted window starts cover."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(starts) > width) + 1
    return np.column_stack([starts[np.append(0, cut)], starts[np.append(cut - 1, len(starts) - 1)] + width])


def _by_doc(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a run of equal documents begins, and the run lengths."""
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(doc)))


def _announce(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """Packed undecided windows by hash, and packed intervals decided inside a task."""
    stored = (64 - bits + 7) // 8

    def packed(value: np.ndarray, doc: np.ndarray, word: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(value, kind="stable")
        value, doc, word = value[order], doc[order], word[order]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(value))))
        open_ = doc == least
        rows: list[tuple] = []
        # undecided: once per document and hash
        v, d = value[open_], doc[open_]
        fresh = np.append(True, (v[1:] != v[:-1]) | (d[1:] != d[:-1]))
        v, d = v[fresh], d[fresh]
        part = (v >> np.uint64(64 - bits)).astype(np.int64)
        order = np.lexsort((d, part))
        v, d, part = v[order], d[order], part[order]
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for low, high in zip(edges, np.append(edges[1:], len(part)), strict=True):
            begins, counts = _by_doc(d[low:high])
            ids = d[low:high][begins]
            raw = v[low:high].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :stored].tobytes()
            rows.append((int(part[low]), _HASHES, _pack(np.diff(ids, prepend=np.int64(0))), _pack(counts.astype(np.uint32)), raw))
        # decided: intervals, sent by document
        d, w = doc[~open_], word[~open_]
        order = np.lexsort((w, d))
        d, w = d[order], w[order]
        begins, counts = _by_doc(d)
        for low, count in zip(begins, counts, strict=True):
            spans = merge_windows(np.unique(w[low : low + count]), width).astype(np.int64)
            home = int(mix(d[low : low + 1].view(np.uint64))[0] >> np.uint64(64 - bits))
            rows.append((home, _INTERVALS, d[low : low + 1].tobytes(), b"", spans.tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
            ["part", "kind", "docs", "counts", "payload"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Hasher(), [], 0
        for batch in batches:
            for part, data, offsets in text_slices(batch, "t"):
                keys = part["k"].fill_null(int(_NULL_KEY)).to_numpy(zero_copy_only=False)
                start, end, doc = runs(data, offsets, SPACE)
                value, at = shingles(hasher.spans(data, start, end), doc, width)
                word = at - np.searchsorted(doc, doc[at], "left")
                held.append((value, keys[doc[at]], word))
                size += len(value)
                if size >= GROUP_WINDOWS:
                    yield packed(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            yield packed(*map(np.concatenate, zip(*held, strict=True)))

    return docs.select(F.col("k"), F.col("t")).mapInArrow(run, _PACKED)


def _answer(packed: DataFrame, bits: int) -> DataFrame:
    """``(k, kind, payload)``: for each document the hashes or intervals to remove."""
    stored = (64 - bits + 7) // 8

    def compare(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        keys, out_kind, payload = [], [], []
        docs, values = [], []
        for k, kind in enumerate(kinds):
            if kind == _INTERVALS:
                keys.append(int(np.frombuffer(table["docs"][k].as_py(), np.int64)[0]))
                out_kind.append(_INTERVALS)
                payload.append(table["payload"][k].as_py())
                continue
            raw = np.frombuffer(table["payload"][k].as_py(), np.uint8).reshape(-1, stored)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :stored] = raw
            values.append(wide.view("<u8").ravel())
            ids = np.cumsum(_unpack(table["docs"][k].as_py(), np.int64))
            docs.append(np.repeat(ids, _unpack(table["counts"][k].as_py(), np.uint32)))
        if values:
            value, doc = np.concatenate(values), np.concatenate(docs)
            order = np.argsort(value, kind="stable")
            value, doc = value[order], doc[order]
            first, counts = _by_doc(value)
            later = doc > np.repeat(np.minimum.reduceat(doc, first), counts)
            value, doc = value[later], doc[later]
            order = np.argsort(doc, kind="stable")
            value, doc = value[order], doc[order]
            prefix = np.uint64(table["part"][0].as_py()) << np.uint64(64 - bits)
            mask = np.uint64((1 << (64 - bits)) - 1)
            for low, count in zip(*_by_doc(doc), strict=True):
                keys.append(int(doc[low]))
                out_kind.append(_HASHES)
                payload.append(((value[low : low + count] & mask) | prefix).tobytes())
        return pa.table([pa.array(keys, pa.int64()), pa.array(out_kind, pa.int32()), pa.array(payload, pa.binary())], ["k", "kind", "payload"])

    return packed.groupBy("part").applyInArrow(compare, "k bigint, kind int, payload binary")


def remove_repeats(docs: DataFrame, width: int = 13, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_words, intervals, kept)`` for every row of ``docs``.

    Words are runs without ASCII white space, unchanged.  ``intervals`` are the maximal word
    ranges ``[begin, end)`` covered by a window that also starts in a row with a smaller key;
    ``kept`` is what is left, joined by single spaces.  Windows are judged on the input.
    Null text has no words; a null key counts as the smallest; rows that share a key do not
    remove each other's words.  The key is an integer.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t")).alias("n")).first().n or 0
    bits = min(24, max(8, int(size // 6 // GROUP_WINDOWS).bit_length()))
    answers = _answer(_announce(rows, width, bits), bits).groupBy("k").agg(F.collect_list(F.struct("kind", "payload")).alias("gone"))
    joined = rows.join(answers, F.coalesce(rows.k, F.lit(int(_NULL_KEY))) == answers.k, "left").select(rows.k.alias("k"), "t", "gone")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part, data, offsets in text_slices(batch, "t"):
                gone = part["gone"].to_pylist()
                start, end, doc = runs(data, offsets, SPACE)
                value, at = shingles(hasher.spans(data, start, end), doc, width) if any(gone) else (None, None)
                words_at = np.searchsorted(doc, np.arange(len(gone) + 1))
                spans, kept = [], []
                whole = data.tobytes()
                for i, answer in enumerate(gone):
                    words = whole[offsets[i] : offsets[i + 1]].split()
                    own = np.zeros((0, 2), np.int64)
                    if answer:
                        low, high = np.searchsorted(at, words_at[i : i + 2])
                        hashes = [np.frombuffer(a["payload"], "<u8") for a in answer if a["kind"] == _HASHES]
                        ready = [np.frombuffer(a["payload"], np.int64).reshape(-1, 2) for a in answer if a["kind"] == _INTERVALS]
                        hits = at[low:high][np.isin(value[low:high], np.concatenate(hashes))] - words_at[i] if hashes else np.zeros(0, np.int64)
                        cover = np.zeros(len(words) + 1, np.int64)
                        for ranges in [merge_windows(hits, width), *ready]:
                            np.add.at(cover, ranges[:, 0], 1)
                            np.add.at(cover, ranges[:, 1], -1)
                        inside = np.cumsum(cover)[:-1] > 0
                        edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
                        own = np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)])
                        kept.append(b" ".join(compress(words, (~inside).tolist())).decode())
                    else:
                        kept.append(b" ".join(words).decode())
                    spans.append(own)
                flat = np.concatenate(spans)
                pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["begin", "end"])
                edges = pa.array(np.append(0, np.cumsum([len(x) for x in spans])), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part["k"], pa.array(np.diff(words_at)), pa.ListArray.from_arrays(edges, pairs), pa.array(kept, pa.string())],
                    [key, "n_words", "intervals", "kept"],
                )

    return joined.mapInArrow(rest, f"`{key}` bigint, n_words bigint, intervals array<struct<begin:bigint,end:bigint>>, kept string")
