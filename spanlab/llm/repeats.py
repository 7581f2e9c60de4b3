"""Repeated byte strings by an enhanced suffix array.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier (a
smaller doc_id, or the same document and an earlier start) is removed.

1. *Anchors.*  The anchor of a window of ``LENGTH`` bytes is its least ``GRAM``-byte
   hash, the rightmost of equals: equal windows have equal anchors at equal
   places.  Neighbouring windows with one anchor form a superwindow of at most
   ``2 * LENGTH`` bytes.  Rows (anchor hash, superwindow hash, place) are shuffled once
   by anchor hash.  Of equal superwindows all but the first are repeats.
2. *Common-prefix interval tree.*  Anchors with several different superwindows need
   their texts, one of each kind.  Their window suffixes are sorted, a stack scan
   over the common prefixes of neighbours walks the interval tree, and intervals
   of ``LENGTH`` bytes or more whose occurrences are preceded by different bytes are
   the maximal repeat groups, with all occurrences.  All but the first of a group
   are repeats.
3. A document's repeats are united and cut out.

Skew: equal superwindows meet in the task that reads them before the shuffle, so
a passage in a third of the documents is a row of each batch.  An anchor with very
many different surroundings (a short line that everybody has) is found in a first
scan, and again when a group outgrows ``GROUP``; its windows are dealt one by one,
each by its own hash, instead of together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlab.llm.common import materialise, read

LENGTH = 100
GRAM = 20
#: Different superwindows of an anchor that are compared in one task.
GROUP = 2048
#: Anchors dealt by window from the start: those with so many rows, at most so many
#: of them (the list is broadcast), counting tasks in which they have LOCAL rows.
HOT_ROWS, HOT_ANCHORS, LOCAL = 2048, 200_000, 32
#: Bytes hashed together, and bytes of superwindows sorted together.
SLICE = 1 << 20
SORT_BYTES = 1 << 20

_U = np.uint64
_BYTE = np.random.default_rng(23).integers(1, 2**63, (2, 256), dtype=np.uint64) * _U(2) + _U(1)
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INVERSE = tuple(pow(b, -1, 1 << 64) for b in _BASE)
_MIX = _U(0xFF51AFD7ED558CCD)
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get((base, 0))
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 4 * LENGTH), _U(base), np.uint64)
        have[0] = 1
        have = _POWERS[base, 0] = np.multiply.accumulate(have)
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h *= _MIX
    h ^= h >> _U(29)
    return h


class Hashes:
    """Hashes of any substring of one byte array."""

    def __init__(self, data: np.ndarray, which: int):
        self.which = which
        terms = _BYTE[which][data]
        terms *= _powers(_BASE[which], len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def of(self, first, stop) -> np.ndarray:
        if isinstance(first, slice):
            h = self.sums[stop] - self.sums[first]
            h *= _powers(_INVERSE[self.which], len(h))
        else:
            h = (self.sums[stop] - self.sums[first]) * _powers(_INVERSE[self.which], len(self.sums))[first]
        return _mix(h)


def superwindows(data: np.ndarray, length: int, gram: int):
    """(anchor hash, first window, last window) of every run of windows with one anchor."""
    n = len(data)
    g = Hashes(data, 0).of(slice(0, n - gram + 1), slice(gram, n + 1))
    bits = _U(int(len(g)).bit_length())
    low = (_U(1) << bits) - _U(1)
    key = (g & ~low) | (low - np.arange(len(g), dtype=np.uint64))  # rightmost of equal hashes
    size, width = length - gram + 1, 1
    least = key
    while width < size:
        step = min(width, size - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = low - (least & low)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return g[at[first].astype(np.int64)], first, last


def _rows(text: bytes, length: int, gram: int, hot: np.ndarray):
    """(h, sh, start, n) of a text's superwindows; n + 1 windows start at start, start + 1, ..."""
    out = []
    for b in range(0, len(text) - length + 1, SLICE):
        data = np.frombuffer(text[b:b + SLICE + length - 1], np.uint8)
        h, first, last = superwindows(data, length, gram)
        second = Hashes(data, 1)
        sh = second.of(first, last + length)
        n = last - first
        if len(hot):
            at = np.searchsorted(hot, h)
            is_hot = hot[np.minimum(at, len(hot) - 1)] == h
            if is_hot.any():  # one row a window
                each = n[is_hot] + 1
                stops = np.cumsum(each)
                w = np.repeat(first[is_hot] - (stops - each), each) + np.arange(stops[-1])
                cold = ~is_hot
                h = np.concatenate([h[cold], Hashes(data, 0).of(w, w + length)])
                sh = np.concatenate([sh[cold], second.of(w, w + length)])
                first = np.concatenate([first[cold], w])
                n = np.concatenate([n[cold], np.zeros(len(w), n.dtype)])
        out.append((h, sh, first + b, n))
    return [np.concatenate(c) for c in zip(*out)] if out else None


def _hot_anchors(length: int, gram: int):
    """Anchor hashes with LOCAL or more different superwindows among a task's texts, counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            hs, shs = [], []
            for t in batch.column(0):
                if rows := _rows((t.as_py() or "").encode("utf-8", "surrogatepass"), length, gram, none):
                    hs.append(rows[0]), shs.append(rows[1])
            if not hs:
                continue
            h, sh = np.concatenate(hs), np.concatenate(shs)
            order = np.lexsort((sh, h))
            h, sh = h[order], sh[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (sh[1:] != sh[:-1])])
            found, n = np.unique(h[new], return_counts=True)
            keep = n >= max(LOCAL, new.sum() // HOT_ANCHORS)
            yield pa.record_batch([pa.array(found[keep].view(np.int64)), pa.array(n[keep])], names=["h", "n"])
    return run


def _deal(length: int, gram: int, shared):
    """doc_id, k, text -> superwindow rows, and the repeats already certain here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            parts, owners = [], []
            for i, t in enumerate(batch.column(2)):
                if rows := _rows((t.as_py() or "").encode("utf-8", "surrogatepass"), length, gram, hot):
                    parts.append(rows)
                    owners.append(np.full(len(rows[0]), i))
            if not parts:
                continue
            h, sh, start, n = (np.concatenate(c) for c in zip(*parts))
            owner = np.concatenate(owners)
            rank = _ranks(batch.column(0))[owner]
            order = np.lexsort((start, rank, sh, h))
            h, sh, start, n, owner, rank = (a[order] for a in (h, sh, start, n, owner, rank))
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (sh[1:] != sh[:-1])])
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            again = (rank != rank[first]) | (start != start[first])
            # repeats: one row a run of a document
            o, a, b = _merge(owner[again], start[again], start[again] + n[again] + length)
            keep = ~again
            take = pa.array(np.concatenate([owner[keep], o]))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([h[keep].view(np.int64), _mix((o * 0x9E3779B1 + a).astype(np.uint64)).view(np.int64)])),
                pa.array(np.concatenate([sh[keep].view(np.int64), np.zeros(len(o), np.int64)])),
                batch.column(0).take(take), batch.column(1).take(take),
                pa.array(np.concatenate([start[keep], a]).astype(np.int64)),
                pa.array(np.concatenate([n[keep], np.full(len(o), -1)]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(keep.sum(), np.int64), b]).astype(np.int64))],
                names=["h", "sh", "doc_id", "k", "start", "n", "stop"])
    return run


def _ranks(ids: pa.Array) -> np.ndarray:
    """Order of ids, nulls first."""
    return pd.factorize(ids.to_pandas(), sort=True)[0]


def _merge(owner: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Unite touching intervals of each owner."""
    if not len(owner):
        return owner, start, stop
    order = np.lexsort((start, owner))
    owner, start, stop = owner[order], start[order], stop[order]
    wide = int(stop.max()) + 2
    reach = np.maximum.accumulate(stop + owner.astype(np.int64) * wide)
    new = np.concatenate([[True], start[1:] + owner[1:].astype(np.int64) * wide > reach[:-1]])
    at = np.flatnonzero(new)
    ends = np.concatenate([at[1:], [len(owner)]]) - 1
    return owner[at], start[at], reach[ends] - owner[at].astype(np.int64) * wide


def _settle(length: int):
    """Superwindow rows sorted by (h, sh, doc_id, start) -> repeats, and one row of
    each different superwindow of an anchor (stop 0; n is below -1 in groups over GROUP)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last anchor's superwindows so far
        large = None  # the last anchor, if they were passed on already
        for batch in batches:
            if not batch.num_rows:
                continue
            n_held = held.num_rows if held is not None else 0
            table = pa.Table.from_batches([batch])
            if n_held:
                table = pa.concat_tables([held, table])
            out, held, large = _settle_rows(table, n_held, large, length)
            yield from out
        if held is not None:
            yield from _pass_on(held, large)

    def _pass_on(table: pa.Table, large) -> list[pa.RecordBatch]:
        """Complete anchors' superwindows."""
        h = table.column("h").to_numpy()
        _, group, size = np.unique(h, return_inverse=True, return_counts=True)
        keep = size[group] > 1
        n = table.column("n").to_numpy().copy()
        over = size[group] > GROUP
        if large is not None:
            keep |= h == large
            over |= h == large
        n[over] = -2 - n[over]
        table = table.set_column(5, "n", pa.array(n, pa.int32())).filter(pa.array(keep))
        return table.combine_chunks().to_batches()

    def _settle_rows(table: pa.Table, n_held: int, large, length: int):
        h, sh = table.column("h").to_numpy(), table.column("sh").to_numpy()
        start, n = table.column("start").to_numpy(), table.column("n").to_numpy()
        done = n == -1
        done[:n_held] = False
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (sh[1:] == sh[:-1])])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
        ids = table.column("doc_id")
        tied = pa.compute.equal(ids, ids.take(pa.array(first))).fill_null(False).to_numpy(zero_copy_only=False)
        tied |= ids.is_null().to_numpy(zero_copy_only=False) & ids.take(pa.array(first)).is_null().to_numpy(zero_copy_only=False)
        repeat = same & ~done & ~(tied & (start == start[first]))
        rep = ~same & ~done
        # rows of equal place (a repeated document) stay, without a part in the comparison
        out = []
        if (repeat | done).any():
            stop = table.column("stop").to_numpy().copy()
            stop[repeat] = start[repeat] + n[repeat] + length
            sent = table.set_column(6, "stop", pa.array(stop)).filter(pa.array(repeat | done))
            out += sent.combine_chunks().to_batches()
        last = h == h[-1]
        whole = rep & ~last
        if whole.any():
            out += _pass_on(table.filter(pa.array(whole)), large)
        if not last[:n_held].any():
            large = None
        keep = table.filter(pa.array(rep & last))
        if keep.num_rows > GROUP:  # too many to hold: this anchor's are dealt by window
            large = int(h[-1])
            out += _pass_on(keep.slice(0, keep.num_rows - 1), large)
            keep = keep.slice(keep.num_rows - 1)
        return out, keep if keep.num_rows else None, large

    return run


def _fetch(length: int):
    """doc_id, k, text, wanted[(h, sh, start, n)] -> rows with the superwindow's bytes.

    Windows of anchors over GROUP become rows of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = (batch.column(2)[i].as_py() or "").encode("utf-8", "surrogatepass")
                wanted = batch.column(3)[i].values
                h, sh, start, n = (np.asarray(wanted.field(x)) for x in ("h", "sh", "start", "n"))
                over = n < -1
                if over.any():
                    size = -2 - n[over] + 1
                    stops = np.cumsum(size)
                    w = np.sort(np.repeat(start[over] - (stops - size), size) + np.arange(stops[-1]))
                    hs, shs = [], []
                    for b in range(0, len(text) - length + 1, SLICE):
                        data = np.frombuffer(text[b:b + SLICE + length - 1], np.uint8)
                        own = w[(w >= b) & (w < b + SLICE)] - b
                        hs.append(Hashes(data, 0).of(own, own + length))
                        shs.append(Hashes(data, 1).of(own, own + length))
                    h = np.concatenate([h[~over], np.concatenate(hs).view(np.int64)])
                    sh = np.concatenate([sh[~over], np.concatenate(shs).view(np.int64)])
                    start = np.concatenate([start[~over], w])
                    n = np.concatenate([n[~over], np.zeros(len(w), n.dtype)])
                for at in range(0, len(h), 10_000):
                    s, m = start[at:at + 10_000].tolist(), n[at:at + 10_000].tolist()
                    one = pa.array(np.full(len(s), i))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(h[at:at + 10_000]), pa.array(sh[at:at + 10_000]),
                        batch.column(0).take(one), batch.column(1).take(one), pa.array(s, pa.int64()),
                        pa.array([text[a:a + b + length] for a, b in zip(s, m)], pa.binary())],
                        names=["h", "sh", "doc_id", "k", "start", "bytes"])
    return run


def repeat_groups(strings: list[bytes], group: np.ndarray, rank: np.ndarray, length: int):
    """Maximal repeat groups among ``strings`` of equal ``group``.

    Yields (bytes long, [(string, offset), ...]) with all occurrences, the first by
    (rank of the string's document, start) leading.  ``rank`` is (strings, 2): the
    document's rank and the string's start.
    """
    size = np.array([len(s) for s in strings], np.int64)
    base = np.cumsum(size) - size
    tail = 2 * length  # what a suffix may have beyond the common window
    data = np.frombuffer(b"".join(strings) + bytes(tail + 8), np.uint8)
    each = size - length + 1
    stops = np.cumsum(each)
    owner = np.repeat(np.arange(len(strings)), each)
    offset = np.arange(stops[-1]) - np.repeat(stops - each, each)
    at = base[owner] + offset
    h0, h1 = (Hashes(data, w).of(at, at + length) for w in (0, 1))
    # suffixes whose first `length` bytes nobody shares are in no repeat
    order = np.lexsort((h1, h0, group[owner]))
    same = (h0[order][1:] == h0[order][:-1]) & (h1[order][1:] == h1[order][:-1]) & (
        group[owner[order]][1:] == group[owner[order]][:-1])
    near = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    order = order[near]
    if not len(order):
        return
    own, off, pos = owner[order], offset[order], at[order]
    run = np.cumsum(~np.concatenate([[False], same])[near]) - 1
    rest = size[own] - off - length  # bytes after the common window
    # big-endian words of the rest, zero beyond its end
    words = []
    for w in range(0, int(rest.max()) if len(rest) else 0, 8):
        block = np.zeros((len(pos), 8), np.uint8)
        for j in range(8):
            real = w + j < rest
            block[real, j] = data[pos[real] + length + w + j]
        words.append(block.view(">u8").reshape(-1).astype(np.uint64))
    sort = np.lexsort((rest, *words[::-1], run)) if words else np.lexsort((rest, run))
    own, off, pos, run, rest = own[sort], off[sort], pos[sort], run[sort], rest[sort]
    words = [w[sort] for w in words]
    # common prefixes of neighbours
    lcp = np.zeros(len(own), np.int64)
    open_ = np.ones(len(own) - 1, bool)
    common = np.zeros(len(own) - 1, np.int64)
    for w in words:
        x = w[1:] ^ w[:-1]
        equal = x == 0
        lead = np.full(len(x), 8, np.int64)
        diff = ~equal
        lead[diff] = (63 - np.floor(np.log2(x[diff].astype(np.float64))).astype(np.int64)) // 8
        # rounding to the next power of two can only lift a value at a byte's border
        fix = diff & (lead > 0)
        shift = (_U(64) - _U(8) * lead.astype(np.uint64)) % _U(64)
        wrong = fix & ((x >> shift) != 0)
        lead[wrong] -= 1
        low = diff & (lead < 7)
        shift = (_U(56) - _U(8) * np.minimum(lead, 6).astype(np.uint64))
        lead[low & ((x >> shift) == 0)] += 1
        common += np.where(open_, lead, 0)
        open_ &= equal
    common = np.minimum(common, np.minimum(rest[1:], rest[:-1]))
    joined = run[1:] == run[:-1]
    lcp[1:] = np.where(joined, length + common, 0)
    before = np.where(off > 0, data[pos - 1], -1 - np.arange(len(own)))  # an edge differs from all
    key = np.lexsort((rank[own, 1] + off, rank[own, 0]))
    place = np.empty(len(own), np.int64)
    place[key] = np.arange(len(own))

    heights, prior = lcp.tolist() + [0], before.tolist()
    stack: list[list] = []  # [common prefix, first suffix, the byte before all or None]
    for i in range(1, len(heights)):
        height = heights[i]
        start, byte = i - 1, prior[i - 1]
        while stack and stack[-1][0] > height:
            top = stack.pop()
            shared = top[2] if top[2] == byte else None
            start, byte = top[1], shared
            if shared is None:  # left extensions differ: a maximal repeat
                members = np.arange(start, i)
                members = members[np.argsort(place[members])]
                yield top[0], list(zip(own[members].tolist(), off[members].tolist()))
        if height >= length:
            if stack and stack[-1][0] == height:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == byte else None
            else:
                stack.append([height, start, byte])


def _interval_tree(length: int):
    """Rows sorted by (h, doc_id, start) with bytes -> repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n_bytes = 0

        def work(table: pa.Table) -> pa.RecordBatch:
            h = table.column("h").to_numpy()
            strings = table.column("bytes").to_pylist()
            start = table.column("start").to_numpy()
            group = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
            ids = table.column("doc_id").combine_chunks()
            doc = _ranks(ids)
            rank = np.stack([doc, start], axis=1)
            who, a, b = [], [], []
            for size, members in repeat_groups(strings, group, rank, length):
                (s0, o0), *rest = members
                for s, o in rest:
                    if (doc[s], start[s] + o) != (doc[s0], start[s0] + o0):
                        who.append(s), a.append(start[s] + o), b.append(start[s] + o + size)
            o, a, b = _merge(np.array(who, np.int64), np.array(a, np.int64), np.array(b, np.int64))
            take = pa.array(o, pa.int64())
            return pa.RecordBatch.from_arrays(
                [ids.take(take), table.column("k").combine_chunks().take(take), pa.array(a, pa.int64()),
                 pa.array(b, pa.int64())], names=["doc_id", "k", "start", "stop"])

        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                piece = batch.slice(part, 2000)
                held.append(piece)
                n_bytes += sum(len(x) for x in piece.column(5).to_pylist())
                if n_bytes >= SORT_BYTES:
                    table = pa.Table.from_batches(held)
                    h = table.column("h").to_numpy()
                    cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
                    if cut:
                        yield work(table.slice(0, cut))
                        held = table.slice(cut).combine_chunks().to_batches()
                        n_bytes = sum(len(x) for x in table.slice(cut).column("bytes").to_pylist())
        if held:
            yield work(pa.Table.from_batches(held))
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, repeats -> doc_id, n_bytes, spans, kept."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            n_bytes, spans, kept = [], [], []
            for text, found in zip(part.column(1), part.column(2)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                runs: list[tuple[int, int]] = []
                if found.is_valid:
                    start, stop = (np.asarray(found.values.field(x)) for x in ("start", "stop"))
                    _, start, stop = _merge(np.zeros(len(start), np.int64), start, stop)
                    runs = list(zip(start.tolist(), stop.tolist()))
                n_bytes.append(len(data))
                spans.append([{"start": a, "stop": b} for a, b in runs])
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_bytes, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                 pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, k, start, stop)``: bytes that repeat earlier ones; k is a hash of the text."""
    spark = docs.sparkSession
    docs = keyed(docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    hot = (docs.select("text").mapInArrow(_hot_anchors(length, gram), "h long, n long")
           .groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_ROWS)
           .orderBy(F.desc("n"), "h").limit(HOT_ANCHORS).select("h").collect())
    shared = spark.sparkContext.broadcast(np.sort(np.array([r.h for r in hot], np.int64).view(np.uint64)))
    place = f"h long, sh long, doc_id {id_type}, k int"
    dealt = docs.mapInArrow(_deal(length, gram, shared), f"{place}, start long, n int, stop long")
    settled = materialise(
        dealt.repartition("h").sortWithinPartitions("h", "sh", "doc_id", "start")
        .mapInArrow(_settle(length), f"{place}, start long, n int, stop long"), "repeats-anchors")
    certain = settled.where("stop > 0").select("doc_id", "k", "start", "stop")
    wanted = (settled.where("stop = 0").groupBy("doc_id", "k")
              .agg(F.collect_list(F.struct("h", "sh", "start", "n")).alias("wanted")))  # one document's
    fetched = (docs.join(wanted, docs.doc_id.eqNullSafe(wanted.doc_id) & (docs.k == wanted.k))
               .select(docs.doc_id, docs.k, "text", "wanted")
               .mapInArrow(_fetch(length), f"{place}, start long, bytes binary"))
    compared = (fetched.repartition("h").sortWithinPartitions("h", "doc_id", "start")
                .mapInArrow(_interval_tree(length), f"doc_id {id_type}, k int, start long, stop long"))
    return certain.union(compared)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.hash("text").alias("k"), "text")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` of every row of ``docs``.

    Null and empty texts have no bytes.  Rows that share a doc_id are one document:
    what starts at the same place in both does not start earlier.  A null doc_id is
    smaller than any other.  Texts under ``length`` bytes stay whole.
    """
    found = (repeats(docs, length, gram).groupBy("doc_id", "k")
             .agg(F.collect_list(F.struct("start", "stop")).alias("repeats")))  # one document's
    docs = keyed(docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return (docs.join(found, docs.doc_id.eqNullSafe(found.doc_id) & (docs.k == found.k), "left")
            .select(docs.doc_id, "text", "repeats")
            .mapInArrow(_cut, f"doc_id {id_type}, n_bytes long, "
                              "spans array<struct<start:long,stop:long>>, kept binary"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
