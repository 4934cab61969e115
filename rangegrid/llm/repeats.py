"""Suffix-array dedup: every byte that a repeated string of ``least`` bytes covers.

The corpus is cut into contexts by anchors. An anchor is the place of the least hash of ANCHOR bytes in a window of
``least`` bytes, so that equal windows have equal anchors at equal distance. Windows that share an anchor make one
context of at most 2 * least - ANCHOR bytes. Only contexts whose anchor occurs again can hold a repeat; equal contexts
are counted and kept once, and those that share an anchor meet in one task. There they are concatenated, an enhanced
suffix array (order, common prefixes) is built, and a stack scan over it yields the tree of common-prefix intervals.
Intervals whose occurrences differ in the byte to the left are the maximal repeats; each covers all its occurrences.
Where one anchor has too many contexts for a task, these are compared window by window, dealt by the windows' hashes.

Defined results: nulls and empty texts have no byte; matches never cross documents; overlapping repeats count; equal
texts, and rows that repeat id and text, cover each other; documents that share an id are told apart by their text; an
empty table gives an empty table; other columns are not carried, whatever their names; texts of any length are read whole,
in overlapping blocks of 1 MB: besides the text itself a task holds its anchors, one for 80 bytes or so.
"""

from __future__ import annotations

import hashlib
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangegrid.llm.common import text_batches, written
from rangegrid.llm.near import mixed, text_bytes

LEAST, ANCHOR = 200, 40
#: Bytes of text handled at once, and bytes of contexts that one suffix array takes, if their groups allow.
BLOCK, ARRAY = 1 << 20, 1 << 20

_U = np.uint64
_ONE = _U(0x9E3779B97F4A7C15)
_TWO = _U(0xC2B2AE3D27D4EB4F)
_INVERSE = {int(b): _U(pow(int(b), -1, 2**64)) for b in (_ONE, _TWO)}


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64; n is a block and a context at most."""
    key = int(base)
    if key not in _POWERS or len(_POWERS[key]) < n:
        p = np.full(max(n, BLOCK + 2 * LEAST + 2), base, _U)
        p[0] = 1
        _POWERS[key] = np.multiply.accumulate(p, out=p)
    return _POWERS[key][:n]


class _Hashes:
    """Hashes of any stretch of some bytes, by prefix sums of a polynomial modulo 2 ** 64."""

    def __init__(self, raw: np.ndarray, base: np.uint64):
        self.base, self.sums = base, np.zeros(len(raw) + 1, _U)
        np.cumsum((raw.astype(_U) + _U(1)) * _powers(base, len(raw)), out=self.sums[1:])

    def of(self, begin, stop) -> np.ndarray:
        down = _powers(_INVERSE[int(self.base)], len(self.sums))
        return mixed((self.sums[stop] - self.sums[begin]) * down[begin])


# ---- enhanced suffix array ----


def suffix_array(raw: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(order of the suffixes by their first ``depth`` bytes or more, ranks by 8, 16, ... bytes).

    Prefix doubling: eight bytes are one sort key, then pairs of ranks are. Bytes past the end count as 0, as text may not.
    """
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(_U)
    key = np.zeros(n, _U)
    for k in range(8):
        key = (key << _U(8)) | padded[k : k + n]
    levels, width = [], 8
    while True:
        order = np.argsort(key)
        ahead = key[order]
        ranks = np.empty(n, np.int64)
        ranks[order] = np.cumsum(np.concatenate([[0], (ahead[1:] != ahead[:-1]).astype(np.int64)])) + 1 if n else ranks
        levels.append((width, ranks))
        if width >= depth or not n or ranks.max() == n:
            return order, levels
        later = np.zeros(n, np.int64)
        if width < n:
            later[: n - width] = ranks[width:]
        key, width = (ranks * (n + 2) + later).astype(_U), width * 2


def common_prefixes(raw: np.ndarray, order: np.ndarray, levels: list[tuple[int, np.ndarray]], room: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix in order and the one before it (0 for the first), within the room that both have.

    Ranks that are equal skip as many bytes as they stand for, the widest ones first; single bytes decide the rest.
    """
    n, out = len(order), np.zeros(len(order), np.int64)
    if n < 2:
        return out
    a, b, got = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for width, ranks in [levels[-1], *reversed(levels)]:
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = ranks[a[inside]] == ranks[b[inside]]
        step = same * width
        a, b, got = a + step, b + step, got + step
    padded = np.concatenate([raw, np.zeros(9, np.uint8)])
    going = np.ones(n - 1, bool)
    for _ in range(8):
        going &= (padded[np.minimum(a, n)] == padded[np.minimum(b, n)]) & (a < n) & (b < n)
        if not going.any():
            break
        a, b, got = a + going, b + going, got + going
    out[1:] = np.minimum(got, np.minimum(room[order[:-1]], room[order[1:]]))
    return out


def intervals(prefixes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The common-prefix interval tree from ``least`` on, by a stack scan: (length, first, last) in order, children before parents."""
    out, stack = [], []
    for i in np.flatnonzero((prefixes >= least) | (np.concatenate([[0], prefixes[:-1]]) >= least)).tolist():
        h, left = int(prefixes[i]), i - 1
        while stack and stack[-1][0] > h:
            length, left = stack.pop()
            out.append((length, left, i - 1))
        if h >= least and (not stack or stack[-1][0] < h):
            stack.append((h, left))
    while stack:
        length, left = stack.pop()
        out.append((length, left, len(prefixes) - 1))
    return out


def maximal_repeats(texts: list[bytes], least: int, weights: list[int] | None = None, depth: int | None = None) -> tuple[list[tuple[int, list[tuple[int, int]]]] | np.ndarray, ...]:
    """(groups, cover): maximal repeats of ``least`` bytes or more, and for every text the marked bytes.

    A group is (length, first, last) over ``order``; see ``groups_of`` for its occurrences. A text with a weight above 1
    stands for so many equal ones and is a repeat as a whole.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    # text may hold any byte: shift by one, so that 0 is left for the ends (255 and 254 never occur in UTF-8)
    raw = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)
    ends = begin + sizes
    room = np.repeat(ends, sizes + 1) - np.arange(len(raw))
    order, levels = suffix_array(raw, depth or int(sizes.max(initial=1)))
    prefixes = common_prefixes(raw, order, levels, room)
    tree = intervals(prefixes, least)
    # differing bytes to the left; the begin of a text differs from everything
    left = np.concatenate([[-1], raw[:-1].astype(np.int64)])
    left[begin] = -1 - np.arange(len(begin))
    own = left[order]
    changes = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])]) if len(own) else own
    groups = [(h, a, z) for h, a, z in tree if changes[z] > changes[a]]
    reach = np.zeros(len(raw), np.int64)
    in_order = np.zeros(len(raw), np.int64)
    for h, a, z in sorted(groups):  # longer ones, which lie within, come later
        in_order[a : z + 1] = h
    reach[order] = in_order
    if weights is not None:
        whole = np.array(weights) > 1
        reach[begin[whole]] = sizes[whole]
    # a byte is covered if a repeat that begins at or before it reaches beyond it
    cover = np.maximum.accumulate(np.where(reach > 0, np.arange(len(raw)) + reach, 0)) > np.arange(len(raw))
    return groups, order, begin, cover


def groups_of(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """All maximal repeats of some texts: (length, occurrences as (text, place)), every occurrence of each."""
    groups, order, begin, _ = maximal_repeats(texts, least)
    out = []
    for h, a, z in groups:
        at = np.sort(order[a : z + 1])
        text = np.searchsorted(begin, at, "right") - 1
        out.append((h, list(zip(text.tolist(), (at - begin[text]).tolist(), strict=True))))
    return out


# ---- anchors and contexts ----


def _anchors(raw: np.ndarray, begin: np.ndarray, least: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(place of the anchor, its hash, first and last window that it serves) for documents that begin at these places."""
    n, span = len(raw), least - anchor + 1
    count = n - least + 1
    if count <= 0:
        return (np.zeros(0, np.int64),) * 4
    own = _Hashes(raw, _ONE)
    grams = own.of(np.arange(n - anchor + 1), np.arange(anchor, n + 1))
    low = (grams & ~_U(0xFFFFFF)) | np.arange(len(grams)).astype(_U)  # blocks are shorter than 2 ** 24
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[:count], low[span - width : span - width + count])
    at = (low & _U(0xFFFFFF)).astype(np.int64)
    good = np.ones(count, bool)
    for e in begin[1:]:  # windows that would cross into the next document
        good[max(0, e - least + 1) : e] = False
    first = good & np.concatenate([[True], (at[1:] != at[:-1]) | ~good[:-1]])
    last = good & np.concatenate([(at[1:] != at[:-1]) | ~good[1:], [True]])
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    return at[lo], grams[at[lo]], lo, hi


def _blocks(raw: np.ndarray, offsets: np.ndarray, least: int):
    """(first document, shift, bytes, document begins) of pieces of about BLOCK bytes; a longer document comes in overlapping blocks."""
    d, n = 0, len(offsets) - 1
    while d < n:
        to = d + 1
        while to < n and offsets[to + 1] - offsets[d] <= BLOCK:
            to += 1
        a, z = int(offsets[d]), int(offsets[to])
        if z - a <= BLOCK:
            yield d, 0, raw[a:z], offsets[d : to + 1] - a
        else:
            for at in range(a, z, BLOCK):
                stop = min(z, at + BLOCK + least - 1)
                yield d, at - a, raw[at:stop], np.array([0, stop - at])
                if stop == z:
                    break
        d = to


def _find(least: int, anchor: int):
    """(r1, r2, hash, packed) of every anchor; packed: place << 32 | windows before it << 16 | windows from the first to the last."""

    def run(batches):
        for b in text_batches(batches, limit=BLOCK):
            ids = [np.asarray(b.column(b.schema.get_field_index(c))) for c in ("r1", "r2")]
            raw, offsets = text_bytes(b.column(b.schema.get_field_index("text")))
            found = []
            for d, shift, part, begin in _blocks(raw, offsets, least):
                at, h, lo, hi = _anchors(part, begin[:-1], least, anchor)
                doc = np.searchsorted(begin, lo, "right") - 1
                found.append((d + doc, at - begin[doc] + shift, h, lo - begin[doc] + shift, hi - begin[doc] + shift))
            if not found:
                continue
            doc, at, h, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
            # an anchor whose windows go on in the next block is one
            goes_on = np.concatenate([[False], (doc[1:] == doc[:-1]) & (at[1:] == at[:-1]) & (lo[1:] == hi[:-1] + 1)]) if len(at) else np.zeros(0, bool)
            first = np.flatnonzero(~goes_on)
            last = np.concatenate([first[1:], [len(at)]]) - 1 if len(at) else first
            doc, at, h, lo, hi = doc[first], at[first], h[first], lo[first], hi[last]
            packed = (at << 32) | ((at - lo) << 16) | (hi - lo)
            yield pa.RecordBatch.from_arrays([pa.array(ids[0][doc]), pa.array(ids[1][doc]), pa.array(h.view(np.int64)), pa.array(packed)], names=["r1", "r2", "hash", "packed"])

    return run


def _context_hashes(raw: np.ndarray, lo: np.ndarray, stop: np.ndarray, salt: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each stretch raw[lo:stop], block by block; a stretch is hashed with the block that it begins in."""
    out = [np.zeros(len(lo), np.int64) for _ in range(2)]
    order = np.argsort(lo, kind="stable")
    cuts = np.searchsorted(lo[order], np.arange(0, len(raw) + BLOCK, BLOCK))
    for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if x < y:
            own, at = order[x:y], k * BLOCK
            part = raw[at : int(stop[own].max())]
            for c, p in zip(out, (_ONE, _TWO), strict=True):
                c[own] = (_Hashes(part, p).of(lo[own] - at, stop[own] - at) + salt[own]).view(np.int64)
    return out


#: Bytes of distinct contexts that a task holds to count copies before it passes them on.
HELD = 24 << 20


def _contexts(least: int, with_text: bool):
    """Contexts of a document's anchors that occur again; c1 and c2 stand for a context's bytes and its anchor's place in it.

    With text: (hash, wide, c1, c2, n, text), copies within the task counted; else (doc_id, r1, r2, hash, c1, c2, base), one row each.
    """

    def run(batches):
        held, size = {}, 0

        def out():
            keys = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([*[pa.array(k, t) for k, t in zip(keys, (pa.int64(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.binary())], names=["hash", "wide", "c1", "c2", "n", "text"])

        for b in text_batches(batches, limit=BLOCK):
            get = lambda k, b=b: b.column(b.schema.get_field_index(k))
            count = np.asarray(pc.fill_null(pc.list_value_length(get("marks")), 0), np.int64)
            if not count.sum():
                continue
            raw, offsets = text_bytes(get("text"))
            flat = get("marks").flatten()
            h, packed, wide = np.asarray(flat.field("hash")), np.asarray(flat.field("packed")), flat.field("wide").to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(count)), count)
            order = np.lexsort((h, packed, doc))
            doc, h, packed, wide = doc[order], h[order], packed[order], wide[order]
            keep = np.concatenate([[True], (doc[1:] != doc[:-1]) | (packed[1:] != packed[:-1])])  # rows alike have found each other's anchors
            doc, h, packed, wide = doc[keep], h[keep], packed[keep], wide[keep]
            base = (packed >> 32) - (packed >> 16 & 0xFFFF)
            lo = offsets[doc] + base
            stop = lo + (packed & 0xFFFF) + least
            c1, c2 = _context_hashes(raw, lo, stop, mixed((packed & 0xFFFFFFFF).astype(_U)))
            if not with_text:
                own = [get(c).take(pa.array(doc)) for c in ("doc_id", "r1", "r2")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(h), pa.array(c1), pa.array(c2), pa.array(base)], names=["doc_id", "r1", "r2", "hash", "c1", "c2", "base"])
                continue
            blob = memoryview(raw)
            for key, x, y in zip(zip(h.tolist(), wide.tolist(), c1.tolist(), c2.tolist(), strict=True), lo.tolist(), stop.tolist(), strict=True):
                if key in held:
                    held[key][0] += 1
                else:
                    held[key] = [1, bytes(blob[x:y])]
                    size += y - x
            if size > HELD:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    return run


def _runs(cover: np.ndarray, begin: int, size: int) -> tuple[list[int], list[int]]:
    own = np.concatenate([[False], cover[begin : begin + size], [False]])
    edge = np.flatnonzero(own[1:] != own[:-1])
    return edge[::2].tolist(), edge[1::2].tolist()


#: Rows that ``_scanned`` makes of a context: its covered runs, or its place in a group of repeats.
_SCANNED = {"hash": pa.int64(), "c1": pa.int64(), "c2": pa.int64(), "node": pa.int64(), "length": pa.int64(), "starts": pa.list_(pa.int32()), "stops": pa.list_(pa.int32())}
_SCANNED_SCHEMA = "hash bigint, c1 bigint, c2 bigint, node bigint, length bigint, starts array<int>, stops array<int>"


def _covered(rows: list[list], least: int):
    """Covered runs of contexts (hash, c1, c2, n, text) of some anchors."""
    _, _, begin, cover = maximal_repeats([r[4] for r in rows], least, [r[3] for r in rows])
    for k, r in enumerate(rows):
        starts, stops = _runs(cover, int(begin[k]), len(r[4]))
        if starts:
            yield (*r[:3], None, None, starts, stops)


def _grouped(rows: list[list], least: int):
    """Groups of maximal repeats of contexts of some anchors, an occurrence a row; one that has copies is a group by itself."""
    found, order, begin, _ = maximal_repeats([r[4] for r in rows], least)
    whole = set()
    for node, (length, a, z) in enumerate(found):
        at = order[a : z + 1]
        text = np.searchsorted(begin, at, "right") - 1
        for t, x in zip(text.tolist(), (at - begin[text]).tolist(), strict=True):
            if not x and length == len(rows[t][4]):
                whole.add(t)
            yield (*rows[t][:3], node, length, [x], [x + length])
    for t, r in enumerate(rows):
        if r[3] > 1 and t not in whole:
            yield (*r[:3], len(found) + t, len(r[4]), [0], [len(r[4])])


def _scanned(least: int, scan, most: int):
    """Contexts by (hash, c1, c2) -> rows of _SCANNED, by an enhanced suffix array over those that share anchors.

    Copies that different tasks counted are added up. A context that no other shares the anchor with has nothing to be
    compared with: its tree is one leaf, and copies make it a repeat. Contexts of an anchor that has more than ``most``
    rows, or is wide, are left to ``_left_over``, so that no more than these are ever held.
    """

    def merged(batches):
        """[hash, c1, c2, n, text, wide, rows that made it]"""
        last = None
        for b in batches:
            for row in zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in ("hash", "c1", "c2", "n", "text", "wide")), strict=True):
                if last and last[:3] == list(row[:3]):
                    last[3] += row[3]
                    last[6] += 1
                else:
                    if last:
                        yield last
                    last = [*row, 1]
        if last:
            yield last

    def scanned(batches):
        rows, size = [], 0
        for _, own in groupby(merged(batches), key=lambda r: r[0]):
            held, count = [], 0
            for r in own:
                count += r[6]
                if r[5] or count > most:
                    held = []
                    break
                held.append(r)
            if len(held) == 1:
                if held[0][3] > 1:
                    n = len(held[0][4])
                    yield (*held[0][:3], 0, n, [0], [n])
            elif held:
                if rows and (size > ARRAY or scan is _grouped):  # the nodes of a tree are numbered by anchor
                    yield from scan(rows, least)
                    rows, size = [], 0
                rows += held
                size += sum(len(r[4]) + 1 for r in held)
        if rows:
            yield from scan(rows, least)

    def run(batches):
        done = scanned(batches)
        while part := list(islice(done, 5_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), _SCANNED.values(), strict=True)], names=list(_SCANNED))

    return run


def _left_over(most: int):
    """Contexts by hash -> those of anchors that have more than ``most`` rows or are wide, as they come."""

    def run(batches):
        own, held, count, passes = None, [], 0, False
        for b in batches:
            hashes = np.asarray(b.column(b.schema.get_field_index("hash")))
            wide = b.column(b.schema.get_field_index("wide")).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(hashes[1:] != hashes[:-1]) + 1).tolist(), len(hashes)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if hashes[x] != own:
                    own, held, count, passes = hashes[x], [], 0, bool(wide[x])
                count += y - x
                if not passes and count <= most and y < len(hashes):
                    continue  # the run ends within this batch, and is small
                held.append(b.slice(x, y - x))
                if passes or count > most:
                    passes = True
                    yield from held
                    held = []

    return run


def _windows(least: int):
    """Contexts left over -> (w1, w2, hash, c1, c2, at, n): hashes and places of all their windows."""
    names = ["w1", "w2", "hash", "c1", "c2", "at", "n"]

    def run(batches):
        for b in text_batches(batches, limit=64 << 10):
            get = lambda k, b=b: b.column(b.schema.get_field_index(k))
            raw, offsets = text_bytes(get("text"))
            count = np.maximum(0, np.diff(offsets) - least + 1)
            row = np.repeat(np.arange(len(count)), count)
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            w = [_Hashes(raw, p).of(offsets[row] + at, offsets[row] + at + least).view(np.int64) for p in (_ONE, _TWO)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, w), *(get(c).take(pa.array(row)) for c in ("hash", "c1", "c2")), pa.array(at.astype(np.int32)), get("n").take(pa.array(row))], names=names)

    return run


def _cut():
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "stops"]

    def run(batches):
        for b in text_batches(batches):
            get = lambda k, b=b: b.column(b.schema.get_field_index(k))
            raw, offsets = text_bytes(get("text"))
            blob, spans = memoryview(raw), get("spans").to_pylist()
            rows = []
            for k, own in enumerate(spans):
                a, z = int(offsets[k]), int(offsets[k + 1])
                merged: list[list[int]] = []
                for s, e in sorted((x["s"], x["e"]) for x in own or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                digest, at = hashlib.sha256(), a
                for s, e in merged:
                    digest.update(blob[at : a + s])
                    at = a + e
                digest.update(blob[at:z])
                rows.append((z - a, sum(e - s for s, e in merged), len(merged), digest.hexdigest(), [s for s, _ in merged], [e for _, e in merged]))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([get("doc_id"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=names)

    return run


def _prepared(docs: DataFrame, text: str, least: int, anchor: int, spread: int) -> tuple[DataFrame, DataFrame]:
    """(docs with row keys, dealt by them; the same with their marks: anchors that occur again)."""
    keyed = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    keyed = keyed.withColumns({"r1": F.xxhash64("doc_id", "text"), "r2": F.hash("text", "doc_id")})
    # the texts are dealt once: every later stage reads this exchange again
    dealt = keyed.repartition("r1", "r2")
    found = keyed.mapInArrow(_find(least, anchor), "r1 bigint, r2 int, hash bigint, packed bigint")
    # a table of its own, so that a join with an anchor that very many documents share can be split
    again = written(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash", (F.col("n") > spread).alias("wide")), "anchors")
    # sets: rows that repeat id and text have one row key, and must not get the marks of all of them
    marks = found.join(again, "hash").groupBy("r1", "r2").agg(F.collect_set(F.struct("hash", "packed", "wide")).alias("marks"))
    return dealt, dealt.join(marks.hint("shuffle_hash"), ["r1", "r2"], "left")


def _contexts_of(marked: DataFrame, least: int, scan, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scanned contexts, windows of those left over that occur again, places of all contexts)."""
    kind = marked.schema["doc_id"].dataType.simpleString()
    distinct = marked.mapInArrow(_contexts(least, True), "hash bigint, wide boolean, c1 bigint, c2 bigint, n bigint, text binary")
    # the contexts of an anchor meet, save those of a wide one, which are spread; both readers share this exchange
    met = distinct.repartition("hash", F.when(F.col("wide"), F.col("c1"))).sortWithinPartitions("hash", "c1", "c2")
    scanned = met.mapInArrow(_scanned(least, scan, most), _SCANNED_SCHEMA)
    windows = met.mapInArrow(_left_over(most), met.schema).mapInArrow(_windows(least), "w1 bigint, w2 bigint, hash bigint, c1 bigint, c2 bigint, at int, n bigint")
    often = windows.groupBy("w1", "w2").agg(F.sum("n").alias("times")).where("times > 1").select("w1", "w2")
    places = marked.mapInArrow(_contexts(least, False), f"doc_id {kind}, r1 bigint, r2 int, hash bigint, c1 bigint, c2 bigint, base bigint")
    return scanned, windows.join(often, ["w1", "w2"]), places


#: Contexts of one anchor that meet in a task (360 bytes each at the usual lengths); anchors that occur more often
#: than SPREAD are never gathered. Beyond either, windows are compared one by one, dealt by their hashes.
MOST_CONTEXTS, SPREAD = 8_000, 200_000


def dedup(docs: DataFrame, text: str = "text", least: int = LEAST, anchor: int = ANCHOR, most: int = MOST_CONTEXTS, spread: int = SPREAD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, stops): what repeats cover in each document, as runs of bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt, marked = _prepared(docs, text, least, anchor, spread)
    scanned, windows, places = _contexts_of(marked, least, _covered, most)
    single = windows.groupBy("hash", "c1", "c2").agg(F.collect_set("at").alias("starts"))  # a context has at most so many windows as an anchor serves
    covered = scanned.select("hash", "c1", "c2", "starts", "stops").unionByName(single.withColumn("stops", F.transform("starts", lambda x: x + least)))
    hits = places.drop("doc_id").join(covered, ["hash", "c1", "c2"])
    runs = hits.select("r1", "r2", "base", F.explode(F.arrays_zip("starts", "stops")).alias("x")).select("r1", "r2", F.struct((F.col("base") + F.col("x.starts")).alias("s"), (F.col("base") + F.col("x.stops")).alias("e")).alias("x"))
    spans = runs.groupBy("r1", "r2").agg(F.collect_set("x").alias("spans"))
    return dealt.join(spans.hint("shuffle_hash"), ["r1", "r2"], "left").select("doc_id", "text", "spans").mapInArrow(_cut(), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, starts array<bigint>, stops array<bigint>")


def groups(docs: DataFrame, text: str = "text", least: int = LEAST, anchor: int = ANCHOR, most: int = MOST_CONTEXTS, spread: int = SPREAD) -> DataFrame:
    """(group_id, length, doc_id, place): repeats of the corpus of ``least`` bytes or more, with every occurrence of each.

    Trees give the maximal repeats of the contexts of an anchor; those of neighbouring contexts that occur at the same
    places, moved alike, and touch, are one. So a string is given with exactly all places where it occurs, and can't be
    extended among strings with the same occurrences; one whose parts occur at more places than the whole is given by these
    parts, up to where the occurrences change. The spans of all groups cover what ``dedup`` removes. Of windows
    that are compared one by one, those that stand side by side at the same places are joined in the same way.
    """
    _, marked = _prepared(docs, text, least, anchor, spread)
    scanned, windows, places = _contexts_of(marked, least, _grouped, most)
    own = scanned.select(F.xxhash64("hash", "node", "length").alias("g"), F.col("length"), "hash", "c1", "c2", F.col("starts")[0].alias("at"))
    single = windows.select(F.xxhash64(F.lit("window"), "w1", "w2").alias("g"), F.lit(least).cast("long").alias("length"), "hash", "c1", "c2", "at").distinct()
    found = written(own.unionByName(single).join(places, ["hash", "c1", "c2"]).select("g", "length", "doc_id", "r1", "r2", (F.col("base") + F.col("at")).alias("place")), "occurrences")
    # sums over the occurrences that stay the same when all of them are moved by one distance
    h = [F.pmod(F.xxhash64(F.lit(k), "r1", "r2"), F.lit(2**31 - 1)).cast("decimal(38,0)") for k in (1, 2)]
    sums = [x for k in (0, 1) for x in (F.sum(h[k]).alias(f"a{k}"), F.sum(h[k] * F.col("place").cast("decimal(20,0)")).alias(f"b{k}"))]
    heads = found.groupBy("g", "length").agg(F.count("*").alias("times"), F.min(F.struct("r1", "r2", "place")).alias("first"), *sums)
    place = F.col("first.place")
    heads = heads.select("g", "length", "times", F.col("first.r1").alias("r1"), F.col("first.r2").alias("r2"), place.alias("at"), "a0", "a1", *[(F.col(f"b{k}") - F.col(f"a{k}") * place).cast("decimal(38,0)").alias(f"s{k}") for k in (0, 1)])
    alike = W.partitionBy("times", "r1", "r2", "a0", "a1", "s0", "s1").orderBy("at", F.desc("length"), "g")
    reach = F.max(F.col("at") + F.col("length")).over(alike.rowsBetween(W.unboundedPreceding, -1))
    chained = heads.withColumn("new", F.when(F.col("at") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(alike))
    whole = chained.groupBy("times", "r1", "r2", "a0", "a1", "s0", "s1", "island").agg(F.min_by("g", F.struct("at", -F.col("length"), "g")).alias("g"), (F.max(F.col("at") + F.col("length")) - F.min("at")).alias("whole"))
    return found.join(whole.select("g", "whole"), "g").select(F.col("g").alias("group_id"), F.col("whole").alias("length"), "doc_id", "place")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
