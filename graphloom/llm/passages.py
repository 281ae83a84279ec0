"""Substring duplicates by collinear chaining: shared k-word seeds are joined, those that keep
their order are chained with gap costs through a Fenwick tree, and chains are aligned word by
word, which finds passages that repeat with changes."""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import MOST_BROADCAST, fresh_name, frugal, heavy_from, materialize, mix, pieces, prepare, raw, salted_join, words
from graphloom.llm.minhash import only

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes travel together for the alignment.
BLOCK = 32
#: Words beyond a chain's ends, and between its parts, that alignment looks at.
REACH = 24
#: Words before and after a seed whose signs travel with it.
SIGNS = 16
#: What a word of gap costs a chain, in matched words.
GAP_COST = 0.1
MOST_CARRIED = GAP_COST * 8 * REACH
#: Words between two seeds that stand next to each other in a junction.
NEXT = 24
#: Seeds before and after the border of two first documents that make a junction too, by how many they are
#: away from it: where changes have removed those at the border, two of these are left.
BESIDE = tuple((p, q) for p in range(5) for q in range(5 - p))


def hashes(text: bytes) -> np.ndarray:
    return word_hashes([text])[0]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' words, text after text; number of words of each text)."""
    split = [words(x) for x in texts]
    size = np.fromiter(map(len, split), np.int64, len(split))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(split)), np.uint64, int(size.sum())), size


#: Bytes up to which a word is mixed eight bytes at a time, with all others.
SHORT = 64
#: What is kept of eight bytes of which a word has so many.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(32 bits of each of all texts' words(), text after text; number of words of each text). Words are equal or
    not by them, as by hashes(), but they take a fraction of its time: all texts stand in one array, where the first
    eight bytes of every word are mixed at once, then the next eight of those that go on."""
    text = b" ".join([b"", *texts, b" " * 8]).lower()
    x = np.frombuffer(text, np.uint8)
    gap = (x == 32) | (x - np.uint8(9) < 5)
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    start, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(x) - 7, "<u8", text, 0, 1)  # those from each byte on
    h = mix((eight[start] & _MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * _GOLD)
    at = np.flatnonzero(size > 8)
    for done in range(8, SHORT, 8):
        h[at] = mix(h[at] * _GOLD + (eight[start[at] + done] & _MASKS[np.minimum(size[at] - done, 8)]))
        at = at[size[at] > done + 8]
    for i in at.tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[start[i] : start[i] + size[i]])
    length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return h.astype("<u4"), np.diff(np.searchsorted(start, np.r_[0, np.cumsum(length)] + 1))


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of every `window` neighbouring ones: two texts that share a run of
    so many k-grams share a chosen one."""
    w = min(window, len(h))
    least = h[: len(h) - w + 1]
    for i in range(1, w):
        least = np.minimum(least, h[i : len(h) - w + 1 + i])
    chosen = np.zeros(len(h), bool)
    for i in range(w):
        part = chosen[i : len(h) - w + 1 + i]
        part |= h[i : len(h) - w + 1 + i] == least
    return np.flatnonzero(chosen)


def monotone(h: np.ndarray, least: int) -> np.ndarray:
    """Places `least` apart, and the last one, in stretches of `least` equal hashes or more: a word that is
    repeated on and on. Their first document is one that repeats it as long, not just once or twice."""
    cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    size = np.diff(np.r_[cut, len(h)])
    out = [np.r_[np.arange(a, a + n - least + 1, least), a + n - least] for a, n in zip(cut, size, strict=True) if n >= least] if size.max() >= least else []
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _paired(h: np.ndarray, owner: np.ndarray, head: np.ndarray) -> np.ndarray:
    """For rows sorted by (h, owner, place), with the first row of each h: the hub's place that a row goes
    with, as a row. The n-th time that a text holds a seed goes with the n-th time of the hub; a text that
    holds it more often begins again, and what is left over goes with the hub's last times."""
    run = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
    size = np.diff(np.r_[run, len(h)])
    times = np.repeat(size, size)
    rank = np.arange(len(h)) - np.repeat(run, size)
    of_hub = size[np.searchsorted(run, head)]
    rounds = times // of_hub
    over = (rounds > 0) & (rank >= rounds * of_hub)
    return head + np.where(over, of_hub - (times - rank), rank % of_hub)


def signs(h: np.ndarray) -> np.ndarray:
    """For each place and the end, four bits of each of the SIGNS words from there on, the nearest lowest."""
    x = np.r_[h >> np.uint64(60), np.zeros(1, np.uint64)]
    for n in (1, 2, 4, 8):
        x[: max(0, len(x) - n)] |= x[n:] << np.uint64(4 * n)
    return x


def may_go_on(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether reach() can find anything in REACH words that begin like these signs, and whether it can
    come to their end. It never says no where reach() goes on: equal words have equal signs, and words
    behind the signs count as equal."""
    out, far = np.zeros(len(a), bool), np.zeros(len(a), bool)
    for i, j in ((0, 0), *SKIPS):
        x = (a >> np.uint64(4 * i)) ^ (b >> np.uint64(4 * j))
        worth = np.zeros(len(a), np.int8)
        for _ in range(SIGNS - max(i, j)):
            worth += np.where(x & np.uint64(15), np.int8(-2), np.int8(1))
            out |= worth > 2 * (i + j)
            x >>= np.uint64(4)
        far |= worth + (REACH - SIGNS) > 2 * (i + j)
    return out | far, far


def _chosen(ids: np.ndarray, texts: list[bytes], k: int, every: int, least: int) -> tuple[np.ndarray, ...] | None:
    """(hash, id, pos, behind, ahead) of the seeds of some texts, see _seeds(); None without any. The words of all
    texts stand in one array, SIGNS empty places apart, so that numpy works on many short texts at once."""
    flat, size = word_hashes(texts)
    keep = np.flatnonzero(size >= k)
    if not len(keep):
        return None
    flat = flat[np.repeat(size >= k, size)]
    size, total = size[keep], len(flat)
    start = np.cumsum(size + SIGNS) - size  # a gap before each text, and one at the end
    h = np.zeros(total + SIGNS * (len(keep) + 1), np.uint64)
    h[_ranges(start, size)] = mix(flat)
    rolling = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        rolling = rolling * _GOLD + h[i : len(h) - k + 1 + i]
    many = size - k + 1
    row, begin = np.repeat(np.arange(len(keep)), many), np.cumsum(many) - many
    rolling = mix(rolling[_ranges(start, many)])
    pos = np.arange(len(rolling)) - begin[row]
    chosen = np.zeros(len(rolling), bool)
    if len(rolling) >= every:
        lowest = rolling[: len(rolling) - every + 1]
        for i in range(1, every):
            lowest = np.minimum(lowest, rolling[i : len(rolling) - every + 1 + i])
        inside = (pos + every <= many[row])[: len(lowest)]
        for i in range(every):
            chosen[i : len(lowest) + i] |= inside & (rolling[i : len(lowest) + i] == lowest)
    for d in np.flatnonzero(many < every).tolist():  # of so few k-grams one window
        chosen[begin[d] + winnow(rolling[begin[d] : begin[d] + many[d]], every)] = True
    at = np.flatnonzero(chosen)
    found, row_, pos_ = [rolling[at]], [row[at]], [pos[at]]
    alike = (rolling[1:] == rolling[:-1]) & (row[1:] == row[:-1])
    for d in np.unique(row[1:][alike]).tolist():
        own = rolling[begin[d] : begin[d] + many[d]]
        more = monotone(own, least - k + 1)
        found.append(mix(~own[more]))
        row_.append(np.full(len(more), d, np.int64))
        pos_.append(more)
    row, pos = np.concatenate(row_), np.concatenate(pos_)
    place = start[row] + pos
    return np.concatenate(found).view(np.int64), ids[keep][row], pos, signs(h[::-1])[len(h) - place], signs(h)[place + k]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, `size` of them, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _seeds(k: int, every: int, least: int):
    """(id, pos, hash, a, b, near): each text's seeds, the least k-gram hash of every `every` places. Of a
    seed that several texts of a chunk hold, only the first text's go on as seeds (near null, a and b the
    signs of the words behind and ahead); the others are anchors to it already (near: see _near, a and b
    hub and hub_pos) and spread by id, so a passage that very many texts share is shuffled once a chunk.
    Seeds are most of what this operator shuffles, hence so few columns."""

    @frugal
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 2_000_000):
                made = _chosen(part.column("id").to_numpy(), raw(part.column("text")), k, every, least)
                if made is None:
                    continue
                h, owner, at, behind, ahead = made
                order = np.lexsort((at, owner, h))
                h, owner, at, behind, ahead = h[order], owner[order], at[order], behind[order], ahead[order]
                lead, with_ = _led(h, owner)
                near = np.zeros(len(h), np.int8)
                near[~lead] = _near(behind, ahead, np.flatnonzero(~lead), with_[~lead])
                a, b = np.where(lead, behind.view(np.int64), owner[with_]), np.where(lead, ahead.view(np.int64), at[with_])
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (owner, at, h, a, b)), pa.array(near, pa.int8(), mask=lead)], names=["id", "pos", "hash", "a", "b", "near"])

    return seeds


def _led(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by (h, owner, place): which belong to the first text of their h, and the rows of that
    text that the others go with."""
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    head = np.repeat(first, np.diff(np.r_[first, len(h)]))
    return owner == owner[head], _paired(h, owner, head)


def _dealt(h: np.ndarray, owner: np.ndarray, at: np.ndarray, lead: np.ndarray, with_: np.ndarray) -> list[pa.Array]:
    """(id, pos, hash, hub, hub_pos): leading rows have no hub, the others are anchors already."""
    return [*(pa.array(x, pa.int64()) for x in (owner, at, h)), *(pa.array(x, pa.int64(), mask=lead) for x in (owner[with_], at[with_]))]


def _near(behind: np.ndarray, ahead: np.ndarray, own: np.ndarray, hub: np.ndarray) -> np.ndarray:
    """1 where the words before two rows' seeds may go on alike, plus 2 where those after them may, plus 4
    and 8 where they may beyond REACH words."""
    (left, far_left), (right, far_right) = may_go_on(behind[own], behind[hub]), may_go_on(ahead[own], ahead[hub])
    return left + np.int8(2) * right + np.int8(4) * far_left + np.int8(8) * far_right


_ANCHORS = "id bigint, pos bigint, hub bigint, hub_pos bigint, near tinyint, hash bigint, span bigint, need boolean"


def _anchors(signed: bool):
    """(id, pos, hub, hub_pos, near, hash, span) of rows sorted by (hash, id, pos): each hash's first text is
    the hub of the others. Between batches the hub's rows of the last hash are held, and those of its last
    text: a text's length at most. signed: rows of _seeds(); else of _grouped(), with spans and whether they
    need a hub."""
    names = [x.split()[0] for x in _ANCHORS.split(", ")]
    partner = ("a", "b", "near") if signed else ("hub", "hub_pos", "hub")

    @frugal
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            known = batch.column(partner[2])
            ready, seeds = batch.filter(known.is_valid()), batch.filter(known.is_null())
            if ready.num_rows:
                n = ready.num_rows
                near, span, need = (ready.column("near"), pa.array(np.zeros(n, np.int64)), pa.array(np.ones(n, bool))) if signed else (pa.array(np.full(n, 15, np.int8)), ready.column("span"), ready.column("need"))
                yield pa.RecordBatch.from_arrays([*(ready.column(c) for c in ("id", "pos", *partner[:2])), near, ready.column("hash"), span, need], names=names)
            if not seeds.num_rows:
                continue
            rows = [seeds.column(c).to_numpy() for c in ("hash", "id", "pos", *(("a", "b") if signed else ("span",)))] + ([] if signed else [seeds.column("need").to_numpy(zero_copy_only=False)])
            done = len(held[0]) if held else 0
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)] if held else rows
            h, owner, pos = rows[:3]
            lead, with_ = _led(h, owner)
            keep = ~lead & (np.arange(len(h)) >= done)
            if keep.any():
                with_ = with_[keep]
                near = _near(rows[3].view(np.uint64), rows[4].view(np.uint64), np.flatnonzero(keep), with_) if signed else np.full(len(with_), 15, np.int8)
                span, need = (np.zeros(len(with_), np.int64), np.ones(len(with_), bool)) if signed else (rows[3][keep], rows[4][keep])
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (owner[keep], pos[keep], owner[with_], pos[with_])), pa.array(near), pa.array(h[keep]), pa.array(span), pa.array(need)], names=names)
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])[-1]
            last = (h == h[-1]) & ((owner == owner[start]) | (owner == owner[-1]))
            held = [x[last] for x in rows]

    return anchors


class Fenwick:
    """Greatest (value, item) over a prefix of places."""

    def __init__(self, n: int):
        self.best: list = [(-1e18, -1)] * (n + 1)

    def put(self, place: int, value: float, item: int) -> None:
        place += 1
        while place < len(self.best):
            if value > self.best[place][0]:
                self.best[place] = (value, item)
            place += place & -place

    def most(self, count: int) -> tuple[float, int]:
        """Over the first `count` places."""
        found = (-1e18, -1)
        while count:
            found = max(found, self.best[count])
            count -= count & -count
        return found


#: Seeds up to which Python's own numbers take less time than numpy's calls.
FEW = 40


def segments(pos: np.ndarray, hub: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(start, end, hub_start) of maximal runs of overlapping or touching seeds on one diagonal."""
    if len(pos) == 1:
        return [(int(pos[0]), int(pos[0]) + k, int(hub[0]))]
    if len(pos) <= FEW:
        out: list[tuple[int, int, int]] = []
        diagonal = last = None
        for d, p in sorted(zip((hub - pos).tolist(), pos.tolist(), strict=True)):
            if d == diagonal and p - last <= k:
                out[-1] = (out[-1][0], p + k, out[-1][2])
            else:
                out.append((p, p + k, p + d))
            diagonal, last = d, p
        return sorted(out)
    order = np.lexsort((pos, hub - pos))
    pos, hub = pos[order], hub[order]
    cut = np.flatnonzero(np.r_[True, (np.diff(hub - pos) != 0) | (np.diff(pos) > k)])
    end = np.r_[cut[1:], len(pos)] - 1
    return sorted(zip(pos[cut].tolist(), (pos[end] + k).tolist(), hub[cut].tolist(), strict=True))


def chains(parts: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of segments, best first; each segment is in one chain at most. What a chain hands
    on to the next segment is MOST_CARRIED words at most, so that the best predecessor is one within
    reach: gaps of more than MOST_CARRIED / GAP_COST words, of both sides together, part chains."""
    if len(parts) == 1:
        return [parts]
    ends = sorted({h + e - s for s, e, h in parts})
    tree = Fenwick(len(ends))
    by_end = sorted(range(len(parts)), key=lambda i: parts[i][1])
    score, before, done = [0.0] * len(parts), [-1] * len(parts), 0
    for i, (s, e, h) in enumerate(parts):
        while done < len(parts) and parts[by_end[done]][1] <= s:  # all that end before this starts
            j = by_end[done]
            js, je, jh = parts[j]
            tree.put(bisect_left(ends, jh + je - js), min(score[j], MOST_CARRIED) + GAP_COST * (je + jh + je - js), j)
            done += 1
        value, j = tree.most(bisect_left(ends, h + 1))
        value -= GAP_COST * (s + h)
        if j >= 0 and value > 0:
            score[i], before[i] = e - s + score[j] - (min(score[j], MOST_CARRIED) - value), j
        else:
            score[i] = float(e - s)
    out, used = [], [False] * len(parts)
    for i in sorted(range(len(parts)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(parts[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def farthest(chain: list[tuple[int, int, int]], k: int, near: dict[tuple[int, int], int]) -> float:
    """Words that no passage of the chain exceeds: from the first place that one of its segments may
    reach back to, to the last that one may reach forward to. near: of each (pos, hub_pos)."""
    codes = [(near[s, h], near[e - k, h + e - k - s]) for s, e, h in chain]
    if any(a & 4 or b & 8 for a, b in codes):
        return float("inf")
    first = min(s - REACH * (a & 1) for (s, _, _), (a, _) in zip(chain, codes, strict=True))
    last = max(e + REACH * (b >> 1 & 1) for (_, e, _), (_, b) in zip(chain, codes, strict=True))
    return last - first


_CHAINS = "chain bigint, id bigint, hub bigint, parts array<bigint>, own_blocks array<bigint>, hub_blocks array<bigint>"
_GROUPED = f"{_CHAINS}, pos bigint, hash bigint, hub_pos bigint, span bigint, need boolean"


def _grouped(k: int, every: int, least: int, level: int):
    """Of anchors sorted by (id, pos): chains (chain, id, hub, parts, own_blocks, hub_blocks), at higher levels
    the anchors themselves as parts of chains, and junctions (id, pos, hash, hub, hub_pos, span, need).

    Chains that alignment can't bring to `least` are dropped: a seed or two that texts share by chance.
    A junction is a pair of anchors with different hubs, or different places in one, that are neighbours or, at
    the first level, near the place where neighbours differ so (BESIDE). Texts that share a passage whose parts different texts hold first have its junctions in common, and the
    first text with a junction is its hub: an anchor of the next level. Only stretches of anchors that a
    passage of `least` words could stand in have junctions. need: whether the text needs a hub there; others
    only serve as hubs."""
    names = [x.split()[0] for x in _GROUPED.split(", ")]

    @frugal
    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 33
        rest: list[np.ndarray] | None = None

        def linked(c: list[np.ndarray]) -> pa.RecordBatch:
            own, pos, hub, hub_pos, span = (x[c[7]] for x in (*c[:4], c[6]))
            both = np.stack([pos, pos + k, hub_pos, pos + span, pos + span + k, hub_pos + span], axis=1)
            parts = pa.ListArray.from_arrays(pa.array(np.arange(0, 6 * len(own) + 1, 6), pa.int32()), pa.array(both.reshape(-1)))
            none = pa.nulls(len(own), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(own), np.int64)), pa.array(own), pa.array(hub), parts, none, none] + [pa.nulls(len(own), pa.int64())] * 4 + [pa.nulls(len(own), pa.bool_())], names=names)

        def chained(c: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal serial
            own, pos, hub, hub_pos, near = c[:5]
            order = np.lexsort((pos, hub, own))
            own, pos, hub, hub_pos, near = own[order], pos[order], hub[order], hub_pos[order], near[order]
            cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (hub[1:] != hub[:-1])])
            out: list[list] = [[] for _ in range(6)]
            ends, code = np.r_[cut[1:], len(own)], near[cut].astype(np.int64)
            worth = (ends - cut > 1) | (code >= 4) | (k + REACH * ((code & 1) + (code >> 1)) >= least)
            for a, b in zip(cut[worth].tolist(), ends[worth].tolist(), strict=True):
                at = None
                for chain in chains(segments(pos[a:b], hub_pos[a:b], k)):
                    start, end = chain[0][0], chain[-1][1]
                    if end - start < least:
                        at = at or dict(zip(zip(pos[a:b].tolist(), hub_pos[a:b].tolist(), strict=True), near[a:b].tolist(), strict=True))
                        if farthest(chain, k, at) < least:
                            continue
                    for column, value in zip(out, (serial, int(own[a]), int(hub[a]), *spots(chain)), strict=True):
                        column.append(value)
                    serial += 1
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)] + [pa.nulls(len(out[0]), pa.int64())] * 4 + [pa.nulls(len(out[0]), pa.bool_())], names=names)

        def junctions(c: list[np.ndarray]) -> pa.RecordBatch | None:
            own, pos, hub, hub_pos, _, h, span, need = c
            apart = pos[1:] - (pos[:-1] + span[:-1])
            beside = (own[1:] == own[:-1]) & (apart <= NEXT)
            stretch, first = np.r_[0, np.cumsum(~beside)], np.flatnonzero(np.r_[True, ~beside])
            long = (np.maximum.reduceat(pos + span, first) + k - pos[first] >= least - 2 * (every - 1))[stretch]
            at = np.flatnonzero(beside & (pos[1:] > pos[:-1]) & long[1:] & ((hub[1:] != hub[:-1]) | (hub_pos[1:] - pos[1:] != hub_pos[:-1] - pos[:-1])))
            if not len(at):
                return None
            a, b = (np.concatenate(x) for x in zip(*((at - p, at + 1 + q) for p, q in (BESIDE if not level else BESIDE[:1])), strict=True))
            inside = (a >= 0) & (b < len(own))
            a, b = a[inside], b[inside]
            apart = (stretch[a] == stretch[b]) & ((hub[a] != hub[b]) | (hub_pos[a] - pos[a] != hub_pos[b] - pos[b]))
            a, b = np.divmod(np.unique(a[apart] * len(own) + b[apart]), len(own))
            with np.errstate(over="ignore"):
                key = mix(mix(h[a].view(np.uint64)) * _GOLD + h[b].view(np.uint64) + (pos[b] - pos[a]).view(np.uint64) * _GOLD).view(np.int64)
            width, owner, place, need = pos[b] + span[b] - pos[a], own[a], pos[a], need[a] | need[b]
            order = np.lexsort((place, owner, key))
            key, owner, place, width, need = key[order], owner[order], place[order], width[order], need[order]
            lead, with_ = _led(key, owner)
            id_, pos_, hash_, hub_, hub_pos_ = _dealt(key, owner, place, lead, with_)
            none = pa.nulls(len(key), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.int64()), id_, hub_, none, none, none, pos_, hash_, hub_pos_, pa.array(width), pa.array(need)], names=names)

        def solve(c: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            yield linked(c) if level else chained(c)
            if (found := junctions(c)) is not None:
                yield found

        for batch in batches:
            c = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("id", "pos", "hub", "hub_pos", "near", "hash", "span", "need")]
            if rest is not None:
                c = [np.concatenate(x) for x in zip(rest, c, strict=True)]
            same = np.flatnonzero(c[0] != c[0][-1]) if len(c[0]) else []
            whole = int(same[-1]) + 1 if len(same) else 0
            if whole:
                yield from solve([x[:whole] for x in c])
            rest = [x[whole:] for x in c]
        if rest is not None and len(rest[0]):
            yield from solve(rest)

    return grouped


def blocks_of(spots: list[tuple[int, int]]) -> list[int]:
    """The blocks that hold the words of some stretches."""
    return sorted({n for x, y in spots if y > max(0, x) for n in range(max(0, x) // BLOCK, (y - 1) // BLOCK + 1)})


def spots(chain: list[tuple[int, int, int]]) -> tuple[list[int], list[int], list[int]]:
    """A chain's numbers, and the blocks of its own and its hub's words that alignment looks at: around its
    ends and between its parts."""
    start, end = chain[0][0], chain[-1][1]
    last = chain[-1][2] + chain[-1][1] - chain[-1][0]
    own = [(start - REACH, start), (end, end + REACH)] + [(p[1], q[0]) for p, q in zip(chain, chain[1:], strict=False)]
    hub = [(chain[0][2] - REACH, chain[0][2]), (last, last + REACH)] + [(p[2] + p[1] - p[0], q[2]) for p, q in zip(chain, chain[1:], strict=False)]
    return [n for p in chain for n in p], blocks_of(own), blocks_of(hub)


def merged(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Segments (start, end, hub_start), of which those that overlap or touch on one diagonal are one."""
    out: list[tuple[int, int, int]] = []
    for s, e, h in sorted(parts, key=lambda p: (p[2] - p[0], p[0])):
        if out and out[-1][2] - out[-1][0] == h - s and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), out[-1][2])
        else:
            out.append((s, e, h))
    return sorted(out)


@frugal
def _rechained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of all the segments in `parts` of rows sorted by (id, hub)."""
    names = [x.split()[0] for x in _CHAINS.split(", ")]
    out: list[list] = [[] for _ in names]
    serial = (1 << 56) + (TaskContext.get().partitionId() << 33)
    now, segs = None, []

    def done() -> None:
        nonlocal serial
        for chain in chains(merged(segs)):
            for column, value in zip(out, (serial, *now, *spots(chain)), strict=True):
                column.append(value)
            serial += 1

    def made() -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3
        columns = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)]
        for x in out:
            x.clear()
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        for own, hub, parts in zip(*(batch.column(c).to_pylist() for c in ("id", "hub", "parts")), strict=True):
            if (own, hub) != now:
                if now is not None:
                    done()
                now, segs = (own, hub), []
            segs += [tuple(parts[i : i + 3]) for i in range(0, len(parts), 3)]
        if len(out[0]) > 20_000:
            yield made()
    if now is not None:
        done()
    yield made()


@frugal
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, block, words): each text's word_codes() in blocks."""
    for batch in batches:
        for part in pieces(batch, "text"):
            h, size = word_codes(raw(part.column("text")))
            many, end = -(-size // BLOCK), np.cumsum(size)
            number = _ranges(np.zeros(len(many), np.int64), many)
            cut = np.minimum(np.repeat(end - size, many) + (number + 1) * BLOCK, np.repeat(end, many))
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(np.r_[0, cut * 4].astype(np.int64)), pa.py_buffer(h)])
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(np.repeat(np.arange(len(many)), many))), pa.array(number), data.cast(pa.binary())], names=["id", "block", "words"])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    if not len(a) or not len(b):
        return 0
    if len(a) == len(b) and (level := int(np.count_nonzero(a == b))) >= len(a) - 2:
        return level
    if len(a) == 1 or len(b) == 1:
        return int((a == b).any())
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        np.maximum.accumulate(row, out=row)
    return int(row[-1])


#: Words left out of one side, the other, or both, that the end of a passage may go on behind.
SKIPS = ((1, 0), (0, 1), (2, 0), (0, 2), (3, 0), (0, 3))


def _level(a: np.ndarray, b: np.ndarray, least: int = 0) -> tuple[int, int, int]:
    """(words, matches, worth) word against word, as far as matches less twice the mismatches grow; nothing
    where no more than `least` words match, as worth is no more than they are."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    if (matches := int(np.count_nonzero(same))) <= least:
        return 0, 0, 0
    if matches == n:
        return n, n, n
    best = worth = words = matched = found = 0
    for i, x in enumerate(same.tolist(), 1):
        if x:
            worth, matched = worth + 1, matched + 1
            if worth > best:
                best, words, found = worth, i, matched
        else:
            worth -= 2
    return words, found, best


def reach(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """How far two runs of words go on alike, in each, and the matches; a few words may be missing in
    either where more than twice as many match behind."""
    x, matched, _ = _level(a, b)
    y = x
    while True:
        best = (0, 0, 0, 0)
        for i, j in SKIPS:
            if min(len(a) - x - i, len(b) - y - j) <= 2 * (i + j):
                continue
            n, m, worth = _level(a[x + i :], b[y + j :], 2 * (i + j))
            if worth > 2 * (i + j):
                best = max(best, (worth - 2 * (i + j), m, i + n, j + n))
        if not best[0]:
            return x, y, matched
        matched += best[1]
        x, y = x + best[2], y + best[3]


def reach_on(a: np.ndarray, b: np.ndarray, ended: bool) -> tuple[int, int, int, bool]:
    """reach() again and again, REACH words at a time, while it comes to the end of what it looks at. The
    last is whether it came to the end of the words at hand, and `ended` doesn't say that there are no more."""
    x = y = matched = 0
    while True:
        i, j, m = reach(a[x : x + REACH], b[y : y + REACH])
        x, y, matched = x + i, y + j, matched + m
        if max(i, j) < REACH - 3:
            return x, y, matched, False
        if min(len(a) - x, len(b) - y) < REACH:
            return (x, y, matched, True) if not ended else (*_last(a, b, x, y, matched), False)


def _last(a: np.ndarray, b: np.ndarray, x: int, y: int, matched: int) -> tuple[int, int, int]:
    i, j, m = reach(a[x : x + REACH], b[y : y + REACH])
    return x + i, y + j, matched + m


_NO_WORDS = np.zeros(0, np.uint32)


def take(blocks: dict[int, np.ndarray], start: int, end: int) -> np.ndarray:
    """Words `start` to `end`, as far as the text goes."""
    start = max(0, start)
    if end <= start:
        return _NO_WORDS
    first = start // BLOCK
    if (end - 1) // BLOCK == first:
        return blocks[first][start - first * BLOCK : end - first * BLOCK] if first in blocks else _NO_WORDS
    found = []
    for n in range(first, (end - 1) // BLOCK + 1):
        if n not in blocks:
            break
        found.append(blocks[n])
    if not found:
        return _NO_WORDS
    offset = first * BLOCK
    return np.concatenate(found)[start - offset : end - offset]


def extend(spot: tuple[int, int, int, int, int], sides: int, far: int, own: dict[int, np.ndarray], hub: dict[int, np.ndarray]) -> tuple[int, int, int, int, int, int]:
    """(start, end, hub_start, hub_end, matched, sides) of a passage, extended by up to `far` words at its
    left (sides & 1) and right (sides & 2); the new sides are those that may go on."""
    own_start, own_end, hub_start, hub_end, matched = spot
    still = 0
    if sides & 1:
        a, b = take(own, own_start - far, own_start)[::-1], take(hub, hub_start - far, hub_start)[::-1]
        x, y, more, on = reach_on(a, b, min(own_start, hub_start) <= far)
        own_start, hub_start, matched, still = own_start - x, hub_start - y, matched + more, still | on
    if sides & 2:
        a, b = take(own, own_end, own_end + far), take(hub, hub_end, hub_end + far)
        x, y, more, on = reach_on(a, b, min(len(a), len(b)) < far)
        own_end, hub_end, matched, still = own_end + x, hub_end + y, matched + more, still | 2 * on
    return own_start, own_end, hub_start, hub_end, matched, still


def align(parts: list[int], own: dict[int, np.ndarray], hub: dict[int, np.ndarray], alike: float) -> list[tuple[int, int, int, int, int, int]]:
    """(start, end, hub_start, hub_end, matched, sides) of the passages in a chain of segments; sides: see
    extend. Gaps are aligned; where a chain as a whole is less than `alike`, it is parted at its worst gap."""
    segs = [tuple(parts[i : i + 3]) for i in range(0, len(parts), 3)]
    gaps = []
    for (s, e, h), (s2, _, h2) in zip(segs, segs[1:], strict=False):
        h_end = h + e - s
        gaps.append((common(take(own, e, s2), take(hub, h_end, h2)) if s2 > e and h2 > h_end else 0, max(s2 - e, h2 - h_end)))
    out, todo = [], [(0, len(segs))]
    while todo:
        a, b = todo.pop()
        own_start, hub_start = segs[a][0], segs[a][2]
        own_end, hub_end = segs[b - 1][1], segs[b - 1][2] + segs[b - 1][1] - segs[b - 1][0]
        matched = sum(e - s for s, e, _ in segs[a:b]) + sum(m for m, _ in gaps[a : b - 1])
        if matched < alike * max(own_end - own_start, hub_end - hub_start) and b - a > 1:
            worst = max(range(a, b - 1), key=lambda i: gaps[i][1] - gaps[i][0])
            todo += [(a, worst + 1), (worst + 1, b)]
            continue
        out.append(extend((own_start, own_end, hub_start, hub_end, matched), 3, REACH, own, hub))
    return out


_PASSAGES = "chain bigint, id bigint, hub bigint, start bigint, end bigint, hub_start bigint, hub_end bigint, matched bigint, sides bigint"


def _aligned(least: int, alike: float, far: int, step: int):
    """Passages of rows sorted by (chain, role): role 0 has the chain, or from the second step on the passage
    so far, 1 and 2 its blocks of words. Those that end (sides = 0) have `least` words, `alike` or more of them."""
    names = [x.split()[0] for x in _PASSAGES.split(", ")]

    @frugal
    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        serial = (step << 56) + (TaskContext.get().partitionId() << 33)
        now, parts, ids, own, hub = None, None, None, {}, {}

        def done() -> None:
            nonlocal serial
            found = [extend(tuple(parts[:5]), parts[5], far, own, hub)] if step else align(parts, own, hub, alike)
            for p in found:
                if p[5] or p[1] - p[0] >= least and p[4] >= alike * max(p[1] - p[0], p[3] - p[2]):
                    out.append((serial, *ids, *p))
                    serial += 1

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 9
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

        for batch in batches:
            chain_, role_, block_ = (batch.column(c).to_numpy() for c in ("chain", "role", "block"))
            data = batch.column("words").to_pylist()
            cut = np.flatnonzero(np.r_[True, (chain_[1:] != chain_[:-1]) | (role_[1:] != role_[:-1])])
            head = np.flatnonzero(role_ == 0)
            heads = iter(zip(*(batch.column(c).take(pa.array(head)).to_pylist() for c in ("id", "hub", "parts")), strict=True))
            for chain, role, a, b in zip(chain_[cut].tolist(), role_[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(chain_)], strict=True):
                if chain != now:
                    if parts is not None:
                        done()
                    now, parts, own, hub = chain, None, {}, {}
                if role == 0:
                    *ids, parts = next(heads)
                else:
                    flat, at = np.frombuffer(b"".join(data[a:b]), "<u4"), 0
                    for block, x in zip(block_[a:b].tolist(), data[a:b], strict=True):
                        (own if role == 1 else hub)[block] = flat[at : at + len(x) // 4]
                        at += len(x) // 4
            if len(out) > 50_000:
                yield made()
        if parts is not None:
            done()
        yield made()

    return aligned


def _with_words(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of found (chain, id, hub, parts, own_blocks, hub_blocks) and the blocks of words that they name,
    sorted by (chain, role) within partitions. A text that very many chains have as their hub is copied."""
    sides = found.select("chain", "id", F.lit(1).alias("role"), F.col("own_blocks").alias("blocks")).union(found.select("chain", F.col("hub").alias("id"), F.lit(2).alias("role"), F.col("hub_blocks").alias("blocks")))
    ids = materialize(sides.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.size("blocks")).alias("blocks")), "ids")
    blocks = only(texts, ids.select("id")).mapInArrow(_blocks, "id bigint, block bigint, words binary")
    exploded = lambda rows: rows.select("chain", "id", "role", F.explode("blocks").alias("block"))
    # A side names a block once, so only texts with that many sides can have hot blocks. Each side names one at least: few texts do.
    most = heavy_from(ids.agg(F.sum("blocks")).first()[0] or 0)
    often = ids.where(F.col("n") > most).select("id")
    if often.isEmpty():
        joined = exploded(sides).join(blocks, ["id", "block"])
    else:
        hot = exploded(sides.join(F.broadcast(often), "id", "left_semi")).groupBy("id", "block").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
        joined = salted_join(exploded(sides), blocks, ["id", "block"], "chain", hot)
    none = {"id": "bigint", "hub": "bigint", "parts": "array<bigint>"}
    words_ = joined.select("chain", "role", "block", "words", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    heads = found.select("chain", F.lit(0).alias("role"), F.lit(0).cast("bigint").alias("block"), F.lit(None).cast("binary").alias("words"), "id", "hub", "parts")
    return heads.union(words_).repartition("chain").sortWithinPartitions("chain", "role")


def _one_text(df: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """(id, text) of df, of each id the row whose text has the smallest hash; and (id, text_hash) of the ids
    that have several rows, None if there are none."""
    rows = df.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("id is not null")
    again = materialize(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "again")
    rows = rows.where("text is not null")
    if again.isEmpty():
        return rows, None
    again = F.broadcast(again) if again.count() <= MOST_BROADCAST else again
    rank = F.row_number().over(Window.partitionBy("id").orderBy("text_hash", "text"))
    several = rows.join(again, "id", "left_semi").withColumn("text_hash", F.xxhash64("text")).withColumn("rank", rank).where("rank = 1").drop("rank")
    several = materialize(several, "several")
    return rows.join(again, "id", "left_anti").union(several.select("id", "text")), several.select("id", "text_hash")


def repeated_passages(df: DataFrame, k: int = 5, least: int = 40, alike: float = 0.8, every: int = 6, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per passage of a document that an earlier document (by id) holds too: id,
    source_<id>, start_word, end_word, source_start, source_end (words, ends exclusive), n_matched,
    text_hash.

    A passage has `least` words or more, of which `alike` or more match, in order, those of the
    earlier one; it goes on, however far, as long as what follows matches more than it differs. Words
    are compared without case (A-Z). Any run of k + every - 1 equal words shares a seed; a passage without
    k equal words in a row, as with every fifth word changed, has none and is not found. Each seed's
    first document is the one that the others are compared with, so a passage in m documents costs m
    comparisons, and the first keeps it; within 2 MB of text the first of these stands for it, so which
    earlier document a passage is laid at, and a few of the passages least alike, follow the input's partitions. Where the seeds of a stretch have different first documents,
    the first document that holds both sides of the junction is compared too, and where junctions
    have different ones, that with both junctions, and so on until no junction is left.
    Null and short texts hold no passages; rows with a null id are left out; rows with the same id are
    one document, whose row with the smallest hash of its text counts: text_hash is that hash there,
    and null for other ids. Other columns are left out; an empty df gives an empty result.
    """
    prepare(df)
    source, several = _one_text(df, id, text)
    seeds = source.mapInArrow(_seeds(k, every, least), "id bigint, pos bigint, hash bigint, a bigint, b bigint, near tinyint")
    kept = found = more = None
    level = 0
    while True:
        key = F.when(F.isnull("hub" if level else "near"), F.xxhash64("hash")).otherwise(F.xxhash64("id"))
        anchors = seeds.repartition(key).sortWithinPartitions("hash", "id", "pos").mapInArrow(_anchors(not level), _ANCHORS)
        grouped = materialize(anchors.repartition("id").sortWithinPartitions("id", "pos").mapInArrow(_grouped(k, every, least, level), _GROUPED), "chains")
        rows = grouped.where("chain is not null").select(*(x.split()[0] for x in _CHAINS.split(", ")))
        seeds = grouped.where("chain is null").select("id", "pos", "hash", "hub", "hub_pos", "span", "need")
        if level:
            more = rows if more is None else more.union(rows)
        else:
            found, kept = rows, _settled(rows, source, least, alike)
            spans = materialize(spans_of(kept, "id", "start", "end"), "spans")
            inside = F.exists("spans", lambda s: (s["a"] <= F.col("pos")) & (s["b"] >= F.col("pos") + F.col("span") + k))
            seeds = seeds.join(spans, "id", "left").withColumn("need", F.coalesce(~inside, F.lit(True))).drop("spans")
        level += 1
        if seeds.where("need").isEmpty():
            break
    if more is not None:  # what junctions add to chains of the same two documents is one with them
        more = more.select("id", "hub", "parts")
        pairs = more.select("id", "hub").distinct()
        again = more.union(found.join(pairs, ["id", "hub"], "left_semi").select("id", "hub", "parts")).repartition("id", "hub").sortWithinPartitions("id", "hub")
        kept = kept.union(_settled(materialize(again.mapInArrow(_rechained, _CHAINS), "chains"), source, least, alike))
    # A passage that several chains found is one.
    once = kept.groupBy("id", "hub", "start", "end", "hub_start", "hub_end").agg(F.max("matched").alias("matched"))
    once = once.withColumn("text_hash", F.lit(None).cast("bigint")) if several is None else once.join(several, "id", "left")
    return once.select(F.col("id").alias(id), F.col("hub").alias(f"source_{id}"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("hub_start").alias("source_start"), F.col("hub_end").alias("source_end"), F.col("matched").alias("n_matched"), "text_hash")


def _settled(found: DataFrame, source: DataFrame, least: int, alike: float) -> DataFrame:
    """The passages in chains `found`. Those that may go on beyond the words at hand are looked at again,
    with sixteen times as many, until none is left: few rounds, since each reads the texts again."""
    kept, step, far = None, 0, REACH
    while True:
        aligned = materialize(_with_words(found, source).mapInArrow(_aligned(least, alike, far, step), _PASSAGES), "passages")
        ended, going = aligned.where("sides = 0"), aligned.where("sides > 0")
        kept = ended if kept is None else kept.union(ended)
        if going.isEmpty():
            return kept
        step, far = step + 1, 16 * far
        own, hub = (F.expr(f"array_distinct(concat({_blocks_sql(a, b, far)}))") for a, b in (("start", "end"), ("hub_start", "hub_end")))
        found = going.select("chain", "id", "hub", F.array("start", "end", "hub_start", "hub_end", "matched", "sides").alias("parts"), own.alias("own_blocks"), hub.alias("hub_blocks"))


def spans_of(passages: DataFrame, id: str, start: str, end: str) -> DataFrame:
    """(id, spans): the passages' words as ascending disjoint (a, b)."""
    by = Window.partitionBy(id).orderBy(start, end)
    reach_ = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = passages.select(id, start, end).distinct().withColumn("_new", F.coalesce(F.col(start) > reach_, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(by))
    runs = fresh.groupBy(id, "_run").agg(F.min(start).alias("a"), F.max(end).alias("b"))
    return runs.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


def _blocks_sql(start: str, end: str, far: int) -> str:
    """The blocks of `far` words before start, if it goes on there, and after end."""
    empty = "cast(array() as array<bigint>)"
    left = f"if(sides & 1 > 0 and {start} > 0, sequence(greatest({start} - {far}, 0L) div {BLOCK}, ({start} - 1) div {BLOCK}), {empty})"
    return f"{left}, if(sides & 2 > 0, sequence({end} div {BLOCK}, ({end} + {far} - 1) div {BLOCK}), {empty})"


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of the (ascending, disjoint) spans; what stands between them stays."""
    out, at = [], 0
    starts = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", text)]
    for first, last in spans:
        first, last = min(first, len(starts)), min(last, len(starts))
        if first < last:
            out.append(text[at : starts[first][0]])
            at = starts[last - 1][1]
    out.append(text[at:])
    return b"".join(out)


def remove_passages(df: DataFrame, passages: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with `text` less the words of repeated_passages(): its first document keeps a passage.

    Overlapping passages of a document are cut once. Texts without passages, rows with a null id
    and null texts stay as they are, and so do, of rows with the same id, those with another text than
    the one that counted; a text that was a copy throughout becomes empty. Columns, whatever their
    names, and rows are otherwise unchanged.
    """
    of, at, hash_ = (fresh_name(df, x) for x in ("_spans", "_span_id", "_text_hash"))
    hashes_ = passages.groupBy(id).agg(F.first("text_hash").alias("text_hash"))
    spans = spans_of(passages, id, "start_word", "end_word").join(hashes_, id).select(F.col(id).alias(at), F.col("spans").alias(of), F.col("text_hash").alias(hash_))
    spans = materialize(spans, "spans")

    @F.arrow_udf("string")
    def cut(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, all_spans in columns:
            yield pa.array([t if not s else cut_words(t.encode(), [(x["a"], x["b"]) for x in s]).decode() for t, s in zip(texts.to_pylist(), all_spans.to_pylist(), strict=True)], pa.string())

    spans = F.broadcast(spans) if spans.count() <= MOST_BROADCAST else spans
    with_spans = df.join(spans, F.col(f"`{id}`") == F.col(at), "left")
    own = F.col(f"`{text}`").cast("string")
    whole = F.col(of).isNull() | own.isNull() | F.coalesce(F.xxhash64(own) != F.col(hash_), F.lit(False))
    less = F.when(whole, F.col(f"`{text}`")).otherwise(cut(own, F.col(of)))
    return with_spans.select(*(less.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns))
