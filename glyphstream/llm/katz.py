"""Katz backoff language model of order three: three words back off to two, two to one, one to an unknown word.

Counts of one to KATZ_MAX are discounted by Good and Turing's estimate. The counts of counts
that it needs are smoothed by a straight line through their logarithms, so discounted counts
rise with the count. What the discounts free goes to unseen events in proportion to the lower
order, divided by an exact sum over what was seen, so that the probabilities of all words and
the unknown one after any history sum to one:

    P(w | u v) = d3(c) c(u, v, w) / c(u, v)    if (u, v, w) was seen in training
                 a(u, v) P(w | v)              if not; a(u, v) = 1 where (u, v) wasn't seen
    P(w | v)   = d2(c) c(v, w) / c(v)          if (v, w) was seen
                 a(v) P(w)                     if not; a(v) = 1 after a word that wasn't seen
    P(w)       = d1(c) c(w) / N                if w was seen, else what is left

A text's first word has no more history than its start. Where all counts after a history are
above KATZ_MAX and nothing is freed, one unseen event is added to the history's count; the
same goes for N.

All counts live in tables that are partitioned by key range: words by the range of their
hash, longer runs by v, the last word of their history, so that what recursion from three
words to two needs is in one range. Words are numbered by descending count within their
range, for small messages. A word so frequent that its runs would overload a range has them
dealt out by the next word as well; what histories that end in it need is then summed by
ranges of (u, v). Blocks of documents send distinct keys only, each once, so neither a hot
word nor a hot run loads one task. Everything that ranges send back is a sum of integers, or
of P(w); discounts are applied by the blocks. The driver gets sums, and a row for each word
that is dealt out: those with more than N / ranges tokens, so fewer than there are ranges.
Scores are sums over all tokens of the whole texts.

A null text is empty and has the end token only. Rows that repeat count and score as often
as they occur; a null id is not held out; without training rows every token is unknown with
probability one half. Other columns stay behind. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._blocks import answer, block_words, finish, pack_bytes, pack_ints, pack_parts, pack_sorted, places, ranges_of, send, unpack_bytes, unpack_ints, unpack_parts, unpack_sorted, write_coded
from ._scratch import exchange_ranges, input_bytes, materialise, table, width

KATZ_MAX = 5
HELD_OUT = 1
END = np.uint64((1 << 64) - 1)  # the end token's key
NONE, BOS, FIRST = 0, 1, 2  # numbers: no or an unknown word, what stands before a text, the first word
SLOPE = -1.1  # the least steep line through the counts of counts that still frees something everywhere
ROW = T.StructType().add("kind", T.IntegerType()).add("part", T.IntegerType()).add("block", T.LongType()).add("payload", T.BinaryType())
REPLY = T.StructType(list(ROW.fields)).add("word", T.LongType()).add("sums", T.ArrayType(T.LongType())).add("seen", T.DoubleType())
WORDS, GRAMS, SUMS, HOT, PARTIAL, ASKED, HISTORIES = range(7)  # kinds of rows
R = np.arange(1, KATZ_MAX + 1)


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d(0..KATZ_MAX) from N_1..N_(KATZ_MAX + 1)."""
    r = np.flatnonzero(np.array(counts_of_counts, dtype=float) > 0) + 1
    slope = np.polyfit(np.log(r), np.log([counts_of_counts[i - 1] for i in r]), 1)[0] if len(r) > 1 else -2.0
    slope = min(slope, SLOPE)
    share = (KATZ_MAX + 1.0) ** (slope + 1)
    return np.concatenate(([1.0], ((1 + 1 / R) ** (slope + 1) - share) / (1 - share)))


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(counts <= KATZ_MAX, d[np.minimum(counts, KATZ_MAX)], 1.0) * counts


def freed(low: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What discounts free of histories; low: how many runs have counts 1..KATZ_MAX, as rows. One where it is nothing."""
    return ((1 - d[1:]) * R) @ low + ~low.any(axis=0)


def trains(key, held: int = HELD_OUT) -> bool:
    return key is None or zlib.crc32(str(key).encode()) % 5 != held


@dataclass(frozen=True)
class Words:
    """What the words' counts come to."""

    parts: int
    total: int
    types: int
    documents: int
    low: tuple[int, ...]  # N_1..N_(KATZ_MAX + 1)

    def discounts(self) -> np.ndarray:
        return discounts(list(self.low))

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """P(w) of words by their count; of the unknown one for zero."""
        if not self.total:
            return np.full(len(counts), 0.5)
        low, d = np.array(self.low[:KATZ_MAX])[:, None], self.discounts()
        divisor = self.total + (not low.any())
        return np.where(counts > 0, discounted(counts, d) / divisor, freed(low, d)[0] / divisor)

    def splits(self, before: np.ndarray) -> np.ndarray:
        """Into how many parts the runs after words of these counts are dealt."""
        share = before * self.parts
        return np.where(share > self.total, np.minimum(self.parts, 1 + 2 * share // max(1, self.total)), 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)).astype(np.int64)


def combined(*columns: np.ndarray) -> np.ndarray:
    """One sortable number for each row, in the order of the columns; exact."""
    columns = [c.astype(np.uint64) for c in columns]
    bits = [max(1, int(c.max(initial=0)).bit_length()) for c in columns]
    while sum(bits) > 64:  # the widest column by its ranks, which are fewer than there are rows
        widest = int(np.argmax(bits))
        _, columns[widest] = np.unique(columns[widest], return_inverse=True)
        columns[widest] = columns[widest].astype(np.uint64)
        bits[widest] = max(1, int(columns[widest].max(initial=0)).bit_length())
    out = columns[0]
    for column, size in zip(columns[1:], bits[1:], strict=True):
        out = out << np.uint64(size) | column
    return out


def runs(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(sorted_)), dtype=bool), sorted_[1:] != sorted_[:-1])))


def spread(begins: np.ndarray, size: int) -> np.ndarray:
    """The number of its run for each row."""
    return np.repeat(np.arange(len(begins)), np.diff(np.append(begins, size)))


def pack_flags(flags: np.ndarray) -> bytes:
    return pack_bytes(np.packbits(flags).tobytes())


def unpack_flags(data: bytes, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(unpack_bytes(data), dtype=np.uint8), count=size).astype(bool)


# Words


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vocabulary with the end, last; number into it of each token; tokens of each text; whether each text trains)."""
    vocabulary, codes, sizes = block_words(row)
    tokens = np.insert(codes, np.cumsum(sizes), len(vocabulary))
    return np.append(vocabulary, END), tokens, sizes + 1, np.array([trains(k) for k in row["ids"]], dtype=bool)


def _ask_words(row: dict, parts: int) -> Iterator[tuple]:
    keys, tokens, sizes, train = _tokens(row)
    count = np.bincount(tokens[np.repeat(train, sizes)], minlength=len(keys))
    edge = ranges_of(keys, parts)
    for part in np.flatnonzero(np.diff(edge)).tolist():
        own = slice(edge[part], edge[part + 1])
        yield WORDS, part, row["block"], pack_parts(pack_sorted(keys[own]), pack_ints(count[own]))


def _count_words(part: int, rows: list[dict]) -> Iterator[tuple]:
    asked = [unpack_parts(r["payload"]) for r in rows]
    keys = [unpack_sorted(a) for a, _ in asked]
    words, at = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(at, weights=np.concatenate([unpack_ints(b) for _, b in asked])).astype(np.int64)
    rank = np.empty(len(words), dtype=np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(words))
    done = 0
    for row, own in zip(rows, keys, strict=True):
        mine = at[done : done + len(own)]
        done += len(own)
        yield WORDS, part, row["block"], pack_parts(pack_ints(count[mine]), pack_ints(np.where(count[mine] > 0, rank[mine], 0))), None, None, None
    documents = int(count[-1]) if words[-1] == END else 0
    yield SUMS, part, None, None, None, [int(count.sum()), int((count > 0).sum()), documents, *_low(count, KATZ_MAX + 1)], None


def _low(counts: np.ndarray, most: int) -> list[int]:
    return np.bincount(counts[(counts > 0) & (counts <= most)], minlength=most + 1)[1:].tolist()


# Runs of two and three words


class Grams:
    """The distinct runs (u, v, w) of a block after words v that were seen, in the order in which they are sent.

    Slots are words v, those dealt out once for each part that they are dealt to. ``slot``,
    ``w`` and ``u`` (numbers into ``number``) name each run, ``pair`` and ``history`` the
    (slot, w) and (slot, u) it belongs to, ``at`` the run of each token in ``asked``.
    """

    def __init__(self, row: dict, answers: list[dict], words: Words) -> None:
        vocabulary, tokens, self.sizes, self.train = _tokens(row)
        n, edge = len(vocabulary), ranges_of(vocabulary, words.parts)
        count, number = np.zeros((2, n + 3), dtype=np.int64)
        for reply in answers:
            own = slice(edge[reply["part"]], edge[reply["part"] + 1])
            counts, ranks = unpack_parts(reply["payload"])
            count[own] = unpack_ints(counts)
            number[own] = unpack_ints(ranks).astype(np.int64) * words.parts + reply["part"] + FIRST
        start, none, unknown = n, n + 1, n + 2
        number[start:] = BOS, NONE, NONE
        self.tokens, self.count, self.number = tokens, count, number
        before = count.copy()
        before[start] = words.documents
        _, place = places(self.sizes)
        v, u = np.full((2, len(tokens)), none)
        v[1:], u[2:] = tokens[:-1], tokens[:-2]
        v[place == 0], u[place == 1], u[place == 0] = start, start, none
        self.asked = np.flatnonzero(before[v] > 0)
        v, u, w = v[self.asked], u[self.asked], tokens[self.asked]
        u, w = np.where(before[u] > 0, u, none), np.where(count[w] > 0, w, unknown)

        splits = words.splits(before)
        dealt = np.flatnonzero(splits > 1)
        code = np.concatenate((np.arange(n + 3), np.repeat(dealt, splits[dealt])))
        first = np.arange(n + 3)
        first[dealt] = n + 3 + np.cumsum(splits[dealt]) - splits[dealt]
        split = np.arange(len(code)) - first[code]
        part = (_mixed(number[code]) + np.where(np.arange(len(code)) >= n + 3, split, 0)) % words.parts
        order = np.lexsort((number[code], part))
        rank = np.empty(len(code), dtype=np.int64)
        rank[order] = np.arange(len(code))
        self.slot_word, self.slot_part, self.slot_hot, self.slot_before = code[order], part[order], (splits > 1)[code[order]], before[code[order]]
        slot = rank[first[v] + np.where(splits[v] > 1, _mixed(number[w]) % splits[v], 0)]

        key = combined(slot, w, u)
        _, index, self.at = np.unique(key, return_index=True, return_inverse=True)
        self.slot, self.w, self.u = slot[index], w[index], u[index]
        self.pairs = runs(combined(self.slot, self.w))
        self.pair = spread(self.pairs, len(self.slot))
        self.slots = runs(self.slot)
        self.has = self.slot[self.slots]  # the slots that there are
        # Histories by slot and by the number of u, which both sides know.
        numbers = np.where(self.u == none, NONE, number[self.u])
        _, where, self.history = np.unique(combined(self.slot, numbers), return_index=True, return_inverse=True)
        self.history_slot, self.history_u = self.slot[where], numbers[where]
        self.edge = np.searchsorted(self.slot_part[self.slot], np.arange(words.parts + 1))

    def counts(self) -> np.ndarray:
        """How often each run stands in training texts of the block."""
        return np.bincount(self.at, weights=np.repeat(self.train, self.sizes)[self.asked], minlength=len(self.slot)).astype(np.int64)

    def part_slices(self, part: int) -> tuple[slice, slice, slice, slice]:
        """Runs, pairs, slots and histories of a part."""
        a, b = self.edge[part], self.edge[part + 1]
        slots = self.slot_part[self.history_slot]
        return slice(a, b), slice(*np.searchsorted(self.pairs, (a, b))), slice(*np.searchsorted(self.slots, (a, b))), slice(*np.searchsorted(slots, (part, part + 1)))

    def dealt_histories(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(v, u, part) by number of the histories that end in a word dealt out, in order of part, v and u."""
        of = self.slot_hot[self.history_slot] & (self.history_u > NONE)
        v, u = self.number[self.slot_word[self.history_slot[of]]], self.history_u[of]
        index = np.unique(combined(v, u), return_index=True)[1]
        v, u = v[index], u[index]
        part = history_part(v, u, parts)
        order = np.lexsort((u, v, part))
        return v[order], u[order], part[order]


def history_part(v: np.ndarray, u: np.ndarray, parts: int) -> np.ndarray:
    return (_mixed(v) + _mixed(u + (1 << 40))) % parts


def _ask_grams(row: dict, answers: list[dict], words: Words) -> Iterator[tuple]:
    g = Grams(row, answers, words)
    count, pair_sizes = g.counts(), np.diff(np.append(g.pairs, len(g.slot)))
    pair_slot = g.slot[g.pairs]
    slot_sizes = np.diff(np.append(np.searchsorted(pair_slot, g.has), len(g.pairs)))
    pair_w, slot_v = g.w[g.pairs], g.slot_word[g.has]
    for part in np.flatnonzero(np.diff(g.edge)).tolist():
        own, pairs, slots, _ = g.part_slices(part)
        w, v = pair_w[pairs], slot_v[slots]
        yield GRAMS, part, row["block"], pack_parts(
            pack_sorted(g.number[v].astype(np.uint64)), pack_ints(g.slot_before[g.has[slots]]), pack_ints(slot_sizes[slots]),
            pack_ints(g.number[w]), pack_ints(g.count[w]), pack_ints(pair_sizes[pairs]), pack_ints(g.number[g.u[own]]), pack_ints(count[own]),
        )
    v, u, part = g.dealt_histories(words.parts)
    for begin, end in zip(runs(part).tolist(), [*runs(part)[1:].tolist(), len(part)], strict=True) if len(part) else ():
        yield ASKED, int(part[begin]), row["block"], pack_parts(pack_ints(v[begin:end]), pack_ints(u[begin:end]))


def _sums_by(groups: np.ndarray, n: int, counts: np.ndarray, values: np.ndarray, most: int, rest: bool) -> np.ndarray:
    """Sums of values by group, a row for each count 1..most of ``counts``, and one for larger ones if ``rest``."""
    out = np.empty((most + rest, n), dtype=np.int64)
    for r in range(1, most + rest + 1):
        own = counts == r if r <= most else counts > most
        out[r - 1] = np.bincount(groups[own], weights=values[own], minlength=n)
    return out


def _count_grams(part: int, rows: list[dict], words: Words) -> Iterator[tuple]:
    for row in rows:
        if row["kind"] == ASKED:
            yield ASKED, part, row["block"], row["payload"], None, None, None
    rows = [r for r in rows if r["kind"] == GRAMS]
    if not rows:
        return
    columns = [[unpack_sorted(p[0]).astype(np.int64), *(unpack_ints(x).astype(np.int64) for x in p[1:])] for p in (unpack_parts(r["payload"]) for r in rows)]
    rows = [(r["block"], len(x[0]), len(x[3]), x[2], x[5], len(x[6])) for r, x in zip(rows, columns, strict=True)]
    v, before, v_size, w, w_count, w_size, u, c = (np.concatenate([x[i] for x in columns]) for i in range(8))
    del columns
    of_pair, of_slot = np.repeat(np.arange(len(w)), w_size), np.repeat(np.arange(len(v)), v_size)
    run_slot = of_slot[of_pair]
    key = combined(v[run_slot], w[of_pair], u)
    order = np.argsort(key)
    begin = runs(key[order])
    index, at = order[begin], np.empty(len(key), dtype=np.int64)
    at[order] = spread(begin, len(key))
    total3 = np.add.reduceat(c[order], begin)
    # All distinct runs of the range: pairs and slots of them, as in a block.
    gv, gw, gu = v[run_slot[index]], w[of_pair[index]], u[index]
    pairs = runs(combined(gv, gw))
    pair = spread(pairs, len(gv))
    total2 = np.add.reduceat(total3, pairs)
    pv = gv[pairs]
    slots = runs(pv)
    slot = spread(slots, len(pairs))
    word, word_before = pv[slots], before[run_slot[index[pairs[slots]]]]
    hot = words.splits(word_before) > 1
    p1 = np.where(total2 > 0, words.probability(w_count[of_pair[index[pairs]]]), 0.0)
    low2, seen = _sums_by(slot, len(slots), total2, np.ones(len(total2)), KATZ_MAX, False), np.bincount(slot, weights=p1, minlength=len(slots))
    any2 = low2.any(axis=0)
    histories, history = np.unique(combined(slot[pair], gu), return_inverse=True)
    n = len(histories)
    low3, sums3 = _sums_by(history, n, total3, np.ones(len(total3)), KATZ_MAX, False), _sums_by(history, n, np.where(total3 > 0, total2[pair], 0), total2[pair], KATZ_MAX, True)
    any3, known3 = low3.any(axis=0), np.bincount(history, weights=total3, minlength=n) > 0

    t = p = s = 0
    for block, n_slots, n_pairs, slot_sizes, pair_sizes, n_runs in rows:
        t_end, p_end, s_end = t + n_runs, p + n_pairs, s + n_slots
        own, first = at[t:t_end], np.concatenate(([0], np.cumsum(pair_sizes)[:-1]))
        c3, mine = total3[own], pair[own[first]]
        c2, in_slot = total2[mine], of_slot[p:p_end] - s
        context = slot[mine[np.concatenate(([0], np.cumsum(slot_sizes)[:-1]))]]
        unseen = np.bincount(in_slot, weights=c2 == 0, minlength=s_end - s) > 0
        wanted = context[unseen & ~hot[context]]
        # Histories in the block's order: by slot, then by the number of u.
        _, where, of = np.unique(combined(run_slot[t:t_end] - s, u[t:t_end]), return_index=True, return_inverse=True)
        mine3 = history[own[where]]
        need = (np.bincount(of, weights=c3 == 0, minlength=len(where)) > 0) & known3[mine3] & (u[t:t_end][where] > NONE) & ~hot[slot[pair[own[where]]]]
        yield GRAMS, part, block, pack_parts(
            pack_ints(c3), pack_ints(c2), pack_flags(any2[context]), pack_flags(unseen & ~hot[context]), pack_ints(low2[:, wanted].reshape(-1)), pack_bytes(seen[wanted].tobytes()),
            pack_flags(any3[mine3]), pack_flags(need), pack_ints(low3[:, mine3[need]].reshape(-1)), pack_ints(sums3[:, mine3[need]].reshape(-1)),
        ), None, None, None
        t, p, s = t_end, p_end, s_end
    yield SUMS, part, None, None, None, [*_low(total2, KATZ_MAX + 1), *_low(total3[gu > NONE], KATZ_MAX + 1)], None
    for i in np.flatnonzero(hot).tolist():
        yield HOT, part, None, None, int(word[i]), low2[:, i].tolist(), float(seen[i])
    if hot.any():
        where = np.unique(history, return_index=True)[1]
        some = hot[slot[pair[where]]] & (gu[where] > NONE) & known3
        hv, hu, to = gv[where[some]], gu[where[some]], history_part(gv[where[some]], gu[where[some]], words.parts)
        low3, sums3 = low3[:, some], sums3[:, some]
        for other in np.unique(to).tolist():
            own = to == other
            yield PARTIAL, other, None, pack_parts(pack_ints(hv[own]), pack_ints(hu[own]), pack_ints(low3[:, own].reshape(-1)), pack_ints(sums3[:, own].reshape(-1))), None, None, None


def _sum_histories(part: int, rows: list[dict]) -> Iterator[tuple]:
    """Replies about histories that end in words dealt out: found, any low count, low counts, sums."""
    ints = lambda data: unpack_ints(data).astype(np.int64)
    partial = [[ints(x) for x in unpack_parts(r["payload"])] for r in rows if r["kind"] == PARTIAL]
    asked = [(r["block"], *map(ints, unpack_parts(r["payload"]))) for r in rows if r["kind"] == ASKED]
    if not asked:
        return
    empty = np.zeros(0, np.int64)
    v, u = (np.concatenate([*[x[i] for x in partial], *[a[i + 1] for a in asked]]) for i in (0, 1))
    of = np.unique(combined(v, u), return_inverse=True)[1]
    n, given = int(of.max()) + 1, sum(len(x[0]) for x in partial)
    summed = []
    for i, height in ((2, KATZ_MAX), (3, KATZ_MAX + 1)):
        grid = np.concatenate([x[i].reshape(height, -1) for x in partial] or [empty.reshape(height, 0)], axis=1)
        summed.append(np.stack([np.bincount(of[:given], weights=grid[k], minlength=n) for k in range(height)]).astype(np.int64))
    found, done = np.bincount(of[:given], minlength=n) > 0, given
    for block, own_v, _ in asked:
        mine = of[done : done + len(own_v)]
        done += len(own_v)
        some = mine[found[mine]]
        yield HISTORIES, part, block, pack_parts(pack_flags(found[mine]), pack_ints(summed[0][:, some].reshape(-1)), pack_ints(summed[1][:, some].reshape(-1)))


# Scores


def _score(row: dict, answers: list[dict], words: Words, d2: np.ndarray, d3: np.ndarray, hot: dict[int, tuple[list[int], float]]) -> Iterator[tuple]:
    by = lambda kind: [a for a in answers if a["kind"] == kind]
    g = Grams(row, by(WORDS), words)
    c3, c2 = np.zeros(len(g.slot), dtype=np.int64), np.zeros(len(g.pairs), dtype=np.int64)
    k, h = len(g.has), len(g.history_slot)
    any2, low2, seen = np.zeros(k, dtype=bool), np.zeros((KATZ_MAX, k), dtype=np.int64), np.zeros(k)
    any3, low3, sums3 = np.zeros(h, dtype=bool), np.zeros((KATZ_MAX, h), dtype=np.int64), np.zeros((KATZ_MAX + 1, h), dtype=np.int64)
    for reply in by(GRAMS):
        own, pairs, slots, histories = g.part_slices(reply["part"])
        x = unpack_parts(reply["payload"])
        c3[own], c2[pairs] = unpack_ints(x[0]), unpack_ints(x[1])
        any2[slots], any3[histories] = unpack_flags(x[2], slots.stop - slots.start), unpack_flags(x[6], histories.stop - histories.start)
        some = slots.start + np.flatnonzero(unpack_flags(x[3], slots.stop - slots.start))
        low2[:, some], seen[some] = unpack_ints(x[4]).reshape(KATZ_MAX, -1), np.frombuffer(unpack_bytes(x[5]))
        some = histories.start + np.flatnonzero(unpack_flags(x[7], histories.stop - histories.start))
        low3[:, some], sums3[:, some] = unpack_ints(x[8]).reshape(KATZ_MAX, -1), unpack_ints(x[9]).reshape(KATZ_MAX + 1, -1)
    number = g.number[g.slot_word]
    for i in np.flatnonzero(g.slot_hot[g.has]).tolist():
        sums, seen[i] = hot[int(number[g.has[i]])]
        low2[:, i] = sums
        any2[i] = low2[:, i].any()
    if replies := by(HISTORIES):
        v, u, part = g.dealt_histories(words.parts)
        found, low, sums = np.zeros(len(v), dtype=bool), np.zeros((KATZ_MAX, len(v)), dtype=np.int64), np.zeros((KATZ_MAX + 1, len(v)), dtype=np.int64)
        for reply in replies:
            a, b = np.searchsorted(part, (reply["part"], reply["part"] + 1))
            x = unpack_parts(reply["payload"])
            some = a + np.flatnonzero(unpack_flags(x[0], b - a))
            low[:, some], sums[:, some], found[some] = unpack_ints(x[1]).reshape(KATZ_MAX, -1), unpack_ints(x[2]).reshape(KATZ_MAX + 1, -1), True
        of = np.flatnonzero(g.slot_hot[g.history_slot] & (g.history_u > NONE))
        own = number[g.history_slot[of]]
        keys = combined(np.concatenate((v, own)), np.concatenate((u, g.history_u[of])))
        order = np.argsort(keys[: len(v)])
        to = order[np.searchsorted(keys[: len(v)][order], keys[len(v) :])]
        low3[:, of], sums3[:, of], any3[of] = low[:, to], sums[:, to], low[:, to].any(axis=0)

    base1 = words.probability(g.count)
    divisor2 = g.slot_before[g.has] + ~any2
    back2 = freed(low2, d2) / divisor2 / np.maximum(1 - seen, base1[-1])
    pair_slot = np.searchsorted(g.has, g.slot[g.pairs])
    p2 = np.where(c2 > 0, discounted(c2, d2) / divisor2[pair_slot], back2[pair_slot] * base1[g.w[g.pairs]])
    # How often a run's history was seen is the count of the pair that ends where the run's last word begins.
    of_token = np.full(len(g.tokens) + 1, -1)
    of_token[g.asked + 1] = g.pair[g.at]
    earlier = of_token[g.asked]
    times = np.zeros(len(g.slot), dtype=np.int64)
    times[g.at] = np.where(earlier >= 0, np.append(c2, 0)[earlier], 0)
    times[g.history_u[g.history] == NONE] = 0
    history_slot = np.searchsorted(g.has, g.history_slot)
    seen3 = (d2[1:] @ sums3[:KATZ_MAX] + sums3[KATZ_MAX]) / divisor2[history_slot]
    divisor3 = np.maximum(1, times + ~any3[g.history])
    back3 = (freed(low3, d3) / (1 - seen3))[g.history] / divisor3
    p3 = np.where(times == 0, p2[g.pair], np.where(c3 > 0, discounted(c3, d3) / divisor3, back3 * p2[g.pair]))
    score = base1[g.tokens]
    score[g.asked] = p3[g.at]

    counts, owner = g.count[g.tokens], places(g.sizes)[0]
    base = np.log10((counts + 0.5) / (words.total + 0.5 * (words.types + 1)))
    totals = [np.bincount(owner, weights=x, minlength=len(g.sizes)) for x in (counts > 0, base, np.log10(score))]
    for i, key in enumerate(row["ids"]):
        yield key, not bool(g.train[i]), int(g.sizes[i]), int(totals[0][i]), words.total, float(totals[1][i]), float(totals[2][i])


def _summed(rows: DataFrame, kind: int, size: int) -> list[int]:
    """The sums of the rows of a kind, place by place."""
    sums = rows.filter(F.col("kind") == kind).agg(*[F.sum(F.col("sums")[i]).alias(str(i)) for i in range(size)]).first()
    return [int(x or 0) for x in sums]


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document."""
    spark, size = docs.sparkSession, input_bytes(docs)
    parts = parts or exchange_ranges(4 * size // 3)  # runs of words are more than words
    blocks = write_coded(docs, id_col, text_col, "katz-words")
    counted = materialise(answer(send(blocks, lambda r: _ask_words(r, parts), ROW), REPLY, _count_words), "katz-counts", size)
    total, types, documents, *low = _summed(counted, SUMS, 3 + KATZ_MAX + 1)
    words = Words(parts, total, types, documents, tuple(low))
    replies = counted.filter(F.col("kind") == WORDS).select(*ROW.fieldNames())

    asked = finish(blocks, replies, ROW, lambda row, got: _ask_grams(row, got, words))
    grams = materialise(answer(asked, REPLY, lambda part, rows: _count_grams(part, rows, words)), "katz-runs", size)
    sums = _summed(grams, SUMS, 2 * (KATZ_MAX + 1))
    d2, d3 = discounts(sums[: KATZ_MAX + 1]), discounts(sums[KATZ_MAX + 1 :])
    dealt = grams.filter(F.col("kind") == HOT).groupBy("word").agg(*[F.sum(F.col("sums")[i]) for i in range(KATZ_MAX)], F.sum("seen")).collect()
    hot = spark.sparkContext.broadcast({r[0]: (list(r[1:-1]), r[-1]) for r in dealt})
    histories = answer(grams.filter(F.col("kind").isin(PARTIAL, ASKED)).select(*ROW.fieldNames()), ROW, _sum_histories)

    both = replies.unionByName(grams.filter(F.col("kind") == GRAMS).select(*ROW.fieldNames())).unionByName(histories)
    schema = T.StructType().add(id_col, blocks.schema["ids"].dataType.elementType).add("held_out", T.BooleanType())
    for name in ("n_tokens", "n_known", "train_tokens"):
        schema = schema.add(name, T.LongType())
    schema = schema.add("base_score", T.DoubleType()).add("score", T.DoubleType())
    return finish(blocks, both, schema, lambda row, got: _score(row, got, words, d2, d3, hot.value)).coalesce(width(spark, size))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the scores of every document."""
    return score(table(spark, sf_dir, "documents"))
