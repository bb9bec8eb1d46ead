"""Language-model scores by logistic mixing of hashed-context bit predictors, beside a smoothed unigram baseline."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, blocks, cut, drop, mix64, runs, span_hashes, text_buffers, trim, word_spans

#: Bytes of text in one block: what a task counts at a time, and gets the corpus' counts of its words back for.
BLOCK_TEXT = 4 << 20
#: Words with a symbol of their own: the most frequent. All other words share symbols, by count and cluster.
HEAD = 2048
#: Clusters of words: the language that most of a word's learned texts have; the last one is of all rarer languages.
CLUSTERS = 16
#: Bits of a symbol predictor's table, and of a byte predictor's; the table of two symbols has a slot for each learned
#: token, from the first number of bits up to PAIR_BITS.
SYMBOL_BITS, BYTE_BITS, PAIR_BITS = 20, 19, 23
#: A table is summed up in parts of so many slots, at most so many tasks' shares at a time.
PART_BITS, FAN_IN = 17, 64
#: Weight of the order-0 probability in each symbol predictor's estimate; added to both counts of a byte slot.
PRIOR, BYTE_PRIOR = 2.0, 1.0
#: First weights of order 0, one symbol, two symbols, clusters, the usual cluster. In a gate the second and third are times
#: its trust, by how often the slot has been seen (once, GATES[1] times, ...); the rest of 1 goes to the last two.
START = (-0.1, 0.35, 0.3, 0.2, 0.25)
GATES, TRUST = (1, 4, 32), (0.5, 0.8, 1.0, 1.2)
#: Tokens after which a text's own weights are refined, the step, and the most tokens whose bits are held at a time.
SEGMENT, STEP, SLAB = 16, 0.05, 1 << 16
#: Contexts whose bits are counted, and words that are spelled, at a time.
COUNTED, SPELLED = 1 << 16, 1 << 14
#: Bytes of its word before a byte that each byte predictor sees.
ORDERS = (2, 3, 4)
_END_HASH = np.uint64(0x51E7C0DE51E7C0DE)
_SPACE = 0x20


def held_out(id_col: str):
    """Whether a document is held out of learning: crc32 of its id as text has remainder 1 by 5. A null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


class Code(NamedTuple):
    """A binary code: for each symbol the number of its bits and where they start in bit and node; mass: of each node, by bit."""

    size: np.ndarray
    start: np.ndarray
    bit: np.ndarray
    node: np.ndarray
    mass: np.ndarray


def huffman(weights: np.ndarray) -> Code:
    """A Huffman code: the more weight a symbol has, the fewer bits have to be predicted."""
    n = len(weights)
    heap = [(float(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    children, mass = [], []
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        children.append((x, y))
        mass.append((a, b))
        heapq.heappush(heap, (a + b, n + len(children) - 1))
    paths: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    stack = [(heap[0][1], [])]
    while stack:
        at, path = stack.pop()
        if at < n:
            paths[at] = path
        else:
            stack += [(child, [*path, (at - n, bit)]) for bit, child in enumerate(children[at - n])]
    size = np.array([len(p) for p in paths], np.int64)
    flat = [x for p in paths for x in p]
    return Code(size, np.cumsum(size) - size, np.array([b for _, b in flat], np.int8), np.array([k for k, _ in flat], np.int32), np.array(mass, np.float64).reshape(-1, 2))


def byte_code() -> Code:
    """The fixed code in which words are spelled: short for the space that ends a word and for letters."""
    weights = np.full(256, 1.0)
    weights[0x80:0xC0], weights[ord("0") : ord("9") + 1], weights[ord("a") : ord("z") + 1], weights[_SPACE] = 16, 8, 64, 256
    return huffman(weights)


def expand(code: Code, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every bit of the symbols' codes: its symbol's number, its place in the code, and the number of bits before each symbol."""
    size = code.size[symbol]
    before = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(symbol), dtype=np.int32), size)
    at = np.repeat((code.start[symbol] - before).astype(np.int32), size)
    at += np.arange(len(at), dtype=np.int32)
    return owner, at, before


def _salts(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


def _slots(context: np.ndarray, owner: np.ndarray, salt: np.ndarray, bits: int) -> np.ndarray:
    at = context[owner]
    at += salt
    at >>= np.uint64(64 - bits)
    return at.view(np.int64)


def _places(ends: np.ndarray) -> np.ndarray:
    return np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))


def _bits(slots: int) -> int:
    return slots.bit_length() - 1


def table_bits(tokens: int) -> list[int]:
    """Bits of each symbol predictor's table by the number of learned tokens: the pairs of symbols grow with the corpus."""
    return [SYMBOL_BITS, min(max(SYMBOL_BITS, tokens.bit_length()), PAIR_BITS), SYMBOL_BITS, SYMBOL_BITS]


def _count(tables: list[np.ndarray], contexts: list[np.ndarray], symbol: np.ndarray, code: Code, salts: np.ndarray) -> None:
    """Adds the bits of each symbol to the slots of its contexts, whose low 16 bits are 0."""
    for table, context in zip(tables, contexts, strict=True):
        seen = np.sort(context | symbol.astype(np.uint64))  # a context with the same symbol behind it is counted once
        first = runs(seen)
        seen, n = seen[first], np.diff(first, append=len(seen)).astype(np.uint32)
        for lo in range(0, len(seen), COUNTED):
            some, times = seen[lo : lo + COUNTED], n[lo : lo + COUNTED]
            owner, at, _ = expand(code, (some & np.uint64(0xFFFF)).astype(np.int64))
            slot = _slots(some & ~np.uint64(0xFFFF), owner, salts[code.node[at]], _bits(len(table) // 2))
            np.add.at(table, slot * 2 + code.bit[at], times[owner])


# Spelling: the bytes of words that aren't known.


def spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, lower-cased, each with a space behind; and the words' offsets."""
    size = end - start
    ends = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(ends[-1], _SPACE, np.uint8)
    shift = start - np.concatenate([[0], np.cumsum(size)])[:-1]
    out[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = LOWER[data[np.repeat(shift, size) + np.arange(size.sum())]]
    return out, ends


def byte_contexts(stream: np.ndarray, ends: np.ndarray, cluster: np.ndarray) -> list[np.ndarray]:
    """For each byte predictor a hash of the bytes before each byte in its word; for the first also of the word's cluster."""
    place, n = _places(ends), len(stream)
    group = np.repeat(cluster.astype(np.uint64) + np.uint64(1), np.diff(ends)) << np.uint64(48)
    out = []
    for order in ORDERS:
        packed = np.zeros(n, np.uint64)
        for back in range(1, order + 1):
            packed[back:] |= stream[:-back].astype(np.uint64) << np.uint64(8 * (back - 1)) if back < n else packed[:0]
        early = np.flatnonzero(place < order)
        packed[early] &= (np.uint64(1) << (place[early] * 8).astype(np.uint64)) - np.uint64(1)
        out.append(mix64(packed + np.uint64(order << 56) + (group if order == ORDERS[0] else np.uint64(0))) & ~np.uint64(0xFFFF))
    return out


def spelling_bits(stream: np.ndarray, ends: np.ndarray, cluster: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """log2 of each word's probability of being spelled so, as a word of its cluster: each predictor leans on the one before it, and all weigh the same."""
    code = byte_code()
    owner, at, before = expand(code, stream)
    salt, sign = _salts(256)[code.node[at]], (2 * code.bit[at] - 1).astype(np.float32)
    p, total = np.full(len(at), 0.5, np.float32), np.zeros(len(at), np.float32)
    for context, table in zip(byte_contexts(stream, ends, cluster), tables, strict=True):
        zeros, ones = counts_of(table[_slots(context, owner, salt, _bits(len(table)))])
        p = (ones + BYTE_PRIOR * p) / (zeros + ones + BYTE_PRIOR)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        total += np.log(p / (1 - p)) / len(tables)
    cost = np.log2(1 + np.exp(-np.clip(total * sign, -20, 20))).astype(np.float64)
    return -np.add.reduceat(cost, before[ends[:-1]]) if len(ends) > 1 else np.zeros(0)


def counts_of(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often the bit was 0 and 1, from the low and high 16 bits."""
    return (slots & np.uint32(0xFFFF)).astype(np.float32), (slots >> np.uint32(16)).astype(np.float32)


# Symbols: frequent words, and classes of the others.


class Symbols(NamedTuple):
    """What is known of the corpus' words as a whole. Symbols: the head's words, then for each band of counts and cluster one.

    Band 0 is of words that aren't known. shares: log2 of all counts of a tail symbol's words.
    """

    head: int
    bands: int
    code: Code
    shares: np.ndarray
    cluster: np.ndarray

    @staticmethod
    def read(plain: tuple) -> Symbols:
        return Symbols(plain[0], plain[1], Code(*plain[2]), *plain[3:])

    def of(self, count: np.ndarray, cluster: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Symbols of words by their counts, clusters and numbers in the head (-1: none)."""
        band = np.minimum(band_of(count), self.bands - 1)
        return np.where(head >= 0, head, self.head + np.where(band > 0, band * CLUSTERS + cluster, 0))


def band_of(count: np.ndarray) -> np.ndarray:
    """0 for none, else the number of binary digits."""
    return np.frexp(np.maximum(count, 0).astype(np.float64))[1].astype(np.int64)


def symbols(head: list[tuple[int, int]], tail: list[tuple[int, int, int, int]]) -> Symbols:
    """head: count and cluster of each of its words. tail: of all other words by band of count, band of count less one and cluster: their counts' sum.

    A token is learned as a word whose count is one less, as it would be without this token: words seen once teach what
    comes before words that aren't known.
    """
    bands = 2 + max([own for own, *_ in tail], default=0)
    weight, all_ = np.full(len(head) + bands * CLUSTERS, 0.5), np.zeros(len(head) + bands * CLUSTERS)
    weight[: len(head)] += [c for c, _ in head]
    for own, less, cluster, n in tail:
        weight[len(head) + (less * CLUSTERS + cluster if less else 0)] += n
        all_[len(head) + own * CLUSTERS + cluster] += n
    clusters = np.concatenate([np.array([g for _, g in head], np.int64), np.full(CLUSTERS, CLUSTERS), np.tile(np.arange(CLUSTERS), bands - 1)])
    return Symbols(len(head), bands, huffman(weight), np.log2(np.maximum(all_, 1)), clusters)


def usual_cluster(model: Symbols, symbol: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The cluster that most tokens before each one in its text have, the first of equals; CLUSTERS for none."""
    cluster = model.cluster[symbol]
    most, which = np.zeros(len(symbol), np.int32), np.full(len(symbol), CLUSTERS, np.int8)
    for k in np.unique(cluster[cluster < CLUSTERS]):
        seen = np.concatenate([[0], np.cumsum(cluster == k, dtype=np.int32)])
        seen = seen[:-1] - np.repeat(seen[ends[:-1]], np.diff(ends))
        which[seen > most] = k
        np.maximum(most, seen, out=most)
    return which


def symbol_contexts(model: Symbols, symbol: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each symbol predictor a hash of what stands before each token in its text: one symbol, two, the clusters of two and the usual one."""
    place = _places(ends)

    def before(values: np.ndarray, back: int, none: int) -> np.ndarray:
        out = np.full(len(values), none, np.uint64)
        out[back:] = values[:-back] if back < len(values) else values[:0]
        out[place < back] = none
        return out

    last, second = (before(symbol, k, 0xFFFF) for k in (1, 2))
    cluster = model.cluster[symbol]
    trail = [before(cluster, k, 31) for k in (1, 2, 3, 4)]
    four = trail[0] + trail[1] * np.uint64(32) + trail[2] * np.uint64(1 << 10) + trail[3] * np.uint64(1 << 15)
    usual = usual_cluster(model, symbol, ends).astype(np.uint64) * np.uint64(32) + trail[0]
    return [mix64(x + np.uint64(k << 60)) & ~np.uint64(0xFFFF) for k, x in enumerate((last, last * np.uint64(1 << 16) + second, four, usual), 1)]


def symbol_bits(model: Symbols, symbol: np.ndarray, ends: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """log2 of each text's probability of its symbols. tables: how often a slot's bits were 0 (low 16 bits) and 1 (high).

    Bit after bit, the predictors' stretched probabilities are summed with weights: those of the bit's gate, which is by
    how much the predictors have seen, and the text's own. Each predictor's estimate leans on the order-0 probability by
    PRIOR. A text's own weights start at 0 and follow the gradient of the coding cost after each SEGMENT tokens, so a bit's
    probability depends on earlier tokens only. The k-th segments of all texts are worked on together.
    """
    texts, code = len(ends) - 1, model.code
    out = np.zeros(texts)
    level = (_places(ends) // SEGMENT).astype(np.uint32)
    order = np.argsort(level, kind="stable")
    text_of = np.repeat(np.arange(texts), np.diff(ends))[order]
    contexts = [c[order] for c in symbol_contexts(model, symbol, ends)]
    symbol = symbol[order]
    edges = np.searchsorted(level[order], np.arange(int(level.max()) + 2))
    even = (code.mass[:, 1] / code.mass.sum(1)).astype(np.float32)
    stretch, salts = np.log(even / (1 - even)), _salts(len(even))
    gates = start_weights()
    own = np.zeros((len(tables) + 1, texts), np.float32)
    done = 0
    while done < len(edges) - 1:
        upto = max(done + 1, int(np.searchsorted(edges, edges[done] + SLAB, "right")) - 1)
        lo = edges[done]
        part = slice(lo, edges[upto])
        owner, at, before = expand(code, symbol[part])
        node = code.node[at]
        sign, salt, prior = (2 * code.bit[at] - 1).astype(np.float32), salts[node], even[node]
        inputs, gate = [stretch[node]], np.zeros(len(node), np.int64)
        for k, (context, table) in enumerate(zip(contexts, tables, strict=True)):
            zeros, ones = counts_of(table[_slots(context[part], owner, salt, _bits(len(table)))])
            if k < 2:
                n = ones + zeros
                gate = gate * (len(GATES) + 1) + sum((n >= g).astype(np.int8) for g in GATES)
            inputs.append(np.log((ones + PRIOR * prior) / (zeros + PRIOR * (1 - prior))))
        fixed = sum(x * gates[:, k][gate] for k, x in enumerate(inputs))
        for a, b in zip(edges[done:upto] - lo, edges[done + 1 : upto + 1] - lo, strict=True):
            first, last = before[a], (before[b] if b < len(before) else len(owner))
            heads = runs(text_of[lo + a : lo + b])
            who, cuts = text_of[lo + a + heads], before[a + heads] - first
            amount = np.diff(cuts, append=last - first)
            total, signs = fixed[first:last], sign[first:last]
            if lo + a:
                total = total + sum(np.repeat(own[k, who], amount) * x[first:last] for k, x in enumerate(inputs))
            wrong = np.exp(-np.clip(total * signs, -20, 20))
            out[who] -= np.add.reduceat(np.log2(1 + wrong).astype(np.float64), cuts)
            slope = signs * wrong / (1 + wrong)
            for k, x in enumerate(inputs):
                own[k, who] += STEP * np.add.reduceat(slope * x[first:last], cuts) / SEGMENT
        done = upto
    return out


def start_weights() -> np.ndarray:
    """First weights by gate and predictor; each gate's sum is 1."""
    weights = []
    for one in TRUST:
        for two in TRUST:
            w = np.array(START)
            w[1:3] *= one, two
            w[3:] *= (1 - w[:3].sum()) / w[3:].sum()
            weights.append(w)
    return np.array(weights, np.float32)


# What moves between the passes.


def _packed(array: np.ndarray) -> bytes:
    """Bytes of equal rank side by side, then compressed."""
    raw = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).ravel()


class Block(NamedTuple):
    """The words of some texts. token: each token's number among the distinct words, the end included, text after text.

    hashes, size, first: of the distinct words by hash, with their bytes and where their spelling starts in spelling.
    """

    token: np.ndarray
    tokens: np.ndarray
    size: np.ndarray
    hashes: np.ndarray
    spelling: np.ndarray
    spelled: np.ndarray


def block_of(texts: pa.Array) -> Block:
    """The texts' words. Bytes are worked on a slice of texts at a time."""
    hashes, sizes, owners, starts, row, done = [], [], [], [], 0, 0
    for part in blocks(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), 0, 1 << 20):
        data, off = text_buffers(part.column(0))
        start, end, own = word_spans(data, off)
        hashes.append(span_hashes(LOWER[data], start, end))
        sizes.append((end - start).astype(np.int32))
        owners.append((own + row).astype(np.int32))
        starts.append(start + done)
        row, done = row + part.num_rows, done + len(data)
    data, off = text_buffers(texts)
    n = len(off) - 1
    size, own = np.concatenate(sizes), np.concatenate(owners)
    start = np.concatenate(starts)
    words = np.bincount(own, minlength=n)
    every = np.empty(len(own) + n, np.uint64)
    at = np.arange(len(own)) + own
    every[at], every[np.cumsum(words + 1) - 1] = np.concatenate(hashes), _END_HASH
    order = np.argsort(every)
    ranked = every[order]
    first = runs(ranked)
    token = np.empty(len(every), np.uint32)
    token[order] = np.repeat(np.arange(len(first), dtype=np.uint32), np.diff(first, append=len(ranked)))
    which = np.searchsorted(at, order[first])  # a token of each distinct word, among the words
    which = np.where(ranked[first] == _END_HASH, -1, which)  # the end has no bytes
    begin, length = np.append(start, 0)[which], np.append(size, 0)[which]
    spelling, spelled_ = spelled(data, begin, begin + length)
    nbytes = np.bincount(own, weights=size + 1, minlength=n).astype(np.int64) + 1
    return Block(token, words + 1, nbytes, ranked[first], spelling, spelled_)


def _subset(block: Block, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spelling of the distinct words with these numbers."""
    size = np.diff(block.spelled)[which]
    ends = np.concatenate([[0], np.cumsum(size)])
    return block.spelling[np.arange(ends[-1]) + np.repeat(block.spelled[which] - ends[:-1], size)], ends


_ROW = ["block", "place", "hash", "cluster", "n", "ids", "learned", "packed"]


def _gather(id_type: pa.DataType):
    """For each block: a row for each distinct word and cluster it is learned in (how often), and one row of its texts' tokens."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in blocks(batches, 1, BLOCK_TEXT):
            found = block_of(part.column(1))
            learned, cluster = (part.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            taught = np.repeat(learned.astype(bool), found.tokens)
            key = found.token[taught].astype(np.int64) * CLUSTERS + np.repeat(cluster, found.tokens)[taught]
            n = np.bincount(key, minlength=len(found.hashes) * CLUSTERS)
            key = np.flatnonzero(n)
            never = np.setdiff1d(np.arange(len(found.hashes)), key // CLUSTERS)
            word = np.concatenate([key // CLUSTERS, never])
            size = len(word)
            none = lambda kind, m: pa.nulls(m, kind)
            kinds = (pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(size, number)), pa.array(word.astype(np.int32)), pa.array(found.hashes[word].view(np.int64)), pa.array(np.concatenate([key % CLUSTERS, np.zeros(len(never), np.int64)]).astype(np.int32)),
                pa.array(np.concatenate([n[key], np.zeros(len(never), np.int64)])), *(none(k, size) for k in kinds)], _ROW)
            packed = [_packed(x) for x in (found.token, found.tokens, found.size, found.spelling, np.diff(found.spelled).astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([-1], pa.int32()), none(pa.int64(), 1), none(pa.int32(), 1), none(pa.int64(), 1),
                pa.array([part.column(0).to_pylist()], kinds[0]), pa.array([learned.tolist()], kinds[1]), pa.array([packed], kinds[2])], _ROW)
            number += 1
            del found, learned, taught, cluster, key, n, never, word, packed
            trim()

    return gather


def _of_block(group: pa.Table) -> pa.Table:
    """The counts, clusters and head numbers of one block's words, in the order of the block, and which are in no block before."""
    place = group["place"].to_numpy()
    order = np.argsort(place, kind="stable")
    first = order[runs(place[order])]
    value, head = group["known"].to_numpy(), group["head"].to_numpy()[first]
    lead = np.zeros(int(place.max()) + 1, np.uint8)
    lead[place[(value & 1) > 0]] = 1
    both = value[first] >> 1
    known = [_packed(x) for x in (both // CLUSTERS, (both % CLUSTERS).astype(np.int8), head.astype(np.int16), lead)]
    return pa.table({"block": group["block"][:1], "known": pa.array([known], pa.list_(pa.binary()))})


def _read(packed: list[bytes]) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block, its words' counts, clusters and numbers in the head, and which of them are in no block before."""
    kinds = (np.uint32, np.int64, np.int64, np.uint8, np.uint32, np.int64, np.int8, np.int16, np.uint8)
    token, tokens, size, spelling, sizes, count, cluster, head, lead = (_unpacked(p, k) for p, k in zip(packed, kinds, strict=True))
    return Block(token, tokens, size, np.empty(0, np.uint64), spelling, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])), count, cluster.astype(np.int64), head.astype(np.int64), lead > 0


def _learn(model, bits: list[int]):
    """Each task's tables, in parts: how often each slot's bit was 0 and 1."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Symbols.read(model.value)
        tables = [np.zeros(2 << b, np.uint32) for b in bits]
        spelling = [np.zeros(2 << BYTE_BITS, np.uint32) for _ in ORDERS]
        salts = _salts(len(known.code.mass))
        for batch in batches:
            for packed, learned in zip(batch.column(2), batch.column(1), strict=True):
                block, count, cluster, head, lead = _read(packed.as_py())
                taught = np.array(learned.as_py(), bool)
                ends = np.concatenate([[0], np.cumsum(block.tokens[taught])])
                if ends[-1]:
                    symbol = known.of(count - 1, cluster, head)[block.token[np.repeat(taught, block.tokens)]]
                    _count(tables, symbol_contexts(known, symbol, ends), symbol, known.code, salts)
                words = np.flatnonzero(lead & (count > 0) & (np.diff(block.spelled) > 1))
                for at in range(0, len(words), SPELLED):
                    stream, ends = _subset(block, words[at : at + SPELLED])
                    _count(spelling, byte_contexts(stream, ends, cluster[words[at : at + SPELLED]]), stream, byte_code(), _salts(256))
                trim()
        step, part = 2 << PART_BITS, 0
        for table in (*tables, *spelling):
            for i in range(0, len(table), step):
                if table[i : i + step].any():
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_packed(table[i : i + step])], pa.binary())], ["part", "task", "counts"])
                part += 1
        del tables, spelling, table
        trim()

    return learn


def _summed(group: pa.Table) -> pa.Table:
    total = np.zeros(2 << PART_BITS, np.uint64)
    for raw in group["counts"]:
        total += _unpacked(raw.as_py(), np.uint32)
    counts = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
    return pa.table({"part": group["part"][:1].cast(pa.int32()), "task": pa.array([group["task"][0].as_py() // FAN_IN], pa.int64()), "counts": pa.array([_packed(counts)], pa.binary())})


def _slot_counts(counts: np.ndarray) -> np.ndarray:
    """Both counts of each slot in 32 bits; those of a slot with more than 16 bits keep their ratio."""
    pair = counts.reshape(-1, 2)
    most = pair.max(1)
    large = np.flatnonzero(most > 0xFFFF)
    out = np.minimum(pair, 0xFFFF)
    out[large] = np.minimum(np.ceil(pair[large] * (0xFFFF / most[large])[:, None]), 0xFFFF)
    return out[:, 0] | (out[:, 1] << np.uint32(16))


def _score(model, tables):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (of_symbols, of_bytes) = Symbols.read(model.value), tables.value
        for batch in batches:
            for row, packed in enumerate(batch.column(2)):
                block, count, cluster, head, _ = _read(packed.as_py())
                token, texts = block.token.astype(np.int64), len(block.tokens)
                ends = np.concatenate([[0], np.cumsum(block.tokens)])
                own = np.repeat(np.arange(texts), block.tokens)
                symbols_ = known.of(count, cluster, head)
                symbol = symbols_[token]
                score = symbol_bits(known, symbol, ends, of_symbols)
                share = np.where((head < 0) & (count > 0), np.log2(np.maximum(count, 1)) - known.shares[symbols_], 0.0)
                score += np.bincount(own, weights=share[token], minlength=texts)
                new = np.flatnonzero(count[token] == 0)
                pair, back = np.unique(token[new] * (CLUSTERS + 1) + usual_cluster(known, symbol, ends)[new], return_inverse=True)
                cost = np.empty(len(pair))
                for at in range(0, len(pair), SPELLED):
                    some = pair[at : at + SPELLED]
                    stream, spelled_ends = _subset(block, some // (CLUSTERS + 1))
                    cost[at : at + SPELLED] = spelling_bits(stream, spelled_ends, some % (CLUSTERS + 1), of_bytes)
                score += np.bincount(own[new], weights=cost[back], minlength=texts)
                base = np.bincount(own, weights=np.log10(count + 0.5)[token], minlength=texts)
                seen = np.bincount(own, weights=(count > 0)[token], minlength=texts).astype(np.int64)
                ids, learned = (batch.column(k)[row].values for k in (0, 1))
                arrays = [ids, learned, pa.array(block.tokens), pa.array(seen), pa.array(base), pa.array(score * math.log10(2)), pa.array(block.size)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "learned", "n_tokens", "n_known", "base", "score", "n_bytes"])
                del token, own, symbol, share, new, pair, back, block
                trim()

    return score


def _clusters(texts: DataFrame):
    """The number of a text's cluster: of the languages that most texts have, CLUSTERS - 1 at most, by rank; the rest share the last."""
    ranked = texts.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(CLUSTERS - 1).collect()
    cluster = F.lit(CLUSTERS - 1)
    for k, row in enumerate(ranked):
        cluster = F.when(F.col("lang").eqNullSafe(F.lit(row.lang)), F.lit(k)).otherwise(cluster)
    return cluster


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Scored are a text's words, lower-cased (A-Z), each followed by a space, and an end; learned are those of documents that
    aren't held out. base_score is log10 of a unigram model of the words, score that of the mixing model: each token is a
    symbol, coded in bits that the predictors give probabilities; a known word that isn't one of the HEAD most frequent then
    has its share of its symbol's counts, and one that isn't known is spelled. bits_per_byte is the model's. lang_col serves
    to group the words that are learned by language, never a text that is scored; None, or a column that isn't there: one
    group.

    Null text is empty: one token, the end. Repeated rows each get their row and are learned as often as they are there; an
    empty table gives an empty result; ties of counts in the head go by hash, ties of languages by name. Only id, text and
    lang are read, so other columns may have any name. A very long text is a block of its own: its tokens are held as
    numbers, a few bytes for each byte of text; the bits of SLAB tokens, or one segment of all texts, are held at a time.

    Passes: each task counts the distinct words of its blocks of texts; Spark adds them up by hash (64 bits, taken for the
    word) and returns to each block the counts of its own words, a row each, so what is gathered and moved grows with the
    corpus and no faster. Then each block teaches the predictors' tables, and each is scored. Of the corpus only the head,
    sums by count and language, and the tables are broadcast: HEAD words, (1 << BYTE_BITS) slots a byte predictor and
    (1 << SYMBOL_BITS) slots a symbol predictor, but for pairs of symbols a slot for each learned token up to
    (1 << PAIR_BITS). Slots have no check bits, so rare contexts share them: beyond some 8 M tokens the pairs' table fills
    up, and what still grows then is the words: all have their exact counts.
    """
    spark = docs.sparkSession
    kind, id_type = docs.schema[id_col].dataType.simpleString(), _arrow(docs.select(id_col))
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (~held_out(id_col)).alias("learned"), lang.alias("lang"))
    texts = texts.select("id", "text", "learned", _clusters(texts).alias("cluster"))
    schema = f"block bigint, place int, hash bigint, cluster int, n bigint, ids array<{kind}>, learned array<boolean>, packed array<binary>"
    gathered = cut(texts.mapInArrow(_gather(id_type), schema), "gathered")
    every, own = Window.partitionBy("hash"), Window.partitionBy("hash", "cluster")
    words = gathered.filter("place >= 0").select("block", "place", "hash", "cluster", "n")
    words = words.repartition("hash").withColumn("of_cluster", F.sum("n").over(own))
    words = words.withColumn("count", F.sum("n").over(every)).withColumn("usual", F.max(F.col("of_cluster") * CLUSTERS + CLUSTERS - 1 - F.col("cluster")).over(every))
    row = F.col("block") * CLUSTERS + F.col("cluster")  # a word has one row for each
    cluster = CLUSTERS - 1 - F.pmod("usual", F.lit(CLUSTERS))
    words = words.withColumn("known", (F.col("count") * CLUSTERS + cluster) * 2 + (F.min(row).over(every) == row).cast("bigint"))
    words = cut(words.select("block", "place", "hash", "known"), "words")
    drop(spark)
    distinct = words.select("hash", F.shiftright("known", 1).alias("both"), F.col("known").bitwiseAND(F.lit(1)).alias("lead")).filter("lead = 1").select("hash", F.floor(F.col("both") / CLUSTERS).alias("count"), F.pmod("both", F.lit(CLUSTERS)).alias("cluster")).filter("count > 0")
    is_end = F.col("hash") == int(_END_HASH.astype(np.int64))
    head = cut(distinct.filter((F.col("count") > 1) | is_end).orderBy(is_end.desc(), F.desc("count"), "hash").limit(HEAD).select("hash", "count", "cluster"), "head")
    ranked = sorted(head.collect(), key=lambda r: (-r["count"], r["hash"]))  # HEAD rows at most
    numbers = spark.createDataFrame([(r["hash"], k) for k, r in enumerate(ranked)], "hash bigint, head int")
    size, vocabulary = distinct.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    tail = distinct.join(F.broadcast(numbers), "hash", "left_anti").groupBy(_band(F.col("count")).alias("own"), _band(F.col("count") - 1).alias("less"), "cluster")
    tail = [tuple(r) for r in tail.agg(F.sum("count")).collect()]  # 128 by CLUSTERS rows at most
    bits = table_bits(int(size))
    known = symbols([(r["count"], r["cluster"]) for r in ranked], tail)
    model = spark.sparkContext.broadcast((*known[:2], tuple(known.code), *known[3:]))  # without classes, which a worker may not find
    counted = words.join(F.broadcast(numbers), "hash", "left").select("block", "place", "known", F.coalesce("head", F.lit(-1)).alias("head"))
    of_blocks = cut(counted.groupBy("block").applyInArrow(_of_block, "block bigint, known array<binary>"), "known")
    del counted, distinct
    drop(spark, words, head)
    whole = gathered.filter("place < 0").select("block", "ids", "learned", "packed")
    assembled = cut(whole.join(of_blocks, "block").select("ids", "learned", F.concat("packed", "known").alias("packed")), "blocks")
    del whole
    drop(spark, gathered, of_blocks)
    parts = cut(assembled.mapInArrow(_learn(model, bits), "part int, task bigint, counts binary"), "tables")
    tasks = 1
    while tasks:  # FAN_IN tasks' shares at a time
        parts = cut(parts.groupBy("part", F.floor(F.col("task") / FAN_IN).alias("to")).applyInArrow(_summed, "part int, task bigint, counts binary"), "tables")
        tasks = parts.agg(F.coalesce(F.max("task"), F.lit(0))).first()[0]
    tables = spark.sparkContext.broadcast(_tables(parts, bits))
    scored = assembled.mapInArrow(_score(model, tables), f"id {kind}, learned boolean, n_tokens bigint, n_known bigint, base double, score double, n_bytes bigint")
    base = F.col("base") - F.col("n_tokens") * math.log10(size + 0.5 * (vocabulary + 1))
    per_byte = -F.col("score") / math.log10(2) / F.col("n_bytes")
    return scored.select(F.col("id").alias(id_col), (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", F.lit(size).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes", per_byte.alias("bits_per_byte"))


def _band(count):
    """As band_of."""
    return F.when(count > 0, F.length(F.bin(count))).otherwise(0)


def _tables(parts: DataFrame, bits: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The predictors' tables: of symbols, and of bytes. Their size has a fixed bound, so the driver's share is bounded."""
    sizes = [1 << b for b in bits] + [1 << BYTE_BITS] * len(ORDERS)
    flat = np.zeros(sum(sizes), np.uint32)
    for part, raw in parts.select("part", "counts").toLocalIterator():
        flat[part << PART_BITS : (part + 1) << PART_BITS] = _slot_counts(_unpacked(raw, np.uint32))
    tables = np.split(flat, np.cumsum(sizes)[:-1])
    return tables[: len(START) - 1], tables[len(START) - 1 :]


def _arrow(ids: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(ids.schema[0].dataType)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
