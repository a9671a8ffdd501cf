"""Canonical length-limited Huffman codes over token ids, with numpy.

Code lengths are optimal under the limit (package-merge). Codes are canonical:
they follow from the lengths alone, shorter ones first, ids ascending within a
length. A stream is cut into blocks of equally many ids; the bit offset at which
each begins is its checkpoint, so any block can be decoded alone. Decoding looks
up the next ``limit`` bits in a table and does that for many blocks at a time.
"""

from __future__ import annotations

import numpy as np

#: Bits of the longest code, if the alphabet doesn't need more.
LIMIT = 16
#: The longest code that four bytes from any bit on are sure to hold.
MOST_BITS = 25
#: Ids in a block.
BLOCK = 512


def limit_for(n_symbols: int) -> int:
    """The length limit for so many different ids: 16 bits, or what they need at least."""
    need = max(LIMIT, int(n_symbols - 1).bit_length())
    if need > MOST_BITS:
        raise ValueError(f"{n_symbols} ids need codes of more than {MOST_BITS} bits")
    return need


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Bits of each id's code (0: doesn't occur), the shortest total that no code of more than ``limit`` bits allows.

    A single id gets one bit. No ids at all: all lengths are 0.
    """
    used = np.flatnonzero(counts)
    n = len(used)
    out = np.zeros(len(counts), np.uint8)
    limit = limit or limit_for(n)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids can't have codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    packages, levels = leaves[:0], []
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        pairs = both[at][: len(both) // 2 * 2]
        packages = pairs[::2] + pairs[1::2]
    # Of the last level the cheapest 2n - 2 are taken; packages among them stand for two of the level before.
    take, bits = 2 * n - 2, np.zeros(n, np.uint8)
    for is_leaf in reversed(levels):
        leaf = int(is_leaf[:take].sum())
        bits[:leaf] += 1
        take = 2 * (take - leaf)
    out[order] = bits
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, as a number of ``lengths`` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint64)
    if len(order):
        bits = lengths[order].astype(np.int64)
        top = int(bits[-1])
        # Aligned to the longest code, each code begins where those before it end.
        begin = np.concatenate([[0], np.cumsum(np.int64(1) << (top - bits))[:-1]])
        codes[order] = (begin >> (top - bits)).astype(np.uint64)
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The bits of ``ids``, first bit highest, and the bit offset at which each block begins and the last ends."""
    bits = lengths[ids].astype(np.int64)
    if len(bits) and not bits.min():
        raise ValueError("an id has no code")
    ends = np.cumsum(bits)
    total = int(ends[-1]) if len(ends) else 0
    begins = ends - bits
    checkpoints = np.append(begins[::block], total).astype("<u8")
    words = np.zeros(total // 64 + 2, np.uint64)
    if len(ids):
        code = codes[ids]
        word, room = begins >> 6, 64 - (begins & 63) - bits
        whole = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.add.reduceat(whole, first)
        over = np.flatnonzero(room < 0)  # one a word at most
        words[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (total + 7) // 8], checkpoints


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each value of the next bits the id (times 32) plus its code's length; how many bits those are."""
    top = max(1, int(lengths.max(initial=0)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    table = np.repeat(order.astype(np.int64) << 5 | lengths[order], np.int64(1) << (top - lengths[order].astype(np.int64)))
    return np.append(table, np.zeros((1 << top) - len(table), np.int64)), top


def decode(payload: bytes, checkpoints: np.ndarray, n_ids: int, table: np.ndarray, top: int, block: int = BLOCK) -> np.ndarray:
    """The ids of the blocks that begin at ``checkpoints`` (the last is where they end); ``n_ids`` in all of them.

    checkpoints: bit offsets into ``payload``, which may be a part of a stream.
    """
    if not n_ids:
        return np.empty(0, np.int64)
    raw = np.frombuffer(payload + bytes(4), np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at = checkpoints[:-1].astype(np.int64)
    lanes = len(at)
    out = np.zeros((block, lanes), np.int64)
    mask = np.uint32((1 << top) - 1)
    last = n_ids - (lanes - 1) * block
    for i in range(block):
        if i == last:
            lanes -= 1  # the last block is over
            at = at[:lanes]
            if not lanes:
                break
        found = table[(window[at >> 3] >> (32 - top - (at & 7)).astype(np.uint32)) & mask]
        out[i, :lanes] = found >> 5
        at = at + (found & 31)
    if not np.array_equal(at, checkpoints[1 : lanes + 1].astype(np.int64)):
        raise ValueError("blocks don't end at their checkpoints")
    return out.T.ravel()[:n_ids]
