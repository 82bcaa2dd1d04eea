"""Byte-level codes of sequences: numbers, packing, compression and differences.

These work on one value; the columns at the end apply them to Arrow batches. They are
what a JVM expression cannot say: bit packing, zstd and the search for matches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from .bases import IUPAC, UNKNOWN

M64 = (1 << 64) - 1


# Multipliers and shifts of the published murmur hashes.
def murmur64(x: int) -> int:
    """The 64-bit finaliser of MurmurHash3."""
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & M64
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & M64
    return x ^ x >> 33


def murmur32(x: int) -> int:
    """The 32-bit finaliser of MurmurHash3."""
    x ^= x >> 16
    x = x * 0x85EBCA6B & 0xFFFFFFFF
    x ^= x >> 13
    x = x * 0xC2B2AE35 & 0xFFFFFFFF
    return x ^ x >> 16


def murmur64a(key: int, seed: int = 0) -> int:
    """MurmurHash64A of the eight bytes of a number."""
    m = 0xC6A4A7935BD1E995
    h = seed ^ 8 * m & M64
    k = key * m & M64
    k = (k ^ k >> 47) * m & M64
    h = (h ^ k) * m & M64
    h = (h ^ h >> 47) * m & M64
    return h ^ h >> 47


def murmur64_columns(x: np.ndarray) -> np.ndarray:
    """murmur64() of an array."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> np.uint64(33)) * np.uint64(m)
        return x ^ x >> np.uint64(33)


def murmur64a_columns(key: np.ndarray, seed: int = 0) -> np.ndarray:
    """murmur64a() of an array."""
    with np.errstate(over="ignore"):
        m, r = np.uint64(0xC6A4A7935BD1E995), np.uint64(47)
        k = key.astype(np.int64).view(np.uint64) * m
        k = (k ^ k >> r) * m
        h = (np.uint64(seed ^ 8 * 0xC6A4A7935BD1E995 & M64) ^ k) * m
        h = (h ^ h >> r) * m
        return h ^ h >> r


def murmur_pair(a: int, b: int) -> int:
    """The finaliser over two numbers, one after the other."""
    return murmur64(murmur64(a) ^ b)


def murmur_text(text: str) -> int:
    """MurmurHash3 (128 bits, seed 0) of a text's UTF-8 bytes, both halves folded by an
    exclusive-or. Whole blocks are read highest byte first, the rest lowest first.
    """
    turn = lambda x, r: (x << r | x >> 64 - r) & M64
    one, two = 0x87C37B91114253D5, 0x4CF5AD432745937F
    first = lambda k: turn(k * one & M64, 31) * two & M64
    second = lambda k: turn(k * two & M64, 33) * one & M64
    data, a, b = text.encode(), 0, 0
    whole = len(data) // 16 * 16
    for i in range(0, whole, 16):
        a = ((turn(a ^ first(int.from_bytes(data[i : i + 8], "big")), 27) + b) * 5 + 0x52DCE729) & M64
        b = ((turn(b ^ second(int.from_bytes(data[i + 8 : i + 16], "big")), 31) + a) * 5 + 0x38495AB5) & M64
    rest = data[whole:]
    b ^= second(int.from_bytes(rest[8:], "little")) if len(rest) > 8 else 0
    a ^= first(int.from_bytes(rest[:8], "little")) if rest else 0
    a, b = a ^ len(data), b ^ len(data)
    a = (a + b) & M64
    b = (a + b) & M64
    a, b = murmur64(a), murmur64(b)
    a = (a + b) & M64
    b = (a + b) & M64
    return a ^ b


def kept_by_hash_columns(kmers: np.ndarray, fraction: float, salt: int = 0) -> np.ndarray:
    """kept_by_hash() of an array."""
    return (murmur64a_columns(kmers) ^ np.uint64(salt)) < np.uint64(min(M64, int(fraction * M64)))


def kept_by_hash(kmer: int, fraction: float, salt: int = 0) -> bool:
    """Is a k-mer in the sample of about ``fraction`` of all?"""
    return (murmur64a(kmer) ^ salt) < min(M64, int(fraction * M64))


def write_number(x: int) -> bytes:
    """A length byte and the number's bytes, highest first; 0 is one zero byte."""
    size = (x.bit_length() + 7) // 8
    return bytes([size]) + x.to_bytes(size, "big")


def read_number(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number at ``at`` and the place after it."""
    size = data[at]
    return int.from_bytes(data[at + 1 : at + 1 + size], "big"), at + 1 + size


#: First values that take two, three, four and five bytes.
STEPS = (1 << 7, (1 << 7) + (1 << 14), (1 << 7) + (1 << 14) + (1 << 21), (1 << 7) + (1 << 14) + (1 << 21) + (1 << 28))


def write_prefixed(x: int) -> bytes:
    """One to five bytes; the leading ones of the first tell how many follow."""
    n = sum(x >= s for s in STEPS)
    if n == 4:
        return b"\xf0" + (x - STEPS[3]).to_bytes(4, "big")
    rest = (x - (STEPS[n - 1] if n else 0)).to_bytes(n + 1, "big")
    return bytes([rest[0] | (0xFF << (8 - n) & 0xFF)]) + rest[1:]


def read_prefixed(data: bytes, at: int = 0) -> tuple[int, int]:
    n = next(i for i in range(5) if i == 4 or not data[at] >> (7 - i) & 1)
    if n == 4:
        return int.from_bytes(data[at + 1 : at + 5], "big") + STEPS[3], at + 5
    value = int.from_bytes(bytes([data[at] & (0xFF >> (n + 1))]) + data[at + 1 : at + n + 1], "big")
    return value + (STEPS[n - 1] if n else 0), at + n + 1


def _table(any_case: bool) -> np.ndarray:
    table = np.full(256, UNKNOWN, np.uint8)
    for i, c in enumerate(IUPAC):
        table[ord(c)] = i
        if any_case:
            table[ord(c.lower())] = i
    return table


_TABLES = {case: _table(case) for case in (False, True)}


def to_codes(seq: str, any_case: bool = True) -> np.ndarray:
    return _TABLES[any_case][np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


#: Bytes of a column that are cleaned at a time.
SLICE = 1 << 22


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow column of texts, a byte for each letter; letters
    that take more are a question mark.
    """
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    if len(raw) and raw.max() >= 128:
        each = [(x or "").encode("latin-1", "replace") for x in texts.to_pylist()]
        return np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64), np.frombuffer(b"".join(each), np.uint8)
    return at - at[0], raw


def codes_of(raw: np.ndarray) -> np.ndarray:
    """Codes of upper-case letters, as to_codes() tells them."""
    return _TABLES[False][raw]


def only_bases_column(texts: pa.Array, also: str = "") -> pa.Array:
    """The letters A, C, G and T of each text (and ``also``), upper case; null stays null."""
    table = np.zeros(256, np.uint8)
    for c in "ACGT" + also:
        table[ord(c)] = table[ord(c.lower())] = ord(c)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return texts.cast(pa.string())
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    sizes, kept, row = [np.zeros(1, np.int64)], [], 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE, "right")) - 1)
        letters = table[raw[at[row] : at[end]]]
        places = np.flatnonzero(letters)
        kept.append(letters[places])
        sizes.append(np.diff(np.searchsorted(places, at[row : end + 1] - at[row])))
        row = end
    ends = np.cumsum(np.concatenate(sizes)).astype(np.int32)
    out = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(np.concatenate(kept)))
    return out if not texts.null_count else pa.array(out.to_pylist(), pa.string(), mask=~texts.is_valid().to_numpy(zero_copy_only=False))


def to_letters(codes: np.ndarray) -> str:
    table = np.frombuffer((IUPAC + "N" * 240).encode(), np.uint8)
    return table[codes].tobytes().decode()


def turned(codes: np.ndarray) -> np.ndarray:
    """The reverse complement of codes; those from 4 on stay what they are."""
    back = codes[::-1]
    return np.where(back < 4, 3 - back, back).astype(np.uint8)


def unpack_two_bits(packed: bytes, length: int) -> np.ndarray:
    """Codes of two bits each, highest bits first."""
    bits = np.frombuffer(packed, np.uint8)
    return ((bits[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).reshape(-1)[:length]


def pack_tuples(codes: np.ndarray) -> bytes:
    """As many symbols in a byte as their range allows (4, 3, 2 or 1), and a last byte
    with that number and how many the byte before holds.
    """
    top = int(codes.max(initial=0)) + 1
    n, base = (4, 4) if top <= 4 else (3, 6) if top <= 6 else (2, 16) if top <= 16 else (1, 256)
    if n == 1:
        return codes.tobytes() + bytes([0x10])
    full, over = divmod(len(codes), n)
    weights = base ** np.arange(n - 1, -1, -1)
    body = (codes[: full * n].reshape(-1, n).astype(np.int64) * weights).sum(axis=1).astype(np.uint8).tobytes()
    last = 0
    for c in codes[full * n :].tolist():
        last = last * base + c
    return body + (bytes([last]) if over else b"") + bytes([n << 4 | over])


def unpack_tuples(data: bytes) -> np.ndarray:
    n, over = data[-1] >> 4, data[-1] & 15
    body = np.frombuffer(data[:-1], np.uint8)
    if n == 1:
        return body.copy()
    base = {4: 4, 3: 6, 2: 16}[n]
    whole = body[:-1] if over else body
    out = (whole[:, None].astype(np.int64) // base ** np.arange(n - 1, -1, -1) % base).reshape(-1).astype(np.uint8)
    if not over:
        return out
    return np.concatenate([out, (int(body[-1]) // base ** np.arange(over - 1, -1, -1) % base).astype(np.uint8)])


def compress(data: bytes, level: int = 17) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def decompress(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def lag_share(codes: np.ndarray) -> float:
    """The share that chooses a reference's compression: see bases.repetitiveness()."""
    best = 0.0
    for lag in range(4, 32):
        a, b = codes[:-lag], codes[lag:]
        known = int((a < 4).sum())
        best = max(best, int((a == b).sum()) / known if known else 0.0)
        if best >= 0.5:
            break
    return best


def compress_reference(codes: np.ndarray) -> tuple[bytes, int]:
    """Block and marker: packed tuples at level 13 unless the sequence repeats itself."""
    if lag_share(codes) < 0.5:
        return compress(pack_tuples(codes), 13), 1
    return compress(codes.tobytes(), 19), 0


def decompress_marked(data: bytes, marker: int) -> np.ndarray:
    raw = decompress(data)
    return unpack_tuples(raw) if marker else np.frombuffer(raw, np.uint8).copy()


#: Codes of the difference text. A literal is 'A' plus its code.
EQUAL, RUN, RUN_END, MATCH_END, LENGTH = ord("!"), 0x1E, 0x04, ord("."), ord(",")
LEAST_RUN, SAMPLE = 4, 4
N = 4


class Differ:
    """Tells sequences by their differences from one reference.

    The reference is indexed by hashes of its words at every fourth place; a target
    takes, at each place, a run of N, the longest match of those the index offers
    (grown to both sides), or one base: the expected one, or a literal.
    """

    def __init__(self, reference: np.ndarray, min_match: int = 20) -> None:
        self.ref, self.min_match, self.word = reference, min_match, min_match - SAMPLE + 1
        self.text = reference.tobytes()
        self.index: dict[bytes, list[int]] = {}
        plain = int(reference.max(initial=0)) < 4
        for i in range(0, len(reference) - self.word + 1, SAMPLE):
            w = self.text[i : i + self.word]
            if plain or max(w) < 4:
                self.index.setdefault(w, []).append(i)

    @staticmethod
    def _common(a: bytes, i: int, b: bytes, j: int) -> int:
        """How many bytes are alike from ``i`` and ``j`` on; takes time for these only."""
        n, done, step = min(len(a) - i, len(b) - j), 0, 16
        while done < n:
            step = min(step, n - done)
            if a[i + done : i + done + step] == b[j + done : j + done + step]:
                done, step = done + step, step * 4
            elif step > 16:
                step //= 4
            else:
                while a[i + done] == b[j + done]:
                    done += 1
                break
        return done

    def marks(self, target: np.ndarray) -> list[tuple[str, int, int, int]]:
        """tokens() of more than one base, in order: runs and matches. Between them each
        base is a token of its own. Only places whose word is in the index are looked at.
        """
        data, text, word, index = target.tobytes(), self.text, self.word, self.index
        out: list[tuple[str, int, int, int]] = []
        n = len(data)
        hits = [i for i in range(n - word + 1) if data[i : i + word] in index] if index else []
        runs = []
        if data.find(b"\x04" * LEAST_RUN) >= 0:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], target == N, [0]]).astype(np.int8))).tolist()
            runs = [x for x in zip(edges[::2], edges[1::2], strict=True) if x[1] - x[0] >= LEAST_RUN]
        # i: what is told so far, in so many tokens; shift: the expected place in the reference less that in the target.
        i = shift = h = r = count = 0
        while True:
            while h < len(hits) and hits[h] < i:
                h += 1
            while r < len(runs) and runs[r][1] - max(i, runs[r][0]) < LEAST_RUN:
                r += 1
            if r < len(runs) and (h == len(hits) or runs[r][0] < hits[h]):
                at = max(i, runs[r][0])
                out.append(("run", at, runs[r][1] - at, 0))
                count += at - i + 1
                shift -= runs[r][1] - at
                i = runs[r][1]
                continue
            if h == len(hits):
                return out
            p = hits[h]
            h += 1
            best, near, place, behind, ahead = 0, 0, 0, 0, 0
            for at in index[data[p : p + word]][:64]:
                forward = self._common(data, p, text, at)
                back, most = 0, min(p - i, at)
                while back < most and data[p - back - 1] == text[at - back - 1]:
                    back += 1
                d = abs(at - p - shift)
                if forward + back > best or (forward + back == best and d < near):
                    best, near, place, behind, ahead = forward + back, d, at, back, forward
            if best >= self.min_match:
                behind = min(behind, (count + p - i + 1) // 2)  # no more than half of the tokens so far are taken back
                out.append(("match", p - behind, ahead + behind, place - behind))
                count += p - behind - i + 1
                i, shift = p + ahead, place - p

    def tokens(self, target: np.ndarray) -> list[tuple[str, int, int, int]]:
        """(kind, place in the target, length, place in the reference) in order; kinds
        are literal, equal, run and match. Nothing if the target is the reference.
        """
        if target.tobytes() == self.text:
            return []
        out: list[tuple[str, int, int, int]] = []
        i = expected = 0
        for mark in [*self.marks(target), ("end", len(target), 0, 0)]:
            kind, begin, length, at = mark
            for j in range(i, begin):
                same = expected < len(self.text) and self.text[expected] == target[j]
                out.append(("equal" if same else "literal", j, 1, expected))
                expected += 1
            if kind != "end":
                out.append(mark)
            i = begin + length
            expected = at + length if kind == "match" else expected
        return out

    def _match(self, length: int, place: int, expected: int, last: bool) -> bytes:
        to_end = last and place + length == len(self.ref)
        return str(place - expected).encode() + (b"" if to_end else b",%d" % (length - self.min_match)) + b"."

    def pieces(self, target: np.ndarray) -> list[tuple[int, int, bytes]]:
        """(place, length, text) of each run, match and stretch of single bases, whose
        texts are a byte for each base.
        """
        if target.tobytes() == self.text:
            return []
        out: list[tuple[int, int, bytes]] = []
        i = expected = 0
        for kind, begin, length, at in [*self.marks(target), ("end", len(target), 0, 0)]:
            if begin > i:
                own, there = target[i:begin], self.ref[expected : expected + begin - i]
                text = own + np.uint8(ord("A"))
                text[: len(there)][own[: len(there)] == there] = EQUAL
                out.append((i, begin - i, text.tobytes()))
                expected += begin - i
            if kind == "run":
                out.append((begin, length, bytes([RUN]) + str(length - LEAST_RUN).encode() + bytes([RUN_END])))
            elif kind == "match":
                out.append((begin, length, self._match(length, at, expected, begin + length == len(target))))
                expected = at + length
            i = begin + length
        return out

    def encode(self, target: np.ndarray) -> bytes:
        if not len(target) and len(self.ref):  # an empty text means the reference itself
            return bytes([RUN]) + str(-LEAST_RUN).encode() + bytes([RUN_END])
        return b"".join(t for _, _, t in self.pieces(target))

    def decode(self, text: bytes) -> np.ndarray:
        if not text:
            return self.ref.copy()
        out, expected, i = bytearray(), 0, 0
        while i < len(text):
            c = text[i]
            if c == EQUAL:
                out.append(self.text[expected])
                expected, i = expected + 1, i + 1
            elif c == RUN:
                end = text.index(RUN_END, i)
                out += bytes([N]) * (int(text[i + 1 : end]) + LEAST_RUN)
                i = end + 1
            elif ord("A") <= c <= ord("A") + 32:
                out.append(c - ord("A"))
                expected, i = expected + 1, i + 1
            else:
                end = text.index(MATCH_END, i)
                step, comma, length = text[i:end].partition(b",")
                at = expected + int(step)
                expected = at + int(length) + self.min_match if comma else len(self.text)
                out += self.text[at:expected]
                i = end + 1
        return np.frombuffer(bytes(out), np.uint8).copy()

    def costs(self, target: np.ndarray, at_start: bool) -> np.ndarray:
        """For each base the bytes that its token takes, at the token's first base or
        its last.
        """
        return costs_of(self.pieces(target), len(target), at_start)

    def estimate(self, target: np.ndarray, bound: int | None = None) -> int:
        """Bytes of the whole text; what exceeds ``bound`` counts as just that."""
        total = sum(len(text) for _, _, text in self.pieces(target))
        return total if bound is None else min(total, bound)


def costs_of(pieces: list[tuple[int, int, bytes]], n: int, at_start: bool) -> np.ndarray:
    """Differ.costs() of a target of ``n`` bases from its pieces."""
    out = np.zeros(n, np.int32)
    for i, length, text in pieces:
        if len(text) == length and text[:1] != bytes([RUN]) and text[-1:] != bytes([MATCH_END]):
            out[i : i + length] = 1  # single bases
        else:
            out[i if at_start else i + length - 1] = len(text)
    return out


def as_list(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in decimal, joined by commas."""
    if not len(numbers) or numbers.max() > 9:
        return ",".join(map(str, numbers.tolist())).encode()
    out = np.full(2 * len(numbers) - 1, ord(","), np.uint8)
    out[::2] = numbers + ord("0")
    return out.tobytes()


def best_split(left: np.ndarray, right: np.ndarray, k: int) -> tuple[str, int]:
    """Where to part a segment between two groups, from its costs against the reference
    of the left one (at the start) and of the right one (at the end): ("right", 0) or
    ("left", n) for all of it, ("split", place), or ("none", 0) if it is too short. The
    costs up to and at a place for the left, and at and from it for the right, are least.
    """
    n = len(left)
    if n < 2 * (k + 1):
        return "none", 0
    total = np.cumsum(left) + right[::-1].cumsum()[::-1]
    at = int(total.argmin())
    if at < k + 1:
        return "right", 0
    if at + k + 1 > n:
        return "left", n
    return "split", at


def split_at(seq: str, pos: int, k: int) -> tuple[str, str]:
    """Both pieces; they share k bases around ``pos``."""
    begin = max(pos - (k + 1) // 2, 0)
    return seq[: begin + k], seq[begin:]


def packed(items: list[bytes]) -> bytes:
    """A pack's items with 0xFF between; the inverse is unpacked()."""
    return b"".join(x + b"\xff" for x in items)


def unpacked(pack: bytes, n: int) -> bytes:
    return pack.split(b"\xff")[n]


def code_id(value: int, last: int) -> int:
    """An id in a group told by the largest so far (-1: none yet)."""
    if last == -1 or value == 0:
        return value
    if value == last + 1:
        return 1
    return against(value, last + 1) + 1


def read_id(code: int, last: int) -> int:
    """The inverse of code_id()."""
    if last == -1 or code == 0:
        return code
    if code == 1:
        return last + 1
    return read_against(code - 1, last + 1)


def read_against(code: int, near: int) -> int:
    """The inverse of against()."""
    return code if code >= 2 * near else near - (code + 1) // 2 if code % 2 else near + code // 2


def against(value: int, near: int) -> int:
    """A value told by a near one: see bases.zigzag_against()."""
    return value if value >= 2 * near else 2 * (value - near) if value >= near else 2 * (near - value) - 1


def _column(f: Callable, kind: str):
    return F.pandas_udf(f, kind)


def murmur64_column():
    """A column function: murmur64 of a long, as a signed long."""

    def run(x: pd.Series) -> pd.Series:
        return pd.Series(murmur64_columns(x.to_numpy(np.int64).view(np.uint64)).view(np.int64))

    return _column(run, "long")
