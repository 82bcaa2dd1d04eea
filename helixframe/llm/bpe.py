"""BPE encoding and decoding with a public vocabulary, by tree concatenation.

Text that a vocabulary never joins across (a space or a line feed) is encoded
piece by piece, with a bounded cache of the pieces seen. Long text without such a
place, and every long document, is halved; the halves are encoded in parallel and
then joined: a window around the join is encoded again and grows until its tokens
agree with those of both sides, identifier and place, some way off the join. A BPE
encoding is right if each pair of neighbours is, so from an agreed token on the
encodings can be spliced, and the result is that of the whole text.

Documents up to ``piece_chars`` are encoded where they are read (no shuffle).
Longer ones are cut into pieces that are dealt over the cluster, encoded, and
joined as a tree in one task for each document, so one long document does not
hold up a task, and only long documents are shuffled.

Defined results: null counts as the empty text (no tokens, empty decoding);
repeated rows give one row each; an empty table gives no rows; only ``id_col`` and
``text_col`` are read, other columns are ignored, whatever their names.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import json
import os
import re
import threading
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_FOLD, LOWER, UPPER, table

#: Characters of a text without a space from which it is halved.
LEAF_CHARS = 4096
#: Characters of a document from which its pieces are encoded by different tasks.
PIECE_CHARS = 1 << 16
#: Pieces without a space in a generation of a Python worker's cache.
CACHE = 400_000
#: Characters in such a generation, from which it counts as full too.
CACHE_CHARS = 1 << 23
#: Seconds without a task after which a Python worker forgets vocabulary and cache.
IDLE_SECONDS = 5.0
#: Characters of documents that are looked up together.
BATCH_CHARS = 1 << 21
#: Runs of letters that are encoded together.
RUNS = 1000
#: Marks that are parted from the letters before them (not the apostrophe: 's is a token).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: How a vocabulary must take texts for runs of letters to be encoded together.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Characters between a join and the tokens that must agree; above the longest special token.
GUARD = 64


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core; idle threads would spin
    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


class Encoded:
    """The tokens of a text: identifiers and the places of their characters."""

    __slots__ = ("ends", "ids", "size", "starts")

    def __init__(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> None:
        self.ids, self.starts, self.ends, self.size = ids, starts, ends, size

    @classmethod
    def of(cls, own, text: str) -> Encoded:
        e = own.encode(text, add_special_tokens=False)
        spans = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
        return cls(np.array(e.ids, dtype=np.int32), spans[:, 0].copy(), spans[:, 1].copy(), len(text))


def _alike(a: Encoded, i: int, b: Encoded, j: int, shift: int) -> bool:
    """Is token i of a token j of b, which begins ``shift`` characters later?"""
    return a.ids[i] == b.ids[j] and a.starts[i] == b.starts[j] + shift and a.ends[i] == b.ends[j] + shift


def joined(own, left_text: str, left: Encoded, right_text: str, right: Encoded, window: int = 64) -> Encoded:
    """The encoding of both texts together, from those of each."""
    at, n, m = left.size, len(left.ids), len(right.ids)
    while True:
        lo, hi = max(0, n - window), min(m, window)
        begin = int(left.starts[lo]) if lo else 0
        end = int(right.ends[hi - 1]) if hi < m else right.size
        mid = Encoded.of(own, left_text[begin:] + right_text[:end])
        places = {int(left.starts[i]): i for i in range(n - 1, lo - 1, -1)}  # the first token that begins there
        first = None  # (tokens kept on the left, first token of mid)
        if not lo:
            first = (0, 0)
        else:
            for j in range(len(mid.ids) - 2, -1, -1):
                if mid.ends[j + 1] + begin > at - GUARD:
                    continue
                i = places.get(int(mid.starts[j]) + begin)
                if i is not None and i + 1 < n and _alike(left, i, mid, j, begin) and _alike(left, i + 1, mid, j + 1, begin):
                    first = (i + 1, j + 1)
                    break
        last = None  # (tokens of mid kept, first token of the right side)
        if hi == m:
            last = (len(mid.ids), m)
        elif first:
            places = {int(right.starts[i]): i for i in range(hi - 1, -1, -1)}
            shift = at - begin
            for j in range(first[1], len(mid.ids) - 1):
                if mid.starts[j] - shift < GUARD:
                    continue
                i = places.get(int(mid.starts[j]) - shift)
                if i is not None and i + 1 < m and _alike(mid, j, right, i, shift) and _alike(mid, j + 1, right, i + 1, shift):
                    last = (j + 1, i + 1)
                    break
        if first and last:
            keep, j0 = first
            j1, i1 = last
            return Encoded(
                np.concatenate([left.ids[:keep], mid.ids[j0:j1], right.ids[i1:]]),
                np.concatenate([left.starts[:keep], mid.starts[j0:j1] + begin, right.starts[i1:] + at]),
                np.concatenate([left.ends[:keep], mid.ends[j0:j1] + begin, right.ends[i1:] + at]),
                left.size + right.size,
            )
        window *= 2


def tree_joined(own, texts: list[str], parts: list[Encoded]) -> Encoded:
    """Joins neighbours until one encoding is left."""
    while len(parts) > 1:
        parts = [joined(own, texts[i], parts[i], texts[i + 1], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        texts = ["".join(texts[i : i + 2]) for i in range(0, len(texts), 2)]
    return parts[0]


def tree_encoded(own, text: str, leaf: int = LEAF_CHARS) -> Encoded:
    """Encodes the leaves of the halved text in one batch, and joins them."""
    count = 1
    while len(text) > leaf * count:
        count *= 2
    cuts = [len(text) * i // count for i in range(count + 1)]
    texts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return tree_joined(own, texts, [Encoded.of(own, t) for t in texts])


def _folds(own) -> bool:
    """Does the vocabulary take A-Z as a-z?"""
    tokens = lambda t: own.encode(t, add_special_tokens=False).ids
    return tokens(UPPER) == tokens(LOWER)


def _run_end(own) -> str:
    """What the last token of each run of letters ends in, and no other token; empty
    if this vocabulary is not known to part letters, digits and marks like that.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    made = json.loads(own.to_str())
    end = made["model"].get("end_of_word_suffix")
    known = (
        end
        and made["decoder"] is None
        and (made["normalizer"], made["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER)
        and all(c + end in made["model"]["vocab"] for c in ByteLevel.alphabet())
        and all(re.search(r"[^\w\s][^\W_]", t["content"]) for t in made["added_tokens"])  # not in letters followed by marks
    )
    return end if known else ""


class Encoder:
    """Encodes and decodes whole texts, with a cache of the pieces between spaces
    in two generations: when the young one is full, the old one is forgotten.

    New pieces that are runs of letters are encoded many at a time, with a space
    between, and told apart by the tokens that end a run. As each has one run at
    least, as many ends as pieces mean that each has one; else they are encoded
    one by one. Marks behind letters are a piece of their own.
    """

    def __init__(self, path: str, leaf: int = LEAF_CHARS) -> None:
        self.own, self.leaf, self.young, self.old, self.chars = tokenizer(path), leaf, {}, {}, 0
        self.folds, self.end, self.closing = _folds(self.own), _run_end(self.own), {}
        size = self.own.get_vocab_size(with_added_tokens=True)
        self.names = [str(i) for i in range(size)]
        # Without a decoder the decoded text is the tokens with a space between.
        self.signs = [self.own.id_to_token(i) or "" for i in range(size)] if self.own.decoder is None else None
        if self.end:
            after = ["\n" if t.endswith(self.end) else " " for t in self.signs]
            self.run_names = [x + y for x, y in zip(self.names, after, strict=True)]
            self.run_signs = [x + y for x, y in zip(self.signs, after, strict=True)]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, and the two digests."""
        return tuple(column[0] for column in self.digests([text]))

    def digests(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Of each text: number of tokens, and the two digests."""
        raw = [t.encode() for t in texts]
        # Special tokens are told by their case.
        raw = [t.translate(ASCII_FOLD) if self.folds and b"<|" not in t else t.replace(b"\n", b" ") for t in raw]
        rows = pc.split_pattern(pa.array(raw, pa.large_binary()).view(pa.large_string()), " ")
        coded = rows.flatten().dictionary_encode()
        pieces = _joined(coded.dictionary, [0, len(coded.dictionary)])[0].as_py().split(" ")
        entries = self.entries(pieces)
        some = np.array([x != "" for x in entries])
        both = "\t".join([x or "\t" for x in entries]).split("\t")
        names, signs = pa.array(both[::2], pa.large_string()), pa.array(both[1::2], pa.large_string())
        codes = coded.indices.to_numpy()
        kept = some[codes]
        codes, offsets = codes[kept], _sums(kept)[rows.offsets.to_numpy()]
        counts = _sums((pc.count_substring(names, " ").to_numpy() + 1)[codes])[offsets]
        whole = [_joined(x.take(pa.array(codes)), offsets) for x in (names, signs)]
        return np.diff(counts).tolist(), *([hashlib.sha256(t).hexdigest() for t in x.view(pa.large_binary()).to_pylist()] for x in whole)

    def entries(self, pieces: list[str]) -> list[str]:
        """Of each piece: identifiers, a tab, and the decoded text, which holds no tab;
        of one without tokens: nothing.
        """
        if len(self.young) > CACHE or self.chars > CACHE_CHARS:
            self.old, self.young, self.chars = self.young, {}, 0
        found = list(map(self.young.get, pieces))
        missing = [i for i, x in enumerate(found) if x is None]
        learned = self.learn({pieces[i] for i in missing})
        for i in missing:
            found[i] = learned[pieces[i]]
        return found

    def learn(self, pieces: set[str]) -> dict[str, str]:
        """The entries of pieces that are not in the young generation; puts them there,
        but for long ones.
        """
        young, old = self.young, self.old
        known: dict[str, str] = {}
        runs, rest, long, ending = set(), set(), [], {}

        def sort(w: str) -> None:
            if w in old:
                known[w] = old[w]
            else:
                (runs if self.end and w.isalpha() else rest).add(w)

        for w in pieces:
            if len(w) > self.leaf:
                long.append(w)
            elif self.end and w not in old and (head := w.rstrip(MARKS)) != w and head.isalpha() and self.closes(head[-1]):
                ending[w] = head, w[len(head) :]
            else:
                sort(w)
        for p in {p for pair in ending.values() for p in pair}:
            if p not in young:
                sort(p)
        rest.update(self.encode_runs(list(runs), known))
        if rest:
            rest = list(rest)
            known.update(zip(rest, self.written([e.ids for e in self.own.encode_batch_fast(rest, add_special_tokens=False)]), strict=True))
        parts = {p: known[p] if p in known else young[p] for pair in ending.values() for p in pair}
        for w, (head, marks) in ending.items():
            (x, y), (u, v) = parts[head].split("\t"), parts[marks].split("\t")
            known[w] = f"{x} {u}\t{y} {v}"
        young.update(known)
        self.chars += sum(map(len, known)) + sum(map(len, known.values()))
        return known | dict(zip(long, self.written([tree_encoded(self.own, w, self.leaf).ids.tolist() for w in long]), strict=True))

    def encode_runs(self, pieces: list[str], known: dict[str, str]) -> list[str]:
        """Puts entries of pieces of letters into ``known``; returns those that are left."""
        chunks = [pieces[i : i + RUNS] for i in range(0, len(pieces), RUNS)]
        left = []
        for chunk, e in zip(chunks, self.own.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False), strict=True):
            ids = e.ids
            names, signs = ("".join([of[t] for t in ids]).split("\n")[:-1] for of in (self.run_names, self.run_signs))
            if len(names) == len(chunk):
                known.update(zip(chunk, map("\t".join, zip(names, signs, strict=True)), strict=True))
            else:
                left += chunk
        return left

    def closes(self, letter: str) -> bool:
        """Does a run of letters that ends in this one end before a mark? Not if it is
        taken apart into a letter and an accent.
        """
        if letter not in self.closing:
            tokens = lambda t: self.own.encode(t, add_special_tokens=False).ids
            self.closing[letter] = tokens(f"ab{letter}.") == tokens(f"ab{letter}") + tokens(".")
        return self.closing[letter]

    def written(self, ids: list[list[int]]) -> list[str]:
        """The entries of encodings."""
        names, signs = self.names, self.signs
        decoded = [" ".join([signs[t] for t in i]) for i in ids] if signs else self.own.decode_batch(ids, skip_special_tokens=False)
        return [" ".join([names[t] for t in i]) + "\t" + d if i else "" for i, d in zip(ids, decoded, strict=True)]


@lru_cache(maxsize=1)
def encoder(path: str, leaf: int) -> Encoder:
    """That of a Python worker: its cache serves the tasks to come."""
    return Encoder(path, leaf)


#: What waits to forget the encoder of this Python worker.
_waiting: list[threading.Timer] = []


@contextmanager
def lent_encoder(path: str, leaf: int) -> Iterator[Encoder]:
    """The encoder for one task. Spark keeps idle workers while other stages run, also
    those that need the memory and have no Python: so it is forgotten when none follows.
    """
    while _waiting:
        _waiting.pop().cancel()
    try:
        yield encoder(path, leaf)
    finally:
        timer = threading.Timer(IDLE_SECONDS, _forget)
        timer.daemon = True
        timer.start()
        _waiting.append(timer)


def _forget() -> None:
    encoder.cache_clear()
    tokenizer.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def _joined(texts: pa.Array, offsets: list | np.ndarray) -> pa.Array:
    """The texts from each offset to the next, with a space between."""
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, texts), pa.scalar(" ", pa.large_string()))


def _sums(of: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(of, dtype=np.int64)])


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


RESULT = "_hf_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SCHEMA = pa.schema([("_hf_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)


def bpe_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One row for each document: ``id_col``, n_tokens, ids_sha256 (of the decimal
    identifiers joined by a space) and decoded_sha256 (of the decoded text).
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lent_encoder(vocabulary, leaf_chars) as own:
            yield from encoded(own, batches)

    def encoded(own: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        texts: list[str] = []
        chars = 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((keys, *own.digests(texts)), SCHEMA.types, strict=True)], schema=SCHEMA)

        for key, text in _texts(batches):
            keys.append(key)
            texts.append(text or "")
            chars += len(texts[-1])
            if chars > BATCH_CHARS or len(keys) == 4096:
                yield done()
                keys, texts, chars = [], [], 0
        if keys:
            yield done()

    cut_schema = pa.schema([("_hf_key", pa.string()), ("_hf_id", pa.int64()), ("_hf_piece", pa.int32()), ("_hf_text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The key does not depend on the order of rows: a task that runs again cuts alike.
        seen: Counter = Counter()
        for key, text in _texts(batches):
            name = f"{key}-{hashlib.md5(text.encode()).hexdigest()}-{TaskContext.get().partitionId()}"
            seen[name] += 1
            for k in range(0, -(-len(text) // piece_chars)):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((f"{name}-{seen[name]}", key, k, text[k * piece_chars : (k + 1) * piece_chars]), cut_schema.types, strict=True)], schema=cut_schema)

    coded_schema = pa.schema([*cut_schema, ("_hf_ids", pa.binary()), ("_hf_starts", pa.binary()), ("_hf_ends", pa.binary())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                e = tree_encoded(own, row.column(3)[0].as_py(), leaf_chars)
                yield pa.RecordBatch.from_arrays([*row.columns, *(pa.array([x.tobytes()], pa.binary()) for x in (e.ids, e.starts, e.ends))], schema=coded_schema)

    def join(pieces: pd.DataFrame) -> pd.DataFrame:
        own = tokenizer(vocabulary)
        p = pieces.sort_values("_hf_piece")
        texts = p["_hf_text"].tolist()
        parts = [Encoded(np.frombuffer(a, np.int32), np.frombuffer(b, np.int64), np.frombuffer(c, np.int64), len(t)) for a, b, c, t in zip(p["_hf_ids"], p["_hf_starts"], p["_hf_ends"], texts, strict=True)]
        ids = tree_joined(own, texts, parts).ids.tolist()
        row = (p["_hf_id"].iloc[0], len(ids), _hex(" ".join(map(str, ids))), _hex(own.decode(ids, skip_special_tokens=False)))
        return pd.DataFrame([row], columns=SCHEMA.names).astype({"_hf_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("_hf_id"), F.col(text_col).alias("_hf_text"))
    long = F.coalesce(F.length("_hf_text") > piece_chars, F.lit(False))
    short = rows.filter(~long).mapInArrow(encode, RESULT)
    cuts = rows.filter(long).mapInArrow(cut, "_hf_key string, _hf_id long, _hf_piece int, _hf_text string")
    coded = cuts.repartition("_hf_key", "_hf_piece").mapInArrow(code, "_hf_key string, _hf_id long, _hf_piece int, _hf_text string, _hf_ids binary, _hf_starts binary, _hf_ends binary")
    return short.unionByName(coded.groupBy("_hf_key").applyInPandas(join, RESULT)).withColumnRenamed("_hf_id", id_col)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
