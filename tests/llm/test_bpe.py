import json
import random
import time

import public_tokenizers
import pytest

from helixframe.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
BITS = [".", ",", "A", "Be", "...", "é.", "1.", "<|", "<|ENDOFTEXT|>", "ab", "é", "'s", "'", "!!", "12", " ", "\n", "<|endoftext|>", "ing", "tion", "́", "ﬁ", "漢", "字", "Σ", "İ", "\x1c", " ", "th", "e"]


def want(text):
    own = bpe.tokenizer(PATH)
    ids = own.encode(text, add_special_tokens=False).ids
    return len(ids), bpe._hex(" ".join(map(str, ids))), bpe._hex(own.decode(ids, skip_special_tokens=False))


def texts(seed, n, size):
    rnd = random.Random(seed)
    for k in range(n):
        some = BITS if k % 2 else [b for b in BITS if b not in (" ", "\n", " ")]
        yield "".join(rnd.choice(some) for _ in range(rnd.randint(0, size)))


def test_tree_equals_library():
    rnd = random.Random(1)
    own = bpe.tokenizer(PATH)
    for t in texts(1, 300, 700):
        assert bpe.tree_encoded(own, t, rnd.choice([40, 100, 300])).ids.tolist() == own.encode(t, add_special_tokens=False).ids


def test_encoder_equals_library(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    e = bpe.Encoder(PATH, leaf=50)
    for t in texts(2, 600, 120):
        assert e.digest(t) == want(t)


@pytest.mark.parametrize("piece", [bpe.PIECE_CHARS, 200])
def test_documents(spark, docs, piece):
    rows = [(i, t) for i, t in enumerate(texts(3, 40, 400))] + [(100, None), (101, ""), (102, "x" * 70_000), (103, "long words " * 4_000), (3, "again"), (103, "long words " * 4_000), (None, "no id " * 100)]
    got = bpe.bpe_digests(docs(rows, ["n_tokens", "score"]), PATH, leaf_chars=100, piece_chars=piece).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=str) == sorted(((i, *want(t or "")) for i, t in rows), key=str)
    assert bpe.bpe_digests(docs([]), PATH).count() == 0


def test_letters_that_come_apart_before_a_mark():
    e = bpe.Encoder(PATH)
    for c in "יִक़ড়ଢ଼གྷİé":  # all but the last become a letter and an accent
        for t in (f"x{c}.", f"{c},", f"a{c}!? {c}... ab{c}", f"{c}b.", f"A{c}. the ofand"):
            assert e.digest(t) == want(t)


class Counted:
    """A tokenizer that counts what it is given."""

    def __init__(self, own):
        self.own, self.inputs = own, 0

    def __getattr__(self, name):
        return getattr(self.own, name)

    def encode_batch_fast(self, texts, **options):
        self.inputs += len(texts)
        return self.own.encode_batch_fast(texts, **options)


def test_new_words_are_encoded_together():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(5, 12))) + rnd.choice(["", ".", ",", "!!", ".***"]) for _ in range(4_000)]
    e = bpe.Encoder(PATH)
    e.own = Counted(e.own)
    assert e.digest(" ".join(words)) == want(" ".join(words))
    assert e.own.inputs < 20


def test_texts_together_equal_library(monkeypatch):
    monkeypatch.setattr(bpe, "RUNS", 7)
    monkeypatch.setattr(bpe, "CACHE_CHARS", 5_000)
    e = bpe.Encoder(PATH, leaf=50)
    rnd = random.Random(5)
    more = [*BITS, "יִ", "क़.", "***", "don't", "<|endoftext", "|>", "\t", "\x85", "　", "_", "ǅ", "Ᲊ", "\U000323b0", "가", "가"]
    for _ in range(60):
        some = ["".join(rnd.choice(more) for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(1, 12))]
        assert list(zip(*e.digests(some), strict=True)) == [want(t) for t in some]
    assert sum(map(len, e.young)) < 10_000


def test_other_vocabulary(tmp_path):
    made = json.loads(open(PATH).read())
    made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\p{L}+\.?|[^\s\p{L}]"  # letters and a mark are one
    (tmp_path / "other.json").write_text(json.dumps(made))
    e = bpe.Encoder(str(tmp_path / "other.json"))
    own = bpe.tokenizer(str(tmp_path / "other.json"))
    for t in texts(6, 100, 80):
        ids = own.encode(t, add_special_tokens=False).ids
        assert e.digest(t)[:2] == (len(ids), bpe._hex(" ".join(map(str, ids))))


def test_idle_worker_forgets(monkeypatch):
    """The encoder serves the tasks that follow, and is not kept while none does."""
    monkeypatch.setattr(bpe, "IDLE_SECONDS", 0.5)
    bpe.encoder.cache_clear()
    with bpe.lent_encoder(PATH, bpe.LEAF_CHARS) as own:
        time.sleep(1)
    with bpe.lent_encoder(PATH, bpe.LEAF_CHARS) as again:
        time.sleep(1)  # what waited after the first task does not disturb the second
        assert again is own and bpe.encoder.cache_info().currsize == 1
    time.sleep(1.5)
    assert bpe.encoder.cache_info().currsize == 0 and bpe.tokenizer.cache_info().currsize == 0
