import hashlib
import itertools
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clauselake.llm import bpe_stream, token_counts

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))

TEXTS = [
    "", " ", "\n\n  x\t", "Hello world's  it'll don't 'twas '' 's ''s", "1234567 12a ½ ² ٣", "日本語テキスト mixed with English",
    "<|endoftext|> a<|endoftext|>b <|startoftext|>C<|startoftext|>", "ÀÉÎ é Å İ ΟΔΟΣ ΣΑΣ Straße ǅ", "a" * 5000,
    "ab" * 3000, "​ 　\u0085 \x1c\x1d x\x1ey", "😀👍🏽 e️‍", "%%% ### &&&*** !!??", "the" * 900 + "s", "\x00\x01\x7f",
    "x" + "́" * 50, "१२३ ௧ Ⅷ ⅷ ㈠", "don’t ‘quoted’ — dash…", "q " * 4000,
]


def random_texts(seed, n=150):
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzeeeeaaattthhhiinnoossrr"
    out = []
    for _ in range(n):
        out.append("".join(r.choice([r.choice(letters), r.choice(letters).upper(), " ", "\n", "'", r.choice("éßñ日本ΩΣ0123456789.,!<|>")])
                           if r.random() < 0.5 else "".join(r.choices(letters, k=r.randint(1, 12))) for _ in range(r.randint(0, 80))))
    out += ["".join(r.choices(letters, k=4000)) for _ in range(3)]
    return out


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(TEXTS + random_texts(5))) + [(9998, None), (9999, "same"), (9999, "same")]


def test_counts_equal_the_library(spark, rows):
    lib = Tokenizer.from_file(BYTES)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, token_counts.count_tokens(df, BYTES).collect()))
    want = []
    for i, t in rows:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want)
    assert token_counts.count_tokens(df.limit(0), BYTES).count() == 0


def test_coding_equals_the_library(spark, rows):
    lib = Tokenizer.from_file(WORDS)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    got = sorted(map(tuple, bpe_stream.code_digests(df, WORDS).collect()))
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe_stream.code_digests(df.limit(0), WORDS).count() == 0


def test_encoded_texts_decode(spark):
    df = spark.createDataFrame([(1, "Hello  wörld!"), (2, None), (3, "")], "doc_id long, text string")
    back = bpe_stream.decode(bpe_stream.encode(df, WORDS), WORDS, raw=False)
    assert {r.doc_id: r.text for r in back.collect()} == {1: "hello wörld ! ", 2: None, 3: ""}


def test_lookahead_settles_tokens():
    """Every short alphabet string: tokens emitted early are those of the whole."""
    r = random.Random(2)
    for trial in range(60):
        known, merges = ["a", "b", "c"], []
        for _ in range(r.randint(2, 9)):
            pair = (r.choice(known), r.choice(known))
            if "".join(pair) not in known:
                merges.append(pair)
                known.append("".join(pair))
        ranks = {m: i for i, m in enumerate(merges)}
        ahead = bpe_stream.lookahead(merges)
        for _ in range(40):
            text = r.choices("abc", k=r.randint(1, 60))
            machine = bpe_stream.WordTransducer(ranks, ahead)
            out = list(itertools.chain.from_iterable(machine.feed([c]) for c in text))
            out += machine.finish()
            assert out == bpe_stream.merge(text[:-1] + [text[-1] + "</w>"], ranks)
            assert max(map(len, [machine.held])) <= ahead + 1


def test_long_words_hold_little_and_equal_the_library():
    lib = Tokenizer.from_file(WORDS)
    v = bpe_stream.Vocabulary(WORDS)
    print("lookahead", v.lookahead)
    r = random.Random(4)
    for _ in range(4):
        word = "".join(r.choices("etaoinshrdlu", k=6000))
        machine, out, most = bpe_stream.WordTransducer(v.ranks, v.lookahead), [], 0
        for i in range(0, len(word), 64):
            out += machine.feed([v.chars[b] for b in word[i : i + 64].encode()])
            most = max(most, len(machine.held))
        out += machine.finish()
        assert [v.ids[t] for t in out] == lib.encode(word, add_special_tokens=False).ids
        assert most <= v.lookahead + 64 + 32


def test_long_pre_tokens_equal_the_library_in_seconds(monkeypatch):
    import random
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    from clauselake.llm import token_counts as tc

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, counter = Tokenizer.from_file(path), tc.TextCounter(path)
    r = random.Random(8)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)), "a" * 100_001, "ab" * 50_000, "the" * 40_000 + "!" * 3_000 + "é" * 5_000,
             " " * 5_000 + "x", "".join(r.choices("aab", k=30_000)), "0123456789" * 900]
    began = time.time()
    assert counter(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert time.time() - began < 60
    began = time.time()
    counter(["".join(r.choices("etaoinshrdlu", k=1_000_000))])
    assert time.time() - began < 60
    monkeypatch.setattr(tc, "LONG", 0)  # every pre-token
    words = [("".join(r.choices("abcdeé ", k=r.randrange(40))) + r.choice(["", "ing", "tion"])) for _ in range(400)]
    assert tc.TextCounter(path)(words) == [len(lib.encode(t, add_special_tokens=False).ids) for t in words]


def test_every_word_passes_the_transducer_and_long_ones_leave_it_in_parts(monkeypatch):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from clauselake.llm import bpe_stream as bs

    path = public_tokenizers.path("word_bpe_49k.json")
    vocabulary, lib = bs.Vocabulary(path), Tokenizer.from_file(path)
    fed = []
    plain = bs.WordTransducer.feed
    monkeypatch.setattr(bs.WordTransducer, "feed", lambda self, parts: fed.append(len(parts)) or plain(self, parts))
    r = random.Random(3)
    for block in (1, 7, 64, bs.BLOCK):
        encode = bs.Encoder(vocabulary, block)
        for n in (1, 2, 6, 63, 64, 65, 700, 730, 1100, 1800, 5000):
            if n > 2000 and block < 64:
                continue
            text = "x " + "".join(r.choices("etaonéß", k=n)) + " y"
            fed.clear()
            parts = list(encode(text))
            want = lib.encode(text, add_special_tokens=False).ids
            assert [i for p in parts for i in struct.unpack(f"<{len(p) // 4}I", p)] == want
            assert sum(fed) >= n and max(fed) <= 2 * block
    assert max(map(len, encode("".join(r.choices("etaoin", k=50_000))))) < 4 * 2048
