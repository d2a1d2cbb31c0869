import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from clauselake.llm import scan

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def random_texts(seed, n=200):
    r = random.Random(seed)
    alphabet = ["a", "B", "é", "日", " ", "  ", "\n", "\t", "\x0b", "\x1f", "x" * 9, "Q" * 300, " "]
    return ["".join(r.choices(alphabet, k=r.randint(0, 30))) for _ in range(n)] + [None, "", " ", "end"]


@pytest.mark.parametrize("lower", [False, True])
def test_words_are_those_of_the_pattern(lower):
    texts = random_texts(1)
    for array in (pa.array(texts), pa.array([None, "skip", *texts]).slice(2)):
        w = scan.scan(array, lower=lower)
        raw = w.buf.tobytes()
        seen = {}
        for i, t in enumerate(texts):
            want = WORD.findall((t or "").encode())
            if lower:
                want = [bytes(c | 32 if 65 <= c <= 90 else c for c in x) for x in want]
            got = [raw[a:b] for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]])]
            assert got == want
            for word, h in zip(got, w.hash[w.first[i] : w.first[i + 1]].tolist()):
                assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


def test_window_hashes_tell_all_arrangements_apart():
    h = scan.scan(pa.array(["a b c"])).hash
    for k in (3, 5, 7):
        rows = np.array(list(itertools.product(range(3), repeat=k)))
        got = {int(scan.windows(h[row], k)[0]) for row in rows}
        assert len(got) == 3**k


def test_slices_cover_all_rows():
    texts = pa.array(["x" * n if n else None for n in (0, 5, 100, 0, 7, 3, 0, 50)])
    parts = list(scan.slices(texts, 10))
    assert [i for a, b in parts for i in range(a, b)] == list(range(8))
    assert list(scan.slices(texts.slice(0, 0))) == []
