import re

import numpy as np
import pyarrow as pa

from echoless.llm.words import ALPHANUMERIC, SPACES, byte_powers, gram_hashes, slices, word_powers

TEXTS = ["a b", None, "", "  x\ty\n", "Ünë dœux trois, 4", "b", "A-b c'd", "z" * 50, "a b"]


def test_words_are_those_of_the_patterns():
    for inside, lower, pattern in ((SPACES, False, r"[^\x20\x09-\x0D]+"), (ALPHANUMERIC, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for limit in (1, 20, 1 << 20):
            found = []
            for part in slices(pa.array(TEXTS), inside, lower, limit):
                words = [part.word(i).decode() for i in range(len(part.starts))]
                found += [words[a:b] for a, b in zip(part.first, part.first[1:])]
            fold = str.maketrans({i: i + 32 for i in range(65, 91)}) if lower else {}
            assert found == [re.findall(pattern, (t or "").translate(fold)) for t in TEXTS]


def test_equal_words_and_runs_hash_alike_and_others_do_not():
    part = next(slices(pa.array(["a b c a b", "x a b c", "ab c"]), SPACES))
    h = part.hashes(byte_powers())
    words = [part.word(i) for i in range(len(h))]
    assert len(set(h.tolist())) == len(set(words)) and all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(h)) for j in range(len(h)))
    grams = gram_hashes(h, 2, word_powers())
    assert grams[0] == grams[3] == grams[6] and len(set(grams.tolist())) == len(set(zip(words, words[1:])))
    assert len(gram_hashes(h, 50, word_powers())) == 0 and grams.dtype == np.uint64


def test_a_sliced_column_is_read_from_its_own_start():
    texts = pa.array(["skip me", "a b", "c"]).slice(1)
    part = next(slices(texts, SPACES))
    assert [part.word(i) for i in range(3)] == [b"a", b"b", b"c"]
