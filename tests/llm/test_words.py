import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import suffix_array
from newsloom.llm.text_arrays import alnum_table, shingle_sets, slices, space_table, span_hashes, utf8, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ é1\n\t\x0b.漢", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    for table, pattern in ((space_table(), r"[^\x20\x09-\x0D]+"), (alnum_table(), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        data, offsets = utf8(pa.array(texts, pa.string()))
        got = []
        for a, b in slices(offsets, 16):
            w = words(data, offsets[a : b + 1], table)
            for d in range(b - a):
                got.append([w.data[w.starts[i] : w.ends[i]].tobytes().decode().translate(LOW) for i in range(w.first[d], w.first[d + 1])])
        assert got == [re.findall(pattern, (t or "").translate(LOW)) for t in texts]


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_shingle_sets_agree_with_sets_of_tuples(texts):
    data, offsets = utf8(pa.array(texts, pa.string()))
    w = words(data, offsets, space_table())
    flat, bounds = shingle_sets(w, span_hashes(w), 3)
    own = [set(flat[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    plain = []
    for t in texts:
        x = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        plain.append({tuple(x[i : i + 3]) for i in range(len(x) - 2)} if len(x) >= 3 else ({tuple(x)} if x else set()))
    for i in range(len(texts)):
        assert len(own[i]) == len(plain[i])
        for j in range(i):
            assert len(own[i] & own[j]) == len(plain[i] & plain[j])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 6), st.sampled_from([1, 512]))
def test_suffix_array_and_common_prefixes(symbols, times, mean):
    text = np.tile(np.array(symbols, np.uint8), times)
    kept, suffix_array.MEAN_BUCKET = suffix_array.MEAN_BUCKET, mean
    try:
        order = suffix_array.suffix_array(text, 4)
    finally:
        suffix_array.MEAN_BUCKET = kept
    raw = text.tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    common = suffix_array.permuted_lcp(text, order, 12)
    for i, j in zip(order[:-1], order[1:], strict=True):
        n = 0
        while max(i, j) + n < len(raw) and raw[i + n] == raw[j + n]:
            n += 1
        assert min(common[j], 12) == min(n, 12)
