"""Word splitting and hashing from Arrow buffers, against Python's own splitting; small pieces stand for very long texts."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkcube.llm import _text, line_dedup

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\x85 XYZ", max_size=60)), max_size=12)


def _split(texts, fold=False):
    out = []
    for t in texts:
        raw = (t or "").encode()
        out.append((bytes(_text.FOLD[np.frombuffer(raw, np.uint8)]) if fold else raw).split())
    return out


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([3, 7, 1 << 21]), st.booleans())
def test_words(texts, piece, fold):
    old, _text.PIECE = _text.PIECE, piece
    try:
        data, at = _text.buffers(pa.array(texts, pa.string()))
        h, s, e, to = _text.hashed(data, at, _text.SPACED, fold)
    finally:
        _text.PIECE = old
    want = _split(texts, fold)
    assert np.diff(to).tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    folded = _text.FOLD[data] if fold else data
    assert [bytes(folded[a:b]) for a, b in zip(s, e)] == flat
    seen = {}
    for w, x in zip(flat, h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_windows(texts, k):
    data, at = _text.buffers(pa.array(texts, pa.string()))
    h, _, _, to = _text.hashed(data, at)
    w, _, wat = _text.windows(h, to, k)
    want = [[tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else [] for ws in _split(texts)]
    assert np.diff(wat).tolist() == [len(x) for x in want]
    seen = {}
    for g, x in zip([g for x in want for g in x], w.tolist()):
        assert seen.setdefault(g, x) == x
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=40), max_size=8), st.integers(1, 4), st.sampled_from([1, 3, 1 << 62]))
def test_codes_are_exact_whatever_the_hash(texts, k, kinds):
    data, at = _text.buffers(pa.array(texts, pa.string()))
    h, s, e, to = _text.hashed(data, at)
    codes = _text.word_codes(data, s, e, h % np.uint64(kinds))  # few kinds: nearly all hashes collide
    flat = [w for ws in _split(texts) for w in ws]
    assert len(set(zip(flat, codes.tolist()))) == len(set(flat)) == len(set(codes.tolist()))
    got, wat = _text.window_codes(codes, to, k)
    want = [tuple(ws[i : i + k]) for ws in _split(texts) for i in (range(max(1, len(ws) - k + 1)) if ws else [])]
    assert len(set(zip(want, got.tolist()))) == len(set(want)) == len(set(got.tolist())) and wat[-1] == len(want)


def test_slices_and_offsets():
    batch = pa.RecordBatch.from_pydict({"text": ["aa", None, "b" * 50, "", "c c"]}).slice(1, 4)
    parts = list(_text.slices(batch, "text", 10))
    assert [x for p in parts for x in p.column("text").to_pylist()] == [None, "b" * 50, "", "c c"]
    assert _text.hashed(*_text.buffers(parts[-1].column("text")))[3][-1] == 2
    assert list(_text.slices(batch.slice(0, 0), "text")) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.lists(st.integers(0, 3), min_size=1, max_size=9))
def test_equal_variants_mean_one_edit(a, b):
    """Lines share a variant as _earliest() uses it exactly if they are a word edit apart, and then the sieve lets them meet."""
    rng = np.random.default_rng(0)
    word = rng.integers(0, 1 << 63, (2, 4), dtype=np.uint64)
    lanes = tuple(np.concatenate([w[a], w[b]]) for w in word)
    spans = [(0, len(a)), (len(a), len(b))]
    s = line_dedup._Sequences(lanes, *(np.array(x) for x in zip(*spans)))
    full = [[int(s.of(np.array([lo]), np.array([n]), k)[0]) for k in (0, 1)] for lo, n in spans]
    less = [[[int(s.without(np.array([lo]), np.array([n]), np.array([i]), k)[0]) for k in (0, 1)] for i in range(n)] for lo, n in spans]
    same = full[0] == full[1]
    near = any(x == y for x, y in zip(*less)) and len(a) == len(b) or full[0] in less[1] or full[1] in less[0]
    assert same == (a == b)
    substituted = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= 1
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    removed = len(longer) == len(shorter) + 1 and any(longer[:i] + longer[i + 1 :] == shorter for i in range(len(longer)))
    assert near == (substituted or removed)
    assert line_dedup.edits([b"%d" % x for x in a], [b"%d" % x for x in b]) == (0 if a == b else 1 if near else 2)
    if near:
        k = min(len(a), len(b)) // 2
        assert a[:k] == b[:k] or a[len(a) - k :] == b[len(b) - k :]
        first, last = ([int(f(np.array([x]), np.array([k]))[0]) for x in y] for f, y in ((s.of, (0, len(a))), (s.last, (len(a), len(a) + len(b)))))
        assert (first[0] == first[1]) == (a[:k] == b[:k]) and (last[0] == last[1]) == (a[len(a) - k :] == b[len(b) - k :])
