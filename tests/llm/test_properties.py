"""Properties of the worker-side pieces, on drawn inputs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from graniteloom.llm import near_duplicates, pieces, scans, spans, terms, words

TEXT = st.text(st.sampled_from("ab.!? \n\té한 "), max_size=400)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 60), st.integers(2, 30), st.booleans())
def test_ranges_do_not_matter(text, size, limit, table):
    """Boundary tables of any ranges give the plan of the whole text; pieces cover all words in order within the limit."""
    whole = [np.asarray(x, np.int64) for x in pieces.boundaries("", text, "")]
    cut = [pieces.boundaries(text[a - 1] if a else "", text[a : a + size], text[a + size : a + size + 1]) for a in range(0, len(text), size)] or [([0], [0])]
    parts = [np.concatenate([np.asarray(p[i], np.int64) for p in cut]) for i in (0, 1)]
    assert whole[0].sum() == parts[0].sum() == len(text.split())
    assert pieces.boundary(*whole, table, limit) == pieces.boundary(*parts, table, limit)
    how = pieces.Limits(limit, min(3, limit - 1))
    plan = pieces.plan(*parts, table, how)
    assert plan == pieces.plan(*whole, table, how)
    done = 0
    for a, b, _ in plan:
        assert a <= done < b and b - a <= limit and done - a <= (0 if table else how.overlap)
        done = b
    assert done == len(text.split())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=80), st.integers(1, 20))
def test_sliding_minimum(xs, w):
    v = np.array(xs, np.uint64)
    assert spans.sliding_min(v, w).tolist() == [min(xs[i : i + w]) for i in range(len(xs) - w + 1)]


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=60), st.integers(1, 12))
def test_window_hashes(t, k):
    """Equal windows have equal hashes, different ones different."""
    h = spans.window_hashes(np.frombuffer(t.encode("utf-32-le"), np.uint32), k, spans._B1)
    by = {}
    for i, x in enumerate(h.tolist()):
        assert by.setdefault(t[i : i + k], x) == x
    assert len(set(by.values())) == len(by)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 65535), max_size=200), min_size=1, max_size=5))
def test_bitmap_union(sets):
    u = terms.union([terms._one(np.array(sorted(s), np.int64)) for s in sets])
    assert terms.members(u).tolist() == sorted(set().union(*sets))


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_words(t):
    w = words.words(t)
    assert all(w) and (not w or len(w) == len(words._WORD.findall(t.translate(words._no_digit))))


@settings(max_examples=80, deadline=None)
@given(st.text("machinelud rwk", min_size=3, max_size=30), st.data())
def test_misread_lines_keep_their_skeleton(line, data):
    pairs = [(a, b) for a, b in scans.CONFUSIONS if len(a) == 1 and b in ("rn", "li", "ii", "cl", "vv", "ri", "lc", "c", "1", "0", "5", "@") and a in line and (a, b) != ("i", "1")]
    if pairs:
        a, b = data.draw(st.sampled_from(pairs))
        seen = line.replace(a, b, 1)
        assert scans.skeleton("x" + seen + "x") == scans.skeleton("x" + line + "x") or b == "c"


def test_signatures_agree_as_often_as_sets_overlap():
    r = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.9):
        hits = []
        for _ in range(40):
            n = 60
            common = r.integers(0, 2**63, int(round(2 * n * share / (1 + share)))).astype(np.uint64)
            a, b = (np.concatenate([common, r.integers(0, 2**63, n - len(common)).astype(np.uint64)]) for _ in range(2))
            sig = near_duplicates._densified(np.repeat([0, 1], n), np.concatenate([a, b]), 2, 192)
            hits.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(hits) - share) < 0.06
