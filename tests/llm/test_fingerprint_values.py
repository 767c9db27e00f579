"""I-Match fingerprints against a direct computation over the whole table."""

import hashlib
import math
import re
from collections import Counter

import pytest
import xxhash

from lagspace.llm import fingerprints

SHARES = [4] * 6 + [16] * 6 + [64] * 6 + [256] * 6


def terms(text):
    return {t for t in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower(), flags=re.ASCII) if t}


def kept(term, i, share):
    seed = xxhash.xxh64_intdigest(term.encode(), seed=42)
    h = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=seed)
    return (h - (1 << 64) * (h >> 63)) % share == 0


def fingerprint(text, lexicon):
    found = sorted(terms(text) & lexicon)
    if not found:
        return "all:" + hashlib.md5(" ".join(sorted(terms(text))).encode()).hexdigest()
    parts = [" ".join(t for t in found if kept(t, i, share)) for i, share in enumerate(SHARES)]
    return "-".join(p and f"{xxhash.xxh64_intdigest(p.encode(), seed=42):x}"[:8] for p in parts)


def likeness(a, b):
    if a == b:
        return 1.0
    pairs = [(x, y) for x, y in zip(a.split("-"), b.split("-")) if x or y]
    if a.startswith("all:") or b.startswith("all:") or not pairs:
        return 0.0
    return sum(x == y for x, y in pairs) / len(pairs)


def test_fingerprints_of_the_whole_table(docs, texts):
    ids = sorted(texts)
    df = Counter(t for i in ids for t in terms(texts[i]))
    low, high = max(2, math.ceil(0.004 * len(ids))), max(2, math.floor(0.05 * len(ids)))
    lexicon = {t for t, n in df.items() if low <= n <= high}
    assert len(lexicon) > 100
    got = {r.doc_id: r for r in fingerprints.fingerprinted(docs).collect()}
    assert sorted(got) == ids
    own = {i: fingerprint(texts[i], lexicon) for i in ids}
    for i, after in zip(ids, [*ids[1:], ids[0]]):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[after][:half]
        want = fingerprint(edited, lexicon)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (own[i], want)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].near_edited, got[i].near_next) == pytest.approx((likeness(own[i], want), likeness(own[i], own[after])))
