"""Golay keys and bounds of long SimHash fingerprints at the similarity of the near-duplicate stage."""

import numpy as np

from tidemark.llm import near, simhash


def pairs(n, size, own, seed):
    """n pairs of sets of size + own shingles that have size in common."""
    draw = np.random.default_rng(seed)
    for _ in range(n):
        both = draw.integers(0, 2**63, size).astype(np.uint64)
        yield tuple(np.concatenate([both, draw.integers(0, 2**63, own).astype(np.uint64)]) for _ in range(2))


def bounds(sets):
    return np.concatenate([[0], np.cumsum([len(x) for x in sets])])


def test_stage_takes_its_candidates_from_golay_keys():
    """Texts at 0.8 share a key of codewords; unrelated ones don't. The stage's keys are those of the SimHash operator."""
    assert near.likely_keys is simhash.likely_keys
    sets = [x for pair in pairs(1000, 160, 20, 1) for x in pair]  # 160 of 200: 0.8
    rows, keys = near.bands(np.concatenate(sets), bounds(sets))
    assert len(rows) == 2000 and keys.shape[1] == near.BANDS * near.KEYS
    shared = [len(np.intersect1d(a, b)) > 0 for a, b in zip(keys[::2], keys[1::2], strict=True)]
    assert np.mean(shared) > 0.998
    assert not any(len(np.intersect1d(a, b)) for a, b in zip(keys[::2], keys[3::2], strict=False))


def test_keys_are_pairs_of_codewords_near_the_segments():
    """The first codeword of an unanimous vote is the segment's own, by the tables that simhash decodes with."""
    words = np.random.default_rng(2).integers(0, 1 << 23, 50).astype(np.int32)
    signs = (2 * ((words[:, None] >> np.arange(23)) & 1) - 1).reshape(-1, 1, 23).repeat(3, axis=1).reshape(50, 69)
    keys = simhash.likely_keys(signs, 1, 1)[:, 0, 0]
    own = simhash.codeword(words).astype(np.int64)
    code = [simhash._codewords()[:, c >> 1] * (1 - 2 * (c & 1)) for c in (keys & 0xFFF)]
    assert [simhash.codeword(np.array([int(((c > 0) @ (1 << np.arange(23))))], dtype=np.int32))[0] for c in code] == own.tolist()


def test_votes_are_those_of_single_bits():
    x = np.random.default_rng(3).integers(0, 2**63, 1300).astype(np.uint64)
    got = simhash.votes(x, np.array([0, 1, 700, 1300]), 2)
    for k in range(2):
        drawn = simhash.mix(x ^ simhash.mix(np.array([simhash.SEED + 1 + k], dtype=np.uint64)))
        for row, part in enumerate((drawn[:1], drawn[1:700], drawn[700:])):
            single = [2 * int(((part >> np.uint64(b)) & np.uint64(1)).sum()) - len(part) for b in range(64)]
            assert sorted(single) == sorted(got[row, 64 * k : 64 * k + 64].tolist())


def test_fingerprints_rule_out_no_linked_pair():
    for size, own in ((57, 7), (160, 20), (1600, 200)):
        a, b = (np.stack([np.frombuffer(near.long_print(p[k]), dtype=np.uint64) for p in pairs(200, size, own, size)]) for k in (0, 1))
        n = np.full(200, size + own)
        assert near.in_reach(a, n, b, n, 0.8).all()
        assert not near.in_reach(a[1:], n[1:], b[:-1], n[1:], 0.8).any()
    # as unequal as 0.8 allows
    whole = [x for x, _ in pairs(200, 400, 100, 9)]
    a, b = (np.stack([np.frombuffer(near.long_print(x), dtype=np.uint64) for x in side]) for side in (whole, [x[:400] for x in whole]))
    assert near.in_reach(a, np.full(200, 500), b, np.full(200, 400), 0.8).all()
