import random

import numpy as np

from riskgrid.llm.suffixarray import permuted_lcp, repeats, suffix_array


def brute_sa(s):
    return sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_array_and_common_prefixes():
    rng = random.Random(1)
    for k in range(400):
        n, sigma = rng.randrange(1, 120), rng.choice([1, 2, 3, 20, 200, 3000])
        s = [rng.randrange(1, sigma + 1) for _ in range(n)] + [0]
        if k % 5 == 0:
            s = (s[:-1] * 3) + [0]
        x = np.array(s)
        sa = suffix_array(x, max(s) + 1)
        assert sa.tolist() == brute_sa(s)
        plcp, phi = permuted_lcp(x.astype(np.uint16), sa, 10)
        for r in range(1, len(s)):
            i, j = int(sa[r]), int(sa[r - 1])
            m = 0
            while max(i, j) + m < len(s) and s[i + m] == s[j + m]:
                m += 1
            assert phi[i] == j and plcp[i] == m


def test_repeats():
    rng = random.Random(2)
    for _ in range(100):
        common = bytes(rng.randrange(4) for _ in range(40))
        pieces = []
        for _ in range(rng.randrange(1, 8)):
            p = bytes(rng.randrange(256) for _ in range(rng.randrange(0, 30)))
            pieces.append(p + common[rng.randrange(20):rng.randrange(20, 41)] + p[:5] + b"\0\0")
        span = rng.randrange(2, 15)
        seen = {}
        for p in pieces:
            for i in range(len(p) - span + 1):
                seen[p[i:i + span]] = seen.get(p[i:i + span], 0) + 1
        want = [[i + span <= len(p) and seen[p[i:i + span]] > 1 for i in range(len(p))] for p in pieces]
        assert [r.tolist() for r in repeats(pieces, span)] == want
