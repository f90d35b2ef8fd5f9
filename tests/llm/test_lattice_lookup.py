"""The lookup of spans among the pieces of a lattice."""

import numpy as np

from codefacts.llm import lattice_lm


def test_only_spans_in_used_slots_are_compared():
    rng = np.random.default_rng(5)
    pieces = ["▁", *sorted({"".join(rng.choice(list("abcd"), rng.integers(1, 6))) for _ in range(300)})]
    own = lattice_lm.Lattice(pieces)
    spans = ["".join(rng.choice(list("abcde"), 3)) for _ in range(2000)]
    raw = np.array([sum((ord(c) + 1) * pow(int(lattice_lm._BASE), len(s) - 1 - i, 1 << 64) for i, c in enumerate(s)) % (1 << 64) for s in spans], np.uint64)
    rows, ids = own._find(raw, 3)
    assert dict(zip(rows.tolist(), ids.tolist(), strict=True)) == {i: pieces.index(s) for i, s in enumerate(spans) if s in pieces} and (np.diff(rows) > 0).all()
    assert own.used.sum() <= len(pieces) and all(own.used[k >> np.uint64(64 - own.slot_bits)] for k in own.keys)
