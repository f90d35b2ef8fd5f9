"""Near-duplicate components on families of copies with a spread of edits, against brute force."""

import random

from codefacts.llm.minhash import near_duplicates


def family_texts():
    r = random.Random(3)
    words, out = [f"w{j}" for j in range(3000)], []
    for n in (400, 60, 8):
        base = [r.choice(words) for _ in range(160)]
        for _ in range(n):
            own = list(base)
            for _ in range(r.randrange(9)):
                own[r.randrange(len(own))] = r.choice(words)
            out.append(" ".join(own))
    passage = [r.choice(words) for _ in range(60)]
    out += [" ".join(passage + [r.choice(words) for _ in range(r.choice([20, 40, 100]))]) for _ in range(300)]
    r.shuffle(out)
    return list(enumerate(out))


def test_families(spark):
    docs = family_texts()
    sets = {k: frozenset(zip(*[t.split()[j:] for j in range(5)], strict=False)) for k, t in docs}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and find(a) != find(b):
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: find(k) for k in sets}
