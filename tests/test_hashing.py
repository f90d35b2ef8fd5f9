"""The exact text hash against a scalar form of it, and the golden name."""

import random

import numpy as np
from pyspark.sql import functions as F

from codefacts.functions import hashing, symbols

MASK = 2**64 - 1


def scalar(text: bytes) -> int:
    s = [int(x) for x in hashing.SECRET]
    number = lambda i, n: int.from_bytes(text[i : i + n], "little")
    fold = lambda a, b: (a * b & MASK) ^ (a * b >> 64)
    n, seed = len(text), fold(s[0], s[1])
    if n > 16:
        at, left = 0, n
        if left > 48:
            lanes = [seed] * 3
            while left > 48:
                lanes = [fold(number(at + 16 * i, 8) ^ s[i + 1], number(at + 16 * i + 8, 8) ^ lane) for i, lane in enumerate(lanes)]
                at, left = at + 48, left - 48
            seed = lanes[0] ^ lanes[1] ^ lanes[2]
        while left > 16:
            seed, at, left = fold(number(at, 8) ^ s[1], number(at + 8, 8) ^ seed), at + 16, left - 16
        a, b = number(n - 16, 8), number(n - 8, 8)
    elif n >= 4:
        step = n // 8 * 4
        a, b = number(0, 4) << 32 | number(step, 4), number(n - 4, 4) << 32 | number(n - 4 - step, 4)
    else:
        a, b = (text[0] << 16 | text[n // 2] << 8 | text[n - 1] if n else 0), 0
    product = (a ^ s[1]) * (b ^ seed)
    return fold((product & MASK) ^ s[0] ^ n, (product >> 64) ^ s[1])


def test_every_length():
    rng = random.Random(1)
    texts = [rng.randbytes(n) for n in [*range(0, 200), 1000, 4096, 48 * 7, 48 * 7 + 16]]
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = hashing.text_hashes(data, np.cumsum([0, *map(len, texts)]))
    assert got.tolist() == [scalar(t) for t in texts]
    assert hashing.text_hashes(np.zeros(0, np.uint8), np.zeros(1, np.int64)).tolist() == []


def test_names_of_other_tools(spark):
    table = spark.createDataFrame([("types.cc", 0), ("é" * 40, 1), ("", 2), (None, 3)], "path string, n int")
    name = symbols.anonymous_type(F.col("path"), F.col("n"), F.lit(True), hashing.exact_hash)
    got = [r[0] for r in table.orderBy("n").select(name).collect()]
    assert got == ["$anonymous_type_9a8b4e83cf46cb05_0", f"$anonymous_type_{scalar(('é' * 40).encode()):x}_1", f"$anonymous_type_{scalar(b''):x}_2", None]
