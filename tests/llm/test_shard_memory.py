"""A shard's suffix array and common prefixes fit the memory that an executor's task has, and find what they should."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard

from auditlake.llm.suffix_dedup import _shard, remove_repeats, shard_windows


def test_bytes_of_memory_a_byte_of_text():
    rng = np.random.default_rng(1)
    base = b" ".join(b"w%d" % i for i in rng.integers(0, 3000, 60000))
    texts = [base[a : a + int(n)] for a, n in zip(rng.integers(0, len(base) - 3000, 600), rng.integers(400, 3000, 600))]
    size = sum(map(len, texts))
    tracemalloc.start()
    shard_windows(texts, np.array([len(t) - 399 for t in texts]), np.ones(len(texts), np.int64), 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * size  # 103 bytes a byte of text before


def test_a_shard_of_many_anchors_takes_the_memory_of_a_few():
    rng = np.random.default_rng(2)
    base = b" ".join(b"w%d" % i for i in rng.integers(0, 3000, 200000))
    z = zstandard.ZstdCompressor(level=1)
    # 3 MB, as the shards of 0.51 GB have: 20 contexts of each of 150 anchors, which share windows with each other only
    begin = np.repeat(np.arange(150) * 2500, 20) + rng.integers(0, 600, 3000)
    n = rng.integers(300, 900, 3000)
    table = pa.table(
        {
            "shard": np.zeros(3000, np.int64), "anchor": np.repeat(rng.permutation(150), 20), "ctx": np.arange(3000), "low": begin, "n": n,
            "m": np.ones(3000, np.int64), "hot": np.zeros(3000, bool), "z": pa.array([z.compress(base[a : a + k + 399]) for a, k in zip(begin, n)], pa.binary()),
        }
    ).take(rng.permutation(3000))
    tracemalloc.start()
    found = _shard(table, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    by = [(x, "ascending") for x in ("anchor", "ctx", "a", "b")]
    assert found.sort_by(by) == _shard(table, 400, most=1 << 40).sort_by(by)  # all anchors sorted together
    assert found.num_rows > 2000
    assert peak < 20 * int((n + 399).sum())  # 62 bytes a byte of text before


def test_windows_of_texts_that_part_behind_512_bytes():
    # beyond 512 bytes suffixes were left unsorted, and some of their windows taken for repeated ones
    rng = np.random.default_rng(3)
    for _ in range(60):
        base, other = (rng.integers(97, 100, 2000).astype(np.uint8).tobytes() for _ in range(2))
        texts = []
        for _ in range(20):
            a, n = int(rng.integers(0, 300)), int(rng.integers(420, 736))
            cut = int(rng.integers(400, n + 1))
            texts.append(base[a : a + cut] + other[a : a + n - cut])
        starts = np.array([len(t) - 399 for t in texts])
        seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
        text, position, repeated, _ = shard_windows(texts, starts, np.ones(len(texts), np.int64), 400)
        assert repeated.tolist() == [seen[texts[t][i : i + 400]] > 1 for t, i in zip(text, position)]


def test_texts_without_a_repeat_take_one_python_worker(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "é" * 400), (4, "é" * 400)], "doc_id long, text string")
    kept = remove_repeats(docs)
    found = {r.doc_id: (r.n_bytes, r.n_removed) for r in kept.collect()}
    assert found == {1: (3, 0), 2: (0, 0), 3: (800, 800), 4: (800, 800)}
    # texts with a repeat are packed before they are dealt out, the others never: 3 before, two of them in each task
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
