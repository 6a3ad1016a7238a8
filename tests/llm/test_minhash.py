"""Groups of near copies against all pairs, and their defined results at the edges."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import EDGES, frame, rows

from auditlake.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset()


def expected(data):
    """(doc_id, size, component_id, kept) by all pairs of distinct sets."""
    each = [shingles(t) for _, t in data]
    sets = sorted(set(each) - {frozenset()}, key=len)
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    links = 0
    for i, x in enumerate(sets):
        for y in sets[i + 1 :]:
            if 100 * len(x) < 80 * len(y):
                break
            if 100 * len(x & y) >= 80 * len(x | y):
                links += 1
                root[find(x)] = find(y)
    low = {}
    for (i, _), s in zip(data, each):
        if s and i is not None:
            low[find(s)] = min(i, low.get(find(s), i))
    out = [(i, len(s), low.get(find(s)) if s else i) for (i, _), s in zip(data, each)]
    return sorted(((i, n, c, i == c) for i, n, c in out), key=str), links


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_all_pairs(spark):
    data = rows() + EDGES + [(None, "null id text"), (6001, "Word"), (6002, "a b a b a"), (6003, "b a b"), (None, "lonely unidentified text")]
    assert got(minhash.near_duplicates(frame(spark, data))) == expected(data)[0]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, links = expected([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert links and got(minhash.near_duplicates(docs)) == want


def families(seed=5):
    """Chains of copies of copies around the threshold, stars of copies of one text, and texts that share much without a link."""
    rng = np.random.default_rng(seed)
    draw = lambda n: [f"v{x}" for x in rng.integers(0, 5000, n)]
    texts = []
    for size, n in ((120, 60), (40, 40), (7, 25), (500, 20)):
        chain = draw(size)
        for _ in range(n):
            texts.append(list(chain))
            for _ in range(rng.integers(1, max(2, size // 18))):
                chain[rng.integers(size)] = f"v{rng.integers(5000)}"
    for size, edits in ((100, 5), (60, 4), (200, 14)):  # each within the threshold of the first, hardly any of each other
        base = draw(size)
        texts.append(base)
        for _ in range(60):
            x = list(base)
            for at in rng.choice(size, edits, replace=False):
                x[at] = f"u{rng.integers(10**6)}"
            texts.append(x)
    common = draw(60)
    texts += [draw(3) + common + draw(int(k)) for k in rng.integers(2, 30, 60)]
    order = rng.permutation(len(texts))
    return [(int(i), " ".join(texts[k])) for i, k in enumerate(order)]


@pytest.mark.parametrize("small", [False, True])
def test_families(spark, monkeypatch, small):
    """The same groups whatever the sizes of tiles, and without any round of centres."""
    if small:
        monkeypatch.setattr(minhash, "CHUNK", 16)
        monkeypatch.setattr(minhash, "PART", 3000)
        monkeypatch.setattr(minhash, "ROUNDS", 0)
    data = families()
    want, links = expected(data)
    assert links > 200 and len({x[2] for x in want}) > 20
    assert got(minhash.near_duplicates(frame(spark, data))) == want


def test_large_lists_are_compared_block_by_block():
    """Both ways to compare the lists of a row find the same components."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (6, minhash.COORDS), np.uint8)
    sig = base[rng.integers(0, 6, 300)].copy()
    hit = rng.random(sig.shape) < 0.25
    sig[hit] = rng.integers(0, 256, hit.sum())
    held = [{"key": i, "n": 10, "root": i, "sig": s.tobytes()} for i, s in enumerate(sig)]
    kind = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("sig", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array([held[:200], held[:3]], kind), pa.array([held, held[150:]], kind)], ["l", "r"])
    found = []
    for small in (1, 1 << 20):
        pairs = np.concatenate([np.stack([np.asarray(x) for x in b.columns]) for b in minhash._tile_batches(iter([batch]), small)], 1)
        found.append(sorted(zip(*(x.tolist() for x in minhash.forest(*pairs)))))
    assert found[0] == found[1] and len(found[0]) > 200


def test_signatures_estimate_similarity():
    """The share of equal coordinates is the similarity, within a few standard deviations of the binomial."""
    rng = np.random.default_rng(4)
    for n, same in ((50, 40), (400, 300), (2000, 1000)):
        x = rng.integers(0, 2**63, (20, n), np.uint64)
        y = x.copy()
        y[:, same:] = rng.integers(0, 2**63, (20, n - same), np.uint64)
        first = np.arange(21) * n
        a, b = (minhash.signatures(z.ravel(), first) for z in (x, y))
        similarity = same / (2 * n - same)
        assert abs((a == b).mean() - similarity) < 5 * np.sqrt(similarity * (1 - similarity) / (20 * minhash.COORDS))


def test_prefixes_meet():
    """Sets with POSTED_MATCHES equal coordinates share a posted token, whatever the levels are."""
    rng = np.random.default_rng(6)
    head = rng.integers(0, 2**32, (2, minhash.POSTED), np.uint32)
    head[1, rng.choice(minhash.POSTED, minhash.POSTED_MATCHES, replace=False)] = 0
    for seed in range(50):
        order = np.random.default_rng(seed)
        head[1] = order.integers(0, 2**32, minhash.POSTED, np.uint32)
        at = order.choice(minhash.POSTED, minhash.POSTED_MATCHES, replace=False)
        head[1, at] = head[0, at]
        known = np.unique(minhash.tokens(head).ravel())
        token = minhash.prefixes(head, (known, order.integers(0, 64, len(known)).astype(np.uint64)))
        assert token.shape == (2, minhash.PREFIX) and set(token[0].tolist()) & set(token[1].tolist())


def test_copies_and_extra_columns(spark):
    """A third of all rows has one text; the rows keep their component."""
    data = [(i, "the same text for many rows " + ("here" if i % 3 else f"{i} x{i} y{i} z{i} u{i}")) for i in range(3000)]
    out = minhash.near_duplicates(frame(spark, data).withColumn("component_id", F.lit("x")))
    assert got(out) == expected(data)[0]


def test_no_rows(spark):
    assert minhash.near_duplicates(frame(spark, [])).collect() == []
    assert got(minhash.near_duplicates(frame(spark, [(1, None), (2, ""), (None, " ")]))) == expected([(1, None), (2, ""), (None, " ")])[0]
