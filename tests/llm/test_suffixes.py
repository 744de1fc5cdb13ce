import hashlib
import random

import numpy as np
import pytest

from siftstone.llm import suffixes


def brute(rows, window):
    """[(n_bytes, n_removed, n_spans, kept)] in order of rows: every string of every row is compared."""
    first: dict[bytes, int] = {}
    late = max((i for i, _ in rows if i is not None), default=0) + 1
    for i, text in rows:
        b = (text or "").encode()
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            first[w] = min(first.get(w, late), late if i is None else i)
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for s in range(len(b) - window + 1):
            if first[b[s : s + window]] < (late if i is None else i):
                gone[s + 1 : s + window + 1] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def same(spark, rows, window, seed):
    got = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window, seed=seed).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == brute(rows, window)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(x.end - x.start for x in r.spans) == r.n_removed for r in got)


def test_query_against_all_strings(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = suffixes.op12(spark, "/root/testdata/sf0.001").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, 50)
    assert sum(r.n_removed > 0 for r in got) > 5


@pytest.mark.parametrize("seed", range(3))
def test_many_buckets_and_runs_over_their_edges(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choices("ab" if seed else "a", k=rng.randrange(60)))) for i in range(60)]
    line = "".join(rng.choices("xyz", k=40))
    rows += [(100 + i, line + str(i)) for i in range(60)] + [(300 - i, rows[i][1] + "é" + rows[i + 1][1]) for i in range(30)]
    rng.shuffle(rows)
    monkeypatch.setattr(suffixes, "BUCKET_ROWS", 40)
    same(spark, rows, 14, 8)


def test_strings_that_differ_around_a_common_seed(spark):
    body = "the quick brown fox jumps over the lazy dog and runs"
    rows = [(n, "".join(chr(97 + (n * k) % 26) for k in range(20)) + body[n : n + 40] + "".join(chr(65 + (n * k) % 26) for k in range(20))) for n in range(12)]
    same(spark, rows + [(-5, body), (50, body + body), (51, None), (52, "")], 24, 10)


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = suffixes.without_repeats(odd).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == brute(rows, 50)
    assert suffixes.without_repeats(empty).count() == 0


def test_long_text(spark):
    rng = random.Random(5)
    long = "".join(rng.choices("abcdefgh ", k=2 << 20))
    got = {r.doc_id: r for r in suffixes.without_repeats(spark.createDataFrame([(1, long), (2, "q" * 9 + long[1_000_000:1_700_000] + "w" * 9)], "doc_id long, text string"), kept=False).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 700_000 and got[2].spans[0].start == 9


def test_multikey_order():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(4)]
    order = suffixes.multikey_order(keys)
    assert (np.stack(keys)[:, order] == np.stack(keys)[:, np.lexsort(keys[::-1])]).all()
