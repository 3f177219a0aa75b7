"""The piece encoder's memory and its rounds of joins."""
import numpy as np
import pyarrow as pa

from newsgauge.llm import pieces as P


def test_a_worker_encodes_two_megabytes_at_a_time():
    batch = pa.RecordBatch.from_pydict({"text": ["word " * 100_000] * 12})
    sizes = [sum(len(t) for t in b.column("text").to_pylist()) for b in P.slices([batch], limit=P.SLICE)]
    assert sum(sizes) == 6_000_000 and max(sizes) <= (2 << 20) + 500_000


def test_rounds_join_the_best_and_leftmost_pair_of_each_segment(monkeypatch):
    def no_sort(*_):
        raise AssertionError("edges come in order")
    monkeypatch.setattr(P.np, "lexsort", no_sort)
    # "aaa" and "aab" with pieces aa (rank 1) and ab (rank 0): leftmost aa, and ab before aa
    place, end, piece, rank, owner = (np.array(x) for x in ([0, 1, 4, 5], [2, 3, 6, 7], [7, 7, 7, 8], [1, 1, 1, 0], [0, 0, 1, 1]))
    after, name = np.array([1, 2, 3, -1, 5, 6, 7, -1]), np.full(8, -1)
    P.merge_rounds(place, end, piece, rank, owner, after, name)
    assert after.tolist() == [2, -1, 3, -1, 5, 7, -1, -1] and name[[0, 5]].tolist() == [7, 8]


def test_a_worker_lets_go_of_one_operators_cache_when_it_comes_to_another():
    import weakref

    from newsgauge.llm import common as K

    class Cache:
        pass

    mine = K.kept(("pieces", "a"), Cache)
    held = weakref.ref(mine)
    del mine
    batch = pa.RecordBatch.from_pydict({"text": ["word"]})
    assert K.kept(("pieces", "a"), Cache) is held()
    list(K.slices([batch], keeps=("pieces", "a")))
    assert held() is not None
    list(K.slices([batch]))                                                  # as quality rules or near-dedup read their texts
    assert held() is None


def test_frequent_segments_stay_when_the_cache_turns_over(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [f"the house {word} {word}s" for word in ("red", "green", "blue", "white", "black", "brown")]
    whole = [P.Coder(path).encode([t]) for t in texts]
    seen, plain = [], P.encode_segments
    monkeypatch.setattr(P, "CACHE", 10)
    monkeypatch.setattr(P, "encode_segments", lambda new, p: (seen.extend(new), plain(new, p))[1])
    coder = P.Coder(path)
    for t, (ids, ends) in zip(texts, whole, strict=True):
        got, got_ends = coder.encode([t])
        assert got.tolist() == ids.tolist() and got_ends.tolist() == ends.tolist()
        assert len(coder.pool.known) <= 5 and len(coder.older.known) <= 5
    assert len(coder.older.known) > 0 and len(seen) == len(set(seen)) == 2 + 2 * len(texts)
