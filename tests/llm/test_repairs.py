"""Cases that once went wrong: long digit runs, dense texts, repeated query ids, ids that don't tell rows apart."""

import time

from weftgraph.llm import pii, sharding, topk


def test_digit_runs_of_any_length():
    for digits in ("0" * 5000, "1" * 5000, "0" * 4999 + "7"):
        found = pii.matches(digits + ".1.1.1")["ip"]
        assert [good for _, _, good in found] == [digits[0] == "0"]


def test_dense_texts_take_linear_time():
    line = "write to a.b@c.com or (212) 555-0100, 123-45-6789, +1 212 555 0100 from 10.0.0.1\n"
    began = time.process_time()
    short = pii.candidates(line * 2000)
    middle = time.process_time()
    long = pii.candidates(line * 8000)
    assert len(long) == 4 * len(short) and time.process_time() - middle < 10 * (middle - began) + 1


def test_loose_candidates_lie_beside_base_spans():
    text = "a@b.co 1.2.3.4 (212) 555-0100 +1 (212) 555-0100 x (at) y (dot) com " * 30
    base = [(a, b) for k in pii.BASE_KINDS for a, b, good in pii.matches(text)[k] if good]
    for kind, a, b, good in pii.candidates(text):
        if not good and kind not in ("ip", "card"):
            assert kind in pii.BASE_KINDS and (a, b, False) in pii.matches(text)[kind] or not any(x < b and a < y for x, y in base)


def test_repeated_query_ids_have_ranks_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), *[(i, [float(i), float(10 - i)]) for i in range(1, 9)]]
    found = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found)
    one = [(k + 1, 8 - k, 65536 * (8 - k)) for k in range(5)]
    two = [(k + 1, k + 1, 65536 * (9 - k)) for k in range(5)]
    assert got == sorted(one + two)


def test_null_ids_and_groups_below_a_shard(spark):
    rows = [(None, "one text of many copies")] * 2000 + [(7, "another text, one id")] * 1500
    size = {}
    for r in sharding.vector_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    assert len(size) == 8 and max(size.values()) < 1.15 * min(size.values())
    rows = [(i, "a-tenth-of-all" if i % 10 == 0 else f"text number {i:05d}") for i in range(4000)]
    found = sharding.vector_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r["shard"] for r in found if r["doc_id"] % 10 == 0}) == 1
    for r in found:
        assert r["size"] == len(dict(rows)[r["doc_id"]]) + 1
