"""Nulls, empty, blank and very long texts, ties, repeated rows, empty tables, clashing names: for every operator."""

import public_tokenizers
import pytest

from weftgraph.llm import bpe, line_dedup, minhash, mixing, pii, sharding, simhash, token_output, topk, toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def labels(docs):
    return docs.sparkSession.createDataFrame([(4, 1), (6, 0), (3, 0), (None, 1), (7, None), (999, 1)], "doc_id long, toxic int")


OPERATORS = {
    "toxicity": lambda d: toxicity.score_toxicity(d, labels(d)),
    "token_files": lambda d: token_output.read_token_files(token_output.write_token_files(d, TOKENIZER)),
    "sharding": sharding.vector_shards,
    "bpe": lambda d: bpe.digests(d, TOKENIZER),
    "simhash": simhash.simhash_groups,
    "minhash": minhash.edited_likeness,
    "pii": pii.find_personal_data,
    "mixing": mixing.pareto_mix,
    "line_dedup": line_dedup.deduplicated,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_out_for_each_row_in(name, odd, nothing):
    found = sorted(str(r["doc_id"]) for r in OPERATORS[name](odd).select("doc_id").collect())
    assert found == sorted(str(r["doc_id"]) for r in odd.select("doc_id").collect())
    assert OPERATORS[name](nothing).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    shape = "vec_id long, embedding array<float>, score long"
    rows = [(0, [1.0, 2.0], 1), (50, None, 1), (100, [nan, 1.0], 1), (3, [inf], 1), (None, [1.0], 1), (4, [1.0, None], 1), (5, [1.0], 1), (6, [], 1), (7, [1.0, 2.0], 1), (8, [1.0, 2.0], 1)]
    found = topk.exact_top_k(spark.createDataFrame(rows, shape)).orderBy("rank").collect()
    assert [tuple(r) for r in found] == [(0, 1, 7, 327680), (0, 2, 8, 327680), (0, 3, 5, 65536), (0, 4, 6, 0)]
    assert topk.exact_top_k(spark.createDataFrame([], shape)).count() == 0


def test_stages_keep_columns(odd):
    for stage in (lambda d: toxicity.without_toxic(d, labels(d)), line_dedup.with_kept_lines, simhash.one_of_each_group, mixing.mixed_documents):
        assert stage(odd).columns == odd.columns
        stage(odd).collect()


def test_one_of_repeated_rows_keeps_its_lines(spark):
    text = "first line of this text\n\nsecond"
    rows = [(1, text, "b"), (1, text, "a"), (1, text, "c"), (None, "only once here", "d"), (None, "only once here", "e"), (2, "else\nelse", "f"), (3, text + "!", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = line_dedup.deduplicated(docs).collect()
    of = lambda i: sorted((r["kept_text"], r["n_lines"], r["n_exact"], r["n_near"]) for r in found if r["doc_id"] == i)
    assert of(1) == [("", 2, 2, 0), ("", 2, 2, 0), (text, 2, 0, 0)]
    assert of(None) == [("", 1, 1, 0), ("only once here", 1, 0, 0)]
    assert of(2) == [("else", 2, 1, 0)] and of(3) == [("\nsecond!", 2, 1, 0)]
    near = spark.createDataFrame([(5, "a line of twenty letters or more", "a"), (6, "a line of twenty letters or morE", "b"), (6, "a line of twenty letters or morE", "c")], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["kept_text"], r["n_exact"], r["n_near"]) for r in line_dedup.deduplicated(near).collect()) == [(5, "a line of twenty letters or more", 0, 0), (6, "", 0, 1), (6, "", 1, 0)]


def test_one_of_repeated_rows_stays_in_a_group(spark):
    docs = spark.createDataFrame([(1, "some words that repeat", "a"), (1, "some words that repeat", "b"), (2, "some words that repeat", "c"), (None, "x", "d")], "doc_id long, text string, source string").repartition(3)
    assert sorted(str(r["doc_id"]) for r in simhash.one_of_each_group(docs).collect()) == ["1", "None"]
