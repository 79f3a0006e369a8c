"""The pipeline against its stages done one by one in plain Python on a small table."""

import collections
import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ba", "do", "ri", "len", "ta", "mo", "ku"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(40)]
        toxic = i % 9 == 0
        if toxic:
            for p in (3, 12, 25, 31):
                words[p] = "zgrunk"
        text = " ".join(words) + "\nall rights reserved by the usual people\n" + " ".join(word() for _ in range(30))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows.append((400, rows[1][1].replace("\n", " - "), "en", "s1", len(rows[1][1]) + 4))  # a near copy on one line
    rows.append((401, rows[2][1], "en", "s2", len(rows[2][1])))  # an exact copy
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    now, by = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = by[name] = stage(spark, now, str(tmp_path)).cache()
    kept = {n: collections.Counter(r["doc_id"] for r in d.select("doc_id").collect()) for n, d in by.items()}
    assert set(kept["toxicity"]) == {r[0] for r in rows if r[0] % 9 or r[0] >= 400}
    assert 401 not in kept["line_dedup"] and set(kept["line_dedup"]) == set(kept["toxicity"]) - {401}
    lines = {r["doc_id"]: r["text"] for r in by["line_dedup"].collect()}
    assert sum("all rights reserved" in t for i, t in lines.items() if i != 400) == 1
    assert set(kept["line_dedup"]) - set(kept["simhash_near_dedup"]) <= {1, 400}
    mixed = by["source_mixing"].collect()
    words = collections.Counter()
    for r in mixed:
        words[r["source"]] += len(r["text"].split())
    total = sum(len(r["text"].split()) for r in by["simhash_near_dedup"].collect())
    assert all(abs(words[f"s{k}"] - total * (k + 1) / 6) < 100 for k in range(3)) and max(kept["source_mixing"].values()) <= 3
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text_of = {r["doc_id"]: r["text"] for r in mixed}
    for r in by["bpe_encoding"].collect():
        ids = library.encode(text_of[r["doc_id"]], add_special_tokens=False).ids
        assert bytes(r["ids"]) == np.array(ids, "<u4").tobytes() and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(text_of[r["doc_id"]].encode()).hexdigest()
    whole = collections.Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect())
    assert whole == kept["bpe_encoding"]
