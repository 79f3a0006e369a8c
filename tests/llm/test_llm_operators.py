"""Each operator against a plain version, an exact round trip, or held-out rows."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from weftgraph.llm import bpe, components, line_dedup, minhash, mixing, pii, pretokens, sharding, simhash, token_file, token_output, topk, toxicity
from weftgraph.llm.queries import ORACLE_SQL, QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts(small):
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{small}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(name, spark, small, same):
    same(QUERIES[name](spark, small), ORACLE_SQL[name])


def test_toxicity_on_rows_it_never_saw(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ba", "do", "ri", "len", "ta", "mo"]) for _ in range(rng.randint(1, 4)))
    bad = ["zgrunk", "vexhole", "zgrunkel"]
    rows, marks = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randint(20, 80))]
        if toxic := i % 8 == 0:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    scored = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    held = [r for r in scored if r["held_out"]]
    assert len(held) > 200 and all(r["predicted"] == (r["doc_id"] % 8 == 0) for r in held)


def test_toxicity_recall_by_language_on_given_tables(spark):
    folder = "/root/testdata/sf0.1"
    scored = toxicity.op1_kneser_ney_toxicity(spark, folder).where("held_out").select("doc_id", "predicted")
    known = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    caught = {}
    for r in scored.join(known, "doc_id").collect():
        caught.setdefault((r["lang"], r["toxic"]), []).append(r["predicted"])
    print({k: (sum(v), len(v)) for k, v in sorted(caught.items())})
    for lang in ("en", "fr", "de", "es"):
        assert sum(caught[lang, 1]) >= 0.85 * len(caught[lang, 1]) and sum(caught[lang, 0]) <= 0.02 * len(caught[lang, 0])


def word_table(spark, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé𐐀") for _ in range(rng.randint(1, 12))) for _ in range(150)] + ["aaaaaaaaaaaa", "aaaaaaaaaaab", "ab"]
    table = {w: tuple(rng.choice([0, 0, 1, 2, 7]) for _ in range(4)) for w in words}
    return table, spark.createDataFrame([(w, sum(c) + rng.randint(1, 3), *c) for w, c in table.items()], "word string, uses long, o0 long, o1 long, t0 long, t1 long")


def plain_ratios(table):
    """Log-ratios of words by the formulas themselves, over dictionaries."""
    of = lambda c: {"o0": c[0], "o1": c[1], "o2": c[0] + c[1], "t0": c[2], "t1": c[3], "t2": c[2] + c[3], "n2": sum(c)}
    seen = {w + "\n": of(c) for w, c in table.items() if sum(c)}
    models = list(of((0, 0, 0, 0)))
    ratio, edges, unseen = {"": (0.0, 0.0, 0.0)}, [0, *toxicity.CUTS, 10**6], {}
    sums = []
    for lo, hi in zip(edges, edges[1:]):
        level = {}
        for x, c in seen.items():
            if len(x) > lo:
                for m in models:
                    level.setdefault(x[:hi], dict.fromkeys(models, 0))[m] += c[m]
        discount = {}
        for m in models:
            once, twice = (sum(c[m] == k for c in level.values()) for k in (1, 2))
            discount[m] = once / (once + 2 * twice) if once else 0.5
        after, steps = {}, {}
        for x, c in level.items():
            after.setdefault(x[:lo], []).append(c)
            steps[x[lo:]] = steps.get(x[lo:], 0) + 1
        total = lambda h, m: sum(c[m] for c in after[h])
        kinds = lambda h, m: sum(c[m] > 0 for c in after[h])
        for h in after:
            unseen[h] = [ratio[h][k] + math.log((20 + discount[f"t{k}"] * kinds(h, f"t{k}")) / (20 + total(h, f"t{k}"))) - math.log((20 + discount[f"o{k}"] * kinds(h, f"o{k}")) / (20 + total(h, f"o{k}"))) for k in range(3)]
        mass = {}
        for x, c in level.items():
            h = x[:lo]
            pooled = (max(c["n2"] - discount["n2"], 0) + discount["n2"] * kinds(h, "n2") * steps[x[lo:]] / len(level)) / total(h, "n2")
            p = {m: (max(c[m] - discount[m], 0) + (20 + discount[m] * kinds(h, m)) * pooled) / (total(h, m) + 20) for m in models if m != "n2"}
            mass[h] = mass.get(h, 0) + p["t2"]
            ratio[x] = tuple(ratio[h][k] + math.log(p[f"t{k}"] / p[f"o{k}"]) for k in range(3))
        sums.append(max(mass.values()))
    judged = {}
    for w, c in table.items():
        x = w + "\n"
        judged[w] = ratio[x] if sum(c) else next((unseen[x[:k]] for k in toxicity.LADDER if x[:k] in unseen), (0.0,) * 3)
    return judged, sums


def test_toxicity_ratios_equal_the_plain_formulas(spark):
    table, df = word_table(spark)
    expected, sums = plain_ratios(table)
    assert max(sums) <= 1 + 1e-9  # no context gives its steps more than all
    bounded = {w: tuple(round(1e6 * min(r, toxicity.MOST_RATIO)) if r >= toxicity.LEAST else 0 for r in rs) for w, rs in expected.items()}
    found = {r["word"]: (r["r0"], r["r1"], r["r2"]) for r in toxicity.word_ratios(df).collect()}
    wanted = {w: rs for w, rs in bounded.items() if any(rs)}
    assert len(wanted) > 30 and found.keys() == wanted.keys()
    assert all(abs(a - b) <= 1 for w in found for a, b in zip(found[w], wanted[w]))


def test_toxicity_evidence_equals_a_plain_scan(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "COMMON", 20)
    ratios = {"zgrunk": (3_000_000, 2_000_000, 4_000_000), "oft": (600_000, 0, 700_000), "réeux": (0, 900_000, 800_000)}
    df = spark.createDataFrame([(w, 900 if w == "oft" else 1, *r) for w, r in ratios.items()], "word string, uses long, r0 long, r1 long, r2 long")
    words = toxicity.indexed(df, 10_000)
    assert set(words.common) == {"oft"}
    texts = ["zgrunk oft " * 6 + "Réeux, other", "", "none of it", "oft"]
    shape = "row long, doc_id long, held_out boolean, text_hash long, toxic int, half int, chosen boolean, text string"
    rows = [(i, None if i == 3 else i, False, i, i % 2, i % 2, i < 2, t) for i, t in enumerate(texts)]
    found = {r["text_hash"]: r for r in toxicity.evidence(spark.createDataFrame(rows, shape).repartition(2), words).collect()}
    assert len(found) == 4 and found[3]["doc_id"] is None and found[3]["label"] == -1
    for i, text in enumerate(texts):
        bag = toxicity.tokens(text)
        for name, k in (("", 2), ("half_", 1 - i % 2 if i < 2 else 2)):
            says = [ratios[w][k] for w in bag if w in ratios]
            assert found[i][f"{name}total"] == sum(says) and found[i]["tokens"] == len(bag)
            assert [v for v in found[i][f"{name}top"] if v] == [v for v in sorted(says, reverse=True)[:8] if v]


def test_token_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 1024, 1025, 5000):
        for values in (rng.integers(0, 50_000, n), rng.pareto(1, n) * 10, rng.integers(0, 2**63, n), np.full(n, 7)):
            values = values.astype(np.uint64)
            blocks = token_file.encode_blocks(values)
            starts = np.cumsum([0, *map(len, blocks)])[:-1].tolist()
            assert (token_file.decode_blocks(b"".join(blocks), starts) == values).all()
    skewed = np.where(np.arange(1024) % 100 == 0, 2**40, np.arange(1024) % 50).astype(np.uint64)
    assert len(token_file.encode_blocks(skewed)[0]) < 1200  # outliers are exceptions, not a width for all


def test_token_files_equal_the_library(spark, small, texts, library):
    found = {r["doc_id"]: r for r in token_output.read_token_files(token_output.write_token_files(spark.read.parquet(f"{small}/documents.parquet"), PATH)).collect()}
    at = 0
    for doc_id in sorted(texts):
        ids = [*library.encode(texts[doc_id], add_special_tokens=False).ids, 0]
        assert (found[doc_id]["start"], np.frombuffer(found[doc_id]["ids"], "<u4").tolist()) == (at, ids)
        at += len(ids)


def test_pivot_search_equals_brute_force():
    rng = np.random.default_rng(2)
    x = rng.integers(-40, 40, (300, 8))
    best = topk.Best(3, 5)
    ids = rng.permutation(300)
    for lo in range(0, 300, 70):
        best.add(topk.products(x[:3], x[lo : lo + 70]), ids[lo : lo + 70], np.ones((3, len(ids[lo : lo + 70])), bool))
    for i in range(3):
        expected = sorted(((-int(x[i] @ x[j]), int(ids[j])) for j in range(300)))[:5]
        assert [(-int(s), int(v)) for s, v in zip(best.score[i], best.ids[i], strict=True)] == expected


def test_pivot_search_reads_few_blocks_of_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (12, 6))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.02, 6)).tolist()) for i in range(1500)]
    found = topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    whole = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows}
    for q in range(0, 1500, 50):
        expected = sorted((-int(whole[q] @ whole[i]), i) for i in whole if i != q)[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == expected


def test_shards_are_even_and_groups_stay_together(spark):
    rng = random.Random(5)
    rows = [(i, "hot copy" if i % 3 == 0 else "x" * rng.randint(1, 200) + (str(i) if i % 5 else "")) for i in range(3000)]
    found = sharding.vector_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size, slots, of = {}, {}, {}
    for r in found:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        of.setdefault(dict(rows)[r["doc_id"]], set()).add(r["shard"])
    assert len(size) == 8 and max(size.values()) < 1.02 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for text, s in of.items() if text != "hot copy")


def test_pieces_equal_the_library(library):
    split = lambda t: [t[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t)]
    rng = random.Random(3)
    signs = ["\x1c", "\x85", "\xa0", " ", "²", "Ⅷ", "中", "ß", "'s", "'ll", "'", "  ", "\n", "a", "Z", "9", "-", "é", "😀", "́", "\U00010940", "<|endoftext|>", "\x0b"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 9)))
        assert pretokens.pieces(text) == split(text)


def test_transducer_equals_the_library_and_forgets(library):
    coder = bpe.BpeCodec(PATH)
    rng = random.Random(7)
    vocabulary = [b for b in coder.merges.vocab if b.isalpha()]
    cases = ["", " ", "a" * 9000, "-=" * 3000, "<|endoftext|>x", " " * 3000 + "x"]
    cases += ["".join(rng.choice("aeiouth ésñ1!\n") for _ in range(rng.randint(1, 80))) for _ in range(400)]
    cases += [b"".join(rng.choice(vocabulary) for _ in range(600)).decode("utf-8", "replace") for _ in range(5)]
    for text in cases:
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert coder.decode(ids) == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
    assert "".join(coder.decode_stream(np.frombuffer(coder.encode("né 😀"), "<u4").tolist())) == "né 😀"
    assert coder.decode(np.array([coder.merges.vocab[b"\xc3"]], "<u4").tobytes()) == "�"
    t, most = bpe.Transducer(coder.merges), 0
    for _ in range(60):
        t.feed("".join(rng.choice("abcdefghinorste") for _ in range(500)).encode())
        most = max(most, len(t.buffer))
    assert most < 2 * coder.merges.sufficient_lookahead + 500


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(texts):
    for text in [*list(texts.values())[:60], "", "É É É", "a b\x0bc\x85d"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("kind", ["uniform", "skewed"])
def test_simhash_links_equal_all_pairs(spark, kind):
    rng = random.Random(11)
    centres = [rng.getrandbits(64) & (2**64 - 1 if kind == "uniform" else 0xFFFF00FF0000FF0F) for _ in range(60)]
    values = {0} | {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(12)}
    values = np.array(sorted(values), np.uint64)
    parent = {int(v): int(v) for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, v in enumerate(values):
        for w in values[i + 1 :][np.bitwise_count(values[i + 1 :] ^ v) <= 4]:
            parent[find(int(w))] = find(int(v))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    for total in (len(values), 10**9):
        plan = simhash.plan_for(values, total)
        assert sum(t + 1 for t in plan.thresholds) == 5 and sorted(b for p in plan.parts for b in p) == list(range(64))
        roots = {int(np.int64(r["node"]).view(np.uint64)): int(np.int64(r["root"]).view(np.uint64)) for r in components.components(simhash.links(df, plan)).collect()}
        groups, expected = {}, {}
        for v in map(int, values):
            groups.setdefault(roots.get(v, v), set()).add(v)
            expected.setdefault(find(v), set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_large_buckets_are_searched_whole():
    rng = np.random.default_rng(4)
    values = np.unique(np.concatenate([np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64), rng.integers(0, 2**63, 5000).astype(np.uint64)]))
    found = simhash.connect(values, 4)
    rooted = lambda links: components.stars([(int(a), int(b)) for us, vs in links for a, b in zip(us, vs, strict=True)])
    linked, expected = rooted(found), rooted(simhash.search(values, 4))
    assert len({linked.get(int(v), int(v)) for v in values}) == len({expected.get(int(v), int(v)) for v in values})


def test_components_by_rounds_equal_one_task(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(7, 7), (None, 3), (5, None), (0, 1)]
    df = spark.createDataFrame(links, "u long, v long")
    assert dict(map(tuple, components.components(df, held=3).collect())) == dict(map(tuple, components.components(df).collect()))
    assert components.components(df.where("false")).count() == 0


def shingles(text):
    words = text.encode().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_minhash_estimates(spark, small, texts):
    order = sorted(texts)
    errors = []
    for r in minhash.op7_minhash_prints(spark, small).collect():
        text, following = texts[r["doc_id"]], texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for value, other in ((r["near_edited"], edited), (r["near_next"], following)):
            a, b = shingles(text), shingles(other)
            errors.append(value - (len(a & b) / len(a | b) if a | b else 1.0))
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.12


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_plain_patterns():
    rng = random.Random(2)
    parts = ["a", "b.", "@", "@c.d", "-", "+", "+1", " ", "(", "1", "22", "4111111111111111", ".", "256", "9.8.7.6", "%", "é", "٣"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert [(k, a, b) for k in pii.BASE_KINDS for a, b, good in pii.matches(text)[k] if good] == plain_spans(text)


def test_method_adds_spans_and_leaves_numbers_alone(spark):
    rows = [(i, f"write to u{i}@site{i}.com or +1 (212) 555-01{i:02d}, host 10.1.2.{i}, card 4111 1111 1111 1111.") for i in range(40)]
    rows += [(100, "call 555-123-4567 today"), (101, "order 378282246310006 version 1.2.3.999"), (102, "mail bob (at) example (dot) com"), (103, "nothing here")]
    found = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0]["spans"] == found[0]["base_spans"] and found[0]["n_email"] == 1
    assert found[100]["spans"] == "phone:5:17" and found[100]["base_spans"] == ""
    assert found[102]["spans"].startswith("email:5:")
    assert found[101]["spans"] == "" and found[103]["spans"] == ""


def test_reliabilities_are_learnt():
    counts = {("phone", (1, 1, 1, 1, 1)): 900, ("phone", (1, 1, -1, 1, 1)): 300, ("phone", (0, -1, 1, 0, -1)): 800}
    model = pii.estimate(counts)
    assert model.reliability["phone"][1, 1, 2] > 0.9 > 0.8 > model.reliability["phone"][1, 2, 2]


def test_mix_meets_targets_and_reruns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = mixing.pareto_mix(docs)
    again = mixing.pareto_mix(docs.repartition(7))
    assert sorted(map(str, found.collect())) == sorted(map(str, again.collect()))
    rows = found.collect()
    taken, target, largest = {}, {}, {}
    for r in rows:
        key = r["source_key"]
        taken[key] = taken.get(key, 0) + r["taken"]
        target[key], largest[key] = r["target"], max(largest.get(key, 0), r["size"])
        assert r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"]
    assert abs(sum(target.values()) - sum(r["size"] for r in rows)) < 1
    assert all(abs(taken[k] - target[k]) <= largest[k] for k in taken)
    assert mixing.mixed_documents(docs).count() == sum(r["copies"] for r in rows)


def plain_mix(rows, weights=(1, 2, 3), most=3):
    """doc_id, source, size, own weight, u: copies of each, with the level found by halving."""
    size_of = {}
    for _, source, size, _, _ in rows:
        size_of[source] = size_of.get(source, 0) + size
    share = dict(zip(sorted(size_of), [weights[i % 3] for i in range(len(size_of))]))
    low, high = 0.0, 1e9
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(min(most * size_of[s], share[s] * middle) for s in share) < sum(size_of.values()) else (low, middle)
    copies = {}
    for source in share:
        target, of = min(most * size_of[source], share[source] * high), [r for r in rows if r[1] == source]
        low_c, high_c = 0.0, 1e6
        for _ in range(200):
            middle = (low_c + high_c) / 2
            low_c, high_c = (middle, high_c) if sum(min(most, middle * w) * n for _, _, n, w, _ in of) < target else (low_c, middle)
        wanted = [(i, n, u, min(most, high_c * w)) for i, _, n, w, u in of]
        left = target - sum(int(e) * n for _, n, _, e in wanted)
        copies |= {i: int(e) for i, _, _, e in wanted}
        used = 0
        odds = lambda r: r[2] / (1 - r[2]) * (1 - r[3] % 1) / (r[3] % 1)
        for i, n, u, e in sorted((r for r in wanted if r[3] % 1 > 0), key=odds):
            used += n
            copies[i] = int(e) + (used - n / 2 <= left)
    return copies


def test_mix_equals_plain_version_and_inclusion_is_unequal(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("aabc"), rng.choice([1, 3, 8, 20, 90, 300]), rng.randint(1, 9)) for i in range(900)]
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), s, w) for i, s, n, w in rows], "doc_id long, text string, source string, worth int")
    us = {r["doc_id"]: r["u"] for r in docs.select("doc_id", mixing.uniform("doc_id", mixing.SEED).alias("u")).collect()}
    for weight_col in (None, "worth"):
        found = {r["doc_id"]: r["copies"] for r in mixing.pareto_mix(docs, weight_col=weight_col).collect()}
        assert found == plain_mix([(i, s, n, n.bit_length() if weight_col is None else w, us[i]) for i, s, n, w in rows])
    # Heavier documents are taken more often, and the order isn't that of the random number alone.
    mean = lambda ws: sum(found[i] for i, _, _, w in rows if w in ws) / sum(w in ws for _, _, _, w in rows)
    assert mean({8, 9}) > 2 * mean({1, 2})
    kept = sorted(i for i, s, _, _ in rows if s == "a" and found[i])
    assert kept != sorted(sorted((i for i, s, _, _ in rows if s == "a"), key=us.get)[: len(kept)])


def test_mixed_rows_are_as_many_as_the_mix_takes(odd):
    plan = mixing.pareto_mix(odd).collect()
    assert mixing.mixed_documents(odd).count() == sum(r["copies"] for r in plan)


def test_near_lines_equal_all_pairs(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(18, 40))).strip() or "x" for _ in range(12)]

    def edit(s, n):
        for _ in range(n):
            i, kind = rng.randrange(len(s) + 1), rng.randrange(3)
            s = s[:i] + rng.choice(["", "z"]) + s[i + 1 :] if kind else s[:i] + "y" + s[i:]
        return s

    lines = sorted({edit(b, rng.randint(0, 4)) for b in base for _ in range(14)} - {""})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, last = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
        return row[-1]

    for edits in (1, 2, 3):
        df = spark.createDataFrame([(s,) for s in lines], "line string")
        named = {(r["h1"], r["h2"]): r["line"] for r in df.select("line", *line_dedup.line_hashes()).collect()}
        found = {frozenset((named[r["a1"], r["a2"]], named[r["b1"], r["b2"]])) for r in line_dedup.near_links(df, edits).collect()}
        expected = {frozenset((a, b)) for i, a in enumerate(lines) for b in lines[i + 1 :] if min(len(a), len(b)) >= 20 and distance(a, b) <= edits}
        assert found == expected


def test_lines_are_dropped_after_their_first_place(spark):
    long = "this line is long enough to be compared"
    rows = [(2, f"{long}!\nshort\n\nown two"), (1, f"{long}\nshort\n\nown one"), (3, "short"), (4, None)]
    found = {r["doc_id"]: (r["kept_text"], r["n_exact"], r["n_near"]) for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (f"{long}\nshort\n\nown one", 0, 0), 2: ("\nown two", 1, 1), 3: ("", 1, 0), 4: (None, 0, 0)}


def test_long_texts_are_digested_as_streams(library, monkeypatch):
    coder = bpe.BpeCodec(PATH)
    rng = random.Random(8)
    text = "".join(rng.choice(["un mot ", "x" * 90, "中文", "é😀\n", "<|endoftext|>", "'s ", "  12345 "]) for _ in range(3000))
    whole = coder.digest(text, True)
    ids = library.encode(text, add_special_tokens=False).ids
    assert whole == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), np.array(ids, "<u4").tobytes())
    monkeypatch.setattr(bpe, "LONG", 10)
    assert coder.digest(text, True) == whole


def test_columns_of_clashing_names_keep_their_values(spark):
    docs = spark.createDataFrame([(1, "a line\nanother", 777, "mine", 9), (2, "a line\nthird", 778, "yours", 9)], "doc_id long, text string, text_hash long, kept_text string, n_lines int")
    found = {r["doc_id"]: r for r in line_dedup.with_kept_lines(docs).collect()}
    assert found[2]["text"] == "third" and (found[2]["text_hash"], found[2]["kept_text"], found[2]["n_lines"]) == (778, "yours", 9)
    assert line_dedup.deduplicated(docs).columns == ["doc_id", "text", "text_hash", "kept_text", "n_lines", "n_exact", "n_near"]
