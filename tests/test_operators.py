import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import rule_tables as R
from weftgraph.operators import crawl, enrich, graph, infobox, load, questions, retrieve, typing
from weftgraph.sources import readers, writers


def edges(spark, rows):
    return spark.createDataFrame(rows, "source string, target string, type string")


def nodes(spark, titles):
    return spark.createDataFrame([(t,) for t in titles], "title string")


def scores(df, column):
    return {r["title"]: round(r[column], 6) for r in df.collect()}


def test_votes_top_two_and_closure(spark):
    text = "Gia Long cưới Tống Thị. Gia Long đánh bại Tống Thị. Gia Long gặp Tống Thị. Tống Thị là vợ vua."
    articles = spark.createDataFrame([("Gia Long", text), ("Im", ""), ("X", "Không nhắc ai.")], "title string, text string")
    pairs = spark.createDataFrame([("Gia Long", "Tống Thị"), ("Im", "Gia Long"), ("X", "Gia Long")], "source string, target string")
    out = {(r["source"], r["target"], r["type"]): r["evidence"] for r in typing.typed_edges(pairs, articles, R.RULES_A, R.INVERSE_A).collect()}
    assert out["Gia Long", "Tống Thị", "PHỐI_NGẪU_VỚI"] == "Gia Long cưới Tống Thị."
    assert out["Tống Thị", "Gia Long", "PHỐI_NGẪU_VỚI"] == "[SUY LUẬN] Từ việc Gia Long là PHỐI_NGẪU_VỚI của Tống Thị."
    assert ("Gia Long", "Tống Thị", R.GENERIC) not in out
    assert out["Im", "Gia Long", R.GENERIC] == "" and ("X", "Gia Long", R.GENERIC) not in out
    kept = typing.typed_edges(pairs, articles, R.RULES_B, R.INVERSE_B, keep_missing=True)
    assert kept.where("source = 'X'").count() == 1


def test_labeler_is_asked_about_generic_pairs_only(spark):
    articles = spark.createDataFrame([("A", "A gặp B. A cưới C.")], "title string, text string")
    pairs = spark.createDataFrame([("A", "B"), ("A", "C")], "source string, target string")
    asked = typing.typed_edges(pairs, articles, R.RULES_B, {}, labeler=lambda d: d.withColumn("label", F.lit("ĐỒNG_MINH_VỚI")))
    assert {(r["target"], r["type"]) for r in asked.collect()} == {("B", "ĐỒNG_MINH_VỚI"), ("C", "PHỐI_NGẪU_VỚI")}


def test_first_writer_wins_among_inverses(spark):
    forward = spark.createDataFrame([("A", "B", "LÀ_CHA_CỦA", "e1", 1), ("A", "B", "LÀ_MẸ_CỦA", "e2", 2)], "source string, target string, type string, evidence string, rank int")
    back = typing.inverse_closure(forward, R.INVERSE_A).where("source = 'B'").collect()
    assert [(r["type"], "LÀ_CHA_CỦA" in r["evidence"]) for r in back] == [("LÀ_CON_CỦA", True)]


def test_contains_join_by_grams_equals_broadcast(spark, small):
    texts = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").cast("string").alias("source"), F.lower("text").alias("low"))
    titles = spark.createDataFrame([(w, w) for w in ("that", "there", "schä", "tion the", "zzzz")], "lowered string, title string")
    key = ["source", "t_lowered"]
    a = enrich.contains_join(texts, "low", titles).select(key)
    b = enrich.contains_join(texts, "low", titles, limit=1).select(key)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_contains_join_finds_every_title_in_every_text(spark):
    texts = [(1, "aaab ab"), (2, ""), (3, None), (4, "đab\U0001f600x"), (5, "b"), (6, "x" * 200_000 + "ab"), (1, "aaab ab")]
    titles = [("ab", "AB"), ("ab", "Ab"), ("b", "B"), ("aa", "AA"), ("aaab ab", "all"), ("\U0001f600", "face"), ("đ", None), ("", "none"), (None, "null")]
    t = spark.createDataFrame(texts, "id int, low string").withColumn("hit", F.lit(7))
    n = spark.createDataFrame(titles, "lowered string, title string")
    expected = sorted((i, 7, a, str(b)) for i, low in texts for a, b in titles if low and a and a in low)
    for limit in (100, 1):
        found = enrich.contains_join(t, "low", n, min_length=1, limit=limit)
        assert sorted((r["id"], r["hit"], r["t_lowered"], str(r["t_title"])) for r in found.collect()) == expected
        assert "NestedLoop" not in found._jdf.queryExecution().toString()
    empty = enrich.contains_join(t, "low", n.where("title = 'absent'"), min_length=1)
    assert empty.columns == ["id", "low", "hit", "t_lowered", "t_title"] and empty.count() == 0


def test_upsert_and_load(spark):
    existing = spark.createDataFrame([("A", "1")], "title string, page_id string")
    new = spark.createDataFrame([("A", 9, 0), ("B", None, 1), ("B", 5, 2), (None, 3, 3)], "title string, page_id long, pos int")
    assert sorted(map(tuple, load.upsert_nodes(existing, new).collect())) == [("A", "1"), ("B", "TITLE_KEY_B")]
    e = edges(spark, [("A", "B", "t"), ("A", "B", "t"), ("A", "Z", "t")])
    n = nodes(spark, ["A", "B"])
    assert load.insert_edges(e, n).count() == 2
    once = load.insert_edges(e, n, keep_repeated=False)
    assert load.insert_edges(e, n, once, keep_repeated=False).count() == 1
    assert load.rejected(e, n).count() == 1
    load.assert_unique(n)
    with pytest.raises(ValueError):
        load.assert_unique(nodes(spark, ["A", "A"]))


def model_crawl(links, ok, seeds, depth):
    queue, seen, kept, found = collections.deque((s, 0) for s in seeds), set(), {}, set()
    while queue:
        title, d = queue.popleft()
        if title in seen:
            continue
        seen.add(title)
        if title not in links or not ok[title]:
            continue
        kept[title] = d
        if d < depth:
            for t in links[title]:
                if t != title:
                    found.add((title, t))
                    queue.append((t, d + 1))
    return kept, {(a, b) for a, b in found if a in kept and b in kept}


def test_crawl_equals_queue(spark):
    rng = random.Random(4)
    names = [f"P{i}" for i in range(14)]
    links = {n: rng.sample(names, rng.randint(0, 3)) for n in names[:12]}
    ok = {n: rng.random() < 0.8 for n in links}
    pages = spark.createDataFrame([(n, links[n], ok[n]) for n in links], "title string, links array<string>, good boolean")
    found, e = crawl.crawl(pages, nodes(spark, names[:2]), 2, None, F.col("good"))
    kept, expected = model_crawl(links, ok, names[:2], 2)
    assert {r["title"]: r["depth"] for r in found.collect()} == kept
    assert {(r["source"], r["target"]) for r in e.collect()} == expected


def test_measures_on_known_graphs(spark):
    path = edges(spark, [("a", "b", "t"), ("b", "c", "t")])
    n = nodes(spark, ["a", "b", "c", "z"])
    assert scores(graph.betweenness(n, path), "score") == {"a": 0.0, "b": 1.0, "c": 0.0, "z": 0.0}
    assert scores(graph.degree(n, path), "degree") == {"a": 1.0, "b": 2.0, "c": 1.0, "z": 0.0}
    triangle = edges(spark, [("a", "b", "t"), ("b", "c", "t"), ("c", "a", "t"), ("a", "b", "u"), ("c", "d", "t")])
    assert scores(graph.clustering(nodes(spark, "abcd"), triangle), "coefficient") == {"a": 1.0, "b": 1.0, "c": 0.333333, "d": 0.0}
    assert {r["title"]: r["distance"] for r in graph.shortest_distances(n, path, "a", 5).collect()} == {"a": 0, "b": 1, "c": 2}


def test_louvain_finds_two_cliques(spark):
    rows = [(x, y, "t") for group in ("abcd", "wxyz") for i, x in enumerate(group) for y in group[i + 1 :]] + [("d", "w", "t")]
    found, reached = graph.louvain(nodes(spark, "abcdwxyz"), edges(spark, rows))
    by = collections.defaultdict(set)
    for r in found.collect():
        by[r["community"]].add(r["title"])
    assert sorted(map(sorted, by.values())) == [list("abcd"), list("wxyz")]
    assert reached > 0.4


def test_retrieval_text_and_fallback(spark):
    n = spark.createDataFrame([("Gia Long", "Vua đầu"), ("Minh Mạng", None)], "title string, summary string")
    e = edges(spark, [("Gia Long", "Minh Mạng", "LÀ_CHA_CỦA"), ("Gia Long", "Minh Mạng", R.GENERIC)])
    assert retrieve.context(n, e, "SUMMARY", "gia long").endswith("Vua đầu")
    assert retrieve.context(n, e, "SUMMARY", "minh mạng") == "- Minh Mạng --[LÀ_CHA_CỦA]--> Gia Long"
    assert retrieve.context(n, e, "RELATION", "minh mạng", 2) == "Gia Long --[LÀ_CHA_CỦA]--> Minh Mạng"
    assert retrieve.context(n, e, "RELATION", "nobody") is None


def test_questions_and_labels(spark):
    out = questions.yes_no_items(edges(spark, [("A", "B", "LÀ_CHA_CỦA")])).collect()
    assert [r["expected_answer"] for r in out] == ["Đúng", "Sai"] and "là cha của" in out[0]["question"]
    pairs = spark.createDataFrame([("A", "B", "s"), ("A", "C", "bad")], "source string, target string, sentence string")

    def make():
        def first(s, t, sentence):
            if sentence == "bad":
                raise RuntimeError
            return "vua x"

        return [first, lambda s, t, sentence: "LIEN_KET"]

    labelled = questions.labelled(pairs, make)
    assert {r["target"]: r["label"] for r in labelled.collect()} == {"B": "VUA", "C": "LIEN_KET"}
    assert questions.useful_labels(labelled).count() == 1
    answer = spark.createDataFrame([('x {"intent":"SUMMARY","keyword":"k","hops":2} y', "q"), ("junk", "q")], "a string, q string")
    assert [tuple(r["r"]) for r in answer.select(questions.route(F.col("a"), F.col("q")).alias("r")).collect()] == [("SUMMARY", "k", 2), ("RELATION", "q", 1)]


def test_infobox_edges_and_labels(spark):
    n = spark.createDataFrame([("Gia Long", {"Phối ngẫu 2": "Tống Thị [1]<br>Trần  Thị (mất)", "sinh": "1762"}, "Thông tin vua")], "title string, infobox map<string,string>, template string")
    out = infobox.infobox_edges(n, [("phối ngẫu", "PHỐI_NGẪU_VỚI")])
    assert sorted(r["target"] for r in out.collect()) == ["Trần Thị", "Tống Thị"]
    assert infobox.labelled_nodes(n, [("Vua", ["vua"]), ("Khác", ["x"])]).first()["label"] == "Vua"


def test_files_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("A", 'B, "b"', "t", ""), ("C", "D", "t", 'say "x"\nline')], "source string, target string, type string, evidence string")
    writers.csv_edges(e, str(tmp_path / "e"), True)
    assert sorted(map(tuple, readers.csv_edges(spark, str(tmp_path / "e"), True).collect())) == sorted(map(tuple, e.collect()))
    (tmp_path / "a.jsonl").write_text('{"title": "A", "page_id": "7", "text": "x"}\n\nnot json\n{"title": "B", "page_id": 8}\n')
    rows = readers.json_lines(spark, str(tmp_path / "a.jsonl"), "title string, page_id long, text string, source string").collect()
    assert [(r["title"], r["page_id"]) for r in rows] == [("A", 7), ("B", 8)]
    (tmp_path / "n.json").write_text(json.dumps([{"page_id": 1, "title": "A", "infobox": {"k": "v"}}]))
    n = readers.json_array(spark, str(tmp_path / "n.json"), "page_id long, title string, infobox map<string,string>")
    assert writers.bulk_nodes(n.withColumn("label", F.lit(None).cast("string"))).first()["infobox"] == '{"k":"v"}'
    writers.json_array(n, str(tmp_path / "out"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("part-*")))[0]["title"] == "A"
    (tmp_path / "dump.xml").write_text('<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/"><page><title>A</title><id>3</id><revision><text>hello</text></revision></page><page><title>B</title><id>4</id><revision><text/></revision></page></mediawiki>')
    assert [tuple(r) for r in readers.xml_pages(spark, str(tmp_path / "dump.xml"), [3, 4]).collect()] == [(3, "A", "hello")]
    with pytest.raises(readers.MissingInput):
        readers.csv_edges(spark, str(tmp_path / "none"))
    spark.range(3).write.parquet(str(tmp_path / "t"))
    writers.replaced(spark.read.parquet(str(tmp_path / "t")).where("id > 0"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_offline_pages_and_summaries(spark):
    pages = spark.createDataFrame([("A", "x"), ("B", " "), ("C", "y")], "title string, wikitext string")
    redirects = spark.createDataFrame([("a", "A")], "source string, target string")
    assert [r["title"] for r in readers.pages_of(pages, nodes(spark, ["a", "B", "Q"]), redirects).collect()] == ["A"]
    n = spark.createDataFrame([("A", ""), ("B", "has"), ("C", None)], "title string, summary string")
    s = spark.createDataFrame([("A", " one\ntwo "), ("B", "new")], "title string, summary string")
    assert {r["title"]: r["summary"] for r in load.filled_summaries(n, s).collect()} == {"A": "one two", "B": "has", "C": ""}


def test_stream_of_mentions(spark, tmp_path):
    from weftgraph.streaming import mentions

    rows = spark.createDataFrame([("d1", "about Alpha"), ("d2", "alpha again"), ("d1", "about Alpha")], "title string, text string")
    rows.write.parquet(str(tmp_path / "in"))
    titles = spark.createDataFrame([("alpha", "Alpha")], "lowered string, title string")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = mentions.append_to(mentions.mention_stream(stream, titles, "M"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted((r["source"], r["target"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("d1", "Alpha"), ("d2", "Alpha")]


def test_keyword_titles_beyond_the_limit_keep_short_titles(spark):
    articles = spark.createDataFrame([("a1", "Key and ox, oxen, é at last"), ("a2", "no word"), ("a3", "key"), ("x", "key x")], "title string, text string")
    titles = spark.createDataFrame([(t, t.upper()) for t in ("ox", "oxen", "é", "last", "x", "absent", "key")], "lowered string, title string")
    rows = lambda limit: sorted(map(tuple, enrich.keyword_titles(articles, titles, {"key": "K"}, limit=limit).collect()))
    assert rows(2) == rows(100) and len(rows(2)) == 9


def test_a_parent_of_unknown_gender_is_a_father(spark):
    from weftgraph.functions import rule_tables as R
    from weftgraph.operators import typing

    edges = spark.createDataFrame([("A", "B")], "source string, target string")
    articles = spark.createDataFrame([("A", "A là con trai của B.")], "title string, text string")
    found = {(r["source"], r["target"], r["type"]) for r in typing.typed_edges(edges, articles, R.RULES_A, R.INVERSE_A).collect()}
    assert found == {("A", "B", "LÀ_CON_CỦA"), ("B", "A", "LÀ_CHA_CỦA")}
