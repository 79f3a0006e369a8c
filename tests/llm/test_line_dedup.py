import random
import time

from pyspark.sql import functions as F

from weftgraph.llm import line_dedup, shared


def shuffled(spark):
    """Bytes that all stages so far have written for others."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    doubles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, doubles, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def links(spark, lines, edits=2):
    df = spark.createDataFrame([(s,) for s in lines], "line string")
    named = {(r["h1"], r["h2"]): r["line"] for r in df.select("line", *line_dedup.line_hashes()).collect()}
    return {frozenset((named[r["a1"], r["a2"]], named[r["b1"], r["b2"]])) for r in line_dedup.near_links(df, edits).collect()}


def test_texts_are_not_shuffled_once_a_probe(spark, monkeypatch):
    """beyond ``BROADCAST_KEYS`` every probe of every line took the line's text through a shuffle."""
    rng = random.Random(1)
    lines = ["".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyz") for _ in range(600)) for _ in range(1500)]
    lines += [f"{line[:9]}!{line[9:-1]}" for line in lines[:40]]
    expected = {frozenset((lines[i], lines[1500 + i])) for i in range(40)}
    assert links(spark, lines) == expected
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        began = shuffled(spark)
        assert links(spark, lines) == expected
        assert shuffled(spark) - began < 3 * sum(map(len, lines))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shuffle_files_go_with_their_query(spark):
    """files of queries long ended stayed on disk until the driver happened to collect its garbage."""
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    began = files()
    found = shared.stored(spark.range(1000).repartition(5, "id"), "numbers", keep_shuffles=False)
    for _ in range(50):
        if files() <= began:
            break
        time.sleep(0.2)
    assert files() <= began
    assert found.count() == 1000 and spark.conf.get(shared.CLEANUP) == "false"


def test_a_line_has_few_keys(spark):
    """Twelve rows a line of any length before."""
    lines = spark.createDataFrame([("ab" * 200)[:n] for n in range(20, 400)], "string").select(F.col("value").alias("line"), F.xxhash64("value").alias("h1"), F.length("value").alias("length"))
    assert line_dedup.keyed(lines, 2, 20).count() < 6.5 * 380


def test_links_across_classes_of_length_equal_all_pairs(spark):
    """Lengths around 20, 28, 148, 180 and 512, edits at both ends, close together and far apart."""
    rng = random.Random(3)

    def edit(s, n):
        for _ in range(n):
            i = rng.choice([0, 1, len(s) // 3, len(s) // 2, len(s) - 1, rng.randrange(len(s))])
            s = rng.choice([s[:i] + s[i + 1 :], f"{s[:i]}é{s[i:]}", f"{s[:i]}ß{s[i + 1 :]}"])
        return s

    base = ["".join(rng.choice("abé ") for _ in range(n)) for n in (20, 21, 22, 27, 28, 29, 30, 36, 147, 148, 149, 150, 180, 181, 512, 513)]
    lines = sorted({edit(b, rng.randint(0, 4)) for b in base for _ in range(9)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, last = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
        return row[-1]

    far = {frozenset((a, b)): distance(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if min(len(a), len(b)) >= 20 and abs(len(a) - len(b)) <= 3}
    for edits in (0, 1, 2, 3):
        assert links(spark, lines, edits) == {pair for pair, d in far.items() if d <= edits}


def test_changed_documents_are_split_once(spark):
    """A document of many lines was split anew for each line it kept."""
    text = "\n".join(f"line number {i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, "the first line"), (2, f"the first line\n \n{text}")], "doc_id long, text string")
    began = time.time()
    found = {r["doc_id"]: r for r in line_dedup.deduplicated(docs).collect()}
    assert found[2]["kept_text"] == f" \n{text}" and (found[2]["n_lines"], found[2]["n_exact"], found[2]["n_near"]) == (20_001, 1, 0)
    assert time.time() - began < 40
