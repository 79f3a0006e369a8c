"""Toxicity by class-conditional Kneser-Ney models over the beginnings of words, in distributed tables.

A text is its words: runs of letters and digits, or of other signs, in lower case, nothing folded.  A word
is spelt in steps: its first ``CUTS[0]`` letters, then letter by letter, then all that is left and its end.
Each step is predicted from all letters before it; the probability of a word is the product of its steps.

* All counts are rows of tables keyed by the real beginning of a word (and by the word), so what is gathered
  grows with the labelled corpus; no task and no driver holds a table.
* The pooled model of both classes discounts its counts and falls back on Kneser-Ney's continuation counts:
  after how many beginnings a step is seen.  Each class discounts its own counts and falls back on the pooled
  probability with ``PRIOR`` more counts' weight, so what a class has rarely seen says nothing.
* A word's evidence is its log-ratio under the two models.  A word that no labelled row has is judged by its
  longest beginning of ``LADDER`` letters that one has.  Ratios below ``LEAST`` are noise and count as 0; none
  counts more than ``MOST_RATIO``.
* A text's evidence is the mean ratio over its words, the means of its 1, 2, 4 and 8 most toxic words, and its
  length.  A logistic curve over these turns evidence into a score.  It is fitted on at most ``CALIBRATION_ROWS``
  labelled rows, each scored by models of the other half of the labelled rows.

Words that say something and make up ``1 / COMMON`` of the corpus or more (so at most ``COMMON`` of them) are
looked up in the tasks.  All others pass a filter of ``FILTER_BITS`` bits, which lets every word that says
something through and few that don't, and are joined.  Ratios are summed as whole millionths, so that no
order of rows shows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import documents, forget, small_enough, stored, text_or_empty

CUTS = (2, 3, 4, 5, 6, 7, 8)
#: Beginnings that judge words of no labelled row, the longer ones first.
LADDER = (6, 4)
PRIOR = 20.0
LEAST, MOST_RATIO = 1.0, 5.0
TOPS = (1, 2, 4, 8)
MOST = max(TOPS)
COMMON = 50_000
FILTER_BITS = 1 << 26
UNIT = 1e6
CALIBRATION_ROWS = 20_000
#: Labels, or texts to reject, up to so many rows (some 100 MB when broadcast) are joined by broadcast, more by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Steps (letters, or what is left of a word) that are joined by broadcast, some 100 MB; letters are never more.
BROADCAST_STEPS = 2_000_000
THRESHOLD = 0.7
#: The labelled rows that a model learns from: half 0, half 1, all.
SETS = (0, 1, 2)
#: Words that a task holds before it passes counts on, or remembers the filter's answer for; rows of a batch.
HELD, BATCH = 200_000, 50_000
#: Stands for the end of a word; no word holds white space.
END = "\n"
TOKEN = re.compile(r"\w+|[^\w\s]+")
COUNTS = ("o0", "o1", "t0", "t1")
CLASSES = tuple(f"{c}{k}" for k in SETS for c in "ot")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _half(id_col: str = "doc_id") -> Column:
    return (F.floor(F.crc32(F.col(id_col).cast("string")) / 3) % 2).cast("int")


def known_labels(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """label_id, toxic, half, chosen (calibrates the curve) of the ids of ``docs`` that may be learnt from.

    Of contradicting labels toxic wins.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("label_id")).agg((F.max(F.col(label_col).cast("int")) > 0).cast("int").alias("toxic"))
    known = stored(known.join(docs.select(F.col(id_col).cast("long").alias("label_id")), "label_id", "left_semi"), "toxicity-labels")
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id").limit(CALIBRATION_ROWS).select("label_id", F.lit(True).alias("chosen"))
    return known.join(F.broadcast(chosen), "label_id", "left").select("label_id", "toxic", _half("label_id").alias("half"), F.coalesce("chosen", F.lit(False)).alias("chosen"))


def labelled(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, held_out, text_hash, toxic and half (-1: not learnt from), chosen, text of every row of ``docs``."""
    text = text_or_empty(text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    none = F.lit(-1)
    return rows.join(small_enough(known, BROADCAST_LABELS), F.col("doc_id") == F.col("label_id"), "left").select(
        "row", "doc_id", "held_out", "text_hash", F.coalesce("toxic", none).alias("toxic"), F.coalesce("half", none).alias("half"), F.coalesce("chosen", F.lit(False)).alias("chosen"), "text"
    )


def word_counts(texts: DataFrame) -> DataFrame:
    """word, uses, and how often labelled rows have it, by class and half: o0, o1, t0, t1; over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {k: Counter() for k in range(5)}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for k, counter in held.items():
                words = list(counter)
                for lo in range(0, len(words), BATCH):
                    part = words[lo : lo + BATCH]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(part), pa.int32()), pa.array(part, pa.string()), pa.array([counter[w] for w in part], pa.int64())], ["k", "word", "n"])
                counter.clear()

        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counter = held[k]
                before = len(counter)
                counter.update(tokens(text.as_py()))
                size += len(counter) - before
                if size > HELD:
                    yield from rows()
                    size = 0
        yield from rows()

    found = texts.select(F.when(F.col("toxic") < 0, 4).otherwise(2 * F.col("toxic") + F.col("half")).alias("k"), "text").mapInArrow(run, "k int, word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("uses"), *[F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(name) for k, name in enumerate(COUNTS)])


def count_of(name: str, prefix: str = "") -> Column:
    """A class's count of a set, or of both classes (``n``), from the four that tables hold."""
    c, k = name[0], int(name[1])
    kinds = "ot" if c == "n" else c
    parts = [F.col(f"{prefix}{a}{h}") for a in kinds for h in ((0, 1) if k == 2 else (k,))]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


MODELS = (*CLASSES, "n2")


def beginnings(deeper: DataFrame, cut: int) -> DataFrame:
    """x (the first ``cut`` letters), counts, and of how many kinds what follows is (``k_...``)."""
    return deeper.groupBy(F.substring("x", 1, cut).alias("x")).agg(*[F.sum(c).alias(c) for c in COUNTS], *[F.count_if(count_of(m) > 0).alias(f"k_{m}") for m in MODELS])


def discounts(levels: dict[int, DataFrame]) -> dict[int, dict[str, float]]:
    """The absolute discount of each level and model, from how many steps were seen once and twice."""
    rows = None
    for cut, level in levels.items():
        steps = level.where(F.length("x") > before(cut)).agg(*[F.count_if(count_of(m) == n).alias(f"{m}_{n}") for m in MODELS for n in (1, 2)], F.count("*").alias("steps")).select(F.lit(cut).alias("cut"), "*")
        rows = steps if rows is None else rows.unionByName(steps)
    found = {}
    for r in rows.collect():
        found[r["cut"]] = {m: r[f"{m}_1"] / (r[f"{m}_1"] + 2 * r[f"{m}_2"]) if r[f"{m}_1"] else 0.5 for m in MODELS} | {"steps": float(r["steps"])}
    return found


#: The level of whole words.
WHOLE = 1 << 30


def before(cut: int) -> int:
    """How many letters the level before has."""
    return CUTS[-1] if cut == WHOLE else 0 if cut == CUTS[0] else CUTS[CUTS.index(cut) - 1]


def after(cut: int) -> int:
    return WHOLE if cut == CUTS[-1] else CUTS[CUTS.index(cut) + 1]


def pooled_step(d: dict[str, float]) -> Column:
    """The pooled model's probability of a step: discounted count, and continuation for the rest."""
    return (F.greatest(count_of("n2") - d["n2"], F.lit(0.0)) + F.lit(d["n2"]) * F.col("h_k_n2") * F.col("contexts") / d["steps"]) / count_of("n2", "h_")


def class_step(m: str, d: dict[str, float]) -> Column:
    return (F.greatest(count_of(m) - d[m], F.lit(0.0)) + (PRIOR + F.lit(d[m]) * F.col(f"h_k_{m}")) * F.col("pooled")) / (count_of(m, "h_") + PRIOR)


def spelt(level: DataFrame, cut: int, shorter: DataFrame | None, d: dict[str, float]) -> DataFrame:
    """``level`` with r0, r1, r2: the log-ratio of all steps up to it; ``shorter``: the level before, with its own."""
    carried = ["h_x", *[f"h_{c}" for c in COUNTS], *[f"h_k_{m}" for m in MODELS], *[f"h_r{k}" for k in SETS]]
    step = F.expr(f"substring(x, {before(cut) + 1})")
    made = level.where(F.length("x") > before(cut))
    units = made.groupBy(step.alias("step")).agg(F.count("*").alias("contexts"))
    if shorter is None:
        whole = level.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"h_{c}") for c in COUNTS], *[F.count_if(count_of(m) > 0).alias(f"h_k_{m}") for m in MODELS]).first()
        joined = level.withColumns({c: F.lit(whole[c]) for c in carried[1:-3]} | {f"h_r{k}": F.lit(0.0) for k in SETS})
    else:
        context = shorter.select(*[F.col(c[2:]).alias(c) for c in carried])
        joined = level.join(context, F.substring("x", 1, before(cut)) == F.col("h_x"))
    joined = joined.withColumn("step", step).join(small_enough(units, BROADCAST_STEPS), "step", "left").withColumn("pooled", pooled_step(d))
    # A word that ended before has no further step.
    ratio = lambda k: F.when(F.length("x") > before(cut), F.log(class_step(f"t{k}", d) / class_step(f"o{k}", d))).otherwise(0.0)
    return joined.select(*level.columns, *[(F.col(f"h_r{k}") + ratio(k)).alias(f"r{k}") for k in SETS])


def gone_on(level: DataFrame, cut: int, d: dict[str, float]) -> DataFrame:
    """x, e0, e1, e2: the log-ratio of a beginning and one more step that no labelled row has."""
    rest = lambda m: (PRIOR + F.lit(d[m]) * F.col(f"k_{m}")) / (count_of(m) + PRIOR)
    return level.select(F.col("x").alias(f"x{cut}"), *[(F.col(f"r{k}") + F.log(rest(f"t{k}") / rest(f"o{k}"))).alias(f"e{k}_{cut}") for k in SETS])


def word_ratios(counted: DataFrame) -> DataFrame:
    """word, uses, r0, r1, r2 (millionths, under the models of half 0, half 1, all) of the words that say something."""
    seen = F.col("o0") + F.col("o1") + F.col("t0") + F.col("t1") > 0
    levels = {WHOLE: counted.where(seen).select(F.concat("word", F.lit(END)).alias("x"), *COUNTS)}
    for cut in reversed(CUTS):
        levels[cut] = stored(beginnings(levels[after(cut)], cut), "toxicity-level")
    found = discounts(levels)
    now, kept, spent = None, {}, [levels[c] for c in CUTS]
    for cut in (*CUTS, WHOLE):
        now = spelt(levels[cut], cut, now, found[cut])
        if cut in LADDER:
            now = kept[cut] = stored(now, "toxicity-spelt")
            spent.append(now)
    letters = F.concat("word", F.lit(END))
    rs = [f"r{k}" for k in SETS]
    own = counted.where(seen).select("word", "uses", letters.alias("x")).join(now.select("x", *rs), "x").select("word", "uses", *rs)
    others = counted.where(~seen).select("word", "uses", *[F.substring(letters, 1, cut).alias(f"x{cut}") for cut in LADDER])
    for cut in LADDER:
        others = others.join(gone_on(kept[cut], cut, found[after(cut)]), f"x{cut}", "left")
    others = others.select("word", "uses", *[F.coalesce(*[F.col(f"e{k}_{cut}") for cut in LADDER], F.lit(0.0)).alias(f"r{k}") for k in SETS])
    bounded = [F.when(F.col(r) >= LEAST, F.round(UNIT * F.least(F.col(r), F.lit(MOST_RATIO)))).otherwise(0).cast("long").alias(r) for r in rs]
    out = stored(own.unionByName(others).where(F.greatest(*rs) >= LEAST).select("word", "uses", *bounded), "toxicity-words")
    for table in spent:
        forget(table)
    return out


@dataclass(frozen=True)
class Words:
    """The words that say something, those of them that tasks look up, and the filter that all of the others pass."""

    ratios: DataFrame
    common: dict[str, tuple[int, int, int]]
    passing: np.ndarray


def indexed(ratios: DataFrame, uses: int) -> Words:
    often = F.col("uses") > F.lit(uses / COMMON)
    common = {r["word"]: (r["r0"], r["r1"], r["r2"]) for r in ratios.where(often).collect()}
    bit = F.xxhash64("word").bitwiseAND(F.lit(FILTER_BITS - 1))
    # At most FILTER_BITS / 64 rows, however many words there are.
    rows = ratios.where(~often).groupBy(F.shiftright(bit, 6).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(xxhash64(word) & 63 as int))")).alias("bits")).toArrow()
    passing = np.zeros(FILTER_BITS // 64, np.int64)
    passing[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return Words(ratios.where(~often), common, passing.view(np.uint64))


ROW = "row long, word string, n int, doc_id long, held_out boolean, text_hash long, label int, half int, tokens long, total long, top array<long>, half_total long, half_top array<long>"


def evidence(texts: DataFrame, words: Words) -> DataFrame:
    """doc_id, held_out, text_hash, label (-1: no part in calibration), tokens, total, top, half_total, half_top.

    One row a row of ``texts``; totals and the most toxic words' ratios are in millionths, under the model of
    all and, for calibration, under that of the other half.
    """
    shared = texts.sparkSession.sparkContext.broadcast((words.common, words.passing))
    names = [f.split(" ")[0] for f in ROW.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, passing = shared.value
        #: What a word says: its ratios; True if the join decides; False if nothing.
        answers: dict[str, tuple[int, int, int] | bool] = dict(common)
        out: list[tuple] = []

        def answer(word: str) -> bool:
            b = xxhash.xxh64_intdigest(word.encode(), 42) & (FILTER_BITS - 1)
            found = bool(int(passing[b >> 6]) >> (b & 63) & 1)
            answers[word] = found
            return found

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for row, doc_id, held, text_hash, toxic, half, chosen, text in zip(*[batch.column(i).to_pylist() for i in range(7)], batch.column(7), strict=True):
                found = tokens(text.as_py())
                hits, rare = [], Counter()
                for word, says in zip(found, map(answers.get, found), strict=True):
                    if says is None:
                        says = answer(word)
                    if says is True:
                        rare[word] += 1
                    elif says is not False:
                        hits.append(says)
                other = 1 - half if chosen else 2
                top = lambda k, hits=hits: sorted((h[k] for h in hits), reverse=True)[:MOST]
                # A blank is never in a word, so this row finds no partner; its number keeps such rows apart.
                out.append((row, f" {row}", None, doc_id, held, text_hash, toxic if chosen else -1, half, len(found), sum(h[2] for h in hits), top(2), sum(h[other] for h in hits), top(other)))
                out += [(row, word, n, None, None, None, None, half if chosen else -1, None, None, None, None, None) for word, n in rare.items()]
                if len(out) >= BATCH:
                    yield batch_of(out)
                    out = []
            if len(answers) > len(common) + HELD:
                answers = dict(common)
        yield batch_of(out)

    rows = texts.mapInArrow(run, ROW).join(words.ratios.select("word", "r0", "r1", "r2"), "word", "left")
    at_half = F.when(F.col("half") == 0, F.col("r1")).when(F.col("half") == 1, F.col("r0")).otherwise(F.col("r2"))
    times = F.least("n", F.lit(MOST))
    own = lambda total, r: F.coalesce(F.col(total), F.col("n") * r, F.lit(0))
    best = lambda top, r: F.slice(F.sort_array(F.flatten(F.collect_list(F.coalesce(F.col(top), F.when(r.isNotNull(), F.array_repeat(r, times))))), asc=False), 1, MOST)
    return rows.groupBy("row").agg(
        *[F.max(c).alias(c) for c in ("doc_id", "held_out", "text_hash", "label", "tokens")],
        F.sum(own("total", F.col("r2"))).alias("total"),
        best("top", F.col("r2")).alias("top"),
        F.sum(own("half_total", at_half)).alias("half_total"),
        best("half_top", at_half).alias("half_top"),
    ).drop("row")


def features(prefix: str = "") -> list[Column]:
    """Mean over all words, means of the most toxic ones, log of the number of words."""
    size = F.greatest("tokens", F.lit(1))
    tops = [F.aggregate(F.slice(f"{prefix}top", 1, k), F.lit(0).cast("long"), lambda a, x: a + x) / F.lit(UNIT * k) for k in TOPS]
    return [(F.col(f"{prefix}total") / size / F.lit(UNIT)).alias("f0"), *[t.alias(f"f{i + 1}") for i, t in enumerate(tops)], F.log(size.cast("double")).alias(f"f{len(TOPS) + 1}")]


def fit_curve(rows: list[tuple]) -> list[float]:
    """Intercept and weights of the features by ridge-penalised logistic regression."""
    if len({r[0] for r in rows}) < 2:
        # Nothing to tell apart: a score near 0, or near 1 if all that is known is toxic.
        return [4.0 if rows and rows[0][0] else -4.0] + [0.0] * (len(TOPS) + 2)
    y = np.array([r[0] for r in rows], float)
    x = np.column_stack([np.ones(len(rows)), np.array([r[1:] for r in rows], float)])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.01] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def scored(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, text_hash, score, mean_ratio, window_ratio (mean of the most toxic words) of every row.

    A null id is never learnt from.  Labels that are null, or of no document, are ignored.  With labels
    of one class only, or none, the curve is flat.
    """
    known = stored(known_labels(docs, labels, id_col, label_col), "toxicity-known")
    texts = labelled(docs, known, id_col, text_col)
    counted = stored(word_counts(texts), "toxicity-counts")
    ratios = word_ratios(counted)
    words = indexed(ratios, counted.agg(F.sum("uses")).first()[0] or 0)
    forget(counted)
    seen = stored(evidence(texts, words), "toxicity-evidence")
    forget(ratios)
    curve = fit_curve(sorted(tuple(r) for r in seen.where("label >= 0").select("label", *features("half_")).collect()))
    at = F.lit(curve[0])
    for i, w in enumerate(curve[1:]):
        at = at + F.lit(w) * F.col(f"f{i}")
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), at))))
    return seen.select("doc_id", "held_out", "text_hash", *features()).select("doc_id", "held_out", "text_hash", score.alias("score"), F.col("f0").alias("mean_ratio"), F.col(f"f{len(TOPS)}").alias("window_ratio"))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, mean_ratio, window_ratio.

    Null texts score as empty ones; equal texts score alike.  Long texts are read whole, text by text.  A null
    id is not held out.  Further columns of ``docs`` and ``labels`` are not looked at.  No rows in, no rows out.
    """
    found = scored(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "mean_ratio", "window_ratio")


def without_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, as they are.

    Null texts score as empty ones; rows of equal texts stay or go together, null ids among them.
    """
    found = scored(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    toxic = stored(found.where(F.col("score") >= THRESHOLD).select(F.col("text_hash").alias("toxic_hash")).distinct(), "toxicity-toxic")
    return docs.join(small_enough(toxic, BROADCAST_LABELS), F.xxhash64(text_or_empty(text_col)) == F.col("toxic_hash"), "left_anti")


def op1_kneser_ney_toxicity(spark, sf_dir: str) -> DataFrame:
    """``score_toxicity`` over all documents and labels."""
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
