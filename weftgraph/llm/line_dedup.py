"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

A line occurrence goes if an earlier place, by document id and then line number, holds the same line
or one that is within ``edits`` edits; of lines shorter than ``SHORT`` characters only equal ones count, as
two edits make another line of them.  Blank lines stay.

Two lines within ``edits`` edits share at least one of ``edits + 1`` segments of the one that isn't longer
(pigeonhole).  Segments are even for the shortest line of a class of lengths, the last one at the line's end; what
longer lines have between the last two is in no segment.  Every line is indexed by its own segments, and probes the
substrings of itself that can be a segment of a line of its class or, where up to ``edits`` less lead there, of the
class below: for each segment number only the starts that leave room for the edits to its left and right
(multi-match-aware selection over all differences of length).  A key is the hash of class, segment number and substring.

Nearly all keys belong to one line.  Keys are first reduced to the least and the greatest line hash
under them; only where these differ are lines and texts brought together, and the join itself verifies
them, so candidates are never written out.  Keys too many to broadcast meet keys and hashes of lines, without
texts, and only lines found so are fetched.  Verification compares lengths and cuts off equal beginnings and ends; the
rest goes through Spark's ``levenshtein`` with a threshold; a bit-parallel one can't be written in built-in functions at a bearable cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.shared import copy_number, documents, forget, small_enough, stored, text_or_empty

EDITS = 2
SHORT = 20
#: Keys shared by several lines, and hashes of lines, are broadcast up to this number (some 100 MB), else joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Lines with more than ``1 / HOT`` of all places are at most so many.
HOT = 2000
#: A line that isn't blank begins with these and goes on.
BLANKS = " \t\n\x0b\x0c\r"
#: Once in every line that isn't blank: from its first character that isn't blank to its end.
FILLED = r"[^\x20\x09-\x0D][^\n]*"


def probes(edits: int) -> list[tuple[bool, int, int]]:
    """(of the class below, segment number, shift); in a line's own class those without a shift index the line itself.

    Shifts are from where the segment begins in the indexed line, of the last segment from where it ends.
    """
    out = []
    for below in (False, True):
        for i in range(edits + 1):
            low, high = max(-i, below - (edits - i)), i
            if i == edits:
                low = high = 0
            out += [(below, i, shift) for shift in range(low, high + 1)]
    return out


def class_of(length: Column, edits: int, short: int) -> Column:
    """The shortest length of a length's class; classes are four times as wide from ``short`` and 64 edits on."""
    width = 4 * max(edits, 1)
    wide = F.when(length < short + 16 * width, width).otherwise(4 * width)
    return length - (length - short) % wide


def keyed(lines: DataFrame, edits: int, short: int) -> DataFrame:
    """The rows of ``lines`` (line, length) once a key that the line is indexed by (``own``) or probes besides.

    One row a probe, so that one short expression makes all keys: one long one a line would never be compiled.
    """
    as_array = lambda found: F.array(*[F.struct(F.lit(below).alias("below"), F.lit(i).alias("part"), F.lit(shift).alias("shift")) for below, i, shift in found])
    at = class_of(F.col("length"), edits, short)
    classes = lines.select("*", at.alias("at")).select("*", class_of(F.col("at") - 1, edits, short).alias("under"))
    reaches = (F.col("length") - F.col("at") < edits) & (F.col("at") > short)
    each = F.explode(F.when(reaches, as_array(probes(edits))).otherwise(as_array([p for p in probes(edits) if not p[0]])))
    least, k = F.when(F.col("p.below"), F.col("under")).otherwise(F.col("at")), edits + 1
    start = F.floor(F.col("p.part") * least / k).cast("int")
    size = F.floor((F.col("p.part") + 1) * least / k).cast("int") - start
    begin = F.when(F.col("p.part") == edits, F.col("length") - size).otherwise(start) + F.col("p.shift")
    own = ~F.col("p.below") & (F.col("p.shift") == 0)
    return classes.select("*", each.alias("p")).select(*lines.columns, F.xxhash64(least, "p.part", F.substring("line", begin + 1, size)).alias("key"), own.alias("own"))


def filled(line: Column) -> Column:
    """Whether a line isn't blank."""
    return F.ltrim(line, F.lit(BLANKS)) != ""


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, doc_hash, line_no, line for every line that isn't blank."""
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("doc_hash"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return texts.where(filled(F.col("line")))


def place() -> Column:
    """What orders occurrences; null ids are last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc_hash", "line_no")


def line_hashes(line: str = "line") -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), F.col(line)).alias("h2")]


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two different lines are within ``edits`` edits.

    Spark's distance walks a whole line for each character of the other.  So what lines begin and end with alike is
    cut off first, and what follows must begin alike but for the edits.
    """
    steps = lambda top: F.array(*[F.lit(1 << i) for i in range(top, -1, -1)])
    window = 8 * edits

    def alike(x: Column, y: Column) -> Column:
        sizes = F.when(F.length(x) < 512, steps(8)).otherwise(steps(15))
        return F.aggregate(sizes, F.lit(0), lambda n, size: F.when(F.substring(x, n + 1, size) == F.substring(y, n + 1, size), n + size).otherwise(n))

    def cut(x: Column, y: Column, then) -> Column:
        """``then`` of both without what they begin with alike; ``exists`` over one row names what is used twice."""
        rest = lambda n: F.struct(F.substring(x, n + 1, F.length(x)).alias("x"), F.substring(y, n + 1, F.length(y)).alias("y"))
        near = lambda r: F.exists(F.array(*[F.lit(d) for d in range(-edits, edits + 1)]), lambda d: F.levenshtein(F.left(r["x"], F.lit(window)), F.left(r["y"], window + d), edits) >= 0)
        return F.exists(F.transform(F.array(alike(x, y)), rest), lambda r: near(r) & then(r["x"], r["y"]))

    return cut(a, b, lambda x, y: F.exists(F.array(F.struct(F.reverse(x).alias("x"), F.reverse(y).alias("y"))), lambda r: cut(r["x"], r["y"], lambda v, w: F.levenshtein(v, w, edits) >= 0)))


def candidates(lines: DataFrame, edits: int, short: int) -> DataFrame:
    """key, h1, h2, line, length, own for every line (h1, h2, line, length) under a key that another line has too."""
    keys = keyed(lines.drop("h2"), edits, short)
    shared = keys.groupBy("key").agg(F.min("h1").alias("least"), F.max("h1").alias("most")).where("least <> most").select("key")
    shared = stored(shared, "line-keys", keep_shuffles=False)
    names = ["key", "h1", "h2", "line", "length", "own"]
    if shared.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        rows = keyed(lines, edits, short).join(F.broadcast(shared), "key", "left_semi").select(*names)
        found = stored(rows.distinct(), "line-candidates", keep_shuffles=False)
    else:
        # Texts times probes would be several times the input, so keys and hashes meet first.
        hits = stored(keys.select("key", "h1", "own").join(shared.hint("shuffle_hash"), "key", "left_semi"), "line-hits", keep_shuffles=False)
        hashes = stored(hits.select("h1").distinct(), "line-hit-hashes", keep_shuffles=False)
        texts = stored(lines.join(small_enough(hashes, BROADCAST_KEYS), "h1", "left_semi").distinct(), "line-hit-texts", keep_shuffles=False)
        found = stored(hits.distinct().join(texts, "h1").select(*names), "line-candidates", keep_shuffles=False)
        for done in (hits, hashes, texts):
            forget(done)
    forget(shared)
    return found


def near_links(lines: DataFrame, edits: int = EDITS, short: int = SHORT) -> DataFrame:
    """(a1, a2, b1, b2): hashes of different lines (``line``) within ``edits`` edits, each pair once."""
    rows = candidates(lines.select(*line_hashes(), "line", F.length("line").alias("length")).where(F.col("length") >= short), edits, short)
    a = rows.where("own").select("key", F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("line").alias("a"), F.col("length").alias("a_length"))
    b = rows.select("key", F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("b"), F.col("length").alias("b_length"))
    differ = (F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2"))
    close = (F.abs(F.col("a_length") - F.col("b_length")) <= edits) & within(F.col("a"), F.col("b"), edits)
    pairs = a.join(b, (a["key"] == b["key"]) & differ & close).select("a1", "a2", "b1", "b2")
    turned = F.struct("a1", "a2") > F.struct("b1", "b2")
    names = [F.when(turned, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("b1", "a1"), ("b2", "a2"), ("a1", "b1"), ("a2", "b2"))]
    links = stored(pairs.select(*names).distinct(), "line-links", keep_shuffles=False)
    forget(rows)
    return links


def dropped_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, short: int = SHORT) -> DataFrame:
    """doc_id, doc_hash, line_no, near (dropped for a near line, not an equal one) of occurrences that go."""
    lines = lines_of(docs, id_col, text_col)
    links = near_links(lines, edits, short)
    spots = stored(lines.select("doc_id", "doc_hash", "line_no", *line_hashes()), "line-places", keep_shuffles=False)
    first = stored(spots.groupBy("h1", "h2").agg(F.min(place()).alias("first"), F.count("*").alias("n")), "line-first", keep_shuffles=False)
    both = links.unionByName(links.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2")))
    of_a = first.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("first").alias("first_a"))
    of_b = first.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("first").alias("first_b"))
    later = both.join(of_a, ["a1", "a2"]).join(of_b, ["b1", "b2"]).where("first_b < first_a").select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).distinct().withColumn("is_near", F.lit(True))
    # Lines that occur once and have no earlier near line need no second look.
    judged = first.join(later, ["h1", "h2"], "left").where("n > 1 or is_near").select("h1", "h2", "n", "first", F.coalesce("is_near", F.lit(False)).alias("is_near"))
    judged = stored(judged, "line-judged", keep_shuffles=False)
    # Very common lines are few by arithmetic and meet their places by broadcast; no other line has many places.
    hot = F.col("n") > F.lit((first.agg(F.sum("n")).first()[0] or 0) / HOT)
    common = F.broadcast(judged.where(hot))
    at_first = place() == F.col("first")
    met = spots.join(common, ["h1", "h2"]).unionByName(spots.join(common.select("h1", "h2"), ["h1", "h2"], "left_anti").join(judged.where(~hot), ["h1", "h2"]))
    return met.where(F.col("is_near") | ~at_first).select("doc_id", "doc_hash", "line_no", at_first.alias("near"))


def judged_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, short: int = SHORT) -> DataFrame:
    """The rows of ``docs`` with ``__kept_text``, ``__n_lines``, ``__n_exact``, ``__n_near``."""
    gone = (
        dropped_lines(docs, id_col=id_col, text_col=text_col, edits=edits, short=short)
        .groupBy("doc_id", "doc_hash")
        .agg(F.collect_set("line_no").alias("__gone"), F.size(F.collect_set(F.when(F.col("near"), F.col("line_no")))).alias("__gone_near"))
        .select(F.coalesce("doc_id", F.lit(0).cast(docs.schema[id_col].dataType)).alias("__id"), F.col("doc_id").isNull().alias("__no_id"), F.col("doc_hash").alias("__hash"), "__gone", "__gone_near")
    )
    # Window and join deal rows out by the same keys, so repeated rows are numbered without a shuffle of their own.
    key = ["__id", "__no_id", "__hash"]
    hashed = docs.select("*", F.coalesce(F.col(id_col), F.lit(0).cast(docs.schema[id_col].dataType)).alias("__id"), F.col(id_col).isNull().alias("__no_id"), F.xxhash64(text_or_empty(text_col)).alias("__hash"))
    joined = hashed.withColumn("__copy", copy_number(docs, key, id_col, text_col)).join(gone, key, "left")
    repeated = F.col("__copy") > 1
    # Texts that change are split once, in a column of its own: within a lambda they would be split once a line.
    joined = joined.withColumn("__lines", F.when(repeated | F.col("__gone").isNotNull(), F.split(F.col(text_col), "\n", -1)))
    lines = F.col("__lines")
    # By a set difference, not by a search a line: documents may have very many lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    kept = F.when(repeated, F.filter(lines, lambda x: ~filled(x))).otherwise(F.transform(stay, lambda i: F.get(lines, i)))
    n_lines = F.coalesce(F.regexp_count(F.col(text_col), F.lit(FILLED)), F.lit(0)).cast("long")
    n_gone = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")
    n_near = F.coalesce("__gone_near", F.lit(0)).cast("long")
    return joined.select(
        *docs.columns,
        F.when(F.col("__gone").isNull() & ~repeated, F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias("__kept_text"),
        n_lines.alias("__n_lines"),
        F.when(repeated, n_lines).otherwise(n_gone - n_near).alias("__n_exact"),
        F.when(repeated, 0).otherwise(n_near).cast("long").alias("__n_near"),
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with ``kept_text``, ``n_lines``, ``n_exact``, ``n_near`` (lines that went).

    A null text has the kept text null and no lines.  Of rows with the same id and the same text one
    keeps what is kept, the others lose all lines that aren't blank.  Rows with a null id count as the
    last documents.  Long texts are split whole.  Further columns of ``docs`` are kept, but for any of the four
    names, and names that begin with two underscores must not be used.  No rows in, no rows out.
    """
    new = ("kept_text", "n_lines", "n_exact", "n_near")
    found = judged_rows(docs, **options)
    return found.select(*[c for c in docs.columns if c not in new], *[F.col(f"__{c}").alias(c) for c in new])


def with_kept_lines(docs: DataFrame, *, chars_col: str = "n_chars", **options) -> DataFrame:
    """The columns of ``docs`` with texts of kept lines only, and their length in ``chars_col`` if there is one.

    Documents all of whose lines went are left out; blank and null texts stay.  All else as :func:`deduplicated`.
    """
    text_col = options.get("text_col", "text")
    left = judged_rows(docs, **options).where("__n_lines = 0 or __n_lines > __n_exact + __n_near")
    length = F.when(F.col("__kept_text").isNull(), F.col(chars_col)).otherwise(F.length("__kept_text").cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else None
    new = {text_col: F.col("__kept_text"), chars_col: length}
    return left.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """``deduplicated`` over all documents, the kept text as a digest."""
    found = deduplicated(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i AS line_no, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, range(1, len(string_split(coalesce(text, ''), chr(10))) + 1) r(i)),
filled AS (SELECT * FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
first AS (SELECT line, min(row(doc_id, line_no)) AS place FROM filled GROUP BY line),
long AS (SELECT line, place, length(line) AS n FROM first WHERE length(line) >= 20),
own AS (SELECT line, place, n, k, substr(line, 1 + (k * n) // 3, ((k + 1) * n) // 3 - (k * n) // 3) AS seg FROM long, range(3) t(k)),
probes AS (
  SELECT line, place, n - less AS n, k, substr(line, 1 + (k * (n - less)) // 3 + shift, ((k + 1) * (n - less)) // 3 - (k * (n - less)) // 3) AS seg
  FROM long, range(3) t(k), range(3) d(less), range(-2, 3) s(shift)
  WHERE (k * (n - less)) // 3 + shift >= 0),
pairs AS (
  SELECT DISTINCT a.line AS a, b.line AS b, a.place AS pa, b.place AS pb
  FROM own a JOIN probes b ON a.n = b.n AND a.k = b.k AND a.seg = b.seg AND a.line <> b.line),
near AS (SELECT * FROM pairs WHERE levenshtein(a, b) <= 2),
later AS (SELECT a AS line FROM near WHERE pb < pa UNION SELECT b FROM near WHERE pa < pb),
judged AS (
  SELECT f.doc_id, f.line_no, row(f.doc_id, f.line_no) = first.place AS at_first, later.line IS NOT NULL AS is_near
  FROM filled f JOIN first ON f.line = first.line LEFT JOIN later ON f.line = later.line),
kept AS (
  SELECT l.doc_id,
         count(at_first) AS n_lines,
         count(CASE WHEN NOT at_first THEN 1 END) AS n_exact,
         count(CASE WHEN at_first AND is_near THEN 1 END) AS n_near,
         coalesce(string_agg(line, chr(10) ORDER BY l.line_no) FILTER (WHERE at_first IS NULL OR at_first AND NOT is_near), '') AS kept_text
  FROM lines l LEFT JOIN judged j ON l.doc_id = j.doc_id AND l.line_no = j.line_no
  GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_exact, n_near, sha256(kept_text) AS kept_sha256 FROM kept
"""
