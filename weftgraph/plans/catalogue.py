"""Registered queries over the driver's tables, and the SQL that each is held against.

Every query runs over whole tables.  Limits stand only where a top list is what is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import schema as S
from weftgraph import storage
from weftgraph.functions import rule_tables as R
from weftgraph.functions import text as T
from weftgraph.functions.rules import first_match
from weftgraph.operators import crawl, enrich, graph, infobox, load, questions, retrieve, typing
from weftgraph.plans import inputs as I
from weftgraph.plans.inputs import SQL_ANCHORS, SQL_ARTICLES, SQL_NATIONS, SQL_TITLES, SQL_TRADE, sql_any, sql_case, sql_sentences
from weftgraph.sources import readers, writers

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# --- sentences and mentions -------------------------------------------------------------------------


@registered(f"""
WITH s AS (SELECT doc_id, {sql_sentences("text", True)} AS a, {sql_sentences("text", False)} AS b FROM documents)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_strict, CAST(len(b) AS BIGINT) AS n_plain, md5(array_to_string(a, chr(2))) AS strict_md5, md5(array_to_string(b, chr(2))) AS plain_md5 FROM s
""")
def sentence_split(spark, d) -> DataFrame:
    """Both sentence splits of every document."""
    s = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.sentences_strict(F.col("text")).alias("a"), T.sentences(F.col("text")).alias("b"))
    join = lambda c: F.md5(F.array_join(c, "\x02"))
    return s.select("doc_id", F.size("a").cast("long").alias("n_strict"), F.size("b").cast("long").alias("n_plain"), join("a").alias("strict_md5"), join("b").alias("plain_md5"))


@registered(f"""
WITH {SQL_ARTICLES}, {SQL_TITLES}
SELECT DISTINCT a.title AS source, t.title AS target, 'MENTIONS' AS type FROM articles a JOIN titles t ON contains(lower(a.text), t.lowered) WHERE lower(a.title) <> t.lowered
""")
def mention_doc(spark, d) -> DataFrame:
    """Articles that hold a title."""
    return enrich.document_mentions(I.articles(spark, d), I.titles(spark, d), "MENTIONS")


_patterns_sql = " UNION ALL ".join(f"SELECT '{k}' AS kw, '{v}' AS kind" for k, v in I.PATTERNS.items())


@registered(f"""
WITH {SQL_ARTICLES}, {SQL_TITLES}, patterns AS ({_patterns_sql})
SELECT DISTINCT a.title AS source, t.title AS target, p.kind AS type
FROM articles a JOIN patterns p ON contains(lower(a.text), p.kw) JOIN titles t ON contains(lower(a.text), t.lowered)
""")
def keyword_title_cross(spark, d) -> DataFrame:
    """Keyword and title in one article."""
    return enrich.keyword_titles(I.articles(spark, d), I.titles(spark, d), I.PATTERNS)


@registered(f"""
WITH {SQL_ARTICLES}, {SQL_TITLES}, s AS (SELECT title, unnest({sql_sentences("text", False)}) AS sentence FROM articles)
SELECT DISTINCT s.title AS source, t.title AS target, {sql_case("lower(sentence)", I.CLASSES, "MENTIONED")} AS type
FROM s JOIN titles t ON contains(lower(sentence), t.lowered)
""")
def mention_sentence_classify(spark, d) -> DataFrame:
    """Classes of the sentences that hold a title."""
    return enrich.sentence_mentions(I.articles(spark, d), I.titles(spark, d), I.CLASSES, "MENTIONED")


# --- typing ----------------------------------------------------------------------------------------

_order = sorted(I.RULES, key=lambda t: -I.WEIGHTS[t])
_found = sql_case("lower(sentence)", [(I.RULES[t], t) for t in _order], I.GENERIC)
_weight = "CASE type " + " ".join(f"WHEN '{t}' THEN {w}" for t, w in I.WEIGHTS.items()) + " ELSE 1 END"
_SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_line = f"regexp_replace(replace(sentence, chr(10), ' '), '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _votes_sql(found: str = _found) -> str:
    return f"""
{SQL_ARTICLES}, {SQL_TITLES},
pairs AS (SELECT DISTINCT a.title AS source, t.title AS target FROM articles a JOIN titles t ON contains(lower(a.text), t.lowered)),
split AS (SELECT title AS source, {sql_sentences("text", True)} AS l FROM articles WHERE text <> ''),
sentences AS (SELECT source, i - 1 AS pos, l[i] AS sentence FROM split, range(1, len(l) + 1) r(i)),
mentions AS (SELECT p.source, p.target, s.pos, s.sentence FROM pairs p JOIN sentences s ON p.source = s.source WHERE contains(s.sentence, p.target)),
typed AS (SELECT *, {found} AS type FROM mentions),
votes AS (
  SELECT source, target, type, CAST(sum({_weight}) AS BIGINT) AS score, CAST(min(pos) AS INTEGER) AS pos,
         arg_min(CASE WHEN length({_line}) > 200 THEN substr({_line}, 1, 200) || '...' ELSE {_line} END, pos) AS evidence
  FROM typed GROUP BY ALL),
top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY score DESC, pos) AS rank
    FROM (SELECT *, count(*) OVER (PARTITION BY source, target) AS kinds FROM votes) WHERE kinds = 1 OR type <> '{I.GENERIC}')
  WHERE rank <= 2)
"""


def _mentions(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    articles = I.articles(spark, d)
    edges = enrich.document_mentions(articles, I.titles(spark, d), I.GENERIC)
    return edges, articles, typing.mention_sentences(edges, articles)


@registered(f"WITH {_votes_sql()} SELECT source, target, type, evidence, score, CAST(rank AS INTEGER) AS rank FROM top")
def edge_vote_top2(spark, d) -> DataFrame:
    """Weighted votes of sentences, the best two types of each pair."""
    return typing.top_types(typing.votes(_mentions(spark, d)[2], I.RULES, I.WEIGHTS, generic=I.GENERIC), generic=I.GENERIC)


_inverse = "CASE type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in I.INVERSE.items()) + " END"


@registered(f"""
WITH {_votes_sql()},
arcs AS (
  SELECT source, target, type, evidence, 0 AS generation, source AS o1, target AS o2, rank FROM top
  UNION ALL
  SELECT target, source, {_inverse}, '[SUY LUẬN] Từ việc ' || source || ' là ' || type || ' của ' || target || '.', 1, source, target, rank FROM top WHERE {_inverse} IS NOT NULL)
SELECT source, target, type, evidence, generation FROM (SELECT *, row_number() OVER (PARTITION BY source, target, type ORDER BY generation, o1, o2, rank) AS n FROM arcs) WHERE n = 1
""")
def inverse_closure(spark, d) -> DataFrame:
    """Forward edges and their inverses, first writer wins.  The flagship."""
    forward = typing.top_types(typing.votes(_mentions(spark, d)[2], I.RULES, I.WEIGHTS, generic=I.GENERIC), generic=I.GENERIC)
    return typing.inverse_closure(forward, I.INVERSE)


_published = {t: k for t, k in R.RULES_A.items()}
_p_order = sorted(_published, key=lambda t: -R.WEIGHTS[t])
_collapsed = {k: R.COLLAPSED.get(v, v) for k, v in R.INVERSE_A.items()}
_p_inverse = "CASE type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _collapsed.items()) + " END"
#: Documents' words in order, put into the published types' phrases.
_phrases = ["con của", "cha là", "vợ của", "kế nhiệm", "đánh bại", "bổ nhiệm", "học trò", "mẹ là"]
_p_articles = f"told AS (SELECT 'doc_' || doc_id AS source, source AS target, CAST(doc_id AS INTEGER) AS pos, list_extract([{', '.join(repr(p) for p in _phrases)}], CAST(doc_id % 8 AS INTEGER) + 1) || ' ' || source AS sentence FROM documents)"


@registered(f"""
WITH {_p_articles},
top AS (SELECT source, target, {sql_case("lower(sentence)", [(_published[t], t) for t in _p_order], R.GENERIC)} AS type, sentence AS evidence FROM told),
arcs AS (
  SELECT source, target, type, evidence, 0 AS generation FROM top
  UNION ALL
  SELECT target, source, {_p_inverse}, '[SUY LUẬN] Từ việc ' || source || ' là ' || type || ' của ' || target || '.', 1 FROM top WHERE {_p_inverse} IS NOT NULL)
SELECT * FROM arcs
""")
def inverse_closure_published(spark, d) -> DataFrame:
    """G2 with the published rules and inverses: a child's parent of unknown gender is a father."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    phrase = F.element_at(F.array(*[F.lit(p) for p in _phrases]), (F.col("doc_id") % 8).cast("int") + 1)
    told = docs.select(F.concat(F.lit("doc_"), "doc_id").alias("source"), F.col("source").alias("target"), F.col("doc_id").cast("int").alias("pos"), F.concat(phrase, F.lit(" "), "source").alias("sentence"))
    forward = typing.top_types(typing.votes(told, R.RULES_A), generic=R.GENERIC)
    return typing.inverse_closure(forward, R.INVERSE_A)


_flipped = f"CASE WHEN ({_found}) = 'LEADS' AND {sql_any('lower(sentence)', ['that'])} THEN 'FOLLOWS' WHEN ({_found}) = 'FOLLOWS' AND {sql_any('lower(sentence)', ['with'])} THEN 'LEADS' ELSE {_found} END"


@registered(f"WITH {_votes_sql(_flipped)} SELECT source, target, type, score, pos FROM votes")
def direction_flip(spark, d) -> DataFrame:
    """votes whose type cue words turn round."""
    return typing.votes(_mentions(spark, d)[2], I.RULES, I.WEIGHTS, I.FLIPS, I.GENERIC).select("source", "target", "type", "score", "pos")


@registered(f"""
WITH {_votes_sql()}
SELECT p.source, p.target, '{I.GENERIC}' AS type, '' AS evidence, 'no mention' AS why FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM mentions m WHERE m.source = p.source AND m.target = p.target)
""")
def no_mention_fallback(spark, d) -> DataFrame:
    """Generic edges for pairs whose sentences never hold the target as written."""
    edges, articles, mentions = _mentions(spark, d)
    return typing.unmentioned(edges, mentions, articles, True, I.GENERIC)


# --- links -----------------------------------------------------------------------------------------

_wiki_sql = f"wiki AS (SELECT 'doc_' || doc_id AS title, regexp_replace(text, '([A-Za-z]{{4,}}) (of|de|der) ([A-Za-z]{{3,}})', '[[\\1|\\2 \\3]] [[ns:\\3]] [[\\3#x]]', 'g') AS wikitext FROM documents)"
_cut = "CASE WHEN length(sentence) > 220 THEN substr(sentence, 1, 220) || '...' ELSE sentence END"
_links = r"list_filter(list_transform(regexp_extract_all(sentence, '\[\[(.*?)(?:\|(.*?))?\]\]', 1), lambda x: trim(x)), lambda x: x <> '' AND NOT contains(x, ':'))"
_linked_sql = f"""
{_wiki_sql}, split AS (SELECT title AS source, {sql_sentences("wikitext", False)} AS l FROM wiki WHERE wikitext <> ''),
cut AS (SELECT source, i - 1 AS pos, {_cut} AS sentence FROM (SELECT source, i, l[i] AS sentence FROM split, range(1, least(len(l), 200) + 1) r(i)) WHERE length(sentence) >= 20),
linked AS (SELECT source, pos, sentence, {sql_case("lower(sentence)", I.CLASSES, "MENTIONED_IN")} AS type, {_links}[1:3] AS links FROM cut),
links AS (SELECT source, pos, sentence, type, i - 1 AS link_no, links[i] AS link FROM linked, range(1, len(links) + 1) r(i))
"""


def _wiki(spark, d) -> DataFrame:
    """Documents with some words written as links, one of them into a namespace."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.concat(F.lit("doc_"), "doc_id").alias("title"), F.regexp_replace("text", "([A-Za-z]{4,}) (of|de|der) ([A-Za-z]{3,})", "[[$1|$2 $3]] [[ns:$3]] [[$3#x]]").alias("wikitext"))


@registered(f"WITH {_linked_sql} SELECT source, CAST(pos AS INTEGER) AS pos, sentence, type, CAST(link_no AS INTEGER) AS link_no, link FROM links")
def link_extract(spark, d) -> DataFrame:
    """The first links of the first sentences."""
    return enrich.link_sentences(_wiki(spark, d), I.CLASSES, "MENTIONED_IN")


@registered(f"""
WITH {_linked_sql}, {SQL_ANCHORS},
gaz AS (SELECT DISTINCT lower(anchor) AS lowered, CASE WHEN length(anchor) % 3 = 0 THEN 'Place' WHEN length(anchor) % 3 = 1 THEN 'Person' ELSE 'Other' END AS label FROM anchors),
hits AS (SELECT l.source, g.lowered AS target, l.type, l.sentence, row_number() OVER (PARTITION BY l.source, g.lowered, l.type ORDER BY pos, link_no) AS n FROM links l JOIN gaz g ON lower(l.link) = g.lowered WHERE g.label IN ('Place', 'Person') AND g.lowered <> l.source)
SELECT source, target, type, sentence AS evidence FROM hits WHERE n = 1
""")
def link_resolve_whitelist(spark, d) -> DataFrame:
    """Links that name a node of a wanted label."""
    n = F.length("anchor") % 3
    gaz = I.anchors(spark, d).select(F.lower("anchor").alias("lowered"), F.lower("anchor").alias("title"), F.when(n == 0, "Place").when(n == 1, "Person").otherwise("Other").alias("label")).distinct()
    return enrich.resolve_links(enrich.link_sentences(_wiki(spark, d), I.CLASSES, "MENTIONED_IN"), gaz, ["Place", "Person"])


@registered(f"""
WITH {SQL_ANCHORS}, ranked AS (SELECT anchor AS title, lower(anchor) AS lowered, row_number() OVER (PARTITION BY lower(anchor) ORDER BY page_id DESC, pos DESC, anchor DESC) AS n FROM anchors WHERE anchor <> '')
SELECT lowered, title FROM ranked WHERE n = 1
""")
def gazetteer_last_wins(spark, d) -> DataFrame:
    """Of titles that are equal in lower case the last one written."""
    a = I.anchors(spark, d).select(F.col("anchor").alias("title"), F.struct("page_id", "pos").alias("place"))
    return enrich.gazetteer(a, order="place")


@registered(f"""
WITH {SQL_ARTICLES}, {SQL_TITLES}, {SQL_TRADE},
new AS (SELECT DISTINCT a.title AS source, t.title AS target, 'MENTIONS' AS type FROM articles a JOIN titles t ON contains(lower(a.text), t.lowered)),
existing AS (SELECT source, target, type FROM edges UNION ALL SELECT source, target, type FROM new WHERE contains(target, 'th'))
SELECT * FROM existing UNION ALL SELECT * FROM new WHERE NOT contains(target, 'th')
""")
def triple_anti_append(spark, d) -> DataFrame:
    """New triples behind existing ones."""
    new = mention_doc(spark, d)
    existing = I.trade_edges(spark, d).unionByName(new.where(F.contains("target", F.lit("th"))))
    return enrich.appended(existing, new)


# --- loading ---------------------------------------------------------------------------------------

_page_edges_sql = f"{SQL_ANCHORS}, page_edges AS (SELECT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS source, a.anchor AS target, 'LINKS_TO' AS type FROM pages p JOIN anchors a ON p.page_id = a.page_id)"


def _page_edges(spark, d) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.lower(F.regexp_extract("url", "^https?://([^/:?#]+)", 1)).alias("source"))
    return pages.join(I.anchors(spark, d), "page_id").select("source", F.col("anchor").alias("target"), F.lit("LINKS_TO").alias("type"))


@registered(f"WITH {SQL_TRADE} SELECT source, target, type FROM trade WHERE source IN (SELECT n_name FROM nation WHERE n_regionkey < 4) AND target IN (SELECT n_name FROM nation WHERE n_regionkey < 4)")
def endpoint_semijoin(spark, d) -> DataFrame:
    """Edges both of whose ends are nodes, repeated ones kept."""
    nodes = spark.read.parquet(f"{d}/nation.parquet").where("n_regionkey < 4").select(F.col("n_name").alias("title"))
    return load.endpoint_checked(I.trade(spark, d), nodes)


@registered(f"WITH {SQL_TRADE} SELECT CAST(count(*) AS BIGINT) AS rejected FROM trade WHERE source NOT IN (SELECT n_name FROM nation WHERE n_regionkey < 4) OR target NOT IN (SELECT n_name FROM nation WHERE n_regionkey < 4)")
def rejected_count(spark, d) -> DataFrame:
    """How many edges have an end that is no node."""
    nodes = spark.read.parquet(f"{d}/nation.parquet").where("n_regionkey < 4").select(F.col("n_name").alias("title"))
    return load.rejected(I.trade(spark, d), nodes).agg(F.count("*").alias("rejected"))


@registered(f"""
WITH {SQL_ANCHORS}, existing AS (SELECT n_name AS title, CAST(n_nationkey AS VARCHAR) AS page_id FROM nation),
first AS (SELECT anchor AS title, page_id, row_number() OVER (PARTITION BY anchor ORDER BY page_id, pos) AS n FROM anchors)
SELECT * FROM existing UNION ALL SELECT title, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) ELSE 'TITLE_KEY_' || title END FROM first WHERE n = 1 AND title NOT IN (SELECT title FROM existing)
""")
def node_upsert_first_wins(spark, d) -> DataFrame:
    """New titles once, by their first row; a missing page id gets a name."""
    existing = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("title"), F.col("n_nationkey").cast("string").alias("page_id"))
    new = I.anchors(spark, d).select(F.col("anchor").alias("title"), F.when(F.col("page_id") % 2 == 0, F.col("page_id")).alias("page_id"), F.struct(F.col("page_id").alias("p"), "pos").alias("pos"))
    return load.upsert_nodes(existing, new)


@registered(f"WITH {SQL_TRADE} SELECT DISTINCT source, target, type FROM trade WHERE source <> 'NATION_3' AND target <> 'NATION_3'")
def rel_load(spark, d) -> DataFrame:
    """Checked edges; loading them again changes nothing."""
    nodes = I.nations(spark, d).where("title <> 'NATION_3'")
    once = load.insert_edges(I.trade(spark, d), nodes, keep_repeated=False)
    return load.insert_edges(I.trade(spark, d), nodes, once, keep_repeated=False)


@registered("SELECT page_id, url, length(html) AS size FROM pages WHERE page_id IN (SELECT l_suppkey FROM lineitem)")
def seed_semijoin(spark, d) -> DataFrame:
    """Pages with a seed id."""
    ids = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("page_id")).distinct()
    return spark.read.parquet(f"{d}/pages.parquet").join(ids, "page_id", "left_semi").select("page_id", "url", F.length("html").cast("long").alias("size"))




@registered(f"WITH {SQL_ANCHORS} SELECT DISTINCT anchor AS title, regexp_extract(trim(anchor), '^[^ ]+') IN ('The', 'En', 'La', 'Der') AS starts_well FROM anchors WHERE regexp_matches(anchor, '^\\p{{Lu}}')")
def valid_node_filter(spark, d) -> DataFrame:
    """Capitalised titles, and whether their first word is a known one."""
    a = I.anchors(spark, d).select(F.col("anchor").alias("title")).distinct()
    return a.where(T.capitalised(F.col("title"))).select("title", crawl.valid_title(F.col("title"), ["The"], ["The", "En", "La", "Der"], F.lit(False)).alias("starts_well"))


@registered(f"""
WITH {SQL_TRADE}, valid AS (SELECT n_name AS title FROM nation WHERE n_regionkey <> 2),
d0 AS (SELECT title FROM valid WHERE title IN ('NATION_3', 'NATION_7')),
l0 AS (SELECT DISTINCT source, target FROM edges JOIN d0 ON source = title WHERE source <> target),
f1 AS (SELECT DISTINCT target AS title FROM l0 WHERE target NOT IN ('NATION_3', 'NATION_7')),
d1 AS (SELECT title FROM f1 WHERE title IN (FROM valid)),
l1 AS (SELECT DISTINCT source, target FROM edges JOIN d1 ON source = title WHERE source <> target),
f2 AS (SELECT DISTINCT target AS title FROM l1 WHERE target NOT IN ('NATION_3', 'NATION_7') AND target NOT IN (FROM f1)),
found AS (SELECT title, 0 AS depth FROM d0 UNION ALL SELECT title, 1 FROM d1 UNION ALL SELECT title, 2 FROM f2 WHERE title IN (FROM valid)),
links AS (FROM l0 UNION FROM l1)
SELECT title AS a, CAST(depth AS VARCHAR) AS b, 'node' AS kind FROM found
UNION ALL SELECT source, target, 'edge' FROM links WHERE source IN (SELECT title FROM found) AND target IN (SELECT title FROM found)
""")
def bfs_depth2(spark, d) -> DataFrame:
    """G1: two levels of a crawl in which some pages aren't valid."""
    outgoing = I.trade_edges(spark, d).groupBy(F.col("source").alias("title")).agg(F.collect_set("target").alias("links"))
    nodes = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("title"), "n_regionkey")
    pages = nodes.join(outgoing, "title", "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))
    seeds = spark.createDataFrame([("NATION_3",), ("NATION_7",)], "title string")
    found, links = crawl.crawl(pages, seeds, 2, None, F.col("n_regionkey") != 2)
    return found.select(F.col("title").alias("a"), F.col("depth").cast("string").alias("b"), F.lit("node").alias("kind")).unionByName(links.select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit("edge").alias("kind")))


# --- histograms ------------------------------------------------------------------------------------


@registered("SELECT coalesce(CASE WHEN lang = 'en' THEN NULL ELSE lang END, 'Khác') AS label, count(*) AS n FROM documents GROUP BY 1")
def label_histogram(spark, d) -> DataFrame:
    """Rows by label, a missing one named."""
    return load.label_histogram(spark.read.parquet(f"{d}/documents.parquet").select(F.when(F.col("lang") != "en", F.col("lang")).alias("label")))


@registered(f"WITH {_page_edges_sql} SELECT target AS type, count(*) AS n FROM page_edges GROUP BY 1 ORDER BY n DESC, type LIMIT 10")
def type_histogram_top10(spark, d) -> DataFrame:
    """A10: the ten most frequent types (here: anchors)."""
    return load.type_histogram(_page_edges(spark, d).select(F.col("target").alias("type")), 10)


@registered("SELECT l_returnflag AS type, count(*) AS n FROM lineitem GROUP BY 1")
def type_histogram(spark, d) -> DataFrame:
    return load.type_histogram(spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("type")))


# --- graph measures --------------------------------------------------------------------------------

_arcs = "arcs AS (SELECT source AS src, target AS dst FROM edges UNION ALL SELECT target, source FROM edges), simple AS (SELECT DISTINCT src, dst FROM arcs WHERE src <> dst)"


@registered(f"""
WITH {SQL_TRADE}, {SQL_NATIONS}, {_arcs}, deg AS (SELECT title, CAST(count(src) AS DOUBLE) AS degree FROM nodes LEFT JOIN arcs ON title = src GROUP BY title)
SELECT title, degree, CAST(row_number() OVER (ORDER BY degree DESC, title) AS INTEGER) AS rank FROM deg ORDER BY rank LIMIT 10
""")
def degree_top10(spark, d) -> DataFrame:
    """G4 A11 O1 O5."""
    return graph.top(graph.degree(I.nations(spark, d), I.trade_edges(spark, d)), "degree")


_pr = ", ".join(
    ["r0 AS (SELECT title, 0.15::DOUBLE AS score FROM nodes)"]
    + [f"r{i} AS MATERIALIZED (SELECT n.title, 0.15 + 0.85 * coalesce(g.got, 0) AS score FROM nodes n LEFT JOIN (SELECT dst, sum(score * share) AS got FROM shares JOIN r{i - 1} ON src = title GROUP BY dst) g ON n.title = g.dst)" for i in range(1, 21)]
)


@registered(f"""
WITH {SQL_TRADE}, {SQL_NATIONS}, {_arcs}, outs AS (SELECT src, count(*) AS o FROM arcs GROUP BY src),
shares AS (SELECT b.src, b.dst, count(*) / any_value(o)::DOUBLE AS share FROM arcs b JOIN outs ON b.src = outs.src GROUP BY b.src, b.dst), {_pr}
SELECT title, round(score, 6) AS score FROM r20
""")
def pagerank20(spark, d) -> DataFrame:
    """Twenty updates at damping 0.85."""
    return graph.pagerank(I.nations(spark, d), I.trade_edges(spark, d), tolerance=None).select("title", F.round("score", 6).alias("score"))


_levels = 6
_bt = ", ".join(
    ["p0 AS (SELECT title AS s, title AS v, 1.0::DOUBLE AS paths, 0 AS dist FROM nodes)", "s0 AS (FROM p0)"]
    + [
        x
        for i in range(1, _levels + 1)
        for x in (
            f"p{i} AS MATERIALIZED (SELECT p.s, l.dst AS v, sum(p.paths) AS paths, {i} AS dist FROM p{i - 1} p JOIN simple l ON p.v = l.src WHERE NOT EXISTS (SELECT 1 FROM s{i - 1} x WHERE x.s = p.s AND x.v = l.dst) GROUP BY p.s, l.dst)",
            f"s{i} AS MATERIALIZED (FROM s{i - 1} UNION ALL FROM p{i})",
        )
    ]
)


@registered(f"""
WITH {SQL_TRADE}, {SQL_NATIONS}, {_arcs}, {_bt},
b AS (SELECT a.v AS title, sum(a.paths * c.paths / st.paths) / 2 AS score
  FROM s{_levels} st JOIN s{_levels} a ON a.s = st.s JOIN s{_levels} c ON c.s = st.v AND c.v = a.v
  WHERE a.v <> st.s AND a.v <> st.v AND a.dist + c.dist = st.dist GROUP BY a.v)
SELECT n.title, round(coalesce(b.score, 0), 6) AS score FROM nodes n LEFT JOIN b ON n.title = b.title
""")
def betweenness(spark, d) -> DataFrame:
    """Exact, undirected, unweighted."""
    return graph.betweenness(I.nations(spark, d), I.trade_edges(spark, d)).select("title", F.round("score", 6).alias("score"))


_lcc = """
k AS (SELECT src, count(*) AS k FROM simple GROUP BY src),
t AS (SELECT a.src, count(*) AS t FROM simple a JOIN simple b ON a.src = b.src AND a.dst < b.dst JOIN simple c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src),
lcc AS (SELECT n.title, CASE WHEN k >= 2 THEN 2.0::DOUBLE * coalesce(t, 0) / (k * (k - 1)) ELSE 0.0::DOUBLE END AS coefficient FROM nodes n LEFT JOIN k ON n.title = k.src LEFT JOIN t ON n.title = t.src)
"""


@registered(f"WITH {SQL_TRADE}, {SQL_NATIONS}, {_arcs}, {_lcc} SELECT title, round(coefficient, 6) AS coefficient FROM lcc")
def clustering_coefficients(spark, d) -> DataFrame:
    """G8."""
    return graph.clustering(I.nations(spark, d), I.trade_edges(spark, d)).select("title", F.round("coefficient", 6).alias("coefficient"))


@registered(f"WITH {SQL_TRADE}, {SQL_NATIONS}, {_arcs}, {_lcc} SELECT round(avg(coefficient), 6) AS average FROM lcc")
def lcc_avg(spark, d) -> DataFrame:
    """A13."""
    return graph.clustering(I.nations(spark, d), I.trade_edges(spark, d)).agg(F.round(F.avg("coefficient"), 6).alias("average"))


@registered()
def louvain(spark, d) -> DataFrame:
    """Communities and the modularity they reach; moves depend on order, so no SQL is given."""
    found, reached = graph.louvain(I.nations(spark, d), I.trade_edges(spark, d))
    return found.withColumn("modularity", F.round(F.lit(reached), 6))


@registered("""
WITH c AS (SELECT lang || '/' || source AS community, 'doc_' || doc_id AS title FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY title) AS n FROM c)
SELECT community, count(*) AS size, list(title ORDER BY title) FILTER (WHERE n <= 5) AS members FROM n GROUP BY community ORDER BY size DESC, community LIMIT 5
""")
def community_top5(spark, d) -> DataFrame:
    """The largest communities and their first members."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return graph.community_sizes(docs.select(F.concat("lang", F.lit("/"), "source").alias("community"), F.concat(F.lit("doc_"), "doc_id").alias("title")))


# --- retrieval -------------------------------------------------------------------------------------

_KEY = "Nation 15"
_score_sql = """
terms AS (SELECT title, unnest(list_filter(string_split_regex(lower(title), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS term FROM (SELECT DISTINCT title FROM nodes)),
sizes AS (SELECT title, count(*) AS size FROM terms GROUP BY title), whole AS (SELECT count(*) AS n, avg(size) AS mean FROM sizes),
hits AS (SELECT title, term, count(*) AS tf FROM terms WHERE term IN ('nation', '15') GROUP BY title, term), spread AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scored AS (SELECT h.title, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)))) AS score FROM hits h JOIN spread USING (term) JOIN sizes USING (title), whole GROUP BY h.title),
hit AS (SELECT title, score FROM scored WHERE score > 0.6 ORDER BY score DESC, title LIMIT 1)
"""


@registered(f"WITH {SQL_NATIONS}, {_score_sql} SELECT title, round(score, 6) AS score FROM hit")
def fulltext_top1(spark, d) -> DataFrame:
    """G9 P18 O3."""
    return retrieve.search(I.nations(spark, d), _KEY).select("title", F.round("score", 6).alias("score"))


@registered(f"WITH {SQL_NATIONS}, {_score_sql} SELECT title AS name, summary FROM nodes WHERE title IN (SELECT title FROM hit)")
def summary_lookup(spark, d) -> DataFrame:
    """G12."""
    return retrieve.summary(I.nations(spark, d), _KEY)


@registered(f"""
WITH {SQL_TRADE}, {SQL_NATIONS}, {_score_sql},
steps AS (SELECT source AS center, type AS rel_type, target AS neighbor FROM edges WHERE type <> 'A' UNION ALL SELECT target, type, source FROM edges WHERE type <> 'A' AND source <> target)
SELECT * FROM steps WHERE center IN (SELECT title FROM hit) ORDER BY rel_type, neighbor LIMIT 30
""")
def one_hop(spark, d) -> DataFrame:
    """G10 J15 P16."""
    return retrieve.one_hop(I.nations(spark, d), I.trade_edges(spark, d), _KEY, ["A"])


@registered(f"""
WITH {SQL_TRADE}, {SQL_NATIONS}, {_score_sql}, kept AS (SELECT *, row_number() OVER () AS id FROM edges WHERE type <> 'A'),
steps AS (SELECT source AS a, target AS b, id, source || ' --[' || type || ']--> ' || target AS t FROM kept UNION ALL SELECT target, source, id, source || ' --[' || type || ']--> ' || target FROM kept WHERE source <> target),
chains AS (
  SELECT s.t AS path FROM steps s JOIN hit ON s.a = hit.title WHERE s.b <> hit.title
  UNION SELECT s.t || ' ; ' || u.t FROM steps s JOIN hit ON s.a = hit.title JOIN steps u ON s.b = u.a WHERE s.id <> u.id AND u.b <> hit.title)
SELECT path FROM chains ORDER BY path LIMIT 50
""")
def two_hop_paths(spark, d) -> DataFrame:
    """G11 J16 P17 A15 F15."""
    return retrieve.paths(I.nations(spark, d), I.trade_edges(spark, d), _KEY, ["A"])


@registered(f"""
WITH {SQL_TRADE}, {SQL_NATIONS}, {_score_sql},
steps AS (SELECT source AS center, type AS rel_type, target AS neighbor FROM edges WHERE type <> 'A' UNION ALL SELECT target, type, source FROM edges WHERE type <> 'A' AND source <> target),
found AS (SELECT * FROM steps WHERE center IN (SELECT title FROM hit) ORDER BY rel_type, neighbor LIMIT 30)
SELECT coalesce(string_agg('- ' || center || ' --[' || rel_type || ']--> ' || neighbor, chr(10) ORDER BY '- ' || center || ' --[' || rel_type || ']--> ' || neighbor), '') AS context FROM found
""")
def one_hop_context(spark, d) -> DataFrame:
    """A16."""
    return retrieve.one_hop_text(one_hop(spark, d))


@registered(f"WITH {SQL_TRADE} SELECT source, target FROM edges WHERE type = 'R' ORDER BY source, target LIMIT 20")
def succession(spark, d) -> DataFrame:
    """G13."""
    return retrieve.succession(I.trade_edges(spark, d), "R")


# --- infoboxes, JSON, questions --------------------------------------------------------------------

_props = "SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS k FROM events"


@registered(f"""
WITH e AS ({_props}), rows AS (SELECT 'user_' || user_id AS source, unnest(['k' || k, event_type || ' x']) AS part, unnest(['HAS_KEY', 'DID']) AS type FROM e)
SELECT DISTINCT source, part AS target, type FROM rows
""")
def infobox_edges(spark, d) -> DataFrame:
    """Edges from map keys, values cut at line breaks and cleaned of notes."""
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.element_at(F.from_json("props", "map<string,string>"), "k")
    box = F.create_map(F.lit("Key no"), F.concat(F.lit("k"), k, F.lit(" (note)<br/>")), F.lit("Act of"), F.concat("event_type", F.lit(" [1]  x")))
    return infobox.infobox_edges(e.select(F.concat(F.lit("user_"), "user_id").alias("title"), box.alias("infobox")), [("key", "HAS_KEY"), ("act", "DID")])


@registered(f"WITH {SQL_TRADE} SELECT DISTINCT CASE WHEN type IN ('A', 'N') THEN least(source, target) ELSE source END AS source, CASE WHEN type IN ('A', 'N') THEN greatest(source, target) ELSE target END AS target, type FROM edges")
def symmetric_pair_dedupe(spark, d) -> DataFrame:
    """D3."""
    return load.symmetric_once(I.trade_edges(spark, d), ["A", "N"])


@registered(f"WITH {SQL_TRADE}, pairs AS (SELECT DISTINCT a.n_name AS source, b.n_name AS target FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name) SELECT * FROM edges UNION ALL SELECT source, target, 'LINKS_TO' FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.source = p.source AND e.target = p.target)")
def generic_fallback(spark, d) -> DataFrame:
    """Pairs of a region without an edge get a generic one."""
    n = spark.read.parquet(f"{d}/nation.parquet")
    pairs = n.select(F.col("n_name").alias("source"), "n_regionkey").join(n.select(F.col("n_name").alias("target"), "n_regionkey"), "n_regionkey").where("source <> target")
    return load.with_generic_fallback(pairs, I.trade_edges(spark, d), "LINKS_TO")


@registered(f"WITH {SQL_TRADE}, {SQL_NATIONS} SELECT e.*, a.page_id AS source_id, b.page_id AS target_id FROM edges e LEFT JOIN nodes a ON e.source = a.title LEFT JOIN nodes b ON e.target = b.title")
def page_id_resolution(spark, d) -> DataFrame:
    """D4."""
    return infobox.with_page_ids(I.trade_edges(spark, d), I.nations(spark, d))


@registered("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":\"' || json_extract_string(props, '$.k') || '\"}' AS written FROM events")
def infobox_json_roundtrip(spark, d) -> DataFrame:
    """JSON to map and back."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("box", F.from_json("props", "map<string,string>"))
    return e.select("event_id", F.element_at("box", "k").cast("long").alias("k"), F.to_json("box").alias("written"))


@registered("SELECT event_id, coalesce(nullif(regexp_replace(upper(event_type), '[^A-Z_]', '', 'g'), ''), 'LIEN_KET') AS label FROM events")
def label_clean(spark, d) -> DataFrame:
    """F10."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", T.clean_label(F.concat(F.lit(" "), "event_type", F.lit("-1! extra")), "LIEN_KET").alias("label"))


@registered(f"""
WITH {SQL_TRADE}
SELECT source || ' có quan hệ ' || lower(replace(type, '_', ' ')) || ' với ' || target || ' phải không?' AS question, 'Đúng' AS expected_answer FROM edges
UNION ALL SELECT source || ' không có quan hệ ' || lower(replace(type, '_', ' ')) || ' với ' || target || ' phải không?', 'Sai' FROM edges
""")
def eval_yes_no(spark, d) -> DataFrame:
    """X7 U4 F12."""
    return questions.yes_no_items(I.trade_edges(spark, d))


@registered(r"""
SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') THEN 'SUMMARY' ELSE 'RELATION' END AS intent, CASE WHEN contains(lower(text), 'der') THEN 2 ELSE 1 END AS hops,
       regexp_replace(text, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS keyword
FROM conversations WHERE role = 'user'
""")
def router_json(spark, d) -> DataFrame:
    """Routes of user turns, read back out of an answer with words around the JSON."""
    c = spark.read.parquet(f"{d}/conversations.parquet").where("role = 'user'")
    said = F.concat(F.lit("Sure: "), questions.rule_route(F.col("text"), ["the"], ["der"]), F.lit(" ."))
    r = c.select("conv_id", "turn", questions.route(said, F.col("text")).alias("r"))
    return r.select("conv_id", "turn", "r.intent", "r.hops", "r.keyword")


@registered("""
WITH f AS (SELECT text AS title, min(conv_id * 1000 + turn) AS pos FROM conversations WHERE text IS NOT NULL GROUP BY text)
SELECT md5(title) AS title_md5, CAST((row_number() OVER (ORDER BY pos) - 1) // 50 AS BIGINT) AS batch FROM f
""")
def first_seen_batches(spark, d) -> DataFrame:
    """Distinct titles in order of first appearance, in batches of fifty."""
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("text").alias("title"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    return load.first_batch_numbers(c).select(F.md5("title").alias("title_md5"), "batch")


@registered("SELECT doc_id, CASE WHEN text LIKE '%License%' THEN 'LICENSED' ELSE 'PLAIN' END AS class FROM documents")
def first_match_class(spark, d) -> DataFrame:
    """F17 on whole texts."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", first_match(F.col("text"), [(["License"], "LICENSED")], "PLAIN").alias("class"))


@registered(f"""
WITH {_votes_sql()}
SELECT source, target, md5(string_agg(sentence, ' ' ORDER BY pos)) AS context_md5 FROM mentions GROUP BY source, target
""")
def mention_context(spark, d) -> DataFrame:
    """All sentences of a pair, in order."""
    m = _mentions(spark, d)[2]
    ordered = F.array_sort(F.collect_list(F.struct("pos", "sentence")))
    return m.groupBy("source", "target").agg(F.md5(F.concat_ws(" ", F.transform(ordered, lambda x: x["sentence"]))).alias("context_md5"))


# --- sources and sinks, written and read back --------------------------------------------------------

_source_edges_sql = f"WITH {SQL_ANCHORS}, page_edges AS (SELECT 'page_' || page_id AS source, anchor AS target, CASE WHEN pos = 0 THEN 'FIRST' ELSE 'LATER' END AS type, CASE WHEN pos % 3 = 0 THEN '' ELSE 'said \"' || anchor || '\", at ' || pos END AS evidence FROM anchors WHERE anchor <> '')"


def _evidence_edges(spark, d) -> DataFrame:
    """Links of all pages, with evidence that holds quotes and commas, or none."""
    a = I.anchors(spark, d).where("anchor <> ''")
    evidence = F.when(F.col("pos") % 3 == 0, "").otherwise(F.concat(F.lit('said "'), "anchor", F.lit('", at '), F.col("pos").cast("string")))
    return a.select(F.concat(F.lit("page_"), "page_id").alias("source"), F.col("anchor").alias("target"), F.when(F.col("pos") == 0, "FIRST").otherwise("LATER").alias("type"), evidence.alias("evidence"))


@registered(_source_edges_sql + " SELECT * FROM page_edges")
def csv_evidence_roundtrip(spark, d) -> DataFrame:
    """Edges with evidence through CSV."""
    path = storage.fresh(spark, "csv-evidence")
    writers.csv_edges(_evidence_edges(spark, d), path, with_evidence=True)
    return readers.csv_edges(spark, path, with_evidence=True)


@registered(_source_edges_sql + " SELECT source, target, type FROM page_edges")
def csv_edges_roundtrip(spark, d) -> DataFrame:
    """Edges without evidence through CSV."""
    path = storage.fresh(spark, "csv-edges")
    writers.csv_edges(_evidence_edges(spark, d), path)
    return readers.csv_edges(spark, path)


@registered("SELECT 'doc_' || doc_id AS title, CAST(doc_id AS BIGINT) AS page_id, text, source FROM documents UNION ALL SELECT 'page_' || page_id, CAST(page_id AS BIGINT), html, 'pages' FROM pages")
def json_lines_append(spark, d) -> DataFrame:
    """Articles as JSON lines, the pages appended to the documents."""
    path = storage.fresh(spark, "json-lines")
    docs, pages = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "pages"))
    writers.json_lines(docs.select(F.concat(F.lit("doc_"), "doc_id").alias("title"), F.col("doc_id").cast("long").alias("page_id"), "text", "source"), path)
    writers.json_lines(pages.select(F.concat(F.lit("page_"), "page_id").alias("title"), F.col("page_id").cast("long").alias("page_id"), F.col("html").alias("text"), F.lit("pages").alias("source")), path, "append")
    return readers.json_lines(spark, path, S.ARTICLE)


@registered(f"WITH {SQL_NATIONS} SELECT title, page_id, summary FROM nodes")
def json_array_roundtrip(spark, d) -> DataFrame:
    """Nodes as one JSON array, a form for small results."""
    path = storage.fresh(spark, "json-array")
    writers.json_array(I.nations(spark, d), path)
    return readers.json_array(spark, path, "title string, page_id long, summary string")


@registered(_source_edges_sql + ' SELECT source AS ":START_ID", target AS ":END_ID", type AS ":TYPE", evidence FROM page_edges')
def bulk_edges_roundtrip(spark, d) -> DataFrame:
    """K5 K6: relations in the columns of a bulk import, as CSV."""
    path = storage.fresh(spark, "bulk-edges")
    rows = writers.bulk_edges(_evidence_edges(spark, d).withColumn("evidence", F.nullif("evidence", F.lit(""))), with_evidence=True)
    writers.bulk_csv(rows, path)
    found = spark.read.schema(rows.schema).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return found.withColumn("evidence", F.coalesce("evidence", F.lit("")))


@registered("""
SELECT c_name AS "title:ID", CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS ":LABEL", CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey END AS BIGINT) AS page_id,
       CASE WHEN c_custkey % 5 = 0 THEN '{}' ELSE '{"segment":"' || c_mktsegment || '"}' END AS infobox FROM customer
""")
def bulk_nodes_roundtrip(spark, d) -> DataFrame:
    """Nodes in the columns of a bulk import; some without label, page id or infobox."""
    path, key = storage.fresh(spark, "bulk-nodes"), F.col("c_custkey")
    box = F.when(key % 5 != 0, F.create_map(F.lit("segment"), "c_mktsegment"))
    nodes = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_name").alias("title"), F.when(key % 2 == 0, F.col("c_mktsegment")).alias("label"), F.when(key % 3 != 0, key.cast("long")).alias("page_id"), box.alias("infobox"))
    rows = writers.bulk_nodes(nodes)
    writers.bulk_csv(rows, path)
    found = spark.read.schema(rows.schema).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return found.withColumn(":LABEL", F.coalesce(":LABEL", F.lit("")))


@registered("SELECT n_name AS title, CAST(n_nationkey * 10 AS BIGINT) AS score FROM nation WHERE n_nationkey > 4")
def replaced_table(spark, d) -> DataFrame:
    """A table that is rewritten from itself."""
    path = storage.fresh(spark, "replaced")
    nodes = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("title"), F.col("n_nationkey").cast("long").alias("score"))
    writers.replaced(nodes, path)
    writers.replaced(spark.read.parquet(path).where("score > 4").withColumn("score", F.col("score") * 10), path)
    return spark.read.parquet(path)


@registered("SELECT c_name AS title, c_mktsegment AS label, CAST(n AS BIGINT) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def scores_written_back(spark, d) -> DataFrame:
    """Nodes with a score column; null for nodes without."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    customers = t("customer").select("c_custkey", F.col("c_name").alias("title"), F.col("c_mktsegment").alias("label"))
    scores = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return load.written_back(customers, scores, "c_custkey").drop("c_custkey")


@registered("SELECT 'doc_' || doc_id AS title, CASE WHEN lang = 'en' THEN coalesce(text, '') ELSE '' END AS text FROM documents")
def texts_of_titles(spark, d) -> DataFrame:
    """A text for every title, empty where there is no article."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("doc_"), "doc_id").alias("title"), "lang", "text")
    return readers.texts_of(docs.select("title"), docs.where("lang = 'en'"))


# --- measures over a graph that grows with the tables ------------------------------------------------

_parties_sql = """
edges AS (SELECT DISTINCT 'C' || o_custkey AS source, 'S' || l_suppkey AS target, l_returnflag AS type FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
nodes AS (SELECT 'C' || c_custkey AS title FROM customer UNION ALL SELECT 'S' || s_suppkey FROM supplier)
"""


@registered(f"WITH {_parties_sql}, {_arcs}, deg AS (SELECT title, CAST(count(src) AS DOUBLE) AS degree FROM nodes LEFT JOIN arcs ON title = src GROUP BY title) SELECT title, degree FROM deg")
def degree_parties(spark, d) -> DataFrame:
    """Degrees of all customers and suppliers by all order lines."""
    return graph.degree(*I.parties(spark, d)).select("title", "degree")


_shares = "outs AS (SELECT src, count(*) AS o FROM arcs GROUP BY src), shares AS (SELECT b.src, b.dst, count(*) / any_value(o)::DOUBLE AS share FROM arcs b JOIN outs ON b.src = outs.src GROUP BY b.src, b.dst)"


@registered(f"WITH {_parties_sql}, {_arcs}, {_shares}, {_pr} SELECT title, round(score, 6) AS score FROM r20")
def pagerank20_parties(spark, d) -> DataFrame:
    """Twenty updates over all customers and suppliers."""
    return graph.pagerank(*I.parties(spark, d), tolerance=None).select("title", F.round("score", 6).alias("score"))
