"""C: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import rules as R
from ..operators import joins as J
from ..operators import similar as M
from ..operators import terms as T
from ..operators import windows as W
from ..operators.prefix import places
from ..operators.storage import checkpointed
from .base import query, table


@query("c1_role_playing_join", """SELECT l_orderkey, l_linenumber, cn.n_name AS from_n_name, sn.n_name AS to_n_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey""")
def c1(spark, sf):
    t = lambda n: table(spark, sf, n)
    facts = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    out = J.role_playing_join(facts, t("nation").select("n_nationkey", "n_name"), "n_nationkey", {"c_nationkey": "from", "s_nationkey": "to"})
    return out.select("l_orderkey", "l_linenumber", "from_n_name", "to_n_name")


@query("c2_follow_feed", """WITH f AS (SELECT DISTINCT user_id AS reader, CAST(json_extract_string(props, '$.k') AS BIGINT) AS author FROM events WHERE event_type = 'click'
    UNION SELECT DISTINCT user_id, user_id FROM events WHERE event_type = 'view'),
  r AS (SELECT reader, author, event_id AS post, row_number() OVER (PARTITION BY reader ORDER BY ts DESC, event_id DESC) AS place FROM f JOIN events ON user_id = author AND event_type = 'view')
  SELECT reader, author, post, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""")
def c2(spark, sf):
    e = table(spark, sf, "events")
    posts = e.filter("event_type = 'view'").select(F.col("user_id").alias("author"), "ts", F.col("event_id").alias("post"))
    follows = e.filter("event_type = 'click'").select(F.col("user_id").alias("reader"), F.get_json_object("props", "$.k").cast("bigint").alias("author"))
    return J.follow_feed(posts, follows, 5).select("reader", "author", "post", "place")


@query("c3_status_lookup_join", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey")
def c3(spark, sf):
    o, c = table(spark, sf, "orders").filter("o_orderstatus = 'P'"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).orderBy(F.desc("o_totalprice"), F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "c_name", "o_totalprice")


@query("c4_edge_endpoint_join", """SELECT event_id, left(a.text, 30) AS start_text, left(b.text, 30) AS end_text FROM events JOIN documents a ON a.doc_id = user_id JOIN documents b ON b.doc_id = CAST(json_extract_string(props, '$.k') AS BIGINT) * 2
  ORDER BY event_id LIMIT 30""")
def c4(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 30).alias("t"))
    e = table(spark, sf, "events").select("event_id", "user_id", (F.get_json_object("props", "$.k").cast("bigint") * 2).alias("k"))
    return e.join(d.toDF("user_id", "start_text"), "user_id").join(d.toDF("k", "end_text"), "k").orderBy("event_id").limit(30).select("event_id", "start_text", "end_text")


LISTED = """SELECT o.o_orderkey, greatest(0.0, coalesce(sum(h.o_totalprice::DECIMAL(18, 2))::DOUBLE / count(h.o_totalprice) - any_value(o.o_totalprice), 0.0)) AS profit FROM orders o
  LEFT JOIN orders h ON h.o_orderpriority = o.o_orderpriority AND h.o_orderstatus = o.o_orderstatus AND h.o_orderdate >= o.o_orderdate - INTERVAL 90 DAY AND h.o_orderdate < o.o_orderdate GROUP BY o.o_orderkey"""


def profits(orders):
    """Each order's profit against the mean of its sort in the 90 days before, zero without history."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    priced = J.trailing_mean(orders, ["o_orderpriority", "o_orderstatus"], day, "o_totalprice", 90)
    return priced.withColumn("profit", F.greatest(F.lit(0.0), F.coalesce(F.col("mean") - F.col("o_totalprice"), F.lit(0.0))))


@query("c5_trailing_window_lookup", f"SELECT o_orderkey, profit FROM ({LISTED}) WHERE profit > 100")
def c5(spark, sf):
    return profits(table(spark, sf, "orders")).filter("profit > 100").select("o_orderkey", "profit")


WORDS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"
_SETS = f"""w AS (SELECT doc_id AS id, {WORDS} AS w FROM documents), s AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS t FROM w WHERE len(w) >= 5)"""


def id_texts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


@query("c6_all_pairs_similarity", f"""WITH {_SETS}, f AS (SELECT t, min(id) AS first FROM s GROUP BY t)
  SELECT x.first AS a, y.first AS b, round(len(list_intersect(x.t, y.t))::DOUBLE / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))), 6) AS jaccard FROM f x JOIN f y ON x.first < y.first
    WHERE len(list_intersect(x.t, y.t))::DOUBLE / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) >= 0.8 - 1e-12
  UNION ALL SELECT f.first, s.id, 1.0 FROM s JOIN f USING (t) WHERE s.id <> f.first""")
def c6(spark, sf):
    return M.jaccard_pairs(id_texts(spark, sf), 0.8, M.shingle_sets).withColumn("jaccard", F.round("jaccard", 6))


def sources(spark, sf):
    """path, code: a source for each item of the benchmark, with a function for each sentence
    of its text.  Every four words are a statement; the length of the first decides which."""
    w = lambda k: F.coalesce(F.get("words", F.col("i") * 4 + k), F.lit("x"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    kind = F.char_length(w(0)) % 4
    statement = (
        F.when(kind == 0, say("    a.", w(0), "_ = b.", w(1), "_(", w(2), "_, '", w(3), "')"))
        .when(kind == 1, say("    if ", w(0), "_.", w(1), "_ > len(", w(2), "_):\n        return '", w(3), "'"))
        .when(kind == 2, say("    for ", w(0), "_ in a.", w(1), "_:\n        b.", w(2), "_('", w(3), "')"))
        .otherwise(say("    ", w(0), "_ = ", w(1), "_ + a.", w(2), "_(", w(3), "_)"))
    )
    t = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", "[.\n]")).alias("line", "text"))
    t = t.select("item_id", "line", F.regexp_extract_all("text", F.lit(r"(\p{L}+)")).alias("words")).filter("size(words) > 0")
    t = t.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / 4).cast("int"))).alias("i")).select("item_id", "line", "i", statement.alias("s"))
    joined = lambda order, x: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, x))), lambda r: r[x]), "\n")
    f = t.groupBy("item_id", "line").agg(joined("i", "s").alias("body"))
    f = f.select("item_id", "line", F.format_string("def f%d(a, b):\n%s\n    return b\n", "line", "body").alias("f"))
    return f.groupBy("item_id").agg(joined("line", "f").alias("code")).select(F.col("item_id").cast("string").alias("path"), "code")


def functions_of(spark, sf):
    return P.code_functions(sources(spark, sf)).select(F.concat_ws("::", "path", "name", "start_line").alias("key"), "text", "ast")


@query("c6_code_similarity")
def c6_code(spark, sf):
    """Pairs of different functions, and each copy with the first of its class."""
    functions = functions_of(spark, sf)
    classes = M.code_classes(functions)
    return M.code_class_pairs(classes).select("a", "b", *(F.round(c, 6).alias(c) for c in ("text_ratio", "ast_ratio", "similarity")))


@query("d13_code_repetition")
def d13_code(spark, sf):
    return M.code_repetition(functions_of(spark, sf))


def _spans_sql(pattern):
    return f"""(SELECT doc_id, m[k] AS text, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT doc_id, p, m, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS m FROM documents)))"""


@query("c7_proximity_link", rf"""WITH s AS MATERIALIZED {_spans_sql('[A-Z][a-z]+|[.]')}, l AS MATERIALIZED {_spans_sql('ter|ion|ent|sch')}, p AS (SELECT * FROM s WHERE text <> '.'),
  q AS (SELECT p.doc_id, p.text AS person, p.start, max(s.start) AS place FROM p LEFT JOIN s ON s.doc_id = p.doc_id AND s.text = '.' AND abs(s.start - p.start) <= 300 GROUP BY 1, 2, 3),
  e AS (SELECT p.doc_id, p.start, bool_or(l.text IN ('ter', 'ion')) AS born FROM p JOIN l ON l.doc_id = p.doc_id AND abs(l.start - p.start) <= 200 GROUP BY 1, 2)
  SELECT q.doc_id, person, q.start, CASE WHEN place IS NOT NULL THEN '.' END AS place, CASE WHEN born THEN 'born' WHEN NOT born THEN 'died' END AS event FROM q LEFT JOIN e ON e.doc_id = q.doc_id AND e.start = q.start""")
def c7(spark, sf):
    """Every capitalised word is a person, every full stop a place; syllables stand for the
    words of birth and death."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    named = J.token_spans(d, "[A-Z][a-z]+|[.]").withColumn("label", F.when(F.col("text") == ".", "PLACE").otherwise("PERSON"))
    life = J.token_spans(d, "ter|ion|ent|sch").withColumn("label", F.when(F.col("text").isin("ter", "ion"), "BORN").otherwise("DIED"))
    out = J.proximity_link(named.unionByName(life), ["PLACE"])
    return out.select(F.col("id").alias("doc_id"), "person", "start", F.col("PLACE").alias("place"), F.when(F.col("born"), "born").when(F.col("died"), "died").alias("event"))


@query("c8_term_occurrences", """WITH terms AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:2], ' ') AS term FROM benchmark), h AS (SELECT doc_id, item_id, term, text, string_split(text, term) AS parts FROM documents JOIN terms ON contains(text, term)),
  o AS (SELECT doc_id, item_id, term, text, unnest(range(1, len(parts))) AS k, parts FROM h)
  SELECT doc_id, item_id, CAST(list_sum(list_transform(parts[1:k], lambda p: length(p))) + (k - 1) * length(term) AS BIGINT) AS start,
    substr(text, greatest(1, CAST(list_sum(list_transform(parts[1:k], lambda p: length(p))) + (k - 1) * length(term) AS BIGINT) - 29), length(term) + 30 + least(30, CAST(list_sum(list_transform(parts[1:k], lambda p: length(p))) + (k - 1) * length(term) AS BIGINT))) AS context FROM o""")
def c8(spark, sf):
    """Each place of each term, the first two words of an item, with 30 characters around it."""
    terms = table(spark, sf, "benchmark").select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("term"))
    return T.term_occurrences(table(spark, sf, "documents"), terms, "doc_id", "item_id")


PATTERNS = ["th[a-z]+", "[A-Z][a-z]+ [a-z]+", "ion", "e[a-z]*s", "(un|der) [a-z]+"]
BROKEN = "([a-z"


@query("c9_pattern_case_matrix", "WITH p AS (SELECT unnest(" + str(PATTERNS) + r""") AS pattern), c AS (SELECT item_id, text AS context, lower(string_split(text, ' ')[3]) AS target FROM benchmark)
  SELECT pattern, item_id, len(list_filter(regexp_extract_all(context, '(?i)' || pattern), lambda m: contains(lower(m), target))) > 0 AS hit FROM p, c
  UNION ALL SELECT '([a-z', item_id, false FROM c""")
def c9(spark, sf):
    """A rule table against every case; the broken pattern hits nothing."""
    c = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("context"), F.lower(F.get(F.split("text", " "), F.lit(2))).alias("target"))
    return R.pattern_cases(c, [*PATTERNS, BROKEN]).select("pattern", "item_id", "hit")


@query("c10_status_left_join", """SELECT c_custkey, coalesce(st, 'pending') AS status, coalesce(strftime(d, '%Y-%m-%d'), 'never') AS last_checked, coalesce(strftime(d + INTERVAL 30 DAY, '%Y-%m-%d'), 'now') AS next_check
  FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS st, max(o_orderdate) AS d FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def c10(spark, sf):
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("st"), F.max("o_orderdate").cast("date").alias("d"))
    c = table(spark, sf, "customer")
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    return c.join(last, c.c_custkey == last.o_custkey, "left").select("c_custkey", F.coalesce("st", F.lit("pending")).alias("status"), F.coalesce(day("d"), F.lit("never")).alias("last_checked"), F.coalesce(day(F.date_add("d", 30)), F.lit("now")).alias("next_check"))


@query("c11_next_unmastered", """WITH t AS (SELECT DISTINCT p_type AS topic FROM part), g AS (SELECT c_custkey, topic FROM customer, t), d AS (SELECT DISTINCT o_custkey, p_type FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_quantity > 40)
  SELECT c_custkey, min(topic) AS topic FROM g LEFT JOIN d ON o_custkey = c_custkey AND p_type = topic WHERE p_type IS NULL GROUP BY 1""")
def c11(spark, sf):
    """A topic is mastered by a large order of its type; topics have numbers in their order, and
    the next one is the first number that a customer lacks."""
    t = lambda n: table(spark, sf, n)
    topics = checkpointed(places(t("part").select(F.col("p_type").alias("topic")).distinct(), [], ["topic"], "number"))
    parts = t("part").join(topics, F.col("p_type") == F.col("topic")).select("p_partkey", "number")
    done = t("orders").join(t("lineitem").filter("l_quantity > 40"), F.col("o_orderkey") == F.col("l_orderkey")).join(parts, F.col("p_partkey") == F.col("l_partkey")).select(F.col("o_custkey").alias("c_custkey"), "number")
    gaps = W.first_gaps(done, "c_custkey", "number")
    wanted = t("customer").select("c_custkey").join(gaps, "c_custkey", "left").select("c_custkey", F.coalesce("gap", F.lit(1).cast("bigint")).alias("number"))
    return wanted.join(topics, "number").select("c_custkey", "topic")


@query("c12_term_lookup_table_refs", r"""SELECT doc_id, regexp_extract(code, 'spark\.table\("([a-z0-9_.]+)"\)', 1) AS name, CASE WHEN snap IS NULL THEN code ELSE replace(code, 'spark.table("' || regexp_extract(code, 'spark\.table\("([a-z0-9_.]+)"\)', 1) || '")', 'spark.read.parquet("' || snap || '")') END AS code
  FROM (SELECT doc_id, 'df = spark.table("db.' || lang || '").where(x)' AS code FROM documents) LEFT JOIN (VALUES ('db.en', '/snap/en'), ('db.fr', '/snap/fr')) m(n, snap) ON n = regexp_extract(code, 'spark\.table\("([a-z0-9_.]+)"\)', 1)""")
def c12(spark, sf):
    """References to tables in code lines, rewritten to their snapshots."""
    code = table(spark, sf, "documents").select("doc_id", F.concat(F.lit('df = spark.table("db.'), "lang", F.lit('").where(x)')).alias("code"))
    snapshots = spark.createDataFrame([("db.en", "/snap/en"), ("db.fr", "/snap/fr")], "name string, snap string")
    named = code.withColumn("name", F.regexp_extract("code", r'spark\.table\("([a-z0-9_.]+)"\)', 1)).join(F.broadcast(snapshots), "name", "left")
    new = F.replace("code", F.concat(F.lit('spark.table("'), "name", F.lit('")')), F.concat(F.lit('spark.read.parquet("'), "snap", F.lit('")')))
    return named.select("doc_id", "name", F.when(F.col("snap").isNull(), F.col("code")).otherwise(new).alias("code"))


