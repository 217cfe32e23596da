"""B: projections, filters, predicates, row scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import scoring as S
from .base import query, table

AS_OF = "2001-01-01 00:00:00"


@query("b1_pending_embedding", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def b1(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").filter(F.col("quality").isNull()).select("doc_id")


@query("b2_valid_vectors", """SELECT CASE WHEN e IS NULL THEN 'undecodable' WHEN len(e) = 0 THEN 'empty' WHEN len(e) <> 63 THEN 'dimension' ELSE 'valid' END AS reason, count(*) AS n
  FROM (SELECT CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 7 = 1 THEN [] WHEN vec_id % 7 = 2 THEN embedding ELSE embedding[1:63] END AS e FROM embeddings) GROUP BY 1""")
def b2(spark, sf):
    """Vectors kept as JSON text, with the reason for which a row is dropped."""
    v, n = F.col("embedding"), F.col("vec_id") % 7
    stored = F.when(n == 0, F.lit("{broken")).when(n == 1, F.lit("[]")).when(n == 2, F.to_json("embedding")).otherwise(F.to_json(F.slice(v, 1, 63)))
    reason = F.coalesce(S.vector_fault(F.col("stored"), 63), F.lit("valid"))
    return table(spark, sf, "embeddings").select(stored.alias("stored")).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("b3_quality_band", "SELECT event_id, CASE WHEN value / 300 >= 0.75 THEN 'high' WHEN value / 300 >= 0.60 THEN 'medium' ELSE 'low' END AS band FROM events")
def b3(spark, sf):
    return table(spark, sf, "events").select("event_id", S.quality_band(F.col("value") / 300).alias("band"))


@query("b4_value_range_filter", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 905 AND 910.5")
def b4(spark, sf):
    return S.in_value_range(table(spark, sf, "part"), "p_retailprice", 905, 910.5).select("p_partkey", "p_retailprice")


@query("b5_category_exclude", "SELECT a.p_partkey AS item, b.p_partkey AS other FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_type <> b.p_type")
def b5(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    return S.other_category(p, p, ["p_brand", "p_size"], "p_type").select(F.col("item_p_partkey").alias("item"), F.col("other_p_partkey").alias("other"))


@query("b6_listing_query", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 100000 ORDER BY o_totalprice DESC, o_orderkey")
def b6(spark, sf):
    return S.listings(table(spark, sf, "orders"), F.col("o_orderpriority"), "o_totalprice", "o_orderkey", "1-URGENT", 100000).select("o_orderkey", "o_totalprice")


@query("b7_due_filter", """SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) + INTERVAL 30 DAY AS next FROM orders GROUP BY 1) ON o_custkey = c_custkey
  WHERE next IS NULL OR next <= TIMESTAMP '2001-01-01 00:00:00'""")
def b7(spark, sf):
    last = table(spark, sf, "orders").groupBy("o_custkey").agg((F.max("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("next"))
    c = table(spark, sf, "customer").select("c_custkey")
    return S.due(c, last.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "next", F.lit(AS_OF).cast("timestamp_ntz"))


@query("b8_rule_validate", """SELECT coalesce(CASE WHEN NOT coalesce(length(trim(p_name)) > 0, false) THEN 'name is required' END,
  CASE WHEN NOT (p_retailprice > 901) THEN 'value must be above the least' END, CASE WHEN NOT (p_size <= 40) THEN 'size is too large' END, 'ok') AS verdict, count(*) AS n FROM part GROUP BY 1""")
def b8(spark, sf):
    rules = [(F.char_length(F.trim("p_name")) > 0, "name is required"), (F.col("p_retailprice") > 901, "value must be above the least"), (F.col("p_size") <= 40, "size is too large")]
    return table(spark, sf, "part").groupBy(F.coalesce(S.first_failure(rules), F.lit("ok")).alias("verdict")).agg(F.count("*").alias("n"))


@query("b9_unique_key_check", """WITH batch AS (SELECT c_custkey % 97 + 100 AS k, c_custkey AS place FROM customer), r AS (
  SELECT k, place, row_number() OVER (PARTITION BY k ORDER BY place) AS nth FROM batch)
  SELECT k, place, CASE WHEN k IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) THEN 'exists' WHEN nth > 1 THEN 'repeated' ELSE 'new' END AS verdict FROM r""")
def b9(spark, sf):
    c = table(spark, sf, "customer")
    batch = c.select((F.col("c_custkey") % 97 + 100).alias("k"), F.col("c_custkey").alias("place"))
    there = c.filter("c_nationkey < 12").select(F.col("c_custkey").alias("k"))
    return S.unique_key_check(batch, there, "k", "place").select("k", "place", "verdict")


def _case(value, names, other):
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in names.items()) + f" ELSE {other} END"


_MULTIPLIER = "least(1.5, " + " * ".join([f"(CASE WHEN contains(lower({{0}}), '{w}') THEN 1.1 ELSE 1.0 END)::DOUBLE" for w in S.POSITIVE] + [f"(CASE WHEN contains(lower({{0}}), '{w}') THEN 0.9 ELSE 1.0 END)::DOUBLE" for w in S.NEGATIVE]) + ")"
_CATEGORIES = ["electronics", "jewelry", "collectibles", "tools", "unknown"]
_BRANDS = ["apple", "rolex", "", "noname"]
_CONDITIONS = ["poor", "fair", "good", "excellent", "odd"]


def pick(names, key):
    return F.get(F.array(*map(F.lit, names)), (key % len(names)).cast("int"))


def _pick_sql(names, key):
    return f"(['{chr(39).join([]) + (chr(39) + ', ' + chr(39)).join(names)}'])[({key}) % {len(names)} + 1]"


@query("b10_item_value_estimate", f"""WITH i AS (SELECT p_partkey, p_retailprice, p_name, {_pick_sql(_CATEGORIES, 'p_partkey')} AS category, {_pick_sql(_BRANDS, 'p_size')} AS brand, {_pick_sql(_CONDITIONS, 'p_partkey // 7')} AS cond FROM part)
  SELECT p_partkey, round(p_retailprice * ({_case('category', S.CATEGORY, '1.0')}::DOUBLE * (CASE WHEN brand <> '' THEN {_case('brand', S.BRAND, '1.1')} ELSE 1.0 END)::DOUBLE * {_case('cond', S.CONDITION, '1.0')}::DOUBLE * {_MULTIPLIER.format('p_name')}), 2) AS value FROM i""")
def b10(spark, sf):
    i = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_name", pick(_CATEGORIES, F.col("p_partkey")).alias("category"), pick(_BRANDS, F.col("p_size")).alias("brand"), pick(_CONDITIONS, F.floor(F.col("p_partkey") / 7)).alias("cond"))
    return i.select("p_partkey", S.item_value(F.col("p_retailprice"), F.col("category"), F.col("brand"), F.col("cond"), F.col("p_name")).alias("value"))


@query("b11_keyword_multiplier", f"SELECT doc_id, round(CASE WHEN coalesce(text, '') = '' THEN 1.0 ELSE {_MULTIPLIER.format('text')} END, 6) AS multiplier FROM documents")
def b11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(S.keyword_multiplier(F.col("text")), 6).alias("multiplier"))


@query("b12_value_step_band", """SELECT p_partkey, v, CASE WHEN v < 10 THEN 0.5 WHEN v < 100 THEN 0.3 WHEN v < 1000 THEN 0.2 WHEN v < 5000 THEN 0.1 ELSE 0.05 END::DOUBLE AS lo,
  CASE WHEN v < 10 THEN 1.0 WHEN v < 100 THEN 0.5 WHEN v < 1000 THEN 0.3 WHEN v < 5000 THEN 0.15 ELSE 0.1 END::DOUBLE AS hi FROM (SELECT p_partkey, p_size * p_size * 3 AS v FROM part)""")
def b12(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * F.col("p_size") * 3).alias("v"))
    return p.select("p_partkey", "v", S.step_band(F.col("v")).alias("s")).select("p_partkey", "v", "s.lo", "s.hi")


_PARTS = "part AS a JOIN part b ON a.p_size = b.p_size AND a.p_partkey < b.p_partkey"
_FIT = {"ECONOMY": ["ECONOMY", "MEDIUM"], "LARGE": ["LARGE", "PROMO"]}


def _part_pairs(spark, sf, first, second, alike):
    """Parts of one size with all parts of greater keys: first and second map names to columns."""
    p = table(spark, sf, "part")
    side = lambda key, columns: p.select("p_size", F.col("p_partkey").alias(key), *(c.alias(n) for n, c in columns.items()))
    return J.block_pairs(side("f", first), side("t", second), ["p_size"], below=("f", "t"), alike=alike)


@query("b13_trade_score", f"""SELECT f, t, greatest(least(70 + CASE WHEN (fc = 'ECONOMY' AND tc IN ('ECONOMY', 'MEDIUM')) OR (fc = 'LARGE' AND tc IN ('LARGE', 'PROMO')) THEN 10 ELSE 0 END
    + CASE WHEN r < 0.2 THEN 15 WHEN r < 0.5 THEN 10 WHEN r > 1.0 THEN -20 ELSE 0 END + CASE WHEN fb <> '' THEN 10 ELSE 0 END, 95), 10) AS score
  FROM (SELECT a.p_partkey AS f, b.p_partkey AS t, a.p_type AS fc, b.p_type AS tc, a.p_brand AS fb, (b.p_partkey + 1.0 - (a.p_partkey + 1.0)) / (a.p_partkey + 1.0) AS r FROM {_PARTS})""")
def b13(spark, sf):
    c = F.col
    pairs = _part_pairs(spark, sf, {"fc": c("p_type"), "fb": c("p_brand")}, {"tc": c("p_type")}, "tc")
    return pairs.select("f", "t", S.trade_score(c("fc"), c("f") + 1.0, c("fb"), c("tc"), c("t") + 1.0, compatible=_FIT).alias("score"))


_MARKETS = list(S.MARKETPLACE) + ["other"]


@query("b14_listing_score", f"""SELECT p_partkey, s_suppkey, CAST(greatest(least(60 + CASE WHEN r >= 1.05 AND r <= 1.5 THEN 20 WHEN r >= 1.0 AND r <= 1.05 THEN 10 WHEN r > 2.0 THEN -30 ELSE 0 END
    - least(p_size * 2, 20) + CASE m WHEN 'Facebook Marketplace' THEN 5 WHEN 'Craigslist' THEN 0 WHEN 'OfferUp' THEN 3 WHEN 'eBay' THEN 8 ELSE 0 END, 95), 10) AS INTEGER) AS score
  FROM (SELECT p_partkey, s_suppkey, p_size, {_pick_sql(_MARKETS, 'p_partkey')} AS m, p_retailprice / (s_acctbal / 5) AS r FROM part JOIN supplier ON s_nationkey = p_size % 25 WHERE s_acctbal > 0)""")
def b14(spark, sf):
    p = table(spark, sf, "part").select((F.col("p_size") % 25).alias("nation"), "p_partkey", "p_retailprice", "p_size")
    s = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    score = S.listing_score(F.col("s_acctbal") / 5, F.col("p_retailprice"), F.col("p_size"), pick(_MARKETS, F.col("p_partkey")))
    return J.block_pairs(p, s, ["nation"], alike="s_acctbal").select("p_partkey", "s_suppkey", score.cast("int").alias("score"))


@query("b15_pct_increase", """SELECT o_orderkey, round(CASE WHEN old = 0 THEN 0.0 ELSE (o_totalprice - old) / old * 100 END, 3) AS pct, '$' || format('{:,.2f}', o_totalprice) AS price
  FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE 1000.0 + o_custkey END::DOUBLE AS old FROM orders)""")
def b15(spark, sf):
    old = F.when(F.col("o_orderkey") % 10 == 0, 0.0).otherwise(1000.0 + F.col("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", F.round(S.pct_increase(old, F.col("o_totalprice")), 3).alias("pct"), S.format_currency(F.col("o_totalprice")).alias("price"))


@query("b16_time_ago", """SELECT event_id, CASE WHEN s >= 86400 THEN (s // 86400) || 'd ago' WHEN s >= 3600 THEN (s // 3600) || 'h ago' WHEN s >= 60 THEN (s // 60) || 'm ago' ELSE 'Just now' END AS ago
  FROM (SELECT event_id, CAST(floor(epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts)) AS BIGINT) AS s FROM events)""")
def b16(spark, sf):
    return table(spark, sf, "events").select("event_id", S.time_ago(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).alias("ago"))


@query("b17_human_bytes", """SELECT doc_id, CASE WHEN n < 1024 THEN format('{:.2f} B', n::DOUBLE) WHEN n < 1048576 THEN format('{:.2f} KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN format('{:.2f} MB', n / 1048576.0::DOUBLE)
  ELSE format('{:.2f} GB', n / 1073741824.0::DOUBLE) END AS size FROM (SELECT doc_id, CAST(n_chars * n_chars + 3 AS BIGINT) AS n FROM documents)""")
def b17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.human_bytes((F.col("n_chars") * F.col("n_chars") + 3).cast("double")).alias("size"))


@query("b18_sanitize_name", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g'), '^[-_]+', '') AS c, url FROM pages),
  b AS (SELECT page_id, url, regexp_replace(CASE WHEN regexp_matches(c, '^[\p{L}\p{N}]') THEN c ELSE 'p_' || c END, '[-_]+$', '') AS c FROM a)
  SELECT page_id, lower(CASE WHEN length(c) < 3 THEN c || '_collection' ELSE substr(c, 1, 63) END) AS name, regexp_replace(substr(url, 1, 30), '[^A-Za-z0-9_]', '_', 'g') AS slug FROM b""")
def b18(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.sanitize_name(F.col("url")).alias("name"), S.slug(F.col("url")).alias("slug"))


@query("b19_template_message", """SELECT a.p_partkey AS f, b.p_partkey AS t, CASE WHEN b.p_partkey - a.p_partkey > 50 THEN 'I would trade my ' || a.p_name || ' ($' || format('{:.1f}', a.p_retailprice) || ') for your ' || b.p_name || ': a large step'
    WHEN b.p_partkey - a.p_partkey > 10 THEN 'Would you trade your ' || b.p_name || ' for my ' || a.p_brand || ' ' || a.p_name || '?' ELSE 'My ' || a.p_name || ' for your ' || b.p_name || '?' END AS message,
    'Traded ' || a.p_name || ' for ' || b.p_name || ': $' || format('{:.2f}', b.p_partkey * 1.0 - a.p_partkey::DOUBLE) AS story FROM """ + _PARTS)
def b19(spark, sf):
    """The long, middle or short text, by the gap in value, with its fields filled in.  What
    one part says is said before parts meet."""
    c, cat = F.col, F.concat
    name, lit = c("p_name"), F.lit
    price = F.when(c("p_retailprice").isNotNull(), F.format_string("%.1f", "p_retailprice"))
    first = {"long": cat(lit("I would trade my "), name, lit(" ($"), price, lit(") for your ")), "middle": cat(lit(" for my "), c("p_brand"), lit(" "), name, lit("?")), "short": cat(lit("My "), name, lit(" for your ")), "traded": cat(lit("Traded "), name, lit(" for "))}
    gap = c("t") - c("f")
    message = F.when(gap > 50, cat("long", "name", lit(": a large step"))).when(gap > 10, cat(lit("Would you trade your "), "name", "middle")).otherwise(cat("short", "name", lit("?")))
    story = cat("traded", "name", lit(": $"), gap.cast("string"), lit(".00"))
    return _part_pairs(spark, sf, first, {"name": name}, "name").select("f", "t", message.alias("message"), story.alias("story"))


_SECRETS = ["API_KEY", "TOKEN", "api_key", "password"]


@query("b20_redact_secrets", r"""SELECT doc_id, md5(regexp_replace(t, '(?m)^(API_KEY|TOKEN|api_key|password)=[^\r\n]*', '\1=***REDACTED***', 'g')) AS redacted, CAST(len(regexp_extract_all(t, '(?m)^(API_KEY|TOKEN|api_key|password)=')) AS INTEGER) AS hits
  FROM (SELECT doc_id, 'TOKEN=' || doc_id || chr(10) || text || chr(10) || 'password=x' AS t FROM documents)""")
def b20(spark, sf):
    text = F.concat(F.lit("TOKEN="), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"), F.lit("\npassword=x"))
    return table(spark, sf, "documents").select("doc_id", F.md5(S.redact_secrets(text, _SECRETS)).alias("redacted"), S.count_secrets(text, _SECRETS).alias("hits"))
