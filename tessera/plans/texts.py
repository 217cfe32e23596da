"""I: text, string, array and JSON functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import rules as R
from ..functions import texts as X
from .base import query, table

TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"


@query("i1_paragraph_chunks", r"""SELECT doc_id, CAST(k AS INTEGER) AS chunk, md5(p[k + 1]) AS h FROM (SELECT doc_id, p, unnest(range(0, len(p))) AS k FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), '\n\s*\n'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: length(p) >= 50) AS p FROM documents))""")
def i1(spark, sf):
    """Lines that end a sentence are taken as paragraph ends."""
    text = F.replace("text", F.lit(".\n"), F.lit(".\n\n"))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.paragraphs(text)).alias("chunk", "p")).select("doc_id", "chunk", F.md5("p").alias("h"))


@query("i2_recursive_chunks")
def i2(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return X.recursive_chunks(d).select("id", "chunk", F.char_length("text").alias("size"), F.md5("text").alias("h"))


@query("i2_fixed_chunks", "SELECT doc_id, k AS chunk, md5(substr(text, k * 800 + 1, 1000)) AS h FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 800.0) AS BIGINT)))) AS k FROM documents)")
def i2b(spark, sf):
    last = F.greatest(F.ceil(F.char_length("text") / 800), F.lit(1)) - 1
    d = table(spark, sf, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk"))
    return d.select("doc_id", "chunk", F.md5(F.substring(F.col("text"), (F.col("chunk") * 800 + 1).cast("int"), F.lit(1000))).alias("h"))


@query("i3_embed_text")
def i3(spark, sf):
    e = table(spark, sf, "documents").select("doc_id", X.embed_text(F.col("text"), 16).alias("v"))
    return e.select("doc_id", F.transform("v", lambda x: F.round(x, 4)).cast("string").alias("v"))


@query("i4_rule_scan", R.SCAN_SQL)
def i4(spark, sf):
    found = R.scan(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), R.TEXT_RULES)
    return found.select("id", "line", "rule", "snippet")


#: Lines of code around a word: one for each code rule, then two that nearly break one.
LINES = [
    "df = data .collect ( )  # {}", "{} = spark.read.csv(path, inferSchema = True)", "from pyspark.sql.functions import udf, {}", "{}.coalesce( 1 )", "n_{} = rows.count()", "from {} import *",
    "def {}(a, b=[]):", "    except :", "    print(\"{} is %d of '%s'\" % n)", "{}._{} = 1", "{} = df.collect(n)", "except {}:",
]
_QUOTED = [x.replace("'", "''") for x in LINES]
CODE_SQL = f"""SELECT id, CAST(line AS INTEGER) AS line, rule, kind, trim(snippet) AS snippet FROM (
    SELECT id, line, replace(CASE (length(w) + line) % {len(LINES)} {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_QUOTED))} END, '{{}}', w) AS snippet FROM (
      SELECT conv_id || '/' || turn AS id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) AS line FROM conversations)),
  (VALUES """ + ", ".join("('{}', '{}', '{}')".format(k, kind, p.replace("'", "''")) for k, (kind, p) in R.CODE_RULES.items()) + ") r(rule, kind, pattern) WHERE regexp_matches(snippet, pattern)"


def code_findings(spark, sf):
    """The ten code rules over sources with a line for each word of a conversation's turns."""
    words = table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.posexplode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("line", "w"))
    at = (F.char_length("w") + F.col("line") + 1) % len(LINES)
    line = F.replace(F.get(F.array(*map(F.lit, LINES)), at), F.lit("{}"), F.col("w"))
    ordered = F.sort_array(F.collect_list(F.struct("line", line.alias("text"))))
    sources = words.groupBy("id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
    return R.scan(sources, R.CODE_RULES)


@query("i4_code_rules", CODE_SQL)
def i4_code(spark, sf):
    return code_findings(spark, sf)


@query("d2_code_violations", f"SELECT rule, kind, count(*) AS n FROM ({CODE_SQL}) GROUP BY 1, 2")
def d2_code(spark, sf):
    return R.summary(code_findings(spark, sf))


_REPLY = "'Okay, ' || text || chr(10) || 'Let me explain [x]' || chr(10) || 'Speaker: ' || left(text, 40) || '<think>no' || chr(10) || '</think>'"


def reply():
    return F.concat(F.lit("Okay, "), "text", F.lit("\nLet me explain [x]\nSpeaker: "), F.substring("text", 1, 40), F.lit("<think>no\n</think>"))


def _clean_sql(text):
    out = f"regexp_replace({text}, '(?is)(<think>.*?</think>)', '', 'g')"
    for p in X.CHATTER:
        out = f"regexp_replace({out}, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return f"""array_to_string(list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: length(x) > 12 AND NOT starts_with(x, 'Okay') AND NOT starts_with(x, 'So ') AND NOT starts_with(x, 'First') AND NOT regexp_matches(x, '[{{}}<>\\[\\]()]')), chr(10))"""


@query("i5_clean_generated_text", f"SELECT conv_id, turn, md5({_clean_sql(_REPLY)}) AS h FROM conversations WHERE role = 'assistant'")
def i5(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'assistant'")
    return c.select("conv_id", "turn", F.md5(X.clean_generated(reply())).alias("h"))


@query("i6_generated_text_gate", """SELECT conv_id, turn, NOT regexp_matches(text, '(?i)(think|monologue|self.reference|internal)') AND length(text) >= length(coalesce(prompt, '')) * 0.5 AS ok FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prompt FROM conversations) WHERE role = 'assistant'""")
def i6(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = table(spark, sf, "conversations").withColumn("prompt", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w))
    return c.filter("role = 'assistant'").select("conv_id", "turn", X.passes_gate(F.col("text"), F.coalesce("prompt", F.lit(""))).alias("ok"))


_ESC = "map {" + ", ".join("'" + k.replace("'", "''") + "': '" + v.replace("'", "''") + "'" for k, v in X.ESCAPES.items()) + "}"


@query("i7_escape_markup", rf"SELECT item_id, md5(regexp_replace(array_to_string(list_transform(string_split(t, ''), lambda c: coalesce({_ESC}[c], c)), ''), '[^\x00-\x7F]', '', 'g')) AS h FROM (SELECT item_id, text || '$5_%~^\{{}}“é”<&>' AS t FROM benchmark)")
def i7(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.md5(X.escape_markup(F.concat("text", F.lit("$5_%~^\\{}“é”<&>")))).alias("h"))


@query("i8_section_parse", """WITH t AS (SELECT conv_id || '-' || turn AS id, 'IMPROVED_QUERY:' || chr(10) || text || chr(10) || 'SUGGESTIONS:' || chr(10) || '- one' || chr(10) || '-two ' || chr(10) || 'EXPLANATION:' || chr(10) || 'because' AS text FROM conversations),
  l AS (SELECT id, trim(line, ' ' || chr(9) || chr(13)) AS line, pos FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t)),
  n AS (SELECT *, CASE WHEN starts_with(line, 'IMPROVED_QUERY:') THEN 'improved_query' WHEN starts_with(line, 'SUGGESTIONS:') THEN 'suggestions' WHEN starts_with(line, 'CLARIFYING_QUESTIONS:') THEN 'clarifying_questions' WHEN starts_with(line, 'EXPLANATION:') THEN 'explanation' END AS label FROM l),
  s AS (SELECT *, last_value(label IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM n)
  SELECT id, section, md5(string_agg(line, ' ' ORDER BY pos)) AS h, coalesce(string_agg(CASE WHEN starts_with(line, '-') THEN trim(substr(line, 2), ' ' || chr(9)) END, '|' ORDER BY pos), '') AS bullets FROM s WHERE label IS NULL AND section IS NOT NULL AND line <> '' GROUP BY 1, 2""")
def i8(spark, sf):
    c = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("IMPROVED_QUERY:\n"), "text", F.lit("\nSUGGESTIONS:\n- one\n-two \nEXPLANATION:\nbecause")).alias("text"))
    out = X.sections(c, ["IMPROVED_QUERY", "SUGGESTIONS", "CLARIFYING_QUESTIONS", "EXPLANATION"])
    return out.select("id", "section", F.md5("text").alias("h"), F.array_join("bullets", "|").alias("bullets"))


_LIST = "'1. ' || replace(text, chr(10), ' ') || chr(10) || '2) tiny' || chr(10) || ' 3. ' || lang || ' list item' || chr(10) || 'x 4. no'"


@query("i9_numbered_list_parse", rf"SELECT doc_id, md5(array_to_string(list_filter(list_transform(regexp_extract_all({_LIST}, '(?m)^[ \t]*\d+[.)][ \t]+(.+)$', 1), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: length(x) > 5)[1:10], '|')) AS items FROM documents")
def i9(spark, sf):
    text = F.concat(F.lit("1. "), F.translate("text", "\n", " "), F.lit("\n2) tiny\n 3. "), "lang", F.lit(" list item\nx 4. no"))
    return table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(X.numbered_items(text), "|")).alias("items"))


@query("i10_graded_reply_parse", """SELECT conv_id, turn, CAST(CASE WHEN turn % 2 = 0 THEN turn % 6 ELSE 3 END AS INTEGER) AS grade, CASE WHEN turn % 2 = 0 THEN 'good work' ELSE '' END AS feedback, CASE WHEN turn % 2 = 0 THEN 'a|b' ELSE '' END AS rest FROM conversations""")
def i10(spark, sf):
    first = F.when(F.col("turn") % 2 == 0, (F.col("turn") % 6).cast("string")).otherwise("none")
    text = F.concat(F.lit(" "), first, F.lit("\n good work\n a\n\n b \n"))
    c = table(spark, sf, "conversations").select("conv_id", "turn", X.graded_reply(text).alias("g"))
    return c.select("conv_id", "turn", "g.grade", "g.feedback", F.array_join("g.rest", "|").alias("rest"))


@query("i11_extraction_checks", rf"""WITH e AS (SELECT item_id, regexp_extract_all(text, '\p{{Lu}}\p{{L}}+') AS a FROM benchmark), b AS (SELECT item_id, list_distinct(a) AS expected, CASE WHEN item_id % 3 = 0 THEN list_filter(list_distinct(a), lambda x: x <> a[1]) ELSE list_distinct(a) END AS lines FROM e WHERE len(a) > 0),
  c AS (SELECT item_id, [CASE WHEN len(lines) <> len(expected) THEN 'line_count' END, CASE WHEN len(list_filter(expected, lambda n: NOT list_contains(lines, n))) > 0 THEN 'all_present' END,
      CASE WHEN len(list_filter(expected, lambda n: regexp_matches(n, '[{P.MARKED}]') AND len(list_filter(lines, lambda x: contains(x, n))) = 0)) > 0 THEN 'marks_kept' END,
      CASE WHEN len(list_filter(expected, lambda n: regexp_matches(n, '[{P.MARKED}]') AND len(list_filter(lines, lambda x: contains(x, translate(n, '{P.MARKED}', '{P.PLAIN}')))) > 0)) > 0 THEN 'no_plain_form' END,
      CASE WHEN list_has_any(list_transform(lines, lambda x: lower(x)), {P.ROLES}) THEN 'no_labels' END] AS f FROM b)
  SELECT item_id, len(list_filter(f, lambda x: x IS NOT NULL)) = 0 AS passed, array_to_string(list_filter(f, lambda x: x IS NOT NULL), ',') AS failures FROM c""")
def i11(spark, sf):
    """Replies that list a benchmark item's capitalised words, some spoilt, against them."""
    b = table(spark, sf, "benchmark").select("item_id", F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{L}+"), F.lit(0))).alias("expected")).filter("size(expected) > 0")
    spoilt = F.when(F.col("item_id") % 3 == 0, F.slice("expected", F.lit(2), F.size("expected"))).otherwise(F.col("expected"))
    out = b.withColumn("output", F.array_join(F.transform(spoilt, lambda x: F.concat(F.lit("- "), x)), "\n"))
    return P.extraction_checks(out).select("item_id", "passed", F.array_join("failures", ",").alias("failures"))


@query("i12_titlecase_entities", r"SELECT doc_id, len(e) AS n, e[1] AS first, md5(array_to_string(e, '|')) AS h FROM (SELECT doc_id, regexp_extract_all(text, '\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*') AS e FROM documents)")
def i12(spark, sf):
    e = table(spark, sf, "documents").select("doc_id", X.title_entities(F.col("text")).alias("e"))
    return e.select("doc_id", F.size("e").cast("bigint").alias("n"), F.get("e", F.lit(0)).alias("first"), F.md5(F.array_join("e", "|")).alias("h"))


@query("i13_vital_record_parse", """SELECT c_custkey AS id, 'person' AS kind, string_split(c_name, '#')[1] AS first, 'Smith' AS last, 'London' AS place, CAST(1900 + c_custkey % 90 AS INTEGER) AS birth, NULL AS death, NULL AS spouse, '' AS children FROM customer
  UNION ALL SELECT c_custkey + 1000000, 'death', CASE WHEN c_custkey % 2 = 0 THEN 'John' ELSE 'Łucja' END, 'Smith' || c_nationkey, 'Łódź', NULL, CAST(1900 + c_custkey % 100 AS INTEGER), ['Mary Smith', 'Adam Nowak', 'Anna Lis', NULL][c_custkey % 4 + 1], ['Paul Smith|Sarah Smith', 'Ewa Nowak|Jan Nowak', '', 'Piotr Kot'][c_custkey % 4 + 1] FROM customer""")
def i13(spark, sf):
    """Person and death lines made from customers; four forms of what follows a death."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    person = c.select(k.alias("id"), F.format_string("%s Smith London %d", F.element_at(F.split("c_name", "#"), 1), F.lit(1900) + k % 90).alias("line"))
    forms = F.array(*map(F.lit, ["żona Mary Smith synowie: Paul Smith, córki: Sarah Smith", "mąż Adam Nowak, dzieci: Ewa Nowak, Jan Nowak", "żona Anna Lis", "syn Piotr Kot"]))
    name = F.when(k % 2 == 0, "John").otherwise("Łucja")
    death = c.select((k + 1_000_000).alias("id"), F.format_string("%02d %02d %d St%s %s Smith%d %d Łódź %s", k % 28 + 1, k % 12 + 1, F.lit(1900) + k % 100, name, name, F.col("c_nationkey"), k % 90 + 1, F.get(forms, (k % 4).cast("int"))).alias("line"))
    return P.vital_records(person.unionByName(death)).withColumn("children", F.array_join("children", "|"))


@query("i14_code_functions")
def i14(spark, sf):
    """Sources made from the benchmark's words."""
    name = F.regexp_replace(F.lower(F.get(F.split("text", " "), F.lit(0))), "[^a-z]", "")
    code = F.format_string("import os\n\ndef f_%s(x):\n    # note\n    return os.path.join(x, 'a#b')\n\nclass A:\n    def g(self, y=%d):\n        return y\n", name, F.col("item_id"))
    return P.code_functions(table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("path"), code.alias("code"))).select("path", "name", "start_line", F.md5("text").alias("text"), F.md5("ast").alias("ast"))


@query("i15_token_words", r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS n FROM documents")
def i15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.words(F.col("text"))).cast("bigint").alias("n"))


LANGUAGE_SQL = ", ".join(f"{{'n': len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in words)}))), 'o': {-i}, 'lang': '{k}'}}" for i, (k, words) in enumerate(sorted(X.STOP_WORDS.items())))


@query("i16_language_gate", rf"SELECT doc_id, list_max([{LANGUAGE_SQL}]).lang AS found, list_max([{LANGUAGE_SQL}]).lang = lang AS agrees FROM (SELECT doc_id, lang, string_split_regex(lower(text), '[^\p{{L}}]+') AS w FROM documents)")
def i16(spark, sf):
    found = X.language_of(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", "lang", found.alias("found")).select("doc_id", "found", (F.col("found") == F.col("lang")).alias("agrees"))


@query("i17_context_digest", """SELECT user_id AS id, md5('ITEMS: ' || count(*) || chr(10) || string_agg(i || '. ' || event_type, chr(10) ORDER BY i) FILTER (i <= 20) || CASE WHEN count(*) > 20 THEN chr(10) || '... and ' || (count(*) - 20) || ' more' ELSE '' END) AS digest
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) GROUP BY 1""")
def i17(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), F.col("event_type").alias("item"))
    return X.digest(e, 20).withColumn("digest", F.md5("digest"))


def _section(kind, heading, cap, rest, last=False):
    shown = f"list_filter(list({{'p': place, 'line': line}} ORDER BY place) FILTER (type = '{kind}' AND place <= {cap}), lambda x: x.line IS NOT NULL)"
    return f"""CASE WHEN count(*) FILTER (type = '{kind}') > 0 THEN chr(10) || '{heading}' || coalesce(list_aggregate(list_transform({shown}, lambda x: chr(10) || x.line), 'string_agg', ''), '')
    || CASE WHEN count(*) FILTER (type = '{kind}') > {cap} THEN chr(10) || '... and ' || (count(*) FILTER (type = '{kind}') - {cap}) || ' more {rest}' ELSE '' END || {"''" if last else 'chr(10)'} ELSE '' END"""


@query("i17_board_digest", f"""WITH b AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'shape' WHEN 'click' THEN 'sticky_note' WHEN 'purchase' THEN 'connector' WHEN 'signup' THEN 'frame' ELSE 'other' END AS type,
    CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type || ' of a board, number ' || event_id END AS content, lag(event_id) OVER w AS s, lead(event_id) OVER w AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  n AS (SELECT *, row_number() OVER (PARTITION BY user_id, type ORDER BY event_id) AS place FROM b),
  l AS (SELECT n.*, CASE n.type WHEN 'shape' THEN n.place || '. [' || CASE WHEN n.event_id % 2 = 1 THEN 'circle' ELSE 'rectangle' END || '] ' || nullif(n.content, '') WHEN 'frame' THEN n.place || '. ' || CASE WHEN n.event_id % 3 = 0 THEN 'Untitled Frame' ELSE 'frame ' || n.event_id END
      WHEN 'sticky_note' THEN n.place || '. ' || nullif(n.content, '') WHEN 'connector' THEN n.place || '. ' || chr(39) || left(x.content, 30) || chr(39) || ' --> ' || chr(39) || left(y.content, 30) || chr(39) END AS line
    FROM n LEFT JOIN b x ON x.event_id = n.s AND x.user_id = n.user_id LEFT JOIN b y ON y.event_id = n.e AND y.user_id = n.user_id)
  SELECT user_id AS board, md5('BOARD INFORMATION:' || chr(10) || '- Name: board ' || user_id || chr(10) || '- Total Items: ' || count(*) || chr(10) || '- Shapes: ' || count(*) FILTER (type = 'shape') || chr(10) || '- Sticky Notes: ' || count(*) FILTER (type = 'sticky_note')
    || chr(10) || '- Connectors: ' || count(*) FILTER (type = 'connector') || chr(10) || '- Frames: ' || count(*) FILTER (type = 'frame') || chr(10) || {' || '.join(_section(*x, last=x[0] == 'frame') for x in X.SECTIONS)}) AS digest FROM l GROUP BY 1""")
def i17_board(spark, sf):
    """Boards of users; a connection joins the events before and after it."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    kind = F.when(F.col("event_type") == "view", "shape").when(F.col("event_type") == "click", "sticky_note").when(F.col("event_type") == "purchase", "connector").when(F.col("event_type") == "signup", "frame").otherwise("other")
    content = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.concat("event_type", F.lit(" of a board, number "), F.col("event_id").cast("string")))
    items = table(spark, sf, "events").select(
        F.col("user_id").alias("board"), F.concat(F.lit("board "), F.col("user_id").cast("string")).alias("name"), F.col("event_id").alias("id"), F.col("event_id").alias("pos"), kind.alias("type"), content.alias("content"),
        F.when(F.col("event_id") % 2 == 1, "circle").alias("shape"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("frame "), F.col("event_id").cast("string"))).alias("title"), F.lag("event_id").over(w).alias("start"), F.lead("event_id").over(w).alias("end"))
    return X.board_digest(items).withColumn("digest", F.md5("digest"))


_GRAPH = """(SELECT l_orderkey AS graph, 'o' || l_orderkey AS s, 'n' || l_linenumber AS e, 'part ' || l_partkey AS label, l_linenumber AS pos FROM lineitem)"""


def order_graphs(spark, sf):
    """A small graph per order: an edge from it to each of its lines."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("graph"), F.concat(F.lit("n"), "l_linenumber").alias("id"), F.concat(F.lit("part "), "l_partkey").alias("label"), F.col("l_linenumber").alias("pos"))
    return P.graph_texts(lines, lines.select("graph", F.concat(F.lit("o"), "graph").alias("start"), F.col("id").alias("end"), "pos"))


def _joined(line, sep="chr(10)"):
    return f"string_agg({line}, {sep} ORDER BY pos, {line})"


@query("i18_graph_text_export", f"""SELECT graph, 'graph TD' || chr(10) || {_joined("'    ' || e || '[\"' || label || '\"]'")} || chr(10) || {_joined("'    ' || s || ' --> ' || e")} AS mermaid,
  '@startuml' || chr(10) || {_joined("'rectangle \"' || label || '\" as ' || e")} || chr(10) || {_joined("s || ' --> ' || e")} || chr(10) || '@enduml' AS plantuml FROM {_GRAPH} GROUP BY 1""")
def i18(spark, sf):
    return order_graphs(spark, sf).select("graph", "mermaid", "plantuml")


@query("i18_graph_text_other_formats", f"""SELECT graph, md5('<XMI>' || chr(10) || {_joined("'    <uml:Class id=\"' || e || '\" name=\"' || label || '\"/>'")} || chr(10) || {_joined("'    <uml:Association from=\"' || s || '\" to=\"' || e || '\"/>'")} || chr(10) || '</XMI>') AS xmi,
  md5({_joined("'class ' || e || ': ' || label")} || chr(10) || {_joined("s || ' -> ' || e")}) AS types,
  md5('{{"nodes": [' || {_joined("'{\"$id\":\"' || e || '\",\"title\":\"' || label || '\"}'", "','")} || '], "edges": [' || {_joined("'{\"from\":\"' || s || '\",\"to\":\"' || e || '\"}'", "','")} || ']}}') AS json_schema,
  md5('nodes:' || chr(10) || {_joined("'  - id: ' || e || chr(10) || '    label: ' || label")} || chr(10) || 'edges:' || chr(10) || {_joined("'  - from: ' || s || chr(10) || '    to: ' || e")}) AS yaml FROM {_GRAPH} GROUP BY 1""")
def i18b(spark, sf):
    return order_graphs(spark, sf).select("graph", *(F.md5(c).alias(c) for c in ("xmi", "types", "json_schema", "yaml")))


@query("i19_slide_parse", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, 'Turn' AS title, role AS visual, 'says ' || turn AS narration, CASE WHEN turn % 2 = 0 THEN 30 END AS duration FROM conversations")
def i19(spark, sf):
    """Slides made from each conversation's turns."""
    block = F.concat(F.lit("## Slide "), F.col("turn").cast("string"), F.lit(": Turn\n### Visual\n"), "role", F.lit("\n### Narration\nsays "), F.col("turn").cast("string"), F.when(F.col("turn") % 2 == 0, "\n### Duration\n30").otherwise(""))
    c = table(spark, sf, "conversations").select("conv_id", F.struct("turn", block.alias("b")).alias("s")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["b"]), "\n---\n").alias("text"))
    s = c.select("conv_id", F.posexplode(X.slides(F.col("text"))).alias("pos", "s"))
    return s.select("conv_id", "pos", "s.title", "s.visual", "s.narration", "s.duration")


_BI = r"""WITH c AS (SELECT list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS w FROM benchmark), s AS (SELECT unnest(w[1:len(w) - 1]) AS a, unnest(w[2:len(w)]) AS b FROM c), n2 AS (SELECT a, b, count(*) AS n2 FROM s GROUP BY 1, 2), n1 AS (SELECT a, count(*) AS n1 FROM s GROUP BY 1),
  v AS (SELECT count(*) AS v FROM (SELECT a FROM s UNION SELECT b FROM s)), d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS w FROM documents), p AS (SELECT doc_id, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:len(w)]) AS b FROM d WHERE len(w) > 1)
  SELECT doc_id AS id, round(exp(avg(-ln((coalesce(n2, 0) + 1) / (coalesce(n1, 0) + v + 1.0::DOUBLE)))), 2) AS perplexity FROM p LEFT JOIN n2 USING (a, b) LEFT JOIN n1 USING (a), v GROUP BY 1"""


@query("i20_text_perplexity", _BI)
def i20(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return X.bigram_perplexity(d, table(spark, sf, "benchmark").select("text")).withColumn("perplexity", F.round("perplexity", 2))
