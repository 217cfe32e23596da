"""A: sources, sinks, incremental ingest.

Queries of file formats first write files made from the given tables to the shared folder,
then read them back through the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.storage import shared_folder
from ..sources import files as S
from ..sources import sinks
from .base import query, table
from .texts import LANGUAGE_SQL


@query("a1_mbox_scan", "SELECT conv_id || '-' || turn AS subject, role || '@example.org' AS from_email, CAST(2 AS BIGINT) AS recipients, md5(regexp_replace(replace(text, chr(10), ' '), '^ +', '')) AS h FROM conversations")
def a1(spark, sf):
    body = F.regexp_replace(F.translate("text", "\n", " "), "^ +", "")
    c = table(spark, sf, "conversations").select(F.concat(F.lit("From x Thu Jan  4 00:00:00 2024\nSubject: "), "conv_id", F.lit("-"), "turn", F.lit("\nFrom: "), "role", F.lit("@example.org\nTo: a@x.org, B <b@x.org>\nDate: Thu, 04 Jan 2024 00:00:00 +0000\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.encode(body, "utf-8"))).alias("value"))
    c.write.text(path := shared_folder(spark))
    m = S.mbox_scan(spark, path)
    return m.select("subject", "from_email", F.size("recipients").cast("bigint").alias("recipients"), F.md5("body").alias("h"))


def written(spark, sf):
    d = table(spark, sf, "documents")
    folder = shared_folder(spark)
    d.select("lang", "text").repartition(2, "lang").write.partitionBy("lang").text(f"{folder}/texts")
    d.select("doc_id", "lang", "source").write.option("header", True).csv(f"{folder}/rows")
    return folder


@query("a2_file_scan", "SELECT lang, '.txt' AS extension, true AS named, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS line_ends FROM documents GROUP BY 1")
def a2(spark, sf):
    """The text files of each folder: their bytes, and the line ends in their content, which are
    the lines, but for a last one that no line feed ends."""
    folder = written(spark, sf)
    files = S.file_scan(spark, folder, [".txt"]).select("path", "filename", "extension", "length")
    lines = S.file_lines(spark, folder, [".txt"]).groupBy("path").agg(F.count("*").alias("n"), F.first("length").alias("size"), F.sum(F.octet_length("line").cast("bigint")).alias("held"))
    lang = lambda: F.regexp_extract("path", "lang=([a-z]+)/", 1).alias("lang")
    ends = lines.select(lang(), F.least("n", F.col("size") - F.col("held")).alias("ends")).groupBy("lang").agg(F.sum("ends").alias("line_ends"))
    about = files.groupBy(lang(), "extension").agg(F.bool_and(F.col("filename").rlike("^part-.*[.]txt$")).alias("named"), F.sum("length").alias("bytes"))
    return about.join(ends, "lang").select("lang", "extension", "named", "bytes", "line_ends")


_RULES = [("", "*.org/es/*"), ("", "node_modules/"), ("http:", "**/en/1*")]


@query("a3_exclude_paths", """SELECT page_id FROM pages WHERE NOT regexp_matches(p, '^[^/]*\\.org/es/[^/]*(/|$)') AND NOT regexp_matches(p, '^(.*/)?node_modules(/|$)') AND NOT regexp_matches(p, '^http\\:/.*/en/1[^/]*(/|$)') AND NOT regexp_matches(p, '(^|/)\\.[^/]+/') AND NOT regexp_matches(p, '(^|/)de/')
  AND true""".replace("FROM pages", "FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages)"))
def a3(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("p"))
    return S.exclude_paths(p, F.col("p"), S.ignore_patterns(_RULES), ["de"]).select("page_id")


@query("a4_wet_scan", f"""SELECT 'http://x/' || doc_id AS url, md5(t) AS h FROM (SELECT doc_id, t, string_split_regex(lower(t), '[^\\p{{L}}]+') AS w FROM (SELECT doc_id, trim(text, ' ' || chr(10) || chr(13)) AS t FROM documents WHERE source <> 'src1'))
  WHERE length(t) >= 300 AND list_max([{LANGUAGE_SQL}]).lang = 'en'""")
def a4(spark, sf):
    """Archives made from documents; records of another kind, short texts and texts in
    other languages do not pass."""
    kind = F.when(F.col("source") != "src1", "conversion").otherwise("warcinfo")
    d = table(spark, sf, "documents").select(F.concat(F.lit("WARC/1.0\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Target-URI: http://x/"), "doc_id", F.lit("\r\nContent-Type: text/plain\r\n\r\n"), "text", F.lit("\r\n\r\n")).alias("value"))
    d.write.option("compression", "gzip").option("lineSep", "\n").text(path := shared_folder(spark))
    return S.wet_scan(spark, path).select("url", F.md5("text").alias("h"))


@query("a5_manifest_minus_done", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a5(spark, sf):
    return S.manifest_minus_done(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("a6_html_or_text_load", """SELECT 'csv' AS kind, count(*) AS n, CAST(sum(length('{"doc_id":"' || doc_id || '","lang":"' || lang || '","source":"' || source || '"}')) AS BIGINT) AS chars FROM documents
  UNION ALL SELECT 'text', count(DISTINCT lang), CAST(sum(length(text) + 1) AS BIGINT) FROM documents""")
def a6(spark, sf):
    """Text files and csv records, with all their characters; a large file is several rows."""
    out = S.load_documents(spark, written(spark, sf))
    n = F.when(F.first("kind") == "text", F.count_distinct(F.when(F.col("kind") == "text", F.col("path")))).otherwise(F.count("*"))
    return out.groupBy("kind").agg(n.alias("n"), F.sum(F.char_length("text").cast("bigint")).alias("chars"))


@query("a7_notebook_cells", "SELECT doc_id, md5('print(' || doc_id || ')' || chr(10) || lang || chr(10) || 'x = 1') AS h FROM documents")
def a7(spark, sf):
    cell = lambda kind, *source: F.struct(F.lit(kind).alias("cell_type"), F.array(*source).alias("source"))
    cells = F.array(cell("markdown", "text"), cell("code", F.concat(F.lit("print("), "doc_id", F.lit(")\n")), F.col("lang")), cell("code", F.lit("x = 1")))
    return table(spark, sf, "documents").select("doc_id", F.md5(S.notebook_code(F.to_json(F.struct(cells.alias("cells"))))).alias("h"))


@query("a8_jsonl_append_sink", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1")
def a8(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    path = shared_folder(spark)
    for _ in range(2):
        sinks.append_jsonl(e, path)
    return spark.read.schema(e.schema).json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("a9_csv_json_export", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a9(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    path = shared_folder(spark)
    sinks.export(e, f"{path}/csv", "csv")
    sinks.export(e, f"{path}/json", "json")
    both = spark.read.schema(e.schema).csv(f"{path}/csv", header=True).join(spark.read.schema(e.schema).json(f"{path}/json"), ["event_id", "event_type"])
    return both.groupBy("event_type").agg(F.count("*").alias("n"))


@query("a10_tuple_csv_gz_sink", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def a10(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    sinks.append_tuples(d, path := shared_folder(spark))
    return spark.read.schema(d.schema).csv(path, header=True).groupBy("lang").agg(F.count("*").alias("n"))


@query("a11_table_snapshot", "SELECT 'orders' AS name, count(*) AS n FROM orders")
def a11(spark, sf):
    code = table(spark, sf, "nation").select(F.when(F.col("n_nationkey") == 0, "spark.table('lineitem')").when(F.col("n_nationkey") < 3, "x = spark.table('orders').where(y)").otherwise("pass").alias("code"))
    used = {r["name"]: r["n"] for r in S.table_references(code).collect()}
    made = sinks.snapshot_tables(spark, {n: f"{sf}/{n}.parquet" for n in ("orders", "lineitem")}, used, shared_folder(spark), slow=3600)
    return spark.read.parquet(made["orders"]).agg(F.lit("orders").alias("name"), F.count("*").alias("n")).select("name", "n")


@query("a12_report_bundle", """WITH e AS (SELECT CASE WHEN length(text) >= 200 THEN 'analysed' ELSE 'failed' END AS state, conv_id || '-' || turn || ':' || role AS detail FROM conversations)
  SELECT 'summary' AS part, state, count(*) AS n, NULL AS detail FROM e GROUP BY state UNION ALL SELECT 'result', state, 1, detail FROM e""")
def a12(spark, sf):
    detail = F.concat("conv_id", F.lit("-"), "turn", F.lit(":"), "role")
    return S.report_bundle(table(spark, sf, "conversations"), F.char_length("text") >= 200, detail)
