"""Regular-expression rules over the lines of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The ten rules for Python sources, by id.
CODE_RULES = {
    "PS001": ("pyspark", r"(df|spark|data)\s*\.(collect|toPandas)\s*\(\s*\)"),
    "PS002": ("pyspark", r"inferSchema\s*=\s*True"),
    "PS003": ("pyspark", r"from\s+pyspark\.sql\.functions\s+import\s+udf"),
    "PS004": ("pyspark", r"\.(repartition|coalesce)\s*\(\s*1\s*\)"),
    "PS005": ("pyspark", r"\.count\s*\(\s*\)"),
    "PY001": ("python", r"from\s+.*\s+import\s+\*"),
    "PY002": ("python", r"def\s+\w+\s*\(.*=\s*(\[\]|\{\}|\w+\.acquire\(\))\s*\):"),
    "PY003": ("python", r"^\s*except\s*:\s*$"),
    "PY004": ("python", r"[\"'].*?%[dsif].*?[\"'].*?%"),
    "PY005": ("python", r"\.\s*_[a-zA-Z_]\w*"),
}

#: Rules for prose, used where no source code is at hand.
TEXT_RULES = {
    "TX001": ("text", r"[#$%&*]{3}"),
    "TX002": ("text", r"[A-Z]{4,}!!"),
    "TX003": ("text", r"^\s*$"),
    "TX004": ("text", r"[a-z]+@[a-z]+\.[a-z]+"),
    "TX005": ("text", r"licen[cs]ed? under"),
}


def compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether a pattern is a regular expression; patterns are a small table on the driver."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def pattern_cases(cases: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """The cases (context, target in lower case) with each pattern, and hit: whether a match
    in any case of letters contains the target.  A broken pattern hits nothing."""

    def hit(pattern: str) -> Column:
        if not compiles(cases.sparkSession, f"(?i){pattern}"):
            return F.lit(False)
        found = F.regexp_extract_all("context", F.lit(f"(?i){pattern}"), F.lit(0))
        return F.coalesce(F.exists(found, lambda m: F.contains(F.lower(m), F.col("target"))), F.lit(False))

    each = F.array(*(F.struct(F.lit(p).alias("pattern"), hit(p).alias("hit")) for p in patterns))
    return cases.select("*", F.explode(each).alias("_p")).select(*cases.columns, "_p.pattern", "_p.hit")


def scan(texts: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """id, line (from 1), rule, kind, snippet: at most one finding per line and rule.

    texts: id, text.  The rules become one array of columns, so a line is read once and no
    join is needed.  A rule whose pattern is broken finds nothing."""
    rules = {k: r for k, r in rules.items() if compiles(texts.sparkSession, r[1])}
    if not rules:
        return texts.select("id", *(F.lit(None).cast(t).alias(c) for c, t in (("line", "int"), ("rule", "string"), ("kind", "string"), ("snippet", "string")))).limit(0)
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("line", "snippet"))
    found = F.array_compact(F.array(*(F.when(F.rlike("snippet", F.lit(p)), F.struct(F.lit(k).alias("rule"), F.lit(kind).alias("kind"))) for k, (kind, p) in rules.items())))
    hits = lines.select("id", (F.col("line") + 1).alias("line"), "snippet", F.explode(found).alias("hit"))
    return hits.select("id", "line", "hit.rule", "hit.kind", F.trim("snippet").alias("snippet"))


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("rule", "kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule")


SCAN_SQL = """SELECT doc_id AS id, CAST(line AS INTEGER) AS line, rule, trim(snippet) AS snippet FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS snippet, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
  (VALUES """ + ", ".join(f"('{k}', '{p}')" for k, (_, p) in TEXT_RULES.items()) + ") r(rule, pattern) WHERE regexp_matches(snippet, pattern)"
