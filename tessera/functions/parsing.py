"""Parsing of records, replies, sources and graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters with marks and their plain forms, role labels.
MARKED, PLAIN = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "acelnoszzACELNOSZZ"
ROLES = ["żona", "mąż", "wdowiec", "wdowa", "dzieci", "syn", "córka", "ojciec", "matka", "córki", "synowie"]
ALIAS, MAIDEN = r"\w[\w-]*\s+\([^)]+\)", r"z\s+d\.\s+\w[\w-]*"


def reply_lines(output: Column) -> Column:
    """The lines of a reply without bullets and numbers."""
    clean = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(x, r"^[\s\-*•]+", ""), r"^\d+[.)]\s*", ""))
    return F.filter(F.transform(F.split(output, r"\R"), clean), lambda x: x != "")


def extraction_checks(rows: DataFrame) -> DataFrame:
    """Adds one boolean per check of a reply (output) against the names expected of it,
    passed and failures.  (?U) makes the word classes cover all letters."""
    lines, expected = F.col("_lines"), F.col("expected")
    text = F.array_join(lines, "\n")
    marks = f"[{MARKED}]"
    plain = lambda x: F.translate(x, MARKED, PLAIN)
    kept = lambda pattern: F.forall(F.flatten(F.transform(expected, lambda n: F.regexp_extract_all(n, F.lit(f"(?U){pattern}"), F.lit(0)))), lambda p: F.contains(text, p))
    checks = {
        "line_count": F.size(lines) == F.size(expected),
        "all_present": F.size(F.array_except(expected, lines)) == 0,
        "marks_kept": F.forall(expected, lambda n: ~n.rlike(marks) | F.exists(lines, lambda x: F.contains(x, n))),
        "no_plain_form": ~F.exists(expected, lambda n: n.rlike(marks) & F.exists(lines, lambda x: F.contains(x, plain(n)))),
        "alias_intact": kept(ALIAS),
        "maiden_intact": kept(MAIDEN),
        "no_labels": ~text.rlike(rf"(?iU)\b({'|'.join(ROLES)})\b"),
    }
    out = rows.withColumn("_lines", reply_lines(F.col("output"))).withColumns(checks)
    failures = F.array_compact(F.array(*(F.when(~F.col(k), F.lit(k)) for k in checks)))
    return out.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0).drop("_lines")


def vital_records(rows: DataFrame) -> DataFrame:
    """id, kind, first, last, place, birth, death, spouse, children of person lines and death
    lines (id, line).  A death line is tried first, since its form also fits a person's; the
    spouse's name ends at the next label."""
    line = F.col("line")
    death = r"(?U)^(\d+)\s+(\d+)\s+(\d{4})\s+(\S+)\s+(\w+)\s+(\w+)\s+(\d+)\s+(\S+)\s*(.*)$"
    person = r"(?U)^(\w+)\s+(\w+)\s+(\w+)\s+(\d{4})$"
    is_death, is_person = line.rlike(death), line.rlike(person)
    d, p = lambda i: F.regexp_extract(line, death, i), lambda i: F.regexp_extract(line, person, i)
    either = lambda a, b: F.when(is_death, d(a)).when(is_person, p(b))
    info = F.when(is_death, d(9)).otherwise("")
    labels = r"(?:żona|mąż|synowie|syn|córki|córka|dzieci)"
    spouse = F.nullif(F.btrim(F.regexp_extract(info, rf"(?U)(?:żona|mąż)\s+(.+?)(?=,?\s+{labels}\b|,|$)", 1)), F.lit(""))
    lists = F.regexp_extract_all(info, F.lit(rf"(?U)(?:synowie|syn|córki|córka|dzieci):?\s+(.+?)(?=,?\s+{labels}\b|$)"), F.lit(1))
    names = F.filter(F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda x: F.btrim(x)), lambda x: x != "")
    kind = F.when(is_death, "death").when(is_person, "person")
    return rows.select("id", kind.alias("kind"), either(5, 1).alias("first"), either(6, 2).alias("last"), either(8, 3).alias("place"), F.when(~is_death & is_person, p(4).cast("int")).alias("birth"), F.when(is_death, d(3).cast("int")).alias("death"), spouse.alias("spouse"), names.alias("children")).filter("kind is not null")


def family_edges(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People (last, first) and edges (src, relation, dst), with every relation both ways."""
    key = lambda last, first: F.concat(last, F.lit(" "), first)
    me = key(F.col("last"), F.col("first"))
    named = lambda full: key(F.element_at(F.split(full, " "), -1), F.element_at(F.split(full, " "), 1))
    spouse = records.filter("spouse is not null").select(me.alias("src"), F.lit("spouse").alias("relation"), named(F.col("spouse")).alias("dst"))
    child = records.select(me.alias("src"), F.explode("children").alias("c")).select("src", F.lit("child").alias("relation"), named(F.col("c")).alias("dst"))
    back = spouse.select(F.col("dst").alias("src"), "relation", F.col("src").alias("dst")).union(child.select(F.col("dst").alias("src"), F.lit("parent").alias("relation"), F.col("src").alias("dst")))
    edges = spouse.union(child).union(back).distinct()
    return records.select(me.alias("name")).union(edges.select("src")).distinct(), edges


def _renamed(tree):
    """tree with its variables and arguments named by their order of appearance."""
    import ast

    names: dict[str, str] = {}
    left = [tree]
    while left:
        node = left.pop()
        if isinstance(node, ast.Name):
            node.id = names.setdefault(node.id, f"var_{len(names) + 1}")
        elif isinstance(node, ast.arg):
            node.arg = names.setdefault(node.arg, f"var_{len(names) + 1}")
            continue
        left += reversed(list(ast.iter_child_nodes(node)))
    return tree


def _functions(path: str, code: str) -> list[tuple]:
    """Each function's own source gives its text and tree, so a nested one is whole in both."""
    import ast
    import textwrap

    try:
        tree, lines = ast.parse(code), code.split("\n")
        spans = [(n.name, n.lineno, n.end_lineno) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for name, begin, end in spans:
        raw = textwrap.dedent("\n".join(lines[begin - 1 : end]))
        try:
            whole = _renamed(ast.parse(raw))
            text, dump = ast.unparse(whole), ast.dump(whole.body[0], annotate_fields=False)
        except (SyntaxError, ValueError, RecursionError):
            text, dump = raw.strip(), ""
        out.append((path, name, begin, text, dump, raw))
    return out


def _graph(path: str, code: str) -> list[tuple]:
    """(src, relation, dst) edges of a source: definitions, used literals, imports."""
    import ast

    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return []
    edges = []
    trivial = (0, 1, -1, "", True, False, None)
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            edges.append((path, "defines", f"{path}::{node.name}"))
        elif isinstance(node, ast.Import):
            edges += [(path, "imports", a.name) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            edges.append((path, "imports", node.module or "."))
        elif isinstance(node, ast.Constant) and not any(node.value is t or (type(node.value) is type(t) and node.value == t) for t in trivial) and len(str(node.value)) <= 50:
            edges.append((path, "uses", repr(node.value)))
    return edges


def _each(rows: DataFrame, function, schema: str) -> DataFrame:
    import pyarrow as pa

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [r for p, c in zip(batch.column("path").to_pylist(), batch.column("code").to_pylist(), strict=True) for r in function(p, c or "")]
            columns = list(zip(*made, strict=True)) if made else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "int" else pa.string()) for c, k in zip(columns, kinds, strict=True)], names)

    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return rows.select("path", "code").mapInArrow(scan, schema)


def code_functions(sources: DataFrame) -> DataFrame:
    """path, name, start_line, text and ast (without comments, variables named by their order),
    raw of each function.  A source that does not parse has none."""
    return _each(sources, _functions, "path string, name string, start_line int, text string, ast string, raw string")


def code_graph(sources: DataFrame) -> DataFrame:
    return _each(sources, _graph, "src string, relation string, dst string").distinct()


def graph_texts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per graph its text in several formats.  nodes: graph, id, label, pos; edges: graph,
    start, end, pos."""
    cat = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    both = nodes.select("graph", F.struct("pos", "id", "label").alias("node"), F.lit(None).cast(edges.select(F.struct("pos", "start", "end")).dtypes[0][1]).alias("edge"))
    both = both.unionByName(edges.filter("graph is not null").select("graph", F.lit(None).cast(both.schema["node"].dataType).alias("node"), F.struct("pos", "start", "end").alias("edge")))
    held = both.groupBy("graph").agg(F.collect_list("node").alias("nodes"), F.collect_list("edge").alias("edges")).filter("size(nodes) > 0")

    def lines(items: str, made: Callable[[Column], Column]) -> Column:
        """Of each format the lines are made and sorted where the graph is: one list of each is gathered."""
        return F.array_join(F.transform(F.sort_array(F.transform(items, lambda x: F.struct(x["pos"].alias("pos"), made(x).alias("t")))), lambda x: x["t"]), "\n")

    plain = lambda x: F.regexp_replace(x["label"], r"[\n\"]", " ")
    xml = lambda x: F.replace(F.replace(x["label"], F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    of_nodes = {
        "n_m": lambda x: cat("    ", x["id"], '["', plain(x), '"]'), "n_p": lambda x: cat('rectangle "', plain(x), '" as ', x["id"]), "n_x": lambda x: cat('    <uml:Class id="', x["id"], '" name="', xml(x), '"/>'),
        "n_t": lambda x: cat("class ", x["id"], ": ", plain(x)), "n_j": lambda x: F.to_json(F.struct(x["id"].alias("$id"), x["label"].alias("title"))), "n_y": lambda x: cat("  - id: ", x["id"], "\n    label: ", plain(x))}
    of_edges = {
        "e_m": lambda x: cat("    ", x["start"], " --> ", x["end"]), "e_p": lambda x: cat(x["start"], " --> ", x["end"]), "e_x": lambda x: cat('    <uml:Association from="', x["start"], '" to="', x["end"], '"/>'),
        "e_t": lambda x: cat(x["start"], " -> ", x["end"]), "e_j": lambda x: F.to_json(F.struct(x["start"].alias("from"), x["end"].alias("to"))), "e_y": lambda x: cat("  - from: ", x["start"], "\n    to: ", x["end"])}
    g = held.select("graph", *(lines("nodes", f).alias(k) for k, f in of_nodes.items()), *(lines("edges", f).alias(k) for k, f in of_edges.items()))
    c = lambda name: F.coalesce(name, F.lit(""))
    return g.select(
        "graph", cat("graph TD\n", c("n_m"), "\n", c("e_m")).alias("mermaid"), cat("@startuml\n", c("n_p"), "\n", c("e_p"), "\n@enduml").alias("plantuml"),
        cat("<XMI>\n", c("n_x"), "\n", c("e_x"), "\n</XMI>").alias("xmi"), cat(c("n_t"), "\n", c("e_t")).alias("types"),
        cat('{"nodes": [', F.replace(c("n_j"), F.lit("\n"), F.lit(",")), '], "edges": [', F.replace(c("e_j"), F.lit("\n"), F.lit(",")), "]}").alias("json_schema"), cat("nodes:\n", c("n_y"), "\nedges:\n", c("e_y")).alias("yaml"))
