"""Rankings as documents and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT_SCHEMA = "query string, results array<struct<score: double, RegID: string>>"


def _score(d: Column) -> Column:
    return F.format_string("%.6f", d)


def result_lines(hits: DataFrame) -> DataFrame:
    """(query_id, line_no, line): a header ``query found n``, then ``score TAB id`` ascending.

    One row per line, so a ranking of any length can be written.
    """
    head = hits.groupBy("query_id").agg(F.count("*").alias("n")).select(
        "query_id", F.lit(0).cast("bigint").alias("line_no"),
        F.concat(F.col("query_id").cast("string"), F.lit(" found "), F.col("n").cast("string")).alias("line"),
    )
    body = hits.select("query_id", F.col("rank").alias("line_no"), F.concat_ws("\t", _score(F.col("dist")), F.col("item_id").cast("string")).alias("line"))
    return head.unionByName(body)


#: Entries of one document: a longer ranking goes on in numbered parts.
PART_ENTRIES = 10_000


def _listed(hits: DataFrame, top_n: int | None, entry: Column, *keys: str) -> DataFrame:
    """Entries of each query in rank order, in parts of bounded length (``part`` from 0)."""
    few = hits if top_n is None else hits.filter(F.col("rank") <= top_n)
    part = F.expr(f"(rank - 1) div {PART_ENTRIES}").alias("part")
    return few.select(*keys, part, F.struct("rank", entry.alias("e")).alias("_e")).groupBy(*keys, "part").agg(
        F.transform(F.array_sort(F.collect_list("_e")), lambda e: e["e"]).alias("es"))


def _documents(docs: DataFrame, top_n: int | None, *cols: str) -> DataFrame:
    """A ranking that a limit keeps in one part has no part number."""
    return docs.select(*cols) if top_n is not None and top_n <= PART_ENTRIES else docs.select(*cols, "part")


def results_text(hits: DataFrame, top_n: int | None = None) -> DataFrame:
    """One text document per query and part: whole rankings, or their ``top_n``. The head counts all of the query's lines."""
    line = F.concat_ws("\t", _score(F.col("dist")), F.col("item_id").cast("string"))
    few = hits if top_n is None else hits.filter(F.col("rank") <= top_n)
    counts = few.groupBy("query_id").agg(F.count("*").alias("n"))
    head = F.concat(F.col("query_id").cast("string"), F.lit(" found "), F.col("n").cast("string"), F.lit("\n"))
    docs = _listed(hits, top_n, line, "query_id").join(counts, "query_id").withColumn("doc", F.concat(head, F.array_join("es", "\n")))
    return _documents(docs, top_n, "query_id", "doc")


def results_nested(hits: DataFrame, top_n: int | None = None) -> DataFrame:
    """One JSON document per query and part: query -> results [{score, RegID}]."""
    entry = F.struct(F.col("dist").alias("score"), F.col("item_id").cast("string").alias("RegID"))
    doc = F.struct(F.col("query_id").cast("string").alias("query"), F.col("es").alias("results"))
    return _documents(_listed(hits, top_n, entry, "query_id").withColumn("doc", F.to_json(doc)), top_n, "query_id", "doc")


def parse_results_text(docs: DataFrame, key: str, text: str = "doc") -> DataFrame:
    """(query, score, item) of text documents; a header covers the lines below it.

    ``key`` tells the documents apart; each is one row, so its lines are few.
    """
    lines = docs.select(F.col(key).alias("_d"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    head = F.regexp_extract("line", r"^(.*) found \d+$", 1)
    w = Window.partitionBy("_d").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("query", F.last(F.nullif(head, F.lit("")), ignorenulls=True).over(w))
    return marked.filter(F.col("line").contains("\t")).select(
        "query",
        F.substring_index("line", "\t", 1).try_cast("double").alias("score"),
        F.regexp_replace("line", "^[^\t]*\t", "").alias("item"),
    )


def parse_results_nested(docs: DataFrame, text: str = "doc") -> DataFrame:
    d = F.from_json(text, RESULT_SCHEMA)
    return docs.select(d.alias("d")).select("d.query", F.explode("d.results").alias("r")).select(
        "query", F.col("r.score").alias("score"), F.col("r.RegID").alias("item")
    )


def parse_service_lines(lines: DataFrame, text: str = "line") -> DataFrame:
    """Service result lines ``score TAB path TAB f{[x,y;w,h] TAB d[id]}``: (score, id, id_region)."""
    tag = F.regexp_extract(text, r"d\[([^\]]*)\]", 1)
    region = F.regexp_replace(F.regexp_extract(text, r"\t([a-z]\{\[[^\]]*\])", 1), r"\{", "")
    score = F.substring_index(text, "\t", 1).try_cast("double")
    return lines.select(score.alias("score"), tag.alias("id"), F.concat_ws("\t", tag, region).alias("id_region")).filter(
        "score IS NOT NULL AND score <= 1"
    )


def results_by_collection(hits: DataFrame, top_n: int | None = None) -> DataFrame:
    """One JSON document per query and part over its collections: [{eventid, result, matches}].

    A document holds the same part of every collection's ranking.
    """
    line = F.concat_ws("\t", _score(F.col("dist")), F.col("item_id").cast("string"))
    each = _listed(hits, top_n, line, "query_id", "event_id")
    entry = F.struct(F.col("event_id").alias("eventid"), F.array_join("es", "\n").alias("result"), F.size("es").alias("matches"))
    docs = each.groupBy("query_id", "part").agg(F.to_json(F.array_sort(F.collect_list(entry)), {"pretty": "true"}).alias("doc"))
    return _documents(docs, top_n, "query_id", "doc")
