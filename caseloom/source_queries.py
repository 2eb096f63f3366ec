"""Queries of readers and adapters: records made of whole tables, written as files where a reader is meant, with the
lines that a delivery may spoil among them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import _SOLID
from .plans.shared import Scratch
from .queries import _table
from .sources import adapters as A
from .sources import joined, readers

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def _lines(spark: SparkSession, rows: DataFrame) -> str:
    """The folder of rows written as lines of text."""
    folder = f"{Scratch(spark, 'lines').root}/lines"
    rows.select("value").write.text(folder)
    return folder


@query
def jsonl_lines(spark, sf_dir):
    """A seventh of the lines is cut off."""
    whole = F.to_json(F.struct("raw_no", F.col("state.question").alias("question")))
    folder = _lines(spark, _table(spark, sf_dir, "raw").select(F.when(F.col("raw_no") % 7 == 0, F.substring(whole, 1, 9)).otherwise(whole).alias("value")))
    return readers.read_jsonl(spark, folder, "raw_no long, question string").select("row.raw_no", "row.question", "broken")


@query
def tsv_lines(spark, sf_dir):
    """A fifth of the lines lacks a field; quotes are data."""
    raw = _table(spark, sf_dir, "raw")
    told = F.concat_ws("\t", F.col("raw_no").cast("string"), F.concat(F.lit('"'), F.coalesce("type", F.lit(""))))
    folder = _lines(spark, raw.select(F.when(F.col("raw_no") % 5 == 0, told).otherwise(F.concat_ws("\t", told, F.col("delivery").cast("string"))).alias("value")))
    return readers.numbered_tsv(spark, folder, "raw_no long, kind string, delivery int").select("row.*", "reason")


@query
def csv_records(spark, sf_dir):
    """Texts with line breaks, quotes and commas, numbered by record; an empty field is null."""
    folder = f"{Scratch(spark, 'csv').root}/csv"
    rows = _table(spark, sf_dir, "raw").select("raw_no", F.regexp_replace("state.text", "\r", " ").alias("text"))
    options = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(**options).csv(folder)
    found = readers.numbered_csv(spark, folder)
    # Numbers run from 1 in every file, without gaps.
    each = found.groupBy("file").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.count(F.lit(1)).alias("n")).select("file", (F.expr("low = 1 and high = n")).alias("numbered"))
    return found.join(each, "file").select(F.col("row.raw_no").cast("long").alias("raw_no"), F.md5("row.text").alias("text"), "numbered")


@query
def judgement_lines(spark, sf_dir):
    """Lines of other than four words and grades out of range are told of."""
    lines = _table(spark, sf_dir, "lineitem")
    word = lambda c: F.col(c).cast("string")
    whole = F.concat_ws(" ", word("l_orderkey"), F.lit("0"), word("l_partkey"), F.floor(F.col("l_quantity") / 10).cast("string"))
    folder = _lines(spark, lines.select(F.when(F.col("l_linenumber") == 7, F.concat_ws(" ", word("l_orderkey"), word("l_partkey"))).otherwise(whole).alias("value")))
    return readers.read_judgements(spark, folder).select("qid", "grade", "reason").groupBy("qid", "grade", "reason").agg(F.count(F.lit(1)).alias("n"))


def _shaped(rows: DataFrame, line: str, name: str, params=None, **fields) -> DataFrame:
    """``(line, at, reason, label)`` of records made of a table's rows; ``at`` is the place inside the record."""
    records = rows.select(F.lit("table").alias("file"), F.col(line).cast("long").alias("line"), F.struct(*[c.alias(k) for k, c in fields.items()]).alias("row"))
    return _told(A.decision_rows(records, A.SHAPES[name], params))


def _told(rows: DataFrame) -> DataFrame:
    gold = F.from_json(F.get_json_object("gold", "$.decision.probabilities"), "map<string,double>")
    label = F.get(F.map_keys(F.map_filter(gold, lambda k, p: p == 1)), F.lit(0))
    return rows.select("place.line", F.array_join(F.col("place.at").cast("array<string>"), ":").alias("at"), "qtype", "reason", F.when(F.col("reason").isNull(), label).alias("label"))


@query
def adapter_pairs(spark, sf_dir):
    """Binary: whether two texts mean the same."""
    raw = _table(spark, sf_dir, "raw")
    label = F.when(F.col("type") == "noul", "1").when(F.col("type") == "score", "0").otherwise("x")
    return _shaped(raw, "raw_no", "cblue_sts", id=F.col("id"), text1=F.col("state.text"), text2=F.col("state.question"), label=label)


@query
def adapter_levels(spark, sf_dir):
    """Ordinal: a level from 0 to 3."""
    raw = _table(spark, sf_dir, "raw")
    return _shaped(raw, "raw_no", "cblue_qtr", id=F.col("id"), query=F.col("state.text"), title=F.col("instruction"), label=(F.col("delivery") - 2).cast("string"))


@query
def adapter_classes(spark, sf_dir):
    """A choice among a vocabulary."""
    raw = _table(spark, sf_dir, "raw")
    return _shaped(raw, "raw_no", "cblue_qic", {"labels": ["choice", "score"]}, id=F.col("id"), query=F.col("state.question"), label=F.col("type"))


@query
def adapter_exams(spark, sf_dir):
    """An exam question: a choice, or a decision for each option where several are right."""
    part = _table(spark, sf_dir, "part")
    options = F.create_map(F.lit("A"), F.col("p_brand"), F.lit("B"), F.col("p_type"), F.lit("C"), F.concat(F.lit("size "), F.col("p_size").cast("string")))
    answer = F.element_at(F.array(*map(F.lit, ("A", "B", "AC", "D", "CB", "x"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return _shaped(part, "p_partkey", "mlec_qa", qid=F.lit("1"), qtype=F.lit("A1"), qtext=F.col("p_name"), options=options, answer=answer)


@query
def adapter_fan_out(spark, sf_dir):
    """A decision for each label of a vocabulary."""
    documents = _table(spark, sf_dir, "documents")
    meta = F.struct(F.array_compact(F.array("kind", F.when(F.col("doc_id") % 9 == 0, "other"))).alias("accusation"), F.array().cast("array<string>").alias("relevant_articles"))
    return _shaped(documents, "doc_id", "cail2018", {"labels": ["note", "dialogue", "titled", "list"]}, fact=F.col("text"), meta=meta)


@query
def adapter_candidates(spark, sf_dir):
    """Five answers to a question, in an order that no label shows, read from tab-separated lines."""
    lines = _table(spark, sf_dir, "lineitem")
    field = lambda c: F.col(c).cast("string")
    right = (F.col("l_linenumber") == F.col("l_orderkey") % 6 + 1).cast("int").cast("string")
    text = F.concat_ws("\t", F.lit("d"), right, field("l_orderkey"), F.concat(F.lit("order "), field("l_orderkey")), F.concat_ws("/", field("l_partkey"), field("l_suppkey")))
    rows = joined.convert_webmedqa(spark, _lines(spark, lines.select(text.alias("value"))), {})
    fine = F.col("reason").isNull()
    told = rows.select(F.when(fine, F.regexp_extract("source_id", r":(\d+)$", 1)).cast("long").alias("order_no"), "reason", F.when(fine, F.regexp_extract("gold", r'"([A-E])":1\.0', 1)).alias("label"))
    return told.groupBy("order_no", "reason", "label").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _solid(c: str) -> str:
    return f"coalesce(regexp_matches({c}, '{_SOLID}'), false)"


SQL = {
    "jsonl_lines": "SELECT raw_no, state.question AS question, false AS broken FROM raw WHERE raw_no % 7 <> 0 UNION ALL SELECT NULL, NULL, true FROM raw WHERE raw_no % 7 = 0",
    "tsv_lines": """SELECT raw_no, '"' || coalesce(type, '') AS kind, CASE WHEN raw_no % 5 <> 0 THEN delivery END AS delivery, CASE WHEN raw_no % 5 = 0 THEN 'not 3 fields' END AS reason FROM raw""",
    "csv_records": "SELECT raw_no, md5(nullif(replace(state.text, chr(13), ' '), '')) AS text, true AS numbered FROM raw",
    "judgement_lines": """SELECT l_orderkey::VARCHAR AS qid, CASE WHEN l_linenumber <> 7 THEN floor(l_quantity / 10)::INT END AS grade, CASE WHEN l_linenumber = 7 THEN 'not four fields' WHEN l_quantity >= 40 THEN 'grade out of range' END AS reason, count(*) AS n FROM lineitem GROUP BY ALL""",
    "adapter_pairs": f"""SELECT raw_no AS line, '' AS at, 'noul' AS qtype, reason, CASE WHEN reason IS NULL THEN (type = 'noul')::VARCHAR END AS label FROM (SELECT *, CASE WHEN state.text IS NULL OR state.question IS NULL OR NOT ({_solid('state.text')} OR {_solid('state.question')}) THEN 'blank state'
  WHEN NOT {_solid('state.text')} THEN 'no group' WHEN type NOT IN ('noul', 'score') OR type IS NULL THEN 'no label' END AS reason FROM raw)""",
    "adapter_levels": f"""SELECT raw_no AS line, '' AS at, 'score' AS qtype, reason, CASE WHEN reason IS NULL THEN (delivery - 2)::VARCHAR END AS label FROM (SELECT *, CASE WHEN state.text IS NULL OR instruction IS NULL OR NOT ({_solid('state.text')} OR {_solid('instruction')}) THEN 'blank state'
  WHEN NOT {_solid('state.text')} THEN 'no group' WHEN delivery - 2 NOT BETWEEN 0 AND 3 OR delivery IS NULL THEN 'level out of range' END AS reason FROM raw)""",
    "adapter_classes": f"""SELECT raw_no AS line, '' AS at, 'choice' AS qtype, reason, CASE WHEN reason IS NULL THEN CASE type WHEN 'choice' THEN 'A' ELSE 'B' END END AS label FROM (SELECT *, CASE WHEN NOT {_solid('state.question')} THEN 'blank state' WHEN type NOT IN ('choice', 'score') OR type IS NULL THEN 'answer out of range' END AS reason FROM raw)""",
    "adapter_exams": """WITH e AS (SELECT p_partkey AS line, ['A', 'B', 'AC', 'D', 'CB', 'x'][p_partkey % 6 + 1] AS answer FROM part)
SELECT line, '' AS at, 'choice' AS qtype, CASE answer WHEN 'D' THEN 'answer out of range' WHEN 'x' THEN 'no answer letters' END AS reason, CASE WHEN answer IN ('A', 'B') THEN answer END AS label FROM e WHERE length(answer) = 1
UNION ALL SELECT line, (i - 1)::VARCHAR, 'noul', NULL, contains(answer, chr(64 + i::INT))::VARCHAR FROM e, range(1, 4) t(i) WHERE length(answer) = 2""",
    "adapter_fan_out": f"""SELECT doc_id AS line, (i - 1)::VARCHAR AS at, 'noul' AS qtype, CASE WHEN doc_id % 9 = 0 THEN 'label outside the vocabulary' WHEN NOT {_solid('text')} THEN 'blank state' END AS reason,
  CASE WHEN doc_id % 9 <> 0 AND {_solid('text')} THEN coalesce(kind = ['note', 'dialogue', 'titled', 'list'][i], false)::VARCHAR END AS label FROM documents, range(1, 5) t(i)""",
    "adapter_candidates": """WITH c AS (SELECT l_orderkey AS q, l_partkey || '/' || l_suppkey AS a, l_linenumber = l_orderkey % 6 + 1 AS good FROM lineitem),
g AS (SELECT q, count(*) AS n, count(*) FILTER (good) AS goods, count(DISTINCT a) AS answers FROM c GROUP BY q),
p AS (SELECT q, good, row_number() OVER (PARTITION BY q ORDER BY sha256('["order ' || q || '","' || a || '"]'), a, good) AS place FROM c),
r AS (SELECT g.q, CASE WHEN n <> 5 THEN 'not 5 candidates' WHEN goods <> 1 THEN 'not one right answer' WHEN answers < 5 THEN 'repeated candidates' END AS reason, (SELECT chr(64 + min(place)::INT) FROM p WHERE p.q = g.q AND good) AS letter FROM g)
SELECT CASE WHEN reason IS NULL THEN q END AS order_no, reason, CASE WHEN reason IS NULL THEN letter ELSE NULL END AS label, count(*) AS n FROM r GROUP BY ALL""",
}
