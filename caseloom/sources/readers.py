"""Readers of raw deliveries. Each gives a lazy frame with ``file`` and a place in the file beside the content; what
stops a build (a broken file, repeated keys) is a query of its own, what spoils a row is a reason."""

from __future__ import annotations

import io
import json
import pickle
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as X
from ..operators.sequences import physical_lines

Paths = str | Sequence[str]


def _list(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """``(file, line, value)`` of non-blank lines with their physical numbers from 1; plain or ``.gz``; no BOM."""
    return physical_lines(spark.read.text(_list(paths))).where(X.non_blank(F.col("value")))


def known_json() -> Column:
    """Whether ``value`` is JSON. Repeated keys aren't broken in a lenient reader: only VARIANT refuses them."""
    return F.try_parse_json(F.col("value")).isNotNull() | F.json_object_keys("value").isNotNull()


def read_jsonl(spark: SparkSession, paths: Paths, schema: str) -> DataFrame:
    """Lines parsed as ``row`` of a schema. ``broken`` marks a line that is no JSON, which stops a build."""
    lines = read_lines(spark, paths)
    return lines.select("file", "line", "value", F.from_json("value", schema).alias("row"), (~known_json()).alias("broken"))


def sound(fine: Column, *place: Column) -> Column:
    """A condition for ``where`` that holds for every row or stops the build, naming the place.

    The number, never below 0, makes it nondeterministic: else the optimizer drops broken rows by later conditions, such
    as those of an explode, before they are seen here."""
    return F.when(fine | (F.monotonically_increasing_id() < 0), True).otherwise(F.raise_error(F.concat_ws(" ", *place, F.lit("can't be parsed"))).cast("boolean"))


def sound_jsonl(spark: SparkSession, paths: Paths, schema: str) -> DataFrame:
    """:func:`read_jsonl` where a broken line stops the build."""
    return read_jsonl(spark, paths, schema).where(sound(~F.col("broken"), F.col("file"), F.lit("line"), F.col("line"))).drop("broken")


def _whole(spark: SparkSession, paths: Paths) -> DataFrame:
    """``(file, value)`` of whole files, without a BOM."""
    return spark.read.text(_list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("value"))


def read_json_array(spark: SparkSession, paths: Paths, schema: str | None = None) -> DataFrame:
    """``(file, line, value[, row])`` of the entries of whole-file arrays, numbered from 1; ``value`` is raw JSON. A
    file that is no array stops the build."""
    whole = _whole(spark, paths).where(sound(F.json_array_length("value").isNotNull(), F.col("file")))
    entries = whole.select("file", F.posexplode(F.from_json("value", "array<string>")).alias("at", "value"))
    rows = entries.select("file", (F.col("at") + 1).cast("long").alias("line"), "value")
    return rows if schema is None else rows.withColumn("row", F.from_json("value", schema))


def read_json_records(spark: SparkSession, paths: Paths, schema: str) -> DataFrame:
    """Arrays or lines of objects, by the first character of each file; rows with a repeated field get a reason."""
    arrays, lines = [], []
    for path in _list(paths):
        first = spark.read.text(path).where(X.non_blank(F.col("value"))).limit(1).collect()
        head = first[0].value.strip()[:1] if first else ""
        if head == "[":
            arrays.append(path)
        elif head in ("{", ""):
            lines.append(path)
        else:
            raise ValueError(f"{path} holds neither an array nor lines of objects")
    parts = [read_json_array(spark, arrays)] if arrays else []
    parts += [read_lines(spark, lines).select("file", "line", "value")] if lines else []
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.withColumns({"row": F.from_json("value", schema), "reason": F.when(X.has_repeated_fields(F.col("value")), "repeated field")})


def read_json_dictionary(spark: SparkSession, paths: Paths, schema: str) -> DataFrame:
    """``(file, line, key, value, row)`` of the entries of whole-file objects, in their order. A file that is no object stops
    the build."""
    whole = _whole(spark, paths).where(sound(F.json_object_keys("value").isNotNull(), F.col("file")))
    entries = whole.select("file", F.posexplode(F.from_json("value", "map<string,string>")).alias("at", "key", "value"))
    return entries.select("file", (F.col("at") + 1).cast("long").alias("line"), "key", "value", F.from_json("value", schema).alias("row"))


def read_nested_questions(spark: SparkSession, paths: Paths) -> DataFrame:
    """Questions of ``data[].paragraphs[].qas[]`` documents in their order: ``(file, line, title, context, id, question,
    answers, impossible)``; ``line`` numbers the questions of a file from 1."""
    schema = "data array<struct<title string, paragraphs array<struct<context string, qas array<struct<id string, question string, answers array<struct<text string, answer_start int>>, is_impossible boolean>>>>>>"
    whole = _whole(spark, paths).where(sound(F.json_object_keys("value").isNotNull(), F.col("file"))).select("file", F.from_json("value", schema).alias("d"))
    asked = """flatten(transform(d.data, a -> coalesce(flatten(transform(a.paragraphs, p -> coalesce(transform(p.qas, q -> named_struct(
        'title', a.title, 'context', p.context, 'id', q.id, 'question', q.question, 'answers', q.answers, 'impossible', q.is_impossible)), array()))), array())))"""
    return whole.select("file", F.posexplode(F.expr(asked)).alias("at", "q")).select("file", (F.col("at") + 1).cast("long").alias("line"), "q.*")


def read_csv(spark: SparkSession, paths: Paths, columns: str | None = None, charset: str = "utf-8") -> DataFrame:
    """Comma-separated rows with a header, quoted line breaks, doubled quotes. Other charsets are decoded in Python."""
    if charset.lower().replace("_", "-") not in ("utf-8", "utf8"):
        return _decoded_csv(spark, paths, charset)
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return (reader.schema(columns) if columns else reader).csv(_list(paths))


def _decoded_csv(spark: SparkSession, paths: Paths, charset: str, numbered: bool = False) -> DataFrame:
    """Rows of CSV files in any charset that Python knows, such as gb18030; the header names the columns. ``numbered``
    gives ``(file, line, row)``. A file that can't be decoded stops the build."""
    import csv

    files = spark.read.format("binaryFile").load(_list(paths)).select("path", "content")
    head = files.orderBy("path").limit(1).collect()
    names = next(csv.reader(io.StringIO(head[0].content.decode(charset).lstrip("\ufeff")))) if head else []
    schema = ", ".join(f"`{n}` string" for n in names)

    def parse(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                reader = csv.DictReader(io.StringIO(bytes(content).decode(charset).lstrip("\ufeff"), newline=""))
                rows = [{n: r.get(n) for n in names} for r in reader]
                for at in range(0, len(rows), 10_000):
                    part = pd.DataFrame(rows[at : at + 10_000], columns=names, dtype=object)
                    yield part.assign(_file=path, _line=range(at + 1, at + len(part) + 1))

    found = files.mapInPandas(parse, f"{schema}, _file string, _line long" if names else "_file string, _line long")
    if not numbered:
        return found.drop("_file", "_line")
    return found.select(F.col("_file").alias("file"), F.col("_line").alias("line"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))


def numbered_csv(spark: SparkSession, paths: Paths, charset: str = "utf-8") -> DataFrame:
    """``(file, line, row)`` of :func:`read_csv`; ``line`` numbers the records of a file from 1. A file with quoted line
    breaks is read by one task, so its records are numbered in one."""
    if charset.lower().replace("_", "-") not in ("utf-8", "utf8"):
        return _decoded_csv(spark, paths, charset, numbered=True)
    rows = read_csv(spark, paths)
    marked = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_at"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    return marked.select("file", F.row_number().over(Window.partitionBy("file").orderBy("_at")).cast("long").alias("line"), "row")


def numbered_tsv(spark: SparkSession, paths: Paths, columns: str) -> DataFrame:
    """``(file, line, row, reason)`` of lines cut at their tabs, quotes being data; a line with more or fewer fields gets a
    reason. An empty field is null."""
    names = [f.name for f in StructType.fromDDL(columns).fields]
    parts = F.split("value", "\t", -1)
    lines = read_lines(spark, paths).withColumn("_parts", parts)
    row = F.struct(*[F.nullif(F.get("_parts", F.lit(k)), F.lit("")).cast(f.dataType).alias(f.name) for k, f in enumerate(StructType.fromDDL(columns).fields)])
    return lines.select("file", "line", row.alias("row"), F.when(F.size("_parts") != len(names), f"not {len(names)} fields").alias("reason"))


def read_tsv(spark: SparkSession, paths: Paths, columns: str) -> DataFrame:
    """Tab-separated rows in which quotes are data."""
    return spark.read.schema(columns).option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE").csv(_list(paths))


def read_two_columns(spark: SparkSession, paths: Paths, first: str, second: str, header: bool = False) -> DataFrame:
    """Lines cut at their first tab; ``header`` drops the first line of each file."""
    lines = read_lines(spark, paths)
    parts = F.split("value", "\t", 2)
    rows = lines.select("file", "line", F.get(parts, F.lit(0)).alias(first), F.get(parts, F.lit(1)).alias(second))
    return rows.where("line > 1") if header else rows


def read_judgements(spark: SparkSession, paths: Paths, highest: int = 3) -> DataFrame:
    """Lines of four words, ``qid iteration pid grade``; ``reason`` where a line is otherwise or a grade out of range."""
    words = F.split(X.collapse_space(F.col("value")), " ")
    grade = F.get(words, F.lit(3)).try_cast("int")
    rows = read_lines(spark, paths).select("file", "line", words.alias("w"), grade.alias("grade"))
    reason = F.when(F.size("w") != 4, "not four fields").when(F.col("grade").isNull() | ~F.col("grade").between(0, highest), "grade out of range")
    return rows.select("file", "line", F.get("w", F.lit(0)).alias("qid"), F.get("w", F.lit(2)).alias("pid"), "grade", reason.alias("reason"))


class _Primitive(pickle.Unpickler):
    """Unpickles containers, texts and numbers; any global is refused."""

    def find_class(self, module, name):
        raise pickle.UnpicklingError(f"global {module}.{name} is not allowed")


def read_pickled_lists(spark: SparkSession, paths: Paths) -> DataFrame:
    """``(file, line, value)`` of pickled lists or dictionaries of plain values, each entry as JSON."""
    def parse(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                found = _Primitive(io.BytesIO(bytes(content))).load()
                entries = list(found.values()) if isinstance(found, dict) else list(found)
                yield pd.DataFrame({"file": path, "line": range(1, len(entries) + 1), "value": [json.dumps(e, ensure_ascii=False) for e in entries]})

    return spark.read.format("binaryFile").load(_list(paths)).select("path", "content").mapInPandas(parse, "file string, line long, value string")


def read_words(spark: SparkSession, path: str) -> list[str]:
    """A vocabulary of one word a line, in order; blank lines at the end don't count, a repeated word stops a build."""
    words = [r.value for r in physical_lines(spark.read.text(path)).orderBy("line").collect()]  # a closed vocabulary
    while words and not words[-1].strip():
        words.pop()
    if len(set(words)) != len(words) or any(not w.strip() for w in words):
        raise ValueError(f"{path} repeats a word or has a blank line")
    return words


def read_vocabulary(spark: SparkSession, path: str) -> list[str]:
    """The words of a closed vocabulary in their order: a line file (:func:`read_words`), a JSON list, a JSON dictionary
    of words with descriptions, or one of words with numbers, which must run from 0 without a gap. Repeated or blank
    words, and repeated descriptions, stop a build."""
    whole = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()).lstrip("\ufeff")  # a closed vocabulary
    if whole.lstrip()[:1] not in ("[", "{"):
        return read_words(spark, path)
    pairs: list[tuple] = []
    found = json.loads(whole, object_pairs_hook=lambda x: pairs.extend(x) or dict(x))
    words = list(found) if isinstance(found, list) else [k for k, _ in pairs]
    told = [] if isinstance(found, list) else [v for _, v in pairs]
    if told and all(isinstance(v, int) for v in told):
        if sorted(told) != list(range(len(told))):
            raise ValueError(f"{path}: the words' numbers don't run from 0")
        words = [k for k, _ in sorted(pairs, key=lambda x: x[1])]
    if any(not isinstance(w, str) or not w.strip() for w in words) or len(set(words)) != len(words) or len(set(map(str, told))) != len(told):
        raise ValueError(f"{path} repeats a word or has a blank one")
    return words


def template_capture(text: Column, templates: Sequence[str], slot: str = "[INPUT_TEXT]") -> Column:
    """What a prompt made from one of the templates held at the slot; null unless exactly one text fits. Where a template
    lists labels, any list will do."""
    found = []
    for template in templates:
        before, _, after = (part.replace("[LIST_LABELS]", r"\E.+?\Q") for part in template.partition(slot))
        pattern = rf"(?s)^\Q{before}\E(.*)\Q{after}\E$"
        found.append(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)))
    distinct = F.array_distinct(F.array_compact(F.array(*found)))
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0)))


def read_release(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Lines of one split of a release; both a plain and a packed file, or none, stop the read."""
    jvm = spark.sparkContext._jvm
    names = [f"{folder}/{split}.cases.jsonl", f"{folder}/{split}.cases.jsonl.gz"]
    there = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(name)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            there.append(name)
    if len(there) != 1:
        raise ValueError(f"{split}: {len(there)} case files")
    return read_lines(spark, there)


def read_split(spark: SparkSession, root: str, split: str, template: str = "{split}.cases.jsonl.gz", limit: int | None = None) -> DataFrame:
    """Non-blank lines of the file that a template names for a split, packed or not by its suffix; with ``limit`` the
    first so many of them. A split without a file stops the read."""
    path = f"{root}/{template.format(split=split)}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(f"split {split}: {path}")
    lines = read_lines(spark, path)
    return lines if limit is None else lines.orderBy("line").limit(limit)


def file_inventory(spark: SparkSession, paths: Paths) -> DataFrame:
    """``(path, bytes, sha256)`` of every file."""
    files = spark.read.format("binaryFile").load(_list(paths))
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
