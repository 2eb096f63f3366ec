"""Queries of the engine's own operators, over whole tables. ``oracles.py`` has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import decisions as D
from .functions import text as X
from .operators import batches as B
from .operators import cases as C
from .operators import compiling as T
from .operators import components as G
from .operators import joins as J
from .operators import lengths as L
from .operators import merge as M
from .operators import scoring as S
from .operators import sequences as W
from .operators import validation as V
from .plans.shared import Scratch
from .sources import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with their provenance as columns."""
    cases = _table(spark, sf_dir, "cases")
    return cases.select("case_no", "id", "state", "questions", "gold", "_meta.*").withColumnRenamed("group_key", "grp")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.explode_decisions(_cases(spark, sf_dir))


def _merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the merge needs of cases: those with a group, official splits, arrival by number."""
    rows = _decisions(spark, sf_dir).where("grp is not null")
    return rows.select(
        F.col("case_no").alias("arrival"), "case_no", C.input_key(F.col("state"), F.col("questions")).alias("input_key"), X.digest(F.col("gold")).alias("gold_key"), "grp",
        F.coalesce("link_keys", F.array().cast("array<string>")).alias("link_keys"), F.col("source_split").alias("split"), "source", "original_id", "qtype", M.label_key(F.col("option_keys"), F.col("gold_probs")).alias("label_key"),
    )


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Scratch]:
    scratch = Scratch(spark, "merge")
    rows = _merge_rows(spark, sf_dir)
    return scratch.keep(M.merge_cases(rows, scratch, 7, 0.05, 0.1, 0.1), "merged"), rows, scratch


# Construction and validation.


@query
def raw_conversion(spark, sf_dir):
    rows = A.raw_record_rows(_table(spark, sf_dir, "raw"))
    return rows.select("raw_no", "source_id", "qtype", "gold", "group_key", "reason")


@query
def raw_rejections(spark, sf_dir):
    rows = A.raw_record_rows(_table(spark, sf_dir, "raw"))
    return rows.where("reason is not null").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))


@query
def decision_rows(spark, sf_dir):
    rows = _decisions(spark, sf_dir)
    return rows.select("case_no", "question_id", "qtype", "instructions", F.array_join("option_keys", "|").alias("option_keys"), D.first_largest(F.col("gold_probs")).alias("label"), M.label_key(F.col("option_keys"), F.col("gold_probs")).alias("label_key"))


@query
def case_reasons(spark, sf_dir):
    rows = _decisions(spark, sf_dir).select("qtype", F.coalesce(V.case_reason(), V.question_reason(), V.gold_reason(), F.lit("valid")).alias("verdict"))
    return rows.groupBy("qtype", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query
def case_digests(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    question = F.element_at(F.from_json("questions", "map<string,string>"), F.lit("decision"))
    return cases.select("case_no", C.case_digest(F.col("source_id"), F.col("state"), question).alias("case_digest"), C.input_key(F.col("state"), F.col("questions")).alias("input_key"))


@query
def provenance(spark, sf_dir):
    decorated = C.decorate(_cases(spark, sf_dir), _table(spark, sf_dir, "sources"))
    return decorated.select("case_no", "source_family", "task_family", "domain", "revision", "license", "reason")


@query
def option_texts(spark, sf_dir):
    rows = _decisions(spark, sf_dir)
    return rows.select("case_no", F.array_join(D.option_texts(F.col("qtype"), F.col("option_keys"), F.col("option_desc")), "\n").alias("options"))


@query
def targets(spark, sf_dir):
    rows = C.compiled_targets(_decisions(spark, sf_dir))
    return rows.select("case_no", "kind_no", F.array_join(F.transform("target", lambda x: F.round(x, 6).cast("string")), "|").alias("target"), "label")


@query
def source_names(spark, sf_dir):
    rows = _cases(spark, sf_dir)
    return rows.groupBy(X.source_family_of(F.col("source"), F.col("source_family"), F.col("source_split")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query
def group_keys_composed(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").where(X.non_blank(F.col("text")))
    return documents.select("doc_id", X.group_key("text", F.col("text")).alias("group_key"))


@query
def hash_fractions(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    u = X.hash_fraction(F.col("doc_id").cast("string"), 7)
    return documents.select("doc_id", u.alias("u"), M.component_split(F.lit(0), F.col("doc_id").cast("string"), 7, 0.05, 0.1, 0.1).alias("split"))


@query
def hash_sample(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return events.where(X.hash_fraction(F.col("user_id").cast("string"), 3) < 0.3).select("event_id", "user_id")


# The merge.


@query
def dedup_survivors(spark, sf_dir):
    rows = _merge_rows(spark, sf_dir).withColumn("priority", M.split_priority(F.col("split")))
    return M.input_groups(rows).select("input_key", F.col("arrival").alias("case_no"), "copies", "conflict")


@query
def contradictions(spark, sf_dir):
    """Raters who give one document different levels."""
    grades = _table(spark, sf_dir, "doc_grades").where("reading_level is not null")
    rows = grades.select("doc_id", "rater", F.col("doc_id").alias("input_key"), F.col("reading_level").alias("gold_key"), F.lit(0).alias("priority"), F.concat_ws(":", "doc_id", "rater").alias("arrival"))
    return M.contradicting_rows(rows, M.input_groups(rows)).select("doc_id", "rater", "differs")


@query
def connected_components(spark, sf_dir):
    rows = _merge_rows(spark, sf_dir)
    return G.connected_groups(M.group_anchors(rows), Scratch(spark, "components"))


@query
def record_components(spark, sf_dir):
    """Raw parents tied by records that were delivered under both, over all deliveries."""
    members = _table(spark, sf_dir, "raw").select("grp", F.col("id").alias("anchor"))
    return G.connected_groups(members, Scratch(spark, "records"))


@query
def component_names(spark, sf_dir):
    rows = _merge_rows(spark, sf_dir)
    scratch = Scratch(spark, "names")
    return G.component_names(scratch.keep(G.connected_groups(M.group_anchors(rows), scratch), "roots")).select("component", "groups")


@query
def leak_free_split(spark, sf_dir):
    merged, _, _ = _merged(spark, sf_dir)
    return merged.select("case_no", "component", "copies", "fate", "split")


@query
def unit_counts(spark, sf_dir):
    merged, rows, _ = _merged(spark, sf_dir)
    units = lambda df, stage: df.select("source", F.lit(stage).alias("stage"), "split", "original_id", "grp")
    return M.unit_counts(units(rows, "converted").unionByName(units(merged.where("fate = 'kept'"), "output")))


@query
def build_counters(spark, sf_dir):
    merged, rows, _ = _merged(spark, sf_dir)
    rejected = A.raw_record_rows(_table(spark, sf_dir, "raw")).where("reason is not null")
    return M.named_counters(merged, rows, rejected)


@query
def group_leakage(spark, sf_dir):
    groups = _table(spark, sf_dir, "groups").where(X.non_blank(F.col("split"))).select("grp", F.lower(X.strip_space(F.col("split"))).alias("split"))
    each = groups.groupBy("grp").agg(F.min("split").alias("lowest"), F.max("split").alias("highest"), F.count_distinct("split").alias("splits"))
    return each.where("lowest <> highest")


@query
def repeated_ids(spark, sf_dir):
    return _cases(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("case_no").alias("first_case")).where("n > 1")


# Joins.


def _judgements(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("pid"), F.least(F.floor(F.col("l_quantity") / 13), F.lit(3)).cast("int").alias("grade"))


@query
def judged_pairs(spark, sf_dir):
    queries = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("query"))
    passages = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), F.col("p_name").alias("passage"))
    return J.judged_pairs(_judgements(spark, sf_dir), queries, passages)


@query
def ungraded_documents(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "kind")
    return J.missing_references(documents, _table(spark, sf_dir, "doc_grades").select("doc_id").distinct(), "doc_id")


@query
def referenced_orders(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), "o_orderstatus")
    return orders.join(_judgements(spark, sf_dir).where("grade = 0").select("qid"), "qid", "left_semi")


@query
def audited_lookup(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("pid"))
    cheap = _table(spark, sf_dir, "part").where("p_retailprice < 950").select(F.col("p_partkey").alias("pid"), "p_name")
    return J.lookup_or_reason(lines, cheap, "pid", "p_name", "no such part").groupBy("p_name", "reason").agg(F.count(F.lit(1)).alias("n"))


@query
def gold_membership(spark, sf_dir):
    part, lines = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "lineitem")
    gold = part.select(F.col("p_partkey").alias("text_a"), F.concat_ws("##", F.split("p_name", " ")[0], "p_brand", "p_type").alias("result"))
    words = part.select(F.col("p_partkey").alias("text_a"), F.explode(F.array("p_brand", "p_type", F.lit("Brand#1"), F.lit("red"))).alias("text_b"))
    # One row for each pair: the label says whether the part was ever sold in a large lot.
    sold = lines.groupBy(F.col("l_partkey").alias("text_a")).agg(F.max((F.col("l_quantity") > 49).cast("int")).alias("label"))
    return J.membership_agrees(words.distinct().join(sold, "text_a"), gold, "text_a", "text_b", "label").groupBy("label", "member", "agrees").agg(F.count(F.lit(1)).alias("n"))


@query
def zipped_lists(spark, sf_dir):
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    from pyspark.sql import Window

    placed = nation.select("n_regionkey", "n_name", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("place"))
    left = placed.select(F.col("n_regionkey").alias("key"), "place", "n_name")
    right = region.select(F.col("r_regionkey").alias("key"), F.posexplode(F.split("r_name", "")).alias("at", "letter")).select("key", (F.col("at") + 1).alias("place"), "letter")
    return J.zipped_by_place(left, right, "key", "place")


@query
def zipped_slots(spark, sf_dir):
    """Names of slots and the sorted criteria of their records, by place; either list may be longer."""
    raw = _table(spark, sf_dir, "raw")
    names = raw.select(F.col("raw_no").alias("key"), F.posexplode("state.slots.name").alias("at", "slot"))
    keys = raw.select(F.col("raw_no").alias("key"), F.posexplode(F.array_sort(F.json_object_keys("criteria"))).alias("at", "criterion"))
    placed = lambda df, c: df.select("key", (F.col("at") + 1).alias("place"), c)
    return J.zipped_by_place(placed(names, "slot"), placed(keys, "criterion"), "key", "place")


@query
def label_fan_out(spark, sf_dir):
    events = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 40, F.col("event_type"))).alias("labels"))
    rows = J.fan_out(events, F.col("labels"), ["click", "error", "purchase", "signup", "view"])
    return rows.groupBy("label_name").agg(F.count_if("holds").alias("positive"), F.count(F.lit(1)).alias("n"))


@query
def candidate_groups(spark, sf_dir):
    """Orders of exactly four lines with one returned among them, all parts different."""
    lines = _table(spark, sf_dir, "lineitem")
    each = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("l_returnflag") == "R").alias("positives"), F.count_distinct("l_partkey").alias("parts"))
    return each.where("candidates = 4 and positives = 1 and parts = 4")


@query
def label_sets(spark, sf_dir):
    raw = _table(spark, sf_dir, "raw").where(X.non_blank(F.col("state.text")))
    each = raw.groupBy(X.digest(F.col("state.text")).alias("text_key"), "type").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("label")), "|").alias("labels"), F.size(F.collect_set("label")).alias("different"))
    return each.where("n > 1")


@query
def overlapping_documents(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").where(X.non_blank(F.col("text"))).select("doc_id", "grp", "text")
    hot = F.col("grp").startswith("desk:")
    return J.overlapping_texts(documents.where(hot), "text", documents.where(~hot).select(F.col("text").alias("held")), "held").select("doc_id")


# Ordered rows.


@query
def dialogue_prefixes(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    turns = W.dialogue_prefixes(events.withColumn("turn", F.struct("ts", "event_id")), "user_id", "turn", "event_type")
    return turns.select("event_id", F.md5("prefix").alias("prefix"))


@query
def sessions(spark, sf_dir):
    return W.session_starts(_table(spark, sf_dir, "events"), "user_id", "ts", 6 * 3600).select("event_id", "session")


@query
def continued_sessions(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return W.last_good_before(events, "user_id", ["ts", "event_id"], F.col("event_type") != "error", "event_id", "continues").select("event_id", "continues")


@query
def broken_runs(spark, sf_dir):
    return W.broken_runs(_table(spark, sf_dir, "events"), "event_type", "user_id", ["ts", "event_id"])


@query
def label_blind_order(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").withColumns({"a": F.col("l_partkey").cast("string"), "b": F.col("l_linenumber").cast("string"), "c": F.col("l_suppkey").cast("string")})
    return W.label_blind_order(lines, "l_orderkey", "a", "b", "c").groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("numbers"))


@query
def label_blind_places(spark, sf_dir):
    """The place of every line, which :func:`label_blind_order` only sums."""
    lines = _table(spark, sf_dir, "lineitem").withColumns({"a": F.col("l_partkey").cast("string"), "b": F.col("l_linenumber").cast("string"), "c": F.col("l_suppkey").cast("string")})
    return W.label_blind_order(lines, "l_orderkey", "a", "b", "c").select("l_orderkey", "l_linenumber", "place")


@query
def enumerated_slots(spark, sf_dir):
    raw = _table(spark, sf_dir, "raw").where("size(state.slots) > 0")
    return W.enumerated(raw.select("raw_no", "state"), F.col("state.slots.name"), "slot").select("raw_no", "entry_no", "slot")


# Texts.


@query
def span_checks(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").where(F.col("text").contains("医生"))
    at = F.instr("text", "医生") - 1
    rows = documents.select("doc_id", at.alias("at"), X.span_matches(F.col("text"), at, F.lit("医生")).alias("holds"), X.span_matches(F.col("text"), at + 1, F.lit("医生")).alias("shifted"))
    return rows


@query
def picture_references(spark, sf_dir):
    raw = _table(spark, sf_dir, "raw")
    return raw.where(F.col("state.text").rlike("如图|下图|见图|化验单|拍片")).select("raw_no")


@query
def answer_letters(spark, sf_dir):
    raw = _table(spark, sf_dir, "raw").where("type = 'choice'")
    return raw.select("raw_no", F.array_join(X.answer_letters(F.col("label")), "").alias("letters"))


@query
def event_properties(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    k = F.from_json("props", "k int").getField("k")
    return events.groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query
def url_documents(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").where("source is not null")
    url = F.concat(F.lit("https://Docs.Example.org/"), "source", F.lit("?page=1&id="), F.col("doc_id").cast("string"), F.lit("#top"))
    return documents.select("doc_id", X.url_document(url).alias("document"))


# Lengths.


@query
def length_summary(spark, sf_dir):
    return L.length_summary(_table(spark, sf_dir, "documents"), F.length("text"), ["kind"]).withColumn("mean", F.round("mean", 6))


@query
def length_histogram(spark, sf_dir):
    return L.length_histogram(_table(spark, sf_dir, "documents"), F.length("text"))


@query
def length_retention(spark, sf_dir):
    return L.retention(_table(spark, sf_dir, "documents"), F.length("text")).withColumn("share", F.round("share", 9))


@query
def recommended_cap(spark, sf_dir):
    return L.recommended_cap(_table(spark, sf_dir, "documents"), F.length("text"), 0.99)


@query
def length_buckets(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").where(F.length("text") > 0)
    return documents.groupBy(X.length_bucket(F.length("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query
def head_budget(spark, sf_dir):
    rows = _decisions(spark, sf_dir).withColumn("n", F.transform(D.option_texts(F.col("qtype"), F.col("option_keys"), F.col("option_desc")), lambda t: F.length(t) + 1))
    width = L.head_width(F.col("n")) + F.length("instructions")
    return L.head_budget(rows, width, F.size("option_keys"), F.col("case_no"))


@query
def value_counts(spark, sf_dir):
    return L.value_counts(_decisions(spark, sf_dir).withColumn("n_options", F.size("option_keys")), "qtype", "source", "n_options")


# Compiled sequences.


def _states(spark, sf_dir):
    return _decisions(spark, sf_dir).withColumn("state_text", F.col("state"))


def _shown(ids):
    return F.md5(F.array_join(ids.cast("array<string>"), ","))


@query
def strict_items(spark, sf_dir):
    rows = T.strict_items(_states(spark, sf_dir), T.character_tokens(), 320, 120)
    return rows.select("case_no", "reason", _shown(F.col("ids")).alias("ids"), F.array_join(F.col("markers").cast("array<string>"), ",").alias("markers"), "state_tokens")


@query
def strict_reasons(spark, sf_dir):
    rows = T.strict_items(_states(spark, sf_dir), T.character_tokens(), 260, 84)
    return rows.groupBy("qtype", "reason").agg(F.count(F.lit(1)).alias("n"))


@query
def rebuilt_items(spark, sf_dir):
    rows = T.lenient_prompts(_states(spark, sf_dir), T.character_tokens(), 120)
    whole = T.rebuilt(F.col("prompt"), F.col("state_ids"), F.lit(256), 2)
    left = T.rebuilt(F.col("prompt"), F.col("state_ids"), F.lit(128), 2, left=True)
    return rows.select("case_no", "reason", F.size(whole).alias("n_right"), _shown(whole).alias("right"), _shown(left).alias("left"))


@query
def length_filters(spark, sf_dir):
    rows = T.lenient_prompts(_states(spark, sf_dir), T.character_tokens(), 120).where("reason is null").select("qtype", F.size("prompt").alias("p"), F.size("state_ids").alias("s"))
    caps = F.explode(F.array(*map(F.lit, (128, 256, 512)))).alias("cap")
    each = rows.select("qtype", "p", "s", caps)
    return each.groupBy("qtype", "cap").agg(F.count_if(F.col("p") + F.col("s") + 1 <= F.col("cap")).alias("whole"), F.count_if(F.col("p") + 1 <= F.col("cap")).alias("prompt"))


def _padded(spark, sf_dir):
    rows = T.strict_items(_states(spark, sf_dir), T.character_tokens(), 320, 120).where("reason is null").select(F.col("case_no").alias("item"), "ids", "markers", F.size("ids").alias("length"))
    rows = Scratch(spark, "items").keep(rows, "items")
    plan = B.fixed_batches(rows.select("item", "length"), "item", "length", 16, 5)
    joined = plan.select("item", "batch").join(rows, "item")
    from pyspark.sql import Window

    width = F.max("length").over(Window.partitionBy("batch"))
    wide = joined.withColumns({"width": width, "marks": F.max(F.size("markers")).over(Window.partitionBy("batch"))})
    return wide.select("item", "batch", "width", T.padded(F.col("ids"), F.col("width"), 0).alias("ids"), T.marker_mask(F.col("markers"), F.col("marks")).alias("mask"))


@query
def padded_batches(spark, sf_dir):
    return _padded(spark, sf_dir).select("item", "batch", F.size("ids").alias("n_ids"), F.size("mask").alias("n_marks"), "width")


@query
def padded_sequences(spark, sf_dir):
    """The padded ids and masks themselves, by digest."""
    return _padded(spark, sf_dir).select("item", _shown(F.col("ids")).alias("ids"), F.array_join(F.col("mask").cast("array<string>"), ",").alias("mask"))


@query
def fixed_batches(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("length"))
    return B.fixed_batches(documents, "doc_id", "length", 16, 5).select("doc_id", "window", "batch", "place")


@query
def token_batches(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("length"))
    return B.token_batches(documents, "doc_id", "length", 8192, 1024, 5)


@query
def epoch_batches(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("length"))
    plan = B.fixed_batches(documents, "doc_id", "length", 16, 5)
    return B.epoch_order(plan, "batch", 5, 2).select("doc_id", "batch", "place", "step")


@query
def shard_plan(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("length"))
    plan = B.fixed_batches(documents, "doc_id", "length", 16, 5).select("batch")
    return B.shards(plan.distinct(), "batch", 8)


@query
def seeded_subset(spark, sf_dir):
    return B.seeded_subset(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, 9)


# Predictions.


def _predictions(spark, sf_dir):
    """The first numbers of an embedding as logits, its label as gold, kinds in turn."""
    rows = _table(spark, sf_dir, "embeddings")
    kind = F.element_at(F.array(F.lit("choice"), F.lit("score"), F.lit("noul")), (F.col("label") % 3 + 1).cast("int"))
    k = F.when(kind == "noul", 2).otherwise(4)
    logits = F.transform(F.slice("embedding", F.lit(1), k), lambda x: x.cast("double") * 6)
    place = F.col("label") % F.when(kind == "noul", 2).otherwise(4)
    target = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when(i == place, 0.7).otherwise(0.3 / (k - 1)))
    return rows.select("vec_id", kind.alias("qtype"), logits.alias("logits"), target.alias("target"))


@query
def softmax_scores(spark, sf_dir):
    rows = S.with_temperatures(_predictions(spark, sf_dir), {"choice": 1.5, "score": 0.8})
    return rows.select("vec_id", "qtype", F.round("confidence", 9).alias("confidence"), "correct", F.round("log_score", 9).alias("log_score"))


@query
def evaluation(spark, sf_dir):
    rows = S.scored(_predictions(spark, sf_dir))
    out = S.evaluation(rows)
    return out.select(F.coalesce("qtype", F.lit("all")).alias("qtype"), "items", *[F.round(c, 8).alias(c) for c in ("accuracy", "mean_log_score", "mean_confidence")])


@query
def calibration_error(spark, sf_dir):
    return S.calibration_error(S.scored(_predictions(spark, sf_dir)), "qtype").withColumn("ece", F.round("ece", 8))


@query
def proper_rewards(spark, sf_dir):
    rows = S.scored(_predictions(spark, sf_dir))
    return rows.select("vec_id", F.round(D.proper_reward(F.col("qtype"), F.col("probabilities"), F.col("target")), 8).alias("reward"), F.round(D.entropy_confidence(F.col("probabilities")), 8).alias("entropy_confidence"))


@query
def two_largest(spark, sf_dir):
    rows = S.scored(_predictions(spark, sf_dir)).select("vec_id", D.two_largest(F.col("probabilities")).alias("t"))
    return rows.select("vec_id", *[F.round(F.col("t")[c], 8).alias(c) for c in ("first", "second", "margin")])


@query
def temperature_losses(spark, sf_dir):
    """The loss that :func:`fitted_temperatures` minimizes, at fixed temperatures."""
    found = S.temperature_losses(_predictions(spark, sf_dir), [0.25, 0.5, 0.8, 1.0, 1.25, 2.0, 4.0, 8.0])
    return found.withColumn("loss", F.round("loss", 8))


@query
def fitted_temperatures(spark, sf_dir):
    fitted = S.fit_temperatures(_predictions(spark, sf_dir))
    return spark.createDataFrame(sorted(fitted.items()), "qtype string, temperature double")


def queries() -> dict[str, Query]:
    return dict(_ALL)


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
