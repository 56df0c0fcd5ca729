"""Questions against gold evidence: recall of sets, graded gain, citations, recovery of parents, rules of a data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_blank
from tessera.functions.texts import text_key
from tessera.operators.skew import salted_join


def gold_sets(questions: DataFrame, links: DataFrame, own: float = 2, linked: float = 1) -> DataFrame:
    """(qa_id, key, rel): a question's own document and those that a link joins to it, in either direction.

    ``questions`` (qa_id, doc), ``links`` (a, b). Repeated links and loops count once; a question without a document has no gold.
    """
    q = questions.where("qa_id is not null and doc is not null").select("qa_id", "doc").distinct()
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null and a <> b").distinct()
    more = salted_join(q.withColumnRenamed("doc", "a"), both, "a", F.col("qa_id")).select("qa_id", F.col("b").alias("key"), F.lit(float(linked)).alias("rel"))
    return q.select("qa_id", F.col("doc").alias("key"), F.lit(float(own)).alias("rel")).unionByName(more)


def recall_of_sets(lists: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(qa_id, strategy, gold, found, recall): the part of the gold set that is among the documents of the first k hits together.

    ``lists`` (qa_id, strategy, place, hit_doc). Only questions with gold and a list.
    """
    size = gold.groupBy("qa_id").agg(F.countDistinct("key").alias("gold"))
    asked = lists.select("qa_id", "strategy").distinct().join(size, "qa_id")
    top = lists.where((F.col("place") <= k) & F.col("hit_doc").isNotNull()).select("qa_id", "strategy", F.col("hit_doc").alias("key")).distinct()
    found = top.join(gold.select("qa_id", "key").distinct(), ["qa_id", "key"]).groupBy("qa_id", "strategy").agg(F.count(F.lit(1)).alias("found"))
    out = asked.join(found, ["qa_id", "strategy"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.withColumn("recall", F.round(F.col("found") / F.col("gold"), 6))


def parent_recovery(lists: DataFrame, parents: DataFrame, k: int = 10) -> DataFrame:
    """(strategy, hits, recovered, rate): of the first k hits that name a parent, those whose parent is their document's and has a
    text. ``parents`` (parent_id, doc, text). A strategy without such hits has a rate of null and comes out with 0 hits."""
    named = lists.where(F.col("place") <= k).select("strategy", "qa_id", "parent_id", "hit_doc")
    p = parents.where(~is_blank(F.col("text"))).select("parent_id", F.col("doc").alias("parent_doc")).dropDuplicates(["parent_id"])
    each = salted_join(named, p, "parent_id", F.col("qa_id"), how="left")
    return each.groupBy("strategy").agg(
        F.count("parent_id").alias("hits"), F.count_if(F.col("parent_doc") == F.col("hit_doc")).alias("recovered"), F.round(F.count_if(F.col("parent_doc") == F.col("hit_doc")) / F.nullif(F.count("parent_id"), F.lit(0)), 6).alias("rate")
    )


def citations_of(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """(answer_id, qa_id, label, …): the cited labels of each answer that stand for one of its question's hits."""
    cited = answers.select("answer_id", "qa_id", F.explode(F.array_distinct("citations")).alias("label")).where("qa_id is not null")
    return cited.join(labels, ["qa_id", "label"])


def gold_citations(answers: DataFrame, labels: DataFrame, gold: DataFrame) -> DataFrame:
    """(answer_id, strategy, cited, right, precision, recall): citations of documents of the gold set.

    ``labels`` (qa_id, strategy, label, hit_doc). Precision is null without a valid citation, recall without gold.
    """
    docs = citations_of(answers, labels).select("answer_id", "qa_id", "strategy", F.col("hit_doc").alias("key")).distinct()
    marked = docs.join(gold.select("qa_id", "key", F.lit(1).alias("hit")).distinct(), ["qa_id", "key"], "left")
    counts = marked.groupBy("answer_id", "strategy").agg(F.count(F.lit(1)).alias("cited"), F.count("hit").alias("right"))
    size = gold.groupBy("qa_id").agg(F.countDistinct("key").alias("gold"))
    lists = labels.select("qa_id", "strategy").distinct()
    all_ = answers.select("answer_id", "qa_id").join(lists, "qa_id").join(size, "qa_id", "left").join(counts, ["answer_id", "strategy"], "left")
    cited, right = F.coalesce("cited", F.lit(0)), F.coalesce("right", F.lit(0))
    return all_.select("answer_id", "strategy", cited.alias("cited"), right.alias("right"), F.round(right / F.nullif(cited, F.lit(0)), 6).alias("precision"), F.round(right / F.col("gold"), 6).alias("recall"))


def substring_citations(answers: DataFrame, evidence: DataFrame, references: DataFrame) -> DataFrame:
    """(answer_id, strategy, cited, holding, precision, recall): cited evidence that holds the reference answer word for word.

    ``evidence`` (qa_id, strategy, label, evidence), ``references`` (qa_id, reference). Recall is 1 where any does, else 0;
    precision is null without a valid citation. Blank references are held by nothing.
    """
    held = citations_of(answers, evidence).join(references, "qa_id", "left")
    holds = ~is_blank(F.col("reference")) & F.coalesce(F.col("evidence").contains(F.col("reference")), F.lit(False))
    out = held.groupBy("answer_id", "strategy").agg(F.count(F.lit(1)).alias("cited"), F.count_if(holds).alias("holding"))
    return out.select("answer_id", "strategy", "cited", "holding", F.round(F.col("holding") / F.col("cited"), 6).alias("precision"), (F.col("holding") > 0).cast("int").alias("recall"))


def same_ranking(lists: DataFrame, a: str, b: str, k: int = 10) -> DataFrame:
    """(qa_id, same, shared): whether two strategies rank the same documents in the same order, and how many both have.

    Only questions with both lists.
    """
    ordered = lists.where((F.col("place") <= k) & F.col("strategy").isin(a, b)).groupBy("qa_id", "strategy").agg(F.array_sort(F.collect_list(F.struct("place", "hit_doc"))).alias("x"))  # at most k
    names = ordered.select("qa_id", "strategy", F.transform("x", lambda e: F.coalesce(e["hit_doc"], F.lit(""))).alias("docs"))
    of = lambda s, name: names.where(F.col("strategy") == s).select("qa_id", F.col("docs").alias(name))
    both = of(a, "one").join(of(b, "two"), "qa_id")
    return both.select("qa_id", (F.col("one") == F.col("two")).cast("int").alias("same"), F.size(F.array_intersect("one", "two")).alias("shared"))


def first_ids(docs: DataFrame, doc: str, k: int) -> list:
    """The first k documents by id."""
    return [r[0] for r in docs.select(doc).distinct().orderBy(doc).limit(k).collect()]


def filled_top(scored: DataFrame, queries: DataFrame, docs: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """(query, doc, score, rank): the k best; a query with fewer scored documents is filled with the first others, at score 0.

    Of the documents by id the first k are enough to fill any list, so only these come to the driver. ``scored`` need have only
    the k best of each query and its pairs with these documents; it is read twice.
    """
    first = first_ids(docs, doc, k)
    w = Window.partitionBy(query).orderBy(F.desc("score"), doc)
    top = scored.select(query, doc, F.round("score", 9).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
    zero = queries.select(query).distinct().select(query, F.explode(F.array(*map(F.lit, first))).alias(doc)) if first else top.select(query, doc).limit(0)
    zero = zero.join(scored.select(query, doc), [query, doc], "left_anti").withColumn("score", F.lit(0.0))
    return top.unionByName(zero).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def counted(name: str, broken: Column) -> Column:
    return F.struct(F.lit(name).alias("check"), F.count_if(F.coalesce(broken, F.lit(False))).alias("violations"))


def dataset_rules(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """(check, violations): answers that aren't in their source's text, spans that don't hold them, ids inside questions, blank
    questions, unknown documents, and questions repeated but for blanks and case. One pass over the pairs, one join."""
    known = documents.select(F.col("doc")).where("doc is not null").distinct().withColumn("known", F.lit(True))
    p = salted_join(pairs, known, "doc", F.col("qa_id"), how="left")
    span = F.substring(F.col("source_text"), F.col("answer_start") + 1, F.col("answer_end") - F.col("answer_start"))
    counts = p.agg(
        F.array(
            counted("answer_outside", ~F.col("source_text").contains(F.col("answer"))),
            counted("span_differs", span != F.col("answer")),
            counted("id_in_question", F.lower("question").contains(F.lower("qa_id")) | F.lower("question").contains(F.col("doc"))),
            counted("blank_question", is_blank(F.col("question"))),
            counted("unknown_document", F.col("doc").isNotNull() & F.col("known").isNull()),
        ).alias("x")
    ).select(F.explode("x").alias("x")).select("x.*")
    repeated = repeated_questions(pairs).agg(F.lit("repeated_question").alias("check"), F.coalesce(F.sum("records"), F.lit(0)).alias("violations"))
    return counts.unionByName(repeated)


def repeated_questions(pairs: DataFrame) -> DataFrame:
    """(question_key, records, splits): questions that several records ask, but for blanks and case, and in how many splits."""
    keyed = pairs.where(~is_blank(F.col("question"))).select(text_key(F.col("question")).alias("question_key"), "split")
    return keyed.groupBy("question_key").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("split").alias("splits")).where("records > 1")


def chunk_rules(chunks: DataFrame, parents: DataFrame, limit: int) -> DataFrame:
    """(check, violations): chunks that repeat an id, exceed the limit, lack a parent or differ from it in type or role, or aren't
    a part of its text. Parents are joined once."""
    p = parents.select("parent_id", F.lit(True).alias("known"), F.col("source_type").alias("parent_type"), F.col("evidence_role").alias("parent_role"), "original_text")
    c = salted_join(chunks.select("chunk_id", "parent_id", "text", "source_type", "evidence_role"), p, "parent_id", F.col("chunk_id"), how="left")
    out = c.agg(
        F.array(
            counted("too_long", F.length("text") > limit),
            counted("no_parent", F.col("parent_id").isNull()),
            counted("orphan", F.col("parent_id").isNotNull() & F.col("known").isNull()),
            counted("other_type", F.col("known") & (F.col("source_type") != F.col("parent_type"))),
            counted("other_role", F.col("known") & (F.col("evidence_role") != F.col("parent_role"))),
            counted("not_in_parent", F.col("known") & ~F.col("original_text").contains(F.col("text"))),
        ).alias("x")
    )
    return out.select(F.explode("x").alias("x")).select("x.*")


def child_parents(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """(chunk_id, parent_id, state): ok, no_parent, orphan or other_type."""
    p = parents.select("parent_id", F.lit(True).alias("known"), F.col("source_type").alias("parent_type"))
    c = salted_join(chunks.select("chunk_id", "parent_id", "source_type"), p, "parent_id", F.col("chunk_id"), how="left")
    state = F.when(F.col("parent_id").isNull(), "no_parent").when(F.col("known").isNull(), "orphan").when(F.col("source_type") != F.col("parent_type"), "other_type").otherwise("ok")
    return c.select("chunk_id", "parent_id", state.alias("state"))


def joined_units(units: DataFrame, group: str, unit: str, text: str) -> DataFrame:
    """(group, unit, start, length): where each unit's text begins when a group's units are joined in order with a line end between."""
    before = Window.partitionBy(group).orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return units.select(group, unit, F.coalesce(F.sum(n + 1).over(before), F.lit(0)).cast("long").alias("start"), n.alias("length"))


def pending(records: DataFrame, methods: list[str], answers: DataFrame) -> DataFrame:
    """(qa_id, method, attempt): what a resumed run has still to do: every record by every method without a whole answer; the
    attempt counts the failed ones before."""
    plan = records.select("qa_id").distinct().select("qa_id", F.explode(F.array(*map(F.lit, methods))).alias("method"))
    done = answers.where(~is_blank(F.col("answer"))).select("qa_id", "method").distinct()
    failed = answers.where(is_blank(F.col("answer"))).groupBy("qa_id", "method").agg(F.count(F.lit(1)).alias("failed"))
    left = plan.join(done, ["qa_id", "method"], "left_anti").join(failed, ["qa_id", "method"], "left")
    return left.select("qa_id", "method", (F.coalesce("failed", F.lit(0)) + 1).alias("attempt"))
