"""Graded retrieval metrics, judged answers and checks of golden queries; all queries are scored in one plan.

A label names a note and a heading.  A candidate that is a whole note (its chunk id ends in
``::doc``) covers every label of its path, a section those of its own heading; at note level
headings do not count.  Per query there are only as many labels as a person wrote and k
candidates, so a query's claims are folded inside one row.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: End of the chunk id of a candidate that is a whole note, the grade of a direct answer and the least grade of required support.
WHOLE, DIRECT, REQUIRED = "::doc", 3, 2


def label_units(labels: DataFrame, note_level: bool = False) -> DataFrame:
    """query_id, path, heading, the best grade and ``ord``, the first place among the query's labels.

    ``labels`` may have ``ord``; without it labels are in order of path and heading.
    """
    heading = F.lit("") if note_level else F.col("heading")
    order = F.col("ord").cast("long") if "ord" in labels.columns else F.lit(0).cast("long")
    return labels.groupBy("query_id", "path", heading.alias("heading")).agg(F.max("grade").alias("grade"), F.min(order).alias("ord"))


def _whole(hits: DataFrame) -> Column:
    return F.coalesce(F.col("chunk_id").endswith(WHOLE), F.lit(False)) if "chunk_id" in hits.columns else F.lit(False)


def _candidates(hits: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, rank, path, heading and whether it is a whole note; the first k only if asked."""
    rows = hits.select("query_id", F.col("rank").cast("int").alias("rank"), "path", "heading", _whole(hits).alias("whole"))
    return rows if k is None else rows.filter(F.col("rank") <= k)


def _covers(hit_heading: Column, hit_whole: Column, heading: Column, note_level: bool) -> Column:
    return F.lit(True) if note_level else hit_whole | F.coalesce(hit_heading == heading, F.lit(False))


def claims(labels: DataFrame, hits: DataFrame, k: int = 5, note_level: bool = False) -> DataFrame:
    """query_id, path, heading, grade and rank (null: unclaimed) of every label with a grade above 0.

    Each of the first k candidates claims the label of the highest grade that it covers and no
    earlier one has claimed; of equal grades the first label.
    """
    units = label_units(labels, note_level).filter("grade > 0")
    listed = units.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("grade")).alias("down"), "ord", "path", "heading", "grade"))).alias("units"))
    top = _candidates(hits, k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "path", "heading", "whole"))).alias("hits"))
    rows = listed.join(top, "query_id", "left")

    def step(taken: Column, hit: Column) -> Column:
        free = F.zip_with("units", taken, lambda u, t: t.isNull() & (u["path"] == hit["path"]) & _covers(hit["heading"], hit["whole"], u["heading"], note_level))
        at = F.array_position(free, True)
        return F.transform(taken, lambda t, i: F.when(F.coalesce(at, F.lit(0)) == i + 1, hit["rank"]).otherwise(t))

    none = F.transform("units", lambda u: F.lit(None).cast("int"))
    taken = F.when(F.col("hits").isNull(), none).otherwise(F.aggregate("hits", none, step))
    found = rows.select("query_id", F.explode(F.zip_with("units", taken, lambda u, t: F.struct(u["path"].alias("path"), u["heading"].alias("heading"), u["grade"].alias("grade"), u["ord"].alias("ord"), t.alias("rank")))).alias("c"))
    return found.select("query_id", "c.path", "c.heading", "c.grade", "c.ord", "c.rank")


def ndcg(claimed: DataFrame, k: int = 5) -> DataFrame:
    """query_id and nDCG@k with a linear gain, of queries with a positive grade."""
    gains = F.sort_array(F.collect_list("grade"), asc=False)
    dcg = F.sum(F.when(F.col("rank") <= k, F.col("grade") / F.log2(F.col("rank") + 1)).otherwise(0.0))
    rows = claimed.groupBy("query_id").agg(dcg.alias("dcg"), gains.alias("gains"))
    ideal = F.aggregate(F.transform(F.slice("gains", 1, k), lambda g, i: g / F.log2(i + 2)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("query_id", (F.col("dcg") / ideal).alias("ndcg"))


def _met(wanted: DataFrame, hits: DataFrame, k: int | None, note_level: bool) -> DataFrame:
    """Rows of ``wanted`` (query_id, path, heading) with ``rank`` of each candidate that covers it."""
    rows = _candidates(hits, k).withColumnsRenamed({"heading": "__heading"})
    both = wanted.join(rows, ["query_id", "path"])
    return both.filter(_covers(F.col("__heading"), F.col("whole"), F.col("heading"), note_level)).drop("__heading", "whole")


def reciprocal_rank(labels: DataFrame, hits: DataFrame, note_level: bool = False) -> DataFrame:
    """query_id, rank of the first candidate, among all, that covers a direct answer, and its reciprocal; 0 without one."""
    wanted = label_units(labels, note_level).filter(F.col("grade") == DIRECT)
    first = _met(wanted, hits, None, note_level).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return labels.select("query_id").distinct().join(first, "query_id", "left").select("query_id", "first_rank", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("rr"))


def group_recall(groups: DataFrame, hits: DataFrame, k: int = 5, note_level: bool = False) -> DataFrame:
    """query_id, recall (share of groups of which the first k cover a member), complete and the numbers of the groups that are not met.

    ``groups``: query_id, group_no, path, heading; a member without a path is no label and meets nothing.
    """
    met = _met(groups.select("query_id", "group_no", "path", "heading"), hits, k, note_level).select("query_id", "group_no").distinct().withColumn("ok", F.lit(True))
    per = groups.select("query_id", "group_no").distinct().join(met, ["query_id", "group_no"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    return per.groupBy("query_id").agg(
        F.avg(F.col("ok").cast("double")).alias("recall"), F.bool_and("ok").alias("complete"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("group_no")))).alias("unmet")
    )


def missed(claimed: DataFrame) -> DataFrame:
    """Labels of required support that none of the first k candidates has claimed."""
    return claimed.filter((F.col("grade") >= REQUIRED) & F.col("rank").isNull()).select("query_id", "path", "heading", "grade")


def scores(labels: DataFrame, groups: DataFrame, hits: DataFrame, k: int = 5, note_level: bool = False) -> DataFrame:
    """One row per query of ``labels`` with every metric, rounded to 4; without labels of a grade, or groups, a metric is 0."""
    claimed = claims(labels, hits, k, note_level)
    rows = reciprocal_rank(labels, hits, note_level).join(ndcg(claimed, k), "query_id", "left").join(group_recall(groups, hits, k, note_level), "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c)
    return rows.select("query_id", zero("ndcg"), zero("recall"), F.coalesce("complete", F.lit(False)).alias("complete"), zero("rr"), "first_rank")


def golden_labels(golden: DataFrame) -> DataFrame:
    """query_id, ord, note_id, path, heading, grade of every label of the golden queries."""
    rows = golden.select(F.col("id").alias("query_id"), F.posexplode("relevant_evidence").alias("ord", "e"))
    return rows.select("query_id", "ord", "e.note_id", "e.path", "e.heading", "e.grade")


def golden_groups(golden: DataFrame) -> DataFrame:
    """query_id, group_no, path, heading of every member of a required group; without a path if it is no label."""
    rows = golden.select(F.col("id").alias("query_id"), F.posexplode("required_evidence_groups").alias("group_no", "g")).select("query_id", "group_no", F.explode("g").alias("ref"))
    known = golden_labels(golden).select("query_id", F.concat("note_id", F.lit("#"), "heading").alias("ref"), "path", "heading").dropDuplicates(["query_id", "ref"])
    return rows.join(known, ["query_id", "ref"], "left").select("query_id", "group_no", "path", "heading")


def judged(judge: Callable[[str, str], str], answer: str, statements: list[str]) -> list[bool] | None:
    """For each statement whether the answer claims it, as a model says; null if its answer has another shape."""
    from .synthesis import parse

    numbered = "\n".join(f"{k}. {s}" for k, s in enumerate(statements, 1))
    told = parse(judge(JUDGE, f"<ANSWER>\n{answer}\n</ANSWER>\n<STATEMENTS>\n{numbered}\n</STATEMENTS>"))
    verdicts = told.get("verdicts") if told else None
    good = isinstance(verdicts, list) and len(verdicts) == len(statements) and all(isinstance(v, bool) for v in verdicts)
    return verdicts if good else None


#: What a judging model is told.
JUDGE = (
    "You judge an answer strictly.  You get the answer and a numbered list of statements.  For each statement say whether the answer claims or takes for granted what it says; "
    'whether it is true is not the question.  Reply with JSON only: {"verdicts": [true, false, ...]}, one boolean for each statement, in order.'
)


def score_answer(golden: dict, answer: dict, judge: Callable[[str, str], str], note_level: bool = False) -> dict:
    """How one answer of ``synthesis.synthesize`` does on its golden query."""
    answerable, abstained = golden["answerable"], bool(answer.get("abstained"))
    out = {"abstained": abstained, "abstention_correct": abstained != answerable, "confidence": answer.get("confidence"), "warnings": list(answer.get("warnings") or [])}
    if answerable:
        units = {f"{e['note_id']}#{e['heading']}": (e["path"], e["heading"]) for e in golden["relevant_evidence"]}

        def covers(citation: dict, unit: tuple[str, str]) -> bool:
            whole = note_level or str(citation.get("chunk_id", "")).endswith(WHOLE)
            return citation.get("path") == unit[0] and (whole or citation.get("heading") == unit[1])

        groups = golden["required_evidence_groups"]
        met = sum(any(covers(c, units[ref]) for c in answer.get("citations") or [] for ref in group if ref in units) for group in groups)
        out |= {"citation_group_recall": round(met / len(groups), 4) if groups else 0.0, "citation_complete": bool(groups) and met == len(groups)}
    gold, forbidden = list(golden["gold_facts"]) if answerable else [], list(golden["forbidden_facts"])
    if not abstained and answer.get("answer") and (gold or forbidden):
        verdicts = judged(judge, answer["answer"], gold + forbidden)
        if verdicts is None:
            return out | {"judge_failed": True}
        if gold:
            out |= {"gold_fact_coverage": round(sum(verdicts[: len(gold)]) / len(gold), 4), "gold_facts_missing": [f for f, v in zip(gold, verdicts, strict=False) if not v], "gold_facts_present": sum(verdicts[: len(gold)])}
        if forbidden:
            out["forbidden_facts_present"] = [f for f, v in zip(forbidden, verdicts[len(gold) :], strict=True) if v]
    return out


def retrieval_means(rows: DataFrame) -> DataFrame:
    """Means of ``scores`` over all queries."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    return rows.agg(F.count(F.lit(1)).alias("queries_scored"), mean("ndcg").alias("mean_ndcg"), mean("recall").alias("mean_recall"), mean("complete").alias("complete_rate"), mean("rr").alias("mrr"))


def breakdown(rows: DataFrame, metrics: tuple[str, ...] = ("ndcg", "rr")) -> DataFrame:
    """Means over all queries, by category and by slice; a query counts in each of its slices."""
    whole = rows.select("query_id", F.explode(F.concat(
        F.array(F.struct(F.lit("overall").alias("kind"), F.lit("").alias("name")), F.struct(F.lit("category").alias("kind"), F.col("category").alias("name"))),
        F.transform("slices", lambda s: F.struct(F.lit("slice").alias("kind"), s.alias("name"))),
    )).alias("g"), *metrics)
    return whole.groupBy("g.kind", "g.name").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(F.round(m, 4)), 4).alias(m) for m in metrics))


@dataclass
class Run:
    """An evaluation: a row per query, means over all, means by category and slice, and what went wrong."""

    queries: DataFrame
    means: DataFrame
    breakdown: DataFrame
    answers: DataFrame | None
    failed: dict[str, str]


def run(golden: DataFrame, search: Callable[[dict], DataFrame], k: int = 5, note_level: bool = False, only: Sequence[str] | None = None,
        answer: Callable[[dict, DataFrame], dict] | None = None, judge: Callable[[str, str], str] | None = None) -> Run:
    """Search for every answerable golden query and score what is found; with ``answer``, ask for answers to all and judge them.

    ``search`` gives the results of one query (path, heading, chunk_id and place); one that
    raises ValueError, as filters that match nothing do, counts as without results.  Golden
    queries are written by hand, so they are read to the driver; their results are one plan.
    """
    rows = [r.asDict(recursive=True) for r in golden.collect()]
    if only is not None:
        if odd := sorted(set(only) - {r["id"] for r in rows}):
            raise ValueError(f"unknown query ids: {', '.join(odd)}")
        rows = [r for r in rows if r["id"] in set(only)]
        golden = golden.filter(F.col("id").isin(*only))
    found: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    for r in rows:
        if r["answerable"] or answer:
            try:
                found[r["id"]] = search(r)
            except ValueError as e:
                failed[r["id"]] = str(e)
    spark = golden.sparkSession
    hits = spark.createDataFrame([], "query_id string, rank int, path string, heading string, chunk_id string")
    for name, out in found.items():
        hits = hits.unionByName(out.select(F.lit(name).alias("query_id"), F.col("place").cast("int").alias("rank"), "path", "heading", "chunk_id"))
    asked = golden.filter("answerable")
    scored = scores(golden_labels(asked), golden_groups(asked), hits, k, note_level)
    zero = {"ndcg": 0.0, "recall": 0.0, "complete": False, "rr": 0.0}
    scored = asked.select(F.col("id").alias("query_id"), "category", "slices").join(scored, "query_id", "left").fillna(zero)
    answers = None
    if answer:
        none = spark.createDataFrame([], "path string, heading string, chunk_id string, place int")
        told = [{"id": r["id"], "answerable": r["answerable"]} | score_answer(r, answer(r, found.get(r["id"], none)), judge, note_level) for r in rows]
        names = [x.split()[0] for x in ANSWER_SCORES.split(", ")]
        answers = spark.createDataFrame([tuple(t.get(n) for n in names) for t in told], ANSWER_SCORES)
    return Run(scored, retrieval_means(scored), breakdown(scored.withColumn("done", F.col("complete").cast("double")), ("ndcg", "recall", "done", "rr")), answers, failed)


#: Columns of the scores of answers; a column is null where a score does not apply.
ANSWER_SCORES = (
    "id string, answerable boolean, abstained boolean, abstention_correct boolean, confidence string, citation_group_recall double, citation_complete boolean, "
    "gold_fact_coverage double, forbidden_facts_present array<string>, judge_failed boolean"
)


def synthesis_means(rows: DataFrame) -> DataFrame:
    """Means over the answers that each of them is about; ``rows`` have the columns of ``ANSWER_SCORES``."""
    mean = lambda cond, value: F.round(F.avg(F.when(cond, value.cast("double"))), 4)
    answerable, failed = F.col("answerable"), F.coalesce("judge_failed", F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("queries_scored"), mean(F.lit(True), F.col("abstention_correct")).alias("abstention_accuracy"), mean(answerable, F.col("abstained")).alias("false_abstain_rate"),
        mean(~answerable, ~F.col("abstained")).alias("false_answer_rate"), mean(answerable & ~F.col("abstained"), F.coalesce("citation_complete", F.lit(False))).alias("citation_complete_rate"),
        mean(answerable, F.col("gold_fact_coverage")).alias("gold_fact_coverage"),
        mean(F.col("forbidden_facts_present").isNotNull() & ~failed, F.size("forbidden_facts_present") > 0).alias("forbidden_fact_violation_rate"),
        F.count_if(failed).alias("judge_failures"),
    )


#: Keys of a golden query, of a label, and of its filters.
QUERY_KEYS = ("id", "query", "answerable", "category", "slices", "relevant_evidence", "required_evidence_groups", "gold_facts", "forbidden_facts")
LABEL_KEYS, FILTER_KEYS = ("note_id", "path", "heading", "grade"), ("type", "folder", "tags", "since", "until")


def shape_problems(line: str) -> list[str]:
    """What is wrong with the form of one golden query, a line of JSON."""
    try:
        row = json.loads(line)
    except ValueError:
        return ["no JSON"]
    if not isinstance(row, dict):
        return ["no JSON object"]
    if gone := [k for k in QUERY_KEYS if k not in row]:
        return ["missing: " + ", ".join(gone)]
    text = lambda v: isinstance(v, str) and bool(v.strip())
    texts = lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)
    found = [f"{k} is no text" for k in ("id", "query", "category") if not text(row[k])] + [f"{k} is no list of texts" for k in ("slices", "gold_facts", "forbidden_facts") if not texts(row[k])]
    found += ["answerable is no boolean"] * (not isinstance(row["answerable"], bool))
    for k, e in enumerate(row["relevant_evidence"] if isinstance(row["relevant_evidence"], list) else [None]):
        if not isinstance(e, dict) or any(x not in e for x in LABEL_KEYS):
            found.append(f"label {k} is no object with {', '.join(LABEL_KEYS)}")
        elif not (text(e["note_id"]) and text(e["path"]) and isinstance(e["heading"], str)):
            found.append(f"label {k} has a name that is no text")
        elif isinstance(e["grade"], bool) or e["grade"] not in (0, 1, 2, 3):
            found.append(f"label {k} has a grade that is none of 0 to 3")
    for k, g in enumerate(row["required_evidence_groups"] if isinstance(row["required_evidence_groups"], list) else [None]):
        if not texts(g) or not g or any("#" not in ref for ref in g):
            found.append(f"group {k} is no list of note#heading")
    if (own := row.get("filters")) is not None:
        if not isinstance(own, dict) or set(own) - set(FILTER_KEYS):
            found.append("filters has other keys than " + ", ".join(FILTER_KEYS))
        elif any(not (texts(v) if k == "tags" else isinstance(v, str)) for k, v in own.items()):
            found.append("a filter is no text, or tags no list of texts")
    return found


def validate(golden: DataFrame, corpus: DataFrame, headings: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """id, problem and level (error or warning) of every golden query that breaks a rule.

    ``corpus``: note_id, path; ``headings``: path, heading, with "" for what stands before the
    first heading; ``expected``: numbers of ``notes`` and ``queries``, if given.  Each rule is a
    plan of its own and all are put together; labels are looked up by joins.
    """
    def rule(cond, text: str) -> DataFrame:
        return golden.filter(cond).select("id", F.lit(text).alias("problem"))

    def none(column: str):
        return F.coalesce(F.size(column), F.lit(0)) <= 0

    label = golden_labels(golden).withColumnRenamed("query_id", "id")
    known = corpus.select("path", F.col("note_id").alias("real_id"))
    at = label.join(known, "path", "left")
    head = headings.select("path", "heading").distinct().withColumn("has", F.lit(True))
    titled = at.filter("real_id IS NOT NULL").join(head, ["path", "heading"], "left")
    member = golden.select("id", F.explode("required_evidence_groups").alias("g")).select("id", F.explode("g").alias("ref"))
    refs = label.withColumn("ref", F.concat("note_id", F.lit("#"), "heading")).groupBy("id", "ref").agg(F.max("grade").alias("grade"), F.count_distinct("ord").alias("n"))
    found = member.join(refs, ["id", "ref"], "left")
    many = golden.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    twice = corpus.groupBy("note_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    problems = [
        rule(F.col("id").isNull() | F.col("query").isNull(), "id or query missing"), many.select("id", F.lit("repeated id").alias("problem")),
        rule(F.col("answerable") & ~F.exists(F.coalesce("relevant_evidence", F.array()), lambda e: e["grade"] == DIRECT), "answerable without a grade 3"),
        rule(F.col("answerable") & none("required_evidence_groups"), "answerable without groups"), rule(F.col("answerable") & none("gold_facts"), "answerable without facts"),
        rule(~F.col("answerable") & (~none("relevant_evidence") | ~none("required_evidence_groups") | ~none("gold_facts")), "unanswerable with labels, groups or facts"),
        label.filter("grade NOT BETWEEN 0 AND 3").select("id", F.lit("grade out of range").alias("problem")),
        at.filter("real_id IS NULL").select("id", F.concat(F.lit("no such path: "), "path").alias("problem")),
        at.filter("real_id IS NOT NULL AND real_id <> note_id").select("id", F.concat(F.lit("other id at: "), "path").alias("problem")),
        titled.filter("has IS NULL").select("id", F.concat(F.lit("no such heading: "), "path", F.lit("#"), "heading").alias("problem")),
        found.filter("grade IS NULL").select("id", F.concat(F.lit("group member without label: "), "ref").alias("problem")),
        found.filter("grade < 2").select("id", F.concat(F.lit("group member below grade 2: "), "ref").alias("problem")),
        twice.select(F.lit(None).cast("string").alias("id"), F.concat(F.lit("note id used twice: "), "note_id").alias("problem")),
        *(
            rows.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != expected[k]).select(F.lit(None).cast("string").alias("id"), F.concat(F.lit(f"{expected[k]} {k} expected, not "), F.col("n").cast("string")).alias("problem"))
            for k, rows in (("notes", corpus), ("queries", golden)) if expected and k in expected
        ),
    ]
    warned = refs.filter("n > 1").select("id", F.concat(F.lit("label given twice: "), "ref").alias("problem"), F.lit("warning").alias("level"))
    return reduce(DataFrame.unionByName, (p.withColumn("level", F.lit("error")) for p in problems)).unionByName(warned)


def same_paths(corpus: DataFrame, index: DataFrame) -> DataFrame:
    """Paths on one side only, with the side."""
    a, b = corpus.select("path").distinct(), index.select("path").distinct()
    return a.join(b, "path", "left_anti").withColumn("only_in", F.lit("corpus")).unionByName(b.join(a, "path", "left_anti").withColumn("only_in", F.lit("index")))


def dataset_stats(golden: DataFrame, corpus: DataFrame) -> DataFrame:
    labelled = golden.select(F.explode("relevant_evidence.path").alias("path")).distinct()
    return golden.agg(F.count(F.lit(1)).alias("queries"), F.count_if("answerable").alias("answerable"), F.count_distinct("category").alias("categories")).withColumns(
        {"labelled_notes": labelled.agg(F.count(F.lit(1))).scalar(), "distractors": corpus.join(labelled, "path", "left_anti").agg(F.count(F.lit(1))).scalar()}
    )
