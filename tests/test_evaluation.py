"""Retrieval metrics against a plain fold over small golden sets, and judged answers."""

import json
import math
import random

import pytest

from quillspark.operators import evaluation


def covers(hit, unit, note_level):
    return hit["path"] == unit[0] and (note_level or hit["chunk_id"].endswith("::doc") or hit["heading"] == unit[1])


def plain(labels, groups, hits, k, note_level):
    units = {}
    for e in labels:
        u = (e["path"], "" if note_level else e["heading"])
        units[u] = max(units.get(u, 0), e["grade"])
    units = {u: g for u, g in units.items() if g > 0}
    free, gain, claimed = dict(units), 0.0, {}
    for rank, hit in enumerate(hits[:k], 1):
        fits = [u for u in free if covers(hit, u, note_level)]
        if fits:
            best = max(fits, key=lambda u: free[u])  # the first of equal grades
            gain += free.pop(best) / math.log2(rank + 1)
            claimed[best] = rank
    ideal = sum(g / math.log2(r + 1) for r, g in enumerate(sorted(units.values(), reverse=True)[:k], 1))
    met = [any(covers(h, u, note_level) for h in hits[:k] for u in g) for g in groups]
    first = next((r for r, h in enumerate(hits, 1) if any(covers(h, u, note_level) for u, g in units.items() if g == 3)), None)
    out = round(gain / ideal, 4) if ideal else 0.0, round(sum(met) / len(met), 4) if met else 0.0, bool(met) and all(met), round(1 / first, 4) if first else 0.0, first
    return out, claimed, sorted(u for u, g in units.items() if g >= 2 and u not in claimed)


@pytest.mark.parametrize("note_level", [False, True])
def test_scores(spark, note_level):
    rng = random.Random(11)
    labels, groups, hits, want = [], [], [], {}
    for q in range(60):
        name = f"q{q}"
        place = lambda: (rng.choice("ab") + ".md", rng.choice(["", "H", "K"]))
        own = [dict(zip(("path", "heading"), place(), strict=True)) | {"grade": rng.randrange(4)} for _ in range(rng.randrange(1, 6))]
        sets = [[(e["path"], e["heading"]) for e in rng.sample(own, rng.randrange(1, len(own) + 1))] for _ in range(rng.randrange(3))]
        if note_level:
            sets = [[(p, "") for p, _ in g] for g in sets]
        found = [dict(zip(("path", "heading"), place(), strict=True)) | {"chunk_id": rng.choice(["n::doc", "n::s001", "n::s002"])} for _ in range(rng.randrange(9))]
        labels += [(name, k, e["path"], e["heading"], e["grade"]) for k, e in enumerate(own)]
        groups += [(name, k, *u) for k, g in enumerate(sets) for u in g]
        hits += [(name, r, h["path"], h["heading"], h["chunk_id"]) for r, h in enumerate(found, 1)]
        want[name] = plain(own, sets, found, 3, note_level)
    labels = spark.createDataFrame(labels, "query_id string, ord int, path string, heading string, grade int")
    groups = spark.createDataFrame(groups, "query_id string, group_no int, path string, heading string")
    hits = spark.createDataFrame(hits, "query_id string, rank int, path string, heading string, chunk_id string")
    got = {r.query_id: (r.ndcg, r.recall, r.complete, r.rr, r.first_rank) for r in evaluation.scores(labels, groups, hits, 3, note_level).collect()}
    assert got == {q: w[0] for q, w in want.items()}
    claimed = evaluation.claims(labels, hits, 3, note_level)
    told = {q: {} for q in want}
    for r in claimed.filter("rank IS NOT NULL").collect():
        told[r.query_id][r.path, r.heading] = r["rank"]
    assert told == {q: w[1] for q, w in want.items()}
    lost = {q: [] for q in want}
    for r in evaluation.missed(claimed).collect():
        lost[r.query_id].append((r.path, r.heading))
    assert {q: sorted(v) for q, v in lost.items()} == {q: w[2] for q, w in want.items()}


GOLDEN = {
    "answerable": True, "relevant_evidence": [{"note_id": "a", "path": "a.md", "heading": "H", "grade": 3}, {"note_id": "b", "path": "b.md", "heading": "", "grade": 2}], "required_evidence_groups": [["a#H"], ["b#"]],
    "gold_facts": ["one", "two"], "forbidden_facts": ["never"],
}


def test_judged_answers(spark):
    says = lambda *v: lambda system, user: json.dumps({"verdicts": list(v)})
    answer = {"abstained": False, "answer": "x", "citations": [{"path": "a.md", "heading": "H"}, {"path": "b.md", "heading": "", "chunk_id": "b::doc"}]}
    good = evaluation.score_answer(GOLDEN, answer, says(True, False, False))
    assert good["citation_group_recall"] == 1.0 and good["citation_complete"] and good["gold_fact_coverage"] == 0.5 and good["gold_facts_missing"] == ["two"] and good["forbidden_facts_present"] == []
    less = evaluation.score_answer(GOLDEN, answer | {"citations": [{"path": "a.md", "heading": "K"}]}, says(True, True, True))
    assert less["citation_group_recall"] == 0.0 and less["forbidden_facts_present"] == ["never"]
    assert evaluation.score_answer(GOLDEN, answer | {"citations": [{"path": "a.md", "heading": "K"}]}, says(True, True, True), note_level=True)["citation_group_recall"] == 0.5
    for reply in (says(True), lambda s, u: "?", says(1, 0, 0)):
        assert evaluation.score_answer(GOLDEN, answer, reply)["judge_failed"]
    none = evaluation.score_answer(GOLDEN | {"answerable": False}, {"abstained": True}, None)
    assert none["abstention_correct"] and "citation_complete" not in none
    rows = [{"id": str(k), "answerable": True} | s for k, s in enumerate((good, less))] + [{"id": "n", "answerable": False} | none]
    kinds = [x.split()[0] for x in evaluation.ANSWER_SCORES.split(", ")]
    means = evaluation.synthesis_means(spark.createDataFrame([tuple(r.get(k) for k in kinds) for r in rows], evaluation.ANSWER_SCORES)).first()
    assert (means.abstention_accuracy, means.citation_complete_rate, means.gold_fact_coverage, means.forbidden_fact_violation_rate, means.judge_failures) == (1.0, 0.5, 0.75, 0.5, 0)


def test_run(spark):
    golden = spark.createDataFrame(
        [
            ("q1", "one", True, "x", ["s"], [("a", "a.md", "H", 3), ("b", "b.md", "", 2)], [["a#H"], ["b#"]], ["f"], []),
            ("q2", "two", True, "x", [], [("c", "c.md", "", 3)], [["c#"]], ["f"], []), ("q3", "no", False, "y", ["s"], [], [], [], []),
        ],
        "id string, query string, answerable boolean, category string, slices array<string>, relevant_evidence array<struct<note_id:string,path:string,heading:string,grade:int>>, required_evidence_groups array<array<string>>, gold_facts array<string>, forbidden_facts array<string>",
    )

    def search(row):
        if row["id"] == "q2":
            raise ValueError("no note passes the filters")
        return spark.createDataFrame([("a.md", "K", "a::s1", 1), ("a.md", "H", "a::s2", 2), ("b.md", "", "b::doc", 3)], "path string, heading string, chunk_id string, place int")

    def answer(row, results):
        top = [r.asDict() for r in results.orderBy("place").collect()]
        return {"abstained": not row["answerable"] or not top, "answer": "x", "citations": top}

    out = evaluation.run(golden, search, k=5, answer=answer, judge=lambda s, u: '{"verdicts": [true]}')
    rows = {r.query_id: r for r in out.queries.collect()}
    want = (3 / math.log2(3) + 2 / 2) / (3 + 2 / math.log2(3))
    assert rows["q1"].ndcg == round(want, 4) and rows["q1"].rr == 0.5 and rows["q1"].complete and rows["q2"].ndcg == 0 and set(rows) == {"q1", "q2"}
    assert out.failed == {"q2": "no note passes the filters"} and out.means.first().complete_rate == 0.5
    assert {(r.kind, r.name): (r.n, r.rr) for r in out.breakdown.collect()} == {("overall", ""): (2, 0.25), ("category", "x"): (2, 0.25), ("slice", "s"): (1, 0.5)}
    told = {r.id: r for r in out.answers.collect()}
    assert told["q1"].citation_complete and told["q1"].gold_fact_coverage == 1.0 and told["q3"].abstention_correct and not told["q2"].abstention_correct
    assert evaluation.run(golden, search, only=["q1"]).queries.count() == 1
    with pytest.raises(ValueError, match="zz"):
        evaluation.run(golden, search, only=["zz"])
