import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.porter import stem
from quillspark.operators import chunking, dense, edits, enrich, fusion, health, lexical, links, providers, ranking, summaries, sync, synthesis
from quillspark.sources import notes
from quillspark.streaming import incremental


def test_bm25_against_loop(spark):
    docs = ["a cat sat", "the cat cat ran far away", "dog", "", "cat dog bird", "cat and cats"]
    rows = lexical.tokenized(spark.createDataFrame(list(enumerate(docs)), "note_id int, body string"))
    terms = lexical.query_terms("cat the dog dog")
    toks = [[w for w in d.split() if w not in lexical.T.STOP_WORDS] for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = {t: sum(t in x for x in toks) for x in toks for t in x}
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if v < 0 else v for t, v in raw.items()}
    want = [sum(idf[q] * x.count(q) * 2.2 / (x.count(q) + 1.2 * (0.25 + 0.75 * len(x) / avg)) for q in terms if q in x) for x in toks]
    got = {r.note_id: r.keyword for r in lexical.scored(rows, terms).collect()}
    assert [got[k] for k in range(n)] == pytest.approx(want)
    assert {r.keyword for r in lexical.scored(rows, []).collect()} == {0.0}


def test_stemmed_search(spark):
    docs = ["Running runs", "the runner ran a relation", "relational relations relate", "Dying news", "none of it"]
    rows = spark.createDataFrame(list(enumerate(docs)), "note_id int, body string")
    plain = [[stem(w) for w in d.lower().split() if w not in lexical.T.STOP_WORDS] for d in docs]
    assert [r.tokens for r in lexical.tokenized(rows, stemmed=True).orderBy("note_id").collect()] == plain
    assert lexical.query_terms("Relations, dying", stemmed=True) == ["relat", "die"]
    assert {r.note_id for r in lexical.search(rows, "relation run", 5).collect() if r.keyword > 0} == {0, 1, 2}


def test_fusion_values(spark):
    rows = spark.createDataFrame([("a", 2.0, 1.0), ("b", 2.0, 5.0), ("c", 1.0, 3.0)], "note_id string, semantic double, keyword double")
    got = {r.note_id: r.fused for r in fusion.rrf(rows).collect()}
    total = {"a": 0.5 / 61.5 + 0.5 / 63, "b": 0.5 / 61.5 + 0.5 / 61, "c": 0.5 / 63 + 0.5 / 62}
    low, high = min(total.values()), max(total.values())
    assert got == pytest.approx({k: (v - low) / (high - low) for k, v in total.items()})
    same = rows.withColumns({"semantic": F.lit(1.0), "keyword": F.lit(1.0)})
    assert {r.fused for r in fusion.rrf(same).collect()} == {0.5} == {r.fused for r in fusion.z_sigmoid(same).collect()} == {r.fused for r in fusion.min_max_fusion(same).collect()}
    batch = rows.withColumn("q", F.lit(1)).union(rows.withColumn("q", F.lit(2)))
    assert {r.q: r.n for r in fusion.rrf(batch, by=("q",)).filter("fused = 1").groupBy("q").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 1}


def test_recency_budget(spark):
    scores = [0.75, 0.5, 0.4375, 0.25, 0.125]
    rows = spark.createDataFrame([(str(k), s) for k, s in enumerate(scores)], "note_id string, relevance double")
    for cutoff in (1, 2, 5, 9):
        for below in (0, 1, 2, 50):
            at = lambda k: scores[min(k, len(scores)) - 1]
            assert ranking.recency_budget(rows, cutoff, below).first().budget == pytest.approx(at(cutoff) - at(cutoff + below))
    assert ranking.recency_budget(rows.limit(1), 3, 3).first().budget == 0
    with pytest.raises(ValueError, match="top_k"):
        ranking.SearchParams(top_k=0)


def test_rerank_failure_keeps_fused(spark):
    rows = spark.createDataFrame([("a", 1.0, "x"), ("b", 0.5, "y")], "note_id string, fused double, body string")
    params = ranking.SearchParams(rerank_top_k=1)

    def fails(_):
        raise RuntimeError

    assert {r.reranker for r in ranking.rerank(rows, fails, params).collect()} == {None}
    assert {r.note_id: r.reranker for r in ranking.rerank(rows, lambda t: [7.0] * len(t), params).collect()} == {"a": 7.0, "b": None}
    assert ranking.rerank(rows.limit(0), fails, params).collect() == []
    # By places the reranked row has 1; by the reranker's own scores, 7.
    kept = ranking.rerank(rows, lambda t: [7.0] * len(t), params)
    for strategy, use_ranks, top in (("geometry", True, 7.0), ("multiplicative", True, 1.0), ("multiplicative", False, 7.0)):
        told = ranking.relevance(kept, ranking.SearchParams(recency_strategy=strategy, use_ranks=use_ranks)).collect()
        assert {r.note_id: (r.relevance, r.rerank_rank) for r in told} == {"a": (top, 1), "b": (0.5, None)}


def test_nearest_batch(spark):
    rows = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(6)], "vec_id int, embedding array<double>")
    got = [(r.query_id, r.vec_id) for r in dense.nearest_batch(rows, [(1, [0.0, 0.0]), (2, [4.5, 0.0])], 2).orderBy("query_id", "place").collect()]
    assert got == [(1, 0), (1, 1), (2, 4), (2, 5)]
    assert "CartesianProduct" not in dense.nearest_batch(rows, [(1, [0.0, 0.0])], 2)._jdf.queryExecution().toString()


def test_nearest_listed(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(10 * (k % 5), 1), rng.gauss(0, 1)]) for k in range(200)] + [(500, None)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    centre = dense.centroids(df, lists=6)
    listed = dense.listed(df, centre).collect()
    assert len(listed) == 200 and all(len(r.lists) == 1 for r in listed)
    exact = {(r.query_id, r.vec_id) for r in dense.nearest_blocks(df.filter("vec_id < 500"), df.filter("vec_id < 20"), 5).collect()}
    every = {(r.query_id, r.vec_id) for r in dense.nearest_listed(df, df.filter("vec_id < 20"), 5, centre, probes=6).collect()}
    some = {(r.query_id, r.vec_id) for r in dense.nearest_listed(df, df.filter("vec_id < 20"), 5, centre, probes=2).collect()}
    assert every == exact and len(some & exact) >= 90
    assert dense.nearest_listed(df.limit(0), df.limit(0), 5, dense.centroids(df.limit(0))).collect() == []


def test_link_parts_and_health(spark):
    got = spark.range(1).select(links.link_parts(F.lit("![[a#h|s]] [[ b ]] [[#c]]")).alias("l")).first().l
    assert [(x.embed, x.target, x.heading, x.alias, x.shown) for x in got] == [(True, "a", "h", "s", "s"), (False, "b", None, None, "b"), (False, "", "c", None, "c")]
    rows = spark.createDataFrame([("p", "created: 2024-01-01T00:00:00\nupdated: 2024-01-01T00:00:00Z")], "path string, frontmatter_text string")
    assert health.fix_timestamps(rows).first().after == "created: 2024-01-01T00:00:00+00:00\nupdated: 2024-01-01T00:00:00Z"
    assert health.fix_timestamps(rows, "local").first().after == "created: 2024-01-01T00:00:00\nupdated: 2024-01-01T00:00:00"


BODY = "intro line\n\n# One\n\n" + "A sentence here. " * 500 + "\n\n## Two\n- item one\n- item two\n  more\n\n```\n# not a heading\n```\n\n| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 400 + "\n### Three\n" + "word " * 700 + "\n" + "\n".join(f"- point {k} of many, as it goes" for k in range(200))


def test_sections_cover_every_line(spark):
    rows = chunking.cut("n", BODY)
    lines = BODY.split("\n")
    seen = {k for r in rows for k in range(r["line_start"], r["line_end"] + 1)}
    assert all(k + 1 in seen for k, x in enumerate(lines) if x.strip())
    assert all(r["token_count"] <= 2 * chunking.HARD for r in rows)
    assert [r["chunk_id"] for r in rows] == [f"n::s{k:03d}" for k in range(len(rows))]
    assert {r["heading"] for r in rows} == {"", "One", "Two", "Three"}
    df = chunking.sections(spark.createDataFrame([("n", BODY), ("m", None), ("o", "")], "note_id string, body string"))
    assert df.groupBy("note_id").count().collect()[0]["count"] == len(rows)
    assert [r.text for r in chunking.outline(spark.createDataFrame([("n", BODY)], "note_id string, body string")).orderBy("line").collect()] == ["One", "Two", "Three"]


def test_edits():
    assert edits.edit_note("a b a", '[{"old_text": "a", "new_text": "c", "occurrence": 2}, {"old_text": "b", "new_text": ""}]')[0] == "a  c"
    for raw, why in (('[{"old_text": "a", "new_text": "c"}]', "ambiguous"), ('[{"old_text": "z", "new_text": "c"}]', "not found"), ("[]", "element"), ('[{"old_text": "a b", "new_text": ""}, {"old_text": "b a", "new_text": ""}]', "overlap"), ('[{"old_text": "b", "new_text": "", "occurrence": true}]', "occurrence")):
        with pytest.raises(edits.EditError, match=why):
            edits.edit_note("a b a", raw)
    with pytest.raises(edits.EditError, match="changed"):
        edits.edit_note("a", '[{"old_text": "a", "new_text": "b"}]', "0" * 64)
    assert edits.set_field("---\nid: 1\n---\nx", "updated", "2") == "---\nid: 1\nupdated: 2\n---\nx"
    assert edits.add_link("`Beta` then Beta and Beta", "Beta", "Beta") == "`Beta` then [[Beta]] and Beta"
    assert edits.add_link("see [[Beta]]", "see", "Beta") == "see [[Beta]]"
    assert edits.insert_related("x\n\n## Related\n- [[A]]\n\n## End\n", ["a", "B", "b"]).count("[[") == 2
    assert edits.merge_fields({"id": 1, "aliases": ["x"]}, {"aliases": "y"}) == {"id": 1, "aliases": ["x", "y"]} and edits.merge_fields({"a": 1}, {"a": 1}) is None
    assert "No newline" in edits.diff("a", "b")


def test_providers_and_cache(spark, tmp_path):
    p = providers.Offline(4)
    rows = providers.embed(spark.createDataFrame([("x",), ("y",), ("x",)], "text string"), p).collect()
    by = {r.text: r.embedding for r in rows}
    assert math.isclose(sum(v * v for v in by["x"]), 1) and by["x"] != by["y"]
    assert providers.checked_ranks(p.rerank("q", ["a", "b"]), 2) == [0.5, 1.0]
    for bad in ([(0, 1.0)], [(0, 1.0), (0, 2.0)], [(0, float("nan")), (1, 1.0)]):
        with pytest.raises(providers.ProviderError):
            providers.checked_ranks(bad, 2)
    waits, calls = [], iter([ConnectionError(), TimeoutError(), None])

    def call():
        if (e := next(calls)) is not None:
            raise e
        return "ok"

    assert providers.retried(call, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    cache = providers.QueryCache(2)
    made = []
    for t in ("a", "b", "a", "c", "a", "b"):
        cache.get("m", t, lambda t=t: made.append(t) or [1.0])
    assert made == ["a", "b", "c", "b"]
    path = str(tmp_path / "cache.json")
    assert providers.QueryCache(2, path).get("m", "t", lambda: [0.5]) == [0.5] == providers.QueryCache(2, path).get("m", "t", lambda: [9.0])
    (tmp_path / "cache.json").write_text("broken")
    assert providers.QueryCache(2, path).rows == {}


def test_generated_summaries(spark):
    notes = spark.createDataFrame([("1", "a.md", "T", "# H\n\nbody " + "word " * 9000), ("2", "b.md", "U", "x"), ("3", "c.md", "V", "y")], "note_id string, path string, title string, body string")
    heads = spark.createDataFrame([("1", 1, "H")], "note_id string, line int, text string")
    none = spark.createDataFrame([], "note_id string, source_fingerprint string")
    due = summaries.jobs(notes, none, heads)
    assert chunking.token_count(summaries.prompt("T", "word " * 9000, ["H"])) < summaries.PROMPT_TOKENS + 20

    def chat(system, user):
        return '{"summary": " short  one "}' if "- H" in user else '{"summary": ""}' if "Title: U" in user else '{"other": 1}'

    got = {r.note_id: (r.summary, r.problem) for r in summaries.generated(due, chat, "m").collect()}
    assert got == {"1": ("short one", None), "2": (None, "empty or too long"), "3": (None, "reply has another shape")}


def test_replayed_results(spark, tmp_path):
    one = {"query": "q", "candidates": [{"note_id": "a", "path": "a.md", "excerpt": "x", "scores": {"final": 0.5}}, {"note_id": "b", "path": "b.md", "excerpt": "", "scores": {"final": 1}}]}
    for k, told in enumerate((one, {"ok": True, "result": one})):
        (tmp_path / f"{k}.json").write_text(json.dumps(told))
        assert [(r.place, r.note_id, r.final, r.query) for r in notes.read_results(spark, str(tmp_path / f"{k}.json")).orderBy("place").collect()] == [(1, "a", 0.5, "q"), (2, "b", 1.0, "q")]
    for k, told in enumerate(({"query": "q"}, {"candidates": [{"excerpt": "x", "scores": {}}]}, {"candidates": [{"scores": {"final": 1.0}}]})):
        (tmp_path / f"bad{k}.json").write_text(json.dumps(told))
        with pytest.raises(ValueError, match="bad"):
            notes.read_results(spark, str(tmp_path / f"bad{k}.json"))


REPLIES = [
    ('{"a": 1}', {"a": 1}), ("[1, 2]", None), ('[{"a": 1}]', None), ('"a"', None), ('```JSON\n{"a": [1]}\n```', {"a": [1]}), ('so: {"a": {"b": 2}} end', {"a": {"b": 2}}), ('{"a": "b\\"c', {"a": 'b"c'}),
    ('{"a": [1, {"b": "x', {"a": [1, {"b": "x"}]}), ('{"a": "open [ {', {"a": "open [ {"}), ("", None), (None, None), ("none", None), ('{"a": 1,', None), ('{"a": tru', None),
]


def test_replies():
    for raw, want in REPLIES:
        assert synthesis.parse(raw) == want, raw


def test_read_reply():
    sources = {"S0": {"note_id": "1", "path": "a.md", "title": "A", "excerpt": "x"}, "S1": {"note_id": "2", "path": "b.md"}}
    read = lambda **more: synthesis.read_reply(json.dumps({"answer": "It is so [S0].", "citations": ["S0"], "confidence": "High", "abstained": False} | more), sources, "q")
    good = read()
    assert (good["abstained"], good["confidence"], good["notes_used"], good["warnings"], good["citations"][0]["title"]) == (False, "high", ["a.md"], [], "A")
    assert read(citations=["S1", "S1", "S9", "S0"])["notes_used"] == ["b.md", "a.md"] and read(citations=["S9"])["warnings"] == ["model cited unknown key S9"]
    for more, abstained in (({"abstained": "false"}, True), ({"answer": 3}, True), ({"answer": " "}, True), ({"citations": "S0"}, False), ({"confidence": "sure"}, False)):
        told = read(**more)
        assert told["abstained"] is abstained and len(told["warnings"]) == 1, more
    assert read(confidence="sure")["confidence"] == "low"
    assert read(answer="This sentence is long enough to need a mark of its own. Short.")["warnings"] == ["1 sentence(s) lack citations"]
    assert synthesis.read_reply("no", sources)["warnings"] == ["unparseable model output"]


def test_synthesize(spark):
    rows = spark.createDataFrame([(str(k), f"n{k}.md", f"T{k}", "body " * k, "", "distilled" if k == 2 else "note", 1 / k, k) for k in (1, 2, 3)], "note_id string, path string, title string, body string, provenance string, note_type string, final double, place int")
    asked = []
    out = synthesis.synthesize(lambda system, user: asked.append(user) or '{"answer": "Yes [S1].", "citations": ["S1"], "confidence": "low", "abstained": false}', rows, "why?", most=2)
    assert out["notes_used"] == ["n2.md"] and "<S0 score=1.0000>\nTitle: T1\nPath: n1.md\nbody" in asked[0] and "<S1 provenance=distilled score=0.5000>" in asked[0] and "S2" not in asked[0]


def test_synthesis(spark):
    rows = spark.createDataFrame([("a", "Long sentence without any mark in it at all, really. Short. Marked one [S0].", False, "high"), ("b", " ", False, "low")], "id string, answer string, abstained boolean, confidence string")
    got = rows.select(F.size(synthesis.uncited(F.col("answer"))).alias("n"), synthesis.save_reason(rows).alias("why")).collect()
    assert [(r.n, r.why) for r in got] == [(1, None), (0, "low confidence")]
    name, text = synthesis.distilled_note("My Answer!", "x [S0]", [("1", "a/b.md", "B"), ("1", "a/b.md", "B"), ("2", "c.md", "C")], frozenset({"B"}))
    assert name == "my-answer.md" and text.endswith("## Sources\n\n- [[a/b]]\n- [[C]]\n")
    assert synthesis.prompt_body("one two three four", 2).strip() == "one two"


NEAR = [{"title": "Alpha", "path": "Areas/Alpha one.md"}, {"title": "Beta", "path": "Areas/B.md"}, {"title": "alpha", "path": "Areas/C.md"}, {"title": "Gamma", "path": "X/G.md"}]


def test_enrich_plan():
    note = {"title": "My note", "body": "first\nal text and [[Gamma]]", "path": None, "frontmatter": {}, "source_url": "https://x.example"}
    links = [{"target": "ALPHA", "confidence": "0.95", "anchor_text": "al text"}, {"target": "b", "confidence": 0.95, "anchor_text": "zz"}, {"target": "Gamma", "confidence": 0.99, "anchor_text": "al"}, {"target": "Beta", "confidence": True}, {"target": "Nope", "confidence": 1}, "odd"]
    related = [{"target": "Areas/C", "confidence": 0.7, "reason": "why"}, {"target": "Alpha one", "confidence": 0.8}, {"target": "Beta", "confidence": 0.5}]
    reply = {"title": "Better", "type": "Idea", "aliases": [" x ", ""], "inline_links": links, "related": related, "warnings": ["w"]}
    got = enrich.planned(json.dumps(reply), note, NEAR)
    assert got["title"] == "Better" and got["title_changed"] and got["suggested_path"] == "Areas/Better.md" and got["frontmatter_patch"] == {"type": "idea", "aliases": ["x"], "source_url": "https://x.example"}
    assert [(x["target_path"], x["occurs_at_line"]) for x in got["link_insertions"]] == [("Areas/Alpha one.md", 2)]
    assert [(x["target_path"], x["reason"]) for x in got["related_candidates"]] == [("Areas/B.md", "anchor text not found in body"), ("Areas/C.md", "why")]
    assert got["warnings"] == ["w", "dropped link with invalid confidence: Beta", "dropped link to nonexistent note: Nope"] and got["confidence"] == "medium"
    for raw in (None, "[1]", "no"):
        assert enrich.planned(raw, note, NEAR)["warnings"] == ["planner failed to produce a usable plan"]
    kept = enrich.planned(json.dumps({"title": "a/b", "type": "poem"}), note | {"path": "Inbox/old/My.md", "title": "..", "frontmatter": {"type": "idea"}}, NEAR)
    assert kept["title"] == "Untitled" and kept["suggested_path"] == "Areas/Untitled.md" and len(kept["warnings"]) == 2
    assert enrich.planned('{"title": "my NOTE!", "type": "idea"}', note | {"path": "Y/My.md", "frontmatter": {"type": "journal"}}, NEAR[3:]) | {"warnings": 0} == {
        "title": "My note", "title_changed": False, "suggested_path": "Y/My.md", "frontmatter_patch": {"source_url": "https://x.example"}, "link_insertions": [], "related_candidates": [], "warnings": 0, "confidence": "medium",
    }
    assert [enrich.confidence(x) for x in (0, "1", 1.1, "x", None, False, float("nan"))] == [0.0, 1.0, None, None, None, None, None]


def test_enrich_gather(spark):
    rows = spark.createDataFrame([(f"n{k}", f"T{k}", f"f/n{k}.md", "body", 1.0 / k, k) for k in (1, 2, 3)], "note_id string, title string, path string, body string, final double, place int")
    sections = spark.createDataFrame([("n2", "n2::s0", "Far", "far text", [9.0]), ("n2", "n2::s1", "Near", "near text", [1.0]), ("n9", "n9::s0", "No", "no", [0.0])], "note_id string, chunk_id string, heading string, text string, embedding array<double>")
    asked = []
    note = {"title": "Title", "body": "running runs", "path": "f/n3.md"}
    out = enrich.plan(lambda q: asked.append(q) or rows, lambda system, user: asked.append(user) or '{"related": [{"target": "T2", "confidence": 0.9}]}', note, sections, [0.0])
    assert asked[:3] == ["Title", "running runs", "run"] and [x["target_path"] for x in out["related_candidates"]] == ["f/n2.md"]
    assert '"excerpt_heading": "Near", "excerpt": "near text"' in asked[3] and '"path": "f/n1.md"' in asked[3] and "n3.md" not in asked[3].split("NEIGHBORS")[1]


NOTE = "note_id string, path string, title string, body string, content_hash string, updated timestamp"


def test_snapshots_and_stream(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "index")
    told = []

    def add(rows):
        spark.createDataFrame(rows, "note_id string, path string, title string, body string, content_hash string").withColumn("updated", F.current_timestamp()).coalesce(1).write.mode("append").parquet(source)
        incremental.run(spark, source, root, str(tmp_path / "cp"), lambda n, v: told.append(v)).awaitTermination()

    add([("1", "a.md", "A", "alpha", "h1"), ("2", "b.md", "B", "beta", "h2")])
    add([("1", "a.md", "A", "alpha", "h1")])
    add([("2", "b.md", "B", "beta two", "h3"), ("3", "c.md", "C", "", "h4")])
    assert told[0] and told[1] is None and told[2] and told[0] != told[2]
    now = sync.Snapshots(spark, root).read()
    assert {(r.note_id, r.content_hash) for r in now.filter("granularity = 'document'").collect()} == {("1", "h1"), ("2", "h3"), ("3", "h4")}
    assert now.filter("granularity = 'section' AND note_id = '2'").first().text.endswith("beta two")
    kept = sync.with_vectors(now, now.withColumn("embedding", F.array(F.lit(1.0))).filter("note_id = '1'"))
    assert {r.note_id for r in kept.filter("embedding IS NOT NULL").collect()} == {"1"}
    with pytest.raises(ValueError, match="model"):
        sync.Snapshots(spark, root).check(model="x")


def test_activity_stream(spark, tmp_path):
    events = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet("/root/testdata/sf0.001/events.parque[t]")
    q = incremental.activity(events).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM activity").first()[0] == 1000
