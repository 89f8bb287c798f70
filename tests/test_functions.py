import hashlib

from pyspark.sql import functions as F

from quillspark.functions import frontmatter, porter
from quillspark.functions import text as T


def one(spark, *cols, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(*cols).first()


def base62(n):
    out = ""
    while n:
        n, d = divmod(n, 62)
        out = T.DIGITS[d] + out
    return out or "0"


def test_hash62(spark):
    paths = [f"dir/{k}.md" for k in range(200)] + ["", "é/ü.md"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", T.hash62(F.col("p")).alias("h")).collect()
    assert all(r.h == base62(int(hashlib.md5(r.p.encode()).hexdigest()[16:], 16)) for r in got)


def test_words_and_tokens(spark):
    r = one(spark, T.normalize(F.col("a")), T.tokens(F.col("a")), T.estimate_tokens(F.col("b")), a="The  Río_9, and THE b-c!", b="one, two 日本語 x")
    assert r[0] == "the río_9 and the b c" and r[1] == ["río_9", "b", "c"] and r[2] == 7


def test_slugs_titles_dates(spark):
    r = one(spark, T.slugify(F.col("a")), T.heading_slug(F.col("a")), T.derive_title(F.col("b"), F.lit("x")), T.short_date(F.col("c")), T.short_date(F.col("d")), a="  Héllo, World! ", b="\n\ntext\n## Head \n", c="2024-01-03T05:00:00", d="no date at all")
    assert list(r) == ["h-llo-world", "héllo-world", "Head", "3 Jan 2024", "no date at"]


def test_ignore_tags_paths_previews(spark):
    r = one(spark, T.has_ignore_tag(F.col("a"), ("ignore", "a.b")), T.has_ignore_tag(F.col("b"), ("a.b",)), T.skipped_path(F.col("c")), T.skipped_path(F.col("d"), ("tmp",)), T.clean_preview(F.col("e")), a="x #A.B", b="#axb", c="a/.git/x.md", d="a/tmp.md", e="# T\n> **b** [x](u) [[N|alias]] ![i](p) `c`")
    assert list(r) == [True, False, True, False, "T b x alias i c"]


def test_timestamp_problem(spark):
    rows = [("2024-01-01T00:00:00Z", None, "offset_aware"), ("2024-01-01T00:00:00", "naive", None), ("soon", "unparseable", "unparseable"), (None, None, None), ("2024-01-01T00:00:00+02:00", None, "offset_aware")]
    got = spark.createDataFrame([(r[0],) for r in rows], "t string").select(T.timestamp_problem(F.col("t"), "offset").alias("a"), T.timestamp_problem(F.col("t"), "local").alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [r[1:] for r in rows]


def test_summary_functions(spark):
    r = one(spark, T.summary_fingerprint(1, F.col("a"), F.col("b")), T.normalize_summary(F.col("c")), T.normalize_summary(F.col("d")), a="t", b="b", c=" x\n y ", d="  ")
    assert list(r) == [hashlib.sha256("1\x1ft\x1fb".encode()).hexdigest(), "x y", None]


def test_stems():
    # Words and stems of the paper.
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope triplicate triplic formative form formalize formal electrical electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll"
    words = pairs.split()
    assert {w: porter.stem(w, extended=False) for w in words[::2]} == dict(zip(words[::2], words[1::2], strict=True))
    # Of these only "ties" has another stem by the extended rules.
    assert {w for w, x in zip(words[::2], words[1::2], strict=True) if porter.stem(w) != x} == {"ties"}
    more = "ties tie flies fli dies die died die cried cri spied spi enjoy enjoy say say by by cry cri dying die news news proceed proceed geology geolog hopefully hope normally normal possibly possibl happily happili skies sky aged age"
    words = more.split()
    assert {w: porter.stem(w) for w in words[::2]} == dict(zip(words[::2], words[1::2], strict=True))


def test_frontmatter(spark):
    raws = ["---\nid: 7\ntags: [a, ' b ']\naliases: One\ncreated: 2024-01-02\n---\n\nbody\n---\n", "plain", "---\n- list\n---\nx", "---\nbad: [\n---\nx", "---\ntags: a, b\n---\n", "---\nnever closed\n"]
    raw = F.col("raw")
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k int, raw string").withColumn("f", frontmatter.as_json(frontmatter.block(raw))).select("k", frontmatter.body(raw, F.col("f")).alias("body"), "f")
    got = rows.select("k", "body", "f", frontmatter.tags_of(F.col("f")).alias("tags"), frontmatter.aliases_of(F.col("f")).alias("aliases"), frontmatter.when_field(F.col("f"), "date", "created").alias("date")).orderBy("k").collect()
    assert got[0].body == "body\n---\n" and got[0].tags == ["a", "b"] and got[0].aliases == ["One"] and got[0].date == "2024-01-02"
    # A list is YAML without fields; a block that is no YAML stays where it is.
    assert [r.body for r in got[1:]] == ["plain", "x", raws[3], "", "---\nnever closed\n"]
    assert got[1].f == got[2].f == "{}" and got[3].f is None and got[4].tags == ["a", "b"]
