"""Links, names, outlines and stand-in embeddings against plain Python."""

import random
from urllib.parse import quote_plus, urljoin

import pytest
from pyspark.sql import functions as F

from marlstone import session
from marlstone.functions import links as L
from marlstone.functions import prompts as R
from marlstone.functions import text as T
from marlstone.operators import documents as D
from marlstone.operators import ranking, seams, vectors
from marlstone.plans.registry import queries


def test_links_equal_urljoin(spark):
    bases = ["https://a.example", "https://a.example/", "http://a.example/b/c.html?q=1#f", "https://a.example/b/c/d/"]
    links = ["/x", "x", "../x", "../../x/y", "./x", "a/../b", "../../../../x", "//c.example/z", "?q", "#f", "", "https://o.example/p/../q", "x#y", "x/", "a/./b"]
    rows = [(b, x) for b in bases for x in links]
    got = {(r.b, r.x): r.u for r in spark.createDataFrame(rows, "b string, x string").select("b", "x", L.resolved(F.col("b"), F.col("x")).alias("u")).collect()}
    for b, x in rows:
        if x in ("https://o.example/p/../q",):  # absolute addresses stay as written
            want = x
        else:
            want = urljoin(b, x)
        assert got[b, x] == want.split("#")[0].rstrip("/"), (b, x)
    assert spark.createDataFrame([(None, "x"), ("https://a.example", None)], "b string, x string").select(L.resolved(F.col("b"), F.col("x")).alias("u")).where("u is not null").count() == 0


def test_quoting(spark):
    texts = ["a b", "ü/é?&=*~-_.", "", "100%+", "ạ\n"]
    got = [r.q for r in spark.createDataFrame([(t,) for t in texts], "t string").select(L.quoted_plus(F.col("t")).alias("q")).collect()]
    assert got == [quote_plus(t) for t in texts]


def test_names(spark):
    d = spark.createDataFrame([("a", None, None), ("", "b", None), (None, None, "x\\y/c.txt"), (None, "", ""), (None, None, None)], "a string, b string, s string")
    assert [r.n for r in d.select(L.document_id(F.col("a"), F.col("b"), F.col("s"), F.lit("none")).alias("n")).collect()] == ["a", "b", "c", "none", "none"]
    t = spark.createDataFrame([("abc_1",), ("Abc",), ("1a",), ("a" * 63,), ("a" * 64,), ("a-b",), ("",)], "t string")
    assert [r.x for r in t.select(L.is_table_name(F.col("t")).alias("x")).collect()] == [True, False, False, True, False, False, False]


def test_outline_and_sections(spark):
    d = spark.createDataFrame([("how to renew a police check", "long"), ("cloud storage", "medium"), ("", "medium")], "topic string, length string")
    one, two, three = (r.o for r in d.select(D.outline(F.col("topic"), F.col("length")).alias("o")).collect())
    assert one[0] == "What Renew a Police Check Covers" and len(one) == 7 and one[-2:] == [D.EXTRA, D.CONCLUSION[3:]]
    assert two[0] == "What Cloud Storage Is" and len(two) == 6 and three[0] == "What Current Draft Update Is"
    s = spark.createDataFrame([(["1: One", "Two", " : "], ["fact"], "t")], "h array<string>, f array<string>, t string")
    got = s.select(D.drafted_sections(F.col("h"), F.col("f"), F.col("t")).alias("s")).first().s
    assert [(x.heading, x.body) for x in got] == [("One", "On t: fact"), ("Two", f"On t: {D.MISSING}")]


def test_hero_picture(spark):
    rows = ["# T\nx", "x\n# T", "no title", "# T\n![a](https://i)", ""]
    got = [r.x for r in spark.createDataFrame([(x,) for x in rows], "d string").select(D.with_hero(F.col("d"), F.lit("alt"), F.lit("u")).alias("x")).collect()]
    assert got == ["# T\n\n![alt](u)\n\nx", "x\n# T\n\n![alt](u)\n", *rows[2:]]


def test_intro(spark):
    rows = ["# T\na\n b\n## S\nc", "# T\n## S", "no title\n## S", "x\n# T\nonly", ""]
    assert [r.x for r in spark.createDataFrame([(x,) for x in rows], "d string").select(T.intro(F.col("d")).alias("x")).collect()] == ["a b", "", "", "only", ""]


def test_names_of_requests(spark):
    d = spark.createDataFrame([(" A  b ", " HR ", "LONG"), (None, None, None), ("", "", "huge")], "t string, a string, l string")
    got = [tuple(r) for r in d.select(R.tone_of_name(F.col("t")), R.audience_of_name(F.col("a")), R.length_of_name(F.col("l"))).collect()]
    assert got == [("a_b", "hr", "long"), ("clear_professional", "general audience", "medium"), ("clear_professional", "general audience", "medium")]


def test_stand_in_embeddings(spark, data):
    import hashlib

    rows = {r.chunk_id: r.embedding for r in queries()["fake_embeddings"](spark, data).collect()}
    text = {r.chunk_id: r.content for r in spark.read.parquet(f"{data}/validex_knowledge.parquet").collect()}
    for k, v in list(rows.items())[:20]:
        draw = random.Random(int(hashlib.sha1((text[k] or "").encode()).hexdigest()[:16], 16))
        assert v == [draw.uniform(-1.0, 1.0) for _ in range(seams.FAKE_SIZE)]


def test_drafts_of_topics(spark, data):
    for r in queries()["drafts_of_topics"](spark, data).collect():
        assert len(r.sections) == 6 and r.draft.startswith("# ") and r.draft.count("\n## ") == 6 and 1 <= len(r.sources) <= 6


def test_earlier_near_duplicates_equal_brute_force(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, r.choice("gh"), " ".join(r.sample(words, r.choice([3, 9, 10])))) for i in range(60)] + [(90, None, "w1"), (91, "g", None), (92, "g", "")]
    got = {x.k: x.earlier for x in ranking.earlier_near_duplicate(spark.createDataFrame(rows, "k int, g string, t string"), key="k", within="g", text="t", above=0.8).collect()}
    sets = {k: (g, set(t.split())) for k, g, t in rows if g and t}
    for k, _, _ in rows:
        near = [j for j in sets if j < k and k in sets and sets[j][0] == sets[k][0] and len(sets[j][1] & sets[k][1]) > 0.8 * max(len(sets[j][1]), len(sets[k][1]))]
        assert got[k] == (min(near) if near else None)


def test_clusters_need_a_shared_folder():
    class Context:
        master = "spark://x"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_plugs(spark):
    df = spark.createDataFrame([(1, "ab", 1), (2, None, 2), (3, "abc", 3)], "k int, text string, score int")
    got = {r.k: (r.n, r.score) for r in seams.plugged(df, F.col("text"), lambda xs: [len(x) for x in xs], "bigint", "n").collect()}
    assert got == {1: (2, 1), 2: (0, 2), 3: (3, 3)}
    assert {(r.k, r.kept) for r in seams.judged(df.drop("score"), "text", lambda xs: [float(3 * len(x)) for x in xs]).collect()} == {(1, True), (2, False), (3, True)}
    assert {r.provider for r in seams.embedded(df, "text").collect()} == {None} and seams.embedded(df.where("false"), "text", allow_fake=True).count() == 0
    d = spark.createDataFrame([("a", [1.0, 2.0]), ("bb", [3.0, 4.0])], "t string, v array<double>")
    new = {r.t: (r.v, r.status) for r in seams.refreshed(d, "t", "v", 2, lambda xs: [[0.5] * (1 + len(x)) for x in xs]).collect()}
    assert new == {"a": ([0.5, 0.5], "ok"), "bb": ([3.0, 4.0], "dimension_mismatch")}
    assert {r.status for r in seams.refreshed(d, "t", "v", 2, None).collect()} == {"skipped"}


def test_search_and_writers(spark):
    q = spark.createDataFrame([("x",), ("y",)], "query string")
    assert seams.searched(spark, q).count() == 0
    found = seams.searched(spark, q, lambda qs: [[(f"t{i}", None, f"s  {i}") for i in range(5)] if s == "x" else [] for s in qs])
    shown = seams.shown_results(found, "query", "title").collect()
    assert [(r.query, r.text) for r in shown] == [("x", "1. t0 (n/a): s 0\n2. t1 (n/a): s 1\n3. t2 (n/a): s 2")]
    writers = [("agent", lambda xs: [None for _ in xs]), ("direct", lambda xs: ["d" if x == "x" else "" for x in xs])]
    got = {r["query"]: (r.draft, r.path) for r in seams.written_drafts(q, "query", F.lit("own"), writers).collect()}
    assert got == {"x": ("d", "direct"), "y": ("own", "template")}
    assert {(r.draft, r.path) for r in seams.written_drafts(q, "query", F.lit("own")).collect()} == {("own", "template")}


def test_revision_ends(spark):
    d = spark.createDataFrame([("a",), ("aaa",), ("aaaaaaaa",)], "draft string")
    review = lambda x: x.withColumn("feedback", F.when(F.length("draft") > 2, "shorter"))
    rewrite = lambda x: x.withColumn("draft", F.expr("substr(draft, 2)"))
    assert {(r.draft, r.revisions) for r in seams.revised(d, review, rewrite).collect()} == {("a", 0), ("aa", 1), ("aaaaa", 3)}


def test_nearest_in_several_blocks(spark, data, monkeypatch):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    ask = lambda: sorted(map(tuple, vectors.nearest(e, e.where("vec_id % 50 = 0"), key="vec_id", vector="embedding", k=3).collect()))
    whole = ask()
    monkeypatch.setattr(vectors, "BLOCK", 3)
    assert ask() == whole and len(whole) == 3 * e.where("vec_id % 50 = 0").count()
    assert vectors.nearest(e, e.where("false"), key="vec_id", vector="embedding", k=3).count() == 0


def test_pictures_of_edits(spark):
    sec = [("Context  from previous draft", "b", "u0"), ("A", "b", "u1"), ("B", "b", "u2")]
    draft = "# T\n![a](u0)\n![b](u1)\ntext ![c](u2)\n ![d](u2) \n![e](u1)"
    rows = [(sec, draft, n) for n in (0, 1, 2, None)]
    d = spark.createDataFrame(rows, "s array<struct<heading:string,body:string,image_url:string>>, d string, n int")
    p = d.select("n", "d", D.limited_pictures(F.col("s"), F.col("n")).alias("s"))
    got = {r.n: ([x.image_url for x in r.s], r.o) for r in p.select("n", "s", D.allowed_images(F.col("d"), F.col("n"), F.transform("s", lambda x: x["image_url"])).alias("o")).collect()}
    assert got[0] == (["", "", ""], "# T\ntext ![c](u2)") and got[1] == (["", "u1", ""], "# T\n![b](u1)\ntext ![c](u2)")
    assert got[2] == (["", "u1", "u2"], "# T\n![b](u1)\ntext ![c](u2)\n ![d](u2)") and got[None] == (["u0", "u1", "u2"], draft)
