"""Pages to articles, chunks and links; names; sources."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.operators import articles as A
from lodestar.operators.ontology import Ontology
from lodestar.sources import tables as I

SITE = A.Markup("main-part", "hd", "para", "items", ("tip", "warn"), "lead", ("Legal text:",))
PAGE = """<html><body><nav><p class="para">Menu</p></nav><div id="main-part"><h1>Mend a   kettle</h1><p class="lead">When it won't boil .</p>
<ul class="items"><li><a href="#a">A</a></li><li><a href="#b">B</a></li></ul>
<h2 class="hd">First aid</h2><h3 class="hd">Cold water</h3><p class="para">Fill it. See <a href="/de-de/20002">the other kettle</a> first! Then wait.</p><p class="para">Legal text: nothing.</p>
<ol class="items"><li>Unplug it</li><li>Plug it in <a href="/de-de/20002?x=1">again</a></li></ol><h2 class="hd">Empty</h2><h2 class="hd">Noise</h2><div class="tip">It hums&nbsp;.</div><div><p class="para">Inside a wrapper</p></div><p>No class</p></div>
<time>x</time><time itemprop="datePublished">March 3, 2024</time></body></html>"""


def test_page_to_article():
    got = A.parse_page(PAGE, SITE)
    assert (got["title"], got["summary"], got["last_updated"]) == ("Mend a kettle", "When it won't boil.", "2024-03-03")
    assert [(s["heading"], s["level"], [(u["kind"], u["text"]) for u in s["units"]]) for s in got["sections"]] == [
        ("Mend a kettle", 1, [("paragraph", "When it won't boil.")]),
        ("First aid › Cold water", 3, [("paragraph", "Fill it. See the other kettle first! Then wait."), ("step", "Unplug it"), ("step", "Plug it in again")]),
        ("Noise", 2, [("note", "It hums."), ("paragraph", "Inside a wrapper")]),
    ]
    assert [(x["href"], x["anchor"], x["sentence"]) for x in got["links"]] == [("/de-de/20002", "the other kettle", "See the other kettle first!"), ("/de-de/20002?x=1", "again", "Plug it in again")]
    assert A.parse_page("<p>no title</p>") is None and A.parse_page(None) is None and A.parse_page("<h1>T</h1>") is None
    assert A.iso_date("not a date") is None


def test_links_meet_corpus_and_chunks(spark):
    other = '<div id="main-part"><h1>O</h1><p class="para">Back to <a href="/10001">kettles</a>, or <a href="/20002">here</a>, or <a href="/99999">gone</a>.</p></div>'
    pages = spark.createDataFrame([("10001", PAGE), ("20002", other), ("30003", None)], "page_id string, html string")
    arts = A.articles(pages, SITE)
    links = A.attach_chunks(A.links_in_corpus(arts, r"/(\d{5})(?:$|[?#/])"), A.chunks(arts)).collect()
    assert sorted((r["src_article"], r["dst_article"], r["anchor"], r["src_chunk_id"]) for r in links) == [("10001", "20002", "again", "10001:0:0"), ("10001", "20002", "the other kettle", "10001:0:0"), ("20002", "10001", "kettles", "20002:0:0")]


WORDS = st.lists(st.integers(1, 120), min_size=1, max_size=12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), WORDS), min_size=1, max_size=7))
def test_chunks_are_pieces_of_the_text_and_cover_it(plan):
    sections = [{"heading": f"h{i} " * n, "units": [{"text": " ".join(["w"] * k)} for k in units]} for i, (n, units) in enumerate(plan)]
    text = "\n\n".join("\n".join([s["heading"], *[u["text"] for u in s["units"]]]) for s in sections)
    got = A.chunk_sections(sections)
    covered = set()
    for _, _, _, a, b, piece in got:
        assert text[a:b] == piece
        assert A.n_tokens(piece) <= 500 or piece.count("\n") == 0
        covered |= set(range(a, b))
    assert all(text[i] == "\n" for i in set(range(len(text))) - covered)
    assert len({(s, w) for s, w, *_ in got}) == len(got)


def test_canonical_text_in_the_jvm_is_what_chunks_point_into(spark):
    arts = A.articles(spark.createDataFrame([("10001", PAGE)], "page_id string, html string"), SITE)
    text = arts.select(A.article_text(F.col("sections")).alias("t")).first()["t"]
    assert all(text[r["char_start"] : r["char_end"]] == r["text"] for r in A.chunks(arts).collect())


O = Ontology(families={"Kettle": {"aliases": ["boiler"], "patterns": [r"\bKettle\s+\d\b"]}, "Pot": {}}, macos_names={"Moss": "12", "Big Fern": "11"}, components={"lid": ["cover"], "lid lock": []}, features={"Quick Boil": []})


def test_names_in_texts(spark):
    text = "My BOILER and Kettle  2 (not kettle-like) on iOS 17.2, macOS Moss, macOS Big Fern 11.4, iOS 9 and macOS Big Fern; the cover of its lid lock. Quick boil fails, error code -42."
    r = spark.createDataFrame([(text,)], "t string").select(
        O.families_in(F.col("t")).alias("f"), O.products_in(F.col("t")).alias("p"), O.os_versions_in(F.col("t")).alias("v"), O.components_in(F.col("t")).alias("c"), O.rule_mentions(F.col("t")).alias("m"),
        O.canonical(F.lit("Component"), F.col("t"))["text"].alias("longest"), O.canonical(F.lit("OSVersion"), F.lit("the latest iOS")).alias("none"), O.canonical(F.lit("OSVersion"), F.lit("macOS Moss")).alias("moss"),
    ).first()
    assert r["f"] == ["Kettle"] and [tuple(x) for x in r["p"]] == [("Kettle", "Kettle 2")]
    assert r["v"] == ["iOS 9", "iOS 17.2", "macOS 11", "macOS 11.4", "macOS 12"] and r["c"] == ["lid", "lid lock"]
    assert r["m"]["products"] == ["Kettle 2"] and r["m"]["error_codes"] == ["error -42"] and r["m"]["os_versions"] == ["iOS 9", "iOS 17.2", "macOS 11"]
    assert r["longest"] == "lid lock" and r["none"] is None and (r["moss"]["text"], r["moss"]["major"]) == ("macOS 12", 12)


def test_tables_round_trip(spark, tmp_path):
    arts = spark.createDataFrame([("1", "u", "t", "s", ["a"], None, None, [("h", 1, [("step", "x"), ("note", "")])])], "article_id string, url string, title string, summary string, product_tags array<string>, os_versions_mentioned array<string>, last_updated string, sections array<struct<heading:string,level:bigint,units:array<struct<kind:string,text:string>>>>")
    I.write_articles(arts, f"{tmp_path}/a")
    assert I.read_articles(spark, f"{tmp_path}/a").select(*arts.columns).collect() == arts.collect()
    q = spark.createDataFrame([("q1", ["c:0:0"])], "qid string, gold_chunk_ids array<string>").select("qid", *[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "gold_chunk_ids" else F.col(f.name) for f in I.QUESTIONS.fields[1:]])
    I.write(q, f"{tmp_path}/q", "questions", "json")
    assert I.read(spark, f"{tmp_path}/q", "questions", "json").select("qid", "gold_chunk_ids").first() == ("q1", ["c:0:0"])
    for kind in ("chunks", "links", "nodes", "edges", "mentions", "verdicts"):
        none = spark.createDataFrame([], I.SCHEMAS[kind])
        I.write(none, f"{tmp_path}/{kind}", kind)
        assert I.read(spark, f"{tmp_path}/{kind}", kind).count() == 0 and I.read_or_empty(spark, f"{tmp_path}/missing", kind).columns == none.columns
    (tmp_path / "ans.json").write_text('{"qid":"q1","system":"S1","answer":{"abstained":false,"sentences":[{"text":"One.","citations":["c"]},{"text":"Two.","citations":[]}]}}\n')
    (tmp_path / "jud.json").write_text('{"qid":"q1","system":"S1","judge":{"score":0.5,"key_facts_covered":[true]}}\n')
    assert I.load_run(spark, f"{tmp_path}/ans.json", f"{tmp_path}/jud.json").first().asDict() == {"qid": "q1", "system": "S1", "text": "One. Two.", "abstained": False, "score": 0.5}
    (tmp_path / "777.html").write_text("<h1>T</h1>")
    assert I.pages_from_folder(spark, f"{tmp_path}/777.html").first()["article_id"] == "777"


def test_robots_rules_the_longest_first(spark):
    urls = spark.createDataFrame([(1, "http://x.org/a/b"), (2, "http://x.org/a/b/c"), (3, "http://x.org/"), (4, "http://x.org/z")], "id int, url string")
    rules = spark.createDataFrame([("*", "/a", False), ("*", "/a/b/c", True)], "agent string, prefix string, allow boolean")
    held = spark.createDataFrame([(4,)], "id int")
    assert {r["id"]: r["status"] for r in I.fetch_plan(urls, rules, held).collect()} == {1: "disallowed", 2: "fetch", 3: "fetch", 4: "cached"}


def test_select_corpus_and_sizes(spark):
    d = spark.createDataFrame([("10", 1.0), ("9", 1.0), ("8", 0.0), ("7", 3.0)], "article_id string, s double")
    assert [r["article_id"] for r in A.select_corpus(d, F.col("s"), 2).collect()] == ["7", "9"]
    sizes = spark.createDataFrame([(n,) for n in (5, 1, 9, 7)], "n_tokens int")
    assert tuple(A.size_summary(sizes).first()) == (4, 1, 7, 9, 22)
