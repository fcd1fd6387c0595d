"""Queries of what comes in: sitemaps, pages, articles, chunks, links, ontology names and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import articles as A
from lodestar.operators.ontology import Ontology, merge_mentions, relevance, version_parts
from lodestar.plans.catalogue import LIST, _docs, content, query
from lodestar.sources import tables as I
from lodestar.sources.tables import table

#: The names that parts are matched against.
GOODS = Ontology(
    families={"widget": {"aliases": ["gizmo"], "patterns": [r"\b(?:red|blue)\s+(?:widget|gizmo)\b"]}, "gear": {"aliases": ["ring"], "patterns": [r"\bhot\s+gear\b"]}, "anvil": {}},
    target_families=["widget", "gear"], os_platforms={"iOS": "widget", "macOS": "gear"}, macos_names={"Sonoma": "14", "Big Sur": "11"}, dependencies=[("gear", "widget")],
    components={"bolt": ["rod"], "plate": []}, features={"cold start": ["cold"], "large print": ["large"]},
)
NOTE = "'The '||p_name||' shows error code '||(p_partkey%900+100)||'. Update it to iOS '||(p_size%18+1)||'.'||(p_partkey%5)||'; the '||p_type||' one has '||CASE p_size%3 WHEN 0 THEN 'macOS Sonoma' WHEN 1 THEN 'macOS Big Sur 11.'||(p_size%7) ELSE 'watchOS 9' END||' and costs '||p_size"


def _notes(s: SparkSession, d: str) -> DataFrame:
    """(p_partkey, note): a sentence or two about each part, the same in both engines."""
    return table(s, d, "part").select("p_partkey", "p_name", "p_size", "p_type", F.expr(NOTE).alias("note"))


N = f"n AS (SELECT p_partkey, p_name, p_size, p_type, {NOTE} AS note FROM part)"
HAS = lambda words: f"regexp_matches(note, '(?i)(^|[^\\w-])({words})($|[^\\w-])')"
FAMILIES = f"list_filter([CASE WHEN {HAS('anvil')} THEN 'anvil' END, CASE WHEN {HAS('gear|ring')} THEN 'gear' END, CASE WHEN {HAS('widget|gizmo')} THEN 'widget' END], lambda x: x IS NOT NULL)"
COMPONENTS = f"list_filter([CASE WHEN {HAS('bolt|rod')} THEN 'bolt' END, CASE WHEN {HAS('plate')} THEN 'plate' END], lambda x: x IS NOT NULL)"
FEATURES = f"list_filter([CASE WHEN {HAS('cold start|cold')} THEN 'cold start' END, CASE WHEN {HAS('large print|large')} THEN 'large print' END], lambda x: x IS NOT NULL)"
MODELS = r"list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(note,'\b(?:red|blue)\s+(?:widget|gizmo)\b'), lambda m: 'widget/'||m), list_transform(regexp_extract_all(note,'\bhot\s+gear\b'), lambda m: 'gear/'||m))))"
VERSIONS = f"list_filter(list_concat(['iOS '||(p_size%18+1)||'.'||(p_partkey%5)], [CASE p_size%3 WHEN 0 THEN 'macOS 14' WHEN 1 THEN 'macOS 11.'||(p_size%7) END], [CASE WHEN p_size%3=2 THEN 'watchOS 9' END]), lambda x: x IS NOT NULL)"
shown = lambda c: F.array_join(c, ",")


# ---- names
@query(f"WITH {N} SELECT p_partkey, array_to_string({FAMILIES},',') AS families, array_to_string({COMPONENTS},',') AS components, array_to_string({FEATURES},',') AS features FROM n")
def txt_ontology_names(s, d):
    t = F.col("note")
    return _notes(s, d).select("p_partkey", shown(GOODS.families_in(t)).alias("families"), shown(GOODS.components_in(t)).alias("components"), shown(GOODS.features_in(t)).alias("features"))


@query(f"WITH {N} SELECT p_partkey, array_to_string({MODELS},',') AS models FROM n")
def txt_products(s, d):
    return _notes(s, d).select("p_partkey", shown(F.transform(GOODS.products_in(F.col("note")), lambda p: F.concat_ws("/", p["family"], p["name"]))).alias("models"))


@query(f"WITH {N} SELECT p_partkey, array_to_string({VERSIONS},',') AS versions FROM n")
def txt_os_versions(s, d):
    return _notes(s, d).select("p_partkey", shown(GOODS.os_versions_in(F.col("note"))).alias("versions"))


@query("SELECT p_partkey, 'iOS' AS platform, (p_size%18+1)::INT AS major, (p_partkey%5)::INT AS minor, CASE WHEN p_size%2=0 THEN (p_size%9)::INT ELSE 0 END AS patch FROM part")
def txt_os_parts(s, d):
    v = F.expr("'iOS '||(p_size%18+1)||'.'||(p_partkey%5)||CASE WHEN p_size%2=0 THEN '.'||(p_size%9) ELSE '' END")
    return table(s, d, "part").select("p_partkey", version_parts(v).alias("v")).select("p_partkey", "v.*")


@query(f"WITH {N} SELECT p_partkey, CASE WHEN p_size%3=0 THEN 'OSVersion' WHEN len({FAMILIES.replace('note', 'p_name')})>0 AND len({FEATURES.replace('note', 'p_name')})=0 THEN 'Product' ELSE 'Feature' END AS kind FROM n")
def txt_requirement_kind(s, d):
    return _notes(s, d).select("p_partkey", GOODS.requirement_kind(F.when(F.col("p_size") % 3 == 0, F.lit("iOS 17.2 or later")).otherwise(F.col("p_name"))).alias("kind"))


@query(f"WITH {N} SELECT p_partkey, array_to_string(CASE WHEN len({MODELS})>0 THEN list_transform({MODELS}, lambda m: split_part(m,'/',2)) ELSE {FAMILIES} END,',') AS products, array_to_string({FEATURES},',') AS features, 'error '||(p_partkey%900+100) AS error_codes, array_to_string(({VERSIONS})[1:3],',') AS os_versions FROM n")
def ret_mentions(s, d):
    m = _notes(s, d).select("p_partkey", GOODS.rule_mentions(F.col("note")).alias("m"))
    return m.select("p_partkey", *[shown(F.col(f"m.{k}")).alias(k) for k in ("products", "features", "error_codes", "os_versions")])


@query("SELECT p_partkey, array_to_string(CASE WHEN p_type=p_brand THEN [p_name,p_type] ELSE [p_name,p_type,p_brand] END,',') AS merged FROM part")
def ret_merge_mentions(s, d):
    a, b = F.array("p_name", F.lit(" "), F.concat(F.lit(" "), F.col("p_type"))), F.array("p_type", "p_brand", "p_name", F.lit(""))
    return table(s, d, "part").select("p_partkey", shown(merge_mentions(a, b)).alias("merged"))


CANON = f"CASE WHEN len({MODELS})>0 THEN split_part(({MODELS})[1],'/',2) WHEN len({FAMILIES})=1 THEN ({FAMILIES})[1] ELSE p_name END"


@query(f"WITH {N.replace(NOTE, 'p_name')} SELECT p_partkey, {CANON} AS product, 'iOS '||(p_size%18+1) AS version, 'error '||(p_partkey%900+100) AS code, CASE WHEN len({COMPONENTS})>0 THEN ({COMPONENTS})[1] ELSE p_name END AS component FROM n")
def kg_canonical_rules(s, d):
    c = lambda label, text: GOODS.canonical(F.lit(label), text)["text"]
    n, code = F.col("p_name"), F.expr("'Error code '||(p_partkey%900+100)")
    d = table(s, d, "part").select("p_partkey", c("Product", F.concat(F.lit("the "), n, F.lit("."))).alias("product"), c("OSVersion", F.expr("'needs iOS '||(p_size%18+1)||' now'")).alias("version"), c("ErrorCode", code).alias("code"), c("Component", n).alias("component"))
    return d


# ---- text scalars
@query("SELECT o_orderkey, replace(replace(o_orderpriority,':','-'),'/','-') AS slug FROM orders")
def txt_model_slug(s, d):
    return table(s, d, "orders").select("o_orderkey", T.model_slug(F.col("o_orderpriority")).alias("slug"))


@query("SELECT o_orderkey, (o_custkey%7)::INT AS bridge, (o_custkey%5)::INT AS single FROM orders")
def txt_mix(s, d):
    mix = T.parse_mix(F.expr("'single='||(o_custkey%5)||', bridge='||(o_custkey%7)"))
    return table(s, d, "orders").select("o_orderkey", mix["bridge"].alias("bridge"), mix["single"].alias("single"))


@query("SELECT conv_id, array_to_string(list_sort(list_distinct(list(role))),',') AS articles FROM conversations GROUP BY conv_id")
def txt_question_articles(s, d):
    ids = table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.concat_ws(":", "role", "turn", F.lit("0"))).alias("chunks"))
    return ids.select("conv_id", shown(T.article_ids(F.col("chunks"))).alias("articles"))


@query("SELECT doc_id, kind FROM labels, (VALUES ('all'),('screened'),('verified')) k(kind) WHERE kind='all' OR (kind='screened' AND quality=1) OR (kind='verified' AND quality=1 AND toxic=0)")
def txt_question_filter(s, d):
    q = table(s, d, "labels").select("doc_id", (F.col("quality") == 1).alias("passed"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("verified"))
    kinds = F.explode(F.array(*[F.lit(k) for k in ("all", "screened", "verified")]))
    return q.withColumn("kind", kinds).where(T.question_kept(F.col("kind"), F.col("passed"), F.col("verified"))).select("doc_id", "kind")


@query("SELECT p_partkey, array_to_string([p_brand],',') AS kept FROM part")
def txt_citations(s, d):
    cites = F.array(F.concat(F.lit("[ "), F.col("p_brand"), F.lit("]")), F.lit("[none]"))
    return table(s, d, "part").select("p_partkey", shown(T.clean_citations(cites, F.array("p_brand", "p_type"))).alias("kept"))


@query("SELECT p_partkey, CASE WHEN p_size%2=0 THEN p_name||chr(10)||'It is '||p_type ELSE p_name||' is here' END AS text FROM part")
def txt_titled_chunk(s, d):
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("It is "), F.col("p_type"))).otherwise(F.concat(F.col("p_name"), F.lit(" is here")))
    return table(s, d, "part").select("p_partkey", A.titled(text, F.col("p_name")).alias("text"))


@query(f"WITH {N} SELECT p_partkey, strpos(lower(note), lower(p_name))-1 AS start, strpos(lower(note), lower(p_name))-1+length(p_name) AS \"end\" FROM n")
def txt_located(s, d):
    from lodestar.operators.extraction import located

    return _notes(s, d).select("p_partkey", located(F.upper("p_name"), F.col("note")).alias("x")).select("p_partkey", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"))


@query(f"WITH {N} SELECT p_partkey, CASE WHEN p_size%2=0 THEN 'Update it to '||split_part(note,'Update it to ',2) ELSE split_part(note,'. ',1)||'.' END AS sentence FROM n")
def txt_sentence_with(s, d):
    return _notes(s, d).select("p_partkey", T.sentence_with(F.col("note"), F.when(F.col("p_size") % 2 == 0, F.lit("Update it")).otherwise(F.col("p_name"))).alias("sentence"))


@query("SELECT c_custkey, lower(regexp_replace(c_mktsegment,'\\s+',' ','g'))||' customer' AS key FROM customer")
def txt_clustering_key(s, d):
    return table(s, d, "customer").select("c_custkey", T.clustering_key(F.concat(F.lit(" Your "), F.col("c_mktsegment"), F.lit("  Customer."))).alias("key"))


@query()
def txt_text_match(s, d):
    from lodestar.operators.extraction import text_match
    from lodestar.sources.storage import ship_package

    ship_package(s)
    return _notes(s, d).select("p_partkey", text_match(F.col("p_name"), F.concat(F.lit("The "), F.col("p_name"), F.lit("!"))).alias("same"), text_match(F.col("p_name"), F.col("p_type")).alias("other"))


TOPICS = LIST(T.TOPIC_WORDS)


@query(f"SELECT item_id, round(list_max([leak(1),leak(2)]),6) AS leak FROM benchmark".replace("leak(1)", "CASE WHEN len(a1)>0 THEN len(list_intersect(a1,q))/len(a1) ELSE 0.0 END").replace("leak(2)", "CASE WHEN len(a2)>0 THEN len(list_intersect(a2,q))/len(a2) ELSE 0.0 END").replace("FROM benchmark", f"FROM (SELECT item_id, {content('text')} AS q, list_filter({content('left(text,60)')}, lambda w: NOT list_contains({TOPICS},w)) AS a1, list_filter({content(chr(39) + 'app settings ' + chr(39) + '||right(text,40)')}, lambda w: NOT list_contains({TOPICS},w)) AS a2 FROM benchmark)"))
def txt_leak_of_answers(s, d):
    b = table(s, d, "benchmark")
    answers = F.array(F.substring("text", 1, 60), F.concat(F.lit("app settings "), F.right("text", F.lit(40))))
    return b.select("item_id", F.round(T.leak_of_answers(F.col("text"), answers), 6).alias("leak"))


# ---- sources
SITE = "'<urlset>'||string_agg('<url><loc> '||url||' </loc></url>','' ORDER BY page_id)||'</urlset>'"


@query("SELECT page_id, url FROM pages")
def src_sitemap(s, d):
    p = table(s, d, "pages")
    xml = p.groupBy(F.floor(F.col("page_id") / 50).alias("part")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: F.concat(F.lit("<url><loc> "), x["url"], F.lit(" </loc></url>"))), ""), F.lit("</urlset>")).alias("xml"))
    return xml.select((F.col("part") * 50).alias("base"), F.posexplode(T.sitemap_locs(F.col("xml"))).alias("pos", "url")).select((F.col("base") + F.col("pos")).alias("page_id"), "url")


@query(r"SELECT id, min(url) AS url FROM (SELECT nullif(regexp_extract(url, '/([0-9]+)(?:[?#].*)?$', 1),'')::BIGINT AS id, url FROM pages) WHERE id IS NOT NULL GROUP BY id")
def src_sitemap_index(s, d):
    p = table(s, d, "pages").select(F.nullif(F.regexp_extract("url", r"/([0-9]+)(?:[?#].*)?$", 1), F.lit("")).cast("long").alias("id"), "url")
    return p.where("id is not null").groupBy("id").agg(F.min("url").alias("url")).orderBy("id")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(url,'^https?://[^/]+/(de|fr)/') THEN 'disallowed' WHEN page_id IN (SELECT doc_id FROM labels) THEN 'cached' WHEN url LIKE '%.htm_' THEN 'failed' ELSE 'fetch' END AS status FROM pages) GROUP BY 1")
def src_fetch_plan(s, d):
    rules = s.createDataFrame([("*", "/de/", False), ("*", "/fr/", False), ("*", "/", True)], "agent string, prefix string, allow boolean")
    plan = I.fetch_plan(table(s, d, "pages").select(F.col("page_id").alias("id"), "url"), rules, table(s, d, "labels").select(F.col("doc_id").alias("id")).distinct())
    plan = plan.withColumn("status", F.when((F.col("status") == "fetch") & F.col("url").rlike(r"\.htm.$"), "failed").otherwise(F.col("status")))
    return plan.groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, 'kg/model='||replace(replace(o_clerk,':','-'),'/','-')||'/prompt=v'||(o_orderkey%3) AS path FROM (SELECT o_orderkey, o_orderpriority AS o_clerk FROM orders)")
def src_output_paths(s, d):
    return table(s, d, "orders").select("o_orderkey", I.output_path(F.lit("kg"), F.col("o_orderpriority"), F.concat(F.lit("v"), F.col("o_orderkey") % 3)).alias("path"))


@query("SELECT cache_key, count(*) AS requests, count(*)-1 AS hits FROM (SELECT sha256('{\"model\":\"m'||(turn%2)||'\",\"text\":\"'||role||'\"}') AS cache_key FROM conversations) GROUP BY 1")
def st_cache_counters(s, d):
    """Requests and hits of a cache that keeps every reply: the first request of a key is its only miss."""
    request = F.to_json(F.struct(F.concat(F.lit("m"), F.col("turn") % 2).alias("model"), F.col("role").alias("text")))
    return I.cache_counters(table(s, d, "conversations").select(I.cache_key(request).alias("cache_key")))


@query("SELECT doc_id, CASE WHEN hit THEN 'kept' ELSE 'made' END AS reply FROM (SELECT d.doc_id, l.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING(doc_id))")
def src_cache_get_put(s, d):
    asked = _docs(s, d).select(I.cache_key(F.to_json(F.struct("doc_id"))).alias("cache_key"), "doc_id")
    held = table(s, d, "labels").select("doc_id").distinct().select(I.cache_key(F.to_json(F.struct("doc_id"))).alias("cache_key"), F.lit("kept").alias("reply"), F.lit(1).cast("long").alias("seq"))
    got, missed = I.cache_get(asked, held)
    now = I.cache_put(held, missed.select("cache_key", F.lit("made").alias("reply"), F.lit(2).cast("long").alias("seq")))
    return asked.join(now.select("cache_key", "reply"), "cache_key").select("doc_id", "reply")


# ---- articles
@query(r"SELECT page_id::VARCHAR AS article_id, len(regexp_extract_all(html,'<p>')) AS n FROM pages")
def doc_articles(s, d):
    """Units of each page's article, its title being its level-1 heading; the pages' paragraphs are ``p`` elements."""
    a = A.articles(table(s, d, "pages"), ontology=GOODS)
    return a.select("article_id", F.aggregate("sections", F.lit(0).cast("long"), lambda n, x: n + F.size(x["units"])).alias("n"))


@query()
def doc_article_chunks(s, d):
    return A.chunks(A.articles(table(s, d, "pages")))


LINKED = "SELECT doc_id AS src_article, doc_id+k AS dst_article, 'See that one now.' AS sentence FROM documents, (VALUES (1),(-3)) t(k) WHERE doc_id+k IN (SELECT doc_id FROM documents)"


def _linked(s: SparkSession, d: str) -> DataFrame:
    """Articles of the documents, each linking to the next one, to the third before it twice, to a missing one and to itself."""
    docs = _docs(s, d)
    last = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("last"))
    to = lambda id: f"lpad({id}, greatest(6, length({id})), '0')"
    link = lambda id: f"'<p>See <a href=\"/en-us/'||{to(f'cast({id} as string)')}||'\">that one</a> now. Or not.</p>'"
    html = "'<html><body><div id=\"content\"><h1>T</h1>'||" + "||".join(link(x) for x in ("doc_id+1", "doc_id-3", "doc_id-3", "doc_id+last+900000", "doc_id")) + "||'<p><a href=\"#top\">up</a></p></div></body></html>'"
    return A.articles(docs.join(F.broadcast(last), F.lit(True)).select(F.expr(to("cast(doc_id as string)")).alias("page_id"), F.expr(html).alias("html")))


HREF = r"/(?:[a-z]{2}-[a-z]{2}/)?(\d{5,})(?:$|[/?#])"


@query(LINKED)
def doc_link_corpus(s, d):
    x = A.links_in_corpus(_linked(s, d), HREF)
    return x.select(F.col("src_article").cast("long").alias("src_article"), F.col("dst_article").cast("long").alias("dst_article"), "sentence")


@query(f"SELECT src_article, dst_article, printf('%06d:0:0', src_article) AS src_chunk_id FROM ({LINKED})")
def doc_link_chunks(s, d):
    a = _linked(s, d)
    x = A.attach_chunks(A.links_in_corpus(a, HREF), A.chunks(a))
    return x.select(F.col("src_article").cast("long").alias("src_article"), F.col("dst_article").cast("long").alias("dst_article"), "src_chunk_id")


@query("SELECT count(*) AS n, min(n_chars) AS min, (list_sort(list(n_chars)))[count(*)//2+1] AS median, max(n_chars) AS max, sum(n_chars)::BIGINT AS total FROM documents")
def doc_size_summary(s, d):
    return A.size_summary(_docs(s, d).select(F.col("n_chars").alias("n_tokens")))


@query(f"WITH {N} SELECT family, count(*) AS n FROM (SELECT unnest({FAMILIES}) AS family FROM n) GROUP BY 1")
def doc_family_counts(s, d):
    return _notes(s, d).select(F.explode(GOODS.families_in(F.col("note"))).alias("family")).groupBy("family").agg(F.count("*").alias("n"))


SCORE = f"CASE WHEN len(list_intersect({FAMILIES},['widget','gear']))=0 OR p_type='PROMO' THEN 0.0 ELSE CASE WHEN len(list_intersect({FAMILIES},['widget','gear']))>0 THEN 2.0 ELSE 0.5 END + CASE WHEN p_name LIKE 'old%' THEN 2.0 ELSE 0.0 END + 0.3*least(3,p_partkey%5) + CASE WHEN p_size BETWEEN 4 AND 200 THEN 1.0 ELSE 0.0 END + CASE WHEN p_partkey%2=0 THEN 0.5 ELSE 0.0 END END"


@query(f"WITH {N} SELECT article_id, round(score,6) AS score FROM (SELECT p_partkey::VARCHAR AS article_id, {SCORE} AS score FROM n) WHERE score>0 ORDER BY score DESC, article_id::BIGINT LIMIT 100")
def doc_select_corpus(s, d):
    """The 100 articles that are worth most: a top-k report."""
    n = _notes(s, d).select(F.col("p_partkey").cast("string").alias("article_id"), "*")
    families = GOODS.families_in(F.col("note"))
    score = relevance(families, families, GOODS.target_families, F.startswith("p_name", F.lit("old")), (F.col("p_partkey") % 5).cast("int"), F.col("p_size"), F.col("p_partkey") % 2 == 0, F.col("p_type") == "PROMO")
    return A.select_corpus(n, score, 100).select("article_id", F.round("score", 6).alias("score"))
