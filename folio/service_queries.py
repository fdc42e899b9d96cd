"""More queries over the driver's tables: access, captures, benchmark runs, lookups and text shapes, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions import urls as U
from folio.operators import captured as K
from folio.operators import emit as M
from folio.operators import graph as G
from folio.operators import retrieve as R
from folio.plans import access as A
from folio.plans import benchmark as B
from folio.plans import escalation as E
from folio.plans import outcome as O
from folio.queries import _HOST, _HREFS, _LINES, _collapse, _extracted, _lines, _markup, _n, _q, _t, _tokens, _unescape, query

_CUT = "CASE WHEN length({x}) > {n} THEN trim(substr({x}, 1, {n})) || '…' ELSE {x} END"


def _cut_bytes(x: str, n: int) -> str:
    return f"substr({x}, 1, list_max(list_filter(range(0, {n + 1}), lambda i: strlen(substr({x}, 1, i::INTEGER)) <= {n}))::INTEGER)"


def _key(x: str) -> str:
    return f"lower({_collapse(x)})"


# Text shapes.

@query(f"""SELECT doc_id, pos, {' OR '.join(f"contains(line, '{t}')" for t in T.CODE_TOKENS)} OR regexp_matches(line, '--[A-Za-z]') OR (NOT contains(line, ' ') AND (contains(line, '_') OR regexp_matches(line, '{chr(92)}p{{Ll}}.*{chr(92)}p{{Lu}}')))
 OR {_n('line', T.SYMBOL)} - {_n('line', T.PROSE_SYMBOL)} > length(line) * 0.12::DOUBLE AS code FROM {_LINES}""")
def code_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", T.looks_like_code("line").alias("code"))


@query(f"""SELECT doc_id, CASE WHEN strlen(t) <= 400 THEN t ELSE {_cut_bytes('t', 397)} || '…' END AS excerpt FROM (SELECT doc_id, {_collapse('text')} AS t FROM documents)""")
def body_excerpts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.excerpt("text").alias("excerpt"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN props ELSE 'no object' END AS found FROM events""")
def json_answers(spark, sf_dir):
    """Objects out of answers that fence them, surround them with words, or hold none."""
    i = F.col("event_id") % 3
    said = F.when(i == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone {really}"))).when(i == 1, F.concat(F.lit("It is "), "props", F.lit(" as asked"))).otherwise("no object")
    return _t(spark, sf_dir, "events").select("event_id", T.json_within(said).alias("found"))


@query("""SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https://', ''), '^http://', ''), '[^A-Za-z0-9._-]', '-', 'g'), '-+', '-', 'g'), 1, 100) AS name,
 'm_001' || CASE WHEN e = '' THEN '.bin' ELSE e END AS media FROM (SELECT *, lower(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '(\\.[A-Za-z0-9]{1,5})$', 1)) AS e FROM pages)""")
def artifact_names(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", U.artifact_name("url").alias("name"), U.media_filename(F.lit("m_001"), F.col("url")).alias("media"))


@query(f"""SELECT doc_id, pos, CASE WHEN line = '' OR regexp_matches(line, '[:#{chr(92)}[{chr(92)}]{{}}&*!|>''"%@`,{chr(92)}n]') OR regexp_matches(line, '^[ -]') OR regexp_matches(line, '[ ]$') THEN '"' || replace(replace(line, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' ELSE line END AS yaml,
 regexp_matches(regexp_replace(line, '{chr(92)}P{{L}}', '', 'g'), '^{chr(92)}p{{Lu}}{{3,}}$') AS upper, regexp_matches(trim(line), '[.;,…]$') AND NOT regexp_matches(trim(line), '(^|[ ]){chr(92)}p{{L}}{{1,2}}{chr(92)}.$') AS closes FROM {_LINES}""")
def line_shapes(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", T.yaml_string("line").alias("yaml"), T.uppercase("line").alias("upper"), T.closes_like_prose("line").alias("closes"))


@query("""WITH p AS (SELECT doc_id, text, instr(lower(text), 'the') - 1 AS place FROM documents), s AS (SELECT *, greatest(place - 53, 0) AS a FROM p WHERE place >= 0), e AS (SELECT *, least(a + 160, length(text)) AS b FROM s)
SELECT doc_id, CASE WHEN a > 0 THEN '…' ELSE '' END || trim(substr(text, a + 1, b - a)) || CASE WHEN b < length(text) THEN '…' ELSE '' END AS snippet FROM e""")
def search_snippets(spark, sf_dir):
    return R.snippets(_t(spark, sf_dir, "documents"), "the", "text").select("doc_id", "snippet")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def event_times(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", T.written_at("ts").alias("at"))


@query("""SELECT s_suppkey, trunc(s_acctbal / 0.5::DOUBLE + 0.5::DOUBLE) * 0.5::DOUBLE AS stepped, CASE WHEN s_acctbal / 10000 >= 0.85 THEN 'high' WHEN s_acctbal / 10000 >= 0.6 THEN 'medium' ELSE 'low' END AS bucket,
 CASE WHEN s_acctbal <= 0 THEN 0 ELSE floor(s_acctbal / 3.8::DOUBLE + 0.5::DOUBLE)::BIGINT END AS tokens FROM supplier""")
def number_shapes(spark, sf_dir):
    c = F.col("s_acctbal")
    return _t(spark, sf_dir, "supplier").select("s_suppkey", T.round_to(c, 0.5).alias("stepped"), T.bucket(c / 10000).alias("bucket"), T.tokens_of_length(c).alias("tokens"))


@query(f"SELECT doc_id, regexp_matches(text, {_q(T.REFUSED)}) AS refused, regexp_matches(lower(text), 'javascript|js') AND regexp_matches(lower(text), 'enable|require|need|turn on|activate|support') AS warns FROM documents")
def label_words(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.refused("text").alias("refused"), T.noscript_warning("text").alias("warns"))


@query(f"""SELECT doc_id, rank - 1 AS rank, clause FROM (SELECT doc_id, clause, row_number() OVER (PARTITION BY doc_id ORDER BY strlen(clause) DESC, i) AS rank FROM (
 SELECT doc_id, unnest(cs) AS clause, generate_subscripts(cs, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.,;:{chr(92)}n!?—–|]'), lambda x: regexp_replace(x, {_q('^' + T.SPACE + '+|' + T.SPACE + '+$')}, '', 'g')), lambda x: strlen(x) >= 16) AS cs FROM documents)))""")
def clause_order(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.clauses("text")).alias("rank", "clause")).withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT doc_id, to_json(struct_pack(doc_id := doc_id, quality := quality, toxic := toxic))::VARCHAR AS record FROM labels""")
def json_records(spark, sf_dir):
    return _t(spark, sf_dir, "labels").select("doc_id", F.to_json(F.struct("doc_id", "quality", "toxic")).alias("record"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def hook_payloads(spark, sf_dir):
    from folio.sources.store import read_hooks

    rows = _t(spark, sf_dir, "events").select(F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"props":'), "props", F.lit("}")).alias("value"))
    return read_hooks(rows, "event_id long, props struct<k:long>").select("event_id", F.col("props.k").alias("k"))


# Access.

@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN starts_with(lower(ltrim(substr(html, 1, 512))), '<!doctype html') OR starts_with(lower(ltrim(substr(html, 1, 512))), '<html') WHEN page_id % 3 = 1 THEN true ELSE false END AS is_html FROM pages""")
def document_responses(spark, sf_dir):
    i = F.col("page_id") % 3
    return _t(spark, sf_dir, "pages").select("page_id", A.is_html(F.when(i == 1, "Text/HTML; charset=utf-8").when(i == 2, "application/json"), F.col("html")).alias("is_html"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'HTTP 403' WHEN event_id % 7 = 1 THEN 'HTTP 429 rate limited' WHEN event_id % 7 = 2 THEN 'HTTP 503' WHEN event_id % 5 = 0 THEN 'Cloudflare challenge' WHEN event_id % 7 = 3 AND event_id % 3 = 0 THEN 'DataDome' WHEN event_id % 7 = 3 AND event_id % 3 = 1 THEN 'Sucuri' END AS reason FROM events""")
def block_reasons(spark, sf_dir):
    i = F.col("event_id")
    status = F.when(i % 7 == 0, 403).when(i % 7 == 1, 429).when(i % 7 == 2, 503).when(i % 7 == 3, 404).otherwise(200)
    headers = F.create_map(F.lit("cf-mitigated"), F.when(i % 5 == 0, "Challenge"), F.lit("x-datadome"), F.when(i % 3 == 0, "p"), F.lit("x-sucuri-id"), F.when(i % 3 == 1, "q"))
    return _t(spark, sf_dir, "events").select("event_id", A.block_reason(status, headers).alias("reason"))


_ADDRESS = "((event_id * 7919 % 256)::VARCHAR || '.' || (event_id * 104729 % 256)::VARCHAR || '.' || (event_id % 256)::VARCHAR || '.' || (event_id * 31 % 256)::VARCHAR)"


def _network(net: int, bits: int) -> str:
    return f"(n >> {32 - bits}) = {net >> 32 - bits}"


@query(f"""WITH a AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN '169.254.169.254' WHEN event_id % 50 = 1 THEN '10.1.2.3' WHEN event_id % 50 = 2 THEN '172.20.0.1' WHEN event_id % 50 = 3 THEN '192.0.2.7' ELSE {_ADDRESS} END AS ip FROM events),
b AS (SELECT *, string_split(ip, '.')[1]::BIGINT * 16777216 + string_split(ip, '.')[2]::BIGINT * 65536 + string_split(ip, '.')[3]::BIGINT * 256 + string_split(ip, '.')[4]::BIGINT AS n FROM a)
SELECT event_id, ip, CASE WHEN ip IN ('{"','".join(A.METADATA)}') THEN 'cloud instance metadata endpoint' {' '.join(f"WHEN {_network(net, bits)} THEN '{name}'" for name, net, bits in A.NETWORKS)} END AS refused FROM b""")
def address_guard(spark, sf_dir):
    i = F.col("event_id")
    own = F.concat_ws(".", *[x.cast("string") for x in (i * 7919 % 256, i * 104729 % 256, i % 256, i * 31 % 256)])
    ip = F.when(i % 50 == 0, "169.254.169.254").when(i % 50 == 1, "10.1.2.3").when(i % 50 == 2, "172.20.0.1").when(i % 50 == 3, "192.0.2.7").otherwise(own)
    return _t(spark, sf_dir, "events").select("event_id", ip.alias("ip"), A.address_reason(ip).alias("refused"))


@query("""WITH v AS (SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS seen, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS hops FROM events)
SELECT event_id, CASE WHEN seen > 3 THEN 'redirect loop' WHEN hops > 9 THEN 'too many redirects' END AS refused FROM v""")
def redirect_guard(spark, sf_dir):
    return A.guarded(_t(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("event_id", "refused")


_AGENT = "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Mozilla/5.0 curl/8' WHEN 2 THEN 'Mozilla/5.0 (X11)' END"
_ACCEPT = "CASE event_id % 5 WHEN 0 THEN 'text/html, Text/Markdown;q=0.9' WHEN 1 THEN 'application/json' WHEN 2 THEN '*/*' WHEN 3 THEN 'text/x-markdown ;q=1' END"


@query(f"""WITH r AS (SELECT event_id, lower(coalesce({_AGENT}, '')) AS ua, list_transform(string_split(coalesce({_ACCEPT}, ''), ','), lambda x: lower(trim(string_split(x, ';')[1]))) AS acc FROM events)
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'not-modified' WHEN event_id % 13 = 0 THEN 'forbidden' WHEN list_contains(acc, 'application/json') THEN 'json' WHEN list_contains(acc, 'text/markdown') OR list_contains(acc, 'text/x-markdown') THEN 'markdown'
 WHEN ua = '' OR contains(ua, 'curl') OR event_id % 3 <> 0 THEN 'html' ELSE 'redirect' END AS served FROM r""")
def served_representation(spark, sf_dir):
    i = F.col("event_id")
    ua, accept = F.expr(_AGENT), F.expr(_ACCEPT)
    tag = A.etag(F.lit("sha256:0123456789abcdef0123"))
    said = A.representation(accept, ua, tag, F.when(i % 11 == 0, '"0123456789abcdef"'), i % 13 == 0, i % 3 == 0)
    return _t(spark, sf_dir, "events").select("event_id", said.alias("served"))


_ROBOTS = "'# rules' || chr(10) || 'User-agent: other' || chr(10) || 'Disallow: /' || chr(10) || 'User-Agent: *' || chr(10) || 'User-agent: Folio' || s_suppkey % 3 || chr(10) || 'Disallow: /n' || s_nationkey || ' # no' || chr(10) || 'Disallow:' || chr(10) || 'Allow: /n' || s_nationkey || '/x' || chr(10) || 'Crawl-delay: 2' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /last'"


@query("""SELECT s_suppkey, rule, allow FROM (SELECT s_suppkey, s_suppkey % 3 = 1 AS own, unnest(['/n' || s_nationkey, '/n' || s_nationkey || '/x', '/last']) AS rule, unnest([false, true, false]) AS allow FROM supplier) WHERE own = (rule <> '/last')""")
def robots_files(spark, sf_dir):
    """Rules of robots files of several groups, for one agent."""
    files = _t(spark, sf_dir, "supplier").withColumn("robots", F.expr(_ROBOTS.replace("chr(10)", "'\n'")))
    return A.robots_rules(files, "s_suppkey", "robots", "folio1")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value WHEN event_id % 4 = 1 THEN event_id % 90 + 0.5 ELSE 0 END::DOUBLE AS seconds, CASE event_id % 3 WHEN 0 THEN 'the site did not answer in time (net::ERR_TIMED_OUT)' WHEN 1 THEN 'the site''s TLS certificate was rejected (ERR_CERT_ODD at x)' ELSE 'else' END AS said FROM events""")
def retry_times(spark, sf_dir):
    i = F.col("event_id")
    header = F.when(i % 4 == 0, F.concat(F.lit(" "), F.col("value").cast("string"))).when(i % 4 == 1, "soon")
    message = F.when(i % 4 == 1, F.concat(F.lit("Rate limited. Please try again in "), (i % 90).cast("string"), F.lit(".5s"))).otherwise("no")
    error = F.when(i % 3 == 0, " net::ERR_TIMED_OUT").when(i % 3 == 1, "ERR_CERT_ODD at x ").otherwise("else")
    return _t(spark, sf_dir, "events").select("event_id", A.retry_after(header, message).alias("seconds"), A.navigation_error(error).alias("said"))


@query("""WITH t AS (SELECT doc_id, n_chars::BIGINT AS t FROM documents), r AS (SELECT *, t - greatest(t // 5, 1400) AS x FROM t), s AS (SELECT doc_id, CASE WHEN x < 1000 THEN t ELSE x END AS render FROM r)
SELECT doc_id, render, least(greatest(floor(render * 6 / 10::DOUBLE), 2000), 45000)::BIGINT AS navigation, least(greatest(floor(render * 3 / 25::DOUBLE), 400), 6000)::BIGINT AS settle, least(greatest(floor(render * 3 / 4::DOUBLE), 800), 600000)::BIGINT AS sweep, least(greatest(floor(render / 18::DOUBLE), 250), 1200)::BIGINT AS reveal FROM s""")
def time_budgets(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", *[c.cast("long").alias(k) for k, c in A.budgets(F.col("n_chars").cast("long")).items()])


@query(rf"""WITH h AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT page_id, host FROM h WHERE NOT (ends_with(host, '.example.com') OR host = 'example.com' OR host = 'm.casino-win.example' OR ends_with(host, '.m.casino-win.example'))""")
def untracked_pages(spark, sf_dir):
    blocked = spark.createDataFrame([("example.com",), ("m.casino-win.example",)], "host string")
    return A.untracked(_t(spark, sf_dir, "pages").select("page_id", U.host("url").alias("host")), F.col("host"), blocked)


@query(rf"""WITH h AS (SELECT page_id, url, {_HOST} AS host FROM pages) SELECT page_id, host = 'casino-win.example' OR ends_with(host, '.casino-win.example') OR host = 'news.example' AS listed, trim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '/') AS path FROM h""")
def host_rules(spark, sf_dir):
    rules = F.array(F.lit("*.Casino-win.example"), F.lit(" news.example "), F.lit(""))
    return _t(spark, sf_dir, "pages").select("page_id", U.host_matches(U.host("url"), rules).alias("listed"), U.path_part(U.path("url")).alias("path"))


@query(rf"""SELECT DISTINCT page_id, regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || {_unescape('href')}, '/$', '') AS url FROM {_HREFS} WHERE NOT contains({_unescape('href')}, '?') AND contains(lower({_unescape('href')}), 't')""")
def site_frontier(spark, sf_dir):
    found = _extracted(spark, sf_dir)
    linked = G.links(found).withColumn("region", G.region(F.col("landmark")))
    return R.site_links(linked, F.col("url"), "t").select("page_id", "url")


# Captures.

_RUNS = f"(SELECT doc_id AS page_id, pos AS ord, line AS text, (pos * 7 % 10) / 40.0::DOUBLE AS min_opacity, (pos * 7 % 10) / 40.0::DOUBLE + CASE WHEN doc_id % 2 = 0 AND pos % 4 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS max_opacity, pos % 11 = 0 AS same_colour, pos % 5 = 0 AS revealable FROM {_LINES})"


def _runs(spark, sf_dir):
    p = F.col("pos")
    low = (p * 7 % 10) / F.lit(40.0)
    high = low + F.when((F.col("doc_id") % 2 == 0) & (p % 4 == 0), F.lit(0.5)).otherwise(F.lit(0.0))
    return _lines(spark, sf_dir).select(F.col("doc_id").alias("page_id"), p.alias("ord"), F.col("line").alias("text"), low.alias("min_opacity"), high.alias("max_opacity"), (p % 11 == 0).alias("same_colour"), (p % 5 == 0).alias("revealable"))


@query(f"""WITH r AS (SELECT *, count(*) FILTER (WHERE max_opacity >= 0.12 AND min_opacity < 0.12) OVER (PARTITION BY page_id) >= 3 AS animates, max_opacity < 0.12 AS unseen, {_key('text')} AS k FROM {_RUNS}),
d AS (SELECT *, unseen AND (revealable OR animates) AND NOT same_colour AS declared FROM r), o AS (SELECT *, CASE WHEN same_colour THEN 'text colour matches background' WHEN unseen AND NOT declared THEN 'never reached visible opacity' END AS why FROM d),
t AS (SELECT *, coalesce(bool_or(why IS NULL AND NOT declared) OVER (PARTITION BY page_id, k), false) AS told, row_number() OVER (PARTITION BY page_id, k ORDER BY NOT declared, ord) AS turn FROM o)
SELECT page_id, ord, declared, CASE WHEN declared AND (told OR turn > 1) THEN 'declared duplicate' ELSE why END AS drop_reason FROM t""")
def visible_runs(spark, sf_dir):
    return K.kept(_runs(spark, sf_dir)).select("page_id", "ord", "declared", "drop_reason")


@query(f"""WITH o AS (SELECT page_id, sum(length(text)) FILTER (WHERE max_opacity >= 0.12 AND NOT same_colour) AS observed, sum(length(text)) FILTER (WHERE max_opacity >= 0.3) AS emitted FROM {_RUNS} GROUP BY page_id)
SELECT page_id, coalesce(observed, 0)::BIGINT AS observed, CASE WHEN coalesce(observed, 0) = 0 THEN 1.0::DOUBLE ELSE trunc(least(coalesce(emitted, 0) / observed::DOUBLE, 1.0::DOUBLE) / 0.001::DOUBLE + 0.5::DOUBLE) * 0.001::DOUBLE END AS retention FROM o""")
def graph_retention(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    emitted = runs.groupBy("page_id").agg(F.sum(F.when(F.col("max_opacity") >= 0.3, F.length("text")).otherwise(0)).alias("emitted"))
    out = emitted.join(K.observed_chars(runs), "page_id", "left")
    return out.select("page_id", F.coalesce("observed", F.lit(0)).cast("long").alias("observed"), K.retention(F.col("observed"), F.col("emitted")).alias("retention"))


_NODES = "(SELECT user_id AS page_id, event_type AS path, (event_id % 5)::VARCHAR AS text, event_id AS seq, event_id // 7 AS checkpoint, (event_id * 13 % 11) / 10.0::DOUBLE AS opacity, event_id % 3 = 0 AS visible, event_id % 2 = 0 AS same_colour, event_id % 100 AS x, event_id % 70 AS y, event_id % 30 AS w, event_id % 9 AS h FROM events)"


def _nodes(spark, sf_dir):
    i = F.col("event_id")
    return _t(spark, sf_dir, "events").select(
        F.col("user_id").alias("page_id"), F.col("event_type").alias("path"), (i % 5).cast("string").alias("text"), i.alias("seq"), F.floor(i / 7).alias("checkpoint"), ((i * 13 % 11) / F.lit(10.0)).alias("opacity"),
        (i % 3 == 0).alias("visible"), (i % 2 == 0).alias("same_colour"), (i % 100).alias("x"), (i % 70).alias("y"), (i % 30).alias("w"), (i % 9).alias("h"),
    )


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY page_id, path, text ORDER BY opacity DESC, visible DESC, checkpoint, seq) AS i FROM {_NODES})
SELECT page_id, path, text, max(opacity) AS max_opacity, min(opacity) AS min_opacity, bool_or(visible) AS ever_visible, bool_and(same_colour) AS same_colour, min(checkpoint) AS first_checkpoint, count(*) AS seen, max(x) FILTER (WHERE i = 1) AS x, max(w) FILTER (WHERE i = 1) AS w FROM r GROUP BY 1, 2, 3""")
def node_reinforcement(spark, sf_dir):
    return K.reinforced(_nodes(spark, sf_dir)).select("page_id", "path", "text", "max_opacity", "min_opacity", "ever_visible", "same_colour", "first_checkpoint", "seen", "box.x", "box.w")


@query(f"""WITH m AS (SELECT page_id, seq, CASE WHEN seq % 4 = 0 THEN path ELSE text END AS key, CASE WHEN seq % 3 = 0 THEN '' ELSE 'alt ' || seq % 10 END AS alt, same_colour AS decorative, w, h FROM {_NODES}),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, key ORDER BY w * h DESC, seq) AS i FROM m)
SELECT page_id, key, min(seq) AS seq, coalesce(arg_min(alt, seq) FILTER (WHERE alt <> ''), '') AS alt, bool_and(decorative) AS decorative, max(w) FILTER (WHERE i = 1) AS w, max(h) FILTER (WHERE i = 1) AS h FROM r GROUP BY 1, 2""")
def media_merge(spark, sf_dir):
    i = F.col("seq")
    rows = _nodes(spark, sf_dir).withColumn("src", F.when(i % 4 == 0, "").otherwise(F.col("text"))).withColumn("alt", F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("alt "), (i % 10).cast("string")))).withColumnRenamed("same_colour", "decorative")
    return K.merged_media(rows)


@query(f"""SELECT page_id, text AS kind, lower(path) AS key, arg_min(CASE WHEN seq % 2 = 0 THEN upper(path) ELSE path END, seq) AS label, bool_or(CASE WHEN seq % 3 = 0 THEN NULL ELSE seq % 5 = 0 END) AS open FROM {_NODES} GROUP BY 1, 2, 3""")
def disclosure_merge(spark, sf_dir):
    i = F.col("seq")
    rows = _nodes(spark, sf_dir).select("page_id", F.col("text").alias("kind"), F.when(i % 2 == 0, F.upper("path")).otherwise(F.col("path")).alias("label"), F.when(i % 3 == 0, None).otherwise(i % 5 == 0).alias("open"), "seq")
    return K.merged_disclosures(rows)


@query(f"SELECT page_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM {_NODES} GROUP BY 1")
def box_union(spark, sf_dir):
    return _nodes(spark, sf_dir).groupBy("page_id").agg(*K.union_box(*map(F.col, "xywh")))


@query(f"""WITH r AS (SELECT page_id, seq, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS i, count(*) OVER (PARTITION BY page_id) > 20 AS saturated FROM {_NODES}) SELECT page_id, seq, saturated FROM r WHERE i <= 20""")
def capture_capacity(spark, sf_dir):
    """A capture's bound is the feature here, and it is reported."""
    return K.capped(_nodes(spark, sf_dir), "page_id", "seq", 20).select("page_id", "seq", "saturated")


@query(f"""SELECT page_id, seq FROM (SELECT page_id, seq, sum(w) OVER (PARTITION BY page_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM {_NODES} WHERE w <= 25) WHERE run <= 300""")
def asset_budget(spark, sf_dir):
    return K.within_budget(_nodes(spark, sf_dir), "page_id", "seq", "w", 25, 300).select("page_id", "seq")


@query(f"""SELECT doc_id, pos, CASE WHEN pos % 4 = 0 THEN 'speculative' ELSE 'dom' END AS verified, regexp_matches(line, {_q(T.BIDI)}) AS bidi, regexp_matches(line, {_q(T.INVISIBLE)}) AS invisible, (regexp_matches(line, {_q(T.BIDI)})::INT + regexp_matches(line, {_q(T.INVISIBLE)})::INT + (pos % 3 = 0)::INT + (pos % 4 = 0)::INT)::INTEGER AS n_flags FROM {_LINES}""")
def block_flags(spark, sf_dir):
    p = F.col("pos")
    rows = _lines(spark, sf_dir).withColumn("flags", K.flags(F.col("line"), p % 3 == 0, p % 4 == 0))
    has = lambda name: F.array_contains("flags", name)
    return rows.select("doc_id", "pos", K.verified(p % 4 == 0, F.lit("dom")).alias("verified"), has("bidi-control-removed").alias("bidi"), has("invisible-characters-removed").alias("invisible"), F.size("flags").alias("n_flags"))


# Regions, headings, order.

_BOXES = f"(SELECT doc_id AS page_id, pos, line AS text, CASE WHEN pos % 3 = 0 THEN 'x' ELSE '' END AS href, CASE WHEN pos % 13 = 0 THEN 'aside' ELSE '' END AS landmark, CASE WHEN pos % 7 = 0 THEN 'code' ELSE 'p' END AS tag, CASE WHEN pos % 10 = 9 THEN '' ELSE 'b' || pos // 2 END AS block, pos * 40.0::DOUBLE AS y, pos * 40.0::DOUBLE + 32 AS bottom, (max(pos) OVER (PARTITION BY doc_id) + 1) * 40.0::DOUBLE AS doc_height, pos % 5 = 0 AS fixed FROM {_LINES})"


@query(f"""WITH p AS (SELECT *, landmark <> '' AS named, length(text) <= 40 AND href <> '' AND tag <> 'code' AS linked, length(text) <= 60 AS brief FROM {_BOXES}),
a AS (SELECT *, CASE WHEN named THEN landmark WHEN fixed AND brief AND bottom <= 162 THEN 'header' WHEN fixed AND brief AND y >= 738 THEN 'footer' WHEN linked AND doc_height > 900 AND bottom > greatest(doc_height - 675, doc_height * 0.75::DOUBLE) THEN 'footer' WHEN linked AND y < 108 THEN 'nav' ELSE 'main' END AS r1 FROM p),
b AS (SELECT *, CASE WHEN NOT named AND block <> '' AND bool_or(r1 = 'main') OVER (PARTITION BY page_id, block) THEN 'main' ELSE r1 END AS r2, CASE WHEN brief THEN count(*) OVER (PARTITION BY page_id, CASE WHEN brief THEN lower(text) END) ELSE 0 END AS same FROM a)
SELECT page_id, pos, CASE WHEN r2 = 'main' AND href <> '' AND length(text) <= 24 AND same >= 4 THEN 'nav' ELSE r2 END AS region, CASE WHEN same >= 3 THEN same ELSE 0 END AS repeats FROM b""")
def box_regions(spark, sf_dir):
    p = F.col("pos")
    rows = _lines(spark, sf_dir).select(
        F.col("doc_id").alias("page_id"), "pos", F.col("line").alias("text"), F.when(p % 3 == 0, "x").otherwise("").alias("href"), F.when(p % 13 == 0, "aside").otherwise("").alias("landmark"), F.when(p % 7 == 0, "code").otherwise("p").alias("tag"),
        F.when(p % 10 == 9, "").otherwise(F.concat(F.lit("b"), F.floor(p / 2).cast("string"))).alias("block"), (p * 40.0).alias("y"), (p * 40.0 + 32).alias("bottom"), ((F.max("pos").over(Window.partitionBy("doc_id")) + 1) * 40.0).alias("doc_height"), (p % 5 == 0).alias("fixed"),
    )
    return G.regions(rows).select("page_id", "pos", "region", F.col("repeats").cast("long").alias("repeats"))


@query("""WITH RECURSIVE s AS (SELECT DISTINCT l_suppkey AS k, l_quantity::DOUBLE AS s FROM lineitem WHERE l_quantity > 0),
t AS (SELECT k, max(s) AS s, 1 AS n FROM s GROUP BY k UNION ALL SELECT k, nxt, n + 1 FROM (SELECT t.k, t.n, (SELECT max(s.s) FROM s WHERE s.k = t.k AND t.s / s.s >= 1.08::DOUBLE) AS nxt FROM t WHERE t.n < 6) WHERE nxt IS NOT NULL)
SELECT k AS l_suppkey, n AS step, s AS size FROM t""")
def type_scale_steps(spark, sf_dir):
    sizes = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.col("l_quantity").cast("double")).alias("s"))
    return sizes.select("l_suppkey", F.posexplode(G.size_steps(F.col("s"))).alias("i", "size")).select("l_suppkey", (F.col("i") + 1).alias("step"), "size")


@query("""WITH RECURSIVE s AS (SELECT DISTINCT l_orderkey AS k, l_quantity::DOUBLE AS s FROM lineitem), r AS (SELECT k, min(s) AS s FROM s GROUP BY k
 UNION ALL SELECT k, nxt FROM (SELECT r.k, (SELECT min(s.s) FROM s WHERE s.k = r.k AND s.s / r.s > 1.08::DOUBLE) AS nxt FROM r) WHERE nxt IS NOT NULL),
g AS (SELECT k, s / lag(s) OVER (PARTITION BY k ORDER BY s) AS ratio FROM r), w AS (SELECT k, min(ratio) AS worst FROM g GROUP BY k)
SELECT k AS l_orderkey, CASE WHEN worst IS NULL THEN 1.0::DOUBLE ELSE least(greatest((least(worst, 10.0::DOUBLE) - 1.08::DOUBLE) / 0.32::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) END AS separation FROM w""")
def heading_separation(spark, sf_dir):
    sizes = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_quantity").cast("double")).alias("s"))
    return sizes.select("l_orderkey", G.separation(F.col("s")).alias("separation"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS q, trunc(greatest(1.0::DOUBLE - (CASE WHEN o < 0.5 THEN 0.25::DOUBLE WHEN o < 0.9 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END) - (CASE WHEN l_linenumber = 2 THEN CASE WHEN l_orderkey % 2 = 0 THEN 0.1::DOUBLE ELSE 0.15::DOUBLE END ELSE 0.0::DOUBLE END) - (CASE WHEN l_orderkey % 5 >= 4 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END) - (CASE WHEN length(l_returnflag) = 1 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END), 0.1::DOUBLE) * 1000 + 0.5)::INTEGER // 10 AS percent
 FROM (SELECT *, l_quantity / 50.0::DOUBLE AS o FROM lineitem)""")
def block_confidence(spark, sf_dir):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    score = G.confidence(F.when(n == 2, "heading").otherwise("paragraph"), F.lit(0), k % 2 == 0, k % 5, F.col("l_quantity") / F.lit(50.0), F.col("l_returnflag"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.floor(score * 100 + 0.01).cast("int").alias("percent"))


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN l_orderkey % 2 = 0 THEN 'div' ELSE 'p' END, l_orderkey % 30, l_linenumber, l_orderkey) AS place FROM lineitem""")
def path_order(spark, sf_dir):
    """Places of elements in the order of their paths, numbers compared as numbers."""
    k = F.col("l_orderkey")
    path = F.concat(F.lit("html/body/"), F.when(k % 2 == 0, "div").otherwise("p"), F.lit("["), (k % 30).cast("string"), F.lit("]/span["), F.col("l_linenumber").cast("string"), F.lit("]"))
    w = Window.partitionBy("l_suppkey").orderBy(G.path_key(path), "l_orderkey")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("place"))


# Decisions.

@query("""SELECT event_id, least(greatest(event_id % 4, 1), 2)::INTEGER AS clamped, CASE event_id % 4 WHEN 0 THEN 'fetch' WHEN 1 THEN 'render' WHEN 2 THEN 'sweep' ELSE 'recover' END AS tier, event_id % 1000 >= 400 AND event_id % 1000 > 3 * (event_id % 300) AS static FROM events""")
def tier_choices(spark, sf_dir):
    i = F.col("event_id")
    rank = (i % 4).cast("int")
    return _t(spark, sf_dir, "events").select("event_id", E.clamp(E.rank(E.tier_of(rank)), 1, 2).alias("clamped"), E.tier_of(rank).alias("tier"), E.static_preferred(i % 1000, i % 300).alias("static"))


@query(rf"""WITH s AS (SELECT page_id, length({_markup('html')}) AS chars, strlen(html) AS bytes, regexp_matches(html, '(?i)<script') AS scripts FROM pages) SELECT page_id, chars / bytes::DOUBLE AS ratio, chars < 100 AND scripts AS shell FROM s""")
def text_ratios(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").select("page_id", F.length(T.markup_text("html")).alias("chars"), F.octet_length("html").alias("bytes"), F.col("html").rlike("(?i)<script").alias("scripts"))
    return rows.select("page_id", F.coalesce(F.try_divide("chars", "bytes"), F.lit(0.0)).alias("ratio"), O.shell(F.col("chars"), F.lit(False), F.col("scripts").cast("int"), F.lit(0)).alias("shell"))


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'robots.txt disallows this path for this user agent' WHEN event_id % 11 = 0 THEN 'the server answered HTTP 401' WHEN event_id % 13 = 0 THEN 'Captcha shown' WHEN event_id % 11 = 1 THEN 'the server answered HTTP 503' WHEN event_id % 17 = 0 THEN 'the site refused this client'
 WHEN event_id % 19 = 0 THEN 'an entry screen labelled "Enter" was not passed' WHEN event_id % 4 = 0 AND event_id % 2 = 0 AND event_id % 3 <> 0 THEN 'the served document is a shell and no browser rendered it' WHEN event_id % 4 = 0 THEN 'the served document is a shell and rendering it produced no text'
 WHEN event_id % 5 = 0 THEN 'a higher tier was chosen and did not deliver, so a cheaper one was used' END AS evidence FROM events""")
def outcome_evidence(spark, sf_dir):
    i = F.col("event_id")
    http = F.when(i % 11 == 0, 401).when(i % 11 == 1, 503).otherwise(200)
    said = O.evidence(i % 9 == 0, http, F.when(i % 13 == 0, "Captcha shown").otherwise(""), i % 17 == 0, F.when(i % 19 == 0, "Enter").otherwise(""), i % 2 == 0, i % 3 == 0, i % 5 == 0, F.lit(""), i % 4)
    return _t(spark, sf_dir, "events").select("event_id", said.alias("evidence"))


@query("SELECT host, max(rank)::INTEGER AS rank FROM (SELECT user_id AS host, event_id % 4 AS rank FROM events) GROUP BY 1")
def tier_memory(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("host"), (F.col("event_id") % 4).cast("int").alias("rank"), (F.col("event_id") % 2 == 0).alias("old"))
    return R.merged_memory(rows.where("old"), rows.where("NOT old"))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 64")
def kept_jobs(spark, sf_dir):
    """The 64 jobs that a server keeps: the limit is the feature."""
    return R.evicted(_t(spark, sf_dir, "events"), "ts", "event_id").select("event_id")


@query("""WITH l AS (SELECT user_id, max_by(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY user_id) SELECT user_id, event_id FROM l WHERE event_id % 3 <> 0 AND floor(epoch(TIMESTAMP '2024-01-03 00:00:00')) - floor(epoch(ts)) <= 172800""")
def live_jobs(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3 != 0).alias("ready"))
    return R.alive(rows, "user_id", "ts", F.lit("2024-01-03 00:00:00").cast("timestamp"), 172_800).select("user_id", "event_id")


# Benchmark runs.

@query("SELECT item_id, condition FROM benchmark, (SELECT unnest(['raw', 'artifact']) AS condition)")
def answer_tasks(spark, sf_dir):
    return B.tasks(_t(spark, sf_dir, "benchmark")).select("item_id", "condition")


_ANSWERS = "(SELECT doc_id, quality, toxic, doc_id % 4 AS n_facts, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE quality * (doc_id % 3) END AS n_found, CASE WHEN toxic = 1 THEN 'It is Not in the provided text.' ELSE 'yes' END AS text FROM labels)"


@query(f"""WITH g AS (SELECT *, n_facts <> 0 AND (toxic = 1 OR n_found IS NOT NULL) AS graded FROM {_ANSWERS})
SELECT doc_id, graded, CASE WHEN NOT graded THEN NULL WHEN toxic = 1 THEN 0.0::DOUBLE ELSE trunc(n_found / n_facts::DOUBLE / 0.001::DOUBLE + 0.5::DOUBLE) * 0.001::DOUBLE END AS accuracy, CASE WHEN n_facts = 0 THEN 'no ground-truth facts supplied for this question; not scored' WHEN toxic = 1 THEN 'the answer reported the information was absent' END AS note FROM g""")
def graded_answers(spark, sf_dir):
    i = F.col("doc_id")
    rows = _t(spark, sf_dir, "labels").select("doc_id", (i % 4).alias("n_facts"), F.when(i % 7 == 0, None).otherwise(F.col("quality") * (i % 3)).alias("n_found"), F.when(F.col("toxic") == 1, "It is Not in the provided text.").otherwise("yes").alias("text"))
    return B.graded(rows).select("doc_id", "graded", "accuracy", "note")


@query("""SELECT quality, count(*) AS n, count(*) FILTER (WHERE a = b) AS agreeing, trunc(count(*) FILTER (WHERE a = b) / count(*)::DOUBLE / 0.001::DOUBLE + 0.5::DOUBLE) * 0.001::DOUBLE AS share FROM (SELECT quality, doc_id % 3 AS a, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 2 END AS b FROM labels) WHERE b IS NOT NULL GROUP BY 1""")
def grader_agreement(spark, sf_dir):
    i = F.col("doc_id")
    return B.agreement(_t(spark, sf_dir, "labels").select("quality", (i % 3).alias("a"), F.when(i % 5 == 0, None).otherwise(i % 2).alias("b")), "quality")


def _normal(x: str) -> str:
    folded = "replace(translate(" + x + ", '‘’‚‛′“”„″‐‑‒–—―−', '" + "''" * 5 + '"' * 4 + "-" * 7 + "'), '…', '...')"
    return f"lower({_collapse(folded)})"


@query(f"""WITH c AS (SELECT conv_id, text, CASE WHEN turn % 2 = 0 THEN substr(text, 3, 30) ELSE 'other words' END AS claim FROM conversations), h AS (SELECT conv_id, contains({_normal('text')}, {_normal('claim')}) AS ok FROM c)
SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE ok) AS supported, trunc(count(*) FILTER (WHERE ok) / count(*)::DOUBLE / 0.001::DOUBLE + 0.5::DOUBLE) * 0.001::DOUBLE AS fidelity FROM h GROUP BY 1""")
def claim_fidelity(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select("conv_id", F.col("text").alias("source"), F.when(F.col("turn") % 2 == 0, F.substring("text", 3, 30)).otherwise("other words").alias("claim"))
    return B.fidelity(rows, "conv_id")


@query("""WITH g AS (SELECT regexp_replace(text, '\\d[\\d.,]*', 'N', 'g') AS k, count(*) AS n, min_by(text, doc_id) AS reason FROM documents WHERE length(text) < 200 GROUP BY 1) SELECT (SELECT count(*) FROM g) AS reasons, n, trim(reason) AS reason FROM g ORDER BY n DESC, reason LIMIT 1""")
def commonest_failure(spark, sf_dir):
    groups = R.failure_groups(_t(spark, sf_dir, "documents").where(F.length("text") < 200), "text", "doc_id")
    return B.dominant_failure(groups.select(F.col("example").alias("reason"), "n"))


@query("""WITH s AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS t, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id, substr(t, 1, 2000) AS text, length(t)::BIGINT AS chars, length(t) > 2000 AS saturated, n AS n_text FROM s""")
def corpus_texts(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("seq"), F.lit("text").alias("kind"), F.col("text").alias("body"))
    return B.corpus(rows, 2000).select(F.col("page_id").alias("conv_id"), "text", "chars", "saturated", "n_text")


@query(r"""SELECT doc_id, (strlen(t) BETWEEN 8 AND 4096)::BIGINT + 1 AS literals FROM (SELECT doc_id, regexp_replace(text, '["\\\n]', ' ', 'g') AS t FROM documents)""")
def script_strings(spark, sf_dir):
    """String literals of scripts made of the texts, between comments and an escaped string."""
    plain = F.regexp_replace("text", r'["\\\n]', " ")
    body = F.concat(F.lit('// "words that are left out"\nvar a = "'), plain, F.lit("\"; /* 'these words too' */ b('it\\'s one string')"))
    found = _t(spark, sf_dir, "documents").select("doc_id", F.explode(B.script_literals(body)).alias("said"))
    return found.groupBy("doc_id").agg(F.count("*").alias("literals"))


@query("""WITH r AS (SELECT p_size, p_brand, p_type, row_number() OVER (PARTITION BY p_size ORDER BY w DESC, p_brand) AS i, w FROM (SELECT DISTINCT p_size, p_brand, '' AS p_type, (ascii(right(p_brand, 1)) * 7 % 10) / 10.0::DOUBLE AS w FROM part))
SELECT p_size, w AS lib_weight, p_brand AS library, (SELECT count(DISTINCT q.p_brand) FROM part q WHERE q.p_size = r.p_size AND ascii(right(q.p_brand, 1)) % 2 = 0)::INTEGER AS n_notes FROM r WHERE i = 1""")
def library_choice(spark, sf_dir):
    last = F.ascii(F.right("p_brand", F.lit(1)))
    parts = _t(spark, sf_dir, "part")
    specs = parts.select(F.col("p_brand").alias("name"), ((last * 7 % 10) / F.lit(10.0)).alias("weight"), F.when(last % 2 == 0, "kept").alias("note")).distinct()
    out = B.library_weights(parts.select("p_size", F.col("p_brand").alias("name")).distinct(), specs, "p_size")
    return out.select("p_size", "lib_weight", "library", F.size("notes").alias("n_notes"))


# Lookups.

@query("""WITH t AS (SELECT DISTINCT text FROM documents WHERE source = 'src0'), u AS (SELECT DISTINCT text FROM documents WHERE source = 'src1'),
d AS (SELECT 'a' AS side, text FROM (SELECT text FROM t EXCEPT SELECT text FROM u) UNION ALL SELECT 'b', text FROM (SELECT text FROM u EXCEPT SELECT text FROM t)), r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY encode(text)) AS i FROM d)
SELECT side, """ + _CUT.format(x="text", n=80) + """ AS sample FROM r WHERE i <= 10""")
def stability_samples(spark, sf_dir):
    """Ten texts a side that only one run has: the limit is the feature."""
    docs = _t(spark, sf_dir, "documents")
    return R.samples(docs.where("source = 'src0'"), docs.where("source = 'src1'"), "text")


@query("SELECT conv_id, turn, text FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND turn % 4 <> 3")
def content_by_ids(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").withColumn("verified", F.when(F.col("turn") % 4 == 3, "speculative").otherwise("dom"))
    return R.by_ids(rows, _t(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("conv_id")), "conv_id").select("conv_id", "turn", "text")


@query("""WITH s AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations) SELECT conv_id AS page_id, section::BIGINT AS section, turn FROM s WHERE section = 2 AND conv_id % 2 = 0""")
def section_content(spark, sf_dir):
    rows = G.sections(_t(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "page_id"), "page_id", "turn", F.col("role") == "user")
    wanted = rows.select("page_id", F.lit(2).cast("long").alias("section")).where("page_id % 2 = 0").distinct()
    return R.section_blocks(rows, wanted).select("page_id", "section", "turn")


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, strlen(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
w AS (SELECT conv_id, turn, i, n AS used, 0 AS page FROM r WHERE i = 1 UNION ALL SELECT r.conv_id, r.turn, r.i, CASE WHEN w.used > 0 AND w.used + r.n > 2000 THEN r.n ELSE w.used + r.n END, CASE WHEN w.used > 0 AND w.used + r.n > 2000 THEN w.page + 1 ELSE w.page END FROM w JOIN r ON r.conv_id = w.conv_id AND r.i = w.i + 1)
SELECT conv_id, turn, page FROM w""")
def content_cursor(spark, sf_dir):
    return R.content_pages(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 2000).select("conv_id", "turn", "page")


@query(f"""WITH s AS (SELECT conv_id, sum({_tokens('text')})::BIGINT AS tokens, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1) SELECT conv_id, tokens, CASE WHEN tokens <= 1500 THEN t END AS body FROM s""")
def inline_content(spark, sf_dir):
    return R.inlined(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


# Pages as whole artifacts.

@query(rf"""WITH l AS (SELECT page_id, seq, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || {_unescape('href')} AS href, {_collapse(_unescape('label'))} AS label FROM {_HREFS}),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, href, lower(label) ORDER BY seq) AS n FROM l), f AS (SELECT * FROM r WHERE n = 1)
SELECT page_id, href, label, 'a_' || lpad((row_number() OVER (PARTITION BY page_id ORDER BY seq) - 1)::VARCHAR, 3, '0') AS action_id FROM f""")
def page_actions(spark, sf_dir):
    return G.actions(_extracted(spark, sf_dir)).where("type = 'link'").select("page_id", "href", "label", "action_id")


@query()
def page_artifact(spark, sf_dir):
    """Each page as one Markdown text with front matter and all sections."""
    pages = _t(spark, sf_dir, "pages")
    return M.artifact(pages, _extracted(spark, sf_dir))


@query()
def page_summaries(spark, sf_dir):
    found = _extracted(spark, sf_dir)
    return G.titles(found, G.blocks(found))
