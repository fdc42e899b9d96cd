"""Who may read what, and in which form: responses, addresses, robots rules, representations, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tokens of automated readers, headers of protections, networks that aren't public, errors of navigation.
AGENTS = ("claude", "anthropic", "gptbot", "chatgpt", "openai", "perplexity", "bingbot", "google-extended", "cohere", "bytespider", "ccbot", "applebot-extended", "curl", "wget", "httpie", "python-requests", "go-http-client", "node-fetch", "axios", "libwww-perl")
PROTECTIONS = (("x-datadome", "DataDome"), ("x-iinfo", "Imperva Incapsula"), ("x-sucuri-id", "Sucuri"), ("x-kasada-classification", "Kasada"))
METADATA = ("169.254.169.254", "169.254.170.2", "100.100.100.200", "192.0.0.192")
NETWORKS = (
    ("loopback address", 127 << 24, 8), ("unspecified address", 0, 32), ("link-local address", 169 << 24 | 254 << 16, 16), ("multicast address", 224 << 24, 4), ("private address", 10 << 24, 8),
    ("private address", 172 << 24 | 16 << 16, 12), ("private address", 192 << 24 | 168 << 16, 16), ("carrier-grade NAT range", 100 << 24 | 64 << 16, 10), ("IETF protocol assignment range", 192 << 24, 24),
    ("documentation range", 192 << 24 | 2 << 8, 24), ("benchmarking range", 198 << 24 | 18 << 16, 15), ("documentation range", 198 << 24 | 51 << 16 | 100 << 8, 24), ("documentation range", 203 << 24 | 113 << 8, 24), ("reserved range", 240 << 24, 4),
)
NAVIGATION = (
    ("ERR_CERT_COMMON_NAME_INVALID", "the site's TLS certificate is issued for a different hostname"), ("ERR_CERT_AUTHORITY_INVALID", "the site's TLS certificate is not signed by a recognised authority"),
    ("ERR_CERT_DATE_INVALID", "the site's TLS certificate has expired or is not yet valid"), ("ERR_CERT_", "the site's TLS certificate was rejected"), ("ERR_CONNECTION_RESET", "the site closed the connection without answering"),
    ("ERR_CONNECTION_REFUSED", "the site refused the connection"), ("ERR_HTTP2_PROTOCOL_ERROR", "the site broke the HTTP/2 connection; it may be refusing clients it does not recognise"),
    ("ERR_NAME_NOT_RESOLVED", "the browser could not resolve this hostname"), ("ERR_TIMED_OUT", "the site did not answer in time"), ("ERR_TOO_MANY_REDIRECTS", "the site redirected in a loop"),
)
REDIRECTS, REPEATS = 8, 3


def is_html(content_type: Column, body: Column) -> Column:
    """Whether a response is a document: by its type, or without one by how its first 512 characters begin."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    head = F.lower(F.ltrim(F.substring(body, 1, 512), F.lit(" \t\r\n")))
    return kind.contains("text/html") | kind.contains("application/xhtml") | (kind == "") & (head.startswith("<!doctype html") | head.startswith("<html"))


def block_reason(status: Column, headers: Column) -> Column:
    """Why a response refuses this client, null if it doesn't; headers is a map with names in lower case."""
    out = F.when(status == 403, "HTTP 403").when(status == 429, "HTTP 429 rate limited").when(status == 503, "HTTP 503")
    out = out.when(F.lower(F.coalesce(headers["cf-mitigated"], F.lit(""))).contains("challenge"), "Cloudflare challenge")
    for key, name in PROTECTIONS:
        out = out.when((status >= 400) & (F.coalesce(headers[key], F.lit("")) != ""), name)
    return out


def agent(user_agent: Column) -> Column:
    """Whether a reader is automated: it says nothing of itself or one of the tokens."""
    said = F.lower(F.coalesce(user_agent, F.lit("")))
    return (said == "") | said.rlike("|".join(AGENTS))


def accepts(accept: Column, kind: str) -> Column:
    """Whether a type is named; a wildcard names none."""
    return F.exists(F.split(F.coalesce(accept, F.lit("")), ","), lambda x: F.lower(F.trim(F.substring_index(x, ";", 1))) == kind)


def representation(accept: Column, user_agent: Column, etag: Column, match: Column, private: Column, redirect: Column) -> Column:
    """What a request for an artifact gets."""
    return (
        F.when(match == etag, "not-modified").when(private, "forbidden").when(accepts(accept, "application/json"), "json").when(accepts(accept, "text/markdown") | accepts(accept, "text/x-markdown"), "markdown")
        .when(agent(user_agent) | ~redirect, "html").otherwise("redirect")
    )


def etag(content_hash: Column) -> Column:
    return F.concat(F.lit('"'), F.substring(F.regexp_replace(content_hash, "^sha256:", ""), 1, 16), F.lit('"'))


def address_reason(ip: Column) -> Column:
    """Why a literal IPv4 address may not be fetched, null if it may."""
    part = lambda i: F.element_at(F.split(ip, r"\."), i).cast("long")
    n = part(1) * (1 << 24) + part(2) * (1 << 16) + part(3) * 256 + part(4)
    out = F.when(ip.isin(*METADATA), "cloud instance metadata endpoint")
    for name, net, bits in NETWORKS:
        out = out.when(F.shiftright(n, 32 - bits) == net >> 32 - bits, name)
    return out


def guarded(visits: DataFrame, page: str, order: str, url: str) -> DataFrame:
    """visits with refused: the fourth visit of an address by a page is a loop, the tenth hop one too many."""
    w = Window.partitionBy(page).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.count("*").over(Window.partitionBy(page, url).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return visits.withColumn("refused", F.when(seen > REPEATS, "redirect loop").when(F.count("*").over(w) > REDIRECTS + 1, "too many redirects"))


def robots_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, field, value, grp of each line that says something: agents in a row share a group of rules."""
    rows = files.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    line = F.trim(F.regexp_replace(F.substring_index("line", "#", 1), r"[\t\r]", " "))
    rows = rows.withColumn("line", line).where(F.col("line").contains(":"))
    rows = rows.select(key, "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    rows = rows.where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    w = Window.partitionBy(key).orderBy("pos")
    new = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    rows = rows.withColumn("grp", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("grp > 0")


def robots_rules(files: DataFrame, key: str, text: str, agent_name: str) -> DataFrame:
    """key, rule, allow of the group that is for this agent: the first that names it, else the last for all."""
    rows = robots_lines(files, key, text)
    named = F.lower("value") == agent_name.lower()
    groups = rows.where("field = 'user-agent'").groupBy(key).agg(F.min(F.when(named, F.col("grp"))).alias("own"), F.max(F.when(F.col("value") == "*", F.col("grp"))).alias("every"))
    rules = rows.where("field = 'allow' OR field = 'disallow' AND value != ''").join(groups, key)
    return rules.where(F.col("grp") == F.coalesce("own", "every")).select(key, F.col("value").alias("rule"), (F.col("field") == "allow").alias("allow"))


def retry_after(header: Column, message: Column) -> Column:
    """Seconds to wait: the header's, else those that the message names, else 0."""
    said = F.regexp_extract(message, r"(?i)try again in ([0-9.]+)\s*s", 1)
    ok = lambda c: F.when(c >= 0, c)
    return F.coalesce(ok(F.trim(header).try_cast("double")), ok(said.try_cast("double")), F.lit(0.0))


def navigation_error(message: Column) -> Column:
    """A plain reason before the browser's own message; others stay as they are."""
    out = F
    for code, plain in NAVIGATION:
        out = out.when(message.contains(code), F.concat(F.lit(plain + " ("), F.trim(message), F.lit(")")))
    return out.otherwise(message)


def budgets(total: Column) -> dict[str, Column]:
    """Parts in milliseconds of a time budget: what rendering may take, and its allowances."""
    reserve = F.greatest(F.floor(total / 5), F.lit(1400))
    render = F.when(total - reserve < 1000, total).otherwise(total - reserve)
    part = lambda num, den, low, high: F.least(F.greatest(F.floor(render * num / den), F.lit(low)), F.lit(high))
    return {"render": render, "navigation": part(6, 10, 2000, 45_000), "settle": part(3, 25, 400, 6000), "sweep": part(3, 4, 800, 600_000), "reveal": part(1, 18, 250, 1200)}


def untracked(requests: DataFrame, host: str, blocked: DataFrame) -> DataFrame:
    """requests whose host isn't, and isn't under, a host of blocked (host): each host's suffixes meet the list by equality."""
    rows = requests.withColumn("__h", F.lower(host))
    labels = F.split("__h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hit = rows.select("__h").distinct().select("__h", F.explode(suffixes).alias("host")).join(blocked.select(F.lower("host").alias("host")), "host", "left_semi").select("__h").distinct()
    return rows.join(hit, "__h", "left_anti").drop("__h")
