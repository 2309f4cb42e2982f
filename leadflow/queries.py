"""The queries of the core operators over the test tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import extract as ex
from .functions import lexicon as lx
from .functions import text as tx
from .operators import candidates, evidence, keys, limiter, ordering, querygen, replies, shapes
from .plans.run import new_leads
from .sources.archive import with_defaults
from .sources.frames import as_frame, split_frames
from .sources.tables import table

HOST = "instagram.example"

# ---- SQL pieces -------------------------------------------------------------------------------

_WS = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def s_handle(x: str) -> str:
    text = rf"regexp_replace(lower(regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')), '^@+|/+$', '', 'g')"
    inside = rf"regexp_extract({text}, 'instagram\.example/([a-z0-9._]+)', 1)"
    cut = f"regexp_extract(CASE WHEN {inside} <> '' THEN {inside} ELSE {text} END, '^[^?/]*', 0)"
    bare = f"regexp_replace({cut}, '[^a-z0-9._]', '', 'g')"
    return f"(CASE WHEN {bare} NOT IN ('', 'p', 'reel', 'stories') THEN {bare} END)"


def s_host(u: str) -> str:
    text = rf"regexp_replace({u}, '[\t\r\n]', '', 'g')"
    full = f"CASE WHEN starts_with({text}, 'http') THEN {text} ELSE 'https://' || {text} END"
    authority = rf"regexp_extract({full}, '^https?:[/\\]*([^/?#\\]*)', 1)"
    host = f"lower(regexp_replace(regexp_replace({authority}, '^.*@', ''), ':[0-9]*$', ''))"
    return rf"(CASE WHEN {u} <> '' AND {host} <> '' AND NOT regexp_matches({host}, '[\x00-\x20:<>@\[\]^|%\x7f]') THEN regexp_replace({host}, '^www\.', '') END)"


def s_key(n: str) -> str:
    return rf"nullif(trim(regexp_replace(lower({n}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), '')"


def s_distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


BLOBS = """blobs AS (
  SELECT *, coalesce(title, '') || chr(10) || coalesce(snippet, '') || chr(10) || coalesce(url, '') AS blob FROM search_result)"""
_FOUND = rf"list_transform(regexp_extract_all(blob, '(?i)instagram\.example/([A-Za-z0-9._]+)', 1), lambda h: {s_handle('h')})"
_OWN = rf"CASE WHEN regexp_matches(coalesce(url, ''), '(?i)instagram\.example') THEN {s_handle('url')} END"
_NAMED = s_handle(r"nullif(regexp_extract(blob, '\(@([A-Za-z0-9._]{2,30})\)', 1), '')")
_BLOCKED = ", ".join(map(q, lx.BLOCKED_HANDLES))
_SITES = rf"""list_filter(list_transform(regexp_extract_all(blob, '(?i)https?://[^{_WS})]+'), lambda u: regexp_replace(u, '[.,]+$', '')),
    lambda u: NOT regexp_matches(u, '(?i)instagram\.example|facebook\.com|twitter\.com|youtube\.com|t\.me'))"""
_TELEGRAM = rf"""coalesce(nullif(regexp_extract(blob, '(?i)(?:t\.me/|telegram\.me/)[A-Za-z0-9_]{{3,}}', 0), ''),
    nullif(regexp_extract(blob, 'تلگرام[:{_WS}]+@?[A-Za-z0-9_]{{3,}}', 0), ''))"""
_WHATSAPP = rf"""coalesce(nullif(regexp_extract(blob, '(?i)(?:wa\.me/|whatsapp)[^{_WS}]*', 0), ''), CASE WHEN contains(blob, 'واتساپ') THEN 'whatsapp' END)"""
EXTRACTED = f"""{BLOBS},
listed AS (SELECT *, list_filter({_FOUND} || [{_OWN}, {_NAMED}], lambda h: h IS NOT NULL AND h NOT IN ({_BLOCKED})) AS hs, {_SITES} AS websites, {_TELEGRAM} AS telegram, {_WHATSAPP} AS whatsapp FROM blobs),
handled AS (SELECT *, {s_distinct('hs')} AS handles, list_transform(websites, lambda w: 'web:' || coalesce({s_host('w')}, w)) AS ws FROM listed),
extracted AS (SELECT *, CASE WHEN len(handles) > 0 THEN handles WHEN len(websites) > 0 THEN {s_distinct('ws')} ELSE ['url:' || coalesce(url, '')] END AS keys FROM handled)"""
_NAME = rf"nullif(regexp_replace(regexp_replace(coalesce(title, ''), '[{_WS}]*[|\-\x{{2013}}].*$', ''), '^[{_WS}]+|[{_WS}]+$', '', 'g'), '')"
_SITE = rf"coalesce(websites[1], CASE WHEN {s_host('url')} IS NOT NULL AND NOT regexp_matches(url, '(?i)instagram\.example') THEN url END)"
RESOLVED = f"""{EXTRACTED},
flat AS (SELECT request_id, result_idx, unnest(range(0, len(keys))) AS key_pos, unnest(keys) AS key, {_NAME} AS business_name, nullif(snippet, '') AS bio, {_SITE} AS website, websites[1] AS listed_site, telegram, whatsapp FROM extracted),
grp AS (
  SELECT request_id, key, min(row(result_idx, key_pos)) AS seat, first(business_name ORDER BY result_idx, key_pos) AS business_name, first(bio ORDER BY result_idx, key_pos) AS bio,
    first(telegram ORDER BY result_idx, key_pos) AS telegram, first(whatsapp ORDER BY result_idx, key_pos) AS whatsapp,
    coalesce(first(website ORDER BY result_idx, key_pos), first(listed_site ORDER BY result_idx, key_pos) FILTER (WHERE listed_site IS NOT NULL)) AS website, count(*) AS results,
    CASE WHEN NOT regexp_matches(key, '^(?:web|url):') THEN key END AS username FROM flat GROUP BY request_id, key),
homes AS (SELECT *, coalesce(CASE WHEN {s_host('website')} <> '{HOST}' THEN 'site:' || {s_host('website')} END, 'key:' || key) AS cluster FROM grp),
resolved AS (
  SELECT request_id, cluster, min(seat) AS seat, first(username ORDER BY seat) FILTER (WHERE username IS NOT NULL) AS username, first(business_name ORDER BY seat) AS business_name, first(bio ORDER BY seat) AS bio,
    first(website ORDER BY seat) FILTER (WHERE website IS NOT NULL) AS website, first(telegram ORDER BY seat) FILTER (WHERE telegram IS NOT NULL) AS telegram,
    first(whatsapp ORDER BY seat) FILTER (WHERE whatsapp IS NOT NULL) AS whatsapp, count(*) AS keys, CAST(sum(results) AS BIGINT) AS results FROM homes GROUP BY request_id, cluster)"""


def s_shop_keys(name: str, source: str, columns: str) -> str:
    city = "nullif(trim(lower(city)), '')"
    return f"""{name} AS (SELECT {columns}, {s_handle("coalesce(username, instagram_url)")} AS kh, CASE WHEN {s_host('website')} <> '{HOST}' THEN {s_host('website')} END AS kw,
    CASE WHEN {s_key('business_name')} IS NOT NULL AND {city} IS NOT NULL THEN {s_key('business_name')} || chr(31) || {city} END AS kn FROM {source})"""


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


# ---- scalars ----------------------------------------------------------------------------------


@query("norm_handle", f"SELECT lead_id, {s_handle('username')} AS handle, {s_handle('instagram_url')} AS profile_handle, 'https://www.{HOST}/' || {s_handle('coalesce(username, instagram_url)')} AS profile FROM lead")
def norm_handle(spark: SparkSession, root: str) -> DataFrame:
    either = F.coalesce("username", "instagram_url")
    return table(spark, root, "lead").select("lead_id", tx.norm_handle("username", HOST).alias("handle"), tx.norm_handle("instagram_url", HOST).alias("profile_handle"), tx.profile_url(either, HOST).alias("profile"))


@query("host_of_results", f"SELECT result_idx, {s_host('url')} AS host, coalesce({s_host('url')}, 'unknown') AS source_id FROM search_result")
def host_of_results(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "search_result").select("result_idx", tx.host_of("url").alias("host"), tx.source_id("url").alias("source_id"))


@query("host_of_leads", f"SELECT lead_id, {s_host('website')} AS host FROM lead")
def host_of_leads(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lead").select("lead_id", tx.host_of("website").alias("host"))


@query("business_key", f"SELECT lead_id, {s_key('business_name')} AS name_key FROM lead")
def business_key(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lead").select("lead_id", tx.business_key("business_name").alias("name_key"))


_ANY = lambda words: "|".join(words)


@query("text_flags", f"""WITH {BLOBS} SELECT result_idx, regexp_matches(blob, '[\\x{{0600}}-\\x{{06FF}}]') AS persian, regexp_matches(lower(blob), {q(_ANY(lx.CITIES))}) AS city,
  regexp_matches(lower(blob), {q(_ANY(lx.ABROAD))}) AS abroad, regexp_matches(regexp_replace(blob, '[\\s\\x{{00A0}}-]', '', 'g'), {q(lx.PHONE)}) AS phone,
  regexp_matches(blob, '(?i)تومان|ریال|toman|rial|irt(?:[^A-Za-z0-9_]|$)') AS currency FROM blobs""")
def text_flags(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "search_result").withColumn("blob", ex.text_blob())
    return rows.select("result_idx", tx.has_persian("blob").alias("persian"), tx.mentions_city("blob").alias("city"), tx.mentions_abroad("blob").alias("abroad"), tx.has_phone("blob").alias("phone"), tx.has_currency("blob").alias("currency"))


@query("city_mentioned", "SELECT result_idx, coalesce(city <> '' AND contains(lower(coalesce(title, '') || chr(10) || coalesce(snippet, '')), lower(city)), false) AS mentioned FROM search_result JOIN search_request USING (request_id)")
def city_mentioned(spark: SparkSession, root: str) -> DataFrame:
    requests = table(spark, root, "search_request").select("request_id", "city")
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    return table(spark, root, "search_result").join(requests, "request_id").select("result_idx", tx.mentions(text, "city").alias("mentioned"))


@query("redact_errors", r"SELECT o_orderkey, left(regexp_replace('call ' || o_orderkey || ' failed: key sk-' || o_custkey || 'Ab, ' || repeat(o_orderpriority || ' ', 40), 'sk-[a-zA-Z0-9]+', '[redacted]', 'g'), 300) AS message FROM orders")
def redact_errors(spark: SparkSession, root: str) -> DataFrame:
    text = F.concat(F.lit("call "), F.col("o_orderkey").cast("string"), F.lit(" failed: key sk-"), F.col("o_custkey").cast("string"), F.lit("Ab, "), F.repeat(F.concat("o_orderpriority", F.lit(" ")), F.lit(40)))
    return table(spark, root, "orders").select("o_orderkey", tx.redacted(text).alias("message"))


@query("fetchable", rf"""SELECT lead_id, regexp_matches(website, '(?i)^https?://') AND NOT coalesce({s_host('lower(website)')} IN ('localhost', 'metadata.google.internal')
  OR regexp_matches({s_host('lower(website)')}, '\.local$|^(?:::1$|127\.|10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)'), true) AS fetchable FROM lead WHERE website IS NOT NULL""")
def fetchable(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lead").where("website is not null").select("lead_id", tx.is_fetchable("website").alias("fetchable"))


# ---- results ----------------------------------------------------------------------------------

_CANON = "lower(regexp_replace(split_part(url, '?', 1), '/+$', ''))"


@query("canonical_urls", f"SELECT result_idx, {_CANON} AS url_key FROM search_result")
def canonical_urls(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "search_result").select("result_idx", tx.canonical_url("url").alias("url_key"))


@query("dedupe_results", f"SELECT request_id, result_idx, url FROM search_result WHERE request_id IS NOT NULL AND {_CANON} <> '' QUALIFY row_number() OVER (PARTITION BY request_id, {_CANON} ORDER BY result_idx) = 1")
def dedupe_results(spark: SparkSession, root: str) -> DataFrame:
    return keys.first_per_key(table(spark, root, "search_result"), ["request_id", tx.canonical_url("url")], ["result_idx"]).select("request_id", "result_idx", "url")


@query("extract_handles", f"WITH {EXTRACTED} SELECT result_idx, array_to_string(handles, '|') AS handles FROM extracted")
def extract_handles(spark: SparkSession, root: str) -> DataFrame:
    return candidates.extracted(table(spark, root, "search_result"), HOST).select("result_idx", F.array_join("handles", "|").alias("handles"))


@query("extract_websites", f"WITH {EXTRACTED} SELECT result_idx, array_to_string(websites, '|') AS websites FROM extracted")
def extract_websites(spark: SparkSession, root: str) -> DataFrame:
    return candidates.extracted(table(spark, root, "search_result"), HOST).select("result_idx", F.array_join("websites", "|").alias("websites"))


@query("extract_contacts", f"WITH {BLOBS} SELECT result_idx, {_TELEGRAM} AS telegram, {_WHATSAPP} AS whatsapp, {_NAME} AS business_name FROM blobs")
def extract_contacts(spark: SparkSession, root: str) -> DataFrame:
    return candidates.extracted(table(spark, root, "search_result"), HOST).select("result_idx", "telegram", "whatsapp", ex.name_in_title().alias("business_name"))


@query("contacts_in_bios", f"WITH b AS (SELECT lead_id, coalesce(bio, '') || chr(10) || coalesce(telegram, '') AS blob FROM lead) SELECT lead_id, {_TELEGRAM} AS telegram, {_WHATSAPP} AS whatsapp FROM b")
def contacts_in_bios(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lead").select("lead_id", F.concat_ws("\n", F.coalesce("bio", F.lit("")), F.coalesce("telegram", F.lit(""))).alias("blob"))
    return rows.select("lead_id", ex.telegram().alias("telegram"), ex.whatsapp().alias("whatsapp"))


@query("candidate_keys", f"WITH {EXTRACTED} SELECT result_idx, unnest(range(0, len(keys))) AS key_pos, unnest(keys) AS key FROM extracted")
def candidate_keys(spark: SparkSession, root: str) -> DataFrame:
    return candidates.extracted(table(spark, root, "search_result"), HOST).select("result_idx", F.posexplode_outer("keys").alias("key_pos", "key")).withColumn("key_pos", F.col("key_pos").cast("long"))


@query("group_candidates", f"WITH {RESOLVED} SELECT request_id, key, business_name, bio, telegram, whatsapp, website, username, results FROM grp")
def group_candidates(spark: SparkSession, root: str) -> DataFrame:
    found = candidates.grouped(candidates.members(table(spark, root, "search_result"), profile_host=HOST), profile_host=HOST)
    return found.select("request_id", "key", "business_name", "bio", "telegram", "whatsapp", "website", "username", "results")


@query("resolve_entities", f"WITH {RESOLVED} SELECT request_id, cluster, username, business_name, bio, website, telegram, whatsapp, keys, results FROM resolved")
def resolve_entities(spark: SparkSession, root: str) -> DataFrame:
    return candidates.resolved(table(spark, root, "search_result"), profile_host=HOST).select("request_id", "cluster", "username", "business_name", "bio", "website", "telegram", "whatsapp", "keys", "results")


@query("cluster_members", f"WITH {RESOLVED} SELECT DISTINCT h.request_id, h.cluster, f.result_idx FROM flat f JOIN homes h ON f.request_id = h.request_id AND f.key = h.key")
def cluster_members(spark: SparkSession, root: str) -> DataFrame:
    return candidates.cluster_members(table(spark, root, "search_result"), profile_host=HOST)


# ---- joins ------------------------------------------------------------------------------------

_BOTH = f"WITH {s_shop_keys('a', 'lead_batch', 'lead_id')}, {s_shop_keys('b', 'lead', 'lead_id')}"
_SAME = "a.kh = b.kh OR a.kw = b.kw OR a.kn = b.kn"
_LINK = " UNION ALL ".join(f"SELECT a.lead_id AS new_id, min(b.lead_id) AS lead_id, '{n}' AS shared FROM a JOIN b ON a.{k} = b.{k} GROUP BY a.lead_id, a.{k}" for k, n in (("kh", "handle"), ("kw", "host"), ("kn", "name")))


@query("anti_archive", f"{_BOTH}, hit AS (SELECT a.lead_id FROM a JOIN b ON a.kh = b.kh UNION SELECT a.lead_id FROM a JOIN b ON a.kw = b.kw UNION SELECT a.lead_id FROM a JOIN b ON a.kn = b.kn) SELECT lead_id, batch_id FROM lead_batch WHERE lead_id NOT IN (SELECT lead_id FROM hit)")
def anti_archive(spark: SparkSession, root: str) -> DataFrame:
    return keys.not_in(table(spark, root, "lead_batch"), table(spark, root, "lead"), HOST).select("lead_id", "batch_id")


@query("semi_archive", f"{_BOTH}, hit AS (SELECT a.lead_id FROM a JOIN b ON a.kh = b.kh UNION SELECT a.lead_id FROM a JOIN b ON a.kw = b.kw UNION SELECT a.lead_id FROM a JOIN b ON a.kn = b.kn) SELECT lead_id, batch_id FROM lead_batch WHERE lead_id IN (SELECT lead_id FROM hit)")
def semi_archive(spark: SparkSession, root: str) -> DataFrame:
    return keys.also_in(table(spark, root, "lead_batch"), table(spark, root, "lead"), HOST).select("lead_id", "batch_id")


@query("same_lead_pairs", f"{_BOTH} {_LINK}")
def same_lead_pairs(spark: SparkSession, root: str) -> DataFrame:
    batch = table(spark, root, "lead_batch").withColumnRenamed("lead_id", "new_id")
    return keys.same_shop_links(batch, table(spark, root, "lead"), "new_id", "lead_id", HOST)


@query("route_queries", "SELECT DISTINCT r.query, c.category_id FROM search_result r JOIN category_ref c ON contains(lower(r.query), lower(c.name_en)) OR contains(lower(r.query), lower(c.name_fa))")
def route_queries(spark: SparkSession, root: str) -> DataFrame:
    """Each distinct query with the fixture sets its text fires; the list of routes is of fixed size."""
    routes = table(spark, root, "category_ref").select("category_id", F.lower("name_en").alias("en"), F.lower("name_fa").alias("fa"))
    distinct = table(spark, root, "search_result").select("query").where("query is not null").distinct()
    text = F.lower("query")
    return distinct.join(F.broadcast(routes), F.contains(text, F.col("en")) | F.contains(text, F.col("fa"))).select("query", "category_id")


# ---- queries of a request ---------------------------------------------------------------------


def _s_fill(template: str, values: dict[str, str]) -> str:
    parts, rest = [], template
    while rest:
        at = rest.find("{")
        if at < 0:
            parts.append(q(rest))
            break
        if at:
            parts.append(q(rest[:at]))
        parts.append(values[rest[at + 1]])
        rest = rest[at + 3 :]
    return "(" + " || ".join(parts) + ")"


_FLAG = {"a": "true", "c": "city IS NOT NULL", "h": "home", "hc": "home AND city IS NOT NULL", "n": "NOT home", "nc": "NOT home AND city IS NOT NULL"}
_VALUES = {"k": "country", "c": "city", "p": f"coalesce(city, {q(lx.HOME)})"}
_s_lines = lambda term, templates: "[" + ", ".join(f"CASE WHEN {_FLAG[f]} THEN {_s_fill(t, _VALUES | {'t': term})} END" for f, t in templates) + "]"
_TERMS = "CASE " + " ".join(f"WHEN regexp_matches(category, {q(p)}) THEN [{', '.join(map(q, t))}]" for p, t in lx.SYNONYMS) + " ELSE CAST([] AS VARCHAR[]) END"
_REQ = rf"""req AS (SELECT request_id, regexp_replace(category, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g') AS category, regexp_replace(country, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g') AS country,
  nullif(regexp_replace(city, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g'), '') AS city, coalesce(regexp_matches(country, '(?i)ایران|iran'), false) AS home FROM search_request),
terms AS (SELECT *, [category] || {_TERMS} AS ts FROM req), t2 AS (SELECT *, ({s_distinct('ts')})[1:5] AS term_list FROM terms)"""
_TIDY = rf"list_filter(list_transform(list_filter(ls, lambda x: x IS NOT NULL), lambda x: trim(regexp_replace(x, '[\s\x{{00A0}}]+', ' ', 'g'))), lambda x: x <> '')"


@query("query_variants", f"WITH {_REQ} SELECT request_id, array_to_string(term_list, '|') AS terms, CASE " + " ".join(f"WHEN contains(lower(city), {q(n)}) THEN {q(c)}" for n, c in lx.AREA_CODES) + " END AS area_code FROM t2")
def query_variants(spark: SparkSession, root: str) -> DataFrame:
    requests = table(spark, root, "search_request")
    return requests.select("request_id", F.array_join(querygen.term_list(querygen.tidy_ends("category")), "|").alias("terms"), querygen.area_code(F.col("city")).alias("area_code"))


@query("generate_queries", f"""WITH {_REQ}, lines AS (SELECT request_id, flatten(list_transform(term_list, lambda t: {_s_lines('t', lx.TERM_TEMPLATES)})) || {_s_lines('category', lx.TAIL_TEMPLATES)} AS ls FROM t2),
tidied AS (SELECT request_id, {_TIDY} AS qs FROM lines), cut AS (SELECT request_id, ({s_distinct('qs')})[1:48] AS qs FROM tidied) SELECT request_id, CAST(unnest(range(0, len(qs))) AS INTEGER) AS pos, unnest(qs) AS query FROM cut""")
def generate_queries(spark: SparkSession, root: str) -> DataFrame:
    return querygen.search_queries(table(spark, root, "search_request"))


_PATTERNS = ("influencers", "foreign", "generic_instagram", "duplicates")
_CITY_CODE = "CASE " + " ".join(f"WHEN contains(lower(coalesce(city, '')), {q(n)}) THEN {q(c)}" for n, c in lx.AREA_CODES) + " END"
_FURTHER = {"t": "category", "c": "coalesce(city, '')", "p": f"coalesce(nullif(city, ''), {q(lx.HOME)})", "q": f"coalesce(nullif(city, ''), {q(lx.CAPITAL)})", "d": _CITY_CODE}


@query("adaptive_queries", f"""WITH lines AS (SELECT request_id, pattern, [{', '.join(f"CASE WHEN pattern = {q(p)} THEN {_s_fill(t, _FURTHER)} END" for p, t in lx.FURTHER_TEMPLATES)}] AS ls
FROM search_request, (SELECT unnest([{', '.join(map(q, _PATTERNS))}]) AS pattern)), tidied AS (SELECT request_id, pattern, {_TIDY} AS qs FROM lines), cut AS (SELECT request_id, pattern, {s_distinct('qs')} AS qs FROM tidied)
SELECT request_id, pattern, CAST(unnest(range(0, len(qs))) AS INTEGER) AS pos, unnest(qs) AS query FROM cut""")
def adaptive_queries(spark: SparkSession, root: str) -> DataFrame:
    requests = table(spark, root, "search_request").withColumn("pattern", F.explode(F.array(*map(F.lit, _PATTERNS))))
    return querygen.further_queries(requests)


@query("failure_patterns", f"""WITH {RESOLVED}, home AS (SELECT DISTINCT h.request_id, h.cluster, f.result_idx FROM flat f JOIN homes h ON f.request_id = h.request_id AND f.key = h.key),
marks AS (SELECT h.request_id, cluster, bool_or(regexp_matches(blob, '(?i)influencer|اینفلوئنسر|پیج شخصی|fan page')) AS i, bool_or(regexp_matches(blob, '(?i)dubai|istanbul|turkey|uae|دبی|استانبول|ترکیه')) AS f FROM home h JOIN blobs USING (result_idx) GROUP BY 1, 2),
c AS (SELECT r.request_id, count(*) AS n, coalesce(count_if(i), 0) AS influencers, coalesce(count_if(f), 0) AS abroad, count_if(username IS NOT NULL AND website IS NULL) AS bare, count(DISTINCT username) AS users FROM resolved r LEFT JOIN marks m ON r.request_id = m.request_id AND r.cluster = m.cluster GROUP BY 1)
SELECT coalesce(c.request_id, q.request_id) AS request_id, coalesce(n, 0) AS n, CAST(coalesce(influencers, 0) AS BIGINT) AS influencers, CAST(coalesce(abroad, 0) AS BIGINT) AS abroad, CAST(coalesce(bare, 0) AS BIGINT) AS bare, coalesce(users, 0) AS users, CASE WHEN n IS NULL THEN 'duplicates' ELSE concat_ws('|', CASE WHEN influencers > n / 4 THEN 'influencers' END, CASE WHEN abroad > n / 5 THEN 'foreign' END, CASE WHEN bare > n / 2 THEN 'generic_instagram' END, CASE WHEN n > 8 AND users < n / 3 THEN 'duplicates' END) END AS patterns FROM c FULL JOIN (SELECT request_id FROM search_request UNION ALL SELECT -1) q ON c.request_id = q.request_id""")
def failure_patterns(spark: SparkSession, root: str) -> DataFrame:
    results = table(spark, root, "search_result")
    # One more request that has no results.
    requests = table(spark, root, "search_request").select("request_id").unionByName(spark.createDataFrame([(-1,)], "request_id long"))
    blobs = candidates.cluster_members(results, profile_host=HOST).join(results.select("request_id", "result_idx", ex.text_blob().alias("blob")), ["request_id", "result_idx"])
    return querygen.shortfalls(candidates.resolved(results, profile_host=HOST), blobs, requests=requests).withColumn("patterns", F.array_join("patterns", "|"))


@query("valid_requests", "SELECT request_id FROM search_request WHERE length(trim(category)) BETWEEN 2 AND 80 AND length(trim(country)) BETWEEN 2 AND 40 AND (city IS NULL OR length(trim(city)) <= 40) AND max_leads BETWEEN 1 AND 50")
def valid_requests(spark: SparkSession, root: str) -> DataFrame:
    return querygen.valid_requests(table(spark, root, "search_request")).select("request_id")


@query("new_query_strings", "SELECT DISTINCT query FROM search_result WHERE query IS NOT NULL EXCEPT SELECT DISTINCT query FROM search_result WHERE provider = 'mock'")
def new_query_strings(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "search_result")
    return rows.select("query").where("query is not null").distinct().join(rows.where("provider = 'mock'").select("query"), "query", "left_anti")


@query("both_fetches", "SELECT result_idx, url, 1 AS fetch FROM search_result WHERE provider = 'mock' UNION ALL SELECT result_idx, url, 2 AS fetch FROM search_result WHERE provider <> 'mock'")
def both_fetches(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "search_result").select("result_idx", "url", "provider")
    first = rows.where("provider = 'mock'").withColumn("fetch", F.lit(1))
    return first.unionByName(rows.where("provider <> 'mock'").withColumn("fetch", F.lit(2))).drop("provider")


# ---- evidence, scores, order ------------------------------------------------------------------

_SRC = "list_transform({}, lambda e: coalesce(e.source_id, '~'))"


@query("independent_sources", f"""SELECT lead_id, len(list_distinct({_SRC.format("list_filter(coalesce(iran_evidence, []), lambda e: e.strength IS DISTINCT FROM 'weak')")})) AS sources,
  len(list_distinct(list_transform(coalesce(evidence, []), lambda e: coalesce(e.source_id, 'null') || ':' || coalesce(e.type, 'null')))) AS signals,
  least(100, 35 * len(list_distinct({_SRC.format('coalesce(iran_evidence, []) || coalesce(evidence, [])')})) + CASE WHEN len(coalesce(source_urls, [])) > 0 THEN 10 ELSE 0 END) AS quality FROM lead""")
def independent_sources(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lead").select(
        "lead_id", evidence.source_count("iran_evidence").cast("long").alias("sources"), F.size(evidence.independent_signals("evidence")).cast("long").alias("signals"),
        evidence.evidence_quality("iran_evidence", "evidence", "source_urls").cast("long").alias("quality"))


@query("evidence_rows", "SELECT lead_id, CAST(unnest(range(0, len(evidence))) AS INTEGER) AS pos, unnest(evidence, recursive := true) FROM lead")
def evidence_rows(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lead").select("lead_id", F.posexplode("evidence").alias("pos", "e")).select("lead_id", "pos", "e.*")


_PART = "least(100.0, greatest(0.0, round(CAST(coalesce(score_breakdown.{0}, 0) AS DOUBLE)))) * CAST({1} AS DOUBLE)"
_SCORE = "CAST(round(CAST(0 AS DOUBLE) + " + " + ".join(_PART.format(n, w) for n, w in lx.SCORE_WEIGHTS) + ") AS INTEGER)"
_TIER = "CASE " + " ".join(f"WHEN {{0}} >= {b} THEN '{n}'" for b, n in lx.TIERS) + f" ELSE '{lx.LOWEST_TIER}' END"


@query("lead_score", f"WITH s AS (SELECT lead_id, {_SCORE} AS score FROM lead) SELECT lead_id, score, {_TIER.format('score')} AS tier FROM s")
def lead_score(spark: SparkSession, root: str) -> DataFrame:
    scored = table(spark, root, "lead").select("lead_id", ordering.weighted_score("score_breakdown").alias("score"))
    return scored.withColumn("tier", ordering.banded(F.col("score")))


@query("tier_histogram", f"WITH s AS (SELECT {_SCORE} AS score FROM lead) SELECT {_TIER.format('score')} AS tier, count(*) AS leads FROM s GROUP BY 1")
def tier_histogram(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lead").groupBy(ordering.banded(ordering.weighted_score("score_breakdown")).alias("tier")).agg(F.count("*").alias("leads"))


_RANK = "CASE iran_verification_status " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in lx.STATUS_RANK) + " ELSE 0 END"
_ORDER = ", ".join(f"{k} DESC" for k in (
    "coalesce(overall_confidence, 0)", _RANK, *(f"coalesce(score_breakdown.{p}, 0)" for p in ("business_authenticity", "commercial_intent", "online_shop_strength")), "coalesce(shop_bot_fit, 0)",
    "coalesce(customer_message_potential, 0)", "coalesce(evidence_quality_score, 0)", "coalesce(score_breakdown.activity_recency, 0)", "coalesce(score_breakdown.contactability, 0)", "coalesce(score, 0)")) + ", lead_id"


@query("rank_leads", f"SELECT lead_id, row_number() OVER (ORDER BY {_ORDER}) AS position FROM lead")
def rank_leads(spark: SparkSession, root: str) -> DataFrame:
    columns = ["lead_id", "overall_confidence", "iran_verification_status", "score_breakdown", "shop_bot_fit", "customer_message_potential", "evidence_quality_score", "score"]
    return ordering.positions(table(spark, root, "lead").select(*columns), ordering.lead_order()).select("lead_id", "position")


@query("archive_sorted", "SELECT lead_id, discovered_at, row_number() OVER (ORDER BY discovered_at DESC NULLS LAST, lead_id DESC) AS position FROM lead")
def archive_sorted(spark: SparkSession, root: str) -> DataFrame:
    return ordering.positions(table(spark, root, "lead").select("lead_id", "discovered_at"), [F.col("discovered_at").desc_nulls_last(), F.col("lead_id").desc()])


@query("first_n_results", f"""WITH d AS (SELECT request_id, result_idx FROM search_result WHERE request_id IS NOT NULL AND {_CANON} <> '' QUALIFY row_number() OVER (PARTITION BY request_id, {_CANON} ORDER BY result_idx) = 1)
SELECT request_id, result_idx FROM d JOIN search_request USING (request_id) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY result_idx) <= max_leads""")
def first_n_results(spark: SparkSession, root: str) -> DataFrame:
    distinct = keys.first_per_key(table(spark, root, "search_result"), ["request_id", tx.canonical_url("url")], ["result_idx"])
    requests = table(spark, root, "search_request").select("request_id", "max_leads")
    return ordering.first_n(distinct.join(requests, "request_id"), ["request_id"], ["result_idx"], "max_leads").select("request_id", "result_idx")


@query("lead_table", """SELECT row_number() OVER (ORDER BY lead_id) AS position, lead_id, coalesce(business_name, '—') AS shown_name, CASE WHEN instagram_url <> '' AND username <> '' THEN '@' || username ELSE '—' END AS handle,
  coalesce(city, '—') AS shown_city, coalesce(category, '—') AS shown_category, score, tier, coalesce(reason[1], '—') AS first_reason, coalesce(nullif(website, ''), nullif(instagram_url, ''), '—') AS link FROM lead""")
def lead_table(spark: SparkSession, root: str) -> DataFrame:
    """The rows of a table of leads as they are shown, numbered in their order."""
    dash, filled = F.lit("—"), lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    rows = table(spark, root, "lead").select(
        "lead_id", F.coalesce("business_name", dash).alias("shown_name"), F.when(filled("instagram_url") & filled("username"), F.concat(F.lit("@"), "username")).otherwise(dash).alias("handle"),
        F.coalesce("city", dash).alias("shown_city"), F.coalesce("category", dash).alias("shown_category"), "score", "tier", F.coalesce(F.try_element_at("reason", F.lit(1)), dash).alias("first_reason"),
        F.coalesce(F.nullif("website", F.lit("")), F.nullif("instagram_url", F.lit("")), dash).alias("link"))
    return ordering.positions(rows, [F.col("lead_id")])


@query("score_unpivot", " UNION ALL ".join(f"SELECT lead_id, '{n}' AS name, score_breakdown.{n} AS value FROM lead" for n, _ in lx.SCORE_WEIGHTS))
def score_unpivot(spark: SparkSession, root: str) -> DataFrame:
    return shapes.unpivoted(table(spark, root, "lead"), ["lead_id"], "score_breakdown")


@query("archive_defaults", "SELECT lead_id, coalesce(score, 0) AS score, coalesce(tier, 'REJECT') AS tier, coalesce(provider, 'unknown') AS provider, coalesce(iran_verification_status, 'UNCERTAIN') AS iran_verification_status, coalesce(activity_status, 'UNKNOWN') AS activity_status, coalesce(catalog_knownness, 'unknown') AS catalog_knownness, len(coalesce(reason, [])) AS reasons, len(coalesce(verification_warnings, [])) AS warnings, username, website FROM lead")
def archive_defaults(spark: SparkSession, root: str) -> DataFrame:
    filled = with_defaults(table(spark, root, "lead"))
    return filled.select("lead_id", "score", "tier", "provider", "iran_verification_status", "activity_status", "catalog_knownness", F.size("reason").cast("long").alias("reasons"), F.size("verification_warnings").cast("long").alias("warnings"), "username", "website")


@query("url_union", f"SELECT l.lead_id, array_to_string({s_distinct('(coalesce(l.source_urls, []) || [b.website])')}, '|') AS urls FROM lead l JOIN (SELECT username, min(website) AS website FROM lead_batch WHERE website IS NOT NULL GROUP BY 1) b USING (username)")
def url_union(spark: SparkSession, root: str) -> DataFrame:
    batch = table(spark, root, "lead_batch").where("website is not null").groupBy("username").agg(F.min("website").alias("new_site"))
    lead = table(spark, root, "lead").select("lead_id", "username", "source_urls")
    empty = F.array().cast("array<string>")
    return lead.join(batch, "username").select("lead_id", F.array_join(F.array_union(F.coalesce("source_urls", empty), F.array("new_site")), "|").alias("urls"))


# ---- statistics, replies, limits, frames ------------------------------------------------------


@query("request_stats", f"""SELECT request_id, count(*) AS rows, count_if(coalesce(title, '') = '')::BIGINT AS untitled, count_if(coalesce(snippet, '') = '')::BIGINT AS bare, count_if(fetched_at < ingested_at - INTERVAL 1 DAY)::BIGINT AS late,
  count_if({s_host('url')} IS NULL)::BIGINT AS hostless FROM search_result GROUP BY 1""")
def request_stats(spark: SparkSession, root: str) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return shapes.counted(table(spark, root, "search_result"), ["request_id"], untitled=empty("title"), bare=empty("snippet"), late=F.expr("fetched_at < ingested_at - INTERVAL 1 DAY"), hostless=tx.host_of("url").isNull())


@query("stage_ends", "SELECT user_id, event_type, first(value ORDER BY ts, event_id) AS first_value, last(value ORDER BY ts, event_id) AS last_value, count(*) AS rows FROM events GROUP BY 1, 2")
def stage_ends(spark: SparkSession, root: str) -> DataFrame:
    return shapes.ends(table(spark, root, "events"), ["user_id", "event_type"], F.struct("ts", "event_id"), "value")


_REPLIES = (
    '{"businessName": "N#", "businessType": "retail", "city": null, "reasons": ["a", "b"], "warnings": [], "shopBotFit": 70, "credibility": 55.5, "inventedClaims": []}',
    "not json",
    '{"businessName": "N#", "city": null, "reasons": [], "warnings": [], "shopBotFit": 1, "credibility": 1}',
    '{"businessName": null, "businessType": null, "city": "C", "reasons": [], "warnings": ["w"], "shopBotFit": 0, "credibility": 100, "inventedClaims": ["x"]}',
    '{"businessName": "N#", "businessType": "retail", "city": null, "reasons": [], "warnings": [], "shopBotFit": "70", "credibility": 55}',
    '{"businessName": "N#", "businessType": "retail", "city": null, "reasons": [], "warnings": [], "shopBotFit": 101, "credibility": 55}',
    '{"businessName": "N#", "businessType": "retail", "city": null, "reasons": ["1","2","3","4","5","6","7","8","9","10","11","12","13"], "warnings": [], "shopBotFit": 7, "credibility": 5}',
    '{"businessName": null, "businessType": null, "city": null, "reasons": [], "warnings": [], "shopBotFit": 0, "credibility": 0}',
    '{"businessName": "N#", "businessType": "b", "city": "c", "reasons": ["r"], "warnings": [], "shopBotFit": 3, "credibility": 4, "more": {"a": 1}}',
)
_RAW = "CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN replace({q(t)}, '#', CAST(o_orderkey AS VARCHAR))" for i, t in enumerate(_REPLIES)) + " END"


@query("validate_replies", f"""WITH r AS (SELECT o_orderkey, CASE WHEN json_valid({_RAW}) THEN CAST({_RAW} AS JSON) END AS j FROM orders),
ok AS (SELECT o_orderkey, j FROM r WHERE j IS NOT NULL AND {' AND '.join(f"coalesce(json_type(j, '$.{k}') IN ('VARCHAR', 'NULL'), false)" for k in replies.TEXTS)} AND {' AND '.join(f"coalesce(json_type(j, '$.{k}') = 'ARRAY' AND json_array_length(j, '$.{k}') <= 12, false)" for k in replies.LISTS)}
  AND {' AND '.join(f"coalesce(json_type(j, '$.{k}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(j->>'$.{k}' AS DOUBLE) BETWEEN 0 AND 100, false)" for k in replies.NUMBERS)} AND coalesce(json_array_length(j, '$.inventedClaims'), 0) = 0)
SELECT o_orderkey, j->>'$.businessName' AS business_name, j->>'$.businessType' AS business_type, j->>'$.city' AS city, CAST(json_array_length(j, '$.reasons') AS INTEGER) AS reasons, CAST(j->>'$.shopBotFit' AS DOUBLE) AS shop_bot_fit, CAST(j->>'$.credibility' AS DOUBLE) AS credibility FROM ok""")
def validate_replies(spark: SparkSession, root: str) -> DataFrame:
    rows = _reply_table(spark, root).select("o_orderkey", replies.parsed_reply("raw").alias("r")).where("r is not null")
    return rows.select("o_orderkey", "r.business_name", "r.business_type", "r.city", F.size("r.reasons").alias("reasons"), "r.shop_bot_fit", "r.credibility")


def _reply_table(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("o_orderkey")
    raw = F.coalesce(*[F.when(key % 9 == i, F.replace(F.lit(t), F.lit("#"), key.cast("string"))) for i, t in enumerate(_REPLIES)])
    return table(spark, root, "orders").select("o_orderkey", raw.alias("raw"))


@query("enrich_left_join", f"""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'N' || o_orderkey WHEN 7 THEN NULL WHEN 8 THEN 'N' || o_orderkey END AS n, CASE o_orderkey % 9 WHEN 0 THEN 70 WHEN 7 THEN 0 WHEN 8 THEN 3 END AS f, CASE o_orderkey % 9 WHEN 0 THEN 2 WHEN 8 THEN 1 ELSE 0 END AS k FROM orders)
SELECT lead_id, coalesce(n, business_name) AS business_name, CAST(greatest(shop_bot_fit, coalesce(f, 0)) AS DOUBLE) AS shop_bot_fit, CAST(len(reason) + coalesce(k, 0) AS INTEGER) AS reasons FROM lead LEFT JOIN r ON lead_id = o_orderkey""")
def enrich_left_join(spark: SparkSession, root: str) -> DataFrame:
    lead = table(spark, root, "lead").select("lead_id", "business_name", "business_type", "shop_bot_fit", "reason", "verification_warnings")
    found = replies.enriched(lead, _reply_table(spark, root).withColumnRenamed("o_orderkey", "lead_id"), "lead_id")
    return found.select("lead_id", "business_name", F.col("shop_bot_fit").cast("double").alias("shop_bot_fit"), F.size("reason").alias("reasons"))


@query("rate_limit_events", """WITH RECURSIVE anchors AS (
  SELECT user_id, min(ts) AS anchor FROM events WHERE ts IS NOT NULL GROUP BY 1
  UNION ALL
  SELECT a.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = a.user_id AND e.ts > a.anchor + INTERVAL 120 HOUR) FROM anchors a WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = a.user_id AND e.ts > a.anchor + INTERVAL 120 HOUR)),
placed AS (SELECT e.event_id, e.user_id, e.ts, max(a.anchor) AS anchor FROM events e JOIN anchors a ON a.user_id = e.user_id AND a.anchor <= e.ts GROUP BY 1, 2, 3)
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, anchor ORDER BY ts, event_id) <= 8 AS allowed FROM placed""")
def rate_limit_events(spark: SparkSession, root: str) -> DataFrame:
    return limiter.limited(table(spark, root, "events"), "user_id", "ts", "event_id", 8, 120 * 3600 * 1_000_000).drop("ts")


@query("frames_round_trip", "SELECT event_id, event_type AS event, user_id, value FROM events WHERE event_type <> ''")
def frames_round_trip(spark: SparkSession, root: str) -> DataFrame:
    framed = table(spark, root, "events").select("event_id", as_frame("event_type", "user_id", "value").alias("text"))
    return split_frames(framed, "text", "user_id long, value double").select("event_id", "event", "data.user_id", "data.value")


_DISTINCT = f"SELECT * FROM search_result WHERE request_id IS NOT NULL AND {_CANON} <> '' QUALIFY row_number() OVER (PARTITION BY request_id, {_CANON} ORDER BY result_idx) = 1"
# Handles and sites tell the candidates of a request apart already; only names can repeat among them.
_PIPELINE = f"""WITH {RESOLVED.replace('FROM search_result)', f'FROM ({_DISTINCT}))')},
found AS (SELECT r.*, username AS instagram_url, city, max_leads FROM resolved r JOIN search_request USING (request_id)),
{s_shop_keys('a', 'found', '*')}, {s_shop_keys('b', 'lead', 'lead_id')},
fresh AS (SELECT * FROM a WHERE (kh IS NULL OR kh NOT IN (SELECT kh FROM b WHERE kh IS NOT NULL)) AND (kw IS NULL OR kw NOT IN (SELECT kw FROM b WHERE kw IS NOT NULL)) AND (kn IS NULL OR kn NOT IN (SELECT kn FROM b WHERE kn IS NOT NULL))),
single AS (SELECT * FROM fresh QUALIFY kn IS NULL OR row_number() OVER (PARTITION BY request_id, kn ORDER BY seat) = 1),
leads AS (SELECT * FROM single QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY seat) <= max_leads)"""


@query("pipeline_leads", f"{_PIPELINE} SELECT request_id, cluster, username, business_name, bio, website, telegram, whatsapp, city, keys, results FROM leads")
def pipeline_leads(spark: SparkSession, root: str) -> DataFrame:
    """Results to new shops: distinct, extracted, grouped, merged, not in the archive, each shop once, first n."""
    found = new_leads(table(spark, root, "search_result"), table(spark, root, "search_request"), table(spark, root, "lead"), HOST)
    return found.select("request_id", "cluster", "username", "business_name", "bio", "website", "telegram", "whatsapp", "city", "keys", "results")


@query("pipeline_counts", f"{_PIPELINE} SELECT request_id, count(*) AS leads, CAST(sum(results) AS BIGINT) AS results FROM leads GROUP BY 1")
def pipeline_counts(spark: SparkSession, root: str) -> DataFrame:
    return pipeline_leads(spark, root).groupBy("request_id").agg(F.count("*").alias("leads"), F.sum("results").alias("results"))


@query("insert_new", f"""WITH RECURSIVE {s_shop_keys('a', 'lead_batch', 'lead_id')}, {s_shop_keys('b', 'lead', 'lead_id')},
hit AS (SELECT a.lead_id FROM a JOIN b ON a.kh = b.kh UNION SELECT a.lead_id FROM a JOIN b ON a.kw = b.kw UNION SELECT a.lead_id FROM a JOIN b ON a.kn = b.kn),
cand AS (SELECT lead_id, row_number() OVER (ORDER BY lead_id) AS n, list_filter(['h' || kh, 'w' || kw, 'n' || kn], lambda k: k IS NOT NULL) AS ks FROM a WHERE lead_id NOT IN (SELECT lead_id FROM hit)),
walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS BIGINT) AS lead_id, false AS kept
  UNION ALL SELECT c.n, CASE WHEN list_has_any(w.seen, c.ks) THEN w.seen ELSE list_concat(w.seen, c.ks) END, c.lead_id, NOT list_has_any(w.seen, c.ks) FROM walk w JOIN cand c ON c.n = w.n + 1)
SELECT lead_id FROM walk WHERE kept""")
def insert_new(spark: SparkSession, root: str) -> DataFrame:
    """The batch rows that an insert one after the other adds to the archive."""
    fresh = keys.not_in(table(spark, root, "lead_batch"), table(spark, root, "lead"), HOST)
    return keys.first_of_each_shop(fresh, ["lead_id"], profile_host=HOST).select("lead_id")
