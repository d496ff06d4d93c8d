"""The same results as plain SQL for the check database (DuckDB dialect)."""

from __future__ import annotations

from ..functions import patterns as P
from .inputs import (
    ASKED_CITIES, CITIES, DOMAINS, HASHTAGS, SOURCE_CITIES, LABEL, LANGUAGES, LOCATION, PHRASE_CITIES, RESOURCE, SENTIMENT,
    SITE_SECTION, TOPIC_CITIES, TOWN, TRACK_CITIES, TRACK_TEXT,
)
from .storedsites import CITY as SITE_CITY
from .storedsites import IS_FORUM, IS_REVIEW, IS_THREAD, PER_LIST
from .storedsites import TEXT as SITE_TEXT


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(quoted(v) for v in values)


def clean_forum(expr: str) -> str:
    flat = f"regexp_replace(regexp_replace({expr}, '<[^>]+>', '', 'g'), '[\\n\\r\\t]', ' ', 'g')"
    return f"regexp_replace({flat}, ' +', ' ', 'g')"


def clean_review(expr: str) -> str:
    return f"replace(regexp_replace({expr}, '<[^>]+>', '', 'g'), chr(10), '')"


def clean_topic(expr: str) -> str:
    return f"trim(lower(regexp_replace({expr}, '[\\n\\r\\t]', ' ', 'g')))"


WORDS = (
    "list_filter(regexp_split_to_array(lower(replace(text, '#', '')), '[\\s\\p{Z}]+'), lambda w: w <> '')")
RAW = f"regexp_extract_all(text, {quoted(P.token_pattern())}, 1)"
UNREPEATED = (
    "array_to_string(list_transform(list_filter(range(1, len(w) + 1), "
    "lambda i: strpos(w, substr(w, i, 1)) = i), lambda i: substr(w, i, 1)), '')")
FOLDED = (
    f"list_transform({RAW}, lambda w: CASE WHEN regexp_matches(w, {quoted(P.STARTS_WITH_EMOTICON)}) "
    f"THEN {UNREPEATED} ELSE regexp_replace(lower(w), {quoted(P.ADDRESS)}, '{P.ADDRESS_MARK}', 'g') END)")


def kept(tokens: str) -> str:
    return f"list_filter({tokens}, lambda w: w NOT IN ({listed(P.STOPWORDS)}) AND NOT starts_with(w, '#'))"


CLEAN = kept(FOLDED)
TOK = f"tok AS (SELECT doc_id, {CLEAN} AS words FROM documents)"
PAIRS = "list_transform(range(1, len(words)), lambda i: words[i] || chr(1) || words[i + 1])"
FEATURES = f"unnest(list_distinct(list_concat(words, {PAIRS}))) AS feature"
NANO = "CAST(round(ln({p}) * 1000000000) AS BIGINT)"

TRAINING = f"""{TOK},
train AS (SELECT doc_id, {LABEL} AS label, words FROM tok JOIN labels USING (doc_id)
          WHERE {LABEL} <> '{P.IRRELEVANT}'),
nl AS (SELECT label, count(*) AS nl FROM train GROUP BY label),
total AS (SELECT count(*) AS docs, count(DISTINCT label) AS kinds FROM train),
found AS (SELECT label, {FEATURES} FROM train),
seen AS (SELECT feature, label, count(*) AS n FROM found GROUP BY feature, label),
known AS (SELECT feature, sum(n) AS df FROM seen GROUP BY feature),
likelihood AS (
  SELECT k.feature, nl.label, coalesce(s.n, 0) AS n,
         {NANO.format(p='(coalesce(s.n, 0) + 0.5) / (nl + 0.5 * CASE WHEN df = docs THEN 1 ELSE 2 END)')} AS logp_nano
  FROM known k CROSS JOIN nl CROSS JOIN total
  LEFT JOIN seen s ON s.feature = k.feature AND s.label = nl.label),
prior AS (SELECT label, nl AS n, {NANO.format(p='(nl + 0.5) / (docs + 0.5 * kinds)')} AS logp_nano FROM nl, total)"""

# Scores of every text in a relation ``texts(id..., words)`` against the trained model.
def scored(texts: str, key: str) -> str:
    return f"""asked AS (SELECT {key}, {FEATURES} FROM {texts}),
sums AS (SELECT {key}, label, sum(logp_nano) AS s FROM asked JOIN likelihood USING (feature) GROUP BY ALL),
scores AS (SELECT t.*, p.label, CAST(coalesce(s.s, 0) + p.logp_nano AS BIGINT) / 1000000000 AS score
           FROM (SELECT {key} FROM {texts}) t CROSS JOIN prior p
           LEFT JOIN sums s USING ({key}, label)),
labelled AS (SELECT {key}, arg_max(label, (score, label)) AS sentiment,
                    max(score) FILTER (label = 'negative') AS score_negative,
                    max(score) FILTER (label = 'positive') AS score_positive
             FROM scores GROUP BY ALL)"""


CHARS = P.LOCATION_PUNCTUATION


def cleaned(expr: str) -> str:
    return f"nullif(trim(regexp_extract({expr}, {quoted(f'^([^{CHARS}]+)')}, 1)), '')"


def located(rows: str) -> str:
    """``geo_of(key...)``: the geography of each row of ``rows(..., geo)``."""
    return f"""keys AS (SELECT DISTINCT lower({cleaned('geo')}) AS place_key FROM {rows}),
hit AS (SELECT place_key, p_partkey, p_name FROM keys JOIN part ON contains(lower(p_name), place_key)
        QUALIFY row_number() OVER (PARTITION BY place_key ORDER BY p_size DESC, p_partkey) = 1),
place AS (SELECT place_key, p_partkey AS geoname_id,
                 upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' '
                 || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS geo_city,
                 CAST(p_partkey % 25 AS VARCHAR) AS geo_country, r_name AS geo_continent
          FROM hit LEFT JOIN nation ON n_nationkey = p_partkey % 25 AND n_nationkey <> 7
          LEFT JOIN region ON r_regionkey = n_regionkey),
resolved AS (SELECT r.*, coalesce(geo_city, nullif(geo, '')) AS geo_city, geo_country, geo_continent
             FROM {rows} r LEFT JOIN place ON place.place_key = lower({cleaned('r.geo')}))"""


CUSTOMERS = f"""located AS (SELECT c_custkey, {LOCATION.format(id='c_custkey')} AS geo
  FROM customer LEFT JOIN part ON p_partkey = c_custkey)"""

POSTS = f"""posts AS (
  SELECT {RESOURCE} AS resource, source AS city, {TOWN.format(text='VARCHAR')} AS geo_city,
         n_name AS geo_country, r_name AS geo_continent,
         CASE WHEN quality IS NOT NULL THEN {SENTIMENT} END AS sentiment
  FROM documents LEFT JOIN nation ON n_nationkey = doc_id % 30
  LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN labels USING (doc_id))"""

STATS = """leveled AS (
  SELECT resource, city, sentiment, unnest([
    {'level': 'by_city', 'geo': geo_city}, {'level': 'by_country', 'geo': geo_country},
    {'level': 'by_continent', 'geo': geo_continent}, {'level': 'total', 'geo': NULL}], recursive := true)
  FROM posts),
counted AS (
  SELECT resource, city, coalesce(s, 'all') AS sentiment, level, geo, count(*) AS n
  FROM (SELECT *, unnest([NULL, CASE WHEN sentiment IN ('positive', 'negative') THEN sentiment ELSE '' END]) AS s
        FROM leveled) WHERE s IS NULL OR s <> '' GROUP BY ALL)"""

def dense(cities) -> str:
    return STATS + f""",
grid AS (
  SELECT g.resource, c.city, s.sentiment, g.level, g.geo
  FROM (SELECT DISTINCT resource, level, geo FROM leveled) g
  CROSS JOIN (SELECT unnest([{listed(cities)}]) AS city) c
  CROSS JOIN (SELECT unnest(['positive', 'negative', 'all']) AS sentiment) s),
dense AS (
  SELECT g.*, coalesce(n, 0) AS n FROM grid g LEFT JOIN counted k
  ON k.resource = g.resource AND k.city = g.city AND k.sentiment = g.sentiment AND k.level = g.level
  AND k.geo IS NOT DISTINCT FROM g.geo)"""


STATS_JSON = "'{' || " + " || ',' || ".join(
    f"""'"{s}":' || coalesce(sum(n) FILTER (sentiment = '{s}'), 0)""" for s in ("positive", "negative", "all")) + " || '}'"
# All cities of a source with all its geo values, zeros included.
DENSE = STATS + """,
grid AS (
  SELECT g.resource, c.city, s.sentiment, g.level, g.geo
  FROM (SELECT DISTINCT resource, level, geo FROM leveled) g
  JOIN (SELECT DISTINCT resource, city FROM posts) c ON c.resource = g.resource
  CROSS JOIN (SELECT unnest(['positive', 'negative', 'all']) AS sentiment) s),
dense AS (
  SELECT g.*, coalesce(n, 0) AS n FROM grid g LEFT JOIN counted k
  ON k.resource = g.resource AND k.city IS NOT DISTINCT FROM g.city AND k.sentiment = g.sentiment AND k.level = g.level
  AND k.geo IS NOT DISTINCT FROM g.geo)"""

STATS_DOCUMENTS = f"""document AS (
  SELECT resource, city, level, CASE WHEN level <> 'total' THEN coalesce(geo, 'null') END AS geo, {STATS_JSON} AS stats
  FROM counted GROUP BY 1, 2, 3, 4)"""

H1 = "regexp_extract(html, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1)"
ANCHORS = f"""anchor AS (
  SELECT page_id, generate_subscripts(links, 1) - 1 AS position, unnest(links) AS link,
         unnest(inner_texts) AS inner_text
  FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"[^>]*>.*?</a>', 1) AS links,
               regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*"[^"]*"[^>]*>(.*?)</a>', 1) AS inner_texts
        FROM pages)),
linked AS (SELECT page_id, position, link, {clean_forum('inner_text')} AS link_text FROM anchor)"""


def named_entities(expr: str, amp: bool = True) -> str:
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        expr = f"replace({expr}, '{name}', '{char}')"
    return f"replace({expr}, '&amp;', ' and ')" if amp else expr


def phrase_words(names) -> str:
    """Cities of several words as runs of neighbouring words."""
    parts = []
    for name in names:
        n = len(name.split())
        run = " || ' ' || ".join(f"words[i + {k}]" if k else "words[i]" for k in range(n))
        parts.append(
            f"SELECT doc_id, {run} AS city FROM (SELECT doc_id, words, unnest(range(1, len(words) - {n - 2})) AS i "
            f"FROM w) WHERE {run} = {quoted(name)}")
    return " UNION ALL ".join(parts)


TRACKED = " OR ".join(
    "(" + " AND ".join(f"list_contains(forms, {quoted(x)})" for x in f"#{h} {c}".lower().split()) + ")"
    for h in HASHTAGS for c in TRACK_CITIES)

LINES = """lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) - 1 AS position, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""

SITE = "'http://www.tripadvisor.com'"

MENTIONS = f"""mention AS (
  SELECT doc_id, w AS city FROM (SELECT doc_id, unnest({WORDS}) AS w FROM documents) WHERE w IN ({listed(CITIES)})),
place_of AS (SELECT doc_id, {LOCATION.format(id='doc_id')} AS geo
             FROM documents LEFT JOIN part ON p_partkey = doc_id)"""

ORDER_STAMPS = """made AS (
  SELECT o_orderkey, o_orderdate AS day, o_orderkey % 5 AS form,
         o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) AS at_time FROM orders)"""
STAMP = "strftime({x}, '%Y-%m-%d %H:%M:%S')"

ORACLES: dict[str, str] = {
    "city_mentions": f"""SELECT doc_id, lang, city FROM (SELECT doc_id, lang, unnest({WORDS}) AS city FROM documents)
        WHERE city IN ({listed(CITIES)})""",
    "city_phrases": f"""WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents) {phrase_words(PHRASE_CITIES)}""",
    "track_filter": f"""WITH w AS (
        SELECT doc_id, lang, regexp_extract_all(lower({TRACK_TEXT}), '([#@]?[\\p{{L}}\\p{{N}}_]+)', 1) AS words FROM documents),
        f AS (SELECT doc_id, lang, list_distinct(list_concat(words, list_transform(words, lambda x: ltrim(x, '#@')))) AS forms FROM w)
        SELECT doc_id, lang FROM f WHERE ({TRACKED}) AND lower(lang) IN ({listed(LANGUAGES)})""",
    "topic_prefix": f"""WITH h AS (SELECT page_id, {clean_topic(clean_forum(H1))} AS topic FROM pages)
        SELECT page_id, city, topic FROM h, (SELECT unnest([{listed(TOPIC_CITIES)}]) AS city) c
        WHERE starts_with(topic, lower(city))""",
    "tokens": f"""SELECT doc_id, CAST(len(k) AS INTEGER) AS n_tokens, array_to_string(k, ' ') AS tokens
        FROM (SELECT doc_id, {RAW} AS k FROM documents)""",
    "clean_tokens": f"""SELECT doc_id, CAST(len(k) AS INTEGER) AS n_tokens, array_to_string(k, ' ') AS tokens
        FROM (SELECT doc_id, {CLEAN} AS k FROM documents)""",
    "cased_tokens": f"""SELECT doc_id, CAST(len(k) AS INTEGER) AS n_tokens, array_to_string(k, ' ') AS tokens
        FROM (SELECT doc_id, {kept(RAW)} AS k FROM documents)""",
    "bigram_counts": f"""WITH {TOK}, p AS (SELECT words, unnest(range(1, len(words))) AS i FROM tok)
        SELECT words[i] AS first, words[i + 1] AS second, count(*) AS n FROM p GROUP BY ALL""",
    "entity_decode": f"""WITH d AS (SELECT page_id, {H1} AS h1,
          {named_entities("html || ' €é < &bogus; &#99999999; &#55296;'")} AS decoded FROM pages),
        t AS (SELECT page_id, md5(decoded) AS html_md5, CAST(length(decoded) AS INTEGER) AS n_chars, h1,
          {clean_forum('h1')} AS title FROM d)
        SELECT page_id, html_md5, n_chars, {named_entities('title')} AS title,
          {named_entities('title', amp=False)} AS title_strict FROM t""",
    "nb_prior": f"WITH {TRAINING} SELECT label, n, logp_nano FROM prior",
    "nb_likelihood": f"WITH {TRAINING} SELECT label, feature, CAST(n AS BIGINT) AS n, logp_nano FROM likelihood",
    "nb_classify": f"""WITH {TRAINING}, {scored('tok', 'doc_id')}
        SELECT doc_id, score_negative, score_positive, sentiment AS label FROM labelled""",
    "text_sentiment": f"""WITH {TRAINING}, talk AS (SELECT conv_id * 1000 + turn AS id, {CLEAN} AS words FROM conversations),
        {scored('talk', 'id')}
        SELECT conv_id, turn, sentiment FROM conversations JOIN labelled ON id = conv_id * 1000 + turn""",
    "informative_features": f"""WITH {TRAINING}
        SELECT feature, max(logp_nano) - min(logp_nano) AS log_ratio_nano FROM likelihood WHERE n > 0
        GROUP BY feature HAVING count(*) >= 2 ORDER BY log_ratio_nano DESC, feature LIMIT 100""",
    "clean_location": f"""WITH {CUSTOMERS} SELECT c_custkey, geo, {cleaned('geo')} AS place,
        nullif(regexp_replace(geo, {quoted(f'^([^{CHARS}]+).+$')}, '\\1'), '') AS place_strict FROM located""",
    "best_place": f"""WITH {CUSTOMERS}, {located('located')} SELECT place_key, geoname_id FROM place""",
    "geo_enrich": f"""WITH {CUSTOMERS}, {located('located')}
        SELECT c_custkey, geo_city, geo_country, geo_continent FROM resolved""",
    "post_stats": f"WITH {POSTS}, {STATS} SELECT resource, city, sentiment, level, geo, n FROM counted",
    "post_stats_dense": f"WITH {POSTS}, {dense(ASKED_CITIES)} SELECT resource, city, sentiment, level, geo, n FROM dense",
    "post_stats_city": f"WITH {POSTS}, {dense(['src3'])} SELECT resource, city, sentiment, level, geo, n FROM dense",
    "post_totals": f"""WITH {POSTS} SELECT resource, city, count(*) AS total,
        count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative
        FROM posts GROUP BY ALL""",
    "geo_values": f"WITH {POSTS}, {STATS} SELECT DISTINCT resource, level, geo FROM leveled WHERE level <> 'total'",
    "subject_cities": f"WITH {POSTS} SELECT DISTINCT resource, city FROM posts WHERE resource = 'TWITTER'",
    "post_count": f"""WITH {POSTS} SELECT count(*) AS n FROM posts
        WHERE city = 'src3' AND sentiment = 'positive' AND geo_country IS NULL""",
    "stats_json": f"WITH {POSTS}, {DENSE}, {STATS_DOCUMENTS.replace('FROM counted', 'FROM dense')} SELECT * FROM document",
    "stats_nested": f"""WITH {POSTS}, {STATS}, {STATS_DOCUMENTS},
        flat AS (SELECT resource, city, CASE WHEN level = 'total' THEN '' ELSE level END AS level, coalesce(geo, '') AS geo, stats
          FROM document WHERE resource IS NOT NULL AND city IS NOT NULL),
        row AS (SELECT *, row_number() OVER o AS position, count(*) OVER () AS rows,
          coalesce(lag(resource) OVER o = resource, false) AS s0, coalesce(lag(resource) OVER o = resource AND lag(city) OVER o = city, false) AS c0,
          coalesce(lag(resource) OVER o = resource AND lag(city) OVER o = city AND lag(level) OVER o = level, false) AS l0,
          coalesce(lead(resource) OVER o = resource, false) AS s1, coalesce(lead(resource) OVER o = resource AND lead(city) OVER o = city, false) AS c1,
          coalesce(lead(resource) OVER o = resource AND lead(city) OVER o = city AND lead(level) OVER o = level, false) AS l1
          FROM flat WINDOW o AS (ORDER BY resource, city, level, geo))
        SELECT position, CASE WHEN position = 1 THEN '{{' ELSE ',' END || CASE WHEN s0 THEN '' ELSE '"' || resource || '":{{' END
          || CASE WHEN c0 THEN '' ELSE '"' || city || '":{{' END
          || CASE WHEN level = '' THEN '"total":' WHEN l0 THEN '' ELSE '"' || level || '":{{' END
          || CASE WHEN level = '' THEN '' ELSE '"' || geo || '":' END || stats || CASE WHEN level = '' OR l1 THEN '' ELSE '}}' END
          || CASE WHEN c1 THEN '' ELSE '}}' END || CASE WHEN s1 THEN '' ELSE '}}' END || CASE WHEN position = rows THEN '}}' ELSE '' END AS fragment
        FROM row""",
    "page_titles": f"SELECT page_id, {clean_topic(clean_forum(H1))} AS title FROM pages",
    "page_posts": f"""WITH p AS (SELECT page_id, regexp_extract_all(replace(html, '<p>', '</p><p>') || '</p>', '(?s)<p>(.*?)</p>', 1) AS parts FROM pages)
        SELECT page_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS position,
          unnest(list_transform(parts, lambda x: {clean_forum('x')})) AS text FROM p""",
    "page_links": f"""WITH {ANCHORS} SELECT page_id, CAST(position AS INTEGER) AS position, link, link_text FROM linked""",
    "first_rule_links": f"""WITH {ANCHORS} SELECT page_id, link, link_text, min(CASE WHEN length(link_text) <= 3 THEN 0
        WHEN regexp_matches(link_text, '[aeiou]$') THEN 1 ELSE 2 END) AS rule FROM linked GROUP BY page_id, link, link_text""",
    "url_dedupe": f"""SELECT page_id, url FROM pages QUALIFY row_number() OVER (
        PARTITION BY regexp_replace(regexp_replace(url, '[?#].*$', ''), '{SITE_SECTION}', '') ORDER BY page_id) = 1""",
    "unseen_urls": """WITH l AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)
        SELECT page_id, url FROM l WHERE url NOT IN (SELECT url FROM l WHERE page_id % 5 = 0)""",
    "domain_filter": "SELECT page_id, url FROM (SELECT page_id, url, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages) WHERE "
        + " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in DOMAINS),
    "city_propagation": f"""WITH RECURSIVE names AS (
          SELECT n_nationkey, replace(lower(n_name), '_', ' ') AS city,
                 {SITE} || '/Search?q=' || replace(lower(n_name), '_', '+') AS url FROM nation),
        edge AS (
          SELECT 'c/' || o_custkey AS src, 'c/' || ((o_orderkey * 7 + 13) % (SELECT count(*) FROM customer)) AS dst
          FROM orders
          UNION SELECT url, 'c/' || n_nationkey FROM names),
        reach(url, city, depth) USING KEY (url) AS (
          SELECT url, city, 0 FROM names
          UNION SELECT dst, min(city), min(depth) + 1 FROM reach JOIN edge ON src = url
          WHERE dst NOT IN (SELECT url FROM recurring.reach) GROUP BY dst)
        SELECT url, city, depth FROM reach""",
    "search_urls": f"""SELECT n_nationkey, {SITE} || '/Search?q=' || replace(replace(lower(n_name), '_', ' ') || ' city', ' ', '+') AS url,
          replace(lower(n_name), '_', ' ') || ' city' AS city, split_part(lower(n_name), '_', 1) AS city_strict FROM nation
        UNION ALL SELECT CAST(page_id AS INTEGER), url, NULL, NULL FROM pages""",
    "detail_urls": """WITH p AS (SELECT page_id, 'http://www.tripadvisor.com/Hotel_Review-g' || page_id || '-d7-Reviews.html' AS page_url,
          list_transform(range(0, page_id % 4 + 1), lambda i: CAST(page_id * 10 + i AS VARCHAR)) AS ids FROM pages
          WHERE page_id % 3 > 0 AND page_id % 4 > 0)
        SELECT page_id, page_url, 'http://www.tripadvisor.com/ExpandedUserReviews-g' || page_id || '-d7?target=' || ids[1]
          || '&context=1&reviews=' || array_to_string(ids, ',') || '&servlet=g' || page_id || '-d7Hotel_Review&expand=1' AS url FROM p""",
    "site_posts": f"""WITH p AS (SELECT page_id, {SITE_TEXT} AS text, {SITE_CITY} AS city FROM pages)
        SELECT 'TRIPADVISOR' AS resource, city, text, 'Town ' || page_id AS geo, '2014-04-02 00:00:00' AS date FROM p WHERE {IS_REVIEW}
        UNION ALL SELECT 'TRIPADVISOR', city, text, 'Place ' || page_id, '2016-01-05 19:05:00' FROM p WHERE {IS_THREAD}
        UNION ALL SELECT 'SKYSCRAPER', 'chicago', text, 'Place ' || page_id, '2015-03-07 09:30:00' FROM p
          WHERE {IS_FORUM} AND page_id % 2 = 0""",
    "site_requests": f"""WITH p AS (SELECT page_id, page_id % 3 AS g, page_id // {PER_LIST} AS o, {SITE_CITY} AS city FROM pages),
        town AS (SELECT * FROM (VALUES (0, 'chicago'), (1, 'new york city'), (2, 'boston')) v(g, city)),
        lists AS (SELECT DISTINCT g, o, city FROM p)
        SELECT {SITE} || '/Search?q=' || replace(city, ' ', '+') AS url, city, -1 AS rule, 0 AS depth FROM town
        UNION ALL SELECT {SITE} || '/Tourism-g' || g || '.html', city, 2, 1 FROM town
        UNION ALL SELECT {SITE} || kind || g || '.html', city, 0, 2 FROM town CROSS JOIN (SELECT unnest(['/Hotels-g', '/Forum-g']) AS kind)
        UNION ALL SELECT {SITE} || '/Hotels-g' || g || '-o' || o || '.html', city, 3, 3 FROM lists
        UNION ALL SELECT {SITE} || '/Forum-g' || g || '-o' || o || '.html', city, 6, 3 FROM lists
        UNION ALL SELECT {SITE} || '/Hotel_Review-g' || page_id || '-d7-Reviews.html', city, 4, 4 FROM p WHERE {IS_REVIEW}
        UNION ALL SELECT {SITE} || '/ShowTopic-g' || page_id || '.html', city, 5, 4 FROM p WHERE {IS_THREAD}
        UNION ALL SELECT {SITE} || '/ExpandedUserReviews-g' || page_id || '-d7?target=' || page_id || '1&context=1&reviews=' || page_id
          || '1,' || page_id || '2&servlet=g' || page_id || '-d7Hotel_Review&expand=1', city, -2, 5 FROM p WHERE {IS_REVIEW}""",
    "click_targets": """SELECT p_partkey, 'open(''http://www.tripadvisor.com/Tourism-g' || p_partkey || '.html' AS link FROM part""",
    "forum_posts": f"""WITH {LINES} SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(position AS INTEGER) AS position,
          CASE doc_id % 3 WHEN 0 THEN 'chicago' ELSE 'new york' END AS city,
          CASE doc_id % 3 WHEN 0 THEN 'chicago | ' ELSE 'new york: ' END || doc_id AS topic,
          {clean_forum("CASE WHEN line = '' THEN 'end' ELSE line || ' end' END")} AS text, 'Place ' || position AS geo,
          CASE position % 3 WHEN 0 THEN '2015-03-10 13:05:00' WHEN 1 THEN '2015-03-09 23:59:00'
            ELSE '2015-03-07 09:30:00' END AS date
        FROM lines WHERE doc_id % 3 < 2""",
    "review_posts": f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang AS city, 'Title ' || doc_id AS title,
          {clean_review("text || ' second part'")} AS text, 'Town, ' || lang AS geo,
          CASE doc_id % 3 WHEN 0 THEN '2014-04-02 00:00:00' ELSE '2013-05-12 00:00:00' END AS date
        FROM documents WHERE doc_id % 3 < 2""",
    "thread_posts": f"""SELECT conv_id || '/' || turn AS url, role AS city, 'Talk ' || conv_id AS title,
          {clean_review("replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || 'bye'")} AS text, role AS geo,
          '2016-01-' || lpad(CAST(turn % 28 + 1 AS VARCHAR), 2, '0') || ' 19:05:00' AS date FROM conversations""",
    "site_links": f"""WITH l AS (SELECT p_partkey AS k, p_name, p_brand AS city, unnest([
            {{'rule': 0, 'link': '/hotels/1.html', 'link_text': 'Hotels'}}, {{'rule': 0, 'link': '/forum/1.html', 'link_text': 'Forum'}},
            {{'rule': 1, 'link': '/list/' || p_partkey || '.html', 'link_text': ''}},
            {{'rule': 2, 'link': '/Tourism-g' || p_partkey || '.html', 'link_text': 'x'}},
            {{'rule': 4, 'link': '/p/' || p_partkey || '.html', 'link_text': p_name}},
            {{'rule': 5, 'link': 'http://other.org/t.html', 'link_text': 'T'}},
            {{'rule': 6, 'link': '/p/2', 'link_text': '2'}}], recursive := true) FROM part)
        SELECT {SITE} || '/page/' || k AS url, city, rule,
          CASE WHEN starts_with(link, 'http') THEN link ELSE {SITE} || link END AS link, link_text FROM l""",
    "parse_dates": f"""WITH {ORDER_STAMPS} SELECT o_orderkey,
          CASE form WHEN 0 THEN {STAMP.format(x="try_strptime(strftime(at_time, '%b %-d, %Y, %-I:%M %p'), '%b %d, %Y, %I:%M %p')")}
            WHEN 1 THEN {STAMP.format(x='at_time')} WHEN 2 THEN {STAMP.format(x='at_time - INTERVAL 1 DAY')} END AS forum_time,
          CASE WHEN form < 2 THEN {STAMP.format(x='day')} END AS review_date,
          CASE WHEN form < 4 THEN {STAMP.format(x='at_time')} END AS post_date,
          CASE WHEN form < 4 THEN strftime(at_time + to_milliseconds(o_orderkey % 1000), '%Y-%m-%d %H:%M:%S.%g') END AS millis_date
        FROM made""",
    "json_events": """SELECT event_id, CASE WHEN event_id % 5 > 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
          CASE WHEN event_id % 5 > 0 THEN json_extract_string(props, '$.k') END AS k_text FROM events""",
    "tweet_rows": """SELECT text, conv_id * 1000000 + turn AS millis, 'en' AS lang, role AS location FROM conversations
        WHERE turn % 7 <> 6""",
    "bad_tweet_rows": "SELECT '{broken ' || conv_id AS line FROM conversations WHERE turn % 7 = 6",
    "stream_posts": f"""SELECT conv_id, turn, role, city FROM (
          SELECT conv_id, turn, role, unnest({WORDS}) AS city FROM conversations) WHERE city IN ({listed(CITIES)})""",
    "tweet_stream": f"""WITH {TRAINING},
        tweet AS (SELECT conv_id * 1000000 + turn AS id, conv_id, {TRACK_TEXT} AS text FROM conversations WHERE conv_id % 7 < 5),
        w AS (SELECT *, regexp_extract_all(lower(text), '([#@]?[\\p{{L}}\\p{{N}}_]+)', 1) AS words FROM tweet),
        f AS (SELECT *, list_distinct(list_concat(words, list_transform(words, lambda x: ltrim(x, '#@')))) AS forms FROM w),
        tracked AS (SELECT id, conv_id, text FROM f WHERE {TRACKED}),
        talk AS (SELECT id, {CLEAN} AS words FROM tracked), {scored('talk', 'id')},
        place_of AS (SELECT id, {LOCATION.format(id='conv_id')} AS geo FROM tracked LEFT JOIN part ON p_partkey = conv_id),
        {located('place_of')},
        mention AS (SELECT id, text, city FROM (SELECT id, text, unnest({WORDS}) AS city FROM tracked)
                    WHERE city IN ({listed(c.lower() for c in TRACK_CITIES)}))
        SELECT city, text, id AS millis, geo_city, geo_country, geo_continent, sentiment
        FROM mention JOIN resolved USING (id) JOIN labelled USING (id)""",
    "tweet_stream_bad": f"""SELECT CASE WHEN conv_id % 7 = 5 THEN {TRACK_TEXT} END AS text FROM conversations
        WHERE conv_id % 7 >= 5""",
    "stream_dedupe": "SELECT DISTINCT user_id FROM events",
    "stream_stats": " UNION ALL ".join(f"""SELECT * FROM (WITH {POSTS.replace('SELECT', 'SELECT doc_id % 3 AS part,', 1)},
        {STATS.replace('FROM posts', f'FROM posts WHERE part <= {b}')} SELECT resource, city, sentiment, level, geo, n, {b} AS batch FROM counted)"""
        for b in range(3)),
    "merged_posts": f"""WITH {POSTS}, {STATS} SELECT resource, city, sentiment, level, geo, n, phase
        FROM counted CROSS JOIN (SELECT unnest(['before', 'after']) AS phase)""",
    "enriched_posts": f"""WITH {TRAINING}, {scored('tok', 'doc_id')}, {MENTIONS}, {located('place_of')}
        SELECT m.doc_id, m.city, count(*) AS mentions, any_value(geo_city) AS geo_city, any_value(geo_country) AS geo_country,
          any_value(geo_continent) AS geo_continent, any_value(sentiment) AS sentiment
        FROM mention m JOIN resolved r USING (doc_id) JOIN labelled USING (doc_id) GROUP BY m.doc_id, m.city""",
    "post_report": f"""WITH {TRAINING}, {scored('tok', 'doc_id')}, {MENTIONS}, {located('place_of')},
        posts AS (SELECT 'TWITTER' AS resource, m.city, geo_city, geo_country, geo_continent, sentiment
          FROM mention m JOIN resolved USING (doc_id) JOIN labelled USING (doc_id)), {dense(CITIES)}
        SELECT resource, city, sentiment, level, geo, n FROM dense""",
}
ORACLES["nb_classify_shuffled"] = ORACLES["nb_classify"]
WHITE = "list_filter(regexp_split_to_array(text, '[\\s\\p{Z}]+'), lambda w: w <> '')"
MANY = "lang || CAST(doc_id % 9 AS VARCHAR)"
ORACLES["nb_many_labels"] = f"""WITH {TRAINING.replace(TOK, TOK.replace('SELECT doc_id', 'SELECT doc_id, lang')).replace(LABEL, MANY)},
    {scored('tok', 'doc_id')} SELECT doc_id, arg_max(label, (score, label)) AS label, max(score) AS score FROM scores GROUP BY doc_id"""
ORACLES["whitespace_classify"] = f"""WITH {TRAINING.replace(CLEAN, WHITE)}, {scored('tok', 'doc_id')}
    SELECT doc_id, sentiment AS label FROM labelled"""
NAMED = "FROM documents LEFT JOIN part ON p_partkey = doc_id"
ORACLES |= {
    "phrase_table": f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(concat_ws(' ', text, p_name)), '([#@]?[\\p{{L}}\\p{{N}}_]+)', 1) AS words {NAMED}),
        f AS (SELECT doc_id, list_distinct(list_concat(words, list_transform(words, lambda x: ltrim(x, '#@')))) AS forms FROM w),
        phrases AS (SELECT regexp_extract(text, '^([a-zA-Z]+ [a-zA-Z]+)', 1) AS phrase FROM documents UNION SELECT p_name FROM part)
        SELECT doc_id, phrase FROM f JOIN phrases ON phrase <> '' AND list_has_all(forms, string_split(lower(phrase), ' '))""",
    "city_table": f"""WITH t AS (SELECT doc_id, concat_ws(' ', text, upper(p_name)) AS text {NAMED}),
        w AS (SELECT doc_id, {WORDS} AS words FROM t),
        names AS (SELECT lower(p_name) AS city FROM part UNION SELECT lower(split_part(p_name, ' ', 1)) FROM part),
        runs AS (SELECT doc_id, unnest(words) AS city FROM w
          UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM w)
        SELECT doc_id, city FROM runs SEMI JOIN names USING (city)""",
    "topic_table": """WITH city AS (SELECT list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS city FROM part
          UNION SELECT substr(p_name, 1, 4) FROM part UNION SELECT substr(n_name, 1, 2) FROM nation)
        SELECT p_partkey, city FROM part JOIN city ON starts_with(lower(p_name), lower(city))""",
    "corpus_csv": f"SELECT text, {LABEL} AS label FROM documents JOIN labels USING (doc_id)",
    "geonames_scan": """SELECT p_partkey AS geoname_id, p_name AS name,
        array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS asciiname,
        CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size AS BIGINT) END AS population, substr(p_brand, 1, 2) AS country_code FROM part""",
    "country_continents": """SELECT 'N' || n_nationkey AS country_code, CASE r_name WHEN 'AFRICA' THEN 'Africa' WHEN 'AMERICA' THEN 'North America'
        WHEN 'ASIA' THEN 'Asia' WHEN 'EUROPE' THEN 'Europe' END AS continent FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "stored_pages": "SELECT url, length(html) AS n_chars FROM pages WHERE page_id % 3 > 0 AND html LIKE '%<%'",
    "feature_maps": f"""WITH {TOK}, f AS (SELECT doc_id, len(list_distinct(list_concat(words, {PAIRS}))) AS n FROM tok)
        SELECT doc_id, n AS n_features, n AS n_true FROM f""",
    "hooked_posts": f"""WITH {MENTIONS} SELECT doc_id, city, NULL AS geo_city, NULL AS sentiment, count(*) AS mentions
        FROM mention JOIN documents USING (doc_id) WHERE length(documents.text) >= 200 GROUP BY doc_id, city""",
    "undated_reviews": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang AS city, 'long ago' AS date_text, NULL AS date FROM documents WHERE doc_id % 3 = 2",
}
ORACLES["source_report"] = f"""WITH {TRAINING.replace("WHERE " + LABEL, "WHERE doc_id % 2 = 1 AND " + LABEL)},
    item AS (
      SELECT 'r' || doc_id AS id, 'TRIPADVISOR' AS resource, city, text, geo FROM ({ORACLES['review_posts']})
      UNION ALL SELECT 't' || url, 'TRIPADVISOR', city, text, geo FROM ({ORACLES['thread_posts']})
      UNION ALL SELECT 'f' || doc_id || '/' || position, 'SKYSCRAPER', city, text, geo FROM ({ORACLES['forum_posts']})),
    talk AS (SELECT id, {CLEAN} AS words FROM item), {scored('talk', 'id')},
    place_of AS (SELECT id, geo FROM item), {located('place_of')},
    posts AS (
      SELECT 'TWITTER' AS resource, city, geo_city, geo_country, geo_continent, sentiment FROM ({ORACLES['tweet_stream']})
      UNION ALL SELECT resource, lower(city), geo_city, geo_country, geo_continent, sentiment
      FROM item JOIN resolved USING (id) JOIN labelled USING (id)), {dense(SOURCE_CITIES)}
    SELECT resource, city, sentiment, level, geo, n FROM dense"""
