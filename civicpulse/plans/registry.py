"""The registered queries: every operator on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..params import FORUM_URL, Parameters
from ..operators import bayes, geo, links, match, pages, sites, stats
from ..session import run_dir, shared_dir
from ..sources import readers, writers
from ..streaming import ingest
from ..streaming.cells import CellStore
from . import posts as flow
from . import storedsites
from .inputs import (
    ASKED_CITIES, CITIES, SOURCE_CITIES, DOMAINS, HASHTAGS, LANGUAGES, LOCATION, PHRASE_CITIES, SITE_SECTION, TOPIC_CITIES,
    TRACK_CITIES, TRACK_TEXT, Tables, escaped,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
    return build


def stamp(column) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# ---- posts kept, and their cities -------------------------------------------------

@query
def city_mentions(t):
    return match.city_mentions(t.documents, CITIES).select("doc_id", "lang", "city")


@query
def city_phrases(t):
    return match.city_mentions(t.documents, PHRASE_CITIES, phrase_match=True).select("doc_id", "city")


@query
def track_filter(t):
    docs = t.documents.select("doc_id", "lang", F.expr(TRACK_TEXT).alias("text"))
    kept = match.track_filter(docs, match.phrase_list(HASHTAGS, TRACK_CITIES))
    return match.language_filter(kept, LANGUAGES).select("doc_id", "lang")


@query
def phrase_table(t):
    """Texts by a table of phrases: the first two words of every document, and all part names."""
    named = t.documents.join(
        t.part.select(F.col("p_partkey").alias("doc_id"), "p_name"), "doc_id", "left").select(
        "doc_id", F.concat_ws(" ", "text", "p_name").alias("text"))
    first = F.regexp_extract("text", r"^([a-zA-Z]+ [a-zA-Z]+)", 1)
    phrases = t.documents.select(first.alias("phrase")).unionByName(t.part.select(F.col("p_name").alias("phrase")))
    return match.tracked_phrases(named, phrases, "doc_id")


@query
def city_table(t):
    """Occurrences in texts of the names of a table: part names, and their first words."""
    named = t.documents.join(
        t.part.select(F.col("p_partkey").alias("doc_id"), "p_name"), "doc_id", "left").select(
        "doc_id", F.concat_ws(" ", "text", F.upper("p_name")).alias("text"))
    cities = t.part.select(F.explode(F.array("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("city"))
    return match.city_mentions_by(named, cities).select("doc_id", "city")


@query
def topic_table(t):
    """Part names as topics of cities of a table: nation names cut short, and part names."""
    cities = t.part.select(F.explode(F.array(F.initcap("p_name"), F.substring("p_name", 1, 4))).alias("city"))
    cities = cities.unionByName(t.nation.select(F.substring("n_name", 1, 2).alias("city")))
    topics = t.part.select("p_partkey", F.lower("p_name").alias("topic"))
    return match.topic_cities_by(topics, cities).select("p_partkey", "city")


@query
def topic_prefix(t):
    topics = t.pages.select(
        "page_id", text.clean_topic(pages.first_element_text(F.col("html"), "h1")).alias("topic"))
    return match.topic_cities(topics, TOPIC_CITIES).select("page_id", "city", "topic")


# ---- text -------------------------------------------------------------------------

def token_columns(tokens):
    return F.size(tokens).alias("n_tokens"), F.array_join(tokens, " ").alias("tokens")


@query
def tokens(t):
    found = t.documents.select("doc_id", text.raw_tokens(F.col("text")).alias("k"))
    return found.select("doc_id", *token_columns(F.col("k")))


@query
def clean_tokens(t):
    found = t.documents.select("doc_id", text.tokenize(F.col("text")).alias("k"))
    return found.select("doc_id", *token_columns(F.col("k")))


@query
def cased_tokens(t):
    found = t.documents.select("doc_id", text.tokenize(F.col("text"), preserve_case=True).alias("k"))
    return found.select("doc_id", *token_columns(F.col("k")))


@query
def bigram_counts(t):
    return bayes.pair_counts(t.documents)


@query
def entity_decode(t):
    extra = F.lit(" &#8364;&#233; &#38;lt; &bogus; &#99999999; &#55296;")
    decoded = text.decode_entities(F.concat("html", extra))
    title = pages.first_element_text(F.col("html"), "h1")
    return t.pages.select(
        "page_id", F.md5(decoded).alias("html_md5"), F.length(decoded).alias("n_chars"),
        text.decode_entities(title).alias("title"),
        text.decode_entities(title, strict=True).alias("title_strict"))


# ---- sentiment --------------------------------------------------------------------

@query
def nb_prior(t):
    return bayes.prior_table(t.corpus()).select("label", "n", "logp_nano")


@query
def nb_likelihood(t):
    return bayes.train(t.corpus()).likelihood().select("label", "feature", "n", "logp_nano")


def trained(t: Tables) -> bayes.Model:
    """Train, save, and load back: the saved model knows its size."""
    folder = run_dir(t.spark, "models")
    writers.save_model(bayes.train(t.corpus()), folder, "documents")
    return readers.load_model(t.spark, folder, "documents")


@query
def nb_classify(t):
    return bayes.score(t.documents.select("doc_id", "text"), trained(t), "doc_id")


@query
def nb_classify_shuffled(t):
    """The same scores by the way that a model too large to broadcast takes."""
    model = bayes.train(t.corpus())
    return bayes.score(t.documents.select("doc_id", "text"), model, "doc_id")


def many_labels(t: Tables) -> DataFrame:
    """The labelled documents with their language and last digits as label."""
    marks = F.concat("lang", (F.col("doc_id") % 9).cast("string"))
    return t.documents.join(t.labels.select("doc_id"), "doc_id").select("doc_id", "text", marks.alias("label"))


@query
def nb_many_labels(t):
    """Labels of documents among many: only pairs that occur are stored and added up."""
    model = bayes.train_sparse(many_labels(t))
    return bayes.score_sparse(t.documents.select("doc_id", "text"), model, "doc_id")


@query
def text_sentiment(t):
    """Labels without a row id: copies of a text are scored once."""
    return bayes.classify(
        t.conversations.select("conv_id", "turn", "text"), trained(t)
    ).select("conv_id", "turn", "sentiment")


@query
def informative_features(t):
    return bayes.informative_features(bayes.train(t.corpus())).select("feature", "log_ratio_nano")


# ---- geography --------------------------------------------------------------------

@query
def clean_location(t):
    return t.customer_locations().select(
        "c_custkey", "geo", text.clean_location(F.col("geo")).alias("place"),
        text.clean_location(F.col("geo"), strict=True).alias("place_strict"))


@query
def best_place(t):
    keys = geo.with_place_key(t.customer_locations()).where("place_key is not null")
    return geo.best_places(keys.select("place_key").distinct(), t.gazetteer()).select(
        "place_key", "geoname_id")


@query
def geo_enrich(t):
    located = geo.enrich_locations(t.customer_locations(), t.gazetteer(), t.continents())
    return located.select("c_custkey", F.col("geo.city").alias("geo_city"),
                          F.col("geo.country").alias("geo_country"),
                          F.col("geo.continent").alias("geo_continent"))


# ---- counts -----------------------------------------------------------------------

@query
def post_stats(t):
    return stats.sparse_stats(stats.cells(t.posts()))


@query
def post_stats_dense(t):
    return stats.stats_for(t.posts(), ASKED_CITIES)


@query
def post_stats_city(t):
    return stats.stats_for(t.posts(), "SRC3")


@query
def post_totals(t):
    return stats.post_totals(stats.cells(t.posts()))


@query
def geo_values(t):
    return stats.geo_values(stats.cells(t.posts()))


@query
def subject_cities(t):
    return stats.all_cities(stats.cells(stats.posts_of(t.posts(), "twitter")))


@query
def post_count(t):
    return stats.count_posts(t.posts(), "src3", "positive", {"country": None})


@query
def stats_json(t):
    """Every source and city, cell by cell, zeros included."""
    shared_dir(t.spark)
    return stats.stats_documents(stats.dense_stats_of_all(stats.cells(t.posts()).checkpoint()))


@query
def stats_nested(t):
    """The cells that occur as one nested document, in fragments."""
    return stats.stats_fragments(stats.stats_documents(stats.sparse_stats(stats.cells(t.posts()))))


# ---- pages ------------------------------------------------------------------------

@query
def page_titles(t):
    return t.pages.select(
        "page_id", text.clean_topic(pages.first_element_text(F.col("html"), "h1")).alias("title"))


@query
def page_posts(t):
    found = pages.element_texts(F.col("html"), "p")
    return t.pages.select("page_id", F.posexplode_outer(found).alias("position", "text")).where(
        F.col("position").isNotNull())


@query
def page_links(t):
    found = t.pages.select("page_id", F.posexplode_outer(pages.anchors(F.col("html"))).alias("position", "a"))
    return found.where(F.col("a").isNotNull()).select("page_id", "position", "a.link", "a.link_text")


@query
def first_rule_links(t):
    found = t.pages.select("page_id", F.explode_outer(pages.anchors(F.col("html"))).alias("a"))
    link = found.where(F.col("a").isNotNull()).select("page_id", "a.link", "a.link_text")
    rules = F.array(
        F.when(F.length("link_text") <= 3, 0), F.when(F.col("link_text").rlike("[aeiou]$"), 1), F.lit(2))
    ruled = link.withColumn("rule", F.explode(F.filter(rules, F.isnotnull)))
    return links.first_rule(ruled)


@query
def url_dedupe(t):
    section = lambda url: F.regexp_replace(urls.without_query(url), SITE_SECTION, "")
    return links.first_seen(t.pages, "page_id", normalize=section).select("page_id", "url")


@query
def unseen_urls(t):
    """Pages that the site's first pages have not shown yet."""
    listed = t.pages.select("page_id", urls.without_query(F.col("url")).alias("url"))
    seen = listed.where("page_id % 5 = 0")
    return links.unseen(listed, seen).select("page_id", "url")


@query
def domain_filter(t):
    return links.in_domains(t.pages, DOMAINS).select("page_id", "url")


@query
def city_propagation(t):
    seeds = links.seed_cities(t.nation.select(
        urls.search_url(F.lower(F.replace("n_name", F.lit("_"), F.lit(" ")))).alias("url"), "n_nationkey"))
    start = t.nation.select(
        urls.search_url(F.lower(F.replace("n_name", F.lit("_"), F.lit(" ")))).alias("src"),
        F.concat(F.lit("c/"), F.col("n_nationkey").cast("string")).alias("dst"))
    return links.propagate_cities(seeds, t.edges().unionByName(start))


@query
def search_urls(t):
    city = F.concat(F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))), F.lit(" city"))
    made = t.nation.select("n_nationkey", urls.search_url(city).alias("url"))
    other = t.pages.select(F.col("page_id").alias("n_nationkey"), "url")
    return made.unionByName(other.select(F.col("n_nationkey").cast("int"), "url")).select(
        "n_nationkey", "url", urls.search_city(F.col("url")).alias("city"),
        urls.search_city(F.col("url"), strict=True).alias("city_strict"))


@query
def detail_urls(t):
    review = lambda i: F.concat(
        F.lit('<div class="x reviewSelector" id="review_'),
        (F.col("page_id") * 10 + i).cast("string"), F.lit('"></div>'))
    reviews = F.transform(F.sequence(F.lit(0), F.col("page_id") % 4), review)
    site = F.concat(F.lit("http://www.tripadvisor.com/Hotel_Review-g"), F.col("page_id").cast("string"),
                    F.lit("-d7-Reviews.html"))
    listed = t.pages.select(
        "page_id", F.when(F.col("page_id") % 3 > 0, site).otherwise(F.col("url")).alias("url"),
        F.concat("html", F.when(F.col("page_id") % 4 > 0, F.array_join(reviews, "")).otherwise("")).alias("html"))
    return pages.detail_requests(listed)


@query
def click_targets(t):
    value = F.concat(F.lit("open('http://www.tripadvisor.com/s/Tourism-g"), F.col("p_partkey").cast("string"),
                     F.lit(".html', '"), F.col("p_name"), F.lit("')"))
    return t.part.select("p_partkey", urls.rewrite_click_target(value).alias("link"))


AS_OF = "2015-03-10 08:00:00"


def forum_pages(t: Tables) -> DataFrame:
    """Every document as a forum thread, every line as a post."""
    line = lambda body, i: F.concat(
        F.lit('<table id="post'), i.cast("string"), F.lit('"><tr><td class="thead"><div><span><span><b>'),
        F.when(i % 3 == 0, "Today, 1:05 PM").when(i % 3 == 1, "Yesterday, 11:59 PM")
        .otherwise("Mar 7, 2015, 9:30 AM"),
        F.lit('</b></span></span></div></td></tr><tr><td class="alt2"><table><tr><td valign="top"><div>'
              '<div>Join Date: 2001</div><div>Posts: 5\nLocation: Place '), i.cast("string"),
        F.lit('<br>x</div></div></td></tr></table></td><td><div id="post_message_'), i.cast("string"),
        F.lit('">'), body, F.lit("<br><i>quote</i>end</div></td></tr></table>"))
    page = F.concat(
        F.lit('<html><body><table><tr><td class="alt1"><table><tr><td class="navbar"><strong>\n\t'),
        F.when(F.col("doc_id") % 3 == 0, "Chicago | ").when(F.col("doc_id") % 3 == 1, "New York: ")
        .otherwise("Old Boston "), F.col("doc_id").cast("string"),
        F.lit("\n</strong></td></tr></table></td></tr></table>"),
        F.array_join(F.transform(F.split(F.col("body"), "\n"), line), ""), F.lit("</body></html>"))
    return t.documents.select("doc_id", escaped("text").alias("body")).select(
        F.col("doc_id").cast("string").alias("url"), page.alias("html"))


@query
def forum_posts(t):
    found = pages.forum_items(forum_pages(t), as_of=F.lit(AS_OF).cast("timestamp"))
    return found.select(F.col("url").alias("doc_id"), "position", "city", "topic", "text", "geo",
                        stamp("date").alias("date"))


def review_pages(t: Tables) -> DataFrame:
    """Every document as one review, with the date as attribute, as text, or missing."""
    page = F.concat(
        F.lit('<div id="expanded_review_1"><span class="noQuotes">Title '), F.col("doc_id").cast("string"),
        F.lit('</span><div class="location">Town, '), F.col("lang"), F.lit('</div><span class="ratingDate"'),
        F.when(F.col("doc_id") % 3 == 0, ' title="April 2, 2014">on time').when(
            F.col("doc_id") % 3 == 1, ">Reviewed May 12, 2013 by phone").otherwise(">long ago"),
        F.lit('</span><div class="entry"><p>'), F.col("body"), F.lit("<p>second<b>bold</b>part</div></div>"))
    return t.documents.select("doc_id", "lang", escaped("text").alias("body")).select(
        F.col("doc_id").cast("string").alias("url"), page.alias("html"), F.col("lang").alias("city"))


@query
def review_posts(t):
    return pages.dated(pages.review_items(review_pages(t))).select(
        F.col("url").alias("doc_id"), "city", "title", "text", "geo", stamp("date").alias("date"))


def thread_pages(t: Tables) -> DataFrame:
    """Every conversation turn as a travel-forum post."""
    page = F.concat(
        F.lit('<h1 id="HEADING">Talk '), F.col("conv_id").cast("string"),
        F.lit('</h1><div class="post first"><div class="postDate"><span>Jan '),
        (F.col("turn") % 28 + 1).cast("string"), F.lit(', 2016, 7:05 PM</span></div><div class="location">'),
        F.col("role"), F.lit('</div><div class="postBody"><p>'), F.col("body"),
        F.lit("</p><p>bye</p></div></div>"))
    return t.conversations.select(
        F.concat_ws("/", "conv_id", "turn").alias("url"), escaped("text").alias("body"),
        "conv_id", "turn", "role").select("url", page.alias("html"), F.col("role").alias("city"))


@query
def thread_posts(t):
    return pages.thread_items(thread_pages(t)).select(
        "url", "city", "title", "text", "geo", stamp("date").alias("date"))


@query
def site_links(t):
    """Every part as a result page of a review site, searched by the site's rules."""
    number = F.col("p_partkey").cast("string")
    page = F.concat(
        F.lit('<head><link rel="next" href="/list/'), number, F.lit('.html"></head><ul class="navLinks">'
              '<li><a href="/hotels/1.html">Hotels</a><li><a href="/forum/1.html"><b>Forum</b></a></ul>'
              '<div class="srch result GEOS"><div onclick="http://www.tripadvisor.com/s/Tourism-g'), number,
        F.lit('.html?x=1">x</div></div><div class="property_title"><a href="/hotels/1.html">Hotels</a>'
              '<a href="/p/'), number, F.lit('.html">'), F.col("p_name"),
        F.lit('</a></div><table class="t topics"><tr><td>1<td><b><a href="http://other.org/t.html">T</a></b>'
              '</table><div class="pgLinks"><a href="/p/2">2</a></div><a href="/no">No</a>'))
    listed = t.part.select(
        F.concat(F.lit("http://www.tripadvisor.com/page/"), number).alias("url"), page.alias("html"),
        F.col("p_brand").alias("city"))
    return links.requests(listed, links.REVIEW_RULES).select("url", "city", "rule", "link", "link_text")


def site_items(t: Tables) -> dict[str, DataFrame]:
    """Both stored sites from their start urls to items, by source."""
    found, _ = sites.crawled(storedsites.start_urls(t), storedsites.review_site(t), sites.REVIEW_SITE)
    talk, _ = sites.crawled(
        t.spark.createDataFrame([(f"{FORUM_URL}/", None)], "url string, city string"), storedsites.forum_site(t), sites.FORUM_SITE)
    columns = ("city", "text", "geo", "date")
    reviews = pages.dated(pages.review_posts(found.where("layout = 'review'"))).select(*columns)
    threads = pages.thread_posts(found.where("layout = 'thread'")).select(*columns)
    return {"TRIPADVISOR": reviews.unionByName(threads),
            "SKYSCRAPER": pages.forum_posts(talk, as_of=F.lit(AS_OF).cast("timestamp")).select(*columns)}


@query
def site_posts(t):
    """Posts of two sites, from search pages and an index through their rules to the fixpoint."""
    parts = [rows.select(F.lit(resource).alias("resource"), "city", "text", "geo", stamp("date").alias("date"))
             for resource, rows in site_items(t).items()]
    return parts[0].unionByName(parts[1])


@query
def site_requests(t):
    """Every url that the review site's rules request, with city, rule and round."""
    return sites.crawled(storedsites.start_urls(t), storedsites.review_site(t), sites.REVIEW_SITE)[1]


# ---- dates, events, streams -------------------------------------------------------

@query
def parse_dates(t):
    made = t.orders.select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("day"),
        F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
                            + F.col("o_orderkey") % 1440 * 60).alias("at"))
    clock = F.date_format("at", "h:mm a")
    form = F.col("o_orderkey") % 5
    shown = (F.when(form == 0, F.date_format("at", dates.POST_LAYOUT))
             .when(form == 1, F.concat(F.lit("Today, "), clock))
             .when(form == 2, F.concat(F.lit("Yesterday, "), clock))
             .when(form == 3, F.concat(F.lit("Yesterday at "), clock))
             .otherwise(F.date_format("at", "d/M/yyyy")))
    day_text = F.date_format("day", dates.REVIEW_LAYOUT)
    title = F.when(form == 0, day_text)
    body = F.when(form == 1, F.concat(F.lit("Reviewed "), day_text, F.lit(" via mobile"))).when(
        form == 2, F.concat(F.lit("Visited "), day_text))
    millis = (F.unix_millis("at") + F.col("o_orderkey") % 1000).cast("string")
    return made.select(
        "o_orderkey", stamp(dates.forum_time(shown, F.col("day"))).alias("forum_time"),
        stamp(dates.review_date(title, body)).alias("review_date"),
        stamp(dates.post_date(F.when(form < 4, F.date_format("at", dates.POST_LAYOUT)).otherwise("soon")))
        .alias("post_date"),
        F.date_format(dates.epoch_millis(F.when(form < 4, millis).otherwise("n/a")), "yyyy-MM-dd HH:mm:ss.SSS")
        .alias("millis_date"))


@query
def json_events(t):
    """Event properties, a fifth of them cut short so that they do not parse."""
    raw = F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    parsed = F.from_json(raw, "k bigint", {"mode": "PERMISSIVE"})
    return t.events.select("event_id", parsed["k"].alias("k"), F.get_json_object(raw, "$.k").alias("k_text"))


def conversation_lines(t: Tables) -> DataFrame:
    """Conversation turns as tweet lines; every seventh line of a turn number is broken."""
    tweet = F.to_json(F.struct(
        "text", (F.col("conv_id") * 1_000_000 + F.col("turn")).cast("string").alias("timestamp_ms"),
        F.lit("en").alias("lang"), F.struct(F.col("role").alias("location")).alias("user")))
    broken = F.concat(F.lit("{broken "), F.col("conv_id").cast("string"))
    return t.conversations.select(F.when(F.col("turn") % 7 == 6, broken).otherwise(tweet).alias("value"))


@query
def tweet_rows(t):
    good = readers.good_tweets(readers.parse_tweets(conversation_lines(t)))
    return good.select("text", F.unix_millis("date").alias("millis"), "lang", "location")


@query
def bad_tweet_rows(t):
    bad = readers.bad_tweets(readers.parse_tweets(conversation_lines(t)))
    return bad.select(F.col(readers.CORRUPT).alias("line"))


@query
def stream_posts(t):
    """Conversation turns replayed as a stream into stored posts, then read back."""
    source = t.stream("conversations")

    def to_rows(batch):
        return match.city_mentions(batch, CITIES).select(
            F.lit("TWITTER").alias("resource"), "city", "conv_id", "turn", "role")

    folder = run_dir(t.spark, "stream")
    ingest.start_ingest(source, to_rows, f"{folder}/posts", f"{folder}/state", available_now=True
                        ).awaitTermination()
    stored = t.spark.read.schema("city string, conv_id bigint, turn bigint, role string").parquet(f"{folder}/posts")
    return stored.select("conv_id", "turn", "role", "city")


def tweet_lines(t: Tables) -> DataFrame:
    """Conversation turns as lines of a tweet stream, with keywords and author locations.

    Of seven conversations one has broken lines and one has lines without a readable time.
    """
    names = t.part.select(F.col("p_partkey").alias("conv_id"), "p_name", "p_brand")
    number = F.col("conv_id") % 7
    millis = (F.col("conv_id") * 1_000_000 + F.col("turn")).cast("string")
    tweet = F.to_json(F.struct(
        F.expr(TRACK_TEXT).alias("text"), F.when(number == 5, "soon").otherwise(millis).alias("timestamp_ms"),
        F.lit("en").alias("lang"),
        F.struct(F.expr(LOCATION.format(id="conv_id")).alias("location")).alias("user")))
    broken = F.concat(F.lit("{broken "), millis)
    return t.conversations.join(names, "conv_id", "left").select(
        "conv_id", F.when(number == 6, broken).otherwise(tweet).alias("value"))


PARAMS = Parameters(hashtags=HASHTAGS, stream_cities=TRACK_CITIES, languages=LANGUAGES)


def streamed_tweets(t: Tables) -> str:
    """The tweet stream from lines to stored posts, stopped halfway and resumed."""
    folder, lines, model = run_dir(t.spark, "tweets"), tweet_lines(t), trained(t)
    for half in (0, 1):
        lines.where(F.col("conv_id") % 2 == half).select("value").write.mode("append").text(f"{folder}/in")
        ingest.start_tweets(
            readers.stream_tweet_lines(t.spark, f"{folder}/in"), PARAMS, t.gazetteer(), t.continents(), model,
            f"{folder}/posts", f"{folder}/state", quarantine=f"{folder}/bad", available_now=True,
        ).awaitTermination()
    return folder


@query
def tweet_stream(t):
    """Stored posts of the whole stream: filters, mentions, geography and sentiment."""
    return readers.read_posts(t.spark, f"{streamed_tweets(t)}/posts", "twitter").select(
        "city", "text", F.unix_millis("date").alias("millis"), F.col("geo.city").alias("geo_city"),
        F.col("geo.country").alias("geo_country"), F.col("geo.continent").alias("geo_continent"), "sentiment")


@query
def tweet_stream_bad(t):
    """Quarantine of the whole stream: the texts of bad lines, null for lines that are not JSON."""
    bad = t.spark.read.parquet(f"{streamed_tweets(t)}/bad")
    return bad.select(F.get_json_object(readers.CORRUPT, "$.text").alias("text"))


BATCHES = 3


def batched_posts(t: Tables, after_batch: Callable[[str, CellStore, int], None] | None = None) -> tuple[str, CellStore]:
    """Posts that arrive in three batches by document number, stored and counted as they come."""
    folder = run_dir(t.spark, "batches")
    cells = CellStore(t.spark, f"{folder}/cells", merge_every=2)
    rows = t.posts("doc_id").select(
        "doc_id", "resource", "city", F.timestamp_seconds(F.col("doc_id") % 5 * 86400).alias("date"),
        F.lit(None).cast("string").alias("text"), "geo", "sentiment")
    for part in range(BATCHES):
        rows.where(F.col("doc_id") % BATCHES == part).write.mode("append").parquet(f"{folder}/in")
        source = t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        ingest.start_ingest(source, lambda batch: batch.drop("doc_id"), f"{folder}/posts", f"{folder}/state",
                            available_now=True, cells=cells).awaitTermination()
        if after_batch:
            after_batch(folder, cells, part)
    return f"{folder}/posts", cells


@query
def stream_stats(t):
    """The counts as they stand after each of three batches, the second of which is replayed."""
    def report(folder: str, cells: CellStore, part: int) -> None:
        if part == 1:
            cells.add(readers.read_batch_posts(t.spark, f"{folder}/posts", part), part)
        stats.sparse_stats(cells.cells()).withColumn("batch", F.lit(part)).write.mode("append").parquet(f"{cells.path}-reports")

    _, cells = batched_posts(t, report)
    return t.spark.read.parquet(f"{cells.path}-reports")


@query
def merged_posts(t):
    """The counts of the stored posts before and after a merge.  An earlier merge holds the
    first two batches, the second of which is replayed behind it."""

    def merge(folder: str, cells: CellStore, part: int) -> None:
        if part == 1:
            again = readers.read_batch_posts(t.spark, f"{folder}/posts", part).checkpoint()
            writers.merge_posts(t.spark, f"{folder}/posts", part)
            writers.write_batch_posts(again, f"{folder}/posts", part)

    def counted(phase: str) -> DataFrame:
        posts = readers.read_posts(t.spark, path)
        return stats.sparse_stats(stats.cells(posts)).withColumn("phase", F.lit(phase))

    path, _ = batched_posts(t, merge)
    before = counted("before").checkpoint()
    writers.merge_posts(t.spark, path, BATCHES - 1)
    return before.unionByName(counted("after"))


@query
def stream_dedupe(t):
    """Users of the event stream, each once however late a row comes: three batches, the last
    of which brings all rows of the first again."""
    folder = run_dir(t.spark, "stream")
    parts = (F.col("user_id") % 2 == 0, F.lit(True), F.col("user_id") % 2 == 0)
    for part in parts:
        t.events.where(part).write.mode("append").parquet(f"{folder}/in")
        source = t.spark.readStream.schema(t.events.schema).parquet(f"{folder}/in")
        with ingest.state_on_disk(t.spark):
            users = ingest.dedupe_stream(source, "user_id").select("user_id")
            (users.writeStream.format("parquet").option("path", f"{folder}/users")
             .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination())
    return t.spark.read.parquet(f"{folder}/users")


# ---- sources of files -------------------------------------------------------------

@query
def corpus_csv(t):
    """The labelled corpus through a quoted CSV: commas, quotes and line breaks in texts."""
    folder = run_dir(t.spark, "corpus")
    writers.write_corpus(t.corpus(), folder)
    return readers.read_corpus(t.spark, folder)


@query
def geonames_scan(t):
    """Parts as lines of the published dump of places, a few without a readable population."""
    people = F.when(F.col("p_partkey") % 9 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    given = {"geonameid": F.col("p_partkey").cast("string"), "name": F.col("p_name"), "asciiname": F.initcap("p_name"),
             "country_code": F.substring("p_brand", 1, 2), "population": people}
    cells = [given.get(c, F.lit("")) for c in readers.GEONAMES_COLUMNS]
    folder = run_dir(t.spark, "geonames")
    t.part.select(F.concat_ws("\t", *cells).alias("value")).write.text(folder)
    return readers.read_geonames(t.spark, folder)


@query
def country_continents(t):
    """Nations as lines of the published country list, with its comments."""
    code = F.when(F.col("r_name") == "AMERICA", "NA").when(F.col("r_name") == "MIDDLE EAST", "??").otherwise(
        F.substring("r_name", 1, 2))
    given = {"iso": F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), "country": F.col("n_name"), "continent": code}
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat_ws("\t", *[given.get(c, F.lit("")) for c in readers.COUNTRY_COLUMNS]).alias("value"))
    folder = run_dir(t.spark, "countries")
    t.region.select(F.concat(F.lit("#"), "r_name").alias("value")).unionByName(rows).write.text(folder)
    return readers.read_country_continents(t.spark, folder)


@query
def stored_pages(t):
    """Pages stored and read back; of three one has no markup and one of them no text at all."""
    html = F.when(F.col("page_id") % 3 > 0, F.col("html")).when(F.col("page_id") % 2 == 0, F.lit("no markup"))
    folder = run_dir(t.spark, "pages")
    t.pages.select("url", html.alias("html"), F.lit(None).cast("string").alias("city")).write.parquet(folder)
    return links.with_markup(readers.read_pages(t.spark, folder)).select("url", F.length("html").alias("n_chars"))


@query
def feature_maps(t):
    """The feature set of each document as a map."""
    features = text.feature_map(text.tokenize(F.col("text")))
    found = t.documents.select("doc_id", features.alias("features"))
    return found.select("doc_id", F.size("features").alias("n_features"), F.size(
        F.map_filter("features", lambda _, there: there)).alias("n_true"))


@query
def whitespace_classify(t):
    """Model and labels over tokens between white space."""
    split = text.TOKENIZERS["whitespace"]
    model = bayes.train(t.corpus(), tokens=split)
    return bayes.score(t.documents.select("doc_id", "text"), model, "doc_id", tokens=split).select("doc_id", "label")


@query
def hooked_posts(t):
    """Posts of items that a user function has seen before they are processed."""
    hook = lambda items: items.where(F.length("text") >= 200).withColumn("geo", F.lit(None).cast("string"))
    found = flow.to_posts(document_items(t), "TWITTER", t.gazetteer(), t.continents(), key="doc_id", hook=hook)
    return found.groupBy("doc_id", "city", F.col("geo.city").alias("geo_city"), "sentiment").agg(F.count(F.lit(1)).alias("mentions"))


@query
def undated_reviews(t):
    """Quarantine of a review site: reviews whose date is none."""
    folder = run_dir(t.spark, "quarantine")
    writers.append_quarantine(flow.undated_reviews(review_pages(t)), folder)
    return t.spark.read.parquet(folder).select(F.col("url").alias("doc_id"), "city", "date_text", "date")


# ---- all together -----------------------------------------------------------------

def document_items(t: Tables) -> DataFrame:
    """Documents as items: one per mention of a city, with an author location."""
    names = t.part.select(F.col("p_partkey").alias("doc_id"), "p_name", "p_brand")
    located = t.documents.join(names, "doc_id", "left").select(
        "doc_id", "text", F.expr(LOCATION.format(id="doc_id")).alias("geo"))
    return match.with_mentions(located, CITIES).select(
        "doc_id", "cities", "text", "geo", F.lit(None).cast("timestamp").alias("date"))


@query
def enriched_posts(t):
    """Mentions, author geography and sentiment of all documents."""
    posts = flow.to_posts(
        document_items(t), "TWITTER", t.gazetteer(), t.continents(), trained(t), key="doc_id")
    return posts.groupBy(
        "doc_id", "city", F.col("geo.city").alias("geo_city"), F.col("geo.country").alias("geo_country"),
        F.col("geo.continent").alias("geo_continent"), "sentiment",
    ).agg(F.count(F.lit(1)).alias("mentions"))


@query
def post_report(t):
    """The whole way: items to posts to the zero-filled report."""
    posts = flow.to_posts(document_items(t), "TWITTER", t.gazetteer(), t.continents(), trained(t))
    return flow.report(posts, CITIES)


@query
def source_report(t):
    """Tweets, review pages and forum pages to one store and one report, each with its source's
    model; the models differ.  Reviews without a date go to quarantine."""
    folder = run_dir(t.spark, "sources")
    corpora = {"twitter": t.corpus(), "reviews": t.corpus().where("doc_id % 2 = 1")}
    for name, corpus in corpora.items():
        writers.save_model(bayes.train(corpus), f"{folder}/models", name)
    models = readers.load_models(t.spark, f"{folder}/models", PARAMS.models)
    tweets = readers.good_tweets(readers.parse_tweets(tweet_lines(t)))
    reviews, index = flow.stored_reviews(review_pages(t)), geo.place_index(t.gazetteer(), t.continents())
    items = {
        "TWITTER": flow.tweet_items(tweets, PARAMS),
        "TRIPADVISOR": flow.review_site_items(review_pages(t), thread_pages(t), reviews=reviews),
        "SKYSCRAPER": flow.forum_site_items(forum_pages(t), PARAMS, F.lit(AS_OF).cast("timestamp"))}
    writers.append_quarantine(flow.undated_reviews(review_pages(t), reviews), f"{folder}/bad")
    for resource, rows in items.items():
        found = flow.to_posts(rows, resource, t.gazetteer(), t.continents(), models[resource], index=index)
        writers.append_posts(found, f"{folder}/posts")
    return flow.report(readers.read_posts(t.spark, f"{folder}/posts"), SOURCE_CITIES)
