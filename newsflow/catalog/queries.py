"""Every operator as a query over the given tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsflow.catalog import inputs
from newsflow.catalog.inputs import DICTIONARY, EVENT_DICTIONARY, LEXICON, PAGE_TAIL, TEXT_DISTANCE, VECTOR_DISTANCE
from newsflow.functions import entities, html, lexicon, text, urls, vectors
from newsflow.operators import articles as article_ops
from newsflow.operators import entities as entity_ops
from newsflow.operators import feed, incremental, novelty, pages, reports
from newsflow.operators.ids import dense_ids
from newsflow.operators.staging import Staging
from newsflow.plans.ingest import ingest
from newsflow.plans.job import NewsJob
from newsflow.plans.news import process_articles, three_word_vector
from newsflow.schemas import FEED_ITEM, FEED_XML_ITEM
from newsflow.sources.feeds import feed_step, read_batch, read_feed, read_pages, read_snapshot, stream_feed
from newsflow.sources.stores import ArticleStore, PostingStore, SnapshotStore
from newsflow.sources.tables import read_table, spread
from newsflow.streaming import jobs
from newsflow.streaming.snapshots import SnapshotLog

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


# Lexicon filter and text


@query
def asset_filter(spark: SparkSession, folder: str) -> DataFrame:
    return article_ops.filter_assets(inputs.articles(spark, folder), LEXICON).select("doc_id", "source")


@query
def asset_filter_labelled(spark, folder):
    return article_ops.label_assets(inputs.articles(spark, folder), LEXICON).select("doc_id", "status")


@query
def lexicon_matches(spark, folder):
    return inputs.articles(spark, folder).select(
        "doc_id",
        lexicon.names_match(F.col("text"), LEXICON).alias("by_name"),
        lexicon.ticker_match(F.col("text"), LEXICON).alias("by_ticker"),
    )


@query
def full_text_fallback(spark, folder):
    documents = read_table(spark, folder, "documents")
    rows = documents.join(read_table(spark, folder, "labels"), "doc_id", "left").select(
        "doc_id",
        F.when(F.col("quality") == 1, F.col("text")).when(F.col("quality") == 0, "").alias("full_body"),
        F.when(F.col("toxic") == 1, F.col("source")).otherwise("").alias("rss_summary"),
        F.col("lang").alias("description"),
        F.when(F.col("lang") != "de", F.col("source")).alias("title"),
    )
    return article_ops.with_full_text(rows).select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


@query
def batch_size(spark, folder):
    return reports.batch_size(inputs.articles(spark, folder))


@query
def strip_text(spark, folder):
    padded = F.concat(F.lit("\u00a0\t \u3000"), F.col("text"), F.lit("\n\u2003 \u0085"))
    return read_table(spark, folder, "conversations").select("conv_id", "turn", text.strip(padded).alias("stripped"))


@query
def line_split(spark, folder):
    lines = text.split_lines(F.col("text"))
    return inputs.documents(spark, folder).select("doc_id", F.posexplode(lines).alias("line_no", "line"))


@query
def line_dedup(spark, folder):
    kept = text.drop_repeated_lines(text.split_lines(F.col("text")))
    return inputs.documents(spark, folder).select("doc_id", F.array_join(kept, "\n").alias("kept"))


@query
def pagination_cut(spark, folder):
    tailed = F.concat(F.col("text"), F.lit(PAGE_TAIL))
    return read_table(spark, folder, "conversations").select("conv_id", "turn", text.cut_page_numbers(tailed).alias("kept"))


@query
def clean_body(spark, folder):
    tailed = F.concat(F.col("text"), F.lit(PAGE_TAIL))
    return inputs.documents(spark, folder).select("doc_id", text.clean_body(tailed).alias("full_body"))


# Urls, keys, snapshots


@query
def normalize_url(spark, folder):
    return read_table(spark, folder, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("normal_url"))


@query
def tracking_params(spark, folder):
    given = urls.query_parameters(F.regexp_extract("url", r"\?([^#]*)", 1))
    kept = urls.drop_tracking(given)
    counted = read_table(spark, folder, "pages").select("page_id", given.alias("given"), kept.alias("kept"))
    return counted.select("page_id", F.size("given").alias("n_given"), urls.encode_query(F.col("kept")).alias("kept"))


@query
def article_keys(spark, folder):
    keys = urls.article_keys(F.col("guid"), F.col("url"))
    return inputs.keyed_items(spark, folder).select("feed_pos", F.explode(keys).alias("key"))


@query
def historical_keys(spark, folder):
    return incremental.historical_keys(inputs.keyed_items(spark, folder))


@query
def find_new_articles(spark, folder):
    items = inputs.keyed_items(spark, folder)
    later = F.col("snapshot_id") >= "2024-01-16"
    return incremental.find_new(items.filter(later), items.filter(~later)).select("feed_pos", "guid", "url")


@query
def snapshot_diff(spark, folder):
    return incremental.snapshot_diff(inputs.daily_items(spark, folder)).select("snapshot_id", "feed_pos", "guid")


@query
def previous_snapshot(spark, folder):
    return incremental.previous_snapshots(inputs.daily_items(spark, folder))


@query
def feed_items(spark, folder):
    link = F.concat(F.lit(" "), F.col("url"), F.lit("\n"))
    entries = read_table(spark, folder, "pages").select(
        F.lit("run").alias("snapshot_id"),
        F.col("page_id").alias("feed_pos"),
        F.concat(F.lit("\t"), F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"),
        link.alias("link"),
        F.lit(None).cast("string").alias("description"),
        F.struct(
            F.when(~F.col("url").contains("#"), F.col("page_id").cast("string")).alias("_VALUE"),
            F.lit(None).cast("string").alias("_isPermaLink"),
        ).alias("guid"),
        F.array(F.regexp_extract("html", 'lang="([a-z]*)"', 1)).alias("category"),
        F.lit("Mon, 01 Jan 2024 10:20:30 +0000").alias("pubDate"),
    )
    assert set(FEED_XML_ITEM.names) <= set(entries.columns)
    return feed.project_items(entries, "pages").select(
        "feed_pos", "source", "guid", "title", "rss_summary", "url", "published_at", "published_ts",
        F.array_join("categories", ",").alias("categories"),
    )


@query
def feed_head(spark, folder):
    items = inputs.keyed_items(spark, folder)
    return feed.usable_items(feed.feed_head(items)).select("snapshot_id", "feed_pos", "guid")


# Pages


@query
def item_page_join(spark, folder):
    joined = pages.item_page_join(inputs.page_items(spark, folder), read_table(spark, folder, "pages"))
    return joined.select("feed_pos", "url", F.md5("html").alias("html_md5"))


@query
def page_main_text(spark, folder):
    return spread(read_table(spark, folder, "pages").select("page_id", "html"), "page_id").select("page_id", html.main_text(F.col("html")).alias("main_text"))


@query
def page_planted_parts(spark, folder):
    """Main text of pages with nested tables and character references planted at the head of their article."""
    rows = spread(read_table(spark, folder, "pages").select("page_id", "html"), "page_id")
    planted = F.replace("html", F.lit("<article>"), F.lit("<article>" + inputs.PLANTED_TABLE + inputs.PLANTED_REFERENCES))
    return rows.select("page_id", html.main_text(planted).alias("main_text"))


def _scraped(spark, folder):
    joined = pages.item_page_join(inputs.page_items(spark, folder), read_table(spark, folder, "pages"))
    return pages.with_scrape_status(joined)


@query
def scrape_status(spark, folder):
    return _scraped(spark, folder).select("feed_pos", "full_body", "scrape_status", "scrape_error")


@query
def successful_articles(spark, folder):
    return pages.successful(_scraped(spark, folder)).select("feed_pos", "url")


@query
def run_summary(spark, folder):
    _, _, summary = ingest(
        inputs.page_items(spark, folder), inputs.page_history(spark, folder), read_table(spark, folder, "pages"), limit=None
    )
    return summary


@query
def ingest_articles(spark, folder):
    _, scraped, _ = ingest(
        inputs.page_items(spark, folder), inputs.page_history(spark, folder), read_table(spark, folder, "pages"), limit=None
    )
    return scraped.select("guid", "scrape_status", F.md5("full_body").alias("body_md5"))


# Vectors and novelty


@query
def embed_text(spark, folder):
    vector = vectors.term_vector(F.col("text"), dim=4096)
    exploded = inputs.documents(spark, folder).select("doc_id", F.explode(vector).alias("t"))
    return exploded.select("doc_id", F.col("t.term").alias("bucket"), F.round("t.weight", 6).alias("weight"))


@query
def cosine_distance(spark, folder):
    a = inputs.vectors(spark, folder)
    b = a.select((F.col("seq") + 1).alias("seq"), F.col("embedding").alias("before"))
    distance = vectors.cosine_distance(F.col("embedding"), F.col("before"))
    return a.join(b, "seq").select("seq", F.round(distance, 6).alias("distance"))


@query
def novelty_flags(spark, folder):
    flagged = novelty.flag_redundant(inputs.vectors(spark, folder), threshold=VECTOR_DISTANCE)
    return flagged.select("seq", "is_redundant", "novelty_label")


@query
def novelty_match(spark, folder):
    flagged = novelty.flag_redundant(inputs.vectors(spark, folder), threshold=VECTOR_DISTANCE, first_match=True)
    return flagged.filter("is_redundant").select("seq", "match_seq")


def _document_rows(spark, folder):
    return inputs.articles(spark, folder).select(F.col("doc_id").alias("seq"), "doc_id", "title", "full_body")


def _document_vectors(spark, folder):
    return _document_rows(spark, folder).withColumn("embedding", three_word_vector(F.col("full_body")))


@query
def novelty_documents(spark, folder):
    vector = three_word_vector(F.col("full_body"))
    flagged = novelty.flag_redundant(_document_rows(spark, folder), threshold=TEXT_DISTANCE, vector=vector)
    return flagged.select("doc_id", "is_redundant", "novelty_label")


@query
def novelty_match_titles(spark, folder):
    rows = _document_rows(spark, folder)
    vector = three_word_vector(F.col("full_body"))
    flagged = novelty.flag_redundant(rows, threshold=TEXT_DISTANCE, vector=vector, first_match=True)
    stored = rows.select("seq", F.col("doc_id").alias("id"), "title")
    return novelty.match_report(flagged, stored).withColumnRenamed("seq", "doc_id")


@query
def novelty_stored_corpus(spark, folder):
    """Labelled documents as the stored table, the others as the new batch."""
    rows = _document_vectors(spark, folder).select("doc_id", "embedding").join(
        read_table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    rows = Staging(spark).table(rows, "rows")
    stored = rows.filter("quality is not null").select(F.col("doc_id").alias("seq"), "embedding")
    new = rows.filter("quality is null").select("doc_id", (F.col("doc_id") + 10**12).alias("seq"), "embedding")
    return novelty.flag_redundant(new, stored, TEXT_DISTANCE).select("doc_id", "is_redundant")


@query
def novelty_lsh(spark, folder):
    flagged = novelty.flag_redundant_approx(inputs.vectors(spark, folder), threshold=VECTOR_DISTANCE)
    return flagged.select("seq", "is_redundant", "novelty_label")


@query
def novelty_lsh_recall(spark, folder):
    """The approximate flags against the exact ones: none wrong, and the stated share found."""
    rows = inputs.vectors(spark, folder)
    exact = novelty.flag_redundant(rows, threshold=VECTOR_DISTANCE)
    counts = novelty.measured_recall(novelty.flag_redundant_approx(rows, threshold=VECTOR_DISTANCE), exact)
    return counts.select("exact", "wrong", (F.col("found") >= inputs.LSH_RECALL * F.col("exact")).alias("recall_reached"))


# Entities


def _mentions(spark, folder):
    return entity_ops.extract_mentions(inputs.articles(spark, folder), LEXICON, extra_names=())


@query
def extract_mentions(spark, folder):
    found = _mentions(spark, folder).select("doc_id", F.explode("mentions").alias("m"))
    return found.select("doc_id", "m.pos", "m.word", "m.score")


@query
def link_entities(spark, folder):
    linked = entities.link_mentions(F.col("mentions"), DICTIONARY)
    found = _mentions(spark, folder).select("doc_id", F.posexplode(linked).alias("place", "e"))
    return found.select("doc_id", "place", "e.asset_id", "e.matched_text", "e.ner_confidence")


@query
def entity_texts(spark, folder):
    linked = entities.link_mentions(F.col("mentions"), DICTIONARY)
    names = entities.matched_texts(linked)
    return _mentions(spark, folder).select("doc_id", F.array_join(names, ",").alias("matched_texts"))


@query
def confident_mentions(spark, folder):
    mentions = inputs.event_mentions(spark, folder)
    score = entities.confidence(F.col("score"))
    return mentions.select(
        "article_id", "pos", entities.clean_mention(F.col("word")).alias("surface"), score.alias("confidence")
    ).filter(F.col("confidence") > entities.MIN_CONFIDENCE)


@query
def link_mention_table(spark, folder):
    linked = entity_ops.link_entities(
        inputs.event_mentions(spark, folder), entity_ops.dictionary_table(spark, EVENT_DICTIONARY)
    )
    found = linked.select("article_id", F.posexplode("extracted_assets").alias("place", "e"))
    return found.select("article_id", "place", "e.asset_id", "e.matched_text", "e.ner_confidence")


# Article table and complete jobs


@query
def article_rows(spark, folder):
    rows = inputs.articles(spark, folder).select("doc_id", "title", "source")
    numbered = dense_ids(rows, ["source", "doc_id"])
    return article_ops.valid_rows(article_ops.with_defaults(numbered)).select(
        "id", "doc_id", "title", "is_redundant", "novelty_label"
    )


def _category_rows(spark, folder):
    return inputs.articles(spark, folder).select(
        "doc_id",
        F.when(F.col("lang") != "de", F.col("title")).alias("title"),
        F.substring_index("title", ".", 1).alias("category"),
        F.substring_index("title", " ", 2).alias("sentiment"),
    )


@query
def rejected_rows(spark, folder):
    return article_ops.rejected_rows(_category_rows(spark, folder)).select("doc_id", "reason")


def _processed(spark, folder):
    return process_articles(
        inputs.articles(spark, folder), lexicon=LEXICON, dictionary=DICTIONARY, extra_names=(), threshold=TEXT_DISTANCE
    )


def _readable(rows):
    """Article rows with the entity list as text."""
    return rows.select(
        "id",
        "title",
        F.md5("description").alias("description_md5"),
        "is_redundant",
        "novelty_label",
        F.array_join(F.transform("extracted_assets", lambda e: F.concat_ws(":", e["asset_id"], e["matched_text"])), ",").alias(
            "extracted_assets"
        ),
        "category",
    )


@query
def news_end_to_end(spark, folder):
    return _readable(_processed(spark, folder))


@query
def article_scan(spark, folder):
    """Append the processed articles to a table, then read some columns of it."""
    store = ArticleStore(spark, Staging(spark).root)
    store.write(_processed(spark, folder), 0)
    return store.read().select("id", "title", "url", "is_redundant", "novelty_label")


@query
def disposition_report(spark, folder):
    labelled = article_ops.label_assets(inputs.articles(spark, folder), LEXICON)
    staging = Staging(spark)
    labelled = staging.table(labelled.select("doc_id", "source", "status", "text"), "labelled")
    passed = labelled.filter("status = 'PASSED'").select(F.col("doc_id").alias("seq"), "text")
    passed = passed.withColumn("embedding", three_word_vector(F.col("text")))
    flagged = novelty.flag_redundant(passed, threshold=TEXT_DISTANCE, staging=staging)
    both = labelled.drop("text").join(
        flagged.select(F.col("seq").alias("doc_id"), "is_redundant"), "doc_id", "left"
    )
    return reports.disposition_report(both, "source")


@query
def stream_snapshot_diff(spark, folder):
    """Daily snapshots landed in two halves, each half of a group of days a micro-batch after the other."""
    staging = Staging(spark)
    items = inputs.daily_items(spark, folder)
    numbers = incremental.number_snapshots(items, staging)
    days = numbers.agg(F.max("snapshot_no")).first()[0] or 1
    group = F.floor((F.col("snapshot_no") - 1) * inputs.LANDINGS / days) + F.col("feed_pos") % 2
    grouped = staging.table(items.join(numbers, "snapshot_id").withColumn("landing", group), "grouped")
    log = SnapshotLog(spark, f"{staging.root}/log")
    stream = spark.readStream.schema(FEED_ITEM).parquet(f"{staging.root}/landed/*")
    for landing in range(inputs.LANDINGS + 1):
        grouped.filter(F.col("landing") == landing).select(*FEED_ITEM.names).write.parquet(f"{staging.root}/landed/{landing}")
        jobs.start(stream, jobs.snapshot_step(log), f"{staging.root}/progress").awaitTermination()
    return log.new_items().select("snapshot_id", "feed_pos", "guid")


def _read_items(items: DataFrame) -> DataFrame:
    number = F.regexp_extract("snapshot_id", "snapshot=([0-9]+)", 1).cast("bigint")
    return items.select(number.alias("snapshot_no"), "feed_pos", "guid", "title", "url", "published_at")


@query
def feed_files(spark, folder):
    """pages written as feed files and read again."""
    return _read_items(read_feed(spark, inputs.landed_feed(spark, folder), "pages"))


@query
def stream_feed_files(spark, folder):
    """The same files as a stream, some per micro-batch."""
    output = SnapshotStore(spark, f"{Staging(spark).root}/items")
    entries = stream_feed(spark, inputs.landed_feed(spark, folder), files_per_batch=16)
    jobs.start(entries, feed_step("pages", output.write), f"{output.path}-progress").awaitTermination()
    return _read_items(output.read())


@query
def snapshot_files(spark, folder):
    """pages written as JSON lists and read as snapshots; a missing file has no rows."""
    pattern = inputs.landed_json(spark, folder)
    rows = read_snapshot(spark, pattern).unionByName(read_snapshot(spark, f"{pattern}.missing"))
    return rows.select("snapshot_id", "feed_pos", "guid", "url", F.md5("title").alias("title_md5"), F.array_join("categories", ",").alias("categories"))


@query
def batch_files(spark, folder):
    """The same files read as a batch of scraped articles, whose absent columns are null."""
    rows = read_batch(spark, inputs.landed_json(spark, folder))
    return rows.select("guid", "url", F.coalesce("description", "full_body", F.lit("none")).alias("body"))


@query
def landed_pages(spark, folder):
    return read_pages(spark, f"{folder}/pages.parquet").select("url", F.md5("html").alias("html_md5"))


@query
def required_items(spark, folder):
    """Items of a feed that has usable ones."""
    return feed.require_items(feed.usable_items(inputs.keyed_items(spark, folder))).select("feed_pos", "guid")


@query
def feed_dates(spark, folder):
    """events as feed dates with a day name or without, in another zone, some malformed."""
    at = F.date_format("ts", "d MMM yyyy HH:mm:ss")
    number = F.col("event_id") % 4
    raw = (
        F.when(number == 0, F.concat(F.date_format("ts", "EEE, "), at, F.lit(" +0000")))
        .when(number == 1, F.concat(at, F.lit(" +0200")))
        .when(number == 2, F.concat(F.lit("Mon,"), at, F.lit(" -0330")))
        .otherwise(F.concat(at, F.lit(" nowhere")))
    )
    return read_table(spark, folder, "events").select("event_id", F.unix_timestamp(feed.parsed_date(raw)).alias("seconds"))


@query
def article_reset(spark, folder):
    """An article table after a reset holds what was written since, and its ids begin again."""
    store = ArticleStore(spark, f"{Staging(spark).root}/articles")
    rows = article_ops.with_defaults(inputs.articles(spark, folder).select("doc_id", "title", "source"))

    def batch(part):
        numbered = dense_ids(part, ["doc_id"], ArticleStore.next_id(store.read()))
        missing = {f.name: F.lit(None).cast(f.dataType) for f in store.schema.fields if f.name not in numbered.columns}
        return numbered.withColumns(missing)

    store.write(batch(rows.filter("doc_id % 2 = 0")), 0)
    store.write(batch(rows.filter("doc_id % 2 = 1")), 1)
    store.reset()
    store.write(batch(rows.filter("doc_id % 3 = 0")), 0)
    return store.read().select("id", "title", "is_redundant", "novelty_label")


@query
def pipeline_end_to_end(spark, folder):
    """Two runs of the complete job, the second over all items; what became of each new item."""
    pages = read_table(spark, folder, "pages")
    job = NewsJob(
        spark, f"{Staging(spark).root}/job", lambda: pages, limit=None, lexicon=LEXICON, dictionary=DICTIONARY,
        extra_names=(), threshold=TEXT_DISTANCE, scraped_at="2024-01-01", chunks=2,
    )
    for run in (0, 1):
        job.run(inputs.titled_page_items(spark, folder, run), run)
    kept = job.articles().select("id", "title", "url", F.col("novelty_label").alias("outcome"))
    refused = job.rejected().select(F.lit(None).cast("bigint").alias("id"), "title", "url", F.col("reason").alias("outcome"))
    return kept.unionByName(refused)


@query
def stream_novelty(spark, folder):
    """documents landed source by source as a stream of articles into an article table with postings."""
    staging = Staging(spark)
    documents = read_table(spark, folder, "documents").select("doc_id", "text", "source")
    sources = dense_ids(documents.select("source").distinct(), ["source"], staging=staging)
    landing = F.least(F.col("id"), F.lit(inputs.SOURCE_LANDINGS)).alias("landing")
    sources = sources.select(F.col("source").alias("s"), landing)
    landed = documents.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    stream = spark.readStream.schema(documents.schema).parquet(f"{staging.root}/landed/*")
    incoming = stream.select(
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("full_body"),
        F.col("source").alias("snapshot_id"),
        F.col("doc_id").alias("feed_pos"),
    )
    table, postings = ArticleStore(spark, f"{staging.root}/articles"), PostingStore(spark, f"{staging.root}/postings")
    step = jobs.news_step(table, postings, lexicon=LEXICON, dictionary=DICTIONARY, extra_names=(), threshold=TEXT_DISTANCE)
    for number in range(1, inputs.SOURCE_LANDINGS + 1):
        landed.filter(F.col("landing") == number).drop("landing").write.parquet(f"{staging.root}/landed/{number}")
        jobs.start(incoming, step, f"{staging.root}/progress").awaitTermination()
    return _readable(table.read())
