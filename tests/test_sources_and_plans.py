import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from newsflow.catalog import inputs
from newsflow.functions.entities import ASSET_DICTIONARY
from newsflow.functions.lexicon import CRYPTO_ASSETS
from newsflow.operators import articles as article_ops
from newsflow.operators import feed, incremental, pages, reports, skew
from newsflow.operators.entities import dictionary_table, embed_with, link_entities, tag_with
from newsflow.operators.ids import dense_ids
from newsflow.operators.staging import SETTING, Staging, shared_folder
from newsflow.plans import job as job_module
from newsflow.plans.ingest import ingest
from newsflow.plans.job import NewsJob
from newsflow.operators.novelty import posting_bucket
from newsflow.plans.news import detect_novelty, process_articles, three_word_vector
from newsflow.schemas import DENSE_VECTOR, FEED_ITEM, INCOMING_ARTICLE
from newsflow.sources.feeds import feed_step, read_batch, read_feed, read_pages, read_snapshot, stream_feed
from newsflow.sources.stores import ArticleStore, PostingStore, SnapshotStore
from newsflow.streaming import jobs
from newsflow.streaming.snapshots import SnapshotLog

FEED = """<?xml version="1.0" encoding="UTF-8"?><rss><channel><title>c</title>
<item><title> First &amp; one </title><link> https://n.org/a?utm_source=x </link><guid isPermaLink="false">g1</guid>
<description>sum</description><category>Markets</category><category>Bitcoin</category>
<pubDate>Mon, 05 Jan 2026 10:20:30 +0000</pubDate></item>
<item><title>2025-01-01</title><link>https://n.org/b</link><pubDate>5 Jan 2026 10:20:30 +0100</pubDate></item>
<item><title>no key</title></item>
</channel></rss>"""


def items(spark, rows, snapshot="s"):
    """Feed items from (guid, url[, snapshot])."""
    data = [
        {"snapshot_id": row[2] if len(row) > 2 else snapshot, "feed_pos": i, "guid": row[0], "url": row[1], "title": f"t{i}"}
        for i, row in enumerate(rows)
    ]
    return spark.createDataFrame(data, FEED_ITEM)


def test_read_feed(spark, tmp_path):
    (tmp_path / "run1.xml").write_text(FEED)
    rows = read_feed(spark, str(tmp_path / "*.xml"), "Test").orderBy("feed_pos").collect()
    assert all(r.snapshot_id.endswith("/run1.xml") for r in rows) and [r.feed_pos for r in rows] == [0, 1, 2]
    assert [("run1", r.source, r.guid, r.title, r.rss_summary, r.url) for r in rows] == [
        ("run1", "Test", "g1", "First & one", "sum", "https://n.org/a?utm_source=x"),
        ("run1", "Test", "https://n.org/b", "2025-01-01", "", "https://n.org/b"),
        ("run1", "Test", "", "no key", "", ""),
    ]
    assert rows[0].categories == ["Markets", "Bitcoin"] and rows[1].categories == []
    assert rows[0].published_at == "Mon, 05 Jan 2026 10:20:30 +0000"
    assert rows[0].published_ts == datetime.datetime(2026, 1, 5, 10, 20, 30)
    assert rows[1].published_ts == datetime.datetime(2026, 1, 5, 9, 20, 30)
    assert feed.usable_items(read_feed(spark, str(tmp_path / "*.xml"), "Test")).count() == 2


def test_feed_head_cuts_before_it_drops(spark):
    rows = [(f"g{i}" if i != 2 else "", "") for i in range(26)]
    assert feed.usable_items(feed.feed_head(items(spark, rows))).count() == 24
    with pytest.raises(ValueError):
        feed.require_items(items(spark, rows).limit(0))


def test_read_snapshot(spark, tmp_path):
    assert read_snapshot(spark, str(tmp_path / "none.json")).count() == 0
    assert read_batch(spark, str(tmp_path / "none.json")).schema == INCOMING_ARTICLE
    good = tmp_path / "good.json"
    good.write_text("\n " + json.dumps([{"guid": "g", "title": "t", "categories": ["a"], "unknown": 1}], indent=2))
    assert [(r.guid, r.categories) for r in read_snapshot(spark, str(good)).collect()] == [("g", ["a"])]
    bad, root = tmp_path / "bad.json", tmp_path / "root.json"
    bad.write_text('[{"guid": ')
    root.write_text('{"guid": "g"}')
    with pytest.raises(Exception):
        read_snapshot(spark, str(bad)).collect()
    with pytest.raises(ValueError):
        read_snapshot(spark, str(root))


def test_find_new(spark, monkeypatch):
    current = items(spark, [("g1", "http://u/1"), ("g2", "http://u/2"), (None, None), ("g9", "http://u/1/"), ("g2", "http://u/2")])
    history = items(spark, [("g1", "http://x"), ("q", "http://U/1?utm_x=1")])
    for rows_per_salt in (250_000, 1):
        monkeypatch.setattr(skew, "ROWS_PER_SALT", rows_per_salt)
        assert sorted(r.feed_pos for r in incremental.find_new(current, history).collect()) == [1, 2, 4]
        assert incremental.find_new(current, history.limit(0)).count() == 5


def test_lookup_with_heavy_and_null_keys(spark):
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i}", i) for i in range(300)]
    big = spark.createDataFrame(rows, "k string, i long")
    unique = spark.createDataFrame([("hot", 1), ("k6", 2), ("other", 3)], "k string, v int")
    expected = sorted((i, {"hot": 1, "k6": 2}.get(k)) for k, i in rows)
    got = skew.lookup(big, unique, "k", spread_by="i", rows_per_salt=20)
    assert sorted((r.i, r.v) for r in got.collect()) == expected
    inner = skew.lookup(big, unique, "k", spread_by="i", how="inner", rows_per_salt=20)
    assert sorted((r.i, r.v) for r in inner.collect()) == [(i, v) for i, v in expected if v]


def test_dense_ids(spark):
    frame = spark.range(1000).select((F.lit(1000) - F.col("id")).alias("x")).repartition(7)
    got = dense_ids(frame, ["x"], start=5).orderBy("x").collect()
    assert [r.id for r in got] == list(range(5, 1005)) and [r.x for r in got] == list(range(1, 1001))
    assert dense_ids(frame.limit(0), ["x"]).count() == 0


def test_shared_folder_comes_from_the_session(spark):
    assert Staging(spark).root.startswith(spark.conf.get(SETTING).rstrip("/"))


class Unset:
    """A session whose cluster names no shared folder."""

    def __init__(self, master):
        self.master, self.folder, self.conf, self.sparkContext = master, None, {}, self

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_temporary_folder_only_in_local_mode():
    local = Unset("local[2]")
    assert shared_folder(local) == local.folder == shared_folder(local)
    with pytest.raises(RuntimeError):
        shared_folder(Unset("yarn"))


def test_staging_is_dropped(spark, tmp_path):
    staging = Staging(spark)
    assert staging.table(spark.range(3), "t").count() == 3
    staging.drop()
    from newsflow.sources.files import exists

    assert not exists(spark, staging.root)


HTML = "<html><body><nav>menu</nav><article><p>{}</p></article></body></html>"


def test_ingest(spark, tmp_path):
    current = items(spark, [("g1", "u1"), ("g2", "u2"), ("g3", "u3"), ("", ""), ("g4", "u4")])
    spark.createDataFrame(
        [("u2", HTML.format("Bitcoin up - 1 - 2"), 1), ("u4", "<body></body>", 2)], "url string, html string, extra int"
    ).write.parquet(str(tmp_path / "pages"))
    landed = read_pages(spark, str(tmp_path / "pages"))
    assert landed.columns == ["url", "html"]
    head, articles, summary = ingest(current, items(spark, [("g1", None)]), landed)
    assert head.count() == 4
    got = {r.guid: (r.full_body, r.scrape_status, r.scrape_error) for r in articles.collect()}
    assert got == {
        "g2": ("Bitcoin up", "success", None),
        "g3": (None, "failed", pages.NO_PAGE),
        "g4": (None, "failed", pages.NO_CONTENT),
    }
    assert summary.first().asDict() == {"rss_items": 4, "new_items": 3, "scrape_success": 1, "scrape_failed": 2}
    assert [r.guid for r in pages.successful(articles).collect()] == ["g2"]


def test_constraints_and_defaults(spark):
    rows = spark.createDataFrame(
        [(1, "t", None, "c"), (2, None, "High", "c"), (3, "t", "much too long", "c"), (4, "t", "Low", "x" * 51)],
        "id long, title string, novelty_label string, category string",
    )
    rejected = {r.id: r.reason for r in article_ops.rejected_rows(rows).collect()}
    assert rejected == {
        2: "title is null",
        3: "novelty_label is longer than 10",
        4: "category is longer than 50",
    }
    filled = article_ops.with_defaults(article_ops.valid_rows(rows)).first()
    assert (filled.novelty_label, filled.is_redundant) == ("High", False) and filled.created_at is not None


STORY = "the exchange said on monday that it would list the token after a long review of the market"
NEWS = [
    ("Bitcoin news", STORY),
    ("Sun hype in Miami", "no asset here"),
    ("Bitcoin news", STORY + " again"),
    ("Ethereum and SOL", "ripple of a different kind"),
    ("Ethereum and SOL", None),
]


def incoming(spark, rows, snapshot="s1"):
    data = [
        {"snapshot_id": snapshot, "feed_pos": i, "title": t, "full_body": None, "rss_summary": b, "url": f"u{i}"}
        for i, (t, b) in enumerate(rows)
    ]
    return spark.createDataFrame(data, INCOMING_ARTICLE)


def test_process_and_append(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "articles"))
    store.write(process_articles(incoming(spark, NEWS)), 0)
    rows = store.read().orderBy("id").collect()
    assert [(r.id, r.title, r.is_redundant, r.novelty_label) for r in rows] == [
        (1, "Bitcoin news", False, "High"),
        (2, "Bitcoin news", True, "Low"),
        (3, "Ethereum and SOL", False, "High"),
        (4, "Ethereum and SOL", False, "High"),
    ]
    assert [e.asset_id for e in rows[2].extracted_assets] == ["asset_eth", "asset_sol", "asset_xrp"]
    assert rows[1].extracted_assets is None and rows[1].description == STORY + " again"
    # The same batch again under a new number: everything repeats stored rows.
    store.write(process_articles(incoming(spark, NEWS), store.read()), 1)
    again = store.read([1]).orderBy("id").collect()
    assert [(r.id, r.is_redundant) for r in again] == [(5, True), (6, True), (7, True), (8, True)]
    # Under its own number it replaces itself.
    store.write(process_articles(incoming(spark, NEWS), store.read(store.before(1))), 1)
    assert store.read().count() == 8
    store.reset()
    assert store.read().count() == 0 and ArticleStore.next_id(store.read()) == 1


def test_own_encoder_and_tagger(spark):
    def make_encoder():
        return lambda texts: [[float("Bitcoin" in t), float("SOL" in t), 0.5] for t in texts]

    def make_tagger():
        return lambda texts: [[(w, 0.9) for w in t.split()] for t in texts]

    rows = process_articles(incoming(spark, NEWS), make_encoder=make_encoder)
    assert rows.schema["embedding"].dataType == DENSE_VECTOR
    assert {r.id: r.is_redundant for r in rows.collect()} == {1: False, 2: True, 3: False, 4: True}
    texts = spark.createDataFrame([(1, "BTC up BTC"), (2, "x"), (3, "Doge btc")], "article_id long, text string")
    linked = link_entities(tag_with(texts, make_tagger), dictionary_table(spark)).collect()
    assert {r.article_id: [tuple(e) for e in r.extracted_assets] for r in linked} == {
        1: [("asset_btc", "BTC", 0.9)],
        3: [("asset_doge", "DOGE", 0.9), ("asset_btc", "BTC", 0.9)],
    }
    assert embed_with(texts, make_encoder).filter("size(embedding) = 3").count() == 3


def test_disposition(spark):
    frame = spark.createDataFrame(
        [("DROPPED", None), ("PASSED", True), ("PASSED", False), ("PASSED", False)], "status string, is_redundant boolean"
    )
    got = {r.disposition: r.articles for r in reports.disposition_report(frame).collect()}
    assert got == {"DROPPED": 1, "Redundant": 1, "Unique": 2}


def land(frame, folder, number):
    frame.coalesce(1).write.parquet(str(folder / f"in/{number}"))


def streamed(spark, tmp_path, frame, number, log):
    land(frame, tmp_path, number)
    stream = spark.readStream.schema(FEED_ITEM).parquet(str(tmp_path / "in/*"))
    jobs.start(stream, jobs.snapshot_step(log), str(tmp_path / "progress")).awaitTermination()


def found(log):
    return sorted((r.snapshot_id, r.guid) for r in log.new_items().collect())


def test_stream_of_snapshots(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path / "log"))
    snapshots = [["a", "b"], ["b", "c"], ["a", "c"], ["a"]]
    for number, guids in enumerate(snapshots):
        if number < 2:
            streamed(spark, tmp_path, items(spark, [(g, "", f"s{number}") for g in guids]), number, log)
    # The last two snapshots arrive together in one micro-batch.
    last = items(spark, [(g, "", f"s{n}") for n in (2, 3) for g in snapshots[n]])
    streamed(spark, tmp_path, last, 2, log)
    # "a" left and came back, so it is new again.
    assert found(log) == [("s0", "a"), ("s0", "b"), ("s1", "c"), ("s2", "a")]
    whole = items(spark, [(g, "", f"s{n}") for n, guids in enumerate(snapshots) for g in guids])
    assert sorted((r.snapshot_id, r.guid) for r in incremental.snapshot_diff(whole).collect()) == found(log)
    # A replayed micro-batch reads the register before it and writes the same rows.
    log.add(items(spark, [("b", "", "s1"), ("c", "", "s1")]), 1)
    assert found(log) == [("s0", "a"), ("s0", "b"), ("s1", "c"), ("s2", "a")]
    assert [r.guid for r in log.latest().collect()] == ["a"]
    log.add(items(spark, []), 3)
    assert found(log) == [("s0", "a"), ("s0", "b"), ("s1", "c"), ("s2", "a")]


def test_snapshots_in_parts(spark, tmp_path):
    """Split, late and replayed parts end with the rows of whole snapshots."""
    log = SnapshotLog(spark, str(tmp_path / "log"))

    def part(snapshot, guids, at):
        rows = [{"snapshot_id": snapshot, "feed_pos": at + i, "guid": g, "url": "", "title": g} for i, g in enumerate(guids)]
        return spark.createDataFrame(rows, FEED_ITEM)

    log.add(part("s0", ["a", "b"], 0), 0)
    log.add(part("s1", ["a", "c"], 0), 1)
    # Split: the second part of s1 is compared with s0 as the first was.
    log.add(part("s1", ["b", "d"], 2), 2)
    assert found(log) == [("s0", "a"), ("s0", "b"), ("s1", "c"), ("s1", "d")]
    log.add(part("s2", ["d", "e", "f"], 0), 3)
    assert found(log)[4:] == [("s2", "e"), ("s2", "f")]
    # Late: a part of s1 arrives after s2, so "e" was not new there.
    log.add(part("s1", ["e"], 4), 4)
    assert found(log) == [("s0", "a"), ("s0", "b"), ("s1", "c"), ("s1", "d"), ("s1", "e"), ("s2", "f")]
    # Replayed: the same micro-batch again, also when it failed before its register was written.
    log.add(part("s1", ["e"], 4), 4)
    assert found(log)[4:] == [("s1", "e"), ("s2", "f")]
    write, log.register.write = log.register.write, lambda *_: 1 / 0
    with pytest.raises(ZeroDivisionError):
        log.add(part("s3", ["f", "g"], 0), 5)
    log.register.write = write
    assert found(log)[4:] == [("s1", "e"), ("s2", "f")]
    log.add(part("s3", ["f", "g"], 0), 5)
    assert found(log)[4:] == [("s1", "e"), ("s2", "f"), ("s3", "g")]
    assert sorted(r.guid for r in log.latest().collect()) == ["f", "g"]


def test_stream_of_feed_files(spark, tmp_path):
    """Files of one name in two folders, read as a stream one by one, give the rows of a batch."""
    for name in ("x/run.xml", "y/run.xml", "y/other.xml"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(FEED.replace("g1", name))
    output = SnapshotStore(spark, str(tmp_path / "out"))
    entries = stream_feed(spark, str(tmp_path / "*/*.xml"), files_per_batch=1)
    jobs.start(entries, feed_step("Test", output.write, "2026-01-06"), str(tmp_path / "progress")).awaitTermination()
    assert output.batches() == [0, 1, 2]
    batch = read_feed(spark, str(tmp_path / "*/*.xml"), "Test", "2026-01-06")
    assert sorted(map(tuple, output.read().collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)
    assert batch.select("snapshot_id").distinct().count() == 3 and batch.filter("feed_pos = 0").count() == 3


def job_pages(spark, n):
    rows = [(f"u{i}", HTML.format(f"{STORY} {'Bitcoin' if i % 3 else 'nothing'} {i // 4}"), 1) for i in range(n)]
    rows += [("u1", HTML.format("Bitcoin, the page as it was crawled again"), 2)]
    return spark.createDataFrame(rows, "url string, html string, landed_at int")


def job_items(spark, numbers, snapshot):
    rows = [
        {"snapshot_id": snapshot, "feed_pos": i, "guid": f"g{i}", "url": f"u{i}", "title": None if i == 5 else f"title {i % 4}"}
        for i in numbers
    ]
    return spark.createDataFrame(rows, FEED_ITEM)


def job_rows(job):
    articles = [(r.id, r.url, r.description, r.is_redundant) for r in job.articles().collect()]
    return sorted(articles), sorted((r.url, r.reason) for r in job.rejected().collect()), sorted(r.guid for r in job.history().collect())


def test_complete_job_in_batches_and_as_a_stream(spark, tmp_path):
    table = job_pages(spark, 12)
    jobs_of = [NewsJob(spark, str(tmp_path / n), lambda: table, landed="landed_at") for n in ("batch", "stream", "broken")]
    runs = [job_items(spark, range(6), "s0"), job_items(spark, range(3, 12), "s1")]
    for number, run in enumerate(runs):
        jobs_of[0].run(run, number)
        land(run, tmp_path, number)
        stream = spark.readStream.schema(FEED_ITEM).parquet(str(tmp_path / "in/*"))
        jobs.start(stream, jobs.job_step(jobs_of[1]), str(tmp_path / "progress")).awaitTermination()
    articles, rejected, history = job_rows(jobs_of[0])
    assert job_rows(jobs_of[1]) == (articles, rejected, history)
    assert rejected == [("u5", "title is null")] and history == sorted(f"g{i}" for i in range(3, 12))
    assert [a[0] for a in articles] == list(range(1, len(articles) + 1)) and {a[1] for a in articles} == {f"u{i}" for i in range(12) if i % 3 and i != 5}
    assert next(a for a in articles if a[1] == "u1")[2] == "Bitcoin, the page as it was crawled again"
    counts = [tuple(r) for r in jobs_of[0].summary().orderBy("rss_items").collect()]
    assert counts == [(6, 6, 6, 0, 3, 1), (9, 6, 6, 0, 4, 0)]

    # A run that fails before its manifest entry moves nothing; its repetition ends as an undisturbed one.
    broken = jobs_of[2]
    broken.run(runs[0], 0)
    before = job_rows(broken)
    write, broken.history_table.write = broken.history_table.write, lambda *_: 1 / 0
    with pytest.raises(ZeroDivisionError):
        broken.run(runs[1], 1)
    assert job_rows(broken) == before
    broken.history_table.write = write
    broken.run(runs[1], 1)
    assert job_rows(broken) == (articles, rejected, history)
    with pytest.raises(ValueError):
        broken.run(runs[0].limit(0), 2)
    assert job_rows(broken) == (articles, rejected, history)


def test_job_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    """Stopped after some chunks of pages, a run makes only the missing articles and ends with the same rows."""
    table = job_pages(spark, 12)
    whole, stopped = (NewsJob(spark, str(tmp_path / n), lambda: table, chunks=3) for n in ("whole", "stopped"))
    items_ = job_items(spark, range(12), "s0")
    whole.run(items_, 0)
    scraped, made = job_module.scrape, []

    def counting(fresh, *rest):
        if len(made) == 2:
            raise RuntimeError("stopped")
        made.append(fresh.count())
        return scraped(fresh, *rest)

    monkeypatch.setattr(job_module, "scrape", counting)
    with pytest.raises(RuntimeError):
        stopped.run(items_, 0)
    assert stopped.articles().count() == 0 and 0 < sum(made) < 12
    again = []
    monkeypatch.setattr(job_module, "scrape", lambda fresh, *rest: again.append(fresh.count()) or scraped(fresh, *rest))
    stopped.run(items_, 0)
    assert sum(made) + sum(again) == 12 and job_rows(stopped) == job_rows(whole)


def test_stream_of_articles(spark, tmp_path):
    table = ArticleStore(spark, str(tmp_path / "articles"))
    step = jobs.news_step(table)
    for number in range(2):
        land(incoming(spark, NEWS[: 3 + 2 * number], f"s{number}"), tmp_path, number)
        stream = spark.readStream.schema(INCOMING_ARTICLE).parquet(str(tmp_path / "in/*"))
        jobs.start(stream, step, str(tmp_path / "progress")).awaitTermination()
    got = [(r.id, r.is_redundant) for r in table.read().orderBy("id").collect()]
    # In one go: the second batch meets the first as stored rows.
    both = incoming(spark, NEWS[:3], "s0").unionByName(incoming(spark, NEWS, "s1"))
    expected = [(r.id, r.is_redundant) for r in process_articles(both).orderBy("id").collect()]
    assert got == expected == [(1, False), (2, True), (3, True), (4, True), (5, False), (6, False)]


def test_stream_with_postings(spark, tmp_path):
    """Three micro-batches on a store: the rows of one batch, and only the buckets of a batch's terms are opened."""
    table, postings = ArticleStore(spark, str(tmp_path / "articles")), PostingStore(spark, str(tmp_path / "postings"))
    step = jobs.news_step(table, postings)
    news = [(t, None if b is None else f"{b} {n}") for n in range(3) for t, b in NEWS]
    parts = [news[:5], news[5:10], news[10:], news[:1]]
    for number, part in enumerate(parts):
        step(incoming(spark, part, f"s{number}"), number)
    whole = None
    for number, part in enumerate(parts):
        frame = incoming(spark, part, f"s{number}")
        whole = frame if whole is None else whole.unionByName(frame)
    expected = [(r.id, r.title, r.is_redundant) for r in process_articles(whole).orderBy("id").collect()]
    assert [(r.id, r.title, r.is_redundant) for r in table.read().orderBy("id").collect()] == expected
    assert postings.batches() == [0, 1, 2, 3] and sum(e[2] for e in expected) >= 6
    # A replay gives the same table again.
    step(incoming(spark, parts[3], "s3"), 3)
    assert [(r.id, r.title, r.is_redundant) for r in table.read().orderBy("id").collect()] == expected
    # A small batch opens some buckets only.
    asked = incoming(spark, [("Bitcoin", "a b c d e f")]).select(F.explode(three_word_vector(F.lit("a b c d e f"))).alias("t"))
    buckets = {r[0] for r in asked.select(posting_bucket(F.col("t.term"))).collect()}
    stored = postings.read().select("bucket").distinct().count()
    assert 0 < len(buckets) <= 4 < stored
    plan = postings.read().filter(F.col("bucket").isin(list(buckets)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


def test_fixed_values():
    assert len(CRYPTO_ASSETS.names) == 10 and len(CRYPTO_ASSETS.tickers) == 8
    assert len(ASSET_DICTIONARY) == 20 and len(set(ASSET_DICTIONARY.values())) == 10
    assert math.isclose(feed.FEED_LIMIT, 25)


def test_detect_novelty_keeps_arrival_order(spark):
    frame = incoming(spark, NEWS[:1] * 2).withColumn("text", F.col("rss_summary"))
    got = detect_novelty(frame).orderBy("id").collect()
    assert [(r.feed_pos, r.is_redundant) for r in got] == [(0, False), (1, True)]


def test_landed_lists_lie_in_one_file_each(spark, tmp_path):
    """Also where the rows fill several partitions: a list is one file, closed, in the order of its pages."""
    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.example/"), "id").alias("url"), F.repeat(F.lit("x"), 60).alias("html"))
    rows.write.parquet(str(tmp_path / "pages.parquet"))
    setting = "spark.sql.adaptive."
    small = {f"{setting}advisoryPartitionSizeInBytes": "16k", f"{setting}coalescePartitions.minPartitionSize": "1k", f"{setting}coalescePartitions.parallelismFirst": "false"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        pattern = inputs.landed_json(spark, str(tmp_path))
        assert read_snapshot(spark, pattern).count() == read_batch(spark, pattern).count() == 3000
    finally:
        for key in small:
            spark.conf.unset(key)
    files = [json.loads(r["value"]) for r in spark.read.text(pattern, wholetext=True).collect()]
    assert sorted(tuple(x["feed_pos"] for x in f) for f in files) == [tuple(range(i, i + 50)) for i in range(0, 3000, 50)]
