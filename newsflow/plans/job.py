"""The complete job: feed items in, article table, rejected rows and history out.

A run writes its articles, the rows it refused with the reason, the items that
become the next history, and last a manifest entry. Only runs with an entry
are ever read, so these tables move together: a run that fails, wherever,
leaves all of them as they were, and its repetition replaces what it had
written.

The costly part, pages to bodies, is done in chunks that are kept. A repeated
run leaves out the items whose article is in a finished chunk and goes on with
the others; what it ends with is what an undisturbed run gives.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newsflow.operators.articles import rejected_rows
from newsflow.operators.feed import FEED_LIMIT
from newsflow.operators.incremental import ITEM_ID
from newsflow.operators.novelty import postings_of
from newsflow.operators.pages import successful
from newsflow.operators.reports import run_summary
from newsflow.operators.staging import Staging
from newsflow.plans.ingest import new_items, scrape
from newsflow.plans.news import process_articles
from newsflow.schemas import SCRAPED_ARTICLE, SPARSE_VECTOR
from newsflow.sources.stores import ArticleStore, BatchStore, PostingStore, SnapshotStore

CHUNKS = 4
_REJECTED = T.StructType(SCRAPED_ARTICLE.fields + [T.StructField("reason", T.StringType())])
_COUNTS = ["rss_items", "new_items", "scrape_success", "scrape_failed", "articles", "rejected"]
_MANIFEST = T.StructType([T.StructField(name, T.LongType()) for name in _COUNTS])


class NewsJob:
    """Runs over one set of tables under ``path``. ``pages`` gives the landed pages when a run needs them."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        pages,
        limit: int | None = FEED_LIMIT,
        landed: str | None = None,
        chunks: int = CHUNKS,
        vector: T.DataType = SPARSE_VECTOR,
        scraped_at=None,
        **options,
    ):
        self.spark, self.path, self.pages = spark, path.rstrip("/"), pages
        self.limit, self.landed, self.chunks, self.scraped_at, self.options = limit, landed, chunks, scraped_at, options
        self.article_table = ArticleStore(spark, f"{self.path}/articles", vector)
        # Dense vectors are compared with the article table itself.
        self.postings = PostingStore(spark, f"{self.path}/postings") if vector == SPARSE_VECTOR else None
        self.rejected_table = BatchStore(spark, f"{self.path}/rejected", _REJECTED)
        self.history_table = SnapshotStore(spark, f"{self.path}/history")
        self.manifest = BatchStore(spark, f"{self.path}/manifest", _MANIFEST)

    def articles(self) -> DataFrame:
        return self.article_table.read(self.manifest.batches())

    def rejected(self) -> DataFrame:
        return self.rejected_table.read(self.manifest.batches())

    def history(self) -> DataFrame:
        return self.history_table.read(self.manifest.batches()[-1:])

    def summary(self) -> DataFrame:
        """Counts of every run that ended."""
        return self.manifest.read()

    def run(self, items: DataFrame, batch: int) -> None:
        """One run over the items of one or more feed snapshots."""
        staging = Staging(self.spark)
        try:
            self._run(staging.table(items, "items"), batch, staging)
        finally:
            staging.drop()

    def _run(self, items: DataFrame, batch: int, staging: Staging) -> None:
        ended = self.manifest.before(batch)
        current, fresh = new_items(items, self.history_table.read(ended[-1:]), self.limit)
        scraped = self._scraped(fresh, batch, staging)
        good = successful(scraped)
        earlier = {"stored": self.article_table.read(ended)} if self.postings is None and ended else {}
        if self.postings is not None:
            earlier = {"postings": self.postings.read(ended)}
        start = self.article_table.next_id_after(ended)
        self.article_table.write(process_articles(good, start_id=start, staging=staging, **earlier, **self.options), batch)
        if self.postings is not None:
            self.postings.write(postings_of(self.article_table.read([batch])), batch)
        self.rejected_table.write(rejected_rows(good), batch)
        self.history_table.write(current, batch)
        counts = run_summary(current, scraped).withColumns(
            {"articles": F.lit(self.article_table.read([batch]).count()), "rejected": F.lit(self.rejected_table.read([batch]).count())}
        )
        self.manifest.write(counts, batch)

    def _scraped(self, fresh: DataFrame, batch: int, staging: Staging) -> DataFrame:
        """All new articles; those of chunks that an earlier attempt finished are not made again."""
        log = BatchStore(self.spark, f"{self.path}/scraped/{batch}", SCRAPED_ARTICLE)
        open_items = staging.table(fresh.join(log.read().select(*ITEM_ID), ITEM_ID, "left_anti"), "open")
        if not open_items.isEmpty():
            first = max(log.batches(), default=-1) + 1
            chunk = F.pmod(F.xxhash64(*ITEM_ID), F.lit(self.chunks))
            for number in range(self.chunks):
                log.write(scrape(open_items.filter(chunk == number), self.pages(), self.scraped_at, self.landed), first + number)
        return log.read().join(fresh.select(*ITEM_ID), ITEM_ID, "left_semi")
