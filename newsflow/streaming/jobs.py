"""Streaming jobs: the batch operators inside foreachBatch.

Each micro-batch reads the state of the batches before it and replaces its own
output and state, so a replayed batch gives the same tables again.
"""

from pyspark.sql import DataFrame

from newsflow.operators.novelty import postings_of
from newsflow.operators.staging import Staging
from newsflow.plans.job import NewsJob
from newsflow.plans.news import process_articles
from newsflow.sources.stores import ArticleStore, PostingStore
from newsflow.streaming.snapshots import SnapshotLog


def start(stream: DataFrame, step, checkpoint: str, processing_time: str | None = None):
    """Run ``step(batch, batch_id)``: once for all that has landed, or every ``processing_time``."""
    trigger = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def snapshot_step(log: SnapshotLog):
    """New items against the snapshot before, whatever parts of snapshots a micro-batch holds."""
    return log.add


def job_step(job: NewsJob):
    """The complete job, from feed items to the article table, for each micro-batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            job.run(batch, batch_id)

    return step


def news_step(articles: ArticleStore, postings: PostingStore | None = None, **options):
    """Filter, novelty against all stored and earlier articles, entities, append.

    With ``postings`` (for sparse vectors) a micro-batch opens only the stored
    terms in the buckets of its own, and the last batch for the next id, so
    what it reads follows its size; its own terms are appended at the end.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        staging = Staging(batch.sparkSession)
        before = articles.before(batch_id)
        try:
            if postings is None:
                rows = process_articles(batch, articles.read(before), staging=staging, **options)
            else:
                known = postings.read([b for b in postings.before(batch_id) if b in set(before)])
                rows = process_articles(
                    batch, start_id=articles.next_id_after(before), postings=known, staging=staging, **options
                )
            articles.write(rows, batch_id)
            if postings is not None:
                postings.write(postings_of(articles.read([batch_id])), batch_id)
        finally:
            staging.drop()

    return step
