"""Raw corpus files to prepared text as they arrive.

Corpus projections are row-local, so the batch functions run unchanged on a stream: no state, no watermark. The checkpoint
makes every input file count exactly once, also after a restart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tokenmill.operators import corpora
from tokenmill.session import shared_dir


def ingest_corpus(
    spark: SparkSession,
    source: str,
    schema: str,
    corpus: str,
    target: str,
    keys: Sequence[str] = ("doc_id",),
    checkpoint: str | None = None,
    files_per_batch: int = 1000,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Project every new JSON-lines file under `source` to (keys…, prompt, text) and append it to `target`.

    Runs over what is there and stops; started again, it takes up the files that came since.
    """
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    projected = corpora.prepare(corpus, prepare(raw) if prepare else raw, keys=keys)
    folder = checkpoint or f"{shared_dir(spark)}/ingest-{corpus}"
    return projected.writeStream.format("parquet").option("path", target).option("checkpointLocation", folder).trigger(availableNow=True).start()
