"""Progress of a run, as rows and as the progress of streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

STAGES = ("generate", "search", "extract", "merge", "dedupe", "order", "finish")


class Progress:
    """Collects (stage, detail, current, total) and gives them as a table or event frames."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.events: list[tuple[int, str, str | None, int | None, int | None]] = []

    def emit(self, stage: str, detail: str | None = None, current: int | None = None, total: int | None = None) -> None:
        if stage not in STAGES:
            raise ValueError(stage)
        self.events.append((len(self.events), stage, detail, current, total))

    def on_query(self, query: str, used: int, total: int) -> None:
        """For ``fetch``."""
        self.emit("search", query, used, total)

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.events, "seq int, stage string, detail string, current int, total int")


class StreamProgress(StreamingQueryListener):
    """Passes each batch of a streaming query on to a ``Progress``."""

    def __init__(self, progress: Progress) -> None:
        self.progress = progress

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.progress.emit("search", event.name)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.progress.emit("merge", event.progress.name, int(event.progress.batchId), int(event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.progress.emit("finish")
