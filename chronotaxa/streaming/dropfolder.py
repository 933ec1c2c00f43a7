"""Release files arriving in a folder, as a stream: each is loaded once and compared with its predecessor."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming import StreamingQuery

from ..plans.history import check_ids_text
from ..plans.store import Store, parse_date


def version_and_date(path: str) -> tuple[str, str] | None:
    """``YYYY.MM.DD`` and ``YYYY-MM-DD`` from the first eight digits of a file name."""
    found = re.search(r"(\d{4})(\d\d)(\d\d)", path.rsplit("/", 1)[-1])
    return (".".join(found.groups()), "-".join(found.groups())) if found else None


def consecutive(releases: DataFrame) -> DataFrame:
    """(code, before, after) for each release that has a successor; ``releases`` has code, version and released_on."""
    order = Window.partitionBy("code").orderBy(F.asc_nulls_first("released_on"), "version")
    return releases.select("code", F.col("version").alias("before"), F.lead("version").over(order).alias("after"), F.row_number().over(order).alias("place")).where("after is not null")


def load_files(store: Store, code: str, paths: list[str], read: Callable[[str], DataFrame], tell: Callable[[str], None] | None = None) -> list[tuple[str, str]]:
    """Loads new releases in the order of their versions and compares each with the one before. Returns the pairs compared.

    ``tell`` gets a text for each pair before it is compared: how well its identifiers survive (T8), which decides how to anchor.
    """
    known = {r["version"] for r in store.ordered_releases(code).collect()}
    todo = sorted((v[0], v[1], p) for p in paths if (v := version_and_date(p)) and v[0] not in known)
    for version, date, path in todo:
        store.ingest(code, version, read(path), released_on=parse_date(date), uri=path)
    new = {v for v, _, _ in todo}
    pairs = [(r["before"], r["after"]) for r in consecutive(store.ordered_releases(code)).orderBy("place").collect() if r["before"] in new or r["after"] in new]
    for before, after in pairs:
        if tell:
            tell(check_ids_text(store, code, before, after))
        store.diff(code, before, after, force=True)
    return pairs


def watch(spark: SparkSession, store: Store, code: str, folder: str, read: Callable[[str], DataFrame], checkpoint: str, pattern: str = "*.csv") -> StreamingQuery:
    """A streaming query over the folder. Files' contents are not read by the stream itself; a batch that is run again finds its releases loaded."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder).select("path")

    def batch(df: DataFrame, _: int) -> None:
        load_files(store, code, [r["path"].removeprefix("file:") for r in df.collect()], read)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
