"""Collections written for other readers: cursor chains of pages, TeX archives."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.sources import shared

CHAINS, PAGE = 8, 100


def _cursor(chain: Column, page: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", chain.cast("string"), page.cast("string")), 256), 1, 16)


def write(rows: DataFrame, *, id_col: str, columns: list[str], at: str | None = None, only: Column | None = None, chains: int = CHAINS, size: int = PAGE) -> tuple[str, dict[str, str]]:
    """(folder, first cursor of each chain) of ``rows`` written as pages of up to ``size`` items; ``only`` picks pages by ``page``.

    Ids are dealt over chains and pages by their value; the pages of a chain
    that any id falls into run without a gap up to its last.
    """
    spark = rows.sparkSession
    at = at or shared.folder(spark, "collection")
    chain, page = F.pmod(F.col(id_col), F.lit(chains)), F.floor(F.col(id_col) / (chains * size))
    placed = rows.select(*columns, chain.alias("chain"), page.alias("page"))
    last = placed.groupBy("chain").agg(F.max("page").alias("last"))
    # Pages without an id are written empty, so that a chain goes on over them.
    every = last.select("chain", "last", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("page"))
    items = placed.groupBy("chain", "page").agg(F.collect_list(F.struct(*columns)).alias("items"))
    pages = every.join(items, ["chain", "page"], "left")
    after = F.when(F.col("page") < F.col("last"), _cursor(F.col("chain"), F.col("page") + 1))
    pages = pages.where(only) if only is not None else pages
    pages.select(_cursor(F.col("chain"), F.col("page")).alias("cursor"), after.alias("next"), "items").write.mode("append").partitionBy("cursor").json(at)
    names = last.select("chain", _cursor(F.col("chain"), F.lit(0)).alias("cursor")).collect()  # a row a chain
    return at, {str(r["chain"]): r["cursor"] for r in names}


def write_archives(rows: DataFrame, *, id_col: str, text_col: str, members: int = 200) -> str:
    """A folder of gzipped tar archives with up to ``members`` texts each, ``<id>.tex``, written where their rows are."""
    spark = rows.sparkSession
    at = shared.folder(spark, "archives")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(at)
        system.create_dir(root, recursive=True)
        held: list[tuple[int, str]] = []
        name = None

        def close() -> None:
            if held:
                buffer = io.BytesIO()
                with gzip.GzipFile(fileobj=buffer, mode="wb", mtime=0) as packed, tarfile.open(fileobj=packed, mode="w") as archive:
                    for i, text in held:
                        data = text.encode()
                        entry = tarfile.TarInfo(f"{i}.tex")
                        entry.size = len(data)
                        archive.addfile(entry, io.BytesIO(data))
                # A task that runs again writes the same bytes to the same name.
                with system.open_output_stream(f"{root}/{name}.tar.gz", compression=None) as f:
                    f.write(buffer.getvalue())

        for frame in frames:
            for part, i, text in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                if part != name:
                    close()
                    held, name = [], part
                held.append((i, text or ""))
        close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["n"])

    part = F.floor(F.col(id_col) / members).alias("part")
    rows = rows.select(part, id_col, text_col).repartition("part").sortWithinPartitions("part", id_col)
    rows.mapInArrow(run, "n long").collect()  # no rows come back
    return at
