"""Graphs as CSR files: a Python data source that writes and reads them in parts.

A folder holds ``nodes-<first>.npz`` (ids, the nodes at positions first,
first + 1, ...) and ``arcs-<first>.npz`` (rows, the positions of nodes with arcs
in this part; indptr; neighbors, positions too). Parts have a bounded number of
nodes or arcs, so a hub's arcs go on in the next part. A single file with
node_ids, indptr and neighbors of a whole graph is read as well, as one part.
Paths may be any that pyarrow's file systems know.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from loomgraph.model import Graph
from loomgraph.operators.ranks import placed
from loomgraph.store import cut

#: Nodes or arcs of a part.
PART = 1 << 22
#: Rows that a reader hands on at once.
ROWS = 1 << 16

#: The arrays of a file that holds a whole graph.
WHOLE = ("node_ids", "indptr", "neighbors")


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _load(path: str) -> dict[str, np.ndarray]:
    system, at = _at(path)
    with system.open_input_file(at) as f, np.load(io.BytesIO(f.read())) as arrays:
        return {k: arrays[k].astype(np.int64, copy=False) for k in arrays.files if arrays[k].ndim == 1}


@dataclass
class Part(InputPartition):
    """A file, and the position of its first node."""

    path: str
    first: int


class CsrReader(DataSourceReader):
    """Rows (pos, id) of the nodes or (src_pos, dst_pos) of the arcs."""

    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def partitions(self) -> list[Part]:
        if self.path.endswith(".npz"):
            return [Part(self.path, 0)]
        system, at = _at(self.path)
        head = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        found = [(re.fullmatch(rf"{self.table}-(\d+)\.npz", x.base_name), x.path) for x in system.get_file_info(fs.FileSelector(at))]
        return [Part(head + p, int(m[1])) for m, p in sorted((x for x in found if x[0]), key=lambda x: x[1])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        arrays = _load(part.path)
        ids = arrays.get("ids", arrays.get(WHOLE[0]))
        if self.table == "nodes":
            a, b, names = np.arange(part.first, part.first + len(ids)), ids, ["pos", "id"]
        else:
            size = np.diff(arrays["indptr"])
            rows = arrays["rows"] if "rows" in arrays else np.arange(len(size))
            a, b, names = np.repeat(rows, size), arrays["neighbors"], ["src_pos", "dst_pos"]
        for k in range(0, len(a), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(a[k : k + ROWS], pa.int64()), pa.array(b[k : k + ROWS], pa.int64())], names=names)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class CsrWriter(DataSourceArrowWriter):
    """Rows (part, first, a, b), those of a part one after another, as files that appear when all are written."""

    def __init__(self, path: str, table: str, overwrite: bool):
        self.path, self.table, self.overwrite = path, table, overwrite
        self.aside = f"{path.rstrip('/')}/_unfinished-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, held = [], []
        system, aside = _at(self.aside)
        system.create_dir(aside)

        def close() -> None:
            if held:
                first, a, b = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
                if self.table == "nodes":
                    arrays = {"ids": b}
                else:
                    rows, at = np.unique(a, return_index=True)
                    arrays = {"rows": rows, "indptr": np.append(at, len(a)), "neighbors": b}
                data = io.BytesIO()
                np.savez(data, **arrays)
                # a task that is run again writes files of its own; commit names those that count
                name = f"{self.table}-{int(first[0]):020d}.npz-{uuid.uuid4().hex}"
                with system.open_output_stream(f"{aside}/{name}") as f:
                    f.write(data.getvalue())
                files.append(name)
                held.clear()

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            bounds = [0, *(np.flatnonzero(np.diff(cols[0])) + 1).tolist(), len(cols[0])]
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                if y > x:
                    if held and held[0][0][0] != cols[0][x]:
                        close()
                    held.append([c[x:y] for c in cols])
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = _at(self.path)
        _, aside = _at(self.aside)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if x.is_file and re.fullmatch(rf"{self.table}-\d+\.npz", x.base_name):
                    system.delete_file(x.path)
        for m in messages:
            for name in m.files if m else ():
                system.move(f"{aside}/{name}", f"{at}/{name.rpartition('-')[0]}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, aside = _at(self.aside)
        if system.get_file_info(aside).type != fs.FileType.NotFound:
            system.delete_dir(aside)


class CsrSource(DataSource):
    """``csr``, with the option table: nodes or arcs."""

    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return "pos bigint, id bigint" if self.options.get("table") == "nodes" else "src_pos bigint, dst_pos bigint"

    def reader(self, schema) -> CsrReader:
        return CsrReader(self.options["path"], self.options.get("table", "arcs"))

    def writer(self, schema, overwrite: bool) -> CsrWriter:
        return CsrWriter(self.options["path"], self.options.get("table", "arcs"), overwrite)


def write_csr(graph: Graph, path: str, part: int = PART) -> None:
    """The graph as CSR files of at most ``part`` nodes or arcs; the files of an earlier graph there are replaced.

    Positions are ranks of the ids; arcs are cut by their places in the order
    of (source, target), so no task holds all arcs of a hub.
    """
    spark = graph.nodes.sparkSession
    spark.dataSource.register(CsrSource)
    index, _ = placed(graph.nodes.select("id"), [F.col("id")], "pos")
    index = cut(index, "csr")
    src, dst = (index.select(F.col("id").alias(c), F.col("pos").alias(f"{c}_pos")) for c in ("src", "dst"))
    arcs, _ = placed(graph.arcs.join(src, "src").join(dst, "dst").select("src_pos", "dst_pos"), [F.col("src_pos"), F.col("dst_pos")])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for table, rows, a, b, place in (("nodes", index, "pos", "id", "pos"), ("arcs", arcs, "src_pos", "dst_pos", "place")):
        number = F.floor(F.col(place) / part).alias("part")
        rows = rows.select(number, (number * part).alias("first"), F.col(a).alias("a"), F.col(b).alias("b"))
        rows.repartition(n, "part").sortWithinPartitions("part", "a", "b").write.format("csr").option("table", table).mode("overwrite").save(path)


def read_csr(spark: SparkSession, path: str, directed: bool = True) -> Graph:
    """The graph of a folder that ``write_csr`` has written, or of one file; positions are decoded by a join with the nodes."""
    spark.dataSource.register(CsrSource)
    nodes, arcs = (spark.read.format("csr").option("table", t).load(path) for t in ("nodes", "arcs"))
    nodes = cut(nodes, "csr-nodes")
    src, dst = (nodes.select(F.col("pos").alias(f"{c}_pos"), F.col("id").alias(c)) for c in ("src", "dst"))
    return Graph(nodes.select("id"), arcs.join(src, "src_pos").join(dst, "dst_pos").select("src", "dst"), directed)
