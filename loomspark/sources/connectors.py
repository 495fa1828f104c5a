"""Reading and writing outside tables: guarded SQL, keyset pages, NDJSON graphs, uploads."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

WRITES = re.compile(r"\b(create|merge|delete|set|remove|detach|drop|insert|update|truncate|alter|replace|refresh|cache|load|grant|call)\b", re.I)


def guarded_sql(spark: SparkSession, text: str, **args) -> DataFrame:  # noqa: ANN003
    """One SELECT or WITH statement over the session's views; anything that could write is refused."""
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|--[^\n]*|/\*.*?\*/", " ", text, flags=re.S).strip().rstrip(";")
    if not re.match(r"(select|with)\b", bare, re.I) or WRITES.search(bare) or ";" in bare:
        raise ValueError("only a single reading statement is allowed")
    return spark.sql(text.strip().rstrip(";"), args=args or None)


def keyset_page(rows: DataFrame, cursor: str, after, limit: int, content: list[str], id_column: str) -> DataFrame:  # noqa: ANN001
    """id, cursor, text of the next rows by cursor: id is a hash, text the content columns that are not null, a line each."""
    found = rows.where(F.col(cursor) > F.lit(after)) if after is not None else rows
    found = found.orderBy(cursor, id_column).limit(limit)
    return found.select(F.substring(F.sha2(F.col(id_column).cast("string").cast("binary"), 256), 1, 32).alias("id"), F.col(cursor).alias("cursor"), F.concat_ws("\n", *[F.col(c).cast("string") for c in content]).alias("text"))


def keyset_pages(rows: DataFrame, cursor: str, after, batch: int, content: list[str], id_column: str) -> Iterator[DataFrame]:  # noqa: ANN001
    """Pages of at most `batch` rows until a short one; each begins behind the cursor of the one before, and is read once."""
    while True:
        page = keyset_page(rows, cursor, after, batch, content, id_column).persist()
        n, last = page.agg(F.count("*"), F.max("cursor")).first()
        if n:
            yield page
        page.unpersist()
        if n < batch:
            return
        after = last


def export_ndjson(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """section, value: typed JSON lines of nodes, then edges; write them with write.text by section."""
    line = lambda df, kind, n: df.select(F.lit(n).alias("section"), F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*df.columns).alias("data"))).alias("value"))
    return line(nodes, "node", 1).unionByName(line(edges, "edge", 2))


def import_ndjson(lines: DataFrame, node_schema: str, edge_schema: str, salt: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and the lines that were skipped (malformed, of other types, or edges with an unknown end).

    With a salt the nodes are copied under new ids, and the edges follow.
    """
    parsed = lines.withColumn("p", F.from_json("value", f"type string, data string"))  # noqa: F541
    data = F.get_json_object("value", "$.data")
    nodes = parsed.where("p.type = 'node'").select(F.from_json(data, node_schema).alias("d")).select("d.*").where("id is not null")
    edges = parsed.where("p.type = 'edge'").select("value", F.from_json(data, edge_schema).alias("d")).select("value", "d.*")
    if salt is not None:
        fresh = lambda c: F.substring(F.sha2(F.concat(F.lit(salt), F.lit(":"), c).cast("binary"), 256), 1, 32)
        nodes = nodes.withColumn("id", fresh(F.col("id")))
        edges = edges.withColumns({c: fresh(F.col(c)) for c in ("id", "source_id", "target_id")})
    ids = nodes.select("id").distinct()
    good = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    other = parsed.where("p.type is null or p.type not in ('node', 'edge', 'metadata')").select("value")
    return nodes, good.drop("value"), other.unionByName(edges.join(good.select("value"), "value", "left_anti").select("value"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.deep = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:  # noqa: ARG002
        self.deep += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.deep -= tag in ("script", "style") and self.deep > 0

    def handle_data(self, data: str) -> None:
        if not self.deep and data.strip():
            self.out.append(" ".join(data.split()))


def parsed_text(name: str, kind: str | None, content: bytes) -> tuple[str | None, str | None]:
    """Text and error of an upload, by media type or suffix; unknown ones are read as plain text."""
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if kind in ("application/pdf",) or suffix in ("pdf", "docx"):
        return None, f"no parser for {suffix or kind} is installed"
    text = content.decode("utf-8", "replace")
    if kind == "text/html" or suffix in ("html", "htm"):
        parser = _Text()
        parser.feed(text)
        return "\n".join(parser.out), None
    if kind == "text/markdown" or suffix in ("md", "markdown"):
        return plain_markdown(text), None
    return text, None


def plain_markdown(text: str) -> str:
    """Markdown without fences, marks of headings, lists, quotes and emphasis; links and pictures keep their words."""
    lines = [re.sub(r"^\s*(?:#{1,6}\s+|>\s?|[-*+]\s+|\d+[.)]\s+)", "", x) for x in text.splitlines() if not re.match(r"^\s*(?:```|~~~|[-*_]{3,}\s*$)", x)]
    flat = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", "\n".join(lines))
    return re.sub(r"(\*\*|__|\*|`)(?=\S)(.+?)(?<=\S)\1", r"\2", flat).strip()


def uploads(files: DataFrame) -> DataFrame:
    """path, text, error of binary files (path, content), as spark.read.format('binaryFile') gives them; empty files are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [parsed_text(p, None, c or b"") for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame({"path": pdf["path"], "text": [t for t, _ in both], "error": [e for _, e in both]})

    return files.where(F.length("content") > 0).select("path", "content").mapInPandas(run, "path string, text string, error string").where("error is not null or trim(text) <> ''")


def split_uploads(files: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Texts (path, text) of files, and a dead letter (path, reason, failed_at) for each that could not be read."""
    read = uploads(files)
    return read.where("error is null").select("path", "text"), read.where("error is not null").select("path", F.col("error").alias("reason"), now.alias("failed_at"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file of JSON lines; lines that are no object of the schema are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def listed(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """A small YAML list of mappings (a corpus or tasks) as rows; missing keys are null, other keys are left out."""
    import yaml  # only here, so that nothing else needs it

    kind = spark.createDataFrame([], schema).schema
    rows = [x for x in yaml.safe_load(text) or [] if isinstance(x, dict)]
    shown = lambda x: x if x is None or isinstance(x, (str, int, float, bool, list, dict)) else str(x)
    return spark.createDataFrame([tuple(shown(r.get(f.name)) for f in kind.fields) for r in rows], kind)


def kafka_source(servers: str, topic: str, rows: int = 100, start: str = "earliest") -> dict[str, str]:
    """Options of spark.readStream.format('kafka') for micro-batches of at most so many messages; use trigger(processingTime='2 seconds')."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "maxOffsetsPerTrigger": str(rows), "startingOffsets": start, "failOnDataLoss": "false"}


def kafka_range(servers: str, topic: str, start_ms: int, end_ms: int | None = None) -> dict[str, str]:
    """Options of spark.read.format('kafka') for the messages of a span of time."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingTimestamp": str(start_ms)}
    return out | ({"endingTimestamp": str(end_ms)} if end_ms is not None else {})


def kafka_rows(rows: DataFrame, key: str = "agent_id") -> DataFrame:
    """key, value for a Kafka sink: rows of one agent keep their order; the value is the row as JSON."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def kafka_sink(servers: str, topic: str) -> dict[str, str]:
    """Options of writeStream.format('kafka') for an idempotent producer."""
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.enable.idempotence": "true"}


class SqlPages(DataSource):
    """A data source 'sql_pages': the rows of a query on a DB-API database by keyset pages, as a table or as a stream.

    Options: module (sqlite3), database, query, cursor (an ascending column), batch, and after, a cursor to go on from. A
    stream's offset is the last cursor value read; rows that come later must have greater ones. For it `rows` bounds a
    batch, once the reader knows where it stands (not the first batch after a restart, which takes all there is), and
    whole-number cursors are dealt into `partitions` ranges of the batch's rows, read by as many tasks.
    Register it with spark.dataSource.register(SqlPages) and give the schema with the read.
    """

    @classmethod
    def name(cls) -> str:
        return "sql_pages"

    def reader(self, schema) -> SqlPagesReader:  # noqa: ANN001
        return SqlPagesReader(schema.fieldNames(), dict(self.options))

    def streamReader(self, schema) -> SqlPagesStream:  # noqa: ANN001, N802
        return SqlPagesStream(schema.fieldNames(), dict(self.options))


class _Pages:
    """Pages of a guarded query between two values of its cursor."""

    def __init__(self, columns: list[str], options: dict[str, str]) -> None:
        query, cursor = options["query"].strip().rstrip(";"), options["cursor"]
        if not re.match(r"(select|with)\b", query, re.I) or ";" in query or WRITES.search(query) or not re.fullmatch(r"[A-Za-z_]\w*", cursor):
            raise ValueError("only a reading query and a plain cursor column are allowed")
        self.columns, self.options, self.query, self.cursor = columns, options, query, cursor

    def _asked(self, sql: str, values: tuple) -> list[tuple]:
        import importlib

        connection = importlib.import_module(self.options.get("module", "sqlite3")).connect(self.options["database"])
        try:
            return connection.execute(sql, values).fetchall()
        finally:
            connection.close()

    def _between(self, after, upto) -> tuple[str, tuple]:  # noqa: ANN001
        bounds = [(f"{self.cursor} > ?", after), (f"{self.cursor} <= ?", upto)]
        used = [(c, v) for c, v in bounds if v is not None]
        return (" WHERE " + " AND ".join(c for c, _ in used) if used else ""), tuple(v for _, v in used)

    def pages(self, after, upto=None) -> Iterator[tuple]:  # noqa: ANN001
        batch, names = int(self.options.get("batch", "500")), ", ".join(self.columns)
        while True:
            where, values = self._between(after, upto)
            rows = self._asked(f"SELECT {names}, {self.cursor} FROM ({self.query}) q{where} ORDER BY {self.cursor} LIMIT {batch}", values)
            yield from (r[:-1] for r in rows)
            if len(rows) < batch:
                return
            after = rows[-1][-1]


class SqlPagesReader(_Pages, DataSourceReader):
    def read(self, partition) -> Iterator[tuple]:  # noqa: ANN001, ARG002
        return self.pages(self.options.get("after"))


class KeyRange(InputPartition):
    def __init__(self, after, upto) -> None:  # noqa: ANN001
        self.after, self.upto = after, upto


class SqlPagesStream(_Pages, DataSourceStreamReader):
    """The rows of a batch are those with a cursor after its start and up to its end, so a batch read again gives the same rows."""

    at = None  # where the next batch begins, once that is known
    known = False

    def initialOffset(self) -> dict:  # noqa: N802
        self.at, self.known = self.options.get("after"), True
        return {"cursor": self.at}

    def latestOffset(self) -> dict:  # noqa: N802
        where, values = self._between(self.at, None)
        rows = int(self.options.get("rows", "0"))
        found = self._asked(f"SELECT {self.cursor} FROM ({self.query}) q{where} ORDER BY {self.cursor} LIMIT 1 OFFSET {rows - 1}", values) if rows and self.known else []
        last = found[0][0] if found else self._asked(f"SELECT MAX({self.cursor}) FROM ({self.query}) q{where}", values)[0][0]
        return {"cursor": self.at if last is None else last}

    def partitions(self, start: dict, end: dict) -> list[KeyRange]:
        after, upto = start["cursor"], end["cursor"]
        self.at, self.known = upto, True
        if upto is None or after == upto:
            return []
        parts = int(self.options.get("partitions", "1"))
        if parts > 1 and isinstance(upto, int):
            where, values = self._between(after, upto)
            least = self._asked(f"SELECT MIN({self.cursor}) FROM ({self.query}) q{where}", values)[0][0]
            if least is not None:
                cuts = sorted({least - 1 + (upto - least + 1) * i // parts for i in range(1, parts)} - {least - 1, upto})
                return [KeyRange(a, b) for a, b in zip([after, *cuts], [*cuts, upto], strict=True)]
        return [KeyRange(after, upto)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        return self.pages(partition.after, partition.upto)


class EpochFiles(DataSource):
    """A streaming sink 'epoch_files': JSON lines that count only once their epoch is committed.

    Option path, a folder (a local path or a URI that pyarrow knows). Each task writes one file under the epoch's folder and
    reports it; the commit writes the epoch's list of files, in one step. A task or an epoch that fails leaves no
    list, an epoch that comes again replaces its list, and what no list names is never read. committed() reads the rest.
    """

    @classmethod
    def name(cls) -> str:
        return "epoch_files"

    def streamWriter(self, schema, overwrite: bool) -> EpochWriter:  # noqa: ANN001, ARG002, N802
        return EpochWriter(dict(self.options)["path"], schema.fieldNames())


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class EpochWriter(DataSourceStreamWriter):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns = path, columns

    def _store(self):  # noqa: ANN202
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def write(self, iterator) -> Written:  # noqa: ANN001
        store, root = self._store()
        store.create_dir(f"{root}/data", recursive=True)
        file, n = f"data/{uuid.uuid4().hex}.jsonl", 0
        with store.open_output_stream(f"{root}/{file}") as out:
            for row in iterator:
                out.write((json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False) + "\n").encode())
                n += 1
        return Written(file, n)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        store, root = self._store()
        store.create_dir(f"{root}/epochs", recursive=True)
        listed = [m.file for m in messages if m and m.rows]
        with store.open_output_stream(f"{root}/_{batchId}.tmp") as out:
            out.write(json.dumps(listed).encode())
        store.move(f"{root}/_{batchId}.tmp", f"{root}/epochs/{batchId:012d}.json")
        self._remove(store, root, [m.file for m in messages if m and not m.rows])

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: ARG002, N803
        store, root = self._store()
        self._remove(store, root, [m.file for m in messages if m])

    def _remove(self, store, root: str, files: list[str]) -> None:  # noqa: ANN001
        for f in files:
            store.delete_file(f"{root}/{f}")


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of an epoch_files sink whose epochs were committed."""
    lists = spark.read.text(f"{path}/epochs", wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("f")) if _has(spark, f"{path}/epochs") else None
    files = [f"{path}/{r.f}" for r in lists.collect()] if lists is not None else []  # names of files, not rows
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)


def _has(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
