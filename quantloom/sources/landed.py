"""Landed vendor files as Spark sources: wide bars (a column a field and symbol) and share counts in a folder a symbol."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import DateType, StringType, StructField, StructType

from ..shipping import ship
from .ingest import PRICE_FIELDS

CELLS = 1 << 20  # values read into a task's memory at once


@dataclass
class _Part(InputPartition):
    file: str
    symbols: tuple[str, ...]


def _files(path: str):
    """The file system of ``path`` and its Parquet files (itself, or all under the folder), in the order of their names."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if system.get_file_info(root).type == fs.FileType.File:
        return system, [root]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda p: any(step[:1] in "_." for step in p[len(root) :].strip("/").split("/"))
    return system, sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet") and not hidden(f.path))


class LandedBarsReader(DataSourceReader):
    """A partition is a file and some of its symbols; of the file only their columns of the asked fields are read."""

    def __init__(self, schema: StructType, options):
        self.schema, self.path = schema, options["path"]
        self.date, self.some = options.get("datecolumn", "date"), int(options.get("symbols", "200"))
        self.only: set[str] | None = None
        self.fields = [f.name for f in schema.fields if f.name not in ("date", "symbol")]

    def pushFilters(self, filters):
        """Equality and membership of symbols choose columns; all other filters are left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("symbol",):
                asked = {v for v in ([f.value] if isinstance(f, EqualTo) else f.value) if v is not None}
                self.only = asked if self.only is None else self.only & asked
            else:
                yield f

    def partitions(self):
        import pyarrow.parquet as pq

        system, files = _files(self.path)
        parts = []
        for file in files:
            with system.open_input_file(file) as f:
                names = pq.read_schema(f).names  # the footer alone
            have: dict[str, set[str]] = {}
            for name in names:
                field, bar, symbol = name.partition("|")
                if bar and (self.only is None or symbol in self.only):
                    have.setdefault(symbol, set()).add(field)
            whole = [s for s, fields in have.items() if fields.issuperset(PRICE_FIELDS)]
            parts += [_Part(file, tuple(whole[k : k + self.some])) for k in range(0, len(whole), self.some)]
        return parts or [_Part("", ())]

    def read(self, part: _Part):
        import pyarrow as pa
        import pyarrow.parquet as pq

        if not part.symbols:
            return
        system, _ = _files(self.path)
        names = {(f, s): f"{f}|{s}" for f in self.fields for s in part.symbols}
        at_once = max(1, CELLS // max(1, len(names)))
        with system.open_input_file(part.file) as f:
            for rows in pq.ParquetFile(f).iter_batches(batch_size=at_once, columns=[self.date, *names.values()]):
                columns = []
                for field in self.schema.fields:
                    if field.name == "symbol":
                        columns.append(pa.concat_arrays([pa.array([s] * rows.num_rows, pa.string()) for s in part.symbols]))
                    elif field.name == "date":
                        kind = pa.date32() if isinstance(field.dataType, DateType) else pa.string()
                        columns.append(pa.concat_arrays([rows.column(self.date).cast(kind)] * len(part.symbols)))
                    else:
                        columns.append(pa.concat_arrays([rows.column(names[field.name, s]).cast(pa.float64()) for s in part.symbols]))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in self.schema.fields])


class LandedBars(DataSource):
    """``spark.read.format("landed_bars")``: date, symbol and the vendor's fields from Parquet files with columns ``Field|SYMBOL``.

    A row of a file and a symbol with all six fields give a row, whose fields may be NULL; symbols that lack a field are left
    out of that file.  A schema with fewer fields reads fewer columns.  Options: ``path``; ``datecolumn``; ``symbols``, most in a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "landed_bars"

    def schema(self) -> str:
        return "date string, symbol string, " + ", ".join(f"`{f}` double" for f in PRICE_FIELDS)

    def reader(self, schema: StructType) -> LandedBarsReader:
        known = {"date", "symbol", *PRICE_FIELDS}
        if bad := [f.name for f in schema.fields if f.name not in known]:
            raise ValueError(f"no fields of landed bars: {bad}")
        return LandedBarsReader(schema, self.options)


def landed_bars(spark: SparkSession, path: str, fields=None, date_type: str = "string", **options: str) -> DataFrame:
    """Bars of the landed files at ``path``, with the vendor's ``fields`` (all, if None); filters on ``symbol`` choose the columns read.

    Registers the source in the session and lets Python sources take filters (``spark.sql.python.filterPushdown.enabled``).
    """
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedBars)
    wanted = f"date {date_type}, symbol string" + "".join(f", `{f}` double" for f in (PRICE_FIELDS if fields is None else fields))
    return spark.read.format("landed_bars").schema(wanted).options(**options).load(path)


def share_files(spark: SparkSession, path: str) -> DataFrame:
    """Share counts from ``path/symbol=X/``, or from one table with a symbol; filters on ``symbol`` leave out folders.

    Symbols are strings even where all of them look like numbers.
    """
    found = spark.read.parquet(path).schema
    return spark.read.schema(StructType([StructField("symbol", StringType()) if f.name == "symbol" else f for f in found.fields])).parquet(path)
