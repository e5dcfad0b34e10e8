"""Scans with contracts, assembly of columns from several tables, validated replacement."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """What a dataset promises: its key, required columns, and columns in which 0 means missing."""

    name: str
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    zero_is_missing: tuple[str, ...] = ()
    date: str | None = None
    notes: dict[str, str] = field(default_factory=dict)

    def problems(self, df: DataFrame, unique: bool = True) -> list[str]:
        """Missing columns, null keys and repeated keys; one aggregate over the table."""
        missing = [c for c in (*self.key, *self.required) if c not in df.columns]
        if missing:
            return [f"{self.name}: no column {c}" for c in missing]
        out = []
        nulls = df.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in self.key]).first()
        out += [f"{self.name}: {nulls[k]} null values of {k}" for k in self.key if nulls[k]]
        if unique and not df.groupBy(*self.key).count().where("count > 1").isEmpty():
            out.append(f"{self.name}: ({', '.join(self.key)}) repeats")
        return out


def scan(spark: SparkSession, path: str, contract: Contract, columns: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The wanted columns in a date range; both reach the Parquet reader.  Declared zeros are null."""
    df = spark.read.parquet(path)
    if contract.date and start:
        df = df.where(F.col(contract.date) >= F.lit(start))
    if contract.date and end:
        df = df.where(F.col(contract.date) <= F.lit(end))
    if columns:
        df = df.select(*dict.fromkeys([*contract.key, *columns]))
    zeros = [c for c in contract.zero_is_missing if c in df.columns]
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0).cast(dict(df.dtypes)[c])) for c in zeros}) if zeros else df


def assemble(spark: SparkSession, root: str, manifest: dict[str, list[str]], key: tuple[str, ...]) -> DataFrame:
    """Columns from several tables under ``root``, joined one to one on the key."""
    out = None
    for path, columns in manifest.items():
        if path.startswith("/") or ".." in path.split("/") or "://" in path:
            raise ValueError(f"{path} leaves {root}")
        df = scan(spark, f"{root}/{path}", Contract(path, key), columns)
        if bad := Contract(path, key, tuple(columns)).problems(df):
            raise ValueError("; ".join(bad))
        out = df if out is None else out.join(df, list(key))
    if out is None:
        raise ValueError("an empty manifest")
    return out


def replace_table(df: DataFrame, path: str, contract: Contract, least_rows: int = 0, backup: bool = True) -> int:
    """Writes beside ``path``, checks rows and contract of what was written, then swaps by rename.

    The table before stays as ``path.bak`` with ``backup``.  Gives the number of rows.
    """
    spark = df.sparkSession
    staging = f"{path}.building-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(staging)
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = spark.read.schema(df.schema).parquet(staging)
    n, bad = written.count(), contract.problems(written)
    if n < least_rows:
        bad.append(f"{n} rows; at least {least_rows} were due")
    if bad:
        fs.delete(at(staging), True)
        raise ValueError("; ".join(bad))
    if fs.exists(at(path)):
        fs.delete(at(f"{path}.bak"), True)
        fs.rename(at(path), at(f"{path}.bak"))
    fs.rename(at(staging), at(path))
    if not backup:
        fs.delete(at(f"{path}.bak"), True)
    return n


def read_many(spark: SparkSession, paths: dict[str, str], column: str = "exchange") -> DataFrame:
    """One table from a path or glob for each exchange, with its name in ``column``; missing columns are null."""
    out = None
    for name, path in paths.items():
        part = spark.read.parquet(path).withColumn(column, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths")
    return out


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """Tab-separated text (lists of instruments); lines that don't fit the schema have nulls."""
    return spark.read.csv(path, sep="\t", schema=schema, header=header, mode="PERMISSIVE")


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A report as one file of ``kind`` (csv with a header, json or text) in the folder ``path``; reports are a few rows."""
    if kind not in ("csv", "json", "text"):
        raise ValueError(f"unknown kind of report {kind!r}")
    w = df.coalesce(1).write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else getattr(w, kind)(path)


@dataclass
class CollectorState:
    """What a collector has seen, as one JSON line a source: its last id and time.

    Kept by Spark's writers, so it can be in any store; a new state replaces the old
    one only when it is written.
    """

    spark: SparkSession
    path: str

    def load(self) -> dict[str, dict]:
        try:
            rows = self.spark.read.text(self.path).collect()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return {}
            raise
        return {r["source"]: r for r in (json.loads(x.value) for x in rows)}

    def save(self, source: str, **seen: str) -> dict[str, dict]:
        state = self.load() | {source: {"source": source, **seen}}
        lines = [(json.dumps(state[k], sort_keys=True),) for k in sorted(state)]
        self.spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(self.path)
        return state
