"""What leaves: protected texts once nothing waits for an answer and the audit is clean; and what is kept: tables of vaults and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators import vault
from . import versions


def take_out(protected: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, protected of documents without open suggestions."""
    waiting = F.exists("findings", lambda f: f["confidence"] == "suggest")
    return protected.where(~waiting).select(id_col, "protected")


def write_take_out(protected: DataFrame, audit: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes Parquet; a leak in any document stops the whole write."""
    if audit.where("leak").limit(1).count():
        raise ValueError("a protected value is left in a text")
    take_out(protected, id_col).write.mode("errorifexists").parquet(path)


#: Tables of a vault and of a session; a folder keeps them in versions.
SESSION = {"tokens": "session string, token string, value string, kind string", "payloads": "payload_id long, session string, made timestamp, answered boolean"}
TABLES = {**vault.SCHEMAS, **SESSION}


def save_tables(tables: dict[str, DataFrame], folder: str, read: int | None = None) -> int:
    """Tables of a vault or session by name, each whole and in its own schema, as the folder's next version, whose number is given.

    read: the version that the change was made from: what load_tables gave (taken from `tables` if it is that), or the
    folder's last one. A version that came in between raises versions.Changed, and nothing is changed. Tables not given
    stay. The tables may be read from the same folder.
    """
    if not tables:
        raise ValueError("no tables to save")
    spark = next(iter(tables.values())).sparkSession
    if read is None:
        read = tables.version if isinstance(tables, versions.Tables) else max(versions.versions(spark, folder), default=0)
    cast = {n: [F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(TABLES[n]).fields] for n in tables}
    return versions.commit(spark, folder, {n: t.select(*cast[n]) for n, t in tables.items()}, read)


def load_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(TABLES), version: int | None = None) -> versions.Tables:
    """The tables of a folder's last version (or of a given one) by name, with its number. A table that isn't there is empty,
    as all of a locked vault's are to a scan."""
    out = versions.Tables()
    out.version = max(versions.versions(spark, folder), default=0) if version is None else version
    at = versions.manifest(spark, folder, out.version)
    for name in names:
        out[name] = spark.read.schema(TABLES[name]).parquet(f"{folder}/{at[name]}") if name in at else spark.createDataFrame([], TABLES[name])
    return out
