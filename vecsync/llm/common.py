"""Helpers shared by the training-data operators."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecsync.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, name: str = "__row") -> Column:
    """All columns of ``df`` as one struct, so that added columns cannot clash with them."""
    return F.struct(*[col(c) for c in df.columns]).alias(name)


def unpacked(df: DataFrame, columns: list[str], name: str = "__row") -> DataFrame:
    return df.select(*[F.col(name).getField(c).alias(c) for c in columns])


def id_keys(name: str) -> list[Column]:
    """An identifier as two columns that are never null, so that joins and aggregations on
    them share a partitioning: ``id_none``, ``id_text``."""
    return [col(name).isNull().alias("id_none"),
            F.coalesce(col(name).cast("string"), F.lit("")).alias("id_text")]


def _has_map(kind) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def one_of_each(df: DataFrame, keys: list[str], name: str = "__row") -> DataFrame:
    """Of the rows with equal ``keys`` the one whose packed columns have the least hash, so a
    repeated run keeps the same one."""
    every = F.xxhash64(F.to_json(name) if _has_map(df.schema[name].dataType) else F.col(name))
    return df.groupBy(*keys).agg(F.min_by(name, every).alias(name))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes: exactly the white
    space that ``bytes.split`` knows."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder of ``spark.checkpoint.dir`` and read it back:
    cuts the lineage, survives lost executors, and keeps columns prunable."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def slices(batches: Iterator, text: str, most: int = 4_000_000) -> Iterator:
    """Cut pandas batches into runs of rows of about ``most`` characters, so that what a
    task holds beside its batch is bounded by that and by the longest single text."""
    for pdf in batches:
        if not len(pdf):
            continue
        ends = pdf[text].str.len().fillna(0).cumsum().to_numpy()
        at = 0
        while at < len(pdf):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int((ends <= base + most).sum()))
            yield pdf.iloc[at:to]
            at = to


def per_text(docs: DataFrame, id_col: str, text_col: str, fn: Callable, schema: str,
             most: int = 4_000_000) -> DataFrame:
    """``fn`` over frames of (doc_id, text) of about ``most`` characters; other columns never
    reach Python."""
    src = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))

    def run(batches):
        for pdf in slices(batches, "text", most):
            yield fn(pdf)

    return src.mapInPandas(run, schema)


def crc_of_id(id_col: str = "doc_id") -> Column:
    """crc32 of the identifier written as text (a null identifier as empty text)."""
    return F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A character for each byte, as byte-level vocabularies spell them: printable Latin-1 as it
#: is, the others in order from U+0100 on.
BYTE_LETTER = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172
                                                      or b >= 174)], map(chr, range(256, 324))))


def byte_letters(text: str) -> str:
    return text.encode("utf-8").decode("latin-1").translate(BYTE_LETTER)


class Recent(dict):
    """A dict that forgets: the entries of the last one or two generations of ``size``."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) < self.size:
            self[key] = value
        else:
            self.put(key, value)
        return value
