"""Stored tables: upsert, right to be forgotten, encrypted fields, token vault."""

from __future__ import annotations

import hashlib
import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """The latest row of each key; of equal versions the change counts."""
    both = current.withColumn("_src", F.lit(0)).unionByName(changes.withColumn("_src", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc(version), F.desc("_src"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_src")


def forget(tables: dict[str, DataFrame], deletions: DataFrame, key: str = "dossier_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the deleted dossiers, and the count removed by table."""
    gone = deletions.select(key).distinct()
    kept = {n: t.join(gone, key, "left_anti") for n, t in tables.items()}
    counts = [
        t.join(gone, key, "left_semi").agg(F.count(F.lit(1)).alias("removed")).select(F.lit(n).alias("table"), "removed") for n, t in tables.items()
    ]
    return kept, reduce(DataFrame.unionByName, counts)


def encrypt(plain: Column, key: Column, table: str, row_key: Column, nonce: Column | None = None) -> Column:
    """AES-256-GCM with a random 96-bit nonce; the table and key are bound in."""
    aad = F.concat(F.lit(f"{table}:"), row_key)
    iv = F.lit(b"") if nonce is None else nonce
    return F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), iv, F.encode(aad, "UTF-8"))


def decrypt(cipher: Column, key: Column, table: str, row_key: Column) -> Column:
    aad = F.concat(F.lit(f"{table}:"), row_key)
    return F.aes_decrypt(cipher, key, F.lit("GCM"), F.lit("DEFAULT"), F.encode(aad, "UTF-8")).cast("string")


def vault_merge(vault: DataFrame, new: DataFrame, key: str = "dossier_id", value: str = "pii_map") -> DataFrame:
    """Token maps by dossier; on a clash the new value counts."""
    n = new.select(F.col(key).alias("_k"), F.col(value).alias("_n"))
    joined = vault.join(n, F.col(key) == F.col("_k"), "full")
    old = F.map_filter(value, lambda t, _: ~F.map_contains_key(F.col("_n"), t))
    merged = F.when(F.col("_n").isNull(), F.col(value)).when(F.col(value).isNull(), F.col("_n")).otherwise(F.map_concat(old, F.col("_n")))
    return joined.select(F.coalesce(key, "_k").alias(key), merged.alias(value))


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == value)


def load(table: DataFrame, key: str, value: str, column: str, name: str, aes_key: Column) -> str:
    """The decrypted column of one row; KeyError if there is none."""
    row = lookup(table, key, value).select(decrypt(F.col(column), aes_key, name, F.col(key)).alias("plain")).first()
    if row is None:
        raise KeyError(f"{name}: no row {value}")
    return row.plain


def derive_key(passphrase: str, salt: bytes) -> bytes:
    """A 256-bit key by scrypt, whose cost is memory (128 MB); made on the driver."""
    if not passphrase:
        raise ValueError("a passphrase is needed")
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=1 << 17, r=8, p=1, maxmem=1 << 28, dklen=32)


class Vault:
    """Token maps of dossiers, encrypted, in a folder of any store.

    Every change writes a whole new version beside the last one; a version counts
    once Spark has committed it, so a reader sees the state before or the one after.
    The salt is stored with the entries, the passphrase nowhere."""

    NAME, KIND = "vault", "map<string,string>"

    def __init__(self, spark: SparkSession, path: str, passphrase: str):
        self.spark, self.path = spark, path.rstrip("/")
        last = self._last()
        salt = secrets.token_bytes(16) if last is None else bytes(spark.read.parquet(f"{self.path}/salt").first().salt)
        self._key = F.lit(derive_key(passphrase, salt))
        if last is None:
            spark.createDataFrame([(salt,)], "salt binary").write.parquet(f"{self.path}/salt")
            self._write(spark.createDataFrame([], "dossier_id string, cipher binary"), 0)

    def _last(self) -> int | None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/_SUCCESS"))
        numbers = [int(f.getPath().getParent().getName().split("=")[1]) for f in done or []]
        return max(numbers, default=None)

    def _write(self, entries: DataFrame, version: int) -> None:
        entries.write.mode("overwrite").parquet(f"{self.path}/version={version}")

    def entries(self) -> DataFrame:
        return self.spark.read.schema("dossier_id string, cipher binary").parquet(f"{self.path}/version={self._last()}")

    def opened(self) -> DataFrame:
        """(dossier_id, pii_map), decrypted; a wrong passphrase or a moved entry fails."""
        plain = decrypt(F.col("cipher"), self._key, self.NAME, F.col("dossier_id"))
        return self.entries().select("dossier_id", F.from_json(plain, self.KIND).alias("pii_map"))

    def store(self, new: DataFrame) -> None:
        """Merges maps (dossier_id, pii_map); on a clash the new value counts."""
        merged = vault_merge(self.opened(), new)
        sealed = merged.select("dossier_id", encrypt(F.to_json("pii_map"), self._key, self.NAME, F.col("dossier_id")).alias("cipher"))
        self._write(sealed, self._last() + 1)

    def load(self, dossier_id: str) -> dict[str, str]:
        row = lookup(self.opened(), "dossier_id", dossier_id).first()
        if row is None:
            raise KeyError(f"no map of {dossier_id}")
        return row.pii_map

    def forget(self, dossier_id: str) -> bool:
        """Whether there was a map; it is in no later version, and the earlier ones are deleted."""
        entries = self.entries()
        if not lookup(entries, "dossier_id", dossier_id).count():
            return False
        last = self._last()
        self._write(entries.where(F.col("dossier_id") != dossier_id), last + 1)
        jvm = self.spark._jvm
        fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for v in range(last + 1):
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={v}"), True)
        return True

    def dossiers(self) -> DataFrame:
        return self.entries().select("dossier_id").orderBy("dossier_id")


def listing(table: DataFrame, columns: list[str], updated: str) -> DataFrame:
    return table.select(*columns, updated).orderBy(F.desc(updated), *columns)
