"""Keys tried against a known ciphertext, at many places of many images at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytefold.functions.crypto import CHECK_IV, encrypt, verifies
from bytefold.operators.chunks import CHUNK


@dataclass(frozen=True)
class Verifier:
    """A cipher's check as column expressions, so that it runs in the JVM."""

    name: str
    key_length: int
    verify: Callable[[Column, Column, Column, bytes], Column]  # key, ciphertext, expected plaintext, vector
    seal: Callable[[Column, Column, bytes], Column]  # key, plaintext, vector


VERIFIERS: dict[str, Verifier] = {}


def register_verifier(verifier: Verifier) -> Verifier:
    """Add a cipher; one of the same name is replaced."""
    VERIFIERS[verifier.name] = verifier
    return verifier


register_verifier(Verifier("AES-256-CBC", 32, verifies, encrypt))


def verified(chunks: DataFrame, candidates: DataFrame, ciphertext: bytes, expected: bytes, cipher: str = "AES-256-CBC", iv: bytes = CHECK_IV, chunk: int = CHUNK) -> DataFrame:
    """The candidates ``(dump_id, off, …)`` whose bytes decrypt the ciphertext: their columns and ``key_hex, cipher``.

    A candidate meets the chunk it starts in, whose halo must hold a key; one that reaches beyond
    its image is left out.
    """
    v = VERIFIERS[cipher]
    at = candidates.withColumn("chunk_no", F.floor(F.col("off") / chunk).cast("int"))
    parts = chunks.select("dump_id", "chunk_no", F.col("data").alias("_data"))
    key = F.substring("_data", (F.col("off") - F.col("chunk_no").cast("bigint") * chunk + 1).cast("int"), F.lit(v.key_length))
    tried = at.join(parts, ["dump_id", "chunk_no"]).withColumn("_key", key).filter(F.octet_length("_key") == v.key_length)
    good = tried.filter(v.verify(F.col("_key"), F.lit(ciphertext), F.lit(expected), iv))
    return good.select(*candidates.columns, F.lower(F.hex("_key")).alias("key_hex"), F.lit(v.name).alias("cipher"))


def first_verified(chunks: DataFrame, candidates: DataFrame, ciphertext: bytes, expected: bytes, cipher: str = "AES-256-CBC", iv: bytes = CHECK_IV, chunk: int = CHUNK) -> DataFrame:
    """Per image the first candidate that verifies: ``dump_id, off, key_hex, cipher``.

    First by the column ``position`` of the candidates, or by offset without one.
    """
    order = F.col("position") if "position" in candidates.columns else F.col("off")
    good = verified(chunks, candidates, ciphertext, expected, cipher, iv, chunk)
    best = good.groupBy("dump_id").agg(F.min_by(F.struct("off", "key_hex", "cipher"), F.struct(order, "off")).alias("_b"))
    return best.select("dump_id", "_b.*")
