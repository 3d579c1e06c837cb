"""Query op10: every document as stored WAV samples and their fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm.common import read
from treeline.llm.media import store_and_fingerprint

NAME = "op10_wav_peak_fingerprints"
#: Fourier transforms of stored samples are beyond SQL; tests hold the query against a direct transform.
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = store_and_fingerprint(read(spark, sf_dir, "documents"), keep_media=False)
    pairs = F.transform(F.arrays_zip("times", "codes"), lambda x: F.concat_ws(":", x["times"], F.lower(F.hex(x["codes"]))))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.array_join(pairs, " ").alias("feature"))
