"""Content evidence: hashes of selected files, duplicate groups, and their features by directory."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import paths
from treeline.store import ship, written

#: Evidence levels, and what their matches prove. Level D3 is a full hash like D4; both are SHA-256 here.
LEVELS = {"D2": ("SHA-256-SAMPLED-V1", "CANDIDATE"), "D3": ("SHA-256", "CONFIRMED"), "D4": ("SHA-256", "CONFIRMED")}
SAMPLE_BYTES = 65_536
_SAMPLE_TAG = b"treeline-sampled-v1\x00"


def _eight(number: Column) -> Column:
    """A number as eight bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 16, "0"))


def _samples(size: Column, sample: int) -> list[Column]:
    """Where samples start: the beginning, the middle and the end; null for one that is there already."""
    middle, end = F.floor((size - sample) / 2).cast("long"), (size - sample).cast("long")
    return [F.lit(0).cast("long"), F.when((size > sample) & (middle > 0), middle), F.when((size > sample) & (end > middle), end)]


def sampled_digest(data: Column, sample: int = SAMPLE_BYTES) -> Column:
    """SHA-256 over the tag, the size and each sample with its offset and length."""
    size = F.length(data)
    nothing = F.unhex(F.lit(""))
    parts = [F.when(at.isNotNull(), F.concat(_eight(at), _eight(F.least(size - at, F.lit(sample))), F.substr(data, (at + 1).cast("int"), F.lit(sample)))).otherwise(nothing) for at in _samples(size, sample)]
    return F.sha2(F.concat(F.lit(_SAMPLE_TAG), _eight(size), *parts), 256)


def hash_content(files: DataFrame, level: str, *, content: str = "content", sample: int = SAMPLE_BYTES) -> DataFrame:
    """(relative_path, evidence_level, algorithm, digest, logical_bytes, bytes_read) of files with binary ``content``.

    All hashes are built in; a sampled one is of at most three samples of a file's bytes.
    """
    algorithm, _ = LEVELS[level]
    data = F.col(content)
    if level == "D2":
        size = F.length(data)
        digest = sampled_digest(data, sample)
        read = sum((F.when(at.isNotNull(), F.least(size - at, F.lit(sample))).otherwise(0) for at in _samples(size, sample)), F.lit(0))
    else:
        digest, read = F.sha2(data, 256), F.length(data)
    return files.select("relative_path", F.lit(level).alias("evidence_level"), F.lit(algorithm).alias("algorithm"), digest.alias("digest"), F.length(data).cast("long").alias("logical_bytes"), read.cast("long").alias("bytes_read"))


def _base(spark: SparkSession, folder: str) -> str:
    """The folder's resolved name with a slash, as Spark's readers name it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/") + "/"


def read_selected(files: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(``files`` with ``content``, errors): those whose path, size and time match a file under ``folder`` now, and (relative_path, reason) of the others.

    A reason is MISSING, CHANGED or UNREADABLE. Content goes through a join with all files below the folder; to hash few
    of many, or large ones, use :func:`hash_selected`, whose cases these are too.
    """
    base, done = _base(files.sparkSession, folder), _checked(files, folder, 0)
    found = files.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    content = found.select(F.substring("path", len(base) + 1, 2**31 - 1).alias("relative_path"), "content")
    same = done.where("reason is null").select("relative_path").distinct()
    # Spark's reader leaves out empty files.
    read = files.join(same, "relative_path", "left_semi").join(content, "relative_path", "left").withColumn("content", F.coalesce("content", F.unhex(F.lit(""))))
    return read, done.where("reason is not null").select("relative_path", "reason")


def _file_system(uri: str):
    """(file system, path in it) of a path as the listing names it."""
    if uri.startswith("file:"):
        return LocalFileSystem(), re.sub("^file:(//)?", "", uri)
    return FileSystem.from_uri(quote(uri, safe=":/@"))


def hash_file(fs, name: str, size: int, modified_ns: int | None, sample: int | None) -> tuple[str | None, str | None, int]:
    """(reason, digest, bytes read) of one file: of its samples, of all its bytes if ``sample`` is None, of none if it is 0.

    The file's size and time are taken before and after. Where they are not those of the inventory (times by the
    millisecond), or differ between the two, the reason is CHANGED; MISSING and UNREADABLE are the others. Memory is
    that of one piece of a megabyte, or of one sample.
    """
    try:
        before, read, h = fs.get_file_info(name), 0, hashlib.sha256()
        if before.type == FileType.NotFound:
            return "MISSING", None, 0
        with fs.open_input_file(name) as f:
            if before.size != size or (modified_ns is not None and before.mtime_ns // 1_000_000 != modified_ns // 1_000_000):
                return "CHANGED", None, 0
            if sample is None:
                while piece := f.read(1 << 20):
                    h.update(piece)
                    read += len(piece)
            elif sample:
                middle, end = (size - sample) // 2, size - sample
                starts = [0] + ([middle] if size > sample and middle > 0 else []) + ([end] if size > sample and end > max(middle, 0) else [])
                h.update(_SAMPLE_TAG + size.to_bytes(8, "big"))
                for at in starts:
                    n = min(sample, size - at)
                    piece = f.read_at(n, at)
                    h.update(at.to_bytes(8, "big") + n.to_bytes(8, "big") + piece)
                    read += len(piece)
        after = fs.get_file_info(name)
    except FileNotFoundError:
        return "MISSING", None, 0
    except OSError:
        return "UNREADABLE", None, 0
    if (after.size, after.mtime_ns) != (before.size, before.mtime_ns) or (sample is None and read != size):
        return "CHANGED", None, read
    return None, h.hexdigest(), read


def _hash_files(batches: Iterator[pa.RecordBatch], sample: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch[c].to_pylist() for c in ("uri", "logical_bytes", "modified_ns")), strict=True)
        got = [hash_file(*_file_system(uri), size, time, sample) for uri, size, time in rows]
        columns = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch["relative_path"], batch["logical_bytes"], *columns], names=["relative_path", "logical_bytes", "reason", "digest", "bytes_read"])


def _checked(files: DataFrame, folder: str, sample: int | None) -> DataFrame:
    """(relative_path, logical_bytes, reason, digest, bytes_read) of every file, read in executors and written once. Files are dealt evenly, wherever their rows were."""
    ship(files.sparkSession)
    uri = F.concat(F.lit(_base(files.sparkSession, folder)), paths.normalise("relative_path"))
    todo = files.select("relative_path", F.col("logical_bytes").cast("long").alias("logical_bytes"), F.col("modified_ns").cast("long").alias("modified_ns"), uri.alias("uri")).where("relative_path is not null")
    dealt = todo.repartition(F.xxhash64("uri"))
    return written(dealt.mapInArrow(lambda it: _hash_files(it, sample), "relative_path string, logical_bytes long, reason string, digest string, bytes_read long"))


def hash_selected(files: DataFrame, folder: str, level: str, *, sample: int = SAMPLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(evidence, errors) of ``files`` (relative_path, logical_bytes, modified_ns) that lie under ``folder``.

    Evidence is as :func:`hash_content` gives it, errors are (relative_path, reason). Executors open these files and no
    others, and nothing is listed; at level D2 they read the three samples alone.

    Defined cases: a time that is null is not compared, a null size is CHANGED; a repeated path is hashed each time; a
    null path has no row; a path that leaves the folder raises; links are followed; no files, no rows.
    """
    algorithm, _ = LEVELS[level]
    done = _checked(files, folder, sample if level == "D2" else None)
    evidence = done.where("reason is null").select("relative_path", F.lit(level).alias("evidence_level"), F.lit(algorithm).alias("algorithm"), "digest", "logical_bytes", "bytes_read")
    return evidence, done.where("reason is not null").select("relative_path", "reason")


def group_id(level: Column, algorithm: Column, digest: Column, size: Column) -> Column:
    """SHA-256 of the compact JSON list [level, algorithm, digest, size]."""
    return F.sha2(F.concat(F.lit('["'), level, F.lit('","'), algorithm, F.lit('","'), digest, F.lit('",'), size.cast("string"), F.lit("]")), 256)


def duplicate_groups(evidence: DataFrame) -> DataFrame:
    """(group_id, evidence_level, algorithm, digest, logical_bytes, evidence_status, member_count) of two files or more."""
    keys = ["evidence_level", "algorithm", "digest", "logical_bytes"]
    status = F.create_map(*(F.lit(x) for level, (_, s) in LEVELS.items() for x in (level, s)))
    grouped = evidence.groupBy(*keys).agg(F.count(F.lit(1)).alias("member_count")).where("member_count > 1")
    return grouped.select(group_id(*(F.col(k) for k in keys)).alias("group_id"), *keys, status[F.col("evidence_level")].alias("evidence_status"), "member_count")


def duplicate_members(evidence: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, relative_path)."""
    keys = ["evidence_level", "algorithm", "digest", "logical_bytes"]
    return evidence.join(groups.select("group_id", *keys), keys).select("group_id", "relative_path")


def selected(files: DataFrame, selection: DataFrame) -> DataFrame:
    """The files of a selection; a selected path that is not a regular observed file raises."""
    known = files.select("relative_path", "entry_type", "observation_status", F.lit(True).alias("known"))
    checked = selection.select("relative_path").distinct().join(known, "relative_path", "left")
    good = F.col("known") & (F.col("entry_type") == "FILE") & (F.col("observation_status") == "OBSERVED")
    path = F.when(F.coalesce(good, F.lit(False)), F.col("relative_path")).otherwise(F.raise_error(F.concat(F.lit("not a regular observed file: "), F.col("relative_path"))))
    return files.join(checked.select(path.alias("relative_path")), "relative_path", "left_semi")


def directory_evidence(aggregates: DataFrame, evidence: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """What content evidence says of every directory: selected, candidate and confirmed files and bytes, coverage, confirmed share.

    Files are summed up by parent before they are expanded over ancestors; more evidence than files raises.
    """
    status = members.join(groups.select("group_id", "evidence_status"), "group_id").select("relative_path", "evidence_status")
    marked = evidence.join(status, "relative_path", "left")
    names = ("selected_files", "selected_bytes", "candidate_files", "candidate_bytes", "confirmed_files", "confirmed_bytes")
    is_, size = (lambda s: F.col("evidence_status").eqNullSafe(s)), F.col("logical_bytes")
    sums = [F.count(F.lit(1)), F.sum(size)]
    for s in ("CANDIDATE", "CONFIRMED"):
        sums += [F.count_if(is_(s)), F.coalesce(F.sum(F.when(is_(s), size)), F.lit(0))]
    per_parent = marked.groupBy(F.coalesce(paths.parent("relative_path"), F.lit("")).alias("p")).agg(*(x.alias(n) for x, n in zip(sums, names, strict=True)))
    up = per_parent.select(F.explode(paths.ancestors("p", itself=True)).alias("relative_path"), *names).groupBy("relative_path").agg(*(F.sum(n).alias(n) for n in names))
    rows = aggregates.select("relative_path", F.col("file_count").alias("observed_files"), F.col("recursive_bytes").alias("observed_bytes")).join(up, "relative_path", "left").na.fill(0, list(names))
    over = (F.col("selected_files") > F.col("observed_files")) | (F.col("selected_bytes") > F.col("observed_bytes"))
    coverage = F.when(over, F.raise_error(F.lit("more evidence than files"))).when(F.col("observed_files") == 0, 0.0).otherwise(F.col("selected_files") / F.col("observed_files"))
    return rows.withColumns({"coverage": coverage, "confirmed_ratio": F.when(F.col("selected_files") == 0, 0.0).otherwise(F.col("confirmed_files") / F.col("selected_files"))})


def as_content(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")

