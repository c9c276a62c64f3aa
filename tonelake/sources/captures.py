"""Capture files: catalogue, size rule, readers, sidecars, checksums, format inference.

The catalogue never reads file contents; the readers do, one task per file, and hand on
bounded block rows. A bad file becomes a row with a reason, never a failed job.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tonelake.session import TEXT_ROWS, arrow_rows, pin
from tonelake.sources.series import DEFAULT_BLOCK

# Fixed values of the formats and rules.
CATALOGUE_SUFFIXES = ("iq", "wav")
RAW_SUFFIXES = ("iq", "cf32", "ci16", "raw", "dat", "sigmf-data")
MAX_BYTES = 100 * 1024 * 1024
FORMAT_ALIASES = {"cf32": "complex64", "ci16": "int16", "cu8": "uint8", "ci8": "int8"}
FORMATS = ("complex64", "int16", "int8", "uint8")
DEFAULT_RATE = 100_000.0
MAX_RATE = 1e9
MAX_SYNC_DIGITS = 256
MAX_FRAME_BITS = 65_536
MAX_SEARCH_BITS = 1_000_000
MAX_SEARCH_SECONDS = 600.0
ALLOWED_FORMATS = ("auto", "complex64", "int16", "uint8", "int8", "cf32", "ci16", "cu8", "ci8")
ALLOWED_MODULATIONS = (
    "auto", "bpsk", "qpsk", "2-fsk", "2fsk", "fsk", "4-fsk", "4fsk", "8psk", "8-psk", "16-qam", "qam16", "qam",
    "64-qam", "qam64", "64qam",
)


# -- catalogue ----------------------------------------------------------------


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, length) of all files below a folder, without their contents."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(folder).select("path", "length")


def suffix(path: Column) -> Column:
    """Lower-case suffix of the file name, empty without one."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def catalogue(files: DataFrame) -> DataFrame:
    """Files the batch job accepts, in path order."""
    return files.where(suffix(F.col("path")).isin(*CATALOGUE_SUFFIXES)).orderBy("path")


def file_kind(path: Column) -> Column:
    """'iq', 'wav', or NULL for an unsupported suffix."""
    s = suffix(path)
    return F.when(s.isin(*RAW_SUFFIXES), F.lit("iq")).when(s == "wav", F.lit("wav"))


def gated(files: DataFrame, cap: int | None = MAX_BYTES) -> DataFrame:
    """Adds ``kind`` and the ``error`` that keeps a file from being loaded (NULL = load it)."""
    kind = file_kind(F.col("path"))
    bad_type = F.concat(
        F.lit("Unsupported file type: '"),
        F.when(suffix(F.col("path")) == "", F.lit("(none)")).otherwise(F.concat(F.lit("."), suffix(F.col("path")))),
        F.lit("'"),
    )
    error = F.when(kind.isNull(), bad_type)
    if cap is not None:
        error = error.when(F.col("length") > cap, F.concat(F.lit("File exceeds "), F.lit(str(cap)), F.lit(" bytes")))
    return files.withColumn("kind", kind).withColumn("error", error)


# -- readers ------------------------------------------------------------------


def canonical_format(name: Column) -> Column:
    pairs = [F.lit(v) for item in FORMAT_ALIASES.items() for v in item]
    low = F.lower(name)
    return F.coalesce(F.element_at(F.create_map(*pairs), low), low)


#: Samples of the blocks that leave a reader together.
TOGETHER = 1 << 17


def _decode_raw(buf: bytes, form: str, endian: str) -> np.ndarray:
    order = ">" if endian == "big" else "<"
    kinds = {"complex64": ("<f4", 0.0, 1.0), "int16": (order + "i2", 0.0, 32768.0), "int8": ("i1", 0.0, 128.0), "uint8": ("u1", 128.0, 128.0)}
    if form not in kinds:
        raise ValueError(f"unsupported sample format {form}")
    code, shift, scale = kinds[form]
    pair = 2 * np.dtype(code).itemsize
    flat = np.frombuffer(buf[: len(buf) // pair * pair], dtype=code)
    return ((flat.astype(np.float32) - np.float32(shift)) / np.float32(scale)).reshape(-1, 2)


def _decode_wav(buf: bytes) -> tuple[np.ndarray, float]:
    """Walk the RIFF chunks; integer PCM and IEEE float, the first two channels."""
    if buf[:4] != b"RIFF" or buf[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form, data = 12, None, None
    while at + 8 <= len(buf):
        name, size = buf[at : at + 4], struct.unpack("<I", buf[at + 4 : at + 8])[0]
        body = buf[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", body[:16])
            if form[0] == 0xFFFE and len(body) >= 26:
                form = (struct.unpack("<H", body[24:26])[0], *form[1:])
        elif name == b"data":
            data = body
        at += 8 + size + (size & 1)
    if form is None or data is None:
        raise ValueError("WAV file lacks a format or data chunk")
    tag, channels, rate, _, _, bits = form
    width = bits // 8
    data = data[: len(data) // (width * channels) * (width * channels)]
    if tag == 3 and bits in (32, 64):
        flat = np.frombuffer(data, dtype=f"<f{width}").astype(np.float32)
    elif tag == 1 and bits == 8:
        flat = (np.frombuffer(data, dtype="u1").astype(np.float32) - 128.0) / 128.0
    elif tag == 1 and bits in (16, 32):
        flat = (np.frombuffer(data, dtype=f"<i{width}") / float(1 << (bits - 1))).astype(np.float32)
    elif tag == 1 and bits == 24:
        octets = np.frombuffer(data, dtype="u1").reshape(-1, 3).astype(np.int32)
        value = octets[:, 0] | octets[:, 1] << 8 | octets[:, 2] << 16
        flat = (((value ^ 0x800000) - 0x800000) / float(1 << 23)).astype(np.float32)
    else:
        raise ValueError(f"unsupported WAV encoding {tag} with {bits} bits")
    table = flat.reshape(-1, channels)
    if channels == 1:
        table = np.column_stack([table[:, 0], np.zeros(len(table), dtype=np.float32)])
    return table[:, :2], float(rate)


def read_blocks(files: DataFrame, block_len: int = DEFAULT_BLOCK) -> DataFrame:
    """Decode capture files into block rows.

    ``files``: (capture_id, kind, iq_format, endian, content). Every file gives at least
    one row; ``reason`` tells why a file could not be decoded, ``sample_rate`` is set
    from WAV headers. No row exceeds ``block_len``; blocks leave the task some at a time.
    """
    id_type = files.schema["capture_id"].dataType.simpleString()
    shape = (
        f"capture_id {id_type}, block_no long, start_n long, i array<double>, q array<double>, "
        "sample_rate double, reason string"
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type, rows, held = batch.schema.field("capture_id").type, [], 0

            def sent() -> pa.RecordBatch:
                ids, numbers, starts, parts, rates, reasons = zip(*rows, strict=True)
                table = np.concatenate(parts).astype(np.float64)
                offsets = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
                i, q = (pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(table[:, k]))) for k in (0, 1))
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, id_type), pa.array(numbers, pa.int64()), pa.array(starts, pa.int64()), i, q,
                        pa.array(rates, pa.float64()), pa.array(reasons, pa.string()),
                    ],
                    ["capture_id", "block_no", "start_n", "i", "q", "sample_rate", "reason"],
                )

            for k in range(batch.num_rows):
                capture_id, kind, form, endian, content = (batch.column(c)[k].as_py() for c in range(5))
                rate, reason = None, None
                samples = np.zeros((0, 2), dtype=np.float32)
                try:
                    if kind == "wav":
                        samples, rate = _decode_wav(content)
                    else:
                        samples = _decode_raw(content, form, endian)
                    if not len(samples):
                        reason = "no samples"
                except (ValueError, struct.error) as exc:
                    reason = str(exc)
                for no in range(max(1, -(-len(samples) // block_len))):
                    part = samples[no * block_len : (no + 1) * block_len]
                    rows.append((capture_id, no, no * block_len, part, rate, reason))
                    held += len(part)
                    if held >= TOGETHER:
                        yield sent()
                        rows, held = [], 0
            if rows:
                yield sent()

    return files.select("capture_id", "kind", "iq_format", "endian", "content").mapInArrow(decode, shape)


def load(
    spark: SparkSession, folder: str, iq_format: str = "complex64", recursive: bool = False, cap: int | None = None
) -> DataFrame:
    """Blocks of all accepted files of a folder; rejected files come back as reason rows.

    ``cap`` rejects files of more bytes; without it, size is no reason.
    """
    source = spark.read.format("binaryFile")
    if recursive:
        source = source.option("recursiveFileLookup", "true")
    files = gated(source.load(folder).where(suffix(F.col("path")).isin(*CATALOGUE_SUFFIXES)), cap)
    good = files.where(F.col("error").isNull()).select(
        F.col("path").alias("capture_id"), "kind", canonical_format(F.lit(iq_format)).alias("iq_format"), F.lit("little").alias("endian"), "content"
    )
    bad = files.where(F.col("error").isNotNull()).select(F.col("path").alias("capture_id"), F.col("error").alias("reason"))
    return read_blocks(good).unionByName(bad, allowMissingColumns=True)


# -- sidecars and rates -------------------------------------------------------

SIDECAR_SCHEMA = (
    "`global` struct<`core:sample_rate`: double, `core:datatype`: string>, captures array<struct<`core:frequency`: double>>"
)


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def parse_sidecars(texts: DataFrame) -> DataFrame:
    """(path, value) sidecar texts to (stem, sample_rate, datatype, center_frequency).

    A malformed text gives no row values, only NULLs.
    """
    doc = F.from_json("value", SIDECAR_SCHEMA)
    return texts.select(stem(F.col("path")).alias("stem"), doc.alias("d")).select(
        "stem",
        F.col("d.global")["core:sample_rate"].alias("sidecar_rate"),
        F.col("d.global")["core:datatype"].alias("datatype"),
        F.get("d.captures", F.lit(0))["core:frequency"].alias("center_frequency"),
    )


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    texts = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.sigmf-meta").text(folder)
    return parse_sidecars(texts.select(F.col("_metadata.file_path").alias("path"), "value"))


def with_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Left join on the file stem; files without a sidecar keep NULLs."""
    return files.withColumn("stem", stem(F.col("path"))).join(sidecars, "stem", "left").drop("stem")


def resolve_rate(rows: DataFrame) -> DataFrame:
    """Working sample rate with its source.

    ``rows``: (kind, header_rate, requested_rate, sidecar_rate, hypothesis_rate,
    format_confidence), NULL where absent.
    """

    def usable(c: str) -> Column:
        return F.when((F.col(c) > 0) & (F.col(c) < float("inf")), F.col(c))

    source = (
        F.when(F.col("kind") == "wav", F.lit("wav-header"))
        .when(usable("requested_rate").isNotNull(), F.lit("explicit"))
        .when(usable("sidecar_rate").isNotNull(), F.lit("sigmf"))
        .otherwise(F.lit("hypothesis"))
    )
    rate = F.when(F.col("kind") == "wav", F.col("header_rate")).otherwise(
        F.coalesce(usable("requested_rate"), usable("sidecar_rate"), usable("hypothesis_rate"), F.lit(DEFAULT_RATE))
    )
    assumed = source == "hypothesis"
    return rows.withColumn("sample_rate", rate).withColumn("rate_source", source).withColumn("rate_assumed", assumed).withColumn(
        "warnings",
        F.array_compact(
            F.array(
                F.when(F.col("format_confidence") < 0.6, F.lit("IQ format auto-detection was inconclusive")),
                F.when(assumed, F.lit("sample_rate was not supplied; assumed")),
            )
        ),
    )


# -- requests -----------------------------------------------------------------


def validate_requests(requests: DataFrame) -> DataFrame:
    """Check request rows of raw strings; adds clean values and the list of ``problems``.

    Limits at or below zero mean "no limit" and become NULL.
    """

    def text(c: str) -> Column:
        return F.when(F.trim(F.col(c)) == "", F.lit(None)).otherwise(F.trim(F.col(c)))

    def number(c: str) -> Column:
        # Decimal texts only: hex, suffixes and the NaN / infinity words are no numbers here.
        ok = text(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
        return F.when(ok, F.expr(f"try_cast(trim({c}) AS DOUBLE)"))

    form = F.coalesce(text("iq_format"), F.lit("auto"))
    mod = F.coalesce(text("modulation"), F.lit("auto"))
    word = text("sync_word")
    digits = F.regexp_replace(F.lower(word), "^0x", "")
    word_ok = word.isNull() | (digits.rlike("^[0-9a-f]+$") & (F.length(digits) <= MAX_SYNC_DIGITS))
    rate = number("sample_rate")
    rate_ok = text("sample_rate").isNull() | F.coalesce((rate > 0) & (rate <= MAX_RATE), F.lit(False))

    def limit_ok(c: str, cap: float) -> Column:
        return text(c).isNull() | F.coalesce(number(c) <= cap, F.lit(False))

    limits = {"frame_bits": MAX_FRAME_BITS, "decode_max_bits": MAX_SEARCH_BITS, "decode_time_budget_s": MAX_SEARCH_SECONDS}
    checks = [
        ("iq_format", F.lower(form).isin(*ALLOWED_FORMATS)),
        ("modulation", F.lower(mod).isin(*ALLOWED_MODULATIONS)),
        ("sync_word", word_ok),
        ("sample_rate", rate_ok),
        *[(c, limit_ok(c, cap)) for c, cap in limits.items()],
    ]
    problems = F.array_compact(F.array(*[F.when(~ok, F.lit(f"invalid '{name}'")) for name, ok in checks]))
    return requests.select(
        "capture_id",
        form.alias("iq_format"),
        mod.alias("modulation"),
        word.alias("sync_word"),
        rate.alias("sample_rate"),
        *[F.when(number(c) > 0, number(c)).alias(c) for c in limits],
        problems.alias("problems"),
    )


# -- checksums ----------------------------------------------------------------


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status of every manifest entry: ok, mismatch or missing."""
    actual = files.select("name", F.sha2("content", 256).alias("actual"), F.length("content").alias("size_bytes"))
    return manifest.join(actual, "name", "left").select(
        "name",
        "sha256",
        "size_bytes",
        F.when(F.col("actual").isNull(), F.lit("missing"))
        .when(F.col("actual") == F.lower("sha256"), F.lit("ok"))
        .otherwise(F.lit("mismatch"))
        .alias("status"),
    )


def with_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Left join of files ``(path, ...)`` with what the download manifest says of their name.

    ``manifest(name, ...)``; its other columns come with the prefix ``declared_``. Files that the
    manifest does not name keep NULLs; of several entries with one name the first by its
    checksum counts, so a file stays one row.
    """
    said = [c for c in manifest.columns if c != "name"]
    one = manifest.groupBy("name").agg(F.min_by(F.struct(*said), F.coalesce(F.col("sha256"), F.lit(""))).alias("said"))
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return named.join(one, "name", "left").select(
        *files.columns, *[F.col(f"said.{c}").alias(f"declared_{c}") for c in said], F.col("said").isNotNull().alias("in_manifest")
    )


# -- format inference ---------------------------------------------------------

_MOMENTS = T.StructType(
    [
        T.StructField(n, T.DoubleType())
        for n in ("num", "mean_i", "mean_q", "std_i", "std_q", "corr", "lag", "power", "span", "finite", "peak", "tiny")
    ]
)


@pandas_udf(T.ArrayType(_MOMENTS))
def _reading_moments(content: pd.Series) -> pd.Series:
    """Moments of the bytes under each reading, in the order of FORMATS."""
    out = []
    for buf in content:
        rows = []
        for form in FORMATS:
            with np.errstate(all="ignore"):
                if form == "complex64":
                    z = np.frombuffer(buf[: len(buf) // 8 * 8], dtype="<f4").astype(np.float64).reshape(-1, 2)
                    mag = np.hypot(z[:, 0], z[:, 1])
                    ok = np.isfinite(mag)
                    kept = mag[ok]
                    rows.append(
                        {
                            "num": float(len(z)),
                            "finite": float(ok.mean()) if len(z) else 0.0,
                            "peak": float(kept.max()) if kept.size else 0.0,
                            "tiny": float((kept < 1e-30).mean()) if kept.size else 1.0,
                        }
                    )
                    continue
                table = _decode_raw(buf, form, "little").astype(np.float64)
                a, b = table[:, 0], table[:, 1]
                row = {"num": float(len(table))}
                if len(table) >= 16:
                    sa, sb = float(a.std()), float(b.std())
                    cov = float(np.mean((a - a.mean()) * (b - b.mean())))
                    row.update(
                        mean_i=float(a.mean()), mean_q=float(b.mean()), std_i=sa, std_q=sb,
                        corr=cov / (sa * sb) if sa > 0 and sb > 0 else None,
                        lag=float(np.mean(a[1:] * a[:-1])), power=float(np.mean(a * a)),
                        span=float(max(np.ptp(a), np.ptp(b))),
                    )
                rows.append(row)
        out.append(rows)
    return pd.Series(out)


def infer_format(files: DataFrame, preview: int | None = None) -> DataFrame:
    """Score the four readings of every file; the best one and its margin.

    ``preview`` reads only so many bytes of each file.
    """
    content = F.col("content") if preview is None else F.substring("content", 1, preview)
    with arrow_rows(files.sparkSession, TEXT_ROWS):  # stored at once, so that few files are in a batch
        moments = pin(files.select("capture_id", _reading_moments(content).alias("all")))
    moments = moments.select("capture_id", F.posexplode("all").alias("turn", "m"))
    num = F.col("m.num")
    floats = F.when(
        (num >= 16) & (F.col("m.finite") >= 0.99) & (F.col("m.peak") >= 1e-6) & (F.col("m.peak") <= 1e15) & (F.col("m.tiny") <= 0.5),
        F.lit(1.0),
    ).otherwise(F.lit(0.0))
    top = F.greatest("m.std_i", "m.std_q")
    dc = F.greatest(F.abs("m.mean_i"), F.abs("m.mean_q")) / top
    full = F.when(F.col("turn") == 1, F.lit(65535.0)).otherwise(F.lit(255.0))
    smooth = F.when(F.col("m.power") > 0, F.abs(F.col("m.lag") / F.col("m.power"))).otherwise(F.lit(0.0))
    raw = (
        smooth
        * (1.0 - F.least(F.abs(F.coalesce("m.corr", F.lit(1.0))), F.lit(1.0)))
        * (0.9 + 0.1 * F.least(F.lit(1.0), F.col("m.span") / full))
        * F.greatest(F.lit(0.0), 1.0 - 0.5 * dc)
    )
    ok = (num >= 16) & (top > 1e-12) & (dc <= 1.5) & (F.least("m.std_i", "m.std_q") / top >= 0.05)
    whole = F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(F.lit(0.0))
    names = F.array(*[F.lit(f) for f in FORMATS])
    scored = moments.select(
        "capture_id", "turn", F.get(names, F.col("turn")).alias("format"), F.when(F.col("turn") == 0, floats).otherwise(whole).alias("score")
    )
    order = Window.partitionBy("capture_id").orderBy(F.col("score").desc(), "turn")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    best = ranked.groupBy("capture_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("format"))).alias("format"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"),
        *[F.max(F.when(F.col("format") == f, F.round("score", 4))).alias(f"score_{f}") for f in FORMATS],
    )
    confidence = (
        F.when(F.col("s1") <= 0, F.lit(0.0))
        .when(F.col("s1") >= 1, F.lit(1.0))
        .otherwise(F.least(F.lit(0.99), F.greatest(F.lit(0.5), 0.5 + F.col("s1") - F.col("s2"))))
    )
    return best.withColumn("confidence", F.round(confidence, 4)).drop("s1", "s2")
