"""Registered queries: catalogue, readers, sidecars, requests, checksums, sinks.

The given documents stand in for files: their paths, sizes and bytes are columns that
Spark derives from the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions.scalars import rounded
from tonelake.plans.inputs import Inputs
from tonelake.plans.registry import query
from tonelake.plans.statements import r, sql
from tonelake.session import spread
from tonelake.sources import captures, sinks

_SUFFIX = (".iq", ".IQ", ".wav", ".Wav", ".cf32", ".dat", ".txt", "")
_SUFFIX_SQL = "[" + ", ".join(f"'{s}'" for s in _SUFFIX) + "]"
_FILES = f"fl AS (SELECT 'captures/' || source || '/' || doc_id || {_SUFFIX_SQL}[(doc_id % 8)::INT+1] AS path, octet_length(encode(text)) AS length, doc_id, text FROM documents)"


def _files(inp: Inputs):
    ends = F.get(F.array(*[F.lit(s) for s in _SUFFIX]), (F.col("doc_id") % 8).cast("int"))
    return spread(inp.table("documents").select("doc_id", "source", "text")).select(
        F.concat(F.lit("captures/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), ends).alias("path"),
        F.octet_length("text").cast("long").alias("length"),
        "doc_id",
        F.encode("text", "UTF-8").alias("content"),
    )


@query("S1_catalogue", f"WITH {_FILES} SELECT path, length FROM fl WHERE doc_id % 8 < 4")
def s1(inp: Inputs):
    return captures.catalogue(_files(inp).select("path", "length"))


@query(
    "S2_size_gate",
    f"WITH {_FILES} SELECT path, CASE WHEN doc_id % 8 = 6 THEN 'Unsupported file type: ''.txt''' WHEN doc_id % 8 = 7 THEN 'Unsupported file type: ''(none)''' WHEN length > 4096 THEN 'File exceeds 4096 bytes' END AS error FROM fl",
)
def s2(inp: Inputs):
    return captures.gated(_files(inp), cap=4096).select("path", "error")


@query(
    "S3_file_kind",
    f"WITH {_FILES} SELECT path, CASE WHEN doc_id % 8 IN (0, 1, 4, 5) THEN 'iq' WHEN doc_id % 8 IN (2, 3) THEN 'wav' END AS kind FROM fl",
)
def s3(inp: Inputs):
    return _files(inp).select("path", captures.file_kind(F.col("path")).alias("kind"))


_READ = [
    "pr AS (SELECT capture_id, k, b, lead(b, 1) OVER o AS b1, lead(b, 2) OVER o AS b2, lead(b, 3) OVER o AS b3, count(*) OVER (PARTITION BY capture_id) AS nb FROM D WINDOW o AS (PARTITION BY capture_id ORDER BY k))",
    """sm AS (SELECT capture_id, k//2 AS n, CASE WHEN capture_id % 4 = 0 THEN (b - CASE WHEN b > 127 THEN 256 ELSE 0 END)/128.0 ELSE (b-128)/128.0 END AS i,
   CASE WHEN capture_id % 4 = 0 THEN (b1 - CASE WHEN b1 > 127 THEN 256 ELSE 0 END)/128.0 ELSE (b1-128)/128.0 END AS q FROM pr WHERE capture_id % 4 < 2 AND k % 2 = 0 AND k+1 < nb
   UNION ALL SELECT capture_id, k//4, (lo - CASE WHEN lo > 32767 THEN 65536 ELSE 0 END)/32768.0, (hi - CASE WHEN hi > 32767 THEN 65536 ELSE 0 END)/32768.0 FROM (
     SELECT capture_id, k, CASE WHEN capture_id % 4 = 2 THEN b+256*b1 ELSE b1+256*b END AS lo, CASE WHEN capture_id % 4 = 2 THEN b2+256*b3 ELSE b3+256*b2 END AS hi FROM pr WHERE capture_id % 4 >= 2 AND k % 4 = 0 AND k+3 < nb))""",
]


@query(
    "S4_raw_reader",
    sql("D", *_READ, f"SELECT capture_id, count(*) AS num_samples, {r('sum(i)', 4, 'sum_i')}, {r('sum(q)', 4, 'sum_q')}, {r('sum(i*(n % 101))', 3, 'mark')} FROM sm GROUP BY 1"),
)
def s4(inp: Inputs):
    cid = F.col("doc_id")
    forms = F.array(*[F.lit(f) for f in ("ci8", "uint8", "int16", "ci16")])
    files = _files(inp).select(
        cid.alias("capture_id"),
        F.lit("iq").alias("kind"),
        captures.canonical_format(F.get(forms, (cid % 4).cast("int"))).alias("iq_format"),
        F.when(cid % 4 == 3, "big").otherwise("little").alias("endian"),
        "content",
    )
    from tonelake.sources.series import to_samples

    samples = to_samples(captures.read_blocks(files, 4096).where(F.col("reason").isNull()))
    return rounded(
        samples.groupBy("capture_id").agg(
            F.count("*").alias("num_samples"), F.sum("i").alias("sum_i"), F.sum("q").alias("sum_q"),
            F.sum(F.col("i") * (F.col("n") % 101)).alias("mark"),
        ),
        4,
        mark=3,
    )


@query(
    "S5_wav_reader",
    sql(
        "D",
        "pr AS (SELECT capture_id, k, b, lead(b, 1) OVER o AS b1, lead(b, 2) OVER o AS b2, lead(b, 3) OVER o AS b3, count(*) OVER (PARTITION BY capture_id) AS nb FROM D WINDOW o AS (PARTITION BY capture_id ORDER BY k))",
        """sm AS (SELECT capture_id, (b+256*b1 - CASE WHEN b1 > 127 THEN 65536 ELSE 0 END)/32768.0 AS i, (b2+256*b3 - CASE WHEN b3 > 127 THEN 65536 ELSE 0 END)/32768.0 AS q FROM pr WHERE capture_id % 2 = 0 AND k % 4 = 0 AND k+3 < nb
   UNION ALL SELECT capture_id, (b+256*b1 - CASE WHEN b1 > 127 THEN 65536 ELSE 0 END)/32768.0, 0.0 FROM pr WHERE capture_id % 2 = 1 AND k % 2 = 0 AND k+1 < nb)""",
        f"SELECT capture_id, count(*) AS num_samples, (8000 + any_value(capture_id % 3)*1000)::DOUBLE AS sample_rate, {r('sum(i)', 4, 'sum_i')}, {r('sum(q)', 4, 'sum_q')} FROM sm GROUP BY 1",
    ),
)
def s5(inp: Inputs):
    cid = F.col("doc_id")

    def le(value, width: int):
        """Little-endian bytes of a non-negative integer column."""
        text = F.lpad(F.hex(value), 2 * width, "0")
        return F.unhex(F.concat(*[F.substring(text, 2 * width - 2 * k - 1, 2) for k in range(width)]))

    size, channels = F.length("content"), F.when(cid % 2 == 0, 2).otherwise(1)
    rate = F.lit(8000) + cid % 3 * 1000
    header = F.concat(
        F.encode(F.lit("RIFF"), "UTF-8"), le(size + 36, 4), F.encode(F.lit("WAVEfmt "), "UTF-8"), le(F.lit(16), 4), le(F.lit(1), 2),
        le(channels, 2), le(rate, 4), le(rate * channels * 2, 4), le(channels * 2, 2), le(F.lit(16), 2),
        F.encode(F.lit("data"), "UTF-8"), le(size, 4),
    )
    files = _files(inp).select(
        cid.alias("capture_id"), F.lit("wav").alias("kind"), F.lit("n/a").alias("iq_format"), F.lit("little").alias("endian"),
        F.concat(header, F.col("content")).alias("content"),
    )
    from tonelake.sources.series import to_samples

    blocks = captures.read_blocks(files, 4096).where(F.col("reason").isNull())
    rates = blocks.groupBy("capture_id").agg(F.max("sample_rate").alias("sample_rate"))
    sums = to_samples(blocks).groupBy("capture_id").agg(
        F.count("*").alias("num_samples"), F.sum("i").alias("sum_i"), F.sum("q").alias("sum_q")
    )
    return rounded(sums.join(rates, "capture_id"), 4)


_SIDECAR_SQL = (
    f"""WITH {_FILES} SELECT path, CASE WHEN doc_id % 3 = 0 THEN (1000 + doc_id)::DOUBLE END AS sidecar_rate, CASE WHEN doc_id % 3 = 0 THEN 'cf32_le' END AS datatype,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN (doc_id * 10)::DOUBLE END AS center_frequency FROM fl WHERE doc_id % 8 < 4"""
)


@query("S6_sidecar_join", _SIDECAR_SQL)
@query("J6_sidecar_left_join", _SIDECAR_SQL)
def s6(inp: Inputs):
    files = _files(inp).where(captures.suffix(F.col("path")).isin(*captures.CATALOGUE_SUFFIXES))
    key = F.col("doc_id").cast("string")
    good = F.concat(
        F.lit('{"global": {"core:sample_rate": '), (F.col("doc_id") + 1000).cast("string"), F.lit(', "core:datatype": "cf32_le"}, "captures": ['),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"core:frequency": '), (F.col("doc_id") * 10).cast("string"), F.lit("}"))).otherwise(F.lit("")),
        F.lit("]}"),
    )
    # Every third capture has a sound sidecar, every third a broken one, the rest none.
    texts = files.where(F.col("doc_id") % 3 < 2).select(
        F.concat(captures.stem(F.col("path")), F.lit(".sigmf-meta")).alias("path"),
        F.when(F.col("doc_id") % 3 == 0, good).otherwise(F.concat(F.lit('{"global": {"core:'), key)).alias("value"),
    )
    return captures.with_sidecars(files.select("path"), captures.parse_sidecars(texts))


@query(
    "J6_manifest_join",
    f"""WITH {_FILES},
mf AS (SELECT parse_filename(path) AS name, (1000 + doc_id)::DOUBLE AS sample_rate, CASE WHEN doc_id % 2 = 0 THEN 'int16' ELSE 'complex64' END AS iq_format FROM fl WHERE doc_id % 3 = 1)
SELECT path, sample_rate AS declared_sample_rate, iq_format AS declared_iq_format, name IS NOT NULL AS in_manifest FROM fl LEFT JOIN mf ON name = parse_filename(path)""",
)
def j6_manifest(inp: Inputs):
    """Every third file stands in the manifest, half of these twice."""
    files = _files(inp).select("path", "doc_id")
    key = F.col("doc_id")
    entry = [
        F.element_at(F.split("path", "/"), -1).alias("name"), (key + 1000).cast("double").alias("sample_rate"),
        F.when(key % 2 == 0, "int16").otherwise("complex64").alias("iq_format"),
    ]
    manifest = files.where(key % 3 == 1).select(*entry, F.lit("0a").alias("sha256"))
    again = files.where(key % 6 == 1).select(*entry[:2], F.lit("uint8").alias("iq_format"), F.lit("0b").alias("sha256"))
    joined = captures.with_manifest(files.select("path"), manifest.unionByName(again))
    return joined.drop("declared_sha256")


def _format_sql() -> str:
    byte_value = "(b - CASE WHEN b > 127 THEN 256 ELSE 0 END)"
    return sql(
        "D",
        "pr AS (SELECT capture_id, k, b, lead(b, 1) OVER o AS b1, lead(b, 2) OVER o AS b2, lead(b, 3) OVER o AS b3, count(*) OVER (PARTITION BY capture_id) AS nb FROM D WINDOW o AS (PARTITION BY capture_id ORDER BY k))",
        f"""rd AS (SELECT capture_id, 'int16' AS form, k//4 AS n, (b+256*b1 - CASE WHEN b1 > 127 THEN 65536 ELSE 0 END)/32768.0 AS i, (b2+256*b3 - CASE WHEN b3 > 127 THEN 65536 ELSE 0 END)/32768.0 AS q FROM pr WHERE k % 4 = 0 AND k+3 < nb
   UNION ALL SELECT capture_id, 'int8', k//2, {byte_value}/128.0, {byte_value.replace('b ', 'b1 ')}/128.0 FROM pr WHERE k % 2 = 0 AND k+1 < nb
   UNION ALL SELECT capture_id, 'uint8', k//2, (b-128)/128.0, (b1-128)/128.0 FROM pr WHERE k % 2 = 0 AND k+1 < nb)""",
        "lg AS (SELECT *, lag(i) OVER (PARTITION BY capture_id, form ORDER BY n) AS i0 FROM rd)",
        """mo AS (SELECT capture_id, form, count(*) AS num, avg(i) AS mi, avg(q) AS mq, stddev_pop(i) AS si, stddev_pop(q) AS sq, covar_pop(i, q) AS cv, avg(i*i0) AS lag, avg(i*i) AS pw, greatest(max(i)-min(i), max(q)-min(q)) AS span FROM lg GROUP BY 1, 2)""",
        "sc AS (SELECT *, greatest(si, sq) AS top, greatest(abs(mi), abs(mq))/greatest(si, sq) AS dc FROM mo)",
        """ss AS (SELECT capture_id, form, CASE WHEN num < 16 OR top <= 1e-12 OR dc > 1.5 OR least(si, sq)/top < 0.05 THEN 0 ELSE
   greatest(0, least(1, abs(lag/pw)*(1-least(abs(cv/(si*sq)), 1))*(0.9+0.1*least(1, span/CASE form WHEN 'int16' THEN 65535.0 ELSE 255.0 END))*greatest(0, 1-0.5*dc))) END AS score FROM sc)""",
        # Little-endian single-precision value: sign, exponent and fraction of four bytes.
        """fv AS (SELECT capture_id, k//4 AS w, CASE WHEN e = 255 THEN NULL WHEN e = 0 THEN m*power(2.0, -149) ELSE (1+m/8388608.0)*power(2.0, e-127) END AS v, e = 255 AS bad FROM (
     SELECT capture_id, k, ((b3::BIGINT & 127) << 1) + (b2::BIGINT >> 7) AS e, ((b2::BIGINT & 127) << 16) + (b1::BIGINT << 8) + b::BIGINT AS m FROM pr WHERE k % 4 = 0 AND k//8*8+7 < nb))""",
        "fz AS (SELECT capture_id, w//2 AS n, bool_or(bad) AS bad, sqrt(sum(v*v)) AS mag FROM fv GROUP BY 1, 2)",
        "fs AS (SELECT capture_id, CASE WHEN count(*) < 16 OR avg((NOT bad)::INT) < 0.99 OR max(mag) FILTER (NOT bad) < 1e-6 OR max(mag) FILTER (NOT bad) > 1e15 OR avg((mag < 1e-30)::INT) FILTER (NOT bad) > 0.5 THEN 0 ELSE 1 END AS score FROM fz GROUP BY 1)",
        "al AS (SELECT doc_id AS capture_id, coalesce(fs.score, 0)::DOUBLE AS c, coalesce(a.score, 0) AS i16, coalesce(b.score, 0) AS i8, coalesce(d.score, 0) AS u8 FROM documents LEFT JOIN fs ON fs.capture_id = doc_id LEFT JOIN ss a ON a.capture_id = doc_id AND a.form = 'int16' LEFT JOIN ss b ON b.capture_id = doc_id AND b.form = 'int8' LEFT JOIN ss d ON d.capture_id = doc_id AND d.form = 'uint8')",
        "bs AS (SELECT *, greatest(c, i16, i8, u8) AS s1, list_reverse_sort([c, i16, i8, u8])[2] AS s2 FROM al)",
        f"""SELECT capture_id, CASE WHEN c = s1 THEN 'complex64' WHEN i16 = s1 THEN 'int16' WHEN i8 = s1 THEN 'int8' ELSE 'uint8' END AS format, {r('c', 4, 'score_complex64')}, {r('i16', 4, 'score_int16')}, {r('i8', 4, 'score_int8')}, {r('u8', 4, 'score_uint8')},
   {r('CASE WHEN s1 <= 0 THEN 0 WHEN s1 >= 1 THEN 1 ELSE least(0.99, greatest(0.5, 0.5+s1-s2)) END', 4, 'confidence')} FROM bs""",
    )


@query("S7_format_inference", _format_sql())
def s7(inp: Inputs):
    return rounded(captures.infer_format(_files(inp).select(F.col("doc_id").alias("capture_id"), "content")), 4)


@query(
    "S8_working_rate",
    """WITH q AS (SELECT o_orderkey AS capture_id, CASE WHEN o_orderkey % 7 = 0 THEN 'wav' ELSE 'iq' END AS kind, CASE WHEN o_orderkey % 7 = 0 THEN 48000.0 END AS header_rate, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS requested,
  CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice*2 WHEN o_orderkey % 5 = 1 THEN -1 END AS sidecar, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice/2 END AS hyp, (o_orderkey % 10)/10.0 AS conf FROM orders),
s AS (SELECT *, CASE WHEN kind = 'wav' THEN 'wav-header' WHEN requested > 0 THEN 'explicit' WHEN sidecar > 0 THEN 'sigmf' ELSE 'hypothesis' END AS src FROM q)
SELECT capture_id, CASE src WHEN 'wav-header' THEN header_rate WHEN 'explicit' THEN requested WHEN 'sigmf' THEN sidecar ELSE coalesce(hyp, 100000.0) END::DOUBLE AS sample_rate, src AS rate_source, src = 'hypothesis' AS rate_assumed,
  concat_ws('; ', CASE WHEN conf < 0.6 THEN 'IQ format auto-detection was inconclusive' END, CASE WHEN src = 'hypothesis' THEN 'sample_rate was not supplied; assumed' END) AS warnings FROM s""",
)
def s8(inp: Inputs):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    rows = inp.table("orders").select(
        key.alias("capture_id"),
        F.when(key % 7 == 0, "wav").otherwise("iq").alias("kind"),
        F.when(key % 7 == 0, 48000.0).alias("header_rate"),
        F.when(key % 3 == 0, price).alias("requested_rate"),
        F.when(key % 5 == 0, price * 2).when(key % 5 == 1, -1.0).alias("sidecar_rate"),
        F.when(key % 4 == 0, price / 2).alias("hypothesis_rate"),
        ((key % 10) / 10.0).alias("format_confidence"),
    )
    return captures.resolve_rate(rows).select(
        "capture_id", "sample_rate", "rate_source", "rate_assumed", F.array_join("warnings", "; ").alias("warnings")
    )


_REQ = {
    "iq_format": ("auto", "CF32", " int16 ", "float", ""),
    "modulation": ("auto", "QPSK", "ofdm", "16-qam", "", "8PSK"),
    "sync_word": ("0x1ACFFC1D", "", "xyz", "7e7e", "0x", "0x1G"),
    "sample_rate": ("100000", "0", "-5", "abc", "2e9", "", "NaN"),
    "frame_bits": ("100", "0", "-3", "70000", "x", "inf"),
    "decode_max_bits": ("", "20000", "2000000"),
    "decode_time_budget_s": ("5.5", "900", "", "-1"),
}


@query(
    "S9_request_validation",
    f"""WITH q AS (SELECT o_orderkey AS capture_id, {', '.join(f"[{', '.join(repr(v) for v in vals)}][(o_orderkey % {len(vals)})::INT+1] AS {c}" for c, vals in _REQ.items())} FROM orders)
SELECT capture_id, CASE iq_format WHEN '' THEN 'auto' ELSE trim(iq_format) END AS iq_format, CASE modulation WHEN '' THEN 'auto' ELSE modulation END AS modulation, nullif(sync_word, '') AS sync_word,
  CASE sample_rate WHEN '100000' THEN 100000.0 WHEN '0' THEN 0.0 WHEN '-5' THEN -5.0 WHEN '2e9' THEN 2e9 END::DOUBLE AS sample_rate, CASE frame_bits WHEN '100' THEN 100.0 WHEN '70000' THEN 70000.0 END::DOUBLE AS frame_bits,
  CASE decode_max_bits WHEN '20000' THEN 20000.0 WHEN '2000000' THEN 2000000.0 END::DOUBLE AS decode_max_bits, CASE decode_time_budget_s WHEN '5.5' THEN 5.5 WHEN '900' THEN 900.0 END::DOUBLE AS decode_time_budget_s,
  concat_ws(';', CASE WHEN iq_format = 'float' THEN 'invalid ''iq_format''' END, CASE WHEN modulation = 'ofdm' THEN 'invalid ''modulation''' END, CASE WHEN sync_word IN ('xyz', '0x', '0x1G') THEN 'invalid ''sync_word''' END,
    CASE WHEN sample_rate IN ('0', '-5', 'abc', '2e9', 'NaN') THEN 'invalid ''sample_rate''' END, CASE WHEN frame_bits IN ('70000', 'x', 'inf') THEN 'invalid ''frame_bits''' END,
    CASE WHEN decode_max_bits = '2000000' THEN 'invalid ''decode_max_bits''' END, CASE WHEN decode_time_budget_s = '900' THEN 'invalid ''decode_time_budget_s''' END) AS problems FROM q""",
)
def s9(inp: Inputs):
    picks = [
        F.get(F.array(*[F.lit(v) for v in vals]), (F.col("o_orderkey") % len(vals)).cast("int")).alias(c) for c, vals in _REQ.items()
    ]
    checked = captures.validate_requests(inp.table("orders").select(F.col("o_orderkey").alias("capture_id"), *picks))
    return checked.withColumn("problems", F.array_join("problems", ";"))


@query(
    "S10_checksum_manifest",
    """SELECT doc_id::VARCHAR AS name, CASE WHEN doc_id % 4 = 1 THEN repeat('0', 64) ELSE sha256(text) END AS sha256, CASE WHEN doc_id % 4 <> 2 THEN octet_length(encode(text)) END::INT AS size_bytes,
  CASE doc_id % 4 WHEN 1 THEN 'mismatch' WHEN 2 THEN 'missing' ELSE 'ok' END AS status FROM documents""",
)
def s10(inp: Inputs):
    files = _files(inp).select(F.col("doc_id").cast("string").alias("name"), "content", "doc_id")
    manifest = files.select(
        "name", F.when(F.col("doc_id") % 4 == 1, F.repeat(F.lit("0"), 64)).otherwise(F.sha2("content", 256)).alias("sha256")
    )
    return captures.verify_manifest(files.where(F.col("doc_id") % 4 != 2), manifest)


@query(
    "S12_safe_cells",
    r"""WITH c AS (SELECT doc_id, [text, '=' || text, '  +1', '-2', '@x', chr(9) || '|y', '%z', 'plain', text || '='][(doc_id % 9)::INT+1] AS cell FROM documents)
SELECT doc_id, md5(CASE WHEN regexp_matches(cell, '^\s*[=+\-@|%]') THEN '''' || cell ELSE cell END) AS cell_md5, regexp_matches(cell, '^\s*[=+\-@|%]') AS quoted FROM c""",
)
def s12(inp: Inputs):
    text = F.col("text")
    cells = F.array(
        text, F.concat(F.lit("="), text), F.lit("  +1"), F.lit("-2"), F.lit("@x"), F.lit("\t|y"), F.lit("%z"), F.lit("plain"), F.concat(text, F.lit("="))
    )
    rows = inp.table("documents").select("doc_id", F.get(cells, (F.col("doc_id") % 9).cast("int")).alias("cell"))
    safe = sinks.safe_cell(F.col("cell"))
    return rows.select("doc_id", F.md5(F.encode(safe, "UTF-8")).alias("cell_md5"), (safe != F.col("cell")).alias("quoted"))


@query(
    "S13_bit_streams",
    sql(
        "E",
        "bt AS (SELECT capture_id, n AS pos, (i > 0)::INT AS bit FROM E)",
        "oc AS (SELECT capture_id, pos//8 AS k, sum(bit << (7-pos%8)::INT)::INT AS b FROM bt GROUP BY 1, 2)",
        "SELECT capture_id, (SELECT string_agg(bit::VARCHAR, '' ORDER BY pos) FROM bt WHERE bt.capture_id = oc.capture_id) AS text, string_agg(printf('%02X', b), '' ORDER BY k) AS packed FROM oc GROUP BY capture_id",
    ),
)
def s13(inp: Inputs):
    bits = inp.vector_samples().select("capture_id", F.col("n").alias("pos"), (F.col("i") > 0).cast("int").alias("bit"))
    packed = sinks.packed_streams(bits).select("capture_id", F.hex("data").alias("packed"))
    return sinks.text_streams(bits).join(packed, "capture_id")


