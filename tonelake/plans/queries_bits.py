"""Registered queries: bits, bytes, payloads, framed search and code screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions import bits as B
from tonelake.functions.scalars import rounded
from tonelake.operators import frames, interleave, payload
from tonelake.plans.inputs import Inputs
from tonelake.plans.registry import query
from tonelake.plans.statements import r, sql


@query(
    "P7_hex_to_bits",
    """WITH h AS (SELECT o_orderkey AS capture_id, hex(o_orderkey) AS x FROM orders),
c AS (SELECT capture_id, unnest(string_split(x, '')) AS d, generate_subscripts(string_split(x, ''), 1) - 1 AS k FROM h)
SELECT capture_id, (4*k+j)::BIGINT AS pos, (((instr('0123456789ABCDEF', d)-1) >> (3-j)) & 1)::INT AS bit FROM c, range(4) t(j)""",
)
def p7(inp: Inputs):
    words = inp.table("orders").select(
        F.col("o_orderkey").alias("capture_id"), F.concat(F.lit("0x"), F.lower(F.hex("o_orderkey"))).alias("word")
    )
    return words.select("capture_id", F.posexplode(B.hex_bits(F.col("word"))).alias("pos", "bit")).select(
        "capture_id", F.col("pos").cast("long").alias("pos"), "bit"
    )


@query(
    "P8_gray_code",
    """WITH RECURSIVE g AS (SELECT o_orderkey AS key, xor(o_orderkey, o_orderkey >> 1) AS gray FROM orders)
SELECT key, gray, list_reduce(list_transform(range(40), lambda s: (key >> s)), lambda a, b: xor(a, b)) AS decoded_key,
  list_reduce(list_transform(range(40), lambda s: (gray >> s)), lambda a, b: xor(a, b)) AS back FROM g""",
)
def p8(inp: Inputs):
    return inp.table("orders").select(
        F.col("o_orderkey").alias("key"),
        B.to_gray(F.col("o_orderkey")).alias("gray"),
        B.from_gray(F.col("o_orderkey")).alias("decoded_key"),
        B.from_gray(B.to_gray(F.col("o_orderkey"))).alias("back"),
    )


@query(
    "P9_bits_to_bytes",
    sql("E10", "bt AS (SELECT capture_id, n AS pos, (i > 0)::INT AS bit FROM E10)",
        "SELECT capture_id, (pos // 8)::BIGINT AS k, sum(bit << (7 - pos % 8)::INT)::INT AS byte FROM bt GROUP BY 1, 2"),
)
def p9(inp: Inputs):
    bits = inp.label_samples().select("capture_id", F.col("n").alias("pos"), (F.col("i") > 0).cast("int").alias("bit"))
    return B.bits_to_bytes(bits)


@query(
    "P9_bytes_to_bits",
    sql("D", """SELECT capture_id, count(*)*8 AS n_bits, sum(bit_count(b::INT))::BIGINT AS ones,
  sum(list_reduce(list_transform(range(8), lambda j: ((b::BIGINT >> (7-j)) & 1) * ((8*k+j) % 1009)), lambda x, y: x + y))::BIGINT AS mark FROM D GROUP BY 1"""),
)
def p9_bits(inp: Inputs):
    return B.bytes_to_bits(B.byte_rows(inp.payloads())).groupBy("capture_id").agg(
        F.count("*").alias("n_bits"),
        F.sum("bit").alias("ones"),
        F.sum(F.col("bit") * (F.col("pos") % 1009)).alias("mark"),
    )


@query(
    "P9_bit_groups",
    sql(
        "D",
        "w AS (SELECT capture_id, k, b, coalesce(lead(b) OVER (PARTITION BY capture_id ORDER BY k), 0) AS b2, count(*) OVER (PARTITION BY capture_id) AS nb FROM D)",
        "g AS (SELECT capture_id, ((8*k+j)//3)::BIGINT AS g, (((b::BIGINT << 8) + b2) >> (13-j)) & 7 AS v, nb FROM w, range(8) t(j) WHERE (8*k+j) % 3 = 0 AND 8*k+j+3 <= 8*nb)",
        "SELECT capture_id, count(*) AS groups, sum(v)::BIGINT AS total, sum(v*(g % 1009))::BIGINT AS mark FROM g GROUP BY 1",
    ),
)
def p9_groups(inp: Inputs):
    return (
        B.bit_groups(inp.payloads(), 3)
        .groupBy("capture_id")
        .agg(
            F.count("*").alias("groups"),
            F.sum("v").alias("total"),
            F.sum(F.col("v").cast("long") * (F.col("g") % 1009)).alias("mark"),
        )
    )


@query(
    "P15_payload_slice",
    sql(
        "E10",
        "bt AS (SELECT capture_id, n AS pos, (i > 0)::INT AS bit FROM E10)",
        "st AS (SELECT capture_id, CASE WHEN capture_id % 3 = 0 THEN 10 + 32 WHEN capture_id = 4 THEN 100000000 ELSE 0 END AS start FROM (SELECT DISTINCT capture_id FROM E10))",
        "SELECT capture_id, (pos - start)::BIGINT AS pos, bit FROM bt JOIN st USING (capture_id) WHERE pos >= start",
    ),
)
def p15(inp: Inputs):
    samples = inp.label_samples()
    bits = samples.select("capture_id", F.col("n").alias("pos"), (F.col("i") > 0).cast("int").alias("bit"))
    cid = F.col("capture_id")
    starts = inp.label_blocks().select("capture_id").distinct().select(
        "capture_id",
        F.when(cid == 4, F.lit(100_000_000))
        .otherwise(payload.payload_start(cid % 3 == 0, F.lit(10), F.lit(32)))
        .cast("long")
        .alias("start"),
    )
    return payload.slice_bits(bits, starts)


@query(
    "P16_content_class",
    sql(
        "D",
        "s AS (SELECT capture_id, avg(CASE WHEN (b >= 32 AND b < 127) OR b IN (9, 10, 13) THEN 1.0 ELSE 0.0 END) AS share FROM D GROUP BY 1)",
        "SELECT doc_id AS capture_id, CASE WHEN share IS NULL THEN 'empty' WHEN share >= 0.9 THEN 'text' WHEN share >= 0.5 THEN 'mixed' ELSE 'binary' END AS content_type FROM documents LEFT JOIN s ON capture_id = doc_id",
    ),
)
def p16(inp: Inputs):
    return inp.payloads().select("capture_id", payload.content_class(F.col("data")).alias("content_type"))


@query(
    "P17_payload_preview",
    sql(
        "D",
        "s AS (SELECT capture_id, count(*) AS n, avg(CASE WHEN (b >= 32 AND b < 127) OR b IN (9, 10, 13) THEN 1.0 ELSE 0.0 END) AS share FROM D GROUP BY 1)",
        """h AS (SELECT capture_id, k, b, lower(printf('%02X', b::INT)) AS x, CASE WHEN b >= 32 AND b < 127 THEN chr(b::INT) ELSE '.' END AS c,
   CASE WHEN (b >= 32 AND b < 127) OR b IN (9, 10, 13) THEN chr(b::INT) ELSE '.' END AS t FROM D WHERE k < 256)""",
        "ln AS (SELECT capture_id, k//16 AS row, lower(printf('%08X', (k//16*16)::INT)) || '  ' || rpad(string_agg(x, ' ' ORDER BY k), 47, ' ') || '  |' || string_agg(c, '' ORDER BY k) || '|' AS line FROM h GROUP BY capture_id, k//16)",
        "du AS (SELECT capture_id, string_agg(line, chr(10) ORDER BY row) AS dump FROM ln GROUP BY 1)",
        "hx AS (SELECT capture_id, string_agg(x, '' ORDER BY k) AS hex_preview, string_agg(t, '' ORDER BY k) AS text_preview FROM h GROUP BY 1)",
        """SELECT s.capture_id, n::INT AS bytes, CASE WHEN share >= 0.9 THEN 'text' WHEN share >= 0.5 THEN 'mixed' ELSE 'binary' END AS content_type,
   hex_preview, text_preview || CASE WHEN n > 256 THEN '...' ELSE '' END AS text_preview,
   dump || CASE WHEN n > 256 THEN chr(10) || '... ' || (n-256)::VARCHAR || ' more byte(s) not shown' ELSE '' END AS hexdump
   FROM s JOIN hx USING (capture_id) JOIN du USING (capture_id)""",
    ),
)
def p17(inp: Inputs):
    return payload.describe(inp.payloads()).withColumn("hexdump", F.array_join("hexdump", "\n"))


# -- checksums ----------------------------------------------------------------

CRC_TABLE = """T AS (SELECT list(v ORDER BY k) AS t FROM (
  SELECT k, list_reduce(range(8), lambda a, b: CASE WHEN a & 32768 > 0 THEN xor((a << 1) & 65535, 4129) ELSE (a << 1) & 65535 END, (k << 8)::BIGINT) AS v FROM range(256) r(k)))"""
BYTE_LISTS = """BL AS (SELECT doc_id AS capture_id, text, list_transform(regexp_extract_all(hex(encode(text)), '..'),
  lambda hx: ((instr('0123456789ABCDEF', hx[1])-1)*16 + instr('0123456789ABCDEF', hx[2])-1)::BIGINT) AS h FROM documents)"""
CRC_FOLD = "list_reduce(h, lambda s, b: xor((s << 8) & 65535, t[xor(s >> 8, b)+1]), 65535::BIGINT)"


def _crc32_sql() -> str:
    table = """T32 AS (SELECT list(v ORDER BY k) AS u FROM (
  SELECT k, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 > 0 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, k::BIGINT) AS v FROM range(256) r(k)))"""
    fold = "xor(list_reduce(h, lambda s, b: xor(s >> 8, u[xor(s, b) & 255 + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
    fold = fold.replace("xor(s, b) & 255 + 1", "(xor(s, b) & 255) + 1")
    return "WITH " + ",\n".join([CRC_TABLE, table, BYTE_LISTS]) + f"""
SELECT capture_id, {CRC_FOLD}::INT AS crc16, {fold} AS crc32, true AS appended_holds, capture_id % 2 = 0 AS tampered_holds FROM BL, T, T32"""


@query("A37_checksums", _crc32_sql())
def a37(inp: Inputs):
    framed = B.with_crc16(F.col("data"))
    # Odd captures get their last checksum byte inverted.
    flip = F.unhex(F.lpad(F.hex(255 - F.conv(F.hex(F.substring("framed", -1, 1)), 16, 10).cast("int")), 2, "0"))
    size = F.length("framed")
    tampered = F.when(F.col("capture_id") % 2 == 0, F.col("framed")).otherwise(
        F.concat(F.substring("framed", F.lit(1), size - 1), flip)
    )
    return inp.payloads().withColumn("framed", framed).select(
        "capture_id",
        B.crc16(F.col("data")).alias("crc16"),
        F.crc32("data").alias("crc32"),
        B.crc16_holds(F.col("framed")).alias("appended_holds"),
        B.crc16_holds(tampered).alias("tampered_holds"),
    )


# A fold that keeps, in one number, the CRC after the last three bytes, the last byte, the
# position and the first matching end: state = crc0 | crc1<<16 | crc2<<32 | last<<48 | k<<56 | hit<<80.
def _scan_fold(lo: str) -> str:
    crc0 = "xor(((s & 65535) << 8) & 65535, t[(xor(((s & 65535) >> 8)::BIGINT, b::BIGINT))+1])::HUGEINT"
    k = "((s >> 56) & 16777215)"
    return f"""list_reduce(h, lambda s, b: ({crc0} | ((s & 65535) << 16) | (((s >> 16) & 65535) << 32) | (b << 48) | (({k} + 1) << 56)
   | ((CASE WHEN (s >> 80) > 0 THEN (s >> 80) WHEN {k} + 1 >= {lo} AND ((s >> 16) & 65535) = (((s >> 48) & 255) << 8) + b THEN {k} + 1 ELSE 0 END) << 80)), 65535::HUGEINT)"""


_FRAMED = """FR AS (SELECT capture_id, CASE WHEN capture_id % 2 = 0 THEN h || [c >> 8, c & 255] || CASE WHEN capture_id % 4 = 0 THEN [0::BIGINT, 0, 0] ELSE [] END ELSE h END AS h
  FROM (SELECT capture_id, h, """ + CRC_FOLD + """ AS c FROM BL, T))"""


def framed_payloads(inp: Inputs):
    """Even documents carry their CRC-16, every fourth one also three zero bytes."""
    cid = F.col("capture_id")
    pad = F.when(cid % 4 == 0, F.unhex(F.lit("000000"))).otherwise(F.unhex(F.lit("")))
    return inp.payloads().select(
        "capture_id",
        F.when(cid % 2 == 0, F.concat(B.with_crc16(F.col("data")), pad)).otherwise(F.col("data")).alias("data"),
    )


@query(
    "A38_crc_scan_free",
    "WITH " + ",\n".join([CRC_TABLE, BYTE_LISTS, _FRAMED]) + f""",
HU AS (SELECT capture_id, len(h) AS n, ({_scan_fold('3')} >> 80)::BIGINT AS hit FROM (SELECT capture_id, list_transform(h, lambda x: x::HUGEINT) AS h FROM FR), T)
SELECT capture_id, hit > 0 AS crc_pass, CASE WHEN hit > 0 THEN hit - 2 END::BIGINT AS payload_bytes, greatest(n - 2, 0)::INT AS trials FROM HU""",
)
def a38_free(inp: Inputs):
    return frames.crc_scan(framed_payloads(inp)).select(
        "capture_id", "crc_pass", F.length("payload").cast("long").alias("payload_bytes"), "trials"
    )


_ENDS = """EN AS (SELECT *, greatest(6, n - 33) AS lo FROM (SELECT capture_id, list_transform(h, lambda x: x::HUGEINT) AS h, len(h) AS n,
   len(h) - coalesce(nullif(list_position(list_transform(list_reverse(h), lambda x: x > 0), true), 0), len(h) + 1) + 1 AS bare FROM FR))"""


@query(
    "A38_crc_scan_strict",
    "WITH " + ",\n".join([CRC_TABLE, BYTE_LISTS, _FRAMED, _ENDS]) + f""",
HU AS (SELECT capture_id, n, lo, bare, ({_scan_fold("CASE WHEN bare >= 6 AND " + "((s >> 56) & 16777215)" + " + 1 = bare THEN 0 ELSE lo END")} >> 80)::BIGINT AS hit FROM EN, T)
SELECT capture_id, n >= 6 AND hit > 0 AS crc_pass, CASE WHEN n >= 6 AND hit > 0 THEN hit - 2 END::BIGINT AS payload_bytes,
  (CASE WHEN n < 6 THEN 0 ELSE n - lo + 1 + CASE WHEN bare >= 6 AND bare < lo THEN 1 ELSE 0 END END)::INT AS trials FROM HU""",
)
def a38_strict(inp: Inputs):
    return frames.crc_scan(framed_payloads(inp), min_payload=4, window=32).select(
        "capture_id", "crc_pass", F.length("payload").cast("long").alias("payload_bytes"), "trials"
    )


@query(
    "A39_trial_account",
    "WITH " + ",\n".join([CRC_TABLE, BYTE_LISTS, _FRAMED, _ENDS]) + f"""
SELECT capture_id, (CASE WHEN n < 6 THEN 0 ELSE n - lo + 1 + CASE WHEN bare >= 6 AND bare < lo THEN 1 ELSE 0 END END)::INT AS crc_trials,
 {r('(CASE WHEN n < 6 THEN 0 ELSE n - lo + 1 + CASE WHEN bare >= 6 AND bare < lo THEN 1 ELSE 0 END END)/65536.0', 9, 'expected_false_alarms')}, false AS false_alarm_risk_high FROM EN""",
)
def a39(inp: Inputs):
    scanned = frames.crc_scan(framed_payloads(inp), min_payload=4, window=32)
    return rounded(
        frames.with_trial_account(scanned.select("capture_id", F.col("trials").alias("crc_trials"))), 9
    )


# -- interleaving -------------------------------------------------------------

_BITS20 = "bt AS (SELECT capture_id, 8*k+j AS x, (b::BIGINT >> (7-j)) & 1 AS bit FROM D, range(8) t(j))"


def _marked(streams):
    """Per stream and hypothesis: bytes and a position-weighted byte sum."""
    return (
        streams.select("capture_id", "interleaver", B.byte_sums("data").alias("s"))
        .groupBy("capture_id", "interleaver")
        .agg(F.sum("s.n").alias("n_bytes"), F.sum("s.placed").alias("mark"))
        .where("n_bytes > 0")
    )


def _base_list() -> str:
    return str([int(v) for v in frames.random_base(frames.RANDOM_BLOCK)])


_MAPS_SQL = sql(
      "D",
      _BITS20,
      "nb AS (SELECT capture_id, count(*)*8 AS n FROM D GROUP BY 1)",
      f"inv AS (SELECT list(m ORDER BY v) AS inv FROM (SELECT unnest({_base_list()}) AS v, generate_subscripts({_base_list()}, 1) - 1 AS m))",
      """mp AS (
SELECT capture_id, 'block' AS interleaver, (x//96)*96 + 12*(x%8) + (x%96)//8 AS p, bit FROM bt WHERE bit > 0
UNION ALL SELECT bt.capture_id, 'convolutional', ((((x//8 - x%8) % (n//8)) + n//8) % (n//8))*8 + x%8, bit FROM bt JOIN nb USING (capture_id) WHERE bit > 0
UNION ALL SELECT capture_id, 'diagonal', (x//96)*96 + ((x%96)//12)*12 + ((x%12) - (x%96)//12 + 12) % 12, bit FROM bt WHERE bit > 0
UNION ALL SELECT capture_id, 'pseudo-random-block', (x//256)*256 + (inv[(x%256)::INT+1] + x//256) % 256, bit FROM bt, inv WHERE bit > 0)""",
      "ms AS (SELECT capture_id, interleaver, sum((1 << (7-p%8)::INT) * (p//8+1))::BIGINT AS mark FROM mp GROUP BY 1, 2)",
      """SELECT capture_id, interleaver, CASE interleaver WHEN 'convolutional' THEN n//8 WHEN 'pseudo-random-block' THEN ((n+255)//256)*32 ELSE ((n+95)//96)*12 END AS n_bytes, mark
 FROM ms JOIN nb USING (capture_id)""",
  )
_MAPS = ("block", "convolutional", "diagonal", "pseudo-random-block")
#: Bits of the chunks in the chunk queries; small, so that the texts have several.
TEXT_CHUNK = 10 * interleave.UNIT_BITS


@query("A24_deinterleave", _MAPS_SQL)
def a24(inp: Inputs):
    return _marked(frames.deinterleave(inp.payloads(), _MAPS))


@query("A24_deinterleave_in_chunks", _MAPS_SQL)
def a24_chunks(inp: Inputs):
    """The same maps with streams of several rows: a byte counts by its place in the stream."""
    chunks = interleave.to_chunks(inp.payloads(), TEXT_CHUNK)
    parts = [
        interleave.deinterleave_chunks(chunks, name, TEXT_CHUNK).select(
            "capture_id", F.lit(name).alias("interleaver"), (F.col("chunk_no") * (TEXT_CHUNK // 8)).alias("start"),
            B.byte_sums("data").alias("s"),
        )
        for name in _MAPS
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    mark = F.sum(F.col("start") * F.col("s.plain") + F.col("s.placed"))
    return rows.groupBy("capture_id", "interleaver").agg(F.sum("s.n").alias("n_bytes"), mark.alias("mark")).where("n_bytes > 0")


@query("J11_deinterleave_hypotheses")
def j11(inp: Inputs):
    return _marked(frames.deinterleave(inp.payloads()))


_SEARCH_SQL = (
    "WITH " + ",\n".join([CRC_TABLE, BYTE_LISTS, _FRAMED, _ENDS.replace("greatest(6,", "greatest(3,")]) + f""",
HU AS (SELECT capture_id, n, lo, bare, ({_scan_fold("CASE WHEN bare >= 3 AND " + "((s >> 56) & 16777215)" + " + 1 = bare THEN 0 ELSE lo END")} >> 80)::BIGINT AS hit FROM EN, T)
SELECT capture_id, n >= 4 AND hit > 0 AS validated, CASE WHEN n >= 4 AND hit > 0 THEN 'none' END AS interleaver,
  CASE WHEN n >= 4 AND hit > 0 THEN hit - 2 END::BIGINT AS payload_bytes FROM HU"""
)


@query("A41_frame_search", _SEARCH_SQL)
def a41(inp: Inputs):
    """Hypothesis "none" only: the part of the search that SQL can state over whole texts."""
    return frames.search(framed_payloads(inp), names=("none",), max_bits=None).select(
        "capture_id", "validated", "interleaver", F.length("payload").cast("long").alias("payload_bytes")
    )


@query("A41_frame_search_in_chunks", _SEARCH_SQL)
def a41_chunks(inp: Inputs):
    """The same search over streams of several rows, their checksums put together from the chunks."""
    chunks = interleave.to_chunks(framed_payloads(inp), TEXT_CHUNK)
    return interleave.search_chunks(chunks, ("none",), TEXT_CHUNK).select(
        "capture_id", "validated", "interleaver", F.col("payload_len").alias("payload_bytes")
    )


@query("A41_frame_search_all_hypotheses")
def a41_all(inp: Inputs):
    found = frames.with_trial_account(frames.search(framed_payloads(inp), max_bits=None))
    return rounded(
        found.select(
            "capture_id", "validated", "interleaver", F.length("payload").cast("long").alias("payload_bytes"),
            "n_attempts", "crc_trials", "expected_false_alarms", "false_alarm_risk_high",
        ),
        9,
    )


@query(
    "A42_blind_scores",
    sql(
        "D",
        "w AS (SELECT capture_id, k, b::BIGINT AS b, lead(b::BIGINT) OVER (PARTITION BY capture_id ORDER BY k) AS b2 FROM D)",
        "tr AS (SELECT capture_id, count(*)*8 AS n, sum(bit_count(xor(b, b >> 1) & 127) + CASE WHEN b2 IS NULL THEN 0 ELSE xor(b2 >> 7, b & 1) END)::BIGINT AS flips FROM w GROUP BY 1)",
        "sc AS (SELECT *, CASE WHEN n < 16 THEN 0.0 ELSE greatest(0.0, least(0.5, 0.35 - flips/n*0.2)) END AS drift, 0.25 AS rs FROM tr)",
        f"""SELECT capture_id, n::INT AS n_bits, flips::INT AS transitions, CASE WHEN drift >= rs THEN 'Convolutional r=1/2 K=7' ELSE 'RS(255,223)' END AS code_candidate,
   {r('greatest(drift, rs)', 6, 'code_confidence')}, 'Block' AS interleaver_candidate, 0.28::DOUBLE AS interleaver_confidence FROM sc""",
    ),
)
def a42(inp: Inputs):
    return rounded(frames.blind_scores(inp.payloads()))


@query(
    "U1_custom_hypotheses",
    sql(
        "E10",
        "bt AS (SELECT capture_id, n AS pos, (i > 0)::INT AS bit FROM E10)",
        "mp AS (SELECT 'swap' AS interleaver, n AS src_pos, n + CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END AS dst_pos FROM (SELECT DISTINCT n FROM E10))",
        "SELECT capture_id, interleaver, dst_pos::BIGINT AS pos, bit FROM bt JOIN mp ON pos = src_pos",
    ),
)
def u1(inp: Inputs):
    samples = inp.label_samples()
    bits = samples.select("capture_id", F.col("n").alias("pos"), (F.col("i") > 0).cast("int").alias("bit"))
    n = F.col("n")
    mapping = samples.select("n").distinct().select(
        F.lit("swap").alias("interleaver"), n.alias("src_pos"), (n + F.when(n % 2 == 0, 1).otherwise(-1)).alias("dst_pos")
    )
    return frames.deinterleave_custom(bits, mapping)


def _screen_sql() -> str:
    """Syndromes from a 40-bit window: one mask over the interleaved output bits per relation."""
    rows = []
    for turn, (name, length, generators) in enumerate(frames.CODES):
        rate = len(generators)
        for relation in frames.code_relations(length, generators):
            mask = 0
            for column, delay in relation:
                mask |= 1 << (rate * delay + (rate - 1 - column))
            rows.append(f"({turn}, '{name}', {rate}, {length}, {mask})")
    return sql(
        "D",
        """w AS (SELECT capture_id, k, count(*) OVER (PARTITION BY capture_id) * 8 AS nbits,
   (coalesce(lag(b, 4) OVER o, 0)::BIGINT << 32) + (coalesce(lag(b, 3) OVER o, 0)::BIGINT << 24) + (coalesce(lag(b, 2) OVER o, 0)::BIGINT << 16) + (coalesce(lag(b) OVER o, 0)::BIGINT << 8) + b::BIGINT AS win
   FROM D WINDOW o AS (PARTITION BY capture_id ORDER BY k))""",
        f"cd AS (SELECT * FROM (VALUES {', '.join(rows)}) v(turn, code, rate, klen, mask))",
        # Bit e ends a group of `rate` bits; the window is shifted so that bit e is the lowest.
        """g AS (SELECT capture_id, nbits, 8*k+j AS e, win >> (7-j) AS reg FROM w, range(8) t(j))""",
        """sy AS (SELECT capture_id, turn, code, mask, any_value(nbits//rate) AS groups, count(*) FILTER ((e+1)//rate - 1 >= klen-1) AS tested,
   sum(CASE WHEN (e+1)//rate - 1 >= klen-1 THEN bit_count(reg & mask) % 2 ELSE 0 END) AS weight
   FROM g JOIN cd ON (e+1) % rate = 0 AND e < nbits GROUP BY 1, 2, 3, 4)""",
        """sm AS (SELECT capture_id, turn, code, (CASE WHEN any_value(groups) < 4 THEN 0 ELSE sum(tested) END)::BIGINT AS n_positions,
   CASE WHEN any_value(groups) < 4 OR sum(tested) = 0 THEN 1.0 ELSE round(sum(weight)/sum(tested), 6) END AS syndrome FROM sy GROUP BY 1, 2, 3)""",
        f"""SELECT * FROM (SELECT capture_id, (row_number() OVER (PARTITION BY capture_id ORDER BY syndrome, turn))::INT AS rank, 'none' AS interleaver, code, n_positions,
   {r('syndrome', 6, 'syndrome')}, syndrome <= 0.10 AS plausible FROM sm) WHERE rank <= 4""",
    )


@query("A40_code_screen", _screen_sql())
def a40(inp: Inputs):
    return rounded(frames.code_screen(inp.payloads(), names=("none",)))


@query("A40_code_screen_all_hypotheses")
def a40_all(inp: Inputs):
    return rounded(frames.code_screen(inp.payloads()))
