"""From block tables to one nested report per capture, for all captures at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.functions.bits import pack_frames
from tonelake.operators import bursts, frames, models, payload, rates, spectrum, state, stats, symbols, sync, verdicts
from tonelake.session import pin
from tonelake.sources.series import with_lookahead

DEFAULT_WORD = "0x1ACFFC1D"


def analyse(
    blocks: DataFrame,
    sample_rate: float | DataFrame,
    block_len: int,
    word: str = DEFAULT_WORD,
    nfft: int = spectrum.PSD_NFFT,
    line_nfft: int = 128,
    model=None,
    averaged: bool = False,
    least_line_nfft: int | None = None,
) -> DataFrame:
    """Report table of all captures in ``blocks`` (capture_id, block_no, start_n, i, q).

    A block leaves one row of sums in each of a few passes (``operators.state``), and the measures
    of all captures follow from these rows; a capture that a measure cannot handle keeps NULLs
    from the left joins. Samples, phase steps and bits are never rows.

    ``averaged`` takes centre, SNR and bandwidth from the spectrum over all frames of a capture
    instead of its first ``nfft`` samples. With ``least_line_nfft`` the frames of the rate lines
    shrink from ``line_nfft`` to that size for short captures; else these report no line.

    ``sample_rate`` is one rate for all captures or a table (capture_id, sample_rate) that may
    also name ``file_type`` and ``iq_format_used``. Frequencies are measured in cycles per
    sample and scaled by the capture's own rate.
    """
    inputs = _inputs(blocks, sample_rate)
    rate_of = inputs.select("capture_id", F.col("sample_rate").alias("_rate"))

    def scaled(part: DataFrame, *columns: str) -> DataFrame:
        timed = part.join(rate_of, "capture_id")
        return timed.select(*[(F.col(c) * F.col("_rate")).alias(c) if c in columns else F.col(c) for c in part.columns])

    # Few long rows instead of many short ones: every pass below is one Arrow stage over them.
    joined, block_len = state.coalesced(blocks, block_len)
    blocks = pin(joined) if joined is not blocks else blocks

    states = pin(state.block_states(blocks))
    whole = pin(state.merged(states))
    sizes = whole.select("capture_id", F.col("num").alias("num_samples"))
    windows = bursts.floored(state.envelope_windows(states))
    regions = pin(bursts.regions(windows, whole.select("capture_id", F.col("num").alias("n_samples"))))
    focus = pin(state.burst_focus(regions, models.FOCUS_MIN_SAMPLES, models.FOCUS_MIN_BURST))

    psd = spectrum.averaged_psd(blocks, sizes, 1.0, nfft, block_len) if averaged else _head_psd(blocks, focus.select("capture_id", F.lit(0).alias("lo"), F.lit(2**62).alias("hi")), nfft)
    measures = pin(scaled(spectrum.spectrum_measures(psd), "center_hz", "bandwidth_hz"))
    periods = pin(_tone_periods(blocks, states, whole, block_len))

    # Captures without a usable burst are in focus as wholes: their sums are there already.
    bursts_only = focus.where("NOT whole")
    inner = pin(state.block_states(blocks, bursts_only))
    focused_states = inner.unionByName(states.join(focus.where("whole").select("capture_id"), "capture_id", "left_semi"))
    focused = pin(state.merged(focused_states))
    rows = pin(_features(blocks, focused_states, focused, focus, nfft)).join(
        periods.select("capture_id", "period"), "capture_id", "left"
    ).fillna({"period": 1})
    ruled = models.classify_rules(rows).join(models.last_resort(state.last_resort(whole)), "capture_id", "left")
    if model is not None:
        learned = models.classify_learned(model, rows).select("capture_id", "ml_label", "ml_confidence", "probabilities")
        ruled = ruled.join(learned, "capture_id", "left")
    else:
        ruled = ruled.withColumn("ml_label", F.lit(None).cast("string")).withColumn("ml_confidence", F.lit(None).cast("double"))
        ruled = ruled.withColumn("probabilities", F.lit(None).cast("map<string, double>"))
    decided = models.decide(ruled).withColumnRenamed("label", "scheme").join(ruled.select("capture_id", "probabilities"), "capture_id")
    labels = pin(decided)

    bits = pin(_packed(blocks, whole, labels, periods, block_len))
    halo = -(-len(sync.parse_word(word)) // 8) * 8
    heads = pin(sync.find_header(state.packed_frames(bits, halo), word))
    starts = heads.select(
        "capture_id", payload.payload_start(F.col("detected"), F.col("offset"), F.col("sync_length")).alias("start")
    )
    streams = pin(state.payload_streams(bits, starts))
    bit_counts = bits.groupBy("capture_id").agg(F.sum("n_bits").alias("num_bits"))
    searched = pin(frames.with_trial_account(frames.search(streams)))
    blind = frames.blind_scores(streams)
    powers = whole.select("capture_id", ((F.col("s_ii") + F.col("s_qq")) / F.col("num")).alias("p"))
    table_of_fits = pin(state.fit_sums(blocks, powers))
    fits = symbols.fit_verdict(table_of_fits, table_of_fits, labels.select("capture_id", "scheme"))

    bpsk = table_of_fits.where("scheme = 'BPSK'").select("capture_id", "evm_percent")

    line = pin(scaled(spectrum.envelope_line_rate(blocks, sizes, 1.0, line_nfft, block_len, least_nfft=least_line_nfft), "symbol_rate_hz"))
    profile = pin(spectrum.coherence_profile(blocks, sizes, 1.0, line_nfft, block_len, least_nfft=least_line_nfft))
    cycle = pin(scaled(spectrum.cycle_rate(profile, sizes), "symbol_rate_hz"))
    parts = (
        sizes.select("capture_id")
        .join(measures.select("capture_id", "bandwidth_hz"), "capture_id", "left")
        .join(line.select("capture_id", F.when(F.col("found"), F.col("symbol_rate_hz")).alias("envelope_hz")), "capture_id", "left")
        .join(cycle.select("capture_id", F.when(F.col("found"), F.col("symbol_rate_hz")).alias("cycle_hz")), "capture_id", "left")
        .join(labels.select("capture_id", "scheme"), "capture_id", "left")
        .join(periods.select("capture_id", "period"), "capture_id", "left")
        .join(rate_of, "capture_id", "left")
        .select(
            "capture_id", "bandwidth_hz",
            F.when(~F.col("scheme").isin(*models.FSK), F.col("envelope_hz")).alias("envelope_hz"),
            "cycle_hz",
            F.when((F.col("period") > 1) & F.col("scheme").isin(*models.FSK), F.col("_rate") / F.col("period")).alias("period_hz"),
        )
    )
    symbol_rates = pin(rates.fuse_symbol_rate(parts))
    working = rates.fused_sampling_rate(
        measures.select("capture_id", "bandwidth_hz").join(symbol_rates.select("capture_id", "symbol_rate_hz"), "capture_id", "left")
    )
    cfo = pin(scaled(state.frequency_offset(states), "cfo_hz"))

    table = sizes.join(inputs, "capture_id").withColumn("duration_s", F.col("num_samples") / F.col("sample_rate"))
    for part, prefix in (
        (measures, "m_"), (regions, "b_"), (labels, "l_"), (bit_counts, "n_"), (heads, "h_"), (searched, "s_"), (blind, "f_"),
        (fits, "q_"), (bpsk, "e_"), (symbol_rates, "r_"), (working, "w_"), (cfo, "c_"), (starts, "p_"),
        (streams.select("capture_id", F.length("data").alias("bytes")), "x_"),
    ):
        renamed = part.select("capture_id", *[F.col(c).alias(prefix + c) for c in part.columns if c != "capture_id"])
        table = table.join(renamed, "capture_id", "left")
    return _assembled(table, word)


def _head_psd(blocks: DataFrame, focus: DataFrame, nfft: int) -> DataFrame:
    """Periodogram of the first ``nfft`` samples from ``lo`` on; only blocks that hold some are unpacked."""
    near = blocks.join(focus.select("capture_id", "lo", "hi"), "capture_id").where(
        (F.col("start_n") < F.least(F.col("hi"), F.col("lo") + nfft)) & (F.col("start_n") + F.size("i") > F.col("lo"))
    )
    at = F.greatest(F.col("lo") - F.col("start_n"), F.lit(0)).cast("int")
    until = F.least(F.col("hi"), F.col("lo") + nfft, F.col("start_n") + F.size("i"))
    count = (until - F.col("start_n") - at).cast("int")
    cut = near.select(
        "capture_id", (F.col("start_n") + at - F.col("lo")).alias("n"), F.slice("i", at + 1, count).alias("i"), F.slice("q", at + 1, count).alias("q")
    )
    parts = F.sort_array(F.collect_list(F.struct("n", "i", "q")))  # of nfft samples together
    head = cut.groupBy("capture_id").agg(parts.alias("c")).select(
        "capture_id", F.lit(0).cast("long").alias("frame_no"), F.flatten("c.i").alias("i"), F.flatten("c.q").alias("q")
    )
    return spectrum.spectra(head, 1.0)


def _tone_periods(blocks: DataFrame, states: DataFrame, whole: DataFrame, block_len: int) -> DataFrame:
    """Tone periods; only captures with candidate periods are dealt out with a look-ahead."""
    known = pin(state.lagged(states, whole))
    plans = pin(symbols.tone_plans(known))
    wanted = blocks.join(plans.select("capture_id"), "capture_id", "left_semi")
    haloed = with_lookahead(wanted, block_len + 1, block_len)
    steps = stats.frequency_arrays(haloed.select("capture_id", "block_no", "start_n", "i", "q", "own_len"), None, "own_len")
    rows = pin(steps.select("capture_id", "start_n", F.col("steps").alias("f"), "own_len"))
    freqs = stats.instant_frequency(blocks.join(plans.where(F.col("hi") > block_len).select("capture_id"), "capture_id", "left_semi"), block_len)
    return symbols.tone_scores(rows, freqs, plans, known, block_len)


def _features(blocks: DataFrame, states: DataFrame, merged: DataFrame, focus: DataFrame, nfft: int) -> DataFrame:
    """The 13 features of the samples in focus, always finite."""
    shares = state.step_distribution(blocks, states, merged, focus, [0.01, 0.99])
    shape = spectrum.spectrum_measures(_head_psd(blocks, focus, nfft)).select(
        "capture_id", F.col("snr_db").alias("psd_snr"), F.col("bandwidth_hz").alias("psd_bw_norm")
    )
    moments = state.step_moments(merged).select(
        "capture_id", F.log10(F.col("fvar") + 1e-12).alias("log_fvar"), F.col("kurtosis").alias("freq_kurt")
    )
    span = shares.select(
        "capture_id", F.col("nsig").cast("double").alias("freq_nsig"), F.greatest(F.col("q1") - F.col("q0"), F.lit(0.0)).alias("freq_prange")
    )
    joined = state.shape_features(merged)
    for part in (moments, span, shape):
        joined = joined.join(part, "capture_id", "left")
    return models.finite_features(joined)


def _packed(blocks: DataFrame, whole: DataFrame, labels: DataFrame, periods: DataFrame, block_len: int) -> DataFrame:
    """Packed bits of all captures: linear schemes block by block, tone schemes symbol by symbol."""
    linear = state.packed_bits(blocks, labels.select("capture_id", "scheme").join(whole.select("capture_id", "peak"), "capture_id"))
    tones = labels.where(F.col("scheme").isin(*models.FSK)).select("capture_id", "scheme")
    keyed = pin(stats.instant_frequency(blocks.join(tones.select("capture_id"), "capture_id", "left_semi"), block_len))
    for scheme, order in (("2-FSK", 2), ("4-FSK", 4)):
        mine = keyed.join(tones.where(F.col("scheme") == scheme).select("capture_id"), "capture_id", "left_semi")
        sliced = pack_frames(symbols.slice_tones(mine, periods, order), sync.FRAME_BITS, 0)
        linear = linear.unionByName(
            sliced.select("capture_id", F.col("frame_no").alias("block_no"), F.col("start").alias("start_bit"), F.col("n_bits").cast("long").alias("n_bits"), "data")
        )
    return linear


def _inputs(blocks: DataFrame, sample_rate: float | DataFrame) -> DataFrame:
    """(capture_id, sample_rate, file_type, iq_format_used), one row per capture."""
    if isinstance(sample_rate, DataFrame):
        given = sample_rate
    else:
        given = blocks.select("capture_id").distinct().withColumn("sample_rate", F.lit(float(sample_rate)))
    for name, usual in (("file_type", F.lit("iq")), ("iq_format_used", F.lit(None).cast("string"))):
        if name not in given.columns:
            given = given.withColumn(name, usual)
    return given.select("capture_id", "sample_rate", "file_type", "iq_format_used")


def _assembled(t: DataFrame, word: str) -> DataFrame:
    detected = F.coalesce("h_detected", F.lit(False))
    validated = F.coalesce("s_validated", F.lit(False))
    warnings = F.concat(
        F.array_compact(
            F.array(
                F.when(F.coalesce("m_bandwidth_hz", F.lit(0.0)) <= 0, F.lit("occupied bandwidth is not measurable")),
                F.col("l_warning"),
                F.when(~F.coalesce("q_fit_ok", F.lit(True)), F.lit("modulation fit is poor")),
                F.col("w_warning"),
                verdicts.wide_band_hint(
                    F.coalesce("m_bandwidth_hz", F.lit(0.0)), F.coalesce("r_symbol_rate_hz", F.lit(0.0)), F.col("e_evm_percent")
                ),
            )
        ),
        F.coalesce("r_warnings", F.array().cast("array<string>")),
    )
    state = verdicts.fan_out(
        t.select(
            "capture_id",
            F.col("l_scheme").alias("label"),
            F.col("l_confidence").alias("label_confidence"),
            F.array(*[F.lit(s) for s in symbols.LINEAR_SCHEMES[:4]]).alias("alternatives"),
            detected.alias("detected"),
            F.coalesce("h_score", F.lit(0.0)).alias("score"),
            F.coalesce("h_min_score", F.lit(1.0)).alias("min_score"),
            F.col("q_evm_percent").alias("evm_percent"),
            validated.alias("validated"),
            F.col("l_probabilities").alias("distribution"),
        )
    )
    verdict = state.select("capture_id", F.struct(*[c for c in state.columns if c != "capture_id"]).alias("judgments"))
    return t.join(verdict, "capture_id", "left").select(
        "capture_id",
        F.struct(F.lit("tonelake").alias("tool_name"), F.current_timestamp().alias("generated_at"), F.lit(None).cast("double").alias("elapsed_s")).alias("meta"),
        F.struct(
            F.col("capture_id").cast("string").alias("file_name"), "file_type", "iq_format_used", "sample_rate",
        ).alias("input"),
        F.struct(
            "num_samples",
            F.col("duration_s").alias("duration_seconds"),
            F.col("m_center_hz").alias("center_frequency_estimate"),
            F.col("m_bandwidth_hz").alias("bandwidth_estimate"),
            F.col("m_snr_db").alias("snr_db"),
            F.col("r_symbol_rate_hz").alias("symbol_rate_estimate"),
            F.col("r_method").alias("symbol_rate_method"),
            F.col("w_sampling_rate_hz").alias("sample_rate_estimate"),
            F.col("c_cfo_hz").alias("cfo_estimate_hz"),
            F.struct(
                F.col("b_found").alias("found"), F.col("b_start_sample").alias("start_sample"),
                F.col("b_end_sample").alias("end_sample"), F.col("b_snr_db").alias("snr_db"), F.col("b_reason").alias("reason"),
            ).alias("burst"),
        ).alias("signal"),
        F.struct(F.col("l_scheme").alias("estimated_type"), F.col("l_confidence").alias("confidence"), F.col("l_revised_from").alias("revised_from")).alias("modulation"),
        F.struct(F.col("l_scheme").alias("mode"), F.coalesce("n_num_bits", F.lit(0)).alias("num_bits")).alias("demodulation"),
        F.struct(
            F.lit(word).alias("sync_word"), F.col("h_offset").alias("header_offset"), F.col("h_score").alias("score"),
            detected.alias("detected"), F.col("h_min_score").alias("min_score"),
        ).alias("correlation"),
        F.struct(
            (F.coalesce("n_num_bits", F.lit(0)) - F.coalesce("p_start", F.lit(0))).alias("payload_bits"),
            F.coalesce("x_bytes", F.lit(0)).alias("raw_bytes"),
            F.struct(
                validated.alias("available"), F.length("s_payload").alias("bytes"),
                F.decode("s_payload", "ISO-8859-1").alias("text"),
            ).alias("decoded"),
            F.struct(
                F.coalesce("s_n_attempts", F.lit(0)).alias("attempts"), validated.alias("validated"), F.coalesce("s_crc_trials", F.lit(0)).alias("crc_trials")
            ).alias("search"),
        ).alias("payload"),
        F.struct(F.col("q_evm_percent").alias("evm_percent"), F.col("q_mer_db").alias("mer_db"), F.col("q_fit_ok").alias("fit_ok")).alias("quality"),
        F.struct(F.col("f_code_candidate").alias("candidate"), F.col("f_code_confidence").alias("confidence")).alias("fec"),
        F.struct(F.coalesce("s_interleaver", "f_interleaver_candidate").alias("candidate")).alias("interleaving"),
        "judgments",
        warnings.alias("warnings"),
        F.array().cast("array<string>").alias("errors"),
    )


def error_reports(failures: DataFrame) -> DataFrame:
    """(capture_id, reason) rows in the shape of a report without measurements."""
    return failures.select(
        "capture_id",
        F.struct(F.lit("tonelake").alias("tool_name"), F.current_timestamp().alias("generated_at"), F.lit(None).cast("double").alias("elapsed_s")).alias("meta"),
        F.struct(
            F.col("capture_id").cast("string").alias("file_name"), F.lit(None).cast("string").alias("file_type"),
            F.lit(None).cast("string").alias("iq_format_used"), F.lit(None).cast("double").alias("sample_rate"),
        ).alias("input"),
        F.array().cast("array<string>").alias("warnings"),
        F.array("reason").alias("errors"),
    )


def analyse_files(files: DataFrame, sample_rate: float, block_len: int, **options) -> DataFrame:
    """One report per file, also for files that cannot be read.

    ``files``: (capture_id, kind, iq_format, endian, content, error), as the size rule
    leaves them. A file's rate is that of its header, else that of a ``sample_rate`` column
    of ``files``, else ``sample_rate``.
    """
    from tonelake.sources.captures import read_blocks

    read = pin(read_blocks(files.where(F.col("error").isNull()), block_len))
    rejected = files.where(F.col("error").isNotNull()).select("capture_id", F.col("error").alias("reason"))
    broken = read.where(F.col("reason").isNotNull()).select("capture_id", "reason")
    good = read.where(F.col("reason").isNull()).select("capture_id", "block_no", "start_n", "i", "q")
    header = read.where(F.col("reason").isNull()).groupBy("capture_id").agg(F.max("sample_rate").alias("header_rate"))
    own = F.col("sample_rate") if "sample_rate" in files.columns else F.lit(None).cast("double")
    rate_of = (
        files.select("capture_id", "kind", "iq_format", own.alias("own_rate"))
        .join(header, "capture_id")
        .select(
            "capture_id",
            F.coalesce("header_rate", "own_rate", F.lit(float(sample_rate))).alias("sample_rate"),
            F.col("kind").alias("file_type"),
            F.when(F.col("kind") == "iq", F.col("iq_format")).alias("iq_format_used"),
        )
    )
    reports = analyse(good, rate_of, block_len, **options)
    return reports.unionByName(error_reports(rejected.unionByName(broken)), allowMissingColumns=True)
