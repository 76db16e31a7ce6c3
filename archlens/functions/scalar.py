"""Column expressions for catalog facts. All stay inside Spark's codegen."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Sentinels, codecs, tags and file extensions that decide results.
SENTINELS = ["", "N/A"]
INTRA_CODECS = ["prores", "dnxhd", "dnxhr"]
LOW_MAX, HIGH_MIN = 0.12, 0.25
REF_WIDTH, REF_HEIGHT, REF_FPS = 3840, 2160, 59.94
BUFFER_CAP_KBPS = 240000
VIDEO_EXTENSIONS = [".mp4", ".mov", ".mxf", ".mts", ".m2ts", ".ts", ".mkv", ".avi", ".m4v",
                    ".wmv", ".webm", ".mpg", ".mpeg"]
ENVIRONMENT_TEXT = ["no space left", "access is denied", "permission", "disk",
                    "not enough space", "error 5"]
READER_TEXT = ["failed to open", "could not find", "invalid data", "moov atom", "no such file",
               "avcodec", "reader", "demux", "could not read", "unable to find a suitable output"]
READER_TOKENS = ["avcuvid", "avqsv", "avsw", "avhw", "d3d11va", "d3d11", "dxva2", "cuda", "vulkan"]
LOADER_CODES = [0xC0000135, 0xC0000142, 0xC0000005, 0xC0000139]
DETAIL_CHARS = 300


def _missing(text: Column) -> Column:
    return text.isNull() | text.isin(*SENTINELS)


def lenient_float(text: Column) -> Column:
    return F.when(_missing(text), 0.0).otherwise(
        F.coalesce(text.try_cast("double"), F.lit(0.0)))


def lenient_int(text: Column) -> Column:
    whole = F.regexp_extract(text, r"^\s*([+-]?\d+)\s*$", 1)
    return F.coalesce(whole.try_cast("bigint"), F.lit(0))


def ratio(text: Column) -> Column:
    """``a/b`` or a plain number; missing, malformed or zero denominator is 0."""
    num = F.substring_index(text, "/", 1).try_cast("double")
    den = F.regexp_extract(text, r"^[^/]*/(.*)$", 1).try_cast("double")
    value = F.when(text.contains("/"), F.try_divide(num, den)).otherwise(text.try_cast("double"))
    return F.when(_missing(text), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))


def bit_depth(pix_fmt: Column, raw_bits: Column) -> Column:
    suffix = F.regexp_extract(pix_fmt, r"p(\d+)(?:le|be)?$", 1).try_cast("bigint")
    return (F.when(raw_bits > 0, raw_bits).when(suffix.isNotNull(), suffix)
            .when(F.length(pix_fmt) > 0, 8).otherwise(0).cast("bigint"))


def chroma(pix_fmt: Column) -> Column:
    return (F.when(pix_fmt.contains("420"), "4:2:0").when(pix_fmt.contains("422"), "4:2:2")
            .when(pix_fmt.contains("444"), "4:4:4").when(pix_fmt.startswith("gray"), "mono")
            .otherwise(""))


def is_vfr(real_rate: Column, avg_rate: Column) -> Column:
    r, a = (F.trim(F.coalesce(c, F.lit(""))) for c in (real_rate, avg_rate))
    unknown = ["", "0/0", "N/A"]
    return ~r.isin(*unknown) & ~a.isin(*unknown) & (r != a)


def normalized_bitrate(kbps: Column, width: Column, height: Column, fps: Column) -> Column:
    known = (width > 0) & (height > 0) & (fps > 0)
    return F.when(known, F.try_divide(kbps * 1000.0, width * height * fps)).otherwise(0.0)


def source_class(codec: Column, norm: Column) -> Column:
    return (F.when(F.lower(codec).isin(*INTRA_CODECS), "INTRA_LIKE")
            .when(norm <= 0, "NORMAL_LONG_GOP")
            .when(norm < LOW_MAX, "LOW_BITRATE_LONG_GOP")
            .when(norm >= HIGH_MIN, "HIGH_BITRATE_LONG_GOP").otherwise("NORMAL_LONG_GOP"))


def six_places(x: Column) -> Column:
    """``%.6f`` of a non-negative double by its exact value, ties to even, as C and Python print it.

    Java rounds the shortest decimal half up, which differs only where that
    decimal ends in half a unit. There the split halves of ``x`` times 15625,
    both exact, tell on which side of the half it lies.
    """
    n = F.floor(x * 1e6)
    half = n + 0.5
    high = x * 134217729.0 - (x * 134217729.0 - x)
    over = (x - high) * 15625.0 - (half / 64.0 - high * 15625.0)
    up = (over > 0) | ((over == 0) & (n % 2 == 1))
    return F.format_string("%.6f", F.when(x == half / 1e6, (n + F.when(up, 1).otherwise(0)) / 1e6).otherwise(x))


def class_evidence(codec: Column, norm: Column) -> Column:
    six = six_places(norm)
    return (F.when(F.lower(codec).isin(*INTRA_CODECS),
                   F.concat(F.lit("codec '"), codec, F.lit("' matched intra_like_codecs")))
            .when(norm <= 0, "fallback: unknown width/height/fps or OB")
            .when(norm < LOW_MAX, F.concat(F.lit("normalized_ob "), six, F.lit(f" < low_max {LOW_MAX}")))
            .when(norm >= HIGH_MIN, F.concat(F.lit("normalized_ob "), six, F.lit(f" >= high_min {HIGH_MIN}")))
            .otherwise(F.concat(F.lit("normalized_ob "), six, F.lit(f" within [{LOW_MAX}, {HIGH_MIN})"))))


def factors(width: Column, height: Column, fps: Column) -> dict[str, Column]:
    px = (width * height).cast("double")
    rate = F.when(fps > 0, fps).otherwise(REF_FPS)
    ref_px = float(REF_WIDTH * REF_HEIGHT)
    return {
        "spatial": F.when(px > 0, F.sqrt(px / ref_px)).otherwise(1.0),
        "temporal": rate / REF_FPS,
        "pixel_rate": F.when(px > 0, px * rate / (ref_px * REF_FPS)).otherwise(1.0),
    }


def frame_expression(expr: Column, fps: Column, cap: Column | None = None) -> Column:
    """A number, or ``FR*k`` frames at ``fps``; rounded up, capped, at least 1."""
    text = F.upper(F.regexp_replace(expr, " ", ""))
    factor = F.regexp_extract(text, r"^FR\*(.+)$", 1).try_cast("double")
    value = F.ceil(F.when(factor.isNotNull(), fps * factor).otherwise(text.try_cast("double")))
    return F.greatest(F.lit(1), value if cap is None else F.least(value, cap)).cast("bigint")


def clamp_round(value: Column, low: Column, high: Column) -> Column:
    """Clamp (null bounds are open), round half up, at least 1."""
    inside = F.least(F.greatest(value, low), high)
    return F.greatest(F.lit(1), F.floor(inside + 0.5)).cast("bigint")


def even(value: Column) -> Column:
    return F.greatest(F.lit(2.0), F.rint(value / 2) * 2)


def scaled_size(width: Column, height: Column, factor: float) -> tuple[Column, Column]:
    """Scale the long edge, keep the aspect, both edges even; null if unknown."""
    w_long, h_long = even(width * factor), even(height * factor)
    wide = width >= height
    w = F.when(wide, w_long).otherwise(even(F.try_divide(h_long * width, height)))
    h = F.when(wide, even(F.try_divide(w_long * height, width))).otherwise(h_long)
    known = (width > 0) & (height > 0)
    return F.when(known, w).cast("bigint"), F.when(known, h).cast("bigint")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(suffix(path) == "", name).otherwise(
        F.regexp_extract(name, r"^(.+)\.[^.]+$", 1))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def output_path(path: Column, preset: str, several_presets: bool) -> Column:
    """Mirror of the source path; a preset folder only when presets share a root."""
    ext = F.when(F.lower(suffix(path)) == ".mov", ".MOV").otherwise(".MP4")
    root = F.lit(preset.upper() + "/" if several_presets else "")
    parent = directory(path)
    return F.concat(root, F.when(parent == "", "").otherwise(F.concat(parent, F.lit("/"))),
                    stem(path), ext)


def job_id(path: Column) -> Column:
    clean = F.regexp_replace(stem(path), r"(?U)[^\w.-]+", "_")
    return F.concat(clean, F.lit("-"), F.substring(F.sha1(path), 1, 8))


def _contains_any(text: Column, needles: list[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | text.contains(needle)
    return hit


def failure_class(log: Column) -> Column:
    low = F.lower(log)
    return (F.when(_contains_any(low, ENVIRONMENT_TEXT), "environment")
            .when(_contains_any(low, READER_TEXT), "reader").otherwise("format"))


def _line_with(log: Column, needle: str) -> Column:
    line = F.trim(F.regexp_extract(log, rf"(?im)^(.*{needle}.*)$", 1))
    return F.when(line == "", needle).otherwise(line)


def short_detail(detail: Column) -> Column:
    """The detail as reports show it; :func:`reader_failure` gives it whole."""
    return F.substring(detail, 1, DETAIL_CHARS)


def reader_failure(log: Column, code: Column) -> tuple[Column, Column]:
    """(reason, whole detail) for a reader that failed; the first matching rule wins."""
    low = F.lower(F.coalesce(log, F.lit("")))
    loader = code.isNotNull() & F.pmod(code, F.lit(1 << 32)).isin(*LOADER_CODES)
    empty = F.regexp_replace(low, r"\s+", "") == ""
    lines = F.split(F.trim(F.regexp_replace(log, r"^\s+|\s+$", "")), r"\r?\n")
    rules = [
        (loader, "startup_failed", F.concat(F.lit("loader failure rc=0x"),
                                            F.lpad(F.hex(F.pmod(code, F.lit(1 << 32))), 8, "0"))),
        (empty, "startup_failed", F.concat(
            F.lit("no tool output at all (rc="), F.coalesce(code.cast("string"), F.lit("None")),
            F.lit("); the process did not start"))),
        (low.contains("unable to decode by"), "capability_refused", _line_with(log, "unable to decode")),
        (low.contains("invalid device id") | low.contains("no device"), "device_unavailable",
         _line_with(log, "device")),
        (low.contains("failed to initialize") | low.contains("could not initialize"),
         "reader_unavailable", _line_with(log, "initialize")),
        (low.contains("no video packets found"), "decode_failed", _line_with(log, "no video packets")),
        (low.contains("failed to open") | low.contains("could not find"), "decode_failed",
         _line_with(log, "open")),
        (low.contains("decoder") & low.contains("not supported"), "capability_refused",
         _line_with(log, "not supported")),
    ]
    reason, detail = None, None
    for test, name, text in rules:
        reason = F.when(test, name) if reason is None else reason.when(test, name)
        detail = F.when(test, text) if detail is None else detail.when(test, text)
    return (reason.otherwise("decode_failed"),
            detail.otherwise(F.element_at(lines, -1)))


def reader_name(log: Column) -> Column:
    """Reader named on the input line, else a line that starts with a known token."""
    named = F.regexp_extract(log, r"(?i)Input\s+Info\s+([A-Za-z][A-Za-z0-9_]*)\s*:", 1)
    token = F.regexp_extract(log, r"(?im)^\s*(" + "|".join(READER_TOKENS) + "):", 1)
    return F.nullif(F.lower(F.when(named != "", named).otherwise(token)), F.lit(""))


def encoded_frames(log: Column) -> Column:
    return F.regexp_extract(log, r"(?i)encoded\s+(\d+)\s+frames", 1).try_cast("bigint")


def reader_frames(log: Column) -> Column:
    return F.regexp_extract(log, r"(?m)^\s*(\d+)\s+frames,\s*End of file", 1).try_cast("bigint")


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def linear_to_db(gain: Column) -> Column:
    return F.when(gain <= 0, F.lit(float("-inf"))).otherwise(20 * F.log10(gain))


def rms_dbfs(samples: Column) -> Column:
    """Level of one block; null when a sample is not finite, -inf when silent."""
    bad = F.exists(samples, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    ssq = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(bad, F.lit(None).cast("double")).otherwise(
        F.when(ssq <= 0, F.lit(float("-inf"))).otherwise(10 * F.log10(ssq / F.size(samples))))


def samples_from_seconds(seconds: Column, rate: Column | float) -> Column:
    value = seconds * rate
    return (F.signum(value) * F.floor(F.abs(value) + 0.5)).cast("bigint")


def natural_key(text: Column) -> Column:
    """array<struct<kind,num,text>> whose order is the natural order of the text."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    digit = lambda p: p.rlike(r"^\d+$")
    return F.transform(parts, lambda p: F.struct(
        F.when(digit(p), 0).otherwise(1).alias("kind"),
        F.when(digit(p), p.cast("decimal(38,0)")).otherwise(F.lit(0)).alias("num"),
        F.when(digit(p), "").otherwise(p).alias("text")))


def one_in(name: Column, n: int) -> Column:
    """Deterministic 1-in-n selection by the first byte of the name's SHA-256."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 2), 16, 10).cast("int") % n == 0


def is_pcm(codec: Column) -> Column:
    low = F.lower(F.trim(codec))
    return F.coalesce(low.startswith("pcm_") | (low == "ipcm"), F.lit(False))


def bitrate_text(bits: Column) -> Column:
    whole = bits.cast("bigint")
    return (F.when(whole.isNull() | (whole <= 0), "")
            .when(whole % 1000 == 0, F.concat((whole / 1000).cast("bigint").cast("string"), F.lit("k")))
            .otherwise(whole.cast("string")))


def is_action_series(tool: Column) -> Column:
    compact = F.regexp_replace(F.lower(F.coalesce(tool, F.lit(""))), "[ _-]", "")
    return compact.contains("action")


def channel_parts(channel_id: Column) -> dict[str, Column]:
    """source, stream and channel of ``source:sN:cM`` (or ``:sNcM``), null if malformed."""
    pattern = r"^(.+):s(\d+):?c(\d+)$"
    text = F.trim(channel_id)
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return {"source_id": part(1), "stream_index": part(2).try_cast("bigint"),
            "channel_index": part(3).try_cast("bigint")}
