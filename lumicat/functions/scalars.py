"""Scalar rules of the catalog as Column expressions, all evaluated inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumicat import config as C


def clamp_mtime(seconds: Column) -> Column:
    return F.greatest(F.lit(C.MTIME_MIN), F.least(F.lit(C.MTIME_MAX), seconds))


def mtime_anomalous(seconds: Column) -> Column:
    return ~seconds.between(C.MTIME_MIN, C.MTIME_MAX)


def id_text(digest: Column) -> Column:
    """URL-safe base64 of a binary id, without padding."""
    return F.translate(F.rtrim(F.base64(digest), F.lit("=")), "+/", "-_")


def content_id(size: Column, mtime: Column, content: Column) -> Column:
    """SHA-256 over size and clamped mtime (8 bytes each, low byte first) and the first and last 64 KiB."""

    def eight(x: Column) -> Column:
        return F.unhex(F.concat(*(F.substring(F.lpad(F.hex(x.cast("long")), 16, "0"), 15 - 2 * i, 2) for i in range(8))))

    n = F.octet_length(content)
    w = C.WINDOW_BYTES
    head = F.substring(content, 1, w)
    tail_from = F.greatest(n - w, F.least(n, F.lit(w)))
    tail = F.substr(content, tail_from + 1, n - tail_from)
    return F.sha2(F.concat(eight(size), eight(clamp_mtime(mtime)), head, tail), 256)


def flip_to_orientation(flip: Column) -> Column:
    pairs = [x for k, v in C.FLIP_TO_ORIENTATION.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), flip.cast("int"))


def valid_orientation(tag: Column) -> Column:
    return F.when(tag.between(1, 8), tag.cast("int"))


def aspect(width: Column, height: Column, orientation: Column) -> Column:
    """landscape, portrait or square of the upright image; null without both dimensions."""
    turned = F.coalesce(orientation, F.lit(1)) >= 5
    w, h = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    return F.when(w > h, "landscape").when(w < h, "portrait").when(w == h, "square")


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def valid_score(score: Column) -> Column:
    return is_finite(score) & score.between(C.SCORE_MIN, C.SCORE_MAX)


def rating(score: Column) -> Column:
    """Stars from a score, after narrowing to 32 bits; null for null and for values that aren't finite."""
    s = score.cast("float").cast("double")
    out = reduce(lambda w, t: w.when(s < t[0], t[1]), C.TIERS[1:], F.when(s < C.TIERS[0][0], C.TIERS[0][1])).otherwise(C.TOP_TIER[0])
    return F.when(is_finite(s), out)


def tier(score: Column) -> Column:
    s = score.cast("float").cast("double")
    out = reduce(lambda w, t: w.when(s < t[0], t[2]), C.TIERS[1:], F.when(s < C.TIERS[0][0], C.TIERS[0][2])).otherwise(C.TOP_TIER[1])
    return F.when(is_finite(s), out)


def effective_rating(own: Column, score: Column) -> Column:
    """A sidecar's own rating, else that of the score, else 0; null for a score that isn't finite."""
    return F.when(own.isNotNull() | score.isNull() | is_finite(score), F.coalesce(own, rating(score), F.lit(0)))


def color_label(score: Column, red: str = C.DEFAULT.red_label, green: str = C.DEFAULT.green_label) -> Column:
    """Red below 4, green from 7, else the empty text, which clears a label; null without a score."""
    s = score.cast("float").cast("double")
    return F.when(~is_finite(s), None).when(s < 4.0, red).when(s >= 7.0, green).otherwise("")


def two_decimals(x: Column, width: int = 5) -> Column:
    """Two decimals, ties to even on the exact value of a 32-bit float, zero-padded to ``width``."""
    exact = x.cast("float").cast("double").cast("decimal(38,17)")
    text = F.bround(exact, 2).cast("decimal(38,2)").cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def stem_of(path: Column) -> Column:
    """File name without its last extension; a leading dot starts no extension."""
    name = file_name(path)
    return F.when(name.rlike(r"(?s)^.+\.[^.]*\z"), F.regexp_extract(name, r"(?s)^(.+)\.[^.]*\z", 1)).otherwise(name)


def extension_of(path: Column) -> Column:
    name = file_name(path)
    return F.when(name.rlike(r"(?s)^.+\.[^.]*\z"), F.regexp_extract(name, r"(?s)^.+\.([^.]*)\z", 1)).otherwise("")


def with_extension(path: Column, extension: str) -> Column:
    """The path with its extension replaced, or added if it has none."""
    return F.when(path.rlike(r"[^/]\.[^./]*\z"), F.regexp_replace(path, r"\.[^./]*\z", f".{extension}")).otherwise(F.concat(path, F.lit(f".{extension}")))


def source_kind(path: Column) -> Column:
    e = F.lower(extension_of(path))
    return F.when(e.isin(*C.RASTER_EXTENSIONS), "raster").when(e.isin(*C.TESTED_RAW), "raw").when(e.isin(*C.UNTESTED_RAW), "untested_raw")


def is_ingestible(path: Column) -> Column:
    return F.lower(extension_of(path)).isin(*C.TESTED_RAW)


def safe_stem(stem: Column) -> Column:
    """The stem, or null if it holds a separator or a control character."""
    return F.when(~stem.rlike(r"[\p{Cc}/\\]"), stem)


def cap_bytes(text: Column, most: Column) -> Column:
    """The longest prefix of whole characters within ``most`` UTF-8 bytes.

    The prefix in bytes never splits a character further back than three bytes, so four cuts decide.
    """
    raw = text.cast("binary")
    cuts = [F.substr(raw, F.lit(1), F.greatest(most - k, F.lit(0))) for k in range(4)]
    whole = [F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")) for c in cuts]
    return F.when(text.isNotNull(), F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*whole, F.lit(""))))


def cluster_part(cluster: Column, pattern: str, none: str | None = None) -> Column:
    made = F.when(cluster >= 0, F.format_string(pattern, cluster))
    return F.coalesce(made, F.lit(none)) if none is not None else made


def export_name(path: Column, score: Column, cluster: Column, with_cluster: bool = True, with_score: bool = True) -> Column:
    """[cluster-NNN-][cull-NN.NN-]stem.jpg; parts without a value are left out."""
    parts = []
    if with_cluster:
        parts.append(F.coalesce(F.when(cluster.isNotNull(), F.format_string("cluster-%03d-", cluster)), F.lit("")))
    if with_score:
        parts.append(F.coalesce(F.when(is_finite(score), F.concat(F.lit("cull-"), two_decimals(score), F.lit("-"))), F.lit("")))
    return F.concat(*parts, stem_of(path), F.lit(".jpg"))


def rename_name(path: Column, score: Column, cluster: Column) -> Column:
    """Cluster-NNN|NONE_Cull-NN.NN|NONE-stem.ext within the file-name limit; null for an unsafe stem."""
    score_part = F.when(is_finite(score), F.concat(F.lit("Cull-"), two_decimals(score)))
    prefix = F.concat(cluster_part(cluster, "Cluster-%03d", "Cluster-NONE"), F.lit("_"), F.coalesce(score_part, F.lit("Cull-NONE")), F.lit("-"))
    ext = extension_of(path)
    dotted = F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))
    room = F.greatest(F.lit(0), F.lit(C.NAME_MAX_BYTES - 4) - F.octet_length(prefix) - F.octet_length(dotted))
    return F.concat(prefix, cap_bytes(safe_stem(stem_of(path)), room), dotted)


def under_root(path: Column, root: str) -> Column:
    """Path prefix by whole components."""
    root = root.rstrip("/") or "/"
    return (path == root) | path.startswith("/" if root == "/" else root + "/")


def is_managed_keyword(keyword: Column, root: str = C.DEFAULT.keyword_root) -> Column:
    tiers = "|".join(C.TIER_NAMES)
    fixed = keyword.rlike(rf"(?is)^(\Q{root}\E([|:].*)?|nima:({tiers}))$")
    number = F.regexp_extract(keyword, r"(?i)^cluster:(\+?[0-9]+|-0+)$", 1)
    return fixed | F.coalesce(number.try_cast("long") >= 0, F.lit(False))


def keywords(score: Column, cluster: Column, root: str = C.DEFAULT.keyword_root) -> Column:
    """Flat keywords: root, nima:<tier>, cluster:<id>; none without a score and a cluster."""
    t = tier(score)
    some = t.isNotNull() | cluster.isNotNull()
    return F.when(some, F.array_compact(F.array(F.lit(root), F.concat(F.lit("nima:"), t), F.concat(F.lit("cluster:"), cluster.cast("string"))))).otherwise(F.array().cast("array<string>"))


def hierarchical_keywords(score: Column, cluster: Column, root: str = C.DEFAULT.keyword_root) -> Column:
    return F.transform(keywords(score, cluster, root), lambda k: F.when(k == root, k).otherwise(F.concat(F.lit(root + "|"), k)))


#: The characters of Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: A decimal number: ASCII digits, with no type letter, digit group or hexadecimal form.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def number_text(text: Column) -> Column:
    """The trimmed text of a number, else null."""
    t = trimmed(text)
    return F.when(t.rlike(NUMBER), t)


def clean_keywords(words: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, trimmed), lambda w: w != "")))


def merge_keywords(existing: Column, incoming: Column, root: str = C.DEFAULT.keyword_root) -> Column:
    """Incoming replaces the managed ones among existing; null incoming keeps existing."""
    own = F.filter(F.coalesce(existing, F.array().cast("array<string>")), lambda k: ~is_managed_keyword(k, root))
    return F.when(incoming.isNull(), existing).otherwise(F.array_sort(F.array_distinct(F.concat(own, incoming))))


def valid_xml_text(text: Column) -> Column:
    """Only characters that XML 1.0 allows."""
    return ~text.rlike(r"[^\x09\x0A\x0D\x20-\uD7FF\uE000-\uFFFD\x{10000}-\x{10FFFF}]")


def half_away(x: Column) -> Column:
    """Rounds ties away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def parse_int32(text: Column) -> Column:
    d = number_text(text).try_cast("double")
    return F.when(is_finite(d) & d.between(-2147483648.0, 2147483647.0), half_away(d).cast("int"))


def parse_int64(text: Column) -> Column:
    t = number_text(text)
    d = t.try_cast("double")
    return F.coalesce(F.when(~t.rlike(r"[.eE]"), t.try_cast("long")), F.when(is_finite(d) & (F.abs(d) < 9.2e18), half_away(d).cast("long")))


def parse_float(text: Column) -> Column:
    d = number_text(text).try_cast("float")
    return F.when(is_finite(d), d)


def parse_bool(text: Column) -> Column:
    t = F.lower(trimmed(text))
    return F.when(t == "true", True).when(t == "false", False)


def parse_time(text: Column) -> Column:
    t = trimmed(text)
    return F.when(t.rlike(r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(F.upper(t)))


def valid_settings(temperature: Column, tint: Column, score: Column) -> Column:
    """The strict ranges of values that a caller sets (what is read from files is clamped or dropped)."""
    return temperature.between(2000, 50000) & tint.between(-150, 150) & valid_score(score)


def clamp(x: Column, low, high) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def or_null(x: Column, low, high) -> Column:
    return F.when(x.between(low, high), x)


def resolve_update(op: Column, value: Column, existing: Column) -> Column:
    """A three-state field patch: keep, clear or set."""
    return F.when(op == "set", value).when(op == "clear", None).otherwise(existing)


def conflict_outcome(exists: Column, forced: Column, file_mtime: Column, metadata_date: Column, processed_at: Column, is_ours: Column, has_settings: Column) -> Column:
    """What a sidecar write does; times are Unix seconds as doubles."""
    touched = processed_at.isNotNull() & (file_mtime - processed_at > C.MTIME_SLACK_SECONDS)
    keep, write = F.lit("conflict_preserved"), F.lit("overwritten")
    both = F.when(metadata_date > processed_at, keep).otherwise(write)
    neither = F.when(has_settings & ~is_ours, keep).otherwise(write)
    return (
        F.when(~exists, "created").when(forced, "forced_overwrite").when(touched, keep)
        .when(metadata_date.isNotNull() & processed_at.isNotNull(), both)
        .when(metadata_date.isNotNull(), write)
        .when(processed_at.isNotNull(), F.when(is_ours, write).otherwise(keep))
        .otherwise(neither)
    )


def cfa_pattern(filters: Column) -> Column:
    """Colour filter layout of a 2x2 cell from a LibRaw bit mask."""
    def color(row: int, col: int) -> Column:
        index = F.shiftright(filters.cast("long"), (((row << 1) & 14) | (col & 1)) << 1).bitwiseAND(F.lit(3))
        return F.element_at(F.array(*map(F.lit, "RGBG")), (index + 1).cast("int"))

    name = F.concat(color(0, 0), color(0, 1), color(1, 0), color(1, 1))
    return F.when(name.isin("RGGB", "BGGR", "GRBG", "GBRG"), name)


def bit_depth(white: Column) -> Column:
    return F.when(white == 0, 0).otherwise(F.length(F.bin(white.cast("long"))))


def fitted_size(width: Column, height: Column, long_edge: int, downscale_only: bool = False):
    """(width, height) of an aspect-preserving resize to a long edge, at least one pixel each."""
    if long_edge < 16:
        raise ValueError("the long edge is at least 16")
    w, h = width.cast("float"), height.cast("float")
    scale = F.lit(float(long_edge)).cast("float") / F.greatest(w, h)
    scale = scale.cast("float")
    if downscale_only:
        scale = F.least(scale, F.lit(1.0).cast("float"))
    size = [F.greatest(F.lit(1), F.floor((x * scale).cast("float") + 0.5).cast("int")) for x in (w, h)]
    return size[0], size[1]


def mark_box(tw: Column, th: Column, mw: Column, mh: Column, height_frac: float, margin_x: Column, margin_y: Column, slot: str) -> Column:
    """Struct x, y, w, h of a mark at the top right or bottom left; null if it doesn't fit.

    Equal margins: pass one column as both.
    """
    h = F.greatest(F.lit(1), F.floor(th * F.lit(height_frac) + 0.5).cast("int"))
    w = F.greatest(F.lit(1), F.floor(mw * (h / F.greatest(mh, F.lit(1))) + 0.5).cast("int"))
    x, y = (tw - margin_x - w, margin_y) if slot == "top_right" else (margin_x, th - margin_y - h)
    fits = (x >= 0) & (y >= 0) & (x + w <= tw) & (y + h <= th)
    return F.when(fits, F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.alias("w"), h.alias("h")))


def place(position: str, w: Column, h: Column, tw: Column, th: Column, mx: Column, my: Column) -> tuple[Column, Column]:
    """Top-left corner of a box at one of five positions."""
    left, right, top, bottom = mx, tw - mx - w, my, th - my - h
    return {
        "top_left": (left, top), "top_right": (right, top), "bottom_left": (left, bottom), "bottom_right": (right, bottom),
        "center": ((tw - w) / 2, (th - h) / 2),
    }[position]


def badge_box(tw: Column, th: Column, bw: Column, bh: Column, position: str = "bottom_right", scale_percent: float = 5.0) -> Column:
    """Struct x, y, w, h of a badge whose long edge is a share of the image's; null if it doesn't fit."""
    edge = F.greatest(tw, th).cast("double")
    factor = F.greatest(edge * F.lit(scale_percent / 100.0), F.lit(1.0)) / F.greatest(bw, bh)
    w, h = F.greatest(F.lit(1.0), bw * factor), F.greatest(F.lit(1.0), bh * factor)
    pad = F.greatest(F.lit(8.0), F.floor(edge * F.lit(0.015) + 0.5).cast("double"))
    x, y = place(position, w, h, tw.cast("double"), th.cast("double"), pad, pad)
    fits = (x >= 0) & (y >= 0) & (x + w <= tw) & (y + h <= th)
    return F.when(fits, F.struct(*(F.floor(v + 0.5).cast("int").alias(k) for k, v in zip("xywh", (x, y, w, h)))))


def shadow_ramp(height: Column, fraction: float) -> Column:
    """Alpha values 0..255 of the rows of the bottom band."""
    band = F.floor(height * F.lit(fraction) + 0.5).cast("int")
    last = F.greatest(band - 1, F.lit(1))
    return F.when(band > 0, F.transform(F.sequence(F.lit(0), band - 1), lambda i: F.floor(i / last * 255 + 0.5).cast("int"))).otherwise(F.array().cast("array<int>"))


def tone_value(sample: Column, exposure_ev: float) -> Column:
    """8-bit sRGB of a 16-bit linear sample: exposure, filmic curve, transfer function.

    The curve's constants are fixed values: 2.51, 0.03, 2.43, 0.59, 0.14.
    """
    x = sample / F.lit(65535.0) * F.lit(2.0**exposure_ev)
    y = (x * (2.51 * x + 0.03)) / (x * (2.43 * x + 0.59) + 0.14)
    y = F.greatest(F.lit(0.0), F.least(F.lit(1.0), y))
    s = F.when(y <= 0.0031308, 12.92 * y).otherwise(1.055 * F.pow(y, F.lit(1.0 / 2.4)) - 0.055)
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(s * 255.0 + 0.5).cast("int")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors, kept in [-1, 1]; null if their sizes differ."""
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def weighted_mean(bins: Column) -> Column:
    """Sum of (i + 1) times bin i."""
    return F.aggregate(F.transform(bins, lambda p, i: p.cast("double") * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
