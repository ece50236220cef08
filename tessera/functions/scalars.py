"""Scalar functions over text, names, numbers and maps, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tagged(tag: Column, caption: Column) -> Column:
    return F.concat_ws("\n", tag, caption)


def tag_content(c: Column, tag: str) -> Column:
    """The first <tag> part, or the whole text."""
    return F.coalesce(F.nullif(F.regexp_extract(c, f"(?s)<{tag}>(.*?)</{tag}>", 1), F.lit("")), c)


def json_object(c: Column) -> Column:
    """From the first brace to the last, whatever stands around; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def lint_flags(c: Column, words: list[str], most: int, tag: str) -> Column:
    """Flags: too many connectives, missing tag."""
    n = F.size(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b(" + "|".join(words) + r")\b"), F.lit(1)))
    return F.array_compact(F.array(F.when(n > most, F.lit("connectives")), F.when(~c.contains(f"<{tag}>"), F.lit("no_tag"))))


def clip_key(clip: Column, start: Column, stop: Column) -> Column:
    return F.concat(clip.cast("string"), F.lit("_"), start.cast("string"), F.lit("-"), stop.cast("string"))


def rate(c: Column) -> Column:
    """a/b as a number; null for other texts and for b = 0."""
    a, b = (F.split_part(c, F.lit("/"), F.lit(i)).try_cast("double") for i in (1, 2))
    return F.when(c.contains("/"), F.try_divide(a, b)).otherwise(c.try_cast("double"))


def to_factor(x: Column, factor: int, how: str = "round") -> Column:
    f = {"round": F.bround, "ceil": F.ceil, "floor": F.floor}[how]
    return (f(x / factor) * factor).cast("long")


def smart_size(h: Column, w: Column, factor: int, least: int, most: int) -> Column:
    """(h, w) aligned to factor with a pixel count between least and most; aspect ratios over 200 raise."""
    hb, wb = F.greatest(F.lit(factor), to_factor(h, factor)), F.greatest(F.lit(factor), to_factor(w, factor))
    down, up = F.sqrt(h * w / F.lit(float(most))), F.sqrt(F.lit(float(least)) / (h * w))
    hb2 = F.when(hb * wb > most, F.greatest(F.lit(factor), to_factor(h / down, factor, "floor"))).when(hb * wb < least, to_factor(h * up, factor, "ceil")).otherwise(hb)
    wb2 = F.when(hb * wb > most, F.greatest(F.lit(factor), to_factor(w / down, factor, "floor"))).when(hb * wb < least, to_factor(w * up, factor, "ceil")).otherwise(wb)
    wide = F.greatest(h, w) / F.least(h, w) > 200
    return F.when(wide, F.raise_error(F.lit("aspect ratio over 200")).cast("struct<h:bigint,w:bigint>")).otherwise(F.struct(hb2.cast("long").alias("h"), wb2.cast("long").alias("w")))


def frame_count(total: Column, video_fps: Column, fps: float, least: int, most: int, factor: int = 2) -> Column:
    """Frames to take at fps, between bounds and the total, a multiple of factor."""
    lo, hi = -(-least // factor) * factor, most // factor * factor
    n = F.least(F.greatest(total / video_fps * fps, F.lit(lo)), F.lit(hi), total)
    return (F.floor(n / factor) * factor).cast("long")


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


#: Offsets and scales of the technical and aesthetic parts, and their weights.
FUSION = {"technical": (0.1107, 0.07355), "aesthetic": (-0.08285, 0.03774), "weights": (0.6104, 0.3896)}


def fused_score(technical: Column, aesthetic: Column) -> Column:
    (a, b), (c, d), (u, v) = FUSION["technical"], FUSION["aesthetic"], FUSION["weights"]
    return logistic((technical - a) / b * u + (aesthetic - c) / d * v)


def likert(score: Column) -> Column:
    """1 to 5, clamped, as 0 to 1."""
    return (F.least(F.greatest(score, F.lit(1.0)), F.lit(5.0)) - 1) / 4


def boosted(mass: Column, keys: list[str], by: float) -> Column:
    """Shares of a map with the given keys multiplied and all made to sum to 1."""
    up = F.transform_values(mass, lambda k, v: F.when(k.isin(keys), v * by).otherwise(v))
    total = F.aggregate(F.map_values(up), F.lit(0.0), lambda a, x: a + x)
    return F.transform_values(up, lambda k, v: v / total)


def per_token(mass: Column, tokens: Column) -> Column:
    return F.transform_values(mass, lambda k, v: F.when(F.coalesce(tokens[k], F.lit(0)) > 0, v / tokens[k]).otherwise(F.lit(0.0)))


def preference(label: Column) -> Column:
    """A 1, B -1, same 0, anything else 22."""
    return F.when(label == "A", 1).when(label == "B", -1).when(label == "same", 0).otherwise(22)


def even(x: Column) -> Column:
    return to_factor(x, 2)


def paired_seed(base: int, index: Column, epoch: Column | int = 0) -> Column:
    return (F.lit(base) + (epoch if isinstance(epoch, Column) else F.lit(epoch)) * 1_000_000 + index).cast("long")


def uniform_indices(n: Column, k: int) -> Column:
    """Distinct rounded points of an even grid over 0..n-1."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / max(1, k - 1)).cast("long")))


def with_suffix_once(name: Column, frames: Column) -> Column:
    f = frames.cast("string")
    return F.when(name.contains("_ori"), name).otherwise(F.concat(name, F.lit("_"), f, F.lit("_ori"), f))


def valid_run_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$")


def ema_decay(step: Column, after: int, most: float, least: float = 0.0, inv_gamma: float | None = None, power: float = 2 / 3) -> Column:
    """0 until ``after``, then (1 + s) / (10 + s) of the steps since, or the warm-up 1 - (1 + s / inv_gamma)^-power if that is given; at most ``most``, then at least ``least``."""
    s = F.greatest(F.lit(0), step - after - 1)
    rising = (1 + s) / (10 + s) if inv_gamma is None else 1 - F.pow(1 + s / F.lit(float(inv_gamma)), F.lit(-power))
    return F.when(s <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), rising)))


def metric_number(c: Column) -> Column:
    """A metric's text as a number, booleans as 0 and 1; null for anything else."""
    return F.when(c == "true", 1.0).when(c == "false", 0.0).otherwise(c.try_cast("double"))
