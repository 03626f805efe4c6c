"""Column functions over paths, file names, model names and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of audio files.
AUDIO_SUFFIXES = (".wav", ".flac", ".mp3", ".m4a")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def suffix(path: Column) -> Column:
    """The last suffix with its dot, lower-cased; empty for none and for dot files."""
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    """The file name without its last suffix; dot files keep their name."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def is_audio(path: Column) -> Column:
    return suffix(path).isin(*AUDIO_SUFFIXES)


def segment_key(file_id: Column, segment: int = 0) -> Column:
    """The key of a stored sequence: the stem of the id and a zero-padded segment."""
    return F.concat(stem(file_id), F.format_string("_s%03d", F.lit(segment)))


def sample_key(group: Column, voice: Column, positive: Column) -> Column:
    """group_voice_pos or group_voice_neg; null as soon as a part is null, but a null flag counts as negative."""
    return F.concat(group.cast("string"), F.lit("_"), voice, F.lit("_"), F.when(positive, "pos").otherwise("neg"))


def trailing_number(path: Column) -> Column:
    """The number behind the last dash, or null."""
    return F.regexp_extract(path, r"-(\d+)$", 1).try_cast("bigint")


def model_info(name: Column) -> dict[str, Column]:
    """Encoder, architecture and size that a model name tells; lstm wins where both architectures stand in a name."""
    number = lambda p: F.coalesce(F.regexp_extract(name, p, 1).try_cast("int"), F.lit(0))
    lstm, gpt2 = name.contains("lstm"), name.contains("gpt2")
    return {
        "encoder": F.when(lstm, F.split(name, "_lstm")[0]).when(gpt2, F.split(name, "_gpt2")[0]),
        "arch": F.when(lstm, "lstm").when(gpt2, "gpt2").otherwise("unknown"),
        "size": F.when(lstm, number(r"_h(\d+)")).when(gpt2, number(r"_e(\d+)")).otherwise(0),
    }


def day_tag(ts: Column) -> Column:
    """Month and day as in feb03."""
    return F.lower(F.date_format(ts, "MMMdd"))


def rewrite(key: Column, rules: list[tuple[str, str | None | tuple[tuple[str, str], ...]]]) -> Column:
    """The first rule (pattern, replacement) that matches rewrites the key; no match keeps it.

    A replacement is a text for the pattern, or several (part, text) that are replaced in turn, or None, which drops the key
    (null).
    """

    def changed(pattern: str, new) -> Column:
        if new is None:
            return F.lit(None).cast("string")
        if isinstance(new, str):
            return F.regexp_replace(key, pattern, new)
        out = key
        for part, text in new:
            out = F.replace(out, F.lit(part), F.lit(text))
        return out

    out = key
    for pattern, new in reversed(rules):
        out = F.when(key.rlike(pattern), changed(pattern, new)).otherwise(out)
    return out


#: Formats of time stamps.
STAMPS = {"full": "yyyy-MM-dd HH:mm:ss", "time": "HH:mm:ss", "date": "dd-MM-yy", "iso": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def stamp(ts: Column, kind: str = "full") -> Column:
    """A time stamp as text; an unknown kind is full."""
    return F.date_format(ts, STAMPS.get(kind, STAMPS["full"]))


def lstm_name(hidden: Column, layers: Column, dropout: Column, ts: Column) -> Column:
    return F.concat(F.lit("lstm_h"), hidden.cast("string"), F.lit("_l"), layers.cast("string"), F.lit("_d"), dropout.cast("string"), F.lit("_"), day_tag(ts))


def gpt2_name(embedding: Column, layers: Column, heads: Column, ts: Column) -> Column:
    return F.concat(F.lit("gpt2_e"), embedding.cast("string"), F.lit("_l"), layers.cast("string"), F.lit("_h"), heads.cast("string"), F.lit("_"), day_tag(ts))


def eta(seconds: Column) -> Column:
    """Whole hours and minutes, as in 2h5m."""
    whole = F.floor(seconds)
    return F.concat(F.floor(whole / 3600).cast("string"), F.lit("h"), F.floor(F.pmod(whole, F.lit(3600)) / 60).cast("string"), F.lit("m"))


def shown(value: Column) -> Column:
    """Four decimals, or N/A for null."""
    return F.when(value.isNull(), "N/A").otherwise(F.format_string("%.4f", value))


def spread(mean: Column, std: Column) -> Column:
    """mean±deviation, four decimals each, or N/A."""
    return F.when(mean.isNull(), "N/A").otherwise(F.format_string("%.4f\u00b1%.4f", mean, std))
