"""Scalar functions on strings, as columns over built-in functions."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of languages and their codes. The order decides which name wins where a text holds several.
LANGUAGES = {
    "ukrainian": "uk",
    "german": "de",
    "hebrew": "he",
    "hungarian": "hu",
    "norwegian": "no",
    "dutch": "nl",
    "chinese": "zh",
    "japanese": "ja",
    "arabic": "ar",
    "english": "en",
    "portuguese": "pt",
    "romanian": "ro",
    "french": "fr",
    "czech": "cs",
    "swedish": "sv",
    "greek": "el",
    "indonesian": "id",
    "spanish": "es",
    "danish": "da",
    "russian": "ru",
    "italian": "it",
    "thai": "th",
    "vietnamese": "vi",
    "korean": "ko",
    "finnish": "fi",
    "turkish": "tr",
    "hindi": "hi",
    "polish": "pl",
    "malay": "ms",
}
# An answer with one of these says that the language isn't known; its code.
UNCERTAIN = ("unknown", "unclear", "unsure", "could be")
NO_LANGUAGE = "int"

_EDGES = r"^[\x00-\x20]+|[\x00-\x20]+$"


def strip_controls(text: Column) -> Column:
    """Without spaces and control characters at both ends; trim() alone cuts spaces only."""
    return F.regexp_replace(text, _EDGES, "")


def clean_language(text: Column) -> Column:
    """A language answer as a two-letter code, or `int` where it names none."""
    return once(F.lower(strip_controls(F.coalesce(text, F.lit("")))), _code)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once a row however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _code(t: Column) -> Column:
    out = F.when(t == "", F.lit(NO_LANGUAGE))
    for word in UNCERTAIN:
        out = out.when(t.contains(word), F.lit(NO_LANGUAGE))
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    out = out.when(t.isin(list(LANGUAGES)), F.try_element_at(names, t)).when(t.rlike("^[a-z]{2}$"), t)
    for name, code in LANGUAGES.items():
        out = out.when(t.contains(name), F.lit(code))
    return out.otherwise(F.lit(NO_LANGUAGE))


def sanitize_filename(text: Column) -> Column:
    """A safe file name part: other characters become `_`, outer dots and underscores go, runs of `_` shrink to one."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[^a-zA-Z0-9._-]", "_")
    t = F.regexp_replace(F.regexp_replace(t, "^[._]+|[._]+$", ""), "_{2,}", "_")
    return F.when(t == "", F.lit("unknown")).otherwise(t)


def language_for_filename(text: Column) -> Column:
    return sanitize_filename(clean_language(text))


def target_name(language: Column, emoji: Column, keyword: Column, name: Column) -> Column:
    """`lang_emoji_keyword_name`; a null emoji reads `null`."""
    return F.format_string("%s_%s_%s_%s", clean_language(language), F.coalesce(emoji, F.lit("null")), sanitize_filename(keyword), name)


def strip_fences(text: Column) -> Column:
    """Without Markdown code fences."""
    return strip_controls(F.regexp_replace(F.regexp_replace(text, r"```json\s*", ""), r"```\s*", ""))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units; null counts as empty."""
    return (F.octet_length(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")) / 2).cast("bigint")


def token_estimate(*texts: Column) -> Column:
    """Four characters a token and a margin of a fifth, rounded."""
    total = F.lit(0).cast("bigint")
    for text in texts:
        total = total + utf16_length(text)
    return F.floor(total / F.lit(4.0) * F.lit(1.2) + F.lit(0.5)).cast("bigint")


def plain_base64(content: Column) -> Column:
    """Base64 on one line."""
    return F.regexp_replace(F.base64(content), "[\r\n]", "")


def base64_length(size: Column) -> Column:
    return (F.ceil(size / 3) * 4).cast("bigint")


def context_size(estimate: Column, encoded_length: Column, least: int = 4000, most: int = 65536) -> Column:
    """Tokens of a text and of an image of this base64 length, within the limits of the model."""
    whole = F.floor(estimate + encoded_length / F.lit(4.0) * F.lit(1.3) + F.lit(0.5)).cast("bigint")
    return F.greatest(F.lit(least), F.least(F.lit(most), whole)).cast("bigint")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def parent_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def sibling(path: Column, suffix: str) -> Column:
    """The folder beside a file's own whose name has the suffix: `/a/b/x.png` gives `/a/b_suffix`."""
    return F.concat(parent_path(path), F.lit(suffix))


# The patterns of the file names below must be these for names to come out right.
def group_file_name(group: Column, name: Column) -> Column:
    """A file's name under a five-digit group id. Sticker ids move to the front, an old group prefix is replaced."""
    shape = r"^[0-9]{5}_(.*)_([0-9]{5,8})@2x.png$"
    with_id = F.format_string("%s_%08d_%s.png", group, F.regexp_extract(name, shape, 2).try_cast("bigint"), F.regexp_extract(name, shape, 1))
    new = F.when(name.rlike(shape), with_id).when(name.rlike("^[0-9]{5}_"), F.concat_ws("_", group, F.substring(name, 7, 1 << 30)))
    return F.replace(new.otherwise(F.concat_ws("_", group, name)), F.lit("__"), F.lit("_"))


def pack_file_name(name: Column) -> Column:
    """Without a group prefix, and with a trailing sticker id moved to the front as eight digits."""
    bare = F.when(name.rlike("^[0-9]{5}_"), F.substring(name, 7, 1 << 30)).otherwise(name)
    shape = r"^(.*)_([0-9]{5,8})(@2x)?.png$"
    return F.when(bare.rlike(shape), F.format_string("%08d_%s.png", F.regexp_extract(bare, shape, 2).try_cast("bigint"), F.regexp_extract(bare, shape, 1))).otherwise(bare)


def delete_me_name(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, r"\.png$", ""), F.lit("_DELETE-ME.png"))


def eta_seconds(queue: Column, per_minute: Column) -> Column:
    """Seconds until a queue is empty; null where the rate is next to nothing."""
    return F.when(queue == 0, F.lit(0).cast("bigint")).when(per_minute <= 0.01, F.lit(None).cast("bigint")).otherwise((queue / per_minute * 60).cast("bigint"))


def eta_text(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    out = F.when(seconds.isNull(), F.lit("unknown")).when(seconds == 0, F.lit("done"))
    out = out.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s))
    return out.otherwise(F.format_string("%ds", s))


def log_stamp(ts: Column, for_file: bool = False) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HH-mm-ss" if for_file else "yyyy-MM-dd HH:mm:ss.SSS")


def context_json(values: Column | None = None) -> Column:
    """Prompt data as JSON; without data an empty object."""
    return F.to_json(values) if values is not None else F.lit("{}")


def json_schema(kind: T.StructType) -> str:
    """A struct type as a JSON schema (2020-12) with all fields required, names in order."""
    simple = {"string": "string", "boolean": "boolean", "int": "integer", "bigint": "integer", "double": "number"}

    def of(t: T.DataType) -> dict:
        if isinstance(t, T.StructType):
            return {"type": "object", "properties": {f.name: of(f.dataType) for f in sorted(t, key=lambda f: f.name)}, "required": sorted(f.name for f in t)}
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": of(t.elementType)}
        return {"type": simple[t.simpleString()]}

    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", **of(kind)})
