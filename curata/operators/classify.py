"""Classification requests, bounded retries, answers and category matches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.text import base64_length, context_size, file_name, once, parent_path, strip_controls, strip_fences, target_name, token_estimate
from curata.plans.scratch import Scratch
from curata.sources.connectors import ERROR, OK, RETRY, Connector

#: Reads an image by its path, in the task; null if it can't be read.
Reader = Callable[[str], bytes | None]
#: Attempts at a request in all.
ATTEMPTS = 4
#: Fixed value: the category of an answer that matches no other; the one prompt type.
OTHER, IMAGE_TASK = "other", "STICKER_CLASSIFICATION"
ANSWER = "struct<detectedTags:array<string>,hasText:string,textLanguageGuess:string,emoji:string,keyword:string>"
REQUEST = "session_id string, kind string, image_path string, prompt string, prompt_type string, json_format string"

SYSTEM_PROMPT = """You label sticker images. You get one image and a list of tags with descriptions.
Answer with one JSON object and nothing else. Its fields are:
detectedTags (list of all tags that fit the picture; "other" if none does), hasText (true if any writing is visible),
textLanguageGuess (language of the writing, "Unknown" if unclear, "" without writing), emoji (one emoji for the mood or
action, not for the kind of figure), keyword (one to three words for the gist)."""


TEXT_PROMPT = """You help with sorting stickers. Answer the request in plain text, briefly, and use the given context only."""


def build_prompt(categories: list[tuple[str, str]]) -> str:
    """The user prompt: an intro, then `Tag:` and `Description:` of each base category in the config's order."""
    intro = "Look at this sticker and describe it. Set hasText if you see writing and guess its language. Choose an emoji, a keyword and all fitting tags for detectedTags from this list:\n\n"
    return intro + "".join(f"Tag: {name}\nDescription: {about}\n\n" for name, about in categories)


def image_requests(unique: DataFrame, prompt: str, session_id: str, json_format: str | None = None) -> DataFrame:
    """One request per unique file; the prompt is built once. Where files have a size, context_size is what the model needs."""
    need = [context_size(token_estimate(F.lit(SYSTEM_PROMPT), F.lit(prompt)), base64_length(F.col("size"))).alias("context_size")] if "size" in unique.columns else []
    return unique.select(F.lit(session_id).alias("session_id"), F.lit("image").alias("kind"), F.col("path").alias("image_path"), F.lit(prompt).alias("prompt"), F.lit(IMAGE_TASK).alias("prompt_type"), F.lit(json_format).cast("string").alias("json_format"), *need)


def with_contents(requests: DataFrame, images: DataFrame) -> DataFrame:
    """The requests with the bytes of their images, which are shuffled: for images that are rows of a table. Files are read by a reader."""
    return requests.join(images.select(F.col("path").alias("image_path"), "content"), "image_path", "left").select(*requests.columns, "content")


def parse_answer(raw: Column) -> Column:
    """A raw answer as struct<tags, hasText, textLanguageGuess, emoji, keyword>, or null if it is not valid.

    Code fences are cut; tags are trimmed, lower-cased and distinct, and there must be one at least and none null; hasText
    turns false where no language is named or it is unknown, and the language's text stays as it is.
    """
    return once(F.from_json(strip_fences(raw), ANSWER), lambda answer: _checked(raw, answer))


def _checked(raw: Column, answer: Column) -> Column:
    tags = F.array_distinct(F.transform(answer["detectedTags"], lambda t: F.lower(strip_controls(t))))
    valid = ~F.coalesce(strip_controls(raw) == "", F.lit(True)) & (F.coalesce(F.size(answer["detectedTags"]), F.lit(0)) > 0) & ~F.exists(answer["detectedTags"], lambda t: t.isNull())
    language = answer["textLanguageGuess"]
    named = (strip_controls(F.coalesce(language, F.lit(""))) != "") & ~F.lower(F.coalesce(language, F.lit(""))).contains("unknown")
    has_text = F.coalesce(F.lower(answer["hasText"]) == "true", F.lit(False)) & named
    return F.when(valid, F.struct(tags.alias("tags"), has_text.alias("hasText"), language.alias("textLanguageGuess"), answer["emoji"].alias("emoji"), answer["keyword"].alias("keyword")))


def answer_fault(raw: Column, whole: bool = False) -> Column:
    """Why a raw answer is not what was asked for, or null if it is: the first of the faults below that it has.

    `empty`, `no JSON`, `no object`, `tags missing`, `tags null`, `tags no list`,
    `tags empty`, `tag null`, `tag no text`, `hasText no boolean`, and `<field> no text` of the three text fields. A field
    that is missing or null is no fault but in tags; numbers and booleans pass as texts, "true" and "false" as booleans.
    What is missing, null or of another type is told apart on the parsed VARIANT, without a schema. What comes after an
    object is no fault, as in `parse_answer`, unless the answer must be JSON as a whole; a text that merely begins with
    another value, such as a number, is no JSON.
    """
    return once(strip_fences(raw), lambda x: once(F.struct(F.try_parse_json(x).alias("v"), _alone(x).alias("alone")), lambda got: _fault(raw, got["v"], got["alone"], whole)))


def _alone(x: Column) -> Column:
    """Whether a text is one JSON value and nothing else: parsers pass over what follows a value, but not within a list.

    No text holds its own digest, so the list can't end within the text.
    """
    digest = F.sha2(x, 256)
    return once(F.try_parse_json(F.concat(F.lit("[["), x, F.lit('], "'), digest, F.lit('"]'))), lambda v: _lone(v, digest))


def _lone(v: Column, digest: Column) -> Column:
    size = [F.size(F.try_variant_get(v, path, "array<variant>")) for path in ("$", "$[0]")]
    return F.coalesce((size[0] == 2) & (size[1] == 1) & (F.try_variant_get(v, "$[1]", "string") == digest), F.lit(False))


def _fault(raw: Column, v: Column, alone: Column, whole: bool) -> Column:
    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, path, "variant"))

    def nested(of: Column) -> Column:
        return of.startswith("OBJECT") | of.startswith("ARRAY")

    tags = F.try_variant_get(v, "$.detectedTags", "array<variant>")
    told = F.coalesce(F.lower(F.try_variant_get(v, "$.hasText", "string")), F.lit(""))
    boolean = kind("$.hasText").isin("BOOLEAN", "VOID") | told.isin("true", "false")
    checks = [
        (F.coalesce(strip_controls(raw) == "", F.lit(True)), "empty"),
        (v.isNull() | ~alone & (F.lit(whole) | ~F.schema_of_variant(v).startswith("OBJECT")), "no JSON"),
        (~F.schema_of_variant(v).startswith("OBJECT"), "no object"),
        (kind("$.detectedTags").isNull(), "tags missing"),
        (kind("$.detectedTags") == "VOID", "tags null"),
        (~kind("$.detectedTags").startswith("ARRAY"), "tags no list"),
        (F.size(tags) == 0, "tags empty"),
        (F.exists(tags, F.is_variant_null), "tag null"),
        (F.exists(tags, lambda t: nested(F.schema_of_variant(t))), "tag no text"),
        (~boolean, "hasText no boolean"),
        *[(nested(kind(f"$.{name}")), f"{name} no text") for name in ("textLanguageGuess", "emoji", "keyword")],
    ]
    out = F.when(checks[0][0], checks[0][1])
    for wrong, name in checks[1:]:
        out = out.when(wrong, name)
    return out


def _values(col: pa.Array) -> list:
    """Python values of a column; texts, bytes and whole numbers are made at once, not one by one."""
    kind = col.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or (pa.types.is_integer(kind) and not col.null_count):
        return col.to_numpy(zero_copy_only=False).tolist()
    return col.to_pylist()


def process(requests: DataFrame, connector: Connector, system_prompt: str = SYSTEM_PROMPT, text_prompt: str = TEXT_PROMPT, reader: Reader | None = None) -> DataFrame:
    """The requests with status (ok, retry or error) and raw; image requests with no path are retried.

    The system prompt is that of the request's kind. content and context, if the requests have them, are handed to the
    connector. reader, if given, reads the image of a request just before the call, unless the connector says that it
    needs none (`needs_content`): one image is in memory at a time, and none is shuffled. An image that can't be read is a
    failed attempt. One batch of rows is in memory at a time, and its columns are passed on as they came.
    """
    names = requests.columns
    reads = reader is not None and getattr(connector, "needs_content", True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for values in zip(*map(_values, batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                if row["kind"] == "image" and not row.get("image_path"):
                    got.append((RETRY, None))
                    continue
                try:
                    if reads and row["kind"] == "image":
                        row["content"] = reader(row["image_path"])
                        if row["content"] is None:
                            got.append((RETRY, None))
                            continue
                    row["system_prompt"] = system_prompt if row["kind"] == "image" else text_prompt
                    got.append(connector.process(row))
                except Exception:  # noqa: BLE001  a connector's own failure is a failed attempt
                    got.append((RETRY, None))
            told = [pa.array([x[k] for x in got], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], [*names, "status", "raw"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", status string, raw string"
    return requests.mapInArrow(run, schema)


def run_requests(requests: DataFrame, connector: Connector, attempts: int = ATTEMPTS, workers: int | None = None, reader: Reader | None = None) -> DataFrame:
    """One row per request: status (classified, string, error or exhausted), attempts, raw and the parsed answer.

    workers, if given, is the number of calls at a time; reader is that of `process`: requests then carry paths only,
    through every round.

    Every round calls the connector for what is still open and writes its results, so a call is never repeated by a
    recomputation. Exhausted requests are rows of their own and no errors.
    """
    work = Scratch(requests.sparkSession, "requests")
    open_, done = requests, []
    for k in range(attempts):
        dealt = open_.repartition(workers) if workers else open_
        called = process(dealt.withColumn("attempt", F.lit(k)), connector, reader=reader)
        valid = F.when(F.col("kind") == "image", parse_answer(F.col("raw")))
        judged = called.withColumn("answer", F.when(F.col("status") == OK, valid))
        kept = (F.col("status") == OK) & (F.col("answer").isNotNull() | ((F.col("kind") != "image") & F.col("raw").isNotNull()))
        state = F.when(F.col("status") == ERROR, "error").when(kept & (F.col("kind") == "image"), "classified").when(kept, "string").otherwise("exhausted" if k == attempts - 1 else "again")
        result = work.table(judged.select(*[c for c in requests.columns if c != "content"], (F.col("attempt") + 1).alias("attempts"), state.alias("status"), "raw", "answer"), f"attempt{k}")
        done.append(result.filter("status != 'again'"))
        again = result.filter("status = 'again'")
        if k == attempts - 1 or again.isEmpty():
            break
        if "content" not in requests.columns:
            open_ = again.select(*requests.columns)  # the open rows are carried on
        else:  # contents aren't written with the results
            left = again.select("image_path", "prompt", "session_id")
            open_ = requests.join(left, requests["session_id"].eqNullSafe(left["session_id"]) & requests["image_path"].eqNullSafe(left["image_path"]) & (requests["prompt"] == left["prompt"]), "left_semi")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def match_categories(rows: DataFrame, base: DataFrame, compound: DataFrame, key: str = "image_path", tags: str = "tags") -> DataFrame:
    """(key, categories): names of the base categories whose lower-cased name is a tag, with those compounds whose members
    are exactly the names found; `other` if there are none. Rows are not multiplied: tags are looked up one by one.

    base has name; compound has name and members, sorted. Both are joined by equality, so Spark broadcasts them below its
    own size limit and shuffles them beyond it.
    """
    names = base.select(F.lower("name").alias("tag"), F.col("name").alias("category")).distinct()
    each = rows.select(key, F.explode_outer(tags).alias("tag")).join(names, "tag", "left")
    found = each.groupBy(key).agg(F.array_sort(F.collect_set("category")).alias("found"))
    whole = compound.select(F.array_sort(F.array_distinct("members")).alias("found"), "name").groupBy("found").agg(F.array_sort(F.collect_set("name")).alias("compounds"))
    joined = found.join(whole, "found", "left")
    all_ = F.array_sort(F.array_union("found", F.coalesce("compounds", F.array().cast("array<string>"))))
    return joined.select(key, F.when(F.size("found") == 0, F.array(F.lit(OTHER))).otherwise(all_).alias("categories"))


def fan_out_plan(classified: DataFrame, output: str, existing: DataFrame, remove_original: bool = True) -> DataFrame:
    """Copies of each image to the folders of its categories, but not over existing files, and the move of the original.

    classified has image_path, categories, textLanguageGuess, emoji and keyword; existing has path.
    """
    name = target_name(F.col("textLanguageGuess"), F.col("emoji"), F.col("keyword"), file_name(F.col("image_path")))
    each = classified.select("image_path", F.explode("categories").alias("category"), name.alias("name"))
    copies = each.select(F.lit("copy").alias("action"), F.col("image_path").alias("src"), F.concat_ws("/", F.lit(output), "category", "name").alias("dst"), F.lit("category").alias("reason"))
    copies = copies.join(existing.select(F.col("path").alias("dst")), "dst", "left_anti").select("action", "src", "dst", "reason")
    if not remove_original:
        return copies
    return copies.unionByName(moves(classified, "_processed", "processed"))


def moves(rows: DataFrame, suffix: str, reason: str) -> DataFrame:
    """Moves of images to the sibling folder with the suffix: `_processed`, `_error`."""
    dst = F.concat(parent_path(F.col("image_path")), F.lit(f"{suffix}/"), file_name(F.col("image_path")))
    return rows.select(F.lit("move").alias("action"), F.col("image_path").alias("src"), dst.alias("dst"), F.lit(reason).alias("reason"))


def next_request(requests: DataFrame, *arrival: str) -> DataFrame:
    """The request that came first, if there is one: a top-1 by partial sorts, whatever the length of the queue."""
    return requests.orderBy(*arrival).limit(1)


def error_plan(results: DataFrame) -> DataFrame:
    return moves(results.filter("status = 'error'"), "_error", "error")
