"""Golden cases of the scalar functions, and image functions on synthetic PNGs."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.functions import images, text
from curata.operators import classify


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


def test_clean_language(spark):
    cases = {None: "int", "": "int", "  ": "int", "EN": "en", "looks like Spanish.": "es", "en-US": "int", "brazilian portuguese": "pt", "Korean": "ko", "zz": "zz", "Unknown": "int", "unclear": "int", "could be french": "int", "Klingon": "int", "english or german": "de"}
    assert one(spark, text.clean_language, *cases) == list(cases.values())


def test_sanitize(spark):
    cases = {None: "unknown", "": "unknown", "happy greeting": "happy_greeting", "..a b//c_.": "a_b_c", "안녕": "unknown", "...": "unknown", "a-b.c": "a-b.c"}
    got = one(spark, text.sanitize_filename, *cases)
    assert got == list(cases.values())
    assert one(spark, text.sanitize_filename, *got) == got


def test_target_and_group_names(spark):
    row = spark.range(1).select(text.target_name(F.lit("Korean"), F.lit(None).cast("string"), F.lit("happy greeting"), F.lit("1@2x.png"))).first()
    assert row[0] == "ko_null_happy_greeting_1@2x.png"
    cases = {"00001_brown_33068@2x.png": "00007_00033068_brown.png", "00001_x.png": "00007_x.png", "x.png": "00007_x.png", "a__b.png": "00007_a_b.png", "00007_x.png": "00007_x.png"}
    assert one(spark, lambda c: text.group_file_name(F.lit("00007"), c), *cases) == list(cases.values())
    assert one(spark, text.delete_me_name, "apng.png") == ["apng_DELETE-ME.png"]


@pytest.mark.parametrize("queue,rate,said", [(0, 1.0, "done"), (10, 2.0, "5m 0s"), (100, 0.4, "4h 10m"), (5, 0.01, "unknown"), (1, 2.0, "30s")])
def test_eta(spark, queue, rate, said):
    assert spark.range(1).select(text.eta_text(text.eta_seconds(F.lit(queue), F.lit(rate)))).first()[0] == said


def test_tokens(spark):
    row = spark.range(1).select(text.token_estimate(F.repeat(F.lit("x"), 1000)).alias("a"), text.base64_length(F.lit(100_000)).alias("b"), text.utf16_length(F.lit("😀")).alias("u"), text.token_estimate(F.lit(None).cast("string")).alias("z"))
    row = row.withColumn("c", text.context_size(F.col("a"), F.lit(0))).withColumn("d", text.context_size(F.col("a"), F.col("b"))).first()
    assert (row.a, row.b, row.u, row.z, row.c, row.d) == (300, 133336, 2, 0, 4000, 43634)


def test_parse_answer(spark):
    good = '{"detectedTags": ["a"], "hasText": true, "textLanguageGuess": %s}'
    cases = [
        ('```json\n{"detectedTags": [" Bear ","bear","CAT"], "hasText": true, "textLanguageGuess": "Korean"}\n```', (["bear", "cat"], True)),
        ('{"detectedTags": []}', None),
        ('{"hasText": true}', None),
        (good % '""', (["a"], False)),
        (good % "null", (["a"], False)),
        (good % '"Unknown script"', (["a"], False)),
        ("  ", None),
        (None, None),
        ('prose {"detectedTags": ["a"]}', None),
        ('{"detectedTags": ["a", null]}', None),
        ('{"detectedTags": "a"}', None),
    ]
    got = one(spark, classify.parse_answer, *[c for c, _ in cases])
    assert [None if g is None else (g.tags, g.hasText) for g in got] == [w for _, w in cases]


def test_json_schema():
    from pyspark.sql import types as T

    said = text.json_schema(T.StructType([T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("ok", T.BooleanType())]))
    assert '"required": ["ok", "tags"]' in said and "2020-12" in said


def filtered(pixels: np.ndarray, kinds: list[int]) -> bytes:
    h, w, b = pixels.shape
    out, above = b"", np.zeros(w * b, int)
    for y in range(h):
        row = pixels[y].astype(int).ravel()
        left = np.r_[np.zeros(b, int), row[:-b]]
        corner = np.r_[np.zeros(b, int), above[:-b]]
        far = left + above - corner
        da, db, dc = abs(far - left), abs(far - above), abs(far - corner)
        guess = {0: 0 * row, 1: left, 2: above, 3: (left + above) // 2, 4: np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, corner))}[kinds[y]]
        out += bytes([kinds[y]]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    return out


def cgbi(pixels: np.ndarray, kinds: list[int], split: bool = False) -> bytes:
    raw = zlib.compressobj(wbits=-15)
    data = raw.compress(filtered(pixels, kinds)) + raw.flush()
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 6 if pixels.shape[2] == 4 else 2, 0, 0, 0)
    idat = [(b"IDAT", data[:5]), (b"IDAT", data[5:])] if split else [(b"IDAT", data)]
    return images.png([(b"CgBI", b"PPPP"), (b"IHDR", head), (b"tEXt", b"a"), *idat, (b"tIME", b"b"), (b"IEND", b"")])


@pytest.mark.parametrize("bands", [3, 4])
@pytest.mark.parametrize("split", [False, True])
def test_cgbi_repair(bands, split):
    rng = np.random.default_rng(bands)
    px = rng.integers(0, 256, (5, 5, bands)).astype(np.uint8)
    if bands == 4:
        px[0, :, 3] = [0, 1, 128, 254, 255]
        px[..., :3] = np.minimum(px[..., :3], px[..., 3:])
    fixed = images.repair_cgbi(cgbi(px, [0, 1, 2, 3, 4], split))
    got = images.decode_png(fixed)
    want = px[..., [2, 1, 0]].astype(int)
    if bands == 4:
        a = px[..., 3:].astype(int)
        want = np.where((a > 0) & (a < 255), np.minimum(255, want * 255 // np.maximum(a, 1)), want)
        assert (got[..., 3] == px[..., 3]).all()
    assert (got[..., :3] == want).all()
    assert [k for k, _ in images.chunks(fixed)] == [b"IHDR", b"tEXt", b"tIME", b"IDAT", b"IEND"]


def test_cgbi_detection_and_errors(spark):
    px = np.full((4, 4, 4), 90, np.uint8)
    bad = images.png([(b"CgBI", b"PPPP"), (b"IHDR", struct.pack(">IIBBBBB", 4, 4, 8, 6, 0, 0, 0)), (b"IDAT", b"\xff\xff"), (b"IEND", b"")])
    rows = [(1, cgbi(px, [0] * 4)), (2, images.repair_cgbi(cgbi(px, [0] * 4))), (3, b"short"), (4, bad), (5, None)]
    df = spark.createDataFrame(rows, "i int, c binary").select("i", images.is_cgbi(F.col("c")).alias("b"), "c")
    assert [r.b for r in df.orderBy("i").collect()] == [True, False, False, True, False]
    errors = df.filter("b").select("i", images.fixed_png("c").alias("r")).orderBy("i").collect()
    assert errors[0].r.error is None and errors[1].r.error and errors[1].r.content is None


def lines_of(values: np.ndarray, depth: int) -> np.ndarray:
    """Packed bytes of rows of samples."""
    h = len(values)
    flat = values.reshape(h, -1).astype(np.int64)
    bits = (flat[..., None] >> np.arange(depth)[::-1] & 1).reshape(h, -1).astype(np.uint8)
    return np.packbits(bits, axis=1)


@pytest.mark.parametrize("colour,depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
@pytest.mark.parametrize("interlace", [0, 1])
def test_every_kind_of_png_is_decoded(colour, depth, interlace):
    rng = np.random.default_rng(depth + colour)
    w, h, n = 11, 9, images.SAMPLES[colour]
    values = rng.integers(0, 1 << depth, (h, w, n))
    raw = b""
    for x, y, dx, dy in images.PASSES if interlace else [(0, 0, 1, 1)]:
        part = values[y::dy, x::dx]
        if part.size:
            packed = lines_of(part, depth)
            bpp = max(1, n * depth // 8)
            padded = np.pad(packed, ((0, 0), (0, -packed.shape[1] % bpp)))
            lines = filtered(padded.reshape(len(padded), -1, bpp), [k % 5 for k in range(len(padded))])
            step = padded.shape[1] + 1
            raw += b"".join(lines[k * step : k * step + packed.shape[1] + 1] for k in range(len(padded)))
    palette = rng.integers(0, 256, (256, 3)).astype(np.uint8)
    alpha = bytes([7, 0])
    extra = [(b"PLTE", palette.tobytes()), (b"tRNS", alpha)] if colour == 3 else [(b"tRNS", values[0, 0].astype(">u2").tobytes())] if colour in (0, 2) else []
    got = images.decode_png(images.png([(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlace)), *extra, (b"IDAT", zlib.compress(raw)), (b"IEND", b"")]))
    if colour == 3:
        want = np.dstack([palette[values[..., 0]], np.where(values[..., 0] == 0, 7, np.where(values[..., 0] == 1, 0, 255))])
    else:
        eight = values >> 8 if depth == 16 else values * 255 // ((1 << depth) - 1)
        rgb = np.repeat(eight[..., :1], 3, axis=2) if colour in (0, 4) else eight[..., :3]
        a = eight[..., -1] if colour in (4, 6) else np.where((values == values[0, 0]).all(axis=-1), 0, 255)
        want = np.dstack([rgb, a])
    assert (got == want).all()


def test_perceptual_hash():
    rng = np.random.default_rng(5)
    blocks = np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8)))
    px = np.dstack([blocks] * 3 + [np.full((64, 64), 255)]).astype(np.uint8)
    bits = lambda a, b: bin((images.perceptual_hash(a) ^ images.perceptual_hash(b)) & (1 << 64) - 1).count("1")
    noisy = px.copy()
    noisy[..., :3] = np.clip(px[..., :3].astype(int) + rng.integers(-3, 4, (64, 64, 1)), 0, 255)
    assert bits(px, px) == 0 and bits(px, noisy) <= 6
    other = np.dstack([rng.integers(0, 256, (64, 64))] * 3 + [np.full((64, 64), 255)]).astype(np.uint8)
    assert bits(px, other) > 16
    clear = noisy.copy()
    clear[..., 3] = 0
    assert images.perceptual_hash(clear) == images.perceptual_hash(np.zeros((8, 8, 4), np.uint8))


@pytest.mark.parametrize(
    "raw,fault",
    [
        (None, "empty"), (" \n", "empty"), ("no idea", "no JSON"), ('{"detectedTags": ["a"', "no JSON"),
        ("null", "no object"), ("[1]", "no object"), ('"a"', "no object"), ("{}", "tags missing"), ('{"detectedTags": null}', "tags null"),
        ('{"detectedTags": "a"}', "tags no list"), ('{"detectedTags": {"a": 1}}', "tags no list"), ('{"detectedTags": []}', "tags empty"),
        ('{"detectedTags": ["a", null]}', "tag null"), ('{"detectedTags": ["a", ["b"]]}', "tag no text"), ('{"detectedTags": [{}]}', "tag no text"),
        ('{"detectedTags": ["a"], "hasText": "maybe"}', "hasText no boolean"), ('{"detectedTags": ["a"], "hasText": [true]}', "hasText no boolean"),
        ('{"detectedTags": ["a"], "emoji": {"x": 1}}', "emoji no text"), ('{"detectedTags": ["a"], "hasText": "True", "keyword": [1]}', "keyword no text"),
        ('{"detectedTags": ["a", 1, true], "hasText": null, "emoji": 5}', None), ('{"detectedTags": ["a"]} and more', None), ('```json\n{"detectedTags": ["a"], "textLanguageGuess": null}\n```', None),
    ],
)
def test_answer_faults(spark, raw, fault):
    got = spark.createDataFrame([(raw,)], "raw string").select(classify.answer_fault(F.col("raw")).alias("fault"), classify.parse_answer(F.col("raw")).alias("a")).first()
    assert got.fault == fault and (fault is not None or got.a is not None)
