"""Tensor and metadata function queries."""

import pandas as pd
from pyspark.sql import functions as F

from kilnset.functions import headers as HD
from kilnset.functions import images as I
from kilnset.functions import pixels
from kilnset.functions import tensors as X
from kilnset.functions.hashing import uniform
from kilnset.operators import batching as B
from kilnset.operators.sampling import permutation
from kilnset.plans.images import HEX, IDX, IMG, images
from kilnset.plans.registry import query, u

SEED = 42


def _hex(n, size, big=False):
    digits = F.lpad(F.hex(n), 2 * size, "0")
    if big:
        return digits
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])


@query("image_headers", "C5", """
select doc_id, case doc_id % 8 when 0 then 'GIF' when 1 then 'PNG' when 2 then 'PNG' when 3 then 'BMP' when 4 then 'BMP' when 5 then 'ICO' when 6 then 'JPEG' end as type,
  case when doc_id % 8 = 7 then null when doc_id % 8 = 5 then w % 200 else w end as width,
  case when doc_id % 8 = 7 then null when doc_id % 8 = 5 then h % 200 else h end as height, case when doc_id % 8 = 7 then 'unknown' else 'ok' end as status
from (select doc_id, n_chars % 3000 + 1 as w, (n_chars // 3) % 2000 + 1 as h from documents)""")
def image_headers(t):
    rows = t.documents.select("doc_id", (F.col("n_chars") % 3000 + 1).alias("w"), (F.floor(F.col("n_chars") / 3) % 2000 + 1).alias("h"))
    w, h = F.col("w"), F.col("h")
    zeros = lambda n: F.lit("00" * n)
    kinds = [
        F.concat(F.lit("474946383961"), _hex(w, 2), _hex(h, 2)),
        F.concat(F.lit("89504E470D0A1A0A"), zeros(4), F.lit("49484452"), _hex(w, 4, True), _hex(h, 4, True)),
        F.concat(F.lit("89504E470D0A1A0A"), _hex(w, 4, True), _hex(h, 4, True)),
        F.concat(F.lit("424D"), zeros(12), _hex(F.lit(12), 4), _hex(w, 2), _hex(h, 2), zeros(4)),
        F.concat(F.lit("424D"), zeros(12), _hex(F.lit(40), 4), _hex(w, 4), _hex(F.lit(2**32) - h, 4), zeros(4)),
        F.concat(F.lit("000001000100"), _hex(w % 200, 1), _hex(h % 200, 1)),
        F.concat(F.lit("FFD8FFE00004AABBFFC0000B08"), _hex(h, 2, True), _hex(w, 2, True), zeros(6)),
        F.lit("0102030405060708090A"),
    ]
    body = kinds[-1]
    for i, k in enumerate(kinds[:-1]):
        body = F.when(F.col("doc_id") % 8 == i, k).otherwise(body)
    files = rows.select("doc_id", F.unhex(body).alias("content"))
    return files.select("doc_id", HD.image_header(F.col("content")).alias("m")).select("doc_id", "m.*")


SM = "[x::double for x in embedding]"


@query("softmax_vectors", "C10", f"""
with p as (select vec_id, label, {SM} as z from embeddings), e as (select *, [exp(x - list_max(z)) for x in z] as w from p)
select vec_id, list_position(z, list_max(z))::int - 1 as best, round(w[1] / list_sum(w), 9) as first, round(list_sum([w[i] / list_sum(w) * i for i in range(1, 65)]), 6) as checksum,
  array_to_string([case when i = label then 1 else 0 end for i in range(0, 10)], ',') as hot from e""")
def softmax_vectors(t):
    z = X.doubles(F.col("embedding"))
    rows = t.embeddings.select("vec_id", "label", z.alias("z"), X.softmax(z).alias("p"))
    hot = X.join_numbers(F.transform(X.one_hot(F.col("label"), 10), lambda x: x.cast("int")))
    return rows.select("vec_id", X.argmax(F.col("z")).alias("best"), F.round(F.get("p", F.lit(0)), 9).alias("first"),
                       F.round(X.weighted_checksum(F.col("p")), 6).alias("checksum"), hot.alias("hot"))


@query("normalised_images", "C11", f"""
with {IMG} select vec_id, round(list_sum([(px[k+1] / 255.0::double - [0.485, 0.456, 0.406][k % 3 + 1]::double) / [0.229, 0.224, 0.225][k % 3 + 1]::double * (k + 1) {IDX}), 5) as checksum from img""")
def normalised_images(t):
    stats = X.CHANNEL_STATS["imagenet"]
    rows = I.map_images(images(t), "checksum", "double", lambda img: I.weighted(I.tensor(img, stats)))
    return rows.select("vec_id", F.round("checksum", 5).alias("checksum"))


@query("channel_layout", "C12", f"""
with {IMG} select vec_id, {HEX.format('[px[(k % 64) * 3 + k // 64 + 1] ' + IDX)} as chw, {HEX.format('px')} as back from img""")
def channel_layout(t):
    rows = I.hwc_to_chw(images(t), "chw")
    return I.chw_to_hwc(rows, "back", "chw").select("vec_id", F.lower(F.hex("chw")).alias("chw"), F.lower(F.hex("back")).alias("back"))


@query("standardised_signals", "C13", """
with m as (select vec_id, [sqrt(abs(x::double)) for x in embedding] as a from embeddings), n as (select *, list_sum(a) / 64 as mu from m),
s as (select *, sqrt(list_sum([(x - mu) * (x - mu) for x in a]) / 63) as sd from n)
select vec_id, round(list_sum([(a[i] - mu) / sd * i for i in range(1, 51)]), 6) as cut, round(list_sum([(a[i] - mu) / sd * i for i in range(1, 65)]), 6) as padded, 80 as width from s""")
def standardised_signals(t):
    ready = X.standardise(F.transform("embedding", lambda x: F.sqrt(F.abs(x.cast("double")))))
    rows = t.embeddings.select("vec_id", ready.alias("a"))
    padded = X.fit_length(F.col("a"), 80)
    return rows.select("vec_id", F.round(X.weighted_checksum(X.fit_length(F.col("a"), 50)), 6).alias("cut"),
                       F.round(X.weighted_checksum(padded), 6).alias("padded"), F.size(padded).alias("width"))


@query("signal_spectrogram", "C13", None)
def signal_spectrogram(t):
    long = F.flatten(F.array_repeat(X.doubles(F.col("embedding")), 8))
    stft = X.stft_magnitude(200, 80, 256)
    return t.embeddings.select("vec_id", stft(long).alias("s")).select(
        "vec_id", F.size("s").alias("cells"), F.round(X.total(F.col("s")), 5).alias("total"))


DFT = "sqrt(pow(list_sum([embedding[n + 1]::double * cos(2 * pi() * {k} * n / 64) for n in range(0, 64)]), 2) + pow(list_sum([embedding[n + 1]::double * sin(2 * pi() * {k} * n / 64) for n in range(0, 64)]), 2))"


@query("half_spectrum", "C14", f"""
select vec_id, 32 as width, round({DFT.format(k=1)}, 6) as k1, round({DFT.format(k=7)}, 6) as k7, round({DFT.format(k=31)}, 6) as k31 from embeddings""")
def half_spectrum(t):
    rows = t.embeddings.select("vec_id", X.half_spectrum(X.doubles(F.col("embedding"))).alias("s"))
    at = lambda k: F.round(F.get("s", F.lit(k)), 6).alias(f"k{k}")
    return rows.select("vec_id", F.size("s").alias("width"), at(1), at(7), at(31))


@query("blended_images", "C15", f"""
with {IMG} select vec_id, {HEX.format('[cast(trunc(least(greatest(px[k+1] + 1.6::double * (px[192 - k] - px[k+1]), 0), 255)) as int) ' + IDX)} as outside,
  {HEX.format('[cast(trunc(px[k+1] + 0.25::double * (px[192 - k] - px[k+1])) as int) ' + IDX)} as between_ from img""")
def blended_images(t):
    rows = images(t)
    for name, factor in (("outside", 1.6), ("between_", 0.25)):
        rows = I.map_images(rows, name, "binary", lambda img, f=factor: pixels.blend(img, img[::-1, ::-1, ::-1], f).tobytes())
    return rows.select("vec_id", *[F.lower(F.hex(x)).alias(x) for x in ("outside", "between_")])


DEC_PERM = f"row_number() over (order by {u('perm', SEED, 0, 'vec_id')}, vec_id) - 1"


@query("decode_transform_collate", "I30 B4 F8", f"""
with {IMG}, p as (select vec_id, label, {DEC_PERM} as pos, list_sum([(px[k+1] / 255.0::double - [0.485, 0.456, 0.406][k % 3 + 1]::double) / [0.229, 0.224, 0.225][k % 3 + 1]::double * (k + 1) {IDX}) as s,
  {HEX.format('[255 - x for x in px]')} as inv from img)
select pos // 16 as batch_id, count(*) as size, string_agg(cast(label as varchar), ',' order by pos) as labels, md5(string_agg(inv, '' order by pos)) as pixels_md5 from p group by 1""")
def decode_transform_collate(t):
    # BMP files: 54-byte header, then rows bottom up in blue-green-red order
    head = bytes.fromhex("424D" + "00" * 8 + "36000000" + "28000000" + "08000000" + "08000000" + "01001800" + "00" * 24)
    files = I.map_images(images(t), "content", "binary", lambda img: head + img[::-1, :, ::-1].tobytes()).drop("px")
    decoded = I.run(files.withColumn("px", HD.decode_bmp(F.col("content"))).drop("content"), [I.step("invert")])
    batches = B.fixed_batches(permutation(decoded, "vec_id", SEED, total="n"), 16)
    stacked = B.collate(batches, ["batch_id"], "pos_in_batch", ["px", "label"])
    pixels_hex = F.array_join(F.transform("px", lambda x: F.lower(F.hex(x))), "")
    return stacked.select("batch_id", "size", X.join_numbers(F.col("label")).alias("labels"), F.md5(pixels_hex).alias("pixels_md5"))


@query("stage_timings", "X2", None)
def stage_timings(t):
    """Rows and seconds per transform step, timed inside the tasks."""
    import time

    steps = [("lower", lambda s: s.str.lower()), ("length", lambda s: s.str.len())]

    def timed(batches):
        for pdf in batches:
            values, rows = pdf["text"], []
            for name, fn in steps:
                begin = time.perf_counter()
                values = fn(values)
                rows.append((name, len(values), time.perf_counter() - begin))
            yield pd.DataFrame(rows, columns=["stage", "n", "seconds"])

    out = t.documents.select("text").mapInPandas(timed, "stage string, n long, seconds double")
    return out.groupBy("stage").agg(F.sum("n").alias("n"), (F.sum("seconds") >= 0).alias("timed"))


@query("worker_init_rows", "X5", None)
def worker_init_rows(t):
    """Per-task set-up and task identity; draws still come from the key."""

    def run(batches):
        from pyspark import TaskContext

        worker = TaskContext.get().partitionId()
        for pdf in batches:
            yield pdf.assign(worker=worker)

    rows = t.orders.select("o_orderkey", uniform("x", SEED, 0, "o_orderkey").alias("draw"))
    return rows.mapInPandas(run, "o_orderkey long, draw double, worker int").groupBy("worker").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("draw"), 6).alias("draws"))
