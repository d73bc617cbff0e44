"""Image queries: every vector becomes an 8 x 8 colour image (or a larger one)."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kilnset.functions import images as I
from kilnset.functions.hashing import gaussian, uniform
from kilnset.functions.tensors import CHANNEL_STATS
from kilnset.plans.registry import query, u

SEED = 42
H = W = 8
C = 3
Q = "least(greatest(cast(floor((embedding[{i}]::double + 0.6) / 1.2 * 256) as int), 0), 255)"
QUANTA = f"(select vec_id, label, [{Q.format(i='i')} for i in range(1, 65)] as q from embeddings)"
IMG = f"img as (select vec_id, label, [q[(k // 3 + 21 * (k % 3)) % 64 + 1] for k in range(0, 192)] as px from {QUANTA})"
HEX = "array_to_string([printf('%02x', p) for p in {}], '')"
OUT = HEX + " as pixels"


def _cells(side: int) -> tuple[np.ndarray, np.ndarray]:
    """Which value of a vector each pixel of a ``side`` image takes, and what is
    added to it: larger images repeat a value in a block, with a ramp."""
    y, x, ch = np.indices((side, side, 3))
    block = side // 8
    place = ((y // block) * 8 + x // block + 21 * ch) % 64
    return place.ravel(), ((9 * (x % block) + 5 * (y % block)) % 256).astype(np.uint8).ravel()


#: Bytes of pixels that are laid out at once.
PIECE_BYTES = 1 << 20


def _laid_out(place, ramp):
    rows = max(1, PIECE_BYTES // len(place))

    def run(batches):
        for whole in batches:
            for begin in range(0, len(whole), rows):
                batch = whole.slice(begin, rows)
                values = batch["embedding"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1)
                q = np.clip(np.floor((values + 0.6) / 1.2 * 256), 0, 255).astype(np.uint8)
                px = np.ascontiguousarray(q[:, place] + ramp)  # bytes: modulo 256
                ends = np.arange(len(batch) + 1, dtype=np.int32) * px.shape[1]
                raw = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(px)])
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], raw], ["vec_id", "label", "px"])
    return run


def images(t, side: int = 8):
    rows = t.embeddings.select("vec_id", "label", "embedding")
    kinds = dict(rows.dtypes)
    laid = rows.mapInArrow(_laid_out(*_cells(side)), f"vec_id {kinds['vec_id']}, label {kinds['label']}, px binary")
    return laid.withColumn("h", F.lit(side)).withColumn("w", F.lit(side))


def draw(tag):
    return uniform(tag, SEED, 0, "vec_id")


def ud(tag):
    return u(tag, SEED, 0, "vec_id")


def show(df, px="px"):
    return df.select("vec_id", F.lower(F.hex(px)).alias("pixels"))


def register(name, covers, expr, steps, pre=""):
    """One pixel query: SQL list expression over ``px`` and the steps in Spark."""

    @query(name, covers, f"with {IMG}{pre} select vec_id, {OUT.format(expr)} from {'pre' if pre else 'img'}")
    def run(t):
        return show(I.run(images(t), steps()))

    return run


IDX = "for k in range(0, 192)]"
# x, y and channel of flat index k
XX, YY, CH = "((k // 3) % 8)", "(k // 24)", "(k % 3)"


def gathered(sx, sy, fill="0"):
    return (f"[case when {sx} >= 0 and {sx} < 8 and {sy} >= 0 and {sy} < 8 "
            f"then px[(({sy}) * 8 + ({sx})) * 3 + {CH} + 1] else {fill} end {IDX}")


def fl(x):
    return f"cast(floor({x}) as int)"


def blended(a, b, f):
    return f"[cast(trunc(least(greatest({a} + ({f}) * ({b} - {a}), 0.0), 255.0)) as int) {IDX}"


register("invert_images", "I1", "[255 - p for p in px]", lambda: [I.step("invert")])
register("solarize_images", "I2", "[case when p < 110 then p else 255 - p end for p in px]", lambda: [I.step("solarize", 110)])
register("solarize_add_images", "I3", "[case when least(p + 40, 255) < 128 then least(p + 40, 255) else 255 - least(p + 40, 255) end for p in px]",
         lambda: [I.step("solarize_add", 40)])
register("solarize_add_below_images", "I3", "[case when p < 128 then least(p + 40, 255) else p end for p in px]",
         lambda: [I.step("solarize_add_below", 40)])
register("posterize_images", "I4", "[(p >> 3) << 3 for p in px]", lambda: [I.step("posterize", 5)])
register("posterize_clamped_images", "I4", "[(p >> 7) << 7 for p in px]", lambda: [I.step("posterize", 0, 1)])
register("brightness_images", "I5", blended("0.0::double", "px[k + 1]", "1.3::double"), lambda: [I.step("brightness", 1.3)])
LUMA = "[(px[3*j+1] * 19595 + px[3*j+2] * 38470 + px[3*j+3] * 7471 + 32768) >> 16 for j in range(0, 64)]"
register("contrast_images", "I6", blended("m::double", "px[k + 1]", "0.6::double"), lambda: [I.step("contrast", 0.6)],
         f", pre as (select vec_id, px, floor(list_sum({LUMA}) / 64.0::double + 0.5) as m from img)")
register("contrast_count_images", "I6", blended("0.0::double", "px[k + 1]", "1.5::double"), lambda: [I.step("contrast_count", 1.5)])
register("colour_images", "I7", blended("g[k // 3 + 1]::double", "px[k + 1]", "0.4::double"), lambda: [I.step("colour", 0.4)],
         f", pre as (select vec_id, px, {LUMA} as g from img)")
SMOOTH = ("[case when " + f"{XX} in (0, 7) or {YY} in (0, 7)" + " then px[k + 1] else cast(floor(("
          + " + ".join(f"{5 if dx == dy == 0 else 1} * px[k + 1 + {(dy * 8 + dx) * 3}]" for dy in (-1, 0, 1) for dx in (-1, 0, 1))
          + ") / 13.0::double + 0.5) as int) end " + IDX)
register("sharpness_images", "I8", blended("s[k + 1]::double", "px[k + 1]", "1.7::double"), lambda: [I.step("sharpness", 1.7)],
         f", pre as (select vec_id, px, {SMOOTH} as s from img)")
CHANS = "[[px[3*j+1+c] for j in range(0, 64)] for c in range(0, 3)]"
register("autocontrast_images", "I9",
         f"[case when hi[{CH}+1] > lo[{CH}+1] then cast(trunc(least(greatest(px[k+1] * (255.0::double / (hi[{CH}+1] - lo[{CH}+1])) - lo[{CH}+1] * (255.0::double / (hi[{CH}+1] - lo[{CH}+1])), 0.0), 255.0)) as int) else px[k+1] end {IDX}",
         lambda: [I.step("autocontrast")],
         f", pre as (select vec_id, px, [list_min(x) for x in {CHANS}] as lo, [list_max(x) for x in {CHANS}] as hi from img)")
register("rotate_images", "I14", gathered(fl(f"co * ({XX} + 0.5) + si * ({YY} + 0.5) + (4.0 - co * 4.0 - si * 4.0)"),
                                         fl(f"-si * ({XX} + 0.5) + co * ({YY} + 0.5) + (4.0 + si * 4.0 - co * 4.0)")),
         lambda: [I.step("rotate", *I.angle(17.0))],
         ", pre as (select vec_id, px, round(cos(-radians(17.0::double)), 15) as co, round(sin(-radians(17.0::double)), 15) as si from img)")
SGN = "(case when {} < 0.5 then -1.0::double else 1.0::double end)"


def _sign(tag):
    return F.when(draw(tag) < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))


register("shear_x_images", "I11", gathered(fl(f"{XX} + 0.5 + v * ({YY} + 0.5)"), YY), lambda: [I.step("shear_x", _sign("shx") * 0.25)],
         f", pre as (select *, {SGN.format(ud('shx'))} * 0.25::double as v from img)")
register("shear_y_images", "I11", gathered(XX, fl(f"v * ({XX} + 0.5) + {YY} + 0.5")), lambda: [I.step("shear_y", _sign("shy") * 0.2)],
         f", pre as (select *, {SGN.format(ud('shy'))} * 0.2::double as v from img)")
register("translate_x_relative_images", "I12", gathered(fl(f"{XX} + 0.5 + v"), YY), lambda: [I.step("translate_x", _sign("trx") * 0.3 * W)],
         f", pre as (select *, {SGN.format(ud('trx'))} * 0.3::double * 8 as v from img)")
register("translate_y_relative_images", "I12", gathered(XX, fl(f"{YY} + 0.5 + v")), lambda: [I.step("translate_y", _sign("try") * 0.4 * H)],
         f", pre as (select *, {SGN.format(ud('try'))} * 0.4::double * 8 as v from img)")
register("translate_x_pixels_images", "I13", gathered(fl(f"{XX} + 0.5 + v"), YY), lambda: [I.step("translate_x", _sign("tra") * 3.0)],
         f", pre as (select *, {SGN.format(ud('tra'))} * 3.0::double as v from img)")
register("translate_y_pixels_images", "I13", gathered(XX, fl(f"{YY} + 0.5 + v")), lambda: [I.step("translate_y", _sign("trb") * 2.0)],
         f", pre as (select *, {SGN.format(ud('trb'))} * 2.0::double as v from img)")
register("random_flip_images", "I15", f"case when {ud('flip')} < 0.5 then {gathered(f'(7 - {XX})', YY)} else px end",
         lambda: [I.when(draw("flip") < 0.5, I.step("flip"))])
MEAN = "[125, 123, 114][k % 3 + 1]"


def boxed(x0, y0, x1, y1, fill, keep="px[k + 1]"):
    return f"[case when {XX} >= {x0} and {XX} <= {x1} and {YY} >= {y0} and {YY} <= {y1} then {fill} else {keep} end {IDX}"


CUT = (f", c as (select *, floor(greatest({ud('cx')} * 8 - v / 2, 0)) as x0, floor(greatest({ud('cy')} * 8 - v / 2, 0)) as y0 from (select *, {{v}} as v from img)),"
       " pre as (select *, floor(least(8, x0 + v)) as x1, floor(least(8, y0 + v)) as y1 from c)")
register("cutout_images", "I16", boxed("x0", "y0", "x1", "y1", MEAN), lambda: [I.step("cutout", 0.2, draw("cx"), draw("cy"), fill=I.MEAN_FILL)],
         CUT.format(v="0.2::double * 8"))
register("cutout_pixels_images", "I16", boxed("x0", "y0", "x1", "y1", "0"), lambda: [I.step("cutout_pixels", 3.0, draw("cx"), draw("cy"), fill=I.BLACK_FILL)],
         CUT.format(v="3.0::double"))
register("cutout_clipped_images", "I17", boxed("x0", "y0", "x1", "y1", MEAN), lambda: [I.step("cutout_clipped", 4, draw("cx"), draw("cy"), fill=I.MEAN_FILL)],
         f", pre as (select *, floor(least(greatest({ud('cx')} * 8 - 2, 0), 8)) as x0, floor(least(greatest({ud('cy')} * 8 - 2, 0), 8)) as y0,"
         f" floor(least(greatest({ud('cx')} * 8 + 2, 0), 8)) as x1, floor(least(greatest({ud('cy')} * 8 + 2, 0), 8)) as y1 from img)")
register("cutout_replace_images", "I19", boxed("cx - 2", "cy - 2", "cx + 1", "cy + 1", "128"),
         lambda: [I.step("cutout_square", 2, draw("cx"), draw("cy"), fill=I.GREY_FILL)],
         f", pre as (select *, floor({ud('cx')} * 8) as cx, floor({ud('cy')} * 8) as cy from img)")


@query("cutout_tensors", "I18 C11", f"""
with {IMG}, pre as (select *, floor({ud('cx')} * 8) as cx, floor({ud('cy')} * 8) as cy from img)
select vec_id, round(list_sum([case when {XX} >= cx - 2 and {XX} < cx + 2 and {YY} >= cy - 2 and {YY} < cy + 2 then 0
  else (px[k + 1] / 255.0::double - [0.4914, 0.4822, 0.4465][{CH} + 1]::double) / [0.2023, 0.1994, 0.2010][{CH} + 1]::double end * (k + 1) {IDX}), 5) as checksum from pre""")
def cutout_tensors(t):
    def cut(img, cx, cy):
        x = I.tensor(img, CHANNEL_STATS["cifar"])
        x[max(cy - 2, 0):cy + 2, max(cx - 2, 0):cx + 2] = 0.0
        return I.weighted(x)

    rows = images(t).select("*", F.floor(draw("cx") * W).alias("cx"), F.floor(draw("cy") * H).alias("cy"))
    return I.map_images(rows, "checksum", "double", cut, ("cx", "cy")).select("vec_id", F.round("checksum", 5).alias("checksum"))


register("pad_crop_images", "I20", gathered(f"({XX} + ox - 2)", f"({YY} + oy - 2)", MEAN),
         lambda: [I.step("pad_and_crop", 2, F.floor(draw("ox") * 5), F.floor(draw("oy") * 5), fill=I.MEAN_FILL)],
         f", pre as (select *, cast(floor({ud('ox')} * 5) as int) as ox, cast(floor({ud('oy')} * 5) as int) as oy from img)")
register("random_crop_images", "I20", gathered(f"({XX} + ox - 4)", f"({YY} + oy - 4)", "0"),
         lambda: [I.step("pad_and_crop", 4, F.floor(draw("ox") * 9), F.floor(draw("oy") * 9))],
         f", pre as (select *, cast(floor({ud('ox')} * 9) as int) as ox, cast(floor({ud('oy')} * 9) as int) as oy from img)")
register("padded_images", "I25",
         "[case when (k // 3) % 11 - 2 between 0 and 7 and k // 33 - 1 between 0 and 7 then px[((k // 33 - 1) * 8 + (k // 3) % 11 - 2) * 3 + k % 3 + 1] else 7 end for k in range(0, 330)]",
         lambda: [I.step("pad", 2, 1, 1, 1, fill=7)])
register("edge_padded_images", "I25",
         "[px[(least(greatest(k // 33 - 1, 0), 7) * 8 + least(greatest((k // 3) % 11 - 2, 0), 7)) * 3 + k % 3 + 1] for k in range(0, 330)]",
         lambda: [I.step("pad_edge", 2, 1, 1, 1)])
register("cut_by_negative_pad_images", "I25",
         "[px[((k // 15 + 1) * 8 + (k // 3) % 5 + 2) * 3 + k % 3 + 1] for k in range(0, 105)]",
         lambda: [I.step("pad", -2, -1, -1, 0)])
register("centre_crop_images", "I23", "[px[((k // 15 + 2) * 8 + (k // 3) % 5 + 2) * 3 + k % 3 + 1] for k in range(0, 75)]",
         lambda: [I.step("centre_crop", 5, 5)])
register("centre_crop_padded_images", "I23",
         "[case when (k // 3) % 11 - 1 between 0 and 7 and k // 33 - 1 between 0 and 7 then px[((k // 33 - 1) * 8 + (k // 3) % 11 - 1) * 3 + k % 3 + 1] else 0 end for k in range(0, 363)]",
         lambda: [I.step("centre_crop", 11, 11)])
register("affine_replace_images", "I28", gathered(fl(f"{XX} + 0.5 + v * ({YY} + 0.5)"), YY, "128"),
         lambda: [I.step("shear_x", _sign("shx") * 0.3, fill=I.GREY_FILL)],
         f", pre as (select *, {SGN.format(ud('shx'))} * 0.3::double as v from img)")
register("identity_images", "I29", "px", lambda: [])



@query("equalize_images", "I10", f"""
with {IMG}, p as (select vec_id, k, k % 3 as ch, (px[k % 192 + 1] + 9 * (k // 192)) % 256 as v from img, (select unnest(range(0, 1536)) as k)),
r as (select *, rank() over (partition by vec_id, ch order by v) - 1 as below, max(v) over (partition by vec_id, ch) as top from p),
s as (select *, max(case when v = top then below end) over (partition by vec_id, ch) // 255 as step from r)
select vec_id, string_agg(printf('%02x', case when step = 0 then v else least((step // 2 + below) // greatest(step, 1), 255) end), '' order by k) as pixels
from s group by 1""")
def equalize_images(t):
    # eight images below each other, each lighter than the one above
    def stack(img):
        return np.concatenate([(img.astype(np.int64) + 9 * k) % 256 for k in range(8)]).astype(np.uint8).tobytes()

    tall = I.map_images(images(t), "tall", "binary", stack).select("vec_id", F.col("tall").alias("px"), F.lit(8 * H).alias("h"), "w")
    return show(I.run(tall, [I.step("equalize")]))


@query("pca_lighting", "I26", f"""
with {IMG},
g as (select vec_id, px, [0.1::double * sqrt(-2.0::double * ln(1 - a1[i])) * cos(2 * pi() * a2[i]) for i in range(1, 4)] as al from
  (select vec_id, px, [{ud('ga0')}, {ud('ga1')}, {ud('ga2')}] as a1, [{ud('gb0')}, {ud('gb1')}, {ud('gb2')}] as a2 from img)),
r as (select vec_id, px, [-0.5675::double*0.2175*al[1] + 0.7192::double*0.0188*al[2] + 0.4009::double*0.0045*al[3],
  -0.5808::double*0.2175*al[1] - 0.0045::double*0.0188*al[2] - 0.8140::double*0.0045*al[3],
  -0.5836::double*0.2175*al[1] - 0.6948::double*0.0188*al[2] + 0.4203::double*0.0045*al[3]] as sh from g)
select vec_id, round(sh[1], 9) as red, round(sh[3], 9) as blue,
  round(list_sum([(px[k+1] / 255.0::double + sh[{CH}+1]) * (k + 1) {IDX}), 5) as checksum from r""")
def pca_lighting(t):
    shift = I.colour_shift([F.lit(0.1) * gaussian(draw(f"ga{k}"), draw(f"gb{k}")) for k in range(3)])
    rows = images(t).withColumns({f"s{k}": shift[k] for k in range(3)})
    lit = I.map_images(rows, "checksum", "double", lambda img, *s: I.weighted(img / 255.0 + np.array(s)), ("s0", "s1", "s2"))
    return lit.select("vec_id", F.round("s0", 9).alias("red"), F.round("s2", 9).alias("blue"), F.round("checksum", 5).alias("checksum"))


def _jit(tag):
    return F.lit(0.6) + draw(tag) * 0.8


def _bl(a, f, p="p"):
    return f"cast(trunc(least(greatest({a} + ({f}) * ({p} - {a}), 0.0), 255.0)) as int)"


def _jitter_sql():
    fb, fc, fs = (f"(0.6::double + {ud(x)} * 0.8::double)" for x in ("jb", "jc", "js"))
    luma = "[({0}[3*j+1] * 19595 + {0}[3*j+2] * 38470 + {0}[3*j+3] * 7471 + 32768) >> 16 for j in range(0, 64)]"
    steps = {
        0: lambda src: f"[{_bl('0.0::double', 'fb', src + '[k+1]')} {IDX}",
        1: lambda src: f"[{_bl('floor(list_sum(' + luma.format(src) + ') / 64.0::double + 0.5)', 'fc', src + '[k+1]')} {IDX}",
        2: lambda src: f"[{_bl('(' + luma.format(src) + ')[k // 3 + 1]::double', 'fs', src + '[k+1]')} {IDX}",
    }
    out = f"with {IMG}, f as (select vec_id, px, {fb} as fb, {fc} as fc, {fs} as fs, cast(floor({ud('jo')} * 3) as int) as o from img)"
    prev = "f"
    for k in range(3):
        src = "px" if k == 0 else "p"
        case = "case o " + " ".join(f"when {o} then {steps[(o + k) % 3](src)}" for o in range(3)) + " end"
        out += f", s{k} as (select vec_id, fb, fc, fs, o, {case} as p from {prev})"
        prev = f"s{k}"
    return out + " select vec_id, " + OUT.format("p") + " from s2"


@query("colour_jitter", "I27", _jitter_sql())
def colour_jitter(t):
    return show(I.run(images(t), [I.step("colour_jitter", _jit("jb"), _jit("jc"), _jit("js"), F.floor(draw("jo") * 3))]))


DOCSHAPE = "s as (select doc_id, cast(n_chars % 300 + 40 as int) as w, cast((n_chars // 7) % 260 + 50 as int) as h from documents)"


def _shapes(t):
    return t.documents.select("doc_id", (F.col("n_chars") % 300 + 40).cast("int").alias("w"),
                              (F.floor(F.col("n_chars") / 7) % 260 + 50).cast("int").alias("h"))


def _doc_draw(name, k):
    return uniform(f"{name}{k}", SEED, 0, "doc_id")


def _try_sql(k):
    d = lambda n: u(f"{n}{k}", SEED, 0, "doc_id")
    return (f"t{k} as (select *, round_even(sqrt(ta * asp), 0) as bw, round_even(sqrt(ta / asp), 0) as bh, {d('left')} as ul, {d('top')} as ut from "
            f"(select doc_id, w, h, w::double * h * ({d('area')} * (1.0::double - 0.08::double) + 0.08::double) as ta, "
            f"exp({d('ratio')} * (ln(4.0::double/3) - ln(0.75::double)) + ln(0.75::double)) as asp from s)),"
            f"v{k} as (select doc_id, {k} as k, floor(ul * (w - bw + 1)) as l, floor(ut * (h - bh + 1)) as t, bw, bh from t{k} where bw > 0 and bw <= w and bh > 0 and bh <= h)")


@query("random_resized_boxes", "I21", f"""
with {DOCSHAPE}, {', '.join(_try_sql(k) for k in range(10))},
a as ({' union all '.join(f'select * from v{k}' for k in range(10))}),
b as (select * from (select *, row_number() over (partition by doc_id order by k) as rn from a) where rn = 1),
f as (select *, case when w / h > 4.0::double/3 then cast(round_even(h * (4.0::double/3), 0) as int) else w end as fw,
  case when w / h < 0.75::double then cast(round_even(w / 0.75::double, 0) as int) else h end as fh from s)
select doc_id, cast(coalesce(l, (w - fw) // 2) as int) as box_left, cast(coalesce(t, (h - fh) // 2) as int) as box_top,
  cast(coalesce(bw, fw) as int) as box_w, cast(coalesce(bh, fh) as int) as box_h from f left join b using (doc_id)""")
def random_resized_boxes(t):
    box = I.random_resized_box(F.col("h"), F.col("w"), _doc_draw)
    return _shapes(t).select("doc_id", box.alias("b")).select(
        "doc_id", *[F.col(f"b.{x}").alias(f"box_{x}") for x in ("left", "top", "w", "h")])


def _cover_sql(k):
    d = lambda n: u(f"{n}{k}", SEED, 0, "doc_id")
    return f"""c{k} as (select doc_id, {k} as k, w, h, bw, bh, floor({d('left')} * (w - bw + 1)) as l, floor({d('top')} * (h - bh + 1)) as t from (
  select *, round_even(bh * asp, 0) as bw from (
  select *, round_even({d('height')} * (most - least(lo, most)) + least(lo, most), 0) as bh from (
  select *, least(case when mx * asp > w then case when fit * asp > w then fit - 1 else fit end else mx end, h)::double as most from (
  select *, round_even(sqrt(w * h * 0.08::double / asp), 0) as lo, round_even(sqrt(w * h::double / asp), 0) as mx, floor((w + 0.5 - 1e-7) / asp) as fit from (
  select doc_id, w, h, {d('aspect')} * (4.0::double/3 - 0.75::double) + 0.75::double as asp from s)))))
  where bw * bh >= w * h * 0.08::double and bw * bh <= w * h and bw <= w and bh <= h and bw * bh >= w * h * 0.1::double)"""


@query("covered_crop_boxes", "I22 I23", f"""
with {DOCSHAPE}, {', '.join(_cover_sql(k) for k in range(10))},
a as ({' union all '.join(f'select * from c{k}' for k in range(10))}),
b as (select doc_id, l, t, bw, bh, bw = w and bh = h as whole from (select *, row_number() over (partition by doc_id order by k) as rn from a) where rn = 1),
z as (select doc_id, w, h, least(h, w) * (224.0::double / 256) as side from s),
y as (select *, cast(round_even((w - side) / 2, 0) as int) as zl, cast(round_even((h - side) / 2, 0) as int) as zt from z),
x as (select *, cast(round_even(zl + side, 0) as int) - zl as zw, cast(round_even(zt + side, 0) as int) - zt as zh from y)
select doc_id, cast(case when l is null or whole then zl else l end as int) as box_left, cast(case when l is null or whole then zt else t end as int) as box_top,
  cast(case when l is null or whole then zw else bw end as int) as box_w, cast(case when l is null or whole then zh else bh end as int) as box_h
from x left join b using (doc_id)""")
def covered_crop_boxes(t):
    box = I.covered_box(F.col("h"), F.col("w"), _doc_draw, 224)
    return _shapes(t).select("doc_id", box.alias("b")).select(
        "doc_id", *[F.col(f"b.{x}").alias(f"box_{x}") for x in ("left", "top", "w", "h")])


@query("short_side_sizes", "I24", f"""
with {DOCSHAPE} select doc_id, case when w <= h then cast(h * 256 // w as int) else 256 end as out_h,
  case when w <= h then 256 else cast(w * 256 // h as int) end as out_w from s""")
def short_side_sizes(t):
    out_h, out_w = I.short_side_size(F.col("h"), F.col("w"), 256)
    return _shapes(t).select("doc_id", out_h.alias("out_h"), out_w.alias("out_w"))


def _cubic_sql(start, length, size, out):
    """Rows (o, i, m): the separable bicubic weights of output ``o`` on input ``i``."""
    return f"""
  select o, i, (case when d < 1 then (1.5::double * d - 2.5) * d * d + 1 else ((-0.5::double * d + 2.5) * d - 4) * d + 2 end) as raw from (
  select o, i, abs((i + 0.5::double - ({start} + (o + 0.5::double) * ({length} / {out}.0::double))) / greatest({length} / {out}.0::double, 1.0)) as d
  from (select unnest(range(0, {out})) as o), (select unnest(range(0, {size})) as i)) where d < 2"""


def _resize_sql(source, out):
    """Rows first, then columns, rounded after each: ``source`` gives vec_id, px, l,
    t, bw, bh; the weights of a direction are a relation over (start, length)."""
    def weights(name, start, length, size):
        return (f"{name} as (select {start}, {length}, o, i, raw / sum(raw) over (partition by {start}, {length}, o) as m from "
                f"(select distinct {start}::double as {start}, {length}::double as {length} from src), lateral ({_cubic_sql(start, length, size, out)}) z)")

    value = "least(greatest(floor(round(sum(v * m), 9) + 0.5), 0), 255)"
    return f"""{source}, {weights('wx', 'l', 'bw', W)}, {weights('wy', 't', 'bh', H)},
p as (select vec_id, l, t, bw, bh, k // {3 * W} as y, (k // 3) % {W} as x, k % 3 as ch, px[k + 1] as v from src, (select unnest(range(0, {3 * W * H})) as k)),
a as (select vec_id, t, bh, y, ch, wx.o as ox, {value} as v from p join wx on wx.l = p.l and wx.bw = p.bw and wx.i = p.x group by all),
b as (select vec_id, ch, ox, wy.o as oy, {value} as v from a join wy on wy.t = a.t and wy.bh = a.bh and wy.i = a.y group by all)
select vec_id, string_agg(printf('%02x', v::int), '' order by oy, ox, ch) as pixels from b group by 1"""


@query("resized_images", "I24", _resize_sql(f"with {IMG}, src as (select vec_id, px, 0 as l, 0 as t, {W} as bw, {H} as bh from img)", 12))
def resized_images(t):
    return show(I.run(images(t), [I.step("resize_whole", 12, 12)]))


def _vec_try(k):
    d = lambda n: u(f"{n}{k}", SEED, 0, "vec_id")
    return (f"v{k} as (select vec_id, {k} as k, floor({d('left')} * ({W} - bw + 1)) as l, floor({d('top')} * ({H} - bh + 1)) as t, bw, bh from ("
            f"select *, round_even(sqrt(ta * asp), 0) as bw, round_even(sqrt(ta / asp), 0) as bh from ("
            f"select vec_id, {W}.0::double * {H} * ({d('area')} * (1.0::double - 0.08::double) + 0.08::double) as ta, "
            f"exp({d('ratio')} * (ln(4.0::double/3) - ln(0.75::double)) + ln(0.75::double)) as asp from img)) "
            f"where bw > 0 and bw <= {W} and bh > 0 and bh <= {H})")


RESIZED = (f"with {IMG}, {', '.join(_vec_try(k) for k in range(10))}, "
           f"tries as ({' union all '.join(f'select * from v{k}' for k in range(10))}), "
           "best as (select * from (select *, row_number() over (partition by vec_id order by k) as rn from tries) where rn = 1), "
           f"src as (select vec_id, px, coalesce(l, 0) as l, coalesce(t, 0) as t, coalesce(bw, {W}) as bw, coalesce(bh, {H}) as bh from img left join best using (vec_id))")


@query("random_resized_images", "I21", _resize_sql(RESIZED, 6))
def random_resized_images(t):
    box = I.random_resized_box(F.col("h"), F.col("w"), lambda name, k: draw(f"{name}{k}"))
    rows = images(t).withColumn("b", box)
    return show(I.run(rows, [I.step("resize", *[F.col(f"b.{x}") for x in ("left", "top", "w", "h")], 6, 6)]))
