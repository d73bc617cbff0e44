"""Policy queries: which ops every document, vector or part gets."""

from pyspark.sql import functions as F

from kilnset.functions import tensors as X
from kilnset.functions.hashing import uniform
from kilnset.operators import policies as P
from kilnset.functions import images as I
from kilnset.functions import magnitudes as M
from kilnset.plans.images import HEX, IDX, IMG, QUANTA, images
from kilnset.plans.registry import query, u
from kilnset.sources.catalog import OP_RANGES, TENSOR_OPS, op_table, policy_table, published_rows

SEED = 42


def table_sql(name):
    rows = ", ".join(f"({p}, {i}, '{op}', {prob}::double, {'null' if lv is None else lv}::double)" for p, i, op, prob, lv in published_rows(name))
    return f"pol(policy_id, i, op, prob, level) as (values {rows})"


def ranges_sql(*families):
    rows = ", ".join(f"('{op}', {lo}::double, {hi}::double)" for f in families for op, lo, hi in OP_RANGES[f])
    return f"rng(op, lo, hi) as (values {rows})"


def names_sql(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def d(tag, *keys):
    return u(tag, SEED, 0, "doc_id", *keys)


def chosen_sql(n):
    return f"c as (select doc_id, cast(floor({d('subpolicy')} * {n}) as int) as policy_id from documents)"


SGN = "(case when {} < 0.5 then -1.0::double else 1.0::double end)"


def _plan(df, extra=("policy_id",)):
    out = P.explode_plan(df, ["doc_id", *extra])
    return out.withColumn("arg", F.round("arg", 9))


def _docs(t):
    return t.documents.select("doc_id")


LEVEL01 = "pol as (select policy_id, i, op, prob, coalesce(level, 0) / 10 as level from raw)"


@query("searched_policy_plan", "P1 J8 S15 C7", f"""
with {table_sql('cifar10').replace('pol(', 'raw(')}, {LEVEL01}, {ranges_sql('search', 'autoaugment_extra')}, {chosen_sql(25)}
select doc_id, policy_id, i as step, op, round(level * (hi - lo) + lo, 9) as arg, {d('gate', 'i')} <= prob as applied
from c join pol using (policy_id) join rng using (op)""")
def searched_policy_plan(t):
    policy = policy_table(t.spark, "cifar10").withColumn("level", F.coalesce("level", F.lit(0.0)) / 10)
    return _plan(P.searched_policy(_docs(t), "doc_id", policy, SEED))


def _random_sql(family, n, m):
    names = names_sql([r[0] for r in OP_RANGES[family]])
    return f"""
with {ranges_sql(family)}, s as (select doc_id, i, {names}[1 + floor({d('op', 'i')} * {len(OP_RANGES[family])})::int] as op
  from documents, (select unnest(range(0, {n})) as i))
select doc_id, cast(i as int) as step, op, round({m} / 30.0::double * (hi - lo) + lo, 9) as arg, true as applied from s join rng using (op)"""


@query("random_policy_plan", "P2 C8 S20", _random_sql("randaugment", 2, 9))
def random_policy_plan(t):
    return _plan(P.random_policy(_docs(t), "doc_id", "randaugment", 2, 9, SEED), ())


@query("restricted_random_policy_plan", "P3", _random_sql("gpu", 2, 9))
def restricted_random_policy_plan(t):
    return _plan(P.random_policy(_docs(t), "doc_id", "gpu", 2, 9, SEED), ())


SHAPE = "(select doc_id, cast(n_chars % 300 + 40 as int) as w, cast((n_chars // 7) % 260 + 50 as int) as h from documents)"


def _shape(t):
    return t.documents.select("doc_id", (F.col("n_chars") % 300 + 40).cast("int").alias("w"),
                              (F.floor(F.col("n_chars") / 7) % 260 + 50).cast("int").alias("h"))


def mag_sql(space, b, bins, h="h", w="w"):
    s = M.SPACES[space]
    st = f"({b} / {bins - 1}.0::double)"
    rx = f"{s['pixels']}::double" if "pixels" in s else f"{w} * {s['share']!r}::double"
    ry = f"{s['pixels']}::double" if "pixels" in s else f"{h} * {s['share']!r}::double"
    first, span = s["bits"]
    return (f"(case when op in ('ShearX', 'ShearY') then {st} * {s['shear']}::double when op = 'TranslateX' then {st} * ({rx}) "
            f"when op = 'TranslateY' then {st} * ({ry}) when op = 'Rotate' then {st} * {s['rotate']}::double "
            f"when op in ('Brightness', 'Color', 'Contrast', 'Sharpness') then {st} * {s['enhance']}::double "
            f"when op = 'Posterize' then {first} - round_even({b} / {(bins - 1) / span!r}::double, 0) "
            f"when op = 'Solarize' then 255.0::double - {st} * 255.0::double else 0.0::double end)")


SIGNED = "op in (" + ", ".join(f"'{o}'" for o in M.SIGNED) + ")"


def _binned_sql(name):
    return f"""
with {table_sql(name)}, c as (select doc_id, w, h, cast(floor({d('subpolicy')} * 25) as int) as policy_id from {SHAPE})
select doc_id, policy_id, i as step, op, round(coalesce({mag_sql('autoaugment', 'level', 10)}, 0)
  * case when {SIGNED} then {SGN.format(d('sign', 'i'))} else 1 end, 9) + 0.0::double as arg, {d('gate', 'i')} <= prob as applied
from c join pol using (policy_id)"""


for _name in ("imagenet", "cifar10", "svhn"):

    @query(f"published_policy_{_name}_plan", "P4 C9 S15", _binned_sql(_name))
    def published_policy_plan(t, name=_name):
        return _plan(P.binned_policy(_shape(t), "doc_id", policy_table(t.spark, name), F.col("h"), F.col("w"), SEED))


@query("binned_random_policy_plan", "P5 C9", f"""
with s as (select doc_id, w, h, i, {names_sql(M.BINNED_OPS)}[1 + floor({d('op', 'i')} * 14)::int] as op from {SHAPE}, (values (0), (1)) v(i))
select doc_id, i as step, op, round({mag_sql('autoaugment', '9', 31)} * case when {SIGNED} then {SGN.format(d('sign', 'i'))} else 1 end, 9) + 0.0::double as arg, true as applied from s""")
def binned_random_policy_plan(t):
    return _plan(P.binned_random_policy(_shape(t), "doc_id", 2, 9, 31, F.col("h"), F.col("w"), SEED), ())


@query("one_op_policy_plan", "P6 C9", f"""
with s as (select doc_id, i, {names_sql(M.BINNED_OPS)}[1 + floor({d('op', 'i')} * 14)::int] as op, floor({d('bin', 'i')} * 31) as b from documents, (values (0)) v(i))
select doc_id, i as step, op, round({mag_sql('wide', 'b', 31)} * case when {SIGNED} then {SGN.format(d('sign', 'i'))} else 1 end, 9) + 0.0::double as arg, true as applied from s""")
def one_op_policy_plan(t):
    return _plan(P.one_op_policy(_docs(t), "doc_id", 31, SEED), ())


CHAINS = f"""
w as (select doc_id, w, h, {d('mix0')} as m, [-ln(1 - {d('chain0')}), -ln(1 - {d('chain1')}), -ln(1 - {d('chain2')})] as e from {SHAPE}),
ch as (select doc_id, w, h, m, chain, e[chain + 1] / (e[1] + e[2] + e[3]) * (1 - m) as weight, cast(floor({d('depth', 'chain')} * 3) + 1 as int) as depth
  from w, (values (0), (1), (2)) v(chain)),
st as (select *, {names_sql(M.AUGMIX_OPS)}[1 + floor({d('op', 'chain', 'i')} * 13)::int] as op, floor({d('bin', 'chain', 'i')} * 3) as b
  from (select *, unnest(range(0, depth)) as i from ch))"""


@query("mixed_chain_plan", "P7 C9 X7", f"""
with {CHAINS} select doc_id, chain, round(weight, 9) as weight, round(m, 9) as original_weight, cast(i as int) as step, op,
  round({mag_sql('augmix', 'b', 10)} * case when {SIGNED} then {SGN.format(d('sign', 'chain', 'i'))} else 1 end, 9) + 0.0::double as arg from st""")
def mixed_chain_plan(t):
    chains = P.mixed_chains(_shape(t), "doc_id", 3, -1, 3, F.col("h"), F.col("w"), SEED)
    plan = P.explode_plan(chains, ["doc_id", "chain", "weight", "original_weight"]).drop("applied")
    return plan.select("doc_id", "chain", F.round("weight", 9).alias("weight"), F.round("original_weight", 9).alias("original_weight"),
                       "step", "op", F.round("arg", 9).alias("arg"))


VD = lambda tag: u(tag, SEED, 0, "vec_id")


@query("mixed_chain_images", "P7", f"""
with {IMG}, w as (select vec_id, px, {VD('mix0')} as m, [-ln(1 - {VD('chain0')}), -ln(1 - {VD('chain1')}), -ln(1 - {VD('chain2')})] as e from img),
x as (select vec_id, px, m, [v / (e[1] + e[2] + e[3]) * (1 - m) for v in e] as wt from w)
select vec_id, {HEX.format('[cast(trunc(round(px[k+1] * m + (255 - px[k+1]) * wt[1] + px[k+1] * wt[2] + (255 - px[k+1]) * wt[3], 9)) as int) ' + IDX)} as pixels from x""")
def mixed_chain_images(t):
    chains = P.mixed_chains(images(t), "vec_id", 3, 1, 3, 8, 8, SEED)
    turned = I.run(chains.withColumn("aug", F.col("px")), [I.when(F.col("chain") != 1, I.step("invert"))], "aug")
    mixed = P.mix_chains(turned, "vec_id", "px", "aug")
    return mixed.select("vec_id", F.lower(F.hex("mixed")).alias("pixels"))


def level_sql(level, sgn, cut, tr):
    s = f"({level} / 10.0::double)"
    return (f"case when op = 'Rotate' then {s} * 30 * {sgn} when op = 'Posterize' then trunc({s} * 4) when op = 'Solarize' then trunc({s} * 256) "
            f"when op = 'SolarizeAdd' then trunc({s} * 110) when op in ('Color', 'Contrast', 'Brightness', 'Sharpness') then {s} * 1.8::double + 0.1::double "
            f"when op in ('ShearX', 'ShearY') then {s} * 0.3::double * {sgn} when op in ('TranslateX', 'TranslateY') then {s} * {tr} * {sgn} "
            f"when op = 'Cutout' then trunc({s} * {cut}) end")


@query("level_policy_plan", "P8 C6", f"""
with {table_sql('detection_v0')}, {chosen_sql(25)}
select doc_id, policy_id, i as step, op, round({level_sql('level', SGN.format(d('sign', 'i')), 100, 250)}, 9) + 0.0::double as arg,
  floor({d('gate', 'i')} + prob) >= 1 as applied from c join pol using (policy_id)""")
def level_policy_plan(t):
    return _plan(P.level_policy(_docs(t), "doc_id", policy_table(t.spark, "detection_v0"), SEED))


@query("tensor_random_policy_plan", "P9 C6", f"""
with s as (select doc_id, i, {names_sql(TENSOR_OPS)}[1 + floor({d('op', 'i')} * 16)::int] as op from documents, (values (0), (1), (2)) v(i))
select doc_id, i as step, op, round({level_sql('7.0::double', SGN.format(d('sign', 'i')), 40, 100)}, 9) + 0.0::double as arg, true as applied from s""")
def tensor_random_policy_plan(t):
    return _plan(P.tensor_random_policy(_docs(t), "doc_id", 3, 7.0, SEED), ())


# Candidate weights come from the part table: each brand parity is a layer.
CAND = ("cand as (select cast(substr(p_brand, 7) as int) % 3 as layer, p_size % 10 as magnitude, p_type, cast(sum(p_retailprice) as double) as weight from part group by 1, 2, 3),"
        " cn as (select layer, row_number() over (partition by layer order by p_type, magnitude) - 1 as cand_id, weight, magnitude, "
        f"{names_sql([r[0] for r in OP_RANGES['weighted']])}[1 + (length(p_type) + magnitude) % 15] as op from cand)")


def _candidates(t):
    from pyspark.sql import Window

    names = X.literal_array([r[0] for r in OP_RANGES["weighted"]])
    cand = t.part.groupBy(
        (F.substring("p_brand", 7, 9).cast("int") % 3).alias("layer"), (F.col("p_size") % 10).alias("magnitude"), "p_type").agg(
        F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double").alias("weight"))
    w = Window.partitionBy("layer").orderBy("p_type", "magnitude")
    return cand.select("layer", (F.row_number().over(w) - 1).alias("cand_id"), "weight",
                       F.get(names, (F.length("p_type") + F.col("magnitude")) % 15).alias("op"), "magnitude")


@query("weighted_layer_plan", "P10 C3", f"""
with {CAND.replace("cast(sum(p_retailprice) as double)", "cast(sum(cast(p_retailprice as decimal(18,2))) as double)")}, {ranges_sql('weighted')},
cu as (select *, sum(weight) over (partition by layer order by cand_id) as hi, sum(weight) over (partition by layer) as tot from cn),
dr as (select doc_id, layer, {d('layer', 'layer')} as u from documents, (values (0), (1), (2)) v(layer)),
pk as (select doc_id, layer, op, magnitude, row_number() over (partition by doc_id, layer order by cand_id) as rn from dr join cu using (layer) where hi > u * tot)
select doc_id, cast(layer as int) as step, op, round(magnitude / 9.0::double * (hi - lo) + lo, 9) as arg, true as applied from pk join rng using (op) where rn = 1""")
def weighted_layer_plan(t):
    return _plan(P.weighted_layers(_docs(t), "doc_id", _candidates(t), 10, SEED), ())


PRESET_NAMES = list(P.PRESETS)


@query("preset_stages", "P11", f"""
with p as (select doc_id, {names_sql(PRESET_NAMES)}[1 + doc_id % {len(PRESET_NAMES)}] as preset from documents)
select doc_id, preset, case preset {' '.join(f"when '{k}' then '{chr(44).join(v)}'" for k, v in P.PRESETS.items())} end as stages from p""")
def preset_stages(t):
    rows = t.documents.select("doc_id", F.get(X.literal_array(PRESET_NAMES), (F.col("doc_id") % len(PRESET_NAMES)).cast("int")).alias("preset"))
    return P.preset_stages(rows, F.col("preset")).select("doc_id", "preset", F.array_join("stages", ",").alias("stages"))


@query("stage_order", "P12", f"""
with s as (select doc_id, i, {names_sql([r[0] for r in OP_RANGES['staged']])}[1 + floor({d('op', 'i')} * 15)::int] as op from documents, (values (0), (1)) v(i))
select doc_id, 'Start,Decode,' || string_agg(op, ',' order by i) || ',RandomCrop,FlipAndNormalize,Finish' as stages from s group by 1""")
def stage_order(t):
    rows = P.stage_order(P.random_policy(_docs(t), "doc_id", "staged", 2, 9, SEED), "randaugment")
    return rows.select("doc_id", F.array_join("stages", ",").alias("stages"))


@query("staged_policy_usage", "P12 S15 S20", f"""
with {table_sql('staged')}, c as (select doc_id, cast(floor({d('subpolicy')} * 23) as int) as policy_id from documents),
{ranges_sql('randaugment')}
select op, lo as low, hi as high, count(*) as chosen, cast(sum(case when {d('gate', 'i')} <= prob then 1 else 0 end) as bigint) as applied
from c join pol using (policy_id) join rng using (op) group by 1, 2, 3""")
def staged_policy_usage(t):
    rows = P.binned_policy(_docs(t), "doc_id", policy_table(t.spark, "staged"), 224, 224, SEED)
    plan = P.explode_plan(rows, ["doc_id"]).groupBy("op").agg(
        F.count(F.lit(1)).alias("chosen"), F.sum(F.col("applied").cast("int")).alias("applied"))
    return plan.join(op_table(t.spark, "randaugment").drop("op_no"), "op")


@query("published_levels_rescaled", "S15 C6 C7", f"""
with {table_sql('detection_v0')}, {ranges_sql('search')}, {chosen_sql(25)},
a as (select doc_id, policy_id, i as step, op, case when op in ('ShearX', 'ShearY') then level * 0.3::double / 10 when op = 'Rotate' then trunc(level * 30 / 10)
  when op = 'Solarize' then 256 - trunc(level * 256 / 10) when op in ('Contrast', 'Color', 'Brightness', 'Sharpness') then level * 1.8::double / 10 + 0.1::double
  else level end as v from c join pol using (policy_id))
select doc_id, policy_id, step, op, round((v - lo) / (hi - lo), 9) as level from a join rng using (op)""")
def published_levels_rescaled(t):
    ranges = op_table(t.spark, "search")
    policy = policy_table(t.spark, "detection_v0").join(ranges, "op")
    value = M.searched_level(F.col("op"), F.col("level"))
    policy = policy.select("policy_id", F.col("op_idx").alias("step"), "op", F.round(M.unscale(value, F.col("low"), F.col("high")), 9).alias("level"))
    chosen = _docs(t).withColumn("policy_id", F.floor(uniform("subpolicy", SEED, 0, "doc_id") * 25).cast("int"))
    return chosen.join(F.broadcast(policy), "policy_id")  # fixed table of 50 rows


@query("magnitude_bins", "C9", f"""
with s as (select doc_id, w, h, {names_sql(M.BINNED_OPS)}[1 + doc_id % 14] as op, doc_id % 31 as b from {SHAPE})
select doc_id, op, round({mag_sql('autoaugment', 'b', 31)}, 9) as paper, round({mag_sql('wide', 'b', 31)}, 9) as wide, round({mag_sql('augmix', 'b', 31)}, 9) as mix from s""")
def magnitude_bins(t):
    rows = _shape(t).withColumn("op", F.get(X.literal_array(M.BINNED_OPS), (F.col("doc_id") % 14).cast("int"))).withColumn("b", F.col("doc_id") % 31)
    mag = lambda s: F.round(M.bin_magnitude(s, F.col("op"), F.col("b"), 31, F.col("h"), F.col("w")), 9)
    return rows.select("doc_id", "op", mag("autoaugment").alias("paper"), mag("wide").alias("wide"), mag("augmix").alias("mix"))


# Images of 32 x 32 pixels, on which equalisation moves values.
S = 32
CELLS = S * S
ALL = f"for k in range(0, {3 * CELLS})]"
PX, PY, PC = f"((k // 3) % {S})", f"(k // {3 * S})", "(k % 3)"
IMG32 = (f"img as (select vec_id, [(q[(({PY} // 4) * 8 + {PX} // 4 + 21 * {PC}) % 64 + 1] + 9 * ({PX} % 4) + 5 * ({PY} % 4)) % 256 {ALL} as px "
         f"from {QUANTA})")
ENHANCE = "('Brightness', 'Color', 'Contrast', 'Sharpness')"


def _unrounded(sql):
    """Plan SQL with the arguments in full: ``round(x, 9)`` becomes ``(x)``."""
    at = sql.find("round(")
    while at >= 0:
        depth, end = 0, at + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if not depth:
                break
            end += 1
        if sql[:end].endswith(", 9"):
            sql = sql[:at] + "(" + sql[at + 6:end - 3] + ")" + sql[end + 1:]
        at = sql.find("round(", at + 1)
    return sql


def _for_vectors(name):
    """The registered SQL of a plan over documents, for vectors as 32 x 32 images."""
    from kilnset.plans.registry import QUERIES

    sql = _unrounded(QUERIES[name].sql).strip()
    shape = f"(select vec_id, {S} as w, {S} as h from embeddings)"
    sql = sql.replace("doc_id", "vec_id").replace(SHAPE.replace("doc_id", "vec_id"), shape).replace("documents", "embeddings")
    return f"given as ({sql})"


def _gathered(sx, sy):
    return f"[case when {sx} >= 0 and {sx} < {S} and {sy} >= 0 and {sy} < {S} then px[(({sy}) * {S} + ({sx})) * 3 + {PC} + 1] else 0 end {ALL}"


def _blended(a, f):
    return f"[cast(trunc(least(greatest({a} + ({f}) * (px[k + 1] - {a}), 0.0), 255.0)) as int) {ALL}"


def _step_sql(i, keys):
    """CTEs of one step of the fold: what the op needs, then the op."""
    d = lambda tag: u(tag, SEED, 0, "vec_id", str(i))
    fl = lambda x: f"cast(floor({x}) as int)"
    channel = f"[px[3 * j + {PC} + 1] for j in range(0, {CELLS})]"
    per_channel = lambda f: f"[{f}([px[3 * j + c + 1] for j in range(0, {CELLS})]) for c in range(0, 3)]"
    grey = f"[(px[3*j+1] * 19595 + px[3*j+2] * 38470 + px[3*j+3] * 7471 + 32768) >> 16 for j in range(0, {CELLS})]"
    near = " + ".join(f"{5 if dx == dy == 0 else 1} * px[k + 1 + {(dy * S + dx) * 3}]" for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    soft = f"(case when {PX} in (0, {S - 1}) or {PY} in (0, {S - 1}) then px[k + 1] else floor(({near}) / 13.0::double + 0.5) end)::double"
    ext = f"(255.0::double / (hi[{PC} + 1] - lo[{PC} + 1]))"
    clip = f"cast(floor(least(greatest(u * {S} + d, 0), {S})) as int)"
    ends = lambda x, half: clip.replace("u *", f"u{x} *").replace("+ d", f"+ {half}")
    box = lambda x0, y0, x1, y1: (f"[case when {PX} >= {x0} and {PX} <= {x1} and {PY} >= {y0} and {PY} <= {y1} "  # noqa: E731
                                  f"then [125, 123, 114][k % 3 + 1] else px[k + 1] end {ALL}")
    square = box("x0", "y0", f"floor(least({S}, x0 + side))", f"floor(least({S}, y0 + side))")
    added = "least(greatest(p + trunc(v), 0), 255)"
    half = S / 2
    cropped = (f"[case when {PX} + ox - 4 between 0 and {S - 1} and {PY} + oy - 4 between 0 and {S - 1} "
               f"then px[(({PY} + oy - 4) * {S} + {PX} + ox - 4) * 3 + {PC} + 1] else [125, 123, 114][k % 3 + 1] end {ALL}")
    ops = {
        "Invert": "[255 - p for p in px]",
        "Solarize": "[case when p < v then p else 255 - p end for p in px]",
        "SolarizeAdd": f"[cast(case when {added} < 128 then {added} else 255 - {added} end as int) for p in px]",
        "SolarizeAddBelow": f"[cast(case when p < 128 then {added} else p end as int) for p in px]",
        "Posterize": "[p - p % cast(pow(2, 8 - greatest(trunc(v), 0)) as int) for p in px]",
        "Brightness": _blended("0.0::double", "v"),
        "Contrast": _blended("floor(list_sum(g) / {0}.0::double + 0.5)".format(CELLS), "v"),
        "ContrastCount": _blended(f"{CELLS // 256}.0::double", "v"),
        "Color": _blended("g[k // 3 + 1]::double", "v"),
        "Sharpness": _blended(soft, "v"),
        "AutoContrast": f"[case when hi[{PC}+1] > lo[{PC}+1] then cast(trunc(least(greatest(px[k+1] * {ext} - lo[{PC}+1] * {ext}, 0.0), 255.0)) as int) else px[k+1] end {ALL}",
        "Equalize": f"[cast(case when st[{PC}+1] = 0 then px[k+1] else least((st[{PC}+1] // 2 + list_position(eq[{PC}+1], px[k+1]) - 1) // greatest(st[{PC}+1], 1), 255) end as int) {ALL}",
        "ShearX": _gathered(fl(f"{PX} + 0.5 + v * ({PY} + 0.5)"), PY),
        "ShearY": _gathered(PX, fl(f"v * ({PX} + 0.5) + {PY} + 0.5")),
        "TranslateXAbs": _gathered(fl(f"{PX} + 0.5 + v"), PY), "TranslateYAbs": _gathered(PX, fl(f"{PY} + 0.5 + v")),
        "TranslateX": _gathered(fl(f"{PX} + 0.5 + v * {S}"), PY), "TranslateY": _gathered(PX, fl(f"{PY} + 0.5 + v * {S}")),
        "Rotate": _gathered(fl(f"co * ({PX} + 0.5) + si * ({PY} + 0.5) + ({half} - co * {half} - si * {half})"),
                            fl(f"-si * ({PX} + 0.5) + co * ({PY} + 0.5) + ({half} + si * {half} - co * {half})")),
        "Cutout": f"case when v <= 0 then px else {square} end",
        "CutoutAbs": f"case when v < 0 then px else {square} end",
        "RandCutout": box(ends("x", -8), ends("y", -8), ends("x", 8), ends("y", 8)),
        "RandFlip": f"case when {d('flip')} > 0.5 then [px[({PY} * {S} + {S - 1} - {PX}) * 3 + {PC} + 1] {ALL} else px end",
        "RandCrop": cropped,
    }
    ops |= {"TranslateXabs": ops["TranslateXAbs"], "TranslateYabs": ops["TranslateYAbs"]}
    both = ", ".join(keys)
    named = ", ".join(f"{k} as plan_{k}" for k in keys)
    join = " and ".join(f"plan_{k} = {k}" for k in keys)
    cases = " ".join(f"when '{o}' then {e}" for o, e in ops.items())
    return f""", n{i} as (select s{i}.*, case when coalesce(applied, false) then op end as op, arg as v, {d('cut_x')} as ux, {d('cut_y')} as uy,
  cast(floor({d('crop_x')} * 9) as int) as ox, cast(floor({d('crop_y')} * 9) as int) as oy
  from s{i} left join (select {named}, op, arg, applied from plan where step = {i}) on {join}),
p{i} as (select *, round(cos(-radians(v)), 15) as co, round(sin(-radians(v)), 15) as si, case op when 'Cutout' then v * {S} else v end as side,
  case when op in ('Contrast', 'Color') then {grey} end as g, case when op = 'AutoContrast' then {per_channel('list_min')} end as lo,
  case when op = 'AutoContrast' then {per_channel('list_max')} end as hi, case when op = 'Equalize' then {per_channel('list_sort')} end as eq from n{i}),
q{i} as (select *, [(list_position(e, e[-1]) - 1) // 255 for e in eq] as st, floor(greatest(ux * {S} - side / 2, 0)) as x0,
  floor(greatest(uy * {S} - side / 2, 0)) as y0 from p{i}),
s{i + 1} as (select {both}, nullif(concat_ws(',', ops, op), '') as ops, case op {cases} else px end as px from q{i})"""


def _fold_sql(plan, steps, family="search", keys=("vec_id",), start="select vec_id, null::varchar as ops, px from img"):
    """SQL of a whole policy on 32 x 32 images: the relation ``given`` of ``plan``
    (vec_id, step, op, arg, applied) put into the convention of ``executable``, four
    CTEs a step."""
    names = {"search": {}, "binned": {"TranslateX": "TranslateXAbs", "TranslateY": "TranslateYAbs"}, "level": {
        "TranslateX": "TranslateXAbs", "TranslateY": "TranslateYAbs", "Cutout": "CutoutAbs", "SolarizeAdd": "SolarizeAddBelow",
        "Contrast": "ContrastCount"}}[family]
    arg = {"search": "arg", "binned": f"case when op in {ENHANCE} then arg + 1.0 else arg end",
           "level": "case when op = 'Cutout' then arg * 2.0 else arg end"}[family]
    renamed = "case op " + " ".join(f"when '{a}' then '{b}'" for a, b in names.items()) + " else op end" if names else "op"
    chain = ", chain" if "chain" in keys else ""
    applied = "true" if chain else "applied"
    out = f"with {IMG32}, {plan}, "
    out += f"plan as (select vec_id{chain}, step, {renamed} as op, {arg} as arg, {applied} as applied from given), s0 as ({start})"
    return out + "".join(_step_sql(i, keys) for i in range(steps))


def _folded(plan, steps, family):
    return _fold_sql(plan, steps, family) + f" select vec_id, coalesce(ops, '') as ops, {HEX.format('px')} as pixels from s{steps}"


MIRRORED = ("Rotate", "ShearX", "ShearY", "TranslateXabs", "TranslateYabs")
_SIGN = f"case when {u('mirror', SEED, 0, 'vec_id', 'step')} < 0.5 then -1.0::double else 1.0::double end"
_MIRROR_SQL = (_for_vectors("random_policy_plan").replace("given as (", "unsigned as (", 1)
               + f", given as (select vec_id, step, op, arg * case when op in {MIRRORED} then {_SIGN} else 1 end as arg, applied from unsigned)")


def _shown(out):
    return out.select("vec_id", F.array_join(F.transform("applied", lambda a: a["op"]), ",").alias("ops"), F.lower(F.hex("px")).alias("pixels"))


@query("augmented_images", "P2 I30", _folded(_MIRROR_SQL, 2, "search"))
def augmented_images(t):
    rows = P.random_policy(images(t, S), "vec_id", "randaugment", 2, 9, SEED)
    return _shown(P.augment_images(rows, "vec_id", "px", "h", "w", SEED, mirror=MIRRORED))


def _pixels(rows, family, **more):
    rows = rows.withColumn("ops", P.executable(F.col("ops"), family))
    return _shown(P.augment_images(rows, "vec_id", "px", "h", "w", SEED, **more))


@query("published_policy_images", "P4 I30", _folded(_for_vectors("published_policy_cifar10_plan"), 2, "binned"))
def published_policy_images(t):
    rows = P.binned_policy(images(t, S), "vec_id", policy_table(t.spark, "cifar10"), F.col("h"), F.col("w"), SEED)
    return _pixels(rows, "binned")


@query("binned_random_images", "P5 I30", _folded(_for_vectors("binned_random_policy_plan"), 2, "binned"))
def binned_random_images(t):
    return _pixels(P.binned_random_policy(images(t, S), "vec_id", 2, 9, 31, F.col("h"), F.col("w"), SEED), "binned")


@query("one_op_images", "P6 I30", _folded(_for_vectors("one_op_policy_plan"), 1, "binned"))
def one_op_images(t):
    return _pixels(P.one_op_policy(images(t, S), "vec_id", 31, SEED), "binned")


_CHAIN_START = "select distinct vec_id, chain, null::varchar as ops, px from img join given using (vec_id)"


@query("augmix_images", "P7 I30", _fold_sql(_for_vectors("mixed_chain_plan"), 3, "binned", ("vec_id", "chain"), _CHAIN_START) + f""",
w as (select distinct vec_id, chain, weight, original_weight from given),
c as (select vec_id, any_value(original_weight) as m, list(px order by chain) as c, list(weight order by chain) as wt from s3 join w using (vec_id, chain) group by 1)
select vec_id, {HEX.format(f'[cast(trunc(round(px[k+1] * m + c[1][k+1] * wt[1] + c[2][k+1] * wt[2] + c[3][k+1] * wt[3], 9)) as int) {ALL}')} as pixels from img join c using (vec_id)""")
def augmix_images(t):
    chains = P.mixed_chains(images(t, S), "vec_id", 3, -1, 3, F.col("h"), F.col("w"), SEED)
    chains = chains.withColumn("ops", P.executable(F.col("ops"), "binned")).withColumn("aug", F.col("px"))
    done = P.augment_images(chains, "vec_id", "aug", "h", "w", SEED)
    return P.mix_chains(done, "vec_id", "px", "aug").select("vec_id", F.lower(F.hex("mixed")).alias("pixels"))


@query("level_policy_images", "P8 I30", _folded(
    _for_vectors("level_policy_plan").replace("* 250", "* 8").replace("* 100)", "* 8)"), 2, "level"))
def level_policy_images(t):
    return _pixels(P.level_policy(images(t, S), "vec_id", policy_table(t.spark, "detection_v0"), SEED, cutout=8.0, translate=8.0), "level")


@query("tensor_random_images", "P9 I30", _folded(
    _for_vectors("tensor_random_policy_plan").replace("* 100 *", "* 8 *").replace("* 40)", "* 8)"), 3, "level"))
def tensor_random_images(t):
    return _pixels(P.tensor_random_policy(images(t, S), "vec_id", 3, 7.0, SEED, cutout=8.0, translate=8.0), "level")


@query("weighted_layer_images", "P10 I30", _folded(_for_vectors("weighted_layer_plan"), 3, "search"))
def weighted_layer_images(t):
    return _pixels(P.weighted_layers(images(t, S), "vec_id", _candidates(t), 10, SEED), "search")


@query("resized_crop_policy_images", "P10 I21", f"""
select vec_id, {S // 2} as h, {S // 2} as w, 'RandResizeCrop_imagenet,Invert' as ops from embeddings""")
def resized_crop_policy_images(t):
    # one layer with the resized crop as its only candidate, one that inverts
    layers = t.region.where("r_regionkey < 2").select(
        F.col("r_regionkey").cast("int").alias("layer"), F.lit(0).alias("cand_id"), F.lit(1.0).alias("weight"),
        F.when(F.col("r_regionkey") == 0, "RandResizeCrop_imagenet").otherwise("Invert").alias("op"), F.lit(5).alias("magnitude"))
    rows = P.weighted_layers(images(t, S), "vec_id", layers, 10, SEED)
    out = P.augment_images(rows, "vec_id", "px", "h", "w", SEED, crop_size=S // 2)
    fits = F.octet_length("px") == F.col("h") * F.col("w") * 3
    return out.where(fits).select("vec_id", "h", "w", F.array_join(F.transform("applied", lambda a: a["op"]), ",").alias("ops"))
