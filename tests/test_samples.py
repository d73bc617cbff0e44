"""Golden and property tests of samplers, splits, batches and sources."""

import gzip
import math
import struct

import pytest
from pyspark.sql import functions as F

from kilnset.functions import headers as HD
from kilnset.functions import text as TX
from kilnset.operators import batching as B
from kilnset.operators import filters as P
from kilnset.operators import joins as J
from kilnset.operators import meters as M
from kilnset.operators import sampling as S
from kilnset.operators import splits as SP
from kilnset.operators.ranking import positions
from kilnset.sources import catalog as C
from kilnset.sources import logs as LG
from kilnset.sources import samples as SR
from kilnset.sources import sinks as K


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "k")


def test_batches_of_three(spark):
    rows = positions(ids(spark, 10), ["k"], total="n")
    keep = B.fixed_batches(rows, 3).groupBy("batch_id").agg(F.sort_array(F.collect_list("k")).alias("b")).orderBy("batch_id")
    assert [r.b for r in keep.collect()] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9]]
    assert B.fixed_batches(rows, 3, drop_last=True).count() == 9
    assert B.batch_length(rows, 3, False).first().batches == 4
    assert B.batch_length(rows, 3, True).first().batches == 3


@pytest.mark.parametrize("workers,sizes", [(0, [4]), (2, [2, 2]), (20, [1, 1, 1, 1])])
def test_worker_shards_of_four(spark, workers, sizes):
    got = SP.worker_shards(ids(spark, 4), "k", workers).groupBy("worker").count().orderBy("worker").collect()
    assert [r["count"] for r in got] == sizes


def test_micro_batches_need_a_multiple(spark):
    with pytest.raises(ValueError):
        B.micro_batches(positions(ids(spark, 10), ["k"], total="n"), 4, 10)
    assert B.micro_batches(positions(ids(spark, 10), ["k"], total="n"), 4, 8).count() == 8


def test_permutation_ignores_partitioning_and_changes_by_epoch(spark):
    rows = ids(spark, 500)
    one = {r.k: r.pos for r in S.permutation(rows.repartition(1), "k", 3).collect()}
    many = {r.k: r.pos for r in S.permutation(rows.repartition(17), "k", 3).collect()}
    other = {r.k: r.pos for r in S.permutation(rows, "k", 3, 1).collect()}
    assert one == many and one != other
    assert sorted(one.values()) == list(range(500))
    # seed 1 epoch 2 is not seed 2 epoch 1
    a = {r.k: r.pos for r in S.permutation(rows, "k", 1, 2).collect()}
    assert a != {r.k: r.pos for r in S.permutation(rows, "k", 2, 1).collect()}


@pytest.mark.parametrize("n,r,drop", [(10, 4, False), (10, 4, True), (12, 4, True), (3, 8, False), (3, 8, True)])
def test_rank_sizes_are_equal(spark, n, r, drop):
    got = S.distributed(ids(spark, n), "k", r, 7, drop_last=drop).groupBy("rank").count().collect()
    want = (n // r if n % r == 0 else max(math.ceil((n - r) / r), 0)) if drop else math.ceil(n / r)
    assert [g["count"] for g in got] == ([want] * r if want else [])


def test_weighted_draws_follow_the_weights(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 9), (3, 90)], "k long, w long")
    got = {r.k: r["count"] for r in S.weighted_with_replacement(df, "k", F.col("w"), 4000, 5).groupBy("k").count().collect()}
    assert sum(got.values()) == 4000 and 0 not in got
    assert abs(got[3] - 3600) < 120 and abs(got[2] - 360) < 100
    same = df.withColumn("w", F.lit(1))
    assert S.weighted_with_replacement(same, "k", F.col("w"), 100, 5).count() == 100
    with pytest.raises(ValueError):
        S.weighted_with_replacement(df.withColumn("w", F.lit(0)), "k", F.col("w"), 1, 5)
    first = S.weighted_without_replacement(df, "k", F.col("w"), 3, 5)
    assert first.count() == 3 and first.select("k").distinct().count() == 3


def test_split_lengths_must_add_up(spark):
    rows = ids(spark, 100)
    parts = SP.random_split(rows, "k", [70, 20, 10], 1).groupBy("split").count().orderBy("split").collect()
    assert [p["count"] for p in parts] == [70, 20, 10]
    with pytest.raises(Exception, match="add up"):
        SP.random_split(rows, "k", [70, 20], 1).collect()


def test_stratified_quota_error_is_below_one(spark):
    rows = ids(spark, 1000).withColumn("t", F.when(F.col("k") % 10 < 7, 0).when(F.col("k") % 10 < 9, 1).otherwise(F.col("k") % 3 + 2))
    quota = SP.class_quota(rows, "t", F.lit(150)).collect()
    assert sum(q.quota for q in quota) == 150
    assert all(abs(q.quota - q.n_class * 0.15) < 1 for q in quota)
    kept = SP.reduce_stratified(rows, "k", "t", 150, 2)
    assert kept.count() == 150


def test_collate_rejects_unequal_lengths(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0], "a"), (0, 1, [3.0], "b")], "b int, p int, v array<double>, s string")
    with pytest.raises(Exception, match="equal size"):
        B.collate(df, ["b"], "p", ["v"]).collect()
    row = B.collate(df.select("b", "p", "s", F.slice("v", 1, 1).alias("v")), ["b"], "p", ["v", "s"]).first()
    assert row.v == [[1.0], [3.0]] and row.s == ["a", "b"]


def test_addresses_out_of_range_raise(spark):
    sizes = spark.createDataFrame([(0, 3), (1, 0), (2, 2)], "ordinal int, n long")
    req = spark.createDataFrame([(0,), (3,), (4,), (-1,), (-5,)], "idx long")
    got = {r.idx: (r.ordinal, r.local_idx) for r in J.resolve_addresses(req, sizes).collect()}
    assert got == {0: (0, 0), 3: (2, 0), 4: (2, 1), -1: (2, 1), -5: (0, 0)}
    with pytest.raises(Exception, match="exceeds"):
        J.resolve_addresses(spark.createDataFrame([(5,)], "idx long"), sizes).collect()


def test_mixup_keeps_at_least_half(spark):
    df = spark.range(64).select(
        F.col("id").alias("k"), F.floor(F.col("id") / 16).alias("batch_id"), (F.col("id") % 16).alias("pos_in_batch"),
        F.array(F.col("id").cast("double")).alias("x"), (F.col("id") % 3).alias("t"))
    for alpha in (1.0, 2.0, 0.2):
        got = J.mixup(df, "k", "x", "t", 1, 0, alpha).collect()
        assert len(got) == 64 and all(0.5 <= r.lam <= 1 for r in got)
        assert all(r.mixed[0] == pytest.approx(r.k * r.lam + r.partner * (1 - r.lam)) for r in got)
        assert len({(r.batch_id, r.partner) for r in got}) == 64


def test_dict_sums_divide_by_key_or_number(spark):
    df = spark.createDataFrame([({"loss": 2.0, "cnt": 1.0},), ({"loss": 4.0, "cnt": 3.0},)], "d map<string,double>")
    by_key = {r.key: r.value for r in M.accumulate(df, "d", "cnt").collect()}
    assert by_key == {"loss": 1.5, "cnt": 4.0}
    assert {r.key: r.value for r in M.accumulate(df, "d", 2).collect()} == {"loss": 3.0, "cnt": 2.0}


def test_nan_can_end_the_job(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan"))], "g string, loss double")
    assert P.nan_report(df, ["g"], "loss").first().n_nan == 1
    with pytest.raises(Exception, match="NaN"):
        P.nan_report(df, ["g"], "loss", fail=True).collect()


def test_char_codes(spark):
    df = spark.createDataFrame([("Ab?",), ("",), ("x" * 50,)], "t string")
    got = [r.c for r in df.select(TX.vectorize_chars(F.col("t"), 8).alias("c")).collect()]
    assert got[0] == [2, 4, 5, 33, 3, 0, 0, 0]
    assert got[1] == [2, 3, 0, 0, 0, 0, 0, 0]
    assert got[2] == [2] + [27] * 6 + [3]


def test_labelled_folder_of_files(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.wav").write_bytes(b"12345")
        (tmp_path / name / "2.TXT").write_bytes(b"1")
    files = SR.read_folder(spark, str(tmp_path))
    got = SR.label_by_folder(files, SR.parent_folder(F.col("path")))
    assert {(r.class_name, r.target) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert SR.only_extensions(files, "path", "wav", "mp3").count() == 3
    with pytest.raises(FileNotFoundError):
        SR.only_extensions(files, "path", "flac")


def test_gzip_files_are_unpacked(spark):
    df = spark.createDataFrame([(0, bytearray(gzip.compress(b"hello"))), (1, bytearray(b"plain"))], "i int, content binary")
    got = {r.i: bytes(r.content) for r in SR.decompress(df).collect()}
    assert got == {0: b"hello", 1: b"plain"}


def test_text_sources(spark, tmp_path):
    (tmp_path / "m.txt").write_text("n01/a.jpg 3\n\n  n02/b.jpg 4  \n")
    got = SR.parse_manifest(spark.read.text(str(tmp_path / "m.txt"))).collect()
    assert [(r.path, r.class_name) for r in got] == [("n01/a.jpg", "n01"), ("n02/b.jpg", "n02")]
    (tmp_path / "u.csv").write_text("time,gpu_id,gpu_utilization,memory_usage,cpu_usage,\n1:2,0,50.0,1.5,20.0,\n")
    row = LG.read_utilisation(spark, str(tmp_path / "u.csv")).first()
    assert (row.gpu_id, row.gpu_utilization, row.cpu_usage) == (0, 50.0, 20.0)
    (tmp_path / "p.json").write_text('[[["ShearY", 0.1, 0.5], ["Color", 0.2, 0.3]], [["Invert", 1.0, 0.0], ["Color", 0.4, 0.6]]]\n')
    got = C.read_policies(spark, str(tmp_path / "p.json")).orderBy("policy_id", "op_idx").collect()
    assert [(r.policy_id, r.op_idx, r.op, r.prob) for r in got] == [
        (0, 0, "ShearY", 0.1), (0, 1, "Color", 0.2), (1, 0, "Invert", 1.0), (1, 1, "Color", 0.4)]


def test_result_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1, 10), ("b", 1, 20)], "k string, e int, v int")
    K.write_results(df, path, ["k", "e"])
    K.write_results(spark.createDataFrame([("a", 1, 99)], "k string, e int, v int"), path, ["k", "e"])
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {("a", 99), ("b", 20)}


def test_unaligned_columns_raise(spark):
    a, b = ids(spark, 3).withColumn("x", F.lit(1)), ids(spark, 2).withColumn("y", F.lit(1))
    with pytest.raises(Exception, match="aligned"):
        SR.aligned_columns(a, b, "k").collect()


def _tiff(order, w, h):
    o = "<" if order == b"II" else ">"
    entry = lambda tag, kind, v: struct.pack(o + "HHL", tag, kind, 1) + struct.pack(o + ("HH" if kind == 3 else "L"), *((v, 0) if kind == 3 else (v,)))
    return order + struct.pack(o + "HL", 42, 8) + struct.pack(o + "H", 2) + entry(256, 3, w) + entry(257, 4, h)


@pytest.mark.parametrize("content,want", [
    (b"GIF87a" + struct.pack("<HH", 7, 9), ("GIF", 7, 9)),
    (b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">LL", 251, 208), ("PNG", 251, 208)),
    (b"BM" + b"\0" * 12 + struct.pack("<Lll", 40, 33, -44), ("BMP", 33, 44)),
    (b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc2\x00\x0b\x08" + struct.pack(">HH", 30, 40) + b"\0" * 4, ("JPEG", 40, 30)),
    (_tiff(b"II", 640, 70000), ("TIFF", 640, 70000)),
    (_tiff(b"MM", 64, 48), ("TIFF", 64, 48)),
    (b"\x00\x00\x01\x00\x01\x00" + bytes([16, 32]), ("ICO", 16, 32)),
    (b"\xff\xd8\xff", (None, None, None)),
    (b"not an image at all", (None, None, None)),
])
def test_image_headers(spark, content, want):
    row = spark.createDataFrame([(bytearray(content),)], "content binary").select(HD.image_header(F.col("content")).alias("m")).first().m
    assert (row.type, row.width, row.height) == want
    assert row.status == ("ok" if want[0] else "unknown")


def test_policy_tables():
    assert len(C.published_rows("imagenet")) == len(C.published_rows("cifar10")) == len(C.published_rows("svhn")) == 50
    assert len(C.published_rows("staged")) == 46
    assert [len(C.OP_RANGES[f]) for f in ("search", "autoaugment_extra", "crop_extra", "randaugment", "staged", "weighted", "gpu")] == [15, 4, 6, 16, 15, 15, 7]


def test_files_of_long_transcripts_are_no_orphans(spark):
    from types import SimpleNamespace

    from kilnset.plans.joins import transcript_join, transcript_orphans

    rows = [(1, 0, "user", "short"), (1, 1, "bot", "x" * 200), (1, 2, "user", "y" * 5000), (2, 0, "user", None), (2, 1, "bot", "")]
    tables = SimpleNamespace(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [tuple(r) for r in transcript_orphans(tables).select("id", "path").collect()] == [("2_0", "wavs/user/2_0.wav")]
    assert {r.id for r in transcript_join(tables).collect()} == {"1_0", "2_1"}
