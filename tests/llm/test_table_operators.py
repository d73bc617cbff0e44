"""Operators on vectors, sizes, rows and messages, and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from brute import SMALL, Union, words

import __spark_entry__ as entry

key = lambda r: tuple((x is None, x) for x in r)


def test_components(spark):
    from kilnset.llm.components import components

    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    pairs += [(7, 7), (None, 3), (2000, 2001), (2001, 2000)] + [(3000, i) for i in range(3001, 3200)]
    groups = Union()
    for a, b in pairs:
        if a is not None and a != b:
            groups.join(a, b)
    found = {tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {(x, groups.find(x)) for x in groups.up}


def _vectors():
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((12, 32))
    rows = []
    for i in range(240):
        v = centers[i % 12] + rng.standard_normal(32) * (0.05 + 0.5 * ((i // 12) % 2))
        rows.append((i, v.astype(np.float32).astype(float).tolist()))
    rows += [(300 + k, rows[5][1]) for k in range(30)]  # copies
    rows += [(400, None), (401, [0.0] * 32), (402, [math.nan] + [1.0] * 31), (403, [None] + [1.0] * 31), (404, []),
             (405, [1.0] * 7), (406, [1.0] * 7), (407, [math.inf] * 32), (408, [x * 3 for x in rows[5][1]]),
             (None, rows[5][1]), (409, [1e-300] * 7), (410, [1e300] * 7)]
    return rows


@pytest.mark.parametrize("block", [512, 5])
def test_near_vectors(spark, monkeypatch, block):
    from kilnset.llm import near_vectors as module

    monkeypatch.setattr(module, "BLOCK", block)
    rows = _vectors()
    unit = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v) / np.abs(v).max()
            unit[i] = a / np.linalg.norm(a)
    links, groups = Counter(), Union()
    ids = sorted(unit)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rep", "'x' as cls")
    out = module.near_vectors(df).collect()
    assert sorted(r.vec_id for r in out if r.vec_id is not None) == sorted(i for i, _ in rows if i is not None)
    found = {r.vec_id: r for r in out}
    assert all(found[i].n_links <= links[i] for i in unit)  # nothing below the bound
    assert sum(found[i].n_links for i in unit) >= 0.97 * sum(links.values())
    assert all(found[i].component_id == groups.find(i) for i in unit)
    for i in (400, 401, 402, 403, 404, 407):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert found[None].n_links == 0 and found[None].component_id is None
    assert module.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_query_recall(spark):
    out = entry.queries()["op7_near_vectors"](spark, "/root/testdata/sf0.01").toPandas().sort_values("vec_id")
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas().sort_values("vec_id")
    unit = np.array(rows.embedding.tolist(), dtype=float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert (out.n_links.to_numpy() <= links).all() and out.n_links.sum() >= 0.9 * links.sum()


def test_permutation_is_a_computable_bijection():
    from kilnset.llm.sharding import locate, permute, row_at

    for n in (0, 1, 2, 3, 5, 16, 17, 1000, 4097):
        got = permute(np.arange(n), n, seed=9)
        assert sorted(got.tolist()) == list(range(n))
        assert permute(got, n, seed=9, inverse=True).tolist() == list(range(n))
    assert permute(np.arange(1000), 1000, 1).tolist() != permute(np.arange(1000), 1000, 2).tolist()
    assert all(row_at(*locate(i, 1000, 16, 4), 1000, 16, 4) == i for i in range(0, 1000, 37))


def test_shards(spark, odd_docs):
    from kilnset.llm.sharding import locate, shard_rows

    n = odd_docs.count()
    out = shard_rows(odd_docs, 16, seed=3)
    rows = out.collect()
    assert Counter(tuple(r)[:6] for r in rows) == Counter(map(tuple, odd_docs.collect()))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert locate(r.row_number, n, 16, 3) == (r.shard, r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(len(slots.get(s, [])) for s in range(16)) <= 1
    again = shard_rows(odd_docs.repartition(11), 16, seed=3)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, rows))
    assert shard_rows(odd_docs.limit(0), 16).count() == 0


def test_targets_fill_up(spark):
    from kilnset.llm.mixing import source_targets

    sizes = {"a": 1000, "b": 10, "c": 500, "d": 0, None: 300}
    out = {r.source: r for r in source_targets(spark.createDataFrame(
        [(s, n // 2) for s, n in sizes.items()] + [(s, n - n // 2) for s, n in sizes.items()], "source string, size long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    assert {s: r.source_size for s, r in out.items()} == sizes
    assert all(abs(out[s].target - target[s]) < 1e-6 for s in sizes)


def test_pivotal_rounding_keeps_totals_and_expectations():
    from kilnset.llm.mixing import _pivot

    size = np.sort(np.random.default_rng(1).pareto(1.5, 60) * 100 + 1)[::-1]
    start, mean = np.full(60, 0.3), np.zeros(60)
    for seed in range(2000):
        part, left = _pivot(size, start, np.random.default_rng(seed))
        assert abs(np.dot(part, size) - np.dot(start, size)) < 1e-6 * size.sum()
        assert sum(0 < p < 1 for p in part) == (left is not None)
        mean += np.array(part) / 2000
    assert np.abs(mean - 0.3).max() < 0.05


def test_mix(spark, odd_docs, odd_texts, monkeypatch):
    from pyspark.sql import functions as F

    from kilnset.llm import mixing

    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    many = spark.createDataFrame([(i, f"s{i % 3}" if i % 11 else None, 5 + i * 7 % 60) for i in range(900)],
                                 "doc_id long, source string, size long").withColumn("mark", F.lit(0))
    out = mixing.mix_sources(many)
    rows = out.toPandas()
    assert len(rows) == 900 and rows.copies.max() <= 2
    for _, part in rows.groupby(rows.source.fillna("-")):
        assert abs((part.copies * part["size"]).sum() - part.target.iloc[0]) <= part["size"].max()
    again = mixing.mix_sources(many.repartition(7)).toPandas()
    assert rows.sort_values("doc_id").copies.tolist() == again.sort_values("doc_id").copies.tolist()
    sized = odd_docs.withColumn("size", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).withColumn("mark", F.crc32("text"))
    out = mixing.mix_sources(sized).collect()
    assert sorted((r.size for r in out)) == sorted(len(words(t)) for _, t in odd_texts)
    assert all(r.copies == 0 for r in out if r.size == 0)
    assert mixing.mix_sources(many.limit(0)).count() == 0


def test_encoder_gives_the_ids_of_the_tokenizers_library(odd_texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    from kilnset.llm.packing import byte_bpe

    json = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    json.encode_special_tokens = True
    texts = [t or "" for _, t in odd_texts] + [
        "<|endoftext|> x", "a  b   c", " \n \n x", "don't we'll 12345 ½   x", "日本語 \U0001f600", "\x00\x85  a"]
    texts += duckdb.sql(f"select text from '{SMALL}/documents.parquet' where text is not null").df().text.tolist()
    assert [byte_bpe()(t) for t in texts] == [e.ids for e in json.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_in_running_text(spark, odd_texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    from kilnset.llm.packing import cut_documents, encoder

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> x", "<|endoftext|>", "<|endoftext|><|endoftext|>a", "x  <|endoftext|>  y\n<|endoftext|", "",
             "<|ENDOFTEXT|> <|endof<|endoftext|>text|>", "'<|endoftext|>s \n <|endoftext|>\n", "é<|endoftext|>\U0001f600"]
    texts += [t + "<|endoftext|>" + t[::-1] for _, t in odd_texts if t] + [t or "" for _, t in odd_texts]
    texts += duckdb.sql(f"select text from '{SMALL}/documents.parquet' where text is not null").df().text.tolist()
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert wanted[0] == [64, 220, 50256, 2124]
    assert [encoder()(t) for t in texts] == wanted
    rows = spark.createDataFrame(list(enumerate(texts[:20])), "doc_id long, text string")
    for r in cut_documents(rows, window=10**6).collect():
        ids = [*wanted[r.doc_id], 0]
        assert (r.start, r.length, r.doc_tokens) == (0, len(ids), len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4"))


def test_pack(spark, odd_docs, odd_texts):
    from kilnset.llm.packing import byte_bpe, pack

    out = pack(odd_docs, window=64, with_ids=True).collect()
    held = defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4"))
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(held) == list(range(len(held)))
    pieces = Counter((r.doc_id, r.start, tuple(r.ids), r.doc_tokens) for r in out)
    wanted = Counter()
    for i, t in odd_texts:
        ids = [*byte_bpe()(t or ""), 0]
        for s in range(0, len(ids), 64):
            wanted[(i, s, tuple(ids[s:s + 64]), len(ids))] += 1
    assert pieces == wanted
    assert sum(r.length for r in out) > 0.93 * 64 * len(held)
    assert pack(odd_docs.limit(0)).count() == 0


def test_pack_many_full_windows(spark):
    """Full windows have numbers of their own, and ranges of a few pieces agree."""
    from kilnset.llm.packing import pack

    rows = [(i, "word " * (200 + i % 7)) for i in range(120)] + [(i, "a b c") for i in range(60)] + [(None, None)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), window=16, range_pieces=5).collect()
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    assert sorted(held) == list(range(len(held)))
    for parts in held.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 16
    assert sum(r.length == 16 for r in out) > 1000
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append((r.start, r.length))
    assert sum(n for n, in [(len(v),) for v in by_doc.values()]) == len(out) and len(by_doc) == 121


def test_plan_uses_every_piece_once():
    from kilnset.llm.packing import plan_ranges, plan_sequences

    rng = np.random.default_rng(0)
    for histogram in (rng.integers(0, 40, 129), np.eye(129, dtype=int)[100] * 7, np.zeros(129, int)):
        histogram[0] = 0
        plan = plan_sequences(histogram)
        used = np.zeros(129, dtype=int)
        for parts, n in plan:
            assert sum(parts) <= 128 and n > 0
            np.add.at(used, list(parts), n)
        assert (used == histogram).all()
        assert len(plan_ranges(plan)) == sum(len(p) for p, _ in plan)
    even = rng.integers(50, 60, 129)
    even[0] = 0
    total = sum(n for _, n in plan_sequences(even))
    assert (even * np.arange(129)).sum() > 0.99 * 128 * total


CHAT = [
    (1, 0, "user", "Hello there\nHow are  YOU?"), (1, 1, "bot", "> how are you?\nFine, thanks."),
    (1, 2, "user", ">> How are you?\n> Fine, thanks.\n\nGood to hear\nreally"), (1, 3, "bot", "> Hello there\n> How are you?\nyes"),
    (1, 4, "user", "> Good to hear\n> really\nok\n> nobody said this\nend"), (1, 5, "user", "plain"),
    (2, 0, "user", "> quotes the future"), (2, 1, "bot", "quotes the future"), (2, 2, None, None),
    (2, 2, "bot", "  > > quotes the future\n   >   deeper"), (3, None, "user", "x"), (None, 1, "user", "> x\ny"),
    (3, 1, "user", ">\n>>>\n"), (3, 2, "user", "a > b"), (1, 5, "user", "plain"), (4, 7, "user", ""),
    (5, 1, "a", "one"), (5, 2, "b", "> one\ntwo"), (5, 3, "c", "> two\nthree"), (5, 4, "d", "> three\nfour"), (5, 5, "e", "> two\nfive"),
]


def _oracle(con):
    out = con.execute(entry.oracle_sql()["op2_quote_links"])
    names = [d[0] for d in out.description]
    return names, out.fetchall()


def test_quote_links_against_sql(spark):
    from kilnset.llm.quote_links import link_quotes

    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", CHAT)
    names, wanted = _oracle(con)
    out = link_quotes(df.selectExpr("*", "1 as depth", "'y' as path"))
    found = [tuple(r[c] for c in names) for r in out.collect()]
    assert sorted(found, key=key) == sorted(wanted, key=key)
    by = {(r.conv_id, r.turn, r.role): r for r in out.collect()}
    assert (by[1, 1, "bot"].reply_to, by[1, 1, "bot"].text) == (0, "Fine, thanks.")
    assert (by[1, 2, "user"].reply_to, by[1, 2, "user"].n_quotes, by[1, 2, "user"].n_linked) == (1, 2, 2)
    assert [r.turn for r in sorted((r for r in out.collect() if r.conv_id == 5), key=lambda r: r.position)] == [1, 2, 3, 4, 5]
    assert by[5, 5, "e"].depth == 2 and by[5, 4, "d"].depth == 3
    assert link_quotes(df.limit(0)).count() == 0


def _same_as_sql(out, rows):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    names, wanted = _oracle(con)
    assert sorted([tuple(r[c] for c in names) for r in out], key=key) == sorted(wanted, key=key)


def test_quotes_with_null_keys(spark):
    from kilnset.llm.quote_links import link_quotes

    t = "hello\n> q\nbye"
    rows = [(5, None, "u", t), (None, 5, "u", t), (None, 0, "a", "hi there"), (None, 1, "b", "> hi there\nyes"),
            (None, 1, "b", "> hi there\nyes"), (None, None, None, None), (0, 0, "a", "hi there"), (6, None, "a", "x"), (6, None, "a", "> x")]
    out = link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    _same_as_sql(out, rows)
    assert all(r.text == "hello\nbye" and r.n_quotes == 1 for r in out if r.role == "u")
    assert [r.n_linked for r in out if r.conv_id is None and r.role == "b"] == [1, 1]


def test_long_threads_and_messages(spark):
    """A chain of 5,000 replies, a message with 2,000 replies, and 30,000 equal lines."""
    from kilnset.llm.quote_links import link_quotes

    rows = [(1, 0, "a", "m0")] + [(1, t, "a", f"> m{t - 1}\nm{t}") for t in range(1, 5000)]
    rows += [(2, 0, "a", "start")] + [(2, t, "a", "> start\nre") for t in range(1, 2001)]
    rows += [(3, 0, "a", "x\n" * 30_000 + "y")] + [(3, n, "a", "> x\n" * n + "> y\nhere") for n in range(1, 12)]
    out = link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {(r.conv_id, r.turn): r for r in out}
    assert all((by[1, t].position, by[1, t].depth) == (t, t) for t in range(5000))
    assert all((by[2, t].position, by[2, t].depth) == (t, min(t, 1)) for t in range(2001))
    assert all(by[3, n].reply_to == 0 for n in range(1, 12))


def test_quotes_of_neighbouring_lines(spark):
    from kilnset.llm.quote_links import link_quotes

    rows = [
        (1, 0, "a", "a\nb\nc"), (1, 1, "b", "> a\n> b\nyes"), (1, 2, "c", "> B\n>  c \nno"), (1, 3, "d", "> a\n> c\nno run"),
        (1, 4, "e", "> b\n> a\nother order"), (1, 5, "f", "> c\n> d\ntoo long"), (1, 6, "g", ">> a\n>> b\n> yes\nboth"),
        (2, 0, "a", "one\ntwo\n\nthree\nfour\n\nfive"), (2, 1, "b", "> two\n>\n> three\n> four\na"), (2, 2, "c", "> three\n> four\nb"),
        (2, 3, "d", "> one\nfirst\n> two\n> three\nsecond\nthird"), (2, 4, "e", "> second\n> third\nof a quoting one"),
        (3, 0, "a", "x\nx\nx\ny"), (3, 1, "b", "> x\n> y\nend"), (3, 2, "c", "> x\n> x\nstart"), (3, 3, "d", "> a\n> b\nelsewhere"),
        (4, 0, "a", "> p\n> q\nbefore it was said"), (4, 1, "b", "o\np\nq"), (4, 2, "c", "n\np\nq\nr"), (4, 3, "d", "> p\n> q\nfirst of two"),
        (5, None, "a", "k\nl\nm"), (5, 1, "b", "> k\n> l\nnobody's turn"),
    ]
    out = link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == len(rows)
    _same_as_sql(out, rows)
    found = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.reply_to) for r in out if r.n_quotes}

    def lines(text):  # what a message says itself, line by line
        return [x for x in (" ".join(y.lower().split()) for y in text.split("\n") if not y.startswith(">")) if x]

    wanted = {}
    for conv, turn, _, text in rows:
        passages, last = [], None
        for line in text.split("\n"):
            depth = len(line) - len(line.lstrip(">"))
            if depth and depth == last:
                passages[-1][1].append(line)
            elif depth:
                passages.append((depth, [line]))
            last = depth
        if not passages:
            continue
        links = []
        for depth, part in passages:
            said = lines("\n".join(x.lstrip(">") for x in part))
            turns = [t for c, t, _, other in rows if c == conv and t is not None and any(
                lines(other)[i:i + len(said)] == said for i in range(len(lines(other))))]
            if turns and min(turns) < turn:
                links.append((-depth, min(turns)))
        wanted[conv, turn] = (len(passages), len(links), max(links)[1] if links else None)
    assert found == wanted
    assert found[1, 1] == (1, 1, 0) and found[1, 3] == (1, 0, None) and found[2, 3] == (2, 2, 0) and found[2, 4] == (1, 1, 3)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SMALL)
        assert now.columns == names and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema], name
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0
    kept = corpus_pipeline.keep_quality(spark, docs, SMALL)
    clean = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1")
    long = docs.where("size(split(text, ' ')) >= 12").join(clean, "doc_id")
    assert long.join(kept, "doc_id", "left_semi").count() >= 0.95 * long.count()


def test_pipeline_stages_on_odd_rows(spark, odd_texts):
    import corpus_pipeline

    rows = [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", len(t or ""), k) for k, (i, t) in enumerate(odd_texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank int")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SMALL)
            assert name == "packing" or out.columns == table.columns
            n = out.count()
            assert (n > 0) == (table is docs), name
    near = corpus_pipeline.drop_near_copies(spark, docs, SMALL)
    assert near.where("doc_id is null").count() == docs.where("doc_id is null").count()


def test_mix_keeps_the_columns_of_each_row(spark):
    import corpus_pipeline

    text = " ".join(f"w{k}" for k in range(20))
    rows = [(i % 4, text, lang, "s", 100 + i, [i, None], {"k": i}) for i, lang in enumerate(["en", "de", None, "fr"] * 10)]
    rows += [(9, text, "en", "s", 200, None, None)] * 3
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, list array<int>, map map<string,int>")
    out = corpus_pipeline.mix(spark, docs, SMALL)
    assert out.columns == docs.columns
    taken = Counter((r.doc_id, r.lang, r.n_chars, tuple(r.list or ()), tuple((r.map or {}).items())) for r in out.collect())
    had = Counter((i, lang, n, tuple(a or ()), tuple((m or {}).items())) for i, _, lang, _, n, a, m in rows)
    assert set(taken) == set(had)  # one source is taken 1.5 times: each row once or twice
    assert all(had[x] <= n <= 2 * had[x] for x, n in taken.items())
    marks = docs.limit(0).unionByName(docs).select(corpus_pipeline.row_mark(docs)).distinct().count()
    assert marks == len(had)


def test_registered_sql_twins(spark):
    from oracle import compare

    for name in ("op2_quote_links",):
        found = compare(spark, entry.queries()[name], entry.oracle_sql()[name], SMALL)
        assert found["status"] == "ok" and found["rows"] > 0, found["note"]


def test_every_operator_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
