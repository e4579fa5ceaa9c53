"""The ten operators against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import io
import itertools
import math
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from starledger.llm import credentials, decontam, langid, linededup, mixing, queries, repetition, simhash, sitetemplate, token_records, toxicity

SF = "/root/testdata/sf0.001"
SF_MODEL = "/root/testdata/sf0.01"
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "ÉTÉ x 中文 👍 " * 3), (None, "no id here"), (6, "a b c d e f g h i j k l " * 3000)]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


ODD = ("copy", "Copy", "TEXT", "a.b", "c0", "mark", "row", "shuffle_key", "n_lines", "fp", "rate", "cdf", "kept", "component_id", "score", "key", "n", "host", "source_x")


def odd(df):
    """``df`` with columns more: names that operators use inside, with dots, and that differ by case only."""
    more = df.selectExpr("*", *[f"'x' as `{i}_`" for i in range(len(ODD))])
    return more.toDF(*df.columns, *ODD)


def edge(spark):
    """Nulls, empty and very long texts, repeated rows, and odd columns."""
    return odd(spark.createDataFrame([(i, t, None if i == 1 else "en", None if i == 2 else "s", 0) for i, t in EDGE], DOCS))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts(name="documents", sf=SF):
    return duckdb.sql(f"select * from read_parquet('{sf}/{name}.parquet')").to_arrow_table().to_pylist()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    rows = lambda t: sorted(repr([r[c] for c in sorted(t.column_names)]) for r in t.to_pylist())
    assert rows(queries.QUERIES[name](spark, SF).toArrow()) == rows(con.sql(queries.ORACLES[name]).to_arrow_table())


# 1 benchmark decontamination


def brute_leaks(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hit, which = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        for i in range(max(1, len(w) - 9) if w else 0):
            win = w[i : i + 10]
            for j in range(len(words) - len(win) + 1):
                if words[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    which.add(item)
    return len(words), len(hit), which


def test_decontamination_by_brute_force(spark):
    items = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (10, "SHORT item"), (3, None), (4, " ... "), (5, "été à")]
    docs = [(1, "x one TWO three, four five six seven eight nine ten eleven y short; item"), (2, "shorted item"), (3, None), (4, ""), (5, "Été à été à"), (5, "Été à été à"), (6, "short item short item" * 2)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = sorted((i, *brute_leaks(t, items)[:2], hashlib.sha256(",".join(sorted(map(str, brute_leaks(t, items)[2]))).encode()).hexdigest()) for i, t in docs)
    one = decontam.report(df, bench)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.items_sha256) for r in one.collect()) == want
    many = decontam.hits(df, bench, block_chars=20)
    n_hit = sorted((r.doc_id, r.n_words, sum(x["to"] - x["from"] for x in r.ranges), hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest()) for r in many.collect())
    assert n_hit == want
    for most in (20, decontam.BLOCK_CHARS):
        assert sorted(r.doc_id for r in decontam.clean(df, bench, most).collect()) == [2, 3, 4]
        found = {(r.doc_id, docs[0][1][r.start : r.end]) for r in decontam.spans(df.where("doc_id = 1"), bench, most).collect()}
        assert found == {(1, "one TWO three, four five six seven eight nine ten eleven"), (1, "short; item")}
    assert decontam.report(df, bench.where("false")).where("contaminated").count() == 0


def test_items_of_one_window_fill_blocks(spark):
    bench = spark.createDataFrame([(i, "the same item") for i in range(300)] + [(None, "the same item")], "item_id bigint, text string")
    blocks = list(decontam._blocks(decontam.windows_of(bench), 400))
    assert len(blocks) > 5 and max(len(ids) for b in blocks for _, ids in b) <= 50
    docs = spark.createDataFrame([(1, "here is the same item again"), (2, "nothing")], "doc_id bigint, text string")
    assert {(r.doc_id, r.n_hit, r.n_items) for r in decontam.report(docs, bench, 400).collect()} == {(1, 3, 301), (2, 0, 0)}


# 2 toxicity


def test_toxicity_on_held_out_rows(spark):
    """Most toxic rows are found and few clean ones called so: a model that says one thing always fails."""
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, SF_MODEL).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(got[r["doc_id"]].predicted, r["toxic"]) for r in texts("labels", SF_MODEL) if got[r["doc_id"]].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([p for p, y in held if y == 1]) >= 0.5 and np.mean([p for p, y in held if y == 0]) <= 0.05


def toxic_model(seed=0, n=300):
    rng = np.random.default_rng(seed)
    plain = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    make = lambda bad: " ".join([*rng.choice(plain, 30), *(["blorgo" + rng.choice(list("xyz"))] if bad else [])]).encode()
    labels = [i % 2 for i in range(n)]
    return toxicity.fit([make(y) for y in labels], labels, ["en"] * n, list(range(n))), make


def test_toxicity_of_planted_words():
    model, make = toxic_model()
    s = model.scores([make(0), make(1), b"alpha blorgoq beta", b"", None])
    assert s[0] < 0.5 < s[1] and s[2] > 0.5 and s[3] == s[4] and 0 <= s[3] <= 1
    assert 0 <= toxicity.fit([b"x"], [0], [None], [0]).scores([b"x"])[0] <= 1


def test_scores_by_plain_convolution():
    """The table of responses gives what filters run along each text alone give, whatever lies beside it."""
    model, make = toxic_model(3, 80)
    values = [make(1)[:60], b"", b"alpha", b"beta blorgox", make(0), None, b"unseen words blorgo"]
    want = []
    for v in values:
        words = [model.emb[toxicity.features([w])[0]].astype(float).sum(axis=0) for w in toxicity.words_of(v)] + [np.zeros(toxicity.DIM)] * toxicity.PAD
        tops = []
        for k in toxicity.WIDTHS:
            at = [sum((words[i + o] @ model.filters[:, toxicity.COLUMNS[k, o]] for o in range(k) if i + o < len(words)), np.zeros(toxicity.FILTERS)) for i in range(len(words))]
            tops.append(np.max(at, axis=0))
        z = np.concatenate(tops) + model.bias
        z = np.where(z > 0, z, toxicity.LEAK * z) @ model.out + model.out_bias
        want.append(1 / (1 + np.exp(-(model.scale * z + model.shift))))
    assert np.allclose(model.scores(values), want, atol=1e-6)
    assert np.allclose([model.scores([v])[0] for v in values], want, atol=1e-6)


def test_evidence_by_brute_force():
    docs, y = [np.array([1, 2, 0, 0]), np.array([1, 0, 0]), np.array([2, 2, 0, 0]), np.array([3, 0, 0])], np.array([1, 1, 0, 0])
    feats = np.array([[0], [5], [6], [7]])
    got = toxicity.evidence(docs * 20, feats, np.tile(y, 20))
    # bucket 5 stands in 40 texts, all of label 1, of 80 with half of them; 4 buckets were looked at
    want = min(toxicity.EVIDENCE_MOST, 40 * math.log(2) - math.log(4)) / toxicity.EVIDENCE_UNIT
    assert abs(got[5] - want) < 1e-9 and got[6] == got[7] == got[0] == 0


def test_toxicity_learns_from_every_labelled_row(spark):
    """Texts of any length, and rows of any task, count for what is learned; those of the held-out fold never do."""
    rng = np.random.default_rng(4)
    plain = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    long = lambda i: " ".join([*rng.choice(plain, 4500), *(["blorgox"] if i % 2 else [])])
    rows = [(i, long(i), "en") for i in range(1, 81)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i, _, _ in rows], "doc_id bigint, toxic int")
    labelled = toxicity._labelled(docs, labels)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    assert sorted((r.text, r.toxic) for r in labelled.collect()) == sorted((t, i % 2) for i, t, _ in learned)
    held = toxicity._holders(labelled).sum(axis=0)
    for word in (b"alpha", b"blorgox"):
        bucket = toxicity.features([word])[0][0]
        assert [held[c, bucket] for c in (0, 1)] == [sum(word.decode() in t.split() and i % 2 == c for i, t, _ in learned) for c in (0, 1)]
    model = toxicity.train(docs, labels)
    s = model.scores([b"alpha beta", b"alpha blorgox beta"])
    assert s[0] < 0.5 < s[1]


# 3 line dedup


def test_line_dedup_cases(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "b\nc\nd"), (4, None), (5, ""), (6, "a\nb"), (7, "q\nr\ns\nq\nr\ns\nt"), (8, "\n\n\n\n"), (9, "\n\n\n\n"), (10, "z1\nz2\nz3"), (10, "z1\nz2\nz3"), (None, "m\nn\no"), (11, "m\nn\no")]
    got = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in linededup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(1, "a\nb\nc\nd", 4, 0), (2, "x\ny", 5, 3), (3, "", 3, 3), (4, None, 0, 0), (5, "", 1, 0), (6, "a\nb", 2, 0), (7, "q\nr\ns\nt", 7, 3), (8, "\n\n\n\n", 5, 0), (9, "\n\n\n\n", 5, 0), (10, "z1\nz2\nz3", 3, 0), (None, "m\nn\no", 3, 0), (11, "", 3, 3)}


def test_window_in_a_third_of_all_documents(spark):
    """Tasks of a window that many documents share are split, and all but the first lose it."""
    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        docs = spark.range(0, 60_000, 1, 8).selectExpr("id as doc_id", "if(id % 3 = 0, concat('one\ntwo\nthree\n', id), concat('a', id, '\nb')) as text")
        later = linededup.later_occurrences(linededup.windows(docs))
        tasks = later.groupBy(linededup.F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in tasks) == 19_999 and max(r["count"] for r in tasks) < 8000
        assert linededup.report(docs).where("n_removed = 3").count() == 19_999
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_line_dedup_runs_no_python(spark):
    plan = linededup.report(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# 4 token records


def test_records_round_trip(spark, tmp_path):
    rows = texts()
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id bigint, text string")
    folder = f"file://{tmp_path}/records"
    token_records.write_records(df, folder, token_records.vocabulary_path())
    index = token_records.open_index(spark, folder).cache()
    assert not list((tmp_path / "records").glob(".shard-*"))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_records.vocabulary_path())
    start = 0
    got = {r.doc_id: r for r in token_records.read_records(index, folder).collect()}
    by_few_bytes = {r.doc_id: r for r in token_records.read_records(index, folder, most=3000).collect()}
    assert by_few_bytes == got and token_records.read_records(index.limit(0), folder).isEmpty()
    digest = {r.doc_id: r for r in token_records.digests(index, folder).collect()}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        g = got[r["doc_id"]]
        assert (g.start, g.n_tokens, g.ids) == (start, len(ids), ids)
        assert digest[r["doc_id"]].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    # the shards hold the records in ascending order, one after another
    seen = 0
    for f in sorted((tmp_path / "records").glob("shard-*.rec")):
        with f.open("rb") as s:
            while token_records.read_record(s) is not None:
                seen += 1
    assert seen == len(rows)


def test_rows_of_one_id_are_many_shards(spark, tmp_path):
    df = spark.range(4000).selectExpr("cast(if(id % 3 = 0, null, 7) as bigint) as doc_id", "concat('word ', id) as text")
    folder = f"file://{tmp_path}/records"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    index = token_records.write_records(df.repartition(4), folder, token_records.vocabulary_path())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert index.select("shard").distinct().count() >= 4 and index.groupBy("shard").count().agg({"count": "max"}).first()[0] < 2000
    rows = index.orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None] * 1334 + [7] * 2666 and all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))


def test_damaged_records_are_told():
    good = token_records.frame(b"abcd")
    assert token_records.read_record(io.BytesIO(good)) == b"abcd" and token_records.read_record(io.BytesIO(b"")) is None
    for bad in (good[:-1], good[:5], good[:13] + b"X" + good[14:], b"\x05" + good[1:]):
        with pytest.raises(ValueError):
            token_records.read_record(io.BytesIO(bad))


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_records.vocabulary_path())
    e = token_records.Encoder(token_records.vocabulary_path(), 2)
    assert e.simple
    cases = ["don't we're 's The's <|endoftext|>x a<|b", "\x1c\x85 q été. İstanbul ΟΔΟΣ ǅ 123,4 中文。x 👍🏽 ﬁne é ́a", "", "...!!! a.,;b", "ÀÉÞß, ŁÓDŹ*** a'll, 'tis l'été'", *(r["text"] for r in texts()[:60])]
    for c in cases:
        assert next(e.encode([c.encode()])) == np.array(t.encode(c, add_special_tokens=False).ids, "<u2").tobytes(), c[:80]


# 5 language ID


def test_language_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op5_language_id(spark, SF_MODEL).collect()}
    rows = texts(sf=SF_MODEL)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == {r["doc_id"] for r in held}
    assert np.mean([got[r["doc_id"]].lang_pred == r["lang"] for r in held]) >= 0.97
    assert np.mean([got[r["doc_id"]].rejected for r in rows]) <= 0.01


def test_all_of_many_languages_are_learnt(spark):
    rows = [(i, f"w{chr(97 + i % 25)}{chr(97 + i // 25 % 10)}zq " * 6, f"l{i % 250:03d}", "s", 0) for i in range(1500)]
    model = langid.train(spark.createDataFrame(rows, DOCS))
    assert model.languages == sorted({r[2] for r in rows})


def test_undetermined_without_a_letter(spark):
    cases = [(1, "½ ² ①"), (2, "Ⅷ 123 _ !"), (3, None), (4, ""), (5, " \n"), (6, "½ a"), (7, "ʰ"), (8, "文"), (9, "\u0301")]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in cases] + [(100 + i, "the words of this text", "en", "s", 0) for i in range(20)], DOCS)
    import unicodedata

    for r in langid.report(docs).where("doc_id < 100").collect():
        letter = any(unicodedata.category(c).startswith("L") for c in dict(cases)[r.doc_id] or "")
        assert (r.lang_pred == "und") == (not letter) and (r.rejected or letter) and 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_probabilities_by_plain_averages():
    """A text's logits are the mean over its subwords, counted one by one."""
    model = langid.fit([b"the and of", b"der und das", b"le la les"] * 10, ["en", "de", "fr"] * 10, [False] * 30)
    values = [b"The und, le2la", b"x", "Übel é".encode()]
    for v, got in zip(values, model.raw(values), strict=True):
        grams = []
        for w in v.translate(langid.TABLE).split():
            w = b" " + w + b" "
            for n in langid.ORDERS:
                for i in range(len(w) - n + 1):
                    h = 0
                    for k, byte in enumerate(w[i : i + n]):
                        h = byte if k == 0 else (h * 0x01000193 & 0xFFFFFFFF) ^ byte
                    grams.append(((h + (n * 0x9E3779B1 & 0xFFFFFFFF) & 0xFFFFFFFF) * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - langid.BITS)
        assert np.allclose(got, model.logits[:, grams].astype(float).mean(axis=1) + model.bias, atol=1e-5)


def test_subwords_stay_in_words():
    found = list(langid.subwords([b"ab c", b"", b"x"]))
    # " ab " has 3 of two bytes, 2 of three and 1 of four; " c " and " x " have 2 and 1
    assert sum(n for _, n in found).tolist() == [3 + 2 + 1 + 2 + 1, 0, 3]
    assert all(len(b) == n.sum() for b, n in found)
    alone = list(langid.subwords([b"x"]))
    assert all((b[len(b) - len(x) :] == x).all() for (b, _), (x, _) in zip(found, alone, strict=False))


def test_pieces_lose_no_subword():
    text = b"Wor\xc3\xa4 and, more-of it " * 40 + b"x" * 300 + b" end"
    whole = np.sort(np.concatenate([b for b, _ in langid.subwords([text])]))
    cut = list(langid.pieces(text, 50))
    assert len(cut) > 10 and (np.sort(np.concatenate([b for p in cut for b, _ in langid.subwords([p])])) == whole).all()


# 6 mixing


def test_counts_follow_the_distribution(spark):
    rows = [(i, "t", "en", "big" if i % 3 else "small", 1) for i in range(6000)] + [(9000, "t", "en", None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(docs, {"big": 1.0, "small": 3.0}, total=12_000)
    got = collections.Counter(r.source for r in out.collect())
    assert None not in got and abs(got["small"] - 9000) < 400 and abs(got["big"] - 3000) < 250
    # a mean above one draw's step is a sum of draws
    many = mixing.mix(docs.where("doc_id < 30"), None, total=30 * 50)
    n = collections.Counter(r.doc_id for r in many.collect())
    assert 1200 < sum(n.values()) < 1800


def test_poisson_inverse(spark):
    docs = spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(500)], DOCS)
    got = collections.Counter(r.doc_id for r in mixing.mix(docs, total=900).collect())
    for i in range(500):
        u = int(hashlib.md5(f"20:{i}:1".encode()).hexdigest()[:13], 16) / 2**52
        k, cdf = 0, math.exp(-1.8)
        while cdf <= u:
            k += 1
            cdf += math.exp(-1.8) * 1.8**k / math.factorial(k)
        assert got[i] == k
    order = [r.shuffle_key for r in mixing.mix(docs, total=900).collect()]
    assert len(set(order)) == len(order)


def test_one_document_for_half_of_the_mixture(spark):
    """The lone document of a source is drawn for and copied in blocks over all tasks."""
    many = spark.range(200_000).selectExpr("id as doc_id", "'text' as text", "'en' as lang", "'large' as source", "4L as n_chars")
    docs = many.union(spark.createDataFrame([(-1, "lone", "en", "small", 4)], DOCS)).union(spark.createDataFrame([(-2, "rare", "en", None, 4)] * 2, DOCS))
    out = mixing.mix(docs)
    counts = {r.source: r.n for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(counts["small"] - 66_667) < 1500 and abs(counts["large"] - 66_667) < 1500 and abs(counts[None] - 66_667) < 3000
    numbers = out.where("doc_id = -1").agg(F.min("copy"), F.max("copy"), F.countDistinct("copy"), F.countDistinct("shuffle_key")).first()
    assert tuple(numbers) == (1, counts["small"], counts["small"], counts["small"])
    joined = docs.limit(0).union(spark.createDataFrame([(-1, "lone", "en", "small", 4)], DOCS)).toDF("c0", "c1", "c2", "c3", "c4")
    rates = mixing._tables(spark.createDataFrame([("small", 300_000.0)], "source string, rate double")).withColumnRenamed("source", "mixed_source")
    blocks = mixing._in_blocks(joined.join(rates, joined.c3 == rates.mixed_source), F.col("c0").cast("string"), 1)
    sizes = blocks.groupBy(F.spark_partition_id()).agg(F.sum(F.col("last") - F.col("first") + 1).alias("n"), F.max(F.col("last") - F.col("first")).alias("most")).collect()
    assert sum(r.n for r in sizes) > 297_000 and max(r.most for r in sizes) < mixing.BLOCK and max(r.n for r in sizes) < 75_000
    plain = sum(int(r.n) for r in sizes)
    inline = joined.join(rates, joined.c3 == rates.mixed_source).select(mixing._counted(1, F.col("c0").cast("string"), F.lit(1), F.col("draws")).alias("n")).first().n
    assert plain == inline


def test_more_copies_than_an_array_holds(spark):
    """A rate of billions is blocks of a thousand: only the plan is made, the draws stay numbers of 64 bits."""
    table = mixing._tables(spark.createDataFrame([("small", 5e9)], "source string, rate double")).first()
    assert table.draws == 312_500_000


# 7 site templates

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href=/x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><header class=top>Site</header>
<article><header><h1>Title &amp; more</h1></header><p>First <b>bold<br>line</b> &#233;.<p>Second   one.<ul><li>a<li>b</ul>
<div class="share-buttons">Share</div><form><input>Sign up</form><aside>Side</aside><p>{body}</p><p>{extra}</p></article>
<section id=comments><p>Reader says</p></section><div class="ad">Buy</div><footer>&copy; x</footer></body></html>"""


def test_main_text():
    got = sitetemplate.main_text(sitetemplate.parse(PAGE.replace("{body}", "Body 1 < 2").replace("{extra}", "")))
    assert got == "Title & more\nFirst bold line é.\nSecond one.\na\nb\nShare\nBody 1 < 2"
    assert sitetemplate.main_text(sitetemplate.parse("")) == ""
    assert sitetemplate.main_text(sitetemplate.parse("<p>a &am")) == "a &am"
    assert sitetemplate.main_text(sitetemplate.parse("<p>a<p>b</div></b>c<!-- x")) == "a\nb\nc".replace("b\nc", "bc")
    assert sitetemplate.main_text(sitetemplate.parse("<div>" * 5000 + "deep")) == "deep"
    assert sitetemplate.main_text(sitetemplate.parse('<article><p title="a>b">x</p><script>no')) == "x"
    wrapped = '<div class="page with-sidebar"><div class=sidebar><p>side</div><article class="post tag-alert"><p>Body</p><div class=comments><article class=comment>Me</article></div></article></div>'
    assert sitetemplate.main_text(sitetemplate.parse(wrapped)) == "Body"
    menu = "<div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><p>Text with <a href=4>link</a>.</p>"
    assert sitetemplate.main_text(sitetemplate.parse(menu)) == "Text with link."
    assert sitetemplate.main_text(sitetemplate.parse('<div role="main"><p>x</div><div hidden>y</div>')) == "x"


def test_templates_of_a_site_go(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.replace("{body}", f"Body {i}").replace("{extra}", "All pages end with this line.")) for i in range(20)]
    rows += [(100 + i, f"http://other.example/{i}", f"<body><div>Menu one</div><div>Text {i}</div></body>") for i in range(10)]
    rows += [(200, None, None), (201, "no url", ""), (202, "http://h.example/0", "<p>All pages end with this line."), (0, rows[0][1], rows[0][2])]
    got = collections.defaultdict(list)
    for r in sitetemplate.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert all(got[i][0].endswith(f"Body {i}") for i in range(20)) and len(got[0]) == 2
    assert all(got[100 + i] == [f"Text {i}"] for i in range(10))
    assert got[200] == [""] and got[201] == [""]


def test_menus_take_nothing_out_of_articles(spark):
    page = '<div><a href=/e>Economy</a> | <a href=/s>Sport</a></div><article><p>Story {i} on the <a href=/e>Economy</a>.</p></article>'
    rows = [(i, f"http://m.example/{i}", page.replace("{i}", str(i)) if i < 8 else page.replace("{i}", str(i)).replace(' on the <a href=/e>Economy</a>', "")) for i in range(40)]
    rows.append((99, "http://m.example/list", "<div><a href=/e>Economy</a> | <a href=/s>Sport</a></div><p>No article here.</p>"))
    got = {r.page_id: r.text for r in sitetemplate.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert [got[i] for i in range(8)] == [f"Story {i} on the Economy." for i in range(8)] and got[99] == "No article here."


def test_names_take_nothing_out_of_articles():
    text = lambda page: sitetemplate.main_text(sitetemplate.parse(page))
    assert text('<article><h1>T</h1><div class="long-form with-sidebar"><p>The story.</p><p class="alert">Important</p><section class="discussion">Talk</section></div></article><article><p>Second.</p></article>') == "T\nThe story.\nImportant\nTalk\nSecond."
    assert text("<article><p>Short.</p><div class=comments><p>A much longer comment of a reader.</p></div><div style='display:none'>" + "hidden " * 99 + "</div><div class='box ad'>Buy</div></article>") == "Short."
    assert text('<div class="site-wrapper with-sidebar"><p>The whole long story is here.</p><div class="left-sidebar">x</div></div>') == "The whole long story is here."


NAMELESS = "<div><b>Daily</b> <i>since 1900</i></div><div><p>{i} is the story.</p><p>Read more of our stories.</p></div><div>Write to us.</div>"


def test_templates_without_telling_names(spark):
    """Nothing but the counts tells this site's furniture: without templates it would stay."""
    rows = [(i, f"http://n.example/{i}", NAMELESS.replace("{i}", str(i))) for i in range(12)]
    got = {r.page_id: r.text for r in sitetemplate.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"{i} is the story." for i in range(12)}
    assert sitetemplate.main_text(sitetemplate.parse(rows[3][2])) == "Daily since 1900\n3 is the story.\nRead more of our stories.\nWrite to us."


def test_template_counts_by_brute_force(spark):
    pages = [(i, f"http://{'ab'[i % 2]}.example/{i}", (NAMELESS if i % 3 else "<article><p>Own {i}</p><p>Shared line</p></article><div>Write to us.</div>").replace("{i}", str(i // 4))) for i in range(40)]
    pages += [(100, None, None), (101, "http://a.example/x", "")]
    seen, total = collections.defaultdict(set), collections.defaultdict(set)
    for _, url, html in pages:
        host = (url or "http:///").split("/")[2]
        page, inside, outside = sitetemplate.subtrees(html)
        total[host].add(page)
        for place, digests in (("inside", inside), ("outside", outside)):
            for d in digests:
                seen[host, place, d].add(page)
    want = collections.defaultdict(set)
    for (host, place, d), of in seen.items():
        if len(of) >= 5 and len(of) >= {"inside": 0.5, "outside": 0.1}[place] * len(total[host]):
            want[host, place].add(d)
    known = sitetemplate.templates(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()
    got = {(r.host, place): set(r[place]) for r in known for place in ("inside", "outside") if r[place]}
    assert got == dict(want) and want["a.example", "outside"]


def test_parsing_is_linear():
    for page in ("<div>" * 30_000 + "</b></i></span>" * 30_000 + "x", "<p>" * 30_000 + "</section></b>" * 30_000, "<ul><li>" * 30_000, "<table><tr><td>" * 20_000 + "</div>" * 20_000):
        began = time.process_time()
        sitetemplate.subtrees(page)
        assert time.process_time() - began < 8


def test_copies_of_a_page_are_no_template(spark):
    page = "<article><h1>Same</h1><p>The one story.</p></article>"
    rows = [(i, f"http://c.example/{i}", page) for i in range(30)]
    got = sitetemplate.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.text for r in got} == {"Same\nThe one story."}


def test_pages_whole(spark):
    """On the stored pages the text is the article's text."""
    import html

    want = {}
    for r in texts("pages", SF_MODEL):
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want[r["page_id"]] = "\n".join(b for b in blocks if b)
    assert {r.page_id: r.text for r in queries.op7_site_templates(spark, SF_MODEL).collect()} == want


# 8 secrets


def brute_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    for k, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out)


def test_base_spans_by_brute_force():
    bits = ["token", "=", " : ", "abcdef", "API_KEY", "apikey='", '"', "AKIA", "Z9" * 10, "0a" * 13, "deadbeef", " ", "é", "passwd", "secret=ab", "ſecret=abcdefgh", "toKen=abcdefg"]
    rng = np.random.default_rng(2)
    for _ in range(3000):
        text = "".join(rng.choice(bits, rng.integers(1, 9)))
        assert [(a, k, b) for a, k, b, _ in credentials.base_spans(text, text.encode())] == brute_base(text), text


def test_grammar_learns_formats():
    rng = np.random.default_rng(4)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(200)]
    keys = ["AKIA" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16)) for _ in range(200)]
    words = ["".join(rng.choice(["the", "tion", "ing", "er", "an", "ou"], 7)) for _ in range(500)]
    g = credentials.fit({"hex": hexes, "access": keys}, words)
    access = g.automata["access"]
    assert 1 < access.states < 40 and access.likelihood(keys[0]) > access.likelihood(words[0])
    text = "see 0123456789abcdef0123 and thetioninganouer plus AKIA2345ABCDEFGHIJK here"
    found = {text[a:b]: k for a, b, k, _ in g.spans(text, [])}
    assert found == {"0123456789abcdef0123": "like_hex", "AKIA2345ABCDEFGHIJK": "like_access"}
    assert g.spans("x" * 15, []) == []


def test_grammar_has_no_quota_and_scores_every_run():
    rng = np.random.default_rng(5)
    token = lambda n: "".join(rng.choice(list("0123456789abcdef"), n - 2)) + "a7"
    words = ["".join(rng.choice(["the", "tion", "ing", "er", "an", "ou"], 7)) for _ in range(2000)]
    bare = [token(20) for _ in range(400)]
    g = credentials.fit({"hex": [token(40) for _ in range(200)]}, words + bare)
    found = [t for t in bare if g.spans(f"see {t} here", [])]
    assert len(found) >= 0.99 * len(bare) and sum(bool(g.spans(w, [])) for w in words) <= 0.002 * len(words)
    assert [x[:3] for x in g.spans("a 0a1b2c3d4e5f6071 here", [])] == [(2, 18, "like_hex")]
    assert g.spans("card 4785380592391139 at 152.143.123.131, call 555-3824", []) == []
    text = f"token=abcdef.{bare[0]} x"  # a base span that ends within the run
    assert [x[:3] for x in g.spans(text, [(0, 0, 12, "abcdef")])] == [(12, 33, "like_hex")]


def test_automaton_knows_a_formats_length():
    rng = np.random.default_rng(7)
    hexes = lambda n, k: ["".join(rng.choice(list("0123456789abcdef"), k)) for _ in range(n)]
    for n in (12, 60, 300):
        a = credentials.Automaton(hexes(n, 40))
        assert a.states == 41
        right, short, long = (np.mean([a.likelihood(s) / k for s in hexes(20, k)]) for k in (40, 30, 50))
        assert right > short and right > long
    assert credentials.Automaton(["ab" * k for k in range(1, 30)]).states < 20


PLANTED = {"ghp": ("ghp_", 36), "sk": ("sk_live_", 24), "jwt": ("eyJhbGciOiJIUzI1NiJ9.eyJzdWIi", 30)}


def planted(rng, kind):
    head, n = PLANTED[kind]
    return head + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n))


def like_spans(grammar, text):
    """Added spans by trying every run and every rest of a run, one after another."""
    base = brute_base(text)
    taken = {i for a, _, b in base for i in range(a, b)}
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]{6,}", text):
        free = [i for i in range(*m.span()) if i not in taken]
        for _, of in itertools.groupby(enumerate(free), lambda x: x[1] - x[0]):
            of = [i for _, i in of]
            run = text[of[0] : of[-1] + 1]
            usual = grammar.ordinary.likelihood(run)
            gain, kind = max((a.likelihood(run) - usual, k) for k, a in grammar.automata.items())
            if len(run) >= 6 and gain > max(grammar.threshold, credentials.LEAST_GAIN * len(run)):
                out.append(f"like_{kind}:{of[0]}:{of[-1] + 1}")
    return out


def test_planted_formats_are_found(spark):
    """Formats that stand behind a keyword in some texts are found bare in others, and words are not."""
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(["the", "tion", "ing", "er", "an", "ou", "re"], rng.integers(2, 6))) for _ in range(1500)]
    rows, bare = [], {}
    for i in range(400):
        text = " ".join(rng.choice(words, 30))
        kind = list(PLANTED)[i % 3]
        if i < 120:
            text = f'{text} token="{planted(rng, kind)}" end'
        elif i < 180:
            bare[i] = planted(rng, kind)
            text = f"{text} {bare[i]} end"
        rows.append((i, text))
    rows += [(1000, None), (1001, ""), (1001, ""), (1002, "token=abcdef." + planted(rng, "ghp") + " " + "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    grammar = credentials.train(docs)
    assert grammar.automata["assign"].states > 30
    got = {r.doc_id: r for r in credentials.scan(docs, grammar).collect()}
    for i, text in rows:
        want = like_spans(grammar, text or "")
        assert [x for x in got[i].spans.split(",") if x.startswith("like_")] == want and got[i].n_like == len(want)
        assert len(got[i].gains) == len([x for x in got[i].spans.split(",") if x])
    found = sum(f"like_assign:{rows[i][1].index(v)}:{rows[i][1].index(v) + len(v)}" in got[i].spans for i, v in bare.items())
    assert found >= 0.9 * len(bare) and sum(got[i].n_like for i in range(400) if i not in bare) <= 2


def test_secret_scan_is_linear():
    g = credentials.fit({"hex": ["0123456789abcdef" * 2] * 10}, ["the", "words", "others"] * 20)
    for text in ("token=" + "a" * 3_000_000, "token=abcdef é AKIA" * 150_000, "abcdefgh0a " * 250_000, "0a1b2c3d4e" * 300_000):
        began = time.process_time()
        base = credentials.base_spans(text, text.encode())
        g.spans(text, base)
        sum(1 for _ in credentials.outside(credentials.CANDIDATE.finditer(text), base))
        assert time.process_time() - began < 20


def test_secret_query(spark):
    rows = {r["doc_id"]: r["text"] for r in texts()}
    for r in queries.op8_secrets(spark, SF).collect():
        base = brute_base(rows[r.doc_id] or "")
        said = ",".join(f"{credentials.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


# 9 repetition


def test_repeated_words_by_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(300):
        words = [str(x) for x in rng.integers(0, rng.integers(1, 6) + 1, rng.integers(0, 60))]
        text = "".join(w + rng.choice([" ", "\n", "\t", "  "]) for w in words)
        m = repetition.measure(text.encode())
        seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
        assert (m["n_words"], m["n_repeat_words"], m["word_chars"]) == (len(words), len(hit), sum(map(len, words)))
        for n, chars in zip(repetition.LIMITS, m["ngram_chars"], strict=True):
            first, cover = {}, set()
            for i in range(len(words) - n + 1):
                if first.setdefault(tuple(words[i : i + n]), i) != i:
                    cover |= set(range(i, i + n))
            assert chars == sum(len(words[i]) for i in cover)


def test_colliding_hashes_are_verified():
    ids = np.array([0, 1, 2, 0, 1, 3])
    first, later = repetition.duplicated(np.zeros(5, np.uint64), ids, 2)
    assert first.tolist() == [0] and later.tolist() == [3]


# 10 SimHash


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def reach(fps):
    """Least reachable node by plain search."""
    nodes = sorted(fps)
    root = {}
    for n in nodes:
        if n in root:
            continue
        todo = [n]
        while todo:
            x = todo.pop()
            if x in root:
                continue
            root[x] = n
            todo += [y for y in nodes if y not in root and (fps[x] ^ fps[y]).bit_count() <= 2]
    return root


def test_simhash_by_brute_force(spark):
    rows = texts()
    fps = {r["doc_id"]: brute_fp(r["text"]) for r in rows}
    root = reach(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", root[i]) for i, f in fps.items()}


def test_links_lose_no_pair(spark):
    rng = np.random.default_rng(8)
    fps = {int(x) for x in rng.integers(0, 2**63, 20)}
    for f in list(fps):
        for _ in range(12):
            g = f
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                g ^= 1 << int(b)
            fps.add(g)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    got = [frozenset((r.a, r.b)) for r in simhash.links(df).collect()]
    want = {frozenset((signed(a), signed(b))) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2}
    assert set(got) == want and len(got) == len(want)


def test_dense_families_link_through_their_least(spark):
    """Families that share a half: links of at most two bits, no more than there are pairs, and the same classes."""
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    rng = np.random.default_rng(10)
    base = 0x9E3779B97F4A7C15
    fps = {base ^ (1 << i) ^ (1 << j) for i in range(32) for j in range(i)} | {base} | {base ^ (1 << i) for i in range(64)}
    fps |= {base ^ (int(x) << 32) for x in rng.integers(0, 2**32, 150)} | {base ^ int(x) for x in rng.integers(0, 2**32, 150)}
    fps |= {f ^ (1 << int(b)) for f, b in zip(sorted(fps), rng.integers(0, 64, len(fps)), strict=True)}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    got = {(r.a, r.b) for r in simhash.links(df, dense=8).collect()}
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in got)
    pairs = {(signed(a), signed(b)) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2}
    assert got <= {(min(p), max(p)) for p in pairs} and not simhash.dense_halves(df, 8).isEmpty()

    def classes(of):
        root = {signed(f): signed(f) for f in fps}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in of:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
        return {f: top(f) for f in root}

    assert classes(got) == classes(pairs)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a bigint, b bigint")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_one_document_of_each_group_stays(spark):
    t = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(5, t), (3, t), (3, t), (9, "quite another text of some words here"), (None, None), (7, ""), (None, "unlike all the other texts it has no id")]
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    assert got == sorted([(3, t), (7, ""), (9, rows[3][1]), (None, rows[6][1])], key=repr)
    other = "of one id with the first but of quite different words"
    rows = [(1, t), (1, other), (None, "no id at all has this text"), (None, "nor has that other one of many words"), (2, t)]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(rows[:4], key=repr)


# all of them on edge cases

BENCH = [(1, "one")]
LABELS = [(4, 1, 1), (5, 1, None), (None, 0, 0)]
#: By operator: the rows of a report, or of a filter, on documents.
REPORTS = {
    "op1": lambda s, d: decontam.report(d, s.createDataFrame(BENCH, "item_id bigint, text string")),
    "op1 blocks": lambda s, d: decontam.report(d, s.createDataFrame([*BENCH, (2, "a b c")], "item_id bigint, text string"), 1),
    "op2": lambda s, d: toxicity.report(d, s.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")),
    "op3": lambda s, d: linededup.report(d),
    "op3 whole": lambda s, d: linededup.dedup(d),
    "op4": lambda s, d: token_records.written(d, s),
    "op5": lambda s, d: langid.report(d),
    "op7": lambda s, d: sitetemplate.extract(odd(d.toDF(*["page_id", "html", "url", *d.columns[3:]]).select("page_id", "url", "html"))),
    "op8": lambda s, d: credentials.report(d),
    "op9": lambda s, d: repetition.report(d),
    "op10": lambda s, d: simhash.near_duplicates(d),
}
FILTERS = {
    "op1": lambda s, d: decontam.clean(d, s.createDataFrame(BENCH, "item_id bigint, text string")),
    "op1 blocks": lambda s, d: decontam.clean(d, s.createDataFrame([*BENCH, (2, "zzz")], "item_id bigint, text string"), 1),
    "op5": lambda s, d: langid.accepted(d),
    "op6": lambda s, d: mixing.mix(d, numbered=False),
    "op9": lambda s, d: repetition.kept(d),
    "op10": lambda s, d: simhash.keep_first(d),
}


@pytest.mark.parametrize("name", REPORTS)
def test_reports_on_edge_rows(spark, name):
    assert len(REPORTS[name](spark, edge(spark)).collect()) == len(EDGE)
    assert REPORTS[name](spark, odd(empty(spark))).collect() == []


@pytest.mark.parametrize("name", FILTERS)
def test_filters_on_edge_rows(spark, name):
    df = edge(spark)
    out = FILTERS[name](spark, df)
    assert out.columns == df.columns
    left = {"op1": 6, "op1 blocks": 6, "op5": 5, "op9": 0, "op10": 5}.get(name)
    rows = [tuple(r) for r in out.collect()]
    assert left is None or len(rows) == left
    assert all(r[5:] == ("x",) * len(ODD) for r in rows) and {r[:2] for r in rows} <= set(EDGE)
    none = FILTERS[name](spark, odd(empty(spark)))
    assert none.columns == df.columns and none.collect() == []


def test_edge_values(spark):
    df = edge(spark)
    mixed = mixing.mix(df)
    assert mixed.columns.count("copy") == 1 and mixed.columns.count("Copy") == 1 and mixed.columns.count("shuffle_key") == 1 and mixed.collect()
    by = {r.doc_id: r for r in langid.report(df).collect()}
    assert by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[4].lang_pred == "en"
    once = {r.doc_id: r.n_words for r in repetition.report(df).collect()}
    assert once[1] == once[2] == once[3] == 0 and once[6] == 36_000
    assert simhash.keep_first(df).where("doc_id = 4").count() == 1
    hit = {r.doc_id: r.n_hit for r in REPORTS["op1"](spark, df).collect()}
    assert hit == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0, None: 0, 6: 0}
    assert mixing.rates(empty(spark)).count() == 0
