import random
from collections import Counter

import pytest

import corpus_pipeline as cp
from sampleloom.llm import credential_scan, langid, length_buckets, pareto_mix
from tests.llm.test_length_buckets import check as check_batches
from tests.llm.test_pareto_mix import brute_copies, brute_targets
from tests.llm.test_setsketch import brute as brute_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [tuple(r) for r in table]
    rng = random.Random(1)
    rows += [(10_000 + i, r[1].replace(" the ", " a ", 1), r[2], r[3], r[4]) for i, r in enumerate(rng.sample(rows, 30))]
    rows += [(20_000, None, "en", "s", None), (20_001, "", None, None, 0), (20_002, "12 34 !!", "en", "s", 8), rows[3], rows[3], (None, rows[5][1] + " more", None, None, 1)]
    return spark.createDataFrame(rows, COLUMNS)


def words(text):
    return len((text or "").split())


def test_stages_against_brute_force(spark, docs):
    assert [name for name, _ in cp.STAGES][:1] == ["language ID"] and len(cp.STAGES) == 5
    rows = [tuple(r) for r in docs.collect()]

    one = [tuple(r) for r in cp.identified(spark, docs, "").collect()]
    model = langid.fit(docs)
    said = [langid.label(model, [r[1] or ""])[0] for r in rows]
    assert Counter(one) == Counter(r for r, (lang, score, _) in zip(rows, said) if lang != "und" and score >= cp.LEAST_LANGUAGE)
    assert {20_000, 20_001, 20_002}.isdisjoint(r[0] for r in one) and len(one) >= len(rows) - 4

    df = spark.createDataFrame(one, COLUMNS)
    two = [tuple(r) for r in cp.deduplicated(spark, df, "").collect()]
    comp = brute_components([r[:2] for r in one])
    want = {r for r in one if r[0] is not None and comp[r[0]][1] == r[0]}  # the row with a null id is a near copy of another
    assert len(two) == len(set(two)) and set(two) == want

    df = spark.createDataFrame(two, COLUMNS)
    three = {r[0]: tuple(r) for r in cp.redacted(spark, df, "").collect()}
    formats = credential_scan.fit(df)
    assert len(three) == len(two)
    for r in two:
        spans, cut = formats.spans(r[1]), list(r[1])
        got = three[r[0]]
        if not spans:
            assert got == r
        else:
            assert "<secret>" in got[1] and got[4] == len(got[1]) and not credential_scan.base_spans(got[1])
            inside = {i for a, _, e in spans for i in range(a, e)}
            assert got[1].replace("<secret>", "") == "".join(c for i, c in enumerate(cut) if i not in inside)

    df = spark.createDataFrame(list(three.values()), COLUMNS)
    four = [tuple(r) for r in cp.mixed(spark, df, "").collect()]
    u = {r.doc_id: r.u for r in df.select("doc_id", pareto_mix.uniform(df.doc_id).alias("u")).collect()}
    sized = [(r[0], r[3], words(r[1]), u[r[0]]) for r in three.values()]
    sizes = Counter()
    for r in sized:
        sizes[r[1]] += r[2]
    copies = brute_copies(sized, brute_targets(sizes))
    assert Counter(r[0] for r in four) == Counter({k: n for k, n in copies.items() if n})
    assert all(three[r[0]] == r for r in four)

    df = spark.createDataFrame(four, COLUMNS)
    five = cp.packed(spark, df, "").collect()
    check_batches([(r[0], words(r[1])) for r in four], five, length_buckets.BUDGET)


def test_empty_tables(spark, docs):
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_long_texts_and_columns_of_any_name(spark, docs):
    """Columns that have the names of our own come through all stages as they are; so does a very long text."""
    rows = [(*map(list(r.asDict().values()).__getitem__, range(5)), f"h{i}", i, -i, "k") for i, r in enumerate(docs.where("doc_id < 60").collect())]
    rows.append((70_000, rows[0][1] + " " + " ".join(f"und der{i} the and" for i in range(100_000)), "en", "s", 9, "long", 1, 2, "k"))
    df = spark.createDataFrame(rows, COLUMNS + ", _hash string, _tie int, row int, key string")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, stage in cp.STAGES[:4]:
        own = lambda rows: {(r.doc_id, r._hash, r._tie, r.row, r.key) for r in rows}
        before = own(df.collect())
        df = spark.createDataFrame(stage(spark, df, "").collect(), df.schema)
        assert df.count() and own(df.collect()) <= before
        if name != "mixing to target weights":
            assert df.where("doc_id = 70000").count() == 1
    assert batch and cp.packed(spark, df, "").count() == df.count()


def test_run(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    n = out.count()
    assert n > 100 and out.columns == ["doc_id", "length", "bucket", "padded", "batch", "slot"]
    assert n == cp.run(spark, "/root/testdata/sf0.001").count()


def test_even_mixes_stay_and_unknown_scripts_go(spark):
    vocab = {lang: [f"{lang}{c}{d}" for c in "aeiou" for d in "rstln"] for lang in ("bq", "dx", "fz", "gw", "hj")}
    for k in (1, 4, 5):
        langs = list(vocab)[:k]
        train = [(i, " ".join(random.Random(i).choices(vocab[x], k=30)), x, "s", 1) for i, x in enumerate(langs * 20)]
        odd = [(1000, ". ".join(" ".join(vocab[x]) for x in langs), None, "s", 1), (1001, "漢字 漢字", None, "s", 1), (1002, "漢字 " + vocab["bq"][0], None, "s", 1), (1003, "1 2", None, "s", 1)]
        kept = {r.doc_id for r in cp.identified(spark, spark.createDataFrame(train + odd, COLUMNS), "").collect()}
        assert kept == {*range(len(train)), 1000, 1002}
