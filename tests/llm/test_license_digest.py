import hashlib
import os
import re
import textwrap

from sampleloom.llm import license_digest as ld


def brute(text):
    x = re.sub(r"(^|\n)[ \t#*/;-]*(copyright|©|\(c\))[^\n]*", "\n", (text or "").lower())
    lines = []
    for line in x.split("\n"):
        line = " ".join("".join(c if c.isalpha() or c.isdecimal() else " " for c in line).split())
        for word, same in ld.EQUIVALENT:
            line = re.sub(f"(?<= ){word}(?= )", same, f" {line} ").strip()
        if line:
            lines.append(line)
    return lines


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


MIT = next(t for k, t in ld.KNOWN if k == "MIT" and len(t) > 100)
ROWS = [
    (1, "Copyright (c) 2020 Someone\n\n" + MIT.upper().replace(",", " ,")),
    (2, "text before\nReleased under the  M.I.T. License\nreleased under the MIT licence!\nend"),
    (3, None),
    (4, ""),
    (5, "x " * 50000 + "\nLicensed under CC BY-NC 4.0.\n# © me\n"),
    (5, "x " * 50000 + "\nLicensed under CC BY-NC 4.0.\n# © me\n"),
    (None, "Licensed under the Apache License, version 2.0"),
    (8, "copyright all of it"),
    (9, MIT.replace("free of charge", "for a charge")),
]


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "digest", "license", "notices").collect()), key=str)


def test_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'q' as digest", "1 as license")
    known = ld.known_digests(spark)
    by = {}
    for k, t in ld.KNOWN:
        d = sha(" ".join(brute(t)))
        by[d] = min(by.get(d, k), k)
    want = []
    for k, t in ROWS:
        lines = brute(t)
        want.append((k, sha(" ".join(lines)), by.get(sha(" ".join(lines)), ""), ",".join(sorted({by[sha(x)] for x in lines if sha(x) in by}))))
    got = rows(ld.scan(docs, known))
    assert got == sorted(want, key=str)
    assert [r[2] for r in got if r[0] in (1, 9)] == ["MIT", ""] and [r[3] for r in got if r[0] == 5] == ["CC-BY-NC-4.0"] * 2


def test_the_query_joins(spark):
    """Whole texts and lines are joined with the known digests."""
    plans = []
    store = ld.store
    ld.store = lambda df, what: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), store(df, what))[1]
    try:
        ld.op8_license_digest(spark, "/root/testdata/sf0.001")
    finally:
        ld.store = store
    assert len(plans) == 1 and plans[0].count("Join") == 3 and "map(" not in plans[0]


def test_spellings_that_share_blanks(spark):
    docs = spark.createDataFrame([(1, "v2 v2 v2\nsub license sub\nlicense"), (2, "version 2 version 2 version 2\nsublicense sublicense")], "doc_id long, text string")
    known = ld.known_digests(spark, [("X", "v2 version 2 v2 sublicense sub license")])
    assert {r.doc_id: (r.license, r.notices) for r in ld.scan(docs, known).collect()} == {1: ("X", ""), 2: ("X", "")}


def test_empty_tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert ld.scan(docs.limit(0), ld.known_digests(spark)).count() == 0
    none = ld.known_digests(spark, [("X", " !!! "), ("Y", "(c) 2000")])
    assert {r[2:] for r in rows(ld.scan(docs, none))} == {("", "")}


def test_full_licences_in_any_wrapping(spark):
    wrap = lambda t, n: "\n\n".join(textwrap.fill(" ".join(p.split()), n) for p in re.split(r"\n[ \t]*\n", t))
    folder = os.path.join(os.path.dirname(ld.__file__), "licenses")
    rows, want = [], []
    for name in sorted(os.listdir(folder)):
        titles, *rest = open(os.path.join(folder, name), encoding="utf-8").read().split("\n%%\n")
        title, name = titles.split("\n\n")[0], name[:-4].removesuffix("-Regents")
        for head, tail in (("", ""), (f"{title}\n\nCopyright (c) 2020 Some One\n\n", ""), (title.upper() + "\n", "\n\n".join(["", *rest[1:]]))):
            for n in (35, 60, 200):  # notices of the appendix keep their lines
                rows.append((len(rows), head + wrap(rest[0], n) + tail))
                want.append(name)
    for n in (30, 47, 60, 79):
        for title in ("MIT License\n\n", "The MIT License (MIT)\nCopyright The Authors\nCopyright Others\n\n", "# MIT License\n\nCopyright (c) 2020 A\nAll rights reserved.\n\n"):
            rows.append((len(rows), title + wrap(MIT, n)))
            want.append("MIT")
    out = {r.doc_id: r for r in ld.scan(spark.createDataFrame(rows, "doc_id long, text string"), ld.known_digests(spark)).collect()}
    assert [(i, out[i].license) for i in range(len(rows))] == list(enumerate(want))


def test_only_notices_are_left_out(spark):
    texts = ["a b\ncopyright holders be liable\nc", "a b copyright holders be liable c", "(c) You must retain\nthis", "Copyright 2020 Me\n\nx", "© me\nx", "x\n\nCopyright Me\n", "x"]
    d = {r.doc_id: r.digest for r in ld.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ld.known_digests(spark)).collect()}
    assert d[0] == d[1] == sha("a b copyright owners be liable c")
    assert d[2] == sha("c you must retain this") and {d[3], d[4], d[5]} == {d[6]}
