import hashlib
import math
import random
import re

from sampleloom.llm import credential_scan as cs


def brute_base(text):
    """The patterns as they are stated, with failing matches dropped afterwards."""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_spans_against_the_stated_patterns():
    rng = random.Random(7)
    parts = ["token", "TOKEN", "api_key", "apikey", "secret", "paſſword", "=", ": ", " = ", '"', "'", "ab", "abc123", "AKIA", "AKIAAKIA" + "Z9" * 8, "AKIA" + "A1" * 8, "f" * 24, "0a" * 11, "deadbeef" * 5, " ", "\n", "é", "x.y-z"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert cs.base_spans(text) == brute_base(text), text


def keys(n, seed):
    rng = random.Random(seed)
    return ["zk_" + "".join(rng.choices("0123456789ABCDEFGHJKMNPQRSTVWXYZ", k=28)) for _ in range(n)]


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(["tion", "er", "the", "ing", "on", "ea", "st", "Un"], k=rng.randint(3, 9))) for _ in range(n)]


def test_automata_generalise_and_tell_formats_apart():
    tree = cs.Automaton(keys(400, 1))
    states = len(tree.n)
    learned = tree.generalise()
    assert len(learned.n) < states / 20
    for state in range(len(learned.n)):  # what goes in goes out
        assert learned.n[state] == learned.ends[state] + sum(learned.taken[state].values())
    formats = cs.Formats({"assign": keys(400, 1)}, words(2000, 2))
    assert min(formats.gain(k) for k in keys(200, 9)) > cs.LEAST_TOTAL
    assert max(formats.gain(w) for w in words(500, 8)) < 0


def test_scores_are_probabilities_of_classes():
    learned = cs.Automaton(["ab1", "cd2", "ef3"] * 50).generalise()
    assert math.exp(learned.score("ab1")) > 0.8 > 0.01 > math.exp(learned.score("zz9"))


ROWS = [
    *((i, f"some text with token = {k} in it and {' '.join(words(20, i))}") for i, k in enumerate(keys(300, 3))),
    (1000, "bare key " + keys(1, 77)[0] + " here"),
    (1001, None),
    (1002, ""),
    (1003, " ".join(words(3000, 5))),
    (1003, " ".join(words(3000, 5))),
    (None, "é AKIA" + "Q" * 16 + " " + "ab" * 20),
]


def test_scan_redact_and_edge_cases(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'x' as spans", "doc_id as key")
    formats = cs.fit(docs)
    out = cs.scan(docs, formats).collect()
    assert len(out) == len(ROWS)
    for key, text in ROWS:
        r = next(r for r in out if r.doc_id == key)
        base = brute_base(text or "")
        said = ",".join(f"{cs.KINDS[k]}:{a}:{e}" for a, k, e in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))
    by = {r.doc_id: r for r in out}
    assert by[1000].spans == "format:9:40" and by[1003].spans == by[1001].spans == by[1002].spans == ""
    clean = {r.doc_id: r for r in cs.redact(docs, formats).collect()}
    assert clean[1000].text == "bare key <secret> here" and clean[1001].text is None and clean[1003].text == ROWS[-2][1]
    assert clean[None].text == "é <secret> <secret>" and clean[5].text.startswith("some text with <secret> in it") and clean[5].key == 5
    assert clean[1000].spans == "x"


def test_tokens_that_reach_over_base_spans_and_dots():
    """A longer credential that holds a run of hex digits or stands partly in a base span is scored whole; covered ones are
    not scored again; dots count inside a token."""
    rng = random.Random(4)
    long = lambda: "sk_" + "".join(rng.choices("0123456789abcdef", k=30)) + "." + "".join(rng.choices("GHJKMNPQ", k=12))
    formats = cs.Formats({"assign": [long() for _ in range(300)]}, words(2000, 2))
    key = long()
    text = f"see {key}. And token={key} here"
    spans, gains = formats.scored(text)
    assert (4, 3, 4 + len(key)) in spans and (7, 2, 37) in spans and set(gains) == {4} and gains[4] > cs.LEAST_TOTAL
    assert [s for s in spans if s[1] == 0] == [(text.index("token="), 0, text.index(" here"))]
    assert set(brute_base(text)) <= set(spans)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert cs.scan(docs, cs.fit(docs)).count() == 0


def test_labels_come_from_all_documents(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    few = cs.labelled_values(docs, sample_docs=5).collect()
    assert {r.value for r in few if r.kind == "assign"} >= set(keys(300, 3))
    assert 0 < sum(r.kind == "" for r in few) < sum(r.kind == "" for r in cs.labelled_values(docs).collect())
    assert len(cs.fit(docs, sample_docs=5).automata) == 1
    assert cs.fit(docs, labelled=100, sample_docs=5).automata[0].n[0] >= 100


def plain_merge(words, alpha):
    """The same inference by the book, over prefixes: a state is a set of merged prefixes, and counts come from the words."""
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    classed = [w.translate(cs._TO_CLASS) for w in words]
    visits, ends, kids = {}, {}, {}
    for w in classed:
        for i in range(len(w) + 1):
            visits[w[:i]] = visits.get(w[:i], 0) + 1
            if i < len(w):
                kids.setdefault(w[:i], {})[w[i]] = w[: i + 1]
        ends[w] = ends.get(w, 0) + 1
    n, end, moves = dict(visits), {p: ends.get(p, 0) for p in visits}, {p: dict(kids.get(p, {})) for p in visits}
    taken = {p: {c: visits[q] for c, q in moves[p].items()} for p in visits}

    def alike(a, b):
        most = bound * (n[a] ** -0.5 + n[b] ** -0.5)
        if abs(end[a] / n[a] - end[b] / n[b]) > most or any(abs(taken[a].get(c, 0) / n[a] - taken[b].get(c, 0) / n[b]) > most for c in {*taken[a], *taken[b]}):
            return False
        return all((moves[a][c], moves[b][c]) == (a, b) or alike(moves[a][c], moves[b][c]) for c in {*taken[a]} & {*taken[b]})

    def fold(a, b):
        n[a] += n[b]
        end[a] += end[b]
        for c, q in list(moves[b].items()):
            taken[a][c] = taken[a].get(c, 0) + taken[b][c]
            if c in moves[a]:
                fold(moves[a][c], q)
            else:
                moves[a][c] = q

    kept = [""]
    while True:
        frontier = [(p, c, q) for p in kept for c, q in sorted(moves[p].items()) if q not in kept]
        if not frontier:
            break
        p, c, q = max(frontier, key=lambda x: n[x[2]])
        red = next((k for k in kept if alike(k, q)), None)
        if red is None:
            kept.append(q)
        else:
            moves[p][c] = red
            fold(red, q)
    return {(n[p], end[p], tuple(sorted((c, t, n[moves[p][c]]) for c, t in taken[p].items()))) for p in kept}, len(kept)


def test_merging_against_the_plain_form():
    rng = random.Random(12)
    cases = [keys(60, 2), words(150, 3), ["ab1", "cd2", "ef3"] * 30, ["".join(rng.choices("a1Z-", k=rng.randint(0, 6))) for _ in range(300)], [""], ["a" * k for k in range(1, 40)]]
    for sample in cases:
        for alpha in (0.05, 0.5):
            got = cs.Automaton(sample).generalise(alpha)
            states = {(got.n[s], got.ends[s], tuple(sorted((c, t, got.n[got.moves[s][c]]) for c, t in got.taken[s].items()))) for s in range(len(got.n))}
            assert (states, len(got.n)) == plain_merge(sample, alpha)
