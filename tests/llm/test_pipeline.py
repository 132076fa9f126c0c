"""The pipeline, stage by stage, against brute force."""

import hashlib
import random

import pytest

import corpus_pipeline as P
from ledgerline.llm.common import load
from tests.llm.test_llm import brute_leaks, brute_substrings, words


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    docs, out = load(spark, data, "documents"), []
    for name, f in P.STAGES:
        at = str(tmp_path_factory.mktemp("p") / name)
        f(spark, docs, data).write.parquet(at)
        done = spark.read.parquet(at)
        out.append((docs, done))
        docs = done
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    assert all(done.columns == P.COLUMNS for _, done in stages[:-1])


def test_quality_keeps_good(spark, data, stages):
    labels = {r["doc_id"]: r["quality"] for r in load(spark, data, "labels").collect()}
    kept = {i for i, _ in pairs(stages[0][1])}
    told = [(i in kept, q == 1) for i, q in labels.items()]
    assert sum(a == b for a, b in told) / len(told) > 0.97


def brute_similar(rows, similarity=0.8):
    """(id, smallest id reachable) over links of texts with a Jaccard similarity of their five-word runs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or min(len(x), len(y)) >= similarity * max(len(x), len(y)) and len(x & y) >= similarity * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((rows[i][0], least[find(i)]) for i in range(len(rows)))


def test_near_copies_of_similarity(spark, stages):
    """Copies with words changed, dropped and added, around 0.8, in chains, and short and empty texts."""
    rnd = random.Random(3)
    base = [[f"w{rnd.randrange(5000)}" for _ in range(n)] for n in (30, 60, 200, 900, 4, 5, 6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(100, ""), (101, " ")]
    for k in range(160):
        w = list(base[k % len(base)]) if k % 3 else rows[rnd.randrange(len(rows))][1].split()
        for _ in range(rnd.randrange(1 + len(w) // 25)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randrange(2)] = [f"x{rnd.randrange(9999)}"][: rnd.randrange(2)]
        rows.append((200 + k, " ".join(w)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_similar(rows)
    assert sorted(r["doc_id"] for r in P.keep_one_of_near_copies(spark, docs, "").collect()) == sorted({c for _, c in want})
    before, after = map(pairs, stages[1])
    assert sorted(i for i, _ in after) == sorted({c for _, c in brute_similar(before)})


def test_passages(stages):
    before, after = map(pairs, stages[2])
    want = {i: (n, r, h) for i, n, r, h in brute_substrings(before, 20)}
    text = dict(after)
    for i, t in before:
        n, r, h = want[i]
        if r and r == n:
            assert i not in text
        elif r:
            assert hashlib.sha256(text[i].encode()).hexdigest() == h
        else:
            assert text[i] == t


def test_leaks(spark, data, stages):
    before, after = map(pairs, stages[3])
    items = [(r["item_id"], r["text"]) for r in load(spark, data, "benchmark").collect()]
    clean = {d for d, _, _, found in brute_leaks(before, items, 8) if not found}
    assert set(after) == {(i, t) for i, t in before if i in clean}


def test_pack(stages):
    docs, packed = stages[4]
    n = {i: len(words(t)) + 1 for i, t in pairs(docs)}
    got: dict = {}
    fill: dict = {}
    for r in packed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
        fill.setdefault((r["bin_id"], r["bin_size"]), []).append(r["n_tokens"])
    assert got == n and all(sum(v) <= size for (_, size), v in fill.items())


TABLE = "doc_id long, text string, lang string, source string, n_chars long"


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_rows_not_ids(spark):
    """A repeated id takes no other text with it; of equal rows one stays; a null id goes before others do."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, one), (5, one), (5, two), (20, three), (20, three), (None, three), (None, None), (7, ""), (8, " ")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], TABLE)
    assert kept(P.keep_one_of_near_copies(spark, docs, "")) == sorted([(1, one), (5, two), (7, ""), (20, three)], key=repr)


def test_leak_by_row(spark, data, tmp_path):
    spark.createDataFrame([("i", "z1 z2 z3 z4 z5 z6 z7 z8 z9")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(5, "q z1 z2 z3 z4 z5 z6 z7 z8 q", None, None, 0), (5, clean, None, None, 0), (None, clean, "x", None, 0), (None, None, None, None, None)], TABLE)
    assert kept(P.drop_leaked(spark, docs, str(tmp_path))) == sorted([(5, clean), (None, clean), (None, None)], key=repr)


def test_stages_on_messy_tables(spark, data):
    """Nulls everywhere, repeated rows, clashing extra columns, no rows."""
    long = " ".join(f"v{i % 9000}" for i in range(60_000))
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, long, "en", "s", 5), (3, "a b", None, None, None)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TABLE + ", row int, __id string, n_words int")
    for table in (docs, docs.limit(0)):
        for name, f in P.STAGES:
            out = f(spark, table, data)
            n = out.count()
            assert n <= (2 * table.count() + 40 if name == "packing" else table.count())
            assert name == "packing" or out.columns == P.COLUMNS


def test_tables_of_a_stage_go(spark):
    """Only what a stage returns is left of it."""
    import os

    from ledgerline.llm import common as C

    before = set(os.listdir(C.shared_dir(spark)))
    out = C.stage_output(spark, lambda: C.materialise(C.materialise(spark.range(5), "one").filter("id > 1"), "two").filter("id > 2"), "three")
    assert [r[0] for r in out.orderBy("id").collect()] == [3, 4] and {n.split("-")[0] for n in set(os.listdir(C.shared_dir(spark))) - before} == {"three"}


def test_run_is_the_stages(spark, data, stages):
    assert sorted(map(repr, P.run(spark, data).collect())) == sorted(map(repr, stages[-1][1].collect()))
