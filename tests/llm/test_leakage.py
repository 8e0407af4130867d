import pickle
import random

from kinfold.llm import leakage
from kinfold.llm.leakage import leaked_items, normal_words


def WuManber(items, m=leakage.MIN_WORDS):
    return leakage.WuManber([([i], w) for i, p in items if len(w := normal_words(p)) >= m], m)


def brute(text, items, m):
    w = normal_words(text)
    runs = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
    return {k for k, p in items if any(tuple(q[i : i + m]) in runs for q in [normal_words(p)] for i in range(len(q) - m + 1))}


def test_equals_brute_force():
    r = random.Random(3)
    word = lambda: r.choice(["of", "the", "a", "quasi-x", "beta", "gamma", "delta", "4.5"])
    for m in (2, 5, 12):
        items = [(i, " ".join(word() for _ in range(r.randrange(0, 40)))) for i in range(40)]
        search = WuManber(items, m)
        for _ in range(60):
            text = " ".join(word() for _ in range(r.randrange(0, 80)))
            if r.random() < 0.5:
                p = r.choice(items)[1].split()
                at = r.randrange(len(p) + 1)
                text += " " + " ".join(p[at : at + m + r.randrange(-1, 3)]) + " end"
            assert set(search.find(text)) == brute(text, items, m)


PASSAGE = "Decide whether the weakly reflexive quasi-interface that regularises the 4.32 Totu subdetector can almost-surely be swapped for another one"


def test_what_does_not_count():
    search = WuManber([(1, PASSAGE)])
    w = PASSAGE.split()
    assert search.find(PASSAGE.upper())
    assert search.find("% " + "\n% ".join(" ".join(w[i : i + 4]) for i in range(0, len(w), 4)))
    assert search.find(" ".join(rf"\emph{{{x}}}" for x in w))
    assert search.find(PASSAGE.replace("reflexive", "refle-\n% xive").replace(" the ", "~the\r\n").replace("Totu", "{\\em Totu}"))
    assert search.find("x " + " ".join(w[:12]) + " y") and not search.find("x " + " ".join(w[:11]) + " y")
    assert not search.find(" ".join(w[:6] + ["\\cite{other} word"] + w[6:12]))


def test_table(spark):
    docs = spark.createDataFrame([(1, PASSAGE, 9), (1, PASSAGE, 9), (2, None, 9), (3, "", 9), (4, "b " * 500_000 + PASSAGE, 9), (5, "nothing", 9)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE.lower()), (3, "too short"), (4, None), (5, "")], "item_id int, passage string")
    assert sorted(map(tuple, leaked_items(docs, items).collect())) == [(1, 1), (1, 2), (4, 1), (4, 2)]
    assert leaked_items(docs, items.limit(0)).collect() == [] and leaked_items(docs.limit(0), items).collect() == []


def test_tables_are_bounded(spark):
    r = random.Random(5)
    items = [(i, " ".join(f"{r.choice('abcdef')}word{r.randrange(3000)}" for _ in range(r.randrange(5, 400)))) for i in range(300)] + [(999, " ".join(f"long{i % 7}x{i}" for i in range(9000)))]
    long = dict(items)[999].split()
    docs = [(k, " ".join([*p.split()[a : a + n], "end"])) for k, (i, p) in enumerate(items) for a in [r.randrange(max(1, len(p.split()) - 12))] for n in [r.choice([11, 12, 30])]]
    docs += [(1000 + k, " ".join(long[a : a + 12])) for k, a in enumerate(range(0, 8989, 131))]
    for most in (1 << 15, 1 << 18, leakage.TABLE_BYTES):
        df = spark.createDataFrame(items, "item_id int, passage string")
        blocks = list(leakage._blocks(df, 12, most))
        assert all(b.nbytes() <= most and len(pickle.dumps(b)) <= most + 10_000 for b in blocks) and (len(blocks) > 1) == (most < 1 << 20)
        got = {k: {x for b in blocks for x in b.find(t)} for k, t in docs}
        assert got == {k: brute(t, items, 12) for k, t in docs}
    small = {tuple(x) for x in leaked_items(spark.createDataFrame(docs[::9], "doc_id long, text string"), df, table_bytes=1 << 18).collect()}
    assert small == {(k, i) for k, t in docs[::9] for i in brute(t, items, 12)}
