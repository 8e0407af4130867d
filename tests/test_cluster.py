import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions import grams
from kinfold.operators import blocking, companions, features, generate, scoring
from kinfold.operators.cluster import candidates, cluster, cluster_names
from kinfold.plans import names as plan
from kinfold.session import cut

NAMES = ["IBM Corp", "I.B.M.", "International Business", "Acme Widgets Inc", "Acme Widgets Incorporated", "Acme Widgetts", None, "?!", "日本", "Zeta"]
SF = "/root/testdata/sf0.001"


def frame(spark, names=NAMES, **more):
    rows = [(i, n, "kept", *more.values()) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "pos long, name string, cluster_id string")


def test_nulls_and_extra_columns(spark):
    out = cluster(frame(spark), order_col="pos", threshold=0.4)
    assert out.columns == ["pos", "name", "cluster_id", "canonical_name"] and dict(out.dtypes)["cluster_id"] == "bigint"
    rows = {r.pos: r for r in out.collect()}
    assert [rows[i].cluster_id for i in (6, 7, 8)] == [None] * 3 and rows[6].canonical_name is None
    assert rows[0].cluster_id == rows[1].cluster_id and rows[3].cluster_id == rows[4].cluster_id == rows[5].cluster_id
    found = sorted({(r.cluster_id, r.canonical_name) for r in rows.values() if r.cluster_id is not None})
    assert [c for c, _ in found] == list(range(len(found))) and [n for _, n in found] == sorted(n for _, n in found)


def test_same_for_any_number_of_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "5"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = plan.names(spark, SF).repartition(int(n))
            results.append(sorted(map(str, cluster(df, order_col="row_id").select("row_id", "cluster_id", "canonical_name").collect())))
        assert results[0] == results[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_few_names_never_pair(spark):
    assert cluster_names(spark, ["acme widgets", "acme widget"], threshold=0.0) == [1, 0]
    assert cluster_names(spark, []) == [] and cluster_names(spark, [None]) == [None] and cluster_names(spark, ["x"]) == [0]


def test_threshold_zero_joins_names_without_grams(spark):
    got = cluster_names(spark, ["a", "b", "c", "longer name"], threshold=0.0)
    assert got[0] == got[1] == got[2] != got[3]


def test_stricter_thresholds_give_more_clusters(spark):
    df = plan.names(spark, SF)
    n = [cluster(df, order_col="row_id", threshold=t).select("cluster_id").distinct().count() for t in (0.8, 0.9, 0.99)]
    assert n == sorted(n)


def test_options_are_checked(spark):
    for bad in ({"threshold": 1.5}, {"ngram_size": 0}, {"lsh_bands": 0}):
        with pytest.raises(ValueError):
            cluster(frame(spark), **bad)
    with pytest.raises(TypeError):
        cluster(frame(spark), "pos")


def test_aliases(spark):
    names = ["IBM", "International Business Machines", "Other Thing", "Third Thing Inc"]
    assert len(set(cluster_names(spark, names))) == 4
    got = cluster_names(spark, names, aliases={"International Business Machines": ["IBM"]})
    assert got[0] == got[1]
    assert cluster_names(spark, names, aliases={}) == cluster_names(spark, names)
    df = spark.createDataFrame([("x",), ("y",), ("z",)], "name string")
    for order in ({"B Corp": ["x"], "A Corp": ["x"]}, {"A Corp": ["x"], "B Corp": ["x"]}):
        assert features.with_norm(df, "name", "n", aliases=order).where("name = 'x'").head().n == "b"


def test_blocks_are_apart(spark):
    df = spark.createDataFrame([(n, b) for b in ("x", "y", None) for n in ("Acme Widgets", "Acme Widgets Inc", "Zeta Foods", "Third One")], "name string, block string")
    rows = cluster(df, block_col="block").collect()
    assert {r.cluster_id for r in rows if r.block is None} == {None}
    assert {b: sorted({r.cluster_id for r in rows if r.block == b}) for b in "xy"} == {"x": [0, 1, 2], "y": [0, 1, 2]}


def test_candidates(spark):
    got = candidates(frame(spark), order_col="pos", min_score=0.3)
    assert got.columns == ["name_a", "name_b", "normalized_a", "normalized_b", "score"]
    assert {(r.name_a, r.name_b) for r in got.collect()} >= {("Acme Widgets Inc", "Acme Widgetts")}
    assert candidates(frame(spark), order_col="pos", min_score=0.9).count() <= got.count()


def test_lsh_pairs_are_among_exact_ones_with_equal_scores(spark):
    u = plan.uniques(spark, SF)
    lsh = {(r.a, r.b): r.score for r in scoring.scored_candidates(u, 0.5).collect()}
    exact = {(r.a, r.b): r.score for r in scoring.exact_pairs(u, 0.5).collect()}
    assert lsh and all(abs(exact[p] - s) < 2e-6 for p, s in lsh.items())
    assert {p for p, s in exact.items() if s >= 0.9} <= set(lsh)


def test_minhash(spark):
    u = cut(spark.createDataFrame([(1, "", "abcdefghij"), (2, "", "abcdefghxy"), (3, "", "ab")], "id long, block string, form string"))
    fast = {r.id: r.sig for r in blocking.signatures(u, 3, 64).collect()}
    slow = {r.id: r.s for r in u.select("id", grams.minhash(grams.distinct_ngrams("form"), 64).alias("s")).collect()}
    assert fast == slow and set(fast[3]) == {grams.PRIME}
    est = blocking.signatures(u, 3, 1024).groupBy().pivot("id", [1, 2]).agg(F.first("sig")).select(grams.estimate_jaccard(F.col("1"), F.col("2")).alias("j")).head().j
    assert abs(est - 6 / 10) < 0.1
    assert spark.range(1).select(grams.ngrams(F.lit("ab")).alias("g")).head().g == []


def test_calibrate():
    got = grams.lsh_calibrate(0.85, 0.95)
    assert got["bands"] * got["rows"] == got["num_perm"] and got["p_at_target"] >= 0.95
    for bad in ((0, 0.9), (0.5, 1)):
        with pytest.raises(ValueError):
            grams.lsh_calibrate(*bad)


def test_explain(spark):
    c = cut(cluster(frame(spark), order_col="pos", threshold=0.4))
    k = c.where("pos = 3").head().cluster_id
    got = companions.explain(c, k, order_col="pos")
    assert got["size"] == 2 and got["members"][0] == "Acme Widgets Inc" and len(got["edges"]) == 1 and got["hub_radius"] == 1
    with pytest.raises(ValueError):
        companions.explain(c, 999)
    with pytest.raises(ValueError):
        companions.explain(c, k, "nope")


def test_acronyms(spark):
    df = frame(spark, ["IBM", "I.B.M. Corp", "International Business Machines", "Int Business Mach", "GE", "General Electric", "Bank of America", "BA", "BOA", None, ""])
    got = {r.acronym: r for r in companions.acronym_map(df, order_col="pos").collect()}
    assert got["ibm"].expansion_count == 2 and got["ibm"].expansions[0] == "International Business Machines" and got["ibm"].acronym_examples == ["IBM", "I.B.M. Corp"]
    assert set(got) == {"ibm", "ge", "ba", "boa"}
    for bad in ({"min_acronym_len": 0}, {"max_acronym_len": 1}, {"min_expansion_tokens": 1}):
        with pytest.raises(ValueError):
            companions.acronym_map(df, **bad)


def test_score_clusters(spark):
    score = lambda rows: companions.score_clusters(spark.createDataFrame(rows, "p string, t string"), "p", "t").head()
    assert score([("a", "x"), ("a", "x"), ("b", "y")]).adjusted_rand == 1
    empty = score([])
    assert (empty.adjusted_rand, empty.precision, empty.recall, empty.n_items) == (1, 1, 1, 0)
    apart = score([(None, "x"), (None, "x"), ("b", "y")])
    assert apart.precision == 1 and apart.recall == 0 and apart.f1_pairs == 0 and apart.n_predicted_clusters == 3


def test_generated_names_are_found_again(spark):
    df = cut(generate.generate_examples(spark, 40, difficulty="easy", seed=42))
    got = companions.score_clusters(cluster(df, "variant_name", threshold=0.85), "cluster_id", "true_entity_id").head()
    assert got.recall >= 0.95 and got.adjusted_rand > 0.85
    again = generate.generate_examples(spark.newSession(), 40, difficulty="easy", seed=42).repartition(3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))
    for bad in ({"difficulty": "x"}, {"variants_per_entity": (3, 2)}, {"canonicals": []}):
        with pytest.raises(ValueError):
            generate.generate_examples(spark, 3, **bad)
    assert generate.generate_examples(spark, 120, difficulty="hard").select("true_canonical").distinct().count() == 120


def test_diagnostics(spark):
    rows = {r.pos: r for r in cluster(frame(spark), order_col="pos", threshold=0.4, diagnostics=True).collect()}
    assert rows[0].normalized_name == "ibm" and rows[0].cluster_size == 1 and not rows[0].flagged
    assert rows[4].cluster_size == 2 and rows[6].cluster_size is None


def test_profiles_beyond_the_vocabulary_bound_give_the_same_scores(spark):
    from kinfold.operators import features, scoring

    r = random.Random(3)
    words = ["".join(r.choice("abcdehilmnor") for _ in range(5)) for _ in range(12)]
    rows = [(i, r.choice(["x", "y"]), " ".join(r.sample(words, 3)) + r.choice(["", "a", "s"])) for i in range(160)]
    u = spark.createDataFrame([(i, b, n, n.replace(" ", "")) for i, b, n in rows], "id long, block string, norm string, form string")
    short = spark.createDataFrame([(900, "x", "q", "q"), (901, "x", "w", "w")], u.schema)
    for least in (0.0, 0.3, 0.5):
        got = []
        for most in (features.MAX_VOCABULARY, 5):
            known = features.profiles(u.unionByName(short), 3, prefix_for=least or None, max_vocabulary=most)
            assert known.select("id").distinct().count() == known.count() == 160
            buckets = known.select("block", F.explode("keys").alias("bucket"), "id", "mask1", "mask2")
            got.append({tuple(x) for x in scoring.score_pairs(blocking.lsh_pairs(buckets), known).where(F.col("score") >= least).collect()})
        assert got[0] == got[1] and got[0]
        whole = {(x.block, x.a, x.b, x.score) for x in scoring.scored_candidates(u.unionByName(short), least).collect()}
        assert whole == got[0] | ({("x", 900, 901, 0.0)} if least == 0 else set())


def test_grams_of_other_letters(spark):
    from kinfold.functions.grams import Grams, Signer

    texts = ["añb日本語añb", "ab", "", "xyzxyz", "日本語"]
    for n in (1, 3, 12):
        g = Grams(texts, n)
        name, code, times = g.counts()
        got = {(t, g.joined[p : p + n], k) for t, p, k in zip(name.tolist(), g.first[code].tolist(), times.tolist())}
        assert got == {(i, t[j : j + n], sum(t[k : k + n] == t[j : j + n] for k in range(len(t) - n + 1))) for i, t in enumerate(texts) for j in range(len(t) - n + 1)}
        who, sigs = g.signatures(Signer(n, 8))
        assert [s.tolist() for s in sigs] == [Signer(n, 8)(texts[i]).tolist() for i in who]


def every(edit, name, n=400):
    r = np.random.default_rng(1)
    return {generate.EDITS[edit](name, r) for _ in range(n)}


def test_edits():
    assert every("other form", "Inc") == {"Inc"} and every("other form", "Acme, inc.") == {f"Acme, {s}" for s in generate.SUFFIXES if s != "Inc"}
    assert every("no form", "Acme Ltd.") == {"Acme"} and every("no form", "Ltd") == {"Ltd"}
    assert every("abbreviation", "Intl, Foods (Group)") == {"International Foods (Group)"}
    assert every("abbreviation", "Acme Tech; Mfg") == {"Acme Technologies Mfg", "Acme Tech; Manufacturing"} and every("abbreviation", "Acme") == {"Acme"}
    assert every("letters", "IBM, of Armonk") == {"I B M of Armonk", "IBM, o f Armonk"} and every("letters", "A4 x") == {"A4 x"}
    assert every("comma", "Acme, Foods Inc") == {"Acme Foods Inc", "Acme, Foods, Inc"} and every("comma", "Acme Inc") == {"Acme, Inc"} and every("comma", "Acme, Inc") == {"Acme Inc", "Acme, Inc"}
    assert every("word", "a b") == {"a b"} and every("word", "a b c d") == {"a c d", "a b d"}
    assert every("the", "THE Acme") == {"Acme"} and every("the", "Theory") == {"The Theory"} and every("accents", "Café") == {"Cafe"}
    typos = every("typo", "abcd", 4000)
    assert {"abd", "abdc", "abzcd", "abzd"} <= typos and all(t.startswith("ab") for t in typos) and every("typo", "abc") == {"abc"}
    assert len(typos) == 1 + 1 + 26 + 26
